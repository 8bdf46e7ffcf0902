"""What a run leaves: flat tables with labels, summaries, pages, hand-offs, manifests and feedback.

Frames are counted in Spark; only those counts and the few findings that are shown come to the driver."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.sources import ranked, write_csv

#: Labels of priorities, strengths and finding types.
PRIORITIES = {"critical": "严重", "high": "高", "medium": "中", "low": "低"}
STRENGTHS = {"strong": "强", "moderate": "中", "weak": "弱"}
EXPENSE_LABELS = {
    "exact-duplicate-invoice": "发票号重复",
    "exact-duplicate-employee-date-amount": "同员工同日同金额",
    "near-duplicate": "金额近似",
    "policy-threshold": "超制度上限",
    "split-expense": "拆单报销",
    "weekend-signal": "周末消费",
    "holiday-signal": "节假日消费",
    "robust-outlier": "异常高额",
    "self-approval": "自审自批",
    "cross-employee-invoice": "发票跨人复用",
    "submit-before-expense": "提交早于消费",
    "future-date": "未来日期",
    "missing-expense-type": "缺费用类型",
    "sequential-invoice": "发票连号",
    "invoice-format-anomaly": "发票格式异常",
    "large-amount-low-level-approval": "大额低层级审批",
    "space-time-conflict": "时空冲突",
    "cross-period": "跨期入账",
    "high-frequency-small-amount": "高频小额",
    "resubmit-after-rejection-amount-increase": "撤回/拒绝后重提且金额增加",
    "split-expense-cross-merchant": "跨商户拆单",
    "large-amount": "绝对大额",
    "vendor-concentration": "商户集中度",
    "travel-verification-mismatch": "行程核验不符",
    "travel-verification-not-found": "行程核验未找到",
    "shared-voucher-multiple-employees": "同一凭证多人各报",
    "voucher-incomplete": "凭证要素不全",
    "ticket-number-reused": "同一票号重复出现",
    "ticket-issue-after-flight": "出票日期晚于行程日期",
    "itinerary-segment-conflict": "同一订座号同日航段矛盾",
    "shipment-amount-mismatch": "运单台账与报销金额不一致",
    "checkout-before-transport": "退房时间晚于交通出发",
    "segment-overlap": "同一人同一时段存在两段交通",
    "shipment-without-tracking": "运单缺少运单号",
    "shipment-from-private-address": "运单涉及疑似私人地址",
    "consecutive-nightly-invoicing": "连续逐晚开票",
    "same-amount-no-invoice": "同商户同额且无发票号",
    "lodging-night-mismatch": "住宿晚数与入离店日期不符",
    "invoice-payee-mismatch": "开票方与实际收款方不一致",
    "weekday-mismatch": "日期与周几不符",
    "unit-price-above-market": "单价高于参考市场价",
    "row-limit-exceeded": "超过适用差标/限额",
    "expense-without-travel-request": "差旅报销无对应出差申请",
    "office-swipe-on-offsite-claim": "报销称外地但当天有公司打卡",
    "attendance-city-mismatch": "打卡地点与出差城市不一致",
}
#: Labels of finding types of procurement.
PROCUREMENT_LABELS = {
    "shared-bank-account": "供应商共享账户",
    "shared-phone": "供应商共享电话",
    "shared-email": "供应商共享邮箱",
    "shared-address": "供应商共享地址",
    "shared-legal-representative": "供应商共享法人",
    "employee-vendor-shared-bank-account": "员工供应商共享账户",
    "employee-vendor-shared-phone": "员工供应商共享电话",
    "employee-vendor-shared-email": "员工供应商共享邮箱",
    "employee-vendor-shared-address": "员工供应商共享地址",
    "price-outlier": "价格异常偏高",
    "split-order": "拆单采购",
    "bid-text-similarity": "投标文本雷同",
    "bid-price-subcluster": "报价异常聚集",
    "bid-price-pattern": "报价模式异常",
    "new-vendor-large-order": "新供应商接大单",
    "overpayment": "超额付款",
    "payment-before-order": "付款早于下单",
    "process-order-before-approval": "下单早于审批",
    "process-order-stale-approval": "审批严重滞后",
    "process-payment-before-approval": "付款早于审批",
    "process-receipt-before-approval": "收货早于审批",
    "process-receipt-before-order": "收货早于下单",
    "buyer-vendor-concentration": "采购员供应商集中",
}
LABELS = EXPENSE_LABELS | PROCUREMENT_LABELS


def label(c, table: dict[str, str]) -> F.Column:
    """The label of a value; values without one stay."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(names[c], c)


def flat_findings(found: DataFrame, refs: DataFrame, named: DataFrame) -> DataFrame:
    """The view for people of findings(finding_id, finding_type, finding_key, ...): with labels, entities as JSON,
    and evidence ids joined by |. refs(finding_type, finding_key, evidence_id) and named(finding_type, finding_key,
    entity_type, entity) have a row each."""
    key = ["finding_type", "finding_key"]
    ids = refs.groupBy(*key).agg(F.concat_ws("|", F.array_sort(F.collect_set("evidence_id"))).alias("evidence_refs"))
    who = named.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_set(F.struct(F.col("entity_type").alias("type"), F.col("entity").alias("id"))))).alias("entities"))
    j = found.join(ids, key, "left").join(who, key, "left")
    return j.select("finding_id", "finding_type", label(F.col("finding_type"), LABELS).alias("title"), label(F.col("risk_priority"), PRIORITIES).alias("risk_priority"), label(F.col("evidence_strength"), STRENGTHS).alias("evidence_strength"), "risk_score", F.coalesce("entities", F.lit("[]")).alias("entities"), F.coalesce("evidence_refs", F.lit("")).alias("evidence_refs"))


def excluded_view(excluded: DataFrame) -> DataFrame:
    """Rows left out by their status, as they are reported."""
    names = ("expense_id", "employee_id", "status", "amount", "expense_date")
    return excluded.select(F.col("_src_row").alias("source_row"), *[F.col(n) if n in excluded.columns else F.lit(None).cast("string").alias(n) for n in names])


def suppressed_view(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings left out by an allow-list: their rows, ids, employees, vendors and largest amount."""
    have = [c for c in ("expense_id", "employee_id", "vendor_name") if c in ledger.columns]
    j = rows.join(ledger.select("_src_row", *have), "_src_row")
    listed = lambda c, name: (F.concat_ws("|", F.array_sort(F.collect_set(c))) if c in have else F.lit("")).alias(name)
    return j.groupBy("finding_type", "finding_key").agg(F.count("*").alias("rows"), listed("expense_id", "expense_ids"), listed("employee_id", "employees"), listed("vendor_name", "vendors"), F.max("amount").alias("max_amount")).withColumn("title", label(F.col("finding_type"), LABELS)).drop("finding_key")


def counts(found: DataFrame) -> dict:
    """Findings in all, by type and by priority: as many numbers as there are types and priorities."""
    rows = found.groupBy("finding_type", "risk_priority").count().collect()
    by = lambda k: {x: sum(r["count"] for r in rows if r[k] == x) for x in sorted({r[k] for r in rows})}
    return {"findings": sum(r["count"] for r in rows), "by_type": by("finding_type"), "by_priority": by("risk_priority")}


def quality_text(source: str, sizes: dict[str, int], mapping: dict[str, str], nulls: DataFrame, notes: list[str]) -> str:
    """A report on the data: sizes, mapping, null rates(column, rate) and notes, as Markdown."""
    lines = ["# Data quality", "", "A technical record of how the data were read; not a result.", "", f"- Source: `{source}`", *[f"- {k}: {v}" for k, v in sizes.items()], f"- Columns: `{json.dumps(mapping, ensure_ascii=False)}`", "", "## Empty cells", ""]
    lines += [f"- `{r['column']}`: {(r['rate'] or 0) * 100:.2f}%" for r in nulls.collect()]
    return "\n".join([*lines, "", "## Notes", "", *([f"- {n}" for n in notes] or ["- none"])]) + "\n"


def summary_text(totals: dict, n_rows: int, n_bad: int, hints: list[str] = ()) -> str:
    """The summary of a run as Markdown. Texts in the data that read like instructions come first."""
    warning = ["## Texts that read like instructions", "", f"{len(hints)} rows hold such text. It was read as data and changed nothing. Rows: {', '.join(hints[:10])}", ""] if hints else []
    kinds = [f"- {LABELS.get(k, k)} (`{k}`): {n}" for k, n in totals["by_type"].items()]
    levels = ", ".join(f"{PRIORITIES.get(k, k)} {totals['by_priority'][k]}" for k in PRIORITIES if k in totals["by_priority"])
    return "\n".join([*warning, "# Summary", "", f"- Rows analysed: {n_rows}; bad rows: {n_bad}", f"- Findings: {totals['findings']} ({levels or 'none'})", "", "Findings are leads for review, no verdicts. What was not found is not thereby in order.", "", "## By type", "", *(kinds or ["- none"])]) + "\n"


def page(title: str, totals: dict, top: list[dict], files: list[tuple[str, str]] = ()) -> str:
    """A page that needs nothing else: totals, the findings to look at first, and links to the files."""
    e = lambda x: html.escape(str(x))
    tiles = "".join(f"<div class=t><b>{totals['by_priority'].get(k, 0)}</b><br>{e(v)}</div>" for k, v in PRIORITIES.items())
    rows = "".join(f"<tr><td>{e(f['finding_id'])}<td>{e(LABELS.get(f['finding_type'], f['finding_type']))}<td>{e(PRIORITIES.get(f['risk_priority'], f['risk_priority']))}<td>{e(f['risk_score'])}</tr>" for f in top)
    kinds = "".join(f"<tr><td>{e(LABELS.get(k, k))}<td>{n}</tr>" for k, n in sorted(totals["by_type"].items(), key=lambda x: (-x[1], x[0])))
    links = "".join(f'<li><a href="{e(name)}">{e(name)}</a> {e(note)}' for name, note in files)
    style = "body{font:16px/1.5 sans-serif;max-width:60em;margin:2em auto}.t{display:inline-block;padding:1em 2em;border:1px solid #ccc;margin:.3em}td{padding:.2em 1em;border-top:1px solid #ddd}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title><style>{style}</style></head><body><h1>{e(title)}</h1><p>{totals["findings"]} leads for review, no verdicts.</p>{tiles}<h2>First</h2><table>{rows}</table><h2>By type</h2><table>{kinds}</table><ul>{links}</ul></body></html>'


def dashboard(title: str, found: DataFrame, n: int = 12, files: list[tuple[str, str]] = ()) -> str:
    return page(title, counts(found), [r.asDict() for r in ranked(found, n).collect()], files)


def timeline_span(timeline: DataFrame) -> DataFrame:
    """One row: the first and last time, and how many events."""
    return timeline.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_events"))


def memo_text(scope: dict) -> str:
    """A memo to be filled in by people."""
    parts = ("Facts verified", "Inferences", "Hypotheses and what speaks against them", "Missing evidence and next steps", "Judgement")
    head = [f"- Case: `{scope['case_id']}`", f"- Purpose: {scope['purpose']}", f"- Authorised by: `{scope.get('authorization_reference', '')}`", f"- Period: {scope['date_range']['start']} to {scope['date_range']['end']}", f"- Persons: {', '.join(scope['persons_in_scope'])}"]
    return "\n".join(["# Memo", "", *head, *[x for p in parts for x in ("", f"## {p}", "")], "This form states no responsibility."]) + "\n"


def feedback_text(totals: dict, seconds: float | None = None) -> str:
    """Counts only: no person, vendor, number or amount."""
    kinds = "; ".join(f"{k} {n}" for k, n in totals["by_type"].items())
    return f"{totals['findings']} findings ({kinds or 'none'})" + (f" in {seconds:.1f} s" if seconds is not None else "") + "."


def run_manifest(prefix: str, inputs: DataFrame, parameters: dict, mapping: dict, notes: list[str], outputs: list[str], at: datetime | None = None) -> dict:
    """What ran on what: inputs(path, sha256) with their hashes, parameters and outputs; no network is used."""
    at = at or datetime.now(timezone.utc)
    files = [{"path": r["path"], "sha256": r["sha256"]} for r in inputs.orderBy("path").collect()]
    return {"run_id": f"{prefix}-{at.strftime('%Y%m%dT%H%M%SZ')}-{files[0]['sha256'][:8] if files else 'none'}", "started_at": at.isoformat(), "input_files": files, "parameters": parameters, "field_mapping": mapping, "notes": notes, "network_access": False, "outputs": outputs}


def handoff(vendor: DataFrame, found: DataFrame) -> dict | None:
    """The case of one vendor(vendor_id, n_types, n_findings) as investigators get it: its findings, 20 at most
    spelt out, by score. None if there is no vendor."""
    first = vendor.first()
    if first is None:
        return None
    mine = found.filter(F.col("vendor_id") == first["vendor_id"])
    shown = mine.orderBy(F.desc("risk_score"), "finding_type").limit(20).select("finding_type", "risk_priority", "risk_score").collect()
    return {"vendor_id": first["vendor_id"], "n_types": first["n_types"], "n_findings": first["n_findings"], "findings": [r.asDict() for r in shown], "human_review_required": True}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text where Spark can write; a file that is there is refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def prefixed(folder: str, source: str, name: str) -> str:
    """The path of an output that carries its source's name."""
    from pathlib import PurePosixPath

    return f"{folder.rstrip('/')}/{PurePosixPath(source).stem}-{name}"


def write_sql(spark: SparkSession, folder: str, built: dict) -> list[str]:
    """What sqlgen.build() made: a .sql file for each need that can be met, the suggested mapping as JSON, and
    missing_fields.csv for the others."""
    names = []
    for need, sql in built["sql"].items():
        names.append(f"{need}.sql")
        write_text(spark, f"{folder}/{names[-1]}", sql + ";\n")
    suggested = {f: [{"confidence": c, "table": t, "column": n} for c, t, n in found] for f, found in built["suggested"].items()}
    write_text(spark, f"{folder}/mapping.suggested.json", json.dumps(suggested, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    missing = "".join(f"{need},{'|'.join(fields)}\n" for need, fields in sorted(built["missing"].items()))
    write_text(spark, f"{folder}/missing_fields.csv", "need,missing_fields\n" + missing)
    return [*names, "mapping.suggested.json", "missing_fields.csv"]


def write_run(spark: SparkSession, folder: str, source: str, found: DataFrame, clean: DataFrame, bad: DataFrame, cells: DataFrame, flat: DataFrame, mapping: dict[str, str], nulls: DataFrame, notes: list[str], inputs: DataFrame, excluded: DataFrame | None = None, dropped: DataFrame | None = None) -> dict:
    """All outputs of a run, each with the source's name before its own; excluded and suppressed rows only if there
    are any. Gives the manifest."""
    at = lambda name: prefixed(folder, source, name)
    frames = {"clean_expenses.csv": clean, "bad_rows.csv": bad, "findings.csv": flat, "excluded_by_status.csv": excluded, "suppressed_findings.csv": dropped}
    frames = {k: v for k, v in frames.items() if v is not None and (k not in ("excluded_by_status.csv", "suppressed_findings.csv") or not v.isEmpty())}
    for name, df in frames.items():
        write_csv(df, at(name))
    for name, df in (("findings.jsonl", found), ("evidence.jsonl", cells)):
        df.select(*sorted(df.columns)).write.mode("errorifexists").json(at(name), ignoreNullFields=False)
    totals, n_rows, n_bad = counts(found), clean.count(), bad.count()
    write_text(spark, at("summary.md"), summary_text(totals, n_rows, n_bad))
    write_text(spark, at("data_quality.md"), quality_text(source, {"Rows": n_rows + n_bad, "Valid rows": n_rows, "Bad rows": n_bad}, mapping, nulls, notes))
    names = [*frames, "findings.jsonl", "evidence.jsonl", "summary.md", "data_quality.md", "dashboard.html", "run_manifest.json"]
    write_text(spark, at("dashboard.html"), dashboard(source, found, files=[(prefixed(".", source, n), "") for n in names]))
    made = run_manifest("EXP", inputs, {}, mapping, notes, [prefixed(".", source, n)[2:] for n in names])
    write_text(spark, at("run_manifest.json"), json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return made
