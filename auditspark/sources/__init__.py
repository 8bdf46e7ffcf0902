"""Readers and writers: delimited, JSON and text sources, column mapping, quarantine, and result files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark import functions as fn
from auditspark.sources.records import read_csv
from auditspark.sources.shapes import list_at, read_json_file, read_json_lines, text_at

#: Names by which the columns of a ledger are known.
LEDGER = {
    "expense_id": ("expense_id", "id", "claim_id", "report_id", "单据号", "报销单号", "费用编号"),
    "employee_id": ("employee_id", "emp_id", "employee", "staff_id", "员工编号", "工号", "员工"),
    "employee_name": ("employee_name", "emp_name", "员工姓名", "姓名"),
    "department": ("department", "dept", "部门"),
    "expense_type": ("expense_type", "category", "type", "费用类型", "费用类别", "报销类型"),
    "expense_date": ("expense_date", "date", "transaction_date", "发生日期", "费用日期", "报销日期", "费用发生日期"),
    "submit_date": ("submit_date", "submission_date", "提交日期"),
    "amount": ("amount", "expense_amount", "claim_amount", "金额", "报销金额", "费用金额"),
    "currency": ("currency", "币种", "货币"),
    "vendor_name": ("vendor_name", "vendor", "merchant", "supplier", "商户", "商家", "供应商"),
    "invoice_number": ("invoice_number", "invoice_no", "invoice", "发票号", "发票号码"),
    "invoice_date": ("invoice_date", "发票日期"),
    "flight_no": ("flight_no", "flight_number", "flight", "航班号", "航班"),
    "pnr": ("pnr", "booking_ref", "record_locator", "pnr_code", "订座记录", "订座号", "PNR"),
    "ticket_number": ("ticket_number", "ticket_no", "eticket", "电子客票号", "票号", "客票号"),
    "issue_date": ("issue_date", "ticketing_date", "date_of_issue", "出票日期"),
    "check_in": ("check_in", "checkin", "check_in_date", "arrival_date", "入住日期", "入住"),
    "check_out": ("check_out", "checkout", "check_out_date", "departure_date", "离店日期", "退房日期"),
    "arrive_at": ("arrive_at", "arrival_at", "arrive_time", "到达时间", "抵达时间"),
    "nights": ("nights", "night_count", "room_nights", "晚数", "住宿晚数", "间夜"),
    "room_number": ("room_number", "room_no", "room", "房号", "房间号"),
    "weekday": ("weekday", "day_of_week", "week_day", "周几", "星期几", "星期", "礼拜"),
    "item": ("item", "spec", "item_name", "项目", "规格", "品名", "材料", "配件"),
    "unit": ("unit", "uom", "单位", "计量单位"),
    "unit_price": ("unit_price", "price", "单价", "含税单价"),
    "quantity": ("quantity", "qty", "数量", "工时"),
    "row_limit": ("row_limit", "standard", "standard_amount", "limit", "差标", "标准", "限额", "标准金额", "报销标准"),
    "project_code": ("project_code", "project", "项目编号", "项目代码"),
    "approver": ("approver", "approved_by", "审批人"),
    "payment_date": ("payment_date", "付款日期", "支付日期"),
    "business_purpose": ("business_purpose", "purpose", "description", "事由", "用途", "业务目的"),
    "origin_city": ("origin_city", "from_city", "departure_city", "出发城市", "出发地"),
    "dest_city": ("dest_city", "destination_city", "to_city", "arrival_city", "目的城市", "目的地", "到达城市"),
    "status": ("status", "approval_status", "approval_state", "state", "状态", "审批状态", "单据状态", "报销状态", "流程状态", "审批结果"),
}
DATES = ("expense_date", "submit_date", "invoice_date", "issue_date", "check_in", "check_out", "payment_date")
NUMBERS = ("amount", "unit_price", "quantity", "row_limit", "nights")


def with_ordinals(df: DataFrame, first: int = 2) -> DataFrame:
    """Adds _src_row, the record's ordinal in the source; the header is row 1. Rows are numbered within
    their partitions and shifted by the counts of those before, one number a partition."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = at.withColumn("_part", part).join(F.broadcast(counts), "_part")
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (inner + F.col("_before") + first).cast("long").alias("_src_row"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quoted line breaks allowed, all columns text, with _src_row and _src_file. Many tasks
    read a large file."""
    return read_csv(spark, path).withColumn("_src_file", F.lit(path))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of the lines that are not blank."""
    lines = with_ordinals(spark.read.text(path), 1)
    return lines.filter(F.trim("value") != "").select(F.col("_src_row").alias("line"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, too_short): whole .txt and .md files by path; under 20 visible characters is too short."""
    docs = spark.read.text([f"{folder}/*.txt", f"{folder}/*.md"], wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    size = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    return docs.filter(size >= 20), docs.filter(size < 20)


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Counts of findings by type and priority from a JSON-lines file, of whatever types these are; lines that are no
    JSON objects are left out."""
    rows = read_json_lines(spark, path)[0].filter(F.schema_of_variant("value").startswith("OBJECT"))
    return rows.groupBy(text_at(F.col("value"), "$.finding_type").alias("finding_type"), text_at(F.col("value"), "$.risk_priority").alias("risk_priority")).count()


#: The fields of nodes and edges that are columns; others stay in `value`.
NODE, EDGE = ("node_id", "name", "canonical_id"), ("from", "to", "relation_type")


def read_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a provider's JSON file: known fields as text, all of them in value. Edges have _src_row,
    their place in the file."""
    top = read_json_file(spark, path)[0]
    fields = lambda names: [text_at(F.col("value"), f"$.{n}").alias(n) for n in names]
    edges = top.select(F.posexplode(list_at(F.col("value"), "$.edges")).alias("at", "value"))
    nodes = top.select(F.explode(list_at(F.col("value"), "$.nodes")).alias("value"))
    return nodes.select(*fields(NODE), "value"), edges.select(*fields(EDGE), (F.col("at") + 1).cast("long").alias("_src_row"), "value")


def read_config(path: str, allowed: set[str], comments: bool = True) -> dict:
    """A JSON object of known keys; with `comments`, keys with a leading underscore are such."""
    import difflib

    config = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(config, dict):
        raise ValueError(f"{path}: not a JSON object")
    for k in config:
        if k not in allowed and not (comments and k.startswith("_")):
            near = difflib.get_close_matches(k, sorted(allowed), 1)
            raise ValueError(f"{path}: unknown key {k}" + (f", perhaps {near[0]}" if near else ""))
    return {k: v for k, v in config.items() if k in allowed}


def inside(root: str, relative: str) -> str:
    """The path below root; raises if it leads out of it."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if base not in (path, *path.parents):
        raise ValueError(f"{relative} leads out of {root}")
    return str(path)


def map_columns(headers: list[str], aliases: dict[str, tuple[str, ...]] = LEDGER, explicit: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> tuple[dict[str, str], list[str]]:
    """(canonical -> header, warnings): explicit headers win; a name that several headers fit stays unmapped,
    with a warning; a missing required one raises."""
    out, warnings = dict(explicit or {}), []
    lost = [h for h in out.values() if h not in headers]
    if lost:
        raise ValueError(f"no such column: {', '.join(lost)}")
    by_key: dict[str, list[str]] = {}
    for h in headers:
        by_key.setdefault(fn.header_key(h), []).append(h)
    for name, known in aliases.items():
        found = [h for a in dict.fromkeys(map(fn.header_key, known)) for h in by_key.get(a, [])]
        if name in out:
            continue
        if len(found) == 1:
            out[name] = found[0]
        elif found:
            warnings.append(f"{name}: several columns fit ({', '.join(found)})")
    missing = [r for r in required if r not in out]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return out, warnings


def normalise(raw: DataFrame, mapping: dict[str, str], default_currency: str = "CNY", amount_columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean, bad): canonical columns; a name stands in for a missing employee id, blank amounts are the
    sum of amount_columns, a nightly price follows from the nights. Bad rows keep their reasons and
    the raw record."""
    col = lambda name: fn.norm_text(F.col(f"`{mapping[name]}`"))
    columns = {}
    for name in mapping:
        columns[name] = fn.date_value(col(name)) if name in DATES else fn.amount(col(name)) if name in NUMBERS else col(name)
    text = raw.withColumns({f"_c_{k}": v for k, v in columns.items()})
    have = lambda name, kind="string": F.col(f"_c_{name}") if name in mapping else F.lit(None).cast(kind)
    value = have("amount", "double")
    if amount_columns:
        parts = F.filter(F.array(*[fn.amount(F.col(f"`{c}`")) for c in amount_columns]), lambda x: x.isNotNull())
        value = F.coalesce(value, F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))
    employee = F.coalesce(have("employee_id"), have("employee_name"))
    out = {n: F.col(f"_c_{n}") for n in mapping} | {"amount": F.round(value, 6), "employee_id": employee, "currency": fn.currency(have("currency"), default_currency)}
    if "nights" in mapping:
        out["unit_price"] = F.coalesce(have("unit_price", "double"), F.when(have("nights", "double") > 0, F.round(value / have("nights", "double"), 6)))
    reasons = F.array_compact(F.array(F.when(have("expense_id").isNull(), "expense_id is empty"), F.when(employee.isNull(), "employee_id is empty"), F.when(value.isNull(), "amount cannot be read"), F.when(have("expense_date", "date").isNull(), "expense_date cannot be read")))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if not c.startswith("_")]))
    full = text.select("_src_row", *[v.alias(k) for k, v in out.items()], F.concat_ws("；", reasons).alias("_reasons"), record.alias("_raw"))
    return full.filter("_reasons = ''").drop("_reasons", "_raw"), full.filter("_reasons <> ''").select("_src_row", F.col("_reasons").alias("reasons"), F.col("_raw").alias("raw_record"))


def null_rates(df: DataFrame) -> DataFrame:
    """(column, rate) over all rows, in one aggregation."""
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("rate")) for c in df.columns])).alias("x")
    return one.select(cells).select("x.*")


def reconciled(raw: DataFrame, clean: DataFrame, header: str) -> DataFrame:
    """Rows whose plain number in the source differs from the amount read by more than a cent."""
    plain = raw.select("_src_row", F.trim(F.col(f"`{header}`")).alias("text")).filter(F.col("text").rlike(r"^[+-]?\d+(\.\d+)?$"))
    return plain.join(clean.select("_src_row", "amount"), "_src_row").filter(F.abs(F.col("text").cast("double") - F.col("amount")) > 0.01)


def injection_hints(df: DataFrame, id_col: str, fields: tuple[str, ...] = ("business_purpose", "vendor_name", "expense_type", "employee_name", "department", "project_code")) -> DataFrame:
    """(id, field, snippet): the first field of each row with text that reads like an instruction."""
    have = [f for f in fields if f in df.columns]
    hits = [F.when(fn.injection_hint(F.col(f)).isNotNull(), F.struct(F.lit(f).alias("field"), fn.injection_hint(F.col(f)).alias("snippet"))) for f in have]
    return df.select(F.col(id_col), F.coalesce(*hits).alias("_h")).filter("_h IS NOT NULL").select(id_col, "_h.field", "_h.snippet")


def write_results(folder: str, **frames: DataFrame) -> None:
    """Each frame as Parquet and JSON lines under its name; a folder that has results already is refused."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
        df.write.mode("errorifexists").json(f"{folder}/{name}.jsonl", ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV whose cells no spreadsheet runs; arrays are joined by |."""
    flat = [F.concat_ws("|", F.col(f"`{c}`").cast("array<string>")).alias(c) if t.startswith("array") else fn.csv_safe(F.col(f"`{c}`").cast("string")).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").csv(path, header=True, escape='"')


def ranked(found: DataFrame, n: int = 12) -> DataFrame:
    """The n findings to show first, by score."""
    return found.orderBy(F.desc("risk_score"), "finding_id").limit(n)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("finding_type", "risk_priority").agg(F.count("*").alias("n_findings"), F.sum("n_rows").alias("n_rows"))


def manifest(**facts) -> str:
    return json.dumps(facts, ensure_ascii=False, sort_keys=True, indent=2, default=str)
