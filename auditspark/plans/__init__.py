"""Rules, scoring and lineage of findings.

A rule gives the rows of its findings, one row each: finding_key (rows of one finding share it),
_src_row and amount. A finding that covers a large share of a ledger so never gathers in one task."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Policy = dict[str, Any]


@dataclass(frozen=True)
class Rule:
    finding_type: str
    score: int
    strength: str
    rows: Callable[[DataFrame, Policy], DataFrame]
    #: The switch in the policy that turns an optional rule on, and columns it cannot do without.
    switch: str | None = None
    needs: tuple[str, ...] = ()
    #: For a rule over single rows: its condition, and the columns whose values part its findings.
    test: Callable[[DataFrame, Policy], F.Column] | None = None
    key: tuple[str, ...] = ()


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def __call__(self, finding_type: str, score: int, strength: str, switch: str | None = None, needs: tuple[str, ...] = ()):
        def register(f):
            self.rules[finding_type] = Rule(finding_type, score, strength, f, switch, needs)
            return f

        return register

    def each(self, finding_type: str, score: int, strength: str, switch: str | None = None, needs: tuple[str, ...] = (), key: tuple[str, ...] = ("_src_row",)):
        """Registers a condition on single rows: a finding for each row, or, without a key, one of all rows."""

        def register(f):
            rows = lambda e, p: members(e.filter(f(e, p)), *key)
            self.rules[finding_type] = Rule(finding_type, score, strength, rows, switch, needs, f, key)
            return f

        return register

    @property
    def rule(self):
        return self


def finding_key(*key) -> F.Column:
    """The parts of a key, joined, or "all"."""
    return F.concat_ws("|", *[F.coalesce(k.cast("string") if hasattr(k, "cast") else F.col(k).cast("string"), F.lit("")) for k in key]) if key else F.lit("all")


def members(df: DataFrame, *key) -> DataFrame:
    """finding_key, _src_row, amount."""
    return df.select(finding_key(*key).alias("finding_key"), "_src_row", F.col("amount").cast("double").alias("amount"))


def run_rules(registry: Registry, ledger: DataFrame, policy: Policy) -> tuple[DataFrame, list[str]]:
    """The member rows of every enabled rule, and notes on the rules left out. The conditions on single rows are
    tried in one scan."""
    out, notes, tests = [], [], []
    about = lambda order, rule: [F.lit(order).alias("rule_order"), F.lit(rule.finding_type).alias("finding_type"), F.lit(rule.score).alias("score"), F.lit(rule.strength).alias("strength")]
    for order, rule in enumerate(registry.rules.values()):
        missing = [c for c in rule.needs if c not in ledger.columns]
        if missing or (rule.switch and not policy.get(rule.switch)):
            notes.append(f"{rule.finding_type}: " + (f"no column {', '.join(missing)}" if missing else f"off ({rule.switch})"))
        elif rule.test:
            tests.append((order, rule))
        else:
            out.append(rule.rows(ledger, policy).select(*about(order, rule), "finding_key", "_src_row", "amount"))
    if tests:  # rows carry the numbers of the rules that they meet; the rest is known by the number
        met = F.explode(F.array_compact(F.array(*[F.when(rule.test(ledger, policy), F.lit(order)) for order, rule in tests]))).alias("rule_order")
        keys = {rule.key: [order for order, r in tests if r.key == rule.key] for _, rule in tests}
        fields = {c for key in keys for c in key} - {"_src_row", "amount"}
        hit = ledger.select("_src_row", F.col("amount").cast("double").alias("amount"), *fields, met)
        known = F.create_map(*[x for order, rule in tests for x in (F.lit(order), F.struct(*about(order, rule)))])
        key = F.coalesce(*[F.when(F.col("rule_order").isin(orders), finding_key(*k)) for k, orders in keys.items()])
        told = F.element_at(known, F.col("rule_order"))
        out.append(hit.select("rule_order", *[told[c].alias(c) for c in ("finding_type", "score", "strength")], key.alias("finding_key"), "_src_row", "amount"))
    while len(out) > 1:  # pairs of pairs, as each union looks through all it holds
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) // 2 * 2 :]
    return out[0], notes


def priority(score) -> F.Column:
    return F.when(score >= 6, "critical").when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def adjusted(score, strength, amount, large: float = 5000.0) -> F.Column:
    """Strong evidence on a large amount counts 4 at least, weak evidence on under a tenth of it 2 at most."""
    return F.when((strength == "strong") & (amount >= large), F.greatest(score, F.lit(4))).when((strength == "weak") & (amount < large / 10), F.least(score, F.lit(2))).otherwise(score)


#: Positions that are numbered together.
CELL = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without that setting (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditspark-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that long plans are run, and planned, once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, groups: list[str], position: str, order: list[str], name: str) -> DataFrame:
    """df with `name`, 1 for the first row in the order of groups, position and order. Rows are numbered in cells
    of CELL positions and shifted by the rows of the cells before, so only counts of cells meet in one task."""
    celled = settled(df.withColumn("_cell", F.floor(F.col(position) / CELL)))
    counts = celled.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*groups, "_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*groups, "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(position, *order))
    return celled.withColumn("_in", inner).join(counts, [*groups, "_cell"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_cell", "_in", "_before")


def findings(rows: DataFrame, policy: Policy, prefix: str = "EXP", adjust: bool = True) -> DataFrame:
    """One row per finding from member rows: id in the order of rules and first rows, counts, score and
    priority."""
    found = rows.groupBy("rule_order", "finding_type", "score", "strength", "finding_key").agg(F.count("*").alias("n_rows"), F.max("amount").alias("max_amount"), F.min("_src_row").alias("first_row"))
    scored = found.withColumn("risk_score_base", F.col("score"))
    if adjust:
        scored = scored.withColumn("score", adjusted(F.col("score"), F.col("strength"), F.col("max_amount"), float(policy.get("large_amount_threshold", 5000))))
    scored = numbered(scored, ["rule_order"], "first_row", ["finding_key"], "_no").withColumn("finding_id", F.format_string(f"{prefix}-%06d", "_no"))
    return scored.select("finding_id", "finding_type", "finding_key", F.col("score").alias("risk_score"), "risk_score_base", priority(F.col("score")).alias("risk_priority"), F.col("strength").alias("evidence_strength"), "n_rows", "max_amount", "first_row", F.lit(True).alias("human_review_required"))


#: The fields of a finding's rows that are its evidence, in their order.
EVIDENCE_FIELDS = {
    "exact-duplicate-invoice": ("expense_id", "invoice_number", "amount"),
    "exact-duplicate-employee-date-amount": ("expense_id", "employee_id", "expense_date", "amount", "vendor_name"),
    "near-duplicate": ("expense_id", "employee_id", "expense_date", "vendor_name", "amount", "invoice_number"),
    "policy-threshold": ("expense_id", "expense_type", "amount", "currency"),
    "split-expense": ("expense_id", "employee_id", "expense_date", "vendor_name", "amount"),
    "split-expense-cross-merchant": ("expense_id", "employee_id", "expense_date", "vendor_name", "amount"),
    "weekend-signal": ("expense_id", "expense_date", "business_purpose"),
    "holiday-signal": ("expense_id", "expense_date", "business_purpose"),
    "robust-outlier": ("expense_id", "expense_type", "amount", "currency"),
    "sequential-invoice": ("expense_id", "vendor_name", "invoice_number", "expense_date", "amount"),
    "invoice-format-anomaly": ("expense_id", "vendor_name", "invoice_number"),
    "large-amount-low-level-approval": ("expense_id", "amount", "approver", "currency"),
    "large-amount": ("expense_id", "employee_id", "amount", "currency", "expense_type"),
    "self-approval": ("expense_id", "employee_id", "approver", "amount", "expense_type"),
    "cross-employee-invoice": ("expense_id", "invoice_number", "employee_id", "amount"),
    "submit-before-expense": ("expense_id", "employee_id", "expense_date", "submit_date"),
    "future-date": ("expense_id", "employee_id", "expense_date", "amount"),
    "missing-expense-type": ("expense_id", "amount", "expense_type"),
    "space-time-conflict": ("expense_id", "employee_id", "expense_date", "origin_city", "dest_city"),
    "cross-period": ("expense_id", "employee_id", "expense_date", "submit_date", "amount"),
    "high-frequency-small-amount": ("expense_id", "employee_id", "expense_type", "expense_date", "amount"),
    "vendor-concentration": ("expense_id", "employee_id", "vendor_name", "amount", "expense_date"),
    "shared-voucher-multiple-employees": ("expense_id", "employee_id", "pnr", "amount", "expense_date"),
    "voucher-incomplete": ("expense_id", "employee_id", "amount", "invoice_number", "invoice_date"),
    "ticket-number-reused": ("expense_id", "employee_id", "ticket_number", "expense_date", "amount"),
    "ticket-issue-after-flight": ("expense_id", "employee_id", "ticket_number", "issue_date", "expense_date"),
    "itinerary-segment-conflict": ("expense_id", "employee_id", "pnr", "expense_date", "origin_city", "dest_city"),
    "consecutive-nightly-invoicing": ("expense_id", "employee_id", "expense_date", "vendor_name", "amount"),
    "same-amount-no-invoice": ("expense_id", "employee_id", "vendor_name", "amount", "expense_date", "room_number"),
    "lodging-night-mismatch": ("expense_id", "employee_id", "vendor_name", "check_in", "check_out", "nights", "amount"),
    "weekday-mismatch": ("expense_id", "employee_id", "expense_date", "weekday"),
    "row-limit-exceeded": ("expense_id", "employee_id", "expense_type", "expense_date", "amount", "unit_price", "row_limit"),
    "checkout-before-transport": ("expense_id", "employee_id", "expense_date", "check_out", "origin_city"),
    "segment-overlap": ("expense_id", "employee_id", "expense_date", "arrive_at"),
}
USUAL_FIELDS = ("expense_id", "employee_id", "amount")


def evidence(rows: DataFrame, ledger: DataFrame, fields: dict[str, tuple[str, ...]] = EVIDENCE_FIELDS) -> DataFrame:
    """(evidence_id, _src_row, field, value): one row per cell that findings point to, numbered by its first use:
    in the order of findings, their rows, and the fields of their type. A field that the ledger lacks is empty. The
    ledger's rows are far larger than their files let the planner expect, so they meet in shuffles, not in a broadcast."""
    first = rows.groupBy("rule_order", "finding_type", "finding_key").agg(F.min("_src_row").alias("first_row"))
    of_type = F.coalesce(*[F.when(F.col("finding_type") == t, F.array(*map(F.lit, f))) for t, f in fields.items()], F.array(*map(F.lit, USUAL_FIELDS)))
    used = rows.select("rule_order", "finding_type", "finding_key", "_src_row").join(first.hint("merge"), ["rule_order", "finding_type", "finding_key"])
    used = used.select("rule_order", "first_row", "finding_key", "_src_row", F.posexplode(of_type).alias("place", "field"))
    used = used.groupBy("_src_row", "field").agg(F.min(F.struct("rule_order", "first_row", "finding_key", "_src_row", "place")).alias("use"))
    used = used.select("_src_row", "field", "use.rule_order", "use.first_row", "use.finding_key", "use.place")
    out = numbered(used, ["rule_order"], "first_row", ["finding_key", "_src_row", "place"], "_no")
    names = sorted(({f for x in fields.values() for f in x} | set(USUAL_FIELDS)) & set(ledger.columns))
    cells = ledger.select("_src_row", *[F.col(n).cast("string").alias(f"_cell_{n}") for n in names])
    out = out.join(cells.hint("merge"), "_src_row")
    value = F.coalesce(*[F.when(F.col("field") == n, F.col(f"_cell_{n}")) for n in names], F.lit(""))
    return out.select(F.format_string("EV-%06d", "_no").alias("evidence_id"), "_src_row", "field", value.alias("value"))


def evidence_refs(rows: DataFrame, cells: DataFrame, fields: dict[str, tuple[str, ...]] = EVIDENCE_FIELDS) -> DataFrame:
    """(finding_type, finding_key, evidence_id): what each finding points to, a row each."""
    of_type = F.coalesce(*[F.when(F.col("finding_type") == t, F.array(*map(F.lit, f))) for t, f in fields.items()], F.array(*map(F.lit, USUAL_FIELDS)))
    used = rows.select("finding_type", "finding_key", "_src_row", F.explode(of_type).alias("field"))
    return used.join(cells.hint("merge"), ["_src_row", "field"]).select("finding_type", "finding_key", "evidence_id").distinct()


def entities(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(finding_type, finding_key, entity_type, entity): the employees and vendors of each finding's rows."""
    pairs = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(c).cast("string").alias("entity")) for t, c in (("employee", "employee_id"), ("vendor", "vendor_name")) if c in ledger.columns])
    named = rows.select("finding_type", "finding_key", "_src_row").join(ledger.select("_src_row", F.explode(pairs).alias("x")).hint("merge"), "_src_row")
    return named.select("finding_type", "finding_key", "x.entity_type", "x.entity").filter("entity IS NOT NULL").distinct()


def orphans(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Member rows that point to no row of the ledger; a valid run has none."""
    return rows.join(ledger.select("_src_row"), "_src_row", "left_anti")


ALLOWED_BY = ("expense_id", "employee_id", "employee_name", "vendor_name", "invoice_number", "expense_type")


def allow_list(raw: DataFrame) -> DataFrame:
    """The entries of an allow-list table that fill some field to match by, or amount_max; blank cells are wild."""
    from auditspark.functions import match_key, norm_text

    cell = lambda f: norm_text(F.col(f)) if f in raw.columns else F.lit(None).cast("string")
    out = raw.select(*[match_key(cell(f)).alias(f) for f in ALLOWED_BY], cell("amount_max").alias("amount_max"), cell("reason").alias("reason"))
    return out.filter(F.coalesce(*ALLOWED_BY, F.col("amount_max")).isNotNull())


def suppressed(rows: DataFrame, ledger: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) member rows: a finding is suppressed if every one of its rows matches some entry of
    the allow-list in all its filled cells, compared by match key, and in amount_max. Entries that fill the same
    cells, of which there are 64 kinds at most, are joined on them; those with an amount alone are one number."""
    from auditspark.functions import amount, match_key

    entries = allow_list(allowed).withColumn("_max", amount(F.col("amount_max"))).filter("amount_max IS NULL OR _max IS NOT NULL")
    filled = F.concat(*[F.col(f).isNotNull().cast("int").cast("string") for f in ALLOWED_BY])
    cells = ledger.select("_src_row", F.col("amount").alias("_amount"), *[(match_key(F.col(f).cast("string")) if f in ledger.columns else F.lit(None).cast("string")).alias(f) for f in ALLOWED_BY])
    hits = None
    for r in entries.select(filled.alias("filled")).distinct().collect():
        by = [f for f, bit in zip(ALLOWED_BY, r["filled"], strict=True) if bit == "1"]
        # Of entries that are alike, the most generous one counts; without an amount any will do.
        one = entries.filter(filled == r["filled"]).groupBy(*by).agg(F.max(F.coalesce("_max", F.lit(float("inf")))).alias("_most"))
        hit = cells.join(one, by).filter(F.col("_amount") <= F.col("_most")) if by else cells.filter(F.col("_amount") <= one.scalar())
        hits = hit.select("_src_row") if hits is None else hits.union(hit.select("_src_row"))
    if hits is None:
        return rows, rows.filter("false")
    judged = rows.join(hits.distinct().withColumn("_allowed", F.lit(True)), "_src_row", "left")
    whole = judged.groupBy("finding_type", "finding_key").agg(F.bool_and(F.col("_allowed").isNotNull()).alias("_all"))
    marked = rows.join(whole, ["finding_type", "finding_key"])
    return marked.filter("NOT _all").drop("_all"), marked.filter("_all").drop("_all")
