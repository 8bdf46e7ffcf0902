"""The registered queries of the audit operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import functions as fn
from auditspark.operators import casework, expense, external, procurement, relations, sqlgen
from auditspark.operators.expense import EXPENSE
from auditspark.plans import adjusted, findings, orphans, priority, run_rules
from auditspark.plans.adapters import LEDGER_SQL, ORDERS_SQL, ledger, orders

QUERIES = {}
ORACLES = {}

POLICY = {
    "limits": [{"expense_type": "hotel", "max_amount": 300000}, {"expense_type": "flight", "max_amount": "400,000", "currency": "CNY"}, {"max_amount": 440000}],
    "approval_thresholds": [{"amount": 300000, "currency": "CNY"}],
    "split_window_days": 60,
    "near_duplicate_window_days": 30,
    "near_duplicate_amount_tolerance": 0.15,
    "weekend_check": True,
    "holidays": ["1997-05-01", "1998-05-01", "1996-05-01"],
    "large_amount_threshold": 460000,
    "sequential_invoice_window_days": 400,
    "low_level_approver_keywords": ["lead"],
    "large_amount_check": True,
    "as_of_date": "1998-06-30",
    "high_frequency_max_amount": 100000,
    "high_frequency_window_days": 365,
    "high_frequency_min_count": 3,
    "vendor_concentration_check": True,
    "vendor_concentration_min_count": 2,
    "vendor_concentration_share": 0.1,
    "shared_voucher_check": True,
    "voucher_completeness_check": True,
    "voucher_consistency_check": True,
    "lodging_cross_check": True,
    "lodging_min_nights": 2,
    "lodging_same_amount_min_count": 2,
    "weekday_check": True,
    "row_limit_check": True,
    "split_cross_merchant": True,
    "outlier_robust_z": 1.0,
}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, the SQL it must agree with."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def by_finding(rows: DataFrame) -> DataFrame:
    return rows.groupBy("finding_key").agg(F.min("_src_row").alias("first_row"), F.count("*").alias("n_rows"), F.max("amount").alias("max_amount")).drop("finding_key")


def expense_rule(finding_type: str, sql: str, **policy) -> None:
    """A query of a ledger rule: its findings with first row, rows and largest amount."""
    rule = EXPENSE.rules[finding_type]
    query(finding_type.replace("-", "_"), f"WITH {LEDGER_SQL} {sql}")(lambda spark, sf_dir: by_finding(rule.rows(ledger(spark, sf_dir), POLICY | policy)))


def grouped(keys: str, having: str = "COUNT(*) > 1", where: str = "TRUE") -> str:
    return f"SELECT MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM e WHERE {where} GROUP BY {keys} HAVING {having}"


def each(where: str) -> str:
    return f"SELECT _src_row AS first_row, CAST(1 AS BIGINT) AS n_rows, amount AS max_amount FROM e WHERE {where}"


def together(where: str) -> str:
    return f"SELECT MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM e WHERE {where} HAVING COUNT(*) > 0"


KEY = "regexp_replace(lower({0}), '[^0-9a-z]+', '', 'g')"
_vendor, _type, _city = KEY.format("vendor_name"), KEY.format("expense_type"), KEY.format("dest_city")
_window = """w AS (SELECT a._src_row AS start, b._src_row, b.amount, b.v FROM s a JOIN s b ON a.k = b.k AND (b.d > a.d OR (b.d = a.d AND b._src_row >= a._src_row)) AND b.d <= a.d + 60),
    g AS (SELECT start, MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM w GROUP BY start HAVING COUNT(*) >= 2 AND MAX(amount) < 300000 AND SUM(amount) > 300000 {more}) SELECT first_row, n_rows, max_amount FROM g"""

expense_rule("exact-duplicate-invoice", grouped("employee_id, invoice_number, currency, amount", where="invoice_number IS NOT NULL"))
expense_rule("exact-duplicate-employee-date-amount", grouped("employee_id, expense_date, currency, amount"))
expense_rule("policy-threshold", " UNION ALL ".join(each(w) for w in ("expense_type = 'hotel' AND amount > 300000", "expense_type = 'flight' AND amount > 400000", "amount > 440000")))
expense_rule("near-duplicate", f""", p AS (SELECT a._src_row AS x, b._src_row AS y FROM e a JOIN e b ON a.employee_id = b.employee_id AND a.vendor_name = b.vendor_name AND b.expense_date - a.expense_date BETWEEN 0 AND 30 AND (b.expense_date > a.expense_date OR a._src_row < b._src_row)
    WHERE ABS(a.amount - b.amount) / GREATEST(ABS(a.amount), ABS(b.amount), 0.01) <= 0.15 AND NOT (a.amount = b.amount AND (a.expense_date = b.expense_date OR coalesce(a.invoice_number = b.invoice_number, FALSE))))
    SELECT MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM e WHERE _src_row IN (SELECT x FROM p UNION SELECT y FROM p) HAVING COUNT(*) >= 3""")
expense_rule("split-expense", f", s AS (SELECT *, employee_id || {_vendor} AS k, expense_date AS d, '' AS v FROM e), " + _window.format(more=""))
expense_rule("split-expense-cross-merchant", f", s AS (SELECT *, employee_id AS k, expense_date AS d, {_vendor} AS v FROM e), " + _window.format(more="AND COUNT(DISTINCT v) >= 2"))
expense_rule("weekend-signal", each("isodow(expense_date) >= 6"))
expense_rule("holiday-signal", each("isodow(expense_date) < 6 AND expense_date IN (DATE '1997-05-01', DATE '1998-05-01', DATE '1996-05-01')"))
expense_rule("robust-outlier", f""", p AS (SELECT *, {_type} AS t FROM e WHERE expense_type IS NOT NULL), m AS (SELECT t, MEDIAN(amount) AS med FROM p GROUP BY t HAVING COUNT(*) >= 5),
    d AS (SELECT t, med, MEDIAN(ABS(amount - med)) AS mad FROM p JOIN m USING (t) GROUP BY t, med)
    SELECT _src_row AS first_row, CAST(1 AS BIGINT) AS n_rows, amount AS max_amount FROM p JOIN d USING (t) WHERE mad <> 0 AND 0.6745 * (amount - med) / mad > 1.0 AND amount < 460000""")
expense_rule("sequential-invoice", f""", n AS (SELECT *, {_vendor} AS v, CAST(regexp_extract(invoice_number, '([0-9][0-9]+)', 1) AS BIGINT) AS no FROM e WHERE regexp_matches(invoice_number, '[0-9][0-9]')),
    g AS (SELECT *, CASE WHEN no - LAG(no) OVER (PARTITION BY v, currency ORDER BY no, expense_date, _src_row) = 1 THEN 0 ELSE 1 END AS fresh FROM n),
    r AS (SELECT *, SUM(fresh) OVER (PARTITION BY v, currency ORDER BY no, expense_date, _src_row) AS run FROM g),
    q AS (SELECT a.v, a.currency, a.run, a.no, MIN(b._src_row) AS first_row, COUNT(*) AS n_rows, MAX(b.amount) AS max_amount FROM r a JOIN r b ON a.v = b.v AND a.currency = b.currency AND a.run = b.run AND b.no >= a.no
        GROUP BY ALL HAVING COUNT(*) >= 3 AND MAX(b.expense_date) - MIN(b.expense_date) <= 400)
    SELECT first_row, n_rows, max_amount FROM q QUALIFY ROW_NUMBER() OVER (PARTITION BY v, currency ORDER BY run, no) = 1""")
expense_rule("invoice-format-anomaly", together("length(invoice_number) < 4 OR length(invoice_number) > 40 OR regexp_matches(invoice_number, '[^A-Za-z0-9_. -]') OR length(regexp_replace(invoice_number, '[^@#$%^&*!]', '', 'g')) >= 2"))
expense_rule("large-amount-low-level-approval", together("amount >= 460000 AND lower(approver) LIKE '%lead%'"))
expense_rule("large-amount", together("amount >= 460000 AND lower(approver) NOT LIKE '%lead%'"))
expense_rule("self-approval", together("list_has_any(list_transform(regexp_split_to_array(approver, '[;；,，、]'), lambda x: trim(x)), [employee_id, employee_name])"))
expense_rule("cross-employee-invoice", together("invoice_number IN (SELECT invoice_number FROM e GROUP BY 1 HAVING COUNT(DISTINCT employee_id) > 1)"))
expense_rule("submit-before-expense", together("submit_date < expense_date"))
expense_rule("future-date", together("expense_date > DATE '1998-06-30'"))
expense_rule("missing-expense-type", together("expense_type IS NULL AND amount > 300000"))
expense_rule("space-time-conflict", grouped("employee_id, expense_date", "COUNT(*) >= 2 AND COUNT(DISTINCT dest_city) > 1", "coalesce(expense_type, '') <> 'travel'"))
expense_rule("cross-period", together("year(submit_date) * 12 + month(submit_date) - year(expense_date) * 12 - month(expense_date) >= 3"))
expense_rule("high-frequency-small-amount", f""", s AS (SELECT *, {_type} AS t FROM e WHERE amount <= 100000),
    ends AS (SELECT a._src_row, a.employee_id, a.t, a.expense_date AS d FROM s a JOIN s b ON a.employee_id = b.employee_id AND a.t IS NOT DISTINCT FROM b.t AND b.expense_date BETWEEN a.expense_date - 365 AND a.expense_date GROUP BY ALL HAVING COUNT(*) >= 3)
    SELECT MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM s WHERE EXISTS (SELECT 1 FROM ends x WHERE x.employee_id = s.employee_id AND x.t IS NOT DISTINCT FROM s.t AND s.expense_date BETWEEN x.d - 365 AND x.d) GROUP BY employee_id, t""")
expense_rule("vendor-concentration", f""", c AS (SELECT employee_id, {_vendor} AS v, COUNT(*) AS k, MIN(_src_row) AS first_row, MAX(amount) AS max_amount FROM e GROUP BY 1, 2),
    t AS (SELECT *, SUM(k) OVER (PARTITION BY employee_id) AS n, ROW_NUMBER() OVER (PARTITION BY employee_id ORDER BY k DESC, first_row) AS rn FROM c)
    SELECT first_row, k AS n_rows, max_amount FROM t WHERE rn = 1 AND n >= 2 AND k >= 2 AND k >= n * 0.1""")
expense_rule("shared-voucher-multiple-employees", grouped("pnr", "COUNT(*) >= 2 AND COUNT(DISTINCT employee_id) > 1"))
expense_rule("voucher-incomplete", together("invoice_number IS NULL"))
expense_rule("ticket-number-reused", grouped("ticket_number"))
expense_rule("ticket-issue-after-flight", together("issue_date > expense_date"))
expense_rule("itinerary-segment-conflict", grouped("pnr, expense_date", "COUNT(*) >= 2 AND COUNT(DISTINCT origin_city || '>' || dest_city) > 1"))
expense_rule("consecutive-nightly-invoicing", """, d AS (SELECT DISTINCT employee_id, expense_date AS d FROM e WHERE expense_type = 'hotel'),
    r AS (SELECT *, d - CAST(ROW_NUMBER() OVER (PARTITION BY employee_id ORDER BY d) AS INT) AS run FROM d),
    g AS (SELECT employee_id, MIN(d) AS a, MAX(d) AS b FROM r GROUP BY employee_id, run HAVING COUNT(*) >= 2)
    SELECT MIN(_src_row) AS first_row, COUNT(*) AS n_rows, MAX(amount) AS max_amount FROM e JOIN g USING (employee_id) WHERE expense_type = 'hotel' AND expense_date BETWEEN a AND b GROUP BY employee_id, a""")
expense_rule("same-amount-no-invoice", grouped(f"employee_id, {_vendor}, CAST(amount AS DECIMAL(18,2))", "COUNT(*) >= 2 AND BOOL_AND(invoice_number IS NULL)", "expense_type = 'hotel'"))
expense_rule("lodging-night-mismatch", each("expense_type = 'hotel' AND check_out - check_in > 0 AND nights <> check_out - check_in"))
_said = "CASE _src_row % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 7 WHEN 7 THEN 7 END"
expense_rule("weekday-mismatch", each(f"{_said} <> isodow(expense_date)"))
expense_rule("row-limit-exceeded", each("row_limit > 0 AND amount > row_limit"))
expense_rule("checkout-before-transport", """SELECT LEAST(m._src_row, h._src_row) AS first_row, CASE WHEN m._src_row = h._src_row THEN 1 ELSE 2 END::BIGINT AS n_rows, GREATEST(m.amount, h.amount) AS max_amount FROM e m JOIN e h ON h.employee_id = m.employee_id AND h.dest_city = m.origin_city AND m.depart_at < h.check_out_at WHERE m.expense_type = 'flight'""", all_pairs=True)
expense_rule("segment-overlap", """SELECT LEAST(a._src_row, b._src_row) AS first_row, CAST(2 AS BIGINT) AS n_rows, GREATEST(a.amount, b.amount) AS max_amount FROM e a JOIN e b ON a.employee_id = b.employee_id AND a._src_row < b._src_row AND a.depart_at < b.arrive_at AND b.depart_at < a.arrive_at
    WHERE a.expense_type = 'flight' AND b.expense_type = 'flight'""")


@query(
    "near_duplicate_pairs",
    f"""WITH {LEDGER_SQL} SELECT a._src_row AS row_a, b._src_row AS row_b FROM e a JOIN e b ON a.employee_id = b.employee_id AND a.vendor_name = b.vendor_name
    AND b.expense_date - a.expense_date BETWEEN 0 AND 30 AND (b.expense_date > a.expense_date OR a._src_row < b._src_row)
    WHERE ABS(a.amount - b.amount) / GREATEST(ABS(a.amount), ABS(b.amount), 0.01) <= 0.15 AND NOT (a.amount = b.amount AND (a.expense_date = b.expense_date OR coalesce(a.invoice_number = b.invoice_number, FALSE)))""",
)
def near_duplicate_pairs(spark, sf_dir):
    return expense.near_duplicate_pairs(ledger(spark, sf_dir), POLICY)


@query(
    "near_duplicate_days",
    """SELECT a.o_orderkey AS row_a, b.o_orderkey AS row_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
    AND CAST(b.o_orderdate AS DATE) - CAST(a.o_orderdate AS DATE) BETWEEN 0 AND 30 AND (b.o_orderdate > a.o_orderdate OR a.o_orderkey < b.o_orderkey)
    WHERE ABS(a.o_totalprice - b.o_totalprice) / GREATEST(a.o_totalprice, b.o_totalprice, 0.01) <= 0.15 AND NOT (a.o_totalprice = b.o_totalprice AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE))""",
)
def near_duplicate_days(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = raw.select(F.col("o_orderkey").alias("_src_row"), F.col("o_custkey").alias("employee_id"), F.lit("CNY").alias("currency"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("expense_date"), F.lit("any").alias("vendor_name"))
    return expense.near_duplicate_pairs(e, POLICY)


@query(
    "dup_person_day",
    """SELECT o_custkey AS employee_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS expense_date, COUNT(*) AS n_rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def dup_person_day(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    counted = raw.groupBy(F.col("o_custkey").alias("employee_id"), F.to_date("o_orderdate").cast("string").alias("expense_date")).agg(F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_amount"))
    return counted.filter("n_rows > 1")


@query(
    "resubmit_after_rejection",
    f"""WITH {LEDGER_SQL} SELECT r._src_row AS rejected_row, a._src_row, a.amount FROM e r JOIN e a USING (employee_id, expense_type, vendor_name)
    WHERE r.status = 'Rejected' AND a.status <> 'Rejected' AND a.amount > r.amount AND a.expense_date - r.expense_date BETWEEN 0 AND 900""",
)
def resubmit_after_rejection(spark, sf_dir):
    kept, rejected = expense.apply_status_filter(ledger(spark, sf_dir), exclude=["rejected"])
    return expense.resubmitted(kept, rejected, {"resubmit_window_days": 900})


@query("status_filter", f"WITH {LEDGER_SQL} SELECT status <> 'Rejected' AS analysed, COUNT(*) AS n_rows FROM e GROUP BY 1")
def status_filter(spark, sf_dir):
    kept, out = expense.apply_status_filter(ledger(spark, sf_dir), exclude=["rejected"])
    return kept.select(F.lit(True).alias("analysed")).unionByName(out.select(F.lit(False).alias("analysed"))).groupBy("analysed").agg(F.count("*").alias("n_rows"))


@query(
    "findings_scored",
    f"""WITH {LEDGER_SQL}, f AS (SELECT 'weekend-signal' AS finding_type, 1 AS base, 'weak' AS s, amount FROM e WHERE isodow(expense_date) >= 6 UNION ALL SELECT 'row-limit-exceeded', 3, 'strong', amount FROM e WHERE row_limit > 0 AND amount > row_limit),
    g AS (SELECT *, CASE WHEN s = 'strong' AND amount >= 460000 THEN GREATEST(base, 4) WHEN s = 'weak' AND amount < 46000 THEN LEAST(base, 2) ELSE base END AS risk_score FROM f)
    SELECT finding_type, risk_score, CASE WHEN risk_score >= 6 THEN 'critical' WHEN risk_score >= 4 THEN 'high' WHEN risk_score >= 2 THEN 'medium' ELSE 'low' END AS risk_priority, COUNT(*) AS n_findings FROM g GROUP BY ALL""",
)
def findings_scored(spark, sf_dir):
    e = ledger(spark, sf_dir)
    rows = None
    for kind in ("weekend-signal", "row-limit-exceeded"):
        r = EXPENSE.rules[kind]
        one = r.rows(e, POLICY).select(F.lit(kind).alias("finding_type"), F.lit(r.score).alias("score"), F.lit(r.strength).alias("strength"), "amount")
        rows = one if rows is None else rows.unionByName(one)
    scored = rows.withColumn("risk_score", adjusted(F.col("score"), F.col("strength"), F.col("amount"), 460000.0))
    return scored.groupBy("finding_type", "risk_score", priority(F.col("risk_score")).alias("risk_priority")).agg(F.count("*").alias("n_findings"))


@query("all_expense_findings")
def all_expense_findings(spark, sf_dir):
    """Every rule at once, with ids, scores and priorities."""
    rows, _ = run_rules(EXPENSE, ledger(spark, sf_dir), POLICY)
    return findings(rows, POLICY)


@query("orphan_evidence", "SELECT CAST(NULL AS BIGINT) AS n WHERE FALSE")
def orphan_evidence(spark, sf_dir):
    e = ledger(spark, sf_dir)
    return orphans(EXPENSE.rules["row-limit-exceeded"].rows(e, POLICY), e).select(F.col("_src_row").alias("n"))


TRIPS = "trips AS (SELECT _src_row, employee_id, expense_date AS start_date, check_out AS end_date FROM e WHERE _src_row % 3 = 0)"


COMPANY = {"travel_cross_check": {"company_cities": ["City 0"]}}


def trips_of(e: DataFrame) -> DataFrame:
    """A trip for every row; two in three have no dates."""
    return e.selectExpr("_src_row", "employee_id", "CASE WHEN _src_row % 3 = 0 THEN expense_date END AS start_date", "CASE WHEN _src_row % 3 = 0 THEN check_out END AS end_date")


@query(
    "expense_without_travel_request",
    f"""WITH {LEDGER_SQL}, {TRIPS} SELECT _src_row, amount FROM e WHERE dest_city <> 'City 0'
    AND NOT EXISTS (SELECT 1 FROM trips t WHERE t.employee_id = e.employee_id AND e.expense_date BETWEEN t.start_date - 1 AND t.end_date + 1)""",
)
def expense_without_travel_request(spark, sf_dir):
    e = ledger(spark, sf_dir)
    return external.without_travel_request(e, trips_of(e), COMPANY).select("_src_row", "amount")


@query(
    "office_swipe_on_offsite_claim",
    f"""WITH {LEDGER_SQL}, ev AS (SELECT DISTINCT employee_id AS u, expense_date AS d FROM e WHERE _src_row % 2 = 0)
    SELECT _src_row, amount FROM e WHERE dest_city <> 'City 0' AND (expense_date, employee_id) IN (SELECT d, u FROM ev)""",
)
def office_swipe_on_offsite_claim(spark, sf_dir):
    e = ledger(spark, sf_dir)
    swipes = e.selectExpr("employee_id", "expense_date AS swipe_date", "_src_row % 2 = 0 AS in_office")
    return external.office_swipe(e, swipes, COMPANY).select("_src_row", "amount")


@query(
    "attendance_city_mismatch",
    f"""WITH {LEDGER_SQL}, s AS (SELECT employee_id, expense_date AS d, 'City ' || (_src_row % 4) AS city FROM e WHERE _src_row % 2 = 1)
    SELECT DISTINCT e._src_row, e.amount FROM e JOIN s ON s.employee_id = e.employee_id AND s.d = e.expense_date WHERE e.dest_city <> 'City 0' AND s.city <> e.dest_city AND s.city <> 'City 0'""",
)
def attendance_city_mismatch(spark, sf_dir):
    e = ledger(spark, sf_dir)
    swipes = e.selectExpr("_src_row", "employee_id", "expense_date AS swipe_date", "'gate, City ' || CASE WHEN _src_row % 2 = 1 THEN _src_row % 4 ELSE 0 END AS location")
    return external.swipe_city_mismatch(e, swipes, ["City 1", "City 2", "City 3"], COMPANY).select("_src_row", "amount")


@query(
    "days_without_swipe",
    f"""WITH {LEDGER_SQL}, {TRIPS}, d AS (SELECT _src_row, employee_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM trips)
    SELECT _src_row, employee_id, CAST(MIN(day) AS VARCHAR) AS first_missing FROM d WHERE (employee_id, day) NOT IN (SELECT employee_id, expense_date FROM e WHERE _src_row % 2 = 0) GROUP BY ALL""",
)
def days_without_swipe(spark, sf_dir):
    e = ledger(spark, sf_dir)
    swipes = e.selectExpr("employee_id", "CASE WHEN _src_row % 2 = 0 THEN expense_date END AS swipe_date")
    return external.days_without_swipe(trips_of(e), swipes).withColumn("first_missing", F.col("first_missing").cast("string"))


@query(
    "travel_verification_mismatch",
    f"""WITH {LEDGER_SQL} SELECT _src_row, amount, CASE WHEN _src_row % 4 = 1 THEN 'date' ELSE 'passenger' END AS differs FROM e WHERE _src_row % 4 IN (1, 2)""",
)
def travel_verification_mismatch(spark, sf_dir):
    e = ledger(spark, sf_dir).withColumn("flight_no", F.lit("MU 1"))
    checks = e.selectExpr("_src_row", "expense_id", "'mu-1' AS flight_no", "CASE WHEN _src_row % 4 = 1 THEN date_add(expense_date, 1) ELSE expense_date END AS flight_date", "origin_city", "dest_city", "CASE WHEN _src_row % 4 = 2 THEN 'someone' ELSE employee_name END AS passenger")
    return external.travel_verification(e, checks)[0].select("_src_row", "amount", F.concat_ws("+", "differs").alias("differs"))


@query("travel_verification_not_found", f"WITH {LEDGER_SQL} SELECT _src_row, amount FROM e WHERE _src_row % 10 = 3")
def travel_verification_not_found(spark, sf_dir):
    e = ledger(spark, sf_dir).withColumn("flight_no", F.lit("MU 1"))
    found = {"flight_no": "flight_no", "flight_date": "expense_date", "origin_city": "origin_city", "dest_city": "dest_city", "passenger": "employee_name"}
    checks = e.selectExpr("_src_row", "expense_id", *[f"CASE WHEN _src_row % 10 <> 3 THEN {c} END AS {name}" for name, c in found.items()])
    return external.travel_verification(e, checks)[1].select("_src_row", "amount")


@query("invoice_payee_mismatch", f"WITH {LEDGER_SQL} SELECT _src_row, amount FROM e WHERE _src_row % 6 = 5")
def invoice_payee_mismatch(spark, sf_dir):
    e = ledger(spark, sf_dir)
    paid = e.selectExpr("_src_row", "expense_id", "CAST(NULL AS STRING) AS issuer", "CASE WHEN _src_row % 6 = 5 THEN 'Other Ltd' ELSE upper(vendor_name) END AS payee")
    return external.payee_mismatch(e, paid).select("_src_row", "amount")


@query(
    "price_above_reference",
    f"WITH {LEDGER_SQL} SELECT _src_row, amount, CAST(CAST(substr(item, 6) AS INT) * 10000 AS DOUBLE) AS ref_price FROM e WHERE amount > CAST(substr(item, 6) AS INT) * 10000 * 1.3 AND item <> 'item 0'",
)
def price_above_reference(spark, sf_dir):
    refs = spark.range(25).selectExpr("id AS _src_row", "'ITEM ' || id AS item", "CAST(NULL AS STRING) AS unit", "CAST(id * 10000 AS DOUBLE) AS unit_price", "CAST(NULL AS DOUBLE) AS max_price")
    return external.above_market(ledger(spark, sf_dir), refs, {}).select("_src_row", "amount", "ref_price")


@query(
    "shipment_amount_mismatch",
    f"""WITH {LEDGER_SQL}, s AS (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS shipped FROM lineitem GROUP BY 1)
    SELECT _src_row, amount, CAST(shipped AS DOUBLE) AS shipped FROM e JOIN s ON l_orderkey = _src_row WHERE ABS(shipped - CAST(amount AS DECIMAL(18,2))) > 0.01""",
)
def shipment_amount_mismatch(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("expense_id"), F.col("l_extendedprice").alias("amount"))
    return external.shipment_amounts(ledger(spark, sf_dir), lines, {}).select("_src_row", "amount", "shipped")


@query("shipment_without_tracking", f"WITH {LEDGER_SQL} SELECT _src_row, amount FROM e WHERE _src_row IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def shipment_without_tracking(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_orderkey AS STRING) AS expense_id", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'no' END AS tracking_no")
    return external.shipment_without_tracking(ledger(spark, sf_dir), lines).select("_src_row", "amount")


@query("shipment_from_private_address", f"WITH {LEDGER_SQL} SELECT _src_row, amount FROM e WHERE _src_row IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def shipment_from_private_address(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_orderkey AS STRING) AS expense_id", "CASE WHEN l_linenumber = 7 THEN '幸福小区 7' ELSE 'Road 1' END AS to_addr")
    return external.private_address(ledger(spark, sf_dir), lines, {}).select("_src_row", "amount")


@query("side_table_coverage", f"WITH {LEDGER_SQL} SELECT COUNT(*) FILTER (_src_row IN (SELECT l_orderkey FROM lineitem)) AS matched, COUNT(*) FILTER (_src_row NOT IN (SELECT l_orderkey FROM lineitem)) AS unmatched FROM e")
def side_table_coverage(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("expense_id"))
    return external.coverage(ledger(spark, sf_dir), lines)


def vendors(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.selectExpr("s_suppkey AS _src_row", "s_suppkey AS vendor_id", "'ACC-' || (s_suppkey % 30) AS bank_account", "'p' || (s_suppkey % 45) || '@x.com' AS email", "'nation ' || s_nationkey AS address", "DATE '1995-01-01' AS registered_date")


def employees(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.selectExpr("c_custkey AS _src_row", "c_custkey AS employee_id", "'acc ' || (c_custkey % 200) AS bank_account", "'Nation-' || c_nationkey AS address")


@query(
    "shared_vendor_attributes",
    """WITH a AS (SELECT 'bank_account' AS attribute, 'acc' || (s_suppkey % 30) AS key FROM supplier UNION ALL SELECT 'email', 'p' || (s_suppkey % 45) || '@xcom' FROM supplier UNION ALL SELECT 'address', 'nation' || s_nationkey FROM supplier)
    SELECT attribute, key, COUNT(*) AS n_vendors FROM a GROUP BY ALL HAVING COUNT(*) > 1""",
)
def shared_vendor_attributes(spark, sf_dir):
    return procurement.shared_attributes(vendors(spark, sf_dir), {}).groupBy("attribute", "key").agg(F.count("*").alias("n_vendors"))


@query(
    "shared_vendor_edges",
    "SELECT 'bank_account' AS attribute, f AS source, s_suppkey AS target FROM (SELECT s_suppkey, MIN(s_suppkey) OVER (PARTITION BY s_suppkey % 30) AS f FROM supplier) WHERE f < s_suppkey",
)
def shared_vendor_edges(spark, sf_dir):
    return procurement.shared_edges(vendors(spark, sf_dir).select("_src_row", "vendor_id", "bank_account"), {})


@query(
    "employee_vendor_shared",
    """WITH k AS (SELECT 'bank_account' AS attribute, c_custkey % 200 AS x, c_custkey AS e, NULL AS v FROM customer UNION ALL SELECT 'bank_account', s_suppkey % 30, NULL, s_suppkey FROM supplier
        UNION ALL SELECT 'address', c_nationkey, c_custkey, NULL FROM customer UNION ALL SELECT 'address', s_nationkey, NULL, s_suppkey FROM supplier),
    f AS (SELECT *, MIN(e) OVER (PARTITION BY attribute, x) AS fe, MIN(v) OVER (PARTITION BY attribute, x) AS fv FROM k)
    SELECT DISTINCT attribute, coalesce(e, fe) AS employee, coalesce(v, fv) AS vendor FROM f WHERE fe IS NOT NULL AND fv IS NOT NULL""",
)
def employee_vendor_shared(spark, sf_dir):
    return procurement.employee_vendor_shared(vendors(spark, sf_dir), employees(spark, sf_dir), {}).select("attribute", "employee", "vendor")


@query(
    "price_outlier",
    f"""WITH {ORDERS_SQL}, m AS (SELECT item, MEDIAN(unit_price) AS med, MIN(unit_price) AS low FROM po GROUP BY 1 HAVING COUNT(*) >= 5), d AS (SELECT item, med, low, MEDIAN(ABS(unit_price - med)) AS mad FROM po JOIN m USING (item) GROUP BY ALL)
    SELECT item, COUNT(*) AS n_rows, MAX(unit_price) AS max_price FROM po JOIN d USING (item) WHERE (mad <> 0 AND 0.6745 * (unit_price - med) / mad > 3.5) OR (mad = 0 AND low > 0 AND unit_price >= 1.3 * low) GROUP BY 1""",
)
def price_outlier(spark, sf_dir):
    po = orders(spark, sf_dir).withColumn("unit", F.lit(None).cast("string")).withColumn("region", F.lit(None).cast("string"))
    return procurement.price_outliers(po, {}).groupBy("item").agg(F.count("*").alias("n_rows"), F.max("unit_price").alias("max_price"))


@query(
    "process_order",
    f"""WITH {ORDERS_SQL}, x AS (SELECT 'process-receipt-before-order' AS finding_type, order_date - receipt_date AS days FROM po WHERE receipt_date < order_date
    UNION ALL SELECT 'process-receipt-before-approval', approval_date - receipt_date FROM po WHERE receipt_date < approval_date UNION ALL SELECT 'process-order-before-approval', approval_date - order_date FROM po WHERE approval_date - order_date > 1
    UNION ALL SELECT 'process-payment-before-approval', approval_date - paid FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) + CAST(l_partkey % 20 - 60 AS INT) AS paid FROM lineitem) JOIN (SELECT po_id, max_by(approval_date, _src_row) AS approval_date FROM po GROUP BY 1) ON po_id = l_orderkey WHERE paid < approval_date)
    SELECT finding_type, COUNT(*) AS n_rows, CAST(SUM(days) AS BIGINT) AS total_days FROM x GROUP BY 1""",
)
def process_order(spark, sf_dir):
    po = orders(spark, sf_dir)
    paid = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber AS _src_row", "l_orderkey AS po_id", "date_add(CAST(l_shipdate AS DATE), CAST(l_partkey % 20 - 60 AS INT)) AS payment_date")
    return procurement.process_order(po, paid, {}).groupBy("finding_type").agg(F.count("*").alias("n_rows"), F.sum("days").cast("long").alias("total_days"))


@query("process_stale_approval", f"WITH {ORDERS_SQL} SELECT COUNT(*) AS n_rows, CAST(SUM(approval_date - order_date) AS BIGINT) AS total_days FROM (SELECT order_date, approval_date + 15 AS approval_date FROM po) WHERE approval_date - order_date > 30")
def process_stale_approval(spark, sf_dir):
    po = orders(spark, sf_dir).withColumn("approval_date", F.date_add("approval_date", 15))
    none = spark.createDataFrame([], "_src_row long, po_id long, payment_date date")
    found = procurement.process_order(po, none, {"order_approval_direction": "either"}).filter("finding_type = 'process-order-stale-approval'")
    return found.agg(F.count("*").alias("n_rows"), F.sum("days").cast("long").alias("total_days"))


@query(
    "payment_checks",
    """WITH l AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT l_orderkey, l_extendedprice * 8 AS amount, CAST(l_shipdate AS DATE) AS paid FROM lineitem)
    SELECT 'overpayment' AS finding_type, COUNT(*) AS n_rows FROM p JOIN l ON l_orderkey = o_orderkey WHERE amount > o_totalprice * 1.01 UNION ALL SELECT 'payment-before-order', COUNT(*) FROM p JOIN l ON l_orderkey = o_orderkey WHERE paid < d""",
)
def payment_checks(spark, sf_dir):
    po = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS _src_row", "o_orderkey AS po_id", "o_totalprice AS amount", "CAST(o_orderdate AS DATE) AS order_date")
    paid = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey AS _src_row", "l_orderkey AS po_id", "l_extendedprice * 8 AS amount", "CAST(l_shipdate AS DATE) AS payment_date")
    return procurement.payment_findings(po, paid, {}).groupBy("finding_type").agg(F.count("*").alias("n_rows"))


@query(
    "buyer_vendor_concentration",
    f"""WITH {ORDERS_SQL}, v AS (SELECT buyer, vendor_id, SUM(CAST(amount AS DECIMAL(18,2))) AS t, COUNT(*) AS k FROM po GROUP BY 1, 2), w AS (SELECT *, SUM(t) OVER (PARTITION BY buyer) AS total, SUM(k) OVER (PARTITION BY buyer) AS n FROM v)
    SELECT buyer, vendor_id, k AS n_orders, CAST(t AS DOUBLE) AS vendor_total FROM w WHERE k >= 2 AND t >= total * 0.05""",
)
def buyer_vendor_concentration(spark, sf_dir):
    r = procurement.buyer_vendor_concentration(orders(spark, sf_dir), {"concentration_share": 0.05, "concentration_min_orders": 2})
    return r.select("buyer", "vendor_id", "n_orders", F.col("vendor_total").cast("double").alias("vendor_total"))


@query(
    "split_order",
    f"""WITH {ORDERS_SQL}, s AS (SELECT *, row_number() OVER () AS rid FROM po), w AS (SELECT a.buyer, a.vendor_id, a.category, a.order_date, a._src_row, COUNT(*) AS n_rows, SUM(CAST(b.amount AS DECIMAL(18,2))) AS total, MAX(b.amount) AS top FROM s a JOIN s b ON a.buyer = b.buyer AND a.vendor_id = b.vendor_id AND a.category = b.category
        AND (b.order_date > a.order_date OR (b.order_date = a.order_date AND (b._src_row > a._src_row OR (b._src_row = a._src_row AND b.rid >= a.rid)))) AND b.order_date <= a.order_date + 7 GROUP BY a.rid, a.buyer, a.vendor_id, a.category, a.order_date, a._src_row)
    SELECT DISTINCT buyer, vendor_id, category, CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS month FROM w WHERE n_rows >= 2 AND top < 50000 AND total > 50000""",
)
def split_order(spark, sf_dir):
    r = procurement.split_orders(orders(spark, sf_dir), {"approval_thresholds": [{"amount": 50000}]})
    return r.select("buyer", "vendor_id", "category", F.trunc("order_date", "month").cast("string").alias("month"))


@query(
    "new_vendor_large_order",
    f"""WITH {ORDERS_SQL}, f AS (SELECT vendor_id, order_date, amount, ROW_NUMBER() OVER (PARTITION BY vendor_id ORDER BY order_date, _src_row, amount) AS rn FROM po)
    SELECT vendor_id, CAST(order_date AS VARCHAR) AS order_date, amount, CAST(order_date - DATE '1995-01-01' AS INT) AS days FROM f WHERE rn = 1 AND order_date - DATE '1995-01-01' BETWEEN 0 AND 400 AND amount >= 20000""",
)
def new_vendor_large_order(spark, sf_dir):
    return procurement.new_vendor_large_order(vendors(spark, sf_dir), orders(spark, sf_dir), {"new_vendor_days_threshold": 400}).select("vendor_id", F.col("order_date").cast("string").alias("order_date"), "amount", "days")


@query(
    "bid_price_pattern",
    f"""WITH {ORDERS_SQL} SELECT item AS lot_id, COUNT(*) AS n_bids, MIN(unit_price) AS low, MAX(unit_price) AS high FROM po GROUP BY 1 HAVING COUNT(*) >= 3 AND (MAX(unit_price) - MIN(unit_price)) / MEDIAN(unit_price) <= 20""",
)
def bid_price_pattern(spark, sf_dir):
    bids = orders(spark, sf_dir).select(F.col("item").alias("lot_id"), F.col("unit_price").alias("price"))
    return procurement.bid_price_pattern(bids, {"bid_price_close_ratio": 20}).select("lot_id", "n_bids", "low", "high")


@query(
    "bid_price_subcluster",
    f"""WITH RECURSIVE {ORDERS_SQL}, b AS (SELECT item AS lot_id, unit_price AS price FROM po WHERE unit_price IS NOT NULL AND item IS NOT NULL), d AS (SELECT DISTINCT lot_id, price FROM b),
    s AS (SELECT lot_id, MIN(price) AS first FROM d GROUP BY 1 UNION ALL SELECT s.lot_id, n.next FROM s, LATERAL (SELECT MIN(d.price) AS next FROM d WHERE d.lot_id = s.lot_id AND d.price > s.first AND (d.price - s.first) / GREATEST(s.first, 0.01) > 3 * 0.02) n WHERE n.next IS NOT NULL),
    c AS (SELECT b.lot_id, MAX(s.first) AS first, b.price, COUNT(*) AS k FROM (SELECT *, ROW_NUMBER() OVER () AS i FROM b) b JOIN s ON s.lot_id = b.lot_id AND s.first <= b.price GROUP BY b.lot_id, b.price, b.i)
    SELECT lot_id, first, COUNT(*) AS n_bids, MAX(price) AS high, MEDIAN(price) AS median FROM c GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND (MAX(price) - first) / MEDIAN(price) <= 2 * 0.02""",
)
def bid_price_subcluster(spark, sf_dir):
    bids = orders(spark, sf_dir).select(F.col("item").alias("lot_id"), F.col("unit_price").alias("price"))
    return procurement.bid_price_clusters(bids, {"bid_price_close_ratio": 0.02})


@query("bid_text_similarity")
def bid_text_similarity(spark, sf_dir):
    """The turns of conversations as bids, their roles as lots."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    bids = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("bid_id"), F.concat_ws("/", "role", (F.col("conv_id") % 100).cast("string")).alias("lot_id"), "text")
    return procurement.bid_similarity(bids, {"bid_similarity_threshold": 0.5, "bid_ngram_max": 3})


@query("purchase_graph", f"WITH {ORDERS_SQL} SELECT source, target, COUNT(*) AS n_edges FROM (SELECT 'buyer:' || buyer AS source, 'vendor:' || vendor_id AS target FROM po) GROUP BY ALL")
def purchase_graph(spark, sf_dir):
    return procurement.purchase_graph(orders(spark, sf_dir))[1].groupBy("source", "target").agg(F.count("*").alias("n_edges"))


def case_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, e = spark.read.parquet(f"{sf_dir}/conversations.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    messages = c.selectExpr("conv_id * 1000 + turn AS message_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(conv_id * 10 + turn AS INT), 0) AS at", "role || ' ' || (conv_id % 9) AS sender", "'desk' AS recipient", "text AS content")
    logs = e.selectExpr("event_id", "ts AS at", "'user ' || user_id AS actor", "event_type", "props AS object", "'dev ' || (user_id % 5) AS device")
    return messages, logs


MESSAGES_SQL = "m AS (SELECT conv_id * 1000 + turn AS message_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS \"at\", role || ' ' || (conv_id % 9) AS sender, 'desk' AS recipient, text AS content FROM conversations)"
LOGS_SQL = "l AS (SELECT event_id, ts AS \"at\", 'user ' || user_id AS actor, event_type, props AS object, 'dev ' || (user_id % 5) AS device FROM events)"


@query(
    "timeline",
    f"""WITH {MESSAGES_SQL}, {LOGS_SQL} SELECT "at", 'message' AS kind, CAST(message_id AS STRING) AS source_id, sender AS actor, substr(content, 1, 120) AS object FROM m
    UNION ALL SELECT "at", event_type, CAST(event_id AS STRING), actor, substr(object, 1, 120) FROM l""",
)
def timeline(spark, sf_dir):
    return casework.timeline(*case_tables(spark, sf_dir))


@query(
    "case_relations",
    f"""WITH {MESSAGES_SQL}, {LOGS_SQL} SELECT sender AS source, recipient AS target, 'messaged' AS type FROM m UNION SELECT actor, device, 'used_device' FROM l UNION SELECT actor, object, 'acted_on' FROM l WHERE object IS NOT NULL""",
)
def case_relations(spark, sf_dir):
    return casework.entities_and_relations(*case_tables(spark, sf_dir))[1]


@query("document_emails", r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS n_emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def document_emails(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(fn.emails(F.col("text"))).cast("long").alias("n_emails"))
    return docs.filter("n_emails > 0")


@query("injection_hint", "SELECT page_id, '<!--' AS snippet FROM pages WHERE contains(html, '<!--')")
def injection_hint(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fn.injection_hint(F.col("html")).alias("snippet"))
    return pages.filter("snippet IS NOT NULL")


ISSUES = [{"id": "mail", "keywords": ["email", "@"], "contradiction_keywords": ["the"], "priority": "high"}, {"id": "licence", "keywords": ["license"], "priority": "low"}]


@query(
    "issue_matrix",
    """SELECT 'mail' AS issue, 'supports' AS side, COUNT(*) AS n_refs FROM documents WHERE contains(lower(text), 'email') OR contains(text, '@')
    UNION ALL SELECT 'mail', 'contradicts', COUNT(*) FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT 'licence', 'supports', COUNT(*) FROM documents WHERE contains(lower(text), 'license')""",
)
def issue_matrix(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("evidence_id"), "text")
    return casework.issue_matrix(corpus, ISSUES).groupBy("issue", "side").agg(F.count("*").alias("n_refs"))


@query("investigation_leads")
def investigation_leads(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("evidence_id"), "text")
    return casework.leads(casework.issue_matrix(corpus, ISSUES), ISSUES)


def company_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers tied to suppliers of their nation by number: a sparse graph with paths of every length. Nodes
    and pairs grow with the customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = max(1, c.count() // 25)
    edges = c.selectExpr("c_custkey AS _src_row", f"'c' || (c_custkey % {5 * k}) AS `from`", f"'s' || (c_custkey * 7 % {3 * k}) AS `to`", "CASE WHEN c_custkey % 3 = 0 THEN 'shareholder' WHEN c_custkey % 3 = 1 THEN '历史董事' ELSE 'SAME_PHONE' END AS relation_type")
    pairs = spark.range(k).selectExpr("'c' || (id * 3) AS source", f"'c' || (id * 3 + {k}) AS target")
    return edges, pairs


#: The same graph and search in SQL, step by step: of the paths that reach a node first, the first by its nodes goes on.
GRAPH_SQL = """
    WITH size AS (SELECT greatest(1, count(*) // 25) AS k FROM customer),
    e AS (SELECT c_custkey AS r, 'c' || (c_custkey % (5 * k)) AS a, 's' || (c_custkey * 7 % (3 * k)) AS b,
        CASE WHEN c_custkey % 3 = 0 THEN 'SHAREHOLDER' ELSE 'HISTORICAL_DIRECTOR' END AS t FROM customer, size WHERE c_custkey % 3 < 2),
    adj AS (SELECT u, v, arg_max(t, r) AS t, CASE WHEN arg_max(t, r) = 'SHAREHOLDER' THEN 90.0 ELSE 35.0 END AS w
        FROM (SELECT a AS u, b AS v, r, t FROM e UNION ALL SELECT b, a, r, t FROM e) GROUP BY u, v),
    pairs AS (SELECT 'c' || (i * 3) AS source, 'c' || (i * 3 + k) AS target FROM size, range(0, (SELECT k FROM size)) AS x(i)),
    s1 AS (SELECT source, target, v AS node, [source, v] AS nodes, [t] AS types, w AS weight FROM pairs JOIN adj ON u = source WHERE v <> source),
    k1 AS (SELECT source, target, node, min({'n': nodes, 't': types, 'w': weight}) AS p FROM s1 WHERE node <> target GROUP BY ALL),
    s2 AS (SELECT source, target, v AS node, p.n || [v] AS nodes, p.t || [t] AS types, p.w + w AS weight FROM k1 JOIN adj ON u = node WHERE NOT list_contains(p.n, v)),
    k2 AS (SELECT source, target, node, min({'n': nodes, 't': types, 'w': weight}) AS p FROM s2
        ANTI JOIN k1 USING (source, target, node) WHERE node <> target GROUP BY ALL),
    s3 AS (SELECT source, target, v AS node, p.n || [v] AS nodes, p.t || [t] AS types, p.w + w AS weight FROM k2 JOIN adj ON u = node WHERE NOT list_contains(p.n, v)),
    hits AS (SELECT source, target, nodes, types, CAST(weight AS DOUBLE) AS weight, len(types) AS length, list_contains(types, 'HISTORICAL_DIRECTOR') AS historical
        FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) WHERE node = target),
    best AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY length, weight DESC, historical, nodes) AS rank
        FROM hits QUALIFY rank <= 3),
    told AS (SELECT source, target, count(*) AS n_paths, bool_or(historical) AS historical FROM best GROUP BY ALL)
"""


@query("graph_paths")
def graph_paths(spark, sf_dir):
    edges, pairs = company_graph(spark, sf_dir)
    return relations.paths(edges, pairs)


@query("ranked_paths", GRAPH_SQL + "SELECT source, target, rank, length, weight, historical, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM best")
def ranked_paths(spark, sf_dir):
    """The paths as texts."""
    return graph_paths(spark, sf_dir).withColumn("nodes", F.array_join("nodes", ">")).withColumn("types", F.array_join("types", ">")).select("source", "target", F.col("rank").cast("long").alias("rank"), F.col("length").cast("long").alias("length"), "weight", "historical", "nodes", "types")


@query(
    "relation_decisions",
    GRAPH_SQL + "SELECT source, target, CASE WHEN n_paths > 0 THEN 'RELATED' ELSE 'NOT_RELATED_IN_SCOPE' END AS status, coalesce(n_paths, 0) AS n_paths, coalesce(historical, false) AS historical FROM pairs LEFT JOIN told USING (source, target)",
)
def relation_decisions(spark, sf_dir):
    edges, pairs = company_graph(spark, sf_dir)
    sure = relations.Context(entities_resolved=True, structured_provider_used=True, scope_complete=True, negative_semantics=True)
    return relations.decide(pairs, relations.paths(edges, pairs), sure)


@query(
    "validated_relations",
    GRAPH_SQL + """, claims AS (SELECT source, target, CASE length(source) % 2 WHEN 0 THEN 'NOT_RELATED_IN_SCOPE' ELSE 'RELATED' END AS claimed
        FROM (FROM pairs UNION ALL SELECT source, 'z' || target FROM pairs)),
    seen AS (SELECT source, target, claimed, coalesce(n_paths, 0) AS n_paths, coalesce(historical, false) AS historical FROM claims LEFT JOIN told USING (source, target)),
    said AS (SELECT *, CASE WHEN n_paths > 0 THEN 'RELATED' WHEN claimed = 'NOT_RELATED_IN_SCOPE' THEN claimed ELSE 'NEEDS_VERIFICATION' END AS status FROM seen)
    SELECT source, target, claimed, status, status = 'NEEDS_VERIFICATION' AS downgraded, n_paths, historical FROM said""",
)
def validated_relations(spark, sf_dir):
    """Claims made beforehand, half of them on companies that nothing is tied to, held against the paths."""
    edges, pairs = company_graph(spark, sf_dir)
    pairs = pairs.unionByName(pairs.withColumn("target", F.concat(F.lit("z"), "target")))
    claims = pairs.withColumn("status", F.when(F.length("source") % 2 == 0, "NOT_RELATED_IN_SCOPE").otherwise("RELATED"))
    sure = relations.Context(entities_resolved=True, structured_provider_used=True, scope_complete=True, negative_semantics=True)
    return relations.validated(claims, relations.paths(edges, pairs), sure)


def generated(need: str, mapping: dict[str, str], view: str):
    """The SQL generated for Spark, run there, against the SQL generated for DuckDB."""
    columns = {f: (view, c) for f, c in mapping.items()}

    def run(spark, sf_dir):
        spark.read.parquet(f"{sf_dir}/{view}.parquet").createOrReplaceTempView(view)
        return spark.sql(sqlgen.render(need, columns, "spark")[0])

    query(f"sql_{need.replace('-', '_')}", sqlgen.render(need, columns, "duckdb")[0])(run)


generated("duplicate-claim", {"employee_id": "o_custkey", "expense_date": "o_orderdate", "amount": "o_orderpriority"}, "orders")
generated("duplicate-invoice", {"invoice_number": "l_orderkey", "amount": "l_linenumber"}, "lineitem")
generated("self-approval", {"employee_id": "event_type", "approver": "props"}, "events")
generated("weekend-expense", {"expense_date": "o_orderdate"}, "orders")


from auditspark import catalogue_more  # noqa: E402, F401  registers its queries here
