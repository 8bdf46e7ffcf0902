"""Registered queries of scalar functions, normalisation, lineage, scoring and cases, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditspark import functions as fn
from auditspark import sources
from auditspark.catalogue import ISSUES, LEDGER_SQL, ORDERS_SQL, POLICY, case_tables, company_graph, employees, ledger, orders, query, vendors
from auditspark.operators import casework, expense, external, procurement, relations, scoring
from auditspark.operators.expense import EXPENSE
from auditspark.plans import Registry, allow_list, entities, evidence, evidence_refs, findings, members, run_rules, shared_folder, suppressed
from auditspark.sources import cases, reports, shapes, tables


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalar functions -----------------------------------------------------------------------------


@query(
    "scalar_amounts",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN -floor(o_totalprice) WHEN 1 THEN 1000.5 + o_orderkey % 1000 WHEN 2 THEN -1e9 WHEN 3 THEN CAST('1' || (o_orderkey % 9) AS DOUBLE) WHEN 4 THEN o_orderkey % 77 ELSE o_totalprice END AS amount FROM orders""",
)
def scalar_amounts(spark, sf_dir):
    raw = "CASE o_orderkey % 6 WHEN 0 THEN concat('(', CAST(floor(o_totalprice) AS BIGINT), ')') WHEN 1 THEN concat('¥ ', 1 + o_orderkey % 1000 div 1000, ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50') WHEN 2 THEN 'n/a' WHEN 3 THEN concat('1e', o_orderkey % 9) WHEN 4 THEN concat('+', o_orderkey % 77) ELSE CAST(o_totalprice AS STRING) END"
    return read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(fn.amount(F.expr(raw)), F.lit(-1e9)).alias("amount"))


@query("scalar_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def scalar_dates(spark, sf_dir):
    shapes = ("yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd", "yyyyMMdd", "yyyy年M月d日", "d/M/yyyy", "yyyy-M-d'T'HH:mm:ss")
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", s)) for k, s in enumerate(shapes)], F.lit("2026-02-30"))
    return read(spark, sf_dir, "orders").select("o_orderkey", fn.date_value(raw).cast("string").alias("day"))


@query(
    "scalar_times",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN strftime(CASE WHEN event_id % 4 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') END AS clock,
    epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 3 = 0 THEN 8 * 3600 WHEN event_id % 3 = 1 THEN 0 ELSE 3600 END AS instant FROM events""",
)
def scalar_times(spark, sf_dir):
    """Times of day as they are, and as instants: with an offset, as Z, and in an assumed zone that has no summer time."""
    at = lambda f: F.date_format("ts", f)
    clock = F.when(F.col("event_id") % 4 == 0, at("yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, at("yyyy/M/d HH:mm")).when(F.col("event_id") % 4 == 2, at("yyyy-MM-dd'T'HH:mm:ss")).otherwise(at("yyyy-MM-dd"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).when(F.col("event_id") % 3 == 1, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(at("yyyy-MM-dd HH:mm:ss"))
    instant, _ = fn.instant(text, "Africa/Lagos")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(fn.clock_time(clock), "yyyy-MM-dd HH:mm:ss").alias("clock"), F.unix_timestamp(instant.cast("timestamp")).alias("instant"))


@query(
    "scalar_places",
    """WITH p AS (SELECT c_custkey, 30 + (c_custkey % 40) / 10.0 AS lat, 120 + (c_custkey % 30) / 10.0 AS lon FROM customer),
    d AS (SELECT *, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(31 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31)) * pow(sin(radians(121 - lon) / 2), 2))) AS m FROM p)
    SELECT c_custkey, round(m, 2) AS metres, coalesce(CAST(CASE WHEN c_custkey % 7 = 0 THEN true WHEN c_custkey % 7 = 1 THEN false WHEN c_custkey % 7 < 5 THEN m <= 150000 WHEN c_custkey % 7 = 5 THEN c_custkey % 2 = 0 END AS VARCHAR), 'unknown') AS inside FROM d""",
)
def scalar_places(spark, sf_dir):
    p = read(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(30 + (c_custkey % 40) / 10 AS DOUBLE) AS lat", "CAST(120 + (c_custkey % 30) / 10 AS DOUBLE) AS lon", "CASE c_custkey % 7 WHEN 0 THEN 'YES' WHEN 1 THEN '外勤' END AS flag", "CASE WHEN c_custkey % 7 = 5 THEN concat(CASE c_custkey % 2 WHEN 0 THEN 'hq ' ELSE '' END, 'gate') END AS place")
    near = F.when(F.col("c_custkey") % 7 < 5, F.col("lat"))
    verdict = fn.office_verdict(F.col("flag"), near, F.col("lon"), F.col("place"), [(31.0, 121.0, 150_000)], ["hq"])
    return p.select("c_custkey", F.round(fn.haversine_m(F.col("lat"), F.col("lon"), F.lit(31.0), F.lit(121.0)), 2).alias("metres"), F.coalesce(verdict.cast("string"), F.lit("unknown")).alias("inside"))


@query(
    "scalar_texts",
    r"""SELECT event_id, lower(event_type) || ' x' || (event_id % 5) AS squeezed, CASE event_id % 4 WHEN 0 THEN '''=' || event_id WHEN 1 THEN '-' || event_id WHEN 2 THEN '''-a' || event_id ELSE 'a' || event_id END AS safe,
    CASE WHEN event_id % 3 = 0 THEN 'b' || ',' || 'a' ELSE 'b' END AS present, upper(CASE WHEN event_id % 2 = 0 THEN 'usd' ELSE 'cny' END) AS currency FROM events""",
)
def scalar_texts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    squeezed = fn.norm_text(F.concat(F.lit("　 "), F.lower("event_type"), F.lit("\t\n"), F.lit("ｘ"), F.col("event_id") % 5, F.lit(" ")))
    cell = F.concat(F.when(F.col("event_id") % 4 == 0, "=").when(F.col("event_id") % 4 == 1, "-").when(F.col("event_id") % 4 == 2, "-a").otherwise("a"), F.col("event_id").cast("string"))
    several = F.array(F.lit("b"), F.lit(""), F.lit(None).cast("string"), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b"), F.lit("b"))
    return e.select("event_id", squeezed.alias("squeezed"), fn.csv_safe(cell).alias("safe"), F.concat_ws(",", fn.distinct_present(several)).alias("present"), fn.currency(F.when(F.col("event_id") % 2 == 0, " usd ").otherwise("")).alias("currency"))


@query(
    "text_ngrams",
    """WITH t AS (SELECT p_partkey, regexp_replace(p_name, '\\s', '', 'g') AS s FROM part), g AS (SELECT p_partkey, substr(s, i, n) AS gram FROM t, range(2, 6) a(n), range(1, 100) b(i) WHERE i + n - 1 <= length(s))
    SELECT gram, COUNT(*) AS n, COUNT(DISTINCT p_partkey) AS texts FROM g GROUP BY 1""",
)
def text_ngrams(spark, sf_dir):
    return procurement.ngram_counts(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


# --- normalisation and quality --------------------------------------------------------------------

RAW_SQL = "r AS (SELECT o_orderkey AS id, o_orderkey % 37 = 0 AS no_id, o_orderkey % 41 = 0 AS no_staff, o_orderkey % 43 = 0 AS no_day, o_orderkey % 47 = 0 AS no_amount, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders)"


def raw_ledger(spark, sf_dir):
    """The orders as a ledger before normalisation: text with defects."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS _src_row", "CASE WHEN o_orderkey % 37 <> 0 THEN concat('　X', o_orderkey, ' ') END AS `报销单号`", "CASE WHEN o_orderkey % 41 <> 0 AND o_orderkey % 2 = 0 THEN concat('E', o_custkey) END AS `工号`",
        "CASE WHEN o_orderkey % 41 <> 0 THEN concat('Name ', o_custkey) END AS `姓名`", "CASE WHEN o_orderkey % 43 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy/M/d') END AS `费用日期`",
        "CASE WHEN o_orderkey % 47 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END AS `金额`", "CASE WHEN o_orderkey % 47 <> 0 AND o_orderkey % 3 = 0 THEN CAST(o_totalprice AS STRING) END AS part_a", "CASE WHEN o_orderkey % 47 <> 0 THEN '0.25' END AS part_b",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'usd' END AS `币种`", "CAST(o_orderkey % 4 AS STRING) AS `晚数`",
    )


def normalised(spark, sf_dir):
    raw = raw_ledger(spark, sf_dir)
    mapping, _ = sources.map_columns([c for c in raw.columns if not c.startswith("_")])
    return sources.normalise(raw, mapping, amount_columns=("part_a", "part_b"))


@query(
    "normalised_ledger",
    f"""WITH {RAW_SQL} SELECT id AS _src_row, 'X' || id AS expense_id, CASE WHEN id % 2 = 0 THEN 'E' ELSE 'Name ' END || o_custkey AS employee_id, CAST(day AS VARCHAR) AS expense_date, round(r.o_totalprice + CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0 END, 6) AS amount,
    CASE WHEN id % 5 = 0 THEN 'USD' ELSE 'CNY' END AS currency, CASE WHEN id % 4 > 0 THEN floor((r.o_totalprice + CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0 END) / (id % 4)) ELSE -1 END AS unit_price
    FROM r JOIN orders ON id = o_orderkey WHERE NOT (no_id OR no_staff OR no_day OR no_amount)""",
)
def normalised_ledger(spark, sf_dir):
    clean, _ = normalised(spark, sf_dir)
    return clean.select("_src_row", "expense_id", "employee_id", F.col("expense_date").cast("string").alias("expense_date"), "amount", "currency", F.coalesce(F.floor("unit_price").cast("double"), F.lit(-1.0)).alias("unit_price"))


@query(
    "quarantined_ledger",
    f"""WITH {RAW_SQL} SELECT id AS _src_row, array_to_string(list_filter([CASE WHEN no_id THEN 'expense_id is empty' END, CASE WHEN no_staff THEN 'employee_id is empty' END, CASE WHEN no_amount THEN 'amount cannot be read' END, CASE WHEN no_day THEN 'expense_date cannot be read' END], lambda x: x IS NOT NULL), '；') AS reasons
    FROM r WHERE no_id OR no_staff OR no_day OR no_amount""",
)
def quarantined_ledger(spark, sf_dir):
    return normalised(spark, sf_dir)[1].select("_src_row", "reasons")


@query(
    "normalised_orders",
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS _src_row, l_orderkey % 29 = 0 AS no_buyer, l_orderkey % 31 = 0 AS bad_price, l_partkey % 7 = 0 AS odd FROM lineitem)
    SELECT CASE WHEN no_buyer OR bad_price THEN array_to_string(list_filter([CASE WHEN no_buyer THEN 'buyer_id is empty' END, CASE WHEN bad_price THEN 'unit_price cannot be read' END], lambda x: x IS NOT NULL), '；') ELSE 'kept' END AS outcome, COUNT(*) AS n_rows, COUNT(*) FILTER (NOT odd AND NOT no_buyer AND NOT bad_price) AS with_quantity FROM r GROUP BY 1""",
)
def normalised_orders(spark, sf_dir):
    raw = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS _src_row", "concat('PO', l_orderkey) AS `PO号`", "CAST(l_suppkey AS STRING) AS `供应商编号`", "CASE WHEN l_orderkey % 29 <> 0 THEN 'b' END AS `采购员`", "CASE WHEN l_orderkey % 31 = 0 THEN '?' ELSE '¥ 1,200.5' END AS `单价`", "'5' AS `总金额`", "'2026.3.1' AS `下单日期`", "CASE WHEN l_partkey % 7 = 0 THEN 'many' ELSE CAST(l_quantity AS STRING) END AS `数量`")
    mapping, _ = sources.map_columns([c for c in raw.columns if not c.startswith("_")], tables.PURCHASE_ORDERS, None, tables.REQUIRED["purchase_orders"])
    good = F.col("_reasons") == ""
    judged = tables.judged_table(raw, "purchase_orders", mapping)
    outcome = judged.select(F.when(good, "kept").otherwise(F.col("_reasons")).alias("outcome"), (good & F.col("quantity").isNotNull()).alias("q"))
    return outcome.groupBy("outcome").agg(F.count("*").alias("n_rows"), F.count_if(F.col("q")).alias("with_quantity"))


@query("ledger_null_rates", f"WITH {LEDGER_SQL} SELECT 'expense_type' AS \"column\", AVG((expense_type IS NULL)::INT) AS rate FROM e UNION ALL SELECT 'invoice_number', AVG((invoice_number IS NULL)::INT) FROM e UNION ALL SELECT 'unit', 1.0 UNION ALL SELECT 'amount', 0.0")
def ledger_null_rates(spark, sf_dir):
    return sources.null_rates(ledger(spark, sf_dir).select("expense_type", "invoice_number", "unit", "amount"))


@query("amounts_reconciled", "SELECT o_orderkey AS _src_row FROM orders WHERE o_orderkey % 9 = 0")
def amounts_reconciled(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_src_row"), F.col("o_totalprice").cast("string").alias("金额"))
    clean = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_src_row"), F.expr("o_totalprice + CASE WHEN o_orderkey % 9 = 0 THEN 0.02 ELSE 0 END").alias("amount"))
    return sources.reconciled(raw, clean, "金额").select("_src_row")


@query("approval_hint", f"WITH {LEDGER_SQL} SELECT COUNT(*) FILTER (o_orderkey % 10 < 7) / COUNT(*) AS approvers, 0.0 AS employees, COUNT(*) FILTER (o_orderkey % 10 < 7) / COUNT(*) >= 0.6 AS hint FROM orders")
def approval_hint(spark, sf_dir):
    e = ledger(spark, sf_dir).drop("employee_name").withColumn("approver", F.when(F.col("_src_row") % 10 < 7, "王经理").otherwise("boss"))
    return expense.approval_coverage(e)


@query("courier_coverage", f"WITH {LEDGER_SQL} SELECT COUNT(*) AS claims, COUNT(*) FILTER (_src_row NOT IN (SELECT l_orderkey FROM lineitem)) AS unmatched FROM e WHERE _src_row % 3 = 0")
def courier_coverage(spark, sf_dir):
    e = ledger(spark, sf_dir).withColumn("expense_type", F.when(F.col("_src_row") % 3 == 0, "国内快递费").otherwise("meal"))
    sent = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("expense_id"))
    return external.courier_coverage(e, sent, {})


# --- lineage and scoring --------------------------------------------------------------------------


@query(
    "allow_listed_findings",
    f"""WITH {LEDGER_SQL}, a AS (SELECT *, coalesce(lower(vendor_name) = 'vendor 7' OR (expense_type = 'hotel' AND amount <= 200000) OR amount <= 40000, FALSE) AS allowed FROM e),
    f AS (SELECT employee_id, expense_type, BOOL_AND(allowed) AS gone, COUNT(*) AS k FROM a GROUP BY ALL)
    SELECT gone, COUNT(*) AS n_findings, SUM(k)::BIGINT AS n_rows FROM f GROUP BY 1""",
)
def allow_listed_findings(spark, sf_dir):
    e = ledger(spark, sf_dir)
    rows = members(e, "employee_id", "expense_type").withColumn("finding_type", F.lit("t"))
    allowed = spark.createDataFrame([("VENDOR-7", None, None), (None, "Hotel", "200,000"), (None, None, "40000"), (None, None, None)], "vendor_name string, expense_type string, amount_max string")
    assert "reason" in allow_list(allowed).columns
    kept, gone = suppressed(rows, e, allowed)
    one = lambda df, flag: df.groupBy("finding_key").agg(F.count("*").alias("k")).select(F.lit(flag).alias("gone"), "k")
    return one(kept, False).unionByName(one(gone, True)).groupBy("gone").agg(F.count("*").alias("n_findings"), F.sum("k").alias("n_rows"))


@query(
    "evidence_numbers",
    f"""WITH {LEDGER_SQL}, w AS (SELECT _src_row, 0 AS r FROM e WHERE isodow(expense_date) >= 6 UNION ALL SELECT _src_row, 1 FROM e WHERE row_limit > 0 AND amount > row_limit),
    f AS (SELECT w.*, i AS place, ([['expense_id', 'expense_date', 'business_purpose', NULL, NULL, NULL, NULL], ['expense_id', 'employee_id', 'expense_type', 'expense_date', 'amount', 'unit_price', 'row_limit']])[r + 1][i] AS field FROM w, range(1, 8) t(i)),
    u AS (SELECT _src_row, field, MIN(r * 10 + place) AS first_use, MIN(r) AS r FROM f WHERE field IS NOT NULL GROUP BY ALL)
    SELECT _src_row, field, printf('EV-%06d', ROW_NUMBER() OVER (ORDER BY r, _src_row, first_use)) AS evidence_id FROM u""",
)
def evidence_numbers(spark, sf_dir):
    two = Registry({k: EXPENSE.rules[k] for k in ("weekend-signal", "row-limit-exceeded")})
    e = ledger(spark, sf_dir)
    return evidence(run_rules(two, e, POLICY)[0], e).select("_src_row", "field", "evidence_id")


@query(
    "finding_entities",
    f"""WITH {LEDGER_SQL}, x AS (SELECT expense_date, 'employee' AS entity_type, employee_id AS entity FROM e WHERE amount > row_limit UNION SELECT expense_date, 'vendor', vendor_name FROM e WHERE amount > row_limit)
    SELECT CAST(expense_date AS VARCHAR) AS finding_key, entity_type, COUNT(*) AS n FROM x GROUP BY ALL""",
)
def finding_entities(spark, sf_dir):
    e = ledger(spark, sf_dir)
    rows = members(e.filter("amount > row_limit"), "expense_date").withColumn("finding_type", F.lit("t"))
    return entities(rows, e).groupBy("finding_key", "entity_type").agg(F.count("*").alias("n"))


@query("findings_summary", f"WITH {LEDGER_SQL} SELECT 'weekend-signal' AS finding_type, CASE WHEN amount < 46000 THEN 'low' ELSE 'low' END AS risk_priority, COUNT(*) AS n_findings, COUNT(*) AS n_rows FROM e WHERE isodow(expense_date) >= 6 GROUP BY 2 UNION ALL SELECT 'row-limit-exceeded', CASE WHEN amount >= 460000 THEN 'high' ELSE 'medium' END AS p, COUNT(*), COUNT(*) FROM e WHERE row_limit > 0 AND amount > row_limit GROUP BY 2")
def findings_summary(spark, sf_dir):
    two = Registry({k: EXPENSE.rules[k] for k in ("weekend-signal", "row-limit-exceeded")})
    rows, _ = run_rules(two, ledger(spark, sf_dir), POLICY)
    return sources.summary(findings(rows, POLICY))


@query("labelled_findings", f"WITH {LEDGER_SQL} SELECT _src_row, '高' AS priority, '超过适用差标/限额' AS title FROM e WHERE row_limit > 0 AND amount > row_limit AND amount >= 460000 UNION ALL SELECT _src_row, '中', '超过适用差标/限额' FROM e WHERE row_limit > 0 AND amount > row_limit AND amount < 460000")
def labelled_findings(spark, sf_dir):
    e = ledger(spark, sf_dir)
    rows, _ = run_rules(Registry({"row-limit-exceeded": EXPENSE.rules["row-limit-exceeded"]}), e, POLICY)
    found = findings(rows, POLICY)
    return found.select(F.col("first_row").alias("_src_row"), reports.label(F.col("risk_priority"), reports.PRIORITIES).alias("priority"), reports.label(F.col("finding_type"), reports.LABELS).alias("title"))


@query(
    "label_confusion",
    """WITH j AS (SELECT quality = 0 AS e, length(text) < 200 AS a FROM documents JOIN labels USING (doc_id)), c AS (SELECT COUNT(*) FILTER (e AND a) AS tp, COUNT(*) FILTER (NOT e AND a) AS fp, COUNT(*) FILTER (e AND NOT a) AS fn, COUNT(*) FILTER (NOT e AND NOT a) AS tn FROM j)
    SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c""",
)
def label_confusion(spark, sf_dir):
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return scoring.confusion(j.select((F.col("quality") == 0).alias("expected"), (F.length("text") < 200).alias("actual")))


KINDS_SQL = "x AS (SELECT DISTINCT o_custkey AS fixture, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 < 2), a AS (SELECT DISTINCT o_custkey AS fixture, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 > 0), f AS (SELECT DISTINCT c_custkey AS fixture FROM customer), s AS (SELECT fixture, (SELECT COUNT(*) FROM x WHERE x.fixture = f.fixture) AS ne, (SELECT COUNT(*) FROM a WHERE a.fixture = f.fixture) AS na, (SELECT COUNT(*) FROM x JOIN a USING (fixture, kind) WHERE x.fixture = f.fixture) AS tp FROM f), p AS (SELECT *, CASE WHEN na > 0 THEN tp / na WHEN ne > 0 THEN 0.0 ELSE 1.0 END AS p, CASE WHEN ne > 0 THEN tp / ne ELSE 1.0 END AS r FROM s)"


def kinds_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fixture"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 3).alias("k"))
    return scoring.set_scores(o.filter("k < 2").drop("k"), o.filter("k > 0").drop("k"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fixture")))


@query("set_scores", f"WITH {KINDS_SQL} SELECT fixture, ne AS n_expected, na AS n_actual, tp, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM p")
def set_scores(spark, sf_dir):
    return kinds_scores(spark, sf_dir)


@query(
    "score_changes",
    """WITH b AS (SELECT p_partkey % 3 AS skill, p_partkey AS fixture, round(p_size / 50.0, 2) AS f FROM part WHERE p_partkey % 5 > 0), a AS (SELECT p_partkey % 3 AS skill, p_partkey AS fixture, round((p_size + p_partkey % 3 - 1) / 50.0, 2) AS f FROM part WHERE p_partkey % 5 < 4)
    SELECT CASE WHEN b.f IS NULL THEN 'new' WHEN a.f IS NULL THEN 'gone' WHEN a.f - b.f > 0.0001 THEN 'better' WHEN a.f - b.f < -0.0001 THEN 'worse' ELSE 'same' END AS change, COUNT(*) AS n FROM b FULL JOIN a USING (skill, fixture) GROUP BY 1""",
)
def score_changes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    side = lambda where, f: p.filter(where).selectExpr("p_partkey % 3 AS skill", "p_partkey AS fixture", f"round({f} / 50, 2) AS f1")
    return scoring.score_changes(side("p_partkey % 5 > 0", "p_size"), side("p_partkey % 5 < 4", "(p_size + p_partkey % 3 - 1)")).groupBy("change").agg(F.count("*").alias("n"))


@query(
    "scenario_coverage",
    f"""WITH {LEDGER_SQL}, p AS (SELECT department AS scenario, _src_row, row_limit > 0 AND amount > row_limit AS hit FROM e WHERE _src_row % 26 = 0) SELECT scenario, COUNT(*) AS planted, COUNT(*) FILTER (hit) AS found, BOOL_OR(hit) AS covered FROM p GROUP BY 1""",
)
def scenario_coverage(spark, sf_dir):
    """Rows that scenarios plant, against the ids that the findings' evidence names."""
    e = ledger(spark, sf_dir)
    planted = e.filter("_src_row % 26 = 0").select(F.col("department").alias("scenario"), F.lit("row-limit-exceeded").alias("finding_type"), "expense_id")
    rows, _ = run_rules(Registry({"row-limit-exceeded": EXPENSE.rules["row-limit-exceeded"]}), e, POLICY)
    cells = evidence(rows, e)
    return scoring.coverage(planted, scoring.finding_ids(evidence_refs(rows, cells), cells))


# --- procurement and relations --------------------------------------------------------------------


@query(
    "shared_contacts",
    """WITH a AS (SELECT 'phone' AS attribute, '13' || (s_suppkey % 9) AS key FROM supplier UNION ALL SELECT 'legal_representative', '王' || (s_suppkey % 13) FROM supplier) SELECT attribute, key, COUNT(*) AS n_vendors FROM a WHERE key <> '134' GROUP BY ALL HAVING COUNT(*) > 1""",
)
def shared_contacts(spark, sf_dir):
    v = vendors(spark, sf_dir).selectExpr("_src_row", "vendor_id", "concat('1-3 ', vendor_id % 9) AS phone", "concat('王 ', vendor_id % 13) AS legal_representative")
    return procurement.shared_attributes(v, {"whitelists": {"phone": ["(13) 4"]}}).groupBy("attribute", "key").agg(F.count("*").alias("n_vendors"))


@query(
    "employee_vendor_contacts",
    """WITH k AS (SELECT 'phone' AS attribute, c_custkey % 50 AS x, c_custkey AS e, NULL AS v FROM customer UNION ALL SELECT 'phone', s_suppkey % 20, NULL, s_suppkey FROM supplier UNION ALL SELECT 'email', c_custkey % 31, c_custkey, NULL FROM customer UNION ALL SELECT 'email', s_suppkey % 45, NULL, s_suppkey FROM supplier),
    f AS (SELECT *, MIN(e) OVER (PARTITION BY attribute, x) AS fe, MIN(v) OVER (PARTITION BY attribute, x) AS fv FROM k)
    SELECT DISTINCT attribute, coalesce(e, fe) AS employee, coalesce(v, fv) AS vendor FROM f WHERE fe IS NOT NULL AND fv IS NOT NULL""",
)
def employee_vendor_contacts(spark, sf_dir):
    v = vendors(spark, sf_dir).selectExpr("_src_row", "vendor_id", "concat('1-', vendor_id % 20) AS phone", "email")
    s = employees(spark, sf_dir).selectExpr("_src_row", "employee_id", "concat('1 ', employee_id % 50) AS phone", "concat('P', employee_id % 31, '@X.com') AS email")
    return procurement.employee_vendor_shared(v, s, {}).select("attribute", "employee", "vendor")


@query(
    "vendor_handoff",
    """WITH f AS (SELECT o_custkey AS vendor_id, o_orderpriority AS t, o_orderkey % 11 = 0 AS urgent FROM orders) SELECT vendor_id, COUNT(DISTINCT t) AS n_types, COUNT(*) AS n_findings FROM f GROUP BY 1 HAVING COUNT(DISTINCT t) >= 2 AND BOOL_OR(urgent) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
)
def vendor_handoff(spark, sf_dir):
    """The one vendor with the most kinds of findings: a limit is what the operator is for."""
    found = read(spark, sf_dir, "orders").selectExpr("o_custkey AS vendor_id", "o_orderpriority AS finding_type", "CASE WHEN o_orderkey % 11 = 0 THEN 'high' ELSE 'low' END AS risk_priority")
    return procurement.investigation_handoff(found).select("vendor_id", "n_types", "n_findings")


@query(
    "entity_types",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'person' WHEN 2 THEN 'company' ELSE 'unknown' END AS kind, CASE c_custkey % 4 WHEN 0 THEN '甲' || c_custkey || '有限公司' WHEN 1 THEN '王小明' WHEN 2 THEN '91310000MA1FL4AB2C' ELSE 'Unnamed' || c_custkey END AS clean FROM customer""",
)
def entity_types(spark, sf_dir):
    name = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(' 甲 ', c_custkey, ' 有限公司（存续）') WHEN 1 THEN '　王小明' WHEN 2 THEN '91310000MA1FL4AB2C' ELSE concat('Unnamed ', c_custkey, ' [x]') END")
    c = read(spark, sf_dir, "customer").withColumn("name", F.trim(F.replace(name, F.lit("　"), F.lit(" "))))
    return c.select("c_custkey", relations.entity_type(F.col("name")).alias("kind"), relations.company_name(F.col("name")).alias("clean"))


EDGES_SQL = "k AS (SELECT GREATEST(1, COUNT(*) // 25) AS k FROM customer), g AS (SELECT c_custkey, 'c' || (c_custkey % (5 * k)) AS a, 's' || (c_custkey * 7 % (3 * k)) AS b, CASE WHEN c_custkey % 3 = 0 THEN 'SHAREHOLDER' WHEN c_custkey % 3 = 1 THEN 'HISTORICAL_DIRECTOR' END AS type FROM customer, k)"


@query(
    "strong_relations",
    f"""WITH {EDGES_SQL}, d AS (SELECT a AS u, b AS v, c_custkey, type FROM g WHERE type IS NOT NULL UNION ALL SELECT b, a, c_custkey, type FROM g WHERE type IS NOT NULL)
    SELECT u, v, max_by(type, c_custkey) AS type, CASE max_by(type, c_custkey) WHEN 'SHAREHOLDER' THEN 90.0 ELSE 35.0 END AS weight FROM d GROUP BY u, v""",
)
def strong_relations(spark, sf_dir):
    return relations.strong_edges(company_graph(spark, sf_dir)[0])


# --- cases ----------------------------------------------------------------------------------------

SCOPE = {"case_id": "c", "purpose": "p", "authorization_confirmed": True, "network_access": False, "date_range": {"start": "2024-01-01", "end": "2024-01-03"}, "persons_in_scope": ["user 1", "user 2", "user 3"], "allowed_sources": ["a"]}


@query(
    "case_scope",
    """SELECT CASE WHEN event_id % 13 = 0 THEN 'unreadable' WHEN CAST(ts AS DATE) > DATE '2024-01-03' THEN 'outside the dates' WHEN user_id NOT IN (1, 2, 3) THEN 'outside the persons' ELSE 'inside' END AS outcome, COUNT(*) AS n_rows FROM events GROUP BY 1""",
)
def case_scope(spark, sf_dir):
    """Events with times in their own offset, by the scope's days and persons."""
    stamp = F.when(F.col("event_id") % 13 == 0, "lately").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
    rows = read(spark, sf_dir, "events").select(stamp.alias("timestamp"), F.concat(F.lit("user "), F.col("user_id")).alias("actor"))
    inside, outside, bad = cases.in_case(rows, ["actor"], cases.check_case(SCOPE))
    out = inside.select(F.lit("inside").alias("outcome")).unionByName(outside.select(F.col("reason").alias("outcome"))).unionByName(bad.select(F.lit("unreadable").alias("outcome")))
    return out.groupBy("outcome").agg(F.count("*").alias("n_rows"))


@query("case_timeline_span", "SELECT MIN(t) AS first_at, MAX(t) AS last_at, COUNT(*) AS n_events FROM (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS t FROM conversations UNION ALL SELECT ts FROM events)")
def case_timeline_span(spark, sf_dir):
    return reports.timeline_span(casework.timeline(*case_tables(spark, sf_dir)))


@query(
    "issue_hypotheses",
    """WITH d AS (SELECT *, ['HARD', 'SOFT', 'LEAD', 'x'][doc_id % 4 + 1] AS tier FROM documents), h AS (SELECT 'mail' AS issue, doc_id, source, tier, TRUE AS pro FROM d WHERE contains(lower(text), 'email') OR contains(text, '@') UNION ALL SELECT 'mail', doc_id, source, tier, FALSE FROM d WHERE contains(lower(text), 'the') UNION ALL SELECT 'licence', doc_id, source, tier, TRUE FROM d WHERE contains(lower(text), 'license'))
    SELECT issue, COUNT(*) FILTER (pro) AS supports, COUNT(*) FILTER (NOT pro) AS contradicts, CASE MIN(CASE tier WHEN 'HARD' THEN 0 WHEN 'SOFT' THEN 1 WHEN 'LEAD' THEN 2 ELSE 3 END) WHEN 0 THEN 'HARD' WHEN 1 THEN 'SOFT' WHEN 2 THEN 'LEAD' ELSE 'UNSPECIFIED' END AS best_tier, COUNT(DISTINCT source) AS sources FROM h GROUP BY 1""",
)
def issue_hypotheses(spark, sf_dir):
    corpus = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text", F.col("source").alias("source_file"), F.get(F.array(*map(F.lit, ("hard", "SOFT", "LEAD", "x"))), (F.col("doc_id") % 4).cast("int")).alias("tier"))
    return casework.hypotheses(casework.issue_matrix(corpus, ISSUES), ISSUES).select("issue", "supports", "contradicts", "best_tier", "sources")


@query(
    "lead_scores",
    """WITH h AS (SELECT 'mail' AS issue, doc_id FROM documents WHERE contains(lower(text), 'email') OR contains(text, '@') OR contains(lower(text), 'the') UNION SELECT 'licence', doc_id FROM documents WHERE contains(lower(text), 'license'))
    SELECT issue, COUNT(*) AS n_refs, CASE issue WHEN 'mail' THEN 4 ELSE 1 END AS risk_score, CASE issue WHEN 'mail' THEN 'high' ELSE 'low' END AS risk_priority, CASE WHEN COUNT(*) >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength, printf('INV-%06d', ROW_NUMBER() OVER (ORDER BY issue)) AS finding_id FROM h GROUP BY 1""",
)
def lead_scores(spark, sf_dir):
    corpus = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text")
    return casework.leads(casework.issue_matrix(corpus, ISSUES), ISSUES).select("issue", "n_refs", "risk_score", "risk_priority", "evidence_strength", "finding_id")


@query(
    "case_entities",
    """SELECT kind, COUNT(*) AS n FROM (SELECT 'person' AS kind, role || ' ' || (conv_id % 9) AS value FROM conversations UNION SELECT 'person', 'desk' FROM conversations UNION SELECT 'person', 'user ' || user_id FROM events UNION SELECT 'device', 'dev ' || (user_id % 5) FROM events UNION SELECT 'document', props FROM events WHERE props <> ''
    UNION SELECT 'email', unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))) FROM conversations) GROUP BY 1""",
)
def case_entities(spark, sf_dir):
    return casework.entities_and_relations(*case_tables(spark, sf_dir))[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("first_orders", f"WITH {ORDERS_SQL} SELECT buyer, MIN(CAST(order_date AS VARCHAR)) AS first_day FROM po GROUP BY 1")
def first_orders(spark, sf_dir):
    """The first order of each buyer, first in source order on one day."""
    return external.first_per_key(orders(spark, sf_dir), ["buyer"], [F.col("order_date"), F.col("_src_row")]).select("buyer", F.col("order_date").cast("string").alias("first_day"))


@query(
    "stay_conflicts",
    f"""WITH {LEDGER_SQL} SELECT h._src_row AS stay, COUNT(*) AS n_journeys, FIRST(m._src_row ORDER BY m.depart_at DESC, m._src_row) AS journey FROM e m JOIN e h ON h.employee_id = m.employee_id AND h.dest_city = m.origin_city AND m.depart_at < h.check_out_at WHERE m.expense_type = 'flight' GROUP BY 1""",
)
def stay_conflicts(spark, sf_dir):
    return expense.stay_conflicts(ledger(spark, sf_dir))


@query("quoted_csv", "SELECT doc_id, lang, source, md5(regexp_replace(coalesce(text, ''), '\r+\n', '\n', 'g')) AS text_md5 FROM documents")
def quoted_csv(spark, sf_dir):
    """The documents, written as CSV with quoted line breaks and read by ranges."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    docs.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = sources.read_delimited(spark, path)
    return back.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lang", "source", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


@query(
    "click_items",
    """SELECT click_id, CAST(i.value->>'$.sku' AS BIGINT) AS sku, CAST(i.value->>'$.qty' AS BIGINT) AS qty, props->>'$.device.os' AS os FROM clicks, json_each(CASE WHEN json_valid(props) THEN props END, '$.items') i""",
)
def click_items(spark, sf_dir):
    """The items of clicks, whose properties change in shape."""
    good, _ = shapes.parsed(read(spark, sf_dir, "clicks"), "props")
    items = good.select("click_id", shapes.text_at(F.col("value"), "$.device.os").alias("os"), F.explode(shapes.list_at(F.col("value"), "$.items")).alias("i"))
    return items.select("click_id", shapes.text_at(F.col("i"), "$.sku").cast("long").alias("sku"), shapes.text_at(F.col("i"), "$.qty").cast("long").alias("qty"), "os")


@query("broken_properties", "SELECT kind, COUNT(*) AS n FROM clicks WHERE trim(props) <> '' AND NOT json_valid(props) GROUP BY 1")
def broken_properties(spark, sf_dir):
    """How many clicks of each kind have properties that are no JSON."""
    return shapes.parsed(read(spark, sf_dir, "clicks"), "props")[1].groupBy("kind").agg(F.count("*").alias("n"))
