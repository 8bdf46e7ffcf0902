"""Hand-made inputs for the audit rules, the scalar functions, paths, and the generated SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditspark import functions as fn
from auditspark import sources, streaming
from auditspark.operators import casework, expense, external, procurement, relations, scoring, sqlgen
from auditspark.operators.expense import EXPENSE
from auditspark.plans import entities, evidence, evidence_refs, findings, orphans, run_rules, suppressed

DAY = dt.date(2026, 3, 2)  # a Monday


def ledger(spark, rows, **columns):
    """rows of (row, employee, amount, days after DAY) and further columns by name."""
    data = [(r, f"X{r}", e, float(a), DAY + dt.timedelta(d), "CNY", *[v[i] for v in columns.values()]) for i, (r, e, a, d) in enumerate(rows)]
    kinds = "".join(f", {c} {'date' if c.endswith('_date') else 'string'}" for c in columns)
    return spark.createDataFrame(data, f"_src_row long, expense_id string, employee_id string, amount double, expense_date date, currency string{kinds}")


def rows_of(df):
    return sorted(r["_src_row"] for r in df.collect())


def test_duplicates(spark):
    e = ledger(spark, [(1, "A", 10, 0), (2, "A", 10, 0), (3, "A", 10, 1), (4, "B", 10, 0)], invoice_number=["I1", "I2", "I1", "I1"], expense_type=["meal"] * 4)
    assert rows_of(EXPENSE.rules["exact-duplicate-employee-date-amount"].rows(e, {})) == [1, 2]
    assert rows_of(EXPENSE.rules["exact-duplicate-employee-date-amount"].rows(e, {"multi_occurrence_types": ["meal"]})) == []
    assert rows_of(EXPENSE.rules["exact-duplicate-invoice"].rows(e, {})) == [1, 3]
    assert rows_of(EXPENSE.rules["cross-employee-invoice"].rows(e, {})) == [1, 3, 4]


def test_near_duplicates_leave_exact_ones_out(spark):
    e = ledger(spark, [(1, "A", 100, 0), (2, "A", 110, 7), (3, "A", 110, 8), (4, "A", 100, 0), (5, "B", 100, 1)], vendor_name=["V 1", "v1", "v-1", "V1", "V1"])
    got = {(r["row_a"], r["row_b"]) for r in expense.near_duplicate_pairs(e, {}).collect()}
    assert got == {(1, 2), (4, 2), (2, 3)}


def test_split_counts_only_rows_from_the_start_on(spark):
    e = ledger(spark, [(1, "A", 60, 0), (2, "A", 50, 0), (3, "A", 45, 1)], vendor_name=["V"] * 3)
    got = EXPENSE.rules["split-expense"].rows(e, {"approval_thresholds": [{"amount": 100}], "split_window_days": 0})
    assert rows_of(got) == [1, 2]
    wide = EXPENSE.rules["split-expense"].rows(e, {"approval_thresholds": [{"amount": "94"}], "split_window_days": 1})
    assert sorted((r["finding_key"], r["_src_row"]) for r in wide.collect()) == [("0|1", 1), ("0|1", 2), ("0|1", 3), ("0|2", 2), ("0|2", 3)]


def test_runs_and_outliers(spark):
    e = ledger(spark, [(i, "A", a, i) for i, a in enumerate([10, 11, 12, 13, 14, 500])], invoice_number=["N007", "N008", "N009", "N020", "N021", "N040"], vendor_name=["V"] * 6, expense_type=["hotel"] * 6)
    assert rows_of(EXPENSE.rules["sequential-invoice"].rows(e, {})) == [0, 1, 2]
    assert rows_of(EXPENSE.rules["robust-outlier"].rows(e, {})) == [5]
    assert rows_of(EXPENSE.rules["consecutive-nightly-invoicing"].rows(e, {})) == list(range(6))
    assert rows_of(EXPENSE.rules["high-frequency-small-amount"].rows(e, {"high_frequency_window_days": 2, "high_frequency_min_count": 3})) == [0, 1, 2, 3, 4]


def test_self_approval_needs_a_whole_name(spark):
    e = ledger(spark, [(1, "E1", 1, 0), (2, "E1", 1, 0), (3, "E1", 1, 0)], approver=["boss；E1", "E10", None])
    assert rows_of(EXPENSE.rules["self-approval"].rows(e, {})) == [1]


def test_all_rules_with_scores_and_lineage(spark):
    e = ledger(spark, [(2, "A", 9000, 5), (3, "A", 9000, 5)], invoice_number=["I1", "I1"], vendor_name=["V", "V"], expense_type=["meal", "meal"])
    rows, notes = run_rules(EXPENSE, e, {"weekend_check": True})
    rows = rows.cache()
    found = {r["finding_type"]: r for r in findings(rows, {}).collect()}
    assert found["exact-duplicate-invoice"]["risk_priority"] == "high" and found["exact-duplicate-invoice"]["finding_id"] == "EXP-000001"
    assert found["weekend-signal"]["risk_score"] == 1
    assert any("large-amount" in n for n in notes)
    assert orphans(rows, e).count() == 0
    cells = evidence(rows, e).orderBy("evidence_id").collect()
    assert [(r["evidence_id"], r["_src_row"], r["field"], r["value"]) for r in cells[:6]] == [("EV-000001", 2, "expense_id", "X2"), ("EV-000002", 2, "invoice_number", "I1"), ("EV-000003", 2, "amount", "9000.0"), ("EV-000004", 3, "expense_id", "X3"), ("EV-000005", 3, "invoice_number", "I1"), ("EV-000006", 3, "amount", "9000.0")]
    assert [r["evidence_id"] for r in cells] == [f"EV-{i:06d}" for i in range(1, len(cells) + 1)] and len({(r["_src_row"], r["field"]) for r in cells}) == len(cells)
    refs = evidence_refs(rows, evidence(rows, e)).filter("finding_type = 'weekend-signal'").groupBy("finding_key").count().collect()
    assert [(r["finding_key"], r["count"]) for r in sorted(refs)] == [("2", 3), ("3", 3)]
    assert {(r["entity_type"], r["entity"]) for r in entities(rows, e).collect()} == {("employee", "A"), ("vendor", "V")}
    allowed = spark.createDataFrame([("a", None)], "employee_id string, amount_max string")
    kept, dropped = suppressed(rows, e, allowed)
    assert kept.count() == 0 and dropped.count() == rows.count()


def test_empty_ledger_gives_no_finding(spark):
    e = ledger(spark, [(1, "A", 1, 0)], invoice_number=["I"], vendor_name=["V"], expense_type=["t"]).filter("false")
    rows, _ = run_rules(EXPENSE, e, {"weekend_check": True, "lodging_cross_check": True})
    assert rows.count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("(1,200.50)", "2026年3月5日 10:00", "周三", "ＡＢ　c"), ("1e5", "2026-02-30", "3", " =x "), ("¥7", "31/12/2025", "week 3", None), (None, "20260301", "Tuesday", "")], "a string, d string, w string, t string")
    got = df.select(fn.amount(F.col("a")).alias("a"), fn.date_value(F.col("d")).cast("string").alias("d"), fn.weekday_of(F.col("w")).alias("w"), fn.norm_text(F.col("t")).alias("t")).collect()
    assert [r["a"] for r in got] == [-1200.5, 15.0, 7.0, None]
    assert [r["d"] for r in got] == ["2026-03-05", None, "2025-12-31", "2026-03-01"]
    assert [r["w"] for r in got] == [2, None, 2, 1]
    assert [r["t"] for r in got] == ["AB c", "=x", None, None]
    safe = df.select(fn.csv_safe(F.trim("t")).alias("t")).collect()
    assert safe[1]["t"] == "'=x"


def test_normalise_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_text('报销单号,工号,金额,费用日期,商户\n1,E1,"1,000",2026/3/1,"A\nB"\n2,,x,2026-13-01,V\n', encoding="utf-8-sig")
    raw = sources.read_delimited(spark, str(tmp_path / "l.csv"))
    mapping, _ = sources.map_columns([c for c in raw.columns if not c.startswith("_")], required=("expense_id", "employee_id", "amount", "expense_date"))
    clean, bad = sources.normalise(raw, mapping)
    assert [(r["_src_row"], r["amount"], r["vendor_name"], str(r["expense_date"])) for r in clean.collect()] == [(2, 1000.0, "A B", "2026-03-01")]
    assert [(r["_src_row"], r["reasons"]) for r in bad.collect()] == [(3, "employee_id is empty；amount cannot be read；expense_date cannot be read")]
    with pytest.raises(ValueError):
        sources.map_columns(["x"], required=("amount",))


def test_parity_of_rules(spark):
    """A limit each, three near duplicates, later starts of a run, any stay before a journey."""
    e = ledger(spark, [(1, "A", 500, 0), (2, "A", 90, 1), (3, "A", 95, 2)], expense_type=["hotel", "meal", "meal"], vendor_name=["V", "W", "W"])
    limits = {"limits": [{"expense_type": "hotel", "max_amount": 400}, {"max_amount": "450"}, {"currency": "usd", "max_amount": 1}]}
    assert sorted((r["finding_key"], r["_src_row"]) for r in EXPENSE.rules["policy-threshold"].rows(e, limits).collect()) == [("1|0", 1), ("1|1", 1)]
    assert rows_of(EXPENSE.rules["near-duplicate"].rows(e, {})) == []
    more = ledger(spark, [(2, "A", 90, 1), (3, "A", 95, 2), (4, "A", 99, 3)], expense_type=["meal", "meal", "toll"], vendor_name=["W"] * 3)
    assert rows_of(EXPENSE.rules["near-duplicate"].rows(more, {})) == [2, 3, 4]
    assert rows_of(EXPENSE.rules["near-duplicate"].rows(more, {"fixed_amount_types": ["meal"]})) == [2, 3, 4]
    assert rows_of(EXPENSE.rules["near-duplicate"].rows(more, {"multi_occurrence_types": ["meal", "toll"]})) == []
    run = ledger(spark, [(i, "A", 1, d) for i, d in enumerate([0, 50, 51, 52, 90])], invoice_number=["N10", "N11", "N12", "N13", "N13"], vendor_name=["V"] * 5)
    assert rows_of(EXPENSE.rules["sequential-invoice"].rows(run, {})) == [1, 2, 3]
    at = [dt.datetime(2026, 3, 2, 12), None, None]
    gone = [None, dt.datetime(2026, 3, 1, 9), dt.datetime(2026, 3, 3, 9)]
    rows = [(i, f"X{i}", "A", 10.0, DAY, "CNY", ["meal", "大巴", "bus"][i], at[i], gone[i], ["P", "P", "P"][i], "P") for i in range(3)]
    seg = spark.createDataFrame(rows, "_src_row long, expense_id string, employee_id string, amount double, expense_date date, currency string, expense_type string, check_out_at timestamp, depart_at timestamp, origin_city string, dest_city string")
    assert sorted((r["finding_key"], r["_src_row"]) for r in EXPENSE.rules["checkout-before-transport"].rows(seg, {}).collect()) == [("0-1", 0), ("0-1", 1)]
    names = spark.createDataFrame([("week Mon", 0), ("天", 6), ("3", None), ("周3", 2), ("week 8", None), ("Thursday", 3)], "w string, want int")
    assert names.filter(~fn.weekday_of(F.col("w")).eqNullSafe(F.col("want"))).count() == 0
    assert expense.approval_coverage(e.withColumn("approver", F.lit("张三"))).first()["hint"]
    assert not expense.approval_coverage(e.withColumn("approver", F.lit("E1"))).first()["hint"]


def test_windows_and_medians_against_plain_python(spark, monkeypatch):
    import itertools
    import random
    import statistics

    rng = random.Random(2)
    rows = [(i, rng.choice("AB"), rng.choice([20, 40, 60, 99, 120]), rng.randint(0, 40)) for i in range(60)]
    vendors = [rng.choice(["V", "W", None]) for _ in rows]
    e = ledger(spark, rows, vendor_name=vendors, expense_type=["t"] * 60)
    want = set()
    for who in "AB":
        mine = sorted(((d, r, a, v) for (r, w, a, d), v in zip(rows, vendors, strict=True) if w == who))
        for i, (d, r, _, _) in enumerate(mine):
            window = [x for x in mine[i:] if x[0] - d <= 2]
            if len(window) >= 2 and all(x[2] < 100 for x in window) and sum(x[2] for x in window) > 100 and len({x[3] for x in window} - {None}) >= 2:
                want |= {(f"0|{r}", x[1]) for x in window}
    policy = {"approval_thresholds": [{"amount": 100}], "split_window_days": 2}
    assert {(r["finding_key"], r["_src_row"]) for r in expense.split_cross_merchant(e, policy).collect()} == want and want
    values = [round(rng.uniform(-5, 5), 1) for _ in range(101)] + [0.0] * 30 + [1e9, -1e-9]
    for k in (len(values), len(values) - 1, 1, 2):
        hist = spark.createDataFrame([("g", None, v) for v in values[:k]] + [("h", "x", 3.0)], "a string, b string, v double").groupBy("a", "b", "v").agg(F.count("*").alias("_n"))
        got = {r["a"]: r["m"] for r in expense.medians(hist, ["a", "b"], "v", "m").collect()}
        assert got == {"g": pytest.approx(statistics.median(values[:k])), "h": 3.0}
    rows = spark.createDataFrame([(i, rng.choice(["g", "h", None]), round(rng.lognormvariate(3, 1), 1)) for i in range(400)], "i long, k string, v double")
    outliers = lambda: sorted((r["i"], round(r["_z"], 9)) for r in expense.robust_outliers(rows, ["k"], "v", 5, 2.0).collect())
    plain = outliers()
    monkeypatch.setattr(expense, "GROUP", 50)
    assert outliers() == plain and plain and any(r["k"] is None for r in rows.filter(F.col("i").isin([i for i, _ in plain])).collect())
    spans = [(i, "A", *sorted([rng.randint(0, 40), rng.randint(0, 40)], reverse=i % 7 == 0)) for i in range(40)]
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in spans], "_src_row long, k string, s timestamp, e timestamp")
    pairs = {(x[0], y[0]) for x, y in itertools.combinations(spans, 2) if x[2] < y[3] and y[2] < x[3]}
    assert {(r["row_a"], r["row_b"]) for r in expense.overlaps(df, "k", "s", "e", 6 * 3600).collect()} == pairs


def test_allow_lists(spark):
    e = ledger(spark, [(1, "A", 50, 0), (2, "B", 500, 0), (3, "A", 500, 0)], vendor_name=["V 1", "v1", "W"], expense_type=["t"] * 3)
    rows = e.select(F.lit("x").alias("finding_type"), F.col("expense_id").alias("finding_key"), "_src_row", "amount").unionByName(e.filter("_src_row < 3").select(F.lit("y").alias("finding_type"), F.lit("both").alias("finding_key"), "_src_row", "amount"))
    entry = lambda *r: spark.createDataFrame([r], "employee_id string, vendor_name string, amount_max string, reason string")
    gone = lambda allowed: sorted({(r["finding_type"], r["finding_key"]) for r in suppressed(rows, e, allowed)[1].collect()})
    assert gone(entry(None, "V-1", None, "r")) == [("x", "X1"), ("x", "X2"), ("y", "both")]
    assert gone(entry(None, "V-1", "100", "r")) == [("x", "X1")]
    assert gone(entry(None, None, "60", "r").unionByName(entry("a", "w", None, "r"))) == [("x", "X1"), ("x", "X3")]
    assert gone(entry(None, None, None, "r")) == []


def test_side_tables(spark):
    e = ledger(spark, [(1, "A", 100, 0), (2, "A", 100, 5)], expense_type=["travel", "travel"], dest_city=["X", "X"], vendor_name=["V", "W"])
    trips = spark.createDataFrame([(1, "A", DAY, DAY + dt.timedelta(1))], "_src_row long, employee_id string, start_date date, end_date date")
    assert rows_of(external.without_travel_request(e, trips, {})) == [2]
    paid = spark.createDataFrame([(1, "X1", None, "v"), (2, "X1", None, "other"), (3, "X2", "Q", "other")], "_src_row long, expense_id string, issuer string, payee string")
    assert rows_of(external.payee_mismatch(e, paid)) == [2]
    open_end = spark.createDataFrame([(1, "A", DAY + dt.timedelta(4), None)], "_src_row long, employee_id string, start_date date, end_date date")
    assert rows_of(external.without_travel_request(e, open_end, {})) == [1]
    home = {"travel_cross_check": {"company_cities": ["X"]}}
    assert rows_of(external.without_travel_request(e, trips, home)) == [] and rows_of(external.travel_like(e.withColumn("expense_type", F.lit("出差补贴")), home)) == [1, 2]
    sent = spark.createDataFrame([("X1", "Road 1", "3号楼 5"), ("X2", "Road", None)], "expense_id string, from_addr string, to_addr string")
    assert rows_of(external.private_address(e, sent, {})) == [1]
    assert tuple(external.courier_coverage(e.withColumn("expense_type", F.lit("Courier fee")), sent.filter("expense_id = 'X1'"), {}).first()) == (2, 1)
    places = spark.createDataFrame([("外勤", 1.0, 1.0, "hq", False), (None, 31.0, 121.0, None, True), (None, 31.1, 121.0, "hq", False), (None, None, None, "our hq", True), (None, None, None, "else", False), (None, None, None, None, None)], "flag string, lat double, lon double, place string, want boolean")
    verdict = fn.office_verdict(F.col("flag"), F.col("lat"), F.col("lon"), F.col("place"), [(31.0, 121.0), (31.1, 121.0, 0.0001), (31.1, 121.1, 500)], ["hq"])
    assert places.withColumn("got", verdict).filter("flag IS NOT NULL OR lat <> 31.1 OR lat IS NULL").filter("NOT (got <=> want)").count() == 0


def test_bids(spark):
    bids = spark.createDataFrame([(1, "L", "abcdef ghijkl", 100.0), (2, "L", "abcdef ghijkl", 100.5), (3, "L", "zzzz yyyy", 101.0), (4, "L", "qqqqq", 900.0)], "bid_id long, lot_id string, text string, price double")
    got = procurement.bid_similarity(bids, {}).collect()
    assert [(r["bid_a"], r["bid_b"], round(r["similarity"], 6)) for r in got] == [(1, 2, 1.0)]
    assert [tuple(r) for r in procurement.bid_price_clusters(bids, {}).collect()] == [("L", 100.0, 3, 101.0, 100.5)]
    assert sorted(r["price"] for r in procurement.bid_cluster_prices(bids, {}).collect() if r["first"] == 100.0) == [100.0, 100.5, 101.0]
    import math
    import random
    from collections import Counter

    rng = random.Random(6)
    texts = ["".join(rng.choices("abcd ef", k=rng.randint(5, 40))) for _ in range(30)]
    texts += [t[:-3] + "xyz" for t in texts[:8]]
    counts = [Counter(c[i : i + k] for c in ["".join(t.split())] for k in (2, 3) for i in range(len(c) - k + 1)) for t in texts]
    seen = Counter(g for c in counts for g in c)
    vectors = [{g: k / sum(c.values()) * (math.log((1 + len(texts)) / (1 + seen[g])) + 1) for g, k in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    alike = lambda i, j: sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) / length[i] / length[j]
    want = {(i, j): alike(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i % 2 == j % 2 and alike(i, j) >= 0.4}
    frame = spark.createDataFrame([(i, f"L{i % 2}", t) for i, t in enumerate(texts)], "bid_id long, lot_id string, text string")
    near = procurement.bid_similarity(frame, {"bid_ngram_max": 3, "bid_similarity_threshold": 0.4}).collect()
    assert {(r["bid_a"], r["bid_b"]): round(r["similarity"], 9) for r in near} == {k: round(v, 9) for k, v in want.items()} and len(want) > 5


def test_bid_documents(spark, tmp_path):
    (tmp_path / "bids").mkdir()
    (tmp_path / "bids" / "a.txt").write_text("A whole offer, long ENOUGH to read", encoding="utf-8")
    (tmp_path / "bids" / "b.md").write_text("short", encoding="utf-8")
    docs = spark.read.text([f"{tmp_path}/bids/*.txt", f"{tmp_path}/bids/*.md"], wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    bids = spark.createDataFrame([(1, "bids/a.txt"), (2, "./bids/../bids/b.md"), (3, "../x.txt"), (4, "bids/c.txt"), (5, "bids/d.pdf"), (6, None), (7, "bids/b.md")], "bid_id long, document_path string")
    good, bad = procurement.bid_documents(bids, docs, str(tmp_path))
    assert [(r["bid_id"], r["text"]) for r in good.collect()] == [(1, "a whole offer, long enough to read")]
    assert {r["bid_id"]: r["warning"] for r in bad.collect()} == {2: "not found", 3: "leads out of the folder", 4: "not found", 5: "neither .txt nor .md", 7: "too short"}


def test_shared_attributes_grow_with_the_parties(spark):
    v = spark.createDataFrame([(i, f"V{i}", "acc 1") for i in range(50)], "_src_row long, vendor_id string, bank_account string")
    s = spark.createDataFrame([(i, f"E{i}", "ACC-1") for i in range(40)], "_src_row long, employee_id string, bank_account string")
    assert procurement.shared_edges(v, {}).count() == 49 and procurement.shared_edges(v, {"all_pairs": True}).count() == 50 * 49 // 2
    tied = procurement.employee_vendor_shared(v, s, {})
    assert tied.count() == 89 and tied.select("employee").distinct().count() == 40 and tied.select("vendor").distinct().count() == 50
    assert procurement.employee_vendor_shared(v, s, {"whitelists": {"bank_account": ["acc1"]}}).count() == 0


def test_names_are_matched(spark):
    nodes = spark.createDataFrame([("n1", "甲乙有限公司", "91310000MA1FL4AB2C"), ("n2", "丙丁集团", None), ("n3", "丙丁集团北京分公司", None)], "node_id string, name string, canonical_id string")
    names = spark.createDataFrame([("其他 91310000MA1FL4AB2C",), ("丙丁集团（总部）",), ("甲乙",), ("无关",)], "name string")
    got = {r["name"]: r["node_id"] for r in relations.match_nodes(names, nodes).collect()}
    assert got == {"其他 91310000MA1FL4AB2C": "n1", "丙丁集团（总部）": "n2", "甲乙": "n1"}


def test_paths_and_decision(spark):
    edges = spark.createDataFrame([(1, "a", "b", "股东"), (2, "b", "c", "director"), (3, "a", "d", "历史股东"), (4, "d", "c", "UBO"), (5, "a", "c", "same_phone")], "_src_row long, `from` string, `to` string, relation_type string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "z")], "source string, target string")
    found = relations.paths(edges, pairs).orderBy("rank").collect()
    assert [r["nodes"] for r in found] == [["a", "b", "c"], ["a", "d", "c"]]
    sure = relations.Context(True, False, True, True, False, False, True)
    got = {r["target"]: r["status"] for r in relations.decide(pairs, relations.paths(edges, pairs), sure).collect()}
    assert got == {"c": "RELATED", "z": "NOT_RELATED_IN_SCOPE"}
    unsure = {r["status"] for r in relations.decide(pairs, relations.paths(edges, pairs), relations.Context(entities_resolved=True)).collect()}
    assert unsure == {"RELATED", "NEEDS_VERIFICATION"}


def test_scope_gate():
    scope = {"case_id": "c", "objective": "o", "start_date": "2026-01-01", "end_date": "2026-02-01", "sources": ["a"], "persons": ["p"], "issues": [{}], "authorization_confirmed": True, "network_access": False}
    casework.check_scope(scope)
    with pytest.raises(ValueError):
        casework.check_scope(scope | {"network_access": True})


def test_generated_sql():
    out = sqlgen.build([("t", "emp_id"), ("t", "date"), ("t", "amount")], "mysql")
    assert out["mapping"] == {"employee_id": ("t", "emp_id"), "expense_date": ("t", "date"), "amount": ("t", "amount"), "submit_date": ("t", "date")}
    assert "`emp_id`" in out["sql"]["duplicate-claim"] and out["missing"]["self-approval"] == ["approver"]


def test_streaming_windows(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(at + dt.timedelta(hours=i), 1, 5.0) for i in range(12)], "ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    q = streaming.frequent_small_amounts(stream, days=1).writeStream.format("memory").queryName("busy").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.sql("select max(n_rows) from busy").first()[0] == 12


def test_copied_bids_are_tied_to_their_least(spark, monkeypatch):
    rows = [(i, "L", "abcdef ghijkl") for i in range(60)] + [(100 + i, "L", f"ABCDEF ghijk{i}") for i in range(5)] + [(200, "M", "abcdef ghijkl"), (201, None, "abcdef ghijkl"), (202, "L", None), (203, "L", "a")]
    bids = spark.createDataFrame(rows, "bid_id long, lot_id string, text string")
    at = lambda p: {(r["bid_a"], r["bid_b"]): round(r["similarity"], 9) for r in procurement.bid_similarity(bids, p).collect()}
    whole = at({"all_pairs": True, "bid_similarity_threshold": 0.3})
    tied = at({"bid_similarity_threshold": 0.3})
    assert len([1 for a, b in tied if b < 60]) == 59 and all(a == 0 for a, b in tied if b < 60)
    assert len([1 for a, b in whole if b < 60]) == 60 * 59 // 2 and max(a for a, _ in whole) < 200
    assert {k: whole[k] for k in tied} == tied and all(whole[a, b] == tied[0, b] for a, b in whole if a < 60 <= b)
    monkeypatch.setattr(procurement, "BLOCK", 2)
    assert at({"bid_similarity_threshold": 0.3}) == tied and len(tied) == 59 + 5


def test_bid_ngrams_are_not_written(spark, monkeypatch):
    """Only texts and the counts of n-grams are settled; pairs equal plain loops whatever the sizes of blocks, tiles and the table sent."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = ["".join(rng.choices("abé汉\U0001f600 ", k=rng.randint(60, 300))) for _ in range(60)]
    texts += [t[::-1] + "x" * i for i, t in enumerate(texts[:9])] + texts[:4]
    lots = [None if i % 11 == 0 else f"L{i % 2}" for i in range(len(texts))]
    counts = [Counter(c[i : i + k] for c in ["".join(t.split())] for k in range(2, 6) for i in range(len(c) - k + 1)) for t in texts]
    seen = Counter(g for c in counts for g in c)
    vectors = [{g: k / sum(c.values()) * (math.log((1 + len(texts)) / (1 + seen[g])) + 1) for g, k in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    alike = lambda i, j: sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) / length[i] / length[j]
    want = {(i, j): round(s, 9) for i in range(len(texts)) for j in range(i + 1, len(texts)) if lots[i] and lots[i] == lots[j] and (s := alike(i, j)) >= 0.2}
    assert 50 < len(want) < 1700 and any(s < 0.3 for s in want.values())
    rows, settled = [], procurement.settled
    monkeypatch.setattr(procurement, "settled", lambda df: (out := settled(df), rows.append(out.count()))[0])
    bids = spark.createDataFrame([(i, lots[i], t) for i, t in enumerate(texts)], "bid_id long, lot_id string, text string")
    at = lambda: {(r["bid_a"], r["bid_b"]): round(r["similarity"], 9) for r in procurement.bid_similarity(bids, {"bid_similarity_threshold": 0.2, "all_pairs": True}).collect()}
    assert at() == want
    assert sum(rows) < len(seen) + 3 * len(texts) < sum(map(len, counts)) / 2
    for name, value in {"TILE": 7, "LIGHT": 4, "COLUMNS": 10, "COMMON": 200}.items():
        monkeypatch.setattr(procurement, name, value, raising=False)
    assert at() == want
    monkeypatch.setattr(procurement, "BLOCK", 10)
    monkeypatch.setattr(procurement, "COMMON", 0, raising=False)
    assert at() == want


def test_keys_are_what_they_were(spark):
    """Every character is kept or left out as by the class [^0-9a-z一-鿿], with and without @; no class reaches beyond Latin negated."""
    import re

    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(signs[i : i + 500]) for i in range(0, len(signs), 500)] + ["Vendor 7", "--", "", None, "住宿 @ Hotel"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), fn.match_key(F.col("t")).alias("key"), fn.match_key(F.col("t"), "@").alias("mail"))
    for r in frame.collect():
        for got, kept in ((r["key"], ""), (r["mail"], "@")):
            assert got == (r["low"] and re.sub(f"[^0-9a-z一-鿿{kept}]", "", r["low"]) or None)
    assert "[^" not in fn.all_but("@") and fn.all_but("b@") == fn.all_but("@")


def test_few_groups_are_sent_to_the_rows(spark, monkeypatch):
    e = ledger(spark, [(i, f"E{i % 40}", i % 7, i % 3) for i in range(400)], invoice_number=[None if i % 11 == 0 else f"I{i // 3}" for i in range(400)], dest_city=[None if i % 5 == 0 else f"C{i % 9}" for i in range(400)])
    plan = lambda kind: EXPENSE.rules[kind].rows(e, {})._jdf.queryExecution().executedPlan().toString()
    kinds = ("exact-duplicate-invoice", "space-time-conflict", "cross-employee-invoice")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all("BroadcastHashJoin" in plan(k) and "SortAggregate" not in plan(k) for k in kinds)
        few = {k: rows_of(EXPENSE.rules[k].rows(e, {})) for k in kinds}
        monkeypatch.setattr(expense, "SENT", -1)
        assert all("SortMergeJoin" in plan(k) for k in kinds) and {k: rows_of(EXPENSE.rules[k].rows(e, {})) for k in kinds} == few
        assert "SortAggregate" not in e.groupBy("employee_id").agg(expense.differ("dest_city"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shared = {}
    for r in e.filter("invoice_number IS NOT NULL").collect():
        shared.setdefault(r["invoice_number"], []).append(r)
    assert few["cross-employee-invoice"] == sorted(r["_src_row"] for g in shared.values() if len({r["employee_id"] for r in g}) > 1 for r in g) != []


def test_rows_without_neighbours_meet_none(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, f"E{rng.randrange(3)}", rng.choice([100, 105, 110, 300]), rng.randrange(-200, 900)) for i in range(250)]
    e = ledger(spark, rows, vendor_name=[rng.choice(["V 1", "v1", "w"]) for _ in rows])
    same = lambda a, b: a["employee_id"] == b["employee_id"] and a["vendor_name"].lower().replace(" ", "") == b["vendor_name"].lower().replace(" ", "")
    data = e.collect()
    gap = lambda a, b: (b["expense_date"] - a["expense_date"]).days
    want = sorted((a["_src_row"], b["_src_row"]) for a in data for b in data if same(a, b) and (0 < gap(a, b) <= 7 or (gap(a, b) == 0 and a["_src_row"] < b["_src_row"])) and abs(a["amount"] - b["amount"]) <= 0.15 * max(a["amount"], b["amount"]) and not (a["amount"] == b["amount"] and gap(a, b) == 0))
    met = []
    monkeypatch.setattr(expense, "settled", lambda df, settled=expense.settled: (out := settled(df), met.append(out.count()))[0])
    for spans in (1, 8):
        monkeypatch.setattr(expense, "SPANS", spans, raising=False)
        assert sorted(tuple(r) for r in expense.near_duplicate_pairs(e, {}).collect()) == want and len(want) > 20
    alone = [a for a in data if not any(same(a, b) and abs(gap(a, b)) <= 7 and a is not b for b in data)]
    assert met == [250 - len(alone)] * 2 and len(alone) > 20


def test_long_and_short_numbers_run_alike(spark):
    numbers = [7, 8, 9, 9, 10, 1022, 1023, 1024, 1025, 2047, 2048, 2049, 2050, 3000]
    at = lambda far: rows_of(EXPENSE.rules["sequential-invoice"].rows(ledger(spark, [(i, "A", 1, i % 3) for i in range(14)], invoice_number=[f"N{n + far:020d}" for n in numbers], vendor_name=["V"] * 5 + ["W"] * 4 + [None] * 5), {}))
    near = at(0)
    assert near == at(1024 * 10**15) == at(1024 * 10**25) == [0, 1, 3, *range(5, 13)]


def test_evidence_broadcasts_no_ledger(spark):
    e = spark.range(50).selectExpr("id AS _src_row", "CAST(id AS STRING) AS expense_id", "'e' AS employee_id", "CAST(id AS DOUBLE) AS amount")
    rows = e.filter("_src_row % 2 = 0").select(F.lit(0).alias("rule_order"), F.lit("large-amount").alias("finding_type"), F.col("_src_row").cast("string").alias("finding_key"), "_src_row", "amount")
    cells = evidence(rows, e)
    refs = evidence_refs(rows, cells)
    ids = scoring.finding_ids(refs, cells)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_src_row" not in plan and "SortMergeJoin [_src_row" in plan
    assert sorted(int(r[1]) for r in ids.collect()) == list(range(0, 50, 2))
    assert cells.filter("field = 'currency' AND value = ''").count() == 25


def test_ngram_counts_by_id(spark):
    texts = spark.createDataFrame([(1, "ab ab"), (1, "ab ab"), (2, "abc"), (2, "xab"), (None, "ab"), (3, None), (4, "😀é b")], "id long, text string")
    got = {r["gram"]: (r["n"], r["texts"]) for r in procurement.ngram_counts(texts, "id", "text", 2, 3).collect()}
    assert got == {"ab": (7, 2), "ba": (2, 1), "aba": (2, 1), "bab": (2, 1), "bc": (1, 1), "abc": (1, 1), "xa": (1, 1), "xab": (1, 1), "😀é": (1, 1), "éb": (1, 1), "😀éb": (1, 1)}


def test_split_orders_pass_on_only_groups_that_could_split(spark, monkeypatch):
    day = dt.date(2024, 3, 1)
    rows = [(1, "b", 1, "c", 30.0), (2, "b", 1, "c", 30.0), (3, "b", 2, "c", 45.0), (4, "b", 3, "c", 20.0), (5, "b", 3, "c", 20.0), (6, None, 4, None, 49.0), (7, None, 4, None, 49.0), (8, "d", 1, "c", 60.0), (9, "d", 1, "c", -10.0), (10, "d", 1, "c", 20.0)]
    po = spark.createDataFrame([(*r, "CNY", day) for r in rows], "_src_row long, buyer string, vendor_id long, category string, amount double, currency string, order_date date")
    seen, scan = [], procurement.split_windows
    monkeypatch.setattr(procurement, "split_windows", lambda e, *a: (seen.append(sorted(r[0] for r in e.select("_src_row").collect())), scan(e, *a))[1])
    found = procurement.split_orders(po, {"approval_thresholds": [{"amount": 50}]})
    assert [(r["_src_row"], r["n_rows"], r["total"]) for r in found.orderBy("_src_row").collect()] == [(1, 2, 60.0), (6, 2, 98.0)] and seen == [[1, 2, 6, 7]]


def test_robust_outliers_scan_rows_twice(spark):
    e = spark.createDataFrame([(i, "g" if i % 2 else None, float(i % 7 + 1000 * (i == 41))) for i in range(60)], "_src_row long, g string, x double")
    found = expense.robust_outliers(e, ["g"], "x")
    assert [r[0] for r in found.select("_src_row").collect()] == [41]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [_src_row") == 1
