"""Two-level scans, sweeps and the index of names against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import expense, relations

DAY = dt.date(2026, 3, 1)


def ledger(spark, rows):
    """rows (row, employee, vendor, currency, amount, days, invoice)"""
    schema = "_src_row long, employee_id string, vendor_name string, currency string, amount double, expense_date date, invoice_number string"
    return spark.createDataFrame([(*r[:5], DAY + dt.timedelta(r[5]), r[6]) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("stretch", [1, 7, 1 << 18])
@pytest.mark.parametrize("distinct", [False, True])
def test_split_windows(spark, monkeypatch, stretch, distinct):
    monkeypatch.setattr(expense, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = [(i, rng.choice("AAAB"), rng.choice(["V", "W", None]), rng.choice(["CNY", None]), rng.choice([20.0, 40.0, 60.0, 99.0, 120.0, -10.0]), rng.choice([rng.randint(0, 30), 5]), None) for i in rng.sample(range(400), 150)]
    keys = ["employee_id", "currency"] if distinct else ["employee_id", "vendor_name", "currency"]
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[3]) if distinct else (r[1], r[2], r[3]), []).append(r)
    want = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[5], r[0]))
        for i, r in enumerate(g):
            held = [x for x in g[i:] if x[5] - r[5] <= 3]
            if len(held) >= 2 and all(x[4] < 100 for x in held) and sum(x[4] for x in held) > 100 and (not distinct or len({x[2] for x in held} - {None}) >= 2):
                want.add((r[0], i + 1, i + len(held), len(held), sum(x[4] for x in held)))
    starts, _ = expense.split_windows(ledger(spark, rows), keys, 100.0, 3, "vendor_name" if distinct else None)
    got = {(r["_src_row"], r["_rn"], r["_end"], r["n_rows"], float(r["total"])) for r in starts.collect()}
    assert got == want and want


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("whole", [0, 20, 256])
def test_split_windows_of_large_and_small_groups(spark, monkeypatch, whole, distinct):
    """Whether all groups are dealt by day, those of over 20 rows, or none: then there is one scan, without cells."""
    monkeypatch.setattr(expense, "WHOLE", whole)
    rng = random.Random(whole)
    rows = [(i, rng.choice(["A"] * 9 + ["B", None]), rng.choice(["V", "W", None]), rng.choice(["CNY", None]), rng.choice([20.0, 40.0, 60.0, 99.0, 120.0, -10.0]), rng.randint(0, 30), None) for i in range(200)]
    keys = ["employee_id", "currency"] if distinct else ["employee_id", "vendor_name", "currency"]
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[3]) if distinct else (r[1], r[2], r[3]), []).append(r)
    want, members = set(), set()
    for g in groups.values():
        g.sort(key=lambda r: (r[5], r[0]))
        for i, r in enumerate(g):
            held = [x for x in g[i:] if x[5] - r[5] <= 3]
            if len(held) >= 2 and all(x[4] < 100 for x in held) and sum(x[4] for x in held) > 100 and (not distinct or len({x[2] for x in held} - {None}) >= 2):
                want.add((r[0], i + 1, i + len(held), len(held), sum(x[4] for x in held)))
                members |= {(r[0], x[0]) for x in held}
    starts, numbered = expense.split_windows(ledger(spark, rows), keys, 100.0, 3, "vendor_name" if distinct else None)
    got = {(r["_src_row"], r["_rn"], r["_end"], r["n_rows"], float(r["total"])) for r in starts.collect()}
    assert got == want and want
    assert {(r["_start"], r["_src_row"]) for r in expense.window_rows(starts, numbered, keys).collect()} == members
    assert ("_cell" in starts._jdf.queryExecution().optimizedPlan().toString()) == (whole < 256)


def test_windows_of_a_hot_group_are_dealt_by_day(spark):
    """No scan over rows is partitioned by the group alone: such windows stand over cells only."""
    e = ledger(spark, [(i, "A", "V", "CNY", 60.0, i % 40, None) for i in range(400)])
    starts, _ = expense.split_windows(e, ["employee_id"], 100.0, 3)
    cells = e.select("expense_date").distinct().count()
    text = starts._jdf.queryExecution().toString()
    whole = [x for x in text.splitlines() if x.strip(" :+-").startswith("Window ") and "specifiedwindowframe" in x.lower() and "_cell" not in x]
    assert starts.count() == 399 and cells == 40 and not [x for x in whole if "_src_row" in x]


@pytest.mark.parametrize("stretch", [2, 4, 1 << 10])
def test_runs_of_numbers(spark, monkeypatch, stretch):
    monkeypatch.setattr(expense, "NUMBERS", stretch)
    rng = random.Random(stretch)
    rows, at = [], 0
    for who in ("V", "W", None):
        no = rng.randint(90, 99)
        for _ in range(70):
            no += rng.choice([1, 1, 1, 1, 0, 2, 5])
            rows.append((at, "A", who, rng.choice(["CNY", "CNY", "CNY", "USD"]) if who == "W" else None, 1.0, rng.choice([0, 1, 2, 3, 3, 4, 9]), f"N{no}"))
            at += 1
    rng.shuffle(rows)
    for window in (1, 3, 8):
        want = []
        for g in {(r[2], r[3]) for r in rows}:
            mine = sorted((int(r[6][1:]), r[5], r[0]) for r in rows if (r[2], r[3]) == g)
            runs = []
            for x in mine:
                if runs and x[0] - runs[-1][-1][0] == 1:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            hits = [run[i:] for run in runs for i in range(len(run)) if len(run) - i >= 3 and max(x[1] for x in run[i:]) - min(x[1] for x in run[i:]) <= window]
            want += [x[2] for x in hits[0]] if hits else []
        got = expense.sequential_invoice(ledger(spark, rows), {"sequential_invoice_window_days": window})
        assert sorted(r["_src_row"] for r in got.collect()) == sorted(want)
    assert want


def test_stays_and_journeys(spark):
    rng = random.Random(1)
    when = lambda: dt.datetime(2026, 3, rng.randint(1, 6), rng.choice([0, 9, 12, 23]))
    rows = [(i, rng.choice(["A", "B", None]), 1.0, rng.choice(["flight", "火车", "hotel"]), rng.choice([when(), None]), rng.choice([when(), None]), rng.choice("PQ"), rng.choice(["P", "Q", None])) for i in range(150)]
    e = spark.createDataFrame(rows, "_src_row long, employee_id string, amount double, expense_type string, check_out_at timestamp, depart_at timestamp, origin_city string, dest_city string").repartition(3)
    pairs = {(h[0], m[0], m[5]) for h in rows for m in rows if h[4] and h[7] and m[5] and m[3] != "hotel" and h[1] and h[1] == m[1] and h[7] == m[6] and m[5] < h[4]}
    assert {(r["stay"], r["journey"]) for r in expense.stay_pairs(e).collect()} == {p[:2] for p in pairs} and pairs
    want = {}
    for h, m, at in pairs:
        n, last = want.get(h, (0, None))
        want[h] = (n + 1, max(filter(None, [last, (at, -m)])))
    assert {r["stay"]: (r["n_journeys"], r["journey"]) for r in expense.stay_conflicts(e).collect()} == {h: (n, -last[1]) for h, (n, last) in want.items()}
    one, every = (expense.checkout_after_departure(e, p).select("finding_key").distinct().count() for p in ({}, {"all_pairs": True}))
    assert one == len(want) and every == len(pairs)


def test_names_in_names(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("甲乙丙丁 ab", k=rng.choice([1, 1, 2, 3, 4, 6])))
    parts, wholes = sorted({name() for _ in range(60)}), sorted({name() + name() for _ in range(80)})
    got = relations.contained(spark.createDataFrame([(p,) for p in parts], "p string"), spark.createDataFrame([(w,) for w in wholes], "w string"), "p", "w")
    assert sorted((r["p"], r["w"]) for r in got.collect()) == sorted((p, w) for p in parts for w in wholes if p in w)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_nodes_of_names(spark):
    rng = random.Random(4)
    name = lambda k: "".join(rng.choices("甲乙丙丁戊", k=k))
    nodes = [(f"n{i:03d}", name(rng.choice([1, 2, 4, 7])), None) for i in range(120)]
    names = sorted({name(rng.choice([1, 2, 3, 5, 9])) for _ in range(90)})
    want = {}
    for x in names:
        same, near = [n for n, y, _ in nodes if y == x], [n for n, y, _ in nodes if y in x or x in y]
        if same or near:
            want[x] = min(same or near)
    got = relations.match_nodes(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(nodes, "node_id string, name string, canonical_id string"))
    assert {r["name"]: r["node_id"] for r in got.collect()} == want and want
