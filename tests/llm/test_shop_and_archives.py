"""Near prices, archives and periodic runs against brute force, and their answers to odd input."""

import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import bands, periodic, warc

# --- near prices ---------------------------------------------------------------------------------

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, rank string, owner string"
ITEMS = "item_id long, price double, p string, value string"


def shop(spark, tmp_path, lines, items):
    for name, rows, schema in (("sale_lines", lines, LINES), ("items", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("sale_lines", "items"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return bands.op11_near_prices(spark, str(tmp_path)), con


def plain(lines, items):
    out = []
    whole = []
    for sale, no, item, q, amount, *_ in lines:
        if None not in (sale, item, q, amount) and q != 0:
            a = int(np.floor(100 * amount + 0.5))
            whole.append(((2 * a + q) // (2 * q), sale, no, item, zlib.crc32(f"{sale},{no},{item}".encode())))
    for item, price, *_ in items:
        p = None if price is None else int(np.floor(100 * price + 0.5))
        pairs = [] if p is None else [(abs(u - p), u, s, n, i, c) for u, s, n, i, c in whole if i != item and (abs(u - p) <= 100 or 1000 * abs(u - p) <= max(u, p))]
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        best = sorted(x[:5] for x in pairs)[:2]
        out += [(item, k + 1, *x, *sums) for k, x in enumerate(best)] or [(item, 0, *[None] * 5, *sums)]
    return out


COLUMNS = ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]


def as_rows(df):
    return sorted(map(repr, df.select(*COLUMNS).toPandas().astype(object).where(lambda x: x.notna(), None).apply(lambda r: tuple(None if v is None else int(v) for v in r), axis=1)))


def test_near_prices(spark, tmp_path):
    rng = random.Random(3)
    price = lambda: rng.choice([rng.uniform(1, 9), rng.uniform(900, 1100), rng.uniform(99_000, 101_000), 5.0, 1000.0, 1e6])
    items = [(i, round(price(), 2), "x", "y") for i in range(60)] + [(60, None, "x", "y"), (61, 7e7, "x", "y"), (5, 5.0, "x", "y"), (5, 5.0, "x", "y"), (62, 0.0, "x", "y"), (63, -3.0, "x", "y")]
    lines = []
    for s in range(500):
        q = rng.choice([1, 2, 3, 7, -2])
        lines.append((s, rng.randrange(3), rng.randrange(70), q, round(price() * q * rng.choice([1, 1.0005, 0.9991]), 2), "r", "o"))
    lines += lines[:40] + [(1, 1, 5, 1, 5.0, "r", "o")] * 30 + [(None, 1, 1, 1, 5.0, "r", "o"), (1, 1, None, 1, 5.0, "r", "o"), (1, 1, 1, None, 5.0, "r", "o"), (1, 1, 1, 1, None, "r", "o"), (1, 1, 1, 0, 5.0, "r", "o")]
    got, con = shop(spark, tmp_path, lines, items)
    want = sorted(map(repr, plain(lines, items)))
    assert as_rows(got) == want
    assert any(eval(r)[7] for r in want) and sorted(map(repr, con.sql(bands.oracle()).fetchall())) == want


def test_near_prices_of_broken_numbers_and_empty_tables(spark, tmp_path):
    items = [(1, float("nan"), "", ""), (2, float("inf"), "", ""), (3, 1e300, "", ""), (4, 1.0, "", "")]
    lines = [(1, 1, 9, 1, float("nan"), "", ""), (1, 2, 9, 1, float("inf"), "", ""), (1, 3, 9, 1, 1e300, "", ""), (1, 4, 9, 1, 1.0, "", "")]
    got, _ = shop(spark, tmp_path / "a", lines, items)
    assert {r["item_id"]: r["n_pairs"] for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    got, _ = shop(spark, tmp_path / "b", [], items)
    assert [r["rank"] for r in got.collect()] == [0] * 4
    got, _ = shop(spark, tmp_path / "c", lines, [])
    assert got.count() == 0


@pytest.mark.parametrize("absolute,relative", [(0, (0, 1)), (0, (1, 10)), (3, (1, 4)), (50, (1, 1000)), (7, (0, 5))])
def test_value_pairs(spark, absolute, relative):
    rng = random.Random(absolute)
    xs, ys = ({rng.choice([rng.randrange(-40, 40), rng.randrange(10**6)]) for _ in range(150)} for _ in range(2))
    ys |= {x * 1000 // 999 + d for x in xs for d in (-1, 0, 1)}
    left, right = spark.createDataFrame([(x,) for x in xs], "a long"), spark.createDataFrame([(y,) for y in ys], "b long")
    got = sorted((r["a"], r["b"], r["gap"]) for r in bands.value_pairs(left, right, "a", "b", absolute, relative).collect())
    num, den = relative
    assert got == sorted((x, y, abs(x - y)) for x in xs for y in ys if abs(x - y) <= absolute or num and den * abs(x - y) <= num * max(x, y))


def test_no_pairs_of_rows(spark, tmp_path, monkeypatch):
    """Rows of one value are a class: a third of all lines at one price makes no more joined rows."""
    made = []
    monkeypatch.setattr(bands, "value_pairs", lambda *a, f=bands.value_pairs: made.append(f(*a)) or made[-1])
    lines = [(s, 1, 7, 1, 5.0, "", "") for s in range(3000)] + [(s, 2, s % 50, 1, 5.0 + s % 90, "", "") for s in range(3000)]
    got, _ = shop(spark, tmp_path, lines, [(i, 5.0 + i % 3, "", "") for i in range(900)])
    assert got.count() == 1800 and got.filter("item_id = 9").first()["n_pairs"] > 3000
    assert all(m.count() <= 3 * 3 for m in made)  # three prices, three near values each at most


# --- archives ------------------------------------------------------------------------------------


def pages_of():
    rng = random.Random(4)
    long = "".join(rng.choices("abcdé <>\r\n", k=300_000))
    big = ["x" * 1000, "é" * 500, "y" * 999, "z" * 5000 + "\r\n\r\nWARC/1.1\r\n", long]
    rows = [(k, f"http://a.b/{k}", big[k % 5], "c", "d") for k in range(40)] + [(100, None, None, "c", "d"), (101, "http://a b\n/", "", "c", "d"), (None, "u", "x" * 1000, "c", "d"), (2**53 + 1, "u", "only\x00one" * 200, "c", "d"), (39, "http://a.b/39", big[4], "c", "d")]
    return rows


PAGES = "page_id long, url string, html string, head string, rid string"


def told(rows):
    top = {}
    for k, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and k is not None:
            top[data] = max(top.get(data, k), k)
    out = []
    for k, _, html, *_ in rows:
        data = (html or "").encode()
        seen = len(data) >= 1000 and data in top and (k is None or k < top[data])
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if seen else "response", top[data] if seen else None))
    return sorted(map(repr, out))


def round_trip(spark, tmp_path, rows, **how):
    archives = warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(2), str(tmp_path / "w"), **how)
    read = warc.records(warc.read_archives(archives, how.get("chunk", warc.CHUNK)))
    page = lambda name: warc.field("head", name).cast("long")
    return archives, read.withColumn("page_id", page("Page-ID")).withColumn("refers_to", page("Refers-To-Page-ID"))


@pytest.mark.parametrize("chunk,archive", [(warc.CHUNK, warc.ARCHIVE), (997, 20_000), (1 << 14, 1)])
def test_archives(spark, tmp_path, chunk, archive):
    rows = pages_of()
    archives, read = round_trip(spark, tmp_path, rows, chunk=chunk, archive=archive)
    got = read.collect()
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == told(rows)
    assert all(r["intact"] for r in got) and max(r["n_chunks"] for r in got) > 1
    files = archives.collect()
    assert sum(f["records"] for f in files) == len(rows) and all((tmp_path / "w" / f["archive"].rpartition("/")[2]).stat().st_size == f["bytes"] for f in files)
    if archive == 1:
        assert len(files) == len(rows)


def test_chunk_table(spark, tmp_path):
    rows = pages_of()
    archives, _ = round_trip(spark, tmp_path, rows)
    table = warc.read_archives(archives, 1000)
    got = {}
    for r in sorted(table.collect(), key=lambda r: (r["archive"], r["record"], r["chunk"])):
        data = got.setdefault((r["archive"], r["record"]), bytearray())
        assert len(r["data"]) <= 1000 and (r["head"] is None) == (r["chunk"] > 0)
        data += r["data"]
        assert r["bytes_so_far"] == len(data) and r["sha1_so_far"] == hashlib.sha1(data).hexdigest()
    kept = {bytes(x) for x in got.values()}
    assert {(r[2] or "").encode() for r in rows} <= kept | {b""}


def test_foreign_and_broken_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    good = info + b"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http\r\ncontent-length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    (tmp_path / "plain.warc").write_bytes(good)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(good[:99]) + gzip.compress(good[99:]))
    (tmp_path / "short.warc.gz").write_bytes(gzip.compress(good)[:-20])
    (tmp_path / "cut.warc").write_bytes(good[:-12])
    (tmp_path / "none.warc").write_bytes(b"")
    names = lambda *n: spark.createDataFrame([(str(tmp_path / x),) for x in n], "archive string")
    got = warc.records(warc.read_archives(names("plain.warc", "packed.warc.gz", "none.warc"))).collect()
    assert sorted((r["record"], r["record_type"], r["payload_bytes"], r["intact"]) for r in got) == [(0, "warcinfo", 3, True)] * 2 + [(1, "response", 5, True)] * 2
    assert {r["payload_digest"] for r in got if r["record"]} == {hashlib.sha1(b"hello").hexdigest()}
    for bad in ("short.warc.gz", "cut.warc"):
        with pytest.raises(Exception, match="EOFError|ends inside"):
            warc.read_archives(names(bad)).collect()


def test_changed_payload_is_not_intact(spark, tmp_path):
    archives, _ = round_trip(spark, tmp_path, [(1, "u", "a" * 50, "", "")])
    path = tmp_path / "w" / archives.first()["archive"].rpartition("/")[2]
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"aaaa", b"aaab")))
    assert [r["intact"] for r in warc.records(warc.read_archives(archives)).collect()] == [False]


def test_readers_hold_a_bounded_part():
    """A payload of a gigabyte in a small file passes through pieces of a chunk."""
    tape = warc.Tape(warc.pieces(__import__("io").BytesIO(gzip.compress(b"\0" * (1 << 27))), 1 << 16))
    most = 0
    for _ in range(1 << 11):
        assert len(tape.take(1 << 16)) == 1 << 16
        most = max(most, len(tape.held))
    assert most <= 1 << 18 and not tape.more()


def test_no_pages(spark, tmp_path):
    archives, read = round_trip(spark, tmp_path, [])
    assert archives.count() == 0 and read.count() == 0


def test_lost_attempts_leave_nothing(spark, tmp_path):
    """Only archives of the stored table are read, whatever else lies in the folder."""
    archives, read = round_trip(spark, tmp_path, pages_of())
    (tmp_path / "w" / "part-000000-99-0000.warc.gz").write_bytes(b"half")
    assert read.count() == len(pages_of())


# --- periodic runs -------------------------------------------------------------------------------


def plain_runs(x, least):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # periods rise, so the smallest is first
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), sha(lines), sha(kept))


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a b " * 6, "x " * 5000, "a\x0bb\x0ca\x1fb " * 30, "é ü " * 20]
    for _ in range(150):
        size = rng.choice([1, 2, 2, 3, 40])
        w = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(120))]
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + w[at : at + 9] * rng.randrange(6) + w[at:]))
    thue = [bin(i).count("1") & 1 for i in range(600)]
    texts += [" ".join("ab"[i] for i in thue), " ".join(["0", "1", "0", "0", "1"] * 60 + ["0"] * 30)]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, "a b " * 9, "c", "c"), (2**53 + 1, "a b " * 9, "c", "c"), (3, "a b c " * 9, "c", "c"), (3, "a b c " * 9, "c", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:8] for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_digest(k, t) for k, t, *_ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_no_documents(spark):
    assert periodic.digests(periodic.find_runs(spark.createDataFrame([], "doc_id string, text string"))).count() == 0


@pytest.mark.parametrize("least", [2, 3, 5, 8, 12])
def test_masked_runs_are_all_runs(least):
    rng = random.Random(least)
    for _ in range(300):
        size = rng.choice([1, 2, 3, 6])
        x = [rng.randrange(size) for _ in range(rng.randrange(70))]
        if x and rng.random() < 0.5:
            at, p = rng.randrange(len(x)), rng.randint(1, len(x))
            part = x[at : at + p]
            x = x[:at] + [part[i % len(part)] for i in range(len(x) - at)]
        want = plain_runs(x, least)
        assert [(s, e - s, q) for s, e, q in periodic.main_lorentz(np.array(x, np.int64), least).tolist()] == want
        ((_, runs, _),) = periodic.runs_of_texts([" ".join(map(str, x))], least)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want


def test_words_outside_repeated_grams_are_masked():
    ids = np.array([*range(1000), *[1, 2, 3] * 5, *range(2000, 3000), *range(100, 120)])
    start, end = periodic.segments(ids, np.zeros(len(ids), np.int64), 12)
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(100, 120), (1000, 1015), (2015, 2035)]
    two = np.repeat([0, 1], [2015, 20])  # the second copy is another document's
    assert [s for s in periodic.segments(ids, two, 12)[0].tolist()] == [1000]


# --- ids beside nulls ----------------------------------------------------------------------------


def test_large_ids_beside_nulls(spark):
    """Every operator on documents gives back ids that no double holds, also where a batch has null ids."""
    import public_tokenizers

    from auditspark.llm import jaccard, lm, mixing, packing, repeats, rules, tokencount

    big, text = 2**53 + 1, " ".join(f"w{i}" for i in range(150))
    docs = spark.createDataFrame([(None, text, "en", "s"), (big, text, "en", "s"), (big + 2, None, "en", None)], "doc_id long, text string, lang string, source string").coalesce(1)
    ways = {
        "tokens": lambda d: tokencount.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
        "pack": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
        "repeats": repeats.remove_repeats,
        "repeats with columns": lambda d: repeats.remove_repeats(d, keep_columns=True),
        "mix": mixing.mixed,
        "join": jaccard.join_documents,
        "rules": rules.apply_rules,
        "lm": lambda d: lm.score_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
        "runs": periodic.find_runs,
    }
    for name, way in ways.items():
        assert {r["doc_id"] for r in way(docs).collect()} == {None, big, big + 2}, name
