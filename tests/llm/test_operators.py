"""The corpus operators against brute force, and their answers to odd input."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditspark.llm import graph, jaccard, lm, mixing, neighbours, packing, quality, repeats, rules, tokencount, urls

from . import kneser_ney as dense_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid string, rank int, n string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnprst") + rng.choice(["", "ing", "é", "A"]) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k)) + ".\n"
    base, passage = [prose(120) for _ in range(6)], prose(90)
    out = [prose(rng.randint(1, 200)) for _ in range(40)] + base + base[:3]
    for b in base:
        for _ in range(4):
            w = b.split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += [prose(30) + passage + prose(20) for _ in range(4)]
    out += [None, "", "  \n\t", "one", "two words", "a b c", "A B C", "### $$$ *** " * 40, "spam " * 200, "x" * 3000, "漢字 かな 漢字 かな 漢字", "<|endoftext|> tail", "ﬁne text\x85 here", prose(20000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["s0", "s0", "s1", None, "s2"]
    rows = [(i * 3, t, langs[i % 3], sources[i % 5], len(t or ""), "clash", i, "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[44]]  # rows that repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/x?y#z"), (2, "http://a.example.com/en/"), (3, "http://b.net/es/1"), (4, None), (5, "no scheme/login"), (6, "http://x.org/Login?next=1"), (7, "http://com"), (8, "http://xexample.com/en/"), (9, "ftp://a.org#://b.net/es/"), (1, "https://WWW.Example.com/en/x?y#z"), (10, "https://b.net/ES/1"), (11, "https://www.example.com/EN/x"), (12, "https://EXAMPLE.com/en/"), (None, "https://c.NET/fr/?a=/cart")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted((tuple(r) for r in urls.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by_id[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert by_id[3] == ("b.net", "/es/1", "net/es/", "block")
    assert by_id[4] == ("", "", None, "allow") and by_id[5] == ("", "", None, "block")
    assert by_id[6] == ("x.org", "/Login", None, "block") and by_id[7] == ("com", "", None, "allow")
    assert by_id[8] == ("xexample.com", "/en/", "com/", "allow") and by_id[9] == ("a.org", "", None, "allow")
    assert by_id[10] == ("b.net", "/ES/1", None, "allow") and by_id[11] == ("www.example.com", "/EN/x", "com/", "allow")
    assert by_id[12] == ("example.com", "/en/", "example.com/en/", "block") and by_id[None] == ("c.net", "/fr/", "net/fr/", "block")
    assert len(got) == len(rows) and urls.judge_urls(df.filter("false")).count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    cells = lambda table: sorted((tuple(None if x is None or x != x else x for x in r) for r in table), key=str)
    assert cells(con.execute(urls.oracle()).fetchall()) == cells(tuple(r) for r in urls.judge_urls(df).collect())
    renamed = urls.judge_urls(df.withColumnRenamed("page_id", "url_").withColumnRenamed("url", "id").withColumnRenamed("url_", "verdict_"), "verdict_", "id")
    assert renamed.columns[0] == "verdict_" and renamed.count() == len(rows)


def test_url_tokens_come_from_the_pattern():
    assert urls.literal_tokens(r"/login(?:[/?#.]|$)") == ["login"]
    assert urls.literal_tokens(r"casino") == [] and urls.literal_tokens(r"[/.\-_]xxx(?:[/.\-_]|$)") == ["xxx"]
    assert urls.literal_tokens(r"foo?/bar/") == ["bar"] and urls.literal_tokens(r"/a(b|c)/") == [] and urls.literal_tokens(r"/foo[a-z]/") == []
    index = urls.RuleIndex((urls.Rule("block", pattern=r"/tag/[a-z]+/page/"), urls.Rule("block", pattern="casino")), {"tag": 100, "page": 2})
    assert list(index.by_token) == ["page"] and len(index.always) == 1


def test_token_counts(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = tokencount.count_tokens(docs, path)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert got.filter("over_limit <> (n_tokens > 512)").count() == 0 and tokencount.count_tokens(empty, path).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[5:25] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] + [1.0] * 7), (1300, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).toPandas()
    found, exact = 0, 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(600), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=0, atol=1e-12)
        found += np.isin(order, mine.vec_id).sum()
        exact += 10
    assert set(got.query_id) == set(range(0, 600, 100)) and found >= 0.9 * exact
    few = neighbours.search(df.filter("vec_id < 4"), F.col("vec_id") == 0)
    again = neighbours.search(df.unionByName(df.filter("vec_id < 40")).withColumn("part", F.lit(1)).withColumn("vec", F.lit("clash")), F.col("vec_id") % 100 == 0)
    assert again.groupBy("query_id").count().filter("count NOT IN (10, 20)").count() == 0
    assert few.count() == 3 and neighbours.search(df.filter("vec_id >= 1000"), F.lit(True)).count() == 0


def exact_neighbours(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[j]), d[j]) for j in order if np.isfinite(d[j])]


def test_neighbours_of_other_lengths(spark, monkeypatch):
    """Vectors of rare lengths are searched exactly, over several blocks and groups; none is lost."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    rng = np.random.default_rng(3)
    x = {d: rng.normal(size=(n, d)) for d, n in ((8, 90), (5, 40), (69, 30), (2, 1))}
    rows, at = [], {}
    for d, v in x.items():
        at[d] = np.arange(len(rows), len(rows) + len(v))
        rows += [(len(rows) + i, r.tolist()) for i, r in enumerate(v)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).toPandas()
    for d in (5, 69):  # one bucket holds both
        for q in range(len(x[d])):
            if at[d][q] % 5 == 0:
                mine = got[got.query_id == at[d][q]].sort_values("rank")
                want = exact_neighbours(at[d], x[d], q)
                assert list(mine.vec_id) == [w[0] for w in want] and np.allclose(mine.score, [w[1] for w in want], rtol=0, atol=1e-12)
    assert got.groupby("query_id").size().eq(10).all() and set(got.query_id) == {i for i in range(160) if i % 5 == 0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_neighbours_recall(spark, monkeypatch):
    """Against exact search, over many partitions."""
    monkeypatch.setattr(neighbours, "ROWS", 64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).toPandas()
    held = neighbours.valid(df, "vec_id", "embedding").toPandas()
    ids, x = held["vec_id"].to_numpy(), np.stack(held["vec"].to_numpy())
    found = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = {i for i, _ in exact_neighbours(ids, x, q)}
        found, total = found + len(want & set(got[got.query_id == ids[q]].vec_id)), total + len(want)
    assert neighbours.partitions(len(ids)) >= 32 and total >= 100 and found >= 0.93 * total


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).toPandas()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for i, a in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_crossover_keeps_every_document():
    rng = random.Random(3)
    sizes = [rng.randint(1, 900) for _ in range(200)]
    a, b = (packing.first_packing(sizes, 1000, rng, noise) for noise in (0.0, 0.5))
    child = packing.crossover(a, b, 1000, rng)
    assert sorted(s for x in child for s in x) == sorted(sizes) and max(map(sum, child)) <= 1000


def triplets(bins, rng):
    """Sizes that fill `bins` bins of 1000 by threes, which best fit by decreasing size seldom finds."""
    out = []
    for _ in range(bins):
        a = rng.randint(380, 490)
        b = rng.randint(max(250, 1000 - a - 370), (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    return out


def test_generations_improve_where_best_fit_misses_the_bound():
    rng = random.Random(11)
    sizes = triplets(20, rng)
    first = [packing.first_packing(sizes, 1000, rng, 0.05 * k) for k in range(6)]
    least = min(map(len, first))
    assert least > 20
    later = packing.evolve(first, 1000, rng, 600)
    assert len(later[0]) < least and sorted(s for b in later[0] for s in b) == sorted(sizes) and max(map(sum, later[0])) <= 1000
    assert [packing.fitness(p, 1000) for p in later] == sorted((packing.fitness(p, 1000) for p in later), reverse=True)
    changed = packing.mutation(first[0], 1000, rng)
    assert sorted(s for b in changed for s in b) == sorted(sizes)


def test_islands_beat_best_fit(spark, monkeypatch):
    """Where best fit needs more sequences than the bound, several islands and epochs find fewer."""
    rng = random.Random(11)
    counts = np.bincount(triplets(20, rng), minlength=1000)
    sizes = np.repeat(np.arange(1000), counts).tolist()
    plain = len(packing.first_packing(sizes, 1000, rng, 0.0))
    monkeypatch.setattr(packing, "GENERATIONS", 200)
    monkeypatch.setattr(packing, "EPOCHS", 3)
    got = packing.pack_lengths(spark, counts, 1000).toPandas()
    assert got.sequence_id.nunique() < plain and len(got) == len(sizes) and got.groupby("sequence_id").length.sum().max() <= 1000


def test_elites_migrate(spark):
    state = spark.createDataFrame([(0, i, 0, -5, 1.0, bytes([i]), [bytes([i]), bytes([i + 10])]) for i in range(packing.ISLANDS)], "block long, island int, epoch int, fewest long, fill double, elite binary, population array<binary>")
    got = collections.defaultdict(list)
    for r in packing.with_migrants(state).collect():
        got[r["island"]] += [p[0] for p in r["population"]]
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted([i, i + 10, (i - 1) % packing.ISLANDS]) for i in range(packing.ISLANDS)}


def test_packing_with_null_ids(spark):
    got = packing.pack_documents(spark.createDataFrame([(None, "a b"), (2**53 + 1, None)], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (2**53 + 1, 1)]


def brute_repeats(rows, length):
    data = [(r["text"] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r["doc_id"], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram", [(400, 100), (60, 20)])
def test_repeats(docs, empty, length, gram):
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    got = repeats.remove_repeats(rows, length, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows.collect(), length)
    assert repeats.remove_repeats(empty, length, gram).count() == 0


def test_repeats_with_hot_anchors_split(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    got = repeats.remove_repeats(rows, 60, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows.collect(), 60)


def brute_cut(rows, length, words):
    """{doc_id: text} without the bytes of strings of `length` bytes, or of words + 1 words, that start twice."""
    data = [(r["text"] or "").encode() for r in rows]
    spots = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    tokens = [tuple(b[x:y] for x, y in s) for b, s in zip(data, spots, strict=True)]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    passages = collections.Counter(t[i : i + words + 1] for t in tokens for i in range(len(t) - words))
    out = {}
    for r, b, s, t in zip(rows, data, spots, tokens, strict=True):
        gone = bytearray(len(b))
        found = [(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1]
        found += [(s[i][0], s[i + words][1]) for i in range(len(t) - words) if passages[t[i : i + words + 1]] > 1]
        for x, y in found:
            gone[x:y] = b"\1" * (y - x)
        out[r["doc_id"]] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize("length,gram,words,hot", [(400, 100, 50, repeats.HOT), (60, 20, 8, repeats.HOT), (400, 100, 8, 2)])
def test_repeats_of_words(docs, monkeypatch, length, gram, words, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    want = brute_cut(rows.collect(), length, words)
    assert want != brute_cut(rows.collect(), length, 10_000) or words == 50
    got = repeats.remove_repeats(rows, length, gram, words=words).select("doc_id", "kept_text")
    assert dict(map(tuple, got.collect())) == want
    kept = repeats.remove_repeats(rows, length, gram, keep_columns=True, words=words).select("doc_id", "text")
    assert {i: t or "" for i, t in kept.collect()} == want


def test_passages_of_over_50_words_go(spark):
    """Planted passages of 51 to 60 words, under 400 bytes and with other white space in each document; one of 50 stays."""
    own = lambda d, n: [f"d{d}n{i}" for i in range(n)]
    rows, want = [], {}
    for k, n in enumerate([50, 51, 54, 60]):
        passage = [f"p{k}w{i}"[:6] for i in range(n)]
        assert len(" ".join(passage)) < 400
        for d, gap in ((2 * k, " "), (2 * k + 1, "\n")):
            before, after = own(d, 70), own(100 + d, 70)
            rows.append((d, " ".join(before) + " " + gap.join(passage) + " " + " ".join(after)))
            want[d] = before + (passage if n == 50 else []) + after
    rows.append((99, " ".join(own(99, 300))))
    want[99] = own(99, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs, keep_columns=True, words=50).collect()
    assert {r["doc_id"]: r["text"].split() for r in got} == want


def test_components_of_stars_need_no_round(spark):
    """Each round is some 1,000 tasks at 211 partitions, which the driver keeps track of."""
    links = spark.createDataFrame([(1, 5), (9, 1), (1, 7), (2, 4), (3, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(links, rounds=0).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 4: 2}
    for more in ((5, 9), (4, 6), (0, 1)):  # a ray with two ends, a chain, a centre that is a ray
        open_ = links.unionByName(spark.createDataFrame([more], "a long, b long"))
        with pytest.raises(RuntimeError):
            graph.components(open_, rounds=0)
        assert len({r["node"] for r in graph.components(open_).collect()}) == len({1, 2, 4, 5, 7, 9, *more})


def test_columnwise_finds_windows_that_hold_the_gram():
    parts = [b"abcabcab", b"xbcabcab", b"abcabcaz", b"abc"]
    found = repeats.columnwise(parts, np.array([3, 3, 3, 0]), 4)
    assert [f.tolist() for f in found] == [[0, 1, 2, 3], [1, 2, 3], [0, 1, 2, 3], []]


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values)) and len(got) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, cap, total = {s: 1 + i % 3 for i, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    full: set = set()
    while True:
        left = total - sum(cap[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: cap[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if target[s] > cap[s]}
        if not over:
            break
        full |= over
    assert {round(t, 6) for t in got.target} == {round(t, 6) for t in target.values()}
    assert (got.taken <= 3 * got["size"]).all()
    by_size = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "max"))
    off = (by_size.taken - by_size.target).abs()
    short = by_size["size"] < 1000
    assert (off <= 0.5 * by_size["size"] + 1).all() and (off[short] <= 0.02 * by_size.target[short] + 30).all()
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


@pytest.fixture(scope="module")
def all_ways():
    """The logarithm of a word's probability, every segmentation, from the sentencepiece model alone."""
    import functools

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    plain = {i: 1 / (10 - model.get_score(i)) for i in usual} | {i: 1 / (10 + model.get_piece_size()) for i in range(model.get_piece_size()) if model.is_byte(i)}

    @functools.cache
    def at_scale(scale):
        weight = {i: w**scale for i, w in plain.items()}
        total = sum(weight.values())
        return {model.id_to_piece(i): weight[i] / total for i in usual}, {int(model.id_to_piece(i)[3:-1], 16): weight[i] / total for i in weight if model.is_byte(i)}

    longest = max(len(model.id_to_piece(i)) for i in usual)

    @functools.cache
    def ways(word, scale=1.0):
        pieces, spelt = at_scale(scale)
        word = "▁" + word
        alpha = [0.0]
        for b in range(1, len(word) + 1):
            terms = [alpha[a] + math.log(pieces[word[a:b]]) for a in range(max(0, b - longest), b) if word[a:b] in pieces]
            if word[b - 1] not in pieces:
                terms.append(alpha[b - 1] + sum(math.log(spelt[x]) for x in word[b - 1].encode()))
            alpha.append(max(terms) + math.log(math.fsum(math.exp(t - max(terms)) for t in terms)))
        return alpha[-1]

    return ways


@pytest.mark.parametrize("top", [0, 25, 100_000])
def test_lm_scores(docs, empty, all_ways, top):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm.score_documents(docs, path, top=top).toPandas()
    rows = [(r["doc_id"], words((r["text"] or "").translate(ASCII))) for r in docs.collect()]
    training = [ws for i, ws in rows if zlib.crc32(str(i).encode()) % 10]
    seen = collections.Counter(w for ws in training for w in [*ws, None])
    n, v = sum(seen.values()), len(seen)
    p_end = (len(training) + 0.5) / (n + 1)

    fit = {scale: math.fsum(seen[w] * all_ways(w, scale) for w in seen if w is not None) for scale in lm.SCALES}
    best = max(fit, key=fit.get)

    def score(ws):
        """By the lattices alone, at the scale under which the training words are likeliest."""
        each = [math.log10(1 - p_end) + all_ways(w, best) / math.log(10) for w in ws]
        return round(math.fsum([*each, math.log10(p_end)]), 5)

    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(ws) + 1, sum(seen[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None]), 5), score(ws)) for i, ws in rows)
    mine = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got.itertuples())
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in mine], [x[5:] for x in want], rtol=1e-9, atol=2e-5)
    assert lm.score_documents(empty, path, top=top).count() == 0


def test_lm_with_null_ids_and_no_training(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm.score_documents(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string"), path).collect()
    assert {r["train_tokens"] for r in got} == {0} and all(r["doc_id"] is None and r["held_out"] and r["n_known"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3]


def test_lattice_adds_up_all_segmentations(all_ways, monkeypatch):
    lattice = lm.Lattice(lm.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    each = ["the", "inertia", "größe", "\U0001f600x", "", "漢字かな", "z" * 300, "internationalisation" * 8]
    for long_ in (64, 0, 1000):
        monkeypatch.setattr(lm, "LONG", long_)
        got = lattice.forward(each)
        for k, scale in enumerate(lm.SCALES):
            assert got[k] == pytest.approx([all_ways(w, scale) for w in each], abs=1e-8)


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        w = words((r["text"] or "").translate(ASCII))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least: dict = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted((r["doc_id"], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("size,percent,room", [(4, 85, 400_000), (5, 80, 300), (2, 50, 400_000), (1, 30, 400_000), (3, 95, 3)])
def test_jaccard(docs, empty, monkeypatch, size, percent, room):
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", room)
    monkeypatch.setattr(jaccard, "TASK_SETS", room)
    got = jaccard.join_documents(docs, size, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(docs.collect(), size, percent)
    assert jaccard.join_documents(empty, size, percent).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 67, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    """Any two linked sets have one subset alike, however their shingles are ordered, also without those of no
    other set."""
    rng = random.Random(percent)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a, shared = list(range(n)), rng.randint(0, n)
        b = a[:shared] + list(range(1000, 1000 + rng.randint(0, n)))
        if 100 * shared < percent * len({*a, *b}):
            continue
        alone = {x for x in {*a, *b} if (x >= shared) and rng.random() < 0.4}  # these are in no third set
        place = {x: rng.random() for x in {*a, *b}}
        found = []
        for t in (a, b):
            common = np.array(sorted((x for x in t if x not in alone), key=place.get), np.int64)
            own = len(t) - len(common)
            first, apart = max(0, int(jaccard.spare(len(t), percent)) - own), max(0, jaccard.most_apart(len(t), percent) - own)
            found.append({(k, s) for k in jaccard.subset_sizes(len(t), percent) for s in jaccard.subset_signatures(common[: (apart + 1) * (k - 1) + 1 + first], k).tolist()})
        assert found[0] & found[1]


def test_many_short_near_copies(spark, monkeypatch):
    """One cluster of many blocks: every set has one word of its own, and links with all others."""
    monkeypatch.setattr(jaccard, "TASK_SETS", 400)
    rows = [(i, " ".join([*(f"w{k}" for k in range(30)), f"own{i}"])) for i in range(1500)]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()
    assert tuple(got) == (1499, 1499, 0)


def test_sieve_passes_every_key(spark):
    from auditspark.llm.common import sieved

    got = sieved(spark.range(50_000).withColumnRenamed("id", "k"), "k", spark.range(0, 50_000, 100).withColumnRenamed("id", "k"))
    assert got.filter("maybe AND k % 100 = 0").count() == 500 and got.filter("maybe").count() < 600 and got.count() == 50_000


def brute_links(rows, size, percent):
    sets = []
    for r in rows:
        w = words((r["text"] or "").translate(ASCII))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    linked = lambda a, b: len(a & b) and 100 * len(a & b) >= percent * len(a | b)
    return sorted((r["doc_id"], sum(bool(linked(a, b)) for j, b in enumerate(sets) if i != j)) for i, (r, a) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("size,percent,room", [(4, 85, 400_000), (5, 80, 300)])
def test_jaccard_counts_links(spark, docs, monkeypatch, size, percent, room):
    """A chain is not a clique, and copies count as often as they occur, in one task or over blocks."""
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", room)
    w = [f"w{i}" for i in range(160)]
    chain = [(900 + k, " ".join(w[4 * k : 4 * k + 60])) for k in range(8)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*chain, (950, chain[2][1])], "doc_id long, text string"))
    got = jaccard.join_documents(rows, size, percent)
    want = brute_links(rows.collect(), size, percent)
    assert sorted((r["doc_id"], r["n_links"]) for r in got.collect()) == want and max(n for i, n in want if i >= 900) < 8


def test_jaccard_with_null_and_shared_ids(spark):
    big, w = 2**53 + 1, [f"w{i}" for i in range(400)]
    near = lambda a, k: " ".join(w[a : a + 60 + k])
    rows = [(None, near(0, 0)), (None, near(0, 0)), (None, near(0, 2)), (big, near(0, 3)), (None, near(100, 0)), (None, near(100, 1)), (None, near(200, 0)), (None, None), (7, near(300, 0)), (7, near(300, 1)), (7, near(250, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_documents(docs).collect()
    key = lambda x: (x[0] is None, *[-1 if v is None else v for v in x])
    want = [(None, 57, big, 3), (None, 57, big, 3), (None, 59, big, 3), (big, 60, big, 3), (None, 57, None, 1), (None, 58, None, 1), (None, 57, None, 0), (None, 0, None, 0), (7, 57, 7, 1), (7, 58, 7, 1), (7, 62, 7, 0)]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=key) == sorted(want, key=key)
    kept = sorted((r["text"] or "").split(" ")[0] for r in jaccard.keep_one(docs).collect())
    assert kept == ["", "w0", "w100", "w200", "w250", "w300"]


def test_keep_one(docs, empty):
    odd = docs.withColumn("row", F.col("doc_id") * 3).withColumn("rid", F.lit("r")).withColumn("maybe", F.lit(False))
    same = jaccard.keep_one(odd)
    assert same.columns == odd.columns and same.filter("row <> doc_id * 3 OR rid <> 'r' OR maybe OR _rid <> 'clash' OR rank * 3 <> doc_id").count() == 0
    assert jaccard.keep_one(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert same.count() == kept.count()
    groups = collections.defaultdict(set)
    for i, n, c in brute_components(docs.collect(), 5, 80):
        groups[c if n else (i, "no words")].add(i)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)] + [(200, x) for x in range(201, 230)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 230)} == {200}


def brute_measures(text):
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules(docs, empty, texts):
    for t in texts:
        assert rules.measures(t or "") == brute_measures(t)
    got = rules.apply_rules(docs).toPandas()
    assert (got.base_failed == ((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words))).all()
    assert not (got.kept & got.base_failed).any() and len(got) == docs.count()
    inside = (got.log_perplexity >= got.band_low) & (got.log_perplexity <= got.band_high)
    assert (got.kept == (~got.base_failed & inside)).all() and rules.apply_rules(empty).count() == 0
    # Bands from the scores themselves, sorted: the histogram is at most a step away.
    for _, part in got.groupby("lang"):
        passed = np.sort(part.log_perplexity[~part.base_failed].to_numpy())
        if not len(passed):
            continue
        centre = passed[(len(passed) - 1) // 2]
        deviation = np.sort(np.abs(passed - centre))[(len(passed) - 1) // 2]
        half = rules.WIDTH * max(deviation, 1 / rules.STEP) + rules.SHORT / np.sqrt(np.maximum(part.n_chars, 1))
        near = (0.5 + 2 * rules.WIDTH) / rules.STEP
        assert np.allclose(part.band_low, centre - half, rtol=0, atol=near) and np.allclose(part.band_high, centre + half, rtol=0, atol=near)


def test_sorted_weights():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), [-(2**63), 2**63 - 1, 0]]))
    rng.shuffle(keys)
    weights = rng.normal(size=len(keys))
    known = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    asked = np.concatenate([keys[:2000], keys[:50], rng.integers(-(2**63), 2**63 - 1, 3000), [-(2**63), 2**63 - 1, 1]])
    held = rules.SortedWeights(keys, weights)
    assert (np.diff(held.keys) > 0).all()
    weight, found = held.find(asked)
    assert weight.tolist() == [known.get(k, 0.0) for k in asked.tolist()] and found.tolist() == [k in known for k in asked.tolist()]
    for h, k in ((held, keys[:0]), (rules.SortedWeights(keys[:0], weights[:0]), asked)):
        weight, found = h.find(k)
        assert len(weight) == len(found) == len(k) and not weight.any() and not found.any()


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(2)
    keys, counts = np.unique(rng.integers(0, 1 << 12, 4000), return_counts=True)
    model = dense_model.kneser_ney(keys, counts)
    for context in (0, 77, 4095, 12345):
        p = 10 ** model.score(np.array([(context << 5) | c for c in range(32)], np.int32))
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_mixing_tilts_documents(docs, spark, monkeypatch):
    """Rates follow one logistic of the length in each source, found here by bisection, and meet the targets."""
    got = mixing.mix(docs).toPandas()
    plain = mixing.mix(docs, tilt="mass").toPandas()
    assert sorted(got.target) == pytest.approx(sorted(plain.target)) and (got.taken <= 3 * got["size"]).all()
    tilted = 0
    for _, rows in got[got["size"] > 0].groupby("source_size"):
        target = rows.target.iloc[0]
        if target >= 3 * rows.source_size.iloc[0] * (1 - 1e-9):
            assert (rows.rate == 3).all()
            continue
        x = rows["size"] / rows["size"].mean()
        low, high = -1e4, 1e4
        for _ in range(200):
            dual = (low + high) / 2
            rate = 3 / (1 + np.exp(np.clip(math.log(2) - dual * x, -700, 700)))
            low, high = (dual, high) if (rate * rows["size"]).sum() < target else (low, dual)
        assert np.allclose(rows.rate, rate, rtol=1e-5, atol=1e-7)
        tilted += rows.rate.nunique() > 1
    assert tilted
    used = []
    monkeypatch.setattr(mixing, "table", lambda *_: docs)
    monkeypatch.setattr(mixing, "solve", lambda hist, goals, tilt, cap, f=mixing.solve: used.append(tilt) or f(hist, goals, tilt, cap))
    mixing.op6_mix(spark, "")
    assert used == ["size"]


def test_mixing_of_uneven_lengths(spark, monkeypatch):
    """One long document beside many short ones: the multiplier must saturate some rates; too few steps raise."""
    rows = [(i, "w " * n, f"s{i % 3}") for i, n in enumerate([1] * 300 + [20_000, 5, 7_000] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, of in got.groupby("source_size"):
        assert abs(of.taken.sum() - of.target.iloc[0]) <= 0.5 * of["size"].max() + 1
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        mixing.mix(docs)


def test_mixed_keeps_columns_and_repeats(docs, empty):
    odd = docs.withColumnRenamed("_rid", "_key").withColumn("key", F.lit("k")).withColumn("times", F.col("doc_id") * 7)
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and mixing.mixed(odd.filter("false")).count() == 0
    assert got.filter("_key <> 'clash' OR key <> 'k' OR times <> doc_id * 7").count() == 0
    plan = mixing.mix(docs).toPandas().groupby("doc_id")
    want = {i: int(p.copies.sum()) if p["size"].max() else len(p) for i, p in plan}
    mine = collections.Counter(r["doc_id"] for r in got.collect())
    odd_ids = {r["doc_id"] for r in docs.groupBy("doc_id").count().filter("count > 1").collect()}
    assert all(mine[i] == n for i, n in want.items() if i not in odd_ids)
    assert all(mine[i] <= 6 for i in odd_ids)


def test_joined_model_agrees_with_dense(spark):
    rng, symbols = random.Random(3), " абвгдежзийклмнопрстуфхцчшщъыьэ"
    texts = [symbols[1:]] + ["".join(rng.choices(symbols, weights=[1 + 31 // (1 + i) for i in range(31)], k=rng.randint(5, 400))) for _ in range(60)]
    found = collections.Counter()
    for t in texts:
        padded = [0, 0, 0] + [symbols.index(c) for c in t]
        found.update((a << 15) | (b << 10) | (c << 5) | d for a, b, c, d in zip(padded, padded[1:], padded[2:], padded[3:]))
    keys = np.array(sorted(found))
    dense = dict(zip(keys.tolist(), dense_model.kneser_ney(keys, np.array([found[k] for k in keys.tolist()])).score(keys.astype(np.int32)).tolist(), strict=True))
    other = [("xx", "noise " * 50)]
    got = {r["key"]: r["logp"] for r in rules.train(spark.createDataFrame([("ru", t) for t in texts] + other, "lang string, text string")).collect()}
    for t in texts:
        padded = [0, 0, 0] + [symbols.index(c) for c in t]
        want = [dense[(a << 15) | (b << 10) | (c << 5) | d] for a, b, c, d in zip(padded, padded[1:], padded[2:], padded[3:])]
        assert [got[k] for k in rules.grams("ru", [t])[0].tolist()] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("top", [1_000_000, 300, 0])
def test_every_script_keeps_its_letters(spark, top):
    """Letters dealt anew within their parity are worse than prose, whether n-grams are sent to the tasks or
    joined."""
    rng, rows = random.Random(8), []
    for lang, first in (("ru", 0x430), ("zh", 0x4E00)):
        letters = [chr(first + i) for i in range(30)]
        vocabulary = ["".join(rng.choices(letters, k=rng.randint(3, 6))) for _ in range(60)]
        swap = {0: letters[::2], 1: letters[1::2]}
        for i in range(60):
            text = " ".join(rng.choices(vocabulary, k=80))
            if i >= 55:
                text = "".join(c if c == " " else rng.choice(swap[(ord(c) - first) % 2]) for c in text)
            rows.append((i, text, lang))
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string")
    got = rules.apply_rules(docs, top=top).toPandas()
    model = {r["key"]: r["logp"] for r in rules.train(docs).collect()}
    for r in got.itertuples():
        lang, text = r.lang, next(t for i, t, of in rows if i == r.doc_id and of == r.lang)
        assert r.log_perplexity == pytest.approx(-math.fsum(model[k] for k in rules.grams(lang, [text])[0].tolist()) / len(text), abs=1e-9)
    for lang in ("ru", "zh"):
        mine = got[got.lang == lang]
        assert mine[mine.doc_id >= 55].log_perplexity.min() > 1.2 * mine[mine.doc_id < 55].log_perplexity.max()
        assert not mine[mine.doc_id >= 55].kept.any() and mine[mine.doc_id < 55].kept.mean() > 0.8


def test_every_language_has_its_own_model(spark):
    """The scores of the smallest of 40 languages do not depend on the other languages."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(rng.choices(vocabulary, k=30)), f"l{k:02d}") for i in range(45 - k)]
    schema = "doc_id long, text string, lang string"
    columns = ["doc_id", "log_perplexity", "band_low", "band_high", "kept"]
    got = rules.apply_rules(spark.createDataFrame(rows, schema)).filter("lang = 'l39'").select(*columns).toPandas().sort_values("doc_id")
    alone = rules.apply_rules(spark.createDataFrame([r for r in rows if r[2] == "l39"], schema)).select(*columns).toPandas().sort_values("doc_id")
    assert len(got) == 6 and got.to_numpy(float) == pytest.approx(alone.to_numpy(float), abs=1e-9)


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choices(["the", "house", "stands", "near", "a", "quiet", "river,", "and", "people", "walk."], k=80)) + " " + " ".join(f"w{rng.randint(0, 999)}x" for _ in range(60))
    rows = [(i, clean(), 1, 0) for i in range(200)] + [(200 + i, "".join(f"{w}### " for w in clean().split()), 0, 0) for i in range(30)] + [(230 + i, "spam " * 150, 0, 0) for i in range(30)] + [(260 + i, clean() + " idiot scum idiot moron", 1, 1) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = quality.fit(labelled.select("doc_id", "text"), labelled.filter("doc_id % 2 = 0").select("doc_id", "quality", "toxic"))
    got = quality.classify(labelled, model).toPandas().merge(labelled.drop("text").toPandas(), on="doc_id")
    held = got[got.doc_id % 2 == 1]
    assert held[(held.quality == 1) & (held.toxic == 0)].accepted.mean() >= 0.98
    assert held[held.quality == 0].accepted.mean() <= 0.1 and held[held.toxic == 1].accepted.mean() <= 0.2
    kept = quality.classify(docs, model, keep_columns=True)
    assert kept.columns == [*docs.columns, "_accepted"] and kept.count() == docs.count()
    assert quality.classify(empty, model).count() == 0
    none = quality.fit(empty.select("doc_id", "text"), labelled.filter("false"))
    assert quality.classify(docs.filter("text IS NULL"), none).filter("accepted").count() == docs.filter("text IS NULL").count()


def test_quality_of_tiny_texts(spark):
    """Texts of few words are scored like all others; only those without words are accepted unseen."""
    rng = random.Random(9)
    clean = lambda k: " ".join(rng.choices(["the", "house", "stands", "near", "a", "quiet", "river,", "and", "people", "walk."], k=k))
    rows = [(i, clean(80), 1, 0) for i in range(200)] + [(200 + i, "".join(f"{w} ### $$$ *** " for w in clean(20).split()), 0, 0) for i in range(60)] + [(260 + i, clean(rng.randint(1, 80)) + " idiot scum idiot moron", 1, 1) for i in range(100)]
    rows += [(360 + i, clean(rng.randint(1, 4)), 1, 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = quality.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality", "toxic"))
    tiny = [(0, "idiot scum moron", False), (1, "### $$$ ***", False), (2, "the quiet house", True), (3, "", True), (4, None, True), (5, " \n", True)]
    got = quality.classify(spark.createDataFrame([t[:2] for t in tiny], "doc_id long, text string"), model).toPandas().set_index("doc_id")
    assert got.accepted.to_dict() == {i: a for i, _, a in tiny} and (got.loc[[3, 4, 5], ["junk_score", "toxic_score"]] == 0).all(axis=None)


def test_weak_labels_teach_beside_gold(spark):
    """Junk of a kind that no gold label covers is learnt from the votes, though gold rows would fill the sample."""
    rng = random.Random(11)
    clean = lambda: " ".join(rng.choices(["the", "house", "stands", "near", "a", "quiet", "river,", "and", "people", "walk."], k=80)) + " " + " ".join(f"w{rng.randint(0, 999)}x" for _ in range(60))
    gold = [(i, clean(), 1, 0) for i in range(120)] + [(120 + i, "spam " * 150, 0, 0) for i in range(40)]
    weak = [(200 + i, clean(), None, None) for i in range(60)] + [(260 + i, "".join(f"{w}### " for w in clean().split()), None, None) for i in range(40)]
    rows = spark.createDataFrame(gold + weak, "doc_id long, text string, quality int, toxic int")
    model = quality.fit(rows.select("doc_id", "text"), rows.filter("quality IS NOT NULL").select("doc_id", "quality", "toxic"), sample=100)
    got = quality.classify(rows, model).toPandas().set_index("doc_id").accepted
    assert got.loc[260:].mean() <= 0.1 and got.loc[:119].mean() >= 0.95 and got.loc[200:259].mean() >= 0.95 and got.loc[120:159].mean() <= 0.1


def test_label_model_agrees_with_brute_force():
    """Expectation-maximisation document by document, in plain loops."""
    rng = random.Random(4)
    rows = [[rng.choice([0, 1, 2]) for _ in range(3)] + [rng.choice([0, 1, 2, 2])] for _ in range(120)]
    seen = collections.Counter(map(tuple, rows))
    model = quality.expectation_maximisation(np.array(list(seen)), np.array(list(seen.values()), float), rounds=7)
    k = 4
    start = [[[0.99, 0.01], [0.7, 0.3]] for _ in range(k - 1)] + [[[0.99, 0.01], [0.01, 0.99]]]
    silent = [(sum(r[j] == 2 for r in rows) + 1) / (len(rows) + 2) for j in range(k)]
    spoken, prior = [[list(c) for c in lab] for lab in start], 0.1

    def junk(r):
        p = [1 - prior, prior]
        for c in (0, 1):
            for j, v in enumerate(r):
                p[c] *= silent[j] if v == 2 else spoken[j][c][v] * (1 - silent[j])
        return p[1] / (p[0] + p[1])

    for _ in range(7):
        post = [junk(r) for r in rows]
        for j in range(k - 1):
            for c in (0, 1):
                votes = [spoken[j][c][v] + sum((q if c else 1 - q) for r, q in zip(rows, post, strict=True) if r[j] == v) for v in (0, 1)]
                spoken[j][c] = [x / sum(votes) for x in votes]
        prior = min(max(sum(post) / len(rows), 1e-4), 0.5)
    assert model.prior == pytest.approx(prior, abs=1e-9)
    assert model.posterior(np.array(rows)) == pytest.approx([junk(r) for r in rows], abs=1e-9)


def test_linear_scorer_agrees_with_brute_force():
    """The weights are where the gradient of the penalised loss, taken by differences, vanishes."""
    rng = np.random.default_rng(8)
    n, features = 600, np.array([3, 70, 999, 5000])
    has = rng.random((n, 4)) < 0.4
    target = 1 / (1 + np.exp(-(has @ np.array([2.0, -1.5, 1.0, -2.0]) - 0.2)))
    target = np.where(rng.random(n) < 0.5, (rng.random(n) < target).astype(float), target)
    doc, col = np.nonzero(has)
    chosen, w, bias = quality.linear(doc, features[col], target, passes=20_000, penalty=1e-3)
    assert set(chosen) <= set(features)
    x = has[:, np.searchsorted(features, chosen)].astype(float)

    def loss(v):
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p)) + 0.5e-3 * (v[:-1] ** 2).sum()

    at = np.append(w, bias)
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 2e-4


def test_quality_measures_agree_with_plain_python(texts):
    stats, doc, bucket = quality.measures([t or "" for t in texts])
    for i, t in enumerate(texts):
        t = t or ""
        ws, data = words(t), t.encode()
        low = data.lower()
        chars = max(1, sum(b not in b" \t\n\x0b\x0c\r" for b in data))
        spelt = ["".join(chr(b) for b in w.encode().lower() if b >= 0x80 or chr(b).isalnum()) for w in ws]
        lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        want = [
            sum(b in b"#*$%&|<>{}[]\\^~=_@" for b in data) / chars,
            sum(65 <= b <= 90 for b in data) / chars,
            sum(48 <= b <= 57 for b in data) / chars,
            chars / max(1, len(ws)),
            sum(a == b != "" for a, b in zip(spelt, spelt[1:])) / max(1, len(ws)),
            -len({x for x in spelt if x}) / len(ws) if ws else -1.0,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            sum(b in b".," for b in data) / max(1, len(ws)),
            sum(not (97 <= w.encode().lower()[-1] <= 122 or w.encode()[-1] >= 0x80) for w in ws) / max(1, len(ws)),
            len(ws),
        ]
        assert stats[i] == pytest.approx(want), t[:40]
        assert len(low) == len(data) and len(np.unique(bucket[doc == i])) == (doc == i).sum()


def test_classify_scores_by_its_weights(spark, docs, empty):
    """Scores are the logistic of the sums of the model's weights, row by row, and decide what stays."""
    labels = docs.select("doc_id", (F.length("text") % 3 > 0).cast("int").alias("quality"), (F.length("text") % 5 == 0).cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    model = quality.fit(docs, labels)
    got = {(r["doc_id"]): r for r in quality.classify(docs, model).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        _, _, bucket = quality.measures([t])
        for name, scorer in (("junk_score", model.junk), ("toxic_score", model.toxic)):
            weight = dict(zip(scorer.buckets.tolist(), scorer.weights.tolist(), strict=True)) if scorer else {}
            z = scorer.bias + sum(weight.get(b, 0.0) for b in bucket.tolist()) if scorer else -math.inf
            want = 0.0 if not words(t) else 1 / (1 + math.exp(-max(-30, min(30, z))))
            assert got[r["doc_id"]][name] == pytest.approx(want, abs=1e-9)
    odd = docs.withColumn("_accepted", F.lit("no")).withColumn("row", F.col("rank") + 1).withColumn("_s", F.lit(1))
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and kept.filter("_accepted <> 'no' OR row <> rank + 1").count() == 0
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect() if got[r["doc_id"]]["accepted"])
    assert quality.accepted(empty, model).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    right = [0.95, 0.9, 0.8]
    v = np.stack([np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in right] + [np.where(rng.random(4000) < 0.1, truth, 2).astype(int)], 1)
    pattern, n = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(pattern, n.astype(float))
    assert abs(model.prior - 0.2) < 0.03 and ((model.posterior(v) > 0.5) == truth).mean() > 0.94
