"""The pipeline's stages, each on its predecessor's rows, against plain re-computation."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditspark.llm.common import stored, table

from .test_operators import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [d.collect() for d in kept]
    ids = [[r["doc_id"] for r in x] for x in rows]
    clean = [i for i in ids[0] if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    assert len(set(clean) & set(ids[1])) >= 0.97 * len(clean)
    junk = [i for i in ids[0] if i in labels and labels[i]["quality"] == 0]
    assert len(set(junk) & set(ids[1])) <= 0.3 * len(junk)
    groups = collections.defaultdict(list)
    for i, n, c in brute_components(rows[1], 5, 80):
        groups[c if n else ("no words", i)].append(i)
    assert sorted(ids[2]) == sorted(min(g) for g in groups.values())
    removed = {i: n for i, _, n, _, _ in brute_repeats(rows[2], 400)}
    for before, after in zip(sorted(rows[2]), sorted(rows[3]), strict=True):
        lost = len((before["text"] or "").encode()) - len((after["text"] or "").encode())
        assert removed[before["doc_id"]] <= lost <= removed[before["doc_id"]] + 6 * (removed[before["doc_id"]] > 0)
    times = collections.Counter(ids[4])
    assert set(times) <= set(ids[3]) and max(times.values()) <= 3
    pieces = collections.Counter(r["doc_id"] for r in rows[5] if r["piece"] == 0)
    assert pieces == times
    filled = collections.Counter()
    for r in rows[5]:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, texts empty and long, and columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5), (3, long, "en", "s", len(long)), (4, long + " end", "en", "t", None), (None, "prose of a null id, some words long.", "en", "s", 1), (7, "  \n", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_rid", "_key", "_accepted", "row", "rid", "key", "maybe", "size", "rank", "copies", "part"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, held, SF))
        assert after.columns == docs.columns, name
        for r in after.collect():
            assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for c in docs.columns[5:]), name
        assert set(r["doc_id"] for r in after.collect()) <= {None, 1, 2, 3, 4, 7}
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(str(i) for i in {r["doc_id"]: 0 for r in held.collect() if r["doc_id"] not in (4, None)}) + ["None"] * sum(r["doc_id"] is None for r in held.collect())
        held = after
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, SF).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(rows) and stage(spark, docs.filter("false"), SF).count() == 0
