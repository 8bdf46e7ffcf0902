"""Quality classifier: heuristic labellers weighed by expectation-maximisation teach a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, checkpoint, lower_bytes, table, word_bounds

#: Hashed features: word presence in the lower half, word shapes and binned measures in the upper.
BUCKETS = 1 << 18
HALF = BUCKETS // 2
#: Rows of either kind, with gold labels and without, that the linear scorers are fitted on, by a hash of the id.
SAMPLE = 8_000
#: A document is rejected above these probabilities.
JUNK, TOXIC = 0.7, 0.9
ROUNDS = 50
STATS = ("symbols", "upper", "digits", "word_length", "same_next", "distinct", "line_repeats", "stops", "marks", "n_words")
#: Labellers: a measure and the value from which it votes junk; below, it votes good. Measures of
#: repetition abstain below 20 words, and all abstain on texts without words.
LABELLERS = (
    ("symbols", 0.03),
    ("upper", 0.25),
    ("digits", 0.30),
    ("word_length", 12.0),
    ("same_next", 0.10),
    ("distinct", -0.30),
    ("line_repeats", 0.40),
    ("marks", 0.60),
)
_REPETITION = {"same_next", "distinct", "line_repeats"}


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each text (a row of STATS), and its distinct features as parallel arrays of text
    number and bucket."""
    raw = [as_bytes(t) for t in texts]
    data = np.frombuffer(b"\n\n".join([*raw, b""]), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
    n_docs = len(raw)
    start, end = word_bounds(data)
    doc = np.searchsorted(begin, start, "right") - 1
    low = lower_bytes(data)
    letter = ((low >= 97) & (low <= 122)) | (data >= 0x80)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8))
    total = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), begin) if n_docs else np.zeros(0)

    spelt = letter | digit  # a word is known by these, without its marks
    upto = np.concatenate([[0], np.cumsum(spelt)])
    words = Rolling(low[spelt]).spans(upto[start], upto[end])
    has = upto[end] > upto[start]
    shape = np.where(letter, np.where(upper, 65, 97), np.where(digit, 48, data)).astype(np.uint8)
    first = np.ones(len(shape), bool)
    first[1:] = shape[1:] != shape[:-1]
    kept = np.concatenate([[0], np.cumsum(first & ~blank)])
    shapes = Rolling(shape[first & ~blank]).spans(kept[start], kept[end])

    n_words = np.bincount(doc, minlength=n_docs)
    some = np.maximum(n_words, 1)
    chars = np.maximum(total(~blank), 1)
    next_same = np.zeros(len(words), bool)
    if len(words) > 1:
        next_same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]) & has[1:]
    word_doc, word_hash = distinct_pairs(doc[has], words[has])
    distinct = np.bincount(word_doc, minlength=n_docs)
    stops = total((data == 46) | (data == 44))
    marks = np.bincount(doc, weights=~(((low[end - 1] >= 97) & (low[end - 1] <= 122)) | (data[end - 1] >= 0x80)) if len(end) else None, minlength=n_docs)

    line_at = np.flatnonzero(np.append(data, 10) == 10)
    line_from = np.concatenate([[0], line_at[:-1] + 1])
    filled = np.concatenate([[0], np.cumsum(~blank)])
    real = filled[line_at] > filled[line_from]
    line_from, line_at = line_from[real], line_at[real]
    line_doc = np.searchsorted(begin, line_from, "right") - 1
    lines = np.bincount(line_doc, minlength=n_docs)
    line_hash = Rolling(data).spans(line_from, line_at)
    repeats = 1 - np.bincount(distinct_pairs(line_doc, line_hash)[0], minlength=n_docs) / np.maximum(lines, 1)

    stats = np.stack(
        [total(symbol) / chars, total(upper) / chars, total(digit) / chars, chars / some, np.bincount(doc, weights=next_same, minlength=n_docs) / some, -np.where(n_words > 0, distinct / some, 1.0), np.where(lines > 0, repeats, 0.0), stops / some, marks / some, n_words.astype(float)],
        1,
    )
    bins = np.stack([np.digitize(stats[:, j], _edges(j)) + 16 * j for j in range(stats.shape[1])], 1)
    bin_bucket = HALF + (bins.astype(np.uint64) * np.uint64(2654435761) % np.uint64(HALF)).astype(np.int64)
    shape_bucket = HALF + (shapes % np.uint64(HALF)).astype(np.int64)
    pairs = np.concatenate([word_doc * BUCKETS + (word_hash % np.uint64(HALF)).astype(np.int64), doc * BUCKETS + shape_bucket, (np.arange(n_docs)[:, None] * BUCKETS + bin_bucket).ravel()])
    pairs = np.unique(pairs)
    return stats, pairs // BUCKETS, pairs % BUCKETS


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text. Text numbers rise, so sorting by value is enough before a stable
    sort by text."""
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new]


def _edges(j: int) -> np.ndarray:
    name = STATS[j]
    if name == "word_length":
        return np.array([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30])
    if name == "n_words":
        return np.array([1, 5, 10, 20, 50, 100, 200, 500, 1000, 5000])
    if name == "distinct":
        return np.array([-0.9, -0.8, -0.7, -0.6, -0.5, -0.4, -0.3, -0.2, -0.1, -0.05])
    return np.array([1e-9, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8])


def votes(stats: np.ndarray) -> np.ndarray:
    """A row of 0 (good), 1 (junk) or 2 (abstains) for each text."""
    few = stats[:, STATS.index("n_words")] < 20
    out = []
    for name, junk in LABELLERS:
        v = (stats[:, STATS.index(name)] >= junk).astype(np.int64)
        if name in _REPETITION:
            v = np.where(few, 2, v)
        out.append(np.where(stats[:, STATS.index("n_words")] == 0, 2, v))
    return np.stack(out, 1) if len(stats) else np.zeros((0, len(LABELLERS)), np.int64)


def pack(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(1)


def unpack(pattern: np.ndarray, n: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(n) % 3


@dataclass
class LabelModel:
    """prior: share of junk; table[l, c, v]: how often labeller l votes v on documents of class c."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of junk for each row of votes."""
        at = np.arange(v.shape[1])
        logs = [np.log(p) + np.log(self.table[at, c, v]).sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Fits the label model to vote patterns v seen n times; the last column holds gold labels, which
    abstain wherever there are none. Kinds of junk differ, so a labeller may miss most junk (30 % found
    to begin with), yet seldom votes junk on good text (1 %). Gold labels are taken to be right 99
    times in 100 throughout, which fixes what the two classes mean. A pseudo-count of one vote keeps
    every probability above zero, and abstaining says nothing about the class."""
    k = v.shape[1]
    spoken = np.empty((k, 2, 2))
    spoken[:, 0], spoken[:, 1] = [0.99, 0.01], [0.7, 0.3]
    spoken[-1] = [[0.99, 0.01], [0.01, 0.99]]
    away = np.array([(n * (v[:, j] == 2)).sum() + 1 for j in range(k)]) / (n.sum() + 2)

    def whole() -> np.ndarray:
        return np.concatenate([spoken * (1 - away)[:, None, None], np.repeat(away[:, None, None], 2, 1)], 2)

    model = LabelModel(0.1, whole())
    for _ in range(rounds):
        junk = model.posterior(v)
        for j in range(k - 1):
            for c, w in ((0, (1 - junk) * n), (1, junk * n)):
                counts = np.bincount(v[:, j], weights=w, minlength=3)[:2] + spoken[j, c]
                spoken[j, c] = counts / counts.sum()
        model = LabelModel(float(np.clip((junk * n).sum() / max(n.sum(), 1), 1e-4, 0.5)), whole())
    return model


def linear(doc: np.ndarray, bucket: np.ndarray, target: np.ndarray, passes: int = 1500, penalty: float = 1e-5, step: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sets of buckets with soft targets. Buckets whose share differs between the
    classes by under four standard errors, or that few documents have, take no part."""
    pos, n = target.sum(), len(target)
    if n == 0 or pos < 1 or n - pos < 1:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 0.5) / (n - pos + 0.5)))
    p = np.bincount(bucket, weights=target[doc], minlength=BUCKETS)
    q = np.bincount(bucket, minlength=BUCKETS) - p
    share = (p + q) / n
    z = np.abs(p / pos - q / (n - pos)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / pos + 1 / (n - pos)))
    chosen = np.flatnonzero((z >= 4) & (p + q >= 5))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[bucket] >= 0
    d, b = doc[inside], place[bucket[inside]]
    w, bias = np.zeros(len(chosen)), float(np.log(pos / (n - pos)))
    square, square_bias = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(passes):
        off = 1 / (1 + np.exp(-np.clip(bias + np.bincount(d, weights=w[b], minlength=n), -30, 30))) - target
        g, gb = np.bincount(b, weights=off[d], minlength=len(w)) / n + penalty * w, off.mean()
        square += g * g
        square_bias += gb * gb
        w -= step * g / np.sqrt(square)
        bias -= step * gb / np.sqrt(square_bias)
    return chosen, w, bias


@dataclass
class Scorer:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


@dataclass
class QualityModel:
    labels: LabelModel
    junk: Scorer
    toxic: Scorer | None


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids as text, as pandas would make floats of integers beside nulls."""
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _chunks(batch: pd.DataFrame, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    size = batch["text"].str.len().cumsum() // chars
    for _, part in batch.groupby(size, sort=False):
        yield part


def vote_table(narrow: DataFrame) -> DataFrame:
    """(doc_id, pattern): the packed votes of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch):
                yield pd.DataFrame({"doc_id": part["doc_id"], "pattern": pack(votes(measures(list(part["text"]))[0]))})

    return narrow.mapInPandas(run, "doc_id string, pattern long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Votes on every document are counted by pattern (3**9 at most come back) and weighed by
    expectation-maximisation; gold labels, where `labels` has them, are one more labeller. The linear
    scorers are then fitted on at most `sample` rows with gold labels and as many without, each in the
    order of a hash, so labels never crowd out what the votes teach. Toxicity is learnt from gold labels."""
    narrow = _narrow(docs, id_col, text_col)
    gold = labels.groupBy(F.col("doc_id").cast("string").alias("l_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("l_id IS NOT NULL")
    seen = checkpoint(vote_table(narrow))
    joined = checkpoint(seen.join(gold, seen["doc_id"] == gold["l_id"], "left").select("doc_id", "pattern", F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).otherwise(2).alias("gold"), F.col("toxic")))
    patterns = joined.groupBy("pattern", "gold").agg(F.count("*").alias("n")).orderBy("pattern", "gold").toPandas()
    k = len(LABELLERS)
    all_votes = np.concatenate([unpack(patterns["pattern"].to_numpy(np.int64), k), patterns[["gold"]].to_numpy(np.int64)], 1)
    model = expectation_maximisation(all_votes, patterns["n"].to_numpy(float))

    key = F.xxhash64("doc_id")
    weak = (F.col("gold") == 2) & F.col("toxic").isNull()
    once = joined.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    picked = once.filter(~weak).orderBy(key, "doc_id").limit(sample).unionByName(once.filter(weak).orderBy(key, "doc_id").limit(sample))
    picked = checkpoint(picked.withColumnRenamed("doc_id", "p_id"))
    texts = narrow.join(F.broadcast(picked), narrow["doc_id"] == picked["p_id"]).select("doc_id", "text", "pattern", "gold", F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch):
                _, doc, bucket = measures(list(part["text"]))
                used = (bucket >= HALF) | (part["toxic"].to_numpy() >= 0)[doc]  # words teach toxicity only
                doc, bucket = doc[used], bucket[used]
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                yield part[["doc_id", "pattern", "gold", "toxic"]].assign(buckets=[bucket[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    rows = texts.mapInPandas(run, "doc_id string, pattern long, gold int, toxic int, buckets array<int>")
    got = rows.toPandas().sort_values("doc_id", ignore_index=True)
    if not len(got):
        return QualityModel(model, Scorer(np.zeros(0, np.int64), np.zeros(0), -10.0), None)
    got = got.drop_duplicates("doc_id", ignore_index=True)
    size = got["buckets"].map(len).to_numpy()
    doc, bucket = np.repeat(np.arange(len(got)), size), np.concatenate(got["buckets"].to_list()).astype(np.int64)
    v = np.concatenate([unpack(got["pattern"].to_numpy(np.int64), k), got[["gold"]].to_numpy(np.int64)], 1)
    high = bucket >= HALF
    junk = Scorer(*linear(doc[high], bucket[high], model.posterior(v)))
    known = got["toxic"].to_numpy() >= 0
    toxic = None
    if (got["toxic"] == 1).any():
        place = np.cumsum(known) - 1
        use = ~high & known[doc]
        toxic = Scorer(*linear(place[doc[use]], bucket[use], got["toxic"].to_numpy(float)[known]))
    return QualityModel(model, junk, toxic)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row per input row: the id, junk_score, toxic_score, accepted; with keep_columns all input
    columns and _accepted, which clashes with an input column of that name; accepted() does not.

    Documents score by their own text alone. Null text or text without words holds no evidence and is
    accepted; repeated rows score alike; an empty table gives no row."""
    d_junk, d_toxic = model.junk.dense(), model.toxic.dense() if model.toxic else None
    b_junk, b_toxic = model.junk.bias, model.toxic.bias if model.toxic else 0.0
    held = docs.sparkSession.sparkContext.broadcast((d_junk, d_toxic))  # BUCKETS doubles each

    def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w_junk, w_toxic = held.value
        stats, doc, bucket = measures(texts)
        p = 1 / (1 + np.exp(-np.clip(b_junk + np.bincount(doc, weights=w_junk[bucket], minlength=len(texts)), -30, 30)))
        t = np.zeros(len(texts)) if w_toxic is None else 1 / (1 + np.exp(-np.clip(b_toxic + np.bincount(doc, weights=w_toxic[bucket], minlength=len(texts)), -30, 30)))
        empty = stats[:, STATS.index("n_words")] == 0
        return np.where(empty, 0.0, p), np.where(empty, 0.0, t)

    source = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    if keep_columns:

        @F.pandas_udf("struct<junk_score double, toxic_score double>")
        def scored(text: pd.Series) -> pd.DataFrame:
            parts = [score(list(p["text"])) for p in _chunks(pd.DataFrame({"text": text}))]
            return pd.DataFrame({"junk_score": np.concatenate([p[0] for p in parts]) if parts else [], "toxic_score": np.concatenate([p[1] for p in parts]) if parts else []})

        out = source.select("row", scored("text").alias("s"))
        return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], ((F.col("s.junk_score") <= JUNK) & (F.col("s.toxic_score") <= TOXIC)).alias("_accepted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch):
                p, t = score(list(part["text"]))
                yield pd.DataFrame({"id": part["id"], "junk_score": p, "toxic_score": t, "accepted": (p <= JUNK) & (t <= TOXIC)})

    kind = docs.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    scored_ = source.select(F.col("id").cast(through), "text").mapInPandas(run, f"id {through}, junk_score double, toxic_score double, accepted boolean")
    return scored_.select(F.col("id").cast(kind).alias(id_col), "junk_score", "toxic_score", "accepted")


def accepted(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() accepts, all columns, whatever their names."""
    one = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = classify(one, model, "id", "text", keep_columns=True).filter("_accepted")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
