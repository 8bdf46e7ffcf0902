"""Approximate nearest neighbours with learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

K = 10
#: The index is fitted on about SAMPLE vectors at most; all are indexed. The neighbour graph, of LINKS links a
#: vector, has a partition for every ROWS rows of the table, PARTITIONS at most, as each needs 20 vectors of
#: the sample; as many are searched as the sample needs for the recall RECALL.
SAMPLE, ROWS, PARTITIONS, LINKS, RECALL = 8_000, 2_048, 256, 10, 0.97
#: Vectors of another length than most stand in so many partitions by their length, each searched whole.
OTHER = 64
#: Rows of a partition, and queries, that meet in one task.
BLOCK, QUERIES = 8_192, 20_000
HIDDEN, PASSES = 128, 30


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by a matrix product: near, not exact."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(query: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    d = distances(query, rows)
    if own is not None:
        d[np.arange(len(query)), own] = np.inf
    k = min(k, d.shape[1] - (own is not None))
    return np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(query), 0), np.int64)


def balanced_parts(x: np.ndarray, links: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 15, slack: float = 1.05) -> np.ndarray:
    """A partition of the neighbour graph into parts of nearly one size that cuts few links: halving
    along the widest direction, then sweeps in which vertices move to the part that most of their
    neighbours are in, the most gainful first, as long as there is room."""
    n = len(x)
    part = np.zeros(n, np.int64)
    for bit in range(int(np.log2(parts))):
        for p in range(1 << bit):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                centred = x[at] - x[at].mean(0)
                axis = rng.normal(size=x.shape[1])
                for _ in range(8):
                    axis = centred.T @ (centred @ axis)
                    axis /= max(np.linalg.norm(axis), 1e-30)
                order = at[np.argsort(centred @ axis, kind="stable")]
                part[order[len(order) // 2 :]] = p + (1 << bit)
    cap = int(np.ceil(n / parts * slack))
    a, b = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        np.add.at(votes, (a, part[b]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < cap and rng.random() < 0.7:  # else neighbours swap sides for ever
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer: probabilities of the partitions for vectors scaled to mean 0 and spread 1."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    searched: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Fits the classifier to target shares of partitions by Adam on mini-batches."""
    n, d = x.shape
    mean, scale = x.mean(0), max(float(x.std()), 1e-12)
    parts = target.shape[1]
    weights = [rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = (x - mean) / scale
    for _ in range(PASSES):
        for at in np.array_split(rng.permutation(n), max(1, n // 256)):
            hidden = z[at] @ weights[0] + weights[1]
            live = np.maximum(hidden, 0)
            logits = live @ weights[2] + weights[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            off = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
            back = (off @ weights[2].T) * (hidden > 0)
            t += 1
            for k, g in enumerate((z[at].T @ back, back.sum(0), live.T @ off, off.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= 2e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *weights)


def fit(sample: np.ndarray, parts: int = PARTITIONS, recall: float = RECALL, seed: int = 7) -> Router:
    """Learns the partitions from a bounded sample: its neighbour graph, a balanced partition of it, a
    classifier of vectors by the partitions of their neighbours. A tenth of the sample, unseen in
    training, then tells how many of the most probable partitions hold the wanted recall of its
    neighbours. A sample too small for partitions gets one."""
    x = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    n = len(x)
    while parts > 1 and n < 20 * parts:
        parts //= 2
    if parts <= 1 or n < 40:
        d = sample.shape[1] if sample.ndim == 2 else 1
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    links = np.concatenate([nearest(x[a : a + 1000], x, LINKS, np.arange(a, min(a + 1000, n))) for a in range(0, n, 1000)])
    part = balanced_parts(x, links, parts, rng)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), links.shape[1]), part[links.ravel()]), 1.0)
    target[np.arange(n), part] += links.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    tests = min(n // 10, 500)
    router = train_router(x[tests:], target[tests:], rng)
    of_row = router.scores(x).argmax(1)
    order = np.argsort(-router.scores(x[:tests]), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    found = np.take_along_axis(place, of_row[links[:tests]], 1)
    for m in range(1, parts + 1):
        router.searched = m
        if (found < m).mean() >= recall:
            break
    return router


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part: not null, not zero, every component finite, in double
    precision."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    return rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))


def partitions(rows: int) -> int:
    """A power of two: one partition for every ROWS rows, within bounds."""
    return min(PARTITIONS, 1 << max(0, (rows - 1) // ROWS).bit_length())


def search(df: DataFrame, queries: F.Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The k nearest found to every row that `queries` (over vec_id) selects, among all other rows:
    query_id, rank, vec_id, score (Euclidean distance, exact), nearest first, ties to smaller ids.

    Vectors null, zero, or with null or non-finite components, and rows without an id, take no part. Vectors
    of different lengths have no distance: each is compared with those of its own length, all of them if
    its length is not the most frequent one. Rows of the query's own id are no candidates; other rows with
    the same id each are. A query searches as many partitions as the index asks for, and more until they
    hold k rows; with fewer candidates than k all are returned; an empty table gives no row. Partitions are
    dealt over blocks of at most about BLOCK rows, however many equal vectors one holds, and the queries of
    a partition over groups of about QUERIES, so that neither fills a task."""
    spark = df.sparkSession
    rows = valid(df, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    d, n = common["d"], common["count"]
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    drawn = rows.filter((F.size("vec") == d) & (place < int((1 << 30) * min(1.0, 1.1 * sample / n)))).orderBy(place, "vec_id").limit(sample).select("vec").toArrow()
    router = fit(drawn["vec"].combine_chunks().flatten().to_numpy().reshape(-1, d), partitions(n))
    parts = len(router.b2)

    def routed(batches: Iterator[pd.DataFrame], searched: int, held: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["vec"].map(len).to_numpy()
            rest = batch[size != d]
            if len(rest):
                yield pd.DataFrame({"part": (PARTITIONS + size[size != d] % OTHER).astype(np.int32), "vec_id": rest["vec_id"], "vec": rest["vec"]})
            batch = batch[size == d]
            if not len(batch):
                continue
            order = np.argsort(-router.scores(np.stack(batch["vec"].to_numpy())), axis=1, kind="stable")
            many = np.full(len(batch), min(searched, parts))
            if held is not None:  # at least k rows besides the query's own
                many = np.maximum(many, np.minimum((np.cumsum(held[order], axis=1) <= k).sum(1) + 1, parts))
            at, upto = np.repeat(np.arange(len(batch)), many), np.arange(order.shape[1])[None] < many[:, None]
            yield pd.DataFrame({"part": order[upto].astype(np.int32), "vec_id": batch["vec_id"].to_numpy()[at], "vec": batch["vec"].to_numpy()[at]})

    schema = f"part int, vec_id {kind}, vec array<double>"
    placed = rows.mapInPandas(lambda b: routed(b, 1), schema)
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    held = np.zeros(parts, np.int64)
    for r in sizes.filter(F.col("part") < PARTITIONS).collect():
        held[r["part"]] = r["rows"]
    asked = rows.filter(queries).mapInPandas(lambda b: routed(b, router.searched, held), schema)
    # One row a partition: PARTITIONS + OTHER at most.
    deal = sizes.join(asked.groupBy("part").agg(F.count("*").alias("asked")), "part").select(F.col("part").alias("of"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("groups"))
    deal = F.broadcast(checkpoint(deal))
    own = lambda salt, n_: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n_)).cast("int")
    every = lambda n_: F.explode(F.sequence(F.lit(0), F.col(n_) - 1))
    placed = placed.join(deal, F.col("part") == F.col("of")).withColumn("block", own(1, "blocks")).withColumn("group", every("groups"))
    asked = asked.join(deal, F.col("part") == F.col("of")).withColumn("group", own(2, "groups")).withColumn("block", every("blocks")).select("part", "block", "group", "vec_id", "vec")
    placed = placed.select(*[F.col(c).alias(f"r_{c}") for c in ("part", "block", "group", "vec_id", "vec")])

    def nearest_of(q: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple]:
        x, ids = np.stack(r["r_vec"].to_numpy()), r["r_vec_id"].to_numpy()
        for a in range(0, len(q), 256):
            y, own_ = np.stack(q["vec"].iloc[a : a + 256].to_numpy()), q["vec_id"].iloc[a : a + 256].to_numpy()
            far = distances(y, x)
            far[own_[:, None] == ids[None]] = np.inf
            limit = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
            for i in range(len(y)):
                # The product's error is far below this margin, so all ties are among the reranked.
                at = np.flatnonzero((far[i] <= limit[i] + 1e-9 * (1 + limit[i] + (y[i] ** 2).sum())) & np.isfinite(far[i]))
                exact = np.sqrt(((x[at] - y[i]) ** 2).sum(1))
                yield from ((own_[i], ids[at[j]], exact[j]) for j in np.lexsort((ids[at], exact))[:k])

    def found(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        q_size, r_size = q["vec"].map(len), r["r_vec"].map(len)
        out = [x for s in sorted(set(q_size) & set(r_size)) for x in nearest_of(q[q_size == s], r[r_size == s])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = asked.groupBy("part", "block", "group").cogroup(placed.groupBy("r_part", "r_block", "r_group")).applyInPandas(found, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
