"""Mixing sources to target weights by entropy balancing. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, salted_rank, sieved, table

CAP = 3
ROUNDS, STEP = 100, 8.0
TOLERANCE = 1e-9


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """sources(source, source_size) -> (source, sid, source_size, target).

    Sources by code point, null last, weigh as `weights` repeats; all sizes are shared by weight, no
    target above cap times its source's size, the excess reshared among the rest. That water level
    has a closed form: with sources by rising cap / weight, a source is full while its level does not
    exceed what is left for the sources from it on. One row per source reaches the global windows."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(n)) + 1).cast("int")).cast("double"))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "sid")
    prior = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(prior), F.lit(0.0))).withColumn("_weights", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("_w") * F.col("_left"))
    full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0.0)).over(everything)
    w = w.withColumn("_level", (F.sum("source_size").over(everything) - full("_cap")) / F.nullif(F.sum("_w").over(everything) - full("_w"), F.lit(0.0)))
    return w.select("source", "sid", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level")).alias("target"))


def solve(hist: DataFrame, goals: DataFrame, tilt: str = "size", cap: float = CAP) -> DataFrame:
    """hist(sid, size, n), goals(sid, source_size, target) -> (sid, dual).

    The mix minimises the relative entropy of the taken words against one copy of everything, each
    rate in (0, cap), subject to sum(rate * size) = target in every source. Its dual is convex, one
    multiplier a source, and gives rate = cap * logistic(dual * x - log(cap - 1)): an exponential
    tilt exp(dual * x), saturating at the cap. x is size / mean size for tilt "size" (entropy over
    documents), or 1 for "mass" (entropy over words, rates within a source alike). Each Newton step is one
    distributed aggregation over the histogram; as the taken words grow with the multiplier, the values
    tried so far bracket it, and a step that leaves the bracket halves it instead. Raises if ROUNDS steps
    do not reach the targets."""
    data = hist.join(goals.select("sid", "target", "source_size"), "sid").filter((F.col("size") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12))))
    mean = Window.partitionBy("sid")
    x = F.lit(1.0) if tilt == "mass" else F.col("size") / (F.sum(F.col("size") * F.col("n")).over(mean) / F.sum("n").over(mean))
    data = checkpoint(data.withColumn("x", x))
    dual = data.select("sid").distinct().select("sid", F.lit(0.0).alias("dual"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    for _ in range(ROUNDS):
        share = 1 / (1 + F.exp(F.lit(math.log(cap - 1)) - F.col("dual") * F.col("x")))
        words = F.col("size") * F.col("n") * cap
        step = data.join(dual, "sid").groupBy("sid", "dual", "low", "high").agg(F.sum(words * share).alias("_got"), F.sum(words * share * (1 - share) * F.col("x")).alias("_slope"), F.first("target").alias("_t"))
        step = step.withColumn("low", F.when(F.col("_got") < F.col("_t"), F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("_got") > F.col("_t"), F.col("dual")).otherwise(F.col("high")))
        moved = F.col("dual") + F.greatest(F.lit(-STEP), F.least(F.lit(STEP), (F.col("_t") - F.col("_got")) / F.greatest(F.col("_slope"), F.lit(1e-300))))
        inside = (moved > F.col("low")) & (moved < F.col("high"))
        off = F.abs(F.col("_got") - F.col("_t")) / F.greatest(F.col("_t"), F.lit(1.0))
        next_ = F.when(off < TOLERANCE, F.col("dual")).when(inside, moved).otherwise((F.col("low") + F.col("high")) / 2)
        step = checkpoint(step.select("sid", next_.alias("dual"), "low", "high", off.alias("_off")))
        dual = step.drop("_off")
        worst = step.agg(F.max("_off")).first()[0]
        if worst is None or worst < TOLERANCE:
            return dual.select("sid", "dual")
    raise RuntimeError(f"the mix missed a target by a share of {worst} after {ROUNDS} steps")


def rounded(hist: DataFrame, cap: int = CAP) -> DataFrame:
    """hist(sid, size, n, rate, target) -> (sid, size, n, copies): whole copies for each class of equally
    long documents of a source. Running sums of the fractional copies, longest documents first, are
    rounded, which leaves at most half of the longest document over or short; four passes then
    give that rest, as far as it fits, to the longest classes that are not longer than it."""
    by_size = Window.partitionBy("sid").orderBy(F.col("size").desc())
    upto, prior, everything = by_size.rowsBetween(Window.unboundedPreceding, 0), by_size.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("sid")
    want = F.col("rate") * F.col("n")
    h = hist.withColumn("copies", F.floor(F.sum(want).over(upto) + 0.5) - F.floor(F.coalesce(F.sum(want).over(prior), F.lit(0.0)) + 0.5))
    most = F.col("n") * cap
    h = h.withColumn("copies", F.greatest(F.lit(0), F.least(most, F.col("copies").cast("long"))))
    for _ in range(4):
        h = h.withColumn("_rest", F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(everything)))
        room = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("_rest")), F.when(F.col("_rest") > 0, most - F.col("copies")).otherwise(F.col("copies"))).otherwise(0)
        h = h.withColumn("_room", room)
        h = h.withColumn("_used", F.coalesce(F.sum(F.col("_room") * F.col("size")).over(prior), F.lit(0)))
        fit = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor((F.abs("_rest") - F.col("_used")) / F.greatest(F.col("size"), F.lit(1))).cast("long")))
        h = h.withColumn("copies", F.col("copies") + F.when(F.col("_rest") > 0, fit).otherwise(-fit))
    return h.select("sid", "size", "n", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, tilt: str = "size", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken = copies * size, rate.

    Only the three named columns are read, so other columns may have any name. Null text counts 0
    words and takes nothing; null sources form one source, the last. Rows that repeat, ids included,
    are documents of their own. Documents of one source and length have one rate; which of them gets
    the odd copy follows a hash of the id, so reruns agree. An empty table gives no row. No source is
    brought to one task: classes of (source, length) are counted before any shuffle, and the windows
    run over these classes or over salted ranks."""
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    hist = checkpoint(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = checkpoint(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))
    a, b = hist.alias("a"), goals.alias("b")
    classes = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.sid", "a.source", "a.size", "a.n", "b.source_size", "b.target")
    dual = solve(classes.select("sid", "size", "n"), goals, tilt, cap)
    mean = F.lit(1.0) if tilt == "mass" else F.col("size") / (F.col("source_size") / F.sum(F.when(F.col("size") > 0, F.col("n"))).over(Window.partitionBy("sid")))
    rate = F.when(F.col("dual").isNull(), F.lit(float(cap))).otherwise(cap / (1 + (cap - 1) * F.exp(-F.col("dual") * mean)))
    rated = classes.join(dual, "sid", "left").withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(rate))
    whole = rounded(rated.select("sid", "size", "n", "rate", "target"), cap)
    plan = checkpoint(rated.select("sid", "source", "size", "source_size", "target", "rate").join(whole, ["sid", "size"]).drop("sid"))
    ranked = salted_rank(sized, ["source", "size"], ["doc_id"]).alias("r")
    p = plan.alias("p")
    copies = F.floor(F.col("p.copies") / F.col("p.n")) + F.when(F.col("r.rank") < F.col("p.copies") % F.col("p.n"), 1).otherwise(0)
    out = ranked.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")))
    return out.select("r.doc_id", "r.size", "p.source_size", F.col("p.target").cast("double").alias("target"), copies.cast("long").alias("copies"), "p.rate").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, tilt: str = "size", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them; rows without words, of which there
    is nothing to take, once. Nulls count as in mix(). Rows that are equal in id, text and source share their
    copies, so one of them may stay for all; an empty table gives no row."""
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull(), F.col(source_col), F.col(source_col).isNull())
    keyed = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    source = docs.select(key.alias("key"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    plan = mix(source, weights, cap, tilt, "key", "text", "source")
    times = F.when(F.max("size") == 0, F.count("*")).otherwise(F.sum("copies"))
    plan = checkpoint(plan.groupBy("doc_id").agg(times.alias("times"), F.count("*").alias("rows")))
    once = keyed.join(plan.filter("rows = 1 AND times > 0"), keyed["key"] == plan["doc_id"]).select("row", "times")
    # Rows that repeat are few keys; one row of each stands for them.
    shared = plan.filter("rows > 1 AND times > 0").select("doc_id", "times")
    again = sieved(keyed.select("key", "row"), "key", shared.select(F.col("doc_id").alias("key"))).filter("maybe")
    again = again.join(shared, again["key"] == shared["doc_id"]).dropDuplicates(["key"]).select("row", "times")
    out = once.unionByName(again).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
