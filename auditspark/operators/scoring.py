"""Scores of findings against what is known: confusion, precision and recall, coverage, differences of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion(judged: DataFrame) -> DataFrame:
    """judged(expected, actual), both boolean -> one row: tp, fp, fn, tn, precision, recall, accuracy; a rate of
    nothing is null."""
    n = lambda e, a: F.coalesce(F.count_if(F.col("expected").eqNullSafe(e) & F.col("actual").eqNullSafe(a)), F.lit(0))
    r = judged.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return r.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def set_scores(expected: DataFrame, actual: DataFrame, fixtures: DataFrame) -> DataFrame:
    """expected(fixture, kind), actual(fixture, kind), fixtures(fixture) -> precision, recall and f1 of each fixture's
    set of kinds, rounded to four places. Two empty sets agree; what was found where nothing was expected has
    recall 1 and precision 0."""
    e, a = expected.distinct().withColumn("_e", F.lit(1)), actual.distinct().withColumn("_a", F.lit(1))
    both = e.join(a, ["fixture", "kind"], "full")
    sums = both.groupBy("fixture").agg(F.count("_e").alias("n_expected"), F.count("_a").alias("n_actual"), F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("tp"))
    r = fixtures.distinct().join(sums, "fixture", "left").fillna(0, ["n_expected", "n_actual", "tp"])
    precision = F.when(F.col("n_actual") > 0, F.col("tp") / F.greatest("n_actual", F.lit(1))).when(F.col("n_expected") > 0, 0.0).otherwise(1.0)
    recall = F.when(F.col("n_expected") > 0, F.col("tp") / F.greatest("n_expected", F.lit(1))).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).otherwise(0.0)
    return r.select("fixture", "n_expected", "n_actual", "tp", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("fixtures"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def score_changes(before: DataFrame, after: DataFrame, least: float = 1e-4) -> DataFrame:
    """(skill, fixture, f1 before and after, change): better, worse, same, new or gone, from two runs' scores."""
    b, a = before.select("skill", "fixture", F.col("f1").alias("f1_before")), after.select("skill", "fixture", F.col("f1").alias("f1_after"))
    d = F.col("f1_after") - F.col("f1_before")
    change = F.when(F.col("f1_before").isNull(), "new").when(F.col("f1_after").isNull(), "gone").when(d > least, "better").when(d < -least, "worse").otherwise("same")
    return b.join(a, ["skill", "fixture"], "full").withColumn("change", change)


def finding_ids(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """(finding_type, expense_id): the expense ids that findings' evidence names, by refs(finding_type, evidence_id)
    and cells(evidence_id, field, value)."""
    ids = cells.filter("field = 'expense_id'").select("evidence_id", F.col("value").alias("expense_id"))
    return refs.join(ids.hint("merge"), "evidence_id").select("finding_type", "expense_id").distinct()


def coverage(scenarios: DataFrame, found: DataFrame) -> DataFrame:
    """scenarios(scenario, finding_type, expense_id), a row for each row that a scenario plants -> for each scenario
    its rows, those found under its type, and whether any was."""
    hit = scenarios.join(found.withColumn("_hit", F.lit(1)).hint("merge"), ["finding_type", "expense_id"], "left")
    return hit.groupBy("scenario").agg(F.count("*").alias("planted"), F.count("_hit").alias("found")).withColumn("covered", F.col("found") > 0)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(tool, n): how often each tool was used in a log of JSON lines, whatever else its records hold; lines that are
    no JSON are left out."""
    from auditspark.sources.shapes import read_json_lines, text_at

    value = F.col("value")
    lines = read_json_lines(spark, path)[0].select(text_at(value, "$.type").alias("type"), text_at(value, "$.part.tool", "$.part.name", "$.tool").alias("tool"))
    return lines.filter("type = 'tool_use' AND tool IS NOT NULL").groupBy("tool").agg(F.count("*").alias("n"))
