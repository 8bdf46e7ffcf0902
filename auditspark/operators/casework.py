"""Investigation operators: scope, timeline, entities, and the matrix of issues and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.functions import contains_any, emails, instant
from auditspark.plans import priority

REQUIRED = ("case_id", "objective", "start_date", "end_date", "sources", "persons", "issues")
#: Tiers of evidence, the best first.
TIERS = ("HARD", "SOFT", "LEAD", "UNSPECIFIED")


def check_scope(scope: dict) -> None:
    """Raises unless the case is authorised, offline and complete; nothing is read before."""
    missing = [k for k in REQUIRED if not scope.get(k)]
    if missing:
        raise ValueError(f"scope lacks {', '.join(missing)}")
    if scope.get("authorization_confirmed") is not True:
        raise ValueError("authorization_confirmed must be true")
    if scope.get("network_access") is not False:
        raise ValueError("network_access must be false")


def in_scope(rows: DataFrame, at: str, actors: F.Column, scope: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, outside, unreadable): rows by the date of their time, in the assumed zone, and their actors.
    Outside rows say why."""
    when, warning = instant(F.col(at), scope.get("assumed_timezone", "UTC"))
    r = rows.withColumn("at", when).withColumn("time_warning", warning)
    dated = r.filter("at IS NOT NULL")
    early = ~F.to_date("at").between(F.lit(scope["start_date"]).cast("date"), F.lit(scope["end_date"]).cast("date"))
    people = F.array(*[F.lit(x.lower()) for x in scope["persons"]])
    other = ~F.arrays_overlap(F.transform(actors, lambda x: F.lower(F.trim(x))), people)
    reasons = F.array_compact(F.array(F.when(early, "outside the dates"), F.when(other, "outside the persons")))
    dated = dated.withColumn("reasons", reasons)
    return dated.filter(F.size("reasons") == 0).drop("reasons"), dated.filter(F.size("reasons") > 0), r.filter("at IS NULL")


def timeline(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Messages(message_id, at, sender, content) and logs(event_id, at, actor, event_type, object) in one order of
    time; texts are cut to 120 characters. If either side has observed_at, the time of record, it stands beside."""
    both = "observed_at" in messages.columns or "observed_at" in logs.columns
    seen = lambda df: [F.col("observed_at") if "observed_at" in df.columns else F.lit(None).cast("string").alias("observed_at")] if both else []
    m = messages.select("at", *seen(messages), F.lit("message").alias("kind"), F.col("message_id").cast("string").alias("source_id"), F.col("sender").cast("string").alias("actor"), F.substring("content", 1, 120).alias("object"))
    e = logs.select("at", *seen(logs), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("source_id"), F.col("actor").cast("string").alias("actor"), F.substring("object", 1, 120).alias("object"))
    return m.unionByName(e).orderBy("at", "kind", "source_id")


def entities_and_relations(messages: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities(kind, value), relations(source, target, type)): persons, emails in messages, devices and
    documents of logs; messaged, used_device and acted_on."""
    e = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")).filter("value IS NOT NULL AND value <> ''")
    mails = messages.select(F.explode(emails(F.col("content"))).alias("mail"))
    ents = e(messages, "person", "sender").unionByName(e(messages, "person", "recipient")).unionByName(e(logs, "person", "actor")).unionByName(e(mails, "email", "mail")).unionByName(e(logs, "device", "device")).unionByName(e(logs, "document", "object"))
    r = lambda df, a, b, kind: df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("type")).filter("source IS NOT NULL AND target IS NOT NULL")
    rels = r(messages, "sender", "recipient", "messaged").unionByName(r(logs, "actor", "device", "used_device")).unionByName(r(logs, "actor", "object", "acted_on"))
    return ents.distinct(), rels.distinct()


def issue_matrix(corpus: DataFrame, issues: list[dict]) -> DataFrame:
    """(issue, side, evidence_id, source_file, tier): the corpus(evidence_id, text, source_file, tier) rows that
    hold a keyword of an issue (supports) or of its contradiction. The issues are a short list of the
    scope, so each is a column expression; the texts are read once."""
    low = F.col("text")
    cells = [F.when(contains_any(low, i.get(k, [])), F.struct(F.lit(i["id"]).alias("issue"), F.lit(side).alias("side"))) for i in issues for k, side in (("keywords", "supports"), ("contradiction_keywords", "contradicts")) if i.get(k)]
    have = {c for c in ("source_file", "tier") if c in corpus.columns}
    out = corpus.withColumn("_hit", F.explode(F.array_compact(F.array(*cells))))
    return out.select("_hit.issue", "_hit.side", "evidence_id", *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("source_file", "tier")])


def hypotheses(matrix: DataFrame, issues: list[dict], extended: bool = False) -> DataFrame:
    """One row per issue with counts of supports and contradictions, best tier and independent sources; with
    `extended` one more for each alternative, sides swapped."""
    spark = matrix.sparkSession
    rank = F.coalesce(*[F.when(F.upper("tier") == t, i) for i, t in enumerate(TIERS)], F.lit(len(TIERS) - 1))
    sums = matrix.groupBy("issue").agg(F.sum((F.col("side") == "supports").cast("long")).alias("supports"), F.sum((F.col("side") == "contradicts").cast("long")).alias("contradicts"), F.min(rank).alias("_tier"), F.countDistinct("source_file").alias("sources"))
    rows = [(i["id"], i.get("hypothesis", i["id"]), False) for i in issues]
    if extended:
        rows += [(i["id"], a, True) for i in issues for a in i.get("alternatives", [])]
    base = spark.createDataFrame(rows, "issue string, hypothesis string, alternative boolean")
    j = base.join(sums, "issue", "left").fillna(0, ["supports", "contradicts", "sources"])
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.coalesce(F.col("_tier"), F.lit(len(TIERS) - 1)) + 1)
    swap = F.col("alternative")
    return j.select("issue", "hypothesis", "alternative", F.when(swap, F.col("contradicts")).otherwise(F.col("supports")).alias("supports"), F.when(swap, F.col("supports")).otherwise(F.col("contradicts")).alias("contradicts"), tier.alias("best_tier"), "sources")


def leads(matrix: DataFrame, issues: list[dict]) -> DataFrame:
    """investigation-lead findings of issues with evidence: scored by the issue's priority (low 1, medium 2,
    high 4, critical 6), moderate from two references on."""
    points = {"low": 1, "medium": 2, "high": 4, "critical": 6}
    score = F.coalesce(*[F.when(F.col("issue") == i["id"], points.get(i.get("priority", "medium"), 2)) for i in issues])
    refs = matrix.groupBy("issue").agg(F.countDistinct("evidence_id").alias("n_refs"))
    order = Window.orderBy("issue")
    return refs.withColumn("risk_score", score).withColumn("risk_priority", priority(score)).withColumn("evidence_strength", F.when(F.col("n_refs") >= 2, "moderate").otherwise("weak")).withColumn("finding_id", F.format_string("INV-%06d", F.row_number().over(order)))


def interview_plan(matrix: DataFrame, corpus: DataFrame) -> DataFrame:
    """(actor, summaries, issues): at most eight distinct summaries by actor, the first by evidence id."""
    j = matrix.select("issue", "evidence_id").join(corpus.select("evidence_id", "actor", F.substring("text", 1, 120).alias("summary")), "evidence_id").filter("actor IS NOT NULL")
    by = Window.partitionBy("actor").orderBy("_first", "summary")
    each = j.groupBy("actor", "summary").agg(F.min("evidence_id").alias("_first"), F.collect_set("issue").alias("_issues"))
    top = each.withColumn("_rn", F.row_number().over(by)).filter("_rn <= 8")
    return top.groupBy("actor").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "summary"))), lambda x: x["summary"]).alias("summaries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_issues")))).alias("issues"))


def interviews(plan: DataFrame, interviewees: list[dict], issues: list[dict]) -> DataFrame:
    """A row for each interviewee of the scope: objective, known facts from interview_plan(), and what is missing in
    all issues together. Both lists are short."""
    missing = list(dict.fromkeys(x for i in issues for x in i.get("missing_evidence", []) if x))
    spark = plan.sparkSession
    asked = spark.createDataFrame([(i["id"], i.get("objective", ""), missing) for i in interviewees], "interviewee string, objective string, unknown_facts array<string>")
    known = plan.select(F.col("actor").alias("interviewee"), F.col("summaries").alias("known_facts"))
    return asked.join(known, "interviewee", "left").select("interviewee", "objective", F.coalesce("known_facts", F.array().cast("array<string>")).alias("known_facts"), "unknown_facts")
