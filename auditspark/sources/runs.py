"""Runs of procurement and of cases, published whole or not at all.

All files of a run, the manifest last, are written to a hidden folder beside its own, which then gets its name in one
step. A run that fails leaves nothing behind; one that is killed leaves the hidden folder, and no manifest where
anyone looks for one. On stores without such a step (object stores) the last file to appear is not defined."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.sources import cases, write_csv
from auditspark.sources.reports import counts, dashboard, memo_text, quality_text, run_manifest, summary_text, write_text


def publish(spark: SparkSession, folder: str, frames: dict[str, DataFrame], texts: dict[str, str], about: Callable[[list[str]], dict], copies: Callable[[str], DataFrame] | None = None) -> dict:
    """Writes frames (.csv, or JSON lines) and texts under their names, then run_manifest.json, what `about` makes of
    their names, and gives the manifest. copies(folder) may put files there first; what it gives is written as
    chain_of_custody.jsonl. A folder with anything in it is refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    store = target.getFileSystem(conf)
    if store.exists(target) and len(store.listStatus(target)):
        raise FileExistsError(f"{folder} has files in it")
    stage = f"{folder.rstrip('/').rpartition('/')[0]}/.run-{uuid.uuid4().hex}"
    staged = jvm.org.apache.hadoop.fs.Path(stage)
    try:
        if copies:
            kept = copies(f"{stage}/evidence/raw").withColumn("target", F.replace("target", F.lit(f"{stage}/"), F.lit("")))
            frames = frames | {"chain_of_custody.jsonl": kept}
        for name, df in frames.items():
            if name.endswith(".csv"):
                write_csv(df, f"{stage}/{name}")
            else:
                df.select(*sorted(df.columns)).write.mode("errorifexists").json(f"{stage}/{name}", ignoreNullFields=False)
        for name, text in texts.items():
            write_text(spark, f"{stage}/{name}", text)
        made = about(sorted([*frames, *texts, *(["evidence/raw/"] if copies else []), "run_manifest.json"]))
        write_text(spark, f"{stage}/run_manifest.json", json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n")
        if store.exists(target):
            store.delete(target, False)
        if not store.rename(staged, target):
            raise OSError(f"{stage} cannot be renamed to {folder}")
    except BaseException:
        store.delete(staged, True)
        raise
    return made


def procurement_run(spark: SparkSession, folder: str, source: str, tables: dict[str, DataFrame], bad: DataFrame, found: DataFrame, cells: DataFrame, flat: DataFrame, graph: tuple[DataFrame, DataFrame], handoff: dict | None, mappings: dict[str, dict[str, str]], notes: list[str], inputs: DataFrame, parameters: dict | None = None) -> dict:
    """The files of a procurement run: the normalised tables, bad rows(table, and others), findings, their evidence
    cells and flat view, the graph(nodes, edges), the case for investigators, reports and the manifest."""
    nodes, edges = graph
    both = nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.withColumn("kind", F.lit("edge")), allowMissingColumns=True)
    frames = {f"normalized_{name}.csv": df for name, df in tables.items()} | {"bad_rows.csv": bad, "findings.csv": flat, "findings.jsonl": found, "evidence.jsonl": cells, "relationship_graph.json": both}
    sizes = {name: df.count() for name, df in tables.items()}
    n_bad = bad.count()
    nulls = spark.createDataFrame([], "column string, rate double")
    texts = {
        "investigation_handoff.json": json.dumps(handoff or {"recommended": False}, ensure_ascii=False, indent=2, sort_keys=True) + "\n",
        "data_quality.md": quality_text(source, {f"Rows of {k}": n for k, n in sizes.items()} | {"Bad rows": n_bad}, mappings, nulls, notes),
        "summary.md": summary_text(counts(found), sum(sizes.values()), n_bad),
    }
    links = [(n, "") for n in [*frames, *texts]]
    return publish(spark, folder, frames, texts | {"dashboard.html": dashboard(source, found, files=links)}, lambda names: run_manifest("PRC", inputs, parameters or {}, mappings, notes, names))


def case_run(spark: SparkSession, folder: str, root: str, scope: dict, listed: DataFrame, derived: dict[str, DataFrame], left_out: tuple[DataFrame, DataFrame], views: dict[str, DataFrame], leads: DataFrame, cells: DataFrame, notes: list[str]) -> dict:
    """The files of a case: read-only copies of the listed evidence with the chain of custody, derived tables
    (messages, logs, text_lines), rows out of scope and rows without a time, views (timeline, entity_index,
    evidence_matrix, hypothesis_register, interview_plan as CSV; relationships as JSON lines), leads, evidence cells, the
    memo's form, reports and the manifest."""
    names = {"messages": "derived/normalized_messages.csv", "logs": "derived/normalized_logs.csv", "text_lines": "derived/text_lines.csv"}
    frames = {names[k]: df for k, df in derived.items()} | {"out_of_scope_rows.csv": left_out[0], "unparseable_rows.csv": left_out[1]}
    frames |= {f"{k}.json" if k == "relationships" else f"{k}.csv": df for k, df in views.items()}
    found = leads.withColumn("finding_type", F.lit("investigation-lead"))
    frames |= {"findings.jsonl": found, "evidence_inventory.jsonl": listed, "evidence.jsonl": cells}
    sizes = {f"Rows of {k}": df.count() for k, df in derived.items()} | {"Out of scope": left_out[0].count(), "Without a time": left_out[1].count()}
    texts = {"case_memo_template.md": memo_text(scope), "data_quality.md": quality_text(scope["case_id"], sizes, {}, spark.createDataFrame([], "column string, rate double"), notes)}
    texts["dashboard.html"] = dashboard(scope["case_id"], found, files=[(n, "") for n in [*frames, *texts]])
    inputs = listed.select(F.col("relative_path").alias("path"), "sha256")
    return publish(spark, folder, frames, texts, lambda out: run_manifest("CASE", inputs, {k: scope[k] for k in ("case_id", "purpose", "date_range", "persons_in_scope") if k in scope}, {}, notes, out), lambda at: cases.custody(listed).unionByName(cases.keep_copies(spark, root, listed, at)))
