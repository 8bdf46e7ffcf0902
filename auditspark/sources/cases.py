"""The sources of a case: its scope, messages, logs and texts, what was taken in and how it was kept."""

from __future__ import annotations

import json
import mimetypes
from datetime import date
from pathlib import Path
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import functions as fn
from auditspark.sources import file_hashes, inside, map_columns, read_delimited, read_text_lines
from auditspark.sources.tables import headers, optional_column

#: Names by which the columns of messages and logs are known, and of the time of record.
MESSAGES = {
    "message_id": ("message_id", "id", "消息编号", "邮件编号"),
    "timestamp": ("timestamp", "time", "sent_at", "时间", "发送时间"),
    "sender": ("sender", "from", "发件人", "发送人"),
    "recipient": ("recipient", "to", "收件人", "接收人"),
    "channel": ("channel", "type", "渠道", "消息类型"),
    "content": ("content", "body", "text", "内容", "聊天内容", "正文"),
}
LOGS = {
    "event_id": ("event_id", "id", "事件编号", "日志编号"),
    "timestamp": ("timestamp", "time", "event_time", "时间", "发生时间"),
    "actor": ("actor", "user", "employee_id", "用户", "员工编号", "操作人"),
    "event_type": ("event_type", "action", "操作", "事件类型"),
    "object": ("object", "resource", "file", "对象", "资源", "文件"),
    "device": ("device", "device_id", "设备", "设备编号"),
    "ip": ("ip", "ip_address", "IP", "IP地址"),
    "result": ("result", "status", "结果", "状态"),
}
OBSERVED = ("recorded_at", "observed_at", "record_time", "记录时间", "登记时间", "录入时间")
#: Parts of file names that tell what a file holds.
NAMED = {"messages": ("message", "chat", "email", "mail", "消息", "聊天", "邮件"), "logs": ("log", "event", "access", "日志", "访问")}
#: The keys that a scope may have and must have, and tiers of evidence.
SCOPE_KEYS = {
    "case_id", "purpose", "authorization_confirmed", "authorization_reference", "date_range", "persons_in_scope", "allowed_sources", "source_types",
    "assumed_timezone", "network_access", "issues", "interviewees", "holidays", "context_from_other_skill", "evidence_tiers", "deduplicate_sources",
    "hypothesis_extended",
}
SCOPE_REQUIRED = ("case_id", "purpose", "authorization_confirmed", "date_range", "persons_in_scope", "allowed_sources", "network_access")
TIERS = ("HARD", "SOFT", "LEAD", "UNSPECIFIED")


def check_case(scope: dict) -> dict:
    """The scope; raises unless it is complete, of known keys, authorised and offline. Nothing is read before."""
    unknown = sorted(set(scope) - SCOPE_KEYS)
    missing = [k for k in SCOPE_REQUIRED if k not in scope]
    if unknown or missing:
        raise ValueError(f"scope: unknown {', '.join(unknown) or 'none'}, missing {', '.join(missing) or 'none'}")
    if scope["authorization_confirmed"] is not True:
        raise PermissionError("authorization_confirmed must be true")
    if scope["network_access"] is not False:
        raise ValueError("network_access must be false")
    if not isinstance(scope["allowed_sources"], list) or not scope["allowed_sources"]:
        raise ValueError("allowed_sources must be a list with entries")
    if not isinstance(scope["persons_in_scope"], list):
        raise ValueError("persons_in_scope must be a list")
    for end in ("start", "end"):
        date.fromisoformat(scope["date_range"][end])
    odd = {k: v for k, v in (scope.get("evidence_tiers") or {}).items() if str(v).upper() not in TIERS}
    if odd:
        raise ValueError(f"evidence_tiers may be {', '.join(TIERS)}, not {odd}")
    return scope


def read_scope(path: str) -> dict:
    return check_case(json.loads(Path(path).read_text(encoding="utf-8-sig")))


def source_type(name: str, scope: dict | None = None) -> str:
    """messages, logs, text or unrecognized: as the scope says, else by the file's name."""
    said = (scope or {}).get("source_types", {}).get(name)
    if said:
        return said.strip().lower()
    low = Path(name).name.lower()
    return next((kind for kind, parts in NAMED.items() if any(p in low for p in parts)), "text" if Path(name).suffix.lower() in (".txt", ".md") else "unrecognized")


def timezone_health(zone: str = "UTC") -> dict:
    """Whether times without an offset can be read in the assumed zone."""
    try:
        ZoneInfo(zone)
        return {"assumed_timezone": zone, "available": True}
    except (ZoneInfoNotFoundError, ValueError) as e:
        return {"assumed_timezone": zone, "available": False, "error": str(e)}


def in_case(rows: DataFrame, actors: list[str], scope: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, outside, unreadable): rows by the date that their time has where it was taken, and by their actors,
    of which one must be in scope if the scope names any. Outside rows have a reason, unreadable ones a warning."""
    zone = scope.get("assumed_timezone", "UTC")
    at, warning = fn.instant(F.col("timestamp"), zone)
    iso = F.to_date(F.substring("timestamp", 1, 10), "yyyy-MM-dd")  # the row's own day, whatever its offset
    r = rows.withColumn("at", at).withColumn("warning", F.when(F.col("timestamp").isNull(), "no time").otherwise(warning))
    start, end = scope["date_range"]["start"], scope["date_range"]["end"]
    day = F.coalesce(F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}"), iso), F.to_date("at"))
    persons = [p.strip() for p in scope["persons_in_scope"] if p and p.strip()]
    known = F.lit(not persons)
    for a in actors:
        known = known | F.coalesce(F.col(a).isin(*(persons or [""])), F.lit(False))
    reason = F.when(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "outside the dates").when(~known, "outside the persons")
    dated = r.filter("at IS NOT NULL").withColumn("reason", reason)
    return dated.filter("reason IS NULL").drop("reason"), dated.filter("reason IS NOT NULL").withColumn("scope_status", F.lit("out_of_scope")), r.filter("at IS NULL")


def _read(spark: SparkSession, root: str, name: str, columns: dict, required: tuple[str, ...]) -> DataFrame:
    raw = read_delimited(spark, inside(root, name))
    mapping, _ = map_columns(headers(raw), columns, None, required)
    seen = optional_column(headers(raw), OBSERVED)
    cells = [(fn.norm_text(F.col(f"`{mapping[c]}`")) if c in mapping else F.lit(None).cast("string")).alias(c) for c in columns]
    observed = (fn.norm_text(F.col(f"`{seen}`")) if seen else F.lit(None).cast("string")).alias("observed_at")
    return raw.select(F.lit(name).alias("source_file"), F.col("_src_row").alias("source_row"), *cells, observed)


def read_messages(spark: SparkSession, root: str, name: str, scope: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, outside, unreadable) messages of a file below root."""
    return in_case(_read(spark, root, name, MESSAGES, ("message_id", "timestamp", "sender", "content")), ["sender", "recipient"], scope)


def read_logs(spark: SparkSession, root: str, name: str, scope: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, outside, unreadable) log events of a file below root."""
    return in_case(_read(spark, root, name, LOGS, ("event_id", "timestamp", "actor", "event_type")), ["actor"], scope)


def read_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(source_file, source_row, content) of a text's lines that are not blank."""
    return read_text_lines(spark, inside(root, name)).select(F.lit(name).alias("source_file"), F.col("line").alias("source_row"), fn.norm_text(F.col("text")).alias("content"))


def inventory(spark: SparkSession, root: str, scope: dict) -> DataFrame:
    """(evidence_id, relative_path, sha256, size_bytes, mime_type, source_type) of the allowed sources, in their
    order; a source that is not there, or not below root, raises."""
    names = [n.replace("\\", "/") for n in scope["allowed_sources"]]
    for n in names:
        if Path(n).is_absolute() or not Path(inside(root, n)).is_file():
            raise FileNotFoundError(f"{n}: no file below {root}")
    about = spark.createDataFrame([(i + 1, n, mimetypes.guess_type(n)[0] or "application/octet-stream", source_type(n, scope), Path(inside(root, n)).as_uri()) for i, n in enumerate(names)], "no long, relative_path string, mime_type string, source_type string, uri string")
    hashes = file_hashes(spark, [inside(root, n) for n in names]).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "sha256", F.col("length").alias("size_bytes"))
    return about.join(hashes, "uri").select(F.format_string("EV-%06d", "no").alias("evidence_id"), "relative_path", "sha256", "size_bytes", "mime_type", "source_type")


def custody(listed: DataFrame, event: str = "registered", target: str | None = None) -> DataFrame:
    """(timestamp, event, evidence_id, source, target, sha256): a line of the chain of custody for each file; where
    copies are made, below the folder `target`."""
    to = F.concat(F.lit(target.rstrip("/") + "/"), "relative_path") if target else F.lit(None).cast("string")
    return listed.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(event).alias("event"), "evidence_id", F.col("relative_path").alias("source"), to.alias("target"), "sha256")


def keep_copies(spark: SparkSession, root: str, listed: DataFrame, folder: str) -> DataFrame:
    """Copies the listed files below folder, read-only, and gives the custody lines of the verified copies; a copy
    whose hash differs raises. The files of a case are a short list."""
    import shutil

    wanted = {r["relative_path"]: r["sha256"] for r in listed.collect()}
    for name in wanted:
        to = Path(inside(folder, name))
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(inside(root, name), to)
        to.chmod(to.stat().st_mode & ~0o222)
    copies = {r["path"]: r["sha256"] for r in file_hashes(spark, [inside(folder, n) for n in wanted]).collect()}
    if sorted(copies.values()) != sorted(wanted.values()):
        raise OSError("a copy differs from its source")
    return custody(listed, "copied_and_verified", folder)
