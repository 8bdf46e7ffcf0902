"""Suffix-array dedup: long strings of bytes, or of words, that occur elsewhere, by column-wise construction
over the collection of places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, as_bytes, checkpoint, mix, sieved, table, word_bounds

LENGTH = 400
#: Anchors are grams of this many bytes, the least by hash among all in LENGTH bytes.
GRAM = 100
#: The same for strings of words.
WORD_GRAM = 10
#: Different segments of one anchor that one task takes; an anchor with more is split by content.
HOT, SUB = 20_000, 16
#: Segments a task takes together.
COLLECTION = 20_000
#: No byte of UTF-8 text; stands before the first and behind the last byte of a segment.
NONE = 0xFF


class Unit(NamedTuple):
    """What repeats: strings of `length` symbols, which meet by grams of `gram`; a symbol is a byte, or 64 bits of
    a word's hash. Words are told apart by their bytes; the white space between them is not looked at."""

    length: int
    gram: int
    words: bool = False

    def symbols(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(as_bytes(text), np.uint8)
        return Rolling(data).spans(*word_bounds(data)) if self.words else data

    def least_bytes(self) -> int:
        """A text of fewer bytes holds no such string."""
        return 2 * self.length - 1 if self.words else self.length


def anchors(texts: list[np.ndarray], length: int, gram: int) -> pd.DataFrame:
    """Every window of `length` symbols belongs to its least gram, the leftmost of equal ones, so equal
    windows belong to equal grams at the same distance. Rows (i, anchor, p, lo, hi, seg): the windows
    of text i that start in lo..hi belong to the gram at p; anchor and seg are hashes of the gram and
    of the symbols lo..hi + length with the place of p in them."""
    data = np.concatenate([np.zeros(0, np.uint8), *texts])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    columns = ["i", "anchor", "p", "lo", "hi", "seg"]
    if len(data) < length:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    value = rolling.spans(at, at + gram)
    place, best, reach = at.astype(np.int32), value, 1
    span = length - gram + 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[:-step], best[step:]
        place = np.where(left <= right, place[:-step], place[step:])
        best = np.minimum(left, right)
        reach += step
    n = np.maximum(size - length + 1, 0)
    i = np.repeat(np.arange(len(texts)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[i]
    p = place[start].astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    i, p, lo, hi = i[first], p[first], start[first], start[last]
    seg = mix(rolling.spans(lo, hi + length) ^ mix((p - lo).astype(U64)))
    return pd.DataFrame({"i": i, "anchor": value[p].view(np.int64), "p": p - begin[i], "lo": lo - begin[i], "hi": hi - begin[i], "seg": seg.view(np.int64)})


def slices(batch: pd.DataFrame, chars: int = 500_000) -> Iterator[pd.DataFrame]:
    for _, part in batch.groupby(batch["text"].str.len().cumsum() // chars, sort=False):
        yield part


def occurrences(rows: DataFrame, units: list[Unit]) -> DataFrame:
    """rows(rid, text) -> (rid, anchor, p, lo, hi, seg). The lowest bit of an anchor is the number of its unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                for k, unit in enumerate(units):
                    out = anchors([unit.symbols(t) for t in part["text"]], unit.length, unit.gram)
                    yield out.assign(rid=part["rid"].to_numpy()[out["i"]], anchor=out["anchor"] & ~1 | k)[["rid", "anchor", "p", "lo", "hi", "seg"]]

    return rows.mapInPandas(run, "rid long, anchor long, p int, lo int, hi int, seg long")


def columnwise(texts: list[bytes], centre: np.ndarray, length: int, words: bool = False) -> list[np.ndarray]:
    """For each segment, given with the offset of its gram, the starts (offsets in it) of windows of
    `length` symbols that occur in another segment of the collection at the same distance from the gram.

    Segments are lined up at their grams and read column by column from the right; every round puts one
    more symbol before each. The round's column is the collection's Burrows-Wheeler transform in the
    order of the suffixes behind it; a stable sort by it gives the order of the longer suffixes. The
    common prefix of two neighbours with one symbol is one more than the least between their old
    places, else 0. Runs with common prefixes of `length` are equal windows."""
    n = len(texts)
    flat, none = np.frombuffer(b"".join(texts), U64 if words else np.uint8), -1 if words else NONE
    size = np.fromiter(map(len, texts), np.int64, n) // flat.itemsize
    if words:
        flat = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    left, right = int(centre.max()), int((size - centre).max())
    columns = np.full((left + right, n), none, flat.dtype)
    for k, end in enumerate(np.cumsum(size).tolist()):
        columns[left - centre[k] : left - centre[k] + size[k], k] = flat[end - size[k] : end]
    order, common = np.arange(n, dtype=np.int32), np.zeros(n + 1, np.int16)
    found: list[list[int]] = [[] for _ in range(n)]
    for c in range(left + right - 1, -1, -1):
        transform = columns[c][order]
        moved = np.argsort(transform, kind="stable")
        symbol = transform[moved]
        between = np.minimum.reduceat(common, moved + 1)
        common = np.zeros(n + 1, np.int16)
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != none)
        common[1:n] = np.where(same, np.minimum(between[:-1], length - 1) + 1, 0)
        order = order[moved]
        if c <= left:
            full = common >= length
            if full.any():
                for k in order[full[:n] | full[1:]].tolist():
                    found[k].append(c - left + int(centre[k]))
    return [np.array(f[::-1], np.int64) for f in found]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], breaks + 1])], starts[np.append(breaks, len(starts) - 1)]


def with_text(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(rid, text, wants): the texts that `wanted` names, each with the list of its wants. The lists, bounded
    by the text, and the texts that pass the sieve meet in a shuffle."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("wants"))
    texts = sieved(rows, "rid", wanted).filter("maybe").drop("maybe")
    return texts.dropDuplicates(["rid"]).join(lists, "rid")


def split_hot(rows: DataFrame, hot_rows: DataFrame, units: list[Unit]) -> DataFrame:
    """Occurrences of anchors with too many different segments, dealt anew: SUB windows at a time, the
    new anchor being the symbols that all these windows hold. Fewer can differ within a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text, wants in zip(batch["rid"], batch["text"], batch["wants"], strict=True):
                of_unit = [Rolling(unit.symbols(text)) for unit in units]
                w = pd.DataFrame([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in wants], columns=["anchor", "p", "lo", "hi"])
                for anchor, p, lo, hi in w.itertuples(index=False):
                    rolling, length = of_unit[anchor & 1], units[anchor & 1].length
                    sub = min(SUB, -(-length // 2))  # so that short windows have symbols in common
                    cell = np.arange((lo - p) // sub, (hi - p) // sub + 1)
                    a, b = np.maximum(lo, p + cell * sub), np.minimum(hi, p + cell * sub + sub - 1)
                    core = rolling.spans(p + cell * sub + sub - 1, p + cell * sub + length)
                    key = mix(core ^ mix(np.array([anchor], np.int64).view(U64) + cell.astype(np.int64).view(U64)))
                    seg = mix(rolling.spans(a, b + length) ^ mix((p - a).astype(np.int64).view(U64)))
                    out.append(pd.DataFrame({"rid": rid, "anchor": key.view(np.int64) & ~1 | anchor & 1, "p": p, "lo": a, "hi": b, "seg": seg.view(np.int64)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["rid", "anchor", "p", "lo", "hi", "seg"])

    return with_text(rows, hot_rows, ["anchor", "p", "lo", "hi"]).mapInPandas(run, "rid long, anchor long, p int, lo int, hi int, seg long")


def repeated_spans(rows: DataFrame, units: list[Unit]) -> DataFrame:
    """rows(rid, text) -> (rid, spans): the spans (unit, a, b), in symbols, of windows that also start elsewhere.
    Two units at most.

    Only windows whose anchor occurs twice can repeat. Equal segments of an anchor repeat whole; those of
    its most frequent segment are known as such when occurrences meet their anchor. Where segments differ,
    one text of each goes into a collection for column-wise construction, about COLLECTION a task."""
    spark = rows.sparkSession
    unit_ = F.col("anchor").bitwiseAND(1).cast("int").alias("unit")
    length = F.when(F.col("unit") == 0, units[0].length).otherwise(units[-1].length)
    rows = rows.filter(F.octet_length("text") >= min(u.least_bytes() for u in units))
    places = occurrences(rows, units)
    # Stored apart from its aggregation, so that the join can split a hot anchor's rows over tasks.
    usual = F.max(F.struct("copies", "seg"))
    twice = places.groupBy("anchor", "seg").agg(F.count("*").alias("copies")).groupBy("anchor").agg(F.sum("copies").alias("k"), usual.alias("usual")).filter("k > 1")
    twice = checkpoint(twice.select("anchor", F.when(F.col("usual.copies") > 1, F.col("usual.seg")).alias("usual"), (F.col("usual.copies") == F.col("k")).alias("alike")))
    whole_ = F.coalesce(F.col("seg") == F.col("usual"), F.lit(False))
    found = checkpoint(places.join(twice, "anchor").select("rid", "anchor", "p", "lo", "hi", "seg", "alike", whole_.alias("whole")))
    held = found.filter("NOT alike").drop("alike")
    kinds = held.select("anchor", "seg").distinct().groupBy("anchor").agg(F.count("*").alias("kinds"))
    hot = checkpoint(kinds.filter(F.col("kinds") > HOT).select("anchor"))
    if not hot.isEmpty():
        apart = split_hot(rows, held.join(hot, "anchor"), units).withColumn("whole", F.lit(False))
        held = checkpoint(held.join(hot, "anchor", "left_anti").unionByName(apart))
        kinds = held.select("anchor", "seg").distinct().groupBy("anchor").agg(F.count("*").alias("kinds"))

    segments = checkpoint(held.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "p", "lo", "hi")).alias("at")))
    by_anchor = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).filter("kinds > 1 AND fewest = 1").select("anchor")
    open_ = checkpoint(segments.join(by_anchor, "anchor").select("anchor", "seg", "copies", "at.*"))
    total = open_.count()
    parts = max(1, -(-total // COLLECTION), min(total // 500, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wants in zip(batch["text"], batch["wants"], strict=True):
                data = [unit.symbols(text) if any(w["anchor"] & 1 == k for w in wants) else None for k, unit in enumerate(units)]
                out += [(w["anchor"], w["seg"], w["copies"], w["p"] - w["lo"], data[w["anchor"] & 1][w["lo"] : w["hi"] + units[w["anchor"] & 1].length].tobytes()) for w in wants]
            for a in range(0, max(1, len(out)), 20_000):
                yield pd.DataFrame(out[a : a + 20_000], columns=["anchor", "seg", "copies", "centre", "bytes"])

    texts = with_text(rows, open_, ["anchor", "seg", "copies", "p", "lo", "hi"]).mapInPandas(fetch, "anchor long, seg long, copies long, centre int, bytes binary")

    def construct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everything = [b for b in batches if len(b)]
        if not everything:
            return
        both = pd.concat(everything, ignore_index=True)
        everything.clear()
        for unit, rows_ in both.groupby(both["anchor"] & 1):
            rows_ = rows_.reset_index(drop=True)
            centre = rows_["centre"].to_numpy(np.int64)
            out = []
            for k, starts in enumerate(columnwise(list(rows_["bytes"]), centre, units[unit].length, units[unit].words)):
                if len(starts) and rows_["copies"][k] == 1:  # others repeat whole in any case
                    a, b = runs(starts)
                    out += [(rows_["anchor"][k], rows_["seg"][k], x, y) for x, y in zip((a - centre[k]).tolist(), (b - centre[k]).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["anchor", "seg", "a", "b"])

    matched = checkpoint(texts.repartition(parts, "anchor").mapInPandas(construct, "anchor long, seg long, a int, b int"))
    copied = segments.filter("copies > 1").select("anchor", "seg")
    whole = found.filter("whole").select("rid", unit_, "lo", "hi").unionByName(held.filter("NOT whole").join(copied, ["anchor", "seg"], "left_semi").select("rid", unit_, "lo", "hi"))
    whole = whole.select("rid", "unit", F.col("lo").alias("a"), F.col("hi").alias("b"))
    partly = held.join(matched, ["anchor", "seg"]).select("rid", unit_, (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))
    both = whole.unionByName(partly).select("rid", F.struct("unit", "a", (F.col("b") + length).alias("b")).alias("span"))
    return both.groupBy("rid").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def joined_spans(data: bytes, spans, units: list[Unit]) -> list[tuple[int, int]]:
    """The spans in bytes of the text `data`, sorted, overlapping and touching ones made one. A span of words
    goes from its first word to the end of its last."""
    out: list[list[int]] = []
    start = end = None
    found = []
    for s in spans if spans is not None else ():
        if units[s["unit"]].words:
            if start is None:
                start, end = word_bounds(np.frombuffer(data, np.uint8))
            found.append((int(start[s["a"]]), int(end[s["b"] - 1])))
        else:
            found.append((s["a"], s["b"]))
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, words: int = 0) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text; with
    keep_columns the input's columns, the text being what is left.

    Every byte covered by a `length`-byte string that also starts anywhere else is removed, judged on the
    input. With `words`, so is every passage of more than so many words that also starts anywhere else, whatever
    white space stands between its words. Null text is empty (with keep_columns it stays null). Repeated rows are each other's
    copies and lose all that is long enough. Bytes are cut where they are; kept_text drops the halves
    of characters that a cut leaves. Shorter texts stay whole; ids, null ones too, pass unchanged; an empty
    table gives no row."""
    key = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(key.alias("rid"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    units = [Unit(length, gram)] + ([Unit(words + 1, min(WORD_GRAM, words + 1), True)] if words else [])
    spans = checkpoint(repeated_spans(rows, units))
    if keep_columns:
        held = docs.select(key.alias("_rid"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
        found = spans.select(F.col("rid").alias("_rid"), F.col("spans").alias("_spans"))
        both = held.join(found, "_rid", "left")

        @F.pandas_udf("string")
        def cut(text: pd.Series, spans_: pd.Series) -> pd.Series:
            return pd.Series([t if t is None or s is None else without(as_bytes(t), joined_spans(as_bytes(t), s, units)).decode("utf-8", "ignore") for t, s in zip(text, spans_, strict=True)], dtype=object)

        text = F.when(F.col("_spans").isNull(), F.col(f"_row.{text_col}")).otherwise(cut(F.col(f"_row.{text_col}"), F.col("_spans")))
        return both.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])

    kind = docs.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    source = docs.select(docs[id_col].cast(through).alias("doc_id"), key.alias("rid"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(spans, "rid", "left").drop("rid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, found in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                    data = as_bytes(text)
                    cuts = joined_spans(data, found, units)
                    kept = without(data, cuts)
                    out.append((doc, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in cuts], kept.decode("utf-8", "ignore")))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])

    out = source.mapInPandas(run, f"doc_id {through}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:int,b:int>>, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in cuts:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
