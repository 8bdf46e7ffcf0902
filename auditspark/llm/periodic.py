"""Periodic runs of words: repeated k-grams mask what cannot join a run, Main and Lorentz find the runs of the rest."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WORD, mix, table

#: Least length of a run in words.
LEAST = 12
#: Characters of texts handled at once; a longer text is handled by itself.
CHARS = 2_000_000
_WORD = re.compile(WORD)


def overlap(least: int) -> int:
    """The k of the masking. A run of period q has least words or 2 * q, so it overlaps itself, q words on, in
    max(least - q, q) words at least: half of `least`, rounded up. Every word of it lies in a k-gram of that
    length which occurs q words before or after."""
    return (least + 1) // 2


def segments(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of words, inside documents, that k-grams repeated in their document cover;
    only stretches that have room for a run. k-grams are told apart by 64 bits: equal ones are never missed, and
    different ones of equal bits only make a stretch longer."""
    k, n = overlap(least), len(ids)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = mix(doc[: n - k + 1].astype(U64) + U64(1 << 40))
    for j in range(k):
        gram = mix(gram ^ (ids[j : n - k + 1 + j].astype(U64) + U64(1)))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    order = at[np.argsort(gram[at])]
    same = gram[order][1:] == gram[order][:-1]
    repeated = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + k, -1)
    covered = np.cumsum(edge[:n]) > 0
    new = np.ones(n + 1, bool)
    new[1:n] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    start, end = cut[:-1], cut[1:]
    fit = covered[start] & (end - start >= least)
    return start[fit], end[fit]


class Extensions:
    """How far two places of a sequence agree, forwards and backwards. ranks[j][i] names the string of 2**j
    symbols that starts at i: equal names, equal strings."""

    def __init__(self, x: np.ndarray):
        self.n, self.ranks = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int64)]
        while (step := 1 << len(self.ranks)) <= self.n:
            last = self.ranks[-1]
            half = step >> 1
            names, rank = np.unique(last[: self.n - step + 1] * np.int64(self.n + 1) + last[half : self.n - step + 1 + half], return_inverse=True)
            if len(names) == len(rank):
                break  # no string of this length or longer occurs twice
            self.ranks.append(rank.astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest t with x[a : a + t] == x[b : b + t], for a < b."""
        out = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            step, rank = 1 << j, self.ranks[j]
            q = b + out
            ok = q + step <= self.n
            ok[ok] = rank[(a + out)[ok]] == rank[q[ok]]
            out += step * ok
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest t with x[a - t : a] == x[b - t : b], for a < b."""
        out = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            step, rank = 1 << j, self.ranks[j]
            p = a - out - step
            ok = p >= 0
            ok[ok] = rank[p[ok]] == rank[(b - out - step)[ok]]
            out += step * ok
        return out


def main_lorentz(x: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs of a sequence as rows (start, end, smallest period) by start, then period: maximal stretches with
    least symbols and two periods at least.

    The sequence is halved again and again, all blocks of a level together. A run inside a block that crosses
    its middle m holds the period before or after m whole, so places (m - q, m) or (m, m + q) agree around m;
    extending both ways gives the run. Multiples of its period give the same stretch: the smallest stays."""
    n = len(x)
    near, found = Extensions(x), []
    low, high = np.array([0], np.int64), np.array([n], np.int64)
    while True:
        wide = high - low >= least
        low, high = low[wide], high[wide]
        if not len(low):
            break
        mid = (low + high) // 2
        for after in (False, True):
            size = high - mid if after else mid - low
            m = np.repeat(mid, size)
            q = np.arange(len(m)) - np.repeat(np.cumsum(size) - size, size) + 1
            c = m if after else m - q
            inner = c + q < n
            meet = np.zeros(len(c), bool)
            meet[inner] = x[c[inner]] == x[(c + q)[inner]]
            back = c > 0
            meet[back] |= x[c[back] - 1] == x[(c + q)[back] - 1]
            c, q = c[meet], q[meet]
            before, behind = near.backward(c, c + q), near.forward(c, c + q)
            whole = before + behind >= np.maximum(q, least - q)
            found.append(np.stack([(c - before)[whole], (c + q + behind)[whole], q[whole]], axis=1))
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[str | None], least: int) -> list[tuple[int, list[dict], str]]:
    """Number of words, runs and collapsed text of every text."""
    index: defaultdict[str, int] = defaultdict(count().__next__)
    words = [_WORD.findall(t or "") for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((index[w] for own in words for w in own), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    own: dict[int, list[np.ndarray]] = {}
    for a, b in zip(*(x.tolist() for x in segments(ids, doc, least)), strict=True):
        found = main_lorentz(ids[a:b], least)
        if len(found):
            found[:, :2] += a - first[doc[a]]
            own.setdefault(int(doc[a]), []).append(found)
    out = []
    for k, kept in enumerate(words):
        runs = own.get(k)
        n = len(kept)
        if runs:
            all_runs = np.concatenate(runs)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, all_runs[:, 0] + all_runs[:, 2], 1)
            np.add.at(edge, all_runs[:, 1], -1)
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
            runs = [{"start": s, "length": e - s, "period": q} for s, e, q in all_runs.tolist()]
        out.append((n, runs or [], " ".join(kept)))
    return out


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of consecutive words with smallest period q and max(least, 2 * q) words at least that no
    neighbouring word extends keeping the period. collapsed holds, joined by one space, the words that no run
    contains after its first q words. Only the two named columns are read; null and empty texts have no words, no
    runs and an empty collapsed text; ids, null ones too, pass unchanged; repeated rows count each by itself; an
    empty table gives no row. A text is handled whole, in memory in proportion to its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARS):
                    size += len(texts[end] or "")
                    end += 1
                n, runs, collapsed = zip(*runs_of_texts(texts[at:end], least), strict=True)
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of find_runs. Without a run start, length, period and exponent are null."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    length, period = best["length"], -best["short"]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["before"]).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents repeats some of its words to the end, as the contract of
    op13 states it. A document without id stays as it is."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    chosen = chosen.select("*", F.when(n > 0, g % n).cast("int").alias("a"), n.alias("n"))
    p = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8))).cast("int")
    return chosen.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(repeating(p)).alias("text"))


def repeating(p: Column) -> Column:
    """The first a of words, then the next p of them over and over, n words in all."""
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), F.ceil(rest / p).cast("int")))
    return F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(planted(table(spark, sf_dir, "documents"))))
