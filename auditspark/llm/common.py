"""What the corpus operators share: reading, lineage cuts, skew-safe ranks, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of characters that are not ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts. Spark takes it from spark.checkpoint.dir; only a local session
    without that setting (tests) gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditspark-checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through reliable storage, so that later stages survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, A_Z, a_z)


def tasks(spark: SparkSession) -> int:
    """Partitions to deal work over: the session's setting, and at least the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def salted_rank(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row among rows of equal keys (nulls are equal), in an order that
    depends on the order columns only. Rows of one key are dealt over salts, ranked there, and shifted
    by the counts of the smaller salts, so no task gets a whole hot key. Equal rows are
    interchangeable."""
    salts = max(64, tasks(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_inner", F.row_number().over(inner) - 1)
    a, b = ranked.alias("a"), counts.alias("b")
    same = F.col("a._salt") == F.col("b._salt")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    kept = [F.col(f"a.{c}") for c in df.columns]
    return a.join(b, same).select(*kept, (F.col("a._inner") + F.col("b._before")).cast("long").alias(rank))


#: Words of 64 bits in a sieve: so many rows at most are sent to every task.
SIEVE = 1 << 17


def sieved(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with `maybe`, which is true wherever keys(key) has the row's key, and for few other rows. The keys
    are known by 64 * SIEVE bits, sent to every task; with many more keys than that most rows pass, so a join
    must follow. Rows that do not pass need not be shuffled for it."""
    h = F.xxhash64(F.col(key), F.lit(1))
    word, bit = F.pmod(h, F.lit(SIEVE)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")
    held = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    bits = held.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    both = rows.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return both.select(*rows.columns, F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)).alias("maybe"))


def frequent(rows: DataFrame, times: str, top: int) -> DataFrame:
    """The rows of the highest classes of `times` that hold `top` rows at most together. Classes are an eighth of a
    doubling wide, so few numbers come to the driver."""
    scale = F.floor(F.log2(times) * 8)
    left, least = top, None
    for r in rows.groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["scale"]
    return rows.filter(F.lit(False) if least is None else scale >= least)


# --- numpy helpers for Python stages -------------------------------------------------------------

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, U64)
    if n:
        out[0] = 1
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial prefix sums over a byte or integer array: the hash of any slice, wherever it starts,
    depends on its content and length only."""

    _up = np.empty(0, U64)
    _down = np.empty(0, U64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Rolling._up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            Rolling._up, Rolling._down = powers(BASE, size), powers(BASE_INV, size)
        self.sums = np.zeros(n, U64)
        np.cumsum((symbols.astype(U64) + U64(1)) * Rolling._up[: n - 1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * Rolling._down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z of a byte array."""
    return _LOWER[data]


def as_bytes(text: str | None) -> bytes:
    """UTF-8 bytes; a null text is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def cached(key: tuple, make):
    """make(), kept for the later tasks of the same Python worker. Only for small fixed tables, such as
    a vocabulary; it lives in an attribute of sys, as these functions travel by value."""
    import sys

    held = sys.__dict__.setdefault("_auditspark_held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]
