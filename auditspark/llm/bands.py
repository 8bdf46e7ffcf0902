"""Joins on near numbers: linear buckets for an absolute band, logarithmic buckets for a relative one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Cents, and thousandths of the larger value, that op11 allows; pairs that it returns of each item.
ABSOLUTE, RELATIVE, KEEP = 100, (1, 1000), 2
#: Values of this size or more, and amounts that are no numbers, take part in no pair: beyond it their products
#: exceed 64 bits.
LARGEST = 10**15


def floor_div(x: Column, y: Column) -> Column:
    """floor(x / y) in integers; null where y is 0."""
    up, down = F.when(y < 0, -x).otherwise(x), F.abs(y)
    return F.when(y != 0, F.call_function("div", up - F.pmod(up, F.nullif(down, F.lit(0).cast("long"))), F.nullif(down, F.lit(0).cast("long"))))


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null for what is null, no finite number or too large."""
    return F.when(~F.isnan(x) & (F.abs(x) < LARGEST / 100), F.floor(x * F.lit(100.0) + F.lit(0.5)))


def value_pairs(left: DataFrame, right: DataFrame, a: str, b: str, absolute: int, relative: tuple[int, int]) -> DataFrame:
    """The rows of left beside those of right, with gap = |a - b|, where the gap is at most `absolute` or at most
    num / den of the larger of the two integers; relative = (num, den), num below den.

    Two equi-joins. Buckets of the absolute band are `absolute` wide, so that partners lie in neighbouring ones.
    Values in the relative band differ by the factor den / (den - num) at most; buckets of that width in
    logarithms, a little wider for rounding, have partners in neighbouring ones, too. That join keeps only pairs
    outside the absolute band, which both values must be large for, so smaller ones do not enter it. Both
    conditions are then checked in integers. Sides should hold each value once: rows of equal values multiply."""
    num, den = relative
    if not 0 <= num < den or absolute < 0 or LARGEST * den > 2**62:
        raise ValueError("a band needs absolute >= 0 and 0 <= num < den, den small")
    gap = F.abs(F.col(a) - F.col(b))
    width = F.lit(max(absolute, 1)).cast("long")

    def joined(bucket, kept: Column, needed: Column | None = None) -> DataFrame:
        l, r = (left, right) if needed is None else (left.filter(F.col(a) * num > needed), right.filter(F.col(b) * num > needed))
        at = bucket(F.col(a))
        l = l.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
        r = r.withColumn("_at", bucket(F.col(b)))
        return l.hint("merge").join(r, F.col("_bucket") == F.col("_at")).withColumn("gap", gap).filter(kept).drop("_bucket", "_at")

    near = F.col("gap") <= absolute
    out = joined(lambda v: floor_div(v, width), near)
    if num:
        factor = math.log(den / (den - num)) * (1 + 1e-9)
        far = joined(lambda v: F.floor(F.log(v) / factor), ~near & (F.col("gap") * den <= F.greatest(a, b) * num), F.lit(absolute * (den - num)).cast("long"))
        out = out.unionByName(far)
    return out


def first_of(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Tasks keep their own first n before the shuffle, so a hot key is no load."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def value_classes(right: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """right (value, owner, id columns k1, k2, crc) by value and owner, and by value: rows, sum of crc, and of each
    value the first 2 * keep rows, `keep` of an owner at most. Of those any one owner's rows can be left out and the
    first `keep` others are still there."""
    by_owner = stored(right.groupBy("value", "owner").agg(F.count("*").alias("rows"), F.sum("crc").alias("crc")))
    some = first_of(first_of(right.select("value", "owner", "k1", "k2"), ["value", "owner"], ["k1", "k2"], keep), ["value"], ["k1", "k2", "owner"], 2 * keep)
    lists = some.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("k1", "k2", "owner"))).alias("first"))
    totals = by_owner.groupBy("value").agg(F.sum("rows").alias("rows"), F.sum("crc").alias("crc"))
    return by_owner, stored(totals.join(lists.hint("merge"), "value"))


def nearest_in_band(left: DataFrame, right: DataFrame, absolute: int = ABSOLUTE, relative: tuple[int, int] = RELATIVE, keep: int = KEEP) -> DataFrame:
    """left (owner, value) with n_pairs, gap_sum, crc over all rows of right (owner, value, k1, k2, crc) of another
    owner in the band, and nearest, the first `keep` of them by gap, value, k1, k2, owner.

    Pairs of rows are never made. Rows of right become classes of equal values; left's distinct values meet them
    (value_pairs), which gives the sums over all owners and the gap within which the nearest lie: that of the first
    class whose rows suffice whichever owner is left out. A second pass keeps the classes up to there. An owner's
    own rows in its band, met by owner, are subtracted. A left row with a null value or owner has no pair; repeated
    left rows have a result each; null owners, values and keys of right take no part; empty sides give no pairs.
    Values are 64-bit integers below LARGEST; the sum of crc must fit in 64 bits, else the job fails."""
    here = left.select("owner", F.col("value").alias("p"))
    valid = F.col("owner").isNotNull() & F.col("p").isNotNull()
    by_owner, classes = value_classes(right.dropna(subset=["owner", "value", "k1", "k2"]), keep)
    points = stored(here.filter(valid).groupBy("p").agg(F.count("*").alias("n")).select("p"))
    other = classes.select("value", "rows", F.col("crc"), (F.size("first") == 2 * keep).alias("full"))
    met = value_pairs(points, other, "p", "value", absolute, relative)
    enough = F.min(F.when(F.col("full"), F.struct("gap", "value"))).alias("enough")
    sums = stored(met.groupBy("p").agg(F.sum("rows").alias("n_pairs"), F.sum(F.col("rows") * F.col("gap")).alias("gap_sum"), F.sum("crc").alias("crc"), enough))
    close = value_pairs(sums.select("p", "enough"), classes.select("value", "first"), "p", "value", absolute, relative)
    close = close.filter(F.col("enough").isNull() | (F.struct("gap", "value") <= F.col("enough"))).select("p", "gap", "value", F.explode("first").alias("row")).select("p", "gap", "value", "row.*")
    close = first_of(first_of(close, ["p", "owner"], ["gap", "value", "k1", "k2"], keep), ["p"], ["gap", "value", "k1", "k2", "owner"], 2 * keep)
    lists = close.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("gap", "value", "k1", "k2", "owner"))).alias("first"))
    points = sums.drop("enough").join(lists.hint("merge"), "p")

    gap = F.abs(F.col("p") - F.col("value"))
    inside = (gap <= absolute) | (gap * relative[1] <= F.greatest("p", "value") * relative[0])
    wanted = here.filter(valid).distinct()
    own = wanted.hint("merge").join(by_owner, "owner").filter(inside).groupBy("owner", "p").agg(F.sum("rows").alias("own_n"), F.sum(F.col("rows") * gap).alias("own_gap"), F.sum("crc").alias("own_crc"))
    less = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(own), F.lit(0))
    out = here.filter(valid).hint("merge").join(points, "p", "left").hint("merge").join(own, ["owner", "p"], "left")
    out = out.select("owner", "p", less("n_pairs", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("crc", "own_crc").alias("crc"), F.slice(F.filter("first", lambda r: r["owner"] != F.col("owner")), 1, keep).alias("nearest"))
    zero = F.lit(0).cast("long")
    rest = here.filter(~valid).select("owner", "p", zero.alias("n_pairs"), zero.alias("gap_sum"), zero.alias("crc"), F.lit(None).cast(out.schema["nearest"].dataType).alias("nearest"))
    return out.unionByName(rest).withColumnRenamed("p", "value")


def unit_cents(amount: Column, quantity: Column) -> Column:
    """Cents a piece, rounded half up in integers; null for a quantity of 0."""
    q = quantity.cast("long")
    return floor_div(2 * cents(amount) + q, 2 * q)


def op11_near_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    name = F.concat_ws(",", "sale_id", "line_no", "item_id")
    lines = lines.filter("sale_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("owner"), unit_cents(F.col("amount"), F.col("quantity")).alias("value"), F.col("sale_id").cast("long").alias("k1"), F.col("line_no").cast("long").alias("k2"), F.crc32(name.cast("binary")).alias("crc"))
    items = table(spark, sf_dir, "items").select(F.col("item_id").cast("long").alias("owner"), cents(F.col("price")).alias("value"))
    out = nearest_in_band(items, lines)
    out = out.select(F.col("owner").alias("item_id"), "n_pairs", "gap_sum", F.col("crc").alias("lines_crc"), F.posexplode_outer("nearest").alias("pos", "r"))
    return out.select("item_id", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), F.col("r.gap").alias("gap"), F.col("r.value").alias("u"), F.col("r.k1").alias("sale_id"), F.col("r.k2").alias("line_no"), F.col("r.owner").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


#: The 256 remainders of CRC-32 follow from its polynomial, 0xEDB88320.
_REMAINDERS = "(SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"


def oracle() -> str:
    """DuckDB SQL of op11_near_prices: every pair, compared one by one."""
    return f"""WITH l AS (SELECT *, (x - ((x % y) + y) % y) // y AS u FROM (
            SELECT sale_id, line_no::BIGINT AS line_no, item_id, CASE WHEN quantity < 0 THEN -1 ELSE 1 END * (2 * floor(100 * amount + 0.5)::BIGINT + quantity) AS x, abs(2 * quantity::BIGINT) AS y,
                concat(sale_id, ',', line_no, ',', item_id) AS name FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND quantity <> 0)),
    c AS (SELECT sale_id, line_no, item_id, u, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
            lambda s, b: xor(t[xor(s, b) % 256 + 1], s >> 8))) AS crc FROM l, {_REMAINDERS}),
    i AS (SELECT row_number() OVER () AS row, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
    j AS (SELECT row, abs(u - p) AS gap, u, sale_id, line_no, c.item_id AS line_item_id, crc FROM i JOIN c ON c.item_id <> i.item_id AND u BETWEEN p - greatest({ABSOLUTE}, abs(p) // 900 + 1) AND p + greatest({ABSOLUTE}, abs(p) // 900 + 1)
        WHERE abs(u - p) <= {ABSOLUTE} OR {RELATIVE[1]} * abs(u - p) <= {RELATIVE[0]} * greatest(u, p)),
    s AS (SELECT row, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM j GROUP BY row),
    k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM j QUALIFY rank <= {KEEP})
    SELECT i.item_id, coalesce(rank, 0)::INTEGER AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
    FROM i LEFT JOIN k USING (row) LEFT JOIN s USING (row)"""
