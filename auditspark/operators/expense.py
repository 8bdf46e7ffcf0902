"""Rules over one expense ledger.

The ledger has _src_row, expense_id, employee_id, amount (double), expense_date (date), and whichever of
the other canonical columns the source had. Rules are in the order in which findings are numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.functions import contains_any, match_key, weekday_of
from auditspark.plans import Policy, Registry, members, settled

EXPENSE = Registry()
rule = EXPENSE.rule
#: Words by which lodging is known, and the types that are transport.
LODGING = ("住宿", "酒店", "宾馆", "旅馆", "民宿", "住宿费", "房费", "hotel", "lodging")
TRANSPORT = ("flight", "train", "bus", "transport", "机票", "火车", "高铁", "大巴", "动车")


def day(c: str = "expense_date"):
    return F.unix_date(F.col(c))


#: Groups whose keys are sent to every task; rows meet more groups than these in a shuffle.
SENT = 100_000


def sent(groups: DataFrame) -> DataFrame:
    """groups, settled, sent to every task if they are no more than SENT, so that the rows they meet stay where they are."""
    groups = settled(groups)
    return F.broadcast(groups) if groups.limit(SENT + 1).count() <= SENT else groups


def differ(c: str) -> F.Column:
    """Whether a group has two values of a column, by their 64-bit hashes, which are aggregated without a sort."""
    known = F.when(F.col(c).isNotNull(), F.xxhash64(c))
    return F.min(known) != F.max(known)


def filled(key: str) -> F.Column:
    """Whether a group's key is known: asked of the groups, as a filter of the rows would clean their texts once more."""
    return F.count(key) > 0


def in_groups(e: DataFrame, *keys: str, least: int = 2, extra=None) -> DataFrame:
    """Rows whose group has `least` rows at least. The groups are counted first and joined back, so a hot
    group is pre-aggregated and its rows are dealt by the join, if they need to be dealt."""
    counted = e.groupBy(*keys).agg(F.count("*").alias("_n"), *([extra.alias("_x")] if extra is not None else []))
    counted = counted.filter(F.col("_n") >= least if extra is None else (F.col("_n") >= least) & F.col("_x"))
    right = sent(counted.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return e.join(right, same, "left_semi")


def has_word(e: DataFrame, words) -> F.Column:
    """Whether the expense type holds one of the words, in their own case."""
    if not words or "expense_type" not in e.columns:
        return F.lit(False)
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(F.col("expense_type"), F.lit(w)), F.lit(False))
    return out


def number(value) -> float | None:
    """A number of the policy, given as such or as text."""
    try:
        return float(str(value).replace(",", "").lstrip("¥￥ "))
    except ValueError:
        return None


def islands(e: DataFrame, keys: list[str], position, order: list) -> DataFrame:
    """Adds _run: rows of a group whose positions follow each other by one share it."""
    by = Window.partitionBy(*keys).orderBy(*order)
    stepped = e.withColumn("_at", position).withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(by) != 1).cast("int"), F.lit(1)))
    return stepped.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))


@rule("exact-duplicate-invoice", 4, "strong", needs=("invoice_number",))
def duplicate_invoice(e: DataFrame, p: Policy) -> DataFrame:
    keys = ("employee_id", "invoice_number", "currency", "amount")
    return members(in_groups(e.filter("invoice_number IS NOT NULL"), *keys), *keys)


@rule("exact-duplicate-employee-date-amount", 3, "moderate")
def duplicate_claim(e: DataFrame, p: Policy) -> DataFrame:
    keys = ("employee_id", "expense_date", "currency", "amount")
    words = p.get("multi_occurrence_types", [])
    extra = ~F.bool_and(has_word(e, words)) if words else None
    return members(in_groups(e, *keys, extra=extra), *keys)


#: Spans of days of a group that are searched for neighbours together.
SPANS = 8


def with_neighbours(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """rows(d, ...) whose group has another row within `span` days, and some that share a hash with such. A task sorts
    SPANS spans of a group; rows in the span before the next such stretch stand there too."""
    stretch = lambda c: F.floor(c / (SPANS * (span + 1)))
    cells = F.explode(F.array_distinct(F.array(stretch(F.col("d")), stretch(F.col("d") + span))))
    by = Window.partitionBy("_hash", "_cell").orderBy("d")
    near = F.least(F.col("d") - F.lag("d").over(by), F.lead("d").over(by) - F.col("d")) <= span
    dealt = rows.withColumn("_hash", F.xxhash64(*keys)).withColumn("_cell", cells)
    return dealt.withColumn("_near", near).filter("_near").drop("_hash", "_cell", "_near").distinct()


def near_duplicate_pairs(e: DataFrame, p: Policy) -> DataFrame:
    """(row_a, row_b) of one employee, vendor and currency, days apart at most near_duplicate_window_days,
    amounts apart at most near_duplicate_amount_tolerance of the larger, and no exact duplicates; pairs of
    which both rows are of fixed_amount_types, or of multi_occurrence_types, are left out. Rows without a neighbour
    fall out first; others are dealt by week-like buckets of days, each row meeting its own and the next, so a busy
    employee is split up."""
    span, ratio = int(p.get("near_duplicate_window_days", 7)), float(p.get("near_duplicate_amount_tolerance", 0.15))
    rows = e.select("_src_row", "employee_id", "currency", "amount", has_word(e, p.get("fixed_amount_types")).alias("fixed"), has_word(e, p.get("multi_occurrence_types")).alias("often"), day().alias("d"), match_key(F.col("vendor_name")).alias("vendor"), *(["invoice_number"] if "invoice_number" in e.columns else [F.lit(None).cast("string").alias("invoice_number")])).filter("vendor IS NOT NULL AND d IS NOT NULL")
    rows = settled(with_neighbours(rows, ["employee_id", "vendor", "currency"], span).withColumn("bucket", F.floor(F.col("d") / (span + 1))))
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    joined = a.join(b, (F.col("a_employee_id") == F.col("b_employee_id")) & (F.col("a_vendor") == F.col("b_vendor")) & F.col("a_currency").eqNullSafe(F.col("b_currency")) & (F.col("a_bucket") == F.col("b_bucket")))
    gap = F.col("b_d") - F.col("a_d")
    near = F.abs(F.col("a_amount") - F.col("b_amount")) / F.greatest(F.abs("a_amount"), F.abs("b_amount"), F.lit(0.01)) <= ratio
    same = (F.col("a_amount") == F.col("b_amount")) & ((gap == 0) | F.coalesce(F.col("a_invoice_number") == F.col("b_invoice_number"), F.lit(False)))
    ordered = (gap > 0) | ((gap == 0) & (F.col("a__src_row") < F.col("b__src_row")))
    exempt = (F.col("a_fixed") & F.col("b_fixed")) | (F.col("a_often") & F.col("b_often"))
    return joined.filter(ordered & (gap <= span) & near & ~same & ~exempt).select(F.col("a__src_row").alias("row_a"), F.col("b__src_row").alias("row_b"))


@rule("near-duplicate", 2, "moderate", needs=("vendor_name",))
def near_duplicate(e: DataFrame, p: Policy) -> DataFrame:
    """One finding of all rows in some pair, if they are three or more."""
    rows = near_duplicate_pairs(e, p).select(F.explode(F.array("row_a", "row_b")).alias("_src_row")).distinct()
    hit = members(e.join(rows, "_src_row", "left_semi"))
    return hit.filter(rows.agg(F.count("*")).scalar() >= 3)


@rule("policy-threshold", 3, "strong", needs=("expense_type",))
def policy_threshold(e: DataFrame, p: Policy) -> DataFrame:
    """One finding for each row and limit that it is above."""
    hits = []
    for i, limit in enumerate(p.get("limits", [])):
        most = number(limit.get("max_amount"))
        if most is None:
            continue
        one = F.col("amount") > most
        if limit.get("expense_type"):
            one = one & F.coalesce(match_key(F.col("expense_type")) == match_key(F.lit(limit["expense_type"])), F.lit(False))
        if limit.get("currency"):
            one = one & (F.col("currency") == str(limit["currency"]).upper())
        hits.append(F.when(one, F.lit(i)))
    above = e.withColumn("_limit", F.explode(F.array_compact(F.array(*hits)))) if hits else e.filter("false").withColumn("_limit", F.lit(0))
    return members(above, "_src_row", "_limit")


#: Rows of a group that stand in one bucket when the rows of its windows are fetched.
CELL = 64


#: Rows of a group whose windows are scanned in one task; larger groups are dealt by their days.
WHOLE = 256
#: Source rows of one day and group that are scanned together.
STRETCH = 1 << 18


def same_group(keys: list[str]) -> F.Column:
    """One text for each combination of keys; null keys are equal. It begins with a hash, so that texts differ early
    where they are sorted."""
    return F.concat(F.hex(F.xxhash64(*keys)), F.to_json(F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)])))


def split_windows(e: DataFrame, keys: list[str], limit: float, span: int, distinct: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(starts, numbered). starts: the rows from which the rows of their group within `span` days, themselves
    included, in date then row order, are two or more, each under the limit, together above it, and of two
    known `distinct` values or more; with _rn, the place in the group, _end, the last row's, n_rows and total.

    Groups of up to WHOLE rows are dealt whole and sorted once; larger ones go through dealt_windows. Groups are counted
    by a hash of their keys: of two that share one, both may go the longer way."""
    hash_ = F.xxhash64(*keys)
    sizes = e.groupBy(hash_.alias("_hash")).agg((F.count("*") > WHOLE).alias("_large"))
    groups, hot = sizes.agg(F.count("*"), F.count_if("_large")).first()
    if not hot:
        return whole_windows(e, keys, limit, span, distinct)
    if hot == groups:
        return dealt_windows(e, keys, limit, span, distinct)
    large = sent(sizes.filter("_large").select("_hash"))
    small = whole_windows(e.join(large, hash_ == F.col("_hash"), "left_anti"), keys, limit, span, distinct)
    rest = dealt_windows(e.join(large, hash_ == F.col("_hash"), "left_semi"), keys, limit, span, distinct)
    return small[0].unionByName(rest[0]), small[1].unionByName(rest[1])


def whole_windows(e: DataFrame, keys: list[str], limit: float, span: int, distinct: str | None) -> tuple[DataFrame, DataFrame]:
    """split_windows of groups that a task may hold. Every figure of a window is a difference of running figures of
    the sorted group; only rows of groups that could make a window are numbered."""
    money, large = F.col("amount").cast("decimal(18,2)"), (F.col("amount") >= limit).cast("long")
    group = Window.partitionBy(*keys)
    order, ahead = group.orderBy("_day", "_src_row"), group.orderBy("_day").rangeBetween(Window.unboundedPreceding, span)
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = e.withColumn("_day", day()).filter("_day IS NOT NULL")
    under = F.sum(F.when((F.col("amount") > 0) & (large == 0), money)).over(all_)
    w = w.select("*", F.row_number().over(order).alias("_rn"), F.sum(money).over(upto).alias("_sum"), F.sum(large).over(upto).alias("_large"), under.alias("_under"))
    if distinct:  # a window holds two values if the known value changes behind its first known one
        seen = F.last(distinct, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        w = w.withColumn("_turn", F.coalesce((F.col(distinct) != seen).cast("long"), F.lit(0))).withColumn("_turns", F.sum("_turn").over(upto))
    figures = [F.count("*").over(ahead).alias("_end"), F.sum(money).over(ahead).alias("_s"), F.sum(large).over(ahead).alias("_l")]
    w = w.select("*", *figures, *([F.sum("_turn").over(ahead).alias("_t")] if distinct else [])).filter(F.col("_under") > limit)
    w = w.withColumn("n_rows", (F.col("_end") - F.col("_rn") + 1).cast("int")).withColumn("total", (F.col("_s") - F.col("_sum") + money).cast("decimal(28,2)"))
    good = (F.col("n_rows") >= 2) & (F.col("total") > limit) & (F.col("_l") - F.col("_large") + large == 0)
    if distinct:
        back = group.orderBy(F.desc("_day"), F.desc("_src_row")).rowsBetween(Window.unboundedPreceding, 0)
        w = w.withColumn("_from", F.last(F.when(F.col(distinct).isNotNull(), F.col("_turns")), ignorenulls=True).over(back))
        good = good & (F.col("_t") > F.col("_from"))
    return w.filter(good).select(*e.columns, "_rn", "_end", "n_rows", "total"), w.select(*keys, "_rn", "_src_row", "amount")


def dealt_windows(e: DataFrame, keys: list[str], limit: float, span: int, distinct: str | None = None) -> tuple[DataFrame, DataFrame]:
    """split_windows of groups of any size.

    Every figure of a window is a difference of running figures at its two ends, so no frame is collected. The
    figures run in two levels: rows within a cell, a day of a group and at most STRETCH source rows of it, and cells
    within their group, of which there are as many as days. So a group that holds much of a ledger is dealt over
    tasks by its days."""
    own = ["_group", "_day", "_cell"]
    money, large = F.col("amount").cast("decimal(18,2)"), (F.col("amount") >= limit).cast("long")
    rows = e.withColumn("_group", same_group(keys)).withColumn("_day", day()).withColumn("_cell", F.floor(F.col("_src_row") / STRETCH)).filter("_day IS NOT NULL")
    inner = Window.partitionBy(*own).orderBy("_src_row")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    w = rows.withColumn("_rn", F.row_number().over(inner)).withColumn("_sum", F.sum(money).over(upto)).withColumn("_large", F.sum(large).over(upto))
    figures = [F.count("*").alias("n"), F.sum(money).alias("s"), F.sum(large).alias("l")]
    if distinct:  # a window holds two values if the known value changes between two of its rows
        seen = F.last(distinct, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
        w = w.withColumn("_turn", F.coalesce((F.col(distinct) != seen).cast("long"), F.lit(0))).withColumn("_turns", F.sum("_turn").over(upto))
        back = Window.partitionBy(*own).orderBy(F.desc("_src_row")).rowsBetween(Window.unboundedPreceding, 0)
        w = w.withColumn("_from", F.last(F.when(F.col(distinct).isNotNull(), F.col("_turns")), ignorenulls=True).over(back))
        known = F.when(F.col(distinct).isNotNull(), F.col("_src_row"))
        figures += [F.sum("_turn").alias("t"), F.min_by(distinct, known).alias("first"), F.max_by(distinct, known).alias("last")]
    cells = (w if distinct else rows).groupBy(*own).agg(*figures)
    order = Window.partitionBy("_group").orderBy("_day", "_cell")
    before, ahead = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_group").orderBy("_day").rangeBetween(Window.unboundedPreceding, span)
    sums = ["n", "s", "l"]
    if distinct:
        cells = cells.withColumn("edge", F.coalesce((F.col("first") != F.last("last", ignorenulls=True).over(before)).cast("long"), F.lit(0))).withColumn("t", F.col("t") + F.col("edge"))
        sums.append("t")
    cells = cells.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(ahead).alias(f"{c}_ahead") for c in sums])
    if distinct:
        at_first = F.when(F.col("first").isNotNull(), F.col("t_before") + F.col("edge"))
        cells = cells.withColumn("next", F.first(at_first, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    w = w.join(cells.drop("n", "s", "l", "t", "first", "last"), own)
    w = w.withColumn("_rn", F.col("_rn") + F.col("n_before")).withColumn("_end", F.col("n_ahead")).withColumn("n_rows", (F.col("_end") - F.col("_rn") + 1).cast("int"))
    w = w.withColumn("total", (F.col("s_ahead") - F.col("s_before") - F.col("_sum") + money).cast("decimal(28,2)"))
    good = (F.col("n_rows") >= 2) & (F.col("total") > limit) & (F.col("l_ahead") - F.col("l_before") - F.col("_large") + large == 0)
    if distinct:
        good = good & (F.col("t_ahead") > F.coalesce(F.col("t_before") + F.col("edge") + F.col("_from"), F.col("next")))
    kept = [*e.columns, "_rn", "_end", "n_rows", "total"]
    return w.filter(good).select(*kept), w.select(*keys, "_rn", "_src_row", "amount")


def window_rows(starts: DataFrame, numbered: DataFrame, keys: list[str]) -> DataFrame:
    """(_start, _src_row, amount): the rows of each start's window, met by buckets of CELL places in the group."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    s = starts.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_src_row").alias("_start"), F.col("_rn").alias("_first"), "_end", F.explode(F.sequence(cell("_rn"), cell("_end"))).alias("_cell"))
    same = (cell("_rn") == F.col("_cell")) & F.col("_rn").between(F.col("_first"), F.col("_end"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(s, same).select("_start", "_src_row", "amount")


def thresholds(p: Policy) -> list[tuple[float, str]]:
    """(amount, currency or "") of the approval thresholds."""
    out = [(number(t.get("amount")), str(t.get("currency") or "").upper()) for t in p.get("approval_thresholds", [])]
    return [t for t in out if t[0] is not None]


def _split(e: DataFrame, p: Policy, keys: list[str], distinct: str | None) -> DataFrame:
    out = members(e.filter("false"), "_src_row")
    for i, (limit, currency) in enumerate(thresholds(p)):
        rows = e.filter(F.col("currency") == currency) if currency else e
        held = window_rows(*split_windows(rows, keys, limit, int(p.get("split_window_days", 0)), distinct), keys)
        out = out.unionByName(held.select(F.concat_ws("|", F.lit(str(i)), F.col("_start")).alias("finding_key"), "_src_row", F.col("amount").cast("double").alias("amount")))
    return out


@rule("split-expense", 3, "moderate", needs=("vendor_name",))
def split_expense(e: DataFrame, p: Policy) -> DataFrame:
    return _split(e.withColumn("_vendor", match_key(F.col("vendor_name"))), p, ["employee_id", "_vendor", "currency"], None)


@rule("split-expense-cross-merchant", 3, "moderate", switch="split_cross_merchant", needs=("vendor_name",))
def split_cross_merchant(e: DataFrame, p: Policy) -> DataFrame:
    return _split(e.withColumn("_vendor", match_key(F.col("vendor_name"))), p, ["employee_id", "currency"], "_vendor")


@rule.each("weekend-signal", 1, "weak", switch="weekend_check")
def weekend(e: DataFrame, p: Policy) -> F.Column:
    return F.weekday("expense_date") >= 5


@rule.each("holiday-signal", 1, "weak", switch="weekend_check")
def holiday(e: DataFrame, p: Policy) -> F.Column:
    days = [str(d) for d in p.get("holidays", [])]
    return (F.weekday("expense_date") < 5) & F.col("expense_date").cast("string").isin(days or [""])


def medians(hist: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """hist(keys, value, _n), a row for each value of a group -> (keys, name): the exact median, the mean of the
    two middle values of an even number.

    Values are first counted in classes a sixteenth of a doubling wide; only the classes that hold a middle
    value are then gone through value by value, so a task holds little of a hot group."""
    v = F.col(value)
    scale = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 16) + 20_000)).cast("int")
    classed = hist.withColumn("_class", scale)
    whole = Window.partitionBy(*keys)
    sums = classed.groupBy(*keys, "_class").agg(F.sum("_n").alias("_k")).withColumn("_upto", F.sum("_k").over(whole.orderBy("_class").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_k").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # places of the middle values
    middle = sums.filter((F.col("_upto") >= low) & (F.col("_upto") - F.col("_k") < high)).withColumn("_before", F.col("_upto") - F.col("_k")).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate([*keys, "_class"])], "_before", "_all")
    same = F.col("_class") == F.col(f"_g{len(keys)}")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*keys, "_class").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = classed.join(middle, same).withColumn("_to", F.sum("_n").over(inner) + F.col("_before"))
    holds = lambda place: (F.col("_to") >= place) & (F.col("_to") - F.col("_n") < place)
    return at.groupBy(*keys).agg((0.5 * F.min(F.when(holds(low), v)) + 0.5 * F.min(F.when(holds(high), v))).alias(name))


#: Rows of a group whose values one task may hold; medians of larger groups come from histograms.
GROUP = 100_000


def robust_outliers(e: DataFrame, keys: list[str], value: str, least: int = 5, z: float = 3.5, flat_ratio: float | None = None) -> DataFrame:
    """Rows far above the median of their group: 0.6745 (x - median) / MAD above z, the MAD not 0; with
    flat_ratio, groups of MAD 0 give rows of so many times the group's least. Adds _median, _mad, _z. Null keys
    are equal. Groups are counted first; those of up to GROUP rows have their medians taken in a task, in one pass
    over the rows dealt by group, larger ones by medians()."""
    by = [f"_by{i}" for i in range(len(keys))]
    e = e.withColumns({b: F.concat(F.col(k).isNull().cast("string"), F.coalesce(F.col(k).cast("string"), F.lit(""))) for b, k in zip(by, keys, strict=True)})
    size = settled(e.groupBy(*by).agg(F.count("*").alias("_size"), F.min(value).alias("_least")).filter(F.col("_size") >= least))
    scored, hot = None, size.filter(F.col("_size") > GROUP)
    if not hot.isEmpty():  # one for GROUP rows at most, sent to every task
        large = e.join(F.broadcast(hot), by)
        hist = settled(large.groupBy(*by, value).agg(F.count("*").alias("_n")))
        middle = settled(medians(hist, by, value, "_median"))
        away = hist.join(middle, by).groupBy(*by, F.abs(F.col(value) - F.col("_median")).alias("_away")).agg(F.sum("_n").alias("_n"))
        scored = large.join(F.broadcast(settled(middle.join(medians(away, by, "_away", "_mad"), by))), by)
    few = size.filter(F.col("_size") <= GROUP)
    if scored is None or not few.isEmpty():
        group = Window.partitionBy(*by)
        small = e.join(sent(few), by)
        small = small.withColumn("_median", F.median(value).over(group)).withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_median"))).over(group))
        scored = small if scored is None else small.unionByName(scored)
    scored = scored.drop(*by).withColumn("_z", F.when(F.col("_mad") != 0, 0.6745 * (F.col(value) - F.col("_median")) / F.col("_mad")))
    hit = F.coalesce(F.col("_z") > z, F.lit(False))
    if flat_ratio is not None:
        hit = hit | ((F.col("_mad") == 0) & (F.col(value) >= flat_ratio * F.col("_least")) & (F.col("_least") > 0))
    return scored.filter(hit)


@rule("robust-outlier", 2, "moderate", needs=("expense_type",))
def outlier(e: DataFrame, p: Policy) -> DataFrame:
    rows = e.filter(~has_word(e, p.get("fixed_amount_types"))).withColumn("_type", match_key(F.col("expense_type"))).filter("_type IS NOT NULL")
    rows = robust_outliers(rows, ["_type", "currency"], "amount", int(p.get("outlier_min_group_size", 5)), float(p.get("outlier_robust_z", 3.5)))
    return members(rows.filter((F.col("amount") < float(p.get("large_amount_threshold", 5000))) & (F.col("amount") >= float(p.get("outlier_min_amount", 0) or float("-inf")))), "_src_row")


#: Numbers of a group that are scanned together.
NUMBERS = 1 << 10


def number_runs(rows: DataFrame, row: F.Column) -> DataFrame:
    """rows(_group, _no) as (_group, run, base, slot, row): the rows in runs of numbers that rise by one, run being the
    first number, of two numbers or more; a number is base + slot. A number that several rows have ends a run with the
    least of them and begins one with the largest.

    Numbers are counted first, and only rows of numbers beside others go on. The first number of a run is looked up
    in the number's stretch of NUMBERS; where a run enters a stretch from the one before, it is carried over the
    stretches' edges, for which only stretches stand that a run crosses."""
    stretch, slot, kind = ["_group", "base"], F.col("slot"), rows.schema["_no"].dataType
    rows = rows.withColumn("slot", (F.col("_no") % NUMBERS).cast("int")).withColumn("base", (F.col("_no") - F.col("slot")).cast(kind))
    n = rows.groupBy(*stretch, "slot").agg(F.count("*").alias("n"))
    moved = lambda at, by: n.filter(slot == at).select("_group", (F.col("base") + by).cast(kind).alias("base"), F.lit(True).alias("enters" if by > 0 else "leaves"))
    inner = Window.partitionBy(*stretch).orderBy("slot")
    n = n.withColumn("after", F.lag("slot").over(inner) == slot - 1).withColumn("goes_on", F.lead("slot").over(inner) == slot + 1)
    n = n.join(moved(NUMBERS - 1, NUMBERS), stretch, "left").join(moved(0, -NUMBERS), stretch, "left")
    n = n.withColumn("after", F.coalesce(F.when(slot == 0, F.col("enters")).otherwise(F.col("after")), F.lit(False))).withColumn("goes_on", F.coalesce(F.when(slot == NUMBERS - 1, F.col("leaves")).otherwise(F.col("goes_on")), F.lit(False)))
    n = n.filter("after OR goes_on").withColumn("begins", F.when((F.col("n") > 1) | ~F.col("after"), slot))
    n = settled(n.select(*stretch, "slot", "n", "after", "goes_on", F.last("begins", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("first")))
    edges = n.groupBy(*stretch).agg(F.max(F.when(F.col("first") >= 0, F.col("first"))).alias("held"), F.bool_or((slot == 0) & F.col("after")).alias("enters"), F.bool_or((slot == NUMBERS - 1) & F.col("goes_on")).alias("leaves"))
    order = Window.partitionBy("_group").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("held").isNotNull(), (F.col("base") + F.col("held")).cast(kind))
    carried = edges.filter("enters OR leaves").withColumn("carried", F.last(begun, ignorenulls=True).over(order)).filter("enters").select(*stretch, "carried")
    n = n.join(carried, stretch, "left").withColumn("run", F.coalesce((F.col("base") + F.col("first")).cast(kind), F.col("carried")))
    came = F.when((F.col("n") > 1) & F.col("after"), F.coalesce(F.when(slot > 0, F.lag("run").over(inner)), F.col("carried")))
    n = n.select(*stretch, "slot", "n", "run", came.alias("came"))
    held = rows.withColumn("row", row).select(*stretch, "slot", "row").join(n, [*stretch, "slot"])
    alone = held.filter("n = 1 AND run IS NOT NULL").select("_group", "run", "base", "slot", "row")
    ends = held.filter("n > 1").groupBy(*stretch, "slot", "run", "came").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    both = F.array(F.struct("run", F.col("high").alias("row")), F.struct(F.col("came").alias("run"), F.col("low").alias("row")))
    shared = ends.select(*stretch, "slot", F.explode(F.filter(both, lambda x: x["run"].isNotNull())).alias("x")).select("_group", "x.run", "base", "slot", "x.row")
    return alone.unionByName(shared)


@rule("sequential-invoice", 3, "moderate", needs=("invoice_number", "vendor_name"))
def sequential_invoice(e: DataFrame, p: Policy) -> DataFrame:
    """In each vendor and currency, the first invoices, three or more, whose numbers rise by one up to the end of
    their run and that are dated within sequential_invoice_window_days. A number that repeats ends a run.

    Counts and dates from a row to the end of its run are those in its stretch of numbers and those of the stretches
    behind, so a long run is dealt over tasks."""
    rows = e.withColumn("_vendor", match_key(F.col("vendor_name"))).withColumn("_no", F.regexp_extract("invoice_number", r"(\d{2,})", 1).try_cast("decimal(38,0)")).filter("_no IS NOT NULL")
    groups = settled(rows.select(F.col("_vendor").alias("_v"), F.col("currency").alias("_c")).distinct().withColumn("_group", F.monotonically_increasing_id()))
    named = F.broadcast(groups) if groups.limit(SENT + 1).count() <= SENT else groups
    rows = rows.join(named, F.col("_vendor").eqNullSafe(F.col("_v")) & F.col("currency").eqNullSafe(F.col("_c")))
    rows = settled(rows.select("_group", "_no", F.struct("expense_date", "_src_row", "amount").alias("row")))
    if (rows.agg(F.max("_no")).first()[0] or 0) < 10**18:
        rows = rows.withColumn("_no", F.col("_no").cast("long"))
    runs = settled(number_runs(rows, F.col("row")))
    runs = runs.withColumn("date", F.col("row.expense_date"))
    piece = ["_group", "run", "base"]
    back = Window.partitionBy("_group", "run").orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    behind = runs.groupBy(*piece).agg(F.count("*").alias("k"), F.min("date").alias("a"), F.max("date").alias("b"))
    behind = behind.select(*piece, F.coalesce(F.sum("k").over(back), F.lit(0)).alias("k"), F.min("a").over(back).alias("a"), F.max("b").over(back).alias("b"))
    on = Window.partitionBy(*piece).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.join(behind, piece).withColumn("left", F.count("*").over(on) + F.col("k"))
    runs = runs.withColumn("days", F.datediff(F.greatest(F.max("date").over(on), "b"), F.least(F.min("date").over(on), "a")))
    good = runs.filter((F.col("left") >= 3) & (F.col("days") <= int(p.get("sequential_invoice_window_days", 3))))
    first = good.groupBy("_group").agg(F.min(F.struct("run", "base", "slot")).alias("at")).select(F.col("_group").alias("_g"), "at.run", F.struct("at.base", "at.slot").alias("_from"))
    hit = runs.join(first, (F.col("_group") == F.col("_g")) & (runs["run"] == first["run"]) & (F.struct("base", "slot") >= F.col("_from")), "left_semi")
    return members(hit.join(named.withColumnsRenamed({"_group": "_g", "_v": "_vendor", "_c": "currency"}), F.col("_group") == F.col("_g")).select("row.*", "_vendor", "currency"), "_vendor", "currency")


@rule.each("invoice-format-anomaly", 3, "moderate", needs=("invoice_number",), key=())
def invoice_format(e: DataFrame, p: Policy) -> F.Column:
    no = F.col("invoice_number")
    return (F.length(no) < 4) | (F.length(no) > 40) | no.rlike(r"[^A-Za-z0-9\-_. ]")


@rule.each("large-amount-low-level-approval", 4, "strong", switch="low_level_approver_keywords", needs=("approver",), key=())
def low_level_approval(e: DataFrame, p: Policy) -> F.Column:
    return (F.col("amount") >= float(p.get("large_amount_threshold", 5000))) & contains_any(F.col("approver"), p["low_level_approver_keywords"])


@rule.each("large-amount", 3, "moderate", switch="large_amount_check", key=())
def large_amount(e: DataFrame, p: Policy) -> F.Column:
    large = F.col("amount") >= float(p.get("large_amount_threshold", 5000))
    words = p.get("low_level_approver_keywords")
    return large & ~contains_any(F.col("approver"), words) if words and "approver" in e.columns else large


@rule.each("self-approval", 4, "strong", needs=("approver",), key=())
def self_approval(e: DataFrame, p: Policy) -> F.Column:
    names = F.array_compact(F.array("employee_id", *(["employee_name"] if "employee_name" in e.columns else [])))
    return F.arrays_overlap(F.transform(F.split("approver", "[;；,，、]"), lambda x: F.trim(x)), names)


@rule("cross-employee-invoice", 4, "strong", needs=("invoice_number",))
def cross_employee_invoice(e: DataFrame, p: Policy) -> DataFrame:
    rows = e.filter("invoice_number IS NOT NULL")
    return members(in_groups(rows, "invoice_number", extra=differ("employee_id")))


@rule.each("submit-before-expense", 2, "moderate", needs=("submit_date",), key=())
def submit_before(e: DataFrame, p: Policy) -> F.Column:
    return F.col("submit_date") < F.col("expense_date")


@rule.each("future-date", 3, "moderate", switch="as_of_date", key=())
def future_date(e: DataFrame, p: Policy) -> F.Column:
    return F.col("expense_date") > F.lit(str(p["as_of_date"])).cast("date")


@rule.each("missing-expense-type", 2, "moderate", needs=("expense_type",), key=())
def missing_type(e: DataFrame, p: Policy) -> F.Column:
    least = min([m for x in p.get("limits", []) if (m := number(x.get("max_amount"))) and m > 0], default=None)
    return F.lit(False) if least is None else F.col("expense_type").isNull() & (F.col("amount") > least)


@rule("space-time-conflict", 3, "strong", needs=("dest_city",))
def space_time(e: DataFrame, p: Policy) -> DataFrame:
    rows = e.filter("dest_city IS NOT NULL")
    if "expense_type" in e.columns:
        rows = rows.filter(~F.coalesce(match_key(F.col("expense_type")) == "travel", F.lit(False)))
    keys = ("employee_id", "expense_date")
    return members(in_groups(rows, *keys, extra=differ("dest_city")), *keys)


@rule.each("cross-period", 2, "moderate", needs=("submit_date",), key=())
def cross_period(e: DataFrame, p: Policy) -> F.Column:
    months = F.year("submit_date") * 12 + F.month("submit_date") - F.year("expense_date") * 12 - F.month("expense_date")
    least = int(p.get("cross_period_months", 3))
    return (months >= least) & F.lit(least > 0)


def busy_rows(e: DataFrame, keys: list[str], span: int, least: int) -> DataFrame:
    """Rows in some window of `span` days that holds `least` rows of their group or more. Counts by day
    come first, so a frame holds days, not rows."""
    d = day().alias("d")
    days = e.groupBy(*keys, d).agg(F.count("*").alias("k"))
    by = Window.partitionBy(*keys).orderBy("d")
    days = days.withColumn("held", F.sum("k").over(by.rangeBetween(-span, 0)))
    days = days.withColumn("in", F.max("held").over(by.rangeBetween(0, span)) >= least).filter("in")
    right = sent(days.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("d").alias("_gd")))
    same = day() == F.col("_gd")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return e.join(right, same, "left_semi")


@rule("high-frequency-small-amount", 3, "moderate", needs=("expense_type",))
def high_frequency(e: DataFrame, p: Policy) -> DataFrame:
    least = int(p.get("high_frequency_min_count", 10))
    rows = e.filter((F.col("amount") <= float(p.get("high_frequency_max_amount", 100))) & F.lit(least > 1)).withColumn("_type", match_key(F.col("expense_type")))
    keys = ["employee_id", "_type"]
    return members(busy_rows(rows, keys, int(p.get("high_frequency_window_days", 30)), least), *keys)


@rule("vendor-concentration", 2, "weak", switch="vendor_concentration_check", needs=("vendor_name",))
def vendor_concentration(e: DataFrame, p: Policy) -> DataFrame:
    scope = "department" if p.get("vendor_concentration_scope") == "department" else "employee_id"
    least = int(p.get("vendor_concentration_min_count", 5))
    e = e.filter(F.col(scope).isNotNull())
    rows = e.withColumn("_vendor", match_key(F.col("vendor_name")))
    counted = rows.groupBy(scope, "_vendor").agg(F.count("*").alias("k"), F.min("_src_row").alias("first"))
    top = counted.groupBy(scope).agg(F.sum("k").alias("n"), F.max(F.when(F.col("_vendor").isNotNull(), F.struct("k", -F.col("first"), F.col("_vendor").alias("v")))).alias("top"))
    hit = top.filter((F.col("n") >= least) & (F.col("top.k") >= least) & (F.col("top.k") >= F.col("n") * float(p.get("vendor_concentration_share", 0.6))))
    right = sent(hit.select(F.col(scope).alias("_s"), F.col("top.v").alias("_v")))
    return members(rows.join(right, (F.col(scope) == F.col("_s")) & (F.col("_vendor") == F.col("_v")), "left_semi"), scope)


def apply_status_filter(e: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(analysed, left out): include wins over exclude, rows without a status stay."""
    if "status" not in e.columns or not (include or exclude):
        return e, e.filter("false")
    key = match_key(F.col("status"))
    wanted = [w.lower() for w in (include or exclude)]
    keep = key.isNull() | (key.isin(wanted) if include else ~key.isin(wanted))
    return e.filter(keep), e.filter(~keep)


def resubmitted(e: DataFrame, rejected: DataFrame, p: Policy) -> DataFrame:
    """resubmit-after-rejection-amount-increase: (rejected_row, _src_row, amount) of later claims of one employee,
    type and vendor with a larger amount within the window; either_direction also takes earlier ones."""
    keys = ["employee_id", "expense_type", "vendor_name"]
    r = rejected.select(F.col("_src_row").alias("rejected_row"), F.col("amount").alias("r_amount"), F.col("expense_date").alias("r_date"), *keys)
    gap = F.datediff("expense_date", "r_date")
    window = int(p.get("resubmit_window_days", 90))
    near = F.abs(gap) <= window if p.get("either_direction") else gap.between(0, window)
    return e.join(r, keys).filter((F.col("amount") > F.col("r_amount")) & near & F.lit(window > 0)).select("rejected_row", "_src_row", "amount")


@rule("shared-voucher-multiple-employees", 4, "strong", switch="shared_voucher_check", needs=("pnr",))
def shared_voucher(e: DataFrame, p: Policy) -> DataFrame:
    rows = e.withColumn("_pnr", match_key(F.col("pnr")))
    return members(in_groups(rows, "_pnr", extra=differ("employee_id") & filled("_pnr")), "_pnr")


@rule("voucher-incomplete", 2, "weak", switch="voucher_completeness_check")
def voucher_incomplete(e: DataFrame, p: Policy) -> DataFrame:
    """Rows without an invoice number, or, if all have one, without an invoice date."""
    blank = lambda c: F.col(c).isNull() if c in e.columns else F.lit(True)
    some = F.coalesce(e.agg(F.bool_or(blank("invoice_number"))).scalar(), F.lit(False))
    return members(e.filter(F.when(some, blank("invoice_number")).otherwise(blank("invoice_date"))))


@rule("ticket-number-reused", 4, "strong", switch="voucher_consistency_check", needs=("ticket_number",))
def ticket_reused(e: DataFrame, p: Policy) -> DataFrame:
    rows = e.withColumn("_ticket", match_key(F.col("ticket_number")))
    return members(in_groups(rows, "_ticket", extra=filled("_ticket")), "_ticket")


@rule.each("ticket-issue-after-flight", 3, "moderate", switch="voucher_consistency_check", needs=("issue_date",), key=())
def issued_after(e: DataFrame, p: Policy) -> F.Column:
    return F.col("issue_date") > F.col("expense_date")


@rule("itinerary-segment-conflict", 3, "moderate", switch="voucher_consistency_check", needs=("pnr", "origin_city", "dest_city"))
def itinerary_conflict(e: DataFrame, p: Policy) -> DataFrame:
    route = F.concat_ws(">", F.coalesce(match_key(F.col("origin_city")), F.lit("")), F.coalesce(match_key(F.col("dest_city")), F.lit("")))
    rows = e.withColumn("_pnr", match_key(F.col("pnr"))).withColumn("_route", F.nullif(route, F.lit(">")))
    found = in_groups(rows, "_pnr", "expense_date", extra=differ("_route") & filled("_pnr"))
    return members(found.filter("_route IS NOT NULL"), "_pnr", "expense_date")


def is_lodging(p: Policy) -> F.Column:
    return contains_any(F.col("expense_type"), list(p.get("lodging_types") or LODGING))


def lodging(e: DataFrame, p: Policy) -> DataFrame:
    return e.filter(is_lodging(p))


def consecutive_days(e: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs of consecutive distinct dates: keys, first_day, last_day, n_days of at least `least`."""
    days = e.select(*keys, "expense_date").distinct()
    runs = islands(days, keys, day(), [F.col("expense_date")])
    return runs.groupBy(*keys, "_run").agg(F.min("expense_date").alias("first_day"), F.max("expense_date").alias("last_day"), F.count("*").alias("n_days")).filter(F.col("n_days") >= least).drop("_run")


@rule("consecutive-nightly-invoicing", 3, "moderate", switch="lodging_cross_check", needs=("expense_type",))
def nightly(e: DataFrame, p: Policy) -> DataFrame:
    rows = lodging(e, p)
    runs = consecutive_days(rows, ["employee_id"], int(p.get("lodging_min_nights", 3))).withColumnRenamed("employee_id", "_emp")
    hit = rows.join(runs, (F.col("employee_id") == F.col("_emp")) & F.col("expense_date").between(F.col("first_day"), F.col("last_day")))
    return members(hit, "employee_id", "first_day")


@rule("same-amount-no-invoice", 3, "moderate", switch="lodging_cross_check", needs=("expense_type", "vendor_name", "invoice_number"))
def same_amount(e: DataFrame, p: Policy) -> DataFrame:
    rows = lodging(e, p).withColumn("_vendor", match_key(F.col("vendor_name"))).filter("_vendor IS NOT NULL").withColumn("_cents", F.col("amount").cast("decimal(18,2)"))
    keys = ("employee_id", "_vendor", "_cents")
    return members(in_groups(rows, *keys, least=int(p.get("lodging_same_amount_min_count", 3)), extra=F.bool_and(F.col("invoice_number").isNull())), *keys)


@rule.each("lodging-night-mismatch", 3, "moderate", switch="lodging_cross_check", needs=("expense_type", "check_in", "check_out", "nights"))
def night_mismatch(e: DataFrame, p: Policy) -> F.Column:
    between = F.datediff("check_out", "check_in")
    return is_lodging(p) & (between > 0) & (F.col("nights").cast("int") != between)


@rule.each("weekday-mismatch", 3, "moderate", switch="weekday_check", needs=("weekday",))
def weekday_mismatch(e: DataFrame, p: Policy) -> F.Column:
    return weekday_of(F.col("weekday")) != F.weekday("expense_date")


@rule.each("row-limit-exceeded", 3, "strong", switch="row_limit_check", needs=("row_limit",))
def row_limit(e: DataFrame, p: Policy) -> F.Column:
    value = F.coalesce(F.col("unit_price"), F.col("amount")) if "unit_price" in e.columns else F.col("amount")
    return (F.col("row_limit") > 0) & (value > F.col("row_limit") * (1 + float(p.get("row_limit_tolerance", 0))))


def transport(e: DataFrame) -> DataFrame:
    return e.filter(F.lower(F.trim("expense_type")).isin(*TRANSPORT))


def stays_and_journeys(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays, journeys), each (employee_id, city, at, _src_row): when lodging was left, and when journeys departed."""
    row = lambda df, city, at: df.select("employee_id", F.col(city).alias("city"), F.col(at).alias("at"), "_src_row").dropna()
    return row(e, "dest_city", "check_out_at"), row(transport(e), "origin_city", "depart_at")


def stay_conflicts(e: DataFrame) -> DataFrame:
    """(stay, n_journeys, journey): the stays before whose end their person departs from their city, how often, and the
    last such journey (of several at one time the smallest row). A row for each stay, however many journeys.

    Departures are swept in time order, within a person's and city's day and over its days, of which only counts
    and last departures meet; no stay is joined to journeys."""
    stays, journeys = stays_and_journeys(e)
    group = ["employee_id", "city"]
    both = stays.withColumn("gone", F.lit(0)).unionByName(journeys.withColumn("gone", F.lit(1))).withColumn("date", F.to_date("at"))
    departure = F.when(F.col("gone") == 1, F.struct("at", (-F.col("_src_row")).alias("row")))
    days = both.groupBy(*group, "date").agg(F.sum("gone").alias("n"), F.max(departure).alias("last"))
    earlier = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*group, "date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.max("last").over(earlier).alias("last"))
    inner = Window.partitionBy(*group, "date").orderBy("at", "gone").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.join(days, [*group, "date"]).withColumn("n_journeys", F.sum("gone").over(inner) + F.col("n")).withColumn("last", F.coalesce(F.max(departure).over(inner), F.col("last")))
    return swept.filter("gone = 0 AND n_journeys > 0").select(F.col("_src_row").alias("stay"), "n_journeys", (-F.col("last.row")).alias("journey"))


def stay_pairs(e: DataFrame) -> DataFrame:
    """(stay, journey): every stay and journey of stay_conflicts, as many as a person's stays times journeys."""
    stays, journeys = stays_and_journeys(e)
    s, j = stays.withColumnsRenamed({"at": "left", "_src_row": "stay"}), journeys.withColumnsRenamed({"_src_row": "journey"})
    return s.join(j, ["employee_id", "city"]).filter("at < left").select("stay", "journey")


@rule("checkout-before-transport", 4, "strong", needs=("expense_type", "check_out_at", "depart_at", "origin_city", "dest_city"))
def checkout_after_departure(e: DataFrame, p: Policy) -> DataFrame:
    """A stay and a journey of one person from the city of the stay that departs before the stay is over, both rows
    members: one finding for each such stay, with its last such journey; with all_pairs one for each pair."""
    found = stay_pairs(e) if p.get("all_pairs") else stay_conflicts(e)
    pairs = found.select(F.concat_ws("-", "stay", "journey").alias("_pair"), F.explode(F.array_distinct(F.array("stay", "journey"))).alias("_row"))
    return members(e.join(pairs, F.col("_src_row") == F.col("_row")), "_pair")


def overlaps(rows: DataFrame, key: str, start: str, end: str, span_seconds: int) -> DataFrame:
    """(row_a, row_b) of one key each of which begins before the other ends. Rows are dealt over buckets of
    span_seconds, each to all it touches, also where it ends before it begins; a pair counts in the bucket
    where the later one begins to touch."""
    cell = lambda c: F.floor(F.unix_timestamp(c) / span_seconds)
    r = rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select("_src_row", F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    r = r.withColumn("lo", cell(F.least("s", "e"))).withColumn("b", F.explode(F.sequence(F.col("lo"), cell(F.greatest("s", "e")))))
    a, b = r.select(*[F.col(c).alias(f"a_{c}") for c in r.columns]), r.select(*[F.col(c).alias(f"b_{c}") for c in r.columns])
    pairs = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_b") == F.col("b_b")))
    hit = pairs.filter((F.col("a__src_row") < F.col("b__src_row")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_b") == F.greatest("a_lo", "b_lo")))
    return hit.select(F.col("a__src_row").alias("row_a"), F.col("b__src_row").alias("row_b"))


@rule("segment-overlap", 4, "strong", needs=("expense_type", "depart_at", "arrive_at"))
def segment_overlap(e: DataFrame, p: Policy) -> DataFrame:
    pairs = overlaps(transport(e), "employee_id", "depart_at", "arrive_at", 6 * 3600)
    key = F.concat_ws("-", "row_a", "row_b")
    both = pairs.select(key.alias("_pair"), F.explode(F.array("row_a", "row_b")).alias("_row"))
    return members(e.join(both, F.col("_src_row") == F.col("_row")), "_pair")


def approval_coverage(e: DataFrame) -> DataFrame:
    """One row: the shares of approvers and of employee ids with Chinese characters, and hint, whether ids and
    names stand against each other, so that self-approval cannot be seen."""
    named = F.bool_or(F.col("employee_name").isNotNull()) if "employee_name" in e.columns else F.lit(False)
    han = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.col(c).rlike("[一-鿿]").cast("double")))
    shares = e.agg(han("approver").alias("approvers"), han("employee_id").alias("employees"), F.coalesce(named, F.lit(False)).alias("named"))
    return shares.select("approvers", "employees", F.coalesce((F.col("approvers") >= 0.6) & (F.col("employees") <= 0.2) & ~F.col("named"), F.lit(False)).alias("hint"))
