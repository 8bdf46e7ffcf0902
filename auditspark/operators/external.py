"""Rules that hold the ledger against side tables. Each gives finding_key, _src_row and amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.functions import contains_any, match_key
from auditspark.plans import Policy, members

#: Words of expense types that are about travel, and of courier types.
TRAVEL = ("差旅", "出差", "住宿", "机票", "火车", "高铁", "市内交通", "交通费", "打车", "补贴")
COURIER = ("快递", "快递费", "courier", "物流", "运费")
#: Words of private addresses.
PRIVATE = ("小区", "花园", "公寓", "号院", "号楼", "幢", "单元")


def one_of_each(df: DataFrame, key: str, last: bool = False) -> DataFrame:
    """The first, or last, row of each key in source order. Aggregated by struct, so that a hot key's rows
    are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in (key, "_src_row")]
    pick = F.max if last else F.min
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct("_src_row", *rest)).alias("r")).select(key, "r.*")


def travel(p: Policy) -> dict:
    return p.get("travel_cross_check") or {}


def holds_any(c, words) -> F.Column:
    """Whether the text holds one of the words, in their own case."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(c, F.lit(w)), F.lit(False))
    return out


def away_from(p: Policy) -> F.Column:
    cities = list(travel(p).get("company_cities") or [])
    return F.col("dest_city").isNotNull() & ~(F.col("dest_city").isin(*cities) if cities else F.lit(False))


def travel_like(e: DataFrame, p: Policy) -> DataFrame:
    """Claims whose type holds a word of travel, or with a destination that is no company city."""
    return e.filter(holds_any(F.col("expense_type"), travel(p).get("travel_types") or TRAVEL) | away_from(p))


def without_travel_request(e: DataFrame, trips: DataFrame, p: Policy) -> DataFrame:
    """trips(employee_id, start_date, end_date): travel claims on days that no trip covers, give or take
    date_tolerance_days; a trip without an end is a day. Trips are spelt out by day, so that the anti join is an
    equi-join."""
    slack = int(travel(p).get("date_tolerance_days", 1) or 0)
    spans = trips.filter("start_date IS NOT NULL").select(F.col("employee_id").alias("_emp"), F.date_sub("start_date", slack).alias("lo"), F.date_add(F.coalesce("end_date", "start_date"), slack).alias("hi"))
    days = spans.filter("lo <= hi").select("_emp", F.explode(F.sequence("lo", "hi")).alias("_day")).distinct()
    return members(travel_like(e, p).join(days, (F.col("employee_id") == F.col("_emp")) & (F.col("expense_date") == F.col("_day")), "left_anti"), "_src_row")


def office_swipe(e: DataFrame, swipes: DataFrame, p: Policy) -> DataFrame:
    """swipes(employee_id, swipe_date, in_office): travel claims elsewhere on days with a swipe in the office."""
    away = travel_like(e, p).filter(away_from(p))
    inside = swipes.filter("in_office").select(F.col("employee_id").alias("_emp"), F.col("swipe_date").alias("_day"))
    return members(away.join(inside, (F.col("employee_id") == F.col("_emp")) & (F.col("expense_date") == F.col("_day")), "left_semi"), "_src_row")


def swipe_city_mismatch(e: DataFrame, swipes: DataFrame, vocabulary: list[str], p: Policy) -> DataFrame:
    """swipes(_src_row, employee_id, swipe_date, location): claims with a same-day swipe that names a known city
    other than the destination, and no company city. The city is the vocabulary's first in the text."""
    own = list(travel(p).get("company_cities") or [])
    words = F.array(*[F.lit(c) for c in dict.fromkeys([*own, *vocabulary])])
    city = F.get(F.filter(words, lambda c: F.contains(F.col("location"), c)), F.lit(0))
    placed = swipes.withColumn("_city", city).filter("_city IS NOT NULL")
    s = placed.select(F.col("employee_id").alias("_emp"), F.col("swipe_date").alias("_day"), "_city").distinct()
    claims = travel_like(e, p).filter(F.col("dest_city").isNotNull() & F.lit(bool(travel(p).get("flag_city_mismatch", True))))
    bad = (F.col("_city") != F.col("dest_city")) & ~F.col("_city").isin(*(own or [""]))
    return members(claims.join(s, (F.col("employee_id") == F.col("_emp")) & (F.col("expense_date") == F.col("_day")) & bad, "left_semi"), "_src_row")


def days_without_swipe(trips: DataFrame, swipes: DataFrame) -> DataFrame:
    """The first day of each trip(_src_row, employee_id, start_date, end_date) without a swipe."""
    days = trips.filter("start_date <= end_date").select("_src_row", "employee_id", F.explode(F.sequence("start_date", "end_date")).alias("day"))
    s = swipes.select("employee_id", F.col("swipe_date").alias("day")).distinct()
    return days.join(s, ["employee_id", "day"], "left_anti").groupBy("_src_row", "employee_id").agg(F.min("day").alias("first_missing"))


def travel_verification(e: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mismatch, not_found, unverified) against checks(expense_id, flight_no, flight_date, origin_city, dest_city,
    passenger), of which the last for an id counts. A mismatch lists what differs in `differs`."""
    v = one_of_each(checks, "expense_id", last=True).drop("_src_row")
    v = v.select("expense_id", *[F.col(c).alias(f"v_{c}") for c in ("flight_no", "flight_date", "origin_city", "dest_city", "passenger")])
    j = e.join(v, "expense_id")
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    key = lambda c: match_key(F.col(c))
    whole = F.col("origin_city").isNotNull() & F.col("dest_city").isNotNull() & F.col("v_origin_city").isNotNull() & F.col("v_dest_city").isNotNull()
    parts = [
        F.when(differs(key("flight_no"), key("v_flight_no")), "flight"),
        F.when(differs(F.col("expense_date"), F.col("v_flight_date")), "date"),
        F.when(~whole, None).when((key("origin_city") == key("v_dest_city")) & (key("dest_city") == key("v_origin_city")) & (key("origin_city") != key("dest_city")), "reversed").when((key("origin_city") != key("v_origin_city")) | (key("dest_city") != key("v_dest_city")), "route"),
        F.when(F.col("v_passenger").isNotNull() & ~F.coalesce(key("v_passenger") == key("employee_id"), F.lit(False)) & ~F.coalesce(key("v_passenger") == key("employee_name"), F.lit(False)), "passenger"),
    ]
    empty = F.coalesce(*[F.col(f"v_{c}").cast("string") for c in ("flight_no", "flight_date", "origin_city", "dest_city", "passenger")]).isNull()
    j = j.withColumn("differs", F.array_compact(F.array(*parts)))
    mismatch = j.filter(~empty & (F.size("differs") > 0)).select(F.col("_src_row").cast("string").alias("finding_key"), "_src_row", "amount", "differs")
    return mismatch, members(j.filter(empty)), e.join(v, "expense_id", "left_anti")


def payee_mismatch(e: DataFrame, payments: DataFrame) -> DataFrame:
    """payments(_src_row, expense_id, issuer, payee), the first of each id: issuer, else vendor, and payee differ."""
    p = one_of_each(payments, "expense_id").select("expense_id", "issuer", "payee")
    j = e.join(p, "expense_id").withColumn("_by", F.coalesce(match_key(F.col("issuer")), match_key(F.col("vendor_name"))))
    return members(j.filter(F.col("_by") != match_key(F.col("payee"))), "_src_row")


def above_market(e: DataFrame, refs: DataFrame, p: Policy) -> DataFrame:
    """refs(_src_row, item, unit, unit_price, max_price): claims whose unit price, else amount, is above the first
    fitting reference's highest price, else price, by more than the tolerance; units agree where both have one."""
    tolerance = float(p.get("price_tolerance", 0.30))
    r = refs.select(F.col("_src_row").alias("_ref"), match_key(F.col("item")).alias("_item"), match_key(F.col("unit")).alias("_unit"), F.coalesce("max_price", "unit_price").alias("_price")).filter("_price > 0")
    item = F.coalesce(match_key(F.col("item")), match_key(F.col("expense_type")))
    value = F.coalesce(F.col("unit_price"), F.col("amount"))
    j = e.join(r, (item == F.col("_item")) & (match_key(F.col("unit")).isNull() | F.col("_unit").isNull() | (match_key(F.col("unit")) == F.col("_unit"))) & (value > F.col("_price") * (1 + tolerance)))
    return j.groupBy("_src_row").agg(F.first("amount").alias("amount"), F.min(F.struct("_ref", "_price")).alias("ref")).select(F.col("_src_row").cast("string").alias("finding_key"), "_src_row", "amount", F.col("ref._ref").alias("ref_row"), F.col("ref._price").alias("ref_price"))


def shipment_amounts(e: DataFrame, shipments: DataFrame, p: Policy) -> DataFrame:
    """Claims whose shipments(expense_id, amount) add up to another amount. Sums come before the join."""
    sums = shipments.groupBy("expense_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("shipped"))
    j = e.join(sums, "expense_id")
    return j.filter(F.abs(F.col("shipped") - F.col("amount").cast("decimal(18,2)")) > F.lit(p.get("shipment_amount_tolerance", 0.01)).cast("decimal(18,2)")).select(F.col("_src_row").cast("string").alias("finding_key"), "_src_row", "amount", F.col("shipped").cast("double").alias("shipped"))


def shipment_without_tracking(e: DataFrame, shipments: DataFrame) -> DataFrame:
    lost = shipments.filter("tracking_no IS NULL").select("expense_id").distinct()
    return members(e.join(lost, "expense_id", "left_semi"))


def private_address(e: DataFrame, shipments: DataFrame, p: Policy) -> DataFrame:
    """Claims with a shipment from or to an address that reads like a home."""
    columns = [c for c in ("from_addr", "to_addr", "address") if c in shipments.columns]
    home = F.lit(False)
    for c in columns:
        home = home | holds_any(F.col(c), p.get("private_address_keywords") or PRIVATE)
    return members(e.join(shipments.filter(home).select("expense_id").distinct(), "expense_id", "left_semi"), "_src_row")


def courier_coverage(e: DataFrame, shipments: DataFrame, p: Policy) -> DataFrame:
    """One row: courier claims, and how many have no shipment."""
    words = [w.lower() for w in p.get("shipment_types") or COURIER]
    claims = e.filter(holds_any(F.lower("expense_type"), words))
    known = shipments.filter("expense_id IS NOT NULL").select("expense_id").distinct().withColumn("_known", F.lit(True))
    return claims.join(known, "expense_id", "left").agg(F.count("*").alias("claims"), F.count_if(F.col("_known").isNull()).alias("unmatched"))


def coverage(e: DataFrame, side: DataFrame) -> DataFrame:
    """One row: claims with and without a row in the side table(expense_id)."""
    known = side.select("expense_id").distinct().withColumn("_known", F.lit(True))
    return e.join(known, "expense_id", "left").agg(F.count("_known").alias("matched"), F.sum(F.col("_known").isNull().cast("long")).alias("unmatched"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
