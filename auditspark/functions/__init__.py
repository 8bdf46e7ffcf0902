"""Scalar functions over columns: text keys, numbers, dates, places and flags."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters a match key keeps beside letters and digits.
CJK = "一-鿿"


@F.arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Unicode compatibility form, which Spark has no function for."""
    if pc.all(pc.string_is_ascii(values), min_count=0).as_py():
        return values
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), which takes c apart once, however often f names it. Spark writes an expression out wherever a column
    of it is named, also in filters, so steps upon steps double."""
    return F.transform(F.array(c), f)[0]


def squeezed(c: Column) -> Column:
    """White space of any kind as single blanks, trimmed; empty text is null."""
    return once(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), lambda text: F.when(text != "", text))


def norm_text(c: Column) -> Column:
    return squeezed(nfkc(c.cast("string")))


def all_but(kept: str) -> str:
    """A character class of everything but digits, lower-case letters, CJK and the characters of `kept`, as ranges: Java
    tries these several times faster than a negated class that reaches beyond Latin."""
    out, begin = "", 0
    for first, last in sorted([("0", "9"), ("a", "z"), (CJK[0], CJK[-1]), *zip(kept, kept, strict=True), ("\U0010ffff", "")]):
        end = ord(first) - 1 if last else 0x10FFFF
        if begin <= end:
            out += f"\\x{{{begin:x}}}-\\x{{{end:x}}}"
        begin = max(begin, ord(last) + 1) if last else begin
    return f"[{out}]"


def match_key(c: Column, keep: str = "") -> Column:
    """Lower-case letters, digits and CJK only (and the characters of keep, such as @); null if none."""
    return F.nullif(F.regexp_replace(F.lower(c), f"{all_but(keep)}+", ""), F.lit(""))


def header_key(name: str) -> str:
    import re

    return re.sub(r"[\s_\-./\\]+", "", unicodedata.normalize("NFKC", name).lower())


def amount(c: Column) -> Column:
    """Numbers with grouping commas, currency signs and accounting brackets; null if none can be read."""

    def value(text: Column) -> Column:
        number = F.round(F.regexp_replace(text, r"[^0-9.+\-]", "").try_cast("double"), 6)
        sign = F.when(text.startswith("(") & text.endswith(")"), -1.0).otherwise(1.0)
        return once(number, lambda x: F.when(F.abs(x) != float("inf"), x * sign))

    return once(F.trim(c.cast("string")), value)


#: Date formats in the order they are tried, and their shapes.
DATES = (
    ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("yyyy.M.d", r"\d{4}[.]\d{1,2}[.]\d{1,2}"),
    ("yyyyMMdd", r"\d{8}"),
    ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
)


def date_value(c: Column, formats: tuple[tuple[str, str], ...] = DATES, chinese: bool = True) -> Column:
    """The date before any time of day, by the first format that reads it; null otherwise."""

    def usual(text: Column) -> list[Column]:
        return [F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(f))) for f, shape in formats]

    def read(whole: Column) -> Column:
        by_shape = once(F.regexp_extract(whole, r"^([^T\s]*)", 1), lambda text: F.coalesce(*usual(text)))
        if not chinese:
            return by_shape
        spelt = F.regexp_replace(F.regexp_extract(whole, r"^(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2})\s*日", 1), r"\s*[年月]\s*", "-")
        return F.coalesce(once(spelt, lambda text: F.when(text != "", F.try_to_timestamp(text, F.lit("yyyy-M-d")))), by_shape)

    return once(F.trim(c.cast("string")), read).cast("date")


def clock_time(c: Column) -> Column:
    """A timestamp where the text has a time of day; null for bare dates."""
    text = F.regexp_replace(F.trim(c.cast("string")), "T", " ")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy.M.d H:mm:ss", "yyyy.M.d H:mm")]
    return F.when(text.rlike(r"\d{1,2}:\d{2}"), F.coalesce(*tries))


def instant(c: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """(instant, warning): ISO text with an offset or Z as it is, other text in the assumed zone."""
    text = F.trim(c.cast("string"))
    has = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    naive = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(text, "T", " ")), zone)
    at = F.when(has, F.try_to_timestamp(text)).otherwise(naive)
    return at, F.when(at.isNull(), "unreadable time").when(~has, f"zone {zone} assumed")


def currency(c: Column, default: str = "CNY") -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)))


#: Names of weekdays, Monday first, and words before them.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
HAN_DAYS = ("一", "二", "三", "四", "五", "六", "日")
WEEK = "星期|礼拜|周|week"


def weekday_of(c: Column) -> Column:
    """0 for Monday to 6 for Sunday from Chinese or English names, with or without a word such as week before
    them; digits need one."""
    text = F.lower(F.trim(c))
    bare = F.trim(F.regexp_replace(text, f"^({WEEK})", ""))
    out = F.when(text.rlike(f"^({WEEK})") & bare.rlike("^0*[1-7]$"), bare.try_cast("int") - 1)
    for i, (en, han) in enumerate(zip(WEEKDAYS, HAN_DAYS, strict=True)):
        out = F.when((bare == han) | bare.startswith(en), i).otherwise(out)
    return F.when(bare == "天", 6).otherwise(out)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(a))


#: Words that say whether a swipe was in the office.
INSIDE = ("是", "y", "yes", "true", "1", "在公司", "公司", "内勤", "office")
OUTSIDE = ("否", "n", "no", "false", "0", "不在公司", "外勤", "外出", "field")


def office_verdict(flag: Column, lat: Column, lon: Column, place: Column, offices: list[tuple[float, ...]], keywords: list[str], radius: float = 1000.0) -> Column:
    """True or false by an explicit flag, else by the distance to the offices (latitude, longitude and, if
    other than `radius`, metres), else by a keyword of the place; null where nothing tells."""
    said = F.lower(F.trim(flag))
    by_flag = F.when(said.isin(*INSIDE), True).when(said.isin(*OUTSIDE), False)
    near = F.lit(None).cast("boolean")
    for a, b, *r in offices:
        one = haversine_m(lat, lon, F.lit(float(a)), F.lit(float(b))) <= (r[0] if r else radius)
        near = F.when(lat.isNotNull() & lon.isNotNull(), F.coalesce(near, F.lit(False)) | one)
    found = F.lit(False)
    for w in keywords:
        found = found | F.contains(place, F.lit(w))
    by_word = F.when(F.nullif(F.trim(place), F.lit("")).isNotNull(), found) if keywords else F.lit(None).cast("boolean")
    return F.coalesce(by_flag, near, by_word)


def contains_any(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(low.contains(w.lower()), F.lit(False))
    return out


def distinct_present(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def char_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams of the text without white space, sizes low to high. The text is cleaned and taken apart once,
    not for every n-gram."""
    chars = F.array(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""))
    of_size = lambda x, n: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.flatten(F.transform(chars, lambda x: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: of_size(x, n)))))


def csv_safe(c: Column) -> Column:
    """A quote before cells that a spreadsheet would run, plain numbers apart."""
    risky = c.rlike("^[=+\\-@\t\r]") & ~c.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


#: Texts that read like instructions to a program.
INJECTIONS = (
    r"忽略[^。；\n]{0,14}(指令|规则|提示词|设定|限制)",
    r"系统\s*(提示词|提示|prompt)",
    r"(?i)(ignore|disregard)\s+(all\s+)?(the\s+)?(previous|above|prior|earlier)?\s*(instructions?|prompts?|rules?)",
    r"(?i)ignore\s+todas\s+as\s+instru",
    r"(不要|无需|不必|勿)[^。；\n]{0,10}(向用户|在报告中)[^。；\n]{0,10}(说明|提及|披露|告知)",
    r"(?i)(do\s+not|don't|never)\s+(tell|notify|inform)\s+the\s+user",
    r"<!--",
    r"(?i)(发送|发到|send\s+it\s+to|email\s+to)[^。；\n]{0,20}@[A-Za-z0-9.-]+",
)


def injection_hint(c: Column) -> Column:
    """The first 40 characters of the first pattern's match; null if none matches."""
    return F.coalesce(*[F.substring(F.nullif(F.regexp_extract(c, p, 0), F.lit("")), 1, 40) for p in INJECTIONS])


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower))
