"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import A_Z, a_z, table

_LOWER = str.maketrans(A_Z, a_z)
_TOKEN = re.compile(r"[a-z0-9]+")
#: Rules travel to every task inside the function, so their number is checked.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A rule of either kind. With `site` (like www.example.com/en/) it fits that host, whatever its case,
    and its subdomains where the path starts with the rest, in the same case; otherwise `pattern` is
    searched, ASCII case ignored, in the whole URL."""

    verdict: str
    site: str | None = None
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.site if self.site is not None else self.pattern

    @property
    def regex(self) -> str:
        if self.site is None:
            return self.pattern
        host, _, path = self.site.partition("/")
        host = host.translate(_LOWER)
        return rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path) if '/' in self.site else '(?=/|$)'}"


#: Production rules of the query: the stated sites, then patterns of pages without prose.
SITES = (Rule("allow", site="com/"), Rule("block", site="example.com/en/"), Rule("allow", site="www.example.com/en/"), Rule("block", site="net/es/"), Rule("block", site="net/fr/"))
PAGES = ("login", "signin", "logout", "register", "cart", "checkout", "unsubscribe")
FILES = ("exe", "zip", "apk", "iso", "torrent")
TOPICS = ("casino", "porn", "viagra", "xxx")
PATTERNS = (
    *(Rule("block", pattern=rf"/{x}(?:[/?#.]|$)") for x in PAGES),
    *(Rule("block", pattern=rf"\.{x}(?:[?#]|$)") for x in FILES),
    *(Rule("block", pattern=rf"[/.\-_]{x}(?:[/.\-_]|$)") for x in TOPICS),
)


#: Parts of a pattern: escapes, classes, flat groups, quantifiers, single characters.
_PART = re.compile(r"\\.|\[\^?\]?(?:[^\]\\]|\\.)*\]|\(\?:(?:[^()\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])*\)|[*+?]|\{[^}]*\}|.", re.DOTALL)


def _separates(part: str) -> bool:
    """Whether a part of a pattern matches only where a token ends: separators, anchors, and groups of
    which every alternative begins and ends with one."""
    if part in ("^", "$", r"\A", r"\Z", r"\b"):
        return True
    if part.startswith("(?:"):
        ways = [_PART.findall(x) for x in part[3:-1].split("|")]
        return all(len(w) == 1 and _separates(w[0]) for w in ways)
    if part.startswith("["):
        inner = re.sub(r"\\[^A-Za-z0-9]", "", part[1:-1])  # without its escaped marks
        return not inner.startswith("^") and not re.search(r"[A-Za-z0-9\\]|.-.", inner)
    if part.startswith("\\"):
        return not part[1].isalnum()
    return len(part) == 1 and part not in "*+?.()|{}" and not (part.isascii() and part.isalnum())


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every match holds whole: alphanumeric runs of the pattern between separators. None are
    given for patterns with alternatives or nested groups outside flat ones."""
    parts = _PART.findall(pattern)
    if any(x in ("(", ")", "|") for x in parts):
        return []
    found, run, open_left = [], "", False
    for k, part in enumerate([*parts, "."]):
        after = parts[k + 1] if k + 1 < len(parts) else ""
        if part in ("*", "+", "?") or part.startswith("{"):
            continue
        loose = after in ("*", "?") or after.startswith("{")
        literal = len(part) == 1 and part.isascii() and part.isalnum()
        if literal and not loose and after != "+":
            run += part.lower()
            continue
        ends = not literal and not loose and _separates(part)
        if run and open_left and ends:
            found.append(run)
        run, open_left = "", ends
    return [t for t in dict.fromkeys(found) if _TOKEN.fullmatch(t)]


class RuleIndex:
    """Rules by their rarest token. Rules without a whole literal token are tried on every URL."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules = [(i, r, re.compile(r.regex, re.ASCII | (re.IGNORECASE if r.site is None else 0))) for i, r in enumerate(rules)]
        self.by_token: dict[str, list] = {}
        self.always = []
        for entry in self.rules:
            tokens = rule_tokens(entry[1])
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, url: str) -> list:
        found = list(self.always)
        for token in set(_TOKEN.findall(url.translate(_LOWER))) & self.by_token.keys():
            found += self.by_token[token]
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, the longest fitting site rule, the verdict, the first fitting pattern."""
        host, path = split_url(url)
        text, site, pattern = url or "", None, None
        for i, rule, regex in self.candidates(text):
            if rule.site is not None:
                if host + path and regex.search(host + path) and (site is None or (len(rule.site), -i) > (len(site[1].site), -site[0])):
                    site = (i, rule)
            elif (pattern is None or i < pattern[0]) and regex.search(text):
                pattern = (i, rule)
        deciding = site or pattern
        return host, path, site and site[1].site, deciding[1].verdict if deciding else "allow", pattern and pattern[1].pattern


def rule_tokens(rule: Rule) -> list[str]:
    if rule.site is None:
        return literal_tokens(rule.pattern)
    host, slash, path = rule.site.partition("/")
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    return list(dict.fromkeys(_TOKEN.findall(host.translate(_LOWER)) + _TOKEN.findall(whole.translate(_LOWER))))


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def token_counts(df: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URL tokens of the whole table equal each token of the rules; as many rows as the rules
    have tokens come back."""
    wanted = sorted({t for r in rules for t in rule_tokens(r)})
    tokens = df.select(F.explode(F.regexp_extract_all(F.translate(F.col(url_col), A_Z, a_z), F.lit(r"[a-z0-9]+"), F.lit(0))).alias("t"))
    return {r["t"]: r["count"] for r in tokens.filter(F.col("t").isin(wanted)).groupBy("t").count().collect()} if wanted else {}


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = SITES + PATTERNS) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict, pattern.

    Only the two named columns are read. A null URL or one without :// has empty host and path, fits no
    site rule and is left to the patterns (null: allowed). Site rules decide before patterns; the
    longest decides among sites, the first listed among equally long ones and among patterns. Repeated
    rows are judged each by itself; an empty table gives none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is sent to every task and holds {MAX_RULES} at most")
    narrow = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    counts = token_counts(narrow, "url", rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            got = pd.DataFrame([index.judge(u) for u in batch["url"]], columns=["host", "path", "rule", "verdict", "pattern"], index=batch.index)
            yield pd.concat([batch[["id"]], got], axis=1)

    kind = narrow.schema["id"].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    out = narrow.withColumn("id", F.col("id").cast(through)).mapInPandas(run, f"id {through}, host string, path string, rule string, verdict string, pattern string")
    return out.select(F.col("id").cast(kind).alias(id_col), "host", "path", "rule", "verdict", "pattern")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL of op1_url_filter."""
    blocked = "|".join([f"/(?:{'|'.join(PAGES)})(?:[/?#.]|$)", rf"\.(?:{'|'.join(FILES)})(?:[?#]|$)", rf"[/.\-_](?:{'|'.join(TOPICS)})(?:[/.\-_]|$)"])
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    longest = sorted(SITES, key=lambda r: -len(r.site))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(*_parts(r))} THEN '{value(r)}'" for r in longest)
    pattern = " ".join(f"WHEN regexp_matches(coalesce(url, ''), '(?i){r.pattern}') THEN '{r.pattern}'" for r in PATTERNS)
    return rf"""WITH p AS (SELECT page_id, url,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{A_Z}', '{a_z}') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)
    SELECT page_id, host, path, {case(lambda r: r.site)} ELSE NULL END AS rule,
        {case(lambda r: r.verdict)} WHEN regexp_matches(coalesce(url, ''), '(?i){blocked}') THEN 'block' ELSE 'allow' END AS verdict,
        CASE {pattern} ELSE NULL END AS pattern FROM p"""


def _parts(rule: Rule) -> tuple[str, str]:
    host, slash, path = rule.site.partition("/")
    return host, slash + path
