"""Quality rules: counted text rules, then bands of n-gram perplexity for each language."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, U64, checkpoint, frequent, mix, table

#: The model reads code points as they are, four at a time: three of CODE bits make a context of 63 bits.
ORDER, CODE = 4, 21
#: The weights of the most frequent n-grams, so many at most, are sent to every task; others are joined.
TOP = 1_000_000
#: N-grams that a counting task holds before it gives them out.
HELD = 2_000_000
#: Parts over which the rows of a language are dealt to meet what is known of the language.
SALTS = 64
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Half the width of a band: so many median deviations, and this over the root of the characters (the
#: mean of n characters varies by about 0.5 / sqrt(n)).
WIDTH, SHORT = 1.0, 2.5
STEP = 1000


def grams(lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character, a 64-bit hash of the language and the n-gram that ends there, the three
    characters before it packed, and its code point; then how many characters each text has. Texts
    begin after blanks."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.full(int(sizes.sum()) + (ORDER - 1) * len(codes), 32, U64)
    inside = np.zeros(len(flat), bool)
    at = 0
    for c in codes:
        at += ORDER - 1
        flat[at : at + len(c)] = c
        inside[at : at + len(c)] = True
        at += len(c)
    context = np.zeros(len(flat), U64)
    for back in range(1, ORDER):
        context[back:] |= flat[:-back] << U64(CODE * (back - 1))
    context, flat = context[inside], flat[inside]
    seed = U64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    key = mix(context * U64(BASE) + mix(flat + seed))
    return key.view(np.int64), context.view(np.int64), flat.astype(np.int32), sizes


class SortedWeights:
    """Weights of n-grams in two arrays, sorted by the n-grams' hashes and searched by bisection."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights = keys[order], weights[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, found) of each key; the weight of one that is not there is 0."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        each, back = np.unique(keys, return_inverse=True)  # in order, so that the search runs through the arrays once
        at = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)
        found = self.keys[at] == each
        return np.where(found, self.weights[at], 0.0)[back], found[back]


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    starts = (raw & 0xC0) != 0x80
    blank = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(data.count(bytes([b])) for b in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeated = 0
    if len(words) > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
        w = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(w)]
            w ^= w >> np.uint64(29)
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), int(starts.sum()) - blank, symbols, len(lines) - len(set(lines)), repeated


def count_grams(narrow: DataFrame) -> DataFrame:
    """(lang, context, last, key, n): counts of n-grams over all texts, summed in each task before the
    shuffle; a task holds HELD of them at a time."""

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, context, last, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, found = pd.factorize(key)
        first = np.empty(len(found), np.int64)
        first[code[::-1]] = np.arange(len(key))[::-1]
        return found, context[first], last[first], np.bincount(code, weights=n, minlength=len(found)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in chunks(part["text"]):
                    key, context, last, _ = grams(lang, texts)
                    new = summed([(key, context, last, np.ones(len(key), np.int64))])
                    held[lang] = summed([held[lang], new]) if lang in held else new
                    if sum(len(x[0]) for x in held.values()) > HELD:
                        yield from emitted(held)
        yield from emitted(held)

    def emitted(held: dict) -> Iterator[pd.DataFrame]:
        while held:
            lang, (key, context, last, n) = held.popitem()
            yield pd.DataFrame({"lang": lang, "context": context, "last": last, "key": key, "n": n})

    counted = narrow.select("lang", "text").mapInPandas(run, "lang string, context long, last int, key long, n long")
    return counted.groupBy("lang", "context", "last").agg(F.min("key").alias("key"), F.sum("n").alias("n"))


def chunks(texts, chars: int = 400_000) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def by_language(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with known(lang, ...), a row a language. The rows of a language are dealt over SALTS parts,
    so that no task gets a whole language."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(SALTS)).cast("int"))
    return dealt.join(known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "_salt"], how).drop("_salt")


def cuts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): discounts of counts 1, 2 and 3 or more of each language, from its counts of counts; fixed ones
    where these fail."""
    n1, n2, n3, n4 = (F.col(f"_n{k}") for k in (1, 2, 3, 4))
    of = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"_n{k}") for k in (1, 2, 3, 4)])
    y = n1 / (n1 + 2 * n2)
    full = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    got = [F.when(full, F.greatest(F.lit(0.0), F.least(F.lit(k - 0.01), k - (k + 1) * y * b / a))).otherwise(k / 2) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return of.select("lang", *[d.alias(f"d{k}") for k, d in enumerate(got, 1)])


def train(narrow: DataFrame) -> DataFrame:
    """narrow(lang, text) -> (key, n, logp): how often each n-gram of each language occurs, and log10 of the probability that interpolated modified Kneser-Ney
    smoothing gives its last character, by the n-gram's hash.

    Every language has its own counts of its own characters. Each order is a table of its n-grams, joined
    with the next lower one, so the model grows with the data and no task holds a language. As the
    texts that are scored are those that are counted, n-grams of the highest order are all that is
    looked up."""
    rest = F.shiftleft(F.col("context").bitwiseAND(F.lit((1 << 2 * CODE) - 1)), CODE).bitwiseOR(F.col("last").cast("long"))
    tables = [checkpoint(count_grams(narrow).select("lang", "key", "context", rest.alias("rest"), "n"))]
    for n in range(ORDER - 1, 0, -1):  # below the highest order, how many characters precede the n-gram
        below = tables[0].groupBy("lang", F.col("rest").alias("key")).agg(F.count("*").alias("n"))
        tables.insert(0, checkpoint(below.select("lang", "key", F.shiftrightunsigned("key", CODE).alias("context"), F.col("key").bitwiseAND(F.lit((1 << (n - 1) * CODE) - 1)).alias("rest"), "n")))
    # All characters that a language has, and one that it has not, are alike below the lowest order.
    lower = tables[0].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("lower")).withColumn("rest", F.lit(0).cast("long"))
    for c in tables:
        lower = lower.select("lang", "rest", "lower")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        same = Window.partitionBy("lang", "context")
        c = by_language(c, cuts(c)).withColumn("cut", cut).withColumn("all", F.sum("n").over(same)).withColumn("weight", F.sum("cut").over(same) / F.col("all"))
        prob = F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("all") + F.col("weight") * F.col("lower")
        lower = c.join(lower, ["lang", "rest"]).select("lang", F.col("key").alias("rest"), "n", prob.alias("lower"))
    return lower.select(F.col("rest").alias("key"), "n", F.log10(F.greatest(F.col("lower"), F.lit(1e-12))).alias("logp"))


def scores(narrow: DataFrame, model: DataFrame, kind: str, top: int) -> DataFrame:
    """narrow(rid, id, lang, text) -> rid, id, lang, the measures of the text, n_chars, and logp, the sum over its
    n-grams by model(key, n, logp). The most frequent n-grams are added up in the scan of the texts, from sorted
    arrays; the others, which each text has few of, meet their weights in a join, sorted by hash in its parts."""
    got = frequent(model, "n", top).select("key", "logp").toArrow()
    held = narrow.sparkSession.sparkContext.broadcast(SortedWeights(got["key"].to_numpy(), got["logp"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logp, size = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            rest: list = [None] * len(batch)
            place = pd.Series(np.arange(len(batch)), index=batch.index)
            for lang, part in batch.groupby("lang"):
                at = place[part.index].to_numpy()
                for texts in chunks(part["text"]):
                    key, _, _, sizes = grams(lang, texts)
                    weight, found = held.value.find(key)
                    end = np.cumsum(sizes)
                    total = np.concatenate([[0.0], np.cumsum(weight)])
                    here, at = at[: len(texts)], at[len(texts) :]
                    logp[here], size[here] = total[end] - total[end - sizes], sizes
                    far = np.flatnonzero(~found)
                    cuts_ = np.searchsorted(far, np.append(0, end))
                    for i, a, b in zip(here.tolist(), cuts_[:-1].tolist(), cuts_[1:].tolist(), strict=True):
                        rest[i] = key[far[a:b]]
            out = pd.DataFrame([measures(t) for t in batch["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], index=batch.index)
            yield pd.concat([batch[["rid", "id", "lang"]], out], axis=1).assign(n_chars=size, logp=logp, rest=rest)

    schema = f"rid long, id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, logp double, rest array<long>"
    scored = checkpoint(narrow.mapInPandas(run, schema))
    asked = scored.select("rid", F.explode("rest").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("times"))
    told = asked.join(model.select("key", F.col("logp").alias("weight")), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("weight")).alias("more"))
    # Rows that repeat have one key, and so many times the sums.
    same = scored.groupBy("rid").agg(F.count("*").alias("same"))
    more = same.join(told, "rid").select(F.col("rid").alias("of"), (F.col("more") / F.col("same")).alias("more"))
    out = scored.drop("rest").join(more, F.col("rid") == F.col("of"), "left")
    return out.withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).drop("of", "more")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and then lang, n_chars, log_perplexity (log10 a character), band_low, band_high.

    Only the three named columns are read. Null text has no words and fails the base; null language is
    "und". Each language's band lies around the median over its documents that pass the base: WIDTH
    median deviations each way and, as short texts vary more, SHORT over the root of the length. Bands
    come from a histogram of the scores over all documents. Repeated rows are judged each by itself;
    an empty table gives no row."""
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    narrow = docs.select(F.xxhash64(F.col(id_col), lang, text).alias("rid"), F.col(id_col).cast(through).alias("id"), lang.alias("lang"), text.alias("text"))
    scored = checkpoint(scores(narrow, checkpoint(train(narrow)), through, top))
    scored = scored.withColumn("log_perplexity", -F.col("logp") / F.greatest(F.col("n_chars"), F.lit(1))).drop("logp")
    scored = scored.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = by_language(scored, band_centres(scored), "left")
    half = WIDTH * F.coalesce(F.col("deviation"), F.lit(0.05)) + SHORT / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    centre = F.coalesce(F.col("centre"), F.col("log_perplexity"))
    out = out.withColumn("band_low", centre - half).withColumn("band_high", centre + half)
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "n_chars", "log_perplexity", "band_low", "band_high")


def band_centres(scored: DataFrame) -> DataFrame:
    """(lang, centre, deviation): median and median absolute deviation of each language's scores, from
    a histogram in steps of 1 / STEP, so that a task holds buckets, not documents."""
    hist = scored.filter(~F.col("base_failed")).groupBy("lang", F.round(F.col("log_perplexity") * STEP).cast("long").alias("bucket")).agg(F.count("*").alias("n"))

    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        by = Window.partitionBy("lang")
        upto = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        at = rows.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(by))
        return at.filter(F.col("_upto") * 2 >= F.col("_all")).groupBy("lang").agg(F.min(value).alias(name))

    centre = median(hist, "bucket", "_centre")
    away = hist.join(centre, "lang").withColumn("_away", F.abs(F.col("bucket") - F.col("_centre")))
    away = away.groupBy("lang", "_centre", "_away").agg(F.sum("n").alias("n"))
    spread = median(away, "_away", "_spread")
    out = centre.join(spread, "lang")
    return out.select("lang", (F.col("_centre") / STEP).alias("centre"), (F.greatest(F.col("_spread"), F.lit(1)) / STEP).alias("deviation"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
