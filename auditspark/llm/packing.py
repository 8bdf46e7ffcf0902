"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, checkpoint, salted_rank, table, tasks
from .tokencount import byte_symbols

CAPACITY = 2048
#: Pieces that are packed together; islands of a block, their populations, and how they evolve.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4096, 3, 4, 2, 8
END = 0

#: Letters, numbers and white space up to U+024F, as the tokenizer's pattern has them.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATER = re.compile("[^\x00-ɏ]")
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")


class Encoder:
    """Token ids of texts. Every word is encoded by the library once and remembered, within a bound;
    texts with other scripts or special strings go to the library whole."""

    def __init__(self, path: str, remembered: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.known = Tokenizer.from_file(path), remembered, {}
        self.model, self.symbol = self.tokenizer.model, {b: c for c, b in byte_symbols().items()}

    def _encoded(self, word: str) -> bytes:
        """The ids of one word as the pattern cut it, from the library's merges alone: the word's bytes in
        the characters that stand for them need no further normalising or splitting."""
        symbols = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.symbol)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words: list[list[str] | None] = []
        for text in texts:
            low = text.lower()
            plain = "<|" not in text and (text.isascii() or not (_LATER.search(text) or _LATER.search(low)))
            words.append(_WORDS.findall(unicodedata.normalize("NFC", text).lower()) if plain else None)
        if len(self.known) > self.remembered:
            self.known = {}
        fresh = set().union(*(w for w in words if w)).difference(self.known)
        self.known.update((w, self._encoded(w)) for w in fresh)
        got, end = self.known.__getitem__, np.array([END], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(got, w)) + end if w is not None else np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END], "<u4").tobytes(), "<u4") for t, w in zip(texts, words, strict=True)]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each document, with the end id, cut into
    pieces of `capacity` and a shorter last one."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = cached(("packing", path), lambda: Encoder(path))
        for batch in batches:
            for _, part in batch.groupby(batch["text"].str.len().cumsum() // 400_000, sort=False):
                rows = [(d, i, a, min(capacity, len(x) - a), zlib.crc32(x[a : a + capacity].tobytes())) for d, x in zip(part["doc_id"], encode(list(part["text"])), strict=True) for i, a in enumerate(range(0, len(x), capacity))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    cut_ = narrow.withColumn("doc_id", F.col("doc_id").cast(through)).mapInPandas(run, f"doc_id {through}, piece int, start long, length long, ids_crc32 long")
    return cut_.withColumn("doc_id", F.col("doc_id").cast(kind))


class Bins:
    """Open bins by the room left in them. The rooms in use are bits of one integer, so that the bin
    that fits best is its lowest bit from the size on."""

    def __init__(self, capacity: int, bins: list[list[int]] = ()):
        self.capacity, self.used, self.by_room = capacity, 0, {}
        for b in bins:
            self.add(b)

    def add(self, b: list[int]) -> None:
        room = self.capacity - sum(b)
        self.by_room.setdefault(room, []).append(b)
        self.used |= 1 << room

    def fit(self, sizes: list[int]) -> None:
        for size in sizes:
            rooms = self.used >> size
            if not rooms:
                self.add([size])
                continue
            room = size + (rooms & -rooms).bit_length() - 1
            held = self.by_room[room]
            b = held.pop()
            if not held:
                self.used &= ~(1 << room)
            b.append(size)
            self.by_room.setdefault(room - size, []).append(b)
            self.used |= 1 << (room - size)

    def all(self) -> list[list[int]]:
        return [b for held in self.by_room.values() for b in held]


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the sum of squared fills."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def first_packing(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    """Best fit by decreasing size, with the sizes blurred by `noise` for the order."""
    bins = Bins(capacity)
    bins.fit(sorted(sizes, key=lambda s: -s * (1 + noise * rng.random())))
    return bins.all()


def crossover(mother: list[list[int]], father: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Injects a share of the father's best filled bins whole. Of the mother's bins, emptiest first, those
    that hold a duplicate of an injected document (one of its length) go, and the documents displaced
    with them are put where they fit best."""
    full = sorted(father, key=lambda b: -sum(b))
    chosen = [list(b) for b in full[: max(1, int(len(full) * rng.uniform(0.1, 0.6)))] if rng.random() < 0.7] or [list(full[0])]
    surplus = Counter(s for b in chosen for s in b)
    kept, displaced = [], []
    for b in sorted(mother, key=sum):
        if any(surplus[s] > 0 for s in b):
            for s in b:
                if surplus[s] > 0:
                    surplus[s] -= 1
                else:
                    displaced.append(s)
        else:
            kept.append(list(b))
    bins = Bins(capacity, kept + chosen)
    bins.fit(sorted(displaced, reverse=True))
    return bins.all()


def mutation(bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the worst filled bins and a few others, and refits their documents."""
    order = sorted(bins, key=sum)
    worst = max(1, len(order) // 50)
    out = {*range(worst), *(rng.randrange(len(order)) for _ in range(worst))}
    left = Bins(capacity, [list(b) for i, b in enumerate(order) if i not in out])
    left.fit(sorted((s for i in out for s in order[i]), reverse=True))
    return left.all()


def evolve(population: list[list[list[int]]], capacity: int, rng: random.Random, generations: int) -> list[list[list[int]]]:
    """Steady state: each child replaces the worst if it is better. Ends early at the lower bound."""
    bound = -(-sum(map(sum, population[0])) // capacity)
    scored = sorted(((fitness(p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for step in range(generations):
        if -scored[0][0][0] <= bound or len(scored) < 2:
            break
        a, b = rng.sample(range(len(scored)), 2)
        child = mutation(crossover(scored[max(a, b)][2], scored[min(a, b)][2], capacity, rng), capacity, rng)
        value = fitness(child, capacity)
        if value > scored[-1][0]:
            scored[-1] = (value, len(population) + step, child)
            scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for _, _, p in scored]


def dump(bins: list[list[int]]) -> bytes:
    return np.array([s for b in sorted(map(sorted, bins)) for s in (*b, 0)], np.int32).tobytes()


def load(blob: bytes) -> list[list[int]]:
    out, b = [], []
    for s in np.frombuffer(blob, np.int32).tolist():
        if s:
            b.append(s)
        else:
            out.append(b)
            b = []
    return out


def shares(counts: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The first rank, and the number, of each length's pieces that a block gets."""
    low = counts * block // blocks
    return low, counts * (block + 1) // blocks - low


def with_migrants(state: DataFrame) -> DataFrame:
    """The islands, and on each the elite of the island before it, alone."""
    return state.unionByName(state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("population", F.array("elite")))


def pack_lengths(spark: SparkSession, counts: np.ndarray, capacity: int = CAPACITY) -> DataFrame:
    """(length, rank, sequence_id, offset) for every rank below counts[length].

    Pieces of one length are interchangeable, so the lengths alone are packed. Every block gets its even
    share of each length, about BLOCK pieces, and is packed on ISLANDS islands: each evolves its own
    population, sends its elite to the next island after each epoch, and the best packing of the
    block's islands is taken. The work grows with the number of blocks, each bounded."""
    blocks = max(1, -(-int(counts.sum()) // BLOCK))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                block, island = divmod(int(i), ISLANDS)
                rng = random.Random(f"{block}/{island}")
                sizes = np.repeat(np.arange(len(counts)), shares(counts, block, blocks)[1]).tolist()
                first = [first_packing(sizes, capacity, rng, 0.0 if k + island == 0 else 0.05 * (k + 1)) for k in range(POPULATION)] if sizes else [[]]
                yield grown(block, island, 0, first, rng)

    def grown(block: int, island: int, epoch: int, population: list, rng: random.Random) -> pd.DataFrame:
        best = evolve(population, capacity, rng, GENERATIONS) if population[0] else population
        value = fitness(best[0], capacity)
        return pd.DataFrame([(block, island, epoch, value[0], value[1], dump(best[0]), [dump(p) for p in best])], columns=["block", "island", "epoch", "fewest", "fill", "elite", "population"])

    def go_on(rows: pd.DataFrame) -> pd.DataFrame:
        block, island, epoch = int(rows["block"][0]), int(rows["island"][0]), int(rows["epoch"].max()) + 1
        people = [p for _, r in rows.sort_values(["epoch", "elite"]).iterrows() for p in r["population"]]
        population = [load(p) for p in dict.fromkeys(people)]
        return grown(block, island, epoch, population, random.Random(f"{block}/{island}/{epoch}"))

    schema = "block long, island int, epoch int, fewest long, fill double, elite binary, population array<binary>"
    parts = min(blocks * ISLANDS, max(tasks(spark), blocks * ISLANDS // 8))
    state = spark.range(0, blocks * ISLANDS, 1, parts).mapInPandas(begin, schema)
    for _ in range(EPOCHS - 1):
        state = checkpoint(state)
        state = with_migrants(state).groupBy("block", "island").applyInPandas(go_on, schema)
    state = checkpoint(state)
    best = state.groupBy("block").agg(F.max_by("elite", F.struct("fewest", "fill", F.negative("island"))).alias("elite"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, elite in zip(batch["block"], batch["elite"], strict=True):
                low, n = shares(counts, int(block), blocks)
                flat = np.frombuffer(elite, np.int32).astype(np.int64)
                ends = flat == 0
                bin_no = np.cumsum(ends) - ends
                upto = np.cumsum(flat)
                starts = np.concatenate([[0], upto[:-1]])
                base = np.concatenate([[0], upto[ends]])[bin_no]
                length, sequence, offset = flat[~ends], bin_no[~ends], (starts - base)[~ends]
                order = np.argsort(length, kind="stable")
                use = np.empty(len(length), np.int64)
                sorted_lengths = length[order]
                use[order] = np.arange(len(length)) - np.searchsorted(sorted_lengths, sorted_lengths)
                yield pd.DataFrame({"length": length, "rank": low[length] + use, "sequence_id": int(block) * 2 * BLOCK + sequence, "offset": offset})

    return best.mapInPandas(placed, "length long, rank long, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) -> the same with sequence_id and offset.

    Pieces that fill a sequence stand alone, under negative ids; the others are packed by their lengths
    and joined with the places by length and rank. At most `capacity` counts come to the driver, and
    ranks of a hot length are dealt over salts. An empty table gives no row."""
    spark = pieces.sparkSession
    held = checkpoint(pieces)
    counts = np.zeros(capacity, np.int64)
    for r in held.filter(F.col("length") < capacity).groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    ranked = salted_rank(held, ["length"], ["doc_id", "piece", "start", "ids_crc32"])
    whole = ranked.filter(F.col("length") >= capacity).select(*held.columns, (-1 - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = pack_lengths(spark, counts, capacity)
    short = ranked.filter(F.col("length") < capacity).join(places.hint("merge"), ["length", "rank"]).select(*held.columns, "sequence_id", "offset")
    return whole.unionByName(short)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the two named columns are read. A null text is empty: one piece with the end id alone. Longer
    documents than `capacity` are cut, others stay whole; repeated rows are packed each by itself."""
    return pack(cut(docs, path, capacity, id_col, text_col), capacity)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
