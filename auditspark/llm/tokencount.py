"""Token counts by rank-synchronous array merging of byte-level BPE pre-tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, table

LIMIT = 512
#: Characters of pre-tokens merged at once, and pre-tokens whose counts a task remembers.
BATCH_CHARS, REMEMBERED = 2_000_000, 400_000
_NONE = np.int64(1) << 40
#: Letters, numbers and white space up to U+024F. Texts with later characters are
#: split by the tokenizer's own pre-tokenizer.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATER = re.compile("[^\x00-ɏ]")
_WORDS = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_LETTERS}{_NUMBERS}{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others, in order, for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merger:
    """Byte-level BPE as array operations. Merge rules are a sorted array of pair keys."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocab[symbol]
        self.n = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.n) + vocab[b] for a, b in merges], np.int64)  # below 2**32
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32), order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.path, self.own = path, None

    def split(self, text: str) -> list[str]:
        if not text.isascii() and _LATER.search(text):
            if self.own is None:
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return _WORDS.findall(text)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left * self.n + right).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token. All sequences lie end to end in one array; each round
        finds every sequence's lowest-rank pair, replaces all its occurrences there, from the left
        where they overlap, and takes finished sequences out."""
        out = np.zeros(len(tokens), np.int64)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        ids = np.flatnonzero(length)
        length = length[ids]
        while len(ids):
            start = np.cumsum(length) - length
            inner = np.ones(len(symbols), bool)
            inner[start + length - 1] = False
            rank = np.full(len(symbols), _NONE)
            at = np.flatnonzero(inner)
            rank[at] = self.ranked(symbols[at], symbols[at + 1])
            lowest = np.minimum.reduceat(rank, start)
            done = lowest == _NONE
            out[ids[done]] = length[done]
            chosen = np.flatnonzero((rank == np.repeat(lowest, length)) & (rank != _NONE))
            if len(chosen):
                fresh = np.ones(len(chosen), bool)
                fresh[1:] = np.diff(chosen) != 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
                symbols[chosen] = self.made[rank[chosen]]
            keep = np.repeat(~done, length)
            keep[chosen + 1] = False
            lost = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(~keep, out=lost[1:])
            length = (length - (lost[start + length] - lost[start]))[~done]
            symbols, ids = symbols[keep], ids[~done]
        return out


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens seen before."""

    def __init__(self, path: str):
        self.merger, self.known = Merger(path), {}

    def __call__(self, texts: list[str]) -> list[int]:
        special = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        pieces, extra = [], []
        for text in texts:
            parts = special.split(text) if special and "<" in text else [text]
            extra.append(len(parts) - 1)
            pieces.append([w for p in parts for w in self.merger.split(p)] if len(parts) > 1 else self.merger.split(text))
        fresh = set().union(*pieces).difference(self.known) if len(self.known) < REMEMBERED else None
        if fresh is None:
            self.known, fresh = {}, set().union(*pieces)
        fresh = list(fresh)
        self.known.update(zip(fresh, self.merger.counts([w.encode("utf-8") for w in fresh]).tolist(), strict=True))
        count = self.known.__getitem__
        return [n + sum(map(count, words)) for n, words in zip(extra, pieces, strict=True)]


def bounded(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts with about `chars` characters together, one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Only the two named columns are read. A null text counts as empty: 0 bytes, 0 tokens. Special
    strings inside a text are one token each, as the library's default has it. Whole texts count,
    however long; repeated rows count each by itself; ids, null ones too, pass unchanged; an empty table
    gives no row."""
    kind = df.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    narrow = df.select(F.col(id_col).cast(through).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = cached(("tokencount", path), lambda: Counter(path))
        for batch in batches:
            n = [x for texts in bounded(batch["_text"]) for x in counter(texts)]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in batch["_text"]]
            out = pd.DataFrame({id_col: batch[id_col], "n_bytes": size, "n_tokens": n})
            yield out.assign(over_limit=out["n_tokens"] > limit)

    return narrow.mapInPandas(run, f"`{id_col}` {through}, n_bytes long, n_tokens long, over_limit boolean").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
