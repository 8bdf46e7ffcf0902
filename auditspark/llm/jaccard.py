"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, checkpoint, mix, sieved, table
from .graph import components
from .shingles import fingerprint, shingle_sets

SIZE, PERCENT = 4, 85
#: Small sets are signed by subsets of so many shingles.
SUBSET = 3
#: Shingles of the sets of one cluster, and sets, that a block takes; larger clusters have several blocks,
#: and two of them meet in a task.
TASK_SHINGLES, TASK_SETS = 200_000, 1_500


def spare(n, percent: int):
    """How many shingles of a set of n a set that links with it may lack."""
    return n - (percent * n + 99) // 100


def most_apart(n, percent: int):
    """How many shingles at most are in one of two linked sets only, one of them of n shingles."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


@functools.cache
def subset_sizes(n: int, percent: int) -> tuple[int, ...]:
    """The sizes of the subsets by which a set of n shingles finds all sets that it may link with.

    Lay the shingles that two linked sets share, in any one order, along a line: at most d shingles of either
    set alone fall between them. If (d + 1)(k - 1) + 1 are shared, some k of them follow each other in
    both sets with nothing between. Most sizes allow k = SUBSET; pairs of the smallest sets, and of
    sets that may differ much, take what they allow."""
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    both = -(-percent * (n + m) // (100 + percent))
    return tuple(np.unique(np.clip(1 + (both - 1) // (n + m - 2 * both + 1), 1, SUBSET)).tolist())


def subset_signatures(tokens: np.ndarray, size: int) -> np.ndarray:
    """One hash for each `size` tokens that follow each other."""
    t = tokens.view(U64)
    count = max(0, len(t) - size + 1)
    h = np.full(count, size, U64)
    for i in range(size):
        h = mix(h * U64(3) + mix(t[i : i + count] + U64(i)))
    return h.view(np.int64)


def classes(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n, cid, head): a hash of the row's id and text, the size of each row's set, 64 bits of its fingerprint, and its first
    shingles in the order of their hashes, as many as survivors() needs."""
    kind = docs.schema[id_col].dataType.simpleString()
    through = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make floats of integers beside nulls
    narrow = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).cast(through).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(list(part["text"]), size)
                n = np.array([len(s) for s in sets])
                head = spare(n, percent) + np.maximum(1, spare(n, percent) // 2)
                yield pd.DataFrame({"rid": part["rid"], "doc_id": part["doc_id"], "n": n, "cid": [class_id(s) for s in sets], "head": [s[:k].view(np.int64) for s, k in zip(sets, head, strict=True)]})

    return narrow.mapInPandas(run, f"rid long, doc_id {through}, n long, cid long, head array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))


def row_key(id_col: str, text_col: str) -> F.Column:
    """A key that only rows of the same id and text share."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(fingerprint(s)[:8], "little", signed=True)


def slices(batch: pd.DataFrame, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    for _, part in batch.groupby(batch["text"].str.len().fillna(0).cumsum() // chars, sort=False):
        yield part


def survivors(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """rows(cid, n, head), held(cid, n, ...) -> held of the sets that may link with another.

    Two sets that link share all but spare(n) shingles of either, so the first L they share, in any one
    order, lie among the first spare(n) + L of each. With L half of spare(n), a set survives if so
    many of its head's shingles are in another head; the L of the smallest partner counts. A shingle
    is alone if the smallest and the largest set that have it are one, which copies do not change:
    heads need no grouping by set, and no list of sets is ever formed."""
    tokens = rows.select("cid", F.explode("head").alias("token"))
    alone = tokens.groupBy("token").agg(F.min("cid").alias("cid"), F.max("cid").alias("other")).filter("cid = other")
    alone = alone.groupBy("cid").agg(F.count("*").alias("alone"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    slack = F.col("n") - least
    head = F.least(F.col("n"), slack + F.greatest(F.lit(1), F.floor(slack / 2)))
    rest = F.floor((least - F.floor((least * percent + 99) / 100)) / 2)
    return held.join(alone, "cid", "left").filter(head - F.coalesce("alone", F.lit(0)) >= F.greatest(F.lit(1), rest)).drop("alone")


def fetch_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, n, tokens) of the wanted(cid, rid): the sets again, from the text of the rows rid. A row key is never
    null and names one text, so a set is fetched from one text, whatever ids are null or shared."""
    narrow = docs.select(row_key("doc_id", "text").alias("rid"), F.col("text"))
    keys = wanted.select("rid", F.col("cid").alias("wanted"))
    texts = sieved(narrow, "rid", keys).filter("maybe").drop("maybe").join(keys, "rid").dropDuplicates(["rid"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                rows = [(w, len(s), s.view(np.int64)) for w, s in zip(part["wanted"], shingle_sets(list(part["text"]), size), strict=True) if class_id(s) == w]
                yield pd.DataFrame(rows, columns=["cid", "n", "tokens"])

    return texts.select("wanted", "text").mapInPandas(run, "cid long, n long, tokens array<long>")


def alive(sets: DataFrame, percent: int) -> DataFrame:
    """Sets without more shingles of their own than a partner may lack."""
    tokens = sets.select("cid", F.explode("tokens").alias("token"))
    own = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("cid").alias("cid")).filter("df = 1").groupBy("cid").agg(F.count("*").alias("own"))
    slack = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    return sets.join(own, "cid", "left").filter(F.coalesce("own", F.lit(0)) <= slack).drop("own")


def signatures(live: DataFrame, percent: int) -> DataFrame:
    """live(cid, n, tokens) -> (sig, cid, n).

    Shingles are ordered rarest first; those of no other set, which come first, are left out. Light sets,
    of `boundary` shingles at most, are signed by subsets of shingles that follow each other in the
    prefix in which subset_sizes() promises one that linked sets have alike. Heavy ones go into the
    inverted lists of the shingles of the prefix of which linked sets share one; light sets that may link
    with heavy ones are in the lists too. The boundary is the size at which the sum of subsets formed
    below and list entries read above is least, from a histogram by size."""
    from pyspark.sql.window import Window

    tokens = live.select("cid", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    common = tokens.join(df, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    slack = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    own = F.col("n") - F.size("common")
    apart = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
    lists = live.select("cid", "n").join(common, "cid").withColumn("first", F.greatest(F.lit(0), slack - own).cast("int")).withColumn("apart", F.greatest(F.lit(0), apart - own).cast("int"))
    # At most `first` of these are in the set alone, and `apart` in one of two linked sets alone.
    prefix = ((F.col("apart") + 1) * (SUBSET - 1) + 1 + F.col("first")).cast("int")
    lists = checkpoint(lists.select("cid", "n", "first", "apart", F.slice(F.transform("common", lambda c: c["token"]), F.lit(1), prefix).alias("common"), F.aggregate(F.slice("common", F.lit(1), F.col("first") + 1), F.lit(0).cast("long"), lambda x, c: x + c["df"]).alias("heavy")))
    hist = lists.groupBy("n").agg(F.sum(F.size("common")).alias("light"), F.sum("heavy").alias("heavy"))
    upto, after = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    best = hist.select("n", (F.sum("light").over(upto) + F.coalesce(F.sum("heavy").over(after), F.lit(0))).alias("cost"), F.sum("heavy").over(Window.partitionBy()).alias("all")).orderBy("cost", "n").first()
    boundary = 0 if best is None or best["cost"] >= best["all"] else best["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[a : a + 200] for a in range(0, len(batch), 200)):
                found, owner = [], []
                for i, (n, first, apart_, common_) in enumerate(zip(part["n"], part["first"], part["apart"], part["common"], strict=True)):
                    tokens_ = np.asarray(common_, np.int64)
                    each = [tokens_[: first + 1]] if n > boundary or n * 100 >= percent * (boundary + 1) else []
                    if n <= boundary:
                        each += [subset_signatures(tokens_[: (apart_ + 1) * (k - 1) + 1 + first], k) for k in subset_sizes(int(n), percent)]
                    found += each
                    owner.append(np.full(sum(map(len, each)), i))
                at = np.concatenate(owner) if owner else np.zeros(0, int)
                yield pd.DataFrame({"sig": np.concatenate(found) if found else np.zeros(0, np.int64), "cid": part["cid"].to_numpy()[at], "n": part["n"].to_numpy()[at]})

    signed = lists.mapInPandas(run, "sig long, cid long, n long")
    shared = signed.groupBy("sig").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least < most").select("sig")
    return signed.join(shared, "sig")


def clusters(signed: DataFrame, percent: int) -> DataFrame:
    """(node, label): sets that may link share a label. Sets of one signature and size class are tied to the
    smallest of them, one row each; sizes of linked sets lie in one class or in neighbouring ones, and
    a set stands in its own and the next."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent)) + 1e-9)
    keyed = signed.select("sig", "cid", F.explode(F.array(size_class, size_class + 1)).alias("size_class"))
    hubs = keyed.groupBy("sig", "size_class").agg(F.min("cid").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return components(keyed.join(hubs, ["sig", "size_class"]).select("a", F.col("cid").alias("b")).filter("a <> b").distinct())


def local_links(sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """sets(cid, n, tokens, own, copies) -> (a, b, rows): the links among the sets, thinned to a forest with
    the same components (a, b); and for each set a, with b null, how many rows the sets have that it
    links with. If sets of two blocks `own` are given, only links between the blocks are counted, as those
    inside a block count where it meets itself. The inverted lists are scanned a thousand shingles at a time;
    each scan adds to the sizes of all intersections."""
    ids, n = sets["cid"].to_numpy(np.int64), sets["n"].to_numpy(np.int64)
    m = len(ids)
    tokens, owner = np.concatenate([np.asarray(t, np.int64) for t in sets["tokens"]]), np.repeat(np.arange(m), n)
    _, place, seen = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((m, m), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 1000):
        a, b = np.searchsorted(place, [low, low + 1000])
        lists = np.zeros((m, 1000), np.float32)
        lists[owner[a:b], place[a:b] - low] = 1
        both += lists @ lists.T
    own, copies = sets["own"].to_numpy(), sets["copies"].to_numpy(np.int64)
    apart = (own != own[0]).any()
    link, linked_rows = np.empty((m, m), bool), np.zeros(m, np.int64)
    for a in range(0, m, 500):  # a strip at a time, so that little stands beside the two matrices
        strip = slice(a, a + 500)
        link[strip] = (100 + percent) * both[strip].astype(np.int64) >= percent * (n[strip, None] + n[None])
        link[strip][np.arange(min(500, m - a)), np.arange(a, min(a + 500, m))] = False
        linked_rows[strip] = (link[strip] & (own[strip, None] != own[None]) if apart else link[strip]) @ copies
    some = np.flatnonzero(linked_rows)
    label = np.arange(m)
    new = link.any(1)
    for i in np.flatnonzero(new):
        reached = np.array([i]) if new[i] else np.zeros(0, int)
        while len(reached):
            label[reached], new[reached] = i, False
            reached = np.flatnonzero(link[reached].any(0) & new)
    far = label != np.arange(m)
    forest = pd.DataFrame({"a": ids[label[far]], "b": pd.array(ids[far], "Int64"), "rows": pd.array([0] * int(far.sum()), "Int64")})
    counts = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "rows": pd.array(linked_rows[some], "Int64")})
    return pd.concat([forest, counts], ignore_index=True)


def linked(live: DataFrame, signed: DataFrame, copies: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the components of the linked sets, and (cid, linked_rows): how many rows the sets have
    that a set links with, by the rows of each set in copies(cid, copies).

    The sets of a cluster meet in one task if they have TASK_SHINGLES shingles at most. A larger cluster is
    dealt over blocks by a hash, and every two blocks meet in a task of their own, so none grows with
    the cluster. Every pair is counted in one task; a task gives fewer links and counts than twice its sets,
    however many pairs link."""
    tied = checkpoint(clusters(signed, percent))
    known = tied.join(copies, tied["node"] == copies["cid"]).select("node", "label", "copies")
    held = live.join(known, live["cid"] == known["node"]).select("cid", "n", "tokens", "label", "copies")
    size = tied.join(live.select("cid", "n"), tied["node"] == F.col("cid")).groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / TASK_SHINGLES), F.ceil(F.count("*") / TASK_SETS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = held.join(size, "label").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cid", "n", "tokens", "own", "copies")
    links = checkpoint(dealt.groupBy("label", "x", "y").applyInPandas(lambda sets: local_links(sets, percent), "a long, b long, rows long"))
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("rows").alias("linked_rows"))
    return checkpoint(components(links.filter("b IS NOT NULL").select("a", "b"))), counts


def join_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id, n_links.

    Only the two named columns are read. A null text or one without words has an empty set, links with
    nothing and is its own component. Rows with equal sets, repeated rows included, are one class
    (class_id: 64 bits of a fingerprint) and link always; classes are formed before any shuffle, so a
    group of copies counts once. n_links is the number of other rows that a row links with itself, not
    over others. Rows of one id with different texts are documents of their own, and so are rows with a null
    id, which link like all others; component_id is the smallest id that is not null, and null only if the
    component has none. An empty table gives no row."""
    rows, held, labels, counts = clustered(docs, size, percent, id_col, text_col)
    return assigned(rows, held, labels, counts).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def clustered(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpoint(classes(source, size, percent))
    held = rows.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.count("*").alias("copies"))
    wanted = checkpoint(survivors(rows, held, percent))
    live = checkpoint(alive(checkpoint(fetch_sets(source, wanted, size)), percent))
    return rows, held, *linked(live, signatures(live, percent), held.select("cid", "copies"), percent)


def assigned(rows: DataFrame, held: DataFrame, labels: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with n_shingles, component_id, class_id, n_links and group, the class that stands for the component."""
    named = held.select("cid", "rep").join(labels, held["cid"] == labels["node"]).select("cid", "label", "rep")
    smallest = named.groupBy("label").agg(F.min("rep").alias("smallest"))
    of_class = named.join(smallest, "label").select(F.col("cid").alias("c"), "label", "smallest")
    links = F.col("copies") - 1 + F.coalesce("linked_rows", F.lit(0))
    reps = held.select(F.col("cid").alias("c"), "rep", "copies").join(of_class, "c", "left").join(counts.withColumnRenamed("cid", "c"), "c", "left")
    reps = reps.select("c", F.coalesce("label", "c").alias("group"), F.coalesce("smallest", "rep").alias("component"), links.alias("links"))
    out = rows.select("rid", "doc_id", "n", "cid")
    out = out.join(reps, (out["cid"] == reps["c"]) & (out["n"] > 0), "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), "group")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of linked documents stays: the one with
    the smallest id (null comes first), then key. Rows without words are linked with nothing and stay; of equal rows with
    words one stays."""
    rows, held, labels, counts = clustered(docs, size, percent, id_col, text_col)
    found = assigned(rows, held, labels, counts).filter("n_shingles > 0")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    keys = found.groupBy("rid", "group").agg(F.count("*").alias("times")).join(first, "group")
    # Rows that stay as they are need no shuffle: only keys that go, or that several rows have, are looked up.
    special = checkpoint(keys.select("rid", (F.col("rid") == F.col("first.rid")).alias("stays"), "times").filter("NOT stays OR times > 1").select("rid", "stays"))
    whole = docs.select(row_key(id_col, text_col).alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    looked = sieved(whole, "rid", special)
    met = looked.filter("maybe").join(special, "rid", "left")
    kept = looked.filter("NOT maybe").select("row").unionByName(met.filter("stays IS NULL").select("row")).unionByName(met.filter("stays").dropDuplicates(["rid"]).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
