"""Relations of companies and persons: strong links, short paths, a three-state answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.plans import settled

#: Strong relations with their weights (others 50), and the providers' words for them.
WEIGHTS = {"ACTUAL_CONTROLLER": 100, "UBO": 95, "SHAREHOLDER": 90, "INVESTMENT": 90, "LEGAL_REP": 85, "PARTNER": 85, "BRANCH": 80, "DIRECTOR": 70, "EXECUTIVE": 70, "SUPERVISOR": 65}
TERMS = {
    "LEGAL_REP": ("LEGAL_REPRESENTATIVE", "法人", "法定代表人"),
    "SHAREHOLDER": ("股东",),
    "INVESTMENT": ("投资", "对外投资"),
    "DIRECTOR": ("董事",),
    "SUPERVISOR": ("监事",),
    "EXECUTIVE": ("高管", "高级管理人员"),
    "PARTNER": ("合伙人",),
    "BRANCH": ("分支机构",),
    "ACTUAL_CONTROLLER": ("实控", "实际控制人"),
    "UBO": ("最终受益人", "最终受益所有人"),
}
HISTORICAL = {"LEGAL_REP": "历史法定代表人", "SHAREHOLDER": "历史股东", "DIRECTOR": "历史董事", "SUPERVISOR": "历史监事", "EXECUTIVE": "历史高管", "INVESTMENT": "历史投资"}
OLD = 0.7
COMPANY = ("有限公司", "有限责任公司", "股份有限公司", "合伙企业", "分公司", "集团", "企业", "公司", "厂", "中心", "事务所", "合作社")
REGISTRATION = r"[0-9A-HJ-NPQRTUWXY]{18}"


def entity_type(c: F.Column) -> F.Column:
    text = F.trim(F.replace(c, F.lit("　"), F.lit(" ")))
    named = F.lit(False)
    for word in COMPANY:
        named = named | F.contains(text, F.lit(word))
    return F.when(text.rlike(REGISTRATION) | named, "company").when(text.rlike("^[一-龥]{2,4}$"), "person").otherwise("unknown")


def company_name(c: F.Column) -> F.Column:
    """The name without bracketed notes and white space."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[（(【\[][^）)】\]]*[）)】\]]", ""), r"(?U)\s+", "")


def relation_type(c: F.Column) -> F.Column:
    """The strong relation that a provider's word stands for; null for weak and unknown ones."""
    term, out = F.upper(F.trim(c)), F.lit(None).cast("string")
    for name, words in TERMS.items():
        out = F.when(term.isin(name, *words), name).otherwise(out)
    for name, word in HISTORICAL.items():
        out = F.when(term.isin(f"HISTORICAL_{name}", word), f"HISTORICAL_{name}").otherwise(out)
    return out


def weight(c: F.Column) -> F.Column:
    """Historical relations have the default weight, reduced."""
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.when(c.startswith("HISTORICAL_"), 50 * OLD).otherwise(F.coalesce(table[c], F.lit(50)).cast("double"))


def strong_edges(edges: DataFrame) -> DataFrame:
    """edges(_src_row, from, to, relation_type) -> (u, v, type, weight) in both directions; the last of parallel
    edges counts."""
    e = edges.withColumn("type", relation_type(F.col("relation_type"))).filter("type IS NOT NULL")
    both = e.select(F.col("from").alias("u"), F.col("to").alias("v"), "_src_row", "type").unionByName(e.select(F.col("to").alias("u"), F.col("from").alias("v"), "_src_row", "type"))
    last = both.groupBy("u", "v").agg(F.max(F.struct("_src_row", "type")).alias("r"))
    return last.select("u", "v", "r.type").withColumn("weight", weight(F.col("type")))


#: Links of a node, or nodes around a target, that one key of a join holds; those of larger ones are dealt over slots.
SLOT = 10_000


def dealt(links: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(links with `slot`, (key, n, slots)): the n links of a key lie in so many slots, by what they lead to."""
    counts = links.groupBy(key).agg(F.count("*").alias("n")).withColumn("slots", F.ceil(F.col("n") / SLOT).cast("int"))
    hot = counts.filter("slots > 1").select(key, "slots")
    slot = F.coalesce(F.pmod(F.xxhash64(other), F.col("slots")), F.lit(0)).cast("int")
    return links.join(hot, key, "left").withColumn("slot", slot).drop("slots"), counts


def in_slots(rows: DataFrame) -> DataFrame:
    """Every row once for each of its `slots`."""
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")


def around(targets: DataFrame, links: DataFrame, degree: DataFrame, radius: int) -> DataFrame:
    """(target, node, dist): the nodes within radius steps of each of targets(target)."""
    rim = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("dist"))
    found = rim
    for dist in range(1, radius + 1):
        wide = in_slots(rim.join(degree.select(F.col("u").alias("node"), "slots"), "node")).withColumnRenamed("node", "u")
        rim = wide.join(links, ["u", "slot"]).select("target", F.col("v").alias("node")).distinct().join(found, ["target", "node"], "left_anti")
        rim = settled(rim.withColumn("dist", F.lit(dist)))
        found = found.unionByName(rim)
    return found


def frontiers(edges: DataFrame, pairs: DataFrame, max_depth: int) -> Iterator[DataFrame]:
    """The paths of 1 to max_depth steps that may lead from source to target, one frame for each number of steps.

    Both ends are searched: all nodes within half the depth of a target are known beforehand, and a path that has
    no more than that left goes on to these alone. It is extended by the links of its node, or, where its target has
    fewer nodes around it than its node has links, by these nodes, if they are linked: a hub costs the fewer of
    both. A path through a node goes on only if no shorter one of its pair reached that node; of equally short
    ones the first by its nodes does."""
    adj = strong_edges(edges)
    links, degree = dealt(adj, "u", "v")
    links, degree = settled(links), settled(degree)
    half = max_depth // 2
    near = around(pairs.select("target").distinct(), links, degree, half)
    state = pairs.select("source", "target").distinct().withColumn("at", F.col("source")).withColumn("nodes", F.array("source")).withColumn("types", F.array().cast("array<string>")).withColumn("total", F.lit(0.0))
    seen = state.select("source", "target", "at")
    onward = ["source", "target", F.col("v").alias("at"), F.concat("nodes", F.array("v")).alias("nodes"), F.concat("types", F.array("type")).alias("types"), (F.col("total") + F.col("weight")).alias("total")]
    unseen = ~F.array_contains("nodes", F.col("v"))
    for depth in range(1, max_depth + 1):
        counted, left = state.join(degree.withColumnRenamed("u", "at"), "at"), max_depth - depth
        if left > half:
            step = in_slots(counted).withColumnRenamed("at", "u").join(links, ["u", "slot"]).filter(unseen).select(*onward)
        else:
            goal, size = dealt(near.filter(F.col("dist") <= left).select("target", F.col("node").alias("v")), "target", "v")
            both = counted.join(size.select("target", F.col("n").alias("m"), F.col("slots").alias("parts")), "target").withColumnRenamed("at", "u")
            few = in_slots(both.filter("n <= m")).join(links, ["u", "slot"]).join(goal.select("target", "v"), ["target", "v"], "left_semi")
            many = in_slots(both.filter("n > m").drop("slots").withColumnRenamed("parts", "slots")).join(goal, ["target", "slot"])
            many = many.drop("slot").join(links.drop("slot"), ["u", "v"])
            step = few.filter(unseen).select(*onward).unionByName(many.filter(unseen).select(*onward))
        step = settled(step)
        yield step.withColumnRenamed("total", "weight")
        # Of several paths that reach a node at one depth, the first by its nodes goes on.
        ahead = step.filter(F.col("at") != F.col("target")).join(seen, ["source", "target", "at"], "left_anti")
        state = ahead.groupBy("source", "target", "at").agg(F.min(F.struct("nodes", "types", "total")).alias("first")).select("source", "target", "at", "first.*")
        seen = seen.unionByName(state.select("source", "target", "at"))


def paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3, top: int = 3) -> DataFrame:
    """For pairs(source, target): simple paths of strong edges of at most max_depth steps: (source, target,
    nodes, types, weight, length, historical, rank), the best `top` by length, weight and currency."""
    done = reduce(DataFrame.unionByName, [step.filter(F.col("at") == F.col("target")) for step in frontiers(edges, pairs, max_depth)])
    done = done.withColumn("length", F.size("types")).withColumn("historical", F.exists("types", lambda t: t.startswith("HISTORICAL_")))
    by = Window.partitionBy("source", "target").orderBy("length", F.desc("weight"), "historical", "nodes")
    return done.drop("at").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


@dataclass(frozen=True)
class Context:
    entities_resolved: bool = False
    person_ambiguity: bool = False
    structured_provider_used: bool = False
    scope_complete: bool = False
    provider_error: bool = False
    only_web_search: bool = False
    negative_semantics: bool = False


def evidence_of(found: DataFrame) -> DataFrame:
    return found.groupBy("source", "target").agg(F.count("*").alias("n_paths"), F.bool_or("historical").alias("historical"))


def decide(pairs: DataFrame, found: DataFrame, c: Context) -> DataFrame:
    """(source, target, status, n_paths, historical): related, not related within the scope, or to verify. A
    path tells only of resolved, unambiguous entities; no path tells nothing unless the scope is
    complete and a structured provider vouches for absences. What is decided is validated."""
    clear = c.entities_resolved and not c.person_ambiguity
    absent = clear and c.scope_complete and not c.provider_error and not c.only_web_search and c.negative_semantics
    without = "NOT_RELATED_IN_SCOPE" if absent else "NEEDS_VERIFICATION"
    j = pairs.select("source", "target").distinct().join(evidence_of(found), ["source", "target"], "left").fillna(0, ["n_paths"])
    claims = j.select("source", "target", F.when(F.col("n_paths") > 0, "RELATED" if clear else "NEEDS_VERIFICATION").otherwise(without).alias("status"))
    return validated(claims, found, c).drop("claimed", "downgraded")


def validated(claims: DataFrame, found: DataFrame, c: Context) -> DataFrame:
    """claims(source, target, status), whoever made them, held against the paths found: (source, target, claimed,
    status, downgraded, n_paths, historical). With a path, resolved and unambiguous entities are related,
    whatever was claimed. Without one, only the claim of no relation stands, and only if a structured provider that
    vouches for absences answered for the complete scope. All else, a null claim too, is to be verified.
    Rows that repeat each have their answer."""
    clear = c.entities_resolved and not c.person_ambiguity
    absent = clear and c.structured_provider_used and c.scope_complete and not c.provider_error and c.negative_semantics
    j = claims.select("source", "target", F.col("status").alias("claimed")).join(evidence_of(found), ["source", "target"], "left").fillna(0, ["n_paths"])
    stands = F.lit(absent) & F.col("claimed").eqNullSafe("NOT_RELATED_IN_SCOPE")
    status = F.when((F.col("n_paths") > 0) & F.lit(clear), "RELATED").when((F.col("n_paths") == 0) & stands, "NOT_RELATED_IN_SCOPE").otherwise("NEEDS_VERIFICATION")
    j = j.withColumn("status", status)
    downgraded = (F.col("status") == "NEEDS_VERIFICATION") & ~F.col("claimed").eqNullSafe("NEEDS_VERIFICATION")
    return j.select("source", "target", "claimed", "status", downgraded.alias("downgraded"), "n_paths", F.coalesce("historical", F.lit(False)).alias("historical"))


#: Characters of the strings by which names are indexed.
GRAM = 3


def grams(text: F.Column, n: F.Column) -> F.Column:
    """The distinct strings of n characters of a text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, n)))


def contained(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole): the texts of parts that texts of wholes contain; neither side holds a text twice or empty ones.

    Every text of wholes is indexed by its strings of up to GRAM characters. A part looks only under one of its own,
    that which fewest wholes have (a shorter part under itself), and what it finds there is compared."""
    index = wholes.select(whole, F.explode(F.flatten(F.array(*[grams(F.col(whole), F.lit(n)) for n in range(1, GRAM + 1)]))).alias("gram"))
    own = parts.select(part, F.explode(grams(F.col(part), F.least(F.length(part), F.lit(GRAM)))).alias("gram"))
    counted = own.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = counted.groupBy(part).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("at")).filter("at.n > 0").select(part, "at.gram")
    return rarest.join(index, "gram").filter(F.contains(F.col(whole), F.col(part))).select(part, whole)


def match_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node_id): names(name) found in nodes(node_id, name, canonical_id) by registration number, else
    equal name, else containment either way; the smallest id of equally good ones. Names that neither number nor
    equality finds are looked up in an index of the nodes' names, and these in one of them."""
    n = nodes.select("node_id", company_name(F.col("name")).alias("node_name"), "canonical_id")
    wanted = names.select("name").distinct().withColumn("clean", company_name(F.col("name"))).withColumn("code", F.regexp_extract("name", REGISTRATION, 0))
    by_code = wanted.filter("code <> ''").join(n.select("node_id", F.col("canonical_id").alias("code")), "code").groupBy("name").agg(F.min("node_id").alias("by_code"))
    by_name = wanted.join(n.select("node_id", F.col("node_name").alias("clean")), "clean").groupBy("name").agg(F.min("node_id").alias("by_name"))
    sure = wanted.join(by_code, "name", "left").join(by_name, "name", "left").select("name", "clean", F.coalesce("by_code", "by_name").alias("node_id"))
    left = sure.filter("node_id IS NULL AND clean <> ''").select("name", "clean")
    mine, theirs = left.select("clean").distinct(), n.filter("node_name <> ''").groupBy("node_name").agg(F.min("node_id").alias("node_id"))
    held = contained(theirs.select("node_name"), mine, "node_name", "clean").unionByName(contained(mine, theirs.select("node_name"), "clean", "node_name"))
    near = held.join(theirs, "node_name").groupBy("clean").agg(F.min("node_id").alias("node_id"))
    return sure.filter("node_id IS NOT NULL").select("name", "node_id").unionByName(left.join(near, "clean").select("name", "node_id"))


def registration_number(text: str) -> str | None:
    found = re.search(REGISTRATION, text or "")
    return found.group(0) if found else None


def anchored(people: DataFrame) -> DataFrame:
    """people(name, company, person_id) -> name, anchor, canonical_id, resolved, identity_confirmed: a person is known
    by the company that is known to employ them, and confirmed by a provider's id."""
    person = entity_type(F.col("name")) == "person"
    anchor = F.when(person, company_name(F.col("company")))
    return people.select("name", anchor.alias("anchor"), F.when(person, F.col("person_id")).alias("canonical_id"), (person & anchor.isNotNull()).alias("resolved"), (person & anchor.isNotNull() & F.col("person_id").isNotNull()).alias("identity_confirmed"))


#: What a provider may say that it can do.
CAPABILITIES = ("structured_company_data", "company_entity_resolution", "company_shareholders", "company_key_people", "company_investments", "company_controller", "company_history", "person_resolution", "person_related_companies", "shortest_path", "web_search")


class Provider:
    """Where relations come from. A provider gives nodes and edges as frames, and says what it can do and whether
    it vouches for relations that it does not have."""

    def nodes(self) -> DataFrame:
        raise NotImplementedError

    def edges(self) -> DataFrame:
        raise NotImplementedError

    def capabilities(self) -> dict[str, bool]:
        return dict.fromkeys(CAPABILITIES, False)

    def negative_semantics(self) -> bool:
        return False

    def resolve(self, names: DataFrame) -> DataFrame:
        """(name, node_id) of names(name)."""
        return match_nodes(names, self.nodes())

    def paths(self, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
        return paths(self.edges(), pairs, max_depth)

    def decide(self, pairs: DataFrame, **known: bool) -> DataFrame:
        """decide() for pairs of node ids, with what the provider says of itself."""
        can = self.capabilities()
        c = Context(**{"structured_provider_used": can.get("structured_company_data", False), "only_web_search": can.get("web_search", False) and not can.get("structured_company_data", False), "negative_semantics": self.negative_semantics()} | known)
        return decide(pairs, self.paths(pairs), c)


class FileProvider(Provider):
    """Relations from a JSON file with nodes, edges, capabilities and negative_semantics_supported."""

    def __init__(self, spark, path: str):
        from auditspark.sources import read_relations
        from auditspark.sources.shapes import read_json_file

        self._nodes, self._edges = read_relations(spark, path)
        value = F.col("value")
        said = read_json_file(spark, path)[0].select(F.try_variant_get(value, "$.capabilities", "map<string,variant>").alias("can"), F.try_variant_get(value, "$.negative_semantics_supported", "boolean").alias("vouches"))
        first = said.select(F.map_filter("can", lambda _, v: F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False))).alias("can"), "vouches").select(F.map_keys("can").alias("can"), "vouches").first()
        self._can, self._vouches = dict.fromkeys(first["can"] or [], True), bool(first["vouches"])

    def nodes(self) -> DataFrame:
        return self._nodes.select("node_id", "name", "canonical_id")

    def edges(self) -> DataFrame:
        return self._edges

    def capabilities(self) -> dict[str, bool]:
        return super().capabilities() | {k: bool(v) for k, v in self._can.items()}

    def negative_semantics(self) -> bool:
        return self._vouches
