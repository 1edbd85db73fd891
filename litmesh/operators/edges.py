"""Operators on the edge table (from_key, to_key, via, confidence, evidence): merging, roll-ups, re-keying, filters.

A merged edge is unique per (from_key, to_key) and carries its strategies as an array. Every merge is
one aggregation with partial sums before the shuffle; a much-cited work never gathers its rows in one
task, since the grouping key is the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids

#: Strategies by rank, and the confidence of an edge that states none: fixed values.
STRATEGIES = ("openalex", "pdf-links", "text-doi", "locator-match", "ref-strings", "title-match")
DEFAULT_CONFIDENCE = {"pdf-links": 0.95, "text-doi": 0.9, "title-match": 0.6, "locator-match": 0.7, "ref-strings": 0.5, "openalex": 0.98}
#: Which kind of key names a work that several keys name: fixed values.
RANKS = {"doi": 1, "arxiv": 2, "openalex": 3, "ref": 4}
ASSERTED = 0.9


def by_rank(vias: Column) -> Column:
    """Strategies in rank order, unknown ones after them by name."""
    rank = lambda v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STRATEGIES) for x in (s, i)]), v), F.lit(len(STRATEGIES)))
    return F.transform(F.array_sort(F.transform(vias, lambda v: F.struct(rank(v).alias("r"), v.alias("v")))), lambda x: x["v"])


def with_confidence(edges: DataFrame) -> DataFrame:
    default = F.create_map(*[F.lit(x) for s, c in DEFAULT_CONFIDENCE.items() for x in (s, c)])
    return edges.withColumn("confidence", F.coalesce("confidence", F.element_at(default, F.col("via")), F.lit(0.5)))


def merge(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, confidence, via, n_evidence, evidence): one row for each ordered pair.

    confidence is the greatest; via the distinct strategies in rank order; evidence the distinct
    pieces, each with its strategy. Self-citations and rows with a null end are dropped. Repeated
    rows change nothing.
    """
    e = with_confidence(edges).where(F.col("from_key").isNotNull() & F.col("to_key").isNotNull() & (F.col("from_key") != F.col("to_key")))
    piece = F.when(F.col("evidence").isNotNull(), F.concat(F.col("via"), F.lit(" "), F.to_json("evidence")))
    out = e.withColumn("_piece", piece).groupBy("from_key", "to_key").agg(F.max("confidence").alias("confidence"), F.collect_set("via").alias("via"), F.collect_set("_piece").alias("evidence"))
    return out.select("from_key", "to_key", "confidence", by_rank(F.col("via")).alias("via"), F.size("evidence").alias("n_evidence"), F.array_sort("evidence").alias("evidence"))


def remerge(merged: DataFrame) -> DataFrame:
    """As `merge`, of merged edges whose keys changed."""
    e = merged.where(F.col("from_key") != F.col("to_key"))
    out = e.groupBy("from_key", "to_key").agg(F.max("confidence").alias("confidence"), F.array_distinct(F.flatten(F.collect_set("via"))).alias("via"), F.array_distinct(F.flatten(F.collect_set("evidence"))).alias("evidence"))
    return out.select("from_key", "to_key", "confidence", by_rank(F.col("via")).alias("via"), F.size("evidence").alias("n_evidence"), F.array_sort("evidence").alias("evidence"))


def validate(edges: DataFrame, held: DataFrame, *, namespaces: tuple[str, ...] = ids.NAMESPACES, externals: bool = True) -> DataFrame:
    """Edges whose citing side is held and whose cited side is held, or outside in a known namespace; no self-citations."""
    keys = held.select(F.col("key").alias("_k")).distinct()
    out = edges.where(F.col("from_key") != F.col("to_key")).join(keys, F.col("from_key") == F.col("_k"), "left_semi")
    outside = ids.namespace(F.col("to_key"))
    inside = out.where(outside.isNull()).join(keys, F.col("to_key") == F.col("_k"), "left_semi")
    return inside.unionByName(out.where(outside.isin(*namespaces))) if externals else inside


def external_nodes(merged: DataFrame) -> DataFrame:
    """(key, ns, id, cited_by, confidence, via): works cited but not held, with their numbers of citing works.

    The list of citing works is not gathered: one work may be cited by a third of all. `citers` gives it by rows.
    """
    e = merged.where(ids.is_external(F.col("to_key")))
    out = e.groupBy("to_key").agg(F.count("*").alias("cited_by"), F.max("confidence").alias("confidence"), F.array_distinct(F.flatten(F.collect_set("via"))).alias("via"))
    return out.select(F.col("to_key").alias("key"), ids.namespace(F.col("to_key")).alias("ns"), ids.local_id(F.col("to_key")).alias("id"), "cited_by", "confidence", by_rank(F.col("via")).alias("via"))


def citers(merged: DataFrame) -> DataFrame:
    return merged.where(ids.is_external(F.col("to_key"))).select(F.col("to_key").alias("key"), F.col("from_key").alias("citer")).distinct()


def most_cited(nodes: DataFrame, k: int = 4000) -> DataFrame:
    """The k most cited, ties by key: a bounded heap in each task, no full sort."""
    return nodes.orderBy(F.desc("cited_by"), "key").limit(k)


def lookup_keys(nodes: DataFrame, *, usual: int = 500, openalex: int = 2500) -> DataFrame:
    """The works to look up: the most cited of each class, `openalex` of that namespace and `usual` of doi and arxiv together.

    Each class is cut by its own bounded top-k, so no window gathers a class in one task.
    """
    pick = lambda where, k: nodes.where(where).orderBy(F.desc("cited_by"), "key").limit(k)
    return pick(F.col("ns").isin("doi", "arxiv"), usual).unionByName(pick(F.col("ns") == "openalex", openalex))


def provider_stats(edges: DataFrame) -> DataFrame:
    """(via, produced, new_edges): rows of each strategy, and pairs of which it is the first by rank."""
    e = edges.where((F.col("from_key") != F.col("to_key")))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STRATEGIES) for x in (s, i)]), F.col("via")), F.lit(len(STRATEGIES)))
    first = e.groupBy("from_key", "to_key").agg(F.min(F.struct(rank.alias("r"), "via")).alias("f")).groupBy(F.col("f.via").alias("via")).agg(F.count("*").alias("new_edges"))
    made = e.groupBy("via").agg(F.count("*").alias("produced"))
    return made.join(first, "via", "left").select("via", "produced", F.coalesce("new_edges", F.lit(0)).alias("new_edges"))


def cited_by_histogram(nodes: DataFrame, most: int = 5) -> DataFrame:
    bucket = F.when(F.col("cited_by") >= most, F.lit(f"{most}+")).otherwise(F.col("cited_by").cast("string"))
    return nodes.groupBy(bucket.alias("cited_by")).agg(F.count("*").alias("works"))


def by_corroboration(merged: DataFrame) -> DataFrame:
    return merged.groupBy(F.size("via").alias("strategies")).agg(F.count("*").alias("edges"))


def per_strategy(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode("via").alias("via")).groupBy("via").agg(F.count("*").alias("edges"))


def strategies_present(merged: DataFrame) -> DataFrame:
    """(rank, via): the distinct strategies, in rank order."""
    present = merged.select(F.explode("via").alias("via")).distinct()
    return present.select(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STRATEGIES) for x in (s, i)]), F.col("via")), F.lit(len(STRATEGIES))).alias("rank"), "via")


def at_thresholds(merged: DataFrame, thresholds: tuple[float, ...] = (0.9, 0.7, 0.5)) -> DataFrame:
    return merged.agg(*[F.count_if(F.col("confidence") >= t).alias(f"at_{round(t * 100)}") for t in thresholds])


def filter_edges(merged: DataFrame, *, min_confidence: float = 0.0, via: tuple[str, ...] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Confidence at least the least; some strategy allowed; not every strategy excluded."""
    out = merged.where(F.col("confidence") >= min_confidence)
    if via is not None:
        out = out.where(F.arrays_overlap("via", F.array(*map(F.lit, via))))
    if exclude:
        out = out.where(F.size(F.array_except("via", F.array(*map(F.lit, exclude)))) > 0)
    return out


def visible(merged: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """Edges some enabled strategy found: via keeps the enabled ones, found all of them."""
    shown = F.array_intersect("via", F.array(*map(F.lit, enabled)))
    return merged.withColumn("found", F.col("via")).withColumn("via", shown).where(F.size("via") > 0)


def best_strategy(merged: DataFrame) -> DataFrame:
    return merged.withColumn("best", F.get("via", 0))


def asserted(merged: DataFrame) -> DataFrame:
    return merged.groupBy((F.col("confidence") >= ASSERTED).alias("asserted")).agg(F.count("*").alias("edges"))


def compare_strategies(edges: DataFrame) -> DataFrame:
    """(via_a, via_b, shared, only_a, share_a): for each two strategies the pairs both found; for a strategy with itself its own number, and those it alone found.

    A pair's strategies are a set of bounded size, so the matrix costs one aggregation by pair.
    """
    sets = edges.where(F.col("from_key") != F.col("to_key")).groupBy("from_key", "to_key").agg(F.collect_set("via").alias("v"))
    cells = sets.select(F.explode("v").alias("via_a"), "v").select("via_a", F.explode("v").alias("via_b"), (F.size("v") == 1).alias("alone"))
    out = cells.groupBy("via_a", "via_b").agg(F.count("*").alias("shared"), F.count_if("alone").alias("only_a"))
    union = max(1, sets.count())
    return out.select("via_a", "via_b", "shared", "only_a", F.round(F.col("shared") / F.lit(union), 6).alias("share"))


def node_keys(merged: DataFrame) -> DataFrame:
    return merged.select(F.col("from_key").alias("key")).union(merged.select("to_key")).distinct()


def degrees(merged: DataFrame) -> DataFrame:
    """(key, out_degree, in_degree, degree): one pass, partial counts before the shuffle."""
    ends = merged.select(F.col("from_key").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(merged.select(F.col("to_key").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def rekey(merged: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with the keys of `moved` (key, new_key; one row for each key) replaced on both sides, merged again."""
    m = moved.select("key", "new_key")
    out = merged.join(m.select(F.col("key").alias("to_key"), F.col("new_key").alias("_to")), "to_key", "left")
    out = out.join(m.select(F.col("key").alias("from_key"), F.col("new_key").alias("_from")), "from_key", "left")
    return remerge(out.withColumn("from_key", F.coalesce("_from", "from_key")).withColumn("to_key", F.coalesce("_to", "to_key")).drop("_from", "_to"))


def same_title(nodes: DataFrame) -> DataFrame:
    """(key, new_key) of outside works whose normalised title another key carries too.

    `nodes` is (key, title, seq) of held and outside works. The key of best rank names the work (held
    before doi, arxiv, openalex, ref), the first seen among equals. Held keys never move. Titles
    under 20 letters say too little.
    """
    rank = F.when(~ids.is_external(F.col("key")), 0).otherwise(F.element_at(F.create_map(*[F.lit(x) for n, r in RANKS.items() for x in (n, r)]), ids.namespace(F.col("key"))))
    t = nodes.withColumn("sig", ids.ref_signature(ids.ascii_title(F.col("title")))).where(F.col("sig").isNotNull()).withColumn("r", rank)
    best = t.groupBy("sig").agg(F.min_by("key", F.struct("r", "seq", "key")).alias("new_key"))
    return t.join(best, "sig").where((F.col("r") > 0) & (F.col("key") != F.col("new_key"))).select("key", "new_key")


def by_known_doi(merged_keys: DataFrame, metadata: DataFrame, held: DataFrame) -> DataFrame:
    """(key, new_key) of openalex works whose metadata has a DOI: the held item with that DOI, else the doi key."""
    doi = metadata.select("key", ids.norm_doi(F.col("doi")).alias("doi")).where(F.col("doi").isNotNull() & F.col("key").startswith("openalex:"))
    index = held_by_doi(held)
    return doi.join(merged_keys.select("key"), "key", "left_semi").join(index, "doi", "left").select("key", F.coalesce("held_key", ids.external_key(F.lit("doi"), F.col("doi"))).alias("new_key"))


def held_by_doi(held: DataFrame) -> DataFrame:
    """(doi, held_key): of items that share a DOI the last delivered."""
    return held.select(ids.norm_doi(F.col("doi")).alias("doi"), "key", "seq").where(F.col("doi").isNotNull()).groupBy("doi").agg(F.max_by("key", F.struct("seq", "key")).alias("held_key"))


def adopt(merged: DataFrame, ghost: str, item_key: str) -> DataFrame:
    """Edges after an outside work becomes a held item: both ends re-keyed, merged again."""
    new = lambda c: F.when(F.col(c) == ghost, F.lit(item_key)).otherwise(F.col(c)).alias(c)
    return remerge(merged.select(new("from_key"), new("to_key"), "confidence", "via", "n_evidence", "evidence"))


def wire(merged: DataFrame) -> DataFrame:
    """What leaves the engine of an edge: its ends, confidence, strategies, and the first piece of evidence."""
    return merged.select("from_key", "to_key", "confidence", "via", F.get("evidence", 0).alias("evidence"))
