"""Orders and slots of what is drawn: colours of categories, subfields, labels, and the columns of an exported graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids, scores

SLOTS, SPARE = 10, 10


def category(nodes: DataFrame, mode: str) -> DataFrame:
    """(key, category): what colours a node by `mode`: year, publication, type, author (the first), collection (each) or cluster; without one "(none)"."""
    none = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("(none)"))
    if mode == "collection":
        empty = F.array(F.lit("(none)"))
        own = F.array_distinct(F.filter("collections", lambda c: c.isNotNull() & (c != "")))
        return nodes.select("key", F.explode(F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(empty)).alias("category"))
    column = {"year": "year", "publication": "publication", "type": "item_type", "cluster": "label"}
    if mode == "author":
        return nodes.select("key", none(F.get("creators", 0)).alias("category"))
    if mode not in column:
        raise ValueError(f"no mode {mode}; known: author, collection, {', '.join(sorted(column))}")
    return nodes.select("key", none(F.col(column[mode])).alias("category"))


def legend(counts: DataFrame, *, shown: int = 12) -> DataFrame:
    """(category, items, categories): the most frequent categories of counts (category, items), and the rest as "more"."""
    top = F.broadcast(counts.orderBy(F.desc("items"), "category").limit(shown).select("category", F.lit(True).alias("_top")))
    return counts.join(top, "category", "left").groupBy(F.when(F.col("_top"), F.col("category")).otherwise("more").alias("category")).agg(F.sum("items").alias("items"), F.count("*").alias("categories"))


def colour_slots(counts: DataFrame, *, slots: int = SLOTS, spare: int = SPARE) -> DataFrame:
    """(category, slot) of counts (category, items): the most frequent first, each takes the slot its hash points at or the next free
    one, then one of the spare slots likewise; when all are taken, categories share the slots by their hash.

    Only the first slots + spare categories depend on each other; they are placed in one small task."""
    c = counts.select("category", "items", ids.hash_index(F.col("category"), slots).cast("int").alias("h"), ids.hash_index(F.col("category"), spare).cast("int").alias("g"))
    first = c.orderBy(F.desc("items"), "category").limit(slots + spare)

    def place(f: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for r in f.sort_values(["items", "category"], ascending=[False, True]).itertuples():
            ways = [(r.h + i) % slots for i in range(slots)] + [slots + (r.g + i) % spare for i in range(spare)]
            out.append(next(x for x in ways if x not in taken))
            taken.add(out[-1])
        return pd.DataFrame({"category": f.sort_values(["items", "category"], ascending=[False, True])["category"], "slot": out}).astype({"slot": "int32"})

    placed = first.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(place, "category string, slot int")
    return c.join(F.broadcast(placed), "category", "left").select("category", F.coalesce("slot", "h").alias("slot"))


def cluster_order(communities: DataFrame) -> DataFrame:
    """(comm, size), the largest first, least name first among equals."""
    return communities.groupBy("comm").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "comm")


def title_targets(items: DataFrame, least: int = 30) -> DataFrame:
    """(key, norm_title): titles to look for, the longest first, then by order of delivery."""
    t = items.select("key", "seq", ids.ascii_title(F.col("title")).alias("norm_title")).where(F.length("norm_title") >= least)
    return t.orderBy(F.desc(F.length("norm_title")), "seq", "key").select("key", "norm_title")


def label_order(nodes: DataFrame) -> DataFrame:
    """Nodes (key, in_degree, radius, seq) in the order in which they may claim room for a label: most cited, then largest, then as given."""
    return nodes.orderBy(F.desc("in_degree"), F.desc("radius"), "seq", "key")


def group_pull(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, centre, pull): weighted mean of a group's values and how strongly it draws, one at most."""
    w = F.sum(weight)
    return rows.groupBy(F.col(group).alias("g")).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(w, F.lit(0.0))).alias("centre"), F.least(w, F.lit(1.0)).alias("pull"))


def placement(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, x, y) of works not yet placed: the mean place of the works (key, x, y) they cite."""
    return edges.select("from_key", "to_key").distinct().join(placed.withColumnRenamed("key", "to_key"), "to_key").groupBy(F.col("from_key").alias("key")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Attributes of an exported graph, in the order in which programs that draw it expect them: fixed values.
NODE_KEYS = tuple("label title first_author creators year collection subfield item_type publication doi held cited_here cited_global color r g b size x y".split())
EDGE_KEYS = tuple("strategies confidence weight doi color".split())


def _channel(colour: Column, at: int) -> Column:
    return F.conv(F.substring(colour, at, 2), 16, 10).cast("int")


def export_nodes(merged: DataFrame, items: DataFrame, described: DataFrame, clusters: DataFrame, colours: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each node to export, held or outside: key and NODE_KEYS.

    `clusters` is (key, label), `colours` (key, color as #rrggbb), `places` (key, x, y). Held works take
    their fields from `items` (with count_global), outside ones from `described`; what is unknown is null.
    The size is the radius by the number of works here that cite it."""
    ends = merged.select(F.col("from_key").alias("key"), F.lit(0).alias("i")).unionByName(merged.select(F.col("to_key").alias("key"), F.lit(1).alias("i")))
    cited = ends.where("key is not null").groupBy("key").agg(F.sum("i").alias("cited_here"))
    held = items.select("key", F.lit(True).alias("_held"), F.struct("title", "creators", "year", F.col("publication").alias("venue"), "item_type", "collections", F.col("norm_doi").alias("doi")).alias("h"))
    known = described.groupBy("key").agg(F.min_by(F.struct("title", "creators", "year", "venue", "cited_by_global"), F.struct("title", "year")).alias("o"))
    n = cited.join(held, "key", "full_outer").join(known, "key", "left").join(clusters.select("key", F.col("label").alias("subfield")), "key", "left").join(colours.select("key", "color"), "key", "left").join(places.select("key", "x", "y"), "key", "left")
    of = lambda c: F.when(F.col("_held"), F.col(f"h.{c}")).otherwise(F.col(f"o.{c}"))
    only = lambda c: F.when(F.col("_held"), c)
    label = F.when(F.col("_held"), ids.short_label(F.col("h.creators"), F.col("h.title"), F.col("h.year"))).otherwise(ids.ghost_label(F.col("key"), F.col("o.creators"), F.col("o.title"), F.col("o.year")))
    here = F.coalesce("cited_here", F.lit(0)).cast("long")
    outside_doi = F.when(ids.namespace(F.col("key")) == "doi", ids.local_id(F.col("key")))
    return n.select(
        "key", label.alias("label"), of("title").alias("title"), F.get(of("creators"), 0).alias("first_author"), F.array_join(of("creators"), "; ").alias("creators"), of("year").alias("year"),
        only(F.array_join("h.collections", "; ")).alias("collection"), only(F.col("subfield")).alias("subfield"), only(F.col("h.item_type")).alias("item_type"), of("venue").alias("publication"), F.when(F.col("_held"), F.col("h.doi")).otherwise(outside_doi).alias("doi"),
        F.coalesce("_held", F.lit(False)).alias("held"), here.alias("cited_here"), F.col("o.cited_by_global").alias("cited_global"), "color",
        *(_channel(F.col("color"), at).alias(c) for c, at in (("r", 2), ("g", 4), ("b", 6))), scores.local_radius(here).alias("size"), "x", "y",
    )
