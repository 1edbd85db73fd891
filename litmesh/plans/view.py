"""The view query: which works and edges a filtered graph shows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.operators import edges as E
from litmesh.operators import filters as L


@dataclass(frozen=True)
class ViewSpec:
    """What a view shows; `dumps` and `loads` keep it."""

    filters: tuple[str, ...] = ()
    min_confidence: float = 0.0
    strategies: tuple[str, ...] = E.STRATEGIES
    min_cites: int = 2
    show_ghosts: bool = True
    hide_isolated: bool = False
    hidden: tuple[str, ...] = field(default=())

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> ViewSpec:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def view_edges(merged: DataFrame, facets: DataFrame, spec: ViewSpec) -> DataFrame:
    """Edges shown: believed, from a work that the filters show, to a shown work or to one outside that enough shown works cite.

    The confidence filter reaches the merged table's scan; outside works are never filtered themselves.
    """
    shown = L.matching(facets, [L.parse(f) for f in spec.filters]).select("key")
    if spec.hidden:
        shown = shown.where(~F.col("key").isin(*spec.hidden))
    e = E.visible(merged.where(F.col("confidence") >= spec.min_confidence), spec.strategies).join(shown.withColumnRenamed("key", "from_key"), "from_key", "left_semi")
    outside = ids.is_external(F.col("to_key"))
    inside = e.where(~outside).join(shown.withColumnRenamed("key", "to_key"), "to_key", "left_semi")
    if not spec.show_ghosts:
        return inside
    ghosts = e.where(outside)
    enough = ghosts.groupBy("to_key").agg(F.count("*").alias("n")).where(F.col("n") >= spec.min_cites).select("to_key")
    return inside.unionByName(ghosts.join(enough, "to_key", "left_semi"))


def view_nodes(edges: DataFrame, items: DataFrame, facets: DataFrame, described: DataFrame, spec: ViewSpec) -> DataFrame:
    """(key, held, label, year, degree, in_degree): works shown, held ones without edges too unless they are hidden."""
    shown = L.matching(facets, [L.parse(f) for f in spec.filters]).select("key")
    if spec.hidden:
        shown = shown.where(~F.col("key").isin(*spec.hidden))
    deg = E.degrees(edges)
    held = items.join(shown, "key", "left_semi").select("key", F.lit(True).alias("held"), ids.short_label(F.col("creators"), F.col("title"), F.col("year")).alias("label"), "year")
    known = described.groupBy("key").agg(F.min_by(F.struct("title", "creators", "year"), F.struct("title", "year")).alias("m"))
    ghosts = edges.select(F.col("to_key").alias("key")).where(ids.is_external(F.col("key"))).distinct().join(known, "key", "left")
    ghosts = ghosts.select("key", F.lit(False).alias("held"), ids.ghost_label(F.col("key"), F.col("m.creators"), F.col("m.title"), F.col("m.year")).alias("label"), F.col("m.year").alias("year"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    nodes = held.unionByName(ghosts).join(deg, "key", "left").select("key", "held", "label", "year", zero("degree"), zero("in_degree"))
    return nodes.where("degree > 0 OR NOT held") if spec.hide_isolated else nodes


def view_stats(nodes: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(shown, total, ghosts, named_ghosts, edges): one row."""
    n = nodes.agg(F.count_if("held").alias("shown"), F.count_if(~F.col("held")).alias("ghosts"), F.count_if(~F.col("held") & F.col("year").isNotNull()).alias("named_ghosts"))
    return n.withColumn("edges", F.lit(edges.count())).withColumn("total", F.lit(items.count())).select("shown", "total", "ghosts", "named_ghosts", "edges")


def payload(items: DataFrame, merged: DataFrame, described: DataFrame, meta: dict) -> DataFrame:
    """(part, json): what a page of the graph is made of: items with the counts known elsewhere, outside works with what is known of them, edges, and one row of `meta`.

    Rows leave in no order and are written by tasks; nothing is gathered."""
    known = described.groupBy("key").agg(F.min_by(F.struct("title", "creators", "year", "cited_by_global"), F.struct("title", "year")).alias("m"))
    held = items.select("key", "title", "creators", "year", "item_type", "publication", "collections", "tags", "norm_doi")
    ghosts = E.external_nodes(merged).join(known, "key", "left").select("key", "ns", "id", "cited_by", "confidence", "m.*")
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("json"))
    one = items.sparkSession.createDataFrame([("meta", json.dumps(meta, sort_keys=True))], "part string, json string")
    return part(held, "item").unionByName(part(ghosts, "external")).unionByName(part(E.wire(merged), "edge")).unionByName(one)
