"""Sinks: node-link JSON, GraphML, caches. Text is built row by row in the JVM and written by tasks."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml(c: Column) -> Column:
    """A text as XML content: control characters gone, the five special ones escaped."""
    c = F.regexp_replace(c, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", "")
    for ch, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(ch), F.lit(esc))
    return c


def file_name(name: str, default: str = "graph", most: int = 120) -> str:
    """A name safe on any system."""
    name = re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*]', "-", re.sub(r"[\x00-\x1f\x7f]", "", name or ""))).strip(" .")
    return name[:most].rstrip(" .") or default


def _data(columns: dict[str, str]) -> Column:
    one = lambda c: F.concat(F.lit(f'<data key="{c}">'), xml(F.col(c).cast("string")), F.lit("</data>"))
    return F.array_join(F.filter(F.array(*map(one, columns)), lambda x: x.isNotNull()), "")


def _keys(kind: str, columns: dict[str, str]) -> str:
    return "".join(f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="{t}"/>' for c, t in columns.items())


def _kinds(df: DataFrame, skip: tuple[str, ...]) -> dict[str, str]:
    kinds = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    return {c: kinds.get(t, "string") for c, t in df.dtypes if c not in skip}


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the document's lines; nulls are left out. `nodes` has key, `edges` from_key and to_key, other columns are attributes (arrays joined by blanks)."""
    flat = lambda df: df.select(*[F.array_join(c, " ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes if not t.startswith(("map", "struct", "array<map"))])
    nodes, edges = flat(nodes), flat(edges)
    n, e = _kinds(nodes, ("key",)), _kinds(edges, ("from_key", "to_key"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{_keys("node", n)}{_keys("edge", e)}<graph edgedefault="directed">'
    spark = nodes.sparkSession
    row = lambda part, text: spark.createDataFrame([(part, text)], "part int, line string")
    node = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml(F.col("key")), F.lit('">'), _data(n), F.lit("</node>")).alias("line"))
    edge = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml(F.col("from_key")), F.lit('" target="'), xml(F.col("to_key")), F.lit('">'), _data(e), F.lit("</edge>")).alias("line"))
    return row(0, head).unionByName(node).unionByName(edge).unionByName(row(3, "</graph></graphml>"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The document as text files that read in order of their names: a range exchange by part, no single task for all."""
    graphml(nodes, edges).repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a JSON object for each node and link."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    node_link(nodes, edges).write.mode("overwrite").partitionBy("kind").text(path)


def fresh(cache: DataFrame, now: Column, ttl: timedelta = timedelta(days=30)) -> DataFrame:
    """Cached rows (fetched_at) that are not too old."""
    return cache.where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {int(ttl.total_seconds())} SECONDS"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (att_key, stamp) whose links are not cached under their present stamp."""
    return files.join(cache.select("att_key", "stamp"), ["att_key", "stamp"], "left_anti")
