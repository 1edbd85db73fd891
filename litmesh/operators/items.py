"""Held works: identity indexes, facets, works that several items hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.session import stage


def last_deliveries(items: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, columns) of each key's last delivery by (synced_at, seq); of whole rows repeated one. Rows without key are left out.

    Only keys and times are shuffled to find what was delivered again, and only those few keys' rows are compared."""
    at = F.struct("synced_at", "seq")
    wanted = [F.col(c) for c in dict.fromkeys((key, *columns))]
    known = items.where(F.col(key).isNotNull())
    again = stage(known.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    once = known.join(again, key, "left_anti").select(*wanted)
    rest = [c for c in dict.fromkeys(columns) if c != key]
    last = known.join(again, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_r"))
    return once.unionByName(last.select(key, "_r.*"))


def current(items: DataFrame) -> DataFrame:
    """One row for each item key: its last delivery by (synced_at, seq). Rows without key are left out."""
    return last_deliveries(items, "key", *[c for c in items.columns if c != "key"])


def records(items: DataFrame) -> DataFrame:
    """Items a graph can hold: titled, with derived doi and year."""
    return current(items).where(F.col("title").isNotNull() & (F.trim("title") != "")).withColumn("norm_doi", ids.norm_doi(F.col("doi"))).withColumn("year", ids.first_year(F.col("date")))


def by_doi(items: DataFrame) -> DataFrame:
    """The last of the items that share a DOI."""
    return items.where(F.col("norm_doi").isNotNull()).groupBy(F.col("norm_doi").alias("doi")).agg(F.max_by("key", F.struct("seq", "key")).alias("key"))


def by_title(items: DataFrame, least: int = 1) -> DataFrame:
    """The first of the items that share a normalised title of at least `least` letters."""
    t = items.withColumn("norm_title", ids.ascii_title(F.col("title"))).where(F.length("norm_title") >= least)
    return t.groupBy("norm_title").agg(F.min_by("key", F.struct("seq", "key")).alias("key"))


def oldest_by_doi(items: DataFrame) -> DataFrame:
    """Of the items that hold a DOI the one entered first."""
    return items.where(F.col("norm_doi").isNotNull()).groupBy(F.col("norm_doi").alias("doi")).agg(F.min_by("key", F.struct("item_id", "key")).alias("key"), F.count("*").alias("items"))


def index_stats(items: DataFrame, least_title: int = 30) -> DataFrame:
    """(items, with_doi, dois, titles, title_targets): what the identity indexes hold."""
    t = items.withColumn("norm_title", ids.ascii_title(F.col("title")))
    return t.agg(F.count("*").alias("items"), F.count("norm_doi").alias("with_doi"), F.count_distinct("norm_doi").alias("dois"), F.count_distinct("norm_title").alias("titles"), F.count_if(F.length("norm_title") >= least_title).alias("title_targets"))


def works(items: DataFrame) -> DataFrame:
    """(work, items, first_key, year): items that are one work, by DOI, else by the slug of a title of 20 letters and more.

    The items of a work are counted, and its least key and first year kept; `work_items` lists them by rows.
    """
    return work_items(items).groupBy("work").agg(F.count("*").alias("items"), F.min("key").alias("first_key"), F.min("year").alias("year"))


def work_items(items: DataFrame) -> DataFrame:
    slug = ids.slug(F.col("title"))
    work = F.coalesce(F.col("norm_doi"), F.when(F.length(slug) >= 20, F.concat(F.lit("title:"), slug)))
    return items.select(work.alias("work"), "key", "year").where(F.col("work").isNotNull())


def facets(items: DataFrame) -> DataFrame:
    """The eight facets of each item, each an array of strings (empty where there is nothing)."""
    one = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    many = lambda c: F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))
    year = F.when(F.col("year").isNotNull(), F.array(F.col("year").cast("string"))).otherwise(F.array().cast("array<string>"))
    return items.select("key", one("title").alias("title"), many("creators").alias("author"), year.alias("year"), one("publication").alias("publication"), one("item_type").alias("type"), many("tags").alias("tag"), many("collections").alias("collection"), F.array().cast("array<string>").alias("cluster"))


def facet_counts(facet_rows: DataFrame, fields: tuple[str, ...] = ("author", "year", "publication", "type", "tag", "collection")) -> DataFrame:
    """(field, value, items): how many items carry each value, each item once."""
    def of(field: str):
        return F.transform(F.array_distinct(field), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    pairs = F.flatten(F.array(*map(of, fields)))
    return facet_rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("items"))


def parents(rows: DataFrame) -> DataFrame:
    """(key, pos): of (child, parent, pos) the parents in order of first appearance, a row without parent standing for itself."""
    return rows.select(F.coalesce("parent", "child").alias("key"), "pos").groupBy("key").agg(F.min("pos").alias("pos"))


def global_counts(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """(key, cited_by_global): counts known for a DOI key, folded onto the held items with that DOI."""
    known = metadata.select(ids.local_id(F.col("key")).alias("doi"), "cited_by_global").where(F.col("key").startswith("doi:")).groupBy("doi").agg(F.max("cited_by_global").alias("cited_by_global"))
    return items.select("key", F.col("norm_doi").alias("doi")).join(known, "doi").select("key", "cited_by_global")
