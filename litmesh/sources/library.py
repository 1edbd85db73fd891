"""Sources: a library's attribute store, collections and selections, link annotations, a synthetic library."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmesh.session import stage

#: Kinds of rows that are no works, fields that name the venue, and the largest file a task holds.
NOT_WORKS = ("attachment", "note", "annotation")
VENUE_FIELDS = ("publicationTitle", "proceedingsTitle", "bookTitle")
MOST_BYTES = 256 << 20
URI = re.compile(rb"/URI\s*\(((?:\\.|[^\\)])*)\)")


def pivot_items(values: DataFrame, items: DataFrame, deleted: DataFrame, children: DataFrame) -> DataFrame:
    """Items of an attribute store: `values` (item_id, field, value), `items` (item_id, key, item_type).

    Deleted rows, child rows, kinds that are no works and untitled rows are left out by anti-joins and
    filters before the pivot, which is one aggregation with conditional maxima.
    """
    pick = lambda *names: F.max(F.when(F.col("field").isin(*names), F.col("value")))
    keep = items.where(~F.col("item_type").isin(*NOT_WORKS)).join(deleted.select("item_id"), "item_id", "left_anti").join(children.select("item_id"), "item_id", "left_anti")
    wide = values.join(keep.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(pick("title").alias("title"), pick("DOI").alias("doi"), pick("date").alias("date"), F.coalesce(*[pick(v) for v in VENUE_FIELDS]).alias("publication"), pick("volume").alias("volume"), pick("pages").alias("pages"))
    return keep.join(wide, "item_id").where("title is not null")


def ordered_creators(links: DataFrame) -> DataFrame:
    """(item_id, creators) of (item_id, name, pos): names in order."""
    return links.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("c")).select("item_id", F.transform("c", lambda x: x["name"]).alias("creators"))


def sorted_tags(links: DataFrame) -> DataFrame:
    return links.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def existing_attachments(attachments: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Attachments of held items whose file is there."""
    return attachments.join(items.select(F.col("key").alias("parent_key")), "parent_key", "left_semi").join(files.select("path"), "path", "left_semi")


def texts(cached: DataFrame, extracted: DataFrame) -> DataFrame:
    """(att_key, text): the cached text, else the extracted one."""
    e = extracted.select("att_key", F.col("text").alias("_t"))
    return cached.join(e, "att_key", "full_outer").select("att_key", F.coalesce("text", "_t").alias("text"))


def collection_items(membership: DataFrame, tree: DataFrame, root: str, *, recursive: bool = True) -> DataFrame:
    """(key): items in a collection, and in those below it; `membership` is (collection, key), `tree` (collection, parent)."""
    scope = level = tree.sparkSession.createDataFrame([(root,)], "collection string")
    while recursive:  # each round adds collections that were not there, so a circle ends too
        below = tree.join(level.withColumnRenamed("collection", "parent"), "parent", "left_semi").select("collection").join(scope, "collection", "left_anti").distinct()
        if below.isEmpty():
            break
        level = stage(below)
        scope = scope.unionByName(level)
    return membership.join(scope, "collection", "left_semi").select("key").distinct()


def selected_items(keys: DataFrame, items: DataFrame, children: DataFrame) -> DataFrame:
    """(key): picked rows as works: a child stands for its parent, missing ones are dropped, each work once."""
    own = keys.join(children.select(F.col("key").alias("key"), "parent_key"), "key", "left").select(F.coalesce("parent_key", "key").alias("key")).distinct()
    return own.join(items.select("key"), "key", "left_semi")


def _unescape(raw: bytes) -> str:
    return re.sub(rb"\\(.)", rb"\1", raw).decode("latin-1")


def scan_uris(data: bytes | None, every: bool = False) -> list[str]:
    """Link targets of a PDF: those in plain sight, and those in compressed object streams, or with `every` in all
    compressed streams; a stream ends at its stated length."""
    if not data:
        return []
    found = [_unescape(m) for m in URI.findall(data)]
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", data):
        head = m[1]
        if b"/FlateDecode" not in head or not (every or b"/ObjStm" in head):
            continue
        n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        stop = m.end() + int(n[1]) if n else data.find(b"endstream", m.end())
        try:
            found += [_unescape(x) for x in URI.findall(zlib.decompressobj().decompress(data[m.end() : stop]))]
        except zlib.error:
            continue
    return list(dict.fromkeys(found))


def pdf_uris(spark: SparkSession, path: str, *, every: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, uris) of the PDFs under a folder. A file over `most_bytes` is not read, since a task holds it whole: its uris are null, those of a file without links an empty list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def scan(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "uris": f["content"].map(lambda x: scan_uris(x, every))})

    schema = "path string, uris array<string>"
    read = files.where(F.col("length") <= most_bytes).select("path", "content").mapInPandas(scan, schema)
    return read.unionByName(files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("array<string>").alias("uris")))


def uris_of(content: DataFrame, *, every: bool = False) -> DataFrame:
    """(att_key, uris) of (att_key, content)."""

    def scan(frames):
        for f in frames:
            yield pd.DataFrame({"att_key": f["att_key"], "uris": f["content"].map(lambda x: scan_uris(x, every))})

    return content.select("att_key", "content").mapInPandas(scan, "att_key string, uris array<string>")


def page_lines(items: DataFrame, *, line_gap: float = 3.0, gutter: float = 24.0) -> DataFrame:
    """(page, column, line, text) of text pieces (page, x, y, w, str): columns by the widest gap, lines by their height.

    The gap between columns is where no piece of the page's middle third reaches over; pieces whose
    heights differ by less than `line_gap` are one line.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        page, right = f["page"].iloc[0], float((f["x"] + f["w"]).max())
        spans = sorted(zip(f["x"], f["x"] + f["w"]))
        split, reach = None, 0.0
        for a, b in spans:
            if a - reach >= gutter and right / 3 < (a + reach) / 2 < 2 * right / 3:
                split = (a + reach) / 2
            reach = max(reach, b)
        f = f.assign(column=0 if split is None else (f["x"] > split).astype(int)).sort_values(["column", "y", "x", "str"], ascending=[True, False, True, True])
        new = (f["column"] != f["column"].shift()) | ((f["y"].shift() - f["y"]).abs() >= line_gap)
        f["line"] = new.cumsum() - 1
        out = f.groupby(["column", "line"], as_index=False).agg(text=("str", " ".join))
        return out.assign(page=page)[["page", "column", "line", "text"]]

    return items.groupBy("page").applyInPandas(one, "page int, column int, line int, text string")


def synthetic(spark: SparkSession, n: int, seed: int = 1, edge_ratio: float = 1.4, external: float = 0.12, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, edges) of a made-up library: works `first` to `first + n`, heavy-tailed counts and citations, the same for the same seed.

    Rows are made by tasks from hashes of their numbers. A work is cited in proportion to the root of its
    age, so the library grows by calling again with `first` where it ended: older works stay the most cited.
    """
    uniform = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    key = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("long").cast("string"), 9, "0"))
    works = spark.range(first, first + n)
    items = works.select(key(F.col("id")).alias("key"), F.col("id").alias("seq"), F.concat(F.lit("Synthetic work number "), "id").alias("title"), (1970 + F.floor(uniform(1) * 56)).cast("int").alias("year"), F.floor(10 * (F.pow(uniform(2), F.lit(-1 / 1.2)) - 1)).cast("long").alias("count"))
    cites = spark.range(int(edge_ratio * first), int(edge_ratio * (first + n)))
    ends = cites.select((first + F.floor(uniform(3) * n)).alias("a"), F.floor(F.pow(uniform(4), F.lit(2)) * (first + n)).alias("b"), (uniform(5) < external).alias("out")).where("a <> b")
    to = F.when(F.col("out"), F.concat(F.lit("doi:10.5555/x"), F.col("b"))).otherwise(key(F.col("b")))
    return items, ends.select(key(F.col("a")).alias("from_key"), to.alias("to_key")).distinct()
