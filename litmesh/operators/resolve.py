"""From texts and links to candidate edges: the strategies that resolve identifiers, titles and locators.

Each gives candidate edges (from_key, to_key, via, confidence, evidence) of held citing works. Work tables
are joined on keys with Catalyst's choice of strategy; the containment join (title-match) holds a sieve of
the titles in each task, of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.functions.kernels import find_dois_udf, names_journal_udf, norm_title, norm_title_udf
from litmesh.functions.references import entries_udf, section_udf
from litmesh.session import stage

#: Confidence by section quality, and factors of parsed references: fixed values.
TITLE_CONFIDENCE = {"heading": 0.8, "numbered": 0.75, "tail": 0.4}
LOCATOR_CONFIDENCE = {"heading": 0.85, "numbered": 0.8, "tail": 0.5}
SECTION_FACTOR = {"heading": 1.0, "numbered": 0.95, "tail": 0.6}
QUALITY_RANK = {"heading": 3, "numbered": 2, "tail": 1, "none": 0}
EDGE = ("from_key", "to_key", "via", "confidence", "evidence")


def _by(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), c)


def sections(texts: DataFrame) -> DataFrame:
    """(att_key, parent_key, text, flat, quality) of texts (att_key, parent_key, text); staged, since every strategy reads it."""
    s = texts.select("att_key", "parent_key", section_udf("text").alias("s"))
    return stage(s.select("att_key", "parent_key", "s.text", "s.flat", "s.quality"))


def _doi_edges(found: DataFrame, index: DataFrame, own: DataFrame, via: str, confidence: float, externals: bool) -> DataFrame:
    """Edges of (att_key, parent_key, dois): a document whose only DOI is its own says nothing."""
    docs = found.join(own.select(F.col("key").alias("parent_key"), F.col("norm_doi").alias("own")), "parent_key", "left")
    docs = docs.where(~((F.size("dois") == 1) & F.coalesce(F.get("dois", 0) == F.col("own"), F.lit(False))))
    rows = docs.select("att_key", "parent_key", F.explode("dois").alias("doi"), "own").where(~F.coalesce(F.col("doi") == F.col("own"), F.lit(False)))
    hit = rows.join(index.select("doi", F.col("key").alias("held")), "doi", "left").where(F.col("held").isNull() | (F.col("held") != F.col("parent_key")))
    if not externals:
        hit = hit.where("held is not null")
    return hit.select(F.col("parent_key").alias("from_key"), F.coalesce("held", ids.external_key(F.lit("doi"), F.col("doi"))).alias("to_key"), F.lit(via).alias("via"), F.lit(confidence).alias("confidence"), F.create_map(F.lit("attachment"), F.col("att_key"), F.lit("doi"), F.col("doi")).alias("evidence"))


def pdf_links(uris: DataFrame, items: DataFrame, index: DataFrame, *, externals: bool = True) -> DataFrame:
    """Edges of link targets (att_key, parent_key, uris)."""
    dois = F.array_distinct(F.filter(F.transform("uris", ids.norm_doi), lambda d: d.isNotNull()))
    return _doi_edges(uris.select("att_key", "parent_key", dois.alias("dois")), index, items, "pdf-links", 0.95, externals)


def text_doi(secs: DataFrame, items: DataFrame, index: DataFrame, *, least: str = "tail", externals: bool = True) -> DataFrame:
    """Edges of the DOIs printed in reference sections of quality `least` and better."""
    good = secs.where(_by(F.col("quality"), QUALITY_RANK) >= QUALITY_RANK[least])
    return _doi_edges(good.select("att_key", "parent_key", find_dois_udf("flat").alias("dois")), index, items, "text-doi", 0.9, externals)


class _Rolling:
    """Hashes of stretches of a text in constant time each, by sums of powers modulo 2^64; equal stretches have equal hashes."""

    BASE = 0x9E3779B97F4A7C15
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(self.powers) <= len(c):
            steps = np.full(2 * len(c), self.BASE, np.uint64), np.full(2 * len(c), pow(self.BASE, -1, 1 << 64), np.uint64)
            _Rolling.powers, _Rolling.inverse = (np.cumprod(np.r_[np.uint64(1), x]) for x in steps)
        self.sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * self.powers[: len(c)], out=self.sums[1:])

    def of(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the stretches of n letters from `at` on."""
        h = (self.sums[at + n] - self.sums[at]) * self.inverse[at] ^ np.uint64(0x51ED270B) * np.asarray(n).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


SIEVE_BITS = 27  # bits of the sieve of titles, as a power of two


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << SIEVE_BITS) - 1)
    return (h & low).astype(np.int64), (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _title_sieve(titles: DataFrame, least: int):
    """A broadcast Bloom filter of the titles (t) and of their first `least` letters, of a fixed size whatever their number."""

    def mark(batches):
        for batch in batches:
            ts = batch.column(0).to_pylist()
            if ts:
                rolling, n = _Rolling("".join(ts)), np.array([len(t) for t in ts])
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*_bits(rolling.of(at, least)), *_bits(rolling.of(at, n))]))], ["bit"])

    marked = titles.select("t").distinct().mapInArrow(mark, "bit long")
    words = marked.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # a word of the sieve each, 2^SIEVE_BITS bits at most
    return titles.sparkSession.sparkContext.broadcast((words.column("word").to_numpy().astype(np.int32), words.column("bits").to_numpy()))  # only words that hold a bit


def _opened(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[words[0]] = words[1].view(np.uint64)
    return sieve


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _bits(h)
    at = np.flatnonzero(sieve[one >> 6] >> (one & 63).astype(np.uint64) & np.uint64(1))
    two = two[at]
    return at[np.flatnonzero(sieve[two >> 6] >> (two & 63).astype(np.uint64) & np.uint64(1))]


def _standing(texts: list[str], sieve: np.ndarray, least: int, lengths: list[int]):
    """(text, offset, letters) of all stretches that may be a title."""
    whole = "\0".join(texts)
    if len(whole) < least:
        return
    n = np.array([len(t) for t in texts])
    starts = np.cumsum(n + 1) - n - 1
    rolling = _Rolling(whole)
    at = _passes(sieve, rolling.of(np.arange(len(whole) - least + 1), least))
    of = np.searchsorted(starts, at, side="right") - 1
    room = starts[of] + n[of] - at
    for size in lengths:
        fit = np.flatnonzero(room >= size)
        if not len(fit):
            break
        for i in fit[_passes(sieve, rolling.of(at[fit], size))]:
            yield int(of[i]), int(at[i] - starts[of[i]]), size


def title_match(secs: DataFrame, items: DataFrame, *, least_title: int = 30, reject_impossible_year: bool = True, require_author: bool = False, window: int = 300, most_letters: int = 500_000) -> DataFrame:
    """Edges to held works whose normalised title stands in a reference section.

    Sections are read once, whatever the number of titles: stretches whose first `least_title` letters
    and whose whole pass a sieve of the titles meet the titles in an equi-join. A task hashes `most_letters` or
    the letters of a longer section at once.
    """
    least = max(1, least_title)
    titles = stage(items.select("key", norm_title_udf("title").alias("t"), "year", F.coalesce(F.get("creators", 0), F.lit("")).alias("author")).where(F.length("t") >= least))
    lengths = sorted(r[0] for r in titles.select(F.length("t")).distinct().collect())
    shared = _title_sieve(titles, least)
    schema = "section long, att_key string, parent_key string, quality string, t string, found_at int, near string"
    text = secs.where("quality <> 'none'").select("att_key", "parent_key", "quality", "flat")

    def scan(batches):
        number, sieve = TaskContext.get().partitionId() << 40, _opened(shared.value)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            while rows:
                texts, letters = [], 0
                while letters < most_letters and len(texts) < len(rows):
                    texts.append(norm_title(rows[len(texts)][3]))
                    letters += len(texts[-1]) + 1
                part, rows = rows[: len(texts)], rows[len(texts) :]
                found = [(number + i, *part[i][:3], texts[i][at : at + n], at, texts[i][max(0, at - window) : at + n + window] if require_author else None) for i, at, n in _standing(texts, sieve, least, lengths)]
                number += len(texts)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], ["section", "att_key", "parent_key", "quality", "t", "found_at", "near"])

    stands = text.mapInArrow(scan, schema).groupBy("section", "att_key", "parent_key", "quality", "t").agg(F.min_by("near", "found_at").alias("near"))
    hit = stands.join(titles.select(F.col("key").alias("to_key"), F.col("year").alias("to_year"), "author", "t"), "t").where(F.col("to_key") != F.col("parent_key"))
    hit = hit.join(items.select(F.col("key").alias("parent_key"), F.col("year").alias("from_year")), "parent_key", "left")
    if reject_impossible_year:
        hit = hit.where(~ids.impossible_year(F.col("from_year"), F.col("to_year")))
    if require_author:
        hit = hit.where(F.expr("contains(near, lower(author))"))
    return hit.select(F.col("parent_key").alias("from_key"), "to_key", F.lit("title-match").alias("via"), F.coalesce(_by(F.col("quality"), TITLE_CONFIDENCE), F.lit(0.4)).alias("confidence"), F.create_map(F.lit("attachment"), F.col("att_key"), F.lit("segment"), F.col("quality")).alias("evidence"))


def locators(items: DataFrame) -> DataFrame:
    """(volume, page, key, tokens, year) of held works that a locator can name."""
    name = F.coalesce(F.nullif("journal_abbreviation", F.lit("")), F.nullif("publication", F.lit("")))
    i = items.select("key", F.trim("volume").alias("volume"), ids.first_page(F.col("pages")).alias("page"), norm_title_udf(name).alias("journal"), "year")
    return i.where(F.col("volume").rlike(r"^\d{1,4}$") & F.col("page").isNotNull() & (F.col("journal") != "")).select("volume", "page", "key", ids.journal_tokens(F.col("journal")).alias("tokens"), "year")


def locator_match(secs: DataFrame, items: DataFrame, *, window: int = 80, year_window: int = 40, require_year: bool = True) -> DataFrame:
    """Edges to held works whose journal, volume and first page a section prints: the words of a section meet the locators in an equi-join."""
    flat = secs.where("quality <> 'none'").select("att_key", "parent_key", "quality", norm_title_udf("flat").alias("n"))
    words = flat.select("att_key", "parent_key", "quality", "n", F.split("n", " ").alias("w"))
    size = F.size("w")
    pairs = words.select("att_key", "parent_key", "quality", "w", F.explode(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))).alias("i")).where(F.element_at("w", F.col("i")).rlike(r"^\d") & (F.size("w") > 1))
    second, third = F.get("w", F.col("i")), F.get("w", F.col("i") + 1)
    both = F.filter(F.array(F.struct(second.alias("page"), (F.col("i") + 1).alias("end")), F.struct(F.when(second.rlike(r"^(1[5-9]\d\d|20[0-4]\d)$"), third).alias("page"), (F.col("i") + 2).alias("end"))), lambda x: x["page"].isNotNull())
    before = F.substring(F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("i") - 41), F.least(F.lit(41), F.col("i") - 1)), " "), F.lit(-(window - 1)), F.lit(window - 1))
    cand = pairs.select("att_key", "parent_key", "quality", F.element_at("w", F.col("i")).alias("volume"), before.alias("before"), F.explode(both).alias("b"), "w")
    cand = cand.select("att_key", "parent_key", "quality", "volume", "before", F.col("b.page").alias("page"), F.substring(F.array_join(F.slice("w", F.col("b.end"), F.lit(20)), " "), 1, year_window).alias("after"))
    hit = cand.join(locators(items), ["volume", "page"]).where(F.col("key") != F.col("parent_key"))
    if require_year:
        y = F.col("year").cast("string")
        hit = hit.where(F.col("year").isNull() | F.col("after").contains(y) | F.col("before").contains(y))
    hit = hit.where(names_journal_udf("before", "tokens")).dropDuplicates(["att_key", "key"])
    return hit.select(F.col("parent_key").alias("from_key"), F.col("key").alias("to_key"), F.lit("locator-match").alias("via"), F.coalesce(_by(F.col("quality"), LOCATOR_CONFIDENCE), F.lit(0.5)).alias("confidence"), F.create_map(F.lit("attachment"), F.col("att_key"), F.lit("locator"), F.concat_ws(" ", "volume", "page")).alias("evidence"))


def entries(secs: DataFrame) -> DataFrame:
    """One row for each parsed entry of a section."""
    parsed = secs.where("quality <> 'none'").select("att_key", "parent_key", "quality", F.explode(entries_udf("text")).alias("e"))
    return parsed.select("att_key", "parent_key", "quality", "e.*")


def resolve_entries(parsed: DataFrame, items: DataFrame, *, most_ghost: float = 0.55) -> DataFrame:
    """Edges of parsed references: by DOI, then arXiv id, then whole title; else a work known by its title only.

    `parsed` needs (att_key, parent_key, quality, title, surname, year, doi, arxiv_id, parse_confidence).
    The first way that applies decides; a reference that resolves to the citing work itself gives none.
    """
    held = items.select("key", "norm_doi", "year", "creators", "seq", norm_title_udf("title").alias("t"))
    by_doi = held.where("norm_doi is not null").groupBy(F.col("norm_doi").alias("doi")).agg(F.max_by("key", F.struct("seq", "key")).alias("doi_key"))
    by_title = held.where("t <> ''").groupBy("t").agg(F.min_by(F.struct("key", "year", "creators"), F.struct("seq", "key")).alias("h"))
    own = held.select(F.col("key").alias("parent_key"), F.col("norm_doi").alias("own"), F.col("year").alias("from_year"))
    p = parsed.join(own, "parent_key", "left").withColumn("doi", F.when(F.coalesce(F.col("doi") == F.col("own"), F.lit(False)), None).otherwise(F.col("doi")))
    p = p.withColumn("t", norm_title_udf("title")).join(by_doi, "doi", "left").join(by_title, "t", "left")
    factor = F.coalesce(_by(F.col("quality"), SECTION_FACTOR), F.lit(0.6))
    titled = F.col("h").isNotNull() & (F.col("t") != "") & ~ids.impossible_year(F.col("from_year"), F.col("h.year"))
    signature = ids.ref_signature(F.col("t"))
    agrees = ids.surname_agrees(F.col("surname"), F.col("h.creators"))
    to = F.when(F.col("doi").isNotNull(), F.coalesce("doi_key", ids.external_key(F.lit("doi"), F.col("doi")))).when(F.col("arxiv_id").isNotNull(), ids.external_key(F.lit("arxiv"), F.col("arxiv_id"))).when(titled, F.col("h.key")).otherwise(ids.external_key(F.lit("ref"), signature))
    confidence = F.when(F.col("doi").isNotNull(), 0.9).when(F.col("arxiv_id").isNotNull(), 0.85).when(titled, F.round(F.when(agrees, 0.8).otherwise(0.65) * factor, 3)).otherwise(F.round(F.least(F.col("parse_confidence") * factor, F.lit(most_ghost)), 3))
    out = p.withColumn("to_key", to).withColumn("confidence", confidence).where(F.col("to_key").isNotNull() & (F.col("to_key") != F.col("parent_key")) & (F.col("confidence") > 0))
    return out.select(F.col("parent_key").alias("from_key"), "to_key", F.lit("ref-strings").alias("via"), "confidence", F.create_map(F.lit("attachment"), F.col("att_key"), F.lit("title"), F.coalesce("title", F.lit(""))).alias("evidence"), "title", "surname", "year")


def described_by(resolved: DataFrame) -> DataFrame:
    """(key, title, creators, year, source): what parsed references say of works that are not held, the first row by citing work and title."""
    r = resolved.where(ids.is_external(F.col("to_key")) & F.col("title").isNotNull())
    first = r.groupBy(F.col("to_key").alias("key")).agg(F.min_by(F.struct("title", "surname", "year"), F.struct("from_key", "title")).alias("m"))
    return first.select("key", "m.title", F.when(F.col("m.surname").isNotNull(), F.array("m.surname")).otherwise(F.array().cast("array<string>")).alias("creators"), "m.year", F.array(F.lit("ref-strings")).alias("source"))


def openalex_edges(works: DataFrame, items: DataFrame) -> DataFrame:
    """Edges of a second source's works (id, doi, referenced_works): work to references to held items by id.

    Of items that share a DOI the first counts. References without a held item are works outside.
    """
    by_doi = items.where("norm_doi is not null").groupBy("norm_doi").agg(F.min_by("key", F.struct("seq", "key")).alias("key"))
    w = works.select(ids.short_openalex(F.col("id")).alias("id"), ids.norm_doi(F.col("doi")).alias("norm_doi"), "referenced_works").join(by_doi, "norm_doi")
    held = w.groupBy("id").agg(F.min("key").alias("held"))
    refs = w.select(F.col("key").alias("from_key"), F.explode("referenced_works").alias("r")).select("from_key", ids.short_openalex(F.col("r")).alias("id")).distinct()
    out = refs.join(held, "id", "left").withColumn("to_key", F.coalesce("held", ids.external_key(F.lit("openalex"), F.col("id")))).where("from_key <> to_key")
    return out.select("from_key", "to_key", F.lit("openalex").alias("via"), F.lit(0.98).alias("confidence"), F.create_map(F.lit("work"), F.col("id")).alias("evidence"))


def enrich(keys: DataFrame, *providers: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """Metadata of keys filled from providers in order: (key, title, creators, year, venue, cited_by_global, gone, source).

    Each provider is (answers, namespaces it supports) and is asked only for keys still incomplete, that is
    without title or cited_by_global. A field is filled once; empty lists and strings fill nothing.
    """
    fields = ("title", "creators", "year", "venue", "cited_by_global")
    out = keys.select("key").distinct()
    for f, t in zip(fields, ("string", "array<string>", "int", "string", "bigint")):
        out = out.withColumn(f, F.lit(None).cast(t))
    out = out.withColumn("gone", F.lit(False)).withColumn("source", F.array().cast("array<string>"))
    for answers, namespaces in providers:
        value = lambda f: F.when(F.size(f) > 0, F.col(f)) if f == "creators" else F.when(F.col(f).cast("string") != "", F.col(f))
        a = answers.where(ids.namespace(F.col("key")).isin(*namespaces)).groupBy("key").agg(*[F.min(value(f)).alias(f"_{f}") for f in fields], F.bool_or(F.coalesce("gone", F.lit(False))).alias("_gone"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source")))).alias("_source"))
        j = out.join(a, "key", "left")
        wanted = F.col("title").isNull() | F.col("cited_by_global").isNull()
        use = wanted & F.col("_source").isNotNull()
        out = j.select("key", *[F.when(use, F.coalesce(f, f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], (F.col("gone") | F.coalesce(use & F.col("_gone"), F.lit(False))).alias("gone"), F.when(use, F.array_union("source", "_source")).otherwise(F.col("source")).alias("source"))
    return out


def describe_nodes(looked_up: DataFrame, parsed: DataFrame) -> DataFrame:
    """Looked-up metadata over parsed, field by field: (key, title, creators, year, source)."""
    a = looked_up.select("key", "title", F.when(F.size("creators") > 0, F.col("creators")).alias("creators"), "year", "source")
    b = parsed.select("key", F.col("title").alias("_t"), F.col("creators").alias("_c"), F.col("year").alias("_y"), F.col("source").alias("_s"))
    j = a.join(b, "key", "full_outer")
    none = F.array().cast("array<string>")
    return j.select("key", F.coalesce("title", "_t").alias("title"), F.coalesce("creators", "_c", none).alias("creators"), F.coalesce("year", "_y").alias("year"), F.array_union(F.coalesce("source", none), F.coalesce("_s", none)).alias("source"))
