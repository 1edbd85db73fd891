"""Queries of sources, text operators, resolution and enrichment."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.functions import kernels as K
from litmesh.functions.references import section_udf
from litmesh.operators import edges as E
from litmesh.operators import items as I
from litmesh.operators import resolve as X
from litmesh.plans.build import Context, build
from litmesh.queries import CURRENT, NS, REC, R, edges_of, items_of, joined, merged_of, norm_doi_sql
from litmesh.session import stage, table
from litmesh.sources import library as S
from litmesh.streaming import edges as T


def texts_of(s, d):
    """Documents that belong to an attachment of a held item."""
    a = table(s, d, "attachments").select("att_key", "parent_key").distinct()
    return table(s, d, "documents").where("att_key is not null and text is not null").select("att_key", "text").join(a, "att_key").select("att_key", "parent_key", "text")


CLOSING = "Library, “An entry that closes every list so that each is long enough to be one,” Annals of Closing Entries, vol. 1, pp. 1, 1901."
BODY = "This work is held by the library and its text goes on for a while before it comes to what it cites. " * 6


def printed_of(s, d):
    """(parent_key, to_key, …): what a held work prints of each work it cites, whether held or known from elsewhere."""
    cites = edges_of(s, d).where("from_key <> to_key").select(F.col("from_key").alias("parent_key"), "to_key").distinct()
    i = items_of(s, d)
    venue = F.coalesce(F.nullif("journal_abbreviation", F.lit("")), F.nullif("publication", F.lit("")))
    held = i.select(F.col("key").alias("to_key"), "title", F.get("creators", 0).alias("author"), "year", venue.alias("venue"), "volume", ids.first_page(F.col("pages")).alias("page"), F.col("norm_doi").alias("doi"))
    w = table(s, d, "described").join(i.select("key"), "key", "left_anti")
    outside = w.select(F.col("key").alias("to_key"), "title", F.get("creators", 0).alias("author"), "year", "venue", "volume", ids.first_page(F.col("pages")).alias("page"), F.when(F.col("key").startswith("doi:"), F.substring("key", 5, 1000)).alias("doi"))
    return cites.join(i.select(F.col("key").alias("parent_key")), "parent_key", "left_semi").join(held.unionByName(outside), "to_key")


def written_texts(s, d):
    """(att_key, parent_key, text): a text for each held work that cites a described one, its references in one of eight styles."""
    p = printed_of(s, d)
    name, year = F.coalesce(F.regexp_extract("author", r"([^\s,]+),|([^\s,]+)$", 0), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    name = F.when(name == "", "Anonymous").otherwise(F.initcap(F.regexp_replace(name, r"[^\p{L}'-]", "")))
    text = lambda *parts: F.concat_ws("", *parts)  # noqa: E731  leaves out what is null
    title, venue, volume, page = (F.coalesce(c, F.lit("")) for c in ("title", "venue", "volume", "page"))
    styles = (
        text(F.lit("A. "), name, F.lit(", “"), title, F.lit(",” "), venue, F.lit(", vol. "), volume, F.lit(", "), page, F.lit(", "), year, F.lit(".")),
        text(name, F.lit(", A. ("), year, F.lit("). "), title, F.lit(". "), venue, F.lit(", "), volume, F.lit(", "), page, F.lit(".")),
        text(F.lit("Ada "), name, F.lit(". "), year, F.lit(". "), title, F.lit(". "), venue, F.lit(" "), volume, F.lit(", "), page, F.lit(".")),
        text(name, F.lit(" AB. "), title, F.lit(". "), venue, F.lit(". "), year, F.lit(";"), volume, F.lit(":"), page, F.lit(".")),
        text(name, F.lit(", A. "), title, F.lit(". "), venue, F.lit(" "), volume, F.lit(", "), page, F.lit(" ("), year, F.lit(").")),
        text(F.lit("A. "), name, F.lit(", "), title, F.lit(", "), venue, F.lit(" "), volume, F.lit(" ("), year, F.lit(") "), page, F.lit(".")),
        text(name, F.lit(", A. "), year, F.lit(" "), title, F.lit(". "), venue, F.lit(" "), volume, F.lit(", "), page, F.lit(".")),
        text(name, F.lit(": "), title, F.lit("; "), venue, F.lit("; "), volume, F.lit(", "), page, F.lit("; "), year, F.lit(".")),
    )
    kind = F.pmod(F.xxhash64("parent_key"), F.lit(len(styles)))
    entry = F.coalesce(*[F.when(kind == k, x) for k, x in enumerate(styles)])
    entry = F.concat(F.regexp_replace(entry, r"\s+", " "), F.coalesce(F.concat(F.lit(" doi:"), F.col("doi")), F.lit("")))
    lists = p.groupBy("parent_key").agg(F.array_sort(F.collect_list(F.struct("to_key", entry.alias("entry")))).alias("es"))
    lines = F.concat(F.transform("es", lambda e: e["entry"]), F.array(F.lit(CLOSING)))
    numbered = F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return lists.select(F.concat(F.lit("A"), "parent_key").alias("att_key"), "parent_key", F.concat(F.lit(BODY + "\nReferences\n"), F.array_join(numbered, "\n")).alias("text"))


FOLDED = r"trim(regexp_replace(regexp_replace(lower(strip_accents(lower(coalesce({0}, '')))), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
#: What `printed_of` gives of DOIs and titles; FOUND has the DOIs that a text shows of them.
PRINTED = f"""prt AS (SELECT DISTINCT e.from_key AS f, e.to_key AS t, w.title, w.doi FROM edges e JOIN (SELECT key, title, norm_doi AS doi FROM rec UNION ALL SELECT key, title, CASE WHEN starts_with(key, 'doi:') THEN substr(key, 5) END FROM described WHERE key NOT IN (SELECT key FROM rec)) w ON w.key = e.to_key WHERE e.from_key <> e.to_key AND e.from_key IN (SELECT key FROM rec))"""
FOUND = r"""fnd AS (SELECT DISTINCT f, x AS doi FROM (SELECT f, """ + norm_doi_sql(r"regexp_extract(doi, '10\.\d{4,9}/[-._;()/:<>a-zA-Z0-9]+')") + r""" AS x FROM prt WHERE doi IS NOT NULL) WHERE x IS NOT NULL AND regexp_matches(regexp_replace(x, '^[^/]*/', ''), '\d'))"""


def _values(s, d):
    """The items as an attribute store, the way the library's database keeps them."""
    i = I.current(table(s, d, "items"))
    pairs = [("title", "title"), ("DOI", "doi"), ("date", "date"), ("publicationTitle", "publication"), ("volume", "volume"), ("pages", "pages")]
    return i, i.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in pairs])).alias("p")).select("item_id", "p.field", "p.value").where("value is not null")


# --- sources -----------------------------------------------------------------


@R.add("src1_pivot_items", f"WITH {CURRENT} SELECT item_id, key, item_type, title, doi, date, publication, volume, pages FROM cur WHERE title IS NOT NULL AND item_id % 17 <> 0 AND item_type <> 'note'")
def _(s, d):
    i, values = _values(s, d)
    none = i.where("false").select("item_id")
    return S.pivot_items(values, i.select("item_id", "key", "item_type"), i.where("item_id % 17 = 0").select("item_id"), none).select("item_id", "key", "item_type", "title", "doi", "date", "publication", "volume", "pages")


@R.add("src2_ordered_creators", f"WITH {CURRENT} SELECT item_id, array_to_string(creators, '; ') AS creators FROM cur WHERE len(creators) > 0")
def _(s, d):
    links = I.current(table(s, d, "items")).select("item_id", F.posexplode("creators").alias("pos", "name"))
    return S.ordered_creators(links).select("item_id", F.array_join("creators", "; ").alias("creators"))


@R.add("src3_sorted_tags", f"WITH {CURRENT} SELECT item_id, array_to_string(list_sort(list_distinct(tags)), '; ') AS tags FROM cur WHERE len(tags) > 0")
def _(s, d):
    return S.sorted_tags(I.current(table(s, d, "items")).select("item_id", F.explode("tags").alias("tag"))).select("item_id", F.array_join("tags", "; ").alias("tags"))


@R.add("src4_venue", f"WITH {CURRENT} SELECT item_id, coalesce(publication, journal_abbreviation, item_type) AS venue FROM cur")
def _(s, d):
    return I.current(table(s, d, "items")).select("item_id", F.coalesce("publication", "journal_abbreviation", "item_type").alias("venue"))


@R.add("src5_attachments", "SELECT att_key, parent_key, count(*) AS n FROM attachments WHERE parent_key IN (SELECT key FROM items) AND path IN (SELECT path FROM attachments WHERE content_type = 'application/pdf') GROUP BY 1, 2")
def _(s, d):
    a = table(s, d, "attachments")
    return S.existing_attachments(a, table(s, d, "items"), a.where("content_type = 'application/pdf'")).groupBy("att_key", "parent_key").agg(F.count("*").alias("n"))


@R.add("src6_texts", "SELECT coalesce(a.att_key, b.att_key) AS att_key, length(coalesce(a.text, b.text)) AS n FROM (SELECT att_key, max(text) AS text FROM documents WHERE att_key IS NOT NULL AND source = 'fulltext' GROUP BY 1) a FULL JOIN (SELECT att_key, max(text) AS text FROM documents WHERE att_key IS NOT NULL AND source <> 'fulltext' GROUP BY 1) b USING (att_key)")
def _(s, d):
    doc = table(s, d, "documents").where("att_key is not null")
    one = lambda c: doc.where(c).groupBy("att_key").agg(F.max("text").alias("text"))
    return S.texts(one("source = 'fulltext'"), one("source <> 'fulltext'")).select("att_key", F.length("text").alias("n"))


def _pdf_bytes(s, d):
    """A small PDF for each attachment that names a DOI, one link in sight and one in a compressed stream."""
    urls = table(s, d, "attachments").select("att_key", "parent_key").distinct().join(edges_of(s, d).where("to_key like 'doi:%'").groupBy(F.col("from_key").alias("parent_key")).agg(F.min("to_key").alias("a"), F.max("to_key").alias("b")), "parent_key")

    def pdf(frames):
        for f in frames:
            safe = lambda x: x[4:].replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            packed = [zlib.compress(f"1 0 <</S/URI/URI (https://doi.org/{safe(b)})>>".encode("latin-1", "replace")) for b in f["b"]]
            head = (f"%PDF-1.5\n<</S/URI/URI (https://doi.org/{safe(a)})>>\n<</Type/ObjStm/Filter/FlateDecode/Length {len(x)}>>\nstream\n".encode("latin-1", "replace") for a, x in zip(f["a"], packed))
            yield f[["att_key", "parent_key"]].assign(content=[h + x + b"\nendstream\n%%EOF" for h, x in zip(head, packed)])

    return urls.select("att_key", "parent_key", "a", "b").mapInPandas(pdf, "att_key string, parent_key string, content binary")


_LINKED = "SELECT a.att_key, array_to_string(list_sort(list_distinct(['https://doi.org/' || substr(min(to_key), 5), 'https://doi.org/' || substr(max(to_key), 5)])), ' ') AS uris FROM (SELECT DISTINCT att_key, parent_key FROM attachments) a JOIN edges ON from_key = parent_key WHERE to_key LIKE 'doi:%' GROUP BY a.att_key, a.parent_key"


@R.add("src7_pdf_uris", _LINKED)
def _(s, d):
    return S.uris_of(_pdf_bytes(s, d), every=True).select("att_key", F.array_join(F.array_sort("uris"), " ").alias("uris"))


@R.add("src8_object_streams", _LINKED)
def _(s, d):
    return S.uris_of(_pdf_bytes(s, d)).select("att_key", F.array_join(F.array_sort("uris"), " ").alias("uris"))


@R.add("src9_collection", f"WITH {CURRENT}, m AS (SELECT key, unnest(collections) AS c FROM cur), t AS (SELECT DISTINCT c, split_part(c, ' ', 2) AS p FROM m) SELECT DISTINCT key FROM m JOIN t USING (c) WHERE p = 'thesis'")
def _(s, d):
    m = I.current(table(s, d, "items")).select("key", F.explode("collections").alias("collection"))
    tree = m.select("collection").distinct().withColumn("parent", F.element_at(F.split("collection", " "), 2))
    return S.collection_items(m, tree, "thesis")


@R.add("src10_selection", "SELECT DISTINCT parent_key AS key FROM attachments WHERE content_type = 'application/pdf' AND parent_key IN (SELECT key FROM items)")
def _(s, d):
    a = table(s, d, "attachments")
    picked = a.where("content_type = 'application/pdf'").select(F.col("att_key").alias("key")).distinct()
    return S.selected_items(picked, table(s, d, "items").select("key").distinct(), a.select(F.col("att_key").alias("key"), "parent_key").distinct())


@R.add("src11_records", f"WITH {REC} SELECT key, title, norm_doi, year FROM rec")
def _(s, d):
    return items_of(s, d).select("key", "title", "norm_doi", "year")


def _openalex(s, d):
    """The second source's works as a table: its described works of held items with what these cite."""
    held = items_of(s, d).where("norm_doi is not null").select("key", "norm_doi")
    refs = edges_of(s, d).where("via = 'openalex'").groupBy(F.col("from_key").alias("key")).agg(F.collect_set("to_key").alias("r"))
    return held.join(refs, "key").select(F.concat(F.lit("https://openalex.org/W"), "key").alias("id"), F.col("norm_doi").alias("doi"), F.transform("r", lambda x: F.when(x.contains(":"), F.substring_index(x, ":", -1)).otherwise(F.concat(F.lit("https://openalex.org/W"), x))).alias("referenced_works"))


_OA = f"h AS (SELECT norm_doi, arg_min(key, (seq, key)) AS key FROM rec WHERE norm_doi IS NOT NULL GROUP BY 1), w AS (SELECT r.key AS wk, h.key AS k FROM rec r JOIN h USING (norm_doi) WHERE r.key IN (SELECT from_key FROM edges WHERE via = 'openalex')), x AS (SELECT DISTINCT w.k AS f, CASE WHEN contains(e.to_key, ':') THEN list_last(string_split(split_part(e.to_key, ':', 2), '/')) ELSE 'W' || e.to_key END AS id FROM w JOIN edges e ON e.from_key = w.wk AND e.via = 'openalex')"


@R.add("jn6_openalex", f"WITH {REC}, {_OA} SELECT f AS from_key, coalesce(w.k, 'openalex:' || id) AS to_key, count(*) AS n FROM x LEFT JOIN (SELECT 'W' || wk AS wid, min(k) AS k FROM w GROUP BY 1) w ON w.wid = id WHERE f <> coalesce(w.k, 'openalex:' || id) GROUP BY 1, 2")
def _(s, d):
    e = X.openalex_edges(_openalex(s, d), items_of(s, d))
    return e.groupBy("from_key", "to_key").agg(F.count("*").alias("n"))


@R.add("src13_page_lines", "WITH w AS (SELECT journal_id % 10 AS page, 700 - 12 * floor(journal_id / 20) AS y, name FROM journals) SELECT page, 0::INTEGER AS \"column\", CAST(row_number() OVER (PARTITION BY page ORDER BY y DESC) - 1 AS INTEGER) AS line, text FROM (SELECT page, y, string_agg(name, ' ' ORDER BY name) AS text FROM w GROUP BY 1, 2)")
def _(s, d):
    words = table(s, d, "journals").select((F.col("journal_id") % 10).cast("int").alias("page"), F.when(F.col("journal_id") % 2 == 0, 40.0).otherwise(320.0).alias("x"), (700.0 - 12 * F.floor(F.col("journal_id") / 20)).alias("y"), F.lit(200.0).alias("w"), F.col("name").alias("str"))
    return S.page_lines(words)


# --- text operators ----------------------------------------------------------


@R.add("doc1_sections")
def _(s, d):
    return table(s, d, "documents").select("doc_id", section_udf("text").alias("s")).select("doc_id", "s.quality", F.length("s.text").alias("n"))


@R.add("doc2_entries")
def _(s, d):
    return X.entries(X.sections(written_texts(s, d))).select("parent_key", "pos", "layout", "style", "surname", "year", "title", "parse_confidence")


@R.add("doc8_styles")
def _(s, d):
    return X.entries(X.sections(written_texts(s, d))).groupBy("style", "layout").agg(F.count("*").alias("entries"), F.count("title").alias("titled"))


# --- resolution --------------------------------------------------------------


@R.add("jn1_pdf_links", f"WITH {REC}, ix AS (SELECT norm_doi AS doi, arg_max(key, (seq, key)) AS key FROM rec WHERE norm_doi IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT from_key, {norm_doi_sql('substr(to_key, 5)')} AS doi FROM edges WHERE to_key LIKE 'doi:%' UNION SELECT from_key, r.norm_doi FROM edges e JOIN rec r ON r.key = e.to_key WHERE r.norm_doi IS NOT NULL), n AS (SELECT from_key, count(*) AS n FROM u WHERE doi IS NOT NULL GROUP BY 1), x AS (SELECT u.from_key, u.doi, r.norm_doi AS own FROM u JOIN n USING (from_key) LEFT JOIN rec r ON r.key = u.from_key WHERE u.doi IS NOT NULL AND NOT coalesce(u.doi = r.norm_doi, false)) SELECT x.from_key, coalesce(ix.key, 'doi:' || x.doi) AS to_key, count(*) AS n FROM x LEFT JOIN ix USING (doi) WHERE ix.key IS NULL OR ix.key <> x.from_key GROUP BY 1, 2")
def _(s, d):
    i = items_of(s, d)
    e = edges_of(s, d)
    links = e.where("to_key like 'doi:%'").select("from_key", F.substring("to_key", 5, 1000).alias("u")).unionByName(e.join(i.select(F.col("key").alias("to_key"), "norm_doi"), "to_key").where("norm_doi is not null").select("from_key", F.concat(F.lit("https://doi.org/"), "norm_doi").alias("u")))
    uris = links.groupBy(F.col("from_key").alias("parent_key")).agg(F.collect_set("u").alias("uris")).withColumn("att_key", F.concat(F.lit("A"), "parent_key"))
    return X.pdf_links(uris, i, I.by_doi(i)).groupBy("from_key", "to_key").agg(F.count("*").alias("n"))


@R.add("jn2_text_doi", f"WITH {REC}, {PRINTED}, {FOUND}, ix AS (SELECT norm_doi AS doi, arg_max(key, (seq, key)) AS key FROM rec WHERE norm_doi IS NOT NULL GROUP BY 1) SELECT DISTINCT f AS from_key, coalesce(ix.key, 'doi:' || fnd.doi) AS to_key, 0.9::DOUBLE AS confidence FROM fnd JOIN rec r ON r.key = fnd.f LEFT JOIN ix ON ix.doi = fnd.doi WHERE NOT coalesce(fnd.doi = r.norm_doi, false) AND (ix.key IS NULL OR ix.key <> f)")
def _(s, d):
    i = items_of(s, d)
    return X.text_doi(X.sections(written_texts(s, d)), i, I.by_doi(i)).select("from_key", "to_key", "confidence").distinct()


@R.add("jn3_title_match", f"WITH {REC}, {PRINTED}, txt AS (SELECT f, string_agg({FOLDED.format('title')}, ' | ') AS n FROM prt WHERE title IS NOT NULL GROUP BY f), ttl AS (SELECT key, year, {FOLDED.format('title')} AS t FROM rec) SELECT f AS from_key, ttl.key AS to_key, 0.8::DOUBLE AS confidence FROM txt JOIN rec r ON r.key = f JOIN ttl ON length(t) >= 30 AND contains(n, t) WHERE ttl.key <> f AND NOT coalesce(ttl.year > r.year + 1, false)")
def _(s, d):
    return X.title_match(X.sections(written_texts(s, d)), items_of(s, d)).select("from_key", "to_key", "confidence").distinct()


@R.add("jn4_locator_match")
def _(s, d):
    return X.locator_match(X.sections(written_texts(s, d)), items_of(s, d)).select("from_key", "to_key", "confidence").distinct()


def _parsed(s, d):
    return X.entries(X.sections(written_texts(s, d)))


@R.add("jn5_ref_strings")
def _(s, d):
    return X.resolve_entries(_parsed(s, d), items_of(s, d)).select("from_key", "to_key", "confidence").distinct()


@R.add("udf5_described_by")
def _(s, d):
    return X.described_by(X.resolve_entries(_parsed(s, d), items_of(s, d))).select("key", "title", joined("creators"), "year", joined("source"))


@R.add("jn7_enrich", """WITH a AS (SELECT key, CASE WHEN year % 2 = 0 THEN title END AS title, creators, year, venue, CASE WHEN year % 3 <> 0 THEN cited_by_global END AS g, gone FROM described WHERE starts_with(key, 'openalex:')),
b AS (SELECT key, title, creators, year, venue, cited_by_global AS g, gone FROM described)
SELECT b.key, CASE WHEN a.key IS NULL OR a.title IS NULL OR a.g IS NULL THEN coalesce(nullif(a.title, ''), nullif(b.title, '')) ELSE a.title END AS title,
CASE WHEN a.key IS NULL OR a.title IS NULL OR a.g IS NULL THEN coalesce(a.g, b.g) ELSE a.g END AS cited_by_global,
coalesce(a.gone, false) OR ((a.key IS NULL OR a.title IS NULL OR a.g IS NULL) AND b.gone) AS gone,
CASE WHEN a.key IS NULL THEN 'second' WHEN a.title IS NULL OR a.g IS NULL THEN 'first,second' ELSE 'first' END AS source FROM b LEFT JOIN a USING (key)""")
def _(s, d):
    w = table(s, d, "described")
    first = w.where("key like 'openalex:%'").select("key", F.when(F.col("year") % 2 == 0, F.col("title")).alias("title"), "creators", "year", "venue", F.when(F.col("year") % 3 != 0, F.col("cited_by_global")).alias("cited_by_global"), "gone", F.array(F.lit("first")).alias("source"))
    second = w.select("key", "title", "creators", "year", "venue", "cited_by_global", "gone", F.array(F.lit("second")).alias("source"))
    return X.enrich(w, (first, ("openalex",)), (second, ("openalex", "ref", "doi", "arxiv"))).select("key", "title", "cited_by_global", "gone", joined("source"))


@R.add("jn8_describe", "WITH a AS (SELECT key, title, year FROM described WHERE list_contains(source, 'openalex')), b AS (SELECT key, upper(title) AS title, year + 1 AS year FROM described WHERE list_contains(source, 'ref-strings')) SELECT key, coalesce(a.title, b.title) AS title, coalesce(a.year, b.year) AS year FROM a FULL JOIN b USING (key)")
def _(s, d):
    w = table(s, d, "described").select("key", "title", "creators", "year", "source")
    a, b = w.where(F.array_contains("source", "openalex")), w.where(F.array_contains("source", "ref-strings")).withColumn("title", F.upper("title")).withColumn("year", F.col("year") + 1)
    return X.describe_nodes(a, b).select("key", "title", "year")


@R.add("jn9_rekey_by_doi", f"""WITH {REC}, k AS (SELECT lower(title) AS t, min(norm_doi) AS doi FROM rec WHERE norm_doi IS NOT NULL GROUP BY 1), kn AS (SELECT d.key, k.doi FROM described d JOIN k ON lower(d.title) = k.t WHERE starts_with(d.key, 'openalex:')), hb AS (SELECT norm_doi AS doi, arg_max(key, (seq, key)) AS hk FROM rec WHERE norm_doi IS NOT NULL GROUP BY 1),
mv AS (SELECT kn.key, coalesce(hk, 'doi:' || kn.doi) AS nk FROM kn LEFT JOIN hb USING (doi) WHERE kn.key IN (SELECT to_key FROM edges WHERE from_key <> to_key)), e AS (SELECT coalesce(f.nk, from_key) AS f, coalesce(t.nk, to_key) AS t, confidence, via FROM edges LEFT JOIN mv t ON t.key = to_key LEFT JOIN mv f ON f.key = from_key WHERE from_key <> to_key)
SELECT f AS from_key, t AS to_key, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM e WHERE f <> t GROUP BY 1, 2""")
def _(s, d):
    i = items_of(s, d)
    known = table(s, d, "described").where("key like 'openalex:%'").join(i.select(F.lower("title").alias("_t"), "norm_doi").where("norm_doi is not null").groupBy("_t").agg(F.min("norm_doi").alias("doi")), F.lower("title") == F.col("_t")).select("key", "doi")
    m = stage(merged_of(s, d))
    return E.rekey(m, E.by_known_doi(m.select(F.col("to_key").alias("key")).distinct(), known, i)).select("from_key", "to_key", "confidence", joined("via"))


@R.add("plan_build")
def _(s, d):
    """The whole build over the library's documents and the texts of its citing works, every offline strategy, parsed references too."""
    a = table(s, d, "attachments").select("att_key", "parent_key").distinct()
    uris = S.uris_of(_pdf_bytes(s, d)).join(a, "att_key")
    g = build(Context(items_of(s, d), X.sections(texts_of(s, d).unionByName(written_texts(s, d))), uris), only=["pdf-links", "text-doi", "title-match", "locator-match", "ref-strings"])
    return g.edges.select("from_key", "to_key", "confidence", joined("via"))


# --- streams -----------------------------------------------------------------


@R.add("str1_merged", "SELECT from_key, to_key, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM edges WHERE from_key <> to_key GROUP BY 1, 2")
def _(s, d):
    return T.merged_stream(edges_of(s, d)).select("from_key", "to_key", "confidence", joined("via"))


@R.add("str2_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return T.windowed_counts(table(s, d, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


del NS
