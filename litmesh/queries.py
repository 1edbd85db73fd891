"""Queries of the core operators, over whole tables; `oracle_sql` has the SQL of those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmesh.functions import ids, scores
from litmesh.operators import edges as E
from litmesh.operators import graph as G
from litmesh.operators import items as I
from litmesh.operators import layout as Y
from litmesh.registry import Registry
from litmesh.session import stage, table

R = Registry()

# SQL shared by several queries.
NS = "CASE WHEN contains({0}, ':') THEN split_part({0}, ':', 1) END"
IS_EXT = "coalesce(" + NS.format("{0}") + " IN ('doi', 'arxiv', 'openalex', 'ref'), false)"
ID = "CASE WHEN contains({0}, ':') THEN substr({0}, strpos({0}, ':') + 1) END"
DOI = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(trim({0}), '%2F', '/'), '%2f', '/')), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[.,;:\]]+$', ''), '/(abstract|epdf|full|pdf|meta|html|summary)$', '')"
RANK = "CASE {0} WHEN 'openalex' THEN 0 WHEN 'pdf-links' THEN 1 WHEN 'text-doi' THEN 2 WHEN 'locator-match' THEN 3 WHEN 'ref-strings' THEN 4 WHEN 'title-match' THEN 5 ELSE 6 END"
YEAR = r"try_cast(nullif(regexp_extract({0}, '\b(1[89]\d\d|20\d\d)\b', 1), '') AS INTEGER)"
TITLE = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
SLUG = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def norm_doi_sql(c: str) -> str:
    d = DOI.replace("{0}", c)
    return f"(CASE WHEN regexp_matches({d}, '^10\\.\\d{{4,9}}/') THEN {d} END)"


CURRENT = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY synced_at DESC, seq DESC) AS rn FROM items WHERE key IS NOT NULL) WHERE rn = 1)"
REC = CURRENT + f", rec AS (SELECT *, {norm_doi_sql('doi')} AS norm_doi, {YEAR.format('date')} AS year FROM cur WHERE title IS NOT NULL AND trim(title) <> '')"
MERGED = "merged AS (SELECT from_key, to_key, max(confidence) AS confidence, list_sort(list(DISTINCT via)) AS vias, count(DISTINCT CASE WHEN evidence IS NOT NULL THEN via || ' ' || CAST(evidence AS VARCHAR) END) AS n_evidence FROM edges WHERE from_key <> to_key GROUP BY 1, 2)"
EXT = MERGED + f", ext AS (SELECT to_key AS key, {NS.format('to_key')} AS ns, {ID.format('to_key')} AS id, count(*) AS cited_by, max(confidence) AS confidence FROM merged WHERE {IS_EXT.format('to_key')} GROUP BY to_key)"


def edges_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges")


def merged_of(s: SparkSession, d: str) -> DataFrame:
    return E.merge(edges_of(s, d))


def items_of(s: SparkSession, d: str) -> DataFrame:
    return I.records(table(s, d, "items"))


def joined(c: str):
    """An array as one string, so that its order does not matter to a comparison."""
    return F.array_join(F.array_sort(c), ",").alias(c)


# --- functions ---------------------------------------------------------------


@R.add("fn1_norm_doi", f"SELECT item_id, seq, doi, {norm_doi_sql('doi')} AS norm_doi FROM items WHERE doi IS NOT NULL")
def _(s, d):
    return table(s, d, "items").where("doi is not null").select("item_id", "seq", "doi", ids.norm_doi(F.col("doi")).alias("norm_doi"))


@R.add("fn3_decode_percent", "SELECT item_id, seq, replace(replace(doi, '%2F', '/'), '%2f', '/') AS decoded FROM items WHERE doi IS NOT NULL")
def _(s, d):
    return table(s, d, "items").where("doi is not null").select("item_id", "seq", ids.decode_percent(F.col("doi")).alias("decoded"))


@R.add("fn7_find_dois", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(replace(replace(text, '%2F', '/'), '%2f', '/'), '10\.\d{4,9}/[-._;()/:<>a-zA-Z0-9]+'), lambda x: lower(regexp_replace(regexp_replace(x, '[.,;:\]]+$', ''), '/(abstract|epdf|full|pdf|meta|html|summary)$', ''))), lambda x: regexp_matches(regexp_replace(x, '^[^/]*/', ''), '\d')))), ',') AS dois FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(ids.find_dois(F.col("text"))), ",").alias("dois"))


@R.add("fn8_find_arxiv", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)arxiv[:\s]*(\d{4}\.\d{4,5})(?:v\d+)?', 1))), ',') AS arxiv FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(ids.find_arxiv(F.col("text"))), ",").alias("arxiv"))


@R.add("fn10_flatten_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '-\r?\n\s*', '', 'g'), '\r?\n', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(ids.flatten_text(F.col("text"))).alias("flat"))


@R.add("fn11_first_year", f"SELECT item_id, seq, {YEAR.format('date')} AS year FROM items")
def _(s, d):
    return table(s, d, "items").select("item_id", "seq", ids.first_year(F.col("date")).alias("year"))


@R.add("fn12_external_keys", f"SELECT DISTINCT to_key, {NS.format('to_key')} AS ns, {ID.format('to_key')} AS id, {IS_EXT.format('to_key')} AS external FROM edges")
def _(s, d):
    k = F.col("to_key")
    return edges_of(s, d).select("to_key", ids.namespace(k).alias("ns"), ids.local_id(k).alias("id"), ids.is_external(k).alias("external")).distinct()


@R.add("fn14_ref_signature", f"WITH t AS (SELECT key, {TITLE.format('title')} AS t FROM described), j AS (SELECT key, t, array_to_string(list_slice(string_split(t, ' '), 1, 8), '-') AS j FROM t) SELECT key, CASE WHEN length(t) >= 20 THEN CASE WHEN length(j) > 60 THEN regexp_replace(substr(j, 1, 60), '-[^-]*$', '') ELSE j END END AS signature FROM j")
def _(s, d):
    return table(s, d, "described").select("key", ids.ref_signature(ids.ascii_title(F.col("title"))).alias("signature"))


@R.add("fn15_first_page", r"WITH h AS (SELECT item_id, seq, lower(trim(regexp_extract(pages, '^[^-–—,]*'))) AS h FROM items) SELECT item_id, seq, CASE WHEN regexp_matches(h, '^[a-z]?\d{1,6}$') THEN h END AS page FROM h")
def _(s, d):
    return table(s, d, "items").select("item_id", "seq", ids.first_page(F.col("pages")).alias("page"))


_STOP = ", ".join(f"'{w}'" for w in ids.JOURNAL_STOP)


@R.add("fn16_journal_tokens", f"SELECT journal_id, array_to_string(list_filter(string_split({TITLE.format('name')}, ' '), lambda x: x <> '' AND x NOT IN ({_STOP})), ' ') AS tokens FROM journals")
def _(s, d):
    return table(s, d, "journals").select("journal_id", F.array_join(ids.journal_tokens(ids.ascii_title(F.col("name"))), " ").alias("tokens"))


@R.add("fn17_agreement", f"""WITH t AS (SELECT journal_id, {TITLE.format('name')} AS n, {TITLE.format('abbreviation')} AS a FROM journals),
p AS (SELECT journal_id, unnest(list_zip(list_filter(string_split(a, ' '), lambda x: x NOT IN ({_STOP})), list_filter(string_split(n, ' '), lambda x: x NOT IN ({_STOP})))) AS p FROM t),
q AS (SELECT journal_id, p[1] AS w, p[2] AS t FROM p)
SELECT journal_id, w AS word, t AS token, CASE WHEN least(length(w), length(t)) < 3 THEN CASE WHEN w = t THEN 'EXACT' WHEN length(t) >= 4 AND length(w) > 0 AND starts_with(t, w) THEN 'INITIAL' END WHEN starts_with(w, t) OR starts_with(t, w) THEN 'WORD' END AS agreement FROM q""")
def _(s, d):
    j = table(s, d, "journals")
    words = lambda c: ids.journal_tokens(ids.ascii_title(F.col(c)))
    p = j.select("journal_id", F.explode(F.arrays_zip(words("abbreviation").alias("w"), words("name").alias("t"))).alias("p")).select("journal_id", F.col("p.w").alias("word"), F.col("p.t").alias("token"))
    return p.select("journal_id", "word", "token", ids.agreement(F.col("word"), F.col("token")).alias("agreement"))


@R.add("fn19_surname", r"SELECT DISTINCT c AS name, list_last(string_split_regex(trim(c), '\s+')) AS surname FROM (SELECT unnest(creators) AS c FROM items) WHERE c IS NOT NULL")
def _(s, d):
    return table(s, d, "items").select(F.explode("creators").alias("name")).where("name is not null").distinct().select("name", ids.surname(F.col("name")).alias("surname"))


@R.add("fn20_openalex_id", "SELECT key, list_last(string_split(url, '/')) AS short FROM described WHERE url IS NOT NULL")
def _(s, d):
    return table(s, d, "described").where("url is not null").select("key", ids.short_openalex(F.col("url")).alias("short"))


@R.add("fn22_surname_agrees", "SELECT e.from_key, e.to_key, list_bool_or(list_transform(i.creators, lambda x: lower(x) = lower(d.creators[1]) OR ends_with(lower(x), ' ' || lower(d.creators[1])))) AS agrees FROM (SELECT DISTINCT from_key, to_key FROM edges) e JOIN (SELECT key, any_value(creators) AS creators FROM items GROUP BY key) i ON i.key = e.from_key JOIN described d ON d.key = e.to_key WHERE len(d.creators) > 0 AND len(i.creators) > 0")
def _(s, d):
    i = table(s, d, "items").groupBy("key").agg(F.any_value("creators").alias("c")).where(F.size("c") > 0)
    k = table(s, d, "described").where(F.size("creators") > 0).select(F.col("key").alias("to_key"), F.get("creators", 0).alias("w"))
    return edges_of(s, d).select("from_key", "to_key").distinct().join(i, F.col("from_key") == F.col("key")).join(k, "to_key").select("from_key", "to_key", ids.surname_agrees(F.col("w"), F.col("c")).alias("agrees"))


@R.add("fn23_impossible_year", f"WITH y AS (SELECT key, {YEAR.format('any_value(date)')} AS y FROM items GROUP BY key) SELECT e.from_key, e.to_key, coalesce(d.year > y.y + 1, false) AS impossible FROM (SELECT DISTINCT from_key, to_key FROM edges) e JOIN y ON y.key = e.from_key JOIN described d ON d.key = e.to_key")
def _(s, d):
    y = table(s, d, "items").groupBy("key").agg(ids.first_year(F.any_value("date")).alias("y"))
    k = table(s, d, "described").select(F.col("key").alias("to_key"), "year")
    return edges_of(s, d).select("from_key", "to_key").distinct().join(y, F.col("from_key") == F.col("key")).join(k, "to_key").select("from_key", "to_key", ids.impossible_year(F.col("y"), F.col("year")).alias("impossible"))


@R.add("fn24_round3", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice * l_discount AS DECIMAL(18, 6)), 3) AS DOUBLE) AS rounded FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scores.round3((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,6)")).cast("double").alias("rounded"))


@R.add("fn25_gap_score", "SELECT key, round(CASE WHEN cited_by_global IS NULL THEN len(source)::DOUBLE ELSE len(source) / log10(10 + greatest(0, cited_by_global)) END, 6) AS score FROM described")
def _(s, d):
    return table(s, d, "described").select("key", F.round(scores.gap_score(F.size("source"), F.col("cited_by_global")), 6).alias("score"))


@R.add("fn26_reference_count", "WITH c AS (SELECT l_suppkey AS g, l_partkey % 50 AS c FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_linenumber = 1), o AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM c) SELECT g, greatest(1, max(c) FILTER (WHERE i = CASE WHEN n >= 20 THEN floor(0.95::DOUBLE * (n - 1)) ELSE n - 1 END)) AS reference FROM o GROUP BY g")
def _(s, d):
    c = table(s, d, "lineitem").where("l_suppkey % 3 <> 0 OR l_linenumber = 1").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 50).alias("c"))
    return c.groupBy("g").agg(scores.reference_count(F.col("c")).alias("reference"))


@R.add("fn26_reference_count_whole")
def _(s, d):
    """Over all rows; the SQL of fn26 leaves some out."""
    c = table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 50).alias("c"))
    return c.groupBy("g").agg(scores.reference_count(F.col("c")).alias("reference"))


@R.add("fn27_global_radius", "WITH f AS (SELECT key, cited_by_global AS c, sqrt(greatest(cited_by_global, 0) / 400.0::DOUBLE) AS f FROM described), r AS (SELECT key, CASE WHEN c IS NULL THEN 2.0::DOUBLE ELSE least(28.0, 3 + 17 * CASE WHEN f > 1 THEN 1 + log10(f) ELSE f END) END AS r FROM f) SELECT key, round(r, 6) AS radius, round(power(r / 4, 2), 6) AS area FROM r")
def _(s, d):
    r = table(s, d, "described").select("key", scores.global_radius(F.col("cited_by_global"), F.lit(400.0)).alias("r"))
    return r.select("key", F.round("r", 6).alias("radius"), F.round(scores.area(F.col("r")), 6).alias("area"))


@R.add("fn28_local_size", "SELECT to_key AS key, 1 + 2 * count(*) AS val, round(4 * sqrt(1 + 2 * count(*)), 6) AS radius FROM (SELECT DISTINCT from_key, to_key FROM edges WHERE from_key <> to_key) GROUP BY to_key")
def _(s, d):
    n = edges_of(s, d).select("from_key", "to_key").where("from_key <> to_key").distinct().groupBy(F.col("to_key").alias("key")).agg(F.count("*").alias("n"))
    return n.select("key", scores.local_value(F.col("n")).alias("val"), F.round(scores.local_radius(F.col("n")), 6).alias("radius"))


@R.add("fn29_urls", f"SELECT DISTINCT to_key AS key, CASE {NS.format('to_key')} WHEN 'doi' THEN 'https://doi.org/' || replace(replace(replace(replace(replace({ID.format('to_key')}, '%', '%25'), '<', '%3C'), '>', '%3E'), '#', '%23'), '?', '%3F') WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || {ID.format('to_key')} WHEN 'openalex' THEN 'https://openalex.org/' || {ID.format('to_key')} END AS url FROM edges")
def _(s, d):
    return edges_of(s, d).select(F.col("to_key").alias("key")).distinct().select("key", ids.external_url(F.col("key")).alias("url"))


_LABEL = r"CASE WHEN coalesce(nullif(regexp_replace({c}[1], '\s+', '', 'g'), ''), list_filter(regexp_extract_all(coalesce({t}, ''), '[A-Za-z]+'), lambda x: length(x) > 3)[1]) IS NULL THEN '?' ELSE coalesce(nullif(regexp_replace({c}[1], '\s+', '', 'g'), ''), list_filter(regexp_extract_all(coalesce({t}, ''), '[A-Za-z]+'), lambda x: length(x) > 3)[1]) || coalesce(CAST({y} AS VARCHAR), '') END"


@R.add("fn30_short_label", "WITH " + REC + " SELECT key, " + _LABEL.format(c="creators", t="title", y="year") + " AS label FROM rec")
def _(s, d):
    return items_of(s, d).select("key", ids.short_label(F.col("creators"), F.col("title"), F.col("year")).alias("label"))


@R.add("fn31_ghost_label", f"WITH t AS (SELECT *, CASE WHEN contains({ID.format('key')}, '/') THEN substr({ID.format('key')}, strpos({ID.format('key')}, '/') + 1) ELSE {ID.format('key')} END AS tail FROM described) SELECT key, CASE WHEN title IS NOT NULL THEN " + _LABEL.format(c="creators", t="title", y="year") + " WHEN length(tail) > 20 THEN substr(tail, 1, 19) || '…' ELSE tail END AS label FROM t")
def _(s, d):
    return table(s, d, "described").select("key", ids.ghost_label(F.col("key"), F.col("creators"), F.col("title"), F.col("year")).alias("label"))


@R.add("fn32_suffix_letters", "SELECT p_partkey % 702 AS n, any_value(CASE WHEN p_partkey % 702 < 26 THEN chr(CAST(97 + p_partkey % 702 AS INTEGER)) ELSE chr(CAST(96 + (p_partkey % 702) // 26 AS INTEGER)) || chr(CAST(97 + (p_partkey % 702) % 26 AS INTEGER)) END) AS letters FROM part GROUP BY 1")
def _(s, d):
    n = table(s, d, "part").select((F.col("p_partkey") % 702).alias("n")).distinct()
    return n.select("n", ids.suffix_letters(F.col("n")).alias("letters"))


@R.add("fn34_year_colour", "WITH y AS (SELECT DISTINCT year FROM described WHERE year IS NOT NULL), r AS (SELECT min(year) AS a, max(year) AS b FROM y), t AS (SELECT year, CASE WHEN b > a THEN (year - a)::DOUBLE / (b - a) ELSE 0.5::DOUBLE END AS t FROM y, r) SELECT year, CAST((16 + CAST(round((239 - 16) * t) AS INTEGER)) * 65536 + (32 + CAST(round((96 - 32) * t) AS INTEGER)) * 256 + 64 AS INTEGER) AS colour FROM t")
def _(s, d):
    y = table(s, d, "described").where("year is not null").select("year").distinct()
    a, b = y.agg(F.min("year"), F.max("year")).first()
    t = y.select("year", scores.year_position(F.col("year"), F.lit(a), F.lit(b)).alias("t"))
    return t.select("year", scores.mix(F.lit(0x102040), F.lit(0xEF6040), F.col("t")).alias("colour"))


@R.add("fn36_slug", f"SELECT key, {SLUG.format('title')} AS slug FROM described")
def _(s, d):
    return table(s, d, "described").select("key", ids.slug(F.col("title")).alias("slug"))


@R.add("fn37_stats", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = least(n - 1, floor(0.5::DOUBLE * n))) AS p50, max(value) FILTER (WHERE i = least(n - 1, floor(0.95::DOUBLE * n))) AS p95, max(value) FILTER (WHERE i = least(n - 1, floor(0.99::DOUBLE * n))) AS p99, max(value) AS max FROM o GROUP BY event_type")
def _(s, d):
    v = table(s, d, "events").where("value is not null")
    rank = lambda p, n: scores.nearest_rank(F.col("value"), p).alias(n)
    return v.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), rank(0.5, "p50"), rank(0.95, "p95"), rank(0.99, "p99"), F.max("value").alias("max"))


_TSTOP = ", ".join(f"'{w}'" for w in G.TITLE_STOP)
TERMS = rf"""tok AS (SELECT key, list_transform(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) >= 3 AND x NOT IN ({_TSTOP}) AND NOT regexp_matches(x, '^\d+$') THEN x END) AS ws FROM doc),
term AS (SELECT DISTINCT key, term FROM (SELECT key, unnest(ws) AS term FROM tok UNION ALL SELECT key, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM tok) WHERE term IS NOT NULL)"""


@R.add("fn38_title_terms", "WITH doc AS (SELECT key, title FROM described WHERE title IS NOT NULL), " + TERMS + " SELECT key, term FROM term")
def _(s, d):
    return table(s, d, "described").where("title is not null").select("key", F.explode(ids.title_terms(F.col("title"), G.TITLE_STOP)).alias("term"))


@R.add("fn40_colour_keys", "WITH " + REC + " SELECT coalesce(CAST(year AS VARCHAR), '(none)') AS year, coalesce(nullif(publication, ''), '(none)') AS publication, count(*) AS items FROM rec GROUP BY 1, 2")
def _(s, d):
    i = items_of(s, d)
    of = lambda mode: Y.category(i, mode).withColumnRenamed("category", mode)
    return of("year").join(of("publication"), "key").groupBy("year", "publication").agg(F.count("*").alias("items"))


# --- merging and roll-ups ----------------------------------------------------


@R.add("agg1_merge", "WITH " + MERGED + " SELECT from_key, to_key, confidence, array_to_string(vias, ',') AS via, n_evidence FROM merged")
def _(s, d):
    return merged_of(s, d).select("from_key", "to_key", "confidence", joined("via"), "n_evidence")


@R.add("agg2_external_nodes", "WITH " + EXT + ", v AS (SELECT to_key, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM edges WHERE from_key <> to_key GROUP BY to_key) SELECT key, ns, id, cited_by, confidence, via FROM ext JOIN v ON key = to_key")
def _(s, d):
    return E.external_nodes(merged_of(s, d)).select("key", "ns", "id", "cited_by", "confidence", joined("via"))


@R.add("agg3_provider_stats", f"WITH e AS (SELECT * FROM edges WHERE from_key <> to_key), f AS (SELECT from_key, to_key, arg_min(via, {RANK.format('via')}) AS via FROM e GROUP BY 1, 2) SELECT e.via, count(*) AS produced, (SELECT count(*) FROM f WHERE f.via = e.via) AS new_edges FROM e GROUP BY e.via")
def _(s, d):
    return E.provider_stats(edges_of(s, d))


@R.add("agg4_histogram", "WITH " + EXT + " SELECT CASE WHEN cited_by >= 5 THEN '5+' ELSE CAST(cited_by AS VARCHAR) END AS cited_by, count(*) AS works FROM ext GROUP BY 1")
def _(s, d):
    return E.cited_by_histogram(E.external_nodes(merged_of(s, d)))


@R.add("agg5_corroboration", "WITH " + MERGED + " SELECT len(vias) AS strategies, count(*) AS edges FROM merged GROUP BY 1")
def _(s, d):
    return E.by_corroboration(merged_of(s, d))


@R.add("agg6_degrees", "WITH " + MERGED + ", x AS (SELECT from_key AS key, 1 AS o, 0 AS i FROM merged UNION ALL SELECT to_key, 0, 1 FROM merged) SELECT key, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM x GROUP BY key")
def _(s, d):
    return E.degrees(merged_of(s, d))


@R.add("agg7_ghost_threshold", "WITH " + EXT + " SELECT key, cited_by FROM ext WHERE cited_by >= 3")
def _(s, d):
    return E.external_nodes(merged_of(s, d)).where("cited_by >= 3").select("key", "cited_by")


@R.add("agg8_year_range", "WITH " + REC + " SELECT min(year) AS first_year, max(year) AS last_year FROM rec")
def _(s, d):
    return items_of(s, d).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@R.add("agg9_per_strategy", "SELECT via, count(*) AS edges FROM (SELECT DISTINCT from_key, to_key, via FROM edges WHERE from_key <> to_key) GROUP BY via")
def _(s, d):
    return E.per_strategy(merged_of(s, d))


@R.add("agg10_legend", "WITH " + REC + ", c AS (SELECT unnest(list_distinct(collections)) AS category FROM rec), n AS (SELECT category, count(*) AS items FROM c WHERE category IS NOT NULL AND category <> '' GROUP BY category), t AS (SELECT *, row_number() OVER (ORDER BY items DESC, category) AS r FROM n) SELECT CASE WHEN r <= 12 THEN category ELSE 'more' END AS category, CAST(sum(items) AS BIGINT) AS items, count(*) AS categories FROM t GROUP BY 1")
def _(s, d):
    counts = I.facet_counts(I.facets(items_of(s, d)), ("collection",)).select(F.col("value").alias("category"), "items")
    return Y.legend(counts)


_FACETS = "f AS (SELECT key, 'author' AS field, unnest(list_distinct(creators)) AS value FROM rec UNION ALL SELECT key, 'tag', unnest(list_distinct(tags)) FROM rec UNION ALL SELECT key, 'collection', unnest(list_distinct(collections)) FROM rec UNION ALL SELECT key, 'publication', publication FROM rec UNION ALL SELECT key, 'type', item_type FROM rec UNION ALL SELECT key, 'year', CAST(year AS VARCHAR) FROM rec)"


@R.add("agg11_facet_counts", "WITH " + REC + ", " + _FACETS + " SELECT field, value, count(*) AS items FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2")
def _(s, d):
    return I.facet_counts(I.facets(items_of(s, d)))


@R.add("agg15_group_pull", "SELECT l_suppkey AS g, round(sum(l_quantity * l_discount) / nullif(sum(l_discount), 0), 6) AS centre, round(least(sum(l_discount), 1), 6) AS pull FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    return Y.group_pull(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_discount").select("g", F.round("centre", 6).alias("centre"), F.round("pull", 6).alias("pull"))


@R.add("agg22_index_stats", f"WITH {REC}, t AS (SELECT *, {TITLE.format('title')} AS nt FROM rec) SELECT count(*) AS items, count(norm_doi) AS with_doi, count(DISTINCT norm_doi) AS dois, count(DISTINCT nt) AS titles, count(*) FILTER (WHERE length(nt) >= 30) AS title_targets FROM t")
def _(s, d):
    return I.index_stats(items_of(s, d))


WORK = f"w AS (SELECT coalesce(norm_doi, CASE WHEN length({SLUG.format('title')}) >= 20 THEN 'title:' || {SLUG.format('title')} END) AS work, key, year FROM rec)"


@R.add("agg23_works", f"WITH {REC}, {WORK} SELECT work, count(*) AS items, min(key) AS first_key, min(year) AS year FROM w WHERE work IS NOT NULL GROUP BY work")
def _(s, d):
    return I.works(items_of(s, d))


@R.add("agg26_thresholds", "WITH " + MERGED + " SELECT count(*) FILTER (WHERE confidence >= 0.9) AS at_90, count(*) FILTER (WHERE confidence >= 0.7) AS at_70, count(*) FILTER (WHERE confidence >= 0.5) AS at_50 FROM merged")
def _(s, d):
    return E.at_thresholds(merged_of(s, d))


@R.add("agg27_strategies_present", f"SELECT DISTINCT {RANK.format('via')} AS rank, via FROM edges WHERE from_key <> to_key")
def _(s, d):
    return E.strategies_present(merged_of(s, d))


# --- filters -----------------------------------------------------------------


@R.add("flt1_filter_edges", "WITH " + MERGED + " SELECT from_key, to_key, confidence FROM merged WHERE confidence >= 0.6 AND list_has_any(vias, ['pdf-links', 'text-doi', 'ref-strings']) AND len(list_filter(vias, lambda x: x <> 'title-match')) > 0")
def _(s, d):
    return E.filter_edges(merged_of(s, d), min_confidence=0.6, via=("pdf-links", "text-doi", "ref-strings"), exclude=("title-match",)).select("from_key", "to_key", "confidence")


@R.add("flt2_believed", "WITH " + MERGED + " SELECT from_key, to_key FROM merged WHERE confidence >= 0.7 AND list_has_any(vias, ['pdf-links', 'text-doi', 'title-match', 'locator-match'])")
def _(s, d):
    return E.filter_edges(merged_of(s, d), min_confidence=0.7, via=("pdf-links", "text-doi", "title-match", "locator-match")).select("from_key", "to_key")


@R.add("flt13_asserted", "WITH " + MERGED + " SELECT confidence >= 0.9 AS asserted, count(*) AS edges FROM merged GROUP BY 1")
def _(s, d):
    return E.asserted(merged_of(s, d))


@R.add("flt14_visible", "WITH " + MERGED + ", v AS (SELECT from_key, to_key, list_filter(vias, lambda x: x IN ('openalex', 'title-match')) AS shown, vias FROM merged) SELECT from_key, to_key, array_to_string(shown, ',') AS via, array_to_string(vias, ',') AS found FROM v WHERE len(shown) > 0")
def _(s, d):
    return E.visible(merged_of(s, d), ("openalex", "title-match")).select("from_key", "to_key", joined("via"), joined("found"))


# --- keys, joins and sets ----------------------------------------------------


@R.add("jn13_validate", f"SELECT e.from_key, e.to_key, e.via, count(*) AS n FROM edges e WHERE from_key <> to_key AND from_key IN (SELECT key FROM items) AND (to_key IN (SELECT key FROM items) OR {NS.format('to_key')} IN ('doi', 'openalex')) GROUP BY 1, 2, 3")
def _(s, d):
    return E.validate(edges_of(s, d), table(s, d, "items"), namespaces=("doi", "openalex")).groupBy("from_key", "to_key", "via").agg(F.count("*").alias("n"))


NODES = f"nodes AS (SELECT key, title, CAST(seq AS BIGINT) AS seq FROM rec UNION ALL SELECT key, title, 1000000000000 FROM described), sig AS (SELECT key, seq, {TITLE.format('title')} AS t FROM nodes), j AS (SELECT *, array_to_string(list_slice(string_split(t, ' '), 1, 8), '-') AS j FROM sig WHERE length(t) >= 20), g AS (SELECT key, seq, CASE WHEN length(j) > 60 THEN regexp_replace(substr(j, 1, 60), '-[^-]*$', '') ELSE j END AS sig, CASE {NS.format('key')} WHEN 'doi' THEN 1 WHEN 'arxiv' THEN 2 WHEN 'openalex' THEN 3 WHEN 'ref' THEN 4 ELSE 0 END AS r FROM j), o AS (SELECT *, first_value(key) OVER (PARTITION BY sig ORDER BY r, seq, key) AS new_key FROM g), moved AS (SELECT DISTINCT key, new_key FROM o WHERE r > 0 AND key <> new_key)"


def _nodes(s, d):
    held = items_of(s, d).select("key", "title", F.col("seq").cast("long").alias("seq"))
    return held.unionByName(table(s, d, "described").select("key", "title", F.lit(10**12).alias("seq")))


@R.add("jn10_same_title", f"WITH {REC}, {NODES} SELECT key, new_key FROM moved")
def _(s, d):
    return E.same_title(_nodes(s, d)).distinct()


@R.add("jn10_consolidated", f"WITH {REC}, {NODES}, {MERGED}, k AS (SELECT coalesce(a.new_key, from_key) AS f, coalesce(b.new_key, to_key) AS t, confidence, vias FROM merged LEFT JOIN moved a ON a.key = from_key LEFT JOIN moved b ON b.key = to_key), u AS (SELECT f, t, confidence, unnest(vias) AS v FROM k WHERE f <> t) SELECT f AS from_key, t AS to_key, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT v)), ',') AS via FROM u GROUP BY 1, 2")
def _(s, d):
    return E.rekey(merged_of(s, d), E.same_title(_nodes(s, d)).distinct()).select("from_key", "to_key", "confidence", joined("via"))


@R.add("jn11_held_by_doi", f"WITH {REC} SELECT norm_doi AS doi, arg_min(key, (item_id, key)) AS key, count(*) AS items FROM rec WHERE norm_doi IS NOT NULL GROUP BY norm_doi")
def _(s, d):
    return I.oldest_by_doi(items_of(s, d))


@R.add("jn12_adopt", "WITH k AS (SELECT CASE WHEN to_key = 'doi:10.99777/universal.1' THEN 'NEWITEM1' ELSE to_key END AS t, CASE WHEN from_key = 'doi:10.99777/universal.1' THEN 'NEWITEM1' ELSE from_key END AS f, confidence FROM edges WHERE from_key <> to_key) SELECT t AS to_key, count(DISTINCT f) AS citers, max(confidence) AS confidence FROM k WHERE f <> t GROUP BY t")
def _(s, d):
    e = E.adopt(merged_of(s, d), "doi:10.99777/universal.1", "NEWITEM1")
    return e.groupBy("to_key").agg(F.count("*").alias("citers"), F.max("confidence").alias("confidence"))


@R.add("jn15_global_counts", f"WITH {REC}, m AS (SELECT norm_doi AS doi, max(d.cited_by_global) AS g FROM rec JOIN described d ON {SLUG.format('d.title')} = {SLUG.format('rec.title')} WHERE norm_doi IS NOT NULL GROUP BY norm_doi) SELECT key, g AS cited_by_global FROM rec JOIN m ON norm_doi = m.doi")
def _(s, d):
    i = items_of(s, d)
    known = i.where("norm_doi is not null").select("norm_doi", ids.slug(F.col("title")).alias("slug")).join(table(s, d, "described").select(ids.slug(F.col("title")).alias("slug"), "cited_by_global"), "slug")
    return I.global_counts(i, known.select(ids.external_key(F.lit("doi"), F.col("norm_doi")).alias("key"), "cited_by_global"))


@R.add("jn16_parents", "WITH a AS (SELECT att_key AS child, parent_key AS parent, row_number() OVER (ORDER BY att_key, parent_key, hash, path, content_type) AS pos FROM (SELECT DISTINCT * FROM attachments)) SELECT coalesce(parent, child) AS key, count(*) AS n FROM a GROUP BY 1")
def _(s, d):
    a = table(s, d, "attachments").distinct().select(F.col("att_key").alias("child"), F.col("parent_key").alias("parent"), F.monotonically_increasing_id().alias("pos"))
    n = a.groupBy(F.coalesce("parent", "child").alias("key")).agg(F.count("*").alias("n"))
    return I.parents(a).join(n, "key").select("key", "n")


@R.add("set1_union", "SELECT via, count(*) AS n FROM (SELECT DISTINCT from_key, to_key, via FROM edges WHERE via IN ('pdf-links', 'text-doi') UNION SELECT DISTINCT from_key, to_key, via FROM edges WHERE via = 'title-match') GROUP BY via")
def _(s, d):
    e = edges_of(s, d).select("from_key", "to_key", "via")
    return e.where("via IN ('pdf-links', 'text-doi')").unionByName(e.where("via = 'title-match'")).distinct().groupBy("via").agg(F.count("*").alias("n"))


@R.add("set2_compare_strategies", "WITH e AS (SELECT DISTINCT from_key, to_key, via FROM edges WHERE from_key <> to_key), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT from_key, to_key FROM e)), k AS (SELECT from_key, to_key, count(*) AS k FROM e GROUP BY 1, 2) SELECT a.via AS via_a, b.via AS via_b, count(*) AS shared, count(*) FILTER (WHERE k.k = 1) AS only_a, round(count(*) / any_value(n.n), 6) AS share FROM e a JOIN e b ON a.from_key = b.from_key AND a.to_key = b.to_key JOIN k ON k.from_key = a.from_key AND k.to_key = a.to_key, n GROUP BY 1, 2")
def _(s, d):
    return E.compare_strategies(edges_of(s, d))


@R.add("set3_offline", "SELECT (SELECT count(*) FROM (SELECT DISTINCT from_key, to_key FROM edges WHERE from_key <> to_key AND via <> 'openalex')) AS offline, (SELECT count(*) FROM (SELECT DISTINCT from_key, to_key FROM edges WHERE from_key <> to_key)) AS everything")
def _(s, d):
    return merged_of(s, d).agg(F.count_if(F.size(F.array_except("via", F.array(F.lit("openalex")))) > 0).alias("offline"), F.count("*").alias("everything"))


@R.add("set4_confusion", "WITH p AS (SELECT DISTINCT from_key, to_key FROM edges WHERE via = 'title-match'), t AS (SELECT DISTINCT from_key, to_key FROM edges WHERE via = 'openalex') SELECT (SELECT count(*) FROM p JOIN t USING (from_key, to_key)) AS tp, (SELECT count(*) FROM p ANTI JOIN t USING (from_key, to_key)) AS fp, (SELECT count(*) FROM t ANTI JOIN p USING (from_key, to_key)) AS fn")
def _(s, d):
    e = edges_of(s, d).where("via IN ('title-match', 'openalex')").groupBy("from_key", "to_key").agg(F.bool_or(F.col("via") == "title-match").alias("p"), F.bool_or(F.col("via") == "openalex").alias("t"))
    return e.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(~F.col("p") & F.col("t")).alias("fn"))


@R.add("set5_node_keys", "SELECT from_key AS key FROM edges WHERE from_key <> to_key UNION SELECT to_key FROM edges WHERE from_key <> to_key")
def _(s, d):
    return E.node_keys(merged_of(s, d))


@R.add("set6_lookup_keys", f"WITH {REC}, {EXT} SELECT key FROM ext UNION SELECT 'doi:' || norm_doi FROM rec WHERE norm_doi IS NOT NULL")
def _(s, d):
    held = items_of(s, d).where("norm_doi is not null").select(ids.external_key(F.lit("doi"), F.col("norm_doi")).alias("key"))
    return E.external_nodes(merged_of(s, d)).select("key").union(held).distinct()


# --- ranking -----------------------------------------------------------------


@R.add("win4_most_cited", f"WITH {EXT} SELECT key, cited_by FROM ext ORDER BY cited_by DESC, key LIMIT 4000")
def _(s, d):
    return E.most_cited(E.external_nodes(merged_of(s, d))).select("key", "cited_by")


@R.add("win5_lookup", f"WITH {EXT}, r AS (SELECT key, ns, row_number() OVER (PARTITION BY CASE WHEN ns = 'openalex' THEN 1 ELSE 0 END ORDER BY cited_by DESC, key) AS r FROM ext WHERE ns <> 'ref') SELECT key, ns FROM r WHERE r <= CASE WHEN ns = 'openalex' THEN 2500 ELSE 500 END")
def _(s, d):
    return E.lookup_keys(E.external_nodes(merged_of(s, d))).select("key", "ns")


@R.add("win9_best_strategy", f"SELECT from_key, to_key, arg_min(via, {RANK.format('via')}) AS best FROM edges WHERE from_key <> to_key GROUP BY 1, 2")
def _(s, d):
    return E.best_strategy(merged_of(s, d)).select("from_key", "to_key", "best")


@R.add("win13_top_lists", f"WITH {EXT}, a AS (SELECT 'global' AS list, key, cited_by_global AS n FROM described WHERE cited_by_global IS NOT NULL ORDER BY n DESC, key LIMIT 5), b AS (SELECT 'here' AS list, key, cited_by AS n FROM ext ORDER BY n DESC, key LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def _(s, d):
    a = table(s, d, "described").where("cited_by_global is not null").select(F.lit("global").alias("list"), "key", F.col("cited_by_global").alias("n")).orderBy(F.desc("n"), "key").limit(5)
    b = E.external_nodes(merged_of(s, d)).select(F.lit("here").alias("list"), "key", F.col("cited_by").alias("n")).orderBy(F.desc("n"), "key").limit(10)
    return a.unionByName(b)


@R.add("win1_namesakes", f"WITH {REC}, n AS (SELECT key, item_id, " + _LABEL.format(c="creators", t="title", y="year") + " AS label FROM rec), r AS (SELECT key, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY item_id, key) - 1 AS i FROM n) SELECT key, CASE WHEN n > 1 AND label <> '?' THEN label || CASE WHEN regexp_matches(label, '\\d$') THEN '' ELSE '-' END || CASE WHEN i < 26 THEN chr(CAST(97 + i AS INTEGER)) ELSE chr(CAST(96 + i // 26 AS INTEGER)) || chr(CAST(97 + i % 26 AS INTEGER)) END ELSE label END AS label FROM r")
def _(s, d):
    n = items_of(s, d).select("key", "item_id", F.lit(True).alias("held"), ids.short_label(F.col("creators"), F.col("title"), F.col("year")).alias("label"))
    return G.namesakes(n)


# --- graph -------------------------------------------------------------------

COUPLING = """link AS (SELECT DISTINCT from_key AS f, to_key AS t FROM edges WHERE from_key <> to_key AND from_key IN (SELECT key FROM items)),
size AS (SELECT f, count(*) AS n FROM link GROUP BY f), cap AS (SELECT greatest(3, floor({share} * count(*))) AS cap FROM size),
ok AS (SELECT t FROM link, cap GROUP BY t, cap HAVING count(*) >= 2 AND count(*) <= cap),
sh AS (SELECT a.f AS a, b.f AS b, count(*) AS n FROM link a JOIN link b ON a.t = b.t AND a.f < b.f WHERE a.t IN (SELECT t FROM ok) GROUP BY 1, 2),
dir AS (SELECT DISTINCT least(f, t) AS a, greatest(f, t) AS b FROM link WHERE t IN (SELECT key FROM items)),
cp AS (SELECT a, b, sum(w) AS w, bool_or(d) AS direct FROM (SELECT sh.a, sh.b, sh.n / sqrt(x.n * y.n) AS w, false AS d FROM sh JOIN size x ON x.f = sh.a JOIN size y ON y.f = sh.b UNION ALL SELECT a, b, 0.5, true FROM dir) GROUP BY 1, 2)"""


@R.add("gr1_coupling", "WITH " + COUPLING.format(share=0.5) + " SELECT a, b, round(w, 9) AS w, direct FROM cp")
def _(s, d):
    return G.coupling(edges_of(s, d), table(s, d, "items")).select("a", "b", F.round("w", 9).alias("w"), "direct")


@R.add("gr3_modularity", "WITH " + COUPLING.format(share=0.5) + f", {CURRENT}, c AS (SELECT key, item_type AS comm FROM cur), p AS (SELECT x.comm AS ca, y.comm AS cb, w FROM cp JOIN c x ON x.key = a JOIN c y ON y.key = b), e AS (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM p UNION ALL SELECT cb, w, 0 FROM p), t AS (SELECT c, sum(w) AS tot, sum(i) AS i FROM e GROUP BY c), m AS (SELECT sum(tot) AS m FROM t) SELECT round(sum(i / (m / 2) - power(tot / m, 2)), 6) AS modularity, count(*) AS communities FROM t, m")
def _(s, d):
    works = G.coupled(edges_of(s, d), table(s, d, "items"))
    c = I.current(table(s, d, "items")).select("key", F.col("item_type").alias("comm"))
    return G.coupled_modularity(works, c).select(F.round("modularity", 6).alias("modularity"), "communities")


@R.add("gr4_term_scores", f"WITH {REC}, doc AS (SELECT key, title, item_type AS comm FROM rec), {TERMS}, tf AS (SELECT comm, term, count(*) AS n FROM term JOIN doc USING (key) GROUP BY 1, 2), df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1), sz AS (SELECT comm, count(*) AS size FROM doc GROUP BY 1), m AS (SELECT count(*) AS m FROM doc) SELECT comm, term, n, CAST(df AS BIGINT) AS df, size, round(n / size * ln(1 + m / df), 6) AS score FROM tf JOIN df USING (term) JOIN sz USING (comm), m WHERE n >= CASE WHEN size >= 4 THEN 2 ELSE 1 END")
def _(s, d):
    i = items_of(s, d)
    t = G.term_scores(i.select("key", F.col("item_type").alias("comm")), i)
    return t.select("comm", "term", "n", "df", "size", F.round("score", 6).alias("score"))


@R.add("gr2_louvain")
def _(s, d):
    return G.louvain_coupled(G.coupled(edges_of(s, d), table(s, d, "items")))


@R.add("gr5_clusters")
def _(s, d):
    i = items_of(s, d)
    c = stage(G.louvain_coupled(G.coupled(edges_of(s, d), i)))
    return c.join(G.name_communities(c, i).select("comm", "label"), "comm").select("key", "comm", "label")


GAPS = f"g AS (SELECT to_key AS key, count(DISTINCT from_key) AS cited_by FROM edges WHERE from_key <> to_key AND {IS_EXT.format('to_key')} GROUP BY 1 HAVING count(DISTINCT from_key) >= 2), s AS (SELECT g.key, cited_by, cited_by_global, CASE WHEN cited_by_global IS NULL THEN cited_by::DOUBLE ELSE cited_by / log10(10 + greatest(0, cited_by_global)) END AS score FROM g LEFT JOIN described d ON d.key = g.key WHERE NOT coalesce(gone, false))"


@R.add("gr8_gaps", f"WITH {GAPS} SELECT key, cited_by, cited_by_global, round(score, 6) AS score, (SELECT count(*) FROM s) AS total FROM s ORDER BY score DESC, cited_by DESC, key LIMIT 25")
def _(s, d):
    return G.gaps(edges_of(s, d), table(s, d, "described")).select("key", "cited_by", "cited_by_global", F.round("score", 6).alias("score"), "total")


@R.add("agg13_gap_owners", f"WITH {GAPS}, {CURRENT}, c AS (SELECT DISTINCT from_key AS f, to_key AS key FROM edges WHERE from_key <> to_key AND to_key IN (SELECT key FROM s)), p AS (SELECT c.key, cur.item_type AS label, count(*) AS n FROM c LEFT JOIN cur ON cur.key = c.f GROUP BY 1, 2), o AS (SELECT key, sum(n) AS t, count(label) AS spread, min(CASE WHEN label IS NOT NULL THEN (-n, label) END) AS b FROM p GROUP BY key) SELECT key, CAST(t AS BIGINT) AS citers, spread, b[2] AS top, CASE WHEN -b[1] / t > 0.5 THEN b[2] END AS owner FROM o")
def _(s, d):
    keys = G.gaps(edges_of(s, d), table(s, d, "described"), limit=None)
    c = I.current(table(s, d, "items")).select("key", F.col("item_type").alias("label"))
    return G.gap_owners(edges_of(s, d), c, keys)


HOP = "ed AS (SELECT DISTINCT from_key AS a, to_key AS b FROM edges WHERE from_key <> to_key UNION SELECT to_key, from_key FROM edges WHERE from_key <> to_key), h0 AS (SELECT DISTINCT from_key AS k FROM edges WHERE to_key = (SELECT max(to_key) FROM edges WHERE to_key LIKE 'ref:%')), h1 AS (SELECT DISTINCT b AS k FROM ed JOIN h0 ON a = k), h2 AS (SELECT DISTINCT b AS k FROM ed JOIN h1 ON a = k), hop AS (SELECT k AS key, CAST(min(x) AS INTEGER) AS distance FROM (SELECT k, 0 AS x FROM h0 UNION ALL SELECT k, 1 FROM h1 UNION ALL SELECT k, 2 FROM h2) GROUP BY k)"


def _start(s, d):
    e = edges_of(s, d)
    last = e.where("to_key LIKE 'ref:%'").agg(F.max("to_key").alias("t"))
    return e.join(F.broadcast(last), F.col("to_key") == F.col("t"), "left_semi").select(F.col("from_key").alias("key"))  # one row


@R.add("gr6_neighbourhood", f"WITH {HOP} SELECT key, distance FROM hop")
def _(s, d):
    return G.neighbourhood(edges_of(s, d), _start(s, d), 2)


@R.add("gr7_lit_edges", f"WITH {HOP}, {MERGED} SELECT from_key, to_key FROM merged JOIN hop a ON a.key = from_key JOIN hop b ON b.key = to_key WHERE least(a.distance, b.distance) < 2")
def _(s, d):
    return G.lit_edges(merged_of(s, d), stage(G.neighbourhood(edges_of(s, d), _start(s, d), 2)), 2).select("from_key", "to_key")


@R.add("gr9_link_strength", "WITH " + MERGED + ", x AS (SELECT from_key AS k FROM merged UNION ALL SELECT to_key FROM merged), d AS (SELECT k, count(*) AS n FROM x GROUP BY k) SELECT from_key, to_key, round(confidence / greatest(1, least(a.n, b.n)), 6) AS strength FROM merged JOIN d a ON a.k = from_key JOIN d b ON b.k = to_key")
def _(s, d):
    m = stage(merged_of(s, d).select("from_key", "to_key", "confidence"))
    n = E.degrees(m)
    deg = lambda c: n.select(F.col("key").alias(c), F.col("degree").alias(f"d_{c}"))
    return m.join(deg("from_key"), "from_key").join(deg("to_key"), "to_key").select("from_key", "to_key", F.round(scores.link_strength(F.col("confidence"), F.col("d_from_key"), F.col("d_to_key")), 6).alias("strength"))


@R.add("gr11_placement", "WITH p AS (SELECT DISTINCT key, (year % 100)::DOUBLE AS x, length(title)::DOUBLE AS y FROM described WHERE year IS NOT NULL AND title IS NOT NULL) SELECT from_key AS key, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (SELECT DISTINCT from_key, to_key FROM edges) JOIN p ON to_key = key GROUP BY from_key")
def _(s, d):
    p = table(s, d, "described").where("year is not null and title is not null").select("key", (F.col("year") % 100).alias("x"), F.length("title").alias("y"))
    return Y.placement(edges_of(s, d), p).select("key", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: works that the held ones cite most but that are not held, merged, ranked and described."""
    found = G.gaps(edges_of(spark, sf_dir), table(spark, sf_dir, "described"))
    known = table(spark, sf_dir, "described").select("key", "title", "year")
    return found.join(known, "key", "left").select("key", "title", "year", "cited_by", "cited_by_global", "score", "total")


def queries():
    from litmesh import queries_build, queries_more, queries_view  # noqa: F401 - they add to R

    return dict(R.queries)


def oracle_sql():
    queries()
    return dict(R.sql)
