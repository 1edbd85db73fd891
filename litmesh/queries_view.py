"""Queries of filters, views, evaluation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmesh.operators import edges as E
from litmesh.operators import evaluate as V
from litmesh.operators import export as X
from litmesh.operators import filters as L
from litmesh.operators import items as I
from litmesh.plans.view import ViewSpec, view_edges, view_nodes, view_stats
from litmesh.queries import IS_EXT, MERGED, REC, R, edges_of, items_of, joined, merged_of
from litmesh.session import stage, table


def facets_of(s, d):
    return I.facets(items_of(s, d))


# --- filters -----------------------------------------------------------------


@R.add("flt4_year_range", f"WITH {REC} SELECT key FROM rec WHERE year BETWEEN 1990 AND 2005 AND (list_bool_or(list_transform(tags, lambda x: lower(x) = 'review')) OR list_bool_or(list_transform(tags, lambda x: contains(lower(x), 'unread'))))")
def _(s, d):
    return L.matching(facets_of(s, d), [L.parse("year: 1990-2005"), L.parse('tag: "review", ~unread')]).select("key")


@R.add("flt4_any_facet", f"WITH {REC} SELECT key FROM rec WHERE contains(lower(title), 'thermal') OR contains(lower(coalesce(publication, '')), 'thermal') OR contains(lower(coalesce(item_type, '')), 'thermal') OR coalesce(list_bool_or(list_transform(creators, lambda x: contains(lower(x), 'thermal'))), false) OR coalesce(list_bool_or(list_transform(tags, lambda x: contains(lower(x), 'thermal'))), false) OR coalesce(list_bool_or(list_transform(collections, lambda x: contains(lower(x), 'thermal'))), false)")
def _(s, d):
    return L.matching(facets_of(s, d), [L.parse("thermal")]).select("key")


@R.add("flt6_completions", f"WITH {REC}, f AS (SELECT DISTINCT key, unnest(tags) AS value FROM rec) SELECT 'tag' AS field, value, count(*) AS items FROM f WHERE contains(lower(value), 'e') AND value <> '' GROUP BY value ORDER BY items DESC, value LIMIT 11")
def _(s, d):
    return L.completions(I.facet_counts(facets_of(s, d)), "e", field="tag")


@R.add("flt7_all_but_one", f"WITH {REC} SELECT key FROM rec WHERE year >= 2000")
def _(s, d):
    return L.matching(facets_of(s, d), [L.parse("year: >=2000"), L.parse("tag: review")], skip=1).select("key")


@R.add("flt9_search", "SELECT DISTINCT key, title FROM described WHERE contains(lower(concat_ws(' ', key, title)), 'thermal') AND contains(lower(concat_ws(' ', key, title)), 'of') ORDER BY key LIMIT 10")
def _(s, d):
    return L.search(table(s, d, "described").select("key", "title"), "thermal of", ("key", "title"))


@R.add("flt10_everything", f"WITH {REC} SELECT DISTINCT key FROM rec WHERE contains(lower(concat_ws(' ', title, publication, doi)), 'carbon') OR key IN (SELECT parent_key FROM attachments a JOIN documents d ON d.att_key = a.att_key WHERE contains(lower(d.text), 'carbon'))")
def _(s, d):
    i = items_of(s, d)
    own = i.where(F.lower(F.concat_ws(" ", "title", "publication", "doi")).contains("carbon")).select("key")
    texts = table(s, d, "documents").where(F.lower("text").contains("carbon")).select("att_key").distinct()
    below = table(s, d, "attachments").join(texts, "att_key", "left_semi").select(F.col("parent_key").alias("key")).distinct()
    return own.unionByName(i.join(below, "key", "left_semi").select("key")).distinct()


# --- the view ----------------------------------------------------------------

SPEC = ViewSpec(filters=("year: >=1990",), min_confidence=0.5, strategies=("pdf-links", "text-doi", "title-match", "locator-match", "openalex"), min_cites=2)
VIEW = MERGED + f", {REC}, shown AS (SELECT key FROM rec WHERE year >= 1990), ve AS (SELECT from_key, to_key, confidence, list_filter(vias, lambda x: x <> 'ref-strings') AS v FROM merged WHERE confidence >= 0.5 AND from_key IN (SELECT key FROM shown)), vb AS (SELECT * FROM ve WHERE len(v) > 0), gh AS (SELECT to_key FROM vb WHERE {IS_EXT.format('to_key')} GROUP BY to_key HAVING count(*) >= 2), vw AS (SELECT * FROM vb WHERE to_key IN (SELECT key FROM shown) OR to_key IN (SELECT to_key FROM gh))"


@R.add("flt8_view_edges", f"WITH {VIEW} SELECT from_key, to_key, confidence, array_to_string(v, ',') AS via FROM vw")
def _(s, d):
    return view_edges(merged_of(s, d), facets_of(s, d), SPEC).select("from_key", "to_key", "confidence", joined("via"))


@R.add("agg24_view_stats", f"WITH {VIEW} SELECT (SELECT count(*) FROM shown) AS shown, (SELECT count(*) FROM rec) AS total, (SELECT count(DISTINCT to_key) FROM vw WHERE {IS_EXT.format('to_key')}) AS ghosts, (SELECT count(DISTINCT to_key) FROM vw JOIN described d ON d.key = to_key WHERE d.year IS NOT NULL AND {IS_EXT.format('to_key')}) AS named_ghosts, (SELECT count(*) FROM vw) AS edges")
def _(s, d):
    i, f = items_of(s, d), facets_of(s, d)
    e = stage(view_edges(merged_of(s, d), f, SPEC).select("from_key", "to_key"))
    return view_stats(view_nodes(e, i, f, table(s, d, "described"), SPEC), e, i)


@R.add("agg25_empty_scope", f"WITH {REC} SELECT len(collections) = 0 AS outside, count(*) AS items FROM rec GROUP BY 1")
def _(s, d):
    return items_of(s, d).groupBy((F.size("collections") == 0).alias("outside")).agg(F.count("*").alias("items"))


# --- evaluation --------------------------------------------------------------

GRADED = "p AS (SELECT DISTINCT via AS strategy, from_key, to_key FROM edges WHERE from_key <> to_key AND via <> 'openalex'), t AS (SELECT DISTINCT from_key, to_key FROM edges WHERE from_key <> to_key AND via = 'openalex')"


def graded(s, d):
    e = edges_of(s, d).where("from_key <> to_key")
    return e.where("via <> 'openalex'").select(F.col("via").alias("strategy"), "from_key", "to_key"), e.where("via = 'openalex'").select("from_key", "to_key")


@R.add("agg16_accuracy", f"WITH {GRADED}, c AS (SELECT strategy, count(*) AS predicted, count(t.from_key) AS tp, count(*) FILTER (WHERE p.to_key = 'doi:10.99777/universal.1') AS traps FROM p LEFT JOIN t USING (from_key, to_key) GROUP BY strategy), n AS (SELECT count(*) AS n FROM t) SELECT strategy, predicted, tp, predicted - tp AS fp, n - tp AS fn, round(tp / predicted, 6) AS precision, round(tp / n, 6) AS recall, round(2 * tp / (predicted + n), 6) AS f1, traps FROM c, n")
def _(s, d):
    p, t = graded(s, d)
    traps = p.where("to_key = 'doi:10.99777/universal.1'").select("from_key", "to_key")
    a = V.accuracy(p, t, traps)
    return a.select("strategy", "predicted", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "traps")


@R.add("agg17_unique_hits", f"WITH {GRADED}, h AS (SELECT * FROM p SEMI JOIN t USING (from_key, to_key)), u AS (SELECT from_key, to_key FROM h GROUP BY 1, 2 HAVING count(*) = 1) SELECT strategy, count(*) AS unique_tp FROM h JOIN u USING (from_key, to_key) GROUP BY strategy")
def _(s, d):
    return V.unique_hits(*graded(s, d))


@R.add("agg18_external_grades", "WITH t AS (SELECT DISTINCT from_key, substr(to_key, 5) AS id FROM edges WHERE to_key LIKE 'doi:%' AND via = 'openalex'), p AS (SELECT DISTINCT from_key, CASE length(to_key) % 3 WHEN 0 THEN substr(to_key, 5) WHEN 1 THEN substr(to_key, 5) || '/pdf' ELSE substr(to_key, 5, length(to_key) - 6) END AS id FROM edges WHERE to_key LIKE 'doi:%' AND via <> 'openalex'), g AS (SELECT p.from_key, p.id, max(CASE WHEN p.id = t.id THEN 3 WHEN regexp_replace(p.id, '/(abstract|epdf|full|pdf|meta|html|summary)$', '') = t.id THEN 2 WHEN starts_with(t.id, p.id) THEN 1 ELSE 0 END) AS g FROM p LEFT JOIN t USING (from_key) GROUP BY 1, 2) SELECT from_key, id, ['unconfirmed', 'truncated', 'suffix', 'tp'][g + 1] AS grade FROM g")
def _(s, d):
    e = edges_of(s, d).where("to_key like 'doi:%'").select("from_key", "via", F.substring("to_key", 5, 1000).alias("id"), F.length("to_key").alias("n"))
    made = F.when(F.col("n") % 3 == 0, F.col("id")).when(F.col("n") % 3 == 1, F.concat("id", F.lit("/pdf"))).otherwise(F.substring("id", F.lit(1), F.length("id") - 2))
    return V.external_grades(e.where("via <> 'openalex'").select("from_key", made.alias("id")), e.where("via = 'openalex'").select("from_key", "id"))


@R.add("agg19_covered", "SELECT via AS strategy, count(*) AS n FROM (SELECT DISTINCT via, from_key, to_key FROM edges WHERE from_key <> to_key AND via <> 'openalex' AND from_key IN (SELECT unnest(item_keys) FROM works WHERE ref_count > 0)) GROUP BY via")
def _(s, d):
    covered = table(s, d, "works").where("ref_count > 0").select(F.explode("item_keys").alias("from_key"))
    return V.covered_only(graded(s, d)[0].distinct(), covered).groupBy("strategy").agg(F.count("*").alias("n"))


@R.add("agg21_miss_causes", f"WITH {GRADED}, m AS (SELECT t.* FROM t ANTI JOIN p USING (from_key, to_key)), f AS (SELECT from_key, to_key, to_key LIKE 'doi:%' AS a, from_key IN (SELECT parent_key FROM attachments) AS b FROM m) SELECT CASE WHEN a THEN 'doi_in_links' WHEN b THEN 'document_found' ELSE 'nothing' END AS cause, count(*) AS misses FROM f GROUP BY 1")
def _(s, d):
    m = V.missed(*graded(s, d))
    docs = table(s, d, "attachments").select(F.col("parent_key").alias("from_key"), F.lit(True).alias("document_found")).distinct()
    m = m.join(docs, "from_key", "left").withColumn("doi_in_links", F.col("to_key").startswith("doi:"))
    for c in ("doi_in_section", "doi_in_text", "title_in_section", "title_in_text", "locator_in_section", "locator_in_text", "author_and_year_in_section", "author_in_text", "section_found", "text_found"):
        m = m.withColumn(c, F.lit(False))
    return V.miss_causes(m)


@R.add("agg28_compare_runs", "WITH r AS (SELECT event_type AS scene, min(value) FILTER (WHERE event_id % 2 = 0) AS b, min(value) FILTER (WHERE event_id % 2 = 1) AS a, max(value) FILTER (WHERE event_id % 2 = 1) AS m FROM (SELECT event_type, event_id, value + 10 AS value FROM events) GROUP BY 1) SELECT scene, round(b, 6) AS before, round(a, 6) AS after, round((m - a) / a, 6) AS spread, round((a - b) / b, 6) AS delta, CASE WHEN (a - b) / b > 0.08 THEN 'slower' WHEN (a - b) / b < -0.08 THEN 'faster' ELSE 'same' END AS verdict FROM r")
def _(s, d):
    runs = table(s, d, "events").select(F.col("event_type").alias("scene"), F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("run"), (F.col("value") + 10).alias("seconds"))
    return V.compare_runs(runs).select("scene", *(F.round(c, 6).alias(c) for c in ("before", "after", "spread", "delta")), "verdict")


# --- sinks -------------------------------------------------------------------


def exported_nodes(s, d):
    """Every work shown: held items and the works that edges reach, described where known, else by their key alone."""
    i = items_of(s, d).select("key", F.lit(True).alias("_held"), "title", "year", "creators", "item_type")
    known = table(s, d, "described").groupBy("key").agg(F.min_by(F.struct("title", "creators", "year", "cited_by_global"), F.struct("title", "year")).alias("m"))
    keys = E.node_keys(merged_of(s, d)).where("key is not null").union(i.select("key")).distinct()
    n = keys.join(i, "key", "left").join(known, "key", "left")
    held = F.coalesce("_held", F.lit(False))
    of = lambda c: F.when(held, F.col(c)).otherwise(F.col(f"m.{c}")).alias(c)
    return n.select("key", held.alias("held"), of("title"), of("year"), of("creators"), F.when(held, F.col("item_type")).alias("item_type"), F.when(~held, F.col("m.cited_by_global")).alias("cited_by_global"))


@R.add("snk1_node_link")
def _(s, d):
    m = merged_of(s, d)
    return X.node_link(exported_nodes(s, d).drop("creators"), m.select("from_key", "to_key", "confidence", "via"))


@R.add("snk2_graphml")
def _(s, d):
    m = merged_of(s, d)
    return X.graphml(exported_nodes(s, d), m.select("from_key", "to_key", "confidence", "via"))


@R.add("snk5_xml", "SELECT item_id, seq, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM items")
def _(s, d):
    return table(s, d, "items").select("item_id", "seq", X.xml(F.col("title")).alias("xml"))


@R.add("snk7_uncached", "SELECT DISTINCT att_key, hash AS stamp FROM attachments WHERE hash IS NOT NULL AND (att_key, hash) NOT IN (SELECT att_key, hash FROM attachments WHERE hash IS NOT NULL AND content_type = 'application/pdf')")
def _(s, d):
    a = table(s, d, "attachments").where("hash is not null")
    row = lambda df: df.select("att_key", F.col("hash").alias("stamp")).distinct()
    return X.uncached(row(a), row(a.where("content_type = 'application/pdf'")))


@R.add("snk9_wire", "SELECT from_key, to_key, max(confidence) AS confidence FROM edges WHERE from_key <> to_key GROUP BY 1, 2")
def _(s, d):
    return E.wire(merged_of(s, d)).select("from_key", "to_key", "confidence")
