"""Queries of orders, slots, kernels, filter texts, providers, caches and sinks, with SQL where it can say the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.functions import kernels as K
from litmesh.functions.references import section_udf
from litmesh.operators import edges as E
from litmesh.operators import evaluate as V
from litmesh.operators import export as X
from litmesh.operators import filters as L
from litmesh.operators import items as I
from litmesh.operators import layout as Y
from litmesh.plans.build import PROVIDERS
from litmesh.plans.view import ViewSpec
from litmesh.queries import _LABEL, _STOP, ID, IS_EXT, MERGED, NS, REC, TITLE, YEAR, R, edges_of, items_of, merged_of
from litmesh.queries_build import FOLDED, PRINTED, printed_of, written_texts
from litmesh.queries_view import GRADED, graded
from litmesh.session import table

# --- kernels -----------------------------------------------------------------


def _column(kernel, kind="string"):
    """A function of one text as an Arrow-batched column function."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else kernel(t))

    return run


_CLOSED = "substr({0}, 1, length({0}) - 1)"


def _stripped(c: str, depth: int) -> str:
    """Closers without opener cut off the end, `depth` times at most, marks before them too."""
    if not depth:
        return c
    more = f"(length({c}) - length(replace({c}, ')', ''))) > (length({c}) - length(replace({c}, '(', '')))"
    return _stripped(f"(CASE WHEN ends_with({c}, ')') AND {more} THEN regexp_replace(substr({c}, 1, length({c}) - 1), '[.,;:\\]]+$', '') ELSE {c} END)", depth - 1)


@R.add("fn2_strip_closers", f"SELECT DISTINCT doi, {_stripped('x', 3)} AS stripped FROM (SELECT doi, trim(doi) || '.).)' AS x FROM items WHERE doi IS NOT NULL AND doi NOT LIKE '%)')")
def _(s, d):
    i = table(s, d, "items").where("doi is not null and not endswith(doi, ')')").select("doi").distinct()
    return i.select("doi", _column(K.strip_closers)(F.concat(F.trim("doi"), F.lit(".).)"))).alias("stripped"))


@R.add("fn4_decode_entities", "SELECT journal_id, replace(name, 'e', 'é') || ' <' || abbreviation || '> – A' AS decoded FROM journals")
def _(s, d):
    coded = F.concat(F.replace("name", F.lit("e"), F.lit("&#233;")), F.lit(" &lt;"), F.col("abbreviation"), F.lit("&GT; &#x2013; &tnqx41;"))
    return table(s, d, "journals").select("journal_id", _column(K.decode_entities)(coded).alias("decoded"))


@R.add("fn5_heal_dois", r"SELECT DISTINCT doi, CASE WHEN regexp_matches(substr(doi, strpos(doi, '/') + 1), '^[-._;()/:<>a-zA-Z0-9]*\d') THEN 'see ' || doi || ' for more' ELSE 'see ' || substr(doi, 1, strpos(doi, '/')) || '  ' || substr(doi, strpos(doi, '/') + 1) || ' for more' END AS healed FROM (SELECT trim(doi) AS doi FROM items WHERE regexp_matches(trim(doi), '^10\.\d{4,9}/[-._;()/:<>a-zA-Z0-9]*[a-zA-Z0-9]$'))")
def _(s, d):
    i = table(s, d, "items").select(F.trim("doi").alias("doi")).where(F.col("doi").rlike(r"^10\.\d{4,9}/[-._;()/:<>a-zA-Z0-9]*[a-zA-Z0-9]$")).distinct()
    at = F.instr("doi", F.lit("/"))
    torn = F.concat(F.lit("see "), F.substring("doi", F.lit(1), at), F.lit("  "), F.substring("doi", at + 1, F.length("doi")), F.lit(" for more"))
    return i.select("doi", K.heal_dois_udf(torn).alias("healed"))


@R.add("fn6_opens_entry", "SELECT journal_id, k, k <= 3 AS opens FROM journals, (SELECT unnest([1, 2, 3, 4, 9]) AS k)")
def _(s, d):
    rows = table(s, d, "journals").select("journal_id", "name", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 9)))).alias("k"))
    text = F.concat(F.lit("["), "journal_id", F.lit("] Adams, "), "name", F.lit(", 1999. "))
    whole = F.concat(text, F.lit("["), F.col("journal_id") + F.col("k"), F.lit("] Brown, B."))

    @F.pandas_udf("boolean")
    def opens(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([K.opens_entry(t, a) for t, a in zip(texts, at)])

    return rows.select("journal_id", "k", opens(whole, F.length(text) + 1).alias("opens"))


@R.add("fn9_norm_title", f"SELECT item_id, seq, {FOLDED.format('title')} AS norm_title FROM items")
def _(s, d):
    return table(s, d, "items").select("item_id", "seq", K.norm_title_udf("title").alias("norm_title"))


@R.add("fn13_edge_keys", "SELECT from_key, to_key, count(*) AS n FROM edges GROUP BY 1, 2")
def _(s, d):
    return edges_of(s, d).groupBy("from_key", "to_key").agg(F.count("*").alias("n"))


@R.add("fn18_names_journal", f"""WITH t AS (SELECT journal_id, list_filter(string_split({TITLE.format('name')}, ' '), lambda x: x NOT IN ({_STOP})) AS n, list_filter(string_split({TITLE.format('abbreviation')}, ' '), lambda x: x NOT IN ({_STOP})) AS a FROM journals),
p AS (SELECT journal_id, len(n) = len(a) AS same, unnest(list_zip(a, n, range(1, len(n) + 1))) AS p, len(n) AS k FROM t),
g AS (SELECT journal_id, same, CASE WHEN least(length(p[1]), length(p[2])) >= 3 THEN starts_with(p[1], p[2]) OR starts_with(p[2], p[1]) ELSE p[1] = p[2] OR (p[3] < k AND length(p[2]) >= 4 AND length(p[1]) > 0 AND starts_with(p[2], p[1])) END AS ok FROM p)
SELECT journal_id, bool_and(coalesce(same AND ok, false)) AS named FROM g GROUP BY journal_id""")
def _(s, d):
    words = lambda c: ids.journal_tokens(ids.ascii_title(F.col(c)))
    return table(s, d, "journals").select("journal_id", K.names_journal_udf(F.array_join(words("abbreviation"), " "), words("name")).alias("named"))


@R.add("fn21_first_surname")
def _(s, d):
    from litmesh.functions.references import first_surname

    names = table(s, d, "items").select(F.array_join("creators", "; ").alias("authors")).where("authors <> ''").distinct()
    return names.select("authors", _column(first_surname)(F.col("authors")).alias("surname"))


@R.add("fn33_hash_index", "SELECT to_key, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(to_key, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS h, CAST(((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 12 + 12) % 12 AS BIGINT) AS slot FROM (SELECT DISTINCT to_key FROM edges)")
def _(s, d):
    k = edges_of(s, d).select("to_key").distinct()
    return k.select("to_key", F.aggregate(F.filter(F.split("to_key", ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(2**32))).alias("h"), ids.hash_index(F.col("to_key"), 12).alias("slot"))


@R.add("fn39_year_of", f"SELECT key, min({YEAR.format('date')}) AS year FROM items WHERE key IS NOT NULL GROUP BY key")
def _(s, d):
    return table(s, d, "items").where("key is not null").groupBy("key").agg(F.min(ids.first_year(F.col("date"))).alias("year"))


# --- reference sections ------------------------------------------------------


@R.add("flt12_quality", f"WITH {REC}, {PRINTED} SELECT 'heading' AS quality, count(DISTINCT f) AS documents FROM prt")
def _(s, d):
    return written_texts(s, d).select(section_udf("text").alias("s")).groupBy("s.quality").agg(F.count("*").alias("documents"))


@R.add("doc17_numbered_entries", f"WITH {REC}, {PRINTED} SELECT f AS parent_key, count(*) + 1 AS entries FROM prt GROUP BY f")
def _(s, d):
    """Markers that number the entries of each list, one for each entry printed and one for the closing entry."""
    from litmesh.functions.references import ascending_run

    @F.pandas_udf("long")
    def entries(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(ascending_run(t, 1)))

    return written_texts(s, d).select("parent_key", entries(F.element_at(F.split("text", "\nReferences\n"), 2)).alias("entries"))


@R.add("agg20_miss_states", f"WITH {GRADED}, {REC}, {PRINTED}, m AS (SELECT t.* FROM t ANTI JOIN p USING (from_key, to_key)) SELECT CASE WHEN from_key IN (SELECT f FROM prt) THEN 'heading' ELSE 'no document' END AS state, count(*) AS misses FROM m GROUP BY 1")
def _(s, d):
    docs = written_texts(s, d).select(F.col("parent_key").alias("from_key"), "text", section_udf("text").alias("s")).select("from_key", "text", "s.quality")
    return V.miss_states(V.missed(*graded(s, d)), docs)


@R.add("agg21_evidence")
def _(s, d):
    """Causes of the misses by evidence from the texts: what is printed of a target is in the section."""
    docs = written_texts(s, d).select(F.col("parent_key").alias("from_key"), "text", section_udf("text").alias("s")).select("from_key", "text", "s.flat", "s.quality")
    targets = printed_of(s, d).select("to_key", "doi", "title", "author", "year", "volume", "page").distinct()
    return V.miss_causes(V.miss_evidence(V.missed(*graded(s, d)), docs, targets))


# --- filter texts ------------------------------------------------------------

_FILTERS = ("year: >2010", "year: 1995-1990", "year: <=1980", 'tag: "review"', "tag: unread, review", "title: thermal", "type: ~book", "year: 2001")
_FILTER_SQL = ("year > 2010", "year BETWEEN 1990 AND 1995", "year <= 1980", "list_contains(list_transform(tags, lambda x: lower(x)), 'review')", "list_bool_or(list_transform(tags, lambda x: contains(lower(x), 'unread') OR contains(lower(x), 'review')))", "contains(lower(title), 'thermal')", "contains(lower(item_type), 'book')", "year = 2001")


@R.add("flt3_parsed_filters", f"WITH {REC} " + " UNION ALL ".join("SELECT '{}' AS filter, count(*) AS items FROM rec WHERE {}".format(a.replace("'", "''"), b) for a, b in zip(_FILTERS, _FILTER_SQL)))
def _(s, d):
    facets = I.facets(items_of(s, d))
    return facets.agg(F.map_from_arrays(F.array(*map(F.lit, _FILTERS)), F.array(*(F.count_if(L.predicate(L.parse(t))) for t in _FILTERS))).alias("m")).select(F.explode("m").alias("filter", "items"))


_SHOWN = (">=2011", "1990-1995", "<=1980", '"review"', '~"unread", ~"review"', '~"thermal"', '~"book"', "2001")


@R.add("flt5_shown_filters", " UNION ALL ".join("SELECT '{}' AS filter, '{}' AS shown, true AS same".format(t.replace("'", "''"), f"{t.partition(':')[0]}: {x}") for t, x in zip(_FILTERS, _SHOWN)))
def _(s, d):
    parsed = [(t, L.show(L.parse(t)), L.parse(L.show(L.parse(t))) == L.parse(t)) for t in _FILTERS]
    return s.createDataFrame(parsed, "filter string, shown string, same boolean")


_YEARS = (("1999", 1999, 1999), (">=2000", 2000, None), ("> 2000", 2001, None), ("<1990", None, 1989), ("2005..2001", 2001, 2005), ("1890–1895", 1890, 1895), ("20", None, None), ("about 1999", None, None))


@R.add("fn35_year_terms", " UNION ALL ".join(f"SELECT '{t}' AS term, {'NULL' if a is None else a}::INTEGER AS low, {'NULL' if b is None else b}::INTEGER AS high" for t, a, b in _YEARS))
def _(s, d):
    terms = [(t, L.parse(f"year: {t}").terms[0]) for t, _, _ in _YEARS]
    return s.createDataFrame([(t, x.low, x.high) for t, x in terms], "term string, low int, high int")


@R.add("prj2_view_state", "SELECT filters, min_confidence, min_cites, same FROM (VALUES ('year: >=1990; tag: \"review\"', 0.7::DOUBLE, 3, true)) t(filters, min_confidence, min_cites, same)")
def _(s, d):
    spec = ViewSpec(filters=("year: >=1990", 'tag: "review"'), min_confidence=0.7, min_cites=3, hidden=("A",))
    again = ViewSpec.loads(spec.dumps())
    return s.createDataFrame([("; ".join(again.filters), again.min_confidence, again.min_cites, again == spec)], "filters string, min_confidence double, min_cites int, same boolean")


# --- providers ---------------------------------------------------------------

_KNOWN = ("pdf-links", "text-doi", "title-match", "locator-match", "ref-strings", "openalex")


@R.add("flt11_selected_providers", "SELECT * FROM (VALUES ('default', 'pdf-links'), ('default', 'text-doi'), ('default', 'title-match'), ('default', 'locator-match'), ('only', 'ref-strings'), ('without', 'pdf-links'), ('without', 'title-match'), ('without', 'locator-match')) t(choice, provider)")
def _(s, d):
    chosen = {"default": PROVIDERS.select(), "only": PROVIDERS.select(["ref-strings", "openalex"], offline=True), "without": PROVIDERS.select(without=("text-doi",))}
    return s.createDataFrame([(c, p.id) for c, ps in chosen.items() for p in ps], "choice string, provider string")


@R.add("udf3_registry", "SELECT * FROM (VALUES ('pdf-links', false, true), ('text-doi', false, true), ('title-match', false, true), ('locator-match', false, true), ('ref-strings', false, false), ('openalex', true, false)) t(provider, requires_network, default_enabled)")
def _(s, d):
    return s.createDataFrame([(p.id, p.requires_network, p.default_enabled) for p in PROVIDERS.known.values() if p.id in _KNOWN], "provider string, requires_network boolean, default_enabled boolean")


# --- orders and slots --------------------------------------------------------

_H = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
_SLOT = f"((CASE WHEN {_H} >= 2147483648 THEN {_H} - 4294967296 ELSE {_H} END) % 10 + 10) % 10"


@R.add("win2_colour_slots", f"""WITH RECURSIVE {REC}, k AS (SELECT category, n, CAST({_SLOT.replace('{0}', 'category')} AS INTEGER) AS h, row_number() OVER (ORDER BY n DESC, category) AS r FROM (SELECT coalesce(nullif(publication, ''), '(none)') AS category, count(*) AS n FROM rec GROUP BY 1)),
f(r, category, slot, taken) AS (SELECT 0::BIGINT, NULL::VARCHAR, -1, []::INTEGER[] UNION ALL SELECT k.r, k.category, x, list_append(taken, x) FROM (SELECT k.r AS r, k.category AS category, f.taken AS taken, list_filter(list_transform(range(20), lambda i: CAST(CASE WHEN i < 10 THEN (k.h + i) % 10 ELSE 10 + (k.h + i) % 10 END AS INTEGER)), lambda c: NOT list_contains(f.taken, c))[1] AS x FROM f JOIN k ON k.r = f.r + 1 WHERE k.r <= 20) k)
SELECT k.category, coalesce(f.slot, k.h) AS slot FROM k LEFT JOIN f USING (r)""")
def _(s, d):
    counts = Y.category(items_of(s, d), "publication").groupBy("category").agg(F.count("*").alias("items"))
    return Y.colour_slots(counts)


@R.add("win6_title_targets", f"WITH {REC}, t AS (SELECT key, seq, {TITLE.format('title')} AS norm_title FROM rec) SELECT key, norm_title FROM t WHERE length(norm_title) >= 30")
def _(s, d):
    return Y.title_targets(items_of(s, d))


@R.add("win7_cluster_order", f"WITH {REC} SELECT item_type AS comm, count(*) AS size FROM rec GROUP BY 1 ORDER BY size DESC, comm")
def _(s, d):
    return Y.cluster_order(items_of(s, d).select("key", F.col("item_type").alias("comm")))


@R.add("win10_label_order", f"WITH {MERGED}, {REC}, g AS (SELECT to_key AS key, count(*) AS n FROM merged GROUP BY 1) SELECT rec.key, coalesce(n, 0) AS in_degree FROM rec LEFT JOIN g USING (key) ORDER BY in_degree DESC, rec.seq, rec.key LIMIT 100")
def _(s, d):
    n = items_of(s, d).select("key", "seq").join(E.degrees(merged_of(s, d)).select("key", "in_degree"), "key", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return Y.label_order(n.withColumn("radius", F.col("in_degree"))).limit(100).select("key", "in_degree")


@R.add("fn40_categories", f"WITH {REC} SELECT coalesce(nullif(creators[1], ''), '(none)') AS category, count(*) AS items FROM rec GROUP BY 1")
def _(s, d):
    return Y.category(items_of(s, d), "author").groupBy("category").agg(F.count("*").alias("items"))


# --- caches, increments ------------------------------------------------------


@R.add("str4_fresh_cache", "SELECT key, max(synced_at) AS fetched_at FROM items WHERE key IS NOT NULL AND synced_at > (SELECT max(synced_at) FROM items) - INTERVAL 30 DAY GROUP BY key")
def _(s, d):
    i = table(s, d, "items")
    now = i.agg(F.max("synced_at")).first()[0]
    cache = i.where("key is not null").groupBy("key").agg(F.max("synced_at").alias("fetched_at"))
    return X.fresh(cache, F.lit(now)).select("key", "fetched_at")


_GHOST = f"(SELECT max(to_key) FROM edges WHERE {IS_EXT.format('to_key')})"


@R.add("str3_adopted", f"SELECT from_key, to_key, max(confidence) AS confidence FROM (SELECT from_key, CASE WHEN to_key = {_GHOST} THEN 'ADOPTED0' ELSE to_key END AS to_key, confidence FROM edges) WHERE from_key <> to_key GROUP BY 1, 2")
def _(s, d):
    ghost = edges_of(s, d).where(ids.is_external(F.col("to_key"))).agg(F.max("to_key")).first()[0]
    return E.adopt(merged_of(s, d), ghost, "ADOPTED0").select("from_key", "to_key", "confidence")


# --- sinks -------------------------------------------------------------------


@R.add("snk3_export_nodes", f"""WITH {MERGED}, {REC}, ends AS (SELECT from_key AS key, 0 AS i FROM merged UNION ALL SELECT to_key, 1 FROM merged), n AS (SELECT key, sum(i) AS c FROM ends GROUP BY key), w AS (SELECT key, arg_min(struct_pack(t := title, y := year, v := venue, g := cited_by_global), struct_pack(t := title, y := year)) AS o FROM described GROUP BY key)
SELECT coalesce(n.key, rec.key) AS key, CASE WHEN rec.key IS NOT NULL THEN rec.title ELSE o.t END AS title, CASE WHEN rec.key IS NOT NULL THEN rec.year ELSE o.y END AS year, CASE WHEN rec.key IS NOT NULL THEN publication ELSE o.v END AS publication,
CASE WHEN rec.key IS NOT NULL THEN norm_doi WHEN {NS.format('n.key')} = 'doi' THEN {ID.format('n.key')} END AS doi, rec.key IS NOT NULL AS held, CAST(coalesce(c, 0) AS BIGINT) AS cited_here, CASE WHEN rec.key IS NOT NULL THEN 170 END AS r, round(4 * sqrt(1 + 2 * coalesce(c, 0)), 6) AS size FROM n FULL JOIN rec ON rec.key = n.key LEFT JOIN w ON w.key = coalesce(n.key, rec.key)""")
def _(s, d):
    i = items_of(s, d)
    none = i.select("key", F.lit(None).cast("string").alias("label")).where("false")
    n = Y.export_nodes(merged_of(s, d), i, table(s, d, "described"), none, i.select("key", F.lit("#aa0044").alias("color")), i.select("key", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return n.select("key", "title", "year", "publication", "doi", "held", "cited_here", "r", F.round("size", 6).alias("size"))


@R.add("snk6_file_names", r"SELECT journal_id, CASE WHEN x = '' THEN 'graph' ELSE x END AS file_name FROM (SELECT journal_id, regexp_replace(substr(trim(regexp_replace(regexp_replace(regexp_replace(name || ': a/b?', '[\x00-\x1f\x7f]', '', 'g'), '[<>:\"/\\|?*]', '-', 'g'), '\s+', ' ', 'g'), ' .'), 1, 120), '[ .]+$', '') AS x FROM journals)")
def _(s, d):
    return table(s, d, "journals").select("journal_id", _column(X.file_name)(F.concat("name", F.lit(": a/b?"))).alias("file_name"))


@R.add("snk8_report", f"WITH {GRADED}, c AS (SELECT strategy, count(*) AS predicted, count(*) FILTER (WHERE (from_key, to_key) IN (SELECT from_key, to_key FROM t)) AS tp FROM p GROUP BY 1) SELECT strategy, round(tp / predicted, 6) AS precision_now, round(tp / (SELECT count(*) FROM t), 6) AS recall_now, round(tp / predicted - 0.5, 6) AS precision_delta FROM c")
def _(s, d):
    now = V.accuracy(*graded(s, d))
    before = now.select("strategy", F.lit(0.5).alias("precision"), F.lit(0.5).alias("recall"), F.lit(0.5).alias("f1"))
    return V.report(now, before).select("strategy", *(F.round(c, 6).alias(c) for c in ("precision_now", "recall_now", "precision_delta")))


@R.add("prj1_view_nodes", f"WITH {MERGED}, {REC}, " + """shown AS (SELECT key FROM rec WHERE year >= 1990), ve AS (SELECT from_key, to_key FROM merged WHERE confidence >= 0.5 AND from_key IN (SELECT key FROM shown) AND len(list_filter(vias, lambda x: x <> 'ref-strings')) > 0),
""" + f"gh AS (SELECT to_key FROM ve WHERE {IS_EXT.format('to_key')} GROUP BY to_key HAVING count(*) >= 2), vw AS (SELECT * FROM ve WHERE to_key IN (SELECT key FROM shown) OR to_key IN (SELECT to_key FROM gh)), x AS (SELECT from_key AS key, 0 AS i FROM vw UNION ALL SELECT to_key, 1 FROM vw), dg AS (SELECT key, count(*) AS degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY key), " + f"w AS (SELECT key, arg_min(struct_pack(t := title, c := creators, y := year), struct_pack(t := title, y := year)) AS m FROM described GROUP BY key), q AS (SELECT key, title, creators, year, true AS held FROM rec WHERE key IN (SELECT key FROM shown) UNION ALL SELECT to_key, m.t, m.c, m.y, false FROM gh LEFT JOIN w ON w.key = to_key), l AS (SELECT *, CASE WHEN contains({ID.format('key')}, '/') THEN substr({ID.format('key')}, strpos({ID.format('key')}, '/') + 1) ELSE {ID.format('key')} END AS tail FROM q) SELECT key, held, CASE WHEN held OR title IS NOT NULL THEN {_LABEL.format(c='creators', t='title', y='year')} WHEN length(tail) > 20 THEN substr(tail, 1, 19) || '…' ELSE tail END AS label, year, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree FROM l LEFT JOIN dg USING (key)")
def _(s, d):
    from litmesh.plans.view import view_edges, view_nodes
    from litmesh.queries_view import SPEC
    from litmesh.session import stage

    i = items_of(s, d)
    f = I.facets(i)
    e = stage(view_edges(merged_of(s, d), f, SPEC).select("from_key", "to_key"))
    return view_nodes(e, i, f, table(s, d, "described"), SPEC)


@R.add("prj1_payload", f"WITH {MERGED}, {REC} SELECT 'item' AS part, count(*) AS n FROM rec UNION ALL SELECT 'external', count(DISTINCT to_key) FROM merged WHERE {IS_EXT.format('to_key')} UNION ALL SELECT 'edge', count(*) FROM merged UNION ALL SELECT 'meta', 1")
def _(s, d):
    from litmesh.plans.view import payload

    return payload(items_of(s, d), merged_of(s, d), table(s, d, "described"), {"built": "2024-01-01"}).groupBy("part").agg(F.count("*").alias("n"))
