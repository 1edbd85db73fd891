"""The queries of this folder's operators, each over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmesh.llm import canonical, cooccur, dedupe, leaks, matching, mixing, names, quality
from litmesh.session import table


def _found(s: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.cooccurrence(table(s, d, "edges"), "from_key", "to_key", min_support=5, min_lift=4.0)
    return pairs.select(F.col("item_a").alias("key_a"), F.col("item_b").alias("key_b"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.cooccurrence(table(s, d, "edges"), "from_key", "to_key", min_support=5)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", *(F.round(c, 6).alias(c) for c in ("lift", "log_odds", "odds_se", "z")))


def _mix(s: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")).select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names_of = lambda s, d: names.entered_names(table(s, d, "items"), table(s, d, "works"))
    works_of = lambda s, d: matching.matched(table(s, d, "items"), table(s, d, "described"), table(s, d, "journals"))
    leaks_of = lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items"))
    mapped_of = lambda s, d: canonical.mapped(table(s, d, "items"), table(s, d, "journals"))
    return {
        "p1_found": _found,
        "p1_pairs": _pairs,
        "p2_found": lambda s, d: dedupe.duplicate_pairs(table(s, d, "items")),
        "p2_records": lambda s, d: dedupe.deduplicated(table(s, d, "items")),
        "p3_found": lambda s, d: mapped_of(s, d).select("item_id", "journal_id"),
        "p3_values": lambda s, d: canonical.value_report(table(s, d, "items"), table(s, d, "journals")),
        "p4_found": lambda s, d: names.name_pairs(names_of(s, d)),
        "p4_classes": lambda s, d: names.name_classes(names_of(s, d)),
        "p5_found": lambda s, d: works_of(s, d).select("item_id", "described_key"),
        "p5_matches": works_of,
        "p6_found": lambda s, d: leaks_of(s, d).select("doc_id", "eval_id"),
        "p6_leaks": leaks_of,
        "p7_mix": _mix,
        "p7_shares": lambda s, d: mixing.shares(mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: quality.not_prose(table(s, d, "documents")),
        "p8_statistics": lambda s, d: quality.statistics(table(s, d, "documents"), table(s, d, "text_labels")),
    }


_PAIRS = """
WITH link AS (SELECT DISTINCT from_key AS f, to_key AS t FROM edges WHERE from_key <> to_key),
n AS (SELECT t, count(*) AS n FROM link GROUP BY t),
m AS (SELECT count(DISTINCT f) AS m FROM link),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM link a JOIN link b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 5),
q AS (SELECT a, b, c, x.n AS na, y.n AS nb, m FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b, m)
"""
_CANON = r"""
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY synced_at DESC, seq DESC) AS r FROM items WHERE item_id IS NOT NULL) WHERE r = 1),
c AS (SELECT item_id,
  regexp_replace(lower(nfc_normalize(replace(regexp_replace(title, '</?[a-zA-Z][^<>]*>', '', 'g'), '&amp;', '&'))), '[^\p{L}\p{N}]+', '', 'g') AS t,
  nullif(rtrim(regexp_replace(regexp_replace(lower(replace(replace(doi, '%2F', '/'), '%2f', '/')), '\s+', '', 'g'), '^(https?://)?([\w.-]*doi[\w.-]*/|doi:?)?10\.', '10.'), '.,;:'), '') AS d,
  trim(regexp_replace(lower(volume), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS v, trim(regexp_replace(lower(pages), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS p FROM last),
k AS (SELECT item_id, concat_ws('|', coalesce('t' || t, '-'), coalesce('d' || d, '-'), coalesce('v' || v, '-'), coalesce('p' || p, '-'),
  CASE WHEN d IS NULL AND (v IS NULL OR p IS NULL) THEN item_id END) AS k FROM c)
"""


def oracle_sql() -> dict[str, str]:
    both, oa, ob, none = "(c + 0.5)", "(na - c + 0.5)", "(nb - c + 0.5)", "(m - na - nb + c + 0.5)"
    odds, se = f"ln({both} * {none} / ({oa} * {ob}))", f"sqrt(1 / {both} + 1 / {oa} + 1 / {ob} + 1 / {none})"
    odds, se = odds.replace("0.5", "0.5::DOUBLE"), se.replace("0.5", "0.5::DOUBLE")
    return {
        "p1_found": _PAIRS + "SELECT a AS key_a, b AS key_b FROM q WHERE c * m >= 4 * na * nb",
        "p1_pairs": _PAIRS + f"SELECT a AS item_a, b AS item_b, c AS n_ab, na AS n_a, nb AS n_b, m AS n_baskets, round(c * m / (na * nb)::DOUBLE, 6) AS lift, round({odds}, 6) AS log_odds, round({se}, 6) AS odds_se, round({odds} / {se}, 6) AS z FROM q",
        "p2_found": _CANON + "SELECT a.item_id AS item_id_a, b.item_id AS item_id_b FROM k a JOIN k b ON a.k = b.k AND a.item_id < b.item_id",
        "p2_records": _CANON + "SELECT min(item_id) AS item_id, count(*) AS n_copies FROM k GROUP BY k",
    }
