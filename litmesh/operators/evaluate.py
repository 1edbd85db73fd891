"""Grading of strategies against answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.functions import ids


def accuracy(predicted: DataFrame, truth: DataFrame, traps: DataFrame | None = None) -> DataFrame:
    """(strategy, predicted, tp, fp, fn, precision, recall, f1, traps) of predictions (strategy, from_key, to_key).

    `truth` is (from_key, to_key); `traps` lists pairs that are no citation, `*` for any target.
    """
    p = predicted.select("strategy", "from_key", "to_key").distinct()
    t = truth.select("from_key", "to_key").distinct().withColumn("true", F.lit(True))
    n = F.lit(t.count())
    out = p.join(t, ["from_key", "to_key"], "left")
    trapped = F.lit(0)
    if traps is not None:
        one = traps.where("to_key <> '*'").select("from_key", "to_key").distinct().withColumn("_t", F.lit(1))
        every = traps.where("to_key = '*'").select("from_key").distinct().withColumn("_e", F.lit(1))
        out = out.join(one, ["from_key", "to_key"], "left").join(every, "from_key", "left")
        trapped = F.count_if(F.col("_t").isNotNull() | F.col("_e").isNotNull())
    out = out.groupBy("strategy").agg(F.count("*").alias("predicted"), F.count("true").alias("tp"), (trapped if traps is not None else F.max(F.lit(0)).cast("long")).alias("traps")).withColumn("_n", n)
    tp = F.col("tp")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.select("strategy", "predicted", "tp", (F.col("predicted") - tp).alias("fp"), (F.col("_n") - tp).alias("fn"), share(tp, F.col("predicted")).alias("precision"), share(tp, F.col("_n")).alias("recall"), share(2 * tp, F.col("predicted") + F.col("_n")).alias("f1"), "traps")


def unique_hits(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(strategy, unique_tp): true pairs only this strategy found."""
    p = predicted.select("strategy", "from_key", "to_key").distinct().join(truth.select("from_key", "to_key").distinct(), ["from_key", "to_key"], "left_semi")
    alone = p.groupBy("from_key", "to_key").agg(F.count("*").alias("n"), F.min("strategy").alias("strategy")).where("n = 1")
    return alone.groupBy("strategy").agg(F.count("*").alias("unique_tp"))


def external_grades(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(from_key, id, grade) of outside ids (from_key, id): tp, suffix (a true id with a publisher's tail), truncated (a strict beginning of one), else unconfirmed.

    Beginnings are met by an equi-join on the citing work, so only its own references are compared.
    """
    t = truth.select("from_key", F.col("id").alias("true_id")).distinct()
    p = predicted.select("from_key", "id").distinct()
    j = p.join(t, "from_key", "left")
    bare = F.regexp_replace("id", ids.URL_TAIL, "")
    grade = F.when(F.col("id") == F.col("true_id"), 3).when(bare == F.col("true_id"), 2).when(F.col("true_id").startswith(F.col("id")), 1).otherwise(0)
    best = j.groupBy("from_key", "id").agg(F.max(F.coalesce(grade, F.lit(0))).alias("g"))
    return best.select("from_key", "id", F.element_at(F.array(*map(F.lit, ("unconfirmed", "truncated", "suffix", "tp"))), F.col("g") + 1).alias("grade"))


def missed(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("from_key", "to_key").distinct().join(predicted.select("from_key", "to_key"), ["from_key", "to_key"], "left_anti")


def covered_only(predicted: DataFrame, covered: DataFrame) -> DataFrame:
    """Predictions of works the answer key covers; the others cannot be graded."""
    return predicted.join(covered.select("from_key").distinct(), "from_key", "left_semi")


def miss_states(misses: DataFrame, documents: DataFrame) -> DataFrame:
    """(state, misses): how far each missed pair's citing work came: no document, no text, or the quality of its best section."""
    rank = F.when(F.col("text").isNull() | (F.length("text") == 0), 0).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for q, r in (("none", 1), ("tail", 2), ("numbered", 3), ("heading", 4)) for x in (q, r)]), F.col("quality")), F.lit(1)))
    best = documents.groupBy("from_key").agg(F.max(rank).alias("r"))
    state = F.lit("no document")  # where no document was joined; element_at takes a null index for no null
    for r, name in enumerate(("no text", "none", "tail", "numbered", "heading")):
        state = F.when(F.col("r") == r, name).otherwise(state)
    return misses.join(best, "from_key", "left").groupBy(state.alias("state")).agg(F.count("*").alias("misses"))


def miss_evidence(misses: DataFrame, texts: DataFrame, targets: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Misses (from_key, to_key) with the flags that `miss_causes` reads, taken from the citing works' documents.

    `texts` is (from_key, text, flat, quality), a row for each document, `targets` (to_key, doi, title, author,
    year, volume, page) of cited works, `links` (from_key, uris). What a target lacks is no evidence.
    """
    words = lambda c: F.concat(F.lit(" "), ids.ascii_title(F.col(c)), F.lit(" "))
    has = lambda hay, x: F.coalesce(F.when(F.length(x) > 0, F.col(hay).contains(x)), F.lit(False))
    m = misses.select("from_key", "to_key").distinct().join(targets.groupBy("to_key").agg(F.min(F.struct("doi", "title", "author", "year", "volume", "page")).alias("t")), "to_key", "left")
    docs = texts.select("from_key", F.lower(F.coalesce("text", F.lit(""))).alias("_text"), F.lower(F.coalesce("flat", F.lit(""))).alias("_section"), words("text").alias("_words"), words("flat").alias("_in"), (F.coalesce("quality", F.lit("none")) != "none").alias("_some"))
    title = F.when(F.length(ids.ascii_title(F.col("t.title"))) >= 20, F.concat(F.lit(" "), ids.ascii_title(F.col("t.title")), F.lit(" ")))
    author = F.when(F.length(ids.ascii_title(F.col("t.author"))) > 0, F.concat(F.lit(" "), ids.ascii_title(F.col("t.author")), F.lit(" ")))
    locator = F.concat_ws(" ", F.lit(""), F.lower("t.volume"), F.lower("t.page"), F.lit(""))
    located = F.when(F.col("t.volume").isNotNull() & F.col("t.page").isNotNull(), locator)
    doi = F.lower("t.doi")
    flags = {
        "doi_in_section": has("_section", doi), "doi_in_text": has("_text", doi), "title_in_section": has("_in", title), "title_in_text": has("_words", title), "locator_in_section": has("_in", located), "locator_in_text": has("_words", located),
        "author_and_year_in_section": has("_in", author) & has("_in", F.col("t.year").cast("string")), "author_in_text": has("_words", author), "section_found": F.col("_some") & (F.length("_section") > 0), "text_found": F.length("_text") > 0, "document_found": F.lit(True),
    }
    seen = m.join(docs, "from_key").groupBy("from_key", "to_key").agg(*(F.bool_or(x).alias(c) for c, x in flags.items()))
    out = m.select("from_key", "to_key", doi.alias("_doi")).join(seen, ["from_key", "to_key"], "left")
    if links is None:
        return out.withColumn("doi_in_links", F.lit(False)).drop("_doi")
    linked = links.select("from_key", F.explode(F.transform("uris", lambda u: ids.norm_doi(u))).alias("_doi")).where("_doi is not null").distinct().withColumn("doi_in_links", F.lit(True))
    return out.join(linked, ["from_key", "_doi"], "left").drop("_doi")


def miss_causes(misses: DataFrame) -> DataFrame:
    """(cause, misses) of misses with evidence flags: the narrowest piece of evidence that is there names the cause."""
    flags = ("doi_in_links", "doi_in_section", "doi_in_text", "title_in_section", "title_in_text", "locator_in_section", "locator_in_text", "author_and_year_in_section", "author_in_text", "section_found", "text_found", "document_found")
    cause = F.lit("nothing")
    for f in reversed(flags):
        cause = F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)).otherwise(cause)
    return misses.groupBy(cause.alias("cause")).agg(F.count("*").alias("misses"))


def compare_runs(runs: DataFrame, noise: float = 0.08) -> DataFrame:
    """(scene, before, after, spread, delta, verdict) of repeats (scene, run, seconds): best of each run, and whether they differ by more than noise."""
    best = runs.groupBy("scene").agg(*[F.min(F.when(F.col("run") == r, F.col("seconds"))).alias(r) for r in ("before", "after")], F.max(F.when(F.col("run") == "after", F.col("seconds"))).alias("_most"))
    delta = (F.col("after") - F.col("before")) / F.col("before")
    return best.select("scene", "before", "after", ((F.col("_most") - F.col("after")) / F.col("after")).alias("spread"), delta.alias("delta"), F.when(delta > noise, "slower").when(delta < -noise, "faster").otherwise("same").alias("verdict"))


def report(now: DataFrame, before: DataFrame) -> DataFrame:
    """(strategy, and of precision, recall and f1 what they are, were and by how much they changed) of two `accuracy` results; a strategy of one run only has nulls."""
    names = ("precision", "recall", "f1")
    j = now.select("strategy", *(F.col(c).alias(f"{c}_now") for c in names)).join(before.select("strategy", *(F.col(c).alias(f"{c}_before") for c in names)), "strategy", "full_outer")
    return j.select("strategy", *(x for c in names for x in (F.col(f"{c}_now"), F.col(f"{c}_before"), (F.col(f"{c}_now") - F.col(f"{c}_before")).alias(f"{c}_delta"))))


def markdown(table: DataFrame, *, most: int = 1000) -> str:
    """A report of few rows as a Markdown table, numbers with three places; more than `most` rows are an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no report")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in (table.columns, ["---"] * len(table.columns), *rows))
