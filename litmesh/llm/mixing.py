"""Problem 7: mixing sources to target weights.

Method: entropy balancing. Among all document rates between 0 and the source's `max_repeats` the
mixture takes those of greatest entropy that give each source its target share of the tokens. The
convex dual has one multiplier a source; Newton iterations solve it with sums taken over the whole
corpus, and the rates are the (bounded) exponential tilts exp(multiplier * size) of a uniform rate.
The rates are then rounded to whole copies by a hash of the document, with one threshold a source
that brings the rounded total to its target.

A text that stands in several rows is one text: its least doc_id stands for it, so no text is used
more often than `max_repeats`. The corpus' total is the largest that all sources can reach, or `total`.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmesh.session import stage

#: How byte-level BPE cuts a text into words before merging: a fixed value of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BINS = 1 << 12
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _counter(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, digest, tokens) of each row; a null text has no digest and no tokens.

    `vocabulary` is a file of the driver: a byte-level BPE of some hundred kB, whose bytes go to the tasks.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches):
        tokens = None
        for batch in batches:
            tokens = tokens or _counter(shared.value)
            n = [0 if t is None else tokens(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "digest", "tokens"])

    rows = documents.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, digest string, tokens long")


def balance(sizes: DataFrame, targets: dict[str, float], most: dict[str, int], *, rounds: int = 60, tolerance: float = 1e-9) -> dict[str, tuple[float, float, float]]:
    """Of each source (base, multiplier, mean size): a text's log odds of a copy are base + multiplier * size / mean.

    `sizes` has (source, tokens, docs): a rate depends on source and size only, so that histogram
    holds all the dual needs. A step is halved while the constraint's error grows.
    """
    means = {r[0]: r[1] / r[2] for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")), F.sum("docs")).collect()}
    lam = {s: 0.0 for s in targets}
    base = {s: np.log(1.0 / most[s] / (1 - 1.0 / most[s] + 1e-12)) if most[s] > 1 else 0.0 for s in targets}
    step, error, back = dict(lam), {s: np.inf for s in targets}, dict(lam)
    for _ in range(rounds):
        col = lambda d: F.create_map(*[F.lit(x) for s, v in d.items() for x in (s, float(v))])[F.col("source")]
        x = F.col("tokens") / col(means)
        p = 1 / (1 + F.exp(-(col(base) + col(lam) * x)))
        w = F.col("docs") * F.col("tokens") * col({s: most[s] for s in targets})
        sums = {r[0]: (r[1], r[2]) for r in sizes.withColumn("p", p).groupBy("source").agg(F.sum(w * F.col("p")), F.sum(w * F.col("p") * (1 - F.col("p")) * x)).collect()}
        done = True
        for s in targets:
            g = sums[s][0] - targets[s]
            if abs(g) > tolerance * max(1.0, targets[s]):
                done = False
                if abs(g) > abs(error[s]):
                    step[s] /= 2
                else:
                    back[s], error[s] = lam[s], g
                    step[s] = -g / max(sums[s][1], 1e-9)
                    step[s] = float(np.clip(step[s], -20, 20))
                lam[s] = back[s] + step[s]
        if done:
            break
    return {s: (base[s], lam[s], means[s]) for s in targets}


def mixture(documents: DataFrame, mix_targets: DataFrame, *, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7, most_targets: int = 1000) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): the texts used at least once and how often.

    Sources that `mix_targets` does not list, null sources, null and empty texts belong to no mix. A
    source without any text cannot have its share: its target is left out and the shares of the
    others are of what remains. More than `most_targets` sources are an error: their goals and
    multipliers stand in the plan.
    """
    wanted = mix_targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share"), F.max("max_repeats")).limit(most_targets + 1).collect()
    if len(wanted) > most_targets:
        raise ValueError(f"the mix has more than {most_targets} sources: raise most_targets with the plan's size in mind")
    goals = {r[0]: (float(r[1]), int(r[2])) for r in wanted}
    listed = documents.where(F.col("source").isin(list(goals)) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counted = token_counts(listed, vocabulary).where("tokens > 0")
    texts = stage(counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("t")).select("t.*"))
    sizes = texts.groupBy("source", "tokens").agg(F.count("*").alias("docs"))
    sizes = stage(sizes)
    have = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs"))).collect()}
    goals = {s: g for s, g in goals.items() if s in have}
    schema = "doc_id long, source string, tokens long, rate double, copies int"
    if not goals:
        return documents.sparkSession.createDataFrame([], schema)
    shares = {s: g[0] / sum(x[0] for x in goals.values()) for s, g in goals.items()}
    most = {s: g[1] for s, g in goals.items()}
    reach = min(have[s] * most[s] / shares[s] for s in goals)
    size = reach if total is None else min(float(total), reach)
    dual = balance(sizes, {s: min(size * shares[s], have[s] * most[s] * (1 - 1e-6)) for s in goals}, most)
    col = lambda d: F.create_map(*[F.lit(x) for s, v in d.items() for x in (s, v)])[F.col("source")]
    tilt = col({s: float(d[0]) for s, d in dual.items()}) + col({s: float(d[1]) for s, d in dual.items()}) * F.col("tokens") / col({s: float(d[2]) for s, d in dual.items()})
    rated = texts.where(F.col("source").isin(list(goals))).withColumn("rate", col(most) / (1 + F.exp(-tilt)))
    # Rounding: a copy more where the document's hash is under the rate's fraction, shifted by one
    # threshold a source so that the rounded total meets the target.
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("late", uniform - (F.col("rate") - F.floor("rate")))
    bins = rated.groupBy("source", F.floor((F.col("late") + 1) * (BINS / 2)).alias("bin")).agg(F.sum("tokens").alias("more"), F.sum(F.col("tokens") * F.col("whole")).alias("sure"))
    own = Window.partitionBy("source")  # BINS rows a source at most
    bins = bins.withColumn("short", col({s: float(size * shares[s]) for s in goals}) - F.sum("sure").over(own)).withColumn("taken", F.sum("more").over(own.orderBy("bin")))
    nearest = bins.groupBy("source").agg(F.min("short").alias("short"), F.min(F.struct(F.abs(F.col("short") - F.col("taken")).alias("miss"), F.col("bin"))).alias("m")).collect()  # a row a source
    threshold = {r[0]: (r.m.bin + 1) / (BINS / 2) - 1 if r.m.miss <= abs(r.short) else -1.0 for r in nearest}
    copies = F.least(F.col("whole") + (F.col("late") < col({s: float(t) for s, t in threshold.items()})).cast("int"), col(most)).cast("int")
    return rated.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")


def shares(mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, n_copies, tokens, share): the shares really reached, one row for each target."""
    got = mix.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row for each source
    got = got.withColumn("share", F.col("tokens") / total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return mix_targets.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("n_texts"), zero("n_copies"), zero("tokens"), F.coalesce("share", F.lit(0.0)).alias("share"))
