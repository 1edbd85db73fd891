"""Problem 1: items that appear together.

Method: every basket's pairs are packed into 64-bit codes (two 32-bit item codes), each task sorts
its buffer and run-length counts it (a sorted run), the runs are exchanged by code, Spark's external
sorter spills and merges them, and one streaming pass adds up equal codes. Odds ratios carry the
Haldane-Anscombe continuity correction.

Before any pair is made, two exact bounds prune the items: a pair of support ``min_support`` needs
both items in at least as many baskets, and ``n_ab * N / (n_a * n_b) >= min_lift`` needs
``max(n_a, n_b) <= N / min_lift`` because ``n_ab <= min(n_a, n_b)``.

Baskets of more than ``hot_basket`` surviving items emit no pairs of their own: a pair that also
occurs in an ordinary basket has its hot baskets looked up by joins, and a pair that occurs in hot
baskets only needs ``min_support`` of them, so only items found in that many hot baskets are paired,
in blocks spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.session import stage

RUN = 4_000_000  # packed codes held by a task before it sorts and counts them


def _runs(codes: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts.astype(np.int64))], ["code", "n"])


def _pair_runs(batches):
    """Arrow batches of id lists -> sorted runs (code, n)."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column(0)
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(offsets)
        for k in np.unique(lengths):
            if k < 2:
                continue
            left, right = np.triu_indices(int(k), 1)
            rows = offsets[:-1][lengths == k]
            step = max(1, RUN // len(left))
            for at in range(0, len(rows), step):
                block = np.sort(ids[rows[at : at + step, None] + np.arange(k)], axis=1)
                held.append(((block[:, left] << 32) | block[:, right]).ravel())
                size += held[-1].size
                if size >= RUN:
                    yield _runs(held)
                    held, size = [], 0
    if held:
        yield _runs(held)


def _block_runs(batches):
    """As `_pair_runs`, of rows (left ids, right ids, same block) of one hot basket's block pair."""
    for batch in batches:
        for a, b, same in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            x, y = np.minimum.outer(a, b), np.maximum.outer(a, b)
            keep = np.triu(np.ones(x.shape, bool), 1) if same else x < y
            if keep.any():
                yield _runs([(x[keep] << 32) | y[keep]])


def _merge(batches):
    """Sorted (code, n) batches of one partition -> one row per code; a code may cross batches."""
    code, n = None, 0
    for batch in batches:
        codes, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        values, sums = codes[starts], np.add.reduceat(counts, starts)
        if code is not None:
            if values[0] == code:
                sums[0] += n
            else:
                values, sums = np.r_[code, values], np.r_[n, sums]
        code, n = values[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(values[:-1]), pa.array(sums[:-1])], ["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([n], pa.int64())], ["code", "n"])


def dense_codes(counts: DataFrame, key: str) -> DataFrame:
    """Adds ``code``: 0, 1, 2 ... in the byte order of ``key``, without a window over all rows."""
    numbered = stage(counts.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in numbered.groupBy(part.alias("p")).count().collect())  # a row for each partition
    total, start = 0, {}
    for p, n in sizes:
        start[p] = total
        total += n
    if total >= 2**31:
        raise ValueError("more than 2^31 items reach the least support: raise min_support")
    if not start:
        return numbered.withColumn("code", F.lit(0).cast("long")).drop("_at")
    offset = F.create_map(*[F.lit(x).cast("long") for p in start.items() for x in p])
    return numbered.withColumn("code", offset[part] + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).drop("_at")


def cooccurrence(rows: DataFrame, basket: str, item: str, *, min_support: int = 5, min_lift: float = 0.0, drop_self: bool = True, hot_basket: int = 1024) -> DataFrame:
    """Pairs of items that share at least ``min_support`` baskets and reach ``min_lift``.

    Result: item_a, item_b (a < b in byte order), n_ab, n_a, n_b, n_baskets, lift, log_odds, odds_se, z.
    A basket counts an item once however many rows say so. Rows with a null basket or item are no
    membership; with ``drop_self`` neither are rows whose basket is the item. An empty input gives an
    empty result. Other columns of ``rows`` are ignored, whatever their names.
    """
    links = rows.select(F.col(basket).alias("b"), F.col(item).alias("i")).where(F.col("b").isNotNull() & F.col("i").isNotNull())
    if drop_self:
        links = links.where(F.col("b") != F.col("i"))
    links = stage(links.distinct())
    n_baskets, n_links = links.groupBy("b").agg(F.count("*").alias("c")).agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    counts = links.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    if min_lift > 0:
        counts = counts.where(F.col("n") * F.lit(float(min_lift)) <= n_baskets)
    items = stage(dense_codes(counts, "i"))

    # An item in more than a thousandth of all links is one of at most 1000, so those may be
    # broadcast; the others meet their rows in a shuffle that no single item can dominate.
    hot_n = n_links // 1000
    hot = F.broadcast(items.where(F.col("n") > hot_n).select("i", "code"))
    often = F.broadcast(links.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > hot_n).select("i"))
    coded = links.join(hot, "i").unionByName(links.join(often, "i", "left_anti").join(items.where(F.col("n") <= hot_n).select("i", "code"), "i"))
    coded = stage(coded.select("b", F.col("code").cast("int").alias("code")))

    sizes = coded.groupBy("b").agg(F.count("*").alias("c"))
    hot_baskets = stage(sizes.where(F.col("c") > hot_basket))
    n_hot = hot_baskets.count()
    usual = coded.join(hot_baskets.select("b"), "b", "left_anti") if n_hot else coded
    lists = usual.groupBy("b").agg(F.collect_list("code").alias("ids")).where(F.size("ids") > 1).select("ids")
    schema = "code long, n long"
    runs = lists.mapInArrow(_pair_runs, schema)

    def merged(df: DataFrame) -> DataFrame:
        return df.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, schema)

    if n_hot:
        pairs = stage(merged(runs.unionByName(_hot_only(coded, hot_baskets, min_support, hot_basket))))
        pairs = _add_hot(pairs, coded, hot_baskets, min_support)
    else:
        pairs = merged(runs)
    pairs = pairs.where(F.col("n") >= min_support).select(F.shiftright("code", 32).alias("ca"), F.col("code").bitwiseAND(F.lit(2**32 - 1)).alias("cb"), F.col("n").alias("n_ab"))
    side = lambda c: items.select(F.col("code").alias(f"c{c}"), F.col("i").alias(f"item_{c}"), F.col("n").alias(f"n_{c}"))
    out = pairs.join(side("a"), "ca").join(side("b"), "cb").drop("ca", "cb").withColumn("n_baskets", F.lit(n_baskets).cast("long"))
    out = out.withColumn("lift", F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")))
    if min_lift > 0:
        out = out.where(F.col("n_ab") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    both, only_a, only_b, none = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5, F.col("n_baskets") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    out = out.withColumn("log_odds", F.log(both * none / (only_a * only_b))).withColumn("odds_se", F.sqrt(1 / both + 1 / only_a + 1 / only_b + 1 / none))
    return out.withColumn("z", F.col("log_odds") / F.col("odds_se")).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", "lift", "log_odds", "odds_se", "z")


def _in_hot(coded: DataFrame, hot_baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = coded.join(hot_baskets.select("b"), "b", "left_semi")
    return rows, rows.groupBy("code").agg(F.count("*").alias("h"))


def _hot_only(coded: DataFrame, hot_baskets: DataFrame, min_support: int, width: int) -> DataFrame:
    """Runs of hot baskets, over the items that are in at least ``min_support`` of them."""
    rows, by_item = _in_hot(coded, hot_baskets)
    rows = rows.join(by_item.where(F.col("h") >= min_support), "code", "left_semi").join(hot_baskets, "b")
    blocks = rows.withColumn("blocks", F.ceil(F.col("c") / width)).withColumn("k", F.pmod(F.xxhash64("code"), F.col("blocks")))
    packed = blocks.groupBy("b", "k", "blocks").agg(F.collect_list("code").alias("ids"))  # about `width` ids each
    left = packed.select("b", F.col("k").alias("x"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("y"), F.col("ids").alias("l"))
    right = packed.select("b", F.col("k").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("x"), F.col("ids").alias("r"))
    both = left.join(right, ["b", "x", "y"]).select("l", "r", (F.col("x") == F.col("y")).alias("same"))
    return both.mapInArrow(_block_runs, "code long, n long")


def _add_hot(pairs: DataFrame, coded: DataFrame, hot_baskets: DataFrame, min_support: int) -> DataFrame:
    """Adds the hot baskets of pairs of which one item at least is in fewer than ``min_support`` of them."""
    rows, by_item = _in_hot(coded, hot_baskets)
    by_item = stage(by_item)
    parts = pairs.select("code", "n", F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(2**32 - 1)).alias("z"))
    one = lambda c, h: by_item.select(F.col("code").cast("long").alias(c), F.col("h").alias(h))
    few = parts.join(one("a", "ha"), "a").join(one("z", "hz"), "z").withColumn("least", F.least("ha", "hz"))
    few = few.where((F.col("least") < min_support) & (F.col("n") + F.col("least") >= min_support))
    # The rarer item's few baskets come first, so rows stay in proportion to the pairs.
    rarer = F.col("ha") <= F.col("hz")
    few = few.select("code", F.when(rarer, F.col("a")).otherwise(F.col("z")).alias("a"), F.when(rarer, F.col("z")).otherwise(F.col("a")).alias("z"))
    member = lambda c: rows.select(F.col("code").cast("long").alias(c), "b")
    more = few.join(member("a"), "a").join(member("z"), ["z", "b"]).groupBy("code").agg(F.count("*").alias("n"))
    return pairs.unionByName(more).groupBy("code").agg(F.sum("n").alias("n"))
