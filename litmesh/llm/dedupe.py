"""Problem 2: duplicates hidden by formatting differences.

Method: every record gets a canonical form and its 64-bit hash. Each task marks the hashes it sees in
two Bloom filters, "seen" and "seen again"; the partitions' filters are merged region by region (a bit
that two partitions set is "again"), and only records whose bits are all "again" are possible repeats.
Those alone are shuffled and grouped exactly by their whole canonical form; all others are single.

The filters are made for one range of hashes after the other, each of `slice_mb` at most (16 bits a
record), so any number of records takes the same memory: of one range the merged filter passes
through the driver to the tasks. The staged records are sorted by hash within their files, so a
range reads its own row groups only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmesh.llm import textnorm
from litmesh.llm.groups import group_pairs
from litmesh.session import stage

REGION = 1 << 19  # bits of a filter that travel and are merged together
CHUNK = 1 << 21  # hashes marked at a time


def _canonical(batches):
    """(item_id, title, doi, volume, pages) -> (item_id, canon); null only equals null."""
    for batch in batches:
        _, title, doi, volume, pages = (c.to_pylist() for c in batch.columns)
        canon = []
        for t, d, v, p in zip(title, doi, volume, pages):
            d = (textnorm.doi(d) or None) if d is not None else None
            v = None if v is None else textnorm.locator(v)
            p = None if p is None else textnorm.locator(p)
            if d is None and (v is None or p is None):
                canon.append(None)
                continue
            canon.append("\x1f".join("\x00" if x is None else x for x in (None if t is None else textnorm.letters(t), d, v, p)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(canon, pa.string())], ["item_id", "canon"])


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """Two bit positions of each hash."""
    u = h.view(np.uint64)
    return np.stack([u & np.uint64(size - 1), (u >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)])


def _marker(size: int):
    def mark(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= CHUNK:
                yield _marked(np.concatenate(held), size)
                held, n = [], 0
        if held:
            yield _marked(np.concatenate(held), size)

    return mark


def _marked(h: np.ndarray, size: int) -> pa.RecordBatch:
    """The regions of both filters that these hashes mark; a bit hit by two of them is "again"."""
    where, hits = np.unique(_bits(h, size).ravel(), return_counts=True)
    region = (where // REGION).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    out: list[list] = [[], [], []]
    for i, j in zip(starts, [*starts[1:], len(where)]):
        seen = np.zeros(REGION, bool)
        seen[(where[i:j] % REGION).astype(np.int64)] = True
        again = np.zeros(REGION, bool)
        again[(where[i:j][hits[i:j] > 1] % REGION).astype(np.int64)] = True
        for column, value in zip(out, (int(region[i]), *(zlib.compress(np.packbits(x).tobytes(), 1) for x in (seen, again)))):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["region", "seen", "again"])


def _merge(batches):
    """Filters sorted by region -> one "again" filter for each region; one region is held at a time."""
    at = seen = again = None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], ["region", "again"])
    for batch in batches:
        for region, s, a in zip(*(c.to_pylist() for c in batch.columns)):
            s, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (s, a))
            if region != at:
                if at is not None:
                    yield done()
                at, seen, again = region, s.copy(), a.copy()
            else:
                again |= a | (seen & s)
                seen |= s
    if at is not None:
        yield done()


def _prober(filters, size: int):
    def probe(batches):
        table = {r: np.frombuffer(zlib.decompress(b), np.uint8) for r, b in filters.value}
        whole = np.concatenate([table.get(r, np.zeros(REGION // 8, np.uint8)) for r in range(max(1, size // REGION))])
        for batch in batches:
            bits = _bits(batch.column("h").to_numpy().astype(np.int64), size).astype(np.int64)
            hit = ((whole[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=0)
            if hit.any():
                yield batch.filter(pa.array(hit))

    return probe


def _range(k: int, slices: int) -> Column:
    """Whether a hash lies in the k-th of so many ranges of all hashes."""
    bound = lambda i: (i << 64) // slices - (1 << 63)
    above = F.lit(True) if k == 0 else F.col("h") >= F.lit(bound(k))
    return above if k == slices - 1 else above & (F.col("h") < F.lit(bound(k + 1)))


def possible_repeats(records: DataFrame, n: int, slice_mb: float = 64) -> DataFrame:
    """Of `n` records (item_id, canon, h) at least all those whose hash another record has, staged."""
    most = int(slice_mb * (1 << 23))  # bits
    slices = max(1, math.ceil(16 * n / most))
    size = max(REGION, 1 << (16 * math.ceil(max(n, 1) / slices) - 1).bit_length())
    context, out = records.sparkSession.sparkContext, None
    for k in range(slices):
        rows = records.where(_range(k, slices)) if slices > 1 else records
        marked = rows.select("h").mapInArrow(_marker(size), "region long, seen binary, again binary")
        merged = marked.repartition("region").sortWithinPartitions("region").mapInArrow(_merge, "region long, again binary")
        filters = context.broadcast([(r[0], bytes(r[1])) for r in merged.collect()])  # twice slice_mb at most
        part = stage(rows.mapInArrow(_prober(filters, size), records.schema))
        filters.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _records(items: DataFrame) -> DataFrame:
    """One (item_id, canon, h) for each delivery that counts, staged."""
    twice = items.groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.struct("synced_at", "seq")).alias("last")).where("n > 1")
    old = items.select("item_id", F.struct("synced_at", "seq").alias("at")).join(twice, "item_id").where(F.col("at") != F.col("last")).select("item_id", F.col("at.seq").alias("seq")).distinct()
    rows = items.where(F.col("item_id").isNotNull()).join(old, ["item_id", "seq"], "left_anti").select("item_id", "title", "doi", "volume", "pages")
    canon = rows.mapInArrow(_canonical, "item_id long, canon string")
    hashed = canon.withColumn("h", F.xxhash64(F.coalesce("canon", F.concat(F.lit("\x00item"), F.col("item_id").cast("string")))))
    return stage(hashed.sortWithinPartitions("h"))


def duplicate_groups(items: DataFrame, *, slice_mb: float = 64) -> tuple[DataFrame, DataFrame]:
    """(records, members): all records (item_id, canon, h), and (canon, item_id) of those with a copy.

    Records are the same if title, doi, volume and pages are, null only with null, and are told
    apart from others only if doi is given or both volume and pages are; without these a row is a
    record of its own. Of an item delivered several times the last delivery (synced_at, seq) counts,
    and whole rows repeated count once. Rows without item_id are left out. Other columns are ignored.
    """
    records = _records(items)
    n = records.count()
    some = possible_repeats(records.where(F.col("canon").isNotNull()), n, slice_mb).select("canon", "item_id").distinct()
    groups = some.groupBy("canon").agg(F.count("*").alias("c")).where("c > 1").select("canon")
    return records, some.join(groups, "canon", "left_semi")


def duplicate_pairs(items: DataFrame) -> DataFrame:
    """(item_id_a, item_id_b): all pairs of each group of copies, smaller id first."""
    members = stage(duplicate_groups(items)[1])
    return group_pairs(members, "canon", "item_id").select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def deduplicated(items: DataFrame) -> DataFrame:
    """(item_id, n_copies): one row for each record, its least item_id and its number of items."""
    records, members = duplicate_groups(items)
    members = stage(members)
    kept = members.groupBy("canon").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_copies")).select("item_id", "n_copies")
    single = records.select("item_id").distinct().join(members.select("item_id"), "item_id", "left_anti").withColumn("n_copies", F.lit(1).cast("long"))
    return kept.unionByName(single)
