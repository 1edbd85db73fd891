"""Graph analytics on citation edges: coupling, communities and their names, gaps, neighbourhoods."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmesh.functions import ids, scores
from litmesh.session import stage

#: Words that say nothing about a subfield: fixed values.
TITLE_STOP = tuple(
    """a an the and or of for in on at to from with without within by via as is are be we our its their this that these those it not no new novel
    toward towards through over under between into out about after before during use using used usage based case study studies paper article report letter review
    overview introduction chapter thesis preprint approach approaches method methods technique techniques result results effect effects system systems model models
    can may vs versus one two three first second high low large small more most less than then there here have has had do does done such also""".split()
)
LEAST_GAP, GAP_LIMIT, LABEL_TERMS, SEPARATOR = 2, 25, 2, " / "


def block_pairs(rows: DataFrame, group: str, member: str, width: int = 512) -> DataFrame:
    """(a, b) with a < b of each two members of a group, one row for each group they share.

    A group of more than `width` members is cut in blocks, and each two blocks meet in a task of their
    own, so one much-cited work neither fills a task nor holds up a stage.
    """
    r = rows.select(F.col(group).alias("g"), F.col(member).alias("m"))
    n = r.groupBy("g").agg(F.ceil(F.count("*") / width).alias("n"))
    r = r.join(n, "g").withColumn("k", F.pmod(F.xxhash64("m"), F.col("n")))
    left = r.select("g", F.col("k").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("y"), F.col("m").alias("a"))
    right = r.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"), F.col("k").alias("y"), F.col("m").alias("b"))
    return left.join(right, ["g", "x", "y"]).where(F.col("a") < F.col("b")).select("a", "b")


def coupled(edges: DataFrame, held: DataFrame, *, max_share: float = 0.5) -> DataFrame:
    """(key, n, ts, cites): the works that coupling says anything of, staged, a row each.

    n is a work's number of references, ts are numbers of the works it cites that tell something, cites
    are the held works it cites. Works cited by one held work only, or by more than max(3, max_share of
    all citing works), tell nothing.
    """
    keys = held.select("key").distinct()
    links = edges.select("from_key", "to_key").where(F.col("from_key") != F.col("to_key")).distinct()
    links = stage(links.join(keys, F.col("from_key") == F.col("key"), "left_semi"))
    sizes = links.groupBy("from_key").agg(F.count("*").alias("n"))
    cap = max(3, int(max_share * sizes.count()))
    telling = links.groupBy("to_key").agg(F.count("*").alias("c")).where((F.col("c") >= 2) & (F.col("c") <= cap))
    telling = stage(telling.select("to_key", F.monotonically_increasing_id().alias("t")))
    marked = links.join(telling, "to_key", "left").join(keys.select(F.col("key").alias("to_key"), F.col("key").alias("own")), "to_key", "left")
    citing = marked.groupBy(F.col("from_key").alias("key")).agg(F.count("*").alias("n"), F.collect_list("t").alias("ts"), F.collect_list("own").alias("cites"))  # a work's references
    cited = marked.where("own is not null").select(F.col("own").alias("key")).distinct().withColumn("cited", F.lit(True))
    both = citing.join(cited, "key", "full_outer").where((F.size("ts") > 0) | (F.size("cites") > 0) | F.col("cited"))
    return stage(both.select("key", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("ts", "array<long>"), ("cites", "array<string>")))))


def _direct_pairs(works: DataFrame) -> DataFrame:
    cites = works.select("key", F.explode("cites").alias("other"))
    return cites.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _listed(works: DataFrame) -> DataFrame:
    """(key, t, x): a row for each telling reference; the product of two works' x is what one shared reference weighs."""
    return works.select("key", F.explode("ts").alias("t"), (1 / F.sqrt("n")).alias("x"))


def coupling(edges: DataFrame, held: DataFrame, *, direct: float = 0.5, max_share: float = 0.5, width: int = 8192) -> DataFrame:
    """(a, b, w, direct): bibliographic coupling of held works, a < b.

    w is the number of works both cite over the root of the product of their numbers of references,
    plus `direct` if one cites the other. Works cited by one held work only, or by more than
    max(3, max_share of all citing works), say nothing and are left out before any pair is made.
    """
    return pairs_of(coupled(edges, held, max_share=max_share), direct=direct, width=width)


def pairs_of(works: DataFrame, *, direct: float = 0.5, width: int = 8192) -> DataFrame:
    """(a, b, w, direct) of `coupled` works.

    Where many works share references, works are cut into blocks of `width` at most, and each two
    blocks are multiplied in a task of their own: works move once for each block, pairs not at all.
    Where that would move more rows than there are pairs, the pairs are listed and counted instead.
    """
    listed = _listed(works)
    n, links = works.agg(F.count("*"), F.sum(F.size("ts"))).first()
    pairs = listed.groupBy("t").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    blocks = max(1, -(-n // min(width, max(512, -(-n // 6)))))
    if n and pairs > blocks * links:
        return _multiplied(works, blocks, direct)
    shared = block_pairs(listed, "t", "key").groupBy("a", "b").agg(F.count("*").alias("shared"))
    size = lambda k: works.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"))
    weighed = shared.join(size("a"), "a").join(size("b"), "b").select("a", "b", (F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))).alias("w"), F.lit(False).alias("direct"))
    if direct <= 0:
        return weighed
    both = weighed.unionByName(_direct_pairs(works).select("a", "b", F.lit(float(direct)).alias("w"), F.lit(True).alias("direct")))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"), F.bool_or("direct").alias("direct"))


def _multiplied(works: DataFrame, blocks: int, direct: float, rows: int = 65_536) -> DataFrame:
    """`pairs_of` by blocks: a task has the works of two blocks (or of one) and yields their pairs, `rows` or somewhat more at a time."""

    def multiply(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        key, block, n, ts, cites = (table.column(c).to_pylist() for c in ("key", "k", "n", "ts", "cites"))
        order = sorted(range(len(key)), key=key.__getitem__)
        names = pa.array([key[i] for i in order], pa.string())
        rank = {key[i]: r for r, i in enumerate(order)}
        n, block = np.array([n[i] for i in order], float), np.array([block[i] for i in order])
        ts, cites = [ts[i] for i in order], [cites[i] for i in order]
        own = block.min() == block.max()
        left, right = (np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()))
        at = np.full(len(order), -1)
        at[right] = np.arange(len(right))
        links = [(t, at[r]) for r in right for t in ts[r]]
        who, where = (np.array(c, np.int64) for c in zip(*links)) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        by = np.argsort(who, kind="stable")
        who, where = who[by], where[by]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
        citers = {int(who[s]): where[s:e] for s, e in zip(starts, [*starts[1:], len(who)])}
        met: dict[int, set[int]] = {}  # rank on the left: places on the right that it cites or is cited by
        if direct > 0:
            side = np.zeros(len(order), bool)
            side[left] = True
            for r, others in enumerate(cites):
                for o in others:
                    if (q := rank.get(o)) is not None:
                        for x, y in ((r, q), (q, r)):
                            if side[x] and at[y] >= 0:
                                met.setdefault(x, set()).add(int(at[y]))
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            a, b, w, d = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(a, b))), names.take(pa.array(np.maximum(a, b))), pa.array(w), pa.array(d)], ["a", "b", "w", "direct"])

        for a in left:
            found = [citers[t] for t in ts[a] if t in citers]
            count = np.bincount(np.concatenate(found), minlength=len(right)) if found else np.zeros(len(right), np.int64)
            cited = np.zeros(len(right), bool)
            cited[list(met.get(a, ()))] = True
            b = np.flatnonzero((count > 0) | cited)
            if own:
                b = b[right[b] > a]
            if not len(b):
                continue
            shared, cited = count[b], cited[b]
            w = np.divide(shared, np.sqrt(n[a] * n[right[b]]), out=np.zeros(len(b)), where=shared > 0)
            out.append((np.full(len(b), a), right[b], np.where(cited, w + direct, w), cited))
            held += len(b)
            if held >= rows:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    k = works.withColumn("k", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    met = k.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    x, y = F.least("k", "y"), F.greatest("k", "y")
    sent = met.select("key", "k", "n", "ts", "cites", (x * blocks - (x * (x - 1) / 2).cast("long") + y - x).cast("int").alias("task"))
    return sent.repartitionById(blocks * (blocks + 1) // 2, "task").mapInArrow(multiply, "a string, b string, w double, direct boolean")


def coupled_modularity(works: DataFrame, communities: DataFrame, *, direct: float = 0.5, resolution: float = 1.0) -> DataFrame:
    """`modularity` of `coupled` works without a list of pairs.

    What pairs weigh is a product of their works' shares in each reference, so all pairs between two
    communities that share a reference weigh the product of sums: the sums hold all that is needed.
    """
    placed = communities.select("key", "comm")
    rows = _listed(works).join(placed, "key").groupBy("t", "comm").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    rows = stage(rows)
    whole = rows.groupBy("t").agg(F.sum("s").alias("all"), F.sum("n").alias("of"))
    known = F.col("comm").isNotNull()
    shared = rows.join(whole, "t").where("of > 1").select(F.col("comm").alias("c"), (F.col("s") * F.col("all") - F.col("q")).alias("tot"), F.when(known & (F.col("n") > 1), (F.col("s") * F.col("s") - F.col("q")) / 2).otherwise(0.0).alias("inside"))
    per = shared
    if direct > 0:
        comm = lambda k: placed.select(F.col("key").alias(k), F.col("comm").alias(f"c{k}"))
        p = _direct_pairs(works).join(comm("a"), "a").join(comm("b"), "b").withColumn("w", F.lit(float(direct)))
        per = per.unionByName(p.select(F.col("ca").alias("c"), F.col("w").alias("tot"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside"))).unionByName(p.select(F.col("cb").alias("c"), F.col("w").alias("tot"), F.lit(0.0).alias("inside")))
    return _modularity(per.groupBy("c").agg(F.sum("tot").alias("tot"), F.sum("inside").alias("inside")), resolution)


def modularity(pairs: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity, communities): of the partition (key, comm) over weighted pairs."""
    comm = lambda k: communities.select(F.col("key").alias(k), F.col("comm").alias(f"c{k}"))
    p = pairs.join(comm("a"), "a").join(comm("b"), "b")
    ends = p.select(F.col("ca").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside")).unionByName(p.select(F.col("cb").alias("c"), "w", F.lit(0.0).alias("inside")))
    return _modularity(ends.groupBy("c").agg(F.sum("w").alias("tot"), F.sum("inside").alias("inside")), resolution)


def _modularity(per: DataFrame, resolution: float) -> DataFrame:
    # With sums over communities of tot, inside and tot squared the total weight factors out.
    sums = per.agg(F.sum("tot").alias("two_m"), F.sum("inside").alias("inside"), F.sum(F.col("tot") * F.col("tot")).alias("squares"), F.count("*").alias("communities"))
    q = F.col("inside") / (F.col("two_m") / 2) - resolution * F.col("squares") / (F.col("two_m") * F.col("two_m"))
    return sums.select(F.coalesce(q, F.lit(0.0)).alias("modularity"), "communities")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(key, root): connected components by large-star and small-star steps, each a table in the shared folder."""
    stars = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = stage(small.where("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _move(adj: list[dict[int, float]], loops: np.ndarray, two_m: float, resolution: float) -> np.ndarray:
    """One level of local moving, nodes and candidate communities in ascending order, until none gains by moving; each move raises the modularity, so that ends."""
    n = len(adj)
    of = np.arange(n)
    degree = np.array([sum(x.values()) for x in adj]) + loops
    total = degree.copy()
    while True:
        moved = False
        for i in range(n):
            near: dict[int, float] = {}
            for j, w in adj[i].items():
                near[of[j]] = near.get(of[j], 0.0) + w
            own = of[i]
            total[own] -= degree[i]
            gain = lambda c: near.get(c, 0.0) - resolution * total[c] * degree[i] / two_m  # noqa: E731, B023
            best, most = own, gain(own)
            for c in sorted(near):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            total[best] += degree[i]
            if best != own:
                of[i], moved = best, True
        if not moved:
            break
    first: dict[int, int] = {}
    return np.array([first.setdefault(c, len(first)) for c in of])


def louvain_local(pairs: pd.DataFrame, two_m: float, resolution: float = 1.0) -> pd.DataFrame:
    """Louvain communities of one component (a, b, w): (key, comm), comm a number within the component."""
    keys = sorted(set(pairs["a"]) | set(pairs["b"]))
    at = {k: i for i, k in enumerate(keys)}
    adj: list[dict[int, float]] = [{} for _ in keys]
    for a, b, w in zip(pairs["a"].map(at), pairs["b"].map(at), pairs["w"]):
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    of, loops = np.arange(len(keys)), np.zeros(len(keys))
    while True:
        level = _move(adj, loops, two_m, resolution)
        n = int(level.max()) + 1 if len(level) else 0
        of = level[of]
        if n == len(adj):
            break
        merged: list[dict[int, float]] = [{} for _ in range(n)]
        held = np.zeros(n)
        for i, row in enumerate(adj):
            held[level[i]] += loops[i]
            for j, w in row.items():
                if level[i] == level[j]:
                    held[level[i]] += w
                else:
                    merged[level[i]][level[j]] = merged[level[i]].get(level[j], 0.0) + w
        adj, loops = merged, held
    return pd.DataFrame({"key": keys, "comm": of})


def louvain(pairs: DataFrame, *, resolution: float = 1.0, largest: int = 2_000_000) -> DataFrame:
    """(key, comm): communities, comm being the least key of each.

    A work only ever joins a community next to it, and gains depend on the rest only by the total
    weight, so components are independent: each is one group, moved in ascending order of its keys. A
    component of more than `largest` pairs is no group for one task; it is moved by joins instead
    (`louvain_parallel`): the same gain, and levels until nothing changes, but another order of moves.
    """
    two_m = 2 * (pairs.agg(F.sum("w")).first()[0] or 0.0)
    rooted = stage(pairs.join(components(pairs), F.col("a") == F.col("key")).select("a", "b", "w", "root"))
    huge = rooted.groupBy("root").count().where(F.col("count") > largest).select("root")
    usual = rooted.join(huge, "root", "left_anti")
    schema = "key string, comm string"

    def each(group: pd.DataFrame) -> pd.DataFrame:
        out = louvain_local(group, two_m, resolution)
        return out.assign(comm=out.groupby("comm")["key"].transform("min"))

    local = usual.groupBy("root").applyInPandas(each, schema)
    if huge.isEmpty():
        return local
    return local.unionByName(louvain_parallel(rooted.join(huge, "root", "left_semi").select("a", "b", "w"), two_m, resolution))


def louvain_coupled(works: DataFrame, *, direct: float = 0.5, resolution: float = 1.0, largest: int = 4_000_000) -> DataFrame:
    """As `louvain`, of `coupled` works without a list of pairs.

    What a work gains by joining a community depends on the community's sums of shares in the work's
    references, so a component is moved with memory in proportion to its references. One of more than
    `largest` references is no group for one task and is moved in rounds (`louvain_rounds`); if those that
    cite the most cited work alone are that many, all components are, and none is looked for.
    """
    links = stage(_listed(works))
    pairs = _direct_pairs(works) if direct > 0 else links.where("false").select(F.col("key").alias("a"), F.col("key").alias("b"))
    per = links.groupBy("t").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("c"))
    sums = per.agg(F.sum(F.col("s") * F.col("s") - F.col("q")), F.max_by("t", F.struct("c", "t"))).first()
    two_m = (sums[0] or 0.0) + 2 * max(direct, 0.0) * pairs.count()
    if sums[1] is not None and (works.where(F.array_contains("ts", sums[1])).agg(F.sum(F.size("ts") + F.size("cites"))).first()[0] or 0) > largest:
        return louvain_rounds(works, two_m, direct, resolution, largest=largest)
    roots = components(links.select(F.col("key").alias("a"), F.concat(F.lit("\0"), F.col("t").cast("string")).alias("b")).unionByName(pairs))
    rooted = stage(works.join(roots, "key"))
    huge = rooted.groupBy("root").agg(F.sum(F.size("ts") + F.size("cites")).alias("n")).where(F.col("n") > largest).select("root")
    schema = "key string, comm string"

    def each(group: pd.DataFrame) -> pd.DataFrame:
        out = louvain_shared(group, two_m, direct, resolution)
        return out.assign(comm=out.groupby("comm")["key"].transform("min"))

    local = rooted.join(huge, "root", "left_anti").select("root", "key", "n", "ts", "cites").groupBy("root").applyInPandas(each, schema)
    if huge.isEmpty():
        return local
    return local.unionByName(louvain_rounds(rooted.join(huge, "root", "left_semi").drop("root"), two_m, direct, resolution, largest=largest))


class _Level:
    """Nodes of one level: shares in references, as dicts or, for references of many, as rows of a matrix; weights of direct links; weight within."""

    def __init__(self, shares: list[dict[int, float]], crowded: np.ndarray, adj: list[dict[int, float]], loops: np.ndarray):
        self.shares, self.crowded, self.adj, self.loops = shares, crowded, adj, loops  # crowded: (nodes, crowded references)
        whole: dict[int, float] = {}
        for row in shares:
            for t, s in row.items():
                whole[t] = whole.get(t, 0.0) + s
        self.degree = loops + np.array([sum(s * (whole[t] - s) for t, s in row.items()) + sum(near.values()) for row, near in zip(shares, adj)])
        self.degree += (crowded * (crowded.sum(axis=0) - crowded)).sum(axis=1)

    def merged(self, level: np.ndarray) -> _Level:
        n = int(level.max()) + 1
        shares: list[dict[int, float]] = [{} for _ in range(n)]
        adj: list[dict[int, float]] = [{} for _ in range(n)]
        loops, crowded = np.zeros(n), np.zeros((n, self.crowded.shape[1]))
        np.add.at(crowded, level, self.crowded)
        squares = np.zeros(n)  # what members share with themselves
        np.add.at(squares, level, (self.crowded * self.crowded).sum(axis=1))
        np.add.at(loops, level, self.loops)
        for i, (row, near) in enumerate(zip(self.shares, self.adj)):
            c = level[i]
            for t, s in row.items():
                shares[c][t] = shares[c].get(t, 0.0) + s
                squares[c] += s * s
            for j, w in near.items():
                if level[j] == c:
                    loops[c] += w
                else:
                    adj[c][level[j]] = adj[c].get(level[j], 0.0) + w
        loops += (crowded * crowded).sum(axis=1) + np.array([sum(s * s for s in row.values()) for row in shares]) - squares
        return _Level(shares, crowded, adj, loops)


def _move_shared(level: _Level, two_m: float, resolution: float) -> np.ndarray:
    """`_move` over shares. Communities with a crowded reference are weighed all at once, in a vector of the communities that are left."""
    n, degree = len(level.shares), level.degree
    of, members = np.arange(n), np.ones(n, np.int64)
    sums: dict[int, dict[int, float]] = {}  # by reference: communities' shares
    for i, row in enumerate(level.shares):
        for t, s in row.items():
            sums.setdefault(t, {})[i] = s
    slot, at = np.arange(n), np.arange(n)  # a community's place among those left, and the reverse
    total, held = degree.copy(), np.ascontiguousarray(level.crowded.T)  # by place
    cites = [np.flatnonzero(row) for row in level.crowded]
    gains, part = np.empty(n), np.empty(n)
    empty = 0
    while True:
        moved = False
        for i in range(n):
            own, shares, adj, mine = int(of[i]), level.shares[i], level.adj[i], cites[i]
            pull, k = resolution * degree[i] / two_m, slot[own]
            total[k] -= degree[i]
            near: dict[int, float] = {}
            for t, s in shares.items():
                here = sums[t]
                left = here[own] - s
                if left > 1e-9:
                    here[own] = left
                else:
                    del here[own]
                for c, v in here.items():
                    near[c] = near.get(c, 0.0) + s * v
            for j, w in adj.items():
                c = int(of[j])
                near[c] = near.get(c, 0.0) + w
            crowd = level.crowded[i]
            if len(mine):
                held[mine, k] -= crowd[mine]
                size = len(at)
                g, p = gains[:size], part[:size]
                np.multiply(held[mine[0]], crowd[mine[0]], out=g)
                for h in mine[1:]:
                    np.multiply(held[h], crowd[h], out=p)
                    g += p
                for c, v in near.items():
                    g[slot[c]] += v
                stay = (g[k] if members[own] > 1 else 0.0) - pull * total[k]
                np.multiply(total, pull, out=p)
                p -= g
                b = int(p.argmin())
                if g[b] <= 1e-9:  # no neighbour
                    p[g <= 1e-9] = np.inf
                    b = int(p.argmin())
                best = int(at[b]) if -p[b] > stay + 1e-12 else own
            else:
                best, most = own, near.get(own, 0.0) - pull * total[k]
                for c in sorted(near):
                    if (gain := near[c] - pull * total[slot[c]]) > most + 1e-12:
                        best, most = c, gain
            b = slot[best]
            total[b] += degree[i]
            if len(mine):
                held[mine, b] += crowd[mine]
            for t, s in shares.items():
                sums[t][best] = sums[t].get(best, 0.0) + s
            if best != own:
                of[i], moved = best, True
                members[own] -= 1
                members[best] += 1
                if not members[own]:
                    empty += 1
                    if empty * 16 > len(at):
                        kept = members[at] > 0
                        at, total, held, empty = at[kept], total[kept], np.ascontiguousarray(held[:, kept]), 0
                        slot[at] = np.arange(len(at))
        if not moved:
            break
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(c), len(first)) for c in of])


def louvain_shared(works: pd.DataFrame, two_m: float, direct: float, resolution: float = 1.0) -> pd.DataFrame:
    """`louvain_local` of one component of `coupled` works (key, n, ts, cites)."""
    works = works.sort_values("key")
    keys = works["key"].tolist()
    rank, x = {k: i for i, k in enumerate(keys)}, 1 / np.sqrt(np.maximum(works["n"].to_numpy(float), 1))
    adj: list[dict[int, float]] = [{} for _ in keys]
    count: dict[int, int] = {}
    for i, (ts, others) in enumerate(zip(works["ts"], works["cites"])):
        for t in ts:
            count[t] = count.get(t, 0) + 1
        for o in others if direct > 0 else ():
            adj[i][rank[o]] = adj[rank[o]][i] = direct
    many = {t: h for h, t in enumerate(t for t, c in count.items() if c > max(256, len(keys) / 16))}  # few: a work has few references
    crowded = np.zeros((len(keys), len(many)))
    shares: list[dict[int, float]] = [{} for _ in keys]
    for i, ts in enumerate(works["ts"]):
        for t in ts:
            if t in many:
                crowded[i, many[t]] = x[i]
            else:
                shares[i][t] = x[i]
    return pd.DataFrame({"key": keys, "comm": _moved_up(_Level(shares, crowded, adj, np.zeros(len(keys))), two_m, resolution)})


def _moved_up(level: _Level, two_m: float, resolution: float) -> np.ndarray:
    of = np.arange(len(level.shares))
    while True:
        moved = _move_shared(level, two_m, resolution)
        of = moved[of]
        if int(moved.max()) + 1 == len(moved):
            return of
        level = level.merged(moved)


#: References that are dealt with as sums only where a component is moved in rounds: the most cited ones, of more works than this.
HUBS, CROWD = 6, 256


def _front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that have the most p*a - q*b for some p > 0, q >= 0, besides those that do when one of these is left out."""
    left, out = np.flatnonzero(a > 0), []
    order = left[np.lexsort((-a[left], b[left]))]
    for _ in range(2):
        best = np.maximum.accumulate(a[order])
        steps = order[np.r_[True, a[order][1:] > best[:-1]]] if len(order) else order
        hull: list[int] = []
        for c in steps.tolist():
            while len(hull) > 1 and (a[hull[-1]] - a[hull[-2]]) * (b[c] - b[hull[-1]]) <= (a[c] - a[hull[-1]]) * (b[hull[-1]] - b[hull[-2]]):
                hull.pop()
            hull.append(c)
        out += hull
        order = order[~np.isin(order, hull)]
    return np.array(out, np.int64)


class _Places:
    """Where works are in a round: communities' degrees and shares in the hubs. n: a work's references; mask: a bit for each hub it cites.

    A community bears the number of its least work. Those of one work have no entries of their own."""

    def __init__(self, comm: np.ndarray, n: np.ndarray, mask: np.ndarray, degree: np.ndarray, hubs: int):
        self.comm, self.n, self.mask, self.degree, self.hubs = comm, n, mask, degree, hubs
        large = np.flatnonzero(np.bincount(comm, minlength=len(comm)) > 1)
        self.large, self.slot = large, np.full(len(comm), -1, np.int32)
        self.slot[large] = np.arange(len(large), dtype=np.int32)
        i = np.flatnonzero(self.slot[comm] >= 0)
        at = self.slot[comm[i]]
        self.totals = np.r_[np.bincount(at, degree[i], len(large)), 0.0]
        x, mask = 1 / np.sqrt(n[i]), mask[i]
        self.shares = [np.r_[np.bincount(at, np.where(mask >> h & 1, x, 0), len(large)), 0.0] for h in range(hubs)]
        self.bits = np.array([m.bit_count() for m in range(1 << hubs)])
        self.by_mask = np.array([sum((self.shares[h] for h in range(hubs) if m >> h & 1), np.zeros(len(large) + 1)) for m in range(1 << hubs)]).ravel() if len(large) < 1 << 14 else None

    def total(self, c: np.ndarray) -> np.ndarray:
        at = self.slot[c]
        return np.where(at < 0, self.degree[c], self.totals[at])

    def drawn(self, mask: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The communities' shares in the hubs of the masks."""
        at = self.slot[c]
        if self.by_mask is not None:
            out = self.by_mask[mask.astype(np.int64) * len(self.totals) + at % len(self.totals)]
        else:
            out = sum(((mask >> h & 1) * self.shares[h][at] for h in range(self.hubs)), np.zeros(len(c)))
        one = np.flatnonzero(at < 0)
        out[one] = self.bits[mask[one] & self.mask[c[one]]] / np.sqrt(self.n[c[one]])
        return out

    def share(self, h: int, c: np.ndarray) -> np.ndarray:
        at = self.slot[c]
        return np.where(at < 0, (self.mask[c] >> h & 1) / np.sqrt(self.n[c]), self.shares[h][at])

    def fronts(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By mask the communities that a work's hubs can draw it to, with their shares in those and their degrees."""
        one = np.flatnonzero((self.slot[self.comm] < 0) & (self.mask > 0))
        kind = self.n[one].astype(np.int64) << 8 | self.mask[one]
        order = np.lexsort((self.degree[one], kind))
        one, kind = one[order], kind[order]
        one = one[np.r_[True, True, kind[2:] != kind[:-2]][: len(one)]]  # of works alike in their hubs the two of the least degree
        c = np.r_[self.large, one]
        shares, total, out = [self.share(h, c) for h in range(self.hubs)], self.total(c), {}
        for m in np.unique(self.mask[self.mask > 0]).tolist():
            a = sum(shares[h] for h in range(self.hubs) if m >> h & 1)
            front = _front(a, total)
            out[m] = c[front], a[front], total[front]
        return out

    def height(self, two_m: float, resolution: float) -> float:
        """What moves change of the modularity, times two_m, but for what works have in common with their communities' others beside hubs."""
        one = np.flatnonzero(self.slot[self.comm] < 0)
        squares = sum(float((s * s).sum()) for s in self.shares) + sum(float((1 / self.n[one[self.mask[one] >> h & 1 > 0]]).sum()) for h in range(self.hubs))
        return squares - resolution * (float((self.totals * self.totals).sum()) + float((self.degree[one] ** 2).sum())) / two_m


def _near(batch, n: np.ndarray, comm: np.ndarray, direct: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Works (id, js, ds) -> their numbers; (place in the batch, community, weight) of those they have references in common with, hubs aside, or links to."""
    i, parts = batch.column(0).to_numpy(), []
    for name, weight in (("js", None), ("ds", direct)):
        lists = batch.column(batch.schema.get_field_index(name))
        at, j = np.repeat(np.arange(len(i)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        other = j != i[at]
        at, j = at[other], j[other]
        parts.append((at, j, 1 / np.sqrt(n[i[at]].astype(float) * n[j]) if weight is None else np.full(len(at), weight)))
    at, j, w = (np.concatenate(p) for p in zip(*parts))
    code = at * len(comm) + comm[j]
    order = np.argsort(code)
    code, w = code[order], w[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return i, code[first] // len(comm), code[first] % len(comm), np.add.reduceat(w, first) if len(first) else np.zeros(0)


def _wanted(batch, p: _Places, fronts: dict, direct: float, two_m: float, resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(works that gain by moving, where to, -1 for a community of its own, what they gain; what works have in common with their communities' others)."""
    i, at, c, w = _near(batch, p.n, p.comm, direct)
    own, x, mask, degree = p.comm[i], 1 / np.sqrt(p.n[i]), p.mask[i], p.degree[i]
    pull = resolution * degree / two_m
    here = c == own[at]
    stay = np.zeros(len(i))
    stay[at[here]] = w[here]
    inside = float(stay.sum())
    stay += x * (p.drawn(mask, own) - p.bits[mask] * x)
    w = w + x[at] * p.drawn(mask[at], c)
    stay -= pull * (p.total(own) - degree)
    stay[p.slot[own] < 0] = 0.0
    best, most = own.astype(np.int64), stay.copy()
    alone = most < 0
    best[alone], most[alone] = -1, 0.0
    at, c, gain = at[~here], c[~here], (w - pull[at] * p.total(c))[~here]
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        top = np.maximum.reduceat(gain, first)
        where = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(at)])))
        where = where[np.r_[True, at[where][1:] != at[where][:-1]]]
        more = gain[where] > most[at[where]]
        best[at[where[more]]], most[at[where[more]]] = c[where[more]], gain[where[more]]
    for m in np.unique(mask[mask > 0]).tolist():
        front, a, b = fronts[m]
        rows = np.flatnonzero(mask == m)
        gains = x[rows, None] * a - pull[rows, None] * b
        gains[own[rows, None] == front] = -np.inf
        k = gains.argmax(axis=1)
        top = gains[np.arange(len(rows)), k]
        more = top > most[rows]
        best[rows[more]], most[rows[more]] = front[k[more]], top[more]
    moves = most > stay + 1e-9
    return i[moves], best[moves], (most - stay)[moves], inside


def louvain_rounds(works: DataFrame, two_m: float, direct: float, resolution: float = 1.0, *, largest: int = 4_000_000, parts: int = 8) -> DataFrame:
    """As `louvain`, of `coupled` works of components too large for a task, without their pairs.

    Works are numbered, and each lists those with which it has references in common, but for the `HUBS` most
    cited ones. What those add is a product of sums; the communities that they can draw a work to are corners of a hull,
    for each combination of hubs. In a round each task finds what its works gain, and a hashed part of those that would gain is moved, all at once.
    A round that lowers the modularity is taken back and half as many are moved. When no work gains, communities become nodes and go on in one task,
    or by joins if that has more than `largest` links. The driver and each task hold some numbers of each work.
    """
    spark = works.sparkSession
    cores = max(2, spark.sparkContext.defaultParallelism)
    ranked = stage(works.select("key").repartitionByRange(4 * cores, "key").sortWithinPartitions("key").select("key", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    start, starts = 0, []
    for p, n in sorted(ranked.groupBy("p").count().collect()):
        starts += [F.lit(p), F.lit(start)]
        start += n
    ranked = ranked.select("key", (F.create_map(*starts)[F.col("p")] + F.col("k")).cast("int").alias("id"))
    works = stage(works.join(ranked, "key").select("id", "key", "n", "ts", "cites"))
    crowds = works.select(F.explode("ts").alias("t")).groupBy("t").count().where(F.col("count") > CROWD).orderBy(F.desc("count"), "t").limit(HUBS).collect()
    hubs = F.array(*(F.lit(r[0]).cast("long") for r in crowds)).cast("array<long>")
    citers = works.select("id", F.explode(F.array_except("ts", hubs)).alias("t")).groupBy("t").agg(F.collect_list("id").alias("js")).where("size(js) > 1")
    links = citers.select(F.explode("js").alias("id"), "js", F.array().cast("array<int>").alias("ds"))
    if direct > 0:
        cites = works.select(F.col("id").alias("a"), F.explode("cites").alias("key")).join(ranked.select("key", F.col("id").alias("b")), "key").select("a", "b")
        both = cites.unionByName(cites.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("ds"))
        links = links.unionByName(both.select(F.col("a").alias("id"), F.array().cast("array<int>").alias("js"), "ds"))
    every = links.unionByName(works.select("id", *(F.array().cast("array<int>").alias(c) for c in ("js", "ds"))))
    listed = stage(every.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("js", "ds"))))
    rows = works.select("id", F.col("n").cast("int"), sum((F.array_contains("ts", r[0]).cast("int") * (1 << h) for h, r in enumerate(crowds)), F.lit(0)).alias("mask")).toArrow()
    at = rows["id"].to_numpy()
    n, mask = np.ones(start, np.int32), np.zeros(start, np.uint8)
    n[at], mask[at] = np.maximum(rows["n"].to_numpy(), 1), rows["mask"].to_numpy()
    count = len(crowds)
    whole = [float((1 / np.sqrt(n[mask >> h & 1 > 0])).sum()) for h in range(count)]
    base = spark.sparkContext.broadcast((n, mask))
    del rows, at, n, mask

    def degrees(batches):
        n, mask = base.value
        nowhere = np.zeros(len(n), np.int8)
        for batch in batches:
            i, at, _, w = _near(batch, n, nowhere, direct)
            x, d = 1 / np.sqrt(n[i]), np.bincount(at, w, len(i))
            for h in range(count):
                d += (mask[i] >> h & 1) * x * (whole[h] - x)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(d)], ["id", "d"])

    found = listed.mapInArrow(degrees, "id int, d double").toArrow()
    degree = np.zeros(start)
    degree[found["id"].to_numpy()] = found["d"].to_numpy()
    weighed = spark.sparkContext.broadcast(degree)
    del found, degree

    def round_of(comm: np.ndarray):
        sent = spark.sparkContext.broadcast(comm)

        def survey(batches):
            p = _Places(sent.value, *base.value, weighed.value, count)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((p.height(two_m, resolution), p.fronts()))])], ["seen"])

        rest, fronts = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(survey, "seen binary").first()[0])

        def look(batches):
            p, inside = _Places(sent.value, *base.value, weighed.value, count), 0.0
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    i, to, gain, near = _wanted(batch.slice(k, 4096), p, fronts, direct, two_m, resolution)
                    inside += near
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(gain)], ["id", "next", "gain"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([inside])], ["id", "next", "gain"])

        out = listed.coalesce(cores).mapInArrow(look, "id int, next int, gain double").toArrow()
        sent.destroy()
        i, to, gain = (out[c].to_numpy() for c in ("id", "next", "gain"))
        return rest + float(gain[i < 0].sum()), i[i >= 0], to[i >= 0], gain[i >= 0]

    comm, r = np.arange(start, dtype=np.int32), 0
    now, i, to, gain = round_of(comm)
    while len(i):
        alone = parts > 2 * len(i)
        moved = np.lexsort((i, -gain))[:1] if alone else np.flatnonzero(_scatter(i, r) % np.uint64(parts) == 0)
        r += 1
        if not len(moved):
            continue
        after = comm.copy()
        after[i[moved]] = np.where(to[moved] < 0, start + i[moved], to[moved])
        least = np.full(2 * start, start, np.int32)
        np.minimum.at(least, after, np.arange(start, dtype=np.int32))
        after = least[after]
        then, *wanted = round_of(after)
        if then > now + 1e-12:
            comm, now, parts = after, then, max(2, parts // 2)
            i, to, gain = wanted
        elif alone:
            break  # what it would gain is lost in rounding
        else:
            parts *= 2
    least = np.flatnonzero(comm == np.arange(start))
    m, rank = len(least), np.zeros(start, np.int32)
    rank[least] = np.arange(m, dtype=np.int32)
    level, (n, mask) = rank[comm], base.value
    crowded = np.array([np.bincount(level, (mask >> h & 1) / np.sqrt(n), m) for h in range(count)]).reshape(count, m).T
    loops = (crowded * crowded).sum(axis=1)
    for h in range(count):
        loops -= np.bincount(level, (mask >> h & 1) / n, m)
    sent = spark.sparkContext.broadcast(level)

    def contract(batches):
        (n, _), level = base.value, sent.value
        for batch in batches:
            i, at, c, w = _near(batch, n, level, direct)
            code, back = np.unique(level[i[at]].astype(np.int64) * m + c, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // m), pa.array(code % m), pa.array(np.bincount(back, w, len(code)))], ["x", "y", "w"])

    merged = stage(listed.mapInArrow(contract, "x long, y long, w double").groupBy("x", "y").agg(F.sum("w").alias("w")))
    if merged.count() <= largest:
        shares = spark.sparkContext.broadcast((crowded, loops))

        def finish(batches):
            crowded, loops = shares.value
            loops = loops.copy()
            adj: list[dict[int, float]] = [{} for _ in range(m)]
            for batch in batches:
                for a, b, w in zip(*(c.to_pylist() for c in batch.columns)):
                    if a == b:
                        loops[a] += w
                    else:
                        adj[a][b] = w
            of = _moved_up(_Level([{} for _ in range(m)], crowded, adj, loops), two_m, resolution)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(of.astype(np.int64))], ["at", "comm"])

        done = merged.repartition(1).sortWithinPartitions("x", "y").mapInArrow(finish, "at long, comm long").toArrow()
    else:
        frame = lambda **columns: spark.createDataFrame(pa.table(columns))
        h, c = np.nonzero(crowded.T)
        hub = frame(h=h, c=c, s=crowded[c, h])
        drawn = hub.join(hub.select("h", F.col("c").alias("d"), F.col("s").alias("z")), "h").where("c < d").select(F.col("c").alias("a"), F.col("d").alias("b"), (F.col("s") * F.col("z")).alias("w"))
        pairs = merged.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "w").unionByName(drawn)
        within = frame(key=np.arange(m), loop=loops).unionByName(merged.where("x = y").select(F.col("x").alias("key"), F.col("w").alias("loop"))).groupBy("key").agg(F.sum("loop").alias("loop"))
        done = louvain_parallel(pairs, two_m, resolution, loops=within).select(F.col("key").alias("at"), "comm").toArrow()
    top = np.empty(m, np.int64)
    top[done["at"].to_numpy()] = done["comm"].to_numpy()
    label = np.full(max(m, top.max() + 1), start)
    np.minimum.at(label, top, least)
    label = spark.sparkContext.broadcast(label[top[level]].astype(np.int32))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label.value[batch.column(0).to_numpy()])], ["id", "key", "at"])

    placed = stage(works.select("id", "key").mapInArrow(place, "id int, key string, at int"))
    return placed.select("key", "at").join(placed.where("id = at").select("at", F.col("key").alias("comm")), "at").select("key", "comm")


def _scatter(i: np.ndarray, r: int) -> np.ndarray:
    h = (i.astype(np.uint64) + np.uint64(r << 32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def louvain_parallel(pairs: DataFrame, two_m: float, resolution: float = 1.0, *, loops: DataFrame | None = None) -> DataFrame:
    """As `louvain`, by joins: the nodes move until none gains by it, then each community becomes a node, level by level until nothing changes.

    loops: (key, loop) of all nodes, where they have weight within."""
    of = None
    nodes = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().withColumn("loop", F.lit(0.0)) if loops is None else loops)
    pairs = stage(pairs.groupBy("a", "b").agg(F.sum("w").alias("w")))
    while True:
        both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        level = _move_parallel(both, nodes, two_m, resolution)
        of = level if of is None else stage(of.select("key", F.col("comm").alias("_at")).join(level.select(F.col("key").alias("_at"), "comm"), "_at").select("key", "comm"))
        if level.where("key <> comm").isEmpty():
            break
        comm = lambda c, k: level.select(F.col("key").alias(c), F.col("comm").alias(k))
        ends = stage(both.join(comm("a", "x"), "a").join(comm("b", "y"), "b").groupBy("x", "y").agg(F.sum("w").alias("w")))
        pairs = stage(ends.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
        inside = nodes.join(level, "key").select("comm", "loop").unionByName(ends.where("x = y").select(F.col("x").alias("comm"), F.col("w").alias("loop")))
        nodes = stage(inside.groupBy(F.col("comm").alias("key")).agg(F.sum("loop").alias("loop")))
    label = of.groupBy("comm").agg(F.min("key").alias("label"))
    return of.join(label, "comm").select("key", F.col("label").alias("comm"))


def _move_parallel(both: DataFrame, nodes: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """One level of local moving: (key, comm), comm a node of the community.

    A round moves, all at once, a hashed part of the nodes that would gain, a half at first. If that
    lowers the modularity (neighbours swapped), it is taken back and half as many move; a single node,
    the one that gains most, always raises it. The level ends when no node would gain.
    """
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    state = stage(nodes.join(degree, F.col("key") == F.col("a"), "left").select("key", (F.coalesce("d", F.lit(0.0)) + F.col("loop")).alias("d"), F.col("key").alias("comm")))

    def height(state: DataFrame) -> float:
        """What moves change of the modularity, times two_m."""
        comm = lambda c, k: state.select(F.col("key").alias(c), F.col("comm").alias(k))
        inside = both.join(comm("a", "x"), "a").join(comm("b", "y"), "b").where("x = y").agg(F.sum("w")).first()[0] or 0.0
        return inside - resolution * (state.groupBy("comm").agg(F.sum("d").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0) / two_m

    now, parts, r, wanted = height(state), 2, 0, None
    while True:
        if wanted is None:
            total = state.groupBy("comm").agg(F.sum("d").alias("t"))
            near = both.join(state.select(F.col("key").alias("b"), "comm"), "b").groupBy("a", "comm").agg(F.sum("w").alias("w"))
            own = state.select(F.col("key").alias("a"), F.col("comm").alias("own"), "d")
            options = near.unionByName(own.select("a", F.col("own").alias("comm"), F.lit(0.0).alias("w"))).groupBy("a", "comm").agg(F.sum("w").alias("w")).join(own, "a").join(total, "comm")
            rest = F.col("t") - F.when(F.col("comm") == F.col("own"), F.col("d")).otherwise(0.0)
            scored = options.select("a", "comm", (F.col("comm") == F.col("own")).alias("stays"), (F.col("w") - resolution * rest * F.col("d") / two_m).alias("gain"))
            best = scored.groupBy("a").agg(F.max_by("comm", F.struct("gain", "comm")).alias("next"), F.max("gain").alias("most"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"))
            wanted = stage(best.where(F.col("most") > F.col("stay") + 1e-9).select("a", "next", (F.col("most") - F.col("stay")).alias("gain")))
            n = wanted.count()
        if not n:
            return state.select("key", "comm")
        alone = parts > 2 * n
        movers = wanted.orderBy(F.desc("gain"), "a").limit(1) if alone else wanted.where(F.pmod(F.xxhash64("a", F.lit(r)), F.lit(parts)) == 0)
        after = stage(state.join(movers.select(F.col("a").alias("key"), "next"), "key", "left").select("key", "d", F.coalesce("next", "comm").alias("comm")))
        r += 1
        then = height(after)
        if then > now + 1e-12:
            state, now, parts, wanted = after, then, max(2, parts // 2), None
        elif alone:
            return state.select("key", "comm")  # what it would gain is lost in rounding
        else:
            parts *= 2


def term_scores(communities: DataFrame, titles: DataFrame) -> DataFrame:
    """(comm, term, n, df, size, score): how well a title's term names a community."""
    docs = communities.join(titles.select("key", "title"), "key", "left")
    terms = docs.select("comm", F.explode(ids.title_terms(F.col("title"), TITLE_STOP)).alias("term"))
    size = docs.groupBy("comm").agg(F.count("*").alias("size"))
    n_docs = F.lit(communities.count())
    tf = terms.groupBy("comm", "term").agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    out = tf.join(df, "term").join(size, "comm").withColumn("docs", n_docs)
    out = out.where(F.col("n") >= F.when(F.col("size") >= 4, 2).otherwise(1))
    return out.select("comm", "term", "n", "df", "size", (F.col("n") / F.col("size") * F.log(1 + F.col("docs") / F.col("df"))).alias("score"))


def name_communities(communities: DataFrame, titles: DataFrame, *, terms: int = LABEL_TERMS) -> DataFrame:
    """(comm, label, size): a name of the best terms that share no word; names are distinct.

    A term is picked, the terms that share a word with it are left out, and the next best is picked. Of
    communities with one name the largest keeps it, the second adds its best term left, the third its
    second best and so on; names that are then still shared are numbered.
    """
    order = F.struct((-F.round("score", 12)).alias("s"), (-F.size(F.split("term", " "))).alias("w"), "term")
    scored = stage(term_scores(communities, titles).select("comm", "term", order.alias("o")))
    left, picks = scored, []
    for k in range(terms):
        best = stage(left.groupBy("comm").agg(F.min_by("term", "o").alias("pick")))
        picks.append(best.withColumn("k", F.lit(k)))
        left = left.join(best, "comm").where(~F.arrays_overlap(F.split("term", " "), F.split("pick", " "))).drop("pick")
    picked = stage(reduce(DataFrame.unionByName, picks))
    names = picked.groupBy("comm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "pick"))), lambda x: x["pick"]), SEPARATOR).alias("label"))  # `terms` at most
    size = communities.groupBy("comm").agg(F.count("*").alias("size"))
    named = size.join(names, "comm", "left").withColumn("label", F.coalesce("label", F.lit("cluster")))
    named = stage(named.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "comm"))))
    twins = named.where("i > 1").select("comm", (F.col("i") - 1).alias("n"))
    spare = scored.join(twins.select("comm"), "comm", "left_semi").join(picked.select("comm", F.col("pick").alias("term")), ["comm", "term"], "left_anti")
    spare = spare.withColumn("n", F.row_number().over(Window.partitionBy("comm").orderBy("o"))).join(twins, ["comm", "n"]).select("comm", F.col("term").alias("spare"))
    named = named.join(spare, "comm", "left").withColumn("label", F.concat_ws(SEPARATOR, "label", "spare"))
    named = named.withColumn("j", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "comm")))
    return named.select("comm", F.when(F.col("j") > 1, F.concat("label", F.lit(" ("), F.col("j"), F.lit(")"))).otherwise(F.col("label")).alias("label"), "size")


def clusters(edges: DataFrame, items: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """(key, comm, label): held works placed in named subfields; works without any coupling are in none."""
    communities = stage(louvain_coupled(coupled(edges, items), resolution=resolution))
    return communities.join(name_communities(communities, items).select("comm", "label"), "comm").select("key", "comm", "label")


def gaps(edges: DataFrame, nodes: DataFrame, *, least: int = LEAST_GAP, limit: int | None = GAP_LIMIT) -> DataFrame:
    """(key, cited_by, cited_by_global, score, total): works cited but not held, by score.

    `nodes` is (key, cited_by_global, gone). Citing works are counted once; works that are gone are
    skipped; total is the number of gaps before `limit`.
    """
    cites = edges.where(ids.is_external(F.col("to_key")) & (F.col("from_key") != F.col("to_key"))).select("from_key", "to_key").distinct()
    counted = cites.groupBy(F.col("to_key").alias("key")).agg(F.count("*").alias("cited_by")).where(F.col("cited_by") >= least)
    known = nodes.groupBy("key").agg(F.max("cited_by_global").alias("cited_by_global"), F.bool_or(F.coalesce("gone", F.lit(False))).alias("gone"))
    found = counted.join(known, "key", "left").where(~F.coalesce("gone", F.lit(False)))
    found = found.select("key", "cited_by", "cited_by_global", scores.gap_score(F.col("cited_by"), F.col("cited_by_global")).alias("score"))
    found = stage(found)
    total = found.count()
    ranked = found.orderBy(F.desc("score"), F.desc("cited_by"), "key")
    return (ranked.limit(limit) if limit is not None else ranked).withColumn("total", F.lit(total).cast("long"))


def gap_owners(edges: DataFrame, communities: DataFrame, gap_keys: DataFrame) -> DataFrame:
    """(key, citers, spread, top, owner): which subfield's works cite a gap.

    spread is the number of subfields, top the one with most citing works (least name among equals),
    owner the one with more than half of all citing works, those in no subfield counted too.
    """
    cites = edges.where(F.col("from_key") != F.col("to_key")).select("from_key", F.col("to_key").alias("key")).distinct().join(gap_keys.select("key").distinct(), "key", "left_semi")
    placed = cites.join(communities.select(F.col("key").alias("from_key"), "label"), "from_key", "left")
    per = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    some = F.col("label").isNotNull()
    out = per.groupBy("key").agg(F.sum("n").alias("citers"), F.count_if(some).alias("spread"), F.min(F.when(some, F.struct((-F.col("n")).alias("n"), "label"))).alias("b"))
    return out.select("key", "citers", "spread", F.col("b.label").alias("top"), F.when(-F.col("b.n") / F.col("citers") > 0.5, F.col("b.label")).alias("owner"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(key, distance): works within `depth` steps of `start` (key), direction aside.

    Each step joins only the works reached last with the edges and drops those reached before.
    """
    both = edges.select(F.col("from_key").alias("key"), F.col("to_key").alias("next")).unionByName(edges.select(F.col("to_key").alias("key"), F.col("from_key").alias("next"))).where(F.col("key") != F.col("next"))
    both = stage(both.distinct()) if depth > 1 else both
    reached = start.select("key").distinct().withColumn("distance", F.lit(0))
    edge = reached
    for d in range(1, depth + 1):
        found = both.join(edge.select("key"), "key", "left_semi").select(F.col("next").alias("key")).distinct()
        edge = stage(found.join(reached.select("key"), "key", "left_anti").withColumn("distance", F.lit(d)))
        reached = reached.unionByName(edge)
    return reached


def lit_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges with both ends reached, one of them before the last step."""
    at = lambda c, n: reached.select(F.col("key").alias(c), F.col("distance").alias(n))
    both = edges.join(at("from_key", "_a"), "from_key").join(at("to_key", "_b"), "to_key")
    return both.where(F.least("_a", "_b") < max(depth, 1)).drop("_a", "_b")


def namesakes(nodes: DataFrame) -> DataFrame:
    """Labels told apart: (key, label) of nodes (key, label, held, item_id).

    Of nodes with one label, held ones first by item_id, then outside ones by key, each gets a
    letter; after a digit it follows at once, else after a dash. "?" stays.
    """
    bare = nodes.where("label = '?' or label is null").select("key", "label")  # many have none; they are not ranked
    nodes = nodes.where("label <> '?'")
    w = Window.partitionBy("label").orderBy(F.desc("held"), "item_id", "key")
    n = nodes.withColumn("n", F.count("*").over(Window.partitionBy("label"))).withColumn("i", F.row_number().over(w) - 1)
    letters = ids.suffix_letters(F.col("i"))
    joined = F.concat("label", F.when(F.col("label").rlike(r"\d$"), "").otherwise("-"), letters)
    return n.select("key", F.when(F.col("n") > 1, joined).otherwise(F.col("label")).alias("label")).unionByName(bare)
