import itertools
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmesh import queries as Q
from litmesh.functions import scores
from litmesh.functions.kernels import norm_title
from litmesh.operators import edges as E
from litmesh.operators import evaluate as V
from litmesh.operators import export as X
from litmesh.operators import filters as L
from litmesh.operators import graph as G
from litmesh.operators import items as I
from litmesh.operators import resolve as R
from litmesh.operators import layout as L2
from litmesh.plans import contracts as C
from litmesh.plans.build import Provider, Providers
from litmesh.plans.view import ViewSpec
from litmesh.sources import library as S
from litmesh.streaming import edges as T

EDGE = "from_key string, to_key string, via string, confidence double, evidence map<string,string>, note string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def edges(spark, data):
    return spark.createDataFrame([(*x, None, "extra") if len(x) == 4 else x for x in data], EDGE)


def test_merge_ties_nulls_and_repeats(spark):
    e = edges(spark, [("A", "B", "title-match", 0.4), ("A", "B", "pdf-links", None), ("A", "B", "pdf-links", None), ("A", "A", "pdf-links", 0.9), (None, "B", "pdf-links", 0.9)])
    (m,) = E.merge(e).collect()
    assert (m.from_key, m.to_key, m.confidence, m.via, m.n_evidence) == ("A", "B", 0.95, ["pdf-links", "title-match"], 0)
    assert E.merge(e.where("false")).count() == 0


def test_merge_is_invariant_and_idempotent(spark):
    data = [(a, b, v, 0.5) for a, b, v in itertools.product("AB", "CD", E.STRATEGIES[:3])]
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    key = lambda m: rows(m.withColumn("v", F.array_join("via", ",")), "from_key", "to_key", "v")
    assert key(E.merge(edges(spark, data))) == key(E.merge(edges(spark, shuffled + data)))


def test_validate_and_rekey(spark):
    held = spark.createDataFrame([("A",), ("B",)], "key string")
    e = edges(spark, [("A", "B", "x", 0.5), ("A", "doi:1", "x", 0.5), ("A", "C", "x", 0.5), ("C", "A", "x", 0.5), ("A", "zzz:1", "x", 0.5)])
    assert rows(E.validate(e, held), "from_key", "to_key") == [("A", "B"), ("A", "doi:1")]
    moved = spark.createDataFrame([("doi:1", "B")], "key string, new_key string")
    assert rows(E.rekey(E.merge(E.validate(e, held)), moved), "from_key", "to_key") == [("A", "B")]


def test_same_title_keeps_the_best_key(spark):
    t = "A title that is long enough to say something"
    n = spark.createDataFrame([("ref:a", t, 1), ("doi:b", t, 2), ("doi:c", t, 3), ("ref:d", "short", 4), ("ref:e", None, 5)], "key string, title string, seq bigint")
    assert rows(E.same_title(n), "key", "new_key") == [("doi:c", "doi:b"), ("ref:a", "doi:b")]


def naive_coupling(pairs, held, direct=0.5, max_share=0.5):
    refs = {}
    for a, b in set(pairs):
        if a != b and a in held:
            refs.setdefault(a, set()).add(b)
    cap = max(3, math.floor(max_share * len(refs)))
    cited = {}
    for a, bs in refs.items():
        for b in bs:
            cited.setdefault(b, set()).add(a)
    w = {}
    for cs in cited.values():
        if 2 <= len(cs) <= cap:
            for a, b in itertools.combinations(sorted(cs), 2):
                w[a, b] = w.get((a, b), 0) + 1
    w = {k: n / math.sqrt(len(refs[k[0]]) * len(refs[k[1]])) for k, n in w.items()}
    for k in {tuple(sorted((a, b))) for a, bs in refs.items() for b in bs if b in held}:
        w[k] = w.get(k, 0) + direct
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_coupling_equals_naive(spark, seed):
    rng = random.Random(seed)
    keys = [f"K{i:02d}" for i in range(25)]
    pairs = [(rng.choice(keys), rng.choice(keys + [f"doi:{i}" for i in range(12)] + ["doi:hub"] * 8)) for _ in range(300)]
    e = spark.createDataFrame(pairs, "from_key string, to_key string")
    held = spark.createDataFrame([(k,) for k in keys[:20]], "key string")
    got = {(r.a, r.b): r.w for r in G.coupling(e, held).collect()}
    want = naive_coupling(pairs, set(keys[:20]))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_title_match_reads_sections_once_whatever_the_number_of_titles(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    titles = [" ".join(word() for _ in range(rng.randint(4, 14))) for _ in range(150)]
    titles += [t[: len(t) - 3].strip() for t in titles[:20]] + titles[20:30] + ["x" * 40, "É" + titles[0]]  # prefixes of others, twins, one word, an accent
    i = spark.createDataFrame([(f"T{n}", t, 2000, ["Zed"]) for n, t in enumerate(titles)] + [("P", "p", 2010, ["Q"])], "key string, title string, year int, creators array<string>")
    flat = ["", " ".join(word() for _ in range(30))] + [" ".join([word(), *(word() + x.upper() + ", " + word() for x in rng.sample(titles, 4)), word()]) for _ in range(40)] + ["x" * 90]
    secs = spark.createDataFrame([(f"A{n % 30}", "P" if n % 3 else f"T{n}", "heading" if n % 5 else "none", x) for n, x in enumerate(flat)], "att_key string, parent_key string, quality string, flat string")
    want = sorted((r.parent_key, f"T{n}", r.att_key) for r in secs.collect() if r.quality != "none" for n, t in enumerate(titles) if len(norm_title(t)) >= 30 and norm_title(t) in norm_title(r.flat) and r.parent_key != f"T{n}")
    for most in (100, 500_000):
        got = R.title_match(secs, i, most_letters=most)
        assert sorted((r.from_key, r.to_key, r.evidence["attachment"]) for r in got.collect()) == want
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert len(want) > 80 and R.title_match(secs, i, require_author=True).count() == 0
    assert R.title_match(secs, i.where("key = 'P'")).count() == 0


def crowd(seed=5, n=60):
    """Works that cite six hubs and some others: (edges, held)."""
    rng = random.Random(seed)
    keys = [f"K{i:03d}" for i in range(n)]
    refs = [(k, r) for k in keys for r in {rng.choice([f"hub:{i}" for i in range(6)]) for _ in range(3)} | {rng.choice(keys + [f"doi:{i}" for i in range(20)]) for _ in range(2)}]
    return refs, keys[:-5]


def test_coupling_by_blocks_lists_no_pairs_before_they_are_summed(spark):
    refs, keys = crowd()
    e, held = spark.createDataFrame(refs, "from_key string, to_key string"), spark.createDataFrame([(k,) for k in keys], "key string")
    want = naive_coupling(refs, set(keys))
    for direct in (0.5, 0.0):
        pairs = G.coupling(e, held, width=13, direct=direct)
        assert "Aggregate" not in pairs._jdf.queryExecution().toString()  # a pair is made once, whole
        assert {(r.a, r.b): r.w for r in pairs.collect()} == pytest.approx(naive_coupling(refs, set(keys), direct) if direct else {k: w for k, w in naive_coupling(refs, set(keys), 0.0).items() if w}, abs=1e-9)
        assert pairs.count() == len({(r.a, r.b) for r in pairs.collect()})
    assert {(r.a, r.b): r.w for r in G.coupling(e, held).collect()} == pytest.approx(want, abs=1e-9)
    assert G.coupling(e.where("false"), held).count() == 0


def test_modularity_of_coupled_works_needs_no_pairs(spark, monkeypatch):
    refs, keys = crowd(7)
    e, held = spark.createDataFrame(refs, "from_key string, to_key string"), spark.createDataFrame([(k,) for k in keys], "key string")
    # Some works have no community, some an unknown one, as an outer join may leave them.
    c = spark.createDataFrame([(k, None if i % 11 == 0 else "abc"[i % 3]) for i, k in enumerate(keys) if i % 7], "key string, comm string")
    want = [G.modularity(G.coupling(e, held, direct=d), c).first() for d in (0.5, 0.0)]
    monkeypatch.setattr(G, "pairs_of", None)
    monkeypatch.setattr(G, "block_pairs", None)
    for d, w in zip((0.5, 0.0), want):
        got = G.coupled_modularity(G.coupled(e, held), c, direct=d).first()
        assert (got.modularity, got.communities) == (pytest.approx(w.modularity, abs=1e-12), w.communities)
    none = G.coupled_modularity(G.coupled(e.where("false"), held), c).first()
    assert (none.modularity, none.communities) == (0.0, 0)


def test_block_pairs_of_a_hot_group(spark):
    r = spark.createDataFrame([("g", f"m{i:03d}") for i in range(40)] + [("h", "x"), ("h", "y"), ("i", "z")], "g string, m string")
    pairs = G.block_pairs(r, "g", "m", width=7)
    assert pairs.count() == 40 * 39 // 2 + 1 == pairs.distinct().count()


def two_communities(spark):
    a, b = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    p = [(x, y, 1.0) for s in (a, b) for x, y in itertools.combinations(s, 2)] + [("a0", "b0", 0.2)]
    return spark.createDataFrame(p, "a string, b string, w double")


def test_louvain_finds_two_communities_whatever_the_order(spark):
    p = two_communities(spark)
    got = rows(G.louvain(p), "key", "comm")
    assert len({c for _, c in got}) == 2 and all(k[0] == c[0] for k, c in got)
    assert got == rows(G.louvain(p.orderBy(F.rand(3))), "key", "comm")
    q = G.modularity(p, G.louvain(p)).first()
    assert q.communities == 2 and q.modularity > 0.45
    assert {k[0] == c[0] for k, c in rows(G.louvain_parallel(p, 2 * 20.2), "key", "comm")} == {True}
    assert G.louvain(p.where("false")).count() == 0


def test_both_louvains_go_through_all_levels(spark):
    # A ring of 24 cliques of three: single moves alone end with the cliques, the next level joins them in pairs or more.
    p = [(f"c{i:02d}{x}", f"c{i:02d}{y}", 1.0) for i in range(24) for x, y in ("ab", "ac", "bc")] + [(f"c{i:02d}a", f"c{(i + 1) % 24:02d}b", 1.0) for i in range(24)]
    p = spark.createDataFrame([(*sorted((a, b)), w) for a, b, w in p], "a string, b string, w double")
    local, parallel = G.louvain(p), G.louvain(p, largest=10)
    q, r = G.modularity(p, local).first(), G.modularity(p, parallel).first()
    assert {k for k, _ in rows(parallel, "key", "comm")} == {k for k, _ in rows(local, "key", "comm")}
    assert q.communities < 24 and r.communities < 24
    assert r.modularity == pytest.approx(q.modularity, abs=0.02)
    assert all(c <= k for k, c in rows(parallel, "key", "comm"))


def test_louvain_in_rounds_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    refs = [(f"K{i:03d}", r) for i in range(400) for r in {f"doi:{i % 8}-{rng.randrange(12)}" for _ in range(4)} | {f"hub:{h}" for h in range(3) if rng.random() < (0.8, 0.75, 0.3)[h]}]
    refs += [(f"K{i:03d}", f"K{rng.randrange(400):03d}") for i in range(0, 400, 5)] + [("L0", "L1"), ("L2", "doi:x"), ("L3", "doi:x")]
    e = spark.createDataFrame(refs, "from_key string, to_key string")
    works = G.coupled(e, spark.createDataFrame([(k,) for k in {k for k, _ in refs} | {"L1"}], "key string"), max_share=0.95)
    monkeypatch.setattr(G, "pairs_of", None)
    monkeypatch.setattr(G, "block_pairs", None)
    for direct, largest in ((0.5, 1000), (0.0, 0)):  # all that is left in one task; by joins
        want = G.coupled_modularity(works, G.louvain_coupled(works, direct=direct), direct=direct).first().modularity
        got = G.louvain_coupled(works, direct=direct, largest=largest)
        got, found = G.coupled_modularity(works, got, direct=direct).first().modularity, dict(rows(got, "key", "comm"))
        assert got > want - 0.01
        assert found.keys() >= {k for k, _ in refs if k[0] == "K"} and found["L2"] == found["L3"] == "L2"
        assert all(c <= k and found[c] == c for k, c in found.items())


def test_a_round_finds_the_best_of_all_communities():
    rng, n, hubs = np.random.default_rng(2), 60, 3
    cites = np.c_[rng.random((n, hubs)) < (0.7, 0.5, 0.3), rng.random((n, 40)) < 0.05]
    size, link = cites.sum(axis=1) + rng.integers(1, 9, n), np.triu(rng.random((n, n)) < 0.02, 1)
    weights = lambda c: (c.astype(int) @ c.T) / np.sqrt(np.outer(size, size)) * (1 - np.eye(n))
    w = weights(cites) + 0.5 * (link | link.T)
    degree, two_m = w.sum(axis=1), w.sum()
    js = [np.concatenate([np.flatnonzero(c) for c in cites.T[hubs:] if c[i]] or [[]]).astype(np.int32) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(js, pa.list_(pa.int32())), pa.array([np.flatnonzero((link | link.T)[i]).astype(np.int32) for i in range(n)], pa.list_(pa.int32()))], ["id", "js", "ds"])
    for parts in (60, 40, 6):
        comm = rng.integers(0, parts, n) if parts < n else np.arange(n)
        comm = np.array([np.flatnonzero(comm == c)[0] for c in comm], np.int32)
        p = G._Places(comm, size.astype(np.int32), (cites[:, :hubs] @ (1, 2, 4)).astype(np.uint8), degree, hubs)
        at, to, gain, inside = G._wanted(batch, p, p.fronts(), 0.5, two_m, 1.0)
        same = comm[:, None] == comm
        assert p.height(two_m, 1.0) + inside == pytest.approx((w * same).sum() + sum(cites[i, :hubs].sum() / size[i] for i in range(n)) - sum(degree[comm == c].sum() ** 2 for c in set(comm)) / two_m)
        for i in range(n):
            others = np.arange(n) != i
            value = {c: w[i, (comm == c) & others].sum() - degree[i] * degree[(comm == c) & others].sum() / two_m for c in set(comm)}
            stay, most = value.pop(comm[i]), max([0.0, *value.values()])
            stay = stay if (comm == comm[i]).sum() > 1 else 0.0
            if most > stay + 1e-9:
                assert i in at and gain[at == i][0] == pytest.approx(most - stay)
            else:
                assert i not in at


def test_louvain_of_coupled_works_is_that_of_their_pairs(spark, monkeypatch):
    rng = random.Random(3)
    # 320 works in eight fields, each with references of its own; five hubs (more than 256 citing works among them) cut across.
    refs = [(f"K{i:03d}", r) for i in range(320) for r in {f"doi:{i % 8}-{rng.randrange(12)}" for _ in range(4)} | {f"hub:{h}" for h in range(5) if rng.random() < (0.9, 0.45, 0.4, 0.3, 0.85)[h]}]
    refs += [(f"K{i:03d}", f"K{rng.randrange(320):03d}") for i in range(0, 320, 5)] + [("L0", "L1"), ("L2", "doi:x"), ("L3", "doi:x")]
    e = spark.createDataFrame(refs, "from_key string, to_key string")
    held = spark.createDataFrame([(k,) for k in {k for k, _ in refs} | {"L1"}], "key string")
    for direct, share in ((0.5, 0.95), (0.0, 0.95), (0.5, 0.5)):
        works = G.coupled(e, held, max_share=share)
        pairs = G.pairs_of(works, direct=direct)
        want, q = dict(rows(G.louvain(pairs), "key", "comm")), G.modularity(pairs, G.louvain(pairs)).first()
        with monkeypatch.context() as m:
            m.setattr(G, "pairs_of", None)
            m.setattr(G, "block_pairs", None)
            got = dict(rows(G.louvain_coupled(works, direct=direct), "key", "comm"))
        assert got == want
        assert G.coupled_modularity(works, spark.createDataFrame(list(got.items()), "key string, comm string"), direct=direct).first().modularity == pytest.approx(q.modularity, abs=1e-9)
    few = spark.createDataFrame([(f"A{i}", f"doi:{j}") for i in range(4) for j in range(2)] + [("B0", "doi:9"), ("B1", "doi:9")], "from_key string, to_key string")
    few = G.coupled(few, few.select(F.col("from_key").alias("key")), max_share=0.9)
    assert rows(G.louvain_coupled(few, largest=4), "key", "comm") == [(f"A{i}", "A0") for i in range(4)] + [("B0", "B0"), ("B1", "B0")]
    assert G.louvain_coupled(works.where("false")).count() == 0


def test_coupling_queries_are_registered_over_the_whole_job(spark, sf):
    q = Q.queries()
    pairs = [(r.from_key, r.to_key) for r in spark.read.parquet(f"{sf}/edges.parquet").select("from_key", "to_key").distinct().collect()]
    held = {r.key for r in spark.read.parquet(f"{sf}/items.parquet").select("key").distinct().collect()}
    want = naive_coupling(pairs, held)
    assert {(r.a, r.b): r.w for r in q["gr1_coupling"](spark, sf).collect()} == pytest.approx(want, abs=1e-8)
    coupled = spark.createDataFrame([(a, b, w) for (a, b), w in sorted(want.items())], "a string, b string, w double")
    everyone = {k for p in want for k in p}
    for name in ("gr2_louvain", "gr5_clusters"):
        placed = q[name](spark, sf).select("key", "comm")
        assert {r.key for r in placed.collect()} == everyone
        assert G.modularity(coupled, placed).first().modularity == pytest.approx(G.modularity(coupled, G.louvain(coupled)).first().modularity, abs=0.01)
    kinds = {r.key: r.item_type for r in I.current(spark.read.parquet(f"{sf}/items.parquet")).collect()}
    ends, inside, total = {}, 0.0, 0.0
    for (a, b), w in want.items():
        total += w
        inside += w * (kinds[a] == kinds[b])
        for k in (a, b):
            ends[kinds[k]] = ends.get(kinds[k], 0.0) + w
    got = q["gr3_modularity"](spark, sf).first()
    assert (got.modularity, got.communities) == (pytest.approx(inside / total - sum((t / (2 * total)) ** 2 for t in ends.values()), abs=1e-5), len(ends))


def test_reference_count_over_all_rows_and_of_small_groups(spark, sf):
    def want(counts):
        c = sorted(counts)
        return max(1, c[math.floor(0.95 * (len(c) - 1))] if len(c) >= 20 else c[-1])

    groups = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        groups.setdefault(r.l_suppkey, []).append(r.l_partkey % 50)
    assert dict(rows(Q.queries()["fn26_reference_count_whole"](spark, sf), "g", "reference")) == {g: want(c) for g, c in groups.items()}
    small = {n: [(7 * i + n) % 50 for i in range(n)] for n in (1, 2, 19, 20, 21)} | {0: [0, 0]}
    df = spark.createDataFrame([(g, c) for g, cs in small.items() for c in cs], "g int, c int")
    assert dict(rows(df.groupBy("g").agg(scores.reference_count(F.col("c")).alias("r")), "g", "r")) == {g: want(c) for g, c in small.items()}


def test_names_and_gaps(spark):
    c = spark.createDataFrame([(f"k{i}", "A" if i < 4 else "B") for i in range(8)], "key string, comm string")
    t = spark.createDataFrame([(f"k{i}", "quantum error correction" if i < 4 else "protein folding landscapes") for i in range(8)], "key string, title string")
    assert rows(G.name_communities(c, t), "comm", "label") == [("A", "error correction / quantum"), ("B", "folding landscapes / protein")]
    e = spark.createDataFrame([("A", "doi:1"), ("B", "doi:1"), ("A", "doi:2"), ("B", "doi:2"), ("A", "doi:3"), ("A", "doi:1")], "from_key string, to_key string")
    n = spark.createDataFrame([("doi:1", 10**6, False), ("doi:2", None, None), ("doi:3", 1, True)], "key string, cited_by_global bigint, gone boolean")
    got = G.gaps(e, n).orderBy(F.desc("score")).collect()
    assert [(r.key, r.cited_by, r.total) for r in got] == [("doi:2", 2, 2), ("doi:1", 2, 2)]


def test_neighbourhood_and_namesakes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "from_key string, to_key string")
    s = spark.createDataFrame([("a",)], "key string")
    r = G.neighbourhood(e, s, 2)
    assert rows(r, "key", "distance") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(G.lit_edges(e, r, 2), "from_key", "to_key") == [("a", "b"), ("b", "c")]
    n = spark.createDataFrame([("k2", "Doe2001", True, 2), ("k1", "Doe2001", True, 1), ("doi:1", "Doe2001", False, None), ("k3", "?", True, 3), ("k4", "?", True, 4), ("k5", "Roe", True, 5)], "key string, label string, held boolean, item_id bigint")
    assert rows(G.namesakes(n), "key", "label") == [("doi:1", "Doe2001c"), ("k1", "Doe2001a"), ("k2", "Doe2001b"), ("k3", "?"), ("k4", "?"), ("k5", "Roe")]


@pytest.mark.parametrize("text", ['publication: "Nature, the", ~rev', "year: 2000-1990, >2010, 201", '"say ""so"""', "smith, smith", "nofield: x", "tag:"])
def test_filters_round_trip(text):
    f = L.parse(text)
    assert L.parse(L.show(f)) == f


def test_filters_meaning(spark):
    assert L.parse("year: 2005-1990").terms == (L.Term("range", low=1990, high=2005),)
    assert L.parse("year: 201").terms == (L.Term("contains", "201"),)
    assert L.parse("nofield: x").field is None
    data = [("k1", ["T one"], ["Smith"], ["1999"], [], [], [], [], []), ("k2", ["T two"], ["Jones"], [], [], [], ["Smithy"], [], [])]
    f = spark.createDataFrame(data, "key string, " + ", ".join(f"{c} array<string>" for c in L.FIELDS))
    match = lambda *t: [r.key for r in L.matching(f, [L.parse(x) for x in t]).orderBy("key").collect()]
    assert match("smith") == ["k1", "k2"] and match('author: "smith"') == ["k1"] and match("year: <2005") == ["k1"] and match("smith", "author: jones") == ["k2"] and match() == ["k1", "k2"]


def test_view_spec_round_trip():
    v = ViewSpec(filters=("year: 2000",), min_cites=3, hidden=("k",))
    assert ViewSpec.loads(v.dumps()) == v


def test_providers():
    p = Providers()
    p.register(Provider("a", "A", lambda c: None))
    p.register(Provider("b", "B", lambda c: None, requires_network=True))
    with pytest.raises(ValueError, match="twice"):
        p.register(Provider("a", "A", lambda c: None))
    with pytest.raises(ValueError, match="known: a, b"):
        p.select(["c"])
    assert [x.id for x in p.select(offline=True)] == ["a"] and [x.id for x in p.select(without=("a",))] == ["b"]


def _items(spark):
    data = [
        ("K1", 1, "Thermal transport in very thin crystalline films", "10.1/a1", 2000, "J. Appl. Phys.", "Journal of Applied Physics", "81", "2590-2595", ["Lee"]),
        ("K2", 2, "A citing work about other things altogether", "10.1/a2", 2005, None, None, None, None, ["Roe"]),
        ("K3", 3, "Another work with the same old identifier", "10.1/a1", 2001, None, None, None, None, []),
    ]
    return spark.createDataFrame(data, "key string, seq int, title string, norm_doi string, year int, journal_abbreviation string, publication string, volume string, pages string, creators array<string>")


def test_strategies(spark):
    i = _items(spark)
    body = "Body text that says nothing of note. " * 30
    refs = "\n".join(f"[{n}] A. Author, Some other title {n}, Some Journal {n}, 1{n} (199{n})." for n in range(1, 8))
    text = f"{body}\nReferences\n{refs}\n[8] S. Lee, Thermal transport in very thin crystalline films, J. Appl. Phys. 81, 2590 (2000), doi:10.1/a2x."
    docs = spark.createDataFrame([("AT2", "K2", text), ("AT1", "K1", ""), ("AT0", "K1", None)], "att_key string, parent_key string, text string")
    s = R.sections(docs)
    assert rows(R.title_match(s, i), "from_key", "to_key", "confidence") == [("K2", "K1", 0.8)]
    assert rows(R.title_match(s, i, most_letters=50), "from_key", "to_key", "confidence") == [("K2", "K1", 0.8)]
    assert rows(R.locator_match(s, i), "from_key", "to_key", "confidence") == [("K2", "K1", 0.85)]
    from litmesh.operators.items import by_doi

    uris = spark.createDataFrame([("AT2", "K2", ["https://doi.org/10.1000/x1", "https://doi.org/10.1/A1"]), ("AT1", "K1", ["https://doi.org/10.1/a1"])], "att_key string, parent_key string, uris array<string>")
    i2 = i.withColumn("norm_doi", F.regexp_replace("norm_doi", "10.1/", "10.1000/"))
    links = R.pdf_links(uris, i2, by_doi(i2))
    assert rows(links, "from_key", "to_key") == [("K2", "doi:10.1000/x1")]
    parsed = spark.createDataFrame([("AT2", "K2", "heading", "Thermal transport in very thin crystalline films", "Lee", 2000, None, None, 0.9), ("AT2", "K2", "tail", "A title nobody holds at all", "X", 1990, None, None, 0.9), ("AT2", "K2", "tail", None, None, None, None, "2101.00001", 0.5), ("AT2", "K2", "tail", None, None, None, "10.1/a2", None, 0.5)], "att_key string, parent_key string, quality string, title string, surname string, year int, doi string, arxiv_id string, parse_confidence double")
    assert rows(R.resolve_entries(parsed, i), "from_key", "to_key", "confidence") == [("K2", "K1", 0.8), ("K2", "arxiv:2101.00001", 0.85), ("K2", "ref:a-title-nobody-holds-at-all", 0.54)]


def test_enrich_fills_first_and_asks_only_for_the_incomplete(spark):
    schema = "key string, title string, creators array<string>, year int, venue string, cited_by_global bigint, gone boolean, source array<string>"
    a = spark.createDataFrame([("doi:1", "One", [], None, None, 5, None, ["a"]), ("doi:2", None, ["X"], 2000, None, None, None, ["a"])], schema)
    b = spark.createDataFrame([("doi:1", "Uno", ["Y"], 1999, None, 7, None, ["b"]), ("doi:2", "Two", ["Z"], 1999, "V", 1, True, ["b"])], schema)
    k = spark.createDataFrame([("doi:1",), ("doi:2",), ("ref:3",)], "key string")
    got = {r.key: r for r in R.enrich(k, (a, ("doi",)), (b, ("doi",))).collect()}
    assert (got["doi:1"].title, got["doi:1"].creators, got["doi:1"].source) == ("One", None, ["a"])
    assert (got["doi:2"].title, got["doi:2"].creators, got["doi:2"].year, got["doi:2"].gone, got["doi:2"].source) == ("Two", ["X"], 2000, True, ["a", "b"])
    assert got["ref:3"].title is None and got["ref:3"].source == []


def test_accuracy(spark):
    p = spark.createDataFrame([("s", "A", "B"), ("s", "A", "C"), ("t", "A", "B")], "strategy string, from_key string, to_key string")
    t = spark.createDataFrame([("A", "B"), ("B", "C")], "from_key string, to_key string")
    trap = spark.createDataFrame([("A", "*")], "from_key string, to_key string")
    got = {r.strategy: r for r in V.accuracy(p, t, trap).collect()}
    assert (got["s"].tp, got["s"].fp, got["s"].fn, got["s"].precision, got["s"].traps) == (1, 1, 1, 0.5, 2)
    assert V.unique_hits(p, t).count() == 0


def test_exports(spark, tmp_path):
    n = spark.createDataFrame([("K<1>", 'A & "B"\x01', None)], "key string, title string, year int")
    e = spark.createDataFrame([("K<1>", "doi:1", ["a", "b"])], "from_key string, to_key string, via array<string>")
    X.write_graphml(n, e, str(tmp_path / "g"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    import xml.dom.minidom

    doc = xml.dom.minidom.parseString("".join(r.line for r in X.graphml(n, e).orderBy("part").collect()))
    assert doc.getElementsByTagName("node")[0].getAttribute("id") == "K<1>" and "<graphml" in text
    assert len(doc.getElementsByTagName("data")) == 2
    assert X.file_name('a<b>:"c"\x00 ') == "a-b---c-" and X.file_name("...") == "graph"
    X.write_node_link(n, e, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2


def test_sinks_write_a_node_for_each_end_of_an_edge(spark, sf):
    import json
    import xml.etree.ElementTree as ET

    described = {r.key: r.title for r in spark.read.parquet(f"{sf}/described.parquet").where("title is not null").collect()}
    got = [(r.kind, json.loads(r.json)) for r in Q.queries()["snk1_node_link"](spark, sf).collect()]
    nodes, ends = {x["key"]: x for k, x in got if k == "node"}, {x[c] for k, x in got if k == "link" for c in ("from_key", "to_key")}
    assert len(nodes) == sum(k == "node" for k, _ in got) and ends <= nodes.keys()
    outside = {k: x for k, x in nodes.items() if not x["held"]}
    assert any("title" in x for x in outside.values()) and all(x.get("title") in (None, described.get(k)) for k, x in outside.items())
    lines = Q.queries()["snk2_graphml"](spark, sf).orderBy("part").collect()
    graph = ET.fromstring("".join(r.line for r in lines).encode())
    tag = "{http://graphml.graphdrawing.org/xmlns}"
    assert {e.get(c) for e in graph.iter(f"{tag}edge") for c in ("source", "target")} <= {n.get("id") for n in graph.iter(f"{tag}node")} == nodes.keys()


def test_pdf_links(spark, tmp_path):
    import zlib

    packed = zlib.compress(b"<</URI (https://doi.org/10.1/b)>>")
    pdf = b"%PDF\n<</URI (https://doi.org/10.1/a\\(1\\))>>\n<</Type/ObjStm/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>\nstream\n" + packed + b"\nendstream"
    (tmp_path / "x.pdf").write_bytes(pdf)
    (tmp_path / "y.pdf").write_bytes(b"")
    got = {r.path[-5:]: r.uris for r in S.pdf_uris(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": ["https://doi.org/10.1/a(1)", "https://doi.org/10.1/b"]}
    assert S.scan_uris(None) == S.scan_uris(b"") == []


def test_streamed_upsert_equals_batch(spark, tmp_path):
    data = edges(spark, [("A", "B", "title-match", 0.4), ("A", "B", "pdf-links", 0.9), ("B", "C", "text-doi", 0.8)]).select("from_key", "to_key", "via", "confidence")
    data.limit(2).write.parquet(str(tmp_path / "in"))
    run = lambda: T.upsert(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    data.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = T.current(spark.read.parquet(str(tmp_path / "out")))
    assert rows(got.withColumn("v", F.array_join("via", ",")), "from_key", "to_key", "confidence", "v") == [("A", "B", 0.9, "pdf-links,title-match"), ("B", "C", 0.8, "text-doi")]


def test_page_lines(spark):
    f = pd.DataFrame([(1, 10.0, 700.0, 100.0, "left one"), (1, 200.0, 700.0, 100.0, "right one"), (1, 10.0, 680.0, 100.0, "left two")], columns=["page", "x", "y", "w", "str"]).astype({"page": "int32"})
    got = S.page_lines(spark.createDataFrame(f))
    assert rows(got, "column", "line", "text") == [(0, 0, "left one"), (0, 1, "left two"), (1, 2, "right one")]


def test_synthetic_is_seeded(spark):
    a, b = S.synthetic(spark, 50, seed=4), S.synthetic(spark, 50, seed=4)
    assert a[1].collect() == b[1].collect() and a[0].count() == 50


def test_library_grows_with_its_oldest_works_cited_most(spark):
    (a, e), (b, f) = S.synthetic(spark, 60, seed=2), S.synthetic(spark, 40, seed=2, first=60)
    keys = {r.key for r in a.collect()} | {r.key for r in b.collect()}
    ends = [(r.from_key, r.to_key) for r in e.unionByName(f).collect()]
    assert len(keys) == 100 and {x for x, _ in ends} <= keys and {y for _, y in ends if not y.startswith("doi:")} <= keys
    late = [y for x, y in ends if x >= "S000000060" and not y.startswith("doi:")]
    assert sum(y < "S000000050" for y in late) > len(late) / 2


def test_collections_in_a_circle_and_deep(spark):
    tree = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 40)] + [("c0", "c39")], "collection string, parent string")
    members = spark.createDataFrame([(f"c{i}", f"k{i}") for i in range(40)] + [("x", "other")], "collection string, key string")
    assert S.collection_items(members, tree, "c3").count() == 40
    assert S.collection_items(members, tree, "c3", recursive=False).count() == 1


def test_large_files_are_reported_unread(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"/URI (https://x.example)")
    (tmp_path / "b.pdf").write_bytes(b"/URI (https://y.example)" + b" " * 100)
    got = {r.path[-5:]: r.uris for r in S.pdf_uris(spark, str(tmp_path), most_bytes=50).collect()}
    assert got == {"a.pdf": ["https://x.example"], "b.pdf": None}


def test_colour_slots(spark):
    n = spark.createDataFrame([(f"cat{i:02d}", 30 - i % 4) for i in range(25)] + [("", 1)], "category string, items bigint")
    got = dict(rows(L2.colour_slots(n, slots=10, spare=5), "category", "slot"))
    first = sorted(got, key=lambda c: (-next(r.items for r in n.collect() if r.category == c), c))
    assert sorted(got[c] for c in first[:10]) == list(range(10)) and sorted(got[c] for c in first[10:15]) == list(range(10, 15))
    assert all(got[c] < 10 for c in first[15:]) and L2.colour_slots(n.where("false")).count() == 0


def test_contracts(spark):
    frame = lambda cols: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))
    made = {n: (lambda self, c=c: frame(c)) for n, c in C.TABLES.items()}
    assert C.checked(type("Lib", (), made)())
    with pytest.raises(ValueError, match="uris lacks att_key"):
        C.checked(type("Lib", (), made | {"uris": lambda self: frame(["uris"])})())
    with pytest.raises(TypeError, match="items"):
        C.checked(object())


def test_an_enricher_that_fails_leaves_what_it_has(spark):
    keys = spark.createDataFrame([("doi:a",), ("doi:b",), ("ref:c",)], "key string")
    known = lambda ks, name: spark.createDataFrame([(k, f"{name} {k}", ["X"], 2000, "V", 1, False, [name]) for k in ks], "key string, title string, creators array<string>, year int, venue string, cited_by_global bigint, gone boolean, source array<string>")

    def half(asked):
        raise C.Partial("stopped", known(["doi:a"], "half"))

    def broken(asked):
        raise RuntimeError("no answer")

    asked = []
    rest = lambda df: asked.append(sorted(r.key for r in df.collect())) or known(asked[-1], "rest")
    got, errors = C.enriched(keys, [C.Enricher("half", ("doi",), half), C.Enricher("broken", ("doi",), broken), C.Enricher("rest", ("doi", "ref"), rest)])
    assert {r.key: r.title for r in got.collect()} == {"doi:a": "half doi:a", "doi:b": "rest doi:b", "ref:c": "rest ref:c"}
    assert errors == {"half": "stopped", "broken": "no answer"} and asked == [["doi:b", "ref:c"]]


def test_only_the_newest_run_counts(spark):
    runs, seen = C.Newest(spark, "view"), []
    assert runs.run(lambda newest: spark.range(5).count()) == 5

    def old(newest):
        assert runs.run(lambda n: "new") == "new"
        seen.append(newest())
        return "old"

    assert runs.run(old) is None and seen == [False]


def test_throttle():
    now, out = [0.0], []
    t = C.Throttle(out.append, clock=lambda: now[0])
    for x in range(6):
        t(x)
        now[0] += 0.09
    t.done()
    t.done()
    assert out == [0, 3, 5]


def test_a_failing_strategy_fails_the_build_unless_asked(spark):
    from litmesh.plans import build as B

    def broken(context):
        raise KeyError("nothing")

    try:
        B.PROVIDERS.register(Provider("broken", "Broken", broken, default_enabled=False))
        context = B.Context.__new__(B.Context)
        with pytest.raises(RuntimeError, match="broken"):
            B.build(context, only=["broken"])
        with pytest.raises(ValueError, match="no strategy gave edges"):
            B.build(context, only=["broken"], partial=True)
    finally:
        B.PROVIDERS.known.pop("broken", None)


def test_staged_tables_go_with_their_scope(spark):
    from litmesh import session

    with session.staged():
        path = session.stage(spark.range(3)).inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_evidence_of_misses(spark):
    miss = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "x")], "from_key string, to_key string")
    texts = spark.createDataFrame([("a", "Body. doi:10.1/X", "doi:10.1/X", "heading"), ("b", "On the Long Title of a Work here", "", "none"), ("c", "smith 1999", "Smith 1999", "tail"), ("d", None, None, None)], "from_key string, text string, flat string, quality string")
    targets = spark.createDataFrame([("x", "10.1/x", "On the long title of a work", "Smith", 1999, "3", "17")], "to_key string, doi string, title string, author string, year int, volume string, page string")
    got = dict(rows(V.miss_causes(V.miss_evidence(miss, texts, targets)), "cause", "misses"))
    assert got == {"doi_in_section": 1, "title_in_text": 1, "author_and_year_in_section": 1, "document_found": 1, "nothing": 1}
