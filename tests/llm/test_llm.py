import itertools
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from litmesh.llm import canonical, cooccur, dedupe, groups, leaks, matching, mixing, names, quality, textnorm


def pairs_of(df, a, b):
    return sorted((r[a], r[b]) for r in df.select(a, b).collect())


# --- 1 -----------------------------------------------------------------------


def brute_pairs(rows, support, lift):
    baskets, n = {}, {}
    for b, i in {(b, i) for b, i in rows if b and i and b != i}:
        baskets.setdefault(b, set()).add(i)
        n[i] = n.get(i, 0) + 1
    both = {}
    for items in baskets.values():
        for p in itertools.combinations(sorted(items), 2):
            both[p] = both.get(p, 0) + 1
    return {p: c for p, c in both.items() if c >= support and c * len(baskets) >= lift * n[p[0]] * n[p[1]]}


@pytest.mark.parametrize("hot, lift", [(1024, 0.0), (4, 0.0), (4, 1.2), (2, 0.0)])
def test_pairs_equal_brute_force(spark, hot, lift):
    rng = random.Random(hot)
    rows = [(f"b{rng.randrange(40)}", f"i{int(rng.paretovariate(0.8)) % 25:02d}") for _ in range(700)] + [("b0", f"i{k:02d}") for k in range(25)] + [(None, "i01"), ("b1", None), ("i01", "i01")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "f string, t string, code string, n int")
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccur.cooccurrence(df, "f", "t", min_support=3, min_lift=lift, hot_basket=hot).collect()}
    assert got == brute_pairs(rows, 3, lift) and got


def test_pairs_of_nothing(spark):
    assert cooccur.cooccurrence(spark.createDataFrame([], "f string, t string"), "f", "t").count() == 0


# --- 2 -----------------------------------------------------------------------

ITEM = "item_id bigint, seq int, synced_at timestamp, title string, doi string, volume string, pages string, canon string, h int"


def items(spark, rows):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, n, at + datetime.timedelta(days=n), *r, "x", 1) for n, (i, *r) in enumerate(rows)], ITEM)


ROWS = [
    (1, "Naïve <i>trade</i>-offs &amp; more", "10.1/ABC", "5", "1-10"),
    (2, "  NAÏVE trade‐offs & more.", "https://doi.example/10.1%2fabc", "5", "1--10"),
    (2, "  NAÏVE trade‐offs & more.", "https://doi.example/10.1%2fabc", "5", "1--10"),
    (3, "Naive trade-offs & more", "10.1/abc", "5", "1-10"),
    (4, "Same", None, "5", "1-23"),
    (5, "same", None, "5", "12-3"),
    (6, "Same", None, "5", None),
    (7, "same", None, "5", None),
    (8, None, "10.1/x", None, None),
    (9, None, "doi: 10.1/X;", None, None),
    (10, "", "10.1/x", None, None),
    (11, "Other", "10.1/q", "1", "1"),
    (11, "same", None, "5", "1-23"),
    (None, "Same", None, "5", "1-23"),
]


@pytest.mark.parametrize("slice_mb", [64, 8e-6])
def test_hidden_duplicates(spark, slice_mb):
    df = items(spark, ROWS)
    members = dedupe.duplicate_groups(df, slice_mb=slice_mb)[1]  # one range of hashes, or four
    got = pairs_of(groups.group_pairs(members, "canon", "item_id"), "a", "b")
    assert got == [(1, 2), (4, 11), (8, 9)]


def test_deduplicated_counts(spark):
    got = {r.item_id: r.n_copies for r in dedupe.deduplicated(items(spark, ROWS)).collect()}
    assert got == {1: 2, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, 8: 2, 10: 1}
    assert dedupe.duplicate_pairs(items(spark, ROWS).where("false")).count() == 0


@pytest.mark.parametrize("slice_mb", [64, 0.01])
def test_bloom_loses_no_repeat(spark, slice_mb):
    n = 20_000
    df = spark.range(n).select((F.col("id") % (n - 500)).cast("string").alias("canon"), F.col("id").alias("item_id")).withColumn("h", F.xxhash64("canon")).select("item_id", "canon", "h").repartition(7)
    some = dedupe.possible_repeats(df, n, slice_mb)
    assert some.groupBy("canon").count().where("count > 1").count() == 500
    assert some.count() < 0.2 * n


def test_large_groups_are_listed_whole(spark):
    df = spark.range(70).select(F.lit("g").alias("g"), F.col("id").alias("m"))
    got = groups.group_pairs(df, "g", "m", width=16)
    assert got.count() == got.distinct().count() == 70 * 69 // 2


def test_components(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(35)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(pairs_of(groups.components(spark.createDataFrame(links, "a string, b string")), "node", "root"))
    assert got == {x: find(x) for x in got} and set(got) == {x for p in links if p[0] != p[1] for x in p}


# --- 3 -----------------------------------------------------------------------

JOURNALS = [(1, "Gildesh Journal of Glaciology A", "Gildesh J. Glaciol. A"), (2, "Gildesh Journal of Glaciology B", "Gildesh J. Glaciol. B"), (3, "Proceedings of the Thalwen Academy: Marine Ecology", "Proc. Thalwen Acad. Mar. Ecol."), (4, "Birkenau-Sund Letters in Ørsava Studies", "Birkenau-Sund Lett. Ørsava Stud."), (5, "Annals of Brathic Numerical Modelling", "Ann. Brathic Numer. Model.")]
VALUES = [
    (("gildesh  J Glaciol B", None), 2),
    (("Giildesh Jourmal of Glaciology A", None), 1),
    (("Gildesh Journal of Glaciology", None), 0),
    (("Gildesh Journal of Glaciology C", None), 0),
    (("The Proceedings of Thalwen Academy: Marine Ecology, vol. 16, no. 2 (Online)", None), 3),
    (("Thalwen Academy: Marine Ecology, Proceedings of the", None), 3),
    (("BirkenauSund Letters on Orsava Studies", None), 4),
    (("??", "Ann.Brathic Numer.Model."), 5),
    (("Ann. Brathic Numerical Modeling", None), 5),
    (("Annals of Corvessa Numerical Modelling", None), 0),
    (("", "n/a"), 0),
    ((None, "12"), 0),
    (("x" * 20_000, None), 0),
]


@pytest.mark.parametrize("values, wanted", VALUES)
def test_canonical_values(values, wanted):
    assert canonical.Matcher(JOURNALS).decide(*values)[0] == wanted


MENTIONED = [(1, "Journal of Marine Ecology", None), (2, "Marine Ecology", None), (3, "Gildesh Journal of Glaciology", "Gildesh J. Glaciol.")]


@pytest.mark.parametrize(
    "value, wanted",
    [
        ("Published in Journal of Marine Ecology by Elsevier", 1),
        ("Journal of Marine Ecology; Springer", 1),
        ("see Journal of Marine Ecology", 1),
        ("Springer / Gildesh J. Glaciol. 12(3)", 3),
        ("Advances in Marine Ecology", 0),
        ("European Journal of Marine Ecology", 0),
        ("Gildesh Journal of Glaciology C", 0),
        ("Gildesh Journal of Glaciology (C)", 0),
        ("Journal of Marine Ecology; Gildesh Journal of Glaciology", 0),  # two entries, alike in length
    ],
)
def test_embedded_mentions(value, wanted):
    assert canonical.Matcher(MENTIONED).decide(value)[0] == wanted


def test_words_like_a_listed_word_equal_brute_force():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 11)))
    matcher = canonical.Matcher([(i, f"{word()} {word()}", None) for i in range(150)])
    for _ in range(1500):
        w, want = word(), {}
        for x in matcher.listed:
            most = 1 if max(len(w), len(x)) < canonical.LONG else 2
            stem = w[:-1] if len(w) > 3 and w[-1] == "s" else w
            if x == w:
                want[x] = 1.0
            elif len(w) > 1 and (x.startswith(stem) or len(x) >= 3 and w.startswith(x)):
                want[x] = 0.95
            elif min(len(x), len(w)) >= 3 and (d := textnorm.edits(w, x, most)) <= most:
                want[x] = 0.9 - 0.1 * d
        assert matcher.agreement(w) == want


def test_mapped(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, i, at, p, a, "x") for i, ((p, a), _) in enumerate(VALUES)] + [(99, 1, at, None, None, "x")], "item_id bigint, seq int, synced_at timestamp, publication string, journal_abbreviation string, score string")
    j = spark.createDataFrame(JOURNALS, "journal_id int, name string, abbreviation string")
    assert pairs_of(canonical.mapped(df, j), "item_id", "journal_id") == [(i, w) for i, (_, w) in enumerate(VALUES)]
    assert {r.journal_id for r in canonical.mapped(df, j.where("false")).collect()} == {0}
    with pytest.raises(ValueError, match="most_entries"):
        canonical.mapped(df, j, most_entries=3)


# --- 4 -----------------------------------------------------------------------

CLASSES = [
    ["Klopisuvard, Frederick", "Frederick D. Klopisuvard", "Klopisuvard, F.", "KLOPISUVARD, Frederick", "Fred Klopisuvard", "Klopisuvard FD", "Klopisuvard, Fred.", "Frederick Klopsuvard", "Klopisuvard Frederick"],
    ["Klopisuvard, Lars", "L. Klopisuvard", "Lars S. Klopisuvard"],
    ["van der Hatenudos, Ulrich", "Hatenudos, Ulrich van der", "Ulrich H. van der Hatenudos"],
    ["Nepevelös, Olivia", "Nepeveloes, Olivia", "Nepevelös, O.", "Liv Nepevelös"],
    ["Refimikow", "Refimikow, Wilhelmina", "REFIMIKOW"],
    ["Gefanimek Agency for Catalysis", "Agency for Catalysis, Gefanimek", "Gefanimek Agcy Catal.", "GEFANIMEK AGENCY FOR CATALYSIS", "Gefanimek Agency of Catalysis (AC)", "Gefanimek AC"],
    ["Hoskesikek-Bek, Samuel", "Hoskesikek Bek,Samuel", "S. Hoskesikek-Bek"],
    ["Silsatedin SC", "SILSATEDIN, Samuel", "Sam Silsatedin"],
    ["Tivestalek, Noor"],
    ["Tivestalek, Oskar", "O.L. Tivestalek"],
    ["—"],
]


@pytest.mark.parametrize("times", [1, 8])
def test_misspelt_names_stay_with_their_namesakes_as_the_table_grows(spark, times):
    families = [f"{a}{b}" for a in ("Bordek", "Dalmip", "Fugtur", "Gilzav") for b in ("anisen", "ovuhorst", "ecklund", "ipowitz", "urrabel", "yttcomb")][: 3 * times]
    listed = [f"{f}, {g}" for f in families for g in ("William", "Wikliam")] + [f"{a}{b}by, Marta" for a in "KLMN" for b in ("orud", "ipal")] + [f"{a}{b}ton, Maria" for a in "PQRS" for b in ("ezun", "avol")] + ["Korudby, Maria"]
    got = {r["name"]: r["class"] for r in names.name_classes(spark.createDataFrame([(n,) for n in listed], "name string")).collect()}
    assert all(got[f"{f}, William"] == got[f"{f}, Wikliam"] for f in families)
    assert got["Korudby, Maria"] != got["Korudby, Marta"] and len({got[f"{f}, William"] for f in families}) == len(families)


def test_names_with_two_misspelt_words_are_linked(spark):
    linked = [("Peter Schmidt", "Petr Schmitt"), ("Frederick Klopisuvard", "Fredrick Klopsuvard")]
    other = ["Paula Schmidt", "Dieter Schmidt", "Peter Schmalz", "Frederick Klopsiva"]
    df = spark.createDataFrame([(n,) for n in [*itertools.chain(*linked), *other]], "name string")
    got = {r["name"]: r["class"] for r in names.name_classes(df).collect()}
    assert all(got[a] == got[b] for a, b in linked) and len({got[n] for n in ("Paula Schmidt", "Dieter Schmidt", "Peter Schmalz")} | {got["Peter Schmidt"]}) == 4


def test_name_classes(spark):
    known = {n: i for i, c in enumerate(CLASSES) for n in c}
    df = spark.createDataFrame([(n, "x") for n in [*known, *list(known)[:5]]] + [(None, "x")], "name string, class string")
    got = {}
    for r in names.name_classes(df).collect():
        got.setdefault(r["class"], set()).add(r["name"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in CLASSES)
    want = sorted(p for c in CLASSES for p in itertools.combinations(sorted(c, key=lambda s: s.encode()), 2))
    assert pairs_of(names.name_pairs(df), "name_a", "name_b") == want
    assert names.name_classes(df.where("false")).count() == 0


# --- 5 -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "held, described, wanted",
    [
        ("Toward compact reading with thermogravimetry", "Towrd compact reading with thermogravimetry", "title_near"),
        ("Toward compact reading with thermogravimetry", "Toward reading compact with thermogravimetry", "title_near"),
        ("Toward compact reading with thermogravimetry", "Toward compact reading", "title_cut"),
        ("Toward compact reading with thermogravimetry", "Toward compact reading with thermogravimetry: a reply", "title_other"),
        ("Toward compact reading with thermogravimetry", "Toward compact tremor with thermogravimetry", "title_other"),
        ("Hybrid coupling and reading in anvils", "Hybrid couplingand reading in anvils", "title_same"),  # a lost blank
    ],
)
def test_titles(held, described, wanted):
    assert matching._titles(matching.title_parts(held)[0], matching.title_parts(described)[0]) == wanted


def test_title_parts():
    assert matching.title_parts("A study, Part III") == (["a", "study"], "iii", "")
    assert matching.title_parts("Reply to comment on: A study") == (["a", "study"], "", "reply to comment on")
    assert matching.title_parts(None) == ([], "", "")


def test_blocking_misses_no_short_title_with_typos():
    rng = random.Random(4)
    words = [a + b for a in "ba de fi go ku lo ma ne pi ru sa to".split() for b in "lin mar nox pel rus tan vik zor".split()]
    record = lambda ws, year: ("x", "".join(ws), ws, "", "", ["ana keller"], year, None, None, None, None)
    pairs = []
    for n, typos in ((1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (6, 1)):
        for _ in range(100):
            title = rng.sample(words, n)
            other = list(title)
            for i in rng.sample(range(n), typos):
                other[i] = other[i][:2] + "q" + other[i][3:]
            pairs.append((record(title, 2001), record(other, 2001 + rng.randint(-1, 1))))
    near = [(a, b) for a, b in pairs if matching.features(a, b)[matching.FEATURES.index("title_near")]]
    keys = lambda r, described: set(matching.Keys().of([r], described)[1].tolist())
    met = [(a, b) for a, b in near if keys(a, False) & keys(b, True)]
    assert len(near) == len(pairs) and len(met) == len(near)


def test_matching_of_made_up_sources(spark):
    import datetime

    rng = random.Random(9)
    at = datetime.datetime(2024, 1, 1)
    words = [a + b for a in "ba de fi go ku lo ma ne pi ru sa to".split() for b in "lin mar nox pel rus tan vik zor".split()]
    surnames = [w.capitalize() + "ard" for w in rng.sample(words, 40)]
    held, described, true = [], [], set()
    for i in range(240):
        title, year, vol, page, author = " ".join(rng.sample(words, 6)), rng.randint(1980, 2020), str(rng.randint(1, 60)), rng.randint(1, 9000), rng.choice(surnames)
        held.append((i, i, at, title, [f"{author}, A."], f"{year}-05-01", "Gildesh Journal of Glaciology A", None, vol, f"{page}-{page + 9}", "x"))
        if i % 2 == 0:
            t = title[: len(title) * 3 // 4] if i % 3 == 0 else None if i % 10 == 0 else title.upper()
            described.append((f"d{i}", t, [author], year + (i % 4 == 0), "Gildesh J. Glaciol. A", f"Vol. {vol}", f"pp. {page}", 1))
            true.add((i, f"d{i}"))
        elif i % 5 == 0:  # the same title by others elsewhere
            described.append((f"d{i}", title, [rng.choice(surnames) + "ov"], year - 9, "Gildesh J. Glaciol. B", str(int(vol) + 1), str(page + 77), 1))
    h = spark.createDataFrame(held, "item_id bigint, seq int, synced_at timestamp, title string, creators array<string>, date string, publication string, journal_abbreviation string, volume string, pages string, confidence string")
    d = spark.createDataFrame(described, "key string, title string, creators array<string>, year int, venue string, volume string, pages string, id int")
    j = spark.createDataFrame(JOURNALS, "journal_id int, name string, abbreviation string")
    got = set(pairs_of(matching.matched(h, d, j), "item_id", "described_key"))
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.95 * len(got)
    assert matching.matched(h.where("false"), d, j).count() == 0


# --- 6 -----------------------------------------------------------------------


@pytest.mark.parametrize("copies", [False, True])
def test_a_passage_in_a_third_of_the_documents_is_no_stock(spark, copies):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passages = [(i, text(40)) for i in range(4)]
    leaking = f"{text(30)} {passages[0][1]} {text(30)}"
    docs = [(i, leaking if copies else f"{text(30)} {passages[0][1]} {text(30)}") for i in range(40)] + [(i, text(100)) for i in range(40, 119)] + [(119, f"{text(40)} {passages[0][1]} {text(9)}")]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "eval_id bigint, passage string")
    assert pairs_of(leaks.leaks(d, e), "doc_id", "eval_id") == [(i, 0) for i in [*range(40), 119]]


def test_a_passage_copied_into_many_documents_is_found_in_each(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [(i, text(50)) for i in range(5)]
    docs = [(i, f"{text(40)} {passages[0][1]} {text(40)}" if i < 30 else text(120)) for i in range(1000)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "eval_id bigint, passage string")
    assert pairs_of(leaks.leaks(d, e), "doc_id", "eval_id") == [(i, 0) for i in range(30)]


def test_edited_passages_are_found(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(2000)]
    some = lambda n: [vocab[rng.randrange(40 if rng.random() < 0.4 else 2000)] for _ in range(n)]
    passages = [(i, some(60)) for i in range(40)]
    docs, want = [], set()
    for i in range(400):
        words = list(passages[i % 40][1])
        if i < 40:  # every fourth word is another
            words = [w if n % 4 != 3 else "new" + w for n, w in enumerate(words)]
        else:  # a stretch with words changed, left out and put in
            at, size = rng.randint(0, 30), rng.randint(24, 30)
            words = [x for w in words[at : at + size] for x in rng.choices(([w], ["new" + w], [], [w, "more"]), (85, 6, 5, 4))[0]]
        docs.append((i, " ".join([*some(rng.randint(0, 90)), *words, *some(60)])))
        want.add((i, i % 40))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in passages], "eval_id bigint, passage string")
    got = set(pairs_of(leaks.leaks(d, e), "doc_id", "eval_id"))
    assert {p for p in want if p[0] < 40} <= got and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_the_subsequence_and_the_inverted_file():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, (50, leaks.SIDE)), rng.integers(1, 9, (50, leaks.SIDE))
    a[:9, 40:], b[5:20, 30:] = 0, -1

    def brute(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            last = list(row)
            for j, v in enumerate(y, 1):
                row[j] = last[j - 1] + 1 if w == v else max(last[j], row[j - 1])
        return row[-1]

    assert leaks.common_subsequence(a, b).tolist() == [brute(x, y) for x, y in zip(a.tolist(), b.tolist())]
    v = rng.standard_normal((60, 24)).astype(np.float32)[rng.integers(0, 60, 1500)] + 0.5 * rng.standard_normal((1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows, found = leaks.Lists(v, 16).search(v[:300], 0.5)
    dense = set(map(tuple, np.argwhere(v[:300] @ v.T >= 0.5)))
    assert set(zip(rows, found)) <= dense and len(set(zip(rows, found))) >= 0.95 * len(dense)


def test_leaks_equal_the_cases_made(spark):
    rng = random.Random(4)
    vocab = [a + b + c for a in "ba ce di fo gu".split() for b in "la me ni po ru".split() for c in "ks nt rd".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    stock = "This page was scanned from the shelf copy and may contain marks that are not part of the text."
    passages = [(i, " ".join(rng.choice(vocab) + str(i) if k % 3 == 0 else rng.choice(vocab) for k in range(50)) + (" " + stock if i % 2 else "")) for i in range(12)]
    docs, want = [], set()
    for i in range(120):
        body = text(150)
        k, kind = i % 12, i // 12
        w = passages[k][1].split()[:50]
        inside = {0: " ".join(w), 1: " ".join(w[10:26]), 2: " ".join(w[5:14]), 3: " ".join(w).upper(), 4: "\n".join(w), 5: " ".join(x if n % 9 else x + " [sic]" for n, x in enumerate(w)), 6: stock}.get(kind, "")
        docs.append((i, f"{body} {inside} {text(120)} {stock}", "x"))
        if kind in (0, 1, 3, 4, 5):
            want.add((i, k))
    docs += [(1000 + i, f"{text(60)} {stock}", "x") for i in range(400)]  # a passage in 1.5 % of all documents would be stock itself
    docs += [(900, "", "x"), (901, None, "x"), (None, passages[0][1], "x"), (902, text(40_000) + " " + passages[3][1], "x")]
    want.add((902, 3))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, words string")
    e = spark.createDataFrame(passages + [(99, None)], "eval_id bigint, passage string")
    assert set(pairs_of(leaks.leaks(d, e), "doc_id", "eval_id")) == want
    assert leaks.leaks(d.where("false"), e).count() == leaks.leaks(d, e.where("false")).count() == 0
    with pytest.raises(ValueError, match="most_words"):
        leaks.leaks(d, e, most_words=10)


# --- 7 -----------------------------------------------------------------------


def test_mixture_meets_its_targets(spark):
    rng = random.Random(2)
    docs = [(i, "a" if i % 3 else "b", " ".join(["word"] * rng.randint(5, 80)) + f" {i}", "x") for i in range(900)]
    docs += [(5000, "a", docs[0][2], "x"), (5001, None, "t", "x"), (5002, "zzz", "t", "x"), (5003, "a", None, "x"), (5004, "a", "", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(d, t).cache()
    got = {r.source: r for r in mixing.shares(mix, t).collect()}
    assert abs(got["a"].share - 1 / 3) < 0.01 and abs(got["b"].share - 2 / 3) < 0.01 and got["none"].tokens == 0
    assert mix.agg(F.max(F.col("copies"))).first()[0] <= 3 and mix.where("source = 'a' and copies > 1").count() == 0
    assert mix.where("doc_id >= 5000").count() == 0
    with pytest.raises(ValueError, match="most_targets"):
        mixing.mixture(d, t, most_targets=2)
    assert mixing.mixture(d.where("false"), t).count() == mixing.mixture(d, t.where("false")).count() == 0


def test_token_counts_are_the_tokenizer_s(spark):
    counter = mixing._counter(pathlib.Path(mixing.VOCABULARY).read_bytes())
    d = spark.createDataFrame([(1, "a", "naïve trade-offs <|endoftext|>"), (2, "a", None), (3, "a", "")], "doc_id bigint, source string, text string")
    assert {r.doc_id: r.tokens for r in mixing.token_counts(d).collect()} == {1: counter("naïve trade-offs <|endoftext|>"), 2: 0, 3: 0}


# --- 8 -----------------------------------------------------------------------

PROSE = "The most important limitation of this study is the passive adhesion of the plasma sheaths. From then on it has long been argued that the analysis had to rely on other methods, which is in line with what others have written. "
TEXTS = [
    (PROSE, "prose"),
    (PROSE.upper(), "prose"),
    (PROSE.replace(" ", "  ").replace(". ", ".\n"), "prose"),
    (PROSE * 4 + "\n[1] Doe, J. A title. 1999.\n[2] Roe, J. Other title. 2001.", "prose"),
    ("Nach 114 Tagen wurde die Messung mit Wägung wiederholt, und das Ergebnis blieb gleich, weil es nicht überall möglich ist.", "prose"),
    ("Ce n'est pas la première fois que les cartes anciennes sont étudiées par diffraction, mais la question reste ouverte dans ce cas.", "prose"),
    ("- spectral shielding\n- random forests\n- porous literacy\n- broadband reading\n- crystalline sintering", "other"),
    ("6.20\n±0.74\n—\n4.85\n±0.08\nranking\n0.32\n724\n492\n6.01", "other"),
    (" ".join(PROSE), "other"),
    ("Downloaded from shelf.example on 25 May 0\n" * 20, "other"),
    ("Home\nCite\nExport\nLog out\nNext >\n< Previous\nHelp\nShare", "other"),
    ("", "other"),
    (None, "other"),
    ("—", "other"),
    ("(cid:36) (cid:67) (cid:108) " * 30, "other"),
]


@pytest.mark.parametrize("text, wanted", TEXTS)
def test_profiles(text, wanted):
    assert (quality.measure([text])["profile"][0] == "prose") == (wanted == "prose")


FOREIGN = {
    "it": "La ricerca sulla storia delle città italiane ha mostrato che il commercio non era limitato alle grandi famiglie. Molti documenti sono stati trovati negli archivi, ma pochi sono stati studiati con attenzione dagli storici.",
    "pt": "A pesquisa sobre a história das cidades mostrou que o comércio não era limitado às grandes famílias. Muitos documentos foram encontrados nos arquivos, mas poucos foram estudados com atenção pelos historiadores.",
    "nl": "Het onderzoek naar de geschiedenis van de steden heeft laten zien dat de handel niet beperkt was tot de grote families. Veel documenten zijn in de archieven gevonden, maar weinig zijn met aandacht bestudeerd door historici.",
    "sv": "Forskningen om städernas historia har visat att handeln inte var begränsad till de stora familjerna. Många dokument har hittats i arkiven, men få har studerats med uppmärksamhet av historiker under de senaste åren.",
    "pl": "Badania nad historią miast pokazały, że handel nie był ograniczony do wielkich rodzin. Wiele dokumentów znaleziono w archiwach, ale tylko nieliczne zostały uważnie zbadane przez historyków w ostatnich latach.",
    "ru": "Исследование истории городов показало, что торговля не была ограничена крупными семьями. Многие документы были найдены в архивах, но только некоторые из них были внимательно изучены историками за последние годы.",
    "zh": "对城市历史的研究表明，贸易并不局限于大家族。许多文件是在档案馆中发现的，但只有少数文件得到了历史学家的认真研究。近年来，研究人员开始使用新的方法来分析这些材料，并取得了一些重要的结果。",
    "ja": "都市の歴史に関する研究は、商業が大きな家族に限られていなかったことを示している。多くの文書が公文書館で発見されたが、歴史家によって注意深く研究されたものは少ない。近年、新しい方法が使われるようになった。",
    "el": "Η έρευνα για την ιστορία των πόλεων έδειξε ότι το εμπόριο δεν περιοριζόταν στις μεγάλες οικογένειες. Πολλά έγγραφα βρέθηκαν στα αρχεία, αλλά λίγα έχουν μελετηθεί με προσοχή από τους ιστορικούς τα τελευταία χρόνια.",
    "et": "Linnade ajaloo uurimine on näidanud, et kaubandus ei piirdunud suurte peredega. Paljud dokumendid leiti arhiividest, kuid ajaloolased on neist vaid väheseid tähelepanelikult uurinud. Viimastel aastatel hakati kasutama uusi meetodeid.",
    "fi": "Kaupunkien historian tutkimus on osoittanut, että kauppa ei rajoittunut suuriin perheisiin. Monet asiakirjat löydettiin arkistoista, mutta vain harvoja niistä on tutkittu huolellisesti. Viime vuosina on alettu käyttää uusia menetelmiä.",
    "ar": "أظهرت الأبحاث حول تاريخ المدن أن التجارة لم تكن مقتصرة على العائلات الكبيرة. تم العثور على العديد من الوثائق في الأرشيف، لكن القليل منها درس بعناية من قبل المؤرخين في السنوات الأخيرة، وقد بدأ الباحثون في استخدام طرق جديدة.",
    "hu": "A városok történetének kutatása megmutatta, hogy a kereskedelem nem korlátozódott a nagy családokra. Sok dokumentumot találtak a levéltárakban, de csak keveset tanulmányoztak figyelmesen a történészek az elmúlt években.",
    "tr": "Şehirlerin tarihi üzerine yapılan araştırmalar, ticaretin büyük ailelerle sınırlı olmadığını göstermiştir. Arşivlerde çok sayıda belge bulunmuş, ancak bunların çok azı tarihçiler tarafından dikkatle incelenmiştir.",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_prose_of_any_language_is_prose(lang):
    assert quality.measure([FOREIGN[lang]])["profile"] == ["prose"]


def test_lists_of_unknown_words_are_no_prose():
    assert "prose" not in quality.measure(["\n".join(f"{w} {v}" for w, v in zip(FOREIGN["et"].split(), FOREIGN["hu"].split())), "; ".join(FOREIGN["el"].split())])["profile"]


def test_kinds_by_labelled_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    make = {"list": lambda: "\n".join(f"{word()} {word()}" for _ in range(20)), "table": lambda: "\n".join("\t".join(str(rng.random())[:5] for _ in range(6)) for _ in range(12)), "junk": lambda: " ".join(rng.choice("xyzq#@|~") for _ in range(80))}
    rows = [(i, make[k](), k) for i, k in enumerate(["list", "table", "junk"] * 20)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows[:30]] + [(1, None), (None, "list"), (999, "junk"), (2, "prose")], "doc_id bigint, label string")
    got = {r.doc_id: r.profile for r in quality.statistics(d, labels).collect()}
    assert all(got[i] == k for i, _, k in rows[30:])
    assert quality.statistics(d, labels.where("false")).count() == len(rows)


def test_statistics(spark):
    d = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(TEXTS)] + [(0, TEXTS[0][0], "x"), (77, "word " * 300_000, "x")], "doc_id bigint, text string, profile string")
    rows = {r.doc_id: r for r in quality.statistics(d).collect()}
    assert len(rows) == len(TEXTS) + 1 and quality.statistics(d).count() == len(TEXTS) + 2
    assert rows[0].n_words == len(PROSE.split()) and rows[0].language == "en" and rows[4].language == "de" and rows[5].language == "fr"
    assert (rows[11].n_words, rows[11].language, rows[11].profile) == (0, None, "junk") and rows[77].n_words == 300_000
    assert {r.doc_id for r in quality.not_prose(d).collect()} >= {i for i, (_, w) in enumerate(TEXTS) if w == "other"}
    assert quality.statistics(d.where("false")).count() == 0


def test_divergence_is_symmetric_and_bounded():
    import numpy as np

    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.0, 0.0, 1.0]])
    assert quality.divergence(p, q)[0, 0] == pytest.approx(1.0) and quality.divergence(p, p)[0, 0] == 0.0


# --- shared ------------------------------------------------------------------


def test_edit_and_name_distances():
    assert textnorm.edits("quorvin", "quovrin", 2) == 1 and textnorm.edits("abc", "xyz", 1) == 2 and textnorm.edits("", "ab", 3) == 2
    assert textnorm.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and textnorm.jaro_winkler("", "a") == 0.0


def test_queries_and_sql(spark, sf):
    import duckdb

    from litmesh.llm import queries as Q

    sql = Q.oracle_sql()
    con = duckdb.connect()
    for t in ("edges", "items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in sql:
        df = Q.queries()[name](spark, sf)
        cols = sorted(df.columns)
        rel = con.execute(sql[name])
        at = [[x[0] for x in rel.description].index(c) for c in cols]
        plain = lambda v: round(v, 4) if isinstance(v, float) else v
        assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_matching_crowded_blocks_drop_no_pair_that_can_match(spark):
    import numpy as np

    M, letters, rng = matching, textnorm.letters, random.Random(6)
    names = ["wilson a", "willson a", "keller b", "kellar b", "okafor c", "tanaka d"]  # some but for a letter alike
    titles = ["spectral gaps of random walks on trees", "spectral gaps of random walk on trees", "a note on sparse graph limits", "folding of long chains in solvents"]

    def records(side, n):
        some = lambda x: x if rng.random() < 0.7 else None
        out = []
        for i in range(n):
            ws, part, lead = M.title_parts(title := rng.choice(titles))
            venue = some(rng.choice(["annals of graphs", "annals of graph", "chain letters"]))
            out.append((f"{side}{i:03d}", letters(title), ws, part, lead, [rng.choice(names)] if rng.random() < 0.8 else [], some(rng.choice([1990, 1991, 2005])), venue, rng.choice([None, 7]) if venue == "annals of graphs" else None, some(rng.choice([3, 4])), some(rng.choice(["11", "12"]))))
        return out

    # The last of each side: one title and author, misspelt, each with attributes that the other lacks.
    a = records("a", 60) + [("a", "x", "spectral gaps of random walks on trees".split(), "", "", ["wilson a"], 1990, "chain letters", None, None, None)]
    b = records("b", 60) + [("b", "x", "spectral gaps of random walks on trees".split(), "", "", ["willson"], None, None, None, 4, "12")]
    held, other = spark.createDataFrame(a, M.SCHEMA), spark.createDataFrame(b, M.SCHEMA)
    every = {tuple(r) for r in M.candidates(held, other, block=10**9).collect()}
    found, crowd = M._candidates(held, other, 0, 7)
    found = {tuple(r) for r in found.collect()}
    assert ("a", "b") in every - found
    by = {r[0]: r for r in a + b}
    weights = [-1.95, 1.12, 0.77, 1.08, -3.63, -2.6, -0.03, 1.53, -1.37, -1.16, 1.37, 0.1, -1.91, 1.3, 0.0, -1.31, 0.82, -1.71, 1.63, -2.92, 1.8, 1.84]
    for w in (weights, [-3.0] + [rng.uniform(-2, 2) for _ in M.FEATURES]):
        w, least = np.array(w), 1.05
        more = M.rest(crowd, w, least, piece=7)
        more = set() if more is None else {tuple(r) for r in more.collect()}
        score = {p: w[0] + float(np.dot(w[1:], M.features(by[p[0]], by[p[1]]))) for p in every}
        assert {p for p in every if score[p] >= least} <= found | more
        assert more <= every
        if w[0] == weights[0]:
            assert ("a", "b") in more and score["a", "b"] >= least and len(more - found) < len(every - found)
    assert M.rest(crowd, np.array(weights), 50.0) is None
