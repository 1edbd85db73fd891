"""Problem 4: variant spellings of names typed by people.

Method: a name is read as a set of sorted words, initials and shortened words (nicknames by table,
umlauts and their transcriptions alike, particles and order without weight). Names with all words are
blocked by the phonetic codes of their sorted words: one block has the codes of all words, so that
every word may be misspelt as long as it sounds the same; in the others all words but one are equal,
and the code of that one is the same but for one position. In a block the differing words are compared
by Jaro-Winkler and edit distance. Accepted pairs are clustered by connected components. Then initials,
shortened names and bare surnames join the one cluster that fits them; where several fit, none is taken.

Blocks hold distinct readings, not rows: a name in a third of all rows is one reading.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.llm.groups import components, group_pairs
from litmesh.llm.textnorm import edits, jaro_winkler, plain
from litmesh.session import stage

#: Short forms of given names: fixed values.
NICKNAMES = dict(
    x.split(":")
    for x in """alex:alexander sasha:alexander andy:andrew tony:anthony bea:beatrice ben:benjamin bob:robert rob:robert bobby:robert cathy:katherine
    charlie:charles chris:christopher dan:daniel dave:david dot:dorothy dottie:dorothy dora:theodora ed:edward eddie:edward ellie:eleanor fred:frederick freddy:frederick
    gabi:gabriela greg:gregory hattie:henrietta harry:henry inge:ingrid jack:john jim:james jimmy:james joe:joseph jon:jonathan kate:katherine kathy:katherine katie:katherine
    ken:kenneth larry:lawrence len:leonard leo:leonard liv:olivia liz:elizabeth lizzie:elizabeth beth:elizabeth betty:elizabeth maggie:margaret peggy:margaret matt:matthew
    mike:michael mick:michael mina:wilhelmina nick:nicholas pat:patricia patty:patricia peter:peter phil:philip becky:rebecca rich:richard dick:richard rick:richard ron:ronald
    sam:samuel steve:stephen sue:susan ted:theodore tim:timothy tom:thomas tommy:thomas uli:ulrich vicky:victoria vince:vincent walt:walter will:william bill:william willy:william""".split()
)
#: Words between given name and surname that move, vanish or change case: fixed values.
PARTICLES = frozenset("van von der den de la le di da del della du dos das ter ten zu zur af av el al y e the".split())
#: Kinds of organisations and the stems of their short forms: fixed values.
KINDS = {"institute": ("inst",), "agency": ("ag",), "centre": ("cent", "ctr"), "laboratory": ("lab",), "consortium": ("cons",), "society": ("soc",), "university": ("univ",), "department": ("dep", "dpt"), "office": ("off",), "council": ("counc", "cncl"), "association": ("assoc",), "foundation": ("found",), "committee": ("comm", "cttee"), "ministry": ("min",), "bureau": ("bur",), "group": ("gr",)}
LINKING = frozenset("for of the and on in".split())
WORDS = re.compile(r"[^\W\d_]+\.?")
CONSONANTS = str.maketrans({**dict.fromkeys("bfpvw", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6", **dict.fromkeys("aeiouyh", "")})
FOLD = re.compile(r"oe|ae|ue|aa|ss")
FOLDED = {"oe": "o", "ae": "a", "ue": "u", "aa": "a", "ss": "s"}


def fold(word: str) -> str:
    return FOLD.sub(lambda m: FOLDED[m[0]], plain(word))


SHORT = {fold(k): fold(v) for k, v in NICKNAMES.items()}


def kind_of(word: str) -> str | None:
    for kind, stems in KINDS.items():
        if len(word) >= 3 and (kind.startswith(word) or any(word.startswith(s) for s in stems)) and (len(word) <= 6 or edits(word, kind, 2) <= 2):
            return kind
    return None


def reading(name: str) -> tuple[str, str, str, str]:
    """(kind, words, short, mids): kind p(erson) or o(rganisation); sorted whole words joined by blanks;
    the shortened or initial given name, '' if all words are whole; further initials, of an organisation its acronym."""
    bare = re.sub(r"\([^)]*\)", " ", name).strip()
    tokens = WORDS.findall(bare)
    lower = [plain(t.rstrip(".")) for t in tokens]
    if (LINKING & {w for w in lower if w != "the"} and len(tokens) > 2) or (len(tokens) > 2 and any(len(w) > 2 and kind_of(w) for w in lower[1:2])):
        words = [w for w in lower if w not in LINKING]
        at = next((i for i, w in enumerate(words) if kind_of(w)), None)
        if at is not None and len(words) > 2:
            place = words[-1] if at == 0 and "," in bare else words[0]
            rest = [w for i, w in enumerate(words) if i != at and w != place]
            kind = kind_of(words[at]) or ""
            return "o", " ".join([fold(place), kind, *sorted(rest)]), "", kind[0] + "".join(w[0] for w in rest)
    head, comma, tail = bare.partition(",")
    given_part = set(range(len(WORDS.findall(head)), len(tokens))) if comma else set()
    long, initials, short = [], [], ""
    for i, token in enumerate(tokens):
        word = token.rstrip(".")
        if plain(word) in PARTICLES and (len(word) > 1) and not (word.isupper() and len(word) == 2 and i == len(tokens) - 1 and not bare.isupper()):
            continue
        if len(word) == 1:
            initials.append(plain(word))
        elif word.isupper() and len(word) <= 3 and not bare.isupper() and i == len(tokens) - 1 and not comma:
            initials += list(plain(word))
        elif token.endswith(".") and len(word) <= 4 and (not comma or i in given_part):
            short = fold(word)
        else:
            w = fold(word)
            long.append(SHORT.get(w, w))
    if not short and initials and (len(long) < 2 or (comma and not any(len(tokens[i].rstrip(".")) > 1 for i in given_part)) or (not comma and _initials_first_or_last(tokens))):
        short, initials = initials[0], initials[1:]
    return "p", " ".join(sorted(long)), short, "".join(initials)


def _initials_first_or_last(tokens: list[str]) -> bool:
    """Whether a name without comma opens with an initial, or closes with initials in one word."""
    first, last = tokens[0].rstrip("."), tokens[-1].rstrip(".")
    return len(first) == 1 or (last.isupper() and len(last) <= 3)


def phonetic(word: str) -> str:
    """The classes of a word's consonants."""
    return word.translate(CONSONANTS)


def sounds(word: str) -> str:
    """The word's classes, neighbours of one class once."""
    return "".join(c for c, _ in itertools.groupby(phonetic(word)))


def keys(kind: str, words: str) -> list[str]:
    """Blocks of a name with all words: the codes of all words, and the rest as it is beside the phonetic code of one word but for a position."""
    tokens = words.split()
    out = {f"o#{tokens[0]}|{tokens[1]}"} if kind == "o" else set()  # the topic's words may all be shortened
    if kind == "p" and len(tokens) > 1:
        out.add("p&" + " ".join(sorted(map(sounds, tokens))))
    for i, token in enumerate(tokens):
        rest = " ".join(tokens[:i] + tokens[i + 1 :])
        if kind == "o" and i == 1:
            continue
        code = phonetic(token)
        for c in {code, *(code[:j] + code[j + 1 :] for j in range(len(code)))}:
            out.add(f"{kind}{i if kind == 'o' else ''}|{rest}|{c}")
    return sorted(out)


def _readings(batches):
    for batch in batches:
        names = batch.column(0).to_pylist()
        found = [reading(n) for n in names]
        cols = [pa.array(x, pa.string()) for x in (zip(*found) if found else [[]] * 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["name", "kind", "words", "short", "mids"])


def _keys(batches):
    """(node, block) of nodes "kind|words"."""
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        found = [keys(*n.split("|", 1)) for n in nodes]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, ks in zip(nodes, found) for _ in ks], pa.string()), pa.array([k for ks in found for k in ks], pa.string())], ["node", "key"])


def _same_topic(p: str, q: str) -> bool:
    return min(len(p), len(q)) >= 3 and (p.startswith(q) or q.startswith(p)) or min(len(p), len(q)) >= 4 and edits(p, q, 2) <= (1 if max(len(p), len(q)) < 8 else 2)


def _like(p: str, q: str) -> bool:
    return min(len(p), len(q)) >= 4 and edits(p, q, 2) <= (1 if max(len(p), len(q)) < 8 else 2) and jaro_winkler(p, q) >= 0.85


def differing(x: list[str], y: list[str]) -> list[tuple[str, str]] | None:
    """The words in which two sorted readings differ, each beside the word it may stand for; None if they differ by more than
    misspelt words. One word may differ as `_like` says, further ones only if they sound the same and begin alike."""
    left, right = list(x), list(y)
    for w in x:
        if w in right:
            left.remove(w)
            right.remove(w)
    if not left or len(left) != len(right):
        return None
    if len(left) == 1:
        return [(left[0], right[0])] if _like(left[0], right[0]) else None
    out = []
    for p in left:
        fit = [q for q in right if p[0] == q[0] and sounds(p) == sounds(q) and _like(p, q)]
        if not fit:
            return None
        out.append((p, max(fit, key=lambda q: jaro_winkler(p, q))))
        right.remove(out[-1][1])
    return out


def _compare(batches):
    """(a, b) readings of one block -> those whose differing words are alike: (a, b, words of a, words of b)."""
    for batch in batches:
        out: list[tuple] = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = a.split("|", 1)[1].split(), b.split("|", 1)[1].split()
            if a[0] == b[0] == "o" and x[:2] == y[:2]:
                if len(x) == len(y) and all(_same_topic(p, q) for p, q in zip(x[2:], y[2:])):
                    out.append((a, b, [], []))
                continue
            if (pairs := differing(x, y)) is not None:
                out.append((a, b, [p for p, _ in pairs], [q for _, q in pairs]))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))], ["a", "b", "ps", "qs"])


def _misspelt(coded: DataFrame) -> DataFrame:
    """(a, b, ps, qs) of (node, key): pairs of a block that could be one name, compared once each.

    Before the pairs are shuffled the JVM drops those whose one differing word differs by more than two
    edits can make; organisations, whose topic may be shortened, all pass."""
    pairs = group_pairs(coded, "key", "node")
    of = lambda c: F.split(F.element_at(F.split(c, r"\|"), 2), " ")
    only = lambda c, d: F.array_except(of(c), of(d))
    apart = F.levenshtein(F.array_join(only("a", "b"), " "), F.array_join(only("b", "a"), " "))  # words may have changed places
    pairs = pairs.where(F.col("a").startswith("o|") | (F.size(only("a", "b")) > 1) | (apart <= 4)).distinct()
    return pairs.mapInArrow(_compare, "a string, b string, ps array<string>, qs array<string>")


def name_classes(names: DataFrame, column: str = "name", *, rare: int = 3) -> DataFrame:
    """(name, class): distinct names, each with the class of its person or organisation.

    A misspelt word stands beside the right one: of two words that differ by few letters, at least one
    in `rare` of the rarer one's readings must have a namesake with the other word, or it must occur
    in a twentieth of the other's readings at most. Both are shares, so a table's size does not
    matter. Nulls are left out; a name without letters is a class of its own. The class is the least
    name that belongs to it.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    read = stage(distinct.mapInArrow(_readings, "name string, kind string, words string, short string, mids string"))
    node = F.concat_ws("|", "kind", "words")
    whole = (F.col("short") == "") & (F.col("words").contains(" "))
    full = stage(read.where(whole).select(node.alias("node"), "mids").distinct())
    nodes = full.select("node").distinct()
    part = F.split(F.element_at(F.split("node", r"\|"), 2), " ")

    # Misspelt words: each pair of words of two names must be judged the same word.
    alike = stage(_misspelt(nodes.mapInArrow(_keys, "node string, key string")))
    uses = stage(nodes.select(F.explode(F.array_distinct(part)).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    use = lambda c, n: uses.select(F.col("w").alias(c), F.col("n").alias(n))
    beside = alike.select("a", "b", F.explode(F.arrays_zip("ps", "qs")).alias("w")).select("a", "b", F.least("w.ps", "w.qs").alias("p"), F.greatest("w.ps", "w.qs").alias("q"))
    met = beside.groupBy("p", "q").agg(F.count("*").alias("met")).join(use("p", "np"), "p").join(use("q", "nq"), "q")
    few, many = F.least("np", "nq"), F.greatest("np", "nq")
    same = met.where((F.col("met") * rare >= few) | (few <= many * 0.05)).select("p", "q")
    doubted = beside.join(same, ["p", "q"], "left_anti").select("a", "b").distinct()
    typed = alike.select("a", "b").join(doubted, ["a", "b"], "left_anti")
    linked = components(typed)
    root = stage(nodes.join(linked, nodes["node"] == linked["node"], "left").select(nodes["node"], F.coalesce("root", nodes["node"]).alias("root")))

    # Persons by surname and the given name's first letter: each word may be the given name.
    people = full.where(F.col("node").startswith("p|")).join(root, "node")
    roles = people.select("root", "mids", F.explode(F.array_distinct(part)).alias("given"), part.alias("ws"))
    roles = roles.select("root", "given", F.array_join(F.array_except("ws", F.array("given")), " ").alias("surname"), F.substring("given", 1, 1).alias("i"), "mids")
    held = stage(roles.where("surname <> ''").groupBy("surname", "i", "root").agg(F.collect_set("given").alias("givens"), F.array_distinct(F.flatten(F.collect_set(F.split("mids", "")))).alias("mids")))
    asked = read.where((F.col("short") != "") & (F.col("words") != "")).select("name", F.col("words").alias("surname"), F.substring("short", 1, 1).alias("i"), "short", "mids")
    # Names that ask for the same are one request, so a surname's classes meet its few kinds of initials and not its names.
    request = ["surname", "i", "short", "mids"]
    met = asked.select(request).distinct().join(held.withColumnRenamed("mids", "known"), ["surname", "i"])
    met = met.where((F.length("short") == 1) | F.exists("givens", lambda g: g.startswith(F.col("short"))))
    known = F.filter("known", lambda x: x != "")
    mine = F.filter(F.split("mids", ""), lambda x: x != "")
    fit = F.when(F.arrays_overlap(mine, known), 2).when((F.size(mine) == 0) | (F.size(known) == 0), 1).otherwise(0)
    met = met.withColumn("fit", fit).where("fit > 0")
    one = met.groupBy(*request).agg(F.max(F.struct("fit", "root")).alias("m"), F.min(F.struct(-F.col("fit"), "root")).alias("l"))
    one = stage(one.select(*request, F.when((F.col("m.fit") == -F.col("l.col1")) & (F.col("m.root") == F.col("l.root")), F.col("m.root")).alias("root")))
    answered = asked.join(one, request, "left").select("name", "root")
    joined = answered.where("root is not null").select("name", "root")
    # Initials that meet no whole name are one person for each surname and first initial.
    lone = asked.join(one, request, "left_anti")
    # Some are an organisation's place and acronym.
    acronyms = read.where((F.col("kind") == "o") & whole).select(F.get(F.split("words", " "), 0).alias("surname"), F.col("mids").alias("acronym"), node.alias("node")).join(root, "node")
    acronyms = acronyms.groupBy("surname", "acronym").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").drop("other")
    lone = stage(lone.withColumn("acronym", F.concat("short", "mids")).join(acronyms, ["surname", "acronym"], "left"))
    joined = joined.unionByName(lone.where("root is not null").select("name", "root"))
    left = lone.where("root is null").select("name", F.concat(F.lit("i|"), "surname", F.lit("|"), "i").alias("root"))
    by_whole = read.where(whole).select("name", node.alias("node")).join(root, "node").select("name", "root")
    classed = stage(by_whole.unionByName(joined).unionByName(left))

    # Bare surnames join the surname's only class, misspelt ones that of the one surname a letter away.
    surnames = held.select("surname", "root").distinct().unionByName(left.join(asked.select("name", "surname"), "name").select("surname", "root").distinct())
    only = surnames.groupBy("surname").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").select("surname", "root")
    bare = read.where((F.col("short") == "") & ~F.col("words").contains(" ") & (F.col("words") != "")).select("name", F.col("words").alias("surname"))
    bare = stage(bare.join(surnames.select("surname").distinct().withColumn("met", F.lit(True)), "surname", "left").join(only, "surname", "left"))
    words = surnames.where(~F.col("surname").contains(" ")).select("surname").unionByName(bare.select("surname")).distinct()
    coded = words.select(F.concat(F.lit("b|"), "surname").alias("node")).mapInArrow(_keys, "node string, key string")
    near = _misspelt(coded).select(F.element_at("ps", 1).alias("p"), F.element_at("qs", 1).alias("q"))
    near = near.where(F.levenshtein("p", "q") <= 2).select(F.col("p").alias("x"), F.col("q").alias("y"))
    near = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    stray = bare.where("met is null").groupBy("surname").agg(F.count("*").alias("n")).where("n = 1").select(F.col("surname").alias("x"))
    weight = surnames.groupBy("surname").agg(F.count("*").alias("c")).unionByName(bare.groupBy("surname").agg(F.count("*").alias("c"))).groupBy("surname").agg(F.sum("c").alias("c"))
    to = near.join(stray, "x").join(weight.select(F.col("surname").alias("y"), "c"), "y").groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select(F.col("x").alias("surname"), F.col("y").alias("right"))
    moved = to.join(only.select(F.col("surname").alias("right"), F.col("root").alias("its")), "right", "left").select("surname", F.coalesce("its", F.concat(F.lit("s|"), F.greatest("surname", "right"))).alias("its"), "right", F.col("its").isNull().alias("loose"))
    fallback = F.concat(F.lit("s|"), "surname")
    # Two bare strays that are each other's only neighbour meet under the greater of both.
    bare = bare.join(moved, "surname", "left").select("name", F.coalesce("root", "its", fallback).alias("root"))
    known_names = classed.unionByName(bare)
    rest = read.select("name").join(known_names.select("name"), "name", "left_anti").withColumn("root", F.concat(F.lit("n|"), "name"))
    every = stage(known_names.unionByName(rest))
    label = every.groupBy("root").agg(F.min("name").alias("class"))
    return every.join(label, "root").select("name", "class")


def name_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """(name_a, name_b): all pairs of different strings of one class, smaller first in byte order."""
    classes = stage(name_classes(names, column))
    return group_pairs(classes, "class", "name").select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def entered_names(items: DataFrame, works: DataFrame) -> DataFrame:
    """The distinct names of items.creators and works.first_author_in_zotero."""
    one = items.select(F.explode("creators").alias("name")).where("name is not null").distinct()
    return one.unionByName(works.select(F.col("first_author_in_zotero").alias("name")).where("name is not null").distinct()).distinct()
