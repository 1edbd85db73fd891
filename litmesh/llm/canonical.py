"""Problem 3: mapping freely entered values to a canonical list.

Method: an automaton over all canonical names and abbreviations finds the names that a value
mentions; mentions that overlap are settled longest first. The longest mention decides if the rest
of the value is only dressing (volume and issue numbers, carrier, legal form), or if the mention
stands by itself in the value: set off by a semicolon, slash, bracket or dash, introduced by words
like "published in", or followed by words like "by". Words that directly precede or follow a mention
otherwise make it another name, as does a series letter set off behind it. What no mention decides
goes to token-set similarity: every word of the value must agree with one word of the entry and the
other way round, as the same word, a shortened one, or one with few letters wrong.

The list is bounded (`most_entries`, checked): it is held by every task. The values are not. Words with
few letters wrong are looked up in an index of deletions, so a new word costs the same whatever
the length of the list; of the entries only those are compared that hold the value's rarest word.
"""

from __future__ import annotations

import itertools
import re
import uuid
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.llm.groups import latest
from litmesh.llm.textnorm import edits, plain

#: Words without weight in names, and words that only dress a name: fixed values.
LIGHT = frozenset("of the and for in on to de la".split())
DRESSING = frozenset("vol volume no number nr issue print online electronic resource inc ltd web cd rom".split())
#: Words that introduce a mention, that may follow one, and that make another name of one set off before them: fixed values.
LEADS = frozenset("published appeared printed cited quoted see in from cf via the also".split())
TRAILS = frozenset("by published from via see".split())
QUALIFIERS = frozenset("series ser section sect part pt supplement suppl letters".split())
NOT_WORD = re.compile(r"[^a-z0-9]+")
SET_OFF = re.compile(r"[;|/()\[\]\"“”]|\s[-–—]\s")
LONG = 7  # letters from which on a word may have two letters wrong


def words(value: str, join_hyphens: bool = False) -> list[str]:
    value = plain(value).replace("&", " and ").replace("'", "")
    if join_hyphens:
        value = re.sub(r"(?<=[a-z])-(?=[a-z])", "", value)
    return [w for w in NOT_WORD.split(value) if w and w not in LIGHT]


def undressed(tokens: list[str]) -> list[str]:
    return [w for w in tokens if w not in DRESSING and not w.isdigit()]


def _deletions(word: str) -> set[str]:
    """The word and what is left of it without one letter, of a long one without two: words at that distance share one."""
    out = {word}
    for n in range(1, 3 if len(word) >= LONG - 2 else 2):
        out |= {"".join(x) for x in itertools.combinations(word, len(word) - n)}
    return out


def _hashes(parts) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in parts), np.uint64)


class Matcher:
    """(entry id, name, abbreviation) rows -> the entry that a value stands for."""

    def __init__(self, entries: list[tuple[int, str | None, str | None]]):
        self.automaton, self.aliases = ahocorasick.Automaton(), {}
        by_text: dict[str, set[int]] = {}
        for key, *names in entries:
            for name in names:
                for joined in (False, True):
                    if name and (tokens := words(name, joined)):
                        by_text.setdefault(" ".join(tokens), set()).add(key)
        for text, keys in by_text.items():
            self.automaton.add_word(f" {text} ", (text, keys))
            self.aliases[text] = (tuple(text.split()), keys)
        if by_text:
            self.automaton.make_automaton()
        self.by_word: dict[tuple[int, str], list[str]] = {}  # by length and word
        for text, (tokens, _) in self.aliases.items():
            for w in set(tokens):
                self.by_word.setdefault((len(tokens), w), []).append(text)
        self.listed = sorted({w for _, w in self.by_word})
        self.known, self.longest = frozenset(self.listed), max(map(len, self.listed), default=0)
        parts = [_deletions(w) for w in self.listed]
        keys = np.concatenate([_hashes(p) for p in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.deletions, self.of_deletion = keys[order], np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]
        self.agreeing: dict[str, dict[str, float]] = {}

    def _close(self, word: str) -> set[str]:
        """Listed words that share a deletion with `word`: all at the distances that count, and some others."""
        keys = _hashes(_deletions(word))
        lo, hi = np.searchsorted(self.deletions, keys), np.searchsorted(self.deletions, keys, "right")
        return {self.listed[i] for a, b in zip(lo[hi > lo], hi[hi > lo]) for i in self.of_deletion[a:b]}

    def agreement(self, word: str) -> dict[str, float]:
        """Words of the list that `word` may stand for, each with a similarity."""
        if (known := self.agreeing.get(word)) is not None:
            return known
        out = {}
        if 3 <= len(word) <= 64:
            for w in self._close(word):
                if len(w) >= 3:
                    most = 1 if max(len(w), len(word)) < LONG else 2
                    if (d := edits(word, w, most)) <= most:
                        out[w] = 0.9 - 0.1 * d
        if len(word) > 1:
            out |= {word[:n]: 0.95 for n in range(3, min(len(word), self.longest + 1)) if word[:n] in self.known}
            stem = word[:-1] if len(word) > 3 and word[-1] == "s" else word
            at = bisect_left(self.listed, stem)
            while at < len(self.listed) and self.listed[at].startswith(stem):
                out[self.listed[at]] = 0.95
                at += 1
        if word in self.known:
            out[word] = 1.0
        if len(self.agreeing) > 200_000:
            self.agreeing.clear()
        self.agreeing[word] = out
        return out

    def mentions(self, tokens: list[str]) -> list[tuple[int, int, set[int]]]:
        """(first word, word behind the last, entries) of the names that stand in the words; overlapping ones longest first, then leftmost."""
        if not self.aliases:
            return []
        text = f" {' '.join(tokens)} "
        places, at = {0: 0}, 0  # of each blank the word that follows
        for i, t in enumerate(tokens):
            at += len(t) + 1
            places[at] = i + 1
        found = sorted(((places[end - len(t) - 1], places[end], k) for end, (t, k) in self.automaton.iter(text)), key=lambda x: (x[0] - x[1], x[0]))
        out, taken = [], bytearray(len(tokens))
        for a, b, k in found:
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, k))
        return out

    def mention(self, tokens: list[str]) -> tuple[float, int] | None:
        """The longest mention, if the rest is dressing."""
        for a, b, keys in self.mentions(tokens)[:1]:
            if len(keys) == 1 and not undressed([*tokens[:a], *tokens[b:]]):
                return 2.0, next(iter(keys))
        return None

    def embedded(self, value: str) -> tuple[float, int] | None:
        """The longest mention that stands by itself within the value; none if two entries are mentioned alike."""
        parts = [[w for w in NOT_WORD.split(plain(p).replace("&", " and ").replace("'", "")) if w] for p in SET_OFF.split(value)]
        parts = [p for p in parts if p]
        best: list[tuple[int, int]] = []
        for i, raw in enumerate(parts):
            at = [j for j, w in enumerate(raw) if w not in LIGHT]
            behind = parts[i + 1][0] if i + 1 < len(parts) else ""
            for a, b, keys in self.mentions([raw[j] for j in at]):
                before, after = raw[: at[a]], raw[at[b - 1] + 1 :]
                free = lambda w: w in DRESSING or w.isdigit()
                alone = all(w in LEADS or free(w) for w in before) and (not after or after[0] in TRAILS or all(map(free, after)))
                other = not after and (behind in QUALIFIERS or len(behind) == 1 and behind.isalpha())
                if alone and not other and len(keys) == 1:
                    best.append((b - a, next(iter(keys))))
        best.sort(reverse=True)
        if not best or any(n == best[0][0] and k != best[0][1] for n, k in best):
            return None
        return 1.5, best[0][1]

    def similar(self, tokens: list[str]) -> tuple[float, int] | None:
        tokens = undressed(tokens)
        if not tokens:
            return None
        n, options = len(tokens), [self.agreement(w) for w in tokens]
        fewest = min(options, key=lambda o: sum(len(self.by_word.get((n, w), ())) for w in o))
        best: list[tuple[float, bool, int]] = []
        for text in {t for w in fewest for t in self.by_word.get((n, w), ())}:
            alias, keys = self.aliases[text]
            if (score := self._matched(options, alias)) is not None:
                ordered = all(alias[i] in options[i] for i in range(n))
                best += [(score, ordered, k) for k in keys]
        best.sort(reverse=True)
        if not best or self._rival(best):
            return None
        return best[0][0], best[0][2]

    @staticmethod
    def _rival(best) -> bool:
        return any(b[:2] == best[0][:2] and b[2] != best[0][2] for b in best)

    @staticmethod
    def _matched(options: list[dict[str, float]], alias: tuple[str, ...]) -> float | None:
        """Mean similarity of a one-to-one assignment of all words, in order if that is possible."""
        if all(w in o for w, o in zip(alias, options)):
            return sum(o[w] for w, o in zip(alias, options)) / len(alias)
        taken: dict[int, int] = {}

        def place(i: int, tried: set[int]) -> bool:
            for j in sorted((j for j, w in enumerate(alias) if w in options[i]), key=lambda j: -options[i][alias[j]]):
                if j not in tried:
                    tried.add(j)
                    if j not in taken or place(taken[j], tried):
                        taken[j] = i
                        return True
            return False

        if not all(place(i, set()) for i in range(len(options))):
            return None
        return sum(options[i][alias[j]] for j, i in taken.items()) / len(alias) - 0.05

    def value(self, value: str | None) -> tuple[float, int] | None:
        if value is None or not (tokens := words(value)):
            return None
        return self.mention(tokens) or self.embedded(value) or self.similar(tokens) or ("-" in value and self.similar(words(value, True))) or None

    def decide(self, *values: str | None) -> tuple[int, float]:
        """The best match of several fields; the earlier field wins a tie. (0, 0.0) if none matches."""
        found = [m for v in values if (m := self.value(v))]
        return (lambda m: (m[1], min(m[0], 1.0)))(max(found, key=lambda m: m[0])) if found else (0, 0.0)


_READY: dict[str, Matcher] = {}


def entries_of(journals: DataFrame, most_entries: int) -> tuple[str, list[tuple]]:
    """The list under a name of its own, by which a worker knows the matcher it has made of it."""
    rows = journals.select("journal_id", "name", "abbreviation").where(F.col("journal_id").isNotNull()).limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"the canonical list has more than {most_entries} entries: raise most_entries with the executors' memory in mind")
    return uuid.uuid4().hex, [tuple(r) for r in rows]


def matcher_of(named: tuple[str, list[tuple]]) -> Matcher:
    """The list's matcher, made once in each worker process."""
    name, entries = named
    if name not in _READY:
        _READY.clear()
        _READY[name] = Matcher(entries)
    return _READY[name]


def mapped(items: DataFrame, journals: DataFrame, *, most_entries: int = 50_000) -> DataFrame:
    """(item_id, publication, journal_abbreviation, journal_id, score) for items with either field.

    journal_id is 0 where no entry fits or several fit equally well. Of an item delivered several
    times the last delivery counts. Empty values are values that fit nothing. An empty list maps
    all to 0.
    """
    shared = items.sparkSession.sparkContext.broadcast(entries_of(journals, most_entries))
    rows = latest(items, "publication", "journal_abbreviation").where("publication is not null or journal_abbreviation is not null")

    def decide(batches):
        matcher, known = matcher_of(shared.value), {}
        for batch in batches:
            ids, scores = [], []
            for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if pair not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[pair] = matcher.decide(*pair)
                ids.append(known[pair][0])
                scores.append(known[pair][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32()), pa.array(scores, pa.float64())], ["item_id", "publication", "journal_abbreviation", "journal_id", "score"])

    return rows.mapInArrow(decide, "item_id long, publication string, journal_abbreviation string, journal_id int, score double")


def value_report(items: DataFrame, journals: DataFrame) -> DataFrame:
    """(publication, journal_abbreviation, journal_id, n_items): how each entered value was read, the unmatched with 0."""
    return mapped(items, journals).groupBy("publication", "journal_abbreviation", "journal_id").agg(F.count("*").alias("n_items"))
