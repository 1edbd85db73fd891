"""Problem 8: per-document text quality statistics.

Method: each text gives two distributions, one over function words and word classes, one over
character classes. Their Jensen-Shannon divergence from language prose profiles and from profiles
of lists, tables and junk is taken, and the text is assigned the nearest profile; basic counts stand
beside it. The language is the one whose function words the text holds most of, so the recorded
language is not needed. A text of another language, known by its script or by words set in sentences
without the function words of any language here, is judged by its character classes alone.

A prose profile is made by rule: its function words, in order of frequency, share their mass as
1 / (rank + 3); the mass is the language's. Whether a text is prose is judged by these constants alone,
alike in any corpus. Lists, tables and junk can be told apart by profiles measured on labelled texts
(`kind_profiles`). Everything is local to a row; there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words by falling frequency, single letters left out: fixed values.
FUNCTION_WORDS = {
    "en": "the of and in to is that was for it with as on be by at are this not from which were has have had or an but we can been also its than if no they there their these more only such when all into may most some between over after under who what so other any our both how each then whether will would about where very much because though does should could did",
    "de": "die der und in von den das zu ist mit des nicht ein eine dem auf für im sich auch als an es aus bei nach wie war wird sind oder dass haben hat nur noch mehr über durch vor zur zum um am werden einer einem wir diese dieser damit wenn alle allen ob ab so wo unter kann sehr ohne einen dazu bis hatten wurde",
    "fr": "de la le et les des en un une du dans que qui est pour pas au sur par plus ne ce se sont avec il cette aux ont son été nous ou mais même était entre deux comme fait sans leur ses on ces bout dont très",
    "es": "de la que el en los se del las un por con no una su para es al lo como más pero sus le ha si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está hemos hay nos esto antes",
    "it": "di che il la un per una non sono con del da le si come più al anche della nel ma lo ha dei alla su gli delle questo se essere tra era fra quando dopo molto stato ed nella dal ad",
    "pt": "de que do da em um para com não uma os no se na por mais as dos como mas ao das foi ele tem seu sua ou quando muito nos já está também pelo pela até isso entre era depois sem",
    "nl": "de van het een en in is dat op te zijn voor met die aan niet er als bij ook door naar uit maar om werd worden wordt heeft hebben nog dan over meer kan deze dit zo wel geen tot",
    "sv": "och att det som en på är av för med till den har de inte om ett var från men sig så kan vi vid efter när också eller än där mot skulle hade detta bland mycket under",
    "da": "og at det en den til er som på de med af for ikke der var et har fra men om vi sig kan også efter ved eller når skal blev være denne over under",
    "pl": "na się nie do to że jest jak po od za ale przez co dla był są oraz tym tego która który już być tylko czy może było przy jego",
    "cs": "se na je že do to jako za by ale pro které jsou od po byl jeho nebo také podle který až při není jsme",
    "fi": "ja on ei se että oli joka mutta ovat kun myös niin hän tai ole sen kuin jos olla mukaan ollut vain sekä jotka tämä",
    "hu": "az és hogy nem is egy volt de ez meg csak mint már vagy el még ha ki azt több után lehet pedig amely",
    "tr": "ve bir bu da de için ile olarak olan daha çok gibi en ne kadar sonra var ancak her olduğu ise veya",
    "ro": "de și în la cu pe nu din este că pentru care un mai sau se fi au al prin după fost sunt într",
    "ru": "не на что по как это он от из за для но так же все было его бы до был или если они только при также которые она мы",
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: Share of these words in prose where the language says more by endings: fixed values; elsewhere that of PROFILES.
MASS = {"it": 0.30, "pt": 0.24, "pl": 0.22, "cs": 0.22, "fi": 0.20, "hu": 0.20, "tr": 0.14, "ro": 0.30, "ru": 0.22}
RANKS = {lang: {w: r for r, w in enumerate(words.split())} for lang, words in FUNCTION_WORDS.items()}
WIDTH = max(map(len, RANKS.values()))
#: Masses of (function words, other words, words of one or two letters, numbers, symbols) and of
#: (letters, digits, spaces, line breaks, punctuation, symbols, damaged characters): fixed values.
PROFILES = {
    "prose": ((0.42, 0.50, 0.03, 0.04, 0.01), (0.800, 0.012, 0.155, 0.008, 0.024, 0.001, 0.0)),
    "prose with figures": ((0.32, 0.33, 0.05, 0.20, 0.10), (0.670, 0.080, 0.185, 0.010, 0.045, 0.010, 0.0)),
    "list": ((0.06, 0.72, 0.06, 0.10, 0.06), (0.780, 0.030, 0.090, 0.045, 0.045, 0.010, 0.0)),
    "table": ((0.02, 0.30, 0.06, 0.42, 0.20), (0.420, 0.250, 0.110, 0.080, 0.110, 0.030, 0.0)),
    "junk": ((0.03, 0.20, 0.45, 0.10, 0.22), (0.480, 0.070, 0.290, 0.020, 0.060, 0.060, 0.02)),
}
#: A letter of a script without blanks is a word of its own.
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+|\d+(?:[.,]\d+)*|[^\w\s.,;:!?'\"()\[\]’“”„«»-]+")
ENDS = tuple(".!?:;…\"'”’»)。！？")
SENTENCE = re.compile(r"[.!?](?=\s|$)(?:\s+(\S)|)")
KNOWN = 0.12  # share of function words from which on a language is known
KINDS = ("prose", "list", "table", "junk")
SHAPES = tuple(PROFILES)  # the first two are prose


def _class_of(c: int) -> int:
    ch, kind = chr(c), unicodedata.category(chr(c))
    if c < 0x3000:
        return 0 if ch.isalpha() or 0x300 <= c < 0x370 else 1 if ch.isdigit() else 3 if ch in "\n\r\v\f\x85\u2028\u2029" else 2 if ch.isspace() else 4 if ch in ".,;:!?'\"()[]-–—’‘“”„«»" else 6 if c < 32 or 127 <= c < 160 else 5
    return 0 if kind[0] in "LM" else 1 if kind == "Nd" else 2 if kind == "Zs" else 4 if kind[0] == "P" else 6 if kind[0] == "C" or c >= 0xFFF0 else 5


def _classes() -> np.ndarray:
    return np.array([_class_of(c) for c in range(0x10000)], np.int8)


CLASSES = _classes()


def _word_profile(masses) -> np.ndarray:
    zipf = 1 / (np.arange(WIDTH) + 3)
    return np.concatenate([masses[0] * zipf / zipf.sum(), masses[1:]])


def _in_language(lang: str, masses) -> tuple:
    """A prose profile's masses with the language's share of function words, the rest being other words."""
    own = masses[0] * MASS[lang] / PROFILES["prose"][0][0] if lang in MASS else masses[0]
    return own, masses[1] + masses[0] - own, *masses[2:]


#: (languages, shapes, words): prose differs by language.
WORD_PROFILES = np.stack([np.stack([_word_profile(_in_language(lang, PROFILES[k][0]) if k.startswith("prose") else PROFILES[k][0]) for k in SHAPES]) for lang in LANGUAGES])
CHAR_PROFILES = np.stack([np.array(PROFILES[k][1]) / sum(PROFILES[k][1]) for k in SHAPES])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q, or from each row of its own q."""
    p, q = p[:, None, :], q if q.ndim == 3 else q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=2)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=2)
    return (a + b) / 2


def _apart(words: np.ndarray, chars: np.ndarray, word_profiles: np.ndarray, char_profiles: np.ndarray) -> np.ndarray:
    """Divergence from measured profiles; function words count as one, lines weigh as much as words."""
    whole = lambda x: np.column_stack([x[:, :WIDTH].sum(axis=1), x[:, WIDTH:]])
    return 0.5 * divergence(whole(words), whole(word_profiles)) + 0.5 * divergence(chars, char_profiles)


def measure(texts: list[str | None], kinds_by: tuple[np.ndarray, np.ndarray, list[int]] | None = None) -> dict[str, list]:
    n = len(texts)
    spoken = np.zeros(n, np.int64)
    words_at = np.zeros((n, WIDTH + 4))
    chars_at = np.zeros((n, 7))
    out: dict[str, list] = {k: [] for k in ("n_chars", "n_words", "mean_word_length", "line_end_share", "common_word_share", "language")}
    ranks, alone = RANKS, np.zeros(n, bool)
    for i, text in enumerate(texts):
        text = text or ""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kinds = CLASSES[np.minimum(codes, len(CLASSES) - 1)]
        if len(codes) and codes.max() >= len(CLASSES):
            kinds = np.where((codes >= 0x20000) & (codes < 0x32000), 0, np.where(codes >= len(CLASSES), 5, kinds))
        if len(kinds) > 1:  # wide spacing is layout: a run of spaces counts once
            kinds = kinds[np.r_[True, (kinds[1:] != 2) | (kinds[:-1] != 2)]]
        chars_at[i] = np.bincount(kinds, minlength=7)
        counts: dict[str, int] = {}
        for w in WORD.findall(text.lower()):
            counts[w] = counts.get(w, 0) + 1
        found = {lang: sum(counts[w] for w in counts.keys() & ranks[lang].keys()) for lang in LANGUAGES}
        lang = max(LANGUAGES, key=found.__getitem__)
        spoken[i] = LANGUAGES.index(lang)
        known, row = ranks[lang], words_at[i]
        n_words = letters = 0
        for w, c in counts.items():
            if w[0].isalpha():
                n_words += c
                letters += c * len(w)
                r = known.get(w)
                row[r if r is not None else WIDTH if len(w) > 2 else WIDTH + 1] += c
            else:
                row[WIDTH + 2 if w[0].isdigit() else WIDTH + 3] += c
        if n_words >= 20 and found[lang] < KNOWN * n_words:
            foreign = (CLASSES[np.minimum(codes, len(CLASSES) - 1)] == 0) & (codes >= 0x370)
            ends = SENTENCE.findall(text)
            sentences = len(ends) >= 2 and 6 <= n_words / len(ends) <= 60 and sum(not x or x.isupper() for x in ends) >= 0.8 * len(ends)
            alone[i] = (2 * int(foreign.sum()) > letters or sentences) and chars_at[i, 4] <= 0.4 * n_words  # a mark behind each other word is a list
        lines = [x for x in (y.rstrip() for y in text.splitlines()) if x]
        out["n_chars"].append(len(text))
        out["n_words"].append(n_words)
        out["mean_word_length"].append(letters / n_words if n_words else 0.0)
        out["line_end_share"].append(sum(x.endswith(ENDS) for x in lines) / len(lines) if lines else 0.0)
        out["common_word_share"].append(found[lang] / n_words if n_words else 0.0)
        out["language"].append(lang if found[lang] else None)
    chars = chars_at / np.maximum(chars_at.sum(axis=1, keepdims=True), 1)
    out["words"], out["chars"] = words_at / np.maximum(words_at.sum(axis=1, keepdims=True), 1), chars
    out["symbol_ratio"] = (chars[:, 5] + chars[:, 6]).tolist()
    words = out["words"]
    bare = lambda x: np.delete(x, 2, axis=1) / np.maximum(np.delete(x, 2, axis=1).sum(axis=1, keepdims=True), 1e-9)  # noqa: E731  scripts differ in blanks
    far = np.zeros((n, len(SHAPES)))
    for i in range(0, n, 512):
        at = slice(i, i + 512)
        both = 0.75 * divergence(words[at], WORD_PROFILES[spoken[at]]) + 0.25 * divergence(chars[at], CHAR_PROFILES)
        far[at] = np.where(alone[at, None], divergence(bare(chars[at]), bare(CHAR_PROFILES)), both)
    far = np.column_stack([far[:, :2].min(axis=1), far[:, 2:]])
    nearest = far.argmin(axis=1)
    if kinds_by is not None and len(kinds_by[2]):
        known, of = kinds_by[0], np.array(kinds_by[2])
        rest = np.flatnonzero(nearest > 0)
        for i in range(0, len(rest), 512):
            at = rest[i : i + 512]
            nearest[at] = of[_apart(words[at], chars[at], known, kinds_by[1]).argmin(axis=1)]
    few = words_at.sum(axis=1) < 3
    for k, kind in enumerate(KINDS):
        out[f"divergence_{kind}"] = far[:, k].tolist()
    out["profile"] = [KINDS[3 if e else k] for k, e in zip(nearest, few)]
    return out


SCHEMA = "doc_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, line_end_share double, common_word_share double, language string, divergence_prose double, divergence_list double, divergence_table double, divergence_junk double, profile string"
_TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def kind_profiles(documents: DataFrame, labels: DataFrame, *, most: int = 4000, each: int = 8, seed: int = 3) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Profiles of lists, tables and junk, at most `each` for a kind: centres of the labelled texts' distributions.

    `labels` has (doc_id, label). Of more than `most` labelled texts that many are taken by hash. Labels of
    other kinds, nulls and labels of no document count for nothing."""

    def distributions(batches):
        for batch in batches:
            found = measure(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in found["words"]], pa.binary()), pa.array([r.tobytes() for r in found["chars"]], pa.binary())], ["label", "words", "chars"])

    wanted = labels.where(F.col("label").isin(*KINDS[1:]) & F.col("doc_id").isNotNull()).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "label").limit(most)
    rows = documents.join(F.broadcast(wanted), "doc_id").select("label", "text").mapInArrow(distributions, "label string, words binary, chars binary").collect()  # `most` rows, but for repeated doc_ids
    words, chars, of, rng = [], [], [], np.random.default_rng(seed)
    for kind in KINDS[1:]:
        own = sorted((r.words, r.chars) for r in rows if r.label == kind)
        if not own:
            continue
        x = np.array([np.concatenate([np.frombuffer(w), np.frombuffer(c)]) for w, c in own])
        centres = x[rng.choice(len(x), min(each, len(x)), replace=False)]
        for _ in range(12):
            near = _apart(x[:, : WIDTH + 4], x[:, WIDTH + 4 :], centres[:, : WIDTH + 4], centres[:, WIDTH + 4 :]).argmin(axis=1)
            centres = np.stack([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        words.append(centres[:, : WIDTH + 4])
        chars.append(centres[:, WIDTH + 4 :])
        of += [KINDS.index(kind)] * len(centres)
    return (np.concatenate(words), np.concatenate(chars), of) if of else (np.zeros((0, WIDTH + 4)), np.zeros((0, 7)), [])


def statistics(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row of figures for each row of documents (see SCHEMA).

    A null or empty text has zero counts, no language and the profile junk, as has a text of fewer
    than three words and numbers. Ties between profiles go to the first of prose, list, table, junk. Repeated
    rows are measured each. Columns besides doc_id and text are ignored. With `labels` the kinds of
    what is no prose are told apart by the labelled texts' profiles.
    """
    fields = [f.split() for f in SCHEMA.split(", ")]
    by = kind_profiles(documents, labels) if labels is not None else None

    def each(batches):
        for batch in batches:
            found = measure(batch.column(1).to_pylist(), by)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[name], _TYPES[kind]) for name, kind in fields[1:])], [name for name, _ in fields])

    return documents.select("doc_id", "text").mapInArrow(each, SCHEMA)


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_ids whose text is for the most part not running prose."""
    return statistics(documents).where("doc_id is not null and profile <> 'prose'").select("doc_id").distinct()
