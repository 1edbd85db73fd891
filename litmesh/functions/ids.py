"""Identifier and text functions as Column expressions; they stay inside whole-stage codegen.

All take and return columns, give NULL for NULL unless said otherwise, and never raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of works that are cited but not held: fixed values.
NAMESPACES = ("doi", "arxiv", "openalex", "ref")
#: Tails of a publisher's URL that are no part of a DOI: fixed values.
URL_TAIL = r"/(abstract|epdf|full|pdf|meta|html|summary)$"
#: Words without weight in journal names: fixed values.
JOURNAL_STOP = ("of", "the", "and", "on", "in", "for", "a", "an", "des", "der", "die", "das", "und", "fur", "zur", "zum", "de", "la", "le")


def decode_percent(c: Column) -> Column:
    """Each %XX decoded by itself: ASCII characters only, in one pass; anything else stays as it is."""
    parts = F.split(c, "%")
    head, tail = F.element_at(parts, 1), F.slice(parts, F.lit(2), F.size(parts))
    code = lambda p: F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
    one = lambda p: F.when(p.rlike("^[0-7][0-9A-Fa-f]"), F.concat(F.char(code(p)), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p))
    return F.concat(head, F.array_join(F.transform(tail, one), ""))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def strip_closers(c: Column) -> Column:
    """Drops trailing ")" that close nothing opened before, and the punctuation in front of each."""
    step = lambda acc: F.when(acc.endswith(")") & (_count(acc, ")") > _count(acc, "(")), F.regexp_replace(F.substring(acc, F.lit(1), F.length(acc) - 1), r"[.,;:\]]+$", "")).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), _count(c, ")") - _count(c, "("))), c, lambda acc, _: step(acc))


def norm_doi(c: Column) -> Column:
    """A DOI in its one spelling, NULL where there is none."""
    d = F.lower(decode_percent(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    d = F.regexp_replace(d, r"^https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(d, r"^doi:\s*", "")
    d = F.regexp_replace(d, r"[.,;:\]]+$", "")
    d = strip_closers(F.regexp_replace(d, URL_TAIL, ""))
    return F.when(d.rlike(r"^10\.\d{4,9}/"), d)


def find_dois(c: Column) -> Column:
    """Distinct DOIs of a clean text in order of first appearance; an id without a digit after its slash is a torn one."""
    found = F.transform(F.regexp_extract_all(decode_percent(c), F.lit(r"10\.\d{4,9}/[-._;()/:<>a-zA-Z0-9]+"), F.lit(0)), norm_doi)
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull() & F.regexp_replace(d, r"^[^/]*/", "").rlike(r"\d")))


def find_arxiv(c: Column) -> Column:
    """Distinct arXiv ids without version."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})(?:v\d+)?"), F.lit(1)))


def flatten_text(c: Column) -> Column:
    """Line wrapping undone: a hyphen at a line's end joins, runs of white space are one blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"-\r?\n\s*", ""), r"\r?\n", " "), r"\s+", " ")


def first_year(c: Column) -> Column:
    """The first whole number from 1800 to 2099."""
    return F.nullif(F.regexp_extract(c, r"\b(1[89]\d\d|20\d\d)\b", 1), F.lit("")).cast("int")


def namespace(key: Column) -> Column:
    """What stands before the first colon; NULL for keys of held items, which have none."""
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1))


def local_id(key: Column) -> Column:
    return F.when(F.instr(key, ":") > 0, F.substring(key, F.instr(key, ":") + 1, F.length(key)))


def is_external(key: Column) -> Column:
    return F.coalesce(namespace(key).isin(*NAMESPACES), F.lit(False))


def external_key(ns: Column, ident: Column) -> Column:
    return F.concat(ns, F.lit(":"), ident)


def ascii_title(c: Column) -> Column:
    """`norm_title` for texts without accents; `kernels.norm_title` is the general form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "), r"\s+", " "))


def ref_signature(title: Column) -> Column:
    """The key of a work known by its normalised title only: its first eight words, 60 characters at most, whole words."""
    joined = F.array_join(F.slice(F.split(title, " "), 1, 8), "-")
    cut = F.regexp_replace(F.substring(joined, 1, 60), r"-[^-]*$", "")
    return F.when(F.length(title) >= 20, F.when(F.length(joined) > 60, cut).otherwise(joined))


def first_page(pages: Column) -> Column:
    """The first page of a range; NULL where it is no page."""
    head = F.lower(F.trim(F.element_at(F.split(pages, "[-–—,]"), 1)))
    return F.when(head.rlike(r"^[a-z]?\d{1,6}$"), head)


def journal_tokens(norm_title: Column) -> Column:
    return F.filter(F.split(norm_title, " "), lambda w: (w != "") & ~w.isin(*JOURNAL_STOP))


def agreement(word: Column, token: Column) -> Column:
    """How a printed word stands for a word of a journal's name: WORD (one begins the other, three letters at least), EXACT for shorter ones, INITIAL, or NULL."""
    least = F.least(F.length(word), F.length(token))
    short = F.when(word == token, "EXACT").when((F.length(token) >= 4) & (F.length(word) > 0) & token.startswith(word), "INITIAL")
    return F.when(least < 3, short).when(word.startswith(token) | token.startswith(word), "WORD")


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def short_openalex(ident: Column) -> Column:
    return F.substring_index(ident, "/", -1)


def surname_agrees(wanted: Column, creators: Column) -> Column:
    w = F.lower(wanted)
    return F.coalesce(F.exists(creators, lambda x: (F.lower(x) == w) | F.lower(x).endswith(F.concat(F.lit(" "), w))), F.lit(False))


def impossible_year(citing: Column, cited: Column) -> Column:
    """A cited work cannot be more than a year younger; unknown years make nothing impossible."""
    return F.coalesce(cited > citing + 1, F.lit(False))


def doi_url(doi: Column) -> Column:
    """The resolver's URL of a DOI, with the characters that a URL reads as its own escaped."""
    out = doi
    for ch, esc in (("%", "%25"), (" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("#", "%23"), ("?", "%3F"), ("[", "%5B"), ("]", "%5D"), ("\\", "%5C"), ("^", "%5E"), ("`", "%60"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D")):
        out = F.replace(out, F.lit(ch), F.lit(esc))
    return F.concat(F.lit("https://doi.org/"), out)


def external_url(key: Column) -> Column:
    ns, ident = namespace(key), local_id(key)
    return F.when(ns == "doi", doi_url(ident)).when(ns == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), ident)).when(ns == "openalex", F.concat(F.lit("https://openalex.org/"), ident))


def item_url(url: Column, doi: Column) -> Column:
    """The item's own web address, else its DOI's."""
    return F.when(url.rlike("^https?://"), url).otherwise(doi_url(norm_doi(doi)))


def short_label(creators: Column, title: Column, year: Column) -> Column:
    """First author (blanks removed), else the title's first word of more than three letters, and the year; "?" if there is neither."""
    author = F.regexp_replace(F.get(creators, 0), r"\s+", "")
    word = F.get(F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"([A-Za-z]+)"), F.lit(1)), lambda w: F.length(w) > 3), 0)
    name = F.coalesce(F.nullif(author, F.lit("")), word)
    return F.when(name.isNull(), F.lit("?")).otherwise(F.concat(name, F.coalesce(year.cast("string"), F.lit(""))))


def ghost_label(key: Column, creators: Column, title: Column, year: Column) -> Column:
    """A cited work's label: its citekey once it is described, else its id after the first slash, 20 characters at most."""
    ident = local_id(key)
    tail = F.when(F.instr(ident, "/") > 0, F.substring(ident, F.instr(ident, "/") + 1, F.length(ident))).otherwise(ident)
    return F.when(title.isNotNull(), short_label(creators, title, year)).otherwise(F.when(F.length(tail) > 20, F.concat(F.substring(tail, 1, 19), F.lit("…"))).otherwise(tail))


def suffix_letters(n: Column) -> Column:
    """0 -> a, 25 -> z, 26 -> aa ... for n below 702."""
    low = F.char(F.lit(97) + F.pmod(n, F.lit(26)))
    return F.when(n < 26, low).otherwise(F.concat(F.char(F.lit(96) + F.floor(n / 26).cast("int")), low))


def hash_index(text: Column, size: int) -> Column:
    """31 h + c over the characters with 32-bit wrap, floor-modulo `size`."""
    signed = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    h = F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: signed(acc * 31 + F.ascii(x)))
    return F.pmod(h, F.lit(size))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def title_terms(title: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words of three letters and more that are neither stop words nor numbers, and pairs of neighbours among them."""
    words = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    kept = F.transform(words, lambda w: F.when((F.length(w) >= 3) & ~w.isin(*stop) & ~w.rlike(r"^\d+$"), w))
    pairs = F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(F.concat(kept, pairs), lambda x: x.isNotNull()))
