"""Normal forms shared by the operators of this folder."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
NOT_WORD = re.compile(r"[\W_]+")
DOI_HEAD = re.compile(r"^(?:https?://)?(?:[\w.-]*doi[\w.-]*/|doi\s*:?\s*)?(?=10\.)", re.IGNORECASE)
DASHES = {ord(c): "-" for c in "‐‑‒–—―−­"}
#: Letters that decomposition leaves whole: fixed values.
WHOLE = {ord("ø"): "o", ord("Ø"): "O", ord("ł"): "l", ord("Ł"): "L", ord("đ"): "d", ord("Đ"): "D", ord("ß"): "ss", ord("æ"): "ae", ord("Æ"): "AE", ord("œ"): "oe", ord("Œ"): "OE", ord("ı"): "i"}


def letters(s: str) -> str:
    """Letters and digits only: what remains of a title without spacing, case, punctuation, typography, markup and encoding."""
    if "<" in s:
        s = TAG.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    return unicodedata.normalize("NFC", NOT_WORD.sub("", s.casefold()))


def doi(s: str) -> str:
    """A DOI however it is written out; '' if nothing is left."""
    s = unicodedata.normalize("NFKC", unquote(html.unescape(s))).translate(DASHES).strip().casefold()
    s = re.sub(r"\s+", "", s)
    s = DOI_HEAD.sub("", s).rstrip(".,;:")
    return s


def locator(s: str) -> str:
    """Volume or pages: runs of other characters than letters and digits are one dash."""
    return NOT_WORD.sub("-", unicodedata.normalize("NFKC", s).casefold()).strip("-")


def plain(s: str) -> str:
    """Lower-case text without accents."""
    if s.isascii():
        return s.lower()
    s = s.translate(WHOLE)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.lower()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; most + 1 if it is more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row2 = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row2[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row2.append(d)
        if min(row2) > most:
            return most + 1
        before, row = last, row2
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    hit_a, hit_b, m = [False] * la, [False] * lb, 0
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not hit_b[j] and b[j] == x:
                hit_a[i] = hit_b[j] = True
                m += 1
                break
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip((c for c, h in zip(a, hit_a) if h), (c for c, h in zip(b, hit_b) if h))) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)
