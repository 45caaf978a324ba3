"""Personal data in plain and disguised form, with spans of the source text.

Four kinds are found by pattern in the text as it is. Transducers then rewrite
homoglyphs and foreign digits, spelled digits and at/dot disguises, each output
character keeping its source range; what is found in the rewritten text and
holds a rewritten character is mapped back and added. It may hold plain spans of
its own kind (the tail of an address that a hidden character cuts), which stay;
otherwise it overlaps no span. Offsets are code points, end exclusive.

Null texts are empty. Repeated rows are scanned alike; extra columns are
ignored. Of overlapping added spans the kind listed first stays, then the
earlier one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import small_batches

KINDS = ("email", "ip", "card", "phone")
# A digit run is entered at its start only: later starts in it would end alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str):
    """Leftmost matches of local@domain; the local part is the run before the sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    at = 0
    while m := _IP.search(text, at):
        at = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the text as it is, by kind and start."""
    return [(k, *s) for k, find in enumerate((emails, _ips, _cards, _phones)) for s in find(text)]


# Letters of other scripts that look like ASCII ones, in order of the ASCII letter.
_LOOKALIKE = {
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Е": "E", "Ε": "E", "Н": "H", "Η": "H", "І": "I", "Ι": "I", "Ј": "J",
    "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Ѕ": "S", "Т": "T", "Τ": "T",
    "Х": "X", "Χ": "X", "Υ": "Y", "Ζ": "Z", "а": "a", "α": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ι": "i",
    "ј": "j", "ο": "o", "о": "o", "р": "p", "ρ": "p", "ѕ": "s", "υ": "u", "ν": "v", "х": "x", "у": "y",
}
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SIGNS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}
#: Words that no domain's first or last label is, in "look at the dot on it".
_PROSE = frozenset(
    ["a", "an", "the", "this", "that", "these", "those", "each", "every", "any", "some", "one", "no", "my", "your", "his", "her", "its", "our", "their", "which", "what", "on", "and", "or", "but", "for", "from", "with", "was", "were", "are", "by", "as", "if", "when", "where", "then", "than", "into", "over", "under"]
)


def _characters() -> dict[str, str]:
    """Every character that is rewritten as one ASCII character, or as nothing."""
    out = dict(_LOOKALIKE)
    out.update({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
    for c in range(0x80, 0x1F000):
        if unicodedata.category(chr(c)) == "Nd":
            out[chr(c)] = str(unicodedata.digit(chr(c)))
    out |= {"​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "", " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-"}
    return out


_MAP = _characters()
_MAPPED = re.compile("[" + "".join(map(re.escape, _MAP)) + "]")
_DIGIT_WORD = "|".join(_SPELLED)
_SIGN_WORD = "|".join(_SIGNS)
# A run of digits, spelled digits and spelled signs. All repeats are possessive, so a text is gone through once.
_RUN = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[\s,-]++)?(?:{_DIGIT_WORD}|[0-9]++)(?![A-Za-z0-9])(?:[\s,-]++(?:{_DIGIT_WORD}|{_SIGN_WORD}|[0-9]++)(?![A-Za-z0-9]))++")
_UNITS = re.compile(r"[A-Za-z]+|[0-9]+")
_BRACKET = re.compile(r"(?i)[\[({<]\s*+(at|dot)\s*+[\])}>]")
_BARE = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\s++at\s++)([A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++)(?![A-Za-z0-9])")
_AFTER_SIGN = re.compile(r"(?i)@([A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++)(?![A-Za-z0-9])")
_BARE_DOT = re.compile(r"(?i)\s++dot\s++")
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPELLED_BYTES = frozenset(w.encode() for w in (*_SPELLED, *_SIGNS))


def _hints(text: str) -> tuple[bool, bool, bool]:
    """Whether there are disguised characters, spelled digits or signs, at/dot disguises."""
    glyphs = not text.isascii() and _MAPPED.search(text) is not None
    data = text.encode("utf-8", "surrogatepass")
    words = set(data.translate(_LETTERS).split())
    spelled = not _SPELLED_BYTES.isdisjoint(words)
    return glyphs, spelled, b"dot" in words or b"at" in words and (glyphs or _BRACKET.search(text) is not None)


class Rewritten:
    """A text with, for each character, its source range and whether it was rewritten."""

    def __init__(self, text: str, start=None, end=None, changed=None):
        n = len(text)
        self.text = text
        self.start = np.arange(n) if start is None else start
        self.end = np.arange(1, n + 1) if end is None else end
        self.changed = np.zeros(n, bool) if changed is None else changed

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Ranges of this text, ascending and apart, replaced; each new character covers its range."""
        if not edits:
            return self
        i, j, size = (np.array(x) for x in zip(*((i, j, len(new)) for i, j, new in edits), strict=True))
        gone = np.zeros(len(self.text) + 1, np.int8)
        np.add.at(gone, i, 1)
        np.add.at(gone, j, -1)
        stays = np.cumsum(gone[:-1]) == 0
        at = np.repeat(i - np.concatenate(([0], np.cumsum(j - i)[:-1])), size)  # places among what stays
        put = lambda old, new: np.insert(old[stays], at, np.repeat(new, size))
        texts, done = [], 0
        for a, b, new in edits:
            texts += [self.text[done:a], new]
            done = b
        texts.append(self.text[done:])
        return Rewritten("".join(texts), put(self.start, self.start[i]), put(self.end, self.end[j - 1]), put(self.changed, np.ones(len(i), bool)))


def _glyphs(r: Rewritten) -> Rewritten:
    return r.edit([(m.start(), m.end(), _MAP[m[0]]) for m in _MAPPED.finditer(r.text)])


def _digits(r: Rewritten, least: int, signs: bool) -> Rewritten:
    """Runs with so many spelled digits (or signs) or more become digits, their spaces dropped."""
    edits = []
    for run in _RUN.finditer(r.text):
        units = list(_UNITS.finditer(r.text, *run.span()))
        while units[-1][0].lower() in _SIGNS:  # a run ends with a digit
            units.pop()
        words = [u[0].lower() for u in units]
        if sum(w in _SPELLED or signs and w in _SIGNS for w in words) >= least and len(units) > 1:
            for k, (u, word) in enumerate(zip(units, words, strict=True)):
                upto = units[k + 1].start() if k + 1 < len(units) else u.end()
                edits.append((u.start(), u.end(), _SPELLED.get(word) or _SIGNS.get(word) or u[0]))
                if upto > u.end():
                    edits.append((u.end(), upto, ""))
    return r.edit(edits)


def _domain(labels: str) -> bool:
    """Whether what stands between the dots can be a domain, and isn't prose."""
    own = _BARE_DOT.sub(".", labels).lower().split(".")
    return len(own[-1]) >= 2 and own[-1].isalpha() and own[0] not in _PROSE and own[-1] not in _PROSE


def _bracketed(r: Rewritten) -> Rewritten:
    """[at] and (dot) with the blanks around them."""
    edits, done = [], 0
    for m in _BRACKET.finditer(r.text):
        i, j = m.span()
        while i > done and r.text[i - 1].isspace():
            i -= 1
        while j < len(r.text) and r.text[j].isspace():
            j += 1
        edits.append((i, j, "@" if m[1].lower() == "at" else "."))
        done = j
    return r.edit(edits)


def _at_dot(r: Rewritten) -> Rewritten:
    r = _bracketed(r)
    edits = []
    for m in _BARE.finditer(r.text):
        dots = [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(r.text, *m.span(2))]
        if (dots or r.changed[m.end(1) : m.end()].any()) and _domain(m[2]):  # "look at example.com" is no address
            edits += [(*m.span(1), "@"), *dots]
    r = r.edit(edits)
    # after an at-sign, bare dots in what can only be its domain
    edits = []
    for m in _AFTER_SIGN.finditer(r.text):
        if _domain(m[1]):
            edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(r.text, *m.span(1))]
    return r.edit(edits)


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further (kind, start, end); they overlap no other, but may hold base ones of their kind."""
    glyphs, spelled, ats = _hints(text)
    if not (glyphs or spelled or ats):
        return []
    r = Rewritten(text)
    if glyphs:
        r = _glyphs(r)
        _, spelled, ats = _hints(r.text)
        ats = ats or b"at" in r.text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    stands, out = _Standing(len(text), base), []
    every = _digits(r, 1, True) if spelled else r
    if spelled:
        r = _digits(r, 5, False)
    few = every.text != r.text
    if ats:
        r = _at_dot(r)
    found = plain(r.text)
    if spelled:  # a long run of spelled digits needs no plus sign to be a phone number
        found += _bare_phones(r)
    _add(text, r, found, stands, out)
    if few:  # short runs can be numbers, but must not change what stands before an at-sign
        _add(text, every, [x for x in plain(every.text) if x[0]] + _bare_phones(every), stands, out)
    return out


def _bare_phones(r: Rewritten) -> list[tuple[int, int, int]]:
    return [(3, *m.span()) for m in re.finditer(r"(?<![0-9+])[0-9]{8,15}(?![0-9])", r.text) if r.changed[m.start() : m.end()].sum() >= 7]


class _Standing:
    """What stands at each character: an added span, and the number of each kind's base span."""

    def __init__(self, n: int, base: list[tuple[int, int, int]]):
        self.base, self.added, self.at = base, np.zeros(n, bool), {}
        for x, (k, i, j) in enumerate(base):
            self.at.setdefault(k, np.full(n, -1, np.int32))[i:j] = x

    def admits(self, kind: int, s: int, e: int) -> bool:
        """Nothing added there, and of base spans only whole ones of this kind, shorter than it."""
        if self.added[s:e].any():
            return False
        for k, at in self.at.items():
            found = np.unique(at[s:e])
            found = found[found >= 0]
            if len(found) and (k != kind or self.base[found[0]][1] < s or self.base[found[-1]][2] > e or self.base[found[0]] == (kind, s, e)):
                return False
        return True


def _add(text: str, r: Rewritten, found: list, stands: _Standing, out: list) -> None:
    """What is found in a rewritten text and holds something rewritten, where it may stand."""
    for kind, i, j in sorted(found):
        s, e = int(r.start[i]), int(r.end[j - 1])
        if r.changed[i:j].any() or e - s > j - i:  # a dropped character leaves none that is changed
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if stands.admits(kind, s, e):
                stands.added[s:e] = True
                out.append((kind, s, e))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))


def find(text: str | None) -> tuple[list, list]:
    """Base spans and added ones."""
    base = plain(text or "")
    return base, disguised(text or "", base)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind's base spans, their digest, all spans."""
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id", "text")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                base, more = find(t.as_py())
                n = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_disguised long")
