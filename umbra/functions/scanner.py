"""Spans of whole batches of texts: what ``detect`` and ``redact`` do, in Python workers.

The texts of a batch are joined and their characters classed once. For each
pattern of the catalog the classes give every place where a match can begin;
the pattern itself is tried at those places only, from left to right, which is
what a scan of each text finds. Overlaps are resolved and texts replaced over
all spans of a batch together. Other patterns are scanned text by text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .masks import PLACEHOLDERS
from ..rules import BANK_CONTEXT, RULES, TIME_PATTERN, Rule

SPAN = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("engine", pa.string()), ("rule_id", pa.string()), ("priority", pa.int32()), ("ord", pa.int32())])
_PAD = "\0"  # no pattern of the catalog matches it, so matches stay inside their text
_EDGE = 16
_CHUNK = 1 << 21

_NUMERALS = "零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两"
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGIT, ASCII, ALNUM, UPPER, HAN, CODE, AMOUNT, FIRST = (1 << i for i in range(8))


def character_data() -> tuple[list[int], list[int]]:
    """Decimal digits and spaces, as ``re`` takes them."""
    return [c for c in range(0x110000) if chr(c).isdecimal()], [c for c in range(0x110000) if chr(c).isspace()]


def _table(digits: list[int], spaces: list[int]) -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)

    def put(flag: int, *what) -> None:
        for w in what:
            t[np.array([ord(c) for c in w] if isinstance(w, str) else list(w))] |= flag

    low, high, nums, wide = range(97, 123), range(65, 91), range(48, 58), range(0xFF10, 0xFF1A)
    put(DIGIT | CODE, digits)
    put(ASCII, nums)
    put(ALNUM, nums, low, high)
    put(UPPER, high)
    put(HAN, range(0x4E00, 0xA000))
    put(CODE, "0123456789ABCDEFGHJKLMNPQRTUWXY")
    put(AMOUNT, nums, wide, _NUMERALS, spaces, ".,，¥￥人民币")
    put(FIRST, nums, wide, _NUMERALS, "¥￥人")
    return t


def _objects(xs: list) -> np.ndarray:
    out = np.empty(len(xs), object)
    out[:] = xs
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where the mask holds; its edges don't hold."""
    at = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return at[0::2], at[1::2]


class Chunk:
    """Joined texts with the classes of their characters."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.text = _PAD * _EDGE + _PAD.join(texts) + _PAD * _EDGE
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cls = table[self.codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = _EDGE + np.cumsum(sizes) - sizes

    def has(self, flag: int) -> np.ndarray:
        return (self.cls & flag) != 0

    @cached_property
    def digits(self):
        return _runs(self.has(DIGIT))

    @cached_property
    def ascii_digits(self):
        return _runs(self.has(ASCII))

    @cached_property
    def words(self):
        return _runs(self.has(ALNUM))

    def at(self, chars: str) -> np.ndarray:
        """Places of any of the characters."""
        hit = self.codes == ord(chars[0])
        for c in chars[1:]:
            hit |= self.codes == ord(c)
        return np.flatnonzero(hit)

    def places(self, term: str) -> np.ndarray:
        p = self.at(term[0])
        for i, c in enumerate(term[1:], 1):
            p = p[self.codes[p + i] == ord(c)]
        return p


def _matched(rx: re.Pattern, text: str, places) -> list[tuple[int, int]]:
    """Matches of a left-to-right scan, given all places where one can begin, in order."""
    out, last, match = [], 0, rx.match
    for p in places.tolist() if isinstance(places, np.ndarray) else places:
        if p >= last and (m := match(text, p)):
            last = m.end()
            out.append((p, last))
    return out


# ---- places where each rule's match can begin ---------------------------------------------------


def _phone(t: Chunk):
    a, b = t.digits
    return a[(b - a == 11) & (t.codes[a] == 49)]


def _landline(t: Chunk):
    a, b = t.digits
    return a[(b - a >= 3) & (t.codes[a] == 48)]


def _id_card(t: Chunk):
    a, b = t.digits
    return a[((b - a == 17) | (b - a == 18)) & (t.codes[a] >= 49) & (t.codes[a] <= 57)]


def _passport(t: Chunk):
    a, b = t.digits
    a = a[b - a >= 8] - 1
    return a[(t.cls[a] & ALNUM) != 0]


def _case_no(t: Chunk):
    a, b = t.digits
    return a[(b - a == 4) & (t.codes[a - 1] == 40) & (t.codes[b] == 41)] - 1


def _case_no_contract(t: Chunk):
    open_ = t.at("[【（(")
    after = t.codes[open_ + 1]
    digit = ((after >= 48) & (after <= 57)) | ((after >= 0xFF10) & (after <= 0xFF19)) | (after == 111) | (after == 79)
    space = ((t.cls[open_ + 1] & AMOUNT) != 0) & ~np.isin(after, [ord(c) for c in ".,，¥￥人民币" + _NUMERALS])
    a, b = t.words
    fit = (b - a >= 2) & (b - a <= 8) & np.isin(t.codes[b], [ord(c) for c in "-－—"]) & ((t.cls[b + 1] & ALNUM) != 0)
    no = t.at("号")
    case = no[t.codes[no - 1] == ord("案")] - 1
    contract = no[(t.codes[no - 1] == ord("编")) & (t.codes[no - 2] == ord("同")) & (t.codes[no - 3] == ord("合"))] - 3
    return np.sort(np.concatenate([open_[digit | space], a[fit], case, contract]))


def _execution_no(t: Chunk):
    return t.at("执")


def _org_code(t: Chunk):
    a, b = t.digits
    n = b - a
    p = np.unique(np.concatenate([a[n >= 6] - 2, a[n >= 7] - 1, a[n >= 8]]))
    x, y = _runs(t.has(CODE))
    run = np.searchsorted(x, p, "right") - 1
    ok = run >= 0
    p, run = p[ok], run[ok]
    return p[y[run] - p >= 18]


def _bank_card(t: Chunk):
    a, b = t.ascii_digits
    return a[(b - a >= 13) & (b - a <= 19) & (t.codes[a] >= 51) & (t.codes[a] <= 54)]


def _money(t: Chunk):
    x, y = _runs(t.has(AMOUNT))
    live = np.isin(t.codes[y], [ord(c) for c in "元圆块"])
    live[np.searchsorted(x, t.at("¥￥"), "right") - 1] = True
    first = t.has(FIRST)
    first[1:] &= ~t.has(ALNUM)[:-1]
    p = np.flatnonzero(first)
    return p[live[np.searchsorted(x, p, "right") - 1]]


def _plate(t: Chunk):
    return np.flatnonzero(t.has(HAN)[:-1] & t.has(UPPER)[1:])


def _property(t: Chunk):
    text, places = t.text, set()
    for w in np.concatenate([t.places(x) for x in ("不动产", "房权证", "土地证")]).tolist():
        k = w
        while text[k - 1].isspace():
            k -= 1
        if text[k - 1] in ")）":
            k -= 1
        least = k - 10
        while k > least and "一" <= text[k - 1] <= "鿿":
            k -= 1
        if text[k - 1] in "（(":
            k -= 1
        places.update(range(k, w))
    return sorted(places)


def _token(t: Chunk):
    a, b = t.words
    a = a[b - a >= 20]
    parted = a[np.isin(t.codes[a - 1], [95, 45])] - 1
    return np.unique(np.concatenate([a, *(parted - n for n in (2, 3, 5, 6, 8))]))


def _time(t: Chunk):
    a, b = t.ascii_digits
    return a[((b - a == 4) | (b - a == 8)) & (t.codes[a] <= 51) & ((t.cls[a - 1] & ALNUM) == 0)]


def _email(t: Chunk, rx: re.Pattern) -> list[tuple[int, int]]:
    """From each sign back over the local part, or to the last match; where that start fails, later ones do."""
    out, last, text = [], 0, t.text
    for p in t.at("@").tolist():
        i = p
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < p and (m := rx.match(text, i)):
            last = m.end()
            out.append((i, last))
    return out


def _bank_branch(t: Chunk, rx: re.Pattern) -> list[tuple[int, int]]:
    """Within each stretch of Han characters that names a bank, or from the words that may stand before it."""
    out, last, text = [], 0, t.text
    named = np.concatenate([t.places("银行"), t.places("信用社")])
    if not len(named):
        return out
    a, b = _runs(t.has(HAN))
    for r in np.unique(np.searchsorted(a, named, "right") - 1).tolist():
        lo, hi = int(a[r]), int(b[r])
        j = lo
        while text[j - 1].isspace():
            j -= 1
        if text[j - 1] in ":：":
            j -= 1
            while text[j - 1].isspace():
                j -= 1
        if text[j - 3 : j] == "开户行":
            lo = j - 3
        at = max(lo, last)
        while m := rx.search(text, at, hi):
            at = last = m.end()
            out.append(m.span())
    return out


def _catalog() -> dict[str, Callable]:
    """Pattern -> places where it can begin."""
    by = {
        "phone_cn": _phone, "landline_cn": _landline, "id_card_cn": _id_card, "passport_cn": _passport, "case_no": _case_no, "case_no_contract": _case_no_contract,
        "execution_no": _execution_no, "org_code": _org_code, "bank_card_cn": _bank_card, "money_cn": _money, "plate_cn": _plate, "property_cert": _property, "api_token": _token,
    }
    return {**{r.pattern: by[r.rule_id] for r in RULES if r.rule_id in by}, TIME_PATTERN: _time}


def _whole() -> dict[str, Callable]:
    """Pattern -> its own scan."""
    by = {"email": _email, "bank_branch_cn": _bank_branch}
    return {r.pattern: by[r.rule_id] for r in RULES if r.rule_id in by}


class Scanner:
    """Scans texts for patterns. ``prepare`` is called once in a worker."""

    def __init__(self, patterns: list[str]):
        self.rx = [re.compile(p) for p in patterns]
        self.begins = [_catalog().get(p) for p in patterns]
        self.scans = [_whole().get(p) for p in patterns]
        self.characters = character_data()
        self.table = None

    def prepare(self) -> Scanner:
        self.table = _table(*self.characters)
        return self

    def chunks(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        at = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= _CHUNK:
                yield at, texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield at, texts[at:]

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, pattern, start, end, text) of all matches: by line, then pattern, then place.

        A last pattern number, one beyond the patterns, has the numbers of 12 to 19 digits.
        """
        parts, hits = [], []
        for first, some in self.chunks(texts):
            t = Chunk(some, self.table)
            found = []
            for k, rx in enumerate(self.rx):
                if self.scans[k]:
                    got = self.scans[k](t, rx)
                elif self.begins[k]:
                    got = _matched(rx, t.text, self.begins[k](t))
                else:
                    got = [(s + m.start(), s + m.end()) for s, x in zip(t.starts.tolist(), some) for m in rx.finditer(x)]
                if got:
                    g = np.array(got, np.int64)
                    found.append((g[:, 0], g[:, 1], np.full(len(g), k)))
            a, b = t.digits
            n = (b - a >= 12) & (b - a <= 19)
            found.append((a[n], b[n], np.full(int(n.sum()), len(self.rx))))
            s, e, k = (np.concatenate(x) for x in zip(*found))
            line = np.searchsorted(t.starts, s, "right") - 1
            order = np.lexsort((e, s, k, line))
            s, e, k, line = s[order], e[order], k[order], line[order]
            text = t.text
            hits.extend(text[i:j] for i, j in zip(s.tolist(), e.tolist()))
            begin = t.starts[line]
            parts.append((line + first, k, s - begin, e - begin))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none, _objects([])
        return *(np.concatenate(x) for x in zip(*parts)), _objects(hits)


# ---- detection ----------------------------------------------------------------------------------


def _offsets(line: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(line, minlength=n))]).astype(np.int32)


def _place(line: np.ndarray) -> np.ndarray:
    """Place of each row among those of its line; lines come in order."""
    if not len(line):
        return line
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return np.arange(len(line)) - np.repeat(new, np.diff(np.concatenate([new, [len(line)]])))


class Found:
    """Spans of a batch as columns; ``kinds`` are (entity_type, engine, rule_id, priority)."""

    def __init__(self, kinds: list[tuple], line, kind, start, end, order, texts: np.ndarray):
        self.kinds, self.line, self.kind, self.start, self.end, self.order, self.texts = kinds, line, kind, start, end, order, texts

    def take(self, index: np.ndarray) -> Found:
        """The spans at these places, or where this mask holds."""
        return Found(self.kinds, self.line[index], self.kind[index], self.start[index], self.end[index], self.order[index], self.texts[index])

    def with_(self, other: Found) -> Found:
        """Both, by line, these before the others."""
        if not len(other.line):
            return self
        both = Found(self.kinds, *(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("line", "kind", "start", "end", "order", "texts")))
        return both.take(np.argsort(both.line, kind="stable"))

    def named(self, i: int) -> pa.Array:
        kind = pa.array([k[i] for k in self.kinds], pa.int32() if i == 3 else pa.string())
        return kind.take(pa.array(self.kind, pa.int64()))

    def lists(self, n: int) -> pa.Array:
        number = lambda x: pa.array(x.astype(np.int32), pa.int32())
        columns = [self.named(0), number(self.start), number(self.end), pa.array(self.texts, pa.string()), self.named(1), self.named(2), self.named(3), number(self.order)]
        return pa.ListArray.from_arrays(pa.array(_offsets(self.line, n)), pa.StructArray.from_arrays(columns, fields=list(SPAN)))

    def ranks(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sort keys after the line: longest, higher priority, pattern before model, earlier discovery; and those by value, where the first leave ties."""
        engine = np.array([{"regex": 0, "ner": 1}.get(k[1], 99) for k in self.kinds] + [0])[self.kind]
        priority = np.array([np.inf if k[3] is None else k[3] for k in self.kinds] + [0], float)[self.kind]
        keys = [self.start - self.end, -priority, engine, self.order]
        lowest = self.order.min(initial=0)
        if len(np.unique(self.line * (self.order.max(initial=0) - lowest + 1) + self.order - lowest)) == len(self.line):
            return keys, []
        ties = lambda xs: np.unique(np.array(["0" if x is None else "1" + x for x in xs], object), return_inverse=True)[1]
        by_kind = lambda i: ties([self.kinds[k][i] for k in self.kind.tolist()])
        return keys, [by_kind(0), self.start, self.end, ties(self.texts), by_kind(1), by_kind(2), priority]


def _resolved(f: Found, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the kept spans by start and of the dropped ones by rank: greedy, each against all kept before.

    Only spans that meet others of their line are compared one by one.
    """
    keys, values = f.ranks()
    rank = np.empty(len(f.line), np.int64)
    rank[np.lexsort((*reversed(keys + values), f.line))] = np.arange(len(f.line))
    base = np.cumsum(room) - room
    s, e = f.start + base[f.line], f.end + base[f.line]
    by = np.argsort(s, kind="stable")
    group = np.cumsum(np.concatenate([[True], s[by][1:] >= np.maximum.accumulate(e[by])[:-1]])) if len(by) else by
    kept = np.ones(len(f.line), bool)
    crowd = np.bincount(group)[group] > 1 if len(by) else np.zeros(0, bool)
    several, of = by[crowd], group[crowd]
    order = np.lexsort((rank[several], of))
    several, of = several[order], of[order]
    now, mine, lost = -1, [], []
    for i, g, a, b in zip(several.tolist(), of.tolist(), s[several].tolist(), e[several].tolist()):
        if g != now:
            now, mine = g, [(a, b)]
            continue
        for x, y in mine:
            if x < b and a < y:
                lost.append(i)
                break
        else:
            mine.append((a, b))
    kept[lost] = False
    yes, no = np.flatnonzero(kept), np.flatnonzero(~kept)
    by_start = [x[yes] for x in (f.line, f.start, f.end, f.order, *values)]
    return yes[np.lexsort(by_start[::-1])], no[np.argsort(rank[no])]


_FIRST_YEAR = re.compile("(?:19|20)[0-9]{2}元")
_BANK = re.compile(BANK_CONTEXT)


class Detector:
    """Texts (and spans of other engines) to arrays of spans, and to redacted texts.

    dates: also the expressions of TIME_PATTERN. off: types that are found but
    left out of ``kept``. labels: type -> label, others are in brackets.
    wanted: names among spans, kept, dropped, bare_numbers, redacted_text, occurrences, n_entities
    (distinct types and texts among the occurrences).
    plain: the rules' spans alone, as they are found.
    """

    OCCURRENCE = pa.struct([("entity_type", pa.string()), ("original", pa.string()), ("replacement", pa.string()), ("engine", pa.string()), ("original_start", pa.int32()), ("original_end", pa.int32()), ("redacted_start", pa.int32()), ("redacted_end", pa.int32())])

    def __init__(self, rules: list[Rule], dates: bool = False, off: frozenset[str] = frozenset(), labels: dict[str, str] | None = None, wanted: tuple[str, ...] = ("spans",), plain: bool = False):
        self.kinds = [(r.entity_type, "regex", r.rule_id, r.priority) for r in rules]
        self.n_rules = len(rules)
        self.scanner = Scanner([r.pattern for r in rules] + ([TIME_PATTERN] if dates else []))
        if dates:
            self.kinds.append(("TIME", "regex", "time_profile", 80))
        self.account = len(self.kinds)
        self.kinds.append(("BANK_ACCOUNT", "regex", "bank_account_context", 110))
        self.off, self.labels, self.wanted, self.plain = off, labels or {}, wanted, plain

    def prepare(self) -> Detector:
        self.scanner.prepare()
        return self

    def found(self, texts: list[str | None]) -> tuple[Found, np.ndarray]:
        line, kind, start, end, hits = self.scanner.scan([x or "" for x in texts])
        f = Found(list(self.kinds), line, kind, start, end, np.zeros(len(line), np.int64), hits)
        room = np.fromiter((len(x or "") for x in texts), np.int64, len(texts)) + 1
        return f, room

    def rule_spans(self, f: Found) -> Found:
        f = f.take(f.kind < self.n_rules)
        f.order = _place(f.line)
        return f

    @staticmethod
    def _given(f: Found, extra: pa.Array) -> Found:
        """Spans of other engines, whose kinds join those that are there."""
        rows = [(i, s) for i, x in enumerate(extra.to_pylist()) for s in x or []]
        named = [(s["entity_type"], s["engine"], s["rule_id"], s["priority"]) for _, s in rows]
        number_of = {k: len(f.kinds) + i for i, k in enumerate(dict.fromkeys(named))}
        f.kinds.extend(number_of)
        kind = [number_of[k] for k in named]
        number = lambda xs: np.array(list(xs), np.int64)
        return Found(f.kinds, number(i for i, _ in rows), number(kind), *(number(s[c] for _, s in rows) for c in ("start", "end", "ord")), _objects([s["text"] for _, s in rows]))

    def __call__(self, column: pa.Array, extra: pa.Array | None = None) -> pa.Array:
        texts = column.to_pylist()
        n = len(texts)
        every, room = self.found(texts)
        f = self.rule_spans(every)
        if self.plain:
            allowed = np.array([k[0] not in self.off for k in f.kinds], bool)
            return f.take(allowed[f.kind]).lists(n)
        if extra is not None:
            given = self._given(f, extra)
            np.maximum.at(room, given.line, given.end + 1)
            f = f.with_(given)
        if self.account > self.n_rules:
            dates = every.take(every.kind == self.n_rules)
            dates.kinds, dates.order = f.kinds, self._last(f, n, -1)[dates.line] + 1 + _place(dates.line)
            f = f.with_(dates)
        free = every.take(every.kind == self.account)
        free = free.take(self._apart(free, f, room))
        near = np.array([_BANK.search(texts[i], max(0, s - 30), e + 30) is not None for i, s, e in zip(free.line.tolist(), free.start.tolist(), free.end.tolist())], bool)
        accounts, bare = free.take(near), free.take(~near)
        accounts.kinds, accounts.order = f.kinds, self._last(f, n, 0)[accounts.line] + 1 + _place(accounts.line)
        f = f.with_(accounts)
        years = self._first_years(f, texts)
        f = f.take(~years) if years.any() else f
        yes, no = _resolved(f, room)
        allowed = np.array([k[0] not in self.off for k in f.kinds], bool)
        yes = yes[allowed[f.kind[yes]]]
        out = {}
        if "spans" in self.wanted:
            out["spans"] = f.lists(n)
        if "dropped" in self.wanted:
            out["dropped"] = f.take(no).lists(n)
        if "bare_numbers" in self.wanted:
            out["bare_numbers"] = bare.lists(n)
        kept = f.take(yes)
        if "kept" in self.wanted:
            out["kept"] = kept.lists(n)
        if {"redacted_text", "occurrences", "n_entities"}.intersection(self.wanted):
            out["redacted_text"], out["occurrences"], out["n_entities"] = self._replaced(kept, texts)
        return pa.StructArray.from_arrays([out[c] for c in self.wanted], names=list(self.wanted))

    @staticmethod
    def _last(f: Found, n: int, none: int) -> np.ndarray:
        """Last discovery number of each line."""
        last = np.full(n, np.iinfo(np.int64).min)
        np.maximum.at(last, f.line, f.order)
        last[last == np.iinfo(np.int64).min] = none
        return last

    @staticmethod
    def _apart(free: Found, f: Found, room: np.ndarray) -> np.ndarray:
        """Which of the numbers meet no span."""
        base = np.cumsum(room) - room
        s, e = f.start + base[f.line], f.end + base[f.line]
        by = np.argsort(s, kind="stable")
        reach = np.concatenate([[-1], np.maximum.accumulate(e[by])])
        before = np.searchsorted(s[by], free.end + base[free.line], "left")
        return reach[before] <= free.start + base[free.line]

    @staticmethod
    def _first_years(f: Found, texts: list[str | None]) -> np.ndarray:
        """Amounts that are a year before 年, as in 2023元年."""
        out = np.zeros(len(f.line), bool)
        money = np.array([k[0] == "MONEY" for k in f.kinds], bool)[f.kind]
        for i in np.flatnonzero(money & (f.end - f.start == 5)).tolist():
            e = int(f.end[i])
            if _FIRST_YEAR.fullmatch(f.texts[i] or "") and (texts[f.line[i]] or "")[e : e + 1] == "年":
                out[i] = True
        return out

    def _replaced(self, kept: Found, texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Redacted texts, their occurrences and entities: spans by start, those that overlap one before skipped."""
        n = len(texts)
        same = kept.line[1:] == kept.line[:-1]
        if (same & (kept.start[1:] < kept.end[:-1])).any():
            use, line, at = [], -1, 0
            for i, (x, s, e) in enumerate(zip(kept.line.tolist(), kept.start.tolist(), kept.end.tolist())):
                line, at = (x, 0) if x != line else (line, at)
                if s >= at:
                    use.append(i)
                    at = e
            kept = kept.take(np.array(use, np.int64))
        labels = [self.labels.get(k[0], f"【{k[0]}】") for k in kept.kinds]
        size = np.array([len(x) for x in labels], np.int64)[kept.kind]
        grown = np.cumsum(size - (kept.end - kept.start))
        offsets = _offsets(kept.line, n)
        before = np.concatenate([[0], grown])
        begin = kept.start + before[:-1] - before[offsets[kept.line]] if len(kept.line) else kept.start
        number = lambda x: pa.array(x.astype(np.int32), pa.int32())
        label = pa.array(labels, pa.string()).take(pa.array(kept.kind, pa.int64()))
        columns = [kept.named(0), pa.array(kept.texts, pa.string()), label, kept.named(1), number(kept.start), number(kept.end), number(begin), number(begin + size)]
        occ = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(self.OCCURRENCE)))
        out = list(texts)
        spans = list(zip(kept.start.tolist(), kept.end.tolist(), kept.kind.tolist()))
        bounds = offsets.tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            text, at, pieces = texts[i], 0, []
            if a == b or text is None:
                continue
            for s, e, k in spans[a:b]:
                pieces += text[at:s], labels[k]
                at = e
            pieces.append(text[at:])
            out[i] = "".join(pieces)
        distinct = [0] * n
        if "n_entities" in self.wanted:
            types = [kept.kinds[k][0] for k in kept.kind.tolist()]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                distinct[i] = b - a if b - a < 2 else len(set(zip(types[a:b], kept.texts[a:b])))
        return pa.array(out, pa.string()), occ, pa.array(distinct, pa.int32())


def _sizes(lists: pa.Array) -> list[int]:
    return [n or 0 for n in pc.list_value_length(lists).to_pylist()]


def exported(texts: pa.Array, spans: pa.Array, style: str) -> pa.Array:
    """Texts with star masks or numbered placeholders for their spans by start; those that overlap one before are skipped.

    Placeholders count every span of a type in its text.
    """
    out = texts.to_pylist()
    flat = spans.flatten()
    start, end, original, kind = (flat.field(c).to_pylist() for c in ("start", "end", "text", "entity_type"))
    first = 0
    for i, n in enumerate(_sizes(spans)):
        text, at, pieces, seen = out[i], 0, [], {}
        for j in range(first, first + n if text is not None else first):
            seen[kind[j]] = number = seen.get(kind[j], 0) + 1
            if start[j] < at:
                continue
            pieces += text[at : start[j]], starred(original[j], kind[j]) if style == "star" else f"<{PLACEHOLDERS.get(kind[j], '敏感信息')}{number}>"
            at = end[j]
        if pieces:
            out[i] = "".join(pieces) + text[at:]
        first += n
    return pa.array(out, pa.string())


_TIMES = re.compile("[^年月日号时分秒]")


def starred(x: str | None, kind: str) -> str:
    """``masks.star`` of one text."""
    n = len(x or "")
    if not n:
        return ""
    if kind in ("PHONE", "LANDLINE"):
        return x[:3] + "****" + x[-4:] if n >= 11 else x[:1] + "***"
    if kind in ("ID_CARD", "PASSPORT", "ORG_CODE"):
        return x[:4] + "*" * (n - 8) + x[-4:] if n >= 15 else x[:3] + "*" * max(1, n - 6) + x[-3:]
    if kind in ("ORG", "BANK_BRANCH") and n > 4:
        return x[:2] + "*" * max(2, n - 4) + x[-2:]
    if kind in ("PERSON", "ORG", "BANK_BRANCH"):
        return x[:1] + "*" * max(1, n - 1)
    if kind == "EMAIL":
        at = x.find("@")
        return x[: min(2, at)] + "***" + x[at:] if at >= 0 else x[:2] + "***"
    if kind == "BANK_CARD":
        return "*" * (n - 4) + x[-4:] if n >= 8 else "*" * max(1, n - 2) + x[-2:]
    if kind == "MONEY":
        return "****" + x[-1:]
    if kind in ("DATE", "TIME"):
        return _TIMES.sub("*", x)
    return x[:1] + "***"


def restored(redacted: pa.Array, occurrences: pa.Array) -> pa.Array:
    """The source texts, by position: replacements that look alike stay apart."""
    out = redacted.to_pylist()
    flat = occurrences.flatten()
    begin, end, original = (flat.field(c).to_pylist() for c in ("redacted_start", "redacted_end", "original"))
    known = occurrences.is_valid().to_pylist()
    first = 0
    for i, n in enumerate(_sizes(occurrences)):
        text = out[i]
        if not known[i]:
            out[i] = None
        elif n and text is not None:
            at, pieces = 0, []
            for b, e, o in sorted(zip(begin[first : first + n], end[first : first + n], original[first : first + n])):
                pieces += text[at:b], o
                at = e
            out[i] = "".join(pieces) + text[at:]
        first += n
    return pa.array(out, pa.string())
