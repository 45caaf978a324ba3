"""Benchmark decontamination by spaced seeds, by DataFrame operations alone.

A seed mask reads some words of a window and ignores the others, so an equal
hash survives substitutions. A document is contaminated where at least ``share``
of some ``least`` consecutive words of a benchmark item (of all its words, if it
has fewer) stand in the same order and places. For each length that occurs, the
masks are chosen so that every pattern of allowed substitutions leaves one of
them intact somewhere (``masks_for``; the tests try every pattern). Around each
hit the aligned words are compared.

Words are runs of letters and digits, lower-cased; non-ASCII characters count
as letters. Items without words, and null or empty texts on either side, match
nothing. Documents equal in their key columns share their result rows; a null
doc_id is a value like any other. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

WIDEST = 8  # words that a mask may span
MOST = 3  # masks for one length
SEARCHED = 13  # longer windows are searched by a part of this length
#: Index rows that may be broadcast: about 100 bytes each, 100 MB at most.
BROADCAST_ROWS = 1_000_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def allowed(n: int, share: float) -> int:
    """Substitutions that n words may have."""
    return n - math.ceil(share * n - 1e-9)


@cache
def masks_for(n: int, gone: int) -> tuple[tuple[int, ...], ...]:
    """The fewest masks of the most words that hit n words, whichever ``gone`` of them differ.

    Of a window longer than SEARCHED some part of that length has no more than
    its share of the differences, so masks for the part will do.
    """
    if n > SEARCHED:
        return masks_for(SEARCHED, gone // (n // SEARCHED))
    patterns = [sum(1 << i for i in c) for c in combinations(range(n), gone)]

    def hits(mask) -> int:
        at = [sum(1 << (o + p) for p in mask) for o in range(n - mask[-1])]
        return sum(1 << k for k, pattern in enumerate(patterns) if any(not x & pattern for x in at))

    for size in range(n - gone, 0, -1):
        ends = range(size - 1, min(n, WIDEST)) if size > 1 else [0]
        masks = [(0, *inner, end) if end else (0,) for end in ends for inner in combinations(range(1, end), max(0, size - 2))]
        known = [hits(m) for m in masks]
        for k in range(1, MOST + 1):
            for chosen in combinations(range(len(masks)), k):
                union = 0
                for i in chosen:
                    union |= known[i]
                if union == (1 << len(patterns)) - 1:
                    return tuple(masks[i] for i in chosen)
    raise ValueError("a share of 0 leaves nothing to find")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _hash(mask: tuple[int, ...], h: str, at: Column) -> Column:
    """The mask's hash at a place, from 0; it begins with the mask, so masks don't mix."""
    return F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(h, at + p) for p in mask))


def _windows(rows: DataFrame, keep: list[str], at: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row a place and mask: kept columns, place, words' hashes, the mask's number and hash.

    Where a mask reaches beyond the text its hash is of fewer words; that can hit
    nothing whole, and each hit is verified.
    """
    rows = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("_h") - min(m[-1] for m in masks) - 1
    rows = rows.select(*keep, "_h", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias(at))
    seeds = []
    for k, mask in enumerate(masks):
        seeds += [F.lit(k), _hash(mask, "_h", F.col(at))]
    return rows.select(*keep, at, "_h", F.stack(F.lit(len(masks)), *seeds).alias("mask", "hash"))


def _before(h: str, at: str, masks: list[tuple[int, ...]]) -> Column:
    """The same mask's hash one place earlier; null at the first place."""
    out = F.lit(None).cast("long")
    for k, mask in enumerate(masks):
        out = F.when(F.col("mask") == k, _hash(mask, h, F.col(at) - 1)).otherwise(out)
    return F.when(F.col(at) > 0, out)


def _index(items: DataFrame, least: int, share: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """The items' seeds, by the masks for their lengths, and all masks in use."""
    n = F.least(F.size("words"), F.lit(least))
    lengths = sorted(r.n for r in items.select(n.alias("n")).distinct().collect() if r.n)
    parts, used = [], []
    for length in lengths:
        masks = list(masks_for(length, allowed(length, share)))
        used += [m for m in masks if m not in used]
        part = _windows(items.where(n == length), ["_item"], "j", masks)
        whole = F.element_at(F.array(*(F.lit(m[-1]) for m in masks)), F.col("mask") + 1)
        parts.append(part.where(F.col("j") + whole < F.size("_h")).select("_item", "j", "hash", _before("_h", "j", masks).alias("item_before")))
    out = parts[0] if parts else items.select("_item", F.lit(0).alias("j"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("item_before")).limit(0)
    for part in parts[1:]:
        out = out.union(part)
    return written(out, "seeds"), used or [(0,)]


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, keys: dict[str, Column] | None = None) -> DataFrame:
    """The key columns (doc_id), item_id, overlap (best share of a stretch), matched (its words).

    One row for each document and item that it contains. ``least`` and ``share``
    decide; every hit is verified, none is capped. A small index is broadcast. A
    large one is joined by hash with places alone; the words come back to the
    documents with a hit, once each.
    """
    keys = keys or {"doc_id": F.col("doc_id")}
    names = list(keys)
    items = benchmark.select(F.monotonically_increasing_id().alias("_item"), "item_id", words_of(F.col("text")).alias("words"))
    items = written(items, "items")
    index, masks = _index(items, least, share)
    small = index.count() <= BROADCAST_ROWS
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), words_of(F.col("text")).alias("words"))
    shift = (F.col("i") - F.col("j")).alias("shift")
    if small:
        found = _windows(rows, [*names, "words"], "i", masks).join(F.broadcast(index), "hash")
        # A run of hits along one diagonal is verified once, at its first.
        found = found.where(~F.coalesce(_before("_h", "i", masks) == F.col("item_before"), F.lit(False)))
        found = found.select(*names, "words", shift, "_item")
    else:
        rows = rows.withColumn("_row", F.struct(*names, F.xxhash64("words")))
        hits = _windows(rows, ["_row"], "i", masks).select("_row", "i", "hash").join(index, "hash").select("_row", shift, "_item").distinct()
        found = written(hits, "hits").join(rows.dropDuplicates(["_row"]), "_row").select(*names, "words", "shift", "_item")
    texts = items.select("_item", "item_id", F.col("words").alias("item"))
    found = found.join(F.broadcast(texts) if small else texts, "_item")
    same = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda k: F.get("words", F.col("shift") + k).eqNullSafe(F.get("item", k)))
    aligned = found.select(*names, "item_id", F.least(F.size("item"), F.lit(least)).alias("n"), same.alias("same"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("n") + 1), lambda p: F.size(F.filter(F.slice("same", p, F.col("n")), lambda x: x))))
    scored = aligned.select(*names, "item_id", "n", best.alias("matched")).where(F.col("matched") >= F.col("n") * share - 1e-9)
    return scored.groupBy(*names, "item_id").agg(F.max(F.col("matched") / F.col("n")).alias("overlap"), F.max("matched").alias("matched"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that contain no benchmark passage, all columns as they were."""
    keys = {"_id": F.col("doc_id"), "_text": F.xxhash64("text")}
    bad = written(matches(docs, benchmark, keys=keys, **how).select("_id", "_text").distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_text"])
    return docs.join(bad, same, "left_anti")
