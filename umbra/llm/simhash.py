"""Near duplicates by SimHash: fingerprints, exact tiled comparison, classes.

Fingerprints within the radius differ in ``radius`` of ``radius + k`` bit blocks
at most, so they agree in some k of them: equal values of k blocks deal the
distinct fingerprints into groups. k follows their number, so a group of
unrelated fingerprints stays about a tile however many there are. A group larger
than a tile is cut into tiles by population count and hash; each pair of tiles
whose counts can meet is compared whole with exclusive-or and bit counts, in
one task. A comparison reports a spanning forest of its links, never all pairs:
that keeps every connection between different texts.

``nearcopies`` has the form of this operator that keeps one document of each
group of near copies.

Nulls and empty texts have fingerprint zero and link like any other. Repeated
rows share a fingerprint, hence a class. A class without any non-null doc_id has
a null component_id. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import components, small_batches, written

TILE = 1024
CHUNK = 1 << 16  # shingles whose bits are counted together


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)), np.uint64, n))


def bits_of(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """The key columns (doc_id) and ``fp``, a signed 64-bit long."""
    small_batches(docs.sparkSession)
    keys = keys or {"doc_id": F.col("doc_id")}
    chosen = docs.select(F.col(text).alias("text"), *(c.alias(k) for k, c in keys.items()))
    fields = chosen.schema.fields[1:]

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp.view(np.int64))], [*(f.name for f in fields), "fp"])

    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long")


def blocks_of(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of n blocks that cover 64 bits."""
    out, at = [], 0
    for i in range(n):
        bits = 64 // n + (i < 64 % n)
        out.append((at, bits))
        at += bits
    return out


def agreeing(n: int, radius: int, tile: int) -> int:
    """The least number of equal blocks that leaves n unrelated fingerprints in groups of about a tile."""
    k = 1
    while n > tile << (k * (64 // (radius + k))) and k * (64 // (radius + k)) < (k + 1) * (64 // (radius + k + 1)):
        k += 1
    return k


def block_values(fp: Column, radius: int, k: int) -> list[Column]:
    """The values of every k of radius + k blocks, of which linked fingerprints share one."""
    out = []
    for chosen in combinations(blocks_of(radius + k), k):
        value = F.lit(0).cast("long")
        for at, bits in chosen:
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND((1 << bits) - 1))
        out.append(value)
    return out


def forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that span what lies within the radius, among x or between x and y."""
    both = x if y is None else np.concatenate((x, y))
    counts = np.bitwise_count(both.view(np.uint64)).astype(np.int64)
    label = np.arange(len(both))
    out = []
    ys = np.arange(len(both)) if y is None else np.arange(len(x), len(both))
    order = ys[np.argsort(counts[ys], kind="stable")]
    rows = np.argsort(counts[: len(x)], kind="stable")
    near = counts[order]
    for k in range(0, len(rows), 256):
        r = rows[k : k + 256]
        i, j = np.searchsorted(near, counts[r[0]] - radius), np.searchsorted(near, counts[r[-1]] + radius, "right")
        if i == j:
            continue
        cols = order[i:j]
        hit = np.bitwise_count(both[r][:, None].view(np.uint64) ^ both[cols][None].view(np.uint64)) <= radius
        for p, row in zip(r, hit, strict=True):
            found = cols[row]
            found = found[label[found] != label[p]]
            if len(found):
                merged, at = np.unique(label[found], return_index=True)
                out += [(int(both[p]), int(both[q])) for q in found[at]]
                label[np.isin(label, merged)] = label[p]
    return out


def _tile(count: str, part: Column) -> Column:
    return F.shiftleft(F.col(count).cast("long"), 32) + part


def tiled(members: DataFrame, group: list[str], radius: int, tile: int) -> DataFrame:
    """members (group columns, fp, others) as rows of tile pairs: group, p, q, side, fp, others; by task, in this order.

    A group up to a tile stays whole. In a larger one each population count has
    its own tiles, by hash; pairs of tiles whose counts can't meet aren't made.
    """
    rest = [c for c in members.columns if c not in (*group, "fp")]
    dealt = members.withColumn("pc", F.bit_count("fp"))
    cut = F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("count") / tile).cast("int"))))  # 65 entries at most
    groups = dealt.groupBy(*group, "pc").count().groupBy(*group).agg(F.sum("count").alias("total"), cut.alias("cut")).where("total > 1")
    tiles = dealt.join(written(groups, "groups"), group)
    zero = F.lit(0).cast("long")
    out = lambda rows, p, q, side: rows.select(*group, p.alias("p"), q.alias("q"), F.lit(side).alias("side"), "fp", *rest)
    small = out(tiles.where(F.col("total") <= tile), zero, zero, 0)
    big = tiles.where(F.col("total") > tile)
    big = big.select("*", _tile("pc", F.pmod(F.xxhash64("fp", *rest), F.col("cut")[F.col("pc")])).alias("t"))
    count = F.col("cut")[F.col("pd")]
    met = lambda low, high: (  # noqa: E731  the tiles of the counts from pc + low to pc + high
        big.select("*", F.explode(F.sequence(F.col("pc") + low, F.col("pc") + high)).alias("pd"))
        .select("*", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("d"))
        .select("*", _tile("pd", F.col("d")).alias("u"))
    )
    first = out(met(0, radius).where("t <= u"), F.col("t"), F.col("u"), 0)
    second = out(met(-radius, 0).where("u < t"), F.col("u"), F.col("t"), 1)
    key = [*group, "p", "q"]
    return small.union(first).union(second).repartition(*key).sortWithinPartitions(*key)


def by_tile_pair(batches, n_key: int):
    """Of rows from ``tiled``: the columns of each tile pair, from side on, and whether it is one tile with itself."""
    keep = None
    for batch in batches:
        t = [c.to_numpy() for c in batch.columns]
        if keep is not None:
            t = [np.concatenate(x) for x in zip(keep, t, strict=True)]
        new = np.zeros(len(t[0]), bool)
        for x in t[:n_key]:
            new[1:] |= x[1:] != x[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(new)))
        keep = [x[cuts[-1] :].copy() for x in t]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield [x[i:j] for x in t[n_key:]], bool(t[n_key - 2][i] == t[n_key - 1][i])
    if keep is not None and len(keep[0]):
        yield keep[n_key:], bool(keep[n_key - 2][0] == keep[n_key - 1][0])


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): fingerprints at most ``radius`` bits apart, enough to connect all such.

    distinct: one row a fingerprint, column fp.
    """
    k = agreeing(distinct.count(), radius, tile)
    parts = F.array(*(F.struct(F.lit(i).alias("b"), v.alias("v")) for i, v in enumerate(block_values(F.col("fp"), radius, k))))
    dealt = distinct.select("fp", F.explode(parts).alias("k")).select("k.b", "k.v", "fp")

    def run(batches):
        for (side, fp), whole in by_tile_pair(batches, 4):
            one = side == 1
            if len(fp) > 1 and (whole or one.any() and not one.all()):
                if found := forest(fp if whole else fp[~one], None if whole else fp[one], radius):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tiled(dealt, ["b", "v"], radius, tile).mapInArrow(run, "a long, b long")


def classes(fps: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp -> also component_id and class_fp, the class's least fp. fps: a written table."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(rooted.join(ids, "root").select("fp", "component_id", F.col("root").alias("class_fp")), "byfp")
    return fps.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    return classes(written(fingerprints(docs, size), "fps"), radius)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
