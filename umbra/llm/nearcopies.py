"""SimHash near-dedup of whole documents: five-word shingles, Jaccard 0.8 or more.

Sets that similar have fingerprints 10 bits apart on average, too far for equal
bit blocks to narrow the search. Here the groups come from shared shingles: two
such sets share one among the first n - ceil(share n) + 1 of each in any common
order. Within a group, in tiles, fingerprints are compared by exclusive-or and
bit counts at a wide radius, 64 bits, then 256, and the pairs left are
compared whole, so nothing is linked that isn't similar. A pair exactly at the
threshold lies beyond a radius with a probability of 2 in a million at most (sets
of five; 6 in a billion for longer ones).

Whole sets lie in files of the shared folder that tasks map, so a tile compares
them where it stands and reports a spanning forest of its links: no pair leaves
a task that links nothing, however many a large group has.

The order is by how many distinct texts hold a shingle, rarest first, so a text
without near copies has little but shingles of its own there and joins no
group, and what a whole corpus repeats forms none unless a text has little else.
Frequencies are counted over all texts, for the half of all shingles that has
the lower hashes; the others stand last. A prefix seldom reaches that far. Each
distinct set stands for its copies, and of groups with the same members one is
compared. Groups are first compared with one member each, over a round or more,
so most of a large group of near copies is connected before any tile is.

A text with fewer words is one shingle; nulls and empty texts have the empty
set and are copies of each other. Repeated rows are copies. Of a class the row
of the least doc_id stays (null last), any one of equal rows. Extra columns are
kept, packed in a struct meanwhile. Empty tables give empty results. Words are
as for SimHash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, components, fresh_dir, local_path, mapped, numbered, part_number, partitions_for, put_bytes, put_ids, remove, run_starts, six, small_batches, tidy, unsix, with_ids, written
from .simhash import TILE, bits_of, by_tile_pair

RADIUS = 28
WIDE = 80  # of all 256 bits
MORE = [f"fp{k}" for k in (1, 2, 3)]  # the columns of the further bits
BLOCK = 512  # rows of a tile whose whole sets are compared together
BLOCK_SHINGLES = 500_000  # in all, unless one set has more
COLUMNS = 4096  # shingles counted together in a block
FLUSH = 2_000_000  # shingles counted, or whole sets' shingles written, together in a task
FILES = 200  # mapped at a time
OPEN = 1024  # tiles are compared once so many pairs are left for each member of a group
LOW48 = np.uint64((1 << 48) - 1)
HALF = np.uint64(1 << 63)  # hashes below are counted


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def further_bits(h: np.ndarray) -> list[int]:
    """192 bits beside ``bits_of``, from the same hashes mixed again three times (the splitmix64 finish)."""
    out = []
    for k in range(1, len(MORE) + 1):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(bits_of(x ^ (x >> np.uint64(31))))
    return out


def prefix(own: np.ndarray, share: float, counts: np.ndarray) -> np.ndarray:
    """Places of the first shingles of an order by count, then hash, those not counted last; similar sets share one of these."""
    n = len(own) - math.ceil(share * len(own) - 1e-9) + 1 if len(own) else 0
    return np.argsort(np.where(own < HALF, counts, 256), kind="stable")[:n]


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """uid, doc_id, key (of the whole set)."""
    chosen = rows.select("uid", "row.doc_id", "row.text")

    def run(batches):
        for b in batches:
            key = [xxhash.xxh3_128_digest(shingles(t.as_py(), size).tobytes()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.binary())], ["uid", "doc_id", "key"])

    return chosen.mapInArrow(run, f"uid long, doc_id {chosen.schema['doc_id'].dataType.simpleString()}, key binary")


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(h << np.uint64(1), n)


def count_shingles(rows: DataFrame, ids: str, size: int, n_buckets: int) -> str:
    """How many of the texts in the folder ``ids`` hold each shingle that several hold, up to 255.

    A file for each bucket of lower hashes: ascending 48-bit values, then counts.
    A task sends each hash it has counted once, so a frequent one costs a group
    as much as any other.
    """
    path = fresh_dir(rows.sparkSession, "counts")

    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        where, n = _bucket(h, n_buckets), np.minimum(n, 255).astype(np.uint8)
        cuts = np.append(run_starts(where), len(where))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(where[i])], pa.int32()), pa.array([six(h[i:j] & LOW48)], pa.binary()), pa.array([n[i:j].tobytes()], pa.binary())], ["bucket", "h", "n"])

    def spread(batches):
        held, held_n = [], 0
        for b in batches:
            for t in b.column(1):
                own = shingles(t.as_py(), size)
                held.append(own[own < HALF])
                held_n += len(held[-1])
                if held_n >= FLUSH:
                    yield from flush(held)
                    held, held_n = [], 0
        if held_n:
            yield from flush(held)

    def gather(table: pa.Table) -> pa.Table:
        h = np.concatenate([unsix(b.as_py()) for b in table.column("h")])
        n = np.concatenate([np.frombuffer(b.as_py(), np.uint8) for b in table.column("n")])
        order = np.argsort(h)
        h = h[order]
        at = run_starts(h)
        n = np.minimum(np.add.reduceat(n[order].astype(np.int64), at), 255).astype(np.uint8)
        h = h[at]
        put_bytes(f"{path}/{table.column('bucket')[0].as_py()}", [h[n > 1].astype("<u8").tobytes(), n[n > 1].tobytes()])
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    dealt = with_ids(rows.select("uid", "row.text"), ids, spread, "bucket int, h binary, n binary")
    with tidy(rows.sparkSession):
        dealt.groupBy("bucket").applyInArrow(gather, "n long").agg(F.sum("n")).collect()
    return path


class Counts:
    """The written counts, mapped bucket by bucket."""

    def __init__(self, path: str, n_buckets: int):
        self.path, self.n_buckets, self.files = path, n_buckets, {}

    def _file(self, bucket: int):
        if bucket not in self.files:
            raw = mapped(f"{self.path}/{bucket}")
            n = len(raw) // 9
            self.files[bucket] = raw[: 8 * n].view("<u8"), raw[8 * n :]
        return self.files[bucket]

    def of(self, h: np.ndarray) -> np.ndarray:
        """The counts of hashes that were counted: 1 where no other text holds one, 2 where that isn't known."""
        out = np.where(h < HALF, 1, 2)
        low = np.flatnonzero(h < HALF)
        where = _bucket(h[low], self.n_buckets)
        order = np.argsort(where, kind="stable")
        cuts = np.append(run_starts(where[order]), len(order))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = low[order[i:j]]
            keys, n = self._file(int(where[order[i]]))
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, h[at] & LOW48), len(keys) - 1)
                hit = keys[pos] == h[at] & LOW48
                out[at[hit]] = n[pos[hit]]
        return out


class Sets:
    """The whole sets that ``members`` has written, by file, place and length; a remote store's are read by range."""

    def __init__(self, path: str):
        self.path, self.files = path, {}

    def of(self, file: int, at: int, n: int) -> np.ndarray:
        if file not in self.files:
            if len(self.files) >= FILES:
                self.files.clear()
            uri = f"{self.path}/{file}"
            if local_path(uri) is None:
                from pyarrow import fs

                store, name = fs.FileSystem.from_uri(uri)
                self.files[file] = store.open_input_file(name)
            else:
                self.files[file] = mapped(uri).view("<u8")
        data = self.files[file]
        return data[at : at + n] if isinstance(data, np.ndarray) else np.frombuffer(data.read_at(8 * n, 8 * at), "<u8")


def members(rows: DataFrame, ids: str, sets_at: str, size: int, share: float) -> DataFrame:
    """uid, n, file and at (of the whole set in the folder ``sets_at``), fp and further bits, hs: the prefix shingles that several texts share, of the rows in the folder ``ids`` that have any."""
    n_buckets = partitions_for(rows)
    path = count_shingles(rows, ids, size, n_buckets)

    def run(batches):
        counts = Counts(path, n_buckets)
        file, held, held_n = part_number() << 20, [], 0
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            known = counts.of(np.concatenate([np.zeros(0, np.uint64), *sets]))
            used, places, hs, at = [], [], [np.zeros(0, np.uint64)], 0
            for k, own in enumerate(sets):
                c = known[at : at + len(own)]
                at += len(own)
                first = prefix(own, share, c)
                first = first[c[first] > 1]
                if len(first):
                    used.append(k)
                    hs.append(own[first])
                    places.append(held_n)
                    held.append(own.astype("<u8").tobytes())
                    held_n += len(own)
            bits = np.array([[bits_of(sets[k]), *further_bits(sets[k])] for k in used], np.uint64).reshape(-1, 1 + len(MORE)).view(np.int64)
            ends = pa.array(np.cumsum([len(x) for x in hs]), pa.int32())
            cols = [b.column(0).take(pa.array(used, pa.int64())), pa.array([len(sets[k]) for k in used], pa.int32()), pa.array([file] * len(used), pa.int64()), pa.array(places, pa.int64()), *(pa.array(bits[:, k].copy()) for k in range(bits.shape[1]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hs).view(np.int64)))], ["uid", "n", "file", "at", "fp", *MORE, "hs"])
            if held_n >= FLUSH:
                put_bytes(f"{sets_at}/{file}", held)
                file, held, held_n = file + 1, [], 0
        if held:
            put_bytes(f"{sets_at}/{file}", held)

    more = "".join(f", {c} long" for c in MORE)
    return with_ids(rows.select("uid", "row.text"), ids, run, f"uid long, n int, file long, at long, fp long{more}, hs array<long>")


def groups_of(docs: DataFrame) -> DataFrame:
    """h, c, uid, n, file, at, fp and further bits: the different groups of ``members`` that share a shingle, c rows each, as a written table.

    Near copies share many shingles, so most groups hold the same rows; one of
    each kind stays. Kinds are told by size, least and greatest uid and a digest.
    """
    each = docs.select(F.explode("hs").alias("h"), "uid")
    marks = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.bit_xor(F.xxhash64("uid")).alias("x")).where("c > 1")
    one = written(marks.groupBy("c", "lo", "hi", "x").agg(F.min("h").alias("h")).select("h", "c"), "kinds")
    places = written(each.join(one, "h"), "places")
    out = written(places.join(docs.drop("hs"), "uid").select("h", "c", "uid", "n", "file", "at", "fp", *MORE), "groups")
    remove(one, places)
    return out


def shared(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many elements each set of the places ``rows`` has in common with each other one of ``cols``."""
    held, counts = np.unique(np.concatenate(sets), return_counts=True)
    held = held[counts > 1]
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not len(held):
        return out
    at = [np.searchsorted(held, x) for x in sets]
    at = [p[held[np.minimum(p, len(held) - 1)] == x] for p, x in zip(at, sets, strict=True)]
    for k in range(0, len(held), COLUMNS):
        has = np.zeros((len(sets), min(COLUMNS, len(held) - k)), np.float32)
        for one, p in zip(has, at, strict=True):
            i, j = np.searchsorted(p, (k, k + COLUMNS))
            one[p[i:j] - k] = 1
        out += has[rows] @ has[cols].T
    return out


def _blocks(rows: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The rows in blocks of bounded length and of bounded shingles in all."""
    out, start, total = [], 0, 0
    for k, x in enumerate(n[rows].tolist()):
        if k > start and (k - start >= BLOCK or total + x > BLOCK_SHINGLES):
            out.append(rows[start:k])
            start, total = k, 0
        total += x
    return [*out, rows[start:]] if len(rows) else out


def _links(rows, cols, same, tile, label, sets, share, radius, wide) -> list[tuple[int, int]]:
    """Pairs of places in a tile, one of ``rows`` and one of ``cols``, that connect its similar sets of different labels; merges the labels."""
    n, file, at, bits = tile
    low, high = np.minimum(n[rows][:, None], n[cols][None]), np.maximum(n[rows][:, None], n[cols][None])
    near = (label[rows][:, None] != label[cols][None]) & (low >= share * high - 1e-6)
    i, j = np.nonzero(np.triu(near) if same else near)
    i, j = rows[i], cols[j]
    far = np.bitwise_count(bits[0][i] ^ bits[0][j]).astype(np.int16)
    yes = far <= radius
    i, j, far = i[yes], j[yes], far[yes]
    for x in bits[1:]:
        far += np.bitwise_count(x[i] ^ x[j])
    i, j = i[far <= wide], j[far <= wide]
    if not len(i):
        return []
    rows, i_at = np.unique(i, return_inverse=True)
    cols, j_at = np.unique(j, return_inverse=True)
    used = np.union1d(rows, cols)
    both = shared([sets.of(int(file[x]), int(at[x]), int(n[x])) for x in used], np.searchsorted(used, rows), np.searchsorted(used, cols))
    both = both[i_at, j_at].astype(np.float64)
    yes = both >= share * (n[i] + n[j] - both) - 1e-9
    i, j, out = i[yes], j[yes], []
    cuts = np.append(run_starts(i), len(i))
    for k, m in zip(cuts[:-1], cuts[1:], strict=True):
        p, others = i[k], j[k:m]
        others = others[label[others] != label[p]]
        if len(others):
            merged, first = np.unique(label[others], return_index=True)
            out += [(p, q) for q in others[first]]
            label[np.isin(label, merged)] = label[p]
    return out


def _tile_links(share: float, radius: int, wide: int, sets_at: str):
    """Rows of ``dealt`` to links (a, b) of uids: of similar sets, enough to connect all such in a pair of tiles."""

    def run(batches):
        sets = Sets(sets_at)
        for (side, uid, n, root, file, at, *bits), whole in by_tile_pair(batches, 3):
            tile, label, found = (n, file, at, [x.view(np.uint64) for x in bits]), root.copy(), []
            rows = _blocks(np.arange(len(uid)) if whole else np.flatnonzero(side == 0), n)
            cols = rows if whole else _blocks(np.flatnonzero(side == 1), n)
            for k, r in enumerate(rows):
                for c in cols[k:] if whole else cols:
                    found += _links(r, c, r is c, tile, label, sets, share, radius, wide)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(uid[j])], ["a", "b"])

    return run


def dealt(own: DataFrame, tile: int) -> DataFrame:
    """h, p, q, side, uid, n, root, file, at, fp and further bits: a group's rows in pairs (p, q) of its tiles; by task, in this order.

    A row of a group that is one tile stands there once, of a larger group once
    for each of its tiles.
    """
    n = F.ceil(F.col("c") / tile)
    each = own.withColumn("t", F.pmod(F.xxhash64("uid"), n)).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    rest = ["uid", "n", "root", "file", "at", "fp", *MORE]
    out = each.select("h", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q"), (F.col("t") > F.col("u")).cast("int").alias("side"), *rest)
    return out.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")


def similar(pairs: DataFrame, share: float, sets_at: str) -> DataFrame:
    """(a, b): the uids of the pairs (a, b) of uid, n, file and at whose whole sets are similar."""

    def run(batches):
        sets = Sets(sets_at)
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.concatenate([sets.of(z["file"], z["at"], z["n"]) for z in (x, y)])
                w.sort()
                both = np.count_nonzero(w[1:] == w[:-1])
                if both >= share * (len(w) - both) - 1e-9:
                    found.append((x["uid"], y["uid"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def connected(groups: DataFrame, sets_at: str, share: float, radius: int, wide: int) -> DataFrame:
    """(node, root) of the rows with similar ones, as a written table."""
    total, before = groups.count(), None
    links = written(found_in_turn(groups.withColumn("root", F.col("uid")), 0, share, radius, wide, sets_at), "links")
    roots = components(links)
    for turn in range(1, 1 << 30):
        own = groups.join(roots, groups.uid == roots.node, "left").select(*groups.columns, F.coalesce("root", "uid").alias("root"))
        of = own.groupBy("h", "root").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("h").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        of = written(of.select("h", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("open")).where("open > 0"), "open")
        open_ = of.agg(F.sum("open")).first()[0] or 0
        if not open_:
            remove(groups, of, links)
            return roots
        own = written(own.join(of.select("h"), "h", "left_semi"), "groups")  # groups of one root are done
        remove(groups, of)
        groups = own.drop("root")
        last = open_ <= OPEN * total or before is not None and open_ > 0.9 * before
        before = open_
        if last:
            found = dealt(own, TILE).mapInArrow(_tile_links(share, radius, wide, sets_at), "a long, b long")
        else:
            found = found_in_turn(own, turn, share, radius, wide, sets_at)
        links = links.union(written(found, "links"))
        remove(roots)
        roots = components(links)
        if last:
            remove(groups, links)
            return roots


def found_in_turn(own: DataFrame, turn: int, share: float, radius: int, wide: int, sets_at: str) -> DataFrame:
    """Links (a, b) of members with one of their group, as far as can be the same one in many groups."""
    place = ["uid", "n", "file", "at"]
    one = own.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "root", "uid").alias("x"), *place, "root", "fp", *MORE)).alias("m"))
    apart = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"m.{c}")))
    near = (F.least("n", "m.n") >= share * F.greatest("n", "m.n") - 1e-6) & (apart("fp") <= radius) & (sum(map(apart, MORE), apart("fp")) <= wide)
    pairs = own.join(one, "h").where((F.col("root") != F.col("m.root")) & near)
    two = F.struct(*place), F.struct(*(F.col(f"m.{c}").alias(c) for c in place))
    return similar(pairs.select(F.least(*two).alias("a"), F.greatest(*two).alias("b")).distinct(), share, sets_at)


def keep_one(docs: DataFrame, size: int = 5, share: float = 0.8, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """One row of each class of near copies: of the least doc_id (null last), any one of equal rows."""
    small_batches(docs.sparkSession)
    rows = numbered(docs, "rows")
    sigs = written(signatures(rows, size), "sigs")
    firsts = sigs.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("m"))
    firsts = written(firsts.select("m", "m.uid"), "firsts")
    remove(sigs)
    sets_at = fresh_dir(docs.sparkSession, "sets")
    found = written(members(rows, put_ids(firsts, "firsts"), sets_at, size, share), "members")
    groups = groups_of(found)
    remove(found)
    roots = connected(groups, sets_at, share, radius, wide)
    classed = firsts.join(roots, firsts.uid == roots.node, "left").select("m", F.coalesce("root", "uid").alias("uid"))
    kept = put_ids(classed.groupBy("uid").agg(F.min("m").alias("m")).select("m.uid"), "kept")
    remove(firsts, roots, sets_at)
    return with_ids(rows, kept).select("row.*")
