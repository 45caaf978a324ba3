"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each task packs its distinct bigrams into one block per bucket of
context hashes; a bucket's blocks meet in one group, which writes the bucket's
sorted hash arrays to the shared folder. A context that is a large share of all
words is hot: its pairs are dealt by the whole pair, and its sums meet in the
next group, so no bucket holds a frequent word's whole list of followers. Which
contexts are hot decides places alone, never a score. Scoring workers map those
files.

Nulls and empty texts are the empty token sequence, scored as its end token
alone. Repeated rows count and are scored repeatedly. An empty training table
gives the uniform model over one unknown word, hence score 0. Extra columns are
ignored.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import among, bucket_of, fresh_dir, mapped, partitions_for, put_bytes, run_starts, six, small_batches, unsix, written

START, END = 1, 2
FLUSH = 4_000_000  # tokens counted together in a task
SCORED = 1_000_000  # tokens looked up together
HOT_WORDS = 100_000  # so many hot contexts at most, whatever the input's size
LOW48 = np.uint64((1 << 48) - 1)


def word_hash(word: bytes) -> int:
    """64-bit hash of a lower-cased word; the two marks keep their own values."""
    h = xxhash.xxh64_intdigest(word)
    return h if h > END else h + 3


class _Ids(dict):
    """Word -> dense id, in order of first use; 0 and 1 are the marks."""

    def __missing__(self, word):
        self[word] = n = len(self) + 2
        return n

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self) + 2, np.uint64)
        out[:2] = START, END
        out[2:] = np.fromiter(map(word_hash, self), np.uint64, len(self))
        return out


def _words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.lower() and bytes.split() know ASCII only, as asked."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a context's hash and the low 48 bits of a word's."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b & LOW48) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def place_of(a: np.ndarray, b: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    """Each pair's bucket: by its context, by the whole pair where that is hot."""
    return np.where(among(a, hot), bucket_of(pair_hash(a, b), n), bucket_of(a, n))


def hot_contexts(docs: DataFrame, share: float) -> np.ndarray:
    """Ascending hashes of the words that are about ``share`` of all words or more, and START.

    docs: one column, the text. Tasks report the words that are ``share`` of what
    they count together, so a word can be undercounted but never overcounted;
    the driver gets 1 / share of them at most.
    """

    def run(batches):
        n, size = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                words = _words(text.as_py())
                n.update(words)
                size += len(words)
                if size >= FLUSH:
                    yield rows(n, size)
                    n, size = Counter(), 0
        yield rows(n, size)

    def rows(n, size):
        found = [(word_hash(w), c) for w, c in n.items() if c >= size * share]
        hashes = np.array([0, *(h for h, _ in found)], np.uint64)  # 0 is no word's hash; it counts all
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array([size, *(c for _, c in found)], pa.int64())], ["hash", "n"])

    sums = written(docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "frequent")
    total = sums.where("hash = 0").agg(F.sum("n")).first()[0] or 0
    found = [r.hash for r in sums.where((F.col("hash") != 0) & (F.col("n") >= total * share)).collect()]
    return np.sort(np.append(np.array(found, np.int64).view(np.uint64), np.uint64(START)))


def _pairs(ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
    r = rank[ids].astype(np.uint64)
    return r[:-1] << np.uint64(32) | r[1:]


def _small_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; 255 marks one that follows in full."""
    big = c[c >= 255].astype("<u8")
    return np.minimum(c, 255).astype(np.uint8).tobytes() + big.tobytes()


def _unsmall(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(b, "<u8", offset=n).astype(np.int64)
    return c


def _block(ctx, runs, words, counts) -> bytes:
    head = np.array([len(ctx), len(words)], "<u8").tobytes()
    return head + ctx.astype("<u8").tobytes() + runs.astype("<u4").tobytes() + six(words) + _small_counts(counts)


def _unblock(b: bytes):
    n, m = (int(x) for x in np.frombuffer(b, "<u8", 2))
    ctx = np.frombuffer(b, "<u8", n, 16)
    runs = np.frombuffer(b, "<u4", n, 16 + 8 * n)
    at = 16 + 12 * n
    return np.repeat(ctx, runs), unsix(b[at : at + 6 * m]), _unsmall(b[at + 6 * m :], m)


def _count_blocks(n_buckets: int, hot: np.ndarray):
    def flush(ids: _Ids, seen: list[list[int]]):
        h = ids.hashes()
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        key = np.sort(_pairs(np.fromiter((x for s in seen for x in s), np.int64, sum(map(len, seen))), rank))
        at = run_starts(key)
        n = np.diff(np.append(at, len(key)))
        key = key[at]
        a, b = h[(key >> np.uint64(32)).astype(np.int64)], h[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        keep = a != END  # the step from one text's end to the next text's start
        a, b, n = a[keep], b[keep], n[keep]
        where = place_of(a, b, n_buckets, hot)
        order = np.argsort(where, kind="stable")  # by context within a bucket, as before
        where, a, b, n = where[order], a[order], b[order], n[order]
        cuts = np.append(run_starts(where), len(where))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            c = run_starts(a[i:j])
            yield int(where[i]), _block(a[i:j][c], np.diff(np.append(c, j - i)), b[i:j], n[i:j])

    def run(batches):
        ids, seen, size = _Ids(), [], 0
        for batch in batches:
            for text in batch.column(0):
                seen.append([0, *map(ids.__getitem__, _words(text.as_py())), 1])
                size += len(seen[-1])
                if size >= FLUSH:
                    yield from _rows(flush(ids, seen))
                    ids, seen, size = _Ids(), [], 0
        if seen:
            yield from _rows(flush(ids, seen))

    def _rows(found):
        for bucket, block in found:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])

    return run


def _spread(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _by_context(a: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct contexts, ascending, and the columns' sums."""
    if not len(a):
        return a, columns
    order = np.argsort(a)
    a = a[order]
    at = run_starts(a)
    return a[at], [np.add.reduceat(x[order].astype(np.int64), at) for x in columns]


def _write_bigrams(path: str, n_buckets: int, hot: np.ndarray):
    """One bucket's files; gives its words' predecessors by word bucket, its hot contexts' parts, and its sums."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_unblock(b.as_py()) for b in table.column("block")]
        a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = pair_hash(a, b)
        order = np.argsort(key)
        key, a, b, n = key[order], a[order], b[order], n[order]
        at = run_starts(key)
        n = np.add.reduceat(n, at)
        key, a, b = key[at], a[at], b[at]
        put_bytes(f"{path}/pair-{bucket}", (key.astype("<u8").tobytes(), n.astype("<u8").tobytes()))
        starts = int(n[a == START].sum())
        info = {"tokens": int(n.sum()) - starts, "texts": starts, "pairs": len(key), "spread": _spread(n)}
        is_hot = among(a, hot)
        whole, part = (_by_context(a[x], [n[x], n[x] == 1, n[x] == 2, n[x] > 2]) for x in (~is_hot, is_hot))
        put_bytes(f"{path}/context-{bucket}", _columns(*whole))
        rows = [(bucket, None, 0, json.dumps(info | {"contexts": len(whole[0])}), None)]
        where = bucket_of(part[0], n_buckets)
        cuts = np.append(run_starts(where), len(where))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((int(where[i]), None, j - i, None, b"".join(_columns(part[0][i:j], [x[i:j] for x in part[1]]))))
        b = np.sort(b)
        at = run_starts(b)
        before = np.diff(np.append(at, len(b)))
        b = b[at]
        where = bucket_of(b << np.uint64(16), n_buckets)
        cuts = np.append(run_starts(where), len(where))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((int(where[i]), six(b[i:j]) + _small_counts(before[i:j]), j - i, None, None))
        types = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "block", "n", "info", "hot"])

    return run


def _columns(key: np.ndarray, values: list[np.ndarray]) -> list[bytes]:
    return [x.astype("<u8").tobytes() for x in (key, *values)]


def _write_words(path: str):
    """A word bucket's file, and its hot contexts' sums."""

    def run(table: pa.Table) -> pa.Table:
        bucket, keys, counts, infos, hot = table.column("bucket")[0].as_py(), [], [], [], []
        for block, n, info, part in zip(*(table.column(c).to_pylist() for c in ("block", "n", "info", "hot")), strict=True):
            if info:
                infos.append(info)
            elif part:
                hot.append(np.frombuffer(part, "<u8").reshape(5, n))
            else:
                keys.append(unsix(block[: 6 * n]))
                counts.append(_unsmall(block[6 * n :], n))
        info = {"words": 0, "wspread": [0] * 4, "followed": 0}
        if keys:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key, n = key[order], n[order]
            at = run_starts(key)
            key, n = key[at], np.add.reduceat(n, at)
            put_bytes(f"{path}/word-{bucket}", (key.astype("<u8").tobytes(), n.astype("<u8").tobytes()))
            info = {"words": len(key), "wspread": _spread(n), "followed": int(n.sum())}
        if hot:
            both = np.concatenate(hot, axis=1)
            key, sums = _by_context(both[0], list(both[1:]))
            put_bytes(f"{path}/hot-{bucket}", _columns(key, sums))
            info["contexts"] = int((key != START).sum())
        infos.append(json.dumps(info))
        return pa.table([pa.array([_add(map(json.loads, infos))], pa.string())], ["info"])

    return run


def _add(infos) -> str:
    total: dict = {}
    for x in infos:
        for k, v in x.items():
            total[k] = [a + b for a, b in zip(total.get(k, [0] * 4), v, strict=True)] if isinstance(v, list) else total.get(k, 0) + v
    return json.dumps(total)


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from the counts of counts 1 to 4.

    Where a count of counts is zero (tiny corpora) the formula has no value and
    0.5, 0.75 and 0.9 stand in; all lie between 0 and the count.
    """
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for i, plain in zip((1, 2, 3), (0.5, 0.75, 0.9), strict=True):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else plain
        out.append(d if 0 < d < i else plain)
    return out


def train(docs: DataFrame, text: str = "text", n_buckets: int | None = None) -> dict:
    """Count ``docs`` and write the model; returns its small description.

    n_buckets: defaults to the input's number of partitions, so a bucket's size
    stays level as the input grows. The driver receives one row a bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(text).alias("text"))
    n_buckets = n_buckets or partitions_for(docs)
    path = fresh_dir(spark, "lm")
    hot = hot_contexts(docs, max(1 / (4 * n_buckets), 1 / HOT_WORDS))
    blocks = docs.mapInArrow(_count_blocks(n_buckets, hot), "bucket int, block binary")
    words = blocks.groupBy("bucket").applyInArrow(_write_bigrams(path, n_buckets, hot), "bucket int, block binary, n long, info string, hot binary")
    infos = words.groupBy("bucket").applyInArrow(_write_words(path), "info string").collect()
    info = json.loads(_add(json.loads(r.info) for r in infos))
    empty = {"tokens": 0, "texts": 0, "contexts": 0, "pairs": 0, "spread": [0] * 4, "words": 0, "wspread": [0] * 4, "followed": 0}
    info = empty | info
    texts = info["texts"]
    return info | {
        "path": path,
        "buckets": n_buckets,
        "hot": hot,
        "N": info["tokens"] + texts,
        "V": info["contexts"] + bool(texts),
        "d2": discounts(info["spread"]),
        "d1": discounts(info["wspread"]),
    }


class Model:
    """The written model, mapped bucket by bucket as lookups need it."""

    def __init__(self, info: dict):
        self.info, self.files = info, {}
        n, d = info["wspread"], info["d1"]
        more = info["words"] - n[0] - n[1]
        self.rest = (d[0] * n[0] + d[1] * n[1] + d[2] * more) / max(info["followed"], 1) if info["words"] else 1.0
        self.d1, self.d2 = np.array([0.0, *d]), np.array([0.0, *info["d2"]])

    def _file(self, kind: str, bucket: int, width: int):
        if (kind, bucket) not in self.files:
            try:
                raw = mapped(f"{self.info['path']}/{kind}-{bucket}")
            except FileNotFoundError:
                raw = np.zeros(0, np.uint8)
            n = len(raw) // width
            self.files[kind, bucket] = raw[: 8 * n].view("<u8"), raw[8 * n :]
        return self.files[kind, bucket]

    def find(self, kind: str, width: int, where: np.ndarray, keys: np.ndarray, dtype: str, columns: int) -> np.ndarray:
        """columns x len(keys) values; zeros where a key isn't there.

        Keys are looked up bucket by bucket in ascending order.
        """
        out = np.zeros((columns, len(keys)), np.int64)
        order = np.lexsort((keys, where))
        cuts = np.append(run_starts(where[order]), len(order))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[i:j]
            table, rest = self._file(kind, int(where[at[0]]), width)
            if not len(table):
                continue
            pos = np.minimum(np.searchsorted(table, keys[at]), len(table) - 1)
            hit = table[pos] == keys[at]
            at, pos = at[hit], pos[hit]
            values = rest.view(dtype).reshape(columns, len(table))
            for c in range(columns):
                out[c, at] = values[c][pos]
        return out

    def contexts(self, h: np.ndarray) -> np.ndarray:
        """count, and how many followers were seen once, twice, more often."""
        out, is_hot = np.zeros((4, len(h)), np.int64), among(h, self.info["hot"])
        for kind, at in (("context", ~is_hot), ("hot", is_hot)):
            out[:, at] = self.find(kind, 40, bucket_of(h[at], self.info["buckets"]), h[at], "<u8", 4)
        return out

    def word_p(self, h: np.ndarray) -> np.ndarray:
        """Continuation probability of each word."""
        low = h & LOW48
        n = self.find("word", 16, bucket_of(low << np.uint64(16), self.info["buckets"]), low, "<u8", 1)[0]
        own = np.maximum(n - self.d1[np.minimum(n, 3)], 0) / max(self.info["followed"], 1)
        return own + self.rest / (self.info["V"] + 1)

    def pair_p(self, a: np.ndarray, b: np.ndarray, ctx: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p(b | a), given the contexts' rows and the words' own probabilities."""
        n = self.find("pair", 16, place_of(a, b, self.info["buckets"], self.info["hot"]), pair_hash(a, b), "<u8", 1)[0]
        total = np.maximum(ctx[0], 1)
        own = np.maximum(n - self.d2[np.minimum(n, 3)], 0) / total
        rest = (self.d2[1] * ctx[1] + self.d2[2] * ctx[2] + self.d2[3] * ctx[3]) / total
        return own + np.where(ctx[0] > 0, rest, 1.0) * p

    def score(self, texts: list[list[bytes]]):
        """Per text: tokens, known tokens, base score, model score."""
        ids = _Ids()
        seqs = [[0, *map(ids.__getitem__, w), 1] for w in texts]
        h = ids.hashes()
        ctx, p = self.contexts(h), self.word_p(h)
        seen = ctx[0].copy()
        seen[0], seen[1] = 0, self.info["texts"]
        base = np.log10((seen + 1) / (self.info["N"] + self.info["V"] + 1))
        lens = np.array([len(s) for s in seqs])
        flat = np.fromiter((x for s in seqs for x in s), np.int64, lens.sum())
        first = np.cumsum(lens) - lens
        tokens = np.delete(np.arange(len(flat)), first)
        key = flat[tokens - 1].astype(np.uint64) << np.uint64(32) | flat[tokens].astype(np.uint64)
        order = np.argsort(key)
        sorted_key = key[order]
        at = run_starts(sorted_key)
        i, j = (sorted_key[at] >> np.uint64(32)).astype(np.int64), (sorted_key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        logs = np.log10(self.pair_p(h[i], h[j], ctx[:, i], p[j]))
        value = np.empty(len(key))
        value[order] = np.repeat(logs, np.diff(np.append(at, len(key))))
        cut = first - np.arange(len(first))  # each text has a token at least
        word = flat[tokens]
        return lens - 1, np.add.reduceat((seen[word] > 0).astype(np.int64), cut), np.add.reduceat(base[word], cut), np.add.reduceat(value, cut)


def score(docs: DataFrame, info: dict, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """One row a document: the key columns, its counts and both scores."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text).alias("text"), *(c.alias(k) for k, c in keys.items()))
    names = list(keys)
    fields = [f for f in chosen.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        model = Model(info)
        for batch in batches:
            words, first, size = [], 0, 0
            for k, text in enumerate(batch.column(0)):
                words.append(_words(text.as_py()))
                size += len(words[-1]) + 1
                if size >= SCORED or k == batch.num_rows - 1:
                    n, known, base, own = model.score(words)
                    cols = [batch.column(names.index(f.name) + 1).slice(first, len(words)) for f in fields]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([info["N"]] * len(words), pa.int64()), pa.array(base), pa.array(own)], [*(f.name for f in fields), "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    words, first, size = [], k + 1, 0

    return chosen.mapInArrow(run, schema + ", n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )
