"""Language identification: nearest of several clustered centroids per language.

A text is its normalised TF-IDF vector of hashed character n-grams; it gets the
language of the centroid with the highest cosine, and is rejected if that
cosine lies below the language's own threshold. The classifier is fitted on a
bounded sample of labelled rows (about ``per_label`` different texts a label, by
hash, however often each repeats); every row is classified by its whole text.

Null texts and texts without a letter are ``und`` with score 0, and rejected.
Rows without a label never train. Without any label at all, every row is
``und``. Equal cosines go to the first language in code-point order. Repeated
rows are classified alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, written

DIMS = 1 << 13
ORDERS = (1, 2, 3)
PIECE = 1 << 19  # characters hashed together
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numbers that aren't decimal digits


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def features(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased text; non-letters are one mark."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(dims, np.int64)
    for k in range(0, len(code), PIECE):
        c = code[max(0, k - max(ORDERS) + 1) : k + PIECE].astype(np.uint64)
        new = min(k, max(ORDERS) - 1)  # characters seen before, for context only
        c = np.where((c < 65) | (c > 90) & (c < 97) | (c > 122) & (c < 170), np.uint64(32), c)
        h = np.zeros(len(c), np.uint64)
        for n in ORDERS:
            h = (h[:-1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + (c[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            x = h[max(0, new - n + 1) :]
            out += np.bincount(((x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64) % dims, minlength=dims)
            if len(h) < 2:
                break
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def fit(docs: DataFrame, label: str = "lang", text: str = "text", per_label: int = 300, clusters: int = 4, seed: int = 7) -> dict:
    """The model from about ``per_label`` different texts of each label.

    Sampling: texts whose hash lies below per_label over the (approximate) number
    of the label's texts, one row each. Each label's centroids are fitted in a
    task of their own, from its sample alone. The driver gets the labels' counts,
    a number for each of the ``DIMS`` n-grams, and the centroids, no text.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit(seed)).alias("hash"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not counts:
        return {"labels": []}
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_label / n))))
    draw = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    sample = rows.where(draw < share[F.col("label")]).groupBy("label", "hash").agg(F.min("text").alias("text")).select("label", "text")

    def count(batches):
        for batch in batches:
            vec = [features(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["label", "vec"])

    def held(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for v in batch.column(0):
                df += np.frombuffer(v.as_buffer(), "<u4") > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS)), pa.array(np.append(df[at], n))], ["dim", "n"])

    vectors = written(sample.mapInArrow(count, "label string, vec binary"), "sample")
    df = np.zeros(DIMS + 1, np.int64)  # the last one counts the texts
    for r in vectors.select("vec").mapInArrow(held, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    def cluster(table: pa.Table) -> pa.Table:
        vec = sorted(table.column("vec").to_pylist())
        own = _weighted(np.array([np.frombuffer(v, "<u4") for v in vec]), idf)
        c = _clusters(own, min(clusters, len(own)), np.random.default_rng(seed))
        near = (own @ c.T).max(1)
        least = float(max(0.0, near.mean() - 6 * near.std()) / 2)
        return pa.table({"label": [table.column("label")[0].as_py()], "k": pa.array([len(c)], pa.int32()), "c": pa.array([c.astype("<f4").tobytes()], pa.binary()), "least": [least]})

    got = sorted(vectors.groupBy("label").applyInArrow(cluster, "label string, k int, c binary, least double").collect())
    centroids = np.concatenate([np.frombuffer(r.c, "<f4").reshape(r.k, DIMS) for r in got])
    return {"labels": [r.label for r in got for _ in range(r.k)], "centroids": centroids, "idf": idf, "texts": int(df[-1]), "least": {r.label: r.least for r in got}}


def _clusters(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means, from spread-out starts."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        c = np.vstack((c, x[(x @ c.T).max(1).argmin()]))
    for _ in range(20):
        own = (x @ c.T).argmax(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c):
            break
        c = new
    return c


def _classify(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's language, cosine, and whether it is rejected."""
    n = len(texts)
    lang, score, out = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    known = [i for i in range(n) if model["labels"] and (t := texts[i].as_py()) and has_letter(t)]
    for k in range(0, len(known), 256):
        at = known[k : k + 256]
        cos = _weighted(np.array([features(texts[i].as_py()) for i in at]), model["idf"]) @ model["centroids"].T
        best = cos.argmax(1)
        for i, b, row in zip(at, best, cos, strict=True):
            lang[i], score[i] = model["labels"][b], min(1.0, max(0.0, float(row[b])))
            out[i] = row[b] < model["least"][model["labels"][b]]
    return lang, score, out


def predict(docs: DataFrame, model: dict, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """Key columns, lang_pred, score (the cosine), rejected."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text).alias("_text"), *(c.alias(k) for k, c in keys.items()))
    fields = chosen.schema.fields[1:]

    def run(batches):
        for batch in batches:
            lang, score, out = _classify(batch.column(0), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [*(f.name for f in fields), "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return chosen.mapInArrow(run, schema + ", lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they were; each text goes to Python once."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_classify(batch.column(at), model)[2]))

    return docs.mapInArrow(run, docs.schema)
