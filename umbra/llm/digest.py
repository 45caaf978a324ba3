"""Document fingerprints: quartile bucket digests and their bounded difference.

Byte triplets are hashed into 128 buckets and counted; each bucket's digest is
the quartile its count falls into (2 bits), after a length code and a checksum
byte. Two digests' likeness is one less their weighted difference over its
largest value, so it lies between 0 and 1.

Nulls are empty texts. Texts with fewer than three bytes have no triplet, and
the digest of zero counts. Equal texts have equal digests; repeated rows repeat.
For ``with_next``, equal doc_ids follow one another in order of their texts'
hashes, a null doc_id comes first, and one row's next document is itself. Empty tables
give no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import by_range, part_number, partitions_for, small_batches, written

BUCKETS = 128
PIECE = 1 << 20


def counts(data: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for k in range(0, max(0, len(data) - 2), PIECE):
        b = np.frombuffer(data[k : k + PIECE + 2], np.uint8).astype(np.uint32)
        x = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - 7)
        out += np.bincount(x, minlength=BUCKETS)
    return out


def digest(text: str | None) -> bytes:
    """Length code, checksum, then 32 bytes of quartile codes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    c = counts(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = (c[:, None] > q).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    length = int(np.log(len(data)) / np.log(1.15)) if data else 0
    check = int((c * (np.arange(BUCKETS) * 2 + 1)).sum() % 251)
    return bytes([min(length, 255), check]) + packed.astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Quartile steps, a jump of three counted as six; length steps up to 60; 1 for the checksum."""
    x, y = (np.frombuffer(d, np.uint8, offset=2) for d in (a, b))
    shift = np.arange(0, 8, 2, dtype=np.uint8)
    step = np.abs((x[:, None] >> shift & 3).astype(np.int64) - (y[:, None] >> shift & 3))
    return int(step.sum() + 3 * (step == 3).sum()) + min(60, abs(a[0] - b[0]) * 3) + (a[1] != b[1])


#: Two digests of random buckets differ by about this much; all beyond is likeness 0.
FAR = 160


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, 1.0 - difference(a, b) / FAR)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the hexadecimal digest of every text."""
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t.as_py()).hex() for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fingerprint string")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def with_next(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Every document beside the next one: its own, its edited text's and the next one's likeness.

    The texts are dealt once, by ranges of doc_id. A range's task also reports
    its first and last text; a join of these, a row a range, gives each last row
    the first row of the range after it (the last range's, of the first).
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        last, part = None, part_number()
        for b in batches:
            out = []
            for key, text in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                own = digest(text)
                if last is None:
                    out.append((*[None] * 7, part, "head", text))
                else:
                    out.append((*_row(*last, text, own), part, None, None))
                last = key, text, own
            yield batch(b.schema.field(0).type, out)
        if last is not None:
            yield batch(b.schema.field(0).type, [(last[0], *[None] * 6, part, "tail", last[1])])

    def batch(key_type, out):
        columns = list(zip(*out, strict=True)) or [[]] * 10
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*COLUMNS, "part", "side", "text"])

    def ends(batches):
        for b in batches:
            out = [(*_row(key, text, digest(text), after, digest(after)), None, None, None) for key, text, after in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield batch(b.schema.field(0).type, out).select(COLUMNS)

    found = written(by_range(rows, "doc_id", "text", n_parts or partitions_for(docs)).mapInArrow(run, types + ", part int, side string, text string"), "ranges")
    heads = found.where("side = 'head'").select("part", F.col("text").alias("after"))
    order = Window.orderBy("part")  # a row a range
    before = heads.select("part").withColumn("p", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())))
    tails = found.where("side = 'tail'").select("doc_id", "text", F.col("part").alias("p"))
    borders = tails.join(before, "p").join(heads, "part").select("doc_id", "text", "after").mapInArrow(ends, types)
    return found.where("side is null").select(COLUMNS).union(borders)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the following text's start."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(key, text: str, own: bytes, following: str, after: bytes):
    changed = edited(text, following)
    new = digest(changed)
    return key, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, after)
