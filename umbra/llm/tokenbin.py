"""Token ids in bit-packed files: written in key order, read back, by block or at random.

File format, little-endian: magic ``UMBT2``, one byte of bits per id, the
blocks, the documents' first ids (8 bytes each, one more than documents), the
blocks' byte offsets (8 bytes each, one more than blocks), three 8-byte numbers
(documents, ids, blocks). A block packs BLOCK ids, the last one fewer, each in
the least bits that hold the vocabulary, and starts at a whole byte. The index
stands last, so a file is written block by block; a range of keys takes as many
files as its ids need.

Nulls and empty texts are the end id alone. Repeated rows are written
repeatedly; a null key sorts first, any orderable key will do. An empty table
writes no file and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import by_range, fresh_dir, mapped, part_number, partitions_for, put_bytes, small_batches

MAGIC = b"UMBT2"
BLOCK = 4096
FILE_IDS = 1 << 26  # ids after which a file ends
FILE_DOCS = 1 << 20  # documents after which it does
CACHED = 400_000  # pre-tokens whose ids a worker keeps
#: The byte-level BPE family's published pre-token pattern. In texts of the
#: characters below, the standard library's classes mean the same and are faster.
SIMPLE = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_SIMPLE = r"[^\t\n\r -~À-ɏ]"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable() -> dict[int, int]:
    """Byte -> code point: itself if it is a visible Latin-1 character, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(hidden)}


_SHOWN = _printable()


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """The tokenizers library's ids, with a cache of pre-tokens.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of
    its pre-tokens in turn, which the library's model gives. Texts with an added
    token's string, and tokenizers of another kind, go to the library whole.
    """

    def __init__(self, path: str):
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.split = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not (spec.get("truncation") or spec.get("padding")):
            odd, simple, full = re.compile(NOT_SIMPLE).search, re.compile(SIMPLE).findall, regex.compile(PRETOKEN).findall
            self.split = lambda text: full(text) if odd(text) else simple(text)
        self.bits = max(1, (self.tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        model = self.tok.model
        if self.split is not None and hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the library's own cache of words outlives its model: some 4 MB for each task of a worker
        self.cache = _Cache(model)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        get, split = self.cache.__getitem__, self.split
        return [self._whole(t) if split is None or any(a in t for a in self.added) else b"".join(map(get, split(t))) for t in texts]


class _Cache(dict):
    """Pre-token -> its ids, from its bytes in their printable form."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        shown = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)
        self[piece] = ids = _little(array("I", [t.id for t in self.tokenize(shown)]))
        return ids


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.reshape(-1), bitorder="little").tobytes()


def unpack(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """A file's bytes in pieces, from (key, ids) of its documents; it holds a block of ids and the index.

    Takes documents until the file is full, and leaves their keys and numbers.
    """

    def __init__(self, bits: int):
        self.bits, self.keys, self.lengths, self.n = bits, [], [], 0

    def chunks(self, docs):
        held, size, offsets = [], 0, [0]

        def full(last: bool):
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            end = len(ids) if last else len(ids) - len(ids) % BLOCK
            for k in range(0, end, BLOCK):
                block = pack(ids[k : k + BLOCK], self.bits)
                offsets.append(offsets[-1] + len(block))
                yield block
            held[:] = [ids[end:]]

        yield MAGIC + bytes([self.bits])
        for key, ids in docs:
            self.keys.append(key)
            self.lengths.append(len(ids))
            self.n += len(ids)
            held.append(ids)
            size += len(ids)
            if size >= 16 * BLOCK:
                yield from full(False)
                size = len(held[0])
            if self.n >= FILE_IDS or len(self.keys) >= FILE_DOCS:
                break
        yield from full(True)
        yield np.concatenate(([0], np.cumsum(self.lengths))).astype("<u8").tobytes()
        yield np.array(offsets, "<u8").tobytes()
        yield np.array([len(self.keys), self.n, len(offsets) - 1], "<u8").tobytes()


class Reader:
    """Random access to a mapped file: ``reader[i]`` is document i's ids."""

    def __init__(self, uri: str):
        raw = mapped(uri)
        if bytes(raw[:5]) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.bits = int(raw[5])
        self.docs, self.n, blocks = (int(x) for x in raw[-24:].copy().view("<u8"))
        at = len(raw) - 24 - 8 * (blocks + 1)
        self.offsets = raw[at:-24].copy().view("<u8")
        self.firsts = raw[at - 8 * (self.docs + 1) : at].copy().view("<u8")
        self.data = raw[6:]

    def ids(self, i: int, j: int) -> np.ndarray:
        """Ids i to j of the file, from the blocks that hold them."""
        if i >= j:
            return np.zeros(0, "<u4")
        a, b = i // BLOCK, (j - 1) // BLOCK
        out = [unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], min(BLOCK, self.n - k * BLOCK), self.bits) for k in range(a, b + 1)]
        return np.concatenate(out)[i - a * BLOCK : j - a * BLOCK]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


def write_files(docs: DataFrame, tokenizer: str, end_id: int, n_ranges: int, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Every text's ids and the end id in files, in ascending key order; their folder and manifest.

    Texts are dealt once, by ranges of the key; a range's task encodes them and
    writes its files one after the other. The manifest has a row a file: name,
    and ``start``, the ids in all files before. Only that row reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, "tokens")
    dealt = by_range(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", n_ranges)

    def run(batches):
        enc, end, kind = Encoder(tokenizer), np.array([end_id], "<u4").tobytes(), None

        def encoded():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for k in range(0, batch.num_rows, 200):
                    part = batch.slice(k, 200)
                    raws = enc([t or "" for t in part.column(1).to_pylist()])
                    yield from zip(part.column(0).to_pylist(), (np.frombuffer(r + end, "<u4") for r in raws), strict=True)

        docs, number = encoded(), 0
        while (first := next(docs, None)) is not None:
            name, w = f"{part_number():08d}-{number:06d}", Writer(enc.bits)
            put_bytes(f"{path}/{name}.tok", w.chunks(chain([first], docs)))
            put_bytes(f"{path}/{name}.keys", [_ipc(pa.array(w.keys, kind))])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.n], pa.int64())], ["name", "ids"])
            number += 1

    found, start, rows = sorted(dealt.mapInArrow(run, "name string, ids long").collect()), 0, []
    for name, n in found:
        rows.append((name, start))
        start += n
    return path, spark.createDataFrame(rows, "name string, start long")


def _ipc(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"key": values})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_files(path: str, manifest: DataFrame, key_type: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(f"{path}/{name}.tok")
                keys = pa.ipc.open_stream(mapped(f"{path}/{name}.keys").tobytes()).read_all().column(0)
                firsts = reader.firsts.astype(np.int64)
                for at in range(0, reader.docs, 4096):
                    end = min(reader.docs, at + 4096)
                    ids = reader.ids(int(firsts[at]), int(firsts[end])).astype("<u4").tobytes()
                    cut = (firsts[at : end + 1] - firsts[at]) * 4
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(at, end - at).combine_chunks(), pa.array(firsts[at:end] + start), pa.array(np.diff(firsts[at : end + 1])), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("name", "start").repartition(partitions_for(manifest), "name")
    return spread.mapInArrow(run, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Encode, write, read back."""
    path, manifest = write_files(docs, tokenizer, end_id, partitions_for(docs), key)
    return read_files(path, manifest, docs.schema[key].dataType.simpleString(), key)
