"""Every stage of the pipeline against a brute-force version on what the stage before kept."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer
from umbra.llm import mixing
from umbra.llm.queries import END_ID, table, tokenizer_path

from test_nearcopies import brute_kept

SF = "/root/testdata/sf0.001"


def leaks(rows, items):
    """(place, item) of every row with at least 0.8 of 13 aligned words of an item, or of all its words."""
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    out = set()
    for p, text in enumerate(rows):
        at = collections.defaultdict(list)
        for i, x in enumerate(split(text)):
            at[x].append(i)
        for k, item in enumerate(map(split, items)):
            n, diagonals = min(13, len(item)), collections.defaultdict(list)
            for j, x in enumerate(item):
                for i in at.get(x, ()):
                    diagonals[i - j].append(j)
            if any(sum(s <= j < s + n for j in js) >= 0.8 * n - 1e-9 for js in diagonals.values() for s in range(len(item) - n + 1)):
                out.add((p, k))
    return out


def checked(spark, folder):
    """Runs the stages; each result is compared with what brute force makes of the one before."""
    docs = table(spark, folder, "documents")
    tok = Tokenizer.from_file(tokenizer_path())
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], folder).cache())
        assert seen[-1].columns == docs.columns, name
    rows = [[tuple(r) for r in d.collect()] for d in seen]
    at = {c: docs.columns.index(c) for c in ("doc_id", "text")}
    of = lambda k, c: [r[at[c]] for r in rows[k]]
    assert not collections.Counter(map(repr, rows[1])) - collections.Counter(map(repr, rows[0]))
    gone = collections.Counter(of(0, "text")) - collections.Counter(of(1, "text"))
    numbered = list(enumerate(of(1, "text")))
    by_id = [(ids is None, ids or 0, k) for k, ids in enumerate(of(1, "doc_id"))]
    order = {k: n for n, (_, _, k) in enumerate(sorted(by_id))}  # of equal ids any one may stay
    kept = [by_id[next(k for k, n in order.items() if n == x)] for x in brute_kept([(order[k], t) for k, t in numbered])]
    assert sorted(of(2, "doc_id"), key=str) == sorted((None if none else i for none, i, _ in kept), key=str)
    bad = {p for p, _ in leaks(of(2, "text"), [r.text for r in table(spark, folder, "benchmark").collect()])}
    assert collections.Counter(map(repr, rows[3])) == collections.Counter(repr(r) for p, r in enumerate(rows[2]) if p not in bad)
    copies = collections.Counter()
    for r in mixing.plan(seen[3]).collect():
        copies[repr(tuple(r.row))] += r.copies
        assert 0 <= r.copies <= 3
    assert collections.Counter(map(repr, rows[4])) == +copies
    want = collections.Counter()
    for i, t in zip(of(4, "doc_id"), of(4, "text"), strict=True):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    out = corpus_pipeline.STAGES[-1][1](spark, seen[4], folder).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    starts = np.cumsum([0, *(r.n_tokens for r in sorted(out, key=lambda r: r.start))])
    assert sorted(r.start for r in out) == starts[:-1].tolist()
    return gone, bad


def test_stages_take_effect(spark):
    gone, bad = checked(spark, SF)
    assert not +gone and bad  # clean documents stay, leaks go


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, foreign scripts, clashing extra columns."""
    real = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source").limit(60).collect()]
    texts = ["", None, "   ", "x" * 50_000, "1 2 3 !!!", "これは日本語の文章です。東京は大きな都市です。", "Это предложение на русском языке."]
    rows = real + [(1000 + k, t, None, f"s{k % 2}") for k, t in enumerate(texts)] + real[:5] + [real[0], (None, real[3][1], None, None), (None, None, None, None), (1000, real[7][1] + " more", "en", None)]
    rows = [(*r, "u", 1, "row", None) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, uid string, copies int, row string, key string").write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_odd_rows_go_through_all_stages(spark, odd_folder):
    gone, _ = checked(spark, odd_folder)
    for t in (None, "", "1 2 3 !!!", "これは日本語の文章です。東京は大きな都市です。", "Это предложение на русском языке."):
        assert gone[t], t  # the language stage rejects what has no letters or is near no language


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
