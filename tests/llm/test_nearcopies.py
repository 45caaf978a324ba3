"""The pipeline's near-duplicate stage against all pairs by brute force."""

import collections
import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from umbra.llm import nearcopies
from umbra.llm._shared import numbered, put_ids

SF = "/root/testdata/sf0.01"


def brute_kept(rows):
    """doc_ids of the least of each class."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            root[top(b)] = top(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(least.values())


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies at all distances, with a line that all texts share, short texts and empty ones."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    line = " this very line stands in every one of the texts"
    texts = [changed(rng, base, rng.randrange(8)) + line for _ in range(150)]
    texts += [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(2, 80))) + line for _ in range(100)]
    texts += ["", None, "  ", "a b", "A  B", "a b c", line, line + " too"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("half,tile", [(1 << 63, 1024), (0, 16)])
def test_near_copies_of_all_distances(spark, copies, half, tile, monkeypatch):
    """With frequent shingles last or no frequency known, in whole groups or small tiles."""
    monkeypatch.setattr(nearcopies, "HALF", np.uint64(half))
    monkeypatch.setattr(nearcopies, "TILE", tile)
    monkeypatch.setattr(nearcopies, "BLOCK", tile)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got == brute_kept(copies)


def test_near_copies_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = corpus_pipeline.near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_counts_are_those_of_all_texts(spark):
    texts = [f"w{i} x{i} y{i} z{i} a{i} in each of these texts {'and twice more in here' if i < 2 else ''}" for i in range(40)]
    rows = numbered(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "t")
    counts = nearcopies.Counts(nearcopies.count_shingles(rows, put_ids(rows, "all"), 5, 4), 4)
    held = collections.Counter(h for t in texts for h in nearcopies.shingles(t).tolist())
    h = np.array(sorted(held), np.uint64)
    want = [held[x] if x < 2**63 else 2 for x in h.tolist()]
    assert counts.of(h).tolist() == want and max(want) == 40


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "one text here", 1), (None, "one text here", 1), (3, "one text here", 2), (3, "another", None), (3, "another", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    got = nearcopies.keep_one(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[2], rows[3], rows[5]], key=str) and got.columns == df.columns
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_pairs_that_link_nothing_leave_no_task(spark, monkeypatch):
    """Many texts of one template, most not similar enough: no table has more rows than the groups have."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = [changed(rng, base, rng.randrange(14)) for _ in range(400)]
    rows, inner = {}, nearcopies.written

    def written(df, tag):
        out = inner(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(nearcopies, "written", written)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in nearcopies.keep_one(df).collect())
    assert got == brute_kept(list(enumerate(texts))) and 100 < len(got) < 400
    assert max(rows.values()) == rows["groups"] < 20_000, rows


@pytest.mark.parametrize("columns,remote", [(4096, False), (3, True)])
def test_whole_sets_by_place_and_what_they_share(columns, remote, monkeypatch, tmp_path):
    """Sets come back from their files, a remote store's too; counts of common elements agree with Python's sets."""
    monkeypatch.setattr(nearcopies, "COLUMNS", columns)
    monkeypatch.setattr(nearcopies, "FILES", 1)
    if remote:
        monkeypatch.setattr(nearcopies, "local_path", lambda uri: None)
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 30))), np.uint64) for _ in range(12)] + [np.array([99], np.uint64)]
    ends = [0, *itertools.accumulate(map(len, sets))]
    for file in (0, 1):
        (tmp_path / str(file)).write_bytes(b"".join(x.astype("<u8").tobytes() for x in sets))
    kept = nearcopies.Sets(f"file://{tmp_path}")
    back = [kept.of(k % 2, ends[k], len(x)) for k, x in enumerate(sets)]
    assert [x.tolist() for x in back] == [x.tolist() for x in sets]
    got = nearcopies.shared(back, np.arange(5), np.arange(5, 13))
    assert got.tolist() == [[len({*a.tolist()} & {*b.tolist()}) for b in sets[5:]] for a in sets[:5]]
