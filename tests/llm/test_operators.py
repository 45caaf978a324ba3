"""Every operator against a brute-force version or an exact round trip, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from umbra.llm import chat, decontam, digest, langid, licenses, lm, mixing, pii, simhash, tokenbin
from umbra.llm._shared import by_range, components, written
from umbra.llm.queries import END_ID, fold, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, fp string, copies int, word string"
TEXTS = ["", None, "   ", "a", "a b c", "x" * 50_000, "the same words again and again here " * 3, "the same words again and again here " * 3, "漢字 and ümlaut 😊", "1 2 3 !!!", "a\n\nb\tc"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, None, i, "r", "f", 2, "w") for i, t in enumerate(TEXTS)]
    rows += [(3, "another text with the same id", "fr", "s1", 5, None, None, None, None, None), rows[4], rows[4], (None, "no id here", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def brute_lm(rows, train, info):
    tr = [words(t) for i, t in rows if train(i)]
    c = collections.Counter(w for x in tr for w in x)
    c["</s>"] += len(tr)
    n, v = sum(c.values()), len([w for w in c if c[w]])
    pairs = collections.Counter(p for x in tr for p in zip(["<s>", *x], [*x, "</s>"], strict=True))
    total, kinds, before = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a][min(k, 3) - 1] += 1
        before[b] += 1
    d2, d1, all_ = [0, *info["d2"]], [0, *info["d1"]], max(1, len(pairs))
    rest = sum(d1[min(k, 3)] for k in before.values()) / all_ if before else 1.0
    one = lambda b: max(before[b] - d1[min(before[b], 3)], 0) / all_ + rest / (v + 1)

    def p(a, b):
        if a not in total:
            return one(b)
        k = pairs[a, b]
        return max(k - d2[min(k, 3)], 0) / total[a] + sum(x * y for x, y in zip(d2[1:], kinds[a], strict=True)) / total[a] * one(b)

    out = []
    for i, t in rows:
        w = words(t)
        own = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True))
        out.append((i, len(w) + 1, sum(c[x] > 0 for x in [*w, "</s>"]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, "</s>"]), own))
    return out, p, before


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_op1(request, which):
    df = request.getfixturevalue(which)
    info = lm.train(df.where(~fold(7, 2)), n_buckets=5)
    got = lm.score(df, info, {"doc_id": F.col("doc_id")}).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, p, seen = brute_lm(rows, lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2, info)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[4], 6))
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    if which == "odd":  # probabilities of every word and one unknown word sum to one
        for a in ("<s>", "a", "never seen"):
            assert sum(p(a, b) for b in seen) + p(a, "\0 unknown") == pytest.approx(1)


def test_op1_hot_contexts_move_pairs_but_no_score(docs, monkeypatch):
    keys, found = {"doc_id": F.col("doc_id")}, lm.hot_contexts

    def scores():
        info = lm.train(docs, n_buckets=6)
        return len(info["hot"]), {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(docs, info, keys).collect()}

    monkeypatch.setattr(lm, "hot_contexts", lambda texts, share: found(texts, 1.0))
    few, plain = scores()
    monkeypatch.setattr(lm, "hot_contexts", lambda texts, share: found(texts, 1 / 2000))
    many, moved = scores()
    assert few == 1 and 50 < many <= 2001
    assert plain.keys() == moved.keys()
    assert all(moved[k][0] == v[0] and moved[k][1:] == pytest.approx(v[1:], rel=1e-12) for k, v in plain.items())


def test_op1_frequent_words_are_hot(spark):
    df = spark.createDataFrame([("the " * 50 + f"w{i} x{i}",) for i in range(200)], "text string")
    hot = lm.hot_contexts(df, 0.1)
    assert list(hot) == sorted([lm.START, lm.word_hash(b"the")])


def test_op1_counts_beyond_32_bits():
    n = np.array([1, 254, 255, 2**33], np.int64)
    _, _, back = lm._unblock(lm._block(np.array([7], np.uint64), np.array([4]), np.arange(4, dtype=np.uint64), n))
    assert (back == n).all()


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            n = re.sub("[^0-9]", "", m[0])
            if lo <= len(n) <= hi and (k == 3 or pii.luhn(n)):
                out.append((k, *m.span()))
    return out


def test_op2_base(docs, odd, none):
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a1@.. +-(9%é2") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.plain(t)) == sorted(brute_pii(t))
    for df in (docs, odd):
        texts = collections.Counter(hashlib.sha256(pii.joined(brute_pii(r.text or "")).encode()).hexdigest() for r in df.collect())
        assert collections.Counter(r.base_sha256 for r in pii.scan(df).collect()) == texts
    assert pii.scan(none).count() == 0


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("to john [at] mail [dot] example.com now", "email", "john [at] mail [dot] example.com"),
        ("call doe at corp dot com", "email", "doe at corp dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_op2_disguises_map_back(text, kind, span):
    base, more = pii.find(text)
    assert not base and [(pii.KINDS[k], text[i:j]) for k, i, j in more] == [(kind, span)]


@pytest.mark.parametrize(
    "text,kind,span",
    [
        *((f"card 4111{c}1111{c}1111{c}1111", "card", f"4111{c}1111{c}1111{c}1111") for c in "\u2010\u2011\u2012\u2013\u00a0"),
        ("call +49\u201130\u20111234567 now", "phone", "+49\u201130\u20111234567"),
        ("to al\u00adice@exam\u00adple.com", "email", "al\u00adice@exam\u00adple.com"),
        ("to jane@exam\u00adple.com", "email", "jane@exam\u00adple.com"),
        ("to ali\u200bce@example.com now", "email", "ali\u200bce@example.com"),
        ("call +44 20\u20107946\u20100958 now", "phone", "+44 20\u20107946\u20100958"),
    ],
)
def test_op2_marks_alone_map_back(text, kind, span):
    base, more = pii.find(text)
    assert (pii.KINDS.index(kind), text.index(span), text.index(span) + len(span)) in [*base, *more]


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("ip one dot two dot three dot four", "ip", "one dot two dot three dot four"),
        ("card 4111 1111 1111 one one one one now", "card", "4111 1111 1111 one one one one"),
        ("call +1 five five five 0100 123 now", "phone", "+1 five five five 0100 123"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("write to jane at example dot xyz today", "email", "jane at example dot xyz"),
        ("mail jane(at)example(dot)museum please", "email", "jane(at)example(dot)museum"),
        ("mail jane at ex\u0430mple.com please", "email", "jane at ex\u0430mple.com"),
        ("to jane@mail dot example dot org now", "email", "jane@mail dot example dot org"),
    ],
)
def test_op2_few_spelled_digits_map_back(text, kind, span):
    base, more = pii.find(text)
    assert not base and [(pii.KINDS[k], text[i:j]) for k, i, j in more] == [(kind, span)]


def test_op2_few_spelled_digits_change_no_address():
    text = "seven eight at corp dot com"
    assert pii.find(text) == ([], [(0, text.index("eight"), len(text))])


def test_op2_base_spans_stay_beside_longer_ones():
    base, more = pii.find("to ali\u200bce@example.com now")
    assert base == [(0, 7, 21)] and more == [(0, 3, 21)]


@pytest.mark.parametrize("text", ["dot" + " " * 200_000 + "x", "a at" + " " * 200_000 + "dot", "one" + " " * 200_000 + "x", "( " * 100_000 + "dot", "one dot " * 40_000, "x" * 200_000 + " at dot", "a@b dot " * 30_000, "a.b-" * 50_000 + " at dot \u0430"])
def test_op2_is_linear(text):
    start = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - start < (1 if text.count(" ") >= 200_000 else 4)


@pytest.mark.parametrize("text", ["look at the dot on it", "they stare at this dot and wait", "5 dash 6", "point 3 point", "look at example.com", "one two three", "plain words", ""])
def test_op2_leaves_clean_texts(text):
    assert pii.find(text) == ([], [])


def brute_fingerprint(text):
    import xxhash

    w = words(text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which,tile", [("docs", 1024), ("docs", 4), ("odd", 1024), ("none", 1024)])
def test_op3(request, which, tile, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (4, tile))
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64) for r in got) == collections.Counter((r.doc_id, brute_fingerprint(r.text)) for r in df.collect())
    fps = sorted({r.fp % 2**64 for r in got})
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[top(b)] = top(a)
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = top(r.fp % 2**64)
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(top(r.fp % 2**64)) for r in got)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_op3_large_groups_lose_no_link(spark, k, monkeypatch):
    """Thousands of near fingerprints around a few centres, in small tiles, by k equal blocks."""
    monkeypatch.setattr(simhash, "agreeing", lambda *a: k)
    rng = random.Random(5)
    near = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in (rng.getrandbits(64) for _ in range(3)) for _ in range(400)}
    x = np.array(sorted(near), np.uint64).view(np.int64)
    df = written(spark.createDataFrame([(int(v),) for v in x], "fp long"), "t")
    found = {r.node: r.root for r in components(simhash.links(df, 4, 64)).collect()}
    d = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in d])
        if (new == label).all():
            break
        label = new
    assert len(set(found.values())) == len({label[i] for i in range(len(x)) if d[i].sum() > 1})


def test_op3_equal_blocks_follow_the_number_of_fingerprints():
    assert [simhash.agreeing(n, 4, 1024) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [1, 1, 2, 3, 4]
    assert all(sum(b for _, b in simhash.blocks_of(n)) == 64 for n in range(5, 12))


def test_op4(docs, odd, none):
    for df in (docs, odd):
        index = licenses.Index(licenses.frequencies(df))
        want = collections.Counter()
        for r in df.collect():
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text))
            at = [(i, p) for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            pos = [i for i, _ in at]
            labels = {licenses.PHRASES[p] for _, p in at}
            for par in re.split(r"\n[ \t\r]*\n", r.text or ""):
                labels |= {t.label for t in licenses.TEMPLATES if brute_license(t, licenses.words_of(par.encode()))}
            want[r.doc_id, len(w), len(at), min(pos, default=None), max(pos, default=None), ",".join(sorted({licenses.PHRASES[p] for _, p in at})), ",".join(sorted(labels))] += 1
        assert collections.Counter(tuple(r)[:7] for r in licenses.scan(df).collect()) == want
        assert index.prefix
    assert licenses.scan(none).count() == 0


def brute_license(t, par):
    """Whether some stretch of twice the template's words meets it."""
    own = [w.encode() for w in words(re.sub("[^A-Za-z0-9]", " ", t.text))]
    need = math.ceil(0.8 * len(set(own)) - 1e-9)
    if len(set(own) & set(par)) < need:
        return False
    blocks = (set(par[max(0, i - 2 * len(own) + 1) : i + 1]) for i in range(len(par)))
    return any(len(set(own) & b) >= need and not any(w.encode() in b for w in t.never) and all(any(w.encode() in b for w in g) for g in t.must) for b in blocks)


def test_op4_filters_are_exact():
    rng = random.Random(1)
    index = licenses.Index({w: rng.randint(0, 9) for w in licenses.VOCABULARY})
    texts, voc = [licenses.words_of(t.text.encode()) for t in licenses.TEMPLATES], sorted(licenses.KNOWN)
    for _ in range(3000):
        w = [x for x in rng.choice(texts) if rng.random() < 0.9]
        for _ in range(rng.choice((0, 2, 8, 60))):
            w.insert(rng.randint(0, len(w)), rng.choice((b"other", b"words", rng.choice(voc))))
        assert {i for i, _ in index.matches(w)} == {i for i, t in enumerate(licenses.TEMPLATES) if brute_license(t, w)}


@pytest.mark.parametrize(
    "text,labels",
    [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
        ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),  # the phrase alone gives gpl
        ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl,gpl"),
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "bsl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "zlib"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Copyright 2020 Somebody. All rights reserved.", "reserved"),
        ("it was released by the MIT press " + "and many other words " * 20 + "under no license", ""),
        ("a license to drive, under the law", ""),
    ],
)
def test_op4_notices(text, labels):
    assert ",".join(sorted(licenses.scan_text(text, licenses.Index({}))[3])) == labels


def test_op5_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\e\\S<|end|><|end|<|end|>"), (2, 0, "us<|body|>er", None), (2, 0, "assistant", "x\\"), (None, None, None, "z"), (None, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = written(chat.linear(df, "conv_id", "turn"), "m")
    got = {r.tree: r for r in chat.read_back(chat.format_paths(m, chat.chosen_paths(m.select("tree", "node", "parent", "score")))).collect()}
    order = lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")
    for tree in ("1", "2", "null"):
        own = sorted((r for r in rows if (str(r[0]) if r[0] is not None else "null") == tree), key=order)
        assert [tuple(t) for t in got[tree].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[tree].loss_texts == [r[3] or "" for r in own if r[2] == "assistant"]
    empty = written(chat.linear(df.limit(0), "conv_id", "turn"), "m")
    assert chat.format_paths(empty, chat.chosen_paths(empty)).count() == 0


def test_op5_trees(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 0.5), ("t", 3, 1, 0.9), ("t", 4, 3, 0.1), ("t", 5, 2, 0.5), ("t", 6, 7, 1.0), ("t", 7, 6, 1.0), ("u", 1, 99, None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    every = collections.defaultdict(list)
    for r in sorted(chat.chosen_paths(df, None).collect(), key=lambda r: r.depth):
        every[r.tree, r["rank"]].append(r.node)
    assert dict(every) == {("t", 1): [1, 3, 4], ("t", 2): [1, 2, 5], ("u", 1): [1]}
    assert {(r.tree, r.node) for r in chat.chosen_paths(df, 1).collect()} == {("t", 1), ("t", 3), ("t", 4), ("u", 1)}


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1.0 for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [k for k in names if k not in full]
        left = total - sum(3 * sizes[k] for k in full)
        level = left / sum(weight[k] for k in open_) if open_ else 0
        over = {k for k in open_ if weight[k] * level > 3 * sizes[k]}
        if not over:
            return {k: 3.0 * sizes[k] if k in full else weight[k] * level for k in names}
        full |= over


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_op6(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.plan(df, keep=["doc_id", "source"]).collect()
    sizes = collections.Counter()
    for r in df.collect():
        sizes[r.source] += len(words(r.text))
    want = brute_targets(sizes)
    assert len(rows) == df.count()
    for r in rows:
        assert r.target == pytest.approx(want[r.row.source]) and r.source_size == sizes[r.row.source] and 0 <= r.copies <= 3
    again = mixing.plan(df, keep=["doc_id", "source"]).collect()
    assert collections.Counter(map(repr, rows)) == collections.Counter(map(repr, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)


def test_op6_comes_near_the_target(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    for r in mixing.plan(df, keep=["source"]).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect():
        assert r.n == pytest.approx(r.t, rel=0.05)


def test_op6_small_sources_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), f"s{i % 6}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.plan(df, keep=["source"]).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect():
        assert r.n == pytest.approx(r.t, rel=0.05)


def test_op7_sample_holds_a_repeated_text_once(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    assert langid.fit(df)["texts"] == 1
    assert [langid.has_letter(t) for t in ("½²", "12 _", "a", "1é")] == [False, False, True, True]


def test_op7(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries()["op7_langid"](spark, "/root/testdata/sf0.01").where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows) and not any(r.rejected for r in rows)
    model = langid.fit(df)
    got = {r.t: r for r in langid.predict(odd, model, {"t": F.col("text")}).collect()}
    for t in ("", None, "   ", "1 2 3 !!!"):
        assert got[t].lang_pred == "und" and got[t].score == 0 and got[t].rejected
    assert langid.keep_identified(odd, model).columns == odd.columns
    assert langid.predict(none, model, {"i": F.col("doc_id")}).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none), {"i": F.col("doc_id")}).collect()} == {"und"}


def brute_features(text):
    """Hashed n-grams of one to three characters, one character at a time."""
    code = [c if c >= 170 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in map(ord, text.lower())]
    out, most = np.zeros(langid.DIMS), 2**64
    for i in range(len(code)):
        h = 0
        for n in (1, 2, 3):
            if i + n <= len(code):
                h = (h * 0x9E3779B97F4A7C15 + (code[i + n - 1] + n) * 0xC2B2AE3D27D4EB4F) % most
                out[((h ^ h >> 31) * 0x9E3779B97F4A7C15 % most >> 51) % langid.DIMS] += 1
    return out


def test_op7_equals_brute_force(docs):
    """Features, weights, the nearest centroid and the rejection, computed anew from the fitted model."""
    model = langid.fit(docs)
    assert sorted(set(model["labels"])) == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    rows = docs.select("text").where(F.length("text") < 3000).limit(60)
    for r in langid.predict(rows, model, {"text": F.col("text")}).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        x = np.log1p(brute_features(r.text)) * model["idf"].astype(float)
        cos = [float(x @ c / np.linalg.norm(x)) for c in model["centroids"].astype(float)]
        assert r.score == pytest.approx(max(cos), abs=1e-5)
        assert r.lang_pred in {k for k, c in zip(model["labels"], cos, strict=True) if c > max(cos) - 1e-5}
        assert r.rejected == (r.score < model["least"][r.lang_pred])


def test_op7_rejects_what_no_language_is_near(spark, docs):
    model = langid.fit(docs)
    rng = random.Random(4)
    far = ["これは日本語の文章です。東京は大きな都市であり、多くの人が住んでいます。", "Это предложение на русском языке, и его здесь никто не знает.", " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(9)) for _ in range(40))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(far)], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(rows, model, {"i": F.col("doc_id")}).collect())
    assert langid.keep_identified(rows.unionByName(docs.select("doc_id", "text")), model).count() == docs.count()


def test_op7_pieces_add_up(monkeypatch):
    text = "abcdéfg xyz " * 900
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert (langid.features(text) == whole).all()


@pytest.mark.parametrize("n", range(1, 14))
def test_op8_masks_hit_every_pattern(n):
    masks = decontam.masks_for(n, decontam.allowed(n, 0.8))
    for r in range(decontam.allowed(n, 0.8) + 1):
        for gone in itertools.combinations(range(n), r):
            assert any(all(o + p not in gone for p in m) for m in masks for o in range(n - m[-1]))


def test_op8_masks_of_long_windows():
    rng = random.Random(1)
    for n, gone in ((20, 4), (40, 8), (50, 20)):
        masks = decontam.masks_for(n, gone)
        for _ in range(500):
            out = set(rng.sample(range(n), gone))
            assert any(all(o + p not in out for p in m) for m in masks for o in range(n - m[-1]))


@pytest.mark.parametrize("limit", [10**6, 1])
def test_op8_finds_items_of_every_length(spark, limit, monkeypatch):
    """Items of 1 to 13 words, under every pattern of substitutions that their share allows, and one more."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 14)]
    rows, want = [], set()
    for n, text in items:
        most = decontam.allowed(n, 0.8)
        for r in range(most + 2):
            for gone in itertools.combinations(range(n), r):
                w = ["gone" if i in gone else x for i, x in enumerate(text.split())]
                if r <= most:
                    want.add((len(rows), n, n - r))
                rows.append((len(rows), " ".join(["before", *w, "after"])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched) for r in decontam.matches(docs, bench).collect()} == want


@pytest.mark.parametrize("limit", [10**6, 1])
def test_op8(spark, docs, odd, none, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    w = item.text.split()
    w[3] = w[9] = "substituted"
    more = spark.createDataFrame([(10_001, " ".join(["x", "y", *w[:15], "z"])), (10_002, " ".join(w[:9])), (None, item.text)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more).union(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 20_000))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()}
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    items, want = [(r.item_id, split(r.text)) for r in bench.collect()], set()
    for r in df.collect():
        at = collections.defaultdict(list)
        for i, x in enumerate(split(r.text)):
            at[x].append(i)
        for k, iw in items:
            n, diag = min(13, len(iw)), collections.defaultdict(list)
            for j, x in enumerate(iw):
                for i in at.get(x, ()):
                    diag[i - j].append(j)
            if any(sum(p <= j < p + n for j in js) >= 0.8 * n for js in diag.values() if len(js) >= 0.8 * n for p in range(len(iw) - n + 1)):
                want.add((r.doc_id, k))
    assert got == want and (10_001, item.item_id) in got and (10_002, item.item_id) not in got and (None, item.item_id) in got
    clean = decontam.remove_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - len({i for i, _ in got})
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_op9(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tok = Tokenizer.from_file(tokenizer_path())
    got = tokenbin.token_output(df, tokenizer_path(), END_ID).collect()
    ids = collections.Counter()
    for r in df.collect():
        x = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        ids[r.doc_id, len(x), zlib.crc32(x.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ids
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_op9_packing_and_random_access(tmp_path):
    rng = np.random.default_rng(0)
    for bits in (1, 5, 13, 16, 17):
        lengths = rng.integers(0, 3000, 9)
        ids = rng.integers(0, 2**bits, lengths.sum()).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum(lengths)))
        w = tokenbin.Writer(bits)
        (tmp_path / "f").write_bytes(b"".join(w.chunks(iter([(k, ids[i:j].astype("<u4")) for k, (i, j) in enumerate(itertools.pairwise(at))]))))
        assert w.keys == list(range(9)) and w.n == len(ids)
        reader = tokenbin.Reader(str(tmp_path / "f"))
        for i in (8, 0, 5):
            assert (reader[i] == ids[at[i] : at[i + 1]]).all()


def test_op9_cuts_files_by_ids(docs, monkeypatch):
    """Files of 50 ids or so: the same rows, in order, whatever the files."""
    whole = sorted(map(tuple, tokenbin.token_output(docs.limit(40), tokenizer_path(), END_ID).collect()))
    monkeypatch.setattr(tokenbin, "FILE_IDS", 50)
    path, manifest = tokenbin.write_files(docs.limit(40), tokenizer_path(), END_ID, 2)
    assert manifest.count() > 20
    assert sorted(map(tuple, tokenbin.read_files(path, manifest, "bigint").collect())) == whole


@pytest.mark.parametrize("n", [10, 1000])
def test_ranges_leave_no_trace_in_the_plan(docs, n):
    """As many nodes and letters for 10 ranges as for 1,000, and a hot key is dealt to several."""
    plan = lambda n: by_range(docs, "doc_id", "text", n)._jdf.queryExecution().logical().toString()
    assert abs(len(plan(n)) - len(plan(10))) < 40
    hot = docs.withColumn("doc_id", F.lit(None).cast("long"))
    sizes = [r["count"] for r in by_range(hot, "doc_id", "text", 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.4 * sum(sizes)


def test_op9_encoders_leave_no_memory():
    """A worker's tasks load an encoder each; the library's cache of one stayed, some 4 MB."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024

    def encode():
        return tokenbin.Encoder(tokenizer_path())(words)

    words = ["".join(map(chr, w)) for w in np.random.default_rng(3).integers(97, 123, (20_000, 8)).tolist()]

    for _ in range(3):
        encode()
    before = held()
    for _ in range(15):
        encode()
    assert held() - before < 30


def test_op9_encoder_equals_the_library():
    enc, rng = tokenbin.Encoder(tokenizer_path()), random.Random(2)
    parts = [*"ab1.,' \n\t\xa0é½漢", "'s", "  ", " \n", "<|endoftext|>", "don't", " ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for t, raw in zip(texts, enc(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which,parts", [("docs", 3), ("docs", 60), ("odd", 4), ("none", 2)])
def test_op10(request, which, parts):
    df = request.getfixturevalue(which)
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")  # documents of one id follow their texts' hashes
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.text or "") for r in df.select("*", tie).collect())
    want = collections.Counter()
    for i, (known, key, _, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        e = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = digest.digest(text), digest.digest(e), digest.digest(after)
        want[key if known else None, len(text), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), digest.likeness(a, b), digest.likeness(a, c)] += 1
    assert collections.Counter(tuple(r) for r in digest.with_next(df, parts).collect()) == want


def brute_digest(text):
    """From the definition: counts of hashed triplets, quartiles, two bits a bucket."""
    data = (text or "").encode()
    counts = [0] * 128
    for i in range(len(data) - 2):
        counts[(data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 0x9E3779B1 % 2**32 >> 25] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    packed = [sum(codes[4 * i + k] << 2 * k for k in range(4)) for i in range(32)]
    length = min(255, int(math.log(len(data)) / math.log(1.15))) if data else 0
    return bytes([length, sum(c * (2 * i + 1) for i, c in enumerate(counts)) % 251, *packed])


def brute_likeness(a, b):
    steps = [abs((a[2 + i // 4] >> 2 * (i % 4) & 3) - (b[2 + i // 4] >> 2 * (i % 4) & 3)) for i in range(128)]
    off = sum(6 if s == 3 else s for s in steps) + min(60, 3 * abs(a[0] - b[0])) + (a[1] != b[1])
    return max(0.0, 1 - off / 160)


def test_op10_equals_brute_force(docs, odd):
    texts = [r.text for df in (docs, odd) for r in df.select("text").collect() if len(r.text or "") < 4000]
    own = [(digest.digest(t), brute_digest(t)) for t in texts]
    assert all(a == b for a, b in own)
    assert all(digest.likeness(a, b) == brute_likeness(a, b) for (a, _), (b, _) in itertools.pairwise(own))


def test_op10_likeness():
    a, b = digest.digest("some text of ordinary words " * 9), digest.digest("")
    assert digest.likeness(a, a) == 1 and 0 <= digest.likeness(a, b) <= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 200), 100)}
