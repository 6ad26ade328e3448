"""Prefix-free parsing and phrase mining against a brute-force version."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from veracity.llm import phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile("[.,;:!?\x0a-\x0d]")
WORD = re.compile("[^\x20\x09]+")


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [WORD.findall(p) for p in SPLIT.split(lower)]


def brute(rows, min_count, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= min_count}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s, k))
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS)
    return [tuple(r) for r in phrases.mine_collocations(df, **kw).collect()]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "Ünd", "e-f", "g"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", " . ", "!? "]
    return [("".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 120))),
             rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


ODD = [(None, "en"), ("", None), (" \t ", "en"), ("...,,,", "en"), ("one", "xx"), ("same words here " * 400, "en"),
       ("z " * 3000, "de"), ("x y z\x1cq " * 40, "en"), ("W" * 200000 + " tail", "en")]


@pytest.mark.parametrize(("seed", "modulus", "top"), [(1, 4, 2000), (2, 32, 15), (3, 1, 2000), (4, 10**9, 2000)])
def test_equals_brute_force(spark, seed, modulus, top):
    rows = corpus(seed, 60) + ODD
    rows += rows[:7] * 3  # repeated rows
    got = mined(spark, rows, min_count=5, top=top, modulus=modulus)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 5, top)


def test_several_blocks_and_buckets(spark, monkeypatch):
    rows = corpus(9, 200)
    whole = set(mined(spark, rows, min_count=6))
    packs = phrases.kc.BLOCK_BYTES
    monkeypatch.setattr(phrases.kc, "BUCKET_KEYS", 50)
    assert set(mined(spark, rows, min_count=6)) == whole == brute(rows, 6, 2000)
    assert phrases.kc.BLOCK_BYTES == packs


def test_chunks_overlap_and_cover_each_start_once():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", ".", ""]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    for modulus in (1, 3, 16):
        doc, chunks = phrases.parse(pa.array(texts), modulus)
        for d, text in enumerate(texts):
            own = [c.split(" ")[:-1] for c, k in zip(chunks.to_pylist(), doc, strict=True) if k == d]
            joined = [t for c in own for t in c[:-phrases.OVERLAP]]
            expected = [w for i, p in enumerate(p for p in pieces(text) if p) for w in (["\n"] if i else []) + p]
            assert joined == expected
            for a, b in zip(own, own[1:], strict=False):
                assert a[-phrases.OVERLAP:] == b[:phrases.OVERLAP]
            assert not own or own[-1][-phrases.OVERLAP:] == ["\n"] * phrases.OVERLAP


def test_equal_passages_share_chunks():
    rng = random.Random(6)
    passage = " ".join(str(rng.randint(0, 10**6)) for _ in range(400))
    texts = [f"{rng.random()} start {passage} end {rng.random()}" for _ in range(20)]
    doc, chunks = phrases.parse(pa.array(texts), 16)
    assert len(set(chunks.to_pylist())) < len(chunks) / 4
    assert np.all(np.bincount(doc) > 5)


def peak(run):
    """Result of a call and the most bytes it held at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_block_steps_hold_little_memory():
    rng = np.random.default_rng(7)
    chunks = [" ".join(f"w{x}" for x in rng.integers(0, 50000, 40)) + " \n \n \n " for _ in range(32000)]
    block = pa.array(["en", "de"] * 16000), pa.array(chunks), pa.array([2] * 32000, pa.int64())
    g, most = peak(lambda: phrases.block_grams(*block))
    assert most < 14 * len(g.data)
    at = np.flatnonzero((g.run > 3) & (np.arange(len(g.run)) % 2 == 0))
    starts, ends = g.starts[at], g.ends[at + 3]
    made, most = peak(lambda: phrases.byte_ranges(g.data, starts, ends))
    assert most < 6 * made.nbytes
    assert made.to_pylist()[::999] == [bytes(g.data[a:b]).decode() for a, b in zip(starts[::999], ends[::999], strict=True)]


def test_sliced_block_equals_whole_block(monkeypatch):
    texts = [t for t, _ in corpus(13, 60)] + ["one"]
    _, chunks = phrases.parse(pa.array(texts), 4)
    block = (pa.array(["en", "de", "en"] * len(chunks))[:len(chunks)], chunks, pa.array(np.arange(1, len(chunks) + 1)))
    whole = phrases.block_grams(*block)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 50)
    for a, b in zip(whole, phrases.block_grams(*block), strict=True):
        assert np.array_equal(a, b)
    made = phrases.byte_ranges(whole.data, whole.starts, whole.ends).to_pylist()
    assert made == [x for c in chunks.to_pylist() for x in c.split(" ")[:-1]]


def test_blocks_travel_one_by_one(spark):
    """A block meets its answers in a group of its own, not in a join whose whole partition makes one Arrow batch."""
    chunks = spark.createDataFrame([("en", "a b \n \n \n ", 40), ("de", "c \n \n \n ", 30)], "lang string, chunk string, freq long")
    counts = phrases.phrase_counts(chunks)
    assert {tuple(r) for r in counts.collect()} == {
        ("en", "a", 1, 40), ("en", "b", 1, 40), ("en", "a b", 2, 40), ("en", "", 0, 80), ("de", "c", 1, 30), ("de", "", 0, 30)}
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert plan.count("FlatMapGroupsInArrow") == 2


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    rows = corpus(11, 40)
    df = spark.createDataFrame([(i, t, lang, 1, 2, "x") for i, (t, lang) in enumerate(rows)],
                               "rank long, text string, lang string, f int, block int, chunk string")
    assert {tuple(r) for r in phrases.mine_collocations(df, min_count=5).collect()} == brute(rows, 5, 2000)


def test_big_counts_keep_exact_scores(spark):
    """Products past 64 bits: floor(2000000 * a / (l + r)) with a near 10**18."""
    from pyspark.sql import functions as F
    big = 10**18 + 7
    row = spark.createDataFrame([(big, big + 5, big + 11)], "a long, l long, r long").select(F.expr(
        "cast(2000000 as decimal(12,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    assert row.first()[0] == 2000000 * big // (2 * big + 16)
