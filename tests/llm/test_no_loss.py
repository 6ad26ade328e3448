"""Cases in which rows or pairs used to be lost, or a result hung on unrelated rows."""

import numpy as np
import pyarrow as pa
import pytest

from veracity.llm import decontamination, jaccard_join, language, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = " ".join(f"w{i}" for i in range(40))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_keep_one_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, TEXT, 7, 8, "r", 9), (2, TEXT, 7, 8, "r", 9), (3, "other", 1, 2, "x", 3)],
                               "doc_id long, text string, keep_id long, keep_hash long, row string, many int")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, TEXT, 7, 8, "r", 9), (3, "other", 1, 2, "x", 3)]


@pytest.mark.parametrize("repeated", [False, True])
def test_rows_without_shingles_stay_whatever_else_is_there(spark, repeated):
    rows = [(None, None), (None, None), (5, ""), (5, ""), (6, " \n"), (1, TEXT)] + [(1, TEXT), (1, TEXT)] * repeated
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs(spark, rows)).collect()), key=str)
    assert kept == sorted(rows[:6], key=str)


def test_repeats_that_differ_elsewhere_leave_one_defined_row(spark):
    df = spark.createDataFrame([(1, TEXT, s) for s in ("a", "b", "c")], "doc_id long, text string, source string")
    picks = {jaccard_join.keep_one(df.orderBy(o)).first().source for o in (df.source.asc(), df.source.desc())}
    assert len(picks) == 1


def test_repeated_shingles_lose_no_pair(spark):
    """Items of 94 words against copies whose last words are one repeated token: similarity exactly 0.8."""
    rng = np.random.default_rng(5)
    items, copies = [], []
    for k in range(120):
        words = [f"i{k}w{rng.integers(10**6)}" for _ in range(94)]
        items.append((k, " ".join(words)))
        copies.append((k, " ".join(words[:84] + ["n/a"] * 10)))
        copies.append((1000 + k, "some words before " + " ".join(words[:84] + ["-"] * 10) + " and after it"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, copies), bench).collect()}
    assert found == {(k, k) for k in range(120)} | {(1000 + k, k) for k in range(120)}
    # and the other way round: items that repeat a shingle
    back = spark.createDataFrame([(k, " ".join([*t.split()[:84], *["n/a"] * 10])) for k, t in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, items), back).collect()}
    assert found == {(k, k) for k in range(120)}


def test_next_repeat():
    own = np.array([3, 1, 3, 2, 1, 2, 9], np.uint64)
    got = decontamination.next_repeat(own)
    for s in range(len(own)):
        seen = next((i for i in range(s, len(own)) if own[i] in own[s:i]), 10**9)
        assert got[s] == seen or (seen == 10**9 and got[s] > len(own))


def test_toxicity_bounds_hold_for_rows_and_disagreeing_copies_are_toxic(spark):
    rows = [(0, f"text number {i} of one id") for i in range(200)] + [(0, "same")] * 500
    rows += [(3, "bad word"), (5, "bad word"), (6, "fine day"), (9, "fine day"), (12, None), (12, "")]
    labels = spark.createDataFrame([(0, 0), (3, 1), (5, 0), (6, 0), (9, 0), (12, 1), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows)
    whole = toxicity.labelled_texts(df, labels, 16_000, 1 << 20).collect()
    held = [i for i in (0, 3, 5, 6, 9, 12) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    texts = {t or "" for i, t in rows if i not in held}
    assert sorted(r.text for r in whole) == sorted(texts)
    assert all(r.toxic == max(y for i, y in [(0, 0), (3, 1), (5, 0), (6, 0), (9, 0), (12, 1)]
                              if i not in held and (i, r.text) in [(j, t or "") for j, t in rows]) for r in whole)
    assert toxicity.labelled_texts(df, labels, 50, 1 << 20).count() == 50
    few = toxicity.labelled_texts(df, labels, 16_000, 300).collect()
    assert 1 <= len(few) < len(whole) and sum(len(r.text.encode()) for r in few) <= 300
    assert toxicity.labelled_texts(df, labels, 16_000, 1).count() >= 1
    assert toxicity.score_toxicity(df, labels, max_rows=50).count() == len(rows)


def test_no_evidence_is_no_certainty():
    p = np.array([[0.7, 0.3], [0.4, 0.6], [0.5, 0.5]])
    _, share = language.infer(np.zeros((2, 2)), p, 1.0)
    assert share.tolist() == [1 / 3, 1 / 3]
    _, sure = language.infer(np.array([[9.0, 0.0]]), p, 1.0)
    assert sure[0] == 1.0 and pa is not None
