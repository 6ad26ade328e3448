"""Lossless blocking inside a leaf, and masking line by line."""

from pyspark.sql import functions as F

from veracity.llm import line_dedup

DOCS = "doc_id long, text string"


def test_a_leaf_of_unlike_lines_costs_no_round(spark, monkeypatch):
    jobs = []
    real = line_dedup.cut_lineage
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df, name="": jobs.append(name) or real(df, name))
    unlike = [" ".join(["all", "of", "the", *(f"w{'abcdefghij'[i % 10]}{'x' * (i // 10 % 25)}{'y' * (i // 250)}{c}" for c in "klmnopq")])
              for i in range(10_000)]
    like = ["all of the one two three four five six seven", "all of the one two three four five six other"]
    texts = ["\n".join([*unlike[k::4], like[k % 2]]) for k in range(4)]
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS), name="cut").orderBy("doc_id").collect()
    assert [r.cut.n_dropped_lines for r in rows] == [0, 1, 1, 1]
    assert jobs.count("line-round") <= 2


def test_lines_that_fit_share_a_segment(spark):
    import random
    rng = random.Random(3)
    pairs = []
    for n in range(4, 40):
        for _ in range(20):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(3, n), min(int(n * 0.2 + 1e-9), n - 3)):
                b[i] = "z"
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    both = df.select(line_dedup._fits(F.col("a"), F.col("b"), 0.8).alias("fits"), "a", "b")
    for side in "ab":
        both = both.withColumn("toks", F.col(side)).withColumn(f"s{side}", line_dedup._segments(3, 0.8))
    got = both.select("fits", F.arrays_overlap("sa", "sb").alias("met")).collect()
    assert all(r.met for r in got if r.fits) and sum(r.fits for r in got) > 600


def test_masking(spark):
    texts = ["a  b\tc \r\n x1y  2024-05-06 \n17\n 3 4 \nplain line\n\n9 of 10", "  \n\t", None, "ü1 ß\x0b\x0cq"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(line_dedup.masked_lines(F.col("t")).alias("m")).collect()]
    assert got == [["a b c", "x1y 2024-05-06", "17", "3 4", "plain line", "", "<*> of <*>"], ["", ""], None, ["<*> ß q"]]
