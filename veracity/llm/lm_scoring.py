"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of order 1..n and a uniform floor are mixed; the
mixture weights depend on how often the context was seen (one bucket per
power of two and per longest seen context).  They are learned by
expectation-maximisation on a part of the learning documents that is deleted
from the counts (every ``DELETED``-th block); the scores then use the counts
of all learning documents.

EM sees the held-out tokens as a table of cells: tokens of one bucket whose
estimates agree to within ``CELL`` in the logarithm share a cell, which keeps
their number and the means of their estimates.  The table is bounded by the
number of buckets and steps, not by the corpus.

Defined results: null and empty texts are one end token; ids whose checksum
remainder is ``remainder`` are never learned from; a null id counts as '' for
that; repeated rows are scored (and learned from) separately; without
learning documents every token scores 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm import keycounts as kc
from veracity.llm.textblocks import chain, crc_held_out, tokenize
from veracity.session import cut_lineage

DELETED = 8
CELL = 0.1
FLOOR = 0.05  # prior mass of each weight, keeps every mixture positive
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
_END, _BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def ngram_keys(column, order: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of all n-grams ending at each token, by order, and each document's first token.

    The two lowest bits of a key hold the order; ``bits`` are used in all.
    """
    words = tokenize(column)
    docs = len(words.first) - 1
    first = words.first + np.arange(docs + 1)
    h = np.full(int(first[-1]), _END, np.uint64)
    h[np.arange(len(words.hashes)) + words.doc] = words.hashes
    keys, parts = [], [h]
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, order + 1):
        whole = chain(*parts, salt=k)
        keys.append(((whole >> np.uint64(64 - bits)) & ~np.uint64(3)) | np.uint64(k))
        back = np.full(len(h), _BEGIN, np.uint64)
        back[k:] = h[:-k] if k < len(h) else h[:0]
        back[place < k] = _BEGIN
        parts = [back, *parts]
    return keys, first


def estimates(counts: list[np.ndarray], first: np.ndarray, n_tokens: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (order x token) and context buckets."""
    starts = np.zeros(len(counts[0]), bool)
    starts[first[:-1]] = True
    f = np.zeros((len(counts), len(counts[0])))
    f[0] = counts[0] / max(n_tokens, 1)
    bucket = np.zeros(len(counts[0]), np.int64)
    for k in range(1, len(counts)):
        context = np.empty(len(counts[0]), np.int64)
        context[1:] = counts[k - 1][:-1]
        context[starts] = n_docs
        seen = context > 0
        f[k][seen] = counts[k][seen] / context[seen]
        bucket[seen] = k * 64 + np.log2(context[seen]).astype(np.int64)
    return f, bucket


def learn_weights(cells, order: int, floor: float, rounds: int = 60) -> dict[int, np.ndarray]:
    """EM per bucket over the cells; weights are (uniform, order 1, .., order n)."""
    out = {}
    for bucket, own in cells.groupby("bucket"):
        n = own["n"].to_numpy(float)
        f = np.stack([np.full(len(n), floor), *(own[f"f{k}"].to_numpy() / n for k in range(order))])
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            part = w[:, None] * f
            w = ((part / part.sum(axis=0)) * n).sum(axis=1) + FLOOR
            w /= w.sum()
        out[int(bucket)] = w
    return out


def weight_table(weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Weights of every context bucket (rows) for the floor and the orders 1..n.

    A bucket that the held-out tokens do not fill takes those of the nearest
    one that they fill and whose contexts are as long.  Orders whose context
    was not seen have no estimate and no weight: each row adds up to 1 over
    the estimates that exist.
    """
    table = np.full((64 * (order + 1), order + 1), 1 / (order + 1))
    for b in range(len(table)):
        filled = [f for f in weights if f // 64 == b // 64]
        if filled:
            table[b] = weights[min(filled, key=lambda f, b=b: (abs(f - b), f))]
        table[b, b // 64 + 2:] = 0
    return table / table.sum(axis=1, keepdims=True)


def score_texts(df: DataFrame, order: int = 2, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its model score, its base score, and counts of its tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.expr(crc_held_out(id_col, modulus, remainder)).alias("held_out"), text.alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = kc.blocks_for(size, DELETED)
    # Collisions stay at one in 2**21 lookups or fewer, up to 64 bits.
    bits = min(64, max(48, size.bit_length() + 21))
    n_buckets = max(1, -(-size * order // (5 * kc.BUCKET_KEYS)))
    docs = read.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(n_blocks)))

    def ask(key, table):
        block = key[0].as_py()
        keys, first = ngram_keys(table.column("text"), order, bits)
        learn = np.repeat(~table.column("held_out").to_numpy().astype(bool), np.diff(first))
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.tile(learn, order), minlength=len(own)).astype(np.int64)
        none = np.zeros(len(own), np.int64)
        return kc.requests(block, own, [none, n] if block % DELETED == 0 else [n, none], bits, n_buckets)

    def summary(keys, totals):
        words = (keys & np.uint64(3)) == 1
        both = totals[0] + totals[1]
        return [int((both[words] > 0).sum()), int(totals[0][words].sum()), int(totals[1][words].sum())]

    asked = docs.groupBy("block").applyInArrow(ask, kc.request_schema(2))
    answers = cut_lineage(kc.answer(asked, 2, summary), "lm-counts")
    words, kept, deleted = (x or 0 for x in answers.agg(F.sum("s0"), F.sum("s1"), F.sum("s2")).first())
    learners = docs.where("not held_out").groupBy((F.col("block") % DELETED == 0).alias("out")).count().collect()
    n_docs = {r["out"]: r["count"] for r in learners}
    docs_kept, docs_all = n_docs.get(False, 0), sum(n_docs.values())
    n_tokens, floor = kept + deleted, 1 / (words + 1)
    replies = answers.select("block", "bucket", "n", "t0", "t1")

    def lookup(table, reply):
        keys, first = ngram_keys(table.column("text"), order, bits)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        t0, t1 = kc.totals_of(reply, 2)
        split = np.split(inverse, order)
        return [t0[i] for i in split], [t1[i] for i in split], first

    def tabulate(table, reply):
        c0, _, first = lookup(table, reply)
        f, bucket = estimates(c0, first, kept, docs_kept)
        use = np.repeat(~table.column("held_out").to_numpy().astype(bool), np.diff(first))
        f, bucket = f[:, use], bucket[use]
        steps = [np.where(x > 0, np.round(np.log(np.maximum(x, 1e-300) / floor) / CELL), -999).astype(np.int64) for x in f]
        cell = bucket
        for s in steps:
            cell = cell * 2048 + (s + 1024)
        names, at = np.unique(cell, return_inverse=True)
        n = np.bincount(at)
        return pa.table({"bucket": pa.array(names // 2048**order, pa.int64()), "cell": pa.array(names, pa.int64()),
                         "n": pa.array(n, pa.int64())}
                        | {f"f{k}": pa.array(np.bincount(at, weights=f[k]), pa.float64()) for k in range(order)})

    pick = F.col("block") % DELETED == 0
    cells = (docs.where(pick).groupBy("block").cogroup(replies.where(pick).groupBy("block")).applyInArrow(
        tabulate, "bucket long, cell long, n long" + "".join(f", f{k} double" for k in range(order)))
        .groupBy("bucket", "cell").agg(F.sum("n").alias("n"), *(F.sum(f"f{k}").alias(f"f{k}") for k in range(order))))
    weights = learn_weights(cells.toPandas(), order, floor)
    table_of = weight_table(weights, order)

    def score(table, reply):
        c0, c1, first = lookup(table, reply)
        counts = [a + b for a, b in zip(c0, c1, strict=True)]
        f, bucket = estimates(counts, first, n_tokens, docs_all)
        w = table_of[bucket]
        p = w[:, 0] * floor + sum(w[:, k + 1] * f[k] for k in range(order))
        base = np.log10((counts[0] + 1) / (n_tokens + words + 1))
        n = np.diff(first)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first[:-1]), pa.int64()),
            "train_tokens": pa.array(np.full(len(n), n_tokens), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, first[:-1]), pa.float64()),
            "score": pa.array(np.add.reduceat(np.log10(p), first[:-1]), pa.float64())})

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCHEMA)
