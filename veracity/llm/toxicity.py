"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, word pairs and skip pairs (one word left
out) of the whole text, hashed into ``2**bits`` coordinates.  FTRL-proximal
gives each coordinate its own learning rate and an L1 term that keeps most
weights at exactly zero, so the model is one small vector that is broadcast.

The classifier is fitted on a bounded sample of labelled rows
(``max_rows``, taken in the order of a hash of the id); every document is
scored.

Defined results: null and empty texts have no features and score the bias
alone; several labels of one document count as toxic if one is; null labels
are left out; repeated rows are scored separately; without any labelled row
every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.textblocks import NON_ALNUM, chain, crc_held_out, slices, stems, tokenize

# Word beginnings (bytes) that stand for a word's inflected forms.
STEMS = (4, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(column, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of all words, pairs and skip pairs; repeats included."""
    words = tokenize(column, NON_ALNUM)
    h, doc = words.hashes, words.doc
    parts, docs = [chain(h, salt=1)], [doc]
    for size in STEMS:
        parts.append(chain(stems(column, words, size), salt=10 + size))
        docs.append(doc)
    for gap, salt in ((1, 2), (2, 3)):
        same = doc[:-gap] == doc[gap:]
        parts.append(chain(h[:-gap], h[gap:], salt=salt)[same])
        docs.append(doc[:-gap][same])
    return np.concatenate(docs), (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(doc: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc << bits) | at)
    return key >> bits, key & ((1 << bits) - 1)


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0,
             l1: float = 16.0, l2: float = 0.1, epochs: int = 6,
             toxic_weight: float = 4.0) -> tuple[np.ndarray, float]:
    """Sparse weights and bias; ``examples`` are arrays of distinct coordinates."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            at = np.append(x, size)  # the bias is the last coordinate, without L1
            zi, ni = z[at], n[at]
            thin = np.append(np.full(len(x), l1), 0.0)
            w = np.where(np.abs(zi) <= thin, 0.0, -(zi - np.sign(zi) * thin) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            if y:
                g *= toxic_weight
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    thin = np.append(np.full(size, l1), 0.0)
    w = np.where(np.abs(z) <= thin, 0.0, -(z - np.sign(z) * thin) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1].astype(np.float32), float(w[-1])


def labelled_texts(df: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, h, text, toxic``: at most ``max_rows`` different labelled texts of ``max_bytes`` in all (one at least)."""
    sample = (labels.where(f"{id_col} is not null and toxic is not null and not ({crc_held_out(id_col, 3, 1)})")
              .groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    # At most max_rows rows of two numbers: the size of the broadcast is bounded by the parameter.
    labelled = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    # Equal texts teach once, as toxic if any of them is; copies are merged before the shuffle.
    texts = labelled.groupBy(F.xxhash64("text").alias("h")).agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.any_value("text").alias("text"))
    # An id may have several texts: the bounds hold for the rows that are fitted, in the order of a hash.
    order = Window.orderBy(F.xxhash64("doc_id", "h"), "h")
    sized = texts.orderBy(F.xxhash64("doc_id", "h"), "h").limit(max_rows).withColumn(
        "bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return sized.where((F.col("bytes") <= max_bytes) | (F.col("bytes") == F.octet_length("text"))).select(
        F.lit(0).alias("one"), "doc_id", "h", "text", "toxic")


def train(df: DataFrame, labels: DataFrame, bits: int = 20, max_rows: int = 16_000, id_col: str = "doc_id",
          text_col: str = "text", max_bytes: int = 256 << 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias learned from at most ``max_rows`` different labelled texts of ``max_bytes`` in all."""
    rows = labelled_texts(df, labels, max_rows, max_bytes, id_col, text_col)

    def run(table):
        table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        examples: list[np.ndarray] = []
        seen = np.zeros(1 << bits, np.int32)
        for lo, hi in slices(table.column("text")):
            doc, at = _distinct(*features(table.column("text").slice(lo, hi - lo), bits), bits)
            np.add.at(seen, at, 1)
            examples += np.split(at.astype(np.int32), np.searchsorted(doc, np.arange(1, hi - lo)))
        examples = [x[seen[x] > 1] for x in examples]  # a feature of one document alone teaches nothing
        order = np.random.default_rng(7).permutation(len(examples))
        y = table.column("toxic").to_numpy().astype(float)
        w, bias = fit_ftrl([examples[i] for i in order], y[order], bits)
        at = np.flatnonzero(w)
        return pa.table([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())],
                        names=["at", "weight"])

    model = rows.groupBy("one").applyInArrow(run, "at long, weight double").toPandas()
    if not len(model):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    inner = model[model["at"] >= 0]
    return inner["at"].to_numpy(), inner["weight"].to_numpy(np.float32), float(model.loc[model["at"] < 0, "weight"].iloc[0])


def score_toxicity(df: DataFrame, labels: DataFrame, bits: int = 20, max_rows: int = 16_000, threshold: float = 0.7,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``df``."""
    model = train(df, labels, bits, max_rows, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # non-zero weights only, 2**bits at most

    def run(batches):
        at, weight, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = weight
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for lo, hi in slices(batch.column(2)):
                doc, f = features(batch.column(2).slice(lo, hi - lo), bits)
                live = dense[f] != 0
                doc, f = _distinct(doc[live], f[live], bits)
                out[lo:hi] += np.bincount(doc, weights=dense[f], minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p),
                                              pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(crc_held_out(id_col, 3, 1)).alias("held_out"),
                     F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
