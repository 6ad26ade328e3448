"""Language identification by multilingual mixture inference.

A document is a bag of byte trigrams drawn from a mixture of languages.
Trigrams are hashed into ``2**bits`` coordinates, counted per language over
all learning documents, and the most informative coordinates are kept.  For
each document, expectation-maximisation estimates the proportions of the
languages in a set; sets grow greedily from the best single language, and a
language enters only if the log-likelihood gains more than a penalty in the
number of trigrams.  The prediction is the language with the largest share.

The likelihood is concave in the proportions, so EM is skipped for documents
where no language has a positive slope at the single-language solution: that
solution is their optimum.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing could be learned; ties go to the language first
in the alphabet; texts are read whole; repeated rows are predicted
separately; rows without a language are not learned from; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.textblocks import crc_held_out, slices, utf8

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def trigrams(column, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every byte trigram inside a text; ASCII non-letters read as blanks."""
    data, at = utf8(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    code >>= np.uint32(32 - bits)
    ends = np.maximum(at[1:] - 2, at[:-1])
    use = np.ones(len(code) + 1, np.int8)
    for k in (1, 2):  # trigrams that would start in the last two bytes of a text
        tail = at[1:] - k
        use[tail[(tail >= at[:-1]) & (tail <= len(code))]] = 0
    use = use[:len(code)].astype(bool) & ~((b[:-2] == 32) & (b[1:-1] == 32))
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[:len(code)]
    del ends
    return doc[use], code[use].astype(np.int64)


def learn(df: DataFrame, bits: int, top: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, coordinate -> feature map (-1: unused), and P(feature | language).

    Counts cover every learning document; the collected table has one row per
    language and coordinate, 2**bits x languages at most.
    """
    rows = df.where(f"`{lang_col}` is not null and `{text_col}` is not null and not ({crc_held_out(id_col, 3, 1)})").select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            for i, lang in enumerate(names.dictionary.to_pylist()):
                texts = batch.column(1).filter(pa.array(code == i))
                for lo, hi in slices(texts):
                    _, at = trigrams(texts.slice(lo, hi - lo), bits)
                    total[lang] = total.get(lang, 0) + np.bincount(at, minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    found = rows.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    n = np.zeros((len(langs), 1 << bits))
    if langs:
        n[found["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    p = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    mean = p.mean(axis=0) if langs else np.zeros(1 << bits)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log(p / np.where(mean > 0, mean, 1)), 0).sum(axis=0)
    # Informative coordinates, and by their frequency what they add to the likelihood ratio.
    chosen = np.sort(np.lexsort((np.arange(1 << bits), -gain))[:top])
    chosen = chosen[mean[chosen] > 0]
    where = np.full(1 << bits, -1, np.int32)
    where[chosen] = np.arange(len(chosen))
    kept = n[:, chosen] + 0.5
    return langs, where, (kept / kept.sum(axis=1, keepdims=True)).astype(np.float32)


def em(counts: np.ndarray, p: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x set) and log-likelihood by EM for one set of languages.

    ``p`` is set x features, or documents x set x features flattened per call
    when all documents share the set.
    """
    share = np.full((len(counts), len(p)), 1.0 / len(p), np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((counts / (share @ p)) @ p.T) / total
    return share, (counts * np.log(share @ p)).sum(axis=1)


def infer(counts: np.ndarray, p: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Best language (index) and its share for each row of feature counts."""
    single = counts @ np.log(p).T
    best = np.argmax(single, axis=1)
    n = counts.sum(axis=1)
    share = np.where(n > 0, 1.0, 1 / len(p))  # no evidence: each language is as likely
    mixed: list[int] = []
    for b in np.unique(best):
        rows = np.flatnonzero(best == b)
        slope = counts[rows] @ (p / p[b]).T  # > n: the likelihood rises when this language enters
        mixed += rows[(slope > n[rows, None] * (1 + 1e-4)).any(axis=1)].tolist()
    groups: dict[tuple[int, ...], list[int]] = {}
    for r in mixed:
        groups.setdefault((int(best[r]),), []).append(r)
    like = single[np.arange(len(counts)), best].astype(np.float64)
    while groups:
        grown: dict[tuple[int, ...], list[int]] = {}
        for chosen, rows in groups.items():
            at = np.asarray(rows)
            others = [k for k in range(len(p)) if k not in chosen]
            trials = [em(counts[at], p[[*chosen, k]]) for k in others]
            if not trials:
                continue
            likes = np.stack([t[1] for t in trials], axis=1)
            top = np.argmax(likes, axis=1)
            gain = likes[np.arange(len(at)), top] - like[at]
            for i in np.flatnonzero(gain > penalty * np.log(np.maximum(n[at], 2))):
                r, members = int(at[i]), (*chosen, others[top[i]])
                theta = trials[top[i]][0][i]
                like[r] = likes[i, top[i]]
                lead = max(range(len(members)), key=lambda k: (theta[k], -members[k]))
                best[r], share[r] = members[lead], theta[lead]
                grown.setdefault(members, []).append(r)
        groups = grown
    return best, share


def identify_languages(df: DataFrame, bits: int = 18, top: int = 2048, penalty: float = 4.0, id_col: str = "doc_id",
                       text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(learn(df, bits, top, id_col, text_col, lang_col))

    def run(batches):
        langs, where, p = shared.value
        for batch in batches:
            names = np.full(batch.num_rows, "und", object)
            scores = np.zeros(batch.num_rows)
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if langs:
                step = max(1, (1 << 21) // p.shape[1])
                for lo, hi in ((a, min(a + step, d)) for c, d in slices(batch.column(2)) for a in range(c, d, step)):
                    doc, at = trigrams(batch.column(2).slice(lo, hi - lo), bits)
                    f = where[at]
                    use = f >= 0
                    counts = np.bincount(doc[use].astype(np.int64) * p.shape[1] + f[use],
                                         minlength=(hi - lo) * p.shape[1]).reshape(hi - lo, -1).astype(np.float32)
                    best, share = infer(counts, p, penalty)
                    names[lo:hi] = np.asarray(langs, object)[best]
                    scores[lo:hi] = np.clip(share, 0, 1)
            names[~letters], scores[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(crc_held_out(id_col, 3, 1)).alias("held_out"),
                     F.col(text_col).alias("text"),
                     F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, SCHEMA)
