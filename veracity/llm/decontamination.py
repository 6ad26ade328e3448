"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a 64-bit SimHash of its 5-word shingles, weighted by
how often they occur in it.  A document is cut into all windows of as many
shingles as an item has; a window's fingerprint is looked up in a multi-index
over the items of that size: the 64 bits are split into 8 blocks, and two
fingerprints within ``RADIUS`` bits agree in some block up to
``RADIUS // 8`` bits, so probing the blocks finds *all* items within the
radius.  A repeated shingle can move a fingerprint much further than its share
of the similarity: windows that repeat one, and items that do, are candidates
for everything they share a shingle with.  Candidates are verified by the exact weighted similarity of their
shingles (sum of the smaller weights over sum of the larger).

Windows that cannot reach the similarity are skipped before any fingerprint
is made: the window must hold enough shingles that occur in the benchmark at
all.  The gate loses nothing that the verification would accept.

The index of the items is broadcast in parts of ``PART_BYTES`` of item text
at most; a larger benchmark takes several passes over the documents.

Defined results: null or empty documents and items match nothing; an item of
fewer words than a shingle matches only a document that is that word sequence;
repeated items are all reported; repeated documents are reported separately; a
null ``doc_id`` is kept; other columns are ignored by ``find_leaks`` and kept
by ``drop_leaks``; without items nothing matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.textblocks import shingles, slices, tokenize

RADIUS = 23
BLOCKS = 8
PART_BYTES = 32 << 20
_RUN = 4096  # window starts whose bit sums are held at once
SCHEMA = "doc_id long, item_id long, similarity double, distance int, start_word long, n_words long"


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of 8 bytes) of summed +1/-1 bits (rows x 64)."""
    return np.packbits(sums > 0, axis=1)


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    """+1/-1 for the 64 bits of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class MultiIndex:
    """All fingerprints within ``radius`` of a query, by block probing."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        values = np.arange(256, dtype=np.uint8)
        near = np.unpackbits((values[:, None] ^ values[None, :])[:, :, None], axis=2).sum(axis=2) <= radius // BLOCKS
        self.lists = [[np.flatnonzero(near[v][prints[:, b]]) for v in range(256)] for b in range(BLOCKS)]

    def query(self, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.unique(np.concatenate([self.lists[b][fingerprint[b]] for b in range(BLOCKS)]))
        distance = np.unpackbits(self.prints[found] ^ fingerprint, axis=1).sum(axis=1)
        return found[distance <= self.radius], distance[distance <= self.radius]


def next_repeat(own: np.ndarray) -> np.ndarray:
    """For every start, where a shingle first stands that stood before at or after the start."""
    order = np.argsort(own, kind="stable")
    nxt = np.full(len(own) + 1, len(own) + 1)
    same = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    nxt[order[same]] = order[same + 1]
    return np.minimum.accumulate(nxt[::-1])[::-1][:len(own)]


class ItemIndex:
    """Items by size in shingles, with their fingerprints and weighted shingles."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, pct: int):
        self.pct, self.shingle = pct, shingle
        words = tokenize(pa.array(texts, pa.large_string()))
        found, first = shingles(words, shingle)
        self.ids, self.n_words = ids, words.counts
        self.weights = [dict(zip(*(x.tolist() for x in np.unique(found[a:b], return_counts=True)), strict=True))
                        for a, b in zip(first[:-1], first[1:], strict=True)]
        self.known = np.unique(found)
        self.mask = np.zeros(1 << 22, bool)
        self.mask[(self.known >> np.uint64(42)).astype(np.int64)] = True
        sizes = np.diff(first)
        self.by_size = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            items = np.flatnonzero(sizes == size)
            prints = np.concatenate([simhash(signed_bits(found[first[i]:first[i + 1]]).sum(axis=0, keepdims=True))
                                     for i in items])
            repeated = [i for i in items.tolist() if len(self.weights[i]) < size]
            self.by_size[size] = (items, MultiIndex(prints), self.holders(items.tolist()), self.holders(repeated))

    def holders(self, items: list[int]) -> dict[int, list[int]]:
        """Items by the shingles that they hold."""
        out: dict[int, list[int]] = {}
        for i in items:
            for h in self.weights[i]:
                out.setdefault(h, []).append(i)
        return out

    def need(self, size: int, window: int) -> int:
        """Least number of shared shingles of a window and an item that are similar enough."""
        return -(-self.pct * (size + window) // (100 + self.pct))

    def hits(self, found: np.ndarray) -> np.ndarray:
        hit = self.mask[(found >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, found[at]), len(self.known) - 1)
            hit[at] = self.known[place] == found[at]
        return hit

    def match(self, own: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item -> (similarity, -distance, -start) of its best window in one document."""
        best: dict[int, tuple[float, int, int]] = {}
        total = np.concatenate([[0], np.cumsum(hit)])
        again = next_repeat(own)
        for size, (items, index, holders, repeated) in self.by_size.items():
            window = min(size, len(own))
            need = self.need(size, window)
            if need > window or total[-1] < need:
                continue
            starts = np.flatnonzero(total[window:] - total[:len(total) - window] >= need)
            while len(starts):
                run = starts[starts < starts[0] + _RUN]
                starts = starts[len(run):]
                lo, hi = int(run[0]), int(run[-1]) + window
                sums = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(signed_bits(own[lo:hi]), axis=0, out=sums[1:])
                prints = simhash(sums[run - lo + window] - sums[run - lo])
                for s, fingerprint in zip(run.tolist(), prints, strict=True):
                    near = {int(items[k]): d for k, d in zip(*(x.tolist() for x in index.query(fingerprint)), strict=True)}
                    # A repeated shingle weighs on the fingerprint as on nothing else: all who share one are verified.
                    sharing = holders if again[s] < s + window else repeated
                    for item in {i for h in set(own[s:s + window].tolist()) for i in sharing.get(h, ())} if sharing else ():
                        if item not in near:
                            k = int(np.searchsorted(items, item))
                            near[item] = int(np.unpackbits(index.prints[k] ^ fingerprint).sum())
                    for item, distance in near.items():
                        similar = self.similarity(item, own[s:s + window])
                        if 100 * similar[0] >= self.pct * similar[1]:
                            best[item] = max(best.get(item, (0.0, -64, 0)), (similar[0] / similar[1], -distance, -s))
        return best

    def similarity(self, item: int, window: np.ndarray) -> tuple[int, int]:
        """Sums of the smaller and of the larger weights of all shingles."""
        weights = self.weights[item]
        names, n = np.unique(window, return_counts=True)
        low = sum(min(weights.get(h, 0), k) for h, k in zip(names.tolist(), n.tolist(), strict=True))
        return low, sum(weights.values()) + len(window) - low

    def scan(self, column):
        """(row, matches) of every text that holds an item."""
        least = min((self.need(m, m) for m in self.by_size), default=0)
        small = min((self.need(m, 1) for m in self.by_size), default=2)
        for lo, hi in slices(column):
            found, first = shingles(tokenize(column.slice(lo, hi - lo)), self.shingle)
            hit = self.hits(found) if len(self.known) else np.zeros(len(found), bool)
            total = np.concatenate([[0], np.cumsum(hit)])
            per_doc = total[first[1:]] - total[first[:-1]]
            for d in np.flatnonzero(per_doc >= max(1, min(least, small))):
                matches = self.match(found[first[d]:first[d + 1]], hit[first[d]:first[d + 1]])
                if matches:
                    yield lo + int(d), matches


def _indexes(benchmark: DataFrame, shingle: int, pct: int, item_col: str, text_col: str):
    """Item indexes of ``PART_BYTES`` of text at most, one after another."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size * 2 // PART_BYTES)) if size > PART_BYTES else 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], shingle, pct)


def find_leaks(df: DataFrame, benchmark: DataFrame, shingle: int = 5, pct: int = 80, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item that it holds, with the best window."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, shingle, pct, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = [(r, i, *m) for r, found in index.scan(batch.column(1)) for i, m in sorted(found.items())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())),
                     pa.array([index.ids[x[1]] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.float64()),
                     pa.array([-x[3] for x in rows], pa.int32()), pa.array([-x[4] for x in rows], pa.int64()),
                     pa.array([int(index.n_words[x[1]]) for x in rows], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "distance", "start_word", "n_words"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, shingle: int = 5, pct: int = 80, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``df`` without the rows that hold a benchmark item."""
    at = df.columns.index(text_col)
    for index in _indexes(benchmark, shingle, pct, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in shared.value.scan(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
