"""Corpus-wide counts of hashed keys, asked for and answered by blocks.

Documents are dealt by hash into blocks of bounded size.  A block asks for
the counts of its *distinct* keys; requests travel to key ranges ("buckets"),
where the blocks' own counts are added up, and the totals travel back in the
order of the request.  However frequent a key is, it occurs once per block,
so no key makes a bucket or a task large.

A request row is one (block, bucket) pair: sorted keys as differences plus
one or more aligned counters, packed as small integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes per block and keys per bucket: what one Python task holds.
BLOCK_BYTES = 6 << 20
BUCKET_KEYS = 2_000_000


def pack_counts(x: np.ndarray) -> bytes:
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64
    return x.astype(kind).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(data) // n] if n else np.uint8)


def bucket_of(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Key ranges of equal width (``keys`` are ``bits`` wide, 32 at least)."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(n_buckets)) >> np.uint64(32)


def requests(block: int, keys: np.ndarray, counters: list[np.ndarray], bits: int, n_buckets: int) -> pa.Table:
    """Request rows of one block; ``keys`` are sorted and distinct."""
    bucket = bucket_of(keys, bits, n_buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    if not len(keys):
        starts = ends = np.zeros(0, np.int64)
    packed = []
    for a, b in zip(starts, ends, strict=True):
        gaps = np.diff(keys[a:b])
        packed.append(gaps.astype(np.uint32 if not len(gaps) or int(gaps.max()) < 1 << 32 else np.uint64).tobytes())
    columns = {
        "bucket": pa.array(bucket[starts].astype(np.int64), pa.int64()),
        "block": pa.array(np.full(len(starts), block), pa.int64()),
        "n": pa.array(ends - starts, pa.int32()),
        "base": pa.array(keys[starts].view(np.int64), pa.int64()),
        "gaps": pa.array(packed, pa.binary()),
    }
    for i, c in enumerate(counters):
        columns[f"c{i}"] = pa.array([pack_counts(c[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.table(columns)


def request_schema(counters: int) -> str:
    return "bucket long, block long, n int, base long, gaps binary" + "".join(f", c{i} binary" for i in range(counters))


def answer(asked: DataFrame, counters: int, summary: Callable[[np.ndarray, list[np.ndarray]], list[int]] | None = None,
           combine=np.add) -> DataFrame:
    """Totals of every request: ``block, bucket, n, t0.., s0..``.

    ``summary`` maps a bucket's distinct keys and totals to a few numbers,
    given on one of the bucket's rows (the others hold 0).
    """
    extra = 0 if summary is None else len(summary(np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * counters))

    def run(table):
        table = table.combine_chunks()
        n = table.column("n").to_numpy()
        base = table.column("base").to_numpy().view(np.uint64)
        keys = np.empty(int(n.sum()), np.uint64)
        given = [np.empty(len(keys), np.int64) for _ in range(counters)]
        ends = np.cumsum(n)
        packed = [table.column(f"c{i}").to_pylist() for i in range(counters)]
        for r, (gaps, m, e) in enumerate(zip(table.column("gaps").to_pylist(), n.tolist(), ends.tolist(), strict=True)):
            own = keys[e - m:e]
            own[0] = base[r]
            if m > 1:
                own[1:] = np.frombuffer(gaps, np.uint32 if len(gaps) == 4 * (m - 1) else np.uint64)
                np.cumsum(own, out=own)
            for i in range(counters):
                given[i][e - m:e] = unpack_counts(packed[i][r], m)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        group = np.zeros(len(keys), np.int32)
        group[heads[1:]] = 1
        np.cumsum(group, out=group)
        totals = [combine.reduceat(g[order], heads) for g in given]
        columns = {"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n")}
        for i, t in enumerate(totals):
            full = np.empty(len(keys), np.int64)
            full[order] = t[group]
            columns[f"t{i}"] = pa.array([pack_counts(full[e - m:e]) for m, e in zip(n.tolist(), ends.tolist(), strict=True)],
                                        pa.binary())
        found = summary(keys[heads], totals) if summary else []
        for i, s in enumerate(found):
            columns[f"s{i}"] = pa.array([s] + [0] * (len(n) - 1), pa.int64())
        return pa.table(columns)

    schema = ("block long, bucket long, n int" + "".join(f", t{i} binary" for i in range(counters))
              + "".join(f", s{i} long" for i in range(extra)))
    return asked.groupBy("bucket").applyInArrow(run, schema)


def totals_of(answers: pa.Table, counters: int) -> list[np.ndarray]:
    """A block's totals, aligned with its sorted distinct keys."""
    answers = answers.sort_by("bucket")
    n = answers.column("n").to_pylist()
    return [np.concatenate([unpack_counts(b, m).astype(np.int64)
                            for b, m in zip(answers.column(f"t{i}").to_pylist(), n, strict=True)] or [np.zeros(0, np.int64)])
            for i in range(counters)]


def blocks_for(total_bytes: int, multiple: int = 1) -> int:
    """Number of blocks for so many text bytes."""
    return max(1, -(-total_bytes // (BLOCK_BYTES * multiple))) * multiple


def row_ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``most``."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi
