"""Reproducible shuffle and sharding by a Feistel permutation.

Rows get global numbers 0..n-1 in an order that depends on their content
only.  A keyed Feistel network over the smallest even-bit domain that holds n
permutes the numbers; values that fall outside 0..n-1 walk the cycle until
they are inside, so the result is a permutation of 0..n-1.  Position p goes to
shard ``p mod k``, slot ``p div k``: both can be computed from a row number
alone (``locate``), and shard sizes differ by one row at most (law ``rows``).

Numbering needs no global sort: rows are counted per content bucket, bucket
offsets are a running sum over the (few) buckets, and rows are ranked inside
their bucket.  Equal rows are counted once and numbered as a run, so a group
of any size never meets in one task.

Defined results: a null text has size 1 and the checksum of the empty text;
equal rows get consecutive numbers (they are interchangeable); a null
``doc_id`` is kept and ordered first; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.textblocks import mix
from veracity.session import cut_lineage


class Feistel:
    """Keyed permutation of 0..n-1 (vectorised over numpy arrays)."""

    def __init__(self, n: int, seed: int = 17, rounds: int = 6):
        self.n = n
        self.half = max(1, -(-max(1, int(max(n - 1, 1)).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right ^ key) & self.mask)
        return (left << np.uint64(self.half)) | right

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the given row numbers; cycles are walked to the end."""
        x = self._once(np.asarray(rows, np.uint64))
        outside = np.flatnonzero(x >= self.n)
        while len(outside):
            x[outside] = self._once(x[outside])
            outside = outside[x[outside] >= self.n]
        return x.astype(np.int64)


def locate(row_number: int, n_rows: int, n_shards: int, seed: int = 17) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    p = int(Feistel(n_rows, seed)(np.array([row_number]))[0])
    return p % n_shards, p // n_shards


def number_rows(distinct: DataFrame, keys: list[str], count_col: str, bucket_rows: int = 100_000) -> tuple[DataFrame, int]:
    """First global number (``first_row``) of each distinct row, and the number of rows.

    ``distinct`` must be materialised.  Buckets are hash ranges of about
    ``bucket_rows`` distinct rows, so ranking inside one is bounded.
    """
    total = distinct.agg(F.coalesce(F.sum(count_col), F.lit(0)), F.count("*")).first()
    buckets = max(1, total[1] // bucket_rows)
    named = distinct.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    # One row per bucket: n / bucket_rows rows, summed in order.
    sizes = named.groupBy("bucket").agg(F.sum(count_col).alias("rows_in"))
    offsets = sizes.select("bucket", (F.sum("rows_in").over(Window.orderBy("bucket")) - F.col("rows_in")).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    ranked = named.withColumn("upto", F.sum(count_col).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = ranked.join(offsets, "bucket").withColumn("first_row", F.col("offset") + F.col("upto") - F.col(count_col))
    return out.drop("bucket", "upto", "offset"), int(total[0])


def shard_rows(df: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digest of the layout: one row per input row with its shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    digest = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    keys = ["doc_id", "size", "text_crc32"]
    distinct = cut_lineage(digest.groupBy(*keys).agg(F.count("*").alias("copies")), "shard-rows")
    numbered, n = number_rows(distinct, keys, "copies")
    rows = numbered.select(*keys, F.explode(F.sequence("first_row", F.col("first_row") + F.col("copies") - 1)).alias("row"))

    def place(batches):
        permute = Feistel(max(n, 1), seed)
        for batch in batches:
            p = permute(batch.column("row").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [pa.array(["rows"] * len(p), pa.string()), pa.array(p % n_shards, pa.int32()),
                   pa.array(p // n_shards, pa.int64()), pa.nulls(len(p), pa.int32()), batch.column("row")],
                names=[*keys, "law", "shard", "slot", "grown_shard", "row_number"])

    return rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, "
                                  "grown_shard int, row_number long")
