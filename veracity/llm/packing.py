"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces.
Pieces are dealt by hash into groups of bounded token mass, and each group is
packed by best-fit decreasing over all permitted lengths jointly:

* a piece goes to the open bin it leaves least room in;
* if none fits, a new bin is opened, of the size with the least net cost: its
  own cost (length plus a fixed price per sequence) minus the worth of the
  room that the pieces still to come are expected to use;
* at the end every bin shrinks to the smallest permitted length that holds
  its contents.

Defined results: a null or empty text is one piece of one token (the end
mark); cuts keep the order of the tokens; ties in size are packed in the
order of (doc_id, checksum, piece); repeated rows are packed separately; a
null ``doc_id`` is kept; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
SCHEMA = ("doc_id long, text_crc32 long, piece int, start long, n_tokens int, "
          "bin_id string, bin_capacity int, bin_offset int, bin_filled int")


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_price: float = 64.0,
         expected_fill: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and final capacity of each size (no size above the largest capacity)."""
    caps = sorted(capacities)
    unit = min((c + bin_price) / c for c in caps) * expected_fill
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    rest = float(np.sum(sizes))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    for i in order:
        s = int(sizes[i])
        rest -= s
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room = min((c for c in caps if c >= s), key=lambda c: (c + bin_price - unit * min(c - s, rest), c))
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += s
        left = room - s
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    final = np.asarray(caps)[np.searchsorted(caps, np.asarray(filled, np.int64))] if filled else np.zeros(0, np.int64)
    return bins, offsets, final


def word_tokens(text: Column) -> Column:
    """Words of a text plus one end mark."""
    from veracity.llm.quality_rules import WHITE
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")) + 1


def pack_documents(df: DataFrame, n_tokens: Column | None = None, capacities: Sequence[int] = CAPACITIES,
                   group_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its bin, offset, and the bin's final capacity.

    ``group_tokens`` bounds what one task packs; packing quality is within
    one partly filled bin per group of packing everything together.
    """
    top = max(capacities)
    sized = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        (word_tokens(F.col(text_col)) if n_tokens is None else n_tokens).cast("long").alias("tokens"))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    pieces = sized.select("doc_id", "text_crc32", "tokens", F.explode(F.sequence(
        F.lit(0), ((F.col("tokens") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.select(
        F.pmod(F.xxhash64("doc_id", "text_crc32", "piece"), F.lit(groups)).cast("int").alias("grp"),
        "doc_id", "text_crc32", "piece", (F.col("piece").cast("long") * top).alias("start"),
        F.least(F.lit(top), F.col("tokens") - F.col("piece").cast("long") * top).cast("int").alias("n_tokens"))

    def run(key, table):
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("text_crc32", "ascending"),
                               ("piece", "ascending")])
        bins, offsets, final = pack(table.column("n_tokens").to_numpy(), capacities)
        filled = np.bincount(bins, weights=table.column("n_tokens").to_numpy()).astype(np.int64)
        names = pa.array([f"{key[0].as_py()}-{b}" for b in bins.tolist()], pa.string())
        return pa.table([*(table.column(c) for c in ("doc_id", "text_crc32", "piece", "start", "n_tokens")), names,
                         pa.array(final[bins], pa.int32()), pa.array(offsets, pa.int32()),
                         pa.array(filled[bins], pa.int32())],
                        names=["doc_id", "text_crc32", "piece", "start", "n_tokens", "bin_id", "bin_capacity",
                               "bin_offset", "bin_filled"])

    return pieces.groupBy("grp").applyInArrow(run, SCHEMA)
