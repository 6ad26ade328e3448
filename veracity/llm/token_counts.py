"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a doubly linked list of byte symbols.  A heap holds
the ranks of adjacent pairs; the lowest rank (leftmost first) is popped and
merged, its two new neighbours are pushed, stale entries are skipped.  The
count is the number of initial symbols minus the number of merges: no token
identifier is ever produced.

Defined results: null and empty texts have 0 bytes and 0 tokens; any text
length is counted whole; repeated rows are counted separately; a null
``doc_id`` is kept; other columns of the input, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The split pattern and the special string of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load_merges(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Ranked merges and special strings of a byte-level BPE ``.json`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return merges, [t["content"] for t in spec.get("added_tokens", [])]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the merge list.

    Fixed format: printable Latin-1 bytes stand for themselves, the others
    for the characters from U+0100 on, in byte order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Cache from pre-token to its number of tokens, computed on a miss."""

    def __init__(self, merges, specials, cache_entries: int = 400_000):
        super().__init__()
        ids = {s: i for i, s in enumerate(byte_symbols())}
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            merged = ids.setdefault(a + b, len(ids))
            self.rule[ids[a], ids[b]] = (rank, merged)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cache_entries = cache_entries

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= self.cache_entries:  # bounds memory, not results
                self.clear()
            self[piece] = n
        return n

    def merge(self, symbols) -> int:
        """Initial symbols minus merges for one pre-token (a bytes object)."""
        sym = list(symbols)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rule = self.rule
        heap = []
        for i in range(n - 1):
            hit = rule.get((sym[i], sym[i + 1]))
            if hit:
                heap.append((hit[0], i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = rule[a, b][1], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = rule.get((sym[i], sym[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, sym[i], sym[k]))
            h = before[i]
            if h >= 0:
                hit = rule.get((sym[h], sym[i]))
                if hit:
                    heapq.heappush(heap, (hit[0], h, sym[h], sym[i]))
        return n - merges

    def count(self, text: str) -> int:
        specials, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            specials = len(parts) - 1
        return specials + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``vocabulary`` is the path of the tokenizer file on the driver; its
    merges (a fixed 50,000) are the only thing broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches):
        counter = MergeCounter(*shared.value)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = [counter.count(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
