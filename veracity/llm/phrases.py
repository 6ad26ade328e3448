"""Phrase collocations by prefix-free parsing.

The word stream of a text is cut where the words themselves say so: a window
of ``OVERLAP`` tokens whose hash is a multiple of ``modulus`` ends a chunk and
begins the next one, so neighbouring chunks share that window and equal
passages give equal chunks wherever they stand.  Distinct chunks with their
parse frequencies are the dictionary; n-grams are counted inside distinct
chunks, weighted by the frequency.  An n-gram belongs to the chunk in which it
begins before the last ``OVERLAP`` tokens, so each occurrence counts once.
Piece borders are tokens of their own, and ``OVERLAP`` of them close a text.

Counting takes two steps over blocks of the dictionary.  A block first asks
for its distinct one- and two-word keys (hashed, packed; see ``keycounts``)
and is told which may reach ``min_count``.  It then gives out, as exact
strings with their weights, the words and pairs that may be frequent and the
longer n-grams all of whose pairs may be; Spark adds those up and drops what
stays below.  A collision of hashed keys only lets more strings through.  A
block travels as one compressed value, and it and its answers come as one
group, so a task holds one block at a time, however many its partition has;
tokens are made from slices of the block.

Defined results: null and empty texts hold nothing; a null language is
``und``; repeated rows all count; texts without words give no rows; texts of
any length are parsed whole; a language whose phrases all stay below
``min_count`` has no row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm import keycounts as kc
from veracity.llm.textblocks import chain, mix, slices, tokenize, utf8
from veracity.session import cut_lineage

LONGEST = 4
OVERLAP = LONGEST - 1
MODULUS = 32
BITS = 44  # width of the hashed keys, so that their differences pack into 32 bits
BLOCK_BYTES = 4 << 20  # text bytes per block: its tokens, keys and rows take up to 20 times that in a Python task
SLICE_BYTES = 1 << 20  # bytes of text handled at once, bounds the temporary arrays
# What ends a piece, and what parts words within one.
BORDERS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
_BORDER = np.uint64(0xA4093822299F31D0)


def byte_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String array of the given byte ranges."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), np.uint8)
    for lo, hi in kc.row_ranges(sizes, SLICE_BYTES):
        at = np.arange(offsets[lo], offsets[hi]) + np.repeat(starts[lo:hi] - offsets[lo:hi], sizes[lo:hi])
        out[offsets[lo]:offsets[hi]] = data[at]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def parse(column, modulus: int = MODULUS) -> tuple[np.ndarray, pa.Array]:
    """Document index and text of every chunk; tokens end with a blank, a border is a line feed."""
    data, _ = utf8(column)
    words = tokenize(column, BORDERS + BLANKS)
    if not len(words.starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    is_border = np.zeros(256, bool)
    is_border[list(BORDERS)] = True
    borders = np.concatenate([[0], np.cumsum(is_border[data])])
    counts, doc = words.counts, words.doc
    filled = np.flatnonzero(counts)
    heads = words.first[filled]
    parted = np.zeros(len(words.starts), np.int64)
    parted[1:] = borders[words.starts[1:]] > borders[words.ends[:-1]]
    parted[heads] = 0
    ordinal = np.cumsum(counts > 0) - 1
    place = np.arange(len(words.starts)) + np.cumsum(parted) + OVERLAP * ordinal[doc]
    begin = place[heads]
    n = int(place[-1]) + 1 + OVERLAP
    end = np.append(begin[1:], n)
    hashes = np.full(n, _BORDER, np.uint64)
    hashes[place] = words.hashes
    word = np.full(n, -1, np.int64)
    word[place] = np.arange(len(place))
    cut = np.zeros(n, bool)
    windows = chain(*(hashes[k:n - OVERLAP + 1 + k] for k in range(OVERLAP)), salt=OVERLAP)
    cut[:len(windows)] = windows % np.uint64(modulus) == 0
    for k in range(1, OVERLAP + 1):
        cut[end - k] = False
    cut[begin] = True
    first = np.flatnonzero(cut)
    owner = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) + OVERLAP, end[owner])
    sizes = last - first
    base = np.concatenate([[0], np.cumsum(sizes)])
    token = word[np.arange(int(base[-1])) + np.repeat(first - base[:-1], sizes)]
    real = np.flatnonzero(token >= 0)
    width = np.full(len(token), 2, np.int64)
    width[real] = (words.ends - words.starts)[token[real]] + 1
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.full(int(at[-1]), 32, np.uint8)
    out[at[:-1][token < 0]] = 10
    size = width[real] - 1
    inner = np.cumsum(size) - size
    run = np.arange(int(size.sum()))
    out[run + np.repeat(at[real] - inner, size)] = lower[run + np.repeat(words.starts[token[real]] - inner, size)]
    chunks = pa.Array.from_buffers(pa.large_string(), len(first), [
        None, pa.py_buffer(at[base].astype(np.int64)), pa.py_buffer(out)])
    return filled[owner], chunks


def dictionary(df: DataFrame, modulus: int = MODULUS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, chunk, freq``: the distinct chunks of every language and how often each is parsed."""
    read = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                doc, chunks = parse(batch.column(1).slice(lo, hi - lo), modulus)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)).cast(pa.string()), chunks.cast(pa.string())],
                    names=["lang", "chunk"])

    return read.mapInArrow(run, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count("*").alias("freq"))


def _pack(batches):
    """One row per block of about ``BLOCK_BYTES`` of chunks, compressed: Spark moves it as one value."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | number], pa.int64()), pa.array([size], pa.int64()),
             pa.array([body.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "body"])

    for batch in batches:
        for lo, hi in slices(batch.column(1), BLOCK_BYTES // 8):
            held.append(batch.slice(lo, hi - lo))
            size += len(utf8(held[-1].column(1))[0])
            if size >= BLOCK_BYTES:
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


class Grams(NamedTuple):
    """Tokens of a block of chunks, in narrow types."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    run: np.ndarray     # words that follow without a border, the token included
    own: np.ndarray     # whether this chunk counts the token, not the next one
    chunk: np.ndarray
    salts: np.ndarray   # hash of each chunk's language
    freqs: np.ndarray   # parse frequency of each chunk

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        return chain(self.salts[self.chunk[at]], *(self.hashes[at + k] for k in range(size)), salt=size)

    def weight(self, at: np.ndarray) -> np.ndarray:
        return np.where(self.own[at], self.freqs[self.chunk[at]], 0)


def block_grams(langs, chunks, freqs) -> Grams:
    data, offsets = utf8(chunks)
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    coded = langs.dictionary_encode()
    salts = mix(np.array([zlib.crc32(x.encode()) + 1 for x in coded.dictionary.to_pylist()], np.uint64))
    parts = []
    for lo, hi in slices(chunks, SLICE_BYTES):
        words = tokenize(chunks.slice(lo, hi - lo), BLANKS[:1])
        doc, counts = words.doc, words.counts
        place = np.arange(len(doc)) - words.first[doc]
        starts, ends = words.starts + offsets[lo], words.ends + offsets[lo]
        real = data[starts] != 10
        run = real.astype(np.int8)
        for _ in range(LONGEST - 1):  # a text closes with borders, so no run crosses into the next chunk of another text
            longer = np.zeros(len(run), np.int8)
            longer[:-1] = run[1:]
            longer[place == counts[doc] - 1] = 0
            run = np.where(real, 1 + np.minimum(longer, LONGEST - 1), 0).astype(np.int8)
        parts.append((starts.astype(narrow), ends.astype(narrow), words.hashes, run, place < counts[doc] - OVERLAP,
                      (doc + lo).astype(np.int32)))
    return Grams(data, *(np.concatenate(x) for x in zip(*parts, strict=True)),
                 salts[coded.indices.to_numpy()], freqs.to_numpy())


def _opened(rows, at: int) -> list[pa.Array]:
    """Languages, chunks and frequencies of the block in a row."""
    body = rows.column(rows.schema.get_field_index("body"))[at].as_buffer()
    return pa.ipc.open_stream(body).read_next_batch().columns


def _short_keys(g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of words and of pairs, and their hashed keys (words first)."""
    one = np.flatnonzero((g.run > 0) & g.own)
    two = np.flatnonzero(g.run > 1)
    keys = np.concatenate([g.keys(1, one), g.keys(2, two)])
    keys >>= np.uint64(64 - BITS)
    return one, two, keys


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and where in it each distinct key begins."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def _asked(g: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct short keys of a block and the block's own counts of them."""
    one, two, keys = _short_keys(g)
    order, heads = _distinct(keys)
    weight = np.concatenate([g.weight(one), g.weight(two)])[order]
    return keys[order[heads]], np.add.reduceat(weight, heads) if len(heads) else weight


def _frequent(g: Grams, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that may be frequent; for every token whether its pair may be."""
    one, two, keys = _short_keys(g)
    order, heads = _distinct(keys)
    may = np.empty(len(keys), bool)
    may[order] = np.repeat(kc.totals_of(told, 1)[0] > 0, np.diff(np.append(heads, len(keys))))
    pairs = np.zeros(len(g.run) + LONGEST, bool)
    pairs[two[may[len(one):]]] = True
    return one[may[:len(one)]], pairs


class _Reaches:
    """Totals as 1 where they reach a bound, else 0."""

    def __init__(self, least: int):
        self.least = least

    def reduceat(self, x, heads):
        return (np.add.reduceat(x, heads) >= self.least).astype(np.int64) if len(x) else x


def phrase_counts(chunks: DataFrame, min_count: int = 30) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of up to ``LONGEST`` words with ``f >= min_count``.

    One more row per language with size 0 holds the number of its word occurrences.
    """
    packed = cut_lineage(chunks.mapInArrow(_pack, "block long, n_bytes long, body binary"), "phrase-blocks")
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0]
    n_buckets = max(1, -(-(n_bytes or 0) // (5 * kc.BUCKET_KEYS)))

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, total = _asked(block_grams(*_opened(batch, row)))
                yield from kc.requests(batch.column(0)[row].as_py(), keys, [total], BITS, n_buckets).to_batches()

    told = kc.answer(packed.mapInArrow(ask, kc.request_schema(1)), 1, combine=_Reaches(min_count))

    def give(group):
        is_block = pc.is_valid(group.column("body"))
        langs, texts, freqs = _opened(group, pc.index(is_block, True).as_py())
        g = block_grams(langs, texts, freqs)
        words, pairs = _frequent(g, group.select(["bucket", "n", "t0"]).filter(pc.invert(is_block)))
        rows = [_rows(g, langs, words, 1)]
        own = np.flatnonzero(g.own)
        for size in range(2, LONGEST + 1):
            at = own[(g.run[own] >= size) & np.logical_and.reduce([pairs[own + k] for k in range(size - 1)])]
            rows.append(_rows(g, langs, at, size))
        n_words = np.bincount(g.chunk[(g.run > 0) & g.own], minlength=len(texts))
        total = pa.table({"lang": langs, "f": n_words * g.freqs}).group_by("lang").aggregate([("f", "sum")])
        rows.append(_batch(total.column("lang").combine_chunks(), pa.array([""] * total.num_rows, pa.string()), 0,
                           total.column("f_sum").to_numpy()))
        return pa.Table.from_batches(rows)

    found = (packed.drop("n_bytes").unionByName(told, allowMissingColumns=True)
             .groupBy("block").applyInArrow(give, "lang string, phrase string, size int, f long")
             .groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")))
    return found.where((F.col("f") >= min_count) | (F.col("size") == 0))


def _batch(langs, phrases, size, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases.cast(pa.string()),
                                       pa.array(np.full(len(f), size), pa.int32()), pa.array(f, pa.int64())],
                                      names=["lang", "phrase", "size", "f"])


def _rows(g: Grams, langs, at: np.ndarray, size: int) -> pa.RecordBatch:
    """Distinct phrases of ``size`` words that begin at the given tokens, with their weights."""
    order, heads = _distinct(g.keys(size, at))
    weight = g.weight(at)[order]
    f = np.add.reduceat(weight, heads) if len(heads) else weight
    at = at[order[heads]]
    return _batch(langs.take(pa.array(g.chunk[at])), byte_ranges(g.data, g.starts[at], g.ends[at + size - 1]), size, f)


def mine_collocations(df: DataFrame, min_count: int = 30, top: int = 2000, cover_pct: int = 80,
                      scale: int = 2_000_000, modulus: int = MODULUS, text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score, first_words``.

    A phrase is cut after its first ``first_words`` words, where the score
    floor(scale * a / (l + r)) is least; phrases that a longer one covers in
    ``cover_pct`` percent of their occurrences are left out.
    """
    counts = cut_lineage(phrase_counts(dictionary(df, modulus, text_col, lang_col), min_count), "phrase-counts")
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"),
                                              F.split("phrase", " ").alias("w"))
    cuts = (phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
            .withColumn("left_part", F.expr("array_join(slice(w, 1, k), ' ')"))
            .withColumn("right_part", F.expr("array_join(slice(w, k + 1, size - k), ' ')")))
    for side, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("part_f").alias(name)), ["lang", side])
    scored = (cuts.withColumn("score", F.expr(
        f"cast({scale} as decimal(12,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    inner = (phrases.where("size > 2").select("lang", "w", "size", F.col("a").alias("longer"),
                                              F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
             .select("lang", "longer", F.explode(F.expr(
                 "transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.expr(f"longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {cover_pct}")))
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.select("lang", "phrase", "a", "best.*").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top).join(n, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                    F.col("k").cast("long").alias("first_words")))
