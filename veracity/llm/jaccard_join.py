"""Groups of near-duplicate documents by an n-gram Jaccard join.

Documents are sets of distinct 5-word shingles; two link when the Jaccard
similarity is at least 80 %.  Prefix filtering under several global token
orders finds candidates: rare tokens come first in every order, and each order
breaks the (many) ties in its own way.  Two linked sets share a token in
their prefixes under *every* order, so candidate sets are intersected before
any pair is verified on its whole token sets.

Work is kept linear where sets repeat:

* equal sets are one class (fingerprint of the set), expanded only at the end;
* a token in one class only never makes a posting, and a class whose prefix
  holds no shared token can link with nothing and drops out;
* round 1, once per order, compares each class with one class drawn for each
  of its prefix tokens (a star per token, as many pairs as postings at most);
  the links are joined into components after the first and the last order;
* round 2 compares all remaining pairs *across* components that pass the
  prefix, length and position filters under all orders.  A pair inside one
  component can change nothing and is not made.

Defined results: a null or empty text has no shingles, is its own component
and links with nothing; with fewer words than a shingle the whole sequence is
one shingle; repeated rows stay separate rows of one component; a null
``doc_id`` never names a component unless all its members are null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm import keycounts as kc
from veracity.llm.textblocks import mix, shingles, slices, tokenize
from veracity.session import cut_lineage

ORDERS = 3
HUBS = (1, 8, 8)  # classes drawn per group of classes that share tokens, by round
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def distinct_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, one after another, and where each text starts."""
    found, first = shingles(tokenize(column), n)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(sizes) + 1))


def fingerprints(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128-bit order-free fingerprint of each set."""
    sums = []
    for seed in (np.uint64(0x51), np.uint64(0xA7)):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ mix(np.array([seed]))[0]))])
        sums.append(mix((run[first[1:]] - run[first[:-1]]) + np.diff(first).astype(np.uint64)))
    return [r.tobytes() for r in np.stack(sums, axis=1)]


def least_overlap(a, b, pct: int):
    """Smallest intersection of sets of sizes ``a`` and ``b`` that link."""
    return -((-pct * (a + b)) // (100 + pct))


def prefix_length(n, pct: int):
    """Tokens of a set of size ``n`` of which a linked set must share one."""
    return n + (-pct * n) // 100 + 1


def _docs(df: DataFrame, n_blocks: int, id_col: str, text_col: str) -> DataFrame:
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.withColumn("text_hash", F.xxhash64("text")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_blocks)))


def classify(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, block, n_shingles, class`` (null class: empty set) for every document."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                sets, first = distinct_sets(batch.column("text").slice(lo, hi - lo), shingle)
                n = np.diff(first)
                names = fingerprints(sets, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("block").slice(lo, hi - lo),
                     batch.column("text_hash").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([x if k else None for x, k in zip(names, n.tolist(), strict=True)],
                                                       pa.binary())],
                    names=["doc_id", "block", "text_hash", "n_shingles", "class"])

    return docs.mapInArrow(run, "doc_id long, block long, text_hash long, n_shingles long, class binary")


def active_classes(docs: DataFrame, members: DataFrame, total_bytes: int, shingle: int, pct: int) -> DataFrame:
    """Classes that can link: ``class, n, tokens``, and per order the shared prefix tokens and their places."""
    heads = members.where("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "block")).alias("first"))
    heads = heads.groupBy(F.col("first.block").alias("block")).agg(F.collect_list("class").alias("classes"))
    bits = min(64, max(48, int(total_bytes).bit_length() + 18))
    n_buckets = max(1, -(-total_bytes // (6 * kc.BUCKET_KEYS)))

    def heads_of(table, chosen):
        """Token sets of the block's class representatives, each class once."""
        names = chosen.column("classes").to_pylist()
        wanted = set(names[0]) if names else set()
        column = table.column("text").combine_chunks()
        for lo, hi in slices(column):
            sets, first = distinct_sets(column.slice(lo, hi - lo), shingle)
            for d, name in enumerate(fingerprints(sets, first)):
                if name in wanted:
                    wanted.discard(name)
                    yield name, sets[first[d]:first[d + 1]]

    def ask(key, table, chosen):
        found = [s for _, s in heads_of(table, chosen)]
        keys = np.concatenate(found) >> np.uint64(64 - bits) if found else np.zeros(0, np.uint64)
        own, n = np.unique(keys, return_counts=True)
        return kc.requests(key[0].as_py(), own, [np.minimum(n, 255)], bits, n_buckets)

    by_block = docs.select("block", "text").groupBy("block")
    asked = by_block.cogroup(heads.groupBy("block")).applyInArrow(ask, kc.request_schema(1))
    # Frequencies only order tokens and tell one class from several: 255 stands for all above.
    answers = kc.answer(asked, 1)
    sides = answers.select("block", "bucket", "n", "t0", F.lit(None).cast("array<binary>").alias("classes")).unionByName(
        heads.select("block", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("n"),
                     F.lit(None).cast("binary").alias("t0"), "classes"))

    def choose(table, side):
        is_reply = np.asarray(side.column("n").is_valid())
        reply, chosen = side.filter(pa.array(is_reply)), side.filter(pa.array(~is_reply))
        found = list(heads_of(table, chosen))
        out = {k: [] for k in ("class", "n", "tokens", "prefix", "place")}
        if found:
            frequency = np.minimum(kc.totals_of(reply, 1)[0], 255)
            keys = np.concatenate([s for _, s in found]) >> np.uint64(64 - bits)
            _, inverse = np.unique(keys, return_inverse=True)
            df_all = frequency[inverse]
            at = 0
            for name, tokens in found:
                n = len(tokens)
                df = df_all[at:at + n]
                at += n
                reach = prefix_length(n, pct)
                if (df == 1).sum() >= reach:
                    continue  # its prefix holds no shared token, under any order
                prefixes, places = [], []
                for seed in _SEEDS[:ORDERS]:
                    order = np.lexsort((mix(tokens ^ seed), df))[:reach]
                    shared = np.flatnonzero(df[order] > 1)
                    prefixes.append(tokens[order[shared]].view(np.int64))
                    places.append(shared.astype(np.int32))
                out["class"].append(name)
                out["n"].append(n)
                out["tokens"].append(tokens[df > 1].tobytes())  # the others are in no intersection
                out["prefix"].append([p.tolist() for p in prefixes])
                out["place"].append([p.tolist() for p in places])
        return pa.table([pa.array(out["class"], pa.binary()), pa.array(out["n"], pa.int64()),
                         pa.array(out["tokens"], pa.binary()),
                         pa.array(out["prefix"], pa.list_(pa.list_(pa.int64()))),
                         pa.array(out["place"], pa.list_(pa.list_(pa.int32())))],
                        names=["class", "n", "tokens", "prefix", "place"])

    return by_block.cogroup(sides.groupBy("block")).applyInArrow(
        choose, "class binary, n long, tokens binary, prefix array<array<long>>, place array<array<int>>")


def verify(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs ``a, b`` of classes that link.

    A pair must share a prefix token under every order; only then are its
    token sets intersected.  The sets of ``a`` and ``b`` meet in plain joins,
    which Spark splits if one class is in many pairs.
    """
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("prefix").alias("pa"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("prefix").alias("pb"))
    shared = [F.arrays_overlap(F.col("pa")[k], F.col("pb")[k]) for k in range(ORDERS)]

    def run(batches):
        for batch in batches:
            a, b = batch.column("ta"), batch.column("tb")
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), np.uint64)
                y = np.frombuffer(b[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= pct * (na[i] + nb[i] - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    candidates = pairs.join(left, "a").join(right, "b").where(shared[0]).where(shared[1]).where(shared[2])
    return candidates.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``class, comp``: smallest class reachable from each class in a link.

    Alternating large-star and small-star steps; each step is one shuffle per
    edge and the number of steps is logarithmic in a component's diameter.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges, "jaccard-links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small, "jaccard-links")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")),
                                              F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        # Done when every edge leads from a leaf of one edge to a root that is no leaf: a further step changes nothing.
        inner = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and n > 1")
        if inner.agg(F.count("*")).first()[0] == 0:
            break
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("class"), "comp")


def _with_component(frame: DataFrame, comps: DataFrame) -> DataFrame:
    joined = frame.join(comps, "class", "left")
    return joined.withColumn("comp", F.coalesce("comp", "class"))


def _postings(active: DataFrame, order: int) -> DataFrame:
    """One row per class and shared prefix token under one order."""
    return active.select("class", "n", F.explode(F.arrays_zip(
        F.col("prefix")[order].alias("token"), F.col("place")[order].alias("place"))).alias("p")).select(
        "class", "n", "p.token", "p.place")


def _fits(na: Column, pa_: Column, nb: Column, pb: Column, pct: int) -> Column:
    """Length and position filters: what the two sets still have from the shared token on must suffice."""
    need = F.ceil((na + nb) * pct / (100 + pct))
    return (na * 100 >= nb * pct) & (nb * 100 >= na * pct) & (F.least(na - pa_, nb - pb) >= need)


def _enough(order: int, pct: int) -> Column:
    """The prefixes share so much under one order that the whole sets may link.

    The set whose prefix ends first in the global order can share no more
    than its prefix shares plus all its tokens behind the prefix.
    """
    xn, yn = F.col("x.n"), F.col("y.n")
    behind = [F.ceil(n * pct / 100) - 1 for n in (xn, yn)]
    need = F.ceil((xn + yn) * pct / (100 + pct))
    return F.size(F.array_intersect(F.col("x.prefix")[order], F.col("y.prefix")[order])) + F.greatest(*behind) >= need


def _open(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Postings of the tokens whose classes are in several components, with their component."""
    if comps is None:
        return postings.withColumn("comp", F.col("class"))
    named = _with_component(postings, comps)
    # A token whose classes are in one component already has no pair left.
    several = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return named.join(several, "token")


def link_classes(active: DataFrame, pct: int) -> DataFrame:
    """``class, comp`` of all linked classes (see the module's notes on the two rounds)."""
    if active.isEmpty():
        return active.select("class", F.col("class").alias("comp"))
    sets = active.select("class", "n", "tokens", "prefix")
    links = comps = None
    for k in range(ORDERS):
        stars = _open(_postings(active, k), comps)
        hubs = stars.groupBy("token").agg(F.min(F.struct(
            F.xxhash64("class", F.pmod("token", F.lit(HUBS[k])), F.lit(k)).alias("draw"), "class", "n", "place", "comp")).alias("hub"))
        pairs = stars.join(hubs, "token").where(F.col("hub.comp") != F.col("comp")).where(_fits(
            F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), pct)).select(
            F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()
        found = verify(pairs, sets, pct)
        links = cut_lineage(found if links is None else links.unionByName(found), "jaccard-stars")
        if k in (0, ORDERS - 1):  # the first stars join most classes; the later ones all look across those components
            comps = components(links)
    rest = cut_lineage(_open(_postings(active, 0), comps).join(active.select("class", "prefix"), "class"), "jaccard-open")
    x, y = rest.alias("x"), rest.alias("y")
    # Prefixes are in the global order: a pair is made once, at its first shared token.
    once = F.get(F.array_intersect(F.col("x.prefix")[0], F.col("y.prefix")[0]), F.lit(0)) == F.col("x.token")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") < F.col("y.class"))
                    & (F.col("x.comp") != F.col("y.comp"))
                    & _fits(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), pct) & once
                    & reduce(and_, [_enough(k, pct) for k in range(ORDERS)])).select(
        F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    more = cut_lineage(verify(across, sets, pct), "jaccard-across")
    if more.isEmpty():
        return comps
    return components(links.unionByName(more))


def _grouped(df: DataFrame, shingle: int, pct: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class, comp`` of every row (null: empty set)."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    docs = _docs(df, kc.blocks_for(total), id_col, text_col)
    members = cut_lineage(classify(docs, shingle), "jaccard-classes")
    active = cut_lineage(active_classes(docs, members, total, shingle, pct), "jaccard-active")
    return _with_component(members, link_classes(active, pct))


def near_duplicates(df: DataFrame, shingle: int = 5, pct: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``df``."""
    rows = cut_lineage(_grouped(df, shingle, pct, id_col, text_col), "jaccard-groups")
    # Ids are pre-aggregated per component, so a group of any size stays small.
    ids = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, shingle: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id, a null id last.

    Documents without shingles (null, empty, blank) are all kept, repeated or
    not, whatever else the table holds.  Of rows that repeat id and text of a
    group's document, the one with the smallest hash of all its columns stays.
    All columns are kept, whatever their names; an empty table stays empty.
    """
    rows = cut_lineage(_grouped(df, shingle, pct, id_col, text_col), "jaccard-groups")
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
    copies = rows.groupBy("comp", named.alias("f")).agg(F.count("*").alias("n"))
    first = copies.where("comp is not null").groupBy("comp").agg(F.min(F.struct("f", "n")).alias("x")).select("x.f", (F.col("x.n") > 1).alias("many"))
    empty = copies.where("comp is null").select("f", F.lit(False).alias("many"))
    keep = cut_lineage(first.unionByName(empty).select(
        F.col("f.id").alias("keep_id"), F.col("f.th").alias("keep_hash"), "many"), "jaccard-kept")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.col(id_col).cast("long").alias("row_id"),
                     F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"))

    def of(kept: DataFrame) -> DataFrame:
        return held.join(kept, F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash")), "left_semi")

    out = of(keep.where("not many")).select("row.*")
    again = keep.where("many")
    if again.isEmpty():
        return out
    one = of(again).groupBy("row_id", "row_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row.*"))
