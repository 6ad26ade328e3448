"""Hard negatives of anchor rows, by spanning-tree bounds.

Rows are packed into blocks of ``ROWS``, anchors into blocks of ``ANCHORS``;
every anchor block meets every row block once per phase.  In an anchor block
the anchors of one label are joined by a minimum spanning tree.  The root's
scores are computed for all rows of the block; a child's score of a row lies
within its parent's score plus or minus the edge length times the row's norm,
intervals widen along the tree, and only rows whose interval can reach the
wanted window are scored again, exactly.

Phase one wants each anchor's first ``positives`` rows of its label, phase two
the first ``top`` rows of other labels in the window that each positive's
score opens.  A block gives out its own best rows, Spark ranks them.

The bounds prune where edges are short against the norms (near anchors,
repeated vectors); where they are not, every row is scored, and the result is
the same.

Defined results: rows with a null label, a null vector or a null or
non-finite component (times ``scale``) take no part; rows that agree in id,
label and vector are one row; rows that share only the id are separate; a null
id is no anchor and comes last among ties; vectors of unlike length count as
padded with zeros; scores past 64 bits count as the nearest 64-bit number; an
anchor without rows of its label has no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.session import cut_lineage

ROWS = 16384
ANCHORS = 1024
_SLACK = 1e-9  # relative widening of bounds that are computed in floating point
_TOP = np.iinfo(np.int64)


def pack_matrix(vectors: list) -> tuple[int, bytes]:
    """Number of columns and bytes of a matrix, shorter vectors padded with zeros."""
    wide = max((len(v) for v in vectors), default=0)
    m = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        m[i, :len(v)] = v
    return wide, m.astype(np.int32).tobytes() if not m.size or np.abs(m).max() < 2**31 else m.tobytes()


def unpack_matrix(n: int, wide: int, data: bytes) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * n * wide else np.float64
    return np.frombuffer(data, kind).reshape(n, wide).astype(np.float64)


def inner_products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered vectors, as 64-bit numbers."""
    wide = min(rows.shape[1], len(anchor))
    rows, anchor = rows[:, :wide], anchor[:wide]
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(anchor).max()) * wide < 2**53:
        return (rows @ anchor).astype(np.int64)
    other = [int(x) for x in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(r, other, strict=True)), int(_TOP.min)), int(_TOP.max))
                     for r in rows.tolist()], np.int64)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean norms, without overflow on the way."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
    return np.where(np.isfinite(most), scale * np.sqrt(((rows / scale[:, None]) ** 2).sum(axis=1)), most)


def spanning_tree(points: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Minimum spanning tree by nearest insertion: order, parent's place in it, edge lengths."""
    order, parent, edge = [0], [-1], [0.0]
    n = len(points)
    distance, source = np.full(n, np.inf), np.zeros(n, np.int64)
    free = np.ones(n, bool)
    free[0] = False
    for k in range(1, n):
        near = lengths(points - points[order[-1]])
        closer = near < distance
        distance[closer], source[closer] = near[closer], k - 1
        nxt = int(np.argmin(np.where(free, distance, np.inf)))
        free[nxt] = False
        order.append(nxt)
        parent.append(int(source[nxt]))
        edge.append(float(distance[nxt]))
    return order, parent, edge


def first_rows(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first rows by score descending, then id."""
    at = np.arange(len(score))
    if len(score) > most:
        at = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return at[np.lexsort((ids[at], ~score[at]))][:most]


class Tree:
    """Scores of a row block along the tree of one label's anchors."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, rows: np.ndarray):
        self.anchors, self.parent, self.edge, self.rows = anchors, parent, edge, rows
        self.norms = lengths(rows) * (1 + _SLACK)
        self.rescored = 0

    def walk(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places, exact scores) of all rows that ``wanted(anchor, low, high)`` marks."""
        last_child = {int(p): k for k, p in enumerate(self.parent)}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, p in enumerate(self.parent.tolist()):
            if p < 0:
                low = high = None
                need = np.ones(len(self.rows), bool)
            else:
                with np.errstate(over="ignore"):  # an infinite bound is a bound
                    slack = np.where(self.norms > 0, self.edge[k] * (1 + _SLACK), 0.0) * self.norms + 1
                low, high = held[p][0] - slack, held[p][1] + slack
                need = wanted(k, low, high)
                if last_child[p] == k:
                    del held[p]
            at = np.flatnonzero(need)
            exact = (inner_products(self.rows, self.anchors[k])[at] if 2 * len(at) > len(self.rows)
                     else inner_products(self.rows[at], self.anchors[k]))
            self.rescored += len(at)
            if k in last_child:
                if low is None:
                    low, high = np.empty(len(self.rows)), np.empty(len(self.rows))
                low[at] = exact - np.abs(exact) * _SLACK
                high[at] = exact + np.abs(exact) * _SLACK
                held[k] = low, high
            yield k, at, exact


def kth_largest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def _build(table: pa.Table) -> pa.Table:
    """Pack rows of a block, sorted by label and id."""
    table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    wide, data = pack_matrix(table.column("vector").to_pylist())
    return pa.table({"n": pa.array([table.num_rows], pa.int32()), "wide": pa.array([wide], pa.int32()),
                     "data": pa.array([data], pa.binary())}
                    | {c: _single(table.column(c)) for c in ("vec_id", "label", "uid") if c in table.column_names})


def _single(column) -> pa.Array:
    column = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def pack_rows(rows: DataFrame, n_blocks: int) -> DataFrame:
    """``block, n, wide, data, vec_id, label``: blocks of about ``ROWS`` rows."""
    def run(key, table):
        return _build(table).append_column("block", pa.array([key[0].as_py()], pa.int64()))

    return (rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(n_blocks))).groupBy("block")
            .applyInArrow(run, "n int, wide int, data binary, vec_id array<long>, label array<long>, block long"))


def pack_anchors(blocks: DataFrame, every: int, n_blocks: int) -> DataFrame:
    """Anchor blocks in tree order; ``uid`` tells an anchor's row block and place there."""
    def pick(batches):
        for batch in batches:
            for b in batch.to_pylist():
                m = unpack_matrix(b["n"], b["wide"], b["data"])
                at = [i for i, v in enumerate(b["vec_id"]) if v is not None and v % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b[c][i] for i in at], pa.int64()) for c in ("vec_id", "label")]
                    + [pa.array([b["block"] << 32 | i for i in at], pa.int64()),
                       pa.array([m[i].tolist() for i in at], pa.list_(pa.float64()))],
                    names=["vec_id", "label", "uid", "vector"])

    def run(key, table):
        built = _build(table).to_pylist()[0]
        points, label = unpack_matrix(built["n"], built["wide"], built["data"]), np.array(built["label"])
        places, parent, edge = [], [], []
        for value in np.unique(label):
            own = np.flatnonzero(label == value)
            order, up, length = spanning_tree(points[own])
            parent += [p + len(places) if p >= 0 else -1 for p in up]
            places += own[order].tolist()
            edge += length
        wide, data = pack_matrix(list(points[places]))
        return pa.table({"ablock": pa.array([key[0].as_py()], pa.int64()), "a_n": pa.array([len(places)], pa.int32()),
                         "a_wide": pa.array([wide], pa.int32()), "a_data": pa.array([data], pa.binary())}
                        | {f"a_{c}": pa.array([[built[c][i] for i in places]], pa.list_(pa.int64()))
                           for c in ("vec_id", "label", "uid")}
                        | {"a_parent": pa.array([parent], pa.list_(pa.int64())), "a_edge": pa.array([edge], pa.list_(pa.float64()))})

    picked = blocks.mapInArrow(pick, "vec_id long, label long, uid long, vector array<double>")
    return (picked.withColumn("ablock", F.pmod(F.xxhash64("uid"), F.lit(n_blocks))).groupBy("ablock")
            .applyInArrow(run, "ablock long, a_n int, a_wide int, a_data binary, a_vec_id array<long>, a_label array<long>, "
                               "a_uid array<long>, a_parent array<long>, a_edge array<double>"))


def _trees(pair: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Tree]]:
    """Per label: the anchors' places, the rows' places and order keys, and the tree."""
    rows = unpack_matrix(pair["n"], pair["wide"], pair["data"])
    ids = np.array([_TOP.max if v is None else v for v in pair["vec_id"]], np.int64)
    labels, label = np.array(pair["label"]), np.array(pair["a_label"])
    anchors = unpack_matrix(pair["a_n"], pair["a_wide"], pair["a_data"])
    parent, edge = np.array(pair["a_parent"]), np.array(pair["a_edge"])
    for value in np.unique(label):
        own = np.flatnonzero(label == value)
        at = np.flatnonzero((labels == value) == same)
        if len(at):
            up = parent[own]
            yield own, at, ids[at], Tree(anchors[own], np.where(up >= 0, up - own[0], -1), edge[own], rows[at])


def _best_positives(pair: dict, most: int) -> Iterator[tuple]:
    for own, at, ids, tree in _trees(pair, True):
        uid = np.array(pair["a_uid"])[own]
        self_at = [np.flatnonzero(at == (u & 0xFFFFFFFF)) if u >> 32 == pair["block"] else at[:0] for u in uid.tolist()]

        def wanted(k, low, high, self_at=self_at):
            others = np.ones(len(low), bool)
            others[self_at[k]] = False
            return high >= kth_largest(low[others], most)

        for k, place, score in tree.walk(wanted):
            other = ~np.isin(place, self_at[k])
            place, score = place[other], score[other]
            for i in first_rows(score, ids[place], most).tolist():
                row = int(at[place[i]])
                yield pair["ablock"], int(own[k]), pair["vec_id"][row], int(score[i]), pair["block"] << 32 | row


def _best_negatives(pair: dict, most: int, low_pct: int, high_pct: int) -> Iterator[tuple]:
    opened: dict[int, list] = {}
    for p in pair["windows"]:
        opened.setdefault(p["anchor"], []).append(
            (p["rank"], p["vec_id"], p["score"], -(-low_pct * p["score"] // 100), high_pct * p["score"] // 100))
    for own, at, ids, tree in _trees(pair, False):
        windows = [sorted(opened.get(a, ())) for a in own.tolist()]

        def wanted(k, low, high, windows=windows):
            need = np.zeros(len(low), bool)
            for _, _, _, bottom, top in windows[k]:
                sure = low[(low >= bottom) & (high <= top)]
                need |= (high >= max(bottom, kth_largest(sure, most))) & (low <= top)
            return need

        for k, place, score in tree.walk(wanted):
            for rank, positive, p_score, bottom, top in windows[k]:
                inside = np.flatnonzero((score >= bottom) & (score <= top))
                for i in inside[first_rows(score[inside], ids[place[inside]], most)].tolist():
                    row = int(at[place[i]])
                    yield (pair["ablock"], int(own[k]), pair["a_vec_id"][int(own[k])], rank, positive, p_score,
                           pair["vec_id"][row], int(score[i]), pair["block"] << 32 | row)


def _meet(anchors: DataFrame, blocks: DataFrame, n_blocks: int, best, schema: str) -> DataFrame:
    """``best`` of every pair of an anchor block and a row block."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(best(batch.slice(row, 1).to_pylist()[0]))
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    pairs = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return pairs.join(blocks, "block").mapInArrow(run, schema)


def mine_hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, top: int = 10, low_pct: int = 30,
                        high_pct: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors (id divisible by ``every``).

    The rows of other labels whose score lies between ``low_pct`` and
    ``high_pct`` percent of the positive's, best first.
    """
    scaled = f"{scale} * cast(x as double)"
    usable = F.expr(f"forall(`{vector_col}`, x -> x is not null and abs({scaled}) < double('infinity'))")
    floor = f"case when abs({scaled}) < 4503599627370496D then cast(floor({scaled}) as double) else {scaled} end"
    rows = (df.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.expr(f"transform(`{vector_col}`, x -> {floor})").alias("vector")))
    n, n_anchors = rows.agg(F.count("*"), F.count_if(F.expr(f"vec_id % {every} = 0"))).first()
    n_blocks = max(1, -(-n // ROWS))
    blocks = cut_lineage(pack_rows(rows.dropDuplicates(["vec_id", "label", "vector"]), n_blocks), "negative-rows")
    anchors = cut_lineage(pack_anchors(blocks, every, max(1, -(-n_anchors // ANCHORS))), "negative-anchors")

    near = _meet(anchors, blocks, n_blocks, lambda pair: _best_positives(pair, positives),
                 "ablock long, anchor int, vec_id long, score long, uid long")
    order = Window.partitionBy("ablock", "anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    windows = (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
               .groupBy("ablock").agg(F.collect_list(F.struct("anchor", "rank", "vec_id", "score")).alias("windows")))
    opened = cut_lineage(anchors.join(windows, "ablock"), "negative-windows")
    far = _meet(opened, blocks, n_blocks, lambda pair: _best_negatives(pair, top, low_pct, high_pct),
                "ablock long, anchor int, anchor_id long, positive_rank int, positive_id long, positive_score long, "
                "negative_id long, negative_score long, uid long")
    order = (Window.partitionBy("ablock", "anchor", "positive_rank")
             .orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "uid"))
    return (far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
