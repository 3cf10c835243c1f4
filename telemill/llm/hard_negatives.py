"""Hard negatives for anchors, with score bounds along spanning trees of anchors.

For each anchor: its `n_positives` rows of the same label with the highest
inner products, and for each of these the first `n_negatives` rows of other
labels whose score lies between `low` and `high` hundredths of the positive's.

1. Rows become packets: integer matrices of up to `PACKET` vectors.
2. Anchors are ordered by the signs of random projections, cut into groups of
   up to `GROUP` neighbours, and each group gets a minimum spanning tree by
   Euclidean distance. One row a group.
3. All anchors against all rows is a grid: cells of row packets by cells of
   groups. A cell gets its groups first and then its packets as a stream, so
   a task holds one cell's groups (bounded) and one block of rows. The
   root of a tree is scored against a whole block. Below it a child's score
   lies within (parent's score or bounds) -+ (edge distance * norm of the row), and
   only rows whose bounds overlap the child's window are scored again. The
   window starts at the worst score that would still be kept.
4. The grid runs twice: for positives, and with their scores as windows for
   negatives. A cell gives at most the wanted number of rows for each anchor (and
   positive); what the cells give is ranked by a shuffle on the anchor.

Defined cases: rows without id or label, with a null vector or with a null or
non-finite component take no part; repeated rows count once; other rows are
rows of another id; shorter vectors count as filled up with zeros; ties go to
the smaller id; anchors without positives and positives without negatives give
no rows; scores beyond 64 bits become the nearest 64-bit value; other columns
take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, written

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Vectors in a packet, anchors in a tree, anchors in a cell, rows in a cell, rows worked on at once.
PACKET, GROUP, CELL_ANCHORS, CELL_ROWS, BLOCK = 256, 256, 16_384, 100_000, 4096
#: Bits of the projection code that orders anchors.
CODE_BITS = 16

PACKETS = "ids array<bigint>, labels array<int>, dims int, width int, data binary"
ANCHORS = "code long, id long, label int, data binary"
TREES = "tree long, ids array<bigint>, labels array<int>, parents array<int>, edges array<double>, dims int, data binary"
FOUND = "tree long, node int, place int, id long, score long"
_I64 = np.iinfo(np.int64)


def _list(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of whole numbers, filled up with zeros."""
    n = len(column)
    length = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((n, int(length.max()) if n else 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def packets(rows: DataFrame) -> DataFrame:
    """rows: (id, label, vector of whole numbers)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PACKET):
                part = b.slice(at, PACKET)
                x = matrix(part.column(2))
                most = max(-int(x.min()), int(x.max())) if x.size else 0
                width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1) or w == 8)
                yield pa.RecordBatch.from_arrays([
                    _list(part.column(0).to_pylist(), pa.int64()), _list(part.column(1).to_pylist(), pa.int32()),
                    pa.array([x.shape[1]], pa.int32()), pa.array([width], pa.int32()),
                    pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], ["ids", "labels", "dims", "width", "data"])

    return map_batches(rows, run, PACKETS)


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(n, -1)


def anchors_of(packed: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by `every`, with a code that neighbours tend to share."""
    def run(batches):
        for b in batches:
            for ids, labels, width, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                at = [k for k, i in enumerate(ids) if i % every == 0]
                if not at:
                    continue
                x = _unpack(data, width, len(ids))[at]
                planes = np.random.default_rng(16).standard_normal((CODE_BITS, x.shape[1]))
                code = ((x @ planes.T) > 0) @ (1 << np.arange(CODE_BITS)[::-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(code, pa.int64()), pa.array([ids[k] for k in at], pa.int64()),
                    pa.array([labels[k] for k in at], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["code", "id", "label", "data"])

    return map_batches(packed, run, ANCHORS)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edges) of a minimum spanning tree; parents are places in the order, the root's is -1."""
    x = x.astype(np.float64)
    n = len(x)
    square = (x * x).sum(axis=1)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    near, by = np.full(n, np.inf), np.zeros(n, int)
    out = np.ones(n, bool)
    now = int(square.argmin())
    for k in range(n):
        if k:
            now = int(np.where(out, near, np.inf).argmin())
            parent[k], edge[k] = by[now], near[now]
        order[k], out[now] = now, False
        d = np.sqrt(((x - x[now]) ** 2).sum(axis=1))
        closer = d < near
        near[closer], by[closer] = d[closer], k
    return order, parent, edge


def trees(anchors: DataFrame, n: int, cell_anchors: int = CELL_ANCHORS, group: int = GROUP) -> tuple[DataFrame, int]:
    """(one row a group, number of cells); a tree's cell is tree >> 32. anchors: a written table of n rows."""
    cells = max(1, -(-n // cell_anchors))

    def run(batches):
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made(rows):
            dims = max(len(r[2]) for r in rows) // 8
            x = np.zeros((len(rows), dims), "<i8")
            for k, r in enumerate(rows):
                x[k, :len(r[2]) // 8] = np.frombuffer(r[2], "<i8")
            order, parent, edge = spanning_tree(x)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), _list([rows[k][0] for k in order], pa.int64()),
                _list([rows[k][1] for k in order], pa.int32()), _list(parent.tolist(), pa.int32()),
                _list(edge.tolist(), pa.float64()), pa.array([dims], pa.int32()), pa.array([x[order].tobytes()], pa.binary())],
                ["tree", "ids", "labels", "parents", "edges", "dims", "data"])

        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            while len(held) >= group:
                yield made(held[:group])
                held, number = held[group:], number + 1
        if held:
            yield made(held)

    ordered = anchors.repartitionByRange(cells, "code", "id", "label", "data").sortWithinPartitions("code", "id", "label", "data")
    return map_batches(ordered, run, TREES), cells


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with a vector; beyond 64 bits the nearest value."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, len(v))
    if most < 2.0 ** 53:
        return (x.astype(np.float64) @ v.astype(np.float64)).astype(np.int64)
    big = x.astype(object) @ v.astype(object)
    return np.array([min(max(int(s), _I64.min), _I64.max) for s in big], np.int64)


class Tree:
    """A group of anchors with what has been found for each of them in this cell."""

    def __init__(self, tree, ids, labels, parents, edges, dims, data, wanted):
        self.tree, self.ids, self.labels, self.parents, self.edges = tree, ids, labels, parents, edges
        self.x = np.frombuffer(data, "<i8").reshape(len(ids), dims)
        self.exact = bool(float(np.abs(self.x).max(initial=0)) * 2.0 ** 15 * max(1, dims) < 2.0 ** 53)
        self.scored = 0
        #: For each anchor a list of [least score, greatest score, number wanted, best (score, id)].
        self.wanted = wanted

    def window(self, node: int) -> tuple[float, float] | None:
        """Scores that may still be kept for some of the anchor's lists."""
        live = [(max(lo, best[-1][0]) if len(best) == n else lo, hi) for lo, hi, n, best in self.wanted[node]]
        live = [(lo, hi) for lo, hi in live if lo <= hi]
        return (min(lo for lo, _ in live), max(hi for _, hi in live)) if live else None

    def keep(self, node: int, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        for entry in self.wanted[node]:
            lo, hi, n, best = entry
            a = int(np.searchsorted(-score, -hi)) if hi < _I64.max else 0
            new = [(int(s), int(i)) for s, i in zip(score[a:a + n], ids[a:a + n], strict=True) if s >= lo]
            if new:
                entry[3] = sorted(best + new, key=lambda r: (-r[0], r[1]))[:n]

    def block(self, x: np.ndarray, floats: np.ndarray | None, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray,
              same: bool) -> None:
        """Rows x against all anchors of the tree; floats: x as doubles if products in doubles are exact."""
        dims = self.x.shape[1]
        if x.shape[1] != dims:
            width = max(x.shape[1], dims)
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            floats = None if floats is None else x.astype(np.float64)
            anchors = np.pad(self.x, ((0, 0), (0, width - dims)))
        else:
            anchors = self.x
        by_double = floats is not None and self.exact
        points = anchors.astype(np.float64) if by_double else anchors
        bounds: list = []
        for node, (parent, edge) in enumerate(zip(self.parents, self.edges, strict=True)):
            fits = (labels == self.labels[node]) == same
            fits &= ids != self.ids[node]
            window = self.window(node)
            if parent < 0:
                at = np.arange(len(ids))
            else:
                low, high = bounds[parent]
                slack = norms * (edge * (1 + 1e-9)) + 1e-3
                low, high = low - slack, high + slack
                at = np.flatnonzero(fits & (high >= window[0]) & (low <= window[1])) if window else np.zeros(0, int)
            if by_double:
                score = (floats @ points[node]) if parent < 0 else floats[at] @ points[node]
            else:
                score = products(x[at], points[node])
            self.scored += len(at)
            exact = score.astype(np.int64)
            if parent < 0:
                low, high = score.astype(np.float64), score.astype(np.float64)
            else:
                low[at], high[at] = score, score
            bounds.append((low, high))
            if window:
                ok = fits[at] & (exact >= window[0]) & (exact <= window[1])
                if ok.any():
                    self.keep(node, exact[ok], ids[at][ok])


def _grid(packed: DataFrame, forest: DataFrame, cells: int, row_cells: int, same: bool) -> DataFrame:
    """What each cell finds. forest: TREES and wanted array<struct<node, place, lo, hi, n>>."""
    def run(batches):
        held: dict = {"cell": None, "trees": [], "rows": [], "n": 0}

        def work():
            parts, held["rows"], held["n"] = held["rows"], [], 0
            if not parts or not held["trees"]:
                return
            ids = np.concatenate([np.array(p[0], np.int64) for p in parts])
            labels = np.concatenate([np.array(p[1], np.int64) for p in parts])
            x = np.zeros((len(ids), max(p[2] for p in parts)), np.int64)
            at = 0
            for i, _, dims, width, data in parts:
                x[at:at + len(i), :dims] = _unpack(data, width, len(i))
                at += len(i)
            floats = x.astype(np.float64)
            norms = np.sqrt((floats * floats).sum(axis=1))
            if np.abs(x).max(initial=0) > 1 << 15:
                floats = None
            for t in held["trees"]:
                t.block(x, floats, ids, labels, norms, same)

        def done():
            work()
            out = [(t.tree, node, place, i, s) for t in held["trees"] for node, lists in enumerate(t.wanted)
                   for place, entry in enumerate(lists) for s, i in entry[3]]
            held["trees"] = []
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              ["tree", "node", "place", "id", "score"])

        for b in batches:
            for r in b.to_pylist():
                if r["cell"] != held["cell"]:
                    yield done()
                    held["cell"] = r["cell"]
                if r["kind"] == 0:
                    wanted: list = [[] for _ in r["ids"]]
                    for w in sorted(r["wanted"] or (), key=lambda w: (w["node"], w["place"])):
                        wanted[w["node"]].append([w["lo"], w["hi"], w["n"], []])
                    held["trees"].append(Tree(r["tree"], r["ids"], r["labels"], r["parents"], r["edges"], r["dims"], r["data"], wanted))
                else:
                    held["rows"].append((r["ids"], r["labels"], r["dims"], r["width"], r["data"]))
                    held["n"] += len(r["ids"])
                    if held["n"] >= BLOCK:
                        work()
        yield done()

    side = F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1)))
    groups = forest.select("*", side.alias("r")).select(
        (F.shiftright("tree", 32) * row_cells + F.col("r")).cast("int").alias("cell"), F.lit(0).alias("kind"), "tree", "ids", "labels",
        "parents", "edges", "dims", F.lit(8).alias("width"), "data", "wanted")
    blocks = packed.select("*", F.pmod(F.xxhash64("ids", "data"), F.lit(row_cells)).alias("r"),
                           F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c"))
    blocks = blocks.select((F.col("c") * row_cells + F.col("r")).cast("int").alias("cell"), F.lit(1).alias("kind"), "ids", "labels",
                           "dims", "width", "data")
    both = groups.unionByName(blocks, allowMissingColumns=True)
    both = both.repartition(cells * row_cells, "cell").sortWithinPartitions("cell", "kind")
    return map_batches(both, run, FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first n of each (tree, node, place), numbered from 1."""
    by = Window.partitionBy("tree", "node", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, anchor_every: int = 50, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, cell_anchors: int = CELL_ANCHORS, cell_rows: int = CELL_ROWS,
                   group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: (id long, label int, vector array<bigint>) without nulls.
    """
    spark = rows.sparkSession
    packed = written(packets(rows.select("id", "label", "vector").distinct()))
    n = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
    anchors = written(anchors_of(packed, anchor_every))
    forest, cells = trees(anchors, anchors.count(), cell_anchors, group)
    forest = written(forest)
    row_cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // cell_rows))
    node = F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("node")

    def wanting(lists: DataFrame) -> DataFrame:
        """forest with its lists (tree, node, place, lo, hi, n)."""
        lists = lists.groupBy("tree").agg(F.collect_list(F.struct("node", "place", "lo", "hi", "n")).alias("wanted"))
        return forest.join(lists, "tree")

    best = forest.select("tree", node).select("tree", "node", F.lit(0).alias("place"), F.lit(int(_I64.min)).alias("lo"),
                                              F.lit(int(_I64.max)).alias("hi"), F.lit(n_positives).alias("n"))
    positives = _first(_grid(packed, wanting(best), cells, row_cells, same=True), n_positives)
    positives = written(positives.select("tree", "node", (F.col("rank") - 1).cast("int").alias("place"),
                                         F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * s <= high * p for whole numbers
    scaled = positives.select("*", F.col("positive_score").cast("decimal(30,0)").alias("p"))
    windows = scaled.select("tree", "node", "place", F.ceil(F.col("p") * low / 100).cast("long").alias("lo"),
                            F.floor(F.col("p") * high / 100).cast("long").alias("hi"), F.lit(n_negatives).alias("n"))
    found = _first(_grid(packed, wanting(windows), cells, row_cells, same=False), n_negatives)
    ids = forest.select("tree", F.posexplode("ids").alias("node", "anchor_id"))
    return (found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
            .join(positives, ["tree", "node", "place"]).join(ids, ["tree", "node"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def labelled_vectors(df: DataFrame) -> DataFrame:
    """The query's rows: those without gaps; every seventh label moved on, components as floor(256 x)."""
    x = "transform(embedding, x -> cast(floor(256D * cast(x AS double)) AS bigint))"
    return df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL "
                    "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))").selectExpr(
        "cast(vec_id AS bigint) AS id", "cast(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS int) AS label",
        f"{x} AS vector")


def op11_anchor_tree_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


ORACLE_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * cast(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id,
             cast(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      QUALIFY r <= 3)
SELECT anchor_id, positive_id, cast(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
