"""Operator 12: hard negatives by a multiway hyperplane tree with distance ranges (GNAT) and exact leaves.

Scores are inner products of whole numbers.  Every vector gets one more coordinate that makes all lengths equal; then the distance of a query to
a row falls as the score grows, and a window of scores is an annulus around the query.  A node of the tree has up to ``FAN`` split points;
a row goes to the nearest one.  For each split point and each sibling's subtree the node keeps the least and largest distance of any row; a sibling
is eliminated if by the triangle inequality no row in that range can lie in a query's annuli.  Split points come from a sample of at most ``SAMPLE``
rows, so the tree is small whatever the table; the ranges cover all rows.  A leaf is stored in blocks of some ``BLOCK`` rows, and each block that a
query cannot rule out is searched whole, so results are exact.

Queries move in chunks of ``CHUNK``, taken leaf by leaf, and a block is sent once to each chunk that needs it.  The first search is in the query's own leaf and only sets a bound; the
second takes all other leaves that can hold anything at least as good.  Positives come first, then the windows of negatives
below each positive.

Nulls and odd input: rows with a null id, label or vector or a null or non-finite component take no part, nor do vectors of another
length than most (the shorter of equally frequent lengths); repeated rows are rows of their own, so a copy of an anchor is among its others and is an anchor
itself; equal scores go by id; a vector shared by very many rows fills blocks as any others; scores are exact up to 64 bits and held to that range beyond;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow, cut, table

POSITIVES, NEGATIVES = 5, 10
#: Percentages of the positive's score between which a negative lies.
LEAST, MOST = 30, 90
SCALE = 256
FAN, SAMPLE, BLOCK, CHUNK = 16, 4096, 2048, 4096
#: Sampled rows that a split needs for each of its points.
SUPPORT = 8
#: Distances are compared with this share of the largest one to spare.
SLACK = 1e-6
FAR = (1 << 63) - 1


def clean(rows: DataFrame) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part, components as whole numbers; written once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("x", lambda v: F.lit(float(SCALE)) * v)
    # As doubles: a float times a power of two and its floor are exact there, whatever their size.
    number = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), x.alias("x"), whole.alias("whole"))
    good = good.where("whole and vec_id is not null and label is not null")
    found = cut(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", number.alias("vector")))
    usual = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("vector") == (usual.n if usual else 0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    if queries.size and rows.size and np.abs(queries).max() * np.abs(rows).max() * rows.shape[1] < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    as_int = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(as_int(queries).dot(as_int(rows).T), -FAR, FAR).astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


@dataclass
class Node:
    points: np.ndarray  # split points with the lengthening coordinate
    children: list  # a Node or the number of a leaf
    low: np.ndarray = field(default=None)  # [point, child]: least and largest distance of the rows in a child
    high: np.ndarray = field(default=None)


class Tree:
    def __init__(self, sample: np.ndarray, rows: int, length2: float, fan: int = FAN, block: int = BLOCK):
        self.length2, self.leaves, self.nodes = length2, 0, []
        self.width = sample.shape[1] if sample.ndim == 2 else 0
        lifted = self.lifted(sample) if len(sample) else np.zeros((0, self.width + 1))
        self.root = self.split(lifted, rows / max(1, len(sample)), fan, block)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack((rows, np.sqrt(np.maximum(0.0, self.length2 - (rows * rows).sum(axis=1)))))

    def split(self, sample: np.ndarray, weight: float, fan: int, block: int):
        fan = min(fan, len(sample) // SUPPORT)
        chosen = []
        if fan > 1 and len(sample) * weight > block:  # the farthest of those left, in turn
            away = np.full(len(sample), np.inf)
            at = 0
            while len(chosen) < fan and away[at] > 0:
                chosen.append(at)
                away = np.minimum(away, distances(sample, sample[at : at + 1])[:, 0])
                at = int(away.argmax())
        if len(chosen) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(sample[chosen], [])
        self.nodes.append(node)
        nearest = distances(sample, node.points).argmin(axis=1)
        for k in range(len(chosen)):
            node.children.append(self.split(sample[nearest == k], weight, fan, block))
        return node

    def route(self, lifted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """The leaf of each row, and for each node met the least and largest distances by point and child (infinite if none)."""
        leaf, ranges = np.zeros(len(lifted), np.int32), []
        todo = [(self.root, np.arange(len(lifted)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                leaf[rows] = node
                continue
            away = distances(lifted[rows], node.points)
            nearest = away.argmin(axis=1)
            low, high = (np.full((len(node.points),) * 2, x) for x in (np.inf, -np.inf))
            for k, child in enumerate(node.children):
                own = nearest == k
                if own.any():
                    low[:, k], high[:, k] = away[own].min(axis=0), away[own].max(axis=0)
                    todo.append((child, rows[own]))
            ranges.append((next(i for i, n in enumerate(self.nodes) if n is node), low, high))
        return leaf, ranges

    def visits(self, query: np.ndarray, annuli: Sequence[tuple[float, float]]) -> list[int]:
        """Leaves that can hold a row with a score in one of the closed windows ``annuli``."""
        own2 = float(query @ query)
        point = np.append(query, 0.0)
        spare = SLACK * (1 + np.sqrt(own2) + np.sqrt(self.length2))
        at = lambda s: np.sqrt(max(0.0, own2 + self.length2 - 2 * s))
        rings = np.array([(at(high) - spare, at(low) + spare) for low, high in annuli if low <= high])
        out, todo = [], [self.root] if len(rings) else []
        while todo:
            node = todo.pop()
            if not isinstance(node, Node):
                out.append(node)
                continue
            away = distances(point[None, :], node.points)[0][:, None]
            nearest = np.maximum(0.0, np.maximum(away - node.high, node.low - away))  # [point, child]
            farthest = away + node.high
            near, far = nearest.max(axis=0), farthest.min(axis=0)
            open_ = ((near[:, None] <= rings[:, 1]) & (far[:, None] >= rings[:, 0])).any(axis=1)
            todo += [c for c, o in zip(node.children, open_) if o]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


class Index:
    """All rows in blocks by leaf, with the tree that leads to them."""

    def __init__(self, rows: DataFrame, *, fan: int = FAN, sample: int = SAMPLE, block: int = BLOCK):
        self.spark, self.block = rows.sparkSession, block
        dot = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
        told = rows.agg(F.count("*").alias("n"), F.max(dot).alias("most"), F.max(F.size("vector")).alias("width")).first()
        self.width = told.width or 0
        # The least hashes; a first cut by value keeps the sort short.
        mixed = F.xxhash64("vec_id", "row")
        upto = int(min(1.0, 2 * sample / max(1, told.n)) * (1 << 64)) - (1 << 63)
        least = rows.where(mixed <= F.lit(min(upto, FAR))).orderBy(mixed, "row").limit(sample).select("vector").collect()
        self.tree = Tree(np.array([r[0] for r in least], np.float64).reshape(len(least), self.width), told.n, told.most or 0.0, fan, block)
        self.rows = cut(self._routed(rows))
        counts = {r[0]: r[1] for r in self.rows.groupBy("leaf").count().collect()}  # one a leaf
        self.buckets = [max(1, -(-counts.get(k, 0) // block)) for k in range(self.tree.leaves)]
        self._measure()
        self.blocks = cut(self._blocks())

    def _routed(self, rows: DataFrame) -> DataFrame:
        sent, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for batch in batches:
                leaf, _ = tree.route(tree.lifted(matrix(batch.column("vector"), width)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        return arrow(rows).mapInArrow(run, "row long, vec_id long, label int, vector array<double>, leaf int")

    def _measure(self) -> None:
        """Fills in the ranges of the tree from all rows: a few numbers a pair of points of a node."""
        sent, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, seen = sent.value, {}
            for batch in batches:
                for node, low, high in tree.route(tree.lifted(matrix(batch.column(0), width)))[1]:
                    before = seen.get(node, (low, high))
                    seen[node] = np.minimum(before[0], low), np.maximum(before[1], high)
            cells = [(n, i, j, float(low[i, j]), float(high[i, j])) for n, (low, high) in seen.items() for i, j in np.argwhere(low < np.inf).tolist()]
            columns = list(zip(*cells)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 2)], ["node", "i", "j", "low", "high"])

        found = arrow(self.rows.select("vector")).mapInArrow(run, "node int, i int, j int, low double, high double")
        for node in self.tree.nodes:
            # A child without rows keeps an empty range, so every query rules it out.
            node.low, node.high = (np.full((len(node.points),) * 2, x) for x in (np.inf, -np.inf))
        for n, i, j, low, high in found.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect():
            self.tree.nodes[n].low[i, j], self.tree.nodes[n].high[i, j] = low, high

    def per_leaf(self, leaf: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.buckets)), leaf + 1)

    def _blocks(self) -> DataFrame:
        names = ["leaf", "bucket", "rows", "ids", "labels", "vectors"]

        def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            whole = [np.asarray(rows.column(c).combine_chunks()).astype("<i8").tobytes() for c in ("row", "vec_id", "label")]
            vectors = np.asarray(rows.column("vector").combine_chunks().flatten(), np.float64)
            short = not vectors.size or np.abs(vectors).max() < 2.0**24  # exact as floats too
            data = [pa.array([x], pa.binary()) for x in (*whole, vectors.astype("<f4" if short else "<f8").tobytes())]
            return pa.Table.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + data, names)

        bucket = F.pmod(F.xxhash64("row"), self.per_leaf(F.col("leaf"))).cast("int")
        return self.rows.withColumn("bucket", bucket).groupBy("leaf", "bucket").applyInArrow(pack, "leaf int, bucket int, rows binary, ids binary, labels binary, vectors binary")

    def search(self, queries: DataFrame, most: int, same: bool, own: bool) -> DataFrame:
        """``row, place, id, score``: of each query and each of its windows the first ``most`` rows of every block.

        ``queries`` has ``row, label, vector, leaf, chunk, low, high``, the last two lists of closed windows.  ``same`` asks for rows of the query's label, else for
        those of others; a query never finds itself.  ``own`` searches the query's leaf, else all others.
        """
        sent, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for batch in batches:
                home, low, high = (batch.column(c).to_pylist() for c in ("leaf", "low", "high"))
                found = [[leaf for leaf in tree.visits(q, list(zip(a, b))) if leaf != h] for q, a, b, h in zip(matrix(batch.column("vector"), width), low, high, home)]
                where = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = batch.take(pa.array(where, pa.int64()))
                at = batch.schema.get_field_index("leaf")
                yield pa.RecordBatch.from_arrays([c if i != at else pa.array([x for f in found for x in f], pa.int32()) for i, c in enumerate(taken.columns)], batch.schema.names)

        def scan(asked: pa.Table, block: pa.Table) -> pa.Table:
            schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
            if not len(asked) or not len(block):
                return schema.empty_table()
            rows, ids, labels = (np.frombuffer(block.column(c)[0].as_py(), "<i8") for c in ("rows", "ids", "labels"))
            data = block.column("vectors")[0].as_py()
            vectors = np.frombuffer(data, "<f4" if len(data) == 4 * len(rows) * width else "<f8").astype(np.float64).reshape(len(rows), width)
            own_rows, own_labels = (np.asarray(asked.column(c).combine_chunks()) for c in ("row", "label"))
            scores = products(matrix(asked.column("vector"), width), vectors)
            out = []
            for k, (low, high) in enumerate(zip(asked.column("low").to_pylist(), asked.column("high").to_pylist())):
                fit = (labels == own_labels[k]) == same
                fit &= rows != own_rows[k]
                for place, (least, greatest) in enumerate(zip(low, high)):
                    inside = np.flatnonzero(fit & (scores[k] >= least) & (scores[k] <= greatest))
                    if len(inside) > 4 * most:  # all that tie with the last one stay
                        edge = np.partition(scores[k][inside], len(inside) - most)[len(inside) - most]
                        inside = inside[scores[k][inside] >= edge]
                    best = inside[np.lexsort((ids[inside], -scores[k][inside]))[:most]]
                    out.append((np.full(len(best), own_rows[k]), np.full(len(best), place, np.int32), ids[best], scores[k][best]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        needed = queries.select("row", "label", "vector", "leaf", "chunk", "low", "high")
        if not own:
            needed = cut(arrow(needed).mapInArrow(visit, needed.schema))
        met = needed.select("leaf", F.col("chunk").alias("asked")).distinct()
        blocks = self.blocks.join(met, "leaf")
        spots = F.explode(F.sequence(F.lit(0), self.per_leaf(F.col("leaf")) - 1))
        dealt = needed.withColumn("bucket", spots)
        return dealt.groupBy("leaf", "bucket", "chunk").cogroup(blocks.groupBy("leaf", "bucket", "asked")).applyInArrow(scan, "row long, place int, id long, score long")


def first(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each query and window, with their ``rank``."""
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def bounded(found: DataFrame, most: int) -> DataFrame:
    """``row, place, bound``: the score of the last of ``most`` rows, where there are so many."""
    return found.where(F.col("rank") == most).select("row", "place", F.col("score").alias("bound"))


def percent(share: int, score: Column, up: bool) -> Column:
    """``share`` hundredths of ``score``, rounded up or down, exactly."""
    share_of = score.cast("decimal(20,0)") * share / 100
    return (F.ceil(share_of) if up else F.floor(share_of)).cast("long")


def hard_negatives(
    rows: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    fan: int = FAN, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``rows`` that fulfil ``anchors``."""
    index = Index(clean(rows), fan=fan, sample=sample, block=block)
    asked = index.rows.where(anchors)
    sizes = {r[0]: r[1] for r in asked.groupBy("leaf").count().collect()}  # one a leaf
    counts = np.array([sizes.get(k, 0) for k in range(index.tree.leaves)], np.int64)
    of_leaf = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("leaf") + 1)
    spot = of_leaf(np.cumsum(counts) - counts) + F.pmod(F.xxhash64("row"), of_leaf(np.maximum(counts, 1)))
    asked = cut(asked.withColumn("chunk", F.floor(spot / chunk)))
    wide = asked.withColumn("low", F.array(F.lit(-FAR))).withColumn("high", F.array(F.lit(FAR)))
    near = cut(first(index.search(wide, positives, True, True), positives))
    bound = F.array(F.coalesce("bound", F.lit(-FAR)))
    further = wide.join(bounded(near, positives).drop("place"), "row", "left").withColumn("low", bound).drop("bound")
    found = cut(first(near.drop("rank").union(index.search(further, positives, True, False)), positives))
    windows = found.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    each = windows.select("row", "place", percent(least, F.col("positive_score"), True).alias("l"), percent(most, F.col("positive_score"), False).alias("h"))

    def with_windows(each: DataFrame) -> DataFrame:
        listed = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "l", "h"))).alias("w"))  # at most ``positives``
        return asked.join(listed, "row").select("*", F.col("w.l").alias("low"), F.col("w.h").alias("high")).drop("w")

    near = cut(first(index.search(with_windows(each), negatives, False, True), negatives))
    bounds = bounded(near, negatives).withColumn("place", F.col("place") + 1)
    closer = each.join(bounds, ["row", "place"], "left").select("row", "place", F.greatest("l", F.coalesce("bound", "l")).alias("l"), "h")
    everywhere = first(near.drop("rank").union(index.search(with_windows(closer), negatives, False, False)), negatives)
    out = everywhere.withColumn("place", F.col("place") + 1).join(windows, ["row", "place"]).join(asked.select("row", "vec_id"), "row")
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), found AS (
    SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
        (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    WHERE 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""
