"""Pairs of cells with similar days: a set-similarity join over an inverted index of rare days.

Two sets of ``a`` and ``b`` days whose Jaccard similarity is at least ``t`` share at least ``t / (1 + t) (a + b)`` days and
differ in size by a factor of ``t`` at most.  With the days of every cell in one common order, the rarest first, such sets
share a day among their first ``n - ceil(t n) + 1``, so only those enter the index.  Pairs that meet there are counted over
all the days they share; what can still follow behind the last of these bounds their overlap, and the pairs that may reach
the threshold are checked on their whole sets.  No pair is lost.

Cells with equal days form one class and take part as one.  A day's list longer than ``LIST`` is dealt over several tasks.
Where days are so common that cells meet more than ``MEETINGS`` others each in the index, it would write nearly all pairs
several times over.  Then all pairs are compared in tiles of one bit a day, and only those near enough are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.dates import day_number
from fieldcast.operators.tiles import packed_rows, range_pairs, strips, wanted
from fieldcast.session import cut

#: Entries of one day's list that a task holds.
LIST = 2048
#: Meetings a cell in the index, beyond which all pairs are compared in tiles.
MEETINGS = 256
#: Bounds are taken this much lower than the threshold, so that rounding loses no pair.
SLACK = 1e-9


def day_sets(marked: DataFrame, event: str = "y") -> DataFrame:
    """``(cell, n, days)``: the days with an event, the rarest over all cells first; cells without any hold none.

    The series of one cell is bounded by the calendar, whatever the number of cells.
    """
    dated = marked.select("cell", F.when(F.col(event), day_number("time")).alias("_day"))
    known = dated.where(F.col("_day").isNotNull()).distinct()
    cells = known.groupBy("_day").agg(F.count(F.lit(1)).alias("_cells"))
    placed = known.join(cells, "_day").select("cell", F.struct("_cells", "_day").alias("_d"))
    filled = dated.select("cell").distinct().join(placed, "cell", "left")
    ordered = filled.groupBy("cell").agg(F.array_sort(F.collect_list("_d")).alias("_s"))
    return ordered.select("cell", F.size("_s").alias("n"), F.col("_s._day").alias("days"))


def set_classes(sets: DataFrame) -> DataFrame:
    """``(cell, root)``: cells with the same days share the least of them as their root."""
    roots = sets.groupBy("days").agg(F.min("cell").alias("root"))
    return sets.join(roots, "days").select("cell", "root")


def dealt(entries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of lists with themselves: a long list's first side is cut into ``_part``s, each of which meets the whole."""
    parts = entries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_parts"))
    known = entries.join(parts, keys)
    first = known.withColumn("_part", F.pmod(F.xxhash64("cell"), F.col("_parts")).cast("int")).drop("_parts")
    return first, known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def _least_overlap(t: float, a: Column, b: Column) -> Column:
    return F.ceil((a + b) * (t / (1 + t)))


def _entries(sets: DataFrame, t: float) -> DataFrame:
    """``(cell, n, at, day)``: the index of rare days."""
    prefix = (F.col("n") - F.ceil(F.col("n") * t) + 1).cast("int")
    return sets.where("n > 0").select("cell", "n", F.posexplode(F.slice("days", F.lit(1), F.least(prefix, F.col("n")))).alias("at", "day"))


def meetings(sets: DataFrame, max_dist: float) -> tuple[int, int]:
    """Pairs that would meet in the lists of the index, and the number of sets."""
    lists = _entries(sets, max(1.0 - max_dist - SLACK, 0.0)).groupBy("day").agg(F.count(F.lit(1)).alias("_k"))
    met = lists.agg(F.sum(F.col("_k").cast("double") * (F.col("_k") - 1) / 2)).first()[0]
    return int(met or 0), sets.count()


def tiled_sets(sets: DataFrame, max_dist: float) -> DataFrame:
    """``(i, j, dist)``, i < j, of different sets at most ``max_dist`` (below 1) apart, from all pairs as bits in tiles."""
    days = [r[0] for r in sets.select(F.explode("days").alias("d")).distinct().orderBy("d").collect()]  # bounded by the calendar
    calendar = np.array(days, np.int64)
    cell_type = sets.schema["cell"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("days"))
            rows, at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), np.searchsorted(calendar, lists.flatten().to_numpy())
            bits = np.zeros((len(lists), len(calendar)), bool)
            bits[rows, at] = True
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["cell", "bits"])

    def kernel(a: pa.Table, b: pa.Table, after: np.ndarray | None) -> pa.Table:
        found = []
        if len(a) and len(b):
            names = a["cell"].combine_chunks(), b["cell"].combine_chunks()
            left, right = (packed_rows(x["bits"], np.uint8) for x in (a, b))
            right = np.unpackbits(right, axis=1, count=len(calendar)).astype(np.float32)
            of_right = right.sum(1, dtype=float)
            for strip, begin in strips(len(a), len(b), after):
                part = np.unpackbits(left[strip], axis=1, count=len(calendar)).astype(np.float32)
                both = part @ right[begin:].T  # whole numbers up to the days of the calendar: exact
                either = part.sum(1, dtype=float)[:, None] + of_right[None, begin:] - both
                rows, cols = wanted((both > 0) & (1 - both / either <= max_dist), strip, begin, after)
                at = rows - strip.start, cols - begin
                dist = 1 - both[at].astype(float) / either[at]
                found.append((names[0].take(pa.array(rows)), names[1].take(pa.array(cols)), pa.array(dist, pa.float64())))
        kinds = (a.schema.field("cell").type, a.schema.field("cell").type, pa.float64())
        return pa.table([pa.chunked_array([f[k] for f in found], kinds[k]) for k in range(3)], ["x", "y", "dist"])

    rows = sets.where("n > 0").select("cell", "days").mapInArrow(pack, f"cell {cell_type}, bits binary")
    met = range_pairs(rows, kernel, f"x {cell_type}, y {cell_type}, dist double")
    return met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "dist")


def candidate_pairs(sets: DataFrame, max_dist: float) -> DataFrame:
    """``(i, j)``, i < j, of the sets that size, prefix and position cannot rule out."""
    t = max(1.0 - max_dist - SLACK, 0.0)
    first, second = dealt(_entries(sets, t).withColumn("at", F.col("at") + 1), ["day"])
    left = first.select("day", "_part", F.col("cell").alias("i"), F.col("n").alias("ni"), F.col("at").alias("pi"))
    right = second.select("day", "_part", F.col("cell").alias("j"), F.col("n").alias("nj"), F.col("at").alias("pj"))
    small, large = F.least("ni", "nj"), F.greatest("ni", "nj")
    left_over = F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj"))
    wanted = _least_overlap(t, F.col("ni"), F.col("nj"))
    met = left.join(right, ["day", "_part"]).where((F.col("i") < F.col("j")) & (small >= large * t))
    shared = met.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("_shared"), F.max("pi").alias("pi"), F.max("pj").alias("pj"), F.first("ni").alias("ni"), F.first("nj").alias("nj")
    )
    return shared.where(F.col("_shared") + left_over >= wanted).select("i", "j")


def root_pairs(sets: DataFrame, max_dist: float) -> DataFrame:
    """``(i, j, dist)``, i < j, of different sets at most ``max_dist`` (below 1) apart, checked on the whole sets."""
    if not 0 <= max_dist < 1:
        raise ValueError("sets without a common day are 1 apart: max_dist lies below that")
    met, n = meetings(sets, max_dist)
    if met > MEETINGS * n:
        return tiled_sets(sets, max_dist)
    sides = [sets.select(F.col("cell").alias(c), F.col("days").alias(f"_{c}")) for c in "ij"]
    met = candidate_pairs(sets, max_dist).join(sides[0], "i").join(sides[1], "j")
    both = F.size(F.array_intersect("_i", "_j"))
    checked = met.select("i", "j", both.alias("_both"), (F.size("_i") + F.size("_j") - both).alias("_either"))
    return checked.select("i", "j", (1 - F.col("_both") / F.col("_either")).alias("dist")).where(F.col("dist") <= max_dist)


def similar_sets(marked: DataFrame, max_dist: float, event: str = "y") -> tuple[DataFrame, DataFrame]:
    """``(i, j, dist)`` between roots, and ``(cell, root)``: every pair of cells at most ``max_dist`` apart in short form."""
    sets = cut(day_sets(marked, event))
    members = cut(set_classes(sets))
    roots = sets.join(members.where("cell = root").select("cell"), "cell", "left_semi")
    return root_pairs(roots, max_dist), members


def all_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(i, j, dist)`` of cells from pairs of roots: as many rows as there are pairs near enough."""
    sides = [members.select(F.col("root").alias(f"_{c}"), F.col("cell").alias(c)) for c in "ij"]
    first, second = dealt(members, ["root"])
    same = first.select("root", "_part", F.col("cell").alias("i")).join(second.select("root", "_part", F.col("cell").alias("j")), ["root", "_part"])
    same = same.where("i < j").select("i", "j", F.lit(0.0).alias("dist"))
    across = pairs.select(F.col("i").alias("_i"), F.col("j").alias("_j"), "dist").join(sides[0], "_i").join(sides[1], "_j")
    return across.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").unionByName(same)
