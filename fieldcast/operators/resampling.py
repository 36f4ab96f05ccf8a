"""Block bootstrap of daily series by counters: which block stands where in a draw is a hash of (draw, position).

A draw of a statistic that is a function of sums needs no resampled series.  Each block of consecutive rows is reduced to its sums
first; a draw adds up the sums of its blocks.  Draws and positions are spread over all tasks, nothing depends on the order or number of
partitions, and a recomputed task draws the same.  The hash is plain arithmetic below 2^62, so any SQL engine repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.session import cut

#: Hashes are numbers below 2^31.
MASK = (1 << 31) - 1
MIXERS = ((15, 739_982_445), (12, 695_872_825))
POSITION_STEP, DRAW_STEP, SECOND = 2_654_435_761, 40_503, 1_013_904_223
#: Rows of (draw, position) that one task makes at least, so small series are not spread thin.
ROWS_A_TASK = 200_000


@dataclass(frozen=True)
class Statistic:
    """A function of sums over rows: ``sums`` are SQL expressions of the columns ``c0``, ``c1``... of a row, ``value`` one of their totals."""

    sums: dict[str, str]
    value: str


PEARSON = Statistic(
    {"n": "1D", "sx": "c0", "sy": "c1", "sxx": "c0 * c0", "syy": "c1 * c1", "sxy": "c0 * c1"},
    "try_divide(n * sxy - sx * sy, sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0)))",
)
#: Of a forecast in ``c2`` over the reference in ``c1`` against outcomes in ``c0``.
BRIER_SKILL = Statistic(
    {"reference": "(c1 - c0) * (c1 - c0)", "model": "(c2 - c0) * (c2 - c0)"}, "try_divide(reference - model, reference)"
)
MEAN = Statistic({"n": "1D", "total": "c0"}, "try_divide(total, n)")


def _mixed(x: Column) -> Column:
    for shift, factor in MIXERS:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * factor).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 15))


def drawn(rows: DataFrame, draw: str, position: str, n_blocks: str, seed: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the block, from 0, that stands at ``position`` of ``draw``.

    Two hashes of the draw are used, one before and one after the position is mixed in, so the draws are not shifts of one
    another.  They are columns of their own, each computed once.
    """
    start = (F.col(draw).cast("long") * DRAW_STEP + seed).bitwiseAND(F.lit(MASK))
    rows = rows.withColumns({"_a": _mixed(start), "_b": _mixed(start.bitwiseXOR(F.lit(SECOND)))})
    first = _mixed((F.col("_a") + F.col(position).cast("long") * POSITION_STEP).bitwiseAND(F.lit(MASK)))
    rows = rows.withColumn("_h", first)
    rows = rows.withColumn("_h", _mixed(F.col("_h").bitwiseXOR(F.col("_b"))))
    return rows.withColumn(out, F.shiftright(F.col("_h") * F.col(n_blocks).cast("long"), 31)).drop("_a", "_b", "_h")


def block_sums(series: DataFrame, columns: Sequence[str], statistic: Statistic, blocksizes: Sequence[int | None],
               keys: Sequence[str] = (), order: str = "time") -> DataFrame:
    """``(keys, blocksize, block, sums, n_blocks)``: blocks of consecutive rows, numbered from 0; the last may be shorter.

    Without a block size (NULL) every row is a block.  The numbering sorts a group's days, so a day with several rows fails.
    """
    keys = list(keys)
    data = series.select(*keys, F.col(order).alias("_t"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    group = Window.partitionBy(*keys).orderBy("_t")
    again = F.assert_true(F.coalesce(F.lag("_t").over(group) < F.col("_t"), F.lit(True)), "bootstrap needs a daily series, one row per day")
    rows = data.withColumn("_i", F.row_number().over(group) - 1).withColumn("_ok", again).where(F.col("_ok").isNull())
    sizes = F.explode(F.array(*(F.lit(s).cast("int") for s in blocksizes))).alias("blocksize")
    spread = rows.select(*keys, "_i", *(F.expr(e).alias(n) for n, e in statistic.sums.items()), sizes)
    block = F.floor(F.col("_i") / F.coalesce("blocksize", F.lit(1))).alias("block")
    sums = spread.groupBy(*keys, "blocksize", block).agg(*(F.sum(n).alias(n) for n in statistic.sums))
    counts = sums.groupBy(*keys, "blocksize").agg(F.count(F.lit(1)).alias("n_blocks"))
    return _joined(sums, counts, [*keys, "blocksize"])


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join where NULL meets NULL."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, same).drop(*(f"_r_{c}" for c in on))


def bootstrap(series: DataFrame, columns: Sequence[str], statistic: Statistic, n_draws: int,
              blocksizes: Sequence[int | None] = (None,), keys: Sequence[str] = (), seed: int = 7, order: str = "time") -> DataFrame:
    """``(keys, blocksize, draw, stat)``: the statistic of ``n_draws`` resampled series.

    As many blocks as there are, are drawn with replacement.  A statistic without a value (of a constant resample) is NULL.
    """
    keys = [*keys, "blocksize"]
    # Written, so the planner knows its size: a small table of blocks is broadcast, a large one is shuffled.
    sums = cut(block_sums(series, columns, statistic, blocksizes, keys[:-1], order))
    # A task makes the draws of some positions; partial sums are combined before the shuffle by draw.
    positions = sums.select(*keys, F.col("block").alias("position"), "n_blocks")
    together = max(1, ROWS_A_TASK // n_draws)
    dealt = positions.repartition(max(1, -(-positions.count() // together)), *keys, "position")
    draws = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    taken = drawn(draws, "draw", "position", "n_blocks", seed, "block")
    met = _joined(taken.select(*keys, "draw", "block"), sums.drop("n_blocks"), [*keys, "block"])
    totals = met.groupBy(*keys, "draw").agg(*(F.sum(n).alias(n) for n in statistic.sums))
    return totals.select(*keys, "draw", F.expr(statistic.value).alias("stat"))
