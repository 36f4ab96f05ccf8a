"""Pairs of cells whose series correlate at some lag, without comparing every two series.

Deviations divided by their norm are vectors of length one, and two of them are ``sqrt(2 (1 - correlation))`` apart.  Their
coefficients on some waves of a Fourier basis of the days can only lie nearer than that.  So pairs within a limit are
found by an equi-join on cubes of the three coefficients that differ most from cell to cell, thinned by the distance of
all coefficients, and what is left is checked on the whole series.  No pair is lost.

Cells of equal series form one class and take part as one.  Series without such waves in common, as noise is, are near each
other in every few coefficients, so the cubes rule out next to nothing.  Then all pairs of classes are multiplied in tiles
of one byte a day, and a bound on the rounding keeps every pair that can reach the limit; most are ruled out by about half of the days and the
norms of the rest.  What is left, about the result, meets again in blocks of few cells for the exact products.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import session
from fieldcast.functions.dates import day_number
from fieldcast.operators.similarity import LIST
from fieldcast.operators.temporal import lag_field
from fieldcast.operators.tiles import packed_rows, range_pairs, strips, wanted
from fieldcast.session import cut, dealt_by_size

#: Coefficients whose cubes are joined.
AXES = 3
#: The bound is taken this much wider, so that rounding loses no pair.
SLACK = 1e-9
#: Cells in a row that are checked together.
BLOCK = 64
#: Rows of the field that a task packs at once.
PACKED = 1 << 22
#: Kinds of numbers in a piece of a series by their bytes, and its columns.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}
PIECE = "first int, bits boolean, known binary, values binary, same binary"
#: How far below the limit the rest of the days should lie before pairs are ruled out by the first ones, and the share of pairs left
#: up to which each is worked out by itself.
MARGIN, DENSE = 0.12, 0.005
#: Cells on which the waves are tried, and the share of pairs up to which they are worth it.
SOME, SHARE = 128, 0.05


def unit_series(field: DataFrame, lags: Sequence[int]) -> DataFrame:
    """``(cell, lag, day, u)``: deviations from each lagged series' own mean over its norm; constant series have none."""
    axis = field.select("time").distinct()
    moved = lag_field(field, lags).join(axis, "time", "left_semi").where(F.col("value").isNotNull())
    own = Window.partitionBy("cell", "lag")
    moved = moved.withColumn("_d", F.col("value") - F.sum("value").over(own) / F.count("value").over(own))
    norm = F.sqrt(F.sum(F.col("_d") * F.col("_d")).over(own))
    unit = moved.select("cell", "lag", day_number("time").alias("day"), (F.col("_d") / F.when(norm > 0, norm)).alias("u"))
    return unit.where(F.col("u").isNotNull())


def packed_series(unit: DataFrame, waves: int = 8) -> DataFrame:
    """``(cell, lag, first, u, waves)``: the days as one array from the first on, 0 where missing, and the wave coefficients.

    The waves are the ``waves`` longest over all days, and those of a year and half a year; an array is bounded by the
    calendar.
    """
    start, end = unit.agg(F.min("day"), F.max("day")).first()
    if start is None:
        start, end = 0, 0
    width = end - start + 1
    years = round(width / 365.2425)
    counts = sorted({m for m in (*range(1, waves + 1), years, 2 * years) if 0 < m < width / 2})
    turn = (F.col("day") - start) * (2 * math.pi / width)
    scale = math.sqrt(2 / width)
    parts = [F.sum(F.col("u") * wave(turn * m)) * scale for m in counts for wave in (F.cos, F.sin)]
    parts += [F.lit(0.0)] * max(0, AXES - len(parts))
    packed = unit.groupBy("cell", "lag").agg(
        F.array_sort(F.collect_list(F.struct("day", "u"))).alias("_s"), *[p.alias(f"_w{k}") for k, p in enumerate(parts)]
    )

    def filled(point: Column, at: Column) -> Column:
        gap = F.coalesce(F.get("_s", at + 1)["day"] - point["day"] - 1, F.lit(0))
        return F.concat(F.array(point["u"]), F.array_repeat(F.lit(0.0), gap))

    return packed.select(
        "cell", "lag", F.get("_s", F.lit(0))["day"].alias("first"), F.flatten(F.transform("_s", filled)).alias("u"),
        F.array(*[f"_w{k}" for k in range(len(parts))]).alias("waves"),
    )


def candidate_series(packed: DataFrame, max_dist: float) -> DataFrame:
    """``(i, j, lag)``, i < j, whose wave coefficients allow a correlation of ``1 - max_dist`` of i with j lagged."""
    n = packed.select(F.size("waves").alias("n")).limit(1).collect()
    if not n:
        return packed.select(F.col("cell").alias("i"), F.col("cell").alias("j"), "lag")
    spread = packed.agg(*[F.coalesce(F.var_pop(F.get("waves", F.lit(k))), F.lit(0.0)) for k in range(n[0].n)]).first()
    chosen = sorted(range(n[0].n), key=lambda k: -spread[k])[:AXES]
    reach = math.sqrt(2 * max_dist) + SLACK
    cube = F.array(*[F.floor(F.get("waves", F.lit(k)) / reach).cast("int") for k in chosen])
    steps = F.array(*[F.array(*map(F.lit, step)) for step in itertools.product((-1, 0, 1), repeat=AXES)])
    own = packed.select("cell", "lag", "waves", cube.alias("cube"))
    parts = own.groupBy("cube").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_parts"))
    members = own.join(parts, "cube").withColumn("_part", F.pmod(F.xxhash64("cell", "lag"), F.col("_parts")).cast("int"))
    left = own.where("lag = 0").select(F.col("cell").alias("i"), F.col("waves").alias("_a"), "cube")
    near = left.withColumn("cube", F.explode(F.transform(steps, lambda step: F.zip_with("cube", step, lambda a, b: a + b))))
    # A crowded cube's members are dealt over its parts, and whoever asks for the cube meets all of them.
    asked = near.join(parts, "cube").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = members.select(F.col("cell").alias("j"), "lag", F.col("waves").alias("_b"), "cube", "_part")
    met = asked.join(right, ["cube", "_part"]).where("i < j")
    apart = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return met.where(apart <= 2 * max_dist + SLACK).select("i", "j", "lag")


def wave_join(field: DataFrame, lags: Sequence[int], max_dist: float) -> DataFrame:
    """:func:`correlation_join` by cubes of wave coefficients."""
    packed = cut(packed_series(unit_series(field, lags)))
    whole = packed.select("cell", "lag", "first", "u")
    left = whole.where("lag = 0").select(F.col("cell").alias("i"), F.col("first").alias("_fi"), F.col("u").alias("_ui"))
    right = whole.select(F.col("cell").alias("j"), "lag", F.col("first").alias("_fj"), F.col("u").alias("_uj"))
    met = candidate_series(packed, max_dist).join(left, "i").join(right, ["j", "lag"])
    start = F.greatest("_fi", "_fj")
    sides = [F.slice(f"_u{c}", start - F.col(f"_f{c}") + 1, F.greatest(F.size(f"_u{c}"), F.lit(1))) for c in "ij"]
    product = F.zip_with(*sides, lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    corr = F.aggregate(product, F.lit(0.0), lambda s, v: s + v)
    best = met.select("i", "j", corr.alias("_corr")).groupBy("i", "j").agg((1 - F.max("_corr")).alias("dist"))
    return best.where(F.col("dist") <= max_dist)


def waves_tell_apart(field: DataFrame, lags: Sequence[int], max_dist: float) -> bool:
    """Whether wave coefficients rule out most pairs: tried on some cells, as only the way depends on it, not the result."""
    some = field.select("cell").distinct().orderBy(F.xxhash64("cell")).limit(SOME)
    packed = cut(packed_series(unit_series(field.join(F.broadcast(some), "cell", "left_semi"), lags)))
    n = packed.select("cell").distinct().count()
    return candidate_series(packed, max_dist).select("i", "j").distinct().count() <= SHARE * n * (n - 1) / 2


class Lagged:
    """One cell's series on the days of the field: its deviations at every lag, each divided by its norm."""

    def __init__(self, days: np.ndarray, values: np.ndarray, first: int, axis: np.ndarray, lags: Sequence[int]):
        self.u: dict[int, np.ndarray | None] = {}
        for lag in lags:
            at = days - lag - first
            kept = (at >= 0) & (at < len(axis))
            kept[kept] = axis[at[kept]]
            own = values[kept].astype(float)
            dev = own - own.sum() / max(len(own), 1)
            norm = math.sqrt(float(dev @ dev))
            row = None
            if norm > 0:
                row = np.zeros(len(axis))
                row[at[kept]] = dev / norm
            self.u[lag] = row


def piece(days: np.ndarray, values: np.ndarray) -> tuple[int, bool, bytes, bytes]:
    """A series in few bytes: its first day, whether its days come as bits, the days, the values in the shortest kind that holds all exactly."""
    at = days - days[0]
    if bits := bool(at[-1] < 32 * len(at) and (np.diff(at) > 0).all()):
        known = np.zeros(at[-1] + 1, bool)
        known[at] = True
        at = np.packbits(known)
    with np.errstate(invalid="ignore"):
        short = next((v for kind in KINDS.values() if np.array_equal(v := values.astype(kind), values)), values)
    return int(days[0]), bits, (at if bits else at.astype(np.int32)).tobytes(), short.tobytes()


def piece_days(first: int, bits: bool, known: bytes) -> np.ndarray:
    return first + (np.flatnonzero(np.unpackbits(np.frombuffer(known, np.uint8))) if bits else np.frombuffer(known, np.int32).astype(np.int64))


def piece_series(first: int, bits: bool, known: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Days and values of a piece."""
    days = piece_days(first, bits, known)
    return days, np.frombuffer(values, KINDS[len(values) // len(days)] if values else np.float64).astype(float)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows one after the other: a batch of long series is not turned into Python values as a whole."""
    columns = [batch.column(name) for name in names]
    return (tuple(c[k].as_py() for c in columns) for k in range(len(batch)))


def digest(first: int, bits: bool, known: bytes, values: bytes) -> bytes:
    """The same for equal series only."""
    return hashlib.blake2b(b"%d %d %d " % (first, bits, len(known)) + known + values, digest_size=16).digest()


def in_order(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order of the rows by key, those of one key by value."""
    order = np.argsort(keys, kind="stable")
    return order if (np.diff(keys[order]) > 0).all() else np.lexsort((values, keys))


def _piece_rows(cells: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """``found`` holds the place of the cell (None for no cell) and its piece."""
    at, *columns = zip(*((at, *one, digest(*one)) for at, one in found))
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    arrays = [cells.take(pa.array(at, pa.int64())), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]]
    return pa.RecordBatch.from_arrays(arrays, ["cell", "first", "bits", "known", "values", "same"])


def pieces(field: DataFrame) -> DataFrame:
    """``(cell, first, bits, known, values, same)``: the series of every cell as far as its rows lie together, and its digest.

    Days that have rows, but none with a cell and a value, come as pieces without cell and values.
    """
    cell_type = field.schema["cell"].dataType.simpleString()

    def packed(rows: pa.Table) -> pa.RecordBatch:
        cells = rows["cell"].combine_chunks().dictionary_encode()
        codes, days, values = cells.indices.fill_null(-1).to_numpy().astype(np.int64), rows["day"].to_numpy().astype(np.int64), rows["value"].to_numpy()
        known = (codes >= 0) & rows["value"].is_valid().to_numpy()
        found, bare = [], np.unique(days[~known])
        if len(bare):
            found.append((None, piece(bare, np.zeros(0))))
        codes, days, values = codes[known], days[known], values[known]
        if len(codes):
            low = days.min()
            order = in_order(codes * (days.max() - low + 1) + days - low, values)
            codes, days, values = codes[order], days[order], values[order]
            ends = [*np.flatnonzero(np.diff(codes)) + 1, len(codes)]
            found += [(codes[a], piece(days[a:b], values[a:b])) for a, b in zip([0, *ends], ends)]
        return _piece_rows(cells.dictionary, found)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PACKED:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    rows = field.where(F.col("time").isNotNull()).select("cell", day_number("time").alias("day"), F.col("value").cast("double").alias("value"))
    return rows.mapInArrow(run, f"cell {cell_type}, {PIECE}")


def merged_pieces(found: DataFrame) -> DataFrame:
    """:func:`pieces` with one of each cell."""
    size = found.agg(F.sum(F.length("known") + F.length("values"))).first()[0]
    parts = F.collect_list(F.struct("first", "bits", "known", "values")).alias("_p")
    listed = dealt_by_size(found, (size or 0) // 16, "cell").groupBy("cell").agg(parts)  # a value takes 16 bytes or less
    cell_type = found.schema["cell"].dataType.simpleString()

    def one(cell, parts: list[dict]) -> tuple:
        if cell is None:
            days = np.unique(np.concatenate([piece_days(p["first"], p["bits"], p["known"]) for p in parts]))
            return piece(days, np.zeros(0))
        days, values = (np.concatenate(c) for c in zip(*(piece_series(**p) for p in parts)))
        order = in_order(days, values)
        return piece(days[order], values[order])

    def run(batches):
        for batch in batches:
            cells = batch.column("cell")
            if len(batch):
                rows = zip(cells.is_valid().to_pylist(), cells, batch.column("_p"))
                yield _piece_rows(cells, [(k if known else None, one(k if known else None, p.as_py())) for k, (known, _, p) in enumerate(rows)])

    return listed.mapInArrow(run, f"cell {cell_type}, {PIECE}")


def whole_series(field: DataFrame) -> DataFrame:
    """:func:`pieces` as a table with one of each cell; bounded by the calendar.

    Where the rows of a cell come from one task, as they do from a shuffle by cells or blocks of cells, nothing is shuffled.
    """
    found = cut(pieces(field))
    most = found.where(F.col("cell").isNotNull()).groupBy("cell").count().agg(F.max("count")).first()[0]
    return found if (most or 1) == 1 else cut(merged_pieces(found))


def series_rows(series: DataFrame) -> DataFrame:
    """``(cell, time, value)`` from pieces; days without cell and value come once."""
    cell_type = series.schema["cell"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, one in enumerate(rows_of(batch, "first", "bits", "known", "values")):
                days, values = piece_series(*one)
                cells = batch.column("cell").take(pa.array(np.full(len(days), k)))
                numbers = pa.array(values) if len(values) else pa.nulls(len(days), pa.float64())
                yield pa.RecordBatch.from_arrays([cells, pa.array(days, pa.int32()), numbers], ["cell", "day", "value"])

    rows = series.mapInArrow(run, f"cell {cell_type}, day int, value double")
    return rows.select("cell", F.date_add(F.lit("1970-01-01").cast("date"), "day").alias("time"), "value")


def calendar(series: DataFrame) -> tuple[int, np.ndarray]:
    """The first day that has a row, and for each day from it to the last one whether it has."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for one in rows_of(batch, "first", "bits", "known"):
                seen = np.union1d(seen, piece_days(*one))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32())], ["day"])

    found = series.select("first", "bits", "known").mapInArrow(run, "day int")
    days = [r[0] for r in found.distinct().collect()]  # bounded by the calendar
    first = min(days, default=0)
    axis = np.zeros(max(days, default=0) - first + 1, bool)
    axis[np.asarray(days, np.int64) - first] = True
    return first, axis


def rounded_series(series: DataFrame, first: int, axis: np.ndarray, lags: Sequence[int]) -> DataFrame:
    """``(cell, q, scale, off, more, less)``: series that vary, as one byte a day and what rounding and lags may change.

    ``q * scale`` lies at most ``off`` from the unit vector ``u`` of the unlagged series.  A
    lagged vector is ``u`` moved, less the days that leave the record: its product with any unit vector is at most ``more``
    times that of the moved ``u``, with ``less`` added before.
    """
    cell_type = series.schema["cell"].dataType.simpleString()

    def one(days: np.ndarray, values: np.ndarray):
        dev = values - values.sum() / len(values)
        norm = math.sqrt(float(dev @ dev))
        lagged = Lagged(days, values, first, axis, lags).u
        if not any(row is not None for row in lagged.values()):
            return None
        q, scale, off, more, less = np.zeros(len(axis), np.int8), 0.0, 0.0, 1.0, 0.0
        if norm > 0:
            u = np.zeros(len(axis))
            u[days - first] = dev / norm
            scale = float(np.abs(u).max()) / 127
            q = np.rint(u / scale).astype(np.int8)
            off = float(np.linalg.norm(u - q * scale))
            for lag, row in lagged.items():
                if row is None:
                    continue
                at = days - lag - first
                kept = (at >= 0) & (at < len(axis))
                kept[kept] = axis[at[kept]]
                d = dev[kept]
                shift = abs(float(d.sum())) / len(d)
                d = d - d.sum() / len(d)
                more = max(more, norm / math.sqrt(float(d @ d)))
                less = max(less, shift * math.sqrt(len(d)) / norm)
        return q.tobytes(), scale, off, more, less

    def run(batches):
        for batch in batches:
            found = []
            for k, series in enumerate(rows_of(batch, "first", "bits", "known", "values")):
                row = one(*piece_series(*series))
                if row:
                    found.append((k, *row))
            columns = list(zip(*found)) or [()] * 6
            cells = batch.column("cell").take(pa.array(columns[0], pa.int64()))
            kinds = (pa.binary(), *[pa.float64()] * 4)
            names = ["cell", "q", "scale", "off", "more", "less"]
            yield pa.RecordBatch.from_arrays([cells, *[pa.array(c, kind) for c, kind in zip(columns[1:], kinds)]], names)

    return series.mapInArrow(run, f"cell {cell_type}, q binary, scale double, off double, more double, less double")


def tiled_candidates(rounded: DataFrame, width: int, lags: Sequence[int], max_dist: float) -> DataFrame:
    """``(x, y)`` in any order, each pair once, that can reach a correlation of ``1 - max_dist`` at some lag."""
    cell_type = rounded.schema["cell"].dataType.simpleString()
    rounding = (width + 8) * 2.0**-23  # of sums of single precision

    def numbers(t: pa.Table) -> tuple[np.ndarray, ...]:
        scale, off, more, less = (t[c].to_numpy() for c in ("scale", "off", "more", "less"))
        return scale, off, (1 - max_dist) / more - less

    def overlaps(a: np.ndarray, b: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Days of both that meet at each lag, from the ``begin``th of them up to the ``end``th."""
        for lag in lags:
            stop = max(0, min(end, width - abs(lag)))
            days, ahead, behind = slice(min(begin, stop), stop), max(lag, 0), max(-lag, 0)
            yield a[:, days.start + behind : days.stop + behind], b[:, days.start + ahead : days.stop + ahead]

    def kernel(a: pa.Table, b: pa.Table, after: np.ndarray | None) -> pa.Table:
        found = []
        if len(a) and len(b):
            names = a["cell"].combine_chunks(), b["cell"].combine_chunks()
            left, right = packed_rows(a["q"], np.int8), packed_rows(b["q"], np.int8).astype(np.float32)
            (scale_a, off_a, need_a), (scale_b, off_b, need_b) = numbers(a), numbers(b)
            # The rest of the days adds no more than the product of their norms, so once that is small the first days rule out most pairs.
            behind = np.cumsum((np.square(scale_b) @ np.square(right) / len(b))[::-1])[::-1]
            first = int(np.argmax(np.append(behind, 0.0) <= max(0.0, 1 - max_dist - MARGIN)))
            rest_b = np.sqrt(np.square(right[:, first:]).sum(1, dtype=float)) * scale_b
            for part, begin in strips(len(a), len(b), after):
                strip, other = left[part].astype(np.float32), right[begin:]
                rest = (np.sqrt(np.square(strip[:, first:]).sum(1, dtype=float)) * scale_a[part])[:, None] * rest_b[None, begin:]
                scale = (scale_a[part, None] * scale_b[None, begin:]).astype(np.float32)
                slack = off_a[part, None] + off_b[None, begin:] + off_a[part, None] * off_b[None, begin:] + rounding
                least = np.minimum(need_a[part, None], need_b[None, begin:]) - slack
                products = [x @ y.T for x, y in overlaps(strip, other, 0, first)]
                near = functools.reduce(np.maximum, products) * scale >= least - rest
                if first < width and near.mean() > DENSE:
                    products = [p + x @ y.T for p, (x, y) in zip(products, overlaps(strip, other, first, width))]
                    near = functools.reduce(np.maximum, products) * scale >= least
                elif first < width:
                    at = rows, cols = np.nonzero(near)
                    whole = [p[at] + np.einsum("ij,ij->i", x[rows], y[cols]) for p, (x, y) in zip(products, overlaps(strip, other, first, width))]
                    near[at] = functools.reduce(np.maximum, whole) * scale[at] >= least[at]
                rows, cols = wanted(near, part, begin, after)
                found.append((names[0].take(pa.array(rows)), names[1].take(pa.array(cols))))
        kind = a.schema.field("cell").type
        return pa.table([pa.chunked_array([f[k] for f in found], kind) for k in range(2)], ["x", "y"])

    return range_pairs(rounded, kernel, f"x {cell_type}, y {cell_type}")


def checked_pairs(pairs: DataFrame, series: DataFrame, first: int, axis: np.ndarray, lags: Sequence[int], max_dist: float) -> DataFrame:
    """``(i, j, dist)`` of both directions of each pair, as far as they lie within ``max_dist``: i is the unlagged one.

    Cells are put into blocks of ``BLOCK`` in a row; a series is sent once to each two blocks that have a pair of it.
    """
    field = series.schema["cell"]
    whole = field.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def block(c: str) -> Column:
        return F.floor(F.col(c) / BLOCK) if whole else F.pmod(F.xxhash64(c), F.lit(1 << 12))

    placed = pairs.withColumns({"_a": block("x").cast("long"), "_b": block("y").cast("long")})
    ends = cut(placed.select("_a", "_b", F.col("x").alias("cell")).union(placed.select("_a", "_b", "y")).distinct())  # small beside the series
    asked = ends.join(series, "cell").select(F.col("_a").alias("_ka"), F.col("_b").alias("_kb"), "cell", "first", "bits", "known", "values")

    def run(key, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = {c: Lagged(*piece_series(*one), first, axis, lags).u for c, *one in zip(*(rows[c] for c in ("cell", "first", "bits", "known", "values")))}
        out = []
        for x, y in zip(pairs["x"], pairs["y"]):
            for i, j in ((x, y), (y, x))[: 1 if x == y else 2]:
                base = known[i][0]
                if base is None:
                    continue
                corr = [float(base @ other) for other in known[j].values() if other is not None]
                if corr and 1 - max(corr) <= max_dist:
                    out.append((i, j, 1 - max(corr)))
        return pd.DataFrame(out, columns=["i", "j", "dist"])

    cell = field.dataType.simpleString()
    return placed.groupBy("_a", "_b").cogroup(asked.groupBy("_ka", "_kb")).applyInPandas(run, f"i {cell}, j {cell}, dist double")


def tiled_join(field: DataFrame, lags: Sequence[int], max_dist: float) -> DataFrame:
    """:func:`correlation_join` by tiles of rounded series and exact products of what they leave."""
    return tiled_series(whole_series(field), lags, max_dist)


def tiled_series(series: DataFrame, lags: Sequence[int], max_dist: float) -> DataFrame:
    """:func:`tiled_join` from the series."""
    first, axis = calendar(series)
    series = series.where(F.col("cell").isNotNull())
    members = cut(series.select("cell", "same").join(series.groupBy("same").agg(F.min("cell").alias("root")), "same").select("cell", "root"))
    roots = members.where("cell = root").select("cell")
    rounded = rounded_series(series.join(roots, "cell", "left_semi"), first, axis, lags)
    pairs = tiled_candidates(rounded, len(axis), lags, max_dist)
    crowds = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    pairs = pairs.union(crowds.select(F.col("root").alias("x"), F.col("root").alias("y")))
    found = checked_pairs(pairs, series, first, axis, lags, max_dist).select(F.col("i").alias("_i"), F.col("j").alias("_j"), "dist")
    sides = [members.select(F.col("root").alias(f"_{c}"), F.col("cell").alias(c)) for c in "ij"]
    begun = found.join(sides[0], "_i")
    # A few pairs of roots make many pairs of cells, so tasks are counted by these.
    many = functools.reduce(lambda t, c: t.join(crowds.select(F.col("root").alias(c), F.col("_n").alias(f"_{c}")), c, "left"), "xy", pairs)
    rows = many.agg(F.sum(F.coalesce("_x", F.lit(1)) * F.coalesce("_y", F.lit(1)))).first()[0] or 0
    if rows > session.ROWS:
        begun = begun.repartition(-(-rows // session.ROWS), "i", "_j")
    return begun.join(sides[1], "_j").where("i < j").select("i", "j", "dist")


def correlation_join(field: DataFrame, lags: Sequence[int], max_dist: float) -> DataFrame:
    """``(i, j, dist)``, i < j, with ``1 - max over lags`` of the correlation of cell i with cell j lagged at most ``max_dist``."""
    series = whole_series(field)  # read several times
    some = series.where(F.col("cell").isNotNull()).select("cell").orderBy(F.xxhash64("cell")).limit(SOME)
    if waves_tell_apart(series_rows(series.join(F.broadcast(some), "cell", "left_semi")), lags, max_dist):
        return wave_join(series_rows(series), lags, max_dist)
    return tiled_series(series, lags, max_dist)
