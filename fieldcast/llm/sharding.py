"""Operator 3: balanced label propagation over shards, in DataFrame operations only.

Documents with equal texts are linked.  Each shard has a quota of rows (counts at most one apart: the law ``rows``).  Labels start
spread evenly; in every round each linked document looks at its neighbours' shards and asks to move where most of them are.  Moves
from s to t are granted as far as t wants to send as many to s or holds unlinked documents to give back, so every shard keeps its
quota exactly after every round.  Linked documents of one group in one shard have the same neighbours and so the same wish: the state is a table of cells
(group, shard, documents), the compressed form of the labels, and a round is a few joins and sums of cells.  A group larger than a
shard's quota asks for as many shards as it needs.

Which cells are granted is decided by running totals in two levels, first over hash buckets and then inside one, so no task holds
all cells of a pair of shards.  At the end the members of a group are dealt to its cells by rank, unlinked documents fill up the
quotas, and slots are ranks inside the shard; all ranks are two-level too.

Nulls and odd input: a null text has 8 bytes and checksum 0 and is linked to nothing; a null or repeated doc_id is a row like any
other, with a slot of its own; an empty text equals other empty texts; fewer rows than shards leave shards empty; an empty table has
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import cut, ranked, spread, table

SHARDS = 24
ROUNDS = 4
#: Rows of a window of the two-level ranks.
WINDOW_ROWS = 2_000


def nodes(docs: DataFrame) -> DataFrame:
    """``row, doc_id, size, text_crc32, link`` of every document, written once; ``link`` is a digest of the text."""
    text = F.col("text")
    return cut(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("link"),
    ))


def literal(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def first_cells(groups: DataFrame, shards: int) -> DataFrame:
    """Even start: each group's documents go round all shards from a shard that the group's digest names."""
    base, rest = F.floor(F.col("n") / shards), F.col("n") % shards
    begin = F.pmod(F.xxhash64("link"), F.lit(shards))
    spot = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)).cast("int") - 1)).alias("k")
    dealt = groups.select("link", "n", spot)
    return dealt.select(
        "link", ((begin + F.col("k")) % shards).cast("int").alias("shard"), (base + (F.col("k") < rest).cast("long")).cast("long").alias("held")
    )


def wishes(cells: DataFrame, quota: int) -> DataFrame:
    """``link, shard, held, target``: where the documents of each cell would go.

    The targets of a group are the shards that hold most of it, as many as its size needs; a cell outside them asks for one of
    them in turn.
    """
    seen = F.sort_array(F.collect_list(F.struct("held", (-F.col("shard")).alias("shard"))), asc=False)  # one entry a shard
    groups = cells.groupBy("link").agg(F.sum("held").alias("n"), seen.alias("seen"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(max(1, quota)))).cast("int")
    targets = F.transform(F.slice("seen", F.lit(1), need), lambda x: -x["shard"])
    cell = F.explode(F.transform("seen", lambda x, i: F.struct((-x["shard"]).alias("shard"), x["held"].alias("held"), i.alias("place"))))
    wide = groups.select("link", targets.alias("targets"), cell.alias("c"))
    turn = F.element_at("targets", (F.col("c.place") % F.size("targets") + 1).cast("int"))
    target = F.when(F.col("c.place") < F.size("targets"), F.col("c.shard")).otherwise(turn)
    return wide.select("link", "c.shard", "c.held", target.alias("target"))


def propagate(cells: DataFrame, spare: list[int], quota: int, buckets: int) -> tuple[DataFrame, list[int]]:
    """One round: the cells after it and the unlinked documents of each shard."""
    shards = len(spare)
    wish = cut(wishes(cells, quota))
    moving = wish.where(F.col("shard") != F.col("target"))
    order = F.pmod(F.xxhash64("link"), F.lit(buckets)).cast("int")
    pair = ["shard", "target"]
    sums = moving.groupBy(*pair, order.alias("bucket")).agg(F.sum("held").alias("here"))
    ahead = Window.partitionBy(*pair).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*pair, "bucket", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    asked = [[0] * shards for _ in spare]
    for s, t, n in moving.groupBy(*pair).agg(F.sum("held")).collect():  # one row a pair of shards
        asked[s][t] = n
    granted = [[min(asked[s][t], asked[t][s]) for t in range(shards)] for s in range(shards)]  # exchanges
    left, after = list(spare), list(spare)
    for t in range(shards):
        for k in range(1, shards):
            s = (t + k) % shards
            paid = min(asked[s][t] - granted[s][t], left[t])
            granted[s][t] += paid
            left[t] -= paid
            after[t] -= paid
            after[s] += paid
    may = F.element_at(literal([n for row in granted for n in row]), F.col("shard") * shards + F.col("target") + 1)
    inside = Window.partitionBy(*pair, "bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
    ranked_cells = moving.withColumn("bucket", order).join(offsets, [*pair, "bucket"])
    before = F.col("ahead") + F.coalesce(F.sum("held").over(inside), F.lit(0))
    moved = ranked_cells.withColumn("gone", F.greatest(F.lit(0), F.least(F.col("held"), may - before)))
    state = wish.where(F.col("shard") == F.col("target")).select("link", "shard", "held")
    state = state.union(moved.select("link", "shard", F.col("held") - F.col("gone")))
    state = state.union(moved.select("link", F.col("target").alias("shard"), "gone"))
    return cut(state.groupBy("link", "shard").agg(F.sum("held").alias("held")).where("held > 0")), after


def interval(rank: Column, ends: Column) -> Column:
    """The first interval whose end is above ``rank``."""
    return F.size(F.filter(ends, lambda e: e <= rank))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, link`` of every document."""
    rows = nodes(docs)
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = spread(total, WINDOW_ROWS * shards) * 8
    # Written, so that the joins below meet a table and can split a group that is very large.
    groups = cut(rows.where(F.col("link").isNotNull()).groupBy("link").agg(F.count("*").alias("n")).where("n > 1"))
    cells = cut(first_cells(groups, shards))
    held = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in cells.groupBy("shard").agg(F.sum("held")).collect()}
    # An uneven start beyond the quotas (next to no unlinked documents) is evened out by the largest shards' last cells.
    cells, held = levelled(cells, held, quotas)
    spare = [quotas[s] - held[s] for s in range(shards)]
    for _ in range(rounds):
        cells, spare = propagate(cells, spare, max(quotas), buckets)
    ends = F.array_sort(F.collect_list(F.struct("shard", "held")))
    plan = cells.groupBy("link").agg(ends.alias("cells"))  # one entry a shard
    sums = F.transform("cells", lambda c, i: F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["held"]))
    plan = cut(plan.select("link", F.transform("cells", lambda c: c["shard"]).alias("at"), sums.alias("ends")))
    linked = ranked(rows.join(groups.select("link"), "link", "left_semi"), ["link"], "row", "rank", buckets)
    placed = linked.join(plan, "link").withColumn("shard", F.element_at("at", interval(F.col("rank"), F.col("ends")) + 1))
    alone = rows.join(groups.select("link"), "link", "left_anti").withColumn("one", F.lit(1))
    running, at = [], 0
    for n in spare:
        at += n
        running.append(at)
    single = ranked(alone, ["one"], "row", "rank", buckets * shards).withColumn("shard", interval(F.col("rank"), literal(running)))
    keep = ["row", "doc_id", "size", "text_crc32", "link", "shard"]
    sharded = cut(placed.select(*keep).union(single.select(*keep)))
    return ranked(sharded, ["shard"], "row", "slot", buckets).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "link",
    )


def levelled(cells: DataFrame, held: dict[int, int], quotas: list[int]) -> tuple[DataFrame, dict[int, int]]:
    """``cells`` with no shard above its quota: what is too much goes to shards with room, by running totals inside the shard."""
    over = {s: held[s] - q for s, q in enumerate(quotas) if held[s] > q}
    if not over:
        return cells, held
    room = [max(0, q - held[s]) for s, q in enumerate(quotas)]
    # The excess of all shards in a row is cut at the ends of the rooms in a row.
    starts, at = {}, 0
    for s, n in over.items():
        starts[s], at = at, at + n
    stops, at = [], 0
    for n in room:
        at += n
        stops.append(at)
    excess = F.element_at(literal([over.get(s, 0) for s in range(len(quotas))]), F.col("shard") + 1)
    begin = F.element_at(literal([starts.get(s, 0) for s in range(len(quotas))]), F.col("shard") + 1)
    many = 4096
    bucket = F.pmod(F.xxhash64("link", F.lit(1)), F.lit(many)).cast("int")
    full = cells.where(excess > 0).withColumn("bucket", bucket)
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("shard", "bucket").agg(F.sum("held").alias("here")).select(
        "shard", "bucket", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("held").over(inside), F.lit(0))
    out = full.join(offsets, ["shard", "bucket"]).withColumn("before", before)
    out = out.withColumn("gone", F.greatest(F.lit(0), F.least(F.col("held"), excess - F.col("before"))))
    low, high = begin + F.col("before"), begin + F.col("before") + F.col("gone")
    spots = F.transform(literal(stops), lambda e, i: F.struct(
        i.cast("int").alias("shard"),
        (F.least(e, high) - F.greatest(low, F.when(i > 0, F.element_at(literal(stops), F.greatest(i, F.lit(1)))).otherwise(F.lit(0)))).alias("held")))
    moved = out.where("gone > 0").select("link", F.explode(spots).alias("m")).select("link", "m.shard", "m.held").where("held > 0")
    stay = cells.where(excess <= 0).select("link", "shard", "held").union(out.select("link", "shard", F.col("held") - F.col("gone")))
    level = cut(stay.union(moved).groupBy("link", "shard").agg(F.sum("held").alias("held")).where("held > 0"))
    return level, dict.fromkeys(held, 0) | {r[0]: r[1] for r in level.groupBy("shard").agg(F.sum("held")).collect()}


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("link")
