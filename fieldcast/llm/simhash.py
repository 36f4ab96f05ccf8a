"""Operator 6: SimHash near-duplicates through pigeonhole blocks, by the contract and by the general rule.

``op6_simhash`` keeps to its contract: shingles of ``SHINGLE`` = 3 words, fingerprints at most ``DISTANCE`` = 2 bits apart.  Two bits are
near-identity, so the general rule, ``near_duplicates``, is another one: texts whose sets of ``WIDE`` = 5 word shingles have a Jaccard
similarity of ``SIMILAR`` = 0.8 at least.  The SimHashes of two such texts differ in 15 % of their bits at most on average, beyond any blocks
of 64 bits, so the fingerprint there has ``64 * LENGTH`` bits, and a key is made of ``DEPTH`` bits of it or more.  There are so many keys that a
pair at 0.8 shares none of them ``LOST`` times; a more similar one less often.  Sets of fewer than ``SHORT`` shingles have their least hashes
as further keys, one of which any two at 0.8 share.  Texts that share a key are candidates if their first 64 bits and then 128 are close enough
(five standard deviations), and are verified by their whole shingle sets.  Of texts that share a key all are
compared; of a key that more texts share than chance brings together each is compared to one centre, in one of ``CENTRES`` such keys.  Texts of crowded keys that these links leave
in different components are then joined by their rarest shingles: two sets at 0.8 share one of the fifth that is rarest in either, so no
candidate is lost, and texts that have only a passage in common, however many, do not meet.  Nor do copies of one text with so many changes
of their own that no two of them can be at 0.8: the places of a shingle among those of both sets bound their similarity.

A fingerprint has a bit set where over half of the text's shingle hashes have it.  Two fingerprints at most ``DISTANCE`` = 2 bits
apart agree in at least three of five blocks of bits, so they share one of ten keys made of three blocks (some 38 bits).  Equal
fingerprints are folded to one row first.  Those that share a key are joined on it and their distance verified.

A key that more than ``CROWD`` different fingerprints share is not expanded into pairs.  Its fingerprints are linked through
midpoints instead: two fingerprints at most two bits apart both lie within one bit of a common value, and any two that lie within
one bit of a value are at most two bits apart, so linking all around a value to the least of them gives the same components with
65 rows a fingerprint, however many meet.

Nulls and odd input: a text without words (null, empty, spaces) has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows are copies; a null doc_id is a member but never names a component unless all are null; an
empty table has no rows; other columns are ignored by ``near_duplicates`` and ``near_prints``.  By the general rule texts of equal words are
copies, and those without words are copies of each other only.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import add_columns, cut, fresh, table
from fieldcast.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = (13, 13, 13, 13, 12)
CROWD = 64
#: The general rule: words of a shingle, least Jaccard similarity.
WIDE, SIMILAR = 5, 0.8
#: Words of 64 bits in a fingerprint by the general rule; the first two tell pairs apart, the others make the keys.
LENGTH = 16
#: Least bits of a key, and texts without likeness that may share one on average before keys get longer.
DEPTH, CHANCE = 16, 32
#: Share of the pairs at ``SIMILAR`` that may have no key in common.
LOST = 1e-5
#: Sets of fewer shingles have too few for the bits of a fingerprint to agree as often as those of a large set.
SHORT = 16
SALTS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, LENGTH, np.uint64)
#: Numbers of 64 bits, each of a least hash, by which texts that meet by rare shingles are told apart before their sets are read.
LONG = 16
LONG_FACTORS = np.random.Generator(np.random.PCG64(SEED + 1)).integers(0, 1 << 63, 64 * LONG, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of one key that are all compared to each other, besides those that chance brings together.
FEW = 4
#: One crowded key of so many has a centre; the others only tell that a text is left to the rarest shingles.
CENTRES = 4
#: Words of 64 bits in the filter of rows that may be wanted.
FILTER = 1 << 18
#: Shingle hashes multiplied with all factors at once.
STRIPE = 1 << 7
#: Shingles whose bits are counted at once, no more than a byte can count.
COUNTED = 255
#: Shingle hashes turned into bits at once.
HASHES = 1 << 15
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1
    )


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit number."""
    hashes = shingles(text.translate(LOWER).split(), size)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([fingerprint(t) for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()], pa.int64())]

        return work

    return add_columns(docs, "text", [T.StructField(name, T.LongType())], make)


def block_keys(fp: Column) -> Column:
    """The ten keys of three blocks, each with its number."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(F.shiftright(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    keys = []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(blocks[i])
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` whose components are those of distance at most ``DISTANCE``."""
    keys = prints.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(shared, "key"))
    few = met.where(F.col("n") <= crowd)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, "key").where(F.col("a") < F.col("b")).where(near).select("a", "b")
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    around = many.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in flips))).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = around.join(least, "mid").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def grouped(found: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``found`` (``doc_id``, ``key`` and others) with ``root`` and ``component_id`` by the ``roots`` (``node``, ``root``) of keys."""
    least = cut(found.groupBy(key).agg(F.min("doc_id").alias("least")))
    rooted = least.join(roots.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("root", key).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.join(named, "root").select(key, "root", "component_id"), key)


def near_prints(docs: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row by the contract of operator 6; ``root`` is the component's least fingerprint."""
    found = cut(with_fingerprint(docs.select("doc_id", "text"), "fp").drop("text"))
    return grouped(found, "fp", components(links(found.select("fp").distinct(), crowd))).select("doc_id", "fp", "root", "component_id")


def apart(similar: float) -> float:
    """The share of bits in which the fingerprints of two large sets differ on average: the angle between sets of equal size."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def most(bits: int, share: float) -> float:
    """Five standard deviations above the mean of ``bits`` of which a ``share`` differs."""
    return bits * share + 5 * (bits * share * (1 - share)) ** 0.5


def long_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of ``64 * LENGTH`` bits of a set of shingle hashes, as bytes."""
    counts = np.zeros(64 * LENGTH, np.int64)
    for at in range(0, len(hashes), COUNTED):
        mixed = hashes[at : at + COUNTED, None] + SALTS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def needed(n: int, similar: float) -> int:
    """So many shingles of a set of ``n``, the first in any order, of which two sets of similarity ``similar`` share one."""
    return n - math.ceil(similar * n - 1e-9) + 1


def with_prints(docs: DataFrame, size: int, similar: float) -> DataFrame:
    """``docs`` with ``node`` (a digest of the words), ``many`` (different shingles), ``print``, its first words and the least hashes of short sets."""
    fields = [
        T.StructField("node", T.BinaryType()), T.StructField("many", T.IntegerType()), T.StructField("print", T.BinaryType()),
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("short", T.ArrayType(T.LongType())),
    ]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def make():
        def row(text: bytes) -> tuple:
            words = text.translate(LOWER).split()
            hashes = np.unique(shingles(words, size))
            node = xxhash.xxh3_128_digest(b" ".join(words), SEED)
            least = hashes[: needed(len(hashes), similar)] if 0 < len(hashes) < SHORT else hashes[:0]
            bits = long_print(hashes)
            return node, len(hashes), bits.tobytes(), *bits.view("<i8")[:2].tolist(), least.view(np.int64)

        def work(texts: pa.Array) -> list[pa.Array]:
            columns = list(zip(*map(row, texts.cast(pa.binary()).fill_null(b"").to_pylist()))) or [()] * len(kinds)
            return [pa.array(list(c), k) for c, k in zip(columns, kinds)]

        return work

    return add_columns(docs, "text", fields, make)


def with_keys(nodes: DataFrame, depth: int, similar: float) -> DataFrame:
    """``id, many, low, key``: the keys of every node that has shingles, each of ``depth`` bits of its fingerprint."""
    keys = math.ceil(math.log(LOST) / math.log(1 - (1 - apart(similar)) ** depth))
    choice = np.random.Generator(np.random.PCG64(SEED))
    chosen = np.array([128 + choice.choice(64 * LENGTH - 128, depth, replace=False) for _ in range(keys)])

    def make():
        def work(prints: pa.Array) -> list[pa.Array]:
            raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, 8 * LENGTH)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            found = np.repeat(np.arange(keys)[None] << depth, len(raw), axis=0)
            for i in range(depth):
                found |= bits[:, chosen[:, i]].astype(np.int64) << i
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * keys, pa.int32()), pa.array(found.ravel()))]

        return work

    rows = nodes.where("many > 0").select("id", "many", "low", "short", "print")
    keyed = add_columns(rows, "print", [T.StructField("found", T.ArrayType(T.LongType()))], make)
    return keyed.select("id", "many", "low", F.explode(F.concat("found", "short")).alias("key"))


def long_sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of ``64 * LONG`` least hashes of a set, as signed numbers."""
    least = np.full(len(LONG_FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), STRIPE):
        np.minimum(least, (hashes[at : at + STRIPE, None] * LONG_FACTORS).min(axis=0), out=least)
    return np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool), bitorder="little").view("<i8")


def may_be(rows: DataFrame, hashed: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the hash in ``hashed`` is not in the one column of ``wanted``.

    A filter of ``64 * FILTER`` bits at most goes to all tasks, so rows that are not wanted need no shuffle.
    """
    word, mask = fresh(rows, "filter_word", "filter_mask")

    def place(of: Column) -> tuple[Column, Column]:
        return of.bitwiseAND(F.lit(FILTER - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(of, 40).bitwiseAND(F.lit(63)).cast("int"))

    at, bit = place(F.col(wanted.columns[0]))
    masks = cut(wanted.select(at.alias(word), bit.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask)))
    at, bit = place(F.col(hashed))
    tried = rows.withColumn(word, at).join(F.broadcast(masks), word, "left")
    return tried.withColumn(name, F.coalesce(F.col(mask).bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, name)


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, sketched: bool = False) -> DataFrame:
    """``own``: the shingle hashes of the ``wanted`` nodes (``id`` and others), written once; with ``sketch`` where asked for."""
    kinds = {"own": pa.list_(pa.int64())} | ({"sketch": pa.list_(pa.int64())} if sketched else {})

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            sets = [np.unique(shingles(t.translate(LOWER).split(), size)) for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()]
            rows = {"own": [x.view(np.int64) for x in sets], "sketch": map(long_sketch, sets)}
            return [pa.array(list(rows[name]), kind) for name, kind in kinds.items()]

        return work

    hashed = cut(nodes.select("id", "text_hash").join(wanted, "id"))
    texts = may_be(docs.select(F.xxhash64("text").alias("text_hash"), "text"), "text_hash", hashed.select("text_hash"), "asked").where("asked").drop("asked")
    texts = texts.join(hashed, "text_hash").select(*wanted.columns, "text").dropDuplicates(["id"])
    return cut(add_columns(texts, "text", [T.StructField(name, T.ArrayType(T.LongType())) for name in kinds], make).drop("text"))


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose shingle sets have a Jaccard similarity of ``similar`` at least."""
    left, right = (sets.select(F.col("id").alias(x), F.col("own").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(similar) * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def rare_shingles(sets: DataFrame, similar: float) -> DataFrame:
    """``id, root, n, alone, place, shingle``: of each set its rarest shingles, so many that two sets of similarity ``similar`` and of different roots share one.

    Rare is counted among ``sets``; of n shingles the n - ceil(similar n) + 1 rarest are needed.  The ``alone`` ones that no other root
    has take up places first but meet nothing, so they have no rows.
    """
    each = sets.select("id", "root", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    known = each.groupBy("shingle").agg(F.count("*").alias("in_sets"), F.min("root").alias("one"), F.max("root").alias("other"))
    shared = each.join(known.where("one <> other").select("shingle", "in_sets"), "shingle")
    own = Window.partitionBy("id")
    alone = F.col("n") - F.count("*").over(own)
    places = F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1
    ranked = shared.withColumn("alone", alone).withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("in_sets", "shingle")))
    return ranked.where(F.col("place") <= places).select("id", "root", "n", "alone", "place", "shingle")


def promising(rare: DataFrame, similar: float) -> DataFrame:
    """The ``rare`` rows that can meet one of another root at ``similar``.

    What two sets share is at most n - alone of either, what they do not share at least alone of both.  So a set whose own alone and the
    least one among those with its shingle are too many meets nobody there, however many have the shingle.
    """
    fits = F.lit(1 - similar) * (F.col("n") - F.col("alone")) + 1e-9 >= F.lit(similar) * (F.col("alone") + F.col("least"))
    rows = rare
    for _ in range(2):
        least = rows.groupBy("shingle").agg(F.min("alone").alias("least"), F.min("root").alias("one"), F.max("root").alias("other"))
        rows = cut(rows.join(least.where("one <> other").select("shingle", "least"), "shingle").where(fits).drop("least"))
    return rows


def near_roots(docs: DataFrame, nodes: DataFrame, size: int, similar: float, few: int = FEW) -> DataFrame:
    """``node, root``: the component of every node that has a link, by all verified candidates."""
    total = nodes.count()
    depth = max(DEPTH, math.ceil(math.log2(max(1, total) / CHANCE)))
    few += 3 * math.ceil(total / 2**depth)
    share = apart(similar)

    def differ(a: str, b: str, *parts: str) -> Column:
        return reduce(Column.__add__, (F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in parts))

    def alike(a: Column, b: Column) -> Column:
        fits = F.least(a["many"], b["many"]) >= F.lit(similar) * F.greatest(a["many"], b["many"])
        return (F.bit_count(a["low"].bitwiseXOR(b["low"])) <= most(64, share)) & fits

    # All that a key needs comes from its rows in one place, so that the keys are shuffled once.
    by = Window.partitionBy("key")
    own = [F.col(c) for c in ("id", "many", "low")]
    centre = F.min(F.struct(F.col("id").bitwiseXOR(F.xxhash64("key")).alias("turn"), *own)).over(by)
    met = with_keys(nodes, depth, similar).withColumn("n", F.count("*").over(by)).withColumn("centre", centre).where("n > 1")
    crowded = F.col("n") > few
    members = F.collect_list(F.when(~crowded, F.struct(*own))).over(by)
    central = F.when(F.pmod(F.shiftright("key", depth), F.lit(CENTRES)) == 0, F.array(F.struct("centre.id", "centre.many", "centre.low")))
    asked = F.filter(F.when(crowded, central).otherwise(F.col("members")), lambda x: ((x["id"] < F.col("id")) | crowded & (x["id"] > F.col("id"))) & alike(F.struct(*own), x))
    rows = met.withColumn("members", members).select("id", crowded.alias("crowded"), F.transform(asked, lambda x: x["id"]).alias("others"))
    # One row a text, however many keys it has, is joined from here on.
    others = F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")
    told = cut(rows.where("crowded or size(others) > 0").groupBy("id").agg(F.max("crowded").alias("crowded"), others))
    candidates = told.select("id", F.explode("others").alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    left, right = (nodes.select(*(F.col(c).alias(f"{x}_{c}") for c in ("id", "low", "high"))) for x in "lr")
    both = candidates.join(left, F.col("a") == F.col("l_id")).join(right, F.col("b") == F.col("r_id"))
    pairs = cut(both.where(differ("l_", "r_", "low", "high") <= most(128, share)).select("a", "b"))
    roots = cut(components(verified(pairs, shingle_sets(docs, nodes, ends(pairs), size), similar)).withColumnRenamed("node", "id"))
    # All pairs of a key that is not crowded have been compared by now.
    rest = cut(told.where("crowded").select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    sets = shingle_sets(docs, nodes, rest, size, True)
    met_again = promising(rare_shingles(sets, similar), similar).join(sets.select("id", "sketch"), "id")
    left, right = (met_again.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "root", "n", "alone", "place", "sketch"))) for x in "lr")
    unlike = F.zip_with("l_sketch", "r_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    closely = F.aggregate(unlike, F.lit(0), lambda x, y: x + y) <= most(64 * LONG, (1 - similar) / 2)
    shared = F.least(F.col("l_n") - F.col("l_alone"), F.col("r_n") - F.col("r_alone"))
    possible = F.lit(1 - similar) * shared + 1e-9 >= F.lit(similar) * (F.col("l_alone") + F.col("r_alone"))
    # The first shingle that two sets share leaves them no more than those after it.
    after = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place")) + 1
    enough = F.lit(1 + similar) * after + 1e-9 >= F.lit(similar) * (F.col("l_n") + F.col("r_n"))
    meet = (left["shingle"] == right["shingle"]) & (F.col("l_root") < F.col("r_root"))
    again = left.join(right, meet & possible & enough & closely)
    late = verified(cut(again.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()), sets, similar)
    of_a, of_b = (rest.select(F.col("id").alias(x), F.col("root").alias(f"of_{x}")) for x in "ab")
    tops = components(late.join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    joined = roots.select(F.col("id").alias("node"), "root").union(rest.join(roots, "id", "left_anti").select("id", "root"))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return joined.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, *, size: int = WIDE, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, text_hash, root, component_id`` for every row by the general rule.

    ``root`` is the number of the component's first node, ``text_hash`` tells rows with the same doc_id apart.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = cut(with_prints(rows, size, similar).drop("text"))
    firsts = (F.first(c).alias(c) for c in ("many", "print", "low", "high", "short"))
    nodes = found.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *firsts)
    nodes = cut(nodes.select("*", F.monotonically_increasing_id().alias("id")))
    numbered = found.select("doc_id", "text_hash", "node").join(nodes.select("node", "id"), "node").drop("node")
    return grouped(numbered, "id", near_roots(docs, nodes, size, similar)).select("doc_id", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the row with the least doc_id (of equal rows one)."""
    found = cut(near_duplicates(docs))
    number, missing, mixed, several = fresh(docs, "kept_id", "kept_null", "kept_hash", "kept_several")
    least = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("text_hash"))
    chosen = cut(found.groupBy("root").agg(F.first("component_id").alias("id"), F.min(least).alias(mixed), F.count("*").alias(several)))
    crowd = found.join(chosen.where(F.col(several) > 1).select("root"), "root", "left_semi").select("text_hash")
    chosen = chosen.select(F.coalesce("id", F.lit(0)).alias(number), F.isnull("id").alias(missing), mixed)
    keys = [number, missing, mixed]
    rows = docs.withColumn(number, F.coalesce("doc_id", F.lit(0))).withColumn(missing, F.isnull("doc_id")).withColumn(mixed, F.xxhash64("text"))
    rows = may_be(rows, mixed, crowd, several)
    # A row that is a component of its own stays as it is.
    alone = rows.where(~F.col(several)).select(*docs.columns)
    return alone.union(rows.where(several).join(chosen, keys, "left_semi").dropDuplicates(keys).select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_prints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
