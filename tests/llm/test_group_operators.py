"""Operators that link documents, against brute force over all pairs."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fieldcast.llm import chunk_dedup, graph, sharding, simhash

SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- components ----------------------------------------------------------------------


def test_components_of_random_links(spark):
    rnd = random.Random(1)
    for n, m in ((1, 0), (30, 20), (200, 150)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2, n - 1)]
        found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs or [(0, 0)], "a long, b long")).collect()}
        want = roots(n, pairs)
        assert all(found.get(i, i) == want[i] for i in range(n))


# --- SimHash -------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, prints):
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    group = {}
    for i, r in enumerate(roots(len(prints), pairs)):
        group.setdefault(r, []).append(i)
    return {i: min((ids[k] for k in members if ids[k] is not None), default=None) for members in group.values() for i in members}


def test_fingerprints_and_components_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    found = {r.doc_id: r for r in simhash.op6_simhash(spark, SF).collect()}
    prints = [plain_fingerprint(t) for t in docs.text]
    want = plain_components(docs.doc_id.tolist(), prints)
    for i, doc in enumerate(docs.doc_id):
        assert found[doc].fingerprint == f"{prints[i]:016x}" and found[doc].component_id == want[i]


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_lose_no_component(spark, crowd):
    rnd = random.Random(crowd)
    values = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(12):
            flips = rnd.sample(range(64), rnd.choice((0, 1, 2, 3)))
            values.add(base ^ sum(1 << f for f in flips))
            base = rnd.choice((base, max(values)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if bin((signed[i] ^ signed[j]) & (2**64 - 1)).count("1") <= 2]
    want = roots(len(signed), pairs)
    found = {r.node: r.root for r in graph.components(simhash.links(prints, crowd)).collect()}
    assert all(found.get(v, v) == signed[want[i]] for i, v in enumerate(signed)) and len(pairs) > 50


def test_near_duplicates_of_odd_input(spark):
    rows = [(5, None), (3, ""), (None, "  \n"), (7, "one two"), (8, "ONE\ttwo"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "x y z w"), (12, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    found = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([("5", 3), ("3", 3), ("None", 3), ("7", 7), ("8", 7), ("9", 9), ("9", 9), ("None", None), ("12", 12)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "3", "7", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_finds_near_copies_as_brute_force_does(spark):
    rnd = random.Random(11)
    texts = []
    for n in (60, 90, 150, 300, 900):
        for _ in range(6):
            base = [prose(rnd, 1) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(5):  # from near-identity to below the limit
                words = list(base)
                for at in rnd.sample(range(n), max(1, round(n * rnd.choice((0.005, 0.01, 0.015, 0.02, 0.03, 0.06))))):
                    words[at] = prose(rnd, 1)
                texts.append(" ".join(words))
    hot = [prose(rnd, 1) for _ in range(200)]
    texts += [" ".join(hot[:i] + [f"changed{i}"] + hot[i + 1 :]) for i in range(150)]
    passage = prose(rnd, 60)
    texts += [f"{prose(rnd, 40)} {passage}" for _ in range(80)] + ["", "  ", "two words", "Two  Words"]
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = roots(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(want))
    assert sum(bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 2 for i, j in pairs[:200]) > 20


def test_copies_with_changes_of_their_own_are_not_paired(spark, monkeypatch):
    rnd = random.Random(3)
    base = [prose(rnd, 1) + str(i) for i in range(150)]
    texts = []
    for i in range(150):  # any two are at 121 / 171
        words = list(base)
        for at in (10, 40, 70, 100, 130):
            words[at] = f"own{i}at{at}"
        texts.append(" ".join(words))
    asked, plain = [], simhash.verified

    def counted(pairs, sets, similar):
        asked.append(pairs.count())
        return plain(pairs, sets, similar)

    monkeypatch.setattr(simhash, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in simhash.near_duplicates(docs).collect())
    assert asked[0] > 0 and asked[1] == 0


def rows_made(spark, since):
    """Rows made by the joins and generators of all executions from the number ``since``, by their descriptions."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store, made = spark._jsparkSession.sharedState().statusStore(), {}
    for number in range(since, store.executionsCount()):
        run = store.executionsList(number, 1).apply(0).executionId()
        graph, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (graph.apply(i) for i in range(graph.size())):
            found = node.metrics()
            counts = [found.apply(i).accumulatorId() for i in range(found.size()) if found.apply(i).name() == "number of output rows"]
            if counts and ("Join" in node.name() or "Generate" in node.name()) and values.contains(counts[0]):
                made[node.desc()] = made.get(node.desc(), 0) + int(values.apply(counts[0]).replace(",", ""))
    return made


def test_crowded_keys_cost_few_rows_a_text(spark):
    rnd = random.Random(8)
    base = [prose(rnd, 1) + str(i) for i in range(300)]
    texts = []
    for i in range(200):  # near the limit, so that a crowded key holds a part of them
        words = list(base)
        for at in rnd.sample(range(300), 3):
            words[at] = f"own{i}at{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = [plain_shingles(t) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert [found[i] for i in range(len(texts))] == want
    made = rows_made(spark, since)
    keys = [n for what, n in made.items() if "found#" in what]
    joins = [n for what, n in made.items() if "Join" in what and "shingle#" not in what]
    assert 0 < sum(keys) < 160 * len(texts)  # once
    assert 0 < max(joins) < 100 * len(texts)


def test_near_copies_share_keys_of_their_fingerprints(spark):
    rnd = random.Random(5)
    texts = []
    for n in (8, 9, 12, 40, 200, 600) * 8:  # pairs at 0.8 or just above, unlike all others
        words = [prose(rnd, 1) + str(rnd.random()) for _ in range(n)]
        common = max(1, n - 4)
        texts += [" ".join(words), " ".join(words + [f"more{i}" for i in range(common // 4)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    nodes = simhash.with_prints(docs, 5, 0.8).cache()
    keys, prints = {}, {r.id: int.from_bytes(r["print"], "little") for r in nodes.collect()}
    for r in simhash.with_keys(nodes, simhash.DEPTH, 0.8).collect():
        keys.setdefault(r.id, set()).add(r.key)
    for a in range(0, len(texts), 2):
        assert jaccard(plain_shingles(texts[a]), plain_shingles(texts[a + 1])) >= 0.8 and keys[a] & keys[a + 1]
    large = [a for a in range(0, len(texts), 2) if len(texts[a].split()) >= 40]
    differ = [(prints[a] ^ prints[a + 1]).bit_count() / (64 * simhash.LENGTH) for a in large]
    assert max(differ) < 0.2 and all(0.4 < (prints[a] ^ prints[b]).bit_count() / (64 * simhash.LENGTH) < 0.6 for a in large for b in large if a < b)
    assert sum(len(keys[a] & keys[b]) for a in large for b in large if a < b) < len(large) ** 2 / 20


def test_filter_loses_no_wanted_row(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("hash"), "id")
    told = simhash.may_be(rows, "hash", rows.where("id % 50 = 0").select("hash"), "asked")
    assert told.columns == ["hash", "id", "asked"] and told.count() == 20_000
    assert told.where("id % 50 = 0 and asked").count() == 400 and told.where("asked").count() < 600


# --- sharding ------------------------------------------------------------------------


def laws(rows, shards):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    held = {}
    for r in rows:
        if r["link"] is not None:
            held.setdefault(bytes(r["link"]), []).append(r["shard"])
    return held


def test_shards_are_even_and_groups_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    held = laws(rows, 24)
    assert all(len(set(v)) == 1 for v in held.values() if len(v) < len(rows) // 24)


def test_groups_larger_than_a_shard_take_few_shards(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)], "doc_id long, text string")
    held = laws(sharding.shard_documents(docs, shards=12, rounds=12).collect(), 12)
    spans = [len(set(v)) for v in held.values() if len(v) == 300]
    assert len(spans) == 1 and 4 <= spans[0] <= 8


def test_all_linked_rows_stay_within_quotas(spark):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(200)], "doc_id long, text string")
    before = laws(sharding.shard_documents(docs, shards=8, rounds=0).collect(), 8)
    after = laws(sharding.shard_documents(docs, shards=8).collect(), 8)
    assert sum(len(set(v)) for v in after.values()) < sum(len(set(v)) for v in before.values())


def test_shards_of_odd_input(spark):
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, "x"), (3, "é" * 100_000)]
    docs = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id long, text string, shard int, slot string")
    out = sharding.shard_documents(docs, shards=3).collect()
    laws(out, 3)
    assert sorted((r["size"], r.text_crc32) for r in out)[:2] == [(8, 0), (8, 0)] and max(r["size"] for r in out) == 200_008
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- chunks --------------------------------------------------------------------------


def test_gear_hash_by_definition():
    data = np.frombuffer(bytes(random.Random(2).randrange(256) for _ in range(300)), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup.GEAR[b])) % (1 << 16)
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want


def test_chunks_resist_insertions():
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(2000)).encode()
    changed = text[:3000] + b"an insertion " + text[3000:]

    def cut(t):
        ends = chunk_dedup.chunk_ends(np.frombuffer(t, np.uint8))
        assert ends[-1] == len(t) and all(b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends))
        return [t[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(text), cut(changed)
    assert b"".join(a) == text and len(set(b) - set(a)) <= 6


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rnd = random.Random(6)
    shared = [prose(rnd, rnd.randint(51, 90)) for _ in range(40)]
    short = [prose(rnd, 10) for _ in range(20)]
    texts = [f"{prose(rnd, 60)} {p} {prose(rnd, 60)}" for p in shared for _ in range(2)]
    texts += [f"{prose(rnd, 60)} {p} {prose(rnd, 60)}" for p in short for _ in range(2)] + [prose(rnd, 300) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = chunk_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == set(range(80))
    for r in found:
        passage = shared[r.doc_id // 2].encode()
        part = texts[r.doc_id].encode()[r.begin : r.stop]
        assert part.strip() in passage and r.words <= len(passage.split()) + 1 <= r.most_words + 1 and r.home_doc_id == r.doc_id // 2 * 2
        assert r.first == (r.doc_id % 2 == 0)


def test_passages_of_odd_input(spark):
    body = prose(random.Random(8), 120)
    rows = [(1, None), (2, ""), (3, "x"), (4, body), (4, body), (None, body), (7, "a" * 300_000), (8, "a " * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, row int, digest string")
    found = chunk_dedup.repeated_passages(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ["4", "4", "None"] and all(r.words == 120 for r in found)
    assert sum(r.first for r in found) == 1 and chunk_dedup.repeated_passages(docs.limit(0)).count() == 0
