"""Archives, token files and packed sequences: exact round trips and optimal cuts."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldcast.llm import packing, token_files, tokens, warc
from fieldcast.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4()}"


# --- words and ids -------------------------------------------------------------------

words = st.one_of(st.text(max_size=12), st.sampled_from(["don't", "<|endoftext|>", "İstanbul.", "ΣΑΣ,", "éa", "ÉTÉ.", "12.5", "...", "ß,", "ﬁn", "中文。"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words, st.sampled_from([" ", "\n", "  ", "\t", " ", "\x0b", ""])), max_size=12))
def test_ids_of_words_are_those_of_the_text(whole, parts):
    text = "".join(w + s for w, s in parts)
    cache = test_ids_of_words_are_those_of_the_text.__dict__.setdefault("cache", tokens.WordCache(PATH))
    offsets, ids = cache.encode(pa.array([text, None, text], pa.string()), 7)
    want = whole.encode(text, add_special_tokens=False).ids + [7]
    assert ids[: offsets[1]].tolist() == want and ids[offsets[2] :].tolist() == want and ids[offsets[1] : offsets[2]].tolist() == [7]


def test_small_cache_changes_nothing(monkeypatch, whole):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    cache = tokens.WordCache(PATH)
    for text in ("alpha beta gamma delta", "beta beta epsilon zeta", "alpha eta. theta, beta"):
        assert cache.encode(pa.array([text]), 1)[1].tolist() == whole.encode(text, add_special_tokens=False).ids + [1]


# --- token files ---------------------------------------------------------------------


def test_token_files_round_trip(spark, whole):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r.doc_id: r for r in token_files.op5_token_files(spark, SF).collect()}
    at = 0
    for doc, text in docs:
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_selective_reads_touch_few_row_groups(spark):
    path = folder(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    token_files.write_token_files(docs, path, tokenizer=PATH, rows_per_file=200, layout={"parquet.block.size": "65536", "parquet.page.size": "8192"})
    every = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, path).collect()}
    some = token_files.read_tokens(spark, path, 400, 420)
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {i: every[i] for i in range(400, 421)}
    plan = token_files.read_tokens(spark, path, 400, 420, ("doc_id", "n_tokens"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,400)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    files = sorted(r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect())
    last = -1
    for file in files:
        found = pq.ParquetFile(file.removeprefix("file:").replace("///", "/"))
        meta = found.metadata
        column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        ids = next(v for k, v in column.items() if k.startswith("ids"))
        assert any("DICT" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in column["doc_id"].encodings
        assert meta.num_row_groups > 1 and ids.has_offset_index and column["doc_id"].has_column_index
        own = found.read(["doc_id"])["doc_id"].to_pylist()
        assert own == sorted(own) and own[0] > last
        last = own[-1]


def test_token_files_of_odd_input(spark):
    rows = [(3, None), (1, ""), (None, "b c"), (2, "a"), (2, "a"), (7, "word " * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    for given in (docs, docs.limit(0)):
        path = folder(spark)
        token_files.write_token_files(given, path, tokenizer=PATH)
        found = token_files.token_index(spark, path).orderBy("start").collect()
        assert [(r.doc_id, r.n_tokens) for r in found] == ([(None, 3), (1, 1), (2, 2), (2, 2), (3, 1), (7, 100_001)] if given is docs else [])


# --- packing -------------------------------------------------------------------------


def test_pieces_tile_documents_and_sequences(spark, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = packing.op10_packing(spark, SF).toPandas()
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in docs.items()}
    assert set(out.doc_id) == set(docs)
    for doc, part in out.groupby("doc_id"):
        at = 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == crc(ids[doc][at : at + p.length]) and p.doc_tokens == len(ids[doc])
            at += p.length
        assert at == len(ids[doc])
    assert sorted(set(out.sequence_id)) == list(range(out.sequence_id.max() + 1))
    order = []
    for _, part in out.groupby("sequence_id"):
        at = 0
        for p in part.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
            order.append((p.doc_id, p.start))
        assert at == part.sequence_length.iloc[0] <= 2048
    assert order == sorted(order)
    padded = out.groupby("sequence_id").first()
    assert padded.sequence_length.sum() / padded.padded_length.sum() > 0.97


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 4, 32])), min_size=1, max_size=12), st.integers(9, 20))
def test_cuts_are_cheapest(steps, width):
    at = np.concatenate(([0], np.cumsum([s for s, _ in steps])))
    penalty = np.array([0, *(p for _, p in steps)])
    penalty[-1] = 0

    def price(cuts):
        places = [0, *(at[c] for c in cuts)]
        gaps = np.diff(places)
        return None if gaps.max() > width else sum(width - gaps) + sum(penalty[c] for c in cuts)

    n = len(at) - 1
    every = [[i + 1 for i in range(n - 1) if bits >> i & 1] + [n] for bits in range(1 << (n - 1))]
    best = min(p for p in map(price, every) if p is not None)
    found = packing.best_cuts(at, penalty, width)
    assert price([int(np.searchsorted(at, c)) for c in found]) == best


def test_packing_of_odd_input(spark):
    rows = [(3, None), (1, ""), (None, "b c"), (2, "a."), (2, "a."), (7, "word" * 3 + " word" * 9000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, offset int")
    out = packing.pack(docs, tokenizer=PATH).toPandas()
    assert out.length.sum() == out.groupby(out.doc_id.fillna(-1)).doc_tokens.first().sum() + 3 and out.sequence_length.max() <= 2048
    assert packing.pack(docs.limit(0), tokenizer=PATH).count() == 0


# --- archives ------------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = warc.op1_warc(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        data = pages[r.page_id].html.encode()
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "response", None)


@pytest.fixture(scope="module")
def archived(spark):
    big, other = "x" * 1500, "é" * 600
    rows = [(i, f"http://www.A.com/{i % 7}" if i % 3 else "http://hot.org/?q=1#f", (big, other, f"s{i % 3}")[i % 3]) for i in range(1200)]
    rows += [(None, None, None), (5000, "https://u@b.c:8080/", big), (5000, "https://u@b.c:8080/", big), (7, "x\ny\t\x00", ""), (7, "x\ny\t\x00", ""), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, at int")
    path = folder(spark)
    captures = warc.write_archives(pages, path)
    return rows, pages, path, captures, warc.build_index(captures, path, lines=16, rows_per_file=300)


def test_every_capture_is_found_by_the_index(spark, archived):
    rows, pages, path, captures, index = archived
    assert index.count() > 2 and index.agg(F.sum("lines")).first()[0] == len(rows)
    found = warc.read_records(warc.lookup(pages, index, path), path).collect()
    assert len(found) == len(rows) and all(r.verified for r in found)
    stored = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            stored[data] = max(page, stored.get(data, page))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = data in stored and page != stored[data]
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", stored[data] if revisit else None))
    key = lambda x: tuple(map(str, x))
    assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=key) == sorted(want, key=key)


def test_lookup_of_absent_and_single_captures(spark, archived):
    _, pages, path, _, index = archived
    asked = spark.createDataFrame([("http://a.com/1", 1), ("http://a.com/1", 2), ("zzz", 1), ("", 9)], "url string, page_id long")
    found = warc.read_records(warc.lookup(asked, index, path), path).collect()
    assert [r.page_id for r in found] == [1]


def test_archives_of_no_pages(spark, archived):
    pages, path = archived[1].limit(0), folder(spark)
    index = warc.build_index(warc.write_archives(pages, path), path)
    assert warc.read_records(warc.lookup(pages, index, path), path).count() == 0


def test_keys_sort_by_domain():
    urls = ["http://www.example.com/b", "https://example.com:443/a?x", "http://blog.example.com", "http://user@Example.org:8080/p#f", None]
    assert [warc.reversed_host(u) for u in urls] == ["com,example)/b", "com,example)/a?x", "com,example,blog)/", "org,example:8080)/p", ""]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.integers(-5, 5)), max_size=20))
def test_index_lines_order_ids(pairs):
    rnd = random.Random(0)
    rnd.shuffle(pairs)
    same = [p for k, p in pairs]
    assert sorted(same) == [int(line.rpartition("\t")[2]) - (1 << 63) for line in sorted(warc.index_line("k", p) for p in same)]
