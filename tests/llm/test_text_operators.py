"""Operators that judge or change single texts, against plain Python written from their definitions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldcast.llm import decontamination as dec
from fieldcast.llm import licenses, pii, quality

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, contamination string, hits int, measured int, quality_verdict int, personal int, redacted string"


def odd_rows(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3, 4, "r") for i, t in texts], ODD)


# --- decontamination -----------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_contamination(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, named = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p : p + m] == own[i : i + m]:
                    hit.update(range(p, p + m))
                    named.add(item)
    return len(words), len(hit), named


def test_every_document_against_every_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").collect()]
    found = {r.doc_id: r for r in dec.op2_decontamination(spark, SF).collect()}
    assert sum(r.contaminated for r in found.values()) >= 1
    some = docs[docs.doc_id.map(lambda i: found[i].n_hit > 0 or i % 20 == 0)]
    for doc in some.itertuples():
        n, hit, named = plain_contamination(doc.text[:6000], items) if len(doc.text) <= 6000 else (None, None, None)
        if n is not None:
            r = found[doc.doc_id]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(named))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 6))
def test_search_finds_every_occurrence(words, items, window):
    given_items = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    found = dec.occurrences(" ".join(words), dec.compile_items(given_items, window))
    n, hit, named = plain_contamination(" ".join(words), given_items, window)
    assert found["n_words"] == n and sum(s["last"] - s["first"] for s in found["spans"]) == hit and set(found["items"]) == named


def test_decontamination_of_odd_input(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = odd_rows(spark, [(1, None), (2, ""), (None, passage.upper()), (4, "x " * 300 + passage), (4, "x " * 300 + passage), (5, "short q1"), (6, "é, É")])
    items = spark.createDataFrame([("b", passage), ("a", passage + " tail"), ("b", passage), ("s", "Short Q1"), ("n", None), (None, ""), ("e", "...")], "item_id string, text string")
    out, name = dec.annotate(docs, items)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 7
    rows = {(r.doc_id, r.text): r[name] for r in out.collect()}
    assert rows[1, None].n_words == 0 and not rows[2, ""].contaminated
    assert rows[None, passage.upper()].contaminated and rows[None, passage.upper()]["items"] == ["a", "b"]
    assert rows[4, "x " * 300 + passage].n_hit == 13 and not rows[4, "x " * 300 + passage].contaminated
    assert rows[5, "short q1"]["items"] == ["s"] and rows[6, "é, É"].n_words == 2
    none, name = dec.annotate(docs, items.limit(0))
    assert none.where(F.col(name)["contaminated"]).count() == 0
    assert dec.annotate(docs.limit(0), items)[0].count() == 0


def test_items_in_blocks_give_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, a = dec.annotate(docs, items)
    many, b = dec.annotate(docs, items, limit=3000)
    assert sorted(one.select("doc_id", a).collect()) == sorted(many.select("doc_id", F.col(b).alias(a)).collect())


# --- quality -------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality_measures_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = quality.op9_quality(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        want = plain_measures(docs[r.doc_id])
        assert tuple(r[f] for f in quality.FIELDS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é \x1c中", max_size=80))
def test_quality_measures_of_any_text(text):
    data = text.encode()
    assert quality.measures(data, data.split()) == plain_measures(text)


def test_junk_goes_and_trusted_text_stays(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.op9_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    share = {(r.quality): r.kept for r in out.groupBy("quality").agg(F.avg((F.col("kept") | F.col("base_failed")).cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.6


def test_labelled_junk_that_passes_the_base_rules_goes(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]

    def text(broken, n):
        return " ".join(w + "%*" if rnd.random() < broken else w for w in rnd.choices(words, k=n))

    rows = [(i, text(0.0, rnd.randint(80, 200)), 1) for i in range(600)] + [(i, text(0.35, rnd.randint(80, 200)), 0) for i in range(600, 680)]
    # Trusted by label, but failing the base rules: their scores must not set the threshold.
    rows += [(i, text(0.9, 40), 1) for i in range(680, 690)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    out, name = quality.annotate(docs, labels)
    found = {r.doc_id: r.v for r in out.select("doc_id", F.col(name).alias("v")).collect()}
    assert all(found[i].kept for i in range(600))
    assert not any(found[i].base_failed or found[i].kept for i in range(600, 680))
    assert all(found[i].base_failed for i in range(680, 690))


def test_score_of_a_text_left_out_of_the_fit():
    raw, trusted, found = np.array([8, 2, 3]), np.array([4, 1, 2]), np.array([0, 0, 2])
    want = quality.ratios(raw, trusted - np.bincount(found, minlength=3))[found].mean()
    assert quality.left_out(found, raw, trusted) == pytest.approx(want)


def test_quality_of_odd_input(spark):
    good = " ".join(f"word{i % 97} text{i % 89}" for i in range(80))
    docs = odd_rows(spark, [(1, None), (2, ""), (None, good), (4, good), (4, good), (5, " \n\t ")])
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 1, 0), (9, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out, name = quality.annotate(docs, labels)
    rows = out.select("doc_id", "text", F.col(name).alias("v")).collect()
    assert len(rows) == 6 and out.columns[: len(docs.columns)] == docs.columns
    assert all(r.v.kept == (r.text == good) for r in rows)
    unlabelled, name = quality.annotate(docs, labels.limit(0))
    assert unlabelled.where(F.col(name)["kept"]).count() == 3
    assert quality.annotate(docs.limit(0), labels)[0].count() == 0


def test_ratio_by_hand():
    raw, trusted = np.array([8, 2, 0]), np.array([1, 5, 0])
    w = quality.ratios(raw, trusted)
    assert w == pytest.approx(np.log([(2 / 9) / (9 / 13), (6 / 9) / (3 / 13), (1 / 9) / (1 / 13)]))


# --- personal data -------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+1 92()4_é%", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = pii.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs) and sum(r.n_email for r in found) > 5
    for r in found:
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.told(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in pii.KINDS]
        assert {s for s in pii.told(want).split(",")} <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_repeated_mentions_follow_the_full_one(field):
    text = "call +1 (988) 555-2485 now. Much later 988-555-2485; joe.smith@x.example.com or joe.smith@x, order 12345678901"
    base, spans = field.spans([text])[0]
    found = {text[a:b]: k for a, b, k in spans}
    assert found == {"+1 (988) 555-2485": "phone", "988-555-2485": "phone", "joe.smith@x.example.com": "email", "joe.smith@x": "email"}
    assert set(base) <= set(spans)


def test_clean_texts_get_no_spans(field):
    clean = ["In 1999 there were 12 345 678 of 9, at 3.14 or 1.2.3", "order 12345678901 and order 12345678901", "@ home @ 5", ""]
    assert all(not spans for _, spans in field.spans(clean))


def test_messages_agree_with_enumeration(field):
    text = "+1 (988) 555-2485; 988-555-2485; 9885552485 and 77"
    graph = pii.Mentions(text, pii.base_spans(text))
    p = field.marginals([graph])
    node = pii.features(graph.shapes) @ field.theta
    n, size = len(graph.spans), len(pii.LABELS)
    weight = np.zeros((n, size))
    for state in np.ndindex(*[size] * n):
        if all(y in (-1, s) for y, s in zip(graph.labels, state)):
            e = sum(node[i, s] for i, s in enumerate(state)) + sum(field.chain[state[i - 1], state[i]] for i in graph.chain)
            e += sum(field.skip[state[i], state[j]] for i, j in graph.skip)
            for i, s in enumerate(state):
                weight[i, s] += np.exp(e)
    exact = weight / weight.sum(axis=1, keepdims=True)
    assert (p.argmax(axis=1) == exact.argmax(axis=1)).all() and np.abs(p - exact).max() < 1e-3 and n == 4


def test_personal_data_of_odd_input(spark):
    long_digits = "1" * 200_000
    docs = odd_rows(spark, [(1, None), (2, ""), (None, "a@b.c"), (4, "a@b.c"), (4, "a@b.c"), (5, long_digits), (6, "é 10.0.0.1 " * 3)])
    out, (name, text) = pii.annotate(docs, clean_text=True)
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == 7 and out.columns[: len(docs.columns)] == docs.columns
    assert rows[1, None][text] is None and rows[1, None][name].spans == "" and rows[None, "a@b.c"][text] == "[EMAIL]"
    assert rows[6, "é 10.0.0.1 " * 3][text] == "é [IP] " * 3 and rows[5, long_digits][name].n_card == 0
    assert pii.annotate(docs.limit(0))[0].count() == 0


def test_redaction_of_overlapping_spans():
    assert pii.redact("x 4012888888881881 y", [(2, 18, "card"), (4, 12, "phone")]) == "x [CARD] y"


# --- licences ------------------------------------------------------------------------


def plain_dice(line, template):
    def grams(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return Counter(" ".join(w[i : i + 2]) for i in range(len(w) - 1)) if len(w) != 1 else Counter(w)

    a, b = grams(line), grams(template)
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_license_lines_against_all_templates(spark):
    rnd = random.Random(3)
    lines = [text for _, text in licenses.TEMPLATES]
    for _ in range(60):
        words = rnd.choice(lines[:20]).split()
        words[rnd.randrange(len(words))] = "other"
        lines.append(" ".join(words))
    lines += ["", "mit", "All rights", "license " * 50, "ALL RIGHTS RESERVED"]
    docs = spark.createDataFrame([(i, "some prose\n" + x, "m") for i, x in enumerate(lines)] + [(900, None, "m"), (901, "", "m")], "doc_id long, text string, words string")
    found = {(r.doc_id, r.line_no): (r.license, r.dice) for r in licenses.scan(docs).collect()}
    want = {}
    for i, x in enumerate(lines):
        scores = [(plain_dice(x, t), -k) for k, (_, t) in enumerate(licenses.TEMPLATES)]
        best, turn = max(scores)
        if best >= licenses.LEAST:
            want[i, 1] = (licenses.TEMPLATES[-turn][0], pytest.approx(best))
    assert found == want and len(want) > 30
    assert licenses.scan(docs.limit(0)).count() == 0
