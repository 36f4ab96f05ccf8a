"""Operator 4: personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans.  Around them a random field labels every *mention* of a text: a number with its separators, or
a word with an ``@``.  Its potentials are

* node: how a mention looks (digits, separators, letters, length), by multinomial regression;
* chain: the labels of neighbouring mentions not farther apart than ``NEAR`` characters;
* skip: the labels of distant mentions that repeat one another, that is, share their last nine digits or the local part of an
  address.  Each mention is tied to the previous one with the same key, so a key that stands a thousand times in a text adds a
  thousand links, not half a million.

Mentions that a base span covers are observed.  Loopy belief propagation then carries their labels along skip links, so that a
number without its plus sign or an address cut short is found where the text holds it in full elsewhere.  A mention whose label is
more probable than ``LEAST`` becomes a span; base spans always stay.

The field is trained on the whole table with the base spans as labels: shapes, chain and skip pairs are counted inside tasks and
added up.  Shapes are made of bounded parts, so the counts stay small however large the table is, and are all that reaches the driver.

Nulls and odd input: a null text is empty and has no spans; texts of any length are read whole; repeated rows give the same spans; an
empty table trains a field that adds nothing.  Other columns pass through ``annotate`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import add_columns, arrow, fresh, pieces, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
NEAR = 3
LEAST = 0.5
ROUNDS = 20
#: Log odds that mentions which repeat one another have the same label.
AGREEMENT = 8.0

# Fixed patterns of the base.  A look-behind keeps an address from being tried inside a run of digits that failed as a whole.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MENTION = re.compile(r"[^\s@]{0,64}@[^\s@]{0,255}|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")

Span = tuple[int, int, str]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run of its characters before an ``@``, as far as no earlier match holds it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(small(p) for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def told(spans: Iterable[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


class Mentions:
    """The graph of one text: mentions, their labels by base spans (-1: none), shapes, chain and skip links."""

    def __init__(self, text: str, base: list[Span]):
        self.spans = [m.span() for m in MENTION.finditer(text)]
        self.labels, self.shapes, keys = [], [], []
        k = 0
        for a, b in self.spans:
            while k < len(base) and base[k][1] <= a:
                k += 1
            near = [s for s in base[k : k + 4] if s[0] < b and s[1] > a]
            self.labels.append(LABELS.index(near[0][2]) if near else -1)
            self.shapes.append(shape(text[a:b]))
            keys.append(repeat_key(text[a:b]))
        self.chain = [i for i in range(1, len(self.spans)) if self.spans[i][0] - self.spans[i - 1][1] <= NEAR]
        last: dict[str, int] = {}
        self.skip = []
        for i, key in enumerate(keys):
            if key:
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i


def shape(mention: str) -> str:
    """What a mention looks like, in parts with few values each."""
    digits = digits_of(mention)
    n, dots = len(digits), mention.count(".")
    many = "0" if n == 0 else "s" if n < 7 else "m" if n < 10 else "p" if n < 14 else "c" if n < 20 else "l"
    at = "@" in mention
    return "".join((
        many, str(min(dots, 4)), "+" if "+" in mention else "-", "(" if "(" in mention else "-", "_" if " " in mention or "-" in mention else "-",
        "@" if at else "-", "d" if at and "." in mention.rpartition("@")[2].strip(".") else "-", "l" if at and mention[0] != "@" else "-",
        "v" if many == "c" and luhn(digits) else "-",
    ))


def repeat_key(mention: str) -> str | None:
    """What repeated mentions have in common; none for short ones, which repeat by chance."""
    if "@" in mention:
        local = LOCAL.findall(mention.partition("@")[0])
        return "@" + local[-1].lower() if local and len(local[-1]) >= 4 else None
    digits = digits_of(mention)
    return digits[-9:] if len(digits) >= 9 else None


def features(shapes: list[str]) -> np.ndarray:
    """Bits of shapes: each part has a fixed list of values."""
    parts = ("0smpcl", "01234", "+-", "(-", "_-", "@-", "d-", "l-", "v-")
    rows = [[float(s[i] == v) for i, values in enumerate(parts) for v in values] + [1.0] for s in shapes]
    return np.array(rows).reshape(len(rows), sum(map(len, parts)) + 1)


def count_text(text: str, counts: Counter) -> None:
    found = Mentions(text, base_spans(text))
    labels = [max(x, 0) for x in found.labels]
    for s, y in zip(found.shapes, labels):
        counts["node", s, y, 0] += 1
    for i in found.chain:
        counts["chain", "", labels[i - 1], labels[i]] += 1
    for i, j in found.skip:
        counts["skip", "", labels[i], labels[j]] += 1


def train_counts(docs: DataFrame) -> Counter:
    """How often each shape has each label, and each link each pair of labels, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column(0).to_pylist():
                    if text:
                        count_text(text, counts)
        rows = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "shape", "y", "z", "n"])

    found = arrow(docs.select("text")).mapInArrow(run, "part string, shape string, y int, z int, n long")
    return Counter({tuple(r)[:4]: r["n"] for r in found.groupBy("part", "shape", "y", "z").agg(F.sum("n").alias("n")).collect()})


class Field:
    """Log potentials of a trained skip-chain field."""

    def __init__(self, counts: Counter, steps: int = 300):
        size = len(LABELS)
        shapes = sorted({k[1] for k in counts if k[0] == "node"})
        weight = np.zeros((len(shapes), size))
        pairs = {"chain": np.ones((size, size)), "skip": np.ones((size, size))}
        for (part, name, y, z), n in counts.items():
            if part == "node":
                weight[shapes.index(name), y] += n
            else:
                pairs[part][y, z] += n
        self.theta = self.regress(features(shapes), weight, steps) if shapes else None
        self.chain, self.skip = (self.gain(m) for m in (pairs["chain"], pairs["skip"]))
        # Mentions that repeat one another share a potential for equal labels, which counts where the table shows few pairs.
        self.skip = self.skip + AGREEMENT * np.eye(size)

    @staticmethod
    def gain(pairs: np.ndarray) -> np.ndarray:
        """How much likelier a pair of labels is than its parts, symmetric and bounded."""
        both = pairs + pairs.T
        share = both / both.sum()
        alone = share.sum(axis=0)
        return np.clip(np.log(share / np.outer(alone, alone)), -4, 4)

    @staticmethod
    def regress(x: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
        """Multinomial regression with a small ridge by accelerated gradient steps of fixed number and size."""
        theta = ahead = np.zeros((x.shape[1], weight.shape[1]))
        scale = np.sqrt(weight.sum())
        mass = weight / max(1.0, weight.sum()) * scale
        rate = 2.0 / (np.linalg.norm(x.T @ (x * mass.sum(axis=1, keepdims=True)), 2) + 1e-2)
        for k in range(steps):
            p = softmax(x @ ahead)
            slope = x.T @ (mass.sum(axis=1, keepdims=True) * p - mass) + 1e-2 * ahead
            step = ahead - rate * slope
            ahead, theta = step + k / (k + 3) * (step - theta), step
        return theta

    def marginals(self, graphs: list[Mentions]) -> np.ndarray:
        """Label probabilities of all mentions of ``graphs`` by loopy belief propagation, damped, over all texts at once."""
        first = np.cumsum([0] + [len(g.spans) for g in graphs])
        labels = np.array([y for g in graphs for y in g.labels], np.int64)
        if self.theta is None or not len(labels):
            return np.eye(len(LABELS))[np.maximum(labels, 0)]
        node = features([s for g in graphs for s in g.shapes]) @ self.theta
        node -= node.max(axis=1, keepdims=True)
        seen = labels >= 0
        node[seen] = -30.0
        node[seen, labels[seen]] = 0.0
        kinds: dict[tuple[int, int], int] = {(at + i - 1, at + i): 0 for g, at in zip(graphs, first) for i in g.chain}
        for at, g in zip(first, graphs):
            for i, j in g.skip:
                kinds[at + i, at + j] = 2 if (at + i, at + j) in kinds else 1  # one link with both potentials
        if not kinds:
            return softmax(node)
        a, b = np.array(list(kinds), np.int64).T
        kind = np.array(list(kinds.values()), np.int64)
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        gain = np.stack((self.chain, self.skip, self.chain + self.skip))[np.concatenate((kind, kind))]
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, target, message)
            inner = (belief[source] - message[back])[:, :, None] + gain
            top = inner.max(axis=1)
            new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - message).max() < 1e-6:
                break
            message = 0.5 * message + 0.5 * new
        belief = node.copy()
        np.add.at(belief, target, message)
        return softmax(belief)

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text."""
        bases = [base_spans(t) for t in texts]
        graphs = [Mentions(t, base) for t, base in zip(texts, bases)]
        p = self.marginals(graphs)
        out, at = [], 0
        for text, base, graph in zip(texts, bases, graphs):
            added = []
            for i, (a, b) in enumerate(graph.spans):
                best = int(p[at + i].argmax())
                if graph.labels[i] < 0 and best and p[at + i, best] > LEAST:
                    added.append((a, a + len(text[a:b].rstrip(".,;:!?)>\"'")), LABELS[best]))
            at += len(graph.spans)
            out.append((base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> Field:
    return Field(train_counts(docs))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


RESULT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def annotate(docs: DataFrame, field: Field | None = None, *, clean_text: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with a struct column of counts, digest and spans, and if asked for one of the redacted text; and their names."""
    names = fresh(docs, "personal", "redacted")[: 1 + clean_text]
    sent = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def make():
        model = sent.value

        def work(texts: pa.Array) -> list[pa.Array]:
            given = texts.to_pylist()
            found = model.spans([t or "" for t in given])
            rows = [(*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)) for base, spans in found]
            columns = list(zip(*rows)) or [()] * len(RESULT)
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            out: list[pa.Array] = [pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=RESULT.names)]
            if clean_text:
                out.append(pa.array([t if not s else redact(t, s) for t, (_, s) in zip(given, found)], pa.string()))
            return out

        return work

    kinds = [RESULT, T.StringType()]
    return add_columns(docs, "text", [T.StructField(n, k) for n, k in zip(names, kinds)], make), names


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found, (name,) = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.col(name)[c].alias(c) for c in RESULT.names))
