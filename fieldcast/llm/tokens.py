"""Token ids of texts with a vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldcast.llm.common import add_columns

VOCABULARY = "word_bpe_49k.json"
#: Marks that the vocabulary's splitting parts as one run from the letters before them.
MARKS = ".,;:!?*#$%&|<>()[]{}=+-/\\\"_~^@"
#: Words a task remembers before it starts anew; bounds the memory of a task, never the result.
CACHED_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache(dict):
    """Ids of a word as little-endian bytes.

    For vocabularies that never join across a space or line feed, split letters from a run of marks behind
    them and take no notice of case, so that the ids of a text are those of its words in a row.  Such is the word-end vocabulary used here; the
    tests compare with the encoding of whole texts.  A full cache becomes the old one, from which words that come again
    are taken over, so that frequent words stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Bytes as the letters of a byte-level vocabulary: printable ones stand for themselves, others follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.compute(word)
        self[word] = found
        return found

    def compute(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem.isalpha() and stem.lower().isalpha():
            return self[stem] + self[word[len(stem):]]
        low = word.lower()
        if low.isascii() and low.isalpha():
            if low != word:
                return self[low]
            ids = [t.id for t in self.model.tokenize(low)]
        elif low.isalpha() and max(word) < "\u0250" and unicodedata.is_normalized("NFC", word):
            if low != word:
                return self[low]
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in low.encode()]))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids if word else []
        return array("I", ids).tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and all their ids in a row, ``end_id`` behind each text; a null text is empty.

        A word of the slice is looked up once, however often it stands there.
        """
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        texts = texts.cast(pa.string()).fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the names of special tokens alone heed case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        found = [self[w] for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        word = np.asarray(coded.indices)
        count = lengths[word]
        before = np.concatenate(([0], np.cumsum(count)))
        per_text = before[ends - ends[0]]
        offsets = per_text + np.arange(len(per_text))
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        inside = np.arange(int(before[-1])) - np.repeat(before[:-1], count)
        taken = ids[np.repeat((np.cumsum(lengths) - lengths)[word], count) + inside]
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = taken
        return offsets, out


def encode_column(df: DataFrame, column: str, name: str, end_id: int, path: str) -> DataFrame:
    """``df`` with ``name``: the ids of ``column`` (null: of the empty text) and ``end_id`` behind them."""

    def make():
        words = WordCache(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            offsets, ids = words.encode(texts, end_id)
            values = pa.array(ids.view(np.int32), pa.int32())
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)]

        return work

    return add_columns(df, column, [T.StructField(name, T.ArrayType(T.IntegerType(), True), False)], make)
