"""BPE encoding and decoding (operator 5).

Each word is merged by the priority queue of ``vocab.Vocabulary.word``;
words repeat, so each Python worker keeps a bounded table of words it has
encoded and looks all words of a batch up at once.  A full table is
emptied, which changes speed but no result.  Decoding joins the
vocabulary strings of the ids.

Defined results: a null text counts as empty and gives no ids; an empty
text decodes to the empty string; texts of any length are encoded whole;
repeated rows each give their own row; a null doc_id stays null; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import ids_text, process_cache, rows_of, small_batches
from .tokens import FastIds, batches_of_texts, ragged
from .vocab import Vocabulary, vocabulary

CHUNK = 1 << 18                 # ids turned into strings at once


class Strings:
    """Byte strings by number, joined by blanks with one gather."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) + 1 for s in strings])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b" ".join(strings) + b" ", np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """With a blank after each."""
        return self.flat[ragged(self.starts[ids], self.sizes[ids])].tobytes()

    def sha256(self, ids: np.ndarray) -> str:
        sha = hashlib.sha256()
        for at in range(0, len(ids), CHUNK):
            got = self.joined(ids[at:at + CHUNK])
            sha.update(got if at + CHUNK < len(ids) else got[:-1])
        return sha.hexdigest()


class Codec:
    def __init__(self, path: str):
        self.vocab: Vocabulary = vocabulary(path)
        strings = [self.vocab.strings.get(i, "") for i in range(self.vocab.size)]
        self.numbers = Strings([str(i).encode() for i in range(self.vocab.size)])
        self.strings = Strings([s.encode() for s in strings])
        self.encoder = FastIds(self.vocab, self._merge)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.vocab.word(w.decode()) for w in words]
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


def codec(path: str) -> Codec:
    return process_cache(f"codec {path}", lambda: Codec(path))


def encode_decode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches):
        import pyarrow as pa
        c = codec(vocab_path)
        for got in batches_of_texts(batches):
            ids = c.encoder.texts([t for _, t in got])
            yield pa.record_batch([
                pa.array([d for d, _ in got], pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([c.numbers.sha256(i) for i in ids], pa.string()),
                pa.array([c.strings.sha256(i) for i in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(ids_text()).transform(small_batches).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids: the operator's full output."""

    def run(batches):
        import pyarrow as pa
        c = codec(vocab_path)
        for got in batches_of_texts(batches):
            ids = c.encoder.texts([t for _, t in got])
            yield pa.record_batch([pa.array([d for d, _ in got], pa.int64()),
                                   pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))],
                                  names=["doc_id", "ids"])

    return docs.select(ids_text()).transform(small_batches).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (null ids: empty text)."""

    def run(batches):
        import pyarrow as pa
        vocab = vocabulary(vocab_path)
        for b in batches:
            got = [(d, vocab.decode(ids or [])) for d, ids in rows_of([b], ["doc_id", "ids"])]
            yield pa.record_batch([pa.array([x[0] for x in got], pa.int64()),
                                   pa.array([x[1] for x in got], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(small_batches).mapInArrow(run, "doc_id long, text string")
