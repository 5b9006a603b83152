"""Token ids of texts as bytes, and tables of token pieces.

Same ids as ``bpe`` gives, for operators that only need ids: all words of
a batch are found and hashed with array operations, and the words not
known yet are encoded in lock step, each step merging every word's
leftmost pair of lowest rank.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import ids_text, process_cache, small_batches, text_slices, written
from .runs import Powers, hashes
from .vocab import _L, _N, _S, NOT_LATIN, Vocabulary, vocabulary

WORD_TABLE = 1_000_000          # words kept per Python worker (about 60 bytes each)

NONE = 1 << 62
_APOSTROPHE = ord("'")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of each code point below U+0250, as the splitting pattern has it."""
    kinds = [(re.compile(f"[{c}]"), k) for c, k in ((_L, _LETTER), (_N, _DIGIT), (_S, _SPACE))]
    return np.array([next((k for rx, k in kinds if rx.match(chr(c))), _OTHER) for c in range(0x250)], np.uint8)


class LockStep:
    """BPE merges for many words at once."""

    WIDTHS = (8, 16, 32)

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        keys = np.fromiter(vocab.merge, np.int64, len(vocab.merge))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(NONE))
        self.found = np.append(np.fromiter(vocab.merge.values(), np.int64, len(keys))[order], 0)
        self.byte_id = np.array(vocab.byte_id)
        self.last_byte_id = np.array(vocab.last_byte_id)

    def pair(self, a, b):
        """rank << 20 | merged id of each pair, NONE where there is none."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (b >= 0), self.found[at], NONE)

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        counts = np.zeros(len(data), np.int64)
        parts = []
        least = 0
        for width in self.WIDTHS:
            chosen = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for at in range(0, len(chosen), 5_000):
                rows = chosen[at:at + 5_000]
                ids, counts[rows] = self._merge([data[i] for i in rows.tolist()], sizes[rows], width)
                parts.append((rows, ids))
        for i in np.flatnonzero(sizes > least).tolist():
            ids = np.array(self.vocab.word(data[i].decode("utf-8")), np.uint32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.uint32)
        for rows, ids in parts:
            out[ragged(starts[rows], counts[rows])] = ids
        return out, counts

    def _merge(self, data, sizes, width):
        n = len(data)
        raw = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in data]), np.uint8).reshape(n, width)
        place, every = np.arange(width), np.arange(n)
        inside = place < sizes[:, None]
        symbols = np.where(inside, self.byte_id[raw], -1)
        symbols[every, sizes - 1] = self.last_byte_id[raw[every, sizes - 1]]
        after = np.where(place + 1 < sizes[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        merges = np.full((n, width), NONE)
        merges[:, :-1] = self.pair(symbols[:, :-1], symbols[:, 1:])
        rows = every
        while len(rows):
            at = merges[rows].argmin(1)
            got = merges[rows, at]
            live = got < NONE
            rows, at, got = rows[live], at[live], got[live]
            if not len(rows):
                break
            right, new = after[rows, at], got & 0xFFFFF
            symbols[rows, at] = new
            symbols[rows, right] = -1
            merges[rows, right] = NONE
            merges[rows, at] = NONE
            far = after[rows, right]
            after[rows, at] = far
            k = far < width
            r, a, f = rows[k], at[k], far[k]
            before[r, f] = a
            merges[r, a] = self.pair(new[k], symbols[r, f])
            left = before[rows, at]
            k = left >= 0
            merges[rows[k], left[k]] = self.pair(symbols[rows[k], left[k]], new[k])
        kept = symbols >= 0
        return symbols[kept].astype(np.uint32), kept.sum(1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each pair, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class FastIds:
    """Ids of texts.  ``merge`` encodes the words not known yet: (ids in a row,
    number of each word's ids)."""

    def __init__(self, vocab: Vocabulary, merge=None, most: int = WORD_TABLE):
        self.vocab, self.merge, self.most = vocab, merge or LockStep(vocab).encode, most
        self.classes, self.powers = _classes(), Powers()
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)          # sorted, with check value and place of the ids
        self.checks = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if NOT_LATIN.search(t) or "<|" in t:
                out[k] = np.array(self.vocab.encode(t), np.uint32)
            else:
                plain.append(k)
        if plain:
            for k, ids in zip(plain, self._plain([texts[k].lower() for k in plain])):
                out[k] = ids
        return out

    def _words(self, codes):
        """Start and end of every word."""
        kind = self.classes[codes]
        before = np.empty_like(kind)
        before[0], before[1:] = _SPACE, kind[:-1]
        start = (kind != _SPACE) & ((kind == _DIGIT) | (kind != before))
        quotes = np.flatnonzero(start & (codes == _APOSTROPHE))
        if len(quotes):
            one, two = codes[quotes + 1], codes[quotes + 2]      # two blanks end the codes
            o = lambda c: ord(c)
            short = np.isin(one, [o("s"), o("t"), o("m"), o("d")])
            long = ((one == o("r")) | (one == o("v"))) & (two == o("e")) | (one == o("l")) & (two == o("l"))
            for chosen, size in ((short, 2), (long, 3)):
                at = quotes[chosen]
                start[at + 1] = False
                start[at + size] = kind[at + size] != _SPACE
        marks = np.flatnonzero(start | (kind == _SPACE) & (before != _SPACE))
        begins = start[marks]
        where = np.flatnonzero(begins)
        return marks[where], marks[where + 1]                    # a blank always follows

    def _plain(self, texts):
        joined = " ".join(texts) + "  "
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        starts, ends = self._words(codes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(sizes + 1) - sizes - 1
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        h, check = hashes(codes, starts, ends, self.powers)
        keys, example, word = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[example][word]).any():                # two words of one hash: the slow way
            return [np.array(self.vocab.encode(t), np.uint32) for t in texts]
        if len(self.keys) > self.most:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) & (self.checks[at] == check[example]) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            first = example[new]
            flat, counts = self.merge([joined[a:b].encode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            begin = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, flat])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.checks = np.concatenate([self.checks, check[first]])[order]
            self.starts = np.concatenate([self.starts, begin])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            at = np.searchsorted(self.keys, keys)
            hit = (self.keys[at] == keys) & (self.checks[at] == check[example])
            if not hit.all():                                    # as above, between batches
                return [np.array(self.vocab.encode(t), np.uint32) for t in texts]
        counts = self.counts[at][word]
        ids = self.flat[ragged(self.starts[at][word], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        cuts = total[np.searchsorted(starts, np.append(firsts, len(codes)))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def fast_ids(path: str) -> FastIds:
    return process_cache(f"fast ids {path}", lambda: FastIds(vocabulary(path)))


def batches_of_texts(batches):
    """Lists of (doc_id, text) of bounded size; null counts as empty."""
    for b, texts in text_slices(batches):
        yield list(zip(b.column("doc_id").to_pylist(), texts))


PIECES = ("part int, doc_id long, start long, length int, doc_tokens long, class int, pos long, before long, "
          "ids_crc32 long, ids binary")


def token_pieces(docs: DataFrame, vocab_path: str, window: int, end_id: int, quantum: int) -> DataFrame:
    """Every text's ids and ``end_id``, cut into pieces of ``window`` ids and a rest.

    A written table: part (the task that made the row), class (length in
    units of ``quantum``, rounded up), pos and before (pieces and ids of
    that class that the part had before), ids (little-endian, 32 bits).
    Both counts are fixed once the table is written.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = fast_ids(vocab_path)
        seen = np.zeros(window // quantum + 2, np.int64)
        tokens = np.zeros(window // quantum + 2, np.int64)
        for docs in batches_of_texts(batches):
            rows = []
            for (doc, _), ids in zip(docs, encoder.texts([t for _, t in docs])):
                data = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(data), window):
                    piece = data[start:start + window]
                    n = len(piece)
                    c = -(-n // quantum)
                    raw = piece.tobytes()
                    rows.append((part, doc, start, n, len(data), c, int(seen[c]), int(tokens[c]), zlib.crc32(raw), raw))
                    seen[c] += 1
                    tokens[c] += n
            cols = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                     pa.int64(), pa.binary()]
            for at in range(0, len(rows), 2000):
                yield pa.record_batch([pa.array(c[at:at + 2000], k) for c, k in zip(cols, kinds)],
                                      names=[x.split()[0] for x in PIECES.split(", ")])

    return written(docs.select(ids_text()).transform(small_batches).mapInArrow(run, PIECES), "pieces")
