"""Statistics of texts, computed for a batch of texts at once inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import process_cache, small_batches, text_slices
from .runs import Powers, hashes

NAMES = ["log_chars", "log_words", "mean_word", "max_word", "upper", "digit", "stops", "marks", "bangs", "bars", "signs",
         "newlines", "distinct_words", "repeated_next", "short_words", "mark_words", "top_word", "distinct_lines",
         "mean_line", "marked_ends"]

_SPACE, _LETTER, _DIGIT, _STOP, _MARK = range(5)


class Tables:
    def __init__(self):
        chars = [chr(c) for c in range(0x250)]
        self.kind = np.array([_SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit()
                              else _STOP if c in ".,;:" else _MARK for c in chars], np.uint8)
        self.upper = np.array([c.isupper() for c in chars])
        self.powers = Powers()


def _per_text(values, edges):
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[edges[1:]] - total[edges[:-1]]).astype(float)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for one without words."""
    t = process_cache("text statistics tables", Tables)
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])          # a newline closes each text
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x250
    small = np.where(low, codes, 0)
    kind = np.where(low, t.kind[small], _LETTER)
    space = kind == _SPACE
    chars = np.maximum(sizes, 1)
    letters = np.maximum(_per_text(kind == _LETTER, edges), 1)

    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    lengths = ends - starts
    text_of = np.searchsorted(edges, starts, side="right") - 1
    words = np.bincount(text_of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    h = hashes(codes, starts, ends, t.powers, which=(0,))[0]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    order = np.lexsort((h, text_of))
    hs, ts = h[order], text_of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    firsts = np.flatnonzero(fresh)
    times = np.diff(np.append(firsts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, ts[firsts], times)
    longest = np.zeros(n)
    np.maximum.at(longest, text_of, lengths)
    last = kind[np.maximum(ends - 1, 0)]

    newline = codes == 10
    breaks = np.flatnonzero(newline)
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    full = breaks > line_starts
    ls, le = line_starts[full], breaks[full]
    line_text = np.searchsorted(edges, ls, side="right") - 1
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    lh = hashes(codes, ls, le, t.powers, which=(0,))[0]
    pairs = np.unique(np.stack([line_text.astype(np.uint64), lh], 1), axis=0)[:, 0].astype(np.int64) if len(lh) else []
    distinct_lines = np.bincount(pairs, minlength=n)

    by = lambda values: np.bincount(text_of, values, minlength=n) / some
    out = np.stack([
        np.log1p(sizes), np.log1p(words), by(lengths), np.minimum(longest, 200),
        _per_text(low & t.upper[small], edges) / letters, _per_text(kind == _DIGIT, edges) / chars,
        _per_text(kind == _STOP, edges) / chars, _per_text(kind == _MARK, edges) / chars,
        _per_text(codes == ord("!"), edges) / chars, _per_text(codes == ord("|"), edges) / chars,
        _per_text(np.isin(codes, [ord(c) for c in "#$%&*"]), edges) / chars,
        (_per_text(newline, edges) - 1) / chars, np.bincount(ts[firsts], minlength=n) / some, by(same), by(lengths <= 2),
        by((last >= _STOP) & (lengths == 1)), top / some, distinct_lines / lines, sizes / lines, by(last == _MARK)], 1)
    out[words == 0] = 0
    return np.round(out, 9)


STATS = "_stats"


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with the array ``_stats`` of the statistics of ``text`` (null: empty)."""
    kinds = T.StructType([*rows.schema.fields, T.StructField(STATS, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa
        for b, texts in text_slices(batches):
            got = pa.FixedSizeListArray.from_arrays(pa.array(statistics(texts).ravel()), len(NAMES))
            yield pa.record_batch([*b.columns, got.cast(pa.list_(pa.float64()))], names=[*b.schema.names, STATS])

    return rows.transform(small_batches).mapInArrow(run, kinds)
