"""Fill-in-the-middle transformation with a wavelet matrix (operator 11).

The UTF-8 bytes of a batch of texts are mapped to character classes, and a
wavelet matrix over the classes answers rank queries.  Sums of ranks count
the units (code points, words or lines) that start before a byte, and
bisection on these counts finds the bytes at which prefix and middle end,
for all texts of the batch at once.  Nothing is decoded and no array of
characters is built.

Where a document is cut and which form it takes follows from the sha256 of
its id alone, so a rerun of a lost task gives the same rows.

Defined results: a null text counts as empty and stays plain; a text that
holds one of the three marks stays plain, so an output can be told apart;
a row without an id is cut as by the id '' (sha256 of ``1:``); rows that
repeat an id are cut each on its own by the same four numbers; a text of any
length is one piece of work, in memory in proportion to its bytes; an empty
table gives an empty table; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitvector import WaveletMatrix
from .common import ids_text, slices, small_batches, utf8_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 90                # of 100 documents, those not left plain
SPM_PERCENT = 20                # of 100 transformed ones, those with the suffix first

# Classes of a byte: a byte inside a character; line feed; other white space;
# the first byte of another character, at the start of a word or inside one.
INSIDE, LINE_FEED, SPACE, WORD_START, IN_WORD = range(5)
DEPTH = 3

#: The classes at which a unit starts, or after which one does (lines).
UNITS = {"chars": (LINE_FEED, SPACE, WORD_START, IN_WORD), "words": (WORD_START,), "lines": (LINE_FEED,)}


def _table() -> np.ndarray:
    out = np.full(256, IN_WORD, np.uint8)
    out[0x80:0xC0] = INSIDE
    out[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    out[0x0A] = LINE_FEED
    return out


_CLASS = _table()


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that begin at ``starts``."""
    out = _CLASS[data]
    blank = (out == SPACE) | (out == LINE_FEED)
    after = np.empty(len(data), bool)
    after[1:] = blank[:-1]
    after[starts[starts < len(data)]] = True
    out[after & (out == IN_WORD)] = WORD_START
    return out


class Cutter:
    """Units of texts that lie one after the other in ``data``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, units: str):
        self.starts, self.ends, self.units = bounds[:-1], bounds[1:], units
        self.matrix = WaveletMatrix(classes(data, self.starts), DEPTH)
        self.before = self.matrix.rank_of(UNITS[units], self.starts)
        marks = self.matrix.rank_of(UNITS[units], self.ends) - self.before
        # lines: a rest without a line feed at its end is a line as well; words: white space
        # before the first word belongs to the first unit, a blank text is one unit
        if units == "lines":
            open_end = (self.ends > self.starts) & (data[np.maximum(self.ends, 1) - 1] != 0x0A) if len(data) else np.zeros(len(marks), bool)
            self.n = marks + open_end
        elif units == "words":
            self.n = np.where(self.ends > self.starts, np.maximum(marks, 1), 0)
        else:
            self.n = marks

    def byte_of(self, k: np.ndarray) -> np.ndarray:
        """The byte at which ``k`` units of each text end."""
        if self.units == "lines":                               # the byte after the k-th line feed
            return np.where(k == 0, self.starts, self.matrix.select(UNITS["lines"], self.before + k, self.starts, self.ends))
        # the byte with unit k + 1 at it: one unit more lies before the next byte
        at = self.matrix.select(UNITS[self.units], self.before + k + 1, self.starts, self.ends) - 1
        return np.where(k == 0, self.starts, np.where(k >= self.n, self.ends, at))

    def chars(self, i: np.ndarray) -> np.ndarray:
        """Code points before each byte."""
        return self.matrix.rank_of(UNITS["chars"], i)


def _cut_task(units: str):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").fill_null("")
            data, bounds = utf8_of(texts)
            cutter = Cutter(data, bounds, units)
            h = [part.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            n = cutter.n
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            first, second = cutter.byte_of(np.minimum(one, two)), cutter.byte_of(np.maximum(one, two))
            chars = [cutter.chars(i) for i in (cutter.starts, first, second)]
            plain = (cutter.starts == cutter.ends) | (h[2] % 100 >= FIM_PERCENT)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            spm = h[3] % 100 < SPM_PERCENT
            out = []
            for is_plain, is_spm, at, i, j, end in zip(plain, spm, cutter.starts, first, second, cutter.ends):
                if is_plain:
                    out.append(data[at:end].tobytes())
                    continue
                prefix, middle, suffix = marks[0] + data[at:i].tobytes(), marks[2] + data[i:j].tobytes(), marks[1] + data[j:end].tobytes()
                out.append(suffix + prefix + middle if is_spm else prefix + suffix + middle)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n, pa.int64()),
                pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return cut


def transform(docs: DataFrame, units: str = "chars") -> DataFrame:
    """doc_id, n (units of the text), form, prefix_chars, middle_chars, output of every row.

    ``units`` are the places where a text may be cut: between code points
    (``chars``), before words (``words``; white space stays with the word
    before it) or after line feeds (``lines``).
    """
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(ids_text()).select(
        "doc_id", "text", *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    return small_batches(rows).mapInArrow(
        _cut_task(units), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form"):
    """The exact text, from an output and its form alone.

    The pieces hold no mark, and no mark overlaps the start of another, so
    the marks of an output are where it splits.
    """
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(F.col(output)))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
