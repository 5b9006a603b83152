"""Line deduplication by overlapping three-line windows (operator 4).

Every three consecutive lines are a window, known by 128 bits of hash.
The first occurrence of a window is the one with the smallest (doc_id,
position); every later occurrence covers its three lines.  Covered
positions of a document are merged and these lines are removed.  Only
DataFrame functions, no Python in the tasks.

The strict windows miss a shared passage of one or two lines.  With
``passage_words`` a run of fewer lines is a window too if it has more words
than that; the corpus pipeline asks for it, ``op4_line_windows`` and its SQL
twin do not.

A frequent window is first counted and reduced to its first occurrence
within each task, so no key's rows meet in one task; the way back from
windows to documents carries the repeated windows only.

Defined results: lines are split at newlines; a window of three blank
lines (white space only) never counts; a null text stays null and has no
lines; texts with fewer than three lines stay as they are (without
``passage_words``); a document
may lose all lines (its text is then empty); rows that repeat a doc_id
are taken apart by their text, the copies of one row keep the same lines,
as the first of them does; an empty table gives an empty table; further
columns are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_before, ids_text, rest_of

LINES = 3
PASSAGE_WORDS = 50              # a run of fewer lines needs more words than this


def _window_hashes(lines: str, n: int) -> str:
    """SQL: an array of (position, two hashes) of all windows that aren't blank."""
    parts = ", ".join(f"{lines}[p + {k}]" for k in range(n))
    back = ", ".join(f"{lines}[p + {k}]" for k in reversed(range(n)))
    blank = " AND ".join(f"{lines}[p + {k}] RLIKE '^[ \\\\t\\\\r\\\\f\\\\x0B]*$'" for k in range(n))
    return (f"filter(transform(sequence(0, greatest(size({lines}) - {n}, 0)), p -> IF(p + {n} > size({lines}) OR ({blank}), "
            f"NULL, named_struct('p', p, 'a', xxhash64({parts}), 'b', xxhash64('w', {back})))), w -> w IS NOT NULL)")


def _passage_hashes(lines: str, words: str, n: int, most: int) -> str:
    """SQL: as ``_window_hashes``, of the runs of ``n`` lines with more than ``most`` words."""
    parts = ", ".join(f"{lines}[p + {k}]" for k in range(n))
    back = ", ".join(f"{lines}[p + {k}]" for k in reversed(range(n)))
    count = " + ".join(f"{words}[p + {k}]" for k in range(n))
    return (f"transform(filter(sequence(0, greatest(size({lines}) - {n}, 0)), p -> p + {n} <= size({lines}) AND {count} > {most}), "
            f"p -> named_struct('p', p, 'a', xxhash64({n}, {parts}), 'b', xxhash64('w', {n}, {back})))")


def covered_lines(docs: DataFrame, n: int = LINES, passage_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, covered): the positions that later occurrences cover."""
    every = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    rows = every.where(F.size("lines") >= n)
    windows = rows.select("doc_id", "text_key", F.lit(n).alias("n"), F.expr(f"inline({_window_hashes('lines', n)})"))
    if passage_words is not None:
        counted = every.withColumn("words", F.expr("transform(lines, x -> regexp_count(x, '[^ \\t\\r\\f\\x0B]+'))"))
        for k in range(1, n):
            windows = windows.unionByName(counted.select(
                "doc_id", "text_key", F.lit(k).alias("n"), F.expr(f"inline({_passage_hashes('lines', 'words', k, passage_words)})")))
    first = windows.groupBy("a", "b").agg(
        F.min(F.struct(F.col("doc_id"), F.col("text_key"), F.col("p"))).alias("first"),
        F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b", "first")
    later = windows.join(first, ["a", "b"]).where(
        F.struct("doc_id", "text_key", "p") != F.col("first"))
    return (later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "n")).alias("at"))
            .select("doc_id", "text_key",
                    F.expr("array_distinct(flatten(transform(at, x -> sequence(x.p, x.p + x.n - 1))))").alias("covered")))


def with_counts(docs: DataFrame, n: int = LINES, passage_words: int | None = None) -> DataFrame:
    """rest (the other columns), doc_id, text without covered lines, n_lines, n_removed of every row."""
    covered = covered_lines(docs.select(ids_text()), n, passage_words).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("covered"))
    rows = docs.select(rest_of(docs, "text"), *ids_text())
    joined = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left")
    lines = "split(text, '\\n', -1)"
    # array_except keeps the order and takes time in proportion to both lengths
    kept = f"array_join(transform(array_except(sequence(0, size({lines}) - 1), covered), i -> {lines}[i]), '\\n')"
    return joined.select(
        "rest", "doc_id", F.expr(f"IF(text IS NULL, 0, size({lines}))").cast("long").alias("n_lines"),
        F.expr("IF(covered IS NULL, 0, size(covered))").cast("long").alias("n_removed"),
        F.expr(f"IF(covered IS NULL, text, {kept})").alias("text"))


def remove_repeated_lines(docs: DataFrame, n: int = LINES, drop_emptied: bool = False,
                          passage_words: int | None = None) -> DataFrame:
    """``docs`` with the text without covered lines; documents that lose all their
    lines go if ``drop_emptied``."""
    rows = with_counts(docs, n, passage_words)
    if drop_emptied:
        rows = rows.where("n_removed = 0 OR n_removed < n_lines")
    return as_before(rows, docs.columns, text=F.col("text"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, x[p + 1] || chr(10) || x[p + 2] || chr(10) || x[p + 3] AS win
      FROM (SELECT doc_id, x, unnest(range(0, len(x) - 2)) AS p FROM l WHERE len(x) >= 3)),
r AS (SELECT doc_id, p, win, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w
      WHERE NOT regexp_full_match(win, '[ \t\r\f\x0B\n]*')),
c AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(g.ps), 0) AS BIGINT) AS n_removed,
       CASE WHEN g.ps IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(
         list_zip(l.x, range(0, len(l.x))), lambda z: NOT list_contains(g.ps, z[2])), lambda z: z[1]), chr(10)) END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
