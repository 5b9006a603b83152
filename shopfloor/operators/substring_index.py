"""An index for "contains" searches over many terms.

``ILIKE '%term%'`` reads every row for every term.  The index lists, for each
three characters in a row of a lower-cased text, the rows that hold them, in
chunks of at most ``CHUNK`` ids.  The rows that can hold a term are those in
the lists of all its trigrams; the text itself decides.  Terms under three
characters, or with a wildcard of LIKE, have no trigrams to go by and take
the scan, with the same result.

A trigram that nearly all rows hold has a list in very many chunks, so no
list is gathered in one task: terms are joined to the chunks one by one.  A
term is looked up by its rarest trigram alone, and all terms of a trigram go
along with each of its rows, so that rows are counted by their trigrams and
not by the terms that share them.  The text decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096                    # ids of a chunk of a list, about
TERMS = 64                      # terms that go along with a row, at most
PORTION = 500                   # terms of a scan


def _trigrams(text):
    """Distinct trigrams of the lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def build(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, chunk, ids): posting lists of ``text``; a gram's rows are dealt to
    chunks by a hash of the key, as many as its rows need."""
    rows = df.where(F.char_length(F.lower(F.col(text))) >= 3).select(F.col(key).alias("id"), F.explode(_trigrams(F.col(text))).alias("gram"))
    counts = rows.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    return (rows.join(counts, "gram").withColumn("chunk", F.expr("pmod(xxhash64(id), chunks)"))
            .groupBy("gram", "chunk").agg(F.sort_array(F.collect_set("id")).alias("ids")))


def search(df: DataFrame, index: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(term, id): a row for each row of ``df`` whose ``text`` contains the term, as
    ILIKE '%term%' (wildcards included) finds them.  ``terms``: column ``term``;
    null terms find nothing, an empty term every row with a text."""
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    plain = (F.char_length(F.lower("term")) >= 3) & ~F.col("term").rlike(r"[%_\\]") & (F.char_length(F.lower("term")) == F.char_length("term"))
    grams = asked.where(plain).select("term", F.explode(_trigrams(F.col("term"))).alias("gram"))
    # how long each asked list is; a gram without a list makes its term find nothing
    sizes = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum(F.size("ids")).alias("rows"))
    order = Window.partitionBy("term").orderBy(F.coalesce("rows", F.lit(0)), "gram")        # a term has few grams
    rarest = grams.join(sizes, "gram", "left").withColumn("k", F.row_number().over(order)).where("k = 1").select("gram", "term")
    part = F.expr(f"pmod(xxhash64(term), greatest(1, ceil(count(*) OVER (PARTITION BY gram) / {TERMS})))")
    together = rarest.withColumn("part", part).groupBy("gram", "part").agg(F.collect_list("term").alias("terms"))
    by_chunk = index.select("gram", "chunk").join(together, "gram").select("gram", "chunk", "terms")
    found = index.join(by_chunk, ["gram", "chunk"]).select(F.explode("ids").alias("id"), "terms")
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    low = rows.withColumn("low", F.lower("text"))
    # without wildcards, ILIKE is: the lower-cased text holds the lower-cased term
    held = F.filter("terms", lambda t: F.contains(F.col("low"), F.lower(t)))
    out = found.join(low, "id").select(F.explode(held).alias("term"), "id")
    # typed search terms without trigrams: a row is held against PORTION of them at a time
    scanned = sorted(r.term for r in asked.where(~plain).collect())
    for k in range(0, len(scanned), PORTION):
        patterns = F.array(*[F.lit(t) for t in scanned[k:k + PORTION]])
        hits = F.filter(patterns, lambda t: F.ilike("text", F.concat(F.lit("%"), t, F.lit("%"))))
        out = out.unionByName(rows.select(F.explode(hits).alias("term"), "id"))
    return out
