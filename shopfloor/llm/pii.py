"""Personal data by bootstrapped contextual extraction (operator 2).

Base rules find e-mail addresses, IP addresses, card and phone numbers.
They are the seed entities.  The words around them are lexical patterns:
the two words before, and the word before with the word after.  The same
patterns also stand around candidates: strings of the shape of an
identifier that no base rule takes (an address without a domain ending, a
number that fails its check, ...).  Patterns and instances form a graph.  In
each round a pattern's score is the share of believed instances in its
evidence, damped for little evidence: against it are instances known to be
something else, which are the seeds of other kinds in the same words, dates,
and candidates that are a seed of another kind elsewhere.  Instances that
aren't known yet count against a pattern as far as they outnumber the believed
ones: up to half of a context's identifiers may be unseen, but a few cards in
words that stand around all sorts of numbers trust nothing.  A pattern needs a
word with a letter.  An instance's score is the chance that at least one of its trusted
patterns is right.  Patterns and instances above the bounds are trusted, and
stay so; rounds go on until none is added.  Occurrences of trusted instances
inside a trusted pattern are added to the base spans.

A word of a pattern longer than ``WORD`` characters counts by the ``WORD``
nearest to the span, and ends the pattern on its side; white space of any
length is skipped.

The graph is a table of (pattern, kind, instance) counts and lives in
Spark; its two sides are summed with partial aggregation, so a pattern that
a third of all candidates share is no group of its own.

Defined results: null counts as empty and has no spans; texts of any length
are searched whole; base spans of one kind don't overlap, spans of
different kinds may; added spans overlap nothing; equal texts get equal
base spans; repeated rows each get their spans; an empty table gives an
empty table; further columns are ignored (``redacted`` keeps them).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_before, ids_text, rest_of, small_batches, text_slices, written

KINDS = ("email", "ip", "card", "phone")
PATTERN_BOUND = 0.8
INSTANCE_BOUND = 0.8
SUPPORT = 4                     # believed instances that a pattern needs
DAMPING = 1.0
WORD = 256                      # characters of a word in a pattern

# An address is found from its @: whatever stands before it belongs to it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and not after a digit: a failed start within a run of digits would fail again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Shapes of candidates, by kind.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]{2,64}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,32})*"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,8}(?:\.[0-9]{1,8}){3,5}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])"),
}


def _emails(text):
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def _small(parts: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts.split("."))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small(m[0])]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of a kind's shape that overlap no base span and no earlier candidate."""
    if not re.search("[0-9@]|[\\[(]at[\\])]", text):
        return []
    found = []
    for k, kind in enumerate(KINDS):
        if k == 0 and "@" not in text and "(at)" not in text and "[at]" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in _SHAPES[kind].finditer(text)]
    out, taken = [], [(a, b) for a, _, b in taken]
    i, end, taken = 0, 0, sorted(taken)
    for a, k, b in sorted(found, key=lambda x: (x[0], x[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        # base spans of different kinds may overlap, so look a little further
        if a < end or any(x < b and a < y for x, y in taken[max(0, i - 2):i + 4]):
            continue
        out.append((a, k, b))
        end = b
    return out




_NEXT = re.compile(r"\s*(\S{0,%d})" % WORD)


def _before(text: str, end: int) -> tuple[str, int]:
    """The word before ``end``, or its last part, and where it begins (0 if no pattern goes further)."""
    while end and text[end - 1].isspace():
        end -= 1
    start, least = end, max(0, end - WORD)
    while start > least and not text[start - 1].isspace():
        start -= 1
    return text[start:end], 0 if start and not text[start - 1].isspace() else start


def _alike(word: str) -> str:
    return re.sub("[0-9]+", "0", word.lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span; digits are made alike.  Without a letter there is no pattern."""
    b, at = _before(text, start)
    a = _alike(_before(text, at)[0])
    b, c = _alike(b), _alike(_NEXT.match(text, end)[1])
    found = (f"l {a} {b}", a + b), (f"b {b} _ {c}", b + c)
    return [p for p, words in found if any(x.isalpha() for x in words)]


_DATE = re.compile(r"(?:19|20)[0-9]{2}([ ./-]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
                   r"|(?:0?[1-9]|[12][0-9]|3[01])([ ./-])(?:0?[1-9]|1[0-2])\2(?:19|20)[0-9]{2}"
                   r"|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}")


def known_wrong(text: str) -> bool:
    """A candidate that is something else: a date or a span of years."""
    return _DATE.fullmatch(text) is not None


def instance(text: str, k: int) -> str:
    return text.lower() if k == 0 else _digits(text) if k != 1 else text


FOUND = ("doc_id long, text_key long, base array<struct<s:int,k:int,e:int>>, "
         "near array<struct<s:int,k:int,e:int,seed:boolean,wrong:boolean,i:string,p:array<string>>>")


def found(docs: DataFrame) -> DataFrame:
    """A written table: every row's base spans, and its seeds and candidates with their patterns."""

    def run(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        near = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()),
                                   ("wrong", pa.bool_()), ("i", pa.string()), ("p", pa.list_(pa.string()))]))
        for b, texts in text_slices(batches):
            bases, nears = [], []
            for t in texts:
                base = base_spans(t)
                more = candidates(t, base)
                bases.append([{"s": s, "k": k, "e": e} for s, k, e in base])
                nears.append([{"s": s, "k": k, "e": e, "seed": seed, "wrong": not seed and known_wrong(t[s:e]),
                               "i": instance(t[s:e], k), "p": contexts(t, s, e)}
                              for seed, spans in ((True, base), (False, more)) for s, k, e in spans])
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(bases, span), pa.array(nears, near)],
                                  names=["doc_id", "text_key", "base", "near"])

    rows = docs.select(*ids_text()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return written(rows.transform(small_batches).mapInArrow(run, FOUND), "pii")


def bootstrapped(rows: DataFrame, pattern_bound: float = PATTERN_BOUND, instance_bound: float = INSTANCE_BOUND,
                 support: int = SUPPORT, damping: float = DAMPING) -> DataFrame:
    """(doc_id, text_key, added): the spans that trusted patterns add."""
    near = rows.select("doc_id", "text_key", F.explode("near").alias("n")).select("doc_id", "text_key", "n.*")
    # an edge once, however often it occurs: copies of a text are no evidence
    edges = near.select(F.explode("p").alias("p"), "k", "i", "seed", "wrong").groupBy("p", "k", "i") \
        .agg(F.max("seed").alias("seed"), F.max("wrong").alias("wrong"))
    edges = written(edges, "pii-edges")
    seeds = edges.where("seed").select("k", "i").distinct()
    # digits that are a seed of another kind elsewhere are better explained by that
    other = (edges.where("NOT seed").select("k", "i").distinct().join(seeds.withColumnRenamed("k", "_k"), "i")
             .where("k != _k").select("k", "i").distinct().join(seeds, ["k", "i"], "left_anti").withColumn("other", F.lit(True)))
    edges = edges.join(other, ["k", "i"], "left").select(
        "p", "k", "i", "seed", (~F.col("seed") & (F.col("wrong") | F.coalesce("other", F.lit(False)))).alias("wrong"))
    edges = written(edges, "pii-edges")
    # the evidence against a pattern never grows from round to round: more belief never takes trust away
    every = edges.groupBy("p").agg(F.sum(F.col("seed").cast("long")).alias("seeds"))
    against = (edges.groupBy("p", "k").agg(F.sum(F.col("seed").cast("long")).alias("own"), F.sum(F.col("wrong").cast("long")).alias("wrong"),
                                           F.sum((~F.col("wrong")).cast("long")).alias("fit"))
               .join(every, "p").select("p", "k", (F.col("wrong") + F.col("seeds") - F.col("own")).alias("bad"), "fit"))
    against = written(against, "pii-against")
    believed, n_patterns, n_believed = written(seeds, "pii-believed"), 0, seeds.count()
    while True:
        patterns = (edges.join(believed, ["k", "i"]).groupBy("p", "k").agg(F.count(F.lit(1)).alias("good"))
                    .where(F.col("good") >= support).join(against, ["p", "k"])
                    # unknown ones beyond the believed ones count against the pattern
                    .withColumn("many", F.greatest(F.col("fit") - 2 * F.col("good"), F.lit(0)))
                    .select("p", "k", (F.col("good") / (F.col("good") + F.col("bad") + F.col("many") + F.lit(damping))).alias("trust"))
                    .where(F.col("trust") >= pattern_bound))
        trusted = written(patterns, "pii-patterns")
        # the chance that one of the patterns is right; what is known to be wrong is never believed
        scores = (edges.where("NOT wrong").join(trusted, ["p", "k"]).groupBy("k", "i").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-12)))))).alias("score"))
            .where(F.col("score") >= instance_bound).select("k", "i"))
        believed = written(scores.union(believed).distinct(), "pii-believed")
        now = trusted.count(), believed.count()
        if now == (n_patterns, n_believed):                      # both only grow
            break
        n_patterns, n_believed = now
    more = near.where("NOT seed AND NOT wrong").select("doc_id", "text_key", "s", "k", "e", "i", F.explode("p").alias("p"))
    added = (more.join(trusted.select("p", "k"), ["p", "k"], "left_semi").join(believed, ["k", "i"], "left_semi")
             .select("doc_id", "text_key", "s", "k", "e").distinct())
    return added.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("added"))


def spans(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, text_key, base, added): arrays of (s, k, e) of every row."""
    rows = found(docs)
    # rows that repeat a document have the same spans; one of them is enough on the right
    added = bootstrapped(rows, **bounds).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "added")
    return rows.select("doc_id", "text_key", "base").join(
        added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left").select(
        "doc_id", "text_key", "base", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("added"))


def as_text(column: str) -> str:
    """SQL: kind:start:end by start, then kind, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return (f"array_join(transform(array_sort({column}), x -> concat(element_at(array({kinds}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def redacted(docs: DataFrame, **bounds) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as [EMAIL]; all columns stay."""
    rows = found(docs)
    added = bootstrapped(rows, **bounds).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "added")
    texts = docs.select(rest_of(docs, "text"), F.col("`text`").cast("string").alias("text"),
                        F.col("`doc_id`").cast("long").alias("_id"))
    joined = texts.join(added, F.col("_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left") \
        .select("rest", "text", "added")
    kinds = tuple(f"[{k.upper()}]" for k in KINDS)

    def run(batches):
        import pyarrow as pa
        for b, texts in text_slices(batches):
            out = []
            for t, there, more in zip(texts, b.column("text").is_valid().to_pylist(), b.column("added").to_pylist()):
                if not there:
                    out.append(None)
                    continue
                parts, at = [], 0
                for s, k, e in sorted(base_spans(t) + [(x["s"], x["k"], x["e"]) for x in more or []]):
                    if e <= at:
                        continue
                    if s >= at:
                        parts += [t[at:s], kinds[k]]
                    at = e                              # overlapping spans: one mark for all of them
                out.append("".join([*parts, t[at:]]))
            yield pa.record_batch([b.column("rest"), pa.array(out, pa.string())], names=["rest", "text"])

    done = joined.transform(small_batches).mapInArrow(run, joined.drop("added").schema)
    return as_before(done, docs.columns, text=F.col("text"))
