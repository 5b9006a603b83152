"""MinHash near-deduplication (operator 3): banding in place of an LSH forest.

A document is the set of its shingles.  Documents with equal sets are one
class, known by 128 bits.  Each class has a MinHash signature of 60 values,
in 20 trees of three values each.  Classes that share a tree's three values
are a region, and meet there as candidates.  A forest would sort by whole
signatures and go deeper in large regions; that loses links, so depth is
fixed here.  A pair goes on if 33 of all 60 values agree.  Pairs are looked
at in the first tree in which they meet.

A region of more than ``BLOCK`` classes is cut into blocks, and each pair of
blocks is a task's work; no region meets in one task and none is cut
short.  Confirmation compares the full sets of all members of a block that
go on; it emits links that connect members, not all pairs.  Links then
become components by contraction.

A link of 0.8 is missed if its documents share no region (0.488 ** 20, below
1e-6) or agree in fewer than 33 values (below 1e-5).

Defined results: null texts, empty texts and texts without words have an
empty set and are linked with nothing; texts with fewer words than the
width have their whole sequence as one shingle; rows that repeat a doc_id
count as one document with the sets of all of them, and each row is
returned; rows without a doc_id are compared like all others, but a null
can't name a component: it has the smallest doc_id of its rows, or null if
none has one; an empty table gives an empty table; further columns are
ignored (``deduplicated`` keeps them).

``kept`` is a document's mark, so rows that repeat a kept doc_id all have it.
``deduplicated`` returns one row of each component: the one with the smallest
doc_id (null last), then checksum, then row number.  Of the rows of a doc_id
without words one stays, or none if the doc_id has other texts; rows without
both words and doc_id all stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_before, ids_text, rest_of, small_batches, text_slices, written
from .components import components
from .shingles import DEPTH, TREES, labels, set_hashes, shingle_sets, signatures

SIGNATURE = TREES * DEPTH
AGREE = 33                      # of SIGNATURE values, below which a pair isn't confirmed
BLOCK = 384
BROADCAST_IDS = 1_000_000       # ids up to which they are broadcast


def _binary(matrix):
    import pyarrow as pa
    width = matrix.shape[1] * matrix.itemsize
    raw = np.ascontiguousarray(matrix).tobytes()
    return pa.array([raw[i * width:(i + 1) * width] for i in range(len(matrix))], pa.binary())


def _checksum():
    """A row's 64 bits, to find it again; what it finds is then told by its set."""
    return F.xxhash64("doc_id", "text")


def signed(docs: DataFrame, width: int) -> DataFrame:
    """A written table with every row's set size, set hash, labels and signature.

    ``docs`` has doc_id, text and the row's number.
    """

    def run(batches):
        import pyarrow as pa
        for b, texts in text_slices(batches):
            h, edges = shingle_sets(texts, width)
            sig = signatures(h, edges)
            one, two = set_hashes(h, edges)
            yield pa.record_batch([b.column("doc_id"), b.column("row"), b.column("checksum"), pa.array(np.diff(edges), pa.int64()),
                                   pa.array(one, pa.int64()), pa.array(two, pa.int64()), _binary(labels(sig)),
                                   _binary((sig & 255).astype(np.uint8))],
                                  names=["doc_id", "row", "checksum", "n_shingles", "set_a", "set_b", "labels", "sig"])

    return written(docs.select("doc_id", "row", _checksum().alias("checksum"), "text").transform(small_batches).mapInArrow(
        run, "doc_id long, row long, checksum long, n_shingles long, set_a long, set_b long, labels binary, sig binary"),
        "signatures")


def _groups(batches, key: str):
    """(columns as lists) of each run of equal keys in sorted batches."""
    now, rows, names = None, [], None
    for b in batches:
        names = b.schema.names
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for a, z in zip(cuts, cuts[1:]):
            if now is not None and keys[a] != now:
                yield now, names, rows
                rows = []
            now = int(keys[a])
            rows.append(b.slice(a, z - a))
    if rows:
        yield now, names, rows


def _column(rows, name):
    return [x for b in rows for x in b.column(name).to_pylist()]


def _members(classes: DataFrame) -> DataFrame:
    """(key, tree, side, rep) of every class in every block of a region of several classes.

    A region of m classes makes about m * m / BLOCK rows.
    """

    def spread(batches):
        import pyarrow as pa
        for b in batches:
            found = np.frombuffer(b"".join(b.column("labels").to_pylist()), np.int64)
            yield pa.record_batch([pa.array(found), pa.array(np.tile(np.arange(TREES), b.num_rows), pa.int32()),
                                   pa.array(np.repeat(b.column("rep").to_numpy(), TREES), pa.int64())],
                                  names=["label", "tree", "rep"])

    rows = classes.select("rep", "labels").transform(small_batches).mapInArrow(spread, "label long, tree int, rep long")
    regions = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a large region: each member meets its own block and every other block of its region
    return (rows.join(regions, "label")
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .select("label", "tree", "rep", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
            .select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "tree", "rep",
                    F.expr("CASE WHEN own = other THEN 2 WHEN own < other THEN 0 ELSE 1 END").alias("side")))


def _facing(side: np.ndarray) -> np.ndarray:
    """Which pairs of a block's rows are its to compare."""
    return (side[:, None] != side[None, :]) | (side[:, None] == 2)


def _promising(classes: DataFrame) -> DataFrame:
    """(key, side, rep) of the members of blocks that have a partner to confirm."""

    def run(batches):
        import pyarrow as pa
        out = []

        def flush():
            got = pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                                   pa.array([x[2] for x in out], pa.int64())], names=["key", "side", "rep"])
            out.clear()
            return got

        for key, _, rows in _groups(batches, "key"):
            rep = np.array(_column(rows, "rep"))
            if len(rep) < 2:
                continue
            tree, side = np.array(_column(rows, "tree")), np.array(_column(rows, "side"))
            sig = np.frombuffer(b"".join(_column(rows, "sig")), np.uint8).reshape(-1, SIGNATURE)
            label = np.frombuffer(b"".join(_column(rows, "labels")), np.int64).reshape(-1, TREES)
            n = np.array(_column(rows, "n"))
            ok = _facing(side) & (100 * np.minimum.outer(n, n) >= 80 * np.maximum.outer(n, n))
            np.fill_diagonal(ok, False)
            for t in range(int(tree[0])):                        # met in an earlier tree
                ok &= label[:, t][:, None] != label[:, t][None, :]
            live = np.flatnonzero(ok.any(1))
            if len(live) < 2:
                continue
            agree = np.zeros((len(live), len(live)), np.uint8)
            for c in range(SIGNATURE):
                s = sig[live, c]
                agree += s[:, None] == s[None, :]
            good = (agree >= AGREE) & ok[np.ix_(live, live)]
            out += [(key, int(side[i]), int(rep[i])) for i in live[good.any(1)]]
            if len(out) > 20_000:
                yield flush()
        if out:
            yield flush()

    members = _members(classes).join(classes.select("rep", "n", "sig", "labels"), "rep")
    return members.repartition("key").sortWithinPartitions("key").transform(small_batches).mapInArrow(run, "key long, side int, rep long")


def jaccard_links(sets: list[np.ndarray], allowed: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with 100 * common >= 80 * united, few that connect the same members."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    at, step = 0, max(64, (1 << 21) // n)
    while at < len(number):                                      # bounded pieces of the incidence matrix
        end = int(np.searchsorted(number, number[at] + step))
        part = np.zeros((n, step), np.float32)
        part[owner[at:end], number[at:end] - number[at]] = 1
        common += part @ part.T
        at = end
    link = (100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)) & allowed
    np.fill_diagonal(link, False)
    root = np.arange(n)
    while True:                                                  # smallest member reachable
        low = np.where(link, root[None, :], n).min(1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    # breadth-first from each root: one link a member
    out, seen, front = [], root == np.arange(n), np.flatnonzero(root == np.arange(n))
    while len(front):
        touch = link[:, front] & ~seen[:, None]
        hit = np.flatnonzero(touch.any(1))
        out += [(int(i), int(front[touch[i].argmax()])) for i in hit]
        seen[hit] = True
        front = hit
    return out


def _links(docs: DataFrame, classes: DataFrame, promising: DataFrame, width: int) -> DataFrame:
    """Confirmed links (a, b) between classes."""
    promising = written(promising.join(classes.select("rep", "keeper.checksum", "set_a", "set_b"), "rep"), "promising")
    ids = promising.select(F.col("checksum").alias("_checksum")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, _checksum() == F.col("_checksum"), "left_semi").select("text")

    def members(batches):
        import pyarrow as pa
        for _, part in text_slices(batches):
            h, edges = shingle_sets(part, width)
            one, two = set_hashes(h, edges)
            yield pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                   pa.array([h[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])], pa.binary())],
                                  names=["set_a", "set_b", "members"])

    sets = texts.transform(small_batches).mapInArrow(members, "set_a long, set_b long, members binary") \
        .where("length(members) > 0").distinct()

    def confirm(batches):
        import pyarrow as pa
        for _, _, rows in _groups(batches, "key"):
            rep = np.array(_column(rows, "rep"))
            if len(rep) < 2:
                continue
            found = [np.frombuffer(x, np.uint64) for x in _column(rows, "members")]
            got = jaccard_links(found, _facing(np.array(_column(rows, "side"))))
            if got:
                yield pa.record_batch([pa.array([int(rep[i]) for i, _ in got], pa.int64()),
                                       pa.array([int(rep[j]) for _, j in got], pa.int64())], names=["a", "b"])

    return (promising.select("key", "side", "rep", "set_a", "set_b").join(sets, ["set_a", "set_b"])
            .select("key", "side", "rep", "members").repartition("key").sortWithinPartitions("key")
            .transform(small_batches).mapInArrow(confirm, "a long, b long").where("a != b"))


def _grouped(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs`` (doc_id, text, row), and the component of each
    class: set_a, set_b, keeper (its first row), component (a class number),
    component_id (the smallest doc_id, or null)."""
    rows = signed(docs, width)
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "checksum", "row")).alias("keeper"),
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("labels").alias("labels"))
    # a class is known by its number in the written table: some have no doc_id, and a doc_id may have several
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = _links(docs, classes, _promising(classes), width)
    # rows that repeat a doc_id with other texts belong together
    several = (full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("l"),
                                                                        F.max(F.struct("set_a", "set_b")).alias("h"))
               .where("l != h").select(F.col("doc_id").alias("_id"), "l"))
    if not several.isEmpty():
        numbers = lambda c: classes.select(F.col("set_a").alias(c + "_a"), F.col("set_b").alias(c + "_b"), F.col("rep").alias(c))
        tied = full.join(several, F.col("doc_id") == F.col("_id")).select(
            F.col("l.set_a").alias("a_a"), F.col("l.set_b").alias("a_b"), F.col("set_a").alias("b_a"), F.col("set_b").alias("b_b"))
        links = links.union(tied.distinct().join(numbers("a"), ["a_a", "a_b"]).join(numbers("b"), ["b_a", "b_b"]).select("a", "b"))
    roots = components(links)
    linked = classes.select("rep", "keeper").join(roots, F.col("rep") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("keeper.doc_id").alias("low")).withColumnRenamed("root", "_root")
    named = roots.join(lowest, F.col("root") == F.col("_root")).select("node", "root", "low")
    ends = classes.join(named, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", "keeper", F.coalesce("root", "rep").alias("component"),
        F.when(F.col("root").isNull(), F.col("keeper.doc_id")).otherwise(F.col("low")).alias("component_id"))
    return rows, ends


def near_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, ends = _grouped(docs.select(*ids_text(), F.monotonically_increasing_id().alias("row")), width)
    found = rows.where("n_shingles > 0").join(ends.select("set_a", "set_b", "component_id"), ["set_a", "set_b"], "left")
    every = found.select("doc_id", "n_shingles", "component_id").union(
        rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each component, with all its columns."""
    # the copy fixes the rows' numbers
    every = written(docs.select(rest_of(docs, "text"), F.col("`doc_id`").cast("long").alias("doc_id"),
                                F.col("`text`").alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    rows, ends = _grouped(every.select(*ids_text(), "row"), width)
    kept = ends.groupBy("component").agg(F.min("keeper").alias("keeper")).select("keeper.row")
    empty = rows.where("n_shingles = 0")
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("most"), F.min("row").alias("row"))
    kept = kept.union(ids.where("most = 0").select("row")).union(empty.where("doc_id IS NULL").select("row"))
    gone = rows.select("row").join(kept, "row", "left_anti")
    return as_before(every.join(gone, "row", "left_anti"), docs.columns, text=F.col("text"))
