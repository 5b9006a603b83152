"""Training-order materialisation (operator 8).

Every text's ids with an end id are cut into sequences of at most ``seq_len``
ids.  A sequence's number (its position over all tasks) goes through a
keyed Feistel network over the smallest even number of bits that holds
all numbers; a result beyond the last number goes through it again
(cycle-walking), so that the numbers are permuted.  The permuted number is
the sequence's slot.  Slots are ranges of ``per_shard`` a shard; a shard is
fixed-stride binary: record ``slot`` begins at ``(slot % per_shard) * stride``,
padded with ``pad_id``.  Reading from a slot on therefore needs no index, and a
stopped reader goes on from its slot.

Defined results: a null text counts as empty and gives one sequence with the
end id alone; equal texts and repeated rows keep their own sequences; an
empty table gives no slots; further columns are ignored.  Slots depend on
the key, the number of sequences and the order in which the input is read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, small_batches
from .packing import BROADCAST_ROWS
from .runs import mix
from .tokens import token_pieces

ROUNDS = 4


def permuted(numbers: np.ndarray, total: int, key: int, backward: bool = False) -> np.ndarray:
    """Slots of ``numbers`` below ``total`` (or numbers of slots)."""
    half = max(1, -(-(max(total, 2) - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [mix(np.array([(key * ROUNDS + r) % (1 << 64)], np.uint64))[0] for r in range(ROUNDS)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in reversed(keys) if backward else keys:
            if backward:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return left << shift | right

    out = once(np.asarray(numbers, np.uint64))
    while (beyond := out >= np.uint64(total)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocab_path: str, seq_len: int = 1024, end_id: int = 2, key: int = 7,
              per_shard: int = 4096, dtype: str = "<u2") -> tuple[DataFrame, int]:
    """(doc_id, seq_no, n_tokens, ids, ids_crc32, slot, shard) of every sequence, and
    how many there are.  ``ids`` are bytes of ``dtype``; the checksum is of 32-bit ids."""
    pieces = token_pieces(docs, vocab_path, seq_len, end_id, seq_len)
    # one length class for the count: a part's rows in the order it made them
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    base = offsets(counts.withColumn("k", F.col("part") * 2 + F.col("class")), "k", "n", "base").select("part", "class", "base")
    base = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
    numbered = pieces.join(base, ["part", "class"]).withColumn("number", F.col("base") + F.col("pos"))
    names = ["doc_id", "seq_no", "n_tokens", "ids", "ids_crc32", "slot"]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            slot = permuted(b.column("number").to_numpy(), total, key) if b.num_rows else np.zeros(0, np.int64)
            ids = [narrow(np.frombuffer(x, "<u4"), dtype).tobytes() for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("seq_no"), b.column("length"), pa.array(ids, pa.binary()),
                                   b.column("ids_crc32"), pa.array(slot, pa.int64())], names=names)

    out = numbered.select("doc_id", (F.col("start") / seq_len).cast("long").alias("seq_no"), "length", "ids", "ids_crc32",
                          "number").transform(small_batches).mapInArrow(
        run, "doc_id long, seq_no long, n_tokens int, ids binary, ids_crc32 long, slot long")
    return out.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long")), total


def narrow(ids: np.ndarray, dtype: str) -> np.ndarray:
    """``ids`` as ``dtype``; an id that doesn't fit is an error, never another id."""
    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
        raise ValueError(f"token id {int(ids.max())} does not fit {dtype}; give a wider dtype")
    return ids.astype(dtype)


SHARD_ROWS = "shard long, first_slot long, n_records int, payload binary, payload_crc32 long"


def shard_blocks(seqs: DataFrame, total: int, seq_len: int = 1024, per_shard: int = 4096, pad_id: int = 0,
                 dtype: str = "<u2", block: int = 256, tasks: int | None = None) -> DataFrame:
    """Shards as rows of at most ``block`` records: first slot, payload (records of
    ``seq_len`` ids, one after another, sorted by slot) and its checksum.

    Slots are gapless, so equal ranges of blocks are equal work: task t gets the t-th
    range, known without a sample of the rows, and ``write_shards`` writes it as
    it is.  A row is never larger than a block.
    """
    if per_shard % block:
        raise ValueError("block must divide per_shard")
    spark = seqs.sparkSession
    n_blocks = max(1, -(-total // block))
    tasks = min(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks)
    # a block's records meet in one group of bounded size
    blocks = seqs.withColumn("_b", F.floor(F.col("slot") / block).cast("long"))

    def run(batches):
        import pyarrow as pa
        state = {"b": None, "rows": []}

        def close():
            rows = state["rows"]
            payload = b"".join(rows[i] for i in range(len(rows)))
            first = state["b"] * block
            return pa.record_batch([pa.array([first // per_shard], pa.int64()), pa.array([first], pa.int64()),
                                    pa.array([len(rows)], pa.int32()), pa.array([payload], pa.binary()),
                                    pa.array([zlib.crc32(payload)], pa.int64())],
                                   names=[c.split()[0] for c in SHARD_ROWS.split(", ")])

        for b in batches:
            for k, ids in zip(b.column("_b").to_pylist(), b.column("ids")):
                if state["b"] is not None and k != state["b"]:
                    yield close()
                    state["rows"] = []
                state["b"] = k
                record = np.full(seq_len, pad_id, dtype)
                got = np.frombuffer(ids.as_py(), dtype)
                record[:len(got)] = got
                state["rows"].append(record.tobytes())
        if state["rows"]:
            yield close()

    return (blocks.select("_b", "slot", "ids").repartitionById(tasks, F.expr(f"int(_b * {tasks} div {n_blocks})"))
            .sortWithinPartitions("slot")
            .transform(small_batches).mapInArrow(run, SHARD_ROWS))


def write_shards(blocks: DataFrame, path: str) -> None:
    """One folder a shard, its blocks in order of slots: each task writes the range of
    slots that ``shard_blocks`` gave it, without another shuffle."""
    blocks.sortWithinPartitions("shard", "first_slot").write.partitionBy("shard").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, count: int, seq_len: int = 1024, per_shard: int = 4096,
              dtype: str = "<u2") -> DataFrame:
    """(slot, record) of ``count`` slots from ``slot`` on; only their shards are read."""
    stride = seq_len * np.dtype(dtype).itemsize
    rows = (spark.read.parquet(path)
            .where(F.col("shard").between(slot // per_shard, (slot + count - 1) // per_shard))
            .where((F.col("first_slot") + F.col("n_records") > slot) & (F.col("first_slot") < slot + count)))
    return (rows.select("first_slot", "payload", F.explode(F.expr("sequence(0, n_records - 1)")).alias("_i"))
            .select((F.col("first_slot") + F.col("_i")).alias("slot"),
                    F.expr(f"substring(payload, _i * {stride} + 1, {stride})").alias("record"))
            .where(F.col("slot").between(slot, slot + count - 1)).orderBy("slot"))
