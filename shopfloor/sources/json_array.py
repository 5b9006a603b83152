"""One JSON array document read by many tasks.

``spark.read.json(multiLine=True)`` gives a whole document to one task.  Here
a Python data source reads byte ranges.  Whether a byte is inside a string and
how deep it is nested depends on everything before it, so ranges are read twice:

1. ``pass=scan``: each range counts its quotes and its change of depth, once as if
   it began outside a string and once as if inside.  (Whether a quote is escaped
   is told by the run of backslashes before it alone.)
2. Running sums over one row a range give each range the state in which it begins.
3. ``pass=records``: each range cuts out the elements whose opening ``[`` or ``,``
   lies in it, reading on past its end for the last one.

A task takes neighbouring ranges up to ``TASK_BYTES``, so that small ranges
do not make as many tasks; the second pass reads them as one.
:func:`write_document` writes one such document by many tasks.

Defined results: elements keep their text and byte offset, which is their order
in the file; broken elements are elements too (the reader of their columns
rejects them); an empty file or array gives none; text after the array's end
is ignored, but for a further array, whose elements count; a file that holds
something else than arrays is an error, as is an element longer than ``maxRecordBytes``.
"""

from __future__ import annotations

import itertools
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .._shipping import ship_by_value as _ship_by_value
from ..session import scratch_path

_ship_by_value(__name__)

RANGE_BYTES = 64 << 20
MAX_RECORD_BYTES = 64 << 20
READ_BYTES = 4 << 20            # bytes looked at together
TAIL_BYTES = 64 << 10           # bytes first read past the end of a range; doubled up to READ_BYTES
TASK_BYTES = 32 << 20           # neighbouring ranges of a task, about
LEAST_TASKS = 64                # as far as there are ranges
SCAN_ROWS = "path string, start long, end long, quotes long, depth_outside long, depth_inside long"
RECORD_ROWS = "path string, offset long, record string"
STATE_ROWS = "path string, start long, end long, inside boolean, depth long"


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool = False, depth: int = 0):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.inside, self.depth = path, start, end, inside, depth


class ByteRanges(InputPartition):
    """The ranges of one task."""
    def __init__(self, ranges: list[ByteRange]):
        super().__init__((ranges[0].path, ranges[0].start))
        self.ranges = ranges


def _tasks(ranges: list[ByteRange]) -> list[ByteRanges]:
    """Ranges in order of the files, dealt to tasks of about equal bytes."""
    most = min(TASK_BYTES, sum(r.end - r.start for r in ranges) // LEAST_TASKS)
    out, size = [], 0
    for r in ranges:
        if not out or size + r.end - r.start > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.end - r.start
    return [ByteRanges(t) for t in out]


def _joined(ranges: list[ByteRange]) -> list[ByteRange]:
    """Ranges that follow one another in a file as one: the first one's state holds."""
    out = []
    for r in ranges:
        if out and out[-1].path == r.path and out[-1].end == r.start:
            r = ByteRange(r.path, out[-1].start, r.end, out[-1].inside, out.pop().depth)
        out.append(r)
    return out


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file or of the data files in a folder."""
    from pyarrow import fs
    system, inner = _filesystem(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))


def _escaped_before(handle, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd run of backslashes."""
    run, at = 0, start
    while at > 0:
        size = min(4096, at)
        handle.seek(at - size)
        block = handle.read(size)
        tail = len(block) - len(block.rstrip(b"\\"))
        run += tail
        if tail < size:
            break
        at -= size
    return run % 2 == 1


def _structure(block: bytes, escaped: bool):
    """Positions and bytes of what shapes the document, escaped quotes left out,
    and whether the byte after the block is escaped."""
    import numpy as np
    a = np.frombuffer(block, np.uint8)
    kept = np.isin(a, np.frombuffer(b'"[]{},', np.uint8))
    slashes = a == 0x5C
    if escaped or slashes.any():
        # length of the run of backslashes that ends before each byte
        n = np.arange(len(a) + 1)
        last_other = np.maximum.accumulate(np.concatenate([[0], np.where(~slashes, n[1:], 0)]))
        run = n - last_other
        if escaped:
            run[last_other == 0] += 1
        odd = run % 2 == 1
        kept &= ~((a == 0x22) & odd[:-1])
        escaped = bool(odd[-1])
    at = np.flatnonzero(kept)
    return at, a[at], escaped


def _depth_changes(kinds):
    import numpy as np
    return np.where((kinds == 0x5B) | (kinds == 0x7B), 1, np.where((kinds == 0x5D) | (kinds == 0x7D), -1, 0))


class JsonArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.scan = options.get("pass", "records") == "scan"
        self.states = options.get("states")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.most = int(options.get("maxrecordbytes", MAX_RECORD_BYTES))

    def partitions(self):
        if self.scan:
            return _tasks([ByteRange(p, at, min(size, at + self.range_bytes))
                           for p, size in _files(self.path) for at in range(0, size, self.range_bytes)])
        import pyarrow.dataset as ds
        system, inner = _filesystem(self.states)
        rows = ds.dataset(inner, filesystem=system, format="parquet").to_table(use_threads=False).to_pylist()   # one row a range
        rows.sort(key=lambda r: (r["path"], r["start"]))
        return _tasks([ByteRange(r["path"], r["start"], r["end"], r["inside"], r["depth"]) for r in rows])

    def read(self, part):
        if part is None:                                  # no files: Spark asks one empty task
            return
        ranges = part.ranges if isinstance(part, ByteRanges) else [part]
        for path, group in itertools.groupby(ranges if self.scan else _joined(ranges), key=lambda r: r.path):
            system, inner = _filesystem(path)
            with system.open_input_file(inner) as handle:
                for r in group:
                    yield from (self._scan(handle, r) if self.scan else self._records(handle, r))

    @staticmethod
    def _blocks(handle, start: int, end: int, on: bool = False):
        """(offset, bytes) from ``start`` to ``end``, then with ``on`` in small steps to the end of the file."""
        handle.seek(start)
        step = min(TAIL_BYTES, READ_BYTES)
        while start < end or on:
            if start < end:
                want = min(READ_BYTES, end - start)
            else:
                want, step = step, min(2 * step, READ_BYTES)
            block = handle.read(want)
            if not block:
                return
            yield start, block
            start += len(block)

    def _scan(self, handle, part):
        import numpy as np
        escaped = _escaped_before(handle, part.start)
        quotes = outside = inside = 0
        for _, block in self._blocks(handle, part.start, part.end):
            _, kinds, escaped = _structure(block, escaped)
            is_quote = kinds == 0x22
            odd = (quotes + np.cumsum(is_quote)) % 2 == 1
            change = _depth_changes(kinds)
            outside += int(change[~odd].sum())            # inside after an odd number of quotes
            inside += int(change[odd].sum())
            quotes += int(is_quote.sum())
        yield part.path, part.start, part.end, quotes, outside, inside

    def _records(self, handle, part):
        import numpy as np
        escaped = _escaped_before(handle, part.start)
        inside, depth = part.inside, part.depth
        begun, pieces, length = None, [], 0               # the open element: its offset, bytes so far
        for start, block in self._blocks(handle, part.start, part.end, on=True):
            at, kinds, escaped = _structure(block, escaped)
            is_quote = kinds == 0x22
            in_string = (int(inside) + np.cumsum(is_quote)) % 2 == 1
            inside = bool((int(inside) + int(is_quote.sum())) % 2)
            free = ~in_string & ~is_quote
            at, kinds = at[free], kinds[free]
            depths = depth + np.cumsum(_depth_changes(kinds))
            depth = int(depths[-1]) if len(depths) else depth
            if ((kinds == 0x7B) & (depths == 1)).any():
                raise ValueError(f"{part.path} is no JSON array: an object begins outside of one")
            opens = (kinds == 0x5B) & (depths == 1)
            commas = (kinds == 0x2C) & (depths == 1)
            ends = (kinds == 0x5D) & (depths == 0)
            edge = opens | commas | ends
            cut = 0
            for place, opening, closing in zip(at[edge].tolist(), opens[edge].tolist(), ends[edge].tolist()):
                if begun is not None and not opening:
                    pieces.append(block[cut:place])
                    self._check(part, begun, length + place - cut)
                    if text := b"".join(pieces).strip():
                        yield part.path, begun, text.decode("utf-8", "replace")
                begun, pieces, length = None, [], 0
                if start + place >= part.end:
                    return                                # the next range's elements
                if not closing:
                    begun, cut = start + place + 1, place + 1
            if begun is None and start + len(block) >= part.end:
                return
            if begun is not None:
                pieces.append(block[cut:])
                length += len(block) - cut
                self._check(part, begun, length)
        if begun is not None and (text := b"".join(pieces).strip()):
            yield part.path, begun, text.decode("utf-8", "replace")    # the document breaks off

    def _check(self, part, begun, length):
        if length > self.most:
            raise ValueError(f"the element at byte {begun} of {part.path} is longer than {self.most} bytes")


class JsonArraySource(DataSource):
    @classmethod
    def name(cls):
        return "json_array"

    def schema(self):
        return SCAN_ROWS if self.options.get("pass") == "scan" else RECORD_ROWS

    def reader(self, schema):
        return JsonArrayReader(self.options)


def json_array_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, inside, depth): the state in which each byte range begins."""
    spark.dataSource.register(JsonArraySource)
    scan = spark.read.format("json_array").option("pass", "scan").option("rangebytes", range_bytes).load(path)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)   # one row a range
    inside = scan.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth_outside"))
    return inside.select("path", "start", "end", "inside",
                         F.coalesce(F.sum(change).over(before), F.lit(0)).cast("long").alias("depth"))


def read_json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES,
                    max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """(path, offset, record): the elements of the array document(s) at ``path`` as text."""
    states = f"{scratch_path(spark, 'json-array')}-{uuid.uuid4().hex}"
    json_array_ranges(spark, path, range_bytes).write.parquet(states)
    return (spark.read.format("json_array").option("states", states)
            .option("maxrecordbytes", max_record_bytes).load(path))


def _put(source: str, target: str, at: int) -> None:
    """The bytes of a file to their place in another one."""
    system, inner = _filesystem(source)
    with system.open_input_stream(inner) as rows, open(_filesystem(target)[1], "r+b") as out:
        out.seek(at)
        shutil.copyfileobj(rows, out, READ_BYTES)


def write_document(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """``head``, the ordered text ``lines`` and ``tail`` as one file at ``path``.

    Tasks write the lines as parts; then each part is copied to its place in the
    file, by a task of its own.  That takes a shared folder: a store without
    writes in the middle of a file is an error."""
    from pyarrow import fs
    spark = lines.sparkSession
    system, inner = _filesystem(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: one file is written by many tasks in a shared folder only")
    parts = f"{path}-parts"
    lines.write.text(parts)
    first, last = head.encode(), tail.encode()
    places, at = [], len(first)
    for part, size in _files(parts):                      # one a task
        places.append((part, at))
        at += size
    with open(inner, "wb") as out:
        out.write(first)
        out.seek(at)
        out.write(last)
    if places:
        spark.sparkContext.parallelize(places, len(places)).foreach(lambda p: _put(p[0], path, p[1]))
