"""JSON array documents cut at every possible place."""

import json
import random

import pytest

from shopfloor.sources import files as FS
from shopfloor.sources import json_array as JA
from domain_rows import rows_of


def _read(path, range_bytes):
    """The records of a document by the reader alone: scan, running sums, records."""
    reader = JA.JsonArrayReader({"path": path, "pass": "scan", "rangebytes": str(range_bytes)})
    scans = [r for p in reader.partitions() for r in reader.read(p)]
    reader.scan = False
    out, quotes, depth = [], 0, 0
    for path, start, end, n, outside, inside in scans:
        within = quotes % 2 == 1
        out += reader.read(JA.ByteRange(path, start, end, within, depth))
        quotes, depth = quotes + n, depth + (inside if within else outside)
    return out


def _random_value(rng, level=0):
    kind = rng.randrange(4 if level < 3 else 2)
    if kind == 0:
        return rng.choice([1, -2.5, None, True])
    if kind == 1:
        return "".join(rng.choice('a"\\[]{}, \né') for _ in range(rng.randrange(8)))
    if kind == 2:
        return [_random_value(rng, level + 1) for _ in range(rng.randrange(3))]
    return {_random_value(rng, 3) if rng.random() < .3 else f"k{i}": _random_value(rng, level + 1) for i in range(rng.randrange(3))}


@pytest.mark.parametrize("seed", range(12))
def test_records_equal_a_whole_parse(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(JA, "READ_BYTES", rng.choice([1, 3, 7, 4 << 20]))
    doc = json.loads(json.dumps([_random_value(rng) for _ in range(rng.randrange(12))]))
    text = rng.choice(["", "﻿", " \n"]) + json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=False) + rng.choice(["", "\n"])
    path = str(tmp_path / "doc.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    for size in [1, 2, 3, 5, 11, 64, 10_000]:
        got = _read(path, size)
        assert [json.loads(r[2]) for r in got] == doc
        assert [r[1] for r in got] == sorted(r[1] for r in got)


def test_odd_documents(tmp_path):
    def of(text, size=4):
        p = tmp_path / "odd.json"
        p.write_bytes(text.encode())
        return [r[2] for r in _read(str(p), size)]
    assert of("") == [] and of("[]") == [] and of(" [ ] ") == []
    assert of("[1,,2]") == ["1", "2"]
    assert of('[{"a":1},oops,{"a":2}]') == ['{"a":1}', "oops", '{"a":2}']
    assert of('[1,2] [3]') == ["1", "2", "3"]
    assert of('[{"a":1},{"a":') == ['{"a":1}', '{"a":']          # breaks off
    with pytest.raises(ValueError, match="no JSON array"):
        of('{"a": 1}')
    reader = JA.JsonArrayReader({"path": "x", "maxrecordbytes": "10"})
    p = tmp_path / "long.json"
    p.write_text('["' + "x" * 100 + '"]')
    with pytest.raises(ValueError, match="longer than"):
        list(reader.read(JA.ByteRange(str(p), 0, 104)))


def test_array_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    for n in range(2):
        recs = [{"order_id": i, "status": 'x"],\\', "quantity": None} for i in range(n * 500, n * 500 + 500)] + ["no object"]
        (folder / f"{n}.json").write_text(json.dumps(recs))
    df = FS.read_order_array(spark, str(folder), raw=True, range_bytes=1000)
    assert df.rdd.getNumPartitions() > 20
    rows = rows_of(df.select("order_id", "status", "_corrupt_record"))
    good = [r for r in rows if r[0] is not None]
    assert sorted(int(r[0]) for r in good) == list(range(1000)) and {r[1] for r in good} == {'x"],\\'}
    assert len(rows) == 1002 and sum(r[2] is not None for r in rows) == 2
    empty = tmp_path / "none"
    empty.mkdir()
    assert JA.read_json_array(spark, str(empty)).count() == 0


def test_small_ranges_share_tasks_and_read_little_past_their_end(tmp_path):
    path = str(tmp_path / "doc.json")
    with open(path, "w") as f:
        f.write(json.dumps([{"order_id": i, "status": "x" * 100} for i in range(20_000)]))
    reader = JA.JsonArrayReader({"path": path, "pass": "scan", "rangebytes": "1000"})
    tasks = reader.partitions()
    ranges = sum(len(t.ranges) for t in tasks)
    assert 20 < len(tasks) <= 2 * JA.LEAST_TASKS < ranges
    reader.scan = False
    part, sizes = JA.ByteRange(path, 50_000, 51_000, True, 2), []
    with open(path, "rb") as f:
        for _, block in JA.JsonArrayReader._blocks(f, part.start, part.end, on=True):
            sizes.append(len(block))
            if len(sizes) == 2:
                break
    assert sizes == [1000, JA.TAIL_BYTES]


def test_a_document_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    lines = spark.range(0, 1000, 1, 5).selectExpr("concat('{\"id\": ', id, ', \"t\": \"é\"},') AS value")
    JA.write_document(lines, path, "[\n", '{"id": -1}]\n')
    with open(path, encoding="utf-8") as f:
        assert [r["id"] for r in json.load(f)] == [*range(1000), -1]
    JA.write_document(lines.limit(0), str(tmp_path / "none.json"), "[", "]")
    assert (tmp_path / "none.json").read_text() == "[]"
