"""Delimited files read in byte ranges hold the cells that a scan of the whole finds."""

import random

import pytest

from inkspect.sources import ranges
from inkspect.sources.delimited import scan


def in_ranges(data, size, delimiter=b","):
    """Cells of a text by chained ranges, without Spark."""
    begin, n, found, record, col = 3 if data.startswith(ranges.BOM) else 0, len(data), [], 0, 0
    state, start, close = ranges.FRESH, begin, -1
    for at in range(begin, n, size):
        part = data[at : at + size]
        table = ranges.effect(part, at, delimiter)
        records, cols = record, col
        for kind, a, b, last in ranges.walk(part, at, state, delimiter, start, close):
            if kind == "cell":
                found.append((record, col, a, b))
                record, col = (record + 1, 0) if last else (record, col + 1)
        assert record - records == table["records"][state] and col == table["cols"][state] + (cols if record == records else 0)
        assert a == table["to"][state] and (b == table["start"][state] or table["start"][state] < 0)
        state, start, close = a, b, last
    if col or state not in (ranges.FRESH, ranges.CR):
        found.append((record, col, start, close if state in (ranges.QUOTE, ranges.REST) else n))
    return found


def test_every_range_size_equals_the_scan():
    own = random.Random(5)
    for i in range(3000):
        text = "".join(own.choice('a",\r\né') for _ in range(own.randint(0, 14)))
        data = (b"\xef\xbb\xbf" if i % 5 == 0 else b"") + text.encode()
        for size in (1, 2, 3, 5, 20):
            assert in_ranges(data, size) == scan(data), (data, size)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_files_in_ranges(spark, tmp_path, size):
    texts = {"a.csv": b'\xef\xbb\xbfid,"no\r\nte"\r\n1,"x ""y"" \n z"q,\r2,\n', "b.csv": b"", "c.csv": "é,".encode() * 40 + b'"open\n,', "d.csv": b"\r\r\n,\n"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    got = ranges.range_cells(ranges.file_ranges(files.union(files), size)).collect()
    expected = sorted((name, *c, data[c[2] : c[3]].decode()) for name, data in texts.items() for c in scan(data))
    assert sorted((r.path.rpartition("/")[2], r.record, r.col, r.start, r.end, r.text) for r in got) == expected


def test_no_files(spark):
    files = spark.createDataFrame([], "path string, length long")
    assert ranges.range_cells(ranges.file_ranges(files)).count() == 0


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    data = b"".join(b'%d,"a\nb"\n' % i for i in range(3000))
    (tmp_path / "a.csv").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    cores = spark.sparkContext.defaultParallelism
    for share, tasks in ((4 << 20, 2 * cores), (1 << 10, -(-len(data) // (1 << 10)))):
        monkeypatch.setattr(ranges, "SHARE", share)
        cells = ranges.range_cells(ranges.file_ranges(files, 100))
        assert cells.rdd.getNumPartitions() == tasks
        assert sorted((r.record, r.col, r.start, r.end) for r in cells.collect()) == scan(data)
