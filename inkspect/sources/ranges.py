"""Delimited text read in byte ranges, so that one file is the work of many tasks.

Where a range begins, a scanner may be in any of six states.  Each range is walked from all
of them, which gives its effect on the state, the record, the column and the open cell; the
effects of a file's ranges are chained in order, and every range is walked once more from
the state that it really begins in.  A cell belongs to the range in which it ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import SHARE
from .writer import local

#: Before the first byte of a cell; inside a plain one; behind a CR; inside quotes; behind a quote inside them; behind the closing one.
FRESH, PLAIN, CR, QUOTED, QUOTE, REST = STATES = range(6)
BOM = b"\xef\xbb\xbf"
#: Tasks are no more than this; ranges share them from SHARE bytes down.
MOST_TASKS = 50_000
CELLS = "record long, col int, start long, end long, text string"
#: A range's effect from one state: the state it ends in, records ended, columns since (absolute after a record), and the open cell's start and closing quote, -1 as they were.
EFFECT = "to array<int>, records array<long>, cols array<int>, start array<long>, close array<long>"


def walk(data: bytes, begin: int, state: int, delimiter: bytes, start: int = -1, close: int = -1) -> Iterator[tuple]:
    """("cell", start, end, ends a record) for each cell that ends in the range, then ("end", state, start, close)."""
    at = 0
    if state == FRESH:
        start, state = begin, PLAIN
    elif state == CR and data:
        at = int(data[:1] == b"\n")
        start, state = begin + at, PLAIN
    elif state == QUOTE and data:
        at = int(data[:1] == b'"')
        state = QUOTED if at else REST
    special, ends, inner = re.compile(b'["\r\n' + re.escape(delimiter) + b"]"), re.compile(b"[\r\n" + re.escape(delimiter) + b"]"), re.compile(b'"')
    n = len(data)
    while at < n:
        if state == QUOTED:
            m = inner.search(data, at)
            if not m:
                at = n
            elif m.end() == n:
                state, close, at = QUOTE, begin + m.start(), n
            elif data[m.end() : m.end() + 1] == b'"':
                at = m.end() + 1
            else:
                state, close, at = REST, begin + m.start(), m.end()
            continue
        m = (special if begin + at == start else ends).match(data, at) or ends.search(data, at)
        if not m:
            state, at = REST if state == REST else PLAIN, n
        elif m.group() == b'"':
            state, start, at = QUOTED, begin + m.end(), m.end()
        else:
            line = m.group() in b"\r\n"
            yield "cell", start, close if state == REST else begin + m.start(), line
            at, state = m.end(), PLAIN
            if m.group() == b"\r":
                if at == n:
                    state = CR
                elif data[at : at + 1] == b"\n":
                    at += 1
            start = begin + at
    if state == PLAIN and start == begin + n:
        state = FRESH
    yield "end", state, start, close


def effect(data: bytes, begin: int, delimiter: bytes) -> dict[str, list[int]]:
    """What a range does to each state that it may begin in."""
    out: dict[str, list[int]] = {k: [] for k in ("to", "records", "cols", "start", "close")}
    for state in STATES:
        records = cols = 0
        for kind, *found in walk(data, begin, state, delimiter):
            if kind == "cell":
                records, cols = (records + 1, 0) if found[2] else (records, cols + 1)
        for key, value in zip(out, (found[0], records, cols, found[1], found[2])):
            out[key].append(value)
    return out


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state, record, column and open cell that each range of one file begins with."""
    state, record, col, start, close, rows = FRESH, 0, 0, 0, -1, []
    ranges = ranges.sort_values("begin")
    for x in ranges.itertuples():
        rows.append((state, record, col, start, close))
        col = x.cols[state] + (0 if x.records[state] else col)
        record += x.records[state]
        start, close = (old if new < 0 else new for old, new in ((start, x.start[state]), (close, x.close[state])))
        state = x.to[state]
    out = ranges.drop(columns=["to", "records", "cols", "start", "close"])
    return out.assign(**{k: [r[i] for r in rows] for i, k in enumerate(("state", "record", "col", "start", "close"))})


def _read(path: str, begin: int, end: int) -> tuple[int, bytes]:
    """Where a range begins, behind a byte order mark, and its bytes."""
    with open(local(path), "rb") as f:
        if begin < len(BOM) and f.read(len(BOM)) == BOM:
            begin = len(BOM)
        f.seek(begin)
        return begin, f.read(max(0, end - begin))


def file_ranges(files: DataFrame, size: int = 64 << 20) -> DataFrame:
    """(path, begin, end, length): the ranges of files (path, length); one that is empty has none."""
    begins = F.expr(f"sequence(0L, length - 1, {size}L)")
    rows = files.where("length > 0").select("path", "length", F.explode(begins).alias("begin"))
    return rows.select("path", "begin", F.least(F.col("begin") + size, "length").alias("end"), "length")


def range_cells(ranges: DataFrame, delimiter: str = ",") -> DataFrame:
    """(path, record, col, start, end, text) of all cells, as ``delimited.scan`` finds them, from ``file_ranges`` on mounted file systems.

    No bytes are shuffled: the rows of a file's ranges, some 250 bytes each, meet in one
    task to be chained (a file of 10 TB has 160,000), and each range is read twice.  A
    cell that reaches over ranges is read from its start by the range in which it ends.
    A table without rows gives none; a range that comes twice counts once.
    """
    byte = delimiter.encode()

    def effects(batches):
        for batch in batches:
            found = [effect(data, at, byte) for at, data in (_read(*x) for x in zip(*(batch.column(k).to_pylist() for k in ("path", "begin", "end"))))]
            types = {"to": pa.int32(), "records": pa.int64(), "cols": pa.int32(), "start": pa.int64(), "close": pa.int64()}
            own = [pa.array([x[k] for x in found], pa.list_(t)) for k, t in types.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *types])

    def cells(batches):
        for batch in batches:
            for x in batch.to_pylist():
                begin, data = _read(x["path"], x["begin"], x["end"])
                record, col, out = x["record"], x["col"], []
                for kind, a, b, last in walk(data, begin, x["state"], byte, x["start"], x["close"]):
                    if kind == "cell":
                        out.append((record, col, a, b))
                        record, col = (record + 1, 0) if last else (record, col + 1)
                state, start, close = a, b, last
                if x["end"] == x["length"] and (col or state not in (FRESH, CR)):
                    out.append((record, col, start, close if state in (QUOTE, REST) else x["length"]))
                texts = [(data[a - begin : b - begin] if a >= begin else _read(x["path"], a, b)[1]).decode() for _, _, a, b in out]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([x["path"]] * len(out), pa.string()), *columns, pa.array(texts, pa.string())], ["path", "record", "col", "start", "end", "text"])

    plan = "path string, begin long, end long, length long"
    rows = ranges.select("path", F.col("begin").cast("long"), F.col("end").cast("long"), F.col("length").cast("long")).dropDuplicates(["path", "begin"])
    # by number, as rows this small would be merged into one task; by bytes, as a task for each small range would cost more than its range
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("begin"))).first()
    tasks = max(1, min(MOST_TASKS, n, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // SHARE))))
    rows = rows.repartition(tasks, "path", "begin")
    begun = rows.mapInArrow(effects, f"{plan}, {EFFECT}").groupBy("path").applyInPandas(_chained, f"{plan}, state int, record long, col int, start long, close long")
    return begun.repartition(tasks, "path", "begin").mapInArrow(cells, f"path string, {CELLS}")
