"""Delimited text with byte offsets.  Spark's reader loses them, so cells come from a scan in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Format
from .plain import plain_nodes

CELL = "record int, col int, start int, end int, name string, first int, text string"


def scan(data: bytes, delimiter: str = ",") -> list[tuple[int, int, int, int]]:
    """(record, column, start, end) of every cell's content, in bytes.

    A cell that begins with a quote runs to the closing one (doubled quotes are
    content and stay as they are) or to the end; what follows the closing quote is
    left out.  Records end with CR, LF or both; one at the very end adds nothing.
    """
    d = re.escape(delimiter.encode())
    plain, rest = re.compile(b"[^\r\n" + d + b"]*"), re.compile(b"[^\r\n" + d + b"]*")
    quoted = re.compile(b'"((?:[^"]|"")*)("|\\Z)', re.S)
    at, record, col, out, n = 3 if data.startswith(b"\xef\xbb\xbf") else 0, 0, 0, [], len(data)
    while at < n or col:
        m = quoted.match(data, at)
        if m:
            out.append((record, col, m.start(1), m.end(1)))
            at = rest.match(data, m.end()).end()
        else:
            m = plain.match(data, at)
            out.append((record, col, at, m.end()))
            at = m.end()
        if at < n and data[at : at + 1] == delimiter.encode():
            at, col = at + 1, col + 1
            continue
        at += 2 if data[at : at + 2] == b"\r\n" else 1
        record, col = record + 1, 0
    return out


def cells(docs: DataFrame, delimiter: str = ",") -> DataFrame:
    """(doc_id, record, col, start, end, name, first, text): all cells.

    name is the trimmed cell of record 0 in that column, first the first column of
    that name.  Null text is empty and has no cell.
    """

    def run(batches):
        kinds = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                found = scan(data, delimiter)
                names = {c: data[a:b].decode().strip() for r, c, a, b in found if r == 0}
                first = {}
                for c, name in names.items():
                    first.setdefault(name, c)
                owner += [i] * len(found)
                rows += [(r, c, a, b, names.get(c), first.get(names.get(c)), data[a:b].decode()) for r, c, a, b in found]
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "record", "col", "start", "end", "name", "first", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {CELL}")


def delimited_slices(docs: DataFrame, format: Format, delimiter: str | None = None) -> DataFrame:
    """One slice per target cell; a column belongs to the first target that names it.

    Without targets nothing is linted.  The header, blank cells and cells that a
    short record lacks give no slice; a name that no header has selects nothing.
    Of columns with one name the first is taken.
    """
    from .markdown import with_nodes

    rows = cells(docs, format.delimiter or delimiter or ",")
    if format.header:
        rows = rows.where("record > 0")
    else:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    test, mode = F.lit(False), F.lit("plain")
    for c in reversed(format.columns):
        own = (F.col("name") == c.selector) & (F.col("col") == F.col("first")) if isinstance(c.selector, str) else F.col("col") + 1 == c.selector
        own = F.coalesce(own, F.lit(False))
        test, mode = test | own, F.when(own, c.parse_mode).otherwise(mode)
    blank = F.regexp_replace("text", r"(?U)^\s+|\s+$", "") == ""
    number = (F.shiftleft(F.col("record").cast("long"), 32) + F.col("col")).alias("slice_id")
    chosen = rows.where(test & ~blank).select("doc_id", number, (F.col("col") + 1).alias("column_index"), F.col("name").alias("column_name"), mode.alias("parse_mode"), "start", "text")
    if all(c.parse_mode == "plain" for c in format.columns):
        return chosen.withColumn("nodes", plain_nodes(F.col("text")))
    return with_nodes(chosen)[0]
