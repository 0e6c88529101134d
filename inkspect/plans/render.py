"""Reports: text, JSON, SARIF, compact JSON, and the exit status."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import positions

LEVELS = {"error": "error", "warning": "warning", "info": "note", "hint": "note"}


POINT = "struct<line:int,column:int,utf16_column:int>"


def placed(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """Diagnostics with path and struct columns from_ and to (line, column, utf16_column).

    A document's diagnostics meet its text once, and all their places are found in
    one pass over it.
    """
    item = F.struct("rule_id", "severity", "message", "start", "end", "fixes")
    found = diagnostics.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(item).alias("items"))
    own = docs.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("source")).join(found, F.col("doc_id").eqNullSafe(F.col("d")))
    ends = lambda x: F.array(x["start"], x["end"])
    offsets = F.transform("items", lambda x: F.concat(ends(x), F.flatten(F.transform(x["fixes"], ends))))
    rows = own.select("path", "items", offsets.alias("offsets"), "source")

    def run(batches):
        point = pa.struct([("line", pa.int32()), ("column", pa.int32()), ("utf16_column", pa.int32())])
        for batch in batches:
            parts = []
            for own, text in zip(batch.column(2), batch.column(3)):
                flat = own.values.flatten().to_numpy()
                parts.append(positions(text.as_py().encode(), flat).astype(np.int32))
            flat = np.concatenate([np.empty((3, 0), np.int32), *parts], axis=1)
            points = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(point))
            inner = batch.column(2).flatten()
            nested = pa.ListArray.from_arrays(_bounds(batch.column(2)), pa.ListArray.from_arrays(_bounds(inner), points))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nested], ["path", "items", "points"])

    items = rows.schema["items"].dataType.simpleString()
    located = rows.mapInArrow(run, f"path string, items {items}, points array<array<{POINT}>>")
    each = located.select("path", F.explode(F.arrays_zip("items", "points")).alias("x")).select("path", "x.items.*", F.col("x.points").alias("points"))
    at = lambda i, side: F.get("points", 2 * i + side)
    fixes = F.transform("fixes", lambda f, i: F.struct(F.struct(f["start"].alias("start"), f["end"].alias("end")).alias("span"), F.struct(_point(at(i + 1, 0)).alias("start"), _point(at(i + 1, 1)).alias("end")).alias("position"), f["replacement"].alias("replacement")))
    return each.select("path", "rule_id", "severity", "message", "start", "end", F.get("points", F.lit(0)).alias("from_"), F.get("points", F.lit(1)).alias("to"), fixes.alias("fixes"))


def _point(p: Column) -> Column:
    return F.struct(p["line"].alias("line"), p["column"].alias("column"), p["utf16_column"].alias("utf16Column"))


def _bounds(lists: pa.ListArray) -> pa.Array:
    """Offsets of a list column without nulls, from 0."""
    return pa.array(np.cumsum([0, *lists.value_lengths().to_pylist()]), pa.int32())


def text_lines(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, start, end, rule_id, line): one line per diagnostic; order by the first four and message for a report."""
    rows = placed(diagnostics, docs)
    return rows.select("path", "start", "end", "rule_id", "message", F.format_string("%s:%s:%s: %s: %s [%s]", "path", "from_.line", "from_.column", "severity", "message", "rule_id").alias("line"))


def summary(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: the closing line of a text report."""
    return docs.agg(F.count(F.lit(1)).alias("files")).crossJoin(diagnostics.agg(F.count(F.lit(1)).alias("issues"))).select(F.format_string("%s file(s) checked, %s issue(s) found", "files", "issues").alias("line"))


def json_files(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, json): one object a file, those without a diagnostic included; keys by name."""
    span = F.struct("start", "end")
    item = F.struct("start", "end", "rule_id", "message", F.struct("fixes", "message", F.struct(_point(F.col("from_")).alias("start"), _point(F.col("to")).alias("end")).alias("position"), "rule_id", "severity", span.alias("span")).alias("it"))
    found = placed(diagnostics, docs).groupBy(F.col("path").alias("p")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["it"]).alias("diagnostics"))
    rows = docs.select("path").distinct().join(found, F.col("path") == F.col("p"), "left")
    empty = F.array().cast(dict((f.name, f.dataType) for f in rows.schema)["diagnostics"])
    return rows.select("path", F.to_json(F.struct(F.coalesce("diagnostics", empty).alias("diagnostics"), "path")).alias("json"))


def compact_json(diagnostics: DataFrame) -> DataFrame:
    """(doc_id, json): an array of {ruleId, severity, message, start, end} a document."""
    item = F.struct("start", "end", F.col("rule_id").alias("ruleId"), "message", "severity")
    out = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["ruleId"].alias("ruleId"), x["severity"].alias("severity"), x["message"].alias("message"), x["start"].alias("start"), x["end"].alias("end")))
    return diagnostics.groupBy("doc_id").agg(F.to_json(out).alias("json"))


def sarif_rules(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """(rule_id, rule_index): rules in order of first appearance; there are as many rows as rules."""
    from pyspark.sql import Window

    first = placed(diagnostics, docs).groupBy("rule_id").agg(F.min(F.struct("path", "start", "end", "rule_id", "message")).alias("first"))
    return first.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))


def sarif_results(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, start, end, rule_id, message, json): a SARIF result object per diagnostic; the end column is exclusive."""
    index = F.broadcast(sarif_rules(diagnostics, docs))  # a row per rule
    rows = placed(diagnostics, docs).join(index, "rule_id")
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[F.col("severity")]
    region = F.struct(F.col("from_.line").alias("startLine"), F.col("from_.column").alias("startColumn"), F.col("to.line").alias("endLine"), F.col("to.column").alias("endColumn"))
    uri = F.replace("path", F.lit("\\"), F.lit("/"))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    body = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    return rows.select("path", "start", "end", "rule_id", "message", F.to_json(body).alias("json"))


def sarif_log(diagnostics: DataFrame, docs: DataFrame, tool: str = "inkspect", version: str = "0.1.0") -> str:
    """A whole SARIF 2.1.0 log as text, for reports that a person reads; see ``write_sarif``."""
    import io

    out = io.StringIO()
    write_sarif(out, diagnostics, docs, tool, version)
    return out.getvalue()


def write_sarif(out, diagnostics: DataFrame, docs: DataFrame, tool: str = "inkspect", version: str = "0.1.0") -> None:
    """Write a SARIF 2.1.0 log to a text file, a result at a time: the driver holds a partition of them at most."""
    import json

    rules = [{"id": r.rule_id} for r in sarif_rules(diagnostics, docs).orderBy("rule_index").collect()]  # a row per rule
    driver = json.dumps({"name": tool, "version": version, "rules": rules}, ensure_ascii=False)
    out.write(f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {driver}}}, "results": [')
    rows = sarif_results(diagnostics, docs).orderBy("path", "start", "end", "rule_id", "message")
    for i, r in enumerate(rows.toLocalIterator()):
        out.write((",\n" if i else "\n") + r.json)
    out.write("\n]}]}\n")


def status(diagnostics: DataFrame, errors: DataFrame | None = None) -> int:
    """0 clean, 1 with findings, 2 with errors."""
    if errors is not None and not errors.isEmpty():
        return 2
    return int(not diagnostics.isEmpty())
