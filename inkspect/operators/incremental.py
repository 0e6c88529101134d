"""The fixpoint of fixes, linting in each pass only the nodes that an edit has touched.

A document is a row with its text and its nodes, and a node has the fixes that its rules
found.  A pass takes fixes greedily, as ``fixes.fixed`` does, and makes a piece table: the
runs of the old text that stay, each with the shift that is the sum of all growth before
it.  A node within one run is not touched: it moves by that shift, and its fixes with
it.  A changed text is taken apart again, and its nodes are met with the moved ones by
place; those without a partner are linted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FIX
from ..plans.config import Active
from ..plans.linter import found_in_slice, lint_slices, node_texts
from ..sources.plain import KIND, plain_nodes
from .fixes import PASSES, apart, applied_to, edited
from .registry import RULES, TEXT
from .surface import terms_beside
from .terms import row_slices

NODE = f"struct<start:int,end:int,fixes:array<{FIX}>>"
PASSED = f"text string, changed boolean, applied int, deferred int, moved array<{NODE}>"


def _free(starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, shift) of the nodes that lie within one piece and touch neither end where an edit is."""
    piece = np.searchsorted(begins, starts, "right") - 1
    last = len(begins) - 1
    free = np.flatnonzero(((starts > begins[piece]) | (piece == 0)) & ((stops < ends[piece]) | ((piece == last) & (stops <= ends[piece]))))
    return free, shifts[piece[free]]


def moved(nodes: list[dict], pieces: list[tuple[int, int, int]]) -> list[dict]:
    """The nodes that lie within one piece and touch neither end where an edit is, at their new place."""
    if not nodes:
        return []
    free, shifts = _free(*(np.array([n[k] for n in nodes], np.int64) for k in ("start", "end")), *(np.array(x, np.int64) for x in zip(*pieces)))
    out = []
    for i, by in zip(free.tolist(), shifts.tolist()):
        n = nodes[i]
        out.append({"start": n["start"] + by, "end": n["end"] + by, "fixes": [{"start": f["start"] + by, "end": f["end"] + by, "replacement": f["replacement"]} for f in n["fixes"]]})
    return out


def _cut(data: bytes, starts: np.ndarray, stops: np.ndarray, new: pa.Array) -> tuple[bytes, tuple[np.ndarray, ...], int, int]:
    """(new text, starts, ends and shifts of its pieces, applied, deferred), as ``edited`` gives them."""
    order = np.lexsort((-stops, starts))
    begin, stop = starts[order], stops[order]
    if len(order) and not apart(data, begin, stop):
        text, pieces, applied, deferred = edited(data, zip(starts.tolist(), stops.tolist(), new.to_pylist()))
        return text, tuple(np.array(x, np.int64) for x in zip(*pieces)), applied, deferred
    text, applied, deferred = applied_to(data, starts, stops, new)
    grown = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)[order] - (stop - begin)
    return text, (np.append(0, stop), np.append(begin, len(data)), np.append(0, np.cumsum(grown))), applied, deferred


def _places(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(column.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))


def _ends(lists: pa.ListArray) -> np.ndarray:
    return np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))


def _passed(state: DataFrame) -> DataFrame:
    """(doc_id, text, changed, applied, deferred, moved) after one pass over (doc_id, text, nodes)."""
    kinds = T.StructType([state.schema["doc_id"], *T._parse_datatype_string(PASSED).fields])

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                yield one(batch.slice(a, b - a))

    def one(batch):
        data, nodes = batch.column(1).cast(pa.large_string()).cast(pa.large_binary()), batch.column(2).flatten()
        fixes = nodes.field(2)
        flat, of_node = fixes.flatten(), _ends(fixes)
        (starts, stops), (begin, stop), new = _places(nodes), _places(flat), flat.field(2)
        rows, picks, shifts, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        of_row = _ends(batch.column(2)).tolist()
        for i, (a, b) in enumerate(zip(of_row, of_row[1:])):
            before, x, y = data[i].as_py(), of_node[a], of_node[b]
            text, pieces, applied, deferred = _cut(before, begin[x:y], stop[x:y], new.slice(x, y - x))
            rows.append((text.decode(), text != before, applied, deferred))
            free, by = _free(starts[a:b], stops[a:b], *pieces) if text != before else (picks[0], shifts[0])
            picks.append(free + a)
            shifts.append(by)
            counts.append(len(free))
        pick, by = np.concatenate(picks), np.concatenate(shifts)
        own = fixes.take(pa.array(pick))
        inner, further = own.flatten(), np.repeat(by, np.diff(_ends(own)))
        fix = pa.StructArray.from_arrays([*(pa.array(x + further, pa.int32()) for x in _places(inner)), inner.field(2)], ["start", "end", "replacement"])
        node = pa.StructArray.from_arrays([pa.array(starts[pick] + by, pa.int32()), pa.array(stops[pick] + by, pa.int32()), pa.ListArray.from_arrays(pa.array(_ends(own), pa.int32()), fix)], ["start", "end", "fixes"])
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), node)], kinds.fieldNames())

    return state.select("doc_id", "text", "nodes").mapInArrow(run, kinds)


def _nodes(docs: DataFrame, slices: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, start, end, text) of all text nodes; places are those in the document."""
    rows = slices(docs).select("doc_id", F.col("start").alias("base"), F.explode(node_texts([KIND["text"]])).alias("node"))
    start = F.col("base") + F.col("node.start")
    return rows.select("doc_id", start.alias("start"), (start + F.octet_length("node.text")).alias("end"), F.col("node.text").alias("text"))


def _linted(nodes: DataFrame, rules: list[Active]) -> DataFrame:
    """(doc_id, start, end, fixes) of nodes, each linted on its own; ``slice_id`` is its end."""
    own = nodes.select("doc_id", F.col("end").cast("long").alias("slice_id"), F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("string").alias("column_name"), F.lit("plain").alias("parse_mode"), "start", "text", plain_nodes(F.col("text")).alias("nodes"))
    found = lint_slices(own.withColumn("slice_id", F.shiftleft(F.col("start").cast("long"), 32) + F.col("slice_id")), rules).where(F.size("fixes") > 0)
    each = found.select("doc_id", "slice_id", F.explode("fixes").alias("fix"))
    return each.groupBy("doc_id", "slice_id").agg(F.collect_list("fix").cast(f"array<{FIX}>").alias("fixes")).select("doc_id", F.shiftright("slice_id", 32).cast("int").alias("start"), F.col("slice_id").bitwiseAND((1 << 32) - 1).cast("int").alias("end"), "fixes")


def _beside(rules: list[Active]) -> bool:
    """Whether some rule's findings are not part of the one expression over a slice."""
    return any(r.id == "ja-prh" and terms_beside(F.col("text"), r.options) for r in rules)


def _in_place(nodes: DataFrame, rules: list[Active]) -> DataFrame:
    """(doc_id, start, end, fixes) of all nodes: fixes that are known, and what linting finds in the others, without an exchange."""
    place = lambda c: c + F.col("start")
    found = F.flatten(F.transform(found_in_slice(rules), lambda x: x["fixes"]))
    new = F.transform(found, lambda f: F.struct(place(f["start"]).alias("start"), place(f["end"]).alias("end"), f["replacement"].alias("replacement"))).cast(f"array<{FIX}>")
    rows = nodes.withColumn("nodes", plain_nodes(F.col("text")))
    return rows.select("doc_id", "start", "end", F.when(F.col("known").isNotNull(), F.col("known")).otherwise(new).alias("fixes"))


def _state(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text, nodes): nodes (doc_id, start, end, fixes) beside their documents."""
    own = nodes.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end", "fixes")).cast(f"array<{NODE}>").alias("nodes"))
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", F.coalesce("nodes", F.array().cast(f"array<{NODE}>")).alias("nodes"))


def fix_incremental(docs: DataFrame, slices: Callable[[DataFrame], DataFrame], rules: list[Active], keep: Callable[[DataFrame, str], DataFrame], linted: list[int] | None = None) -> DataFrame:
    """(doc_id, text, passes): as ``fixes.fix`` with these rules, which look at text nodes alone.

    slices(docs) takes documents apart; keep(df, name) writes a table and reads it back.
    How many nodes each pass has linted is added to ``linted``.  Null text is empty;
    rows must not repeat an id.  An empty table gives no row.
    """
    if any(RULES[r.id].scope != TEXT for r in rules):
        raise ValueError("only rules on text nodes can be run node by node")
    place = ["doc_id", "start", "end"]
    same_place = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))
    empty = F.array().cast(f"array<{FIX}>")

    def found(nodes: DataFrame) -> DataFrame:
        """The nodes with their fixes: those that are known, and what linting finds in the others."""
        direct = not _beside(rules)
        if direct and linted is None:
            return _in_place(nodes, rules)
        nodes = keep(nodes, "fix-nodes")
        fresh = nodes.where("known IS NULL").drop("known")
        if linted is not None:
            linted.append(fresh.count())
        if direct:
            return _in_place(nodes, rules)
        hits = _linted(fresh, rules).toDF("d", "s", "e", "fixes")
        new = fresh.join(hits, same_place, "left").select(*place, F.coalesce("fixes", empty).alias("fixes"))
        return new.unionByName(nodes.where("known IS NOT NULL").select(*place, F.col("known").alias("fixes")))

    now, done = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), None
    state = keep(_state(now, found(_nodes(now, slices).withColumn("known", F.lit(None).cast(f"array<{FIX}>")))), "fix-state")
    for n in range(1, PASSES + 1):
        after = keep(_passed(state), f"fix-{n}")
        same = after.where("NOT changed" if n < PASSES else "true").select("doc_id", "text", F.lit(n).alias("passes"))
        done = same if done is None else done.unionByName(same)
        still = after.where("changed")
        if n == PASSES or still.isEmpty():
            return done
        old = still.select(F.col("doc_id").alias("d"), F.inline("moved")).select("d", F.col("start").alias("s"), F.col("end").alias("e"), F.col("fixes").alias("known")).dropDuplicates(["d", "s", "e"])
        texts = still.select("doc_id", "text")
        nodes = _nodes(texts, slices).join(old, same_place, "left").drop("d", "s", "e")
        state = keep(_state(texts, found(nodes)), "fix-state")
    return done
