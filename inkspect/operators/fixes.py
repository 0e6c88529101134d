"""Fixes: a document's sorted fixes taken greedily, and the bounded fixpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FIX
from ..plans.store import drop
from .terms import Automaton, automata, row_slices

PASSES = 10


def edited(data: bytes, fixes: Iterable[tuple[int, int, str]]) -> tuple[bytes, list[tuple[int, int, int]], int, int]:
    """(new text, piece table of (start, end, shift) of what stays, applied, deferred).

    By start, longest first, then replacement.  A fix is deferred that begins before the
    last one's end, is reversed, past the end, or cuts a character in two.
    """
    out, pieces, at, shift, applied, deferred = [], [], 0, 0, 0, 0
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for start, end, new in sorted(fixes, key=lambda f: (f[0], -f[1], f[2].encode())):
        if not at <= start <= end <= len(data) or inside(start) or inside(end):
            deferred += 1
            continue
        pieces.append((at, start, shift))
        out += [data[at:start], raw := new.encode()]
        shift, at, applied = shift + len(raw) - (end - start), end, applied + 1
    pieces.append((at, len(data), shift))
    return b"".join([*out, data[at:]]), pieces, applied, deferred


def apart(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bool:
    """Whether all of these fixes, which are in order, can be applied: none of two in one place, none that ``edited`` would defer."""
    raw = np.frombuffer(data, np.uint8)
    at = np.concatenate([starts, ends])
    if at.min() < 0 or at.max() > len(raw) or (starts > ends).any() or (starts[1:] < ends[:-1]).any() or ((starts[1:] == starts[:-1]) & (ends[1:] == ends[:-1])).any():
        return False
    at = at[at < len(raw)]
    return not ((raw[at] & 0xC0) == 0x80).any()


def applied_to(data: bytes, starts: np.ndarray, ends: np.ndarray, new: pa.Array) -> tuple[bytes, int, int]:
    """(new text, applied, deferred), as ``edited`` gives them; time is linear in the text and its fixes."""
    if not len(starts):
        return data, 0, 0
    order = np.lexsort((-ends, starts))
    if not apart(data, starts[order], ends[order]):
        text, _, applied, deferred = edited(data, zip(starts.tolist(), ends.tolist(), new.to_pylist()))
        return text, applied, deferred
    begin, stop = starts[order].tolist(), ends[order].tolist()
    out = [b""] * (2 * len(begin) + 1)
    out[::2] = [data[a:b] for a, b in zip([0, *stop], [*begin, len(data)])]
    out[1::2] = new.cast(pa.binary()).take(pa.array(order)).to_pylist()
    return b"".join(out), len(begin), 0


def _all_applied(texts: pa.Array, lists: pa.Array) -> list[tuple[bytes, int, int]]:
    """(new text, applied, deferred) of each text and its list of fixes; null text and null fixes are empty."""
    data, flat = texts.cast(pa.large_string()).cast(pa.large_binary()), lists.flatten()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).tolist()
    starts, stops = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
    new = flat.field(2)
    return [applied_to(data[i].as_py() or b"", starts[a:b], stops[a:b], new.slice(a, b - a)) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def fixed(text: Column, fixes: Column) -> Column:
    """struct<text, applied, deferred>: fixes by start, longest first, then replacement; null text and null fixes are empty.

    A fix is deferred if it begins before the last one's end, if its span is
    reversed or past the end, or if it cuts a character in two.  Insertions at one
    place are all applied.  A text that grows fix by fix in a fold is copied each time,
    so Arrow batches go to Python, where what stays and what is new is joined once.
    """

    @F.arrow_udf("struct<text:string,applied:int,deferred:int>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        done = _all_applied(texts, lists)
        out = pa.array([x[0].decode() for x in done], pa.string())
        return pa.StructArray.from_arrays([out, *(pa.array([x[c] for x in done], pa.int32()) for c in (1, 2))], ["text", "applied", "deferred"])

    return run(F.coalesce(text, F.lit("")), F.coalesce(fixes, F.array().cast(f"array<{FIX}>")))


def _beside(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, text, fixes): documents and the fixes of their diagnostics."""
    fixes = diagnostics.where(F.size("fixes") > 0).select(F.col("doc_id").alias("of"), F.explode("fixes").alias("fix")).groupBy("of").agg(F.collect_list("fix").cast(f"array<{FIX}>").alias("fixes"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(fixes, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "fixes")


def apply_fixes(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, text, applied, deferred): every document with the fixes of its diagnostics; null text is empty."""
    return _beside(docs, diagnostics).select("doc_id", fixed(F.col("text"), F.col("fixes")).alias("r")).select("doc_id", "r.text", "r.applied", "r.deferred")


def _passed(rows: DataFrame) -> DataFrame:
    """(doc_id, text, changed) after one pass over (doc_id, text, fixes)."""
    kinds = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("text string, changed boolean").fields])

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                own = batch.slice(a, b - a)
                new = pa.array([x[0].decode() for x in _all_applied(own.column(1), own.column(2))], pa.string())
                yield pa.RecordBatch.from_arrays([own.column(0), new, pc.not_equal(new, own.column(1).cast(pa.string()))], kinds.fieldNames())

    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "fixes").mapInArrow(run, kinds)


def fix(docs: DataFrame, find: Callable[[DataFrame], DataFrame], keep: Callable[..., DataFrame]) -> DataFrame:
    """(doc_id, text, passes): fix again what the last pass changed, at most ten times.

    find(docs) gives diagnostics; keep(df, name, by) writes a table, in a folder for each
    value of ``by`` if that is given, and reads it back, which cuts the lineage between passes.
    What a pass changed stands apart from what it didn't, and goes once the next pass is written.
    """
    now, done = keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "fix-0"), None
    spent = lambda first=now: drop(first)
    for n in range(1, PASSES + 1):
        after = keep(_passed(_beside(now, find(now))), f"fix-{n}", "changed")
        spent()
        still = after.where("changed").select("doc_id", "text")
        same = after.where("NOT changed" if n < PASSES else "true").select("doc_id", "text", F.lit(n).alias("passes"))
        done = same if done is None else done.unionByName(same)
        if n == PASSES or still.isEmpty():
            return done
        now, spent = still, lambda last=after: drop(last, "changed=true")
    return done


def taken(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of these spans, none empty and in order, begin at or after the end of the last one taken."""
    furthest = np.maximum.accumulate(ends)
    out = np.append(True, starts[1:] >= furthest[:-1])  # these begin anew, whatever was taken before
    first = np.flatnonzero(out)
    for a, b in zip(first.tolist(), np.append(first[1:], len(out)).tolist()) if len(first) < len(out) else ():
        if b - a > 2:  # the second of two meets the first
            past = ends[a]
            for i in range(a + 1, b):
                if starts[i] >= past:
                    out[i], past = True, ends[i]
    return out


def replaced(data: bytes, offsets: np.ndarray, own: list[Automaton]) -> tuple[bytes, np.ndarray]:
    """Texts one after another, and where each begins and ends, after one pass with all terms of the automata, which are in order."""
    raw, found = np.frombuffer(data, np.uint8), [np.empty((4, 0), np.int64)]
    for k, automaton in enumerate(own):
        text, start, term = automaton.find(raw, offsets)
        found.append(np.stack([start := start + offsets[text], start + automaton.lengths[term], np.full(len(term), k), term]))
    start, end, k, term = np.concatenate(found, axis=1)
    if not len(start):
        return data, offsets
    order = np.lexsort((term, k, -end, start))
    order = order[taken(start[order], end[order])]
    begin, stop = start[order], end[order]
    new = [own[a].pairs[t][1].encode() for a, t in zip(k[order].tolist(), term[order].tolist())]
    out = [b""] * (2 * len(new) + 1)
    out[::2] = [data[a:b] for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(data)])]
    out[1::2] = new
    shift = np.append(0, np.cumsum(np.array([len(x) for x in new], np.int64) - (stop - begin)))
    return b"".join(out), offsets + shift[np.searchsorted(begin, offsets)]


def settled(texts: list[bytes], own: list[Automaton], most: int) -> tuple[list[bytes], list[int]]:
    """(texts, passes) once a pass changes nothing, or after the most passes."""
    out, passes, still = list(texts), [0] * len(texts), list(range(len(texts)))
    for n in range(1, most + 1):
        offsets = np.append(0, np.cumsum([len(out[i]) for i in still])).astype(np.int64)
        data, at = replaced(b"".join([out[i] for i in still]), offsets, own)
        at, changed = at.tolist(), []
        for i, a, b in zip(still, at, at[1:]):
            passes[i], new = n, data[a:b]
            if new != out[i]:
                out[i] = new
                changed.append(i)
        still = changed
        if not still:
            break
    return out, passes


def fix_terms(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, text, passes): as ``fix`` with a rule of these literal terms alone.

    A document hangs on no other, so all its passes are made where it is, in slices of a
    batch: no table stands between passes, and nothing is dealt out.
    """
    kinds = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("text string, passes int").fields])
    shared, most = docs.sparkSession.sparkContext.broadcast(automata(pairs)), PASSES

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
                new, passes = settled(texts, shared.value, most)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.decode() for x in new], pa.string()), pa.array(passes, pa.int32())], kinds.fieldNames())

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, kinds)
