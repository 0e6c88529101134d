"""Terms of a dictionary in texts: one automaton for all of them, and a join by grams where they are too many.

The automaton is Aho and Corasick's in flat arrays: a dense table of the next state for
a state and a class of bytes, and for each state the term that ends there and the next
shorter end.  It runs on the bytes of an Arrow column, thousands of stretches of text in
step, each begun early enough that the longest term is seen whole.  So the time for a
byte does not depend on the number of terms, as long as the table stays under
``LARGEST`` bytes, which is checked.

Beyond that, terms stay a table.  Of each term the gram (six bytes of it, or three) is
taken that the fewest terms have; texts are joined with them on grams, after a bitmap of
fixed size has passed over those that no term has, and each block of texts is read with an
automaton of the terms it met.  Matches of one term don't overlap; those of different terms may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import HIT
from ..plans.store import table

#: Bytes of an automaton's table, of text that is read at once, of a stretch, and of text that meets terms together.
LARGEST, SLICE, STRETCH, BLOCK = 64 << 20, 2 << 20, 512, 4 << 20
GRAMS = (6, 3)
#: Bits of the bitmap over the grams of terms.
BITS = 1 << 24


class Automaton:
    """All given terms at once; each is (pattern, expected), and patterns are not empty."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs
        patterns = [p.encode() for p, _ in pairs]
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        used = sorted(set(b"".join(patterns)))
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)  # UTF-8 leaves some bytes out, so 0 is free
        self._build(patterns, len(used) + 1)
        #: Where the text goes on so that it has the expected form already, a match is none.
        self.ahead = {i: x.encode() for i, (p, x) in enumerate(pairs) if x.startswith(p)}

    @staticmethod
    def size(total: int, different: int) -> int:
        """The most bytes that the table of terms of so many bytes, and so many different ones, can take."""
        return 4 * (total + 1) * (different + 1)

    def _build(self, patterns: list[bytes], width: int) -> None:
        step, nodes, levels = {}, 1, []
        ends: list[list[int]] = [[]]
        for i, pattern in enumerate(patterns):
            at = 0
            for depth, c in enumerate(self.classes[np.frombuffer(pattern, np.uint8)].tolist()):
                after = step.get((at, c))
                if after is None:
                    after = step[at, c] = nodes
                    nodes += 1
                    ends.append([])
                    while len(levels) <= depth:
                        levels.append([])
                    levels[depth].append((after, at, c))
                at = after
            ends[at].append(i)
        self.next = np.zeros((nodes, width), np.int32)
        fail, shorter = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        has = np.array([bool(e) for e in ends])
        for depth, level in enumerate(levels):
            node, parent, c = (np.array(x, np.int64) for x in zip(*level))
            if depth:
                fail[node] = self.next[fail[parent], c]
            self.next[parent, c] = node
            self.next[node] = self.next[fail[node]]
            shorter[node] = np.where(has[fail[node]], fail[node], shorter[fail[node]])
        self.depth = len(levels)
        self.shorter, self.hit = shorter, has | (shorter > 0)
        self.hit[0] = False
        #: The terms that end in a state, as a range of ``terms``.
        self.first = np.cumsum([0, *map(len, ends)])
        self.terms = np.array([i for e in ends for i in e], np.int64)

    def _ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last byte, state) wherever terms end."""
        warm = self.depth - 1
        stretch = max(STRETCH, 4 * warm)
        lanes = -(-len(data) // stretch)
        padded = np.zeros(warm + lanes * stretch, np.uint8)
        padded[warm : warm + len(data)] = self.classes[data]
        state, flat, width = np.zeros(lanes, np.int64), self.next.reshape(-1), self.next.shape[1]
        places, states = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t in range(warm + stretch):
            column = padded[t : t + (lanes - 1) * stretch + 1 : stretch]
            state = flat.take(state * width + column).astype(np.int64)
            if t >= warm:
                lane = np.flatnonzero(self.hit[state])
                if len(lane):
                    places.append(lane * stretch + (t - warm))
                    states.append(state[lane])
        place, found = np.concatenate(places), np.concatenate(states)
        inside = place < len(data)
        return place[inside], found[inside]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start in it, term) of all matches in texts one after another, ordered by text, term and start."""
        if not len(data) or not len(self.pairs):
            return (np.empty(0, np.int64),) * 3
        last, state = self._ends(data)
        ends, terms = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(state):
            n = self.first[state + 1] - self.first[state]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ends.append(np.repeat(last, n) + 1)
            terms.append(self.terms[np.repeat(self.first[state], n) + within])
            more = self.shorter[state] > 0
            last, state = last[more], self.shorter[state[more]]
        end, term = np.concatenate(ends), np.concatenate(terms)
        start = end - self.lengths[term]
        text = np.searchsorted(offsets, end - 1, "right") - 1
        own = start >= offsets[text]
        start, term, text = start[own], term[own], text[own]
        one = len(offsets) * len(self.pairs) * len(data) < 1 << 62  # one number to sort by is faster than three
        order = np.argsort((text * len(self.pairs) + term) * len(data) + start) if one else np.lexsort([start, term, text])
        start, term, text = start[order], term[order], text[order]
        keep = np.ones(len(start), bool)
        # a match can go only if it begins within the one of its term before it, and few do
        past, before = 0, -1
        for i in (np.flatnonzero((text[1:] == text[:-1]) & (term[1:] == term[:-1]) & (start[1:] - start[:-1] < self.lengths[term[1:]])) + 1).tolist():
            if before != i - 1:
                past = start[i - 1] + self.lengths[term[i]]
            keep[i] = start[i] >= past
            past, before = start[i] + self.lengths[term[i]] if keep[i] else past, i
        if self.ahead:
            flagged = np.zeros(len(self.pairs), bool)
            flagged[list(self.ahead)] = True
            for i in np.flatnonzero(keep & flagged[term]).tolist():
                wanted = self.ahead[int(term[i])]
                keep[i] = data[start[i] : min(start[i] + len(wanted), offsets[text[i] + 1])].tobytes() != wanted
        return text[keep], (start - offsets[text])[keep], term[keep]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a column of texts without nulls."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def row_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes, one row at least."""
    offsets, at = _bytes(column)[1], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, end
        at = end


def _whole(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


def automata(pairs: list[tuple[str, str]], largest: int = LARGEST) -> list[Automaton]:
    """One automaton, or as many as keep each table under ``largest`` bytes; pairs that come twice count once, and those that change nothing not at all."""
    own, out, total, seen = [], [], 0, set()
    for p, x in sorted({(p, x) for p, x in pairs if p and p != x}):
        data = p.encode()
        if own and Automaton.size(total + len(data), len(seen | set(data))) > largest:
            out.append(Automaton(own))
            own, total, seen = [], 0, set()
        own.append((p, x))
        total, seen = total + len(data), seen | set(data)
    return [*out, *([Automaton(own)] if own else [])]


def hits(text: Column, pairs: list[tuple[str, str]], say) -> Column:
    """array<HIT> of a text for given pairs; say(pattern, expected) is the message.  Pairs that come twice count twice."""
    own = automata(pairs)
    times = {x: pairs.count(x) for x in set(pairs)} if len(set(pairs)) < len(pairs) else {}
    kind = T._parse_datatype_string(f"array<{HIT}>")

    @F.arrow_udf(kind)
    def search(column: pa.Array) -> pa.Array:
        texts, starts, ends, patterns, expected = [], [], [], [], []
        whole = _whole(column)
        for a, b in row_slices(whole):
            data, offsets = _bytes(whole.slice(a, b - a))
            for automaton in own:
                text, start, term = automaton.find(data, offsets)
                n = np.array([times.get(automaton.pairs[t], 1) for t in term.tolist()], np.int64) if times else 1
                text, start, term = (np.repeat(x, n) for x in (text, start, term)) if times else (text, start, term)
                texts.append(text + a)
                starts.append(start)
                ends.append(start + automaton.lengths[term])
                patterns += [say(*automaton.pairs[t]) for t in term.tolist()]
                expected += [automaton.pairs[t][1] for t in term.tolist()]
        empty = [np.empty(0, np.int64)]
        text, start, end = np.concatenate(empty + texts), np.concatenate(empty + starts), np.concatenate(empty + ends)
        order = np.argsort(text, kind="stable")
        places = [pa.array(x[order], pa.int32()) for x in (start, end)]
        pick = pa.array(order)
        new = pa.array(expected, pa.string()).take(pick)
        fix = pa.StructArray.from_arrays([*places, new], ["start", "end", "replacement"])
        fixes = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1), pa.int32()), fix)
        hit = pa.StructArray.from_arrays([*places, pa.array(patterns, pa.string()).take(pick), fixes], ["start", "end", "message", "fixes"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(len(column) + 1)), pa.int32()), hit)

    return search(text)


FOUND = "start int, end int, pattern string, expected string"


def _matches(batch: pa.RecordBatch, keys: int, column: int, own: list[Automaton]) -> Iterator[pa.RecordBatch]:
    """The first ``keys`` columns of a batch beside what is found in one."""
    names = [*batch.schema.names[:keys], "start", "end", "pattern", "expected"]
    for automaton in own:
        data, offsets = _bytes(_whole(batch.column(column)))
        text, start, term = automaton.find(data, offsets)
        rows = pa.array(text)
        patterns, expected = (pa.array([p[i] for p in automaton.pairs], pa.string()).take(pa.array(term)) for i in (0, 1))
        places = [pa.array(x, pa.int32()) for x in (start, start + automaton.lengths[term])]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(keys)), *places, patterns, expected], names)


def _found_type(texts: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(texts.schema[k] for k in keys), *T._parse_datatype_string(FOUND).fields])


def find_at_once(texts: DataFrame, pairs: list[tuple[str, str]], keys: list[str], column: str = "text") -> DataFrame:
    """(keys, start, end, pattern, expected) of given terms, in one pass over the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(automata(pairs))  # of a size that find() checks

    def run(batches):
        for batch in batches:
            for a, b in row_slices(_whole(batch.column(len(keys)))):
                yield from _matches(batch.slice(a, b - a), len(keys), len(keys), shared.value)

    return texts.select(*keys, column).mapInArrow(run, _found_type(texts, keys))


def _windows(data: np.ndarray, n: int) -> np.ndarray:
    """The grams of n bytes, as numbers that tell them and n apart."""
    if len(data) < n:
        return np.empty(0, np.int64)
    out = np.full(len(data) - n + 1, n << 56, np.int64)
    for i in range(n):
        out |= data[i : len(data) - n + 1 + i].astype(np.int64) << (8 * i)
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def _grams_of_terms(terms: DataFrame) -> DataFrame:
    """(pattern, expected, gram, slot): each term of three bytes or more under its gram that the fewest terms have."""

    def run(batches):
        for batch in batches:
            data = [np.frombuffer(p.encode(), np.uint8) for p in batch.column(0).to_pylist()]
            own = [np.unique(_windows(x, GRAMS[0] if len(x) >= GRAMS[0] else GRAMS[1])) for x in data]
            gram, of = np.concatenate([np.empty(0, np.int64), *own]), pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(gram), pa.array(_slot(gram))], ["pattern", "expected", "gram", "slot"])

    every = terms.where(f"octet_length(pattern) >= {GRAMS[1]}").select("pattern", "expected").mapInArrow(run, "pattern string, expected string, gram long, slot long")
    held = every.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    return every.join(held, "gram").groupBy("pattern", "expected").agg(F.min(F.struct("held", "gram", "slot")).alias("best")).select("pattern", "expected", "best.gram", "best.slot")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Which slots have a gram: BITS bits, put together by the executors."""
    parts = grams.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(BITS + (1 << 15), np.uint8)
    for row in parts:
        bits = np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little")
        # places begin at 1 in the first part; 0 has a part of its own
        at = (row.part - 1) * len(bits) + 1
        out[max(at, 0) : at + len(bits)] |= bits[max(-at, 0) :]
    return out[:BITS]


def _own(terms: DataFrame) -> DataFrame:
    """The terms that change something, once each, written so that they are made once."""
    return table(terms.where("pattern <> '' AND NOT pattern <=> expected AND expected IS NOT NULL").select("pattern", "expected").distinct(), "terms")


def _blocks(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, block): texts in runs of about BLOCK bytes."""
    kinds = T.StructType([*(texts.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("block", T.LongType())])

    def run(batches):
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            blocks = []
            for size in np.diff(_bytes(_whole(batch.column(len(keys))))[1]).tolist():
                if held and held + size > BLOCK:
                    block, held = block + 1, 0
                held += size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], kinds.fieldNames())

    return texts.select(*keys, F.col(column).alias("text")).mapInArrow(run, kinds)


def find_by_join(texts: DataFrame, terms: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, start, end, pattern, expected) of a table of terms (pattern, expected); none of it is held whole anywhere.

    Terms under three bytes, of which there are few enough for an automaton, are read at once.
    Texts meet terms in blocks: a gram counts once in a block, and its terms come once.
    """
    return _joined(texts, _own(terms), keys, column)


def _joined(texts: DataFrame, own: DataFrame, keys: list[str], column: str) -> DataFrame:
    grams = table(_grams_of_terms(own), "term-grams")
    there = texts.sparkSession.sparkContext.broadcast(_bitmap(grams))  # BITS bytes
    n = len(keys)
    names = [f"key_{i}" for i in range(n)]
    rows = table(_blocks(texts.select(*(F.col(k).alias(x) for k, x in zip(keys, names)), F.col(column).alias("text")), names, "text"), "term-texts")

    def met(batches):
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(edges, edges[1:]):
                part, found = _whole(batch.column(1).slice(i, j - i)), []
                for a, b in row_slices(part):
                    data = _bytes(part.slice(a, b - a))[0]  # grams over two texts are met for nothing
                    for k in GRAMS:
                        grams = _windows(data, k)
                        found.append(np.unique(grams[there.value[_slot(grams)] > 0]))
                every = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), blocks[i] if j > i else 0)), pa.array(every)], ["block", "gram"])

    wanted = rows.select("block", "text").mapInArrow(met, "block long, gram long").join(grams, "gram").select("block", "pattern", "expected").distinct()
    kinds = _found_type(rows, names)

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        own, out = automata(list(zip(given.column(1).to_pylist(), given.column(2).to_pylist()))), []
        for batch in texts.to_batches() if own else []:
            for a, b in row_slices(_whole(batch.column(n))):
                out += _matches(batch.slice(a, b - a), n, n, own)
        return pa.Table.from_batches(out, to_arrow_schema(kinds) if not out else None)

    long = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, kinds)
    short = [tuple(r) for r in own.where(f"octet_length(pattern) < {GRAMS[1]}").collect()]
    found = long.unionByName(find_at_once(rows, short, names)) if short else long
    return found.toDF(*keys, "start", "end", "pattern", "expected")


def find(texts: DataFrame, terms: DataFrame, keys: list[str], column: str = "text", largest: int = LARGEST) -> DataFrame:
    """(keys, start, end, pattern, expected): all matches of the terms (pattern, expected) in the texts; offsets are bytes.

    Matches of one pattern don't overlap, the first counts.  Where the text goes on so that
    it has the expected form already, there is no match.  Null text is empty; terms that are
    empty, null or as expected are left out, and repeated ones count once.  Repeated texts
    are found in as often.  Terms whose automaton may be over ``largest`` bytes are joined.
    """
    own = _own(terms)
    total = own.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    if Automaton.size(total, 255) <= largest:
        return find_at_once(texts, [tuple(r) for r in own.collect()], keys, column)
    return _joined(texts, own, keys, column)
