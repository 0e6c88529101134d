"""Column helpers: regex matches with byte spans, byte slices, positions, sentences.

Spans are half-open offsets in UTF-8 bytes.  All columns stay in Catalyst.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIX = "struct<start:int,end:int,replacement:string>"
HIT = f"struct<start:int,end:int,message:string,fixes:array<{FIX}>>"
CHUNK = 32


def quote(literal: str) -> str:
    """A regex for the literal text."""
    return "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in literal)


def char_class(chars: str) -> str:
    """A class of these characters.

    The engine tries the members one after another, but for the first 256.  So wider
    ones stand in groups behind their ranges, and all of those behind one look at
    whether a character is ASCII.
    """
    points = sorted(set(map(ord, chars)))
    one = lambda p: f"\\x{{{p:x}}}"
    low, wide = [p for p in points if p < 128], [p for p in points if p >= 128]
    groups = [wide[i : i + 6] for i in range(0, len(wide), 6)]
    parts = [f"[{one(g[0])}-{one(g[-1])}&&[{''.join(map(one, g))}]]" if len(g) > 2 and len(groups) > 1 else "".join(map(one, g)) for g in groups]
    inner = "".join(parts)
    return f"[{''.join(map(one, low))}{wider(f'[{inner}]') if len(wide) > 2 else inner}]"


def wider(inner: str) -> str:
    """A class of none but wide characters, behind one look at whether a character is ASCII."""
    return f"[\\x{{80}}-\\x{{10ffff}}&&{inner}]"


@lru_cache
def folded() -> dict[str, str]:
    """Character in lower case -> all that are equal to it without regard to case."""
    out: dict[str, str] = {}
    for c in map(chr, range(0x10000)):
        low = c.upper().lower() if len(c.upper()) == 1 else c.lower()
        if len(low) == 1:
            out[low] = out.get(low, "") + c
    return out


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starting(words: list[str], fold: bool = False) -> str:
    """A regex for any of the words, literally and in this order; where none can begin, one look at a character tells.  fold: without regard to case."""
    first = "".join(dict.fromkeys(w[0] for w in words))
    if fold:
        first = "".join(folded().get(c.lower(), c) + c for c in first)
    return f"(?={char_class(first)})(?{'iu' if fold else ''}:{'|'.join(map(quote, words))})"


def pieces(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,value,gap>>: the matches of a pattern that never matches nothing, and the text before each."""
    return _placed(text, pattern, ["gap"])


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,value>> of the non-overlapping matches of a pattern that never matches nothing."""
    return _placed(text, pattern, [])


def _placed(text: Column, pattern: str | Column, more: list[str]) -> Column:
    """Matches with byte offsets, which are running sums over gaps and matches.

    An array that grows in a fold is copied at each step, so sums run inside chunks,
    then over the chunks' totals: n * CHUNK + (n / CHUNK)^2 steps, short ones, instead
    of n^2.  What grows there are plain numbers; structs, whose copies cost most, are
    made once, at the end.  A text without a match costs one search.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = f"array<struct<start:int,end:int,value:string{',gap:string' if more else ''}>>"
    gaps, found = F.split(text, p, -1), F.regexp_extract_all(text, F.concat(F.lit("("), p, F.lit(")")), F.lit(1))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def inside(both: Column, chunk: Column) -> Column:
        """struct<at,out>: bytes of a chunk's gaps and matches, and where its matches start in it."""

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.octet_length(F.get(both["gaps"], i))
            return F.struct((start + F.octet_length(F.get(both["found"], i))).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

        return F.aggregate(F.sequence(chunk * CHUNK, F.least(chunk * CHUNK + CHUNK, F.size(both["found"])) - 1), begin, step)

    def bases(parts: Column) -> Column:
        return F.aggregate(parts, begin, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def starts(both: Column) -> Column:
        chunked = F.transform(F.sequence(F.lit(0), F.floor((F.size(both["found"]) - 1) / CHUNK).cast("int")), lambda c: inside(both, c))
        return bound(chunked, lambda parts: F.flatten(F.zip_with(parts, bases(parts), lambda part, base: F.transform(part["out"], lambda at: at + base))))

    def placed(both: Column) -> Column:
        def piece(start: Column, m: Column, gap: list[Column]) -> Column:
            return F.struct(start.alias("start"), (start + F.octet_length(m)).alias("end"), m.alias("value"), *(g.alias("gap") for g in gap))

        if not more:
            return F.zip_with(starts(both), both["found"], lambda start, m: piece(start, m, []))
        return bound(starts(both), lambda at: F.transform(both["found"], lambda m, i: piece(F.get(at, i), m, [F.get(both["gaps"], i)])))

    return F.when(F.rlike(text, p), bound(F.struct(found.alias("found"), gaps.alias("gaps")), placed)).otherwise(F.array().cast(kind))


def each_of(rows: DataFrame, keep: list[str], found: Column) -> DataFrame:
    """``keep`` and the fields of each struct of the array ``found``; none of its structs has a null as its first field.

    For a plain ``inline`` the optimiser asks before whether the array holds anything, by
    the array's own expression with all that it is made of written out in it, which so is
    worked out several times over.  The outer form asks nothing; its rows of nulls go after.
    """
    kind = rows.select(found.alias("f")).schema["f"].dataType.elementType
    return rows.select(*keep, found.alias("found__")).select(*keep, F.inline_outer("found__")).where(F.col(kind.fieldNames()[0]).isNotNull())


def hits(found: Column, message) -> Column:
    """Diagnostics without fixes from matches; message: a Column, or a function of a match."""
    text = message if callable(message) else lambda m: message
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), text(m).alias("message"), F.array().cast(f"array<{FIX}>").alias("fixes")))


def no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def code_point(char: Column) -> Column:
    """U+0041 and so on, with four digits at least."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def positions(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Lines, columns and UTF-16 columns (three rows) of byte offsets, counted from 1; an offset inside a character counts as its start.

    One pass over the text, and a search for each offset.
    """
    data = np.frombuffer(raw, np.uint8)
    at = np.clip(offsets, 0, len(data))
    follows = np.concatenate([(data & 0xC0) == 0x80, [False]])
    for _ in range(3):  # step back out of a character
        at = at - (follows[at] & (at > 0))
    chars = np.concatenate([[0], np.cumsum(~follows[:-1])])
    units = chars + np.concatenate([[0], np.cumsum(data >= 0xF0)])
    begins = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    line = np.searchsorted(begins, at, "right")
    begin = begins[line - 1]
    return np.stack([line, chars[at] - chars[begin] + 1, units[at] - units[begin] + 1])


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,line,column,utf16_column>> of the starts of ``matches``, as ``positions`` gives them.

    A text is read once: its gaps and matches are measured, and the measures are
    summed in chunks as in ``matches``.  Columns start again after a line end.
    """
    place = "struct<at:int,lines:int,chars:int,units:int>"

    def measure(piece: Column) -> Column:
        last = F.substring_index(piece, "\n", -1)
        lines = F.char_length(piece) - F.char_length(F.replace(piece, F.lit("\n"), F.lit("")))
        units = (F.octet_length(F.encode(last, "UTF-16BE")) / 2).cast("int")
        return F.struct(F.octet_length(piece).alias("at"), lines.alias("lines"), F.char_length(last).alias("chars"), units.alias("units"))

    def after(a: Column, b: Column) -> Column:
        tail = lambda name: (F.when(b["lines"] > 0, b[name]).otherwise(a[name] + b[name])).alias(name)
        return F.struct((a["at"] + b["at"]).alias("at"), (a["lines"] + b["lines"]).alias("lines"), tail("chars"), tail("units"))

    origin = F.struct(*(F.lit(0).alias(n) for n in ("at", "lines", "chars", "units")))
    begin = F.struct(origin.alias("at"), F.array().cast(f"array<{place}>").alias("out"))

    def inside(real: Column, chunk: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            m = F.get(real, i)
            start = after(acc["at"], m["gap"])
            return F.struct(after(start, m["value"]).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

        return F.aggregate(F.sequence(chunk * CHUNK, F.least(chunk * CHUNK + CHUNK, F.size(real)) - 1), begin, step)

    def bases(parts: Column) -> Column:
        return F.aggregate(parts, begin, lambda acc, c: F.struct(after(acc["at"], c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def counted(m: Column) -> Column:
        return F.struct(m["at"].alias("start"), (m["lines"] + 1).alias("line"), (m["chars"] + 1).alias("column"), (m["units"] + 1).alias("utf16_column"))

    def placed(real: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(real) - 1) / CHUNK).cast("int")), lambda c: inside(real, c))
        return bound(parts, lambda ps: F.flatten(F.zip_with(ps, bases(ps), lambda part, base: F.transform(part["out"], lambda m: counted(after(base, m))))))

    gaps, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda v, g: F.struct(measure(g).alias("gap"), measure(v).alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), bound(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,line:int,column:int,utf16_column:int>>"))


def strip_urls(text: Column) -> Column:
    """Every http(s) address, up to a blank or a closing mark, becomes one middle dot."""
    return F.regexp_replace(text, r"(?U)https?://[^\s」）)、。]*", "・")


def sentences(text: Column) -> Column:
    """Sentences with their delimiter and without blanks before them; empty ones are left out."""
    cut = F.regexp_extract_all(text, F.lit("[^.!?。！？]*[.!?。！？]|[^.!?。！？]+"), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"(?U)^\s+", "")), lambda s: s != "")
