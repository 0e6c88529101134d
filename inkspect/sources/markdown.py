"""Markdown to nodes with byte spans: CommonMark blocks and inlines, tables, strikethrough, footnotes, front matter.

Blocks are read line by line, containers by recursion; inlines by a scan with a
stack of delimiters.  Offsets are kept in characters and turned to bytes once.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.terms import row_slices
from .plain import KIND, NODE

DEEPEST = 1000
FRAMES = 20 * DEEPEST  # of Python's stack, for texts that nest that deep
OPENERS = re.compile(r"^([ \t]*)((?:[ \t]*(?:>|[-+*][ \t]|[0-9]+[.)][ \t]))*)", re.M)
OPENER = re.compile(r">|[-+*][ \t]|[0-9]+[.)][ \t]")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
RULE = re.compile(r" {0,3}([-_*])(?:[ \t]*\1){2,}[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
QUOTE = re.compile(r" {0,3}>")
ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(?=[ \t]|$)")
DEFINITION = re.compile(r" {0,3}\[(?!\^)(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:")
HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|!\[CDATA\[|/?(?:address|article|aside|base|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$))", re.I)
ROW = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
TAG = re.compile(r"<(?:/?[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
BARE = re.compile(r"(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~'\")]")
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)


def nesting(text: str) -> int:
    """At most how deep containers nest: markers at the head of a line, and a level for two columns of indentation (a tab is four)."""
    most = 0
    for m in OPENERS.finditer(text):
        if 2 * len(m[0]) > most:
            most = max(most, len(m[1].replace("\t", "    ")) // 2 + len(OPENER.findall(m[2])))
    return most


class TooDeep(ValueError):
    pass


class Node:
    __slots__ = ("children", "end", "kind", "start")

    def __init__(self, kind: str, start: int, end: int, children: list[Node] | None = None):
        self.kind, self.start, self.end, self.children = kind, start, end, children or []


def _indent(s: str) -> int:
    n = 0
    for c in s:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


class Blocks:
    def __init__(self, text: str):
        self.text = text
        self.labels = {self._label(m[1]) for m in re.finditer(r"^[ >]{0,9}\[((?:[^\[\]\\]|\\.)+)\]:", text, re.M)}

    @staticmethod
    def _label(s: str) -> str:
        return " ".join(s.split()).lower()

    def parse(self) -> Node:
        lines, at = [], 0
        for m in re.finditer(r"\r\n|\r|\n", self.text):
            lines.append((at, m.start()))
            at = m.end()
        if at < len(self.text):
            lines.append((at, len(self.text)))
        front = []
        if lines and (mark := self.text[slice(*lines[0])].rstrip()) in ("---", "+++"):
            for i, (a, b) in enumerate(lines[1:], 1):
                if self.text[a:b].rstrip() == mark:
                    front, lines = [Node("yaml" if mark == "---" else "toml", lines[0][0], b)], lines[i + 1 :]
                    break
        return Node("root", 0, len(self.text), front + self.blocks(lines))

    def blocks(self, lines: list[tuple[int, int]]) -> list[Node]:
        out, i, t = [], 0, self.text
        while i < len(lines):
            a, b = lines[i]
            s = t[a:b]
            lead = a + len(s) - len(s.lstrip(" \t"))
            if not s.strip():
                i += 1
            elif _indent(s) >= 4:
                j, last = i, i
                while j < len(lines) and (not t[slice(*lines[j])].strip() or _indent(t[slice(*lines[j])]) >= 4):
                    last, j = (j if t[slice(*lines[j])].strip() else last), j + 1
                out.append(Node("code", a, lines[last][1]))
                i = last + 1
            elif m := FENCE.match(s):
                close, j = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$"), i + 1
                while j < len(lines) and not close.match(t[slice(*lines[j])]):
                    j += 1
                out.append(Node("code", lead, lines[min(j, len(lines) - 1)][1]))
                i = j + 1
            elif m := HEADING.match(s):
                body = a + m.end()
                stop = a + len(re.sub(r"(?:^|[ \t])#+[ \t]*$", "", s.rstrip())) if len(s.rstrip()) > m.end() else body
                out.append(Node("heading", lead, a + len(s.rstrip()), self.inlines(body, max(body, stop))))
                i += 1
            elif RULE.match(s):
                out.append(Node("thematicBreak", lead, a + len(s.rstrip())))
                i += 1
            elif QUOTE.match(s):
                i = self._quote(lines, i, out)
            elif m := ITEM.match(s):
                i = self._list(lines, i, out)
            elif m := FOOTNOTE.match(s):
                j, inner = i + 1, [(a + m.end(), b)]
                while j < len(lines) and (not t[slice(*lines[j])].strip() or _indent(t[slice(*lines[j])]) >= 4):
                    inner.append((min(lines[j][0] + 4, lines[j][1]), lines[j][1]))
                    j += 1
                while len(inner) > 1 and not t[slice(*inner[-1])].strip():
                    inner.pop()
                out.append(Node("footnoteDefinition", lead, inner[-1][1], self.blocks(inner)))
                i = j
            elif DEFINITION.match(s):
                out.append(Node("definition", lead, a + len(s.rstrip())))
                i += 1
            elif HTML.match(s):
                j = i
                while j + 1 < len(lines) and t[slice(*lines[j + 1])].strip():
                    j += 1
                out.append(Node("html", lead, lines[j][1]))
                i = j + 1
            elif "|" in s and i + 1 < len(lines) and ROW.match(t[slice(*lines[i + 1])]) and "-" in t[slice(*lines[i + 1])] and len(self._cells(a, b)) == len(self._cells(*lines[i + 1])):
                i = self._table(lines, i, out)
            else:
                i = self._paragraph(lines, i, out, lead)
        return out

    def _interrupts(self, s: str) -> bool:
        m = ITEM.match(s)
        return bool(not s.strip() or FENCE.match(s) or HEADING.match(s) or RULE.match(s) or QUOTE.match(s) or HTML.match(s) or (m and s[m.end() :].strip() and (len(m[2]) == 1 or m[2][:-1] == "1")))

    def _paragraph(self, lines, i, out, lead) -> int:
        t, j = self.text, i + 1
        while j < len(lines):
            s = t[slice(*lines[j])]
            if SETEXT.match(s):
                out.append(Node("heading", lead, lines[j][0] + len(s.rstrip()), self.inlines(lead, self._trimmed(lines[j - 1]))))
                return j + 1
            if self._interrupts(s):
                break
            j += 1
        end = self._trimmed(lines[j - 1])
        out.append(Node("paragraph", lead, end, self.inlines(lead, end)))
        return j

    def _trimmed(self, line: tuple[int, int]) -> int:
        return line[0] + len(self.text[slice(*line)].rstrip(" \t"))

    def _quote(self, lines, i, out) -> int:
        t, inner, j, lazy = self.text, [], i, False
        start = lines[i][0] + _leading(t[slice(*lines[i])])
        while j < len(lines):
            a, b = lines[j]
            m = QUOTE.match(t[a:b])
            if m:
                c = a + m.end()
                inner.append((c + (t[c : c + 1] == " " and c < b), b))
                lazy = bool(t[c:b].strip()) and not FENCE.match(t[c:b].lstrip()) and not HEADING.match(t[c:b].lstrip(" "))
            elif lazy and not self._interrupts(t[a:b]):
                inner.append((a, b))
            else:
                break
            j += 1
        out.append(Node("blockquote", start, inner[-1][1], self.blocks(inner)))
        return j

    def _list(self, lines, i, out) -> int:
        t, items = self.text, []
        kind = ITEM.match(t[slice(*lines[i])])[2][-1]
        start = lines[i][0] + _leading(t[slice(*lines[i])])
        while i < len(lines):
            a, b = lines[i]
            m = ITEM.match(t[a:b])
            if not m or m[2][-1] != kind or RULE.match(t[a:b]):
                break
            after = t[a + m.end() : b]
            pad = _leading(after)
            width = m.end() + (pad if 1 <= pad <= 4 and after.strip() else 1)
            inner, j, blank = [(min(a + width, b), b)], i + 1, False
            while j < len(lines):
                c, d = lines[j]
                s = t[c:d]
                if not s.strip():
                    inner.append((d, d))
                    blank = True
                elif _indent(s) >= width:
                    inner.append((c + min(width, _leading(s)), d))
                    blank = False
                elif not blank and not self._interrupts(s) and not ITEM.match(s):
                    inner.append((c + _leading(s), d))
                else:
                    break
                j += 1
            while len(inner) > 1 and inner[-1][0] == inner[-1][1]:
                inner.pop()
            items.append(Node("listItem", a + _leading(t[a:b]), inner[-1][1], self.blocks(inner)))
            i = j
        out.append(Node("list", start, items[-1].end, items))
        return i

    def _cells(self, a: int, b: int) -> list[tuple[int, int]]:
        s = self.text[a:b].rstrip()
        cuts = [m.start() for m in re.finditer(r"\\.|\|", s) if m[0] == "|"]
        edges = [-1, *cuts, len(s)]
        found = [(a + x + 1, a + y) for x, y in zip(edges, edges[1:])]
        if cuts and not s[: cuts[0]].strip():
            found = found[1:]
        if cuts and cuts[-1] == len(s) - 1:
            found = found[:-1]
        return found

    def _table(self, lines, i, out) -> int:
        t, rows, j = self.text, [], i
        width = len(self._cells(*lines[i]))
        while j < len(lines) and (j < i + 2 or not self._interrupts(t[slice(*lines[j])])):
            if j != i + 1:
                a, b = lines[j]
                own = []
                for x, y in self._cells(a, b)[:width]:
                    x, y = x + _leading(t[x:y]), x + len(t[x:y].rstrip())
                    own.append(Node("tableCell", min(x, y) if x > y else x, max(x, y), self.inlines(x, y) if y > x else []))
                rows.append(Node("tableRow", a + _leading(t[a:b]), self._trimmed(lines[j]), own))
            j += 1
        out.append(Node("table", rows[0].start, max(self._trimmed(lines[j - 1]), rows[-1].end), rows))
        return j

    def inlines(self, a: int, b: int) -> list[Node]:
        a += _leading(self.text[a:b])
        b = a + len(self.text[a:b].rstrip()) if b > a else a
        return Inlines(self, a, b).nodes() if b > a else []


def _leading(s: str) -> int:
    return len(s) - len(s.lstrip(" \t"))


class Inlines:
    def __init__(self, blocks: Blocks, a: int, b: int):
        self.blocks, self.text, self.a, self.b = blocks, blocks.text, a, b

    def nodes(self) -> list[Node]:
        t, i, b = self.text, self.a, self.b
        self.out: list[Node] = []  # nodes, and delimiter runs as nodes of kind "run"
        brackets: list[int] = []  # places of open brackets in out
        while i < b:
            c = t[i]
            if c == "\\" and i + 1 < b:
                if t[i + 1] == "\n":
                    self.out.append(Node("break", i, i + 2))
                else:
                    self._text(i, i + 2)
                i += 2
            elif c == "`":
                n = len(re.match("`+", t[i:b])[0])
                m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(t, i + n, b)
                if m:
                    self.out.append(Node("inlineCode", i, m.end()))
                    i = m.end()
                else:
                    self._text(i, i + n)
                    i += n
            elif c == "<" and (m := AUTOLINK.match(t, i, b)):
                self.out.append(Node("link", i, m.end(), [Node("text", i + 1, m.end() - 1)]))
                i = m.end()
            elif c == "<" and (m := TAG.match(t, i, b)):
                self.out.append(Node("html", i, m.end()))
                i = m.end()
            elif c in "hw" and (i == self.a or not t[i - 1].isalnum()) and (m := BARE.match(t, i, b)):
                self.out.append(Node("link", i, m.end(), [Node("text", i, m.end())]))
                i = m.end()
            elif c in "*_~":
                n = len(re.match(re.escape(c) + "+", t[i:b])[0])
                if c == "~" and n > 2:
                    self._text(i, i + n)
                else:
                    self.out.append(Node("run", i, i + n))
                i += n
            elif c == "[" or (c == "!" and t[i + 1 : i + 2] == "[" and i + 1 < b):
                m = re.compile(r"\[\^[^\]\s]+\]").match(t, i, b)
                if m:
                    self.out.append(Node("footnoteReference", i, m.end()))
                    i = m.end()
                    continue
                brackets.append(len(self.out))
                self.out.append(Node("open", i, i + 1 + (c == "!")))
                i += 1 + (c == "!")
            elif c == "]":
                i = self._close(brackets, i)
            elif c == " " and (m := re.compile(r" {2,}\n").match(t, i, b)):
                self.out.append(Node("break", i, m.end()))
                i = m.end()
            else:
                m = re.compile(r"[^\\`<hw*_~\[!\] ]+").match(t, i, b)
                end = m.end() if m else i + 1
                self._text(i, end)
                i = end
        return self._emphasis(self.out)

    def _text(self, a: int, b: int) -> None:
        if self.out and self.out[-1].kind == "text" and self.out[-1].end == a:
            self.out[-1].end = b
        else:
            self.out.append(Node("text", a, b))

    def _close(self, brackets: list[int], i: int) -> int:
        t = self.text
        if brackets:
            at = brackets.pop()
            opener = self.out[at]
            image = t[opener.start] == "!"
            label = Blocks._label(t[opener.end : i])
            m = TARGET.match(t, i + 1, self.b)
            r = None if m else re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(t, i + 1, self.b)
            end, kind = (m.end(), "image" if image else "link") if m else (0, "")
            if r and Blocks._label(r[1] or t[opener.end : i]) in self.blocks.labels:
                end, kind = r.end(), "imageReference" if image else "linkReference"
            elif not m and label in self.blocks.labels:
                end, kind = i + 1, "imageReference" if image else "linkReference"
            if end:
                children = [] if image else self._emphasis(self.out[at + 1 :])
                del self.out[at:]
                self.out.append(Node(kind, opener.start, end, children))
                if not image:  # links hold no links
                    for k in brackets:
                        if t[self.out[k].start] != "!":
                            self.out[k].kind = "text"
                    brackets[:] = [k for k in brackets if self.out[k].kind == "open"]
                return end
        self._text(i, i + 1)
        return i + 1

    def _sides(self, run: Node) -> tuple[bool, bool]:
        """Whether a delimiter run can open and close."""
        t = self.text
        before, after = t[run.start - 1] if run.start > self.a else " ", t[run.end] if run.end < self.b else " "
        punct = lambda c: not c.isalnum() and not c.isspace()
        left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        if t[run.start] == "_":
            return left and (not right or punct(before)), right and (not left or punct(after))
        return left, right

    def _emphasis(self, items: list[Node]) -> list[Node]:
        t, stack = self.text, []
        out: list[Node] = []
        for item in items:
            if item.kind != "run":
                if item.kind == "open":
                    item.kind = "text"
                out.append(item)
                continue
            can_open, can_close = self._sides(item)
            c = t[item.start]
            while can_close and item.start < item.end:
                k = next((k for k in range(len(stack) - 1, -1, -1) if t[stack[k][0].start] == c and self._pairs(stack[k], (item, can_open, can_close))), None)
                if k is None:
                    break
                opener = stack[k][0]
                n = 2 if c != "~" and min(opener.end - opener.start, item.end - item.start) >= 2 else item.end - item.start if c == "~" else 1
                del stack[k + 1 :]
                place = next(i for i, x in enumerate(out) if x is opener)
                inner = [x for x in out[place + 1 :] if x.end > x.start]
                for x in inner:
                    if x.kind == "run":
                        x.kind = "text"
                node = Node("delete" if c == "~" else "strong" if n == 2 else "emphasis", opener.end - n, item.start + n, _merged(inner))
                opener.end -= n
                item.start += n
                del out[place + 1 :]
                out.append(node)
                if opener.end == opener.start:
                    stack.pop(k)
                    out.remove(opener)
            if item.start < item.end:
                out.append(item)
                if can_open:
                    stack.append((item, can_open, can_close))
        for x in out:
            if x.kind == "run":
                x.kind = "text"
        return _merged(out)

    def _pairs(self, opener, closer) -> bool:
        a, b = opener[0].end - opener[0].start, closer[0].end - closer[0].start
        if self.text[closer[0].start] == "~":
            return a == b
        return not ((opener[2] or closer[1]) and (a + b) % 3 == 0 and not (a % 3 == 0 and b % 3 == 0))


def _merged(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for x in nodes:
        if out and x.kind == "text" == out[-1].kind and out[-1].end == x.start:
            out[-1] = Node("text", out[-1].start, x.end)
        else:
            out.append(x)
    return out


def parse(text: str) -> list[tuple]:
    """(node_id, kind, start, end, parent, first_child, next_sibling) in pre-order; offsets in bytes."""
    if nesting(text) > DEEPEST:
        raise TooDeep(f"containers are nested more than {DEEPEST} deep")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    root = Blocks(text).parse()
    if text.isascii():
        byte = lambda i: i
    else:
        wide = [i for i, c in enumerate(text) if c > "\x7f"]
        sums, total = [0], 0
        for i in wide:
            total += len(text[i].encode()) - 1
            sums.append(total)
        byte = lambda i: i + sums[bisect_right(wide, i - 1)]
    rows, last, todo = [], {}, [(root, None)]
    while todo:
        node, parent = todo.pop()
        own = len(rows)
        rows.append([own, KIND[node.kind], byte(node.start), byte(node.end), parent, None, None])
        if parent in last:
            rows[last[parent]][6] = own
        elif parent is not None:
            rows[parent][5] = own
        last[parent] = own
        todo += [(child, own) for child in reversed(node.children)]
    return [tuple(r) for r in rows]


FIELDS = ["node_id", "kind", "start", "end", "parent", "first_child", "next_sibling"]


def spine(text: str) -> list[tuple]:
    """The rows of a plain text: root, paragraph and text over all of it."""
    end = len(text.encode())
    return [(0, KIND["root"], 0, end, None, 1, None), (1, KIND["paragraph"], 0, end, 0, 2, None), (2, KIND["text"], 0, end, 1, None, None)]


def with_nodes(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices with nodes, errors): slices parsed in Arrow batches; a Markdown text nested too deep is an error and is not linted.

    Slices whose parse_mode is plain get the nodes of ``plain_nodes``.
    """
    at, mode = slices.columns.index("text"), slices.columns.index("parse_mode")
    kind = pa.list_(pa.struct([(f, pa.int32()) for f in FIELDS]))

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(at).fill_null("")):
                yield parsed_rows(batch.slice(a, b - a))

    def parsed_rows(batch):
        flat, ends, errors = [array("i") for _ in FIELDS], [0], []
        absent = [bytearray() for _ in FIELDS]
        for text, how in zip(batch.column(at), batch.column(mode).to_pylist()):
            try:
                for row in spine(text.as_py() or "") if how == "plain" else parse(text.as_py() or ""):
                    for values, nulls, value in zip(flat, absent, row):
                        values.append(0 if value is None else value)
                        nulls.append(value is None)
                errors.append(None)
            except (TooDeep, RecursionError) as e:
                errors.append(str(e))
            ends.append(len(flat[0]))
        columns = [pa.array(np.frombuffer(v, np.int32), mask=np.frombuffer(n, bool)) if v else pa.array([], pa.int32()) for v, n in zip(flat, absent)]
        nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind, mask=pa.array([e is not None for e in errors]))
        return pa.RecordBatch.from_arrays([*batch.columns, nodes, pa.array(errors, pa.string())], [*batch.schema.names, "nodes", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema.fields)
    parsed = slices.mapInArrow(run, f"{fields}, nodes array<{NODE}>, error string")
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("doc_id", "slice_id", "error")


def markdown_slices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices, errors): one slice a document; a leading byte-order mark is skipped, and null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.startswith(text, F.lit("\ufeff"))
    body = F.when(marked, F.substring(text, 2, 2**31 - 1)).otherwise(text)
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("slice_id"), F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("string").alias("column_name"), F.lit("markdown").alias("parse_mode"), F.when(marked, 3).otherwise(0).alias("start"), body.alias("text"))
    return with_nodes(rows)
