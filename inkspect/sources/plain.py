"""Slices: what is linted on its own.  A slice row is

(doc_id, slice_id, column_index, column_name, parse_mode, start, text, nodes)

with ``nodes`` as array<struct<node_id,kind,start,end,parent,first_child,next_sibling>>,
offsets in bytes of the slice; ``start`` is the slice's place in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pieces

#: Node kinds in order.
KINDS = (
    "root paragraph heading thematicBreak blockquote list listItem code html definition footnoteDefinition table tableRow tableCell yaml toml math text emphasis strong "
    "delete inlineCode inlineMath break link linkReference image imageReference footnoteReference mdxFlowExpression mdxTextExpression mdxJsxFlowElement mdxJsxTextElement mdxjsEsm"
).split()
KIND = {name: i for i, name in enumerate(KINDS)}
BLOCK_KINDS = [KIND["paragraph"], KIND["heading"], KIND["tableCell"]]
NODE = "struct<node_id:int,kind:int,start:int,end:int,parent:int,first_child:int,next_sibling:int>"


def plain_nodes(text: Column) -> Column:
    """Root, paragraph and text, each over the whole slice."""
    spine = [(0, KIND["root"], None, 1), (1, KIND["paragraph"], 0, 2), (2, KIND["text"], 1, None)]
    return F.array(*(F.struct(F.lit(i).alias("node_id"), F.lit(k).alias("kind"), F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit(p).cast("int").alias("parent"), F.lit(c).cast("int").alias("first_child"), F.lit(None).cast("int").alias("next_sibling")) for i, k, p, c in spine)).cast(f"array<{NODE}>")


def plain_slices(docs: DataFrame) -> DataFrame:
    """One slice a document.  Null text is empty; other columns are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.lit(0).cast("long").alias("slice_id"), F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("string").alias("column_name"), F.lit("plain").alias("parse_mode"), F.lit(0).alias("start"), text.alias("text"), plain_nodes(text).alias("nodes"))


def line_slices(docs: DataFrame) -> DataFrame:
    """One slice a line, without its line feed; what follows the last one is a line too.  Null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.substring_index(text, "\n", -1)
    tail = F.struct((F.octet_length(text) - F.octet_length(last)).alias("start"), last.alias("text"))
    before = F.transform(pieces(text, "\n"), lambda p: F.struct((p["start"] - F.octet_length(p["gap"])).alias("start"), p["gap"].alias("text")))
    rows = docs.select("doc_id", F.posexplode(F.concat(before, F.array(tail))).alias("n", "line"))
    return rows.select("doc_id", F.col("n").cast("long").alias("slice_id"), F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("string").alias("column_name"), F.lit("plain").alias("parse_mode"), "line.start", "line.text", plain_nodes(F.col("line.text")).alias("nodes"))
