"""Near-copies by SimHash and the exact Jaccard similarity of word shingles.

SimHash comes first: fingerprints that differ in three bits or fewer meet by their
deletion variants, and the texts of each component of them are confirmed against its
least one.  Where such links join all sets of a leader (below), these are not compared
again.  Most pairs of 4/5 lie further apart than SimHash reaches, so an exact way for
the rest follows, and no pair is lost.

It is the pigeonhole of SimHash's segments, on sets of shingles instead of 64 bits.  Two
sets of a and b shingles with a similarity of 4/5 or more differ in (a + b) / 9
shingles at most.  So the shingles' hashes, in order, are cut into segments by equal
ranges of hash values, more of them than shingles can differ: a set's segments that
hold anything are indexed, each by a hash of all it holds, and similar sets have
several segments in common.  How many ranges there are goes by levels of set size,
each 1.6 times the one before; a set at the lower end of its level is also cut as in
the level below.  A set with too few filled segments to be sure of two common ones is
cut again into twice as many.

A segment holds a few shingles, so texts that merely share a passage meet in few
segments, and a set that shares fewer of its segments than any similar pair must is
left out.  Of the sets that stay, the shingles are counted that no other one holds:
such are differences from every set.  With u of them among n, two sets can be similar
only if the sum of their 9 u - n is not over 0, and in a crowd of copies with edits
of their own that is nearly as sharp as the similarity itself.

Pairs are not made within groups.  All sets of a segment are first compared with the
one of the least 9 u - n alone, its leader, and those that even this one is too far
from are out; those found similar are one component.  A leader's text travels once for
each few hundred sets that it is compared with.  What a set and its leader do not share
is kept.  It is enough for all that is left: two sets differ where these differences
differ.  And a set that is not similar to its leader can be similar to another one of
that leader's sets only if their differences from it have shingles in common, the more
the larger they are.  So differences are put in order, the rarest first, and sets of
different components meet by equality on the first few of them (as many as a similar
pair can't do without), and are settled by their differences, without texts.  What
all sets have and the leader lacks comes last in that order, and meets nobody.
Texts with the same shingles are one node.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mix
from .common import discard, forget, free_name, ids_and_text, materialise, plain_text, slices
from .components import components
from .simhash import hashed, links, majority

#: Least set size of each level, and how many shingles a pair that meets there can differ in.
LEVELS = np.array(list(accumulate(range(58), lambda least, _: -(-8 * least // 5), initial=1)))
DIFFER = [(a + 5 * a // 4) // 9 for a in (LEVELS[1:] - 1).tolist()]
TAG_BITS = 10  # a node's cuts: 16 a level
BITS = 3  # fingerprints that differ in so many meet
TURNS = 4  # shares that the keys of segments are dealt in
KEYS = [f"keys{i}" for i in range(TURNS)]
TOGETHER = 512  # sets that are compared with a leader for each time that its text travels


class Likeness(NamedTuple):
    """A Jaccard similarity of p / q or more, in whole numbers."""

    p: int
    q: int

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Of sets in order; two empty sets are alike."""
        return (self.p + self.q) * len(np.intersect1d(a, b, assume_unique=True)) >= self.p * (len(a) + len(b))

    def score(self, differ: str, n: str) -> str:
        """SQL of what sums to at most 0 over two sets of n shingles that differ in so many, if they are similar."""
        return f"{self.p + self.q}L * {differ} - {self.q - self.p}L * {n}"


FOUR_FIFTHS = Likeness(4, 5)
similar = FOUR_FIFTHS.similar


def hashes(text: str, size: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a text shorter than a shingle is one, one without words has none."""
    return _distinct(list(hashed(text, size)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def segments(h: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(tag, least number in common with a similar set that has the tag, hashes of filled segments) of each cut of a set."""
    n, out = len(h), []
    if n < 4:  # similar sets of this size are equal
        return out
    level = int(np.searchsorted(LEVELS, n, "right")) - 1
    high, mixed = h >> np.uint64(32), mix(h)
    below = int(LEVELS[level]) - 1
    for own, largest in [(level, 5 * n // 4), *([(level - 1, below)] if 4 * n <= 5 * below else [])]:
        differ = (n + largest) // 9
        for turn in range(16):
            ranges = (5 * DIFFER[own] // 4 + 4) << turn
            of = (high * np.uint64(ranges)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            tag = own * 16 + turn
            key = mix(np.add.reduceat(mixed, first) + mix(of[first] + np.uint64(tag << 48))) >> np.uint64(16)  # 48 bits take less room
            out.append((tag, max(1, len(first) - differ), key))
            if len(first) >= differ + 2:
                break
    return out


def _segmented(sets: list[np.ndarray]) -> list[list[tuple[int, int, np.ndarray]]]:
    return [segments(h) for h in sets]


def _sets(docs: DataFrame, size: int, cut, prints: bool) -> DataFrame:
    """(uid, doc_id, mark, digest, n, fp, needs, keys0, keys1, ...) for every row; ``mark`` is a hash of the text, ``cut`` gives the cuts of some sets, as ``segments`` does of one.

    ``fp`` is the SimHash fingerprint, if it is asked for, ``needs`` has a cut's tag and least number in common, keys0 and so on a share of its keys each.
    """

    def run(batches):
        forget()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                shingles = [list(hashed(text, size)) for text in part.column(1).to_pylist()]
                sets, fps = [_distinct(x) for x in shingles], [majority(x) if prints else 0 for x in shingles]
                digests, counts, cuts = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [len(h) for h in sets], cut(sets)
                flat, ends = [x for own in cuts for x in own], _ends([len(x) for x in cuts])
                tags = pa.array([x[0] for x in flat], pa.int32())
                needs = pa.StructArray.from_arrays([tags, pa.array([x[1] for x in flat], pa.int32())], ["tag", "need"])
                columns = [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(ends, needs)]
                for i in range(TURNS):
                    own = [x[2][x[2] % np.uint64(TURNS) == i].view(np.int64) for x in flat]
                    keys = pa.ListArray.from_arrays(_ends([len(x) for x in own]), pa.array(np.concatenate([np.empty(0, np.int64), *own])))
                    columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([tags, keys], ["tag", "keys"])))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "digest", "n", "fp", "needs", *KEYS])

    rows = ids_and_text(docs).withColumn("mark", F.xxhash64("text"))
    shares = ", ".join(f"{name} array<struct<tag:int,keys:array<long>>>" for name in KEYS)
    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, digest binary, n int, fp long, needs array<struct<tag:int,need:int>>, {shares}")
    # 28 bits for the row and the rest for the part, so that a tag still fits into a long beside it
    part, row = F.shiftright("uid", 33), F.col("uid").bitwiseAND((1 << 33) - 1)
    return out.withColumn("uid", F.monotonically_increasing_id()).withColumn("uid", F.shiftleft(part, 28) + row)


def _ends(sizes: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]), pa.int32())


def _met(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, owner, need): segments that several nodes hold, of nodes that share as many as a similar pair must; an owner is a node's cut.

    Keys are dealt a share at a time, so that never all of them lie in shuffle files at once.
    """
    of_nodes = lambda column: firsts.select("node").join(sets.select("uid", column).hint("merge"), F.col("uid") == F.col("node")).select("node", F.inline(column))
    owner = (F.shiftleft("node", TAG_BITS) + F.col("tag")).alias("owner")
    held = F.count(F.lit(1)).over(Window.partitionBy("key"))
    several = []
    for name in KEYS:
        entries = of_nodes(name).select(owner, F.explode("keys").alias("key"))
        several.append(materialise(entries.withColumn("held", held).where("held > 1").select("key", "owner"), "segments-held"))
    every = reduce(DataFrame.unionByName, several)
    needs = of_nodes("needs").select(owner, "need")
    enough = every.groupBy("owner").agg(F.count(F.lit(1)).alias("shared")).join(needs, "owner").where("shared >= need").select("owner", "need")
    met = materialise(every.join(enough, "owner").select("key", "owner", "need", F.shiftright("owner", TAG_BITS).alias("node")), "segments-met")
    discard(*several)
    return met


def _printed(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints are linked, each with the least node of its component of fingerprints."""
    prints, tables = materialise(nodes.select("fp").distinct(), "near-prints"), []
    roots = components(links(prints, BITS, tables=tables)).withColumnRenamed("node", "print")
    placed = materialise(nodes.select("node", "fp").join(roots.hint("merge"), F.col("fp") == F.col("print"), "left").select("node", F.coalesce("root", "fp").alias("root")), "near-printed")
    discard(prints, *tables)
    least = placed.groupBy("root").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last").select("root", "u")
    pairs = materialise(placed.join(least.hint("merge"), "root").where("node <> u").select("u", F.col("node").alias("v")), "near-print-pairs")
    discard(placed)
    return pairs


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, text) of the nodes of ``wanted``, read again by id and text hash."""
    source = nodes.join(wanted.select("node").distinct(), "node").select("node", "n", F.col("doc_id").alias("id"), F.col("mark").alias("source"))
    rows = ids_and_text(docs).withColumn("mark", F.xxhash64("text"))
    found = rows.join(source, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("source"))).select("node", "n", "text")
    return materialise(found.dropDuplicates(["node"]), "near-texts")


def _scores(texts: DataFrame, size: int, like: Likeness) -> DataFrame:
    """(node, n, score): the score of a set by the shingles that no other set has."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = [hashes(text, size).view(np.int64) for text in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(), [len(h) for h in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], ["h", "node"])

    held = texts.select("node", "text").mapInArrow(run, "h long, node long").groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("of"))
    alone = held.where("held = 1").groupBy("of").agg(F.count(F.lit(1)).alias("alone"))
    rows = texts.select("node", "n").join(alone, F.col("node") == F.col("of"), "left")
    return materialise(rows.select("node", "n", F.expr(like.score("coalesce(alone, 0)", "n")).alias("score")), "near-scores")


def _groups(met: DataFrame, scores: DataFrame) -> DataFrame:
    """(u, v): every node with the leaders of its segments, as far as scores allow it a partner there.

    A similar pair has ``need`` of these segments in common, so it meets although each set
    leaves out its last ``need - 1`` in one order of all segments.  That order goes by leaders,
    so that what is left out are whole leaders that a set shares little with.
    """
    rows = met.join(scores, "node").select("key", "owner", "need", F.struct("score", "node").alias("own"))
    leaders = rows.groupBy("key").agg(F.min("own").alias("u"), F.max("own").alias("last")).where("u.node <> last.node").select("key", "u")
    fit = rows.join(leaders, "key").where("own.score + u.score <= 0")
    of = Window.partitionBy("owner")
    first = fit.withColumn("last", F.count(F.lit(1)).over(of) - F.col("need") + 1).withColumn("rank", F.row_number().over(of.orderBy("u", "key")))
    return first.where("rank <= last AND own.node <> u.node").select("u.node", F.col("own.node").alias("v")).toDF("u", "v").distinct()


def _compared(texts: DataFrame, pairs: DataFrame, size: int, like: Likeness) -> DataFrame:
    """(u, v, n, similar, diff) of ``pairs``: size of the second set, and the shingles that one of the two has alone."""

    def run(batches):
        leader, h = None, None
        for batch in batches:
            for i, j in slices(batch.column(3)):
                part, pairs, kept, diffs = batch.slice(i, j - i), [], [], []
                for u, leads, node, text in zip(*(part.column(c).to_pylist() for c in range(3)), part.column(3)):
                    own = hashes(text.as_py(), size)
                    if leads:
                        leader, h = u, own
                        continue
                    if u != leader:
                        raise RuntimeError(f"the text of leader {u} is not there")
                    pairs.append((u, node, len(own)))
                    kept.append(like.similar(h, own))
                    diffs.append(np.setxor1d(h, own, assume_unique=True).view(np.int64))
                diff = pa.ListArray.from_arrays(_ends([len(x) for x in diffs]), pa.array(np.concatenate([np.empty(0, np.int64), *diffs])))
                us, vs, ns = ([x[c] for x in pairs] for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int32()), pa.array(kept, pa.bool_()), diff], ["u", "v", "n", "similar", "diff"])

    parts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).alias("salt"), F.lit(False).alias("leads"), F.col("v").alias("node"))
    leaders = dealt.select("u", "salt", F.lit(True).alias("leads"), F.col("u").alias("node")).distinct()
    rows = dealt.unionByName(leaders).join(texts.select("node", "text"), "node")
    ordered = rows.repartition("u", "salt").sortWithinPartitions("u", "salt", F.desc("leads"))
    return ordered.select("u", "leads", "node", "text").mapInArrow(run, "u long, v long, n int, similar boolean, diff array<long>")


def _rooted(df: DataFrame, node: str, roots: DataFrame, name: str) -> DataFrame:
    """``df`` with the root of a node of it, which is the node itself where it has no link."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The (u, v) of ``groups`` whose leader has a set of another component; within one component no link is to be found."""
    of = _rooted(_rooted(groups, "u", roots, "top"), "v", roots, "root")
    return groups.join(of.where("root <> top").select("u").distinct(), "u", "left_semi")


def _rest(compared: DataFrame, roots: DataFrame, like: Likeness) -> tuple[DataFrame, list[DataFrame]]:
    """((u, v): links of different components among the sets of one leader, and the tables it reads)."""
    rows = _rooted(_rooted(compared, "u", roots, "top"), "v", roots, "root").withColumn("outside", F.expr("root <> top"))
    members = rows.join(rows.where("outside").select("u").distinct(), "u", "left_semi").withColumn("d", F.size("diff"))
    members = materialise(members.select("u", "v", "n", "root", "outside", "d", "diff", F.expr(like.score("d", "n")).alias("s")), "near-members")
    # a pair has (s + s') / 2 (p + q) of them in common or more; with c of d it must meet in the first d - c + 1
    common = lambda a, b: f"ceil(({a} + {b}) / {2 * (like.p + like.q)})"
    partner = f"greatest(if(outside, least_s, least_o), -{(like.q - like.p) * like.q}L * n / {like.p})"  # a partner isn't too large either
    able = members.drop("diff")
    for _ in range(2):  # those that have no partner are none, which leaves less to others
        least = able.groupBy("u").agg(F.min("s").alias("least_s"), F.min(F.when(F.col("outside"), F.col("s"))).alias("least_o")).where("least_o IS NOT NULL")
        able = able.drop("most").join(least, "u").withColumn("most", F.expr(f"cast(d - {common('s', partner)} as int)")).where("most >= 0").drop("least_s", "least_o")
    able = materialise(able, "near-able")
    # differences in the order of how many sets of the leader have them; first those that only sets of one component have, as no partner does
    rows = able.join(members.select("u", "v", "diff"), ["u", "v"])
    held = rows.select("u", "root", F.explode("diff").alias("e")).groupBy("u", "e").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    sizes = able.groupBy("u").agg(F.count(F.lit(1)).alias("sets"))
    held = materialise(held.join(sizes, "u").select("u", "e", "held", F.expr("2 * held > sets").alias("usual")), "near-held")
    # those that over half of the sets have come last and are few, so they travel as one list, and only the others are looked up
    usual = held.where("usual").groupBy("u").agg(F.expr("transform(sort_array(collect_list(struct(held, e))), x -> x.e)").alias("usual"))
    parted = rows.join(usual, "u", "left").withColumn("rare", F.coalesce(F.array_except("diff", "usual"), "diff")).withColumn("first", F.size("rare"))
    of = Window.partitionBy("u", "v")
    shared = parted.select(*able.columns, "first", F.explode("rare").alias("e")).join(held.where("NOT usual").select("u", "e", "held"), ["u", "e"])
    shared = shared.withColumn("alone", F.col("first") - F.count(F.lit(1)).over(of)).withColumn("rank", F.row_number().over(of.orderBy("held", "e")) - 1 + F.col("alone"))
    shared = shared.where(f"{like.p}L * alone <= {like.q - like.p}L * n AND rank <= most")
    last = F.slice(F.array_intersect("usual", "diff"), 1, F.col("most") - F.col("first") + 1)
    last = parted.where("first <= most").select(*able.columns, "first", F.posexplode(last).alias("rank", "e")).withColumn("rank", F.col("rank") + F.col("first"))
    columns = [c for c in able.columns if c != "most"] + ["e", "rank"]
    entries = materialise(shared.select(*columns).unionByName(last.select(*columns)), "near-entries")
    one = entries.where("outside").select("u", "e", *(F.col(c).alias(f"{c}_o") for c in ("v", "n", "root", "rank", "d", "s")))
    fit = f"root <> root_o AND (NOT outside OR v < v_o) AND rank <= d - {common('s', 's_o')} AND rank_o <= d_o - {common('s', 's_o')}"
    fit += f" AND {like.q}L * n >= {like.p}L * n_o AND {like.q}L * n_o >= {like.p}L * n"
    met = entries.join(one, ["u", "e"]).where(fit).groupBy("v_o", "v").agg(F.min("u").alias("u"))
    side = lambda a, b: members.select("u", F.col("v").alias(a), F.col("n").alias(f"n_{b}"), F.col("diff").alias(f"diff_{b}"))
    both = met.join(side("v", "v"), ["u", "v"]).join(side("v_o", "o"), ["u", "v_o"])
    differ = "(size(diff_v) + size(diff_o) - 2 * size(array_intersect(diff_v, diff_o)))"
    found = both.where(f"{like.score(differ, '(n_v + n_o)')} <= 0").select(F.col("v_o").alias("u"), "v")
    return found, [members, able, held, entries]


def _linked(docs: DataFrame, nodes: DataFrame, met: DataFrame, size: int, like: Likeness, prints: bool) -> DataFrame:
    """(node, root) of all nodes with a link: with ``prints`` first what SimHash finds, then what it can't reach."""
    printed = _printed(nodes) if prints else None
    wanted = met.select("node")
    texts = _texts(docs, nodes, wanted.unionByName(printed.select(F.explode(F.array("u", "v")).alias("node"))) if prints else wanted)
    scores = _scores(texts, size, like)
    groups, first = _groups(met, scores), []
    if prints:
        first = [materialise(_compared(texts, printed, size, like).where("similar").select("u", "v"), "near-printed-links")]
        discard(printed)
        groups = materialise(groups, "near-groups")
    compared = materialise(_compared(texts, _open(groups, components(first[0])) if prints else groups, size, like), "near-compared")
    discard(met, scores, texts)
    found = reduce(DataFrame.unionByName, [*first, compared.where("similar").select("u", "v")])
    more, tables = _rest(compared, components(found), like)
    rest = materialise(more, "near-links")
    discard(*tables)
    return components(found.unionByName(rest))


def near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, component_id, mark, root) for every row of ``docs``: the smallest doc_id reachable over links of 0.8 or more.

    Null text is empty; texts without words are copies of each other.  Null ids take
    part but never name a component unless it has no other id.  Repeated rows are
    repeated.  An empty table gives no row.  ``mark`` is a hash of the text, ``root``
    a number of the component.
    """
    return _named(docs, size)[0].drop("n")


def _named(docs: DataFrame, size: int, cut=_segmented, like: Likeness = FOUR_FIFTHS, prints: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """The result of near_copies with the size n of each set, and the tables it reads."""
    cuts = materialise(_sets(docs, size, cut, prints), "shingle-cuts")
    sets = materialise(cuts.drop("needs", *KEYS), "shingle-sets")
    firsts = materialise(sets.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("uid").alias("node")), "shingle-nodes")
    met = _met(cuts, firsts)
    discard(cuts)
    nodes = firsts.select("node").join(sets, F.col("uid") == F.col("node")).drop("uid")
    roots = _linked(docs, nodes, met, size, like, prints).withColumnRenamed("node", "linked")
    placed = materialise(firsts.join(roots, F.col("node") == F.col("linked"), "left").select("digest", "first", F.coalesce("root", "node").alias("root")), "near-roots")
    discard(firsts)
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return sets.select("doc_id", "mark", "n", "digest").join(placed.join(names, "root"), "digest").select("doc_id", "component_id", "mark", "root", "n"), [sets, placed]


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """A row of ``docs``, unchanged, of each component: that whose id names it.

    Of several rows of the component with that id the one with the least text hash
    stays, of rows that repeat id and text any one.
    """
    every, tables = _named(docs, size)
    named = every.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    each = named.groupBy("root", F.col("doc_id").alias("first"), "mark").agg(F.count(F.lit(1)).alias("rows"))
    best = materialise(each.groupBy("root", "first").agg(F.min(F.struct("mark", "rows")).alias("best")).select("first", "best.*"), "near-kept")
    discard(*tables)

    first, least = free_name(docs, "first"), free_name(docs, "least")

    def rows(chosen: DataFrame) -> DataFrame:
        own = chosen.select(F.col("first").alias(first), F.col("mark").alias(least))
        return docs.join(own, F.col("doc_id").eqNullSafe(F.col(first)) & (F.xxhash64(plain_text()) == F.col(least)), "left_semi")

    repeated = best.where("rows > 1")
    if repeated.isEmpty():
        return rows(best)
    marked = rows(repeated).withColumn(least, F.xxhash64(plain_text()))
    return rows(best.where("rows = 1")).unionByName(marked.dropDuplicates(["doc_id", least]).drop(least))
