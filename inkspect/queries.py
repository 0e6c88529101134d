"""Queries over the given tables for every rule and engine operator, with DuckDB SQL for most.

The tables hold no Japanese, so most rules run over a derived text that both
engines make alike from ``documents.text`` by translate and replace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import each_of, located, pieces, sentences, strip_urls
from .operators import surface, terms
from .operators.fixes import apply_fixes
from .plans import cache, render
from .plans.config import Config, Setting, active, from_dict
from .plans.linter import lint, lint_slices, rule_table
from .sources.plain import line_slices, plain_slices
from .sources.tables import documents


class Derived:
    """A text made from documents.text by steps (function, from, to), in Spark and in SQL."""

    def __init__(self, *steps: tuple[str, str, str]):
        self.steps = steps

    def column(self, text: Column) -> Column:
        for kind, a, b in self.steps:
            text = F.translate(text, a, b) if kind == "translate" else F.replace(text, F.lit(a), F.lit(b))
        return text

    def sql(self) -> str:
        out = "coalesce(text, '')"
        for kind, a, b in self.steps:
            out = f"{kind}({out}, {literal(a)}, {literal(b)})"
        return out

    def docs(self, spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
        docs = documents(spark, f"{sf_dir}/documents.parquet", by)
        return docs.select("doc_id", self.column(F.coalesce("text", F.lit(""))).alias("text"))


def literal(s: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def duck_matches(pattern: str, text: Derived, name: str = "m") -> str:
    """CTEs that end in ``name``(doc_id, text, v, s): regex matches and their byte offsets."""
    return f"""{name}_t AS (SELECT doc_id, {text.sql()} AS text FROM documents),
{name}_p AS (SELECT doc_id, text, string_split_regex(text, {literal(pattern)}) AS gaps, regexp_extract_all(text, {literal(pattern)}) AS ms FROM {name}_t),
{name}_u AS (SELECT doc_id, text, unnest(ms) AS v, unnest(gaps[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM {name}_p),
{name} AS (SELECT doc_id, text, v, i, (sum(strlen(g) + strlen(v)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(v))::INT AS s FROM {name}_u)"""


def found(body: str, ctes: str, message: str, s: str = "s", e: str = "(s + strlen(v))::INT", where: str = "true") -> str:
    return f"WITH {ctes}\nSELECT doc_id, {s} AS span_start, {e} AS span_end, {message} AS message FROM {body} WHERE {where}"


PLAIN = Derived()
RULE_TEXT = {
    "sentence-length": PLAIN,
    "max-ten": Derived(("translate", ",. ", "、。、")),
    "max-kanji-continuous-len": Derived(("translate", "abcdefghijklmnopqrstuvwxyz", "亜位宇江尾化木句毛子左士酢背祖田地津手戸名似抜根野波")),
    "no-hankaku-kana": Derived(("translate", "aeiou", "ｱｴｲｵｳ")),
    "no-mixed-zenkaku-hankaku-alphabet": Derived(("translate", "tnhd", "ｔｎｈｄ"), ("translate", "abcfgijklmopqrs", "亜位宇江尾化木句毛子左士酢背祖")),
    "no-nfd": Derived(("translate", "hs", "゙́")),
    "no-zero-width-spaces": Derived(("translate", "hs", "​﻿")),
    "no-exclamation-question-mark": Derived(("translate", "qz", "！？")),
    "ja-no-mixed-period": Derived(("replace", "e.", "e。"), ("replace", "n.", "n。")),
    "no-todo": Derived(("replace", "the ", "TODO: "), ("replace", "of ", "fixme "), ("replace", "and ", "HACK:")),
    "ja-prh": PLAIN,
    "max-comma": Derived(("translate", ". ", "。,")),
    "no-invalid-control-character": Derived(("translate", "hs", "\x01‪")),
    "no-unmatched-pair": Derived(("translate", "wbyvg", '「」（"）')),
    "ja-unnatural-alphabet": Derived(("translate", "aeiou ", "あえいおう言")),
    "arabic-kanji-numbers": Derived(("replace", "the", "第三章"), ("replace", "er", "五回"), ("replace", "of", "1時的"), ("replace", "on", "12次関数")),
    "ja-no-weak-phrase": Derived(("replace", "the", "かもしれない"), ("replace", "er", "と思う"), ("replace", "of", "と思います"), ("replace", "on", "可能性を示唆している")),
    "ja-no-abusage": Derived(("replace", "the", "うる覚え"), ("replace", "er", "を適応"), ("replace", "of", "固定概念"), ("replace", "on", "目を止め")),
}
OPTIONS = {"ja-prh": {"terms": [{"expected": "thee", "pattern": "the"}, {"expected": "und", "patterns": ["and", "ou"]}]}, "max-comma": {"max": 3}}


def _rule_query(rule_id: str, text: Derived):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = active({rule_id: Setting(options=OPTIONS.get(rule_id))}, "ja")
        out = lint_slices(plain_slices(text.docs(spark, sf_dir)), [r for r in rules if r.id == rule_id])
        return out.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "message")

    return query


def _formatted(key: str, *values: str) -> str:
    """A message template as SQL; values are SQL."""
    parts = surface.MESSAGES[key].split("%s")
    return " || ".join(x for p in zip([literal(p) for p in parts], [f"({v})::VARCHAR" for v in values] + [""]) for x in p if x)


def _code_point(v: str) -> str:
    return f"'U+' || lpad(upper(to_hex(unicode({v}))), 4, '0')"


def _rule_sql() -> dict[str, str]:
    t, out = RULE_TEXT, {}
    simple = {
        "max-kanji-continuous-len": ("[㐀-䶿一-鿿]{6,}", _formatted("kanji", "length(v)", "5")),
        "no-hankaku-kana": ("[｡-ﾟ]+", _formatted("kana")),
        "no-nfd": ("[̀-゙゚ͯ]", _formatted("combining", _code_point("v"))),
        "no-zero-width-spaces": ("[​-‍⁠﻿]", _formatted("invisible", _code_point("v"))),
        "no-exclamation-question-mark": ("[!！?？]", _formatted("exclamation", "v")),
        "no-invalid-control-character": (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{202a}-\x{202e}]", _formatted("control", _code_point("v"))),
        "ja-no-weak-phrase": ("可能性を示唆している|かもしれ|思います|かも|思う", f"CASE WHEN v = '可能性を示唆している' THEN {_formatted('weak_double')} ELSE {_formatted('weak', 'v')} END"),
    }
    for rule, (pattern, message) in simple.items():
        out[rule] = found("m", duck_matches(pattern, t[rule]), message)
    for rule, mark, most in (("max-ten", "、", 3), ("max-comma", ",", 3)):
        n = f"(length(v) - length(replace(v, '{mark}', '')))"
        out[rule] = found("m", duck_matches("[^。]*。|[^。]+", t[rule]), _formatted("marks", f"'{mark}'", n, str(most)), where=f"{n} > {most}")
    stop = "[^.!?。！？]*[.!?。！？]|[^.!?。！？]+"
    out["sentence-length"] = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_replace(unnest(regexp_extract_all(text, '{stop}')), '^\\s+', '') AS v FROM t)
SELECT doc_id, 0 AS span_start, strlen(text)::INT AS span_end, {_formatted("long", "length(v)", "100")} AS message FROM s WHERE length(v) > 100"""
    both = "count(*) FILTER (strlen(v) > 1) OVER (PARTITION BY doc_id) AS wide, count(*) FILTER (strlen(v) = 1) OVER (PARTITION BY doc_id) AS narrow"
    letters = duck_matches("[A-Za-z]|[Ａ-Ｚａ-ｚ]", t["no-mixed-zenkaku-hankaku-alphabet"])
    out["no-mixed-zenkaku-hankaku-alphabet"] = found("c", letters + f", c AS (SELECT *, {both} FROM m)", f"CASE WHEN strlen(v) > 1 THEN {_formatted('alphabet', literal('半角英字'))} ELSE {_formatted('alphabet', literal('全角英字'))} END", where="wide > 0 AND narrow > 0 AND (wide <= narrow) = (strlen(v) > 1)")
    stops = duck_matches(r"。|\.\s|\.$", t["ja-no-mixed-period"])
    kinds = "count(*) FILTER (v = '。') OVER (PARTITION BY doc_id) AS wide, count(*) FILTER (v <> '。') OVER (PARTITION BY doc_id) AS narrow"
    out["ja-no-mixed-period"] = found("c", stops + f", c AS (SELECT *, {kinds} FROM m)", f"CASE WHEN v = '。' THEN {_formatted('period', literal('.'), literal('。'))} ELSE {_formatted('period', literal('。'), literal('.'))} END", e="(s + CASE WHEN v = '。' THEN 3 ELSE 1 END)::INT", where="wide > 0 AND narrow > 0 AND (wide < narrow) = (v = '。')")
    out["no-todo"] = "\nUNION ALL\n".join("(" + found("m", duck_matches(f"(?i){p}", t["no-todo"]), _formatted("marker", literal(p.rstrip()))) + ")" for p in surface.MARKERS)
    terms = [("and", "und"), ("ou", "und")]
    out["ja-prh"] = "\nUNION ALL\n".join("(" + found("m", duck_matches(p, PLAIN), _formatted("term", literal(p), literal(x))) + ")" for p, x in terms)
    the = duck_matches("thee|the", PLAIN)
    out["ja-prh"] = "(" + found("m", the, _formatted("term", literal("the"), literal("thee")), where="v = 'the'") + ")\nUNION ALL\n" + out["ja-prh"]
    pairs = [p for p in surface.PAIRS if p[0] in '「（"']
    sides = []
    for opener, closer, name, _ in pairs:
        m = duck_matches(f"[{opener}{closer}]" if opener != closer else opener, t["no-unmatched-pair"])
        if opener == closer:
            open_ = "SELECT doc_id, CASE WHEN count(*) % 2 = 1 THEN max(s) END AS s FROM m GROUP BY doc_id"
        else:
            open_ = f"SELECT m.doc_id, min(m.s) AS s FROM m LEFT JOIN (SELECT doc_id, max(s) AS last FROM m WHERE v = '{closer}' GROUP BY doc_id) c ON c.doc_id = m.doc_id WHERE m.v = '{opener}' AND m.s > coalesce(c.last, -1) GROUP BY m.doc_id"
        sides.append("(" + found("o", m + f", o AS ({open_})", _formatted("open", literal(opener), literal(name)), e=f"(s + {len(opener.encode())})::INT", where="s IS NOT NULL") + ")")
    out["no-unmatched-pair"] = "\nUNION ALL\n".join(sides)
    near = "[々〇〻㐀-䶿一-鿿豈-﫿ぁ-んァ-ヶー。、・−＀-￯]"
    out["ja-unnatural-alphabet"] = found("c", duck_matches(r"(?s).", t["ja-unnatural-alphabet"]) + ", c AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i))", _formatted("letter", "v"),
        where=f"regexp_full_match(v, '[b-df-hj-mp-tv-z]') AND regexp_full_match(p, '{near}') AND regexp_full_match(n, '{near}') AND n <> '言' AND NOT (v IN ('x', 'y', 'z') AND n IN ('座', '軸'))")
    numbers = t["arabic-kanji-numbers"]
    k = f"[{surface.NUMERALS}]"
    out["arabic-kanji-numbers"] = "(" + found("m", duck_matches(f"第{k}+[章節]|{k}+(?:回|か月|番目|進法|次元)", numbers), _formatted("to_arabic", "v")) + ")\nUNION ALL\n(" + found("m", duck_matches("世界1|第3者|1時的|1部分|1部の|1番に|5大陸|[0-9]+次関数", numbers), _formatted("to_kanji", "v")) + ")"
    entries = [("うる覚え", surface.MESSAGES["misused"] % ("うる覚え", "うろ覚え", "うろ覚え")), ("固定概念", surface.MESSAGES["misused"] % ("固定概念", "固定観念", "固定観念"))] + [(w, surface.MISUSED_OTHER[w]) for w in ("を適応", "目を止め")]
    out["ja-no-abusage"] = "\nUNION ALL\n".join("(" + found("m", duck_matches(w, t["ja-no-abusage"]), literal(m)) + ")" for w, m in entries)
    return out


# Tokens: words of the plain text, with parts of speech made from their lengths.

_KINDS = [("助詞", "接続助詞", "が"), ("助詞", "格助詞", "が"), ("動詞", "自立", "見"), ("助動詞", None, "れる"), ("名詞", "一般", "こと"), ("接続詞", None, "しかし"), ("形容詞", "自立", "ない"), ("助詞", "係助詞", "は")]


def pseudo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_of(PLAIN.docs(spark, sf_dir, by="doc_id"), ["doc_id"], pieces(F.col("text"), r"[^ \n]+"))
    n = F.char_length("value")
    kind = F.array(*(F.struct(F.lit(a).alias("pos"), F.lit(b).alias("pos1"), F.lit(c).alias("surface")) for a, b, c in _KINDS))[F.pmod(n, F.lit(8))]
    base = F.when(kind["pos"] == "助動詞", F.when(n > 4, "ない").otherwise("です")).when(kind["pos"] == "動詞", F.when(n > 4, "できる").otherwise("れる")).otherwise(kind["surface"])
    return rows.select(
        "doc_id", F.lit(0).cast("long").alias("slice_id"), F.lit(1).alias("node_id"), F.lit(0).alias("base"), "gap", F.col("value").alias("written"), "start", "end",
        kind["surface"].alias("surface"), (n > 14).alias("is_unknown"), base.alias("base_form"), kind["pos"].alias("pos"), kind["pos1"].alias("pos1"),
        F.when(kind["pos"] == "動詞", "一段").alias("ctype"),
    )


def _token_ctes() -> str:
    lists = ["[" + ", ".join("NULL" if x[i] is None else literal(x[i]) for x in _KINDS) + "]" for i in range(3)]
    return duck_matches(r"[^ \n]+", PLAIN) + f""",
k AS (SELECT doc_id, i, s, (s + strlen(v))::INT AS e, v, length(v) AS n, text,
  {lists[0]}[length(v) % 8 + 1] AS pos, {lists[1]}[length(v) % 8 + 1] AS pos1, {lists[2]}[length(v) % 8 + 1] AS surface, length(v) > 14 AS unk,
  coalesce(sum(length(v) - length(regexp_replace(v, '[。．.！？!?]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM m),
tok AS (SELECT *, CASE pos WHEN '助動詞' THEN CASE WHEN n > 4 THEN 'ない' ELSE 'です' END WHEN '動詞' THEN CASE WHEN n > 4 THEN 'できる' ELSE 'れる' END ELSE surface END AS base FROM k)"""


def _token_sql() -> dict[str, str]:
    from .operators import tokens as t

    ctes, out = _token_ctes(), {}
    w = "OVER (PARTITION BY doc_id ORDER BY s)"
    sw = "OVER (PARTITION BY doc_id, sent ORDER BY s)"
    neg = "(NOT unk AND ((pos = '助動詞' AND base IN ('ない', 'ぬ', 'ず')) OR (pos = '形容詞' AND base = 'ない')))"
    out["no-doubled-conjunctive-particle-ga"] = found("g", ctes + f", g AS (SELECT *, row_number() {sw} AS nth FROM tok WHERE NOT unk AND pos = '助詞' AND pos1 = '接続助詞' AND surface = 'が')", literal(t.GA), e="e", where="nth >= 2")
    out["ja-no-redundant-expression"] = found("g", ctes + f", g AS (SELECT *, lead(NOT unk AND pos = '助詞' AND pos1 = '格助詞' AND surface = 'が') {w} AS ga, lead(NOT unk AND ((pos = '動詞' AND base = 'できる') OR (pos = '名詞' AND surface = '可能')), 2) {w} AS tail, lead(e, 2) {w} AS last FROM tok)", literal(t.REDUNDANT), e="last", where="NOT unk AND pos = '名詞' AND surface = 'こと' AND ga AND tail")
    out["no-dropping-the-ra"] = found("g", ctes + f", g AS (SELECT *, lead(NOT unk AND pos IN ('動詞', '助動詞') AND base = 'れる') {w} AS reru, lead(e) {w} AS last FROM tok)", literal(t.DROPPED_RA), e="last", where="NOT unk AND pos = '動詞' AND reru")
    out["no-double-negative-ja"] = found("g", ctes + f", g AS (SELECT *, lead({neg}) {w} AS nx, lead(e) {w} AS last, sum(CASE WHEN {neg} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM tok)", literal(t.DOUBLE_NEGATIVE), e="last", where="NOT unk AND pos = '助詞' AND surface = 'は' AND nx AND earlier >= 1")
    out["no-doubled-conjunction"] = found("h", ctes + f", g AS (SELECT *, row_number() {sw} AS nth FROM tok WHERE NOT unk AND pos = '接続詞'), h AS (SELECT *, lag(surface) {w} AS b FROM g WHERE nth = 1)", " || surface || ".join(map(literal, t.CONJUNCTION.split("%s"))), e="e", where="b = surface")
    out["ja-no-successive-word"] = found("g", ctes + f", g AS (SELECT *, lag(surface) {w} AS b, lag(unk) {w} AS lost FROM tok)", " || surface || ".join(map(literal, t.SUCCESSIVE.split("%s"))), e="e", where="NOT unk AND NOT lost AND b = surface")
    style = "CASE WHEN unk THEN NULL WHEN pos = '助動詞' THEN CASE WHEN base IN ('です', 'ます') THEN 'polite' WHEN base IN ('だ', 'である') THEN 'plain' END WHEN pos IN ('動詞', '形容詞') THEN 'plain' WHEN pos = '名詞' THEN 'none' END"
    out["no-mix-dearu-desumasu"] = found("h", ctes + f", g AS (SELECT *, {style} AS style FROM tok), l AS (SELECT doc_id, sent, max_by(style, s) AS style, max_by(e, s) AS e, max(s) AS s FROM g WHERE style IS NOT NULL GROUP BY doc_id, sent), h AS (SELECT *, count(*) FILTER (style = 'plain') OVER (PARTITION BY doc_id) AS a, count(*) FILTER (style = 'polite') OVER (PARTITION BY doc_id) AS b FROM l WHERE style <> 'none')",
        f"CASE WHEN style = 'plain' THEN {literal(t.STYLE % ('である', 'ですます'))} ELSE {literal(t.STYLE % ('ですます', 'である'))} END", e="e", where="a > 0 AND b > 0 AND style = CASE WHEN b >= a THEN 'plain' ELSE 'polite' END")
    p = t.DOUBLED.split("%s")
    line = "CASE WHEN {0}b = '' THEN '- \"' || {0}surface || '\"' ELSE '- ' || {0}b || '\"' || {0}surface || '\"' END"
    out["no-doubled-joshi"] = found("h", ctes + f""",
a AS (SELECT *, row_number() {w} AS at, coalesce(lag(surface) {w}, '') AS b FROM tok),
p AS (SELECT * FROM a WHERE NOT unk AND pos = '助詞' AND NOT (surface = 'の' AND pos1 = '連体化') AND NOT (surface = 'を' AND pos1 = '格助詞') AND NOT (surface = 'て' AND pos1 = '接続助詞')),
q AS (SELECT *, surface || ':助詞.' || pos1 AS key FROM p),
r AS (SELECT *, {line.format("")} AS line FROM q),
g AS (SELECT *, lag(e) OVER x AS pe, lag(line) OVER x AS pl FROM r WINDOW x AS (PARTITION BY doc_id, sent, key ORDER BY s)),
h AS (SELECT * FROM g WHERE pe IS NOT NULL AND NOT regexp_matches(decode(encode(text)[pe + 1:s]), '[、，()（）「」]'))""",
        f"{literal(p[0])} || surface || {literal(p[1])} || pl || {literal(p[2])} || line || {literal(p[3])}", e="e")
    return out


def _token_query(rule_id: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        slices = plain_slices(PLAIN.docs(spark, sf_dir))
        out = lint_slices(slices, [r for r in active({}, "ja") if r.id == rule_id], pseudo_tokens(spark, sf_dir), dealt=True)
        return out.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "message")

    return query


# Engine operators.


def _dictionary(spark, sf_dir):
    """Terms: the words of the benchmark passages and of part names, to be written in capitals."""
    words = lambda table, c: documents(spark, f"{sf_dir}/{table}.parquet").select(F.explode(F.regexp_extract_all(F.col(c), F.lit("[a-z]{3,}"), F.lit(0))).alias("pattern"))
    return words("benchmark", "text").union(words("part", "p_name")).distinct().select("pattern", F.upper("pattern").alias("expected"))


def _found_terms(find):
    def query(spark, sf_dir):
        out = find(PLAIN.docs(spark, sf_dir), _dictionary(spark, sf_dir), ["doc_id"])
        return out.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "pattern", "expected")

    return query


TERMS_SQL = """WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS pattern FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(p_name, '[a-z]{3,}')) FROM part),
t AS (SELECT DISTINCT pattern FROM w),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, pattern, string_split(text, pattern) AS gaps FROM t JOIN d ON contains(text, pattern)),
g AS (SELECT doc_id, pattern, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i, len(gaps) AS n FROM m),
p AS (SELECT doc_id, pattern, i, n, sum(strlen(gap)) OVER (PARTITION BY doc_id, pattern ORDER BY i) + (i - 1) * strlen(pattern) AS span_start FROM g)
SELECT doc_id, span_start::INT AS span_start, (span_start + strlen(pattern))::INT AS span_end, pattern, upper(pattern) AS expected FROM p WHERE i < n"""


def position_map(spark, sf_dir):
    docs = RULE_TEXT["no-hankaku-kana"].docs(spark, sf_dir)
    hit = each_of(docs, ["doc_id"], located(F.col("text"), "ｱ+"))
    return hit.select("doc_id", F.col("start").alias("span_start"), "line", F.col("column").alias("col"), F.col("utf16_column").alias("utf16_col"))


#: Line ends are in gaps alone; a column counts from the last gap that holds one.
POSITION_SQL = "WITH " + duck_matches("ｱ+", RULE_TEXT["no-hankaku-kana"]) + """,
g AS (SELECT doc_id, i, length(g) - length(replace(g, chr(10), '')) AS ends, length(string_split(g, chr(10))[-1]) AS tail,
  sum(strlen(g) + strlen(v)) OVER w - strlen(v) AS span_start, sum(length(g) + length(v)) OVER w - length(v) AS chars FROM m_u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, span_start, sum(ends) OVER w + 1 AS line, chars - coalesce(max(CASE WHEN ends > 0 THEN chars - tail END) OVER w, 0) + 1 AS col FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, span_start::INT AS span_start, line::INT AS line, col::INT AS col, col::INT AS utf16_col FROM p"""


def plain_regions(spark, sf_dir):
    return plain_slices(PLAIN.docs(spark, sf_dir)).select("doc_id", F.inline("nodes")).select("doc_id", "node_id", "kind", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "parent")


PLAIN_SQL = """SELECT doc_id, n.node_id, n.kind, 0 AS span_start, strlen(coalesce(text, ''))::INT AS span_end, n.parent
FROM documents, (VALUES (0, 0, NULL), (1, 1, 0), (2, 17, 1)) n(node_id, kind, parent)"""


def whitespace_tokens(spark, sf_dir):
    from .sources.tokenizers import whitespace_tokens as run

    return run(plain_slices(PLAIN.docs(spark, sf_dir))).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "surface")


WHITESPACE_SQL = "WITH " + duck_matches(r"\S+", PLAIN) + "\nSELECT doc_id, s AS span_start, (s + strlen(v))::INT AS span_end, v AS surface FROM m"


def sentence_split(spark, sf_dir):
    return PLAIN.docs(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


SENTENCE_SQL = r"""WITH c AS (SELECT doc_id, [regexp_replace(x, '^\s+', '') for x in regexp_extract_all(coalesce(text, ''), '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+')] AS v FROM documents),
s AS (SELECT doc_id, [x for x in v if x <> ''] AS v FROM c)
SELECT doc_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS sentence FROM s"""


def url_strip(spark, sf_dir):
    pages = documents(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", strip_urls(F.concat("url", F.lit(" と（"), "url", F.lit("）を見る"))).alias("text"), F.sha2(strip_urls(F.col("html")), 256).alias("html_sha256"))


URL_SQL = r"""SELECT page_id, regexp_replace(url || ' と（' || url || '）を見る', 'https?://[^\s」）)、。]*', '・', 'g') AS text,
sha256(regexp_replace(html, 'https?://[^\s\x{0b}\x{85}\x{a0}\x{3000}」）)、。]*', '・', 'g')) AS html_sha256 FROM pages"""


def apply_fixes_query(spark, sf_dir):
    rules = [r for r in active({"ja-prh": Setting(options={"terms": [{"expected": "Θ", "pattern": "the"}, {"expected": "und", "pattern": "and"}]})}, "ja") if r.id == "ja-prh"]
    docs = PLAIN.docs(spark, sf_dir)
    out = apply_fixes(docs, lint_slices(plain_slices(docs), rules))
    return out.select("doc_id", F.sha2("text", 256).alias("fixed_sha256"), "applied", "deferred")


FIX_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, sha256(replace(replace(text, 'the', 'Θ'), 'and', 'und')) AS fixed_sha256,
  ((strlen(text) - strlen(replace(text, 'the', ''))) // 3 + (strlen(text) - strlen(replace(text, 'and', ''))) // 3)::INT AS applied, 0 AS deferred FROM t"""


def fix_fixpoint(spark, sf_dir):
    from .operators.fixes import fix_terms

    rules = [r for r in active({"ja-prh": Setting(options={"terms": [{"expected": "aer", "pattern": "er"}, {"expected": "en", "pattern": "aae"}]})}, "ja") if r.id == "ja-prh"]
    out = fix_terms(PLAIN.docs(spark, sf_dir), surface.compiled_terms(rules[0].options)[0])
    return out.select("doc_id", F.sha2("text", 256).alias("fixed_sha256"), "passes")


def fix_incremental_query(spark, sf_dir):
    from .operators.incremental import fix_incremental
    from .plans.store import table

    rules = [r for r in active({"ja-prh": Setting(options={"terms": [{"expected": "aer", "pattern": "er"}, {"expected": "en", "pattern": "aae"}]})}, "ja") if r.id == "ja-prh"]
    out = fix_incremental(PLAIN.docs(spark, sf_dir), line_slices, rules, table)
    return out.select("doc_id", F.sha2("text", 256).alias("fixed_sha256"), "passes")


#: Of the two terms only "aae" and "er" in "aaer" can meet, and the one that begins first counts; a pass that changes nothing is the last.
FIXPOINT_SQL = """WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(text, '') AS before, replace(replace(replace(coalesce(text, ''), 'aae', chr(1)), 'er', 'aer'), chr(1), 'en') AS text, 1 AS passes FROM documents
  UNION ALL
  SELECT doc_id, text, replace(replace(replace(text, 'aae', chr(1)), 'er', 'aer'), chr(1), 'en'), passes + 1 FROM r WHERE text <> before AND passes < 10)
SELECT doc_id, sha256(text) AS fixed_sha256, passes FROM r WHERE text = before OR passes = 10"""


def cache_keys(spark, sf_dir):
    return PLAIN.docs(spark, sf_dir).select("doc_id", cache.cache_key(F.col("text"), "settings").alias("cache_key"))


CACHE_SQL = "SELECT doc_id, sha256(strlen(coalesce(text, ''))::VARCHAR || '|' || coalesce(text, '') || '|8|settings') AS cache_key FROM documents"


def cache_hit_miss(spark, sf_dir):
    docs = PLAIN.docs(spark, sf_dir)
    seen = docs.where(F.col("doc_id") % 3 == 0).select(cache.cache_key(F.col("text"), "settings").alias("cache_key")).distinct()
    hits, misses = cache.split(docs, seen, "settings")
    return hits.select("doc_id", F.lit("hit").alias("side")).unionByName(misses.select("doc_id", F.lit("miss").alias("side")))


CACHE_SPLIT_SQL = """SELECT doc_id, CASE WHEN coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 = 0) THEN 'hit' ELSE 'miss' END AS side FROM documents"""

_MIXED = Derived(("translate", "qz", "！？"), ("replace", "the ", "TODO: "))
_MIXED_RULES = ("no-exclamation-question-mark", "no-todo")


def _mixed(spark, sf_dir):
    config = Config("ja", rules={"no-todo": Setting(True, "error", None)})
    docs = _MIXED.docs(spark, sf_dir)
    return docs, lint_slices(plain_slices(docs), [r for r in active(config.rules, "ja") if r.id in _MIXED_RULES])


def _mixed_sql() -> str:
    def side(pattern: str, message: str, rule: str, severity: str) -> str:
        return f"(SELECT *, '{rule}' AS rule_id, '{severity}' AS severity FROM ({found('m', duck_matches(pattern, _MIXED), message)}))"

    todos = [side(f"(?i){p}", _formatted("marker", literal(p.rstrip())), "no-todo", "error") for p in surface.MARKERS]
    return "\nUNION ALL\n".join([side("[!！?？]", _formatted("exclamation", "v"), "no-exclamation-question-mark", "warning"), *todos])


def lint_union(spark, sf_dir):
    return _mixed(spark, sf_dir)[1].select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "message", "rule_id", "severity")


def severity_summary(spark, sf_dir):
    return _mixed(spark, sf_dir)[1].groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def text_report(spark, sf_dir):
    docs, found_ = _mixed(spark, sf_dir)
    return render.text_lines(found_, docs.withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))).select("path", "line")


def _text_report_sql() -> str:
    return f"""WITH d AS ({_mixed_sql()}), x AS (SELECT d.*, decode(encode(t.text)[1:d.span_start]) AS b FROM d JOIN (SELECT doc_id, {_MIXED.sql()} AS text FROM documents) t USING (doc_id))
SELECT 'doc-' || doc_id AS path, 'doc-' || doc_id || ':' || (length(b) - length(replace(b, chr(10), '')) + 1) || ':' || (length(string_split(b, chr(10))[-1]) + 1) || ': ' || severity || ': ' || message || ' [' || rule_id || ']' AS line FROM x"""


def json_report(spark, sf_dir):
    docs, found_ = _mixed(spark, sf_dir)
    return render.json_files(found_, docs.withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))


def _placed_sql() -> str:
    """CTEs that end in p: findings with the place of their start (l1, c1) and end (l2, c2); the derived text is in the basic plane."""
    place = "length({0}) - length(replace({0}, chr(10), '')) + 1 AS l{1}, length(string_split({0}, chr(10))[-1]) + 1 AS c{1}"
    return f"""d AS ({_mixed_sql()}),
x AS (SELECT d.*, 'doc-' || doc_id AS path, decode(encode(t.text)[1:d.span_start]) AS b1, decode(encode(t.text)[1:d.span_end]) AS b2 FROM d JOIN (SELECT doc_id, {_MIXED.sql()} AS text FROM documents) t USING (doc_id)),
p AS (SELECT *, {place.format("b1", 1)}, {place.format("b2", 2)} FROM x)"""


def _json_report_sql() -> str:
    point = """'{{"line":' || l{0} || ',"column":' || c{0} || ',"utf16Column":' || c{0} || '}}'"""
    item = f"""'{{"fixes":[],"message":"' || message || '","position":{{"start":' || {point.format(1)} || ',"end":' || {point.format(2)} || '}},"rule_id":"' || rule_id || '","severity":"' || severity || '","span":{{"start":' || span_start || ',"end":' || span_end || '}}}}'"""
    return f"""WITH {_placed_sql()},
j AS (SELECT path, string_agg({item}, ',' ORDER BY span_start, span_end, rule_id, message) AS items FROM p GROUP BY path)
SELECT 'doc-' || doc_id AS path, '{{"diagnostics":[' || coalesce(items, '') || '],"path":"doc-' || doc_id || '"}}' AS json FROM documents LEFT JOIN j ON j.path = 'doc-' || doc_id"""


def sarif_report(spark, sf_dir):
    docs, found_ = _mixed(spark, sf_dir)
    rows = render.sarif_results(found_, docs.withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))
    return rows.select("path", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "rule_id", "json")


def _sarif_report_sql() -> str:
    region = """'{"startLine":' || l1 || ',"startColumn":' || c1 || ',"endLine":' || l2 || ',"endColumn":' || c2 || '}'"""
    body = f"""'{{"ruleId":"' || rule_id || '","ruleIndex":' || i || ',"level":"' || severity || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":' || {region} || '}}}}]}}'"""
    return f"""WITH {_placed_sql()},
f AS (SELECT rule_id, min((path, span_start, span_end, rule_id, message)) AS first FROM p GROUP BY rule_id),
r AS (SELECT rule_id, row_number() OVER (ORDER BY first) - 1 AS i FROM f)
SELECT path, span_start, span_end, rule_id, {body} AS json FROM p JOIN r USING (rule_id)"""


def compact_report(spark, sf_dir):
    return render.compact_json(_mixed(spark, sf_dir)[1])


def _compact_sql() -> str:
    return f"""WITH d AS ({_mixed_sql()})
SELECT doc_id, '[' || string_agg('{{"ruleId":"' || rule_id || '","severity":"' || severity || '","message":"' || message || '","start":' || span_start || ',"end":' || span_end || '}}', ',' ORDER BY span_start, span_end, rule_id, message) || ']' AS json FROM d GROUP BY doc_id"""


def language_scope(spark, sf_dir):
    rows = [(lang or "none", r.id) for lang in ("ja", "en", None) for r in active({}, lang)]
    return spark.createDataFrame(rows, "lang string, rule_id string").groupBy("lang").agg(F.count(F.lit(1)).alias("rules"))


def rules_overlay(spark, sf_dir):
    config = from_dict({"extends": "ja-basic", "rules": {"no-nfd": {"severity": "error"}, "no-todo": False}})
    return rule_table(spark, config).select("rule_id", "severity", "enabled")


#: All rules there are.
RULE_IDS = """sentence-length max-ten max-kanji-continuous-len no-hankaku-kana no-mixed-zenkaku-hankaku-alphabet no-nfd no-zero-width-spaces no-exclamation-question-mark
ja-no-mixed-period no-todo ja-prh max-comma no-invalid-control-character no-unmatched-pair ja-unnatural-alphabet arabic-kanji-numbers ja-no-weak-phrase ja-no-abusage
no-doubled-joshi no-mix-dearu-desumasu no-doubled-conjunctive-particle-ga ja-no-redundant-expression no-dropping-the-ra no-double-negative-ja no-doubled-conjunction ja-no-successive-word"""
OVERLAY_SQL = f"""SELECT rule_id, CASE rule_id WHEN 'no-nfd' THEN 'error' ELSE 'warning' END AS severity, rule_id <> 'no-todo' AS enabled
FROM (SELECT unnest(string_split_regex('{RULE_IDS}', '\\s+')) AS rule_id)"""


def delimited_cells(spark, sf_dir):
    from .sources.delimited import cells

    return cells(_csv(spark, sf_dir), ",").select("doc_id", "record", "col", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def _csv(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.col("c_custkey").cast("long").alias("doc_id"), F.concat(F.lit('id,"the ""name"""\r\n'), F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('"\n')).alias("text"))


DELIMITED_SQL = """WITH t AS (SELECT c_custkey::BIGINT AS doc_id, strlen(c_custkey::VARCHAR) AS k, strlen(c_name) AS n FROM customer)
SELECT doc_id, r.record, r.col, (CASE r.i WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 19 ELSE 21 + k END)::INT AS span_start, (CASE r.i WHEN 1 THEN 2 WHEN 2 THEN 16 WHEN 3 THEN 19 + k ELSE 21 + k + n END)::INT AS span_end
FROM t, (VALUES (1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)) r(i, record, col)"""


def delimited_ranges(spark, sf_dir):
    """All documents as records of CSV files, read back in ranges of 64 KB."""
    from .plans.store import folder
    from .sources.ranges import file_ranges, range_cells

    path = f"{folder(spark)}/delimited-{uuid.uuid4().hex}"
    text = F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""'))
    documents(spark, f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(',"'), text, F.lit('"')).alias("value")).write.text(path)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cells = range_cells(file_ranges(files, 64 << 10))
    value = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    rows = cells.groupBy("path", "record").agg(value(0).cast("long").alias("doc_id"), value(1).alias("text"), F.count(F.lit(1)).alias("cells"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), "cells")


RANGES_SQL = """WITH t AS (SELECT doc_id, replace(coalesce(text, ''), '"', '""') AS v FROM documents)
SELECT doc_id, strlen(v)::BIGINT AS n_bytes, md5(v) AS text_md5, 2::BIGINT AS cells FROM t"""


def delimited_lint(spark, sf_dir):
    from .sources.delimited import delimited_slices

    config = from_dict({"language": "ja", "rules": {"no-exclamation-question-mark": False}, "formats": {"csv": {"header": True, "columns": {"note": {"parse-mode": "plain", "rules": {"no-exclamation-question-mark": True}}}}}})
    docs = documents(spark, f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit('id, note \n1,"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"\n'))
    slices = delimited_slices(docs.select("doc_id", text.alias("text")), config.formats["csv"], ",")
    out = lint(slices, config, "csv").where("rule_id = 'no-exclamation-question-mark'")
    return out.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "message")


def _delimited_lint_sql() -> str:
    inner = Derived(("replace", '"', '""'))
    return found("m", duck_matches("[!！?？]", inner), _formatted("exclamation", "v"), s="(s + 13)::INT", e="(s + 13 + strlen(v))::INT")


def markdown_nodes(spark, sf_dir):
    from .sources.markdown import markdown_slices

    docs = documents(spark, f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("# Title of `it`\n\n> "), F.coalesce("text", F.lit("")))
    slices, _ = markdown_slices(docs.select("doc_id", text.alias("text")))
    return slices.select("doc_id", F.inline("nodes")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def markdown_structure(spark, sf_dir):
    """Every kind and place of node in a Markdown text around a document's words; where there is no word, an x."""
    from .sources.markdown import markdown_slices

    docs = documents(spark, f"{sf_dir}/documents.parquet")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "))
    words = F.when(words == "", "x").otherwise(words)
    text = F.concat(F.lit("# Title of `it`\n\n> "), words, F.lit("\n\n- **"), words, F.lit("**\n- b"))
    slices, _ = markdown_slices(docs.select("doc_id", text.alias("text")))
    return slices.select("doc_id", F.inline("nodes")).select("doc_id", "node_id", "kind", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "parent")


#: Kinds: 0 root, 2 heading, 17 text, 21 inline code, 4 quote, 1 paragraph, 5 list, 6 item, 19 strong.
STRUCTURE_SQL = """WITH w AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) AS w FROM documents),
n AS (SELECT doc_id, greatest(1, length(w))::INT AS n FROM w)
SELECT doc_id, t.* FROM n, LATERAL (VALUES (0, 0, 0, 34 + 2 * n - 3, NULL), (1, 2, 0, 15, 0), (2, 17, 2, 11, 1), (3, 21, 11, 15, 1), (4, 4, 17, 19 + n, 0), (5, 1, 19, 19 + n, 4), (6, 17, 19, 19 + n, 5),
  (7, 5, 21 + n, 31 + 2 * n, 0), (8, 6, 21 + n, 27 + 2 * n, 7), (9, 1, 23 + n, 27 + 2 * n, 8), (10, 19, 23 + n, 27 + 2 * n, 9), (11, 17, 25 + n, 25 + 2 * n, 10),
  (12, 6, 28 + 2 * n, 31 + 2 * n, 7), (13, 1, 30 + 2 * n, 31 + 2 * n, 12), (14, 17, 30 + 2 * n, 31 + 2 * n, 13)) t(node_id, kind, span_start, span_end, parent)"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all rules that need no tokens, over all documents as Japanese prose."""
    return lint(plain_slices(PLAIN.docs(spark, sf_dir)), from_dict({"extends": "ja-technical-writing"}))


def _name(rule_id: str) -> str:
    return rule_id.replace("-", "_")


def queries():
    own = {_name(rule): _rule_query(rule, text) for rule, text in RULE_TEXT.items()}
    own |= {_name(rule): _token_query(rule) for rule in _token_sql()}
    return own | {
        "term_dictionary": _found_terms(terms.find), "term_dictionary_joined": _found_terms(terms.find_by_join),
        "position_map": position_map, "plain_regions": plain_regions, "whitespace_tokens": whitespace_tokens, "sentence_split": sentence_split, "url_strip": url_strip,
        "apply_fixes": apply_fixes_query, "fix_fixpoint": fix_fixpoint, "fix_incremental": fix_incremental_query, "cache_key": cache_keys, "cache_hit_miss": cache_hit_miss, "lint_union": lint_union,
        "severity_summary": severity_summary, "text_report": text_report, "json_report": json_report, "sarif_report": sarif_report, "compact_report": compact_report,
        "language_scope": language_scope, "rules_overlay": rules_overlay, "delimited_cells": delimited_cells, "delimited_ranges": delimited_ranges, "delimited_lint": delimited_lint, "markdown_nodes": markdown_nodes, "markdown_structure": markdown_structure,
    }


def oracle_sql():
    own = {_name(rule): sql for rule, sql in (_rule_sql() | _token_sql()).items()}
    mixed = _mixed_sql()
    return own | {
        "term_dictionary": TERMS_SQL, "term_dictionary_joined": TERMS_SQL, "position_map": POSITION_SQL, "plain_regions": PLAIN_SQL, "whitespace_tokens": WHITESPACE_SQL, "sentence_split": SENTENCE_SQL, "url_strip": URL_SQL,
        "apply_fixes": FIX_SQL, "cache_key": CACHE_SQL, "cache_hit_miss": CACHE_SPLIT_SQL, "lint_union": mixed,
        "severity_summary": f"SELECT severity, rule_id, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({mixed}) GROUP BY ALL",
        "text_report": _text_report_sql(), "compact_report": _compact_sql(),
        "language_scope": "SELECT * FROM (VALUES ('ja', 26::BIGINT), ('en', 7::BIGINT), ('none', 7::BIGINT)) t(lang, rules)",
        "rules_overlay": OVERLAY_SQL, "json_report": _json_report_sql(), "sarif_report": _sarif_report_sql(), "fix_fixpoint": FIXPOINT_SQL, "fix_incremental": FIXPOINT_SQL, "markdown_structure": STRUCTURE_SQL,
        "delimited_cells": DELIMITED_SQL, "delimited_ranges": RANGES_SQL, "delimited_lint": _delimited_lint_sql(),
    }
