"""Rules on text alone, as Columns.

A rule is a function of a node's text and its options that gives an array of
hits.  Rules on TEXT nodes see prose without markup, rules on blocks see the raw
source of paragraphs, headings and table cells.  Document rules get candidates
from every TEXT node and decide over all of them.

Options are lenient: an option of the wrong type keeps its default.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FIX, bound, char_class, code_point, hits, matches, no_hits, quote, sentences, starting, strip_urls, wider
from . import terms

# Character classes, marks, phrases and messages that results must have.
KANJI = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
HALFWIDTH_KANA = "[\\x{FF61}-\\x{FF9F}]"
LATIN_HALF, LATIN_FULL = "[A-Za-z]", "[\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]"
COMBINING = "[\\x{80}-\\x{10FFFF}&&[\\x{0300}-\\x{036F}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{FE20}-\\x{FE2F}\\x{3099}\\x{309A}]]"
INVISIBLE = "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]"
CONTROL = "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}\\x{80}-\\x{9F}\\x{202A}-\\x{202E}]"
MARKERS = ["TODO:", "TODO ", "FIXME:", "FIXME ", "XXX:", "XXX ", "HACK:"]
PAIRS = [
    ('"', '"', '二重引用符""', False),
    ("[", "]", "角括弧[]", False),
    ("(", ")", "丸括弧()", False),
    ("{", "}", "波括弧{}", False),
    ("「", "」", "かぎ括弧「」", True),
    ("（", "）", "全角丸括弧（）", False),
    ("『", "』", "二重かぎ括弧『』", True),
    ("｛", "｝", "全角波括弧｛｝", False),
    ("［", "］", "全角角括弧［］", False),
    ("〚", "〛", "二重角括弧〚〛", True),
    ("【", "】", "隅付き括弧【】", True),
    ("«", "»", "二重山括弧«»", True),
    ("‹", "›", "山括弧‹›", True),
]
WEAK = ["かも", "かもしれ", "思う", "思います", "可能性を示唆している"]
MISUSED = {
    "値を返却する": "値を返す", "例外を補足": "例外を捕捉", "似て異なるもの": "似て非なるもの", "愛苦しい": "愛くるしい",
    "悪どい": "あくどい", "転稼": "転嫁", "こんにちわ": "こんにちは", "論戦を張る": "論陣を張る",
    "寸暇を惜しまず": "寸暇を惜しんで", "寸暇を置かず": "間を置かず", "一つ返事": "二つ返事", "怒り心頭に達する": "怒り心頭に発する",
    "熱にうなされる": "熱に浮かされる", "やるせぬ": "やるせない", "雪辱を晴らす": "雪辱を果たす", "うる覚え": "うろ覚え",
    "口先三寸": "舌先三寸", "舌の先の乾かぬ": "舌の根の乾かぬ", "悪評さくさく": "悪評高い", "悪評嘖嘖": "悪評高い",
    "悪評嘖々": "悪評高い", "器管": "器官", "上や下への": "上を下への", "上へ下への": "上を下への",
    "押しも押されぬ": "押しも押されもせぬ", "掻き入れ": "書き入れ", "引くに引かれない": "引くに引けない", "死ぬに死なれない": "死ぬに死ねない",
    "腹が煮えくり返る": "腸が煮えくり返る", "胸先三寸": "胸三寸", "肝に据えかねる": "腹に据えかねる", "へそを抱えて": "腹を抱えて",
    "後ろ立て": "後ろ盾", "絶対絶命": "絶体絶命", "有頂点": "有頂天", "一発即発": "一触即発",
    "意気高々": "意気揚々", "青色吐息": "青息吐息", "固定概念": "固定観念", "睨みを効かせ": "睨みを利かせ",
    "恩を着る": "恩に着る", "脚光を集め": "脚光を浴び", "一同に会する": "一堂に会する",
}
MISUSED_OTHER = {
    "を適応": "「を適応」は「を適用」の誤用である可能性があります。適応 → 適用",
    "可変する": "「可変する」という使い方は適切ではありません。「可逆」と同じ使い方になります。可変は状態の形容であり、「変更できる」「可変長の」などの形で使ってください。",
    "目を止め": "「目を止め」は「目を留め」の誤用です。「止」は動作の停止、「留」は意識を向ける時に使います。正しくは「目を留め」。",
}
NUMERALS = "一二三四五六七八九十壱弐参拾百〇"
MESSAGES = {
    "long": "Sentence is too long (%s characters). Maximum allowed is %s.",
    "marks": "一文に「%s」が %s 個あります。上限は %s 個です。",
    "kanji": "Kanji run of length %s exceeds the maximum of %s.",
    "kana": "半角カタカナは推奨されません。全角カタカナを使ってください。",
    "alphabet": "半角英字と全角英字が混在しています。文書全体で多く使われている%sに統一してください。",
    "combining": "Combining mark %s detected; normalize text to NFC.",
    "invisible": "Invisible codepoint %s is not allowed in prose.",
    "exclamation": "「%s」は技術文書では使用を避けてください。",
    "period": "句点の表記が混在しています。文書全体で多く使われている「%s」に合わせて「%s」を書き換えてください。",
    "marker": "Found '%s' marker. Consider resolving this before committing.",
    "term": "表記ゆれ: 「%s」は「%s」に統一してください。",
    "control": "不正なコントロール文字 %s が含まれています。",
    "open": "「%s」に対応する閉じ括弧がありません（%s）。",
    "close": "「%s」に対応する開き括弧がありません（%s）。",
    "letter": "不自然なアルファベットがあります: %s\n\nIMEの入力ミスの可能性があります。意図した文字であれば無視してください。",
    "to_arabic": "「%s」の漢数字は算用数字で書いてください。\n\n数量を表現し、数を数えられるものは算用数字を使用します。任意の数に置き換えても通用する語句がこれに該当します。",
    "to_kanji": "「%s」の算用数字は漢数字で書いてください。\n\n慣用的表現、熟語、概数、固有名詞、副詞など、漢数字を使用することが一般的な語句では漢数字を使います。",
    "weak": "弱い表現「%s」が使われています。断言できる表現に書き換えてください。",
    "weak_double": "弱い表現「可能性を示唆している」が使われています。「可能性がある」または「…を示唆している」を利用してください。弱い表現を二つ重ねることはしないでください。",
    "misused": "「%s」は「%s」の誤用です。正しくは「%s」。",
}


def say(key: str, *values) -> Column:
    """A message with its values, which are none of them null; strings are joined, as a formatter takes much longer."""
    parts = MESSAGES[key].split("%s")
    return F.concat(F.lit(parts[0]), *(x for v, part in zip(values, parts[1:]) for x in ((v if isinstance(v, Column) else F.lit(v)).cast("string"), F.lit(part)))) if values else F.lit(MESSAGES[key])


def whole(options: dict, key: str, default: int) -> int:
    """A count: JSON numbers without sign or fraction."""
    value = options.get(key)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


def flag(options: dict, key: str, default: bool) -> bool:
    value = options.get(key)
    return value if isinstance(value, bool) else default


def char(options: dict, key: str, default: str) -> str:
    value = options.get(key)
    return value[0] if isinstance(value, str) and value else default


def strings(options: dict, key: str) -> list[str] | None:
    value = options.get(key)
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else None


def sentence_length(text: Column, options: dict) -> Column:
    """One hit on the whole block for each sentence that is too long."""
    most = whole(options, "max", 100)
    cut = sentences(strip_urls(text) if flag(options, "skip_urls", True) else text)
    long = F.filter(F.transform(cut, F.char_length), lambda n: n > most)
    return hits(F.transform(long, lambda n: F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"), n.alias("value"))), lambda m: say("long", m["value"], most))


def _marks(text: Column, mark: str, stop: str, most: int) -> Column:
    none = char_class(stop).replace("[", "[^", 1)
    found = matches(text, f"{none}*{char_class(stop)}|{none}+")
    count = lambda m: F.char_length(m["value"]) - F.char_length(F.replace(m["value"], F.lit(mark), F.lit("")))
    return F.when(F.instr(text, mark) > 0, hits(F.filter(found, lambda m: count(m) > most), lambda m: say("marks", mark, count(m), most))).otherwise(no_hits())


def max_ten(text: Column, options: dict) -> Column:
    return _marks(text, char(options, "touten", "、"), char(options, "kuten", "。"), whole(options, "max", 3))


def max_comma(text: Column, options: dict) -> Column:
    return _marks(text, ",", "。", whole(options, "max", 4))


def max_kanji_continuous_len(text: Column, options: dict) -> Column:
    most = whole(options, "max", 5)
    if most > 1 << 20:
        return no_hits()
    return hits(matches(text, f"{KANJI}{{{most + 1},}}"), lambda m: say("kanji", F.char_length(m["value"]), most))


def no_hankaku_kana(text: Column, options: dict) -> Column:
    return hits(matches(text, f"{HALFWIDTH_KANA}+"), say("kana"))


def no_nfd(text: Column, options: dict) -> Column:
    return hits(matches(text, COMBINING), lambda m: say("combining", code_point(m["value"])))


def no_zero_width_spaces(text: Column, options: dict) -> Column:
    return hits(matches(text, INVISIBLE), lambda m: say("invisible", code_point(m["value"])))


def no_exclamation_question_mark(text: Column, options: dict) -> Column:
    marks = {"halfwidth_exclamation": "!", "fullwidth_exclamation": "！", "halfwidth_question": "?", "fullwidth_question": "？"}
    barred = "".join(c for name, c in marks.items() if not flag(options, f"allow_{name}", False))
    return hits(matches(text, char_class(barred)), lambda m: say("exclamation", m["value"])) if barred else no_hits()


def no_todo(text: Column, options: dict) -> Column:
    """Each pattern is searched on its own; an ignored pattern counts inside the matched text only."""
    given = strings(options, "patterns")
    patterns = [p for p in given if p] if given else []
    patterns = patterns or MARKERS
    ignored = [p for p in strings(options, "ignore_patterns") or [] if p]
    case = "" if flag(options, "case_sensitive", False) else "(?iu)"
    skip = F.lit("|".join(case + quote(p) for p in ignored))
    table = F.array(*(F.struct(F.lit(case + quote(p)).alias("pattern"), F.lit(MESSAGES["marker"] % p.rstrip()).alias("message")) for p in patterns))

    def one(p: Column) -> Column:
        found = matches(text, p["pattern"])
        return hits(F.filter(found, lambda m: ~F.rlike(m["value"], skip)) if ignored else found, p["message"])

    any_marker = F.lit(starting(patterns, bool(case)))
    return F.when(F.rlike(text, any_marker), F.flatten(F.transform(table, one))).otherwise(no_hits())


def no_invalid_control_character(text: Column, options: dict) -> Column:
    return hits(matches(text, CONTROL), lambda m: say("control", code_point(m["value"])))


def no_unmatched_pair(text: Column, options: dict) -> Column:
    """Openers left open at the node's end, by type; with detectOrphanedClosers also closers whose type is not open."""
    orphans = flag(options, "detectOrphanedClosers", False)
    mark = "struct<start:int,end:int,value:string>"
    fields = ("opener", "closer", "name", "reportable")
    table = F.array(*(F.struct(*(F.lit(x).alias(f) for x, f in zip(pair, fields))) for pair in PAIRS))

    def one(found: Column, p: Column) -> Column:
        own = F.filter(found, lambda m: (m["value"] == p["opener"]) | (m["value"] == p["closer"]))

        def opened(at: Column, m: Column) -> Column:
            toggled = F.when(at.isNull(), m["start"])
            return F.when(p["opener"] == p["closer"], toggled).otherwise(F.when(m["value"] == p["opener"], F.coalesce(at, m["start"])))

        def lost(acc: Column, m: Column) -> Column:
            alone = (m["value"] != p["opener"]) & ~acc["open"]
            return F.struct((m["value"] == p["opener"]).alias("open"), F.when(alone, F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"))

        left = F.array(F.aggregate(own, F.lit(None).cast("int"), opened))
        still = F.transform(F.filter(left, lambda at: at.isNotNull()), lambda at: F.struct(at.alias("start"), (at + F.octet_length(p["opener"])).alias("end"), p["opener"].alias("value")))
        out = hits(still, say("open", p["opener"], p["name"]))
        if not orphans:
            return out
        state = F.struct(F.lit(False).alias("open"), F.array().cast(f"array<{mark}>").alias("out"))
        closers = hits(F.aggregate(own, state, lost, lambda acc: acc["out"]), lambda m: say("close", m["value"], p["name"]))
        return F.when(p["reportable"], F.concat(out, closers)).otherwise(out)

    any_mark = char_class("".join(dict.fromkeys(a + b for a, b, _, _ in PAIRS)))
    each = bound(matches(text, any_mark), lambda found: F.flatten(F.transform(table, lambda p: one(found, p))))
    return F.when(F.rlike(text, F.lit(any_mark)), each).otherwise(no_hits())


def ja_unnatural_alphabet(text: Column, options: dict) -> Column:
    """A lone small consonant between Japanese characters, but for names of languages and axes."""
    near = wider("[々〇〻\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}ぁ-んァ-ヶー。、・−\\x{FF00}-\\x{FFEF}]")
    lone = f"(?<={near})(?:[b-df-hj-mp-tv-wｂ-ｄｆ-ｈｊ-ｍｐ-ｔｖ-ｗ](?={near})(?!言)|[x-zｘ-ｚ](?={near})(?![言座軸]))"
    return hits(matches(text, lone), lambda m: say("letter", m["value"]))


def arabic_kanji_numbers(text: Column, options: dict) -> Column:
    k, few = char_class(NUMERALS), "[三四五六七八九十壱弐参拾百〇]"
    things = f"(?<!{k})(?:(?<!ただ)(?<!唯)(?<!女手)(?<!男手)(?<!穴)(?<!瓜)(?<!馬鹿の)[一二]|{few}|{k}{{2,}})つ(?!返事|子|ひとつ|[星編葉橋]|と[無な]い|に一つ)"
    to_arabic = f"(?={char_class('第' + NUMERALS)})(?:第{k}+[章節]|(?<![数何]){k}+[兆億万]|{things}|{k}+(?:回|か月|番目|進法|次元))"
    to_kanji = "(?=[世第数0-9])(?:世界1|第3者|数10+[倍兆億万年]|1時的|1部分|1部の|1番に|(?<![0-9])1種(?!類)|5大陸|[0-9]+次関数)"
    return F.concat(hits(matches(text, to_arabic), lambda m: say("to_arabic", m["value"])), hits(matches(text, to_kanji), lambda m: say("to_kanji", m["value"])))


def ja_no_weak_phrase(text: Column, options: dict) -> Column:
    longest = sorted(WEAK, key=len, reverse=True)
    return hits(matches(text, starting(longest)), lambda m: F.when(m["value"] == WEAK[-1], say("weak_double")).otherwise(say("weak", m["value"])))


def ja_no_abusage(text: Column, options: dict) -> Column:
    """Each entry is searched on its own, but only those that occur in the text."""
    entries = [(wrong, MESSAGES["misused"] % (wrong, right, right)) for wrong, right in MISUSED.items()] + list(MISUSED_OTHER.items())
    table = F.array(*(F.struct(F.lit(w).alias("wrong"), F.lit(m).alias("message")) for w, m in entries))
    there = F.filter(table, lambda e: F.contains(text, e["wrong"]))
    each = F.transform(there, lambda e: hits(matches(text, F.concat(F.lit("\\Q"), e["wrong"], F.lit("\\E"))), e["message"]))
    return F.when(F.rlike(text, F.lit(starting([w for w, _ in entries]))), F.flatten(each)).otherwise(no_hits())


def _expand(template: str, match) -> str:
    """$N, ${N} and $$; any other $ stands for itself, a group that took no part for nothing."""
    import re

    def one(m) -> str:
        if m[0] == "$$":
            return "$"
        n = int(m[1] or m[2])
        return (match[n] or "") if n <= match.re.groups else ""

    return re.sub(r"\$\$|\$\{([0-9]+)\}|\$([0-9]+)", one, template)


def _regex_terms(text: Column, given: list[tuple[str, str]]) -> Column:
    """Hits of (pattern, template) pairs; templates with groups are beyond Spark's replacement, so Arrow batches go to Python."""
    schema = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("message", T.StringType()), T.StructField("fixes", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())])))]))
    saying = MESSAGES["term"]

    @F.pandas_udf(schema)
    def search(texts: pd.Series) -> pd.Series:
        import re

        compiled = [(re.compile(p, re.ASCII), t) for p, t in given]

        def one(s):
            out = []
            for pattern, template in compiled:
                last = b = 0  # the end of the last match, in characters and in bytes
                for m in pattern.finditer(s or ""):
                    a = b + len(s[last : m.start()].encode())
                    last, b = m.end(), a + len(m[0].encode())
                    new = _expand(template, m)
                    if m[0] and new != m[0]:
                        out.append({"start": a, "end": b, "message": saying % (m[0], new), "fixes": [{"start": a, "end": b, "replacement": new}]})
            return out

        return texts.map(one)

    return search(text)


def compiled_terms(options: dict) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(literal, expected) and (regex, template) pairs; entries of the wrong shape and invalid patterns are left out."""
    import re

    literal, regex = [], []
    for term in options.get("terms") if isinstance(options.get("terms"), list) else []:
        expected = term.get("expected") if isinstance(term, dict) else None
        if not isinstance(expected, str):
            continue
        single = [term["pattern"]] if isinstance(term.get("pattern"), str) else []
        literal += [(p, expected) for p in [*single, *(strings(term, "patterns") or [])] if p and p != expected]
        for item in term.get("regexPatterns") if isinstance(term.get("regexPatterns"), list) else []:
            source = item.get("source") if isinstance(item, dict) else None
            if not isinstance(source, str) or not source or re.search(r"\(\?<?[=!]|\\[1-9]|\\p\{", source):
                continue
            flags = ("i" if flag(item, "ignoreCase", False) else "") + ("m" if flag(item, "multiline", False) else "")
            try:
                re.compile(pattern := f"(?{flags}){source}" if flags else source, re.ASCII)
            except re.error:
                continue
            regex.append((pattern, expected))
    return literal, regex


#: So many literal terms are searched one by one as expressions; more go through an automaton (``terms_beside``).
FEW = 4


def ja_prh(text: Column, options: dict) -> Column:
    """Terms to be spelled one way; the only rule with fixes."""

    def one(pattern: str, expected: str) -> Column:
        found = matches(text, quote(pattern))
        if expected.startswith(pattern):
            wanted = F.lit(expected.encode())
            found = bound(F.struct(F.encode(text, "UTF-8").alias("raw"), found.alias("found")), lambda both: F.filter(both["found"], lambda m: F.substring(both["raw"], m["start"] + 1, F.octet_length(wanted)) != wanted))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), say("term", pattern, expected).alias("message"), F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(expected).alias("replacement"))).cast(f"array<{FIX}>").alias("fixes")))

    given = compiled_terms(options)[0]
    return F.concat(no_hits(), *(one(*term) for term in (given if len(given) <= FEW else [])))


def terms_beside(text: Column, options: dict) -> list[Column]:
    """Hits of terms that need Python: many literal ones, by an automaton, and regex terms."""
    literal, regex = compiled_terms(options)
    many = [terms.hits(text, literal, lambda pattern, expected: MESSAGES["term"] % (pattern, expected))] if len(literal) > FEW else []
    return many + ([_regex_terms(text, regex)] if regex else [])


# Document rules: whether a slice can have a hit at all, candidates of a node, and the decision over the document's candidates.


def alphabet_possible(text: Column) -> Column:
    return F.rlike(text, F.lit(LATIN_FULL)) & F.rlike(text, F.lit(LATIN_HALF))


def period_possible(text: Column) -> Column:
    return (F.instr(text, "。") > 0) & (F.instr(text, ".") > 0)


def alphabet_candidates(text: Column, options: dict) -> Column:
    return matches(text, f"{LATIN_HALF}|{LATIN_FULL}")


def alphabet_decision(found: Column, options: dict) -> Column:
    """Letters of the rarer width; when there are as many of both, the full-width ones."""
    half = F.filter(found, lambda m: F.octet_length(m["value"]) == 1)

    def decide(half: Column) -> Column:
        n, m = F.size(half), F.size(found) - F.size(half)
        full = F.filter(found, lambda m: F.octet_length(m["value"]) > 1)
        return F.when((n == 0) | (m == 0), no_hits()).when(m <= n, hits(full, say("alphabet", "半角英字"))).otherwise(hits(half, say("alphabet", "全角英字")))

    return bound(half, decide)


def period_candidates(text: Column, options: dict) -> Column:
    return matches(text, r"。|\.(?=(?U:\s)|\z)")


def period_decision(found: Column, options: dict) -> Column:
    """Stops of the rarer kind; when there are as many of both, the ASCII ones."""
    wide = F.filter(found, lambda m: m["value"] == "。")

    def decide(wide: Column) -> Column:
        n, m = F.size(wide), F.size(found) - F.size(wide)
        narrow = F.filter(found, lambda m: m["value"] == ".")
        return F.when((n == 0) | (m == 0), no_hits()).when(n < m, hits(wide, say("period", ".", "。"))).otherwise(hits(narrow, say("period", "。", ".")))

    return bound(wide, decide)
