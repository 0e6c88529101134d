"""Rules on tokens, as window functions.

Tokens are rows as in TOKENS; offsets are bytes of the slice, ``base`` is the slice's
place in its document.  ``written`` is a token's text in the source and ``gap`` the
text between the token before (or the block's start) and this one, so together they
hold a block's text once.

Rows are dealt by slice once, and sorted by place once; what rules need of the tokens
around a token, of its sentence and of its block are running sums and neighbours over
that one order.  A token that ends nothing and begins nothing is dropped then; what
follows (runs of particles and their repeats) sorts the few rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIX, char_class, each_of
from .surface import flag, strings, whole

TOKENS = (
    "doc_id long, slice_id long, node_id int, base int, gap string, written string, start int, end int, surface string, lang int, tagset int, "
    "is_unknown boolean, reading string, base_form string, pos string, pos1 string, pos2 string, pos3 string, ctype string, cform string, pron string"
)
SLICE = ["doc_id", "slice_id"]
BLOCK = ["doc_id", "slice_id", "node_id"]
# Sentence ends, marks and messages that results must have.
TERMINATORS = "。．.！？!?"
COMMAS, BRACKETS = "、，", "()（）「」"
GA = "一文に二回以上利用されている接続助詞「が」がみつかりました。\n\n逆接の「が」を一文に複数置くと係り受けが分かりにくくなります。文を分割するか、二つ目以降の「が」を別の表現に書き換えてください。"
REDUNDANT = "冗長な表現「ことができる」がみつかりました。\n\n「〜できる」と簡潔に書けないか検討してください（例: 泳ぐことができる → 泳げる）。"
DROPPED_RA = "ら抜き言葉がみつかりました。\n\n一段動詞・カ変動詞には「られる」を使ってください（例: 見れる → 見られる、来れる → 来られる）。"
DOUBLE_NEGATIVE = "二重否定がみつかりました。\n\n否定の否定はまわりくどく読みにくいので、肯定の表現に言い換えられないか検討してください（例: できないことはない → できる）。"
STYLE = "文体が混在しています。この文は「%s」体ですが、文書全体では「%s」体に統一してください。"
CONJUNCTION = "同じ接続詞（%s）が連続して使われています。"
SUCCESSIVE = '"%s" が連続して2回使われています。'
DOUBLED = '一文に二回以上利用されている助詞 "%s" がみつかりました。\n\n次の助詞が連続しているため、文を読みにくくしています。\n\n%s\n%s\n\n同じ助詞を連続して利用しない、文の中で順番を入れ替える、文を分割するなどを検討してください。'


HIT = f"struct<rule_id:string,severity:string,start:int,end:int,message:string,fixes:array<{FIX}>>"


def in_block():
    return Window.partitionBy(*BLOCK).orderBy("start", "end")


def before():
    return in_block().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return in_block().rowsBetween(Window.unboundedPreceding, 0)


def known(*conditions: Column) -> Column:
    out = ~F.col("is_unknown")
    for c in conditions:
        out = out & c
    return F.coalesce(out, F.lit(False))


def no(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _numbered(marks: str) -> str:
    """Name of the column that numbers what ``marks`` part."""
    return "part_" + "_".join(f"{ord(c):x}" for c in marks)


class Work:
    """What the active rules add: columns in levels, each over the one before, hits of a row, and conditions to keep it."""

    def __init__(self):
        self.levels: list[dict[str, Column]] = [{}, {}, {}, {}]
        self.hits: list[Column] = []
        self.keep: list[Column] = []

    def add(self, level: int, name: str, value: Column) -> Column:
        self.levels[level].setdefault(name, value)
        return F.col(name)

    def before(self, name: str, places: int = 1) -> Column:
        return self.add(0, f"{name}_{places}_before", F.lag(name, places).over(in_block()))

    def after(self, name: str, places: int = 1) -> Column:
        return self.add(0, f"{name}_{places}_after", F.lead(name, places).over(in_block()))

    def passed(self, marks: str) -> Column:
        """Marks since the token before began."""
        count = lambda c: F.coalesce(F.regexp_count(c, F.lit(char_class(marks))), F.lit(0))
        return count(self.before("written")) + count(F.col("gap"))

    def sentence(self, marks: str) -> Column:
        """Number of the marks before a token in its block."""
        return self.add(1, _numbered(marks), F.sum(self.passed(marks)).over(so_far()))

    def in_sentence_before(self, name: str, is_one: Column) -> Column:
        """How many tokens before this one in its sentence are ``is_one``: those of the block less those before the sentence."""
        sentence = self.sentence(TERMINATORS)
        all_ = self.add(1, f"{name}_before", F.coalesce(F.sum(is_one.cast("int")).over(before()), F.lit(0)))
        first = self.add(2, "is_first", F.coalesce(F.lag(sentence).over(in_block()) != sentence, F.lit(True)))
        return self.add(3, f"{name}_before_in_sentence", all_ - F.max(F.when(first, all_)).over(so_far()))

    def hit(self, rule, test: Column, message: Column, end: Column | None = None) -> None:
        found = F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.col("start").alias("start"), (F.col("end") if end is None else end).alias("end"), message.alias("message"), F.array().cast(f"array<{FIX}>").alias("fixes"))
        self.hits.append(F.when(no(test), F.array(found.cast(HIT))).otherwise(F.array().cast(f"array<{HIT}>")))


def no_doubled_conjunctive_particle_ga(work: Work, rule) -> None:
    ga = known(F.col("pos") == "助詞", F.col("pos1") == "接続助詞", F.col("surface") == "が")
    work.hit(rule, ga & (work.in_sentence_before("ga", ga) >= 1), F.lit(GA))


def ja_no_redundant_expression(work: Work, rule) -> None:
    own = known(F.col("pos") == "名詞", F.col("surface") == "こと")
    ga = work.add(0, "ga_after", F.lead(known(F.col("pos") == "助詞", F.col("pos1") == "格助詞", F.col("surface") == "が")).over(in_block()))
    can = known(((F.col("pos") == "動詞") & (F.col("base_form") == "できる")) | ((F.col("pos") == "名詞") & (F.col("surface") == "可能")))
    work.hit(rule, own & ga & work.add(0, "can_after", F.lead(can, 2).over(in_block())), F.lit(REDUNDANT), work.after("end", 2))


def no_dropping_the_ra(work: Work, rule) -> None:
    verb = known(F.col("pos") == "動詞", F.col("ctype").startswith("一段") | F.col("ctype").startswith("カ変"))
    reru = work.add(0, "reru_after", F.lead(known(F.col("pos").isin("動詞", "助動詞"), F.col("base_form") == "れる")).over(in_block()))
    work.hit(rule, verb & reru, F.lit(DROPPED_RA), work.after("end"))


def no_double_negative_ja(work: Work, rule) -> None:
    """は and a negative after it, where the sentence had a negative before."""
    negative = known(((F.col("pos") == "助動詞") & F.col("base_form").isin("ない", "ぬ", "ず")) | ((F.col("pos") == "形容詞") & (F.col("base_form") == "ない")))
    after = work.add(0, "negative_after", F.lead(negative).over(in_block()))
    work.hit(rule, known(F.col("pos") == "助詞", F.col("surface") == "は") & after & (work.in_sentence_before("negative", negative) >= 1), F.lit(DOUBLE_NEGATIVE), work.after("end"))


def no_doubled_conjunction(work: Work, rule) -> None:
    """A sentence's first conjunction that equals that of the last sentence with one."""
    blank = work.add(0, "blank_before", F.lag(known(F.col("pos1") == "空白")).over(in_block()))
    one = work.add(1, "conjunction", known(F.col("pos") == "接続詞") & ~no(blank))
    sentence = work.sentence(TERMINATORS)
    # the sentence of the conjunction before, and the first conjunction of the sentence before
    last = work.add(2, "conjunction_sentence", F.last(F.when(one, sentence), True).over(before()))
    first = one & (last.isNull() | (last != sentence))
    same = work.add(3, "conjunction_before", F.last(F.when(first, F.col("surface")), True).over(before()))
    work.hit(rule, first & (same == F.col("surface")) & (F.col("surface") != ""), F.format_string(CONJUNCTION, "surface"))


def ja_no_successive_word(work: Work, rule) -> None:
    """A known word right after itself; not numerals, sound words in katakana, or allowed ones."""
    numeral = known(F.col("pos") == "名詞", F.col("pos1") == "数")
    number = work.add(0, "number_before", F.lag(numeral).over(in_block()))
    bad = known(~work.before("is_unknown"), work.before("surface") == F.col("surface")) & ~(no(number) & numeral) & ~F.col("surface").isin(strings(rule.options, "allow") or [])
    if flag(rule.options, "allowOnomatopee", True):
        bad = bad & ~F.col("surface").rlike("^[ァ-ロワヲンー]+$")
    work.hit(rule, bad, F.format_string(SUCCESSIVE, "surface"))


def no_mix_dearu_desumasu(work: Work, rule) -> None:
    """The last decisive token of a sentence gives its style; see ``_mixed_style``."""
    pos, base = F.col("pos"), F.col("base_form")
    decides = (
        F.when(F.col("is_unknown") | pos.isNull(), None)
        .when(pos == "助動詞", F.when(base.isin("です", "ます"), "polite").when(base.isin("だ", "である"), "plain"))
        .when(pos.isin("動詞", "形容詞"), "plain")
        .when(pos.isin("名詞", "代名詞", "形状詞"), "none")
    )
    work.keep.append(work.add(0, "style", decides).isNotNull())
    work.sentence(TERMINATORS)


def _mixed_style(rows: DataFrame, rule) -> DataFrame:
    """Adds hits of the style rule: sentences of the slice's rarer style are reported, plain ones in a tie."""
    backwards = Window.partitionBy(*BLOCK).orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    sentence, style = F.col(_numbered(TERMINATORS)), F.col("style")
    later = F.last(F.when(style.isNotNull(), sentence), True).over(backwards)
    rows = rows.withColumn("later", later).withColumn("style", F.when(F.col("later").isNull() | (F.col("later") != sentence), style)).drop("later")
    rows = rows.withColumn("style", F.when(style != "none", style))
    over = Window.partitionBy(*SLICE)
    plain, polite = F.count_if(style == "plain").over(over), F.count_if(style == "polite").over(over)
    if rule.options.get("prefer") in ("dearu", "desumasu"):
        bad = style == ("polite" if rule.options["prefer"] == "dearu" else "plain")
    else:
        rows = rows.withColumn("rare", F.when((plain > 0) & (polite > 0), F.when(polite >= plain, "plain").otherwise("polite")))
        bad = style == F.col("rare")
    work = Work()
    work.hit(rule, bad, F.when(style == "plain", STYLE % ("である", "ですます")).otherwise(STYLE % ("ですます", "である")))
    return rows.withColumn("found", F.concat("found", *work.hits))


def no_doubled_joshi(work: Work, rule) -> None:
    """A particle (or a run of touching particles) that comes again in its sentence with too few commas and brackets between; see ``_doubled``."""
    options = rule.options
    strict, allow = flag(options, "strict", False), strings(options, "allow") or []
    particle = known(F.col("pos") == "助詞") & ~F.col("surface").isin(allow)
    if not strict:
        particle = particle & ~F.concat_ws("/", "surface", "pos1").isin("の/連体化", "を/格助詞", "て/接続助詞")
    one = work.add(0, "particle", particle)
    touches = work.add(1, "touches", one & no(F.lag(one).over(in_block())) & no(work.before("end") == F.col("start")))
    work.add(2, "run", F.when(one, F.sum((~touches).cast("int")).over(so_far())))
    work.add(1, "at", F.row_number().over(in_block()))
    work.before("surface")
    work.sentence(_letters(options, "separator_characters", TERMINATORS))
    marks = _letters(options, "comma_characters", COMMAS) + BRACKETS
    work.add(1, "marks_before", F.sum(work.passed(marks)).over(so_far()))
    work.add(1, "marks_inside", F.coalesce(F.regexp_count("written", F.lit(char_class(marks))), F.lit(0)))
    work.keep.append(one)


def _letters(options: dict, key: str, default: str) -> str:
    return "".join(x[0] for x in strings(options, key) or [] if x) or default


def _doubled(rows: DataFrame, rule) -> DataFrame:
    """Adds hits of the particle rule; what rows of a block have found and that are no particles becomes one row."""
    options = rule.options
    strict, least = flag(options, "strict", False), whole(options, "min_interval", 1)
    sentence = F.col(_numbered(_letters(options, "separator_characters", TERMINATORS)))
    token = F.struct("at", sentence.alias("sentence"), F.coalesce("surface_1_before", F.lit("")).alias("before"), "pos1", "marks_before", "surface", (F.col("marks_before") + F.col("marks_inside")).alias("marks_after"))
    tokens = F.array_sort(F.collect_list(F.when(F.col("particle"), token)))
    runs = rows.groupBy(*BLOCK, "run").agg(F.first("base").alias("base"), F.flatten(F.collect_list("found")).alias("found"), tokens.alias("tokens"), F.min("start").alias("start"), F.max("end").alias("end"))
    first, last, n = F.get("tokens", F.lit(0)), F.get("tokens", F.size("tokens") - 1), F.size("tokens")
    runs = runs.select(*BLOCK, "base", "found", "start", "end", first.alias("first"), n.alias("n"), last["marks_after"].alias("marks_after"), F.array_join(F.transform("tokens", lambda t: t["surface"]), "").alias("surface"))
    runs = runs.select(*BLOCK, "base", "found", "first.sentence", "first.at", "first.before", "first.pos1", "first.marks_before", "start", "end", "n", "marks_after", "surface")
    key = F.when(F.col("n") > 1, F.concat("surface", F.lit(":連語"))).when(F.col("n") == 1, F.concat_ws(".", F.concat("surface", F.lit(":助詞")), "pos1"))
    line = F.when(F.col("before") == "", F.format_string('- "%s"', "surface")).otherwise(F.format_string('- %s"%s"', "before", "surface"))
    runs = runs.withColumn("key", key).withColumn("line", line)
    group = Window.partitionBy(*BLOCK, "sentence", "key")
    earlier = F.lag(F.struct("end", "at", "surface", "line", "marks_after")).over(group.orderBy("start", "end"))
    parallel = F.bool_and(no((F.col("n") == 1) & (F.col("pos1") == "並立助詞"))).over(group)
    runs = runs.withColumn("last", earlier).withColumn("parallel", parallel)
    between = F.when(F.col("start") <= F.col("last.end"), 0).otherwise(F.col("marks_before") - F.col("last.marks_after"))
    bad = F.col("key").isNotNull() & F.col("last").isNotNull() & (between < least)
    if not strict:
        bad = bad & ~F.col("parallel") & ~no((F.col("last.surface") == "か") & (F.col("surface") == "か") & (F.col("at") == F.col("last.at") + 2) & (F.col("before") == "どう"))
    work = Work()
    work.hit(rule, bad, F.format_string(DOUBLED, "surface", "last.line", "line"))
    return runs.withColumn("found", F.concat("found", *work.hits))


def token_hits(tokens: DataFrame, rules: list, run: dict, dealt: bool = False) -> DataFrame:
    """(doc_id, slice_id, base, rule_id, severity, start, end, message, fixes) of token rules; ``run`` has each rule's function by id.

    dealt: tokens were made of documents dealt by doc_id, so each slice is in one task
    already, and tokens, which take many times the room of their text, stay where they are.
    """
    work = Work()
    for rule in rules:
        run[rule.id](work, rule)
    style, joshi = ([r for r in rules if r.id == id] for id in ("no-mix-dearu-desumasu", "no-doubled-joshi"))
    names = dict.fromkeys([*BLOCK, "base", "gap", "written", "start", "end", "surface", "is_unknown", "base_form", "pos", "pos1", "ctype"])
    rows = tokens.select(*names)
    rows = rows if dealt else rows.repartition(*SLICE)
    for level in work.levels:
        if level:
            rows = rows.select("*", *(value.alias(name) for name, value in level.items()))
    none = F.array().cast(f"array<{HIT}>")
    rows = rows.withColumn("found", F.concat(none, *work.hits))
    keep = F.size("found") > 0
    for condition in work.keep:
        keep = keep | no(condition)
    rows = rows.where(keep)
    for rule in style:
        rows = _mixed_style(rows, rule)
    for rule in joshi:
        rows = _doubled(rows, rule)
    return each_of(rows, [*SLICE, "base"], F.col("found"))
