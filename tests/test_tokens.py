"""Token rules on token tables made by hand, and the tokenizers."""

from inkspect.operators.registry import RULES
from inkspect.operators.tokens import token_hits
from inkspect.plans.config import Active
from inkspect.plans.linter import lint_slices
from inkspect.sources.plain import plain_slices
from inkspect.sources.tokenizers import Dictionary, analyse, lattice_tokens, whitespace_tokens

SCHEMA = "doc_id long, slice_id long, node_id int, base int, gap string, written string, start int, end int, surface string, is_unknown boolean, base_form string, pos string, pos1 string, ctype string"
GA, NO, YA, WO = ("助詞", "格助詞"), ("助詞", "連体化"), ("助詞", "並立助詞"), ("助詞", "格助詞")
NI, HA, KA = ("助詞", "格助詞"), ("助詞", "係助詞"), ("助詞", "副助詞")
N = ("名詞", "一般")


def table(spark, cases):
    """A row per token of cases (doc_id, [(text, pos, pos1, base_form, ctype, unknown) or str])."""
    rows = []
    for doc, tokens in cases:
        at, gap = 0, ""
        for t in tokens:
            if isinstance(t, str):
                gap += t
                at += len(t.encode())
                continue
            text, pos, pos1, base, ctype, unknown = (*t, *[None] * 5)[:6]
            end = at + len(text.encode())
            rows.append((doc, 0, 1, 100, gap, text, at, end, text, bool(unknown), base or text, pos, pos1, ctype))
            at, gap = end, ""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def run(spark, rule, tokens, options=None):
    rule = Active(rule, options or {}, "warning")
    out = token_hits(table(spark, [(1, tokens)]), [rule], {rule.id: RULES[rule.id].run}).collect()
    assert all(r.base == 100 and r.rule_id == rule.id for r in out)
    return sorted((r.start, r.end) for r in out)


def test_doubled_particle(spark):
    rule = "no-doubled-joshi"
    twice = lambda p, between="": [("犬", *N), p, between, ("猫", *N), p]
    assert run(spark, rule, twice(("が", *GA))) == [(9, 12)]
    assert run(spark, rule, twice(("の", *NO))) == [] and run(spark, rule, twice(("の", *NO)), {"strict": True}) == [(9, 12)]
    assert run(spark, rule, twice(("を", *WO))) == []
    assert run(spark, rule, twice(("が", *GA), "。")) == [] and run(spark, rule, twice(("が", *GA), "・"), {"separator_characters": ["・"]}) == []
    assert run(spark, rule, twice(("が", *GA), "、")) == [] and run(spark, rule, twice(("が", *GA), "、"), {"min_interval": 2}) == [(12, 15)]
    assert run(spark, rule, twice(("が", *GA), "「")) == [] and run(spark, rule, twice(("が", *GA), ";"), {"comma_characters": [";"]}) == []
    assert run(spark, rule, twice(("や", *YA))) == [] and run(spark, rule, twice(("や", *YA)), {"strict": True}) == [(9, 12)]
    assert run(spark, rule, twice(("が", *GA)), {"allow": ["が"]}) == []
    assert run(spark, rule, [("来る", "動詞"), ("か", *KA), ("どう", "副詞"), ("か", *KA)]) == []
    assert run(spark, rule, [("犬", *N), ("が", *GA), ("猫", *N), ("が", "助詞", "接続助詞")]) == []
    assert run(spark, rule, [("山", *N), ("に", *NI), ("は", *HA), ("川", *N), ("に", *NI), ("は", *HA)]) == [(12, 18)]
    assert run(spark, rule, [("山", *N), ("に", *NI), ("は", *HA), ("川", *N), ("に", *NI), "、", ("は", *HA)]) == []
    assert run(spark, rule, [("犬", *N), ("が", *GA), ("猫。", *N), ("が", *GA)]) == []
    assert run(spark, rule, [("犬", *N), ("が", *GA), ("猫", *N), ("が", *GA), ("鳥", *N), ("が", *GA)]) == [(9, 12), (15, 18)]


def test_mixed_style(spark):
    rule = "no-mix-dearu-desumasu"
    polite, plain, noun = ("ます", "助動詞", None, "ます"), ("寝る", "動詞"), ("朝", "名詞")
    assert run(spark, rule, [polite, "。", polite, "。", plain, "。"]) == [(18, 24)]
    assert run(spark, rule, [polite, "。", plain, "。"]) == [(9, 15)]
    assert run(spark, rule, [polite, "。", plain, "。", plain]) == [(0, 6)]
    assert run(spark, rule, [plain, polite, "。", plain, ("た", "助動詞", None, "た"), "。"]) == [(15, 21)]
    assert run(spark, rule, [plain, noun, "。", polite, "。"]) == [] and run(spark, rule, [plain, "。", plain]) == []
    assert run(spark, rule, [polite, "。", plain, "。"], {"prefer": "dearu"}) == [(0, 6)]
    assert run(spark, rule, [polite, "。", ("寝る", "動詞", None, None, None, True), "。"]) == []


def test_other_token_rules(spark):
    ga, nai, dekiru = ("が", "助詞", "接続助詞"), ("ない", "形容詞"), ("できる", "動詞")
    rule = "no-doubled-conjunctive-particle-ga"
    assert run(spark, rule, [("雨だ", *N), ga, ("風だ", *N), ga, "。", ga]) == [(15, 18)]
    assert run(spark, rule, [ga, "！", ga]) == [] and run(spark, rule, [ga, ga, ga]) == [(3, 6), (6, 9)]
    rule = "ja-no-redundant-expression"
    assert run(spark, rule, [("泳ぐ", "動詞"), ("こと", "名詞"), ("が", *GA), dekiru]) == [(6, 24)]
    assert run(spark, rule, [("こと", "名詞"), ("が", *GA), ("可能", "名詞")]) == [(0, 15)] and run(spark, rule, [("こと", "名詞"), ("は", *HA), dekiru]) == []
    rule = "no-dropping-the-ra"
    assert run(spark, rule, [("着", "動詞", None, "着る", "一段"), ("れる", "動詞")]) == [(0, 9)]
    assert run(spark, rule, [("書か", "動詞", None, "書く", "五段"), ("れる", "動詞")]) == []
    rule = "no-double-negative-ja"
    assert run(spark, rule, [nai, ("は", *HA), nai]) == [(6, 15)] and run(spark, rule, [nai, "。", ("は", *HA), nai]) == [] and run(spark, rule, [("は", *HA), nai, nai]) == []
    rule, shikashi = "no-doubled-conjunction", ("だが", "接続詞")
    assert run(spark, rule, [shikashi, "、", ("雨", *N), "。", shikashi, "、", ("風", *N)]) == [(15, 21)]
    assert run(spark, rule, [shikashi, "。", ("また", "接続詞"), "。", shikashi]) == [] and run(spark, rule, [shikashi, shikashi]) == []
    assert run(spark, rule, [shikashi, "。", ("雨", *N), "。", shikashi]) == [(15, 21)]
    assert run(spark, rule, [shikashi, "。", ("　", "記号", "空白"), shikashi]) == []
    rule = "ja-no-successive-word"
    assert run(spark, rule, [("雨", *N), ("雨", *N)]) == [(3, 6)] and run(spark, rule, [("雨", *N), ("雨", *N)], {"allow": ["雨"]}) == []
    assert run(spark, rule, [("ドン", *N), ("ドン", *N)]) == [] and run(spark, rule, [("ドン", *N), ("ドン", *N)], {"allowOnomatopee": False}) == [(6, 12)]
    assert run(spark, rule, [("三", "名詞", "数"), ("三", "名詞", "数")]) == [] and run(spark, rule, [("雨", "名詞", None, None, None, True), ("雨", *N)]) == []


def test_all_token_rules_in_one_exchange(spark):
    every = [r.id for r in RULES.values() if r.scope == "tokens"]
    words = [("犬", *N), ("が", *GA), ("だが", "接続詞"), ("ます", "助動詞", None, "ます"), ("寝る", "動詞", None, "寝る", "一段"), ("れる", "動詞"), ("ない", "形容詞"), ("は", *HA), ("こと", "名詞"), ("できる", "動詞"), "。", "、"]
    import random

    own = random.Random(4)
    cases = [(doc, [own.choice(words) for _ in range(60)]) for doc in range(12)]
    tokens = table(spark, cases).cache()
    rules = [Active(id, {}, "warning") for id in every]
    functions = {id: RULES[id].run for id in every}
    together = token_hits(tokens, rules, functions)
    alone = [tuple(r) for rule in rules for r in token_hits(tokens, [rule], functions).collect()]
    assert sorted(map(str, alone)) == sorted(str(tuple(r)) for r in together.collect()) and len(alone) > 100
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :].count("Exchange hashpartitioning") == 1


def test_tokens_keep_their_place_in_the_document(spark):
    slices = plain_slices(spark.createDataFrame([(1, "雨 雨")], "doc_id long, text string"))
    out = lint_slices(slices, [Active("ja-no-successive-word", {}, "error")], whitespace_tokens(slices)).collect()
    assert [(r.start, r.end, r.severity) for r in out] == [(4, 7, "error")]


ENTRIES = {"すもも": [(1, 1, 100, ["名詞", "一般", "*", "*", "*", "*", "すもも", "スモモ", "スモモ"])], "も": [(2, 2, 50, ["助詞", "係助詞", "*", "*", "*", "*", "も", "モ", "モ"])], "もも": [(1, 1, 100, ["名詞", "一般", "*", "*", "*", "*", "もも", "モモ", "モモ"])], "の": [(2, 2, 50, ["助詞", "連体化"])], "うち": [(1, 1, 100, ["名詞", "非自立"])]}
COSTS = {(1, 1): 200, (2, 2): 500}


def test_lattice(spark):
    own = Dictionary(ENTRIES, COSTS, {}, 3)
    text = "すもももももももものうち"
    words = [text[a:b] for a, b, _, _ in analyse(text, own)]
    assert words == ["すもも", "も", "もも", "も", "もも", "の", "うち"]
    slices = plain_slices(spark.createDataFrame([(1, "もも と すもも"), (2, None)], "doc_id long, text string"))
    rows = lattice_tokens(slices, own).orderBy("start").collect()
    assert [(r.gap, r.written) for r in rows] == [("", "もも"), (" ", "と"), (" ", "すもも")]
    assert [(r.surface, r.start, r.end, r.is_unknown, r.pos) for r in rows] == [("もも", 0, 6, False, "名詞"), ("と", 7, 10, True, None), ("すもも", 11, 20, False, "名詞")]


def test_whitespace(spark):
    slices = plain_slices(spark.createDataFrame([(1, "あ　bc d")], "doc_id long, text string"))
    assert [r.gap for r in whitespace_tokens(slices).orderBy("start").collect()] == ["", "　", " "]
    assert [(r.surface, r.start) for r in whitespace_tokens(slices).orderBy("start").collect()] == [("あ", 0), ("bc", 6), ("d", 9)]
