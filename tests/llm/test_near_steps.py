"""What the steps of the near-duplicate stage do, apart from its result."""

import random

from inkspect.llm import near_copies, simhash


def light_edits():
    """Pairs of texts that differ in their last word, and how many bits their fingerprints differ in."""
    own = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{own.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    return texts, [bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(prints[::2], prints[1::2])]


def test_simhash_links_what_it_reaches_without_segments(spark):
    texts, bits = light_edits()
    assert sum(b <= near_copies.BITS for b in bits) > 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, _ = near_copies._named(docs, 5, cut=lambda sets: [[] for _ in sets])
    roots = {x.doc_id: x.component_id for x in found.collect()}
    assert all(roots[2 * i] == 2 * i and roots[2 * i + 1] == 2 * i + (b > near_copies.BITS) for i, b in enumerate(bits))


def test_what_simhash_links_is_confirmed_and_not_compared_again(spark, monkeypatch):
    texts, bits = light_edits()
    tables, write = {}, near_copies.materialise

    def watched(df, name, *more):
        out = write(df, name, *more)
        tables[name] = tables.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "materialise", watched)
    far = ["one two three", "one two four"]  # less than 0.8 alike, whatever their fingerprints are
    docs = spark.createDataFrame(list(enumerate(texts + far)), "doc_id long, text string")
    roots = {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()}
    assert roots == {i: i // 2 * 2 if i < len(texts) else i for i in range(len(texts) + 2)}
    assert tables["near-printed-links"] == sum(b <= near_copies.BITS for b in bits)
    assert tables["near-compared"] == sum(b > near_copies.BITS for b in bits)


def test_keys_are_dealt_in_shares_and_ranks_need_no_further_join(spark, monkeypatch):
    own = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(own.randrange(8)):
            words[own.randrange(len(words))] = own.choice(["x", "y", "z"])
        texts.append(" ".join(words))
    plans, write = [], near_copies.materialise

    def watched(df, name, *more):
        plans.append((name, df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")))
        return write(df, name, *more)

    monkeypatch.setattr(near_copies, "materialise", watched)
    near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert sum(name == "segments-held" for name, _ in plans) == 4
    entries = next(plan for name, plan in plans if name == "near-entries")
    assert entries.index("Window") < entries.index("Join")


def test_sets_meet_without_the_leaders_that_they_share_little_with(spark):
    """Node 9 shares five segments with leader 1 and one each with leaders 2 and 3; a similar set shares three with it or more."""
    own = lambda node: node << near_copies.TAG_BITS
    held = {1: range(5), 2: [5], 3: [6], 4: range(5), 9: range(7)}
    rows = [(key, own(node), 3 if node == 9 else 1, node) for node, keys in held.items() for key in keys]
    met = spark.createDataFrame(rows, "key long, owner long, need int, node long")
    scores = spark.createDataFrame([(node, 100, node - 100) for node in held], "node long, n int, score long")
    assert sorted(tuple(x) for x in near_copies._groups(met, scores).collect()) == [(1, 4), (1, 9)]


def test_usual_differences_are_not_looked_up_and_lose_no_link(spark, monkeypatch):
    """A leader's sets all lack the same shingles; only what few of them have is looked up, and what is similar is found."""
    usual, write, tables = list(range(1000, 1060)), near_copies.materialise, {}
    monkeypatch.setattr(near_copies, "materialise", lambda df, name, *more: tables.setdefault(name, write(df, name, *more)))
    rows = []
    for i in range(12):  # two of each are alike
        of = [*range(100 * (i // 2), 100 * (i // 2) + 30), 10**6 + i]
        rows.append((1, 10 + i, 131, False, [*usual, *of]))
    compared = spark.createDataFrame(rows, "u long, v long, n int, similar boolean, diff array<long>")
    found, _ = near_copies._rest(compared, spark.createDataFrame([], "node long, root long"), near_copies.FOUR_FIFTHS)
    assert sorted(tuple(sorted((x.u, x.v))) for x in found.collect()) == [(10 + i, 11 + i) for i in range(0, 12, 2)]
    held = tables["near-held"]
    assert held.where("usual").count() == 60 and held.where("NOT usual").count() == 180
