"""Each operator against a brute-force version on a table with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from inkspect.llm import bpe, exact_dedup, langid, line_dedup, media, packing, quality, simhash, substring_dedup, suffix_dedup, tokenise, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, n int, key string, rest int"
r = random.Random(5)
WORDS = ["tion", "Alpha", "beta", "gämma", "δέλτα", "of", "the", "x1", "<|endoftext|>", "don't", "日本語"]
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def words(n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


def rows():
    base = words(120)
    texts = [None, "", "", " \t\n", base, base, base.replace("tion", "TION", 1), base + " end", words(5000), "a" * 6000, "a" * 500]
    texts += [words(40) + " " + PASSAGE + " " + words(40) for _ in range(5)]
    texts += ["\n".join([words(8), "  A Common Line of the Corpus ", "short", words(8)]) for _ in range(6)]
    texts += ["a common line of the corpus", "  spaced   out\r\n\ttext　", base.replace(" ", "\n"), "\x00\x1c ", "é" * 200, "\n\n"]
    out = [(i, t, "en" if i % 2 else "fr", "s", None, 1, 2, "k", 3) for i, t in enumerate(texts)]
    return [*out, out[4], (None, "null id " + PASSAGE, None, None, None, 1, 2, "k", 3)]


ROWS = rows()
TEXTS = {(x[0], x[1]): x[1] or "" for x in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def path():
    return tokenise.vocabulary_path()


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path())


def test_codec_equals_the_library():
    own, other = bpe.codec(path()), library()
    pieces = ["a", " ", "  ", "\n", "\t", "é", "'s", "1", "<|endoftext|>", "<|", "😀", "　", "\x1c", "\x85", "the", "\r\n", "###", "²", "_", "日本"]
    for text in [t for t in TEXTS.values()] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 15))) for _ in range(3000)]:
        expected = other.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == expected
        assert own.decode(own.encode(text)) == other.decode(expected, skip_special_tokens=False)


def test_cuts_are_certain():
    own = bpe.codec(path())
    data = "Zürich—x²_^[tion]".encode()
    assert b"".join(own.fragments(data)) == data
    for a, b in zip(own.fragments(data), own.fragments(data)[1:]):
        assert all(a[-1:] + b[:1] not in token for token in own.tokens)


def test_encode_and_decode(docs, empty):
    encoded = tokenise.encode_documents(docs, path())
    assert sorted(str(x.doc_id) + x.text for x in tokenise.decode_documents(encoded, path()).collect()) == sorted(str(x[0]) + (x[1] or "") for x in ROWS)
    digest = tokenise.round_trip_digests(docs, path()).collect()
    assert len(digest) == len(ROWS) and all(x.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in TEXTS.values()} for x in digest)
    assert tokenise.round_trip_digests(empty, path()).count() == 0


def test_packing(docs, empty):
    other = library()
    out = packing.pack(docs, path(), length=64).collect()
    ids = {k: [*other.encode(t, add_special_tokens=False).ids, 0] for k, t in TEXTS.items()}
    total = sum(len(ids[(x[0], x[1])]) for x in ROWS)
    spots = sorted((x.sequence_id, x.offset, x.length) for x in out)
    assert [s * 64 + o for s, o, _ in spots] == list(np.cumsum([0, *(n for *_, n in spots)])[:-1]) and sum(n for *_, n in spots) == total
    assert all(x.offset + x.length <= 64 for x in out)
    for x in out:
        assert any(k[0] == x.doc_id and x.doc_tokens == len(v) and v[x.start : x.start + x.length] == x.ids for k, v in ids.items())
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    assert packing.pack(empty, path()).count() == 0


def test_language(spark, docs, empty):
    learn = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("den katt och hund", "sv")] * 3)], "doc_id long, text string, lang string")
    model = langid.fit(learn, langid.F.lit(True))
    assert model.predict("the dog")[0] == "en" and model.predict("chatte")[0] == "fr" and model.predict("12 ??") == ("und", 0.0)
    assert model.predict("ab") == model.predict("AB") and 0 <= model.predict("ж")[1] <= 1
    out = langid.predict(docs, model).collect()
    assert len(out) == len(ROWS) and all((x.lang_pred == "und") == (x.score == 0) for x in out)
    assert sum(x.lang_pred == "und" for x in out) == sum(not langid.words(x[1] or "") for x in ROWS)
    assert langid.predict(empty, model).count() == 0 and langid.fit(empty, langid.F.lit(True)).langs == []
    kept = langid.keep_known(docs, model, 0.0)
    assert kept.schema == docs.schema and kept.count() == sum(bool(langid.words(x[1] or "")) for x in ROWS)


def test_letters():
    import unicodedata

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(bool(langid.words(c)) == unicodedata.category(c.lower()[0]).startswith("L") for c in chars)
    assert langid.words("² ½ Ⅷ 3_") == {} and langid.words("a½B a_b 日本") == {"a": 2, "b": 2, "日本": 1}
    model = langid.build([("en", "the", 3)])
    assert model.predict("² ½") == ("und", 0.0)


def scored_by_hand(counts, text):
    """Language by the definition: every word on its own, in plain loops."""
    import math
    import unicodedata

    langs = sorted({lang for lang, _, _ in counts})
    known, grams = {}, {}
    for lang, word, n in counts:
        known.setdefault(word, {}).setdefault(lang, 0)
        known[word][lang] += n
        marked = f"_{word}_"
        for size in (1, 2, 3, 4):
            for i in range(len(marked) - size + 1):
                own = grams.setdefault(size, {}).setdefault(marked[i : i + size], {})
                own[lang] = own.get(lang, 0) + math.sqrt(n)

    def log(table, key, lang):
        total = sum(x.get(lang, 0) for x in table.values()) + 0.5 * len(table)
        return round(math.log((table[key].get(lang, 0) + 0.5) / total), 4)

    def gram(key, lang):
        if key in grams[len(key)]:
            return log(grams[len(key)], key, lang)
        return (gram(key[:-1], lang) + gram(key[1:], lang)) / 2 if len(key) > 1 else 0.0

    def word(w, lang):
        if w in known:
            return log(known, w, lang)
        marked = f"_{w}_"
        size = min(4, len(marked))
        parts = [gram(marked[i : i + size], lang) for i in range(len(marked) - size + 1)]
        return sum(parts) / len(parts)

    found = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split()
    if not found:
        return "und", 0.0
    total = [sum(word(w, lang) for w in found) * min(1, 20 / len(found)) for lang in langs]
    share = [math.exp(x - max(total)) for x in total]
    return langs[share.index(max(share))], max(share) / sum(share)


def test_language_equals_plain_scoring():
    own = random.Random(3)
    counts = [(lang, "".join(own.choice("abcdeé") for _ in range(own.randint(1, 5))), own.randint(1, 9)) for lang in ("de", "en", "fr") for _ in range(40)]
    model = langid.build(counts)
    for _ in range(200):
        text = " ".join("".join(own.choice("abcdeéXß½1") for _ in range(own.randint(1, 6))) for _ in range(own.randint(0, 30)))
        lang, score = scored_by_hand(counts, text)
        found = model.predict(text)
        assert found[0] == lang and abs(found[1] - score) < 1e-9


def test_language_of_many_texts_at_once(monkeypatch):
    own = random.Random(5)
    draw = lambda: "".join(own.choice("abcdeéX½1") for _ in range(own.randint(1, 6)))
    model = langid.build([(lang, draw().lower(), own.randint(1, 9)) for lang in ("de", "en", "fr") for _ in range(40)])
    texts = ["", "1 2", "ab" * 60, *(" ".join(draw() for _ in range(own.randint(0, 30))) for _ in range(300))]
    alone = [model.for_a_task().predict(t) for t in texts]
    monkeypatch.setattr(langid, "MEMO_SCORES", 400)  # memos of a hundred, given up again and again
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 7)
    small = model.for_a_task()
    found = [x for i in range(0, len(texts), 50) for x in small.predict_all(texts[i : i + 50])]
    assert [x[0] for x in found] == [x[0] for x in alone] and max(abs(a[1] - b[1]) for a, b in zip(found, alone)) < 1e-9
    assert "ab" * 60 not in small.known.place and small.predict_all([]) == []


def test_every_language_is_learned(spark):
    rows = [(i, "common words of a hot language " + str(i) + " " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20)), "hot") for i in range(300)] + [(1000, "zzyzx qwfp arst", "rare"), (1001, "...", "none"), (None, "common", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.F.lit(True), sample_docs=90)
    assert model.langs == ["hot", "rare"] and model.predict("zzyzx")[0] == "rare"
    learned = {w for x in rows if x[2] == "hot" for w in langid.words(x[1])}
    assert len(model.words) >= len(learned) // 2 and (model.words.find(["zzyzx", "qwfp", "common"]) >= 0).all() and model.words.find(["zzyz"])[0] == -1


def substrings_by_hand():
    first, out = {}, {}
    keys = sorted(TEXTS, key=lambda k: k[0] if k[0] is not None else 1 << 62)
    for k in keys:
        b = TEXTS[k].encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k[0])
    for k in keys:
        b = TEXTS[k].encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] != k[0]:
                keep[p : p + 50] = False
        edge = np.diff(np.concatenate([[True], keep]).astype(int))
        out[k] = (len(b), int((~keep).sum()), int((edge == -1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest())
    return out


def test_suffixes(docs, empty):
    expected = sorted(str((k[0], *v)) for k, v in [(x, substrings_by_hand()[x]) for x in [(x[0], x[1]) for x in ROWS]])
    out = suffix_dedup.dedup_suffixes(docs).collect()
    assert sorted(str((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in out) == expected
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    fp = {k: simhash.fingerprint(t, 3) for k, t in TEXTS.items()}
    keys = list(fp)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if bin((fp[a] ^ fp[b]) & (2**64 - 1)).count("1") <= 2:
                root[top(a)] = top(b)
    groups = {}
    for k in keys:
        groups.setdefault(top(k), []).append(k[0])
    names = {k: min((i for i in groups[top(k)] if i is not None), default=None) for k in keys}
    assert sorted(str((x.doc_id, x.fp, x.component_id)) for x in out) == sorted(str((x[0], fp[(x[0], x[1])], names[(x[0], x[1])])) for x in ROWS)
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_by_hand():
    text = "One two three four one two three"
    words_ = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words_[i : i + 3]), seed=42) for i in range(5)]
    assert simhash.fingerprint(text, 3) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 5)
    assert simhash.fingerprint("a b", 3) & (2**64 - 1) == xxhash.xxh64_intdigest("a b", seed=42) and simhash.fingerprint(" \n", 3) == 0


@pytest.mark.parametrize("bucket", [1, 4, 48])
def test_links_in_crowded_buckets(spark, bucket):
    own = random.Random(bucket)
    base = own.getrandbits(64)
    values = {base ^ (1 << own.randrange(64)) ^ (1 << own.randrange(64)) for _ in range(40)} | {own.getrandbits(64) for _ in range(20)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    out = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, bucket).distinct().collect()
    expected = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {(x.u, x.v) for x in out} == expected


def test_quality(spark, docs, empty):
    good, bad = [(i, words(60)) for i in range(40)], [(i + 40, "!! ".join(["BUY", "NOW"] * 40)) for i in range(40)]
    learn = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(learn, labels, quality.F.lit(True))
    scores = {x.doc_id: x.score for x in quality.score(learn, model).collect()}
    assert np.mean([(scores[i] >= 0.7) == (i < 40) for i in range(80)]) > 0.95
    out = quality.score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= x.score <= 1 for x in out)
    assert quality.score(empty, quality.fit(empty, labels.limit(0), quality.F.lit(True))).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model.fresh(6, 4)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, firsts, y = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model.scores(x, firsts)) + (1 - y) * np.log(1 - p))
    for name, g in model.gradients(x, firsts, y).items():
        flat = model.w[name].reshape(-1)
        i = int(np.abs(g).reshape(-1).argmax())
        was, e = flat[i], 1e-5
        flat[i] = was + e
        up = loss()
        flat[i] = was - e
        down = loss()
        flat[i] = was
        assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 1e-6, name


def test_lines(docs, empty):
    blanks = " \t\n\x0b\f\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    held = {}
    for (i, _), t in TEXTS.items():
        for line in t.split("\n"):
            if len(key := lower(line.strip(blanks))) >= 20:
                held.setdefault(key, set()).add(i)
    gone = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 3}
    expected = []
    for x in ROWS:
        lines = (x[1] or "").split("\n")
        kept = [s for s in lines if (k := lower(s.strip(blanks))) not in gone or gone[k] == x[0]]
        expected.append(str((x[0], len(lines), len(lines) - len(kept), "\n".join(kept))))
    out = line_dedup.dedup_lines(docs, batches=3).collect()
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.kept_text)) for x in out) == sorted(expected)
    assert any(x.n_dropped for x in out) and line_dedup.dedup_lines(empty).count() == 0
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.kept_text)) for x in line_dedup.dedup_lines(docs, batches=7, fan_out=3).collect()) == sorted(expected)


def test_runs_stay_sorted(spark):
    """A batch is dealt and sorted, a run that was written is not: neither in an anti-join nor in a compaction."""
    batch = lambda a, b: spark.range(a, b).selectExpr("id % 20 AS h1", "id % 3 AS h2", "id AS doc_id")
    runs = line_dedup.LineRuns(spark, 3, 2, 9)
    runs.add(batch(0, 300))
    runs.add(batch(300, 700))

    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with line_dedup.with_runs(spark, 2):
        anti, merged = planned(runs.fresh(batch(700, 900))), planned(runs._merged(runs.levels[0]))
    assert anti.count("SortMergeJoin") == 2 and anti.count("- Sort [") == 1 and anti.index("SortMergeJoin") < anti.index("HashAggregate")
    assert merged.count("SortMergeJoin") == 1 and "Sort [" not in merged and "Exchange" not in merged
    found = {(r.h1, r.h2): r.keeper for r in runs.repeated().collect()}
    counts = {}
    for i in range(700):
        counts.setdefault((i % 20, i % 3), []).append(i)
    assert found and all(max(counts[k]) >= v for k, v in found.items()) and set(found) == {k for k, v in counts.items() if len(v) >= 3}


def scored_plainly(model, text):
    """Gated attention over a text's passages in plain loops."""
    import math

    w, data = {k: v.astype(float).tolist() for k, v in model.w.items()}, text.encode()
    bags = []
    column = quality.pa.array([text])
    for i in range(max(1, -(-len(data) // 512))):
        part = data[512 * i : 512 * i + 512]
        shares = [math.sqrt(part.count(bytes([b])) / max(1, len(part))) for b in range(256)]
        bags.append(shares + quality.passages(column)[0][i, 256:].tolist())
    dot = lambda row, table: [sum(x * y for x, y in zip(row, c)) for c in zip(*table)]
    hidden, weight = [], []
    for bag in bags:
        x = [(v - m) / s for v, m, s in zip(bag, w["mean"], w["sd"])]
        h = [math.tanh(v + e) for v, e in zip(dot(x, w["E"]), w["e"])]
        gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(dot(h, w["V"]), dot(h, w["U"]))]
        hidden.append(h)
        weight.append(math.exp(sum(g * a for g, a in zip(gate, w["a"]))))
    z = [sum(p / sum(weight) * h[i] for p, h in zip(weight, hidden)) for i in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(v * c for v, c in zip(z, w["c"])) - w["b"][0]))


def test_quality_equals_plain_scoring(spark):
    own = random.Random(8)
    model = quality.Model.fresh(seed=4)
    texts = ["", "a b a b", "é" * 700, *(" ".join(own.choice(["good", "bad", "x", "ein", "1999"]) for _ in range(n)) for n in (10, 200, 900))]
    out = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for x in out:
        assert abs(x.score - scored_plainly(model, texts[x.doc_id])) < 1e-4


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, firsts, y: seen.append((len(x), len(y))) or quality.Model.fresh())
    rows = [(i, "word " * (2000 if i % 7 == 0 else 30)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    quality.fit(docs, labels, quality.F.lit(True), sample_passages=64)
    quality.fit(docs, labels, quality.F.lit(True), sample_docs=50)
    (few, n_few), (many, n_many) = seen
    assert 32 <= few <= 64 and n_few > 5 and 20 < n_many < 100
    assert len(quality.drawn(5, 5000, 100)) == 100 and quality.drawn(5, 9, 100).tolist() == [5, 6, 7, 8]


HELD_OUT = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(HELD_OUT), reason="needs the given tables")
def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{HELD_OUT}/documents.parquet"), spark.read.parquet(f"{HELD_OUT}/labels.parquet")
    lang = langid.op3_language_id(spark, HELD_OUT).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND text IS NOT NULL").collect()
    assert len(lang) > 200 and sum(x.lang == x.lang_pred for x in lang) / len(lang) > 0.97
    scored = quality.op6_quality(spark, HELD_OUT).where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    good, bad = [x.score for x in scored if x.quality], [x.score for x in scored if not x.quality]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.95


def test_exact(docs, empty):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    groups = {}
    for x in ROWS:
        groups.setdefault(norm(x[1]), []).append(x)
    expected = []
    for x in ROWS:
        own = groups[norm(x[1])]
        best = min(own, key=lambda y: (-len(y[1] or ""), y[0] if y[0] is not None else 1 << 62))
        expected.append(str((x[0], best[0], len(own), x[0] == best[0] and len(x[1] or "") == len(best[1] or ""), hashlib.sha256(norm(x[1]).encode()).hexdigest())))
    told = lambda out: sorted(str((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256)) for x in out.collect())
    assert told(exact_dedup.dedup_exact(docs)) == sorted(expected)
    # hot contents: over a sixteenth of the rows in a sample of them all
    rows, hot = exact_dedup.grouped_by_sort(docs, 4, 1_000_000, 1)
    assert hot and rows.where("salt >= 0").select("salt").distinct().count() > 1
    assert told(exact_dedup.dedup_exact(docs, salts=4, least=1)) == sorted(expected)
    assert exact_dedup.dedup_exact(empty).count() == 0
    named = docs.withColumn("doc_id", exact_dedup.F.concat(exact_dedup.F.lit("d"), exact_dedup.F.lpad(docs.doc_id.cast("string"), 3, "0")))
    assert sorted(x.group_size for x in exact_dedup.dedup_exact(named).collect()) == sorted(len(groups[norm(x[1])]) for x in ROWS)


def test_neighbours_find_all_copies_but_those_of_hot_contents(docs):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    groups = {}
    for x in ROWS:
        groups[norm(x[1])] = groups.get(norm(x[1]), 0) + 1
    rows, hot = exact_dedup.grouped_by_sort(docs, 4, 1_000_000, 10**6)
    assert hot == 0
    for chosen in (rows, exact_dedup.grouped_by_sort(docs, 4, 1_000_000, 1)[0]):
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "Exchange rangepartitioning" in plan and "Exchange hashpartitioning" not in plan
    found = {bytes(x.digest): x.n for x in rows.collect()}
    assert found == {hashlib.sha256(k.encode()).digest(): n for k, n in groups.items()}


def chunks_by_hand(data, reach=16):
    gear, n = [int(x) for x in substring_dedup.GEAR], len(data)
    h = [sum(gear[data[p - i]] << i for i in range(min(16, p + 1))) & 0xFFFFFFFF for p in range(n)]
    starts = {0} if n else set()
    for p in range(15 + reach, n - reach - 1):
        if h[p] < min(h[p - reach : p]) and h[p] < min(h[p + 1 : p + reach + 1]):
            q = p + 1
            while data[q] & 0xC0 == 0x80:
                q += 1
            starts.add(q)
    own = sorted(starts | {n})
    out = []
    for a, b in zip(own, own[1:]):
        for p in range(a, b, 1024):
            q = p
            while q > a and q < b and data[q] & 0xC0 == 0x80:
                q += 1
            out.append(q)
    return list(zip(out, [*out[1:], n]))


def test_substrings(docs, empty):
    first, parts = {}, {}
    for k in sorted(TEXTS, key=lambda k: k[0] if k[0] is not None else 1 << 62):
        data = TEXTS[k].encode()
        parts[k] = chunks_by_hand(data)
        for a, b in parts[k]:
            first.setdefault(data[a:b], k[0])
    out = substring_dedup.dedup_substrings(docs, carry=True).collect()
    found = {(x.doc_id, x.n_bytes): x for x in out}
    for k, own in parts.items():
        data, kept, run = TEXTS[k].encode(), b"", []
        for a, b in [*own, (len(data), len(data))]:
            if b > a and first[data[a:b]] != k[0]:
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] < 64:
                kept += data[run[0][0] : run[-1][1]]
            kept, run = kept + data[a:b], []
        x = found[(k[0], len(data))]
        assert (x.n_chunks, x.kept_text) == (len(own), kept.decode()), k
        assert x.rest.key == "k"
    caught = [x for x in out if x.doc_id in (12, 13, 14, 15)]
    assert all(x.n_removed > 0.6 * len(PASSAGE) for x in caught)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_media(docs, empty):
    out = media.stored_and_read(docs).collect()
    assert len(out) == len(ROWS)
    for x in out:
        text = next(t.encode() for k, t in TEXTS.items() if k[0] == x.doc_id and len(t.encode()) == x.n_bytes)
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert x.media_sha256 == hashlib.sha256(media.store(text)).hexdigest()
    stored = media.store_documents(docs)
    pixels = media.read_pixels(stored).collect()
    assert all(p.width == 192 and len(p.argb) == 4 * p.width * p.height for p in pixels)
    assert media.stored_and_read(empty).count() == 0
    broken = media.store_documents(docs).limit(1).selectExpr("doc_id", "substring(media, 1, 25) AS media")
    assert media.read_pixels(broken).first().argb is None
    long = bytes(range(256)) * 13_000
    assert np.concatenate(media.frames(media.store(long))).tobytes()[: len(long)] == long


def test_line_runs_grow_with_the_lines():
    assert line_dedup.layout(0) == (3, 1) and line_dedup.layout(2_500_000) == (3, 2)
    assert line_dedup.layout(300_000_000) == (3, 200) and line_dedup.layout(3_000_000_000) == (12, 750)
    batches, parts = line_dedup.layout(300_000_000_000)
    assert batches == 12 and parts == 75_000 and 300_000_000_000 / parts <= 4_000_000
