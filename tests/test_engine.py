"""Sources, positions, fixes, configuration, cache and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspect import app
from inkspect.functions.text import positions
from inkspect.operators.fixes import apply_fixes, fix, fixed
from inkspect.operators.registry import RULES
from inkspect.plans import cache, render
from inkspect.plans.config import Config, ConfigError, Setting, active, discover, from_dict, init, load, parse
from inkspect.plans.linter import lint, lint_slices
from inkspect.plans.store import table
from inkspect.sources import files, terminology
from inkspect.sources.delimited import delimited_slices, scan
from inkspect.sources.markdown import markdown_slices, nesting
from inkspect.sources.markdown import parse as markdown
from inkspect.sources.plain import KINDS, plain_slices

FIX = "array<struct<start:int,end:int,replacement:string>>"


@pytest.mark.parametrize(
    ("source", "fixes", "out", "applied", "deferred"),
    [
        ("abcdefgh", [(6, 8, "YZ!"), (2, 3, "")], "abdefYZ!", 2, 0),
        ("abcdefgh", [(2, 4, "-"), (2, 6, "+"), (5, 7, "*")], "ab+gh", 1, 2),
        ("kg", [(2, 1, "z"), (0, 40, "z"), (1, 2, "m")], "km", 1, 2),
        ("pq", [(2, 2, "2"), (0, 0, "0"), (2, 2, "1")], "0pq12", 3, 0),
        ("é日", [(1, 2, "x"), (2, 4, "x"), (2, 5, "本")], "é本", 1, 2),
        ("", [], "", 0, 0),
    ],
)
def test_fixes(spark, source, fixes, out, applied, deferred):
    df = spark.createDataFrame([(source, fixes)], f"text string, fixes {FIX}")
    r = df.select(fixed(F.col("text"), F.col("fixes")).alias("r")).first().r
    assert (r.text, r.applied, r.deferred) == (out, applied, deferred)


def test_fixpoint(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "doc_id long, text string")

    def grow(rows):
        at = F.octet_length("text")
        fixes = F.array(F.struct(at.alias("start"), at.alias("end"), F.lit("!").alias("replacement"))).cast(FIX)
        return rows.where("text LIKE 'a%'").select("doc_id", fixes.alias("fixes"))

    assert {r.doc_id: r.text for r in fix(docs, grow, table).collect()} == {1: "a" + "!" * 10, 2: "b", None: ""}
    assert apply_fixes(docs, grow(docs)).count() == 3


def test_positions():
    text = "zé\n𝄞x\n\n日本"
    raw = text.encode()
    for offset in range(len(raw) + 3):
        before = raw[:offset].decode("utf-8", "ignore") if offset <= len(raw) else text
        last = before.rpartition("\n")[2]
        expected = (before.count("\n") + 1, len(last) + 1, len(last.encode("utf-16-be")) // 2 + 1)
        assert tuple(positions(raw, np.array([offset]))[:, 0]) == expected
    assert positions(b"", np.array([0, 5])).tolist() == [[1, 1], [1, 1], [1, 1]]


@pytest.mark.parametrize(
    ("data", "cells"),
    [
        (b"no,yes\r\n12", [(0, 0, 0, 2), (0, 1, 3, 6), (1, 0, 8, 10)]),
        (b"k\n\nl\n", [(0, 0, 0, 1), (1, 0, 2, 2), (2, 0, 3, 4)]),
        (b'u,"v""w\r\nx",', [(0, 0, 0, 1), (0, 1, 3, 10), (0, 2, 12, 12)]),
        (b'\xef\xbb\xbf"m"', [(0, 0, 4, 5)]),
        (b"", []),
        (b'n,"open, end', [(0, 0, 0, 1), (0, 1, 3, 12)]),
        (b"r\rs,t", [(0, 0, 0, 1), (1, 0, 2, 3), (1, 1, 4, 5)]),
        (b'"go"ne,"on"', [(0, 0, 1, 3), (0, 1, 8, 10)]),
        (b'f"f,""', [(0, 0, 0, 3), (0, 1, 5, 5)]),
    ],
)
def test_scan(data, cells):
    assert scan(data) == cells


def test_columns(spark):
    config = from_dict({"language": "ja", "rules": {"no-todo": False}, "formats": {"csv": {"header": True, "columns": {"note": {"parse-mode": "plain", "rules": {"no-todo": True}}, "1": {}}}}})
    docs = spark.createDataFrame([(1, "id, note ,x\n!,TODO: a,TODO: b\n  ,\n")], "doc_id long, text string")
    slices = delimited_slices(docs, config.formats["csv"], ",")
    out = lint(slices, config, "csv").where("rule_id IN ('no-todo', 'no-exclamation-question-mark')").collect()
    assert sorted((r.rule_id, r.start, r.end) for r in out) == [("no-exclamation-question-mark", 12, 13), ("no-todo", 14, 19)]


def test_many_records_and_columns(spark):
    config = from_dict({"rules": {"no-exclamation-question-mark": False}, "formats": {"csv": {"columns": {"2": {"parse-mode": "plain", "rules": {"no-exclamation-question-mark": True}}, "70000": {"parse-mode": "plain", "rules": {"no-exclamation-question-mark": True}}}}}})
    records = "".join(f"{i}!,{'!' if i % 7000 == 0 else 'n'}\n" for i in range(70_000))
    wide = "a," * 69_999 + "!\nb,!\n"
    docs = spark.createDataFrame([(1, records), (2, wide), (3, None)], "doc_id long, text string")
    slices = delimited_slices(docs, config.formats["csv"], ",")
    assert slices.where("doc_id = 1").select("slice_id").distinct().count() == 70_000
    out = lint(slices, config, "csv").where("rule_id = 'no-exclamation-question-mark'").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {1: 10, 2: 2}
    plan = lint(slices, config, "csv")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    mixed = from_dict({"formats": {"csv": {"columns": {"1": {"parse-mode": "plain"}, "2": {}}}}})
    small = spark.createDataFrame([(1, "*!*,*!*\n")], "doc_id long, text string")
    slices = delimited_slices(small, mixed.formats["csv"], ",")
    kinds = {r.column_index: [KINDS[n.kind] for n in r.nodes] for r in slices.collect()}
    assert kinds == {1: ["root", "paragraph", "text"], 2: ["root", "paragraph", "emphasis", "text"]}
    assert slices._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # cells, and nodes


def test_first_column_of_a_name(spark):
    config = from_dict({"rules": {"no-exclamation-question-mark": False}, "formats": {"csv": {"header": True, "columns": {"n": {"rules": {"no-exclamation-question-mark": True}}}}}})
    docs = spark.createDataFrame([(1, "m, n ,n\n!,!,!\n"), (2, "m,q\n!,!")], "doc_id long, text string")
    out = lint(delimited_slices(docs, config.formats["csv"], ","), config, "csv").collect()
    assert [(r.doc_id, r.start) for r in out if r.rule_id == "no-exclamation-question-mark"] == [(1, 10)]


@pytest.mark.parametrize(
    ("source", "kinds"),
    [
        ("Hello", "root paragraph text"),
        ("", "root"),
        ("# a\n\n- b\n", "root heading text list listItem paragraph text"),
        ("a|b\n-|-\nc|d", "root table tableRow tableCell text tableCell text tableRow tableCell text tableCell text"),
        ("---\nx: 1\n---\n**a** `b`", "root yaml paragraph strong text text inlineCode"),
        ("> a\n\n***", "root blockquote paragraph text thematicBreak"),
        ("[a](b) ![c](d) <!-- e -->", "root paragraph link text text image text html"),
        ("    code\n", "root code"),
        ("*a", "root paragraph text"),
    ],
)
def test_markdown_kinds(source, kinds):
    assert " ".join(KINDS[r[1]] for r in markdown(source)) == kinds


def test_markdown_tree():
    source = "これは*強調*です\n\n- あ\n- い\n"
    rows, raw = markdown(source), source.encode()
    assert next(raw[r[2] : r[3]].decode() for r in rows if KINDS[r[1]] == "emphasis") == "*強調*"
    for r in rows[1:]:
        parent = rows[r[4]]
        assert parent[2] <= r[2] <= r[3] <= parent[3]
        child, seen = parent[5], []
        while child is not None:
            seen.append(child)
            child = rows[child][6]
        assert r[0] in seen and seen == sorted(seen)


def test_too_deep_and_marked(spark):
    docs = spark.createDataFrame([(1, "> " * 1001 + "a"), (2, "\ufeffあ!"), (3, None), (4, "\t" * 501 + "- a"), (5, "> " * 1000 + "deep!")], "doc_id long, text string")
    slices, errors = markdown_slices(docs)
    assert [r.doc_id for r in errors.orderBy("doc_id").collect()] == [1, 4]
    assert sum(KINDS[n.kind] == "blockquote" for n in slices.where("doc_id = 5").first().nodes) == 1000
    out = lint_slices(slices, [r for r in active({}, None) if r.id == "no-exclamation-question-mark"]).collect()
    assert sorted((r.doc_id, r.start) for r in out) == [(2, 6), (5, 2004)]
    for depth in (101, 400, 999):
        assert nesting("- " * depth + "a") == nesting("x\n" + "1. " * depth + "a") == depth and len(markdown("> " * depth + "a")) == depth + 3


def test_configuration(tmp_path):
    assert len(active({}, "ja")) == 26 and len(active({}, None)) == 7 and len(active({}, "en", scoped=False)) == 26
    config = parse('{"extends": ["ja-technical-writing"], "rules": {"max-ten": "off", "no-nfd": {"severity": "error"}}, // x\n}', "jsonc")
    assert config.lang() == "ja" and not config.rules["max-ten"].enabled and config.rules["no-nfd"].severity == "error"
    assert config.rules["max-kanji-continuous-len"].options == {"max": 6}
    assert parse("rules:\n  no-todo: no\n", "yaml").rules["no-todo"] == Setting(False)
    assert parse("  ", "json") == Config() and from_dict({"rules": {"x": True}}).unknown() == ["x"]
    for text, kind in [('{"a": 1}', "parse"), ('{"extends": "x"}', "unknown-preset"), ('{"formats": {"xml": {}}}', "unknown-format"), ('{"formats": {"csv": {"columns": {"a": {}}}}}', "column-name-without-header"), ('{"formats": {"csv": {"delimiter": "、"}}}', "non-ascii-delimiter"), ('{"morphology": {}}', "morphology-source"), ('{"morphology": {"path": "x", "pin": "1"}}', "invalid-pin"), ('{"rules": {"a": {"b": 1}}}', "parse"), ('{"rules": {"a": 1, "a": 2}}', "parse")]:
        with pytest.raises(ConfigError) as e:
            parse(text, "json")
        assert e.value.kind == kind
    with pytest.raises(ConfigError):
        parse("a: &x 1\nb: *x", "yaml")
    path = init(tmp_path)
    assert discover(str(tmp_path))[0] == path and load(path).lang() == "ja"
    with pytest.raises(FileExistsError):
        init(tmp_path)


def test_terminology(tmp_path):
    (tmp_path / "a.yml").write_text("version: 1\nimports: [b.yml, a.yml]\nrules:\n  - expected: Cookie\n    pattern: /cookie/i\n  - expected: x\n", encoding="utf-8")
    (tmp_path / "b.yml").write_text("imports:\n  - path: a.yml\nrules:\n  - expected: y\n    patterns: [z, w]\n", encoding="utf-8")
    assert [(t["expected"], t["patterns"], len(t["regexPatterns"])) for t in terminology.load(tmp_path / "a.yml")] == [("y", ["z", "w"], 0), ("Cookie", [], 1), ("x", [], 0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x!", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(b"\xff")
    (tmp_path / ".h.md").write_text("y", encoding="utf-8")
    found, notes = files.expand([str(tmp_path), str(tmp_path / "*.none")], ["csv"])
    assert [f.rpartition("/")[2] for f in found] == ["a.md", "b.csv"] and len(notes) == 1
    docs, errors = files.read_files(spark, found)
    assert [(r.text, r.processor) for r in docs.collect()] == [("x!", "markdown")] and errors.count() == 1


def test_cache_and_reports(spark):
    docs = spark.createDataFrame([(1, "a.md", "TODO: あ\n!"), (2, "b.md", "ok")], "doc_id long, path string, text string")
    rules = [r for r in active({}, None) if r.id in ("no-todo", "no-exclamation-question-mark")]
    find = lambda d: lint_slices(plain_slices(d), rules)
    settings = cache.settings_digest(rules, "plain")
    empty = spark.createDataFrame([], "cache_key string, diagnostics array<struct<slice_id:bigint,rule_id:string,severity:string,message:string,start:int,end:int,fixes:array<struct<start:int,end:int,replacement:string>>>>")
    first, entries = cache.lint_cached(docs, empty, settings, find)
    again, more = cache.lint_cached(docs, table(entries, "cache"), settings, find)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and more.count() == 0 and entries.count() == 2
    lines = [r.line for r in render.text_lines(first, docs).orderBy("path", "start", "end", "rule_id").collect()]
    assert lines == ["a.md:1:1: warning: Found 'TODO:' marker. Consider resolving this before committing. [no-todo]", "a.md:2:1: warning: 「!」は技術文書では使用を避けてください。 [no-exclamation-question-mark]"]
    assert render.summary(first, docs).first().line == "2 file(s) checked, 2 issue(s) found"
    reports = {r.path: json.loads(r.json) for r in render.json_files(first, docs).collect()}
    assert reports["b.md"]["diagnostics"] == [] and reports["a.md"]["diagnostics"][1]["position"]["start"] == {"line": 2, "column": 1, "utf16Column": 1}
    log = json.loads(render.sarif_log(first, docs))
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["no-todo", "no-exclamation-question-mark"]
    assert log["runs"][0]["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 2, "startColumn": 1, "endLine": 2, "endColumn": 2}
    assert render.status(first) == 1 and render.status(first.where("false")) == 0
    assert json.loads(render.compact_json(first).first().json)[0]["ruleId"] == "no-todo"


def test_stream(spark, tmp_path):
    from inkspect.streaming import lint_stream, read_documents

    spark.createDataFrame([(1, "a!"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = lint_stream(read_documents(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.doc_id, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "no-exclamation-question-mark")]


def test_every_rule_runs_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert len(RULES) == 26 and lint(plain_slices(docs), from_dict({"extends": "ja-technical-writing"})).count() == 0


def test_lint_and_fix_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.md").write_text("# 題!\n\nユーザは`!`だ\n", encoding="utf-8")
    (tmp_path / "in" / "b.CSV").write_text("id,note\n!,だめ!\n", encoding="utf-8")
    (tmp_path / "in" / "c.tsv").write_text("!\t!\n", encoding="utf-8")
    (tmp_path / "in" / "d.md").write_bytes(b"\xff\xfe")
    (tmp_path / "e.md").write_text("> " * 1200 + "x", encoding="utf-8")
    rules = {"ja-prh": {"options": {"terms": [{"expected": "ユーザー", "pattern": "ユーザ"}]}}, "unheard-of": True}
    config = from_dict({"language": "ja", "rules": rules, "formats": {"csv": {"header": True, "columns": {"note": {"parse-mode": "plain"}}}}})
    arguments = [str(tmp_path), str(tmp_path / "in" / "*.tsv")]
    result = app.lint(spark, arguments, config)
    found = sorted((r.path.rpartition("/")[2], r.rule_id, r.start) for r in result.diagnostics.join(result.docs, "doc_id").collect())
    assert found == [("a.md", "ja-prh", 8), ("a.md", "no-exclamation-question-mark", 5), ("b.CSV", "no-exclamation-question-mark", 16)]
    assert sorted(r.path.rpartition("/")[2] for r in result.errors.collect()) == ["d.md", "e.md"] and result.status() == 2
    assert any("unheard-of" in n for n in result.notes) and any(n.startswith("tsv") for n in result.notes)
    lines = [r.line.rpartition("/")[2] for r in app.report(result, "text").collect()]
    assert lines[0].startswith("a.md:1:4: warning") and len(lines) == 3
    assert len(app.report(result, "json").collect()) == 4 and app.report(result, "sarif").count() == app.report(result, "compact").count() + 1 == 3
    before = (tmp_path / "a.md").read_text(encoding="utf-8")
    assert [r.path.rpartition("/")[2] for r in app.fix(spark, arguments, config, dry_run=True).collect()] == ["a.md"]
    assert (tmp_path / "a.md").read_text(encoding="utf-8") == before
    assert app.fix(spark, arguments, config).count() == 1
    assert (tmp_path / "a.md").read_text(encoding="utf-8") == before.replace("ユーザ", "ユーザー")
    assert app.fix(spark, arguments, config).count() == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "e.md", "in"]
    assert sorted(files.expand([tmp_path.as_uri()], ["csv"], spark)[0]) == sorted("file:" + p for p in files.expand([str(tmp_path)], ["csv"])[0])
    assert app.lint_text(spark, "x!").status() == 1 and app.lint(spark, [str(tmp_path / "*.none")]).status() == 0


def test_store_keeps_results(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a.md", "markdown", "x!"), (2, "b.md", "markdown", "x!"), (3, "c.md", "markdown", "ok")], "doc_id long, path string, processor string, text string")
    store = cache.Store(spark, str(tmp_path / "store"))
    first = app.lint_documents(docs, Config(), ["markdown"], store)[0].collect()
    assert sorted((r.doc_id, r.start) for r in first) == [(1, 1), (2, 1)] and store.load().count() == 2
    missed = []
    monkeypatch.setattr(app, "_checked", lambda docs, name, config: (missed.append(docs.count()) or lint(plain_slices(docs), config), None))
    assert sorted(map(str, app.lint_documents(docs, Config(), ["markdown"], store)[0].collect())) == sorted(map(str, first))
    assert missed == [0]
    monkeypatch.undo()
    other = from_dict({"rules": {"no-exclamation-question-mark": {"severity": "error"}}})
    assert {r.severity for r in app.lint_documents(docs, other, ["markdown"], store)[0].collect()} == {"error"}
    monkeypatch.setitem(cache.VERSIONS, "engine", 99)
    assert cache.Store(spark, str(tmp_path / "store")).load().count() == 0


def test_extensions(spark, monkeypatch):
    from inkspect.operators import registry
    from inkspect.sources import tokenizers

    monkeypatch.setattr(tokenizers, "PROVIDERS", {})
    slices = plain_slices(spark.createDataFrame([(1, "雨 雨 qq")], "doc_id long, text string"))
    assert tokenizers.tokens_for(slices, "ja") is None
    called = []
    tokenizers.register_provider("ja", lambda s: called.append(1) or tokenizers.whitespace_tokens(s))
    assert tokenizers.tokens_for(slices, "ja", "en", "ja").count() == 3 and called == [1]
    off = from_dict({"language": "ja", "rules": {r.id: False for r in RULES.values() if r.scope == "tokens"}})
    docs = spark.createDataFrame([(1, "a.x", "markdown", "雨 雨 qq")], "doc_id long, path string, processor string, text string")
    app.lint_documents(docs, off, ["markdown"])
    assert called == [1]
    found = app.lint_documents(docs, from_dict({"language": "ja"}), ["markdown"])[0]
    assert len(called) == 2 and [r.rule_id for r in found.collect()] == ["ja-no-successive-word"]

    from inkspect.functions.text import hits, matches

    before = dict(RULES)
    try:
        registry.register(registry.Rule("no-qq", "text", False, lambda text, options: hits(matches(text, "qq"), F.lit("qq")), "qq"))
        assert [r.rule_id for r in app.lint_documents(docs, Config(), ["markdown"])[0].collect()] == ["no-qq"]
        assert "no-qq" in app.rule_list() and "no-qq" in app.explain("no-qq")
    finally:
        RULES.clear()
        RULES.update(before)
    with pytest.raises(ValueError):
        registry.register(registry.Rule("x", "nowhere", False, None, ""))


def test_cached_results_by_token_rules():
    rules = [r for r in active({}, "ja") if r.id in ("no-todo", "no-dropping-the-ra")]
    assert cache.settings_digest(rules, "plain", "d1") != cache.settings_digest(rules, "plain", "d2")
    assert cache.settings_digest(rules[:1], "plain", "d1") == cache.settings_digest(rules[:1], "plain", "d2")


def test_first_seen(spark, tmp_path):
    from inkspect.streaming import first_seen

    spark.sql("SELECT * FROM VALUES (1L, 'a', timestamp'2026-01-01 00:00:00'), (2L, 'a', timestamp'2026-01-01 00:01:00'), (3L, 'b', timestamp'2026-01-01 00:02:00') t(doc_id, text, at)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    query = first_seen(stream, "at", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
