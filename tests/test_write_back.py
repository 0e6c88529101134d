"""Files written back, cached results under a new provider, and one parse for findings and errors."""

import os

import pytest

from inkspect import app
from inkspect.operators.registry import RULES, Rule
from inkspect.plans import cache
from inkspect.plans.config import from_dict
from inkspect.sources import files, tokenizers, writer

CONFIG = {"language": "ja", "rules": {"ja-prh": {"options": {"terms": [{"expected": "ユーザー", "pattern": "ユーザ"}]}}}}


def test_executors_write_and_one_commit_puts_in_place(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.md").write_text("old")
    (tmp_path / "3.md").chmod(0o600)
    rows = [(f"file:{tmp_path}/{i}.md" if i % 2 else f"{tmp_path}/{i}.md", f"新 {i}") for i in range(12)] + [(f"{tmp_path}/made.md", None)]
    writer.write_files(spark.createDataFrame(rows, "path string, text string").repartition(4))
    assert [(tmp_path / f"{i}.md").read_text() for i in range(12)] == [f"新 {i}" for i in range(12)]
    assert (tmp_path / "made.md").read_text() == "" and len(os.listdir(tmp_path)) == 13
    assert (tmp_path / "3.md").stat().st_mode & 0o777 == 0o600


def test_a_job_that_fails_leaves_everything_as_it_was(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"{i}.md").write_text("old")
    rows = [(f"{tmp_path}/{i}.md", "new") for i in range(8)] + [(f"{tmp_path}/nowhere/x.md", "new")]
    with pytest.raises(Exception, match="nowhere"):
        writer.write_files(spark.createDataFrame(rows, "path string, text string").repartition(3))
    assert sorted(os.listdir(tmp_path)) == sorted(f"{i}.md" for i in range(8))
    assert {(tmp_path / f"{i}.md").read_text() for i in range(8)} == {"old"}


def test_replace_is_one_step_for_any_scheme(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./in", f"file://{tmp_path}")
    for path, text in ((f"file://{tmp_path}/a.md", "é"), ("viewfs://here/in/a.md", "two")):
        files.replace(spark, path, text)
        assert (tmp_path / "a.md").read_text() == text
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["a.md"]


def test_fix_writes_what_lint_then_finds_clean(spark, tmp_path):
    (tmp_path / "a.md").write_text("# ユーザ\n\nユーザーと*ユーザ*\n")
    (tmp_path / "b.md").write_text("静か\n")
    config = from_dict(CONFIG)
    assert [r.path.rpartition("/")[2] for r in app.fix(spark, [str(tmp_path)], config, dry_run=True).collect()] == ["a.md"]
    assert (tmp_path / "a.md").read_text().count("ユーザー") == 1
    assert [(r.path.rpartition("/")[2], r.passes) for r in app.fix(spark, [str(tmp_path)], config).collect()] == [("a.md", 2)]
    assert (tmp_path / "a.md").read_text() == "# ユーザー\n\nユーザーと*ユーザー*\n" and (tmp_path / "b.md").read_text() == "静か\n"
    assert app._fixing("markdown", config)[0].id == "ja-prh"


def test_fixing_rules_of_other_scopes_take_whole_documents(monkeypatch):
    monkeypatch.setitem(RULES, "own", Rule("own", "block", False, lambda text, options: text, "own"))
    assert app._fixing("markdown", from_dict(CONFIG)) is None


def test_kept_results_are_those_of_the_provider(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenizers, "PROVIDERS", {})
    monkeypatch.setattr(tokenizers, "FINGERPRINTS", {})
    (tmp_path / "a.md").write_text("は は 見る\n")
    config, store = from_dict({"language": "ja", "rules": {r: False for r in RULES if r != "ja-no-successive-word"}}), cache.Store(spark, str(tmp_path / "store"))
    found = lambda: [r.rule_id for r in app.lint(spark, [str(tmp_path / "a.md")], config, store).diagnostics.where("rule_id = 'ja-no-successive-word'").collect()]
    assert found() == []
    app_provider = lambda slices: tokenizers.whitespace_tokens(slices)
    tokenizers.register_provider("ja", app_provider, "1")
    expected = [r.rule_id for r in app.lint(spark, [str(tmp_path / "a.md")], config).diagnostics.where("rule_id = 'ja-no-successive-word'").collect()]
    assert found() == expected == ["ja-no-successive-word"]
    tokenizers.register_provider("ja", lambda slices: tokenizers.whitespace_tokens(slices.limit(0)))
    assert found() == []
