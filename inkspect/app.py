"""Files in, reports and fixed files out: discovery, processors by extension, rules, cache, write-back.

    from inkspect import app

    result = app.lint(spark, ["docs", "notes/**/*.csv"], load(".inkspect.jsonc"))
    app.report(result, "text").show()
    app.fix(spark, ["docs"], config, dry_run=True)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fixes import fix as fixpoint
from .operators.incremental import fix_incremental
from .operators.registry import RULES, TEXT, TOKENS
from .plans import cache as results
from .plans import linter, render
from .plans.config import Active, Config, active
from .plans.store import table
from .sources import files, writer
from .sources.delimited import delimited_slices
from .sources.markdown import markdown_slices
from .sources.plain import plain_slices
from .sources.tokenizers import fingerprint, tokens_for

Processor = Callable[[DataFrame, Config], tuple[DataFrame, "DataFrame | None"]]


def _delimited(name: str, delimiter: str) -> Processor:
    def run(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame | None]:
        if name not in config.formats:  # no column is a target
            return plain_slices(docs).where(F.lit(False)), None
        return delimited_slices(docs, config.formats[name], delimiter), None

    return run


#: How documents become slices, by the name of their processor; also (doc_id, slice_id, error) of those that can't be read.
PROCESSORS: dict[str, Processor] = {"markdown": lambda docs, config: markdown_slices(docs), "csv": _delimited("csv", ","), "tsv": _delimited("tsv", "\t")}


def register_processor(name: str, extensions: Iterable[str], run: Processor) -> None:
    """Files with these extensions are read by ``run``; the last one registered for an extension counts."""
    PROCESSORS[name] = run
    files.PROCESSORS.update(dict.fromkeys((x.lower() for x in extensions), name))


@dataclass
class Result:
    """docs (doc_id, path, ext, processor, text), diagnostics, errors (path, error), and notes for the user."""

    docs: DataFrame
    diagnostics: DataFrame
    errors: DataFrame
    notes: list[str]

    def status(self) -> int:
        """0 clean, 1 with findings, 2 with errors."""
        return render.status(self.diagnostics, self.errors)


def notes(config: Config, names: Iterable[str]) -> list[str]:
    """Unknown rules, settings that run nothing, and formats without a target column."""
    return linter.notes(config) + [f"{name}: no column is configured, so nothing is checked" for name in names if name in ("csv", "tsv") and name not in config.formats]


def _rules(name: str, config: Config) -> list[Active]:
    """All rules that run on files of a processor, those of its columns too."""
    columns = config.formats[name].columns if name in config.formats else ()
    return active(config.rules, config.lang()) + [r for c in columns for r in active(linter.overlay(config.rules, c.rules), config.lang())]


def _checked(docs: DataFrame, name: str, config: Config) -> tuple[DataFrame, DataFrame | None]:
    slices, errors = PROCESSORS[name](docs, config)
    rules = _rules(name, config)
    needed = any(RULES[r.id].scope == TOKENS for r in rules)
    return linter.lint(slices, config, name if name in config.formats else None, tokens_for(slices, config.lang()) if needed else None), errors


def read(spark: SparkSession, arguments: Iterable[str], config: Config) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """(docs, errors, names of the processors they need, notes)."""
    paths, said = files.expand(arguments, config.formats, spark)
    if not paths:
        docs = files.read_text(spark, "").where(F.lit(False))
        return docs, docs.select("path", F.lit("").alias("error")), [], said
    docs, errors = files.read_files(spark, paths)
    names = sorted({files.processor_of(p) for p in paths})
    return docs, errors, names, said + notes(config, names)


def lint_documents(docs: DataFrame, config: Config, names: Iterable[str], store: results.Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, errors (path, error)) of documents with a path and a processor; with a store only of those it doesn't hold."""
    found, bad = [], []
    for name in names:
        own = docs.where(F.col("processor") == name)

        if store is None:
            diagnostics, errors = _checked(own, name, config)
            found.append(diagnostics)
        else:
            settings = results.settings_digest(_rules(name, config), f"{name} {config.formats.get(name)}", fingerprint(config.lang()))
            found.append(store.lint(own, settings, lambda rows, name=name: _checked(rows, name, config)[0]))
            errors = PROCESSORS[name](own, config)[1]
        if errors is not None:
            bad.append(errors.join(own.select(F.col("doc_id").alias("d"), "path"), F.col("doc_id").eqNullSafe(F.col("d"))).select("path", "error"))
    empty = linter.lint(plain_slices(docs.where(F.lit(False))), config)
    diagnostics, errors = empty, docs.where(F.lit(False)).select("path", F.lit("").alias("error"))
    for more in found:
        diagnostics = diagnostics.unionByName(more.select(empty.columns))
    for more in bad:
        errors = errors.unionByName(more)
    return diagnostics, errors


def lint(spark: SparkSession, arguments: Iterable[str], config: Config | None = None, store: results.Store | None = None) -> Result:
    """Lint files, folders and globs.  Files that can't be read or parsed are errors and don't stop the others."""
    config = config or Config()
    docs, unread, names, said = read(spark, arguments, config)
    diagnostics, errors = lint_documents(docs, config, names, store)
    return Result(docs, diagnostics, unread.unionByName(errors), said)


def lint_text(spark: SparkSession, text: str, label: str = "<stdin>", config: Config | None = None) -> Result:
    """Lint one text that is no file, as Markdown."""
    config = config or Config()
    docs = files.read_text(spark, text, label)
    diagnostics, errors = lint_documents(docs, config, ["markdown"])
    return Result(docs, diagnostics, errors, notes(config, ["markdown"]))


def report(result: Result, kind: str) -> DataFrame:
    """text, json, sarif or compact as rows; in the order of a report."""
    if kind == "text":
        return render.text_lines(result.diagnostics, result.docs).orderBy("path", "start", "end", "rule_id", "message").select("line")
    if kind == "json":
        return render.json_files(result.diagnostics, result.docs).orderBy("path")
    if kind == "sarif":
        return render.sarif_results(result.diagnostics, result.docs).orderBy("path", "start", "end", "rule_id", "message").select("json")
    if kind == "compact":
        return render.compact_json(result.diagnostics).orderBy("doc_id")
    raise ValueError(f"unknown report {kind!r}")


def _fixing(name: str, config: Config) -> list[Active] | None:
    """The active rules that may have fixes, if they look at text nodes alone and are the same all over a document."""
    rules = [r for r in active(config.rules, config.lang()) if RULES[r.id].fixes]
    return None if name in config.formats or any(RULES[r.id].scope != TEXT for r in rules) else rules


def fixed_documents(docs: DataFrame, config: Config, names: Iterable[str]) -> DataFrame:
    """(doc_id, path, text, passes, changed) of all documents, fixed until nothing changes.

    Rules on text nodes run node by node, so that a pass lints only what the last one has touched.
    """
    out = docs.select("doc_id", "path", "text", F.lit(0).alias("passes"), F.lit(False).alias("changed")).where(F.lit(False))
    for name in names:
        own = docs.where(F.col("processor") == name)
        rules = _fixing(name, config)
        if rules is None:
            after = fixpoint(own, lambda rows, name=name: _checked(rows, name, config)[0], table)
        else:
            after = fix_incremental(own, lambda rows, name=name: PROCESSORS[name](rows, config)[0], rules, table)
        after = after.withColumnRenamed("doc_id", "d").withColumnRenamed("text", "after")
        rows = own.join(after, F.col("doc_id").eqNullSafe(F.col("d")))
        out = out.unionByName(rows.select("doc_id", "path", F.col("after").alias("text"), "passes", (F.col("after") != F.col("text")).alias("changed")))
    return out


def fix(spark: SparkSession, arguments: Iterable[str], config: Config | None = None, dry_run: bool = False) -> DataFrame:
    """(path, passes) of the files that fixes change; unless ``dry_run`` each is replaced by its fixed text, whole or not at all.

    Executors write the new files beside the old ones, and only when all are there they take
    their place; a run that fails before leaves nothing.  Files of other file systems than
    the mounted ones are replaced one by one, each in one step.
    """
    config = config or Config()
    docs, _, names, _ = read(spark, arguments, config)
    changed = table(fixed_documents(docs, config, names).where("changed").select("path", "passes", "text"), "fixed")
    if not dry_run:
        mounted = F.col("path").rlike("^(file:)?/")
        writer.write_files(changed.where(mounted))
        for row in changed.where(~mounted).toLocalIterator():  # a partition at a time; files are at most 16 MiB each
            files.replace(spark, row.path, row.text)
    return changed.select("path", "passes")


def rule_list(config: Config | None = None) -> str:
    """All rules as a JSON array."""
    rules = (config or Config()).rules
    own = lambda r: rules.get(r.id)
    return json.dumps([{"id": r.id, "scope": r.scope, "japanese": r.japanese, "severity": (own(r) and own(r).severity) or r.severity, "enabled": own(r).enabled if own(r) else True, "summary": r.summary} for r in RULES.values()], ensure_ascii=False)


def explain(rule_id: str) -> str:
    """A rule in words."""
    r = RULES[rule_id]
    return f"{r.id}: {r.summary}\n  looks at: {r.scope}\n  severity: {r.severity}\n  {'for Japanese alone' if r.japanese else 'for all languages'}"
