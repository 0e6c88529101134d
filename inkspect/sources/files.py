"""Files as documents: paths, globs and folders in, (doc_id, path, ext, text) and errors out."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, MOST_FILES, DEEPEST = 16 << 20, 100_000, 64
PROCESSORS = {"md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "tsv", "txt": "markdown"}
FOUND = {"md", "markdown"}


def processor(ext):
    """Column: how a file is read, by its extension in any case; what is not known is Markdown."""
    pairs = [F.lit(x) for pair in PROCESSORS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.lower(ext)], F.lit("markdown"))


def processor_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return PROCESSORS.get(name.rpartition(".")[2].lower() if "." in name else "", "markdown")


def _remote(spark: SparkSession, arg: str, wanted: set[str]) -> list[str]:
    """Files of an argument with a scheme, listed by the file system that serves it; Hadoop globs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(arg)
    fs = path.getFileSystem(conf)
    todo, out = [(s, 0) for s in (fs.globStatus(path) or [])], []
    named = not glob.has_magic(arg)
    while todo:
        status, depth = todo.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            if depth < DEEPEST and not (depth and name[0] == "."):
                todo += [(s, depth + 1) for s in fs.listStatus(status.getPath())]
        elif not depth or (name[0] != "." and name.rpartition(".")[2].lower() in wanted):
            out.append(status.getPath().toString())
    return out or ([arg] if named else [])


def expand(arguments: Iterable[str], formats: Iterable[str] = (), spark: SparkSession | None = None) -> tuple[list[str], list[str]]:
    """(files, notes): folders are walked, without hidden entries and links, for Markdown and configured formats; globs keep * in a component, ** crosses.

    With a session, arguments with a scheme (other than a plain path) go to their own file system.
    """
    wanted, files, notes = FOUND | set(formats), set(), []
    for arg in arguments:
        if spark is not None and "://" in arg:
            found = _remote(spark, arg, wanted)
            files |= set(found)
            if not found:
                notes.append(f"{arg}: no file matches")
        elif os.path.isdir(arg):
            depth = arg.rstrip("/").count("/")
            for folder, names, own in os.walk(arg):
                names[:] = sorted(n for n in names if n[0] != "." and not os.path.islink(os.path.join(folder, n)) and folder.count("/") - depth < DEEPEST)
                files |= {os.path.join(folder, n) for n in own if n[0] != "." and n.rpartition(".")[2].lower() in wanted and not os.path.islink(os.path.join(folder, n))}
        elif glob.has_magic(arg):
            found = [f for f in glob.glob(arg, recursive=True) if os.path.isfile(f)]
            files |= set(found)
            if not found:
                notes.append(f"{arg}: no file matches")
        else:
            files.add(arg)
    if len(files) > MOST_FILES:
        notes.append(f"only the first {MOST_FILES} of {len(files)} files are read")
    return sorted(files)[:MOST_FILES], notes


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): files over 16 MiB and text that is not UTF-8 are errors."""
    raw = spark.read.format("binaryFile").load(paths)
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    rows = raw.select(F.xxhash64("path").alias("doc_id"), "path", ext.alias("ext"), processor(ext).alias("processor"), "length", "content")
    good = (F.col("length") <= LIMIT) & F.is_valid_utf8(F.col("content"))
    docs = rows.where(good).select("doc_id", "path", "ext", "processor", F.decode("content", "UTF-8").alias("text"))
    why = F.when(F.col("length") > LIMIT, "too large").otherwise("not UTF-8")
    return docs, rows.where(~good).select("path", why.alias("error"))


def read_text(spark: SparkSession, text: str, label: str = "<stdin>") -> DataFrame:
    """One document from memory."""
    return spark.createDataFrame([(0, label, "md", "markdown", text)], "doc_id long, path string, ext string, processor string, text string")


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside a file and move it over the old one in one step, on the file system that serves it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs, beside = target.getFileSystem(conf), hadoop.Path(target.getParent(), f".{target.getName()}.new")
    try:
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(target), over)
    except Exception:
        fs.delete(beside, False)
        raise
