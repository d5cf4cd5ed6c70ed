"""Corpus scans: files or document tables to admitted texts, lines and inventories."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from strata.functions import text as T
from strata.operators.ranking import budget_skip, global_rank

# Suffixes and names that are scanned, folders and files that aren't, and folders that come first or last.
SUFFIXES = (
    ".ac", ".am", ".c", ".cc", ".cmake", ".conf", ".cpp", ".css", ".cxx", ".go", ".h", ".hh", ".hpp", ".html", ".hxx", ".in", ".inl", ".ipp", ".java", ".js", ".json", ".jsx", ".list", ".m4", ".php", ".po", ".pot",
    ".py", ".rb", ".rs", ".sh", ".toml", ".tpp", ".ts", ".tsx", ".yaml", ".yml",
)
FILE_NAMES = ("CMakeLists.txt", "LINGUAS", "Makefile", "Makefile.inc", "Makevars", "config.mk")
IGNORED_FOLDERS = (
    ".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "output", "repositories", "target", "vendor", "venv",
)
IGNORED_FILES = (".env", ".env.local", ".env.production")
SOURCE_ROOTS = ("app", "lib", "package", "packages", "src")
LOW_PRIORITY_FOLDERS = ("benchmark", "benchmarks", "demo", "demos", "doc", "docs", "example", "examples", "fixture", "fixtures", "sample", "samples", "test", "tests", "testing")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), size, content and sha256 of all files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return raw.select(F.regexp_replace(base, "^" + _quoted(root.rstrip("/")) + "/", "").alias("path"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def document_files(documents: DataFrame) -> DataFrame:
    """A documents table in the form of ``read_files``: the path is made of source and id."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return documents.select(F.concat_ws("/", "source", F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"), content.alias("content"), F.sha2(content, 256).alias("sha256"))


def priority(path: Column) -> Column:
    """0 for a source root, 1 for the rest, 2 for folders of low priority. The file's own name doesn't count."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.when(F.arrays_overlap(folders, F.lit(list(LOW_PRIORITY_FOLDERS))), 2).when(F.coalesce(F.get(folders, F.lit(0)).isin(*SOURCE_ROOTS), F.lit(False)), 0).otherwise(1)


def admission(path: Column, size: Column, content: Column, max_file_bytes: int = 512 * 1024, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Why a file is left out, or null: ignored folder, sensitive configuration, suffix, size, binary (a NUL in the first 8,192 bytes) or not UTF-8."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    suffix = F.regexp_extract(F.lower(name), r"[^.](\.[^.]+)$", 1)
    return (
        F.when(F.arrays_overlap(folders, F.lit(list(IGNORED_FOLDERS))), "ignored-directory").when(name.isin(*IGNORED_FILES) | F.startswith(name, F.lit(".env.")), "sensitive-config")
        .when(~name.isin(*FILE_NAMES) & ~suffix.isin(*suffixes), "unsupported-extension").when(size > max_file_bytes, "file-size-limit")
        .when(F.contains(F.substring(content, 1, 8192), F.lit(b"\0")), "binary").when(~F.is_valid_utf8(content), "non-utf8")
    )


def inventory(files: DataFrame, max_files: int = 5000, max_total_bytes: int = 20 * 1024 * 1024, max_file_bytes: int = 512 * 1024, snapshot: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Admitted files in priority order under a byte and file budget: path, size, sha256, line_count. One budget for each ``snapshot``, if that column is named."""
    group = snapshot or "_all"
    rows = files if snapshot else files.withColumn("_all", F.lit(0))
    rows = rows.withColumn("priority", priority(F.col("path"))).withColumn("reason", admission(F.col("path"), F.col("size"), F.col("content"), max_file_bytes, suffixes)).where("reason is null")
    lines = F.size(T.lines(F.col("content").cast("string")))
    slim = rows.select(group, "priority", "path", "size", "sha256", lines.cast("long").alias("line_count"))
    return budget_skip(slim, [group], ["priority", "path"], "size", max_total_bytes, max_files).drop("priority", *([] if snapshot else ["_all"]))


def skips(files: DataFrame, max_file_bytes: int = 512 * 1024, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files left out by reason."""
    return files.select(admission(F.col("path"), F.col("size"), F.col("content"), max_file_bytes, suffixes).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def coverage(discovered: DataFrame, kept: DataFrame) -> DataFrame:
    """Files and bytes kept of those discovered; 1.0 where there is nothing."""
    d = discovered.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    k = kept.agg(F.count("*").alias("kept_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("kept_bytes"))
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return d.join(k, F.lit(True)).select("*", share("kept_files", "files").alias("file_coverage"), share("kept_bytes", "bytes").alias("byte_coverage"))


def verified_text(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Texts whose digest is the one inventoried; any other raises when the row is read."""
    rows = files.join(expected.select("path", F.col("sha256").alias("_known")), "path")
    same = F.when(F.sha2("content", 256) == F.col("_known"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("snapshot drift: "), "path")))
    return rows.select("path", same.alias("text"))


def _running_digest(by: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by])
            for key, line in zip(keys, batch.column(batch.schema.get_field_index("l")).to_pylist()):
                if digest is None or key != held:
                    if digest is not None:
                        done.append((*held, digest.hexdigest()))
                    held, digest = key, sha256()
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, digest.hexdigest()), schema.types)], schema=schema)

    return run


def inventory_digest(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One digest over path NUL size NUL sha256 LF of all files in path order; of each group, if named. A task streams its sorted rows and holds no list."""
    line = F.concat(F.concat_ws("\x00", "path", F.col("size").cast("string"), "sha256"), F.lit("\n"))
    keys = by or ["_all"]
    rows = (files if by else files.withColumn("_all", F.lit(0))).select(*keys, F.col("path").alias("p"), line.alias("l"))
    schema = StructType([*rows.select(*keys).schema.fields, StructField("digest", StringType())])
    out = rows.repartition(*keys).sortWithinPartitions(*keys, "p", "l").mapInArrow(_running_digest(keys, to_arrow_schema(schema)), schema)
    return out if by else out.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def text_lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., line, content): every line with its number from 1."""
    parts = df.select(*key, F.split(F.coalesce(F.col(text), F.lit("")), T.LINE_END).alias("_parts"))
    rows = parts.select(*key, F.size("_parts").alias("_n"), F.posexplode("_parts").alias("pos", "content"))
    return rows.where((F.col("pos") + 1 < F.col("_n")) | (F.col("content") != "")).select(*key, (F.col("pos") + 1).alias("line"), "content")


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Rows with their place in a total order, from 1."""
    return global_rank(df, [F.asc(c) for c in order], rank=name)
