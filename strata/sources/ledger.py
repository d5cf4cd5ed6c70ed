"""Transactional files as Python data sources: an event log with sequence numbers, documents that are replaced whole, and a cache of results.

Tasks write staged files of their own. The commit alone makes them count: a log's commit is
one small file that names the staged files with their first sequence numbers, so a task that
fails leaves nothing that a reader sees, and a commit under a known transaction changes
nothing. Readers deal the named files to partitions. Folders are URIs of any file system
that Arrow opens; every executor has to see them. One writer at a time commits to a log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LOG = "seq bigint, event string"
DOCUMENTS = "name string, content string"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Put a file in place whole: readers see the one before or this one."""
    files.create_dir(path.rpartition("/")[0])
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(aside) as out:
        out.write(content)
    files.move(aside, path)


def _read(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as stream:
        return stream.read()


def _commits(files: fs.FileSystem, root: str) -> list[dict]:
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return [json.loads(_read(files, f.path)) for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".json")]


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int
    task: int


class LogWriter(DataSourceWriter):
    def __init__(self, uri: str, transaction: str):
        self.uri, self.transaction = uri, transaction

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        files, root = _opened(self.uri)
        path, rows = f"{root}/files/{self.transaction}-{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{root}/files")
        with files.open_output_stream(path) as out:
            for row in iterator:
                out.write(json.dumps(row["event"]).encode() + b"\n")
                rows += 1
        return Staged(path, rows, TaskContext.get().partitionId())

    def _drop(self, messages: list) -> None:
        files, _ = _opened(self.uri)
        for m in messages:
            if m is not None:
                files.delete_file(m.path)

    def commit(self, messages: list) -> None:
        files, root = _opened(self.uri)
        before = _commits(files, root)
        if any(c["transaction"] == self.transaction for c in before):
            self._drop(messages)
            return
        seq = before[-1]["next"] if before else 0
        named = []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            named.append({"path": m.path, "first": seq, "rows": m.rows})
            seq += m.rows
        _write(files, f"{root}/commits/{len(before):012d}.json", json.dumps({"transaction": self.transaction, "files": named, "next": seq}).encode())

    def abort(self, messages: list) -> None:
        self._drop(messages)


@dataclass
class LogPart(InputPartition):
    path: str
    first: int


class LogReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[LogPart]:
        files, root = _opened(self.uri)
        return [LogPart(f["path"], f["first"]) for c in _commits(files, root) for f in c["files"] if f["rows"]] or [LogPart("", 0)]

    def read(self, part: LogPart) -> Iterator[tuple]:
        if part.path:
            files, _ = _opened(self.uri)
            with files.open_input_stream(part.path) as stream:
                for i, line in enumerate(_lines(stream)):
                    yield part.first + i, json.loads(line)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class EventLog(DataSource):
    """``strata_log``: rows (event) are appended, rows (seq, event) are read. Options: path, and for a writer ``transaction``."""

    @classmethod
    def name(cls) -> str:
        return "strata_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(self.options["path"], self.options.get("transaction") or uuid.uuid4().hex)


class DocumentWriter(DataSourceWriter):
    """Stages documents (name, content) and puts them in place at the commit, each by one move."""

    def __init__(self, uri: str):
        self.uri, self.stage = uri, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        files, root = _opened(self.uri)
        folder, names = f"{root}/.staged-{self.stage}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not row["name"] or row["name"] in (".", "..") or set(row["name"]) & set("/\\\0") or row["name"].startswith(".staged-"):
                raise ValueError(f"not a document's name: {row['name']!r}")
            files.create_dir(folder)
            with files.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write((row["content"] or "").encode())
            names.append(row["name"])
        if len(set(names)) < len(names):
            raise ValueError("a document is written twice")
        return Staged(folder, len(names), 0)

    def commit(self, messages: list) -> None:
        files, root = _opened(self.uri)
        found = [f for m in messages if m is not None and m.rows for f in files.get_file_info(fs.FileSelector(m.path))]
        names = [f.base_name for f in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a document is written twice")
        for f in found:
            files.move(f.path, f"{root}/{f.base_name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, root = _opened(self.uri)
        staged = f"{root}/.staged-{self.stage}"
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


class Documents(DataSource):
    """``strata_documents``: each row (name, content) replaces the document of its name in the folder ``path``, or none does."""

    @classmethod
    def name(cls) -> str:
        return "strata_documents"

    def schema(self) -> str:
        return DOCUMENTS

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (EventLog, Documents):
        spark.dataSource.register(source)


def append_events(events: DataFrame, folder: str, transaction: str | None = None) -> None:
    """Append the column ``event`` to a log; under a transaction that it knows, nothing is added."""
    register(events.sparkSession)
    writer = events.select("event").write.format("strata_log").mode("append").option("path", folder)
    (writer.option("transaction", transaction) if transaction else writer).save()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, event) of all committed events; numbers are gapless from 0, by commit, then by task and row."""
    register(spark)
    return spark.read.format("strata_log").option("path", folder).load()


def replace_documents(documents: DataFrame, folder: str) -> None:
    """Put documents (name, content) in place of those of their names."""
    register(documents.sparkSession)
    documents.select("name", "content").write.format("strata_documents").mode("append").option("path", folder).save()


def put_results(results: DataFrame, folder: str, transaction: str | None = None) -> None:
    """Store results (cache_key, payload: a JSON object as text); the last of a key counts. Anything but an object raises."""
    whole = F.try_parse_json("payload")
    bad = F.raise_error(F.concat(F.lit("a payload is a JSON object: "), F.col("cache_key")))
    payload = F.when(_is_object(F.col("payload")), F.to_json(whole)).otherwise(bad)
    append_events(results.select(F.to_json(F.struct("cache_key", payload.alias("payload"))).alias("event")), folder, transaction)


def _is_object(payload: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(payload)), F.lit("OBJECT")), F.lit(False))


def get_results(wanted: DataFrame, folder: str) -> DataFrame:
    """(cache_key, payload, hit) of wanted keys. An entry that can't be read, or isn't an object, is a miss; what is put after it heals it."""
    entry = F.from_json("event", "cache_key string, payload string")
    entries = read_events(wanted.sparkSession, folder).select("seq", entry.alias("e")).select("seq", "e.*").where("cache_key is not null")
    last = entries.groupBy("cache_key").agg(F.max_by("payload", "seq").alias("payload"))
    out = wanted.select("cache_key").distinct().join(last, "cache_key", "left")
    hit = _is_object(F.col("payload"))
    return out.select("cache_key", F.when(hit, F.col("payload")).alias("payload"), hit.alias("hit"))
