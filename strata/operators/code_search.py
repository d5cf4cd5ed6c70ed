"""Searches of lines by literal or regular expression over an index of trigrams.

``write_index`` cuts files into pages of lines and writes two Parquet tables: the pages, in
buckets, and postings (trigram, page), in buckets by trigram. A search takes from its
pattern the literals without which nothing can match, as alternatives of texts that must all
occur; the pages that have all trigrams of an alternative are joined to their texts, and
only these are matched. Postings are read by bucket and pushed-down trigram; pages by
bucket, pruned while the query runs. A pattern without a literal of three characters looks
at all pages. Hits are those of a full scan either way.

Case doesn't count, as in the patterns themselves: trigrams are of folded text, in which the
few letters that match an ASCII letter in some case are that letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as T

PAGE_LINES = 100
BUCKETS = 64
PIECE = 1 << 20
SPECIAL = set(".^$*+?{}[]\\|()")


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, "İıſK", "iisk"))


def _trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text's lines, each three code points of 21 bits. A long text is taken in pieces."""
    found = []
    for i in range(0, max(len(text) - 2, 0), PIECE):
        c = np.frombuffer(text[i : i + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        inside = c != ord("\n")
        found.append(np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside[:-2] & inside[1:-1] & inside[2:]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, trigram) of pages (page, text)."""
    for batch in batches:
        for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys = _trigrams(text.as_py())
            for i in range(0, len(keys), PIECE):
                part = keys[i : i + PIECE]
                chars = np.stack([part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), page)), pa.array([chars[j : j + 3] for j in range(0, len(chars), 3)], pa.string())], names=["page", "trigram"])


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def write_index(files: DataFrame, folder: str, page_lines: int = PAGE_LINES) -> None:
    """Write the index of files (path, text) to a new folder."""
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(page_lines)), lambda at: F.struct(F.floor(at / page_lines).alias("nth"), F.transform(F.slice("all", at + 1, page_lines), lambda c, i: F.struct((at + i + 1).alias("line"), c.alias("content"))).alias("lines")))
    # Outer, as the filter that Spark puts before another explode would make all pages once more.
    pages = files.select("path", T.lines(F.col("text")).alias("all")).select("path", F.explode_outer(F.when(F.size("all") > 0, cut)).alias("x")).where("x is not null").select("path", "x.*")
    pages = pages.select("path", "lines", F.xxhash64("path", "nth").alias("page"))
    spread = F.pmod(F.col("page"), F.lit(4))  # files of a bucket, so that a common trigram is no task of its own
    pages.withColumn("bucket", _bucket(F.col("page"))).repartition("bucket", spread).sortWithinPartitions("bucket", "page").write.partitionBy("bucket").parquet(f"{folder}/pages")
    stored = files.sparkSession.read.parquet(f"{folder}/pages")
    found = stored.select("page", folded(F.array_join(F.transform("lines", lambda x: x["content"]), "\n")).alias("text")).mapInArrow(_postings, "page long, trigram string")
    found.withColumn("bucket", _bucket(F.col("trigram"))).repartition("bucket", spread).sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").parquet(f"{folder}/postings")


@dataclass
class _Part:
    """What of a pattern has been read: texts that must occur, and the one that is being read."""

    needed: list[str] = field(default_factory=list)
    now: str = ""

    def end(self) -> None:
        if self.now:
            self.needed.append(self.now)
        self.now = ""


def _class_end(p: str, i: int) -> int:
    """The place after a character class that starts at ``i``."""
    i += 2 if p[i + 1 : i + 2] == "^" else 1
    i += p[i : i + 1] == "]"
    while i < len(p) and p[i] != "]":
        i += 2 if p[i] == "\\" else 1
    return i + 1


def _group_end(p: str, i: int) -> int:
    """The place after a group that starts at ``i``."""
    depth = 0
    while i < len(p):
        if p[i] == "[":
            i = _class_end(p, i)
            continue
        depth += (p[i] == "(") - (p[i] == ")")
        i += 2 if p[i] == "\\" else 1
        if not depth:
            return i
    return i


def _quantifier(p: str, i: int) -> tuple[int, bool]:
    """The place after a quantifier at ``i``, and whether what stands before it may be absent."""
    absent, end = p[i : i + 1] in ("*", "?"), i
    if p[i : i + 1] in ("*", "+", "?"):
        end = i + 1
    elif m := re.match(r"\{(\d*)(,\d*)?\}", p[i:]):
        absent, end = int(m[1] or 0) == 0, i + m.end()
    return (end + (p[end : end + 1] in ("?", "+")) if end > i else i), absent


def _kept(texts: list[str]) -> list[str]:
    """Runs of at least three ASCII characters, folded. Letters beyond ASCII match in more ways than a fold has."""
    return sorted({x.lower() for t in texts for x in re.findall(r"[\x00-\x7f]{3,}", t)})


def alternatives(pattern: str, literal: bool = False) -> list[list[str]]:
    """Texts that a match must hold: all of one of the lists. An empty list holds for any text.

    Only what surely must occur is taken: plain and escaped characters outside classes, look-arounds and groups that may be absent.
    """
    if literal:
        return [_kept([pattern])]
    if re.search(r"\(\?[a-zA-Z-]*x|\(\?[#P(]|\\[QExupPNkgco0-9]|\[[^\]]*\[", pattern):
        return [[]]
    parts, i = [_Part()], 0
    while i < len(pattern):
        c, part = pattern[i], parts[-1]
        one, inner, start = "", [[]], i
        i += 1
        if c == "|":
            part.end()
            parts.append(_Part())
            continue
        if c == "[":
            i = _class_end(pattern, start)
        elif c == "(":
            i = _group_end(pattern, start)
            body = pattern[start + 1 : i - 1]
            head = re.match(r"\?(:|<[A-Za-z]\w*>)", body)
            if head or not body.startswith("?"):
                inner = alternatives(body[head.end() :] if head else body)
        elif c == "\\":
            one = pattern[i] if i < len(pattern) and not pattern[i].isalnum() else ""
            i += 1
        elif c not in SPECIAL:
            one = c
        atom_end = i
        i, absent = _quantifier(pattern, i)
        if one and not absent:
            part.now += one
        if i > atom_end or not one:
            part.end()
        if not absent and len(inner) == 1:
            part.needed += inner[0]
    parts[-1].end()
    out = [_kept(p.needed) for p in parts]
    return [[]] if [] in out else out


def _triples(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


#: Pages up to which a search names them in the scan's filter; beyond, they are joined.
NAMED_PAGES = 1000


def candidates(spark: SparkSession, folder: str, wanted: list[list[str]]) -> DataFrame:
    """(page): the pages that have all trigrams of one of the alternatives."""
    sets = [sorted({t for text in texts for t in _triples(text)}) for texts in wanted]
    every = sorted(set().union(*sets))
    posts = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in every]) & F.col("trigram").isin(every))
    has = posts.groupBy("page").agg(F.collect_set("trigram").alias("has"))
    whole = [F.size(F.array_except(F.lit(s), "has")) == 0 for s in sets]
    return has.where(reduce(or_, whole)).select("page")


def pages_to_read(spark: SparkSession, folder: str, wanted: list[list[str]]) -> DataFrame:
    """The pages that may have a match, with their lines: all, the few named ones, or those of a join."""
    pages = spark.read.parquet(f"{folder}/pages")
    if wanted == [[]]:
        return pages
    found = candidates(spark, folder, wanted)
    few = [r["page"] for r in found.limit(NAMED_PAGES + 1).collect()]
    if len(few) <= NAMED_PAGES:
        return pages.where(F.col("bucket").isin(*[_bucket(F.lit(p)) for p in few]) & F.col("page").isin(few)) if few else pages.where("false")
    return pages.join(found.withColumn("bucket", _bucket(F.col("page"))), ["bucket", "page"], "left_semi")


def search(spark: SparkSession, folder: str, pattern: str, regex: bool = False, limit: int = 30) -> DataFrame:
    """(path, line, text): the first ``limit`` (1 to 100) lines with a literal or a match, by path and line; case doesn't count, and texts end at 300 characters."""
    lines = pages_to_read(spark, folder, alternatives(pattern, not regex)).select("path", F.explode("lines").alias("x")).select("path", "x.line", "x.content")
    hit = F.col("content").rlike(f"(?iu){pattern}") if regex else F.contains(F.lower("content"), F.lower(F.lit(pattern)))
    return lines.where(hit).orderBy("path", "line").limit(max(1, min(limit, 100))).select("path", "line", F.substring("content", 1, 300).alias("text"))
