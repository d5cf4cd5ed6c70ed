"""Sensitive content in texts and structured values: base64 spans, keyed redaction, and walks of JSON."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.functions.digests import canonical

#: The leftmost longest run of whole quads, 32 characters or more, with up to two pads at its end.
BASE64_SPAN = r"(?:[A-Za-z0-9+/]{4}){7,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})"
# Classes from least to most severe.
CLASSES = ("public", "internal", "sensitive", "restricted")


def base64_spans(text: Column) -> Column:
    """The spans' texts in order."""
    return F.regexp_extract_all(text, F.lit(f"({BASE64_SPAN})"), F.lit(1))


def _signer(tenant: str, key: bytes) -> Callable[[str], str]:
    derived = hmac.new(key, b"tenant\x00" + tenant.encode(), hashlib.sha256).digest()
    return lambda text: hmac.new(derived, b"value\x00" + text.encode(), hashlib.sha256).digest()[:16].hex()


def redacted(text: Column, tenant: str, key: bytes) -> Column:
    """NFC text with each base64 span replaced by its tenant's fingerprint. The key stays in the function's closure."""
    sign, span = _signer(tenant, key), re.compile(BASE64_SPAN)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else span.sub(lambda m: f"[REDACTED:{sign(m.group())}]", unicodedata.normalize("NFC", v)))

    return run(text.cast("string"))


def rewritten_json(payload: Column, replace: Callable[[str | None, object], object]) -> Column:
    """JSON texts with values replaced: ``replace(key, value)`` gives a new value, or the value itself, whose parts are then visited.

    Null, texts that aren't JSON or are nested beyond Python's stack, and values that ``replace`` refuses by ValueError give null, so nothing passes unseen.
    """

    def visit(key: str | None, value: object) -> object:
        new = replace(key, value)
        if new is not value:
            return new
        if isinstance(value, dict):
            return {unicodedata.normalize("NFC", k): visit(k, v) for k, v in value.items()}
        return [visit(None, v) for v in value] if isinstance(value, list) else value

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(visit(None, json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(payload.cast("string"))


def redacted_json(payload: Column, tenant: str, key: bytes) -> Column:
    """JSON texts without sensitive values: whatever stands below a sensitive key, restricted texts and whole base64 values become
    records (fingerprint, value_kind, length), base64 spans inside texts their fingerprints; other texts are in normal form C."""
    sign, span = _signer(tenant, key), re.compile(BASE64_SPAN)
    unsafe = re.compile(f"{T.PEM_HEADER}|{T.URL_CREDENTIAL}")

    def record(value: object) -> dict:
        text = unicodedata.normalize("NFC", value) if isinstance(value, str) else canonical(value)
        kind = "null" if value is None else {str: "string", bool: "bool", int: "int"}.get(type(value), "structured")
        return {"fingerprint": sign(text), "value_kind": kind, "length": len(text if isinstance(value, str) else text.encode())}

    def replace(name: str | None, value: object) -> object:
        if name is not None and any(t in name.lower() for t in T.SENSITIVE_TOKENS):
            return record(value)
        if not isinstance(value, str):
            return value
        text = unicodedata.normalize("NFC", value)
        if unsafe.search(value) or span.fullmatch(text):
            return record(value)
        return span.sub(lambda m: f"[REDACTED:{sign(m.group())}]", text)

    return rewritten_json(payload, replace)


def sanitized_progress(payload: Column) -> Column:
    """Progress JSON in which values of credential-like keys, and credentials inside texts, read [redacted]."""
    names, forms = re.compile(T.PROGRESS_KEY, re.IGNORECASE), re.compile(T.PROGRESS_CREDENTIAL, re.IGNORECASE)

    def replace(name: str | None, value: object) -> object:
        if name is not None and names.search(name):
            return T.PROGRESS_MARK
        return forms.sub(T.PROGRESS_MARK, value) if isinstance(value, str) else value

    return rewritten_json(payload, replace)


def progress_summary(payload: Column) -> Column:
    """The nine listed fields of progress JSON as a struct, absent ones null; null for null, broken or empty progress."""
    parsed = F.from_json(payload, T.PROGRESS_FIELDS)
    return F.when(~payload.rlike(r"^\s*(\{\s*\}|null)?\s*$") & F.get_json_object(payload, "$").isNotNull(), parsed)


def _leaves(value: object, path: tuple[int, ...], key: str | None, depth: int) -> Iterator[tuple[str, str | None, str | None, bool]]:
    """(ordinal path, key, text, whole) of a value's strings, and of whole values below a sensitive key or beyond the depth."""
    here = ".".join(map(str, path))
    if key is not None and any(t in key.lower() for t in T.SENSITIVE_TOKENS):
        yield here, key, value if isinstance(value, str) else json.dumps(value), True
    elif isinstance(value, (dict, list)) and depth <= 0:
        yield here, key, None, True
    elif isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            yield from _leaves(v, (*path, i), k, depth - 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, (*path, i), None, depth - 1)
    elif isinstance(value, str):
        yield here, key, value, False


def structured_entries(df: DataFrame, key: str, payload: str, depth: int = 16) -> DataFrame:
    """Flagged places of JSON payloads: (key, path, field, classification, length).

    Python only walks; what is sensitive is decided by expressions. A payload that isn't JSON, or is too deep, is flagged as a whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, v in zip(b["k"], b["v"]):
                try:
                    out += [(k, *leaf) for leaf in _leaves(json.loads(v), (), None, depth)] if v is not None else []
                except (ValueError, RecursionError):
                    out.append((k, "", None, v, True))
            yield pd.DataFrame(out, columns=["k", "path", "field", "value", "whole"])

    rows = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("v")).mapInPandas(run, f"k {kind}, path string, field string, value string, whole boolean")
    value = F.coalesce("value", F.lit(""))
    level = F.when(T.restricted(value), "restricted").when(F.col("whole") | (F.size(base64_spans(value)) > 0), "sensitive")
    return rows.withColumn("classification", level).where("classification is not null").select(F.col("k").alias(key), "path", "field", "classification", F.length(value).alias("length"))


def classified(df: DataFrame, key: str, payload: str, depth: int = 16) -> DataFrame:
    """(key, classification, flagged): the severest entry of each payload, internal without one."""
    rank = F.array_position(F.lit(list(CLASSES)), F.col("classification"))
    worst = structured_entries(df, key, payload, depth).groupBy(key).agg(F.max(rank).alias("_rank"), F.count("*").alias("flagged"))
    out = df.select(key).join(worst, key, "left")
    return out.select(key, F.element_at(F.lit(list(CLASSES)), F.coalesce(F.col("_rank"), F.lit(2)).cast("int")).alias("classification"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


def mixed_tenants(entries: DataFrame, source: str = "source_path", tenant: str = "tenant") -> DataFrame:
    """Sources whose entries carry more than one tenant; an audit refuses these."""
    return entries.groupBy(source).agg(F.count_distinct(tenant).alias("tenants")).where("tenants > 1")
