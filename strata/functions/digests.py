"""Identities: separator-joined digests, buckets, keyed fingerprints and canonical JSON."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def joined_digest(*parts: Column, size: int = 64, separator: str = NUL) -> Column:
    """The first ``size`` hex digits of SHA-256 over parts joined by a separator; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def fingerprint(rule_id: Column, path: Column, line: Column, evidence: Column) -> Column:
    return joined_digest(rule_id, path, line, evidence, size=24)


def bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket from the first eight hex digits of SHA-256."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hmac_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 by two hashes over padded keys. The key becomes part of the plan: for tests; see ``tenant_fingerprint``."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def tenant_fingerprint(value: Column, tenant: str, key: bytes, domain: str = "value") -> Column:
    """Sixteen bytes as hex of a two-stage HMAC: a tenant key is derived first, then the value is signed under a domain.

    The key travels in the function's closure, so it shows in no plan or log.
    """
    derived = hmac.new(key, b"tenant" + NUL.encode() + tenant.encode(), hashlib.sha256).digest()
    label = domain.encode() + NUL.encode()

    @F.pandas_udf("string")
    def sign(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(derived, label + v.encode(), hashlib.sha256).digest()[:16].hex())

    return sign(value.cast("string"))


def nfc(value: Column) -> Column:
    """Unicode normal form C; Spark has no such function."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return run(value.cast("string"))


def canonical(value: object) -> str:
    """Sorted keys, no spaces, NFC strings. Floats and integers beyond 64 bits are refused."""

    def clean(v: object) -> object:
        if isinstance(v, float):
            raise ValueError("floats are not canonical")
        if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
            raise ValueError("integer beyond 64 bits")
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, dict):
            out = {unicodedata.normalize("NFC", k): clean(x) for k, x in v.items()}
            if len(out) != len(v):
                raise ValueError("keys collide")
            return out
        return v

    return json.dumps(clean(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_json(value: Column) -> Column:
    """Canonical form of JSON texts; null where a text has none."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else canonical(json.loads(v))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(value.cast("string"))


def rounded(value: Column, digits: int) -> Column:
    """Python's rounding of the exact binary value, half to even; Spark's round differs on ties."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    return run(value.cast("double"))


def basis_points(part: Column, whole: Column) -> Column:
    """Floored parts of 10,000; null for a zero denominator."""
    return F.floor(part * 10_000 / F.nullif(whole, F.lit(0))).cast("long")


def basis_points_up(part: Column, whole: Column) -> Column:
    """Parts of 10,000 rounded up, 10,000 at most; null for a zero denominator."""
    return F.least(F.ceil(part * 10_000 / F.nullif(whole, F.lit(0))), F.lit(10_000)).cast("long")
