"""Keyed digests and tokens, and functions under SQL names; all of built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import columns as C


def pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and outer block that HMAC-SHA256 makes of a key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


def hmac_hex(body, secret: str) -> Column:
    """Hex HMAC-SHA256 of each body; of null, null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(secret))
    column = body if isinstance(body, Column) else F.col(body)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, column.cast("binary")), 256))), 256)


def _same(expected: Column, given: Column, secret: str) -> Column:
    """Equality of what only the digests of both are compared for, so that the time taken
    says nothing about the expected text."""
    return F.coalesce(hmac_hex(expected, secret) == hmac_hex(given, secret), F.lit(False))


def signature_holds(body, signature, secret: str) -> Column:
    """Whether a body's signature is this one; a missing one doesn't hold."""
    return _same(hmac_hex(body, secret), signature if isinstance(signature, Column) else F.col(signature), secret)


def payment_signature_holds(order_id, payment_id, signature, secret: str) -> Column:
    return signature_holds(F.concat_ws("|", order_id, payment_id), signature, secret)


def _url64(raw: Column) -> Column:
    # base64 may be parted into lines
    return F.translate(F.base64(raw), "+/=\r\n", "-_")


def upload_token(payload, secret: str) -> Column:
    """``payload`` (a struct) as JSON in base64url, a dot, and its signature."""
    raw = _url64(F.to_json(payload).cast("binary"))
    return F.concat(raw, F.lit("."), _url64(F.unhex(hmac_hex(raw, secret))))


def token_payload(token, secret: str, now_ms: int) -> Column:
    """The payload of a token that is signed and not past its time, else null."""
    parts = F.split(token if isinstance(token, Column) else F.col(token), r"\.")
    raw, signature = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    holds = (raw != "") & (signature != "") & _same(_url64(F.unhex(hmac_hex(raw, secret))), signature, secret)
    whole = F.concat(F.translate(raw, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4))))
    payload = F.from_json(F.when(holds, F.unbase64(whole).cast("string")), schema.UPLOAD_TOKEN)
    return F.when(payload["expiresAt"] >= now_ms, payload)


def register(spark) -> None:
    """SQL names for the functions that users call."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS INT RETURN CAST(ceil(length(t) / 4) AS INT)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION sanitize_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, r'(?U)[\s﻿&&[^\u0085]]+', ' '))")
    trimmed = f"regexp_replace(coalesce(t, ''), r'(?U)^{C.BLANK}+|{C.BLANK}+$', '')"
    lacks = lambda name: f"NOT rlike({trimmed}, r'(?i)(^|\\n)#{{0,3}}(?U:{C.BLANK})*{name}(?![A-Za-z0-9_])')"
    added = [f"CASE WHEN {lacks('Answer')} THEN '{C.ANSWER}' ELSE '' END", trimmed, f"CASE WHEN {lacks('Key Points')} THEN '{C.KEY_POINTS}' ELSE '' END", f"CASE WHEN looked_up AND {lacks('Sources')} THEN '{C.SOURCES}' ELSE '' END"]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ensure_structured_answer(t STRING, looked_up BOOLEAN) RETURNS STRING RETURN CASE WHEN {trimmed} = '' THEN '' ELSE concat({', '.join(added)}) END")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN try_divide({dot.format('a', 'b')}, sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}))")
