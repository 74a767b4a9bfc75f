"""HMAC and tokens as SQL for either dialect, AES columns for Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.dialect import Duck, Spark

TOKEN = r"<[A-Z][A-Z_]*_[0-9a-f]{32}>"


def _blob(d: Spark, raw: bytes) -> str:
    return f"unhex('{raw.hex()}')" if isinstance(d, Duck) else f"X'{raw.hex()}'"


def _utf8(d: Spark, s: str) -> str:
    return f"encode({s})" if isinstance(d, Duck) else f"encode({s}, 'UTF-8')"


def _sha(d: Spark, b: str) -> str:
    return f"unhex(sha256({b}))" if isinstance(d, Duck) else f"unhex(sha2({b}, 256))"


def hmac_sql(d: Spark, key: bytes, message: str) -> str:
    """HMAC-SHA-256 of a blob under a fixed key of at most 64 bytes."""
    pad = key.ljust(64, b"\0")
    inner, outer = (_blob(d, bytes(x ^ k for x in pad)) for k in (0x36, 0x5C))
    return _sha(d, f"({outer} || {_sha(d, f'({inner} || {message})')})")


def _keyed(d: Spark, key: bytes, domain: bytes, s: str) -> str:
    return hmac_sql(d, key, f"({_blob(d, domain)} || {_utf8(d, s)})")


def slot_token_sql(d: Spark, key: bytes, seed: str, scope: str, kind: str, value: str, suffix_bytes: int = 16) -> str:
    """The token of a slot: its type and the first bytes of a code of its seed, scope, type and value."""
    suffix = hmac_sql(d, key, f"({_blob(d, b'token' + bytes(1))} || {seed} || {_keyed(d, key, b'scope' + bytes(1), scope)} || {_utf8(d, kind)} || {_keyed(d, key, b'value' + bytes(1), value)})")
    return f"('<' || {kind} || '_' || lower(substr(hex({suffix}), 1, {2 * suffix_bytes})) || '>')"


def token_sql(d: Spark, key: bytes, scope: str, kind: str, value: str) -> str:
    """The token of (scope, type, value): its seed comes from the key, so equal values of a scope get equal tokens and scopes stay apart."""
    return slot_token_sql(d, key, _keyed(d, key, b"seed" + bytes(1), f"({scope} || chr(0) || {kind} || chr(0) || {value})"), scope, kind, value)


def seal(value: Column, key: bytes, aad: Column, iv: Column | None = None) -> Column:
    """AES-GCM with the associated data; a fresh nonce unless one is given."""
    return F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), *([iv, aad] if iv is not None else [F.lit(bytearray()), aad]))


def unseal(sealed: Column, key: bytes, aad: Column) -> Column:
    """The value, or null where key, data or associated data are not those it was sealed with."""
    return F.try_aes_decrypt(sealed, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
