"""Length-prefixed encoding, HMAC-SHA256 and envelope encryption as column expressions.

Keys enter plans as literals: redact them (``spark.sql.redaction.string.regex``) and never print such plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE, TAG, KEY = 12, 16, 32
FORMAT_VERSION = 1
DOMAIN = b"loomspan/vault"
HASH_DOMAIN = b"loomspan/token-hash"
WRAP_DOMAIN = b"loomspan/data-key"


def raw(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def encode_fields(*fields: Column) -> Column:
    """Every field with its length as four bytes before it, so that different fields never encode alike."""
    parts = []
    for f in fields:
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), f.cast("binary")]
    return F.concat(*parts)


def pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, message: Column) -> Column:
    inner, outer = pads(key)
    return F.unhex(F.sha2(F.concat(raw(outer), F.unhex(F.sha2(F.concat(raw(inner), message), 256))), 256))


def uuid_bytes(uuid: Column) -> Column:
    return F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))


def token_hash(key: bytes, tenant: Column, token: Column) -> Column:
    return hmac_sha256(key, encode_fields(raw(HASH_DOMAIN), uuid_bytes(tenant), token.cast("binary")))


def associated_data(tenant: Column, hashed: Column, entity_type: Column, version: Column) -> Column:
    return encode_fields(raw(DOMAIN), version.cast("string").cast("binary"), uuid_bytes(tenant), hashed, entity_type.cast("binary"))


def wrap_data(key_id: Column, aad: Column) -> Column:
    return encode_fields(raw(WRAP_DOMAIN), key_id.cast("binary"), aad)


def seal(value: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """nonce, ciphertext and tag of AES-256-GCM."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    """The value, or null if anything does not fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
