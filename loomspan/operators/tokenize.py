"""Reversible tokenisation of spans inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import encode_fields, hmac_sha256
from ..functions.spans import detokenize, find_tokens, replace_spans, select_non_overlapping, token_type

TYPES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "DATE_TIME", "IP_ADDRESS", "CREDIT_CARD")
MAX_TOKENS = 1000


def tokenised(docs: DataFrame, salt: bytes, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """id, text, tokenised, mappings (token, entity_type, value; distinct).

    A token's id is a keyed hash of (document, type, value): equal values of a document share a token, and nothing links
    documents. The salt must be secret, fresh per run and unpersisted.
    """
    kept = select_non_overlapping(F.col(spans_col), F.col(text_col))
    ident = lambda s: F.substring(F.lower(F.hex(hmac_sha256(salt, encode_fields(F.col(id_col).cast("string").cast("binary"), s["entity_type"].cast("binary"), s["value"].cast("binary"))))), 1, 32)
    token = lambda s: F.concat(F.lit("<PII_"), s["entity_type"], F.lit(":"), ident(s), F.lit(">"))
    with_tokens = docs.withColumn("__kept", F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["entity_type"].alias("entity_type"), token(s).alias("token"))))
    mappings = F.array_distinct(F.transform("__kept", lambda s: F.struct(s["token"].alias("token"), s["entity_type"].alias("entity_type"), s["value"].alias("value"))))
    return with_tokens.select(id_col, text_col, replace_spans(F.col(text_col), F.col("__kept")).alias("tokenised"), mappings.alias("mappings"))


def mapping_rows(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, entity_type, value): one row per distinct value of a document."""
    return tokens.select(id_col, F.explode("mappings").alias("m")).select(id_col, "m.*")


def value_map(mappings):
    return F.map_from_entries(F.transform(mappings, lambda m: F.struct(m["token"], m["value"])))


def restored(tokens: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from tokens and mappings."""
    return tokens.withColumn("restored", detokenize(F.col("tokenised"), value_map(F.col("mappings"))))


def token_requests(texts: DataFrame, id_col: str = "doc_id", text_col: str = "tokenised") -> DataFrame:
    """Distinct well-formed tokens of known types of every text, and whether there are more than a request may hold."""
    known = F.filter(find_tokens(F.col(text_col)), lambda t: token_type(t, TYPES).isNotNull())
    return texts.select(id_col, known.alias("tokens")).withColumn("too_large", F.size("tokens") > MAX_TOKENS)
