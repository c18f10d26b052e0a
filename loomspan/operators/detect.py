"""Detectors: native recognisers as expressions, and an Arrow adapter for external models."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ontology import LABEL
from ..functions.spans import SPAN, chunk_plan, regex_spans, span_function


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", value)


# Fixed order: where several recognisers match at one place, the first one counts. ASCII classes only: every engine agrees on them.
RECOGNISERS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone_number": r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "api_key": r"AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}\"",
    "password": r"password=[0-9a-f]+",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}",
    "time": r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "credit_debit_card": r"[0-9]{16}",
    "city": r"(?:City|Port|Mount|Lake|Ciudad|Ville|Stadt) (?:of |de |von )?[A-Z][a-z]+",
    "first_name": r"[A-Z][a-z]+ [A-Z][a-z]+",
}
PATTERN = "|".join(RECOGNISERS.values())
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
OTHERS = re.compile("|".join(v for k, v in RECOGNISERS.items() if k != "email"))


def recognise(text: str):
    """(start, end) of all matches of PATTERN as a leftmost search finds them, in linear time: addresses are read backwards from their @."""
    pos, at, mail = 0, text.find("@"), None
    hit = OTHERS.search(text)
    while True:
        while at >= 0 and (mail is None or at <= pos):
            mail = None
            if at < pos:
                at = text.find("@", pos)
                continue
            begin = at
            while begin > pos and text[begin - 1] in LOCAL:
                begin -= 1
            domain = DOMAIN.match(text, at) if begin < at else None
            if domain:
                mail = (begin, domain.end())
                break
            at = text.find("@", at + 1)
        start = max(mail[0], pos) if mail else -1
        if hit and (mail is None or hit.start() < start):
            yield hit.span()
            pos = hit.end()
        elif mail:
            yield start, mail[1]
            pos, mail = mail[1], None
            at = text.find("@", pos)
        else:
            return
        if hit and hit.start() < pos:
            hit = OTHERS.search(text, pos)


def match_spans(text: Column) -> Column:
    """All recogniser matches as (start, end, value)."""
    return span_function(recognise)(text)


def matched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts that have any match: example_index, text, found; one scan."""
    found = span_function(recognise, repeatable=False)(F.col(text_col))
    return docs.select(F.col(id_col).alias("example_index"), F.col(text_col).alias("text"), found.alias("found")).where(F.size("found") > 0)


def native_label(value: Column) -> Column:
    """The recogniser that a match is from, told by its shape."""
    return (
        F.when(value.contains("@"), "email").when(value.startswith("+"), "phone_number").when(value.startswith("AKIA") | value.startswith("token ="), "api_key")
        .when(value.startswith("password="), "password").when(value.rlike("^[A-Z]"), F.when(value.rlike("[0-9]"), "date").when(value.rlike("^" + RECOGNISERS["city"]), "city").otherwise("first_name"))
        .when(value.contains(":"), "time").when(value.rlike("[-/]"), "date").when(value.contains("."), "ipv4").otherwise("credit_debit_card")
    )


def gazetteer_spans(text: Column, names: tuple[str, ...]) -> Column:
    """Whole-word occurrences of listed names, the longest first; a gazetteer of some thousand names, compiled once per worker."""
    pattern = r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n))) + r")(?!\w)"
    return regex_spans(text, pattern) if names else F.expr(f"cast(array() as {SPAN})")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every recogniser match: example_index, label, start, end, value, length of the text; offsets in code points."""
    hits = docs.select(F.col(id_col).alias("example_index"), *keep, F.length(text_col).alias("length"), F.explode(match_spans(F.col(text_col))).alias("s"))
    return hits.select("example_index", *keep, "length", native_label(F.col("s.value")).alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates that pass their check digit."""
    return candidates(docs, id_col, text_col, keep).where((F.col("label") != "credit_debit_card") | luhn(F.col("value")))


def with_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 384, margin: int = 24) -> DataFrame:
    """One row per chunk of every text: example_index, the plan's columns, and the chunk's text."""
    plain = docs.select(F.col(id_col).alias("example_index"), F.col(text_col).alias("__text"))
    planned = plain.select("example_index", "__text", F.explode(chunk_plan(F.col("__text"), max_words, margin)).alias("c"))
    return planned.select("example_index", "c.*", F.substring("__text", F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start")).alias("chunk_text"))


def model_identity(spark, folder: str, max_width: int, revision: str) -> dict:
    """What a model is: its revision, span width and the digest of every file."""
    from ..sources.identity import digest, file_sha256

    held = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in file_sha256(spark, folder).select("path", "sha256").collect()}
    return {"revision": revision, "max_width": max_width, "files": held, "sha256": digest(held)}


def loader_of(build: Callable[[int], object], max_width: int):
    """A loader for ``run_model``: builds a model of the asked span width and refuses one that reports another."""

    def load():
        model = build(max_width)
        if getattr(model, "max_width", max_width) != max_width:
            raise ValueError("the loaded model has another span width than the one asked for")
        return model

    return load


def run_model(
    docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int, float]]]]], id_col: str = "doc_id", text_col: str = "text", max_words: int = 384, margin: int = 24, batch: int = 32,
    labels: tuple[str, ...] | None = None,
) -> DataFrame:
    """Predictions of an external model: example_index, label, start, end, score, copies. ``load`` runs once per task and returns a function from texts to (label, start, end, score) lists.

    Long texts are chunked; chunks are sorted by length inside their Arrow batch so that a model batch wastes little padding; offsets are shifted
    back, each prediction is kept by the chunk that owns its start, and of duplicates the best score stays (``copies`` counts them). A model that
    answers with another number of lists than it was asked, a label outside ``labels`` or a span outside its chunk fails the query.
    """
    chunks = with_chunks(docs, id_col, text_col, max_words, margin)
    kind = dict(chunks.dtypes)["example_index"]
    known = None if labels is None else frozenset(labels)

    def run(batches):
        model = None
        for b in batches:
            if not b.num_rows:
                continue
            model = model or load()
            rows = b.to_pylist()
            out = {k: [] for k in ("example_index", "label", "start", "end", "score")}
            rows.sort(key=lambda r: -len(r["chunk_text"] or ""))
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                answers = model([r["chunk_text"] or "" for r in part])
                if len(answers) != len(part):
                    raise ValueError("the model returned another number of results than it was given texts")
                for r, found in zip(part, answers, strict=True):
                    for label, start, end, score in found:
                        s, e = start + r["char_start"], end + r["char_start"]
                        if not (0 <= start < end and e <= r["char_end"] and 0 <= score <= 1):
                            raise ValueError("the model returned an invalid prediction")
                        if not LABEL.fullmatch(label) or known is not None and label not in known:
                            raise ValueError("the model returned an unknown label")
                        if r["own_start"] <= s < r["own_end"]:
                            for k, v in zip(out, (r["example_index"], label, s, e, float(score)), strict=True):
                                out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"example_index {kind}, label string, start int, end int, score double"
    target = to_arrow_schema(StructType.fromDDL(schema))
    raw = chunks.mapInArrow(run, schema)
    return raw.groupBy("example_index", "label", "start", "end").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("copies"))
