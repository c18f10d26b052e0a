"""URL filter with a weighted vocabulary (operator 6).

An Aho-Corasick automaton finds the strict and soft terms in the lower-cased URL; a hit counts only between word
boundaries (no ASCII letter or digit beside it). One strict term, or SOFT_LIMIT distinct soft terms, rejects. Host and path rules
come before the vocabulary; the longest rule that fits wins.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

STRICT = ("porn", "xxx", "xvideos", "hentai", "camgirls", "escorts", "nsfw", "warez", "casino-bonus", "malware")
SOFT = ("adult", "sex", "nude", "casino", "betting", "poker", "viagra", "cialis", "torrent", "crack", "keygen", "hack", "loan", "payday", "dating", "webcam", "ads", "track", "tracker", "banner", "affiliate", "click", "popup", "sponsor")
SOFT_LIMIT = 2
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def automaton(strict=STRICT, soft=SOFT):
    auto = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            auto.add_word(t, (weight, t))
    auto.make_automaton()
    return auto


def vocabulary_hits(url: str, auto) -> tuple[int, int]:
    """Distinct (strict, soft) terms of a lower-cased URL that stand between boundaries."""
    strict, soft = set(), set()
    edge = lambda c: not (c.isascii() and c.isalnum())
    for end, (weight, term) in auto.iter(url):
        start = end - len(term)
        if (start < 0 or edge(url[start])) and (end + 1 == len(url) or edge(url[end + 1])):
            (strict if weight == 2 else soft).add(term)
    return len(strict), len(soft)


def url_filter(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Verdict of every URL: id, host, path, rule, n_strict, n_soft, verdict.

    Null URLs and those without ``://`` have an empty host and path, no rule, and are judged by the vocabulary alone
    (null: no terms, so allowed). Repeated rows give repeated results, an empty table gives none; URLs of any length are read whole.
    """
    kind = dict(df.dtypes)[id_col]
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.coalesce(F.expr("substring(u, length(s) + 4)"), F.lit(""))
    parts = df.select(F.col(id_col), url.alias("u"), rest.alias("s")).withColumn("after", after)
    parts = parts.select(
        id_col, low(F.col("u")).alias("u"),
        low(F.regexp_extract("after", r"(?s)\A([^/?#]*)([^?#]*)", 1)).alias("host"),
        F.regexp_extract("after", r"(?s)\A([^/?#]*)([^?#]*)", 2).alias("path"),
    )
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(order):
        v, h, p = rules[i]
        rule, verdict = F.when(fits[i], F.lit(h + p)).otherwise(rule), F.when(fits[i], F.lit(v)).otherwise(verdict)
    parts = parts.withColumns({"rule": rule, "by_rule": verdict})
    schema = f"{id_col} {kind}, host string, path string, rule string, by_rule string, n_strict long, n_soft long"
    held: list = []

    def run(batch):
        if not held:
            held.append(automaton(strict, soft))
        counts = [vocabulary_hits(u, held[0]) for u in batch.column("u").to_pylist()]
        return {c: batch.column(c) for c in (id_col, "host", "path", "rule", "by_rule")} | {"n_strict": [a for a, _ in counts], "n_soft": [b for _, b in counts]}

    method = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return map_batches(parts, run, schema).withColumn("verdict", F.coalesce("by_rule", method)).drop("by_rule")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_hits(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)


ORACLE = f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN ({_sql_hits(STRICT)}) >= 1 OR ({_sql_hits(SOFT)}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
