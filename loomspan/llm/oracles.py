"""DuckDB SQL of the operators that SQL can express."""

from . import mixing, urls

_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _mix_sql(blocks: int = mixing.BLOCKS, levels: int = mixing.SHARD_LEVELS, cap: int = mixing.MAX_REPEAT) -> str:
    tree = ["t0 AS (SELECT source_key, block, copy, 0 AS shard FROM units)"]
    for k in range(levels):
        h = _H.format(f"'mix{k}:' || source_key || ':' || block || ':' || copy")
        tree.append(f"t{k + 1} AS (SELECT source_key, block, copy, shard * 2 + CAST(row_number() OVER (PARTITION BY shard ORDER BY {h}, source_key, block, copy) * 2 > count(*) OVER (PARTITION BY shard) AS INT) AS shard FROM t{k})")
    return f"""
WITH r AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {_H.format("'mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS h FROM documents),
rows_ AS (SELECT *, CAST(h % {blocks} AS INT) AS block, CAST((h // {blocks}) % {blocks} AS INT) AS part FROM r),
per AS (SELECT source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank FROM per),
weighted AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * CAST({cap} AS DOUBLE) AS cap FROM ranked),
filled AS (SELECT *, cap / weight AS level, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS before_cap, coalesce(sum(weight) OVER w, 0) AS before_weight FROM weighted
    WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rise AS (SELECT *, (total - before_cap) / (all_weight - before_weight) AS water FROM filled),
lake AS (SELECT *, max(CASE WHEN level >= water THEN water END) OVER () AS lake FROM rise),
targets AS (SELECT source_key, source_size, CASE WHEN level >= lake THEN weight * lake ELSE cap END AS target FROM lake),
based AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS INT) AS base FROM targets),
goal AS (SELECT *, greatest(0.0, target - base * source_size) AS extra FROM based),
sums AS (SELECT source_key, block, part, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY ALL),
blocks_ AS (SELECT source_key, block, CAST(sum(words) AS BIGINT) AS words, {_H.format("'mixblock:' || source_key || ':' || block")} AS turn FROM sums GROUP BY source_key, block),
ahead AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source_key ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks_),
per_block AS (SELECT a.*, g.source_size, g.target, g.base, g.extra - a.before AS left_, CASE WHEN g.extra - a.before >= a.words THEN 1 WHEN g.extra - a.before <= 0 THEN 0 ELSE 2 END AS fill FROM ahead a JOIN goal g USING (source_key)),
inner_ AS (SELECT s.*, b.left_ - coalesce(sum(s.words) OVER (PARTITION BY source_key, block ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM sums s JOIN (SELECT source_key, block, left_ FROM per_block WHERE fill = 2) b USING (source_key, block)),
parts AS (SELECT source_key, block, part, rest AS part_left, CASE WHEN rest >= words THEN 1 WHEN rest <= 0 THEN 0 ELSE 2 END AS part_fill FROM inner_),
units AS (SELECT source_key, block, turn, CAST(unnest(range(1, CAST(base + CASE WHEN fill > 0 THEN 1 ELSE 0 END + 1 AS BIGINT))) AS INT) AS copy FROM per_block),
{", ".join(tree)},
quotas AS (SELECT source_key, shard, sum(quota) OVER (PARTITION BY source_key ORDER BY shard ROWS UNBOUNDED PRECEDING) AS last, sum(quota) OVER (PARTITION BY source_key ORDER BY shard ROWS UNBOUNDED PRECEDING) - quota + 1 AS first
    FROM (SELECT source_key, shard, count(*) AS quota FROM t{levels} GROUP BY ALL)),
placed AS (SELECT u.source_key, u.block, list(q.shard ORDER BY u.copy) AS block_shards FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY copy, turn, block) AS nth FROM units) u
    JOIN quotas q ON u.source_key = q.source_key AND u.nth BETWEEN q.first AND q.last GROUP BY ALL),
edge AS (SELECT r.*, p.part_left - coalesce(sum(r.size) OVER (PARTITION BY r.source_key, r.block, r.part ORDER BY r.h, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM rows_ r JOIN parts p USING (source_key, block, part) WHERE p.part_fill = 2),
cut AS (SELECT source_key, block, part, max(h) AS cutoff FROM edge WHERE room >= size / 2 GROUP BY ALL),
planned AS (SELECT r.*, b.source_size, b.target, b.base, s.block_shards, CASE WHEN b.source_size > 0 THEN b.base + CASE WHEN b.fill = 1 OR (b.fill = 2 AND (p.part_fill = 1 OR (p.part_fill = 2 AND r.h <= c.cutoff))) THEN 1 ELSE 0 END ELSE 0 END AS copies
    FROM rows_ r JOIN per_block b USING (source_key, block) LEFT JOIN placed s USING (source_key, block) LEFT JOIN parts p USING (source_key, block, part) LEFT JOIN cut c USING (source_key, block, part))
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CASE WHEN copies > 0 THEN array_to_string(block_shards[1:copies], ',') ELSE '' END AS shards FROM planned
"""


def _decontamination_sql() -> str:
    low = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {low} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, CAST(least(len(w), 13) AS INT) AS n, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


ORACLES = {"op3_mix": _mix_sql(), "op5_decontaminate": _decontamination_sql(), "op6_url_filter": urls.ORACLE}
