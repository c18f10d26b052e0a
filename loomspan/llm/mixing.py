"""Mixing sources to target weights (operator 3), with DataFrame functions only.

Targets: every source's weight share of all words, capped at ``max_repeat`` times the source, the excess shared out again
(water filling, in closed form over the sources sorted by the level at which they cap).

Drawing: documents fall into BLOCKS hashed blocks of their source. Every source contributes whole copies of all its blocks and, for
the remaining fraction, permuted blocks up to the word quota; the block in which the quota ends is split the same
way once more, and then document by document. The block copies are units of a splitting tree: at every node half of the
units is drawn without replacement, so the counts of the sources in the two halves follow the multivariate
hypergeometric distribution and are exact quotas. The leaves are output shards; each takes disjoint permuted
blocks by its quotas and shuffles its documents by hash. Only the units (sources x BLOCKS x copies, whatever the number of documents) pass through the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.predictions import dense_numbers
from .common import distinct_name, materialise, table

BLOCKS = 64
SHARD_LEVELS = 4  # 2 ** levels output shards
MAX_REPEAT = 3
WORD = r"[^\x20\x09-\x0D]+"
RANGE_BITS = 10  # of the hash ranges in which the units of a node are ranked
BROADCAST_ROWS = 500_000  # larger per-source tables are joined by shuffle


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are few."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hash(seed: str, *cols) -> F.Column:
    """60 bits of md5: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target from (source, size), for any number of sources.

    Sources are ranked in range partitions. The water level rises from everything shared by weight: sources that would go beyond their cap stop there and
    the rest shares what is left, until none is above; a pass is one sum over the sources.
    """
    per = materialise(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    named = per.where("source is not null")
    ranked = dense_numbers(named, "source").withColumnRenamed("source", "__source")
    ranked = named.join(ranked, F.col("source") == F.col("__source")).select("source", "source_size", "line")
    ranked = ranked.union(per.where("source is null").select("source", "source_size", F.lit(named.count()).cast("long")))
    cycle = F.expr(f"get(array({', '.join(f'{w}D' for w in weights)}), cast(line % {len(weights)} as int))")
    levels = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("level", F.col("cap") / F.col("weight"))
    levels = materialise(levels.select("source", "source_size", "weight", "cap", "level"))
    total, full, lake = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], -1, None
    while True:
        below = F.col("level") < (F.lit(-1.0) if lake is None else F.lit(lake))
        count, capped, weight = levels.agg(F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0.0))).first()
        if count == full or not weight:
            break
        full, lake = count, (total - capped) / weight
    return levels.select("source", "source_size", F.when(F.col("level") >= F.lit(lake), F.col("weight") * F.lit(lake)).otherwise(F.col("cap")).alias("target"))


def splitting_tree(units: DataFrame, levels: int = SHARD_LEVELS, seed: str = "tree") -> DataFrame:
    """(source_key, shard, quota): how many block copies of every source every shard gets.

    At every node the half of its units with the smaller hashes goes left. Units are ranked within hash ranges, and the ranges' counts (RANGES rows per
    node) are summed up before, so that no task sorts a node's units.
    """
    node = materialise(units.select("source_key", "block", "copy", F.lit(0).alias("shard")))
    keys = ("source_key", "block", "copy")
    for level in range(levels):
        h = _hash(f"{seed}{level}", F.col("source_key"), F.col("block").cast("string"), F.col("copy").cast("string"))
        hashed = node.withColumn("h", h).withColumn("range", F.shiftright("h", 60 - RANGE_BITS))
        upto = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counts = hashed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("shard")).alias("size"))
        inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", *keys))
        ranked = hashed.join(F.broadcast(counts), ["shard", "range"])  # at most 2 ** (levels + RANGE_BITS) rows
        right = ((inside + F.col("before")) * 2 > F.col("size")).cast("int")
        node = materialise(ranked.withColumn("right", right).select(*keys, (F.col("shard") * 2 + F.col("right")).alias("shard")))
    return node.groupBy("source_key", "shard").agg(F.count(F.lit(1)).alias("quota"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_repeat: int = MAX_REPEAT, blocks: int = BLOCKS, levels: int = SHARD_LEVELS, seed: str = "mix") -> DataFrame:
    """Per row: size, source_size, target, copies (0 .. max_repeat), taken, block and shards (one per copy).

    Null texts and texts without words have size 0; a null source is a source of its own, last in order. A source without words has
    target 0 and gives no copies. Rows that repeat with all of id and text are one row to the draw and share its fate, so the
    taken words may then miss the target by their size. An empty table gives an empty plan.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("source_key"), size.alias("size"), _hash(seed, ident).alias("h"))
    rows = materialise(rows.withColumn("block", (F.col("h") % blocks).cast("int")).withColumn("part", (F.expr(f"h div {blocks}") % blocks).cast("int")))
    targets = source_targets(rows, weights, max_repeat).withColumn("source_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    targets = targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = targets.withColumn("base", F.floor(F.col("ratio") + 1e-12).cast("int")).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))).drop("source")
    targets = _small(targets)
    # blocks in permuted order take the extra words; the last one in part
    sums = materialise(rows.groupBy("source_key", "block", "part").agg(F.sum("size").alias("words")))
    order = _hash(seed + "block", F.col("source_key"), F.col("block").cast("string"))
    whole = Window.partitionBy("source_key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = sums.groupBy("source_key", "block").agg(F.sum("words").alias("words")).withColumn("turn", order)
    per_block = per_block.withColumn("before", F.coalesce(F.sum("words").over(whole), F.lit(0))).join(targets, "source_key")
    left = F.col("extra") - F.col("before")
    per_block = per_block.withColumn("fill", F.when(left >= F.col("words"), 1.0).when(left <= 0, 0.0).otherwise(2.0)).withColumn("left", left)
    split = per_block.where("fill = 2").select("source_key", "block", "left")
    inner = Window.partitionBy("source_key", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.join(split, ["source_key", "block"]).withColumn("before", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    rest = F.col("left") - F.col("before")
    parts = parts.select("source_key", "block", "part", F.when(rest >= F.col("words"), 1).when(rest <= 0, 0).otherwise(2).alias("part_fill"), rest.alias("part_left"))
    units = per_block.select("source_key", "block", "turn", F.explode(F.sequence(F.lit(1), F.col("base") + F.when(F.col("fill") > 0, 1).otherwise(0))).alias("copy")).where("copy > 0 and copy <= base + if(fill > 0, 1, 0)")
    quotas = splitting_tree(units, levels, seed)
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    quotas = quotas.withColumn("last", F.sum("quota").over(upto)).withColumn("first", F.col("last") - F.col("quota") + 1)
    nth = F.row_number().over(Window.partitionBy("source_key").orderBy("copy", "turn", "block"))
    placed = units.withColumn("nth", nth).join(quotas, "source_key").where("nth >= first and nth <= last").select("source_key", "block", "copy", "shard")
    placed = placed.groupBy("source_key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("block_shards"))
    lookup = _small(per_block.select("source_key", "block", "source_size", "target", "base", "fill").join(placed, ["source_key", "block"], "left"))
    # sources x BLOCKS rows: a bound that no document count moves
    planned = rows.join(lookup, ["source_key", "block"], "left").join(_small(parts), ["source_key", "block", "part"], "left")
    edge = planned.where("fill = 2 and part_fill = 2").select("source_key", "block", "part", "id", "h", "size", "part_left")
    # one sixty-fourth of one sixty-fourth of a source: the only documents that are sorted. Those taken come first in the order
    chain = Window.partitionBy("source_key", "block", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken_last = (
        edge.withColumn("before", F.coalesce(F.sum("size").over(chain), F.lit(0))).where(F.col("part_left") - F.col("before") >= F.col("size") / 2)
        .groupBy("source_key", "block", "part").agg(F.max("h").alias("cutoff"))
    )
    planned = planned.join(_small(taken_last), ["source_key", "block", "part"], "left")
    take = F.when(F.col("fill") == 1, 1).when((F.col("fill") == 2) & (F.col("part_fill") == 1), 1).when((F.col("fill") == 2) & (F.col("part_fill") == 2) & (F.col("h") <= F.col("cutoff")), 1).otherwise(0)
    copies = F.when(F.coalesce(F.col("source_size"), F.lit(0)) > 0, F.col("base") + take).otherwise(0)
    return planned.withColumn("copies", copies.cast("int")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "block", "h",
        F.when(F.col("copies") > 0, F.slice("block_shards", 1, F.greatest(F.col("copies"), F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)")).alias("shards"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: one row per copy, all columns of ``df`` unchanged, with copy, shard and shuffle_key, which orders the shard's local shuffle.

    Where ``df`` has columns of these names, the mix's own get underscores before theirs. Rows that repeat an id share its copies; an empty table gives no rows.
    """
    plan = mix_plan(df, id_col=id_col, **options)
    ident, draw = distinct_name(df.columns, "__id"), distinct_name(df.columns, "__draw")
    drawn = plan.where("copies > 0").select(F.col(id_col).alias(ident), "h", F.posexplode("shards").alias("copy", "shard")).dropDuplicates([ident, "copy"])
    drawn = drawn.select(ident, F.struct("copy", "shard", _hash("local", F.col("shard").cast("string"), F.col("copy").cast("string"), F.col("h").cast("string")).alias("shuffle_key")).alias(draw))
    out = df.join(drawn, df[id_col].eqNullSafe(drawn[ident]))
    return out.select(*(df[c] for c in df.columns), *(F.col(f"{draw}.{c}").alias(distinct_name(df.columns, c)) for c in ("copy", "shard", "shuffle_key")))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))
