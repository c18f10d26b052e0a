"""Near-duplicate classes from bottom-k sketches of one hash function (operator 2).

1. Every text becomes the set of its word shingles' 64-bit hashes; equal sets form one node, so copies cost one row.
2. A node keeps the SKETCH smallest hashes; the INDEX smallest of them enter inverted lists. Two sets with similarity t share about t of
   the smallest hashes of their union, so linked nodes share at least ``needed`` indexed values (five standard deviations
   below the mean, without replacement; exact for sets that the sketch holds whole). Nodes with fewer shared values cannot link and
   leave here; of the others only the rarest values that the prefix principle requires stay in the lists, which keeps
   common passages out of them.
3. Star rounds: in every list the node with the most common values is the pivot and all others are compared with it; what is still in
   different components gets another pivot, ROUNDS times in all. Components shrink the large groups of near copies before any pair is listed.
   Last round: what is left in lists of up to LONG_LIST nodes is compared pair by pair, each pair at its first common value. In longer lists the sets are
   described by their difference to the first pivot: of two that link, at least one is beyond the threshold from the pivot, hence they share a
   known number of elements of these differences, and only nodes with a common element in the rare part of the differences that this requires
   meet (the prefix principle again, on what sets a group's members apart). Bit maps of the sets, whose differing bits are differing elements, rule out the rest
   before it becomes a row. No list is capped.
4. Pairs pass the union-sketch estimate and are then confirmed on the full sets.
5. Components by minimum labels with pointer jumping, distributed; nothing but counts reaches the driver.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.store import fresh_folder, remove
from .common import map_batches, map_partitions, materialise, pieces, table, text_of

SHINGLE, PERCENT = 3, 85
INDEX, SKETCH = 48, 160
SIGMAS = 5.0
ROUNDS = 1  # star rounds
LONG_LIST = 64  # longer lists are joined on differences to their pivot instead of on their value
WORDS = 16  # 64-bit words of a set's bit map
BROADCAST_NODES = 1_000_000  # ids shipped to filter the documents that full sets are built from (8 bytes each)
WORD_CACHE = 300_000
BROADCAST_LABELS, ROWS_PER_TASK = 200_000, 4_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def shingle_set(text: bytes, size: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes (below 2**63) of the word shingles; fewer words than ``size`` form one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > WORD_CACHE:
        cache.clear()
    hashes = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(size, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            acc = (acc ^ h[k : k + n]) * _MIX[0]
            acc ^= acc >> np.uint64(29)
            acc *= _MIX[1]
        acc ^= acc >> np.uint64(32)
        acc *= _MIX[2]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc >> np.uint64(1))


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, node (key of the set), n, sketch of every row; node is null for empty sets and null ids."""

    def run(batches):
        cache: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            nodes, ns, sketches = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t, size, cache)
                ns.append(len(s))
                linked = len(s) and i is not None
                nodes.append(node_key(s) if linked else None)
                sketches.append(s[:SKETCH].astype(np.int64) if linked else None)
            yield {"id": b.column(0), "node": nodes, "n": ns, "sketch": sketches}

    return map_partitions(df.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary")), run, "id long, node long, n long, sketch array<long>")


def node_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _deviation(m: float, n, p: float):
    """SIGMAS standard deviations of the shared count among ``m`` hashes drawn without replacement from a union of about n / p."""
    return SIGMAS * F.sqrt(F.lit(m * p * (1 - p)) * F.greatest(F.lit(0.0), 1 - m * p / n))


def needed(n, p: float):
    """Indexed values that a node of n hashes shares with every node linked to it."""
    small = F.ceil(n * p)  # both sets whole in the index
    mixed = F.floor(F.lit(INDEX * p) - _deviation(INDEX, n, p))
    return F.greatest(F.lit(1), F.when(n / p <= INDEX, small).when(n <= INDEX, F.least(small, mixed, F.floor(n * p - SIGMAS))).otherwise(mixed)).cast("int")


def estimate(pairs: DataFrame, p: float) -> DataFrame:
    """Keeps the pairs whose union sketch allows similarity p; ``certain`` marks those decided exactly, the sketches being whole sets."""
    common = F.size(F.array_intersect("sk_a", "sk_b"))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    limit = F.least(F.when(F.col("n_a") > SKETCH, F.element_at("sk_a", -1)), F.when(F.col("n_b") > SKETCH, F.element_at("sk_b", -1)))
    below = lambda c: F.size(F.filter(c, lambda v: v <= F.col("__limit")))
    pairs = pairs.withColumn("certain", whole).withColumn("__limit", F.when(whole, F.lit(2**63 - 1)).otherwise(limit)).withColumn("__common", common)
    pairs = pairs.withColumn("__union", below("sk_a") + below("sk_b") - F.col("__common"))
    pairs = pairs.withColumn("jaccard", F.col("__common") / F.col("__union"))
    slack = F.when(F.col("certain"), F.lit(0.0)).otherwise(_deviation(SKETCH, F.greatest("n_a", "n_b").cast("double"), p) / SKETCH)
    exact = F.lit(100) * F.col("__common") >= F.lit(round(100 * p)) * F.col("__union")
    return pairs.where(F.when(F.col("certain"), exact).otherwise(F.col("jaccard") >= p - slack)).select("a", "b", "certain", "jaccard")


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b) by exact similarity of the full sets, rebuilt from the texts of the nodes concerned only."""
    wanted = compact(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep"), "node"))
    n = wanted.count()
    if not n:
        return pairs.select("a", "b")
    ids = wanted.select(F.col("rep").alias("__rep")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).cast("binary").alias("__text")).join(F.broadcast(ids) if n <= BROADCAST_NODES else ids, F.col("__id") == F.col("__rep"), "left_semi")

    def run(batches):
        cache: dict = {}
        for b in batches:
            if b.num_rows:
                sets = [shingle_set(t, size, cache) for t in b.column(0).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield {"node": [node_key(s) for s in sets], "set": [s.tobytes() for s in sets]}

    sets = map_partitions(texts.select("__text"), run, "node long, set binary").join(F.broadcast(wanted.select("node")) if n <= BROADCAST_NODES else wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
    sets = materialise(sets)
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def check(batch):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= percent * (len(s) + len(t) - common))
        return {"a": [v for v, k in zip(a, keep, strict=True) if k], "b": [v for v, k in zip(b, keep, strict=True) if k]}

    return map_batches(both, check, "a long, b long")


def compact(df: DataFrame) -> DataFrame:
    """Written out, and read in partitions of about ROWS_PER_TASK rows: what a round leaves is small, and so should be the number of its tasks."""
    out = materialise(df)
    return out.coalesce(out.count() // ROWS_PER_TASK + 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with label the smallest node of the component, for every node that has an edge.

    Labels of up to BROADCAST_LABELS nodes (16 bytes each) are broadcast and kept in few partitions, larger ones are joined by shuffle.
    """
    both = compact(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    n, before = labels.agg(F.count(F.lit(1)), _sum(F.col("label"))).first()
    small = n <= BROADCAST_LABELS
    few = (lambda df: df.coalesce(n // ROWS_PER_TASK + 1)) if small else lambda df: df
    hint = F.broadcast if small else lambda df: df
    labels = few(labels)
    while True:
        told = both.join(hint(labels), both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        nearest = few(told.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = materialise(nearest.join(hint(up), "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label")))
        del told, nearest, up
        release(edges.sparkSession)
        after = labels.agg(_sum(F.col("label"))).first()[0]  # labels only fall: the same sum is the same labels
        if after == before:
            return labels
        before = after


def _sum(label):
    return F.sum(label.cast("decimal(28,0)"))


def bit_maps(nodes: DataFrame) -> DataFrame:
    """node, m0 and on: a bit map of every set that its sketch holds whole. A bit that differs between two maps is at least one element that differs."""

    def run(batch):
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        slots = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64(64 * WORDS - 1)
        maps = np.zeros((batch.num_rows, WORDS), np.uint64)
        np.bitwise_or.at(maps, (np.repeat(np.arange(batch.num_rows), sizes), (slots >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slots & np.uint64(63)))
        return {"node": batch.column(0)} | {f"m{k}": maps[:, k].astype(np.int64) for k in range(WORDS)}

    return map_batches(nodes.select("node", "sketch"), run, "node long, " + ", ".join(f"m{k} long" for k in range(WORDS)))


def maps_allow(percent: int):
    """Whether two whole sets may be similar enough by the differing bits of their maps; true where a set is larger than its sketch."""
    bits = sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(WORDS)), F.lit(0))
    return (F.greatest("n_a", "n_b") > SKETCH) | ((100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def difference_pairs(members: DataFrame, facts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that may link, among the members (pivot, node) of every pivot's group.

    With D the difference of a set to the pivot P, q = (100 - percent) / (100 + percent) and n the sizes, sets A and B link if the difference of D(A)
    and D(B) has at most q * (n(A) + n(B)) elements. If B is beyond the threshold from P, more than q * (n(B) + n(P)) elements are in D(B), so A and B share
    more than (D(A) + q * (n(P) - n(A))) / 2 of them. Members within the threshold from P are in its component: one of the two is always beyond. A's prefix are the
    rarest elements of D(A) of which one at least must then be in D(B), and in B's own prefix if A is beyond the threshold as well.
    """
    sets = nodes.select("node", "n", "sketch")
    pivot_sets = sets.select(F.col("node").alias("pivot"), F.col("n").alias("n_p"), F.col("sketch").alias("sketch_p"))
    apart = F.concat(F.array_except("sketch", "sketch_p"), F.array_except("sketch_p", "sketch"))
    d = members.join(sets, "node").join(pivot_sets, "pivot").select("pivot", "node", "n", "n_p", apart.alias("d"))
    d = compact(d.withColumn("beyond", (100 + percent) * F.size("d") > (100 - percent) * (F.col("n") + F.col("n_p"))))
    counts = d.select("pivot", F.explode("d").alias("v")).groupBy("pivot", "v").agg(F.count(F.lit(1)).alias("c"))
    # an element that one member alone has cannot be shared, but it takes a place in the prefix
    shared = d.select("pivot", "node", F.explode("d").alias("v")).join(counts.where("c > 1"), ["pivot", "v"])
    ordered = shared.groupBy("pivot", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("shared"))
    least = F.floor(((100 + percent) * F.size("d") + (100 - percent) * (F.col("n_p") - F.col("n"))) / (2 * (100 + percent))) + 1
    length = F.size("d") - least + 1 - (F.size("d") - F.size("shared"))
    keyed = d.join(ordered, ["pivot", "node"]).select("pivot", "node", "n", "beyond", "shared", length.cast("int").alias("length")).join(facts.drop("n"), "node")
    maps = [f"m{k}" for k in range(WORDS)]
    posted = compact(keyed.select("pivot", "node", "n", "label", "beyond", *maps, F.posexplode("shared").alias("at", "v"), (F.col("at") < F.col("length")).alias("prefix")).where("prefix or beyond"))
    side = lambda x, rows: rows.select("pivot", "v", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "label", "beyond", "prefix", *maps)))
    once = ~F.col("beyond_a") | (F.col("prefix_b") & (F.col("node_a") < F.col("node_b")))
    fits = (F.col("label_a") != F.col("label_b")) & (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")) & once & maps_allow(percent)
    left, right = side("a", posted.where("prefix")).alias("l"), side("b", posted.where("beyond")).alias("r")
    pairs = left.join(right, (F.col("l.pivot") == F.col("r.pivot")) & (F.col("l.v") == F.col("r.v")) & fits)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def upper(v):
    """Upper half of a hash, half the size and in the same order."""
    return F.shiftright(v, 32).cast("int")


def possible(p: float, percent: int):
    """Whether two sets leave room for similarity p: by their bit maps, or, where a set is larger than its sketch, by the hashes that nobody else has.

    A hash that no other sketch has is known to be lacking in the other set only below the ends of both sketches; there neither set has
    more than SKETCH hashes, and what passes ``estimate`` with its slack passes here: I / (I + lonely) >= p, with I at most what is not lonely.
    """
    below = lambda c: F.coalesce(F.size(F.filter(c, lambda v: v < F.least("end_a", "end_b"))), F.lit(0))
    least = p - _deviation(SKETCH, F.greatest("n_a", "n_b").cast("double"), p) / SKETCH
    sampled = below("far_a") + below("far_b") <= (1 / least - 1) * (SKETCH - F.greatest(below("far_a"), below("far_b"))) + 1e-9
    return F.when(F.greatest("n_a", "n_b") <= SKETCH, maps_allow(percent)).otherwise(sampled)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def still_open(posted: DataFrame) -> DataFrame:
    """The rows (value, label, ...) of the lists that hold more than one component."""
    several = posted.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("value")
    return posted.join(several, "value")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, keys: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links of ``percent`` or more), kept.

    Empty texts, texts without words and null texts have an empty set and are their own component. Rows with a null id are linked
    with nothing: component_id null, kept false. Repeated ids share a component if their texts do; all their rows are
    kept if the id is the smallest. An empty table gives no rows. ``keys`` adds node (key of the row's set) and label (its component's smallest node).
    """
    spark, p = df.sparkSession, percent / 100
    place = fresh_folder(spark, "signatures")
    signatures(df, id_col, text_col, shingle).write.parquet(f"{place}/rows")
    drawn = spark.read.parquet(f"{place}/rows")
    sigs = materialise(drawn.select("id", "node", "n"))
    drawn.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).write.parquet(f"{place}/nodes")
    nodes = spark.read.parquet(f"{place}/nodes")
    reps = materialise(nodes.select("node", "rep"))
    release(spark)
    entries = nodes.select("node", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_node = entries.join(shared, "value").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    per_node = per_node.withColumn("spare", F.size("values") - needed(F.col("n").cast("double"), p)).where("spare >= 0")
    lists = compact(per_node.select("node", "n", F.expr("aggregate(values, 0L, (s, x) -> s + x.df)").alias("common"), F.transform(F.slice("values", 1, F.col("spare") + 1), lambda x: x["value"]).alias("prefix")))
    release(spark)

    # only the sketches of nodes that may link go on; the others' tables are removed
    live = materialise(nodes.join(lists.select("node"), "node", "left_semi").select("node", "n", "sketch"))
    remove(spark, place)
    release(spark)
    def with_sketches(pairs: DataFrame) -> DataFrame:
        left = live.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sk_a"))
        right = live.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sk_b"))
        return pairs.join(left, "a").join(right, "b")

    similar_size = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    postings = lists.select("node", "n", "common", F.explode("prefix").alias("value"))
    best = F.struct("common", "node", "n")
    pivots = postings.groupBy("value").agg(F.max(best).alias("pivot"), F.max(F.when(F.col("n") <= SKETCH, best)).alias("small"), F.count(F.lit(1)).alias("length")).where("length > 1")
    pivots = compact(pivots)
    edges, labels = None, None

    def compare(stars: DataFrame) -> DataFrame:
        """Edges among the pairs of a star round."""
        passed = compact(estimate(with_sketches(stars), p))
        # of the pairs that need full sets, every node's closest; later rounds see the others again
        release(spark)
        closest = passed.where("not certain").groupBy("a").agg(F.max(F.struct("jaccard", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        return passed.where("certain").select("a", "b").union(confirm(closest, df, reps, id_col, text_col, shingle, percent))

    # first round: with the pivot and with the best node whose sketch is its whole set, to which differences are taken later
    both = pivots.select("value", F.explode(F.array_distinct(F.array_compact(F.array("pivot", "small")))).alias("pivot"))
    stars = postings.join(both, "value").select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pivot.node").alias("b"), F.col("pivot.n").alias("n_b"))
    edges = compact(compare(stars.where((F.col("a") != F.col("b")) & similar_size).select("a", "b").distinct()))
    release(spark)
    labels = components(edges)
    tried = pivots.select("value", F.col("pivot.node").alias("tried")).union(pivots.where("small is not null").select("value", "small.node"))
    for _ in range(ROUNDS - 1):
        posted = compact(still_open(postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))))
        taken = tried.join(labels, F.col("tried") == F.col("node"), "left").groupBy("value").agg(F.collect_set(F.coalesce("label", "tried")).alias("taken"))
        following = posted.join(taken, "value").where(~F.array_contains("taken", F.col("label"))).groupBy("value").agg(F.max(F.struct("common", "node", "n", "label")).alias("pivot"))
        following = compact(following)
        stars = posted.join(following, "value").where(F.col("label") != F.col("pivot.label")).select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pivot.node").alias("b"), F.col("pivot.n").alias("n_b"))
        edges = compact(edges.union(compare(stars.where(similar_size).select("a", "b").distinct())))
        release(spark)
        labels = components(edges)
        tried = tried.union(following.select("value", "pivot.node"))

    # last round: pairs in different components
    posted = still_open(lists.join(labels, "node", "left").select("node", "n", "prefix", F.coalesce("label", "node").alias("label"), F.explode("prefix").alias("value")))
    reference = F.when(F.col("length") > LONG_LIST, F.col("small.node"))
    posted = posted.join(pivots.select("value", reference.alias("pivot")), "value")
    posted = compact(posted.withColumn("grouped", F.col("pivot").isNotNull() & (F.col("n") <= SKETCH)))
    release(spark)
    concerned = posted.select("node", "n", "label", "prefix").dropDuplicates(["node"])
    sketched = live.join(concerned.select("node"), "node", "left_semi")
    own = sketched.select("node", (F.col("n") > SKETCH).alias("long"), F.explode("sketch").alias("v"))
    lonely = own.join(own.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max("long").alias("any")).where("c = 1 and any"), "v", "left_semi").groupBy("node").agg(F.collect_list(upper(F.col("v"))).alias("far"))
    ends = sketched.where(F.col("n") > SKETCH).select("node", upper(F.element_at("sketch", -1)).alias("end"))
    maps = bit_maps(sketched.where(F.col("n") <= SKETCH))
    facts = compact(concerned.join(lonely, "node", "left").join(ends, "node", "left").join(maps, "node", "left"))
    release(spark)
    columns = ("node", "n", "label", "prefix", "far", "end", *(f"m{k}" for k in range(WORDS)))
    side = lambda x, rows: rows.select("value", "grouped", "node").join(facts, "node").select("value", F.col("grouped").alias(f"grouped_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    left, right = side("a", posted.where("not grouped")).alias("l"), side("b", posted).alias("r")
    first_common = F.element_at(F.array_intersect("prefix_a", "prefix_b"), 1) == F.col("l.value")
    once = F.col("grouped_b") | (F.col("node_a") < F.col("node_b"))
    pairs = left.join(right, (F.col("l.value") == F.col("r.value")) & once & (F.col("label_a") != F.col("label_b")) & similar_size & possible(p, percent) & first_common).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    members = posted.where("grouped").select("pivot", "node").distinct()
    pairs = pairs.union(difference_pairs(members, facts.select("node", "n", "label", *(f"m{k}" for k in range(WORDS))), live, percent)).distinct()
    passed = compact(estimate(with_sketches(pairs), p))
    more = passed.where("certain").select("a", "b").union(confirm(passed.where("not certain").select("a", "b"), df, reps, id_col, text_col, shingle, percent))
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = components(stars.union(more))
    release(spark)

    named = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id", *(["label"] if keys else []))
    out = sigs.select("id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), *(["node", "label"] if keys else []))


def with_node(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """The rows of ``df``, all columns unchanged, with __node: the key of the row's set, null if it is empty."""
    at, target = df.columns.index(text_col), StructType([*df.schema.fields, StructField("__node", LongType())])

    def run(batches):
        cache: dict = {}
        for b in pieces(batches):
            sets = [shingle_set((t or "").encode(), size, cache) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_key(s) if len(s) else None for s in sets], pa.int64())], [*b.schema.names, "__node"])

    return df.mapInArrow(run, target)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
