"""Language-model scoring by subword lattices (operator 7).

The pieces of a public vocabulary weigh every segmentation of a text: its scores (ranks) give the first piece distribution, one
expectation step over all distinct training words, weighted by their counts, the second. The forward recursion in log space sums
all segmentations. Pieces never cross white space, so the document probability is the product over its words and
its end, and each distinct word is computed once.

Counts of all words are aggregated with partial sums; the HEAD most frequent words (a fixed number) are
broadcast, the others join by shuffle, so no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, map_partitions, materialise, table, text_of

VOCABULARY = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
MODULUS, HELD_OUT = 7, 2
HEAD = 200_000
FLUSH = 200_000  # distinct words held by a task before it hands partial counts on
PRIOR = 1000.0  # pseudo-count of the vocabulary's own distribution
SPACE = "▁"
END = b""  # stands for the end of a document among the words; no word is empty
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GROUP = 8192
LONG = 64  # words of more characters are computed one by one


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces, best score first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    normal.sort(key=lambda i: (-sp.get_score(i), i))
    return [sp.id_to_piece(i) for i in normal]


def first_weights(n: int) -> np.ndarray:
    """Probabilities of pieces by rank (Zipf), the 256 byte pieces and the end of a text at the last rank."""
    w = 1.0 / (np.concatenate([np.arange(n), np.full(257, n)]) + 2.7)
    return w / w.sum()


class Lattice:
    """Marginal log probabilities of words. ``logp``: pieces, then 256 bytes, then the end of a text."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp, self.n = pieces, logp, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        # every prefix of a piece is a key, so that a walk knows when to stop
        known = {p[:m]: -2 for p in pieces for m in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        keys, values = np.array([self._hash(p) for p in known], np.uint64), np.array(list(known.values()), np.int32)
        self.bits = 19
        while True:  # three-way buckets; more bits if one overflows
            at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            if not len(place) or place.max() < 3:
                break
            self.bits += 1
        self.slots = np.zeros((3, 1 << self.bits), np.uint64)
        self.which = np.full((3, 1 << self.bits), -1, np.int32)
        self.slots[place, at[order]], self.which[place, at[order]] = keys[order], values[order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return h * 0xC2B2AE3D27D4EB4F % 2**64

    def _arcs(self, codes: np.ndarray, start: int):
        """(length, rows, piece ids) of the pieces that begin at ``start``."""
        rows = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for m in range(1, min(self.longest, codes.shape[1] - start) + 1):
                h = (h ^ codes[rows, start + m - 1]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                key = h * np.uint64(0xC2B2AE3D27D4EB4F)
                at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
                value = np.full(len(rows), -1, np.int32)
                for s in range(3):
                    match = np.flatnonzero(self.slots[s][at] == key)
                    value[match] = self.which[s][at[match]]
                piece = np.flatnonzero(value >= 0)
                if len(piece):
                    out.append((m, rows[piece], value[piece]))
                alive = np.flatnonzero(value != -1)
                if not len(alive):
                    break
                rows, h = rows[alive], h[alive]
        return out

    def words(self, words: list[str], weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the marginal probability of each word (with its leading space mark); with ``weights``, expected piece counts are added to ``counts``."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        for length, members in by_length.items():
            step = GROUP if length <= LONG else max(1, GROUP * LONG // length)
            for at in range(0, len(members), step):
                pick = members[at : at + step]
                codes = np.frombuffer("".join(SPACE + words[i] for i in pick).encode("utf-32-le"), "<u4").reshape(len(pick), length).astype(np.uint64)
                out[pick] = self._forward(codes, None if weights is None else weights[pick], counts)
        return out

    def _forward(self, codes: np.ndarray, weights, counts) -> np.ndarray:
        n, length = codes.shape
        chars, back = np.unique(codes, return_inverse=True)
        spelling_of = [[self.n + b for b in chr(int(c)).encode()] for c in chars]
        spelt = np.array([self.logp[s].sum() for s in spelling_of])[back.reshape(codes.shape)]
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        arcs = []
        for start in range(length):
            found = self._arcs(codes, start)
            if weights is not None:
                arcs.append(found)
            alpha[start + 1] = np.logaddexp(alpha[start + 1], alpha[start] + spelt[:, start])
            for m, rows, ids in found:
                alpha[start + m, rows] = np.logaddexp(alpha[start + m, rows], alpha[start, rows] + self.logp[ids])
        total = alpha[length]
        if weights is not None:
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            by_char = np.zeros(len(chars))
            back = back.reshape(codes.shape)
            seen_ids, seen_mass = [], []
            for start in range(length - 1, -1, -1):
                by_bytes = spelt[:, start] + beta[start + 1]
                beta[start] = by_bytes
                by_char += np.bincount(back[:, start], np.exp(alpha[start] + by_bytes - total) * weights, len(chars))
                for m, rows, ids in arcs[start]:
                    arc = self.logp[ids] + beta[start + m, rows]
                    beta[start, rows] = np.logaddexp(beta[start, rows], arc)
                    seen_ids.append(ids)
                    seen_mass.append(np.exp(alpha[start, rows] + arc - total[rows]) * weights[rows])
            if seen_ids:
                counts += np.bincount(np.concatenate(seen_ids), np.concatenate(seen_mass), len(counts))
            for mass, s in zip(by_char, spelling_of, strict=True):
                for b in s:
                    counts[b] += mass
        return total


def gathered(batches, rows: int = 20_000):
    """Batches of at least ``rows`` rows where there are so many: short vectors would waste the lattice."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, all): occurrences in training documents and in all; the row END counts the documents themselves. ``docs``: train, text."""

    def run(batches):
        inside, outside = Counter(), Counter()

        def flush():
            words = list(inside.keys() | outside.keys())
            out = {"word": words, "c": [inside[w] for w in words], "all": [inside[w] + outside[w] for w in words]}
            inside.clear()
            outside.clear()
            return out

        for b in batches:
            for train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = inside if train else outside
                c.update(tokens(text))
                c[END] += 1
                if len(inside) + len(outside) > FLUSH:
                    yield flush()
        if inside or outside:
            yield flush()

    return map_partitions(docs, run, "word binary, c long, all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))


def expected_pieces(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected piece counts over all training words: partial vectors from every task, summed by piece (a row per piece)."""
    held = words.sparkSession.sparkContext.broadcast((lattice.pieces, lattice.logp))

    def run(batches):
        lat, counts = None, None
        for b in gathered(batches):
            if lat is None:
                lat = Lattice(*held.value)
                counts = np.zeros(lat.n + 257)
            lat.words([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], np.array(b.column(1).to_pylist(), np.float64), counts)
        if lat is not None:
            at = np.flatnonzero(counts)
            yield {"piece": at.tolist(), "count": counts[at].tolist()}

    got = map_partitions(words.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c"), run, "piece long, count double").groupBy("piece").agg(F.sum("count").alias("count")).collect()
    total = np.zeros(lattice.n + 257)
    for r in got:
        total[r["piece"]] = round(r["count"], 6)
    return total


def most_frequent(words: DataFrame, head: int) -> DataFrame:
    """At most ``head`` words, all those above some count: found by a histogram of counts (a sixteenth of an octave wide) without sorting words."""
    octave = F.floor(F.log2(F.col("all").cast("double")) * 16).cast("long")
    sizes = words.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = head, 1 << 40
    for r in sorted(sizes, key=lambda r: -r["octave"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["octave"]
    return words.where(octave >= least)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, remainder: int = HELD_OUT, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null and empty texts consist of their end alone. Rows are scored one by one, repeated ids and texts included; without training
    rows every count is 0. A text of any length is read whole.
    """
    spark = df.sparkSession
    train = bucket(id_col, modulus) != remainder
    docs = df.select(F.col(id_col).alias("id"), train.alias("train"), text_of(text_col).cast("binary").alias("text"))
    counted = materialise(count_words(docs.select("train", "text")))
    totals = counted.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.sum(F.when(F.octet_length("word") == 0, F.col("c")).otherwise(0)).alias("ends")).first()
    N, V, ends = int(totals["N"] or 0), int(totals["V"] or 0), int(totals["ends"] or 0)

    pieces = read_vocabulary(vocabulary)
    start = first_weights(len(pieces))
    expected = expected_pieces(counted, Lattice(pieces, np.log(start)))
    expected[-1] = ends
    logp = np.log((expected + PRIOR * start) / (expected.sum() + PRIOR))
    model = spark.sparkContext.broadcast((pieces, logp))
    end_log10 = float(logp[-1]) / math.log(10)

    def marginals(batches):
        lat = None
        for b in gathered(batches):
            lat = lat or Lattice(*model.value)
            values = lat.words([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]) / math.log(10)
            yield {"word": b.column(0), "c": b.column(1), "all": b.column(2), "marginal": values.tolist()}

    words = materialise(map_partitions(counted.where(F.octet_length("word") > 0).select("word", "c", "all"), marginals, "word binary, c long, all long, marginal double"))
    denominator = N + 1 * (V + 1)
    common = most_frequent(words, head).select("word", "c", "marginal").toArrow()
    frequent = spark.sparkContext.broadcast((common["word"].to_pylist(), np.array(common["c"].to_pylist(), np.int64), np.array(common["marginal"].to_pylist(), np.float64)))
    end_known, end_base = int(ends > 0), math.log10((ends + 1) / denominator)

    def partial(batches):
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        names, c, marginal = frequent.value
        at = {w: i for i, w in enumerate(names)}
        base = np.append(np.log10((c + 1) / denominator), 0.0)
        known, marginal = np.append((c > 0).astype(np.int64), 0), np.append(marginal, 0.0)
        none = len(names)
        for b in batches:
            if not b.num_rows:
                continue
            out: dict[str, list] = {k: [] for k in ("row", "word", "times", "id", "train", "n_tokens", "n_known", "base", "score")}
            for i, is_train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = tokens(text)
                ids = np.array([at.get(w, none) for w in ws], np.int64)
                rare = Counter(ws[k] for k in np.flatnonzero(ids == none))
                for key, value in (("row", row), ("word", None), ("times", 0), ("id", i), ("train", is_train), ("n_tokens", len(ws) + 1), ("n_known", int(known[ids].sum()) + end_known), ("base", float(base[ids].sum()) + end_base), ("score", float(marginal[ids].sum()) + end_log10)):
                    out[key].append(value)
                if rare:
                    k = len(rare)
                    out["row"] += [row] * k
                    out["word"] += rare.keys()
                    out["times"] += rare.values()
                    for key in ("id", "train", "n_tokens", "n_known", "base", "score"):
                        out[key] += [None] * k
                row += 1
            yield out

    parts = map_partitions(docs, partial, f"row long, word binary, times long, id {dict(df.dtypes)[id_col]}, train boolean, n_tokens long, n_known long, base double, score double")
    found = parts.join(words.select("word", "c", "marginal"), "word", "left")
    is_doc = F.col("word").isNull()
    term = F.log10((F.col("c") + 1) / F.lit(float(denominator)))
    per_doc = found.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_doc, F.col("n_known")).when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(is_doc, F.col("base")).otherwise(F.col("times") * term)).alias("base_score"),
        F.sum(F.when(is_doc, F.col("score")).otherwise(F.col("times") * F.col("marginal"))).alias("score"),
    )
    return per_doc.select(id_col, (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", F.round("score", 6).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
