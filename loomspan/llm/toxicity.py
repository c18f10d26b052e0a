"""Toxicity scoring through a noisy channel (operator 4).

A token that cannot be plain prose (digits or symbols inside, letters repeated three times or more, single letters in a row) becomes a
lattice of letters: leet substitutions, dropped separators, collapsed repeats. Viterbi decoding under a character bigram
model restores the likeliest word; tokens and runs of any length are decoded in full. In spelled-out runs and in long tokens, which may hold
many words, terms are looked up at every position, with the less weight the likelier they occur there by chance. Restored words and their leading character n-grams are looked up among the terms
learned from labels; their precisions combine by noisy-or.

The fit counts all labelled training rows where they lie: terms and letter pairs are summed by Spark, and only the terms that pass as evidence
and the table of letter pairs reach the driver. Near copies among the rows of label 1 count once.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, labelled_rows, map_batches, map_partitions, materialise, table, text_of

MODULUS, HELD_OUT = 3, 1
ACCEPT = 0.7
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3
LEAST_PRECISION = 0.9
SIGNATURE, COPY_SHARE = 32, 0.4
BANDS = (2, 4, 8)  # widths of the signatures' bands: narrow ones find loose copies, wide ones keep strangers out of large tables' buckets
FACTORS = (np.random.default_rng(1).integers(1, 2**31, SIGNATURE, dtype=np.uint64) * 2 + 1).astype(np.uint32)
CACHE, TERM_CACHE = 400_000, 100_000
PORTION = 500
TERMS_AT_ONCE, CHARACTERS_AT_ONCE = 200_000, 32 << 20  # what a worker counts before it passes the counts on

#: The letters that a leet symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
EDGE = "^"
SPACED = re.compile(r"(?<!\S)[^\s](?:[ \t][^\s]){2,}(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+\Z")
RUN3 = re.compile(r"(.)\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
LONG = 40  # longer tokens may hold many words
CHANCE = 10.0  # how fast the weight of a term inside a longer text falls with its expected number of chance occurrences
TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!|+(") + "“”„«»…"

SEPARATORS = re.compile(r"(?:[^\w@$!|+(€£]|_)+")


def letter_pairs(words) -> Counter:
    """Counts of the letter pairs, edges included, in the items (word, n) of ``words``."""
    pair: Counter = Counter()
    for w, n in words:
        s = EDGE + w + EDGE
        for ab in zip(s, s[1:], strict=False):
            pair[ab] += n
    return pair


class CharModel:
    """Character bigram model with add-one smoothing; costs are negative natural logarithms. ``portions`` yields word counts."""

    def __init__(self, portions=()):
        pair: Counter = Counter()
        for words in portions:
            pair.update(letter_pairs(words.items()))
        self._count([ord(a) for a, _ in pair], [ord(b) for _, b in pair], list(pair.values()))

    @classmethod
    def of_pairs(cls, first, second, counts) -> CharModel:
        """From distinct pairs of code points and their counts."""
        model = cls()
        model._count(first, second, counts)
        return model

    def _count(self, first, second, counts) -> None:
        # 16 bytes a pair: the pairs of all rows may be millions in scripts of many letters
        codes = np.array(first, np.int64) << 32 | np.array(second, np.int64)
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], np.array(counts, np.int64)[order]
        letters, at = np.unique(self.codes >> 32, return_index=True)
        sums = np.add.reduceat(self.counts, at) if len(at) else []
        self.single = {chr(a): int(n) for a, n in zip(letters, sums, strict=True)}
        self.letters = max(1, len(self.single))
        self._costs: dict[tuple[str, str], float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_costs": {}}

    def cost(self, a: str, b: str) -> float:
        c = self._costs.get((a, b))
        if c is None:
            if len(self._costs) >= CACHE:
                self._costs.clear()
            code = ord(a) << 32 | ord(b)
            at = int(np.searchsorted(self.codes, code))
            n = int(self.counts[at]) if at < len(self.codes) and self.codes[at] == code else 0
            c = self._costs[a, b] = -math.log((n + 0.5) / (self.single.get(a, 0) + 0.5 * self.letters))
        return c


SUBSTITUTE, DROP, COLLAPSE, KEEP_SYMBOL = 1.0, 0.7, 0.2, 6.0


def decode(token: str, lm: CharModel) -> str:
    """Likeliest word behind a token: Viterbi over the lattice, the last letter being the state."""
    t = token
    # a state's text is a chain of letters from the last to the first, so that long tokens stay linear
    states: dict[str, tuple[float, tuple | None]] = {EDGE: (0.0, None)}
    for i, ch in enumerate(t):
        new: dict[str, tuple[float, tuple | None]] = {}

        def offer(state, cost, text, new=new):
            if state not in new or cost < new[state][0]:
                new[state] = (cost, text)

        repeated = i > 0 and t[i - 1] == ch
        for last, (cost, text) in states.items():
            options = [(ch, 0.0)] if ch.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(ch, "")]
            for letter, extra in options:
                offer(letter, cost + extra + lm.cost(last, letter), (letter, text))
            if repeated and text:
                offer(last, cost + COLLAPSE, text)
            if not ch.isalpha():
                offer(last, cost + (KEEP_SYMBOL if ch.isdigit() else DROP if ch not in LEET else DROP + SUBSTITUTE * 3), text)
        states = new or states
    text = min(((cost + lm.cost(last, EDGE), last, text) for last, (cost, text) in states.items()), key=lambda x: x[:2])[2]
    letters = []
    while text:
        letter, text = text
        letters.append(letter)
    return "".join(reversed(letters))


def collapsed(token: str) -> str:
    """A token of more than LONG characters with the repeats shortened that decoding collapses anyway."""
    return LONG_RUN.sub(r"\1\1\1", token) if len(token) > LONG else token


def restore(token: str, lm: CharModel) -> tuple[str, ...]:
    """Readings of a whitespace token: itself without surrounding marks and, if it looks obfuscated, the decoded word."""
    core = collapsed(token.strip(TRIM))
    bare = core.strip("@$!|+(")
    if PLAIN.match(bare) and not RUN3.search(bare):
        if bare == core:
            return (bare,)
        return (bare, decode(core, lm))
    if not core or not any(c.isalpha() for c in core) and sum(c in LEET for c in core) < 3:
        return ()
    if core.isdigit():
        return ()
    return (decode(core, lm), bare) if PLAIN.match(bare) else (decode(core, lm),)


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def spaced_words(text: str, lm: CharModel) -> list[str]:
    return [decode(collapsed("".join(m.group().split())), lm) for m in SPACED.finditer(text)]


def token_terms(token: str) -> tuple[str, ...]:
    """The terms of a lower-case token, its plain word first; none if there is no such word."""
    w = token.strip(TRIM + "@$!|+(")
    return tuple(terms(w)) if PLAIN.match(w) and not RUN3.search(w) else ()


_short_token_terms = lru_cache(TERM_CACHE)(token_terms)


def _terms_of(text: str):
    return [_short_token_terms(t) if len(t) <= LONG else token_terms(t) for t in set(text.lower().split())]


def plain_words(text: str) -> set[str]:
    return {found[0] for found in _terms_of(text) if found}


def bag(text: str) -> set[str]:
    return set().union(*_terms_of(text))


def signature(text: str) -> np.ndarray:
    """Min-hash signature of the word pairs; zeros without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(SIGNATURE, np.uint32)
    codes = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or [""], strict=False)], np.uint32)
    least = np.full(SIGNATURE, 2**32 - 1, np.uint32)
    for k in range(0, len(codes), PORTION):
        least = np.minimum(least, (codes[k : k + PORTION, None] * FACTORS).min(axis=0))
    return least


def bands(signed: np.ndarray) -> list[int]:
    """Keys of the buckets in which a signature meets others: hashes of its bands of every width."""
    return [xxhash.xxh3_64_intdigest(signed[k : k + w].tobytes(), seed=w << 8 | k) - 2**63 for w in BANDS for k in range(0, SIGNATURE, w)]


def text_key(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def is_copy(a: np.ndarray, b: np.ndarray) -> bool:
    return np.count_nonzero(a == b) >= COPY_SHARE * SIGNATURE


def distinct_rows(texts: list[str]) -> list[int]:
    """Indices of rows that are no near copy of another: words that merely accompany a telling one in copies must not look telling.

    Of equal texts the first counts. A row is a copy if its signature agrees in COPY_SHARE of its places with that of the row of the least key
    in any of its buckets: one comparison per row and band, however many rows a bucket holds.
    """
    first: dict[str, int] = {}
    for i, text in enumerate(texts):
        first.setdefault(text_key(text), i)
    signed = {key: signature(texts[i]) for key, i in first.items()}
    leaders: dict[int, str] = {}
    for key in sorted(signed):
        for band in bands(signed[key]):
            leaders.setdefault(band, key)
    return sorted(i for key, i in first.items() if not any(leaders[x] != key and is_copy(signed[key], signed[leaders[x]]) for x in bands(signed[key])))


def least_rows(wanted: int, told: int, rows: int) -> int:
    """In how many rows of label 1 a term must be so that none of ``wanted`` terms would reach it by chance."""
    rate = min(0.5, max(1e-3, told / max(1, rows)))
    return max(LEAST_DOCS, math.ceil((math.log(max(2, wanted)) + 2) / -math.log(rate)))


class Scorer:
    """Fitted on lists; ``fit`` counts the same on tables."""

    def __init__(self, texts: list[str], labels: list[int]):
        told = [text for text, y in zip(texts, labels, strict=True) if y]
        positives = [bag(told[i]) for i in distinct_rows(told)]
        with_label = Counter(t for b in positives for t in b)
        wanted = {t for t, a in with_label.items() if a >= LEAST_DOCS}
        without: Counter = Counter()
        for text, y in zip(texts, labels, strict=True):
            if not y:
                without.update(bag(text) & wanted)
        least = least_rows(len(wanted), len(told), len(labels))
        # smoothed precision as evidence for label 1; indecisive terms are no evidence
        evidence = {t: p for t in wanted if with_label[t] >= least and (p := (with_label[t] + 0.5) / (with_label[t] + without[t] + 1)) >= LEAST_PRECISION}
        missed = sum(not b & evidence.keys() for b in positives)
        # words are counted in portions: the fit never holds the vocabulary of all rows
        lm = CharModel(Counter(w for text in texts[k : k + PORTION] for w in plain_words(text)) for k in range(0, len(texts), PORTION))
        self._learn(evidence, missed, len(labels) - len(told), len(labels), lm)

    @classmethod
    def of_counts(cls, evidence: dict[str, float], missed: int, untold: int, rows: int, lm: CharModel) -> Scorer:
        """From the evidence of terms, the distinct rows of label 1 without any, the rows of label 0 and all rows, and the character model."""
        scorer = cls.__new__(cls)
        scorer._learn(evidence, missed, untold, rows, lm)
        return scorer

    def _learn(self, evidence: dict[str, float], missed: int, untold: int, rows: int, lm: CharModel) -> None:
        self.evidence, self.lm = evidence, lm
        # share of label 1 among the fitted rows that hold no evidence
        self.background = (missed + 0.5) / (missed + untold + 1) if rows else 0.5
        # what may stand anywhere in a longer text: whole terms and the longest prefixes, each with its chance at one position
        inner = {t.rstrip("*"): p for t, p in sorted(self.evidence.items()) if not t.endswith("*") or len(t) > PREFIXES[-1]}
        total = max(1, sum(self.lm.single.values()))
        self.inner = {t: (p, (self.lm.single.get(t[0], 0) + 0.5) / total * math.exp(-sum(self.lm.cost(a, b) for a, b in zip(t, t[1:], strict=False)))) for t, p in inner.items()}
        self.lengths = sorted({len(t) for t in inner}, reverse=True)
        self._cache: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"} | {"_cache": {}}

    def _weight(self, token: str) -> float:
        best = 0.0
        for w in restore(token, self.lm):
            best = max([best, *(self.evidence.get(t, 0.0) for t in terms(w))])
            if len(w) > LONG:
                best = max(best, self._weight_inside(w))
        core = collapsed(token.strip(TRIM))
        if len(core) > LONG:
            # the words that separators glue together
            parts = SEPARATORS.split(core)
            if len(parts) > 1:
                best = max([best, *map(self._weight, set(parts))])
        return best

    def _weight_inside(self, text: str) -> float:
        """Best evidence of a term at any position of a text without word borders, less what chance explains."""
        best = 0.0
        for i in range(len(text)):
            for n in self.lengths:
                hit = self.inner.get(text[i : i + n])
                if hit:
                    best = max(best, hit[0] * math.exp(-CHANCE * len(text) * hit[1]))
        return best

    def score(self, text: str) -> float:
        low, cache = text.lower(), self._cache
        missing, found = 1 - min(self.background, 0.5), []
        for token in set(low.split()):
            p = cache.get(token)
            if p is None:
                if len(cache) >= CACHE:
                    cache.clear()
                p = cache[token] = self._weight(token)
            if p:
                found.append(p)
        for w in spaced_words(low, self.lm):
            p = max([self._weight_inside(w), *(self.evidence.get(t, 0.0) for t in terms(w))])
            if p:
                found.append(p)
        for p in sorted(found):
            missing *= 1 - p
        return round(1 - missing, 6)


def told_apart(told: DataFrame) -> DataFrame:
    """Distinct texts of ``told`` (text) that are no near copy of another, by the rule of distinct_rows."""

    def sign(batch):
        texts = batch.column(0).to_pylist()
        signed = [signature(t) for t in texts]
        return {"key": [text_key(t) for t in texts], "text": batch.column(0), "signature": [x.tobytes() for x in signed], "bands": [bands(x) for x in signed]}

    rows = materialise(map_batches(told, sign, "key string, text string, signature binary, bands array<long>").dropDuplicates(["key"]))
    entries = rows.select("key", "signature", F.explode("bands").alias("band"))
    leaders = entries.groupBy("band").agg(F.min(F.struct("key", "signature")).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = entries.join(leaders, "band").where(F.col("key") != F.col("leader.key")).select("key", "signature", F.col("leader.signature").alias("other"))

    def agree(batch):
        sides = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        copies = [is_copy(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in sides]
        return {"key": [key for key, copy in zip(batch.column(0).to_pylist(), copies, strict=True) if copy]}

    return rows.join(map_batches(pairs, agree, "key string").distinct(), "key", "left_anti").select("text")


TOLD, UNTOLD, SEEN = 0, 1, 2


def count_terms(rows: DataFrame) -> DataFrame:
    """term, told, untold, seen: in how many of the rows (text, as) with as = TOLD or UNTOLD a term is, and a word in those with SEEN. The empty term counts the rows."""

    def run(batches):
        counts, size = (Counter(), Counter(), Counter()), 0

        def passed_on():
            found = list(set().union(*counts))
            return {"term": found} | {name: [c[t] for t in found] for name, c in zip(("told", "untold", "seen"), counts, strict=True)}

        for b in batches:
            for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[kind].update(plain_words(text) if kind == SEEN else bag(text))
                counts[kind][""] += 1
                size += len(text)
                if size >= CHARACTERS_AT_ONCE or sum(map(len, counts)) >= TERMS_AT_ONCE:
                    yield passed_on()
                    counts, size = (Counter(), Counter(), Counter()), 0
        yield passed_on()

    partial = map_partitions(rows, run, "term string, told long, untold long, seen long")
    return partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("told", "untold", "seen")))


def char_model(words: DataFrame) -> CharModel:
    """Character model of the table (word, n)."""

    def run(batches):
        pair: Counter = Counter()

        def passed_on():
            return {"a": [ord(a) for a, _ in pair], "b": [ord(b) for _, b in pair], "n": list(pair.values())}

        for batch in batches:
            pair.update(letter_pairs(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            if len(pair) >= TERMS_AT_ONCE:
                yield passed_on()
                pair.clear()
        yield passed_on()

    pairs = map_partitions(words, run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    return CharModel.of_pairs(*(pairs[c].to_numpy() for c in ("a", "b", "n")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, remainder: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """The Scorer of all labelled rows outside the held-out bucket."""
    rows = labelled_rows(docs, labels, label, modulus, remainder, id_col, text_col)
    positives = materialise(told_apart(rows.where("__y <> 0").select("__text")))
    # copies count for the spelling, not for the terms
    all_rows = rows.select("__text", F.when(F.col("__y") == 0, UNTOLD).otherwise(SEEN)).union(positives.select("text", F.lit(TOLD)))
    counts = materialise(count_terms(all_rows))
    size = counts.where("term = ''").first()
    untold, told = (size["untold"], size["seen"]) if size else (0, 0)
    wanted = counts.where((F.col("term") != "") & (F.col("told") >= LEAST_DOCS))
    precision = (F.col("told") + F.lit(0.5)) / (F.col("told") + F.col("untold") + 1)
    found = wanted.where((F.col("told") >= least_rows(wanted.count(), told, told + untold)) & (precision >= LEAST_PRECISION)).select("term", precision.alias("p")).toArrow()
    evidence = dict(zip(found["term"].to_pylist(), found["p"].to_pylist(), strict=True))
    held = docs.sparkSession.sparkContext.broadcast(frozenset(evidence))
    without = map_batches(positives, lambda batch: {"missed": [sum(held.value.isdisjoint(bag(t)) for t in batch.column(0).to_pylist())]}, "missed long")
    missed = without.agg(F.sum("missed")).first()[0] or 0
    lm = char_model(counts.where((F.col("term") != "") & ~F.col("term").endswith("*") & (F.col("untold") + F.col("seen") > 0)).select("term", F.col("untold") + F.col("seen")))
    return Scorer.of_counts(evidence, missed, untold, told + untold, lm)


def toxicity(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row. Null and empty texts get the background share; ids may be null or repeat."""
    kind = dict(df.dtypes)[id_col]
    held = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield {id_col: b.column(0), "score": [held.value.score(t) for t in b.column(1).to_pylist()]}

    return map_partitions(df.select(F.col(id_col), text_of(text_col)), run, f"{id_col} {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (bucket("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
