"""Quality classifier by nearest-neighbour voting in a latent semantic space (operator 9).

A document is a bag of character-class bigrams plus a few repetition terms; tf-idf weighting and a truncated SVD, fitted on
labelled rows, give latent vectors. The labelled vectors are broadcast (at most FIT_ROWS rows of DIM floats) and
every document's exact cosine products with all of them are computed in blocks; its nearest labels vote with
the similarity as weight.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, labelled_sample, map_batches, pieces, table, text_of

FIT_ROWS = 4000  # labelled rows in the fit: bounds the broadcast to FIT_ROWS * DIM floats
DIM = 32
NEIGHBOURS = 15
POWER = 8
ACCEPT = 0.7
MODULUS, HELD_OUT = 4, 2
DOC_BLOCK = 256


def _classes() -> np.ndarray:
    """Byte classes: each lower-case letter, capitals, digits, bytes from 0x80, control bytes, each punctuation mark."""
    out = np.zeros(256, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        ch = chr(c)
        if "a" <= ch <= "z":
            out[c] = c - 97
        elif "A" <= ch <= "Z":
            out[c] = 26
        elif "0" <= ch <= "9":
            out[c] = 27
        elif c >= 0x80:
            out[c] = 28
        elif ch == "\n":
            out[c] = 29
        elif ch in " \t\r\x0b\x0c":
            out[c] = 30
        elif c in marks:
            out[c] = 32 + marks.index(c)
        else:
            out[c] = 31
    return out


CLASSES = _classes()
K = int(CLASSES.max()) + 1
EXTRA = 8  # repetition terms
N_FEATURES = K * K + EXTRA


def features(text: bytes) -> np.ndarray:
    """Term frequencies of class bigrams, and how often words, word pairs and lines repeat, and how many capitals there are."""
    x = np.zeros(N_FEATURES, np.float32)
    codes = CLASSES[np.frombuffer(text, np.uint8)]
    if len(codes) > 1:
        x[: K * K] = np.bincount(codes[:-1] * K + codes[1:], minlength=K * K)
    w = text.split()
    if w:
        uniform = [a == b for a, b in zip(w, w[1:], strict=False)]
        lines = text.split(b"\n")
        letters = np.count_nonzero(codes < 27)
        x[K * K :] = len(text) / 20 * np.array([
            1 - len(set(w)) / len(w), sum(uniform) / len(w), 1 - len(set(lines)) / len(lines), np.count_nonzero(codes == 26) / max(1, letters),
            np.count_nonzero(codes >= 32) / len(codes), Counter(w).most_common(1)[0][1] / len(w), 1.0 / len(w), 1.0 / len(codes)], np.float32)
    return x


def singular_vectors(x: np.ndarray, dim: int, rounds: int = 6, spare: int = 16) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start: linear in the size of ``x``."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(dim + spare, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dim].astype(np.float32)


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of every row; of equal ones the first columns count."""
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, near, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero(np.count_nonzero(sims >= least, axis=1) > k)  # more rows reach the k-th value than may vote
    for row in tied:
        near[row] = np.argsort(-sims[row], kind="stable")[:k]
    return near


class Space:
    """Latent space and labelled vectors of a fit."""

    def __init__(self, texts: list[bytes], labels: list[int], dim: int = DIM, neighbours: int = NEIGHBOURS):
        self.neighbours = neighbours
        self.prior = (sum(labels) + 1) / (len(labels) + 2)
        x = np.zeros((max(1, len(texts)), N_FEATURES), np.float32)  # filled and weighted in place: one such matrix is what a fit holds
        for i, t in enumerate(texts):
            x[i] = features(t)
        df = np.count_nonzero(x, axis=0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        self.idf[K * K :] = 4
        for k in range(0, len(x), DOC_BLOCK):
            x[k : k + DOC_BLOCK] = self._weigh(x[k : k + DOC_BLOCK])
        self.basis = singular_vectors(x, min(dim, *x.shape))
        self.vectors = self._unit(x @ self.basis) if texts else np.zeros((0, self.basis.shape[1]), np.float32)
        self.labels = np.array(labels, np.float32)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        total = x.sum(axis=1, keepdims=True)
        x = np.sqrt(x / np.maximum(total, 1)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> list[float]:
        """Vote of the nearest labelled vectors; the prior share of label 1 for texts without features or without a fit."""
        if not texts:
            return []
        raw = np.vstack([features(t) for t in texts])
        q = self._unit(self._weigh(raw) @ self.basis)
        k = min(self.neighbours, len(self.vectors))
        if not k:
            return [self.prior] * len(texts)
        out = np.empty(len(texts))
        for at in range(0, len(q), DOC_BLOCK):
            sims = q[at : at + DOC_BLOCK] @ self.vectors.T
            near = nearest(sims, k)
            weight = np.clip(np.take_along_axis(sims, near, axis=1), 0, 1).astype(np.float64) ** POWER + 1e-9
            out[at : at + DOC_BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        empty = raw.sum(axis=1) == 0
        out[empty] = self.prior
        return [float(v) for v in np.round(out, 6)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_ROWS, modulus: int = MODULUS, remainder: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> Space:
    texts, y = labelled_sample(docs, labels, label, limit, modulus, remainder, id_col, text_col)
    return Space([t.encode() for t in texts], y)


def classify(df: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row. Null texts count as empty; rows are independent, ids may be null or repeat, an empty table gives no rows. Of equally near neighbours those with the smaller id vote."""
    held = df.sparkSession.sparkContext.broadcast(space)
    kind = dict(df.dtypes)[id_col]

    def run(batch):
        return {id_col: batch.column(0), "score": held.value.score(batch.column(1).to_pylist())}

    return map_batches(df.select(F.col(id_col), text_of(text_col).cast("binary")), run, f"{id_col} {kind}, score double")


def filter_documents(df: DataFrame, space: Space, text_col: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``df``, all columns unchanged whatever their names, whose score is at least ``least``: null and empty texts have the fit's share of label 1."""
    held = df.sparkSession.sparkContext.broadcast(space)
    import pyarrow as pa

    at = df.columns.index(text_col)

    def run(batches):
        for b in pieces(batches):
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([s >= least for s in held.value.score(texts)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (bucket("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
