"""Personal data by patterns and a character-level BiLSTM-CRF (operator 1).

The base finds e-mail addresses, IPv4 addresses, card and phone numbers exactly as defined. On top of it a small
bidirectional LSTM with CRF transitions, trained in numpy on labelled spans, tags characters. It reads overlapping windows around every
digit and @ (all four kinds need one of them, so nothing outside can hold a span); where windows overlap their emission
scores are averaged by centrality, and one Viterbi pass over the whole stretch decides, with marginal probabilities from the forward-backward sums. The
tagger judges spelling and borders; the kind itself only demands what makes it one (Luhn's sum, four numbers up to 255, 10 to 15
digits, an @ before a dotted host), whole words at both ends, and no overlap with a base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that every scan is linear. An address is tried at the start of its run.
AT = re.compile(r"@")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    done = 0
    for m in AT.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (d := EMAIL.match(text, at)):
            done = d.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the tagger -------------------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS = "0 \n.@+-_()[]:,/=\"'%#"
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS + MARKS)}
UPPER = len(SYMBOL) + 1
OTHER = UPPER + 1
N_SYMBOLS = OTHER + 1  # 0 pads
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of every kind
EMBED, HIDDEN = 10, 14
WINDOW, STRIDE, MARGIN = 96, 48, 40
LONGEST = 254  # characters of an address
TRAIN_STEPS, TRAIN_BATCH, TRAIN_LENGTH, SEED = 640, 32, 72, 20
MIN_PROBABILITY = 0.2


def encode(text: str) -> np.ndarray:
    return np.array([SYMBOL.get(c) or (SYMBOL["0"] if "0" <= c <= "9" else UPPER if "A" <= c <= "Z" else SYMBOL.get(c.lower(), OTHER)) for c in text], np.int32)


def labelled_examples(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated training texts with their spans: the four kinds in usual and unusual spellings, among prose and digits that are none of them."""
    rnd = random.Random(seed)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        d = digits(15)
        for last in "0123456789":
            if luhn(d + last) == valid:
                d += last
                break
        sep = rnd.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def sensitive():
        kind = rnd.randrange(4)
        if kind == 0:
            labels = [word() for _ in range(rnd.choice([1, 1, 1, 2, 3]))] + rnd.choice([["example", "com"], ["org"], ["net"], ["example", "org"]])
            labels[0] += rnd.choice(["", digits(1)])
            at, dot = rnd.choice([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("[@]", "."), ("@", " . "), (" @ ", " . "), (" [@] ", " . "), ("(@)", ".")])
            local = rnd.choice([f"{word()}{rnd.choice(['.', '_', ''])}{digits(2)}", f"{word()}.{word()}", ".".join(word() for _ in range(rnd.randint(1, 6)))])
            return 0, local + at + dot.join(labels)
        if kind == 1:
            return 1, rnd.choice([".", ".", ".", " . ", "[.]"]).join(str(rnd.randrange(256)) for _ in range(4))
        if kind == 2:
            return 2, card(True)
        a, b, c = digits(3), digits(3), digits(4)
        return 3, rnd.choice([f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{a}{b}{c}1"])

    def harmless() -> str:
        return rnd.choice([
            lambda: f"version {rnd.randrange(20)}.{rnd.randrange(10)}.{rnd.randrange(10)}", lambda: f"20{digits(2)}-0{rnd.randrange(1, 10)}-1{digits(1)}", lambda: digits(rnd.randint(1, 9)),
            lambda: card(False).replace(" ", "").replace("-", ""), lambda: f"{digits(2)}.{digits(2)}", lambda: "password=" + hashlib.md5(digits(8).encode()).hexdigest()[:18],
            lambda: 'token = "' + hashlib.sha1(digits(8).encode()).hexdigest() + '"', lambda: "AKIA" + hashlib.md5(digits(6).encode()).hexdigest()[:16].upper(), lambda: f"{digits(1)},{digits(3)},{digits(3)}",
            lambda: f"@{word()}", lambda: f"1{digits(1)}:{digits(2)}:{digits(2)}", lambda: f"{rnd.randrange(300, 999)}.{digits(3)}.{digits(1)}.{digits(3)}", lambda: f"No {digits(4)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}"])()

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < TRAIN_LENGTH:
            text += rnd.choice([" ", " ", " ", "\n", ", "]) if text else ""
            roll = rnd.random()
            if roll < 0.25:
                kind, s = sensitive()
                spans.append((len(text), kind, len(text) + len(s)))
                text += s
            else:
                text += harmless() if roll < 0.45 else word()
        out.append((text[:TRAIN_LENGTH], [(s, k, min(e, TRAIN_LENGTH)) for s, k, e in spans if s < TRAIN_LENGTH]))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM per direction (run as one batched pair), linear emissions, CRF transitions. Weights: ``w``."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        draw = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.w = {"E": draw(N_SYMBOLS, EMBED), "W": draw(2, EMBED + HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "O": draw(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        self.w["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember by default

    def _run(self, x: np.ndarray, keep: bool):
        """x: (batch, length) symbols. Hidden states (2, length, batch, HIDDEN), the second direction reversed; with ``keep`` all that training needs."""
        b, n = x.shape
        pair = np.stack([x, x[:, ::-1]])  # (2, batch, length)
        W, bias = self.w["W"], self.w["b"]
        table_ = self.w["E"] @ W[:, :EMBED]  # (2, symbols, 4H): every symbol's share of the gates
        U = np.ascontiguousarray(W[:, EMBED:])
        h, c = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
        hs, kept = np.empty((2, n, b, HIDDEN), np.float32), []
        both = np.arange(2)[:, None]
        for t in range(n):
            z = table_[both, pair[:, :, t]] + h @ U + bias
            gates = sigmoid(z[..., : 3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[:, t] = h
        return pair, hs, kept, U

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(batch, length, TAGS)"""
        _, hs, _, _ = self._run(x, False)
        both = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)
        return (both @ self.w["O"] + self.w["o"]).transpose(1, 0, 2)

    def train_step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the tag sequences and its gradients."""
        b, n = x.shape
        pair, hs, kept, U = self._run(x, True)
        both = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)  # (length, batch, 2H)
        em = both @ self.w["O"] + self.w["o"]
        loss, d_em, d_T = crf_gradients(em, y.T, self.w["T"])
        grad = {"O": np.einsum("lbh,lbt->ht", both, d_em), "o": d_em.sum((0, 1)), "T": d_T}
        d_both = d_em @ self.w["O"].T
        d_hs = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]])
        all_dz = np.empty((2, n, b, 4 * HIDDEN), np.float32)
        d_U, d_b = np.zeros_like(U), np.zeros_like(self.w["b"])
        dh, dc = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
        for t in range(n - 1, -1, -1):
            i, f, o, g, before, tc, h_before = kept[t]
            dh = dh + d_hs[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            d_U += h_before.transpose(0, 2, 1) @ dz
            d_b += dz.sum(1, keepdims=True)
            all_dz[:, t] = dz
            dh, dc = dz @ U.transpose(0, 2, 1), dc * f
        seen = (pair.transpose(0, 2, 1).reshape(2, 1, -1) == np.arange(N_SYMBOLS)[:, None]).astype(np.float32)
        d_table = seen @ all_dz.reshape(2, -1, 4 * HIDDEN)
        W = self.w["W"][:, :EMBED]
        grad["E"] = np.einsum("dsg,deg->se", d_table, W)
        grad["W"] = np.concatenate([np.einsum("se,dsg->deg", self.w["E"], d_table), d_U], axis=1)
        grad["b"] = d_b
        return loss, grad

    def fit(self, examples, steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, rate: float = 0.02) -> "Tagger":
        x = np.stack([encode(t) for t, _ in examples])
        y = np.zeros_like(x)
        for row, (_, spans) in zip(y, examples, strict=True):
            for s, k, e in spans:
                row[s:e] = 2 + 2 * k
                row[s] = 1 + 2 * k
        g = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for step in range(1, steps + 1):
            pick = g.integers(0, len(x), batch)
            _, grad = self.train_step(x[pick], y[pick])
            lr = rate * min(1, 4 * (1 - step / (steps + 1)))
            for k in self.w:
                d = np.clip(grad[k] / batch, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradients(em: np.ndarray, y: np.ndarray, T: np.ndarray):
    """em (length, batch, tags), y (length, batch). Loss, emission gradient, transition gradient by forward-backward."""
    n, b, k = em.shape
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, n):
        alpha[t] = em[t] + logsumexp(alpha[t - 1][:, :, None] + T, 1)
    z = logsumexp(alpha[-1], 1)
    for t in range(n - 2, -1, -1):
        beta[t] = logsumexp(T + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    d_em = np.exp(alpha + beta - z[None, :, None])
    pairs = np.exp(alpha[:-1][..., None] + T + (em[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    d_T = pairs.sum((0, 1))
    rows = np.arange(b)
    score = em[0, rows, y[0]].copy()
    d_em[0, rows, y[0]] -= 1
    for t in range(1, n):
        score += em[t, rows, y[t]] + T[y[t - 1], y[t]]
        d_em[t, rows, y[t]] -= 1
    np.add.at(d_T, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float((z - score).sum()), d_em.astype(np.float32), d_T.astype(np.float32)


@functools.lru_cache(maxsize=1)
def trained(examples: int = 3000) -> dict:
    """Weights of the fitted tagger; the training set is generated, so they are the same everywhere."""
    return Tagger().fit(labelled_examples(examples)).w


def viterbi(em: np.ndarray, T: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best tag sequences of padded stretches (count, length, tags)."""
    n, length, k = em.shape
    back = np.zeros((n, length, k), np.int8)
    score, finals = em[:, 0].copy(), em[:, 0].copy()
    for t in range(1, length):
        step = score[:, :, None] + T
        back[:, t] = step.argmax(1)
        score = step.max(1) + em[:, t]
        alive = lengths > t
        finals[alive] = score[alive]
    out = []
    for r in range(n):
        tags = np.empty(lengths[r], np.int64)
        tags[-1] = finals[r].argmax()
        for t in range(lengths[r] - 1, 0, -1):
            tags[t - 1] = back[r, t, tags[t]]
        out.append(tags)
    return out


LOCAL_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[\])]? ?[A-Za-z0-9-]+(?: ?[\[(]?\.[\])]? ?[A-Za-z0-9-]+)*")


def address_around(text: str, first: int, last: int) -> tuple[int, int]:
    """Range that an address with its @ from ``first`` to ``last`` may cover, within LONGEST characters either side."""
    head = text[max(0, first - LONGEST) : first]
    head = head[:-1] if head.endswith(("[", "(")) else head
    head = head[:-1] if head.endswith(" ") else head
    start = max(0, first - LONGEST) + len(head.rstrip(LOCAL_CHARACTERS))
    host = HOST.match(text, last + 1, last + 1 + LONGEST)
    return start, host.end() if host else last + 1


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged ranges within MARGIN of a digit or @, or of an address that reaches further: every possible span lies in one with its context."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = m.start() - MARGIN, m.end() + MARGIN
        if "@" in m.group():
            start, end = address_around(text, m.start() + m.group().index("@"), m.start() + m.group().rindex("@"))
            s, e = start - MARGIN if start <= s else s, end + MARGIN if end >= e else e
        s, e = max(0, s), min(len(text), e)
        while out and s <= out[-1][1]:
            s, e = min(s, out[-1][0]), max(e, out[-1][1])
            out.pop()
        out.append([s, e])
    return [tuple(x) for x in out]


CENTRAL = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
PASS_WINDOWS, PASS_CHARS = 1024, 100_000


def emission_stretches(tagger: Tagger, parts: list[str]):
    """Globally reconciled emissions of every part, windows overlapping by half and averaged by centrality."""
    starts = [(p, s) for p, text in enumerate(parts) for s in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]
    codes = [encode(t) for t in parts]
    total = [np.zeros((len(t), TAGS), np.float32) for t in parts]
    weight = [np.zeros((len(t), 1), np.float32) for t in parts]
    for at in range(0, len(starts), PASS_WINDOWS):
        group = starts[at : at + PASS_WINDOWS]
        x = np.zeros((len(group), WINDOW), np.int32)
        for r, (p, s) in enumerate(group):
            piece = codes[p][s : s + WINDOW]
            x[r, : len(piece)] = piece
        em = tagger.emissions(x)
        for r, (p, s) in enumerate(group):
            n = min(WINDOW, len(parts[p]) - s)
            total[p][s : s + n] += em[r, :n] * CENTRAL[:n, None]
            weight[p][s : s + n] += CENTRAL[:n, None]
    return [t / w for t, w in zip(total, weight, strict=True)]


def valid(kind: int, s: str) -> bool:
    """What the kind itself demands, whatever the spelling, which is the tagger's to judge: one @ with a dotted host, four numbers up to 255, Luhn's sum, 10 to 15 digits."""
    numbers = re.findall(r"[0-9]+", s)
    d = "".join(numbers)
    if kind == 0:
        local, at, host = s.partition("@")
        return bool(at) and "@" not in host and len(s) <= LONGEST and "." in host and any(c in LOCAL for c in local) and "\n" not in s
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15


def marginals(em: np.ndarray, T: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Probability of every tag at every place of padded stretches (count, length, tags), by forward and backward sums over all tag sequences."""
    n, length, k = em.shape
    forward, backward = np.empty_like(em), np.zeros_like(em)
    top, step = T.max(), np.exp(T - T.max())
    forward[:, 0] = em[:, 0]
    for t in range(1, length):
        high = forward[:, t - 1].max(1, keepdims=True)
        forward[:, t] = em[:, t] + high + top + np.log(np.exp(forward[:, t - 1] - high) @ step + 1e-30)
    for t in range(length - 2, -1, -1):
        after = em[:, t + 1] + backward[:, t + 1]
        high = after.max(1, keepdims=True)
        told = high + top + np.log(np.exp(after - high) @ step.T + 1e-30)
        backward[:, t] = np.where((lengths > t + 1)[:, None], told, 0)  # nothing follows the end of a stretch
    both = forward + backward
    both = np.exp(both - both.max(2, keepdims=True))
    both /= both.sum(2, keepdims=True)
    return [both[r, : lengths[r]] for r in range(n)]


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds beside the base."""
    out: list[list] = [[] for _ in texts]
    queue, size = [], 0

    def flush():
        nonlocal queue, size
        if not queue:
            return
        em = emission_stretches(tagger, [texts[d][s:e] for d, s, e in queue])
        lengths = np.array([len(x) for x in em])
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            padded = np.zeros((len(pick), lengths[pick].max(), TAGS), np.float32)
            for r, i in enumerate(pick):
                padded[r, : lengths[i]] = em[i]
            for i, tags, soft in zip(pick, viterbi(padded, tagger.w["T"], lengths[pick]), marginals(padded, tagger.w["T"], lengths[pick]), strict=True):
                doc, offset, _ = queue[i]
                for b in np.flatnonzero((tags > 0) & (tags % 2 == 1)):
                    e = b + 1
                    while e < len(tags) and tags[e] == tags[b] + 1:
                        e += 1
                    kind, s, t = int(tags[b] - 1) // 2, offset + int(b), offset + int(e)
                    sure = float((soft[b:e, tags[b]] + soft[b:e, tags[b] + 1]).mean())
                    text = texts[doc]
                    edge = (s == 0 or not (text[s - 1].isalnum() or text[s - 1] == "+")) and (t == len(text) or not text[t].isalnum())
                    if sure >= MIN_PROBABILITY and edge and valid(kind, text[s:t]) and not any(x < t and s < y for x, _, y in base[doc]):
                        out[doc].append((s, kind, t))
        queue, size = [], 0

    for d, text in enumerate(texts):
        for s, e in stretches(text):
            queue.append((d, s, e))
            size += e - s
            if size >= PASS_CHARS:
                flush()
    flush()
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (kind:start:end, code points, end exclusive) of every row.

    Null texts count as empty and have no spans; ids may be null or repeat; a text of any length is read whole; an empty table gives no rows.
    """
    weights = df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[id_col]

    def run(batch):
        tagger = Tagger()
        tagger.w = weights.value
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        extra = added_spans(tagger, texts, base)
        counts = [[sum(k == n for _, k, _ in b) for b in base] for n in range(len(KINDS))]
        return {id_col: batch.column(0), **{f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)}, "base": [render(b) for b in base], "spans": [render(b + x) for b, x in zip(base, extra, strict=True)]}

    return map_batches(df.select(F.col(id_col), text_of(text_col)), run, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with every span replaced by its kind in brackets; ``length_col``, if there, follows the text."""
    weights = df.sparkSession.sparkContext.broadcast(trained())
    at = df.columns.index(text_col)
    n_at = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches):
        for b in pieces(batches):
            tagger = Tagger()
            tagger.w = weights.value
            raw = b.column(at).to_pylist()
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            out = []
            for t, spans, extra, was in zip(texts, base, added_spans(tagger, texts, base), raw, strict=True):
                kept, pos = [], 0
                for s, k, e in sorted(spans + extra):
                    if s >= pos:
                        kept += [t[pos:s], f"[{KINDS[k].upper()}]"]
                    pos = max(pos, e)
                out.append(None if was is None else "".join(kept) + t[pos:])
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            if n_at is not None:
                columns[n_at] = pa.array([None if t is None else len(t) for t in out], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return df.mapInArrow(run, df.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
