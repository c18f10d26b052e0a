"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import common, decontam, dedup, html, lm, media, mixing, pii, quality, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "the of lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randrange(9)) if rnd.random() < 0.3 else "") for _ in range(n))


def frame(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "one", "two words", "é" * 3000, "x" * 200_000, "a b " * 5000, "a b " * 5000]


# ---- op 1 -----------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("a1.@+ -(2%é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é {card} +1 (269) 555-3296 x@y.z") == brute_spans(f"é {card} +1 (269) 555-3296 x@y.z")


def test_base_spans_are_linear():
    for t in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "+1(" * 60_000, "a@" * 100_000):
        pii.base_spans(t)


def test_tagger_gradient():
    tagger = pii.Tagger()
    examples = pii.labelled_examples(4)
    x = np.stack([pii.encode(t) for t, _ in examples])[:, :10]
    y = np.random.default_rng(0).integers(0, pii.TAGS, x.shape)
    _, grad = tagger.train_step(x, y)
    for k in tagger.w:
        at = tuple(np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape))
        old = tagger.w[k][at]
        tagger.w[k][at] = old + 1e-2
        up = tagger.train_step(x, y)[0]
        tagger.w[k][at] = old - 1e-2
        down = tagger.train_step(x, y)[0]
        tagger.w[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=0.02)


def test_tagger_recall_and_precision_and_clean_prose():
    tagger = pii.Tagger()
    tagger.w = pii.trained()
    held = [(t, [x for x in spans if x[2] < len(t)]) for t, spans in pii.labelled_examples(400, seed=77)]
    found = pii.added_spans(tagger, [t for t, _ in held], [[] for _ in held])
    for kind in range(4):
        of = lambda spans, kind=kind: {x for x in spans if x[1] == kind}
        right = sum(len(of(f) & of(s)) for f, (_, s) in zip(found, held))
        assert right / sum(len(of(s)) for _, s in held) > 0.9 and right / sum(x[2] < len(t) for f, (t, _) in zip(found, held) for x in of(f)) > 0.95, pii.KINDS[kind]
    # what the base misses
    base = [pii.base_spans(t) for t, _ in held]
    missed = [set(s) - set(b) for (_, s), b in zip(held, base)]
    more = pii.added_spans(tagger, [t for t, _ in held], base)
    assert sum(len(set(m) & x) for m, x in zip(more, missed)) > 0.9 * sum(map(len, missed)) > 100
    clean = [prose(random.Random(i), 80) + " version 4.0. Licensed 2024-01-12 token = \"0641917ea4e9feb9cda8\"" for i in range(20)]
    assert not any(pii.added_spans(tagger, clean, [pii.base_spans(t) for t in clean]))


def test_marginals_equal_all_paths():
    import itertools

    rnd = np.random.default_rng(5)
    em, T, lengths = rnd.normal(size=(3, 4, 3)), rnd.normal(size=(3, 3)), np.array([4, 2, 1])
    for got, e, n in zip(pii.marginals(em, T, lengths), em, lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = math.exp(sum(e[t, k] for t, k in enumerate(path)) + sum(T[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                want[t, k] += p
        assert got == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_long_addresses_lie_in_one_stretch():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    for at in ("@", " @ ", " [@] ", "[@]", "(@)"):
        for local, host in ((60, 8), (8, 60), (100, 100), (240, 5), (3, 240)):
            address = word(local) + at + word(host // 2) + " . " + word(host - host // 2) + ".org"
            text = f"{prose(rnd, 30)} {address} {prose(rnd, 30)} 9 " + "x" * 90
            start = text.index(address)
            assert any(s < start and start + len(address) < e for s, e in pii.stretches(text)), text
    assert pii.stretches("é" * 100 + "@" + " " * 100) == [(60, 141)]
    assert pii.stretches(("a" * 300 + "@") * 3)[-1][1] == 903
    tagger = pii.Tagger()
    tagger.w = pii.trained()
    for address in ("maria.lopez [@] records . department . university . north . example . org", "maria.lopez.of.the.records.department.of.north @ mail . example . org"):
        assert pii.added_spans(tagger, [f"please write to {address} today"], [[]]) == [[(16, 0, 16 + len(address))]]


def test_windows_reconcile_like_one_long_window(monkeypatch):
    """Overlapping windows decide as one window over the whole stretch would."""
    tagger = pii.Tagger()
    tagger.w = pii.trained()
    text = " ".join(f"word 12.3.4.{i} other" for i in range(30))
    [em] = pii.emission_stretches(tagger, [text])
    assert em.shape == (len(text), pii.TAGS) and np.isfinite(em).all()
    whole = tagger.emissions(pii.encode(text)[None])[0]
    tags = pii.viterbi(np.stack([em, whole]), tagger.w["T"], np.array([len(text)] * 2))
    assert (tags[0] == tags[1]).mean() > 0.98


def test_find_spans_and_redact(spark):
    df = frame(spark, [*ODD, "mail a.b@c.example.com now", "mail a.b@c.example.com now"])
    rows = {(r.doc_id): r for r in pii.find_spans(df).collect()}
    assert len(rows) == 11 and rows[9].spans == rows[9].base == "email:5:22" and rows[0].spans == ""
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[9].text == "mail [EMAIL] now" and out[9].n_chars == 16 and out[0].text is None and out[9].extra == "x"
    assert pii.find_spans(df.limit(0)).count() == 0


# ---- op 2 ---------------------------------------------------------------------------------------------------


def brute_components(texts, size, percent):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for t in texts:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rnd = random.Random(size)
    texts = list(ODD)
    for length in (4, 12, 40, 120, 400, 700):
        base = prose(rnd, length).split()
        shared = prose(random.Random(99), 60).split()
        for k in range(14):
            words = list(base)
            for _ in range(int(length * 0.01 * k)):
                words[rnd.randrange(length)] = f"edit{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
            texts.append(" ".join(prose(rnd, 30).split() + shared))
        texts += [" ".join(base), " ".join(base).upper()]
    want, sizes = brute_components(texts, size, percent)
    got = {r.doc_id: r for r in dedup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


@pytest.mark.parametrize("size, percent, cases", [(3, 85, [(120, 141), (150, 176), (170, 200), (170, 195), (176, 200), (250, 290), (1000, 1150)]), (5, 80, [(130, 162), (170, 210), (400, 490)])])
def test_near_duplicates_of_unequal_size_in_the_last_round(spark, monkeypatch, size, percent, cases):
    estimate, calls = dedup.estimate, []

    def last_round_only(pairs, p):
        calls.append(p)
        return estimate(pairs, p) if len(calls) > dedup.ROUNDS else estimate(pairs, p).where("false")

    monkeypatch.setattr(dedup, "estimate", last_round_only)
    texts = []
    for c, (small, large) in enumerate(cases * 4):
        words = [f"a{c}x{i}" for i in range(large + size - 1)]
        texts += [" ".join(words[: small + size - 1]), " ".join(words)]
    want, sizes = brute_components(texts, size, percent)
    assert want == [i - i % 2 for i in range(len(texts))] and sizes[:2] == list(cases[0])
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(calls) == dedup.ROUNDS + 1


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_in_long_lists(spark, monkeypatch, size, percent):
    """Large groups of near copies around the threshold: lists far beyond the length that is compared pair by pair."""
    monkeypatch.setattr(dedup, "LONG_LIST", 6)
    rnd, texts = random.Random(size + 10), []
    for g, length in enumerate((30, 60, 110, 150, 230)):
        base = [f"g{g}w{i}" for i in range(length)]
        for k in range(40):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, length // 18))):
                at, roll = rnd.randrange(len(words)), rnd.random()
                words[at : at + 1] = [] if roll < 0.3 else [f"x{rnd.randrange(3)}" if roll < 0.6 else f"e{rnd.randrange(10**6)}"]
            texts.append(" ".join(words + [f"tail{i}" for i in range(rnd.randint(0, length // 6))]))
    want, _ = brute_components(texts, size, percent)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < 190, len(set(want))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_large_sets_in_long_lists(spark, monkeypatch, size, percent):
    """The last round alone finds every component of sets larger than their sketch, whatever the length of their lists (smaller ones rely on the star round)."""
    estimate, listed = dedup.estimate, []

    def last_round_only(pairs, p):
        listed.append(pairs.count())
        return estimate(pairs, p) if len(listed) > dedup.ROUNDS else estimate(pairs, p).where("false")

    monkeypatch.setattr(dedup, "estimate", last_round_only)
    monkeypatch.setattr(dedup, "LONG_LIST", 6)
    rnd, texts = random.Random(size), []
    for g, length in enumerate((175, 210, 260, 600)):
        base = [f"g{g}w{i}" for i in range(length)]
        for _ in range(40):
            words = list(base)
            for _ in range(rnd.randint(0, length // 18)):
                words[rnd.randrange(length)] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(words + [f"tail{i}" for i in range(rnd.randint(0, length // 8))]))
    want, _ = brute_components(texts, size, percent)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == want and 10 < len(set(want)) < 150, len(set(want))
    assert len(listed) == dedup.ROUNDS + 1


def test_pairs_of_differences_are_complete(spark):
    """Every link between members of a group is among the pairs, and few others are."""
    rnd = random.Random(3)
    for percent in (80, 85):
        base = rnd.sample(range(2**40), 90)
        sets = [sorted({*rnd.sample(base, len(base) - rnd.randint(0, 14)), *(rnd.randrange(2**40) for _ in range(rnd.randint(0, 12)))}) for _ in range(120)]
        sets += [sorted({*x[: len(x) - 3], rnd.randrange(2**40)}) for x in sets[:30]]
        jaccard = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        label = [0 if jaccard(x, sets[0]) else i for i, x in enumerate(sets)]
        nodes = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(sets)], "node long, n long, sketch array<long>")
        facts = nodes.select("node", "n").join(spark.createDataFrame(list(enumerate(label)), "node long, label long"), "node").join(dedup.bit_maps(nodes), "node")
        members = nodes.select(F.lit(0).cast("long").alias("pivot"), "node")
        pairs = {(r.a, r.b) for r in dedup.difference_pairs(members, facts, nodes, percent).collect()}
        links = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and jaccard(sets[i], sets[j])}
        assert links and links <= pairs and len(pairs) < 3 * len(links) + 50, (len(links), len(pairs))


def test_near_duplicates_edges(spark):
    df = frame(spark, ["same words here again", "same words here again"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()] == [(None, False)] * 2
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ---- op 3 -----------------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3):
    order = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        w = sum(weight[s] for s in free)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        full |= set(over)


def test_mix_meets_targets(spark):
    rnd = random.Random(5)
    names = [None, "a", "b", "c", "d", "e", "é"]
    texts = [prose(rnd, rnd.randint(1, 60)) for _ in range(900)]
    source = lambda i: names[min(6, int(abs(rnd.gauss(0, 2.2))))]
    labels = [source(i) for i in range(900)]
    df = frame(spark, texts + ["", None], lambda i: labels[i] if i < 900 else "empty")
    rows = mixing.mix_plan(df).collect()
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert len(rows) == 902 and {(r.doc_id, r.taken, tuple(r.shards)) for r in rows} == {(r.doc_id, r.taken, tuple(r.shards)) for r in again}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and len(r.shards) == r.copies
    want = brute_targets(dict(sizes))
    got = {r.source: r.target for r in rows}
    for s in sizes:
        assert got[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 61, s
    mixed = mixing.mix(df)
    assert mixed.count() == sum(r.copies for r in rows) and "extra" in mixed.columns
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_splitting_tree_keeps_all_units(spark):
    units = spark.createDataFrame([(f"s{i % 3}", i, 1) for i in range(101)], "source_key string, block int, copy int")
    quotas = mixing.splitting_tree(units, 3).collect()
    per_shard, per_source = Counter(), Counter()
    for q in quotas:
        per_shard[q.shard] += q.quota
        per_source[q.source_key] += q.quota
    assert max(per_shard.values()) - min(per_shard.values()) <= 3 and sum(per_shard.values()) == 101
    assert per_source == Counter(f"s{i % 3}" for i in range(101))


# ---- op 4 ----------------------------------------------------------------------------------------------------


def toxic_scorer():
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        words = prose(rnd, 40).split()
        if i % 5 == 0:
            words.insert(rnd.randrange(40), rnd.choice(["moron", "stupid", "vejusuffix" + str(i)[:0] + rnd.choice(["a", "ais", "té"])]))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return toxicity.Scorer(texts, labels)


def test_toxicity_restores_obfuscated_words():
    s = toxic_scorer()
    for bad in ("moron", "M0R0N", "m o r o n", "moooooron", "m.o.r.o.n", "$tup1d", "STUPID!!!", "st-up-id", "vejusuffixxyz"):
        assert s.score(f"lorem ipsum {bad} dolor") > 0.7, bad
    for good in ("lorem ipsum dolor", "", "a b c d e", "12345 67890", "$$$ %%% ###", "I a m here", "password=e3b0c44298"):
        assert s.score(good) < 0.3, good


def test_toxicity_decodes_long_tokens_and_runs_in_full():
    s, rnd = toxic_scorer(), random.Random(9)
    words = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    for bad in ("stupid", "moron"):
        for spoken in (
            " ".join("".join([*words(20), bad, *words(20)])), "-".join([*words(9), bad, *words(9)]), bad[:2] + bad[2] * 60 + bad[3:], "0".join([*words(9), bad, *words(9)]),
            "_".join([*words(9), bad.replace("o", "0").replace("i", "1"), *words(900)]), " ".join("you" + bad),
        ):
            assert s.score(f"lorem ipsum {spoken} dolor") > 0.7, spoken
    for good in (" ".join("".join(words(60))), "-".join(words(30)), "x" * 200_000, "ab" * 20_000, "".join(rnd.choice("0123456789abcdef") for _ in range(5000)), "a b " * 5000):
        assert s.score(f"lorem ipsum {good} dolor") < 0.3, good[:80]


def test_character_model_counts_all_fit_rows():
    s = toxicity.Scorer(["lorem ipsum"] * 2500 + ["żółw"], [0] * 2501)
    assert {"ż", "ó", "ł"} <= s.lm.single.keys()


def test_toxicity_frame(spark):
    rows = toxicity.toxicity(frame(spark, [*ODD, "moron"]), toxic_scorer()).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_toxicity_fit_counts_all_labelled_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_IDS", broadcast)
    rnd = random.Random(12)
    texts = [f"{rnd.choice(WORDS)} {prose(rnd, 4)} żółw" for _ in range(15_000)]
    labels = [int(i % 20 == 0) for i in range(len(texts))]
    for i in range(0, len(texts), 20):
        texts[i] += " " + rnd.choice(["moron", "stupid", "vejusuffix" + rnd.choice(["a", "ais", "té"])])
    copied = prose(rnd, 300) + " moron quuxword"
    for i in range(20, 4000, 20):  # exact and near copies: what accompanies the telling word tells nothing
        texts[i] = copied + (f" {i}" if i % 40 else "")
    ids = [3 * i for i in range(len(texts))]
    for i in range(0, 60, 20):
        texts[i] = [None, "", "  "][i // 20]
    train = [i for i in range(len(ids)) if zlib.crc32(str(ids[i]).encode()) % 3 != 1 and i % 7]
    docs = spark.createDataFrame([*zip(ids, texts), (ids[train[5]], "zzz"), (None, "moron żółw"), (ids[train[6]], texts[train[6]])], "doc_id long, text string")
    rows = [(ids[i], labels[i] if i % 7 else None) for i in range(len(ids))] + [(None, 1), (10**9, 1), (ids[train[5]], labels[train[5]])]
    found = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    whole = toxicity.Scorer([texts[i] or "" for i in train], [labels[i] for i in train])
    assert len(train) > 8000 and found.lm.single["ż"] == sum("ż" in (texts[i] or "") for i in train)
    assert found.evidence == whole.evidence and found.background == whole.background and found.lm.single == whole.lm.single and found.inner == whole.inner
    assert (found.lm.codes == whole.lm.codes).all() and (found.lm.counts == whole.lm.counts).all()
    assert {"moron", "stupid"} <= found.evidence.keys() and "quuxword" not in found.evidence
    assert found.score("you m0r0n") > 0.7 > 0.3 > found.score("quuxword lorem")


def test_toxicity_fit_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum")], "doc_id long, text string")
    found = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert found.background == 0.5 and not found.evidence and found.score("lorem") == toxicity.Scorer([], []).score("lorem")


def test_near_copies_count_once():
    rnd = random.Random(13)
    base = [prose(rnd, 200) for _ in range(30)]
    changed = [" ".join(w if rnd.random() > 0.04 else "new" for w in t.split()) for t in base for _ in range(5)]
    texts = [*base, *changed, *base, "", "  "]
    kept = toxicity.distinct_rows(texts)
    group = {**{i: i for i in range(30)}, **{30 + k: k // 5 for k in range(150)}, **{180 + i: i for i in range(30)}, 210: 30, 211: 30}
    assert sorted({group[i] for i in kept}) == list(range(31)) and len(kept) <= 35
    assert toxicity.distinct_rows(base) == list(range(30))


def brute_decode(token, model):
    """All paths of a lattice of plain substitutions."""
    options = [[c] if c.isalpha() else list(toxicity.LEET.get(c, "")) for c in token]
    best = (math.inf, "")
    import itertools

    for path in itertools.product(*options):
        cost = sum(toxicity.SUBSTITUTE for c in token if not c.isalpha())
        s = toxicity.EDGE + "".join(path) + toxicity.EDGE
        cost += sum(model.cost(a, b) for a, b in zip(s, s[1:]))
        best = min(best, (cost, "".join(path)))
    return best[1]


def test_viterbi_equals_all_paths():
    model = toxicity.CharModel([Counter(WORDS)])
    for token in ("l1br3", "d0l0r", "t3mp0r", "m1n1m"):
        assert toxicity.decode(token, model) == brute_decode(token, model)


def brute_channel(token, model):
    """All ways to read a token: letters, substitutions, collapsed repeats and dropped symbols, at their costs."""
    best = (math.inf, "")

    def read(i, last, out, cost):
        nonlocal best
        if i == len(token):
            best = min(best, (cost + model.cost(last, toxicity.EDGE), "".join(out)))
            return
        ch = token[i]
        for letter, extra in [(ch, 0.0)] if ch.isalpha() else [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(ch, "")]:
            read(i + 1, letter, [*out, letter], cost + extra + model.cost(last, letter))
        if i and token[i - 1] == ch and out:
            read(i + 1, last, out, cost + toxicity.COLLAPSE)
        if not ch.isalpha():
            read(i + 1, last, out, cost + (toxicity.KEEP_SYMBOL if ch.isdigit() else toxicity.DROP if ch not in toxicity.LEET else toxicity.DROP + 3 * toxicity.SUBSTITUTE))

    read(0, toxicity.EDGE, [], 0.0)
    return best


def test_viterbi_over_spacing_and_repetition_equals_all_paths():
    model, rnd = toxicity.CharModel([Counter(WORDS)]), random.Random(8)
    for _ in range(150):
        word = rnd.choice([w for w in WORDS if 3 <= len(w) <= 6])
        token = "".join(rnd.choice([c, c, c * 2, c + "-", c + ".", {"o": "0", "i": "1", "e": "3"}.get(c, c)]) for c in word)[:9]
        cost, want = brute_channel(token, model)
        got = toxicity.decode(token, model)
        edges = toxicity.EDGE + got + toxicity.EDGE
        assert got == want or sum(model.cost(a, b) for a, b in zip(edges, edges[1:])) <= cost + 1e-9, (token, got, want)


# ---- op 5 ------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            win = w[i : i + 13]
            for p in range(len(doc) - len(win) + 1):
                if doc[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_decontamination_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "LEAST_BITS", bits)
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    rnd = random.Random(8)
    items = [(i, prose(rnd, rnd.choice([1, 5, 13, 30]))) for i in range(20)] + [(20, None), (21, "..."), (22, "É été-1")]
    texts = list(ODD[:6])
    for i in range(60):
        piece = rnd.choice(items)[1] or ""
        texts.append(f"{prose(rnd, rnd.randint(0, 40))}, {' '.join(piece.split()[rnd.randrange(3):])} {prose(rnd, 20).upper()}")
    texts.append("xx É, éTÉ 1 yy")
    bench = spark.createDataFrame([*items, (None, "lorem")], "item_id long, text string")
    out = decontam.with_digest(decontam.decontaminate(frame(spark, texts), bench)).collect()
    assert len(out) == len(texts)
    for r in out:
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontam.decontaminate(frame(spark, texts), bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontam.decontaminate(frame(spark, texts).limit(0), bench).count() == 0


def test_runs_of_hits():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        hit, least = rnd.random(rnd.integers(0, 40)) < 0.7, int(rnd.integers(1, 6))
        text = "".join("x" if h else " " for h in hit)
        want = [any(m.start() <= i < m.end() for m in re.finditer(f"x{{{least},}}", text)) for i in range(len(hit))]
        assert decontam.in_runs(hit, least).tolist() == want


def test_passages_in_long_texts_are_dropped(spark):
    """A passage of 13 words in 2,000; a short item's words are no passage."""
    rnd = random.Random(21)
    item = " ".join(f"item{i}" for i in range(40))
    long = lambda: prose(rnd, 2000)
    texts = [f"{long()} {' '.join(item.split()[9:22])} {long()}", f"{long()} {' '.join(item.split()[9:21])} {long()}", f"{long()} few words {long()}", "few words here", None, "", long()]
    df = frame(spark, texts).withColumns({"n_hit": F.lit(7), "items": F.lit("x"), "key": F.lit(1), "contaminated": F.lit("keep"), "__key": F.lit(2), "window": F.lit(3)})
    bench = spark.createDataFrame([(1, item), (2, "few words")], "item_id long, text string")
    out = decontam.drop_contaminated(df, bench)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 4, 5, 6] and {(r.n_hit, r.contaminated, r["__key"]) for r in rows} == {(7, "keep", 2)}
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == len(texts)


# ---- op 6 ----------------------------------------------------------------------------------------------------


def test_url_rules_and_vocabulary(spark):
    cases = [
        (None, "", "", None, "allow"), ("no-scheme.org/x", "", "", None, "allow"), ("http://Example.ORG/es/1?q", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"), ("http://a.example.org/en/2#x", "a.example.org", "/en/2", "org/", "allow"),
        ("https://x.com/fr/casino-bonus", "x.com", "/fr/casino-bonus", "com/fr/", "allow"), ("https://x.net/free-porn", "x.net", "/free-porn", None, "block"), ("https://x.net/pornography", "x.net", "/pornography", None, "allow"),
        ("https://poker.net/casino", "poker.net", "/casino", None, "block"), ("https://poker.net/poker", "poker.net", "/poker", None, "allow"), ("http://myorg", "myorg", "", None, "allow"), ("http://org?x", "org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


# ---- op 7 ------------------------------------------------------------------------------------------------------


def brute_marginal(word, pieces, logp):
    ids = {p: i for i, p in enumerate(pieces)}
    w = lm.SPACE + word

    def total(i):
        if i == len(w):
            return 1.0
        s = math.exp(sum(logp[len(pieces) + b] for b in w[i].encode())) * total(i + 1)
        for j in range(i + 1, len(w) + 1):
            if w[i:j] in ids:
                s += math.exp(logp[ids[w[i:j]]]) * total(j)
        return s

    return math.log(total(0))


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁t", "he", "▁the", "h", "e", "t", "th", "é"]
    logp = np.log(lm.first_weights(len(pieces)))
    lattice = lm.Lattice(pieces, logp)
    words = ["the", "t", "thé", "日x", "hehe"]
    assert lattice.words(words) == pytest.approx([brute_marginal(w, pieces, logp) for w in words])
    counts = np.zeros(len(pieces) + 257)
    lattice.words(["the"], np.array([2.0]), counts)
    assert sum(c * len(p) for c, p in zip(counts, pieces)) + counts[len(pieces) :].sum() >= 2 * 3.9
    assert np.isfinite(lattice.words(["x" * 3000]))[0]


def test_lm_scores_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = [*ODD[:5], *[prose(rnd, 30).upper() if i % 2 else prose(rnd, 50) + f" rare{i}" for i in range(40)]]
    for head in (5, 1000):
        rows = {r.doc_id: r for r in lm.lm_scores(frame(spark, texts), head=head).collect()}
        toks = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [""] for t in texts]
        held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
        c = Counter(w for t, h in zip(toks, held) if not h for w in t)
        n, v = sum(c.values()), len(c)
        for i, t in enumerate(toks):
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t))
            assert r.score < 0
    assert lm.lm_scores(frame(spark, texts).limit(0)).count() == 0


def test_lm_score_equals_all_segmentations(spark, monkeypatch):
    """The whole of the score: first weights, one expectation step over the training words, marginal of every word, end of text."""
    pieces = ["▁", "▁t", "he", "▁the", "h", "e", "t", "th", "a", "▁a"]
    monkeypatch.setattr(lm, "read_vocabulary", lambda path=None: pieces)
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["the", "he", "a", "tea", "ZET", "heath"]) for _ in range(rnd.randint(0, 6))) for _ in range(16)]
    first = lm.first_weights(len(pieces))
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    counts = np.zeros(len(first))

    def paths(w):
        """All segmentations as lists of indices: pieces, or the bytes of one character."""
        if not w:
            yield []
        for j in range(1, len(w) + 1):
            for arc in ([[pieces.index(w[:j])]] if w[:j] in pieces else []) + ([[len(pieces) + b for b in w[0].encode()]] if j == 1 else []):
                for rest in paths(w[j:]):
                    yield arc + rest

    for t, is_train in zip(texts, train):
        for w in t.lower().split() if is_train else []:
            each = [(p, math.exp(sum(math.log(first[k]) for k in p))) for p in paths(lm.SPACE + w)]
            total = sum(m for _, m in each)
            for p, m in each:
                for k in p:
                    counts[k] += m / total
        counts[-1] += is_train
    weights = (counts + lm.PRIOR * first) / (counts.sum() + lm.PRIOR)
    got = {r.doc_id: r.score for r in lm.lm_scores(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sum(math.log(sum(math.exp(sum(math.log(weights[k]) for k in p)) for p in paths(lm.SPACE + w))) for w in t.lower().split()) + math.log(weights[-1])
        assert got[i] == pytest.approx(want / math.log(10), abs=1e-4), t


# ---- op 8 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain & <b>bold</b>", "plain & bold"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<head><title>T</title><style>x</style></head><body>seen<script>var a='</p>'</script></body>", "seen"),
    ("<div style='display:none'>no</div><div hidden>no</div><span aria-hidden=true>no</span>yes", "yes"),
    ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>2</table>", "name    n\nx       10\nlonger  2"),
    ("<p>x &lt; y &eacute;</p><!-- gone -->tail", "x < y é\n\ntail"), ("<img alt='a picture'> and < 5", "[a picture] and < 5"), ("<a <b>x</b", "x"), ("</p></div>ok", "ok"),
])
def test_html(page, text):
    assert html.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><td>x</td></table>", "x"), ("<table><tr>x<td>y", "x\n\ny"), ("<table><tr><form><td>x</td></form></tr></table>", "x"), ("<table><div>x</div><tr><td>y</td></tr></table>z", "x\n\ny\n\nz"),
    ("<table><tbody>x", "x"), ("<table><tr><table><tr><td>x</table>", "x"), ("<table><tbody><table><td>x</table>y", "x\n\ny"), ("<table><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><colgroup><col>x<tr><td>y</table>", "x\n\ny"), ("<table><caption>t<tr><td>a<td>b</table>", "t\na  b"), ("<table><tr><td>a</td>x<td>b</td></tr></table>", "x\n\na  b"),
    ("<table><tr><b>x<td>a</table>", "x\n\na"), ("<table><tr><td><table><b>x</b><td>y</table>z</table>", "x\n\ny\n\nz"),
])
def test_html_table_text_outside_cells(page, text):
    assert html.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a  b\n   c  d"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"), ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<ol start=-1><li>a<li value=x>b</ol>", "-1. a\n0. b"),
    ("<details><summary>s</summary>gone</details>x", "s\nx"), ("<details open><summary>s</summary>here</details>", "s\nhere"), ("<details>gone</details>x", "x"),
    ("<select><option>a<option selected>b</select>", "b"), ("<select><optgroup><option>a</optgroup><option>b</select>", "a"), ("<select multiple><option>a<option>b</select>", "a\nb"),
    ("<svg><title>t</title><text>seen</text></svg>", "seen"), ("<math><mi>x</mi><annotation>gone</annotation></math>", "x"),
    ("<table><tr><td>" * 14 + "deep<td>side" + "</table>" * 14, "deep  side"),
])
def test_html_visibility_and_spans(page, text):
    assert html.html_to_text(page) == text


def test_html_emits_visible_text_in_order():
    """Every visible text node of random pages without tables appears, in order."""
    rnd = random.Random(31)
    tags = "div p ul ol li b i span section blockquote h1 pre dl dt dd details summary select option svg math form".split()
    for _ in range(1500):
        page = "".join(f"<{rnd.choice(['', '/'])}{rnd.choice(tags)}{rnd.choice(['', '', ' hidden', ' open'])}>" + (f" w{i} " if rnd.random() < 0.6 else "") for i in range(rnd.randint(1, 25)))
        want, todo = [], [html.parse(page)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                want += x.split()
            elif x.tag == "#root" or html.visible(x):
                todo.extend(reversed(html.shown(x)))
        assert re.findall(r"w\d+", html.html_to_text(page)) == want, page


def test_html_loses_no_word_of_random_tables():
    rnd = random.Random(12)
    tags = "table tbody thead tr td th caption colgroup form div b p ul li span".split()
    for _ in range(2000):
        page, words = "", []
        for i in range(rnd.randint(1, 25)):
            page += f"<{rnd.choice(['', '', '/'])}{rnd.choice(tags)}>"
            if rnd.random() < 0.5:
                words.append(f"w{i}")
                page += f" w{i} "
        assert sorted(re.findall(r"w\d+", html.html_to_text(page))) == sorted(words), page
    assert html.html_to_text("<table><tr><td>" * 300 + "deep") == "deep"


def test_html_keeps_all_visible_words_and_survives_depth(spark):
    assert html.html_to_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.html_to_text("<table><tr><td>" * 60 + "deep") == "deep"
    df = spark.createDataFrame([(1, None), (1, "<p>é"), (None, "x")], "page_id long, html string")
    assert sorted(r.text for r in html.extract_text(df).collect()) == ["", "x", "é"]


# ---- op 9 -------------------------------------------------------------------------------------------------------


def quality_rows(n, seed):
    rnd = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        t = prose(rnd, rnd.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            t = rnd.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "%%% "), lambda t: " ".join([t.split()[0]] * 50), lambda t: t.replace(" ", " | ")])(t)
        texts.append(t.encode())
        y.append(int(not bad))
    return texts, y


def test_quality_held_out_accuracy():
    space = quality.Space(*quality_rows(300, 1))
    texts, y = quality_rows(200, 2)
    got = space.score(texts)
    assert np.mean([(s >= 0.7) == t for s, t in zip(got, y)]) > 0.95
    assert space.score([]) == [] and 0 <= space.score([b""])[0] <= 1
    # exact cosine voting, one document at a time
    for text, score in zip(texts, got):
        q = space._unit(space._weigh(quality.features(text)[None]) @ space.basis)[0]
        sims = space.vectors @ q
        near = np.argsort(-sims, kind="stable")[: space.neighbours]
        w = np.clip(sims[near], 0, 1).astype(np.float64) ** quality.POWER + 1e-9
        assert score == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=1e-3)


def test_quality_ties_go_to_the_first_neighbours():
    sims = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5], [0.7] * 5], np.float32)
    assert [sorted(r) for r in quality.nearest(sims, 2).tolist()] == [[0, 1], [3, 4], [0, 1]]
    rows, y = quality_rows(40, 3)
    same = quality.Space(rows * 3, [1 - v for v in y] + y + y)
    assert same.score(rows[:5]) == same.score(rows[:5])


def test_quality_frame(spark):
    space = quality.Space(*quality_rows(100, 1))
    assert len(quality.classify(frame(spark, ODD), space).collect()) == len(ODD)
    kept = quality.filter_documents(frame(spark, ["lorem ipsum dolor sit amet sed do", "AA!! BB!! CC!! DD!! EE!! FF!!"]), space)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == DOCS.replace(",", "").split()[0::2]
    assert quality.Space([], []).score([b"abc"]) == [0.5]


def test_quality_stage_drops_what_the_classifier_rejects(spark):
    space = quality.Space([], [])  # scores everything by its prior
    for score, kept in ((0.4, 0), (0.5, 0), (0.69, 0), (0.7, 2), (1.0, 2)):
        space.prior = score
        assert quality.filter_documents(frame(spark, ["lorem ipsum", "dolor"]), space).count() == kept, score


# ---- op 10 ------------------------------------------------------------------------------------------------------


def slow_adpcm(block):
    p, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [p]
    for b in block[4:]:
        for nib in (b & 15, b >> 4):
            step = int(media.IMA_STEPS[i])
            d = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                if nib & bit:
                    d += step >> shift
            p = max(-32768, min(32767, p - d if nib & 8 else p + d))
            i = max(0, min(88, i + int(media.IMA_MOVES[nib])))
            out.append(p)
    return out


def test_telephony_decoding():
    rnd = np.random.default_rng(0)
    blocks = rnd.integers(0, 256, (5, 40)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    assert (media.TABLES[media.MULAW][0xFF], media.TABLES[media.MULAW][0x00], media.TABLES[media.MULAW][0x80]) == (0, -32124, 32124)
    assert (media.TABLES[media.ALAW][0xD5], media.TABLES[media.ALAW][0x55], media.TABLES[media.ALAW][0xAA]) == (8, -8, 32256)
    payload = media.pad(bytes(range(256)) * 9)
    for codec in (media.MULAW, media.ALAW, media.ADPCM):
        wave = media.to_wave(payload, codec)
        assert media.payload_of(wave) == payload and media.from_wave(wave)[0] == codec
    pcm = np.array([0, 10, -10], np.int16)
    assert media.resample(pcm).tolist() == [0, 5, 10, 0, -10, -10]
    assert len(media.resample(pcm, 8000, 12000)) == 4


def test_media_columns(spark):
    rows = {r.doc_id: r for r in media.media_columns(frame(spark, ODD), keep_pcm=True).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert rows[i].n_bytes == len(raw) and bytes(rows[i].payload) == want and rows[i].pcm[:4] == b"RIFF"
    assert rows[7].features == rows[8].features and rows[7].media == rows[8].media


# ---- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    texts, y = quality_rows(160, 6)
    texts = [t.decode() for t in texts]
    item = prose(rnd, 40)
    texts += [prose(rnd, 60), item, None, ""]
    texts += [texts[-4], "write to a.b@c.example.com " + prose(rnd, 30)]
    df = frame(spark, texts).drop("extra")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(y[i] == 0 for i in docs if i < 160), "rejected documents stay away"
    assert 161 not in docs and 164 not in docs
    if 165 in docs:
        assert "[EMAIL]" in docs[165].text
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, state, str(tmp_path))
        assert out.columns == df.columns, name
        state = spark.createDataFrame(out.collect(), df.schema)
    assert 165 in {r.doc_id for r in state.collect()} and {160} <= {r.doc_id for r in state.collect()}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    near = " ".join([*a.split()[:-1], "edit"])
    rows = [(5, a), (5, a), (5, a.upper()), (5, near), (6, a), (5, b), (5, b), (3, c), (5, c), (7, d), (8, ""), (8, ""), (8, None), (9, ""), (None, d), (None, d)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates_stage(spark, df, "")
    assert out.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in out.collect())
    group = [k for k in got if k[0] == 5 and k[1] != b.lower()]
    assert len(group) == 1 and got.pop(group[0]) == 1 and group[0][1] in (a.lower(), near.lower())
    assert got == Counter({(5, b.lower()): 1, (3, c.lower()): 1, (7, d.lower()): 1, (8, ""): 1, (9, ""): 1, (None, d.lower()): 2})


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every internal name as a further column of the documents."""
    import corpus_pipeline

    rnd = random.Random(14)
    names = "h copy shard __id shuffle_key n_words items spans n_hit contaminated key window row __row __text __key __node __of __set __label __draw part block size source_key value node label score pos start end".split()
    texts = [prose(rnd, 40) for _ in range(6)]
    df = frame(spark, [*texts, texts[0], None, ""]).drop("extra").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    spark.createDataFrame([(1, "some words that no document has at all in any place whatever it may say")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        rows = out.collect()
        assert out.columns[: len(df.columns)] == df.columns and rows, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        empty = stage(spark, df.limit(0), str(tmp_path))
        assert empty.columns == out.columns and empty.count() == 0, name


def test_sources_fill_up_to_their_caps(spark):
    rnd = random.Random(2)
    for n in (1, 2, 9, 40):
        sizes = {f"s{i:02d}": int(10 ** rnd.uniform(0, 5)) for i in range(n)} | {None: 17}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    zero = mixing.source_targets(spark.createDataFrame([("a", 0)], "source string, size long")).collect()
    assert [r.target for r in zero] == [0]


def test_null_columns_everywhere(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None)] * 3, DOCS)
    assert pii.find_spans(df).count() == 3 and mixing.mix_plan(df).count() == 3 and lm.lm_scores(df).count() == 3
    assert dedup.near_duplicates(df).count() == 3 and media.media_columns(df).count() == 3
