import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import maxent_lm as L
from tracemill.llm.storage import Workspace


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split() + [None]


TONGUES = [["the", "and", "thing", "thorn", "thin"], ["der", "und", "dieser", "dort", "dumm"], ["les", "une", "leur", "loin", "lune"]]


def corpus():
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(rng.choice(TONGUES) if rng.random() < 0.05 else TONGUES[k % 3]) for _ in range(rng.randint(1, 80))), k % 7 == 2) for k in range(150)]
    return rows + [(1000, None, True), (1001, "", True), (1002, "Unseen WORDS é", True), (None, "the and", True), (3, rows[3][1], False), (1003, "the der " * 20_000, True)]


@pytest.mark.parametrize("head", [1 << 16, 2])
def test_base_scores_and_gain(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, held_out boolean, score string").repartition(3)
    found = L.score(docs, docs.where("not held_out"), Workspace(spark, "test"), keep=("held_out",)).collect()
    counts = collections.Counter(w for _, t, h in rows if not h for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in found:
        own = words(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
    held = [r for r in found if r["held_out"] and (r["doc_id"] or 0) < 1000]  # of the kind that train has
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = []
    for parts in (1, 7):
        d = docs.repartition(parts)
        got.append({r["doc_id"]: r["score"] for r in L.score(d, d.where("not held_out"), Workspace(spark, "test")).collect()})
    assert got[0].keys() == got[1].keys()
    assert all(abs(got[0][k] - got[1][k]) <= 1e-6 * abs(got[0][k]) for k in got[0])


def plain_score(model, counts, shared, text):
    """The model's log10 probability of a text, token by token."""
    t = L.tokens(pa.array([text]))
    total = 0.0
    for p, w in zip(t.places.tolist(), words(text), strict=True):
        at = np.array([p])
        cls, leaf = model.outcomes(t, at)
        for weights, rows, outcome in zip((model.by_class, model.by_leaf), model.features(t, at, cls), (cls[0], leaf[0]), strict=True):
            x = sum(weights[r[0]].astype(float) for r in rows)
            total += (x[outcome] - math.log(sum(math.exp(v) for v in x))) / math.log(10)
        if leaf[0] == L.LEAVES - 1:
            total += math.log10((counts[w] + 1) / shared[cls[0]])
    return total


def test_scores_against_a_plain_version_and_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAVES", 3)
    kept = []
    real = L.trained
    monkeypatch.setattr(L, "trained", lambda text, model: kept.append(real(text, model)) or kept[-1])
    alike = " ".join(f"thi{c * k}ng" for k, c in enumerate("abcdefg", 1) for _ in range(k))  # of one shape, so of one class
    rows = [*corpus()[:40], (2000, alike, False), (2001, alike + " thing", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r["score"] for r in L.score(docs, docs.where("not held_out"), Workspace(spark, "test")).collect()}
    (model,) = kept
    counts = collections.Counter(w for _, t, h in rows if not h for w in words(t))
    one = L.tokens(pa.array([" ".join(w for w in counts if w)]))
    cls, leaf = model.outcomes(one, one.places)
    names = words(" ".join(w for w in counts if w))
    shared = np.ones(L.CLASSES)
    for w, c, f in zip(names, cls, leaf, strict=True):
        if f == L.LEAVES - 1:
            shared[c] += counts[w] + 1
    assert (leaf < L.LEAVES - 1).any() and (leaf == L.LEAVES - 1).sum() > 1
    for i, t, _ in rows:
        want = plain_score(model, counts, shared, t)
        assert abs(found[i] - want) < 1e-4 * abs(want)
    # every known word and the unseen share, behind one history
    t = L.tokens(pa.array(["the thing"]))
    p = t.places[-1:]
    first = L.softmax(model.by_class, model.features(t, p, np.array([0]))[0])[:, 0]
    whole = 0.0
    for c in range(L.CLASSES):
        leaves = L.softmax(model.by_leaf, model.features(t, p, np.array([c]))[1])[:, 0]
        own = [(counts[w] + 1) / shared[c] for w, k, f in zip(names, cls, leaf, strict=True) if k == c and f == L.LEAVES - 1]
        taken = sum(leaves[f] for k, f in zip(cls, leaf, strict=True) if k == c and f < L.LEAVES - 1)
        spare = sum(leaves[f] for f in range(L.LEAVES - 1) if f not in {x for k, x in zip(cls, leaf, strict=True) if k == c})  # leaves without a word
        whole += first[c] * (taken + spare + leaves[-1] * (sum(own) + 1 / shared[c]))
    assert abs(whole - 1) < 1e-5


def test_class_probabilities_sum_to_one():
    t = L.tokens(pa.array(["a b c", None, "x"]))
    assert np.diff(t.at).tolist() == [4, 1, 2]
    w = np.random.RandomState(0).randn(3 * 64 + 1, L.CLASSES).astype(np.float32)
    rows = [np.arange(len(t.places)) + 64 * k for k in range(3)]
    assert np.allclose(L.softmax(w, rows).sum(axis=0), 1, atol=1e-5)


def test_without_training_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = L.score(docs, docs.limit(0), Workspace(spark, "test")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert L.score(docs.limit(0), docs, Workspace(spark, "test")).count() == 0


def test_scores_do_not_depend_on_head(spark, monkeypatch):
    # of two classes, one's words are all less frequent than the other's
    rows = [*corpus()[:60], (3000, "zebrax zebrox zebrux zebrex zebrax", False), (3001, "zebrax the zebrix", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = []
    for head in (1 << 16, 2):
        monkeypatch.setattr(L, "HEAD", head)
        got.append({r["doc_id"]: r["score"] for r in L.score(docs, docs.where("not held_out"), Workspace(spark, "test")).collect()})
    assert got[0].keys() == got[1].keys()
    assert all(abs(got[0][k] - got[1][k]) <= 1e-6 * abs(got[0][k]) for k in got[0])


def pairs(of, rng, each=40):
    """Texts of a word of its own before each of 600 words of one shape, every third of which share it."""
    all_pairs = [f"cue{k // 3:03}x thi{k:03}ng" for k in range(600) for _ in range(each)]
    rng.shuffle(all_pairs)
    return [(of + k, " ".join(all_pairs[k : k + 100]), False) for k in range(0, len(all_pairs), 100)]


def test_words_without_leaves_of_their_own_follow_their_history(spark):
    rng = random.Random(4)
    rows = pairs(0, rng)
    order = rng.sample(range(600), 200)
    right = " ".join(f"cue{k // 3:03}x thi{k:03}ng" for k in order)
    wrong = " ".join(f"cue{k // 3:03}x thi{w:03}ng" for k, w in zip(order, order[1:] + order[:1], strict=True))
    docs = spark.createDataFrame([*rows, (100_000, right, True), (100_001, wrong, True)], "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r for r in L.score(docs, docs.where("not held_out"), Workspace(spark, "test")).where("doc_id >= 100000").collect()}
    assert abs(found[100_000]["base_score"] - found[100_001]["base_score"]) < 1e-6  # the same words
    assert found[100_000]["score"] > found[100_001]["score"] + 0.15 * 200


@pytest.mark.parametrize("head", [1 << 16, 2])
def test_bins_against_a_plain_version_and_sum_to_one(spark, monkeypatch, head):
    monkeypatch.setattr(L, "WORDS_A_BIN", 1)
    monkeypatch.setattr(L, "HEAD", head)
    kept = []
    real = L.trained
    monkeypatch.setattr(L, "trained", lambda text, model: kept.append(real(text, model)) or kept[-1])
    train = [(i, t, False) for i, t, _ in pairs(0, random.Random(5), 4)]
    held = [(9000, "cue000x thi000ng thi111ng unseen thi999ng cue001x", True), (9001, None, True)]
    docs = spark.createDataFrame([*train, *held], "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r["score"] for r in L.score(docs, docs.where("not held_out"), Workspace(spark, "test")).collect()}
    (model,) = kept
    levels = len(model.bins)
    assert levels == 2 and np.abs(model.by_digit).max() > 0
    counts = collections.Counter(w for _, t, _ in train for w in words(t))
    names = [w for w in counts if w]
    one = L.tokens(pa.array([" ".join(names)]))
    cls, leaf = model.outcomes(one, one.places)
    inside = {w: c for w, c, f in zip(names, cls, leaf, strict=False) if f == L.LEAVES - 1}
    shared = np.ones(L.CLASSES)
    shared[L.CLASSES - 1] += counts[None] + 1
    nodes = collections.Counter()  # tokens and words of all nodes, by class and digits
    digits = {w: f"{L.textkit.hash_word(w):016x}"[:levels] for w in inside}
    for w, c in inside.items():
        shared[c] += counts[w] + 1
        for k in range(levels + 1):
            nodes[c, digits[w][:k]] += counts[w] + 1

    def gain(t, p, w):
        c, total = inside[w], 0.0
        for level, (_, digit, rows) in enumerate(model.paths(t, np.array([p]), np.array([c]))):
            assert digit[0] == int(digits[w][level], 16)
            x = sum(model.by_digit[r[0]].astype(float) for r in rows)
            over = digits[w][:level]
            total += x[digit[0]] - math.log(sum(nodes[c, over + f"{d:x}"] / nodes[c, over] * math.exp(x[d]) for d in range(16)))
        return total / math.log(10)

    for i, t, _ in [*train[:20], *held]:
        read = L.tokens(pa.array([t]))
        want = plain_score(model, counts, shared, t) + sum(gain(read, p, w) for p, w in zip(read.places.tolist(), words(t), strict=True) if w in inside)
        assert abs(found[i] - want) < 1e-5 * abs(want)
    # the known words of a class's shared leaf and the unseen share, behind one history
    c = max(set(inside.values()), key=lambda c: sum(v == c for v in inside.values()))
    whole = 1 / shared[c]
    for w in (w for w in inside if inside[w] == c):
        t = L.tokens(pa.array([f"cue007x {w}"]))
        whole += (counts[w] + 1) / shared[c] * 10 ** gain(t, t.places[1], w)
    assert abs(whole - 1) < 1e-5
