import random

import pytest

from tracemill.llm import near_dup
from tracemill.llm.graph import components
from tracemill.llm.storage import Workspace


def plain(rows, percent=85):
    """Brute force over all pairs: id -> (set size, smallest id reachable)."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, group = sorted(sets), {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], 0
    for copies, size, edits in ((60, 160, 4), (25, 80, 1), (12, 300, 8), (30, 40, 0), (4, 7, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(size)] = word()
            rows.append((n := n + 1, " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    rows += [(n := n + 1, " ".join(word() for _ in range(rng.randint(1, 90)))) for _ in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_against_all_pairs(spark, seed, percent):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE  two"), (905, "long " * 30_000 + "tail")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    found = near_dup.near_duplicates(docs, Workspace(spark, "test"), percent=percent).collect()
    want = plain(rows, percent)
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "alone here"), (7, "other words entirely now")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, Workspace(spark, "test")).collect()), key=str)
    assert found == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (7, 7, True)], key=str)
    assert near_dup.near_duplicates(docs.limit(0), Workspace(spark, "test")).count() == 0


def test_null_ids_and_one_id_with_two_texts_link(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(3, " ".join(base)), (None, " ".join([*base[:-1], "end"])), (None, " ".join(["go", *base[1:]])), (9, " ".join([*base[:-2], "x", "y"])), (9, " ".join(other))]
    rows += [(None, " ".join([*other[:-1], "end"])), (None, "lone one two three four"), (None, "lone one  two three four"), (0, "lone of zero")]
    rows += [(None, " ".join(["z"] * 40 + other[:150])), (None, " ".join(["z"] * 40 + other[:150] + ["q"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dup.near_duplicates(docs, Workspace(spark, "test")).join(docs.withColumn("mark", near_dup.mark(docs["doc_id"], docs["text"])).select("mark", "text"), "mark").collect()
    by = {r["text"]: (r["component_id"], r["kept"]) for r in found}
    assert [by[t] for _, t in rows[:7]] == [(3, True), (3, False), (3, False), (3, False), (9, True), (9, False), by[rows[6][1]]]
    for group in (rows[6:8], rows[9:11]):  # null ids alone: one text of each stays
        assert all(by[t][0] is None for _, t in group) and sum(by[t][1] for _, t in group) == 1
    assert by["lone of zero"] == (0, True)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(links, Workspace(spark, "test"), "c").collect()}
    assert all(found[k] == 0 for k in range(61)) and found[101] == found[100] == 100
