import hashlib
import random
import re

from pyspark.sql import functions as F

from tracemill.llm import fingerprints as W
from tracemill.llm import licences, mixing
from tracemill.llm.storage import Workspace


def rolled(h, gram):
    """Hashes of all runs, each from the one before."""
    turn = lambda x, k: ((x << k % 64) | (x >> (64 - k % 64))) & (1 << 64) - 1 if k % 64 else x
    h = [x & (1 << 64) - 1 for x in h]
    first = 0
    for k in range(gram):
        first = turn(first, 1) ^ (h[k] if k < len(h) else 0)
    out = [first] if h else []
    for k in range(gram, len(h)):
        out.append(turn(out[-1], 1) ^ turn(h[k - gram], gram) ^ h[k])
    return out


def test_winnowing_against_windows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 6, 7, 30, 200)] + ["日本語 text"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", W.winnowed(F.col("t")).alias("p"), W.words(F.col("t")).alias("w"), F.transform(W.words(F.col("t")), lambda w: F.xxhash64(w)).alias("h")).collect()
    for r in rows:
        own = rolled(r["h"], W.GRAM)
        want = {}
        for a in range(max(1, len(own) - W.WINDOW + 1)) if own else ():
            _, i = min((own[i] >> 33, -i) for i in range(a, min(a + W.WINDOW, len(own))))
            want[-i] = own[-i]
        assert [(p["hash"] & (1 << 64) - 1, p["place"]) for p in r["p"]] == [(h, i) for i, h in sorted(want.items())]
    assert rows[-1]["w"] == ["日", "本", "語", "text"]


def marks(fingerprint):
    return {fingerprint[k : k + 16] for k in range(0, len(fingerprint), 16)}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 4)
    rng = random.Random(5)
    rows = [(3 * k, "".join(rng.choice("é bcd") for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(None, "null id"), (1000, None), (1001, "w " * 20_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    found = {r["doc_id"]: r for r in W.edits(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert found[i]["n_chars"] == len(t) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (marks(x) for x in (found[i]["fingerprint"], found[i]["edited_fingerprint"], found[order[(k + 1) % len(order)][0]]["fingerprint"]))
        assert found[i]["near_edited"] == like(own, other) and found[i]["near_next"] == like(own, following)
        assert len(found[i]["places"]) * 16 == len(found[i]["fingerprint"]) and len(found[i]["edited_places"]) * 16 == len(found[i]["edited_fingerprint"])
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert W.edits(one).first()["near_next"] == 1.0
    assert W.edits(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x y z a b c"), (1, "x y z a b c"), (2, "x y z a b c")], "doc_id long, text string")
    assert len({r["fingerprint"] for r in W.edits(twice).collect()}) == 1 and W.edits(twice).count() == 3


def plain_scan(text, known):
    """All passages of all templates, one by one."""
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    best = []
    for t in known:
        own = set(t.bigrams)
        at = [i for i, g in enumerate(grams) if g in own]
        runs = []
        for i in at:
            if runs and i - runs[-1][-1] <= t.gap:
                runs[-1].append(i)
            else:
                runs.append([i])
        solid = [r for r in runs if len(r) >= t.run]
        found = []
        for n, x in enumerate(solid):
            for y in solid[n:]:
                lo, hi = x[0], y[-1]
                passage = set(grams[lo : hi + 1])
                if hi - lo + 1 <= t.longest and 2 * len(passage & own) / (len(passage) + len(own)) >= t.threshold:
                    found.append((2 * len(passage & own) / (len(passage) + len(own)), -lo, t.licence, hi - lo + 1))
        best += [max(found)] if found else []
    return ",".join(sorted({b[2] for b in best})), max(best, default=None)


def test_licences(spark):
    known = licences.templates()
    whole = {t.licence: t.text for t in known}  # the full texts come last
    prose = "of the people and to the sea in the end we went on with the work of all the others " * 9
    comment = lambda t: "\n".join(f" * {x}" for x in t.split("\n"))
    texts = [
        None, "", "word", "Intro.\nReleased under the MIT License.\nMore.", "licensed*** under%%% cc&&& BY-NC### 4.0!!", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "x " * 30_000 + "\nLicensed under CC BY 4.0.", "Released under the MIT License.",
        prose + comment(whole["MIT"]) + prose, "int x;\n/*\n" + comment(whole["ISC"]) + "\n*/", prose + whole["BSD-3-Clause"].replace("COPYRIGHT HOLDER", "ACME CORPORATION LIMITED OF NOWHERE"),
        "see Released under\n  the MIT\n License here", whole["GPL-2.0-only"], prose + whole["Apache-2.0"] + prose, whole["MIT"][:300], prose * 3,
    ]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(None, texts[3], "z"), (3, texts[3], "z")], "doc_id long, text string, dice string")
    df = df.selectExpr("*", "'mine' AS _found", "'mine' AS _licence_grams", "'mine' AS _licence_hits")
    found = licences.scan(df).collect()
    for r in found:
        names, best = plain_scan(r["text"], known)
        assert r["licences"] == names and r["_found"] == r["_licence_hits"] == "mine"
        assert (r["dice"], r["licence_place"], r["licence"], r["licence_bigrams"]) == ((best[0], -best[1], best[2], best[3]) if best else (None,) * 4)
    by = {r["doc_id"]: r["licence"] for r in found if r["doc_id"] is not None}
    assert [by[k] for k in (9, 10, 11, 12, 13, 14, 15, 16)] == ["MIT", "ISC", "BSD-3-Clause", "MIT", "GPL-2.0-only", "Apache-2.0", None, None]
    assert licences.scan(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(1, 40), "big" if rng.random() < 0.6 else f"s{rng.randrange(4)}", rng.choice(["en", "de", None]), "c") for k in range(3000)]
    rows += [(None, None, None, None, "c"), (1, rows[1][1], rows[1][2], rows[1][3], "c"), (9000, "", "only", "xx", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate string")
    out = mixing.sample(docs, Workspace(spark, "test"), share=0.4)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["rate"] <= 1 for r in got)
    total = sum(r["tokens"] for r in got)
    share = lambda rs, key, w: {k: sum(w(r) for r in rs if r[key] == k) for k in {r[key] for r in rs}}
    natural, expected = share(got, "source", lambda r: r["tokens"]), share(got, "source", lambda r: r["tokens"] * r["rate"])
    power = {k: v**0.7 for k, v in natural.items()}
    for k, v in expected.items():
        want = 0.4 * total * power[k] / sum(power.values())
        assert abs(v - min(want, natural[k])) <= 0.05 * total * 0.4
    sampled = sum(r["tokens"] for r in got if r["sampled"])
    assert abs(sampled - sum(expected.values())) < 0.1 * total
    assert mixing.sample(docs.limit(0), Workspace(spark, "test")).count() == 0
    prefixed = mixing.sample(docs, Workspace(spark, "test"), prefix="_m_")
    assert prefixed.columns == [*docs.columns, "_m_topic", "_m_tokens", "_m_rate", "_m_sampled"]
    clash = docs.selectExpr("*", *[f"'mine' AS {c}" for c in ("_lang", "_source", "_topic", "_tokens", "_s", "_l", "_t", "_rate", "_mixing", "_mixing_source")])
    assert {(r["_lang"], r["_s"], r["_mixing"]) for r in mixing.sample(clash, Workspace(spark, "test")).collect()} == {("mine",) * 3}


def test_mixing_meets_given_targets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(10, 40), rng.choice("ab"), rng.choice(["en", "de"])) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    target = lambda **shares: spark.createDataFrame(list(shares.items()), "value string, share double")
    wanted = {"source": target(a=0.7, b=0.3), "lang": target(en=0.4, de=0.6), "topic": target(prose=1.0)}
    want = {"a": 0.7, "b": 0.3, "en": 0.4, "de": 0.6}
    for small, row in ((100_000, 2000), (100_000, 1), (1, 1)):  # in one row, in one task, and by shuffles
        monkeypatch.setattr(mixing, "SMALL_CELLS", small)
        monkeypatch.setattr(mixing, "ROW_CELLS", row)
        got = mixing.sample(docs, Workspace(spark, "test"), share=0.3, targets=wanted).collect()
        total = sum(r["tokens"] for r in got)
        for k, v in want.items():
            assert abs(sum(r["tokens"] * r["rate"] for r in got if k in (r["source"], r["lang"])) / total / 0.3 - v) < 1e-6
    cells = docs.groupBy("source", "lang", F.lit("prose").alias("topic")).agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens"))
    missed = mixing.misses(mixing.fit(cells, wanted, 0.3, Workspace(spark, "test"))).collect()
    assert len(missed) == 5 and all(abs(r["want"] - r["expected"]) < 1e-3 for r in missed)
    assert all(r["rate"] == 0 for r in mixing.sample(docs, Workspace(spark, "test"), targets={"lang": target(en=1.0)}).collect() if r["lang"] == "de")
