import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tracemill.llm import packing, textkit

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_hashes(monkeypatch):
    texts = ["The the THE éa\tx\x0by", None, "", " \n ", "a" * 50 + " b", "x " * 40]
    for limit in (1 << 20, 7):
        monkeypatch.setattr(textkit.blocks, "__defaults__", (limit,))
        words, at = textkit.word_hashes(*textkit.flat_utf8(pa.array(texts)))
        for k, t in enumerate(texts):
            own = "".join(c.lower() if c.isascii() else c for c in t or "").split()
            assert words[at[k] : at[k + 1]].tolist() == [textkit.hash_word(w) for w in own]


def test_shingles():
    w = np.arange(1, 9, dtype=np.uint64)
    assert len(textkit.shingles(w, 5)) == 4 and len(textkit.shingles(w[:3], 5)) == 1 and len(textkit.shingles(w[:0], 5)) == 0
    assert len(textkit.shingles(np.repeat(w[:1], 20), 5)) == 1


def test_best_fit_matches_a_plain_search():
    rng = random.Random(4)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    window_of, offset_of, fill = packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []
    for k in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[k]
        else:
            rooms.append(64 - lengths[k])
    assert sorted(64 - f for f in fill) == sorted(rooms)
    used = {}
    for k in range(500):
        used.setdefault(window_of[k], []).append((offset_of[k], lengths[k]))
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0


def test_pack(spark):
    rng = random.Random(1)
    words = ["the", "and", "don't", "Éa", "12", "x<|endoftext|>y", "中文", "straße", "a,b."]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 700, 3000, 5)] + [None, "  ", "same", "same"]
    rows = [(k if k != 5 else None, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    found = packing.pack(df, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, _ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == own[0]["sequence_tokens"] <= 2048
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_very_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(textkit, "BLOCK_BYTES", 8)
    texts = ["short", "The quick BROWN fox, don't jump " * 30, "", "é" * 100 + " tail 42", None, "<|endoftext|> " * 20]
    coder, plain = packing.TextCoder(PATH), Tokenizer.from_file(PATH)
    got = [x.tolist() for x in coder.encode(*textkit.flat_utf8(pa.array(texts)))]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_blocks_of_a_partition_and_padding(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "naïve", "x1"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {}
    for block in (1 << 18, 40):
        found = packing.pack(docs, PATH, window=64, block_docs=block).collect()
        whole[block] = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found)
        used = {}
        for r in found:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"], r["padded_tokens"]))
        for pieces in used.values():
            at = 0
            for offset, length, _, _ in sorted(pieces):
                assert offset == at
                at += length
            assert all(p[2] == at <= 64 and p[3] == (at if at & (at - 1) == 0 else 64) for p in pieces)
        assert sum(p[0][3] for p in used.values()) < (1.1 if block > 300 else 1.4) * sum(r["length"] for r in found)
    assert whole[1 << 18] == whole[40]  # pieces are cut before they are packed
    assert [packing.padded(n, 2048) for n in (1, 2, 3, 1024, 1025, 2048)] == [1, 2, 2048, 1024, 2048, 2048]
