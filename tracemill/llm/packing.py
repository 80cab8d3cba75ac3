"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; what remains of each document goes, longest first, into the open
window with the least room that still takes it.  The tightest window is found in a segment tree indexed by remaining
capacity.  Each input partition packs its own documents, at most BLOCK_DOCS at a time, so there is no shuffle, memory is
bounded, and only the last windows of a block carry padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracemill.llm import textkit

#: Documents whose remainders are packed together, about: a partition with more is packed in several turns, each leaving its
#: own last windows part empty, which is some windows in a hundred thousand.
BLOCK_DOCS = 1 << 18
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_tokens long"
)


class CapacityTree:
    """Which remaining capacities have an open window: a segment tree whose node tells whether any leaf below it does."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least `need`."""
        node, flags = need + self.size, self.any
        if not flags[node]:
            while node > 1 and (node & 1 or not flags[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if flags[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            flags[node] = 0
            node >>= 1
            while node and not (flags[2 * node] or flags[2 * node + 1]):
                flags[node] = 0
                node >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each item, and the fill of each window; items are placed longest first, ties in order."""
    tree, fill = CapacityTree(capacity), []
    window_of, offset_of = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[k]
        found = tree.take(need)
        if found is None:
            found = capacity, len(fill)
            fill.append(0)
        room, window = found
        window_of[k], offset_of[k] = window, fill[window]
        fill[window] += need
        if room > need:
            tree.add(room - need, window)
    return window_of, offset_of, fill


def padded(tokens: int, window: int) -> int:
    """Stored length of a sequence: the window, unless the sequence holds a power of two of tokens."""
    return tokens if tokens & (tokens - 1) == 0 else window


class PieceTable:
    """Token ids by the 64-bit hash of a piece: open addressing in numpy, so a whole batch is looked up at once."""

    BITS = 20

    def __init__(self):
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.size = 0
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        entry = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            there = self.keys[slot]
            same = there == hashes[todo]
            entry[todo[same]] = self.at[slot[same]]
            more = ~same & (there != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.BITS) - 1)
        return entry

    def add(self, hashes: np.ndarray, coded: list[list[int]]) -> None:
        """Distinct new hashes with the ids of their pieces; beyond half of the slots, the table starts anew."""
        counts = np.array([len(x) for x in coded], np.int64)
        starts = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.ids = np.concatenate([self.ids, np.array([i for x in coded for i in x], np.uint32)])
        entry = len(self.counts) + np.arange(len(hashes))
        self.counts, self.starts = np.concatenate([self.counts, counts]), np.concatenate([self.starts, starts])
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(slot):
            free = self.keys[slot] == 0
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.at[slot[put]] = hashes[put], entry[put]
            hashes, entry, slot = hashes[~put], entry[~put], (slot[~put] + ~free[~put]) & ((1 << self.BITS) - 1)
        self.size = len(self.counts)


class TextCoder:
    """Ids of texts, equal to the tokenizer's own.

    The tokenizer lower-cases, cuts a text into runs of letters, single digits and runs of other characters, and codes
    each piece by itself.  Texts of ASCII and Latin-1 letters without apostrophes are cut here, a batch at a time, and
    each distinct piece goes through the tokenizer's model about once per worker.  Other texts go through the tokenizer.
    """

    #: Fixed: classes of bytes in such texts; 0 white space, 1 letter, 2 digit, 3 other.
    CLASS = np.full(256, 3, np.uint8)
    CLASS[textkit.SPACE] = 0
    CLASS[0x30:0x3A] = 2
    CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = CLASS[0x80:] = 1

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next character from 256 on
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        other = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in own else chr(next(other)) for b in range(256)}
        self.table = PieceTable()

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def code(self, piece: bytes) -> list[int]:
        return [x.id for x in self.tokenizer.model.tokenize("".join(map(self.alphabet.__getitem__, piece)))]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text of a batch, in order."""
        for i, j, a, b in textkit.blocks(buf, off, limit=textkit.BLOCK_BYTES):
            if j == i + 1 and b < off[j] or a > off[i]:  # part of one very long text
                if a == off[i]:
                    parts = []
                parts.append(next(self.piecewise(buf[a:b], np.array([0, b - a]))))
                if b == off[j]:
                    yield np.concatenate(parts)
            else:
                yield from self.piecewise(buf[a:b], off[i : j + 1] - a)

    def piecewise(self, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        n = len(off) - 1
        # plain: besides ASCII only two-byte letters U+00C0 to U+00FF; neither apostrophes nor special tokens
        lead = buf == 0xC3
        tail = np.zeros(len(buf), bool)
        tail[1:] = lead[:-1]
        odd = ((buf >= 0x80) & ~lead & ~tail) | (tail & ((buf == 0x97) | (buf == 0xB7))) | (buf == 0x27) | ((buf < 0x20) & ~textkit.SPACE[buf]) | (buf == 0x7F)
        plain = np.ones(n, bool)
        plain[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = False
        data = buf.tobytes()
        for k in np.flatnonzero(plain) if any(x in data for x in self.special) else ():
            plain[k] = not any(x in data[off[k] : off[k + 1]] for x in self.special)
        small = textkit.LOWER[buf]
        small[tail & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 0x20
        kind = self.CLASS[buf]
        edge = np.ones(len(buf), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[off[:-1][off[:-1] < len(buf)]] = True
        edges = np.append(np.flatnonzero(edge), len(buf))
        keep = kind[edges[:-1]] != 0
        starts, ends = edges[:-1][keep], edges[1:][keep]
        entry = np.zeros(0, np.int64)
        if len(starts):
            hashes = textkit.span_hashes(small, starts, ends)
            entry = self.table.find(hashes)
            if (entry < 0).any():
                if self.table.size > 1 << (PieceTable.BITS - 1):
                    self.table = PieceTable()
                    entry[:] = -1
                new, where = np.unique(hashes[entry < 0], return_index=True)
                where = np.flatnonzero(entry < 0)[where]
                text = small.tobytes()
                self.table.add(new, [self.code(text[x:y]) for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                entry = self.table.find(hashes)
        counts = self.table.counts[entry]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.table.ids[np.repeat(self.table.starts[entry] - total[:-1], counts) + np.arange(total[-1])]
        at = total[np.searchsorted(starts, off)]
        for k in range(n):
            yield ids[at[k] : at[k + 1]] if plain[k] else self.whole(data[off[k] : off[k + 1]])


_coders: dict[str, TextCoder] = {}


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens (with the end id),
    sequence_id, offset, sequence_tokens, padded_tokens.

    Null or empty text: the end id alone.  A null id stays null; repeated rows are packed as often as they occur; equal
    lengths keep their order; sequences and their ids follow the partitions of docs; an empty table gives no rows; further columns are ignored.  Texts of any length are
    tokenised whole.
    """
    end = np.array([end_id], np.uint32)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _coders.get(tokenizer_path)
        if coder is None:
            coder = _coders[tokenizer_path] = TextCoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def packed():
            nonlocal sequence
            window_of, offset_of, fill = best_fit_decreasing([r[2] for r in rest], window)
            rows = [(*r, sequence + w, o, fill[w], padded(fill[w], window)) for r, w, o in zip(rest, window_of, offset_of, strict=True)]
            sequence += len(fill)
            rest.clear()
            return table(rows)

        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), coder.encode(*textkit.flat_utf8(batch.column(1))), strict=True):
                ids = np.append(own, end).astype("<u4").tobytes()
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    rows.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), total, sequence, 0, window, padded(window, window)))
                    sequence += 1
                if total > whole:
                    rest.append((doc_id, whole, total - whole, zlib.crc32(ids[4 * whole :]), total))
            if rows:
                yield table(rows)
            if len(rest) >= block_docs:
                yield packed()
        if rest:
            yield packed()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(textkit.releasing(run), SCHEMA)


def table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=names)
