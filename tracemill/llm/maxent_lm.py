"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf).  A word's class follows from its shape
(its first three bytes and last two), shapes being clustered by what precedes them.  A class has LEAVES leaves: its most
frequent words have one each, all its other words share the last.  P(class | history) and P(leaf | class, history) are
softmaxes over hashed features of the history: the word before, the shapes of the two words before together and, for the
class, two skip features.  Within the shared leaf a word has the share (count + 1) / (tokens + words + 1) of the leaf, one
share being left for all words never seen.  A large vocabulary's shared leaves are trees of bins by the digits of the words'
hashes: at every node the history, by the same hashed features, moves the shares of its children, and so those of every word
below.  Over the known words and that last share, the probabilities sum to 1.

Counts cover all training documents and stay distributed.  Training is synchronous: each round sums, over every token of
every partition, what the weights expect of each feature, and moves the weights once by the difference to what was
observed, scaled by row; so weights don't depend on how rows are dealt to partitions.  Scoring works through sparse numpy
batches.  What workers are sent is bounded: the weights, a class per shape, the shares of the bins, and the counts of the
HEAD most frequent words and of those with leaves.  The counts of all other words meet the documents in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType
from pyspark.sql.window import Window

from tracemill.llm import textkit
from tracemill.llm.storage import Workspace

SHAPES = 4096
CONTEXTS = 64
#: Word classes; the last is that of the end alone.
CLASSES = 16
#: Leaves of a class; the last is that of all words without one of their own.
LEAVES = 16
#: Kinds of hashed features of the class and of the leaf.
CLASS_KINDS = 4
LEAF_KINDS = 2
#: Children of a node of a shared leaf's tree, and bits of a word's hash that tell them.
DIGITS = 16
DIGIT_BITS = 4
#: Most levels of the tree, between none and which they follow the vocabulary (a bin to WORDS_A_BIN words).
MOST_LEVELS = 4
WORDS_A_BIN = 16
#: Bounds of the hashed features a kind, between which they follow the vocabulary (a row to WORDS_A_ROW words).
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 14
WORDS_A_ROW = 32
#: Most frequent words whose counts every worker holds.
HEAD = 1 << 16
ROUNDS = 2
#: Share of the observed log ratios that the first weights take, and step of the rounds.
START = 0.5
RATE = 0.5
#: Occurrences of every outcome that a row's statistics are smoothed by, in the outcome's overall share.
PRIOR = 20.0

_END = np.uint64(textkit.hash_word("\x00end"))
_BOS = np.uint64(textkit.hash_word("\x00begin"))
_ONES = np.ones(DIGITS, np.float32)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_HALF = 200  # texts in one numpy batch
_STEP = 1 << 16  # tokens whose outcomes are held at a time
_TREE_STEP = 1 << 14  # of those in trees


@dataclass
class Tokens:
    """Tokens of a batch of texts, each with its end; history places are in front of each text."""

    words: np.ndarray  # with three begins in front of each text and its end behind
    shapes: np.ndarray  # SHAPES for a begin or an end
    places: np.ndarray  # of tokens
    at: np.ndarray  # offsets of the texts in places


def tokens(texts: pa.Array) -> Tokens:
    words, shapes, at = textkit.shaped_words(*textkit.flat_utf8(texts), SHAPES)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    size = at[-1] + 4 * n
    all_words, all_shapes = np.full(size, _BOS, np.uint64), np.full(size, SHAPES, np.int32)
    put = np.arange(at[-1]) + 4 * doc + 3
    all_words[put], all_shapes[put] = words, shapes
    all_words[at[1:] + 4 * np.arange(n) + 3] = _END
    begins = at[:-1] + 4 * np.arange(n)
    token = np.ones(size, bool)
    for k in range(3):
        token[begins + k] = False
    return Tokens(all_words, all_shapes, np.flatnonzero(token), at + np.arange(n + 1))


def rows_for(vocabulary: int) -> int:
    rows = LEAST_ROWS
    while rows < MOST_ROWS and rows * WORDS_A_ROW < vocabulary:
        rows *= 2
    return rows


def levels_for(vocabulary: int) -> int:
    levels = 0
    while levels < MOST_LEVELS and CLASSES * DIGITS**levels * WORDS_A_BIN < vocabulary:
        levels += 1
    return levels


def _codes(words: np.ndarray, levels: int) -> np.ndarray:
    """The words' first digits, as one number."""
    return (words >> np.uint64(64 - DIGIT_BITS * levels)).astype(np.int64) if levels else np.zeros(len(words), np.int64)


def _keys(t: Tokens, p: np.ndarray) -> tuple[np.ndarray, ...]:
    one, two, three = t.words[p - 1], t.words[p - 2], t.words[p - 3]
    near, far = t.shapes[p - 1].astype(np.uint64), t.shapes[p - 2].astype(np.uint64)
    return one, near * np.uint64(SHAPES + 1) + far, two, three


def softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities (outcome, place) of the sum of the places' rows."""
    x = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        x += weights.take(r, axis=0)
    x = np.ascontiguousarray(x.T)
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


@dataclass
class Model:
    class_of: np.ndarray  # of each shape, and of ends
    slots: np.ndarray  # number of the frequent word that may be at a slot, or -1
    slot_shift: int
    frequent: np.ndarray  # words with a leaf of their own
    leaf_of: np.ndarray  # their leaves
    rows: int
    by_class: np.ndarray  # weights of the class; the last row is every history's
    by_leaf: np.ndarray  # weights of the leaf; the last CLASSES rows are those of every history, by class
    frequent_class: np.ndarray
    frequent_count: np.ndarray
    bins: list[np.ndarray]  # by level of the tree: the shares of each node's children in it
    by_digit: np.ndarray  # weights of the children

    def shared(self, tokens_in: np.ndarray, words_in: np.ndarray) -> np.ndarray:
        """By class: tokens and words of the shared leaf, and the share of the unseen."""
        return tokens_in - np.bincount(self.frequent_class, weights=self.frequent_count, minlength=CLASSES) + words_in - np.bincount(self.frequent_class, minlength=CLASSES) + 1

    def outcomes(self, t: Tokens, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of the words at the places."""
        words = t.words[p]
        at = self.slots[((words >> np.uint64(self.slot_shift)) & np.uint64(len(self.slots) - 1)).astype(np.int64)]
        own = (at >= 0) & (self.frequent[at] == words)
        return self.class_of[t.shapes[p]], np.where(own, self.leaf_of[at], self.by_leaf.shape[1] - 1)

    def features(self, t: Tokens, p: np.ndarray, cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of by_class and of by_leaf that the history of each place has, every history's last."""
        keys, within = _keys(t, p), cls.astype(np.uint64) + np.uint64(1)
        mask = np.uint64(self.rows - 1)
        first = [(textkit.mix64(k + np.uint64(i)) & mask).astype(np.int64) + i * self.rows for i, k in enumerate(keys)]
        second = [(textkit.mix64(textkit.mix64(k + np.uint64(i)) + within) & mask).astype(np.int64) + i * self.rows for i, k in enumerate(keys[:LEAF_KINDS])]
        return [*first, np.full(len(p), CLASS_KINDS * self.rows)], [*second, LEAF_KINDS * self.rows + cls]

    def paths(self, t: Tokens, p: np.ndarray, cls: np.ndarray):
        """By level of the tree: the node of the word at each place, its digit there, and the rows of by_digit that the
        history has at the node."""
        levels, shift = len(self.bins), np.uint64(65 - self.rows.bit_length())
        codes = _codes(t.words[p], levels)
        keys = [textkit.mix64(k + np.uint64(i)) for i, k in enumerate(_keys(t, p)[:LEAF_KINDS])]
        for level in range(levels):
            to = codes >> (DIGIT_BITS * (levels - level - 1))
            node = (cls << (DIGIT_BITS * level)) + (to >> DIGIT_BITS)
            within = (node.astype(np.uint64) + (np.uint64(level + 1) << np.uint64(40))) * _SPREAD  # keys are mixed: a step of odd size will do
            yield node, to & (DIGITS - 1), [((k + within) >> shift).astype(np.int64) + i * self.rows for i, k in enumerate(keys)]

    def moved(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms that the history adds to the shares of a node's children, and the shares times their powers."""
        x = self.by_digit.take(rows[0], axis=0)
        for r in rows[1:]:
            x += self.by_digit.take(r, axis=0)
        powers = np.exp(x)
        powers *= self.bins[level].take(node, axis=0)
        return x, powers

    def gains(self, t: Tokens, p: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log of what the histories multiply the shares by that the words at the places, if known, have of the
        shared leaf."""
        out, n = np.zeros(len(p)), np.arange(len(p))
        for level, (node, digit, rows) in enumerate(self.paths(t, p, cls)):
            x, powers = self.moved(level, node, rows)
            out += x[n, digit] - np.log(np.maximum(powers @ _ONES, 1e-30))
        return out

    def branching(self, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Numbers of the places whose words are in a tree: not those with leaves of their own, nor ends, which are alone."""
        return np.flatnonzero((leaf == self.by_leaf.shape[1] - 1) & (cls < CLASSES - 1)) if self.bins else np.zeros(0, np.int64)

    def logs(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Natural log of P(class) * P(leaf) of each token, its class, whether its leaf is its own, and its gain in the
        shared leaf if it is a known word."""
        out, classes, own, gain = (np.zeros(len(t.places), k) for k in (np.float64, np.int64, bool, np.float64))
        for k in range(0, len(t.places), _STEP):
            p = t.places[k : k + _STEP]
            cls, leaf = self.outcomes(t, p)
            first, second = self.features(t, p, cls)
            n = np.arange(len(p))
            out[k : k + len(p)] = np.log(np.maximum(softmax(self.by_class, first)[cls, n], 1e-30)) + np.log(np.maximum(softmax(self.by_leaf, second)[leaf, n], 1e-30))
            classes[k : k + len(p)], own[k : k + len(p)] = cls, leaf < self.by_leaf.shape[1] - 1
            at = self.branching(cls, leaf)
            for at in np.split(at, range(_TREE_STEP, len(at), _TREE_STEP)) if len(at) else ():
                gain[k + at] = self.gains(t, p[at], cls[at])
        return out, classes, own, gain

    def add_observed(self, t: Tokens, sums: tuple[np.ndarray, ...]) -> None:
        """Add each row's outcomes to the sums (row by outcome)."""
        cls, leaf = self.outcomes(t, t.places)
        at = self.branching(cls, leaf)
        for _, digit, rows in self.paths(t, t.places[at], cls[at]):
            for i, r in enumerate(rows):
                part = sums[2][i * self.rows : (i + 1) * self.rows]
                part += np.bincount((r - i * self.rows) * DIGITS + digit, minlength=part.size).reshape(part.shape)
        for rows, outcome, total in zip(self.features(t, t.places, cls), (cls, leaf), sums[:2], strict=True):
            for i, r in enumerate(rows):
                part = total[i * self.rows : (i + 1) * self.rows]  # every history's rows are the last few
                size = total.shape[1]
                part += np.bincount((r - i * self.rows) * size + outcome, minlength=part.size).reshape(part.shape)

    def add_expected(self, t: Tokens, sums: tuple[np.ndarray, ...]) -> None:
        """Add what the weights expect of each row's outcomes to the sums (outcome by row)."""
        for k in range(0, len(t.places), _STEP):
            p = t.places[k : k + _STEP]
            cls, leaf = self.outcomes(t, p)
            at = self.branching(cls, leaf)
            for at in np.split(at, range(_TREE_STEP, len(at), _TREE_STEP)) if len(at) else ():
                shares, spans = np.empty((DIGITS, len(at) * len(self.bins))), []
                for level, (node, _, rows) in enumerate(self.paths(t, p[at], cls[at])):
                    powers = self.moved(level, node, rows)[1]
                    np.divide(powers.T, powers @ _ONES, out=shares[:, level * len(at) : (level + 1) * len(at)])
                    spans.append(rows)
                for i, r in enumerate(np.concatenate(x) - i * self.rows for i, x in enumerate(zip(*spans, strict=True))):
                    for outcome, share in enumerate(shares):
                        sums[2][outcome, i * self.rows : (i + 1) * self.rows] += np.bincount(r, weights=share, minlength=self.rows)
            first, second = self.features(t, p, cls)
            for rows, weights, total, base in ((first, self.by_class, sums[0], None), (second, self.by_leaf, sums[1], cls)):
                shares = softmax(weights, rows).astype(np.float64)
                for i, r in enumerate(rows[:-1]):
                    r = r - i * self.rows
                    for outcome, share in enumerate(shares):
                        total[outcome, i * self.rows : (i + 1) * self.rows] += np.bincount(r, weights=share, minlength=self.rows)
                if base is None:
                    total[:, -1] += shares.sum(axis=1)
                else:
                    total[:, -CLASSES:] += shares @ (base[:, None] == np.arange(CLASSES))

    def start(self, observed: tuple[np.ndarray, ...]) -> None:
        """First weights: outcomes' overall log shares (by class for the leaf), and a part of each row's log ratio to them;
        none in the trees, whose nodes have their shares."""
        for name, seen, bases in (("by_class", observed[0], 1), ("by_leaf", observed[1], CLASSES)):
            base = seen[-bases:] + 0.5
            base = base / base.sum(axis=1, keepdims=True)
            overall = seen[-bases:].sum(axis=0) + 0.5
            overall = overall / overall.sum()
            rows = seen[:-bases]
            ratio = np.log((rows + PRIOR * overall) / (rows.sum(axis=1, keepdims=True) + PRIOR) / overall)
            setattr(self, name, np.concatenate([START * ratio, np.log(base)]).astype(np.float32))

    def move(self, observed: tuple[np.ndarray, ...], expected: tuple[np.ndarray, ...]) -> None:
        """One gradient step: observed less expected, scaled by what bounds the curvature."""
        for weights, seen, wanted in zip((self.by_class, self.by_leaf, self.by_digit), observed, expected, strict=True):
            weights += (RATE * np.clip((seen - wanted) / (wanted + PRIOR), -1, 2)).astype(np.float32)


def cluster_shapes(table: np.ndarray) -> np.ndarray:
    """Class of each shape, and of ends: weighted k-means over the roots of the shares of what precedes a shape."""
    total = table.sum(axis=1)
    x = np.sqrt(table / np.maximum(total, 1)[:, None])
    k = CLASSES - 1
    centre = x[np.argsort(-total, kind="stable")[:k]].copy()
    for _ in range(15):
        near = ((centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        for c in range(k):
            own = near == c
            if total[own].sum() > 0:
                centre[c] = np.average(x[own], axis=0, weights=total[own])
    return np.append(near, k)


def assembled(class_of: np.ndarray, words: np.ndarray, shapes: np.ndarray, counts: np.ndarray, rows: int, binned: np.ndarray, levels: int) -> Model:
    """A model without weights; words: each class's most frequent ones, by descending count; binned: (CLASSES, bins) tokens
    and words of every bin."""
    cls = class_of[shapes]
    order = np.argsort(cls, kind="stable")
    first = np.searchsorted(cls[order], np.arange(CLASSES))
    rank = np.arange(len(order)) - first[cls[order]]
    chosen = order[(rank < LEAVES - 1) & (cls[order] < CLASSES - 1)]
    leaf = rank[(rank < LEAVES - 1) & (cls[order] < CLASSES - 1)]
    frequent = words[chosen]
    size, shift = 1 << 16, 0
    while True:  # slots that no two of them share
        at = ((frequent >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
        if len(np.unique(at)) == len(at):
            break
        shift, size = (shift + 1, size) if shift < 40 else (0, 2 * size)
    slots = np.full(size, -1, np.int64)
    slots[at] = np.arange(len(at))
    binned = binned.copy()
    np.subtract.at(binned, (cls[chosen], _codes(frequent, levels)), counts[chosen] + 1)
    bins: list = []
    for _ in range(levels):
        binned = binned.reshape(-1, DIGITS)
        bins.insert(0, (binned / np.maximum(binned.sum(axis=1, keepdims=True), 1)).astype(np.float32))
        binned = binned.sum(axis=1)
    by_digit = np.zeros((LEAF_KINDS * rows if levels else 0, DIGITS), np.float32)
    # one more, which the last slot number -1 finds
    return Model(class_of, slots, shift, np.append(frequent, np.uint64(0)), np.append(leaf, LEAVES - 1), rows, np.zeros((CLASS_KINDS * rows + 1, CLASSES), np.float32), np.zeros((LEAF_KINDS * rows + CLASSES, LEAVES), np.float32), cls[chosen], counts[chosen], bins, by_digit)


def _texts(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, _HALF):
            yield batch.slice(k, _HALF)


def _merged(words: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(words), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def _counted(train: DataFrame) -> DataFrame:
    """(word, shape, n) of each partition; and, with shape -1, counts of (shape, context), word being shape * CONTEXTS +
    context."""

    def run(batches):
        words, counts, shape_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
        pairs, held = np.zeros((SHAPES + 1) * CONTEXTS, np.int64), 0
        for batch in _texts(batches):
            t = tokens(batch.column(0))
            own = t.words[t.places] ^ np.uint64(0)
            # the shape goes with its word in the low bits of a second key
            key, first, n = np.unique(own, return_index=True, return_counts=True)
            words.append(key)
            counts.append(n)
            shape_of.setdefault("k", []).append(key)
            shape_of.setdefault("s", []).append(t.shapes[t.places][first])
            pairs += np.bincount(t.shapes[t.places].astype(np.int64) * CONTEXTS + t.shapes[t.places - 1] % CONTEXTS, minlength=len(pairs))
            held += len(key)
            if held > 2_000_000:
                a, b = _merged(words, counts)
                k, i = np.unique(np.concatenate(shape_of["k"]), return_index=True)
                shape_of = {"k": [k], "s": [np.concatenate(shape_of["s"])[i]]}
                words, counts, held = [a], [b], 0
        a, b = _merged(words, counts)
        if len(a):
            _, i = np.unique(np.concatenate(shape_of["k"]), return_index=True)
            s = np.concatenate(shape_of["s"])[i]
            at = np.flatnonzero(pairs)
            a, s, b = np.concatenate([a.astype(np.int64), at]), np.concatenate([s, np.full(len(at), -1, np.int32)]), np.concatenate([b, pairs[at]])
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (a, s.astype(np.int32), b)], names=["word", "shape", "n"])

    return train.mapInArrow(textkit.releasing(run), "word long, shape int, n long")


def _leading(counts: DataFrame, class_of: np.ndarray) -> pa.Table:
    """(word, shape, n) of the LEAVES - 1 most frequent words of each class, by descending count."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(class_of[batch.column(1).to_numpy()].astype(np.int32))], names=["word", "shape", "n", "cls"])

    first = Window.partitionBy("cls").orderBy(F.desc("n"), "word")
    named = counts.select("word", "shape", "n").mapInArrow(run, "word long, shape int, n long, cls int")
    return named.withColumn("rank", F.row_number().over(first)).where(F.col("rank") < LEAVES).orderBy(F.desc("n"), "word").select("word", "shape", "n").toArrow()


def _binned(counts: DataFrame, class_of: np.ndarray, levels: int) -> np.ndarray:
    """(CLASSES, bins) tokens and words of all counted words by the first digits of their hashes."""
    size = DIGITS**levels

    def run(batches):
        sums = np.zeros(CLASSES * size)
        for batch in batches:
            word, shape, n = (c.to_numpy() for c in batch.columns)
            at, where = np.unique(class_of[shape] * size + _codes(word.astype(np.uint64), levels), return_inverse=True)
            sums[at] += np.bincount(where, weights=n + 1)
        at = np.flatnonzero(sums)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(sums[at[k : k + 50_000]].astype(np.int64))], names=["bin", "n"])

    out = np.zeros(CLASSES * size, np.int64)
    summed = counts.select("word", "shape", "n").mapInArrow(textkit.releasing(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    for r in summed.toArrow().to_batches():  # at most a row a bin: bounded
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out.reshape(CLASSES, size)


def _summed(train: DataFrame, model: Model, observed: bool) -> tuple[np.ndarray, ...]:
    """Observed or expected outcomes of every row over all of train, (row, outcome) for class, leaf and digits.

    Each partition sends the rows it touched, in blocks; they are added up in two steps, so no task or driver gathers more
    than some partitions' copies of a block."""
    block_rows, kind = 1024, "<i8" if observed else "<f4"
    shapes = (model.by_class.shape, model.by_leaf.shape, model.by_digit.shape)

    def gather(batches):
        sums = tuple(np.zeros(s if observed else s[::-1]) for s in shapes)
        for batch in _texts(batches):
            (model.add_observed if observed else model.add_expected)(tokens(batch.column(0)), sums)
        salt = TaskContext.get().partitionId() // 16
        for level, total in enumerate(sums if observed else (x.T for x in sums)):
            for k in range(0, len(total), block_rows):
                part = total[k : k + block_rows]
                at = np.flatnonzero(part.any(axis=1))
                if len(at):
                    yield record(level, k, salt, at, part[at])

    def record(level, block, salt, at, values):
        cells = ([level], [block], [salt], [at.astype("<i4").tobytes()], [values.astype(kind).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["level", "block", "salt", "at", "v"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for level, block, at, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                rows, width = shapes[level]
                if (level, block) not in sums:
                    sums[level, block] = np.zeros((min(block_rows, rows - block), width))
                sums[level, block][np.frombuffer(at, "<i4")] += np.frombuffer(v, kind).reshape(-1, width)
        for (level, block), total in sums.items():
            at = np.flatnonzero(total.any(axis=1))
            yield record(level, block, 0, at, total[at])

    schema = "level int, block long, salt int, at binary, v binary"
    # a task sends its sums once, whatever it read: let it read some partitions, as long as all cores have work
    tasks = max(2 * train.sparkSession.sparkContext.defaultParallelism, train.rdd.getNumPartitions() // 8)
    parts = train.coalesce(tasks).mapInArrow(textkit.releasing(gather), schema).repartition("level", "block", "salt").mapInArrow(add, schema).repartition("level", "block").mapInArrow(add, schema)
    out = tuple(np.zeros(s) for s in shapes)
    for r in parts.toLocalIterator():  # the size of the weights: bounded
        out[r["level"]][r["block"] + np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["v"], kind).reshape(-1, shapes[r["level"]][1])
    return out


def trained(text: DataFrame, model: Model) -> Model:
    """The model after ROUNDS gradient steps over all texts of the one column."""
    observed = _summed(text, model, observed=True)
    model.start(observed)
    for _ in range(ROUNDS):
        model.move(observed, _summed(text, model, observed=False))
    return model


def score(docs: DataFrame, train: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of `keep`, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learned from train.

    Tokens are the runs of bytes outside ASCII white space, A-Z lower-cased, then one end.  base_score is the add-one
    unigram log10 probability, score the model's; n_known counts tokens that occur in train.

    Null and empty texts hold the end alone.  Null ids stay null; repeated rows are scored as often as they occur; very
    long texts are read whole.  Without training texts every count is 0.  No rows give no rows; other columns are ignored.
    """
    text = train.select(F.coalesce(F.col(text_col), F.lit("")))
    found = space.save(_counted(text).groupBy("word", F.when(F.col("shape") < 0, F.lit(-1)).otherwise(F.lit(0)).alias("kind")).agg(F.sum("n").alias("n"), F.max("shape").alias("shape")), "counted")
    counts = found.where("kind = 0").select("word", "n", "shape")
    table = np.zeros((SHAPES + 1) * CONTEXTS)
    for r in found.where("kind = -1").select("word", "n").toArrow().to_batches():  # at most one row a shape and context
        table[r.column(0).to_numpy()] = r.column(1).to_numpy()
    class_of = cluster_shapes(table.reshape(-1, CONTEXTS)[:SHAPES])
    tokens_in, words_in = np.zeros(CLASSES), np.zeros(CLASSES)
    total = vocabulary = 0
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a shape
        tokens_in[class_of[r["shape"]]] += r["n"]
        words_in[class_of[r["shape"]]] += r["v"]
        total, vocabulary = total + r["n"], vocabulary + r["v"]
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n", "shape").toArrow()
    word, n = head.column("word").to_numpy().astype(np.int64).astype(np.uint64), head.column("n").to_numpy()
    leading, levels = _leading(counts, class_of), levels_for(vocabulary)
    first_words, first_counts = leading.column("word").to_numpy().astype(np.uint64), leading.column("n").to_numpy()
    binned = _binned(counts, class_of, levels) if levels else np.zeros((CLASSES, 1), np.int64)
    model = assembled(class_of, first_words, leading.column("shape").to_numpy(), first_counts, rows_for(vocabulary), binned, levels)
    # words with leaves of their own are held whatever their rank among all words
    more = np.isin(first_words, word, invert=True)
    word, n = np.append(word, first_words[more]), np.append(n, first_counts[more])
    if total:
        model = trained(text, model)
    order = np.argsort(word)
    # one more entry, so that a search always ends on one
    head_words, head_logs = np.append(word[order], np.uint64(0)), np.append(np.log10(n[order] + 1.0), 0.0)
    inner = np.log10(model.shared(tokens_in, words_in))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in _texts(batches):
            t = tokens(batch.column(batch.num_columns - 1))
            size = np.diff(t.at)
            logs, cls, single, gain = model.logs(t)
            own = t.words[t.places]
            at = np.searchsorted(head_words[:-1], own)
            there = head_words[at] == own
            there &= at < len(head_words) - 1
            known = np.add.reduceat(there.astype(np.int64), t.at[:-1])
            # a word with a leaf of its own needs no count, but `logged` holds it
            by_class = np.add.reduceat((logs + np.where(there, gain, 0.0)) / np.log(10) - np.where(single, head_logs[at], inner[cls]), t.at[:-1])
            logged = np.add.reduceat(np.where(there, head_logs[at], 0.0), t.at[:-1])
            doc, rest, gain = np.repeat(np.arange(len(size)), size)[~there], own[~there], gain[~there] / np.log(10)
            order = np.lexsort((rest, doc))
            doc, rest, gain = doc[order], rest[order], gain[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1]))) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(doc)))
            gain = np.add.reduceat(gain, first) if len(first) else gain
            # each document's own entry leads its list, with no occurrence
            cut = np.searchsorted(doc[first], np.arange(len(size) + 1))
            ids = np.arange(len(size)) + row
            row += len(size)
            words = np.insert(rest[first].astype(np.int64), cut[:-1], textkit.mix64(ids.astype(np.uint64)).astype(np.int64))
            times = np.insert(times, cut[:-1], 0).astype(np.int32)
            gain = np.insert(gain, cut[:-1], 0.0)
            offsets = pa.array((cut + np.arange(len(cut))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids), pa.array(size), pa.array(known), pa.array(logged), pa.array(by_class),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words, times, gain)]], names=names)

    taken = docs.select(id_col, *keep, text_col)
    schema = taken.drop(text_col).schema
    for name, kind in (("_row", "long"), ("_size", "long"), ("_known", "long"), ("_logged", "double"), ("_by_class", "double"), ("_words", ArrayType(LongType())), ("_times", ArrayType(IntegerType())), ("_gains", ArrayType(DoubleType()))):
        schema = schema.add(name, kind)
    names = schema.names
    batched = taken.mapInArrow(textkit.releasing(run), schema)
    lead = [id_col, *keep, "_size", "_known", "_logged", "_by_class"]
    each = batched.select("_row", *lead, F.explode(F.arrays_zip("_words", "_times", "_gains")).alias("e")).select(
        "_row", F.col("e._words").alias("_word"), F.col("e._times").alias("_n"), F.col("e._gains").alias("_gain"), *[F.when(F.col("e._times") == 0, F.col(c)).alias(c) for c in lead]
    )
    tail = counts.select("word", F.col("n").alias("_count"))
    rare = each.join(tail, (each["_word"] == tail["word"]) & (each["_n"] > 0), "left")
    seen = F.col("_count").isNotNull() & (F.col("_n") > 0)
    summed = rare.groupBy("_row").agg(
        *[F.max(c).alias(c) for c in lead],
        F.sum(F.when(seen, F.col("_n")).otherwise(0)).alias("_more"), F.sum(F.when(seen, F.col("_n") * F.log10(F.col("_count") + 1.0)).otherwise(0.0)).alias("_logs"),
        F.sum(F.when(seen, F.col("_gain")).otherwise(0.0)).alias("_gained"),
    )
    logs = F.col("_logged") + F.col("_logs")
    return summed.select(
        id_col, *keep, F.col("_size").alias("n_tokens"), (F.col("_known") + F.col("_more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("_size") * float(np.log10(total + vocabulary + 1))).alias("base_score"), (logs + F.col("_by_class") + F.col("_gained")).alias("score"),
    )
