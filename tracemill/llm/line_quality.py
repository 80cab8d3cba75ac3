"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's features are shares of byte classes, its length and whether it
repeats an earlier line, with the same values of the lines before and after it; transitions tie neighbouring labels.
Only documents come labelled, so the labels of training lines are latent: a document's label speaks for each of its lines
with log odds EVIDENCE, and training raises the likelihood summed over all ways to label the lines.  So junk lines that
mostly stand in bad documents are bad in a good one too.  Forward-backward marginals, weighted by line length in code
points, average to the document's share of good text, and a one-dimensional logistic fit turns that share into a score.
Scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracemill.llm import textkit

#: Bound of the training sample: so many labelled documents, the first by a hash of the id, and so many lines in total.
TRAIN_DOCS = 3000
TRAIN_LINES = 100_000
#: Lines of a training chain; a longer document is several chains, all of its label.
CHAIN = 512
#: Log odds by which a document's label speaks for the label of each of its lines.
EVIDENCE = 3.0
#: Lines whose features are spread out at a time.
_LINES = 1 << 16

_NEWLINE = 0x0A


def _class_table(members: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in members]] = 1
    return table


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class_table("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = 1
_DIGIT = _class_table("0123456789")
_STOP = _class_table(".,;:?")
_SPACE = textkit.SPACE.astype(np.uint8)
_PIPE = _class_table("|<>{}[]\\")
_LOUD = _class_table("!")
_SIGN = _class_table("*$%&#@~^=+_`/")
_CHARS = np.ones(256, np.uint8)
_CHARS[0x80:0xC0] = 0
_SHARES = (_UPPER, _LETTER, _DIGIT, _STOP, _SPACE, _PIPE, _LOUD, _SIGN)

#: Features of one line by itself: a constant, the shares above, words equal to the word before and mean word length,
#: log length, blank, repeated.
OWN = len(_SHARES) + 6
#: With those of its neighbours, and whether it is the first or the last.
FEATURES = 3 * OWN + 2


def own_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text by itself, its length in code points, and each text's offsets in the lines.  An
    empty text is one blank line."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf == _NEWLINE)
    inner = np.searchsorted(breaks, off)
    per_doc = np.diff(inner) + 1
    at = np.concatenate([[0], np.cumsum(per_doc)])
    starts = np.empty(at[-1], np.int64)
    ends = np.empty(at[-1], np.int64)
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    starts[first], starts[~first] = off[:-1], breaks + 1
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    ends[last], ends[~last] = off[1:], breaks

    size = np.maximum(ends - starts, 1)
    own = np.zeros((at[-1], OWN), np.float32)
    own[:, 0] = 1
    chars = np.zeros(at[-1], np.int64)
    hashes = np.zeros(at[-1], np.uint64)
    words, echoes = np.zeros(at[-1]), np.zeros(at[-1])
    last_line, last_word = -1, np.uint64(0)
    for i, j, a, b in textkit.blocks(buf, off):  # what is known of a line of a long text adds up over its pieces
        piece = buf[a:b]
        lo, hi = np.searchsorted(ends, a, side="left"), np.searchsorted(starts, b, side="right")
        lo, hi = max(lo, at[i]), min(hi, at[j])
        s, e = np.clip(starts[lo:hi], a, b) - a, np.clip(ends[lo:hi], a, b) - a
        for k, tab in enumerate((*_SHARES, _CHARS)):
            sums = np.zeros(len(piece) + 1, np.int32)
            np.cumsum(tab[piece], out=sums[1:])
            if k < len(_SHARES):
                own[lo:hi, k + 1] += sums[e] - sums[s]
            else:
                chars[lo:hi] += sums[e] - sums[s]
        if len(piece):
            part = textkit.span_sums(piece, s, e)
            for k in range(int(np.searchsorted(starts[lo:hi], a))):  # begun in an earlier piece
                part[k] *= textkit.power(int(a - starts[lo + k]))
            hashes[lo:hi] += part
            ws, we = textkit.word_spans(piece, s)
            h = textkit.span_hashes(piece, ws, we)
            edges = np.append(np.searchsorted(ws, s), len(ws))
            echo = np.zeros(len(ws) + 1, np.int64)
            same = np.zeros(len(ws), bool)
            same[1:] = h[1:] == h[:-1]
            same[edges[:-1][edges[:-1] < len(ws)]] = False
            if len(ws):
                line_of = lo + np.searchsorted(s, ws[[0, -1]], side="right") - 1
                same[0] = line_of[0] == last_line and h[0] == last_word
                last_line, last_word = line_of[1], h[-1]
            np.cumsum(same, out=echo[1:])
            words[lo:hi] += np.diff(edges)
            echoes[lo:hi] += np.diff(echo[edges])
    own[:, 1 : len(_SHARES) + 1] = np.sqrt(own[:, 1 : len(_SHARES) + 1] / size[:, None])  # a few bytes of a class already tell
    own[:, -5] = np.sqrt(echoes / np.maximum(words, 1))
    own[:, -4] = np.log1p(chars / np.maximum(words, 1)) / 4
    own[:, -3] = np.log1p(chars) / 8
    own[:, -2] = chars == 0
    doc = np.repeat(np.arange(n), per_doc)
    key = textkit.mix64(hashes + textkit.mix64(doc.astype(np.uint64)))
    seen = np.zeros(at[-1], bool)
    seen[np.unique(key, return_index=True)[1]] = True
    own[:, -1] = ~seen & (chars > 0)

    return own, chars, at


def spread(own: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Features of lines lo to hi: their own, those of the lines before and after, and whether they are first or last."""
    first, last = np.zeros(hi - lo, bool), np.zeros(hi - lo, bool)
    ends = at[1:] - 1
    first[at[:-1][(at[:-1] >= lo) & (at[:-1] < hi)] - lo] = True
    last[ends[(ends >= lo) & (ends < hi)] - lo] = True
    x = np.zeros((hi - lo, FEATURES), np.float32)
    x[:, :OWN] = own[lo:hi]
    from_before = own[max(lo - 1, 0) : hi - 1]
    x[hi - lo - len(from_before) :, OWN : 2 * OWN] = from_before
    x[first, OWN : 2 * OWN] = 0
    from_after = own[lo + 1 : hi + 1]
    x[: len(from_after), 2 * OWN : 3 * OWN] = from_after
    x[last, 2 * OWN : 3 * OWN] = 0
    x[:, -2], x[:, -1] = first, last
    return x


def forward_backward(u: np.ndarray, turn: np.ndarray, at: np.ndarray, pairs: bool = False):
    """Marginals of label 1 of a chain per text.  u: the log potential of label 1 (that of 0 is 0); turn: 2 x 2 log
    potentials of transitions; at: offsets of the chains.  With pairs also the expected transition counts.  All chains
    advance together, one line a step."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    begin, length = at[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps + 1)]  # chains longer than t
    alpha, beta = np.zeros((len(u), 2)), np.zeros((len(u), 2))

    def pot(rows):
        return np.stack([np.zeros(len(rows)), u[rows]], axis=1)

    for t in range(steps):
        rows = begin[: alive[t]] + t
        alpha[rows] = pot(rows)
        if t:
            before = alpha[rows - 1]
            alpha[rows] += np.logaddexp(before[:, :1] + turn[0], before[:, 1:] + turn[1])
    for t in range(steps - 2, -1, -1):
        rows = begin[: alive[t + 1]] + t
        after = beta[rows + 1] + pot(rows + 1)
        beta[rows] = np.logaddexp(turn[:, 0] + after[:, :1], turn[:, 1] + after[:, 1:])
    ends = at[1:] - 1
    total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.repeat(total, np.diff(at))
    p = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0))
    if not pairs:
        return p
    inner = np.ones(len(u), bool)
    inner[ends] = False
    rows = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(alpha[rows, a] + turn[a, b] + (u[rows + 1] if b else 0) + beta[rows + 1, b] - z[rows]).sum()
    return p, pair


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    turn: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Slope and intercept of the score over the logit of the share of good text.
    fit: tuple[float, float] = (1.0, 0.0)

    def marginals(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each line to be good."""
        u = np.concatenate([np.zeros(0), *[spread(own, at, k, min(k + _LINES, len(own))) @ self.weights for k in range(0, len(own), _LINES)]])
        return forward_backward(u, self.turn, at)

    def share(self, own: np.ndarray, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals; where no line has any length, their plain mean."""
        if len(at) == 1:
            return np.zeros(0)
        p, weight = self.marginals(own, at), chars.astype(float)
        empty = np.add.reduceat(weight, at[:-1]) == 0
        weight[np.repeat(empty, np.diff(at))] = 1
        return np.add.reduceat(p * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])

    def score(self, own, chars, at) -> np.ndarray:
        return 1 / (1 + np.exp(-self.fit[0] * _logit(self.share(own, chars, at)) - self.fit[1]))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(theta: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return theta


#: Penalties: neighbours' features and transitions speak only where a line's own features don't.
_PENALTY = np.concatenate([np.full(OWN, 3e-4), np.full(2 * OWN + 2, 3e-3), np.full(4, 1e-2)])


def train(own: np.ndarray, chars: np.ndarray, at: np.ndarray, labels: np.ndarray, steps: int = 120) -> Crf:
    """Penalised maximum likelihood with latent line labels.  It starts where every line has its document's label and lets
    go of that in the second half of the steps.  Without examples of both labels, the untrained model, which scores
    everything 0.5."""
    if len(set(labels.tolist())) < 2:
        return Crf()
    x = spread(own, at, 0, len(own))
    y = np.repeat(labels, np.diff(at)).astype(float)
    chains = np.unique(np.concatenate([at, *[np.arange(a, b, CHAIN) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > CHAIN]]))

    def gradient(evidence):
        def at_theta(theta):
            u, turn = x @ theta[:-4], theta[-4:].reshape(2, 2)
            p, pair = forward_backward(u, turn, chains, pairs=True)
            q, seen = forward_backward(u + evidence * (2 * y - 1), turn, chains, pairs=True)
            return np.concatenate([x.T @ (p - q), (pair - seen).ravel()]) / len(y) + _PENALTY * theta

        return at_theta

    theta = _adam(np.zeros(FEATURES + 4), gradient(20.0), steps // 2, 0.2)
    theta = _adam(theta, gradient(EVIDENCE), steps // 2, 0.2)
    crf = Crf(theta[:-4], theta[-4:].reshape(2, 2))
    s = _logit(crf.share(own, chars, at))

    def slope(fit):
        p = 1 / (1 + np.exp(-fit[0] * s - fit[1]))
        return np.array([((p - labels) * s).mean(), (p - labels).mean()]) + 1e-3 * fit

    a, b = _adam(np.array([1.0, 0.0]), slope, 300, 0.05)
    crf.fit = float(a), float(b)
    return crf


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """Train on a bounded sample (TRAIN_DOCS, TRAIN_LINES) of the labelled ids: the first by a hash of the id, until the
    next would pass the lines.  Ids that are null, or labelled both ways, teach nothing; of repeated rows one counts."""
    rows = (
        labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
        .agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_other")).where("_label = _other")
        .orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_DOCS).collect()
    )
    label = {r[0]: r[1] for r in rows}
    if not label:
        return Crf()
    text = F.coalesce(F.col(text_col), F.lit(""))
    there = docs.where(F.col(id_col).isin(list(label)))
    sizes = dict(there.groupBy(F.col(id_col).cast("long")).agg(F.max(1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))).collect())
    chosen, lines = [], 0
    for i in label:
        if lines + sizes.get(i, 0) > TRAIN_LINES:
            if len({label[k] for k in chosen}) == 2:
                break
        elif i in sizes:
            chosen.append(i)
            lines += sizes[i]

    def run(batches):
        for batch in batches:
            own, chars, at = own_features(*textkit.flat_utf8(batch.column(1)))
            cells = [(own[a:b].astype("<f4").tobytes(), chars[a:b].astype("<i8").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["id", "own", "chars"])

    one = docs.where(F.col(id_col).isin(chosen)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(text).alias("text"))
    found = {r["id"]: r for r in one.mapInArrow(textkit.releasing(run), "id long, own binary, chars binary").collect()}
    if not found:
        return Crf()
    ids = sorted(found)
    own = np.concatenate([np.frombuffer(found[i]["own"], "<f4").reshape(-1, OWN) for i in ids])
    chars = [np.frombuffer(found[i]["chars"], "<i8") for i in ids]
    at = np.concatenate([[0], np.cumsum([len(c) for c in chars])])
    return train(own, np.concatenate(chars), at, np.array([label[i] for i in ids]))


def _parts(texts: pa.Array, limit: int = 1 << 22):
    """Slices of the texts, of some 200 and some bytes each."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    k = 0
    while k < len(texts):
        j = max(k + 1, min(k + 200, int(np.searchsorted(size, size[k] + limit, side="right")) - 1))
        yield texts.slice(k, j - k)
        k = j


def score(docs: DataFrame, crf: Crf, columns: list[str | Column], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The given columns of every row with its score in [0, 1].

    Null and empty texts count as one blank line and are scored like any other; texts of any length are read whole;
    repeated rows get equal scores; no rows give no rows; further columns of any name may be carried along.
    """
    out = docs.select(*columns, docs[text_col])  # the text is the last column, whatever the others are called
    schema = StructType([*out.schema.fields[:-1], StructField(score_col, DoubleType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            s = np.concatenate([np.zeros(0), *[crf.score(*own_features(*textkit.flat_utf8(part))) for part in _parts(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=names)

    return out.mapInArrow(textkit.releasing(run), schema)
