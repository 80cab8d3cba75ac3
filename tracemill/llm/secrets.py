"""Secret scans whose false positives a random forest removes.

Candidates are of two shapes.  An assigned value stands behind a naming word (KEYWORDS), with an equals sign, a colon or an
arrow between, in quotes or up to white space: of any length and any characters.  A bare run has at least RUN_LENGTH bytes
of [A-Za-z0-9+/_-] and trailing equals signs, with a digit or a capital behind its first letter (all else is the shape of
plain words); runs of ten bytes or more that single dots join are one.  Where both meet, the assigned value counts.

The forest, trained from labelled findings, tells secrets from checksums, card numbers, identifiers, placeholders and words
by length, character classes and transitions, dictionary coverage, the path and neighbouring words.  Findings come from a
table of reviewed ones (findings_from) or from labelled_findings().  Each text is read once and whole, and nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm import textkit
from tracemill.llm.expressions import unused

#: Least bytes of a bare run, and of each part of a dotted one.
RUN_LENGTH, PART_LENGTH = 16, 10
#: Bytes on either side of a candidate in which neighbouring words are looked for.
AROUND = 80
#: Reviewed findings that a forest is trained on at most, the first by a hash of all their columns.
TRAIN_FINDINGS = 20_000
MARK = "[secret]"

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = True
#: Kinds of bytes: lower, upper, digit, other.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 0, 1, 2
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True

#: Words that name a secret in front of its value.
KEYWORDS = ("key", "token", "secret", "password", "passwd", "passphrase", "pwd", "auth", "bearer", "credential", "credentials")
#: Words beside a value that speak for and against a secret, and path parts of files that hold samples.
FOR = (*KEYWORDS, "api", "apikey", "private", "login")
AGAINST = (
    "sha", "sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "uuid", "guid", "id", "integrity", "etag", "hash", "card", "number", "isbn", "build", "version",
    "public", "keyboard", "primary", "foreign",
)
SAMPLES = ("test", "tests", "example", "examples", "sample", "docs", "fixture", "fixtures", "mock")
#: Common words and parts of identifiers, for dictionary coverage.
DICTIONARY = (
    "the and for with this that from have not you are was were will can has had but all any one two new old use used using value values name names type types data list "
    "item items user users file files path paths test tests code line lines text time times date page pages link index table tables column columns string strings number "
    "numbers object objects array class classes method methods function functions return import export module package version config setting settings option options "
    "default error errors message request response server client example sample placeholder change changeme here dummy fake demo your insert replace enter none null "
    "true false empty unknown required optional password secret token key api auth access private public http https www com org net html json xml yaml home temp build "
    "source target main master branch commit update create delete select order group count first last next prev left right width height color image style button"
).split()
_WORDS = re.compile("|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w))))
_ASSIGNED = re.compile(rb"(?:" + "|".join(sorted(KEYWORDS, key=len, reverse=True)).encode() + rb""")["']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""")


def _assigned(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """Spans of assigned values, text by text."""
    found = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for m in _ASSIGNED.finditer(textkit.LOWER[buf[a:b]].tobytes()):
            lo, hi = m.span(m.lastindex)
            found.append((a + lo, a + hi))
    return found


def _runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Spans of bare runs; long texts are looked through in blocks cut at white space, where no run can be."""
    found = [np.zeros((2, 0), np.int64)]
    for i, j, a, b in textkit.blocks(buf, off):
        piece = buf[a:b]
        run = _RUN[piece]
        edges = off[i + 1 : j] - a  # a run doesn't go on into the next text
        edges = np.unique(edges[(edges > 0) & (edges < b - a)])
        ends_text = np.zeros(b - a + 1, bool)
        ends_text[edges] = True
        # an equals sign is part of a run only as its padding
        goes_on = np.append(run[1:], False) & ~ends_text[1:]
        run &= (piece != 0x3D) | ~goes_on | (np.append(piece[1:], 0) == 0x3D)
        edge = np.diff(np.concatenate([[0], run.astype(np.int8), [0]]))
        bounds = edges[run[edges - 1] & run[edges]] if len(edges) else edges
        starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), bounds]))
        ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), bounds]))
        # dotted parts
        size = ends - starts
        dotted = np.zeros(len(starts), bool)
        dotted[:-1] = (starts[1:] == ends[:-1] + 1) & (size[1:] >= PART_LENGTH) & (size[:-1] >= PART_LENGTH)
        dotted[:-1] &= (piece[np.minimum(ends[:-1], b - a - 1)] == 0x2E) & ~ends_text[ends[:-1]] & ~ends_text[starts[1:]]
        starts, ends = starts[~np.append(False, dotted[:-1])] if len(starts) else starts, ends[~dotted]
        kind = _KIND[piece]
        digits = np.concatenate([[0], np.cumsum(kind == 2)])
        capitals = np.concatenate([[0], np.cumsum(kind == 1)])
        keep = (ends - starts >= RUN_LENGTH) & ((digits[ends] > digits[starts]) | (capitals[ends] > capitals[np.minimum(starts + 1, ends)]))
        found.append(np.stack([starts[keep] + a, ends[keep] + a]))
    return np.concatenate(found, axis=1)


def candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte of each candidate, in order."""
    runs, assigned = _runs(buf, off), np.array(_assigned(buf, off), np.int64).reshape(-1, 2).T
    # runs that overlap no assigned value (these are disjoint and in order)
    after = np.searchsorted(assigned[1], runs[0], side="right")
    free = (after == assigned.shape[1]) | (np.append(assigned[0], np.iinfo(np.int64).max)[after] >= runs[1])
    starts, ends = np.concatenate([runs[:, free], assigned], axis=1)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return np.searchsorted(off, starts, side="right") - 1, starts, ends


def coverage(value: str) -> float:
    """Share of the value that dictionary words of at least three letters cover, taken longest first from the left."""
    return sum(m.end() - m.start() for m in _WORDS.finditer(value.lower())) / max(1, len(value))


_LEAD = re.compile(r"""(?:=>|:=|=|:)\s*["']?$""")
_HEX, _UUID = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def features(value: str, before: str, after: str, path: str | None) -> list[float]:
    v = np.frombuffer(value.encode(), np.uint8)
    n, steps = len(v), max(1, len(v) - 1)
    kind = _KIND[v]
    shares = np.bincount(kind, minlength=4) / max(1, n)
    turns = np.bincount(kind[:-1].astype(int) * 4 + kind[1:], minlength=16).reshape(4, 4) / steps
    pairs = len(np.unique(v[:-1].astype(np.uint16) * 256 + v[1:])) / steps  # distinct transitions
    counts = np.bincount(v)
    p = counts[counts > 0] / max(1, n)
    vowel, letter = _VOWEL[v], kind < 2
    alternating = ((vowel[1:] != vowel[:-1]) & letter[1:] & letter[:-1]).sum() / steps
    left, right = re.findall(r"[a-z0-9]+", before.lower())[-5:], re.findall(r"[a-z0-9]+", after.lower())[:3]
    parts = re.split(r"[^a-z0-9]+", (path or "").lower())
    return [
        n, *shares, 1 - np.trace(turns), turns[0, 2] + turns[2, 0], turns[0, 1], turns[1, 0], turns[1, 2] + turns[2, 1], pairs, vowel.mean() if n else 0.0, alternating,
        -(p * np.log2(p)).sum(), coverage(value), float(_HEX.fullmatch(value) is not None), float(kind.min(initial=3) == kind.max(initial=2) == 2), float(_UUID.fullmatch(value) is not None),
        float(_LEAD.search(before) is not None), float(before.endswith(("'", '"'))), float(value[:1] in "$<{[%(" or "(" in value), float(" " in value),
        float(any(w in FOR for w in left[-2:])), float(any(w in AGAINST for w in left[-2:])), float(any(w in FOR for w in left[:-2])), float(any(w in AGAINST for w in left[:-2])),
        float(any(w in FOR for w in right)), float(any(p in SAMPLES for p in parts)),
    ]


@dataclass
class Tree:
    feature: np.ndarray  # -1 in a leaf
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node]
            go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.limit[node], self.left[node], self.right[node])
            node = np.where(inner, go, node)
        return self.share[node]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.RandomState, depth: int, least: int) -> Tree:
    rows: list[list] = []

    def node(at: np.ndarray, level: int) -> int:
        me = len(rows)
        rows.append([-1, 0.0, 0, 0, y[at].mean()])
        if level == depth or len(at) < 2 * least or y[at].min() == y[at].max():
            return me
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[at, f], kind="stable")
            v, t = x[at[order], f], y[at[order]]
            n, ones = np.arange(1, len(t)), np.cumsum(t)[:-1]
            total, all_ones = len(t), t.sum()
            gini = 2 * (all_ones / total) * (1 - all_ones / total) - 2 * (ones * (1 - ones / n) + (all_ones - ones) * (1 - (all_ones - ones) / (total - n))) / total
            gini[(v[1:] == v[:-1]) | (n < least) | (total - n < least)] = -1
            k = int(gini.argmax())
            if gini[k] > best[0]:
                best = (gini[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            go = x[at, best[1]] <= best[2]
            rows[me][:2] = best[1], best[2]
            rows[me][2] = node(at[go], level + 1)
            rows[me][3] = node(at[~go], level + 1)
        return me

    node(rng.randint(0, len(y), len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*rows, strict=True)))


class Forest:
    """Bagged trees on Gini impurity, each split choosing among a random root of the features."""

    def __init__(self, findings: list[tuple[str, str, str, str | None, int]], trees: int = 40, depth: int = 8, least: int = 2, seed: int = 17):
        x = np.array([features(*f[:4]) for f in findings], float)
        y = np.array([f[4] for f in findings], float)
        rng = np.random.RandomState(seed)
        self.trees = [_grow(x, y, rng, depth, least) for _ in range(trees)]

    def predict(self, found: list[tuple[str, str, str, str | None]]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        x = np.array([features(*f) for f in found], float)
        return np.mean([t.predict(x) for t in self.trees], axis=0)


#: Kinds of findings that labelled_findings() draws: whether they are secrets.
KINDS = {
    "hex key": 1, "cloud id": 1, "prefixed token": 1, "base64 key": 1, "random letters and digits": 1, "password": 1, "signed token": 1, "letters only": 1,
    "checksum": 0, "number": 0, "uuid": 0, "identifier": 0, "file path": 0, "dated name": 0, "long word": 0, "placeholder": 0, "reference": 0, "plain value": 0, "camel case": 0,
}


def labelled_texts(n: int, seed: int, kinds=tuple(KINDS)) -> list[tuple[str, str, str, str | None]]:
    """(kind, text, value, path): invented texts that hold one value of a kind each."""
    rng = np.random.RandomState(seed)
    hexa, alnum, upper, base = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ou", "ti", "st", "le", "la", "de", "que", "der", "ung", "eau", "ment"]

    def pick(letters: str, size: int) -> str:
        return "".join(letters[k] for k in rng.randint(0, len(letters), size))

    def word() -> str:
        return "".join(parts[k] for k in rng.randint(0, len(parts), rng.randint(1, 5)))

    def words(count: int) -> str:
        return " ".join(word() for _ in range(count))

    def some(*of):
        return of[rng.randint(len(of))]

    make = {
        "hex key": lambda: pick(hexa, int(some(32, 40, 48, 64))), "cloud id": lambda: "AKIA" + pick(upper, 16), "prefixed token": lambda: some("ghp_", "sk-", "xoxb-", "pat_") + pick(alnum, int(rng.randint(24, 40))),
        "base64 key": lambda: pick(base, int(rng.randint(24, 64))) + "=" * rng.randint(0, 3), "random letters and digits": lambda: pick(alnum, int(rng.randint(18, 48))),
        "password": lambda: some(str, str.title)(word()[: rng.randint(2, 8)]) + pick("0123456789!@#$%&*?-", int(rng.randint(2, 6))) + some("", word()[:3], pick(alnum, 3)),
        "signed token": lambda: ".".join("eyJ" * (k < 2) + pick(alnum + "_-", int(rng.randint(16, 60))) for k in range(3)), "letters only": lambda: pick(alnum[:26], int(rng.randint(20, 40))),
        "checksum": lambda: pick(hexa, int(some(32, 40, 64))), "number": lambda: pick("0123456789", int(rng.randint(16, 20))), "uuid": lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        "identifier": lambda: "_".join(DICTIONARY[k] for k in rng.randint(0, len(DICTIONARY), 4)) + some("", str(rng.randint(10))), "file path": lambda: "/".join(words(4).split()) + f"/{rng.randint(99)}",
        "dated name": lambda: f"20{rng.randint(10, 30)}-{rng.randint(1, 13):02d}-{rng.randint(1, 29):02d}-{words(2).replace(' ', '-')}", "long word": lambda: (words(5).replace(" ", "") + str(rng.randint(99)))[-30:],
        "placeholder": lambda: some("changeme", "your_token_here", "your-api-key", "xxxxxxxxxxxxxxxx", "<password>", "${TOKEN}", "{{ secret }}", "example", "REPLACE_ME", "insert-your-key-here", "********", "None", "null", "true"),
        "reference": lambda: some("os.environ['TOKEN']", "getenv(KEY)", "config.password", "self.token", "request.headers", "$PASSWORD", "settings.SECRET_KEY", "params[:key]", "function(key)"),
        "plain value": lambda: some(word(), words(3), str(rng.randint(1000)), "the " + word(), some(*DICTIONARY)), "camel case": lambda: "".join(DICTIONARY[k].title() for k in rng.randint(0, len(DICTIONARY), 4)),
    }

    def one(kind: str) -> tuple[str, str, str, str | None]:
        value, quote = make[kind](), some("", '"', "'")
        name = some(*KEYWORDS)
        name = some(name, f"api_{name}", f"{word()}_{name}".upper(), f"{word()}-{name}", name.title())
        assign = f"{name}{some(' = ', ': ', '=', ':', ' => ')}{quote}"
        around = some(words(6), words(2), f"{words(3)} {some(*FOR)} {words(2)}", f"{words(3)} {some(*AGAINST)} {words(2)}") + " "
        if KINDS[kind]:
            lead = assign if kind in ("password", "letters only", "hex key") or rng.rand() < 0.7 else f"{name} {quote}" if rng.rand() < 0.6 or kind == "base64 key" else quote
            if kind in ("hex key",) and rng.rand() < 0.2:
                lead = f"{name} {quote}"
        elif kind == "checksum":
            lead = f"{some(*AGAINST[:14])}{some(' ', ': ', '-', '=', ' = ')}{quote}" if rng.rand() < 0.85 else quote
        elif kind in ("placeholder", "reference", "plain value"):
            lead = assign
        else:
            lead = assign if kind in ("number", "identifier", "long word") and rng.rand() < 0.25 else f"{some(*AGAINST, word())}{some(' ', ': ', '=')}{quote}" if rng.rand() < 0.4 else quote
        after = " " + some(words(4), words(1), f"{some(*FOR)} {some(*FOR)}", f"{word()} {some(*AGAINST)}")
        path = some("src", "app/config", "deploy/env", "web", None) if KINDS[kind] or rng.rand() < 0.6 else some("tests/data", "docs/example", "examples")
        return kind, around + lead + value + quote * (quote != "") + after, value, path

    return [one(kinds[k % len(kinds)]) for k in range(n)]


def labelled_findings(n: int = 3000, seed: int = 5, kinds=tuple(KINDS)) -> list[tuple[str, str, str, str | None, int]]:
    """Labelled findings (value, text before, text after, path, label) where no reviewed ones are at hand: every candidate of
    labelled_texts(), a secret if it lies within the text's secret value."""
    found = []
    for kind, text, value, path in labelled_texts(n, seed, kinds):
        raw = text.encode()
        at = raw.rfind(value.encode())
        _, starts, ends = candidates(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            inside = a < at + len(value.encode()) and b > at
            found.append((raw[a:b].decode(), raw[max(0, a - AROUND) : a].decode(errors="ignore"), raw[b : b + AROUND].decode(errors="ignore"), path, KINDS[kind] if inside else 0))
    return found


def findings_from(table: DataFrame) -> list[tuple[str, str, str, str | None, int]]:
    """Reviewed findings from a table (value string, before string, after string, path string, label int): the candidate, up
    to AROUND bytes on either side, the path of its file, and 1 for a secret or 0 for a false positive.  At most
    TRAIN_FINDINGS rows, the first by a hash of all columns; rows without a value or label teach nothing, and other nulls
    count as empty."""
    rows = table.where("value is not null and label in (0, 1)").select("value", "before", "after", "path", F.col("label").cast("int"))
    first = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(TRAIN_FINDINGS).collect()
    return [(r[0], r[1] or "", r[2] or "", r[3], r[4]) for r in first]


_forest: Forest | None = None


def default_forest() -> Forest:
    """The forest of labelled_findings(); the same in every process."""
    global _forest
    if _forest is None:
        _forest = Forest(labelled_findings())
    return _forest


def _found(texts: pa.Array, paths: list, forest: Forest) -> tuple[list[tuple[int, int, int]], np.ndarray, bytes]:
    """(value number, start byte, end byte) of each candidate of a batch, their probabilities, and the batch's bytes."""
    buf, off = textkit.flat_utf8(texts)
    doc, starts, ends = candidates(buf, off)
    data = buf.tobytes()
    found = []
    for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
        lo, hi = max(int(off[d]), a - AROUND), min(int(off[d + 1]), b + AROUND)
        found.append((data[a:b].decode(errors="ignore"), data[lo:a].decode(errors="ignore"), data[b:hi].decode(errors="ignore"), paths[d]))
    spans = [(d, a - int(off[d]), b - int(off[d])) for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    return spans, forest.predict(found), data


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start and length in code points, sha256 of the value, probability, is_secret.

    Null and empty texts have no candidates; a null path has no parts; null ids stay null; repeated rows repeat their
    candidates; very long texts are read whole, a candidate of any length counting as one; other columns are ignored.  A candidate that
    ends inside a character of several bytes does not occur, as only whole characters of one byte end one.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                spans, share, data = _found(part.column(1), part.column(2).to_pylist(), forest)
                if spans:
                    ids, texts = part.column(0).to_pylist(), part.column(1)
                    held = {d: texts[d].as_py().encode() for d in {s[0] for s in spans}}
                    rows = [(ids[d], len(held[d][:a].decode()), b - a, hashlib.sha256(held[d][a:b]).hexdigest(), float(p), bool(p >= threshold)) for (d, a, b), p in zip(spans, share, strict=True)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                    names = ["doc_id", "start", "length", "value_sha256", "probability", "is_secret"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long"), text_col, F.col(path_col).cast("string"))
    return rows.mapInArrow(textkit.releasing(run), "doc_id long, start long, length long, value_sha256 string, probability double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with every secret in text_col replaced by MARK; other columns and the order of columns stay.  Null stays null."""
    schema = StructType(docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = part.column(at)
                spans, share, _ = _found(texts, part.column(part.num_columns - 1).to_pylist(), forest)
                hits: dict[int, list] = {}
                for (d, a, b), p in zip(spans, share, strict=True):
                    if p >= threshold:
                        hits.setdefault(d, []).append((a, b))
                columns = list(part.columns)[:-1]
                if hits:
                    new = texts.to_pylist()
                    for d, cuts in hits.items():
                        raw = new[d].encode()
                        for a, b in reversed(cuts):
                            raw = raw[:a] + MARK.encode() + raw[b:]
                        new[d] = raw.decode()
                    columns[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("*", F.col(path_col).cast("string").alias(unused(docs.columns, "path"))).mapInArrow(textkit.releasing(run), schema)
