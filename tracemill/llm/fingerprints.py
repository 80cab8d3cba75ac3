"""Document fingerprints by winnowing, in DataFrame expressions alone.

Every run of GRAM words has a rolling hash (a cyclic polynomial over its words' 64-bit hashes), of every WINDOW successive
hashes the least is kept (of equal ones the rightmost), and its position with it.  Two texts that share a passage of
GRAM + WINDOW - 1 words share a kept hash, and the positions tell where.  As lambdas carry no state, each gram's hash is
written as the sum that the rolling update would reach.  The minimum of a window comes from doubling: minima of 2, then 4
hashes, and so on.  The windows compare the upper 31 bits of a hash with its place in one long, smaller for a smaller hash
and then for a later place; what is kept is the whole hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.expressions import let

GRAM = 3
WINDOW = 4
_PLACE = 1 << 32

#: Rows in one range of ids, about; at most MAX_RANGES ranges, beyond which ranges grow (and are sorted by spilling).
RANGE_ROWS = 512
MAX_RANGES = 1 << 16


def words(text: Column) -> Column:
    """Lower-cased words between white space; in texts that hold Han characters or kana, each of these is a word too."""
    low = F.lower(text)
    han = r"[぀-ヿ㐀-鿿]"
    return F.filter(F.when(low.rlike(han), F.split(low, rf"\s+|(?<={han})|(?={han})")).otherwise(F.split(low, r"\s+")), lambda w: w != "")


def rotated(x: Column, by: int) -> Column:
    return x if by % 64 == 0 else F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64))


def grams(h: Column, gram: int = GRAM) -> Column:
    """Rolling hash of every run of `gram` word hashes, or of all of them if there are fewer."""
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (gram - 1), F.least(F.size(h), F.lit(1))))

    def one(x: Column, i: Column) -> Column:
        total = rotated(x, gram - 1)
        for j in range(1, gram):
            total = total.bitwiseXOR(rotated(F.coalesce(F.get(h, i + j), F.lit(0)), gram - 1 - j))
        return total

    return F.transform(starts, one)


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept hashes as an array of (hash, place) in order of place; places count words from 0.  A text of fewer words is one
    gram, one without words has none."""

    def narrowed(m: Column) -> Column:
        """Least of each window, from windows half as wide."""
        width = 1
        while width < window:
            m = let(m, _wider(min(width, window - width)))
            width += min(width, window - width)
        return F.array_distinct(m)

    def least(m: Column) -> Column:
        """Up to one window's grams: the least alone, if there is any."""
        return F.when(F.size(m) <= window, F.filter(F.array(F.array_min(m)), lambda x: x.isNotNull())).otherwise(narrowed(m))

    def kept(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: F.shiftrightunsigned(x, 33) * _PLACE + (_PLACE - 1 - i))
        places = F.transform(let(packed, least), lambda v: (_PLACE - 1 - v.bitwiseAND(F.lit(_PLACE - 1))).cast("int"))
        return F.transform(places, lambda p: F.struct(F.get(g, p).alias("hash"), p.alias("place")))

    return let(let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: grams(h, gram)), kept)


def _wider(step: int):
    """A function of an array alone: the lesser of each element and the one `step` behind it."""
    return lambda m: F.transform(F.slice(m, F.lit(1), F.size(m) - step), lambda x, i: F.least(x, F.get(m, i + step)))


def hashes(kept: Column) -> Column:
    return F.transform(kept, lambda k: k["hash"])


def places(kept: Column) -> Column:
    return F.transform(kept, lambda k: k["place"])


def digest(kept: Column) -> Column:
    """The kept hashes in order of place, sixteen hexadecimal digits each."""
    return F.array_join(F.transform(kept, lambda k: F.lower(F.lpad(F.hex(k["hash"]), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 if both are empty."""
    a, b = hashes(a), hashes(b)
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("c"), F.size(F.array_union(a, b)).alias("u")), lambda s: F.when(s["u"] == 0, 1.0).otherwise(s["c"] / s["u"]))


def _ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that end ranges of about RANGE_ROWS rows each, ascending, the greatest id being the last: at most MAX_RANGES."""
    rows = docs.where(F.col(id_col).isNotNull()).agg(F.count("*").alias("n"), F.max(id_col).alias("top")).first()
    parts = min(MAX_RANGES, max(1, rows["n"] // RANGE_ROWS))
    if rows["n"] == 0:
        return []
    shares = [k / parts for k in range(1, parts)]
    found = docs.select(F.percentile_approx(id_col, shares, 4 * parts + 1000).alias("p")).first()["p"] if shares else []
    return sorted({*(found or []), rows["top"]})


def with_next(docs: DataFrame, id_col: str, carried: str, derived: dict[str, Column]) -> DataFrame:
    """docs with the derived columns, and next_<c> for the carried column and each derived one: its value in the next row by
    descending id, in the first row's after the last.  Ids are whole numbers.  Null ids come last; rows of equal id are
    ordered by the carried value; a single row follows itself.

    Rows are dealt into ranges of ids, in one shuffle, behind which the derived columns are computed.  A row that ends a
    range also goes to the range above it, as the row that follows that range's last, and the greatest id's row to the
    lowest range, so that each range is complete in itself.
    """
    ends = _ranges(docs, id_col)
    if not ends:
        first, wrap = F.lit(0), F.lit(False)
        copies = F.array(F.struct(F.lit(0).alias("range"), F.lit(0).alias("turn")), F.struct(F.lit(0).alias("range"), F.lit(2).alias("turn")))
    else:
        step = max(1, int(len(ends) ** 0.5))
        key = F.col(id_col)
        coarse, whole = (F.split(F.lit(",".join(map(str, some))), ",").cast("array<long>") for some in (ends[step - 1 :: step], ends))
        skip = F.size(F.filter(coarse, lambda e: e < key)) * step
        first = F.coalesce(skip + F.size(F.filter(F.slice(whole, skip + 1, F.lit(step)), lambda e: e < key)), F.lit(0))
        ends_range = F.coalesce(F.array_contains(whole, key), F.lit(False))
        wrap = F.coalesce(key == ends[-1], F.lit(False))
        copies = F.concat(
            F.array(F.struct(first.alias("range"), F.lit(0).alias("turn"))),
            F.when(ends_range & ~wrap, F.array(F.struct((first + 1).alias("range"), F.lit(1).alias("turn")))).otherwise(F.array().cast("array<struct<range:int,turn:int>>")),
            F.when(wrap, F.array(F.struct(F.lit(0).alias("range"), F.lit(2).alias("turn")))).otherwise(F.array().cast("array<struct<range:int,turn:int>>")),
        )
    dealt = docs.withColumn("_copy", F.explode(copies)).withColumns({"_range": F.col("_copy.range"), "_turn": F.col("_copy.turn")}).drop("_copy")
    dealt = dealt.repartition("_range").withColumns(derived)
    order = Window.partitionBy("_range").orderBy("_turn", F.col(id_col).desc_nulls_last(), carried)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in (carried, *derived)}).where("_turn = 0").drop("_range", "_turn")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, places, edited_places) of every
    row.

    The edited text is the text without its last floor(n_chars / 3) code points, followed by the first as many (or all)
    of the next document by descending id.  places are those of the fingerprint's hashes, in words from 0.  Null texts count
    as empty; an empty text has an empty fingerprint.  Null ids, repeated rows and rows of equal id: see with_next.  No rows
    give no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    chained = with_next(base, id_col, "text", {"kept": winnowed(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = chained.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    edited = edited.withColumn("edited_kept", winnowed(F.col("edited")))
    own, other = F.col("kept"), F.col("edited_kept")
    return edited.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(own).alias("fingerprint"), digest(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, F.col("next_kept")).alias("near_next"), places(own).alias("places"), places(other).alias("edited_places"),
    )
