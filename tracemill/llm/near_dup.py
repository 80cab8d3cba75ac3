"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Two small collections of SIDE sub-signatures are computed, each sub-signature the combination of ROWS minhashes.  Table
(i, j) is keyed by sub-signature i of the one with sub-signature j of the other, so SIDE * SIDE tables of 2 * ROWS
minhashes come from 2 * SIDE * ROWS minhashes, about the square root of what separate tables take.  Two sets of
similarity s share a table with probability (1 - (1 - s^ROWS)^SIDE)^2: 0.994 at 0.8, 0.999 at 0.85, 0.9999 at 0.9.

Documents with equal sets are one class from the start.  In a bucket, each class is first compared with one central
member; only classes that this leaves outside the central member's component are then compared with the bucket's
members of other components.  Bounds on full sets keep pairs that cannot reach the threshold from being made: set sizes,
shingles that no other candidate has, and counts of the others by CELLS residues, which two sets share at most cell by
cell.  All bounds are exact, nothing is capped, and only candidates' sets are gathered and shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import textkit
from tracemill.llm.graph import components
from tracemill.llm.storage import Workspace

ROWS = 3
SIDE = 8
CELLS = 64
_SEEDS = np.random.RandomState(7919).randint(0, 1 << 63, size=(2, 2 * SIDE * ROWS), dtype=np.int64).astype(np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The 2 * SIDE sub-signatures of each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k in range(2 * SIDE * ROWS):
        low = np.minimum.reduceat((flat ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), starts)
        out[:, k // ROWS] = textkit.mix64(out[:, k // ROWS] + low)
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, at = textkit.word_hashes(*textkit.flat_utf8(texts))
    return [textkit.shingles(words[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)]


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """id, mark, n_shingles, a 128-bit name of the set, and its sub-signatures."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = shingle_sets(part.column(1), width)
                full = [s for s in sets if len(s)]
                sub = iter(signatures(full)) if full else iter(())
                names, subs = [], []
                for s in sets:
                    if len(s):
                        high = int((textkit.mix64(s ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64))
                        names.append(int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + high.to_bytes(8, "big"))
                        subs.append(next(sub).astype(np.int64))
                    else:
                        names.append(None)
                        subs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(subs, pa.list_(pa.int64()))],
                    names=["id", "mark", "n", "name", "sub"],
                )

    return docs.mapInArrow(textkit.releasing(run), "id long, mark long, n long, name binary, sub array<long>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [s.astype(np.int64) for s in shingle_sets(part.column(1), width)]
                cells = [np.bincount(s % CELLS, minlength=CELLS).astype(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32()))], names=["id", "shingles", "cells"])

    return docs.mapInArrow(textkit.releasing(run), "id long, shingles array<long>, cells array<int>")


def mark(id_col: Column, text_col: Column) -> Column:
    """Tells a row's id and text from those of other rows; never null."""
    return F.xxhash64(id_col.cast("long"), text_col)


def near_duplicates(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) of every row of docs.

    Words are runs of bytes outside ASCII white space, A-Z lower-cased; a set holds the distinct runs of `width` words,
    or the whole sequence if there are fewer.  Sets link if 100 * intersection >= percent * union.  component_id is the
    smallest id reachable, kept whether it is the row's own; mark is mark() of the row.

    Null and empty texts, and texts without words, have the empty set and link with nothing.  Rows of one id but different
    texts are linked by their own texts each; repeated rows are returned as often as they occur.  Rows with a null id link
    like any other but never give a component its id unless all of its ids are null; then component_id is null, and kept
    are the rows of one of its texts.  An empty table gives no rows; other columns are ignored.
    """
    key_of = F.coalesce(F.col("id"), F.lit(0))
    text = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), mark(docs[id_col], docs[text_col]).alias("mark"))
    signed = space.save(_signed(text, width), "signed")
    # classes of equal sets, numbered; of each the row of the smallest id
    first = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    classes = signed.where("name is not null").groupBy("name").agg(F.min(first).alias("first"), F.min("n").alias("n"), F.min_by("sub", first).alias("sub"))
    classes = space.save(classes.select("name", F.monotonically_increasing_id().alias("rep"), "first.id", "first.mark", "n", "sub"), "classes")
    key = F.posexplode(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda j: F.xxhash64(F.get("sub", i), F.get("sub", j + SIDE), i, j))))
    ).alias("table", "key")
    keyed = classes.select(key, "rep")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select(F.col("key").alias("shared"))
    buckets = space.save(keyed.join(shared, keyed["key"] == shared["shared"], "left_semi"), "buckets")

    # full sets of the candidates, and how many of their shingles some other candidate has too
    candidates = classes.join(buckets.select(F.col("rep").alias("met")).distinct(), F.col("rep") == F.col("met"), "left_semi").select("rep", key_of.alias("row"), F.col("mark").alias("its"))
    source = text.select("text", key_of.alias("at"), "mark")
    chosen = source.join(candidates, (source["at"] == candidates["row"]) & (source["mark"] == candidates["its"])).dropDuplicates(["at", "mark"])
    sets = space.save(_full_sets(chosen.select("rep", "text"), width), "sets")
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    single = each.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("owners")).where("owners = 1")
    per_cell = single.groupBy("id", F.pmod("shingle", F.lit(CELLS)).alias("cell")).agg(F.count("*").cast("int").alias("n"))
    alone = per_cell.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("alone")).select(F.col("id").alias("lone"), "alone")
    size = sets.select("id", F.size("shingles").cast("long").alias("n"), "cells")
    shared_cells = F.transform("cells", lambda c, k: c - F.coalesce(F.try_element_at("alone", k.cast("bigint")), F.lit(0)))
    facts = size.join(alone, size["id"] == alone["lone"], "left").select(F.col("id").alias("fact"), "n", F.when(F.col("alone").isNull(), F.col("cells")).otherwise(shared_cells).alias("cells"))
    facts = facts.withColumn("most", F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c))
    # a partner holds `percent` of the union, which is no smaller than the set
    facts = facts.where(100 * F.col("most") >= percent * F.col("n"))
    subs = classes.select(F.col("rep").alias("of"), "sub")
    facts = space.save(facts.join(subs, facts["fact"] == subs["of"]).drop("of"), "facts")
    members = buckets.join(facts, buckets["rep"] == facts["fact"]).select("key", "table", "rep", "n", "most", "cells", "sub")
    members = space.save(members, "members")
    space.remove("buckets")

    def reachable(a: str, b: str) -> Column:
        """Whether sizes and shared shingles of the two sets leave the threshold within reach."""
        both = F.col(f"{a}.n") + F.col(f"{b}.n")
        quick = F.least(F.col(f"{a}.most"), F.col(f"{b}.most"))
        close = F.aggregate(F.zip_with(f"{a}.cells", f"{b}.cells", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, c: s + c)
        return (100 * quick >= percent * (both - quick)) & (100 * close >= percent * (both - close))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = sets.select(F.col("id").alias("left_id"), F.col("shingles").alias("left"))
        right = sets.select(F.col("id").alias("right_id"), F.col("shingles").alias("right"))
        both = pairs.join(left, pairs["a"] == left["left_id"]).join(right, F.col("b") == right["right_id"])
        common = F.size(F.array_intersect("left", "right"))
        counted = both.select("a", "b", common.alias("common"), (F.size("left") + F.size("right")).alias("sum"))
        return space.save(counted.where(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b"), name)

    # every member with the member most of whose shingles others have
    pivot = members.groupBy("key").agg(F.max_by(F.struct("rep", "n", "most", "cells"), F.struct(F.col("most") / F.col("n"), -F.col("rep"))).alias("p"))
    pivot = space.save(pivot.select(F.col("key").alias("at"), "p.rep", "p.n", "p.most", "p.cells"), "pivots")
    m, p = members.alias("m"), pivot.alias("p")
    star = m.join(p, (F.col("m.key") == F.col("p.at")) & (F.col("m.rep") != F.col("p.rep")) & reachable("m", "p"))
    links = confirmed(star.select(F.col("m.rep").alias("a"), F.col("p.rep").alias("b")), "star")
    label = components(links, space, "first")

    # members outside their pivot's component, with members of other components; two that share several tables meet in
    # the first table alone
    tagged = members.join(label, members["rep"] == label["node"], "left").select("key", "table", "rep", "n", "most", "cells", "sub", F.coalesce("label", "rep").alias("label"))
    tagged = space.save(tagged, "tagged")
    centre = pivot.join(label, pivot["rep"] == label["node"], "left").select("at", F.coalesce("label", "rep").alias("centre"))
    outside = tagged.join(centre, (tagged["key"] == centre["at"]) & (tagged["label"] != centre["centre"])).select("key", "table", "rep", "n", "most", "cells", "sub", "label", "centre")
    o, t = outside.alias("o"), tagged.alias("t")
    once = (F.col("t.label") == F.col("o.centre")) | (F.col("o.rep") < F.col("t.rep"))
    before = F.exists(
        F.sequence(F.lit(0), F.lit(SIDE - 1)),
        lambda k: ((k < F.floor(F.col("o.table") / SIDE)) & (F.get("o.sub", k) == F.get("t.sub", k)))
        | ((k < F.col("o.table") % SIDE) & (F.get("o.sub", k + SIDE) == F.get("t.sub", k + SIDE))),
    )
    rest = o.join(t, (F.col("o.key") == F.col("t.key")) & (F.col("o.label") != F.col("t.label")) & once & reachable("o", "t") & ~before)
    more = confirmed(rest.select(F.col("o.rep").alias("a"), F.col("t.rep").alias("b")), "rest")
    label = components(links.union(more), space, "final")

    # a component's smallest id, and the text that stands for it if it has none
    named = label.join(classes.select("rep", "id", "mark"), F.col("node") == F.col("rep")).groupBy(F.col("label").alias("of")).agg(F.min("id").alias("component"), F.min("mark").alias("lead"))
    linked = label.join(named, F.col("label") == F.col("of")).select("node", "component", "lead")
    alone = F.col("node").isNull()
    group = classes.join(linked, F.col("rep") == F.col("node"), "left").select(
        F.col("name").alias("set_name"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(alone, F.col("mark")).otherwise(F.col("lead")).alias("lead")
    )
    own = signed.select("id", "mark", "n", "name")
    found = own.join(group, own["name"] == group["set_name"], "left")
    component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component"))
    kept = F.when(F.col("name").isNull(), F.lit(True)).when(F.col("component").isNotNull(), F.col("id").eqNullSafe(F.col("component"))).otherwise(F.col("mark") == F.col("lead"))
    return found.select(F.col("id").alias("doc_id"), "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
