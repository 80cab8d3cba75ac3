"""Exact top-k by integer inner product with a three-phase uniform threshold.

The dimensions are cut into LISTS slices; a slice's inner product is an entry's local score in that slice's list, and an
entry's score is the sum over the lists.  Lists lie apart: a row of the stored lists holds one slice of a block of
candidates, and meets the same slice of a block of queries.

1. Every list sends each query's best GATHER local entries.  Those are resolved exactly, and the k-th best of them is a safe
   cutoff.
2. The cutoff goes out with the queries.  An entry whose sum reaches it has a local score of cutoff / LISTS or more in some
   list, so each list sends only such entries, in arrays a pair of blocks.
3. Where a pair of blocks meets again, the local scores that the sent entries still lack are computed; entries that reach
   the cutoff are resolved exactly from their vectors, and ranked.

Equal vectors are one candidate with its k + 1 smallest ids, which is all that ties to smaller ids can ask of them.  All
pairs of blocks are one join, dealt out by list and by groups of candidate blocks; the driver holds no queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.storage import Workspace

LISTS = 2
SCALE = 256
#: Local entries that a list sends for a query in phase one.
GATHER = 16
#: Candidates and queries of a block, and candidate blocks that are dealt to a task together.
CANDIDATES, QUERIES, TOGETHER = 2048, 512, 8
#: Rows of one Arrow batch where a row holds blocks: bounds what a worker holds.
BLOCK_ROWS = 16
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name, "10000")
    spark.conf.set(name, str(min(BLOCK_ROWS, int(old) if int(old) > 0 else BLOCK_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _quantised(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(vec, ids) of each partition: distinct vectors of whole numbers, each with its k + 1 smallest ids there."""

    def run(batches):
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = np.floor(SCALE * flat) + 0.0  # no negative zeros
            for n, vec_id in enumerate(batch.column(0).to_pylist()):
                v = np.zeros(dim, "<f8")
                own = flat[at[n] : at[n + 1]]
                v[: len(own)] = own
                ids.setdefault(v.tobytes(), []).append(vec_id)
            least = [sorted(set(x))[: k + 1] for x in ids.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["vec", "ids"])

    return rows.mapInArrow(run, "vec binary, ids array<long>")


def _lists(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """(block, list, ids, most, slices): rows (id, vec) in blocks of `size`, a row for each list; most: the greatest
    component of each whole vector."""
    cuts = [dim * b // LISTS for b in range(LISTS + 1)]

    def run(batches):
        ids, vectors, block = [], [], TaskContext.get().partitionId() << 32

        def record(ids, vectors):
            v = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), dim)
            key, most = np.array(ids, "<i8").tobytes(), np.abs(v).max(axis=1, initial=0).astype("<f8").tobytes()
            cells = ([block] * LISTS, list(range(LISTS)), [key] * LISTS, [most] * LISTS, [np.ascontiguousarray(v[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "list", "ids", "most", "slices"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield record(ids[:size], vectors[:size])
                ids, vectors, block = ids[size:], vectors[size:], block + 1
        if ids:
            yield record(ids, vectors)

    return rows.mapInArrow(run, "block long, list int, ids binary, most binary, slices binary")


class _Scale:
    """Local scores as doubles: exact where all sums are far below 2**53, else scaled to be finite and rounded."""

    def __init__(self, most: float, dim: int):
        self.exact = most * most * max(1, dim) < 2**50
        self.factor = 1.0 if most < 2.0**400 else 2.0 ** (400 - int(np.frexp(most)[1]))
        self.most, self.dim = most, dim

    def matrix(self, slices: bytes, held: int) -> np.ndarray:
        return np.frombuffer(slices, "<f8").reshape(held, -1) * self.factor

    def slack(self, most: bytes) -> np.ndarray:
        """Bound of the rounding of each query's scores and of its cutoff."""
        most = np.frombuffer(most, "<f8")
        return np.zeros(len(most)) if self.exact else (most * self.factor) * (self.most * self.factor) * max(1, self.dim) ** 2 * 2.0**-50


def _met(lists: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """Every block of candidates with every block of queries, list by list; a task has TOGETHER blocks of candidates."""
    left = lists.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    right = asked.withColumn("its_deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.join(right.hint("shuffle_hash"), (F.col("list") == F.col("its_list")) & (F.col("deal") == F.col("its_deal")))


def _gathered(met: DataFrame, scale: _Scale) -> DataFrame:
    """Phase one: (query_id, list, keys, locals) of each pair of blocks."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                which, keys, slices, its, asked = (batch.column(i)[n].as_py() for i in range(5))
                keys, its = np.frombuffer(keys, "<i8"), np.frombuffer(its, "<i8")
                scores = scale.matrix(asked, len(its)) @ scale.matrix(slices, len(keys)).T
                if len(keys) > GATHER:
                    top = np.argpartition(scores, len(keys) - GATHER, axis=1)[:, -GATHER:]
                else:
                    top = np.broadcast_to(np.arange(len(keys)), scores.shape)
                offsets = pa.array(np.arange(len(its) + 1, dtype=np.int32) * top.shape[1])
                best = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (keys[top], np.take_along_axis(scores, top, axis=1))]
                yield pa.RecordBatch.from_arrays([pa.array(its), pa.array(np.full(len(its), which, np.int32)), *best], names=["query_id", "list", "keys", "locals"])

    return met.select("list", "ids", "slices", "its_ids", "its_slices").mapInArrow(run, "query_id long, list int, keys array<long>, locals array<double>")


def _sufficient(met: DataFrame, scale: _Scale) -> DataFrame:
    """Phase two: (block, its_block, list, places, locals), an entry's place being query * candidates + candidate."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block, its_block, which, keys, slices, its, most, asked, cutoff = (batch.column(i)[n].as_py() for i in range(9))
                scores = scale.matrix(asked, len(its) // 8) @ scale.matrix(slices, len(keys) // 8).T
                at = np.flatnonzero((scores >= (np.frombuffer(cutoff, "<f8") / LISTS - scale.slack(most))[:, None]).ravel())
                if len(at):
                    cells = ([block], [its_block], [which], [at.astype("<i4").tobytes()], [scores.ravel()[at].astype("<f8").tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "its_block", "list", "places", "locals"])

    columns = ("block", "its_block", "list", "ids", "slices", "its_ids", "its_most", "its_slices", "cutoff")
    return met.select(*columns).mapInArrow(run, "block long, its_block long, list int, places binary, locals binary")


def _remaining(found: DataFrame, scale: _Scale) -> DataFrame:
    """Phase three: (query_id, key) of entries that reach the cutoff; found: a pair of blocks a row, with the places and
    locals that its lists sent, and the slices of all lists."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                keys, its, most, cutoff, sent, held, asked = (batch.column(i)[n].as_py() for i in range(7))
                keys, its, cutoff = np.frombuffer(keys, "<i8"), np.frombuffer(its, "<i8"), np.frombuffer(cutoff, "<f8")
                parts = {s["list"]: (np.frombuffer(s["places"], "<i4"), np.frombuffer(s["locals"], "<f8")) for s in sent}
                held, asked = ({x["list"]: scale.matrix(x["slices"], size) for x in side} for side, size in ((held, len(keys)), (asked, len(its))))
                slack = scale.slack(most)
                places = np.unique(np.concatenate([p for p, _ in parts.values()]))
                for k in range(0, len(places), 1 << 16):
                    at = places[k : k + (1 << 16)]
                    q, c, total = at // len(keys), at % len(keys), np.zeros(len(at))
                    for b in range(LISTS):
                        known, local = np.zeros(len(at), bool), np.zeros(len(at))
                        if b in parts:
                            lo, hi = np.searchsorted(parts[b][0], (at[0], at[-1] + 1))
                            there = np.searchsorted(at, parts[b][0][lo:hi])
                            known[there], local[there] = True, parts[b][1][lo:hi]
                        lacks = np.flatnonzero(~known)
                        local[lacks] = np.einsum("ij,ij->i", asked[b][q[lacks]], held[b][c[lacks]])
                        total += local
                    may = total >= cutoff[q] - LISTS * slack[q]
                    yield pa.RecordBatch.from_arrays([pa.array(its[q[may]]), pa.array(keys[c[may]])], names=["query_id", "key"])

    return found.select("ids", "its_ids", "its_most", "cutoff", "sent", "held", "asked").mapInArrow(run, "query_id long, key long")


def _resolved(pairs: DataFrame, classes: DataFrame, each: DataFrame, scale: _Scale, columns: list[str]) -> DataFrame:
    """(query_id, columns of classes, score): inner products from whole vectors, or the nearest number that 64 bits hold."""
    held = classes.select("vec", *[c for c in columns if c != "key"], F.col("key").alias("its_key"))
    asked = each.select(F.col("query_id").alias("its_query"), F.col("vec").alias("its_vec"))
    both = pairs.join(held, F.col("key") == F.col("its_key")).join(asked, F.col("query_id") == F.col("its_query"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<f8").reshape(part.num_rows, -1) for i in (0, 1))
                if scale.exact:
                    score = (a * b).sum(axis=1).astype(np.int64)
                else:
                    score = np.array([max(_LEAST, min(_MOST, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for u, v in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(score, pa.int64())], names=names)

    taken = both.select("vec", "its_vec", "query_id", *columns)
    schema = taken.drop("vec", "its_vec").schema.add("score", "long")
    names = schema.names
    return taken.mapInArrow(run, schema)


def _told(cutoffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(of, cutoff): the cutoffs of each block of queries, in the order of its ids."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[n].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[n].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids)], names=["at_block", "n", "id"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        cells = ([table.column("at_block")[0].as_py()], [table.column("cutoff").to_numpy().astype("<f8").tobytes()])
        return pa.table([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.binary()), strict=True)], names=["of", "cutoff"])

    places = blocks.where("its_list = 0").select("its_block", "its_ids").mapInArrow(run, "at_block long, n long, id long")
    joined = places.join(cutoffs, F.col("id") == F.col("query_id"), "left").select("at_block", "n", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    return joined.groupBy("at_block").applyInArrow(pack, "of long, cutoff binary")


def top_k(vectors: DataFrame, queries: DataFrame, space: Workspace, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of greatest inner product, ties to smaller ids.

    Components become floor(256 * x).  Rows whose id or vector is null, or whose vector holds a component that is null or
    whose 256-fold is not finite, take no part.  Scores beyond 64 bits become the nearest number within, and tie with others
    that do.  Shorter vectors are extended by zeros.  Repeated rows count once; candidates of the query's own id are left
    out; a query id with several vectors asks for the least of them.  A query with fewer candidates gets them all, one
    without any no row; no rows give no rows.  Other columns are ignored.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) != float("inf")))
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, asked = valid(vectors), valid(queries)
    facts = rows.union(asked).agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dim = facts[0]
    if dim is None:
        return nothing
    scale = _Scale((facts[1] or 0.0) * SCALE + 1, dim)
    merged = _quantised(rows, dim, k).groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = space.save(merged.select(F.monotonically_increasing_id().alias("key"), "vec", "ids"), "classes")
    each = _quantised(asked, dim, 1 << 62).select("vec", F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.min("vec").alias("vec"))
    each = space.save(each, "queries")
    lists = space.save(_lists(classes.select("key", "vec"), dim, CANDIDATES), "lists")
    blocks = space.save(_lists(each.select("query_id", "vec"), dim, QUERIES), "query-lists")
    blocks = blocks.select(*[F.col(c).alias(f"its_{c}") for c in ("block", "list", "ids", "most", "slices")])
    groups = max(1, -(-lists.where("list = 0").count() // TOGETHER))
    with _small_batches(spark):
        first = space.save(_gathered(_met(lists, blocks, groups), scale), "gathered")
    entry = first.select("query_id", "list", F.explode(F.arrays_zip("keys", "locals")).alias("e")).select("query_id", "list", F.col("e.keys").alias("key"), F.col("e.locals").alias("local"))
    place = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("local"), "key"))
    best = entry.withColumn("place", place).where(F.col("place") <= GATHER).select("query_id", "key").distinct()
    other = _resolved(best, classes, each, scale, ["key", "ids"]).where(~((F.size("ids") == 1) & (F.get("ids", F.lit(0)) == F.col("query_id"))))
    kth = other.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("n") == k)
    # with fewer entries, or where 64 bits don't hold the k-th score, all are wanted
    cutoffs = kth.where(F.abs(F.col("score").cast("double")) < 2.0**62).select("query_id", (F.col("score").cast("double") * scale.factor**2).alias("cutoff"))
    told = space.save(_told(cutoffs, blocks), "told")
    slices = lambda df, lead: df.groupBy(F.col(f"{lead}block").alias(f"of_{lead}block")).agg(F.collect_list(F.struct(F.col(f"{lead}list").alias("list"), F.col(f"{lead}slices").alias("slices"))).alias("all"), *[F.first(f"{lead}{c}").alias(f"{lead}{c}") for c in ("ids", "most")])
    with _small_batches(spark):
        found = space.save(_sufficient(_met(lists, blocks.join(told, F.col("its_block") == F.col("of")).drop("of"), groups), scale), "sufficient")
        sent = found.groupBy("block", "its_block").agg(F.collect_list(F.struct("list", "places", "locals")).alias("sent"))  # a row a list
        held = slices(lists, "").withColumnRenamed("all", "held").drop("most")
        asked_of = slices(blocks, "its_").withColumnRenamed("all", "asked").join(told, F.col("of_its_block") == F.col("of")).drop("of")
        paired = sent.join(held, F.col("block") == F.col("of_block")).join(asked_of, F.col("its_block") == F.col("of_its_block"))
        left = space.save(_remaining(paired, scale), "remaining")
    scored = _resolved(left, classes, each, scale, ["ids"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
