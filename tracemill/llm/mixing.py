"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions alone.

Tokens are summed per cell of source, language and topic.  Each fitting step scales every cell's rate so that one
margin's expected tokens meet their targets, a rate staying at most 1; steps go round the margins until a round moves no
rate by more than TOLERANCE.  The fitted rate of a document's cell is its probability of being sampled.  Cells are
pre-aggregated before any shuffle, so a source that holds most rows is a few small rows here; up to SMALL_CELLS of them are
fitted in one task, more in a shuffle a margin.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.expressions import let, unused
from tracemill.llm.storage import Workspace

MARGINS = ("source", "lang", "topic")
#: Rounds end when no rate moves by more in one, at the latest after so many; STORED rounds make one stored table.
TOLERANCE = 1e-9
MOST_ROUNDS = 120
STORED = 6
#: Cells that are fitted in one task, and broadcast to the documents, at most; beyond, both are joins by a shuffle.
SMALL_CELLS = 100_000
#: Cells whose rounds are one expression on one row, at most: its time grows with cells times margin values.
ROW_CELLS = 2000


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != "")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from the text itself."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(F.lower(t).contains("licen"), "legal").when(t.contains("@"), "contact").otherwise("prose")


def margin(column: Column) -> Column:
    """A margin's value; null is a value of its own."""
    return F.coalesce(column.cast("string"), F.lit("(null)"))


def uniform(identity: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """Targets of a margin (value, share): natural token shares to a power, in proportion."""
    own = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).select("value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("t"))
    return own.select("value", (F.col("t") / F.lit(own.agg(F.sum("t")).first()[0] or 1.0)).alias("share"))


def fit(cells: DataFrame, targets: Mapping[str, DataFrame], share: float, space: Workspace) -> DataFrame:
    """cells (margins, tokens) with rate, the calibrated probability of each cell, and want_<m> for each margin m, the tokens
    that its value should have.

    Margin m's expected tokens approach share * all tokens * targets[m] (value, share); a margin value without a target has
    none.  Rates that would pass 1 stay at 1, so a target beyond what there is is met as far as possible; misses() tells by
    how much.
    """
    facts = cells.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    budget = (facts["t"] or 0) * float(share)
    fitted = cells.withColumn("rate", F.lit(float(share)))
    for m, target in targets.items():
        want = target.select(F.col("value").alias("_value"), (F.col("share") * F.lit(budget)).alias(f"want_{m}"))
        fitted = fitted.join(want, F.col(m) == F.col("_value"), "left").drop("_value")
    if facts["n"] <= ROW_CELLS:
        return space.save(_fitted_in_a_row(fitted, list(targets)), "rates")
    for k in range(0, MOST_ROUNDS, STORED):
        # a single partition meets every window's needs without a shuffle
        fitted = fitted.coalesce(1) if facts["n"] <= SMALL_CELLS else fitted
        for n in range(STORED):
            fitted = fitted.withColumn("before", F.col("rate")) if n + 1 == STORED else fitted
            for m in targets:
                have = F.sum(F.col("tokens") * F.col("rate")).over(Window.partitionBy(m))
                scale = F.when(have > 0, F.coalesce(f"want_{m}", F.lit(0.0)) / have).otherwise(1.0)
                fitted = fitted.withColumn("rate", F.least(F.lit(1.0), F.col("rate") * scale))
        fitted = space.save(fitted, f"rates-{k}")
        moved = fitted.agg(F.max(F.abs(F.col("rate") - F.col("before")))).first()[0]
        if k:
            space.remove(f"rates-{k - STORED}")
        fitted = fitted.drop("before")
        if moved is None or moved <= TOLERANCE:
            break
    return fitted


def _fitted_in_a_row(cells: DataFrame, margins: list[str]) -> DataFrame:
    """All rounds over a few cells as one expression on one row of arrays."""
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*margins, "tokens", *[f"want_{m}" for m in margins], "rate"))).alias("cells"))
    one = one.withColumns({"tokens": F.transform("cells", lambda c: c["tokens"].cast("double")), "start": F.transform("cells", lambda c: c["rate"])})

    def placed(df: DataFrame, m: str) -> DataFrame:
        """Each cell's place among the margin's values, and what these want."""
        values = F.array_distinct(F.transform("cells", lambda c: F.struct(c[m].alias("value"), F.coalesce(c[f"want_{m}"], F.lit(0.0)).alias("want"))))
        df = df.withColumn("values", values).withColumn("names", F.transform("values", lambda v: v["value"]))
        at = F.transform("cells", lambda c: (F.array_position("names", c[m]) - 1).cast("int"))
        return df.withColumns({f"at_{m}": at, f"wants_{m}": F.transform("values", lambda v: v["want"])}).drop("values", "names")

    for m in margins:
        one = placed(one, m)

    def stepped(rates: Column, m: str) -> Column:
        def scaled(products: Column) -> Column:
            def have(v: Column) -> Column:
                return F.aggregate(F.zip_with(f"at_{m}", products, lambda i, x: F.when(i == v, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

            scales = F.transform(f"wants_{m}", lambda w, v: let(have(v), lambda h: F.when(h > 0, w / h).otherwise(1.0)))
            return let(scales, lambda by: F.zip_with(rates, f"at_{m}", lambda r, i: F.least(F.lit(1.0), r * F.get(by, i))))

        return let(F.zip_with("tokens", rates, lambda t, r: t * r), scaled)

    def round_of(rates: Column, left: list[str]) -> Column:
        return let(stepped(rates, left[0]), lambda new: round_of(new, left[1:])) if left else rates

    def advanced(state: Column, _: Column) -> Column:
        def measured(new: Column) -> Column:
            moved = F.aggregate(F.zip_with(new, state["rates"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
            return F.struct(new.alias("rates"), moved.alias("moved"))

        return F.when(state["moved"] <= TOLERANCE, state).otherwise(let(round_of(state["rates"], margins), measured))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_ROUNDS)), F.struct(F.col("start").alias("rates"), F.lit(1.0).alias("moved")), advanced)
    each = one.select(F.explode(F.arrays_zip("cells", done["rates"].alias("rates"))).alias("e"))
    return each.select(*[F.col(f"e.cells.{c}") for c in (*margins, "tokens")], F.col("e.rates").alias("rate"), *[F.col(f"e.cells.want_{m}") for m in margins])


def misses(fitted: DataFrame, margins=MARGINS) -> DataFrame:
    """(margin, value, want, expected) of a fit: wanted tokens, and those to expect at its rates."""
    found = None
    for m in margins:
        own = fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.coalesce(F.max(f"want_{m}"), F.lit(0.0)).alias("want"), F.sum(F.col("tokens") * F.col("rate")).alias("expected"))
        found = own if found is None else found.union(own)
    return found


def sample(
    docs: DataFrame, space: Workspace, share: float = 0.5, power: float = 0.7, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", prefix: str = "",
) -> DataFrame:
    """All rows and columns of docs with topic, tokens, rate and sampled, each behind the prefix.

    targets names the shares (value, share) that margins should have of the tokens; margins it lacks get their natural
    shares to `power`.  sampled holds where a number drawn from the id lies below the rate, so it does not depend on order
    or partitions, and repeated rows are sampled alike.  Null sources and languages are margin values of their own; null and
    empty texts hold no tokens, and cells without tokens keep the rate `share` unless their margins ask for less.  No rows
    give no rows.  Columns of docs with the names above are replaced; others may have any names.
    """
    docs = docs.drop(*[f"{prefix}{c}" for c in ("topic", "tokens", "rate", "sampled")])
    own = unused(docs.columns, "mixing")
    facts = {"source": margin(F.col(source_col)), "lang": margin(F.col(lang_col)), "topic": topic(F.col(text_col)), "tokens": tokens(F.col(text_col))}
    tagged = docs.withColumn(own, F.struct(*[c.alias(n) for n, c in facts.items()]))
    cells = space.save(tagged.groupBy(*[F.col(f"{own}.{m}").alias(m) for m in MARGINS]).agg(F.sum(f"{own}.tokens").alias("tokens")), "cells")
    wanted = {m: targets[m] if targets and m in targets else tempered(cells, m, power) for m in MARGINS}
    rates = fit(cells, wanted, share, space)
    names = {m: unused(docs.columns, f"mixing_{m}") for m in (*MARGINS, "rate")}
    rates = rates.select(*[F.col(m).alias(n) for m, n in names.items()])
    if rates.count() <= SMALL_CELLS:
        rates = F.broadcast(rates)
    on = [F.col(f"{own}.{m}") == F.col(names[m]) for m in MARGINS]
    rate = F.col(names["rate"])
    added = {"topic": F.col(f"{own}.topic"), "tokens": F.col(f"{own}.tokens"), "rate": rate, "sampled": uniform(F.col(id_col)) < rate}
    return tagged.join(rates, on).select(*docs.columns, *[value.alias(f"{prefix}{name}") for name, value in added.items()])
