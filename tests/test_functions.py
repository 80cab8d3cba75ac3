import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars as S


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("t", "end"), [(2, 5_000_000), (4, 5_000_000), (5_000_000, 10_000_000), (0, 5_000_000)])
def test_granulate(spark, t, end):
    assert value(spark, S.granulate(F.lit(t).cast("bigint"))) == end


@pytest.mark.parametrize(
    ("ns", "text"),
    [(0, "0s"), (1_500_000, "1ms 500us"), (61_000_000_001, "1m 1s 1ns"), (2 * 31_557_600 * 10**9, "2years"), (86_400 * 10**9, "1day"), (2_630_016 * 10**9 + 3_600 * 10**9, "1month 1h")],
)
def test_human_duration(spark, ns, text):
    assert value(spark, S.human_duration(F.lit(ns).cast("bigint"))) == text


@pytest.mark.parametrize(("ns", "text"), [(1_500_000, "1.5ms"), (2_000_000_000, "2s"), (999, "999ns"), (1_020, "1.02µs"), (0, "0ns")])
def test_debug_duration(spark, ns, text):
    assert value(spark, S.debug_duration(F.lit(ns).cast("bigint"))) == text


def test_addresses(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")
    assert value(spark, S.format_addr(a)) == "[1, 2, 3]"
    assert value(spark, S.parent(a)) == [1, 2]
    assert value(spark, S.push(a, F.lit(4))) == [1, 2, 3, 4]
    assert value(spark, S.strict_prefixes(a)) == [[1], [1, 2]]
    assert value(spark, S.strict_prefixes(S.from_segments(F.lit(1)))) == []
    assert value(spark, S.parent(F.array().cast("array<bigint>"))) == []


def test_colours(spark):
    white, black = (F.struct(*[F.lit(v).alias(c) for c in "rgb"]) for v in (255, 0))
    assert value(spark, S.hex_color(white)) == "#FFFFFF" and value(spark, S.text_color(white)) == S.DARK_TEXT and value(spark, S.text_color(black)) == S.LIGHT_TEXT
    for name, anchors in S.PALETTES.items():
        assert value(spark, S.hex_color(S.palette_color(F.lit(0.0), name))) == anchors[0]
        assert value(spark, S.hex_color(S.palette_color(F.lit(1.0), name))) == anchors[-1]
    assert value(spark, S.heat_position(F.lit(4.0), F.lit(16.0), F.lit(1.0))) == 0.5
    assert value(spark, S.heat_position(F.lit(0.0), F.lit(16.0), F.lit(1.0))) == 0.0


def test_means_and_differences(spark):
    assert value(spark, S.mean_ns(F.lit(7).cast("bigint"), F.lit(2))) == 3
    assert value(spark, S.mean_ns(F.lit(7).cast("bigint"), F.lit(0))) == 0
    assert value(spark, S.saturating_sub(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))) == 0
    assert value(spark, S.from_seconds(F.lit(1.5))) == 1_500_000_000 and value(spark, S.from_seconds(F.lit(-1.0))) == 0
