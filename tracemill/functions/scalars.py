"""Scalar functions as column expressions: addresses, durations, times and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Result granularity and the margin within which events collapse, in nanoseconds.
GRANULARITY_NS = 5_000_000
EVENT_MARGIN_NS = 500_000


# -- addresses ---------------------------------------------------------------------------------------------------------
def push(addr: Column, segment: Column) -> Column:
    return F.concat(addr, F.array(segment.cast("bigint")))


def parent(addr: Column) -> Column:
    """The address without its last segment; an empty address stays empty."""
    return F.slice(addr, F.lit(1), F.greatest(F.size(addr) - 1, F.lit(0)))


def last_segment(addr: Column) -> Column:
    return F.try_element_at(addr, F.lit(-1))


def is_top_level(addr: Column) -> Column:
    return F.size(addr) == 1


def from_segments(*segments: Column) -> Column:
    return F.array(*[s.cast("bigint") for s in segments])


def extend(addr: Column, more: Column) -> Column:
    return F.concat(addr, more)


def strict_prefixes(addr: Column) -> Column:
    """All non-empty proper prefixes, shortest first."""
    return F.when(F.size(addr) > 1, F.transform(F.sequence(F.lit(1), F.size(addr) - 1), lambda i: F.slice(addr, F.lit(1), i))).otherwise(F.array().cast("array<array<bigint>>"))


def format_addr(addr: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(addr, lambda x: x.cast("string")), ", "), F.lit("]"))


def escape_label(text: Column) -> Column:
    """Backslashes doubled, for labels of graph nodes."""
    return F.regexp_replace(text, r"\\", r"\\\\")


def source_name(prefix: str, worker: Column, replay: bool = False, extension: str = "frames") -> Column:
    """Name of a worker's log file."""
    return F.concat(F.lit(f"{prefix}.{'replay-' if replay else ''}worker-"), worker.cast("string"), F.lit(f".{extension}"))


def has_prefix(path: Column, prefix: str, extension: str = "frames") -> Column:
    """Whether a path's file name has the prefix as its first dot segment and the log extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return (F.element_at(F.split(name, r"\."), 1) == prefix) & name.endswith(f".{extension}")


# -- times -------------------------------------------------------------------------------------------------------------
def granulate(t_ns: Column, step: int = GRANULARITY_NS) -> Column:
    """The end of the bucket that holds a time: an exact multiple belongs to the next bucket."""
    return t_ns - F.pmod(t_ns, F.lit(step)) + F.lit(step)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), a - b)


def mean_ns(total: Column, count: Column) -> Column:
    """Whole nanoseconds, rounded down; 0 if nothing was counted."""
    return F.when(count == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", total, count))


#: Seconds in a year of 365.25 days, a month of 30.44 days, a day, an hour and a minute.
_UNITS = (("year", 31_557_600, True), ("month", 2_630_016, True), ("day", 86_400, True), ("h", 3_600, False), ("m", 60, False), ("s", 1, False))


def human_duration(ns: Column, micro: str = "us") -> Column:
    """A duration in words: `1day 2h 3m 4s 5ms`; zero is `0s`.  Years, months and days take an s beyond one."""
    rest, parts = _div(ns, 1_000_000_000), []
    for name, size, plural in _UNITS:
        value = _div(rest, size)
        suffix = F.when(value > 1, name + "s").otherwise(name) if plural else F.lit(name)
        parts.append(F.when(value > 0, F.concat(value.cast("string"), suffix)))
        rest = F.pmod(rest, F.lit(size))
    nanos = F.pmod(ns, F.lit(1_000_000_000))
    for name, size in (("ms", 1_000_000), (micro, 1_000), ("ns", 1)):
        value = F.pmod(_div(nanos, size), F.lit(1_000))
        parts.append(F.when(value > 0, F.concat(value.cast("string"), F.lit(name))))
    return F.when(ns == 0, "0s").otherwise(F.concat_ws(" ", *parts))


def debug_duration(ns: Column) -> Column:
    """A duration in its largest unit among s, ms, µs and ns, without trailing zeros: `1.5ms`."""

    def unit(size: int, name: str) -> Column:
        whole = _div(ns, size).cast("string")
        digits = len(str(size)) - 1
        part = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(size)).cast("string"), digits, "0"), "0+$", "") if digits else F.lit("")
        return F.concat(whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)), F.lit(name))

    return F.when(ns >= 1_000_000_000, unit(1_000_000_000, "s")).when(ns >= 1_000_000, unit(1_000_000, "ms")).when(ns >= 1_000, unit(1_000, "µs")).otherwise(unit(1, "ns"))


def seconds(ns: Column) -> Column:
    return ns / 1e9


def from_seconds(s: Column) -> Column:
    """Nanoseconds of a number of seconds; negative, infinite and missing numbers give 0."""
    fine = s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s < F.lit(float("inf")))
    return F.when(fine, (s * 1e9).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


# -- bitemporal times: (system_ns, data_ns) in product order ------------------------------------------------------------
def epoch(system_ns: Column, data_ns: Column) -> Column:
    return F.struct(system_ns.alias("system_ns"), data_ns.alias("data_ns"))


def epoch_join(a: Column, b: Column) -> Column:
    return epoch(F.greatest(a["system_ns"], b["system_ns"]), F.greatest(a["data_ns"], b["data_ns"]))


def epoch_meet(a: Column, b: Column) -> Column:
    return epoch(F.least(a["system_ns"], b["system_ns"]), F.least(a["data_ns"], b["data_ns"]))


def epoch_less_equal(a: Column, b: Column) -> Column:
    return (a["system_ns"] <= b["system_ns"]) & (a["data_ns"] <= b["data_ns"])


# -- colours -----------------------------------------------------------------------------------------------------------
#: Weights of red, green and blue in relative luminance, and the luminance from which text is dark.
LUMINANCE = (0.2126, 0.7152, 0.0722)
LUMINANCE_THRESHOLD = 0.5
DARK_TEXT, LIGHT_TEXT = "#0E1111", "#EEEEEE"

#: Anchor colours of the palettes, from low to high; colours between them are interpolated.
PALETTES = {
    "turbo": ("#30123B", "#4145AB", "#4675ED", "#39A2FC", "#1BCFD4", "#24ECA6", "#61FC6C", "#A4FC3B", "#D1E834", "#F3C63A", "#FE9B2D", "#F36315", "#D93806", "#B11901", "#7A0402"),
    "viridis": ("#440154", "#482878", "#3E4989", "#31688E", "#26828E", "#1F9E89", "#35B779", "#6DCD59", "#B4DE2C", "#FDE725"),
    "inferno": ("#000004", "#1B0C41", "#4A0C6B", "#781C6D", "#A52C60", "#CF4446", "#ED6925", "#FB9B06", "#F7D13D", "#FCFFA4"),
    "magma": ("#000004", "#180F3D", "#440F76", "#721F81", "#9E2F7F", "#CD4071", "#F1605D", "#FD9668", "#FECA8D", "#FCFDBF"),
    "plasma": ("#0D0887", "#47039F", "#7301A8", "#9C179E", "#BD3786", "#D8576B", "#ED7953", "#FA9E3B", "#FDC926", "#F0F921"),
    "cividis": ("#002051", "#0A326A", "#2B446E", "#4D566D", "#696970", "#7F7C75", "#948F78", "#ADA476", "#CABA6A", "#FDEA45"),
    "warm": ("#6E40AA", "#BF3CAF", "#FE4B83", "#FF7847", "#E2B72F", "#AFF05B"),
    "cool": ("#6E40AA", "#4C6EDB", "#23ABD8", "#1DDFA3", "#52F667", "#AFF05B"),
    "cubehelix": ("#000000", "#1A1530", "#163D4E", "#1F6642", "#54792F", "#A07949", "#D07E93", "#CF9CDA", "#C1CAF3", "#D2EEEF", "#FFFFFF"),
    "blue-green": ("#F7FCFD", "#CCECE6", "#66C2A4", "#238B45", "#00441B"),
    "blue-purple": ("#F7FCFD", "#BFD3E6", "#8C96C6", "#88419D", "#4D004B"),
    "green-blue": ("#F7FCF0", "#CCEBC5", "#7BCCC4", "#2B8CBE", "#084081"),
    "orange-red": ("#FFF7EC", "#FDD49E", "#FC8D59", "#D7301F", "#7F0000"),
    "purple-blue-green": ("#FFF7FB", "#D0D1E6", "#67A9CF", "#02818A", "#014636"),
    "purple-blue": ("#FFF7FB", "#D0D1E6", "#74A9CF", "#0570B0", "#023858"),
    "purple-red": ("#F7F4F9", "#D4B9DA", "#DF65B0", "#CE1256", "#67001F"),
    "red-purple": ("#FFF7F3", "#FCC5C0", "#F768A1", "#AE017E", "#49006A"),
    "yellow-green-blue": ("#FFFFD9", "#C7E9B4", "#41B6C4", "#225EA8", "#081D58"),
    "yellow-green": ("#FFFFE5", "#D9F0A3", "#78C679", "#238443", "#004529"),
    "yellow-orange-brown": ("#FFFFE5", "#FEE391", "#FE9929", "#CC4C02", "#662506"),
    "yellow-orange-red": ("#FFFFCC", "#FED976", "#FD8D3C", "#E31A1C", "#800026"),
}


def heat_position(value: Column, high: Column, low: Column) -> Column:
    """log2 position of a duration between bounds; 0 where the bounds are equal or a value is not positive."""
    fine = (value > 0) & (high > 0) & (low > 0) & (high != low)
    return F.when(fine, (F.log2(value) - F.log2(low)) / (F.log2(high) - F.log2(low))).otherwise(F.lit(0.0))


def palette_color(position: Column, palette: str = "inferno") -> Column:
    """(r, g, b) of a position in [0, 1], interpolated between the palette's anchors."""
    anchors = PALETTES[palette.lower()]
    points = F.array(*[F.array(*[F.lit(int(a[k : k + 2], 16)) for k in (1, 3, 5)]) for a in anchors])
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)) * (len(anchors) - 1)
    at = F.least(F.floor(x).cast("int"), F.lit(len(anchors) - 2))
    low, high, part = F.get(points, at), F.get(points, at + 1), x - at
    return F.struct(*[F.round(F.get(low, F.lit(k)) + (F.get(high, F.lit(k)) - F.get(low, F.lit(k))) * part).cast("int").alias(c) for k, c in enumerate("rgb")])


def hex_color(rgb: Column) -> Column:
    return F.format_string("#%02X%02X%02X", rgb["r"], rgb["g"], rgb["b"])


def luminance(rgb: Column) -> Column:
    return reduce(lambda a, b: a + b, [w * (rgb[c] / 255.0) for w, c in zip(LUMINANCE, "rgb", strict=True)])


def text_color(rgb: Column) -> Column:
    return F.when(luminance(rgb) >= LUMINANCE_THRESHOLD, DARK_TEXT).otherwise(LIGHT_TEXT)


# -- keys --------------------------------------------------------------------------------------------------------------
def distinguishing_key(worker: Column, kind: Column, ref_id: Column) -> Column:
    """Routing key of events that belong together."""
    return F.xxhash64(worker, kind, ref_id)


def signed_id(unsigned: Column) -> Column:
    """A 64-bit unsigned number (DECIMAL(20, 0), or text) as the BIGINT of the same bits: ids from 2**63 on become negative,
    one to one.  All keys of the engine are such BIGINTs."""
    wide = unsigned.cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("bigint")


def unsigned_id(signed: Column) -> Column:
    """The unsigned number of a BIGINT's bits, as DECIMAL(20, 0)."""
    wide = signed.cast("decimal(20,0)")
    return F.when(signed < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def uniform(seed: Column, low: Column, high: Column) -> Column:
    """A whole number in [low, high) drawn from a seed: equal seeds draw equal numbers, wherever they run."""
    return low + F.pmod(F.xxhash64(seed), high - low)
