"""Row-wise building blocks as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Columns of a frame


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*(c for c in wanted if c in have))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Provenance columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_missing(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Columns that a skipped step would have made, as typed nulls."""
    return df.withColumns({k: F.lit(None).cast(t) for k, t in schema.items() if k not in df.columns})


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


# Predicates


def all_of(parts: Sequence[Column | None]) -> Column:
    """Conjunction of optional predicates; without any, true."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def contains_ci(c: Column | str, text: str) -> Column:
    """Substring without regard to case; the empty text is in everything that is not null."""
    return F.contains(F.lower(col(c)), F.lit(text.lower()))


def matches_ci(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(f"(?i){pattern}")


# Numbers


def safe_ratio(n: Column | str, total: Column | str) -> Column:
    """n / total with a total of at least one."""
    return col(n) / F.greatest(F.lit(1), col(total))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Null stays null (greatest and least pass over nulls)."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def clip_or_zero(c: Column | str, low: float, high: float) -> Column:
    """Clipped; null counts as 0."""
    return F.when(col(c).isNull(), F.lit(0.0)).otherwise(clip(c, low, high))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """A composite whose missing parts count as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(k), F.lit(0.0)) * F.lit(float(w)) for k, w in weights.items()))


def band(c: Column | str, floors: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """Name of the first band, highest floor first, that the value reaches; null stays null."""
    out = F.lit(otherwise)
    for floor, name in sorted(floors):
        out = F.when(col(c) >= floor, F.lit(name)).otherwise(out)
    return F.when(col(c).isNotNull(), out)


def labels(cases: Sequence[tuple[Column, str | None]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(list(cases)):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def weak_label(positive: Column, negative: Column) -> Column:
    """1, 0 or -1 (undecided) of two conditions; both together are undecided."""
    return F.when(positive & ~negative, 1).when(negative & ~positive, 0).otherwise(-1)


def confident(label: Column | str, probability: Column | str, least: float, otherwise: str = "Unclassified") -> Column:
    """Reject option: the label only where its probability reaches the least."""
    return F.when(col(probability) >= least, col(label)).otherwise(F.lit(otherwise))


def normal_cdf(z: Column | str) -> Column:
    """Distribution function of the standard normal (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    x = F.abs(col(z))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(col(z) >= 0, 1 - tail).otherwise(tail)


def geometric_mean(*parts: Column) -> Column:
    return F.pow(reduce(lambda a, b: a * b, parts), F.lit(1.0 / len(parts)))


def saturating(c: Column | str, scale: float) -> Column:
    """0 at 0 and below, towards 1 with growing values."""
    return 1 - F.exp(-F.greatest(F.lit(0.0), col(c)) / scale)


def equivalent_diameter(area: Column | str) -> Column:
    return F.sqrt(4 * col(area) / F.pi())


def log_area(area: Column | str, offset: float = 1.0) -> Column:
    return F.log(col(area) + offset)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def colour_indices(r: Column | str, g: Column | str, b: Column | str) -> dict[str, Column]:
    """Textbook vegetation indices of one colour: excess green, VARI (clipped to -1..1), GLI, red/green, brightness, hue."""
    r, g, b = col(r).cast("double"), col(g).cast("double"), col(b).cast("double")
    total, high, low = r + g + b, F.greatest(r, g, b), F.least(r, g, b)
    safe = lambda n, d: F.when(d != 0, n / d)
    spread = high - low
    hue = F.when(spread == 0, 0.0).when(high == r, F.pmod((g - b) / spread, F.lit(6.0))).when(high == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4) * 60
    return {"exg": safe(2 * g - r - b, total), "vari": clip(safe(g - r, g + r - b), -1.0, 1.0), "gli": safe(2 * g - r - b, 2 * g + r + b), "rg_ratio": safe(r, g), "brightness": total / 3, "hue": hue}


def block_id(x: Column | str, y: Column | str, size: float) -> Column:
    """Square block of a point as a struct, so that no two blocks share a key."""
    return F.struct(F.floor(col(x) / size).alias("bx"), F.floor(col(y) / size).alias("by"))


# Text


def fmt_int(c: Column | str) -> Column:
    return F.coalesce(F.format_number(col(c).cast("double"), 0), F.lit("-"))


def fmt_fixed(c: Column | str, digits: int = 2, signed: bool = False) -> Column:
    return F.coalesce(F.format_string(f"%{'+' if signed else ''}.{digits}f", col(c).cast("double")), F.lit("-")) if digits >= 0 else fmt_int(c)


def fmt_percent(c: Column | str, digits: int = 1) -> Column:
    return F.when(col(c).isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", 100 * col(c).cast("double")))


def tidy(c: Column | str, suffix: str = "", length: int | None = None) -> Column:
    """Without the suffix, other characters than letters, digits and _ as one _, cut to a length."""
    out = F.regexp_replace(F.trim(F.regexp_replace(col(c), f"{suffix}$", "")), r"\W+", "_")
    return F.substring(out, 1, length) if length else out


def day_of(seconds: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), pattern)


def job_id(at: Column | str, random: Column | str | None = None) -> Column:
    """A job's name: its time to the second and six hexadecimal digits, random ones (a new draw each time the plan runs,
    so the result is to be stored) or those of a text."""
    digits = F.replace(F.uuid(), F.lit("-"), F.lit("")) if random is None else F.md5(col(random).cast("string"))
    return F.concat(F.date_format(col(at), "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(digits, 1, 6))


def log_fields(line: Column | str) -> dict[str, Column]:
    """Stage number, name and seconds of runner log lines such as '[2/7] align' and 'align done in 12.5 s'."""
    line = col(line)
    part = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return {"stage_no": part(r"^\[(\d+)/\d+\]", 1).cast("int"), "stage": F.coalesce(part(r"^\[\d+/\d+\] (\w+)", 1), part(r"^(\w+) done in", 1)), "seconds": part(r"done in ([\d.]+) s", 1).cast("double")}


def split_once(c: Column | str, mark: str) -> tuple[Column, Column]:
    """Before and after the first mark; null after it where there is none."""
    parts = F.split(col(c), mark, 2)
    return parts[0], F.get(parts, F.lit(1))


# Web tiles


def tile_resolution(zoom: Column | int) -> Column:
    """Metres for a pixel of 256-pixel Web Mercator tiles at the equator."""
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return F.lit(156543.03392804097) / F.pow(F.lit(2.0), zoom)


def mercator(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    half = 20037508.342789244
    return col(lon) / 180 * half, F.log(F.tan(F.pi() / 4 + F.radians(col(lat)) / 2)) / F.pi() * half


def unmercator(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Longitude and latitude of Web Mercator metres."""
    half = 20037508.342789244
    return col(x) / half * 180, F.degrees(2 * F.atan(F.exp(col(y) / half * F.pi())) - F.pi() / 2)


def tile_of(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the tile that holds Web Mercator metres."""
    half, n = 20037508.342789244, 1 << zoom
    return F.floor((x + half) / (2 * half) * n).cast("int"), F.floor((half - y) / (2 * half) * n).cast("int")


def pack_cell(x: Column | str, y: Column | str, bits: int = 3) -> dict[str, Column]:
    """File and place of a tile when 2**bits by 2**bits tiles share a file."""
    x, y, low = col(x), col(y), F.lit((1 << bits) - 1)
    return {"file_x": F.shiftright(x, bits), "file_y": F.shiftright(y, bits), "cell_x": x.bitwiseAND(low), "cell_y": y.bitwiseAND(low)}


def atlas_place(position: Column | str, per_atlas: int = 256, per_row: int = 16) -> dict[str, Column]:
    p = col(position)
    within = F.pmod(p, F.lit(per_atlas))
    return {"atlas": F.floor(p / per_atlas).cast("int"), "row": F.floor(within / per_row).cast("int"), "col": F.pmod(within, F.lit(per_row)).cast("int")}


def affine(a: float, b: float, c: float, d: float, e: float, f: float, column: Column | str, row: Column | str) -> tuple[Column, Column]:
    """Map coordinates of the centre of a pixel."""
    x, y = col(column) + 0.5, col(row) + 0.5
    return a * x + b * y + c, d * x + e * y + f


def affine_inverse(a: float, b: float, c: float, d: float, e: float, f: float, x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Column and row of the pixel that holds a map coordinate."""
    det = a * e - b * d
    dx, dy = col(x) - c, col(y) - f
    return F.floor((e * dx - b * dy) / det).cast("long"), F.floor((a * dy - d * dx) / det).cast("long")
