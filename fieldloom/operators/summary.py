"""One nested document of headline figures: sections of aggregates, counts by class and exact ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.aggregates import quantiles

OTHER = "other"


def nested(df: DataFrame, figures: Mapping[str, Mapping[str, Column]], classes: Mapping[str, tuple[str, Sequence[str]]] | None = None, ranks: Mapping[str, tuple[str, Mapping[str, float]]] | None = None) -> DataFrame:
    """One row with a struct for each section.

    figures: section -> name -> aggregate. classes: section -> (column, values): rows of each value, and of all others,
    nulls included, as `other`. ranks: section -> (column, name -> share of the values below). Figures and classes
    take one pass over the table, each column of ranks takes its own (exact, whatever its size). A section that is in
    several of the three has the names of all. An empty table has counts of zero and nulls.
    """
    parts: dict[str, dict[str, Column]] = {}
    for section, named in figures.items():
        parts.setdefault(section, {}).update(named)
    for section, (column, values) in (classes or {}).items():
        v = F.col(column).cast("string")
        own = {str(x): F.count_if(v == F.lit(str(x))) for x in values}
        own[OTHER] = F.count_if(~F.coalesce(v.isin([str(x) for x in values]), F.lit(False)))
        parts.setdefault(section, {}).update(own)
    flat = [(section, name, made) for section, named in parts.items() for name, made in named.items()]
    one = df.agg(F.lit(1).alias("__one"), *(made.alias(f"__f{k}") for k, (_, _, made) in enumerate(flat)))
    places: dict[str, list[tuple[str, Column]]] = {}
    for k, (section, name, _) in enumerate(flat):
        places.setdefault(section, []).append((name, F.col(f"__f{k}")))
    for k, (section, (column, named)) in enumerate((ranks or {}).items()):
        got = quantiles(df.select(F.col(column).alias("__v")), "__v", list(named.values())).select(F.col("q").alias(f"__q{k}"))
        # A row of figures at most on either side.
        one = one.join(F.broadcast(got), F.lit(True), "left")
        places.setdefault(section, []).extend((name, F.get(f"__q{k}", F.lit(i))) for i, name in enumerate(named))
    return one.select(*(F.struct(*(c.alias(name) for name, c in named)).alias(section) for section, named in places.items()))


def flattened(document: DataFrame) -> DataFrame:
    """(section, name, value) of a nested document, values as doubles."""
    rows = [F.struct(F.lit(s.name).alias("section"), F.lit(f.name).alias("name"), F.col(s.name)[f.name].cast("double").alias("value")) for s in document.schema for f in s.dataType]
    return document.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
