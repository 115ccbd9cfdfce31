"""Readers and writers of survey folders: discovery, GeoJSON, JSON documents, CSV, optional members, caches."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.functions.scalar import finite, unmercator


def discover(spark: SparkSession, folder: str, patterns: Mapping[str, str]) -> dict[str, str]:
    """The one file under the folder whose name matches each pattern (case-insensitive), or ValueError."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    found = {}
    for name, pattern in patterns.items():
        own = names.where(F.regexp_extract("path", "[^/]*$", 0).rlike(f"(?i){pattern}")).orderBy("path").limit(2).collect()
        if len(own) != 1:
            raise ValueError(f"{'several files' if own else 'no file'} for {name} instead of one")
        found[name] = own[0].path
    return found


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one with the schema where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature: the properties (a DDL schema), geometry type, and coordinates as JSON text."""
    kind = StructType.fromDDL(f"features array<struct<properties: struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in properties.split(','))}>, geometry: struct<type: string, coordinates: string>>>")
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def point_of(coordinates: str = "coordinates") -> tuple[Column, Column]:
    p = F.from_json(coordinates, "array<double>")
    return F.get(p, F.lit(0)), F.get(p, F.lit(1))


def ring_of(coordinates: str = "coordinates") -> Column:
    """Outer ring of a polygon as array<struct<x, y>>."""
    outer = F.get(F.from_json(coordinates, "array<array<array<double>>>"), F.lit(0))
    return F.transform(outer, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def point_features(df: DataFrame, x: str, y: str, fields: Sequence[str], digits: int = 7, decimals: Mapping[str, int] | None = None) -> DataFrame:
    """GeoJSON features as text lines (value): fields that exist, in their order, rounded, non-finite numbers as null."""
    kinds = dict(df.dtypes)
    have = [f for f in fields if f in kinds]
    decimals = decimals or {}
    clean = [(F.round(finite(f), decimals.get(f, 6)) if kinds[f] in ("double", "float") else F.col(f)).alias(f) for f in have]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*clean).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.round(x, digits), F.round(y, digits)).alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """One feature on each line (newline-delimited GeoJSON), in parallel."""
    features.write.mode("overwrite").text(path)


def read_feature_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    kind = f"properties struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in properties.split(','))}>, geometry struct<type: string, coordinates: string>"
    return spark.read.schema(kind).json(path).select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def csv_line(columns: Sequence[str], finite_only: bool = False) -> Column:
    """A CSV line: null as empty, text quoted only where it holds a quote, a comma or a line break. finite_only: numbers
    that are not finite are empty too, else they are written by name."""

    def cell(c: str) -> Column:
        t = F.col(c).cast("string")
        if finite_only:
            t = F.when(F.typeof(c).isin("double", "float") & t.isin("NaN", "Infinity", "-Infinity"), None).otherwise(t)
        return F.coalesce(F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t), F.lit(""))

    return F.concat_ws(",", *(cell(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], header: bool = False, finite_only: bool = False) -> None:
    """header: a first line with the names in every file of the folder."""
    lines = df.select(csv_line(columns, finite_only).alias("value"))
    if header:
        first = ",".join(f'"{c}"' if re.search('[",\n\r]', c) else c for c in columns)

        def with_header(batches):
            schema = None
            for batch in batches:
                if schema is None:
                    schema = batch.schema
                    yield pa.RecordBatch.from_arrays([pa.array([first], schema.types[0])], schema=schema)
                yield batch
            if schema is None:
                yield pa.record_batch([pa.array([first])], names=["value"])

        lines = lines.mapInArrow(with_header, "value string")
    lines.write.mode("overwrite").option("compression", "none").text(path)


def shape_features(df: DataFrame, kind: str, points: str, fields: Sequence[str], digits: int = 7, unproject: bool = False) -> DataFrame:
    """GeoJSON features of LineStrings or Polygons as text lines (value), from arrays of points: coordinates rounded
    (unproject: from Web Mercator metres to degrees first), rings closed, non-finite numbers as null."""
    names = dict(df.dtypes)
    clean = [(finite(f) if names[f] in ("double", "float") else F.col(f)).alias(f) for f in fields if f in names]

    def place(p: Column) -> Column:
        x, y = unmercator(p["x"], p["y"]) if unproject else (p["x"], p["y"])
        return F.array(F.round(x, digits), F.round(y, digits))

    line = F.transform(points, place)
    shape = line if kind == "LineString" else F.array(F.when(F.element_at(line, 1) == F.element_at(line, -1), line).otherwise(F.concat(line, F.slice(line, 1, 1))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*clean).alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one or several to a file, as rows."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_document(df: DataFrame, path: str) -> None:
    document(df).coalesce(1).write.mode("overwrite").text(path)


def grid_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, kind, rows, cols, bands, type, ...) of the PNG, npy and TIFF grids under a folder, from their first
    bytes, whatever their size; other files have null figures."""
    from fieldloom.sources import rasters

    return rasters.headers(spark, folder)


def document(df: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text (value)."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, others with the names of those that they break); null counts as broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """A key of the content, whatever its order and partitions: count and sum of row hashes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n:x}-{int(r.h or 0) & ((1 << 96) - 1):x}"


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table stored under the content key, made and stored first where there is none."""
    path = f"{folder.rstrip('/')}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
