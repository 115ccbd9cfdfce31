"""The nested document: against plain figures, as a written file, and of an empty table."""

import json

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import scalar
from fieldloom.operators import aggregates, summary
from fieldloom.sources import files

def spec():
    return ({"objects": {"n": F.count("*"), "mean": F.avg("v")}, "size": {"high": F.max("v")}}, {"kinds": ("k", ["a", "b"])}, {"size": ("v", {"p50": 0.5, "p90": 0.9}), "other size": ("w", {"p50": 0.5})})


def test_document_equals_plain_figures(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    v, w, k = r.random(200).tolist(), r.random(200).tolist(), r.choice(["a", "b", "c", None], 200).tolist()
    df = spark.createDataFrame(list(zip(v, w, k, strict=True)), "v double, w double, k string").repartition(5)
    want = {
        "objects": {"n": 200, "mean": np.mean(v)},
        "size": {"high": max(v), "p50": np.quantile(v, 0.5), "p90": np.quantile(v, 0.9)},
        "kinds": {"a": k.count("a"), "b": k.count("b"), "other": 200 - k.count("a") - k.count("b")},
        "other size": {"p50": np.quantile(w, 0.5)},
    }
    for few in (aggregates.FEW_VALUES, 50):  # in one aggregate, and by prefix sums
        monkeypatch.setattr(aggregates, "FEW_VALUES", few)
        files.write_document(summary.nested(df, *spec()), f"file:{tmp_path}/doc{few}")
        got = json.loads("".join(x.value for x in spark.read.text(f"file:{tmp_path}/doc{few}").collect()))
        assert list(got) == list(want)
        for section, named in want.items():
            assert set(got[section]) == set(named) and all(np.isclose(got[section][n], x) for n, x in named.items())
        flat = {(x.section, x.name): x.value for x in summary.flattened(summary.nested(df, *spec())).collect()}
        assert len(flat) == 9 and np.isclose(flat[("size", "p90")], want["size"]["p90"])


def test_empty_table_has_a_document(spark):
    df = spark.createDataFrame([], "v double, w double, k string")
    rows = summary.nested(df, *spec()).collect()
    assert len(rows) == 1 and rows[0]["objects"].asDict() == {"n": 0, "mean": None}
    assert rows[0]["kinds"].asDict() == {"a": 0, "b": 0, "other": 0} and rows[0]["size"]["p50"] is None


def test_job_ids(spark):
    one = spark.range(50).select(scalar.job_id(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("a"), scalar.job_id(F.lit("2024-05-06 07:08:09").cast("timestamp"), "id").alias("b")).collect()
    assert all(r.a.startswith("20240506-070809-") and len(r.a) == 22 for r in one) and len({r.a for r in one}) > 45
    assert one[1].b == "20240506-070809-c4ca42"
