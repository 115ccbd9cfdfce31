"""Predicate trees: the three renderers agree with each other, with another engine and with a plain reading."""

import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.functions import predicates as pr
from fieldloom.operators.selection import Kinds, Selection, groups_over, ranked_over

ROWS = [(i, x, n, t) for i, (x, n, t) in enumerate((x, n, t) for x in (None, -1.5, 0.0, 2.0, math.inf) for n in (None, -3, 0, 7) for t in (None, "", "it's", "A b", "7"))]
SCHEMA = "id long, x double, `odd name` long, t string"


def holds(p, row):
    """A plain reading of the tree."""
    v = dict(zip(("id", "x", "odd name", "t"), row, strict=True))
    match p:
        case pr.Test(name, sign, value):
            if v[name] is None:
                return False
            a = str(v[name]) if isinstance(value, str) else v[name]
            return {"=": a == value, "<>": a != value, "<": a < value, "<=": a <= value, ">": a > value, ">=": a >= value}[sign]
        case pr.OneOf(name, values):
            return v[name] is not None and v[name] in values
        case pr.Missing(name):
            return v[name] is None
        case pr.Holds(name, text):
            return v[name] is not None and text.lower() in v[name].lower()
        case pr.Within(name, stretches):
            return v[name] is not None and any(a <= v[name] < b for a, b in stretches)
        case pr.All(parts):
            return all(holds(q, row) for q in parts)
        case pr.Some(parts):
            return any(holds(q, row) for q in parts)
        case pr.Not(part):
            return not holds(part, row)


NUMBERS = st.sampled_from([-3, 0, 7, 2.0, -1.5, 0.25, 1e20])
LEAVES = st.one_of(
    st.builds(pr.Test, st.sampled_from(["x", "odd name"]), st.sampled_from(pr.SIGNS), NUMBERS),
    st.builds(pr.Test, st.sampled_from(["t"]), st.sampled_from(pr.SIGNS), st.sampled_from(["", "7", "it's", "a", "zz"])),
    st.builds(pr.OneOf, st.just("odd name"), st.lists(st.sampled_from([-3, 0, 7, 9]), max_size=3).map(tuple)),
    st.builds(pr.Missing, st.sampled_from(["x", "odd name", "t"])),
    st.builds(pr.Holds, st.just("t"), st.sampled_from(["", "B", "'S", "%"])),
    st.builds(pr.Within, st.just("x"), st.lists(st.tuples(NUMBERS, NUMBERS), max_size=2).map(tuple)),
)
TREES = st.recursive(LEAVES, lambda p: st.one_of(st.builds(pr.Not, p), st.builds(pr.All, st.lists(p, max_size=3).map(tuple)), st.builds(pr.Some, st.lists(p, max_size=3).map(tuple))), max_leaves=8)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).persist()


def test_renderers_agree(spark, table):
    con = duckdb.connect()
    con.execute('CREATE TABLE r (id BIGINT, x DOUBLE, "odd name" BIGINT, t VARCHAR)')
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", ROWS)
    trees = []

    @settings(max_examples=60, deadline=None, database=None, derandomize=True)
    @given(TREES)
    def collect(p):
        assert pr.loaded(p.json()) == p and pr.loaded(p.document()) == p
        trees.append(p)

    collect()
    got = table.select("id", *(p.column().alias(f"c{k}") for k, p in enumerate(trees))).orderBy("id").collect()
    text = table.selectExpr("id", *(f"{p.sql('`')} AS c{k}" for k, p in enumerate(trees))).orderBy("id").collect()
    duck = con.execute(f"SELECT id, {', '.join(p.sql() for p in trees)} FROM r ORDER BY id").fetchall()
    want = [(row[0], *(holds(p, row) for p in trees)) for row in ROWS]
    assert [tuple(r) for r in got] == want
    assert [tuple(r) for r in text] == want
    assert duck == want


def test_operators_bands_and_refusals(table):
    a, b = pr.Test("x", ">", 0), pr.Missing("t")
    assert (a & b) == pr.All((a, b)) and (a | b) == pr.Some((a, b)) and ~a == pr.Not(a)
    counts = [table.where(p.column()).count() for p in pr.band("x", [-1.5, 0.0, 2.0])]
    assert counts == [20, 40]
    for wrong in (float("nan"), None, "a\\b", math.inf):
        with pytest.raises(ValueError):
            pr.Test("x", "=", wrong)
    with pytest.raises(ValueError):
        pr.Test("x", "~", 1)
    for wrong in ({"op": "sql", "text": "1=1"}, {"op": "="}, {"op": "all", "parts": [3]}, [], {}):
        with pytest.raises(ValueError):
            pr.loaded(wrong)


def test_selection_over_two_tables(spark):
    plants = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 3.0), (None, 3.0), ("c", None)], "line string, v double")
    gaps = spark.createDataFrame([("a",), ("a",), ("d",)], "line string")
    tables = {"plants": (plants, Kinds({"line": "line"}, {"bad": pr.Test("v", ">", 2)})), "gaps": (gaps, Kinds({"line": "line"}, {"gap": pr.All(())}))}
    rows = lambda raw: {r.line: (r.n, r.total, r.n_plants, r.n_gaps) for r in groups_over(tables, Selection.parse(raw), "line").collect()}
    assert rows("bad") == {"a": (1, 4, 1, 0), "b": (1, 1, 1, 0), None: (1, 1, 1, 0)}
    assert rows("gap") == {"a": (2, 4, 0, 2), "d": (1, 1, 0, 1)}
    assert rows("line:a") == {"a": (4, 4, 2, 2)}
    assert rows("line") == {} and rows("other:1") == {}
    assert [r.line for r in ranked_over(tables, None, "line", 3).collect()] == ["a", "b", "c"]
    assert tables["gaps"][1].expression(Selection.parse("gap")) == {"op": "all", "parts": []}
