"""Columns of one to three values, keys that are not integers, type suffixes in CSV text, NaN without NULL."""

import pytest

from tabprobe.functions.keyhash import fold_of, row_key
from tabprobe.operators import features
from tabprobe.operators.profile import profile_columns
from tabprobe.sources import ingest


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_profile_of_few_values(spark, n):
    df = spark.createDataFrame([(float(i * i), str(i)) for i in range(n)], "x double, s string")
    r = {r["column"]: r for r in profile_columns(df).collect()}["x"].asDict()
    # one value is a constant and two are a flag: such columns have no numeric summary
    assert n < 3 or r["mean"] == pytest.approx(sum(i * i for i in range(n)) / n, abs=1e-4)


@pytest.mark.parametrize("cols", [["s"], ["d"], ["i"], ["i", "s"], []])
def test_row_keys(spark, cols):
    df = spark.createDataFrame([(i, f"k{i}", i + 0.25) for i in range(200)], "i long, s string, d double")
    got = df.select(row_key(cols).alias("k"), fold_of(row_key(cols), 5).alias("f")).collect()
    assert len({r.k for r in got}) == 200 and {r.f for r in got} == set(range(5))


def test_codes_are_not_numbers(spark):
    df = spark.createDataFrame([("1d", "1.5", "2"), ("2f", "-.5e3", "3")], "code string, num string, whole string")
    typer = next(f for k, f in vars(ingest).items() if callable(f) and (f.__doc__ or "").startswith("Cast string columns to bigint"))
    assert [t for _, t in typer(df).dtypes] == ["string", "double", "bigint"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 5 == 0 else float(i), i % 2) for i in range(100)], "id long, x double, y int")
    model = features.fit(df, "y", ["id"])
    out = model.transform(df)
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    assert out.where(" OR ".join(f"isnan(`{x}`)" for x in numeric)).count() == 0 if numeric else True


def test_nan_is_co_missing(spark):
    from tabprobe.operators import quality as Q
    df = spark.createDataFrame([(float("nan"), None), (1.0, "x"), (None, None), (float("nan"), "y")], "a double, b string")
    assert [tuple(r) for r in Q.co_missing_pairs(df, ["a", "b"]).collect()] == [("a", "b", 2)]
