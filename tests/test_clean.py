import pytest
from pyspark.sql import functions as F

from servelog.operators import clean


def test_validation_reasons(spark):
    rows = [("m", "x", 1, 0.0, 1.0, "sync", "high"), ("m", "x", 8193, 2.5, -0.1, "batch", "low"),
            (None, None, None, 1.0, 1.0, "async", "default")]
    df = spark.createDataFrame(rows, "model string, input string, max_tokens int, temperature double, "
                                     "top_p double, mode string, priority string")
    got = clean.validate_requests(df).collect()
    assert [r["is_valid"] for r in got] == [True, False, False]
    assert got[1]["reasons"] == ["max_tokens", "temperature", "top_p", "mode", "priority"]
    assert got[2]["reasons"] == ["model", "input", "max_tokens"]


def test_params_default(spark):
    df = spark.createDataFrame([('{"max_tokens": 5, "stream": true}',), ("{}",), (None,)], "params string")
    got = [tuple(r["p"]) for r in clean.normalise_params(df).collect()]
    assert got == [(5, 0.7, 1.0, True), (128, 0.7, 1.0, False), (128, 0.7, 1.0, False)]


def test_payload_precedence(spark):
    df = spark.createDataFrame([("e", "t", "o"), (None, "t", "o"), (None, None, "o"), (None, None, None)],
                               "error string, token string, output string")
    got = [(r["kind"], r["payload"]) for r in clean.resolve_payload(df).collect()]
    assert got == [("error", "e"), ("token", "t"), ("output", "o"), ("output", "")]


def test_deadlines(spark):
    df = spark.createDataFrame([("high", 0.0), ("default", 0.0), ("high", 95.0)],
                               "priority string, enqueue_ms double")
    got = clean.deadline_columns(df, F.lit(50.0)).collect()
    assert [(r["slack"], r["overdue"]) for r in got] == [(-45.0, True), (0.0, True), (50.0, False)]


def test_admission_boundaries(spark):
    df = spark.createDataFrame([(d,) for d in (0, 1999, 2000, 9999, 10000, 50000)], "depth int")
    got = [r["admission"] for r in clean.admission_class(df).collect()]
    assert got == ["accept", "accept", "degraded", "degraded", "shed", "shed"]
    for low, high in ((5000, 5000), (-1, 10)):
        with pytest.raises(ValueError):
            clean.admission_class(df, low, high)


def test_steady_state_counts_incomplete_arrivals(spark):
    df = spark.createDataFrame([(i, i != 3) for i in range(6)], "seq long, done boolean")
    got = clean.steady_state(df, 2, completed=F.col("done"))
    assert sorted(r["seq"] for r in got.collect()) == [2, 4, 5]
