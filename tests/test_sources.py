import json

import pytest
from pyspark.sql import functions as F

from servelog.operators import infer
from servelog.sources import readers, sinks


def test_calibration_file_with_nested_samples(spark, tmp_path):
    record = {"model": "m", "source": "s", "alpha_ms": 17.0, "samples": [[1, 25.5], [4, 48.0]]}
    (tmp_path / "c.json").write_text(json.dumps(record, indent=2))
    got = readers.read_calibration(spark, str(tmp_path / "c.json")).collect()
    assert [(r["model"], r["alpha_ms"], r["x"], r["y"]) for r in got] == [
        ("m", 17.0, 1.0, 25.5), ("m", 17.0, 4.0, 48.0)]


def test_absent_request_fields_are_defaulted(spark):
    raw = spark.createDataFrame([(b'{"request_id": "r", "input": "hi", "model": "m"}',)], "value binary")
    got = readers.decode_kafka_requests(raw).first()
    assert (got["max_tokens"], got["temperature"], got["top_p"], got["stream"], got["priority"]) == (
        128, 0.7, 1.0, False, "default")
    assert len(got["prefix_hash"]) == 32


def test_kafka_records_survive_restarts(spark):
    """Five starts from one checkpoint, two of them without new records: each record once."""
    from servelog.streaming.run import replay
    value = F.to_json(F.struct(F.format_string("r%d", "id").alias("request_id"), F.lit("hi").alias("input")))
    wire = spark.range(90).select("id", value.cast("binary").alias("value"))
    runs = [F.col("id") < 40, F.lit(False), F.col("id").between(40, 70), F.lit(False), F.col("id") > 70]
    got = replay([wire], runs, lambda raw: readers.decode_kafka_requests(raw).select("request_id", "max_tokens"), "t-kafka")
    assert sorted(r.request_id for r in got.collect()) == sorted(f"r{i}" for i in range(90))
    assert {r.max_tokens for r in got.collect()} == {128}


def test_unknown_log_table(spark):
    with pytest.raises(ValueError):
        readers.read_log(spark, "/nowhere", "sessions")


def test_sweep_csv_has_a_header(spark, tmp_path):
    sinks.write_sweep_csv(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["a", "b"]


def test_request_log_is_partitioned_and_not_repeated(spark, tmp_path):
    src = spark.createDataFrame([("r1", "m", "2024-01-01 10:00:00"), ("r2", "n", "2024-01-02 10:00:00")],
                                "id string, model string, t string")
    src = src.select("id", "model", F.to_timestamp("t").alias("created_at"))
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
        sinks.write_request_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert (tmp_path / "out" / "model=m" / "day=2024-01-01").is_dir()


def test_batch_infer_cuts_batches_across_arrow_chunks(spark):
    df = spark.range(50, numPartitions=1).select("id", F.concat(F.lit("text "), "id").alias("t")).union(
        spark.sql("select 99L, cast(null as string)")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = infer.batch_infer(df, "t", lambda: lambda texts: ([t.upper() for t in texts], 2.5 * len(texts)),
                                batch_size=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["output"] for r in got) == sorted([f"TEXT {i}" for i in range(50)] + [""])
    assert sorted(r["batch_size"] for r in got) == [3] * 3 + [4] * 48
    assert all(r["inference_ms"] == 2.5 * r["batch_size"] for r in got)


def test_ordered_batches_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 5003).select((F.col("id") * 7 % 5003).alias("seq"), F.lit("x").alias("t"))
    for parts in (1, 13):
        got = infer.batch_infer(rows.repartition(parts), "t", lambda: lambda texts: (texts, float(len(texts))), 16, order="seq")
        sizes = {r.seq: (r.batch_size, r.inference_ms) for r in got.collect()}
        assert len(sizes) == 5003 and got.columns == ["seq", "t", "output", "batch_size", "inference_ms"]
        assert all(sizes[k] == ((16, 16.0) if k < 4992 else (11, 11.0)) for k in sizes)
