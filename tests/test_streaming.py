from datetime import datetime, timedelta

from attestry.operators import usage
from attestry.streaming import usage as stream

SCHEMA = "u string, t timestamp_ntz, c int, l double, id long"


def events(spark):
    t0 = datetime(2024, 1, 1)
    data = [(f"u{i % 3}", t0 + timedelta(hours=2 * i), (200, 429, 500)[i % 3 if i % 2 else 0], float(i), i) for i in range(60)]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_daily_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    got = run(spark, stream.daily_usage_stream(s, "u", "t", "c", "l", "1 hour"), "daily").collect()
    want = {tuple(r) for r in usage.daily_usage(e, "u", "t", "c", "l").collect()}
    assert got and {tuple(r) for r in got} <= want


def test_quota_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    got = {r.o: (r.hit, r.allowed) for r in run(spark, stream.quota_stream(s, "u", "t", "id", 2, 15 * 3600), "quota").collect()}
    assert got == {r.id: (r.hit, r.allowed) for r in usage.quota_decisions(e, "u", "t", "id", 2, 15 * 3600).collect()}


def test_outbox_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,), (2,)], "version_id long")
    df.write.parquet(str(tmp_path / "v"))
    s = spark.readStream.schema("version_id long").parquet(str(tmp_path / "v"))
    assert run(spark, stream.pending_outbox(s, "i"), "outbox").count() == 2
