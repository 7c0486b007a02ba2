from pyspark.sql import functions as F

from lightgraph.operators import users
from lightgraph.streaming.sessions import live_sessions, windowed_activity

SCHEMA = "user_id long, node_id long, at timestamp"


def parts(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 4).alias("user_id"), (F.col("id") * 7 % 11).alias("node_id"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    for n in range(3):
        rows.where(F.col("at").between(F.timestamp_seconds(F.lit(n * 1200)), F.timestamp_seconds(F.lit(n * 1200 + 1199)))).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    return rows


def test_live_sessions_end_like_the_batch(spark, tmp_path):
    rows = parts(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out: dict = {}

    def keep(batch, _):
        out.update({r.user_id: (r.session, r.interactions) for r in batch.collect()})

    q = live_sessions(stream, "3 hours").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = users.history(rows)
    for u in range(4):
        expected = [r.node_id for r in users.sessions(seen).where(F.col("user_id") == u).orderBy("pos").collect()]
        assert out[u] == (expected, 15)


def test_windows(spark, tmp_path):
    parts(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = windowed_activity(stream, "10 minutes", "0 seconds").writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = spark.table("activity").agg(F.sum("n")).collect()[0][0]
    assert 50 <= total <= 60
