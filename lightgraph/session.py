"""What every operator needs from the session: a shared folder, worker imports, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)

#: Arrow batches handed to Python stay under this many rows and bytes, so long texts keep bounded memory.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_ARENA_MAX", "2")  # workers give back what a batch took
    env.setdefault("MALLOC_MMAP_THRESHOLD_", "262144")  # large arrays always by pages of their own, which go back at once
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [REPO, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir. Where that is unset, a session with a local master gets a
    temporary one; on a cluster that is an error, as other machines could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lightgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. options: of the writer."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """materialize() in `buckets` buckets of the keys, a file each, sorted by them: joins and groups by the keys read it without a shuffle.
    forget() takes the table out of the catalog again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    known = f"lightgraph_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(known)
    out = spark.table(known)
    out.written_at, out.known_as = path, known
    return out


def forget(*tables: DataFrame) -> None:
    """Drop what bucketed() wrote for these, files too; nothing may read them any more."""
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.known_as}")
        discard(df)


def discard(*written: DataFrame) -> None:
    """Delete what materialize() wrote for these; nothing may read them any more. For rounds of iterations."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
