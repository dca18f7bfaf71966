"""Session factory and the few helpers that need the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "ticketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a local master gets a temporary folder, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ticketloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, survives lost executors.

    Parquet keeps it compressed and columnar. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ticketloom-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashed(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """(h, *columns): of the distinct keys the `n` of least hash, each with the first of its rows in order.

    A cut-off of the hash, from the number of distinct keys, filters before anything is sorted: a small multiple of `n` rows
    leaves the scan, however many there are, and copies of a key meet in partial aggregates."""
    hashed = rows.withColumn("h", F.pmod(F.xxhash64(key), F.lit(1 << 40)))
    distinct = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    cut = min(1 << 40, int((1.3 * n + 100) / max(distinct, 1) * (1 << 40)))
    kept = hashed.where(F.col("h") < cut).groupBy("h").agg(F.min(F.struct(*rows.columns)).alias("row"))
    return kept.orderBy("h").limit(n).select("h", "row.*")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass
