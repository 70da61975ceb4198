"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local master without that setting gets a temporary folder;
    a cluster without it is an error, as executors would not see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-scanloom-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scanloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, so a lost executor
    costs at most the tasks that read it, and everything that reads it sees the same rows."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """written() in as many buckets of `keys` as there are shuffle partitions: joins and sums by these keys shuffle only
    the other side. `dealt`: df lies by these keys already."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (df if dealt else df.repartition(n, *keys)).write.option("path", path).bucketBy(n, *keys).saveAsTable(table)
    out = spark.table(table)
    out.written_to, out.table_name = path, table
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() or bucketed() made and that no later job reads: what came of them is written, too."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hasattr(df, "table_name"):
            spark.sql(f"drop table if exists {df.table_name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
