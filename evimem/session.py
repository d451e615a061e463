"""Session settings and the shared places that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evimem", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the operators expect (UTC, adaptive plans, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one serves on one machine; a cluster must name its shared folder."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not have and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(have or f"file://{tempfile.mkdtemp(prefix='evimem-')}")
    return have or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the shared folder: its lineage ends here, no executor holds the only copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written as a compressed table in the shared folder, in folders of the column `by`, and read back (order of rows is not kept)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more; other tables stay."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions set for the session, `least` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))



def spread_out(df: DataFrame) -> DataFrame:
    """`df` over all cores, for work that costs far more than moving the rows: a table of fewer partitions than cores is split, others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
