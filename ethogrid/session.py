"""Session factory and the few settings the library relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ethogrid", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the one that exists."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ETHOGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointing(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder: the cluster's, or a local one where all of Spark runs in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ethogrid-ckpt-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which survives lost executors.

    The shuffle files that made them are deleted once the checkpoint is written. Adaptive execution would end a query as soon as a side
    of a join turns out to be empty, while other stages of it still read those files; tasks that ask for deleted ones wait for minutes on a
    cluster. So that rule is off here, and a query ends when all of its stages have.
    """
    spark = checkpointing(df.sparkSession)
    excluded = "spark.sql.adaptive.optimizer.excludedRules"
    rules = [r for r in (spark.conf.get(excluded, None) or "").split(",") if r] + ["org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"]
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", excluded: ",".join(rules)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables; also lets Python workers of this machine find the package, wherever they start."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
