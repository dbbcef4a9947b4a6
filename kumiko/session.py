"""A local session with the settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kumiko")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their plan, by a checkpoint in the folder that spark.checkpoint.dir names (one is set here only
    where it is unset). Later plans then read stored rows instead of repeating and analysing all that came before."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="kumiko-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)
