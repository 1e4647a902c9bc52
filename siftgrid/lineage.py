"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names in ``spark.checkpoint.dir``, which all executors share.

    Only on a local master (tests, one machine), where that setting is absent and none was set on the context, a temporary folder is
    chosen and removed at exit; on a cluster its absence raises RuntimeError, since a folder of one machine would not survive.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="siftgrid-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder as a Parquet table; later reads start from those files.

    A table is compressed, read by column, and made in one pass, where a checkpoint of rows computes its last stage
    twice. It lies in the context's own checkpoint folder, in folders of ``by`` if named, and goes with that.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
