"""Tables, checkpoints and small helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir` (one file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the session names in spark.checkpoint.dir; only where that is unset and the master
    is local (tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="failscope-ckpt-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a parquet table in the shared folder: smaller than a checkpoint, and with columns that can be read apart."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_all(col):
    """Strip every kind of white space, not only blanks (Unicode class)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def blank_to_null(col):
    """Stripped text, or null where nothing is left."""
    t = trim_all(col)
    return F.when(F.length(t) > 0, t)


def month_of(col):
    """yyyy-MM of a timestamp; null stays null."""
    return F.date_format(col, "yyyy-MM")


def require(df: DataFrame, *names: str) -> DataFrame:
    """Select exactly the columns an operator needs, so that extra or clashing ones do no harm."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])
