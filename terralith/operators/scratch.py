"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: Bytes of a row group of a table whose rows hold long arrays; writers and readers hold a group whole.
_WIDE_GROUP = 16 << 20


def wide(df: DataFrame) -> DataFrame:
    """df, whose rows hold arrays of MB: where it is settled, the bytes of a row group are looked at after each row, not first after a hundred."""
    df._wide = True
    return df


def settle(df: DataFrame) -> DataFrame:
    """df as a written table in spark.checkpoint.dir: lineage ends here, and a lost executor costs one stage at most."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terralith-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/terralith-loop-{uuid.uuid4().hex}"
    options = {"parquet.block.size": str(_WIDE_GROUP), "parquet.page.size.row.check.min": "1"} if getattr(df, "_wide", False) else {}
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes settled tables that no plan reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_settled_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup with a frame that shares its lineage."""
    return df.toDF(*df.columns)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that must not gather it in the driver to send it whole: estimates don't see what rows an explode makes."""
    return df.hint("merge")
