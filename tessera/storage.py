"""Tables and small files in the folder that all executors share, through Hadoop's file systems, so any store works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group that a writer of intermediate tables holds.
ROW_GROUP = 16 << 20


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the one named by spark.checkpoint.dir, deleted when the application ends.

    Where that is unset, a folder of our own serves in local mode (tests); on a cluster, executors would not see it, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    fs, path = hadoop(spark, own)
    fs.deleteOnExit(path)
    return own


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in own_dir()."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=compression)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored(); nothing that is still to be computed may need them."""
    for df in tables:
        fs, path = hadoop(df.sparkSession, df.stored_at)
        fs.delete(path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one already. The store must refuse to create a file twice, as HDFS does."""
    fs, p = hadoop(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
    except Exception as e:
        if "exist" not in str(e).lower():
            raise
        return False
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file. It is written under another name first and renamed; where rename does not replace, it is written over in place, so that readers always find one."""
    fs, to = hadoop(spark, path)
    _, step = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    for at in (step, to):
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if at is to:
            fs.delete(step, False)
        elif fs.rename(step, to):
            return


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """df as CSV with a header: a folder of parts of that name, by ranges of order if given, each written by its own task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else df
    rows.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """df as one CSV file with a header, in df's order, by one task: for exchange with what reads files alone."""
    spark, step = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.options(header=True, escape='"', emptyValue="").csv(step)
    fs, folder = hadoop(spark, step)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    _, to = hadoop(spark, path)
    fs.mkdirs(to.getParent())
    fs.delete(to, False)
    fs.rename(part, to)
    fs.delete(folder, True)
