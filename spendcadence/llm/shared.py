"""Small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcadence.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder that all executors share, and go on from there.

    A lost executor then costs no recomputation of what lies before, and several readers share one pass.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filled(text: str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a compressed table that :func:`removed` can take away after its last reader.

    The shuffle files of queries before it are given back.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    given_back(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def given_back(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go: Spark drops them when the driver collects garbage.

    Spark holds on to the last query until another one has run, so after a table is written its own shuffle files stay;
    they go by a call after the first job on that table.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def removed(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


RANK_ROWS = 20_000  # rows numbered in one go
RANK_BLOCKS = 4096  # blocks of a group at most


def numbered(rows: DataFrame, within: list[str], order: list[str], name: str, blocks: int) -> DataFrame:
    """Number the rows of each group without gaps from 0, in blocks, so that no group passes through one task.

    Rows are dealt to blocks by a hash of ``order``; block sizes, one narrow row each, give where a block starts.
    ``rows`` is read twice, so it should be cheap to read.
    """
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*within, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*within, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    in_block = Window.partitionBy(*within, "_block").orderBy(*order)
    return (
        rows.withColumn("_at", F.row_number().over(in_block) - 1)
        .join(starts, [*within, "_block"])
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_block", "_at", "_start")
    )


def rank_blocks(rows: int) -> int:
    return min(RANK_BLOCKS, rows // RANK_ROWS + 1)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: what the cluster names in spark.checkpoint.dir, or one of our own on a local master."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


BITS = 1 << 25  # of a membership bitmap: 4 MB, whatever it is made from
BITMAP = 1 << 15  # bits in one row of it


def likely(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is among ``keys``, and few others, without moving the rows.

    A bitmap of fixed size (one bit for a key's hash) is broadcast; an exact join follows where it is needed.
    Once there are more keys than bits it lets most rows pass and only saves less.
    """
    bit = F.pmod(F.xxhash64(name), F.lit(BITS))
    row, at = F.shiftright(bit, 15), F.pmod(bit, F.lit(BITMAP))
    bitmap = keys.groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(at).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(at, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    return (
        rows.join(F.broadcast(bitmap), row == F.col("_row"))
        .filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        .drop("_row", "_bitmap")
    )
