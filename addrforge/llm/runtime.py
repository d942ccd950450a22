"""Session helpers shared by the operators: shared-folder lineage cuts and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on, unless a single document is longer.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch (one row at least): what a Python worker holds does not depend on how long the rows are.
BATCH_BYTES = 4 << 20
#: Shares that join_spread deals the rows of one key out to.
SALTS = 16

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="addrforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes. The bound is read when a result is computed, so it stays set; it changes no result."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and survives lost executors.

    The folder is needed until the last result built on it is written; release() deletes it then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """A point in time for release()."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders that cut() wrote after the mark, but for the last keep ones."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    paths[since : len(paths) - keep] = []


def join_spread(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """large joined to small (one row a key), whose rows are repeated SALTS times, so that a key that holds much of large is dealt to many tasks."""
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batches whose texts hold about limit bytes at most (one row at least); (slice, text array)."""
    for batch in batches:
        text = batch.column(column)
        if text.null_count:
            text = text.fill_null("")
        sizes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start), text.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start), text.slice(start)


def first_by_hash(df: DataFrame, label: str, n: int) -> DataFrame:
    """The n rows (doc_id, label) of each label with the smallest hash of doc_id; ranked in shares first, so that no task sees all of a label."""
    h = F.xxhash64("doc_id")
    share = df.withColumn("_share", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(256)))
    some = share.withColumn("_r", F.row_number().over(W.partitionBy(label, "_share").orderBy(h, "doc_id"))).filter(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(h, "doc_id"))).filter(F.col("_r") <= n).drop("_r", "_share")


def groups(batches, keys: list[str]):
    """Tables of the rows of each key, from batches sorted by the keys; a key may go on over batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        new = pa.array([False] * (table.num_rows - 1))
        for c in keys:
            column = table[c].combine_chunks()
            new = pa.compute.or_(new, pa.compute.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)))
        begins = [0, *(i + 1 for i, x in enumerate(new.to_pylist()) if x)]
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(begins[-1])
    if held is not None:
        yield held
