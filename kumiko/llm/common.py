"""Helpers that several operators share: shared storage, Arrow batches, text blocks, scalable ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts may be long, so a batch stays small.
BATCH_ROWS = 512
#: Bytes of text that one vectorised step works on at a time.
BLOCK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kumiko-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds; a smaller bound that is already set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least two for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism * 2)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_text(col: Column) -> Column:
    return F.crc32(F.encode(col, "UTF-8"))


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each value starts and the last one ends; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `most` bytes together; a longer text is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Bytes of a sieve at most, whatever the number of its rows.
SIEVE_BYTES = 8 << 20
_PROBES = 4


def _places(col: Column, bits: int) -> list[Column]:
    """Places of a 64-bit hash in a sieve of `bits` bits, a power of two."""
    low, step = col.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(col, 32).bitwiseOR(F.lit(1))
    return [(low + step * k).bitwiseAND(F.lit(bits - 1)) for k in range(_PROBES)]


def sieve(rows: DataFrame, col: Column):
    """A function of a 64-bit hash column: false where no row has that hash in `col`, true where one has and, seldom, elsewhere.

    A join with `rows` need move only what it lets through. It takes 16 bits a row up to SIEVE_BYTES; beyond that it lets more through
    and spares less, and the join that follows decides all the same. Its words are put together by Spark, one row for each.
    """
    n = rows.count()
    bits = min(1 << max(10, (16 * n).bit_length()), SIEVE_BYTES * 8)
    at = rows.select(F.explode(F.array(*_places(col, bits))).alias("at"))
    word = F.shiftright("at", 6).alias("word")
    words = at.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # bounded: SIEVE_BYTES / 8 rows
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        at = np.frombuffer(held.value, np.uint64)
        h = h.to_numpy().view(np.uint64)
        step = h >> np.uint64(32) | np.uint64(1)
        found = np.ones(len(h), bool)
        for k in range(_PROBES):
            place = h + step * np.uint64(k) & np.uint64(bits - 1)
            found &= (at[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return passes


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds `name`: the row's gapless 0-based rank in its group, by `order`.

    No group is ever gathered: rows are range partitioned by (group, order), numbered inside a partition, and the
    counts of earlier partitions (one row for each partition and group) are added.
    """
    n = partitions(df)
    held = cut(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy("_part", group).count().collect()  # bounded: partitions + groups, as partitions are ranges
    before: dict = {}
    offsets = []
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], row[group], before.get(row[group], 0)))
        before[row[group]] = before.get(row[group], 0) + row["count"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    table = df.sparkSession.createDataFrame(offsets, f"_part int, _group {kinds[group]}, _before long")
    # a partition's rows of a group are one run of a sorted range, so this window holds a partition's share at most
    from pyspark.sql import Window

    window = Window.partitionBy("_part", group).orderBy(*order)
    out = held.withColumn("_in", F.row_number().over(window).cast("long") - 1)
    joined = out.join(F.broadcast(table), (out["_part"] == table["_part"]) & out[group].eqNullSafe(table["_group"]))
    return joined.select(*[out[c] for c in df.columns], (F.col("_before") + F.col("_in")).alias(name))


_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes rows as a Parquet table in the shared folder and reads them back; the table goes when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    stored_at(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(spark: SparkSession, path: str) -> None:
    """Notes a folder that is to go when the driver ends."""
    if not _stored:
        import atexit

        atexit.register(_end, spark)
    _stored.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; what stays is the shared folder's to clean
        return


def forget() -> None:
    """Deletes the tables and files that this session has put into the shared folder; call it when results are used."""
    while _stored:
        _delete(*_stored.pop())


def _end(spark: SparkSession) -> None:
    """At the driver's end: all tables, and this application's own folder of checkpoints."""
    forget()
    try:
        of_application = spark.sparkContext._jsc.sc().getCheckpointDir()
        if of_application.isDefined():
            _delete(spark, of_application.get())
    except Exception:  # noqa: BLE001  the session may be gone
        return
