"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.shipping import ship

#: The white space that separates words, and a word, as Java patterns.
SPACE = " \t\n\x0b\x0c\r"
WORD_AND_SPACE = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}
#: Paths of the tables from written() that are still there, in the order they were made.
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one if all of Spark runs in this process, as in
    tests; else an error, as executors would write where others can't read."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="sluice-")
    return _LOCAL[sc.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing is left to ask
        return


@atexit.register
def _remove_all() -> None:
    for path, spark in _MADE.items():
        remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written to the shared folder as Parquet and read back. The files go with dropped(), with
    the kept() around it, or when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # the shuffle files of this write go when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    _MADE[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.sluice_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing will read again."""
    if path := getattr(df, "sluice_path", None):
        remove(df.sparkSession, path)
        _MADE.pop(path, None)


def kept(make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), without the tables that were written on the way."""
    before = set(_MADE)
    out = written(make())
    for path in [p for p in _MADE if p not in before and p != out.sluice_path]:
        remove(_MADE.pop(path), path)
    return out


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once, however often the lambda names it."""
    return F.transform(F.array(value), then)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """How many words a text has: each is replaced, with the white space after it, by one byte, and no list is made."""
    return F.coalesce(F.octet_length(F.regexp_replace(F.btrim(text, F.lit(SPACE)), WORD_AND_SPACE, "x")), F.lit(0)).cast("long")


def join_small(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salts: int = 64, most: int = 100_000) -> DataFrame:
    """Left join on a null-safe key where small has one row per key. Small sides of a counted size are broadcast;
    beyond `most` rows the rows of a hot key are dealt over `salts` partitions instead."""
    on = big[big_key].eqNullSafe(small[small_key])
    if small.count() <= most:
        return big.join(F.broadcast(small), on, "left").drop(small[small_key])
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, left[big_key].eqNullSafe(right[small_key]) & (left["_salt"] == right["_salt_of"]), "left").drop(right[small_key], "_salt", "_salt_of")


def _given_back() -> None:
    """Returns what this Python worker has freed to the system: workers live on between stages, beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def mapped(df: DataFrame, run, schema: str, size: int = 3 << 20) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the workers. run gets batches cut to about `size` bytes (a
    larger row by itself), whatever Spark's own batches are; these are bounded too, unless the session says otherwise."""
    spark = df.sparkSession
    ship(spark)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(most, None) is None:
        spark.conf.set(most, str(8 << 20))

    def bounded(batches):
        def parts():
            for k, b in enumerate(batches):
                step = max(1, int(size * b.num_rows / max(1, b.nbytes)))
                for at in range(0, b.num_rows, step):
                    yield b.slice(at, step)
                if k % 16 == 15:
                    _given_back()

        try:
            yield from run(parts())
        finally:
            _given_back()

    return df.mapInArrow(bounded, schema)


def join_salted(big: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, share: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join on columns of one name. keys (a written table, one row per key) has in `n` how many of big's `total`
    rows have the key, or fewer. Keys with more than total / share, so `share` keys at most, are told to all tasks, and
    the rows of each are dealt over `salts` partitions, where a copy of the key's row meets them."""
    is_hot = F.col(n) * share > total
    hot = keys.where(is_hot).select(*on, F.lit(True).alias("_hot"))
    left = big.join(F.broadcast(hot), on, "left")
    left = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    right = keys.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
