"""Change logs: insertions, updates and deletions of rows, and the tables they make.

A change log has _op ('I', 'U' or 'D'), _seq (its order), and structs `old` and `new` of the row before and after.
Signed rows have _sign instead: +1 where a row came, -1 where one went; an update is both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of a change log: the columns of the row, _sign and _seq."""
    went = F.struct(F.lit(-1).alias("s"), F.col("old").alias("r"))
    came = F.struct(F.lit(1).alias("s"), F.col("new").alias("r"))
    each = F.when(F.col("_op") == "I", F.array(came)).when(F.col("_op") == "D", F.array(went)).otherwise(F.array(went, came))
    return changes.select("_seq", F.explode(each).alias("_e")).select("_e.r.*", F.col("_e.s").alias("_sign"), "_seq")


def fold(changes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The table that a change log makes. With a key: the last image of each key that isn't deleted. A key is found
    in `new` or, for a deletion, in `old`; so logs whose old images hold keys alone will do. Without a key: every row as often as it came more than went.

    With a key, the images of one row are reduced by max_by, partial per task: a row that changes all the time is no
    hot spot.
    """
    columns = changes.schema["new"].dataType.names
    if key:
        image = F.coalesce("new", "old")
        keyed = changes.select(*[image[k].alias(f"_k{i}") for i, k in enumerate(key)], F.struct("_op", "new").alias("_v"), "_seq")
        went = _key_changes(changes, key)
        if went is not None:
            keyed = keyed.unionByName(went)
        last = keyed.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.max_by("_v", "_seq").alias("_v"))
        return last.where(F.col("_v._op") != "D").select("_v.new.*")
    rows = signed(changes).groupBy(*columns).agg(F.sum("_sign").alias("_n"))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("_n") > 0, F.col("_n"))))).drop("_n") if columns else rows


def _key_changes(changes: DataFrame, key: list[str]) -> DataFrame | None:
    """For updates that change the key: a deletion of the old key."""
    moved = None
    for k in key:
        c = ~F.col("old")[k].eqNullSafe(F.col("new")[k])
        moved = c if moved is None else moved | c
    kind = changes.schema["new"].dataType
    gone = changes.where((F.col("_op") == "U") & F.col("old").isNotNull() & moved)
    return gone.select(*[F.col("old")[k].alias(f"_k{i}") for i, k in enumerate(key)], F.struct(F.lit("D").alias("_op"), F.lit(None).cast(kind).alias("new")).alias("_v"), "_seq")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that lead from one table to the other."""
    columns = after.columns
    both = before.select(*columns, F.lit(-1).alias("_sign")).unionByName(after.select(*columns, F.lit(1).alias("_sign")))
    net = both.groupBy(*columns).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    return net.select(*columns, F.signum("_n").cast("int").alias("_sign"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_c")).drop("_c")


def with_old_images(changes: DataFrame, key: list[str]) -> DataFrame:
    """changes with full `old` images, where the source sent keys alone or none: the image before, by key and _seq.

    Needed before any expression on other columns touches `old`. Each key's changes are in one task; keys spread.
    """
    image = F.coalesce("new", "old")
    w = W.partitionBy(*[image[k] for k in key]).orderBy("_seq")
    before = F.lag(F.when(F.col("_op") != "D", F.col("new"))).over(w)
    return changes.withColumn("old", F.when(F.col("_op") == "I", F.lit(None).cast(changes.schema["new"].dataType)).otherwise(F.coalesce(before, "old")))


def inserts(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """A table or a stream of rows as a change log of insertions, in the order of column seq if there is one; a stream
    without it has no order."""
    kind = rows.schema
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long") if rows.isStreaming else F.monotonically_increasing_id()
    return rows.select(F.lit("I").alias("_op"), order.alias("_seq"), F.lit(None).cast(kind).alias("old"), F.struct(*rows.columns).alias("new"))


def schema(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("_op", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("old", row), T.StructField("new", row)])
