"""Change logs from messages: Debezium envelopes, plain Kafka records, webhook and gRPC landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import changelog

#: Debezium's and its Avro connectors' names of types.
DEBEZIUM = {
    "int8": T.LongType(), "int16": T.LongType(), "int32": T.LongType(), "int64": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "float32": T.DoubleType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(),
    "io.debezium.time.Date": T.DateType(), "io.debezium.time.Timestamp": T.TimestampType(), "io.debezium.time.MicroTimestamp": T.TimestampType(), "io.debezium.time.ZonedTimestamp": T.TimestampType(), "io.debezium.data.Json": T.StringType(),
    "org.apache.kafka.connect.data.Decimal": T.DecimalType(38, 10), "org.apache.kafka.connect.data.Date": T.DateType(), "org.apache.kafka.connect.data.Timestamp": T.TimestampType(),
}
_RAW = {"io.debezium.time.Date": "int", "org.apache.kafka.connect.data.Date": "int", "io.debezium.time.Timestamp": "bigint", "org.apache.kafka.connect.data.Timestamp": "bigint", "io.debezium.time.MicroTimestamp": "bigint", "io.debezium.time.ZonedTimestamp": "string"}


def debezium_schema(fields: list[dict]) -> tuple[T.StructType, dict[str, str]]:
    """The row's type from the `fields` of an envelope's before or after schema, and each field's Debezium type."""
    names = {f["field"]: f.get("name") if f.get("name") in DEBEZIUM else f["type"] for f in fields}
    return T.StructType([T.StructField(f["field"], DEBEZIUM[names[f["field"]]], f.get("optional", True)) for f in fields]), names


def debezium(messages: DataFrame, fields: list[dict], value: str = "value", seq: str = "offset") -> DataFrame:
    """A change log of messages with a Debezium envelope in column `value`. c and r insert, u updates, d deletes; an
    update without the row before takes the row after for it. Tombstones (null values) say nothing. All on the JVM."""
    row, names = debezium_schema(fields)
    raw = T.StructType([T.StructField(f.name, T._parse_datatype_string(_RAW[names[f.name]]) if names[f.name] in _RAW else f.dataType) for f in row])
    payload = T.StructType([T.StructField("before", raw), T.StructField("after", raw), T.StructField("op", T.StringType())])
    both = T.StructType([T.StructField("payload", payload), *payload.fields])
    v = messages.where(F.col(value).isNotNull()).select(F.from_json(F.col(value).cast("string"), both).alias("_v"), F.col(seq).cast("long").alias("_seq"))
    v = v.select("_seq", F.coalesce("_v.payload", F.when(F.col("_v.op").isNotNull(), F.struct("_v.before", "_v.after", "_v.op"))).alias("_p")).where("_p.op IS NOT NULL")

    def typed(side: str):
        c = F.col(f"_p.{side}")
        of = {
            "io.debezium.time.Date": F.date_from_unix_date, "org.apache.kafka.connect.data.Date": F.date_from_unix_date, "io.debezium.time.Timestamp": F.timestamp_millis, "org.apache.kafka.connect.data.Timestamp": F.timestamp_millis,
            "io.debezium.time.MicroTimestamp": F.timestamp_micros, "io.debezium.time.ZonedTimestamp": lambda x: x.cast("timestamp"),
        }
        return F.when(c.isNotNull(), F.struct(*[of.get(names[f.name], lambda x: x)(c[f.name]).cast(f.dataType).alias(f.name) for f in row]))

    op = F.when(F.col("_p.op").isin("c", "r"), "I").when(F.col("_p.op") == "u", "U").when(F.col("_p.op") == "d", "D")
    out = v.select(op.alias("_op"), "_seq", typed("before").alias("old"), typed("after").alias("new")).where("_op IS NOT NULL")
    return out.withColumn("old", F.when(F.col("_op") == "U", F.coalesce("old", "new")).when(F.col("_op") == "D", F.col("old"))).withColumn("new", F.when(F.col("_op") != "D", F.col("new")))


def kafka(spark: SparkSession, brokers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Messages of a topic, with Kafka's own columns. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).options(**options).load()


def plain(messages: DataFrame) -> DataFrame:
    """A change log of insertions (key, message), both text: topics without a schema registry."""
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("message", T.StringType())])
    return messages.select(F.lit("I").alias("_op"), F.col("offset").cast("long").alias("_seq"), F.lit(None).cast(kind).alias("old"), F.struct(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("message")).alias("new"))


def typed(messages: DataFrame, row: T.StructType) -> DataFrame:
    """A change log of insertions from JSON values of a known type: topics with a schema registry."""
    return messages.select(F.lit("I").alias("_op"), F.col("offset").cast("long").alias("_seq"), F.lit(None).cast(row).alias("old"), F.from_json(F.col("value").cast("string"), row).alias("new"))


def landed(spark: SparkSession, folder: str, row: T.StructType, streaming: bool = False) -> DataFrame:
    """A change log from JSON lines {op, seq, old, new} as webhook and gRPC receivers land them; op is I, U or D."""
    kind = T.StructType([T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("old", row), T.StructField("new", row)])
    reader = spark.readStream if streaming else spark.read
    return reader.schema(kind).json(folder).select(F.upper("op").alias("_op"), F.col("seq").alias("_seq"), "old", "new")


def landed_arrow(spark: SparkSession, folder: str, row: T.StructType) -> DataFrame:
    """Rows of Arrow stream files as gRPC receivers of the Arrow adapter land them; columns are taken by name."""
    from sluice.shipping import ship

    ship(spark)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(row)
        for files in batches:
            for content in files.column("content"):
                with pa.ipc.open_stream(content.as_buffer()) as reader:
                    for b in reader:
                        yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in want], schema=want)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, row)


def webhook(bodies: DataFrame, table: str, row: T.StructType, method: str = "method", body: str = "body", seq: str = "seq") -> DataFrame:
    """A change log from requests: POST inserts and DELETE deletes the records listed under the table's name."""
    found = F.from_json(F.col(body), T.StructType([T.StructField(table, T.ArrayType(row))]))[table]
    each = bodies.select(F.upper(F.col(method)).alias("_m"), F.col(seq).cast("long").alias("_s"), F.posexplode(found).alias("_p", "_r")).where(F.col("_m").isin("POST", "DELETE"))
    none = F.lit(None).cast(row)
    ins = F.col("_m") == "POST"
    return each.select(F.when(ins, "I").otherwise("D").alias("_op"), (F.col("_s") * 1_000_000 + F.col("_p")).alias("_seq"), F.when(ins, none).otherwise(F.col("_r")).alias("old"), F.when(ins, F.col("_r")).otherwise(none).alias("new"))


def snowflake(rows: DataFrame, seq: str) -> DataFrame:
    """A change log from a stream table's rows: METADATA$ACTION is INSERT or DELETE."""
    own = [c for c in rows.columns if not c.upper().startswith("METADATA$") and c != seq]
    r, none = F.struct(*[F.col(f"`{c}`") for c in own]), F.lit(None).cast(rows.select(*[F.col(f"`{c}`") for c in own]).schema)
    ins = F.col("`METADATA$ACTION`") == "INSERT"
    return rows.select(F.when(ins, "I").otherwise("D").alias("_op"), F.col(seq).cast("long").alias("_seq"), F.when(ins, none).otherwise(r).alias("old"), F.when(ins, r).otherwise(none).alias("new"))


def mongodb(events: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """A change log of (_id, data), both JSON text, from change stream events; deletions know the _id alone."""
    path = lambda p: F.get_json_object(F.col(value), p)
    row = lambda data: F.struct(path("$.documentKey._id").alias("_id"), data.alias("data"))
    kind = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", T.StringType())])
    op = F.when(path("$.operationType") == "insert", "I").when(path("$.operationType").isin("update", "replace"), "U").when(path("$.operationType") == "delete", "D")
    out = events.select(op.alias("_op"), F.col(seq).cast("long").alias("_seq"), row(F.lit(None).cast("string")).cast(kind).alias("old"), row(path("$.fullDocument")).cast(kind).alias("new")).where("_op IS NOT NULL")
    none = F.lit(None).cast(kind)
    return out.withColumns({"old": F.when(F.col("_op") == "I", none).otherwise(F.col("old")), "new": F.when(F.col("_op") == "D", none).otherwise(F.col("new"))})


def as_table(changes: DataFrame, key: list[str] | None) -> DataFrame:
    return changelog.fold(changes, key)
