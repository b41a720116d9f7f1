"""Sources that need a server or a package: each is a reader that Spark loads when it is used."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A snapshot of a table of Postgres or MySQL; with a numeric key and bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def package(spark: SparkSession, format: str, streaming: bool = False, **options: str) -> DataFrame:
    """A table of a connector package: mongodb, snowflake, delta."""
    return (spark.readStream if streaming else spark.read).format(format).options(**options).load()


def generated(spark: SparkSession, name: str, rows, schema: str = "value string") -> DataFrame:
    """A table from a Python generator of rows, run where Spark plans the read: a user's own source."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def read(self, partition) -> Iterator[tuple]:
            yield from rows()

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


#: Fields of a log and of a trace as Ethereum's JSON-RPC names them.
LOG = "struct<address:string,topics:array<string>,data:string,blockHash:string,blockNumber:string,transactionHash:string,transactionIndex:string,logIndex:string,transactionLogIndex:string,logType:string,removed:boolean>"


def _number(c):
    return F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("decimal(20,0)")


def ethereum_logs(messages: DataFrame, value: str = "value") -> DataFrame:
    """Rows of eth_logs from JSON-RPC log objects; quantities in hexadecimal become numbers. id orders by block and place."""
    v = F.from_json(value, LOG)
    block, place = _number(v["blockNumber"]), _number(v["logIndex"])
    return messages.select(
        (block * 100000 + place).cast("decimal(20,0)").alias("id"), v["address"].alias("address"), F.to_json(v["topics"]).alias("topics"), F.unhex(F.regexp_replace(v["data"], "^0x", "")).alias("data"), v["blockHash"].alias("block_hash"), block.alias("block_number"),
        v["transactionHash"].alias("transaction_hash"), _number(v["transactionIndex"]).alias("transaction_index"), place.alias("log_index"), _number(v["transactionLogIndex"]).alias("transaction_log_index"), v["logType"].alias("log_type"), v["removed"].alias("removed"),
    )


def ethereum_traces(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Rows of traces from the JSON of call trees, nested calls flattened in order of the tree, at any depth."""

    def run(batches):
        import json

        import pandas as pd

        def flat(call):
            out, todo = [], [call]
            while todo:
                c = todo.pop()
                out.append(c)
                todo += reversed(c.get("calls") or [])
            return out

        number = lambda h: int(h, 16) if h else 0
        for pdf in batches:
            rows = [(c.get("type"), c.get("from"), c.get("to"), number(c.get("value")), number(c.get("gas")), number(c.get("gasUsed")), c.get("input"), c.get("output")) for v in pdf[value] for r in json.loads(v) for c in flat(r.get("result", r))]
            yield pd.DataFrame(rows, columns=["type_field", "from", "to", "value", "gas", "gas_used", "input", "output"]).astype({"value": str, "gas": str, "gas_used": str})

    out = blocks.select(value).mapInPandas(run, "type_field string, `from` string, `to` string, value string, gas string, gas_used string, input string, output string")
    return out.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("value", "gas", "gas_used")})
