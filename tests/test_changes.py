"""Change logs, views and sinks; the result of the changes is always that of the table they make."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import aggregates, changelog, sets
from sluice.sinks import sinks
from sluice.sources import external, files, messages
from sluice.streaming.view import View, drained, retractable_counts

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.StringType()), T.StructField("v", T.LongType())])


def log(n, seed):
    rnd, now, out = random.Random(seed), {}, []
    for seq in range(n):
        key = rnd.randrange(12)
        row = (key, rnd.choice(["a", "b", None]), rnd.randrange(9))
        if key in now and rnd.random() < 0.4:
            out.append(("D", seq, now.pop(key), None))
        elif key in now:
            out.append(("U", seq, now[key], row))
            now[key] = row
        else:
            out.append(("I", seq, None, row))
            now[key] = row
    return out, sorted(now.values(), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_incremental_results(spark, seed):
    changes, table = log(80, seed)
    df = spark.createDataFrame(changes, changelog.schema(ROW))
    assert got(changelog.fold(df, ["id"])) == got(changelog.fold(df)) == table
    rows = changelog.signed(df)
    want = {}
    for _, g, v in table:
        n, s = want.get(g, (0, 0))
        want[g] = (n + 1, s + v)
    assert {r["g"]: (r["_count"], r["sum_v"]) for r in aggregates.signed_aggregates(rows, ["g"], ["v"]).collect()} == want
    extremes = {r["g"]: (r["min_v"], r["max_v"]) for r in aggregates.signed_extremes(rows, ["g"], "v").collect()}
    assert extremes == {g: (min(v for _, h, v in table if h == g), max(v for _, h, v in table if h == g)) for g in want}
    keys_alone = df.withColumn("old", F.when(F.col("_op") != "I", F.struct(F.coalesce("old", "new")["id"].alias("id"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("long").alias("v"))))
    assert got(changelog.with_old_images(keys_alone, ["id"]).select("_op", "_seq", "old", "new")) == got(df)


def test_key_changes_and_diff(spark):
    df = spark.createDataFrame([("I", 1, None, (1, "a", 1)), ("U", 2, (1, "a", 1), (2, "a", 1))], changelog.schema(ROW))
    assert got(changelog.fold(df, ["id"])) == [(2, "a", 1)]
    a, b = (spark.createDataFrame(x, "k long") for x in ([(1,), (1,), (2,)], [(1,), (3,)]))
    assert got(changelog.diff(a, b)) == [(1, -1), (2, -1), (3, 1)]
    assert got(sets.signed_union(a.withColumn("_sign", F.lit(1)), b.withColumn("_sign", F.lit(-1)))) == [(1,), (2,)]


def test_too_many_deletions_fail(spark):
    rows = spark.createDataFrame([("a", 1, -1)], "g string, v long, _sign int")
    with pytest.raises(Exception, match="more deletions"):
        aggregates.signed_aggregates(rows, ["g"], ["v"]).collect()
    changes = spark.createDataFrame([("D", 1, (1, "a", 1), None)], changelog.schema(ROW))
    with pytest.raises(Exception, match="append-only"):
        aggregates.append_only(changes).collect()


def test_ties_of_max_value(spark):
    df = spark.createDataFrame([("g", 1, "x", 1), ("g", 1, "y", 2), ("g", None, "z", 3)], "g string, k long, v string, seq long")
    assert got(df.groupBy("g").agg(aggregates.max_value("k", "v", "seq").alias("hi"), aggregates.min_value("k", "v", "seq").alias("lo"))) == [("g", "y", "y")]


def test_view_follows_its_changes(spark, tmp_path):
    changes, _ = log(60, 7)
    view = View(spark, str(tmp_path / "store"), {"t": (ROW, ["id"])}, lambda t: t["t"].groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")))
    write, seen = view.writer("t"), {}
    for b in range(3):
        write(spark.createDataFrame(changes[b * 20 : b * 20 + 20], changelog.schema(ROW)), b)
    write(spark.createDataFrame(changes[40:], changelog.schema(ROW)), 2)  # the same batch again
    for r in view.output().collect():
        seen[(r["g"], r["n"], r["top"])] = seen.get((r["g"], r["n"], r["top"]), 0) + r["_sign"]
    assert {k for k, n in seen.items() if n} == set(map(tuple, view.result().collect())) and set(seen.values()) <= {0, 1}


def test_retractable_counts_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    for k, rows in enumerate(([("a", 1.0, 1), ("b", 2.0, 1)], [("a", 1.0, -1), ("b", 5.0, 1)])):
        spark.createDataFrame(rows, "g string, v double, _sign int").coalesce(1).write.parquet(str(folder / f"p{k}"))
    stream = spark.readStream.schema("g string, v double, _sign int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = drained(retractable_counts(stream, "g", "v"), str(tmp_path / "work"), "update")
    net = out.groupBy("g").agg(F.sum(F.col("n") * F.col("_sign")).alias("n"), F.sum(F.col("total") * F.col("_sign")).alias("t")).where("n <> 0")
    assert got(net) == [("b", 2, 7.0)]


def test_sinks(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a", 1, 1), (1, "a", -1, 2), (1, "b", 1, 2), (2, "c", 1, 3)], "id long, v string, _sign int, _seq long")
    up = sinks.Upsert(spark, str(tmp_path / "t"), ["id"])
    up(changes, 0)
    up(changes, 0)
    assert got(up.table()) == [(1, "b"), (2, "c")]
    up(spark.createDataFrame([(2, "c", -1, 4), (3, "d", 1, 5)], changes.schema), 1)
    assert got(up.table()) == [(1, "b"), (3, "d")]
    strict = sinks.Upsert(spark, str(tmp_path / "p"), ["id"], on_delete="panic")
    with pytest.raises(Exception, match="conflict"):
        strict(spark.createDataFrame([(9, "c", -1, 4)], changes.schema), 0)
    assert sinks.signed_rows(changes).columns == ["id", "v", "sign"]
    with pytest.raises(Exception, match="no updates"):
        sinks.signed_rows(changes, collapsing=False).collect()
    ddl = sinks.clickhouse_ddl("t", ROW, ["id"])
    assert "`id` Int64" in ddl and "`g` Nullable(String)" in ddl and "`sign` Int8" in ddl and "ORDER BY (`id`)" in ddl
    noted = sinks.Replication(spark, str(tmp_path / "r"), "t")
    assert noted.last() == -1
    noted.took(4)
    assert noted.last() == 4
    dummy = sinks.Dummy()
    dummy(changes)
    assert dummy.rows == 4


def test_files_with_markers(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text(f"id,name\n{k},x\n")
    (tmp_path / "f1.done").write_text("")
    assert files.read(spark, str(tmp_path), "csv", extension=".csv", marker=".done").collect() == [(1, "x")]
    assert files.read(spark, str(tmp_path), "csv", ["id"], extension=".csv").count() == 2
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    stream = files.stream(spark, str(tmp_path), kind, "csv", extension=".csv")
    assert drained(stream, str(tmp_path / "work")).count() == 2
    poller = files.Marked(spark, str(tmp_path), kind, "csv", ".csv", ".done", str(tmp_path / "given"))
    assert poller.poll().collect() == [(1, "x")]
    poller.done()
    assert poller.poll() is None
    (tmp_path / "f0.done").write_text("")
    assert poller.poll().collect() == [(0, "x")]


def test_debezium(spark):
    fields = [{"field": "id", "type": "int64", "optional": False}, {"field": "d", "type": "int32", "name": "io.debezium.time.Date"}, {"field": "s", "type": "string"}]
    values = [
        '{"payload":{"before":null,"after":{"id":1,"d":0,"s":"x"},"op":"c"}}', '{"payload":{"before":null,"after":{"id":1,"d":1,"s":"y"},"op":"u"}}',
        '{"before":{"id":1,"d":1,"s":"y"},"after":null,"op":"d"}', '{"payload":{"before":null,"after":{"id":2,"d":3,"s":"z"},"op":"r"}}', None,
    ]
    df = spark.createDataFrame(list(enumerate(values)), "offset long, value string")
    out = messages.debezium(df, fields)
    assert [r["_op"] for r in out.orderBy("_seq").collect()] == ["I", "U", "D", "I"]
    assert [(r["id"], str(r["d"]), r["s"]) for r in changelog.fold(out, ["id"]).collect()] == [(2, "1970-01-04", "z")]
    plain = messages.plain(df.withColumn("key", F.lit("k")))
    assert plain.count() == 5 and plain.first()["new"]["key"] == "k"


def test_other_messages(spark, tmp_path):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    bodies = spark.createDataFrame([(1, "POST", '{"users":[{"id":1,"name":"a"},{"id":2,"name":"b"}]}'), (2, "DELETE", '{"users":[{"id":1,"name":"a"}]}')], "seq long, method string, body string")
    assert got(changelog.fold(messages.webhook(bodies, "users", kind), ["id"])) == [(2, "b")]
    (tmp_path / "x.json").write_text('{"op":"i","seq":1,"new":{"id":4,"name":"q"}}\n')
    assert got(changelog.fold(messages.landed(spark, str(tmp_path), kind), ["id"])) == [(4, "q")]
    snow = spark.createDataFrame([(1, "a", "INSERT", 1), (1, "a", "DELETE", 2), (1, "b", "INSERT", 3)], ["id", "name", "METADATA$ACTION", "seq"])
    assert got(changelog.fold(messages.snowflake(snow, "seq"))) == [(1, "b")]
    mongo = spark.createDataFrame([(1, '{"operationType":"insert","documentKey":{"_id":"5"},"fullDocument":{"a":1}}'), (2, '{"operationType":"delete","documentKey":{"_id":"5"}}'), (3, '{"operationType":"insert","documentKey":{"_id":"6"},"fullDocument":{"a":2}}')], "seq long, value string")
    assert got(changelog.fold(messages.mongodb(mongo), ["_id"])) == [("6", '{"a":2}')]
    assert external.generated(spark, "counting", lambda: [("1",), ("2",)]).count() == 2
    eth = spark.createDataFrame([('{"address":"0xaa","topics":["0x1"],"data":"0x0f","blockNumber":"0x10","logIndex":"0x2","removed":false}',)], "value string")
    assert [(int(r["id"]), int(r["block_number"]), bytes(r["data"])) for r in external.ethereum_logs(eth).collect()] == [(1600002, 16, b"\x0f")]
    trace = spark.createDataFrame([('[{"result":{"type":"CALL","from":"a","to":"b","value":"0x5","gas":"0x1","gasUsed":"0x1","calls":[{"type":"INNER","from":"b","to":"c","gas":"0x1","gasUsed":"0x1"}]}}]',)], "value string")
    assert [(r["type_field"], int(r["value"])) for r in external.ethereum_traces(trace).collect()] == [("CALL", 5), ("INNER", 0)]


def test_telemetry_counts(spark, tmp_path):
    from sluice.streaming.telemetry import Telemetry

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = Telemetry()
    spark.streams.addListener(seen)
    try:
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if seen.operations.get("counted") == 10:
                break
            time.sleep(0.1)
        assert seen.operations["counted"] == 10 and seen.pipeline_latency["counted"] >= 0
    finally:
        spark.streams.removeListener(seen)


def test_arrow_landing_files(spark, tmp_path):
    import pyarrow as pa

    batch = pa.record_batch({"name": ["a", None], "id": pa.array([1, 2], pa.int32())})
    with pa.ipc.new_stream(str(tmp_path / "x.arrows"), batch.schema) as w:
        w.write_batch(batch)
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert got(messages.landed_arrow(spark, str(tmp_path), kind)) == [(1, "a"), (2, None)]


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "k int, v string, _sign int, _seq long")

    path = str(tmp_path / "table")
    sinks.Upsert(spark, path, ["k"])(batch((1, "a", 1, 1), (2, "b", 1, 2)), 0)
    again = sinks.Upsert(spark, path, ["k"])
    again(batch((9, "no", 1, 3)), 0)  # the batch that was taken comes again
    again(batch((3, "c", 1, 4), (1, "a", -1, 5)), 1)
    last = sinks.Upsert(spark, path, ["k"])
    last(batch((2, "b", -1, 6), (2, "B", 1, 7)), 2)
    assert sorted(map(tuple, last.table().collect())) == [(2, "B"), (3, "c")]
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.is_dir()) == ["v1", "v2"]


def test_upserts_meet_null_keys(spark, tmp_path):
    table = sinks.Upsert(spark, str(tmp_path / "t"), ["g"])
    rows = lambda *r: spark.createDataFrame(r, "g string, v long, _sign int")
    table(rows((None, 1, 1), ("a", 2, 1)), 0)
    table(rows((None, 1, -1), (None, 5, 1)), 1)
    assert got(table.table()) == [("a", 2), (None, 5)]
    table(rows((None, 5, -1)), 2)
    assert got(table.table()) == [("a", 2)]
