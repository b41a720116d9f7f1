"""Applications that follow their sources: after every epoch, and over restarts, sinks hold what the script gives."""

import json

import pytest
from pyspark.sql import functions as F

from sluice import app
from sluice.sources import messages
from sluice.streaming.follow import Follower

YAML = """
home_dir: {data}/home
connections:
  - name: disk
    config: !LocalStorage
      details: {{path: {data}}}
      tables: [{{name: items, config: !CSV {{path: items, extension: .csv, {marker}}}}}]
  - name: hook
    config: !Webhook
      landing: {data}/hook
      schemas:
        users: {{schema: {{fields: [{{name: id, typ: Int, nullable: false}}, {{name: name, typ: String}}], primary_index: [0]}}}}
sources:
  - {{name: items, connection: disk}}
  - {{name: users, connection: hook}}
sql: SELECT u.name, SUM(i.price) AS total INTO totals FROM items i JOIN users u ON i.owner = u.id GROUP BY u.name;
sinks:
  - {{name: out, config: !Parquet {{table_name: totals, path: {data}/out, key: [name]}}}}
  - {{name: log, config: !Parquet {{table_name: totals, path: {data}/log}}}}
  - {{name: now, config: !Memory {{table_name: totals, view: totals_now}}}}
  - {{name: count, config: !Dummy {{table_name: totals}}}}
"""


def users(folder, name, *changes):
    (folder / "hook" / "users").mkdir(parents=True, exist_ok=True)
    rows = [{"op": op, "seq": seq, "old": old and {"id": old[0], "name": old[1]}, "new": new and {"id": new[0], "name": new[1]}} for op, seq, old, new in changes]
    (folder / "hook" / "users" / name).write_text("\n".join(map(json.dumps, rows)))


def items(folder, name, text):
    (folder / "items").mkdir(exist_ok=True)
    (folder / "items" / f"{name}.csv").write_text("owner,price\n" + text)
    (folder / "items" / f"{name}.done").write_text("")


def holds(spark, sinks, folder, want):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks["out"].table().select("name", "total")) == want
    assert rows(spark.table("totals_now").select("name", "total")) == want
    log = spark.read.parquet(str(folder / "log")).groupBy("name", "total").agg(F.sum("_sign").alias("n")).where("n <> 0")
    assert rows(log) == [(*w, 1) for w in want]


@pytest.mark.parametrize("marker", ["", "marker_extension: .done"])
def test_epochs_and_a_restart(spark, tmp_path, marker):
    items(tmp_path, "a", "1,2\n1,3\n2,7\n2,7\n")
    users(tmp_path, "a.json", ("I", 1, None, (1, "ann")), ("I", 2, None, (2, "bo")))
    config = app.load(YAML.format(data=tmp_path, marker=marker))
    follower, sinks = app.App(spark, config).follow()
    assert follower.step() and not follower.step()
    holds(spark, sinks, tmp_path, [("ann", 5), ("bo", 14)])
    users(tmp_path, "b.json", ("U", 3, (1, "ann"), (1, "cy")), ("D", 4, (2, "bo"), None))
    follower, sinks = app.App(spark, config).follow()  # a new process
    assert follower.step()
    holds(spark, sinks, tmp_path, [("cy", 5)])
    items(tmp_path, "b", "1,1\n3,4\n")
    users(tmp_path, "c.json", ("I", 5, None, (3, "di")))
    assert follower.step() and not follower.step()
    holds(spark, sinks, tmp_path, [("cy", 6), ("di", 4)])


@pytest.mark.parametrize("where", ["_fold", "_deliver"])
def test_a_stop_within_an_epoch(spark, tmp_path, monkeypatch, where):
    items(tmp_path, "a", "1,2\n")
    users(tmp_path, "a.json", ("I", 1, None, (1, "ann")))
    config = app.load(YAML.format(data=tmp_path, marker=""))
    follower, _ = app.App(spark, config).follow()
    assert follower.step()
    items(tmp_path, "b", "1,9\n")

    def stop(*_):
        raise KeyError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Follower, where, stop)
        with pytest.raises(KeyError):
            follower.step()
    follower, sinks = app.App(spark, config).follow()
    follower.step()
    holds(spark, sinks, tmp_path, [("ann", 11)])


def test_envelopes_of_a_topic_from_yaml(spark, monkeypatch):
    text = """
connections:
  - name: k
    config: !Kafka
      broker: none
      topics: {users: {key: [id], debezium: [{field: id, type: int64}, {field: name, type: string}]}}
sources: [{name: users, connection: k}]
sql: SELECT name INTO names FROM users;
sinks: [{name: out, config: !Dummy {table_name: names}}]
"""
    sent = [{"payload": {"op": op, "before": b and {"id": b[0], "name": b[1]}, "after": a and {"id": a[0], "name": a[1]}}} for op, b, a in [("c", None, (1, "ann")), ("c", None, (2, "bo")), ("u", (1, "ann"), (1, "cy")), ("d", (2, "bo"), None)]]
    monkeypatch.setattr(messages, "kafka", lambda spark, *_, **__: spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(sent)], "value string, offset long"))
    assert [tuple(r) for r in app.App(spark, app.load(text)).plan()["names"].collect()] == [("cy",)]
