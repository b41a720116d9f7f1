import json

import pytest
from pyspark.sql import types as T

from sluice import app
from sluice.errors import ConfigError, ContractError
from sluice.types import Schema, rendered, spark_type, type_name

YAML = """
app_name: shop
version: 1
home_dir: {home}
connections:
  - name: disk
    config: !LocalStorage
      details: {{path: {data}}}
      tables:
        - name: items
          config: !CSV {{path: items, extension: .csv}}
  - name: hook
    config: !Webhook
      landing: {data}/hook
      schemas:
        users: {{schema: {{fields: [{{name: id, typ: Int, nullable: false}}, {{name: name, typ: String}}], primary_index: [0]}}}}
sources:
  - {{name: items, table_name: items, connection: disk}}
  - {{name: users, table_name: users, connection: hook}}
sql: |
  SELECT u.name, SUM(i.price) AS total INTO totals FROM items i JOIN users u ON i.owner = u.id GROUP BY u.name;
sinks:
  - {{name: out, config: !Parquet {{table_name: totals, path: {data}/out}}}}
  - {{name: count, config: !Dummy {{table_name: totals}}}}
"""


@pytest.fixture
def text(tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "a.csv").write_text("owner,price\n1,2\n1,3\n2,7\n")
    (tmp_path / "hook" / "users").mkdir(parents=True)
    (tmp_path / "hook" / "users" / "x.json").write_text("\n".join(json.dumps(x) for x in [{"op": "I", "seq": 1, "new": {"id": 1, "name": "ann"}}, {"op": "U", "seq": 2, "old": {"id": 1}, "new": {"id": 1, "name": "bo"}}]))
    return YAML.format(home=tmp_path / "home", data=tmp_path)


def test_run_from_yaml(spark, text, tmp_path):
    done = app.App(spark, app.load(text)).run()
    assert done["count"].rows == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("bo", 5)]


def test_build_and_lock(spark, text):
    a = app.App(spark, app.load(text))
    with pytest.raises(ContractError):
        a.build(locked=True)
    a.build()
    a.build(locked=True)
    other = app.load(text, {"/sql": "SELECT u.name AS n INTO totals FROM users u"})
    with pytest.raises(ContractError):
        app.App(spark, other).build(locked=True)
    a.clean()


def test_wrong_configurations(spark, text):
    with pytest.raises(ConfigError):
        app.load(text + "\nnonsense: 1\n")
    with pytest.raises(ConfigError):
        app.load(text, {"/sources/0/connection": "none"})
    with pytest.raises(ConfigError):
        app.App(spark, app.load(text, {"/sql": "SELECT name INTO lost FROM users"})).plan()


def test_types_and_schemas(spark):
    schema = Schema.from_json({"schema": {"fields": [{"name": "id", "typ": "UInt", "nullable": False}, {"name": "p", "typ": "Point"}], "primary_index": [0]}})
    assert schema.key_names == ["id"] and Schema.from_json(schema.to_json()) == schema
    assert type_name(spark_type("duration")) == "Duration" and type_name(T.TimestampNTZType()) == "Timestamp"
    df = spark.sql("SELECT true AS b, TIMESTAMP '2020-01-01 00:00:00' AS t, named_struct('x', 1D, 'y', 2D) AS p, CAST(NULL AS INT) AS n")
    got = df.select(*[rendered(df[f.name], f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(got) == ("TRUE", "2020-01-01T00:00:00+00:00", "POINT(1.0, 2.0)", "")


def _field(number, value):
    """One protobuf field: an int as a varint, bytes, or text."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _model(width):
    """An ONNX model that sums the columns of a float matrix."""

    def tensor(name, columns):
        shape = _field(1, _field(2, "n")) + _field(1, _field(1, columns))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    axes = _field(1, "axes") + _field(8, 1) + _field(20, 7)
    node = _field(1, "x") + _field(2, "y") + _field(4, "ReduceSum") + _field(5, axes)
    graph = _field(1, node) + _field(2, "g") + _field(11, tensor("x", width)) + _field(12, tensor("y", 1))
    return _field(1, 6) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 11))


def test_functions_of_models_and_json(spark, tmp_path):
    from sluice.engine import Engine
    from sluice.udf import models

    (tmp_path / "sum.onnx").write_bytes(_model(2))
    engine = Engine(spark).udf("summed", models.onnx(str(tmp_path / "sum.onnx"))).udf("sorted_json", models.json_function("builtins", "sorted"))
    engine.table("m", spark.createDataFrame([(1.0, 2.5, "[3,1]"), (-1.0, 1.0, None)], "a double, b double, j string"))
    rows = engine.query("SELECT summed(a, b) AS s, sorted_json(j) AS j FROM m").collect()
    assert [tuple(r) for r in rows] == [(3.5, "[1, 3]"), (0.0, None)]


def test_tables_are_listed(spark, text):
    listed = app.App(spark, app.load(text)).list_tables()
    assert [f["name"] for f in listed["users"]["schema"]["fields"]] == ["id", "name"] and "items" in listed
