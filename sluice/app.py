"""Applications: a YAML description of connections, sources, a script and sinks, and commands to build and run it."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from sluice.engine import Engine
from sluice.errors import ConfigError, ContractError
from sluice.sinks import sinks as out
from sluice.operators import changelog
from sluice.sources import external, files, messages
from sluice.streaming.follow import Feed, Follower
from sluice.types import Schema


@dataclass
class Tagged:
    tag: str
    value: object


class _Loader(yaml.SafeLoader):
    pass


def _tagged(loader, suffix, node):
    value = loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node)
    return Tagged(suffix, value)


_Loader.add_multi_constructor("!", _tagged)

KEYS = {"version", "id", "company_id", "app_name", "home_dir", "connections", "sources", "sinks", "api", "sql", "flags", "app", "telemetry", "udfs", "lambdas"}
CONNECTIONS = {"Postgres", "MySQL", "MongoDB", "Ethereum", "Grpc", "Snowflake", "Kafka", "S3Storage", "LocalStorage", "DeltaLake", "Webhook", "JavaScript", "Oracle", "Aerospike"}
SINKS = {"Dummy", "Clickhouse", "Parquet", "Memory", "Oracle", "Aerospike"}


@dataclass
class Config:
    version: int = 1
    app_name: str = ""
    home_dir: str = ".sluice"
    connections: dict[str, Tagged] = field(default_factory=dict)
    sources: list[dict] = field(default_factory=list)
    sinks: list[dict] = field(default_factory=list)
    sql: str = ""
    udfs: list[dict] = field(default_factory=list)
    flags: dict = field(default_factory=dict)
    app: dict = field(default_factory=dict)


def load(text: str, overrides: dict[str, object] | None = None) -> Config:
    """A configuration from YAML. overrides: values by JSON pointer, as /sinks/0/name. Unknown keys are errors."""
    raw = yaml.load(text, _Loader) or {}
    for pointer, value in (overrides or {}).items():
        at = raw
        *way, last = [p.replace("~1", "/").replace("~0", "~") for p in pointer.strip("/").split("/")]
        for p in way:
            at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
        at[int(last) if isinstance(at, list) else last] = value
    if unknown := set(raw) - KEYS:
        raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
    connections = {}
    for c in raw.get("connections") or []:
        if not isinstance(c.get("config"), Tagged) or c["config"].tag not in CONNECTIONS:
            raise ConfigError(f"connection {c.get('name')}: no such kind")
        connections[c["name"]] = c["config"]
    sources = raw.get("sources") or []
    for s in sources:
        if s.get("connection") not in connections:
            raise ConfigError(f"source {s.get('name')}: no connection {s.get('connection')}")
    sinks = raw.get("sinks") or []
    for s in sinks:
        if not isinstance(s.get("config"), Tagged) or s["config"].tag not in SINKS:
            raise ConfigError(f"sink {s.get('name')}: no such kind")
    return Config(raw.get("version", 1), raw.get("app_name", ""), raw.get("home_dir", ".sluice"), connections, sources, sinks, raw.get("sql") or "", raw.get("udfs") or [], raw.get("flags") or {}, raw.get("app") or {})


def _table(sink: dict) -> str:
    """The name of the table that a sink takes."""
    v = sink["config"].value if isinstance(sink["config"].value, dict) else {}
    return v.get("table_name") or sink["table_name"]


class App:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.engine = Engine(spark, extended=bool(config.flags.get("extended")), compat=bool(config.flags.get("compat")))
        for u in config.udfs:
            from sluice.udf import models

            kind = u["config"]
            self.engine.udf(u["name"], models.onnx(kind.value["path"]) if kind.tag == "Onnx" else models.json_function(kind.value["module"]))

    def _files(self, s: dict) -> tuple[str, str, dict]:
        """Folder, kind and options of a table of files."""
        c, name = self.config.connections[s["connection"]], s.get("table_name") or s["name"]
        own = next((t for t in c.value["tables"] if t["name"] == name), None)
        if own is None:
            raise ConfigError(f"no table {name} in connection {s['connection']}")
        if c.tag == "DeltaLake":
            return own["path"], "delta", {}
        details, o = c.value["details"], own["config"].value
        root = details["path"] if c.tag == "LocalStorage" else f"s3a://{details['bucket_name']}"
        return os.path.join(root, o.get("path", "")), own["config"].tag.lower(), o

    def _changes(self, s: dict, streaming: bool) -> tuple[DataFrame, list[str] | None] | None:
        """The change log of a source that has one, and its key."""
        c, name = self.config.connections[s["connection"]], s.get("table_name") or s["name"]
        v = c.value if isinstance(c.value, dict) else {}
        if c.tag in ("Webhook", "Grpc"):
            schema = Schema.from_json(v["schemas"][name])
            return messages.landed(self.spark, os.path.join(v["landing"], name), schema.fields, streaming), schema.key_names
        if c.tag == "Kafka":
            read = messages.kafka(self.spark, v["broker"], name, streaming=streaming)
            own = (v.get("topics") or {}).get(name) or {}
            if own.get("debezium"):  # the fields of the envelope's rows
                return messages.debezium(read, own["debezium"]), own.get("key")
            if own.get("schema"):
                return messages.typed(read, Schema.from_json({"schema": own["schema"]}).fields), None
            return messages.plain(read), None
        return None

    def _source(self, s: dict) -> DataFrame:
        c, name = self.config.connections[s["connection"]], s.get("table_name") or s["name"]
        v = c.value if isinstance(c.value, dict) else {}
        columns = s.get("columns") or None
        if c.tag in ("LocalStorage", "S3Storage", "DeltaLake"):
            path, kind, o = self._files(s)
            return files.read(self.spark, path, kind, columns, extension=o.get("extension"), marker=o.get("marker_extension"))
        if found := self._changes(s, streaming=False):
            return messages.as_table(*found)
        if c.tag in ("Postgres", "MySQL"):
            return external.jdbc(self.spark, v["url"], name, **{k: str(x) for k, x in (v.get("options") or {}).items()})
        if c.tag in ("MongoDB", "Snowflake"):
            return external.package(self.spark, c.tag.lower(), **{k: str(x) for k, x in v.items()})
        raise ConfigError(f"{c.tag} is not built")

    def _feed(self, s: dict) -> Feed:
        """A source as follow() takes it: message logs and folders of files as streams, all else as one snapshot."""
        if found := self._changes(s, streaming=True):
            return Feed(*found)
        if self.config.connections[s["connection"]].tag in ("LocalStorage", "S3Storage"):
            path, kind, o = self._files(s)
            if kind in ("csv", "parquet"):
                if marker := o.get("marker_extension"):
                    schema = self._source(s).schema
                    return Feed(files.Marked(self.spark, path, schema, kind, o.get("extension") or f".{kind}", marker, f"{self.home}/given/{s['name']}"))
                schema = files.read(self.spark, path, kind, extension=o.get("extension")).schema
                return Feed(changelog.inserts(files.stream(self.spark, path, schema, kind, s.get("columns") or None, o.get("extension"))))
        return Feed(changelog.inserts(self._source(s)))

    def list_tables(self) -> dict[str, dict]:
        """The sources by name and their schemas, as their connections give them; no data is read beyond that."""
        return {s["name"]: Schema(self._source(s).schema).to_json() for s in self.config.sources}

    def plan(self, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The output tables. Each sink's table is an output or a source; each output has a sink. `tables` has the sources
        as they are; else they are read."""
        for s in self.config.sources:
            self.engine.table(s["name"], self._source(s) if tables is None else tables[s["name"]])
        made = self.engine.run(self.config.sql) if self.config.sql.strip() else {}
        used = {_table(s) for s in self.config.sinks}
        if lost := set(made) - used:
            raise ConfigError(f"no sink for {', '.join(sorted(lost))}")
        known = {s["name"] for s in self.config.sources}
        if missing := used - set(made) - known:
            raise ConfigError(f"no table {', '.join(sorted(missing))}")
        return made | {n: self.spark.table(n) for n in used - set(made)}

    def contract(self) -> dict:
        return {name: json.loads(df.schema.json()) for name, df in sorted(self.plan().items())}

    def build(self, locked: bool = False) -> None:
        path = os.path.join(self.config.home_dir, "sluice.lock")
        now = self.contract()
        if locked:
            if not os.path.exists(path):
                raise ContractError("no lock file")
            with open(path) as f:
                if json.load(f) != now:
                    raise ContractError("the schema is not the one in the lock file")
            return
        os.makedirs(self.config.home_dir, exist_ok=True)
        with open(path, "w") as f:
            json.dump(now, f, indent=1)

    def run(self) -> dict[str, object]:
        tables, done = self.plan(), {}
        for s in self.config.sinks:
            kind = s["config"]
            v = kind.value if isinstance(kind.value, dict) else {}
            df = tables[_table(s)]
            name = s.get("name") or v.get("table_name")
            if kind.tag == "Dummy":
                sink = out.Dummy()
                sink(df)
                done[name] = sink
            elif kind.tag == "Parquet":
                df.write.mode("overwrite").parquet(v["path"])
                done[name] = v["path"]
            elif kind.tag == "Memory":
                df.createOrReplaceTempView(v.get("view") or name)
                done[name] = df
            elif kind.tag == "Clickhouse":
                from pyspark.sql import functions as F

                out.jdbc_writer(v["database_url"], v["sink_table_name"])(df.withColumn("_sign", F.lit(1)), 0)
                done[name] = v["sink_table_name"]
            else:
                raise ConfigError(f"{kind.tag} is not built")
        return done

    @property
    def home(self) -> str:
        """Where follow() keeps its tables; on a cluster home_dir must be a folder that executors share."""
        return f"{self.config.home_dir}/follow"

    def _writer(self, s: dict):
        """A sink as follow() writes it, and what run() would return for it. Parquet with `key` is a table kept by key;
        without, the signed rows of each epoch."""
        kind = s["config"]
        v = kind.value if isinstance(kind.value, dict) else {}
        name = s.get("name") or v.get("table_name")
        if kind.tag == "Dummy":
            sink = out.Dummy()
            return (lambda changes, result, epoch: sink(changes, epoch)), sink
        if kind.tag == "Parquet" and v.get("key"):
            sink = out.Upsert(self.spark, v["path"], v["key"], **{f"on_{k}": p for k, p in (v.get("conflicts") or {}).items()})
            return (lambda changes, result, epoch: sink(changes, epoch)), sink
        if kind.tag == "Parquet":
            return (lambda changes, result, epoch: changes.write.mode("overwrite").parquet(f"{v['path']}/epoch={epoch}")), v["path"]
        if kind.tag == "Memory":
            view = v.get("view") or name
            return (lambda changes, result, epoch: result.createOrReplaceTempView(view)), view
        if kind.tag == "Clickhouse":
            write = out.jdbc_writer(v["database_url"], v["sink_table_name"], replication=out.Replication(self.spark, f"{self.home}/replication", name))
            return (lambda changes, result, epoch: write(changes, epoch)), v["sink_table_name"]
        raise ConfigError(f"{kind.tag} is not built")

    def follow(self) -> tuple[Follower, dict[str, object]]:
        """A Follower of the application, to step() or run(), and its sinks by name. It goes on where the last one stopped."""
        made = [(s, self._writer(s)) for s in self.config.sinks]
        feeds = {s["name"]: self._feed(s) for s in self.config.sources}
        follower = Follower(self.spark, self.home, feeds, self.plan, [(_table(s), write) for s, (write, _) in made])
        return follower, {s.get("name") or _table(s): sink for s, (_, sink) in made}

    def clean(self) -> None:
        shutil.rmtree(self.config.home_dir, ignore_errors=True)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("command", choices=["run", "build", "clean"])
    p.add_argument("-c", "--config", default="sluice.yaml")
    p.add_argument("--config-overrides", action="append", default=[], metavar="/POINTER=JSON")
    p.add_argument("--locked", action="store_true")
    p.add_argument("--follow", action="store_true", help="run: go on with what comes, until stopped")
    a = p.parse_args(args)
    with sys.stdin if a.config == "-" else open(a.config) as f:
        config = load(f.read(), {k: json.loads(v) for k, v in (o.split("=", 1) for o in a.config_overrides)})
    if a.command == "clean":
        shutil.rmtree(config.home_dir, ignore_errors=True)
        return 0
    app = App(SparkSession.builder.appName(config.app_name or "sluice").getOrCreate(), config)
    if a.command == "build":
        app.build(a.locked)
    elif a.follow:
        app.follow()[0].run()
    else:
        app.run()
    return 0


if __name__ == "__main__":
    sys.exit(main())
