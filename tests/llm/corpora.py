"""Small tables with every awkward case, and a DuckDB connection over them."""

import random

import duckdb
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def texts(n=60, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared, passage = line(12) + " The Shared Line", line(60)
    out = []
    for i in range(n):
        t = "\n".join(line(rnd.randint(1, 30)) for _ in range(rnd.randint(1, 6)))
        if i % 4 == 0:
            t += "\n  " + (shared.upper() if i % 8 else shared) + "\t"
        if i % 5 == 0:
            t = t + " " + passage + " " + line(4)
        out.append(t)
    out[3] = out[7]
    out[9] = out[7] + " x"
    out[11], out[12], out[13], out[14], out[15], out[16] = None, "", "one", " \t\n ", "É\x0bé  x", "\n\n"
    out[17] = "a " * 500
    out[18] = line(20_000)
    return out


def rows(seed=1):
    ts = texts(seed=seed)
    return [(i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", "s2", None, "S"][i % 5], len(t) if t is not None else None) for i, t in enumerate(ts)]


def docs(spark, own=None):
    return spark.createDataFrame(rows() if own is None else own, DOCS).repartition(3)


def clashing(df):
    """df with extra columns whose names operators could trip over."""
    from pyspark.sql import functions as F

    names = ["length", "start", "fingerprint", "key", "h1", "h2", "n", "a", "b", "pos", "size", "epochs", "target", "component_id", "_kept", "_n_lines", "_n_dropped", "count", "piece"]
    return df.withColumns({n: F.lit(f"extra {n}") for n in names if n not in df.columns})


def duck(own):
    import pyarrow as pa

    d = duckdb.connect()
    d.register("documents", pa.table({k: list(v) for k, v in zip(DOCS.names, zip(*own, strict=True), strict=True)}))
    return d
