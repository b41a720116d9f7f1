"""User functions from configuration: ONNX models and functions of one JSON value."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def onnx(path: str):
    """A Spark function that feeds its arguments, one column of numbers each, to a model with one output; the result is
    a double. The session is opened once per worker, and takes whole Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        inputs = session.get_inputs()
        kinds = {"tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int64)": np.int64, "tensor(int32)": np.int32}
        for columns in batches:
            if len(inputs) == len(columns) and len(inputs) > 1:
                feed = {i.name: c.to_numpy().astype(kinds[i.type]).reshape(-1, 1) for i, c in zip(inputs, columns, strict=True)}
            else:
                feed = {inputs[0].name: np.column_stack([c.to_numpy() for c in columns]).astype(kinds[inputs[0].type])}
            yield pd.Series(np.asarray(session.run(None, feed)[0], np.float64).reshape(len(columns[0]), -1)[:, 0])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


def json_function(module: str, name: str = "run"):
    """A Spark function from JSON text to JSON text: `name` of a Python module, given and giving plain values."""

    def run(values: pd.Series) -> pd.Series:
        f = getattr(importlib.import_module(module), name)
        return pd.Series([None if v is None else json.dumps(f(json.loads(v)), ensure_ascii=False) for v in values], dtype=object)

    return F.pandas_udf(run, T.StringType())
