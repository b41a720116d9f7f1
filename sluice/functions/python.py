"""Functions that need Python: JSON paths and distances on the ellipsoid. All work on Arrow batches."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.jsonpath import find, shaped

#: The WGS 84 ellipsoid.
MAJOR, FLAT = 6378137.0, 1 / 298.257223563


def vincenty(x1: float, y1: float, x2: float, y2: float) -> float | None:
    """Metres along the ellipsoid by Vincenty's inverse formula (1975); None where it doesn't converge."""
    minor = MAJOR * (1 - FLAT)
    u1, u2 = (math.atan((1 - FLAT) * math.tan(math.radians(y))) for y in (y1, y2))
    want = lam = math.radians(x2 - x1)
    for _ in range(200):
        a, b = math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam)
        sin_s = math.hypot(a, b)
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_al = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_al = 1 - sin_al * sin_al
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_al if cos2_al else 0.0
        c = FLAT / 16 * cos2_al * (4 + FLAT * (4 - 3 * cos2_al))
        before, lam = lam, want + (1 - c) * FLAT * sin_al * (s + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        if abs(lam - before) < 1e-12:
            u = cos2_al * (MAJOR**2 - minor**2) / minor**2
            big_a = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
            big_b = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
            d = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid * mid - 1) - big_b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
            return minor * big_a * (s - d)
    return None


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def geodesic(x1: float, y1: float, x2: float, y2: float) -> float | None:
    """Metres along the geodesic: Bessel's equations on the auxiliary sphere, their integrals by Gauss-Legendre
    quadrature, the longitude by fixed-point iteration; Vincenty's series near antipodes, None where that fails too."""
    minor, second = MAJOR * (1 - FLAT), FLAT * (2 - FLAT) / (1 - FLAT) ** 2
    u1, u2 = (math.atan((1 - FLAT) * math.tan(math.radians(y))) for y in (y1, y2))
    want = omega = math.radians((x2 - x1 + 540) % 360 - 180)
    for _ in range(200):
        a, b = math.cos(u2) * math.sin(omega), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(omega)
        if math.hypot(a, b) == 0:
            return 0.0
        sigma = math.atan2(math.hypot(a, b), math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(omega))
        start = math.atan2(a, b)  # azimuth at the first point
        sin0 = math.sin(start) * math.cos(u1)
        k2 = second * (1 - sin0 * sin0)
        from_node = math.atan2(math.sin(u1), math.cos(start) * math.cos(u1))
        at = from_node + sigma / 2 * (_NODES + 1)
        root = np.sqrt(1 + k2 * np.sin(at) ** 2)
        before, omega = omega, want + FLAT * sin0 * sigma / 2 * float((_WEIGHTS * (2 - FLAT) / (1 + (1 - FLAT) * root)).sum())
        if abs(omega) > math.pi:
            break
        if abs(omega - before) < 1e-14:
            return minor * sigma / 2 * float((_WEIGHTS * root).sum())
    return vincenty(x1, y1, x2, y2)


def _metres(f):
    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in r) else f(*r) for r in zip(p["x"], p["y"], q["x"], q["y"], strict=True)], dtype="float64")

    return run


def _json(one):
    def run(j: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or p is None else one(x, p) for x, p in zip(j, path, strict=True)], dtype=object)

    return run


def json_value(text: str, path: str) -> str | None:
    """The scalar at path as JSON text; JSON null if there is none or it isn't a scalar; None for a bad path."""
    try:
        got = shaped(find(path, json.loads(text)))
    except ValueError:
        return None
    return json.dumps(None if isinstance(got, (dict, list)) else got, ensure_ascii=False)


def json_query(text: str, path: str) -> str | None:
    """The object or array at path as JSON text, several matches as an array; JSON null for none or a scalar."""
    try:
        got = shaped(find(path, json.loads(text)))
    except ValueError:
        return None
    return json.dumps(got if isinstance(got, (dict, list)) else None, ensure_ascii=False, separators=(",", ":"))


def register(spark: SparkSession) -> None:
    for name, f in (("sluice_vincenty", vincenty), ("sluice_geodesic", geodesic)):
        spark.udf.register(name, F.pandas_udf(_metres(f), T.DoubleType()))
    for name, f in (("sluice_json_value", json_value), ("sluice_json_query", json_query)):
        spark.udf.register(name, F.pandas_udf(_json(f), T.StringType()))
