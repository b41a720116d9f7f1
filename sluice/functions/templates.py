"""SQL functions of the dialect as Spark SQL text. Each template takes the texts of its arguments, already rewritten."""

from __future__ import annotations

import re

from sluice.errors import PipelineError, UnsupportedExpression

_NUMBERS = "('tinyint','smallint','int','bigint','float','double')"

#: Strftime conversions and the patterns of Spark that mean the same.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "z": "xx", "Z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "%", "n": "\n", "t": "\t",
}


def java_pattern(strftime: str) -> str:
    """A strftime format as a datetime pattern of Spark; all else is quoted text."""
    out, plain = [], ""

    def quoted(text: str) -> str:
        return ("'" + text.replace("'", "''") + "'") if re.search(r"[A-Za-z']", text) else text

    for piece in re.split(r"(%[36]f|%.)", strftime):
        if piece.startswith("%") and len(piece) > 1:
            if piece[1:] not in STRFTIME:
                raise UnsupportedExpression(f"time format {piece}")
            if piece in ("%%", "%n", "%t"):
                plain += STRFTIME[piece[1:]]
                continue
            out += [quoted(plain), STRFTIME[piece[1:]]]
            plain = ""
        else:
            plain += piece
    return "".join([*out, quoted(plain)])


def extract(part: str, x: str) -> str:
    """Parts of a date or time: Monday is day 0 of the week; sub-second parts and EPOCH count from 1970; a century or
    decade is rounded up from the year; times are UTC."""
    part = part.upper()
    ts = f"CAST({x} AS TIMESTAMP)"
    plain = {"DAY", "MONTH", "YEAR", "HOUR", "MINUTE", "QUARTER", "DOY"}
    if part in plain:
        return f"CAST(extract({part} FROM {x if part not in ('HOUR', 'MINUTE') else ts}) AS BIGINT)"
    table = {
        "DOW": f"CAST(weekday({x}) AS BIGINT)",
        "SECOND": f"CAST(floor(extract(SECOND FROM {ts})) AS BIGINT)",
        "WEEK": f"CAST(weekofyear({x}) AS BIGINT)",
        "EPOCH": f"unix_seconds({ts})",
        "MILLISECOND": f"unix_millis({ts})",
        "MICROSECOND": f"unix_micros({ts})",
        "NANOSECOND": f"(unix_micros({ts}) * 1000)",
        "CENTURY": f"CAST(ceil(year({x}) / 100) AS BIGINT)",
        "DECADE": f"CAST(ceil(year({x}) / 10) AS BIGINT)",
        "TIMEZONE": "CAST(0 AS BIGINT)",
    }
    table |= {f"{k}S": v for k, v in table.items() if k.endswith("SECOND") and k != "SECOND"}
    if part not in table:
        raise UnsupportedExpression(f"EXTRACT({part})")
    return table[part]


#: Names of CAST targets.
CASTS = {
    "UINT": "DECIMAL(20,0)", "U128": "DECIMAL(38,0)", "I128": "DECIMAL(38,0)", "INT": "BIGINT", "INTEGER": "BIGINT", "BIGINT": "BIGINT", "INT8": "TINYINT", "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE", "REAL": "DOUBLE",
    "DECIMAL": "DECIMAL(38,10)", "NUMERIC": "DECIMAL(38,10)", "STRING": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "TIMESTAMP": "TIMESTAMP", "DATE": "DATE", "BINARY": "BINARY",
}


def as_text(x: str) -> str:
    """x as text: TRUE and FALSE, RFC 3339 times, POINT(x, y); all else as Spark casts it. typeof() is folded in planning."""
    plain = f"CAST({x} AS STRING)"
    if re.fullmatch(r"'(?:[^']|'')*'|[\d.]+", x):
        return plain
    time = f"date_format(try_cast({plain} AS TIMESTAMP_NTZ), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    time = f"concat(regexp_replace(regexp_replace({time}, '[.]000000$', ''), '([.][0-9]{{3}})000$', '$1'), '+00:00')"
    return f"CASE WHEN typeof({x}) = 'boolean' THEN upper({plain}) WHEN typeof({x}) LIKE 'timestamp%' THEN {time} WHEN typeof({x}) = 'struct<x:double,y:double>' THEN concat('POINT(', substr({plain}, 2, length({plain}) - 2), ')') ELSE {plain} END"


def cast(x: str, to: str, compat: bool) -> str:
    """CAST(x AS to). A number is true if above 0; an integer is a duration in nanoseconds; a text is parsed as JSON, or
    is a JSON string if it can't be. In compat mode NULL becomes 0, false or ''."""
    name, _, size = to.partition("(")
    name = name.strip().upper()
    if name in ("BOOLEAN", "BOOL"):
        out = f"CASE WHEN typeof({x}) IN {_NUMBERS} OR typeof({x}) LIKE 'decimal%' THEN try_cast({x} AS DOUBLE) > 0 ELSE CAST({x} AS BOOLEAN) END"
        return f"coalesce({out}, false)" if compat else f"({out})"
    if name == "JSON":
        return f"coalesce(try_parse_json(CAST({x} AS STRING)), CAST(CAST({x} AS STRING) AS VARIANT))"
    if name == "DURATION":
        return f"make_dt_interval(0, 0, 0, CAST({x} AS DECIMAL(28,9)) / 1000000000)"
    if name == "POINT":
        return x
    if name not in CASTS:
        raise UnsupportedExpression(f"CAST to {to}")
    kind = CASTS[name] if name not in ("DECIMAL", "NUMERIC") or not size else f"DECIMAL({size}"
    out = f"({as_text(x)})" if kind == "STRING" else f"CAST({x} AS {kind})"
    zero = "''" if kind == "STRING" else "0" if kind not in ("TIMESTAMP", "DATE", "BINARY") else None
    return f"coalesce({out}, CAST({zero} AS {kind}))" if compat and zero else out


def _need(args: list[str], least: int, most: int | None = None) -> None:
    if not least <= len(args) <= (most if most is not None else least):
        raise PipelineError(f"{len(args)} arguments where {least} to {most or least} are due")


def _literal(text: str) -> str:
    if not re.fullmatch(r"'(?:[^']|'')*'", text.strip()):
        raise UnsupportedExpression("this argument must be a text in quotes")
    return text.strip()[1:-1].replace("''", "'")


def _round(a):
    _need(a, 1, 2)
    digits = f"CAST({a[1]} AS INT)" if len(a) == 2 else "0"
    return f"if(typeof({a[0]}) LIKE 'decimal%', bround({a[0]}, {digits}), round({a[0]}, {digits}))"


def _substr(a):
    _need(a, 2, 3)
    start = f"greatest({a[1]}, -char_length({a[0]}))"
    if len(a) == 2:
        return f"substr({a[0]}, {start})"
    return f"CASE WHEN {a[2]} < 1 THEN NULL ELSE substr({a[0]}, {start}, {a[2]}) END"


def _chr(a):
    _need(a, 1)
    return f"CASE WHEN {a[0]} < 0 THEN raise_error('CHR of a negative number') ELSE chr({a[0]} % 256) END"


def _to_char(a):
    _need(a, 2)
    return f"date_format({a[0]}, '{java_pattern(_literal(a[1])).replace(chr(39), chr(92) + chr(39))}')"


def _point(a):
    _need(a, 2)
    return f"CASE WHEN {a[0]} IS NULL OR {a[1]} IS NULL THEN NULL ELSE named_struct('x', CAST({a[0]} AS DOUBLE), 'y', CAST({a[1]} AS DOUBLE)) END"


#: Metres: mean radius of the Earth.
RADIUS = 6371008.8


def haversine(p: str, q: str) -> str:
    lat1, lat2 = f"radians({p}.y)", f"radians({q}.y)"
    return f"(2 * {RADIUS}D * asin(sqrt(least(1D, pow(sin(({lat2} - {lat1}) / 2), 2) + cos({lat1}) * cos({lat2}) * pow(sin(radians({q}.x - {p}.x) / 2), 2)))))"


def _distance(a):
    _need(a, 2, 3)
    how = _literal(a[2]).upper() if len(a) == 3 else "GEODESIC"
    if how == "HAVERSINE":
        return haversine(a[0], a[1])
    if how in ("VINCENTY", "GEODESIC"):
        return f"sluice_{how.lower()}({a[0]}, {a[1]})"
    raise UnsupportedExpression(f"DISTANCE by {how}")


def _count(a, compat):
    return "count(1)" if a == ["*"] or (compat and not a[0].upper().startswith("DISTINCT")) else f"count({', '.join(a)})"


def _json(a, query: bool) -> str:
    """JSON_VALUE or JSON_QUERY. Plain paths, of names and places alone, stay on the JVM; filters, wildcards and slices
    take sluice.functions.python."""
    j, path = a[0], a[1] if len(a) > 1 else "'$'"
    if not re.fullmatch(r"'\$(?:\.[A-Za-z_]\w*|\[\d+\])*'", path.strip()):
        return f"sluice_json_{'query' if query else 'value'}({j}, {path})"
    text = f"CAST({j} AS STRING)"
    found = f"to_json(try_variant_get(try_parse_json({text}), {path}, 'variant'))"
    nested = f"left({found}, 1) IN ('{{', '[')"
    got = f"CASE WHEN {nested} THEN get_json_object({text}, {path}) ELSE 'null' END" if query else f"CASE WHEN {nested} THEN 'null' ELSE coalesce({found}, 'null') END"
    return f"(CASE WHEN try_parse_json({text}) IS NOT NULL THEN {got} END)"


def _by(f: str, a: list[str]) -> str:
    """The value a[1] where a[0] is largest or smallest; among equals that whose text is, so the order of rows tells nothing."""
    _need(a, 2)
    return f"{f}({a[1]}, CASE WHEN {a[0]} IS NOT NULL THEN struct({a[0]}, CAST({a[1]} AS STRING)) END)"


PLAIN = {
    "abs": lambda a: f"abs({a[0]})",
    "round": _round,
    "ucase": lambda a: f"upper({a[0]})",
    "concat": lambda a: f"concat_ws('', {', '.join(map(as_text, a))})" if a else "''",
    "length": lambda a: f"CAST(octet_length(CAST({a[0]} AS STRING)) AS BIGINT)",
    "chr": _chr,
    "substr": _substr,
    "substring": _substr,
    "replace": lambda a: f"replace({a[0]}, {a[1]}, {a[2]})",
    "to_char": _to_char,
    "nvl": lambda a: f"coalesce({a[0]}, {a[1]})",
    "decode": lambda a: f"decode({', '.join(a)})",
    "coalesce": lambda a: f"coalesce({', '.join(a)})",
    "nullif": lambda a: f"nullif({a[0]}, {a[1]})",
    "least": lambda a: f"least({', '.join(a)})",
    "now": lambda a: "current_timestamp()",
    "point": _point,
    "distance": _distance,
    "json_value": lambda a: _json([*a[:1], a[1]], False),
    "json_query": lambda a: _json(a, True),
}
AGGREGATES = {
    "count": _count,
    "sum": lambda a, compat: f"coalesce(sum({a[0]}), 0)" if compat else f"sum({a[0]})",
    "avg": lambda a, compat: f"(sum(coalesce({a[0]}, 0)) / count(1))" if compat else f"avg({a[0]})",
    "min": lambda a, compat: f"min({a[0]})",
    "max": lambda a, compat: f"max({a[0]})",
    "min_append_only": lambda a, compat: f"min({a[0]})",
    "max_append_only": lambda a, compat: f"max({a[0]})",
    "min_value": lambda a, compat: _by("min_by", a),
    "max_value": lambda a, compat: _by("max_by", a),
}
