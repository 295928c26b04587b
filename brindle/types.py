"""The six column types, their names, and casts between them."""

from __future__ import annotations

NAMES = {"BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "INT64": "BIGINT", "INTEGER": "BIGINT", "BIGINT": "BIGINT", "INT": "BIGINT", "DOUBLE": "DOUBLE", "FLOAT64": "DOUBLE", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP_NTZ", "STRING": "STRING", "VARCHAR": "STRING"}


def spark_type(name: str) -> str:
    """Spark's name of a type; INTEGER has 64 bits."""
    if name.strip().upper() not in NAMES:
        raise ValueError(f"type {name.strip()} is not supported")
    return NAMES[name.strip().upper()]


def cast(x: str, to: str) -> str:
    """SQL of a cast; one that can't be done raises.

    Strings are BOOLEAN only as ``true`` and ``false``; dates are ``yyyy-MM-dd``; a
    DOUBLE prints without exponent and trailing zeros, a TIMESTAMP as RFC 3339.
    """
    to = spark_type(to)
    text = f"cast({x} as string)"
    if to == "STRING":
        plain = f"(case when isnan(try_cast({text} as double)) or abs(try_cast({text} as double)) >= 1e19 then {text} else regexp_replace(cast(try_cast({text} as decimal(38,18)) as string), '\\\\.?0+$', '') end)"
        moment = f"try_cast({text} as timestamp)"
        micros = f"pmod(unix_micros({moment}), 1000000)"
        fraction = f"(case when {micros} = 0 then '' when {micros} % 1000 = 0 then date_format({moment}, '.SSS') else date_format({moment}, '.SSSSSS') end)"
        return f"(case when typeof({x}) = 'double' then {plain} when typeof({x}) like 'timestamp%' then concat(date_format({moment}, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), {fraction}, '+00:00') else {text} end)"
    if to == "BOOLEAN":
        strict = f"(case {text} when 'true' then true when 'false' then false else raise_error(concat('not a BOOL: ', {text})) end)"
        return f"(case when ({x}) is null then null when typeof({x}) = 'string' then {strict} else cast({x} as boolean) end)"
    if to == "DATE":
        fine = f"typeof({x}) <> 'string' or regexp_like({text}, '^\\\\d{{1,4}}-\\\\d{{1,2}}-\\\\d{{1,2}}$')"
        return f"(case when ({x}) is null then null when {fine} then cast({x} as date) else raise_error(concat('not a DATE: ', {text})) end)"
    return f"cast({x} as {to})"
