"""Row types of discovery and content, and schemas made from a model's JSON Schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

_S = T.StringType()

URL_RECORD = T.StructType([
    T.StructField("url", _S, False), T.StructField("source", _S, False), T.StructField("lastmod", _S), T.StructField("changefreq", _S),
    T.StructField("priority", _S), T.StructField("discovered_at", _S),
])
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", _S), T.StructField("html", _S)])
CONTENT = T.StructType([T.StructField(n, _S) for n in ("url", "text", "raw_text", "title", "lang", "date")])


def strict_schema(schema: dict[str, Any]) -> dict[str, Any]:
    """A JSON Schema in which every property is required, formerly optional ones may be null, and no others are allowed."""
    out: dict[str, Any] = {}
    for key, value in schema.items():
        if key in ("$defs", "definitions"):
            out[key] = {k: strict_schema(v) for k, v in value.items()}
        elif key == "properties":
            needed = set(schema.get("required", ()))
            out[key] = {}
            for name, sub in value.items():
                sub = {k: v for k, v in strict_schema(sub).items() if k != "default"}
                out[key][name] = sub if name in needed or _nullable(sub) else {"anyOf": [sub, {"type": "null"}]}
        elif isinstance(value, dict):
            out[key] = strict_schema(value)
        elif isinstance(value, list):
            out[key] = [strict_schema(v) if isinstance(v, dict) else v for v in value]
        else:
            out[key] = value
    if "properties" in schema:
        out["required"] = list(schema["properties"])
        out["additionalProperties"] = False
    return out


def _nullable(schema: dict[str, Any]) -> bool:
    kind = schema.get("type")
    return kind == "null" or isinstance(kind, list) and "null" in kind or any(_nullable(s) for s in schema.get("anyOf", ()))


_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def spark_type(schema: dict[str, Any], defs: dict[str, Any] | None = None) -> T.DataType:
    """The Spark type of a JSON Schema; what has no fixed type is a string."""
    defs = defs or schema.get("$defs") or schema.get("definitions") or {}
    if "$ref" in schema:
        return spark_type(defs[schema["$ref"].rsplit("/", 1)[-1]], defs)
    options = [s for s in schema.get("anyOf", ()) if s.get("type") != "null"]
    if len(options) == 1:
        return spark_type(options[0], defs)
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None)
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {}), defs))
    if kind == "object" and "properties" in schema:
        needed = set(schema.get("required", ()))
        return T.StructType([T.StructField(n, spark_type(s, defs), n not in needed or _nullable(s)) for n, s in schema["properties"].items()])
    if kind == "object":
        return T.MapType(T.StringType(), T.StringType())
    return _SCALARS.get(kind, T.StringType())
