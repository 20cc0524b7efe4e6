"""Scalar functions over text: durations, sets as keys, truncation, humanized numbers, strict JSON, JSON Schema, errors."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Units of a duration in microseconds (nanoseconds are below the resolution).
UNITS = {"us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
DURATION = r"^[+-]?(0|(([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h))+)$"
PART = r"([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|µs|ms|s|m|h)"


def duration_micros(text: Column) -> Column:
    """'1h30m', '1.5s', '-2ms' in microseconds; null if it is malformed."""
    parts = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    number = lambda p: F.regexp_extract(p, PART, 1).cast("decimal(20,6)")
    unit = lambda p: F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.regexp_extract(p, PART, 2)]
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,6)"), lambda acc, p: (acc + F.coalesce(number(p) * unit(p), number(p) / 1000)).cast("decimal(38,6)"))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(DURATION), signed.cast("long"))


def set_key(items: Column, separator: str = "\0") -> Column:
    """Equal for equal sets, whatever their order and repeats."""
    return F.array_join(F.array_sort(F.array_distinct(items)), separator)


def truncate_utf8(text: Column | str, most: Column | str) -> Column:
    """At most so many bytes, without a broken character at the end: cut before the character that the limit would part."""
    text, most = (F.col(c) if isinstance(c, str) else c for c in (text, most))
    raw = F.encode(text, "utf-8")
    byte = lambda i: F.hex(F.substring(raw, i + 1, F.lit(1)))  # noqa: E731  the byte after the first i
    inside = lambda i: byte(i).between("80", "BF")  # noqa: E731  a character has at most three of these
    cut = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).when(most <= 0, "").otherwise(F.decode(F.substring(raw, F.lit(1), cut), "utf-8"))


def _short(x: Column) -> Column:
    """Four significant digits, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4g", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def humanize_percentage(x: Column) -> Column:
    return F.concat(_short(x * 100), F.lit("%"))


def humanize_duration(seconds: Column) -> Column:
    """'1d 2h 3m 4s' from a minute on, else seconds."""
    s = F.floor(seconds)
    unit = lambda n, m, name: F.when(s >= n, F.concat((F.floor(s / n) % m if m else F.floor(s / n)).cast("string"), F.lit(name)))
    long = F.concat_ws(" ", unit(86_400, None, "d"), unit(3_600, 24, "h"), unit(60, 60, "m"), F.concat((s % 60).cast("string"), F.lit("s")))
    return F.when(seconds >= 60, long).otherwise(F.concat(_short(seconds), F.lit("s")))


#: Errors of the domain by what an HTTP client is told.
ERRORS = {"not_found": (404, "not_found"), "conflict": (409, "conflict"), "invalid": (400, "invalid_request"), "key_reused": (422, "idempotency_key_reused"), "quota": (429, "quota_exceeded"), "rate": (429, "rate_limited"), "overloaded": (503, "overloaded"), "unavailable": (503, "unavailable"), "forbidden": (403, "forbidden")}


def error_status(error: Column) -> Column:
    """struct(status, code); 500 for what is not known."""
    status = F.create_map(*(F.lit(x) for k, (s, _) in ERRORS.items() for x in (k, s)))
    code = F.create_map(*(F.lit(x) for k, (_, c) in ERRORS.items() for x in (k, c)))
    return F.struct(F.coalesce(status[error], F.lit(500)).alias("status"), F.coalesce(code[error], F.lit("internal")).alias("code"))


def _unknown(value: Column, kind: T.DataType, at: str) -> list[Column]:
    """For each object of a schema, wherever it lies, the first field that the schema lacks."""
    if isinstance(kind, T.StructType):
        extra = F.array_except(F.json_object_keys(value), F.array(*(F.lit(f) for f in kind.names)))
        found = [F.when(F.size(extra) > 0, F.concat(F.lit(at), extra[0]))]
        for f in kind.fields:
            found += _unknown(F.get_json_object(value, f"$['{f.name}']"), f.dataType, f"{at}{f.name}.")
        return found
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        items = F.from_json(value, T.ArrayType(T.StringType()))
        inner = F.transform(items, lambda x: F.coalesce(*_unknown(x, kind.elementType, f"{at}[]."), F.lit(None).cast("string")))
        return [F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0))]
    return []


def strict_json(body: Column, schema: T.StructType, most: int = 1 << 20) -> Column:
    """struct(value, error): the body as ``schema``; too large, malformed, with a field anywhere that is not known, or with a value of another type is an error; nothing at all is an empty object."""
    text = F.when(F.trim(body) == "", F.lit("{}")).otherwise(body)
    unknown = F.coalesce(*_unknown(text, schema, ""), F.lit(None).cast("string"))
    wrong = "__wrong"  # set where a value does not fit its type
    read = F.from_json(text, T.StructType([*schema.fields, T.StructField(wrong, T.StringType())]), {"columnNameOfCorruptRecord": wrong})
    error = (
        F.when(F.octet_length(body) > most, "body too large")
        .when(F.json_object_keys(text).isNull(), "malformed JSON")
        .when(unknown.isNotNull(), F.concat(F.lit("unknown field "), unknown))
        .when(read[wrong].isNotNull(), "a value of another type")
    )
    return F.struct(F.when(error.isNull(), F.from_json(text, schema)).alias("value"), error.alias("error"))


# -- JSON Schema -------------------------------------------------------------------

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return isinstance(value, _KINDS[kind])


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def _branches(schema):
    """A schema and all schemas in it."""
    if isinstance(schema, dict):
        yield schema
        for v in schema.values():
            yield from _branches(v)
    elif isinstance(schema, list):
        for v in schema:
            yield from _branches(v)


def _referred(root, ref: str):
    """What a reference within the schema names. ValueError for others."""
    if not ref.startswith("#") or (len(ref) > 1 and ref[1] != "/"):
        raise ValueError(f"reference {ref!r} leaves the schema")
    for part in ref[2:].split("/") if len(ref) > 1 else []:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            root = root[int(part) if isinstance(root, list) else part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"reference {ref!r} names nothing") from None
    return root


#: Keywords whose target depends on the path by which a schema was reached.
REFUSED = ("$dynamicRef", "$recursiveRef")


def check_schema(schema) -> None:
    """ValueError if any branch refers beyond the schema or has a keyword that is not supported, whatever values come."""
    for branch in _branches(schema):
        if isinstance(branch.get("$ref"), str):
            _referred(schema, branch["$ref"])
        if found := [k for k in REFUSED if k in branch]:
            raise ValueError(f"{found[0]} is not supported")


def _looked_at(value, schema, root, depth: int) -> set:
    """Names or places of a value's parts that a schema, and those in it that the value keeps, say something about."""
    if not isinstance(schema, dict) or not isinstance(value, (dict, list)):
        return set()
    if depth > 100:
        raise ValueError("references go in circles")
    keeps = lambda s: not schema_errors(value, s, "", root, depth + 1)
    apply = list(schema.get("allOf", []))
    if isinstance(schema.get("$ref"), str):
        apply.append(_referred(root, schema["$ref"]))
    apply += [s for key in ("anyOf", "oneOf") for s in schema.get(key, []) if keeps(s)]
    if "if" in schema:
        apply += [schema["if"], schema.get("then", True)] if keeps(schema["if"]) else [schema.get("else", True)]
    if isinstance(value, dict):
        seen = {n for n in value if n in schema.get("properties", {}) or any(re.search(p, n) for p in schema.get("patternProperties", {}))}
        if "additionalProperties" in schema or "unevaluatedProperties" in schema:
            seen = set(value)
        apply += [s for n, s in schema.get("dependentSchemas", {}).items() if n in value]
    else:
        seen = set(range(len(value) if "items" in schema or "unevaluatedItems" in schema else min(len(value), len(schema.get("prefixItems", [])))))
        if "contains" in schema:
            seen |= {i for i, v in enumerate(value) if not schema_errors(v, schema["contains"], "", root, depth + 1)}
    for s in apply:
        seen |= _looked_at(value, s, root, depth + 1)
    return seen


def schema_errors(value, schema, at: str = "", root=None, depth: int = 0) -> list[str]:
    """What of a value breaks a schema (2020-12): types, enum, const, bounds, lengths, patterns, properties and their names, dependencies, items, contains, all/any/one of, not, if/then/else, unevaluated parts, references within the schema."""
    if root is None:
        root = schema
        check_schema(schema)
    if depth > 100:
        raise ValueError("references go in circles")
    if schema is True or schema is False:
        return [] if schema else [f"{at or '/'}: nothing is allowed"]
    bad: list[str] = []
    errors = lambda v, s, where: schema_errors(v, s, where, root, depth + 1)
    say = lambda what: bad.append(f"{at or '/'}: {what}")
    if isinstance(schema.get("$ref"), str):
        bad += errors(value, _referred(root, schema["$ref"]), at)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        say(f"is not {kinds}")
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        say("is not one of the values")
    if "const" in schema and not _same(value, schema["const"]):
        say("is not the value")
    if _is(value, "number"):
        for key, broken in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            if key in schema and broken(value, schema[key]):
                say(f"breaks {key}")
        if "multipleOf" in schema and not math.isclose(value / schema["multipleOf"], round(value / schema["multipleOf"]), abs_tol=1e-9):
            say("breaks multipleOf")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            say("has a length that is not allowed")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            say("does not match the pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            say("has a size that is not allowed")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            say("has repeated items")
        if "contains" in schema:
            fit = sum(not errors(v, schema["contains"], at) for v in value)
            if not schema.get("minContains", 1) <= fit <= schema.get("maxContains", math.inf):
                say("has a number of fitting items that is not allowed")
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            own = first[i] if i < len(first) else schema.get("items", True)
            bad += errors(v, own, f"{at}/{i}")
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                say(f"lacks {name}")
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
            say("has a number of properties that is not allowed")
        for name, needed in schema.get("dependentRequired", {}).items():
            bad += [f"{at or '/'}: lacks {n}, which {name} needs" for n in needed if name in value and n not in value]
        for name, s in schema.get("dependentSchemas", {}).items():
            if name in value:
                bad += errors(value, s, at)
        if "propertyNames" in schema:
            bad += [e for name in value for e in errors(name, schema["propertyNames"], f"{at}/{name}")]
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for name, v in value.items():
            matched = [s for p, s in patterns.items() if re.search(p, name)]
            if name in own:
                matched.append(own[name])
            for s in matched or [schema.get("additionalProperties", True)]:
                bad += errors(v, s, f"{at}/{name}")
    for s in schema.get("allOf", []):
        bad += errors(value, s, at)
    if "anyOf" in schema and all(errors(value, s, at) for s in schema["anyOf"]):
        say("matches none of anyOf")
    if "oneOf" in schema and sum(not errors(value, s, at) for s in schema["oneOf"]) != 1:
        say("does not match one of oneOf")
    if "not" in schema and not errors(value, schema["not"], at):
        say("matches what it must not")
    if "if" in schema:
        branch = "else" if errors(value, schema["if"], at) else "then"
        bad += errors(value, schema.get(branch, True), at)
    rest = "unevaluatedProperties" if isinstance(value, dict) else "unevaluatedItems" if isinstance(value, list) else None
    if rest in schema:
        seen = _looked_at(value, {k: s for k, s in schema.items() if k != rest}, root, depth)
        parts = value.items() if isinstance(value, dict) else enumerate(value)
        bad += [e for n, v in parts if n not in seen for e in errors(v, schema[rest], f"{at}/{n}")]
    return bad


@F.pandas_udf(T.StringType())
def validate_payload(payload: pd.Series, schema: pd.Series) -> pd.Series:
    """Null if a payload keeps its schema, else the errors in at most 1,024 bytes; no schema allows any payload."""
    known: dict[str, object] = {}

    def one(text: str | None, rules: str | None) -> str | None:
        if not rules:
            return None
        try:
            if rules not in known:
                known[rules] = json.loads(rules)
            found = schema_errors(json.loads(text or "null"), known[rules])
        except ValueError as e:
            found = [str(e)]
        return "; ".join(found).encode()[:1024].decode("utf-8", "ignore") if found else None

    return pd.Series([one(t, s) for t, s in zip(payload, schema, strict=True)], dtype=object)
