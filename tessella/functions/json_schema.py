"""JSON schemas compiled to expressions on VARIANT columns.

``compile_schema`` turns a schema into an expression from a value to an array of violations (path, code, message); the code is
SCHEMA_ and the keyword. A value is parsed once, by whoever makes the VARIANT. An object is taken apart once, to a map of its
values, an array once to its elements, and the rules of each are lookups in these; arrays of any length and maps with any keys are
gone through by one generator per level. Known keywords: type, enum, const, pattern, minLength, maxLength, minimum, maximum,
minItems, maxItems, required, properties, additionalProperties, items, anyOf, and $ref to #/$defs. Annotations (title,
description, default, format and the like) say nothing about validity, any other keyword is refused. A keyword passes over values of a
type that it is not about, as in the standard.

The expression is put together as SQL text, which Spark reads at once.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import count
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATIONS = "array<struct<path: string, code: string, message: string>>"
#: The code of a value that typed records can't hold, in a result with ``reads``.
UNREADABLE = "UNREADABLE"
Schema = Mapping[str, Any]

_ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format"}
_KEYWORDS = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "required", "properties", "additionalProperties", "items", "anyOf"}
_NONE = f"CAST(array() AS {VIOLATIONS.replace(': ', ':')})"
#: What a value's type is called, for the types of JSON; ``{k}`` is its name in Spark, ``{v}`` the value.
_TYPES = {
    "string": "{k} = 'STRING'",
    "boolean": "{k} = 'BOOLEAN'",
    "null": "{k} = 'VOID'",
    "object": "startswith({k}, 'OBJECT')",
    "array": "startswith({k}, 'ARRAY')",
    "number": "({k} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({k}, 'DECIMAL'))",
    "integer": "({k} = 'BIGINT' OR (({k} IN ('DOUBLE', 'FLOAT') OR startswith({k}, 'DECIMAL')) AND try_variant_get({v}, '$', 'double') = floor(try_variant_get({v}, '$', 'double'))))",
}


def violation(path: Column, code: str, message: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"), message.alias("message"))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve(schema: Schema, root: Schema, seen: tuple[str, ...] = ()) -> tuple[Schema, tuple[str, ...]]:
    """The schema that a $ref names, and the names on the way here; other keywords beside a $ref add to it."""
    while "$ref" in schema:
        name = schema["$ref"]
        if not name.startswith("#/$defs/") or name in seen:
            raise ValueError(f"not a definition, or one that holds itself: {name}")
        seen = (*seen, name)
        schema = {**root["$defs"][name.removeprefix("#/$defs/")], **{k: v for k, v in schema.items() if k != "$ref"}}
    return schema, seen


class _Compiler:
    def __init__(self, root: Schema, reads: bool):
        self.root, self.reads, self.names = root, reads, (f"x{i}" for i in count())

    def let(self, value: str, body) -> str:
        """``body`` of a name for ``value``, which is worked out once."""
        name = next(self.names)
        return f"flatten(transform(array({value}), {name} -> {body(name)}))"

    def found(self, wrong: str, path: str, code: str, message: str) -> str:
        return f"IF({wrong}, named_struct('path', {path}, 'code', {literal(code)}, 'message', {literal(message)}), NULL)"

    def rows(self, *items: str) -> str:
        return f"array_compact(array({', '.join(items)}))" if items else _NONE

    def is_constant(self, v: str, k: str, constant: Any) -> str:
        if constant is None:
            return f"{k} = 'VOID'"
        if isinstance(constant, bool):
            return f"({k} = 'BOOLEAN' AND try_variant_get({v}, '$', 'boolean') = {str(constant).lower()})"
        if isinstance(constant, str):
            return f"({k} = 'STRING' AND try_variant_get({v}, '$', 'string') = {literal(constant)})"
        if isinstance(constant, (int, float)):
            return f"({_TYPES['number'].format(k=k, v=v)} AND try_variant_get({v}, '$', 'double') = {float(constant)!r}D)"
        raise ValueError(f"no constant: {constant!r}")

    def one_of(self, v: str, k: str, constants: list) -> str:
        if all(isinstance(c, str) for c in constants):
            return f"({k} = 'STRING' AND try_variant_get({v}, '$', 'string') IN ({', '.join(map(literal, constants))}))"
        return "(" + " OR ".join(self.is_constant(v, k, c) for c in constants) + ")"

    def check(self, schema: Schema, value: str, path: str, seen: tuple[str, ...] = ()) -> str:
        """The array of violations of a value that is not SQL null."""
        schema, seen = resolve(schema, self.root, seen)
        if unknown := schema.keys() - _KEYWORDS - _ANNOTATIONS:
            raise ValueError(f"keywords that are not known: {sorted(unknown)}")
        if schema.get("type") == "object" and not schema.keys() & {"enum", "const", "anyOf"}:
            return self.let(f"named_struct('v', {value}, 'm', try_variant_get({value}, '$', 'map<string,variant>'))", lambda o: f"IF({o}.m IS NULL, {self.not_of('object', f'{o}.v', path)}, {self.members(schema, f'{o}.m', path, seen)})")
        if schema.get("type") == "array" and not schema.keys() & {"enum", "const", "anyOf"}:
            return self.let(f"named_struct('v', {value}, 'e', try_variant_get({value}, '$', 'array<variant>'))", lambda o: f"IF({o}.e IS NULL, {self.not_of('array', f'{o}.v', path)}, {self.items(schema, f'{o}.e', path, seen)})")
        return self.let(f"named_struct('v', {value}, 'k', schema_of_variant({value}))", lambda o: self.any(schema, f"{o}.v", f"{o}.k", path, seen))

    def not_of(self, name: str, v: str, path: str) -> str:
        rows = [self.found("true", path, "SCHEMA_type", f"must be of type {name}")]
        if self.reads:
            rows.append(self.found(f"NOT is_variant_null({v})", path, UNREADABLE, ""))
        return self.rows(*rows)

    def members(self, schema: Schema, m: str, path: str, seen: tuple[str, ...]) -> str:
        """Violations of an object's keys and values; ``m`` is its map."""
        known = schema.get("properties", {})
        parts = [self.rows(*[self.found(f"{m}[{literal(n)}] IS NULL", path, "SCHEMA_required", f"{n} is required") for n in schema.get("required", ())])]
        for name, inner in known.items():
            child = f"{m}[{literal(name)}]"
            parts.append(f"IF({child} IS NULL, {_NONE}, {self.check(inner, child, f'concat({path}, {literal('/' + name)})', seen)})")
        listed = f"array({', '.join(map(literal, known))})" if known else "CAST(array() AS array<string>)"
        others = schema.get("additionalProperties", True)
        if others is False:
            k = next(self.names)
            parts.append(f"transform(array_except(map_keys({m}), {listed}), {k} -> named_struct('path', {path}, 'code', 'SCHEMA_additionalProperties', 'message', concat({k}, ' is not known')))")
        elif others is not True:
            e, f = next(self.names), next(self.names)
            rest = f"filter(map_entries({m}), {f} -> NOT array_contains({listed}, {f}.key))" if known else f"map_entries({m})"
            parts.append(f"flatten(transform({rest}, {e} -> {self.check(others, f'{e}.value', f'concat({path}, {literal('/')}, {e}.key)', seen)}))")
        return f"concat({', '.join(parts)})"

    def items(self, schema: Schema, e: str, path: str, seen: tuple[str, ...]) -> str:
        """Violations of an array's length and elements; ``e`` is the array."""
        rows = []
        if "minItems" in schema:
            rows.append(self.found(f"size({e}) < {schema['minItems']}", path, "SCHEMA_minItems", f"at least {schema['minItems']} items"))
        if "maxItems" in schema:
            rows.append(self.found(f"size({e}) > {schema['maxItems']}", path, "SCHEMA_maxItems", f"at most {schema['maxItems']} items"))
        out = self.rows(*rows)
        if "items" in schema:
            x, i = next(self.names), next(self.names)
            out = f"concat({out}, flatten(transform({e}, ({x}, {i}) -> {self.check(schema['items'], x, f'concat({path}, {literal('/')}, {i})', seen)})))"
        return out

    def any(self, schema: Schema, v: str, k: str, path: str, seen: tuple[str, ...]) -> str:
        """Violations of a value of any type; ``k`` is the name of its type."""
        text, number = f"try_variant_get({v}, '$', 'string')", f"try_variant_get({v}, '$', 'double')"
        is_text, is_number = f"{k} = 'STRING'", _TYPES["number"].format(k=k, v=v)
        rows = []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            rows.append(self.found(f"NOT ({' OR '.join(_TYPES[n].format(k=k, v=v) for n in names)})", path, "SCHEMA_type", f"must be of type {' or '.join(names)}"))
        if "enum" in schema:
            rows.append(self.found(f"NOT {self.one_of(v, k, list(schema['enum']))}", path, "SCHEMA_enum", f"must be one of {', '.join(map(str, schema['enum']))}"))
        if "const" in schema:
            rows.append(self.found(f"NOT {self.is_constant(v, k, schema['const'])}", path, "SCHEMA_const", f"must be {schema['const']}"))
        if "pattern" in schema:
            rows.append(self.found(f"{is_text} AND NOT regexp_like({text}, {literal(schema['pattern'])})", path, "SCHEMA_pattern", f"must match {schema['pattern']}"))
        for word, about, size, what in (("minLength", is_text, f"char_length({text})", "characters"), ("maxLength", is_text, f"char_length({text})", "characters"), ("minimum", is_number, number, ""), ("maximum", is_number, number, "")):
            if word in schema:
                least = word.startswith("min")
                rows.append(self.found(f"{about} AND {size} {'<' if least else '>'} {schema[word]}", path, f"SCHEMA_{word}", f"at {'least' if least else 'most'} {schema[word]} {what}".strip()))
        if self.reads and (wrong := self.unreadable(schema, v, k)):
            rows.append(self.found(f"{k} <> 'VOID' AND {wrong}", path, UNREADABLE, ""))
        parts = [self.rows(*rows)]
        if "anyOf" in schema:
            plain = _Compiler(self.root, False)
            plain.names = self.names
            bad = " AND ".join(f"size({plain.check(s, v, path, seen)}) > 0" for s in schema["anyOf"])
            parts.append(self.rows(self.found(bad, path, "SCHEMA_anyOf", "matches none of the alternatives")))
        if schema.keys() & {"properties", "required", "additionalProperties"}:
            parts.append(self.let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: f"IF({m} IS NULL, {_NONE}, {self.members(schema, m, path, seen)})"))
        if schema.keys() & {"items", "minItems", "maxItems"}:
            parts.append(self.let(f"try_variant_get({v}, '$', 'array<variant>')", lambda e: f"IF({e} IS NULL, {_NONE}, {self.items(schema, e, path, seen)})"))
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]

    def unreadable(self, schema: Schema, v: str, k: str) -> str | None:
        """Whether a lenient reader of typed records refuses the value: it takes numbers and truth values as text, and text that
        is a number or truth value as such."""
        nested = f"(startswith({k}, 'OBJECT') OR startswith({k}, 'ARRAY'))"
        text = f"trim(try_variant_get({v}, '$', 'string'))"
        if "anyOf" in schema:
            return None
        if "enum" in schema:
            return f"NOT {self.one_of(v, k, list(schema['enum']))}"
        if schema.get("type") == "integer":
            return f"({nested} OR {k} = 'BOOLEAN' OR ({text} <> '' AND try_variant_get({v}, '$', 'int') IS NULL))"
        if schema.get("type") == "boolean":
            return f"({nested} OR {k} = 'DOUBLE' OR startswith({k}, 'DECIMAL') OR ({k} = 'STRING' AND lower({text}) NOT IN ('true', 'false', '')))"
        return nested


def compile_schema(schema: Schema, value: str, path: str = "'$'", reads: bool = False) -> str:
    """SQL text: the array of violations of the VARIANT ``value`` (an expression), empty if it is valid or SQL null.

    With ``reads`` it also has a row of code UNREADABLE for each value that records of the schema's types can't hold; nulls and
    missing keys are read as null.
    """
    return f"IF({value} IS NULL, {_NONE}, {_Compiler(schema, reads).check(schema, value, path)})"
