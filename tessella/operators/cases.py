"""Test case documents: validation to violation rows, adoption, search, locators, page facts.

A document is parsed once, to a VARIANT, and read once more as typed records. What its schema refuses comes from the schema of its
version, compiled to expressions; what does not make sense from rules on the records. All that is wrong with a document is
one array of violations, made in one pass over it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.json_schema import UNREADABLE, VIOLATIONS, Schema, compile_schema
from ..functions.json_schema import literal
from ..functions.json_schema import violation as _violation

# Fixed values of version 1.0.0 of the document.
VERSION = "1.0.0"
SCHEMAS = ("1", "1.0", "1.0.0")
ACTIONS = ("NAVIGATE", "CLICK", "INPUT", "SELECT", "WAIT", "ASSERT", "SCREENSHOT")
STRATEGIES = ("ROLE", "TEXT", "LABEL", "TESTID", "CSS", "XPATH")
KINDS = ("URL_EQUALS", "URL_CONTAINS", "ELEMENT_VISIBLE", "ELEMENT_NOT_PRESENT", "TEXT_EQUALS", "TEXT_CONTAINS", "VALUE_EQUALS")
LOCATOR_FIELDS = (("ROLE", ("role", "name")), ("TEXT", ("text",)), ("TESTID", ("testId",)), ("CSS", ("selector",)), ("XPATH", ("xpath",)))
NEED_TARGET = ("CLICK", "INPUT", "SELECT", "ASSERT")
NEED_VALUE = ("INPUT", "SELECT")
NEED_EXPECTED = ("URL_EQUALS", "URL_CONTAINS", "TEXT_EQUALS", "TEXT_CONTAINS", "VALUE_EQUALS")
NEED_ASSERTION_TARGET = ("ELEMENT_VISIBLE", "ELEMENT_NOT_PRESENT", "TEXT_CONTAINS")
#: Texts of a tree's node, and nodes that are passed on at once.
NODE, NODES_AT_ONCE = ("ref", "role", "name", "test_id"), 10_000
INPUT_ROLES = ("textbox", "searchbox", "combobox", "spinbutton")
WRAPPED = '{"schemaVersion":"1.0.0","summary":{"app":"validation","page":"validation","totalCases":1},"cases":['

# The schema of version 1.0.0.
V1 = {
    "type": "object",
    "additionalProperties": False,
    "required": ["schemaVersion", "summary", "cases"],
    "properties": {
        "schemaVersion": {"const": "1.0.0"},
        "generatedAt": {"type": "string", "format": "date-time"},
        "sourceRequirementRef": {"type": "string"},
        "summary": {
            "type": "object",
            "additionalProperties": False,
            "required": ["app", "page", "totalCases"],
            "properties": {
                "app": {"type": "string", "minLength": 1},
                "page": {"type": "string", "minLength": 1},
                "totalCases": {"type": "integer", "minimum": 0},
                "testScope": {"type": "string"},
            },
        },
        "cases": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/TestCase"}},
    },
    "$defs": {
        "TestCase": {
            "type": "object",
            "additionalProperties": False,
            "required": ["caseId", "title", "automationCandidate", "steps", "expectedOutcome"],
            "properties": {
                "caseId": {"type": "string", "pattern": "^TC_[A-Za-z0-9_]+$"},
                "title": {"type": "string", "minLength": 4, "maxLength": 200},
                "caseType": {"enum": ["FUNCTIONAL", "FLOW", "EXCEPTION", "BOUNDARY", "UI", "COMPATIBILITY"]},
                "designMethod": {"enum": ["EQUIVALENCE", "BOUNDARY", "SCENARIO", "CAUSE_EFFECT", "ERROR_GUESSING", "ORTHOGONAL"]},
                "priority": {"enum": ["P0", "P1", "P2", "P3"]},
                "risk": {"enum": ["HIGH", "MEDIUM", "LOW"]},
                "automationCandidate": {"enum": ["WEB_FUNCTIONAL", "MANUAL_VISUAL", "API", "UNSUPPORTED"]},
                "precondition": {"type": "array", "items": {"type": "string"}},
                "testData": {"type": "object", "additionalProperties": {"anyOf": [{"type": "string"}, {"type": "number"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}]}},
                "steps": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/TestStep"}},
                "expectedOutcome": {"type": "string", "minLength": 1},
                "assertions": {"type": "array", "items": {"$ref": "#/$defs/Assertion"}},
            },
        },
        "TestStep": {
            "type": "object",
            "additionalProperties": False,
            "required": ["order", "action"],
            "properties": {
                "order": {"type": "integer", "minimum": 1},
                "action": {"type": "string", "enum": list(ACTIONS)},
                "target": {"$ref": "#/$defs/TargetLocator"},
                "url": {"type": "string"},
                "value": {"type": "string"},
                "expectedResult": {"type": "string"},
                "timeoutMs": {"type": "integer", "minimum": 100, "maximum": 60000, "default": 5000},
            },
        },
        "TargetLocator": {
            "type": "object",
            "additionalProperties": False,
            "required": ["strategy"],
            "properties": {
                "strategy": {"type": "string", "enum": list(STRATEGIES)},
                "role": {"type": "string"},
                "name": {"type": "string"},
                "text": {"type": "string"},
                "label": {"type": "string"},
                "testId": {"type": "string"},
                "selector": {"type": "string"},
                "xpath": {"type": "string"},
                "exact": {"type": "boolean", "default": False},
            },
        },
        "Assertion": {
            "type": "object",
            "additionalProperties": False,
            "required": ["kind"],
            "properties": {
                "kind": {"type": "string", "enum": list(KINDS)},
                "target": {"$ref": "#/$defs/TargetLocator"},
                "expected": {"type": "string"},
                "negate": {"type": "boolean", "default": False},
            },
        },
    },
}
#: The schema of each version that a document may name.
VERSIONS: Mapping[str, Schema] = dict.fromkeys(SCHEMAS, V1)

WHOLE = "schemaVersion string, summary string, cases array<string>"
LOCATOR = "struct<strategy: string, role: string, name: string, text: string, label: string, testId: string, selector: string, xpath: string>"
STEP = f"struct<`order`: int, action: string, target: {LOCATOR}, url: string, value: string>"
ASSERTION = f"struct<kind: string, target: {LOCATOR}, expected: string>"
CASE = f"struct<caseId: string, title: string, caseType: string, automationCandidate: string, steps: array<{STEP}>, expectedOutcome: string, assertions: array<{ASSERTION}>>"
DOCUMENT = f"struct<schemaVersion: string, summary: struct<totalCases: int>, cases: array<{CASE}>>"

Rule = tuple[Column, Column, str, str]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _rows(*rules: Rule) -> Column:
    """An array of violations from (condition, path, code, message); a condition that is null does not hold."""
    made = [F.when(cond, _violation(path, code, F.lit(message))) for cond, path, code, message in rules]
    return F.array_compact(F.array(*made))


def _sub(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(name))


def _each(items: Column, f) -> Column:
    """The violations of all items of an array, which may be null."""
    return F.coalesce(F.flatten(F.transform(items, f)), F.array().cast(VIOLATIONS))


def _locator_rules(t: Column, path: Column) -> list[Rule]:
    out = [(t.isNotNull() & t["strategy"].isNull(), _sub(path, ".strategy"), "SEM_FIELD_REQUIRED", "a target has a strategy")]
    for strategy, fields in LOCATOR_FIELDS:
        out += [((t["strategy"] == strategy) & _blank(t[f]), _sub(path, f".{f}"), "SEM_LOCATOR_FIELD_REQUIRED", f"strategy {strategy} asks for {f}") for f in fields]
    missing = t["label"].isNull() & t["text"].isNull()
    return [*out, ((t["strategy"] == "LABEL") & missing, _sub(path, ".label"), "SEM_LOCATOR_FIELD_REQUIRED", "strategy LABEL asks for label or text")]


def parse(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``json`` (a VARIANT, null if the text is no JSON, or names a key of an object twice) and ``doc``, the same as records.

    The generator keeps later filters and uses from repeating the parse.
    """
    json = documents.select("*", F.inline(F.array(F.struct(F.try_parse_json(F.col(raw)).alias("json")))))
    return json.select("*", F.inline(F.array(F.struct(F.try_variant_get("json", "$", DOCUMENT).alias("doc")))))


def _meaning_rules() -> Column:
    """What does not make sense; paths are dotted, arrays in brackets."""
    doc = F.col("doc")
    summary = doc["summary"]

    def step(path: Column):
        def of(s: Column, j: Column) -> Column:
            at = F.concat(path, F.lit(".steps["), j.cast("string"), F.lit("]"))
            return _rows(
                (s["order"].isNull(), _sub(at, ".order"), "SEM_FIELD_REQUIRED", "order is required"),
                (s["order"] != j + 1, _sub(at, ".order"), "SEM_ORDER_SEQUENTIAL", "orders are 1, 2, 3 and so on"),
                (s["action"].isNull(), _sub(at, ".action"), "SEM_FIELD_REQUIRED", "action is required"),
                ((s["action"] == "NAVIGATE") & _blank(s["url"]), _sub(at, ".url"), "SEM_URL_REQUIRED_NAVIGATE", "url is required for action NAVIGATE"),
                ((s["action"] == "NAVIGATE") & s["target"].isNotNull(), _sub(at, ".target"), "SEM_TARGET_FORBIDDEN_NAVIGATE", "NAVIGATE has no target"),
                (s["action"].isin(*NEED_TARGET) & s["target"].isNull(), _sub(at, ".target"), "SEM_TARGET_REQUIRED", "the action needs a target"),
                *_locator_rules(s["target"], _sub(at, ".target")),
                (s["action"].isin(*NEED_VALUE) & _blank(s["value"]), _sub(at, ".value"), "SEM_VALUE_REQUIRED", "the action needs a value"),
            )

        return of

    def check(path: Column):
        def of(a: Column, j: Column) -> Column:
            at = F.concat(path, F.lit(".assertions["), j.cast("string"), F.lit("]"))
            return _rows(
                (a["kind"].isNull(), _sub(at, ".kind"), "SEM_FIELD_REQUIRED", "kind is required"),
                (a["kind"].isin(*NEED_EXPECTED) & _blank(a["expected"]), _sub(at, ".expected"), "SEM_EXPECTED_REQUIRED", "the kind needs an expected value"),
                (a["kind"].isin(*NEED_ASSERTION_TARGET) & a["target"].isNull(), _sub(at, ".target"), "SEM_TARGET_REQUIRED_ASSERTION", "the kind needs a target"),
            )

        return of

    def case(c: Column, i: Column) -> Column:
        at = F.concat(F.lit("$.cases["), i.cast("string"), F.lit("]"))
        rules = _rows(
            (_blank(c["title"]), _sub(at, ".title"), "SEM_FIELD_REQUIRED", "title is required"),
            (c["automationCandidate"].isNull(), _sub(at, ".automationCandidate"), "SEM_FIELD_REQUIRED", "automationCandidate is required"),
            (c["steps"].isNull() | (F.size(c["steps"]) == 0), _sub(at, ".steps"), "SEM_STEPS_EMPTY", "at least one step"),
        )
        return F.concat(rules, _each(c["steps"], step(at)), _each(c["assertions"], check(at)))

    rules = _rows(
        (~doc["schemaVersion"].eqNullSafe(F.lit(VERSION)), F.lit("$.schemaVersion"), "SEM_SCHEMA_VERSION", f"schemaVersion must be {VERSION}"),
        (doc["summary"].isNull(), F.lit("$.summary"), "SEM_SUMMARY_REQUIRED", "summary is required"),
        (doc["summary"].isNotNull() & summary["totalCases"].isNull(), F.lit("$.summary.totalCases"), "SEM_FIELD_REQUIRED", "summary.totalCases is required"),
        (doc["cases"].isNull() | (F.size(doc["cases"]) == 0), F.lit("$.cases"), "SEM_CASES_EMPTY", "at least one case"),
    )
    return F.concat(rules, _each(doc["cases"], case))


def checked(documents: DataFrame, raw: str = "raw", versions: Mapping[str, Schema] = VERSIONS) -> DataFrame:
    """``documents`` parsed, with ``found``, the array of a document's violations: of its version's schema first, then of the meaning.

    A document without a version counts as 1.0.0. Of an unknown version nothing else is checked. A document with a value that its
    records can't hold is not checked for its meaning. Other columns stay; a null text is no JSON.
    """
    top, json = F.lit("$"), F.col("json")
    said = F.try_variant_get(json, "$.schemaVersion", "variant")
    version = F.when(said.isNull() | F.is_variant_null(said), VERSION).otherwise(F.try_variant_get(said, "$", "string"))
    # each different schema is compiled once, whatever the number of names it goes by
    schemas: list[tuple[Schema, list[str]]] = []
    for name, schema in versions.items():
        next((names for s, names in schemas if s is schema), schemas.append((schema, [])) or schemas[-1][1]).append(name)
    schemas = [(s, names) for s, names in schemas if names]
    refused = "CASE " + " ".join(f"WHEN version IN ({', '.join(map(literal, names))}) THEN {compile_schema(schema, 'json', reads=True)}" for schema, names in schemas) + " END"
    parsed = parse(documents, raw).select("*", F.inline(F.array(F.struct(version.alias("version")))))
    parsed = parsed.select("*", F.inline(F.array(F.struct(F.expr(refused).alias("all")))))
    is_unread = lambda x: x["code"] == UNREADABLE
    refused = F.filter("all", lambda x: ~is_unread(x))
    found = (
        F.when(json.isNull(), F.array(_violation(top, "PARSE_ERROR", F.lit("no JSON"))))
        .when(F.col("all").isNull(), F.array(_violation(F.lit("$.schemaVersion"), "UNKNOWN_VERSION", F.lit("unknown schema version"))))
        .when(F.exists("all", is_unread), F.concat(refused, F.array(_violation(top, "SEMANTIC_PARSE", F.lit("a value is not of its record's type")))))
        .otherwise(F.concat(refused, _meaning_rules()))
    )
    return parsed.select("*", F.inline(F.array(F.struct(found.alias("found"))))).drop("json", "version", "all")


def violations(documents: DataFrame, key: str = "doc_key", raw: str = "raw") -> DataFrame:
    """Rows (key, path, code, message) of everything that is wrong with each document; a valid one has none."""
    return checked(documents, raw).select(key, F.inline("found"))


def wrap_case(case_raw: Column) -> Column:
    """A document around a single case."""
    return F.concat(F.lit(WRAPPED), case_raw, F.lit("]}"))


def auto_wrap(raw: Column) -> Column:
    """A document without version and summary that has one case with a caseId is wrapped again; any other stays."""
    doc = F.from_json(raw, WHOLE)
    alone = doc["schemaVersion"].isNull() & doc["summary"].isNull() & (F.size(doc["cases"]) == 1)
    named = F.get_json_object(doc["cases"][0], "$.caseId").isNotNull()
    return F.when(alone & named, wrap_case(doc["cases"][0])).otherwise(raw)


def check_batch(cases: DataFrame, key: str = "case_key", raw: str = "case_raw") -> DataFrame:
    """Each case by itself: key, ``caseId``, ``valid`` and the array ``errors``."""
    found = checked(cases.select(key, F.col(raw).alias("one"), wrap_case(F.col(raw)).alias("raw")))
    return found.select(key, F.get_json_object("one", "$.caseId").alias("caseId"), (F.size("found") == 0).alias("valid"), F.col("found").alias("errors"))


def saved_cases(cases: DataFrame, tag: Column, raw: str = "case_raw") -> DataFrame:
    """Generated cases as stored: the whole text, and knowledge, type, adoptionStatus and caseId beside it."""
    get = lambda k, other: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(other))
    return cases.select("*", F.col(raw).alias("content"), tag.alias("knowledge"), F.lit("test_case").alias("type"), get("adoptionStatus", "PENDING").alias("adoptionStatus"), get("caseId", "").alias("caseId"))


def adopt(documents: DataFrame, key: str = "doc_key", raw: str = "raw") -> DataFrame:
    """Cases of valid documents with a stable id (caseId or TC_AUTO, and a hash of the case), status ADOPTED.

    Ids follow from the content, so a retried write adopts nothing twice.
    """
    c = F.col("x.c")
    valid = checked(documents, raw).where(F.size("found") == 0)
    # the records, and each case's own text
    both = F.arrays_zip(F.col("doc.cases").alias("c"), F.from_json(raw, WHOLE)["cases"].alias("raw"))
    made = valid.select(key, F.posexplode(both).alias("case_no", "x"))
    case_id = F.concat_ws("_", F.coalesce(c["caseId"], F.lit("TC_AUTO")), F.substring(F.sha2("x.raw", 256), 1, 12))
    return made.select(key, "case_no", case_id.alias("case_id"), c["caseId"].alias("original_case_id"), F.coalesce(c["title"], F.lit("")).alias("title"), c["caseType"].alias("case_type"), F.coalesce(c["automationCandidate"], F.lit("UNSUPPORTED")).alias("automation_candidate"), F.lit("ADOPTED").alias("status"), F.col("x.raw").alias("raw_dsl"))


def adoption_summary(documents: DataFrame, key: str = "doc_key", raw: str = "raw") -> DataFrame:
    """One row: documents, how many are valid, and ADOPTED, PARTIAL or FAILED."""
    counts = checked(documents, raw).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.size("found") == 0).alias("valid"))
    return counts.withColumn("status", F.when(F.col("valid") == F.col("documents"), "ADOPTED").when(F.col("valid") > 0, "PARTIAL").otherwise("FAILED"))


def search(cases: DataFrame, word: str, columns: tuple[str, ...] = ("title", "case_id")) -> DataFrame:
    """Rows with ``word`` in one of the columns, whatever its case; %, _ and backslash stand for themselves."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(word.lower()))
    return cases.where(found)


class _Number(str):
    """A number of a JSON text as it is written."""


def _json_text(x: object) -> str:
    if isinstance(x, _Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json_text(v)}" for k, v in x.items()) + "}"
    return "[" + ",".join(map(_json_text, x)) + "]" if isinstance(x, list) else json.dumps(x)


def _nodes(raw: str) -> Iterator[tuple]:
    """The nodes of a tree in pre-order: place, depth, the values of NODE that are texts, and others as JSON by their names."""
    stack, i = [(json.loads(raw, parse_int=_Number, parse_float=_Number), 0)], 0
    while stack:
        node, depth = stack.pop()
        i += 1
        attributes, odd = node.get("attributes"), None
        said = [node.get("ref"), node.get("role"), node.get("name"), attributes.get("data-testid") if isinstance(attributes, dict) else None]
        for j, x in enumerate(said):
            if x is not None and type(x) is not str:
                odd, said[j] = (odd or []) + [(NODE[j], _json_text(x))], None
            elif x is not None and not x.isascii():  # half a surrogate pair, written as an escape, is no text
                said[j] = x.encode("utf-8", "replace").decode()
        yield i, depth, *said, odd
        children = node.get("children")
        if isinstance(children, dict):
            children = [children[k] for k in sorted(children)]
        if isinstance(children, list):
            stack.extend((c, depth + 1) for c in reversed(children) if isinstance(c, dict))


def flatten_trees(snapshots: DataFrame, page: str = "page", raw: str = "raw") -> DataFrame:
    """The nodes of nested snapshots (JSON objects with ``children``) in pre-order: page, preorder (from 1), depth, ref, role, name
    and test_id (the attribute data-testid).

    A page has one snapshot, which is read by one task and not shuffled. Children that are no objects are left out, as are texts that are
    no JSON object; other keys are not looked at.
    """
    parsed = F.try_parse_json(raw)
    trees = snapshots.select(F.col(page).alias("page"), F.col(raw).alias("raw")).where(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")))
    kind = StructType([StructField("page", trees.schema["page"].dataType), *StructType.fromDDL("preorder int, depth int, ref string, role string, name string, test_id string, odd map<string,string>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.map_(pa.string(), pa.string())]
        for batch in batches:
            # a part of a tree at a time: the places of its snapshot and its nodes
            nodes = ((at, *n) for at, text in enumerate(batch.column("raw")) for n in _nodes(text.as_py()))
            while some := list(islice(nodes, NODES_AT_ONCE)):
                at, *columns = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(at)), *map(pa.array, columns, types)], names=kind.names)

    # other values than texts are cast as Spark casts them
    text = lambda c: F.coalesce(F.col(c), F.try_variant_get(F.try_parse_json(F.col("odd")[c]), "$", "string")).alias(c)
    return trees.mapInArrow(run, kind).select("page", "preorder", "depth", *map(text, NODE))


def resolve(nodes: DataFrame, locators: DataFrame) -> DataFrame:
    """The first node (by ``preorder``) of its page that each locator names; null for CSS, XPATH and no match.

    Roles and test ids are compared exactly, labels (or else texts) and names whatever their case.

    ``nodes``: page, preorder, ref, role, name, test_id. ``locators``: locator_id, page, strategy, role, name, text, label,
    test_id, exact.
    """
    n = nodes.select("page", "preorder", "ref", F.col("role").alias("n_role"), F.col("name").alias("n_name"), F.col("test_id").alias("n_test_id"))
    label = F.coalesce("label", "text")
    by_name = lambda want: F.when(F.coalesce("exact", F.lit(False)), F.col("n_name") == want).otherwise(F.contains(F.lower("n_name"), F.lower(want)))
    match = (
        F.when(F.col("strategy") == "TESTID", F.col("n_test_id") == F.col("test_id"))
        .when(F.col("strategy") == "LABEL", (F.lower("n_name") == F.lower(label)) & F.col("n_role").isin(*INPUT_ROLES))
        .when(F.col("strategy") == "ROLE", (F.col("n_role") == F.col("role")) & (F.col("name").isNull() | by_name(F.col("name"))))
        .when(F.col("strategy") == "TEXT", by_name(F.col("text")))
        .otherwise(F.lit(False))
    )
    hit = locators.join(n, "page").where(match).groupBy("locator_id").agg(F.min_by("ref", "preorder").alias("ref"))
    return locators.select("locator_id").join(hit, "locator_id", "left")


def page_text(nodes: DataFrame) -> DataFrame:
    """Names of a page's nodes in order, joined by blanks."""
    named = nodes.where(~_blank(F.col("name"))).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("preorder", "name"))).alias("n"))
    return named.select("page", F.array_join(F.col("n.name"), " ").alias("page_text"))


def evaluate_assertion(kind: Column, expected: Column, url: Column, text: Column, value: Column, found: Column, negate: Column) -> Column:
    """Whether an assertion holds on a captured page: real equality for *_EQUALS, and ``negate`` turns the answer."""
    holds = (
        F.when(kind == "URL_EQUALS", url == expected).when(kind == "URL_CONTAINS", F.contains(url, expected))
        .when(kind == "ELEMENT_VISIBLE", found).when(kind == "ELEMENT_NOT_PRESENT", ~found)
        .when(kind == "TEXT_EQUALS", text == expected).when(kind == "TEXT_CONTAINS", F.contains(text, expected))
        .when(kind == "VALUE_EQUALS", value == expected)
    )
    return F.coalesce(holds, F.lit(False)) != F.coalesce(negate, F.lit(False))
