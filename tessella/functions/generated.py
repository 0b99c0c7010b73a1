"""Columns for what language models write: thinking, fences, records, variants, judge and diagnosis answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RECORD_END = "__CASE_END__"
# Diagnosis categories and levels, and judge labels with their gains.
CATEGORIES = ("TARGET_NOT_FOUND", "ASSERTION_FAILED", "PAGE_STATE_UNEXPECTED", "INPUT_REJECTED", "TIMEOUT", "NETWORK_ERROR", "APPLICATION_ERROR", "UNKNOWN")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
GAINS = (("irrelevant", 0.0), ("tangential", 1.0), ("useful", 2.0), ("directly_answers", 3.0))


def strip_thinking(text: Column) -> Column:
    """Without ``<think>`` blocks; one that is not closed reaches to the end."""
    return F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", "")


def first_json(text: Column) -> Column:
    """From the first brace to the last, after fences are ignored; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def fenced_json(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))


def salvage_json(text: Column) -> Column:
    """What begins with a brace, without marks of thinking; else from the last brace before ``cases``, ``caseList`` or ``data``
    on, the first of these that occurs; else a fenced object; else the text without the marks."""
    bare = strip(F.regexp_replace(text, r"</?think>", ""))
    key = F.coalesce(*[F.nullif(F.instr(bare, f'"{k}":'), F.lit(0)) for k in ("cases", "caseList", "data")])
    before = F.regexp_extract(F.substr(bare, F.lit(1), key), r"(?s)^(.*)\{", 1)
    around = F.when(F.contains(F.substr(bare, F.lit(1), key), F.lit("{")), F.substr(bare, F.char_length(before) + 1))
    fenced = strip(F.regexp_extract(bare, r"(?s)```json(.*?)```", 1))
    return F.when(F.startswith(bare, F.lit("{")), bare).when(around.isNotNull(), around).when(F.startswith(fenced, F.lit("{")), fenced).otherwise(bare)


def delimited_records(text: Column) -> Column:
    """Records between end marks that are objects, without a trailing comma."""
    parts = F.transform(F.split(text, RECORD_END), lambda x: strip(F.regexp_replace(strip(x), r",\s*$", "")))
    return F.filter(parts, lambda x: F.startswith(x, F.lit("{")))


def sse_frame(event: str, text: Column) -> Column:
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    return F.concat(F.lit(f"event: {event}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def clean_query(text: Column) -> Column:
    """Without a leading number; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(strip(text), r"^\d+\.\s*", "")), F.lit(""))


#: The number or letter of a line: in brackets, or with a mark after it. A word, or a number with decimals, is none. The group is
#: the first character after a number with a point.
NUMBERING = r"^(?:[\[(（][0-9a-zA-Z]{1,3}[\])）][.、]?\s*|[0-9]{1,3}[、。)）]\s*|[0-9]{1,3}[.,]\s*([^0-9\s])|[a-zA-Z][.、)）]\s+)"


def query_variants(query: Column, response: Column, most: int = 5) -> Column:
    """The query, then a response's lines without their numbers that are longer than three characters; different, five at most."""
    lines = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.regexp_replace(strip(x), NUMBERING, "$1"))
    return F.slice(F.array_distinct(F.concat(F.array(query), F.filter(lines, lambda x: F.char_length(x) > 3))), 1, most)


def is_requirement(text: Column) -> Column:
    """A user story: as someone, I want something."""
    return (F.contains(text, F.lit("作为")) | F.contains(text, F.lit("身为"))) & (F.contains(text, F.lit("我想要")) | F.contains(text, F.lit("我希望")) | F.contains(text, F.lit("我想")))


# A requirement's parts, and what is wanted in it.
PARTS = r"作为[\w\s,，]+[，。,]|我想要[\w\s我想要的内容]+[，。,]|以便于[\w\s]+[，。,]?"
WANTED = r"我想要(.{2,20}?)(?:以便于|为了|$)"


def requirement_parts(text: Column) -> Column:
    """The parts of a requirement without their marks, longer than two characters, then what is wanted; without repeats."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), lambda x: strip(F.regexp_replace(x, "[，,。]", "")))
    wanted = F.transform(F.regexp_extract_all(text, F.lit(WANTED), F.lit(1)), strip)
    return F.array_distinct(F.concat(F.filter(parts, lambda x: F.char_length(x) > 2), F.filter(wanted, lambda x: F.char_length(x) > 1)))


# Families of short queries by their signs; the first that fits is taken.
FAMILIES = (
    (("退", "退款", "退货"), ("申请退款的完整操作流程", "退款审核处理流程", "订单退款步骤")),
    (("增", "添加", "新建"), ("新增数据的操作方法", "添加记录流程")),
    (("删", "删除"), ("删除数据的操作流程", "数据删除注意事项")),
    (("改", "修改", "编辑"), ("修改信息的操作方法", "数据编辑更新流程")),
    (("查", "查询", "搜索"), ("查询数据的方法和步骤", "搜索筛选操作流程")),
)


def expand_short(text: Column, most: int = 10) -> Column:
    """A query under ten characters with its family's queries; null if it is longer or of no family."""
    chosen = F.lit(None).cast("array<string>")
    for signs, more in reversed(FAMILIES):
        fits = F.lit(False)
        for sign in signs:
            fits = fits | F.contains(text, F.lit(sign))
        chosen = F.when(fits, F.array(*map(F.lit, more))).otherwise(chosen)
    return F.when(F.char_length(text) < most, F.array_distinct(F.concat(F.array(text), chosen)))


def rewrite(text: Column, response: Column) -> Column:
    """The queries to ask: a requirement's parts, else a short query's family, else the variants in a response with the query.

    A blank query asks nothing.
    """
    query = strip(text)
    some = lambda a: F.when(F.size(a) > 0, a)
    asked = F.coalesce(F.when(is_requirement(query), some(requirement_parts(query))), some(expand_short(query)), query_variants(query, response))
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast("array<string>")).otherwise(asked)


def shortest(queries: Column) -> Column:
    """The shortest of an array, the first of those as short."""
    keyed = F.transform(queries, lambda x, i: F.struct(F.char_length(x).alias("n"), i.alias("i"), x.alias("q")))
    return F.array_min(keyed)["q"]


def judge_scores(p: Column) -> list[Column]:
    """From a map of label probabilities: by choice, expected gain, and expected gain over three. Missing labels are 0."""
    value = {name: F.coalesce(F.try_element_at(p, F.lit(name)), F.lit(0.0)) for name, _ in GAINS}
    expected = value["directly_answers"] * 3 + value["useful"] * 2 + value["tangential"]
    return [value["directly_answers"].alias("score_choice"), expected.alias("score_expected"), (expected / 3).alias("score_normalized")]


JUDGE = "answers struct<relevance: struct<choice: string, probabilities: map<string,double>>>"


def parse_judgement(raw: Column) -> Column:
    """``choice``, ``probabilities`` and ``confidence``; a bad response is irrelevant with no probabilities."""
    answer = F.from_json(raw, JUDGE)["answers"]["relevance"]
    number = lambda *paths: F.coalesce(*[F.get_json_object(raw, p).try_cast("double") for p in paths])
    return F.struct(
        F.coalesce(answer["choice"], F.lit("irrelevant")).alias("choice"),
        F.coalesce(answer["probabilities"], F.from_json(F.lit("{}"), "map<string,double>")).alias("probabilities"),
        number("$.provider_metadata.typesafe.confidence.relevance", "$.providerMetadata.typesafe.confidence.relevance").alias("confidence"),
    )


def parse_diagnosis(raw: Column) -> Column:
    """Category, summary, root cause, confidence and suggestion; unknown values are UNKNOWN and LOW, the raw text is cut."""
    obj = first_json(raw)
    get = lambda k: F.get_json_object(obj, f"$.{k}")
    known = lambda c, values, other: F.when(F.upper(c).isin(*values), F.upper(c)).otherwise(other)
    return F.struct(
        known(get("category"), CATEGORIES, "UNKNOWN").alias("category"),
        F.coalesce(get("summary"), F.lit("")).alias("summary"),
        F.coalesce(get("rootCause"), F.lit("")).alias("root_cause"),
        known(get("confidence"), CONFIDENCES, "LOW").alias("confidence"),
        F.coalesce(get("suggestedRecovery"), F.lit("")).alias("suggested_recovery"),
        F.substring(raw, 1, 500).alias("raw_response"),
    )


def describe_step(number: Column, action: Column, target: Column, value: Column) -> Column:
    """``1. CLICK [target] with value: v``; parts that are null or empty are left out."""
    part = lambda before, c, after: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(number.cast("string"), F.lit(". "), action, part(" [", target, "]"), part(" with value: ", value, ""))


def content_hash(text: Column) -> Column:
    """SHA-256 in hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def mask_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***@")


def escape_like(word: Column) -> Column:
    one = F.replace(word, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(one, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
