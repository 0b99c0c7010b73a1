"""Text as Spark columns: splitting, cleaning, line filters and character similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The split points of each level.
PARAGRAPH = r"(?<=\n\n)"
SENTENCE = r"(?<=[。！？.!?])"
CLAUSE = r"(?<=[，,；;])"
PIECE = r"(?<=\n\n)|(?<=\n)|(?<=。)"
PARSER_SENTENCE = r"(?<=[。！？.?!])\s*"
CJK = r"[㐀-䶿一-鿿豈-﫿]"

#: What ``strip`` takes off.
BLANKS = " \t\r\n"


def strip(text: Column) -> Column:
    """Without blanks, tabs and line ends at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return _pieces(text, PARAGRAPH)


def sentences(text: Column) -> Column:
    return _pieces(text, SENTENCE)


def clauses(text: Column) -> Column:
    return _pieces(text, CLAUSE)


def etl_pieces(text: Column) -> Column:
    return F.filter(F.split(text, PIECE), lambda x: strip(x) != "")


def parser_sentences(text: Column) -> Column:
    return _pieces(text, PARSER_SENTENCE)


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks become one, blank lines hold nothing, the ends are trimmed."""
    one = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"\n[ \t]+\n", "\n\n"), r"^\s+|\s+$", "")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_lines(text: Column) -> Column:
    """Lines but blank ones, page numbers (digits only) and lines with a replacement character."""
    lines = F.split(normalize_newlines(text), "\n")
    keep = lambda x: (strip(x) != "") & ~strip(x).rlike(r"^\d+$") & ~F.contains(x, F.lit("�"))
    return F.filter(lines, keep)


def split_level(text: Column, most: int) -> Column:
    """1 if every paragraph has at most ``most`` characters, else 2 if every sentence has, else 3."""
    fits = lambda x: F.char_length(x) <= most
    return F.when(F.forall(paragraphs(text), fits), 1).when(F.forall(sentences(text), fits), 2).otherwise(3)


def short_text_parts(text: Column, least: int = 5) -> Column:
    """Parts between full stops, line ends and semicolons that are longer than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"[。\n;]"), strip), lambda x: F.char_length(x) > least)


# Openings of lines that only talk, and the form of a scenario.
CHATTER = ("让我", "按照", "这个", "要求", "分析", "确认", "输出", "以下", "任务", "##", "# ", "**")
SCENARIO = r"^[\S]+[：:][^→]+→[^→]+$"


def scenario_lines(text: Column) -> Column:
    """Lines of the form ``name: step → result``, without marks of lists and repeats; else any line with an arrow."""
    trimmed = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def is_chatter(x: Column) -> Column:
        talk = F.startswith(x, F.lit("功能场景")) & F.contains(x, F.lit("示例"))
        for opening in CHATTER:
            talk = talk | F.startswith(x, F.lit(opening))
        return talk

    strict = F.transform(F.filter(trimmed, lambda x: ~is_chatter(x) & x.rlike(SCENARIO)), lambda x: F.regexp_replace(x, r"^[\-\*\d\.]+\s*", ""))
    strict = F.array_distinct(F.filter(strict, lambda x: F.char_length(x) >= 10))
    loose = F.filter(F.transform(trimmed, lambda x: F.regexp_replace(x, "<think>.*?</think>", "")), lambda x: F.contains(x, F.lit("→")) & (F.char_length(x) >= 10))
    return F.when(F.size(strict) > 0, strict).otherwise(loose)


def char_set(text: Column) -> Column:
    """The text's different letters and digits, in lower case."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}]", ""))
    return F.array_distinct(F.filter(F.split(kept, ""), lambda x: x != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def char_jaccard(a: Column, b: Column) -> Column:
    """Equal texts have 1, null 0; else the Jaccard index of the character sets, 0 if both are empty."""
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(set_jaccard(char_set(a), char_set(b)))


def case_text(raw: Column) -> Column:
    """Of a JSON test case its title, steps and expected outcome; of any other text the text itself."""
    field = lambda *paths: F.coalesce(*[F.get_json_object(raw, f"$.{p}") for p in paths], F.lit(""))
    is_json = F.trim(raw).rlike(r"(?s)^\{.*\}$") & F.json_object_keys(raw).isNotNull()
    return F.when(is_json, F.concat_ws(" ", field("title"), field("steps"), field("expectedOutcome", "expectedResult"))).otherwise(raw)


def token_count(text: Column) -> Column:
    """A deterministic count: a CJK character is a token, any other word ceil(characters / 4)."""
    words = F.filter(F.split(F.regexp_replace(text, CJK, " "), r"\s+"), lambda w: w != "")
    rest = F.aggregate(F.transform(words, lambda w: F.ceil(F.char_length(w) / 4).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(F.regexp_count(text, F.lit(CJK)).cast("long") + rest, F.lit(0).cast("long"))


def is_markdown(text: Column) -> Column:
    return text.rlike(r"(?m)^(#{1,6})\s+(.+)$")


def first_header(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1)


def header_lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}\s+.+)$"), F.lit(1))


def markdown_table(header: Column, rows: Column) -> Column:
    """Header row, rule, and rows with bars escaped and line ends as blanks; all from arrays of strings."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    safe = lambda c: F.replace(F.regexp_replace(c, r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    rule = line(F.transform(header, lambda _: F.lit("---")))
    body = F.transform(rows, lambda r: line(F.transform(r, safe)))
    return F.array_join(F.concat(F.array(line(header), rule), body), "\n")


def is_table_row(line: Column) -> Column:
    t = strip(line)
    return (F.startswith(t, F.lit("|")) | F.endswith(t, F.lit("|"))) & ~t.rlike(r"^\|+$") & (t != "")


def is_table_block(block: Column) -> Column:
    """At least two lines, all of them rows, one of them a rule."""
    lines = F.split(strip(block), "\n")
    return (F.size(lines) >= 2) & F.forall(lines, is_table_row) & F.exists(lines, lambda x: x.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"))
