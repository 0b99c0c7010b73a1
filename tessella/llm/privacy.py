"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find the protected entities: e-mail and IP addresses, card and phone numbers (the base spans), and secrets, which
are long values given to names such as ``token`` or ``password``. A term near an entity discloses it
by pointwise mutual information: log2(p(t, e) / (p(t) p(e))). Against the entity's own information, -log2 p(e), this
is a ratio of at most 1, which is reached when the term occurs with the entity only:

    ratio = 1 - log2(n(t) / n(t, e)) / log2(N / n(e))

with N rows in the corpus, n(e) rows that hold the entity, n(t) rows that hold the term, and n(t, e) rows that hold the
term within WINDOW words of the entity. Terms at or above REMOVE are removed, at or above GENERALISE generalised; both only
in documents that hold the entity, and only if MIN_TEXTS different texts support the pair. Other documents stay as they are.
The classes come from the corpus: a term becomes the longest of its beginnings of PREFIXES letters that so many rows share
that it is below GENERALISE for the same entity, or else nothing but TERM.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, fresh, save_table, small

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
WINDOW = 10
MIN_TEXTS = 3
MIN_TERM_CHARS = 3
GENERALISE, REMOVE = 0.9, 0.97
PREFIXES = (6, 4, 2)

#: Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits without a dot after it is not tried again from its middle
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)[\"']? ?[:=] ?[\"']?([a-z0-9+/_=-]{16,})")
_WORD = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: from each @ back over the local part, which holds no @, then on over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Kind, start and end (code points, end exclusive), by kind and then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def protected_spans(text: str) -> list[Span]:
    """The base spans, then the values of secrets."""
    return base_spans(text) + [(SECRET, *m.span(1)) for m in _SECRET.finditer(text)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity_of(kind: str, raw: str) -> str:
    """An entity's name: spelled alike wherever it occurs, and hashed, so that no table holds it in the clear."""
    plain = raw if kind == SECRET else raw.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", raw)
    return hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=16).hexdigest()


class Words:
    """A text's words in lower case with their places, and which of them are free of ``spans``."""

    def __init__(self, text: str, spans: list[Span]):
        found = list(_WORD.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.words = [m.group().lower() for m in found]
        self.free = [True] * len(found)
        for _, a, b in spans:
            for i in range(bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)):
                self.free[i] = False

    def is_term(self, i: int) -> bool:
        return self.free[i] and self.ends[i] - self.starts[i] >= MIN_TERM_CHARS and not self.words[i].isdigit()

    def near(self, start: int, end: int, window: int) -> set[str]:
        """Terms among the ``window`` words before and after; words of entities are none."""
        before, after = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        at = [*range(max(0, before - window), before), *range(after, min(len(self.words), after + window))]
        return {self.words[i] for i in at if self.is_term(i)}


def mentions(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each entity of each row of ``docs``: ``row_text`` (the text's MD5), ``entity`` and the ``terms`` near it.

    For each row with entities another one, without an entity, has all terms of the text.
    """
    schema = StructType([StructField("row_text", StringType()), StructField("entity", StringType()), StructField("terms", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for t in batch.column("t"):
                t = t.as_py()
                found: dict[str, set[str]] = {}
                spans = protected_spans(t)
                if spans:
                    key = hashlib.md5(t.encode("utf-8", "replace")).hexdigest()
                    words = Words(t, spans)
                    for kind, a, b in spans:
                        found.setdefault(entity_of(kind, t[a:b]), set()).update(words.near(a, b, window))
                    rows += [{"row_text": key, "entity": e, "terms": sorted(w)} for e, w in found.items()]
                    rows.append({"row_text": key, "entity": None, "terms": sorted({w for i, w in enumerate(words.words) if words.is_term(i)})})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_text", pa.string()), ("entity", pa.string()), ("terms", pa.list_(pa.string()))]))

    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(run, schema)


def forms(text: str) -> set[str]:
    """A text's different words in lower case, and their beginnings with a star."""
    words = {w.lower() for w in _WORD.findall(text)}
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in PREFIXES))


def term_rows(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``term`` and ``n_term``: rows of all of ``docs`` that hold it, for the terms of the written table ``terms``.

    A term with a star stands for the words that begin so. Both ways count the same: up to BROADCAST_ROWS terms are
    sent to the tasks, each of which counts its rows and returns one row per term; for more, all terms of the corpus are
    counted by a shuffle.
    """
    own = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    known = terms.select("term").limit(BROADCAST_ROWS + 1).collect()
    if len(known) > BROADCAST_ROWS:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1_000):
                    found = [w for t in whole.column("t").slice(at, 1_000) for w in forms(t.as_py())]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

        words = own.mapInArrow(split, "term string")
        return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column("t"):
                counts.update(shared.value.intersection(forms(t.as_py())))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return own.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, text: str = "text", window: int = WINDOW, generalise: float = GENERALISE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``row_text``, ``terms``, ``ratios`` and ``classes``: for each text with entities, its terms that disclose one of them.

    Of a term that discloses several of a text's entities the largest ratio and the shortest class count.
    """
    found = save_table(mentions(docs, text, window), "privacy-mentions")
    n_rows = docs.count()
    # rows of a text that repeats are counted once per text first, so a hot text is one row from each task
    texts = found.where("entity IS NOT NULL").groupBy("row_text", "entity").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    texts = save_table(texts, "privacy-texts")
    entities = texts.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= min_texts).drop("n_texts")
    entities = save_table(entities, "privacy-entities")
    near = texts.join(small(entities), "entity").select("row_text", "entity", "n", "n_entity", F.explode("terms").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("n_texts"), F.first("n_entity").alias("n_entity")).where(F.col("n_texts") >= min_texts)
    pairs = save_table(pairs.drop("n_texts"), "privacy-pairs")
    schema = "row_text string, terms array<string>, ratios array<double>, classes array<string>"
    if not pairs.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema)
    # the term itself, then what it can be generalised to, from the longest on
    beginnings = [F.when(F.char_length("term") > k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in PREFIXES]
    shapes = pairs.select("*", F.posexplode(F.array_compact(F.array("term", *beginnings))).alias("level", "shape"))
    shapes = save_table(shapes, "privacy-shapes")
    counts = save_table(term_rows(docs, save_table(shapes.select(F.col("shape").alias("term")).distinct(), "privacy-terms"), text), "privacy-counts")
    own = F.greatest(F.log2(F.lit(float(n_rows)) / F.col("n_entity")), F.lit(1e-9))
    # a row counts once for a term however often it holds it, so n_term is at least n_pair
    ratio = 1 - F.log2(F.greatest(F.col("n_term") / F.col("n_pair"), F.lit(1.0))) / own
    scored = shapes.join(small(counts.withColumnRenamed("term", "shape")), "shape").withColumn("ratio", ratio)
    safe = F.when((F.col("level") > 0) & (F.col("ratio") < generalise), F.struct(-F.col("level"), "shape"))
    telling = scored.groupBy("entity", "term").agg(F.max(F.when(F.col("level") == 0, F.col("ratio"))).alias("ratio"), F.max(safe).alias("class"))
    telling = save_table(telling.where(F.col("ratio") >= generalise).select("entity", "term", "ratio", F.coalesce("class.shape", F.lit("")).alias("class")), "privacy-telling")
    # only terms that the text holds: its own terms first, few of which tell anything, then its entities
    held = found.where("entity IS NULL").groupBy("row_text").agg(F.first("terms").alias("terms")).select("row_text", F.explode("terms").alias("term"))
    told = held.join(small(telling), "term").join(texts.select("row_text", "entity"), ["row_text", "entity"])
    per_text = told.groupBy("row_text", "term").agg(F.max("ratio").alias("ratio"), F.min(F.struct(F.length("class").alias("n"), "class")).alias("c"))
    listed = per_text.groupBy("row_text").agg(F.sort_array(F.collect_list(F.struct("term", "ratio", "c.class"))).alias("t"))
    return save_table(listed.select("row_text", F.col("t.term").alias("terms"), F.col("t.ratio").alias("ratios"), F.col("t.class").alias("classes")), "privacy-disclosing")


def term_spans(text: str, terms: dict[str, tuple[float, str]], spans: list[Span]) -> list[Span]:
    """All occurrences of the terms outside the other spans."""
    if not terms:
        return []
    words = Words(text, spans)
    return [(TERM, words.starts[i], words.ends[i]) for i, w in enumerate(words.words) if w in terms and words.free[i]]


def mask(text: str, spans: list[Span], terms: dict[str, tuple[float, str]], remove: float = REMOVE) -> str:
    """Entities become their kind, terms a class or nothing. Overlapping spans are masked as one, by the first's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out.append(text[end:a])
            if kind == TERM:
                ratio, wider = terms[text[a:b].lower()]
                out.append("" if ratio >= remove else f"<{wider or TERM.upper()}>")
            else:
                out.append(f"<{kind.upper()}>")
        end = max(end, b)
    return "".join(out) + text[end:]


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that ``sanitise`` adds."""
    return fresh(docs, "clean_text", "pii")


def sanitise(docs: DataFrame, text: str = "text", window: int = WINDOW, generalise: float = GENERALISE, remove: float = REMOVE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with ``clean_text`` and ``pii`` (array of kind, start, end: the base spans by kind and start, secrets, terms).

    A null text counts as empty: it has no spans, and its clean text is null. Equal texts are treated alike, rows may
    repeat, an empty table gives an empty one; the work on a text grows with its length. A ratio that equals a threshold is above it.
    Columns of ``docs`` stay; a new column whose name is taken gets an underscore before it (``added``).
    """
    clean_text, pii = added(docs)
    key, key2, terms, ratios, wider = fresh(docs, "pii_key", "pii_key2", "pii_terms", "pii_ratios", "pii_classes")
    disclosing = disclosing_terms(docs.select(F.col(f"`{text}`").alias("text")), "text", window, generalise, min_texts).toDF(key2, terms, ratios, wider)
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([*docs.schema.fields, StructField(clean_text, StringType()), StructField(pii, ArrayType(span))])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                clean, found = [], []
                for t, w, r, c in zip(batch.column(text), batch.column(terms), batch.column(ratios), batch.column(wider), strict=True):
                    t = t.as_py()
                    spans = protected_spans(t or "")
                    told = dict(zip(w.as_py(), zip(r.as_py(), c.as_py(), strict=True), strict=True)) if w.is_valid else {}
                    spans += term_spans(t or "", told, spans)
                    clean.append(mask(t, spans, told, remove) if spans else t)
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(clean, pa.string()), pa.array(found, kinds)], names=[*names, clean_text, pii])

    keyed = docs.withColumn(key, F.md5(f"`{text}`"))
    both = keyed.join(small(disclosing), F.col(key) == F.col(key2), "left").drop(key, key2)
    return both.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = sanitise(docs).select("doc_id", "pii")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))

    def number(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.size(F.filter("pii", lambda s: s["kind"] != TERM)).cast("long").alias("n_protected")
    return found.select("doc_id", *map(number, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), number(SECRET), number(TERM), every)
