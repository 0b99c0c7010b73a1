"""How far the sources of a language are apart in their words, by tiles of groups.

A group is a source within a language. Terms are counted in the tasks that read the documents, one row per task, group and
term, and summed by a shuffle. The terms that enough documents of the language hold are numbered within chunks of the
vocabulary, and each group's counts are packed into a vector per chunk. Groups are dealt to blocks. The vectors of a block
go to every tile, a pair of blocks, that the block is in; a task takes a tile and a section of the vocabulary, goes through its
chunks one after the other and adds up the submatrix of its pairs. The sections' matrices are then summed.

All numbers are integers: p = 1 + floor(SCALE * (count + 1) / (N + V)), where N sums the group's counts of kept terms and V is
the number of kept terms; a term adds floor((p - q)^2 / q) for q of the other side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save_table, small

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Groups in a block, terms in a chunk and chunks in a section, each about so many: they are dealt out by hashes.
BLOCK, CHUNK, SECTION = 64, 4_096, 64
#: A task hands on its counts when it holds so many.
HELD = 400_000

# letters stay, A-Z lowered; all other ASCII separates terms
_LETTERS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The maximal runs of ASCII letters and characters beyond ASCII, A-Z lowered, as UTF-8."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs``; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (l_, s), (n, d) in held.items():
                words = list(n)
                columns = [[l_] * (len(words) + 1), [s] * (len(words) + 1), [None, *(w.decode() for w in words)], [0, *n.values()], [0, *(d[w] for w in words)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for t, l_, s in zip(*batch.columns, strict=True):
                n, d = held.setdefault((l_.as_py(), s.as_py()), (Counter(), Counter()))
                before, found = len(n), Counter(terms_of(t.as_py()))
                n.update(found)
                d.update(found.keys())
                size += len(n) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate((text, lang, source))])
    found = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """p of a count; the product is a decimal, so no count is too large."""
    return F.expr(f"1 + (CAST({n} AS DECIMAL(20, 0)) + 1) * CAST({SCALE} AS DECIMAL(10, 0)) DIV ({total})").cast("long")


def scaled(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """p of each count, three decimal digits at a time, so that no product leaves 64 bits."""
    rest, p = counts + 1, np.zeros(np.broadcast(counts, totals).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1_000
        p = p * 1_000 + rest // totals
        rest = rest % totals
    return p + 1


def tile_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of ``p`` and each of ``q`` the sum over the columns of floor((p - q)^2 / q)."""
    out = np.zeros((len(p), len(q)), dtype=np.int64)
    for i, x in enumerate(p):
        d = x[None, :] - q
        out[i] = (d * d // q).sum(axis=1)
    return out


class _Tile:
    """The submatrices of a tile over a section of the vocabulary, chunk after chunk."""

    def __init__(self, key: tuple):
        self.lang, self.low, self.high, self.section = key
        self.groups: tuple[list, list] = ([], [])  # name, N and V of the groups of both blocks
        self.sums: tuple[np.ndarray, np.ndarray] | None = None
        self.seen = 0

    def add(self, rows: list[tuple]) -> None:
        """The vectors (side, place, numbers of terms, counts) of a chunk."""
        sides = range(1 if self.low == self.high else 2)
        terms = np.unique(np.concatenate([r[2] for r in rows]))
        if self.sums is None:
            a, b = len(self.groups[0]), len(self.groups[sides[-1]])
            self.sums = np.zeros((a, b), dtype=np.int64), np.zeros((b, a), dtype=np.int64)
        counts = [np.zeros((len(self.groups[s]), len(terms)), dtype=np.int64) for s in sides]
        for side, place, numbers, n in rows:
            counts[side][place, np.searchsorted(terms, numbers)] = n
        p = [scaled(counts[s], np.array([g[1] + g[2] for g in self.groups[s]], dtype=np.int64)[:, None]) for s in sides]
        self.seen += len(terms)
        self.sums[0][:] += tile_sums(p[0], p[sides[-1]])
        if self.low != self.high:
            self.sums[1][:] += tile_sums(p[1], p[0])

    def rows(self) -> Iterator[tuple]:
        """lang, both groups' names, N and V, the sum, and how many terms it is over."""
        own = self.low == self.high
        for forth, x, y in ((0, 0, 0 if own else 1), *([] if own else [(1, 1, 0)])):
            for i, (name, n, v) in enumerate(self.groups[x]):
                for j, (other, m, _) in enumerate(self.groups[y]):
                    if name != other:
                        yield self.lang, name, other, n, m, v, int(self.sums[forth][i, j]) if self.sums else 0, self.seen


def pair_values(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` and ``value`` of all ordered pairs of groups of a language.

    ``groups`` (lang, source, block, blocks, place, total, terms, chunks); ``vectors`` (lang, source, chunk, numbers, counts).
    """
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    last = F.floor((F.greatest("chunks", F.lit(1)) - 1) / SECTION).cast("int")
    # every task is told the groups of its blocks before any vector
    heads = groups.select("*", tiles).withColumn("section", F.explode(F.sequence(F.lit(0), last)))
    heads = heads.select("lang", "block", "other", "section", F.lit(-1).alias("chunk"), "place", "source", "total", "terms", F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("array<long>").alias("counts"))
    packed = vectors.join(small(groups), ["lang", "source"]).select("*", tiles)
    packed = packed.select("lang", "block", "other", F.floor(F.col("chunk") / SECTION).cast("int").alias("section"), "chunk", "place", F.lit(None).cast("string").alias("source"), "total", "terms", "numbers", "counts")
    dealt = heads.union(packed).select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "section", "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "place", "source", "total", "terms", "numbers", "counts")
    key = ["lang", "low", "high", "section"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "chunk", "side", "place")
    names = ["lang", "source", "item", "n", "m", "v", "value", "seen"]
    kinds = [pa.string()] * 3 + [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, rows = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                tile.add(rows)
                rows.clear()
            if tile:
                out = list(tile.rows())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

        for batch in batches:
            *keys, chunks, sides, places, sources, totals, terms = (batch.column(c).to_pylist() for c in range(10))
            numbers, counts = batch.column(10), batch.column(11)
            for i, at in enumerate(zip(*keys, strict=True)):
                if tile is None or (tile.lang, tile.low, tile.high, tile.section) != at:
                    yield from done()
                    tile, chunk = _Tile(at), None
                if chunks[i] < 0:
                    tile.groups[sides[i]].append((sources[i], totals[i], terms[i]))
                    continue
                if chunks[i] != chunk and rows:
                    tile.add(rows)
                    rows.clear()
                chunk = chunks[i]
                rows.append((sides[i], places[i], numbers[i].values.to_numpy(), counts[i].values.to_numpy()))
        yield from done()

    sums = dealt.mapInArrow(run, "lang string, source string, item string, n long, m long, v long, value long, seen long")
    whole = sums.groupBy("lang", "source", "item", "n", "m", "v").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # terms that no group of the two blocks has add the same each
    p, q = _share("0", "n + v"), _share("0", "m + v")
    rest = whole.where("v > 0").withColumns({"p": p, "q": q}).withColumn("value", F.expr("value + (v - seen) * ((p - q) * (p - q) DIV q)"))
    return rest.select("lang", "source", "item", "value").union(whole.where("v = 0").select("lang", "source", "item", F.lit(0).cast("long")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: how far each group is from the others, and by which terms.

    Part ``pair``: each other source of the language, with the sum over all kept terms. Part ``term``: the ``top`` kept terms
    that the group uses more than its language does. Kept are the terms in at least ``min_docs`` rows of the language. Ranks
    go by value, largest first, ties by item in UTF-8 order. Nulls in all three columns count as empty strings, so they
    make groups of their own; empty texts count as documents without terms, and a group without terms is paired all the same; a
    language without kept terms has values of 0. Repeated rows count as often as they are there, texts of any length are taken
    whole, and an empty table gives an empty one. Other columns, whatever their names, are not read.
    """
    counts = save_table(term_counts(docs, text, lang, source), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = save_table(kept.select("lang", "term", "lang_n"), "divergence-kept")
    langs = save_table(kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms")).withColumn("chunks", F.ceil(F.col("terms") / chunk).cast("int")), "divergence-langs")
    # numbers of terms within a chunk, which holds about ``chunk`` of them
    numbered = kept.join(small(langs), "lang").withColumn("chunk", F.expr("CAST(pmod(xxhash64(term), chunks) AS INT)"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    held = save_table(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "divergence-held")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(small(langs.select("lang", "terms", "chunks")), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "chunks")])
    many = save_table(groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "divergence-blocks")
    dealt = groups.join(small(many), "lang").withColumn("block", F.expr("CAST(pmod(xxhash64(source), blocks) AS INT)"))
    groups = save_table(dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1), "divergence-groups")
    entry = F.array_sort(F.collect_list(F.struct("number", "n")))
    vectors = held.groupBy("lang", "source", "chunk").agg(entry.alias("e")).select("lang", "source", "chunk", F.col("e.number").alias("numbers"), F.col("e.n").alias("counts"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, vectors).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = held.join(small(groups.select("lang", "source", "total")), ["lang", "source"]).withColumns({"p": _share("n", "total + terms"), "q": _share("lang_n", "lang_total + terms")})
    own = own.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    # the limit of the rank is applied before the exchange as well
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
h AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
g AS (SELECT s.lang, s.source, coalesce(sum(h.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN h ON h.lang = s.lang AND h.source = s.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(h.n, 0) + 1) // (g.total + l.v) AS p,
    1 + {SCALE}::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= {TOP}"""
