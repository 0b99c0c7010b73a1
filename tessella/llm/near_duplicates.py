"""Near-duplicate documents by order MinHash.

A document's k-mers are runs of five words, labelled with their occurrence number. For each of M orders the L
least labelled k-mers are taken and kept in text order; one 64-bit number stands for them. This is sensitive to edit
similarity: moved text changes the order, repeated text the labels. Documents that share such a number are in a bucket,
are candidates of each other, and a banded alignment of their words decides: two texts are near if the word edits between
them are at most a fifth of the longer one's words.

Equal texts are one node from the start. First each text is aligned with one leader per bucket. Components of what was linked
then leave open those buckets whose texts are in several components. In these all pairs of different components are compared:
a task takes the texts of a bucket, finds by counts of words which pairs can be near at all, and aligns them.
A bucket of more than BLOCK texts, most of which are one component, is taken apart: its other texts meet that whole component once,
whatever the number of buckets they share, and each other. What is still large is parted by length: texts of more than a quarter
more words can't be near, so a class of lengths meets itself and the next one only, block against block. No pair that
shares a number is left out, and no pairs are emitted but the linked ones. The classes are the connected components.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import fresh, save_table, small

K, L, M = 5, 2, 76
SIMILARITY = 0.8
#: Buckets of more texts, or of more words in all, are taken apart and then compared in blocks.
BLOCK, BLOCK_WORDS = 256, 400_000
#: Words are counted in so many places for a bound on what two texts have in common.
PLACES = 256
#: Texts of more words are aligned with masks of the band only.
DENSE = 4_096

_words = re.compile(r"\w+").findall
_rng = np.random.default_rng(20_240_517)
_SEEDS = _rng.integers(1, 2**63, size=M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LARGEST = np.uint32(2**32 - 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def kmer_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = _mix(h + words[i : i + n] + _ODD)
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """The number of equal values before each value."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    place = np.arange(len(s))
    out = np.empty(len(s), dtype=np.uint64)
    out[order] = (place - np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), place, 0))).astype(np.uint64)
    return out


def labelled_runs(words: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Each run's hash, and a hash of it and its occurrence number among equal runs. A shorter text is one run."""
    with np.errstate(over="ignore"):
        h = kmer_hashes(words.astype(np.uint64), min(k, len(words)))
        return h, _mix(h + occurrences(h) * _ODD)


def sketch(words: np.ndarray, k: int = K, least: int = L) -> np.ndarray:
    """M numbers; none for a text without words."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    h, label = labelled_runs(words, k)
    with np.errstate(over="ignore"):
        take = min(least, len(h))
        step = max(1, 40_000 // len(h))  # so that an order's numbers stay in a core's cache
        out = np.zeros(M, dtype=np.uint64)
        for a in range(0, M, step):
            x = label[None, :] * _SEEDS[a : a + step, None]
            x >>= np.uint64(32)
            order = x.astype(np.uint32)
            rows, at = np.arange(len(order)), np.empty((len(order), take), dtype=np.int64)
            for i in range(take):
                at[:, i] = order.argmin(axis=1)
                order[rows, at[:, i]] = _LARGEST
            at.sort(axis=1)  # text order
            v = np.zeros(len(rows), dtype=np.uint64)
            for i in range(take):
                v = _mix(v + h[at[:, i]] + _ODD)
            out[a : a + step] = v
    return out


class _Masks:
    """For a word, a mask of its places among the ``width`` places from ``shift`` on."""

    def __init__(self, a: np.ndarray, width: int):
        self.width, self.dense = width, len(a) <= DENSE
        if self.dense:
            self.at: dict[int, int] = {}
            for i, x in enumerate(a.tolist()):
                self.at[x] = self.at.get(x, 0) | 1 << i
            return
        self.order = np.argsort(a, kind="stable")
        ordered = a[self.order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.range = dict(zip(ordered[first].tolist(), zip(first.tolist(), np.append(first[1:], len(a)).tolist(), strict=True), strict=True))

    def of(self, word: int, shift: int) -> int:
        if self.dense:
            bits = self.at.get(word, 0)
            return (bits >> shift if shift >= 0 else bits << -shift) & ((1 << self.width) - 1)
        i, j = self.range.get(word, (0, 0))
        places = self.order[i:j]
        places = places[np.searchsorted(places, shift) : np.searchsorted(places, shift + self.width)] - shift
        if len(places) <= 4:
            return sum(1 << p for p in places.tolist())
        bits = np.zeros(self.width, dtype=bool)
        bits[places] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel over a band: for each column of the alignment's table one integer holds which of the 2 * most + 1 cells
    around the diagonal are one more than the cell above, another which are one less. The band moves down a row per column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    width = 2 * most + 1
    masks = _Masks(a, width)
    full, edge = (1 << width) - 1, 1 << (2 * most)
    more, less = full & ~((1 << most) - 1), 0
    distance, down = min(most, n), max(0, n - most)  # so many columns until the band reaches the last row
    for j, y in enumerate(b.tolist()):
        shift = j - most
        equal = masks.of(y, shift)
        diagonal = ((((equal & more) + more) ^ more) | equal | less) & full
        right_more = (less | ~(diagonal | more)) & full
        right_less = diagonal & more
        if j < down:
            distance += not diagonal & edge
        else:
            row = 1 << (n - 1 - shift)
            distance += bool(right_more & row) - bool(right_less & row)
        shifted = diagonal >> 1
        more = (right_less | ~(shifted | right_more)) & full
        less = shifted & right_more
    return distance if distance <= most else None


def most_edits(words: int, similarity: float = SIMILARITY) -> int:
    """How many word edits may part two near texts, the longer of which has so many words."""
    return int(words * (1 - similarity) + 1e-9)


def are_near(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of words are at most ``most_edits`` apart; only their alignment says so."""
    longer = max(len(a), len(b))
    most = most_edits(longer, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    for _ in range(2):  # without the common beginning and end
        n = min(len(a), len(b))
        diff = np.flatnonzero(a[:n] != b[:n])
        cut = int(diff[0]) if len(diff) else n
        a, b = a[cut:][::-1], b[cut:][::-1]
    longer = max(len(a), len(b))
    if longer <= most:
        return True
    # a word that the other text lacks takes an edit
    if longer - sum((Counter(a.tolist()) & Counter(b.tolist())).values()) > most:
        return False
    return banded_distance(a, b, most) is not None


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``md5`` of the text, ``n`` (words), ``sketch`` (its different numbers) and ``words`` (32-bit hashes)."""
    schema = StructType([StructField("id", LongType()), StructField("md5", BinaryType()), StructField("n", IntegerType()), StructField("sketch", ArrayType(LongType())), StructField("words", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                counts, found, words = [], [], []
                for t in batch.column("t"):
                    hashes = word_hashes(words_of(t.as_py()))
                    counts.append(len(hashes))
                    found.append(np.unique(sketch(hashes)).view(np.int64))
                    words.append(hashes.astype("<u4").tobytes())
                cols = [batch.column("id"), batch.column("md5"), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.unhex(F.md5(f"`{text}`")).alias("md5"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, schema)


def sizes_allow(similarity: float, a: str, b: str):
    """Whether two texts can be near by their numbers of words."""
    return F.greatest(a, b) - F.least(a, b) <= F.floor(F.greatest(a, b) * F.lit(1 - similarity) + F.lit(1e-9))


def verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose texts are near. Spark can split both joins where a text has many pairs."""
    side = lambda x: bodies.select(F.col("key").alias(x), F.col("words").alias(f"words_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                left, right = ([np.frombuffer(x.as_buffer(), "<u4") for x in part.column(c)] for c in ("words_a", "words_b"))
                keep = [are_near(x, y, similarity) for x, y in zip(left, right, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, a node of its connected component that all its nodes agree on, for every node of ``edges`` (a, b).

    Level by level each node takes the least of itself and its neighbours as its label, and labels are the nodes of the next,
    smaller graph, until no edge is left; the levels are then put together from the last to the first.
    """
    edges, levels = save_table(edges.select("a", "b").where("a <> b").distinct(), "near-edges"), []
    while edges.limit(1).count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        level = save_table(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "near-level")
        levels.append(level)
        first, second = (level.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
        moved = edges.join(first, "a").join(second, "b").where("label_a <> label_b")
        edges = save_table(moved.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "near-edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = levels.pop()
    for level in reversed(levels):
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = save_table(level.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "near-labels")
    return labels


def joined_up(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after the links ``found``: only the components that they touch are worked on, each as one node."""
    own = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    pairs = found.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    pairs = save_table(pairs.distinct(), "near-joined")
    if not pairs.limit(1).count():
        return labels
    moved = components(pairs)
    alone = moved.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("now"))
    return save_table(labels.union(alone).join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "near-labels")


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (key, ...) with the label of each text's component; a text without links is its own."""
    own = labels.select(F.col("node").alias("key"), F.col("label").alias("known"))
    return members.join(small(own), "key", "left").withColumn("label", F.coalesce("known", "key")).drop("known")


def met(texts: DataFrame) -> DataFrame:
    """Rows (g, key, n) of the groups of two texts and more of ``texts`` (key, n, sketch), with the group's ``leader``, ``size`` and ``total`` words.

    The leader is the text with the least key, so a text leads nearly all groups of its near texts.
    """
    members = texts.select("key", F.explode("sketch").alias("g"))
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # written before the join: Spark can then split the members of a large group. These tables grow with the corpus, so
    # they are shuffled at any size
    members = members.join(save_table(sizes, "near-sizes"), "g")
    members = save_table(members.join(texts.select("key", "n"), "key"), "near-members")
    about = save_table(members.groupBy("g").agg(F.min("key").alias("leader"), F.sum("n").alias("total")), "near-groups")
    return members.join(about, "g")


def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with labels, of the groups of three texts and more that are in several components."""
    marked = with_labels(members.where("size > 2").select("g", "key", "n", "size", "total"), labels)
    still = marked.groupBy("g").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("g")
    return save_table(marked.join(small(save_table(still, "near-still")), "g"), "near-open")


def block_links(rows: pa.Table, similarity: float, low: int, high: int) -> list[tuple[bytes, bytes]]:
    """Links between texts of one block and another (or itself) that join different components, as a spanning forest."""
    keys, blocks = rows.column("key").to_pylist(), np.array(rows.column("b").to_pylist())
    names: dict = {}
    root = [names.setdefault(x, len(names)) for x in rows.column("label").to_pylist()]
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    words = [np.frombuffer(x, "<u4") for x in rows.column("words").to_pylist()]
    n = np.array(list(map(len, words)))
    # words in common are at most as many as their counts by place allow
    counts = np.bincount(np.repeat(np.arange(len(n)) * PLACES, n) + (np.concatenate(words) % PLACES), minlength=len(n) * PLACES).reshape(-1, PLACES)
    counts = counts.astype(np.int16 if n.max() < 2**14 else np.int32)
    maybe = np.zeros((len(n), len(n)), dtype=bool)
    of, first, second = np.array(root), np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    score = np.zeros((len(n), len(n)), dtype=np.float32)
    for i in first.tolist():
        j = second[(of[second] != of[i]) & (np.abs(n[second] - n[i]) <= np.floor(np.maximum(n[second], n[i]) * (1 - similarity) + 1e-9))]
        longest = np.maximum(n[j], n[i])
        common = (n[j] + n[i] - np.abs(counts[j] - counts[i]).sum(axis=1)) // 2
        good = longest - common <= np.floor(longest * (1 - similarity) + 1e-9)
        maybe[i, j[good]] = True
        score[i, j[good]] = common[good] / np.maximum(longest[good], 1)
    if low == high:
        maybe = np.triu(maybe, 1)
    left, right = np.nonzero(maybe)
    out = []
    for i in np.argsort(-score[left, right], kind="stable").tolist():
        x, y = int(left[i]), int(right[i])
        r, q = find(root[x]), find(root[y])
        if r != q and are_near(words[x], words[y], similarity):
            out.append((keys[x], keys[y]))
            parent[r] = q
    return out


def _block_tasks(dealt: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the rows (g, key, label, b, low, high): a task has two blocks, low and high, of a group g, or one twice."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        found = block_links(table, similarity, group[1].as_py(), group[2].as_py())
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.join(bodies.select("key", "words"), "key").groupBy("g", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _blocks():
    """In how many blocks a group of ``size`` texts of ``total`` words is compared."""
    return F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_WORDS)).cast("long")


def compared(rows: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Links among the texts of each open group (g, key, label, n, size, total), all of which meet each other."""
    one = (F.col("size") <= BLOCK) & (F.col("total") <= BLOCK_WORDS)
    zero = F.lit(0).cast("long")
    whole = rows.where(one).select("g", "key", "label", zero.alias("b"), zero.alias("low"), zero.alias("high"))
    large = rows.where(~one)
    if not large.limit(1).count():
        return _block_tasks(whole, bodies, similarity)
    # near texts are in the same class of lengths or in neighbouring ones
    large = large.select("g", "key", "label", "n", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1.01 / similarity)).cast("long").alias("c"))
    classes_ = save_table(large.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).select("g", "c", _blocks().alias("p")), "near-lengths")
    about = lambda by, name: small(classes_.select("g", (F.col("c") + by).alias("c"), F.col("p").alias(name)))
    # a hash of the key, not of the group, so that equal blocks meet alike
    large = large.join(about(0, "p"), ["g", "c"]).join(about(-1, "above"), ["g", "c"], "left").join(about(1, "below"), ["g", "c"], "left")
    large = large.withColumn("own", F.pmod(F.xxhash64("key"), F.col("p")))
    wide = 1 << 32
    number = lambda c, b: c * wide + b  # noqa: E731  of a block among all classes
    c, b = F.col("c"), F.col("own")
    upto = lambda p: F.sequence(zero, F.col(p) - 1)
    meets = F.concat(
        F.transform(upto("p"), lambda o: F.struct(number(c, F.least(b, o)).alias("low"), number(c, F.greatest(b, o)).alias("high"))),
        F.when(F.col("above").isNull(), F.array()).otherwise(F.transform(upto("above"), lambda o: F.struct(number(c, b).alias("low"), number(c + 1, o).alias("high")))),
        F.when(F.col("below").isNull(), F.array()).otherwise(F.transform(upto("below"), lambda o: F.struct(number(c - 1, o).alias("low"), number(c, b).alias("high")))),
    )
    dealt = large.select("g", "key", "label", number(c, b).alias("b"), F.explode(meets).alias("m")).select("g", "key", "label", "b", "m.low", "m.high")
    return _block_tasks(whole.union(dealt), bodies, similarity)


def taken_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large open groups: (``label``, ``key``, ``n``) of texts that must meet a whole component, and the groups without it."""
    counts = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    top = counts.groupBy("g").agg(F.max_by("label", "c").alias("top"), F.max("c").alias("c"), F.first("size").alias("size")).where(2 * F.col("c") > F.col("size"))
    split = save_table(rows.join(small(save_table(top.select("g", "top"), "near-top")), "g", "left"), "near-split").where("top IS NULL OR top <> label")
    outside = save_table(split.where("top IS NOT NULL").select(F.col("top").alias("label"), "key", "n").distinct(), "near-outside")
    left = split.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    left = save_table(left.select("g", "size", "total"), "near-left")
    return outside, save_table(split.select("g", "key", "n", "label").join(small(left), "g"), "near-inside")


def met_components(outside: DataFrame, labels: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Links between each text of ``outside`` (label, key, n) and the texts of the component ``label``, block by block."""
    wanted = save_table(outside.select("label").distinct(), "near-wanted")
    members = save_table(labels.withColumnRenamed("node", "key").join(small(wanted), "label").join(bodies.select("key", "n"), "key"), "near-component")
    about = lambda df: df.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    inside = save_table(about(members).select("label", "least", "most", _blocks().alias("p")), "near-inside-sizes")
    # by the numbers of words
    can = (F.col("n") >= F.floor(F.col("least") * F.lit(similarity))) & (F.col("n") * F.lit(similarity) <= F.col("most") + 1)
    outside = save_table(outside.join(small(inside), "label").where(can).select("label", "key", "n"), "near-able")
    sizes = save_table(inside.join(about(outside).select("label", _blocks().alias("q")), "label").select("label", "p", "q"), "near-blocks")
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    own = members.join(small(sizes), "label").select("label", "key", place("p").alias("b"), F.explode(F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).alias("o"))
    others = outside.join(small(sizes), "label").select("label", "key", (F.col("p") + place("q")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("o"))
    # in these tasks the component is one label and each other text its own
    dealt = own.select("label", "key", F.col("label").alias("l"), "b", F.col("b").alias("low"), F.col("o").alias("high")).union(others.select("label", "key", F.col("key").alias("l"), "b", F.col("o").alias("low"), F.col("b").alias("high")))
    return _block_tasks(dealt.select(F.col("label").alias("g"), "key", F.col("l").alias("label"), "b", "low", "high"), bodies, similarity)


def settled(rows: DataFrame, bodies: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """``labels`` after all pairs of different components in the open groups ``rows`` were compared."""
    large = (F.col("size") > BLOCK) | (F.col("total") > BLOCK_WORDS)
    found = compared(rows.where(~large), bodies, similarity)
    if rows.where(large).limit(1).count():
        outside, inside = taken_apart(rows.where(large))
        found = found.union(met_components(outside, labels, bodies, similarity)).union(compared(inside, bodies, similarity))
    return joined_up(labels, save_table(found, "near-links"))


def led(members: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The components after each of ``members`` (key, n, leader) met its group's leader."""
    pairs = save_table(members.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b"), "n").distinct(), "near-led")
    pairs = pairs.join(bodies.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a").where(sizes_allow(similarity, "n", "n_a")).select("a", "b")
    return components(save_table(verified(save_table(pairs, "near-pairs"), bodies, similarity), "near-links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per distinct text that is in a class with another row: key (its MD5), class_id, class_size and rep_key.

    ``class_id`` and ``rep_key`` name the document that stays: the least id, nulls last, then the least key.
    """
    rep = F.struct(F.col("id").isNull().alias("none"), "id")
    # copies become one node; the partial sums leave one row of a hot text per task
    texts = sketches(docs, doc_id, text).groupBy("md5").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("same"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("words").alias("words"))
    # numbered as they are written
    texts = save_table(texts.withColumn("key", F.monotonically_increasing_id()), "near-texts")
    members = met(texts)
    keys = save_table(members.select("key").distinct(), "near-keys")
    bodies = save_table(texts.join(small(keys), "key", "left_semi").select("key", "n", "words"), "near-bodies")
    labels = led(members, bodies, similarity)
    labels = settled(open_groups(members, labels), bodies, labels, similarity)
    named = with_labels(texts.select("key", "md5", "rep", "same"), labels)
    groups = named.groupBy("label").agg(F.min(F.struct("rep.none", "rep.id", "md5")).alias("r"), F.sum("same").alias("class_size")).where("class_size > 1")
    return save_table(named.join(groups, "label").select(F.col("md5").alias("key"), F.col("r.id").alias("class_id"), "class_size", F.col("r.md5").alias("rep_key")), "near-classes")


def _marked(docs: DataFrame, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, list[str]]:
    key, key2, rep_key, class_id, class_size, kept = names = fresh(docs, "near_key", "near_key2", "rep_key", "class_id", "class_size", "kept")
    found = classes(docs, doc_id, text, similarity).select(F.col("key").alias(key2), F.col("class_id").alias(class_id), F.col("class_size").alias(class_size), F.col("rep_key").alias(rep_key))
    joined = docs.withColumn(key, F.unhex(F.md5(f"`{text}`"))).join(small(found), F.col(key) == F.col(key2), "left")
    alone, own = F.col(rep_key).isNull(), F.col(f"`{doc_id}`").cast("long")
    stays = alone | ((F.col(key) == F.col(rep_key)) & own.eqNullSafe(F.col(class_id)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(alone, own).otherwise(F.col(class_id)).alias(class_id), F.coalesce(class_size, F.lit(1)).cast("long").alias(class_size), stays.alias(kept)), names[3:]


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``class_id`` (the least id of its class), ``class_size`` and ``kept``.

    One id of each class is kept. A row alone in its class has its own id. Null texts stand alone; texts without words are
    only grouped with equal texts; texts under K words are one run. Ids may be null (last) or repeat; rows that
    repeat the kept row in id and text are all marked ``kept``, and ``deduplicate`` drops all but one. An empty table
    gives an empty one. Columns of ``docs`` stay; if one has a new column's name, the new one gets an underscore before it.
    """
    return _marked(docs, doc_id, text, similarity)[0]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows and columns of ``docs`` that stay: one row of each class. See ``mark``."""
    marked, (class_id, _, kept) = _marked(docs, doc_id, text, similarity)
    left = marked.where(F.col(kept))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # the only rows of which one can be too many repeat another in id and text: they are counted without their texts
    (i, key, key2) = fresh(marked, "near_id", "near_key", "near_key2")
    id_and_key = [F.col(f"`{doc_id}`").cast("long").alias(i), F.md5(f"`{text}`").alias(key)]
    twice = save_table(docs.where(F.col(f"`{text}`").isNotNull()).select(*id_and_key).groupBy(i, key).count().where("count > 1").select(F.col(i), F.col(key).alias(key2)), "near-repeats")
    keyed = left.withColumn(key, F.md5(f"`{text}`"))
    same = (F.col(key) == F.col(key2)) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(i))
    once = keyed.join(small(twice), same, "left_anti").select(*cols)
    repeated = keyed.join(small(twice), same, "left_semi").dropDuplicates([class_id, key]).select(*cols)
    return once.union(repeated)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark(docs).select("doc_id", "class_id", "class_size", "kept")
