"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is posted under each (coordinate, value) pair of its MinHash signature. Two documents whose word
shingles have a Jaccard similarity of 0.75 agree on three quarters of the coordinates on average; a pair is a
candidate if it agrees on at least ``MATCHES`` of ``COORDINATES`` (at 0.75 a link is missed about once in ten million
times), and candidates are confirmed on the full shingle sets.

Prefix and skip: with a document's postings ordered from the rarest to the most frequent, a candidate pair must meet
in the first ``COORDINATES - MATCHES + 1`` of each, so the longest lists are skipped when candidates are made and only
count when collisions are counted. Postings that no other document shares stand first in that order and make no
candidates at all.

No list is expanded into all its pairs. Documents with equal shingle sets are one node from the start. In the star
rounds, every member of a list meets a pivot of the list, and each node is confirmed against the pivot it met most
often, which collapses large groups of near-copies into components with linear work. What is left are pairs of a list
in different components; those are all met, within size classes that the similarity allows, and pass only if their
signature sketches collide often enough and enough of their shingles are held by others, so no link between components
is lost.

Joins of signatures, postings and sets are hinted to sort and merge: the files of the written tables are compressed,
and their size must not make the planner broadcast a side that grows with the corpus. Some seventy tables are written
on the way: the files of those whose rows are bounded are counted by the rows of the input, not by the session's shuffle
partitions; tables of whole shingle sets or bitmaps keep the partitions that make them.

Defined results: texts without words (null, empty or white space) have ``n_shingles`` 0 and link with nothing; a row
without an id links with nothing, has no component and is kept; rows that share an id count as one node; the smallest
id of a component is kept, so ties need no rule; an empty table gives an empty result; extra input columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut
from cargoscope.llm.components import components

WORDS = 5
#: A link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
COORDINATES = 64
MATCHES = 28
STAR_ROUNDS = 3
#: A table of bounded rows is written in one file for so many rows of the input at most, or FEWEST_FILES if that is less.
ROWS_A_FILE = 8_000
FEWEST_FILES = 4
_SEED = 20240607

_SIGN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("signature", pa.list_(pa.int64())), *((f"s{i}", pa.int64()) for i in range(4))])
_SIGN_DDL = "doc_id long, n long, f1 long, f2 long, signature array<long>, s0 long, s1 long, s2 long, s3 long"
_SETS_SCHEMA = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes | None, cache: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words; only A-Z are lower-cased and only ASCII white space separates words."""
    words = text.lower().split() if text else []
    if len(cache) > 500_000:
        cache.clear()
    get, digest, out = cache.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: bytes | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one shingle, no words none."""
    h = word_hashes(text, cache)
    if not len(h):
        return h
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : i + n])
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(_SEED))
    both = draw.integers(0, 2**64, size=(2, COORDINATES), dtype=np.uint64)
    return both[0] | np.uint64(1), both[1]


_MULT, _ADD = _coefficients()


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest permuted hash per coordinate, coordinate and value in one 64-bit number."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        out = np.minimum(out, (_MULT[:, None] * found[None, at : at + 1024] + _ADD[:, None]).min(1))
    return _mix(out + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(signed: np.ndarray) -> np.ndarray:
    """Four bits per coordinate in four 64-bit numbers; coordinates that agree agree in these bits."""
    nibbles = (signed >> np.uint64(60)).reshape(4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(nibbles, axis=1)


def _sign(batches):
    cache: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, texts = part.column(0), part.column(1).cast(pa.large_binary())
            n, f1, f2, signs, sketches = [], [], [], [], []
            for i in range(part.num_rows):
                found = shingles(texts[i].as_py(), cache)
                n.append(len(found))
                f1.append(int(np.bitwise_xor.reduce(found).view(np.int64)) if len(found) else 0)
                f2.append(int(_mix(found).sum(dtype=np.uint64).view(np.int64)) if len(found) else 0)
                signed = signature(found) if len(found) else None
                signs.append(None if signed is None else signed.view(np.int64))
                sketches.append(np.zeros(4, np.int64) if signed is None else sketch(signed).view(np.int64))
            four = np.array(sketches).T
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(signs, pa.list_(pa.int64())), *(pa.array(four[i]) for i in range(4))], schema=_SIGN_SCHEMA)


def _sets(batches):
    cache: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(1).cast(pa.large_binary())
            made = [shingles(texts[i].as_py(), cache).view(np.int64) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], schema=_SETS_SCHEMA)


def _bitmaps(batches):
    """(node, pivot, shingles, frame) -> which of the pivot's shingles the node holds, 64 to a number."""
    for batch in batches:
        inside, n = [], []
        for i in range(batch.num_rows):
            held, frame = np.asarray(batch.column(2)[i].values), np.asarray(batch.column(3)[i].values)
            bits = np.isin(frame, held, assume_unique=True)
            padded = np.zeros(-(-len(bits) // 64) * 64, bool)
            padded[: len(bits)] = bits
            inside.append(np.packbits(padded).view(np.int64))
            n.append(int(bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inside, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["node", "pivot", "inside", "n_inside"])


def _similar_sizes(x, y):
    """Sizes whose sets can reach the similarity at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * SIMILAR


def _collisions(x: str, y: str):
    """Coordinates in which two sketches agree: at least the collisions of the signatures."""
    total = F.lit(0)
    for i in range(4):
        differ = F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + (16 - F.bit_count(differ))
    return total


def _confirmed(pairs: DataFrame, texts: DataFrame, files: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links on their full shingle sets."""
    candidates = cut(pairs.distinct(), files)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"))
    joined = candidates.join(sets.hint("merge").select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.hint("merge").select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return cut(joined.where(100 * common >= SIMILAR * (F.size("xa") + F.size("xb") - common)).select("a", "b").distinct(), files)


def _still_mixed(named: DataFrame, files: int) -> DataFrame:
    """Postings of lists that hold several components."""
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return cut(named.join(mixed, "key", "left_semi"), files)


def _undecided(postings: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """Postings of lists that still hold several components, each with its component."""
    return _still_mixed(postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), files)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_sign, _SIGN_DDL))
    files = max(FEWEST_FILES, -(-signed.count() // ROWS_A_FILE))
    usable = signed.where("n > 0 and doc_id is not null")
    classes = cut(usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node")), files)
    carried = ["node", "n", "s0", "s1", "s2", "s3"]
    nodes = usable.withColumnRenamed("doc_id", "node").join(classes, ["n", "f1", "f2", "node"], "left_semi")
    # A node has a row for each of its texts.
    nodes = cut(nodes.select(*carried, "f1", "f2", "signature").dropDuplicates(["node", "n", "f1", "f2"]).drop("f1", "f2"), files)
    # Rows that share an id are one node: the classes of such an id are linked.
    text_class = F.struct("n", "f1", "f2")
    several = cut(usable.groupBy("doc_id").agg(F.min(text_class).alias("lo"), F.max(text_class).alias("hi")).where("lo <> hi").select("doc_id"), files)
    by_id = usable.join(several, "doc_id").join(classes, ["n", "f1", "f2"]).select("doc_id", "node").distinct()
    links = cut(by_id.join(by_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), files)

    # Lists that two or more nodes share; a node's unshared postings are the rarest, so they fill its prefix first.
    posted = nodes.select("node", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.slice(F.sort_array(F.collect_list(F.struct("df", "key"))), F.lit(1), F.greatest(F.count("*") - MATCHES + 1, F.lit(0)).cast("int"))
    lists = posted.hint("merge").join(shared, "key").groupBy("node").agg(F.count("*").alias("shared"), prefix.alias("prefix")).where(F.col("shared") >= MATCHES)
    postings = cut(lists.hint("merge").join(nodes.drop("signature"), "node").select(*carried, "shared", F.explode("prefix.key").alias("key")), files)
    node_texts = texts.withColumnRenamed("doc_id", "node")

    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    left = postings.withColumn("component", F.col("node"))
    for turn in range(STAR_ROUNDS):
        if turn:
            left = _undecided(postings, labels, files)
        # First the member that shares most, then one drawn anew per list and round.
        rank = F.struct("shared", (-F.col("node")).alias("rank")) if not turn else F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("rank"))
        pivot = F.max(F.struct(rank.alias("rank"), F.col("node").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"), *(F.col(f"s{i}").alias(f"p{i}") for i in range(4))))
        pivots = left.groupBy("key").agg(pivot.alias("pivot")).select("key", "pivot.*").drop("rank")
        met = left.hint("merge").join(pivots, "key").where((F.col("component") != F.col("pc")) & _similar_sizes(F.col("n"), F.col("pn")) & (_collisions("s", "p") >= MATCHES))
        best = met.groupBy("node", "p").agg(F.count("*").alias("times")).groupBy("node").agg(F.max(F.struct("times", (-F.col("p")).alias("p"))).alias("best")).select("node", (-F.col("best.p")).alias("p"))
        found = _confirmed(best.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")), node_texts, files)
        links = cut(links.union(found), files)
        labels = components(links, files)

    # Every pair of a list in different components. First an exact bound: the shingles that no other undecided node
    # holds are in no intersection, and a node that has too many of them links with nothing more.
    left = _undecided(postings, labels, files)
    sets = cut(node_texts.join(left.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"))
    holders = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = holders.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    alone = alone.join(several.withColumnRenamed("doc_id", "node"), "node", "left_anti")  # no bound for nodes of several texts
    left = left.join(alone, "node", "left").withColumn("held", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    left = _still_mixed(cut(left.where(100 * F.col("held") >= SIMILAR * F.col("n")), files), files)
    # A second exact bound, by a pivot per list: what two members have in common lies inside the pivot's set, where
    # bitmaps tell it, or outside, where each has only so many shingles that others hold.
    pivots = left.groupBy("key").agg(F.max(F.struct("held", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("pivot"))
    left = cut(left.join(pivots, "key"), files)
    seen = left.select("node", "pivot").distinct().join(sets.hint("merge"), "node").join(sets.hint("merge").select(F.col("node").alias("pivot"), F.col("shingles").alias("frame")), "pivot")
    seen = seen.select("node", "pivot", "shingles", "frame").mapInArrow(_bitmaps, "node long, pivot long, inside array<long>, n_inside long")
    left = cut(left.hint("merge").join(seen, ["node", "pivot"]).withColumn("outside", F.col("held") - F.least("held", "n_inside")))
    # Members of a list's largest component meet only the others.
    sized = left.groupBy("key", "component").agg(F.count("*").alias("members"))
    largest = sized.groupBy("key").agg(F.max(F.struct("members", "component")).alias("top")).select("key", F.col("top.component").alias("largest"))
    step = math.log(100 / SIMILAR)
    members = left.join(largest, "key").withColumn("size_class", F.floor(F.log("n") / step))
    own = {"": "node", "n": "n", "c": "component", "h": "held", "o": "outside", "i": "inside"}
    side = lambda x: [F.col(c).alias(f"{x}{k}") for k, c in own.items()] + [F.col(f"s{i}").alias(f"{x}{i}") for i in range(4)]
    one = members.where("component <> largest").select("key", *side("x"), F.explode(F.sequence(F.col("size_class") - 1, F.col("size_class") + 1)).alias("size_class"))
    other = members.select("key", "size_class", "largest", *side("y"))
    apart = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("largest")) | (F.col("x") < F.col("y")))
    reaches = lambda common: common * (100 + SIMILAR) >= SIMILAR * (F.col("xn") + F.col("yn"))
    inside = F.aggregate(F.zip_with("xi", "yi", lambda v, w: F.bit_count(v.bitwiseAND(w))), F.lit(0), lambda v, w: v + w)
    close = reaches(F.least("xh", "yh")) & (_collisions("x", "y") >= MATCHES) & reaches(inside + F.least("xo", "yo"))
    pairs = one.hint("merge").join(other, ["key", "size_class"]).where(apart & _similar_sizes(F.col("xn"), F.col("yn")) & close)
    rest = _confirmed(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), node_texts, files)
    if not rest.isEmpty():
        labels = components(links.union(rest), files)

    by_class = classes.join(labels, "node", "left").select("n", "f1", "f2", F.coalesce("component", "node").alias("class_component"))
    out = signed.select("doc_id", "n", "f1", "f2").join(by_class, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: a row with the group's smallest id.

    Of several rows with that id the one whose text has the smallest hash stays; rows without an id keep one row a text.
    Any input column may have any name.
    """
    kept = cut(near_duplicates(docs).where("kept").select("doc_id"))
    times = kept.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    held = lambda some: docs.join(some.select(F.col("doc_id").alias(name)), docs["doc_id"].cast("long") == F.col(name), "left_semi")
    name = "kept_" + "_".join(docs.columns)
    out = held(times.where("rows = 1"))
    row, by_text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64("text"), "text")
    if not (repeated := times.where("rows > 1")).isEmpty():
        one = held(repeated).groupBy(F.col("doc_id").alias(name)).agg(F.min_by(row, by_text).alias("row")).select("row.*")
        out = out.unionByName(one)
    if not kept.where(F.col("doc_id").isNull()).isEmpty():
        one = docs.where(F.col("doc_id").isNull()).groupBy(F.sha2("text", 256).alias(name)).agg(F.min_by(row, by_text).alias("row")).select("row.*")
        out = out.unionByName(one)
    return out
