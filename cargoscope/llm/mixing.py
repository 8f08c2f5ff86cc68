"""Mixing sources to target weights.

The words of each source are laid end to end, in a fixed order of its documents, and packed into blocks of equal
length. Targets come from the source weights: each source gets its share of the wanted total, but never more than a
multiple of its own size, and what is cut off is shared among the others by weight until none is above. Output shards
hold equally many slots. Per shard, every source has the whole part of its expected slots, and the slots left over are
drawn multinomially by the fractional parts. A source's slots, numbered through over the shards, run through a
pseudorandom permutation of its blocks (the rank of a seeded hash), a new one for each pass over the source, and
blocks are joined to slots by that index.

All is DataFrame functions; hashes take the place of random numbers, so reruns agree. Running sums over a source are
made in two levels (inside hash buckets of bounded size, then over buckets), so a source with most of the words is
spread over many tasks. Joins of slots, blocks and documents are hinted to sort and merge: all of them grow with the
corpus, and a broadcast would pass one whole through the driver. Only totals, a single row, reach the driver.

Defined results: a null text has no words, is in no block and is never taken; the null source is a source, last in
order; a source without words has target 0; rows that share an id are documents of their own; an empty table gives an
empty result; extra input columns are kept by :func:`mixed` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.llm.common import WORD_REGEX, cut

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's words as a share of all words, and the most that it takes of a source or document.
TOTAL_SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Documents or blocks per bucket of the two-level sums.
BUCKET_ROWS = 20_000
#: Shards per span of the two-level sums.
SPAN_SHARDS = 4096
#: Cells of the unit interval by which draws find their source.
CELLS = 1024
SEED = 17


def _unit_interval(hashed):
    """A 64-bit hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def _numbered(df: DataFrame, parts: list[str], n: str, order: list, size, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over the rows before, per ``parts``, in two levels. ``n``: rows per part, for the
    number of buckets; a row's bucket and place follow from the hash of ``order``."""
    buckets = F.ceil(F.col(n) / BUCKET_ROWS)
    bucket = F.least(F.floor(_unit_interval(F.xxhash64(*order, F.lit(SEED))) * buckets), buckets - 1)
    df = df.withColumn("_bucket", bucket).withColumn("_size", size)
    inside = W.partitionBy(*parts, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    sums = df.groupBy(*parts, "_bucket").agg(F.sum("_size").alias("_sum"))
    before = W.partitionBy(*parts).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return placed.join(sums, [*parts, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_size", "_inside", "_before")


def _before(counts: DataFrame) -> DataFrame:
    """``base``: a source's slots in earlier shards, summed inside spans of shards and then over the spans."""
    inside = W.partitionBy("number", "span").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("number").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = counts.groupBy("number", "span").agg(F.sum("n").alias("of_span"))
    spans = spans.select("number", "span", F.coalesce(F.sum("of_span").over(earlier), F.lit(0)).alias("before"))
    own = counts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(spans, ["number", "span"]).withColumn("base", F.col("before") + F.col("own"))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, docs) -> with number, weight and target; one row per source.

    Sharing the excess by weight until no source is above its limit ends where every source has the smaller of its
    limit and its weight times one common level. Sources reach their limit in order of limit per weight, so the level
    is the first at which the sources that haven't reached it fit.
    """
    every = W.orderBy(F.asc_nulls_last("source"))
    n = sizes.withColumn("number", F.row_number().over(every) - 1)
    n = n.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    n = n.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "number")
    whole = W.orderBy("ratio", "number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("level", (F.sum("source_size").over(whole) * total_share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    n = n.withColumn("found", first)
    return n.select("source", "source_size", "docs", "number", F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("found") * F.col("weight"))).alias("target"))


class Mix:
    """The tables of a mix: ``documents`` with their place, ``sources``, and ``picks`` of blocks by slot."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_PASSES) -> None:
        """``docs``: doc_id, source, size and copy, which tells rows that share an id and size apart."""
        spark = docs.sparkSession
        docs = cut(docs.select("doc_id", "source", "size", "copy"))
        per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        sources = targets(per_source, weights, total_share, most)
        blocks = F.ceil(F.col("source_size") / block_words)
        sources = cut(sources.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)))
        self.sources = sources

        named = docs.join(sources.select(F.col("source").alias("s"), "number", F.col("docs").alias("n")), docs["source"].eqNullSafe(F.col("s"))).drop("s")
        placed = _numbered(named, ["number"], "n", ["doc_id", "size", "copy"], F.col("size"), "start")
        self.documents = placed = cut(placed.select("doc_id", "size", "copy", "number", "start"))
        full = placed.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
        # A block belongs to the document with its first word, so that every block is named once.
        owned_from, owned_to = F.ceil(F.col("start") / block_words), F.ceil(F.col("end") / block_words) - 1
        owned = full.where(owned_from <= owned_to).select("number", F.explode(F.sequence(owned_from, owned_to)).alias("block"))

        totals = sources.agg(F.sum("slots").alias("slots"), F.count("*").alias("sources")).first()
        self.picks = spark.createDataFrame([], "number int, block long, pass long, shard long, slot long")
        if not totals["slots"]:
            return
        shards = max(1, round(totals["slots"] / shard_slots))
        per_shard = max(1, round(totals["slots"] / shards))
        ordered = W.orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow)
        share = F.col("slots") / F.lit(totals["slots"]) * per_shard
        plan = sources.select("number", "blocks", share.alias("expected")).withColumn("fixed", F.floor("expected")).withColumn("part", F.col("expected") - F.col("fixed"))
        plan = cut(plan.withColumn("hi", F.sum("part").over(ordered)).withColumn("lo", F.col("hi") - F.col("part")))
        ends = plan.agg(F.sum("fixed").alias("fixed"), F.max("hi").alias("hi"), F.count_if(F.col("fixed") > 0).alias("steady")).first()
        free = max(0, per_shard - ends["fixed"])

        # Each free slot of a shard draws a source by the fractional parts.
        drawn = spark.range(shards * free).select((F.col("id") / max(1, free)).cast("long").alias("shard"), (_unit_interval(F.xxhash64("id", F.lit(SEED + 1))) * ends["hi"]).alias("u"))
        width = max(ends["hi"], 1e-300) / CELLS
        cells = plan.where("part > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))).select("cell", "number", "lo", "hi")
        drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= lo and u < hi").groupBy("shard", "number").agg(F.count("*").alias("extra"))
        # Sources with a whole slot in every shard, at most a shard's slots, and what was drawn.
        steady = plan.where("fixed > 0").select("number", "fixed").withColumn("at", F.row_number().over(W.orderBy("number")) - 1)
        grid = spark.range(shards * ends["steady"]).select((F.col("id") / max(1, ends["steady"])).cast("long").alias("shard"), (F.col("id") % max(1, ends["steady"])).cast("int").alias("at"))
        counts = grid.join(steady, "at").select("shard", "number", F.col("fixed").alias("n")).unionByName(drawn.select("shard", "number", F.col("extra").alias("n")))
        counts = counts.groupBy("shard", "number").agg(F.sum("n").alias("n")).join(plan.select("number", "blocks"), "number").where("n > 0 and blocks > 0")
        counts = _before(cut(counts.withColumn("span", F.floor(F.col("shard") / SPAN_SHARDS))))
        slots = counts.select("number", "shard", "blocks", "base", F.posexplode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("slot", "turn"))
        slots = slots.withColumn("pass", F.floor(F.col("turn") / F.col("blocks"))).where(F.col("pass") < most).withColumn("index", F.col("turn") % F.col("blocks"))

        # A pass's permutation: the rank of the blocks by a hash of block and pass.
        passes = owned.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("pass", F.col("pass").cast("long"))
        hashed = passes.join(sources.select("number", F.col("blocks").alias("n")), "number").withColumn("rank", F.xxhash64("number", "block", "pass", F.lit(SEED + 2)))
        ranked = _numbered(hashed, ["number", "pass"], "n", ["rank", "block"], F.lit(1), "index")
        # Slots, and a segment per block below, are exploded from rows that the planner takes for the size of a side.
        picks = slots.hint("merge").join(ranked.select("number", "pass", "index", "block"), ["number", "pass", "index"])
        self.picks = cut(picks.select("number", "block", "pass", "shard", F.col("slot").cast("long").alias("slot")))

    def segments(self, block_words: int = BLOCK_WORDS) -> DataFrame:
        """The part of each block in each document: number, start (of the document), block, words [lo, hi)."""
        full = self.documents.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
        spans = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
        lo, hi = F.greatest(F.col("start"), F.col("block") * block_words), F.least(F.col("end"), (F.col("block") + 1) * block_words)
        return spans.select("number", "start", "block", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi"))


def _sized(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``_row``, whatever its columns are named, with id, source, words and a hash of the text."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = docs["text"].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("_row"), docs["doc_id"].cast("long").alias("_id"), source.alias("_source"), size.alias("_size"), F.xxhash64(text).alias("_tie"))


def _keyed(sized: DataFrame) -> DataFrame:
    return sized.withColumn("_copy", F.row_number().over(W.partitionBy("_id", "_size").orderBy(F.asc_nulls_last("_source"), "_tie")))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    keyed = _keyed(_sized(docs).select("_id", "_source", "_size", "_tie"))
    made = Mix(keyed.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_copy").alias("copy")))
    times = made.picks.groupBy("number", "block").agg(F.count("*").alias("times"))
    taken = made.segments().hint("merge").join(times, ["number", "block"]).groupBy("number", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("got"))
    # A document without words shares its start with its neighbour; it has no segment and must not take the other's.
    out = made.documents.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    out = out.hint("merge").join(taken.withColumnRenamed("start", "at"), ["number", "at"], "left")
    totals = made.sources.select("number", "source_size", "target")
    return out.join(totals, "number").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and pass, its text cut to the words that the
    pass takes (unchanged where it takes all of them); ``n_chars`` follows the text."""
    sized = _sized(docs)
    keyed = _keyed(sized.select("_id", "_source", "_size", "_tie"))
    made = Mix(keyed.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_copy").alias("copy")))
    per_pass = made.segments().hint("merge").join(made.picks.select("number", "block", "pass"), ["number", "block"])
    per_pass = per_pass.groupBy("number", "start", "pass").agg(F.sum(F.col("hi") - F.col("lo")).alias("_got"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_parts"))
    places = made.documents.where("size > 0").hint("merge").join(per_pass, ["number", "start"])
    places = places.select(F.col("doc_id").alias("_pid"), F.col("size").alias("_psize"), F.col("copy").alias("_pcopy"), "_got", "_parts")
    whole = _keyed(sized)
    joined = whole.hint("merge").join(places, whole["_id"].eqNullSafe(places["_pid"]) & (whole["_size"] == places["_psize"]) & (whole["_copy"] == places["_pcopy"]))
    words = F.regexp_extract_all(F.col("_row.text").cast("string"), F.lit(f"{WORD_REGEX}[\\x20\\x09-\\x0D]*"), F.lit(0))
    joined = joined.withColumn("_words", F.when(F.col("_got") < F.col("_size"), words))
    cut_text = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice("_words", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), "")
    text = F.when(F.col("_got") < F.col("_size"), cut_text).otherwise(F.col("_row.text").cast("string"))
    joined = joined.withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return joined.select(*(made.get(c, F.col("_row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
