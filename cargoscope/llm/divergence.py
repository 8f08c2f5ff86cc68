"""Source divergence audit: how far the word use of each source lies from the other sources and from its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each language keeps the terms that occur in
at least ``min_docs`` of its documents; a group (language, source) gives each of these the smoothed share ``p``, in
units of 1 / 1,000,000,000, and two groups diverge by the sum of ``(p - q)^2 / (p + q)`` over the kept terms, each term
rounded down. All arithmetic is on integers.

Plan, by a cube of (group block, group block, term block) cells:

1. One pass over the documents counts terms per (language, source) inside the tasks; a full table of counts leaves the
   task, so a hot source or term costs a count a task and flush. Counts travel as lists, a row for each language and
   bucket of its terms (by hash), and are summed bucket by bucket: all of a term's counts meet in one bucket, so the kept
   terms, their totals and numbers are found there too. The number of buckets grows with that of shuffle partitions.
2. Totals and shares are group-bys and joins on (language, source).
3. Groups and terms are dealt into blocks by hash. A *slice* holds the shares of one group in one term block (it may
   hold none); it is replicated to the cells of its group block with every other group block. The number of term blocks grows with the
   kept terms of the language, the number of group blocks with its sources, so a cell's size is bounded however large
   the language is.
4. Each cell computes the partial divergences of its pairs of groups over its terms, as matrices of 64-bit integers. A
   term that none of the cell's groups holds doesn't travel: its contribution is the same number for all such terms, so
   a cell only reports how many terms it has covered. Partial sums are reduced along the term axis.

Defined results: null text, language and source are read as empty; a group without terms takes part with the share of
a count of 0, and if its language keeps no term, its pairs have value 0; repeated rows and null ids count like any
other row; ties rank by the item's UTF-8 bytes; an empty table gives an empty result; extra input columns are ignored.
Counts, shares and values fit 64 bits up to 9 * 10^15 occurrences of kept terms a group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.common import cut

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Groups and terms of a block, about.
GROUP_BLOCK = 8
TERM_BLOCK = 4096
#: Counts held by a task before they leave as rows, and bytes of a text that are cut into terms at a time.
HELD_COUNTS = 200_000
CHUNK_BYTES = 1 << 20
#: A task's texts are counted in slices of so many bytes a held count; a longer text is counted in chunks.
SLICE_BYTES = 8
#: Buckets of a language's terms in which counts are summed: so many a shuffle partition, within bounds.
BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 8, 256, 8192

#: Terms of lower-cased UTF-8: bytes.lower() maps A-Z alone, and every byte of a non-ASCII character is above 0x7F.
TERM = re.compile(rb"[a-z\x80-\xFF]+")
_OTHER = re.compile(rb"[^a-z\x80-\xFF]")
#: A-Z lower-cased, and a space for every byte that is in no term.
_TERMS_ONLY = bytes(c if c > 127 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def terms(text: bytes, chunk: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The terms of lower-cased UTF-8, a chunk of it at a time."""
    at = 0
    while at < len(text):
        to = len(text)
        if at + chunk < to and (found := _OTHER.search(text, at + chunk)):
            to = found.start()
        yield TERM.findall(text, at, to)
        at = to


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _slice_counts(groups: np.ndarray, texts: pa.Array) -> pa.Table:
    """(group, term, n, docs) of a slice of texts: its words as numbers, sorted by document and then by group."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    names, size = words.dictionary, max(1, len(words.dictionary))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    found, times = np.unique(doc * np.int64(size) + words.indices.to_numpy(), return_counts=True)
    key = groups[found // size] * np.int64(size) + found % size
    order = np.argsort(key, kind="stable")
    starts = _runs(key := key[order])
    n = np.add.reduceat(times[order], starts) if len(starts) else starts
    docs = np.diff(np.r_[starts, len(key)])
    made = pa.table([key[starts] // size, names.take(pa.array(key[starts] % size)).cast(pa.binary()), n, docs], names=["group", "term", "n", "docs"])
    return made.filter(pc.greater(pc.binary_length(made["term"]), 0))  # the space at the start of a text parts nothing


def _count(batches):
    """Rows (lang, source, text) -> counts of this task; a row without a term says that the group occurs."""
    groups: dict[tuple[str, str], int] = {}
    parts: list[pa.Table] = []

    def summed() -> pa.Table:
        sums = pa.concat_tables(parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["group", "term", "n", "docs"])

    def leave(sums: pa.Table | None):
        lone = pa.table([np.arange(len(groups)), pa.nulls(len(groups), pa.binary()), *[np.zeros(len(groups), np.int64)] * 2], names=["group", "term", "n", "docs"])
        names = [pa.array(x, pa.string()) for x in zip(*groups, strict=True)]
        for table in (lone, sums) if sums is not None else (lone,):
            for at in range(0, table.num_rows, 1 << 16):
                part = table.slice(at, 1 << 16).combine_chunks()
                group, term, n, docs = (c.chunk(0) for c in part.columns)
                key = [pa.DictionaryArray.from_arrays(group.cast(pa.int32()), x) for x in names]
                yield pa.RecordBatch.from_arrays([*key, term.cast(pa.string()), n, docs], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        texts = batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, keys = memoryview(texts.buffers()[2] or b""), list(keys)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES * HELD_COUNTS, "right")) - 1)
            group = np.array([groups.setdefault(k, len(groups)) for k in keys[at:to]], np.int64)
            text = bytes(data[ends[at] : ends[to]])
            if to == at + 1 and len(text) > CHUNK_BYTES:
                found: Counter = Counter()
                for some in terms(text.lower()):
                    found.update(some)
                one = [np.full(len(found), group[0]), pa.array(list(found), pa.binary()), np.fromiter(found.values(), np.int64, len(found)), np.ones(len(found), np.int64)]
                parts.append(pa.table(one, names=["group", "term", "n", "docs"]))
            else:
                offsets = pa.py_buffer((ends[at : to + 1] - ends[at]).astype(np.int32))
                clean = pa.Array.from_buffers(pa.string(), to - at, [None, offsets, pa.py_buffer(text.translate(_TERMS_ONLY))])
                parts.append(_slice_counts(group, clean))
            at = to
            if sum(p.num_rows for p in parts) >= 2 * HELD_COUNTS:
                parts = [summed()]
                if parts[0].num_rows >= HELD_COUNTS:
                    yield from leave(parts[0])
                    parts.clear()
                    groups.clear()
    if groups:
        yield from leave(summed() if parts else None)


_DEALT_DDL = "lang string, bucket int, sources array<string>, sizes array<int>, terms array<string>, n array<long>, docs array<long>"


def _dealt(batches: list[pa.RecordBatch], buckets: int):
    """Counts as a row per language and bucket of terms, each of its sources with its terms there.

    Rows without a term are dealt by their source, into buckets below 0.
    """
    table = pa.Table.from_batches(batches).unify_dictionaries().combine_chunks()
    lang, source, term, n, docs = (c.chunk(0) for c in table.columns)
    langs, sources = lang.dictionary, source.dictionary
    names, of_source = term.cast(pa.binary()).to_pylist(), np.array([zlib.crc32(x.encode()) for x in sources.to_pylist()], np.int64)
    bucket = np.fromiter((-1 if t is None else zlib.crc32(t) for t in names), np.int64, len(names)) % buckets
    place, lone = source.indices.to_numpy(), np.asarray(term.is_null())
    bucket[lone] = -1 - of_source[place[lone]] % buckets
    key = lang.indices.to_numpy() * np.int64(2 * buckets) + bucket + buckets
    order = np.lexsort((place, key))
    for at in range(0, len(order), 1 << 16):
        some = order[at : at + (1 << 16)]
        own, held = key[some], place[some]
        rows, runs = _runs(own), _runs(own * np.int64(len(sources)) + held)
        lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)
        by_run, by_row = np.searchsorted(runs, rows), pa.array(some)
        yield pa.RecordBatch.from_arrays([
            langs.take(pa.array(own[rows] // (2 * buckets))), pa.array(bucket[some[rows]].astype(np.int32)),
            lists(by_run, sources.take(pa.array(held[runs]))), lists(by_run, pa.array(np.diff(np.r_[runs, len(some)]).astype(np.int32))),
            lists(rows, term.take(by_row)), lists(rows, n.take(by_row)), lists(rows, docs.take(by_row))], names=["lang", "bucket", "sources", "sizes", "terms", "n", "docs"])


def _deal(buckets: int):
    """Rows (lang, source, text) -> the task's counts, dealt into buckets."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for part in _count(batches):
            held.append(part)
            if sum(p.num_rows for p in held) >= HELD_COUNTS:
                yield from _dealt(held, buckets)
                held.clear()
        if held:
            yield from _dealt(held, buckets)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


_SUM_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64()), ("lang_n", pa.int64()), ("idx", pa.int64()), ("first", pa.bool_())])
_SUM_DDL = "lang string, source string, term string, n long, docs long, lang_n long, idx long, first boolean"


def _sum(min_docs: int):
    """The counts of a language and bucket, summed by source and term, for the terms in ``min_docs`` documents."""
    def run(table: pa.Table) -> pa.Table:
        lang, bucket = table["lang"][0].as_py(), table["bucket"][0].as_py()
        flat = {c: pc.list_flatten(table[c].combine_chunks()) for c in ("sources", "sizes", "terms", "n", "docs")}
        flat = {c: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for c, x in flat.items()}
        sources = flat["sources"].dictionary_encode()
        names, size = sources.dictionary, np.int64(len(sources.dictionary))
        if bucket < 0:
            rows = len(names)
            zero, no = pa.array(np.zeros(rows, np.int64)), pa.nulls(rows, pa.int64())
            return pa.Table.from_arrays([pa.array([lang] * rows, pa.string()), names, pa.nulls(rows, pa.string()), zero, zero, no, no, pa.nulls(rows, pa.bool_())], schema=_SUM_SCHEMA)
        words = flat["terms"].dictionary_encode()
        key = words.indices.to_numpy() * size + np.repeat(sources.indices.to_numpy(), flat["sizes"].to_numpy())
        order = np.argsort(key, kind="stable")
        starts = _runs(key := key[order])
        key, n, docs = key[starts], *(np.add.reduceat(flat[c].to_numpy()[order], starts) for c in ("n", "docs"))
        term = key // size
        first = _runs(term)
        rows = np.diff(np.r_[first, len(term)])
        lang_n, keep = np.repeat(np.add.reduceat(n, first), rows), np.repeat(np.add.reduceat(docs, first) >= min_docs, rows)
        of_term = np.zeros(len(term), bool)
        of_term[first] = True
        columns = [names.take(pa.array((key % size)[keep])), words.dictionary.take(pa.array(term[keep])), *(pa.array(x[keep]) for x in (n, docs, lang_n, (np.int64(bucket) << 32) + term, of_term))]
        return pa.Table.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int32))), *columns], schema=_SUM_SCHEMA)

    return run


def term_counts(docs: DataFrame, min_docs: int = 0) -> DataFrame:
    """(lang, source, term, n, docs, lang_n, idx, first) of the terms in ``min_docs`` documents of their language at least.

    ``n`` and ``docs`` are occurrences and documents of the group, ``lang_n`` the language's occurrences; ``idx`` numbers
    a language's terms, with gaps, and ``first`` marks one row of each. A null term marks that the group occurs.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS * partitions))
    narrow = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return narrow.mapInArrow(_deal(buckets), _DEALT_DDL).groupBy("lang", "bucket").applyInArrow(_sum(min_docs), _SUM_DDL)


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly; null where the language keeps no term."""
    over, by = f"cast({SCALE} AS decimal(10,0)) * cast({count} + 2 AS decimal(20,0))", f"{total} + 2 * {kept}"
    wide = f"({over}) div cast({by} AS decimal(20,0))"
    # Counts whose product fits 64 bits need no decimals.
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + CASE WHEN {count} < {2**63 // SCALE - 2} THEN ({SCALE}L * ({count} + 2)) div ({by}) ELSE {wide} END END")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


_PART_SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("covered", pa.int64()), ("a0", pa.int64()), ("b0", pa.int64()), ("kept", pa.int64())])
_PART_DDL = "lang string, a string, b string, value long, covered long, a0 long, b0 long, kept long"


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of a cell: groups of its low block against those of its high block, or among
    themselves, over the terms that any of them holds."""
    rows = table.to_pylist()
    low, high = rows[0]["low"], rows[0]["high"]
    held = np.unique(np.concatenate([np.array(r["idx"], np.int64) for r in rows]))
    shares = np.empty((len(rows), len(held)), np.int64)
    for i, r in enumerate(rows):
        shares[i] = r["p0"]
        shares[i, np.searchsorted(held, np.array(r["idx"], np.int64))] = np.array(r["p"], np.int64)
    columns: list[list] = [[] for _ in _PART_SCHEMA]
    for i, a in enumerate(rows):
        if a["block"] != low:
            continue
        # Within one block a pair is the one of the smaller source; between blocks it is the one of the low block.
        others = [j for j, b in enumerate(rows) if (b["block"] == high if low != high else a["source"] < b["source"])]
        if others:
            apart, joint = shares[others] - shares[i], shares[others] + shares[i]
            sums = (apart * apart // joint).sum(axis=1)
            for j, value in zip(others, sums.tolist(), strict=True):
                made = (a["lang"], a["source"], rows[j]["source"], value, len(held), a["p0"], rows[j]["p0"], a["kept"])
                for column, x in zip(columns, made, strict=True):
                    column.append(x)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART_SCHEMA, strict=True)], schema=_PART_SCHEMA)


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every unordered pair of groups of a language.

    ``groups``: lang, source, kept, p0, group_blocks, term_blocks; ``shares``: lang, source, term_block, idx, p.
    """
    slices = shares.groupBy("lang", "source", "term_block").agg(F.collect_list(F.struct("idx", "p")).alias("held"))
    slices = slices.select("lang", "source", "term_block", F.col("held.idx").alias("idx"), F.col("held.p").alias("p"))
    # Every group has a slice in every term block, though it may hold none of its terms: its pairs need the others' terms.
    info = groups.select("lang", "source", "kept", F.coalesce("p0", F.lit(1)).alias("p0"), "group_blocks", "term_blocks", F.expr("int(pmod(xxhash64(source), group_blocks))").alias("block"))
    every = info.select("lang", "source", "kept", "p0", "group_blocks", "block", F.explode(F.expr("sequence(0, int(term_blocks) - 1)")).alias("term_block"))
    full = every.join(slices, ["lang", "source", "term_block"], "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    placed = full.select("lang", "source", "term_block", "block", "p0", "kept", empty("idx", "array<bigint>"), empty("p", "array<bigint>"), F.explode(F.expr("sequence(0, int(group_blocks) - 1)")).alias("other"))
    cells = placed.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term_block", "source", "block", "p0", "kept", "idx", "p")
    parts = cells.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, _PART_DDL)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"), F.max("a0").alias("a0"), F.max("b0").alias("b0"), F.max("kept").alias("kept"))
    return sums.select("lang", "a", "b", (F.col("value") + (F.col("kept") - F.col("covered")) * distance("a0", "b0")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language with its divergence from the group. Part ``term``: the ``top``
    terms that the group uses more than its language does. Ranks go by value, the largest first, then by item.
    """
    counts = cut(term_counts(docs, min_docs))
    held = counts.where(F.col("term").isNotNull())
    sizes = held.where("first").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    blocks = sizes.select("lang", "kept", "lang_total", F.ceil(F.col("kept") / term_block).alias("term_blocks"))

    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.where(F.col("term").isNull()).select("lang", "source")
    sources = every.groupBy("lang").agg(F.ceil(F.count("*") / group_block).alias("group_blocks"))
    groups = every.join(totals, ["lang", "source"], "left").join(blocks, "lang", "left").join(sources, "lang")
    groups = groups.select("lang", "source", "group_blocks", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total", F.coalesce("term_blocks", F.lit(1)).alias("term_blocks"))
    groups = cut(groups.withColumn("p0", share("0", "total", "kept")))

    shares = held.join(groups.select("lang", "source", "total", "kept", "lang_total", "term_blocks"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", F.expr("int(pmod(xxhash64(term), term_blocks))").alias("term_block"), "idx", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"))

    pairs = pair_values(groups, shares)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
