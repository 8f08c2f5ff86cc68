"""The pipeline's stages against plain Python, each on its own input; ids, texts and figures are computed anew here."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cargoscope.llm import fertility, langid, mixing

SF001 = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Given texts with copies, near copies, noise, nulls, empties, and columns whose names the stages use themselves."""
    rng = random.Random(3)
    given = [r.asDict() for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()]
    rows = list(given)
    whole = [r for r in given if r["text"] and 40 < len(r["text"].split()) < 400][:20]
    for k, r in enumerate(whole):
        words = r["text"].split()
        words[rng.randrange(len(words))] = "replaced"
        rows += [r | {"doc_id": 10_000 + k}, r | {"doc_id": 20_000 + k, "text": " ".join(words)}]
    noise = "".join(rng.choice("qxzjkvwpbdg") + rng.choice(["", " "]) for _ in range(900))
    odd = [None, "", " \n", "a b c", noise, "same words here again now " * 30, "0 1 2 3 4 5 6 7 8 9 10 11 12"]
    rows += [given[0] | {"doc_id": 30_000 + k, "text": t, "lang": None, "source": None} for k, t in enumerate(odd)]
    schema = spark.read.parquet(f"{SF001}/documents.parquet").schema
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    clashing = ("_id", "_size", "_row", "_text", "kept_id", "component_id", "kept", "number", "node")
    docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in clashing]).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Input and output rows of each stage, written and read again between stages as in ``run``."""
    folder, found = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, corpus).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        assert n == 4 or docs.columns == before.columns, name
        found[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    return found


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def repeated(words):
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)})


def quality(text, pieces):
    """base_failed, kept and the four figures of a text, word by word."""
    words = WORDS.findall(text or "")
    failed = len(words) < 10 or 100 * repeated(words) > 20 * len(words)
    tokens = Counter(t for w in words for t in pieces.encode(w))
    n = sum(tokens.values())
    if not n:
        return failed, False, (0, 0.0, 0.0, 0.0)
    fallback = sum(c for t, c in tokens.items() if pieces.is_byte(t) or pieces.is_unknown(t))
    entropy = -sum(c / n * math.log2(c / n) for c in tokens.values())
    figures = (n, sum(map(len, words)) / n, fallback / n, entropy)
    script = fertility.script_of(text)
    low, high, most = fertility.BANDS[script]
    good = low <= figures[1] <= high and figures[2] <= most and entropy >= fertility.entropy_floor(n, script)
    return failed, good and not failed, figures


def test_quality_stage(spark, stages):
    before, after = stages["quality rules"]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(fertility.TOKENIZER))
    wanted = {r["doc_id"]: quality(r["text"], pieces) for r in before}
    assert ids(after) == sorted(i for i, (_, kept, _) in wanted.items() if kept)
    assert 0 < sum(failed for failed, *_ in wanted.values()) < len(wanted)
    assert any(not kept and not failed for failed, kept, _ in wanted.values())        # the method decides some, too
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    for r in fertility.quality(table).collect():
        text, (failed, kept, figures) = by_id(before)[r.doc_id]["text"] or "", wanted[r.doc_id]
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.base_failed, r.kept, r.n_tokens) == (failed, kept, figures[0])
        assert (r.n_words, r.n_repeat_words) == (len(WORDS.findall(text)), repeated(WORDS.findall(text)))
        assert (r.word_chars, r.n_symbols) == (sum(map(len, WORDS.findall(text))), sum(text.count(c) for c in "#*$%&|<>"))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert np.allclose([r.chars_per_token, r.fallback_share, r.token_entropy], figures[1:])


def counted(text):
    """The hashed n-grams of a text, one by one."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    data = (" " + " ".join(kept.split()) + " ").encode("utf-8", "replace")
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            counts[((int.from_bytes(data[i : i + n], "big") + (n << 24)) % 2**32 * 2654435761 % 2**32) >> 19] += 1
    return counts


def test_language_stage(spark, stages):
    """Training rows are those of the fold with the smallest hashes; each prediction is the nearest centroid by hand."""
    before, after = stages["language ID"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    fold = [r for r in before if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    texts = [counted(r["text"]) for r in fold if any(c.isalpha() for c in r["text"])]
    seen = Counter(k for t in texts for k in t)
    idf = [math.log((1 + len(texts)) / (1 + seen[k])) + 1 for k in range(langid.BUCKETS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert model.langs == sorted({r["lang"] for r in fold if r["lang"]})
    kept = []
    for r in before:
        if not any(c.isalpha() for c in r["text"]):
            assert model.predict(r["text"]) == ("und", 0.0, True)
            continue
        weights = {k: math.log1p(c) * idf[k] for k, c in counted(r["text"]).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w / norm * centre[k] for k, w in weights.items()) for centre in model.centres.tolist()]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        lang, score, rejected = model.predict(r["text"])
        assert lang == model.langs[model.owner[best]] and abs(score - cosines[best]) < 1e-4
        assert rejected == (cosines[best] < model.floor[model.owner[best]])
        if not rejected:
            kept.append(r["doc_id"])
    assert ids(after) == sorted(kept) and len(kept) > 0.9 * len(before)


def test_training_rows_of_a_hot_language(spark, monkeypatch):
    """Ranking in parts finds the rows that one rank over the whole language would."""
    monkeypatch.setattr(langid, "RANKED_BY", (8, 2, 1))
    texts = ["gato perro casa", "dog house tree", "un deux trois"]
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")), F.lit(" "), F.expr("repeat('x', id % 7)")).alias("text"), F.lit("hot").alias("lang"))
    parted = langid.fit(docs, rows=40)
    monkeypatch.setattr(langid, "RANKED_BY", (1,))
    whole = langid.fit(docs, rows=40)
    assert parted.floor == whole.floor and (parted.centres == whole.centres).all() and parted.langs == ["hot"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 0)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_dedup_stage(stages):
    before, after = stages["MinHash near-dedup"]
    sets = {}
    for r in before:
        words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert ids(after) == sorted(i for i in sets if find(i) == i) and len(after) < len(before)
    assert all(r == by_id(before)[r["doc_id"]] for r in after)


def shares(sizes):
    """Targets by sharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, target, free = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    wanted = 1.5 * sum(sizes.values())
    while True:
        left = wanted - sum(target.values())
        level = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if level[s] > 2 * sizes[s]}
        if not over:
            return target | level
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
        if not free:
            return target


def test_mixing_stage(spark, stages):
    before, after = stages["mixing sources to target weights"]
    source = by_id(before)
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
    taken, passes = Counter(), Counter()
    for r in after:
        whole, part = WORDS.findall(source[r["doc_id"]]["text"]), WORDS.findall(r["text"])
        taken[r["doc_id"]] += len(part)
        passes[r["doc_id"]] += 1
        left = iter(whole)
        assert part and all(w in left for w in part)                                   # the document's words, in order
        assert r["n_chars"] == len(r["text"]) and (len(part) < len(whole) or r["text"] == source[r["doc_id"]]["text"])
        same = set(r) - {"text", "n_chars"}
        assert {c: r[c] for c in same} == {c: source[r["doc_id"]][c] for c in same}
    assert max(passes.values()) <= 2
    figures = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in before], "doc_id long, text string, source string")).collect()}
    assert {i: r.taken for i, r in figures.items()} == {r["doc_id"]: taken[r["doc_id"]] for r in before}
    wanted, got = shares(dict(sizes)), Counter()
    for r in before:
        got[r["source"]] += taken[r["doc_id"]]
        assert abs(figures[r["doc_id"]].target - wanted[r["source"]]) < 1e-6 * max(1, wanted[r["source"]])
        assert taken[r["doc_id"]] <= 2 * len(WORDS.findall(r["text"]))
    for s in sizes:
        assert abs(got[s] - wanted[s]) <= 0.02 * wanted[s] + 4 * mixing.BLOCK_WORDS, s


def test_shards_are_summed_in_two_levels(spark, monkeypatch):
    """Many shards over several spans: each source's slots are numbered through, and the mix is that of one span."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 20 + id % 50)").alias("text"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    sized = mixing._keyed(mixing._sized(docs).select("_id", "_source", "_size", "_tie")).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_copy").alias("copy"))
    one = sorted(mixing.Mix(sized, shard_slots=16).picks.collect())
    monkeypatch.setattr(mixing, "SPAN_SHARDS", 7)
    assert sorted(mixing.Mix(sized, shard_slots=16).picks.collect()) == one
    assert len({r.shard for r in one}) > 40
    turns = defaultdict(list)
    for r in one:
        turns[r.number].append((r["pass"], r.block))
    assert all(len(set(t)) == len(t) for t in turns.values())                          # no block twice in a pass


def test_bpe_stage_and_run(spark, corpus, stages):
    before, after = stages["BPE encoding and decoding"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    wanted = []
    for r in before:
        found = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(found, skip_special_tokens=False)
        wanted.append((r["doc_id"], len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    figures = lambda rows: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    assert figures(after) == sorted(wanted)
    assert figures(r.asDict() for r in corpus_pipeline.run(spark, corpus).collect()) == sorted(wanted)
