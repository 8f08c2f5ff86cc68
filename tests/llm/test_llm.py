"""The training-data operators against brute force, on small adversarial tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargoscope.llm import bpe, chat, components, fertility, html, langid, licenses, minhash, mixing, queries, vectors, warc

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, component string"


def words(text):
    return (text or "").encode().lower().split()


def documents(spark):
    """Copies, near copies, nulls, empties, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(30, 80))] for _ in range(12)]
    texts = [None, "", " \n\t", "one two", "One TWO", "a b c d e", "A b c d E", "é \u00a0x"]
    for b in base:
        texts += [" ".join(b), " ".join(b).upper()]
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(1, 5)):
                c[rng.randrange(len(c))] = word()
            texts.append("\n".join(c))
    texts.append(" ".join(word() for _ in range(30_000)))
    rows = [(i, t, "xx" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or ""), 1, "c") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "a b c d e f", None, None, 1, 1, "c")]
    return spark.createDataFrame(rows, DOCS), rows


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 3)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for l in links if None not in l and l[0] != l[1] for x in l}
    assert got == reach(nodes, [l for l in links if None not in l])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_brute_force(spark):
    docs, rows = documents(spark)
    got = minhash.near_duplicates(docs).collect()
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = reach(ids, links)
    assert len(got) == len(rows) and len(links) > 30
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (comp[r.doc_id], comp[r.doc_id] == r.doc_id))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_writes_files_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    """Many shuffle partitions would leave every table of a round in as many scraps; its rows and the result stay."""
    docs, _ = documents(spark)
    want = sorted(map(str, minhash.near_duplicates(docs).collect()))
    files, whole = [], ("text", "shingles", "inside", "signature")
    for module in (minhash, components):
        def counted(df, *most, own=module.cut):
            out = own(df, *most)
            if not set(out.columns) & set(whole):
                files.append(len(out.inputFiles()))
            return out
        monkeypatch.setattr(module, "cut", counted)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(map(str, minhash.near_duplicates(docs).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 20 and max(files) <= 4


def test_rows_that_share_an_id(spark):
    """Differing texts under one id are one node with the links of all of them; one row of a group stays."""
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda w: " ".join([*w[:-1], "changed"])
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (20, " ".join(c)), (21, " ".join(d)), (30, near(c)), (30, near(d)), (40, "alone here"), (40, "alone here")]
    rows += [(None, " ".join(a)), (None, " ".join(a)), (None, None), (50, None), (50, ""), (60, " ".join(text()))]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, kept_id string, _id int, n int, node int")
    got = minhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (20, 20), (21, 20), (30, 20), (40, 40), (None, None), (50, 50), (60, 60)}
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and all(r.kept_id == "x" and r.node == 3 for r in kept.collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "20", "40", "50", "60", "None", "None"])


def test_sketches_never_undercount_collisions():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = minhash.signature(np.unique(np.concatenate([common, rng.integers(0, 2**63, 9).astype(np.uint64)])))
    b = minhash.signature(np.unique(np.concatenate([common, rng.integers(0, 2**63, 9).astype(np.uint64)])))
    nibbles = lambda s: [(int(x) >> 4 * i) & 15 for x in minhash.sketch(s) for i in range(16)]
    assert sum(x == y for x, y in zip(nibbles(a), nibbles(b))) >= int((a == b).sum()) >= minhash.MATCHES


def test_vectors_are_replicated_only_where_the_triangle_inequality_asks():
    rng = np.random.default_rng(5)
    unit = vectors._unit((np.eye(8)[np.arange(400) % 8] + rng.normal(scale=0.02, size=(400, 8))).ravel(), 8)
    pivots = vectors.choose_pivots(unit, 8)
    angles = vectors._angles(unit, pivots)
    radii = {(8, c): angles[angles.argmin(1) == c, c].max() for c in range(8)}
    batch = vectors.pa.RecordBatch.from_arrays([vectors.pa.array(np.arange(400)), vectors.pa.array(unit.tolist())], names=["rep", "vector"])
    shared = type("Shared", (), {"value": {8: pivots}})
    reach = float(np.arccos(0.9))
    made = [b.to_pydict() for b in vectors._spread(shared, radii, reach)([batch])]
    cells = {(r, c) for d in made for r, c in zip(d["rep"], d["cell"])}
    assert len(cells) == 400  # separate groups: nothing is replicated
    near = np.argwhere(np.arccos(np.clip(unit @ unit.T, -1, 1)) <= reach)
    assert all((b, int(angles[a].argmin())) in cells for a, b in near)  # each partner is in the vector's own cell


def dealt_vectors(monkeypatch, raw, k):
    """Vectors, their ids and weights as ``_deal`` packs them for tiles of at most 64, with what ``_join`` asks for beside them."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "DEAL_ROWS", 100)
    shared = lambda value: type("Shared", (), {"value": value})
    dim = raw.shape[1]
    unit = vectors._unit(raw.ravel(), dim)
    pivots = vectors.in_chain(vectors.choose_pivots(unit, k))
    angles = vectors._angles(unit, pivots)
    home = angles.argmin(1)
    radii = {(dim, c): angles[home == c, c].max() for c in range(k)}
    places, total, tiles = vectors.lay_out({(dim, c): int((home == c).sum()) for c in range(k)})
    batch = vectors.pa.RecordBatch.from_arrays([vectors.pa.array(np.arange(len(raw)) * 7), vectors.pa.array(raw.tolist()), vectors.pa.array(np.arange(len(raw)) % 3 + 1)], names=["rep", "vector", "weight"])
    reach = float(np.arccos(0.9))
    made = vectors.pa.Table.from_batches(vectors._deal(shared({dim: pivots}), radii, reach, places, total)([batch])).sort_by("tile")
    return unit, made, total, (shared({dim: pivots}), shared({dim: vectors.shortening(unit, 0.9)}), radii, reach, 0.9, np.float64, total)


def test_each_pair_of_vectors_meets_in_one_tile(monkeypatch):
    raw = np.random.default_rng(2).normal(size=(600, 12))  # no structure: the range reaches into every cell
    unit, made, total, _ = dealt_vectors(monkeypatch, raw, 30)
    met, copies = np.zeros((600, 600), int), 0
    for tile in made["tile"].unique().to_pylist():
        sides = {}
        for row in made.filter(vectors.pa.compute.equal(made["tile"], tile)).to_pylist():
            sides.setdefault(row["block"], []).extend(np.frombuffer(row["rep"], np.int64) // 7)
        copies += sum(map(len, sides.values()))
        if tile // total == tile % total or len(sides) == 2:
            x, y = list(sides.values())[0], list(sides.values())[-1]
            met[np.ix_(x, y)] += 1
            if tile // total != tile % total:
                met[np.ix_(y, x)] += 1
    near = np.arccos(np.clip(unit @ unit.T, -1, 1)) <= np.arccos(0.9)
    assert met.max() == 1 and (met[near] == 1).all()
    assert copies <= 600 * total and total < 15  # one copy a block; the 30 cells cost no copy each


@pytest.mark.parametrize("dense", [0.0, 1 / 32, 2.0])
def test_tiles_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(vectors, "DENSE", dense)
    monkeypatch.setattr(vectors, "STRIP_ROWS", 16)
    monkeypatch.setattr(vectors, "STRIP_COLUMNS", 24)
    monkeypatch.setattr(vectors, "HELD_LINKS", 50)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=12)
    at_edge = [[9.0] + [0.0] * 11, [9.0, 0.0, np.sqrt(19.0)] + [0.0] * 9, [9.0, np.sqrt(19.0)] + [0.0] * 10]  # cosines of 0.9, or just beside
    raw = np.concatenate([rng.normal(size=(200, 12)), centre + rng.normal(scale=0.1, size=(180, 12)), at_edge, [centre * 1e150, centre * 1e-150]])
    unit, made, _, rest = dealt_vectors(monkeypatch, raw, 7)
    got = vectors.pa.Table.from_batches(vectors._join(*rest)(made.to_batches(max_chunksize=5))).to_pandas()
    link = vectors.linked(unit, unit, raw, raw, 0.9) & ~np.eye(len(raw), dtype=bool)
    want = link @ (np.arange(len(raw)) % 3 + 1)
    counts = got[got.links > 0].groupby("a").links.sum()
    assert {a // 7: n for a, n in counts.items()} == {i: n for i, n in enumerate(want) if n}
    edges = got[got.links == 0]
    assert all(link_of[0] > link_of[1] for link_of in edges[["a", "b"]].to_numpy())
    comp = reach(list(range(len(raw))), [(int(a) // 7, int(b) // 7) for a, b in edges[["a", "b"]].to_numpy()])
    assert comp == reach(list(range(len(raw))), [(int(a), int(b)) for a, b in np.argwhere(link)]) and link.sum() > 30_000


@pytest.mark.parametrize("least", [1, 6])
def test_vectors_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "LEAST_CELLS", least)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    many = [(centres[i % 12] + rng.normal(scale=0.25, size=16)).tolist() for i in range(400)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 0.0], [2.0, 0.0], [1e200] * 16, [1e-200] * 16]
    rows = [(i, v, 1) for i, v in enumerate(many + odd + [many[3]] * 5)] + [(None, many[3], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()
    fine = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = reach([i for i, *_ in rows if i is not None], links)
    degree = {i: 0 for i in comp}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(got) == len(rows) and len(links) > 500
    for r in got:
        want = (0, None, True) if r.vec_id is None else (degree[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == want, r


def test_chat_round_trip_and_folding(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard, 1), (-7, 1, "assistant", hard, 1), (1, None, None, None, 1), (1, 0, "a:\n:", "\\", 1), (1, 0, "a:\n:", "\\", 1), (2, 0, "assistant", "é" * 2000 + "\n", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    for conv in (-7, 1, 2):
        own = [(r or "", t or "") for c, _, r, t, _ in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "he"), (1, 5, "delta", 1, None, "o"),
        (1, 4, "delta", 1, None, "ll"), (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "new"), (1, 8, "message", 2, "user", "gone"),
        (1, 9, "edit", 0, None, "hey"), (1, 10, "message", 1, "assistant", "yo"), (2, 1, "delta", 0, None, "x"), (3, 1, "message", 0, "user", None),
    ]
    made = chat.fold(spark.createDataFrame(log, chat.EVENTS)).orderBy("conv_id", "message").collect()
    assert [(r.conv_id, r.message, r.role, r.text) for r in made] == [(1, 0, "user", "hey"), (1, 1, "assistant", "yo"), (2, 0, "", "x"), (3, 0, "user", "")]
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def _folded_by_hand(log):
    """The final messages, event after event."""
    state = {}
    for conv, _, kind, m, role, text in sorted(log, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        own = state.setdefault(conv, {})
        now = own.setdefault(m, {"role": "", "parts": [], "dropped": False})
        now["role"] = role if role is not None else now["role"]
        if kind == "delta":
            now["parts"].append(text or "")
        else:
            now.update(parts=["" if kind == "regenerate" else text or ""], dropped=False)
        if kind in ("edit", "regenerate"):
            for later in own:
                if later > m:
                    own[later]["dropped"] = True
    return sorted((str(c), m, v["role"], "".join(v["parts"])) for c, own in state.items() for m, v in own.items() if not v["dropped"])


@pytest.mark.parametrize("most", [100_000, 1])
def test_chat_fold_against_event_after_event(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "BROADCAST_IDS", most)
    draw = random.Random(7)
    log = []
    for conv in (None, *range(40)):
        opened = []
        for seq in range(draw.randint(1, 25)):
            kind = draw.choices(["message", "delta", "edit", "regenerate"], [4, 6, 1, 1] if conv is None or conv % 3 else [1, 1, 0, 0])[0]
            m = draw.choice(opened) if opened and kind != "message" else draw.randint(0, 5)
            if m not in opened:
                kind = "message"
                opened.append(m)
            text = draw.choice([None, "", "a", "b ", "é"])
            log.append((conv, seq, kind, m, draw.choice(["user", "assistant"]) if kind == "message" else None, None if kind == "regenerate" else text))
    got = chat.fold(spark.createDataFrame(log, chat.EVENTS).repartition(5)).collect()
    assert sorted((str(r.conv_id), r.message, r.role, r.text) for r in got) == _folded_by_hand(log)


def test_chat_dropped_messages_and_null_conversations(spark):
    log = [
        # Message 1 is dropped by the edit of 0; a delta doesn't bring it back, an edit does.
        (1, 1, "message", 0, "user", "q"), (1, 2, "message", 1, "assistant", "old"), (1, 3, "edit", 0, None, "q2"), (1, 4, "delta", 1, None, "x"),
        (2, 1, "message", 0, "user", "q"), (2, 2, "message", 1, "assistant", "old"), (2, 3, "edit", 0, None, "q2"), (2, 4, "edit", 1, None, "new"),
        (None, 1, "message", 0, "user", "q"), (None, 2, "message", 1, "assistant", "old"), (None, 3, "regenerate", 0, None, None),
    ]
    made = chat.fold(spark.createDataFrame(log, chat.EVENTS)).collect()
    assert sorted((str(r.conv_id), r.message, r.role, r.text) for r in made) == [
        ("1", 0, "user", "q2"), ("2", 0, "user", "q2"), ("2", 1, "assistant", "new"), ("None", 0, "user", "")]


def test_warc_round_trip(spark, monkeypatch):
    big = "é" * 5000
    rows = [(1, "u", big), (2, "u\nx", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (0, "u", "x" * 99), (7, "u", "x" * 99)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i == 2 else ("response", None))
    assert warc.archive(pages.limit(0)).count() == 0
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 700)
    payload = big.encode()
    row = {"page_id": 9, "url": "u", "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "refers_to": None}
    raw = b"".join(warc.members(row)) * 2
    for step in (1, 37, len(raw)):
        found = list(warc.summarise(raw[i : i + step] for i in range(0, len(raw), step)))
        assert [(r["page_id"], r["payload_bytes"]) for r in found] == [(9, len(payload))] * 2
    with pytest.raises((warc.DamagedArchive, zlib.error)):
        list(warc.summarise([raw[:-9]]))
    with pytest.raises(warc.DamagedArchive):
        list(warc.summarise(warc.members(row | {"digest": "00" * 32})))


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    # A page of two segments after 1,999 others, where a bound of 2,000 records would cut it in two.
    rng = random.Random(4)
    big = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9 << 20))
    rows = [(i, "u", f"page {i} " * 20) for i in range(1999)] + [(5000, "u", big), (5001, "u", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for bound in (warc.ARCHIVE_BYTES, 100_000):
        path = str(tmp_path / str(bound))
        warc.write(pages, path, bound)
        sizes = [f.stat().st_size for f in (tmp_path / str(bound)).rglob("part-*")]
        assert sum(s > bound for s in sizes) <= 1 and (bound > 1 << 20 or len(sizes) > 4)
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect())
        assert got == [(i, len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows]


def repeat_words(w):
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {i for i, x in enumerate(windows) if windows.count(x) > 1}
    return len({k for i in twice for k in range(i, i + 5)})


def test_quality_figures(spark):
    docs, rows = documents(spark)
    got = fertility.quality(docs).collect()
    assert len(got) == len(rows)
    by_text = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        if t and len(t) > 100_000:
            continue
        w = (t or "").encode().split()
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        r = by_text[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), len("".join(x.decode() for x in w)), len(lines) - len(set(lines)), repeat_words(w))
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w)) and (not r.kept or not r.base_failed)
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 30))]
        assert fertility.repeat_words(w) == repeat_words(w)
    assert fertility.accepted(docs).count() == sum(r.kept for r in got)
    assert fertility.accepted(docs).columns == docs.columns and fertility.quality(docs.limit(0)).count() == 0


def test_fertility_rejects_noise_and_keeps_prose():
    import public_tokenizers

    f = fertility.Fertility(public_tokenizers.path(fertility.TOKENIZER))
    prose = open(fertility.__file__, encoding="utf-8").read().split('"""')[1].encode().split()
    noise = [bytes([b]) * 6 for b in b"#*%&"] * 60
    verdict = lambda w: fertility.judge("latin", *f.figures(w, sum(map(len, w))))
    assert verdict(prose) and not verdict(noise)


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe.TOKENIZER)
    library, own = Tokenizer.from_file(path), bpe.Transducer(path, cache_runs=40, chunk_chars=5)
    rng = random.Random(1)
    parts = ["a", "th", "in", "  ", "\n", "'s", "'", "é", "中", "<|endoftext|>", "1", "#", " ", "😀", "\x1c", "\u3000", "'ll", "ation", "\x85"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = np.frombuffer(b"".join(own.encode(text)), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert "".join(own.decode(iter([ids.tobytes()]))) == text
    for text in ("a" * 20_000, "".join(rng.choice(["th", "in", "ation", "er"]) for _ in range(5000)), " " * 9000, "中" * 4000):
        for window in (1, 300, 4096):
            streamed = [i for part in bpe.stream_run(text.encode(), own.vocabulary, window) for i in part]
            assert streamed == bpe.merge_window(text.encode(), own.vocabulary)
        assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for ids in ([200, 50], [162, 255, 100], [50256]):
        assert "".join(own.decode(iter([np.array(ids, "<u4").tobytes()]))) == library.decode(ids, skip_special_tokens=False)
    docs, rows = documents(spark)
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in bpe.digests(docs).collect()) == sorted((i or -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert {r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {t or "" for _, t, *_ in rows}


def test_mixing_targets_and_text(spark):
    docs, rows = documents(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] for r in out)
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:  # share by weight, fix those above their limit, share the rest again
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in above}
        left -= sum(2 * size[s] for s in above)
        open_ -= above
    want = sorted(round(goal[s], 6) for _, _, _, s, *_ in rows)
    assert sorted(round(r.target, 6) for r in out) == want
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in total.items() if v} == taken
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mix_of_given_documents_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_source = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.k / r.t - 1) < 0.03 for r in by_source)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and sum(r.rejected for r in held) <= 0.02 * len(held)
    extra, rows = documents(spark)
    got = langid.identify(extra).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"xx", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert {r.lang_pred for r in langid.identify(extra.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(extra.limit(0)).count() == 0 and langid.accepted(extra).columns == extra.columns


def test_language_id_learns_every_language(spark):
    # 230 languages of two letters each; one id repeats thousands of times.
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice([chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)]) for _ in range(4))
    rows = [(1000 * k + i, " ".join(word(k) for _ in range(30)), f"l{k:03}") for k in range(230) for i in range(5)]
    rows += [next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2)] * 3000
    trained = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.langs) == trained and len(trained) > 220
    assert all(model.predict(t)[0] == lang for _, t, lang in rows[:1150] if lang in trained)
    again = langid.fit(docs.repartition(5))
    assert (again.centres == model.centres).all() and again.floor == model.floor


def test_language_id_reads_whole_training_texts(spark):
    opening = "the menu of this page " * 1000
    bodies = {"aa": "wozu hurdel mankt ", "bb": "quiso llevar peñas "}
    rows = [(i, opening + bodies[lang] * 3000, lang) for i in range(40) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert all(model.predict(b * 50)[0] == lang for lang, b in bodies.items()) and len(opening) > 20_000
    # Document frequencies are those of the whole fold, whatever number of rows the centroids take.
    assert (langid.fit(docs, rows=1).idf == model.idf).all()


def test_license_places_and_templates(spark):
    import re

    fill = "lorem ipsum dolor " * 200
    texts = [None, "", "MIT License", "x the mit-license; mit license", "GNU General PUBLIC license apache LICENSE", "license mit", "general general public license é",
             f"{fill}\nLicensed under CC BY-NC 4.0.\nend", fill + "Licensed under CC BY-NC 4.0 " + fill, "under cc by nothing", "mitlicense"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts + texts[-4:])], "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        t = (texts + texts[-4:])[r.doc_id] or ""
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t))
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert ("cc-by-nc" in r.labels) == ("CC BY-NC" in t) and 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_templates_wrapped_over_lines(spark):
    import textwrap

    fill = textwrap.fill("lorem ipsum dolor sit amet " * 80, 72)
    texts = [f"{fill}\n{textwrap.fill('x ' * 28 + t, 72)}\n{fill}" for _, t in licenses.TEMPLATES]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.replace("\n", "\r\n * ")) for i, t in enumerate(texts)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].split(",") and label in got[100 + i].split(","), licenses.TEMPLATES[i]


def test_license_copies_nulls_and_clashing_columns(spark):
    hot = "x " * 300 + licenses.TEMPLATES[2][1] + " y" * 300
    rows = [(i % 50 or None, hot, 1, "a", "b", "c") for i in range(200)] + [(1000, "plain words alone", 2, None, None, None), (1001, None, 3, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, text_key string, w string, method_labels string").repartition(7)
    got = licenses.scan(docs).collect()
    assert len(got) == 202 and all(r.labels == ("mit" if r.n_words > 3 else "") for r in got)
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(r[0]), len((r[1] or "").split()) if r[0] in (1000, 1001) else 600 + len(licenses.TEMPLATES[2][1].replace(",", " ").split())) for r in rows)


def test_license_labels_are_exact(spark):
    far = "released " + "a " * 30 + "under " + "a " * 30 + "the " + "a " * 30 + "mit " + "a " * 30 + "license"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = {
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by-sa",
        cc.format(""): "cc-by", cc.format("-NonCommercial"): "cc-by-nc", cc.format("-ShareAlike"): "cc-by-sa", cc.format("-NonCommercial-ShareAlike"): "cc-by-nc,cc-by-sa",
        "Licensed under CC BY 4.0. " + "Some words of text go here. " * 3 + cc.format("-NonCommercial"): "cc-by,cc-by-nc", far: "",
        "licensed under the GNU General Public License": "gpl", "licensed under the GNU Lesser General Public License": "gpl,lgpl",  # the base phrase is in it
        "released under the MIT\nLicense": "mit", "Licensed under the Apache License, Version 2.0": "apache", "license under the public terms of this work by 4 0": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    docs = [(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == ["gpl,lgpl" if label == "lgpl" else label for label, _ in licenses.TEMPLATES]


def test_page_text(spark):
    cases = {
        "": "", "x < y &lt; z": "x < y < z", "<p>a<p>b": "a b", "<div class='ad'>z</div><div>a<b>c</b> d</div><script>if(a<b)</script>q": "ac d q",
        "<nav>m</nav><article><header>h</header><h1>t&nbsp;\n u</h1><p>v<br>w</p><section id=comments><p>c</p></section></article><footer>f</footer>": "t u v w",
        "<article><form>a<input>b</form>k": "k", "<p>a<!-- x": "a", "<main><p>m</main><aside>s": "m", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "a b c d e",
    }
    rows = [(i, "http://h.example/x", h, 1) for i, h in enumerate(cases)] + [(99, None, None, 1)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    for i, h in enumerate(cases):
        assert (got[i].text, got[i].n_chars) == (cases[h], len(cases[h])), h
    assert got[99].text == ""
    # A box that many pages of a host share goes; the same box on another host's single page, and own text, stay.
    page = "<body><div><p>Our shop is open daily</p></div><p>Text number {} of the page</p></body>"
    site = [(i, f"https://User@Shop.example:80/p{i}", page.format(i)) for i in range(30)] + [(100, "https://other.example/", page.format(100))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 of the page" and got[100] == "Our shop is open daily Text number 100 of the page"


def test_page_template_is_counted_on_marked_pages(spark):
    page = "<body><div><p>Shop open daily</p></div><article><p>Own {0}</p><p>Passage that articles share</p></article><div><b>By line<br></b>tail {0}</div><div><b>Related {0}<br></b>more</div></body>"
    site = [(i, f"https://shop.example/p{i}", page.format(i)) for i in range(30)] + [(50, "https://shop.example/q", "<div><p>Shop open daily</p></div><p>No mark</p>"), (60, "https://other.example/", page.format(60))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own 3 Passage that articles share By line tail 3 Related 3 more"
    assert got[50] == "No mark" and got[60] == "Shop open daily Own 60 Passage that articles share By line tail 60 Related 60 more"
    # Subtrees left out by name are counted too, and a span left out takes no text along.
    kept, subtrees = html.blocks("<nav><p>m</p></nav><article>a<span class=ad>x</span>b<span class=ad><p>c</p></span></article>")
    assert [t for t, *_ in kept] == ["ab"] and len(subtrees) == 4


def test_page_text_is_not_lost_by_marks_and_names(spark):
    cases = {
        '<article><p>one <svg class="i"/> two</p><p>three</p></article>': "one two three",
        "<p>a</p><template><p>b</p>": "a b", "<p>a<svg><path d=''>b": "ab", "<p>a</p><script>b<p>c</p>": "a",
        '<body><div class="page-header-wrap has-sidebar"><article>text</article></div>': "text",
        '<div class="site-header"><article>text</article>menu</div>': "text", '<form id="aspnetForm"><input><article>text</article>more</form>': "text",
        '<article><div class="side-by-side">a</div><p class="social-history">b</p><section id="discussion">c</section></article>': "a b c",
        "<article>x<math><mi>y</mi></math></article>": "xy", '<article class="post">a</article><article class="comment">b</article>': "a",
        '<div class="adSlot">z</div><div class="ad-slot-2">z</div><p class="cookie-banner">z</p><p>y</p>': "y",
        "<nav><article>teaser</article></nav><aside><main>n</main></aside>": "", '<div role="main" class="menu">m</div>': "m",
    }
    for page, text in cases.items():
        assert " ".join(t for t, *_ in html.blocks(page)[0]) == text, page
    # One entry an element, however deep: the blocks don't name the subtrees around them.
    kept, subtrees = html.blocks("<div>" * 100_000 + "x<p>y")
    assert [t for t, *_ in kept] == ["x", "y"] and len(subtrees) == 100_001
    # The per-host count decides between a shared box and own text of the same form.
    page = "<div><section><p>Daily offers</p></section><section><p>Own {0}</p></section><p>Tail {0}</p></div>"
    site = [(i, f"https://shop.example/p{i}", page.format(i)) for i in range(12)]
    got = html.main_text(spark.createDataFrame(site, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own {i} Tail {i}" for i in range(12)}


def test_queries_are_named_by_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    kept = corpus_pipeline.quality_rules(spark, docs, SF001)
    wanted = {r.doc_id for r in fertility.quality(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted
    unique = corpus_pipeline.minhash_near_dedup(spark, kept, SF001)
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in minhash.near_duplicates(kept).where("kept").collect()}
    out = corpus_pipeline.run(spark, SF001)
    assert 0 < out.count() and out.where("n_tokens = 0").count() == 0
