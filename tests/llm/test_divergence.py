"""Source divergence audit against a plain computation with Python integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from cargoscope.llm import divergence

DDL = "doc_id long, text string, lang string, source string, n long, term string, rank int, block int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs, top):
    docs = [(r[2] or "", r[3] or "", TERM.findall(lowered(r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency, total = Counter(), Counter()
        for _, _, words in mine:
            frequency.update(set(words))
            total.update(words)
        kept = [t for t in total if frequency[t] >= min_docs]
        groups = defaultdict(Counter)
        for _, source, words in mine:
            groups[source].update(words)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        shares, whole = {g: share(c) for g, c in groups.items()}, share(total)
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for g, p in shares.items():
            pairs = [(-sum(far(p[t], q[t]) for t in kept), o.encode(), o) for o, q in shares.items() if o != g]
            terms = [(-far(p[t], whole[t]), t.encode(), t) for t in kept if groups[g][t] and p[t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, g, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


def table():
    rng = random.Random(2)
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "de", None, "", "xx"])
        source = rng.choice([*(f"s{k}" for k in range(13)), None, "", "ä", "z"])
        words = [rng.choice("abcdefghijklmnop") + rng.choice(["", "b", "É", "ß", "日本"]) for _ in range(rng.choice([0, 1, 3, 40, 200]))]
        words = [w.upper() if rng.random() < 0.3 else w for w in words]
        rows.append((i, rng.choice([" ".join(words), " ".join(words), "1-2.".join(words), None]), lang, source, 1, "t", 1, 1))
    rows += [rows[4], rows[4], (None, "a b c", "en", "s1", 1, "t", 1, 1)]
    # A source that holds a third of the rows, a language that keeps no term, a group without terms, one lone group.
    rows += [(1000 + i, f"a b word{i % 30} É é", "en", "s0", 1, "t", 1, 1) for i in range(130)]
    rows += [(2000 + i, f"rare{i}", "no", f"n{i}", 1, "t", 1, 1) for i in range(3)] + [(3000, "12 - 34", "en", "empty", 1, "t", 1, 1), (3001, "a", "one", "lone", 1, "t", 1, 1)]
    rows.append((4000, "a " * 200_000 + "Zulu", "en", "s3", 1, "t", 1, 1))
    return rows


def test_audit_equals_integers(spark):
    rows = table()
    docs = spark.createDataFrame(rows, DDL)
    for options in ({}, {"min_docs": 3, "top": 4, "group_block": 3, "term_block": 7}):
        want = plain(rows, options.get("min_docs", 10), options.get("top", 10))
        got = sorted(tuple(r) for r in divergence.audit(docs, **options).collect())
        assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_leave_tasks_in_parts(spark, monkeypatch):
    rows = table()
    whole = {tuple(r) for r in divergence.term_counts(spark.createDataFrame(rows, DDL)).collect()}
    assert {r[:2] for r in whole} == {(r[2] or "", r[3] or "") for r in rows}
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[3] or "", "text": r[1] or ""} for r in rows[:300]])
    sums, parts = defaultdict(lambda: [0, 0]), 0
    for part in divergence._count([batch]):
        parts += 1
        for r in part.to_pylist():
            key = sums[r["lang"], r["source"], r["term"]]
            key[0], key[1] = key[0] + r["n"], key[1] + r["docs"]
    assert parts > 100
    monkeypatch.undo()
    assert sums == {(r["lang"], r["source"], r["term"]): [r["n"], r["docs"]] for part in divergence._count([batch]) for r in part.to_pylist()}
    text = ("Wörter Zwei drei4fünf É " * 50).encode().lower()
    assert [t.decode() for part in divergence.terms(text, 7) for t in part] == ["wörter", "zwei", "drei", "fünf", "É"] * 50
    assert [t for part in divergence.terms(b"a" * 100, 7) for t in part] == [b"a" * 100]


def test_shares_of_huge_counts_are_exact(spark):
    """Counts far beyond what 64-bit products could hold."""
    rows = [(10**13 + 7, 3 * 10**15 + 1, 12345), (0, 10**15, 10**6), (5, 5, 0), (0, 0, 1)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share("n", "total", "kept")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * kept) if kept else None for n, total, kept in rows]


def test_counts_travel_in_buckets(spark, monkeypatch):
    """A task sends a row for each language and bucket, not one a term; long texts are counted in chunks."""
    rows = [r for r in table() if r[0] is not None]
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[3] or "", "text": r[1] or ""} for r in rows])
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        want[r[2] or "", r[3] or "", None]
        for term, n in Counter(TERM.findall(lowered(r[1] or ""))).items():
            key = want[r[2] or "", r[3] or "", term]
            key[0], key[1] = key[0] + n, key[1] + 1
    for chunk, held in ((1 << 20, 600_000), (9, 600_000), (1 << 20, 50)):
        monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(divergence, "HELD_COUNTS", held)
        made = [r for part in divergence._deal(4)(iter([batch])) for r in part.to_pylist()]
        if held > 50:
            assert len(made) == len({(r["lang"], r["bucket"]) for r in made}) <= 8 * len({r[2] or "" for r in rows})
        got = defaultdict(lambda: [0, 0])
        for r in made:
            sources = [s for s, k in zip(r["sources"], r["sizes"], strict=True) for _ in range(k)]
            for source, term, n, docs in zip(sources, r["terms"], r["n"], r["docs"], strict=True):
                key = got[r["lang"], source, term]
                key[0], key[1] = key[0] + n, key[1] + docs
        assert got == want
