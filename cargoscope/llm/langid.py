"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector over hashed character n-grams (bytes of the lower-cased text, 1 to 3 long).
Every learned language has a few centroids, found by spherical k-means over its training texts, so a language written
in several styles or scripts isn't averaged into one point. A text gets the language of the nearest centroid by
cosine; it is rejected when that centroid is further away than nearly all training texts of the language were
(distance-based rejection), or when it has no letter.

Training learns every language from whole texts. Centroids take at most ``TRAIN_ROWS`` distinct labelled rows (id and
text) per language, those with the smallest hash of the id, so the fit is repeatable; document frequencies are those of
all rows outside the held-out fold. Texts are counted inside tasks, each language is clustered in a task of its own,
and only centroids reach the driver. Every row is then predicted from its whole text. Neither lang, source nor doc_id is an input
of a prediction.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; with no usable training row
every text is ``und`` and rejected; more than ``MOST_LANGUAGES`` languages are an error; equal distances go to the first language by code point; repeated rows and null
ids pass through with the same result; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.common import cut, per_row

#: Labelled rows per language that the fit may take.
TRAIN_ROWS = 400
#: Parts of a language that are ranked side by side, step by step.
RANKED_BY = (512, 64, 8, 1)
CENTROIDS = 4
#: Languages that a model may hold, at CENTROIDS vectors of 32 KB each; more of them are an error.
MOST_LANGUAGES = 2000
BUCKETS = 1 << 13
#: A text is rejected beyond this quantile of its language's training distances, plus a margin.
REJECT_QUANTILE = 0.995
REJECT_MARGIN = 0.15

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
DDL = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
#: Bytes of a text counted at a time, so that memory doesn't grow with the text.
_BLOCK = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the letters, words set apart by one space."""
    counts = np.zeros(BUCKETS)
    data = (" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")
    for at in range(0, len(data), _BLOCK):
        b = np.frombuffer(data, np.uint8, min(_BLOCK + 2, len(data) - at), at).astype(np.uint32)
        first = b[: _BLOCK]
        for n, codes in ((1, first), (2, (b[:-1] << 8 | b[1:])[:_BLOCK]), (3, (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[:_BLOCK] if len(b) > 2 else b[:0])):
            # Multiplicative hashing; the n-gram's length is part of the key.
            key = (codes + np.uint32(n << 24)) * np.uint32(2654435761)
            counts += np.bincount(key >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def cluster(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means with a fixed start: the point nearest the mean, then the points furthest from those taken."""
    mean = points.mean(0)
    chosen = [int(np.argmax(points @ mean))]
    nearest = points @ points[chosen[0]]
    while len(chosen) < min(k, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    centres = points[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = points[own == c].sum(0)
                centres[c] = total / max(np.sqrt(total @ total), 1e-12)
    return centres


class Model:
    """idf weights, centroids with their language, and each language's rejection cosine."""

    def __init__(self, idf: np.ndarray, learned: list[tuple[str, float, np.ndarray]]) -> None:
        """``learned``: language, lowest accepted cosine, and its centroids, for each language once."""
        learned = sorted(learned, key=lambda found: found[0])
        self.idf = idf
        self.langs = [lang for lang, _, _ in learned]
        self.floor = [floor for _, floor, _ in learned]
        self.owner = np.array([k for k, (_, _, own) in enumerate(learned) for _ in own], int)
        self.centres = np.concatenate([own for _, _, own in learned]) if learned else np.zeros((0, BUCKETS), np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether it is rejected."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        cosines = self.centres @ vector(ngram_counts(text), self.idf)
        best = int(np.argmax(cosines))
        k, score = int(self.owner[best]), float(cosines[best])
        return self.langs[k], min(1.0, max(0.0, score)), score < self.floor[k]


def held_out(doc_id):
    """True for the fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(batches):
    """mapInArrow: texts -> per task, the number of texts that hold each bucket, and of all texts at bucket -1."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        texts = batch.column(0)
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if text and _LETTER.search(text):
                df += ngram_counts(text) > 0
                n += 1
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n))], names=["bucket", "n"])


def _count_vectors(batches):
    """mapInArrow: (lang, id, text_key, text) -> the text's n-gram counts, each key once per task."""
    seen = set()
    for batch in batches:
        for i in range(batch.num_rows):
            lang, key, text_key, text = (batch.column(k)[i].as_py() for k in range(4))
            if (lang, key, text_key) not in seen:
                seen.add((lang, key, text_key))
                counts = ngram_counts(text).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_pylist([{"lang": lang, "id": key, "text_key": text_key, "counts": counts}], schema=_COUNTS)


_COUNTS = pa.schema([("lang", pa.string()), ("id", pa.int64()), ("text_key", pa.int64()), ("counts", pa.binary())])
_LEARNED = pa.schema([("lang", pa.string()), ("floor", pa.float64()), ("centres", pa.binary())])


def _learn(idf: np.ndarray):
    """applyInArrow: the count vectors of one language, a bounded number -> its rejection cosine and centroids."""

    def run(table: pa.Table) -> pa.Table:
        found = sorted({(r["id"], r["text_key"]): r for r in table.to_pylist()}.items())
        points = np.array([vector(np.frombuffer(r["counts"], np.float32).astype(float), idf) for _, r in found])
        own = cluster(points, CENTROIDS)
        floor = float(np.quantile((points @ own.T).max(1), 1 - REJECT_QUANTILE)) - REJECT_MARGIN
        return pa.Table.from_pylist([{"lang": found[0][1]["lang"], "floor": floor, "centres": own.astype(np.float32).tobytes()}], schema=_LEARNED)

    return run


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the training fold of ``docs`` (doc_id, text, lang): every language, from its first ``rows`` distinct rows
    (id and text) in the order of the id's hash, the id and the text's hash; idf from the whole fold."""
    key = docs["doc_id"].cast("long")
    fold = docs.select(key.alias("id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where(~held_out(key))
    usable = fold.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike("\\p{L}"))
    usable = usable.select("lang", F.xxhash64("id").alias("h"), "id", F.xxhash64("text").alias("text_key"), "text")
    # The first rows of each (language, part), then of ever fewer parts, so that a hot language is ranked in many tasks
    # and the last rank of all sees a bounded number of rows; no text is moved.
    first = usable.select("lang", "h", "id", "text_key").distinct()
    for parts in RANKED_BY:
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("id", "text_key"), F.lit(parts))).orderBy("h", "id", "text_key")
        first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")
    last = cut(first.groupBy("lang").agg(F.max(F.struct("h", "id", "text_key")).alias("last")))
    if last.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their centroids wouldn't fit into every task")
    counted = fold.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most a row per bucket
    df = np.zeros(BUCKETS + 1)
    for r in counted:
        df[r["bucket"]] = r["n"]  # the number of texts, at -1, is the last
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    chosen = usable.join(F.broadcast(last), "lang").where(F.struct("h", "id", "text_key") <= F.col("last"))  # a row per language
    vectors = chosen.select("lang", "id", "text_key", "text").mapInArrow(_count_vectors, "lang string, id long, text_key long, counts binary")
    learned = vectors.groupBy("lang").applyInArrow(_learn(idf), "lang string, floor double, centres binary").collect()  # CENTROIDS vectors per language
    return Model(idf, [(r["lang"], r["floor"], np.frombuffer(r["centres"], np.float32).reshape(-1, BUCKETS)) for r in learned])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and lang for the fit): held_out, lang_pred, score, rejected."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of 32 KB per language

    def start():
        fitted = shared.value

        def one(row: dict):
            lang, score, rejected = fitted.predict(row["text"])
            yield {"doc_id": row["doc_id"], "held_out": row["held_out"], "lang_pred": lang, "score": score, "rejected": rejected}

        return one

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held_out(docs["doc_id"].cast("long")).alias("held_out"))
    return narrow.mapInArrow(per_row(SCHEMA, start), DDL)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def keep(batches):
        fitted = shared.value
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([not fitted.predict(texts[i].as_py())[2] for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
