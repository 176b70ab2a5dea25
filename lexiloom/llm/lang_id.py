"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (1 to 3 characters of
lower-cased words, with word edges), weighted by log term frequency times
inverse document frequency and scaled to length 1.  ``fit`` clusters each
language's vectors into several centroids (spherical k-means); ``predict``
takes the language of the centroid with the highest cosine.  A text whose
cosine lies below the language's own limit, which is learned from the
distances of its training texts, is marked as rejected.

Document frequencies count every training row.  Centroids are fitted on a
bounded sample: of each language the ``per_lang`` distinct texts with the
smallest hash, so a language of many copies is learned like any other, and a
text that repeats counts once in the centroids.  Every language that has a text
with letters is learned.  The model is sent to the tasks in parts of
``LANGS_AT_ONCE`` languages, so any number of languages works.

A null text, or one without letters, is ``und`` with score 0.  With no training
rows every text is ``und``.  Cosines have 6 places; of centroids with equal ones the first
language by name wins.  Very long texts are counted in blocks of ``BLOCK`` characters.
Columns named like the results are replaced; others are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import column_at, kept_text, small_or_shuffled, stored

#: Buckets that n-grams are hashed into.
DIMS = 1 << 13
#: Characters vectorised at one time.
BLOCK = 1 << 20
#: Languages in one part of the model: some 33 MB with 4 centroids each.
LANGS_AT_ONCE = 256
#: Range of the hash by which texts are sampled.
SPACE = 1 << 40


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    return lower, letter


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the text's hashed n-grams; None without letters."""
    if not text:
        return None
    lower, letter = _characters()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, any_letter, edge = np.zeros(DIMS, np.int64), False, np.zeros(1, np.uint64)
    for a in range(0, len(cps), BLOCK):
        c = cps[max(0, a - 2) : a + BLOCK]  # two characters again, so that no n-gram is lost
        ok = letter[c]
        any_letter = any_letter or bool(ok.any())
        x = np.where(ok, lower[c], 0).astype(np.uint64)
        if a == 0:
            x = np.concatenate([edge, x])
        if a + BLOCK >= len(cps):
            x = np.concatenate([x, edge])
        skip = 2 if a else 0
        one = x[skip:]
        out += np.bincount(_hash(one[one > 0]), minlength=DIMS)
        y = x[max(0, skip - 1) :]
        two = (y[:-1] << np.uint64(21)) | y[1:]
        out += np.bincount(_hash(two[two > 0] + np.uint64(1 << 62)), minlength=DIMS)
        three = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
        out += np.bincount(_hash(three[(x[1:-1] > 0)]), minlength=DIMS)
    return out if any_letter else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


@dataclass
class Part:
    """The centroids of some languages."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of a row
    limits: np.ndarray  # of each language: the least cosine that is accepted

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(text) if len(self.langs) else None
        if counts is None:
            return "und", 0.0, True
        cosines = np.round(self.centroids @ vector(counts, self.idf), 6)  # so that equal centroids tie
        best = int(np.argmax(cosines))
        lang, score = int(self.owner[best]), float(min(1.0, max(0.0, cosines[best])))
        # a short text lies further from every centroid; the limit falls with the n-grams it has
        grams = int(np.count_nonzero(counts))
        return self.langs[lang], score, score < self.limits[lang] * min(1.0, (grams / 400) ** 0.5)


@dataclass
class Model:
    """The languages by name, and a stored table of their centroids (lang, centroid, least)."""

    idf: np.ndarray
    langs: list[str]
    centroids: DataFrame

    def parts(self) -> Iterator[Part]:
        """Parts of LANGS_AT_ONCE languages in order of name, one in memory at a time."""
        for a in range(0, max(1, len(self.langs)), LANGS_AT_ONCE):
            langs = self.langs[a : a + LANGS_AT_ONCE]
            found = sorted(self.centroids.where(F.col("lang").isin(langs)).collect(), key=lambda r: (r.lang, r.centroid))
            rows = np.stack([np.frombuffer(r.centroid, np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
            yield Part(self.idf, langs, rows, np.array([langs.index(r.lang) for r in found], int), np.array([max(r.least for r in found if r.lang == x) for x in langs]))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of docs each bucket occurs, and how many texts have letters.

    Each task sends one row of DIMS counts, summed again in Spark by bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                counts = gram_counts(t.as_py())
                if counts is not None:
                    total += counts > 0
                    n += 1
        ids = np.append(np.flatnonzero(total), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.append(total, n)[ids])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out[:DIMS], int(out[DIMS])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread rows; deterministic."""
    k = min(k, len(vectors))
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        for j in range(k):
            own = np.flatnonzero(near == j)
            if len(own):
                m = np.zeros(vectors.shape[1], vectors.dtype)
                for i in own:  # one by one, without a copy of the cluster
                    m += vectors[i]
                m /= len(own)
                centres[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return centres


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """lang, text: of each language the per_lang distinct texts with the smallest hash."""
    hashed = rows.withColumn("h", F.xxhash64("text"))
    texts = stored(hashed.select("lang", "h").distinct())
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod("h", F.lit(SPACE))).alias("first"))
    # about twice the bound is kept by hash before ranking, so that a frequent language is never ranked as a whole
    place = F.pmod("h", F.lit(SPACE))
    near = texts.join(small_or_shuffled(stored(sizes)), "lang").where((place < F.lit(2.0 * per_lang) / F.col("n") * SPACE) | (place == F.col("first")))
    order = W.partitionBy("lang").orderBy(place, "h")
    chosen = stored(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("lang", "h"))
    return hashed.join(small_or_shuffled(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def learned(texts: pd.Series, idf: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Up to k centroids of the texts, one row each, and the least cosine that is accepted; no centroids if no text has letters.

    Only the vectors are held, in one matrix: idle workers keep what many small arrays took.
    """
    vectors, grams = np.empty((len(texts), DIMS), np.float32), []
    for t in texts:
        counts = gram_counts(t)
        if counts is not None:
            vectors[len(grams)] = vector(counts, idf)
            grams.append(np.count_nonzero(counts))
    vectors = vectors[: len(grams)]
    if not grams:
        return vectors, 0.0
    centres = _clusters(vectors, k)
    scale = np.minimum(1.0, (np.array(grams) / 400) ** 0.5)
    best = (vectors @ centres.T).max(axis=1) / scale
    return centres, 0.6 * float(np.quantile(best, 0.01))


def fit(train: DataFrame, per_lang: int = 1000, k: int = 4, text: str = "text", lang: str = "lang") -> Model:
    """A model from the labelled rows of ``train``; rows with null lang or text are left out.

    per_lang bounds the sample of a language, so its clustering is one small group.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        centres, least = learned(group["text"].sort_values(), idf, k)
        return pd.DataFrame({"lang": pd.Series([group["lang"].iloc[0]] * len(centres), dtype=object), "centroid": pd.Series([c.tobytes() for c in centres], dtype=object), "least": pd.Series([least] * len(centres), dtype=float)})

    made = stored(sample(rows, per_lang).groupBy("lang").applyInPandas(one, "lang string, centroid binary, least double"))
    return Model(idf, sorted(r.lang for r in made.select("lang").distinct().collect()), made)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score and rejected for every row; reads only the text, which may be a field of a kept column (column.field).

    Each part of the model is one pass over the texts and keeps what is best so far.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    own = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent, at = kept_text(keep, text)
    apart = len(sent) > len(keep)  # the text is no part of what is kept, and goes no further than the last pass
    rows = F.struct(*[F.col(c).alias(c) for c in keep]).alias("row")
    out = docs.select(rows, *([F.col(text).alias("text")] if apart else []), F.lit(None).cast(own).alias("best"))

    def one(model, last: bool) -> DataFrame:
        kept = [c for c in out.columns if c != "best" and not (last and c == "text")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    best = []
                    for t, before in zip(column_at(part, "text" if apart else f"row.{at}"), column_at(part, "best"), strict=True):
                        lang, score, rejected = model.value.judge(t.as_py())
                        old = before.as_py()
                        best.append(old if old and old["score"] >= score else {"lang_pred": lang, "score": score, "rejected": rejected})
                    kind = part.schema.field("best").type
                    yield pa.RecordBatch.from_arrays([*(column_at(part, c) for c in kept), pa.array(best, kind)], [*kept, "best"])

        return out.mapInArrow(run, out.select(*kept, "best").schema)

    parts = -(-max(1, len(model.langs)) // LANGS_AT_ONCE)
    for n, part in enumerate(model.parts()):
        out = one(docs.sparkSession.sparkContext.broadcast(part), n == parts - 1)  # LANGS_AT_ONCE * k * DIMS floats at most
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "best.*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = 1000, k: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs; learns from the rows not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), per_lang, k)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
