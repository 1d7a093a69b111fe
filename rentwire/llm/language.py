"""Language identification by nearest centroids (operator 3).

A text is the L2-normalised TF-IDF vector of its hashed character 2- and 3-grams (letters lower-cased, all else a space).
Document frequencies come from all labelled rows. Each language has several centroids from spherical k-means on a
bounded sample; a text gets the language of the centroid with the highest cosine, and is rejected when it is further from
every centroid of that language than the sample allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import U, cut, slices, with_fields

DIMENSIONS = 4096
#: Labelled texts of a language, about, that its centroids are fitted on (a share of its distinct texts, by hash).
SAMPLE = 800
CENTROIDS = 3
ROUNDS = 8
#: A text is rejected below this share of the cosine that all but one in a thousand sampled texts reach.
SLACK = 0.25
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMENSIONS) counts of hashed grams, and letters of each text."""
    lowered = [(x or "").lower() for x in texts.to_pylist()]
    sizes = np.array([len(x) for x in lowered], np.int64)
    points = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(lowered)), sizes + 1)  # each with the space behind it
    is_letter = letters()[points]
    n_letters = np.bincount(text[is_letter], minlength=len(lowered))
    c = np.where(is_letter, points, 32).astype(U)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a space counts once, behind a word
    c, text, is_letter = c[keep], text[keep], is_letter[keep]
    before = np.concatenate([[U(32)], c[:-1]]) if len(c) else c
    before2 = np.concatenate([[U(32)], before[:-1]]) if len(c) else c
    two = ((before * U(0x9E3779B97F4A7C15) + c * U(0xC2B2AE3D27D4EB4F)) >> U(40)).astype(np.int64) % DIMENSIONS
    three = ((before2 * U(0x165667B19E3779F9) + before * U(0xD6E8FEB86659FD93) + c * U(0x27D4EB2F165667C5)) >> U(40)).astype(np.int64) % DIMENSIONS
    at = text * DIMENSIONS
    counts = np.bincount(at + two, minlength=len(lowered) * DIMENSIONS) + np.bincount(at + three, minlength=len(lowered) * DIMENSIONS)
    return counts.reshape(-1, DIMENSIONS), n_letters


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, n_letters = gram_counts(texts)
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), n_letters


def inverse_frequencies(labelled: DataFrame) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 of every dimension over all rows; each task sends one sum for each dimension."""

    def run(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for part in slices(batches, "text", most_bytes=1_000_000, most_rows=256):
            counts, _ = gram_counts(part.column("text"))
            df, n = df + (counts > 0).sum(axis=0), n + len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS + 1), pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["at", "n"])

    rows = labelled.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(DIMENSIONS + 1)
    for at, n in rows:
        sums[at] = n
    return (np.log((1 + sums[-1]) / (1 + sums[:-1])) + 1).astype(np.float32)


def spherical_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids of unit rows; begins with the rows furthest from each other, so it has no random part."""
    mean = x.mean(axis=0)
    picks = [int(np.argmax(x @ mean))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        v, n_letters = vectors(texts, self.idf)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = v @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        none = n_letters == 0
        score[none] = 0
        return [UNKNOWN if no else self.langs[b] for no, b in zip(none, best)], score, none | (score < self.least[best])


def fit(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """labelled: text and lang. Rows without text or lang are left out; no rows give a model of no languages.

    The model, which is broadcast, is ``k`` vectors for each language (16 KB each), so ``lang`` has to name languages, some thousands at most.
    A text that comes often counts once; of few texts all are taken.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    idf = inverse_frequencies(labelled)
    # The sample is a share of a language's distinct texts, by their hashes; all copies of a text are one row before any vector is made.
    keyed = labelled.withColumn("h", F.xxhash64("text", F.lit(3)))
    texts = keyed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    shares = cut(texts.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")).alias("share")))  # a row for each language
    picked = keyed.join(shares, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).dropDuplicates(["lang", "h"])

    def vectorise(batches):
        for part in slices(batches, "text", most_bytes=1_000_000, most_rows=256):
            v, n_letters = vectors(part.column("text"), idf)
            some = pa.array(n_letters > 0)
            yield pa.RecordBatch.from_arrays([part.column("lang").filter(some), pa.array([x.tobytes() for x in v[n_letters > 0]], pa.binary())], ["lang", "v"])

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(b, np.float32) for b in sorted(pdf.v)])  # about `sample` rows: a share of the distinct texts
        c = spherical_means(x, k, ROUNDS)
        least = np.quantile((x @ c.T).max(axis=1), 0.001) * SLACK
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "at": range(len(c)), "v": [y.astype(np.float32).tobytes() for y in c], "least": float(least)})

    rows = sorted(picked.mapInArrow(vectorise, "lang string, v binary").groupBy("lang").applyInPandas(means, "lang string, at int, v binary, least double").collect(), key=lambda r: (r.lang, r.at))
    centroids = np.stack([np.frombuffer(bytes(r.v), np.float32) for r in rows]) if rows else np.empty((0, DIMENSIONS), np.float32)
    return Model(idf, [r.lang for r in rows], centroids, np.array([r.least for r in rows]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (which needs text) with lang_pred, score and rejected.

    A text that is null or has no letters is ``und`` with score 0, and rejected. A model of no languages rejects all.
    Rows are judged by their text alone, so rows that repeat are judged alike; an empty table gives no rows.
    Columns of those names are replaced; all others stay.
    """
    extra = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    source = docs.select(*(c for c in docs.columns if c not in extra))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, "text", most_bytes=1_000_000, most_rows=256):
            lang, score, rejected = sent.value.predict(part.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*part.schema.names, *extra])

    return source.mapInArrow(run, with_fields(source.schema, extra))


def held_out() -> Column:
    """True for the rows that no model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
