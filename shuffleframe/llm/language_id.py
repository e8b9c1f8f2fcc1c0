"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (n = 1 to 3 within words and over their ends), weighted
by TF-IDF and normalised to length one. Each language has several centroids, found by spherical k-means over
the vectors of its texts, and a text has the language of the centroid of highest cosine. A text that is
farther from its centroid than a distance learned for texts of its length is marked as rejected.

The document frequencies and the distances cover all texts to learn from, the distances equal texts once. The
centroids are fitted on a bounded sample of them: the sample_size texts of each language whose text has the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from .common import KEPT, arrow_map, materialise, named, unpacked, with_text

#: Hashed n-grams.
FEATURES = 8192
#: Different texts of each language that centroids are fitted on at most.
SAMPLE = 1000
CENTROIDS, ROUNDS = 3, 12
#: A text is rejected whose cosine is below this part of the one that so many of its centroid's texts of like length reach:
#: junk among the texts to learn from moves no limit while it is less than the rest of them.
SLACK, REACHED = 0.5, 0.9
#: Texts that the limit of a length is learned from at least. Bins of the cosine.
LEAST, BINS = 50, 200
#: Lengths: the number of binary digits of the number of different features.
LENGTHS = FEATURES.bit_length() + 1
UNDETERMINED = "und"
#: Characters of a text that are looked at a time.
PIECE = 1 << 20

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def counts(text: str | None) -> np.ndarray | None:
    """How often each feature is in a whole text; None without a letter."""
    total, before = None, np.zeros(0, np.uint32)
    text = text or ""
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        keep = codes != 32  # runs of other characters are one space
        keep[1:] |= codes[:-1] != 32
        keep[:1] |= len(before) == 0 or before[-1] != 32
        codes = codes[keep]
        if total is None:
            if not (codes != 32).any():
                continue
            codes = np.concatenate([np.full(int(codes[0] != 32), 32, np.uint32), codes])
            total = np.zeros(FEATURES, np.int64)
        x = np.concatenate([before, codes])
        new = len(codes)
        hashed = [x * np.uint32(0x9E3779B1)]
        hashed.append(hashed[0][:-1] * np.uint32(31) + x[1:] * np.uint32(0x85EBCA77))
        hashed.append(hashed[1][:-1] * np.uint32(31) + x[2:] * np.uint32(0xC2B2AE3D))
        for h in hashed:
            h = h[max(0, len(h) - new) :]
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=FEATURES)
        before = x[-2:]
    return total


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    #: The cosine that a text must reach, by centroid and length.
    limit: np.ndarray

    def vector(self, text: str | None) -> np.ndarray | None:
        found = counts(text)
        if found is None:
            return None
        return unit(np.log1p(found) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine cut to 0..1, and whether rejected."""
        vectors = [self.vector(t) for t in texts]
        lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, v in enumerate(vectors) if v is not None]
        if at and len(self.centroids):
            cosine = np.stack([vectors[i] for i in at]) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, c, x in zip(at, best, cosine.max(axis=1), strict=True):
                lang[i] = self.languages[self.owner[c]]
                score[i] = min(max(float(x), 0.0), 1.0)
                rejected[i] = x < self.limit[c, length(vectors[i])]
        return lang, score, rejected


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def length(v: np.ndarray) -> int:
    return int(np.count_nonzero(v)).bit_length()


def least_cosines(seen: np.ndarray) -> np.ndarray:
    """The cosine that texts of each length must reach, from the numbers of a centroid's texts (lengths x bins of the cosine).

    A length with fewer than LEAST texts follows the next longer one that has them: of half as many features, the cosine with
    the same centroid is smaller by the root of 2. Lengths above all such have the limit of the longest. Without any, all texts
    count as of their median length.
    """
    if not seen.any():
        return np.zeros(len(seen))
    if not (seen.sum(axis=1) >= LEAST).any():
        middle = np.searchsorted(2 * np.cumsum(seen.sum(axis=1)), seen.sum())
        seen = np.where(np.arange(len(seen))[:, None] == middle, seen.sum(axis=0), 0)
    learned = np.flatnonzero(seen.sum(axis=1) >= min(LEAST, seen.sum()))
    below = np.cumsum(seen[learned], axis=1)
    limit = [SLACK * np.searchsorted(x, (1 - REACHED) * x[-1], side="right") / seen.shape[1] for x in below]
    at = np.minimum(np.searchsorted(learned, np.arange(len(seen))), len(learned) - 1)
    return np.array(limit)[at] / np.sqrt(2) ** np.maximum(learned[at] - np.arange(len(seen)), 0)


def limits(known: DataFrame, model: Model) -> np.ndarray:
    """What model.limit is, from all texts of known (text, lang); equal texts of a language count once."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = {k: np.flatnonzero(m.owner == i) for i, k in enumerate(m.languages)}
        for rows in batches:
            out = []
            for value, name, h in zip(rows.column(0), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                v = m.vector(value.as_py()) if len(of.get(name, ())) else None
                if v is not None:
                    cosine = m.centroids[of[name]] @ v
                    out.append((h, int(of[name][cosine.argmax()]), length(v), min(max(int(cosine.max() * BINS), 0), BINS - 1)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["h", "centroid", "length", "bin"])

    found = arrow_map(known.select("text", "lang", F.xxhash64("text", "lang").alias("h")), run, "h long, centroid int, length int, bin int").distinct()
    seen = np.zeros((len(model.centroids), LENGTHS, BINS), np.int32)
    for r in found.groupBy("centroid", "length", "bin").count().toLocalIterator():
        seen[r.centroid, r.length, r.bin] = r["count"]
    return np.array([least_cosines(x) for x in seen]).reshape(-1, LENGTHS)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and the number of each row's; starts from rows drawn with a fixed seed."""
    c = x[np.random.default_rng(0).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = np.stack([unit(x[of == i].mean(axis=0)) if (of == i).any() else c[i] for i in range(len(c))])
    return c, (x @ c.T).argmax(axis=1)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """The number of texts with a letter and of those that have each feature; each task sends one row a feature at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for rows in batches:
            for value in rows.column(0):
                found = counts(value.as_py())
                if found is not None:
                    n += 1
                    df += found > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], names=["feature", "n"])

    rows = arrow_map(docs.select(F.col(f"`{text}`").alias("text")), run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES)
    for r in rows:
        if r.feature >= 0:
            df[r.feature] = r.n
    return sum(r.n for r in rows if r.feature == -1), df


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows whose lang is not null. Without rows to learn from, the model finds every text undetermined and rejects it."""
    known = docs.where(named(lang).isNotNull()).select(named(text).alias("text"), named(lang).alias("lang"))
    n, df = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + df)) + 1

    # the texts of least hash for each language, as (lang, hash) first: only the chosen texts are gathered
    keyed = known.withColumn("h", F.xxhash64("text", "lang"))
    sizes = materialise(keyed.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sorted(r.lang for r in sizes.select("lang").toLocalIterator())
    if not languages:
        return Model(idf, [], np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros((0, LENGTHS)))
    # a hash is uniform, so of a language's different texts this part of the range holds more than the sample, or all; the rank takes the rest away
    cuts = F.broadcast(sizes.select("lang", ((2.0 * sample + 200) / F.col("n")).alias("cut")))
    uniform = F.shiftrightunsigned("h", 11) / float(1 << 53)
    few = keyed.join(cuts, "lang").where(uniform < F.col("cut")).groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies count once
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for value, name in zip(rows.column(0), rows.column(1), strict=True):
                counted = counts(value.as_py())
                if counted is not None:
                    at = np.flatnonzero(counted)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([at.astype("<u2").tobytes() + np.minimum(counted[at], 2**31 - 1).astype("<i4").tobytes()])], names=["lang", "v"])

    def dense(v: bytes) -> np.ndarray:
        x, n_at = np.zeros(FEATURES, np.float32), len(v) // 6
        x[np.frombuffer(v[: 2 * n_at], "<u2")] = np.log1p(np.frombuffer(v[2 * n_at :], "<i4"))
        return unit(x * idf)

    def fitted(rows: pa.Table) -> pa.Table:  # one language: sample rows at most
        c, _ = spherical_kmeans(np.stack([dense(v) for v in sorted(rows.column("v").to_pylist())]), centroids)
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(c)), "k": pa.array(range(len(c)), pa.int32()), "c": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary())})

    by_lang = arrow_map(ranked.select("text", "lang"), vectors, "lang string, v binary").groupBy("lang").applyInArrow(fitted, "lang string, k int, c binary")
    number = {k: i for i, k in enumerate(languages)}
    learned = sorted((number[r.lang], r.k, bytes(r.c)) for r in by_lang.toLocalIterator())  # the model itself
    found, owner = [np.frombuffer(c, "<f4") for _, _, c in learned], [i for i, _, _ in learned]
    model = Model(idf, languages, np.stack(found) if found else np.zeros((0, FEATURES), np.float32), np.array(owner, np.int64), np.zeros((len(found), LENGTHS)))
    model.limit = limits(known, model)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns lang_pred (und if text is null or has no letter), score (cosine to the nearest centroid, 0 to 1) and rejected, whose names get the prefix; columns of docs that are named so are replaced, other names don't matter.

    Reads the text only. Ties go to the language that is first by name. Repeated rows are predicted alike, no rows give no rows. The model, of bounded size, is broadcast; there is no shuffle.
    """
    new = [prefix + c for c in ("lang_pred", "score", "rejected")]
    kept = [c for c in docs.columns if c not in new]
    frame, texts = with_text(docs, kept, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                some = rows.slice(at, 256)
                lang, score, rejected = shared.value.predict(texts(some).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[KEPT, "lang", "score", "rejected"])

    schema = StructType([frame.schema[KEPT]]).add("lang", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return arrow_map(frame, run, schema).select(*unpacked(kept), *[F.col(c).alias(name) for c, name in zip(("lang", "score", "rejected"), new, strict=True)])
