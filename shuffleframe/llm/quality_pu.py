"""Quality classification by positive-unlabelled learning.

A logistic model over bounded features of a text's form is fitted by minimising the non-negative unbiased
risk (du Plessis et al. 2015, Kiryo et al. 2017) with the class prior pi, trusted positives P and unlabelled
texts U:  R(f) = pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]),  l(z) = log(1 + exp(-z)).
Every text to learn from is in U. Each round sums the risk, gradient and curvature over all partitions and
takes a damped Newton step; where the part under max() is negative, the round takes the non-negative
correction instead and steps so that it grows. The features are computed once and kept in the shared folder.
The prior is estimated from P and U alone (see mixture_prior); no negative label is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructType

from .common import _BLANK, KEPT, arrow_map, materialise, named, packed, unpacked, with_text

#: Symbols whose part of the text is a feature each.
SYMBOLS = b"!?.,;:|$%&#*@/\\<>{}[]()_=+-~^`'\""
#: Bytes of a text that are looked at a time.
PIECE = 1 << 20
ROUNDS, RIDGE = 14, 1e-3
#: Newton steps are cut to this length in the standardised space.
STEP = 4.0
NAMES = ["length", "words", "word_length", "distinct", "repeated", "lines", "same_lines", "upper", "upper_words", "digits", "other", "marked", "long_words", *(f"symbol_{i}" for i in range(len(SYMBOLS)))]
DIM = len(NAMES)

_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL = np.zeros((5, 256), bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[list(SYMBOLS)] = True


def features(text: str | None) -> np.ndarray:
    """The features of a whole text, each between 0 and about 4; zeros for null and for the empty text. It is looked at in pieces, which change no feature; its different words and lines are held."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIM)
    if not data:
        return out
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n_words = repeated = uppers = marked = long = letters = lines = 0
    distinct: set[bytes] = set()
    kinds: set[bytes] = set()  # of lines
    before = b""
    begun: list[bytes] = []  # of a line that goes on
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > PIECE and (cut := _BLANK.search(data, at + PIECE)):
            to = cut.start()
        part = data[at:to]
        at = to
        own = part.split(b"\n")
        begun.append(own[0])
        if len(own) > 1:
            own[0] = b"".join(begun)
            begun = [own.pop()]
            own = [x for x in own if x.strip()]
            lines += len(own)
            kinds.update(own)
        words = part.split()
        if not words:
            continue
        n_words += len(words)
        distinct.update(words)
        repeated += sum(map(bytes.__eq__, words, [before, *words[:-1]]))
        before = words[-1]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters += int(lengths.sum())
        long += int((lengths > 20).sum())
        uppers += sum(map(bytes.isupper, words))
        joined = np.frombuffer(part, np.uint8)  # pieces end before a blank, so no two symbols in a row are parted
        marked += int((_SYMBOL[joined[:-1]] & _SYMBOL[joined[1:]]).sum())
    last = b"".join(begun)
    if last.strip():
        lines += 1
        kinds.add(last)
    same = lines - len(kinds)
    total = max(len(data), 1)
    w = max(n_words, 1)
    ascii_letters = int(hist[_UPPER].sum() + hist[_LOWER].sum())
    out[:13] = (
        math.log1p(total) / 5,
        math.log1p(n_words) / 4,
        min(letters / w / 10, 4.0),
        len(distinct) / w,
        math.sqrt(repeated / w),
        min(math.log1p(lines) / 3, 4.0),
        math.sqrt(same / max(lines, 1)),
        math.sqrt(int(hist[_UPPER].sum()) / max(ascii_letters, 1)),
        math.sqrt(uppers / w),
        math.sqrt(int(hist[_DIGIT].sum()) / total),
        math.sqrt(int(hist[128:].sum()) / total),
        math.sqrt(marked / total),
        math.sqrt(long / w),
    )
    out[13:] = np.sqrt(hist[list(SYMBOLS)] / w)
    return np.minimum(out, 4.0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the positive class of rows of features."""
        return _sigmoid(design(x, self.mean, self.scale) @ self.weights)


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(kept, x): the columns keep as one struct, and the features of the text as doubles in bytes. Neither a shuffle nor memory beyond one text."""
    frame, texts = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = pa.array([features(v.as_py()).tobytes() for v in texts(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), x], names=[KEPT, "x"])

    return arrow_map(frame, run, StructType([frame.schema[KEPT]]).add("x", BinaryType()))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, DIM)


def summed(frame: DataFrame, f, *others: str) -> np.ndarray:
    """The sum over all rows of f(x, positive, others), a fixed number of doubles for a batch; added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            if rows.num_rows:
                part = f(matrix(rows.column(0)), np.asarray(rows.column(1).to_pylist(), bool), *(c.to_numpy() for c in rows.columns[2:]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    rows = arrow_map(frame.select("x", "positive", *others), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


def fit(frame: DataFrame, prior: float | None = None) -> Model:
    """frame: (x, positive), all texts to learn from, positive where one is a trusted positive; prior None: mixture_prior(). Without positives or rows every score is one half."""

    def moments(x, positive):
        return np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    m = summed(frame, moments)
    if not len(m) or not m[1]:
        return Model(np.zeros(DIM), np.ones(DIM), np.zeros(DIM + 1), 0.5 if prior is None else prior)
    mean = m[2 : 2 + DIM] / m[0]
    scale = np.sqrt(np.maximum(m[2 + DIM :] / m[0] - mean**2, 0)) + 0.02
    if prior is None:
        prior = mixture_prior(frame, mean, scale)
    d = DIM + 1
    w = np.zeros(d)
    w[0] = math.log(prior / (1 - prior))
    for _ in range(ROUNDS):

        def terms(x, positive, w=w):
            z = design(x, mean, scale)
            f = z @ w
            s = _sigmoid(f)
            p, fp, sp = z[positive], f[positive], s[positive]
            return np.concatenate([[len(x), len(p), np.logaddexp(0, f).sum(), np.logaddexp(0, fp).sum(), np.logaddexp(0, -fp).sum()], s @ z, p.sum(axis=0), sp @ p, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        t = summed(frame, terms)
        nu, np_ = t[0], t[1]
        u_grad, p_sum, p_grad = t[5 : 5 + d] / nu, t[5 + d : 5 + 2 * d] / np_, t[5 + 2 * d : 5 + 3 * d] / np_
        curve = t[5 + 3 * d :].reshape(d, d) / nu + RIDGE * np.eye(d)
        negative_risk = t[2] / nu - prior * t[3] / np_
        negative_grad = u_grad - prior * p_grad
        if negative_risk >= 0:
            step = -np.linalg.solve(curve, -prior * (p_sum - p_grad) + negative_grad + RIDGE * w)
        else:
            step = 0.5 * np.linalg.solve(curve, negative_grad)
        size = float(np.linalg.norm(step))
        w = w + step * min(1.0, STEP / max(size, 1e-12))
        if size < 1e-3:
            break
    return Model(mean, scale, w, prior)


def estimate_prior(positives: int, labelled: int) -> float:
    """The class prior from the part of positives among rows labelled by chance, kept from 0 and 1; for callers that have such labels."""
    return min(max((positives + 1) / (labelled + 2), 0.02), 0.98)


#: Rounds and ridge of the fits of trusted positives against all texts, bins of their scores, and the chance that the bound of a bin's part doesn't hold.
SPLIT_ROUNDS, SPLIT_RIDGE, SCORE_BINS, DOUBT = 8, 0.1, 1000, 0.1


def mixture_prior(frame: DataFrame, mean: np.ndarray, scale: np.ndarray) -> float:
    """The class prior from trusted positives and unlabelled texts alone: the best bin of a score (Garg et al. 2021).

    Among the texts that score highest by a fit of positives against all texts hardly one is negative, so the part of all texts that is there, over the part of the positives that is, estimates the prior. The cut is where the upper bound of that ratio is smallest. Texts are in two folds (the column half, 0 or 1, if frame has it; else by their place), and each is scored by the fit to the other one, as a fit scores its own positives too high. Kept from 0 and 1.
    """
    if "half" not in frame.columns:
        frame = frame.withColumn("half", F.pmod(F.monotonically_increasing_id(), F.lit(2)))
    d = DIM + 1
    w = np.zeros((2, d))
    n = p = np.zeros(2)
    for _ in range(SPLIT_ROUNDS):

        def terms(x, positive, of, w=w):
            out = []
            for k in range(2):
                z, known = design(x[of == k], mean, scale), positive[of == k]
                s = _sigmoid(z @ w[k])
                bent = s * (1 - s)
                zp, sp, bp = z[known], s[known], bent[known]
                out += [[len(z), len(zp)], s @ z, (1 - sp) @ zp, ((z * bent[:, None]).T @ z).ravel(), ((zp * bp[:, None]).T @ zp).ravel()]
            return np.concatenate(out)

        t = summed(frame, terms, "half").reshape(2, -1)
        n, p = t[:, 0], t[:, 1]
        moved = 0.0
        for k in range(2):
            each_n, each_p = max(n[k], 1), max(p[k], 1)
            curves = t[k, 2 + 2 * d :].reshape(2, d, d)
            step = -np.linalg.solve(curves[0] / each_n + curves[1] / each_p + SPLIT_RIDGE * np.eye(d), t[k, 2 : 2 + d] / each_n - t[k, 2 + d : 2 + 2 * d] / each_p + SPLIT_RIDGE * w[k])
            size = float(np.linalg.norm(step))
            w[k] = w[k] + step * min(1.0, STEP / max(size, 1e-12))
            moved = max(moved, size)
        if moved < 1e-2:
            break

    def bins(x, positive, of):
        other = 1 - of
        at = np.minimum((_sigmoid((design(x, mean, scale) * w[other]).sum(axis=1)) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
        return np.concatenate([np.bincount(at, minlength=SCORE_BINS), np.bincount(at[positive], minlength=SCORE_BINS)]).astype(np.float64)

    seen = summed(frame, bins, "half").reshape(2, SCORE_BINS)[:, ::-1].cumsum(axis=1)
    u, q = seen[0] / n.sum(), seen[1] / p.sum()
    some = q > 0
    bound = math.sqrt(math.log(4 / DOUBT) / (2 * n.sum())) + math.sqrt(math.log(4 / DOUBT) / (2 * p.sum()))
    best = np.argmin((u[some] + 1.01 * bound) / q[some])
    return float(min(max(u[some][best] / q[some][best], 0.02), 0.98))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", learn: str | None = None, threshold: float = 0.7, prior: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of docs with score (0 to 1) and predicted (1 if score >= threshold, else 0); columns of docs that are named so are replaced, other names don't matter.

    Learns from the rows where the boolean column learn of docs is true (None: all). labels: (id_col, label), 1 for trusted positives; an id with both labels isn't trusted. Other labels aren't used: the prior, where it isn't given, is estimated from trusted positives and all texts to learn from. A score depends on the text alone, of whatever length. Null and empty texts are scored by their features, all zero; without trusted positives every score is one half. Rows with a null id are scored and unlabelled; repeated rows and equal texts are scored alike; no rows give no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    learned = F.lit(True) if learn is None else F.coalesce(named(learn), F.lit(False))
    frame = docs.select(packed(kept).alias("own"), named(id_col).alias("id"), learned.alias("learn"), named(text).alias("text"))
    table = materialise(with_features(frame, ["own", "id", "learn"], "text").select(*unpacked(["own", "id", "learn"]), "x"))
    model = fit_model(table.select("id", "learn", "x"), labels.select(named(id_col).alias("id"), named(label).alias("label")), prior)
    scored = predict(table.select(F.col("own").alias(KEPT), "x"), model, threshold)
    return scored.select(*unpacked(kept), "score", "predicted")


def fit_model(table: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """table: (id, learn, x); labels: (id, label)."""
    known = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("low"))
    learning = materialise(table.where("learn").join(known, "id", "left").select("x", (F.coalesce(F.col("low"), F.lit(0)) == 1).alias("positive"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")))
    return fit(learning, prior)


def predict(table: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """table (kept, x) as (kept, score, predicted)."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            score = shared.value.score(matrix(rows.column(1)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[KEPT, "score", "predicted"])

    return arrow_map(table.select(KEPT, "x"), run, StructType([table.schema[KEPT]]).add("score", DoubleType()).add("predicted", IntegerType()))
