"""Language-model scoring with a hidden Markov model over word classes.

A text is the sequence of its words and one end. Every token has a class: the end and the most frequent
words have one each, all other words share a fixed number of classes by a hash. The model is
    P(text) = sum over state paths of  prod_t A[s_t-1, s_t] E[s_t, class_t] * prod_t p(token_t | class_t),
where p(w | class) = (c(w) + 0.5) / (C + 0.5 (V + 1)) in a shared class with C training tokens of V words,
all unseen words counting as one, and 1 in a class of one token. The likelihood is exact: the scaled forward
recursion runs over the whole text.

Word counts cover all training tokens. They are joined with the texts' words by a shuffle, but for the most
frequent words, a table of bounded size that is broadcast. Baum-Welch runs over all training texts, dealt by
a hash to a fixed number of parts, as incremental EM (Neal and Hinton 1998): a step runs forward-backward over
the segments of one part's texts, adds the expected counts up across partitions, puts them in the place of
those that this part gave before, and makes the model of the sum over all parts. So the model learns with every
part, each round sees every text once, and the driver holds parts * states * classes numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from .common import KEPT, arrow_map, materialise, named, packed, shared_dir, unpacked, word_blocks

STATES = 8
#: Classes of one token (the end is 0), shared classes, words in the broadcast table, and the bytes of a word in it at most.
OWN, SHARED, FREQUENT, LONGEST = 3072, 1024, 65_536, 64
#: Parts of the training texts; rounds over all of them; tokens of a segment in training.
PARTS, ROUNDS, SEGMENT = 8, 4, 512
#: Tokens of the class distribution that each state's counts are mixed with.
SMOOTHING = 500.0
#: Distinct words that a task counts before it sends them on; cells of a padded block of sequences.
HELD, CELLS = 300_000, 1_000_000
#: Bins of word counts for each doubling; words of the bins that fit whole go into the table.
BINS = 64
#: Stands for the end; no word holds a blank.
END = b"\n"
LN10 = float(np.log(10.0))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word binary, c) over all tokens of the column text, each text with one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return made

        for rows in batches:
            counts[END] += rows.num_rows
            for value in rows.column(0):
                for words in word_blocks(value.as_py()):
                    counts.update(words)
                    if len(counts) > HELD:
                        yield out()
        if counts:
            yield out()

    return arrow_map(texts.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass
class Vocabulary:
    """What every task knows of the words: bounded in size."""

    n: int
    v: int
    frequent: dict[bytes, tuple[int, int]]  # word: class, count
    shared_mass: np.ndarray  # C + 0.5 (V + 1) of each shared class
    class_share: np.ndarray  # each class's part of the tokens, none zero
    end_count: int
    own: int
    shared: int

    def shared_class(self, word: bytes) -> int:
        return self.own + zlib.crc32(word) % self.shared


def vocabulary(counts: DataFrame, own: int = OWN, shared: int = SHARED, frequent: int = FREQUENT) -> Vocabulary:
    """counts: (word, c), materialised."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END)))
    # a sorted limit would send so many rows from every task; with the sizes of bins of counts, only the words wanted are sent
    binned = short.withColumn("bin", F.floor(F.log2("c") * BINS).cast("int"))
    chosen, least = 0, None
    for r in sorted(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 64 * BINS rows at most
        if chosen + r.n > frequent:
            break
        chosen, least = chosen + r.n, r.bin
    top = [] if least is None else sorted(binned.where(F.col("bin") >= least).select("word", "c").collect(), key=lambda r: (-r.c, bytes(r.word)))
    single = [bytes(r.word) for r in top[: own - 1]]
    words = {w: (i + 1, r.c) for i, (w, r) in enumerate(zip(single, top, strict=False))}
    words |= {bytes(r.word): (own + zlib.crc32(r.word) % shared, r.c) for r in top[own - 1 :]}
    by_class = counts.groupBy(F.pmod(F.crc32("word"), F.lit(shared)).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    c, v = np.zeros(shared), np.zeros(shared)
    for r in by_class:
        c[r.k], v[r.k] = r.c, r.v
    end = counts.where(F.col("word") == F.lit(END)).first()
    for w, n in [*((w, words[w][1]) for w in single), (END, end.c if end else 0)]:
        if n:
            c[zlib.crc32(w) % shared] -= n
            v[zlib.crc32(w) % shared] -= 1
    share = np.full(own + shared, 0.5)
    share[0] += end.c if end else 0
    for w in single:
        share[words[w][0]] += words[w][1]
    share[own:] += c
    return Vocabulary(total.n or 0, total.v or 0, words, c + 0.5 * (v + 1), share / share.sum(), end.c if end else 0, own, shared)


def read_documents(docs: DataFrame, vocab: Vocabulary, id_col: str, text: str, keep: list[str]) -> DataFrame:
    """One row per row of docs: row, id, kept (a struct of keep), n_tokens, n_known, base, inner (both without log10(c + 0.5) of the words listed), words and times (those not in the table and how often), classes (uint16 of each token)."""
    frame = docs.select(named(id_col).alias("id"), packed(keep), named(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        words_of = list(vocab.frequent)
        number = {w: i + 1 for i, w in enumerate(words_of)}  # 0: not in the table
        classes = np.array([0, *(vocab.frequent[w][0] for w in words_of)], np.int64)
        logs = np.log10(np.array([0.0, *(vocab.frequent[w][1] for w in words_of)]) + 0.5)
        den = float(np.log10(vocab.n + 0.5 * (vocab.v + 1)))
        mass = np.log10(vocab.shared_mass)
        row = TaskContext.get().partitionId() << 33
        known = number.get
        for rows in batches:
            out: list[list] = [[] for _ in range(8)]
            for value in rows.column(rows.num_columns - 1):
                n = n_known = 0
                base = inner = 0.0
                rare: Counter = Counter()
                seen: list[np.ndarray] = []
                for words in word_blocks(value.as_py()):
                    numbers = np.array([known(w, 0) for w in words], np.int64)
                    new = np.flatnonzero(numbers == 0)
                    k = classes[numbers]
                    if len(new):
                        other = [words[i] for i in new.tolist()]
                        rare.update(other)
                        k[new] = [vocab.shared_class(w) for w in other]
                    n += len(words)
                    n_known += len(words) - len(new)
                    log = logs[numbers]
                    log[new] = 0
                    base += float(log.sum())
                    in_shared = k >= vocab.own
                    inner += float(log[in_shared].sum() - mass[k[in_shared] - vocab.own].sum())
                    seen.append(k.astype("<u2"))
                seen.append(np.zeros(1, "<u2"))
                n += 1
                base += float(np.log10(vocab.end_count + 0.5)) - n * den
                for column, x in zip(out, (row, n, n_known + (vocab.end_count > 0), base, inner, list(rare.keys()), list(rare.values()), np.concatenate(seen).tobytes()), strict=True):
                    column.append(x)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
            made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=[*rows.schema.names[:-1], "row", "n_tokens", "n_known", "base", "inner", "words", "times", "classes"])

    schema = StructType(frame.schema.fields[:-1]).add("row", LongType())
    for c, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("base", DoubleType()), ("inner", DoubleType()), ("words", ArrayType(BinaryType())), ("times", ArrayType(LongType())), ("classes", BinaryType())):
        schema = schema.add(c, kind)
    return arrow_map(frame, run, schema)


@dataclass
class Model:
    start: np.ndarray  # K
    middle: np.ndarray  # K, of a segment's first state in training
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences as padded blocks, longest first: (their numbers, tokens by time and sequence, how many are that long at each time)."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        t = int(lengths[order[at]])
        some = order[at : at + max(1, min(4096, CELLS // max(t, 1)))]
        at += len(some)
        tokens = np.zeros((t, len(some)), np.int64)
        for j, i in enumerate(some):
            tokens[: lengths[i], j] = sequences[i]
        active = len(some) - np.searchsorted(lengths[some][::-1], np.arange(t), side="right")
        yield some, tokens, active


def log_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of each whole sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for some, tokens, active in blocks(sequences):
        total = np.zeros(len(some))
        a = model.start * model.emit[tokens[0]]
        for t in range(len(tokens)):
            n = active[t]
            if t:
                a = (a[:n] @ model.move) * model.emit[tokens[t, :n]]
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:n] += np.log(c)
        out[some] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Expected counts by forward-backward, flat: log likelihood, starts, first states of other segments, moves, emissions (classes x K). first: which sequences begin a text."""
    k = len(model.start)
    size = len(model.emit)
    log, starts, middles, moves, emits = 0.0, np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    for some, tokens, active in blocks(sequences):
        steps, n = tokens.shape
        seen = model.emit[tokens]
        a = np.empty((steps, n, k))
        c = np.ones((steps, n))
        a[0] = np.where(first[some][:, None], model.start, model.middle) * seen[0]
        for t in range(steps):
            m = active[t]
            if t:
                np.matmul(a[t - 1, :m], model.move, out=a[t, :m])
                a[t, :m] *= seen[t, :m]
            c[t, :m] = a[t, :m].sum(axis=1)
            a[t, :m] /= c[t, :m, None]
        log += float(np.log(c).sum())
        b = np.ones((n, k))
        raw = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                m = active[t + 1]
                ahead = seen[t + 1, :m] * b[:m] / c[t + 1, :m, None]
                raw += a[t, :m].T @ ahead
                b[:m] = ahead @ model.move.T
            a[t, : active[t]] *= b[: active[t]]  # now the states' probabilities
        moves += raw * model.move
        starts += a[0][first[some]].sum(axis=0)
        middles += a[0][~first[some]].sum(axis=0)
        there = np.arange(n)[None, :] < active[:, None]
        flat = tokens[there]
        states = a[there]
        for i in range(k):
            emits[i] += np.bincount(flat, weights=states[:, i], minlength=size)
    return np.concatenate([[log], starts, middles, moves.ravel(), emits.T.ravel()])


def maximised(counts: np.ndarray, k: int, share: np.ndarray) -> Model:
    """The model of these expected counts; each state's classes are mixed with all tokens' classes."""
    starts, middles, moves, emits = np.split(counts[1:], np.cumsum([k, k, k * k]))
    emits = emits.reshape(-1, k)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Model(norm(starts + 0.1), norm(middles + starts + 0.1), norm(moves.reshape(k, k) + 0.1), (emits + SMOOTHING * share[:, None]) / (emits.sum(axis=0) + SMOOTHING))


def segments(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    out, first = [], []
    for x in data:
        tokens = np.frombuffer(x, "<u2")
        for at in range(0, len(tokens), SEGMENT):
            out.append(tokens[at : at + SEGMENT])
            first.append(at == 0)
    return out, np.array(first, bool)


def initial(share: np.ndarray, k: int) -> Model:
    rng = np.random.default_rng(0)
    emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), k))
    move = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    flat = np.full(k, 1 / k)
    return Model(flat, flat, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(texts: DataFrame, share: np.ndarray, k: int = STATES, rounds: int = ROUNDS, parts: int = PARTS) -> Model:
    """Baum-Welch over all rows of texts (id, classes binary), in so many rounds and parts. The part of a text is a hash of both columns, so copies are spread. Without rows the model is the initial one."""
    model = initial(share, k)
    spark = texts.sparkSession
    path = shared_dir(spark)
    texts.select("classes", F.pmod(F.xxhash64("id", "classes"), F.lit(parts)).cast("int").alias("part")).write.partitionBy("part").parquet(path)
    dealt = spark.read.schema("classes binary, part int").parquet(path)
    held: dict[int, np.ndarray] = {}
    for step in range(rounds * parts):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for rows in batches:
                for at in range(0, rows.num_rows, 500):
                    sequences, first = segments(rows.column(0).slice(at, 500).to_pylist())
                    part = expected_counts(shared.value, sequences, first)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        got = arrow_map(dealt.where(F.col("part") == step % parts).select("classes"), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        shared.destroy()
        if len(got):
            counts = np.zeros(len(got))
            counts[got.i.to_numpy()] = got.v.to_numpy()
            held[step % parts] = counts
            model = maximised(np.sum(list(held.values()), axis=0), k, share)
    return model


RESULTS = ("id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: str | None = None, keep: list[str] | None = None, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, shared: int = SHARED, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: (id, keep, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows where the boolean column held_out is false or null (None: from all). n_known: tokens that training texts have; train_tokens: all of theirs; base_score: the sum of log10 of the tokens' smoothed frequencies; score: log10 of the model's probability of the whole text. Null and empty texts are one end. Very long texts are scored whole. Repeated rows are scored alike; null ids are scored; without training texts all counts are zero and the model is uniform over them. No rows give no rows. Columns of keep that have the name of a result are left out; other names don't matter.
    """
    keep = [c for c in keep or [] if c not in RESULTS]
    learned = F.lit(True) if held_out is None else ~F.coalesce(named(held_out), F.lit(False))
    counts = materialise(count_tokens(docs.where(learned).select(named(text).alias("text"))))
    vocab = vocabulary(counts, own, shared, frequent)
    kept = docs.select(named(id_col).alias("id"), packed(keep).alias("own"), learned.alias("learn"), named(text).alias("text"))
    rows = materialise(read_documents(kept, vocab, "id", "text", ["own", "learn"]).withColumn("learn", unpacked(["own", "learn"])[1]).withColumn(KEPT, unpacked(["own"])[0]))
    model = train(rows.where("learn"), vocab.class_share, states, rounds)

    # the words that aren't in the table, with their counts
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    looked_up = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by_row = looked_up.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("known"))

    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = rows.select("id", KEPT, "row", "n_tokens", "n_known", "base", "inner", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            path = np.zeros(got.num_rows)
            for at in range(0, got.num_rows, 1000):
                sequences = [np.frombuffer(x, "<u2") for x in got.column(got.num_columns - 1).slice(at, 1000).to_pylist()]
                path[at : at + 1000] = log_likelihood(sent.value, sequences) / LN10
            yield pa.RecordBatch.from_arrays([*got.columns[:-1], pa.array(path)], names=[*got.schema.names[:-1], "path"])

    scored = arrow_map(plain, run, StructType(plain.schema.fields[:-1]).add("path", DoubleType()))
    log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(by_row, "row", "left").select(
        "id", *unpacked(keep), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("path") + F.col("inner") + log).alias("score")
    )
