"""Embedding near-dedup by spherical-cap filters with random product codes.

After a random rotation, a vector falls into blocks; each block has a small random code, and every choice
of one code word for each block is a filter direction (Becker, Ducas, Gama, Laarhoven 2016). A vector is
list-decoded to all filters whose direction it exceeds the cap's height with: the sums of the first and of the
second half of the blocks are formed, one half is sorted, and for each sum of the other the sums that reach
the height are read off, so that no filter below it is visited. Vectors are joined on equal filters within a
label, and pairs are verified by their cosine in double precision.

Equal vectors of a label are one class with a number of rows before they are decoded, so copies cost no more
than one vector. The join on filters is done twice: first with 128 signs of random products in place of the vectors,
which says what classes may have a partner at all; only these go through the join that carries vectors. A pair at the
threshold differs in more signs than that join allows with a probability below LOST. More vectors in a label take
more code words and a higher cap, so that the partners that a vector meets by chance do not grow with the table.

A pair that shares several filters is counted in the smallest only. Frequent filters are cut into chunks whose
pairs of chunks are compared in separate tasks. Each task sends the number of links of each vector and a
spanning forest of the links, so a group of near copies gives no more rows than it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_map, complete_groups, group_numbers, in_chunks, materialise, named, promising, same_group_pairs, spanning_forest
from .components import connected_components

#: Blocks of a code and the least code words of a block: words ** BLOCKS filters.
BLOCKS, WORDS = 4, 16
#: Vectors of a label that the least code words serve; each doubling of the words serves 16 times as many.
SERVED = 1 << 18
#: Signs of random products that stand for a vector, and the probability of losing a pair at the threshold by them.
SIGNS, LOST = 128, 1e-8
#: The cap's height in standard deviations of a random vector's product with a filter; the best filters that a vector gets at least.
HEIGHT, LEAST = 3.4, 20
MORE_LEAST = 8
CHUNK = 512
#: Groups of fewer rows are compared pair by pair, larger ones by matrix products.
SMALL = 40


@dataclass
class Codes:
    """A rotation and the blocks' code words, for vectors of dim components."""

    rotation: np.ndarray
    words: np.ndarray
    height: float
    least: int

    @staticmethod
    def make(dim: int, blocks: int = BLOCKS, words: int = WORDS, height: float = HEIGHT, least: int = LEAST, seed: int = 20) -> Codes:
        rng = np.random.default_rng([seed, dim])
        width = -(-dim // blocks)
        rotation = np.linalg.qr(rng.standard_normal((width * blocks, width * blocks)))[0][:dim]
        code = rng.standard_normal((blocks, words, width))
        code /= np.linalg.norm(code, axis=2, keepdims=True) * np.sqrt(blocks)
        return Codes(rotation, code, height / np.sqrt(width * blocks), least)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each row of x (of length one): all that it exceeds the height with, and the best few if those are fewer."""
        blocks, words, width = self.words.shape
        scores = np.einsum("nbw,bcw->nbc", (x @ self.rotation).reshape(len(x), blocks, width), self.words)
        half = blocks // 2

        def sums(part: np.ndarray) -> np.ndarray:
            total = part[:, 0]
            for j in range(1, part.shape[1]):
                total = (total[:, :, None] + part[:, j, None, :]).reshape(len(part), -1)
            return total

        left, right = sums(scores[:, :half]), sums(scores[:, half:])
        order = np.argsort(-right, axis=1, kind="stable")
        right = np.take_along_axis(right, order, 1)
        n_right = right.shape[1]
        out = []
        for i in range(len(x)):
            at = self.height
            while True:
                rows = np.flatnonzero(left[i] + right[i, 0] >= at)
                reach = np.searchsorted(-right[i], left[i, rows] - at, side="right")
                if reach.sum() >= self.least or at < -1:
                    break
                at -= 0.05  # too few: the best of a lower cap
            found = np.repeat(rows, reach) * n_right + np.concatenate([order[i, :k] for k in reach.tolist()]) if len(rows) else np.zeros(0, np.int64)
            if at < self.height and len(found) > self.least:
                value = np.concatenate([left[i, r] + right[i, :k] for r, k in zip(rows.tolist(), reach.tolist(), strict=True)])
                found = found[np.lexsort((found, -value))[: self.least]]
            out.append(np.sort(found))
        return out


def code_size(rows: int) -> tuple[int, float, int]:
    """(code words of a block, height, least filters) for so many vectors of a label: filters grow as fast as a vector's chance to reach one falls. The best filters of higher caps are shared less often, so a vector gets MORE_LEAST more with each doubling, which keeps the recall."""
    words, served, height, least = WORDS, SERVED, HEIGHT, LEAST
    while rows > served:
        words, served, least = 2 * words, served << BLOCKS, least + MORE_LEAST
        height = -NormalDist().inv_cdf(NormalDist().cdf(-height) / (1 << BLOCKS))
    return words, height, least


def signs_apart(threshold: float) -> int:
    """Signs that two vectors at the threshold differ in at most, but for a probability of LOST."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    tail = 1.0
    for k in range(SIGNS):
        tail -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        if tail < LOST:
            return k
    return SIGNS


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one; None for null, zero, and vectors with components that are null or not finite."""
    out: list[np.ndarray | None] = []
    for value in column:
        if not value.is_valid or not len(value.values) or value.values.null_count:
            out.append(None)
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max()
            out.append(None if not np.isfinite(top) or top == 0 else (x / top) / np.linalg.norm(x / top))
    return out


def unit_vectors(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, v, digest): v holds the components, as floats if they are floats, else as doubles of a vector of length one; digest is null for rows that link with nothing."""
    frame = vectors.select(named(id_col).cast("long").alias("id"), named(label).alias("label"), named(vector).alias("v"))
    short = components_type(vectors, vector) == "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = _vectors(rows.column(2))
            components = [b"" if x is None else rows.column(2)[i].values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() if short else x.tobytes() for i, x in enumerate(found)]
            dims = pa.array([0 if x is None else len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], dims, pa.array(components, pa.binary())], names=["id", "label", "dim", "v"])

    out = arrow_map(frame, run, f"id long, label {frame.schema['label'].dataType.simpleString()}, dim int, v binary")
    return out.withColumn("digest", F.when((F.col("dim") > 0) & F.col("id").isNotNull() & F.col("label").isNotNull(), F.unhex(F.sha2("v", 256))))


def with_filters(classes: DataFrame, kind: str, words: int = WORDS, height: float = HEIGHT, least: int = LEAST) -> DataFrame:
    """classes, which have dim and v of type kind as unit_vectors() gives them, with filters and the signs s0 and s1 of each. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, tuple[Codes, np.ndarray]] = {}
        for rows in batches:
            for start in range(0, rows.num_rows, 2000):
                some = rows.slice(start, 2000)
                dims, data = some.column("dim").to_numpy(), some.column("v")
                filters: list[np.ndarray] = [np.zeros(0, np.int32)] * some.num_rows
                signs = np.zeros((some.num_rows, SIGNS // 64), np.int64)
                for dim in np.unique(dims).tolist():
                    if dim not in codes:
                        codes[dim] = Codes.make(dim, words=words, height=height, least=least), np.random.default_rng([21, dim]).standard_normal((dim, SIGNS))
                    at = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(data.take(pa.array(at)).to_pylist()), kind).reshape(len(at), dim).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    signs[at] = np.packbits(x @ codes[dim][1] > 0, axis=1, bitorder="little").view("<i8")
                    for i, f in zip(at.tolist(), codes[dim][0].decode(x), strict=True):
                        filters[i] = f.astype(np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(filters, pa.list_(pa.int32())), *[pa.array(np.ascontiguousarray(c)) for c in signs.T]], names=[*some.schema.names, "filters", "s0", "s1"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return arrow_map(classes, run, f"{fields}, filters array<int>, s0 long, s1 long")


def components_type(vectors: DataFrame, vector: str) -> str:
    """How the components are kept: floats as they are, other numbers as doubles."""
    return "<f4" if vectors.schema[vector].dataType.elementType == FloatType() else "<f8"


def _verified(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, ["key", "low", "high"], 20_000):
            key, low, high, own, row, n_rows, label, dims, filter_ = (rows.column(c).to_numpy() for c in ("key", "low", "high", "own", "row", "n", "label", "dim", "filter"))
            lists = rows.column("filters").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            data = rows.column("v").combine_chunks()
            numbers: list[np.ndarray] = []
            weights: list[np.ndarray] = []
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []

            def link(x: np.ndarray, y: np.ndarray) -> None:
                numbers.extend((row[x], row[y]))
                weights.extend((n_rows[y], n_rows[x]))
                u, v = spanning_forest(row[x], row[y])
                a.append(u)
                b.append(v)

            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = np.frombuffer(b"".join(data.take(pa.array(at)).to_pylist()), kind).reshape(len(at), dim).astype(np.float64)
                vectors /= np.abs(vectors).max(axis=1, keepdims=True)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                group = group_numbers(key[at], low[at], high[at], label[at], filter_[at])  # a hash may be that of several keys
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                sizes = np.diff(np.append(starts, len(at)))
                little = np.repeat(sizes < SMALL, sizes)
                small = np.flatnonzero(little)
                seen: dict[int, frozenset] = {}
                for x, y in same_group_pairs(group[small]):
                    x, y = small[x], small[y]
                    near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
                    x, y = at[x[near]], at[y[near]]
                    keep = (low[x] == high[x]) | (own[x] != own[y])
                    x, y = x[keep], y[keep]
                    first = np.ones(len(x), bool)
                    for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                        for z in (p, q):
                            if z not in seen:
                                seen[z] = frozenset(flat[offsets[z] : offsets[z + 1]].tolist())
                        first[i] = min(seen[p] & seen[q]) == filter_[p]
                    if first.any():
                        link(x[first], y[first])
                for s, n in zip(starts[sizes >= SMALL].tolist(), sizes[sizes >= SMALL].tolist(), strict=True):
                    g = at[s : s + n]
                    if low[g[0]] == high[g[0]]:
                        one = two = np.arange(n)
                    else:
                        one, two = np.flatnonzero(own[g] == low[g[0]]), np.flatnonzero(own[g] == high[g[0]])
                    if not len(one) or not len(two):
                        continue
                    near = vectors[s + one] @ vectors[s + two].T >= threshold
                    if one is two:
                        near &= np.arange(n)[:, None] < np.arange(n)[None, :]
                    if not near.any():
                        continue
                    # pairs that share a smaller filter are counted there
                    smaller = [flat[offsets[z] : offsets[z + 1]] for z in g]
                    smaller = [f[f < filter_[g[0]]] for f in smaller]
                    names, place = np.unique(np.concatenate(smaller), return_inverse=True)
                    has = np.zeros((n, len(names)), np.float32)
                    has[np.repeat(np.arange(n), list(map(len, smaller))), place] = 1
                    near &= (has[one] @ has[two].T) == 0
                    x, y = np.nonzero(near)
                    if len(x):
                        link(g[one[x]], g[two[y]])
            if numbers:
                ids, place = np.unique(np.concatenate(numbers), return_inverse=True)
                counts = np.zeros(len(ids), np.int64)
                np.add.at(counts, place, np.concatenate(weights))
                u, v = spanning_forest(np.concatenate(a), np.concatenate(b))
                nothing = pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64()), nothing(len(ids), pa.int64()), nothing(len(ids), pa.int64())], names=["row", "n", "a", "b"])
                yield pa.RecordBatch.from_arrays([nothing(len(u), pa.int64()), nothing(len(u), pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["row", "n", "a", "b"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """One row per row of vectors: (id, n_links, component, kept).

    Two rows link if their labels are equal, their vectors have as many components and a cosine of threshold or more, and they share a filter, which rows that near almost always do; equal vectors always link. n_links: other rows linked; component: the smallest id that links reach; kept: id = component. Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label or id is null, link with nothing (component: their id; kept is null for a null id). Rows that repeat an id are vectors of their own that share a component if they link. ids are long. No rows give no rows.
    """
    kind = components_type(vectors, vector)
    rows = materialise(unit_vectors(vectors, id_col, vector, label))
    usable = rows.where("digest is not null")
    most = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    folded = usable.groupBy("label", "dim", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = materialise(with_filters(folded.withColumn("row", F.monotonically_increasing_id()), kind, *code_size(most)))

    keyed = classes.select(F.explode("filters").alias("filter"), "label", "dim", "row", "s0", "s1").select(F.xxhash64("label", "dim", "filter").alias("key"), "row", "s0", "s1")
    dealt = in_chunks(keyed, ["key"], chunk, "row").select("key", "low", "high", "own", "row", "s0", "s1")
    order = ["key", "low", "high"]
    some = arrow_map(dealt.repartition(*order).sortWithinPartitions(*order), promising("row", ["s0", "s1"], signs_apart(threshold)), "row long")
    near = materialise(classes.join(materialise(some.distinct()), "row", "left_semi").select("row", "label", "dim", "v", "n", "filters"))

    keys = ["label", "dim", "filter"]
    dealt = in_chunks(near.select("label", "dim", F.explode("filters").alias("filter"), "row", "n", "v", "filters"), keys, chunk, "row").withColumn("key", F.xxhash64(*keys))
    ordered = dealt.repartition(*order).sortWithinPartitions(*order, *keys).select(*order, "own", "row", "n", *keys, "v", "filters")
    found = materialise(arrow_map(ordered, _verified(threshold, kind), "row long, n long, a long, b long"))

    counts = found.where("row is not null").groupBy("row").agg(F.sum("n").alias("links"))
    reached = materialise(connected_components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "row").join(classes.select("row", "id"), "row"))
    smallest = reached.groupBy("component").agg(F.min("id").alias("smallest"))
    of_class = (
        classes.select("label", F.unhex(F.sha2("v", 256)).alias("digest"), "row", "id", "n")
        .join(counts, "row", "left")
        .join(reached.join(smallest, "component").select("row", "smallest"), "row", "left")
        .select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "id").alias("component"))
    )
    out = rows.select("id", "label", "digest").join(materialise(of_class), ["label", "digest"], "left")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")).withColumn("kept", F.col("component") == F.col("id"))
