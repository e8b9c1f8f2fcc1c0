"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits fall into b blocks. Two fingerprints that differ in at most d bits agree in at
least b - d blocks, so they share at least one choice of b - d blocks: each fingerprint is keyed by every
such choice, equal keys are joined, and the pairs' Hamming distance is verified. With d = 4 and b = 6
there are 15 keys of about 21 bits. Equal fingerprints are joined as one before.

A distance that stands for a similarity of shingles of 0.8 takes longer fingerprints, as that is 15 % of the
bits. near_copies() uses 256 bits, of several seeds, and splits them into 12 blocks in several orders of the
bits: in each order pairs of up to 11 bits share a block for certain, and over all orders pairs at a similarity
of 0.8 do so with a probability of 0.9, at 0.85 of 0.98, at 0.9 of 0.999. For the pairs that are lost so, 768 more
bits are made of each shingle's first hash, and 48 blocks of all 1024 bits are further keys: pairs that share any key
and differ in few of the 1024 bits are candidates, whose shingles are compared, and those that are similar by 0.8 or
more are linked too. All keys are first joined with the first 256 bits only, which links what they suffice for and says what
fingerprints have a partner near enough for candidates that these links of a task don't connect; only these go through the join
that carries all bits, under keys that fingerprints of several classes have. What meets by chance ends there, and so does a large
class of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, complete_groups, group_numbers, in_chunks, materialise, named, packed, same_group_pairs, spanning_forest, unpacked, word_blocks
from .components import connected_components

BITS = 64
#: Rows of a chunk of a frequent key.
CHUNK = 512
#: Links that a task holds before it reduces them to a spanning forest.
HELD = 1_000_000


#: Odd factors that further hashes are made of a hash with, the finaliser of splitmix64.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
    return bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(text: str | None, width: int, seeds: tuple[int, ...], more: int = 0) -> np.ndarray:
    """The SimHash of a whole text's word shingles with repeats, for each seed: a bit is set where more than half of the shingles' XXH64 have it. more: so many words follow, of hashes made of the first seed's.

    Fewer words than width are one shingle; null and texts without words have fingerprint zero.
    """
    ones, n = np.zeros((len(seeds) + more, BITS), np.int64), 0
    carried: list[bytes] = []

    def add(shingles: list[bytes]) -> None:
        first = None
        for k, seed in enumerate(seeds):
            hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), "<u8", len(shingles))
            first = hashes if first is None else first
            ones[k] += _bit_counts(hashes)
        for k in range(more):
            ones[len(seeds) + k] += _bit_counts(_mixed(first, k + 1))

    for block in word_blocks(text):
        words = carried + block
        carried = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        shingles = [joined[s:e] for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        n += len(shingles)
        add(shingles)
    if not n and carried:
        n = 1
        add([b" ".join(carried)])
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0] if n else np.zeros(len(seeds) + more, np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return int(fingerprints(text, width, (seed,))[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, seeds: tuple[int, ...] = (42,), more: int = 0) -> DataFrame:
    """(id, fp, fp1, ...): the words of each row's fingerprints, as signed longs. One pass without a shuffle."""
    frame = docs.select(named(id_col).alias("id"), named(text).alias("text"))
    names = columns(len(seeds) + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.array([fingerprints(x.as_py(), width, seeds, more) for x in rows.column(1)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(fps[:, k]) for k in range(len(names))]], names=["id", *names])

    return arrow_map(frame, run, f"id {frame.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


def columns(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """An array with a key for each choice of blocks - distance blocks: the choice's number and the bits of its blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return F.array(*[F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(signed(sum(masks[i] for i in chosen)))).alias("bits")) for k, chosen in enumerate(combinations(range(blocks), blocks - distance))])


def _linked(distance: int, words: int = 1, narrow: int = 0, plain_choices: int = 0):
    """Links rows of a key that differ in distance bits of their words at most. With narrow, the key is one long with its choice in the upper half, only choices below plain_choices link, and rows that differ in narrow bits at most from one that the links of their task don't connect with them are linked with themselves."""
    keys = ["key", "low", "high"] if narrow else ["choice", "bits", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        a, b, c, d = [nothing], [nothing], [nothing], [nothing]

        def out() -> pa.RecordBatch:
            u, v = spanning_forest(np.concatenate(a), np.concatenate(b))
            x, y = np.concatenate(c), np.concatenate(d)
            for part in (a, b, c, d):
                part[1:] = []
            if len(u):
                order = np.argsort(u)  # a node is at most once in u

                def root(of: np.ndarray) -> np.ndarray:
                    at = order[np.minimum(np.searchsorted(u[order], of), len(u) - 1)]
                    return np.where(u[at] == of, v[at], of)

                apart = root(x) != root(y)
                x, y = x[apart], y[apart]
            themselves = np.unique(np.concatenate([x, y]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, themselves])), pa.array(np.concatenate([v, themselves]))], names=["a", "b"])

        held = 0
        for rows in complete_groups(batches, keys):
            *key, low, high, own, node = (rows.column(c).to_numpy() for c in (*keys, "own", "node"))
            fps = [rows.column(c).to_numpy().view(np.uint64) for c in columns(words)]  # signed numbers would be counted by their absolute value
            for x, y in same_group_pairs(group_numbers(*key, low, high)):
                apart = sum(np.bitwise_count(fp[x] ^ fp[y]).astype(np.int16) for fp in fps)
                compared = (low[x] == high[x]) | (own[x] != own[y])
                meet = (apart <= distance) & compared
                if narrow:
                    meet &= key[0][x] >> 32 < plain_choices
                    some = ~meet & (apart <= narrow) & compared
                    if some.any():
                        c.append(node[x[some]])
                        d.append(node[y[some]])
                        held += len(c[-1])
                if meet.any():
                    a.append(node[x[meet]])
                    b.append(node[y[meet]])
                    held += len(a[-1])
                if held > HELD:
                    yield out()
                    held = 0
        if held:
            yield out()

    return run


def _candidates(words: int, narrow: int, more: int, distance: int):
    """The pairs of rows of a key that are of different components and differ in narrow bits of the first words and in distance bits of all words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x, y = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0).T
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        held = 0
        for rows in complete_groups(batches, ["choice", "bits", "low", "high"]):
            choice, bits, low, high, own, node, component = (rows.column(c).to_numpy() for c in ("choice", "bits", "low", "high", "own", "node", "component"))
            fps = [rows.column(c).to_numpy().view(np.uint64) for c in columns(words + more)]
            for x, y in same_group_pairs(group_numbers(choice, bits, low, high)):
                some = (component[x] != component[y]) & ((low[x] == high[x]) | (own[x] != own[y]))
                x, y = x[some], y[some]
                apart = sum(np.bitwise_count(fp[x] ^ fp[y]).astype(np.int16) for fp in fps[:words])
                # of all bits, these are few: pairs that are farther apart in them by a multiple are no pairs of all
                x, y, apart = x[apart <= narrow], y[apart <= narrow], apart[apart <= narrow]
                every = apart + sum(np.bitwise_count(fp[x] ^ fp[y]).astype(np.int16) for fp in fps[words:])
                if (every <= distance).any():
                    a.append(node[x[every <= distance]])
                    b.append(node[y[every <= distance]])
                    held += len(a[-1])
                if held > HELD:
                    yield out()
                    held = 0
        if held:
            yield out()

    return run


def links(distinct: DataFrame, distance: int = 4, blocks: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all nodes whose fingerprints differ in at most distance bits; distinct: (fp, node), both long.

    Of the links that a task finds it returns a spanning forest, so a group of near copies gives no more rows than it has members.
    """
    keyed = distinct.select("fp", "node", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key")).select("key.*", "fp", "node")
    dealt = in_chunks(keyed, ["choice", "bits"], chunk, "node").select("choice", "bits", "low", "high", "own", "fp", "node")
    ordered = dealt.repartition("choice", "bits", "low", "high").sortWithinPartitions("choice", "bits", "low", "high")
    return arrow_map(ordered, _linked(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row per row of docs: (id, fp, component); component is the smallest id whose text can be reached over fingerprints that differ in at most distance bits.

    Null texts and texts without words have fingerprint zero, which is linked like any other. Rows with a null id have a null component and link nothing. Repeated ids give repeated rows, each with the component of its own text. No rows give no rows; other columns of docs are not read.
    """
    prints = materialise(with_fingerprints(docs, id_col, text, width, (seed,)))
    distinct = materialise(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    return _with_components(prints, distinct, links(distinct, distance, blocks), ["fp"])


def _with_components(prints: DataFrame, distinct: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    components = materialise(connected_components(materialise(found)))
    classes = materialise(distinct.join(components, distinct["node"] == components["node"], "left").select(*names, F.coalesce("component", distinct["node"]).alias("component")))
    return prints.join(classes, names, "left").select("id", *names, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


#: near_copies: seeds, blocks of the fingerprint, orders of its bits, and the bits that copies may differ in: the 39 that a similarity of 0.8 stands for, and 1.6 standard deviations (5.7) for chance.
SEEDS, SPLIT, ORDERS, APART = (42, 43, 44, 45), 12, 6, 48


def order_keys(fps: np.ndarray, orders: int = ORDERS, split: int = SPLIT) -> np.ndarray:
    """The blocks of rows of fingerprint words (uint64), split in each order of the bits: rows x (orders * split)."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    out = []
    for k in range(orders):
        order = np.random.default_rng(k).permutation(bits.shape[1]) if k else np.arange(bits.shape[1])
        for block in np.array_split(order, split):
            out.append(bits[:, block].astype(np.int64) @ (1 << np.arange(len(block))))
    return np.stack(out, axis=1)


#: Further words of a fingerprint, blocks of all its bits, the bits of 1024 that candidates may differ in (155 at a similarity of 0.8, and 3 standard deviations (11.5) for chance), and those of the first 256 that such pairs stay below (39 and 5 of theirs).
MORE, MORE_SPLIT, MORE_APART, NARROW = 12, 48, 190, 68
#: Similarity of sets of shingles from which on a candidate is linked.
ALIKE = 0.8


def shingle_sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, fp, shingles): of each row the first word of its fingerprint and the sorted 64-bit hashes of its text's different word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                value = rows.column(1)[i].as_py()
                hashes: list[np.ndarray] = []
                carried: list[bytes] = []
                digests = lambda words, n: np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), seed=SEEDS[0]) for k in range(n)], np.uint64).view(np.int64)
                for block in word_blocks(value):
                    carried += block
                    if len(carried) >= width:
                        hashes.append(digests(carried, len(carried) - width + 1))
                        carried = carried[len(carried) - width + 1 :]
                if not hashes and carried:
                    hashes.append(digests(carried, 1))
                found = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.int64)
                fp = fingerprints(value, width, SEEDS[:1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, 1), pa.array(fp), pa.array([found], pa.list_(pa.int64()))], names=["id", "fp", "shingles"])

    frame = docs.select(named(id_col).alias("id"), named(text).alias("text"))
    return arrow_map(frame, run, f"id {frame.schema['id'].dataType.simpleString()}, fp long, shingles array<long>")


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text: str, width: int, alike: float = ALIKE) -> DataFrame:
    """The pairs (a, b) of nodes of distinct whose texts' sets of shingles are similar (Jaccard) by alike or more. Only texts that are in a pair are read into sets."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "fp"), "node"))
    sets = materialise(shingle_sets(docs.join(wanted.select(F.col("node").alias("__node")), named(id_col) == F.col("__node"), "left_semi"), id_col, text, width))
    # a repeated id may have several texts: one with a node's fingerprint counts
    sets = sets.join(wanted, (F.col("id") == F.col("node")) & (sets["fp"] == wanted["fp"])).select("node", "shingles").dropDuplicates(["node"])
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both >= F.lit(alike) * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _keyed(distinct: DataFrame, names: list[str], carried: list[str] | tuple[()] = ()) -> DataFrame:
    """(node, choice, bits, carried columns, of longs): a row for each block of each fingerprint, choices below ORDERS * SPLIT of its first words, the others of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 2000):
                some = rows.slice(at, 2000)
                fps = np.stack([some.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
                keys = np.concatenate([order_keys(fps[:, : len(SEEDS)]), order_keys(fps, 1, MORE_SPLIT)], axis=1)
                n, k = keys.shape
                again = [pa.array(np.repeat(some.column(c).to_numpy(), k)) for c in ("node", *carried)]
                yield pa.RecordBatch.from_arrays([again[0], pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(keys.ravel()), *again[1:]], names=["node", "choice", "bits", *carried])

    return arrow_map(distinct.select("node", *names, *(c for c in carried if c not in names)), run, ", ".join(["node long, choice int, bits long", *(f"{c} long" for c in carried)]))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, apart: int = APART, chunk: int = CHUNK) -> DataFrame:
    """As near_duplicates, but for texts whose word shingles are similar by 0.8 or more.

    Linked are fingerprints of 256 bits that differ in at most apart bits and share a block in one of the orders, and texts whose fingerprints of 1024 bits share any block and differ in at most MORE_APART, if their sets of shingles are similar by ALIKE or more.
    """
    names = columns(len(SEEDS) + MORE)
    prints = materialise(with_fingerprints(docs, id_col, text, width, SEEDS, MORE))
    distinct = materialise(prints.where("id is not null").groupBy(*names).agg(F.min("id").alias("node")))

    first = names[: len(SEEDS)]
    order = ["key", "low", "high"]
    sent = in_chunks(_keyed(distinct, names, first).withColumn("key", F.shiftleft(F.col("choice").cast("long"), 32) + F.col("bits")).drop("choice", "bits"), ["key"], chunk, "node")
    found = materialise(arrow_map(sent.select(*order, "own", "node", *first).repartition(*order).sortWithinPartitions(*order), _linked(apart, len(SEEDS), NARROW, ORDERS * SPLIT), "a long, b long"))
    sure = materialise(connected_components(found))
    # a class is done with by now: what may link it with another is all that goes on, and only under keys that several classes have
    open_ = found.where("a = b").select(F.col("a").alias("node")).distinct()
    near = materialise(distinct.join(open_, "node", "left_semi").join(sure, "node", "left").select("node", *names, F.coalesce("component", "node").alias("component")))
    keyed = _keyed(near, names, ["component"])
    key = ["choice", "bits", "low", "high"]
    dealt = in_chunks(keyed, ["choice", "bits"], chunk, "node", differing="component").join(near.select("node", *names), "node").select(*key, "own", "component", *names, "node")
    pairs = arrow_map(dealt.repartition(*key).sortWithinPartitions(*key), _candidates(len(SEEDS), NARROW, MORE, MORE_APART), "a long, b long")
    more = verified(materialise(pairs.distinct()), distinct, docs, id_col, text, width)
    return _with_components(prints, distinct, sure.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), names)


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that are near copies of another: of each class that near_copies() finds, the row with the smallest id stays (null is larger than all), of equal ids one.

    Rows are told apart by a number of their own, so rows that repeat an id with other texts are decided separately, and rows with a null id are compared as well. Null and empty texts are a class. Columns of docs may have any name. The texts are written once and shuffled only if the rows to remove are too many to broadcast.
    """
    numbered = materialise(docs.select(packed(docs.columns), F.monotonically_increasing_id().alias("row"), named(id_col).alias("id")))
    texts = numbered.select("row", unpacked(docs.columns)[docs.columns.index(text)].alias("text"))
    classes = near_copies(texts, "row").select(F.col("id").alias("row"), "component")
    ordered = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    several = materialise(classes.join(numbered.select("row", "id"), "row"))
    stays = several.groupBy("component").agg(F.min(ordered).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", F.col("first.row").alias("stays"))
    goes = materialise(several.join(stays, "component").where("row != stays").select("row"))
    return numbered.join(goes, "row", "left_anti").select(*unpacked(docs.columns))
