"""Sharding by vector bin packing: groups of equal texts are placed so that bytes, tokens and rows balance jointly.

Packing every group one by one on one machine doesn't scale, so groups are packed through cells: a group
that weighs more than 1/pieces of a shard in any dimension is a cell of its own; every other group goes to
one of a fixed number of cells by a hash of its text. A group that weighs more than a whole shard in some
dimension is cut, as it fits none: by a hash of the row's id, into as few pieces as fit. Lighter ones are
cut only where the shards can't be balanced with them whole, to halves of a shard, quarters and so on. The cells' vectors, a bounded number of rows, are packed on the driver: largest first,
each into the shard where the dot product of its vector and the residual capacity is highest. Of shards
that have no room left in some dimension the residual is negative there, which steers cells away from them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Cells of the small groups for each shard. The driver holds so many rows times shards, and those of the large groups.
CELLS = 512
#: A group heavier than this part of a shard is a cell of its own; there are fewer such groups than 3 * shards * PIECES.
PIECES = 16
#: Shards whose bytes, tokens and rows are all within this many times the mean are balanced.
BALANCED = 1.02


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (cells x dimensions, not negative): the largest first, each where its dot product with the residual capacity is highest; of equals the first shard."""
    total = vectors.sum(axis=0, dtype=np.float64)
    share = vectors / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, vectors.shape[1]))
    placed = np.zeros(len(vectors), np.int64)
    order = np.argsort(-share.max(axis=1), kind="stable")
    for i in order:
        best = int(np.argmax(residual @ share[i]))
        placed[i] = best
        residual[best] -= share[i]
    return placed


def cuts(small: np.ndarray, heavy: np.ndarray, weights: np.ndarray, shards: int, pieces: int) -> np.ndarray:
    """In how many pieces each heavy group (sizes, tokens, rows; weight in 1/pieces of a shard) is cut: the fewest with which the shards are balanced, or as well as with any."""
    tried = []
    part = 1
    while True:
        parts = np.minimum(np.ceil(weights * part / pieces), heavy[:, 2]).astype(np.int64)
        vectors = np.concatenate([small, np.repeat(heavy / parts[:, None], parts, axis=0)])
        loads = np.zeros((shards, 3))
        np.add.at(loads, pack(vectors, shards), vectors)
        tried.append((float((loads.max(axis=0) / np.maximum(loads.mean(axis=0), 1e-9)).max()), parts))
        if tried[-1][0] <= BALANCED or part >= pieces:
            break
        part = min(2 * part, pieces)
    best = min(worst for worst, _ in tried)
    return next(parts for worst, parts in tried if worst <= max(BALANCED, best * 1.005))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", row_bytes: int = 8, cells: int = CELLS, pieces: int = PIECES) -> DataFrame:
    """One row per row of docs: (id, size, text_crc32, tokens, cell, shard, slot).

    size: bytes of the text in UTF-8 (null: none) plus row_bytes; text_crc32: of these bytes (null: 0); tokens: its words; slot: without gaps from 0 in each shard. Equal texts (null is a text of its own) share a shard, but groups larger than a shard's fair share of the bytes, tokens or rows, which fit none, and those with which whole the shards can't be balanced. Repeated ids and null ids keep their rows. No rows give no rows; other columns of docs aren't read.
    Rows, bytes and tokens of the shards are near equal, as the largest cells are placed first and the small ones fill what is left, but for single rows that exceed a shard's share.
    """
    data = F.col(f"`{text}`")
    word = r"[^\x20\x09-\x0D]+"
    slim = materialise(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.md5(F.coalesce(F.concat(F.lit("="), data), F.lit("")).cast("binary")).alias("text_key"),
            (F.coalesce(F.octet_length(data), F.lit(0)).cast("long") + row_bytes).alias("size"),
            F.crc32(F.coalesce(data, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.regexp_count(data, F.lit(word)), F.lit(0)).cast("long").alias("tokens"),
        )
    )
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = slim.agg(*sums).first()
    if not total.rows:
        return slim.selectExpr("id", "size", "text_crc32", "tokens", "cast(null as bigint) cell", "cast(null as int) shard", "cast(null as bigint) slot")
    weight = F.greatest(*[F.col(k) * float(shards * pieces) / max(total[k], 1) for k in ("size", "tokens", "rows")])
    # Each of the three weights sums to shards * pieces, so fewer groups than 3 * shards * pieces weigh 1 or more.
    heavy = slim.groupBy("text_key").agg(*sums).withColumn("weight", weight).where("weight >= 1")
    found = sorted(tuple(r) for r in heavy.collect())
    hashed = F.pmod(F.xxhash64("text_key"), F.lit(cells * shards))
    parts_of = np.zeros(0, np.int64)
    if found:
        keys = F.broadcast(docs.sparkSession.createDataFrame([(r[0],) for r in found], "text_key string"))
        small = slim.join(keys, "text_key", "left_anti").groupBy(hashed.alias("cell")).agg(*sums).drop("cell").collect()
        parts_of = cuts(np.array(sorted(map(tuple, small)), float).reshape(-1, 3), np.array([r[1:4] for r in found], float), np.array([r[4] for r in found]), shards, pieces)
    first, at = [], cells * shards
    for r, parts in zip(found, parts_of.tolist(), strict=True):
        first.append((r[0], int(parts), at))
        at += int(parts)
    spark = docs.sparkSession
    cut = F.broadcast(spark.createDataFrame(first, "text_key string, parts int, first long"))
    celled = slim.join(cut, "text_key", "left").withColumn("cell", F.coalesce(F.col("first") + F.pmod(F.xxhash64(F.lit("piece"), "id", "text_crc32"), F.col("parts")), hashed)).drop("parts", "first", "text_key")
    by_cell = sorted(tuple(r) for r in celled.groupBy("cell").agg(*sums).collect())
    numbers = np.array(by_cell, dtype=np.int64)
    placed = pack(numbers[:, 1:], shards)
    before = np.zeros(len(numbers), np.int64)
    filled = np.zeros(shards, np.int64)
    for i, s in enumerate(placed):
        before[i] = filled[s]
        filled[s] += numbers[i, 3]
    places = F.broadcast(spark.createDataFrame([(int(c), int(s), int(b)) for c, s, b in zip(numbers[:, 0], placed, before, strict=True)], "cell long, shard int, before long"))
    ordered = W.partitionBy("cell").orderBy("id", "text_crc32", "size")
    return celled.withColumn("n", F.row_number().over(ordered)).join(places, "cell").select("id", "size", "text_crc32", "tokens", "cell", "shard", (F.col("before") + F.col("n") - 1).alias("slot"))
