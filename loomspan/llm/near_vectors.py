"""Near-duplicate embeddings: sorted projection passes.

In each pass vectors of a label are ordered lexicographically by the signs of their products with random directions, and each is compared with the
`window` that follow it. Vectors at an angle a share a sign with probability 1 - a / pi, so close ones stand close in the order; a pair that the label's
size lets meet in one pass with probability p meets in some pass with 1 - (1 - p)^passes, and passes are as many as `recall` asks for
at the threshold itself (nearer pairs meet more often). Pairs are verified by cosine in double precision and united across passes.

Two things keep groups of copies from costing pairs in proportion to their square, and their links whole. Equal vectors of a label are
one class with a count. And after the first passes, of each connected group that has a vector with half a window of links or more, that of most
links is a hub: all members within half the threshold's angle of it link with one another by the triangle inequality of angles, so they're a clique,
whose links are counted, not made; later passes pass over pairs within a clique. What remains to the windows are pairs of vectors of
which one is in no clique or each in another: of a group spread wider than half the angle and larger than the windows, links can be missed.

A pass sorts narrow rows (label, key, number); vectors are shuffled once a pass to blocks of bounded size, each with the window that follows it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import valid
from .common import checkpoint, numbered, small
from .linkage import components

#: Signs of a key, bytes of vectors that a block holds, bytes of hubs that may be broadcast.
BITS, BLOCK_BYTES, HUB_BYTES = 64, 4 << 20, 32 << 20


def passes_needed(n: int, window: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability `recall`, among n vectors without other structure: it meets in a
    pass if it shares the signs that cut n vectors into windows."""
    shared = 1 - math.acos(threshold) / math.pi
    p = shared ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if p >= recall else math.ceil(math.log1p(-recall) / math.log1p(-p))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("rd,rd->r", x, x))[:, None]


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the vectors of each size."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, unit(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def _keys(passes: range, seed: int):
    """(pass, label, d, key, id): a row for each vector and pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for rows, x in by_size(batch.column(2)):
                    d, take = x.shape[1], pa.array(rows)
                    for p in passes:
                        if (p, d) not in planes:
                            planes[p, d] = np.random.default_rng((seed, p, d)).standard_normal((d, BITS))
                        key = np.packbits(x @ planes[p, d] > 0, axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), batch.column(1).take(take), pa.array(np.full(len(rows), d, np.int32)), pa.array([k.tobytes() for k in key], pa.binary()), batch.column(0).take(take)], ["pass", "label", "d", "key", "id"])
    return run


def _compare(block: int, window: int, threshold: float):
    """(a, b) of the pairs of a block, the first of each in it, that stand within a window and reach the threshold."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        no, rank, ids, label, clique = (table.column(c).to_numpy() for c in ("block", "rank", "id", "label", "clique"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, x in by_size(table.column("v").chunk(0)):
            order = np.argsort(rank[rows])
            rows, x = rows[order], x[order]
            r = rank[rows]
            last = int(np.searchsorted(r // block, no[0], "right"))
            for i in range(0, last, window):
                own = slice(i, min(i + window, last))
                near = slice(i, int(np.searchsorted(r, r[own.stop - 1] + window, "right")))
                at, to = np.nonzero(x[own] @ x[near].T >= threshold)
                apart = to - at
                m, n = rows[own][at], rows[near][to]
                keep = (apart > 0) & (rank[n] - rank[m] <= window) & (label[m] == label[n]) & (ids[m] != ids[n]) & ((clique[m] != clique[n]) | (clique[m] < 0))
                a.append(np.minimum(ids[m], ids[n])[keep])
                b.append(np.maximum(ids[m], ids[n])[keep])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})
    return run


def _pass(vectors: DataFrame, cliques: DataFrame | None, passes: range, block: int, window: int, threshold: float, seed: int) -> DataFrame:
    """(a, b) of vectors(id, label, v) found in the passes; those of one clique(id, clique) aren't sought."""
    by = ["pass", "label", "d", "key", "id"]
    sorted_ = vectors.mapInArrow(_keys(passes, seed), "pass int, label long, d int, key binary, id long").repartitionByRange(*by).sortWithinPartitions(*by)
    sorted_ = checkpoint(sorted_.select("id", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    begin, offsets = 0, []
    for p, n in sorted(map(tuple, sorted_.groupBy(part.alias("p")).count().collect())):  # a number for each partition
        offsets.append((p, begin))
        begin += n
    offsets = F.broadcast(vectors.sparkSession.createDataFrame(offsets, "p long, begin long"))
    rank = (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank")
    ranked = sorted_.withColumn("p", part).join(offsets, "p").select("id", rank).withColumn("block", F.floor(F.col("rank") / block))
    halo = (F.col("rank") % block < window) & (F.col("rank") >= block)
    placed = ranked.select("id", "rank", F.explode(F.when(halo, F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))).alias("block"))
    known = vectors.withColumn("clique", F.lit(-1).cast("long")) if cliques is None else vectors.join(cliques, "id", "left").na.fill(-1, ["clique"])
    found = placed.join(known, "id").groupBy("block").applyInArrow(_compare(block, window, threshold), "a long, b long")
    return found.distinct()  # of all passes: few pairs meet once alone


def _within(threshold: float):
    """(id, clique) of the vectors whose cosine with the hub reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            same = batch.column(2).value_lengths().to_numpy() == batch.column(3).value_lengths().to_numpy()
            own = batch.filter(pa.array(same))
            for (rows, x), (_, y) in zip(by_size(own.column(2)), by_size(own.column(3)), strict=True):
                keep[np.flatnonzero(same)[rows]] = np.einsum("rd,rd->r", x, y) >= threshold
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["id", "clique"])
    return run


def _cliques(vectors: DataFrame, links: DataFrame, size: int, window: int, threshold: float, rounds: int) -> DataFrame:
    """(id, clique): groups in which all vectors link with one another; a clique is named by its hub."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    groups = checkpoint(components(links))
    degree = checkpoint(links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(F.col("count") >= window // 2))
    out = vectors.sparkSession.createDataFrame([], "id long, clique long")
    for _ in range(rounds):
        left = degree.join(out, "id", "left_anti").join(groups, "id")
        hubs = checkpoint(left.groupBy("comp").agg(F.max(F.struct("count", (-F.col("id")).alias("minus"))).alias("m")).select("comp", (-F.col("m.minus")).alias("clique")))
        if hubs.isEmpty():
            break
        central = hubs.join(vectors.select(F.col("id").alias("clique"), F.col("v").alias("hub")), "clique")
        central, _ = small(checkpoint(central), max(1, HUB_BYTES // (8 * size)))
        members = groups.join(central, "comp").join(out.select("id"), "id", "left_anti").join(vectors, "id").select("id", "clique", "v", "hub")
        out = checkpoint(out.union(members.mapInArrow(_within(half), "id long, clique long")))
    return out


def near_vectors(rows: DataFrame, threshold: float = 0.93, window: int = 128, recall: float = 0.995, rounds: int = 3, at_once: int = 4, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows.

    Rows link if their labels are equal and their cosine is at least the threshold; n_links counts the other rows that a row links with,
    component_id is the least vec_id reachable (nulls are passed over; null if there is no other) and kept tells whether it's the row's own. Vectors that are null,
    zero or hold null or non-finite components, and rows without a label, link with nothing, and vectors of different sizes not with one another. Repeated
    ids are rows of their own, a null id is never kept; an empty table gives no rows. Other columns play no part.

    at_once passes share a shuffle: more of them need more disk at a time, fewer more jobs.
    """
    own = numbered(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label")))
    good = own.where(F.col("label").isNotNull() & valid(F.col("v"), F.size("v")))
    # adding 0 makes negative zeros positive, which equal vectors may differ by
    hashes = [F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0))).alias("h"), F.xxhash64(F.lit("g"), F.transform("v", lambda x: x + F.lit(0.0))).alias("g")]
    hashed = good.select("_rid", "vec_id", "label", *hashes)
    classes = checkpoint(hashed.groupBy("label", "h", "g").agg(F.min("_rid").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("n")))
    largest, = classes.groupBy("label").count().agg(F.max("count")).first()
    size, = good.agg(F.max(F.size("v"))).first()
    if largest is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    vectors = checkpoint(good.join(classes.select(F.col("id").alias("_rid")), "_rid").select(F.col("_rid").alias("id"), "label", "v"))
    block = max(2 * window, BLOCK_BYTES // (8 * size))
    passes = passes_needed(largest, window, threshold, recall)
    links = checkpoint(_pass(vectors, None, range(min(at_once, passes)), block, window, threshold, seed))
    cliques = _cliques(vectors, links, size, window, threshold, rounds)
    for p in range(at_once, passes, at_once):
        links = links.union(checkpoint(_pass(vectors, cliques, range(p, min(p + at_once, passes)), block, window, threshold, seed)))
    of = lambda side: cliques.select(F.col("id").alias(side), F.col("clique").alias(f"clique_{side}"))
    across = links.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where("clique_a is null or clique_b is null or clique_a <> clique_b").select("a", "b")
    across = checkpoint(across)

    counts = classes.select("id", "n")
    ends = across.union(across.select("b", "a")).toDF("id", "other")
    made = ends.join(counts.toDF("other", "n"), "other").groupBy("id").agg(F.sum("n").alias("more"))
    sized = cliques.join(counts, "id")
    cliqued = sized.join(sized.groupBy("clique").agg(F.sum("n").alias("all")), "clique").select("id", (F.col("all") - F.col("n")).alias("inside"))
    groups = components(across.union(cliques.select(F.col("clique").alias("a"), F.col("id").alias("b"))))
    least = groups.join(classes.select("id", "least"), "id").groupBy("comp").agg(F.min("least").alias("top"))
    tops = groups.join(least, "comp").select("id", "top")
    none = F.lit(0).cast("long")
    known = classes.join(made, "id", "left").join(cliqued, "id", "left").join(tops, "id", "left").select("label", "h", "g", (F.col("n") - 1 + F.coalesce("more", none) + F.coalesce("inside", none)).alias("n_links"), F.coalesce("top", "least").alias("component_id"))
    joined = hashed.join(checkpoint(known), ["label", "h", "g"]).select("_rid", "n_links", "component_id")
    return (own.select("_rid", "vec_id").join(joined, "_rid", "left")
            .select("vec_id", F.coalesce("n_links", none).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
