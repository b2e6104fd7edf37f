"""Approximate nearest neighbours by largest inner product: anisotropic four-bit product codes, then exact reranking.

Rows fall to the nearest of about sqrt(n) coarse centroids. What a centroid leaves is quantised in two-dimensional subspaces with
16 codewords each, under a score-aware loss: error parallel to the vector costs `eta` times as much as error across it, since
only that moves the large inner products. Codes are chosen by coordinate descent and codewords by least squares under the same
loss. A query's tables of 16 products a subspace, joined in pairs to 256, score a cluster's rows by look-ups. The best of a part by these
scores give a k-th exact inner product; every row of the visited clusters that its code's own error lets reach it, ties included, is
reranked in double precision, so among the visited clusters' rows the result is exact, for near copies that share a code too.

How many clusters a query visits is found on the sample: enough for 98 of 100 true neighbours there. Where vectors fall
into clusters that is few of them; where they don't, as good as all, and the search is a table scan in blocks.

Centroids and codewords are fitted on a bounded sample (20,000 rows, the first by a hash of the id); every row is indexed. Rows are dealt by
(cluster, block) to parts of bounded size, so a cluster that holds a third of all rows is spread out; a query visits each part that
holds one of its clusters once. The driver gets the sample and the clusters' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, first_by_hash, numbered
from .wordhash import mix

SAMPLE, BLOCK, PART, QUERIES = 20_000, 2048, 8192, 8192
f32 = np.float32


def valid(vector: Column, size: int | Column) -> Column:
    """Vectors that take part: of the size, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of rows, never 0: a vector far smaller than the largest may vanish in single precision."""
    return np.maximum(np.linalg.norm(x, axis=1), np.finfo(f32).tiny)


class Quantiser:
    """Coarse centroids and codewords (subspace, 16, 2) of vectors of an even size (odd ones are padded)."""

    def __init__(self, x: np.ndarray, clusters: int, threshold: float = 0.2, rounds: int = 4, seed: int = 5, scale: float = 1.0):
        rng = np.random.default_rng(seed)
        self.scale = scale
        x = self.padded(x)
        self.eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        self.coarse = kmeans(x, clusters, 10, rng)
        t = x - self.coarse[nearest(x, self.coarse)]
        u = x / lengths(x)[:, None]
        m = x.shape[1] // 2
        self.words = np.stack([kmeans(t[:, 2 * i : 2 * i + 2], 16, 6, rng) for i in range(m)]).astype(f32)
        for _ in range(rounds):
            self.refit(t, u, self.assign(t, u))

    def padded(self, x: np.ndarray) -> np.ndarray:
        """In single precision, scaled to its range; codes and bounds are of these."""
        x = x * self.scale if self.scale != 1.0 else x
        return np.ascontiguousarray(np.pad(x, ((0, 0), (0, x.shape[1] % 2)) if x.shape[1] % 2 else 0), f32)

    def assign(self, t: np.ndarray, u: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, subspaces) by coordinate descent from the nearest codewords."""
        m = len(self.words)
        codes = np.stack([nearest(t[:, 2 * i : 2 * i + 2], self.words[i]) for i in range(m)], 1)
        part = np.stack([((t[:, 2 * i : 2 * i + 2] - self.words[i][codes[:, i]]) * u[:, 2 * i : 2 * i + 2]).sum(1) for i in range(m)], 1)
        along = part.sum(1)
        rows = np.arange(len(t))
        for i in list(range(m)) * sweeps:
            e = t[:, None, 2 * i : 2 * i + 2] - self.words[i]
            p = (e * u[:, None, 2 * i : 2 * i + 2]).sum(2)
            codes[:, i] = ((e * e).sum(2) + (self.eta - 1) * ((along - part[:, i])[:, None] + p) ** 2).argmin(1)
            new = p[rows, codes[:, i]]
            along += new - part[:, i]
            part[:, i] = new
        return codes

    def refit(self, t: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """The codewords of least loss for these codes: one linear system over all of them."""
        m = len(self.words)
        size = 32 * m
        a, b = np.zeros((size, size)), np.zeros(size)
        for at in range(0, len(t), 2000):
            tt, uu, cc = t[at : at + 2000], u[at : at + 2000], codes[at : at + 2000]
            y = np.zeros((len(tt), size), f32)
            slot = (np.arange(m) * 16 + cc) * 2
            rows = np.arange(len(tt))[:, None]
            y[rows, slot], y[rows, slot + 1] = uu[:, ::2], uu[:, 1::2]
            a += (self.eta - 1) * (y.T @ y)
            b += (self.eta - 1) * (y.T @ (uu * tt).sum(1))
            np.add.at(b, slot, tt[:, ::2])
            np.add.at(b, slot + 1, tt[:, 1::2])
            np.add.at(a, (slot, slot), 1)
            np.add.at(a, (slot + 1, slot + 1), 1)
        a[np.diag_indices(size)] += 1e-3
        b += 1e-3 * self.words.reshape(-1)
        self.words = np.linalg.solve(a, b).reshape(m, 16, 2).astype(f32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, codes packed in pairs to bytes); an odd number of subspaces is padded with a code that scores 0."""
        x = self.padded(x)
        own = nearest(x, self.coarse)
        codes = self.assign(x - self.coarse[own], x / lengths(x)[:, None])
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return own, (codes[:, ::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def decode(self, own: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """The (padded) vectors that encode()'s clusters and codes stand for."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, : len(self.words)]
        return self.coarse[own] + self.words[np.arange(len(self.words)), codes].reshape(len(packed), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(pairs of subspaces, queries, 256)."""
        q = self.padded(q)
        lut = np.stack([q[:, 2 * i : 2 * i + 2] @ w.T for i, w in enumerate(self.words)])
        lut = np.concatenate([lut, np.zeros((len(lut) % 2, *lut.shape[1:]), f32)])
        return (lut[::2, :, :, None] + lut[1::2, :, None, :]).reshape(len(lut) // 2, len(q), 256)

    def probes(self, q: np.ndarray, many: int) -> np.ndarray:
        s = self.padded(q) @ self.coarse.T
        return np.argsort(-s, 1, kind="stable")[:, :many]


def vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def part_of(cluster: np.ndarray, block: np.ndarray, parts: int) -> np.ndarray:
    return (mix(cluster.astype(np.uint64) << np.uint64(32) | block.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _index(model: Quantiser, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own, codes = model.encode(vectors(batch.column(2), size))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary())], ["_rid", "vec_id", "v", "cluster", "codes"])
    return run


def _deal(blocks: np.ndarray, parts: int, copies: int):
    """Index rows to the parts, once for each group of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, rid = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            part = part_of(cluster, mix(rid.astype(np.uint64)) % blocks[cluster].astype(np.uint64), parts)
            for g in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), g)), *batch.columns], ["part", "g", "_rid", "vec_id", "v", "cluster", "codes"])
    return run


def _route(model: Quantiser, size: int, blocks: np.ndarray, parts: int, copies: int, many: int):
    """Queries to each part that holds a block of one of their clusters."""
    held: list[set[int]] = [set(part_of(np.full(n, c), np.arange(n), parts).tolist()) for c, n in enumerate(blocks.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, part, lists = [], [], []
                for i, near in enumerate(model.probes(vectors(batch.column(2), size), many).tolist()):
                    to: dict[int, list[int]] = {}
                    for c in near:
                        for p in held[c]:
                            to.setdefault(p, []).append(c)
                    rows += [i] * len(to)
                    part += to.keys()
                    lists += to.values()
                sent = batch.take(pa.array(rows, pa.int64()))
                group = (mix(sent.column(0).to_numpy().astype(np.uint64)) % np.uint64(copies)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(group), *sent.columns, pa.array(lists, pa.list_(pa.int64()))], ["part", "g", "q_rid", "query_id", "q", "clusters"])
    return run


def largest(s: np.ndarray, r: int) -> np.ndarray:
    """Places of the r largest of each row; of equal ones the first, so that copies are taken in order of their ids."""
    if s.shape[1] <= r:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    top = np.argpartition(-s, r - 1, 1)[:, :r]
    least = np.take_along_axis(s, top, 1).min(1, keepdims=True)
    for i in np.flatnonzero((s >= least).sum(1) > r):
        top[i] = np.argsort(-s[i], kind="stable")[:r]
    return top


class Reach:
    """Which rows may have an exact product of at least t with a query, by their table scores.

    A row x of norm |x| and direction u is coded with an error that has the part a|x| along u and one of norm e across it. With c = q.u
    the table score is c|x|(1 - a) less at most e sqrt(|q|^2 - c^2), which grows with c from 0 on if a < 1; so from c >= t / |x| > 0
    follows the least score of a row that may reach t. Else the error's whole norm is the bound. The slack is for sums in single precision.
    """

    def __init__(self, x: np.ndarray, coded: np.ndarray, coarse: np.ndarray):
        x, coded = x.astype(np.float64), coded.astype(np.float64)
        self.norm = lengths(x)
        error = x - coded
        along = (error * x).sum(1) / self.norm
        self.whole = np.linalg.norm(error, axis=1)
        self.a = along / self.norm
        self.across = np.sqrt(np.maximum(0.0, self.whole**2 - along**2))
        self.slack = (x.shape[1] + 64) * 2.0**-23 * (self.norm + np.linalg.norm(coded, axis=1) + 2 * np.linalg.norm(coarse, axis=1))

    def rows(self, s: np.ndarray, size: float, t: float) -> np.ndarray:
        """Places of such rows, for table scores s (-inf: no candidate) with a query of norm `size`."""
        least = t - size * self.whole
        if t > 0:
            angle = np.sqrt(np.maximum(0.0, size**2 - (t / self.norm) ** 2))
            least = np.where(self.a < 1, np.maximum(least, t * (1 - self.a) - self.across * angle), least)
        return np.flatnonzero((s >= least - size * self.slack) & (s > -np.inf))


def probes_needed(model: Quantiser, x: np.ndarray, k: int, share: float, most: int = 300) -> int:
    """How many clusters a query must visit so that, among the sample's rows, that share of true neighbours lies in them."""
    q = x[:most]
    near = model.padded(q) @ model.padded(x).T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    top = np.argpartition(-near, k - 1, 1)[:, :k]
    order = np.argsort(model.probes(q, len(model.coarse)), 1)
    place = np.take_along_axis(order, nearest(model.padded(x), model.coarse)[top], 1)
    return int(np.quantile(place, share)) + 1


def _search(model: Quantiser, size: int, k: int, rerank: int):
    """The best k rows of a part for each of its queries."""
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if index.num_rows and queries.num_rows:
            index = index.combine_chunks().sort_by([("cluster", "ascending"), ("vec_id", "ascending"), ("_rid", "ascending")])
            col = lambda t, c: t.column(c).combine_chunks()
            cluster, ids, rid = (col(index, c).to_numpy() for c in ("cluster", "vec_id", "_rid"))
            x = vectors(col(index, "v"), size)
            codes = np.frombuffer(b"".join(col(index, "codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            queries = queries.combine_chunks()
            q, q_id, q_rid = vectors(col(queries, "q"), size), col(queries, "query_id").to_numpy(), col(queries, "q_rid").to_numpy()
            lists = col(queries, "clusters")
            asks = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            asked = lists.flatten().to_numpy()
            held = np.unique(cluster)
            edges = np.searchsorted(cluster, np.r_[held, held[-1] + 1])
            reach = Reach(model.padded(x), model.decode(cluster, codes), model.coarse[cluster])
            for at in range(0, len(q), 128):
                mine = slice(*np.searchsorted(asks, [at, at + 128]))
                who, which = asks[mine] - at, asked[mine]
                table, coarse = model.tables(q[at : at + 128]), model.padded(q[at : at + 128]) @ model.coarse.T
                s = np.full((len(coarse), len(ids)), -np.inf, f32)
                for c, i, j in zip(held.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    w = who[which == c]
                    if len(w):
                        own = np.repeat(coarse[w, c][:, None], j - i, 1)
                        for m in range(len(table)):
                            own += table[m][w][:, codes[i:j, m]]
                        s[w, i:j] = own
                s[rid == q_rid[at : at + 128][:, None]] = -np.inf
                top = largest(s, rerank)
                wide = q[at : at + 128].astype(np.float64)
                exact = np.einsum("qrd,qd->qr", x[top].astype(np.float64), wide)
                exact[np.take_along_axis(s, top, 1) == -np.inf] = -np.inf
                kth = np.partition(exact, exact.shape[1] - k, 1)[:, exact.shape[1] - k] if exact.shape[1] >= k else np.full(len(s), -np.inf)
                for i, t in enumerate(kth.tolist()):
                    own = reach.rows(s[i], float(np.linalg.norm(wide[i])) * model.scale, t * model.scale**2)
                    e = np.einsum("rd,d->r", x[own].astype(np.float64), wide[i])
                    best = np.lexsort((ids[own], -e))[:k]
                    found.append((np.full(len(best), at + i), ids[own[best]], e[best]))
        w, i, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((i, -s, w))
        w, i, s = w[order], i[order], s[order]
        first = np.searchsorted(w, w)
        keep = (np.arange(len(w)) - first < k) & (s > -np.inf)
        w, i, s = w[keep], i[keep], s[keep]
        return pa.table({"q_rid": pa.array(q_rid[w] if len(w) else w, pa.int64()), "query_id": pa.array(q_id[w] if len(w) else w, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})
    return run


def search(rows: DataFrame, every: int = 20, k: int = 20, rerank: int = 400, share: float = 0.98, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows of largest inner product found.

    The score is the exact inner product in double precision; ties go to the smaller id. A query's own row is no candidate, but a
    repeated row or another row with its id is. Vectors that are null, zero, of another size than most, or hold a null or
    non-finite component take no part, as queries or candidates; nor do rows without an id. With fewer than k candidates all
    are returned; an empty table gives none. Extra columns don't matter.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    sizes = own.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes.d
    kind = "float" if dict(own.dtypes)["v"] == "array<float>" else "double"  # products are those of the vectors as they are
    own = numbered(own).where(F.col("vec_id").isNotNull() & valid(F.col("v"), size)).select("_rid", "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"))
    n, asked, peak = own.agg(F.count("*"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0)), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clusters = min(4096, max(1, round(math.sqrt(n))))
    taken = first_by_hash(own, "vec_id", sample, "_rid").select("v").toArrow()
    x = vectors(taken.column(0).combine_chunks(), size)
    model = Quantiser(x, clusters, scale=1.0 if 2.0**-30 <= peak <= 2.0**30 else 2.0 ** -math.frexp(peak)[1])
    many = probes_needed(model, x, k, share)
    index = checkpoint(own.mapInArrow(_index(model, size), f"_rid long, vec_id long, v array<{kind}>, cluster long, codes binary"))
    blocks = np.ones(clusters, np.int64)
    for c, m in index.groupBy("cluster").count().collect():
        blocks[c] = -(-m // BLOCK)
    parts = max(1, math.ceil(n / PART))
    copies = max(1, math.ceil(asked * min(1.0, many * blocks.mean() / parts) / QUERIES))
    dealt = index.mapInArrow(_deal(blocks, parts, copies), f"part long, g long, _rid long, vec_id long, v array<{kind}>, cluster long, codes binary")
    routed = own.where(F.col("vec_id") % every == 0).mapInArrow(_route(model, size, blocks, parts, copies, many), f"part long, g long, q_rid long, query_id long, q array<{kind}>, clusters array<long>")
    found = dealt.groupBy("part", "g").cogroup(routed.groupBy("part", "g")).applyInArrow(_search(model, size, k, rerank), "q_rid long, query_id long, vec_id long, score double")
    best = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
