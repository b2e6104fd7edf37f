"""Benchmark decontamination: documents that contain 13-word windows of benchmark items, word by word.

A prefix-filtered set join. A window's set is its 5-word shingles; to contain a window a document must contain all of them, so
one necessary token, the window's rarest shingle over all documents, is joined on. Length and positional bounds (the window must
fit around the shingle's place in the document) come next, then exact containment is verified word by word over item-sized windows.

The benchmark is read in blocks of bounded size, each against all documents: one block is the broadcast side, and a larger
benchmark takes more passes rather than more memory. A pass counts the block's shingles over all documents (sums by shingle
reach the driver, as many as the block has), another joins. Documents are never shuffled if the benchmark is one block; with
more, only their hits are. Items that can't be broadcast as they are too long for a block form one of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpoint, numbered, small
from .wordhash import ALNUM, grams, slices, utf8, words

BLOCK_BYTES = 4 << 20


class Block(NamedTuple):
    """The distinct windows of some items: their word hashes one after another, and which items hold each."""
    words: np.ndarray
    at: np.ndarray
    length: np.ndarray
    holders: list[list[str | None]]


class Probe(NamedTuple):
    """For each shingle size: sorted prefix shingles, and for each of them the windows that it stands for and its place there."""
    size: int
    keys: np.ndarray
    at: np.ndarray
    window: np.ndarray
    place: np.ndarray


def windows_of(items: list[tuple[str | None, str]], size: int = 13) -> Block:
    """Items of fewer words, but not none, are one window."""
    held: dict[bytes, tuple[np.ndarray, dict]] = {}
    data, offsets = utf8(pa.array([t or "" for _, t in items], pa.large_string()))
    h, rows = words(data, offsets, ALNUM)
    for i, (name, _) in enumerate(items):
        own = h[np.searchsorted(rows, i) : np.searchsorted(rows, i + 1)]
        for s in range(max(1, len(own) - size + 1) if len(own) else 0):
            w = own[s : s + size]
            held.setdefault(w.tobytes(), (w, {}))[1][name] = None
    every = [w for w, _ in held.values()]
    length = np.array([len(w) for w in every], np.int64)
    return Block(np.concatenate(every) if every else np.zeros(0, np.uint64), np.r_[0, np.cumsum(length)], length, [list(x) for _, x in held.values()])


def shingles_of(block: Block, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (shingle, window, place) of each window's shingles of min(k, its length) words."""
    out: dict[int, list] = {}
    for i, n in enumerate(block.length.tolist()):
        s = min(k, n)
        g = grams(block.words[block.at[i] : block.at[i + 1]], s)
        out.setdefault(s, []).append((g, np.full(len(g), i), np.arange(len(g))))
    return {s: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for s, parts in out.items()}


def _in(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, places in the keys) of the members."""
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == x) if len(sorted_keys) else np.zeros(0, np.int64)
    return hit, at[hit]


def _count(keys: dict[int, np.ndarray]):
    """(size, shingle, n): occurrences in a task's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                h, rows = words(data, offsets[i : j + 1], ALNUM)
                for s, k in keys.items():
                    hit, at = _in(k, grams(h, s))
                    at = at[rows[hit] == rows[hit + s - 1]]
                    np.add.at(total[s], at, 1)
        for s, k in keys.items():
            seen = total[s] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), s)), pa.array(k[seen].view(np.int64)), pa.array(total[s][seen])], ["size", "shingle", "n"])
    return run


def probes_of(block: Block, k: int, counts: dict[tuple[int, int], int]) -> list[Probe]:
    """Each window's rarest shingle. A window with a shingle that no document has needs none."""
    out = []
    for s, (g, window, place) in shingles_of(block, k).items():
        n = np.array([counts.get((s, x), 0) for x in g.view(np.int64).tolist()], np.int64)
        order = np.lexsort((place, n, window))
        first = order[np.r_[True, window[order][1:] != window[order][:-1]]]
        first = first[n[first] > 0]
        first = first[np.argsort(g[first], kind="stable")]
        keys, at = np.unique(g[first], return_index=True)
        out.append(Probe(s, keys, np.r_[at, len(first)], window[first], place[first]))
    return out


def _match(block: Block, probes: list[Probe]):
    """(_rid, doc_id, n_words, starts, ends, items): merged word intervals of the hits, and the items with windows there."""
    def find(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences."""
        places, found = [], []
        first, last = np.searchsorted(rows, rows), np.searchsorted(rows, rows, "right")
        for p in probes:
            hit, at = _in(p.keys, grams(h, p.size))
            many = p.at[at + 1] - p.at[at]
            own = np.repeat(p.at[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hit = np.repeat(hit, many)
            w, start = p.window[own], hit - p.place[own]
            fits = (start >= first[hit]) & (start + block.length[w] <= last[hit])
            w, start = w[fits], start[fits]
            for n in np.unique(block.length[w]).tolist():
                same = block.length[w] == n
                a, b = start[same], w[same]
                for step in range(n):  # word by word; most false candidates go at the first
                    eq = h[a + step] == block.words[block.at[b] + step]
                    a, b = a[eq], b[eq]
                places.append(a)
                found.append(b)
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            n_words = np.zeros(batch.num_rows, np.int64)
            starts: list = [[] for _ in range(batch.num_rows)]
            ends: list = [[] for _ in range(batch.num_rows)]
            items: list = [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                h, rows = words(data, offsets[i : j + 1], ALNUM)
                begin = np.searchsorted(rows, np.arange(j - i + 1))
                n_words[i:j] = np.diff(begin)
                place, window = find(h, rows)
                if not len(place):
                    continue
                step = np.zeros(len(h) + 1, np.int64)
                np.add.at(step, place, 1)
                np.add.at(step, place + block.length[window], -1)
                hit = np.r_[False, np.cumsum(step[:-1]) > 0, False]
                # an interval may run on into the next document: row edges cut it
                for r in np.unique(rows[place]).tolist():
                    a, b = int(begin[r]), int(begin[r + 1])
                    own = np.r_[False, hit[a + 1 : b + 1], False]
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    starts[i + r], ends[i + r] = edge[::2].tolist(), edge[1::2].tolist()
                for r, w in set(zip(rows[place].tolist(), window.tolist(), strict=True)):
                    items[i + r] += block.holders[w]
            items = [sorted(set(x), key=lambda v: (v is None, v or "")) for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["_rid", "doc_id", "n_words", "starts", "ends", "items"])
    return run


def blocks_of(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most so many bytes of text, or of one item; streamed, a partition at a time."""
    held, size = [], 0
    for name, text in benchmark.toLocalIterator():
        n = len(text.encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((name, text))
        size += n
    yield held


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_rid, doc_id, n_words, spans array<struct<start, end>>, items array<string>) for each row of docs; _rid is its numbered() one.

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased; spans are merged word intervals, end
    exclusive, inside occurrences of item windows; items are the distinct item_ids (as strings, sorted, null last) with one.
    Null and empty texts have no words; items without words match nothing; items repeated under one id count once. Repeated
    rows stay apart. Other columns don't matter. An empty benchmark or table is fine. Word runs are compared by 64-bit hashes.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.select("text")
    parts = []
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    for held in blocks_of(items, block_bytes):
        block = windows_of(held, window)
        keys = {s: np.unique(g) for s, (g, _, _) in shingles_of(block, k).items()}
        counted = texts.mapInArrow(_count(keys), "size long, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).toPandas() if keys else None
        counts = dict(zip(zip(counted["size"], counted["shingle"], strict=True), counted["n"], strict=True)) if keys else {}
        parts.append(rows.select("_rid", "doc_id", "text").mapInArrow(_match(block, probes_of(block, k, counts)), f"_rid long, doc_id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"))
    if len(parts) == 1:
        spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")))
        return parts[0].select("_rid", "doc_id", "n_words", spans.alias("spans"), "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.groupBy("_rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    zero = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), start.alias("open"))
    closed = lambda acc: F.when(acc["open"]["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    def step(acc, x):
        joins = x["starts"] <= acc["open"]["end"]
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.struct(F.when(joins, acc["open"]["start"]).otherwise(x["starts"]).alias("start"), F.when(joins, F.greatest(acc["open"]["end"], x["ends"])).otherwise(x["ends"]).alias("end")).alias("open"))
    return every.select("_rid", "doc_id", "n_words", F.aggregate(F.array_sort("x"), zero, step, closed).alias("spans"), "items")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def is_contaminated() -> Column:
    """A twentieth of the words is hit."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def digest(matched: DataFrame) -> DataFrame:
    """The columns of the query, from match_benchmark()."""
    named = F.array_join(F.filter("items", lambda x: x.isNotNull()), ",")
    return matched.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, as match_benchmark() and digest() have them. Columns of any names pass through."""
    safe, back = apart(docs, {"doc_id": "doc_id", "text": "text"})
    rows = numbered(safe)
    matched = match_benchmark(rows.drop("_rid"), benchmark, **options)
    gone, _ = small(checkpoint(matched.where(is_contaminated()).select("_rid")))
    return rows.join(gone, "_rid", "left_anti").select(*back)
