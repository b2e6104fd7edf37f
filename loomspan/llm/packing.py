"""Packing: tokenises documents and packs them into sequences by harmonic classes, independently in each task.

The capacity divided by k is the slot of class k, and each bin of class k holds k pieces. A document is cut into full sequences
and a rest; a rest that fills its slot badly is cut at the next slot below, at most twice, so what stays empty is a small part
of a slot. A task's bins that never fill are emptied into common sequences at its end, cut where one is full. Nothing is
shuffled; a task holds one open bin per class, and it packs its documents alike again if it is repeated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which the two libraries' splits of a text are the same by their stated pattern: ASCII but for the control
#: characters, Latin, Greek and Cyrillic letters, common punctuation. Texts with others take the slower library.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ӿ‐-‧‰-⁞€]")


@lru_cache(maxsize=2)
def _encoders(path: str, ranks_path: str | None, pattern: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if ranks_path is None:
        return slow, None
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return slow, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], path: str, ranks_path: str | None, pattern: str, special: str = "<|endoftext|>") -> Iterator[np.ndarray]:
    """Ids of each text, without special tokens added. Plain texts go through the same vocabulary's rank file, which is faster; those
    with other characters or the special token's string through the tokenizer file itself."""
    slow, fast = _encoders(path, ranks_path, pattern)
    for t in texts:
        if fast is not None and special not in t and not PLAIN.search(t):
            yield fast.encode_to_numpy(t, disallowed_special=()).astype("<u4")
        else:
            yield np.array(slow.encode(t, add_special_tokens=False).ids, "<u4")


def cuts(length: int, capacity: int, most: int = 3) -> list[int]:
    """Lengths of the pieces of a document: full sequences, then slots of ever higher classes while that leaves less empty."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    for i in range(most):
        if not rest:
            break
        slot = capacity // (capacity // rest)
        below = capacity // (capacity // rest + 1)
        if i == most - 1 or (slot - rest) * 32 <= slot or rest == below:
            out.append(rest)
            break
        out.append(below)
        rest -= below
    return out


class Bins:
    """Open bins by class. put() and close() return the pieces of sequences that became full: lists of (doc, start, ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def put(self, piece: tuple) -> list | None:
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            return self.open.pop(k)
        return None

    def close(self) -> Iterator[list]:
        """What the unfilled bins hold, in order of class, in full sequences but for the last."""
        now, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids in self.open[k]:
                while len(ids):
                    now.append((doc, start, ids[:room]))
                    start, taken = start + len(ids[:room]), len(ids[:room])
                    ids, room = ids[room:], room - taken
                    if not room:
                        yield now
                        now, room = [], self.capacity
        if now:
            yield now
        self.open = {}


def _pack(path: str, ranks_path: str | None, pattern: str, capacity: int, end_id: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        bins = Bins(capacity)
        cols: list[list] = [[] for _ in names]
        docs: list = []

        def write(pieces: list) -> None:
            nonlocal number
            offset = 0
            for (name, total), start, ids in pieces:
                for c, v in zip(cols, (name, start, len(ids), total, number, offset, ids.tobytes()), strict=True):
                    c.append(v)
                offset += len(ids)
            number += 1

        def batch_of() -> pa.RecordBatch:
            kinds = [docs[0], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            docs[:] = [batch.schema.field(0).type]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for name, ids in zip(part.column(0).to_pylist(), encode(texts, path, ranks_path, pattern), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for n in cuts(len(ids), capacity):
                        full = bins.put(((name, len(ids)), start, ids[start : start + n].copy()))
                        start += n
                        if full:
                            write(full)
                if len(cols[0]) >= 512:
                    yield batch_of()
        for full in bins.close():
            write(full)
        if docs:
            yield batch_of()
    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str = "", capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for each piece; ids are little-endian unsigned 32-bit.

    tokenizer is the path of a tokenizers file, ranks that of the same vocabulary for tiktoken (None: not used) with its split
    pattern; both must lie at these paths on every executor. A null or empty text is its end id alone. Repeated rows and null ids are
    packed like any other. sequence_id is the task's number and a count. An empty table gives no rows; other columns don't matter.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return own.mapInArrow(_pack(tokenizer, ranks, pattern, capacity, end_id, names), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of the query, from pack()."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
