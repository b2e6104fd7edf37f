"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time.

Every byte of a text gets a probability for each language; a document's are their mean. Texts are read whole, in windows of 64
bytes that both directions cross from an empty state; windows of many documents are one batch, so each step is a few matrix
operations. Training takes a bounded sample of excerpts on the driver; the weights (about 100 kB) travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash
from .wordhash import slices, utf8

WIDTH = 64
f32 = np.float32


class BiGRU:
    """Arrays have the direction as first axis; the second direction sees a window reversed."""

    def __init__(self, classes: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.h = classes, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)),
            "b": np.zeros((2, 1, hidden)), "v": rng.normal(0, hidden**-0.5, (2, hidden, len(classes))), "c": np.zeros(len(classes)),
        }
        self.p["x"][:, :, :hidden] += 1.0  # keep the state at first
        self.p = {k: v.astype(f32) for k, v in self.p.items()}

    def states(self, bytes_: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, 2, B, h) of (B, T) bytes; mask is 0 after a text's end. keep gets what backward() needs."""
        p, h = self.p, self.h
        n, width = bytes_.shape
        out = np.empty((width, 2, n, h), f32)
        s = np.zeros((2, n, h), f32)
        for t in range(width):
            at = (t, width - 1 - t)
            a = np.stack([p["x"][0].take(bytes_[:, at[0]], 0), p["x"][1].take(bytes_[:, at[1]], 0)])
            m = np.stack([mask[:, at[0]], mask[:, at[1]]])[:, :, None]
            g = np.matmul(s, p["u"])
            zr = a[:, :, : 2 * h] + g[:, :, : 2 * h]
            zr *= f32(0.5)
            np.tanh(zr, out=zr)
            zr += f32(1)
            zr *= f32(0.5)
            z, r = zr[:, :, :h], zr[:, :, h:]
            gn = g[:, :, 2 * h :] + p["b"]
            c = r * gn
            c += a[:, :, 2 * h :]
            np.tanh(c, out=c)
            new = s - c
            new *= z
            new += c
            new *= m
            if keep is not None:
                keep.append((at, s, z, r, gn, c, m))
            s = new
            out[at[0], 0], out[at[1], 1] = s[0], s[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, B, classes)."""
        y = np.matmul(states[:, 0], self.p["v"][0]) + np.matmul(states[:, 1], self.p["v"][1]) + self.p["c"]
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def backward(self, bytes_: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient."""
        p, h, width = self.p, self.h, bytes_.shape[1]
        kept: list = []
        s = self.states(bytes_, mask, kept)
        y = self.probabilities(s)
        total = max(1.0, float(mask.sum()))
        rows = np.arange(len(label))
        loss = -float((np.log(y[:, rows, label] + 1e-9) * mask.T).sum()) / total
        d = y
        d[:, rows, label] -= 1
        d *= (mask.T / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"] = d.sum((0, 1))
        for i in (0, 1):
            g["v"][i] = np.tensordot(s[:, i], d, ((0, 1), (0, 1)))
        ds = np.stack([np.matmul(d, p["v"][0].T), np.matmul(d, p["v"][1].T)], 1)
        carry = np.zeros_like(ds[0])
        for at, before, z, r, gn, c, m in reversed(kept):
            dh = (carry + np.stack([ds[at[0], 0], ds[at[1], 1]])) * m
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dc], -1)
            dg = np.concatenate([dz, dr, dc * r], -1)
            g["b"] += (dc * r).sum(1, keepdims=True)
            g["u"] += np.matmul(before.transpose(0, 2, 1), dg)
            for i in (0, 1):
                np.add.at(g["x"][i], bytes_[:, at[i]], da[i])
            carry = dh * z + np.matmul(dg, p["u"].transpose(0, 2, 1))
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = 500, batch: int = 128, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam on random windows, each language as often; the rate falls linearly. Returns the losses."""
        rng = np.random.default_rng(seed)
        kinds = [np.flatnonzero(np.array(labels) == c) for c in range(len(self.classes))]
        kinds = [k for k in kinds if len(k)]
        m, v, losses = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, []
        m, v = m
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(kinds[i % len(kinds)]) for i in range(batch)])
            bytes_, mask = np.zeros((batch, WIDTH), np.uint8), np.zeros((batch, WIDTH), f32)
            for i, j in enumerate(pick):
                t = texts[j]
                at = int(rng.integers(0, max(1, len(t) - WIDTH + 1)))
                w = np.frombuffer(t[at : at + int(rng.choice([WIDTH, WIDTH, WIDTH, 24]))], np.uint8)
                bytes_[i, : len(w)], mask[i, : len(w)] = w, 1
            loss, g = self.backward(bytes_, mask, np.array(labels)[pick])
            losses.append(loss)
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            for k, x in g.items():
                x = x * f32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(f32)
        return losses

    def label(self, data: np.ndarray, offsets: np.ndarray, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """For each text of the buffer: sums of its positions' probabilities, and how many positions each class won."""
        n, classes = len(offsets) - 1, len(self.classes)
        size = np.diff(offsets)
        many = -(-size // WIDTH)
        own = np.repeat(np.arange(n), many)
        start = offsets[own] + WIDTH * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(WIDTH, offsets[own + 1] - start)
        sums, wins = np.zeros((n, classes)), np.zeros((n, classes), np.int64)
        order = np.argsort(-length, kind="stable")  # short windows together: their batch takes fewer steps
        for at in range(0, len(order), batch):
            w = order[at : at + batch]
            width = int(length[w[0]])
            place = np.arange(width)
            mask = place < length[w][:, None]
            bytes_ = data[np.minimum(start[w][:, None] + place, len(data) - 1)]
            y = self.probabilities(self.states(bytes_, mask.astype(f32)))
            won = y.argmax(-1)
            y *= mask.T[:, :, None]
            np.add.at(sums, own[w], y.sum(0, dtype=np.float64))
            for c in range(classes):
                np.add.at(wins[:, c], own[w], ((won == c) & mask.T).sum(0))
        return sums, wins


def train(docs: DataFrame, most_rows: int = 3000, steps: int = 500) -> BiGRU | None:
    """Learns from docs(doc_id, text, lang): at most so many rows with a language, the first by a hash of the id, of each three excerpts of
    200 characters from places all over the text. None if no row has a language and a text."""
    length = F.length("text")
    at = [F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(length - 199, F.lit(1))) + 1).cast("int"), F.lit(200)) for i in range(3)]
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    ids = F.broadcast(first_by_hash(known.select("doc_id"), "doc_id", most_rows))  # at most so many ids
    rows = known.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sample = rows.orderBy("doc_id").select("lang", F.array(*at).alias("x")).collect()
    if not sample:
        return None
    model = BiGRU(sorted({r.lang for r in sample}))
    model.fit([t.encode() for r in sample for t in r.x], [model.classes.index(r.lang) for r in sample for _ in r.x], steps)
    return model


def _predict(model: BiGRU, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sums, wins = np.zeros((batch.num_rows, len(model.classes))), np.zeros((batch.num_rows, len(model.classes)), np.int64)
            for i, j in slices(offsets):
                sums[i:j], wins[i:j] = model.label(data, offsets[i : j + 1])
            best = sums.argmax(1)
            score = sums[np.arange(len(best)), best] / np.maximum(1, np.diff(offsets))
            out = pa.array(wins.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.classes[i] for i in best]), pa.array(np.clip(score, 0, 1)), out, batch.column(2)], names)
    return run


def identify(docs: DataFrame, model: BiGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, label_bytes) for each row of docs; label_bytes counts the positions labelled with each class.

    lang_pred is `und` with score 0 if the text is null, empty or without a letter, or if there is no model; ties go to the first
    language in order. Only the text is read: other columns, repeated rows and null ids change nothing.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    own = docs.select(F.col(id_col).alias("doc_id"), F.when(letters, F.col(text_col)).otherwise("").alias("text"), letters.alias("_letters"))
    kind = own.schema["doc_id"].dataType.simpleString()
    if model is None:
        return own.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("label_bytes"))
    names = ["doc_id", "lang_pred", "score", "label_bytes", "_letters"]
    out = own.mapInArrow(_predict(model, names), f"doc_id {kind}, lang_pred string, score double, label_bytes array<long>, _letters boolean")
    return out.select("doc_id", F.when(F.col("_letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("_letters"), F.col("score")).otherwise(0.0).alias("score"), "label_bytes")


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
