"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata teach each other.

Content: presence of telling words (chosen by their log-odds on the labelled sample) and measures of the characters' make-up.
Metadata: source, language and length. Both are logistic regressions. In each round each view labels the unlabelled pool rows
that it is surest of, in the proportion of the classes, for the other to learn from. Each view is then calibrated (Platt) and
the calibrated views are combined by a logistic regression, both on labelled rows that neither has trained on.

Fitting takes a bounded sample on the driver (`most` labelled rows and as many of the unlabelled pool, the first by a hash of
the id); scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash
from .wordhash import ALNUM, row_bounds, slices, utf8, words

VOCABULARY, SOURCES, LANGS = 400, 64, 16
DENSE = 9
CLASSES = np.full(256, 6, np.uint8)  # byte classes: upper, lower, digit, white, sentence marks, pipes and marks, non-ASCII
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58] = 0, 1, 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:?'\"-()"]] = 4
CLASSES[[c for c in range(33, 127) if CLASSES[c] == 6]] = 5


def dense(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, DENSE): logarithm of the length, shares of six classes of bytes, mean word length, share of distinct words."""
    n, lo = len(offsets) - 1, int(offsets[0])
    kind = CLASSES[data[lo : int(offsets[-1])]].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * 7 + kind, minlength=7 * n).reshape(n, 7)
    size, many = np.maximum(1, np.diff(offsets)), np.diff(bounds)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    return np.column_stack([np.log1p(size), counts[:, :6] / size[:, None], np.minimum(20, size / np.maximum(1, many)) / 10, distinct / np.maximum(1, many)])


def meta(source: list, lang: list, n_chars: list) -> np.ndarray:
    """(rows, SOURCES + LANGS + 2): hashed one-hot source and language (null is a value), logarithm of the length, its absence."""
    out = np.zeros((len(source), SOURCES + LANGS + 2))
    rows = np.arange(len(source))
    out[rows, [zlib.crc32(str(s).encode()) % SOURCES for s in source]] = 1
    out[rows, [SOURCES + zlib.crc32(str(s).encode()) % LANGS for s in lang]] = 1
    out[:, -2] = [np.log1p(max(0, c)) if c is not None else 0 for c in n_chars]
    out[:, -1] = [c is None for c in n_chars]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features by Newton's method with a ridge."""
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, sure = np.zeros(z.shape[1]), np.ones(len(y)) if weight is None else weight
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = sigmoid(z @ w)
            g = z.T @ (sure * (p - y)) + penalty * w
            step = np.linalg.solve((z * (sure * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), g)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -15, 15)


@dataclass
class Model:
    vocabulary: np.ndarray
    views: tuple[Logistic, Logistic] | None
    platt: tuple[Logistic, Logistic] | None
    both: Logistic | None
    base: float

    def score(self, content: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the content view, the metadata view, and both."""
        if self.views is None:
            return (np.full(len(content), self.base),) * 3
        own = [p.logit(v.logit(x)[:, None]) for p, v, x in zip(self.platt, self.views, (content, about), strict=True)]
        return sigmoid(own[0]), sigmoid(own[1]), sigmoid(self.both.logit(np.column_stack(own)))


def presence(vocabulary: np.ndarray, h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(vocabulary)), np.float32)
    if len(vocabulary) and len(h):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        out[rows[hit], at[hit]] = 1
    return out


def choose_words(sets: list[np.ndarray], y: np.ndarray, most: int = VOCABULARY, least: int = 5) -> np.ndarray:
    """The words of largest |log-odds| in standard errors, among those in `least` rows or more."""
    if not sets or not sum(map(len, sets)):
        return np.zeros(0, np.uint64)
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(y, [len(s) for s in sets])
    good, n = np.bincount(at, own, len(keys)), np.bincount(at, minlength=len(keys))
    a, b = good + 0.5, n - good + 0.5
    c, d = y.sum() - good + 0.5, (len(y) - y.sum()) - (n - good) + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[n < least] = 0
    top = np.argsort(-z, kind="stable")[:most]
    return np.sort(keys[top[z[top] > 1.5]])


def co_train(content: np.ndarray, about: np.ndarray, y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = 5, sure: float = 0.95, share: float = 0.1) -> tuple[Logistic, Logistic]:
    """Both views after the rounds. A view teaches at most `share` of the pool a round, in the proportion of the classes."""
    own, free = [(content, y.astype(float)), (about, y.astype(float))], [pool[0], pool[1]]
    taught: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0)), (np.zeros(0, int), np.zeros(0))]
    views = [Logistic.fit(*x) for x in own]
    many, rate = int(share * len(free[0])), float(y.mean())
    for _ in range(rounds if many else 0):
        for teacher, pupil in ((0, 1), (1, 0)):
            p = sigmoid(views[teacher].logit(free[teacher]))
            order = np.argsort(-p, kind="stable")
            top = order[: int(many * rate)]
            low = order[::-1][: int(many * (1 - rate)) + 1]
            top, low = top[p[top] >= sure], low[p[low] <= 1 - sure]
            taught[pupil] = (np.r_[top, low], np.r_[np.ones(len(top)), np.zeros(len(low))])
        for i in (0, 1):
            at, label = taught[i]
            x, t = own[i]
            weight = np.r_[np.ones(len(t)), np.full(len(at), 0.3)]
            views[i] = Logistic.fit(np.vstack([x, free[i][at]]), np.r_[t, label], weight=weight)
    return views[0], views[1]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, word hashes, their rows, dense features) of slices of a batch with the text in the first column."""
    data, offsets = utf8(batch.column(0))
    for i, j in slices(offsets):
        h, rows = words(data, offsets[i : j + 1], ALNUM)
        yield i, j, h, rows, dense(data, offsets[i : j + 1], h, row_bounds(rows, j - i))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, dense) of a sample's texts: sorted distinct word hashes and dense features, as bytes."""
    for batch in batches:
        sets, rest = [], []
        for i, j, h, rows, d in _parts(batch):
            at = row_bounds(rows, j - i)
            sets += [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            rest += [x.tobytes() for x in d]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary()), pa.array(rest, pa.binary())], ["source", "lang", "n_chars", "good", "words", "dense"])


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Model:
    """Fits on docs(doc_id, text, source, lang, n_chars) and labels(doc_id, good 0/1): at most `most` labelled rows and `most` others.

    Null ids and labels are left out; of repeated labels of an id the least counts. With no label, or one class only, the model
    scores every row with the smoothed share of good labels (1 without any)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("good").isNotNull())
    told = first_by_hash(known.groupBy("doc_id").agg(F.min("good").alias("good")), "doc_id", most)
    some = first_by_hash(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", 2 * most).distinct()
    free = some.join(known.join(F.broadcast(some), "doc_id", "left_semi").select("doc_id").distinct(), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = told.union(free.select("doc_id", F.lit(None).cast("int")))  # at most 2 * most ids
    rows = docs.join(F.broadcast(picked), "doc_id").select("text", "source", "lang", F.col("n_chars").cast("long"), F.col("good").cast("long"), "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).drop("doc_id")
    got = rows.mapInArrow(_features, "source string, lang string, n_chars long, good long, words binary, dense binary").toArrow()
    label = np.array([-1 if g is None else g for g in got.column("good").to_pylist()], np.int64)
    is_told = label >= 0
    y = (label[is_told] > 0).astype(np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), None, None, None, (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0)
    sets = [np.frombuffer(w, np.uint64) for w in got.column("words").to_pylist()]
    d = np.array([np.frombuffer(x) for x in got.column("dense").to_pylist()])
    about = meta(got.column("source").to_pylist(), got.column("lang").to_pylist(), got.column("n_chars").to_pylist())
    order = np.array([zlib.crc32(s.tobytes()) for s in sets]) % 4  # a quarter of the labelled rows calibrates
    fit, hold = is_told & (order > 0), is_told & (order == 0)
    if len(set(label[fit])) < 2 or len(set(label[hold])) < 2:
        fit = hold = is_told
    vocabulary = choose_words([s for s, f in zip(sets, fit, strict=True) if f], (label[fit] > 0).astype(np.int64))
    content = np.column_stack([presence(vocabulary, np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets)), d.astype(np.float32)])
    del sets, got  # the driver's memory is small
    views = co_train(content[fit], about[fit], label[fit] > 0, (content[~is_told], about[~is_told]))
    t = (label[hold] > 0).astype(float)
    logits = [v.logit(x[hold])[:, None] for v, x in zip(views, (content, about), strict=True)]
    platt = tuple(Logistic.fit(z, t) for z in logits)
    both = Logistic.fit(np.column_stack([p.logit(z) for p, z in zip(platt, logits, strict=True)]), t)
    return Model(vocabulary, views, platt, both, float(y.mean()))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            about = meta(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            out = [np.zeros(batch.num_rows) for _ in range(3)]
            for i, j, h, rows, d in _parts(batch):
                content = np.column_stack([presence(model.vocabulary, h, rows, j - i), d])
                for a, s in zip(out, model.score(content, about[i:j]), strict=True):
                    a[i:j] = s
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], *map(pa.array, out)], [*batch.schema.names[4:], "p_content", "p_metadata", "score"])
    return run


def classify(docs: DataFrame, model: Model, threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """The columns of docs (all with keep_text, else doc_id alone), p_content, p_metadata, score (of being good, 0 to 1) and keep.

    docs has doc_id and text; source, lang and n_chars count as null where it lacks them. Null text is empty. Each row is scored
    for itself, so repeated rows and null ids make no difference; columns named like the results are replaced."""
    new = ("p_content", "p_metadata", "score", "keep")
    docs = docs.drop(*new)
    about = [F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    own = docs if keep_text else docs.select("doc_id")
    fields = [(f"_{i}", f.dataType.simpleString()) for i, f in enumerate(own.schema)]
    rows = docs.select(F.col("text").alias("t"), about[0].alias("s"), about[1].alias("l"), about[2].alias("n"), *[F.col(f"`{c}`").alias(a) for c, (a, _) in zip(own.columns, fields, strict=True)])
    out = rows.mapInArrow(_score(model), ", ".join(f"{a} {t}" for a, t in fields) + ", p_content double, p_metadata double, score double")
    return out.toDF(*own.columns, *new[:3]).withColumn("keep", F.col("score") >= threshold)


def good_labels(labels: DataFrame) -> DataFrame:
    """Good is high quality and not toxic; null quality is no label, null toxic is not toxic."""
    return labels.select("doc_id", F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
