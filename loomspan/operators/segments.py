"""Running values of a group in order, when a group may hold any share of all rows.

A window partitioned by the group would put a large one into one task. Here rows are cut into ranges of (group, order) of about equal size; a
group's rows in a range are a segment. Of each segment that isn't its group's only one, a summary row goes to a small table (two a range at
most: a range's first and last group alone can go on elsewhere), a window over that table carries summaries from segment to segment, and the
carried value is joined to the rows of the segment, whose own window holds a range's rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpoint

#: The number of a row's range, and its place there.
RANGE, PLACE = "_range", "_place"


class Segments:
    """rows in ranges of (by, order). Rows that tie in order may come in either order; their number within a range is fixed once cut."""

    def __init__(self, rows: DataFrame, by: str, *order: str | Column):
        ranges = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
        self.rows = checkpoint(ranges.withColumn(PLACE, F.monotonically_increasing_id()).withColumn(RANGE, F.shiftright(PLACE, 33)))
        self.by = by

    def _carried(self, summary: Column, carry: Callable[[Column, Window], Column], forward: bool) -> DataFrame:
        """(range, group, carried) of the segments of groups with more than one: what carry() makes of the summaries before, or behind if not forward."""
        ends = self.rows.groupBy(RANGE).agg(F.min_by(self.by, PLACE).alias("a"), F.max_by(self.by, PLACE).alias("z"))
        met = ends.select(RANGE, F.explode(F.array_distinct(F.array("a", "z"))).alias("_group")).groupBy("_group").agg(F.count("*").alias("n")).where("n > 1").select("_group")
        own = self.rows.join(F.broadcast(met), F.col(self.by).eqNullSafe(F.col("_group")))
        own = own.groupBy("_group", RANGE).agg(summary.alias("_summary"))
        w = Window.partitionBy("_group").orderBy(F.col(RANGE) if forward else F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
        return own.select(F.col(RANGE).alias("_r"), "_group", carry(F.col("_summary"), w).alias("_carried"))

    def scan(self, name: str, summary: Column, carry: Callable[[Column, Window], Column], merge: Callable[[Column, Window], Column], forward: bool = True, current: bool = False) -> Segments:
        """The rows with a column `name`. summary is an aggregate of a segment, carry(summary, w) combines those of the segments before, and
        merge(carried, w) gives a row's value from that and a window w over the rows of its segment before it (with itself, if current). Not forward, "before" is behind."""
        carried = F.broadcast(self._carried(summary, carry, forward))  # two rows a range at most
        w = Window.partitionBy(RANGE, self.by).orderBy(PLACE if forward else F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        rows = self.rows.join(carried, (F.col(RANGE) == F.col("_r")) & F.col(self.by).eqNullSafe(F.col("_group")), "left")
        out = object.__new__(Segments)
        out.by, out.rows = self.by, rows.withColumn(name, merge(F.col("_carried"), w)).drop("_r", "_group", "_carried")
        return out

    def most_before(self, value: str, name: str) -> Segments:
        """The largest value of the rows before; null without one."""
        return self.scan(name, F.max(value), lambda s, w: F.max(s).over(w), lambda c, w: F.greatest(c, F.max(value).over(w)))

    def last_before(self, value: str, name: str, current: bool = False) -> Segments:
        """The last value that isn't null of the rows before."""
        own = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(PLACE)))
        return self.scan(name, own, lambda s, w: F.last(s, ignorenulls=True).over(w), lambda c, w: F.coalesce(F.last(value, ignorenulls=True).over(w), c), current=current)

    def first_behind(self, value: str, name: str, current: bool = False) -> Segments:
        """The first value that isn't null of the rows behind."""
        own = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(PLACE)))
        return self.scan(name, own, lambda s, w: F.last(s, ignorenulls=True).over(w), lambda c, w: F.coalesce(F.last(value, ignorenulls=True).over(w), c), forward=False, current=current)

    def sum_before(self, value: Column, name: str) -> Segments:
        """The sum of a number over the rows before, 0 for the first; nulls count 0."""
        held, zero = F.coalesce(value, F.lit(0)), F.lit(0)
        return self.scan(name, F.sum(held), lambda s, w: F.sum(s).over(w), lambda c, w: F.coalesce(c, zero) + F.coalesce(F.sum(held).over(w), zero))

    def number(self, name: str) -> Segments:
        """The count of rows before, from 0."""
        return self.sum_before(F.lit(1).cast("long"), name)

    def cut_by_size(self, size: str, most: int, name: str) -> DataFrame:
        """The rows with `name`, a number from 0 of the runs that each group is cut into: a row begins a run where it would take the one before over `most`.

        Where a run ends depends on where it began, so segments can't be cut alone. Each range's first and last segment tells, for each row that
        may begin its first run, with what its last one ends; these tables, of the rows of one run's size, are followed from range to range as a stream, and
        then all segments are cut at once. A row larger than `most` is a run by itself; sizes aren't null or negative."""
        kind = dict(self.rows.dtypes)[self.by]
        narrow = self.rows.select(RANGE, self.by, F.col(size).cast("long").alias("_size"))
        tables = narrow.mapInArrow(_ends_by_start(most), f"_range long, _group {kind}, n long, total long, ends binary, held binary, runs binary")
        followed = tables.repartition("_group").sortWithinPartitions("_group", "_range").mapInArrow(_followed(most), f"_range long, _group {kind}, held long, runs long")
        begun = {(r["_range"], r["_group"]): (r.held, r.runs) for r in followed.collect()}  # two a range at most
        kinds = T.StructType([*self.rows.schema.fields, T.StructField(name, T.IntegerType())])
        return self.rows.mapInArrow(_cut(begun, self.rows.columns.index(RANGE), self.rows.columns.index(self.by), self.rows.columns.index(size), most, name), kinds)

    def plain(self) -> DataFrame:
        return self.rows.drop(RANGE, PLACE)


def _runs_of(keys: pa.Array) -> list[tuple[object, int, int]]:
    """(key, begin, end) of the runs of equal keys."""
    if not len(keys):
        return []
    codes = pa.compute.dictionary_encode(keys, null_encoding="encode").combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys.dictionary_encode(null_encoding="encode")
    at = codes.indices.to_numpy()
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return [(codes.dictionary[int(at[a])].as_py(), int(a), int(z)) for a, z in zip(begin, [*begin[1:], len(at)], strict=True)]


def _ends_by_start(most: int):
    """A range's first and last segment: its rows and their sum, and of each row that may begin the first run there, the sum up to its end, what the
    segment's last run then holds and the count of runs that begin."""
    def table(sizes: np.ndarray) -> tuple:
        ends = np.cumsum(sizes)
        begin = ends - sizes
        n = len(sizes)
        after = np.append(np.maximum(np.searchsorted(ends, begin + most, "right"), np.arange(n) + 1), n)
        last, runs = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
        while (go := after[last] < n).any():  # each step looks twice as far
            step = after[last]
            last, runs = np.where(go, last[step], last), np.where(go, runs + runs[step], runs)
        may = int(np.searchsorted(begin, most, "right"))
        return n, int(ends[-1]), ends[:may].tobytes(), (ends[-1] - begin[last[:may]]).tobytes(), runs[:may].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own = pa.Table.from_batches(batches)
        range_, sizes = own.column(0)[0].as_py(), own.column(2).to_numpy()
        found = _runs_of(own.column(1))
        found = found if len(found) < 3 else [found[0], found[-1]]
        cols = list(zip(*[table(sizes[a:z]) for _, a, z in found], strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([range_] * len(found)), pa.array([g for g, _, _ in found], own.schema.field(1).type), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["_range", "_group", "n", "total", "ends", "held", "runs"])
    return run


def _followed(most: int):
    """(range, group, held, runs): what the open run holds in front of each segment, -1 without one, and how many have begun."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield [b.column(c)[i].as_py() for c in range(7)] + [b.schema.field(1).type]
        for group, own in groupby(rows(), key=lambda r: r[1]):
            held, begun, out = -1, 0, []
            for range_, _, n, total, ends, ends_held, runs, kind in own:
                out.append((range_, held, begun))
                k = 0 if held < 0 else int(np.searchsorted(np.frombuffer(ends, np.int64), most - held, "right"))
                if k == n:
                    held += total
                else:
                    held, begun = int(np.frombuffer(ends_held, np.int64)[k]), begun + int(np.frombuffer(runs, np.int64)[k])
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in out], pa.int64()), pa.array([group] * len(out), kind), pa.array([h for _, h, _ in out], pa.int64()), pa.array([b for _, _, b in out], pa.int64())], ["_range", "_group", "held", "runs"])
    return run


def _cut(begun: dict, range_at: int, by_at: int, size_at: int, most: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, no = (), -1, -1
        for b in batches:
            out = np.zeros(b.num_rows, np.int32)
            sizes = b.column(size_at).to_numpy(zero_copy_only=False)
            for key, a, z in _runs_of(b.column(by_at)):
                if (key,) != group:
                    group = (key,)
                    held, runs = begun.get((b.column(range_at)[0].as_py(), key), (-1, 0))
                    no = runs - 1
                ends = np.cumsum(sizes[a:z])
                at = 0
                while at < z - a:
                    done = int(ends[at - 1]) if at else 0
                    end = at if held < 0 else int(np.searchsorted(ends, done + most - held, "right"))
                    end = max(end, at)
                    out[a + at : a + end] = no
                    if end < z - a:  # this row begins a run
                        no, held = no + 1, int(sizes[a + end])
                        out[a + end] = no
                        at = end + 1
                    else:
                        held += int(ends[-1]) - done
                        at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])
    return run


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): of each group's values that aren't null, the middle one, or the mean of both. Ranks are counted by segments, so no group's values meet."""
    known = rows.select(by, value).where(F.col(value).isNotNull())
    n = known.groupBy(by).agg(F.count("*").alias("_n"))
    ranked = Segments(known, by, value).number("_i").plain()
    n = n.withColumnRenamed(by, "_group")
    middle = (F.col("_i") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_i") == F.floor(F.col("_n") / 2))
    return ranked.join(n, F.col(by).eqNullSafe(F.col("_group"))).where(middle).groupBy(by).agg(F.avg(value).alias("median"))
