"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

Edits are arcs of a weighted automaton of four states (nothing kept yet, after a system turn, after a user turn, after an assistant turn). It is
determinised lazily: the cost of reaching a legal end from each state is a vector; less its least value, it's a state of the deterministic
automaton, and the step from one such state over a row's symbol is looked up in a table that is filled as new ones appear. A scan of that table from a
conversation's last row to its first gives the cost. The trace then goes back along the arcs that are tight, those that lose nothing of
the cost, and so from the first row to the last: there the least letter can be chosen at each arc, which gives the ASCII-least audit.

Rows are sorted by conversation and place into ranges of about equal size, so a conversation of any length spreads over as many tasks as it
needs. Of each range, its first and last conversation alone may go on in another: for these, a range's scan is made from each of the four
states (a min-plus matrix), the driver folds these matrices, at most two a range, and hands each range the costs behind it and the state before it.
Nothing is gathered by conversation but its audit and, in pieces of bounded size, the stream of its hash: SHA-256 can't be cut, so
the repaired text of one conversation passes through one task, which holds a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, numbered

INF = float("inf")
#: Fixed values of the contract: what edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Automaton states: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state that a kept initial leads to, and the next role that is legal.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
LEGAL_END = (0, INF, INF, 0)
ROLE = {2: "user", 3: "assistant"}
#: Kinds of rows, the first that holds.
SOUND, CUT, BLANK, AGAIN = 0, 1, 2, 3
SPACE = r"[\x20\x09-\x0D]"
#: Characters of repaired text in a piece of a conversation that more than one range holds.
PIECE = 1 << 20


class Repair:
    """The automaton, its determinised states and their table."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.table: dict[tuple, tuple[int, float]] = {}
        self.letters: dict[tuple, tuple[str, int]] = {}
        self.end, self.end_cost = self.state(self.insert(LEGAL_END))

    @staticmethod
    def insert(v: tuple) -> tuple:
        """With empty turns inserted in front: at most three in a row, for then the state is one that was passed."""
        v = list(v)
        for _ in range(3):
            v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
        return tuple(v)

    def state(self, v: tuple) -> tuple[int, float]:
        """The number of a cost vector less its least value, and that value."""
        low = min(v)
        v = tuple(x - low for x in v)
        if v not in self.known:
            self.known[v] = len(self.vectors)
            self.vectors.append(v)
        return self.known[v], low

    @staticmethod
    def edits(q: int, initial: str, kind: int) -> Iterator[tuple[str, float, int]]:
        """(letter, cost, state after) of what can be done with a row in state q, but for inserting before it."""
        yield "D", DELETE, q
        if kind <= CUT:
            more = TRUNCATED if kind == CUT else 0
            if initial in KEEP[q]:
                yield "K", more, KEEP[q][initial]
            yield "R", REROLE + more, NEXT[q]

    @staticmethod
    def sort(initial: str, kind: int) -> str:
        """Rows alike to the automaton, nine sorts of them."""
        return "D" if kind > CUT else f"{kind}{initial if initial in ('s', 'u', 'a') else ''}"

    def step(self, s: int, initial: str, kind: int) -> tuple[int, float]:
        """The state in front of a row, from that behind it."""
        key = s, self.sort(initial, kind)
        if key not in self.table:
            v = self.vectors[s]
            self.table[key] = self.state(self.insert(tuple(min(c + v[t] for _, c, t in self.edits(q, initial, kind)) for q in range(4))))
        return self.table[key]

    def scan(self, rows: list[tuple[str, int]], s: int) -> tuple[list[int], float]:
        """States in front of each row and behind the last, and the cost that was taken off them."""
        states, total = [s], 0.0
        for initial, kind in reversed(rows):
            s, low = self.step(s, initial, kind)
            states.append(s)
            total += low
        return states[::-1], total

    def arc(self, here: int, behind: int, q: int, initial: str, kind: int) -> tuple[str, int]:
        """The least letter of a tight arc from q in front of a row: itself an insert, or an edit of the row."""
        key = here, behind, q, self.sort(initial, kind)
        if key not in self.letters:
            a, b, low = self.vectors[here], self.vectors[behind], self.step(behind, initial, kind)[1]
            tight = [(x, t) for x, c, t in self.edits(q, initial, kind) if c + b[t] == a[q] + low]
            if INSERT + a[NEXT[q]] == a[q]:
                tight.append(("I", NEXT[q]))
            self.letters[key] = min(tight)
        return self.letters[key]

    def trace(self, rows: list[tuple[str, int]], states: list[int], q: int) -> tuple[list[tuple[str, int]], int]:
        """(letter, state after) of each edit from state q, and the state behind the rows. Inserts behind the last row belong to close()."""
        out = []
        for (initial, kind), here, behind in zip(rows, states, states[1:], strict=False):
            letter = "I"
            while letter == "I":
                letter, q = self.arc(here, behind, q, initial, kind)
                out.append((letter, q))
        return out, q

    @staticmethod
    def close(q: int) -> list[tuple[str, int]]:
        """The inserts that a conversation ends with."""
        out = []
        while LEGAL_END[q]:
            q = NEXT[q]
            out.append(("I", q))
        return out


def damage(rows: DataFrame) -> DataFrame:
    """conversations with the contract's damage: a row dropped, emptied, without marks, doubled (copy 1 is the second) or said by the user. Null fields
    are one space, conv_id and turn in the hashed key alone. Other columns stay."""
    space = F.lit(" ")
    case = F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20))
    text = F.coalesce(F.col("text"), space)
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    said = F.when(case == 4, "user").otherwise(F.coalesce(F.col("role"), space))
    left = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(case != 0).select(*[said.alias(c) if c == "role" else left.alias(c) if c == "text" else F.col(c) for c in rows.columns if c != "copy"], copies.alias("copy"))


def _kinds(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, _rid, copy) with each row's first fault as `kind`."""
    text = F.col("text")
    last = F.regexp_extract(text, rf"(?s)([^\x20\x09-\x0D]){SPACE}*\z", 1)
    # equal rows meet as their least place alone, so a turn that a third of all rows repeat meets in no task
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "_rid", "copy")
    first = rows.select("conv_id", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit("g"), "text", "role").alias("g"), place.alias("p")).groupBy("conv_id", "h", "g").agg(F.min("p").alias("p"))
    first = first.select("p._rid", "p.copy", F.lit(True).alias("first"))
    kind = F.when(last == "", BLANK).when(F.col("first").isNull(), AGAIN).when(~last.rlike("[.!?]"), CUT).otherwise(SOUND)
    return rows.join(first, ["_rid", "copy"], "left").select("conv_id", "turn", "role", "text", "_rid", "copy", kind.alias("kind"))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, object, Iterator[tuple]]]:
    """(range, conversation, its rows) of rows that come sorted."""
    def rows():
        for b in batches:
            yield from zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names], strict=True)
    for (part, conv), own in groupby(rows(), key=lambda r: (r[0] >> 33, r[1])):
        yield part, conv, own


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's first and last conversation."""
    found = []
    for part, conv, own in _runs(batches, ["_pos", "conv_id"]):
        found = [*found[:1], (part, conv)]
        for _ in own:
            pass
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["part", "conv"])


def _matrices(split: set):
    """Of the conversations that more than one range holds, each range's costs from state to state and the turns and roles at its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, out = Repair(), []
        for part, conv, own in _runs(batches, ["_pos", "conv_id", "turn", "initial", "kind"]):
            if conv in split:
                rows = list(own)
                pairs, costs = [(r[3], r[4]) for r in rows], []
                for t in range(4):
                    s, low = auto.state(auto.insert(tuple(0 if q == t else INF for q in range(4))))
                    states, more = auto.scan(pairs, s)
                    costs += [low + more + x for x in auto.vectors[states[0]]]
                out.append((part, conv, costs, rows[0][2], rows[0][3], rows[-1][2], rows[-1][3]))
            else:
                for _ in own:
                    pass
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "conv", "costs", "turn_a", "role_a", "turn_z", "role_z"])
    return run


def _exits(behind: dict):
    """Of the same, the state that each range is left in, by the state that it is entered in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, out = Repair(), []
        for part, conv, own in _runs(batches, ["_pos", "conv_id", "initial", "kind"]):
            if (part, conv) in behind:
                pairs = [(r[2], r[3]) for r in own]
                states, _ = auto.scan(pairs, auto.state(behind[part, conv])[0])
                out.append((part, conv, [auto.trace(pairs, states, q)[1] if auto.vectors[states[0]][q] < INF else -1 for q in range(4)]))
            else:
                for _ in own:
                    pass
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "conv", "after"])
    return run


FOUND = "conv_id long, part long, k int, n_turns long, least long, most long, blank long, duplicate long, truncated long, illegal long, cost double, audit string, digest string, piece string"


def _repair(carry: dict, most: int):
    """A row for each conversation of a range. Of those that go on elsewhere, without digest, and more rows with further pieces of its text.

    carry: of the latter, by range and conversation: the costs behind it, the state it is entered in, its first turn's predecessor (a tuple; empty at the
    beginning), the role before it, whether it's the last, and the conversation's cost if it's the first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, out, size = Repair(), [], 0

        def batch():
            cols = list(zip(*out, strict=True)) if out else [()] * 14
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.float64(), *[pa.string()] * 3]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in FOUND.split(", ")])
            out.clear()
            return made

        for part, conv, own in _runs(batches, ["_pos", "conv_id", "turn", "initial", "kind", "role", "text"]):
            rows = list(own)
            pairs = [(r[3], r[4]) for r in rows]
            behind, q, before, role, last, cost = carry.get((part, conv), (None, 0, (), None, True, 0.0))
            states, low = auto.scan(pairs, auto.end if behind is None else auto.state(behind)[0])
            if behind is None:
                cost = low + auto.end_cost + auto.vectors[states[0]][0]
            edits, q = auto.trace(pairs, states, q)
            if last:
                edits += auto.close(q)
            audit = "".join(x for x, _ in edits)
            left, texts = iter(rows), []
            for letter, after in edits:
                row = next(left) if letter != "I" else None
                if letter != "D":
                    texts.append(f"{row[5]}:{row[6]}" if letter == "K" else f"{ROLE[after]}:{row[6] if row else ''}")
            turns = {r[2] for r in rows} - {None, *before}
            known = [r[2] for r in rows if r[2] is not None]
            kinds = [r[4] for r in rows]
            initials = [*([] if role is None else [role]), *(r[3] for r in rows)]
            counts = [len(turns), min(known, default=None), max(known, default=None), kinds.count(BLANK), kinds.count(AGAIN), kinds.count(CUT), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit]
            if behind is None:
                out.append((conv, part, 0, *counts, sha256("\n".join(texts).encode()).hexdigest(), None))
            else:  # each line ends with a line break here; the last one's is taken off where the pieces meet
                k, piece, held = 0, [], 0
                for t in texts:
                    piece.append(t + "\n")
                    held += len(t) + 1
                    if held >= most:
                        out.append((conv, part, k, *counts, None, "".join(piece)))
                        k, piece, held = k + 1, [], 0
                        counts = [0, None, None, 0, 0, 0, 0, 0.0, ""]
                        yield batch()
                out.append((conv, part, k, *counts, None, "".join(piece)))
            size += len(rows)
            if size > 5000:
                size = 0
                yield batch()
        yield batch()
    return run


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, digest) of pieces that come sorted by conversation, range and number."""
    def pieces():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
    ids, digests = [], []
    for conv, own in groupby(pieces(), key=lambda r: r[0]):
        h, rest = sha256(), ""
        for _, piece in own:
            piece = rest + piece
            h.update(piece[:-1].encode())
            rest = piece[-1:]
        ids.append(conv)
        digests.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["c", "digest"])


def _through(costs: list[float], v: tuple) -> tuple:
    """Costs in front of a range, from those behind it: costs[4 * t + q] leads from q to t."""
    return tuple(min(costs[4 * t + q] + v[t] for t in range(4)) for q in range(4))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of rows(conv_id, turn, role, text).

    Rows go by turn, nulls first; rows of one turn by role, the first 64 characters of the text and its MD5; equal ones are alike in any
    order. Roles count by their first character, an empty one is never legal, and null fields are one space, so a null text is blank. A
    null conv_id is a conversation too. Texts and conversations may have any length. Other columns play no part; an empty table gives none.
    """
    space = F.lit(" ")
    own = numbered(rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    return _joined(rows.select("conv_id").distinct(), own.withColumn("copy", F.lit(0)), piece)


def repair_damaged(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """repair() of the rows after damage(); a conv_id of which nothing is left has zeros, an empty audit and the empty text's hash."""
    own = rows.select("conv_id", "turn", "role", "text")
    return _joined(own.select("conv_id").distinct(), damage(numbered(own)), piece)


def _joined(convs: DataFrame, rows: DataFrame, piece: int) -> DataFrame:
    by = ["conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64), F.md5("text"), "_rid", "copy"]
    ordered = _kinds(rows).repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = checkpoint(ordered.select(F.monotonically_increasing_id().alias("_pos"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "kind", "role", "text"))

    held: dict = {}
    for part, conv in sorted(map(tuple, ordered.select("_pos", "conv_id").mapInArrow(_ends, "part long, conv long").collect()), key=lambda x: x[0]):
        held.setdefault(conv, []).append(part)
    split = {c for c, own in held.items() if len(own) > 1}
    carry: dict = {}
    if split:
        narrow = ordered.select("_pos", "conv_id", "turn", "initial", "kind")
        met: dict = {}
        for r in sorted(narrow.mapInArrow(_matrices(split), "part long, conv long, costs array<double>, turn_a long, role_a string, turn_z long, role_z string").collect(), key=lambda r: r.part):
            met.setdefault(r.conv, []).append(r)
        behind, whole, auto = {}, {}, Repair()
        for conv, own in met.items():
            v = auto.insert(LEGAL_END)
            for r in reversed(own):
                behind[r.part, conv] = v
                v = _through(r.costs, v)
            whole[conv] = v[0]
        after = {(r.part, r.conv): r.after for r in narrow.mapInArrow(_exits(behind), "part long, conv long, after array<long>").collect()}
        for conv, own in met.items():
            q = 0
            for i, r in enumerate(own):
                carry[r.part, conv] = behind[r.part, conv], q, (own[i - 1].turn_z,) if i else (), own[i - 1].role_z if i else None, i == len(own) - 1, 0.0 if i else float(whole[conv])
                q = after[r.part, conv][q]
    found = ordered.mapInArrow(_repair(carry, piece), FOUND)
    counts = ["n_turns", "least", "most", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    if split:
        found = checkpoint(found)
        pieces = found.where("digest is null")
        sums = [F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost")]
        summed = pieces.groupBy("conv_id").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("part", "k", "audit"))).alias("audits"))
        summed = summed.withColumn("audit", F.array_join(F.transform("audits", lambda x: x["audit"]), ""))
        stream = pieces.select("conv_id", "part", "k", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").select("conv_id", "piece")
        hashed = stream.mapInArrow(_hash, "c long, digest string")
        found = found.where("digest is not null").select("conv_id", *counts).union(summed.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *counts))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps")
    return (convs.join(found.select(F.col("conv_id").alias("c"), *counts), F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .select("conv_id", gaps, none("blank"), none("duplicate"), none("truncated"), none("illegal"), none("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256")))
