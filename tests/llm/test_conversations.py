"""Conversation repair against a search over all edits, in one range and in many."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from loomspan.llm import conversations

WHITE = "\x20\x09-\x0D"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 1:
            text = ""
        elif case == 2:
            text = re.sub("[.!?]", "", text)
        elif case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not re.search(f"[^{WHITE}]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif re.search(f"([^{WHITE}])[{WHITE}]*\\Z", text)[1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired lines) by a search over all edits of rows[i:] with the roles so far as state."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for initial, name in (("u", "user"), ("a", "assistant")):
                if initial in follow[last]:
                    c, a, t = best(i, initial, inserted + 1)
                    ways.append((5 + c, "I" + a, (f"{name}:", *t)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            ways.append((2 + c, "D" + a, t))
            if found[i] in ("", "truncated"):
                more = 5 if found[i] else 0
                if role[:1] in follow[last]:
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((more + c, "K" + a, (f"{role}:{text}", *t)))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in follow[last]:
                        c, a, t = best(i + 1, initial, 0)
                        ways.append((1 + more + c, "R" + a, (f"{name}:{text}", *t)))
        return min(ways, key=lambda w: w[:2], default=(float("inf"), "", ()))

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def plain(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        found, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest(own, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, length):
    r, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(r.randint(1, length)):
            text = r.choice(["Well.", "So?", "no mark", "", " ", None, "Yes!\n ", "A\u00a0", "\u00a0", ".", "same.", "same.", "é" * 70 + "."])
            rows.append((conv, r.choice([turn, turn, turn, turn // 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), text))
    return rows


KINDS = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", (1, 2))
def test_equals_a_search_over_all_edits(spark, seed):
    rows = made(seed, 60, 9) + [(None, 0, "user", "Hm."), (None, None, None, None), (10**12, 1, "assistant", "x" * 30000 + ".")]
    rows += rows[:20]
    d = spark.createDataFrame(rows, KINDS).repartition(3)
    for c in ("copy", "kind", "_pos", "case", "first"):
        d = d.withColumn(c, d["role"])
    assert got(conversations.repair_damaged(d)) == plain(rows, damaged(rows))
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(conversations.repair(d)) == plain(rows, whole)


def test_a_conversation_over_many_ranges(spark):
    """One holds most rows, so it's cut, and its repaired text comes in pieces."""
    rows = [(7, t, r, x) for _, t, r, x in made(3, 12, 30)] + made(4, 12, 6) + [(None, t, "user", f"{t}.") for t in range(60)]
    rows += [(7, 5, "user", "again.")] * 100
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        d = spark.createDataFrame(rows, KINDS).repartition(5)
        found = got(conversations.repair_damaged(d, piece=50))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == plain(rows, damaged(rows))


def test_nothing_left_and_nothing_there(spark):
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    d = spark.createDataFrame([(gone, 0, "user", "Hello.")], KINDS)
    assert got(conversations.repair_damaged(d)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(conversations.repair_damaged(d.limit(0))) == []


def test_the_table_stays_small():
    """Any conversation meets few cost vectors: the automaton is finite once normalised."""
    auto, r = conversations.Repair(), random.Random(5)
    for _ in range(300):
        auto.scan([(r.choice("suax"), r.randrange(4)) for _ in range(200)], auto.end)
    assert len(auto.vectors) < 50 and len(auto.table) <= 9 * len(auto.vectors)
