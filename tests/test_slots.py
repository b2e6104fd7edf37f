"""Slots with functions that fail, hang and lie."""

import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomspan.operators import slots
from loomspan.operators.slots import Slot

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def shout(prompts):
    return [p.upper() for p in prompts]


def picky(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("overloaded")
    return [f"ok {p}" for p in prompts]


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, prompt string")


def test_a_bad_prompt_costs_its_own_reply_alone(spark, tmp_path):
    slot = Slot("picky", picky, batch=4, tries=2, pause=0.0)
    got = {r.i: (r.reply, r.failed) for r in slots.replies(rows(spark, "a", "bad", "b", None, "a", ""), slot, str(tmp_path)).collect()}
    assert got == {0: ("ok a", None), 1: (None, "RuntimeError: overloaded"), 2: ("ok b", None), 3: (None, None), 4: ("ok a", None), 5: ("ok ", None)}


def test_hanging_and_short_replies_fail(spark, tmp_path):
    hang = Slot("hang", lambda ps: time.sleep(30) or ps, batch=2, tries=1, seconds=0.3)
    began = time.time()
    assert {r.failed for r in slots.replies(rows(spark, "a"), hang, str(tmp_path)).collect()} == {"TimeoutError: no reply in 0.3 s"} and time.time() - began < 25
    short = Slot("short", lambda ps: ps[:1] if len(ps) > 1 else [], batch=8, tries=1)
    assert {r.failed for r in slots.replies(rows(spark, "a", "b"), short, str(tmp_path)).collect()} == {"ValueError: 0 replies to 1 prompts"}


def test_replies_are_kept_and_failures_asked_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    note = f"{log}/"

    def counting(prompts):
        from uuid import uuid4

        for p in prompts:
            if p == "late" and not any(open(note + x).read() == "late" for x in __import__("os").listdir(note)):
                open(note + uuid4().hex, "w").write(p)
                raise RuntimeError("not yet")
            open(note + uuid4().hex, "w").write(p)
        return [p + "!" for p in prompts]

    slot = Slot("count", counting, batch=1, tries=1)
    first = {r.prompt: r.reply for r in slots.replies(rows(spark, "x", "y", "x", "late"), slot, f"{tmp_path}/kept", waves=3).collect()}
    assert first == {"x": "x!", "y": "y!", "late": None}
    again = slots.replies(rows(spark, "y", "x", "z", "late"), slot, f"{tmp_path}/kept").collect()
    assert {r.prompt: (r.reply, r.failed) for r in again} == {p: (p + "!", None) for p in ("x", "y", "z", "late")}
    seen = sorted(f.read_text() for f in log.iterdir())
    assert seen == ["late", "late", "x", "y", "z"]
    other = Slot("count", shout, version="2")
    assert [r.reply for r in slots.replies(rows(spark, "x"), other, f"{tmp_path}/kept").collect()] == ["X"]


def fails(prompts):
    raise RuntimeError("down")


DOWN = Slot("down", fails, tries=1)


def test_without_a_reply_a_question_stays_as_it_is(spark, tmp_path):
    d = spark.createDataFrame([(1, " what is namaz "), (2, "fine")], "i int, question string")
    good = Slot("refine", lambda ps: [f'"{p.strip().replace("namaz", "salat")}"\nmore' if "namaz" in p else p for p in ps])
    got = {r.i: (r.refined, r.changed) for r in slots.refined(d, good, str(tmp_path)).collect()}
    assert got == {1: ("what is salat", True), 2: ("fine", False)}
    assert [r.refined for r in slots.refined(d, DOWN, str(tmp_path)).orderBy("i").collect()] == [" what is namaz ", "fine"]
    parts = Slot("parts", lambda ps: ["1. one?\n- two?\n\n" if "fine" not in p else "only" for p in ps])
    assert [r.parts for r in slots.decomposed(d, parts, str(tmp_path)).orderBy("i").collect()] == [["one?", "two?"], ["fine"]]
    assert [r.parts for r in slots.decomposed(d, DOWN, str(tmp_path)).orderBy("i").collect()] == [[" what is namaz "], ["fine"]]


def test_without_a_reply_nothing_is_supported(spark, tmp_path):
    d = spark.createDataFrame([(1, [("a", ["p", "q"]), ("b", [])]), (2, [])], "i int, claims array<struct<statement:string,passages:array<string>>>")
    judge = Slot("judge", lambda ps: ["1: supported\n2: unsupported" if "- p\n- q" in p and "- no evidence" in p else "" for p in ps])
    assert [r.supported for r in slots.judged(d, judge, str(tmp_path)).orderBy("i").collect()] == [[True, False], []]
    assert [r.supported for r in slots.judged(d, DOWN, str(tmp_path)).orderBy("i").collect()] == [[False, False], []]


def test_without_a_grounded_reply_an_answer_stays_extractive(spark, tmp_path):
    passage = "the rope holds fast in the storm"
    d = spark.createDataFrame([(1, "write", [passage]), (2, "lie", [passage]), (3, "write", []), (4, "", [passage])], "answer_id int, prompt string, passages array<string>")
    writer = Slot("writer", lambda ps: ["The rope holds fast in the storm [1]." if p == "write" else "Elephants dance on distant moons [7]." if p == "lie" else "  " for p in ps])
    got = {r.answer_id: (r.text, r.grounded) for r in slots.written(d, writer, str(tmp_path)).collect()}
    assert got == {1: ("The rope holds fast in the storm [1].", True), 2: ("Elephants dance on distant moons [7].", False), 3: (None, False), 4: (None, False)}
    down = {r.answer_id: (r.text, r.grounded, r.failed) for r in slots.written(d, DOWN, str(tmp_path)).collect()}
    assert down == {i: (None, False, None if i == 3 else "RuntimeError: down") for i in (1, 2, 3, 4)}
    assert slots.written(d, DOWN, str(tmp_path)).where(F.col("text").isNotNull()).count() == 0
