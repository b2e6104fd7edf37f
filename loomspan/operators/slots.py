"""Slots for models of the caller's: a writer, a judge, a refiner and a decomposer, each a function of a batch of prompts.

Prompts are asked once however many rows have them, in batches within Arrow tasks. A batch that fails or takes too long is tried again, then prompt by
prompt, so that one bad prompt costs its own reply alone; a reply that never came is null with the reason beside it. Replies are kept in a folder of the
shared store as they come, wave by wave: what a wave has brought is never asked again, by a task that is lost later or by another run. No model comes with the
library, and what a missing reply means is fixed by role: a question stays as it is, a claim isn't supported, an answer stays extractive.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grounding import verdicts, verify_synthesis

REPLY = "key string, reply string, failed string"


@dataclass(frozen=True)
class Slot:
    """call(prompts) gives a reply for each, in order. name and version tell kept replies apart. seconds bound a call; pause is the first wait before another try, doubled
    each time."""
    name: str
    call: Callable[[list[str]], list[str]]
    version: str = "1"
    batch: int = 16
    tries: int = 3
    seconds: float = 60.0
    pause: float = 0.5


def within(seconds: float, call: Callable, *args):
    """call(*args), or TimeoutError; a call that hangs is left to itself."""
    got: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got.put((call(*args), None))
        except BaseException as e:  # handed to the caller's thread
            got.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = got.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no reply in {seconds} s") from None
    if error is not None:
        raise error
    return value


def attempt(slot: Slot, prompts: list[str]) -> tuple[list[str | None], str | None]:
    """Replies of a batch, or why there are none."""
    wait, why = slot.pause, ""
    for i in range(slot.tries):
        if i:
            time.sleep(wait)
            wait *= 2
        try:
            replies = list(within(slot.seconds, slot.call, list(prompts)))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [None if r is None else str(r) for r in replies], None
        except Exception as e:  # whatever a caller's model raises
            why = f"{type(e).__name__}: {e}"
    return [None] * len(prompts), why


def asked(slot: Slot, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, why there is none) of each prompt."""
    replies, why = attempt(slot, prompts)
    if why is None:
        return [(r, None if r is not None else "no reply") for r in replies]
    if len(prompts) == 1:
        return [(None, why)]
    return [x for p in prompts for x in asked(slot, [p])]


def _calls(slot: Slot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), slot.batch):
                own = b.iloc[i : i + slot.batch]
                found = asked(slot, own["prompt"].tolist())
                yield pd.DataFrame({"key": own["key"], "reply": [r for r, _ in found], "failed": [w for _, w in found]})
    return run


def replies(rows: DataFrame, slot: Slot, folder: str, waves: int = 1) -> DataFrame:
    """rows(..., prompt) with `reply` and `failed`: one of them is null. A null prompt isn't asked.

    Replies are kept below folder, by slot, version and the prompt's SHA-256; those of before are used, and failures are asked again. waves divides what is
    asked into as many jobs, each kept when done: how much a lost run can lose."""
    spark, path = rows.sparkSession, f"{folder}/{slot.name}-{slot.version}"
    keyed = rows.withColumn("_key", F.sha2("prompt", 256))

    def kept() -> DataFrame:
        try:
            return spark.read.schema(REPLY).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], REPLY)

    wanted = keyed.where(F.col("prompt").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.first("prompt").alias("prompt"))
    for wave in range(waves):
        own = wanted.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).join(kept().where("reply is not null").select("key"), "key", "left_anti")
        own.repartition("key").mapInPandas(_calls(slot), REPLY).write.mode("append").parquet(path)
    best = kept().groupBy("key").agg(F.min("reply").alias("reply"), F.max("failed").alias("failed"))  # a reply of any run, else why there's none
    out = keyed.join(best.withColumnRenamed("key", "_key"), "_key", "left")
    return out.withColumn("failed", F.when(F.col("reply").isNull(), F.col("failed"))).drop("_key")


def first_line(reply: Column) -> Column:
    """A reply's first line, without quotation marks around it; null, if that's empty."""
    line = X.collapse_edges(F.get(F.split(X.collapse_edges(reply), r"\r?\n"), F.lit(0)))
    return F.nullif(F.regexp_replace(line, '^"+|"+$', ""), F.lit(""))


def refined(questions: DataFrame, slot: Slot, folder: str) -> DataFrame:
    """questions(..., question) with `refined` and `changed`: the corrected question, or itself where there's no reply."""
    got = replies(questions.withColumn("prompt", F.col("question")), slot, folder)
    new = F.coalesce(first_line(F.col("reply")), F.col("question"))
    return got.select(*questions.columns, new.alias("refined"), (F.lower(new) != F.lower(X.collapse_edges(F.col("question")))).alias("changed"))


def decomposed(questions: DataFrame, slot: Slot, folder: str) -> DataFrame:
    """questions(..., question) with `parts`: a reply's lines without bullets or numbers, if there are two or more; else the question alone."""
    got = replies(questions.withColumn("prompt", F.col("question")), slot, folder)
    lines = F.filter(F.transform(F.split(F.coalesce("reply", F.lit("")), r"\r?\n"), lambda x: X.collapse_edges(F.regexp_replace(x, r"^\s*[-*\d.)]+\s*", ""))), lambda x: x != "")
    return got.select(*questions.columns, F.when(F.size(lines) > 1, lines).otherwise(F.array("question")).alias("parts"))


def judged(answers: DataFrame, slot: Slot, folder: str) -> DataFrame:
    """answers(..., claims array<struct<statement, passages array<string>>>) with `supported` array<boolean>: what no line of the reply names isn't supported, nor
    anything without a reply. An answer without claims isn't asked about."""
    one = lambda c, i: F.concat_ws("\n", F.concat(F.lit("Claim "), (i + 1).cast("string"), F.lit(": "), X.collapse_edges(F.coalesce(c["statement"], F.lit("")))),
                                   F.when(F.size(c["passages"]) > 0, F.array_join(F.transform(c["passages"], lambda p: F.concat(F.lit("- "), X.collapse_edges(p))), "\n")).otherwise("- no evidence"))
    prompt = F.when(F.size("claims") > 0, F.array_join(F.transform("claims", one), "\n\n"))
    got = replies(answers.withColumn("prompt", prompt), slot, folder)
    return got.select(*answers.columns, verdicts(F.coalesce("reply", F.lit("")), F.greatest(F.size("claims"), F.lit(0))).alias("supported"))


def written(pools: DataFrame, slot: Slot, folder: str) -> DataFrame:
    """pools(answer_id, prompt, passages array<string>) with `text`, `grounded` and `failed`: what the writer made of each pool, and whether all of it is
    grounded in the passages. Without a reply, or with an empty one, the text is null and not grounded; nothing is asked where there are no passages."""
    got = replies(pools.withColumn("prompt", F.when(F.size("passages") > 0, F.col("prompt"))), slot, folder)
    said = got.withColumn("text", F.nullif(X.collapse_edges(F.col("reply")), F.lit(""))).drop("reply", "prompt")
    checks = verify_synthesis(said.where("text is not null").select("answer_id", "text", "passages")).select("answer_id", "grounded")
    return said.join(checks, "answer_id", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
