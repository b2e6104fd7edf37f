"""Filter interaction audit: what each of five filters removes in each of their orders, from one CUBE.

A document's five failure flags and its part say all that any order of the filters does with it, so documents are reduced to counts by
flags, part and labels before anything else: at most 128 rows a part. Of CUBE(A, B, C, D, E, part), a grouping-set row whose selected flags are
all false counts the survivors of that set of filters. An order's step is a pair of such sets, the filters before it and those with it, so each
report row joins two survivor counts; nothing is simulated by document.

Only narrow rows are shuffled: an id, a 128-bit hash of the text and the flags. Copies are found by the least id of each hash, which partial aggregation
reduces where they are read, and a join on that id, so that a text which a third of all rows have meets in no task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """A to D: what fails a text by itself. Words are maximal runs of other than ASCII white space, case-sensitive."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct, size = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 3 * size.cast("long"), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E) for each row of docs. E: a smaller id has the same text; a null id is neither smaller nor larger than any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("g"), text).alias("g"), *[c.alias(k) for k, c in conditions(text).items()])
    # the least id of each text is the one that has no smaller; ids make the join's keys distinct, however many copies a text has
    first = own.where(F.col("id").isNotNull()).groupBy("h", "g").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    return own.join(first, ["id", "h", "g"], "left").select("id", "part", *"ABCD", (F.col("first").isNull() & F.col("id").isNotNull()).alias("E"))


def audit(flags: DataFrame, labels: DataFrame, filters: str = FILTERS, id_col: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each part, each order of
    the filters and each step of it.

    flags: (id, part) and a failure flag by each letter of filters, never null; other columns play no part. labels: (doc_id, quality, toxic); a
    document is good or toxic if any of its rows says 1, null ids label none. Repeated rows count each. A part without rows has no
    report; an empty table gives none.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id is not null and (quality = 1 or toxic = 1)").groupBy("id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    counted = (flags.select("id", "part", *filters).join(marks, "id", "left").groupBy("part", *filters)
               .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", zero)).alias("good"), F.sum(F.coalesce("toxic", zero)).alias("toxic")))
    cube = counted.cube(*filters, "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), *[F.grouping(c).alias(f"all_{c}") for c in (*filters, "part")])
    survived = cube.where("all_part = 0")
    for c in filters:
        survived = survived.where((F.col(f"all_{c}") == 1) | ~F.col(c))
    survived = survived.select("part", sum((F.lit(1 << i) * (1 - F.col(f"all_{c}")) for i, c in enumerate(filters)), F.lit(0)).cast("int").alias("subset"), "n", "good", "toxic")

    bit, whole = {c: 1 << i for i, c in enumerate(filters)}, (1 << len(filters)) - 1
    # a set that nothing survives has no row in the cube: each part gets all of its sets
    sets = survived.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(whole))).alias("subset"))
    sets = sets.join(survived, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])
    spark = flags.sparkSession
    # as many orders begin with a set, and then have the filter, as there are orders of the set and of those that follow
    pairs = [(s, s | bit[c], c, factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()), s == 0, s == whole - bit[c]) for c in filters for s in range(whole + 1) if not s & bit[c]]
    pairs = F.broadcast(spark.createDataFrame(pairs, "before int, after int, filter string, orders long, alone boolean, last boolean"))
    after = sets.select("part", F.col("subset").alias("after"), F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
    steps = (sets.join(pairs, sets.subset == pairs.before).join(after, ["part", "after"])
             .select("part", "before", "filter", "orders", "alone", "last", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost")))
    each = steps.groupBy("part", "filter").agg(F.max(F.when(F.col("alone"), F.col("removed"))).alias("fails"), F.max(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    orders = [("".join(o), k + 1, c, sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, c in enumerate(o)]
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before int"))
    return (steps.join(each, ["part", "filter"]).join(orders, ["before", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"))
