"""Connected groups of linked ids, from postings of keys that linked ids share. DataFrame code only.

Within a key's postings not all pairs are made. First each id meets the key's hub, the id that shares most keys with
most others (of a text and its near copies, the text itself or the one nearest to it); verified links join ids to
groups. A pair within one group can't change the groups any more, so the second step makes only pairs across groups: each
posting outside its key's main group meets the key's other postings. Together the steps lose no connection, and a key that
thousands of near copies share costs thousands of pairs, not millions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for each id of edges(a, b): the least id of its connected component.

    Alternating large and small stars; each round is three aggregations and two equi-joins, and only whether it was the last
    reaches the driver. Null ends are left out, loops and repeated edges do no harm.
    """
    e = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(rounds):
        ends = e.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break  # stars alone: each end points to one centre, and no centre points on
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small_ = large.join(down, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpoint(small_.union(down.select("hi", "m")).distinct())
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("comp")).union(e.select(F.col("lo"), F.col("lo")).distinct())


def linked_groups(postings: DataFrame, attrs: list[str], fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], verify: Callable[[DataFrame], DataFrame], enough: Callable[[Column, Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups(id, comp), links(a, b)): groups of two ids or more.

    postings(key, id, m, *attrs) has each (key, id) once, n among its attrs, and should be a checkpoint or stored; m is about how many ids the
    key has. fits(x, y) is a cheap necessary
    condition of a link on the attrs of two postings; enough(keys, lo, hi) one on the number of keys that a pair shares and the
    smaller and larger n. verify(pairs(a, b)) returns the pairs that link, a < b, and judges each pair once. The first step counts only
    the keys whose hub is in the pair; a pair that fails enough() there is put off to the second, which counts all of its keys.
    """
    def paired(left: DataFrame, right: DataFrame, *cond: Column) -> DataFrame:
        own = fits(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
        for c in (F.col("x_id") != F.col("y_id"), *cond):
            own = own & c
        rows = left.join(right, "key").where(own).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.least("x_n", "y_n").alias("lo"), F.greatest("x_n", "y_n").alias("hi"))
        if enough is None:
            return rows.select("a", "b").distinct()
        return rows.groupBy("a", "b", "lo", "hi").agg(F.count("*").alias("keys")).where(enough(F.col("keys"), F.col("lo"), F.col("hi"))).select("a", "b")

    cols = ["id", *attrs]
    side = lambda d, s: d.select("key", *[F.col(c).alias(f"{s}_{c}") for c in d.columns if c != "key"])
    central, _ = small(checkpoint(postings.groupBy("id").agg(F.sum("m").alias("weight"))))
    weighted = postings.join(central, "id")
    hubs = weighted.groupBy("key").agg(F.max(F.struct("weight", *cols)).alias("h")).select("key", *[F.col(f"h.{c}").alias(f"y_{c}") for c in cols])
    tried = checkpoint(paired(side(postings, "x"), hubs))
    links = checkpoint(verify(tried))
    groups = components(links)

    of_id, _ = small(checkpoint(groups))
    marked = postings.join(of_id, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("key", *cols, "comp")
    split = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = stored(marked.join(split.hint("shuffle_hash"), "key"), "mixed")  # the keys that more than one group has: the fewer
    main = mixed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    mixed = mixed.join(main, "key")
    rest = side(mixed.where(F.col("comp") != F.col("main")).drop("main"), "x")
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    across = checkpoint(paired(rest, side(mixed, "y"), F.col("x_comp") != F.col("y_comp"), once).join(tried, ["a", "b"], "left_anti"))
    if across.isEmpty():
        return groups, links
    links = links.union(checkpoint(verify(across)))
    return components(links), links
