"""Selection in turn: groups take one component each in every pass, passing over those that repeat a chosen one.

What the passes choose is the first set in the order (pass, group) of which no two are alike.
A component can be decided as soon as nothing undecided may come before it, so every round decides the heads of many
groups at once: those alike to a chosen one are its aliases, those that no
earlier group's open component is alike to are chosen, and the others wait. All of it are joins with
the pairs of like components; rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.session import cut

def select_in_turn(anchors: DataFrame, pool: DataFrame, alike: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """chosen (key, place) and aliases (key, of): components until there are `target` with the anchors, which come first.

    anchors: key, place; pool: key, group, turn (a component's place in its group; groups take
    turns in the order of their names); alike: pairs a, b of keys, in either order. A component that is alike to a chosen one becomes
    the alias of the first of those. Aliases are told as far as the selection went.
    """
    first = anchors.select(F.col("key").cast("string").alias("key"), F.lit("").alias("group"), F.col("place").cast("long").alias("turn"), F.lit(0).alias("pass"), F.lit(True).alias("chosen"), F.lit(None).cast("string").alias("of"))
    decided = cut(first, "selection")
    rest = cut(pool.select(F.col("key").cast("string").alias("key"), F.col("group").cast("string").alias("group"), F.col("turn").cast("long").alias("turn")), "selection-pool")
    pairs = alike.select(F.col("a").cast("string").alias("key"), F.col("b").cast("string").alias("other"))
    pairs = cut(pairs.unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other"))).filter("key <> other").distinct(), "selection-pairs")
    kept = decided.count()
    wanted, taken, lap = target - kept, 0, 1
    while wanted > 0:
        new = _round(decided, rest, pairs, lap)
        counts = new.agg(F.count("*").alias("all"), F.count_if("chosen").alias("chosen")).first()
        if counts["all"]:
            taken += counts["chosen"]
            decided, rest = cut(decided.unionByName(new), "selection"), cut(rest.join(new.select("key"), "key", "left_anti"), "selection-pool")
        elif taken >= wanted or not rest.limit(1).count():
            break
        else:  # every group has had its turn
            lap += 1
    place = F.row_number().over(W.orderBy("pass", "group", "turn")) - 1
    chosen = decided.filter("chosen").orderBy("pass", "group", "turn").limit(max(target, kept)).withColumn("place", place)  # as many rows as are wanted
    chosen, aliases = cut(chosen, "selection"), decided.filter("not chosen")
    end = chosen.agg(F.max(F.struct("pass", "group")).alias("at"), F.count("*").alias("n")).first()
    if end["n"] >= target and end["at"] is not None:
        aliases = aliases.filter(F.struct("pass", "group") <= F.struct(F.lit(end["at"]["pass"]), F.lit(end["at"]["group"])))
    return chosen.select("key", "place"), aliases.select("key", "of")


def _open(decided: DataFrame, rest: DataFrame, lap: int) -> DataFrame:
    """Undecided components of groups that have none of this pass yet."""
    served = decided.filter((F.col("pass") == lap) & F.col("chosen")).select("group")
    return rest.join(served, "group", "left_anti")


def _round(decided: DataFrame, rest: DataFrame, pairs: DataFrame, lap: int) -> DataFrame:
    """What can be decided now, in the columns of decided; nothing if every group has had its turn."""
    waiting = _open(decided, rest, lap)
    chosen = decided.filter("chosen").select(F.col("key").alias("other"), F.struct("pass", "group", "turn").alias("at"))
    twin = waiting.join(pairs, "key").join(chosen, "other").groupBy("key").agg(F.min_by("other", "at").alias("of"))
    marked = cut(waiting.join(twin, "key", "left").select("key", "group", "turn", "of"), "selection-open")
    free = marked.filter("of is null")
    heads = free.groupBy("group").agg(F.min(F.struct("turn", "key")).alias("head"))
    passed_over = marked.filter("of is not null").join(heads, "group", "left").filter("head is null or turn < head.turn")
    alias_rows = passed_over.select("key", "group", "turn", F.lit(lap).alias("pass"), F.lit(False).alias("chosen"), "of")
    head = heads.select(F.col("head.key").alias("key"), "group", F.col("head.turn").alias("turn"))
    before = free.select(F.col("key").alias("other"), F.col("group").alias("earlier"))
    waits = head.join(pairs, "key").join(before, "other").filter(F.col("earlier") < F.col("group")).select("key")
    picks = head.join(waits, "key", "left_anti").select("key", "group", "turn", F.lit(lap).alias("pass"), F.lit(True).alias("chosen"), F.lit(None).cast("string").alias("of"))
    return cut(picks.unionByName(alias_rows), "selection")
