"""Joins and set operations on whole records, memberships and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.numbering import placed, placed_in_groups
from cloudstrata.session import cut


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Records with their multiplicity, aggregated before the shuffle: a frequent record is one row."""
    return df.groupBy(*columns).agg(F.count("*").alias("__n"))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Records of a beyond their number in b, with how many there are."""
    x, y = _numbered(a, columns), _numbered(b, columns).withColumnsRenamed({c: f"__{c}" for c in [*columns, "__n"]})
    joined = x.join(y, [x[c].eqNullSafe(y[f"__{c}"]) for c in columns], "left")
    return joined.select(*[x[c] for c in columns], (x["__n"] - F.coalesce(y["____n"], F.lit(0))).alias("extra")).filter("extra > 0")


def label_by_partition(region: DataFrame, parts: dict[str, DataFrame], columns: list[str], check: bool = True) -> DataFrame:
    """region with label: the part that holds its record. Every record must be in one part, as often as in the region.

    A record may be in one part only, so which duplicate pairs with which makes no
    difference, and labels are joined by distinct record. With check, a record of two
    parts, of too many or too few copies raises an error.
    """
    saved = None
    for name, df in parts.items():
        rows = df.select(*columns).withColumn("label", F.lit(name))
        saved = rows if saved is None else saved.unionByName(rows)
    counts = saved.groupBy(*columns).agg(F.count("*").alias("__saved"), F.min("label").alias("label"), F.max("label").alias("__last"))
    names = {c: f"__{c}" for c in columns}
    counts = counts.withColumnsRenamed(names)
    if check:  # one full join of the counts of both sides tells all there is to tell
        there = _numbered(region, columns)
        both = there.join(counts, [there[c].eqNullSafe(counts[n]) for c, n in names.items()], "full")
        both = cut(both.select(*names.values(), "label", "__last", "__saved", "__n"), "labels-of-records")
        n, m = F.coalesce("__n", F.lit(0)), F.coalesce("__saved", F.lit(0))
        bad = both.agg(F.count_if(F.col("label") != F.col("__last")).alias("twice"), F.count_if(m > n).alias("more"), F.count_if(m < n).alias("fewer")).first()
        if bad["twice"]:
            raise ValueError("a record is in two parts")
        if bad["more"]:
            raise ValueError("the parts hold a record, or copies of one, that the region hasn't")
        if bad["fewer"]:
            raise ValueError("the region holds a record that no part has")
        counts = both
    counts = counts.select(*names.values(), "label")
    return region.join(counts, [region[c].eqNullSafe(counts[n]) for c, n in names.items()], "left").select(*[region[c] for c in region.columns], "label")


def recovered(seeds: DataFrame, crop: DataFrame, columns: list[str]) -> DataFrame:
    """One row: seeds, and how many of them have their record in the crop."""
    there = crop.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    found = seeds.join(there, [seeds[c].eqNullSafe(there[f"__{c}"]) for c in columns], "left_semi")
    return seeds.agg(F.count("*").alias("seeds")).crossJoin(found.agg(F.count("*").alias("recovered")))  # two single rows


def context_of(points: DataFrame, members: DataFrame, key: str = "row_id") -> DataFrame:
    """Points that aren't members."""
    return points.join(members.select(key), key, "left_anti")


def shared_members(membership: DataFrame, group: str, row: str, source: str | None = None) -> DataFrame:
    """a < b, shared rows, and their share of the smaller group, of groups (of one source) that share any.

    Rows of one group only drop out before the join; a row of very many groups still
    makes many pairs, because they are the result.
    """
    on = [row] + ([source] if source else [])
    rows = membership.select(*on, group).distinct()
    many = rows.groupBy(*on).agg(F.count("*").alias("__g")).filter("__g > 1")
    rows_many = rows.join(many.drop("__g"), on, "left_semi")
    a, b = rows_many.withColumnRenamed(group, "a"), rows_many.withColumnRenamed(group, "b")
    pairs = a.join(b, on).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    out = pairs.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("smaller_share"))


def overlapping_boxes(boxes: DataFrame, key: str, source: str, axes: tuple[str, ...] = ("x", "y", "z"), cell: float | None = None) -> DataFrame:
    """a < b of boxes of one source that overlap, closed, in the axes.

    Boxes meet in grid cells of the first two axes, of a width of twice their mean span unless it is
    given. A box is in many cells if it is much wider than most.
    """
    cols = [key, source, *[f"{n}_{a}" for a in axes for n in ("min", "max")]]
    df = boxes.select(*cols)
    on = [source]
    cell = cell or typical_cell(boxes, axes[:2])
    for k, a in enumerate(axes[:2]):
        df = df.withColumn(f"__g{k}", F.explode(F.sequence(F.floor(F.col(f"min_{a}") / cell), F.floor(F.col(f"max_{a}") / cell))))
        on.append(f"__g{k}")
    one = df.select(*on, F.struct(*cols).alias("p"))
    two = df.select(*on, F.struct(*cols).alias("q"))
    meet = F.col(f"p.{key}") < F.col(f"q.{key}")
    for a in axes:
        meet = meet & (F.greatest(f"p.min_{a}", f"q.min_{a}") <= F.least(f"p.max_{a}", f"q.max_{a}"))
    return one.join(two, on).filter(meet).select(F.col(source), F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b")).distinct()


def groups_of_edges(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """key and group: the least key of what edges connect, itself if nothing."""
    from cloudstrata.functions.graph import connected_components

    found = connected_components(edges, "a", "b").withColumnsRenamed({"node": key, "component": "group"})
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("group", key).alias("group"))


def tagged_groups(members: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """key and group of members that any tag joins, over all tags: tags join and never split. A null tag joins nothing."""
    edges = None
    for t in tags:
        first = members.filter(F.col(t).isNotNull()).groupBy(t).agg(F.min(key).alias("a"))
        e = members.join(first, t).select("a", F.col(key).alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    return groups_of_edges(members, key, edges)


def union_of_sources(sources: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Rows of all sources, once for each key, of the first source that has it, with their place in the order of keys."""
    all_rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("__s", F.lit(k))
        all_rows = s if all_rows is None else all_rows.unionByName(s)
    columns = [c for c in all_rows.columns if c != "__s"]
    first = all_rows.groupBy(key).agg(F.min_by(F.struct(*columns), "__s").alias("r")).select("r.*")
    return placed(first, [key])


def interleaved(rows: DataFrame, group: str, hint: str, order: list) -> DataFrame:
    """Adds turn: rows of a group in order, taking one of each hint in turn; hints (a few for each group) come in the order of their first rows.

    A row's turn follows from its place within its hint and the sizes of the group's hints, so only these are numbered, by ranges.
    """
    numbered = placed_in_groups(rows, [group, hint], order, "__at", "__size")
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))  # one row for each hint
    hints = numbered.filter("__at = 0").withColumn("__rank", rank).select(F.col(group).alias("__group"), F.col(hint).alias("__hint"), "__rank", F.col("__size").alias("__of"))
    sizes = hints.groupBy(F.col("__group").alias("__every")).agg(F.collect_list(F.struct("__rank", "__of")).alias("__sizes"))
    joined = numbered.join(hints.drop("__of"), numbered[group].eqNullSafe(F.col("__group")) & numbered[hint].eqNullSafe(F.col("__hint"))).join(sizes, F.col(group).eqNullSafe(F.col("__every")))
    before = F.aggregate("__sizes", F.lit(1).cast("long"), lambda n, h: n + F.least(h["__of"], F.col("__at")) + F.when((h["__rank"] < F.col("__rank")) & (h["__of"] > F.col("__at")), 1).otherwise(0))
    return joined.select(*rows.columns, before.cast("int").alias("turn"))


def shape_hint(x, y, z):
    """elongated, thin or compact, by the sorted spans of a box."""
    s = F.sort_array(F.array(x, y, z))
    return F.when(s[2] >= 2.5 * F.greatest(s[1], F.lit(1e-12)), "elongated").when(s[1] >= 2.5 * F.greatest(s[0], F.lit(1e-12)), "thin").otherwise("compact")


def crop_clearance(edges: dict[str, tuple]) -> Column:
    """The least distance of a box (min_a, max_a) from the edges (low, high) of its crop, over the axes given; negative outside."""
    side = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(*[d for a, (low, high) in edges.items() for d in (F.col(f"min_{a}") - side(low), side(high) - F.col(f"max_{a}"))])


def joined_ids(c: str) -> Column:
    """Distinct ids of a group in order, with | between."""
    return F.array_join(F.sort_array(F.collect_set(c)), "|")


def crop_groups(crops: DataFrame, key: str = "crop", source: str = "source", region: str = "region") -> DataFrame:
    """key, group and group_id of crops (a row each, with bounds): those of one source and region, or of one source with boxes that overlap, are one group, whatever lies between.

    group_id is the SHA-256 of the source and the group's keys in order; a group has
    the crops of a review, not its points.
    """
    same = tagged_edges(crops, key, [source, region])
    edges = overlapping_boxes(crops, key, source).select("a", "b").unionByName(same)
    found = groups_of_edges(crops, key, edges).join(crops.select(key, source), key)
    names = found.groupBy("group", source).agg(F.sha2(F.concat_ws("|", F.col(source), joined_ids(key)), 256).alias("group_id"))
    return found.join(names, ["group", source]).select(key, "group", "group_id")


def tagged_edges(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Edges from each row to the first of its group; a null tag joins nothing."""
    first = rows.groupBy(*by).agg(F.min(key).alias("a"))
    return rows.join(first, by).select("a", F.col(key).alias("b"))


def typical_cell(boxes: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> float:
    """A grid width of twice the mean span of boxes, so that a box meets few cells."""
    spans = boxes.agg(*[F.avg(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(a) for a in axes]).first()
    return max([2 * float(spans[a] or 0) for a in axes] + [1e-6])


def first_entry(features: DataFrame, names: DataFrame, name: str = "name", key: str = "candidate_id") -> DataFrame:
    """key and the columns of the first of a candidate's names (key, name, position) that features (name, ...) know; equal positions in the order of names."""
    columns = [c for c in features.columns if c != name]
    met = names.join(features, name)
    return met.groupBy(key).agg(F.min_by(F.struct(F.col(name).alias("found_as"), *columns), F.struct("position", name)).alias("f")).select(key, "f.*")
