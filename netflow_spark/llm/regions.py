"""Exact joins inside overlapping regions, by pivots and the triangle inequality.

A region is a set of items that may be linked; two linked items share at least one region, and the
links' distance is a metric. Only reachability is asked for: inside a region an item is the pivot,
all others are compared with it, and items already in one component are never compared again; what
may still be linked goes on with another pivot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: A region is compared pair by pair once its pairs between components are at most this many a member.
PAIRS_A_MEMBER = 64


def sizes_allow(a: str, b: str, percent: int) -> Column:
    """Sets of such sizes can reach a Jaccard similarity of ``percent``."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def places_allow(na: str, pa: str, nb: str, pb: str, percent: int) -> Column:
    """Sets of such sizes can reach it though the members before the given places are not in common."""
    in_common = F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb))
    return (100 + percent) * in_common >= percent * (F.col(na) + F.col(nb))


def most_size(n: Column, place: Column, percent: int) -> Column:
    """The largest size of a set that one of size ``n`` may be linked to, without the members before ``place``."""
    return F.floor(((100 + percent) * (n - place) - percent * n) / percent)


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` (g, x, n, place, c, ...) that may be linked to a row of another component of their region.

    By sizes alone: the smallest set of another component must not be too large for x (``most``), and
    the largest size that one of another component allows must not be below that of x.
    """
    rows = rows.withColumn("_most", most_size(F.col("n"), F.col("place"), percent))
    per = written(rows.groupBy("g", "c").agg(F.min("n").alias("n"), F.max("_most").alias("most")), "per_component")
    ends = per.groupBy("g").agg(F.min(F.struct("n", "c")).alias("lo"), F.max(F.struct("most", "c")).alias("hi"), F.min("c").alias("_c1"), F.max("c").alias("_c2"))
    ends = written(ends.where("_c1 <> _c2").select("g", "lo", "hi"), "ends")
    others = per.join(ends, "g").groupBy("g", "lo", "hi").agg(F.min(F.expr("if(c <> lo.c, n, null)")).alias("n2"), F.max(F.expr("if(c <> hi.c, most, null)")).alias("most2"))
    bounds = written(others, "bounds")
    smallest, largest = F.expr("if(c = lo.c, n2, lo.n)"), F.expr("if(c = hi.c, most2, hi.most)")
    met = rows.join(bounds, "g").where((smallest <= F.col("_most")) & (largest >= F.col("n")) & (100 * F.col("_most") >= percent * F.col("n")))
    return met.drop("_most", "lo", "hi", "n2", "most2")


def link_regions(regions: DataFrame, compare: Callable[[DataFrame], DataFrame], percent: int,
                 pairs_a_member: int = PAIRS_A_MEMBER, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(node, component)`` of the items that are linked to others.

    ``regions``: written rows ``(g, x, n, place, pivot, pn, pplace)``, item ``x`` with set size ``n`` in
    region ``g``; ``place`` members of x come before those that the region may hold in common, and
    ``pivot`` (size ``pn``, place ``pplace``) is the region's item of the least place, then name: the one
    with the fewest members of its own, near which the others lie. ``compare`` gives
    ``(a, b, d, linked)`` of pairs ``(a, b)``. Rows ``alone``, if there is such a column, have no other item than the
    pivot in their region.

    In rounds, a region's items are compared with its pivot and the pivot leaves the region. So do
    items whose size and place rule out a link to every item of another component. A region of one
    component is finished, however large. A crowded one goes on with the next pivot, which is compared
    with the items outside of its component. A region with at most ``pairs_a_member`` pairs between
    components a member is compared pair by pair, if sizes, places and distances to the
    pivot allow a link. Rounds go on as long as each leaves crowded regions at most half of
    their rows; after a round that does not, pivots gain nothing and the pairs of all regions are compared.

    With ``meet`` all sizes are 1 and all places 0 (they are not looked at between rounds), and the pairs of a region
    are those that ``meet`` gives as ``(a, b)``, a < b, of rows ``(g, x, c)`` of items in components; ``compare`` may then
    leave out pairs that are not linked.
    """
    rows, links, close, rest = regions.withColumns({"c": F.col("x"), "pc": F.col("pivot")}), None, [], []
    before, last = None, False
    while not last:
        pairs = (rows.where("x <> pivot and c <> pc").where(sizes_allow("n", "pn", percent)).where(places_allow("n", "place", "pn", "pplace", percent))
                 .select(F.col("x").alias("a"), F.col("pivot").alias("b")).distinct())
        close.append(written(compare(written(pairs, "pairs")), "distances"))
        found = close[-1].where("linked").select("a", "b")
        links = written(components(found if links is None else links.unionByName(found)), "components").select(F.col("node").alias("a"), F.col("component").alias("b"))
        others = rows.where("x <> pivot and not alone" if "alone" in rows.columns else "x <> pivot").select("g", "x", "n", "place", "pivot")
        named = others.join(links.select(F.col("a").alias("x"), F.col("b").alias("c")), "x", "left").withColumn("c", F.coalesce("c", "x"))
        rows = written(named, "named")
        rows = rows if meet else written(with_partners(rows, percent), "partners")
        least, first = F.min(F.struct("place", "x", "n")), F.min(F.struct("p", "c"))
        if meet:  # all places and sizes are the same; numbers are summed up without a sort
            least, first = F.min("x"), F.struct(F.struct(F.lit(0).cast("long").alias("place"), F.min("p").alias("x"), F.lit(1).cast("long").alias("n")).alias("p"), F.min_by("c", "p").alias("c"))
        state = (rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"), least.alias("p"))
                 .groupBy("g").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), first.alias("p"))
                 .where("k * k > same").withColumn("crowded", F.expr(f"(k * k - same) / 2 > {pairs_a_member} * k")))
        state = written(state.select("g", "k", "crowded", F.col("p.p.x").alias("_pivot"), F.col("p.p.n").alias("pn"), F.col("p.p.place").alias("pplace"), F.col("p.c").alias("pc")), "state")
        size = state.where("crowded").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        last = size == 0 or (before is not None and 2 * size > before)
        rest.append(rows.join(state.where(F.lit(last) | ~F.col("crowded")).select("g"), "g").select("g", "x", "n", "place", "pivot"))
        if not last:
            before = size
            rows = written(rows.drop("pivot").join(state.where("crowded").drop("crowded", "k"), "g").withColumnRenamed("_pivot", "pivot"), "crowded")
    left = rest[0]
    known = close[0]
    for r, k in zip(rest[1:], close[1:]):
        left, known = left.unionByName(r), known.unionByName(k)
    known = written(known.select("a", "b", "d").dropDuplicates(["a", "b"]), "known")
    left = left.join(links.select(F.col("a").alias("x"), F.col("b").alias("c")), "x", "left").withColumn("c", F.coalesce("c", "x"))
    if meet:
        pairs = meet(left).distinct()
    else:
        left = written(left.join(known.select(F.col("a").alias("x"), F.col("b").alias("pivot"), "d"), ["x", "pivot"], "left"), "left")
        one, two = (left.select("g", *[F.col(c).alias(f"{c}{s}") for c in ("x", "n", "place", "c", "d")]) for s in "ab")
        pairs = (one.join(two, "g").where("ca <> cb and xa < xb").where(sizes_allow("na", "nb", percent))
                 .where(places_allow("na", "placea", "nb", "placeb", percent))
                 .where(f"coalesce(abs(da - db) <= {1 - percent / 100 + 1e-9}, true)")
                 .select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct())
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = compare(written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")).where("linked").select("a", "b")
    return components(written(links.unionByName(found), "links"))
