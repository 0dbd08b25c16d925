"""Bibliometric networks: pairs by self-join on the shared key, long frames instead of matrices.

Pair counting dedupes (group, item) first, then joins on the group with ``a < b``; the join key is the
group, so AQE splits a group that is much larger than others. ``max_items`` is an opt-in cap for groups
whose square would not fit any cluster; it is off by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from corvella.operators.blocks import BLOCK, numbered
from corvella.operators.hops import block_names, packed, unpacked
from corvella.plans.storage import materialise

OFTEN = 256  # groups an item is in, on average, from which on pairs are counted in blocks
SALT_ROWS = 250_000  # memberships of a block that one task counts
MOST_PAIRS = 4_000_000  # pairs unfolded at a time in a task


def pair_counts(members: DataFrame, group: str, item: str, min_weight: int = 1, max_items: int | None = None) -> DataFrame:
    """(a, b, weight) with a < b: the number of groups that hold both items."""
    m = members.select(group, item).filter(F.col(item).isNotNull()).distinct()
    if max_items:
        m = m.join(m.groupBy(group).count().filter(F.col("count") <= max_items).select(group), group, "left_semi")
    x, y = m.select(F.col(group).alias("g1"), F.col(item).alias("a")), m.select(F.col(group).alias("g2"), F.col(item).alias("b"))
    pairs = x.join(y, (x.g1 == y.g2) & (x.a < y.b)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return pairs if min_weight <= 1 else pairs.filter(F.col("weight") >= min_weight)


def _tallied(size: int):
    """Counts of the pairs of each key (i, j, salt), whose rows come one after another, as packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([packed(count)], pa.binary())], names=["i", "j", "count"])
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "salt")])
            x, y = batch.column("x"), batch.column("y")
            at_x, at_y, from_x, from_y = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (x.values, y.values, x.offsets, y.offsets))
            many_x, many_y = np.diff(from_x), np.diff(from_y)
            pairs = many_x * many_y
            upto = np.cumsum(pairs)
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if batch.num_rows else np.array([], dtype=int)
            for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
                if tuple(keys[:, a]) != place:
                    if place is not None:
                        yield made()
                    place, count = tuple(keys[:, a]), np.zeros(size * size)
                while a < b:
                    end = min(b, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST_PAIRS, "right"))))
                    row = np.repeat(np.arange(a, end), pairs[a:end])
                    k = np.arange(len(row)) - np.repeat(np.cumsum(pairs[a:end]) - pairs[a:end], pairs[a:end])
                    count += np.bincount(at_x[from_x[row] + k // many_y[row]] * size + at_y[from_y[row] + k % many_y[row]], minlength=size * size)
                    a = end
        if place is not None:
            yield made()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, count = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            now, size = (batch.column("i")[k].as_py(), batch.column("j")[k].as_py()), batch.column("size")[k].as_py()
            if now != place:
                if place is not None:
                    yield _upper(place, count)
                place, count = now, np.zeros((size, size))
            count += unpacked(batch.column("count")[k].as_py(), size, size)
    if place is not None:
        yield _upper(place, count)


def _upper(place: tuple[int, int], count: np.ndarray) -> pa.RecordBatch:
    count = np.triu(count, 1) if place[0] == place[1] else count
    return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([packed(count)], pa.binary())], names=["i", "j", "count"])


def _unfolded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                count = unpacked(batch.column("count")[k].as_py(), size, size)
                r, c = np.nonzero(count)
                yield pa.RecordBatch.from_arrays([batch.column("xs")[k].values.take(pa.array(r)), batch.column("ys")[k].values.take(pa.array(c)), pa.array(count[r, c].astype(np.int64))], names=["a", "b", "weight"])

    return run


def frequent_pair_counts(members: DataFrame, group: str, item: str, min_weight: int = 1, size: int | None = None, often: int = OFTEN) -> DataFrame:
    """As ``pair_counts``, for items that are in many groups each: pairs are counted in blocks of items by items, so that a group travels once per pair of
    blocks it touches, not once per pair. Where items are in few groups, it is ``pair_counts``."""
    m = materialise(members.select(F.col(group).alias("g"), F.col(item).alias("id")).filter("id IS NOT NULL AND g IS NOT NULL").distinct(), "pair-members")
    known = numbered(m.select("id").distinct())
    if m.count() < often * known.count():
        return pair_counts(m, "g", "id", min_weight)
    size, parts = size or BLOCK, int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = m.join(known, "id").select("g", F.floor(F.col("v") / size).alias("i"), F.pmod("v", F.lit(size)).cast("short").alias("at"))
    salts = materialise(placed.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("n")), "pair-salts")
    # partitioned by group once, for the lists and for their join
    lists = placed.repartition(parts, "g").groupBy("g", "i").agg(F.collect_list("at").alias("x"))
    both = lists.join(lists.select("g", F.col("i").alias("j"), F.col("x").alias("y")), "g").filter("i <= j").join(salts, "i")
    dealt = both.select("i", "j", F.pmod(F.xxhash64("g"), F.col("n")).cast("long").alias("salt"), "x", "y").repartition(parts, "i", "j", "salt").sortWithinPartitions("i", "j", "salt")
    counted = dealt.mapInArrow(_tallied(size), "i long, j long, count binary").withColumn("size", F.lit(size)).repartition(parts, "i", "j").sortWithinPartitions("i", "j")
    whole = counted.mapInArrow(_summed, "i long, j long, count binary")
    named = whole.join(block_names(known, "v", size, "i", "xs"), "i").join(block_names(known, "v", size, "j", "ys"), "j")
    t = known.schema["id"].dataType
    pairs = named.mapInArrow(_unfolded(size), StructType([StructField("a", t), StructField("b", t), StructField("weight", LongType())]))
    return pairs if min_weight <= 1 else pairs.filter(F.col("weight") >= min_weight)


def bibliographic_coupling(references: DataFrame, min_shared: int = 1, **caps) -> DataFrame:
    """Paper pairs by shared distinct references."""
    return pair_counts(references, "ref", "paper_id", min_shared, **caps)


def co_citation(references: DataFrame, min_weight: int = 1, **caps) -> DataFrame:
    """Reference pairs by citing papers."""
    return pair_counts(references, "paper_id", "ref", min_weight, **caps)


def co_citation_of(cites: DataFrame, attributes: DataFrame, attribute: str, node: Column | None = None, min_weight: int = 1) -> DataFrame:
    """Pairs of an attribute of the cited papers, once per citing paper (N3, J4); ``node`` may compute it."""
    looked = cites.join(attributes.withColumnRenamed("paper_id", "dst"), "dst").select("src", (F.col(attribute) if node is None else node).alias("node"))
    return frequent_pair_counts(looked, "src", "node", min_weight)


def co_authorship(authorship: DataFrame, min_weight: int = 1) -> DataFrame:
    """Author pairs by shared papers."""
    return pair_counts(authorship, "paper_id", "author", min_weight)


def author_nodes(authorship: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers and citations per author."""
    return authorship.distinct().join(papers.select("paper_id", "citations_count"), "paper_id").groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.sum("citations_count").alias("citations"))


def collaboration_graph(authorship: DataFrame, papers: DataFrame) -> DataFrame:
    """Author pairs with shared papers, distinct years and first joint paper."""
    m = authorship.distinct().join(papers.select("paper_id", "year"), "paper_id")
    x, y = m.select("paper_id", "year", F.col("author").alias("a")), m.select(F.col("paper_id").alias("p2"), F.col("author").alias("b"))
    both = x.join(y, (x.paper_id == y.p2) & (x.a < y.b))
    return both.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("weight"), F.count_distinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("paper_id", F.struct("year", "paper_id")).alias("first_paper"), F.sort_array(F.collect_set("year")).alias("years"),
    )


def term_co_occurrence(terms: DataFrame, top_n: int = 200, min_weight: int = 1) -> DataFrame:
    """Pairs of the ``top_n`` terms by document frequency, ties by term (N6). Input: paper_id, term."""
    t = terms.distinct()
    top = t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(top_n)
    return pair_counts(t.join(F.broadcast(top.select("term")), "term", "left_semi"), "paper_id", "term", min_weight)  # top_n rows


def co_occurrence_matrix(members: DataFrame, group: str, item: str) -> DataFrame:
    """(i, j, value): symmetric pair counts with document frequency on the diagonal."""
    m = members.select(group, item).distinct()
    pairs = pair_counts(m, group, item).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("weight").alias("value"))
    diagonal = m.groupBy(item).agg(F.count(F.lit(1)).alias("value")).select(F.col(item).alias("i"), F.col(item).alias("j"), "value")
    return pairs.union(pairs.select("j", "i", "value")).union(diagonal)


def normalise(matrix: DataFrame, method: str = "association") -> DataFrame:
    """Association (= cosine), jaccard or inclusion of a long matrix (N8); the diagonal is 1."""
    d = matrix.filter("i = j")
    x = matrix.join(d.select(F.col("i").alias("di"), F.col("value").alias("mi")), F.col("i") == F.col("di")).join(d.select(F.col("i").alias("dj"), F.col("value").alias("mj")), F.col("j") == F.col("dj"))
    v, mi, mj = F.col("value"), F.col("mi"), F.col("mj")
    by = {"association": v / F.sqrt(mi * mj), "jaccard": v / (mi + mj - v), "inclusion": v / F.least(mi, mj)}[method]
    return x.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(by).alias("value"))


def prune(matrix: DataFrame, threshold: float, absolute: bool = True) -> DataFrame:
    """Off-diagonal entries below the threshold (or that share of the largest) go."""
    if absolute:
        return matrix.filter((F.col("i") == F.col("j")) | (F.col("value") >= threshold))
    top = matrix.filter("i <> j").agg(F.max("value").alias("top"))
    return matrix.join(F.broadcast(top)).filter((F.col("i") == F.col("j")) | (F.col("value") >= threshold * F.col("top"))).drop("top")  # one row


def domain_map(topics: DataFrame, bins: int) -> DataFrame:
    """Topic flow between consecutive year bins (N10): topic, year rows -> topic, bin, count, and min with the next bin."""
    lo = topics.agg(F.min("year").alias("lo"))
    binned = topics.join(F.broadcast(lo)).withColumn("bin", F.floor((F.col("year") - F.col("lo")) / bins).cast("int"))
    n = binned.groupBy("topic", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("topic").orderBy("bin")
    nxt = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.least("n", F.lead("n").over(w)))
    return n.select("topic", "bin", "n", nxt.alias("to_next"))


def projection(members: DataFrame, group: str, item: str, how: str = "count") -> DataFrame:
    """One-mode projection (N13): shared groups, their share of all groups (ratio), or Newman's sum of 1 / (k - 1)."""
    m = members.select(group, item).distinct()
    size = m.groupBy(group).agg(F.count(F.lit(1)).alias("k"))
    x = m.join(size, group).select(F.col(group).alias("g1"), F.col(item).alias("a"), "k")
    y = m.select(F.col(group).alias("g2"), F.col(item).alias("b"))
    both = x.join(y, (x.g1 == y.g2) & (x.a < y.b)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(1.0 / (F.col("k") - 1)).alias("newman"))
    if how == "count":
        return both.select("a", "b", F.col("shared").cast("double").alias("weight"))
    if how == "newman":
        return both.select("a", "b", F.col("newman").alias("weight"))
    total = m.agg(F.count_distinct(group).alias("groups"))
    return both.join(F.broadcast(total)).select("a", "b", (F.col("shared") / F.col("groups")).alias("weight"))  # one row


def generic_projection(members: DataFrame, group: str, item: str, weight, counts: bool = False) -> DataFrame:
    """Projection whose weight is a function of both neighbour arrays (N14): weight(Column, Column) -> Column.

    With ``counts``, of the numbers of shared groups, of a's and of b's: weight(shared, na, nb). Pairs then carry three numbers,
    where arrays put both neighbourhoods beside every pair.
    """
    m = members.select(group, item).distinct()
    pairs = pair_counts(m, group, item)
    near = m.groupBy(item).agg((F.count(group) if counts else F.collect_set(group)).alias("near"))
    x = pairs.join(near.select(F.col(item).alias("a"), F.col("near").alias("na")), "a").join(near.select(F.col(item).alias("b"), F.col("near").alias("nb")), "b")
    return x.select("a", "b", weight(*([F.col("weight")] if counts else []), F.col("na"), F.col("nb")).alias("weight"))


def bipartite_stats(members: DataFrame, left: str, right: str) -> DataFrame:
    """Sizes, edges and density of a bipartite graph."""
    m = members.select(left, right).distinct()
    g = m.agg(F.count_distinct(left).alias("n_left"), F.count_distinct(right).alias("n_right"), F.count(F.lit(1)).alias("edges"))
    return g.withColumn("density", F.col("edges") / (F.col("n_left") * F.col("n_right")))


def bipartite_clustering(members: DataFrame, group: str, item: str, mode: str = "dot") -> DataFrame:
    """Mean pairwise overlap with the nodes two steps away (N15): dot = jaccard, min or max as denominator."""
    m = members.select(group, item).distinct()
    deg = m.groupBy(item).agg(F.count(F.lit(1)).alias("d"))
    p = pair_counts(m, group, item)
    p = p.join(deg.select(F.col(item).alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col(item).alias("b"), F.col("d").alias("db")), "b")
    s, da, db = F.col("weight"), F.col("da"), F.col("db")
    p = p.withColumn("c", s / {"dot": da + db - s, "min": F.least(da, db), "max": F.greatest(da, db)}[mode])
    both = p.select(F.col("a").alias(item), "c").union(p.select(F.col("b"), "c"))
    return deg.select(item).join(both.groupBy(item).agg(F.avg("c").alias("c")), item, "left").select(item, F.coalesce("c", F.lit(0.0)).alias("clustering"))


def two_colouring(edges: DataFrame) -> DataFrame:
    """(id, component, side) of every vertex of an undirected graph (N15): sides 0 and 1 differ along every edge, 0 being that of the
    component's smallest vertex; side is null in a component with a cycle of odd length, which has no such colouring.

    Each vertex stands twice, once per side, and each edge joins opposite sides: a component that can be coloured falls into two.
    """
    from corvella.plans.components import components
    from corvella.plans.storage import materialise

    at = lambda c, side: F.struct(F.col(c).alias("v"), F.lit(side).alias("s"))
    doubled = edges.select(at("src", 0).alias("src"), at("dst", 1).alias("dst")).union(edges.select(at("src", 1), at("dst", 0)))
    found = materialise(components(doubled), "two-sides")
    one, two = found.filter("id.s = 0"), found.filter("id.s = 1").select(F.col("id.v").alias("v2"), F.col("component").alias("c2"))
    both = one.join(two, F.col("id.v") == F.col("v2"))
    return both.select(F.col("id.v").alias("id"), F.col("component.v").alias("component"), F.when(F.col("component") != F.col("c2"), F.col("component.s")).alias("side"))


def is_bipartite(edges: DataFrame) -> DataFrame:
    """(bipartite, zeros, ones, components, odd_components) of a graph."""
    c = two_colouring(edges)
    odd = F.count_distinct(F.when(F.col("side").isNull(), F.col("component")))
    return c.agg((odd == 0).alias("bipartite"), F.count_if(F.col("side") == 0).alias("zeros"), F.count_if(F.col("side") == 1).alias("ones"), F.count_distinct("component").alias("components"), odd.alias("odd_components"))


def redundancy(members: DataFrame, group: str, item: str) -> DataFrame:
    """(item, redundancy): of the pairs of an item's groups, the share that another item joins too (N15); null with fewer than two groups."""
    from corvella.operators.graph import wedges

    m = members.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    joined = m.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    pairs = wedges(m, item, group)
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    g = pairs.join(counts, ["a", "b"]).groupBy(F.col("mid").alias(item)).agg(F.avg((F.col("w") > 1).cast("double")).alias("redundancy"))
    return joined.select(item).join(g, item, "left")


def temporal_network(members: DataFrame, group: str, item: str) -> DataFrame:
    """Edges with the distinct years of joint groups (N16): weight counts years."""
    m = members.select(group, item, "year").distinct()
    x, y = m.select(F.col(group).alias("g1"), F.col(item).alias("a"), "year"), m.select(F.col(group).alias("g2"), F.col(item).alias("b"))
    both = x.join(y, (x.g1 == y.g2) & (x.a < y.b))
    return both.groupBy("a", "b").agg(F.count_distinct("year").alias("weight"), F.sort_array(F.collect_set("year")).alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def temporal_nodes(members: DataFrame, item: str) -> DataFrame:
    """First and last year and number of active years per node."""
    return members.groupBy(item).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("n_years"))


def snapshot(edges: DataFrame, year: int) -> DataFrame:
    """Edges as of ``year`` (J11): kept years up to it, weight their number."""
    kept = F.filter("years", lambda y: y <= year)
    return edges.select("a", "b", F.size(kept).cast("long").alias("weight"), kept.alias("years")).filter("weight > 0")


def growth_curve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per year new and cumulative nodes and edges, density, mean degree."""
    new_n = nodes.groupBy(F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("new_nodes"))
    new_e = edges.groupBy(F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("new_edges"))
    y = new_n.join(new_e, "year", "full_outer").na.fill(0)
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    c = y.withColumn("nodes", F.sum("new_nodes").over(upto)).withColumn("edges", F.sum("new_edges").over(upto))
    n, e = F.col("nodes"), F.col("edges")
    return c.withColumn("density", F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0)).withColumn("mean_degree", F.when(n > 0, 2 * e / n).otherwise(0.0))


def evolution(edges: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    """Edges, nodes and total weight of every cumulative yearly snapshot in one job."""
    at = F.explode(F.sequence(F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("first_year") - start) / step).cast("int") * step), F.lit(end), F.lit(step)))
    per = edges.filter(F.col("first_year") <= end - (end - start) % step).select("a", "b", "years", at.alias("year")).withColumn("w", F.size(F.filter("years", lambda y: y <= F.col("year"))))
    ends = per.select("year", F.explode(F.array("a", "b")).alias("v")).groupBy("year").agg(F.count_distinct("v").alias("nodes"))
    return per.groupBy("year").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight")).join(ends, "year")


def temporal_degree(edges: DataFrame) -> DataFrame:
    """Degree of each node in each year's active edges."""
    y = edges.select(F.explode("years").alias("year"), "a", "b")
    return y.select("year", F.explode(F.array("a", "b")).alias("node")).groupBy("year", "node").agg(F.count(F.lit(1)).alias("degree"))


def emerging_pairs(edges: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose first joint year is at least ``threshold``."""
    return edges.filter(F.col("first_year") >= threshold).select("a", "b", "first_year", "weight")


def top_neighbours(pairs: DataFrame, node, n: int) -> DataFrame:
    """The ``n`` strongest neighbours of ``node`` (K2)."""
    other = F.when(F.col("a") == F.lit(node), F.col("b")).otherwise(F.col("a"))
    return pairs.filter((F.col("a") == F.lit(node)) | (F.col("b") == F.lit(node))).select(other.alias("neighbour"), "weight").orderBy(F.desc("weight"), "neighbour").limit(n)


def scientogram(members: DataFrame, group: str, item: str, method: str, threshold: float) -> DataFrame:
    """Matrix, normalised and pruned."""
    return prune(normalise(co_occurrence_matrix(members, group, item), method), threshold)


def inter_institutional(pairs: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Author pairs whose institutions differ (J14). affiliations: author, institution."""
    x = pairs.join(affiliations.select(F.col("author").alias("a"), F.col("institution").alias("ia")), "a").join(affiliations.select(F.col("author").alias("b"), F.col("institution").alias("ib")), "b")
    return x.filter("ia <> ib").select("a", "b", "ia", "ib", "weight")


def heterogeneous_edges(authorship: DataFrame, cites: DataFrame) -> DataFrame:
    """Paper-author and paper-paper edges of one graph."""
    a = authorship.select(F.concat(F.lit("p"), "paper_id").alias("src"), F.concat(F.lit("a"), "author").alias("dst"), F.lit("authorship").alias("type"))
    c = cites.select(F.concat(F.lit("p"), F.greatest("src", "dst")).alias("src"), F.concat(F.lit("p"), F.least("src", "dst")).alias("dst"), F.lit("citation").alias("type"))
    return a.distinct().union(c.distinct())


def resolve_references(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges src -> dst for references that match any alias of a paper (J1, J2); no loops, no repeats."""
    x = references.join(aliases.select(F.col("alias").alias("ref"), F.col("paper_id").alias("dst")), "ref")
    return x.select(F.col("paper_id").alias("src"), "dst").filter("src <> dst").distinct()
