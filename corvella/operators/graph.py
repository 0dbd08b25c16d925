"""Graph measures on edge frames (src, dst[, weight]).

Loops join and aggregate; every few rounds the state is written to the shared folder, so lineage stays
short and lost executors cost one round. Undirected graphs are given once per pair and doubled here.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators import blocks
from corvella.operators.blocks import Blocks, numbered
from corvella.operators.hops import Search, least_dense
from corvella.plans.components import components
from corvella.plans.storage import materialise

CUT_EVERY = 3
JOINED_ROUNDS = 8
MOST_ROUNDS = 201
MOST_HOPS = 10_000  # a graph deeper than this is an error, never a shorter result
CLASSES = 4


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.filter("src <> dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *e.columns[2:]))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree, weighted and degree centrality (G1)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight")).union(edges.select("dst", F.lit(0), F.lit(1), "weight"))
    d = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(n)).withColumn("centrality", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0)).drop("n")  # one row


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int | None = None, tol: float = 1e-6, personal: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(id, rank), summing to one; dangling mass goes where restarts go (G2). ``personal``: id, share (sums to 1).

    With that rule the ranks are the normalised sum of the series ``alpha ** k`` times the k-step walks from the restarts, which grows
    towards its limit: x = restarts + alpha * steps(x). Edges are partitioned by source once and held, sums come out partitioned
    alike, so a round moves nothing but partial sums; ``JOINED_ROUNDS`` rounds are one job. Ends when all further terms together are below
    ``tol`` of the sum (L1), for certain after log(tol) / log(alpha) rounds; ``rounds``: end after so many at the latest, settled or not.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    e = materialise(edges.groupBy("src", "dst").agg(F.sum(w).cast("double").alias("w")), "pr-edges")
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    steps = _held(e.join(out, "src").select("src", "dst", (alpha * F.col("w") / F.col("out")).alias("p")), "src")
    v = materialise(vertices(e), "pr-vertices")
    base = v.select("id", F.lit(1.0 / max(v.count(), 1)).alias("x")) if personal is None else v.join(personal, "id").select("id", F.col("share").cast("double").alias("x"))
    base = materialise(base, "pr-restarts")
    x, was, done = base, 1.0, 0
    most = math.ceil(math.log(tol * (1 - alpha)) / math.log(alpha)) if rounds is None else rounds
    while done < most:
        now = min(JOINED_ROUNDS, most - done)
        for _ in range(now):
            x = steps.join(x.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), (F.col("p") * F.col("x")).alias("x")).union(base).groupBy("id").agg(F.sum("x").alias("x"))
        x, done = materialise(x, "pr-ranks"), done + now
        whole = x.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        if (whole - was) * alpha**now / (1 - alpha**now) < tol * whole:
            break
        was = whole
    steps.unpersist()
    whole = x.agg(F.sum("x").alias("whole"))
    return v.join(x, "id", "left").join(F.broadcast(whole)).select("id", (F.coalesce("x", F.lit(0.0)) / F.col("whole")).alias("rank"))  # one row


def _held(edges: DataFrame, by: str) -> DataFrame:
    """``edges`` partitioned and sorted by one end and kept, in memory or on disk, so that rounds do not shuffle them again."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, by).sortWithinPartitions(by).persist(StorageLevel.MEMORY_AND_DISK)


def _settled(state: DataFrame, value: str, tol: float) -> bool:
    """Is the L1 change of ``value`` against ``was`` below ``tol`` of its L1 norm?"""
    change, norm = state.agg(F.sum(F.abs(F.col(value) - F.col("was"))), F.sum(F.abs(F.col(value)))).first()
    return (change or 0.0) < tol * (norm or 1.0)


def hits(edges: DataFrame, tol: float = 1e-7, most: int = MOST_ROUNDS) -> DataFrame:
    """(id, hub, authority), each summing to one (G3); until the L1 change of hubs is below ``tol`` of their sum, an error past ``most`` rounds."""
    e = materialise(edges.select("src", "dst").distinct(), "hits-edges")
    v = materialise(vertices(e), "hits-vertices")
    out, back = _held(e, "src"), _held(e, "dst")
    authorities = lambda hubs: out.join(hubs.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority"))
    hubs_of = lambda a: back.join(a.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub"))
    # a round reads the last one once, and sums are divided by their total only where they are compared: plans grow with the rounds, not by powers
    x = v.select("id", F.lit(1.0 / max(v.count(), 1)).alias("hub"))
    for _ in range(CUT_EVERY, most + 1, CUT_EVERY):
        for _ in range(CUT_EVERY - 1):
            x = hubs_of(authorities(x))
        was = _scaled(materialise(x, "hits"), "hub")
        a = _scaled(materialise(authorities(was), "hits-authorities"), "authority")
        x = _scaled(materialise(hubs_of(a), "hits"), "hub")
        s = v.join(x, "id", "left").join(was.select("id", F.col("hub").alias("was")), "id", "left").na.fill(0.0, ["hub", "was"])
        if _settled(s, "hub", tol):
            s = materialise(s.select("id", "hub").join(a, "id", "left").na.fill(0.0, ["authority"]), "hits")
            out.unpersist(), back.unpersist()
            return s.select("id", "hub", "authority")
    raise RuntimeError("hubs did not settle")


def _scaled(x: DataFrame, value: str) -> DataFrame:
    """``value`` as shares of its sum, which is taken now."""
    whole = x.agg(F.sum(value)).first()[0]
    return x.withColumn(value, F.col(value) / F.lit(whole or 1.0))


def katz(edges: DataFrame, alpha: float = 0.005, beta: float = 1.0, tol: float = 1e-6, most: int = MOST_ROUNDS) -> DataFrame:
    """x = alpha * A x + beta over the edges of an undirected graph (G4), until the L1 change is below ``tol`` of the L1 norm; an error past ``most`` rounds,
    as for an ``alpha`` above one over the largest eigenvalue."""
    e = materialise(both_ways(edges.select("src", "dst")), "katz-edges")
    v, e = materialise(vertices(e), "katz-vertices"), _held(e, "src")
    x = v.withColumn("x", F.lit(beta))
    for k in range(most):
        last = k % CUT_EVERY == CUT_EVERY - 1
        was = materialise(x, "katz") if last else x
        g = e.join(was.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("g"))
        x = v.join(g, "id", "left").select("id", (alpha * F.coalesce("g", F.lit(0.0)) + beta).alias("x"))
        if last:
            x = materialise(x, "katz")
            if _settled(x.join(was.withColumnRenamed("x", "was"), "id"), "x", tol):
                e.unpersist()
                return x
    raise RuntimeError("values did not settle")


def eigenvector(edges: DataFrame, tol: float = 1e-6, most: int = MOST_ROUNDS) -> DataFrame:
    """Power iteration of x + A x with unit norm (G4), until the L1 change is below ``tol`` of the L1 norm; an error past ``most`` rounds."""
    e = materialise(both_ways(edges.select("src", "dst")), "eigen-edges")
    v = materialise(vertices(e), "eigen-vertices")
    e = _held(e.union(v.select(F.col("id").alias("src"), F.col("id").alias("dst"))), "src")
    x = v.withColumn("x", F.lit(1.0))
    for k in range(most):
        last = k % CUT_EVERY == CUT_EVERY - 1
        if last:
            was = _unit(materialise(x, "eigen"))
        x = e.join((was if last else x).select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))
        if last:
            x = _unit(materialise(x, "eigen"))
            if _settled(x.join(was.withColumnRenamed("x", "was"), "id"), "x", tol):
                e.unpersist()
                return x
    raise RuntimeError("values did not settle")


def _unit(x: DataFrame) -> DataFrame:
    """``x`` over its Euclidean norm, which is taken now."""
    norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    return x.withColumn("x", F.col("x") / F.lit(norm or 1.0))


def distances(edges: DataFrame, sources: DataFrame, most: int = MOST_HOPS, directed: bool = False, radius: int | None = None) -> DataFrame:
    """(source, id, dist, paths): breadth-first from all ``sources`` (id) at once, with shortest-path counts.

    Ends when no vertex is new, or at ``radius`` where one is asked for; vertices further than ``most`` hops away raise an error.
    """
    return _found(edges if directed else both_ways(edges), sources, most, radius).rows()


def hop_counts(edges: DataFrame, sources: DataFrame, most: int = MOST_HOPS, directed: bool = False) -> DataFrame:
    """(source, dist, many): how many vertices are at each distance from each of ``sources`` (id); pairs are never made rows."""
    return _found(edges if directed else both_ways(edges), sources, most, None, False).counts()


def hop_rows(edges: DataFrame, sources: DataFrame, most: int = MOST_HOPS, directed: bool = False) -> DataFrame:
    """(source, id, dist): ``distances`` for a caller who does not ask for the number of paths."""
    return _found(edges if directed else both_ways(edges), sources, most, None, False).rows()


def _found(ways: DataFrame, sources: DataFrame, most: int, radius: int | None = None, counted: bool = True) -> Search:
    known, by_number, start = _numbered_graph(ways, sources)
    return _hops(Search(known, by_number, start, counted), most, radius)


def _numbered_graph(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, Blocks, DataFrame]:
    """Numbers (id, v) of all vertices, the edges by number and the distinct ``sources`` (id)."""
    e = materialise(edges.select("src", "dst").distinct(), "bfs-edges")
    start = materialise(sources.select("id").distinct(), "bfs-sources")
    known = numbered(vertices(e).union(start).distinct())
    of = lambda c, n: known.select(F.col("id").alias(c), F.col("v").alias(n))
    dense = min(blocks.DENSE, least_dense(start.count(), blocks.BLOCK))
    return known, Blocks(e.join(of("src", "u"), "src").join(of("dst", "v"), "dst").select("u", "v"), dense=dense), start


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (s, v, ...) with source and id in place of numbers."""
    return rows.join(known.select(F.col("id").alias("source"), F.col("v").alias("s")), "s").join(known, "v").drop("s", "v")


def _hops(search: Search, most: int, radius: int | None = None) -> Search:
    """``search`` with the distances of all vertices in reach, or within ``radius``."""
    return search.spread(most, radius)


def closeness(dist: DataFrame, n: int) -> DataFrame:
    """Closeness (scaled by reach) and harmonic centrality from distances of every source, a row each or with how ``many`` there are."""
    many = F.col("many") if "many" in dist.columns else F.lit(1)
    g = dist.filter("dist > 0").groupBy(F.col("source").alias("id")).agg(F.sum(many * F.col("dist")).alias("s"), F.sum(many).alias("k"), F.sum(many / F.col("dist")).alias("harmonic"))
    return g.select("id", (F.col("k") / F.col("s") * F.col("k") / F.lit(float(n - 1))).alias("closeness"), "harmonic")


def pivots(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` of the ``nodes`` (id), those of smallest MD5 of id and seed: the same ones every time, each as likely as another."""
    return nodes.select("id").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(k)


def sampled_closeness(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, closeness, harmonic) of every vertex from its distances to ``k`` pivots (G5); exact if k is the number of vertices.

    Distances are taken from the pivots, so there are k rows a vertex, not n. Sums over pivots stand for sums over all others, scaled by (n - 1)
    over the number of pivots that are others. With k pivots the mean distance is off by more than e times the
    diameter with a probability of at most 2 exp(-2 k e^2) for any one vertex.
    """
    e = materialise(edges.select("src", "dst"), "pivot-edges")
    v = vertices(e)
    n = v.count()
    d = hop_rows(e, pivots(v, k, seed)).filter("dist > 0")
    g = d.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("dist").alias("s"), F.sum(1 / F.col("dist")).alias("h"))
    chosen = pivots(v, k, seed).select("id", F.lit(1).alias("own"))
    x = v.join(g, "id", "left").join(chosen, "id", "left").withColumn("asked", F.lit(min(k, n)) - F.coalesce("own", F.lit(0)))
    reach = F.col("k") / F.col("asked")  # share of the other vertices in reach
    return x.select("id", F.coalesce(reach * F.col("k") / F.col("s"), F.lit(0.0)).alias("closeness"), F.coalesce(F.col("h") * F.lit(float(n - 1)) / F.col("asked"), F.lit(0.0)).alias("harmonic"))


def sampled_betweenness(edges: DataFrame, k: int, normalized: bool = True, seed: int = 0) -> DataFrame:
    """(id, betweenness) estimated from ``k`` pivots as sources (G6): their sums times n / k; exact if k is the number of vertices.

    ``normalized`` divides by the (n - 1)(n - 2) / 2 pairs of others. For k pivots a normalised value is off by more than e with a probability of at
    most 2 exp(-2 k e^2 ((n - 2) / n)^2), as each pivot gives between 0 and n - 2.
    """
    e = materialise(edges.select("src", "dst"), "pivot-edges")
    v = vertices(e)
    n = v.count()
    scale = n / max(min(k, n), 1) / (((n - 1) * (n - 2) / 2 or 1) if normalized else 1)
    return betweenness(e, pivots(v, k, seed)).select("id", (F.col("betweenness") * scale).alias("betweenness"))


def eccentricities(dist: DataFrame) -> DataFrame:
    """Eccentricity of each source, with the flags of centre and periphery."""
    g = dist.groupBy(F.col("source").alias("id")).agg(F.max("dist").alias("eccentricity"))
    r = g.agg(F.min("eccentricity").alias("radius"), F.max("eccentricity").alias("diameter"))
    return g.join(F.broadcast(r)).select("id", "eccentricity", (F.col("eccentricity") == F.col("radius")).alias("is_center"), (F.col("eccentricity") == F.col("diameter")).alias("is_periphery"))  # one row


def searched(edges: DataFrame, sources: DataFrame, most: int = MOST_HOPS) -> Search:
    """Breadth-first search from all ``sources`` (id) with numbers of paths, for measures that share one."""
    return _found(both_ways(edges), sources, most)


def searched_distances(found: Search) -> DataFrame:
    """(source, id, dist, paths) of a search."""
    return found.rows()


def betweenness(edges: DataFrame, sources: DataFrame, most: int = MOST_HOPS, found: Search | None = None) -> DataFrame:
    """Unnormalised betweenness over the given sources (G6): Brandes' backward sums, one level at a time for all sources; ``found``: their search, where it is done."""
    sums = (found or searched(edges, sources, most)).passed().select("id", (F.col("x") / 2).alias("betweenness"))
    return vertices(edges).join(sums, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _smallest_above(edges: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, c): the smallest id from which each of ``ids`` can be reached; labels of labels shorten long paths."""
    lab = ids.select("id", F.col("id").alias("c"))
    for _ in range(most):
        near = edges.join(lab, edges.src == lab.id).groupBy("dst").agg(F.min("c").alias("m"))
        lower = materialise(lab.join(near, lab.id == near.dst, "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was")), "scc-lower")
        if lower.filter("c <> was").isEmpty():
            return lower.select("id", "c")
        up = lower.select(F.col("id").alias("up"), F.col("c").alias("top"))
        lab = materialise(lower.join(up, lower.c == up.up).select("id", F.col("top").alias("c")), "scc-labels")
    raise RuntimeError("components did not settle")


def strongly_connected(edges: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(id, component): smallest id above (forward) and, within its colour, below (backward); where both are one, that is
    the component. The rest is split by both and done again, until none are left (G8)."""
    left = materialise(edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges")
    todo = materialise(vertices(edges), "scc-todo")
    done = None
    for _ in range(most):
        above = _smallest_above(left, todo, most)
        same = left.join(above.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(above.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        same = materialise(same, "scc-same")
        below = _smallest_above(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), todo, most)
        ends = materialise(above.join(below.withColumnRenamed("c", "b"), "id"), "scc-ends")
        found = ends.filter("c = b").select("id", F.col("c").alias("component"))
        done = found if done is None else done.union(found)
        todo = ends.filter("c <> b").select("id", "b")
        if todo.isEmpty():
            return done
        left = materialise(same.join(todo.select(F.col("id").alias("src"), F.col("b").alias("bs")), "src").join(todo.select(F.col("id").alias("dst"), F.col("b").alias("bd")), "dst").filter("bs = bd").select("src", "dst"), "scc-edges")
    raise RuntimeError("components did not settle")


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Q of labels (id, label) on an undirected weighted graph."""
    x = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    m = x.agg(F.sum("weight").cast("double").alias("m"))
    inner = x.filter("ls = ld").groupBy(F.col("ls").alias("label")).agg(F.sum("weight").alias("inner"))
    ends = x.select(F.col("ls").alias("label"), "weight").union(x.select("ld", "weight")).groupBy("label").agg(F.sum("weight").alias("ends"))
    y = ends.join(inner, "label", "left").join(F.broadcast(m))  # one row
    return y.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - gamma * (F.col("ends") / (2 * F.col("m"))) ** 2).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def modularities(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(part, modularity, communities) of many undirected weighted graphs at once (G10): edges part, src, dst, weight; labels part, id, label."""
    lab = lambda c, n: labels.select("part", F.col("id").alias(c), F.col("label").alias(n))
    x = edges.join(lab("src", "ls"), ["part", "src"]).join(lab("dst", "ld"), ["part", "dst"])
    m = x.groupBy("part").agg(F.sum("weight").cast("double").alias("m"))
    inner = x.filter("ls = ld").groupBy("part", F.col("ls").alias("label")).agg(F.sum("weight").alias("inner"))
    ends = x.select("part", F.col("ls").alias("label"), "weight").union(x.select("part", "ld", "weight")).groupBy("part", "label").agg(F.sum("weight").alias("ends"))
    y = ends.join(inner, ["part", "label"], "left").join(m, "part")
    return y.groupBy("part").agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - gamma * (F.col("ends") / (2 * F.col("m"))) ** 2).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def label_propagation(edges: DataFrame, rounds: int | None = None, most: int = MOST_ROUNDS) -> DataFrame:
    """(id, label): the label with most weight among the neighbours and the node itself, ties to the smaller.

    Until no label changes, or those that do go back and forth between two states (nodes that all change at once can); an error past ``most``
    rounds. ``rounds``: that many at the most.
    """
    e = materialise(both_ways(edges.select("src", "dst", "weight")), "lpa-edges")
    lab = materialise(vertices(e).select("id", F.col("id").alias("label"), F.lit(None).cast(edges.schema["src"].dataType).alias("before")), "lpa")
    for _ in range(most if rounds is None else rounds):
        votes = e.join(lab, e.src == lab.id).select(F.col("dst").alias("id"), "label", F.col("weight").cast("double").alias("weight")).union(lab.select("id", "label", F.lit(1.0)))
        n = votes.groupBy("id", "label").agg(F.sum("weight").alias("n"))
        new = n.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        both = materialise(lab.join(new, "id"), "lpa")
        lab = both.select("id", F.col("new").alias("label"), F.col("label").alias("before"))
        if both.filter("new <> label").isEmpty() or both.filter("NOT new <=> before").isEmpty():
            return lab.select("id", "label")
    if rounds is None:
        raise RuntimeError("labels did not settle")
    return lab.select("id", "label")


LEAST_GAIN = 1e-6  # of modularity, by a pass over all nodes


def _move_round(ways: DataFrame, lab: DataFrame, mass: DataFrame, gamma: float, turn: int) -> DataFrame:
    """Labels after the nodes of one of ``CLASSES`` hash classes have moved to the neighbouring community of largest gain."""
    tot = lab.groupBy("part", "label").agg(F.sum("k").alias("tot"))
    to = ways.join(lab.select("part", F.col("id").alias("dst"), F.col("label").alias("to")), ["part", "dst"]).groupBy("part", F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
    x = to.join(lab, ["part", "id"]).join(tot.select("part", F.col("label").alias("to"), "tot"), ["part", "to"]).join(mass, "part")
    own = F.col("to") == F.col("label")
    gain = F.col("w") - gamma * F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / (2 * F.col("m"))
    best = x.withColumn("gain", gain).groupBy("part", "id").agg(
        F.min_by(F.when(~own, F.col("to")), F.when(~own, F.struct(-F.col("gain"), F.col("to")))).alias("best"), F.max(F.when(~own, F.col("gain"))).alias("g"), F.max(F.when(own, F.col("w"))).alias("w_own"),
    )
    at = lab.join(tot, ["part", "label"]).join(best, ["part", "id"], "left").join(mass, "part")
    stay = F.coalesce("w_own", F.lit(0.0)) - gamma * F.col("k") * (F.col("tot") - F.col("k")) / (2 * F.col("m"))
    may = F.pmod(F.xxhash64("id", F.lit(turn // CLASSES)), F.lit(CLASSES)) == turn % CLASSES
    return materialise(at.select("part", "id", "k", F.when(may & (F.col("g") > stay + 1e-12), F.col("best")).otherwise(F.col("label")).alias("label")), "lv-lab")


def _local_moves(now: DataFrame, gamma: float, passes: int | None) -> tuple[DataFrame, bool]:
    """(part, id, label) after passes over all nodes, and whether any part got better. A pass that does not raise a part's modularity is
    undone and ends that part, so each goes up to the end."""
    loops = now.filter("src = dst")
    plain = now.filter("src <> dst").select("part", "src", "dst", "weight")
    ways = materialise(plain.union(plain.select("part", "dst", "src", "weight")), "lv-ways")
    deg = ways.select("part", "src", "weight").union(loops.select("part", "src", 2 * F.col("weight"))).groupBy("part", F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    mass = materialise(now.groupBy("part").agg(F.sum("weight").alias("m")), "lv-mass")
    lab = materialise(deg.select("part", "id", "k", F.col("id").alias("label")), "lv-lab")
    q = materialise(modularities(now, lab, gamma).select("part", "modularity"), "lv-q")
    total = parts = before = q.count()
    turn, trial, going = 0, lab, ways
    while True:
        active = q.select("part")
        if parts < before:  # some have ended
            trial, going = lab.join(active, "part", "left_semi"), materialise(ways.join(active, "part", "left_semi"), "lv-ways")
        for _ in range(CLASSES):
            trial = _move_round(going, trial, mass, gamma, turn)
            turn += 1
        new = modularities(now.join(active, "part", "left_semi"), trial, gamma).select("part", F.col("modularity").alias("new"))
        q = materialise(new.join(q, "part").filter(F.col("new") > F.col("modularity") + LEAST_GAIN).select("part", F.col("new").alias("modularity")), "lv-q")
        before, parts = parts, q.count()
        if not parts:
            return lab.select("part", "id", "label"), turn > CLASSES
        if parts == total:  # none has ended
            lab = trial
        else:
            better = q.select("part")
            lab = materialise(lab.join(better, "part", "left_anti").union(trial.join(better, "part", "left_semi").select(*lab.columns)), "lv-lab")
        if passes is not None and turn >= passes * CLASSES:
            return lab.select("part", "id", "label"), True


def louvain_many(edges: DataFrame, gamma: float = 1.0, passes: int | None = None, levels: int | None = None) -> DataFrame:
    """(part, id, label) of many graphs in one run (G9): synchronous local moves towards higher modularity, then contraction, until nothing gains.

    edges: part, src, dst, weight. In a round only one of ``CLASSES`` hash classes of nodes may move, so that few neighbours move at once.
    ``passes`` and ``levels``: that many passes a level and levels at the most, for a rougher partition in less time.
    """
    w = F.col("weight").cast("double")
    now = materialise(edges.groupBy("part", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(w).alias("weight")), "lv-edges")
    member = materialise(now.select("part", F.explode(F.array("src", "dst")).alias("id")).distinct().select("part", "id", F.col("id").alias("label")), "lv-member")
    done = 0
    while levels is None or done < levels:
        up, moved = _local_moves(now, gamma, passes)
        done += 1
        if not moved:
            return member
        member = materialise(member.join(up.select("part", F.col("id").alias("label"), F.col("label").alias("up")), ["part", "label"], "left").select("part", "id", F.coalesce("up", "label").alias("label")), "lv-member")
        x = now.join(up.select("part", F.col("id").alias("src"), F.col("label").alias("s")), ["part", "src"]).join(up.select("part", F.col("id").alias("dst"), F.col("label").alias("d")), ["part", "dst"])
        now = materialise(x.groupBy("part", F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).agg(F.sum("weight").alias("weight")), "lv-edges")
    return member


def louvain(edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(id, label) of one graph (G9); see ``louvain_many``."""
    return louvain_many(edges.select(F.lit(0).alias("part"), "src", "dst", "weight"), gamma).select("id", "label")


def partition_quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Coverage and performance of a partition."""
    x = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    c = x.agg(F.count_if(F.col("ls") == F.col("ld")).alias("intra"), F.count(F.lit(1)).alias("m"))
    s = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("inside"))
    y = c.join(F.broadcast(s))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return y.select((F.col("intra") / F.col("m")).alias("coverage"), ((F.col("intra") + (pairs - F.col("inside")) - (F.col("m") - F.col("intra"))) / pairs).alias("performance"))


def community_density(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, nodes, inner, density): the share of a community's pairs that are linked; 0 for a single node."""
    x = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    inner = x.filter("ls = ld AND src <> dst").select(F.col("ls").alias("label"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("inner"))
    y = labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")).join(inner, "label", "left").na.fill(0, ["inner"])
    return y.withColumn("density", F.when(F.col("nodes") > 1, 2 * F.col("inner") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def hop_silhouette(edges: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """(id, silhouette) on hop distances (G12): mean distance to the own community against that to the nearest other one.

    ``k``: against so many pivots only, in place of all vertices. Vertices that cannot be reached are left out of the means; a vertex
    without others of its community, or without another community in reach, has 0.
    """
    e = materialise(edges.select("src", "dst"), "silhouette-edges")
    v = vertices(e)
    d = _found(both_ways(e), v if k is None else pivots(v, k, seed), MOST_HOPS, None, False)
    near = d.by_label(labels).withColumn("mean", F.col("s") / F.col("many"))
    x = near.join(labels.select("id", "label"), "id").groupBy("id").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("to") != F.col("label"), F.col("mean"))).alias("b"))
    return v.join(x, "id", "left").select("id", F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def _ln_factorial(n: Column) -> Column:
    """ln n! : exact up to 15, Stirling's series from there (relative error below 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n, F.lit(15)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def adjusted_mutual_information(one: DataFrame, two: DataFrame) -> DataFrame:
    """(mi, expected, ami) of two labelings (id, label): mutual information less what chance gives, over the mean entropy less that.

    The expectation is that of the hypergeometric model; it depends on the sizes of the groups alone, so one term is computed for each pair of
    distinct sizes and weighted by how many groups have them. The overlap of two groups runs over all counts within 12 standard deviations and 40
    of its mean; what lies outside adds less than 1e-30.
    """
    c = materialise(one.select("id", F.col("label").alias("x")).join(two.select("id", F.col("label").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")), "ami-cells")
    total = c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    sizes = lambda by, s, m: c.groupBy(by).agg(F.sum("k").alias(s)).groupBy(s).agg(F.count(F.lit(1)).alias(m))
    a, b = sizes("x", "a", "na"), sizes("y", "b", "nb")
    entropy = lambda t, s, m: t.join(F.broadcast(total)).agg(F.coalesce(-F.sum(F.col(m) * F.col(s) / F.col("n") * F.ln(F.col(s) / F.col("n"))), F.lit(0.0)))
    by_x, by_y = c.groupBy("x").agg(F.sum("k").alias("kx")), c.groupBy("y").agg(F.sum("k").alias("ky"))
    mi = c.join(by_x, "x").join(by_y, "y").join(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("k") / F.col("n") * F.ln(F.col("n") * F.col("k") / (F.col("kx") * F.col("ky")))), F.lit(0.0)).alias("mi"))
    # pairs of distinct sizes, not of rows: each side has at most the root of twice the rows
    pairs = a.join(b).join(F.broadcast(total))
    n, x, y = F.col("n"), F.col("a"), F.col("b")
    mean = x * y / n
    spread = 40 + 12 * F.sqrt(mean * (n - x) / n * (n - y) / F.greatest(n - 1, F.lit(1)))
    lo, hi = F.greatest(F.lit(1), x + y - n, F.floor(mean - spread)), F.least(x, y, F.ceil(mean + spread))
    cells = pairs.filter(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    k = F.col("k")
    lf = _ln_factorial
    chance = F.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k))
    expected = cells.agg(F.coalesce(F.sum(F.col("na") * F.col("nb") * k / n * F.ln(n * k / (x * y)) * chance), F.lit(0.0)).alias("expected"))
    both = mi.join(F.broadcast(expected)).join(F.broadcast(entropy(a, "a", "na").toDF("hx"))).join(F.broadcast(entropy(b, "b", "nb").toDF("hy")))  # one row each
    mean_h = (F.col("hx") + F.col("hy")) / 2
    return both.select("mi", "expected", F.when(F.abs(mean_h - F.col("expected")) > 1e-15, (F.col("mi") - F.col("expected")) / (mean_h - F.col("expected"))).otherwise(1.0).alias("ami"))


def compare_labels(one: DataFrame, two: DataFrame) -> DataFrame:
    """NMI, variation of information and adjusted Rand index of two labelings."""
    c = one.select("id", F.col("label").alias("x")).join(two.select("id", F.col("label").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    h = lambda col: c.groupBy(col).agg(F.sum("k").alias("k"))
    pick = lambda: F.col("k") * (F.col("k") - 1) / 2
    t = c.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("kxy"), F.sum(pick()).alias("pxy"))
    a = h("x").agg(F.sum(F.col("k") * F.ln("k")).alias("kx"), F.sum(pick()).alias("px"))
    b = h("y").agg(F.sum(F.col("k") * F.ln("k")).alias("ky"), F.sum(pick()).alias("py"))
    z = t.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    n = F.col("n")
    hx, hy, hxy = F.ln(n) - F.col("kx") / n, F.ln(n) - F.col("ky") / n, F.ln(n) - F.col("kxy") / n
    expected = F.col("px") * F.col("py") / (n * (n - 1) / 2)
    return z.select(
        F.when(hx + hy > 0, 2 * (hx + hy - hxy) / (hx + hy)).otherwise(1.0).alias("nmi"), (2 * hxy - hx - hy).alias("vi"),
        F.when((F.col("px") + F.col("py")) / 2 != expected, (F.col("pxy") - expected) / ((F.col("px") + F.col("py")) / 2 - expected)).otherwise(1.0).alias("ari"),
    )


def core_numbers(edges: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(id, core): each node's value becomes the h-index of its neighbours' until nothing changes.

    Neighbours are counted by value first, so a hub's window holds one row per distinct value of theirs. After the first round only
    nodes are looked at of which a neighbour fell below their own value, as no other can change.
    """
    return _core_numbers(materialise(both_ways(edges.select("src", "dst")).distinct(), "core-edges"), most)


def _core_numbers(e: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """Core numbers over distinct edges that stand both ways."""
    v = materialise(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core")), "core")
    by = Window.partitionBy("id").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    looked = e
    for _ in range(most):
        near = looked.join(v.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.count(F.lit(1)).alias("m")).withColumn("r", F.sum("m").over(by))
        h = near.groupBy("id").agg(F.max(F.least("c", "r")).cast("long").alias("h"))
        fell = materialise(v.join(h, "id").filter("h < core").select("id", "h", F.col("core").alias("was")), "core-changes")
        if fell.isEmpty():
            return v
        v = materialise(v.join(fell.select("id", "h"), "id", "left").select("id", F.coalesce("h", "core").alias("core")), "core")
        hit = e.join(fell.select(F.col("id").alias("dst"), "h", "was"), "dst").join(v.select(F.col("id").alias("src"), "core"), "src").filter("h < core AND was >= core").select("src").distinct()
        looked = e.join(materialise(hit, "core-hit"), "src", "left_semi")
    raise RuntimeError("cores did not settle")


def _oriented(edges: DataFrame) -> DataFrame:
    """(u, v): each edge once, from the end of smaller degree."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    d = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").count()
    x = e.join(d.select(F.col("v").alias("a"), F.col("count").alias("da")), "a").join(d.select(F.col("v").alias("b"), F.col("count").alias("db")), "b")
    swap = F.struct("da", "a") > F.struct("db", "b")
    return x.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"))


def _triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once each: wedges at the end of smaller degree, closed by an edge join."""
    o = materialise(_oriented(edges), "triangle-edges")
    e = o.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    w = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").filter("x < y")
    return w.join(e, (w.x == e.a) & (w.y == e.b)).select(F.col("u").alias("p"), F.col("x").alias("q"), F.col("y").alias("r"))


def _triangles_at(edges: DataFrame) -> DataFrame:
    """(id, triangles) of the nodes of triangles, which are counted, not listed: with edges from the end of smaller degree, ways u to x to y closed by
    an edge u to y are triangles of u and y, and forks to x and y closed by an edge x to y are triangles of x. Dense parts are products of blocks."""
    o = materialise(_oriented(edges), "triangle-edges")
    known = numbered(o.select(F.col("u").alias("id")).union(o.select("v")).distinct())
    of = lambda c: known.select(F.col("id").alias(c), F.col("v").alias(f"n_{c}"))
    o = materialise(o.join(of("u"), "u").join(of("v"), "v").select(F.col("n_u").alias("u"), F.col("n_v").alias("v")), "triangle-edges")
    steps, ends = Blocks(o), o.select(F.col("u").alias("s"), "v")
    closed = lambda front: materialise(steps.through(front.withColumn("x", F.lit(1.0))).join(ends, ["s", "v"]), "triangle-ends")
    ways, forks = closed(ends), closed(o.select(F.col("v").alias("s"), F.col("u").alias("v")))
    found = ways.select("s", "x").union(ways.select("v", "x")).union(forks.select("s", "x"))
    return found.groupBy(F.col("s").alias("v")).agg(F.sum("x").cast("long").alias("triangles")).join(known, "v").select("id", "triangles")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Triangles and local clustering of each node."""
    t = _triangles_at(edges)
    d = both_ways(edges.select("src", "dst")).distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    x = d.join(t, "id", "left").na.fill(0, ["triangles"])
    return x.select("id", "triangles", F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"), "k")


def transitivity(edges: DataFrame) -> DataFrame:
    """Transitivity and mean clustering."""
    t = triangle_counts(edges)
    return t.agg((2 * F.sum("triangles") / F.sum(F.col("k") * (F.col("k") - 1))).alias("transitivity"), F.avg("clustering").alias("average_clustering"), F.floor(F.sum("triangles") / 3).alias("triangles"))


def core_parts(edges: DataFrame, k: int) -> DataFrame:
    """(id, core, in_core, in_shell, in_crust, in_corona) for ``k`` (G14): the k-core, the nodes of core number k, those of at
    most k, and those of the k-shell with just k neighbours in the k-core."""
    e = materialise(both_ways(edges.select("src", "dst")).distinct(), "core-edges")
    c = _core_numbers(e)
    high = c.filter(F.col("core") >= k).select("id")
    n = e.join(high.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    x = c.join(n, "id", "left").na.fill(0, ["n"])
    shell = F.col("core") == k
    return x.select("id", "core", (F.col("core") >= k).alias("in_core"), shell.alias("in_shell"), (F.col("core") <= k).alias("in_crust"), (shell & (F.col("n") == k)).alias("in_corona"))


def onion_layers(edges: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(id, layer): the round of peeling in which a node goes (G15). A round takes all nodes of at most the current core's
    degree; the current core rises when no node is left below it.

    A round writes the degrees of the nodes left; edges are written again only when half of their nodes are gone.
    """
    e = materialise(both_ways(edges.select("src", "dst")).distinct(), "onion-edges")
    k = materialise(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "onion-degrees")
    done, core, held = k.select("id", F.lit(0).alias("layer")).limit(0), 1, None
    for layer in range(1, most + 1):
        least, n = k.agg(F.min("k"), F.count(F.lit(1))).first()
        if least is None:
            return done
        core, held = max(core, least), held or n
        if 2 * n < held:
            left = k.select("id")
            e = materialise(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "onion-edges")
            held = n
        go = materialise(k.filter(F.col("k") <= core).select("id", F.lit(layer).alias("layer")), "onion-layer")
        done = done.union(go)
        if layer % 8 == 0:
            done = materialise(done, "onion")
        lost = e.join(go.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
        k = materialise(k.filter(F.col("k") > core).join(lost, "id", "left").select("id", (F.col("k") - F.coalesce("lost", F.lit(0))).alias("k")), "onion-degrees")
    raise RuntimeError("layers did not settle")


def condensation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, edges) between the strong components ``labels`` (id, component): a graph without cycles."""
    lab = lambda c, n: labels.select(F.col("id").alias(c), F.col("component").alias(n))
    x = edges.join(lab("src", "s"), "src").join(lab("dst", "d"), "dst").filter("s <> d")
    return x.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.count(F.lit(1)).alias("edges"))


# The 16 classes of three nodes, by mutual, asymmetric and null pairs and, where that is not enough, direction.
TRIADS = "003 012 102 021D 021U 021C 111D 111U 030T 030C 201 120D 120U 120C 210 300".split()


def _turned(way: int) -> int:
    return {1: 2, 2: 1}.get(way, 3)


def _open_triad(one: int, two: int) -> str:
    """Class of two linked pairs without the third, by the ways of their middle node: 1 out, 2 in, 3 both."""
    if one == two:
        return {1: "021D", 2: "021U", 3: "201"}[one]
    if 3 in (one, two):
        return "111D" if 2 in (one, two) else "111U"
    return "021C"


def _closed_triad(wx: int, wy: int, wxy: int) -> str:
    """Class of three linked pairs: the ways from the first node to x and to y, and from x to y."""
    ways = [(0, 1, wx), (0, 2, wy), (1, 2, wxy)]
    mutual = sum(w == 3 for _, _, w in ways)
    outs = sorted(sum((p == i and w in (1, 3)) + (q == i and w in (2, 3)) for p, q, w in ways) for i in range(3))
    ins = sorted(sum((p == i and w in (2, 3)) + (q == i and w in (1, 3)) for p, q, w in ways) for i in range(3))
    if mutual > 1:
        return "300" if mutual == 3 else "210"
    if mutual == 1:
        return "120D" if outs[2] == 2 and ins[0] == 0 else "120U" if ins[2] == 2 and outs[0] == 0 else "120C"
    return "030T" if outs[2] == 2 else "030C"


def triad_census(edges: DataFrame) -> DataFrame:
    """(triad, n) of all 16 directed classes.

    Only closed triples are enumerated, from edges of the end of smaller degree. Pairs of links at a node follow from how many it has of each way, less those
    that are closed; triples with one linked pair from the numbers of nodes and neighbours, and the rest from the number of nodes.
    """
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("way")).groupBy("a", "b").agg(F.sum("way").cast("int").alias("way"))
    pairs = materialise(pairs, "triad-pairs")  # way: 1 a to b, 2 b to a, 3 both
    turned = F.when(F.col("way") == 1, 2).when(F.col("way") == 2, 1).otherwise(3)
    both = pairs.select(F.col("a").alias("id"), "way").union(pairs.select("b", turned))
    k = materialise(both.groupBy("id").agg(*[F.count_if(F.col("way") == w).alias(f"k{w}") for w in (1, 2, 3)]), "triad-degrees")
    n1, n2, n3, whole = F.col("k1"), F.col("k2"), F.col("k3"), F.col("k1") + F.col("k2") + F.col("k3")
    two = lambda n: (n * (n - 1) / 2).cast("decimal(38,0)")
    at = {"021D": two(n1), "021U": two(n2), "201": two(n3), "021C": n1 * n2, "111U": n3 * n1, "111D": n3 * n2, "asymmetric": n1 + n2, "mutual": n3, "near_asymmetric": whole * (n1 + n2), "near_mutual": whole * n3}
    got = {c: int(n or 0) for c, n in k.agg(*[F.sum(x.cast("decimal(38,0)")).alias(c) for c, x in at.items()]).first().asDict().items()}
    nodes = vertices(edges).count()
    counted = {c: got[c] for c in ("021D", "021U", "201", "021C", "111U", "111D")}
    # pairs and a third node that neither is linked to: all nodes, less the neighbours of either; each pair stands at both its ends
    counted |= {"012": got["asymmetric"] // 2 * nodes - got["near_asymmetric"], "102": got["mutual"] // 2 * nodes - got["near_mutual"]}
    size = k.select("id", whole.alias("k"))
    x = pairs.join(size.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    swap = F.struct("ka", "a") > F.struct("kb", "b")
    o = materialise(x.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(swap, turned).otherwise(F.col("way")).alias("way")), "triad-edges")
    w = o.select("u", F.col("v").alias("a"), F.col("way").alias("wx")).join(o.select("u", F.col("v").alias("b"), F.col("way").alias("wy")), "u").filter("a < b")
    closed = w.join(pairs.withColumnRenamed("way", "wxy"), ["a", "b"]).groupBy("wx", "wy", "wxy").agg(F.count(F.lit(1)).alias("n"))
    for wx, wy, wxy, n in closed.select("wx", "wy", "wxy", "n").collect():  # at most 27 rows
        counted[_closed_triad(wx, wy, wxy)] = counted.get(_closed_triad(wx, wy, wxy), 0) + n
        for one, other in ((wx, wy), (_turned(wx), wxy), (_turned(wy), _turned(wxy))):
            counted[_open_triad(one, other)] -= n
        for way in (wx, wy, wxy):
            counted["102" if way == 3 else "012"] += n
    counted["003"] = nodes * (nodes - 1) * (nodes - 2) // 6 - sum(counted.values())
    return edges.sparkSession.createDataFrame([(t, int(counted.get(t, 0))) for t in TRIADS], "triad string, n long")


def k_truss(edges: DataFrame, k: int, most: int = MOST_HOPS) -> DataFrame:
    """Edges that stay in at least k - 2 triangles of what is left."""
    e = materialise(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "truss")
    for _ in range(most):
        t = _triangles(e).select(F.explode(F.array(F.array_sort(F.array("p", "q")), F.array_sort(F.array("p", "r")), F.array_sort(F.array("q", "r")))).alias("x"))
        good = t.groupBy(F.col("x")[0].alias("src"), F.col("x")[1].alias("dst")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k - 2).select("src", "dst")
        new = materialise(good, "truss")
        if new.count() == e.count():
            return e
        e = new
    raise RuntimeError("truss did not settle")


def chains(edges: DataFrame, starts: DataFrame, depth: int, simple: bool = False) -> DataFrame:
    """All outgoing walks up to ``depth`` from ``starts`` (id), every prefix kept (G20); ``simple`` drops cycles."""
    walk = starts.select(F.array("id").alias("path"), F.col("id").alias("at"))
    out = None
    for _ in range(depth):
        nxt = walk.join(edges.select(F.col("src").alias("at"), "dst"), "at")
        if simple:
            nxt = nxt.filter(~F.array_contains("path", F.col("dst")))
        walk = nxt.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        out = walk if out is None else out.union(walk)
    return out.select("path", (F.size("path") - 1).alias("length"))


def summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and reciprocity of a directed graph."""
    e = edges.select("src", "dst").distinct()
    n = vertices(e).agg(F.count(F.lit(1)).alias("nodes"))
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("mutual"))
    x = e.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(n)).join(F.broadcast(back))  # one row each
    return x.select("nodes", "edges", (F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), (F.col("mutual") / F.col("edges")).alias("reciprocity"))


def assortativity(edges: DataFrame, attributes: DataFrame, attribute: str) -> DataFrame:
    """Attribute assortativity from the mixing matrix."""
    x = edges.join(attributes.select(F.col("id").alias("src"), F.col(attribute).alias("x")), "src").join(attributes.select(F.col("id").alias("dst"), F.col(attribute).alias("y")), "dst").select("x", "y")
    m = x.union(x.select("y", "x"))
    n = m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    a = m.groupBy("x").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    z = n.join(F.broadcast(a))  # one row each
    e = F.col("sq") / (F.col("n") * F.col("n"))
    return z.select(((F.col("same") / F.col("n") - e) / (1 - e)).alias("assortativity"))


WEDGE_BLOCK = 512


def wedges(links: DataFrame, mid: str, end: str, *carried: str) -> DataFrame:
    """(mid, a, b, carried) for each pair a < b of the ends of a middle node; ``links`` (mid, end, carried of the middle) must be distinct.

    A middle node of many ends has its list split into blocks by its counted size, and every pair of blocks is a key of its
    own: a task holds two blocks, whatever the degree.
    """
    size = links.groupBy(mid).agg(F.ceil(F.count(F.lit(1)) / WEDGE_BLOCK).cast("int").alias("_blocks"))
    x = links.join(size, mid).withColumn("_at", F.pmod(F.xxhash64(end), F.col("_blocks")).cast("int"))
    left = x.select(F.col(mid).alias("mid"), F.col("_at").alias("i"), F.explode(F.sequence("_at", F.col("_blocks") - 1)).alias("j"), F.col(end).alias("x"), *carried)
    right = x.select(F.col(mid).alias("mid"), F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("i"), F.col("_at").alias("j"), F.col(end).alias("y"))
    both = left.join(right, ["mid", "i", "j"]).filter("(i < j AND x <> y) OR x < y")
    return both.select("mid", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *carried)


def _unlinked(pairs: DataFrame, e: DataFrame) -> DataFrame:
    return pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


def link_scores(edges: DataFrame) -> DataFrame:
    """Jaccard, Adamic-Adar, resource allocation and common neighbours of pairs two steps apart without an edge."""
    e = materialise(both_ways(edges.select("src", "dst")).distinct(), "link-edges")
    d = materialise(e.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "link-degrees")
    p = wedges(e.join(d, "src"), "src", "dst", "k").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("k") > 1, 1 / F.ln("k")).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("k")).alias("resource_allocation"))
    p = _unlinked(p, e)
    p = p.join(d.select(F.col("src").alias("a"), F.col("k").alias("ka")), "a").join(d.select(F.col("src").alias("b"), F.col("k").alias("kb")), "b")
    return p.select("a", "b", "common", (F.col("common") / (F.col("ka") + F.col("kb") - F.col("common"))).alias("jaccard"), "adamic_adar", "resource_allocation", (F.col("ka") * F.col("kb")).alias("preferential"))


def _community_wedges(edges: DataFrame, labels: DataFrame, own: bool = False) -> DataFrame:
    """Unlinked pairs a < b of one community, la, with each common neighbour: its degree k and community lm; ``own``: only where that is theirs.

    Ends are paired within their community from the start, so other pairs are never made.
    """
    e = materialise(both_ways(edges.select("src", "dst")).distinct(), "link-edges")
    lab = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    mid = e.groupBy("src").agg(F.count(F.lit(1)).alias("k")).join(lab("src", "lm"), "src")
    links = e.join(mid, "src").join(lab("dst", "la").filter("la IS NOT NULL"), "dst")
    links = links.filter("la = lm") if own else links
    links = materialise(links.select(F.struct("src", "la").alias("mid"), "dst", "k", "lm"), "link-ends")
    return _unlinked(wedges(links, "mid", "dst", "k", "lm"), e.filter("src < dst")).select("a", "b", "k", "lm", F.col("mid.la").alias("la"))


def community_link_scores(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Common neighbours plus those of the same community (Soundarajan-Hopcroft), for pairs of one community."""
    p = _community_wedges(edges, labels)
    return p.groupBy("a", "b").agg((F.count(F.lit(1)) + F.count_if(F.col("lm") == F.col("la"))).alias("score"))


def community_allocation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Resource allocation over the common neighbours of the pair's own community (Soundarajan-Hopcroft), for pairs of one community; scores above 0."""
    p = _community_wedges(edges, labels, own=True)
    return p.groupBy("a", "b").agg(F.sum(1 / F.col("k")).alias("score"))


def within_inter_scores(edges: DataFrame, labels: DataFrame, delta: float = 0.001) -> DataFrame:
    """Common neighbours within the pair's community over those outside plus ``delta``, for pairs of one community; scores above 0."""
    p = _community_wedges(edges, labels)
    within = F.count_if(F.col("lm") == F.col("la"))
    return p.groupBy("a", "b").agg((within / (F.count(F.lit(1)) - within + delta)).alias("score")).filter("score > 0")


def katz_similarity(edges: DataFrame, alpha: float = 0.005, hops: int = 3) -> DataFrame:
    """Sum of alpha ** k times the walks of length k up to ``hops``."""
    ways = both_ways(edges.select("src", "dst"))
    known, by_number, start = _numbered_graph(ways, vertices(ways))
    return Search(known, by_number, start).walks(hops, alpha)


# Filters on a graph (vertices, edges); all return such a pair and compose


def induced(nodes: DataFrame, graph: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    v, e = graph
    keep = nodes.select("id")
    e = e.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return v.join(keep, "id", "left_semi"), e


def degree_range(lo: int, hi: int | None = None):
    def apply(graph):
        d = graph[1].select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
        d = graph[0].select("id").join(d, "id", "left").na.fill(0, ["k"])
        return induced(d.filter((F.col("k") >= lo) & (F.lit(True) if hi is None else F.col("k") <= hi)), graph)

    return apply


def weight_range(lo: float, hi: float = float("inf")):
    return lambda graph: (graph[0], graph[1].filter(F.col("weight").between(lo, hi)))


def property_range(column: str, lo: float, hi: float):
    return lambda graph: induced(graph[0].filter(F.col(column).between(lo, hi)), graph)


def property_in(column: str, values: list):
    return lambda graph: induced(graph[0].filter(F.col(column).isin(values)), graph)


def equal_property(column: str, value):
    """Nodes whose attribute is ``value``; a null value asks for those without one."""
    return lambda graph: induced(graph[0].filter(F.col(column).eqNullSafe(F.lit(value))), graph)


def edge_type(values: list, column: str = "type"):
    """Edges of the given types; all nodes stay."""
    return lambda graph: (graph[0], graph[1].filter(F.col(column).isin(values)))


def giant_component(graph):
    c = components(graph[1])
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return induced(c.join(F.broadcast(top), "component"), graph)  # one row


def component_size(least: int):
    def apply(graph):
        c = components(graph[1])
        big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        return induced(c.join(big, "component"), graph)

    return apply


def k_core(k: int):
    return lambda graph: induced(core_numbers(graph[1]).filter(F.col("core") >= k), graph)


def ego_network(centre, radius: int):
    def apply(graph):
        s = graph[0].filter(F.col("id") == F.lit(centre)).select("id")
        return induced(distances(graph[1], s, radius=radius).select("id").distinct(), graph)

    return apply


def on_shortest_paths(a, b, most: int = MOST_HOPS):
    def apply(graph):
        one = distances(graph[1], graph[0].filter(F.col("id") == F.lit(a)).select("id"), most).select("id", F.col("dist").alias("d1"))
        two = distances(graph[1], graph[0].filter(F.col("id") == F.lit(b)).select("id"), most).select("id", F.col("dist").alias("d2"))
        whole = one.filter(F.col("id") == F.lit(b)).select(F.col("d1").alias("d"))
        return induced(one.join(two, "id").join(F.broadcast(whole)).filter("d1 + d2 = d"), graph)  # one row

    return apply


def mutual_edges(graph):
    v, e = graph
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
    return v, e.join(back, ["src", "dst"]).select("src", "dst", F.greatest("weight", "w2").alias("weight")).filter("src < dst")


def between_groups(column: str):
    """Edges whose ends differ in an attribute; null counts as a value."""

    def apply(graph):
        v, e = graph
        x = e.join(v.select(F.col("id").alias("src"), F.col(column).alias("gs")), "src").join(v.select(F.col("id").alias("dst"), F.col(column).alias("gd")), "dst")
        return v, x.filter(~F.col("gs").eqNullSafe(F.col("gd"))).select(*e.columns)

    return apply


def time_range(start: int, end: int, column: str = "years"):
    """Edges with a time in range; edges without times pass."""
    hit = F.col(column).isNull() | F.exists(column, lambda y: y.between(start, end))
    return lambda graph: (graph[0], graph[1].filter(hit))


def chain(*filters):
    """Filters one after another."""

    def apply(graph):
        for f in filters:
            graph = f(graph)
        return graph

    return apply


def spectral_groups(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """Power iteration clustering of weighted edges (G34): id, label."""
    pic = PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight")
    return pic.assignClusters(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))).select("id", F.col("cluster").alias("label"))
