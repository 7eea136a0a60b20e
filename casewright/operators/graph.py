"""Graph operators on link tables (a, b, weight), a < b, one row a pair.

Iterations are joins and aggregations, a stored table a round. Betweenness takes a task for a batch of
sources of a connected component; modularity communities and articulation points one for each component.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import config
from casewright.operators.sequences import min_max, ranked
from casewright.storage import stored

#: Rounds between looks at how far scores still move.
_EVERY = 10
#: Up to so many links, counted first, a power iteration runs in one task; beyond, so does that of each component of up to so many, and of larger ones each round is a join.
LOCAL_LINKS = 200_000
#: Links of the components that a task takes together, about.
BATCH_LINKS = 20_000


def both_ways(links: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions."""
    w = F.col("weight") if "weight" in links.columns else F.lit(1.0).alias("weight")
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), w).unionAll(links.select(F.col("b"), F.col("a"), w))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link: component is the smallest id that is reachable. Smallest label of the neighbours and pointer jumping, in stored rounds."""
    e = stored(both_ways(links).select("src", "dst"), "links")
    label = stored(e.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")), "labels")
    while True:
        near = e.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        step = stored(step.join(jump, "to", "left").select("id", F.least("to", F.coalesce("beyond", "to")).alias("component"), "old"), "labels")
        moved = step.filter("component != old").limit(1).count()
        label = step.select("id", "component")
        if not moved:
            return label


def _nodes(links: DataFrame, vertices: DataFrame | None) -> DataFrame:
    """(id): the ends of the links, and the vertices that have none."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b"))
    return (ends if vertices is None else ends.union(vertices.select("id"))).distinct()


def _power(rounds: int, tolerance: float, alpha: float | None):
    """Scores of the nodes of a small graph: PageRank with ``alpha``, else the eigenvector of length 1."""

    def iterate(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = np.unique(np.concatenate([p["a"], p["b"]]), return_inverse=True)
        a, b = ends[: len(p)], ends[len(p) :]
        src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([p["weight"], p["weight"]])
        n = len(ids)
        x = np.full(n, 1.0 / n)
        if alpha is not None:
            out = np.bincount(src, w, n)
            w = w / np.where(out > 0, out, 1)[src]
        for _ in range(rounds):
            last = x
            if alpha is None:
                x = last + np.bincount(dst, last[src] * w, n)  # shifted, so that it does not swing between the sides of a bipartite graph
                x = x / np.sqrt((x * x).sum())
            else:
                x = (1 - alpha + alpha * last[out == 0].sum()) / n + alpha * np.bincount(dst, last[src] * w, n)
            if np.abs(x - last).sum() < tolerance:
                break
        return ids, x

    return iterate


def _in_one_task(links: DataFrame, nodes: DataFrame, name: str, iterate) -> DataFrame:
    def work(p: pd.DataFrame) -> pd.DataFrame:
        ids, x = iterate(p)
        return pd.DataFrame({"id": ids, name: x})

    alone = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight"))
    return links.select("a", "b", F.col("weight").cast("double").alias("weight")).union(alone).groupBy().applyInPandas(work, f"id long, {name} double")


def _moved(x: DataFrame, last: DataFrame) -> float:
    """Sum of the changes of a score."""
    return x.join(last.withColumnRenamed("x", "was"), "id").agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0


def _weighted(links: DataFrame) -> DataFrame:
    return links.select("a", "b", (F.col("weight").cast("double") if "weight" in links.columns else F.lit(1.0)).alias("weight"))


def _by_size(links: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, weight) of components of up to LOCAL_LINKS links, with component and batch (a task's components), and links (a, b, weight) of larger ones."""
    of = stored(links.join(label.toDF("a", "component"), "a").select("a", "b", "weight", "component"), "labelled")
    large = stored(of.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL_LINKS).select("component"), "large")
    batches = of.count() // BATCH_LINKS + 1
    return of.join(large, "component", "left_anti").withColumn("batch", F.pmod(F.xxhash64("component"), F.lit(batches))), of.join(large, "component", "left_semi").select("a", "b", "weight")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id")).union(links.select("b")).distinct()


def _arcs(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the nodes, the component of each (0, 1, ...), and source, target and weight of the links both ways."""
    ids, ends = np.unique(np.concatenate([p["a"], p["b"]]), return_inverse=True)
    a, b = ends[: len(p)], ends[len(p) :]
    part = np.zeros(len(ids), dtype="int64")
    part[a] = np.unique(p["component"], return_inverse=True)[1]
    part[b] = part[a]
    return ids, part, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([p["weight"], p["weight"]])


def pagerank(links: DataFrame, vertices: DataFrame | None = None, rounds: int = 100, alpha: float = 0.85, tolerance: float = 1e-10, label: DataFrame | None = None) -> DataFrame:
    """(id, pagerank): weighted power iteration until the ranks move by less than ``tolerance`` together. The rank of nodes without links is dealt to all.

    What each node gets without links depends on the numbers of nodes with and without links only, so components don't
    meet: batches of them are tasks, and only components of more than LOCAL_LINKS links take a join a round. ``label`` is ``components(links)`` if that is known.
    """
    links = stored(_weighted(links), "links")
    nodes = stored(_nodes(links, vertices), "nodes")
    if links.count() <= LOCAL_LINKS and nodes.count() <= LOCAL_LINKS:
        return _in_one_task(links, nodes, "pagerank", _power(rounds, tolerance, alpha))
    heavy = links.filter("weight > 0")
    label = stored(components(heavy), "components") if label is None else label.join(_ends(heavy), "id", "left_semi")
    n, alone = nodes.count(), nodes.join(label, "id", "left_anti").select("id")
    lost, base = alone.count(), [1.0 / max(1, n)]
    for _ in range(rounds):
        base.append((1 - alpha + alpha * lost * base[-1]) / max(1, n))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        ids, _, src, dst, w = _arcs(p)
        share = w / np.bincount(src, w, len(ids))[src]
        x = np.full(len(ids), base[0])
        for k in range(1, rounds + 1):
            last, x = x, base[k] + alpha * np.bincount(dst, x[src] * share, len(ids))
            if np.abs(x - last).sum() < tolerance * len(ids) / n:
                break
        return pd.DataFrame({"id": ids, "x": x})

    small, large = _by_size(heavy, label)
    ranks = stored(small.groupBy("batch").applyInPandas(lambda p: work(p), "id long, x double"), "ranks").unionByName(alone.withColumn("x", F.lit(base[-1])))
    if large.limit(1).count():
        e = both_ways(large)
        e = stored(e.join(e.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
        x = stored(_ends(large).withColumn("x", F.lit(base[0])), "ranks")
        for k in range(1, rounds + 1):
            came = e.join(x, e.src == x.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("came"))
            last, x = x, stored(came.select("id", (F.lit(base[k]) + alpha * F.col("came")).alias("x")), "ranks")  # read several times in the next round
            if k % _EVERY == 0 and _moved(x, last) < tolerance:
                break
        ranks = ranks.unionByName(x)
    return ranks.select("id", F.col("x").alias("pagerank"))


def eigenvector(links: DataFrame, vertices: DataFrame | None = None, rounds: int = 1000, tolerance: float = 1e-10, label: DataFrame | None = None) -> DataFrame:
    """(id, eigenvector): weighted power iteration of length 1, shifted by the identity, until it moves by less than ``tolerance``; 0 in the limit for nodes outside the component that dominates.

    Components don't meet but for the length, so each keeps a vector of length 1 and the logarithm of what it has grown by:
    batches of components are tasks, and only components of more than LOCAL_LINKS links take a join a round. ``label`` is ``components(links)`` if that is known.
    """
    links = stored(_weighted(links), "links")
    nodes = stored(_nodes(links, vertices), "nodes")
    if links.count() <= LOCAL_LINKS and nodes.count() <= LOCAL_LINKS:
        return _in_one_task(links, nodes, "eigenvector", _power(rounds, tolerance, None))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        ids, part, src, dst, w = _arcs(p)
        size = np.bincount(part)
        x, grown = 1 / np.sqrt(size)[part], np.log(size) / 2
        for k in range(1, rounds + 1):
            last, x = x, x + np.bincount(dst, x[src] * w, len(ids))
            norm = np.sqrt(np.bincount(part, x * x))
            x, grown = x / norm[part], grown + np.log(norm)
            if np.abs(x - last).max() < 1e-15:
                grown += (rounds - k) * np.log(norm)
                break
        return pd.DataFrame({"id": ids, "x": x, "grown": grown[part]})

    label = stored(components(links), "components") if label is None else label
    small, large = _by_size(links, label)
    alone = nodes.join(label, "id", "left_anti").select("id", F.lit(1.0).alias("x"), F.lit(0.0).alias("grown"))
    vector = stored(small.groupBy("batch").applyInPandas(lambda p: work(p), "id long, x double, grown double"), "vector").unionByName(alone)
    if large.limit(1).count():
        e = stored(both_ways(large), "links")
        x = stored(_ends(large), "nodes")
        n = x.count()
        x, grown = x.withColumn("x", F.lit(1 / math.sqrt(n))), math.log(n) / 2
        for k in range(1, rounds + 1):
            came = e.join(x, e.src == x.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("weight")).alias("came"))
            last, x = x, stored(x.join(came, "id").select("id", (F.col("x") + F.col("came")).alias("x")), "vector")
            norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
            x, grown = x.select("id", (F.col("x") / F.lit(norm)).alias("x")), grown + math.log(norm)
            if k % _EVERY == 0 and _moved(x, last) < tolerance:
                grown += (rounds - k) * math.log(norm)
                break
        vector = vector.unionByName(x.withColumn("grown", F.lit(grown)))
    most = vector.agg(F.max("grown")).first()[0] or 0.0
    x = F.col("x") * F.exp(F.col("grown") - F.lit(most))
    length = vector.agg(F.sqrt(F.sum(x * x))).first()[0] or 1.0
    return vector.select("id", (x / F.lit(length)).alias("eigenvector"))


def by_component(links: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the links (a, b, weight) of each connected component."""
    label = components(links)
    grouped = _weighted(links).join(label.withColumnRenamed("id", "a"), "a").groupBy("component")
    return grouped.applyInPandas(lambda p: work(p), schema)


def _neighbours(p: pd.DataFrame) -> dict[int, list[int]]:
    near = defaultdict(list)
    for a, b in zip(p["a"], p["b"], strict=True):
        near[int(a)].append(int(b))
        near[int(b)].append(int(a))
    return {v: sorted(near[v]) for v in sorted(near)}


#: Sources of shortest paths that one task takes.
SOURCES = 256


def _betweenness(p: pd.DataFrame) -> pd.DataFrame:
    """Dependencies of the nodes on the sources of one batch: breadth-first levels as array operations, counts forward, shares backward."""
    ids, ends = np.unique(np.concatenate([p["a"], p["b"]]), return_inverse=True)
    src, dst = np.concatenate([ends[: len(p)], ends[len(p) :]]), np.concatenate([ends[len(p) :], ends[: len(p)]])
    n, batch, batches = len(ids), int(p["batch"].iloc[0]), int(p["batches"].iloc[0])
    score = np.zeros(n)
    for s in range(batch, n, batches):
        level, paths, steps = np.full(n, -1), np.zeros(n), []
        level[s], paths[s], depth = 0, 1.0, 0
        while True:
            along = np.flatnonzero((level[src] == depth) & (level[dst] < 0))
            if not len(along):
                break
            depth += 1
            level[dst[along]] = depth
            paths += np.bincount(dst[along], paths[src[along]], n)
            steps.append(along)
        share = np.zeros(n)
        for along in reversed(steps):
            v, w = src[along], dst[along]
            share += np.bincount(v, paths[v] / paths[w] * (1 + share[w]), n)
        share[s] = 0
        score += share
    return pd.DataFrame({"id": ids, "raw": score})


def betweenness(links: DataFrame, vertices: DataFrame | None = None, label: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): share of shortest paths through a node, links count 1, scaled by (n - 1)(n - 2) of all nodes.

    A component's sources are dealt to tasks in batches, each with the component's links; nodes without links have 0.
    """
    links = stored(links.select("a", "b"), "links")
    nodes = stored(_nodes(links, vertices), "nodes")
    label = components(links) if label is None else label
    batches = label.groupBy("component").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("batches"))
    dealt = links.join(label.withColumnRenamed("id", "a"), "a").join(batches, "component").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    raw = dealt.groupBy("component", "batch").applyInPandas(lambda p: _betweenness(p), "id long, raw double").groupBy("id").agg(F.sum("raw").alias("raw"))
    n = nodes.count()
    return nodes.join(raw, "id", "left").select("id", (F.coalesce("raw", F.lit(0.0)) / float(max(1, (n - 1) * (n - 2)))).alias("betweenness"))


def _articulation(p: pd.DataFrame) -> pd.DataFrame:
    near = _neighbours(p)
    out, seen = [], set()
    for root in near:
        if root in seen:
            continue
        low, depth, parent, children, cut = {}, {root: 0}, {root: None}, defaultdict(int), defaultdict(int)
        stack = [(root, iter(near[root]))]
        low[root] = 0
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in depth:
                    depth[w] = low[w] = len(stack)
                    parent[w] = v
                    children[v] += 1
                    stack.append((w, iter(near[w])))
                    break
                if w != parent[v]:
                    low[v] = min(low[v], depth[w])
            else:
                stack.pop()
                u = parent[v]
                if u is not None:
                    low[u] = min(low[u], low[v])
                    if u != root and low[v] >= depth[u]:
                        cut[u] += 1
        if children[root] > 1:
            cut[root] = children[root] - 1
        seen.update(depth)
        out += sorted(cut.items())
    return pd.DataFrame({"id": pd.Series([v for v, _ in out], dtype="int64"), "impact": pd.Series([k for _, k in out], dtype="int64")})


def articulation_points(links: DataFrame) -> DataFrame:
    """(id, impact) of nodes whose removal splits their component, and by how many components the count grows: the branches below a node that reach nothing above it."""
    return by_component(links, _articulation, "id long, impact long")


def _communities(whole: float | None):
    """Greedy modularity of one component in a graph of weight ``whole`` (its own if null): the pair of communities with the largest gain is merged, ties by smaller ids, while it gains."""

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        total = float(p["weight"].sum()) if whole is None else whole
        share: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        weight: dict[int, float] = defaultdict(float)
        for a, b, w in zip(p["a"].astype(int), p["b"].astype(int), p["weight"], strict=True):
            share[a][b] += w / total
            share[b][a] += w / total
            weight[a] += w / (2 * total)
            weight[b] += w / (2 * total)
        members, version = {v: [v] for v in share}, dict.fromkeys(share, 0)
        entry = lambda a, b: (round(2 * weight[a] * weight[b] - share[a][b], 15), a, b, version[a], version[b])
        heap = [entry(a, b) for a in share for b in share[a] if a < b]
        heapify(heap)
        while heap:
            loss, a, b, va, vb = heappop(heap)
            if version.get(a) != va or version.get(b) != vb:
                continue  # one of the two has grown or is gone since
            if loss >= -1e-12:
                break
            for c, w in share.pop(b).items():
                del share[c][b]
                if c != a:
                    share[a][c] += w
                    share[c][a] += w
            weight[a] += weight.pop(b)
            members[a] += members.pop(b)
            del version[b]
            version[a] += 1
            for c in share[a]:
                heappush(heap, entry(min(a, c), max(a, c)))
        rows = [(v, min(group)) for group in members.values() for v in group]
        return pd.DataFrame(rows, columns=["id", "community"])

    return merge


def communities(links: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, community): greedy modularity of the whole graph; no merge across components gains, so each is a task of its own. community is its smallest id; nodes without links are their own."""
    links = stored(_weighted(links), "links")
    total = links.agg(F.sum("weight")).first()[0] or 1.0
    found = by_component(links, _communities(float(total)), "id long, community long")
    return _nodes(links, vertices).join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def subgroups(links: DataFrame, size: int = 8, least: int = 3) -> DataFrame:
    """(id, component, community) of communities of ``least`` members or more in components of ``size`` nodes or more that have two such communities.

    Each component is taken by itself, its links without weights, as in ``communities`` otherwise.
    """
    label = stored(components(links.select("a", "b")), "components")
    large = label.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= size).select("component")
    inside = stored(links.select("a", "b").join(label.toDF("a", "component"), "a").join(large, "component", "left_semi").select("a", "b", "component", F.lit(1.0).alias("weight")), "inside")
    merge = _communities(None)
    found = stored(inside.groupBy("component").applyInPandas(lambda p: merge(p).assign(component=p["component"].iloc[0]), "id long, community long, component long"), "communities")
    groups = found.groupBy("component", "community").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    several = groups.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 2")
    return found.join(groups.select("component", "community"), ["component", "community"], "left_semi").join(several.select("component"), "component", "left_semi").select("id", "component", "community")


def modularity(links: DataFrame, assigned: DataFrame) -> DataFrame:
    """(community, part): parts of the modularity, which is their sum."""
    e = both_ways(links).join(assigned.toDF("src", "cs"), "src").join(assigned.toDF("dst", "cd"), "dst")
    total = e.agg(F.sum("weight").alias("m2"))  # one row
    g = e.groupBy(F.col("cs").alias("community")).agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    return g.join(F.broadcast(total)).select("community", (F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("part"))


def foreign_communities(links: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, bridging): communities among the neighbours other than the own one."""
    e = both_ways(links).join(assigned.toDF("src", "cs"), "src").join(assigned.toDF("dst", "cd"), "dst")
    return e.groupBy(F.col("src").alias("id")).agg(F.countDistinct(F.when(F.col("cs") != F.col("cd"), F.col("cd"))).alias("bridging"))


def influence(links: DataFrame, prior: DataFrame, assigned: DataFrame, vertices: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """(id, score, baseline, phi_<part> for each part, driver, place): weighted sum of six scaled parts, and its exact attribution.

    ``prior`` is (id, prior), ``assigned`` is (id, community), ``between`` (id, betweenness) if that is known. phi = weight * (part - mean part), so baseline + sum of phi = score.
    """
    links = stored(_weighted(links), "links")
    nodes = stored(_nodes(links, vertices), "nodes")
    degree = both_ways(links).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    label = components(links)
    tables = [betweenness(links, nodes, label) if between is None else between, pagerank(links, nodes, label=label), eigenvector(links, nodes, label=label), foreign_communities(links, assigned), degree, prior.select("id", F.col("prior").cast("double").alias("prior"))]
    parts = reduce(lambda x, y: x.join(y, "id", "left"), tables, nodes)
    parts = stored(parts.select("id", *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in config.INFLUENCE_WEIGHTS]), "parts")
    w = config.INFLUENCE_WEIGHTS
    x = stored(min_max(parts, list(w)), "scaled")
    means = x.agg(*[F.avg(k).alias(f"mean_{k}") for k in w])  # one row
    x = x.join(F.broadcast(means))
    phi = {f"phi_{k}": v * (F.col(k) - F.col(f"mean_{k}")) for k, v in w.items()}
    x = x.withColumns({"score": sum(v * F.col(k) for k, v in w.items()), "baseline": sum(v * F.col(f"mean_{k}") for k, v in w.items()), **phi})
    top = F.array_max(F.array(*[F.struct(F.col(p).alias("phi"), F.lit(p[4:]).alias("name")) for p in phi]))["name"]
    x = x.select("id", "score", "baseline", *phi, top.alias("driver"))
    return ranked(x, [F.desc(F.round("score", 6)), F.asc("id")], "place")


def neighbourhood(links: DataFrame, start: Column, hops: int) -> DataFrame:
    """(id, distance) of nodes within ``hops`` of the nodes for which ``start`` (of ``id``) is true; a frontier at a time."""
    e = stored(both_ways(links).select("src", "dst"), "links")
    known = e.select(F.col("src").alias("id")).distinct().filter(start).withColumn("distance", F.lit(0))
    front = known
    for k in range(1, hops + 1):
        front = e.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(known.select("id"), "id", "left_anti").withColumn("distance", F.lit(k))
        front = stored(front, "frontier")
        known = known.unionByName(front)
    return known


def simple_paths(links: DataFrame, source: int, target: int, cutoff: int, confidence: str | None = None) -> DataFrame:
    """(path, hops, confidence): all paths without a repeated node of ``cutoff`` links at most, with the product of the links' confidences. Only steps that can still reach the target in time are taken."""
    c = F.col(confidence) if confidence else F.lit(1.0)
    e = links.select("a", "b", c.alias("c"))
    e = stored(e.toDF("src", "dst", "c").unionAll(e.select("b", "a", "c")), "links")
    left = stored(neighbourhood(links, F.col("id") == target, cutoff - 1).select(F.col("id").alias("dst"), F.col("distance").alias("left")), "left")
    e = stored(e.join(left, "dst"), "near")
    open_ = e.filter((F.col("src") == source) & (F.col("left") <= cutoff - 1)).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("c").alias("confidence"))
    done = open_.filter(F.col("at") == target)
    for k in range(2, cutoff + 1):
        front = open_.filter(F.col("at") != target)
        step = e.filter(F.col("left") <= cutoff - k).join(front, e.src == front["at"]).filter(~F.array_contains("path", F.col("dst")))
        open_ = stored(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("confidence") * F.col("c")).alias("confidence")), "paths")
        done = done.unionByName(open_.filter(F.col("at") == target))
    return done.select("path", (F.size("path") - 1).alias("hops"), "confidence")


def shortest_paths(links: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """(path, hops): the paths of least length, if that is ``depth`` at most: a breadth-first frontier with the links into it, up to the level that holds the target, then back along those links."""
    e = stored(both_ways(links).select("src", "dst").distinct(), "links")
    known = e.select(F.col("src").alias("id")).filter(F.col("id") == source).distinct()
    into: list[DataFrame] = []
    front = known
    while len(into) < depth:
        step = stored(e.join(front.withColumnRenamed("id", "src"), "src").join(known.withColumnRenamed("id", "dst"), "dst", "left_anti"), "into")
        into.append(step)
        front = step.select(F.col("dst").alias("id")).distinct()
        known = known.union(front)
        if source == target or step.filter(F.col("dst") == target).limit(1).count() or not step.limit(1).count():
            break
    paths = into[-1].filter(F.col("dst") == target).select(F.array("src", "dst").alias("path"))
    for step in reversed(into[:-1]):
        paths = paths.join(step, F.element_at("path", 1) == F.col("dst")).select(F.concat(F.array("src"), "path").alias("path"))
    return paths.select("path", (F.size("path") - 1).alias("hops"))


def clustering(links: DataFrame) -> DataFrame:
    """(id, degree, closed, coefficient): triangles over pairs of neighbours. Each triangle is found once, from its ends of smaller degree."""
    e = both_ways(links).select("src", "dst").distinct()
    d = e.groupBy("src").agg(F.count("*").alias("degree"))
    by = e.filter("src < dst").join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = stored(by.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")), "oriented")
    wedge = out.toDF("u", "v").join(out.toDF("u", "w"), "u").filter("v < w")
    tri = wedge.join(e.toDF("v", "w"), ["v", "w"]).select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("closed"))
    return d.withColumnRenamed("src", "id").join(tri, "id", "left").select(
        "id", "degree", F.coalesce("closed", F.lit(0)).alias("closed"),
        F.when(F.col("degree") > 1, F.coalesce("closed", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1) / 2)).otherwise(0.0).alias("coefficient"),
    )


def cycles(edges: DataFrame, least: float, longest: int = 5) -> DataFrame:
    """(nodes, total): directed cycles of 3 to ``longest`` (src, dst, amount) edges with a total of ``least`` or more; one of each node set, the largest."""
    e = edges.filter("src != dst").select("src", "dst", "amount")
    walk = e.select(F.col("src").alias("first"), F.array("src", "dst").alias("nodes"), F.col("dst").alias("at"), F.col("amount").alias("total")).filter("at > first")
    found = None
    for k in range(2, longest + 1):
        step = walk.join(e, walk["at"] == e["src"])
        if k >= 3:
            closed = step.filter(F.col("dst") == F.col("first")).select(F.sort_array("nodes").alias("nodes"), (F.col("total") + F.col("amount")).alias("total"))
            found = closed if found is None else found.unionByName(closed)
        if k < longest:
            walk = stored(step.filter((F.col("dst") > F.col("first")) & ~F.array_contains("nodes", F.col("dst"))).select("first", F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("at"), (F.col("total") + F.col("amount")).alias("total")), "walks")
    return found.groupBy("nodes").agg(F.max("total").alias("total")).filter(F.col("total") >= least)


def impact_of_removal(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, impact): by how many components the count grows if a node (id) goes; 0 for nodes that split nothing."""
    return nodes.select("id").join(articulation_points(links), "id", "left").select("id", F.coalesce("impact", F.lit(0).cast("long")).alias("impact"))


def bridge_scores(links: DataFrame, reach: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, score): nodes of degree 2 or more by betweenness, impact of removal and reach (id, reach) of the merged graph, each scaled."""
    degree = both_ways(links).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).filter("degree >= 2")
    links = stored(links, "links")
    impact = articulation_points(links)
    x = degree.join(betweenness(links, vertices), "id").join(impact, "id", "left").join(reach, "id", "left").select("id", "degree", "betweenness", F.coalesce("impact", F.lit(0)).alias("impact"), F.coalesce("reach", F.lit(1)).alias("reach"))
    x = stored(x, "bridges")
    most = x.agg(*[F.max(c).alias(f"max_{c}") for c in ("betweenness", "impact", "reach")])  # one row
    part = lambda c, less=0: F.when(F.col(f"max_{c}") > less, (F.col(c) - less) / (F.col(f"max_{c}") - less)).otherwise(0.0)
    b, i, r = config.BRIDGE_WEIGHTS
    score = F.round(b * part("betweenness") + i * part("impact") + r * part("reach", 1), 3)
    return x.join(F.broadcast(most)).select("id", "degree", score.alias("score")).filter(F.col("score") >= config.BRIDGE_LEAST)


def within_hops(links: DataFrame, hops: int, starts: DataFrame | None = None) -> DataFrame:
    """(s, v, d): every node within ``hops`` of every node, or of the ids in ``starts``, itself left out. As large as those neighbourhoods are."""
    e = stored(both_ways(links).select("src", "dst"), "links")
    ids = (e.select(F.col("src").alias("id")) if starts is None else starts.select("id")).distinct()
    known = front = ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"))
    for k in range(1, hops + 1):
        front = front.join(e, front["v"] == e["src"]).select("s", F.col("dst").alias("v")).distinct().join(known.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(k))
        front = stored(front, "frontier")
        known = known.unionByName(front)
    return known.filter("d > 0")
