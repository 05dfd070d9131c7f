"""Graph operators (G1-G11, G14, J6-J10, A5). Nothing gathers a frontier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.lineage import cut

TYPED = ("cites",)


def _steps(edges: DataFrame, direction: str, edge_types: tuple[str, ...] | None) -> DataFrame:
    """(u, v): the steps a walk may take."""
    own = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    out, into = own.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")), own.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))
    return (out if direction == "out" else into if direction == "in" else out.union(into)).distinct()


def distances(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", edge_types: tuple[str, ...] | None = TYPED) -> DataFrame:
    """(start, node_id, hops): breadth-first layers from every start at once; hop 0 is the start itself.

    Each layer is one join of the frontier with the steps and one anti-join with what was seen.
    """
    steps = cut(_steps(edges, direction, edge_types))
    seen = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        nxt = front.join(steps, front["node_id"] == steps["u"]).select("start", F.col("v").alias("node_id")).distinct().join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        front = cut(nxt.withColumn("hops", F.lit(hop)))
        seen = cut(seen.unionByName(front))
        if not front.limit(1).count():
            break
    return seen


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", edge_types: tuple[str, ...] | None = TYPED) -> DataFrame:
    """G1: nodes reached, without the start; ids without a node row are walked through but not returned."""
    return distances(edges, starts, depth, direction, edge_types).where("hops > 0").join(nodes.select("node_id"), "node_id", "left_semi")


def shortest_path(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(start, goal, hops, path) over undirected edges of all types; of equal paths the one of least ids backwards. Pairs too far apart are absent."""
    steps = cut(_steps(edges, "both", None))
    starts = pairs.select(F.col("start").alias("node_id")).distinct()
    seen = cut(starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("hops"), F.array("node_id").alias("path")))
    front, found = seen, None
    wanted = pairs.select("start", "goal").distinct()
    for hop in range(depth + 1):
        hit = front.join(wanted, (front["start"] == wanted["start"]) & (front["node_id"] == wanted["goal"])).select(front["start"], "goal", "hops", "path")
        found = cut(hit if found is None else found.unionByName(hit))
        if hop == depth or not wanted.join(found, ["start", "goal"], "left_anti").limit(1).count():
            break
        # One parent for each new node: the least, so that paths don't multiply.
        nxt = front.join(steps, front["node_id"] == steps["u"]).groupBy("start", F.col("v").alias("node_id")).agg(F.min(F.struct("u", "path")).alias("p"))
        front = cut(nxt.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(hop + 1).alias("hops"), F.concat("p.path", F.array("node_id")).alias("path")))
        seen = cut(seen.select("start", "node_id").unionByName(front.select("start", "node_id")).withColumn("hops", F.lit(0)))
        if not front.limit(1).count():
            break
    return found


def _inside(nodes: DataFrame, edges: DataFrame, edge_types: tuple[str, ...] | None) -> DataFrame:
    """(u, v) of edges with both ends among the nodes; parallel edges stay."""
    own = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    ids = nodes.select("node_id")
    return own.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, edge_types: tuple[str, ...] | None = TYPED, every: int = 5) -> DataFrame:
    """(node_id, pagerank) after a fixed number of iterations. The mass of nodes without outgoing edges is lost.

    Links carry their source's degree, so an iteration is one join and one sum
    with map-side partials. Nodes and links are kept dealt by node while the
    iterations last, so only the sums are shuffled; lineage is cut every few iterations.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = nodes.select("node_id").distinct().repartition(parts, "node_id").persist()
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    links = _inside(nodes, edges, edge_types).groupBy("u", "v").agg(F.count("*").alias("k"))
    degree = links.groupBy("u").agg(F.sum("k").alias("d"))
    links = links.join(degree, "u").select("u", "v", (F.col("k") / F.col("d")).alias("w")).repartition(parts, "u").persist()
    score = ids.withColumn("pagerank", F.lit(1.0 / n))
    for i in range(iterations):
        sent = links.join(score, links["u"] == score["node_id"]).groupBy(F.col("v").alias("node_id")).agg(F.sum(F.col("w") * F.col("pagerank")).alias("s"))
        score = ids.join(sent, "node_id", "left").select("node_id", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("pagerank"))
        if i % every == every - 1 or i + 1 == iterations:
            score = cut(score)
    links.unpersist()
    ids.unpersist()
    return score


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = 100, epsilon: float = 1e-6, edge_types: tuple[str, ...] | None = TYPED) -> DataFrame:
    """(node_id, hub, authority). Hubs sum the new authorities before those are normalised; both then get norm 1."""
    ids = cut(nodes.select("node_id").distinct())
    links = cut(_inside(nodes, edges, edge_types))
    score = cut(ids.select("node_id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))
    for _ in range(iterations):
        auth = links.join(score, links["u"] == score["node_id"]).groupBy("v").agg(F.sum("hub").alias("a"))
        hub = links.join(auth, "v").groupBy("u").agg(F.sum("a").alias("h"))
        raw = cut(
            score.join(auth.withColumnRenamed("v", "node_id"), "node_id", "left").join(hub.withColumnRenamed("u", "node_id"), "node_id", "left")
            .select("node_id", F.col("hub").alias("hub0"), F.col("authority").alias("authority0"), F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"))
        )
        nh, na = (x**0.5 for x in raw.agg(F.coalesce(F.sum(F.col("h") ** 2), F.lit(0.0)), F.coalesce(F.sum(F.col("a") ** 2), F.lit(0.0))).first())
        new = raw.select("node_id", (F.col("h") / (nh or 1.0)).alias("hub"), (F.col("a") / (na or 1.0)).alias("authority"), "hub0", "authority0")
        delta = new.agg(F.max(F.greatest(F.abs(F.col("hub") - F.col("hub0")), F.abs(F.col("authority") - F.col("authority0"))))).first()[0]
        score = new.select("node_id", "hub", "authority")
        if delta is None or delta < epsilon:
            break
    return score


def citer_counts(edges: DataFrame) -> DataFrame:
    """A5: incoming citations of each node; parallel edges count."""
    return edges.where("edge_type = 'cites'").groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("citers"))


def co_citations(edges: DataFrame, pairs: DataFrame, most_inbound: int | None = None) -> DataFrame:
    """(a, b, co_citations) for given pairs: distinct sources that cite both, but for a and b. A pair with a node of too many inbound edges counts 0 if a limit is given."""
    cites = edges.where("edge_type = 'cites'").select("source_id", "target_id").distinct()
    to = lambda x: cites.select(F.col("target_id").alias(x), "source_id")
    met = pairs.join(to("a"), "a").join(to("b"), ["b", "source_id"]).where("source_id != a and source_id != b")
    counted = pairs.join(met.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").withColumn("co_citations", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")
    if most_inbound is not None:
        c = citer_counts(edges)
        near = counted.join(c.toDF("a", "ca"), "a", "left").join(c.toDF("b", "cb"), "b", "left")
        counted = near.withColumn("co_citations", F.when((F.coalesce("ca", F.lit(0)) > most_inbound) | (F.coalesce("cb", F.lit(0)) > most_inbound), 0).otherwise(F.col("co_citations"))).select(counted.columns)
    return counted


def coupling(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, strength, shared_refs) for given pairs: Jaccard similarity of the sets of references; 0 where both are empty."""
    sets = refs.select("source_id", "target_id").distinct()
    size = sets.groupBy("source_id").agg(F.count("*").alias("n"))
    to = lambda x: sets.select(F.col("source_id").alias(x), "target_id")
    shared = pairs.join(to("a"), "a").join(to("b"), ["b", "target_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list("target_id")).alias("shared_refs"))
    got = pairs.join(shared, ["a", "b"], "left").join(size.toDF("a", "na"), "a", "left").join(size.toDF("b", "nb"), "b", "left")
    n, either = F.coalesce("shared", F.lit(0).cast("bigint")), F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - F.coalesce("shared", F.lit(0))
    return got.select("a", "b", n.alias("shared"), F.when(either > 0, n / either).otherwise(0.0).alias("strength"), F.coalesce("shared_refs", F.array().cast("array<bigint>")).alias("shared_refs"))


def coupling_top(refs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k papers coupled most with each seed, ties by the other paper's id.

    Only papers that share a reference are met, through the references of the seeds.
    """
    sets = refs.select("source_id", "target_id").distinct()
    size = sets.groupBy("source_id").agg(F.count("*").alias("n"))
    own = sets.join(seeds.select(F.col("seed").alias("source_id")).distinct(), "source_id", "left_semi").select(F.col("source_id").alias("seed"), "target_id")
    shared = own.join(sets, "target_id").where("seed != source_id").groupBy("seed", F.col("source_id").alias("other")).agg(F.count("*").alias("shared"))
    scored = shared.join(size.toDF("seed", "ns"), "seed").join(size.toDF("other", "no"), "other").withColumn("strength", F.col("shared") / (F.col("ns") + F.col("no") - F.col("shared")))
    return top_per(scored.select("seed", "other", "shared", "strength"), ["seed"], [F.col("strength").desc(), F.col("other")], k)


def top_per(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in an order."""
    out = df.withColumn(rank or "_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank or "_r") <= k)
    return out if rank else out.drop("_r")


def max_normalised(df: DataFrame, value: str, key: list[str], name: str) -> DataFrame:
    """Value over its key's largest; 0 where that is not above 0. The largest comes from a partial aggregate."""
    most = df.groupBy(*key).agg(F.max(value).alias("_most"))
    return df.join(most, key).withColumn(name, F.when(F.col("_most") > 0, F.col(value) / F.col("_most")).otherwise(0.0)).drop("_most")


def influence(nodes: DataFrame, edges: DataFrame, as_of_year: int, iterations: int = 20, hits_iterations: int = 100) -> DataFrame:
    """node_id, citation_count, velocity, pagerank, hub, authority."""
    from inkwell.functions.scores import citation_velocity

    v = citation_velocity(F.col("citation_count"), F.lit(None).cast("date"), F.col("year"), as_of_year)
    pr, h = pagerank(nodes, edges, iterations=iterations), hits(nodes, edges, iterations=hits_iterations)
    out = nodes.select("node_id", "citation_count", v.alias("velocity")).join(pr, "node_id", "left").join(h, "node_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("node_id", "citation_count", "velocity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), zero("pagerank"))).alias("pagerank"), zero("hub").alias("hub"), zero("authority").alias("authority"))


def recommend_similar(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Of the nodes within two hops either way the k coupled most with each seed."""
    near = traverse(nodes, edges, seeds, 2, "both").select(F.col("start").alias("a"), F.col("node_id").alias("b"))
    cites = edges.where("edge_type = 'cites'")
    scored = coupling(cites, near).where("strength > 0").select(F.col("a").alias("seed"), F.col("b").alias("node_id"), F.col("strength").alias("score"))
    return top_per(scored, ["seed"], [F.col("score").desc(), F.col("node_id")], k)


def recommend_predecessors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """Of the nodes that each seed's citations reach in two hops the k of highest PageRank."""
    found = traverse(nodes, edges, seeds, 2, "out").select(F.col("start").alias("seed"), "node_id").join(ranks, "node_id")
    scored = max_normalised(found, "pagerank", ["seed"], "score").select("seed", "node_id", "score")
    return top_per(scored, ["seed"], [F.col("score").desc(), F.col("node_id")], k)


def recommend_successors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, as_of_year: int, k: int, years: int = 2) -> DataFrame:
    """Of the recent nodes that reach each seed in two hops the k of highest citation velocity."""
    from inkwell.functions.scores import citation_velocity

    recent = nodes.where(F.col("year") >= as_of_year - years).select("node_id", citation_velocity(F.col("citation_count"), F.lit(None).cast("date"), F.col("year"), as_of_year).alias("velocity"))
    found = traverse(nodes, edges, seeds, 2, "in").select(F.col("start").alias("seed"), "node_id").join(recent, "node_id")
    scored = max_normalised(found, "velocity", ["seed"], "score").select("seed", "node_id", "score")
    return top_per(scored, ["seed"], [F.col("score").desc(), F.col("node_id")], k)


def recommend_bridges(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int, least: int = 2) -> DataFrame:
    """Nodes within two hops that several nodes at exactly three hops cite."""
    layers = cut(distances(edges, seeds, 3, "both"))
    far = layers.where("hops = 3").select(F.col("start").alias("seed"), F.col("node_id").alias("source_id"))
    near = layers.where("hops between 1 and 2").select(F.col("start").alias("seed"), F.col("node_id").alias("target_id"))
    cites = edges.where("edge_type = 'cites'").select("source_id", "target_id").distinct()
    counted = far.join(cites, "source_id").join(near, ["seed", "target_id"], "left_semi").groupBy("seed", F.col("target_id").alias("node_id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counted = counted.join(nodes.select("node_id"), "node_id", "left_semi")
    scored = max_normalised(counted, "n", ["seed"], "score").select("seed", "node_id", "score")
    return top_per(scored, ["seed"], [F.col("score").desc(), F.col("node_id")], k)


def crawl(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, per_node: int, order: list[Column]) -> DataFrame:
    """(start, node_id, hops): at each hop a node's neighbours, its best few in either direction, that weren't seen."""
    facts = nodes.select(F.col("node_id").alias("v"), *(c for c in nodes.columns if c != "node_id"))
    best = None
    for direction in ("out", "in"):
        ranked = top_per(_steps(edges, direction, TYPED).join(facts, "v"), ["u"], [*order, F.col("v")], per_node).select("u", "v")
        best = ranked if best is None else best.union(ranked)
    kept = best.distinct().select(F.col("u").alias("source_id"), F.col("v").alias("target_id"), F.lit("cites").alias("edge_type"))
    return distances(kept, seeds, depth, "out")
