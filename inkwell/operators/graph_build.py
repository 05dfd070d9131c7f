"""Citation graphs from providers' answers (G12) and the graph store as one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import edge_key
from inkwell.operators import graph as G
from inkwell.operators import store

#: Labels of a graph that no provider, or more than one, answered for.
NO_PROVIDER, SEVERAL = "none", "both"


def first_answers(answers: DataFrame) -> DataFrame:
    """For each (seed, direction) the first provider that answered; an empty answer is one, an error is not. answers: seed, direction, place, provider, seed_id, error."""
    good = F.when(F.col("error").isNull(), F.struct("place", "provider", "seed_id"))
    return answers.groupBy("seed", "direction").agg(F.min(good).alias("x")).where("x is not null").select("seed", "direction", "x.provider", "x.seed_id")


def build(answers: DataFrame, related: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes, new edges and (seed, provider_used, nodes_added, edges_added, errors), for all seeds at once.

    related: seed, direction (out, in), provider, place, node_id: at most
    ``most`` rows of each answer count, in order of place. What is stored in
    nodes (node_id) and edges (edge_id) stays; a node or edge that several seeds
    bring counts for the least seed. Errors of providers tried before the answer
    are kept, in order.
    """
    chosen = first_answers(answers)
    got = G.top_per(related.join(chosen, ["seed", "direction", "provider"]), ["seed", "direction"], [F.col("place"), F.col("node_id")], most)
    found = chosen.select("seed", F.col("seed_id").alias("node_id")).unionByName(got.select("seed", "node_id"))
    new_nodes = found.groupBy("node_id").agg(F.min("seed").alias("seed")).join(nodes.select("node_id"), "node_id", "left_anti")
    out = F.col("direction") == "out"
    pairs = got.select("seed", F.when(out, F.col("seed_id")).otherwise(F.col("node_id")).alias("source_id"), F.when(out, F.col("node_id")).otherwise(F.col("seed_id")).alias("target_id"))
    new_edges = pairs.groupBy("source_id", "target_id").agg(F.min("seed").alias("seed")).withColumn("edge_id", edge_key(F.col("source_id").cast("string"), F.col("target_id").cast("string")))
    new_edges = new_edges.join(edges.select("edge_id"), "edge_id", "left_anti").withColumn("edge_type", F.lit("cites"))
    tried = answers.join(chosen.select("seed", "direction", F.col("provider").alias("_used")), ["seed", "direction"], "left")
    used = F.array_distinct(F.collect_list(F.when(F.col("provider") == F.col("_used"), F.col("provider"))))
    label = F.when(F.size(used) == 0, NO_PROVIDER).when(F.size(used) == 1, used[0]).otherwise(SEVERAL)
    failed = F.when(F.col("error").isNotNull(), F.struct(F.col("direction") == "in", "place", F.concat_ws(": ", "provider", F.regexp_replace("error", r"[\r\n]+", " ")).alias("text")))
    told = tried.groupBy("seed").agg(label.alias("provider_used"), F.transform(F.array_sort(F.collect_list(failed)), lambda e: e["text"]).alias("errors"))
    count = lambda df, name: df.groupBy("seed").agg(F.count("*").alias(name))
    done = told.join(count(new_nodes, "nodes_added"), "seed", "left").join(count(new_edges, "edges_added"), "seed", "left").na.fill(0, ["nodes_added", "edges_added"])
    return new_nodes.select("node_id"), new_edges.select("edge_id", "edge_type", "source_id", "target_id"), done.select("seed", "provider_used", "nodes_added", "edges_added", "errors")


@dataclass(frozen=True)
class Graph:
    """Nodes and edges as one store. Changes give a new store; nothing is read before an action.

    X2 is ``ids`` and ``links``, all that PageRank needs; X6 is ``coupling_of``
    and ``coupled_with``.
    """

    nodes: DataFrame
    edges: DataFrame

    def ids(self) -> DataFrame:
        return self.nodes.select("node_id")

    def links(self, edge_type: str = "cites") -> DataFrame:
        return self.edges.where(F.col("edge_type") == edge_type).select("source_id", "target_id")

    def add_nodes(self, new: DataFrame) -> Graph:
        return Graph(store.checked_insert(self.nodes, new, "node_id"), self.edges)

    def add_edges(self, new: DataFrame) -> Graph:
        return Graph(self.nodes, store.checked_insert(self.edges, new, "edge_id"))

    def delete(self, gone: DataFrame) -> Graph:
        return Graph(*store.delete_nodes(self.nodes, self.edges, gone))

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.nodes.join(ids.select("node_id"), "node_id", "left_semi")

    def edges_of(self, node, direction: str = "both", edge_type: str | None = None) -> DataFrame:
        return store.edges_of(self.edges, node, direction, edge_type)

    def with_property(self, key: str, value: str, **more) -> DataFrame:
        return store.by_property(self.nodes, key, value, **more)

    def page(self, order: list[Column], offset: int, limit: int) -> DataFrame:
        return store.page(self.nodes, order, offset, limit)

    def traverse(self, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
        return G.traverse(self.nodes, self.edges, starts, depth, direction)

    def shortest_paths(self, pairs: DataFrame, depth: int) -> DataFrame:
        return G.shortest_path(self.edges, pairs, depth)

    def pagerank(self, **more) -> DataFrame:
        return G.pagerank(self.ids(), self.edges, **more)

    def coupling_of(self, pairs: DataFrame) -> DataFrame:
        return G.coupling(self.links(), pairs)

    def coupled_with(self, seeds: DataFrame, k: int) -> DataFrame:
        return G.coupling_top(self.links(), seeds, k)

    def counts(self) -> DataFrame:
        one = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).alias("kind")).agg(F.count("*").alias("n"))
        return one(self.nodes, "node", "node_type").union(one(self.edges, "edge", "edge_type"))
