"""Graph and table storage operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """Rows of one key, or a key that is already stored."""


class StaleVersion(ValueError):
    """A row has another version than the update expects."""


def merge_properties(old: Column, new: Column) -> Column:
    """F-MAP1: both maps' entries, the new ones winning, whatever the session's policy for repeated keys is."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def checked_insert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K1, K6: all rows or none; a key that repeats or is stored raises."""
    twice = new.groupBy(key).count().where("count > 1").limit(1).count()
    if twice or new.join(table.select(key), key, "left_semi").limit(1).count():
        raise DuplicateKey(f"a {key} is there already")
    return table.unionByName(new)


def update_checked(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """K3: updates (key, expected_version, new_properties) merge properties and raise the version; a stale one raises."""
    stale = updates.join(table.select(key, "version"), key).where("version != expected_version").limit(1).count()
    if stale:
        raise StaleVersion(f"a {key} has another version")
    hit = F.col("expected_version").isNotNull()
    return table.join(updates, key, "left").select(
        *(
            F.when(hit, merge_properties(F.col(c), F.col("new_properties"))).otherwise(F.col(c)).alias(c) if c == "properties" else F.when(hit, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "version" else F.col(c)
            for c in table.columns
        )
    )


def edges_of(edges: DataFrame, node, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """Outgoing and incoming edges; a loop comes twice for both."""
    own = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out, into = own.where(F.col("source_id") == node), own.where(F.col("target_id") == node)
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def by_property(nodes: DataFrame, key: str, value: str, node_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes whose JSON property equals a value."""
    if not key.replace("_", "").isalnum():
        raise ValueError(f"not a property name: {key!r}")
    found = nodes.where(F.get_json_object("properties", f"$.{key}") == value)
    found = found if node_type is None else found.where(F.col("node_type") == node_type)
    return found if limit is None else found.orderBy("node_id").limit(limit)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the given ids, and edges without those at either end."""
    ids = gone.select("node_id")
    left = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.select(edges.columns)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """O9."""
    return df.orderBy(*order).offset(offset).limit(limit)


def add_capped(table: DataFrame, new: DataFrame, owner: str, cap: int) -> DataFrame:
    """Append unless an owner would have more rows than the cap."""
    counts = table.select(owner).unionAll(new.select(owner)).groupBy(owner).count()
    if counts.where(F.col("count") > cap).limit(1).count():
        raise ValueError(f"more than {cap} rows for a {owner}")
    return table.unionByName(new)


def update_known(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace single rows; a key that isn't stored raises."""
    if new.join(table.select(key), key, "left_anti").limit(1).count():
        raise KeyError(key)
    return table.join(new.select(key), key, "left_anti").unionByName(new)
