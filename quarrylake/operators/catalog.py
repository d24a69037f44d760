"""Hierarchies as a catalog: ``nodes(path, parent, name, node_type, link_type,
target)`` and ``attributes(path, name, kind, value)``.

Navigation is filtering; link and scope resolution are bounded joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MAX_LINK_HOPS, LinkResolutionFailed, NotFound
from ..plans.cut import follow


def normalise(path: str, base: str = "/") -> str:
    """Absolute path without empty components; relative paths start at ``base``."""
    whole = path if path.startswith("/") else f"{base}/{path}"
    return "/" + "/".join(p for p in whole.split("/") if p and p != ".")


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("parent") == normalise(path))


def child_counts(nodes: DataFrame) -> DataFrame:
    """(path, n) for every group, empty ones included."""
    n = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    groups = nodes.where("node_type = 'group'").select("path")
    return groups.join(n, groups["path"] == n["parent"], "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def node(nodes: DataFrame, path: str):
    """The row of one path."""
    row = nodes.where(F.col("path") == normalise(path)).first()
    if row is None:
        raise NotFound(path)
    return row


def attributes_of(attributes: DataFrame, path: str, name: str | None = None) -> DataFrame:
    rows = attributes.where(F.col("path") == normalise(path))
    return rows if name is None else rows.where(F.col("name") == name)


def resolve_links(nodes: DataFrame, hops: int = MAX_LINK_HOPS) -> DataFrame:
    """Rows (path, resolved, hops, status) of all soft links.

    Targets are absolute or relative to the link's parent.  status is ok, dangling,
    external (left unresolved) or too_long (more than ``hops``).
    """
    target = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(
        F.concat(F.when(F.col("parent") == "/", "").otherwise(F.col("parent")), F.lit("/"), F.col("target"))
    )
    links = nodes.select("path", F.coalesce("link_type", F.lit("hard")).alias("kind"), F.regexp_replace(target, "/+", "/").alias("to"))
    walks = follow(links.select(F.col("path").alias("key"), F.when(F.col("kind") == "soft", F.col("to")).alias("to")), hops + 1)
    ends = links.select(F.col("path").alias("at"), F.col("kind").alias("end"))
    rows = links.where("kind = 'soft'").select(F.col("path").alias("key")).join(walks, "key").join(ends, "at", "left")
    status = (
        F.when(F.col("end").isNull(), "dangling").when((F.col("end") == "soft") | (F.col("hops") > hops), "too_long").when(F.col("end") == "external", "external").otherwise("ok")
    )
    return rows.select(
        F.col("key").alias("path"),
        F.when(status.isin("ok", "external"), F.col("at")).alias("resolved"),
        F.least(F.col("hops"), F.lit(hops)).cast("long").alias("hops"),
        status.alias("status"),
    )


def resolve(nodes: DataFrame, path: str) -> str:
    """The path behind one path; raises where the chain does not end at a node."""
    row = node(nodes, path)
    if row["link_type"] in (None, "hard"):
        return row["path"]
    found = resolve_links(nodes).where(F.col("path") == row["path"]).first()
    if found["status"] != "ok":
        raise LinkResolutionFailed(f"{path}: {found['status']}")
    return found["resolved"]


def dimension_scope(variables: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Binds each (variable, group, dim) to the dimension of that name in its own group or
    the nearest group outward; unresolved ones have nulls.

    Every group has few ancestors, so a variable meets its candidates by an equi-join on
    (group, name) after its ancestor paths are listed.
    """
    parts = F.filter(F.split("group", "/"), lambda p: p != "")
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    rows = variables.select("*", F.explode(scopes).alias("_scope"))
    known = dimensions.select(F.col("group").alias("_scope"), F.col("name").alias("dim"), F.col("size").alias("_size"))
    rows = rows.join(known, ["_scope", "dim"], "left")
    near = Window.partitionBy("variable", "group", "dim").orderBy(F.col("_size").isNull(), F.desc(F.length("_scope")))
    best = rows.withColumn("_k", F.row_number().over(near)).where("_k = 1")
    return best.select("variable", "group", "dim", F.when(F.col("_size").isNotNull(), F.col("_scope")).alias("scope"), F.col("_size").alias("size"))


def dimension_names(variables: DataFrame, scales: DataFrame) -> DataFrame:
    """Names of a variable's axes: the bound scale's name, else ``d<axis>``.

    ``variables(variable, axis, scale)``; ``scales(scale, name)``.
    """
    default = F.concat(F.lit("d"), F.col("axis").cast("string"))
    bound = variables.where("scale is not null").join(scales, "scale", "left")
    # axes without a scale stay out of the join, where their one key would meet in a task
    lone = variables.where("scale is null").select("variable", "axis", default.alias("name"))
    return bound.select("variable", "axis", F.coalesce("name", default).alias("name")).union(lone)
