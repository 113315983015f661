"""Property-graph upserts, neighbourhoods, communities and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs
from weft.operators.components import connected_components
from weft.session import cut


def upsert(rows: DataFrame, keys: list[str], order: list[str], kept: tuple[str, ...] = (), stamp: str | None = None) -> DataFrame:
    """Last row of each key wins wholesale, nulls included; ``kept`` columns keep their last non-null value.

    With ``stamp``, ``created_at`` is its first value and ``updated_at`` its last if the key was seen again.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.struct(*order, *[c for c in rest if c not in order])
    held = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))).alias(f"_{c}") for c in kept]
    times = [F.min(stamp).alias("created_at"), F.when(F.count(F.lit(1)) > 1, F.max(stamp)).alias("updated_at")] if stamp else []
    merged = rows.groupBy(*keys).agg(F.max(last).alias("_r"), *held, *times)
    out = [(F.col(f"_{c}._v") if c in kept else F.col(f"_r.{c}")).alias(c) for c in rest]
    return merged.select(*keys, *out, *(["created_at", "updated_at"] if stamp else []))


def with_both_ends(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose two ends are nodes, of the same tenant if ``by`` names its column."""
    ids = nodes.select(*by, F.col(key).alias("_id")).distinct()
    for end in (src, dst):
        held = ids.withColumnRenamed("_id", end)
        edges = edges.join(held, [*by, end], "left_semi")
    return edges


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst", by: tuple[str, ...] = ()) -> DataFrame:
    """Undirected steps; rows without either end lead nowhere."""
    there = edges.select(*by, F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    return there.union(there.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def khop(edges: DataFrame, origins: DataFrame, hops: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, origin, id)``: every node within ``hops`` undirected steps inside the tenant, the origin included.

    Each hop expands only the nodes that the hop before has found, from files, so
    the plan grows by one join a hop.
    """
    near = both_ways(edges, by=by)
    near = cut(near) if hops > 1 else near
    reached = fresh = origins.select(*by, F.col("id").alias("origin"), F.col("id")).distinct()
    for hop in range(hops):
        step = fresh.withColumnRenamed("id", "src").join(near, [*by, "src"]).select(*by, "origin", F.col("dst").alias("id")).distinct()
        fresh = step.join(reached, [*by, "origin", "id"], "left_anti")
        if hop + 1 < hops:
            fresh = cut(fresh)
            reached = cut(reached.union(fresh))
        else:
            reached = reached.union(fresh)
    return reached


def isolated(nodes: DataFrame, edges: DataFrame, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    ends = edges.select(*by, F.col("src").alias(key)).union(edges.select(*by, F.col("dst").alias(key)))
    return nodes.join(ends, [*by, key], "left_anti")


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, id, component)``; with ``by``, ids of different tenants are different nodes."""
    if not by:
        return connected_components(edges, "src", "dst")
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct(*by, F.col(c).alias("id")))
    found = connected_components(edges.select(node("src").alias("src"), node("dst").alias("dst")), "src", "dst")
    return found.select(*[F.col(f"id.{c}").alias(c) for c in by], "id.id", F.col("component.id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Communities by the commonest label among a node's neighbours and itself; ties go to the least label."""
    near = cut(both_ways(edges, by=by))
    labels = near.select(*by, F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        told = near.join(labels.withColumnRenamed("id", "dst"), [*by, "dst"]).select(*by, F.col("src").alias("id"), "component").union(labels.select(*by, "id", "component"))
        votes = told.groupBy(*by, "id", "component").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy(*by, "id").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select(*by, "id", F.col("b.component").alias("component")))
    return labels


#: Community algorithms by name. There is no modularity service here, so other names fall back.
ALGORITHMS = {"components": components, "label_propagation": lambda edges, by=(): label_propagation(edges, by=by)}


def detect(edges: DataFrame, nodes: DataFrame, algorithm: str = "components", by: tuple[str, ...] = (), include_isolated: bool = False) -> DataFrame:
    """``(by, id, component, algorithm)``: communities of the whole graph.

    An unknown algorithm falls back to components, and ``algorithm`` says so.
    Without any edge every node is a community of its own; with edges, nodes
    without one are left out unless ``include_isolated``.
    """
    used = algorithm if algorithm in ALGORITHMS else "components"
    inside = with_both_ends(edges, nodes, by=by)
    found = ALGORITHMS[used](inside, by=by)
    if include_isolated or inside.isEmpty():
        alone = isolated(nodes.select(*by, "id"), inside, by=by)
        found = found.unionByName(alone.withColumn("component", F.col("id")))
    return found.withColumn("algorithm", F.lit(used))


def incremental_components(edges: DataFrame, origins: DataFrame, hops: int | None = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Components of the subgraph within ``hops`` of the origins; a lone origin is one.

    Without ``hops``, the origins' whole components.
    """
    loops = lambda rows: rows.select(*by, F.col("id").alias("src"), F.col("id").alias("dst"))
    if hops is None:
        whole = cut(components(edges.select(*by, "src", "dst").union(loops(origins)), by))
        mine = whole.join(origins.select(*by, "id"), [*by, "id"], "left_semi").select(*by, "component").distinct()
        return whole.join(mine, [*by, "component"], "left_semi").select(*by, "id", "component")
    scope = cut(khop(edges, origins, hops, by).select(*by, "id").distinct())
    inside = with_both_ends(edges, scope, by=by).select(*by, "src", "dst")
    return components(inside.union(loops(scope)), by)


def members(assignment: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    grouped = assignment.groupBy(*by, "component").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.select(*by, F.col("component").alias("community_id"), F.size("ids").cast("long").alias("entity_count"), F.array_join("ids", ",").alias("entity_ids"))


def template_summary(sizes: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Community "), F.col("community_id").cast("string"), F.lit(" contains "), exprs.counted(F.col("entity_count"), "entity", "entities"), F.lit("."))
    return sizes.withColumn("summary", text).withColumn("model_used", F.lit("template"))


def context(assignment: DataFrame, names: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Names of a community's members and its directed inner relations, each as one ordered text."""
    named = assignment.join(names, [*by, "id"])
    who = named.groupBy(*by, "component").agg(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(" ("), "kind", F.lit(")")))), ", ").alias("entities"))
    a = named.select(*by, F.col("id").alias("src"), F.col("component"), F.col("name").alias("na"))
    b = named.select(*by, F.col("id").alias("dst"), F.col("component"), F.col("name").alias("nb"))
    told = edges.join(a, [*by, "src"]).join(b, [*by, "dst", "component"])
    rels = told.groupBy(*by, "component").agg(F.array_join(F.sort_array(F.collect_list(F.concat("na", F.lit(" --["), "edge_type", F.lit("]--> "), "nb"))), ", ").alias("relations"))
    return who.join(rels, [*by, "component"], "left").select(*by, F.col("component").alias("community_id"), "entities", F.coalesce("relations", F.lit("none")).alias("relations"))


def annotate(nodes: DataFrame, assignment: DataFrame, summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with their community and its summary; nodes outside keep what they had."""
    told = assignment.withColumnRenamed("component", "community_id").join(summaries, [*by, "community_id"])
    told = told.select(*by, "id", F.col("community_id").alias("_c"), F.col("summary").alias("_s"))
    out = nodes.join(told, [*by, "id"], "left")
    have = set(nodes.columns)
    old = {c: F.col(c) if c in have else F.lit(None) for c in ("community_id", "community_summary")}
    return out.withColumns({"community_id": F.coalesce("_c", old["community_id"]), "community_summary": F.coalesce("_s", old["community_summary"])}).drop("_c", "_s")


def search_summaries(summaries: DataFrame, query: str, top: int = 10, text: str = "community_summary") -> DataFrame:
    """The ``top`` communities by how many words of the query their summary has, then by id."""
    wanted = sorted({w for w in query.lower().split() if w})
    words = F.split(F.lower(F.regexp_replace(text, "[^0-9A-Za-z]+", " ")), " ")
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0)
    return summaries.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "community_id").limit(top)


def quotient(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges between communities with their numbers: the graph seen from afar."""
    a = assignment.select(F.col("id").alias("src"), F.col("component").alias("src_community"))
    b = assignment.select(F.col("id").alias("dst"), F.col("component").alias("dst_community"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_community", "dst_community").agg(F.count(F.lit(1)).alias("n_edges"))
