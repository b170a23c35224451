"""The relationship graph: edges, neighbourhoods, trees and links between concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagging import shared_table

#: The families of declared relationships and the edge types that they become. Fixed values.
FAMILIES = {"summation_trees": "SUMMATION", "disaggregations": "DISAGGREGATION", "cross_statement_ties": "CROSS_STATEMENT_TIE", "intercompany": "IC_DECOMPOSITION", "note_ties": "NOTE_TO_FACE", "ratios": "DIVISION"}


def edge_dim(relations: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge_name, edge_type, context, concept_id, other_context) and their members (edge_name, role, ord, concept_id).
    relations: family, edge_name, context, concept_id, other_context, expression: one concept, "SUM(a, b)" or a list "a, b" in order. Targets (concept_id, context, detail)
    become edges where no disaggregation covers the concept and its detail context yet."""
    kind = F.lit(None).cast("string")
    for family, name in FAMILIES.items():
        kind = F.when(F.col("family") == family, name).otherwise(kind)
    r = relations.withColumn("edge_type", kind).where("edge_type is not null")
    edges = r.select("edge_name", "edge_type", "context", "concept_id", "other_context")
    covered = edges.where("edge_type = 'DISAGGREGATION'").select("concept_id", F.col("other_context").alias("detail"))
    more = targets.join(covered, ["concept_id", "detail"], "left_anti")
    edges = edges.unionByName(more.select(F.concat_ws("_", "concept_id", "detail").alias("edge_name"), F.lit("DISAGGREGATION").alias("edge_type"), "context", "concept_id", F.col("detail").alias("other_context")))
    inner = F.coalesce(F.nullif(F.regexp_extract("expression", r"^\s*SUM\((.*)\)\s*$", 1), F.lit("")), F.col("expression"))
    parts = r.select("edge_name", F.posexplode(F.split(inner, ",")).alias("ord", "concept_id")).select("edge_name", F.lit("member").alias("role"), (F.col("ord") + 1).alias("ord"), F.trim("concept_id").alias("concept_id"))
    head = edges.select("edge_name", F.lit("head").alias("role"), F.lit(0).alias("ord"), "concept_id")
    return edges, head.unionByName(parts.where("concept_id <> ''"))


def neighborhood(members: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """C14: concepts that share an edge with the start, up to `depth` hops (three at most); each with its first hop. A hop goes from the frontier to the edges
    that it touches for the first time, and from them to their members: its cost follows the frontier, and no pair of members is made. Both sets are written each hop."""
    m = members.select("edge_name", "concept_id").distinct()
    last = shared_table(m.where(F.col("concept_id") == start).select("concept_id").distinct(), "hop")
    seen, used = last.withColumn("hop", F.lit(0)), None
    for k in range(1, min(depth, 3) + 1):
        touched = m.join(last, "concept_id", "left_semi").select("edge_name").distinct()
        touched = shared_table(touched if used is None else touched.join(used, "edge_name", "left_anti"), "hop-edges")
        used = touched if used is None else used.unionByName(touched)
        last = shared_table(m.join(touched, "edge_name", "left_semi").select("concept_id").distinct().join(seen.select("concept_id"), "concept_id", "left_anti"), "hop")
        seen = seen.unionByName(last.withColumn("hop", F.lit(k)))
    return seen


def context_forest(concepts: DataFrame, tree: DataFrame, members: DataFrame) -> DataFrame:
    """The concepts of every context as trees of its sums: context, concept_id, depth, path, n_edges (of any type). Roots are concepts that no
    sum of their context has as a part; trees go to any depth, level by level, each written; a concept on its own path ends there, and what only cycles reach has no root.
    concepts: context, concept_id; tree: concept_id, member; members: edge_name, concept_id."""
    own = concepts.select("context", "concept_id").distinct()
    arcs = tree.select("concept_id", "member").distinct().join(own, "concept_id").join(own.withColumnRenamed("concept_id", "member"), ["context", "member"])
    arcs = shared_table(arcs.select("context", "concept_id", "member"), "arcs")
    roots = own.join(arcs.select("context", F.col("member").alias("concept_id")).distinct(), ["context", "concept_id"], "left_anti")
    level = shared_table(roots.select("context", "concept_id", F.lit(0).alias("depth"), F.array("concept_id").alias("path")), "level")
    found = level
    while True:
        below = level.join(arcs, ["context", "concept_id"]).where(~F.array_contains("path", F.col("member")))
        level = shared_table(below.select("context", F.col("member").alias("concept_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("member")).alias("path")), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    edges = members.groupBy("concept_id").agg(F.count_distinct("edge_name").alias("n_edges"))
    return found.join(edges, "concept_id", "left").select("context", "concept_id", "depth", F.array_join("path", "/").alias("path"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def edge_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """C17: pairs of concepts that an edge of a type links, each once."""
    all_ = members.select("edge_name", "concept_id").unionByName(edges.select("edge_name", "concept_id")).distinct().join(edges.select("edge_name", "edge_type"), "edge_name")
    a, b = all_.withColumnRenamed("concept_id", "c1"), all_.select("edge_name", F.col("concept_id").alias("c2"))
    return a.join(b, "edge_name").where("c1 < c2").select("edge_type", "c1", "c2").distinct()


def ontology_stats(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges and members by type."""
    m = members.groupBy("edge_name").agg(F.count(F.lit(1)).alias("n_members"))
    return edges.join(m, "edge_name", "left").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.coalesce("n_members", F.lit(0))).alias("n_members"), F.count_distinct("concept_id").alias("n_concepts"))


def context_overview(edges: DataFrame) -> DataFrame:
    """C17: how many edges of each type link two contexts, in either direction. edges: edge_type, context, other_context."""
    e = edges.where("context <> other_context").select("edge_type", F.least("context", "other_context").alias("c1"), F.greatest("context", "other_context").alias("c2"))
    return e.groupBy("edge_type", "c1", "c2").agg(F.count(F.lit(1)).alias("n_edges"))


#: C17: primary contexts in the order in which a disclosure prefers them. Fixed values.
PREFERENCE = ("SFP", "PNL", "CFS", "OCI", "SOCIE")


def disclosure_parent(edges: DataFrame) -> DataFrame:
    """C17: the primary statement of each disclosure context: the most preferred one that an edge links it with."""
    both = edges.select("context", "other_context").unionByName(edges.select(F.col("other_context").alias("context"), F.col("context").alias("other_context")))
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("other_context"))
    links = both.where(F.col("context").startswith("DISC.") & (rank > 0))
    return links.groupBy("context").agg(F.min_by("other_context", rank).alias("parent"), F.count(F.lit(1)).alias("n_edges"))


def context_counts(concepts: DataFrame) -> DataFrame:
    """Concepts of each context. concepts: concept_id, context."""
    return concepts.groupBy("context").agg(F.count_distinct("concept_id").alias("n_concepts"))


def concept_detail(members: DataFrame) -> DataFrame:
    """Each concept's edges and the other members of them."""
    m = members.select("edge_name", "concept_id").distinct()
    others = m.join(m.select("edge_name", F.col("concept_id").alias("other")), "edge_name").where("concept_id <> other").groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))
    return m.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_edges")).join(others, "concept_id", "left").fillna("", ["others"])
