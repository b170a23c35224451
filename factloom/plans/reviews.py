"""Queries on tagging, the graph, and review work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import reviews as V
from ..operators import tagging as A
from .dealt import by_table, small
from .registry import query
from .timelines import RSEC, report_sections

TREE = [("TOTAL", "LARGE", 1, True, True), ("TOTAL", "MEDIUM", 2, True, True), ("TOTAL", "SMALL", 3, True, True), ("MEDIUM", "PROMO", 1, False, False), ("MEDIUM", "ECONOMY", 2, False, False)]
TREE_SQL = f"tree AS (SELECT * FROM (VALUES {', '.join(str(x) for x in TREE)}) v(concept_id, member, ord, partial, ordered))"
IX = "ix AS (SELECT lower(p_name) AS norm, min(p_type) AS concept_id FROM part GROUP BY 1)"


def tree(t):
    return t.spark.createDataFrame(TREE, "concept_id string, member string, ord int, partial boolean, ordered boolean")


def index(t):
    return t.part.groupBy(F.lower("p_name").alias("norm")).agg(F.min("p_type").alias("concept_id"))


LABEL_MATCH = f"""{IX}, lm AS (SELECT r.doc_id, r.table_id, r.row_id, ix.concept_id, 0.8::DOUBLE AS confidence, 'label' AS rule FROM r_rows r JOIN r_tables t USING (table_id) JOIN ix ON ix.norm = lower(trim(r.label)) WHERE r.tag IS NULL AND t.context IS NOT NULL)"""


@query("i1_tag_label_match", f"WITH {LABEL_MATCH} SELECT * FROM lm")
def tag_label_match(t):
    return A.tag_label_match(t.r_rows, t.r_tables, index(t))


SUMS = """k AS (SELECT * FROM r_rows WHERE parent_id IS NOT NULL),
cs AS (SELECT k.parent_id, c.col_idx, any_value(v.value) AS v, sum(c.value) AS s, count(c.value) AS n, count(*) AS k FROM k JOIN r_cells c ON c.row_id = k.row_id AND c.table_id = k.table_id JOIN r_cells v ON v.row_id = k.parent_id AND v.col_idx = c.col_idx WHERE v.value IS NOT NULL GROUP BY 1, 2),
fits AS (SELECT parent_id FROM cs WHERE n = k GROUP BY 1 HAVING bool_and(abs(s - v) <= 1000))"""


TOP_DOWN = f"""
WITH {TREE_SQL}, {SUMS}, mem AS (SELECT concept_id, list(member ORDER BY ord) AS members, bool_or(partial) AS partial, bool_or(ordered) AS ordered FROM tree GROUP BY 1),
h AS (SELECT doc_id, table_id, parent_id, list(DISTINCT tag) FILTER (tag IS NOT NULL) AS have, list(row_id ORDER BY row_idx) AS al, coalesce(list(row_id ORDER BY row_idx) FILTER (tag IS NULL), []) AS open FROM k GROUP BY 1, 2, 3),
p AS (SELECT h.*, mem.*, list_filter(members, lambda m: NOT list_contains(coalesce(have, []), m)) AS missing FROM h JOIN r_rows r ON r.row_id = h.parent_id JOIN mem ON mem.concept_id = r.tag),
q AS (SELECT *, len(open) > len(missing) AS more, parent_id IN (SELECT parent_id FROM fits) AS fits FROM p WHERE len(missing) > 0 AND len(open) BETWEEN 1 AND 5 AND len(open) - len(missing) BETWEEN 0 AND 1),
lo AS (SELECT parent_id, arg_max(row_id, row_idx) AS left_out FROM (SELECT k.parent_id, k.row_id, k.row_idx FROM k JOIN r_cells c ON c.row_id = k.row_id JOIN cs ON cs.parent_id = k.parent_id AND cs.col_idx = c.col_idx
  WHERE k.tag IS NULL AND cs.n = cs.k - (c.value IS NULL)::INT GROUP BY 1, 2, 3 HAVING bool_and(abs(cs.s - coalesce(c.value, 0) - cs.v) <= 1000)) GROUP BY 1),
va AS (SELECT k.parent_id, list(DISTINCT k.row_id) AS valued FROM k JOIN r_cells c ON c.row_id = k.row_id WHERE k.tag IS NULL AND c.value IS NOT NULL GROUP BY 1),
z AS (SELECT q.*, CASE WHEN NOT more AND (len(missing) = 1 OR (ordered AND fits)) THEN open
    WHEN more AND partial AND len(missing) = 1 THEN [CASE WHEN ordered AND list_position(members, missing[1]) <= len(open) THEN open[list_position(members, missing[1])] WHEN len(valued) = 1 THEN valued[1] END]
    WHEN more AND partial AND ordered AND left_out IS NOT NULL THEN list_filter(open, lambda x: x <> left_out) END AS chosen FROM q LEFT JOIN lo USING (parent_id) LEFT JOIN va USING (parent_id)),
o AS (SELECT *, unnest(chosen) AS row_id, unnest(missing) AS concept FROM z WHERE chosen IS NOT NULL)
SELECT doc_id, table_id, row_id, concept AS concept_id, round(CASE WHEN more THEN CASE WHEN len(missing) = 1 THEN 0.75 ELSE 0.65 END ELSE CASE WHEN len(missing) = 1 THEN 0.85 ELSE 0.75 END END
  + CASE WHEN NOT more AND ordered AND list_position(al, row_id) = list_position(members, concept) THEN 0.05 ELSE 0 END, 2)::DOUBLE AS confidence, 'top_down' AS rule FROM o WHERE row_id IS NOT NULL"""


@query("i2_tag_top_down", TOP_DOWN)
def tag_top_down(t):
    keep = by_table(t, "r_tables", "r_rows")
    return keep(A.tag_top_down(t.r_rows, t.r_cells, small(tree(t), "tree")), "top-down")


BOTTOM_UP = f"""
WITH {TREE_SQL}, {SUMS}, h AS (SELECT doc_id, table_id, parent_id, list_sort(list(DISTINCT tag) FILTER (tag IS NOT NULL)) AS have FROM k GROUP BY 1, 2, 3 HAVING count(*) FILTER (tag IS NULL) = 0),
m AS (SELECT concept_id, list_sort(list(DISTINCT member)) AS members, bool_or(partial) AS partial FROM tree GROUP BY 1),
c AS (SELECT h.doc_id, h.table_id, h.parent_id, m.concept_id, len(have) = len(members) AS exact, h.parent_id IN (SELECT row_id FROM r_cells WHERE value IS NOT NULL) AS valued, h.parent_id IN (SELECT parent_id FROM fits) AS adds
  FROM h JOIN r_rows p ON p.row_id = h.parent_id AND p.tag IS NULL JOIN m ON list_has_all(m.members, h.have) WHERE len(have) = len(members) OR partial),
g AS (SELECT *, (CASE WHEN exact THEN CASE WHEN NOT valued THEN 0.9 WHEN adds THEN 0.95 ELSE 0.7 END WHEN valued AND adds THEN 0.75 ELSE 0.7 END)::DOUBLE AS confidence FROM c)
SELECT doc_id, table_id, parent_id AS row_id, concept_id, confidence, 'bottom_up' AS rule FROM g QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY confidence DESC, exact DESC, concept_id DESC) = 1"""


@query("i3_tag_bottom_up", BOTTOM_UP)
def tag_bottom_up(t):
    keep = by_table(t, "r_tables", "r_rows")
    return keep(A.tag_bottom_up(t.r_rows, t.r_cells, small(tree(t), "tree")), "bottom-up")


FACE = "SELECT t.doc_id, r.tag AS concept_id, c.col_idx, arg_min(c.value, c.row_id) AS amount FROM r_rows r JOIN r_tables t USING (table_id) JOIN r_cells c ON c.row_id = r.row_id WHERE t.context = 'PNL' AND r.tag IS NOT NULL AND c.value IS NOT NULL GROUP BY 1, 2, 3"


@query("i4_tag_cross_table", f"""
WITH face AS ({FACE}), j AS (SELECT r.doc_id, r.table_id, r.row_id, f.concept_id, bool_and(abs(c.value - f.amount) <= 1000) AS ok FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id JOIN face f ON f.doc_id = r.doc_id AND f.col_idx = c.col_idx
  WHERE r.tag IS NULL AND r.row_type = 'TOTAL_EXPLICIT' AND c.value IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT doc_id, table_id, row_id, min(concept_id) AS concept_id, 0.7::DOUBLE AS confidence, 'cross_table' AS rule FROM j WHERE ok GROUP BY 1, 2, 3""")
def tag_cross_table(t):
    return A.tag_cross_table(t.r_rows, t.r_cells, face_amounts(t))


def face_amounts(t):
    face = t.r_rows.where("tag is not null").join(t.r_tables.where("context = 'PNL'").select("table_id"), "table_id").join(t.r_cells.where("value is not null").select("row_id", "col_idx", "value"), "row_id")
    return face.groupBy("doc_id", F.col("tag").alias("concept_id"), "col_idx").agg(F.min_by("value", "row_id").alias("amount"))


@query("i6_cascade")
def cascade(t):
    ties = t.r_edges.where("edge_type = 'NOTE_TO_FACE'").select(F.col("concept_id").alias("face_concept"), F.col("concept_id").alias("note_concept"), F.col("other_context").alias("context"))
    rules = t.spark.createDataFrame([("RATIO", "LARGE", "SMALL")], "result string, numerator string, denominator string")
    keep = by_table(t, "r_tables", "r_rows")
    few = small(index(t), "index"), small(tree(t), "tree")
    return A.cascade(t.r_rows, t.r_cells, t.r_tables, *few, ties=ties, rules=small(rules, "rules"), keep=lambda df, name: keep(df, name, again=True))


@query("e12_best_tag_per_row", f"""
WITH {LABEL_MATCH}, c AS (SELECT * FROM lm UNION ALL SELECT doc_id, table_id, row_id, 'X.' || concept_id, 0.8, 'ratio' FROM lm WHERE row_id % 3 = 0 UNION ALL SELECT doc_id, table_id, row_id, 'Y', 0.9, 'ratio' FROM lm WHERE row_id % 5 = 0)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY confidence DESC, CASE rule WHEN 'label' THEN 1 ELSE 5 END, length(concept_id), concept_id DESC) = 1""")
def best_tag_per_row(t):
    lm = A.tag_label_match(t.r_rows, t.r_tables, index(t))
    x = lm.where("row_id % 3 = 0").withColumns({"concept_id": F.concat(F.lit("X."), F.col("concept_id")), "rule": F.lit("ratio")})
    y = lm.where("row_id % 5 = 0").withColumns({"concept_id": F.lit("Y"), "confidence": F.lit(0.9), "rule": F.lit("ratio")})
    return A.best_tag_per_row(lm.unionByName(x).unionByName(y))


@query("i9_apply_overrides", """
WITH r AS (SELECT doc_id, page_no, min(ctx) AS ctx FROM (SELECT doc_id, unnest([10, 11, 12]) AS page_no, 'CFS' AS ctx FROM r_documents WHERE doc_id % 2 = 0) GROUP BY 1, 2),
f AS (SELECT table_id, arg_min(lower(label), row_idx) AS l FROM r_rows WHERE row_idx > 0 GROUP BY 1), b AS (SELECT table_id, CASE WHEN regexp_matches(l, '^hot.*rod') THEN 'OCI' WHEN regexp_matches(l, 'plate$') THEN 'SOCIE' END AS pat FROM f)
SELECT t.doc_id, t.table_id, CASE WHEN table_id % 6 = 0 THEN context ELSE coalesce(CASE WHEN table_id % 5 = 0 THEN 'SOCIE' END, pat, r.ctx, context) END AS context, context AS previous,
  CASE WHEN table_id % 6 = 0 THEN 'confirmed' WHEN table_id % 5 = 0 THEN 'table' WHEN pat IS NOT NULL THEN 'pattern' WHEN r.ctx IS NOT NULL THEN 'range' ELSE 'automatic' END AS method FROM r_tables t LEFT JOIN b USING (table_id) LEFT JOIN r ON r.doc_id = t.doc_id AND r.page_no = t.page_no""")
def apply_overrides(t):
    ranges = t.r_documents.where("doc_id % 2 = 0").select("doc_id", F.lit(10).alias("start_page"), F.lit(12).alias("end_page"), F.lit("CFS").alias("context"))
    first = t.r_rows.where("row_idx > 0").groupBy("table_id").agg(F.min_by("label", "row_idx").alias("label"))
    return A.apply_overrides(t.r_tables, t.r_tables.where("table_id % 6 = 0"), t.r_tables.where("table_id % 5 = 0").select("table_id", F.lit("SOCIE").alias("context")), ranges, first, [("^hot.*rod", "OCI"), ("plate$", "SOCIE")])


@query("i11_tagging_worklist", """
WITH v AS (SELECT DISTINCT row_id FROM r_cells WHERE value IS NOT NULL), r AS (SELECT r.*, CASE WHEN row_id % 6 = 0 THEN 'DISC.PPE' END AS hint FROM r_rows r WHERE tag IS NULL AND row_type = 'DATA' AND row_id IN (SELECT row_id FROM v)),
o AS (SELECT doc_id, table_id, count(*) AS n_open, string_agg(label || coalesce(' @' || hint, ''), '|' ORDER BY row_idx) AS labels FROM r GROUP BY 1, 2),
c AS (SELECT t.table_id, string_agg(k.concept_id, ',' ORDER BY k.concept_id) AS candidates FROM r_tables t JOIN r_concepts k ON k.valid_context = t.context GROUP BY 1),
j AS (SELECT o.*, t.context, c.candidates, n_open < 3 AS is_small, row_number() OVER (PARTITION BY o.doc_id, n_open < 3 ORDER BY table_id) AS n FROM o JOIN r_tables t USING (table_id) LEFT JOIN c USING (table_id) WHERE t.context IS NOT NULL)
SELECT doc_id, table_id, n_open, labels, context, candidates, is_small, (CASE WHEN is_small THEN floor((n - 1) / 3) ELSE n - 1 END)::INT AS batch FROM j""")
def tagging_worklist(t):
    from ..operators.labels import candidate_concepts

    notes = t.r_rows.where("row_id % 6 = 0").select("row_id", F.lit("DISC.PPE").alias("context"))
    return A.tagging_worklist(t.r_rows, t.r_cells, t.r_tables, candidate_concepts(t.r_tables, t.r_concepts, t.r_documents), notes, small=3)


@query("i12_emit_votes", f"WITH {LABEL_MATCH} SELECT 'row_concept' AS dimension, row_id AS target_id, concept_id AS value, 'rule' AS source, confidence FROM lm")
def emit_votes(t):
    return A.emit_tag_events(A.tag_label_match(t.r_rows, t.r_tables, index(t)), "rule")[1]


RELATIONS = """rel AS (SELECT CASE p_size % 7 WHEN 0 THEN 'summation_trees' WHEN 1 THEN 'disaggregations' WHEN 2 THEN 'cross_statement_ties' WHEN 3 THEN 'intercompany' WHEN 4 THEN 'note_ties' WHEN 5 THEN 'ratios' ELSE 'comments' END AS family, p_brand || '_' || p_size AS edge_name, 'PNL' AS context,
  min(p_type) AS concept_id, CASE WHEN p_size % 2 = 0 THEN 'DISC.SEGMENTS' ELSE 'DISC.PPE' END AS other_context, CASE WHEN p_size % 3 = 0 THEN 'SUM(' || string_agg(DISTINCT p_name, ', ' ORDER BY p_name) || ')' WHEN p_size % 3 = 1 THEN string_agg(DISTINCT p_name, ', ' ORDER BY p_name) ELSE min(p_name) END AS expression FROM part GROUP BY p_brand, p_size),
ft(family, edge_type) AS (VALUES ('summation_trees', 'SUMMATION'), ('disaggregations', 'DISAGGREGATION'), ('cross_statement_ties', 'CROSS_STATEMENT_TIE'), ('intercompany', 'IC_DECOMPOSITION'), ('note_ties', 'NOTE_TO_FACE'), ('ratios', 'DIVISION')),
tg AS (SELECT DISTINCT p_type AS concept_id, 'PNL' AS context, 'DISC.' || CASE WHEN p_size % 2 = 0 THEN 'SEGMENTS' ELSE 'TAX' END AS detail FROM part),
ed AS (SELECT edge_name, edge_type, context, concept_id, other_context FROM rel JOIN ft USING (family) UNION ALL SELECT concept_id || '_' || detail, 'DISAGGREGATION', context, concept_id, detail FROM tg
  WHERE NOT EXISTS (SELECT 1 FROM rel WHERE family = 'disaggregations' AND rel.concept_id = tg.concept_id AND rel.other_context = tg.detail))"""


def edges_and_members(t):
    k = F.col("p_size") % 7
    family = F.when(k == 0, "summation_trees").when(k == 1, "disaggregations").when(k == 2, "cross_statement_ties").when(k == 3, "intercompany").when(k == 4, "note_ties").when(k == 5, "ratios").otherwise("comments")
    names = F.array_join(F.array_sort(F.collect_set("p_name")), ", ")
    third = F.col("p_size") % 3
    expression = F.when(third == 0, F.concat(F.lit("SUM("), names, F.lit(")"))).when(third == 1, names).otherwise(F.min("p_name"))
    rel = t.part.groupBy("p_brand", "p_size").agg(F.min("p_type").alias("concept_id"), expression.alias("expression")).select(
        family.alias("family"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("edge_name"), F.lit("PNL").alias("context"), "concept_id", F.when(F.col("p_size") % 2 == 0, "DISC.SEGMENTS").otherwise("DISC.PPE").alias("other_context"), "expression"
    )
    targets = t.part.select(F.col("p_type").alias("concept_id"), F.lit("PNL").alias("context"), F.concat(F.lit("DISC."), F.when(F.col("p_size") % 2 == 0, "SEGMENTS").otherwise("TAX")).alias("detail")).distinct()
    return G.edge_dim(rel, targets)


@query("a6_edge_dim", f"WITH {RELATIONS} SELECT * FROM ed")
def edge_dim(t):
    return edges_and_members(t)[0]


@query("a6_edge_members", f"""
WITH {RELATIONS}, m AS (SELECT edge_name, string_split(coalesce(nullif(regexp_extract(expression, '^\\s*SUM\\((.*)\\)\\s*$', 1), ''), expression), ',') AS parts FROM rel WHERE family IN (SELECT family FROM ft))
SELECT edge_name, 'head' AS role, 0 AS ord, concept_id FROM ed UNION ALL SELECT edge_name, 'member', i::INT, trim(c) FROM (SELECT edge_name, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM m)""")
def edge_members(t):
    return edges_and_members(t)[1]


NEXT = "nx AS (SELECT unit AS edge_type, context, lead(context) OVER (PARTITION BY doc_id ORDER BY table_ord) AS other_context FROM r_tables), ne AS (SELECT coalesce(edge_type, 'EUR') AS edge_type, context, other_context FROM nx WHERE context IS NOT NULL AND other_context IS NOT NULL)"


def next_contexts(t):
    from pyspark.sql.window import Window

    after = F.lead("context").over(Window.partitionBy("doc_id").orderBy("table_ord"))
    return t.r_tables.select(F.coalesce("unit", F.lit("EUR")).alias("edge_type"), "context", after.alias("other_context")).where("context is not null and other_context is not null")


@query("c17_context_overview", f"WITH {NEXT} SELECT edge_type, least(context, other_context) AS c1, greatest(context, other_context) AS c2, count(*) AS n_edges FROM ne WHERE context <> other_context GROUP BY 1, 2, 3")
def context_overview(t):
    return G.context_overview(next_contexts(t))


@query("c17_disclosure_parent", f"""
WITH {NEXT}, b AS (SELECT context, other_context FROM ne UNION ALL SELECT other_context, context FROM ne), l AS (SELECT *, list_position(['SFP', 'PNL', 'CFS', 'OCI', 'SOCIE'], other_context) AS k FROM b WHERE context LIKE 'DISC.%')
SELECT context, arg_min(other_context, k) AS parent, count(*) AS n_edges FROM l WHERE k > 0 GROUP BY 1""")
def disclosure_parent(t):
    return G.disclosure_parent(next_contexts(t))


@query("d38_contexts", "SELECT valid_context AS context, count(DISTINCT concept_id) AS n_concepts FROM r_concepts GROUP BY 1")
def context_counts(t):
    return G.context_counts(t.r_concepts.select("concept_id", F.col("valid_context").alias("context")))


MEM = "mem AS (SELECT DISTINCT p_brand AS edge_name, p_type AS concept_id FROM part UNION SELECT DISTINCT 'n' || p_size, p_brand FROM part)"


def brand_members(t):
    a = t.part.select(F.col("p_brand").alias("edge_name"), F.col("p_type").alias("concept_id"))
    b = t.part.select(F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("edge_name"), F.col("p_brand").alias("concept_id"))
    return a.unionByName(b).distinct()


@query("c14_neighborhood", f"""
WITH {MEM}, pr AS (SELECT DISTINCT a.concept_id, b.concept_id AS nx FROM mem a JOIN mem b USING (edge_name)), h0 AS (SELECT DISTINCT concept_id, 0 AS hop FROM mem WHERE concept_id = 'Brand#4'),
h1 AS (SELECT DISTINCT nx AS concept_id, 1 AS hop FROM pr JOIN h0 USING (concept_id) WHERE nx NOT IN (SELECT concept_id FROM h0)),
h2 AS (SELECT DISTINCT nx AS concept_id, 2 AS hop FROM pr JOIN h1 USING (concept_id) WHERE nx NOT IN (SELECT concept_id FROM h0 UNION SELECT concept_id FROM h1))
SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def neighborhood(t):
    return G.neighborhood(brand_members(t), "Brand#4", 2)


FOREST = """cn AS (SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'PNL' ELSE 'SFP' END AS context, n_name AS concept_id FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'PNL' ELSE 'SFP' END, r_name FROM region
  UNION SELECT context, 'WORLD' FROM (VALUES ('PNL'), ('SFP')) v(context) UNION SELECT DISTINCT 'PNL', concept_id FROM mem UNION SELECT DISTINCT 'OCI', concept_id FROM mem WHERE concept_id LIKE 'Brand%'),
tr AS (SELECT DISTINCT r_name AS concept_id, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'WORLD', r_name FROM region UNION SELECT edge_name, concept_id FROM mem UNION SELECT 'Brand#' || (i + 1), 'Brand#' || i FROM (VALUES (1), (2), (3), (4)) v(i))"""


@query("c15_context_tree", f"""
WITH RECURSIVE {MEM}, {FOREST}, ar AS (SELECT DISTINCT a.context, t.concept_id, t.member FROM tr t JOIN cn a ON a.concept_id = t.concept_id JOIN cn b ON b.concept_id = t.member AND b.context = a.context),
w(context, concept_id, depth, path) AS (SELECT context, concept_id, 0, [concept_id] FROM cn WHERE (context, concept_id) NOT IN (SELECT (context, member) FROM ar)
  UNION ALL SELECT w.context, ar.member, depth + 1, list_append(path, ar.member) FROM w JOIN ar ON ar.context = w.context AND ar.concept_id = w.concept_id WHERE NOT list_contains(path, ar.member))
SELECT w.context, w.concept_id, depth, array_to_string(path, '/') AS path, coalesce(n, 0)::BIGINT AS n_edges FROM w LEFT JOIN (SELECT concept_id, count(DISTINCT edge_name) AS n FROM mem GROUP BY 1) e ON e.concept_id = w.concept_id""")
def context_tree(t):
    m = brand_members(t)
    statement = F.when(F.col("r_regionkey") % 2 == 0, "PNL").otherwise("SFP").alias("context")
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    brands = m.where("concept_id like 'Brand%'").select(F.lit("OCI").alias("context"), "concept_id")
    concepts = both.select(statement, F.col("n_name").alias("concept_id")).unionByName(t.region.select(statement, F.col("r_name").alias("concept_id")))
    concepts = concepts.unionByName(t.spark.createDataFrame([("PNL", "WORLD"), ("SFP", "WORLD")], "context string, concept_id string")).unionByName(m.select(F.lit("PNL").alias("context"), "concept_id")).unionByName(brands)
    tree = both.select(F.col("r_name").alias("concept_id"), F.col("n_name").alias("member")).unionByName(t.region.select(F.lit("WORLD").alias("concept_id"), F.col("r_name").alias("member")))
    tree = tree.unionByName(m.select(F.col("edge_name").alias("concept_id"), F.col("concept_id").alias("member"))).unionByName(t.spark.createDataFrame([(f"Brand#{i + 1}", f"Brand#{i}") for i in range(1, 5)], "concept_id string, member string"))
    return G.context_forest(concepts, tree, m)


@query("c17_edge_links", f"""
WITH {MEM}, ed AS (SELECT DISTINCT edge_name, CASE WHEN edge_name LIKE 'n%' THEN 'SIZE' ELSE 'BRAND' END AS edge_type, 'ROOT' AS concept_id FROM mem), al AS (SELECT DISTINCT * FROM (SELECT edge_name, concept_id FROM mem UNION ALL SELECT edge_name, concept_id FROM ed))
SELECT DISTINCT edge_type, a.concept_id AS c1, b.concept_id AS c2 FROM al a JOIN al b USING (edge_name) JOIN ed USING (edge_name) WHERE a.concept_id < b.concept_id""")
def edge_links(t):
    m = brand_members(t)
    return G.edge_links(m.select("edge_name", F.when(F.col("edge_name").startswith("n"), "SIZE").otherwise("BRAND").alias("edge_type"), F.lit("ROOT").alias("concept_id")).distinct(), m)


@query("d38_ontology_stats", f"""
WITH {MEM}, ed AS (SELECT DISTINCT edge_name, CASE WHEN edge_name LIKE 'n%' THEN 'SIZE' ELSE 'BRAND' END AS edge_type, 'ROOT' AS concept_id FROM mem)
SELECT edge_type, count(*) AS n_edges, sum(n)::BIGINT AS n_members, count(DISTINCT concept_id) AS n_concepts FROM ed JOIN (SELECT edge_name, count(*) AS n FROM mem GROUP BY 1) USING (edge_name) GROUP BY 1""")
def ontology_stats(t):
    m = brand_members(t)
    return G.ontology_stats(m.select("edge_name", F.when(F.col("edge_name").startswith("n"), "SIZE").otherwise("BRAND").alias("edge_type"), F.lit("ROOT").alias("concept_id")).distinct(), m)


@query("d38_concept_detail", f"""
WITH {MEM} SELECT a.concept_id, count(DISTINCT a.edge_name) AS n_edges, coalesce(string_agg(DISTINCT b.concept_id, ',' ORDER BY b.concept_id), '') AS others FROM mem a LEFT JOIN mem b ON b.edge_name = a.edge_name AND b.concept_id <> a.concept_id GROUP BY 1""")
def concept_detail(t):
    return G.concept_detail(brand_members(t))


@query("c11_concept_occurrences", "SELECT r.doc_id, r.table_id, r.row_id, r.label, t.page_no, t.context, d.entity FROM r_rows r JOIN r_tables t USING (table_id) JOIN r_documents d ON d.doc_id = r.doc_id WHERE r.tag = 'PROMO'")
def concept_occurrences(t):
    return V.concept_occurrences(t.r_rows, t.r_tables, t.r_documents, "PROMO")


def assembled(t):
    return V.assemble_document(t.r_tables, t.r_rows, t.r_cells, t.r_documents.select("doc_id"))


@query("a2_shred_tables", "SELECT r.doc_id, r.table_id, r.row_idx, c.col_idx, c.value FROM r_rows r LEFT JOIN r_cells c ON c.row_id = r.row_id")
def shred_tables(t):
    return V.shred_tables(assembled(t))["cells"]


@query("c12_assemble_document", """
WITH c AS (SELECT r.table_id, r.row_idx, count(x.col_idx) AS n FROM r_rows r LEFT JOIN r_cells x ON x.row_id = r.row_id GROUP BY 1, 2), r AS (SELECT table_id, count(*) AS n_rows, sum(n)::BIGINT AS n_cells FROM c GROUP BY 1)
SELECT t.doc_id, count(*) AS n_tables, coalesce(sum(n_rows), 0)::BIGINT AS n_rows, coalesce(sum(n_cells), 0)::BIGINT AS n_cells, arg_min(t.table_id, table_ord) AS first_table FROM r_tables t LEFT JOIN r USING (table_id) GROUP BY 1""")
def assemble_document(t):
    total = lambda f: F.aggregate("tables", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return assembled(t).select(
        "doc_id", F.size("tables").cast("long").alias("n_tables"), total(lambda x: F.size(x["rows"])).alias("n_rows"),
        total(lambda x: F.aggregate(x["rows"], F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.size(r["cells"]), F.lit(0)))).alias("n_cells"), F.col("tables")[0]["table_id"].alias("first_table"),
    )


OVERRIDES = "SELECT event_id % 20000 AS table_id, event_type AS context FROM events"


def overrides(t):
    return t.events.select((F.col("event_id") % 20000).alias("table_id"), F.col("event_type").alias("context"))


@query("c13_stale_references", f"SELECT * FROM ({OVERRIDES}) WHERE table_id NOT IN (SELECT table_id FROM r_tables WHERE page_no < 20)")
def stale_references(t):
    return V.stale_references(overrides(t), t.r_tables.where("page_no < 20"))


@query("c13b_flag_has_override", "SELECT doc_id, doc_id IN (SELECT doc_id FROM r_tables WHERE table_id IN (SELECT event_id % 20000 FROM events WHERE event_id % 7 = 0)) AS has_override FROM r_documents")
def flag_has_override(t):
    return V.flag_has_override(t.r_documents, t.r_tables, t.events.where("event_id % 7 = 0").select((F.col("event_id") % 20000).alias("table_id")))


@query("d48_review_manifest", """
WITH f AS (SELECT table_id, array_to_string(list(label ORDER BY row_idx)[1:3], '|') AS first_labels, count(*) AS n_rows FROM r_rows GROUP BY 1), t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, context) AS n FROM r_tables),
g AS (SELECT *, CASE WHEN context IS NULL THEN 'unclassified' ELSE 'inflated' END AS reason FROM t WHERE context IS NULL OR n > 3)
SELECT doc_id, table_id, page_no, reason, n AS n_of_type, min(page_no) OVER (PARTITION BY doc_id) AS first_flagged, max(page_no) OVER (PARTITION BY doc_id) AS last_flagged, count(*) OVER (PARTITION BY doc_id) AS n_flagged,
       CASE WHEN reason = 'unclassified' THEN 'classify by section or labels' ELSE 'keep at most 3 of ' || context END AS suggestion, first_labels, n_rows FROM g LEFT JOIN f USING (table_id)""")
def review_manifest(t):
    return V.review_manifest(t.r_tables, t.r_rows, 3)


@query("e10_first_n_per_table", "SELECT table_id, array_to_string(list(label ORDER BY row_idx)[1:3], '|') AS first_labels, count(*) AS n_rows FROM r_rows GROUP BY 1")
def first_n_per_table(t):
    return V.first_n_per_table(t.r_rows)


@query("e10_first_headers", "SELECT table_id, array_to_string(list(header ORDER BY col_idx)[1:4], '|') AS headers FROM r_columns WHERE header IS NOT NULL GROUP BY 1")
def first_headers(t):
    return V.first_headers(t.r_columns, 4)


@query("d50_expected_findings", """
WITH f AS (SELECT DISTINCT context AS edge_name, concept_id, CASE WHEN amount < 50000000 THEN 'OK' ELSE 'ERROR' END AS severity FROM r_facts), e AS (SELECT * FROM (VALUES (1, 'PNL', 'PROMO'), (2, 'OCI', NULL), (3, 'CFS', NULL), (4, NULL, 'LARGE'), (5, 'PNL', 'NONE')) v(id, edge_name, concept_id))
SELECT e.edge_name, e.concept_id, CASE WHEN count(f.edge_name) > 0 THEN 'found' ELSE 'missing' END AS outcome FROM e LEFT JOIN f ON coalesce(e.edge_name, f.edge_name) = f.edge_name AND coalesce(e.concept_id, f.concept_id) = f.concept_id GROUP BY e.id, 1, 2
UNION ALL SELECT edge_name, concept_id, 'unexpected' FROM f WHERE severity = 'ERROR' AND NOT EXISTS (SELECT 1 FROM e WHERE coalesce(e.edge_name, f.edge_name) = f.edge_name AND coalesce(e.concept_id, f.concept_id) = f.concept_id)""")
def expected_findings(t):
    f = t.r_facts.select(F.col("context").alias("edge_name"), "concept_id", F.when(F.col("amount") < 50000000, "OK").otherwise("ERROR").alias("severity"))
    return V.expected_findings(f, t.spark.createDataFrame([("PNL", "PROMO"), ("OCI", None), ("CFS", None), (None, "LARGE"), ("PNL", "NONE")], "edge_name string, concept_id string"))


@query("d54_review_state", """
WITH r AS (SELECT doc_id, action AS element, CASE WHEN event_id % 40 = 0 THEN NULL ELSE page_no END AS page, ts FROM v_log)
SELECT doc_id, element, bool_or(page IS NULL) AS all_reviewed, CASE WHEN NOT bool_or(page IS NULL) THEN array_to_string(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), ',') END AS pages, max(ts) AS last_seen FROM r GROUP BY 1, 2""")
def review_state(t):
    return V.review_state(t.v_log.select("doc_id", F.col("action").alias("element"), F.when(F.col("event_id") % 40 != 0, F.col("page_no")).alias("page"), "ts"))


@query("d55_gap_proposal_state", """
WITH ev AS (SELECT user_id AS gap_id, CASE event_type WHEN 'view' THEN 'link' WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'accept' END AS action, ts, event_id FROM events WHERE user_id % 3 > 0 AND (event_type IN ('view', 'purchase') OR (event_type = 'signup' AND event_id % 50 = 0))),
l AS (SELECT gap_id, arg_max(action, (ts, event_id)) AS last_action, count(*) AS n, bool_or(action = 'accept') AS acc FROM ev GROUP BY 1)
SELECT g.gap_id, CASE WHEN acc THEN 'accepted' WHEN last_action IS NOT NULL THEN 'proposed' ELSE 'open' END AS state, last_action, coalesce(n, 0) AS n_events FROM (SELECT DISTINCT user_id AS gap_id FROM events) g LEFT JOIN l USING (gap_id)""")
def gap_proposal_state(t):
    kind = F.when(F.col("event_type") == "view", "link").when(F.col("event_type") == "purchase", "reject").when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), "accept")
    ev = t.events.where("user_id % 3 > 0").select(F.col("user_id").alias("gap_id"), kind.alias("action"), "ts", "event_id").where("action is not null")
    return V.gap_proposal_state(t.events.select(F.col("user_id").alias("gap_id")).distinct(), ev)


@query("d56_annotation_status", """
WITH s AS (SELECT user_id AS doc_id, count(*) AS n, bool_or(event_type = 'purchase' AND value > 20) AS ok, max(ts) FILTER (event_type = 'purchase' AND value > 20) AS done FROM events GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_sections, CASE WHEN n IS NULL THEN 'not_started' WHEN ok THEN 'complete' ELSE 'in_progress' END AS status, done AS completed_at FROM r_documents d LEFT JOIN s USING (doc_id)""")
def annotation_status(t):
    return V.annotation_status(t.r_documents, t.events.select(F.col("user_id").alias("doc_id"), ((F.col("event_type") == "purchase") & (F.col("value") > 20)).alias("validated"), "ts"))


@query("d55_proposals", """
WITH ev AS (SELECT event_id % 400 AS proposal_id, event_id % 40 AS gap_id, CASE event_type WHEN 'view' THEN 'link' WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'accept' END AS action, 'u' || user_id AS "user", ts, event_id FROM events WHERE event_type IN ('view', 'purchase', 'signup') AND event_id % 3 > 0),
d AS (SELECT proposal_id, gap_id, arg_max(action, (ts, event_id)) AS a, arg_max("user", (ts, event_id)) AS u, max(ts) AS done FROM ev WHERE action <> 'link' GROUP BY 1, 2)
SELECT proposal_id, gap_id, min(ts) AS linked_at, CASE any_value(a) WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS state, any_value(u) AS resolver, any_value(done) AS resolved_at FROM ev LEFT JOIN d USING (proposal_id, gap_id) GROUP BY 1, 2""")
def proposals(t):
    kind = F.when(F.col("event_type") == "view", "link").when(F.col("event_type") == "purchase", "reject").when(F.col("event_type") == "signup", "accept")
    ev = t.events.where("event_type in ('view', 'purchase', 'signup') and event_id % 3 > 0")
    return V.proposal_state(ev.select((F.col("event_id") % 400).alias("proposal_id"), (F.col("event_id") % 40).alias("gap_id"), kind.alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), "ts", "event_id"))


MEMBERS = "gm AS (SELECT DISTINCT c_nationkey AS set_id, c_custkey AS doc_id FROM customer WHERE c_nationkey <> 7)"


def set_members(t):
    return t.customer.where("c_nationkey <> 7").select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("doc_id"))


@query("d51_gt_set_report", f"""
WITH {MEMBERS}, {RSEC}, a AS (SELECT DISTINCT doc_id FROM rs WHERE doc_id % 4 < 3)
SELECT n_nationkey AS set_id, count(gm.doc_id) AS n_documents, count(a.doc_id) AS n_annotated, min(gm.doc_id) AS first_document, round(coalesce(count(a.doc_id) / nullif(count(gm.doc_id), 0), 0), 4) AS coverage FROM nation LEFT JOIN gm ON gm.set_id = n_nationkey LEFT JOIN a ON a.doc_id = gm.doc_id GROUP BY 1""")
def gt_set_report(t):
    return V.gt_set_report(t.nation.select(F.col("n_nationkey").alias("set_id")), set_members(t), report_sections(t).where("doc_id % 4 < 3"))


@query("d51_gt_set_documents", f"""
WITH {MEMBERS}, {RSEC}, c AS (SELECT doc_id, count(DISTINCT page) AS covered FROM (SELECT doc_id, unnest(range(start_page, end_page + 1)) AS page FROM rs WHERE doc_id % 4 < 3) GROUP BY doc_id)
SELECT set_id, gm.doc_id, n_pages, least(floor(100 * coalesce(covered, 0) / n_pages), 100)::BIGINT AS coverage FROM gm JOIN r_documents d ON d.doc_id = gm.doc_id LEFT JOIN c ON c.doc_id = gm.doc_id""")
def gt_set_documents(t):
    return V.gt_set_documents(set_members(t), t.r_documents, report_sections(t).where("doc_id % 4 < 3"))


@query("d37_bbox_coverage", "SELECT doc_id, count(*) AS n_rows, count(*) FILTER (row_id % 7 > 1) AS n_boxed, floor(100 * count(*) FILTER (row_id % 7 > 1) / count(*))::BIGINT AS bbox_coverage FROM r_rows GROUP BY 1")
def bbox_coverage(t):
    return V.bbox_coverage(t.r_rows.select("doc_id", (F.col("row_id") % 7 > 1).alias("has_bbox")))


@query("d37_corpus_health", """
WITH a AS (SELECT DISTINCT user_id AS doc_id, event_type AS kind FROM events), w AS (SELECT unnest(['click', 'error', 'view']) AS kind)
SELECT d.doc_id, count(a.kind)::INT AS n_present, coalesce(string_agg(w.kind, ',' ORDER BY w.kind) FILTER (a.kind IS NULL), '') AS missing FROM r_documents d CROSS JOIN w LEFT JOIN a ON a.doc_id = d.doc_id AND a.kind = w.kind GROUP BY 1""")
def corpus_health(t):
    return V.corpus_health(t.r_documents, t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind")), ["click", "error", "view"])


@query("d35_extraction_match", "SELECT doc_id, n_pages, coalesce(pages, 0) AS pages, CASE WHEN coalesce(pages, 0) = 0 THEN 'missing' WHEN pages < n_pages THEN 'partial' ELSE 'ok' END AS status FROM r_documents LEFT JOIN (SELECT doc_id, max(page_no) AS pages FROM r_tables WHERE doc_id % 5 > 0 GROUP BY 1) USING (doc_id)")
def extraction_match(t):
    return V.extraction_match_status(t.r_documents.select("doc_id", "n_pages"), t.r_tables.where("doc_id % 5 > 0").groupBy("doc_id").agg(F.max("page_no").alias("pages")))


NOTE_RULES = [("plate", "DISC.PPE"), ("rod", "DISC.TAX"), ("wheel|bolt", "DISC.LEASES")]
NOTE_RULE_SQL = "CASE WHEN regexp_matches(lower(label), 'plate') THEN 'DISC.PPE' WHEN regexp_matches(lower(label), 'rod') THEN 'DISC.TAX' WHEN regexp_matches(lower(label), 'wheel|bolt') THEN 'DISC.LEASES' END"
REFS = r"""la AS (SELECT l.doc_id, l.table_id, t.table_ord, l.row_id, l.row_idx, raw AS label, try_cast(nullif(regexp_extract(lower(raw), 'note ([0-9]{1,3})', 1), '') AS INT) AS note_number, t.context FROM l_labels l JOIN r_tables t USING (table_id)),
nc AS (SELECT doc_id, table_id, table_ord, row_id, row_idx, label, (row_id % 30)::INT AS note_number FROM la WHERE table_id % 2 = 0 AND row_idx % 2 = 1),
en AS (SELECT *, 1 AS src FROM nc UNION ALL SELECT doc_id, table_id, table_ord, row_id, row_idx, label, note_number, 2 FROM la WHERE note_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nc WHERE nc.row_id = la.row_id AND nc.note_number = la.note_number)),
tm AS (SELECT doc_id, table_id, table_ord, row_id, row_idx, regexp_extract(label, '^\s*([0-9]{1,3})\s*[.)]\s+(.+)', 2) AS label, try_cast(nullif(regexp_extract(label, '^\s*([0-9]{1,3})\s*[.)]\s+(.+)', 1), '') AS INT) AS note_number
  FROM (SELECT * REPLACE (CASE WHEN row_idx > 0 THEN (row_idx + doc_id % 9) || '. ' || label ELSE label END AS label) FROM la WHERE table_ord <= 20 AND table_id % 6 = 0)),
te AS (SELECT *, 3 AS src FROM tm WHERE note_number IS NOT NULL AND table_id IN (SELECT table_id FROM tm WHERE note_number IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)),"""
NOTES = f"""ae AS (SELECT *, {NOTE_RULE_SQL} AS ctx FROM (SELECT * FROM en UNION ALL SELECT doc_id, table_id, table_ord, row_id, row_idx, label, note_number, src FROM te)),
notes AS (SELECT doc_id, note_number, arg_min(ctx, (src, table_ord, row_idx, row_id)) FILTER (ctx IS NOT NULL) AS context, arg_min(src, (src, table_ord, row_idx, row_id)) FILTER (ctx IS NOT NULL) AS src, count(*) FILTER (src < 3) AS n_refs, count(*) AS n_entries FROM ae GROUP BY 1, 2)"""


def labelled(t):
    from ..functions.labels import clean_label

    return t.l_labels.join(t.r_tables.select("table_id", "table_ord", "context"), "table_id").select("doc_id", "table_id", "table_ord", "row_id", "row_idx", F.col("raw").alias("label"), clean_label(F.col("raw"))["note_number"].alias("note_number"), "context")


def refs(t):
    """Rows that refer to notes, by note columns (every second row of even tables) and labels."""
    r = labelled(t)
    noted = r.where("table_id % 2 = 0 and row_idx % 2 = 1").withColumn("text", F.concat((F.col("row_id") % 30).cast("string"), F.lit(".1")))
    return V.note_entries(noted, r)


def contents(t):
    numbered = labelled(t).withColumn("label", F.when(F.col("row_idx") > 0, F.concat((F.col("row_idx") + F.col("doc_id") % 9).cast("string"), F.lit(". "), F.col("label"))).otherwise(F.col("label"))).drop("table_ord")
    return V.toc_note_entries(t.r_tables.withColumn("n_value_cols", F.when(F.col("table_id") % 6 == 0, 2).otherwise(4)), numbered)


def notes(t):
    return V.note_contexts(refs(t).unionByName(contents(t)), NOTE_RULES)


@query("c6_note_entries", f"WITH {REFS} {NOTES} SELECT doc_id, table_id, row_id, note_number, src FROM ae")
def note_entries(t):
    return refs(t).unionByName(contents(t)).select("doc_id", "table_id", "row_id", "note_number", "src")


@query("c6_note_references", f"WITH {REFS} {NOTES} SELECT * FROM notes")
def note_references(t):
    return notes(t)


@query("c7_classify_by_note_votes", f"""
WITH {REFS} {NOTES}, v AS (SELECT r.doc_id, r.table_id, n.context, count(*) AS votes FROM en r JOIN notes n USING (doc_id, note_number) WHERE n.context IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id, table_id) AS total, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY votes DESC, context DESC) AS k FROM v)
SELECT doc_id, table_id, context, votes, total::BIGINT AS total FROM w WHERE k = 1 AND votes >= 2 AND votes >= 0.5 * total""")
def classify_by_note_votes(t):
    return V.classify_by_note_votes(refs(t).select("doc_id", "table_id", "note_number"), notes(t))


@query("d15_structure_violations", """
WITH c AS (SELECT table_id, count(*) FILTER (regexp_matches(lower(label), 'plate|gear')) AS income, count(*) FILTER (lower(label) LIKE '%rod%') AS balance, count(*) AS n_rows FROM r_rows WHERE row_type = 'DATA' GROUP BY 1)
SELECT t.doc_id, t.table_id, t.context, income, balance, n_rows, CASE WHEN context = 'OCI' AND income >= 2 THEN 'OCI_HAS_PNL_STRUCTURE' ELSE 'MIXED_SUMMARY' END AS violation
FROM r_tables t JOIN c USING (table_id) WHERE (context = 'OCI' AND income >= 2) OR (n_rows <= 8 AND income >= 2 AND balance >= 1)""")
def structure_violations(t):
    return V.structure_violations(t.r_tables, t.r_rows, "plate|gear", "rod")
