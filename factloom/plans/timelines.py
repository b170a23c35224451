"""Queries on pages and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timelines as T
from .registry import query

SECTIONS = "sec AS (SELECT doc_id, section_type, page AS start_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, greatest(page, n_pages)) AS end_page FROM t_transitions JOIN t_documents USING (doc_id))"
PAGES = "pg AS (SELECT doc_id, unnest(range(1, n_pages + 1))::INT AS page FROM t_documents)"
MAP = "pm AS (SELECT doc_id, page_no AS page, context AS type FROM r_tables WHERE context IS NOT NULL)"
RSEC = "rs AS (SELECT DISTINCT c_custkey AS doc_id, v.section_type, v.s + c_custkey % 4 AS start_page, v.s + c_custkey % 4 + v.w AS end_page FROM customer, (VALUES ('PNL', 3, 6), ('SFP', 8, 4), ('NOTES', 14, 9)) v(section_type, s, w))"


def sections(t):
    return T.transitions_to_sections(t.t_transitions, t.t_documents)


def report_sections(t):
    of = [F.struct(F.lit(k).alias("section_type"), F.lit(s).alias("s"), F.lit(w).alias("w")) for k, s, w in (("PNL", 3, 6), ("SFP", 8, 4), ("NOTES", 14, 9))]
    c = t.customer.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*of)).alias("sec"))
    start = F.col("sec.s") + F.col("doc_id") % 4
    return c.select("doc_id", "sec.section_type", start.alias("start_page"), (start + F.col("sec.w")).alias("end_page"))


def page_map(t):
    return t.r_tables.where("context is not null").select("doc_id", F.col("page_no").alias("page"), F.col("context").alias("type"))


@query("e3_transitions_to_sections", f"WITH {SECTIONS} SELECT * FROM sec")
def transitions_to_sections(t):
    return sections(t)


@query("e3_round_trip", "SELECT doc_id, page, section_type FROM t_transitions")
def round_trip(t):
    return T.sections_to_transitions(sections(t))


@query("e4_resolve_transitions", f"""
WITH {PAGES}, a AS (SELECT pg.doc_id, pg.page, last_value(section_type IGNORE NULLS) OVER (PARTITION BY pg.doc_id ORDER BY pg.page) AS type FROM pg LEFT JOIN t_transitions t ON t.doc_id = pg.doc_id AND t.page = pg.page),
b AS (SELECT *, CASE WHEN type <> 'TOC' THEN type END AS c FROM a)
SELECT doc_id, page, type, CASE WHEN type IS NOT NULL THEN coalesce(first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page)) END AS "group" FROM b""")
def resolve_transitions(t):
    return T.resolve_transitions(t.t_transitions, t.t_documents)


@query("e5_multi_tags", f"""
WITH {SECTIONS} SELECT doc_id, page, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (
  SELECT s.doc_id, unnest(range(s.start_page, greatest(s.start_page, s.end_page) + 1))::INT AS page, 'extra' || (s.start_page % 2) AS tag FROM sec s WHERE s.start_page % 3 = 1) GROUP BY ALL""")
def multi_tags(t):
    multi = t.t_transitions.where("page % 3 = 1").select("doc_id", "page", F.concat(F.lit("extra"), (F.col("page") % 2).cast("string")).alias("tag"))
    return T.resolve_multi_tags(multi, t.t_transitions, t.t_documents)


@query("e6_hierarchy_groups", f"""
WITH {SECTIONS}, b AS (SELECT *, CASE WHEN lag(section_type) OVER w = section_type THEN 0 ELSE 1 END AS br FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY start_page)),
c AS (SELECT *, sum(br) OVER (PARTITION BY doc_id ORDER BY start_page) AS isl FROM b)
SELECT doc_id, any_value(section_type) AS grp, min(start_page) AS start_page, max(end_page) AS end_page, count(*) AS n_sections FROM c GROUP BY doc_id, isl""")
def hierarchy_groups(t):
    return T.hierarchy_groups(sections(t))


@query("e7_merge_page_runs", f"""
WITH {MAP}, b AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 5 THEN 0 ELSE 1 END AS br FROM pm WINDOW w AS (PARTITION BY doc_id, type ORDER BY page)),
c AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, type ORDER BY page ROWS UNBOUNDED PRECEDING) AS isl FROM b)
SELECT doc_id, type, min(page) AS start_page, max(page) AS end_page, count(*) AS n_pages FROM c GROUP BY doc_id, type, isl""")
def merge_page_runs(t):
    return T.merge_page_runs(page_map(t))


@query("e8_flagged_ranges", """
WITH f AS (SELECT DISTINCT doc_id, page_no AS page FROM r_tables WHERE context IS NULL),
b AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 3 THEN 0 ELSE 1 END AS br, count(*) OVER (PARTITION BY doc_id) AS total FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
c AS (SELECT *, sum(br) OVER (PARTITION BY doc_id ORDER BY page) AS isl FROM b WHERE total >= 3)
SELECT doc_id, min(page) AS start_page, max(page) AS end_page, count(*) AS n_flagged FROM c GROUP BY doc_id, isl HAVING max(page) - min(page) + 1 >= 3""")
def flagged_ranges(t):
    return T.flagged_ranges(t.r_tables.where("context is null").select("doc_id", F.col("page_no").alias("page")))


@query("e8_review_template", """
WITH f AS (SELECT doc_id, table_id, page_no AS page FROM r_tables WHERE context IS NULL), p AS (SELECT DISTINCT doc_id, page FROM f),
b AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 3 THEN 0 ELSE 1 END AS br, count(*) OVER (PARTITION BY doc_id) AS total FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
c AS (SELECT *, sum(br) OVER (PARTITION BY doc_id ORDER BY page) AS isl FROM b WHERE total >= 3), r AS (SELECT doc_id, min(page) AS start_page, max(page) AS end_page FROM c GROUP BY doc_id, isl HAVING max(page) - min(page) + 1 >= 3)
SELECT doc_id, 'range' AS kind, NULL::BIGINT AS table_id, start_page, end_page FROM r UNION ALL SELECT doc_id, 'table', table_id, page, page FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND f.page BETWEEN start_page AND end_page)""")
def review_template(t):
    flagged = t.r_tables.where("context is null").select("doc_id", "table_id", F.col("page_no").alias("page"))
    return T.review_template(flagged, T.flagged_ranges(flagged.select("doc_id", "page")))


@query("e9_toc_offset", """
WITH e AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 60 + 5 AS INT) AS page FROM orders)
SELECT doc_id, CASE WHEN avg((page > n_pages)::INT) > 0.5 THEN min(page) - 2 ELSE 0 END AS page_offset FROM e JOIN r_documents USING (doc_id) GROUP BY doc_id""")
def toc_offset(t):
    return T.toc_offset(t.orders.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 60 + 5).cast("int").alias("page")), t.r_documents)


@query("c4_asof_section", f"""
WITH {RSEC}, s AS (SELECT *, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page), start_page + 20) AS until FROM rs)
SELECT t.doc_id, t.table_id, t.page_no, CASE WHEN s.start_page = t.page_no THEN s.section_type WHEN t.page_no < s.until AND s.section_type <> 'NOTES' THEN s.section_type END AS section_type
FROM r_tables t ASOF LEFT JOIN s ON s.doc_id = t.doc_id AND s.start_page <= t.page_no""")
def asof_section(t):
    return T.asof_section(t.r_tables, report_sections(t).withColumnRenamed("start_page", "page"))


@query("c5_interval_join", f"""
WITH {RSEC} SELECT t.doc_id, t.table_id, t.page_no AS page, (SELECT arg_min(section_type, start_page) FROM rs WHERE rs.doc_id = t.doc_id AND t.page_no BETWEEN rs.start_page AND rs.end_page) AS section_type FROM r_tables t""")
def interval_join(t):
    return T.interval_join(t.r_tables.select("doc_id", "table_id", F.col("page_no").alias("page")), report_sections(t))


@query("c5_interval_join_last", f"""
WITH {RSEC} SELECT t.doc_id, t.table_id, t.page_no AS page, (SELECT arg_max(section_type, start_page) FROM rs WHERE rs.doc_id = t.doc_id AND t.page_no BETWEEN rs.start_page AND rs.end_page) AS section_type FROM r_tables t""")
def interval_join_last(t):
    return T.interval_join(t.r_tables.select("doc_id", "table_id", F.col("page_no").alias("page")), report_sections(t), "last")


@query("c19_validate_sections", f"""
WITH {RSEC}, s AS (SELECT doc_id, section_type || start_page AS section_id, CASE WHEN doc_id % 7 = 0 AND section_type = 'SFP' THEN 'TOC' ELSE section_type END AS section_type, CASE WHEN doc_id % 11 = 0 AND section_type = 'PNL' THEN NULL ELSE start_page END AS start_page, end_page FROM rs),
h AS (SELECT table_id, bool_or(contains(lower(label), 'hot rod') OR contains(lower(label), 'gear')) AS p, bool_or(contains(lower(label), 'cold plate')) AS f FROM r_rows GROUP BY 1),
v AS (SELECT table_id, count(value) AS n, count(*) FILTER (value >= 1 AND value <= 500 AND value = floor(value)) AS k FROM r_cells GROUP BY 1),
j AS (SELECT s.*, t.table_id, t.context, CASE section_type WHEN 'PNL' THEN p WHEN 'SFP' THEN f ELSE false END AS own, v.n, v.k FROM s LEFT JOIN r_tables t ON t.doc_id = s.doc_id AND t.page_no BETWEEN s.start_page AND s.end_page LEFT JOIN h USING (table_id) LEFT JOIN v USING (table_id)),
g AS (SELECT doc_id, section_id, section_type, start_page, count(table_id) AS n_tables, coalesce(bool_or(own AND table_id IS NOT NULL), false) AS by_keyword, coalesce(bool_or(context = section_type), false) AS by_class, coalesce(sum(k) / nullif(sum(n), 0), 0) AS small FROM j GROUP BY 1, 2, 3, 4),
o AS (SELECT *, CASE WHEN section_type = 'TOC' THEN small > 0.5 WHEN section_type NOT IN ('PNL', 'SFP') THEN true ELSE by_keyword OR by_class END AS ok FROM g)
SELECT doc_id, section_id, section_type, start_page, n_tables, CASE WHEN start_page IS NOT NULL AND n_tables > 0 AND ok THEN 'ok' ELSE 'warning' END AS status,
  CASE WHEN start_page IS NULL THEN 'no start' WHEN n_tables = 0 THEN 'no tables' WHEN section_type = 'TOC' THEN CASE WHEN ok THEN 'numbers' ELSE 'no numbers' END WHEN by_keyword THEN 'keyword' WHEN by_class THEN 'class' WHEN ok THEN 'tables' ELSE 'nothing fits' END AS detail FROM o""")
def validate_sections(t):
    kind = F.when((F.col("doc_id") % 7 == 0) & (F.col("section_type") == "SFP"), "TOC").otherwise(F.col("section_type"))
    start = F.when(~((F.col("doc_id") % 11 == 0) & (F.col("section_type") == "PNL")), F.col("start_page"))
    s = report_sections(t).select("doc_id", F.concat("section_type", F.col("start_page").cast("string")).alias("section_id"), kind.alias("section_type"), start.alias("start_page"), "end_page")
    return T.validate_sections(s, t.r_tables.withColumn("page_no", F.col("page_no").cast("long")), t.r_rows, t.r_cells, {"PNL": ["hot rod", "gear"], "SFP": ["cold plate"]})


@query("c22_transition_diff", """
WITH n AS (SELECT doc_id, page, CASE WHEN page % 5 = 0 THEN 'SFP' ELSE section_type END AS section_type FROM t_transitions WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2, 'OCI' FROM t_documents WHERE doc_id % 4 = 0),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.page, n.page) AS page, o.section_type AS old_type, n.section_type AS new_type FROM t_transitions o FULL JOIN n ON o.doc_id = n.doc_id AND o.page = n.page)
SELECT *, CASE WHEN old_type IS NULL THEN 'add' WHEN new_type IS NULL THEN 'remove' WHEN old_type <> new_type THEN 'reclassify' END AS action FROM j WHERE action IS NOT NULL""")
def transition_diff(t):
    new = t.t_transitions.where("doc_id % 3 <> 0").withColumn("section_type", F.when(F.col("page") % 5 == 0, "SFP").otherwise(F.col("section_type")))
    new = new.unionByName(t.t_documents.where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("page"), F.lit("OCI").alias("section_type")))
    return T.transition_diff(t.t_transitions, new)


@query("d34_page_coverage", f"""
WITH {RSEC}, c AS (SELECT doc_id, count(DISTINCT page) AS covered FROM (SELECT doc_id, unnest(range(start_page, end_page + 1)) AS page FROM rs) GROUP BY doc_id)
SELECT doc_id, n_pages, coalesce(covered, 0) AS covered, least(floor(100 * coalesce(covered, 0) / n_pages), 100)::BIGINT AS coverage FROM r_documents LEFT JOIN c USING (doc_id)""")
def page_coverage(t):
    return T.page_coverage(t.r_documents.select("doc_id", "n_pages"), report_sections(t))


@query("d40_evaluate_detector", f"""
WITH {RSEC}, {MAP}, tr AS (SELECT DISTINCT doc_id, section_type AS type, unnest(range(start_page, end_page + 1)) AS page FROM rs), g AS (SELECT DISTINCT doc_id, type, page FROM pm),
j AS (SELECT coalesce(tr.type, g.type) AS type, tr.page AS t, g.page AS g FROM tr FULL JOIN g ON tr.doc_id = g.doc_id AND tr.type = g.type AND tr.page = g.page)
SELECT type, count(t) AS truth, count(g) AS detected, count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) AS hits, round(hits / nullif(detected, 0), 4) AS precision, round(hits / nullif(truth, 0), 4) AS recall FROM j GROUP BY type""")
def evaluate_detector(t):
    return T.evaluate_detector(page_map(t), report_sections(t))
