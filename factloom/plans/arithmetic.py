"""Queries on table structure and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from .registry import query


@query("c10_parent_child", """
SELECT r.doc_id, r.table_id, r.parent_id, r.row_id, c.col_idx, c.value, p.value AS parent_value
FROM r_rows r JOIN r_cells c ON c.table_id = r.table_id AND c.row_id = r.row_id JOIN r_cells p ON p.table_id = r.table_id AND p.row_id = r.parent_id AND p.col_idx = c.col_idx""")
def parent_child(t):
    return S.parent_child(t.r_rows, t.r_cells)


@query("d5_table_arithmetic", """
SELECT r.doc_id, r.table_id, r.parent_id, c.col_idx, round(any_value(p.value), 2) AS expected, round(sum(c.value), 2) AS actual, count(*) AS n_children,
       abs(any_value(p.value) - sum(c.value)) <= greatest(0.5, 0.001 * abs(any_value(p.value))) AS passed,
       round(round(any_value(p.value), 2) - round(sum(c.value), 2), 2) AS delta
FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id JOIN r_cells p ON p.row_id = r.parent_id AND p.col_idx = c.col_idx
WHERE c.value IS NOT NULL AND p.value IS NOT NULL GROUP BY ALL""")
def table_arithmetic(t):
    return S.table_arithmetic(t.r_tables, t.r_tree_cells)


@query("d27_hierarchy_quality", """
WITH s AS (
  SELECT r.doc_id, r.table_id, c.col_idx, any_value(p.value) AS p, sum(c.value) AS s, count(c.value) AS n, count(*) AS k
  FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id JOIN r_cells p ON p.row_id = r.parent_id AND p.col_idx = c.col_idx
  WHERE p.value IS NOT NULL GROUP BY r.doc_id, r.table_id, r.parent_id, c.col_idx
), q AS (
  SELECT doc_id, table_id, count(*) AS checks, avg((abs(p - s) <= greatest(1, 0.02 * abs(p)))::INT) AS rate FROM s WHERE n = k AND k >= 2 GROUP BY doc_id, table_id
)
SELECT doc_id, table_id, checks, round(rate, 4) AS rate, (CASE WHEN checks < 3 THEN 1 WHEN rate < 0.5 THEN 0.3 WHEN rate < 0.7 THEN 0.7 ELSE 1 END)::DOUBLE AS score FROM q""")
def hierarchy_quality(t):
    return S.hierarchy_quality(t.r_tables, t.r_tree_cells)


GAPPY = "gappy AS (SELECT table_id, row_id, row_idx, col_idx, CASE WHEN (table_id % 5 = 0 AND col_idx > 1) OR (table_id % 5 = 1 AND (col_idx + row_idx) % 2 = 0) OR (table_id % 5 = 2 AND (col_idx > 2 OR row_idx % 3 = 0)) THEN NULL ELSE value END AS value FROM r_cells WHERE NOT (table_id % 7 = 3 AND col_idx = 4 AND row_idx % 2 = 0))"


@query("d26_structural_quality", f"""
WITH {GAPPY}, bare AS (SELECT * FROM r_rows WHERE table_id % 13 <> 5), pr AS (SELECT table_id, row_id, count(*) AS n, count(value) AS parsed FROM gappy GROUP BY ALL),
rate AS (SELECT table_id, avg((n <> 4)::INT) AS ragged, sum(parsed) / sum(n) AS parse_rate FROM pr GROUP BY table_id),
lab AS (SELECT table_id, avg(regexp_matches(label, '[^A-Za-z ]')::INT) AS garbled, count(*) AS n_rows FROM bare GROUP BY table_id),
sp AS (SELECT table_id, count(*) AS k, max(abs(value)) / min(abs(value)) AS spread FROM gappy WHERE value <> 0 GROUP BY table_id),
f AS (SELECT t.doc_id, t.table_id, list_filter([CASE WHEN coalesce(n_rows, 0) = 0 THEN {{'r': 'empty', 's': 0.0}} END, CASE WHEN ragged > 0.3 THEN {{'r': 'ragged', 's': 0.3}} END,
   CASE WHEN parse_rate < 0.3 THEN {{'r': 'parse_low', 's': 0.3}} END, CASE WHEN parse_rate >= 0.3 AND parse_rate < 0.5 THEN {{'r': 'parse_mid', 's': 0.7}} END,
   CASE WHEN k >= 3 AND spread > 1e6 THEN {{'r': 'spread', 's': 0.7}} END, CASE WHEN garbled > 0.3 THEN {{'r': 'garbled', 's': 0.3}} END], lambda x: x IS NOT NULL) AS found
  FROM r_tables t LEFT JOIN lab USING (table_id) LEFT JOIN rate USING (table_id) LEFT JOIN sp USING (table_id))
SELECT doc_id, table_id, coalesce(list_min([x.s FOR x IN found]), 1)::DOUBLE AS score, coalesce(array_to_string([x.r FOR x IN found], ','), '') AS reasons,
       coalesce(list_min([x.s FOR x IN found]), 1) >= 0.3 AS is_processable FROM f""")
def structural_quality(t):
    k, r, c = F.col("table_id") % 5, F.col("row_idx"), F.col("col_idx")
    gap = ((k == 0) & (c > 1)) | ((k == 1) & ((c + r) % 2 == 0)) | ((k == 2) & ((c > 2) | (r % 3 == 0)))
    cells = t.r_cells.where(~((F.col("table_id") % 7 == 3) & (c == 4) & (r % 2 == 0))).withColumn("value", F.when(~gap, F.col("value")))
    return S.structural_quality(t.r_rows.where("table_id % 13 <> 5"), cells, t.r_tables)


ADDITIVE = """w AS (SELECT table_id, row_id, max(value) FILTER (col_idx = 1) AS a, max(value) FILTER (col_idx = 2) AS b, max(value) FILTER (col_idx = 3) AS c, max(value) FILTER (col_idx = 4) AS d
           FROM r_cells WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM (VALUES (1, '2,3'), (1, '2,4'), (1, '3,4'), (1, '2,3,4'), (2, '1,3'), (2, '1,4'), (2, '3,4'), (2, '1,3,4'), (3, '1,2'), (3, '1,4'), (3, '2,4'), (3, '1,2,4'),
      (4, '1,2'), (4, '1,3'), (4, '2,3'), (4, '1,2,3')) v(total, parts)),
r AS (SELECT table_id, total, parts, [a, b, c, d][total] AS t, list_sum([[a, b, c, d][p::INT] FOR p IN string_split(parts, ',')]) AS s,
             len(list_filter(string_split(parts, ','), lambda p: [a, b, c, d][p::INT] IS NULL)) AS gaps FROM w, m),
g AS (SELECT table_id, total, parts, count(*) AS n, avg((abs(s - t) <= greatest(1, 0.02 * abs(t)))::INT) AS rate FROM r WHERE t IS NOT NULL AND gaps = 0 GROUP BY ALL HAVING n >= 3 AND rate >= 0.6),
ad AS (SELECT table_id, total, parts, n, round(rate, 4) AS rate FROM g QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY rate DESC, total, length(parts), parts) = 1)"""


@query("d28_additive_columns", f"WITH {ADDITIVE} SELECT * FROM ad")
def additive_columns(t):
    return S.additive_columns(t.r_tree_cells)


CHAINS = """sig AS (SELECT table_id, string_agg(header, '|' ORDER BY col_idx) AS signature FROM c_columns WHERE role = 'VALUE' GROUP BY table_id),
e AS (SELECT table_id, arg_max(lower(label) LIKE '%plate%', row_idx) AS ends_total FROM c_rows GROUP BY table_id),
x AS (SELECT t.*, signature, ends_total, lag(signature) OVER o AS ps, lag(page_no) OVER o AS pp, lag(context) OVER o AS pc, lag(ends_total) OVER o AS pe
      FROM c_tables t JOIN sig USING (table_id) LEFT JOIN e USING (table_id) WINDOW o AS (PARTITION BY doc_id ORDER BY table_ord)),
b AS (SELECT *, CASE WHEN ps = signature AND signature <> '' AND page_no - pp BETWEEN 0 AND 1 AND NOT coalesce(pe, false) AND (context IS NULL OR pc IS NULL OR context = pc) THEN 0 ELSE 1 END AS br FROM x),
c AS (SELECT *, sum(br) OVER (PARTITION BY doc_id ORDER BY table_ord) AS chain FROM b),
ch AS (SELECT doc_id, chain::BIGINT AS chain, arg_min(table_id, table_ord) AS table_id, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_tables,
       string_agg(table_id::VARCHAR, ',' ORDER BY table_ord) AS stitched_from FROM c GROUP BY doc_id, chain)"""


@query("e2_stitch_tables", f"WITH {CHAINS} SELECT * FROM ch")
def stitch_tables(t):
    cols = t.c_columns.where("role = 'VALUE'")
    signature = cols.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda x: x["header"]), "|").alias("signature"))
    ends = t.c_rows.groupBy("table_id").agg(F.max_by(F.lower("label").contains("plate"), "row_idx").alias("ends_total"))
    return S.stitch_tables(t.c_tables, signature, ends)


@query("e2_stitch_rows", f"""
WITH {CHAINS}, p AS (SELECT table_id AS logical, unnest(string_split(stitched_from, ','))::BIGINT AS table_id FROM ch), n AS (SELECT r.doc_id, p.logical, row_number() OVER (PARTITION BY logical ORDER BY t.table_ord, r.row_idx, r.row_id) - 1 AS i, r.label, r.table_id, r.row_id FROM c_rows r JOIN p USING (table_id) JOIN c_tables t ON t.table_id = r.table_id)
SELECT doc_id, logical AS table_id, i AS row_idx, logical || '_' || i AS row_id, label, NULL::VARCHAR AS parent_id, table_id AS stitched_from, row_id AS old_row_id FROM n""")
def stitch_rows(t):
    return S.stitch_rows(stitch_tables(t), t.c_tables, t.c_rows)


@query("e2_stitch_boxes", f"""
WITH {CHAINS}, p AS (SELECT table_id AS logical, unnest(string_split(stitched_from, ','))::BIGINT AS table_id FROM ch) SELECT logical AS table_id, min(table_id % 50)::DOUBLE AS l, max(400 + table_id % 300)::DOUBLE AS t, max(300 + table_id % 200)::DOUBLE AS r, min(table_id % 90)::DOUBLE AS b FROM p GROUP BY 1""")
def stitch_boxes(t):
    k = F.col("table_id")
    boxes = t.c_tables.select("table_id", (k % 50).cast("double").alias("l"), (400 + k % 300).cast("double").alias("t"), (300 + k % 200).cast("double").alias("r"), (k % 90).cast("double").alias("b"))
    return S.stitch_boxes(stitch_tables(t), boxes)


@query("e13_value_monotonicity", """
WITH s AS (SELECT table_id, value, lag(value) OVER (PARTITION BY table_id ORDER BY row_idx) AS b FROM r_cells WHERE col_idx = 2 AND value IS NOT NULL)
SELECT table_id, round(avg((value >= b)::INT), 4) AS monotonicity, count(*) AS steps FROM s WHERE b IS NOT NULL GROUP BY table_id""")
def value_monotonicity(t):
    return S.value_monotonicity(t.r_cells, 2)
