"""Queries on facts and the checks between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import facts as X
from .dealt import by_table, facts, small
from .registry import query

BEST = """best AS (SELECT * FROM r_facts QUALIFY row_number() OVER (PARTITION BY doc_id, context, concept_id, period_key
  ORDER BY is_primary DESC, value_cols > 4, table_id, row_id, col_idx) = 1)"""
SUMS = "sums AS (SELECT doc_id, context, concept_id, period_key, round(sum(amount), 2) AS amount FROM r_facts GROUP BY ALL)"
SCALE = "(abs({a} / {b}) BETWEEN 990 AND 1010 OR abs({a} / {b}) BETWEEN 990000 AND 1010000 OR abs({a} / {b}) BETWEEN 0.00099 AND 0.00101 OR abs({a} / {b}) BETWEEN 0.00000099 AND 0.00000101)"


@query("b10_period_keys", """
SELECT doc_id, table_id, col_idx, coalesce(replace(period_axis, 'PERIOD.', ''), 'ord_' || (row_number() OVER (PARTITION BY table_id ORDER BY col_idx) - 1)) AS period_key
FROM r_columns WHERE role = 'VALUE'""")
def period_keys(t):
    return X.period_keys(t.r_columns)


WIDE = """wc AS (SELECT * FROM r_columns UNION ALL SELECT doc_id, table_id, col_idx + 4, role, header, period_axis FROM r_columns WHERE col_idx IN (2, 3, 4) AND table_id % 5 = 0),
wv AS (SELECT * FROM r_cells UNION ALL SELECT table_id, row_id, row_idx, col_idx + 4, value * 2 FROM r_cells WHERE col_idx IN (2, 3, 4) AND table_id % 5 = 0)"""


def wide(t):
    """Columns and cells in which every fifth table has three value columns more, of the same periods. No unions, which would forget how their sides are dealt."""
    again = F.when(F.expr("col_idx in (2, 3, 4) and table_id % 5 = 0"), F.array(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0)))
    more = lambda df: df.withColumn("more", F.explode(again)).withColumn("col_idx", F.col("col_idx") + F.col("more"))
    return more(t.r_columns).drop("more"), more(t.r_cells).withColumn("value", F.when(F.col("more") > 0, F.col("value") * 2).otherwise(F.col("value"))).drop("more")


@query("d1_index_facts", f"""
WITH {WIDE}, p AS (SELECT table_id, col_idx, coalesce(replace(period_axis, 'PERIOD.', ''), 'ord_' || (row_number() OVER (PARTITION BY table_id ORDER BY col_idx) - 1)) AS period_key,
                  count(*) OVER (PARTITION BY table_id) AS value_cols, col_idx = max(col_idx) OVER (PARTITION BY table_id, coalesce(period_axis, '')) AS is_last FROM wc WHERE role = 'VALUE'),
ix AS (SELECT lower(p_name) AS norm, min(p_type) AS concept_id FROM part GROUP BY 1),
r AS (SELECT doc_id, table_id, row_id, label, tag AS concept_id, NULL AS label_context, 'tag' AS source FROM r_rows WHERE tag IS NOT NULL
  UNION ALL SELECT doc_id, table_id, row_id, label, ix.concept_id, CASE ix.concept_id WHEN 'ECONOMY' THEN 'DISC.SEGMENTS' ELSE 'SFP' END, 'label' FROM r_rows JOIN ix ON ix.norm = lower(label) WHERE tag IS NULL),
f AS (SELECT r.*, coalesce(t.context IN ('PNL', 'SFP', 'OCI', 'CFS', 'SOCIE'), false) AS is_primary, coalesce(t.context, CASE source WHEN 'tag' THEN k.valid_context ELSE label_context END) AS context, p.period_key, c.col_idx, t.page_no, p.value_cols, t.sign_convention, k.balance_type,
             c.value * CASE WHEN t.unit = 'TEUR' THEN 1000 WHEN t.unit = 'EUR Mio' THEN 1000000 ELSE 1 END AS v
      FROM r JOIN wv c ON c.row_id = r.row_id AND c.table_id = r.table_id JOIN r_tables t ON t.table_id = r.table_id JOIN p ON p.table_id = r.table_id AND p.col_idx = c.col_idx
      LEFT JOIN r_concepts k ON k.concept_id = r.concept_id WHERE c.value IS NOT NULL AND (source = 'tag' OR (value_cols > 4 AND is_last) OR (value_cols <= 4 AND label_context <> 'DISC.SEGMENTS')))
SELECT doc_id, table_id, row_id, context, concept_id, period_key, col_idx,
       round(CASE WHEN sign_convention = 'NATURAL_DRCR' THEN v WHEN context IN ('PNL', 'OCI') THEN -v WHEN balance_type = 'credit' THEN -abs(v) WHEN balance_type = 'debit' THEN abs(v) ELSE v END, 2) AS amount,
       page_no, is_primary, value_cols, label, source FROM f""")
def index_facts(t):
    ix = t.part.groupBy(F.lower("p_name").alias("norm")).agg(F.min("p_type").alias("concept_id"))
    keep, ix = by_table(t, "r_tables", "r_rows"), small(ix, "index")
    matches = t.r_rows.where("tag is null").select("table_id", "row_id", F.lower("label").alias("norm")).join(ix, "norm").select("table_id", "row_id", "concept_id", F.when(F.col("concept_id") == "ECONOMY", "DISC.SEGMENTS").otherwise("SFP").alias("label_context"))
    columns, cells = wide(t)
    return keep(X.index_facts(t.r_rows, cells, t.r_tables, columns, small(t.r_concepts, "concepts"), matches), "facts")


@query("d2_best_fact", f"WITH {BEST} SELECT doc_id, context, concept_id, period_key, table_id, row_id, col_idx, amount, value_cols FROM best")
def best_fact(t):
    return X.best_fact(t.r_facts)


@query("d3_sum_by_axis", "SELECT doc_id, context, concept_id, period_key, round(sum(amount), 2) AS amount, count(*) AS n_facts FROM r_facts GROUP BY ALL")
def sum_by_axis(t):
    return X.sum_by_axis(t.r_facts)


@query("d4_recent_periods", """
SELECT doc_id, period_key, row_number() OVER (PARTITION BY doc_id ORDER BY period_key DESC) AS rank FROM (SELECT DISTINCT doc_id, period_key FROM r_facts)
QUALIFY rank <= 2""")
def recent_periods(t):
    return X.recent_periods(t.r_facts)


@query("d6_check_summation", f"""
WITH {BEST}, w AS (SELECT b.doc_id, b.context, b.period_key, e.edge_name, e.tol, b.amount AS expected, b.value_cols AS p_cols, m.concept_id AS child
  FROM best b JOIN r_edges e ON e.edge_type = 'SUMMATION' AND e.concept_id = b.concept_id AND e.context = b.context JOIN r_members m USING (edge_name)),
g AS (SELECT w.doc_id, w.context, w.period_key, edge_name, any_value(expected) AS expected, any_value(tol) AS tol, sum(k.amount) AS actual, count(k.amount) AS found,
        max(((k.value_cols > 4) <> (p_cols > 4))::INT) AS mixed, coalesce(string_agg(child, ',' ORDER BY child) FILTER (k.amount IS NULL), '') AS missing
  FROM w LEFT JOIN best k ON k.doc_id = w.doc_id AND k.context = w.context AND k.period_key = w.period_key AND k.concept_id = w.child GROUP BY ALL)
SELECT doc_id, context, period_key, edge_name, expected, round(actual, 2) AS actual, round(expected - actual, 2) AS delta, found, missing,
       CASE WHEN abs(round(expected - actual, 2)) <= tol THEN 'valid' WHEN expected <> 0 AND actual <> 0 AND {SCALE.format(a='expected', b='actual')} THEN 'scale' WHEN missing <> '' THEN 'partial' ELSE 'broken' END AS status
FROM g WHERE found > 0 AND coalesce(mixed, 0) = 0""")
def check_summation(t):
    return C.check_summation(X.best_fact(t.r_facts), t.r_edges, t.r_members)


@query("c8_cross_statement", f"""
WITH {BEST.replace("best AS (", "best AS MATERIALIZED (")}, a AS MATERIALIZED (SELECT b.doc_id, b.period_key, b.concept_id, b.amount, e.edge_name, e.tol, e.rule, coalesce(e.other_concept, e.concept_id) AS other, e.other_context FROM best b JOIN r_edges e ON e.concept_id = b.concept_id AND e.context = b.context WHERE e.edge_type = 'CROSS_STATEMENT_TIE'),
j AS (SELECT a.doc_id, a.edge_name, a.concept_id, b.concept_id AS other_concept, a.period_key, a.amount AS expected, b.amount AS actual, a.tol, round(CASE WHEN rule = 'opposite' THEN a.amount + b.amount ELSE a.amount - b.amount END, 2) AS delta
FROM a JOIN best b ON b.doc_id = a.doc_id AND b.period_key = a.period_key AND b.concept_id = a.other AND b.context = a.other_context)
SELECT doc_id, edge_name, concept_id, other_concept, period_key, expected, actual, delta, CASE WHEN abs(delta) <= tol THEN 'valid' WHEN expected <> 0 AND actual <> 0 AND {SCALE.format(a='expected', b='actual')} THEN 'scale' ELSE 'broken' END AS status FROM j""")
def check_cross_statement(t):
    return C.check_cross_statement(X.best_fact(t.r_facts), t.r_edges)


@query("c9_note_to_face", f"""
WITH {BEST}, n AS (SELECT b.doc_id, b.period_key, e.edge_name, sum(b.amount) AS note, count(*) AS n_notes FROM best b JOIN r_members m USING (concept_id)
  JOIN r_edges e ON e.edge_name = m.edge_name AND e.edge_type = 'NOTE_TO_FACE' AND e.other_context = b.context GROUP BY ALL),
f AS (SELECT b.doc_id, b.period_key, e.edge_name, e.tol, b.amount AS expected FROM best b JOIN r_edges e ON e.edge_type = 'NOTE_TO_FACE' AND e.concept_id = b.concept_id AND e.context = b.context),
j AS (SELECT f.*, note, n_notes, round(abs(abs(expected) - abs(note)), 2) AS delta FROM f JOIN n USING (doc_id, period_key, edge_name))
SELECT doc_id, edge_name, period_key, expected, round(note, 2) AS actual, n_notes, delta, CASE WHEN delta <= tol THEN 'OK' WHEN delta < 1e-4 * abs(expected) THEN 'INFO' ELSE 'ERROR' END AS severity FROM j""")
def check_note_to_face(t):
    return C.check_note_to_face(X.best_fact(t.r_facts), t.r_edges, t.r_members)


@query("d7_disaggregation", f"""
WITH {BEST}, {SUMS}, d AS (SELECT s.doc_id, s.period_key, m.edge_name, s.context, sum(s.amount) AS actual FROM sums s JOIN r_members m USING (concept_id) GROUP BY ALL),
j AS (SELECT b.doc_id, e.edge_name, b.period_key, b.amount AS expected, d.actual, e.tol, round(b.amount - d.actual, 2) AS delta FROM best b
  JOIN r_edges e ON e.edge_type = 'DISAGGREGATION' AND e.concept_id = b.concept_id AND e.context = b.context
  JOIN d ON d.doc_id = b.doc_id AND d.period_key = b.period_key AND d.edge_name = e.edge_name AND d.context = e.other_context),
k AS (SELECT j.*, l.amount AS line FROM j LEFT JOIN best l ON l.doc_id = j.doc_id AND l.period_key = j.period_key AND l.context = 'OCI' AND l.concept_id = 'STANDARD' AND j.edge_name = 'std_detail'),
t AS (SELECT doc_id, edge_name, period_key, expected, round(actual, 2) AS actual, delta, CASE WHEN abs(delta) <= tol THEN 'valid' WHEN coalesce(abs(line - delta) <= tol, false) THEN 'confirmed' WHEN abs(delta) < 1e-4 * abs(expected) THEN 'rounding'
       WHEN expected <> 0 AND actual <> 0 AND {SCALE.format(a='expected', b='actual')} THEN 'scale' ELSE 'residual' END AS triage FROM k)
SELECT *, CASE WHEN triage = 'residual' THEN 'IC_NOT_ELIMINATED,SCOPE' END AS causes FROM t""")
def check_disaggregation(t):
    confirm = t.spark.createDataFrame([("std_detail", "OCI", "STANDARD")], "edge_name string, confirm_context string, confirm_concept string")
    return C.check_disaggregation(X.best_fact(t.r_facts), X.sum_by_axis(t.r_facts), t.r_edges, t.r_members, confirm, {"std_detail": ["IC_NOT_ELIMINATED", "SCOPE"]})


@query("d9_ratio", f"""
WITH {BEST}, w AS (SELECT doc_id, period_key, max(amount) FILTER (concept_id = 'SMALL') AS r, max(amount) FILTER (concept_id = 'LARGE') AS n, max(amount) FILTER (concept_id = 'MEDIUM') AS d
  FROM best WHERE context = 'PNL' GROUP BY ALL)
SELECT doc_id, period_key, r AS actual, round(n / d, 6) AS ratio, CASE WHEN abs(r - n / d) <= 0.5 THEN 'ratio' WHEN abs(r - (n - d)) <= 100000 THEN 'difference' ELSE 'broken' END AS status
FROM w WHERE r IS NOT NULL AND n IS NOT NULL AND d IS NOT NULL AND d <> 0""")
def check_ratio(t):
    return C.check_ratio(X.best_fact(t.r_facts), "PNL", "SMALL", "LARGE", "MEDIUM", 0.5, 100_000)


@query("d10_scale_mismatch", """
WITH s AS (SELECT r.table_id, c.col_idx, any_value(p.value) AS p, sum(c.value) AS s
           FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id JOIN r_cells p ON p.row_id = r.parent_id AND p.col_idx = c.col_idx GROUP BY r.table_id, r.parent_id, c.col_idx),
f AS (SELECT table_id, col_idx, CASE WHEN p <> 0 AND s <> 0 THEN abs(p / s) END AS x FROM s)
SELECT t.doc_id, table_id, col_idx, CASE WHEN x BETWEEN 990 AND 1010 THEN 1000.0 WHEN x BETWEEN 990000 AND 1010000 THEN 1000000.0 WHEN x BETWEEN 0.00099 AND 0.00101 THEN 0.001
       WHEN x BETWEEN 0.00000099 AND 0.00000101 THEN 0.000001 END::DOUBLE AS factor
FROM f JOIN r_tables t USING (table_id) WHERE factor IS NOT NULL""")
def scale_mismatch(t):
    from ..operators.structure import parent_sums

    return parent_sums(t.r_tables, t.r_tree_cells).select("doc_id", "table_id", "col_idx", C.scale_mismatch(F.col("p"), F.col("s")).alias("factor")).where("factor is not null")


MISMATCH = """mm AS (SELECT doc_id, concept_id, period_key, count(DISTINCT table_id) AS n_tables, count(DISTINCT amount) AS n_amounts, min(amount) AS low, max(amount) AS high
  FROM r_facts GROUP BY doc_id, concept_id, period_key HAVING count(DISTINCT table_id) > 1 AND count(DISTINCT amount) > 1
  QUALIFY row_number() OVER (PARTITION BY doc_id, concept_id ORDER BY period_key) = 1)"""


@query("d11_concept_mismatches", f"WITH {MISMATCH} SELECT * FROM mm")
def concept_mismatches(t):
    return C.concept_mismatches(t.r_facts)


@query("d12_amount_collisions", """
SELECT doc_id, amount, count(DISTINCT table_id) AS n_tables, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS concepts, count(DISTINCT concept_id) AS n_concepts
FROM r_facts WHERE abs(amount) >= 100 GROUP BY ALL HAVING count(DISTINCT table_id) > 1 AND count(DISTINCT concept_id) > 1""")
def amount_collisions(t):
    return C.amount_collisions(t.r_facts)


SEEN = "SELECT DISTINCT doc_id, concept_id FROM r_facts WHERE context = 'OCI' AND doc_id % 2 = 0"


def seen(t):
    return t.r_facts.where("context = 'OCI' and doc_id % 2 = 0")


@query("d13_explain_mismatches", f"""
WITH {MISMATCH}, x AS (SELECT m.doc_id, m.concept_id, m.period_key, k.unit_type, k.note_unit_type, k.n_variants FROM mm m LEFT JOIN r_concepts k USING (concept_id) WHERE (doc_id, concept_id) NOT IN (SELECT (doc_id, concept_id) FROM ({SEEN})) AND coalesce(k.unit_type, '') NOT IN ('shares', 'per_share', 'percentage', 'dimensionless')),
a AS (SELECT x.*, f.amount, row_number() OVER (PARTITION BY x.doc_id, x.concept_id, x.period_key ORDER BY f.table_id, f.row_id, f.col_idx) AS i FROM x JOIN r_facts f USING (doc_id, concept_id, period_key)),
s AS (SELECT DISTINCT p.doc_id, p.concept_id FROM a p JOIN a q ON q.doc_id = p.doc_id AND q.concept_id = p.concept_id AND q.i > p.i WHERE p.amount <> 0 AND q.amount <> 0 AND (abs(p.amount / q.amount) > 990 AND abs(p.amount / q.amount) < 1010 OR abs(p.amount / q.amount) > 990000 AND abs(p.amount / q.amount) < 1010000)),
r AS (SELECT doc_id, concept_id, period_key, CASE WHEN any_value(note_unit_type) = 'shares' THEN 'SHARE_COUNT_VS_MONETARY' WHEN any_value(n_variants) > 0 THEN 'GROSS_VS_NET' WHEN bool_or((doc_id, concept_id) IN (SELECT (doc_id, concept_id) FROM s)) THEN 'UNIT_SCALE' END AS pattern_id, count(*)::INT AS n_facts FROM a GROUP BY 1, 2, 3)
SELECT * FROM r WHERE pattern_id IS NOT NULL""")
def explain_mismatches(t):
    return C.explain_mismatches(C.first_mismatches(t.r_facts), t.r_facts, t.r_concepts, seen(t))


COARSE = "cf AS (SELECT doc_id, table_id, CASE concept_id WHEN 'LARGE' THEN 'L' ELSE concept_id END AS concept_id, context, label, round(amount / 20000) * 20000 AS amount FROM r_facts)"


@query("d13_explain_collisions", f"""
WITH {COARSE}, c AS (SELECT doc_id, amount FROM cf WHERE abs(amount) >= 100 GROUP BY 1, 2 HAVING count(DISTINCT table_id) > 1 AND count(DISTINCT concept_id) > 1)
SELECT f.doc_id, f.amount, string_agg(DISTINCT f.concept_id, ',' ORDER BY f.concept_id) AS concepts, 'ASSOCIATE_OWN_FIGURES' AS pattern_id FROM cf f JOIN c ON c.doc_id = f.doc_id AND c.amount = f.amount LEFT JOIN ({SEEN}) s ON s.doc_id = f.doc_id AND s.concept_id = f.concept_id
GROUP BY 1, 2 HAVING bool_or(f.context = 'DISC.SEGMENTS') AND NOT bool_or(regexp_matches(lower(label), 'other|total|thereof|davon|summe|gesamt|sonstige')) AND count(s.doc_id) = 0""")
def explain_collisions(t):
    f = t.r_facts.withColumns({"amount": F.round(F.col("amount") / 20000) * 20000, "concept_id": F.when(F.col("concept_id") == "LARGE", "L").otherwise(F.col("concept_id"))})
    return C.explain_collisions(C.collided(f), f, seen(t), "DISC.SEGMENTS")


@query("d14_context_violations", f"""
WITH v AS (SELECT concept_id, valid_context AS context FROM r_concepts UNION SELECT 'SMALL', 'SFP' UNION SELECT 'TOTAL', 'SFP'), o AS (SELECT concept_id, list_sort(list(DISTINCT context)) AS own FROM v GROUP BY 1)
SELECT f.doc_id, f.concept_id, f.context, array_to_string(any_value(own), ',') AS valid_contexts, count(*) AS n_facts, min(table_id) AS first_table FROM r_facts f JOIN o USING (concept_id)
WHERE NOT list_contains(own, f.context) AND f.context NOT LIKE 'DISC.%' AND (f.doc_id, f.concept_id) NOT IN (SELECT (doc_id, concept_id) FROM ({SEEN})) GROUP BY 1, 2, 3""")
def context_violations(t):
    valid = t.r_concepts.select("concept_id", F.col("valid_context").alias("context")).unionByName(t.spark.createDataFrame([("SMALL", "SFP"), ("TOTAL", "SFP")], "concept_id string, context string"))
    return C.context_violations(t.r_facts, valid, seen(t))


@query("d41_period_changes", f"""
WITH {BEST}, b AS (SELECT *, lag(amount) OVER o AS before, lag(period_key) OVER o AS pb FROM best WINDOW o AS (PARTITION BY doc_id, context, concept_id ORDER BY period_key))
SELECT doc_id, context, concept_id, period_key, amount, before, floor(abs(amount - before) / greatest(abs(before), 1) * 100) / 100 AS change FROM b
WHERE substr(period_key, 2)::INT - substr(pb, 2)::INT = 1 AND abs(amount - before) / greatest(abs(before), 1) >= 2""")
def period_changes(t):
    return C.period_changes(X.best_fact(t.r_facts))


@query("d41_rule_violations", """
WITH rules AS (SELECT * FROM (VALUES ('pnl_positive', 'PNL', 'L%', '+'), ('oci_negative', 'OCI', '%O%', '-'), ('sfp_forbidden', 'SFP', 'PROMO', NULL)) v(rule, rule_context, pattern, sign))
SELECT doc_id, rule, concept_id, count(*) AS n_facts, round(min(amount), 2) AS low, round(max(amount), 2) AS high FROM r_facts f JOIN rules r ON r.rule_context = f.context AND concept_id LIKE pattern
WHERE CASE sign WHEN '+' THEN amount < 0 WHEN '-' THEN amount > 0 ELSE true END GROUP BY ALL""")
def rule_violations(t):
    rules = t.spark.createDataFrame([("pnl_positive", "PNL", "L%", "+"), ("oci_negative", "OCI", "%O%", "-"), ("sfp_forbidden", "SFP", "PROMO", None)], "rule string, rule_context string, pattern string, sign string")
    return C.rule_violations(t.r_facts, rules)


@query("d42_fact_uniqueness", "SELECT doc_id, context, concept_id, period_key, count(*) AS n FROM r_facts GROUP BY ALL HAVING count(*) > 1")
def fact_uniqueness(t):
    return C.fact_uniqueness(facts(t), ["doc_id", "context", "concept_id", "period_key"])


@query("d43_completeness_tier", """
WITH req AS (SELECT * FROM (VALUES (1, 'PNL', 'TOTAL'), (2, 'SFP', 'TOTAL'), (2, 'PNL', 'PROMO'), (3, 'OCI', 'TOTAL'), (3, 'SFP', 'LARGE')) v(tier, context, concept_id)),
g AS (SELECT d.doc_id, r.tier, bool_and(f.concept_id IS NOT NULL) AS ok, coalesce(string_agg(r.context || ':' || r.concept_id, ',' ORDER BY r.context || ':' || r.concept_id) FILTER (f.concept_id IS NULL), '') AS missing
  FROM (SELECT DISTINCT doc_id FROM r_facts) d CROSS JOIN req r LEFT JOIN (SELECT DISTINCT doc_id, context, concept_id FROM r_facts) f ON f.doc_id = d.doc_id AND f.context = r.context AND f.concept_id = r.concept_id GROUP BY ALL)
SELECT doc_id, coalesce(min(tier) FILTER (NOT ok) - 1, max(tier))::INT AS tier, coalesce(arg_min(missing, tier) FILTER (NOT ok), '') AS missing FROM g GROUP BY doc_id""")
def completeness_tier(t):
    return C.completeness_tier(t.r_facts, [(1, "PNL", "TOTAL"), (2, "SFP", "TOTAL"), (2, "PNL", "PROMO"), (3, "OCI", "TOTAL"), (3, "SFP", "LARGE")])


@query("d46_composite_residual", f"""
WITH {BEST}, b AS (SELECT doc_id, period_key, max(amount) FILTER (concept_id = 'TOTAL') AS line, sum(amount) FILTER (concept_id IN ('LARGE', 'SMALL')) AS known, count(*) FILTER (concept_id IN ('LARGE', 'SMALL')) AS n FROM best WHERE context = 'PNL' GROUP BY ALL)
SELECT doc_id, period_key, line, round(coalesce(known, 0), 2) AS known, round(line - coalesce(known, 0), 2) AS residual, n FROM b WHERE line IS NOT NULL""")
def composite_residual(t):
    return C.composite_residual(X.best_fact(t.r_facts), "PNL", "TOTAL", ["LARGE", "SMALL"])


@query("d53_provenance_type", """
WITH f AS (SELECT doc_id, is_primary, label, CASE WHEN table_id % 11 = 0 THEN 'MANAGEMENT_REPORT' WHEN table_id % 11 = 1 AND NOT is_primary THEN 'DISC.ASSOCIATES' WHEN table_id % 11 < 4 AND NOT is_primary THEN 'DISC.PPE' ELSE context END AS context, CASE WHEN row_id % 13 = 0 THEN 'KPI.EBIT' ELSE concept_id END AS concept_id,
             CASE WHEN row_id % 4 = 0 THEN 'Konsolidierung' ELSE label END AS l2 FROM r_facts),
k AS (SELECT doc_id, CASE WHEN context = 'MANAGEMENT_REPORT' THEN context WHEN regexp_matches(concept_id, '^(KPI|APM)[.]') THEN 'DERIVED_METRIC' WHEN is_primary THEN 'FACE_STATEMENT' WHEN context LIKE 'DISC.ASSOC%' THEN 'ASSOCIATE_OWN' WHEN regexp_matches(lower(l2), 'elimination|unallocated|reconcil|überleitung|konsolidierung') THEN 'RECONCILING_ITEM'
  WHEN context = 'DISC.SEGMENTS' THEN 'SEGMENT_COMPONENT' WHEN concept_id = 'TOTAL' THEN 'NOTE_TOTAL' ELSE 'NOTE_DETAIL' END AS provenance FROM f)
SELECT doc_id, provenance, count(*) AS n_facts, provenance IN ('FACE_STATEMENT', 'NOTE_TOTAL', 'SEGMENT_COMPONENT', 'RECONCILING_ITEM') AS comparable FROM k GROUP BY 1, 2""")
def provenance_type(t):
    k = F.col("table_id") % 11
    f = t.r_facts.withColumns({
        "context": F.when(k == 0, "MANAGEMENT_REPORT").when((k == 1) & ~F.col("is_primary"), "DISC.ASSOCIATES").when((k < 4) & ~F.col("is_primary"), "DISC.PPE").otherwise(F.col("context")),
        "concept_id": F.when(F.col("row_id") % 13 == 0, "KPI.EBIT").otherwise(F.col("concept_id")), "label": F.when(F.col("row_id") % 4 == 0, "Konsolidierung").otherwise(F.col("label")),
    })
    return C.provenance_type(f)
