"""Queries on roll-ups, votes, gates and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as R
from ..operators import structure as S
from ..operators.tagging import shared_path
from ..sources.snapshots import Snapshot, replaced
from .registry import query
from .timelines import RSEC, report_sections

CONS = """v AS (SELECT *, CASE source WHEN 'human' THEN 3 WHEN 'mlp' THEN 2 ELSE 1 END AS w FROM v_votes WHERE action IN ('tag', 'dissent')),
p AS (SELECT dimension, target_id, value, sum(w) AS weight, count(*) AS n, max(ts) AS latest FROM v WHERE action = 'tag' GROUP BY ALL),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dimension, target_id ORDER BY weight DESC, n DESC, latest DESC, value DESC) = 1),
s AS (SELECT dimension, target_id, count(*) FILTER (action = 'dissent') AS dissent, count(DISTINCT voter) AS voters, count(*) AS votes FROM v GROUP BY ALL),
cons AS (SELECT dimension, target_id, value, weight::BIGINT AS weight, n AS agree, dissent, voters, round(n / votes, 4) AS confidence FROM b JOIN s USING (dimension, target_id))"""


@query("d29_consensus", f"WITH {CONS} SELECT * FROM cons")
def consensus(t):
    return R.consensus(t.v_votes)


@query("d30_vote_conflicts", f"WITH {CONS} SELECT * FROM cons WHERE dimension = 'row_concept' AND dissent > 0")
def vote_conflicts(t):
    return R.vote_conflicts(R.consensus(t.v_votes), "row_concept")


@query("d31_document_stats", """
SELECT t.doc_id, n_tables, coalesce(n_rows, 0) AS n_rows, coalesce(n_tagged, 0) AS n_tagged, coalesce(n_concepts, 0) AS n_concepts
FROM (SELECT doc_id, count(*) AS n_tables FROM r_tables GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(*) AS n_rows, count(tag) AS n_tagged, count(DISTINCT tag) AS n_concepts FROM r_rows GROUP BY 1) r USING (doc_id)""")
def document_stats(t):
    return R.document_stats(t.r_tables, t.r_rows)


@query("d36_tag_coverage", "SELECT r.doc_id, count(*) AS n_rows, count(tag) AS n_tagged, round(count(tag) / count(*), 4) AS coverage FROM r_rows r JOIN r_tables t USING (table_id) WHERE t.context IS NOT NULL AND r.row_id IN (SELECT row_id FROM r_cells WHERE value IS NOT NULL) GROUP BY r.doc_id")
def tag_coverage(t):
    return R.tag_coverage(t.r_tables, t.r_rows, t.r_cells)


PROFILE = """prof AS (SELECT t.doc_id, n_tables, n_unclassified, n_rows, n_data, n_tagged, concepts, coalesce(n_facts, 0) AS n_facts, coalesce(n_primary, 0) AS n_primary
FROM (SELECT doc_id, count(*) AS n_tables, count(*) FILTER (context IS NULL) AS n_unclassified FROM r_tables GROUP BY 1) t
LEFT JOIN (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (row_type = 'DATA') AS n_data, count(tag) AS n_tagged, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS concepts FROM r_rows GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_facts, count(*) FILTER (is_primary) AS n_primary FROM r_facts GROUP BY 1) f USING (doc_id))"""


@query("d18_document_profile", f"WITH {PROFILE} SELECT * FROM prof")
def document_profile(t):
    return R.document_profile(t.r_tables, t.r_rows, t.r_facts)


@query("d19_corpus_summary", f"""
WITH {PROFILE} SELECT gaap, grouping(gaap)::INT AS is_total, count(*) AS n_documents, sum(n_tables)::BIGINT AS n_tables, sum(n_rows)::BIGINT AS n_rows, sum(n_tagged)::BIGINT AS n_tagged, sum(n_facts)::BIGINT AS n_facts
FROM prof JOIN r_documents USING (doc_id) GROUP BY ROLLUP (gaap)""")
def corpus_summary(t):
    return R.corpus_summary(R.document_profile(t.r_tables, t.r_rows, t.r_facts).join(t.r_documents.select("doc_id", "gaap"), "doc_id"), "gaap")


@query("d20_corpus_comparison", f"""
WITH {PROFILE}, m AS (SELECT doc_id, unnest(['n_tables', 'n_unclassified', 'n_rows', 'n_data', 'n_tagged', 'n_facts', 'n_primary']) AS metric, unnest([n_tables, n_unclassified, coalesce(n_rows, 0), coalesce(n_data, 0), coalesce(n_tagged, 0), n_facts, n_primary])::BIGINT AS value FROM prof)
SELECT doc_id, metric, value, round(avg(value) OVER (PARTITION BY metric), 4) AS mean FROM m""")
def corpus_comparison(t):
    return R.corpus_comparison(R.document_profile(t.r_tables, t.r_rows, t.r_facts))


@query("d19_corpus_status", """
WITH r AS (SELECT doc_id, CASE WHEN n_pages < 14 THEN 'error' WHEN n_pages < 20 THEN 'halted' ELSE 'completed' END AS status, CASE WHEN n_pages >= 14 AND n_pages < 20 THEN 'stage' || (n_pages % 3) END AS halted_at FROM r_documents)
SELECT status, halted_at, count(*) AS n_documents, min(doc_id) AS first_document FROM r GROUP BY 1, 2""")
def corpus_status(t):
    status = F.when(F.col("n_pages") < 14, "error").when(F.col("n_pages") < 20, "halted").otherwise("completed")
    return R.corpus_status(t.r_documents.select("doc_id", status.alias("status"), F.when(status == "halted", F.concat(F.lit("stage"), (F.col("n_pages") % 3).cast("string"))).alias("halted_at")))


@query("d22_keyword_argmax", """
WITH s AS (SELECT doc_id, (contains(x, 'the')::INT + contains(x, 'tion')::INT + contains(x, 'with')::INT) AS a, (contains(x, 'der')::INT + contains(x, 'und')::INT + contains(x, 'keit')::INT) AS b, (contains(x, 'que')::INT + contains(x, 'eau')::INT + contains(x, 'les')::INT) AS c
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents))
SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 THEN 'none' WHEN a >= b AND a >= c THEN 'english' WHEN b >= c THEN 'german' ELSE 'french' END AS cls, greatest(a, b, c) AS hits FROM s""")
def keyword_argmax(t):
    return R.keyword_argmax(t.documents, {"english": ["the", "tion", "with"], "german": ["der", "und", "keit"], "french": ["que", "eau", "les"]}, 2, "none")


@query("d22_framework", """
WITH t AS (SELECT doc_id, table_id, table_ord FROM r_tables WHERE table_ord <= 3), x AS (SELECT doc_id, lower(string_agg(x, ' ' ORDER BY table_ord, src, o, x)) AS x FROM (
  SELECT doc_id, table_ord, 0 AS src, col_idx AS o, header AS x FROM r_columns JOIN t USING (doc_id, table_id) WHERE header IS NOT NULL UNION ALL SELECT r.doc_id, table_ord, 1, row_idx, label FROM r_rows r JOIN t USING (table_id) WHERE row_idx < 4) GROUP BY 1),
s AS (SELECT doc_id, (contains(x, 'hot rod')::INT + contains(x, 'gear')::INT + contains(x, '1996')::INT) AS a, (contains(x, 'cold')::INT + contains(x, 'plate')::INT) AS b FROM x)
SELECT s.doc_id, CASE WHEN regexp_matches(lower(entity), '7$') THEN 'UGB' WHEN greatest(a, b) < 2 THEN 'none' WHEN a >= b THEN 'IFRS' ELSE 'UGB' END AS cls, greatest(a, b) AS hits FROM s JOIN r_documents d ON d.doc_id = s.doc_id""")
def framework(t):
    texts = R.window_texts(t.r_tables, t.r_rows, t.r_columns, 3, 4).join(t.r_documents.select("doc_id", F.col("entity").alias("name")), "doc_id")
    return R.keyword_argmax(texts, {"IFRS": ["hot rod", "gear", "1996"], "UGB": ["cold", "plate"]}, 2, "none", {"7$": "UGB"})


@query("d23_modal_unit", """
WITH n AS (SELECT doc_id, unit, count(*) AS n, min(table_ord) AS f FROM r_tables WHERE unit IS NOT NULL GROUP BY 1, 2), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)
SELECT d.doc_id, coalesce(b.unit, 'EUR') AS unit FROM (SELECT DISTINCT doc_id FROM r_tables) d LEFT JOIN b USING (doc_id)""")
def modal_unit(t):
    return R.modal_currency_unit(t.r_tables)


@query("d24_period_dim", """
SELECT doc_id, replace(period_axis, 'PERIOD.', '') AS period_key, arg_min(header, (table_id, col_idx)) AS label, try_cast(nullif(regexp_extract(arg_min(header, (table_id, col_idx)), '(20[0-9]{2})', 1), '') AS INT) AS year
FROM r_columns WHERE period_axis IS NOT NULL GROUP BY doc_id, period_axis""")
def period_dim(t):
    return R.period_dim(t.r_columns)


@query("d32_element_browse", f"""
WITH {RSEC}, u AS (SELECT doc_id, section_type AS element, unnest(range(start_page, end_page + 1))::INT AS page, 'section' AS src FROM rs UNION ALL SELECT doc_id, context, page_no, 'table' FROM r_tables WHERE context IS NOT NULL)
SELECT doc_id, element, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(DISTINCT page)::INT AS n_pages, string_agg(DISTINCT src, '+' ORDER BY src) AS source FROM u GROUP BY 1, 2""")
def element_browse(t):
    return R.element_browse(report_sections(t), t.r_tables)


@query("d33_review_dashboard", """
WITH t AS (SELECT *, CASE table_id % 4 WHEN 0 THEN 'toc' WHEN 1 THEN 'keywords' ELSE 'existing' END AS method FROM (SELECT doc_id, table_id, page_no, CASE WHEN table_id % 9 = 0 THEN 'TOC' ELSE context END AS context FROM r_tables)),
m AS (SELECT doc_id, string_agg(method || '=' || n, ',' ORDER BY method || '=' || n) AS methods FROM (SELECT doc_id, method, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n_note_refs FROM l_labels WHERE contains(lower(raw), 'note ') GROUP BY 1)
SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_tables, count(*) FILTER (context IN ('PNL', 'SFP', 'OCI', 'CFS', 'SOCIE')) AS n_primary, count(*) FILTER (context LIKE 'DISC.%') AS n_disclosure,
       count(*) FILTER (context IS NULL) AS n_unclassified, count(*) FILTER (context = 'TOC') AS n_toc, any_value(methods) AS methods, coalesce(any_value(n_note_refs), 0) AS n_note_refs FROM t JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def review_dashboard(t):
    k = F.col("table_id") % 4
    tables = t.r_tables.select("doc_id", "table_id", "page_no", F.when(F.col("table_id") % 9 == 0, "TOC").otherwise(F.col("context")).alias("context"), F.when(k == 0, "toc").when(k == 1, "keywords").otherwise("existing").alias("method"))
    return R.review_dashboard(tables, t.l_labels.where(F.contains(F.lower("raw"), F.lit("note "))))


LIMITS = {"tables": 1.0, "statements": 1.0, "parse": 0.6, "arithmetic": 0.9, "tags": 0.7}


@query("d47_gates", """
WITH ar AS (SELECT r.doc_id, abs(any_value(p.value) - sum(c.value)) <= greatest(0.5, 0.001 * abs(any_value(p.value))) AS ok FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id JOIN r_cells p ON p.row_id = r.parent_id AND p.col_idx = c.col_idx
  WHERE c.value IS NOT NULL AND p.value IS NOT NULL GROUP BY r.doc_id, r.table_id, r.parent_id, c.col_idx),
k AS (SELECT doc_id, context, count(*) AS n FROM r_tables GROUP BY 1, 2),
d AS (SELECT t.doc_id, t.tables, t.statements, t.max_per_type, t.doc_id % 10 = 0 AS overridden, coalesce(p.parse, 0) AS parse, coalesce(a.arithmetic, 0) AS arithmetic, coalesce(g.tags, 0) AS tags
  FROM (SELECT doc_id, sum(n)::DOUBLE AS tables, (count(*) FILTER (context IN ('PNL', 'SFP', 'OCI')))::DOUBLE AS statements, coalesce(max(n) FILTER (context IN ('PNL', 'SFP', 'OCI')), 0) AS max_per_type FROM k GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(value) / count(*) AS parse FROM r_cells JOIN r_tables USING (table_id) GROUP BY 1) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, avg(ok::INT) AS arithmetic FROM ar GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(tag) / count(*) AS tags FROM r_rows GROUP BY 1) g USING (doc_id)),
e AS (SELECT *, (statements < 1 OR max_per_type > 3) AND NOT overridden AS bad FROM d)
SELECT doc_id, max_per_type, overridden, round(tables, 4) AS tables, round(statements, 4) AS statements, round(parse, 4) AS parse, round(arithmetic, 4) AS arithmetic, round(tags, 4) AS tags,
  CASE WHEN tables < 1 THEN 'tables' WHEN bad THEN 'statements' WHEN parse < 0.6 THEN 'parse' WHEN arithmetic < 0.9 THEN 'arithmetic' WHEN tags < 0.7 THEN 'tags' END AS first_failing,
  (tables < 1)::INT + bad::INT + (parse < 0.6)::INT + (arithmetic < 0.9)::INT + (tags < 0.7)::INT AS n_failed FROM e""")
def gates(t):
    return R.gates(t.r_tables, t.r_cells, S.table_arithmetic(t.r_tables, t.r_tree_cells), t.r_rows, LIMITS, 3, t.r_documents.where("doc_id % 10 = 0"))


@query("d39_summary", """
WITH p AS (SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS g FROM orders),
c AS (SELECT cls, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (SELECT y AS cls, 1 AS s, 0 AS p, (y = g)::INT AS h FROM p UNION ALL SELECT g, 0, 1, 0 FROM p) GROUP BY cls),
f AS (SELECT round(coalesce(2 * hits / nullif(predicted + support, 0), 0), 4) AS f1 FROM c WHERE support > 0)
SELECT (SELECT round(avg((y = g)::INT), 4) FROM p) AS accuracy, (SELECT count(*) FILTER (y <> g) FROM p) AS errors, (SELECT count(*) FROM p) AS n, (SELECT round(avg(f1), 4) FROM f) AS macro_f1, (SELECT count(*) FROM f) AS n_classes""")
def metrics_summary(t):
    return R.metrics_summary(predictions(t), "y", "g")


@query("d39_error_pairs", """
SELECT o_orderpriority AS label, g AS predicted, count(*) AS n FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS g FROM orders) WHERE o_orderpriority <> g GROUP BY 1, 2 ORDER BY n DESC, label, predicted LIMIT 5""")
def error_pairs(t):
    return R.error_pairs(predictions(t), "y", "g")


@query("d39_classification_metrics", """
WITH p AS (SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS g FROM orders),
c AS (SELECT cls, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (SELECT y AS cls, 1 AS s, 0 AS p, (y = g)::INT AS h FROM p UNION ALL SELECT g, 0, 1, 0 FROM p) GROUP BY cls),
r AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM c)
SELECT cls, support::BIGINT AS support, predicted::BIGINT AS predicted, hits::BIGINT AS hits, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1 FROM r""")
def classification_metrics(t):
    return R.classification_metrics(predictions(t), "y", "g")


def predictions(t):
    return t.orders.select(F.col("o_orderpriority").alias("y"), F.when(F.col("o_orderkey") % 5 == 0, "1-URGENT").when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("g"))


@query("d39_confusion", "SELECT o_orderpriority AS label, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS predicted, count(*) AS n FROM orders GROUP BY 1, 2")
def confusion(t):
    return R.confusion(predictions(t), "y", "g")


@query("f1_top_k_counts", "SELECT label, count(*) AS n, min(row_id) AS first FROM r_rows GROUP BY label ORDER BY n DESC, first LIMIT 10")
def top_k_counts(t):
    return R.top_k_counts(t.r_rows, "label", "row_id", 10)


@query("f2_latest_actions", "SELECT * FROM v_log ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 40")
def latest_actions(t):
    return R.latest(t.v_log, "ts", "event_id", 200, 40)


@query("a11_deep_page", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER () AS total FROM v_log)
SELECT * EXCLUDE (nth, total) FROM n WHERE nth > total // 2 AND nth <= total // 2 + 200""")
def deep_page(t):
    pages = R.Pages(t.v_log, "ts", "event_id", 16)
    return pages.page(200, sum(n for _, n in pages.sizes) // 2)


@query("g1_cumulative_tiers", """
WITH u AS (SELECT doc_id, 0 AS src, n_pages AS ord FROM r_documents WHERE gaap = 'UGB' AND doc_id % 10 = 0 UNION ALL SELECT doc_id, 1, n_pages FROM r_documents),
m AS (SELECT doc_id, min((src, ord)) AS o, min(src) AS src FROM u GROUP BY doc_id) SELECT doc_id, src FROM m ORDER BY o, doc_id LIMIT 150""")
def cumulative_tiers(t):
    d = t.r_documents.withColumnRenamed("n_pages", "ord")
    return R.cumulative_tiers(d.where("gaap = 'UGB' and doc_id % 10 = 0"), d, 150)


@query("g2_in_all_documents", "WITH f AS (SELECT DISTINCT table_id % 3 AS doc_id, concept_id FROM r_facts) SELECT concept_id, count(*) AS n_docs FROM f GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT doc_id) FROM f)")
def in_all_documents(t):
    return R.in_all_documents(t.r_facts.select((F.col("table_id") % 3).alias("doc_id"), "concept_id").distinct())


@query("g3_exact_membership", "SELECT * FROM (SELECT c_nationkey AS set_id, c_custkey AS doc_id FROM customer WHERE c_nationkey <> 4) UNION ALL SELECT 4, c_custkey FROM customer WHERE c_custkey % 11 = 0")
def exact_membership(t):
    base = t.customer.select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("doc_id"))
    return merged(t, base, t.customer.where("c_custkey % 11 = 0").select(F.lit(4).cast("int").alias("set_id"), F.col("c_custkey").alias("doc_id")), "set_id")


@query("a10_upsert_snapshot", """
WITH delta AS (SELECT target_id AS doc_id, value AS entity, event_id FROM v_votes WHERE event_id % 2 = 0), n AS (SELECT doc_id, arg_max(entity, event_id) AS entity FROM delta GROUP BY doc_id)
SELECT doc_id, entity FROM r_documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, entity FROM n""")
def upsert_snapshot(t):
    delta = t.v_votes.where("event_id % 2 = 0").select(F.col("target_id").alias("doc_id"), F.col("value").alias("entity"), "event_id")
    return merged(t, t.r_documents.select("doc_id", "entity"), R.newest(delta, ["doc_id"], "event_id"), "doc_id")


def merged(t, base, changes, key):
    """base as a snapshot, and what an update makes of the buckets that it touches."""
    s = Snapshot(t.spark, shared_path(t.spark, "snapshot"), base.schema, [key], 16)
    s.update(base, lambda _, new: new)
    s.update(changes, lambda rows, new: replaced(rows, new, key))
    return s.read()


@query("a12_pending_work", """
WITH p AS (SELECT doc_id, n_pages FROM r_documents WHERE n_pages <= 40 AND doc_id NOT IN (SELECT doc_id FROM r_tables WHERE page_no > 20))
SELECT doc_id, n_pages, ((row_number() OVER (ORDER BY n_pages, doc_id) - 1) % 4)::INT AS shard FROM p""")
def pending_work(t):
    done = t.r_tables.groupBy("doc_id").agg((F.max("page_no") > 20).alias("complete"))
    return R.pending_work(t.r_documents.select("doc_id", "n_pages"), done, "doc_id", 4, "n_pages", 40)


@query("a13_replace_sections", f"""
WITH {RSEC}, n AS (SELECT doc_id, 'OCI' AS section_type, 1::BIGINT AS start_page, 2::BIGINT AS end_page FROM r_documents WHERE doc_id % 6 = 0) SELECT * FROM rs WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def replace_sections(t):
    new = t.r_documents.where("doc_id % 6 = 0").select("doc_id", F.lit("OCI").alias("section_type"), F.lit(1).cast("long").alias("start_page"), F.lit(2).cast("long").alias("end_page"))
    return merged(t, report_sections(t), new, "doc_id")


MAPPING = [("LARGE", 1995, "S1", 100, True), ("MEDIUM", 1995, "S1", 100, True), ("SMALL", 1996, "S2", 60, True), ("SMALL", 1996, "S3", 40, True), ("SMALL", 1998, "S4", 100, True), ("LARGE", 1999, "S9", 100, False), ("MEDIUM", 2000, "S2", 60, True), ("MEDIUM", 2000, "S5", 40, True)]


@query("d44_segment_mapping", f"""
WITH m AS (SELECT * FROM (VALUES {", ".join(str(x) for x in MAPPING)}) v(concept_id, year, segment, pct, confirmed) WHERE confirmed), f AS (SELECT *, substr(period_key, 2)::INT AS year FROM r_facts),
a AS (SELECT f.*, (SELECT max(m.year) FROM m WHERE m.concept_id = f.concept_id AND m.year <= f.year) AS since FROM f),
o AS (SELECT a.doc_id, a.period_key, m.segment, round(sum(amount * pct / 100), 2) AS amount, count(*) AS n_facts, bool_or(a.since < a.year) AS carried FROM a JOIN m ON m.concept_id = a.concept_id AND m.year = a.since GROUP BY 1, 2, 3)
SELECT *, count(*) OVER (PARTITION BY period_key, segment) AS n_docs, count(*) OVER (PARTITION BY period_key, segment) >= 2 AS comparable FROM o""")
def segment_mapping(t):
    return R.segment_mapping(t.r_facts, t.spark.createDataFrame(MAPPING, "concept_id string, year int, segment string, pct int, confirmed boolean"))


@query("d45_map_trial_balance", """
WITH b AS (SELECT DISTINCT p_type AS account, CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'size' ELSE 'class' END AS cls FROM part),
a AS (SELECT account, cls, 'K.' || substr(account, 1, 1) AS concept_id, CASE WHEN account = 'PROMO' THEN 70 ELSE 100 END AS pct, account = 'ECONOMY' AS ic FROM b UNION ALL SELECT account, cls, 'K.IC', 30, true FROM b WHERE account = 'PROMO')
SELECT cls, concept_id, round(sum(s_acctbal * pct / 100), 2) AS balance, round(coalesce(sum(s_acctbal * pct / 100) FILTER (ic), 0), 2) AS intercompany, count(*) AS n_accounts, grouping_id(cls, concept_id)::INT AS level
FROM (SELECT p.p_type AS account, l.v2 AS s_acctbal FROM r_lines l JOIN part p ON p.p_partkey = l.part) JOIN a USING (account) GROUP BY ROLLUP (cls, concept_id)""")
def map_trial_balance(t):
    ledger = t.r_lines.join(t.part, F.col("part") == F.col("p_partkey")).select(F.col("p_type").alias("account"), F.col("v2").alias("balance"))
    a = t.part.select(F.col("p_type").alias("account"), F.when(F.col("p_type").isin("LARGE", "SMALL"), "size").otherwise("class").alias("cls")).distinct()
    own = a.select("account", "cls", F.concat(F.lit("K."), F.substring("account", 1, 1)).alias("concept_id"), F.when(F.col("account") == "PROMO", 70).otherwise(100).alias("pct"), (F.col("account") == "ECONOMY").alias("ic"))
    more = a.where("account = 'PROMO'").select("account", "cls", F.lit("K.IC").alias("concept_id"), F.lit(30).alias("pct"), F.lit(True).alias("ic"))
    return R.map_trial_balance(ledger, own.unionByName(more))


@query("d52_run_progress", """
WITH runs AS (SELECT n_nationkey AS run_id, n_nationkey * 4 AS n_configured FROM nation), res AS (SELECT c_nationkey AS run_id, c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN 'error' ELSE 'ok' END AS status FROM customer WHERE c_nationkey <> 3),
r AS (SELECT run_id, count(DISTINCT doc_id) AS n_seen, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error FROM res GROUP BY 1)
SELECT run_id, n_configured, coalesce(n_seen, 0) AS n_seen, coalesce(n_ok, 0) AS n_ok, coalesce(n_error, 0) AS n_error, CASE WHEN coalesce(n_seen, 0) >= n_configured THEN 'completed' WHEN n_seen > 0 THEN 'running' ELSE 'pending' END AS state FROM runs LEFT JOIN r USING (run_id)""")
def run_progress(t):
    runs = t.nation.select(F.col("n_nationkey").alias("run_id"), (F.col("n_nationkey") * 4).alias("n_configured"))
    res = t.customer.where("c_nationkey <> 3").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 9 == 0, "error").otherwise("ok").alias("status"))
    return R.run_progress(runs, res)


@query("k3_adaptive_buckets", """
WITH b AS (SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS bucket, count(*) AS n FROM events GROUP BY 1), lim AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b)
SELECT s AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(lo, hi + 1, 86400)) AS s FROM lim) LEFT JOIN b ON b.bucket = s""")
def adaptive_buckets(t):
    return R.adaptive_buckets(t.events)


@query("k3_buckets_by_action", """
WITH b AS (SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2), lim AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b)
SELECT s.s AS bucket, k.event_type, coalesce(n, 0) AS n FROM (SELECT unnest(range(lo, hi + 1, 86400)) AS s FROM lim) s CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN b ON b.bucket = s.s AND b.event_type = k.event_type""")
def buckets_by_action(t):
    return R.adaptive_buckets(t.events, by="event_type")


@query("k3_equal_chunks", """
WITH e AS (SELECT event_id, epoch(date_trunc('hour', ts))::BIGINT // 86400 % 3 * 60 AS s FROM events), n AS (SELECT s, row_number() OVER (ORDER BY s, event_id) - 1 AS p FROM e)
SELECT min(s) AS bucket, count(*) AS n FROM n GROUP BY p // (SELECT ceil(count(*) / 20)::BIGINT FROM e)""")
def equal_chunks(t):
    few = t.events.select("event_id", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 86400) % 3 * 60).alias("ts"))  # three minutes: too few for bins of time
    return R.adaptive_buckets(few)
