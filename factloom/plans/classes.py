"""Queries on classification and the rest of the blueprint."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import facts as X
from ..operators import labels as O
from ..operators import tagging as A
from ..operators import timelines as T
from ..sources.reports import pack_table_graphs, read_packed_graphs, shred_table_graphs
from . import dealt
from .arithmetic import ADDITIVE
from .checks import BEST
from .labels import NORM, PRETAG, TOPIC, UNTAG
from .registry import query
from .reviews import NOTES, REFS, notes, refs
from .timelines import RSEC, report_sections

RULES = [("plate.*gear|gear.*plate", "PNL"), ("^total (hot|cold)", "OCI"), ("rod", "SFP"), ("wheel|bolt", "CFS")]
RULE_SQL = "CASE WHEN regexp_matches(text, 'plate.*gear|gear.*plate') THEN 'PNL' WHEN regexp_matches(text, '^total (hot|cold)') THEN 'OCI' WHEN regexp_matches(text, 'rod') THEN 'SFP' WHEN regexp_matches(text, 'wheel|bolt') THEN 'CFS' END"
TEXT = "tx AS (SELECT table_id, string_agg(lower(label), ' ' ORDER BY row_idx) AS text FROM r_rows GROUP BY 1)"


def texts(t):
    return t.r_rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.lower("label").alias("l")))), lambda x: x["l"]), " ").alias("text"))


@query("i8b_keyword_rules", f"WITH {TEXT} SELECT table_id, {RULE_SQL} AS context FROM tx")
def keyword_rules(t):
    return texts(t).select("table_id", C.keyword_rules(F.col("text"), RULES).alias("context"))


WORDED = """wd AS (SELECT table_id, row_idx, CASE (table_id * 7 + row_idx) % 23 WHEN 0 THEN 'Revenue from sales' WHEN 1 THEN 'Total assets' WHEN 2 THEN 'Cash flow from operating activities' WHEN 3 THEN 'Latente Steuern' WHEN 4 THEN 'Goodwill and brands' WHEN 5 THEN 'Lease liabilities' WHEN 6 THEN 'Löhne' WHEN 7 THEN 'Bank loans'
  WHEN 8 THEN 'Sonstiges Ergebnis' WHEN 9 THEN 'Ergebnis je Aktie' WHEN 10 THEN 'Level 2' WHEN 11 THEN 'Rückstellungen für Prozesse' ELSE label END AS label FROM r_rows WHERE table_id % 3 > 0 OR row_idx = 0),
hd AS (SELECT table_id, col_idx, CASE WHEN table_id % 9 = 1 AND col_idx = 2 THEN 'Segment A' WHEN table_id % 9 = 4 AND col_idx = 1 THEN 'Carrying amount' WHEN table_id % 9 = 4 AND col_idx = 2 THEN 'Fair value' ELSE header END AS header FROM r_columns)"""


def worded(t):
    words = ["Revenue from sales", "Total assets", "Cash flow from operating activities", "Latente Steuern", "Goodwill and brands", "Lease liabilities", "Löhne", "Bank loans", "Sonstiges Ergebnis", "Ergebnis je Aktie", "Level 2", "Rückstellungen für Prozesse"]
    k, n = (F.col("table_id") * 7 + F.col("row_idx")) % 23, F.col("table_id") % 9
    label = F.coalesce(F.get(F.array(*map(F.lit, words)), k.cast("int")), F.col("label"))
    rows = t.r_rows.where("table_id % 3 > 0 or row_idx = 0").select("table_id", "row_idx", label.alias("label"))
    header = F.when((n == 1) & (F.col("col_idx") == 2), "Segment A").when((n == 4) & (F.col("col_idx") == 1), "Carrying amount").when((n == 4) & (F.col("col_idx") == 2), "Fair value").otherwise(F.col("header"))
    return C.table_texts(rows, t.r_columns.select("table_id", "col_idx", header.alias("header")), t.r_cells.where("table_id % 5 > 0"))


@query("i8b_keyword_blocks", f"""
WITH {WORDED}, l AS (SELECT table_id, list(lower(label) ORDER BY row_idx) AS l FROM wd GROUP BY 1), h AS (SELECT table_id, string_agg(lower(header), ' ' ORDER BY col_idx) AS headers FROM hd WHERE header IS NOT NULL GROUP BY 1),
x AS (SELECT table_id, array_to_string(l[1:10], ' ') AS first10, array_to_string(l, ' ') AS "all", l[1] AS first, coalesce(headers, '') AS headers, table_id IN (SELECT table_id FROM r_cells WHERE value IS NOT NULL AND table_id % 5 > 0) AS has_values FROM l LEFT JOIN h USING (table_id))
SELECT table_id, CASE {" ".join(f"WHEN regexp_matches({chr(34)}{f}{chr(34)}, '{p}'){'' if b == 1 else ' AND has_values'} THEN '{c}'" for b, f, p, c in C.RULES)} END AS context FROM x""")
def keyword_blocks(t):
    return C.keyword_blocks(worded(t))


HEADINGS = {"PNL": "Consolidated income statement", "SFP": "Notes balance sheet", "OCI": "Statement of comprehensive income, profit or loss"}


@query("i8_classify_tables", f"""
WITH {REFS} {NOTES}, {TEXT}, {RSEC}, se AS (SELECT t.table_id, arg_min(section_type, start_page) AS c FROM r_tables t JOIN rs ON rs.doc_id = t.doc_id AND t.page_no BETWEEN start_page AND end_page GROUP BY 1), toc AS (SELECT * FROM se WHERE table_id % 3 = 0 AND c <> 'NOTES'),
vt AS (SELECT r.table_id, n.context, count(*) AS votes FROM en r JOIN notes n USING (doc_id, note_number) WHERE n.context IS NOT NULL GROUP BY 1, 2), vw AS (SELECT *, sum(votes) OVER (PARTITION BY table_id) AS total, row_number() OVER (PARTITION BY table_id ORDER BY votes DESC, context DESC) AS k FROM vt),
j AS (SELECT t.doc_id, t.table_id, t.context, toc.c AS a, vw.context AS b, CASE WHEN se.c IN ('PNL', 'SFP', 'OCI') THEN se.c END AS d, {RULE_SQL} AS e FROM r_tables t LEFT JOIN toc USING (table_id) LEFT JOIN se ON se.table_id = t.table_id
  LEFT JOIN vw ON vw.table_id = t.table_id AND k = 1 AND votes >= 2 AND votes >= 0.5 * total LEFT JOIN tx ON tx.table_id = t.table_id)
SELECT doc_id, table_id, coalesce(context, a, b, d, e) AS context, CASE WHEN context IS NOT NULL THEN 'existing' WHEN a IS NOT NULL THEN 'toc' WHEN b IS NOT NULL THEN 'notes' WHEN d IS NOT NULL THEN 'path' WHEN e IS NOT NULL THEN 'keywords' ELSE 'unclassified' END AS method,
  CASE WHEN context IS NOT NULL OR a IS NOT NULL THEN 'high' WHEN coalesce(b, d, e) IS NULL THEN 'none' ELSE 'medium' END AS confidence FROM j""")
def classify_tables(t):
    """Classes from a contents list (C5), votes of notes (C7), headings of sections (B14) and keywords, each from the operator that makes it."""
    from ..functions.labels import infer_table_context
    from ..operators.reviews import classify_by_note_votes

    sections = T.interval_join(t.r_tables.select("doc_id", "table_id", F.col("page_no").alias("page")), report_sections(t)).select("table_id", "section_type")
    toc = sections.where("table_id % 3 = 0 and section_type <> 'NOTES'").select("table_id", F.col("section_type").alias("context"))  # every third table's pages are listed
    votes = classify_by_note_votes(refs(t).select("doc_id", "table_id", "note_number"), notes(t)).select("table_id", "context")
    heading = F.lit(None).cast("string")
    for kind, text in HEADINGS.items():
        heading = F.when(F.col("section_type") == kind, text).otherwise(heading)
    paths = sections.select("table_id", infer_table_context(F.lit(None).cast("string"), heading).alias("context")).where("context is not null")
    return C.classify_tables(t.r_tables, toc, votes, paths, texts(t), RULES)


@query("d16_classification_checks", """
WITH c AS (SELECT table_id, count(*) FILTER (lower(label) LIKE '%plate%') AS income, count(*) FILTER (lower(label) LIKE '%rod%') AS balance, count(*) AS n FROM r_rows WHERE row_type = 'DATA' GROUP BY 1), j AS (SELECT * FROM r_tables JOIN c USING (table_id))
SELECT doc_id, table_id, 'OCI_HAS_PNL_STRUCTURE' AS issue FROM j WHERE context = 'OCI' AND income >= 2 UNION ALL SELECT doc_id, table_id, 'ASSOCIATE_SUMMARY_DETECTED' FROM j WHERE income >= 1 AND balance >= 1 AND n <= 4
UNION ALL SELECT doc_id, table_id, 'PNL_NO_REVENUE' FROM j WHERE context = 'PNL' AND income = 0 UNION ALL SELECT doc_id, table_id, 'UNCLASSIFIED_LIKELY_PNL' FROM j WHERE context IS NULL AND income >= 2
UNION ALL SELECT doc_id, table_id, 'UNCLASSIFIED_LIKELY_SFP' FROM j WHERE context IS NULL AND balance >= 2""")
def classification_checks(t):
    return C.classification_checks(t.r_tables, t.r_rows, "plate", "rod")


KINDS = [("plate", "PNL"), ("gear", "SFP"), ("rod", "OCI"), ("wheel", "NOTES")]
KIND_SQL = "CASE WHEN contains(lower(label), 'plate') THEN 'PNL' WHEN contains(lower(label), 'gear') THEN 'SFP' WHEN contains(lower(label), 'rod') THEN 'OCI' WHEN contains(lower(label), 'wheel') THEN 'NOTES' END"
CONTENTS = f"""tr AS (SELECT doc_id, table_id, row_id, row_idx, CASE WHEN row_idx % 6 = 5 THEN ' ' ELSE label END AS label FROM r_rows),
tce AS (SELECT r.table_id, r.row_id, r.row_idx, c.col_idx, CASE WHEN c.col_idx = 1 AND r.row_idx % 4 = 1 THEN 'hot rod part' END AS text,
  CASE c.col_idx WHEN 1 THEN NULL WHEN 2 THEN (r.row_id * 3 + r.row_idx * 31) % 520 WHEN 3 THEN r.row_idx + 0.5 ELSE CASE WHEN r.row_idx % 5 > 0 THEN (r.table_id * 7 + r.row_idx * 40) % 520 END END::DOUBLE AS value FROM r_rows r, (VALUES (1), (2), (3), (4)) c(col_idx)),
el AS (SELECT table_id FROM r_tables WHERE table_ord <= 20 AND table_id % 2 = 1 AND table_id IN (SELECT table_id FROM tr GROUP BY 1 HAVING count(*) >= 3)),
pg AS (SELECT *, CASE WHEN value > 1 AND value < 500 AND value = floor(value) THEN value::INT END AS page FROM tce WHERE table_id IN (SELECT table_id FROM el)),
en AS (SELECT doc_id, tr.table_id, tr.row_idx, -1 AS at_, trim(label) AS label, arg_max(page, col_idx) FILTER (page IS NOT NULL) AS page FROM tr JOIN pg USING (table_id, row_id) WHERE trim(label) <> '' GROUP BY 1, 2, 3, 4, 5 HAVING count(page) > 0
  UNION ALL SELECT doc_id, tr.table_id, tr.row_idx, a.col_idx, a.text, arg_min(b.page, b.col_idx) FROM tr JOIN pg a USING (table_id, row_id) JOIN pg b ON b.table_id = a.table_id AND b.row_id = a.row_id AND b.col_idx > a.col_idx AND b.page IS NOT NULL WHERE a.text IS NOT NULL AND a.value IS NULL GROUP BY 1, 2, 3, 4, 5),
ek AS (SELECT *, {KIND_SQL} AS kind, (page >= lag(page) OVER (PARTITION BY table_id ORDER BY row_idx, at_))::INT AS up FROM en),
cand AS (SELECT t.doc_id, t.table_id, t.table_ord, t.page_no, t.unit, count(*) AS n_entries, coalesce(sum(up), 0) AS n_up, count(DISTINCT kind) FILTER (kind IN ('PNL', 'SFP', 'OCI')) AS kinds, max(page) AS last FROM ek JOIN r_tables t USING (table_id) GROUP BY ALL)"""


def entries(t):
    k, r = F.col("col_idx"), F.col("row_idx")
    rows = t.r_rows.select("doc_id", "table_id", "row_id", "row_idx", F.when(r % 6 == 5, " ").otherwise(F.col("label")).alias("label"))
    value = F.when(k == 2, ((F.col("row_id") * 3 + r * 31) % 520).cast("double")).when(k == 3, r + 0.5).when((k == 4) & (r % 5 > 0), ((F.col("table_id") * 7 + r * 40) % 520).cast("double"))
    cells = t.r_rows.select("table_id", "row_id", "row_idx", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("col_idx")).select("table_id", "row_id", "col_idx", F.when((k == 1) & (r % 4 == 1), "hot rod part").alias("text"), value.alias("value"))
    return C.toc_entries(t.r_tables, rows, cells, t.r_columns)


@query("e1_toc_entries", f"WITH {CONTENTS} SELECT doc_id, table_id, row_idx, at_, label, page FROM en")
def toc_entries(t):
    return entries(t).select("doc_id", "table_id", "ord.row_idx", F.col("ord.at").alias("at_"), "label", "page")


MAP = "SELECT doc_id, table_id, page, arg_max(kind, (row_idx, at_)) AS type FROM ek JOIN toc USING (doc_id, table_id) WHERE kind IS NOT NULL GROUP BY 1, 2, 3"


@query("e1_detect_toc", f"WITH {CONTENTS}, toc AS (SELECT doc_id, arg_min(table_id, table_ord) AS table_id FROM cand WHERE n_entries >= 3 AND n_up >= 0.5 * n_entries AND kinds >= 2 GROUP BY 1) {MAP}")
def detect_toc(t):
    return C.detect_toc(t.r_tables, entries(t), KINDS)


@query("e1b_detect_toc_enhanced", f"WITH {CONTENTS}, toc AS (SELECT doc_id, arg_min(table_id, table_ord) AS table_id FROM cand WHERE n_entries >= 3 AND n_up >= 0.5 * n_entries AND kinds >= 2 AND page_no <= 10 AND unit IS NULL AND last <= 500 GROUP BY 1) {MAP}")
def detect_toc_enhanced(t):
    return C.detect_toc(t.r_tables.withColumn("currency", F.col("unit")), entries(t), KINDS, enhanced=True)


@query("e1b_detect_toc_scored", f"""
WITH {CONTENTS}, s AS (SELECT *, least(n_entries / 3, 3) + 2.0 * n_up / greatest(n_entries - 1, 1) + least(kinds, 3) + CASE WHEN page_no <= 5 THEN 1 ELSE 0 END + CASE WHEN last > 20 THEN 0.5 ELSE 0 END AS score FROM cand WHERE page_no <= 15)
SELECT doc_id, table_id, round(score, 4)::DOUBLE AS score FROM s WHERE score >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_ord) = 1""")
def detect_toc_scored(t):
    return C.detect_toc_scored(t.r_tables, entries(t), KINDS)


PAGE_ROWS = "SELECT table_id, row_idx AS ord, label, CAST((row_id * 7 + row_idx * 40) % 520 AS INT) AS page FROM r_rows"


@query("e1b_detect_toc_index", f"""
WITH en AS ({PAGE_ROWS}) SELECT t.doc_id, table_id, round(avg((page BETWEEN 1 AND n_pages)::INT), 4) AS share, count(*) AS n_entries FROM en JOIN r_tables t USING (table_id) JOIN r_documents d ON d.doc_id = t.doc_id WHERE table_id % 4 = 0 GROUP BY 1, 2 HAVING share >= 0.5""")
def detect_toc_index(t):
    flagged = t.r_tables.join(t.r_documents.select("doc_id", "n_pages"), "doc_id").select("doc_id", "table_id", (F.col("table_id") % 4 == 0).alias("is_index"), "n_pages")
    pages = t.r_rows.select("table_id", F.col("row_idx").alias("ord"), "label", ((F.col("row_id") * 7 + F.col("row_idx") * 40) % 520).cast("int").alias("page"))
    return C.detect_toc_index(flagged, pages)


@query("b16_infer_dimensions", """
SELECT r.row_id, 'ENTITY=' || d.entity || CASE WHEN t.context = 'PNL' THEN ';SCOPE=CONTINUING' ELSE '' END || CASE WHEN r.label LIKE '%gear%' THEN ';SEGMENT=' || r.label ELSE '' END AS dimensions
FROM r_rows r JOIN r_tables t USING (table_id) JOIN r_documents d ON d.doc_id = r.doc_id""")
def infer_dimensions(t):
    r = t.r_rows.join(t.r_tables.select("table_id", "context"), "table_id").join(t.r_documents.select("doc_id", "entity"), "doc_id")
    dims = C.infer_dimensions(F.col("entity"), F.coalesce("context", F.lit("")), F.when(F.col("label").contains("gear"), F.col("label")))
    return r.select("row_id", F.array_join(F.transform(F.map_entries(dims), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("dimensions"))


@query("b18_has_note_column", "SELECT table_id, bool_or(role = 'NOTES') AS has_notes FROM r_columns GROUP BY 1")
def has_note_column(t):
    return C.has_note_column(t.r_columns)


@query("b19_entity_from_name", "SELECT doc_id, 'Customer ' || ltrim(split_part(entity, '#', 2), '') AS entity, greatest(1, n_pages - 12)::INT AS pdf_page FROM r_documents")
def entity_from_name(t):
    return t.r_documents.select("doc_id", C.entity_from_name(F.concat(F.lower("entity"), F.lit("_2024"))).alias("entity"), F.greatest(F.lit(1), F.col("n_pages") - 12).alias("pdf_page"))


@query("c16_note_edges", f"""
WITH {REFS} {NOTES} SELECT e.doc_id, e.table_id || ':' || e.row_id AS source, coalesce(n.context, 'note_' || e.note_number) AS target FROM en e JOIN notes n USING (doc_id, note_number) WHERE e.doc_id % 2 = 0""")
def note_edges(t):
    sections = t.r_documents.select("doc_id", F.lit("PNL").alias("section_type")).unionByName(t.r_documents.where("doc_id % 2 = 0").select("doc_id", F.lit("TOC").alias("section_type")))
    return C.materialize_note_edges(refs(t).join(notes(t).select("doc_id", "note_number", "context"), ["doc_id", "note_number"]), sections)


RANK = "rk AS (SELECT doc_id, page_no AS page, arg_min(CASE table_id % 3 WHEN 0 THEN 'pnl' WHEN 1 THEN 'sfp' ELSE 'notes' END, table_id) AS top_class, round(arg_min(table_id % 97, table_id) / 97, 4) AS top_score FROM r_tables WHERE table_id % 5 > 0 GROUP BY 1, 2)"


@query("c18_page_features", f"""
WITH {RSEC}, {REFS} {NOTES}, {RANK}, sp AS (SELECT doc_id, unnest(range(1, n_pages + 1))::INT AS page FROM r_documents), s AS (SELECT doc_id, page, min(section_type) AS section_type FROM (SELECT doc_id, section_type, unnest(range(start_page, end_page + 1))::INT AS page FROM rs) GROUP BY 1, 2),
t AS (SELECT doc_id, page_no AS page, count(*) AS n_tables, min(context) AS context FROM r_tables GROUP BY 1, 2), n AS (SELECT r.doc_id, t.page_no AS page, count(*) AS n_refs, count(DISTINCT note_number) AS n_notes FROM en r JOIN r_tables t USING (table_id) GROUP BY 1, 2),
tc AS (SELECT doc_id, (row_idx * 3 + doc_id % 5)::INT AS page, string_agg(DISTINCT CASE WHEN row_idx % 2 = 0 THEN 'PNL' ELSE 'SFP' END, ',' ORDER BY CASE WHEN row_idx % 2 = 0 THEN 'PNL' ELSE 'SFP' END) AS toc_refs FROM r_rows WHERE table_id % 4 = 0 AND row_idx > 0 GROUP BY 1, 2)
SELECT sp.doc_id, sp.page, section_type, coalesce(n_tables, 0) AS n_tables, context, coalesce(n_refs, 0) AS n_refs, coalesce(n_notes, 0) AS n_notes, top_class, top_score, coalesce(toc_refs, '') AS toc_refs FROM sp LEFT JOIN s ON s.doc_id = sp.doc_id AND s.page = sp.page LEFT JOIN t ON t.doc_id = sp.doc_id AND t.page = sp.page
LEFT JOIN n ON n.doc_id = sp.doc_id AND n.page = sp.page LEFT JOIN rk ON rk.doc_id = sp.doc_id AND rk.page = sp.page LEFT JOIN tc ON tc.doc_id = sp.doc_id AND tc.page = sp.page""")
def page_features(t):
    r = refs(t).join(t.r_tables.select("table_id", F.col("page_no").alias("page")), "table_id").select("doc_id", "page", "note_number")
    k = F.col("table_id") % 3
    rank = t.r_tables.where("table_id % 5 > 0").groupBy("doc_id", F.col("page_no").alias("page")).agg(F.min_by(F.when(k == 0, "pnl").when(k == 1, "sfp").otherwise("notes"), "table_id").alias("top_class"), F.round(F.min_by(F.col("table_id") % 97, "table_id") / 97, 4).alias("top_score"))
    toc = t.r_rows.where("table_id % 4 = 0 and row_idx > 0").select("doc_id", (F.col("row_idx") * 3 + F.col("doc_id") % 5).cast("int").alias("page"), F.when(F.col("row_idx") % 2 == 0, "PNL").otherwise("SFP").alias("type"))
    return C.page_features(t.r_documents, report_sections(t), t.r_tables, r, rank, toc)


@query("c20_validate_notes", f"""
WITH {REFS} {NOTES}, pr AS (SELECT DISTINCT e.doc_id, e.note_number FROM en e JOIN r_tables t USING (table_id) WHERE t.context IN ('PNL', 'SFP', 'OCI')), n AS (SELECT doc_id, unnest([3, 7, 11]) AS note_number FROM r_documents) SELECT n.doc_id, n.note_number, pr.doc_id IS NOT NULL AS referenced FROM n LEFT JOIN pr USING (doc_id, note_number)""")
def validate_notes(t):
    notes = t.r_documents.select("doc_id", F.explode(F.array(*map(F.lit, (3, 7, 11)))).alias("note_number"))
    primary = refs(t).join(t.r_tables.where("context in ('PNL', 'SFP', 'OCI')").select("table_id"), "table_id", "left_semi")
    return C.validate_notes(notes, primary)


@query("c21_suggest_note_numbers", """
WITH s AS (SELECT DISTINCT doc_id, row_id AS section_id, unnest(list_filter(string_split(lower(label), ' '), lambda w: length(w) > 3)[1:3]) AS w FROM r_rows WHERE row_idx = 1), n AS (SELECT DISTINCT doc_id, row_id % 30 AS note_number, unnest(string_split(lower(label), ' ')) AS w FROM r_rows WHERE row_idx = 2),
h AS (SELECT doc_id, section_id, note_number, count(DISTINCT w) AS n_words FROM s JOIN n USING (doc_id, w) GROUP BY 1, 2, 3)
SELECT doc_id, section_id, note_number, n_words FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, section_id ORDER BY n_words DESC, note_number) = 1""")
def suggest_note_numbers(t):
    return C.suggest_note_numbers(t.r_rows.where("row_idx = 1").select("doc_id", F.col("row_id").alias("section_id"), "label"), t.r_rows.where("row_idx = 2").select("doc_id", (F.col("row_id") % 30).alias("note_number"), "label"))


@query("d8_ic_decomposition", f"""
WITH {BEST}, w AS (SELECT doc_id, period_key, max(amount) FILTER (concept_id = 'LARGE') AS face, max(amount) FILTER (concept_id = 'SMALL') AS external, max(amount) FILTER (concept_id = 'PROMO') AS ic FROM best WHERE context = 'PNL' GROUP BY 1, 2)
SELECT *, round(face - external - coalesce(ic, 0), 2) AS delta, CASE WHEN abs(round(face - external - coalesce(ic, 0), 2)) <= 1000 THEN 'valid' WHEN ic IS NULL THEN 'warning' ELSE 'broken' END AS status FROM w WHERE face IS NOT NULL AND external IS NOT NULL""")
def ic_decomposition(t):
    return C.check_ic_decomposition(X.best_fact(t.r_facts), "PNL", "LARGE", "SMALL", "PROMO")


@query("d28b_filter_axis_members", f"""
WITH {ADDITIVE}, a AS (SELECT table_id, unnest(string_split(parts, ','))::INT AS col_idx FROM ad), n AS (SELECT doc_id, c.table_id, c.col_idx, c.header, a.col_idx IS NOT NULL AS add FROM r_columns c LEFT JOIN a ON a.table_id = c.table_id AND a.col_idx = c.col_idx WHERE c.role = 'VALUE')
SELECT doc_id, table_id, col_idx, header FROM n QUALIFY add OR NOT bool_or(add) OVER (PARTITION BY doc_id)""")
def filter_axis_members(t):
    from ..operators.structure import additive_columns
    from ..operators.structure import filter_axis_members as kept

    return kept(t.r_columns.where("role = 'VALUE'").select("doc_id", "table_id", "col_idx", "header"), additive_columns(t.r_tree_cells))


@query("i5_tag_ratio", """
WITH x AS (SELECT r.doc_id, r.table_id, c.col_idx, min(value) FILTER (tag = 'LARGE') AS n, min(value) FILTER (tag = 'SMALL') AS d FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id AND c.table_id = r.table_id WHERE value IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT *, n / d AS q FROM x WHERE n IS NOT NULL AND d <> 0), e AS (SELECT doc_id, table_id, col_idx, q, unnest([98, 99]) AS i FROM q),
c AS (SELECT r.doc_id, r.table_id, r.row_id, c.col_idx, c.value FROM r_rows r JOIN r_cells c ON c.row_id = r.row_id AND c.table_id = r.table_id WHERE r.tag IS NULL AND c.value IS NOT NULL UNION ALL SELECT doc_id, table_id, table_id * 100 + i, col_idx, CASE WHEN i = 99 AND col_idx = 2 THEN q * 1.01 ELSE q END FROM e)
SELECT c.doc_id, c.table_id, row_id, 'RATIO' AS concept_id, 0.6::DOUBLE AS confidence, 'ratio' AS rule FROM c JOIN q ON q.table_id = c.table_id AND q.col_idx = c.col_idx GROUP BY 1, 2, 3 HAVING bool_and(abs(value - q) <= 0.001 * abs(q))""")
def tag_ratio(t):
    rules = t.spark.createDataFrame([("RATIO", "LARGE", "SMALL")], "result string, numerator string, denominator string")
    rows, cells = ratio_inputs(t)
    return C.tag_ratio(rows, cells, rows.where("tag is not null").select("table_id", "row_id", F.col("tag").alias("concept_id")), rules)


def ratio_inputs(t):
    """Rows and cells, and for each table with the tags LARGE and SMALL a row of their quotients (row_id + 98) and one that is off in column 2 (+ 99)."""
    side = lambda tag, name: t.r_rows.where(F.col("tag") == tag).select("doc_id", "table_id", "row_id").join(t.r_cells.where("value is not null").select("row_id", "col_idx", "value"), "row_id").groupBy("doc_id", "table_id", "col_idx").agg(F.min("value").alias(name))
    q = side("LARGE", "n").join(side("SMALL", "d"), ["doc_id", "table_id", "col_idx"]).where("d <> 0").select("doc_id", "table_id", "col_idx", (F.col("n") / F.col("d")).alias("q"), F.explode(F.array(F.lit(98), F.lit(99))).alias("row_idx"))
    q = q.withColumn("row_id", F.col("table_id") * 100 + F.col("row_idx"))
    rows = q.select("doc_id", "table_id", "row_idx", "row_id", F.lit("Ratio").alias("label"), F.lit("DATA").alias("row_type"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("tag")).distinct()
    cells = q.select("table_id", "row_id", "row_idx", "col_idx", F.when((F.col("row_idx") == 99) & (F.col("col_idx") == 2), F.col("q") * 1.01).otherwise(F.col("q")).alias("value"))
    return t.r_rows.unionByName(rows), t.r_cells.unionByName(cells)


CLEAN = r"""cl AS (SELECT r.doc_id, r.table_id, l.row_id, r.row_type, l.raw, r.tag, try_cast(nullif(regexp_extract(lower(l.raw), '(see )?note ([0-9]{1,3})', 2), '') AS INT) AS note_number,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l.raw, '\(?\s*(see )?note [0-9]{1,3}\s*\)?', '', 'gi'), '\s*\([0-9]{1,2}\)\s*$', ''), '[*¹²³⁴⁵⁶⁷⁸⁹]+', '', 'g'), '\s[a-o]\)$', ''), '\s+', ' ', 'g')) AS cleaned FROM l_labels l JOIN r_rows r ON r.row_id = l.row_id AND r.table_id = l.table_id)"""
PRENORM = PRETAG


@query("i7_pretag", f"""
WITH ix AS (SELECT lower(p_name) AS norm, min(p_type) AS concept_id FROM part GROUP BY 1), {CLEAN},
r AS (SELECT c.doc_id, c.row_id, t.context, note_number, {PRENORM.format('cleaned')} AS clean, {PRENORM.format('raw')} AS whole FROM cl c JOIN r_tables t USING (table_id) WHERE tag IS NULL AND t.context IS NOT NULL AND NOT regexp_matches(trim(raw), '^[0-9]*$') AND NOT {TOPIC.format('raw')}),
n AS (SELECT clean AS norm FROM r UNION SELECT whole FROM r),
af AS (SELECT n.norm, ix.concept_id, conf, k FROM (SELECT norm, k, conf, CASE WHEN k < 3 THEN CASE WHEN suffix(norm, a) THEN left(norm, (length(norm) - length(a))::INT) END ELSE CASE WHEN prefix(norm, a) THEN substr(norm, length(a) + 1) END END AS key
  FROM (SELECT norm AS whole_norm, {NORM.format('norm')} AS norm FROM n), (VALUES (0, ' total', 1.0), (1, ' net', 1.0), (2, ' gross', 1.0), (3, 'total ', 0.95), (4, 'thereof ', 0.9), (5, 'of which ', 0.9), (6, 'davon ', 0.9)) v(k, a, conf)) n JOIN ix ON ix.norm = n.key WHERE n.norm NOT IN (SELECT norm FROM ix)),
a1 AS (SELECT n.norm, arg_min(concept_id, k) AS concept_id, arg_min(conf, k) AS conf FROM n JOIN af ON af.norm = {NORM.format('n.norm')} GROUP BY 1),
fz AS (SELECT n.norm, ix.concept_id, round(1 - levenshtein(n.norm, ix.norm) / greatest(length(n.norm), length(ix.norm)), 6) AS score FROM n, ix WHERE 1 - levenshtein(n.norm, ix.norm) / greatest(length(n.norm), length(ix.norm)) >= 0.75
  QUALIFY row_number() OVER (PARTITION BY n.norm ORDER BY 1 - levenshtein(n.norm, ix.norm) / greatest(length(n.norm), length(ix.norm)) DESC, length(ix.norm), ix.norm DESC) = 1),
m AS (SELECT norm, coalesce(ix.concept_id, a1.concept_id, fz.concept_id) AS concept_id, coalesce(CASE WHEN ix.norm IS NOT NULL THEN 1 END, a1.conf, fz.score)::DOUBLE AS score, CASE WHEN ix.norm IS NOT NULL THEN 'exact' WHEN a1.concept_id IS NOT NULL THEN 'affix' ELSE 'fuzzy' END AS how
  FROM n LEFT JOIN ix USING (norm) LEFT JOIN a1 USING (norm) LEFT JOIN fz USING (norm)),
h AS (SELECT r.*, coalesce(x.concept_id, y.concept_id) AS concept_id, CASE WHEN x.concept_id IS NOT NULL THEN x.score ELSE y.score END AS score, CASE WHEN x.concept_id IS NOT NULL THEN x.how ELSE y.how END AS how FROM r JOIN m x ON x.norm = r.clean JOIN m y ON y.norm = r.whole)
SELECT h.row_id, h.concept_id, round(h.score, 3) AS confidence, h.how, h.context, h.note_number, CASE WHEN h.note_number % 3 = 0 THEN 'DISC.N' || h.note_number END AS note_context,
  'ENTITY=' || d.entity || CASE WHEN h.context = 'PNL' THEN ';SCOPE=CONTINUING' ELSE '' END || CASE WHEN contains(h.clean, 'gear') THEN ';SEGMENT=' || h.clean ELSE '' END AS dimensions
FROM h JOIN r_documents d ON d.doc_id = h.doc_id WHERE h.concept_id IS NOT NULL""")
def pretag(t):
    from ..operators.tagging import pretag as tagged
    from .reviews import index

    rows = t.l_labels.select("table_id", "row_id", "raw").join(t.r_rows.select("doc_id", "table_id", "row_id", "row_type", "tag"), ["table_id", "row_id"])
    notes = t.r_documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("note_number")).where("note_number % 3 = 0").withColumn("context", F.concat(F.lit("DISC.N"), F.col("note_number").cast("string")))
    return tagged(rows, t.r_tables, index(t), t.r_documents, notes, "gear")


@query("i10_external_tags", f"""
WITH r AS MATERIALIZED (SELECT doc_id, table_id, row_id, CASE row_id % 3 WHEN 0 THEN 'LARGE' WHEN 1 THEN 'MEDIUM' ELSE 'NONE' END AS concept_id FROM r_rows WHERE row_id % 2 = 0 AND tag IS NULL AND NOT {UNTAG.format('label')})
SELECT r.doc_id, r.table_id, r.row_id, r.concept_id FROM r JOIN r_tables t USING (table_id) JOIN r_concepts k ON k.concept_id = r.concept_id AND k.valid_context = t.context""")
def external_tags(t):
    k = F.col("row_id") % 3
    s = t.r_rows.where("row_id % 2 = 0").select("row_id", F.when(k == 0, "LARGE").when(k == 1, "MEDIUM").otherwise("NONE").alias("concept_id"))
    return C.apply_external_tags(t.r_rows, s, O.candidate_concepts(t.r_tables, t.r_concepts, t.r_documents))


@query("i10_strip_bad_tags", f"""
WITH r AS (SELECT doc_id, table_id, row_id, tag, CASE row_id % 6 WHEN 0 THEN '31.12.2024' WHEN 1 THEN '(3)' WHEN 2 THEN 'in TEUR' ELSE label END AS label FROM r_rows) SELECT doc_id, table_id, row_id, tag AS removed FROM r WHERE tag IS NOT NULL AND {UNTAG.format('label')}""")
def strip_bad_tags(t):
    from ..operators.tagging import strip_bad_tags as stripped

    k = F.col("row_id") % 6
    return stripped(t.r_rows.withColumn("label", F.when(k == 0, "31.12.2024").when(k == 1, "(3)").when(k == 2, "in TEUR").otherwise(F.col("label"))))


@query("a14_chunk_union", "SELECT doc_id, table_id, page_no, CASE WHEN page_no > 20 THEN context END AS context FROM r_tables")
def chunk_union(t):
    from ..sources.reports import chunk_union as union

    return union([t.r_tables.where("page_no <= 20").select("doc_id", "table_id", "page_no"), t.r_tables.where("page_no > 20").select("doc_id", "table_id", "page_no", "context")])


@query("a3_page_elements", """
SELECT doc_id, i - 1 AS ord, (i - 1) % 4 + 1 AS page_no, CASE WHEN x LIKE '%.' THEN 'text' ELSE 'caption' END AS label, x AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)""")
def page_elements(t):
    from ..sources.reports import page_elements as elements

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(x.alias("text"), F.when(x.endswith("."), "text").otherwise("caption").alias("label"), F.array(F.struct((i % 4 + 1).alias("page_no")), F.struct((i + 9).alias("page_no"))).alias("prov")))
    return elements(t.documents.select("doc_id", lines.alias("texts")))


def scratch(t, name: str) -> str:
    import tempfile

    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='factloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def graph_files(t) -> str:
    """Nested documents (customers) as extraction writes them, packed by size into files of many. Lines and tables are dealt by table once, and go to their documents as
    they are read: ids as text, texts of values and the nesting are made there, after the last shuffle."""
    n = dealt.of_tables(t, "r_tables")
    cell = lambda i, v: F.struct(i.cast("int").alias("colIdx"), v.cast("string").alias("text"), v.cast("double").alias("parsedValue"), (v < 0).alias("isNegative"))

    def row(i, label, kind, parent, cells, tag):
        tagged = F.when(tag.isNotNull(), F.struct(tag.alias("conceptId"), F.lit("label").alias("method"), F.lit(0.8).alias("confidence")))
        return F.struct(i.cast("int").alias("rowIdx"), (F.col("table_id") * 100 + i).cast("string").alias("rowId"), label.alias("label"), F.lit(kind).alias("rowType"), parent.cast("string").alias("parentId"), cells.alias("cells"), tagged.alias("preTagged"))

    lines = t.r_wide_lines.repartition(n, "doc_id")
    values = F.array(*[cell(F.lit(k), F.col(f"v{k}")) for k in (1, 2, 3, 4)])
    lines = lines.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(row(F.col("row_idx"), F.col("label"), "DATA", F.col("table_id") * 100, values, F.col("tag")))).alias("lines"))
    totals = t.r_totals.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("totals"))
    columns = t.r_columns.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(F.col("col_idx").alias("colIdx"), "role", F.col("header").alias("headerLabel")))).alias("columns"))
    tables = t.r_tables.join(columns, "table_id").join(totals, "table_id", "left").repartition(n, "doc_id").join(lines, ["doc_id", "table_id"], "left")
    total = row(F.lit(0), F.lit("Total"), "TOTAL_EXPLICIT", F.lit(None), F.transform("totals", lambda x: cell(x["col_idx"], x["value"])), F.when(F.col("table_id") % 4 != 0, "TOTAL"))
    meta = F.struct(F.col("context").alias("statementComponent"), F.col("unit").alias("detectedUnit"), F.col("sign_convention").alias("signConvention"))
    rows = F.concat(F.array(total), F.coalesce("lines", F.array()))
    tables = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_ord", F.col("table_id").cast("string").alias("tableId"), F.col("page_no").alias("pageNo"), meta.alias("metadata"), "columns", rows.alias("rows")))).alias("tables"))
    path = scratch(t, "graphs")
    documents = t.r_documents.select(F.col("doc_id").cast("string").alias("docId"), "doc_id", "gaap").join(tables, "doc_id").drop("doc_id")
    with A.one_key(t.spark):
        pack_table_graphs(documents, path, dealt=True)
    return path


def shredded(t):
    nested = read_packed_graphs(t.spark, graph_files(t))
    return nested.withColumn("doc_id", F.col("doc_id").cast("long")), shred_table_graphs


@query("a1_read_table_graphs", "SELECT d.doc_id, gaap, count(*)::INT AS n_tables FROM r_documents d JOIN r_tables t USING (doc_id) GROUP BY 1, 2")
def read_graphs(t):
    return shredded(t)[0].select("doc_id", "gaap", F.size("tables").alias("n_tables"))


@query("a2_shred_cells", "SELECT r.doc_id, r.table_id, r.row_id, c.col_idx, c.value FROM r_rows r LEFT JOIN r_cells c ON c.row_id = r.row_id AND c.table_id = r.table_id")
def shred_cells(t):
    nested, shred = shredded(t)
    return shred(nested)["cells"].select("doc_id", F.col("table_id").cast("long").alias("table_id"), F.col("row_id").cast("long").alias("row_id"), "col_idx", F.col("parsed_value").alias("value"))


@query("a2_shred_rows", "SELECT r.doc_id, r.table_id, t.table_ord - 1 AS table_ord, r.row_id, r.row_idx, r.label, r.parent_id, r.tag, t.context FROM r_rows r JOIN r_tables t USING (table_id)")
def shred_rows(t):
    nested, shred = shredded(t)
    r = shred(nested)["rows"].where("table_id is not null")
    return r.select("doc_id", F.col("table_id").cast("long").alias("table_id"), "table_ord", F.col("row_id").cast("long").alias("row_id"), "row_idx", "label", F.col("parent_id").cast("long").alias("parent_id"), "tag", "context")


@query("a7_read_trial_balance", """
SELECT o_orderkey::VARCHAR AS account, 'Order ' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS debit, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE 0 END AS credit, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS balance FROM orders""")
def trial_balance(t):
    from ..sources.reports import read_trial_balance

    european = lambda v: F.translate(F.format_number(v, 2), ",.", ".,")
    even, price = F.col("o_orderkey") % 2 == 0, F.round("o_totalprice", 2)
    path = scratch(t, "ledger")
    none = F.lit("–")
    t.orders.select(
        F.col("o_orderkey").alias("Konto"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("Bezeichnung"), F.when(even, european(price)).otherwise(none).alias("Soll"), F.when(~even, european(price)).otherwise(none).alias("Haben"),
        F.when(even, european(price)).otherwise(F.concat(F.lit("-"), european(price))).alias("Saldo"),
    ).write.csv(path, sep=";", header=True)
    return read_trial_balance(t.spark, path)


@query("a8_event_log", "SELECT event_id, user_id, event_type, value FROM events")
def event_log(t):
    from ..sources.reports import append_log, read_event_log

    path, e = scratch(t, "log"), t.events.select("event_id", "user_id", "event_type", "value")
    for k in (0, 1):
        append_log(e.where(F.col("event_id") % 2 == k), path)
    return read_event_log(t.spark, path, "event_id long, user_id long, event_type string, value double")


@query("a9_write_run", "SELECT doc_id, n_pages, 'two' AS run_id FROM r_documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n_pages, 'one' FROM r_documents")
def write_run(t):
    from ..sources.reports import write_run as write

    path, d = scratch(t, "runs"), t.r_documents.select("doc_id", "n_pages")
    for df, run in ((d.where("doc_id < 5"), "one"), (d.where("doc_id % 2 = 0"), "two"), (d, "one")):  # the last replaces the first
        write(df, path, run)
    return t.spark.read.parquet(path).select("doc_id", "n_pages", F.col("run_id").cast("string").alias("run_id"))


@query("k5_audit_stream", """
SELECT user_id AS target_id, event_type AS value, 'stream' AS source, count(*) AS n FROM events GROUP BY 1, 2""")
def audit_stream(t):
    from ..streaming import streams as K
    from .learning import checkpoint, event_stream

    tags = event_stream(t).select(F.lit(1).alias("doc_id"), F.col("user_id").alias("row_id"), F.col("event_type").alias("concept_id"), F.lit(1.0).alias("confidence"))
    log, votes = scratch(t, "audit-log"), scratch(t, "audit-votes")
    K.audit_stream(tags, log, votes, checkpoint(t), "stream").awaitTermination()
    return t.spark.read.parquet(votes).groupBy("target_id", "value", "source").agg(F.count(F.lit(1)).alias("n"))
