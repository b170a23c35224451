"""Queries on labels, amounts as text, and concept dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import labels as O
from .registry import query

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s*[0-9]+[.]\s*', ''), '\s*[0-9]+\)\s*$', ''), '\s+', ' ', 'g'))"
UNTAG = r"regexp_matches(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '" + L.UNTAGGABLE.replace("{", "{{").replace("}", "}}") + "')"
TOPIC = "regexp_matches(lower({0}), '" + L.EXCLUDED_TOPICS + "')"
AMBIG = "('total', 'other', 'sum', 'balance', 'thereof', 'gesamt', 'summe', 'sonstige')"
INDEX = f"""idx AS (SELECT norm, arg_min(concept_id, (precedence, concept_id)) AS concept_id FROM (SELECT {NORM.format('label')} AS norm, concept_id, precedence FROM l_index)
  WHERE length(norm) >= 4 AND norm NOT IN {AMBIG} GROUP BY norm)"""


def pretag_sql() -> str:
    t = r"regexp_replace(lower({0}), '^\s+|\s+$', '', 'g')"
    for pattern in L.PRETAG:
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return f"rtrim(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ':')"


PRETAG = pretag_sql()


@query("b1_clean_label", r"""
WITH a AS (SELECT row_id, raw, regexp_extract(lower(raw), '(see )?note ([0-9]{1,3})', 2) AS note, regexp_replace(raw, '\(?\s*(see )?note [0-9]{1,3}\s*\)?', '', 'gi') AS t FROM l_labels),
b AS (SELECT *, regexp_extract(t, '\(([0-9]{1,2})\)\s*$', 1) AS foot, regexp_replace(regexp_replace(t, '\s*\([0-9]{1,2}\)\s*$', ''), '[*¹²³⁴⁵⁶⁷⁸⁹]+', '', 'g') AS u FROM a),
c AS (SELECT *, regexp_extract(u, '\s([a-o])\)$', 1) AS letter, regexp_replace(u, '\s[a-o]\)$', '') AS w FROM b)
SELECT row_id, trim(regexp_replace(w, '\s+', ' ', 'g')) AS clean, array_to_string(list_filter([foot, letter], lambda x: x <> ''), ',') AS footnotes, try_cast(nullif(note, '') AS INT) AS note_number FROM c""")
def clean_label(t):
    return t.l_labels.select("row_id", L.clean_label(F.col("raw")).alias("cleaned")).select("row_id", "cleaned.*")


@query("b2_norm_labels", rf"""
SELECT row_id, {PRETAG.format('raw')} AS pretag,
       {NORM.format('raw')} AS norm FROM l_labels""")
def norm_labels(t):
    return t.l_labels.select("row_id", L.norm_label_pretag(F.col("raw")).alias("pretag"), L.norm_label_index(F.col("raw")).alias("norm"))


@query("b3_untaggable", f"""
SELECT doc_id, count(*) FILTER ({UNTAG.format('raw')}) AS n_untaggable,
       count(*) FILTER (length(trim(raw)) >= 4 AND lower(trim(raw)) NOT IN {AMBIG}) AS n_indexable FROM (SELECT doc_id, raw FROM l_labels UNION ALL SELECT doc_id, CASE row_id % 9 WHEN 0 THEN '[3]' WHEN 1 THEN ' 1 234 + 5 ' WHEN 2 THEN '1850' WHEN 3 THEN 'IFRS 16 leases' WHEN 4 THEN 'in TEUR' WHEN 5 THEN 'Note  12.1' WHEN 6 THEN '' WHEN 7 THEN '(12)' ELSE 'note on leases' END FROM r_rows) GROUP BY doc_id""")
def untaggable(t):
    k = F.col("row_id") % 9
    odd = F.when(k == 0, "[3]").when(k == 1, " 1 234 + 5 ").when(k == 2, "1850").when(k == 3, "IFRS 16 leases").when(k == 4, "in TEUR").when(k == 5, "Note  12.1").when(k == 6, "").when(k == 7, "(12)").otherwise("note on leases")
    both = t.l_labels.select("doc_id", "raw").unionByName(t.r_rows.select("doc_id", odd.alias("raw")))
    return both.groupBy("doc_id").agg(F.count_if(L.is_untaggable(F.col("raw"))).alias("n_untaggable"), F.count_if(L.indexable_label(F.col("raw"))).alias("n_indexable"))


@query("b4_excluded_topics", f"""
SELECT doc_id, {TOPIC.format('text')} AS excluded FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN coalesce(text, '') || ' Scope 2' WHEN 1 THEN 'Male years' WHEN 2 THEN 'Germany' WHEN 3 THEN 'Training hours per head' WHEN 4 THEN 'female staff' ELSE coalesce(text, '') END AS text FROM documents)""")
def excluded_topics(t):
    k, own = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    text = F.when(k == 0, F.concat(own, F.lit(" Scope 2"))).when(k == 1, "Male years").when(k == 2, "Germany").when(k == 3, "Training hours per head").when(k == 4, "female staff").otherwise(own)
    return t.documents.select("doc_id", L.is_excluded_topic(text).alias("excluded"))


@query("b8_infer_context", """
SELECT concept_id, CASE WHEN split_part(concept_id, '.', 1) = 'DISC' THEN 'DISC.' || split_part(concept_id, '.', 2) WHEN split_part(concept_id, '.', 1) IN ('PNL', 'SFP', 'OCI', 'CFS', 'SOCIE') THEN split_part(concept_id, '.', 1) ELSE 'UNKNOWN' END AS context
FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'DISC.PPE.' WHEN 1 THEN 'PNL.' WHEN 2 THEN 'SFP.A.' ELSE 'X.' END || p_type AS concept_id FROM part)""")
def infer_context(t):
    size = F.col("p_size") % 4
    ids = t.part.select(F.concat(F.when(size == 0, "DISC.PPE.").when(size == 1, "PNL.").when(size == 2, "SFP.A.").otherwise("X."), F.col("p_type")).alias("concept_id")).distinct()
    return ids.select("concept_id", L.infer_context(F.col("concept_id")).alias("context"))


@query("b9_unit_scale", """
SELECT doc_id, sum(CASE unit WHEN 'TEUR' THEN 1000 WHEN 'EUR Mio' THEN 1000000 ELSE 1 END)::DOUBLE AS scales, count(unit) AS n FROM r_tables GROUP BY doc_id""")
def unit_scale(t):
    from ..operators.facts import unit_scale as scale

    return t.r_tables.groupBy("doc_id").agg(F.sum(scale(F.col("unit"))).alias("scales"), F.count("unit").alias("n"))


@query("b11_normalize_sign", """
SELECT t.table_id, c.row_id, c.col_idx, round(CASE WHEN sign_convention = 'NATURAL_DRCR' THEN value WHEN context IN ('PNL', 'OCI') THEN -value WHEN k.balance_type = 'credit' THEN -abs(value) WHEN k.balance_type = 'debit' THEN abs(value) ELSE value END, 2) AS amount
FROM r_cells c JOIN r_rows r ON r.row_id = c.row_id JOIN r_tables t ON t.table_id = c.table_id LEFT JOIN r_concepts k ON k.concept_id = r.tag WHERE c.value IS NOT NULL""")
def normalize_sign(t):
    from ..operators.facts import normalize_sign as sign

    c = t.r_cells.where("value is not null").join(t.r_rows.select("row_id", "tag"), "row_id").join(t.r_tables.select("table_id", "sign_convention", "context"), "table_id")
    c = c.join(t.r_concepts.select(F.col("concept_id").alias("tag"), "balance_type"), "tag", "left")
    return c.select("table_id", "row_id", "col_idx", F.round(sign(F.col("value"), F.col("sign_convention"), F.col("context"), F.col("balance_type")), 2).alias("amount"))


@query("b12_parse_amounts", """
SELECT row_id, col_idx, text, CASE (row_id + col_idx) % 9 WHEN 0 THEN -(floor(value) + 0.5) WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN 1234567 WHEN 4 THEN floor(value)::BIGINT % 100 + 0.25 WHEN 5 THEN 1234
       WHEN 6 THEN floor(value)::BIGINT % 90 WHEN 7 THEN -(1000 + floor(value)::BIGINT % 900 + 100 + 0.75) ELSE NULL END::DOUBLE AS parsed FROM l_amounts""")
def parse_amounts(t):
    from ..operators.facts import parse_amounts as parse

    return parse(t.l_amounts.select("row_id", "col_idx", "text"))


@query("b13_scale_amounts", """
SELECT c.row_id, c.col_idx, round(c.value * CASE WHEN k.header LIKE '%\\%%' ESCAPE '\\' THEN 1 WHEN t.unit = 'TEUR' THEN 1000 WHEN t.unit = 'EUR Mio' THEN 1000000 ELSE 1 END, 2) AS scaled
FROM r_cells c JOIN r_columns k ON k.table_id = c.table_id AND k.col_idx = c.col_idx AND k.role = 'VALUE' JOIN r_tables t ON t.table_id = c.table_id WHERE c.value IS NOT NULL""")
def scale_amounts(t):
    from ..operators.facts import scale_amounts as scaled

    return scaled(t.r_cells, t.r_columns, t.r_tables)


@query("b14_infer_table_context", """
SELECT table_id, coalesce(context, CASE WHEN path LIKE '%comprehensive%' THEN 'OCI' WHEN path LIKE '%cash flow%' THEN 'CFS' WHEN path LIKE '%changes in equity%' THEN 'SOCIE' WHEN path LIKE '%financial position%' THEN 'SFP'
       WHEN path LIKE '%balance sheet%' THEN 'SFP' WHEN path LIKE '%income statement%' THEN 'PNL' WHEN path LIKE '%profit or loss%' THEN 'PNL' END) AS context
FROM (SELECT table_id, context, CASE table_id % 4 WHEN 0 THEN 'consolidated income statement' WHEN 1 THEN 'notes balance sheet' WHEN 2 THEN 'statement of comprehensive income, profit or loss' ELSE 'other' END AS path FROM r_tables)""")
def infer_table_context(t):
    k = F.col("table_id") % 4
    path = F.when(k == 0, "Consolidated Income Statement").when(k == 1, "notes balance sheet").when(k == 2, "Statement of comprehensive income, profit or loss").otherwise("other")
    return t.r_tables.select("table_id", L.infer_table_context(F.col("context"), path).alias("context"))


@query("a4_concept_dim", "SELECT concept_id, balance_type, unit_type, CASE WHEN concept_id = 'LARGE' THEN 'UNKNOWN' ELSE valid_context END AS valid_context FROM r_concepts")
def concept_dim(t):
    raw = t.r_concepts.withColumn("valid_context", F.when(F.col("concept_id") != "LARGE", F.col("valid_context"))).withColumn("unit_type", F.when(F.col("unit_type") == "shares", F.col("unit_type")))
    return O.concept_dim(raw)


@query("a5_label_dim", """
SELECT DISTINCT * FROM (SELECT p_type AS concept_id, p_name AS label, CASE WHEN regexp_matches(lower(p_name), '[äöüß]') THEN 'de' ELSE 'en' END AS language, 'concept' AS source, 0 AS precedence FROM part
UNION ALL SELECT 'ACC.' || p_type, p_name || ' Erträge', 'de', 'account', 2 FROM part)""")
def label_dim(t):
    a = t.part.select(F.col("p_type").alias("concept_id"), F.col("p_name").alias("label"))
    b = t.part.select(F.concat(F.lit("ACC."), F.col("p_type")).alias("concept_id"), F.concat("p_name", F.lit(" Erträge")).alias("label"))
    return O.label_dim((a, "concept", 0), (b, "account", 2))


@query("b7_candidate_concepts", """
SELECT t.doc_id, t.table_id, t.context, k.concept_id FROM r_tables t JOIN r_documents d USING (doc_id) JOIN r_concepts k ON k.valid_context = t.context WHERE d.gaap <> 'IFRS' OR k.concept_id NOT LIKE '%.UGB.%'""")
def candidate_concepts(t):
    return O.candidate_concepts(t.r_tables, t.r_concepts, t.r_documents)


@query("b15_search_concepts", "SELECT concept_id, label FROM (SELECT DISTINCT p_type AS concept_id, p_name AS label FROM part) WHERE lower(concept_id) LIKE '%gear%' OR lower(label) LIKE '%gear%' ORDER BY concept_id, label LIMIT 20")
def search_concepts(t):
    return O.search_concepts(t.part.select(F.col("p_type").alias("concept_id"), F.col("p_name").alias("label")).distinct(), "Gear")


@query("c1_match_labels_exact", f"WITH {INDEX} SELECT row_id, norm, concept_id, 1.0::DOUBLE AS confidence FROM (SELECT row_id, {NORM.format('raw')} AS norm FROM l_labels) JOIN idx USING (norm)")
def match_labels_exact(t):
    return O.match_labels_exact(t.l_labels, O.label_index(t.l_index))


@query("c2_match_labels_affix", f"""
WITH {INDEX}, r AS (SELECT row_id, {NORM.format('raw')} AS norm FROM l_labels),
c AS (SELECT row_id, norm, k, CASE WHEN k < 3 THEN CASE WHEN suffix(norm, a) THEN left(norm, (length(norm) - length(a))::INT) END ELSE CASE WHEN prefix(norm, a) THEN substr(norm, length(a) + 1) END END AS key, conf
  FROM r, (VALUES (0, ' total', 1.0), (1, ' net', 1.0), (2, ' gross', 1.0), (3, 'total ', 0.95), (4, 'thereof ', 0.9), (5, 'of which ', 0.9), (6, 'davon ', 0.9)) v(k, a, conf))
SELECT row_id, idx.concept_id, conf::DOUBLE AS confidence FROM c JOIN idx ON idx.norm = c.key WHERE c.norm NOT IN (SELECT norm FROM idx)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k) = 1""")
def match_labels_affix(t):
    return O.match_labels_affix(t.l_labels, O.label_index(t.l_index))


@query("c2b_context_guard", """
SELECT row_id, context, concept_id FROM (SELECT r.row_id, t.context, CASE WHEN r.tag IN ('LARGE', 'SMALL') THEN 'DISC.' || r.tag ELSE r.tag END AS concept_id FROM r_rows r JOIN r_tables t USING (table_id) WHERE r.tag IS NOT NULL)
WHERE concept_id NOT LIKE 'DISC%' OR (context NOT IN ('PNL', 'SFP', 'OCI', 'CFS', 'SOCIE') AND concept_id = 'DISC.LARGE' AND context = 'DISC.SEGMENTS')""")
def context_guard(t):
    m = t.r_rows.where("tag is not null").join(t.r_tables.select("table_id", "context"), "table_id")
    m = m.select("row_id", "context", F.when(F.col("tag").isin("LARGE", "SMALL"), F.concat(F.lit("DISC."), F.col("tag"))).otherwise(F.col("tag")).alias("concept_id"))
    valid = t.spark.createDataFrame([("DISC.LARGE", "DISC.SEGMENTS"), ("DISC.SMALL", "PNL")], "concept_id string, valid_context string")
    return O.match_context_guard(m, valid)


@query("c3_match_labels_fuzzy", f"""
WITH {INDEX}, q AS (SELECT DISTINCT substr(lower(p_name), 1, length(p_name) - 1) || chr(CAST(97 + p_partkey % 26 AS INT)) || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS label FROM part),
s AS (SELECT label, norm, concept_id, 1 - levenshtein(label, norm) / greatest(length(label), length(norm)) AS score FROM q, idx)
SELECT label, norm, concept_id, round(score, 6) AS score FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, length(norm), norm DESC) = 1""")
def match_labels_fuzzy(t):
    name = F.lower("p_name")
    q = t.part.select(F.concat(F.expr("substring(lower(p_name), 1, length(p_name) - 1)"), F.char(97 + F.col("p_partkey") % 26), F.when(F.col("p_partkey") % 3 == 0, "s").otherwise("")).alias("label")).where(name.isNotNull())
    return O.match_labels_fuzzy(q, O.label_index(t.l_index))


@query("d25_axis_members", """
WITH f AS (SELECT doc_id, label, min(row_id) AS ord FROM r_rows WHERE lower(label) NOT IN ('total', 'hot rod') GROUP BY ALL)
SELECT doc_id, label, printf('SEG.%03d', row_number() OVER (PARTITION BY doc_id ORDER BY ord, label)) AS member_id FROM f""")
def axis_members(t):
    return O.first_seen_members(t.r_rows.withColumnRenamed("row_id", "ord"), "SEG", ("total", "hot rod"))


@query("d49_gap_report", rf"""
WITH {INDEX}, r AS (SELECT l.table_id, {NORM.format('raw')} AS norm, raw, coalesce(t.context, 'none') AS family, t.page_no FROM l_labels l JOIN r_tables t USING (table_id))
SELECT family, norm, count(*) AS n_rows, count(DISTINCT table_id) AS n_tables, min(table_id) AS first_table, min(page_no) AS first_page, max(page_no) AS last_page, count(DISTINCT page_no) AS n_pages FROM r WHERE norm NOT IN (SELECT norm FROM idx)
  AND NOT {UNTAG.format('raw')} AND NOT {TOPIC.format('raw')} GROUP BY family, norm""")
def gap_report(t):
    return O.gap_report(t.l_labels, O.label_index(t.l_index), t.r_tables)


@query("d49_list_gaps", """
WITH g AS (SELECT user_id AS gap_id, min(event_type) AS context, CASE WHEN count(*) % 3 = 0 THEN 'open' WHEN count(*) % 3 = 1 THEN 'proposed' ELSE 'accepted' END AS status, max(ts) AS updated_at FROM events GROUP BY 1)
SELECT * FROM g WHERE status IN ('open', 'proposed') AND context = 'click'""")
def list_gaps(t):
    g = t.events.groupBy(F.col("user_id").alias("gap_id")).agg(F.min("event_type").alias("context"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("updated_at"))
    status = F.when(F.col("n") % 3 == 0, "open").when(F.col("n") % 3 == 1, "proposed").otherwise("accepted")
    return O.list_gaps(g.withColumn("status", status).drop("n"), ["open", "proposed"], "click")


@query("b15_search_documents", """
WITH s AS (SELECT user_id AS doc_id, count(*) AS n, bool_or(value > 20) AS ok FROM events GROUP BY 1), d AS (SELECT d.doc_id, d.entity, CASE WHEN n IS NULL THEN 'not_started' WHEN ok THEN 'complete' ELSE 'in_progress' END AS status FROM r_documents d LEFT JOIN s USING (doc_id))
SELECT doc_id, entity, status FROM d WHERE contains(lower(entity), '9') AND doc_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND status <> 'not_started' ORDER BY entity, doc_id LIMIT 20""")
def search_documents(t):
    from ..operators.reviews import annotation_status

    status = annotation_status(t.r_documents, t.events.select(F.col("user_id").alias("doc_id"), (F.col("value") > 20).alias("validated"), "ts"))
    allowed = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("doc_id"))
    return O.search_documents(t.r_documents, "9", allowed, status.where("status <> 'not_started'"))


TOC_SQL = "CASE " + " ".join("WHEN contains(lower(label), '" + w.replace("'", "''") + f"') THEN '{s}'" for w, s in L.TOC_LABELS) + " END"


@query("b17_classify_toc_label", f"""
WITH l AS (SELECT row_id, CASE row_id % 8 WHEN 0 THEN 'Group Management Report ' WHEN 1 THEN 'Bestätigungsvermerk' WHEN 2 THEN 'Table of Contents' WHEN 3 THEN 'Directors'' report' WHEN 4 THEN 'Vergütungsbericht' WHEN 5 THEN 'Risk report and contact' ELSE label END AS label FROM r_rows)
SELECT row_id, {TOC_SQL} AS section FROM l""")
def toc_label(t):
    k = F.col("row_id") % 8
    label = F.when(k == 0, "Group Management Report ").when(k == 1, "Bestätigungsvermerk").when(k == 2, "Table of Contents").when(k == 3, "Directors' report").when(k == 4, "Vergütungsbericht").when(k == 5, "Risk report and contact").otherwise(F.col("label"))
    return t.r_rows.select("row_id", L.classify_toc_label(label).alias("section"))


@query("b17_physical_section", f"""
WITH f AS (SELECT table_id, arg_min(label, row_idx) AS label FROM r_rows WHERE row_idx > 0 GROUP BY 1), k AS (SELECT table_id, CASE table_id % 6 WHEN 0 THEN 'TOC' WHEN 1 THEN 'ESG' WHEN 2 THEN 'X' ELSE coalesce(context, 'none') END AS kind, CASE WHEN table_id % 5 = 0 THEN 'Anlage ' ELSE '' END || coalesce(label, '') AS label FROM r_tables LEFT JOIN f USING (table_id))
SELECT table_id, kind, CASE WHEN kind IN {L.PHYSICAL} THEN kind WHEN kind LIKE 'DISC.%' THEN CASE WHEN regexp_matches(lower(label), '{"|".join(L.APPENDIX_WORDS)}') THEN 'APPENDIX' ELSE 'NOTES' END ELSE 'OTHER' END AS section FROM k""")
def physical_section(t):
    first = t.r_rows.where("row_idx > 0").groupBy("table_id").agg(F.min_by("label", "row_idx").alias("label"))
    k = F.col("table_id") % 6
    kind = F.when(k == 0, "TOC").when(k == 1, "ESG").when(k == 2, "X").otherwise(F.coalesce("context", F.lit("none")))
    label = F.concat(F.when(F.col("table_id") % 5 == 0, "Anlage ").otherwise(""), F.coalesce("label", F.lit("")))
    return t.r_tables.join(first, "table_id", "left").select("table_id", kind.alias("kind"), L.physical_section(kind, label).alias("section"))
