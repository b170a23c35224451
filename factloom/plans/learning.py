"""Queries on streams and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as M
from ..streaming import streams as K
from . import dealt
from .registry import query


def checkpoint(t) -> str:
    """A folder for a stream's checkpoint, under the shared one; a local one only in local mode."""
    from .classes import scratch

    return scratch(t, "stream")


def event_stream(t):
    """The events table as a stream of its files."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")


def vote_stream(t):
    from .shapes import SHAPES

    return t.spark.sql(SHAPES["v_votes"], events=event_stream(t))


@query("k1_consensus_stream", """
WITH v AS (SELECT *, CASE source WHEN 'human' THEN 3 WHEN 'mlp' THEN 2 ELSE 1 END AS w FROM v_votes WHERE action IN ('tag', 'dissent')),
p AS (SELECT dimension, target_id, value, sum(w)::BIGINT AS weight, count(*) AS n, max(ts) AS latest FROM v WHERE action = 'tag' GROUP BY ALL),
s AS (SELECT dimension, target_id, count(*) FILTER (action = 'dissent') AS dissent FROM v GROUP BY ALL), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dimension, target_id ORDER BY weight DESC, n DESC, latest DESC, value DESC) = 1)
SELECT dimension, target_id, value, weight, n AS agree, dissent FROM b JOIN s USING (dimension, target_id)""")
def consensus_stream(t):
    return K.winners(K.consensus_stream(vote_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), checkpoint(t), 16).read())


@query("k2_maintain_counts", """
WITH c AS (SELECT user_id AS doc_id, event_type AS kind, event_id, CASE WHEN event_id % 3 > 0 THEN -1 ELSE 1 END AS delta FROM events), r AS (SELECT *, sum(delta) OVER (PARTITION BY doc_id, kind ORDER BY event_id) AS so_far FROM c)
SELECT doc_id, kind, (sum(delta) - least(0, min(so_far)))::BIGINT AS n FROM r GROUP BY 1, 2""")
def maintain_counts(t):
    changes = event_stream(t).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), "event_id", F.when(F.col("event_id") % 3 > 0, -1).otherwise(1).alias("delta"))
    return K.maintain_counts(changes, checkpoint(t), ["doc_id", "kind"], ["event_id"], 16).read()


@query("k4_activity_stream", """
SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS action, count(*) AS n, date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed FROM events GROUP BY 1, 2, 4""")
def activity_stream(t):
    closed, _, still = K.activity_stream(event_stream(t).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action")), checkpoint(t))
    return closed.withColumn("closed", F.lit(True)).unionByName(still.withColumn("closed", F.lit(False)))


@query("k6_progress_stream", "SELECT user_id % 10 AS run_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def progress_stream(t):
    results = event_stream(t).select((F.col("user_id") % 10).alias("run_id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return K.progress_stream(results, checkpoint(t), 4).read()


WORDS = {"toc": ["cold plate"], "pnl": ["hot rod", "gear"], "sfp": ["bolt"], "oci": ["wheel"], "cfs": ["plate"], "socie": ["see note"], "notes": ["thereof"], "audit": ["31.12"], "report": ["erträge"]}


def depths(t):
    return t.r_rows.withColumns({"depth": F.when(F.col("parent_id").isNull(), 0).otherwise(1), "is_parent": F.col("parent_id").isNull()})


@query("j1_page_text", r"""
WITH c AS (SELECT table_id, (row_id - table_id * 100) AS row_idx, col_idx, text FROM l_amounts),
p AS (SELECT t.doc_id, t.page, 1 AS src, t.table_ord::BIGINT AS o, k.col_idx::BIGINT AS a, k.col_idx::BIGINT AS b, header AS x FROM r_columns k JOIN p_tables t USING (table_id) WHERE header IS NOT NULL
  UNION ALL SELECT t.doc_id, t.page, 2, t.table_ord, r.row_idx, r.row_idx, r.label FROM r_rows r JOIN p_tables t USING (table_id) UNION ALL SELECT t.doc_id, t.page, 3, t.table_ord, c.row_idx, c.col_idx, c.text FROM c JOIN p_tables t USING (table_id) WHERE NOT regexp_matches(c.text, '^[0-9.,\s()%+-]*$')
  UNION ALL SELECT doc_id, page, 4, 0, ord, ord, text FROM p_elements)
SELECT doc_id, page, left(string_agg(x, ' ' ORDER BY src, o, a, b, x), 2000) AS text FROM p GROUP BY 1, 2""")
def page_text(t):
    cells = t.l_amounts.select("table_id", (F.col("row_id") - F.col("table_id") * 100).cast("int").alias("row_idx"), "col_idx", "text")
    return M.page_text(t.r_rows.select("table_id", "row_idx", "label"), t.p_tables, t.r_columns.drop("doc_id"), t.p_elements, cells)


@query("j3b_text_features", r"""
SELECT doc_id, length(t) AS n_chars, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::INT AS n_words, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines,
       round(coalesce(length(regexp_replace(t, '[^0-9]', '', 'g')) / nullif(length(t), 0), 0), 6) AS digit_share, round(coalesce(length(regexp_replace(t, '[^A-Z]', '', 'g')) / nullif(length(t), 0), 0), 6) AS capital_share
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def text_features(t):
    return M.text_features(t.documents)


def flags(text: str, words: dict, prefix: str) -> str:
    return ", ".join(f"max(contains(lower({text}), '{w}')::INT) AS {prefix}w_{k}_{i}" for k, ws in words.items() for i, w in enumerate(ws))


def table_part(words: dict) -> str:
    return rf"""tr AS (SELECT table_id, count(*) AS n_rows, count(*) FILTER (trim(label) <> '') AS n_labelled, sum(length(trim(label)))::BIGINT AS label_chars, count(*) FILTER (regexp_matches(label, '{M.DOTTED}')) AS n_dotted, count(*) FILTER (regexp_matches(label, '{M.NUMBERED}')) AS n_numbered,
  max((parent_id IS NOT NULL)::INT) AS max_depth, sum((parent_id IS NOT NULL)::INT)::BIGINT AS sum_depth, count(*) FILTER (parent_id IS NULL) AS n_parents, sum(len(regexp_extract_all(label, '[^\x20\x09-\x0D]+')))::BIGINT AS label_words, {flags("label", words, "")} FROM r_rows GROUP BY 1),
tk AS (SELECT table_id, count(*) AS n_cols, count(*) FILTER (role = 'VALUE') AS n_value_cols, count(*) FILTER (role = 'LABEL') AS n_label_cols, coalesce(max((role = 'NOTES' OR lower(trim(header)) IN ('note', 'notes', 'anhang', 'anmerkung', 'anmerkungen'))::INT), 0) AS any_note FROM r_columns GROUP BY 1),
ts AS (SELECT p.doc_id, p.page, p.table_id, p.context, (currency IS NOT NULL)::INT AS any_currency, header_rows AS n_header_rows, abs(r - l) * abs(t - b) AS table_area, tr.* EXCLUDE (table_id), tk.* EXCLUDE (table_id) FROM p_tables p LEFT JOIN tr USING (table_id) LEFT JOIN tk USING (table_id))"""


def value_part(key: str) -> str:
    return f"""vc AS (SELECT c.*, p.doc_id, p.page, p.table_ord FROM r_cells c JOIN p_tables p USING (table_id)), vb AS (SELECT *, lag(value) OVER (PARTITION BY {key} ORDER BY table_ord, row_idx, col_idx) AS before FROM vc WHERE value IS NOT NULL),
vs AS (SELECT {key}, count(*) AS n_values, count(*) FILTER (value >= 1 AND value <= 500 AND value = floor(value)) AS n_small, max(value) AS max_value, avg(value) AS mean_value, stddev_pop(value) AS std_value, count(*) FILTER (value < 0) AS n_negative, count(before) AS n_steps, count(*) FILTER (value >= before) AS n_up FROM vb GROUP BY ALL),
vn AS (SELECT {key}, count(*) AS n_cells FROM vc GROUP BY ALL)"""


SUMMED = ["n_rows", "n_labelled", "label_chars", "n_dotted", "n_numbered", "sum_depth", "n_parents", "label_words", "n_cols", "n_value_cols", "n_header_rows", "table_area"]
FLAGS = [f"w_{k}_{i}" for k, ws in WORDS.items() for i in range(len(ws))]
MOST = ["max_depth", "any_note", "any_currency", *FLAGS]
LABEL_SQL = ", ".join(f"count(*) FILTER (label = '{v}') AS {k}" for k, v in M.LABELS.items())
ELEMENTS = ["e_count", *M.LABELS, "e_chars", "e_words", "text_area", "e_page_numbers", "e_short", "e_numeric"]
VALUES = ["n_cells", "n_values", "n_small", "max_value", "mean_value", "std_value", "n_negative", "n_steps", "n_up"]
TOC_TYPES = ["PNL", "SFP", "OCI", "CFS", "SOCIE", "NOTES"]
zero = lambda names: ", ".join(f"coalesce({c}, 0) AS {c}" for c in names)
PAGE_SUMS = rf"""{table_part(WORDS)}, {value_part("doc_id, page")},
tp AS (SELECT doc_id, page, count(*) AS n_tables, max(n_cols) AS max_cols, {", ".join(f"sum({c}) AS {c}" for c in SUMMED)}, {", ".join(f"max({c}) AS {c}" for c in MOST)}, {", ".join(f"max(coalesce((context = '{x}')::INT, 0)) AS any_{x.lower()}" for x in ("PNL", "SFP", "CFS"))} FROM ts GROUP BY 1, 2),
el AS (SELECT doc_id, page, count(*) AS e_count, {LABEL_SQL}, sum(length(text))::BIGINT AS e_chars, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS e_words, sum(abs(r - l) * abs(t - b)) AS text_area, count(*) FILTER (regexp_matches(text, '{M.PAGE_NUMBER}')) AS e_page_numbers,
  count(*) FILTER (length(trim(text)) BETWEEN 1 AND 49) AS e_short, count(*) FILTER (trim(text) <> '' AND length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) > 0.3) AS e_numeric, {flags("text", WORDS, "e")} FROM p_elements GROUP BY 1, 2),
tc AS (SELECT doc_id, page, {", ".join(f"max((type = '{x}')::INT) AS toc_{x.lower()}" for x in TOC_TYPES)} FROM (SELECT doc_id, (row_idx * 3 + doc_id % 5)::INT AS page, CASE row_idx % 3 WHEN 0 THEN 'PNL' WHEN 1 THEN 'NOTES' ELSE 'SFP' END AS type FROM r_rows WHERE table_id % 4 = 0 AND row_idx > 0) GROUP BY 1, 2),
ps AS (SELECT p.doc_id, p.page, p.n_pages, p.width, p.height, {zero(["n_tables", "max_cols", *SUMMED, *[m for m in MOST if m not in FLAGS], "any_pnl", "any_sfp", "any_cfs", *VALUES, *ELEMENTS, *[f"toc_{x.lower()}" for x in TOC_TYPES]])},
  {", ".join("(" + " + ".join(f"greatest(coalesce(w_{k}_{i}, 0), coalesce(ew_{k}_{i}, 0))" for i in range(len(ws))) + f") AS kw_{k}" for k, ws in WORDS.items())}
  FROM p_pages p LEFT JOIN tp USING (doc_id, page) LEFT JOIN vn USING (doc_id, page) LEFT JOIN vs USING (doc_id, page) LEFT JOIN el USING (doc_id, page) LEFT JOIN tc USING (doc_id, page))"""


def made(wanted: dict) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in wanted.items())


def sums(t):
    r = F.col("row_idx")
    toc = t.r_rows.where("table_id % 4 = 0 and row_idx > 0").select("doc_id", (r * 3 + F.col("doc_id") % 5).cast("int").alias("page"), F.when(r % 3 == 0, "PNL").when(r % 3 == 1, "NOTES").otherwise("SFP").alias("type"))
    return M.page_sums(t.p_pages, t.p_tables, depths(t), t.r_cells, t.r_columns, t.p_elements, toc, WORDS)


@query("j2_page_features", f"WITH {PAGE_SUMS} SELECT doc_id, page, {made(M.PAGE_FEATURES)} FROM ps")
def page_feature_vector(t):
    return M.features(sums(t), ["doc_id", "page"], M.PAGE_FEATURES)


@query("j3_page_structure", f"WITH {PAGE_SUMS} SELECT doc_id, page, {made(M.STRUCTURE_FEATURES)} FROM ps")
def page_structure(t):
    return M.features(sums(t), ["doc_id", "page"], M.STRUCTURE_FEATURES)


@query("j3b_page_layout", f"WITH {PAGE_SUMS} SELECT doc_id, page, {made(M.LAYOUT_FEATURES)} FROM ps")
def page_layout(t):
    return M.features(sums(t), ["doc_id", "page"], M.LAYOUT_FEATURES)


STATEMENT_WORDS = ["hot rod", "gear", "bolt"]
TABLE_COLUMNS = [c for c in ["n_rows", "n_cols", "n_value_cols", "n_label_cols", "any_note", "n_numbered", "n_labelled", "label_chars", "n_dotted", *[f"w_s_{i}" for i in range(3)]]]


@query("j4_table_features", f"""
WITH {table_part({"s": STATEMENT_WORDS})}, {value_part("table_id")}, j AS (SELECT doc_id, page, table_id, n_header_rows, any_currency, {zero([*TABLE_COLUMNS, *VALUES])} FROM ts LEFT JOIN vn USING (table_id) LEFT JOIN vs USING (table_id)), k AS (SELECT *, w_s_0 + w_s_1 + w_s_2 AS kw FROM j)
SELECT doc_id, table_id, {made(M.TABLE_FEATURES)} FROM k""")
def table_features(t):
    return M.table_features(t.p_tables, depths(t), t.r_cells, t.r_columns, STATEMENT_WORDS)


@query("j5_tfidf_features", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([\p{L}]+)', 1)) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
top AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY df DESC, encode(term) LIMIT 2000)
SELECT doc_id, term, round((1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 6) AS weight FROM tf JOIN top USING (term)""")
def tfidf_features(t):
    return M.tfidf_features(t.documents.select("doc_id", "text"))


@query("j6_balance_classes", """
WITH l AS (SELECT toxic, doc_id FROM labels WHERE toxic IS NOT NULL), s AS (SELECT toxic, count(*) AS n FROM l GROUP BY 1), r AS (SELECT l.*, greatest(least((SELECT max(n) FROM s), 500) / n, 1) AS rate, ('0x' || substr(md5(doc_id::VARCHAR), 1, 5))::BIGINT / 1048576 AS chance FROM l JOIN s USING (toxic))
SELECT toxic, doc_id, unnest(range(1, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT + 1))::INT AS copy FROM r""")
def balance_classes(t):
    labels = t.labels.where("toxic is not null").select("doc_id", "toxic")
    return M.balance_classes(labels, "toxic")


def held_out(key: str):
    """A third of the rows, by a digest of the key: what no model is trained on."""
    return F.crc32(F.col(key).cast("string")) % 3 == 0


def page_classes(t):
    """J2's features of every page, with the class of its tables (a page without any is "none")."""
    # rows, cells and tables are read by several of the sums: dealt by table once
    dealt.by_table(t, "r_tables", "r_rows")
    cls = t.p_tables.groupBy("doc_id", "page").agg(F.max("context").alias("cls"))
    return M.features(sums(t), ["doc_id", "page"], M.PAGE_FEATURES).join(cls, ["doc_id", "page"], "left").withColumn("cls", F.coalesce("cls", F.lit("none")))


@query("j7_page_classifier")
def page_classifier(t):
    """The class of every page from J2's features: trained on two thirds of the documents, classes balanced (J6); the three best classes of all pages."""
    from ..operators.tagging import shared_table

    pages = shared_table(page_classes(t).withColumnRenamed("cls", "label").withColumn("held_out", held_out("doc_id")), "pages", dealt=True)
    train = shared_table(M.balance_classes(pages.where("not held_out"), "label").select("label", *M.PAGE_FEATURES), "train")  # read by each stage of the fit
    model = M.train_page_classifier(train, list(M.PAGE_FEATURES), "label")
    return M.top_k_predictions(model.transform(pages), ["doc_id", "page", "held_out", "label"], 3)


@query("e11_top_k_predictions", """
WITH s AS (SELECT o_orderkey, unnest([o_orderkey % 7 / 10, o_custkey % 5 / 10, o_orderkey % 11 / 20, 0.25, o_custkey % 3 / 10, 0.1]) AS p, unnest(range(6)) AS cls FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, cls) AS rank FROM s)
SELECT o_orderkey, rank::INT AS rank, cls::INT AS cls, round(p, 4)::DOUBLE AS score FROM r WHERE rank <= 5""")
def top_k_predictions(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.array(o % 7 / 10, c % 5 / 10, o % 11 / 20, F.lit(0.25), c % 3 / 10, F.lit(0.1))
    return M.top_k_predictions(t.orders.select("o_orderkey", p.alias("probability")), ["o_orderkey"], 5)


OUT_OF_FOLD = ["page_le5", "page_le15", "rel_position", "table_count", "total_rows", "total_value_cols", "has_note_col", "has_currency", "pct_small_ints", "pct_monotonic", "pct_rows_with_label", "text_element_count", "kw_pnl", "kw_sfp"]


@query("j8_leave_one_out", f"""
WITH {PAGE_SUMS}, f AS (SELECT doc_id, page, {made({k: M.PAGE_FEATURES[k] for k in OUT_OF_FOLD})} FROM ps), lab AS (SELECT doc_id, page, max(context) AS cls FROM p_tables GROUP BY 1, 2),
x AS (SELECT f.doc_id, f.page, coalesce(cls, 'none') AS cls, unnest([{", ".join(f"{k}::DOUBLE" for k in OUT_OF_FOLD)}]) AS v, unnest(range({len(OUT_OF_FOLD)})) AS i FROM f LEFT JOIN lab ON lab.doc_id = f.doc_id AND lab.page = f.page),
own AS (SELECT doc_id, cls, i, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY ALL), tot AS (SELECT cls, i, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM own GROUP BY ALL),
m AS (SELECT d.doc_id, t.cls, t.i, t.n - coalesce(o.n, 0) AS n, (t.s - coalesce(o.s, 0)) / (t.n - coalesce(o.n, 0)) AS mean, (t.q - coalesce(o.q, 0)) / (t.n - coalesce(o.n, 0)) AS sq FROM (SELECT DISTINCT doc_id FROM x) d CROSS JOIN tot t LEFT JOIN own o ON o.doc_id = d.doc_id AND o.cls = t.cls AND o.i = t.i),
g AS (SELECT *, greatest(sq - mean * mean, 0.001) AS var FROM m WHERE n > 0),
sc AS (SELECT x.doc_id, x.page, x.cls, g.cls AS c, ln(any_value(g.n) / (SELECT sum(n) FROM tot WHERE i = 0)) + sum(-0.5 * (ln(var) + (v - mean) * (v - mean) / var)) AS score FROM x JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, c) AS nth, score - lead(score) OVER (PARTITION BY doc_id, page ORDER BY score DESC, c) AS margin FROM sc)
SELECT doc_id, page, cls, c AS predicted, round(margin, 3) AS margin FROM r WHERE nth = 1""")
def leave_one_out(t):
    """The class of every page by a model that has not seen its document."""
    from ..operators.boosting import out_of_fold
    from ..operators.tagging import bucketed_table

    pages = bucketed_table(page_classes(t).select("doc_id", "page", "cls", *OUT_OF_FOLD), "pages", "doc_id", t.orders.count() // dealt.BUCKET + 8)
    return out_of_fold(pages, "doc_id", "cls", OUT_OF_FOLD).select("doc_id", "page", "cls", "predicted", F.round("margin", 3).alias("margin"))


@query("j9_embedding_classifier")
def embedding_classifier(t):
    """Classes of vectors, joined with their length and mean, by boosted trees: trained on two thirds, predicted for all."""
    from ..operators.boosting import predict_boosted, train_boosted
    from ..operators.tagging import shared_table

    total = lambda f: F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x)
    n = 64
    e = t.embeddings.where("label is not null and embedding is not null").select("vec_id", F.col("label").cast("long").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)],
        F.sqrt(total(lambda v: v.cast("double") * v)).alias("norm"), (total(lambda v: v.cast("double")) / F.size("embedding")).alias("mean"), held_out("vec_id").alias("held_out"))
    e, names = shared_table(e, "vectors"), [*[f"e{i}" for i in range(n)], "norm", "mean"]
    model = train_boosted(e.where("not held_out"), names, "label")
    return predict_boosted(e, names, model).select("vec_id", "held_out", "label", "predicted", F.transform("probability", lambda p: F.round(p, 6)).alias("probability"))


@query("j10_layout_grid", """
WITH b AS (SELECT l_orderkey AS page_id, l_returnflag AS kind, l_discount * 5 AS x0, l_tax * 5 AS y0, least(l_discount * 5 + 0.25, 1) AS x1, least(l_tax * 5 + 0.125, 1) AS y1 FROM lineitem),
c AS (SELECT DISTINCT page_id, kind, least(greatest(floor(x0 * 48)::INT, 0), 47) AS xa, least(greatest(ceil(x1 * 48)::INT - 1, 0), 47) AS xb, least(greatest(floor(y0 * 64)::INT, 0), 63) AS ya, least(greatest(ceil(y1 * 64)::INT - 1, 0), 63) AS yb FROM b),
r AS (SELECT page_id, kind, xa, greatest(xa, xb) AS xb, unnest(range(ya, greatest(ya, yb) + 1))::INT AS gy FROM c), u AS (SELECT DISTINCT page_id, kind, gy, unnest(range(xa, xb + 1))::INT AS gx FROM r)
SELECT page_id, kind, gy, count(*) AS n_cells, bit_or((1::BIGINT << gx)) AS cells FROM u GROUP BY 1, 2, 3""")
def layout_grid(t):
    return M.layout_rows(boxes(t.lineitem))


def boxes(lines):
    return lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"), F.least(F.col("l_discount") * 5 + 0.25, F.lit(1.0)).alias("x1"), F.least(F.col("l_tax") * 5 + 0.125, F.lit(1.0)).alias("y1"))


@query("j11_feature_separation", """
SELECT unnest(['n_chars', 'quality']) AS feature, unnest([round(abs(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0)) / nullif(stddev_pop(n_chars), 0), 4), round(abs(avg(quality) FILTER (toxic = 1) - avg(quality) FILTER (toxic = 0)) / nullif(stddev_pop(quality), 0), 4)]) AS separation
FROM documents JOIN labels USING (doc_id)""")
def feature_separation(t):
    return M.feature_separation(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), ["n_chars", "quality"], "toxic")
