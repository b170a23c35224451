"""Page features and classifiers with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizer, IDF, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Words of each page class, searched in lower-cased text. Fixed values.
CLASS_WORDS = {
    "toc": ["inhaltsverzeichnis", "table of contents", "contents", "verzeichnis"], "pnl": ["revenue", "umsatz", "profit", "loss", "ebit", "ergebnis", "income statement", "erfolgsrechnung"],
    "sfp": ["assets", "aktiva", "passiva", "liabilities", "equity", "eigenkapital", "bilanz", "financial position"], "oci": ["other comprehensive", "sonstiges ergebnis", "gesamtergebnis"],
    "cfs": ["cash flow", "kapitalfluss", "zahlungsmittel", "geldfluss"], "socie": ["changes in equity", "eigenkapitalveränderung"], "notes": ["notes to", "anhang", "erläuterungen"],
    "audit": ["bestätigungsvermerk", "audit opinion", "prüfungsurteil"], "report": ["lagebericht", "management report"],
}
NUMBERED, DOTTED, PAGE_NUMBER = r"^\s*[0-9]+\s*[.)]\s+\S", r"[.]{4}|…", r"[.\s…·]{3,}\s*[0-9]+\s*$"
LABELS = {"e_headers": "section_header", "e_lists": "list_item", "e_notes": "footnote", "e_page_headers": "page_header", "e_captions": "caption", "e_texts": "text"}


def page_text(rows: DataFrame, tables: DataFrame, columns: DataFrame, elements: DataFrame, cells: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Each page's column headers, row labels, cells that aren't numbers, and text elements, in this order, cut at max_chars.
    cells: table_id, row_idx, col_idx, text."""
    t = tables.select("doc_id", "page", "table_id", "table_ord")
    one = lambda df, src, a, b, text: df.select("doc_id", "page", F.struct(F.lit(src).alias("src"), F.col("table_ord").cast("long").alias("t"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(text).alias("x")).alias("p"))
    parts = one(columns.where("header is not null").join(t, "table_id"), 1, "col_idx", "col_idx", "header").unionByName(one(rows.select("table_id", "row_idx", "label").join(t, "table_id"), 2, "row_idx", "row_idx", "label"))
    parts = parts.unionByName(one(cells.where(~F.col("text").rlike(r"^[0-9.,\s()%+-]*$")).join(t, "table_id"), 3, "row_idx", "col_idx", "text"))
    parts = parts.unionByName(one(elements.withColumn("table_ord", F.lit(0)), 4, "ord", "ord", "text"))
    return parts.groupBy("doc_id", "page").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["x"]), " "), 1, max_chars).alias("text"))


def text_features(docs: DataFrame) -> DataFrame:
    """Features of a text: characters, words, lines, share of digits and capitals."""
    t = F.coalesce("text", F.lit(""))
    n = F.char_length(t)
    share = lambda p: F.round(F.coalesce(F.try_divide(F.char_length(F.regexp_replace(t, p, "")), n), F.lit(0.0)), 6)
    return docs.select("doc_id", n.alias("n_chars"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"), (F.regexp_count(t, F.lit("\n")) + 1).alias("n_lines"), share("[^0-9]").alias("digit_share"), share("[^A-Z]").alias("capital_share"))


def has_word(text: Column, word: str) -> Column:
    return F.contains(F.lower(text), F.lit(word)).cast("int")


def table_sums(tables: DataFrame, rows: DataFrame, columns: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Sums over each table's rows and columns. rows have depth and is_parent; tables doc_id, page, context, currency, header_rows and a box (l, r, b, t)."""
    label = F.trim("label")
    r = rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(label != "").alias("n_labelled"), F.sum(F.length(label)).alias("label_chars"), F.count_if(F.col("label").rlike(DOTTED)).alias("n_dotted"), F.count_if(F.col("label").rlike(NUMBERED)).alias("n_numbered"),
        F.max("depth").alias("max_depth"), F.sum("depth").alias("sum_depth"), F.count_if("is_parent").alias("n_parents"), F.sum(F.regexp_count("label", F.lit(r"[^\x20\x09-\x0D]+"))).alias("label_words"),
        *[F.max(has_word(F.col("label"), w)).alias(f"w_{k}_{i}") for k, ws in words.items() for i, w in enumerate(ws)],
    )
    note = (F.col("role") == "NOTES") | F.lower(F.trim("header")).isin("note", "notes", "anhang", "anmerkung", "anmerkungen")
    c = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cols"), F.count_if(F.col("role") == "VALUE").alias("n_value_cols"), F.count_if(F.col("role") == "LABEL").alias("n_label_cols"), F.coalesce(F.max(note.cast("int")), F.lit(0)).alias("any_note"))
    area = F.abs(F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b"))
    t = tables.select("doc_id", "page", "table_id", "context", F.col("currency").isNotNull().cast("int").alias("any_currency"), F.col("header_rows").alias("n_header_rows"), area.alias("table_area"))
    t = t.join(r, "table_id", "left").join(c, "table_id", "left")
    return t.fillna(0, [x for x in t.columns if x not in ("doc_id", "page", "table_id", "context")])


def value_sums(cells: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """Sums over the values of each key (a table, or a page), in reading order."""
    c = cells.join(tables.select("doc_id", "page", "table_id", "table_ord"), "table_id")
    n = c.groupBy(*key).agg(F.count(F.lit(1)).alias("n_cells"))
    v = F.col("value")
    known = c.where("value is not null").withColumn("before", F.lag("value").over(Window.partitionBy(*key).orderBy("table_ord", "row_idx", "col_idx")))
    s = known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if((v >= 1) & (v <= 500) & (v == F.floor(v))).alias("n_small"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"),
        F.count_if(v < 0).alias("n_negative"), F.count("before").alias("n_steps"), F.count_if(v >= F.col("before")).alias("n_up"),
    )
    return n.join(s, key, "left").fillna(0)


def page_sums(pages: DataFrame, tables: DataFrame, rows: DataFrame, cells: DataFrame, columns: DataFrame, elements: DataFrame, toc: DataFrame, words: dict[str, list[str]] = CLASS_WORDS) -> DataFrame:
    """What all page features are made of: sums over a page's tables, values and text elements, and the section types that a table of contents
    gives it (toc: doc_id, page, type). Each side is summed up to pages before it meets the spine. pages: doc_id, page, n_pages, width, height."""
    key = ["doc_id", "page"]
    t = table_sums(tables, rows, columns, words)
    flags = [f"w_{k}_{i}" for k, ws in words.items() for i in range(len(ws))]
    most = ["max_depth", "any_note", "any_currency", *flags]
    add = [c for c in t.columns if c not in (*key, "table_id", "context", *most)]
    t = t.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_tables"), F.max("n_cols").alias("max_cols"), *[F.sum(c).alias(c) for c in add], *[F.max(c).alias(c) for c in most], *[F.max(F.coalesce((F.col("context") == x).cast("int"), F.lit(0))).alias(f"any_{x.lower()}") for x in ("PNL", "SFP", "CFS")]
    )
    text, box = F.col("text"), F.abs(F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b"))
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))
    e = elements.groupBy(*key).agg(
        F.count(F.lit(1)).alias("e_count"), *[F.count_if(F.col("label") == v).alias(k) for k, v in LABELS.items()], F.sum(F.length(text)).alias("e_chars"), F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).alias("e_words"), F.sum(box).alias("text_area"),
        F.count_if(text.rlike(PAGE_NUMBER)).alias("e_page_numbers"), F.count_if(F.length(F.trim(text)).between(1, 49)).alias("e_short"), F.count_if((F.trim(text) != "") & (digits > 0.3)).alias("e_numeric"),
        *[F.max(has_word(text, w)).alias(f"e{f}") for f, (k, w) in zip(flags, ((k, w) for k, ws in words.items() for w in ws), strict=True)],
    )
    refs = toc.groupBy(*key).agg(*[F.max((F.col("type") == x).cast("int")).alias(f"toc_{x.lower()}") for x in ("PNL", "SFP", "OCI", "CFS", "SOCIE", "NOTES")])
    out = pages
    for side in (t, value_sums(cells, tables, key), e, refs):
        out = out.join(side, key, "left")
    out = out.fillna(0)
    hits = {f"kw_{k}": sum((F.greatest(f"w_{k}_{i}", f"ew_{k}_{i}") for i in range(len(ws))), F.lit(0)) for k, ws in words.items()}
    return out.withColumns(hits).drop(*flags, *[f"e{f}" for f in flags])


SHARE = "round({} / greatest({}, 1), 6)"
#: Features of a page as expressions over page_sums.
PAGE_FEATURES = {
    "page_le5": "CASE WHEN page <= 5 THEN 1 ELSE 0 END", "page_le15": "CASE WHEN page <= 15 THEN 1 ELSE 0 END", "rel_position": SHARE.format("page", "n_pages"), "has_table": "CASE WHEN n_tables > 0 THEN 1 ELSE 0 END",
    "table_count": "n_tables", "total_rows": "n_rows", "total_cols": "n_cols", "total_value_cols": "n_value_cols", "total_header_rows": "n_header_rows", "has_note_col": "any_note", "has_currency": "any_currency",
    "pct_small_ints": SHARE.format("n_small", "n_values"), "pct_monotonic": SHARE.format("n_up", "n_steps"), "top_value": "round(least(max_value, 1e8), 2)", "mean_abs": "round(least(abs(mean_value), 1e8), 7)", "deviation": "round(least(std_value, 1e8), 4)",
    "value_count": "n_values", "pct_negative": SHARE.format("n_negative", "n_values"), "statement_kw_count": "kw_pnl + kw_sfp + kw_oci + kw_cfs + kw_socie", "note_pattern_count": "n_numbered", "pct_rows_with_label": SHARE.format("n_labelled", "n_rows"),
    "avg_label_len": "round(least(label_chars / greatest(n_labelled, 1), 200), 4)", "pct_dotleader": SHARE.format("n_dotted", "n_rows"), "text_element_count": "e_count", "section_header_count": "e_headers", "list_item_count": "e_lists",
    "text_char_count": "least(e_chars, 50000)", "avg_text_len": "round(least(e_chars / greatest(e_count, 1), 500), 4)", "has_page_number_list": "CASE WHEN e_page_numbers >= 3 THEN 1 ELSE 0 END", "pct_short_lines": SHARE.format("e_short", "e_count"), "pct_numeric_lines": SHARE.format("e_numeric", "e_count"),
    **{f"kw_{k}": f"kw_{k}" for k in ("toc", "pnl", "sfp", "oci", "cfs", "socie", "notes")}, **{f"toc_ref_{k}": f"toc_{k}" for k in ("pnl", "sfp", "oci", "cfs", "socie", "notes")}, "toc_ref_any": "greatest(toc_pnl, toc_sfp, toc_oci, toc_cfs, toc_socie, toc_notes)",
}
#: Features of a page's structure.
STRUCTURE_FEATURES = {
    "n_tables": "n_tables", "n_texts": "e_count", "n_section_headers": "e_headers", "n_list_items": "e_lists", "n_footnotes": "e_notes", "n_page_headers": "e_page_headers", "n_captions": "e_captions", "n_rows": "n_rows", "n_numeric": "n_values", "numeric_density": SHARE.format("n_values", "n_cells"),
    "max_cols": "max_cols", "has_header_rows": "CASE WHEN n_header_rows > 0 THEN 1 ELSE 0 END", "max_depth": "max_depth", "mean_depth": SHARE.format("sum_depth", "n_rows"), "n_parents": "n_parents", "table_share": SHARE.format("table_area", "width * height"), "text_share": SHARE.format("text_area", "width * height"),
    "table_to_text": SHARE.format("table_area", "text_area"), "rel_position": SHARE.format("page", "n_pages"), "is_front": "CASE WHEN page <= 2 THEN 1 ELSE 0 END", "any_pnl": "any_pnl", "any_sfp": "any_sfp", "any_cfs": "any_cfs",
    **{f"says_{k}": f"CASE WHEN kw_{k} > 0 THEN 1 ELSE 0 END" for k in ("audit", "toc", "notes", "sfp", "report", "pnl", "cfs")},
}
#: Features of a page's layout.
LAYOUT_FEATURES = {
    "page_no": "page", "rel_pos": SHARE.format("page", "n_pages"), "is_first_3": "CASE WHEN page <= 3 THEN 1 ELSE 0 END", "word_count": "label_words + e_words", "text_chars": "e_chars", "text_density": "round(e_chars / (width * height), 8)", "text_coverage": "round(least(text_area / (width * height), 1), 6)",
    "n_tables": "n_tables", "total_rows": "n_rows", "total_cols": "n_cols", "total_value_cols": "n_value_cols", "total_header_rows": "n_header_rows", "table_coverage": "round(least(table_area / (width * height), 1), 6)", "numeric_ratio": SHARE.format("n_values", "n_cells"),
    "n_section_headers": "e_headers", "n_list_items": "e_lists", "n_paragraphs": "e_texts", "max_indent": "max_depth", "mean_indent": SHARE.format("sum_depth", "n_rows"),
}
#: Features of a table.
TABLE_FEATURES = {
    "row_count": "n_rows", "col_count": "n_cols", "value_col_count": "n_value_cols", "label_col_count": "n_label_cols", "has_note_column": "any_note", "header_row_count": "n_header_rows", "has_currency": "any_currency", "pct_small_ints": SHARE.format("n_small", "n_values"),
    "pct_monotonic": SHARE.format("n_up", "n_steps"), "top_value": "round(max_value, 2)", "mean_value": "round(mean_value, 7)", "deviation": "round(std_value, 4)", "value_count": "n_values", "pct_negative": SHARE.format("n_negative", "n_values"), "fill": SHARE.format("n_values", "n_cells"), "statement_kw_count": "kw",
    "note_pattern_count": "n_numbered", "pct_rows_with_label": SHARE.format("n_labelled", "n_rows"), "avg_label_len": "round(label_chars / greatest(n_labelled, 1), 4)", "pct_dotleader": SHARE.format("n_dotted", "n_rows"), "page_le5": "CASE WHEN page <= 5 THEN 1 ELSE 0 END", "page_le15": "CASE WHEN page <= 15 THEN 1 ELSE 0 END",
}


def features(sums: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """Features from sums, as columns."""
    return sums.select(*keys, *[F.expr(x).alias(n) for n, x in wanted.items()])


def feature_vector(table: DataFrame, keys: list[str], name: str = "features") -> DataFrame:
    """The columns of a feature table but keys as one vector."""
    return VectorAssembler(inputCols=[c for c in table.columns if c not in keys], outputCol=name).transform(table).select(*keys, name)


def table_features(tables: DataFrame, rows: DataFrame, cells: DataFrame, columns: DataFrame, words: list[str]) -> DataFrame:
    """Descriptive features of each table."""
    t = table_sums(tables, rows, columns, {"s": words}).withColumn("kw", sum((F.col(f"w_s_{i}") for i in range(len(words))), F.lit(0)))
    return features(t.join(value_sums(cells, tables, ["table_id"]), "table_id", "left").fillna(0), ["doc_id", "table_id"], TABLE_FEATURES)


class Sublinear(Transformer):
    """Term counts as 1 + log(count)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("tf", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))))


def tfidf_features(docs: DataFrame, vocab: int = 2000, min_df: int = 2) -> DataFrame:
    """The weight of each term of each document, (1 + log tf) * (log((n + 1) / (df + 1)) + 1), for the `vocab` terms that most documents have. docs: doc_id, text."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}]+)"), 1)).alias("term"))
    tf = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    top = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(vocab)
    weight = (1 + F.log("tf")) * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    return tf.join(F.broadcast(top), "term").select("doc_id", "term", F.round(weight, 6).alias("weight"))  # at most vocab terms


def tfidf_pipeline(vocab: int = 2000, min_df: int = 2) -> list:
    """Sublinear term frequencies times inverse document frequencies."""
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+"), CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocab, minDF=min_df), Sublinear(), IDF(inputCol="tf", outputCol="tfidf"),
    ]


def balance_classes(df: DataFrame, label: str, cap: int = 500) -> DataFrame:
    """Rows of each class repeated up to the size of the largest one, or cap: whole repeats, and one more for a digest's share."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    goal = min(sizes.agg(F.max("n")).first()[0] or 0, cap)  # one number
    rate = F.greatest(F.lit(goal) / F.col("n"), F.lit(1.0))
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != label]))
    chance = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(1 << 20)
    whole = F.floor(rate)
    times = F.when(rate == whole, whole).otherwise(whole + (chance < rate - whole).cast("int")).cast("int")  # a row of a class of whole repeats needs no digest
    return df.join(F.broadcast(sizes), label).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("n")


def train_page_classifier(train: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (64, 32), seed: int = 42):
    """Scaled features and a multilayer perceptron."""
    classes = train.select(label).distinct().count()
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x"), StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[len(features), *hidden, classes], maxIter=60, seed=seed)]
    return Pipeline(stages=stages).fit(train)


def top_k_predictions(pred: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The best k classes of each row with their scores (probability: a vector or an array). Sorting is inside a row, so nothing is shuffled."""
    p_ = F.col("probability") if pred.schema["probability"].dataType.typeName() == "array" else vector_to_array("probability")
    best = F.slice(F.reverse(F.array_sort(F.transform(p_, lambda p, i: F.struct(p.alias("score"), (-i).alias("o"))))), 1, k)
    return pred.select(*keys, F.posexplode(best).alias("rank", "top")).select(*keys, (F.col("rank") + 1).alias("rank"), (-F.col("top.o")).alias("cls"), F.round("top.score", 4).alias("score"))


def layout_rows(boxes: DataFrame, h: int = 64, w: int = 48) -> DataFrame:
    """Cells of a grid that each page's boxes cover, a row of cells as one bit mask (w <= 63). boxes: page_id, kind, x0, y0, x1, y1 as shares of the page.
    A box is a row for each row of cells that it covers, and its mask there is arithmetic; masks are combined before the one shuffle."""
    cell = lambda c, n, up: F.least(F.greatest((F.ceil(F.col(c) * n) - 1 if up else F.floor(F.col(c) * n)).cast("int"), F.lit(0)), F.lit(n - 1))
    b = boxes.select("page_id", "kind", cell("y0", h, False).alias("ya"), cell("y1", h, True).alias("yb"), cell("x0", w, False).alias("xa"), cell("x1", w, True).alias("xb"))
    mask = F.expr("shiftleft(shiftleft(1L, greatest(xa, xb) - xa + 1) - 1L, xa)")
    rows = b.select("page_id", "kind", F.explode(F.sequence("ya", F.greatest("ya", "yb"))).alias("gy"), mask.alias("mask"))
    return rows.groupBy("page_id", "kind", "gy").agg(F.bit_or("mask").alias("cells")).select("page_id", "kind", "gy", F.bit_count("cells").cast("long").alias("n_cells"), "cells")


def feature_separation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """How far apart the classes 1 and 0 are in each feature: difference of means over the deviation. One aggregate for all features."""
    one = [F.struct(F.lit(f).alias("feature"), F.round(F.abs(F.avg(F.when(F.col(label) == 1, F.col(f))) - F.avg(F.when(F.col(label) == 0, F.col(f)))) / F.nullif(F.stddev_pop(f), F.lit(0.0)), 4).alias("separation")) for f in features]
    return df.agg(F.array(*one).alias("a")).select(F.explode("a").alias("sep")).select("sep.feature", "sep.separation")
