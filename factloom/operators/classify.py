"""Classification of tables: keyword rules, priority chains, tables of contents, checks of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyword_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The context of the first rule (pattern, context) that a text fits. One generated chain of tests: evaluation stops at the first hit."""
    out = F.lit(None).cast("string")
    for pattern, context in reversed(rules):
        out = F.when(text.rlike(pattern), context).otherwise(out)
    return out


#: (block, field, pattern, context), tried in this order. Fields: the labels' first ten, all labels, the column headers, the first label; lower-cased.
RULES = [
    (1, "first10", "total assets|summe (?:der )?aktiva|bilanzsumme", "SFP"), (1, "first10", "non-current assets|langfristige vermögenswerte|anlagevermögen", "SFP"), (1, "first10", "equity and liabilities|eigenkapital und schulden|passiva", "SFP"),
    (1, "first10", "cash flows? from operating|kapitalfluss aus|geldfluss aus|cashflow aus", "CFS"), (1, "all", "cash and cash equivalents at (?:the )?(?:beginning|end)|finanzmittel(?:bestand)? am", "CFS"),
    (1, "first10", "items that (?:may|will)(?: not)? be reclassified|umgegliedert", "OCI"), (1, "first10", "other comprehensive income|sonstiges ergebnis", "OCI"), (1, "first10", "comprehensive income for the (?:year|period)|gesamtergebnis", "OCI"),
    (1, "first10", "^revenue|umsatzerlöse|net sales", "PNL"), (1, "first10", "cost of (?:sales|materials)|materialaufwand|herstellungskosten", "PNL"), (1, "all", "earnings per share|ergebnis je aktie", "PNL"), (1, "all", "profit before tax|ergebnis vor (?:ertrag)?steuern", "PNL"),
    (2, "headers", "share capital.*(?:retained|reserves)|grundkapital.*rücklagen", "SOCIE"), (2, "all", "balance (?:at|as of) 1 january.*dividend|stand (?:am )?1[.]1[.].*dividende", "SOCIE"), (2, "headers", "non-controlling interests.*total equity", "SOCIE"),
    (2, "all", "land and buildings|grundstücke und bauten|technische anlagen", "DISC.PPE"), (2, "all", "goodwill.*(?:brands|customer|licen[cs]es)|firmenwert", "DISC.INTANGIBLES"), (2, "all", "right-of-use|nutzungsrecht|lease liabilit", "DISC.LEASES"),
    (2, "all", "deferred tax|latente steuer", "DISC.TAX"), (2, "all", "defined benefit|abfertigung|pensionsrückstellung", "DISC.EMPLOYEE"), (2, "all", "provisions? for|rückstellungen für", "DISC.PROVISIONS"), (2, "all", "raw materials|finished goods|vorräte|fertige erzeugnisse", "DISC.INVENTORIES"),
    (2, "all", "trade receivables|forderungen aus lieferungen", "DISC.RECEIVABLES"), (2, "all", "associates?|joint ventures?|at equity", "DISC.ASSOCIATES"), (2, "all", "level [123]|fair value hierarch|stufe [123]", "DISC.FIN_INST"), (2, "all", "bonds?|anleihen|bank loans", "DISC.BORROWINGS"),
    (2, "all", "wages|salaries|löhne|gehälter", "DISC.PERSONNEL"), (2, "all", "weighted average number of shares|durchschnittliche anzahl", "DISC.EPS"), (2, "all", "audit fees|prüfungshonorar", "DISC.AUDIT_FEES"),
    (3, "headers", "segment|eliminations?|konsolidierung", "DISC.SEGMENTS"), (3, "headers", "up to 1 year.*(?:5 years|over)|bis 1 jahr.*über 5", "DISC.MATURITY"), (3, "headers", "carrying amount.*fair value|buchwert.*zeitwert", "DISC.FIN_INST"), (3, "headers", "acquisition cost.*depreciation|anschaffungskosten.*abschreibung", "DISC.PPE"),
    (3, "first", "^notes?$|^anhang", "NOTES"), (3, "first", "^equity|^eigenkapital", "SFP"), (3, "first", "^operating result|^betriebsergebnis", "PNL"),
]


def table_texts(rows: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """The lower-cased texts that rules look at, and whether the table has values."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.lower("label").alias("l")))), lambda x: x["l"])
    r = rows.groupBy("table_id").agg(in_order.alias("l"))
    r = r.select("table_id", F.array_join(F.slice("l", 1, 10), " ").alias("first10"), F.array_join("l", " ").alias("all"), F.get("l", F.lit(0)).alias("first"))
    h = columns.where("header is not null").groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.lower("header").alias("h")))), lambda x: x["h"]), " ").alias("headers"))
    v = cells.where("value is not null").select("table_id").distinct().withColumn("has_values", F.lit(True))
    return r.join(h, "table_id", "left").join(v, "table_id", "left").fillna("", ["headers"]).fillna(False, ["has_values"])


def keyword_blocks(texts: DataFrame, rules: list[tuple[int, str, str, str]] = RULES) -> DataFrame:
    """The context of the first rule that fits; a table without values gets no further than the first block. One generated chain of tests for all rules."""
    out = F.lit(None).cast("string")
    for block, field, pattern, context in reversed(rules):
        test = F.col(field).rlike(pattern)
        out = F.when(test & (F.lit(block == 1) | F.col("has_values")), context).otherwise(out)
    return texts.select("table_id", out.alias("context"))


def classify_tables(tables: DataFrame, toc: DataFrame, votes: DataFrame, paths: DataFrame, texts: DataFrame, rules: list[tuple[str, str]], reclassify: bool = False) -> DataFrame:
    """I8: a table's class from the first of: its present class, the section of its page, note votes, its section path, keyword rules.
    All inputs but tables have at most one row for each table_id. With reclassify, only human decisions (method 'human') stay."""
    t = tables.join(toc.select("table_id", F.col("context").alias("by_toc")), "table_id", "left").join(votes.select("table_id", F.col("context").alias("by_votes")), "table_id", "left")
    t = t.join(paths.select("table_id", F.col("context").alias("by_path")), "table_id", "left").join(texts.select("table_id", keyword_rules(F.col("text"), rules).alias("by_rules")), "table_id", "left")
    old = F.when(F.col("method") == "human", F.col("context")) if reclassify else F.col("context")
    method = F.when(old.isNotNull(), "existing").when(F.col("by_toc").isNotNull(), "toc").when(F.col("by_votes").isNotNull(), "notes").when(F.col("by_path").isNotNull(), "path").when(F.col("by_rules").isNotNull(), "keywords").otherwise("unclassified")
    confidence = F.when(method.isin("existing", "toc"), "high").when(method == "unclassified", "none").otherwise("medium")
    return t.select("doc_id", "table_id", F.coalesce(old, "by_toc", "by_votes", "by_path", "by_rules").alias("context"), method.alias("method"), confidence.alias("confidence"))


def classification_checks(tables: DataFrame, rows: DataFrame, income: str, balance: str) -> DataFrame:
    """Issues of a table's class against its labels; a table may have several."""
    low = F.lower("label")
    c = rows.where("row_type = 'DATA'").groupBy("table_id").agg(F.count_if(low.rlike(income)).alias("income"), F.count_if(low.rlike(balance)).alias("balance"), F.count(F.lit(1)).alias("n"))
    t = tables.join(c, "table_id")
    tests = [
        ("OCI_HAS_PNL_STRUCTURE", (F.col("context") == "OCI") & (F.col("income") >= 2)), ("ASSOCIATE_SUMMARY_DETECTED", (F.col("income") >= 1) & (F.col("balance") >= 1) & (F.col("n") <= 4)),
        ("PNL_NO_REVENUE", (F.col("context") == "PNL") & (F.col("income") == 0)), ("UNCLASSIFIED_LIKELY_PNL", F.col("context").isNull() & (F.col("income") >= 2)), ("UNCLASSIFIED_LIKELY_SFP", F.col("context").isNull() & (F.col("balance") >= 2)),
    ]
    issues = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    return t.select("doc_id", "table_id", F.explode(issues).alias("issue"))


def toc_entries(tables: DataFrame, rows: DataFrame, cells: DataFrame, columns: DataFrame, first_tables: int = 20, most_cols: int = 4, most_page: int = 500) -> DataFrame:
    """E1, entries of early tables that may be contents (three rows, no note column, few value columns): each label with the last whole number
    between 1 and most_page of its row, and each text cell without a value with the next such number in its row. cells have text and value.
    Cells of a row meet in an array, so nothing is joined by place."""
    note = has_note_column(columns).where("not has_notes").select("table_id")
    few = columns.where("role = 'VALUE'").groupBy("table_id").count().where(F.col("count") <= most_cols).select("table_id")
    long = rows.groupBy("table_id").count().where("count >= 3").select("table_id")
    t = tables.where(F.col("table_ord") <= first_tables).select("table_id").join(note, "table_id", "left_semi").join(few, "table_id", "left_semi").join(long, "table_id", "left_semi")
    page = F.when((F.col("value") > 1) & (F.col("value") < most_page) & (F.col("value") == F.floor("value")), F.col("value").cast("int"))
    c = cells.where("col_idx > 0").withColumn("page", page).groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.when(F.col("value").isNull(), F.nullif(F.trim("text"), F.lit(""))).alias("text"), "page"))).alias("c"))
    r = rows.join(t, "table_id", "left_semi").select("doc_id", "table_id", "row_id", "row_idx", F.trim("label").alias("label")).join(c, ["table_id", "row_id"])
    pages = F.filter("c", lambda x: x["page"].isNotNull())
    first = F.when((F.col("label") != "") & (F.size(pages) > 0), F.array(F.struct(F.lit(-1).alias("at"), F.col("label").alias("label"), F.element_at(pages, -1)["page"].alias("page"))))
    after = lambda x: F.filter("c", lambda y: (y["col_idx"] > x["col_idx"]) & y["page"].isNotNull())
    more = F.transform(F.filter("c", lambda x: x["text"].isNotNull() & (F.size(after(x)) > 0)), lambda x: F.struct(x["col_idx"].alias("at"), x["text"].alias("label"), after(x)[0]["page"].alias("page")))
    none = F.array().cast("array<struct<at:int,label:string,page:int>>")
    e = r.select("doc_id", "table_id", "row_idx", F.explode(F.concat(F.coalesce(first, none), more)).alias("e"))
    return e.select("doc_id", "table_id", F.struct("row_idx", F.col("e.at").alias("at")).alias("ord"), "e.label", "e.page")


def toc_candidates(tables: DataFrame, entries: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """What E1 and E1b ask of a table of contents: entries, the share of steps that don't decrease, and the distinct statement types that labels name by the
    first fitting pattern of kinds. entries: table_id, ord, label, page."""
    t = tables.select("doc_id", "table_id", "table_ord", "page_no", *[c for c in ("currency",) if c in tables.columns])
    e = t.join(entries.select("table_id", "ord", "label", "page"), "table_id")
    order = Window.partitionBy("table_id").orderBy("ord")
    e = e.withColumns({"up": (F.col("page") >= F.lag("page").over(order)).cast("int"), "kind": keyword_rules(F.lower("label"), kinds)})
    primary = F.when(F.col("kind").isin("PNL", "SFP", "OCI", "CFS", "SOCIE"), F.col("kind"))
    return e.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum("up"), F.lit(0)).alias("n_up"), F.count_distinct(primary).alias("kinds"), F.max("page").alias("last"))


def detect_toc(tables: DataFrame, entries: DataFrame, kinds: list[tuple[str, str]], enhanced: bool = False) -> DataFrame:
    """The page map (page, type) of a document's first table with three entries, half of them not decreasing, and two statement types;
    a later entry replaces an earlier one of its page. Enhanced (E1b): only tables on the first ten pages, without a currency, with pages up to 500."""
    c = toc_candidates(tables, entries, kinds).where((F.col("n_entries") >= 3) & (F.col("n_up") >= 0.5 * F.col("n_entries")) & (F.col("kinds") >= 2))
    if enhanced:
        c = c.where((F.col("page_no") <= 10) & F.col("currency").isNull() & (F.col("last") <= 500))
    toc = c.groupBy("doc_id").agg(F.min_by("table_id", "table_ord").alias("table_id"))
    e = entries.join(toc, ["doc_id", "table_id"]).withColumn("type", keyword_rules(F.lower("label"), kinds)).where("type is not null")
    return e.groupBy("doc_id", "table_id", "page").agg(F.max_by("type", "ord").alias("type"))


def detect_toc_scored(tables: DataFrame, entries: DataFrame, kinds: list[tuple[str, str]], max_page: int = 15, least: float = 5) -> DataFrame:
    """The table with the best weighted score of features (entries, order, types, an early page, a span of pages), if it reaches `least`."""
    c = toc_candidates(tables, entries, kinds).where(F.col("page_no") <= max_page)
    score = F.least(F.col("n_entries") / 3, F.lit(3.0)) + 2.0 * F.col("n_up") / F.greatest(F.col("n_entries") - 1, F.lit(1)) + F.least("kinds", F.lit(3)) + F.when(F.col("page_no") <= 5, 1.0).otherwise(0.0) + F.when(F.col("last") > 20, 0.5).otherwise(0.0)
    c = c.withColumn("score", score).where(F.col("score") >= least)
    return c.groupBy("doc_id").agg(F.max_by(F.struct("table_id", "score"), F.struct("score", F.expr("-table_ord"))).alias("toc")).select("doc_id", "toc.table_id", F.round("toc.score", 4).alias("score"))


def detect_toc_index(tables: DataFrame, entries: DataFrame, least: float = 0.5) -> DataFrame:
    """Tables flagged as an index in which at least half of the rows refer to a page of the document. tables: doc_id, table_id, is_index, n_pages."""
    e = entries.join(tables.where("is_index").select("doc_id", "table_id", "n_pages"), "table_id")
    share = F.avg(F.coalesce(F.col("page").between(1, F.col("n_pages")), F.lit(False)).cast("double"))
    return e.groupBy("doc_id", "table_id").agg(F.round(share, 4).alias("share"), F.count(F.lit(1)).alias("n_entries")).where(F.col("share") >= least)


def has_note_column(columns: DataFrame) -> DataFrame:
    """Whether a table has a column of notes, by role or header."""
    hit = (F.col("role") == "NOTES") | F.lower(F.trim("header")).isin("note", "notes", "anhang", "anmerkung", "anmerkungen")
    return columns.groupBy("table_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_notes"))


def infer_dimensions(entity: Column, concept: Column, segment: Column) -> Column:
    """Dimensions of a row: its entity, a scope for results, a segment where the label names one."""
    return F.map_filter(F.create_map(F.lit("ENTITY"), entity, F.lit("SCOPE"), F.when(concept.startswith("PNL"), "CONTINUING"), F.lit("SEGMENT"), segment), lambda k, v: v.isNotNull())


def entity_from_name(name: Column) -> Column:
    """A readable entity from a file name: the year and separators go."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"_?(19|20)[0-9]{2}$", ""), r"[_#-]+", " ")))


def page_features(documents: DataFrame, sections: DataFrame, tables: DataFrame, refs: DataFrame, rank: DataFrame, toc: DataFrame) -> DataFrame:
    """For every page of a document what is known of it. Each side is aggregated to pages before it joins the spine.
    refs: doc_id, page, note_number; rank: doc_id, page, top_class, top_score; toc: doc_id, page, type, of entries that point to the page."""
    spine = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    s = sections.select("doc_id", "section_type", F.explode(F.sequence(F.col("start_page").cast("int"), F.greatest("start_page", "end_page").cast("int"))).alias("page")).groupBy("doc_id", "page").agg(F.min("section_type").alias("section_type"))
    t = tables.groupBy("doc_id", F.col("page_no").alias("page")).agg(F.count(F.lit(1)).alias("n_tables"), F.min("context").alias("context"))
    n = refs.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("note_number").alias("n_notes"))
    c = toc.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("toc_refs"))
    out = spine
    for side in (s, t, n, rank.select("doc_id", "page", "top_class", "top_score"), c):
        out = out.join(side, ["doc_id", "page"], "left")
    return out.fillna(0, ["n_tables", "n_refs", "n_notes"]).fillna("", ["toc_refs"])


def validate_notes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """C20: whether a section's note number occurs among the references of primary tables."""
    r = refs.select("doc_id", "note_number").distinct().withColumn("referenced", F.lit(True))
    return notes.join(r, ["doc_id", "note_number"], "left").fillna(False, ["referenced"])


def suggest_note_numbers(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """Numbered labels that share one of the first three longer words of a section without a number. The words are the join key.
    sections: doc_id, section_id, label; labels: doc_id, note_number, label."""
    word = lambda c: F.slice(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 3), 1, 3)
    s = sections.withColumn("w", F.explode(F.array_distinct(word("label")))).select("doc_id", "section_id", "w")
    n = labels.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("label"), r"[^\p{L}]+")))).select("doc_id", "note_number", "w")
    hits = s.join(n, ["doc_id", "w"]).groupBy("doc_id", "section_id", "note_number").agg(F.count_distinct("w").alias("n_words"))
    return hits.groupBy("doc_id", "section_id").agg(F.max_by(F.struct("note_number", "n_words"), F.struct("n_words", -F.col("note_number"))).alias("hit")).select("doc_id", "section_id", "hit.note_number", "hit.n_words")


def check_ic_decomposition(best: DataFrame, context: str, face: str, external: str, intercompany: str, tol: float = 1000.0) -> DataFrame:
    """A face amount against external and intercompany parts; a missing intercompany part counts as 0 and makes a residual a warning."""
    pick = lambda c: F.max(F.when(F.col("concept_id") == c, F.col("amount")))
    w = best.where((F.col("context") == context) & F.col("concept_id").isin(face, external, intercompany)).groupBy("doc_id", "period_key").agg(pick(face).alias("face"), pick(external).alias("external"), pick(intercompany).alias("ic"))
    w = w.where("face is not null and external is not null")
    delta = F.round(F.col("face") - F.col("external") - F.coalesce("ic", F.lit(0.0)), 2)
    return w.select("doc_id", "period_key", "face", "external", "ic", delta.alias("delta"), F.when(F.abs(delta) <= tol, "valid").when(F.col("ic").isNull(), "warning").otherwise("broken").alias("status"))


def tag_ratio(rows: DataFrame, cells: DataFrame, tags: DataFrame, rules: DataFrame, tol: float = 0.001) -> DataFrame:
    """Untagged rows whose values are a quotient of two tagged rows of the table, in every column. rules: result, numerator, denominator."""
    v = tags.join(cells.where("value is not null").select("table_id", "row_id", "col_idx", "value"), ["table_id", "row_id"]).select("table_id", F.col("concept_id").alias("c"), "col_idx", "value")
    side = lambda name: v.groupBy("table_id", F.col("c").alias(name), "col_idx").agg(F.min("value").alias(f"v_{name}"))
    q = side("numerator").join(rules, "numerator").join(side("denominator"), ["table_id", "denominator", "col_idx"]).where("v_denominator <> 0").select("table_id", "col_idx", "result", (F.col("v_numerator") / F.col("v_denominator")).alias("q"))
    o = rows.where("tag is null").select("doc_id", "table_id", "row_id").join(cells.where("value is not null").select("table_id", "row_id", "col_idx", "value"), ["table_id", "row_id"])
    ok = o.join(q, ["table_id", "col_idx"]).groupBy("doc_id", "table_id", "row_id", "result").agg(F.bool_and(F.abs(F.col("value") - F.col("q")) <= tol * F.abs("q")).alias("ok")).where("ok")
    return ok.groupBy("doc_id", "table_id", "row_id").agg(F.min("result").alias("concept_id")).withColumns({"confidence": F.lit(0.60), "rule": F.lit("ratio")})


def apply_external_tags(rows: DataFrame, suggestions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Suggestions for untagged rows with taggable labels, of concepts that the table's context allows."""
    from ..functions.labels import is_untaggable

    r = rows.where("tag is null").where(~is_untaggable(F.col("label"))).select("doc_id", "table_id", "row_id")
    return suggestions.join(r, "row_id").join(candidates.select("table_id", "concept_id"), ["table_id", "concept_id"], "left_semi").select("doc_id", "table_id", "row_id", "concept_id")


def materialize_note_edges(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """References as edges from a row to a context or note, for documents with a table of contents and a primary section."""
    ok = sections.groupBy("doc_id").agg(F.bool_or(F.col("section_type") == "TOC").alias("toc"), F.bool_or(F.col("section_type").isin("PNL", "SFP", "OCI", "CFS", "SOCIE")).alias("primary")).where("toc and primary")
    r = refs.where("note_number is not null").join(ok.select("doc_id"), "doc_id", "left_semi")
    return r.select("doc_id", F.concat_ws(":", F.col("table_id").cast("string"), F.col("row_id").cast("string")).alias("source"), F.coalesce("context", F.concat(F.lit("note_"), F.col("note_number").cast("string"))).alias("target"))
