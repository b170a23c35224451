"""Review work: occurrences, manifests, expectations, states, notes, and documents put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def concept_occurrences(rows: DataFrame, tables: DataFrame, documents: DataFrame, concept: str) -> DataFrame:
    """C11: places of a concept. The filter on the tag reaches the scan before the joins."""
    r = rows.where(F.col("tag") == concept).select("doc_id", "table_id", "row_id", "label")
    return r.join(tables.select("table_id", "page_no", "context"), "table_id").join(documents.select("doc_id", "entity"), "doc_id")


def assemble_document(tables: DataFrame, rows: DataFrame, cells: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """A document's tables with their rows and cells, nested and in order."""
    t = tables.join(doc_ids, "doc_id", "left_semi")
    own = t.select("table_id")
    c = cells.join(own, "table_id", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("cells"))
    r = rows.join(own, "table_id", "left_semi").join(c, "row_id", "left")
    r = r.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "label", "tag", "cells"))).alias("rows"))
    t = t.select("doc_id", "table_id", "table_ord", "page_no").join(r, "table_id", "left")
    return t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_ord", "table_id", "page_no", "rows"))).alias("tables"))


def shred_tables(nested: DataFrame) -> dict[str, DataFrame]:
    """A2: documents of C12's shape as tables, rows and cells."""
    t = nested.select("doc_id", F.explode_outer("tables").alias("t"))
    r = t.select("doc_id", F.col("t.table_id").alias("table_id"), F.explode_outer("t.rows").alias("r"))
    c = r.select("doc_id", "table_id", F.col("r.row_idx").alias("row_idx"), F.explode_outer("r.cells").alias("c"))
    return {
        "tables": t.select("doc_id", "t.table_id", "t.table_ord", "t.page_no"),
        "rows": r.select("doc_id", "table_id", "r.row_idx", "r.label", "r.tag"),
        "cells": c.select("doc_id", "table_id", "row_idx", "c.col_idx", "c.value"),
    }


def stale_references(overrides: DataFrame, tables: DataFrame) -> DataFrame:
    """Overrides of tables that are no longer there."""
    return overrides.join(tables.select("table_id"), "table_id", "left_anti")


def flag_has_override(documents: DataFrame, tables: DataFrame, overrides: DataFrame) -> DataFrame:
    """Whether any table of a document is overridden."""
    hit = tables.join(overrides.select("table_id"), "table_id", "left_semi").select("doc_id").distinct().withColumn("has_override", F.lit(True))
    return documents.select("doc_id").join(hit, "doc_id", "left").fillna(False, ["has_override"])


def review_manifest(tables: DataFrame, rows: DataFrame, most: int = 8) -> DataFrame:
    """Tables without a class, or of a primary class that a document has too often, with their first labels, how many of the document's
    tables have that class, the pages that its flagged tables span, and what to do."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "context"))
    t = tables.withColumn("n_of_type", n).withColumn("reason", F.when(F.col("context").isNull(), "unclassified").when(F.col("n_of_type") > most, "inflated")).where("reason is not null")
    own = Window.partitionBy("doc_id")
    t = t.withColumns({"first_flagged": F.min("page_no").over(own), "last_flagged": F.max("page_no").over(own), "n_flagged": F.count(F.lit(1)).over(own)})
    hint = F.when(F.col("reason") == "unclassified", "classify by section or labels").otherwise(F.concat(F.lit("keep at most "), F.lit(str(most)), F.lit(" of "), F.col("context")))
    return t.select("doc_id", "table_id", "page_no", "reason", "n_of_type", "first_flagged", "last_flagged", "n_flagged", hint.alias("suggestion")).join(first_n_per_table(rows), "table_id", "left")


def first_n_per_table(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first labels of each table, and its number of rows."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row_idx", "label"))), 1, n), lambda x: x["label"])
    return rows.groupBy("table_id").agg(F.array_join(first, "|").alias("first_labels"), F.count(F.lit(1)).alias("n_rows"))


def first_headers(columns: DataFrame, n: int = 6) -> DataFrame:
    """The first column headers of each table, in order."""
    h = columns.where("header is not null").groupBy("table_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), 1, n).alias("h"))
    return h.select("table_id", F.array_join(F.transform("h", lambda x: x["header"]), "|").alias("headers"))


def expected_findings(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected findings that are there or missing, where a null expectation fits all, and unexpected errors. Each finding lends
    four keys (edge and concept, one of them, none), so that expectations of every kind meet it by equality."""
    f = findings.where("edge_name is not null and concept_id is not null").groupBy("edge_name", "concept_id").agg(F.bool_or(F.col("severity") == "ERROR").alias("error"))
    none = F.lit(None).cast("string")
    keys = [F.struct(e.alias("ke"), c.alias("kc")) for e in (F.col("edge_name"), none) for c in (F.col("concept_id"), none)]
    k = f.withColumn("key", F.explode(F.array(*keys))).select("edge_name", "concept_id", "error", "key.ke", "key.kc")
    there = k.select("ke", "kc").distinct().withColumn("there", F.lit(True))
    e = expected.select(F.col("edge_name").alias("ee"), F.col("concept_id").alias("ec"))
    got = e.join(there, F.col("ee").eqNullSafe(F.col("ke")) & F.col("ec").eqNullSafe(F.col("kc")), "left").select(F.col("ee").alias("edge_name"), F.col("ec").alias("concept_id"), F.when(F.col("there"), "found").otherwise("missing").alias("outcome"))
    known = k.join(e, F.col("ke").eqNullSafe(F.col("ee")) & F.col("kc").eqNullSafe(F.col("ec")), "left_semi").select("edge_name", "concept_id")
    more = f.where("error").join(known, ["edge_name", "concept_id"], "left_anti")
    return got.unionByName(more.select("edge_name", "concept_id", F.lit("unexpected").alias("outcome")))


def review_state(reviews: DataFrame) -> DataFrame:
    """For each document and element either all reviewed (a null page says so), or the pages seen, and when last."""
    g = reviews.groupBy("doc_id", "element").agg(F.bool_or(F.col("page").isNull()).alias("all_reviewed"), F.array_sort(F.collect_set("page")).alias("p"), F.max("ts").alias("last_seen"))
    return g.select("doc_id", "element", "all_reviewed", F.when(~F.col("all_reviewed"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",")).alias("pages"), "last_seen")


def gap_proposal_state(gaps: DataFrame, events: DataFrame) -> DataFrame:
    """A gap's state after its latest proposal event; a rejected proposal leaves its gap as proposed. events: gap_id, action, ts, event_id."""
    last = events.groupBy("gap_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action"), F.count(F.lit(1)).alias("n_events"), F.bool_or(F.col("action") == "accept").alias("accepted"))
    state = F.when(F.col("accepted"), "accepted").when(F.col("last_action").isNotNull(), "proposed").otherwise("open")
    return gaps.select("gap_id").join(last, "gap_id", "left").select("gap_id", state.alias("state"), "last_action", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def proposal_state(events: DataFrame) -> DataFrame:
    """Each proposal's state: linked ones are pending until they are accepted or rejected, by whom and when. The latest decision counts.
    events: proposal_id, gap_id, action, user, ts, event_id."""
    decided = F.col("action").isin("accept", "reject")
    last = F.max_by(F.struct("action", "user", "ts"), F.when(decided, F.struct("ts", "event_id")))
    g = events.groupBy("proposal_id", "gap_id").agg(F.min("ts").alias("linked_at"), last.alias("d"), F.max(decided).alias("any"))
    state = F.when(F.col("any") & (F.col("d.action") == "accept"), "accepted").when(F.col("any"), "rejected").otherwise("pending")
    return g.select("proposal_id", "gap_id", "linked_at", state.alias("state"), F.when(F.col("any"), F.col("d.user")).alias("resolver"), F.when(F.col("any"), F.col("d.ts")).alias("resolved_at"))


def annotation_status(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Not started, in progress, or complete once a section is validated. sections: doc_id, validated, ts."""
    s = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.bool_or("validated").alias("any_validated"), F.max(F.when(F.col("validated"), F.col("ts"))).alias("completed_at"))
    d = documents.select("doc_id").join(s, "doc_id", "left").fillna(0, ["n_sections"])
    return d.select("doc_id", "n_sections", F.when(F.col("n_sections") == 0, "not_started").when(F.col("any_validated"), "complete").otherwise("in_progress").alias("status"), "completed_at")


def gt_set_report(sets: DataFrame, members: DataFrame, sections: DataFrame) -> DataFrame:
    """Each set with its number of documents, how many of them have annotated sections, and the share."""
    done = sections.select("doc_id").distinct().withColumn("done", F.lit(1))
    m = members.distinct().join(done, "doc_id", "left").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count("done").alias("n_annotated"), F.min("doc_id").alias("first_document"))
    m = sets.join(m, "set_id", "left").fillna(0, ["n_documents", "n_annotated"])
    return m.select("set_id", "n_documents", "n_annotated", "first_document", F.round(F.coalesce(F.try_divide("n_annotated", "n_documents"), F.lit(0.0)), 4).alias("coverage"))


def gt_set_documents(members: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """The documents of each set, one a row, with the per cent of their pages that sections cover."""
    from .timelines import page_coverage

    return members.distinct().join(page_coverage(documents.select("doc_id", "n_pages"), sections), "doc_id").select("set_id", "doc_id", "n_pages", "coverage")


def corpus_health(documents: DataFrame, artifacts: DataFrame, wanted: list[str]) -> DataFrame:
    """Which of the wanted artifacts a document has. artifacts: doc_id, kind."""
    a = artifacts.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    d = documents.select("doc_id").join(a, "doc_id", "left")
    missing = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("kinds", F.array().cast("array<string>")))
    return d.select("doc_id", (F.lit(len(wanted)) - F.size(missing)).alias("n_present"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def bbox_coverage(rows: DataFrame) -> DataFrame:
    """Per cent of each document's rows that have a box. rows: doc_id, has_bbox."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("has_bbox").alias("n_boxed"), F.floor(100 * F.count_if("has_bbox") / F.count(F.lit(1))).alias("bbox_coverage"))


def extraction_match_status(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Missing, partial or ok, by page counts. extracted: doc_id, pages."""
    d = documents.join(extracted, "doc_id", "left")
    return d.select("doc_id", "n_pages", F.coalesce("pages", F.lit(0)).alias("pages"), F.when(F.coalesce("pages", F.lit(0)) == 0, "missing").when(F.col("pages") < F.col("n_pages"), "partial").otherwise("ok").alias("status"))


def note_entries(noted: DataFrame, labels: DataFrame) -> DataFrame:
    """C6, entries: notes that rows refer to, from note columns (noted: doc_id, table_id, table_ord, row_id, row_idx, label, text; the leading number of the text counts)
    and from labels (labels: the same with note_number in place of text), unless the row has the note from a column already."""
    key = ["doc_id", "table_id", "table_ord", "row_id", "row_idx", "label"]
    number = F.nullif(F.regexp_extract("text", r"^\s*([0-9]{1,3})", 1), F.lit("")).try_cast("int")
    a = noted.select(*key, number.alias("note_number")).where("note_number is not null").withColumn("src", F.lit(1))
    b = labels.where("note_number is not null").select(*key, "note_number").join(a.select("table_id", "row_id", "note_number"), ["table_id", "row_id", "note_number"], "left_anti").withColumn("src", F.lit(2))
    return a.unionByName(b)


def toc_note_entries(tables: DataFrame, rows: DataFrame, first_tables: int = 20, most_cols: int = 2, least: int = 3) -> DataFrame:
    """C6, contents: numbered labels ("21. Leases") of early tables with few value columns and three such labels at least. tables: doc_id, table_id, table_ord, n_value_cols."""
    t = tables.where((F.col("table_ord") <= first_tables) & (F.col("n_value_cols") <= most_cols)).select("table_id", "table_ord")
    number, topic = F.regexp_extract("label", r"^\s*([0-9]{1,3})\s*[.)]\s+(.+)", 1), F.regexp_extract("label", r"^\s*([0-9]{1,3})\s*[.)]\s+(.+)", 2)
    r = rows.join(t, "table_id").select("doc_id", "table_id", "table_ord", "row_id", "row_idx", F.nullif(number, F.lit("")).try_cast("int").alias("note_number"), topic.alias("label")).where("note_number is not null")
    enough = r.groupBy("table_id").count().where(F.col("count") >= least).select("table_id")
    return r.join(enough, "table_id", "left_semi").withColumn("src", F.lit(3))


def note_contexts(entries: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The context of each note of a document: that of the first label, by source, table and row, that a rule (pattern, context) fits."""
    context = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        context = F.when(F.lower("label").rlike(pattern), name).otherwise(context)
    e = entries.withColumn("context", context)
    first = F.min_by(F.struct("context", "src"), F.when(F.col("context").isNotNull(), F.struct("src", "table_ord", "row_idx", "row_id")))
    n = e.groupBy("doc_id", "note_number").agg(first.alias("x"), F.count_if(F.col("src") < 3).alias("n_refs"), F.count(F.lit(1)).alias("n_entries"), F.max(F.col("context").isNotNull()).alias("known"))
    return n.select("doc_id", "note_number", F.when(F.col("known"), F.col("x.context")).alias("context"), F.when(F.col("known"), F.col("x.src")).alias("src"), "n_refs", "n_entries")


def classify_by_note_votes(refs: DataFrame, notes: DataFrame, min_share: float = 0.5, min_votes: int = 2) -> DataFrame:
    """A table's class by the contexts of the notes that it refers to. refs: doc_id, table_id, note_number."""
    v = refs.join(notes.where("context is not null").select("doc_id", "note_number", "context"), ["doc_id", "note_number"]).groupBy("doc_id", "table_id", "context").agg(F.count(F.lit(1)).alias("votes"))
    top = v.groupBy("doc_id", "table_id").agg(F.sum("votes").alias("total"), F.max_by(F.struct("context", "votes"), F.struct("votes", "context")).alias("winner"))
    return top.where((F.col("winner.votes") >= min_votes) & (F.col("winner.votes") >= min_share * F.col("total"))).select("doc_id", "table_id", F.col("winner.context").alias("context"), F.col("winner.votes").alias("votes"), "total")


def structure_violations(tables: DataFrame, rows: DataFrame, income: str, balance: str, most: int = 8) -> DataFrame:
    """Statements whose labels are those of another kind. income, balance: patterns of lower-cased labels."""
    low = F.lower("label")
    c = rows.where("row_type = 'DATA'").groupBy("table_id").agg(F.count_if(low.rlike(income)).alias("income"), F.count_if(low.rlike(balance)).alias("balance"), F.count(F.lit(1)).alias("n_rows"))
    t = tables.join(c, "table_id")
    kind = F.when((F.col("context") == "OCI") & (F.col("income") >= 2), "OCI_HAS_PNL_STRUCTURE").when((F.col("n_rows") <= most) & (F.col("income") >= 2) & (F.col("balance") >= 1), "MIXED_SUMMARY")
    return t.withColumn("violation", kind).where("violation is not null").select("doc_id", "table_id", "context", "income", "balance", "n_rows", "violation")
