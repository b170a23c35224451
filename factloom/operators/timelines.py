"""Pages and sections: transitions, intervals, runs of pages, diffs and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTENT = ("PNL", "SFP", "OCI", "CFS", "SOCIE", "NOTES")


def transitions_to_sections(transitions: DataFrame, documents: DataFrame) -> DataFrame:
    """A section lasts from its marker to the page before the next one, the last one to the end."""
    order = Window.partitionBy("doc_id").orderBy("page")
    t = transitions.join(documents.select("doc_id", "n_pages"), "doc_id")
    end = F.coalesce(F.lead("page").over(order) - 1, F.greatest("page", "n_pages"))
    return t.select("doc_id", "section_type", F.col("page").alias("start_page"), end.alias("end_page"))


def sections_to_transitions(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", F.col("start_page").alias("page"), "section_type").distinct()


def page_spine(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))


def resolve_transitions(transitions: DataFrame, documents: DataFrame, floating: tuple[str, ...] = ("TOC",)) -> DataFrame:
    """Each page's type carried forward; floating types take the group of the next content type, else of the one before."""
    order = Window.partitionBy("doc_id").orderBy("page")
    p = page_spine(documents).join(transitions, ["doc_id", "page"], "left")
    kind = F.last("section_type", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("type", kind)
    content = F.when(~F.col("type").isin(*floating), F.col("type"))
    after = F.first(content, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(content, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return p.select("doc_id", "page", "type", F.when(F.col("type").isNotNull(), F.coalesce(after, before)).alias("group"))


def resolve_multi_tags(multi: DataFrame, transitions: DataFrame, documents: DataFrame) -> DataFrame:
    """E5: secondary tags of a page carried forward to the end of the span that its transition begins. multi: doc_id, page, tag."""
    s = transitions_to_sections(transitions, documents)
    spans = multi.join(s.select("doc_id", F.col("start_page").alias("page"), "end_page"), ["doc_id", "page"])
    p = spans.select("doc_id", F.explode(F.sequence(F.col("page"), F.greatest("page", "end_page"))).alias("page"), "tag")
    return p.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def review_template(flagged: DataFrame, ranges: DataFrame) -> DataFrame:
    """What a reviewer fills in: one row for each range of flagged pages, and one for each flagged table outside all ranges. flagged: doc_id, table_id, page."""
    inside = ranges.select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    alone = flagged.join(inside, ["doc_id", "page"], "left_anti").select("doc_id", F.lit("table").alias("kind"), "table_id", F.col("page").alias("start_page"), F.col("page").alias("end_page"))
    return ranges.select("doc_id", F.lit("range").alias("kind"), F.lit(None).cast("long").alias("table_id"), "start_page", "end_page").unionByName(alone)


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column) -> DataFrame:
    """df with `island`, a number that grows by one wherever `breaks` is true along `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__b", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def hierarchy_groups(sections: DataFrame, group: str = "section_type") -> DataFrame:
    """Contiguous sections of one group."""
    w = Window.partitionBy("doc_id").orderBy("start_page")
    s = islands(sections, ["doc_id"], "start_page", F.lag(group).over(w) != F.col(group))
    return s.groupBy("doc_id", "island").agg(F.first(group).alias("grp"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.count(F.lit(1)).alias("n_sections")).drop("island")


def merge_page_runs(page_map: DataFrame, gap: int = 5) -> DataFrame:
    """Pages of one type with gaps of at most `gap` form a section. page_map: doc_id, page, type."""
    w = Window.partitionBy("doc_id", "type").orderBy("page")
    s = islands(page_map, ["doc_id", "type"], "page", F.col("page") - F.lag("page").over(w) > gap)
    return s.groupBy("doc_id", "type", "island").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count(F.lit(1)).alias("n_pages")).drop("island")


def flagged_ranges(flagged: DataFrame, gap: int = 3, min_span: int = 3) -> DataFrame:
    """Runs of flagged pages, for documents with min_span flagged pages at least. flagged: doc_id, page."""
    pages = flagged.distinct()
    w = Window.partitionBy("doc_id").orderBy("page")
    s = islands(pages, ["doc_id"], "page", F.col("page") - F.lag("page").over(w) > gap).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where(F.col("total") >= min_span)
    out = s.groupBy("doc_id", "island").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count(F.lit(1)).alias("n_flagged")).drop("island")
    return out.where(F.col("end_page") - F.col("start_page") + 1 >= min_span)


def interval_join(pages: DataFrame, sections: DataFrame, policy: str = "first") -> DataFrame:
    """The first (or last) section that holds a page: sections are unrolled to pages, so the join is an equi-join. Their bytes tell nothing about
    how many pages they unroll to: they are dealt by document before, and the join is never a broadcast."""
    s = sections.repartition("doc_id").select("doc_id", "section_type", "start_page", F.explode(F.sequence(F.col("start_page"), F.greatest("start_page", "end_page"))).alias("page"))
    pick = F.min_by if policy == "first" else F.max_by
    s = s.groupBy("doc_id", "page").agg(pick("section_type", F.struct("start_page", "section_type")).alias("section_type"))
    return pages.join(s.hint("merge"), ["doc_id", "page"], "left")


def asof_section(tables: DataFrame, starts: DataFrame, max_tail: int = 20) -> DataFrame:
    """C4: a table's section is one that starts on its page, else the last one before; the last section ends max_tail pages
    after its start, and pages inside notes have none. One union and one window, no range join."""
    w = Window.partitionBy("doc_id").orderBy("page")
    s = starts.groupBy("doc_id", "page").agg(F.min("section_type").alias("section_type")).withColumn("until", F.coalesce(F.lead("page").over(w), F.col("page") + max_tail))
    both = s.select("doc_id", "page", F.lit(0).alias("side"), F.struct("section_type", "page", "until").alias("s"), F.lit(None).cast("long").alias("table_id"))
    both = both.unionByName(tables.select("doc_id", F.col("page_no").alias("page"), F.lit(1).alias("side"), F.lit(None).cast(both.schema["s"].dataType).alias("s"), "table_id"))
    along = Window.partitionBy("doc_id").orderBy("page", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("s", F.last("s", ignorenulls=True).over(along)).where("side = 1")
    kind = F.when(F.col("s.page") == F.col("page"), F.col("s.section_type")).when((F.col("page") < F.col("s.until")) & (F.col("s.section_type") != "NOTES"), F.col("s.section_type"))
    return out.select("doc_id", "table_id", F.col("page").alias("page_no"), kind.alias("section_type"))


def transition_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Log rows that lead from one set of markers to another."""
    o, n = old.select("doc_id", "page", F.col("section_type").alias("old_type")), new.select("doc_id", "page", F.col("section_type").alias("new_type"))
    action = F.when(F.col("old_type").isNull(), "add").when(F.col("new_type").isNull(), "remove").when(F.col("old_type") != F.col("new_type"), "reclassify")
    return o.join(n, ["doc_id", "page"], "full_outer").withColumn("action", action).where("action is not null")


def page_coverage(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Per cent of a document's pages that sections cover. In order of its start, each section adds the pages behind the furthest end so far: none is unrolled."""
    along = Window.partitionBy("doc_id").orderBy("start_page").rowsBetween(Window.unboundedPreceding, -1)
    s = sections.where("start_page is not null").select("doc_id", F.col("start_page").cast("long").alias("start_page"), F.greatest("start_page", "end_page").cast("long").alias("end_page"))
    before = F.greatest(F.max("end_page").over(along), F.col("start_page") - 1)
    pages = s.withColumn("more", F.greatest(F.col("end_page") - before, F.lit(0))).groupBy("doc_id").agg(F.sum("more").alias("covered"))
    d = documents.join(pages.hint("merge"), "doc_id", "left").fillna(0, ["covered"])
    return d.select("doc_id", "n_pages", "covered", F.least(F.floor(100 * F.col("covered") / F.col("n_pages")), F.lit(100)).alias("coverage"))


def toc_offset(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """The offset of printed page numbers where over half of them exceed the page count."""
    e = entries.join(documents.select("doc_id", "n_pages"), "doc_id").groupBy("doc_id").agg(F.avg((F.col("page") > F.col("n_pages")).cast("double")).alias("beyond"), F.min("page").alias("low"))
    return e.select("doc_id", F.when(F.col("beyond") > 0.5, F.col("low") - 2).otherwise(0).alias("page_offset"))


def validate_sections(sections: DataFrame, tables: DataFrame, rows: DataFrame, cells: DataFrame, keywords: dict[str, list[str]], plain: tuple[str, ...] = ("NOTES",)) -> DataFrame:
    """Whether the tables on a section's pages fit its type. A section without a start, or without tables, is a warning. Contents need over half of their
    values to be whole numbers from 1 to 500; plain types only need tables; others need a table with a keyword of the type in a label, or one that is
    classified like it. tables: doc_id, table_id, page_no, context. Tables are summed up before they meet sections."""
    low = F.lower("label")
    hits = rows.groupBy("table_id").agg(*[F.bool_or(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))).alias(f"has_{k}") for k, ws in keywords.items()])
    small = (F.col("value") >= 1) & (F.col("value") <= 500) & (F.col("value") == F.floor("value"))
    values = cells.groupBy("table_id").agg(F.count("value").alias("n_values"), F.count_if(small).alias("n_small"))
    t = tables.join(hits, "table_id", "left").join(values, "table_id", "left")
    s = sections.withColumn("page_no", F.explode_outer(F.when(F.col("start_page").isNotNull(), F.sequence(F.col("start_page"), F.greatest("start_page", F.coalesce("end_page", "start_page"))))))
    own = F.lit(False)
    for k in keywords:
        own = F.when(F.col("section_type") == k, F.coalesce(f"has_{k}", F.lit(False))).otherwise(own)
    j = s.join(t, ["doc_id", "page_no"], "left")
    g = j.groupBy("doc_id", "section_id", "section_type", "start_page").agg(
        F.count("table_id").alias("n_tables"), F.coalesce(F.bool_or(own & F.col("table_id").isNotNull()), F.lit(False)).alias("by_keyword"), F.coalesce(F.bool_or(F.col("context") == F.col("section_type")), F.lit(False)).alias("by_class"),
        F.coalesce(F.sum("n_small") / F.nullif(F.sum("n_values"), F.lit(0)), F.lit(0.0)).alias("small"),
    )
    ok = F.when(F.col("section_type") == "TOC", F.col("small") > 0.5).when(F.col("section_type").isin(*plain) | ~F.col("section_type").isin(*keywords), True).otherwise(F.col("by_keyword") | F.col("by_class"))
    detail = F.when(F.col("start_page").isNull(), "no start").when(F.col("n_tables") == 0, "no tables").when(F.col("section_type") == "TOC", F.when(ok, "numbers").otherwise("no numbers")).when(F.col("by_keyword"), "keyword").when(F.col("by_class"), "class").when(ok, "tables").otherwise("nothing fits")
    status = F.when(F.col("start_page").isNotNull() & (F.col("n_tables") > 0) & ok, "ok").otherwise("warning")
    return g.select("doc_id", "section_id", "section_type", "start_page", "n_tables", status.alias("status"), detail.alias("detail"))


def evaluate_detector(page_map: DataFrame, sections: DataFrame) -> DataFrame:
    """Precision and recall of detected page types against annotated sections."""
    truth = sections.select("doc_id", F.col("section_type").alias("type"), F.explode(F.sequence(F.col("start_page"), F.greatest("start_page", "end_page"))).alias("page")).distinct().withColumn("t", F.lit(1))
    got = page_map.select("doc_id", "type", "page").distinct().withColumn("g", F.lit(1))
    c = truth.join(got, ["doc_id", "type", "page"], "full_outer").groupBy("type").agg(F.count("t").alias("truth"), F.count("g").alias("detected"), F.count(F.when(F.col("t").isNotNull() & F.col("g").isNotNull(), 1)).alias("hits"))
    return c.select("type", "truth", "detected", "hits", F.round(F.try_divide("hits", "detected"), 4).alias("precision"), F.round(F.try_divide("hits", "truth"), 4).alias("recall"))
