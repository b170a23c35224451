"""Roll-ups over documents and the corpus, votes, gates and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

VOTE_WEIGHTS = {"human": 3, "mlp": 2}


def consensus(votes: DataFrame, weights: dict[str, int] = VOTE_WEIGHTS) -> DataFrame:
    """For each target the value with the most weight, then votes, then the latest; with its share of voters."""
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in weights.items()], F.lit(1))
    v = votes.where(F.col("action").isin("tag", "dissent") & F.col("value").isNotNull()).withColumn("w", weight)
    key = ["dimension", "target_id"]
    per = v.where("action = 'tag'").groupBy(*key, "value").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
    best = per.groupBy(key).agg(F.max_by(F.struct("value", "weight", "n"), F.struct("weight", "n", "latest", "value")).alias("winner"), F.sum("n").alias("n_tags"))
    rest = v.groupBy(key).agg(F.count_if(F.col("action") == "dissent").alias("dissent"), F.count_distinct("voter").alias("voters"), F.count(F.lit(1)).alias("votes"))
    return best.join(rest, key).select(*key, "winner.value", F.col("winner.weight").alias("weight"), F.col("winner.n").alias("agree"), "dissent", "voters", F.round(F.col("winner.n") / F.col("votes"), 4).alias("confidence"))


def vote_conflicts(cons: DataFrame, dimension: str) -> DataFrame:
    """Targets of a dimension that someone dissents from."""
    return cons.where((F.col("dimension") == dimension) & (F.col("dissent") > 0))


def document_stats(tables: DataFrame, rows: DataFrame, approx: bool = False) -> DataFrame:
    """Tables, rows, tagged rows and distinct concepts of each document. Rows carry doc_id, so nothing joins."""
    distinct = F.approx_count_distinct("tag") if approx else F.count_distinct("tag")
    r = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("tag").alias("n_tagged"), distinct.alias("n_concepts"))
    return tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables")).join(r, "doc_id", "left").fillna(0)


def tag_coverage(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Tagged rows among the rows of classified tables that have a value."""
    valued = cells.where("value is not null").select("row_id").distinct()
    r = rows.where("row_type <> 'HEADER'").join(tables.where("context is not null").select("table_id", "context"), "table_id").join(valued, "row_id", "left_semi")
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("tag").alias("n_tagged"), F.round(F.count("tag") / F.count(F.lit(1)), 4).alias("coverage"))


def document_profile(tables: DataFrame, rows: DataFrame, facts: DataFrame, findings: DataFrame | None = None, scores: DataFrame | None = None, inferred: DataFrame | None = None) -> DataFrame:
    """Counts of rows, tags and facts of each document, and its concepts; with findings (doc_id, category, edge_name), scores (doc_id,
    concept_id, status) and inferred tags (doc_id, rule) also their counts by category, edge, status and rule as sorted "name=n" lists."""
    if findings is not None:
        base = document_profile(tables, rows, facts)
        for df, key, name in ((findings, "category", "findings"), (findings, "edge_name", "edges"), (scores, "status", "statuses"), (inferred, "rule", "inferred")):
            n = df.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, F.col("n").cast("string")))), ",").alias(name))
            base = base.join(n, "doc_id", "left").fillna("", [name])
        for status in ("CONFIRMED", "CONTRADICTED"):
            c = scores.where(F.col("status") == status).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("concept_id")), ",").alias(status.lower()))
            base = base.join(c, "doc_id", "left").fillna("", [status.lower()])
        return base
    r = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("row_type") == "DATA").alias("n_data"), F.count("tag").alias("n_tagged"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("concepts"))
    f = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("is_primary").alias("n_primary"))
    t = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("context").isNull()).alias("n_unclassified"))
    return t.join(r, "doc_id", "left").join(f, "doc_id", "left").fillna(0, ["n_rows", "n_data", "n_tagged", "n_facts", "n_primary"])


def corpus_summary(profile: DataFrame, group: str) -> DataFrame:
    """Totals by group and over all, in one pass."""
    return profile.rollup(group).agg(F.grouping(group).cast("int").alias("is_total"), F.count(F.lit(1)).alias("n_documents"), F.sum("n_tables").alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.sum("n_tagged").alias("n_tagged"), F.sum("n_facts").alias("n_facts"))


def corpus_status(results: DataFrame) -> DataFrame:
    """Documents by status and, where they halted, by stage; with the first of each. results: doc_id, status, halted_at."""
    return results.groupBy("status", "halted_at").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_document"))


METRICS = ("n_tables", "n_unclassified", "n_rows", "n_data", "n_tagged", "n_facts", "n_primary")


def corpus_comparison(profile: DataFrame) -> DataFrame:
    """A fixed set of metrics of every document against the corpus: the cells of the metric by document matrix, one a row, with
    the metric's mean over documents. A million documents make rows, not columns."""
    long = profile.unpivot("doc_id", list(METRICS), "metric", "value")
    mean = profile.agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS]).unpivot([], list(METRICS), "metric", "mean")
    return long.select("doc_id", "metric", F.col("value").cast("long").alias("value")).join(F.broadcast(mean), "metric")  # mean has a row for each metric


def comparison_matrix(profile: DataFrame, documents: list[int]) -> DataFrame:
    """D20 with a column for each of some named documents."""
    return corpus_comparison(profile.where(F.col("doc_id").isin(*documents))).groupBy("metric").pivot("doc_id", documents).agg(F.first("value"))


def top_edges(findings: DataFrame, k: int = 10) -> DataFrame:
    """The k edges with most findings of each category. findings: doc_id, category, edge_name."""
    c = findings.groupBy("category", "edge_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "edge_name"))).where(F.col("rank") <= k)


def never_confirmed(scores: DataFrame) -> DataFrame:
    """Concepts whose facts are unconfirmed in every document that has them."""
    return scores.groupBy("concept_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.bool_and(F.col("status") == "UNCONFIRMED").alias("never")).where("never").drop("never")


def cross_document_patterns(scores: DataFrame, min_docs: int = 2, k: int = 10) -> DataFrame:
    """Concepts that are confirmed or contradicted in min_docs documents at least, the k most frequent of each status."""
    c = scores.groupBy("status", "concept_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_facts")).where(F.col("n_docs") >= min_docs)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("n_docs"), "concept_id"))).where(F.col("rank") <= k)


def window_texts(tables: DataFrame, rows: DataFrame, columns: DataFrame, n_tables: int, n_rows: int) -> DataFrame:
    """The column headers and the first row labels of a document's first tables, as one text."""
    t = tables.where(F.col("table_ord") <= n_tables).select("doc_id", "table_id", "table_ord")
    h = columns.where("header is not null").select("table_id", F.lit(0).alias("src"), F.col("col_idx").alias("ord"), F.col("header").alias("x"))
    r = rows.where(F.col("row_idx") < n_rows).select("table_id", F.lit(1).alias("src"), F.col("row_idx").alias("ord"), F.col("label").alias("x"))
    parts = h.unionByName(r).join(t, "table_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_ord", "src", "ord", "x"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda p: p["x"]), " ").alias("text"))


def keyword_argmax(texts: DataFrame, keywords: dict[str, list[str]], min_hits: int, default: str, hints: dict[str, str] | None = None) -> DataFrame:
    """For each document the class with most distinct keywords in its text; ties go to the class listed first; a hint (pattern of the
    lower-cased `name`: class) wins over the text. texts: doc_id, text and, with hints, name. Keywords are tested as a projection, so no row is multiplied."""
    low = F.lower(F.coalesce("text", F.lit("")))
    score = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("score"), F.lit(-i).alias("ord"), F.lit(c).alias("cls")) for i, (c, ws) in enumerate(keywords.items())]
    hinted = F.lit(None).cast("string")
    for pattern, cls in reversed((hints or {}).items()):
        hinted = F.when(F.lower("name").rlike(pattern), cls).otherwise(hinted)
    by_text = F.when(F.col("best_class.score") >= min_hits, F.col("best_class.cls")).otherwise(default)
    return texts.withColumn("best_class", F.array_max(F.array(*score))).select("doc_id", F.coalesce(hinted, by_text).alias("cls"), F.col("best_class.score").alias("hits"))


def modal_currency_unit(tables: DataFrame, default: str = "EUR") -> DataFrame:
    """The unit that most of a document's tables state, the first seen among equals."""
    n = tables.where("unit is not null and unit not like '%!%%' escape '!'").groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("table_ord").alias("first"))
    best = n.groupBy("doc_id").agg(F.max_by("unit", F.struct("n", F.expr("-first"))).alias("unit"))
    return tables.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("unit", F.lit(default)).alias("unit"))


def period_dim(columns: DataFrame) -> DataFrame:
    """The first header of each period of a document, and the year in it."""
    c = columns.where("period_axis is not null").groupBy("doc_id", F.regexp_replace("period_axis", "^PERIOD[.]", "").alias("period_key")).agg(F.min_by("header", F.struct("table_id", "col_idx")).alias("label"))
    return c.withColumn("year", F.nullif(F.regexp_extract("label", "(20[0-9]{2})", 1), F.lit("")).try_cast("int"))


def review_dashboard(tables: DataFrame, refs: DataFrame) -> DataFrame:
    """Page range, counts of table classes, a histogram of classification methods, and tables of contents and note references of
    each document. tables have method; refs: doc_id, one row for each note reference."""
    methods = tables.groupBy("doc_id", "method").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "method", F.col("n").cast("string")))), ",").alias("methods"))
    notes = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_note_refs"))
    return table_counts(tables).join(methods, "doc_id").join(notes, "doc_id", "left").fillna(0, ["n_note_refs"])


def table_counts(tables: DataFrame) -> DataFrame:
    primary = F.col("context").isin("PNL", "SFP", "OCI", "CFS", "SOCIE")
    return tables.groupBy("doc_id").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_tables"), F.count_if(primary).alias("n_primary"),
        F.count_if(F.col("context").startswith("DISC.")).alias("n_disclosure"), F.count_if(F.col("context").isNull()).alias("n_unclassified"), F.count_if(F.col("context") == "TOC").alias("n_toc"),
    )


def element_browse(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """For each document and element type its pages, and where they come from."""
    s = sections.select("doc_id", F.col("section_type").alias("element"), F.explode(F.sequence(F.col("start_page").cast("int"), F.greatest("start_page", "end_page").cast("int"))).alias("page"), F.lit("section").alias("src"))
    t = tables.where("context is not null").select("doc_id", F.col("context").alias("element"), F.col("page_no").alias("page"), F.lit("table").alias("src"))
    g = s.unionByName(t).groupBy("doc_id", "element").agg(F.array_sort(F.collect_set("page")).alias("p"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("source"))
    return g.select("doc_id", "element", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"), F.size("p").alias("n_pages"), "source")


PRIMARY = ("PNL", "SFP", "OCI", "CFS", "SOCIE")
#: Least values of the gates, in their order. Fixed values.
GATES = {"tables": 1.0, "statements": 1.0, "parse": 0.6, "arithmetic": 0.5, "tags": 0.1}


def gates(tables: DataFrame, cells: DataFrame, arithmetic: DataFrame, rows: DataFrame, limits: dict[str, float] = GATES, most: int = 8, overrides: DataFrame | None = None) -> DataFrame:
    """Each document's gates in order, with values and verdicts; `first_failing` names where it halts. The gate of statements also fails
    where a primary type has over `most` tables; documents in overrides (doc_id) pass it in any case."""
    primary = F.when(F.col("context").isin(*PRIMARY), F.col("context"))
    t = tables.groupBy("doc_id", primary.alias("kind")).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(
        F.sum("n").cast("double").alias("tables"), F.count("kind").cast("double").alias("statements"), F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("max_per_type")
    )
    forced = F.lit(False)
    if overrides is not None:
        t = t.join(overrides.select("doc_id").distinct().withColumn("overridden", F.lit(True)), "doc_id", "left")
        forced = F.coalesce("overridden", F.lit(False))
    own = tables.select("doc_id", "table_id")
    p = cells.join(own, "table_id").groupBy("doc_id").agg((F.count("value") / F.count(F.lit(1))).alias("parse"))
    a = arithmetic.groupBy("doc_id").agg(F.avg(F.col("passed").cast("double")).alias("arithmetic"))
    g = rows.groupBy("doc_id").agg((F.count("tag") / F.count(F.lit(1))).alias("tags"))
    d = t.join(p, "doc_id", "left").join(a, "doc_id", "left").join(g, "doc_id", "left")
    low = {n: F.coalesce(F.col(n), F.lit(0.0)) < v for n, v in limits.items()}
    low["statements"] = (low["statements"] | (F.col("max_per_type") > most)) & ~forced
    fails = F.filter(F.array(*[F.when(low[n], F.lit(n)) for n in limits]), lambda x: x.isNotNull())
    return d.select("doc_id", "max_per_type", forced.alias("overridden"), *[F.round(F.coalesce(F.col(n), F.lit(0.0)), 4).alias(n) for n in limits], F.get(fails, F.lit(0)).alias("first_failing"), F.size(fails).alias("n_failed"))


def classification_metrics(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class. Each row counts once under its label and once under its prediction."""
    both = pred.select(F.explode(F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_label"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))).alias("one_side")).select("one_side.*")
    c = both.groupBy("cls").agg(F.sum("is_label").alias("support"), F.count_if(F.col("is_label") == 0).alias("predicted"), F.sum("hit").alias("hits"))
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return c.select("cls", "support", "predicted", "hits", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def metrics_summary(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and macro F1 over the classes that occur as labels, with the number of errors."""
    c = classification_metrics(pred, label, predicted).where("support > 0")
    hit = (F.col(label) == F.col(predicted)).cast("double")
    total = pred.agg(F.round(F.avg(hit), 4).alias("accuracy"), F.count_if(hit == 0).alias("errors"), F.count(F.lit(1)).alias("n"))
    return total.join(c.agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes")), F.lit(True))  # one row each


def error_pairs(pred: DataFrame, label: str, predicted: str, k: int = 5) -> DataFrame:
    """The k most frequent confusions."""
    return confusion(pred, label, predicted).where("label <> predicted").orderBy(F.desc("n"), "label", "predicted").limit(k)


def confusion(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def top_k_counts(df: DataFrame, key: str, ord_col: str, k: int) -> DataFrame:
    """the k most frequent keys, the first seen among equals."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def latest(df: DataFrame, order: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the newest rows."""
    return df.orderBy(F.desc(order), F.desc(tie)).offset(offset).limit(limit)


class Pages:
    """Pages of the newest rows at any depth. Rows are written once by ranges of their order, and the ranges counted; a page reads the ranges that
    hold it and sorts only these, so the ten-thousandth page costs what the first does."""

    def __init__(self, df: DataFrame, order: str, tie: str, ranges: int | None = None):
        from .tagging import shared_path

        self.order = [F.desc(order), F.desc(tie)]
        self.path, self.schema, self.spark = shared_path(df.sparkSession, "pages"), df.schema, df.sparkSession
        dealt = df.repartitionByRange(ranges, *self.order) if ranges else df.repartitionByRange(*self.order)
        dealt.withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(self.path)
        self.sizes = sorted(self._all().groupBy("__range").count().collect())  # a row for each range

    def _all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("__range", IntegerType())])).parquet(self.path)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        before, held, skip = 0, [], None
        for r, n in self.sizes:
            if before < offset + limit and before + n > offset:
                skip = offset - before if skip is None else skip
                held.append(r)
            before += n
        rows = self._all().where(F.col("__range").isin(held) if held else F.lit(False)).drop("__range")
        return rows.orderBy(*self.order).offset(skip or 0).limit(limit)


def cumulative_tiers(core: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """G1: an ordered distinct union, core first, cut at n. core, pool: doc_id, ord. min_by combines; only n rows are ordered in the end."""
    both = core.select("doc_id", F.struct(F.lit(0).alias("src"), "ord").alias("o")).unionByName(pool.select("doc_id", F.struct(F.lit(1).alias("src"), "ord").alias("o")))
    return both.groupBy("doc_id").agg(F.min("o").alias("o")).orderBy("o", "doc_id").limit(n).select("doc_id", F.col("o.src").alias("src"))


def newest(delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, without the column it is newest by."""
    cols = [c for c in delta.columns if c not in keys and c != order]
    return delta.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("newest")).select(*keys, "newest.*")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, from 0, in a total order: ranges are sorted apart, and each adds the sizes of those before it. So no task sees all rows."""
    from .tagging import shared_table

    ranges = shared_table(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("nth", nth).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("nth") - 1).drop("range", "nth", "before")


def pending_work(source: DataFrame, done: DataFrame, key: str, shards: int, size: str, most: int) -> DataFrame:
    """Source rows of at most `most` in size and without complete output, in the order of size and key, dealt to shards in turn."""
    left = source.where(F.col(size) <= most).join(done.where("complete").select(key), key, "left_anti")
    return numbered(left, size, key).withColumn("shard", (F.col("place") % shards).cast("int")).drop("place")


def concept_set_algebra(all_: DataFrame, *others: DataFrame) -> DataFrame:
    """What is in the first set and in none of the others: all less confirmed less contradicted."""
    out = all_.distinct()
    for other in others:
        out = out.subtract(other)
    return out


def in_all_documents(concepts: DataFrame) -> DataFrame:
    """The intersection over documents. concepts: doc_id, concept_id."""
    n = concepts.select(F.count_distinct("doc_id").alias("total"))
    return concepts.groupBy("concept_id").agg(F.count_distinct("doc_id").alias("n_docs")).join(n, F.col("n_docs") == F.col("total")).select("concept_id", "n_docs")


def map_trial_balance(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ledger balances by class and concept, with totals of classes and of all; an account may be split by per cent, and its
    intercompany part is summed apart. accounts: account, concept_id, cls, pct, ic."""
    j = ledger.join(accounts, "account").withColumn("part", F.col("balance") * F.col("pct") / 100)
    return j.rollup("cls", "concept_id").agg(
        F.round(F.sum("part"), 2).alias("balance"), F.round(F.coalesce(F.sum(F.when(F.col("ic"), F.col("part"))), F.lit(0.0)), 2).alias("intercompany"), F.count(F.lit(1)).alias("n_accounts"), F.grouping_id().cast("int").alias("level")
    )


def segment_mapping(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Amounts by target segment: one to one, many to one, or split by per cent, by the concept's latest confirmed mapping up to the
    fact's year (carried forward); a segment is comparable in a period if two documents at least have it. mapping: concept_id, year, segment, pct, confirmed."""
    m = mapping.where("confirmed")
    f = facts.withColumn("year", F.regexp_extract("period_key", "^Y([0-9]{4})$", 1).try_cast("int")).where("year is not null")
    asof = f.select("concept_id", "year").distinct().join(m.select("concept_id", F.col("year").alias("since")).distinct(), "concept_id").where("since <= year")
    asof = asof.groupBy("concept_id", "year").agg(F.max("since").alias("since"))  # a row for each concept and year
    f = f.join(asof, ["concept_id", "year"]).join(m.select("concept_id", F.col("year").alias("since"), "segment", "pct"), ["concept_id", "since"])
    out = f.groupBy("doc_id", "period_key", "segment").agg(F.round(F.sum(F.col("amount") * F.col("pct") / 100), 2).alias("amount"), F.count(F.lit(1)).alias("n_facts"), F.bool_or(F.col("since") < F.col("year")).alias("carried"))
    n = out.groupBy("period_key", "segment").agg(F.count(F.lit(1)).alias("n_docs"))
    return out.join(n, ["period_key", "segment"]).withColumn("comparable", F.col("n_docs") >= 2)


def run_progress(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Completed against configured documents of each run. runs: run_id, n_configured; results: run_id, doc_id, status."""
    r = results.groupBy("run_id").agg(F.count_distinct("doc_id").alias("n_seen"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"))
    j = runs.join(r, "run_id", "left").fillna(0, ["n_seen", "n_ok", "n_error"])
    return j.withColumn("state", F.when(F.col("n_seen") >= F.col("n_configured"), "completed").when(F.col("n_seen") > 0, "running").otherwise("pending"))


SIZES = (604_800, 86_400, 21_600, 3_600, 900, 300, 60)


def adaptive_buckets(events: DataFrame, bins: int = 20, by: str | None = None) -> DataFrame:
    """K3: counts over about `bins` bins: zero-filled bins of the largest size that divides the span so often; where the events fall on under
    `bins` minutes or are no more than `bins`, chunks of equal count. One row of extremes sets the kind. With `by`, counts for each of its values."""
    minute = F.date_trunc("minute", "ts")
    lo, hi, minutes, total = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")), F.approx_count_distinct(minute, 0.05), F.count(F.lit(1))).first()
    if lo is None:
        return events.sparkSession.createDataFrame([], "bucket long, n long")
    if minutes < 2 * bins:  # near the limit, count exactly; there are few minutes then
        minutes = events.select(minute).distinct().count()
    key = [by] if by else []
    if minutes < bins or total <= bins:
        size = -(-total // bins)
        chunk = numbered(events.withColumn("second", F.unix_timestamp("ts")), "second", "event_id").withColumn("chunk", F.floor(F.col("place") / size))
        return chunk.groupBy("chunk", *key).agg(F.min("second").alias("bucket"), F.count(F.lit(1)).alias("n")).drop("chunk")
    if by:
        size = next((s for s in SIZES if (hi - lo) / s >= bins), 60)
        n = events.groupBy((F.floor(F.unix_timestamp("ts") / size) * size).alias("bucket"), by).agg(F.count(F.lit(1)).alias("n"))
        values = n.select(by).distinct()
        spine = values.withColumn("bucket", F.explode(F.sequence(F.lit(lo // size * size), F.lit(hi // size * size), F.lit(size))))
        return spine.join(n, ["bucket", by], "left").fillna(0, ["n"])
    size = next((s for s in SIZES if (hi - lo) / s >= bins), 60)
    n = events.groupBy((F.floor(F.unix_timestamp("ts") / size) * size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = events.sparkSession.range(lo // size * size, hi + 1, size).select(F.col("id").alias("bucket"))
    return spine.join(n, "bucket", "left").fillna(0, ["n"])
