"""Matching row labels with concepts, and dimensions of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L

SUFFIXES = (" total", " net", " gross")
PREFIXES = (("total ", 0.95), ("thereof ", 0.90), ("of which ", 0.90), ("davon ", 0.90))


def label_index(labels: DataFrame) -> DataFrame:
    """One concept for each normalised label: the source of the lowest precedence number, then the last concept in order."""
    norm = labels.withColumn("norm", L.norm_label_index(F.col("label"))).where(L.indexable_label(F.col("norm")))
    return norm.groupBy("norm").agg(F.min_by("concept_id", F.struct("precedence", "concept_id")).alias("concept_id"))


def match_labels_exact(rows: DataFrame, index: DataFrame, label: str = "raw") -> DataFrame:
    """Rows whose normalised label is in the index. Spark broadcasts the index if its measured size allows."""
    return rows.withColumn("norm", L.norm_label_index(F.col(label))).join(index, "norm").select("row_id", "norm", "concept_id", F.lit(1.0).alias("confidence"))


def match_labels_affix(rows: DataFrame, index: DataFrame, label: str = "raw") -> DataFrame:
    """Rows that match once an affix is taken off: suffixes first, then prefixes, which lower the confidence."""
    norm = L.norm_label_index(F.col(label))
    tries = [F.when(F.endswith(norm, F.lit(x)), F.struct(F.lit(k).alias("rank"), F.expr(f"left(norm, length(norm) - {len(x)})").alias("key"), F.lit(1.0).alias("confidence"))) for k, x in enumerate(SUFFIXES)]
    tries += [F.when(F.startswith(norm, F.lit(x)), F.struct(F.lit(len(SUFFIXES) + k).alias("rank"), F.expr(f"substring(norm, {len(x) + 1})").alias("key"), F.lit(c).alias("confidence"))) for k, (x, c) in enumerate(PREFIXES)]
    r = rows.withColumn("norm", norm).withColumn("try", F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull()))).select("row_id", "norm", F.col("try.rank").alias("rank"), F.col("try.key").alias("key"), F.col("try.confidence").alias("confidence"))
    found = r.join(index.select(F.col("norm").alias("key"), "concept_id"), "key").join(index.select("norm"), "norm", "left_anti")
    return found.groupBy("row_id").agg(F.min_by(F.struct("concept_id", "confidence"), "rank").alias("hit")).select("row_id", "hit.concept_id", "hit.confidence")


def match_context_guard(matches: DataFrame, concepts: DataFrame) -> DataFrame:
    """No disclosure concepts in primary tables; elsewhere only with a valid context. matches: row_id, context, concept_id."""
    m = matches.join(concepts.select("concept_id", "valid_context"), "concept_id", "left")
    disc = F.col("concept_id").startswith("DISC")
    keep = ~disc | (~F.col("context").isin("PNL", "SFP", "OCI", "CFS", "SOCIE") & (F.col("valid_context") == F.col("context")))
    return m.where(F.coalesce(keep, F.lit(False))).select(matches.columns)


def pieces(df: DataFrame, n: str, threshold: float) -> DataFrame:
    """A row for each piece of a label of n characters: d (edits that any partner may need), and the piece's number i, start and end."""
    out = df.withColumn("d", F.floor(F.col(n) * (1 - threshold) / threshold + 1e-9).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    cut = lambda k: F.floor(k * F.col(n) / (F.col("d") + 1)).cast("int")
    return out.withColumns({"start": cut(F.col("i")), "end": cut(F.col("i") + 1)}).where("end > start")


def bigrams(c: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda k: F.substring(F.col(c), k, F.lit(2))))


def fuzzy_candidates(labels: DataFrame, index: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of a label and an index label that may have the similarity: label, m, norm, concept_id, n, edits (the most that are allowed).

    An index label of n characters is cut into d + 1 pieces, d being the edits that any partner may need. A label within d edits of it has one
    of the pieces unchanged, and one at least (say piece i) with no more than i edits before it and no more than d - i behind it: were there more before every unchanged
    piece, the edits would run out behind it. So piece i is looked for only in those places of the label that lie within i of its own start, and within d - i of it
    counted from the end. Labels meet index labels by length, piece number and piece, all by equality, which Spark splits where one is hot. Pairs that are left are
    counted: each edit destroys two different bigrams at most, so pairs that share too few never come to the edit distance."""
    own = index.select("norm", "concept_id").withColumn("n", F.length("norm")).where("n > 0")
    i = pieces(own, "n", threshold).select("norm", "concept_id", "n", "i", F.expr("substring(norm, start + 1, end - start)").alias("piece"))
    q = labels.select("label").distinct().withColumn("m", F.length("label")).where("m > 0")
    q = q.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * threshold - 1e-9).cast("int"), F.floor(F.col("m") / threshold + 1e-9).cast("int"))))
    q = pieces(q, "n", threshold).withColumn("len", F.expr("end - start"))
    places = F.expr("sequence(greatest(0, start - i, start + m - n - d + i), least(m - len, start + i, start + m - n + d - i))")
    q = q.where("greatest(0, start - i, start + m - n - d + i) <= least(m - len, start + i, start + m - n + d - i)").withColumn("at", F.explode(places))
    near = q.select("label", "m", "n", "i", F.expr("substring(label, at + 1, len)").alias("piece")).join(i, ["n", "i", "piece"]).select("label", "m", "norm", "concept_id", "n").distinct()
    near = near.withColumn("edits", F.floor((1 - threshold) * F.greatest("m", "n") + 1e-9).cast("int")).where(F.abs(F.col("m") - F.col("n")) <= F.col("edits"))
    a, b = bigrams("label"), bigrams("norm")
    return near.where((F.col("m") < 2) | (F.col("n") < 2) | (F.size(F.array_intersect(a, b)) >= F.greatest(F.size(a), F.size(b)) - 2 * F.col("edits")))


def match_labels_fuzzy(labels: DataFrame, index: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The most similar index label of each distinct label: 1 - levenshtein / longer length, at least the threshold (over 0.5)."""
    near = fuzzy_candidates(labels, index, threshold)
    near = near.withColumn("score", 1 - F.levenshtein("label", "norm") / F.greatest("m", "n")).where(F.col("score") >= threshold)
    return near.groupBy("label").agg(F.max_by(F.struct("norm", "concept_id", "score"), F.struct("score", F.expr("-n"), "norm")).alias("hit")).select("label", "hit.norm", "hit.concept_id", F.round("hit.score", 6).alias("score"))


def label_dim(*sources: tuple[DataFrame, str, int]) -> DataFrame:
    """A5: (concept, label, language, source, precedence) from several sources; the language by umlauts."""
    out = None
    for df, name, rank in sources:
        one = df.select("concept_id", "label", F.when(F.lower("label").rlike("[äöüß]"), "de").otherwise("en").alias("language"), F.lit(name).alias("source"), F.lit(rank).alias("precedence"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def concept_dim(raw: DataFrame) -> DataFrame:
    """A4: concepts with defaults where a field is absent."""
    return raw.select("concept_id", F.coalesce("balance_type", F.lit("debit")).alias("balance_type"), F.coalesce("unit_type", F.lit("monetary")).alias("unit_type"), F.coalesce("valid_context", L.infer_context(F.col("concept_id"))).alias("valid_context"))


def candidate_concepts(tables: DataFrame, concepts: DataFrame, documents: DataFrame) -> DataFrame:
    """Concepts of a table's context; IFRS documents have no concepts of the local framework."""
    t = tables.where("context is not null").select("doc_id", "table_id", "context").join(documents.select("doc_id", "gaap"), "doc_id")
    c = concepts.select("concept_id", F.col("valid_context").alias("context"))
    return t.join(c, "context").where((F.col("gaap") != "IFRS") | ~F.col("concept_id").contains(".UGB.")).select("doc_id", "table_id", "context", "concept_id")


def search_concepts(concepts: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Concepts whose id or label contains q, in order."""
    hit = F.contains(F.lower("concept_id"), F.lit(q.lower())) | F.contains(F.lower("label"), F.lit(q.lower()))
    return concepts.where(hit).orderBy("concept_id", "label").limit(limit)


def search_documents(documents: DataFrame, q: str, allowed: DataFrame, status: DataFrame, limit: int = 20) -> DataFrame:
    """Documents whose entity contains q, among those allowed (doc_id), with their annotation status; in order. status: doc_id, status."""
    d = documents.where(F.contains(F.lower("entity"), F.lit(q.lower()))).select("doc_id", "entity").join(allowed.select("doc_id"), "doc_id", "left_semi")
    return d.join(status.select("doc_id", "status"), "doc_id").orderBy("entity", "doc_id").limit(limit)


def list_gaps(gaps: DataFrame, status: list[str], context: str | None = None) -> DataFrame:
    """Gaps (or proposals) of the given states, and of one context if it is given."""
    g = gaps.where(F.col("status").isin(*status))
    return g if context is None else g.where(F.col("context") == context)


def gap_report(rows: DataFrame, index: DataFrame, tables: DataFrame) -> DataFrame:
    """Labels of rows that no concept matches, by family (the context of their table), with their tables and pages."""
    r = rows.where(~L.is_untaggable(F.col("raw")) & ~L.is_excluded_topic(F.col("raw"))).withColumn("norm", L.norm_label_index(F.col("raw")))
    left = r.join(index.select("norm"), "norm", "left_anti").join(tables.select("table_id", F.coalesce("context", F.lit("none")).alias("family"), "page_no"), "table_id")
    return left.groupBy("family", "norm").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("table_id").alias("n_tables"), F.min("table_id").alias("first_table"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count_distinct("page_no").alias("n_pages"),
    )


def first_seen_members(labels: DataFrame, prefix: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Members of an axis for each document, numbered in the order in which their labels are first seen. labels: doc_id, label, ord."""
    first = labels.where(~F.lower("label").isin(*skip)).groupBy("doc_id", "label").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "label"))
    return first.select("doc_id", "label", F.format_string(f"{prefix}.%03d", n).alias("member_id"))
