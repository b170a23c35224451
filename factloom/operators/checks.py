"""Checks between facts: sums, ties, details, mismatches, rules, and scores of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 1000.0


def scale_mismatch(a: Column, b: Column) -> Column:
    """The factor (1e3, 1e6 or an inverse) by which a is off b, within one per cent; null if there is none."""
    ratio = F.when((a != 0) & (b != 0), F.abs(a / b))
    out = F.lit(None).cast("double")
    for s in (1e3, 1e6, 1e-3, 1e-6):
        out = F.when(ratio.between(s * 0.99, s * 1.01), F.lit(s)).otherwise(out)
    return out


def check_summation(best: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """A parent against the sum of the children that its context has. Each fact meets the edges in which it is the parent or a child once, and one
    aggregate by document, context, period and edge has both sides."""
    e = edges.where("edge_type = 'SUMMATION'").select("edge_name", "context", F.col("concept_id").alias("parent"), "tol")
    all_ = members.groupBy("edge_name").agg(F.collect_set("concept_id").alias("members"))
    roles = e.select("edge_name", "context", F.col("parent").alias("concept_id"), F.lit(True).alias("is_parent")).unionByName(e.select("edge_name", "context").join(members.select("edge_name", "concept_id"), "edge_name").withColumn("is_parent", F.lit(False)))
    wide, up, kid = F.col("value_cols") > 4, F.col("is_parent"), ~F.col("is_parent")
    g = best.join(roles, ["context", "concept_id"]).groupBy("doc_id", "context", "period_key", "edge_name").agg(
        F.max(F.when(up, F.col("amount"))).alias("expected"), F.max(F.when(up, wide)).alias("p_wide"), F.sum(F.when(kid, F.col("amount"))).alias("actual"), F.count_if(kid).alias("found"),
        F.collect_set(F.when(kid, F.col("concept_id"))).alias("have"), F.max(F.when(kid, wide)).alias("any_wide"), F.min(F.when(kid, wide)).alias("all_wide"),
    )
    same = F.when(F.col("p_wide"), F.col("all_wide")).otherwise(~F.col("any_wide"))
    out = g.where(F.col("expected").isNotNull() & (F.col("found") > 0)).where(same).join(e.select("edge_name", "tol"), "edge_name").join(all_, "edge_name")
    missing = F.array_join(F.array_sort(F.array_except("members", "have")), ",")
    delta = F.round(F.col("expected") - F.col("actual"), 2)
    status = F.when(F.abs(delta) <= F.col("tol"), "valid").when(scale_mismatch(F.col("expected"), F.col("actual")).isNotNull(), "scale").when(missing != "", "partial").otherwise("broken")
    return out.select("doc_id", "context", "period_key", "edge_name", "expected", F.round("actual", 2).alias("actual"), delta.alias("delta"), "found", missing.alias("missing"), status.alias("status"))


def check_cross_statement(best: DataFrame, edges: DataFrame) -> DataFrame:
    """A concept of one statement against one of another (the same, if other_concept is null) at the same period: they are equal, or, where
    the edge's rule is 'opposite', their sum is 0. What a factor of scale explains is no breach."""
    e = edges.where("edge_type = 'CROSS_STATEMENT_TIE'").select("edge_name", F.col("context").alias("c1"), "concept_id", F.coalesce("other_concept", "concept_id").alias("other"), F.col("other_context").alias("c2"), "rule", "tol")
    a = best.join(e, "concept_id").where("context = c1").select("doc_id", "period_key", "edge_name", "concept_id", "other", "c2", "rule", "tol", F.col("amount").alias("expected"))
    b = best.select("doc_id", "period_key", F.col("concept_id").alias("other"), F.col("context").alias("c2"), F.col("amount").alias("actual"))
    delta = F.round(F.when(F.col("rule") == "opposite", F.col("expected") + F.col("actual")).otherwise(F.col("expected") - F.col("actual")), 2)
    status = F.when(F.abs(delta) <= F.col("tol"), "valid").when(scale_mismatch(F.col("expected"), F.col("actual")).isNotNull(), "scale").otherwise("broken")
    return a.join(b, ["doc_id", "period_key", "other", "c2"]).select("doc_id", "edge_name", "concept_id", F.col("other").alias("other_concept"), "period_key", "expected", "actual", delta.alias("delta"), status.alias("status"))


def check_note_to_face(best: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """A face amount against the sum of its notes' amounts, signs aside; a deviation of under 0.01 % is only noted."""
    e = edges.where("edge_type = 'NOTE_TO_FACE'").select("edge_name", F.col("context").alias("face_context"), F.col("concept_id").alias("face"), F.col("other_context").alias("note_context"), "tol")
    m = members.select("edge_name", "concept_id").join(e, "edge_name")
    notes = best.join(m, "concept_id").where("context = note_context").groupBy("doc_id", "period_key", "edge_name").agg(F.sum("amount").alias("note"), F.count(F.lit(1)).alias("n"))
    face = best.join(e, (F.col("concept_id") == F.col("face")) & (F.col("context") == F.col("face_context"))).select("doc_id", "period_key", "edge_name", "tol", F.col("amount").alias("expected"))
    delta = F.round(F.abs(F.abs("expected") - F.abs("note")), 2)
    severity = F.when(delta <= F.col("tol"), "OK").when(delta < 1e-4 * F.abs("expected"), "INFO").otherwise("ERROR")
    return face.join(notes, ["doc_id", "period_key", "edge_name"]).select("doc_id", "edge_name", "period_key", "expected", F.round("note", 2).alias("actual"), F.col("n").alias("n_notes"), delta.alias("delta"), severity.alias("severity"))


def check_disaggregation(best: DataFrame, sums: DataFrame, edges: DataFrame, members: DataFrame, confirm: DataFrame, causes: dict[str, list[str]]) -> DataFrame:
    """A face amount against the sum of its detail facts, and what a residual is: confirmed by a tagged intercompany line
    (confirm: edge_name, confirm_context, confirm_concept) within the tolerance, a rounding, a factor of scale, or open, with an edge's possible causes."""
    e = edges.where("edge_type = 'DISAGGREGATION'").select("edge_name", F.col("context").alias("c1"), F.col("concept_id").alias("face"), F.col("other_context").alias("c2"), "tol")
    face = best.join(e, (F.col("concept_id") == F.col("face")) & (F.col("context") == F.col("c1"))).select("doc_id", "period_key", "edge_name", "c2", "tol", F.col("amount").alias("expected"))
    d = members.select("edge_name", "concept_id")
    detail = sums.join(d, "concept_id").groupBy("doc_id", "period_key", "edge_name", F.col("context").alias("c2")).agg(F.sum("amount").alias("actual"))
    delta = F.round(F.col("expected") - F.col("actual"), 2)
    line = best.join(confirm, (F.col("concept_id") == F.col("confirm_concept")) & (F.col("context") == F.col("confirm_context"))).select("doc_id", "period_key", "edge_name", F.col("amount").alias("line"))
    confirmed = F.coalesce(F.abs(F.col("line") - delta) <= F.col("tol"), F.lit(False))
    triage = F.when(F.abs(delta) <= F.col("tol"), "valid").when(confirmed, "confirmed").when(F.abs(delta) < 1e-4 * F.abs("expected"), "rounding").when(scale_mismatch(F.col("expected"), F.col("actual")).isNotNull(), "scale").otherwise("residual")
    known = F.lit(None).cast("string")
    for name, list_ in causes.items():
        known = F.when(F.col("edge_name") == name, ",".join(list_)).otherwise(known)
    out = face.join(detail, ["doc_id", "period_key", "edge_name", "c2"]).join(line, ["doc_id", "period_key", "edge_name"], "left")
    out = out.select("doc_id", "edge_name", "period_key", "expected", F.round("actual", 2).alias("actual"), delta.alias("delta"), triage.alias("triage"))
    return out.withColumn("causes", F.when(F.col("triage") == "residual", known))


def check_ratio(best: DataFrame, context: str, result: str, numerator: str, denominator: str, tol: float, diff_tol: float = TOLERANCE) -> DataFrame:
    """A result equals a quotient within tol, or a difference within diff_tol. One aggregate turns the three concepts into columns."""
    pick = lambda c: F.max(F.when(F.col("concept_id") == c, F.col("amount")))
    wide = best.where((F.col("context") == context) & F.col("concept_id").isin(result, numerator, denominator)).groupBy("doc_id", "period_key").agg(pick(result).alias("r"), pick(numerator).alias("n"), pick(denominator).alias("d"))
    wide = wide.where("r is not null and n is not null and d is not null and d <> 0")
    by_ratio, by_diff = F.abs(F.col("r") - F.col("n") / F.col("d")) <= tol, F.abs(F.col("r") - (F.col("n") - F.col("d"))) <= diff_tol
    return wide.select("doc_id", "period_key", F.col("r").alias("actual"), F.round(F.col("n") / F.col("d"), 6).alias("ratio"), F.when(by_ratio, "ratio").when(by_diff, "difference").otherwise("broken").alias("status"))


def concept_mismatches(facts: DataFrame) -> DataFrame:
    """A concept with different amounts in several tables at one period; the document's first such period."""
    g = facts.groupBy("doc_id", "concept_id", "period_key").agg(F.count_distinct("table_id").alias("n_tables"), F.count_distinct("amount").alias("n_amounts"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    g = g.where("n_tables > 1 and n_amounts > 1")
    return g.groupBy("doc_id", "concept_id").agg(F.min_by(F.struct("period_key", "n_tables", "n_amounts", "low", "high"), "period_key").alias("x")).select("doc_id", "concept_id", "x.*")


def first_mismatches(facts: DataFrame) -> DataFrame:
    """The keys of D11 without its counts: several distinct values have a least and a greatest that differ, which combines before the shuffle."""
    g = facts.groupBy("doc_id", "concept_id", "period_key").agg((F.min("table_id") < F.max("table_id")).alias("tables"), (F.min("amount") < F.max("amount")).alias("amounts"))
    return g.where("tables and amounts").groupBy("doc_id", "concept_id").agg(F.min("period_key").alias("period_key"))


def collided(facts: DataFrame, min_abs: float = 100) -> DataFrame:
    """The keys of D12 without its counts."""
    g = facts.where(F.abs("amount") >= min_abs).groupBy("doc_id", "amount").agg((F.min("table_id") < F.max("table_id")).alias("tables"), (F.min("concept_id") < F.max("concept_id")).alias("concepts"))
    return g.where("tables and concepts").select("doc_id", "amount")


def amount_collisions(facts: DataFrame, min_abs: float = 100) -> DataFrame:
    """One amount in several tables under several concepts."""
    g = facts.where(F.abs("amount") >= min_abs).groupBy("doc_id", "amount").agg(F.count_distinct("table_id").alias("n_tables"), F.array_join(F.array_sort(F.collect_set("concept_id")), ",").alias("concepts"), F.count_distinct("concept_id").alias("n_concepts"))
    return g.where("n_tables > 1 and n_concepts > 1")


#: Labels too generic to compare amounts by. Fixed values.
GENERIC = ("other", "total", "thereof", "davon", "summe", "gesamt", "sonstige")
NON_MONETARY = ("shares", "per_share", "percentage", "dimensionless")


def explain_mismatches(mismatches: DataFrame, facts: DataFrame, concepts: DataFrame, seen: DataFrame) -> DataFrame:
    """D13, concepts: what a mismatch of D11 may come from. Concepts that a check names already, and those without money, are left out;
    then comes a share count in notes, a concept with several measurements, and a pair of amounts, earlier over later, apart by a factor of scale.
    concepts: concept_id, unit_type, note_unit_type, n_variants."""
    m = mismatches.join(seen.select("doc_id", "concept_id").distinct(), ["doc_id", "concept_id"], "left_anti").join(concepts.select("concept_id", "unit_type", "note_unit_type", "n_variants"), "concept_id", "left")
    m = m.where(~F.coalesce(F.col("unit_type").isin(*NON_MONETARY), F.lit(False)))
    key = ["doc_id", "concept_id", "period_key"]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("table_id", "row_id", "col_idx", "amount"))), lambda x: x["amount"])  # a document's facts of one concept and period
    amounts = facts.join(m.select(*key), key, "left_semi").groupBy(*key).agg(in_order.alias("a"))
    ratio = lambda x, y: F.abs(F.try_divide(x, F.nullif(y, F.lit(0.0))))
    scale = lambda r: ((r > 990) & (r < 1010)) | ((r > 990_000) & (r < 1_010_000))
    found = F.exists(F.transform("a", lambda x, i: F.exists(F.slice("a", i + 2, F.size("a")), lambda y: F.coalesce((x != 0) & scale(ratio(x, y)), F.lit(False)))), lambda b: b)
    pattern = F.when(F.col("note_unit_type") == "shares", "SHARE_COUNT_VS_MONETARY").when(F.col("n_variants") > 0, "GROSS_VS_NET").when(found, "UNIT_SCALE")
    return m.join(amounts, key).select(*key, pattern.alias("pattern_id"), F.size("a").alias("n_facts")).where("pattern_id is not null")


def explain_collisions(collisions: DataFrame, facts: DataFrame, seen: DataFrame, associates: str = "DISC.ASSOCIATES") -> DataFrame:
    """D13, amounts: collisions of D12 in which an associate's own figures take part; generic labels and concepts that a check
    names already are left out."""
    f = facts.join(collisions.select("doc_id", "amount"), ["doc_id", "amount"]).join(seen.select("doc_id", "concept_id").distinct().withColumn("seen", F.lit(True)), ["doc_id", "concept_id"], "left")
    low = F.lower("label")
    generic = F.exists(F.array(*map(F.lit, GENERIC)), lambda w: F.contains(low, w))
    g = f.groupBy("doc_id", "amount").agg(F.bool_or(generic).alias("generic"), F.bool_or(F.col("seen").isNotNull()).alias("explained"), F.bool_or(F.col("context") == associates).alias("own"), F.array_join(F.array_sort(F.collect_set("concept_id")), ",").alias("concepts"))
    return g.where("own and not generic and not explained").select("doc_id", "amount", "concepts", F.lit("ASSOCIATE_OWN_FIGURES").alias("pattern_id"))


def context_violations(facts: DataFrame, valid: DataFrame, explained: DataFrame) -> DataFrame:
    """Concepts in a context that isn't among theirs; disclosures are exempt, and so is what is explained already.
    valid: concept_id, context, one row for each context of a concept; explained: doc_id, concept_id."""
    own = valid.groupBy("concept_id").agg(F.array_sort(F.collect_set("context")).alias("own"))
    f = facts.where("context not like 'DISC.%'").join(own, "concept_id").where(~F.array_contains("own", F.col("context"))).join(explained.select("doc_id", "concept_id").distinct(), ["doc_id", "concept_id"], "left_anti")
    return f.groupBy("doc_id", "concept_id", "context", F.array_join("own", ",").alias("valid_contexts")).agg(F.count(F.lit(1)).alias("n_facts"), F.min("table_id").alias("first_table"))


def score_facts(facts: DataFrame, *checks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """A status for each (table, concept, column): contradicted, confirmed by two checks, corroborated by one, or neither.
    checks: doc_id, table_id, concept_id, col_idx, check_type, edge_name, passed, explained; the first of a kind counts. Sets of checks that share no kind
    (check_type, edge_name) may be given apart: each meets the facts in a join of its own, so that sets dealt like the facts stay so, which a union would forget. keep writes each set's sums, so that a
    task holds the aggregates of one set at a time, and facts look them up there instead of being sorted. What the first check says is one number, which needs no sort if ord is one too."""
    key, counts = ["doc_id", "table_id", "concept_id", "col_idx"], ["n_passed", "n_failed", "n_explained"]
    out = facts.groupBy(key).agg(F.min("row_id").alias("row_id"))
    for k, one in enumerate(checks):
        says = F.when(F.col("passed"), 0).when(~F.col("passed") & ~F.col("explained"), 1).when(~F.col("passed") & F.col("explained"), 2)
        once = one.groupBy(*key, "check_type", "edge_name").agg(F.min_by(says, "ord").alias("says"))
        sums = once.groupBy(key).agg(*[F.count_if(F.col("says") == code).alias(f"{n}_{k}") for code, n in enumerate(counts)])
        out = out.join(sums if keep is None else keep(sums, "sums").hint("shuffle_hash"), key, "left")
    out = out.select(*key, "row_id", *[sum((F.coalesce(f"{n}_{k}", F.lit(0)) for k in range(len(checks))), F.lit(0).cast("long")).alias(n) for n in counts])
    status = F.when(F.col("n_failed") > 0, "CONTRADICTED").when(F.col("n_passed") >= 2, "CONFIRMED").when(F.col("n_passed") == 1, "CORROBORATED").otherwise("UNCONFIRMED")
    return out.select(*key, "row_id", *counts, status.alias("status"))


def period_changes(best: DataFrame, limit: float = 2.0) -> DataFrame:
    """D41, changes: amounts that differ from the year before by more than `limit` times it."""
    year = F.regexp_extract("period_key", "^Y([0-9]{4})$", 1).try_cast("int")
    b = best.withColumn("year", year).where("year is not null")
    order = Window.partitionBy("doc_id", "context", "concept_id").orderBy("year")
    b = b.withColumns({"before": F.lag("amount").over(order), "year_before": F.lag("year").over(order)}).where("year - year_before = 1")
    change = F.abs(F.col("amount") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1.0))
    return b.where(change >= limit).withColumn("change", F.floor(change * 100) / 100).select("doc_id", "context", "concept_id", "period_key", "amount", "before", "change")


def rule_violations(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """D41, signs and contexts: rules (rule, context, pattern, sign) whose pattern a concept matches. sign '+', '-' or null (the concept is forbidden)."""
    r = rules
    f = facts.join(r, facts["context"] == r["rule_context"]).where(F.expr("concept_id like pattern"))
    bad = F.when(F.col("sign") == "+", F.col("amount") < 0).when(F.col("sign") == "-", F.col("amount") > 0).otherwise(F.lit(True))
    return f.where(bad).groupBy("doc_id", "rule", "concept_id").agg(F.count(F.lit(1)).alias("n_facts"), F.round(F.min("amount"), 2).alias("low"), F.round(F.max("amount"), 2).alias("high"))


def fact_uniqueness(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Identities that several facts share."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completeness_tier(facts: DataFrame, requirements: list[tuple[int, str, str]]) -> DataFrame:
    """The highest tier whose requirements, and those of all tiers below, a document has; with what is missing from the next."""
    docs = facts.select("doc_id").distinct()
    have = facts.select("doc_id", "context", "concept_id").distinct().withColumn("has", F.lit(True))
    need = docs.withColumn("wanted", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(c).alias("context"), F.lit(k).alias("concept_id")) for t, c, k in requirements]))).select("doc_id", "wanted.*")
    got = need.join(have, ["doc_id", "context", "concept_id"], "left").groupBy("doc_id", "tier").agg(
        F.bool_and(F.coalesce("has", F.lit(False))).alias("ok"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.concat_ws(":", "context", "concept_id")))), ",").alias("missing")
    )
    first_bad = got.groupBy("doc_id").agg(F.min(F.when(~F.col("ok"), F.struct("tier", "missing"))).alias("bad"), F.max("tier").alias("top"))
    return first_bad.select("doc_id", F.coalesce(F.col("bad.tier") - 1, F.col("top")).alias("tier"), F.coalesce("bad.missing", F.lit("")).alias("missing"))


def composite_residual(best: DataFrame, context: str, line: str, components: list[str]) -> DataFrame:
    """A line's amount less its known components."""
    b = best.where(F.col("context") == context).groupBy("doc_id", "period_key").agg(
        F.max(F.when(F.col("concept_id") == line, F.col("amount"))).alias("line"), F.sum(F.when(F.col("concept_id").isin(*components), F.col("amount"))).alias("known"), F.count_if(F.col("concept_id").isin(*components)).alias("n")
    )
    return b.where("line is not null").select("doc_id", "period_key", "line", F.round(F.coalesce("known", F.lit(0.0)), 2).alias("known"), F.round(F.col("line") - F.coalesce("known", F.lit(0.0)), 2).alias("residual"), "n")


#: Labels of reconciling items. Fixed values.
RECONCILING = "elimination|unallocated|reconcil|überleitung|konsolidierung"


def provenance_type(facts: DataFrame, totals: tuple[str, ...] = ("TOTAL",)) -> DataFrame:
    """The kind of each fact's place, and whether it can be compared in ties: statement, segment, reconciling item, associate's own, note total or
    detail, derived metric (ids that begin with KPI or APM), management report."""
    id_, context = F.col("concept_id"), F.col("context")
    kind = F.when(context == "MANAGEMENT_REPORT", "MANAGEMENT_REPORT").when(id_.rlike("^(KPI|APM)[.]"), "DERIVED_METRIC").when(F.col("is_primary"), "FACE_STATEMENT")
    kind = kind.when(context.startswith("DISC.ASSOC"), "ASSOCIATE_OWN").when(F.lower("label").rlike(RECONCILING), "RECONCILING_ITEM").when(context == "DISC.SEGMENTS", "SEGMENT_COMPONENT").when(id_.isin(*totals), "NOTE_TOTAL").otherwise("NOTE_DETAIL")
    comparable = F.col("provenance").isin("FACE_STATEMENT", "NOTE_TOTAL", "SEGMENT_COMPONENT", "RECONCILING_ITEM")
    return facts.withColumn("provenance", kind).groupBy("doc_id", "provenance").agg(F.count(F.lit(1)).alias("n_facts"), F.bool_and(comparable).alias("comparable"))
