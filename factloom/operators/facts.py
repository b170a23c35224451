"""Facts: from tagged rows and value cells to one amount for each document, context, concept and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["doc_id", "context", "concept_id", "period_key"]


def unit_scale(unit: Column) -> Column:
    """Factor of a unit or header text. Longer units are tested first."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(u.rlike("mrd|billion"), 1e9).when(u.rlike("mio|million"), 1e6).when(u.rlike("teur|tsd|thousand|(?:^|[^0-9])000"), 1e3).otherwise(1.0)


def parse_amounts(cells: DataFrame, text: str = "text", out: str = "parsed") -> DataFrame:
    """Amounts from texts. Dashes are 0, n/a is null, parentheses and a leading minus are negative; the last of point and comma is the
    decimal sign; a single comma is one before at most two digits; several points, or a comma before three digits, part thousands.
    The steps are columns of their own, so that none is evaluated more than once."""
    d = cells.withColumn("__t", F.regexp_replace(F.translate(text, "\u00a0%", "  "), r"\s", ""))
    d = d.withColumn("__d", F.regexp_replace("__t", r"^[(−-]+|\)+$", ""))
    d = d.withColumns({"__points": F.regexp_count("__d", F.lit("[.]")), "__commas": F.regexp_count("__d", F.lit(",")), "__comma_last": F.col("__d").rlike(",[^.]*$"), "__cents": F.col("__d").rlike("^[^,]*,[0-9]{1,2}$")})
    as_comma = (F.col("__commas") > 0) & F.when(F.col("__points") > 0, F.col("__comma_last")).otherwise(F.col("__cents"))
    d = d.withColumn("__n", F.when(as_comma, F.translate("__d", ",.", ".")).when((F.col("__commas") > 0) | (F.col("__points") == 1), F.translate("__d", ",", "")).otherwise(F.translate("__d", ".", "")))
    value = F.when(F.col("__n").rlike(r"^[0-9]+([.][0-9]*)?$|^[.][0-9]+$"), F.col("__n").try_cast("double"))
    signed = F.when(F.col("__t").rlike(r"^\(.*\)$|^[-−]"), -value).otherwise(value)
    return d.withColumn(out, F.when(F.col("__t").rlike("^[-–—−]$"), 0.0).otherwise(signed)).drop("__t", "__d", "__points", "__commas", "__comma_last", "__cents", "__n")


def period_keys(columns: DataFrame) -> DataFrame:
    """The period of each value column: its axis, else its rank among the table's value columns."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("col_idx")) - 1
    values = columns.where("role = 'VALUE'").withColumn("pos", rank)
    return values.select("doc_id", "table_id", "col_idx", F.coalesce(F.regexp_replace("period_axis", "^PERIOD[.]", ""), F.concat(F.lit("ord_"), F.col("pos").cast("string"))).alias("period_key"))


def normalize_sign(amount: Column, convention: Column, context: Column, balance: Column) -> Column:
    """Natural signs stay; results are negated; otherwise the sign follows the balance type, if it is known."""
    by_balance = F.when(balance == "credit", -F.abs(amount)).when(balance == "debit", F.abs(amount)).otherwise(amount)
    return F.when(convention == "NATURAL_DRCR", amount).when(context.isin("PNL", "OCI"), -amount).otherwise(by_balance)


def scale_amounts(cells: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Amounts of value columns times the scale of the column's header, else of the table's unit; per cent and per-share columns stay."""
    k = columns.where("role = 'VALUE'").select("table_id", "col_idx", "header")
    c = cells.where("value is not null").join(k, ["table_id", "col_idx"]).join(tables.select("table_id", "unit"), "table_id")
    header = unit_scale(F.col("header"))
    factor = F.when(F.col("header").contains("%") | F.lower("header").contains("per share"), 1.0).otherwise(F.coalesce(F.when(header > 1, header), unit_scale(F.col("unit"))))
    return c.select("row_id", "col_idx", F.round(F.col("value") * factor, 2).alias("scaled"))


PRIMARY = ("PNL", "SFP", "OCI", "CFS", "SOCIE")
WIDE = 4  # tables with more value columns than this hold segments


def index_facts(rows: DataFrame, cells: DataFrame, tables: DataFrame, columns: DataFrame, concepts: DataFrame, matches: DataFrame) -> DataFrame:
    """Scaled and signed facts of tagged rows and of untagged ones whose label matches a concept (matches: row_id, concept_id, label_context, and table_id if they have it).
    A tagged fact's context is its table's, else its concept's; a matched one's is its table's, else its label's. Of wide tables, matched facts come only from
    the last column of each period (columns without a date count as one period), and segment concepts match only there."""
    values = columns.where("role = 'VALUE'")
    dated = F.coalesce(F.regexp_replace("period_axis", "^PERIOD[.]", ""), F.lit("ord_0"))
    last = values.groupBy("table_id", dated.alias("dated")).agg(F.max("col_idx").alias("col_idx")).select("table_id", "col_idx", F.lit(True).alias("is_last"))
    n_cols = values.groupBy("table_id").agg(F.count(F.lit(1)).alias("value_cols"))
    periods = period_keys(columns).drop("doc_id").join(last, ["table_id", "col_idx"], "left").join(n_cols, "table_id")
    # one left join, not a union of tagged and matched rows, which would forget how rows are dealt
    on = [c for c in ("table_id", "row_id") if c in matches.columns]
    m = matches.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("concept_id").alias("matched"), "label_context")
    same = [F.col(c) == F.col(f"__{c}") for c in on]
    f = rows.select("doc_id", "table_id", "row_id", "label", "tag").join(m, [*same, F.col("tag").isNull()], "left").where("tag is not null or __row_id is not null")
    f = f.select("doc_id", "table_id", "row_id", "label", F.coalesce("tag", "matched").alias("concept_id"), "label_context", F.when(F.col("tag").isNotNull(), "tag").otherwise("label").alias("source"))
    f = f.join(cells.where("value is not null").select("table_id", "row_id", "col_idx", "value"), ["table_id", "row_id"])
    f = f.join(tables.select("table_id", "context", "unit", "sign_convention", "page_no"), "table_id").join(periods, ["table_id", "col_idx"])
    wide = F.col("value_cols") > WIDE
    f = f.where((F.col("source") == "tag") | (wide & F.coalesce("is_last", F.lit(False))) | (~wide & (F.coalesce("label_context", F.lit("")) != "DISC.SEGMENTS")))
    f = f.join(concepts.select("concept_id", "balance_type", "valid_context"), "concept_id", "left")
    f = f.withColumn("is_primary", F.coalesce(F.col("context").isin(*PRIMARY), F.lit(False)))
    f = f.withColumn("context", F.coalesce("context", F.when(F.col("source") == "tag", F.col("valid_context")).otherwise(F.col("label_context"))))
    amount = normalize_sign(F.col("value") * unit_scale(F.col("unit")), F.col("sign_convention"), F.col("context"), F.col("balance_type"))
    return f.select("doc_id", "table_id", "row_id", "context", "concept_id", "period_key", "col_idx", F.round(amount, 2).alias("amount"), "page_no", "is_primary", "value_cols", "label", "source")


def best_fact(facts: DataFrame) -> DataFrame:
    """One fact of each key: of primary statements first, then of narrow tables, then the first table and place.
    A min over a struct combines before the shuffle, which a window would not."""
    rank = F.struct((~F.col("is_primary")).cast("int"), (F.col("value_cols") > 4).cast("int"), "table_id", "row_id", "col_idx")
    return facts.groupBy(KEY).agg(F.min_by(F.struct("table_id", "row_id", "col_idx", "amount", "value_cols"), rank).alias("best_one")).select(*KEY, "best_one.*")


def sum_by_axis(facts: DataFrame) -> DataFrame:
    """D3: the sum of all facts of a key."""
    return facts.groupBy(KEY).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count(F.lit(1)).alias("n_facts"))


def recent_periods(facts: DataFrame, n: int = 2) -> DataFrame:
    """A document's latest n years, or its first n keys where no key is a year."""
    year = F.regexp_extract("period_key", "^Y([0-9]{4})$", 1)
    keys = facts.select("doc_id", "period_key").distinct().withColumns({"dated": (year != "").cast("int"), "year": F.when(year != "", year.cast("int"))})
    group = F.when(F.col("period_key") == "CURRENT", 0).when(F.col("period_key") == "COMPARATIVE", 1).when(F.col("period_key").startswith("COMPARATIVE_"), 2).otherwise(3)
    keys = keys.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("dated"), F.desc("year"), group, "period_key")))
    keys = keys.withColumn("any_dated", F.max("dated").over(Window.partitionBy("doc_id")))
    return keys.where((F.col("rank") <= n) & (F.col("dated") == F.col("any_dated"))).select("doc_id", "period_key", "rank")
