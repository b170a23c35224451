"""Table structure: parents and children, arithmetic inside tables, quality, stitching, additive columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parent_child(rows: DataFrame, cells: DataFrame, value_cols: Column | None = None) -> DataFrame:
    """Value pairs of a parent row and its children: doc_id, table_id, parent_id, row_id, col_idx, parent_value, value.
    One join of cells with cells on (table, parent, column); rows only give the parent of each row."""
    links = rows.where("parent_id is not null").select("doc_id", "table_id", "row_id", "parent_id")
    if value_cols is not None:
        cells = cells.where(value_cols)
    child = cells.select("table_id", "row_id", "col_idx", "value").join(links, ["table_id", "row_id"])
    parent = cells.select("table_id", F.col("row_id").alias("parent_id"), "col_idx", F.col("value").alias("parent_value"))
    return child.join(parent, ["table_id", "parent_id", "col_idx"])


def parent_sums(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """C10 summed up: for each parent and column its own value p, the sum s of its children, their non-null number n and number k.
    Every cell goes to its own row's key and to its parent's, so one aggregate that combines before the shuffle replaces the
    join of cells with cells. Cells that carry parent_id need no rows to find it; `rows` may then be tables (doc_id, table_id), which cells with doc_id don't need either."""
    links = rows.select("doc_id", "table_id", "row_id", "parent_id") if "parent_id" not in cells.columns else None
    doc = [c for c in ("doc_id",) if links is None and c in cells.columns]
    c = cells.select("table_id", "row_id", "col_idx", "value").join(links, ["table_id", "row_id"]) if links is not None else cells.select(*doc, "table_id", "row_id", "col_idx", "value", "parent_id")
    none = F.lit(None).cast("double")
    own = F.struct(F.col("row_id").alias("parent"), F.col("value").alias("own"), none.alias("child"), F.lit(0).alias("kid"))
    up = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("parent"), none.alias("own"), F.col("value").alias("child"), F.lit(1).alias("kid")))
    keys = [*doc, "table_id", "col_idx"] if links is None else ["doc_id", "table_id", "col_idx"]
    both = c.select(*keys, F.explode(F.array_compact(F.array(own, up))).alias("side")).select(*keys, "side.parent", "side.own", "side.child", "side.kid")
    sums = both.groupBy(*keys, F.col("parent").alias("parent_id")).agg(F.max("own").alias("p"), F.sum("child").alias("s"), F.count("child").alias("n"), F.sum("kid").alias("k")).where("k > 0 and p is not null")
    return sums if links is not None or doc else sums.join(rows.select("doc_id", "table_id"), "table_id")


def table_arithmetic(rows: DataFrame, cells: DataFrame, abs_tol: float = 0.5, rel_tol: float = 0.001) -> DataFrame:
    """Parent against the sum of its non-null children in every value column."""
    sums = parent_sums(rows, cells).where("n > 0")
    passed = F.abs(F.col("p") - F.col("s")) <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.abs("p"))
    return sums.select("doc_id", "table_id", "parent_id", "col_idx", F.round("p", 2).alias("expected"), F.round("s", 2).alias("actual"), F.col("n").alias("n_children"), passed.alias("passed"), F.round(F.round("p", 2) - F.round("s", 2), 2).alias("delta"))


def hierarchy_quality(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of parents whose children (two or more, all present) add up; a score once three could be checked."""
    ok = F.abs(F.col("p") - F.col("s")) <= F.greatest(F.lit(1.0), 0.02 * F.abs("p"))
    rate = parent_sums(rows, cells).where("n = k and k >= 2").groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("checks"), F.avg(ok.cast("double")).alias("rate"))
    score = F.when(F.col("checks") < 3, 1.0).when(F.col("rate") < 0.5, 0.3).when(F.col("rate") < 0.7, 0.7).otherwise(1.0)
    return rate.withColumns({"score": score, "rate": F.round("rate", 4)})


def structural_quality(rows: DataFrame, cells: DataFrame, tables: DataFrame, n_cols: int = 4) -> DataFrame:
    """Reasons against a table's extraction, and the lowest score that they allow."""
    per_row = cells.groupBy("table_id", "row_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("parsed"))
    size = F.abs("value")
    spread = cells.where("value <> 0").groupBy("table_id").agg(F.count(F.lit(1)).alias("k"), (F.max(size) / F.min(size)).alias("spread"))
    label = rows.groupBy("table_id").agg(F.avg(F.col("label").rlike("[^A-Za-z ]").cast("double")).alias("garbled"), F.count(F.lit(1)).alias("n_rows"))
    rate = per_row.groupBy("table_id").agg(F.avg((F.col("n") != n_cols).cast("double")).alias("ragged"), (F.sum("parsed") / F.sum("n")).alias("parse_rate"))
    out = tables.select("doc_id", "table_id").join(label, "table_id", "left").join(rate, "table_id", "left").join(spread, "table_id", "left")
    tests = [
        ("empty", F.coalesce(F.col("n_rows"), F.lit(0)) == 0, 0.0), ("ragged", F.col("ragged") > 0.3, 0.3), ("parse_low", F.col("parse_rate") < 0.3, 0.3), ("parse_mid", (F.col("parse_rate") >= 0.3) & (F.col("parse_rate") < 0.5), 0.7),
        ("spread", (F.col("k") >= 3) & (F.col("spread") > 1e6), 0.7), ("garbled", F.col("garbled") > 0.3, 0.3),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("r"), F.lit(s).alias("s"))) for n, c, s in tests]), lambda x: x.isNotNull())
    out = out.withColumn("found", found)
    out = out.select("doc_id", "table_id", F.coalesce(F.array_min(F.transform("found", lambda x: x["s"])), F.lit(1.0)).alias("score"), F.array_join(F.transform("found", lambda x: x["r"]), ",").alias("reasons"))
    return out.withColumn("is_processable", F.col("score") >= 0.3)


#: Column sets that are added up at once.
BLOCK = 1 << 12


def best_sum(values: np.ndarray, min_rows: int, min_rate: float) -> tuple[int, list[int], int, float] | None:
    """The column and the set of two or more others that adds up to it in the largest share of the rows that have them all: column, set,
    rows, share. Ties go to the first column, the smaller set, the set that comes first. values: rows x columns, NaN where there is none."""
    rows, n = values.shape
    bit = 1 << np.arange(n - 1, -1, -1)  # the first column is the highest bit, so of sets of one size the first is the largest number
    none = np.isnan(values)
    filled, limit = np.where(none, 0.0, values), np.maximum(1.0, 0.02 * np.abs(values))
    lost = (none * bit).sum(axis=1)
    low = np.zeros((rows, 1))
    for k in range(n - 1, max(n - 1 - int(np.log2(BLOCK)), -1), -1):  # sums of all sets of the last columns, doubled column by column
        low = np.concatenate([low, low + filled[:, k : k + 1]], axis=1)
    width, best = low.shape[1], None
    for high in range((1 << n) // width):
        sets = high * width + np.arange(width)
        sums = low + (filled[:, : n - int(np.log2(width))] @ ((high * width & bit[: n - int(np.log2(width))]) > 0))[:, None] if high else low
        there = (sets[None, :] & lost[:, None]) == 0
        size = np.bitwise_count(sets)
        for t in range(n):
            use = np.flatnonzero(((sets & bit[t]) == 0) & (size >= 2))
            known = there[:, use] & ~none[:, t : t + 1]
            checked = known.sum(axis=0)
            hits = (known & (np.abs(sums[:, use] - filled[:, t : t + 1]) <= limit[:, t : t + 1])).sum(axis=0)
            rate = np.where(checked >= min_rows, hits / np.maximum(checked, 1), 0.0)
            if len(use) and rate.max() >= min_rate:
                top = np.flatnonzero(rate == rate.max())
                k = top[np.lexsort((-sets[use[top]], size[use[top]]))[0]]
                found = (-float(rate[k]), t, int(size[use[k]]), -int(sets[use[k]]), int(checked[k]))
                best = found if best is None else min(best, found)
    if best is None:
        return None
    return best[1], [k for k in range(n) if -best[3] & int(bit[k])], best[4], -best[0]


def additive_columns(cells: DataFrame, min_rows: int = 3, min_rate: float = 0.6) -> DataFrame:
    """For each table the column and the set of two or more others that adds up to it in the largest share of rows. A table's rows meet in
    one row, so cells are shuffled once, by table. All sets are tried, of tables of any width: the sums of all sets of the last twelve columns are doubled up
    once and serve every set of the others, so memory stays small; the time doubles with each column (20 columns of 12 rows: about 3 s)."""
    c = cells.select("table_id", "row_id", "col_idx", "value").repartition("table_id")
    wide = c.groupBy("table_id", "row_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("col_idx", "value")))).alias("v"), F.collect_set("col_idx").alias("c"))
    t = wide.groupBy("table_id").agg(F.collect_list("v").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("cols")).where("size(cols) >= 3")
    t = t.select("table_id", "cols", F.expr("transform(rows, v -> transform(cols, c -> v[c]))").alias("rows"))

    def search(batches):
        for batch in batches:
            out = []
            for table, cols, rows in zip(*(batch.column(c).to_pylist() for c in ("table_id", "cols", "rows")), strict=True):
                found = best_sum(np.array(rows, np.float64), min_rows, min_rate)
                if found is not None:
                    total, parts, n, rate = found
                    out.append((table, cols[total], ",".join(str(cols[k]) for k in parts), n, round(rate, 4)))
            kinds = [batch.schema.field("table_id").type, pa.int32(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["table_id", "total", "parts", "n", "rate"])

    return t.mapInArrow(search, f"table_id {cells.schema['table_id'].dataType.simpleString()}, total int, parts string, n long, rate double")


def filter_axis_members(members: DataFrame, additive: DataFrame) -> DataFrame:
    """Members whose columns take part in an additive column set; a document without any keeps all. members: doc_id, table_id, col_idx and
    more; additive: D28's rows."""
    hit = additive.select("table_id", F.explode(F.split("parts", ",")).alias("col_idx")).select("table_id", F.col("col_idx").cast("int").alias("col_idx")).distinct().withColumn("adds", F.lit(True))
    m = members.join(hit, ["table_id", "col_idx"], "left").fillna(False, ["adds"]).withColumn("any_adds", F.max("adds").over(Window.partitionBy("doc_id")))
    return m.where("adds or not any_adds").select(members.columns)


def stitch_tables(tables: DataFrame, signature: DataFrame, ends_total: DataFrame) -> DataFrame:
    """Consecutive tables with one header signature, on the same or the next page, of compatible classification, after a
    table that doesn't end in a total, form a chain. tables: doc_id, table_id, table_ord, page_no, context."""
    order = Window.partitionBy("doc_id").orderBy("table_ord")
    t = tables.join(signature, "table_id").join(ends_total, "table_id", "left")
    prev = lambda c: F.lag(c).over(order)
    same = (prev("signature") == F.col("signature")) & (F.col("signature") != "") & (F.col("page_no") - prev("page_no")).between(0, 1) & ~F.coalesce(prev("ends_total"), F.lit(False))
    same = same & (F.col("context").isNull() | prev("context").isNull() | (F.col("context") == prev("context")))
    t = t.withColumn("breaks", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    t = t.withColumn("chain", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc_id", "chain").agg(
        F.min_by("table_id", "table_ord").alias("table_id"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_tables"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "table_id"))), lambda x: x["table_id"].cast("string")), ",").alias("stitched_from"),
    )


def stitch_rows(chains: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """E2, rows of stitched tables: they belong to the chain's first table, are numbered anew in the order of tables and rows, and lose their hierarchy, as
    parents of one part don't hold for the next. chains: table_id, stitched_from."""
    parts = chains.select(F.col("table_id").alias("logical_id"), F.explode(F.split("stitched_from", ",")).alias("table_id")).withColumn("table_id", F.col("table_id").cast("long"))
    r = rows.join(parts, "table_id").join(tables.select("table_id", "table_ord"), "table_id")
    n = F.row_number().over(Window.partitionBy("logical_id").orderBy("table_ord", "row_idx", "row_id")) - 1
    return r.select("doc_id", F.col("logical_id").alias("table_id"), n.alias("row_idx"), F.concat_ws("_", F.col("logical_id").cast("string"), n.cast("string")).alias("row_id"), "label", F.lit(None).cast("string").alias("parent_id"), F.col("table_id").alias("stitched_from"), F.col("row_id").alias("old_row_id"))


def stitch_boxes(chains: DataFrame, boxes: DataFrame) -> DataFrame:
    """E2, boxes: the union of the parts' boxes. boxes: table_id, l, t, r, b with the origin at the bottom left."""
    parts = chains.select(F.col("table_id").alias("logical_id"), F.explode(F.split("stitched_from", ",")).alias("table_id")).withColumn("table_id", F.col("table_id").cast("long"))
    return parts.join(boxes, "table_id").groupBy(F.col("logical_id").alias("table_id")).agg(F.min("l").alias("l"), F.max("t").alias("t"), F.max("r").alias("r"), F.min("b").alias("b"))


def value_monotonicity(cells: DataFrame, col_idx: int) -> DataFrame:
    """Share of steps in reading order that don't decrease."""
    order = Window.partitionBy("table_id").orderBy("row_idx")
    c = cells.where((F.col("col_idx") == col_idx) & F.col("value").isNotNull()).withColumn("before", F.lag("value").over(order))
    return c.where("before is not null").groupBy("table_id").agg(F.round(F.avg((F.col("value") >= F.col("before")).cast("double")), 4).alias("monotonicity"), F.count(F.lit(1)).alias("steps"))
