"""Binds the engine's input shapes to the driver's tables with SQL that runs in Spark and in DuckDB.

`{name}` in the SQL stands for a driver table or another shape. Shapes are lazy; Catalyst prunes what a query doesn't use.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SHAPES: dict[str, str] = {
    # reports: one document for each customer, one table for each order, one row for each line item
    "r_documents": """
SELECT c_custkey AS doc_id, c_name AS entity, CASE WHEN c_nationkey % 2 = 0 THEN 'IFRS' ELSE 'UGB' END AS gaap,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS industry, CAST(c_custkey % 40 + 10 AS INT) AS n_pages
FROM {customer}""",
    "r_tables": """
SELECT o_custkey AS doc_id, o_orderkey AS table_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS table_ord,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 2 - o_orderkey % 2 AS INT) AS page_no,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'PNL' WHEN '2-HIGH' THEN 'SFP' WHEN '3-MEDIUM' THEN 'OCI' WHEN '5-LOW' THEN 'DISC.SEGMENTS' END AS context,
       CASE o_orderstatus WHEN 'O' THEN 'TEUR' WHEN 'P' THEN 'EUR Mio' END AS unit,
       CASE WHEN o_orderkey % 3 = 0 THEN 'NATURAL_DRCR' ELSE 'PRESENTATION' END AS sign_convention, year(o_orderdate) AS year
FROM {orders}""",
    "r_lines": """
SELECT l.l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
         l.l_extendedprice, l.l_quantity, l.l_shipdate) AS INT) AS row_idx,
       l.l_quantity AS v1, l.l_extendedprice AS v2, floor(l.l_extendedprice * l.l_discount) * 1.0 AS v3, floor(l.l_extendedprice * l.l_tax * 4) / 4 AS v4,
       l.l_partkey AS part, l.l_suppkey AS supp, l.l_returnflag AS flag
FROM {lineitem} l""",
    "r_rows": """
SELECT t.doc_id, t.table_id, l.row_idx, t.table_id * 100 + l.row_idx AS row_id, p.p_name AS label, 'DATA' AS row_type, t.table_id * 100 AS parent_id,
       CASE WHEN l.flag = 'N' THEN NULL ELSE p.p_type END AS tag
FROM {r_lines} l JOIN {r_tables} t ON t.table_id = l.table_id JOIN {part} p ON p.p_partkey = l.part
UNION ALL
SELECT t.doc_id, t.table_id, 0, t.table_id * 100, 'Total', 'TOTAL_EXPLICIT', NULL, CASE WHEN t.table_id % 4 = 0 THEN NULL ELSE 'TOTAL' END FROM {r_tables} t""",
    "r_cells": """
SELECT table_id, table_id * 100 + row_idx AS row_id, row_idx, c.col_idx,
       CASE c.col_idx WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN CASE WHEN row_idx % 5 = 0 THEN NULL ELSE v3 END ELSE v4 END AS value
FROM {r_lines} CROSS JOIN (VALUES (1), (2), (3), (4)) AS c(col_idx)
UNION ALL
SELECT table_id, table_id * 100, 0, c.col_idx,
       round(CASE c.col_idx WHEN 1 THEN s1 WHEN 2 THEN s2 + CASE WHEN table_id % 7 = 0 THEN 5000 WHEN table_id % 7 = 1 THEN 0.25 ELSE 0 END
             WHEN 3 THEN s3 ELSE CASE WHEN table_id % 11 = 0 THEN s4 * 1000 ELSE s4 END END, 2)
FROM (SELECT table_id, sum(v1) AS s1, sum(v2) AS s2, sum(v3) AS s3, sum(v4) AS s4 FROM {r_lines} GROUP BY table_id) s
CROSS JOIN (VALUES (1), (2), (3), (4)) AS c(col_idx)""",
    "r_columns": """
SELECT t.doc_id, t.table_id, c.col_idx, CASE c.col_idx WHEN 0 THEN 'LABEL' WHEN 5 THEN 'NOTES' ELSE 'VALUE' END AS role,
       CASE c.col_idx WHEN 0 THEN NULL WHEN 1 THEN 'Units' WHEN 2 THEN CAST(t.year AS STRING) WHEN 3 THEN CAST(t.year - 1 AS STRING) WHEN 4 THEN 'in %' ELSE 'Note' END AS header,
       CASE c.col_idx WHEN 2 THEN 'PERIOD.Y' || CAST(t.year AS STRING) WHEN 3 THEN 'PERIOD.Y' || CAST(t.year - 1 AS STRING) END AS period_axis
FROM {r_tables} t CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS c(col_idx) WHERE c.col_idx < 5 OR t.table_id % 2 = 0""",
    "r_concepts": """
SELECT DISTINCT p_type AS concept_id, CASE WHEN length(p_type) % 2 = 0 THEN 'credit' ELSE 'debit' END AS balance_type,
       CASE WHEN p_type = 'PROMO' THEN 'shares' ELSE 'monetary' END AS unit_type,
       CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'PNL' WHEN p_type = 'MEDIUM' THEN 'SFP' ELSE 'OCI' END AS valid_context,
       CASE WHEN p_type = 'ECONOMY' THEN 'shares' END AS note_unit_type, CASE WHEN p_type = 'STANDARD' THEN 2 ELSE 0 END AS n_variants FROM {part}
UNION ALL SELECT 'TOTAL', 'debit', 'monetary', 'PNL', NULL, 0""",
    # cells with their row's parent beside them, as extraction nests them: lines are numbered once, totals need no numbers
    "r_tree_cells": """
SELECT table_id, table_id * 100 + row_idx AS row_id, table_id * 100 AS parent_id, c.col_idx,
       CASE c.col_idx WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN CASE WHEN row_idx % 5 = 0 THEN NULL ELSE v3 END ELSE v4 END AS value
FROM {r_lines} CROSS JOIN (VALUES (1), (2), (3), (4)) AS c(col_idx)
UNION ALL SELECT table_id, row_id, NULL, col_idx, value FROM {r_totals}""",
    "r_totals": """
SELECT table_id, table_id * 100 AS row_id, c.col_idx,
       round(CASE c.col_idx WHEN 1 THEN s1 WHEN 2 THEN s2 + CASE WHEN table_id % 7 = 0 THEN 5000 WHEN table_id % 7 = 1 THEN 0.25 ELSE 0 END
             WHEN 3 THEN s3 ELSE CASE WHEN table_id % 11 = 0 THEN s4 * 1000 ELSE s4 END END, 2) AS value
FROM (SELECT table_id, sum(v1) AS s1, sum(v2) AS s2, sum(v3) AS s3, sum(v4) AS s4 FROM {r_lines} GROUP BY table_id) s
CROSS JOIN (VALUES (1), (2), (3), (4)) AS c(col_idx)""",
    # a line's row with its values beside it
    "r_wide_lines": """
SELECT t.doc_id, t.table_id, l.row_idx, p.p_name AS label, CASE WHEN l.flag = 'N' THEN NULL ELSE p.p_type END AS tag, v1, v2, CASE WHEN l.row_idx % 5 = 0 THEN NULL ELSE v3 END AS v3, v4
FROM {r_lines} l JOIN {r_tables} t ON t.table_id = l.table_id JOIN {part} p ON p.p_partkey = l.part""",
    "r_facts": """
SELECT t.doc_id, v.table_id, v.row_id, t.context, v.concept_id, 'Y' || CAST(t.year + 2 - v.col_idx AS STRING) AS period_key, v.col_idx,
       round(v.value * CASE t.unit WHEN 'TEUR' THEN 1000 WHEN 'EUR Mio' THEN 1000000 ELSE 1 END, 2) AS amount, t.page_no,
       t.context IN ('PNL', 'SFP', 'OCI') AS is_primary, CASE WHEN t.table_id % 5 = 0 THEN 6 ELSE 4 END AS value_cols, v.label
FROM (SELECT l.table_id, l.table_id * 100 + l.row_idx AS row_id, c.col_idx, CASE WHEN c.col_idx = 2 THEN l.v2 WHEN l.row_idx % 5 > 0 THEN l.v3 END AS value, p.p_type AS concept_id, p.p_name AS label
      FROM {r_lines} l JOIN {part} p ON p.p_partkey = l.part CROSS JOIN (VALUES (2), (3)) AS c(col_idx) WHERE l.flag IS NULL OR l.flag <> 'N'
      UNION ALL SELECT table_id, row_id, col_idx, value, 'TOTAL', 'Total' FROM {r_totals} WHERE col_idx IN (2, 3) AND table_id % 4 <> 0) v
JOIN {r_tables} t ON t.table_id = v.table_id WHERE t.context IS NOT NULL AND v.value IS NOT NULL AND v.concept_id IS NOT NULL""",
    "r_edges": """
SELECT * FROM (VALUES ('sizes_sum', 'SUMMATION', 'PNL', 'TOTAL', NULL, 1000.0, NULL, NULL), ('promo_tie', 'CROSS_STATEMENT_TIE', 'PNL', 'PROMO', 'OCI', 1000.0, NULL, 'equals'),
  ('econ_tie', 'CROSS_STATEMENT_TIE', 'SFP', 'ECONOMY', 'PNL', 50000.0, NULL, 'equals'), ('size_tie', 'CROSS_STATEMENT_TIE', 'PNL', 'LARGE', 'SFP', 50000.0, 'SMALL', 'opposite'), ('std_detail', 'DISAGGREGATION', 'PNL', 'STANDARD', 'DISC.SEGMENTS', 1000.0, NULL, NULL),
  ('large_note', 'NOTE_TO_FACE', 'SFP', 'LARGE', 'DISC.SEGMENTS', 1000.0, NULL, NULL)) AS e(edge_name, edge_type, context, concept_id, other_context, tol, other_concept, rule)""",
    "r_members": """
SELECT * FROM (VALUES ('sizes_sum', 1, 'LARGE'), ('sizes_sum', 2, 'MEDIUM'), ('sizes_sum', 3, 'SMALL'), ('promo_tie', 1, 'PROMO'), ('econ_tie', 1, 'ECONOMY'),
  ('std_detail', 1, 'STANDARD'), ('large_note', 1, 'LARGE'), ('large_note', 2, 'MEDIUM')) AS m(edge_name, ord, concept_id)""",
    # statements of a document's year that belong together: sums, ties, notes, details and quotients that hold, but for deviations by `d`
    "s_reports": """
SELECT o_custkey AS doc_id, year(o_orderdate) AS y, (o_custkey + year(o_orderdate)) % 2520 AS d, CAST(sum(CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice) ELSE 0 END) AS DOUBLE) AS a,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) ELSE 0 END) AS DOUBLE) AS r, CAST(sum(CASE WHEN l_returnflag = 'N' THEN floor(l_extendedprice) ELSE 0 END) AS DOUBLE) AS n
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, year(o_orderdate), (o_custkey + year(o_orderdate)) % 2520""",
    "s_lines": """
SELECT doc_id, y, (doc_id * 100 + y - 1990) * 10 + k AS table_id, ((doc_id * 100 + y - 1990) * 10 + k) * 100 + row_idx AS row_id, k, row_idx, parent, concept_id,
       CASE k WHEN 1 THEN 'PNL' WHEN 2 THEN 'SFP' WHEN 3 THEN 'OCI' WHEN 4 THEN 'DISC.SEGMENTS' WHEN 5 THEN 'DISC.REVENUE' ELSE 'DISC.ASSOCIATES' END AS context, lower(concept_id) AS label,
       CASE concept_id WHEN 'REVENUE' THEN a + r + n WHEN 'REV.A' THEN a WHEN 'REV.R' THEN CASE WHEN d % 9 > 0 THEN r END WHEN 'REV.N' THEN CASE WHEN d % 6 = 0 THEN n + 5000 ELSE n END
         WHEN 'MARGIN' THEN CASE WHEN a > 0 THEN floor(100 * (a + r + n) / a) / 100 + CASE WHEN d % 10 = 3 THEN 1 ELSE 0 END END WHEN 'ASSETS' THEN a + r WHEN 'CASH' THEN a WHEN 'STOCK' THEN CASE WHEN d % 7 > 0 THEN r END
         WHEN 'RETAINED' THEN CASE d % 5 WHEN 0 THEN (a + r + n) * 1000 WHEN 1 THEN a + r + n + 7000 ELSE a + r + n END WHEN 'FLOW.A' THEN CASE WHEN d % 8 = 0 THEN 3000 - a ELSE -a END
         WHEN 'SEGREV' THEN CASE row_idx WHEN 0 THEN a WHEN 1 THEN r ELSE CASE WHEN d % 4 = 0 THEN n - 2500 ELSE n END END WHEN 'ICLINE' THEN CASE WHEN d % 12 = 0 THEN 2500 WHEN d % 12 = 4 THEN 40 END
         WHEN 'NOTE.CASH' THEN CASE WHEN d % 7 = 1 THEN a + 2000 WHEN d % 7 = 2 THEN a * 1000 ELSE a END WHEN 'NOTE.REV1' THEN a WHEN 'NOTE.REV2' THEN CASE WHEN d % 9 = 2 THEN r + n + 9000 ELSE r + n END
         WHEN 'GOODWILL' THEN a * k WHEN 'SHARES' THEN r + k WHEN 'LOANS' THEN CASE k WHEN 2 THEN (n + 3) * 1000 WHEN 1 THEN CASE WHEN d % 10 = 0 THEN n + 3 END ELSE n + 3 END WHEN 'ASSOC' THEN n + 3 WHEN 'STAFF' THEN r + n + 77 END AS value
FROM {s_reports} CROSS JOIN (VALUES (1, 0, NULL, 'REVENUE'), (1, 1, 0, 'REV.A'), (1, 2, 0, 'REV.R'), (1, 3, 0, 'REV.N'), (1, 4, NULL, 'MARGIN'), (1, 5, NULL, 'LOANS'), (1, 6, NULL, 'STAFF'), (2, 0, NULL, 'ASSETS'), (2, 1, 0, 'CASH'),
  (2, 2, 0, 'STOCK'), (2, 3, NULL, 'RETAINED'), (2, 4, NULL, 'GOODWILL'), (2, 5, NULL, 'SHARES'), (2, 6, NULL, 'LOANS'), (3, 0, NULL, 'FLOW.A'), (4, 0, NULL, 'SEGREV'), (4, 1, NULL, 'SEGREV'), (4, 2, NULL, 'SEGREV'), (4, 3, NULL, 'ICLINE'),
  (5, 0, NULL, 'NOTE.CASH'), (5, 1, NULL, 'NOTE.REV1'), (5, 2, NULL, 'NOTE.REV2'), (5, 3, NULL, 'GOODWILL'), (5, 4, NULL, 'SHARES'), (5, 5, NULL, 'LOANS'), (6, 0, NULL, 'ASSOC')) AS v(k, row_idx, parent, concept_id)""",
    "s_tables": "SELECT DISTINCT doc_id, table_id, context, CAST(k AS INT) AS page_no FROM {s_lines}",
    "s_rows": "SELECT doc_id, table_id, row_id, row_idx, row_id - row_idx + parent AS parent_id, CASE WHEN concept_id IN ('REVENUE', 'ASSETS') THEN 'TOTAL_EXPLICIT' ELSE 'DATA' END AS row_type, label, CASE WHEN k < 5 OR row_idx < 3 THEN concept_id END AS tag FROM {s_lines}",
    "s_cells": "SELECT table_id, row_id, row_id - row_idx + parent AS parent_id, 2 AS col_idx, value FROM {s_lines}",
    "s_facts": """
SELECT doc_id, table_id, row_id, context, concept_id, 'Y' || CAST(y AS STRING) AS period_key, 2 AS col_idx, CAST(value AS DOUBLE) AS amount, CAST(k AS INT) AS page_no, k < 4 AS is_primary, 4 AS value_cols, label
FROM {s_lines} WHERE value IS NOT NULL""",
    "s_edges": """
SELECT * FROM (VALUES ('rev_sum', 'SUMMATION', 'PNL', 'REVENUE', NULL, 1000.0, NULL, NULL), ('assets_sum', 'SUMMATION', 'SFP', 'ASSETS', NULL, 1000.0, NULL, NULL), ('result_tie', 'CROSS_STATEMENT_TIE', 'PNL', 'REVENUE', 'SFP', 1000.0, 'RETAINED', 'equals'),
  ('flow_tie', 'CROSS_STATEMENT_TIE', 'PNL', 'REV.A', 'OCI', 1000.0, 'FLOW.A', 'opposite'), ('seg_detail', 'DISAGGREGATION', 'PNL', 'REVENUE', 'DISC.SEGMENTS', 1000.0, NULL, NULL), ('cash_note', 'NOTE_TO_FACE', 'SFP', 'CASH', 'DISC.REVENUE', 1000.0, NULL, NULL),
  ('rev_note', 'NOTE_TO_FACE', 'PNL', 'REVENUE', 'DISC.REVENUE', 1000.0, NULL, NULL)) AS e(edge_name, edge_type, context, concept_id, other_context, tol, other_concept, rule)""",
    "s_members": """
SELECT * FROM (VALUES ('rev_sum', 1, 'REV.A'), ('rev_sum', 2, 'REV.R'), ('rev_sum', 3, 'REV.N'), ('assets_sum', 1, 'CASH'), ('assets_sum', 2, 'STOCK'), ('seg_detail', 1, 'SEGREV'), ('cash_note', 1, 'NOTE.CASH'), ('rev_note', 1, 'NOTE.REV1'),
  ('rev_note', 2, 'NOTE.REV2')) AS m(edge_name, ord, concept_id)""",
    "s_concepts": """
SELECT * FROM (VALUES ('GOODWILL', 'monetary', NULL, 2, 'SFP'), ('SHARES', 'monetary', 'shares', 0, 'SFP'), ('LOANS', 'monetary', NULL, 0, 'SFP'), ('ASSOC', 'monetary', NULL, 0, 'SFP'), ('REVENUE', 'monetary', NULL, 0, 'PNL'),
  ('CASH', 'monetary', NULL, 0, 'SFP'), ('MARGIN', 'percentage', NULL, 0, 'SFP'), ('STAFF', 'monetary', NULL, 0, 'SFP')) AS c(concept_id, unit_type, note_unit_type, n_variants, valid_context)""",
    # tables as they are printed: longer ones are broken after their third row and go on, with the same headers, on the next page
    "c_rows": "SELECT doc_id, table_id * 2 + CASE WHEN row_idx > 3 THEN 1 ELSE 0 END AS table_id, row_idx, row_id, label, parent_id FROM {r_rows}",
    "c_tables": """
SELECT t.doc_id, p.table_id, CAST(t.table_ord * 2 + p.table_id % 2 AS INT) AS table_ord, CAST(t.page_no + p.table_id % 2 AS INT) AS page_no, t.context
FROM {r_tables} t JOIN (SELECT DISTINCT table_id, CAST((table_id - table_id % 2) / 2 AS BIGINT) AS whole FROM {c_rows}) p ON p.whole = t.table_id""",
    "c_columns": "SELECT p.table_id, k.col_idx, k.role, k.header FROM {r_columns} k JOIN (SELECT DISTINCT table_id, CAST((table_id - table_id % 2) / 2 AS BIGINT) AS whole FROM {c_rows}) p ON p.whole = k.table_id",
    # labels as reports print them, and amounts as text
    "l_labels": """
SELECT table_id, row_id, row_idx, doc_id, label,
       CASE row_idx % 8 WHEN 0 THEN 'Total' WHEN 1 THEN upper(label) || ' (see note ' || CAST(row_id % 30 AS STRING) || ')' WHEN 2 THEN 'a) ' || label || ':' WHEN 3 THEN label || '* (' || CAST(row_idx AS STRING) || ')'
         WHEN 4 THEN 'thereof ' || label WHEN 5 THEN label || ' total' WHEN 6 THEN CASE WHEN row_id % 2 = 0 THEN '31.12.2024' ELSE label || ' Erträge' END ELSE '3. ' || label END AS raw
FROM {r_rows}""",
    "l_amounts": """
SELECT table_id, row_id, col_idx, value, CASE (row_id + col_idx) % 9 WHEN 0 THEN '(' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || ',5)' WHEN 1 THEN '–' WHEN 2 THEN 'n/a'
         WHEN 3 THEN '1.234.567' WHEN 4 THEN CAST(CAST(floor(value) AS BIGINT) % 100 AS STRING) || ',25' WHEN 5 THEN '1,234' WHEN 6 THEN CAST(CAST(floor(value) AS BIGINT) % 90 AS STRING) || ' %'
         WHEN 7 THEN '-1.' || CAST(CAST(floor(value) AS BIGINT) % 900 + 100 AS STRING) || ',75' ELSE 'text' END AS text
FROM {r_cells} WHERE value IS NOT NULL""",
    "l_index": """
SELECT DISTINCT p_type || '.' || p_name AS concept_id, lower(p_name) AS label, 1 AS precedence FROM {part}
UNION ALL SELECT DISTINCT 'ACC.' || p_name, lower(p_name), 2 FROM {part}""",
    # pages: 600 by 800 points, with tables and text elements in boxes
    "p_pages": "SELECT doc_id, n_pages, CAST(page AS INT) AS page, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM (SELECT doc_id, n_pages, explode(sequence(1, n_pages)) AS page FROM {r_documents})",
    "p_tables": """
SELECT doc_id, table_id, table_ord, page_no AS page, context, unit AS currency, CAST(table_id % 3 AS INT) AS header_rows,
       CAST(table_id % 50 AS DOUBLE) AS l, CAST(250 + table_id % 200 AS DOUBLE) AS r, CAST(table_id % 90 AS DOUBLE) AS b, CAST(120 + table_id % 300 AS DOUBLE) AS t FROM {r_tables}""",
    "p_elements": """
SELECT l.doc_id, t.page_no AS page, l.row_id AS ord, CASE l.row_idx % 7 WHEN 0 THEN 'section_header' WHEN 1 THEN 'list_item' WHEN 2 THEN 'footnote' WHEN 3 THEN 'page_header' WHEN 4 THEN 'caption' ELSE 'text' END AS label,
       CASE WHEN l.row_id % 5 = 0 THEN l.raw || ' ..... ' || CAST(l.row_id % 90 AS STRING) WHEN l.row_id % 7 = 0 THEN '12 345 678 x' ELSE l.raw END AS text,
       CAST(l.row_id % 200 AS DOUBLE) AS l, CAST(300 + l.row_id % 250 AS DOUBLE) AS r, CAST(l.row_idx * 20 AS DOUBLE) AS b, CAST(l.row_idx * 20 + 12 AS DOUBLE) AS t
FROM {l_labels} l JOIN {r_tables} t ON t.table_id = l.table_id""",
    # timelines: one document for each conversation, one page marker for each turn
    "t_transitions": """
SELECT DISTINCT conv_id AS doc_id, CAST(turn * 3 + 1 AS INT) AS page, CASE role WHEN 'user' THEN 'NOTES' WHEN 'assistant' THEN 'PNL' ELSE 'TOC' END AS section_type
FROM {conversations}""",
    "t_documents": "SELECT conv_id AS doc_id, CAST(max(turn) * 3 + 5 AS INT) AS n_pages FROM {conversations} GROUP BY conv_id",
    # votes and logs
    "v_votes": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'row_concept' ELSE 'table_context' END AS dimension, user_id AS target_id, event_type AS value,
       CASE event_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'mlp' ELSE 'rule' END AS source,
       CASE WHEN event_id % 10 = 0 THEN 'dissent' WHEN event_id % 17 = 0 THEN 'comment' ELSE 'tag' END AS action, CAST(event_id % 13 AS STRING) AS voter, ts
FROM {events}""",
    "v_log": """
SELECT event_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'user' || CAST(user_id AS STRING) END AS user_email, user_id AS doc_id,
       CAST(event_id % 9 AS INT) AS page_no, event_type AS action FROM {events}""",
}


def named(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Inputs:
    """Driver tables and shapes by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in SHAPES:
                self._made[name] = self.spark.sql(SHAPES[name], **{x: getattr(self, x) for x in named(SHAPES[name])})
            else:
                raise AttributeError(name)
        return self._made[name]


    def given(self, name: str) -> bool:
        """Whether a table or shape has been made, or put in place, already."""
        return name in self._made

    def keep(self, name: str, how: Callable[[DataFrame, str], DataFrame]) -> None:
        """Puts what `how` makes of a shape in its place, for the shapes above it that are made from now on."""
        self._made[name] = how(getattr(self, name), name)


def oracle(sql: str) -> str:
    """DuckDB SQL with the shapes it names as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in SHAPES and name not in order:
            for x in named(SHAPES[name]):
                need(x)
            order.append(name)

    shape = lambda name: SHAPES[name].replace("explode(sequence(1, n_pages))", "unnest(range(1, n_pages + 1))")
    for name in SHAPES:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    parts = [f"{name} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', shape(name))})" for name in order]
    sql = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", sql, re.I) else ""
    if m := re.match(r"WITH (?:RECURSIVE )?", sql, re.I):
        return f"WITH {recursive}" + ",\n".join([*parts, sql[m.end() :]])
    return (f"WITH {',\n'.join(parts)}\n" if parts else "") + sql
