"""Sections and pages: what unrolled sections would cost, and the same results without it."""

import pytest

from factloom.operators import timelines as T
from factloom.plans import registry
from factloom.plans.catalog import registry as filled  # noqa: F401

SECTIONS = [(1, "A", 3, 6), (1, "B", 5, 9), (1, "C", 20, None), (1, "D", 4, 4), (1, "E", None, 8), (2, "A", 7, 2), (2, "B", 7, 7), (3, "A", -2, 1)]


@pytest.fixture(scope="module")
def sections(spark):
    return spark.createDataFrame(SECTIONS, "doc_id long, section_type string, start_page int, end_page int")


def test_an_interval_join_broadcasts_no_unrolled_sections(spark, sections):
    pages = spark.createDataFrame([(d, p) for d in (1, 2, 3, 4) for p in range(-2, 22)], "doc_id long, page int")
    for policy, pick in (("first", min), ("last", max)):
        out = T.interval_join(pages, sections.where("start_page is not null"), policy)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        for r in out.collect():
            hits = [(s, k) for d, k, s, e in SECTIONS if d == r["doc_id"] and s is not None and s <= r["page"] <= max(s, e if e is not None else s)]
            assert r["section_type"] == (pick(hits)[1] if hits else None)


def test_coverage_counts_pages_without_unrolling_them(spark, sections):
    out = T.page_coverage(spark.createDataFrame([(d, 10) for d in (1, 2, 3, 4)], "doc_id long, n_pages int"), sections)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    pages = {d: {p for d_, _, s, e in SECTIONS if d_ == d and s is not None for p in range(s, max(s, e if e is not None else s) + 1)} for d in (1, 2, 3, 4)}
    assert {r["doc_id"]: r["covered"] for r in out.collect()} == {d: len(p) for d, p in pages.items()}


def test_pretag_broadcasts_no_notes(spark):
    plan = registry.QUERIES["i7_pretag"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2
