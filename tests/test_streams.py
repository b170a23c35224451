"""Streams and snapshots: batches, restarts, order, late rows, and what an update rewrites."""

import random
from datetime import datetime

import pytest

from factloom.operators.rollups import Pages
from factloom.sources.snapshots import Snapshot, replaced
from factloom.streaming import streams as K


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_an_update_rewrites_the_touched_buckets(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"), "k long, v string", ["k"], 32)
    s.update(spark.range(200).selectExpr("id AS k", "'old' AS v"), lambda _, new: new)
    before = files(tmp_path / "s/data")
    change = spark.createDataFrame([(7, "new"), (500, "more"), (9, None)], "k long, v string")
    for _ in range(2):  # run again under its number: the same
        s.update(change, lambda rows, new: replaced(rows, new, "k"), 1)
        got = {r["k"]: r["v"] for r in s.read().collect()}
        assert got == {k: "old" for k in range(200) if k not in (7, 9)} | {7: "new", 500: "more"}
    assert s.versions() == [0, 1] and len(files(tmp_path / "s/data") - before) <= 3
    assert {r["v"] for r in s.read(0).collect()} == {"old"}  # readers of the version before still find it
    s.update(spark.createDataFrame([(7, "newer")], "k long, v string"), lambda rows, new: replaced(rows, new, "k"))
    assert s.versions() == [1, 2] and s.read().where("k = 7").first()["v"] == "newer" and s.read().count() == 200
    assert s.read(1).where("k = 7").first()["v"] == "new"


def test_an_update_that_was_not_committed_is_not_seen(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"), "k long, v string", ["k"], 4)
    assert s.read().collect() == []
    s.update(spark.createDataFrame([(1, "a")], "k long, v string"), lambda _, new: new)
    s.spark.createDataFrame([(1, "b", 0)], "k long, v string, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "s/data/1"))
    assert [tuple(r) for r in s.read().collect()] == [(1, "a")]


def votes(r, n, first):
    return [(first + i, "row_concept", r.randrange(9), r.choice("abc"), r.choice(["human", "mlp", "rule"]), r.choice(["tag", "tag", "dissent"]), str(r.randrange(4)), datetime(2024, 1, 1, 0, 0, first + i)) for i in range(n)]


def test_consensus_over_batches_and_a_restart(spark, tmp_path):
    r, schema, every = random.Random(2), "event_id long, dimension string, target_id long, value string, source string, action string, voter string, ts timestamp", []
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, n in enumerate((20, 12, 1)):
        every += votes(r, n, len(every))
        spark.createDataFrame(every[-n:], schema).coalesce(1).write.mode("append").parquet(src)
        state = K.consensus_stream(K.read_event_log(spark, src, schema, max_files=1), out, 8)
        want = K.batch_winners(spark.createDataFrame(every, schema))
        assert sorted(map(tuple, K.winners(state.read()).collect())) == sorted(map(tuple, want.collect()))
        if k == 2:  # one vote: one bucket
            assert len({f.split("/")[1] for f in files(tmp_path / "out/sums/data") if f.startswith("2/")}) == 1
    # killed before the commit of the last batch: its manifest and the stream's commit are gone, so it runs again
    for p in [*(tmp_path / "out/sums/manifest/2").iterdir(), *(x for x in (tmp_path / "out/checkpoint/commits").iterdir() if x.name in ("2", ".2.crc"))]:
        p.unlink()
    state = K.consensus_stream(K.read_event_log(spark, src, schema, max_files=1), out, 8)
    assert sorted(map(tuple, K.winners(state.read()).collect())) == sorted(map(tuple, want.collect()))


def slow_counts(changes):
    out = {}
    for doc, delta, _ in sorted(changes, key=lambda c: c[2]):
        out[doc] = max(out.get(doc, 0) + delta, 0)
    return out


def test_counts_are_reflected_at_zero_in_any_grouping(spark, tmp_path):
    r = random.Random(4)
    changes = [(r.randrange(5), r.choice([-1, -1, 1, 1, -3]), i) for i in range(300)] + [(9, -1, 300), (9, 1, 301)]
    df = spark.createDataFrame(changes, "doc_id long, delta int, at long")
    assert {x["doc_id"]: x["n"] for x in K.counts(df.repartition(5), ["doc_id"], ["at"]).collect()} == slow_counts(changes) and slow_counts(changes)[9] == 1
    for lo, hi in ((0, 40), (40, 41), (41, 302)):
        spark.createDataFrame(changes[lo:hi], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = K.read_event_log(spark, str(tmp_path / "in"), df.schema, max_files=1)
    for _ in range(2):  # the second time the checkpoint is at the end already
        assert {x["doc_id"]: x["n"] for x in K.maintain_counts(stream, str(tmp_path / "out"), ["doc_id"], ["at"], 4).read().collect()} == slow_counts(changes)


def test_rows_go_with_their_table(spark):
    log = spark.createDataFrame([(1, 10, "tables", 1, 1), (1, 10, "rows", 1, 2), (1, 10, "rows", 1, 3), (1, 11, "tables", 1, 4), (1, 11, "rows", 1, 5), (1, 10, "tables", -1, 6)], "doc_id long, table_id long, kind string, delta long, at long")
    left = spark.createDataFrame([(10, 2), (11, 1)], "table_id long, n long")
    got = K.counts(K.document_changes(log, left), ["doc_id", "kind"], ["at", "kind"]).collect()
    assert {r["kind"]: r["n"] for r in got} == {"tables": 1, "rows": 1}


def test_windows_close_and_late_rows_are_kept_aside(spark, tmp_path):
    day = lambda d, h=12: datetime(2024, 1, d, h)
    batches = [[(day(1), "a"), (day(1), "b"), (day(2), "a")], [(day(2, 13), "a"), (day(4), "b"), (day(1, 23), "b")], [(day(2, 1), "a"), (day(4, 2), "b"), (day(6), "a")]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, action string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = K.read_event_log(spark, str(tmp_path / "in"), "ts timestamp, action string", max_files=1)
    closed, late, still = K.activity_stream(stream, str(tmp_path / "out"))
    rows = lambda df: sorted((r["start"].day, r["action"], r["n"]) for r in df.collect())
    # the first of January closes after the first batch, the second and third after the second one
    assert rows(closed) == [(1, "a", 1), (1, "b", 1), (2, "a", 2), (4, "b", 2)] and rows(still) == [(6, "a", 1)]
    assert sorted((r["ts"].day, r["action"]) for r in late.collect()) == [(1, "b"), (2, "a")]
    assert len({f.split("/")[0] for f in files(tmp_path / "out/open")}) == 3 and spark.read.parquet(str(tmp_path / "out/open/2")).count() == 2


@pytest.mark.parametrize("ranges", [1, 7])
def test_pages_at_any_depth(spark, ranges):
    df = spark.range(1000).selectExpr("id % 37 AS t", "id AS k", "concat('v', id) AS v")
    pages, want = Pages(df, "t", "k", ranges), sorted(((i % 37, i) for i in range(1000)), reverse=True)
    for offset, limit in ((0, 10), (500, 30), (990, 30), (2000, 5), (0, 0)):
        assert [(r["t"], r["k"]) for r in pages.page(limit, offset).collect()] == want[offset : offset + limit]
    read = pages.page(10, 900).inputFiles()
    assert sum("__range=" in f for f in read) >= 1 or ranges == 1
