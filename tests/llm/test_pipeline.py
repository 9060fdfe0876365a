"""Each stage against plain Python, on the stage's own input."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]

import corpus_pipeline
import edge
from test_operators import fair_targets, first_of_each, leaks

from tidemark.llm.common import written

TINY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], TINY), name))
    rows = [[tuple(r) for r in df.collect()] for df in seen[:-1]]
    assert all(df.columns == columns for df in seen[:-1])
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) > 0.7 * len(rows[0])
    assert sorted(r[0] for r in rows[2]) == first_of_each([(r[0], r[1]) for r in rows[1]]) and set(rows[2]) <= set(rows[1])
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {d for d, *_ in leaks([(r[0], r[1]) for r in rows[2]], items)}
    assert leaking and {r[0] for r in rows[3]} == {r[0] for r in rows[2]} - leaking
    size, taken = {}, {}
    for r in rows[3]:
        size[r[3]] = size.get(r[3], 0) + len(edge.word_list(r[1]))
    for r in rows[4]:
        taken[r[3]] = taken.get(r[3], 0) + len(edge.word_list(r[1]))
    longest = max(len(edge.word_list(r[1])) for r in rows[3])
    assert all(abs(taken.get(s, 0) - t) <= longest / 2 + 1e-6 for s, t in fair_targets(size).items())
    last = seen[-1].collect()
    assert sorted(tuple(r)[: len(columns)] for r in last) == sorted(rows[4]) and {r["shard"] for r in last} <= set(range(16))
    assert seen[-1].columns == [*columns, "shard", "slot"]


def test_awkward_rows_pass(spark):
    docs = edge.docs(spark, clash=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, TINY), name)
    assert docs.count() > 0


def test_empty_table_passes(spark):
    docs = edge.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, TINY), name)
    assert docs.count() == 0


def test_run_leaves_only_its_result(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "tables"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, TINY).count() > 0
    assert len({p.name.split("-")[0] for p in set(folder.iterdir()) - before}) == 5
