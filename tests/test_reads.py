from __future__ import annotations

import pytest

from corpusloom import registry
from corpusloom.operators import timing


def scans(spark, name):
    """How often the plan of a query reads the texts of documents; what was written once before is not counted."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan parquet" in line and "/documents.parquet" in line and "text" in line.split("]")[0] for line in plan.splitlines())


@pytest.mark.parametrize(("name", "most"), [("rewrite_targets", 0), ("overall_similarity", 0), ("profile_similarity", 0), ("blended_match", 1), ("profile_snapshots", 0), ("profile_likeness", 0)])
def test_texts_are_read_once(spark, name, most):
    assert scans(spark, name) <= most


def test_words_are_taken_once_for_the_intrinsic_score(spark):
    plan = registry.QUERIES["intrinsic_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _words#") == 1


def test_chapters_of_a_batch_are_made_objects_in_parts(spark, monkeypatch):
    monkeypatch.setattr(timing, "ITEMS", 2)
    frame = spark.createDataFrame([(k, [(1.0, "word here")], [("t", "s", None)], 9.0) for k in range(5)], "k long, cues array<struct<start:double,text:string>>, sections array<struct<title:string,summary:string,points:array<string>>>, duration double")
    made = {}
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: made.update(f=f) or self)
    timing.chapter_times(frame, "k")
    out = list(made["f"](iter(frame.select("k", "cues", "sections", "duration").toArrow().to_batches())))
    sizes = [b.num_rows for b in out]
    assert sum(sizes) == 5 and max(sizes) <= 2


def test_reingested_shots_sort_no_rows_and_send_no_keys_whole(spark):
    frame = registry.QUERIES["reingested_shots"](spark, "/root/testdata/sf0.001")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
