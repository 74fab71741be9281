import pyarrow as pa
from oracle import DATA, same

from siftline.operators import evaluate
from siftline.plans import catalog


def test_batches_are_streamed_and_dealt_out(spark):
    plan = catalog.QUERIES["two_stage_batches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "REPARTITION_BY_NUM" in plan


def test_batches_stay_whole_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # no divisor or multiple of 16
    try:
        same(spark, catalog.QUERIES["two_stage_batches"], catalog.ORACLE_SQL["two_stage_batches"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_batches():
    keys = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 5]
    for n in range(1, 12):
        parts = [pa.RecordBatch.from_pydict({"batch": pa.array(keys[i : i + n], pa.int64())}) for i in range(0, 11, n)]
        found = [p.column("batch").to_pylist() for p in evaluate.whole_batches([parts[0].slice(0, 0), *parts])]
        assert sum(found, []) == keys
        assert all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False))
    assert list(evaluate.whole_batches([])) == []
