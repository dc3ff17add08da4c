import pytest

from twinmark.operators import marking
from twinmark.plans import fixture
from twinmark.plans.marking import MarkDuplicates
from twinmark.streaming.marker import events, mark_stream


@pytest.mark.parametrize("strategy", ["strand-aware", "picard-approx"])
def test_stream_equals_batch(spark, tmp_path, strategy):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey < 400")
    keyed = MarkDuplicates(fixture.alignments(orders), fixture.contigs(spark), fixture.read_groups(spark)).keyed
    for i, (lo, hi) in enumerate(((0, 200), (200, 400))):
        keyed.filter(f"ord >= {lo} and ord < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = mark_stream(stream, strategy).writeStream.format("memory").queryName("marks" + strategy[:6].replace("-", "")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ord, r.dup) for r in spark.table("marks" + strategy[:6].replace("-", "")).collect()}
    assert got == {(r.ord, r.dup) for r in marking.mark(keyed, strategy).collect()} and any(d for _, d in got)


def test_no_exact_stream(spark):
    with pytest.raises(ValueError):
        events(spark.createDataFrame([], "ord long"), "picard-exact")
