"""Intermediates lie in the session's folder, and go with their scope."""

from pathlib import Path

from tickloom.operators import lineage


def _under(spark):
    return {str(p) for p in Path(lineage.fresh_path(spark, "x")).parent.rglob("*") if p.is_dir()}


def test_cuts_lie_in_the_folder_of_the_session(spark):
    cut = lineage.cut(spark.range(7))
    where = spark.sparkContext.getCheckpointDir()
    again = lineage.cut(spark.range(8))
    assert any("/cuts/" in p for p in _under(spark)) and (cut.count(), again.count()) == (7, 8)
    assert spark.sparkContext.getCheckpointDir() == where


def test_a_scope_takes_its_intermediates_with_it(spark):
    outer = lineage.cut(spark.range(5))
    before = _under(spark)
    with lineage.scope(spark):
        inner, table = lineage.cut(spark.range(3)), lineage.kept(spark.range(4), "table")
        assert (inner.count(), table.count()) == (3, 4)
        with lineage.scope(spark):
            assert lineage.cut(spark.range(2)).count() == 2
        assert inner.count() == 3
    assert _under(spark) == before
    after = lineage.cut(spark.range(6))
    assert (outer.count(), after.count()) == (5, 6)


def test_a_written_table_can_be_dropped(spark):
    path = lineage.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    lineage.dropped(spark, path)
    assert not Path(path).exists()
