"""Every command runs on small tables and prints what it wrote."""

import json

import pytest

from tickloom import cli
from tickloom.plans import frames
from tickloom.sources import adapter


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli"))
    frames.base(spark, sf).drop("split", "is_train").write.parquet(f"{path}/rows")
    adapter.perf_long(spark, sf).write.parquet(f"{path}/samples")
    adapter.family_map(spark).write.parquet(f"{path}/aliases")
    return path


def test_merge(spark, rows, capsys):
    got = cli.main(["merge", "--samples", f"{rows}/samples", "--aliases", f"{rows}/aliases", "--out", f"{rows}/merged"], spark)
    assert got["interval_rows"] == spark.read.parquet(f"{rows}/merged/interval").count() > 0
    assert json.loads(capsys.readouterr().out)["pmu_quality_families"] == 5


def test_build_ablate_detect(spark, rows):
    made = cli.main(["build", "--rows", f"{rows}/rows", "--out", f"{rows}/seq", "--experiment", "e", "--mode", "leave_one_out", "--workload", "w3"], spark)
    assert made["rows"] == 5 * spark.read.parquet(f"{rows}/rows").count() and made["families"] == 0
    found = cli.main(["detect", "--rows", f"{rows}/rows", "--out", f"{rows}/det", "--counter", "branch_instructions", "--history", "2"], spark)
    assert len(found["tables"]) == 12 and 0 <= found["accuracy"] <= 1


def test_tasks_and_queries(spark, rows, sf):
    assert cli.main(["tasks", "--workloads", "a,b,c", "--out", f"{rows}/tasks"], spark)["set2"]["tasks"] == 18
    assert cli.main(["query", "a5_collection_quality", "--tables", sf], spark)["rows"] == 5
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
