import pytest

from tidewheel.sources import tables


def test_append_and_check(spark, tmp_path):
    path, ddl = str(tmp_path / "audit"), "audit_id bigint, action string"
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "action string, audit_id bigint")
    tables.append(rows, path, ddl)
    tables.append(rows, path, ddl)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError):
        tables.append(rows.drop("action"), path, ddl)
    with pytest.raises(ValueError):
        tables.checked(rows.union(rows), ddl, ["audit_id"])


def test_versions(spark, tmp_path):
    path = str(tmp_path / "jobs")
    first = tables.write_version(spark.range(3), path)
    tables.write_version(tables.read_version(spark, path).where("id > 0"), path)
    assert tables.read_version(spark, path).count() == 2 and tables.read_version(spark, path, first).count() == 3
