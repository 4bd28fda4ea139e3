"""Files that executors write: all of a write or none of it."""

import os

import pytest
from pyspark.sql import functions as F

from codestrata.sources import report_files as R


def files(folder):
    return {n: open(os.path.join(folder, n), encoding="utf-8").read() for n in os.listdir(folder)} if os.path.isdir(folder) else {}


def texts(spark, n, parts=6):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("f"), "id", F.lit(".json")).alias("name"), F.concat(F.lit('é{"a": '), "id", F.lit("}")).alias("text"))


def test_written_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert R.write_texts(texts(spark, 200), folder) == 200
    assert files(folder) == {f"f{i}.json": f'é{{"a": {i}}}' for i in range(200)}
    assert R.write_texts(texts(spark, 3).withColumn("text", F.lit("new")), f"file://{folder}") == 3
    got = files(folder)
    assert len(got) == 200 and [got[f"f{i}.json"] for i in range(4)] == ["new", "new", "new", 'é{"a": 3}']
    assert R.write_texts(texts(spark, 0), folder) == 0 and len(files(folder)) == 200


@pytest.mark.parametrize("bad", [None, "../x", ""])
def test_a_task_that_fails_leaves_no_file(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    d = texts(spark, 100).withColumn("name", F.when(F.col("name") == "f90.json", F.lit(bad).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="not the name and text|aborted|WRITER"):
        R.write_texts(d, folder)
    assert files(folder) == {}


def test_moving_can_be_run_again(spark, tmp_path):
    written, folder = str(tmp_path / "w"), str(tmp_path / "out")
    spark.dataSource.register(R.NamedTexts)
    texts(spark, 20, 4).write.format(R.FORMAT).mode("append").save(written)
    os.makedirs(folder)
    tasks = sorted(n for n in os.listdir(written) if n != R.COMMITTED)
    assert len(tasks) == 4 and not files(folder)
    first = sorted(os.listdir(os.path.join(written, tasks[0])))
    for n in first[:3]:  # moved before the driver died
        os.rename(os.path.join(written, tasks[0], n), os.path.join(folder, n))
    os.makedirs(os.path.join(written, "9-99"))  # an attempt that does not count
    open(os.path.join(written, "9-99", "half.json"), "w").close()
    assert R.publish(spark, written, folder) == 20
    assert sorted(files(folder)) == sorted(f"f{i}.json" for i in range(20)) and not os.path.exists(written)


@pytest.mark.parametrize("parts", [1, 6])
def test_two_rows_of_one_name(spark, tmp_path, parts):
    """Within a task and in two: an error, and what the folder held stays."""
    folder = str(tmp_path / "out")
    R.write_texts(texts(spark, 2), folder)
    d = texts(spark, 60, parts).withColumn("name", F.when(F.col("name") == "f55.json", "f1.json").otherwise(F.col("name"))).withColumn("text", F.lit("new"))
    with pytest.raises(Exception, match="several rows|aborted|WRITER"):
        R.write_texts(d, folder)
    assert files(folder) == {f"f{i}.json": f'é{{"a": {i}}}' for i in range(2)}
