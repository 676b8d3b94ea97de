import os
import time

from lodestone import session


def test_tables_are_kept_for_the_state_of_their_source(spark, tmp_path):
    source, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("count(*) as n")

    spark.range(3).write.parquet(source)
    assert [session.kept(spark, "n", source, build).first().n for _ in range(2)] == [3, 3] and len(built) == 1
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert session.kept(spark, "n", source, build).first().n == 5 and len(built) == 2


def test_release_deletes_the_scratch_tables(spark):
    path = session.scratch_dir(spark, "x")
    session.written(spark.range(3), path)
    local = path.removeprefix("file:")
    assert os.path.exists(local) and session.release(spark) > 0 and not os.path.exists(local) and session.release(spark) == 0
