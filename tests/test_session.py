from retenta.session import new_shared_path, shared_dir, stage, staged
from retenta.sources.warehouse import path_exists


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and new_shared_path(spark, "x").startswith(f"{named}/x-")


def test_staged_copy_is_removed(spark):
    df = spark.range(10)
    with staged(df, "gone") as copy:
        path = copy.inputFiles()[0].rsplit("/", 1)[0]
        assert sorted(copy.collect()) == sorted(df.collect()) and path_exists(spark, path)
    assert not path_exists(spark, path)


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS DATE) AS d")
    copy = stage(df)
    assert copy.dtypes == df.dtypes and copy.count() == 10
