"""Statistics kept by file."""

from pyspark.sql import functions as F

from slatework.operators import profile
from slatework.sources import statistics as S


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_appended_files_alone_are_scanned(spark, tmp_path):
    path, kept, other = (f"{tmp_path}/{n}" for n in ("t", "kept", "other"))
    whole = spark.range(900).selectExpr("id as key", "if(id % 7 = 0, null, concat('V', id % 30)) as word", "if(id % 10 = 0, double('nan'), id / 3.0D) as x", "array(id) as nested")
    seen = 0
    for k in range(3):
        whole.filter(F.col("key") % 3 == k).coalesce(2).write.mode("append").parquet(path)
        found, scanned = S.refresh(spark, path, kept)
        files = spark.read.parquet(path).inputFiles()
        assert len(scanned) == len(files) - seen
        seen = len(files)
    assert S.refresh(spark, path, kept)[1] == []
    again, scanned = S.refresh(spark, path, other)
    assert len(scanned) == seen
    df = spark.read.parquet(path)
    assert rows_of(S.profile(found, df)) == rows_of(S.profile(again, df))
    assert {r["column"]: r["missing"] for r in S.missing_counts(found).collect()} == {"word": 129, "x": 90}
    got, want = ({r["name"]: r for r in p.collect()} for p in (S.profile(found, df), profile.column_profile(df.replace(float("nan"), None, ["x"]), exact=True)))
    assert got.keys() == want.keys()
    for c in got:
        assert got[c]["sample_values"] == want[c]["sample_values"]
        assert got[c]["semantic_type"] == want[c]["semantic_type"] and got[c]["format"] == want[c]["format"]
        assert got[c]["unique_count"] == want[c]["unique_count"]


def test_files_that_go_and_columns_that_come(spark, tmp_path):
    path, kept = f"{tmp_path}/t", f"{tmp_path}/kept"
    spark.range(10).selectExpr("id as a").coalesce(1).write.mode("append").parquet(path)
    S.refresh(spark, path, kept)
    spark.range(5).selectExpr("id as a", "cast(id as string) as b").coalesce(1).write.mode("append").parquet(path)
    found, scanned = S.refresh(spark, path, kept)
    assert len(scanned) == 1
    assert {r["column"]: (r["n"], r["missing"], r["high"]) for r in S.merged(found).collect()} == {"a": (15, 0, 9.0), "b": (15, 10, None)}
    spark.range(3).selectExpr("id as a").coalesce(1).write.mode("overwrite").parquet(path)
    found, scanned = S.refresh(spark, path, kept)
    assert len(scanned) == 1 and {r["column"]: r["n"] for r in S.merged(found).collect()} == {"a": 3}


def test_large_counts_do_not_depend_on_the_order_of_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    for k in range(3):
        spark.range(30_000 * k // 2, 30_000 * k // 2 + 30_000).selectExpr("id as a").coalesce(1).write.mode("append").parquet(path)
    found = [S.merged(S.refresh(spark, path, f"{tmp_path}/k{i}")[0]).first()["about"] for i in range(2)]
    assert found[0] == found[1] and abs(found[0] - 60_000) < 4_000
