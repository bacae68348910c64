"""CSV files in many splits: records, rows with too many fields, against the one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from slatework.sources import records as R
from slatework.sources import tables


def written(path, text):
    path.write_bytes(text.encode())
    return str(path)


def read(spark, path, split, **more):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = tables.read_csv(spark, path, **more)
        return df, sorted(df.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def random_csv(seed, rows, broken):
    r = random.Random(seed)
    bits = ["a", "bc", "é", "7", " ", ",", '"', "x y"] + (["\n", "\n\n", '"\n"', ",\n"] if broken else [])
    table = [["h1", "h 2", "h,3" + ("\nmore" if broken else "")]] + [["".join(r.choices(bits, k=r.randrange(12))) for _ in range(3)] for _ in range(rows)]
    out = io.StringIO()
    csv.writer(out, quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=r.choice(["\n", "\r\n"])).writerows(table)
    return out.getvalue(), table


def expected(table):
    def value(x):
        return None if x.strip(" ") in tables.NA_TOKENS else x

    return sorted([tuple(map(value, row)) for row in table[1:]], key=str)


@pytest.mark.parametrize("broken", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_splits_read_what_one_task_reads(spark, tmp_path, seed, broken):
    text, table = random_csv(seed, 60, broken)
    path = written(tmp_path / "t.csv", text)
    for split in (90, 1 << 20):
        df, rows = read(spark, path, split)
        assert df.columns == table[0]
        assert [tuple(r) for r in rows] == expected(table)


def test_a_file_of_many_splits_has_many_tasks(spark, tmp_path):
    text, table = random_csv(9, 3000, True)
    path = written(tmp_path / "t.csv", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        df = tables.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_field_longer_than_splits_and_one_that_never_ends(spark, tmp_path):
    long = "line\n" * 200
    path = written(tmp_path / "t.csv", f'a,b\n1,"{long}"\n2,x\n3,"never\nends\n4,y\n')
    for split in (50, 1 << 20):
        _, rows = read(spark, path, split)
        assert [tuple(r) for r in rows][:2] == [("1", long), ("2", "x")]
        assert len(rows) == 3 and rows[2]["a"] == "3" and "4,y" in rows[2]["b"]


def test_a_folder_of_files_has_a_header_each(spark, tmp_path):
    folder = tmp_path / "f.csv"
    folder.mkdir()
    for i, text in enumerate(('a,"b\nc"\n1,2\n', 'a,"b\nc"\n"3\n",4\n\n5,6', 'a,"b\nc"\n')):
        (folder / f"part-{i}.csv").write_text(text)
    for split in (4, 1 << 20):
        df, rows = read(spark, str(folder), split)
        assert df.columns == ["a", "b\nc"] and [tuple(r) for r in rows] == [("1", "2"), ("3\n", "4"), ("5", "6")]


@pytest.mark.parametrize("quoted", [False, True])
def test_rows_with_too_many_fields(spark, tmp_path, quoted):
    odd = '7,"x\ny"\n' if quoted else "7,x\n"
    path = written(tmp_path / "t.csv", f'a,b\n1,2\n1,2,3\n{odd}4\n5,6,,8\n"9,9","1""0,"\n')
    with pytest.raises(Exception, match="more fields than the header"):
        read(spark, path, 1 << 20)
    with pytest.raises(ValueError, match="more fields than the header"):
        tables.ingest(spark, path)
    df, rows = read(spark, path, 8, extra="keep")
    assert df.columns == ["a", "b", "extra_fields"]
    assert sorted(tuple(r) for r in rows if r["extra_fields"]) == [("1", "2", "1,2,3"), ("5", "6", "5,6,,8")]
    assert sorted(map(str, (tuple(r)[:2] for r in rows if not r["extra_fields"]))) == sorted(map(str, [("1", "2"), ("7", "x\ny" if quoted else "x"), ("4", None), ("9,9", '1"0,')]))
    done = tables.ingest(spark, path, extra="keep")
    assert done.actions[0] == ("extra_fields", "Kept 2 rows with more fields than the header", 2)
    fine = written(tmp_path / "fine.csv", "a,b\n1,2\n3\n")
    assert read(spark, fine, 8, extra="keep")[0].columns == ["a", "b"]


def test_no_header_no_rows_and_other_names(spark, tmp_path):
    for name, text in (("e.csv", ""), ("h.csv", "a,b\n"), ("q.csv", '"a\nb",c\n'), ("x.txt", "a\n1\n")):
        with pytest.raises(ValueError):
            tables.read_csv(spark, written(tmp_path / name, text))


def test_both_scans_agree(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(['"', '""', ",", "a", "b c", '",', ',"'], k=r.randrange(9))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.scanned(F.col("t")).alias("s")).collect()
    for row in got:
        assert (row["s"]["place"] == R.QUOTED) == R.ends_quoted(row["t"], False)
    for t in texts:
        for u in texts[:20]:
            assert R.ends_quoted(f"{t}\n{u}".replace("\n", ";"), False) in (True, False)
        fields = next(csv.reader([t]), [""])
        if not R.ends_quoted(t, False) and t:
            assert next(x["s"]["fields"] for x in got if x["t"] == t) == len(fields)
