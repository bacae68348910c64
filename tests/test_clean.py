"""Headers, type repair, missing values and imputation on small tables."""

import pytest

from slatework.operators import clean as C
from slatework.operators import stats as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_headers_become_snake_case_and_are_logged(spark):
    df = frame(spark, [(100, "BS"), (200, "MS")], "`  What is your annual salary?  ` long, `Highest level of education!` string")
    done = C.clean(df)
    assert done.df.columns == ["what_is_your_annual_salary", "highest_level_of_education"]
    assert done.actions[0] == (None, "Normalized 2 column headers", 2)


@pytest.mark.parametrize(("names", "wanted"), [(["a", "a"], ["a", "a_2"]), (["a", "a", "a_2"], ["a", "a_3", "a_2"]), (["a", "A", " a "], ["a", "a_2", "a_3"]), (["!!", "??"], ["column", "column_2"])])
def test_repeated_headers(names, wanted):
    assert C.unique_headers(names) == wanted


def test_numeric_text_and_currency_text(spark):
    rows = [("1.2", "₹10.5", "$12.0"), ("3.4", "₹20", "$1,250.5"), ("5", "₹30.25", "$ 7"), (None, None, None)]
    done = C.clean(frame(spark, rows, "trip_distance string, fare_amount string, total_amount string"))
    assert {c: done.formats[c] for c in done.df.columns} == {"trip_distance": "number", "fare_amount": "currency", "total_amount": "currency"}
    log = {c: a for c, a, _ in done.actions if "Converted" in a}
    assert "numeric text" in log["trip_distance"] and "currency text" in log["total_amount"]
    assert [r["total_amount"] for r in done.df.collect()][:3] == [12.0, 1250.5, 7.0]
    assert done.missing == {"trip_distance": 1, "fare_amount": 1, "total_amount": 1} and done.quality == 75.0


def test_text_stays_text(spark):
    done = C.clean(frame(spark, [("Acme",), (None,), ("Globex",), ("Acme",)], "vendor string"))
    assert dict(done.df.dtypes) == {"vendor": "string"}
    assert [r[0] for r in done.df.collect()].count(None) == 1


def test_confident_metric_gets_its_mean(spark):
    done = C.clean(frame(spark, [(x,) for x in (1.1, 2.4, 3.8, None, 5.2, 6.1, None, 8.0)], "sensor_value double"))
    assert "high-confidence metric" in done.actions[-1][1]
    assert sorted(r[0] for r in done.df.collect()).count(round(26.6 / 6, 4)) == 2


def test_uncertain_stays_null(spark):
    done = C.clean(frame(spark, [(1.0,), (None,), (2.0,), (None,)], "x_metric double"))
    assert "low-confidence imputation" in done.actions[-1][1]
    assert [r[0] for r in done.df.collect()].count(None) == 2


def test_nan_is_missing_and_integers_without_gaps_are_long(spark):
    done = C.clean(frame(spark, [("1", float("nan")), ("2", 5.0)], "n string, v double"))
    assert dict(done.df.dtypes)["n"] == "bigint" and done.missing == {"v": 1}


def test_percent_text(spark):
    df, _, formats = C.repair_types(frame(spark, [("5%",), ("12.5%",), ("-3%",)], "share string"))
    assert formats == {"share": "percentage"} and [r[0] for r in df.collect()] == [0.05, 0.125, -0.03]


@pytest.mark.parametrize(
    ("texts", "first"),
    [
        (["1/2/2021", "12/31/2021"], "2021-01-02 00:00:00"),
        (["31/12/2021", "25/1/2021"], "2021-12-31 00:00:00"),
        (["2021-01-02T03:04:05Z", "2021-05-06T07:08:09Z"], "2021-01-02 03:04:05"),
        (["2021 Jan 5 3:04:05 PM", "2021 Feb 6 1:00:00 AM"], "2021-01-05 15:04:05"),
        (["5 Jan 2021", "6 Feb 2021"], "2021-01-05 00:00:00"),
        (["Jan 5, 2021", "Feb 6, 2021"], "2021-01-05 00:00:00"),
    ],
)
def test_date_text(spark, texts, first):
    df, _, formats = C.repair_types(frame(spark, [(t,) for t in texts], "happened string"))
    assert formats == {"happened": "date"} and df.selectExpr("cast(happened as string)").first()[0] == first


def test_dates_with_many_nulls_and_digit_dates_are_no_times(spark):
    rows = [("2021-01-02",), ("2021-01-03",), (None,), (None,)]
    assert dict(C.repair_types(frame(spark, rows, "d string"))[0].dtypes) == {"d": "string"}
    assert dict(C.repair_types(frame(spark, [("20210102",), ("20210103",)], "d string"))[0].dtypes) == {"d": "bigint"}


def test_codes_bounded_values_and_modes(spark):
    rows = [(1, 0.0, 0.2), (1, 0.0, 0.2), (2, 0.0, 0.1), (2, 0.0, 0.1), (None, None, None)]
    done = C.impute(frame(spark, rows, "zip_code int, flag double, part double"))
    last = done.df.collect()[-1]
    assert (last["zip_code"], last["flag"], last["part"]) == (-1, 0.0, 0.1)


def test_skewed_metric_gets_its_median_and_hints_override(spark):
    rows = [(float(x),) for x in (1, 2, 3, 4, 1000)] + [(None,)]
    done = C.impute(frame(spark, rows, "amt double"), {"amt": "metric"})
    assert done.df.collect()[-1][0] == 3.0
    assert C.impute(frame(spark, rows, "amt double"), {"amt": "identifier"}).df.collect()[-1][0] == -1


def test_skew_is_bias_corrected():
    import pandas as pd

    x = pd.Series([1.0, 2.0, 3.0, 10.0])
    m = x.mean()
    population = ((x - m) ** 3).mean() / (((x - m) ** 2).mean() ** 1.5)
    assert C.sample_skew(population, 4) == pytest.approx(x.skew())
    assert C.sample_skew(None, 4) == C.sample_skew(1.0, 2) == 0


def test_all_null_and_empty_columns(spark):
    done = C.clean(frame(spark, [(None, None), (None, None)], "x double, t string"))
    assert done.df.count() == 2 and done.missing == {"x": 2, "t": 2}
    done = C.clean(frame(spark, [], "x double, t string"))
    assert done.df.count() == 0 and done.quality == 100.0


def test_logs_and_reports_are_tables(spark):
    done = C.clean(frame(spark, [(1.0, "a"), (None, None)], "`X x` double, t string"))
    assert C.search_log(done.cleaning_log(), "header").count() == 1
    assert [r["column"] for r in C.missing_report(done.missing_counts(), "X").collect()] == ["x_x"]


def test_simple_impute(spark):
    rows = [(1, "b", None), (2, "a", None), (None, None, None)]
    out = C.simple_impute(frame(spark, rows, "n int, t string, u string")).collect()[-1]
    assert (out["n"], out["t"], out["u"]) == (1.5, "a", "Unknown")


def test_csv_fields_may_hold_quotes_commas_and_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('Name,"Said, when",n\n"say ""hi"", ok","two\nlines",1\n,"a\\b",N/A\n"  ", x ,3\n')
    from slatework.sources import tables

    df = tables.read_csv(spark, str(path))
    assert df.columns == ["Name", "Said, when", "n"]
    assert [tuple(r) for r in df.collect()] == [('say "hi", ok', "two\nlines", "1"), (None, "a\\b", None), (None, " x ", "3")]
    done = tables.ingest(spark, str(path)).df
    assert done.columns == ["name", "said_when", "n"] and [r["n"] for r in done.collect()] == [1, None, 3]


def test_statistics_are_those_of_brute_force(spark):
    import random
    import statistics

    from slatework.operators import stats

    r = random.Random(3)
    values = [r.choice([None, r.gauss(0, 1) ** 5, 0.5, -0.0, 0.0]) for _ in range(400)]
    words = [r.choice([None, "b", "B", "a", f"w{r.randrange(90)}"]) for _ in range(400)]
    df = spark.createDataFrame(list(zip(values, words, strict=True)), "v double, w string").repartition(3)
    real, said = [v for v in values if v is not None], [w for w in words if w is not None]
    assert stats.median(df, "v", len(real)) == statistics.median(real) and stats.median(df.limit(0), "v", 0) is None
    assert stats.median(df.filter("v > 1"), "v", sum(v > 1 for v in real)) == statistics.median([v for v in real if v > 1])
    best = max(said.count(w) for w in said)
    assert stats.modes(df, ["w"]) == {"w": min(w for w in said if said.count(w) == best)} and stats.modes(df.limit(0), ["w"]) == {"w": None}
    assert stats.exact_distinct(df, ["v", "w"]) == {"v": len(set(real)), "w": len(set(said))}
    assert stats.first_values(df, ["w"]) == {"w": sorted(set(said), key=lambda w: (w.lower(), w))[:20]}
    assert stats.first_values(df.filter("w in ('a', 'B', 'b')"), ["w", "v"], limit=2)["w"] == ["a", "B"]


def test_shapes_let_all_texts_of_their_pattern_through(spark):
    from pyspark.sql import functions as F

    from slatework.functions.text import DATE_PATTERNS, shape

    moments = spark.sql("select explode(sequence(timestamp'1999-01-01 01:02:03', timestamp'2001-01-01', interval 37 hours 11 minutes)) as t")
    for pattern in filter(None, DATE_PATTERNS):
        plain = pattern.replace("[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", ".SSS").replace("[XXX][XX]", "XXX")
        assert moments.filter(~F.date_format("t", plain).rlike(shape(pattern))).count() == 0, pattern
    odd = ["1/2/2020", "Jan 5, 2020", "jan 5, 2020", "5 January 2020", "2020-1-2T3:4:5.123Z", "2020-1-2 3:4:5+0100", "1/2/2020 3:4:5 pm", "x"]
    texts = spark.createDataFrame([(x,) for x in odd], "x string")
    for pattern in filter(None, DATE_PATTERNS):
        assert texts.filter(F.try_to_timestamp("x", F.lit(pattern)).isNotNull() & ~F.col("x").rlike(shape(pattern))).count() == 0, pattern


def test_infinities_end_and_fill(spark):
    inf = float("inf")
    rows = [(float(i) + 0.5, float(i) + 0.25) for i in range(20)] + [(inf, inf), (0.5, -inf), (None, None)]
    done = C.impute(frame(spark, rows, "up double, both double"), {"up": "metric", "both": "metric"})
    assert [tuple(r) for r in done.df.collect()][-1] == (inf, None)
    assert "infinite" in done.actions[0][1] and "both signs" in done.actions[1][1]


@pytest.mark.parametrize("values", [[1.0, 2.0, float("inf")], [-1e308, 1e308], [-1.2e308, 0.0, 1.2e308], [float("inf")] * 3, [-float("inf"), 1.0, 2.0, 3.0], [5e-324, 0.0, 1e-323], [1e308, 1.7e308], []])
def test_medians_of_extremes(spark, values):
    import statistics

    got = S.median(frame(spark, [(v,) for v in [*values, float("nan")]], "x double"), "x", len(values))
    assert got == (statistics.median(values) if len(values) != 2 or max(values) < 1.7e308 else 1.35e308) if values else got is None


def test_halves_are_rounded_as_sql_rounds_them():
    import duckdb

    values = [sign * (2 * k + 1) / 2e4 for sign in (1, -1) for k in range(0, 3_000_000, 377)] + [0.0, 34.69, 1e12 + 0.00005, 2.0**52 + 1, 1e305, float("inf"), -float("inf")]
    wanted = duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 4))", [values]).fetchone()[0]
    assert [S.round_half_away(v) for v in values] == wanted
    assert [round(v, 4) for v in values] != wanted


@pytest.mark.parametrize("case", ["tie", "no gaps", "no rows"])
def test_infinite_query_equals_its_sql_where_the_median_ends_in_a_half(spark, tmp_path, case):
    import duckdb

    from slatework import catalog

    ids = {"tie": range(1, 61), "no gaps": [1, 2, 50, 51, 100], "no rows": []}[case]
    path = str(tmp_path / "events.parquet")
    # 24 values of 145.9267 and 25 of 145.9268 between two -inf and one inf: the median is 145.92675
    frame(spark, [(i, (1_459_267 + (i % 2 == 0)) / 1e4) for i in ids], "event_id long, value double").write.parquet(path)
    ours = catalog.QUERIES["impute_infinite"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    wanted = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({catalog.SQL['impute_infinite']})").fetchall()
    assert sorted(map(str, map(tuple, ours.collect()))) == sorted(map(str, wanted)) and len(wanted) == len(ids)


def test_modes_take_two_jobs_and_are_exact(spark):
    rows = [(i % 3, f"v{i % 50}", float(i), None, "b" if i % 2 else "a") for i in range(1000)] + [(None, "v7", None, None, None)]
    df = frame(spark, rows, "few int, `some name` string, all_once double, nothing string, tie string")
    assert S.modes(df, df.columns) == {"few": 0, "some name": "v7", "all_once": 0.0, "nothing": None, "tie": "a"}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    assert S.modes(df, ["few", "some name", "tie"]) and len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(jobs) <= 4


def test_times_without_a_zone_keep_their_type_and_value(spark):
    df = spark.range(10).selectExpr("if(id = 3, null, timestamp_ntz'2020-01-01 02:30:00' + make_interval(0, 0, 0, id % 3)) as t", "if(id = 4, null, make_dt_interval(0, id % 2)) as d")
    done = C.simple_impute(df)
    assert done.dtypes == df.dtypes and done.filter("t is null or d is null").count() == 0
    import datetime

    assert S.modes(df, ["t", "d"]) == {"t": datetime.datetime(2020, 1, 1, 2, 30), "d": datetime.timedelta(hours=1)}


def test_a_crowded_sketch_leaves_it_to_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "TRACKED", 12)
    monkeypatch.setattr(S, "NAMED", 3)
    df = spark.range(5000).selectExpr("if(id % 100 = 0, -1, id) as x", "id % 2000 as y", "if(id % 3 = 0, 7, id) as z")
    assert S.modes(df, df.columns) == {"x": -1, "y": 0, "z": 7}


def test_text_kinds_are_those_of_the_patterns(spark):
    from pyspark.sql import functions as F

    from slatework.functions import text as X

    samples = ["1", "-12", "1.", ".5", "1e5", "$1,234.50", "€ 5", "1 2", "5%", "5.%", "1.5%", "-5%", "abc", "", "a1", "2021", "2021-1-2", "2021-01-02 3:04", "2021-01-02T03:04:05Z", "2021-01-02t03:04:05.123+0530", "2021-01-02 03:04:05.5 +01:00", "1/2/2021", "1/2/2021 3:04:05 pm", "Jan 5, 2021", "5 Sept 2021", "2021 Jan 5 3:04:05 PM", "T 5", "12:30", "T12:30:00", "9" * 18, "9" * 19, "+" + "9" * 18, "$" + "9" * 18, "1-2", "x 2021-01-02", "5 é 2021", "٣", "1.5.2", "2021-W01", "--5", "8", "8888", "12345/1/2", "1/2/123", "0001/2/3", "1/2/0021", "123/4/5", "8/9/8888"]
    df = frame(spark, [(s,) for s in samples], "s string")
    c = F.col("s")
    times = [X.to_time(c, p).isNotNull().alias(f"p{i}") for i, p in enumerate(X.DATE_PATTERNS)]
    for r in df.select("s", X.text_kind(c).alias("kind"), X.is_number(c).alias("number"), X.is_percent(c).alias("percent"), X.to_number(c).isNotNull().alias("spelled"), X.stripped_number(c).rlike(r"^[+-]?\d{1,18}$").alias("whole"), *times).collect():
        k = r["kind"]
        assert (k in ("whole", "number")) == r["number"] and (k == "whole") == r["whole"] and (k in ("whole", "number", "spelled")) == r["spelled"], r
        assert (k == "percent") == r["percent"], r
        for i, p in enumerate(X.DATE_OUTLINES):
            if r[f"p{i}"]:
                assert i == 0 and k in ("whole", "number", "spelled", "time") or C.re.search(p, k), (r["s"], k, i)
