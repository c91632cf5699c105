"""Schema, filters, joins, aggregates, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.operators import aggregates, filters, groups, joins, schema
from harrow.operators.text_columns import ordinal_with_mode, zip_split
from harrow.plans import intake, outcomes, profiles, reconcile
from harrow.sources import files, sinks
from tests.helpers import one, rows


def test_drift_and_reconcile(spark):
    old = spark.createDataFrame([("1", "Ann", None, "Lee", 5)], "CASE_NO string, F string, M string, L string, extra int")
    new = spark.createDataFrame([("2", "Bob X Ray", "TX")], "CASE_NUMBER string, AGENT string, state string")
    tables = {"file_2014": old, "file_2015": new}
    assert schema.common_columns([old, new]) == []
    assert schema.new_columns(tables) == [("file_2015", "CASE_NUMBER"), ("file_2015", "AGENT"), ("file_2015", "state")]
    assert schema.exclusive_columns(new, [old]) == ["CASE_NUMBER", "AGENT", "state"]
    both = reconcile.reconcile_periods(tables, {"CASE_NO": "CASE_NUMBER", "absent": "x"}, person=("AGENT", ("F", "M", "L")))
    assert set(both.columns) == {"CASE_NUMBER", "AGENT", "data_source"}
    assert rows(both, "CASE_NUMBER", "AGENT", "data_source") == [("1", "Ann  Lee", "file_2014"), ("2", "Bob X Ray", "file_2015")]
    wide = reconcile.reconcile_periods(tables, {"CASE_NO": "CASE_NUMBER"}, person=("AGENT", ("F", "M", "L")), common_only=False)
    assert rows(wide, "CASE_NUMBER", "extra", "state") == [("1", 5, None), ("2", None, "TX")]
    report = rows(schema.drift_report(spark, tables), "period", "column", "status")
    assert ("file_2015", "state", "new") in report


def test_clean_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], T.StructType([T.StructField(n, T.IntegerType()) for n in ["CaseID/Lead Case #", "Case #", "case  number", "Case #?"]]))
    assert schema.clean_names(df).columns == ["caseidlead_case_number", "case_number", "case_number_2", "case_number_3"]


def test_dictionary_and_column_picks(spark):
    s = schema.schema_from_dictionary([("case_id", "Numeric"), ("legal_name", "Char"), ("ld_dt", "Date")])
    assert [f.dataType.simpleString() for f in s] == ["double", "string", "date"]
    df = spark.createDataFrame([(1, "a", 2.0)], "B1_E int, name string, B2_X double")
    assert schema.columns_like(df, prefix="B", suffix="E") == ["B1_E"]
    assert schema.numeric_columns(df) == ["B1_E", "B2_X"]
    assert schema.narrow_text_columns(df, 0) == []


def test_crosswalk(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    walk = spark.createDataFrame([("x", "a", "alpha"), ("x", "zz", "none"), ("y", "b", "beta")], "source string, old_name string, new_name string")
    assert schema.rename_by_crosswalk(df, walk, "x").columns == ["alpha", "b"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "11123", 0.0), (2, "222", 10.0), (3, "999", 20.0), (4, None, 5.0)], "i int, code string, n double")
    jobs = spark.createDataFrame([("222",), (None,)], "c string")
    assert one(filters.pattern_or_member(df, "code", "^11", jobs, "c").select("i").orderBy("i")) == [1, 2]
    assert rows(filters.member_flag(df, F.col("code"), jobs, "c", "m"), "i", "m") == [(1, False), (2, True), (3, False), (4, False)]
    dated = df.withColumn("d", F.lit(dt.date(2015, 5, 5)))
    # counts that contain the digit 0 stay
    assert one(filters.counted_in_years(dated, "n", "d", 2012, 2020).select("i").orderBy("i")) == [2, 3, 4]
    kept, aside = filters.complete_rows(df, ["code"])
    assert (kept.count(), aside.count()) == (3, 1)
    good, bad = filters.split_by_rule(df, F.col("code") == "222")
    assert one(good.select("i")) == [2] and bad.count() == 3
    names = spark.createDataFrame([("Texas Unemployment Commission",), ("Farm",), (None,)], "t string")
    assert rows(filters.without_institutions(names, "t")) == [(None,), ("Farm",)]
    sections = spark.createDataFrame([("el trabajo",), ("the job",), (None,)], "t string")
    assert one(filters.without_marker_words(sections, "t")) == ["the job"]


def test_group_filters(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 1.0), ("c", None)], "m string, v double")
    assert sorted(set(one(filters.without_flat_groups(df, "m", "v").select("m")))) == ["b", "c"]
    assert rows(filters.groups_where(df, "m", F.count("*") > 1, F.max("v") > 0), "m") == [("b",), ("b",)]
    t = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "k string, v string")
    assert rows(filters.most_frequent_per_group(t, "k", "v"), "k", "v") == [("x", "p"), ("x", "q"), ("y", "p")]


def test_precedence_merge_rules(spark):
    a = spark.createDataFrame([(1, None, "TX"), (2, "A", None), (3, None, None)], "k int, party string, state string")
    b = spark.createDataFrame([(1, "B", "GA"), (2, "C", "GA"), (4, "D", None)], "k int, party string, state string")
    got = joins.precedence_merge(a, b, "k", ["party", "state"], "party", ("a", "b"))
    assert rows(got, "k", "party", "state", "source") == [
        (1, "B", "TX", "b"), (2, "A", "GA", "a"), (3, None, None, "missing in both"), (4, "D", None, "b_only")
    ]


def test_enrich_distinct_asks_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "z")], "i int, k string")
    cache = spark.createDataFrame([("x", 1.0), ("unused", 9.0)], "k string, lat double")
    seen = []

    def enrich(keys):
        seen.extend(one(keys))
        return keys.where("k <> 'z'").withColumn("lat", F.lit(2.0))

    got = joins.enrich_distinct(df, "k", cache, enrich)
    assert rows(got, "i", "lat") == [(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, None)]
    assert sorted(seen) == ["y", "z"]


def test_full_and_missing_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    assert rows(joins.full_by_key(a, b, ["k"]), "k", "x", "y") == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    assert rows(joins.add_missing_keys(a, b, ["k"]), "k", "x") == [(1, "a"), (2, "b"), (3, None)]


def test_representative_row_by_type(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("a", 1.0, "x", d(2020, 1, 2), d(2020, 1, 2)), ("a", 3.0, "y", d(2020, 1, 1), d(2020, 1, 5)), ("a", None, "y", None, None), ("b", None, None, None, None)],
        "k string, n double, t string, START_D date, END_D date",
    )
    assert rows(aggregates.representative_rows(df, "k")) == [
        ("a", 2.0, "y", d(2020, 1, 1), d(2020, 1, 5)), ("b", None, None, None, None)
    ]


def test_ratio_to_first_zero_base(spark):
    df = spark.createDataFrame([("g", "t", "001", 0.0), ("g", "t", "002", 5.0), ("h", "t", "001", 4.0), ("h", "t", "002", 1.0)], "g string, t string, s string, v double")
    assert rows(aggregates.ratio_to_first(df, ["g", "t"], "s", "v"), "g", "s", "ratio") == [("g", "002", None), ("h", "002", 0.25)]


def test_concat_text_parts_lose_nothing(spark):
    data = [("hot", i, f"piece {i:03d}\n") for i in range(60)] + [("small", 2, "b"), ("small", 1, "a\n"), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, t string").repartition(4)
    whole = {r["k"]: r["text"] for r in aggregates.concat_text(df, "k", "t", ["i"]).collect()}
    assert whole["small"] == "a || b" and set(whole) == {"hot", "small"}
    parts = aggregates.concat_text(df, "k", "t", ["i"], part_chars=100).where("k = 'hot'").orderBy("part").collect()
    assert len(parts) > 5 and max(p["n_chars"] for p in parts) <= 120
    assert "".join(p["text"] for p in parts) == whole["hot"]


def test_mean_of_distinct_skips_nan(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 2.0), ("a", 2, float("nan")), ("a", 3, 4.0)], "g string, i int, v double")
    assert rows(aggregates.mean_of_distinct(df, ["g"], "v", ["i"])) == [("a", 3.0)]


def test_pivot_of_unpivot_is_identity(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, None)], "k int, a double, b double")
    long = aggregates.lengthen(df, ["k"], ["a", "b"])
    assert rows(aggregates.widen(long, ["k"], "variable", "value", ["a", "b"])) == rows(df)


def test_percent_positive_needs_both_classes(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True)], "c string, f boolean")
    assert rows(aggregates.percent_positive(df, "c", F.col("f")), "c", "percent_positive") == [("a", 50.0)]


def test_groups(spark):
    d = dt.date
    df = spark.createDataFrame([("g", 1, d(2020, 2, 1), "TX"), ("g", 2, d(2020, 1, 1), None), ("g", 3, d(2020, 1, 1), "GA"), ("h", 4, None, "TX")], "g string, i int, d date, s string")
    assert one(groups.earliest_of_group(df, "g", "d", "i").select("i").orderBy("i")) == [2, 4]
    split = groups.split_groups_by(df, "g", "s", "gid")
    assert rows(split, "i", "gid") == [(1, "g_2"), (2, "g_3"), (3, "g_1"), (4, "h_1")]
    assert one(groups.single_value_groups(split, "gid", "s").select("is_single").distinct()) == [True]
    first, second = df.where("s = 'TX'"), df.where("i = 2")
    assert rows(groups.key_category(df.select("i"), first, second, "i", ("A", "B"))) == [(1, "A only"), (2, "B only"), (3, "Neither"), (4, "A only")]


def test_top_fraction_ties_by_id(spark):
    df = spark.createDataFrame([("m", i, 0.5 if i < 38 else 0.9) for i in range(40)], "model string, i int, s double")
    top = groups.top_fraction(df, "model", "s", "i", 0.1).where("is_top")
    assert one(top.select("i").orderBy("i")) == [0, 1, 38, 39]


def test_zip_split_and_ordinal(spark):
    df = spark.createDataFrame([(1, "a\rb", "TX,GA"), (2, "a\rb", "TX"), (3, None, "TX")], "i int, o string, s string")
    assert rows(zip_split(df, {"o": "\r", "s": ","}, ["name", "state"])) == [(1, "a", "TX"), (1, "b", "GA")]
    d = spark.createDataFrame([(dt.date(1, 1, 2),), (dt.date(1, 1, 2),), (dt.date(1, 1, 9),), (None,)], "d date")
    assert sorted(one(ordinal_with_mode(d, "d", "n").select("n"))) == [2, 2, 2, 9]


def test_windows_with_event(spark):
    d = dt.date
    jobs = spark.createDataFrame([("a", d(2020, 1, 1), d(2020, 1, 5)), ("a", d(2020, 1, 6), d(2020, 1, 9)), ("b", d(2020, 1, 1), d(2020, 1, 9)), ("a", None, None)], "g string, s date, e date")
    events = spark.createDataFrame([("a", d(2020, 1, 5)), ("a", d(2020, 2, 1)), ("c", d(2020, 1, 2)), ("b", None)], "g string, f date")
    got = outcomes.windows_with_event(jobs, events, "g", "s", "e", "f", "hit")
    assert rows(got, "g", "s", "hit") == [("a", None, False), ("a", d(2020, 1, 1), True), ("a", d(2020, 1, 6), False), ("b", d(2020, 1, 1), False)]


def test_intake_settling(spark):
    df = spark.createDataFrame([(1, None, "L", "n"), (2, None, None, None)], "i int, org string, lead string, name string")
    got = intake.settle_opponent(df, [("org", "AP org"), ("lead", "Lead AP org"), ("name", "AP name")], ["name"])
    assert rows(got, "opponent", "opponent_source", "opponent_state") == [(None, "Missing all", None), ("L", "Lead AP org", "n")]
    codes = spark.createDataFrame([(None, "CLO"), (None, "zz"), ("Own", "PEN")], "own string, code string")
    assert one(codes.select(intake.disposition("own", "code"))) == ["Closed", "Unknown dispo", "Own"]


def test_sources(spark, tmp_path):
    for year in (2014, 2015):
        (tmp_path / f"jobs_{year}.csv").write_text(f"a,b\n{year},\n")
    got = files.read_periods(spark, str(tmp_path / "jobs_*.csv"), "a int, b string")
    assert rows(got) == [(2014, None, 2014), (2015, None, 2015)]
    (tmp_path / "FACT_MAR2012.TXT").write_text("a\n1\n")
    assert rows(files.read_quarters(spark, str(tmp_path / "FACT_*.TXT"), "a int")) == [(1, 2012, "MAR")]
    assert files.period_names("F_{mon}{year}.TXT", ["MAR", "JUN"], [2011])[1] == ("F_JUN2011.TXT", 2011, "JUN")
    book = tmp_path / "book"
    book.mkdir()
    (book / "Sheet A.csv").write_text("Unnamed: 0,x\n0,5\n")
    (book / "Sheet B.csv").write_text("Unnamed: 0,x\n0,6\n")
    sheets = files.read_sheets(spark, str(book), "`Unnamed: 0` int, x int")
    assert sorted(r["x"] for r in sheets.collect()) == [5, 6] and sheets.columns == ["x", "sheet"]


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert sinks.stage(spark, path, build).count() == 3
    assert sinks.stage(spark, path, build).count() == 3
    assert len(calls) == 1
    sinks.stage(spark, path, build, reuse=False)
    assert len(calls) == 2


def test_geocode_null_on_any_miss(spark):
    good = '{"results":[{"accuracy":1.0,"accuracy_type":"rooftop","location":{"lat":1.5,"lng":-2.0}},{"accuracy":0.1}]}'
    df = spark.createDataFrame([(good,), ('{"results":[]}',), ("broken",), (None,)], "r string")
    got = [tuple(r) for r in files.first_geocode(df, "r").drop("r").collect()]
    assert got == [(1.5, -2.0, 1.0, "rooftop")] + [(None, None, None, None)] * 3


def test_links(spark):
    html = (
        '<p><a class="x" href="/a.xlsx">Plum table</a> <A HREF=\'/c.txt\' id=1>Pear\nlist</A><a href="/b.pdf">Plum annex</a>'
        "<a name=top>none</a><a data-href='/no' href = /d>Fig</a></p>"
    )
    links = files.page_links(spark.createDataFrame([("u", html)], "url string, html string"))
    assert rows(links, "href", "anchor") == [("/a.xlsx", "Plum table"), ("/b.pdf", "Plum annex"), ("/c.txt", "Pear\nlist"), ("/d", "Fig")]
    picked = files.select_links(links, anchor_has="Plum", anchor_lacks="annex", base="https://x")
    assert one(picked.select("link")) == ["https://x/a.xlsx"]


def test_columns_go_by_each_files_header(spark, tmp_path):
    (tmp_path / "list_2010.csv").write_text("case,name,state\n1,Ann,TX\n")
    (tmp_path / "list_2011.csv").write_text("state,extra,case,name\nCA,x,2,Bob\n")
    found = files.read_periods(spark, str(tmp_path / "list_*.csv"), "case int, name string, state string")
    assert rows(found) == [(1, "Ann", "TX", 2010), (2, "Bob", "CA", 2011)]
    (tmp_path / "list_2012.csv").write_text("case,who,state\n3,Cy,NM\n")
    with pytest.raises(ValueError, match="list_2012.csv has no column name"):
        files.read_periods(spark, str(tmp_path / "list_*.csv"), "case int, name string, state string")
    assert files.read_periods(spark, str(tmp_path / "none_*.csv"), "case int").collect() == []


def test_cells_with_quotes_and_line_breaks_read_back(spark, tmp_path):
    cells = ['he said ""go"", then "left"', "two\nlines", " spaces ", "a,b", 'back\\slash "q"', None, "plain"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    sinks.write_table(df, str(tmp_path / "out"), "csv")
    assert rows(files.read_delimited(spark, str(tmp_path / "out"), "i int, cell string")) == list(enumerate(cells))
    (tmp_path / "own.csv").write_text('i,cell\n1,"he said ""go"", then left"\n2,"a\nb"\n')
    assert rows(files.read_delimited(spark, str(tmp_path / "own.csv"), "i int, cell string")) == [(1, 'he said "go", then left'), (2, "a\nb")]


def test_a_side_without_rows_is_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "i int")
    paths = sinks.write_sides(df, F.col("i") > 0, str(tmp_path / "sides"))
    assert spark.read.parquet(paths["matched"]).count() == 2
    assert spark.read.parquet(paths["unmatched"]).count() == 0


def test_tidy_list_drops_blank_names(spark):
    from harrow.functions.dates import LONG_DATE, parse_date

    df = spark.createDataFrame([("Farm-\nOne", "May 13, 2020"), (None, "May 13, 2020"), ("Two", "junk")], "n string, s string")
    tidy = profiles.tidy_list(df, "n", parse_date(F.col("s"), LONG_DATE), F.lit(None).cast("date"))
    assert rows(tidy, "entity", "start_date") == [("Farm One", dt.date(2020, 5, 13))]


def test_checkpoint_folder_needs_setting_on_cluster():
    from harrow import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_folder(Spark())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_join_that_makes_many_rows_is_dealt_out(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("warm", i) for i in range(5)] + [("none", 1), ("none", 1), (None, 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(40)] + [("warm", 7), ("warm", 7), ("other", 1), (None, 3)], "k string, b int")
    got = joins.join_many(left, right, ["k"], how, made_rows=500)
    plain = left.join(right, ["k"], how)
    assert got.columns == plain.columns and rows(got) == rows(plain)
    assert rows(joins.join_many(left, right, ["k"], how)) == rows(plain)
    # the rows of one key are made in many tasks
    assert got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().count() > 5


def test_side_suffixes_of_a_hot_key_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins.join_many, "__defaults__", ("left", 500))
    left = spark.createDataFrame([(1, i) for i in range(200)], "k int, bal int")
    right = spark.createDataFrame([(1, i) for i in range(50)], "k int, bal int")
    got = joins.join_with_suffixes(left, right, ["k"], "left", ("_l", "_r"))
    assert got.columns == ["k", "bal_l", "bal_r"] and got.count() == 10_000
    assert got.groupBy(F.spark_partition_id()).count().count() > 5
