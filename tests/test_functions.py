import datetime as dt

from pyspark.sql import functions as F

from harrow.functions import dates, flags, geometry, strings
from harrow.functions.stemming import porter
from tests.helpers import one, rows


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_status_tail_and_after_dash(spark):
    df = texts(spark, "Determination Issued - Certification", "Withdrawn", None, "A - B - C")
    assert one(df.select(strings.status_tail(F.col("t")))) == ["- CERTIFICATION", None, None, "- B - C"]
    assert one(df.select(strings.after_dash(F.col("t")))) == ["Certification", None, None, "B - C"]


def test_company_name_longest_place_first(spark):
    df = texts(spark, "Green Farm - Alabama", "Green Farm; TX LLC", "Abc Company", "Abc, Inc.,.", "Farm &ndash West - al")
    assert one(df.select(strings.clean_company_name(F.col("t")))) == ["GREEN FARM", "GREEN FARM", "ABCMPANY", "ABC", "FARM  WEST"]
    bounded = one(df.select(strings.clean_company_name(F.col("t"), word_bounded=True)))
    assert bounded[2] == "ABC COMPANY"


def test_every_place_word_is_removed_whole(spark):
    words = strings.place_words()
    df = texts(spark, *[f"X - {w}" for w in words], *[f"X; {w}" for w in words])
    assert set(one(df.select(strings.clean_company_name(F.col("t"))))) == {"X"}
    assert len(strings.STATES) == 50


def test_missing_middle_name_leaves_two_spaces(spark):
    df = spark.createDataFrame([("Ann", None, "Lee"), ("Ann", "B", None)], "a string, b string, c string")
    assert one(df.select(strings.join_names(F.col("a"), F.col("b"), F.col("c")))) == ["Ann  Lee", "Ann B "]


def test_addresses(spark):
    df = spark.createDataFrame([("1 Rd", "Town", None, -5), (None, "Town", "TX", 77)], "a string, c string, s string, z int")
    piece = [strings.address_piece(F.col(n), k) for n, k in df.dtypes]
    assert one(df.select(strings.full_address(*piece))) == ["1 Rd, Town  ", ", Town TX 77"]
    assert one(df.select(strings.strict_address(F.col("a"), F.col("c")))) == ["1 Rd Town", None]
    date = spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")
    assert one(date.select(strings.address_piece(F.col("d"), "date"))) == [""]


def test_small_text_helpers(spark):
    df = texts(spark, "$1,234.50", "abc", None)
    assert one(df.select(strings.money(F.col("t")))) == [1234.5, None, None]
    head, tail = strings.split_once(F.col("t"))
    df = texts(spark, "B01_001_x", "plain")
    assert rows(df.select(head.alias("h"), tail.alias("v"))) == [("B01", "001_x"), ("plain", None)]
    df = texts(spark, "5", "123", "a-b")
    assert one(df.select(strings.zero_pad(F.col("t")))) == ["05", "123", "a-b"]
    assert one(df.select(strings.strip_dashes(F.col("t"))))[-1] == "ab"
    assert one(texts(spark, "1400000US01").select(strings.strip_prefix(F.col("t"), "1400000US"))) == ["01"]
    assert one(texts(spark, "45-2091.00").select(strings.before_dot(F.col("t")))) == ["45-2091"]
    assert one(texts(spark, "  a  b ").select(strings.squeeze_upper(F.col("t")))) == ["A B"]
    assert one(texts(spark, "Abc INC. x").select(strings.undot_company_form(F.col("t")))) == ["Abc INC x"]


def test_label_order_decides(spark):
    df = texts(spark, "random_forest_100020", "random_forest_10020", "gb_shallow", "gb_deep", "dt_deep")
    label = strings.label_by_pattern(F.col("t"), strings.MODEL_LABELS, strings.MODEL_DEFAULT)
    assert one(df.select(label)) == ["RF: deep", "RF: shallow", "GB: shallow", "GB: deep", "DT: deep"]


def test_readable_name(spark):
    df = spark.createDataFrame([("Estimate!!Total!!Male", "SEX (ALL) X")], "l string, c string")
    assert one(df.select(strings.readable_name(F.col("l"), F.col("c")))) == ["acs_Male_SEX__ALL__X"]


def test_dates(spark):
    df = texts(spark, "9/1/2019", "May 13, 2020", "01JAN2015", "2019-03-01 00:00:00.000000", "junk", None)
    parsed = dates.parse_date(F.col("t"), dates.SLASH_DATE, dates.LONG_DATE, dates.COMPACT_DATE)
    assert one(df.select(parsed)) == [dt.date(2019, 9, 1), dt.date(2020, 5, 13), dt.date(2015, 1, 1), None, None, None]
    assert one(df.select(dates.leading_date(F.col("t"))))[3] == dt.date(2019, 3, 1)
    d = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2020, 10, 1),), (None,)], "d date")
    assert one(d.select(dates.ordinal_day(F.col("d")))) == [dt.date(2020, 2, 29).toordinal(), dt.date(2020, 10, 1).toordinal(), None]
    assert one(d.select(dates.quarter_label(F.col("d")))) == ["MAR", "DEC", None]
    assert one(d.select(dates.label_quarter(dates.quarter_label(F.col("d"))))) == [1, 4, None]
    assert one(d.select(dates.in_range_flag(F.col("d"), dt.date(2020, 1, 1), dt.date(2020, 6, 1)))) == [1, 0, None]


def test_window_outcomes_unknown_is_false(spark):
    day = dt.date
    df = spark.createDataFrame(
        [
            ("before", True, day(2020, 1, 1), 1.0, 0.0, 0.0), ("on", True, day(2020, 2, 1), 0.0, 0.0, 2.0),
            ("inside", True, day(2020, 2, 5), 5.0, 0.0, 0.0), ("after", True, day(2020, 4, 1), 5.0, 0.0, 0.0),
            ("null", True, None, 5.0, 0.0, 0.0), ("unmatched", None, day(2020, 2, 5), 5.0, 0.0, 0.0),
        ],
        "k string, m boolean, f date, v double, a double, b double",
    )
    out = flags.window_outcomes(F.col("m"), F.col("f"), F.lit(day(2020, 2, 1)), F.lit(day(2020, 3, 1)), F.col("v"), (F.col("a"), F.col("b")))
    got = {r["k"]: tuple(r)[1:] for r in df.select("k", *[c.alias(n) for n, c in out.items()]).collect()}
    t, f = True, False
    assert got["before"] == (t, f, t, f, f, f)
    assert got["on"] == (t, t, f, t, f, t)
    assert got["inside"] == (t, t, f, t, t, t)
    assert got["after"] == (t, t, f, f, f, f)
    assert got["null"] == (t, f, f, f, f, f)
    assert got["unmatched"] == (f, f, f, f, f, f)


def test_two_sources_null_second_is_neither(spark):
    df = spark.createDataFrame([(True, None), (True, True), (False, None), (False, True)], "a boolean, b boolean")
    got = one(df.select(flags.two_source_category(F.col("a"), F.col("b"), "A", "B")))
    assert got == ["Neither A nor B", "Both A and B", "Neither A nor B", "B; not A"]


def test_effect_zero_has_no_category(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.05, -0.05), (0.2, -0.3)], "a double, b double")
    got = one(df.select(flags.coefficient_category(F.col("a"), F.col("b"), "A", "B")))
    assert got == [None, "Small both", "Higher risk A"]


def test_centroid_of_square_with_hole(spark):
    pt = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    outer = F.array(pt(0, 0), pt(4, 0), pt(4, 4), pt(0, 4), pt(0, 0))
    hole = F.array(pt(2, 1), pt(2, 3), pt(3, 3), pt(3, 1))
    x, y = geometry.centroid(F.array(outer, hole))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got["x"] - (16 * 2 - 2 * 2.5) / 14) < 1e-9 and abs(got["y"] - 2) < 1e-9


def test_porter_published_examples():
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
        "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
        "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
        "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
        "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
        "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
        "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
        "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
        "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
        "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "termination": "termin",
    }
    assert {w: porter(w) for w in pairs} == pairs
