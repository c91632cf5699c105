import random

import pytest
from pyspark.sql import functions as F

from harrow.sources import files, split_csv
from tests.helpers import rows


def odd_table(n, seed=2):
    rng = random.Random(seed)
    parts = ["a", "é", '""', ",", "\n", "\n\n", "\r\n", " ", "long " * 9, ""]
    out = []
    for i in range(n):
        cell = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 7)))
        out.append(f'{i},"{cell}",{rng.choice(["", "x", "y z"])}')
    return out


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_split_reading_equals_the_whole(spark, tmp_path, small_ranges, ending):
    (tmp_path / "a.csv").write_text(ending.join(["i,cell,more", *odd_table(40)]) + ending, newline="")
    (tmp_path / "b.csv").write_text(ending.join(["i,cell,more", *odd_table(9, 3)]), newline="")
    schema = "i int, cell string, more string"
    # Spark's reader of whole files turns line breaks in cells into those of the lines; here they stay
    same = F.regexp_replace("cell", "\r\n", "\n").alias("cell")
    want = rows(files.read_delimited(spark, str(tmp_path), schema).select("i", same, "more"))
    assert len(want) == 49
    for size in (1 << 20, 300, 61, 7):
        small_ranges(size)
        got = files.read_delimited(spark, str(tmp_path), schema, split=True)
        assert rows(got.select("i", same, "more")) == want, size
        if size == 61:
            assert split_csv._lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 20


def test_every_border(spark, tmp_path, small_ranges):
    text = 'i,cell\n1,"a\nb"\n2,"say ""x"", then"\n3,","\n4,""\n5,plain\n'
    (tmp_path / "a.csv").write_text(text)
    want = [(1, "a\nb"), (2, 'say "x", then'), (3, ","), (4, None), (5, "plain")]
    for size in range(1, len(text) + 1):
        small_ranges(size)
        assert rows(split_csv.read_split(spark, str(tmp_path / "a.csv"), "i int, cell string")) == want, size


def test_names_from_the_header_and_broken_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i;"my; name"\n1;x\n\n2;"y"\n')
    df = split_csv.read_split(spark, str(tmp_path / "a.csv"), sep=";")
    assert df.columns == ["i", "my; name"] and rows(df) == [("1", "x"), ("2", "y")]
    (tmp_path / "b.csv").write_text('i\n"1\n')
    with pytest.raises(ValueError, match="without its pair"):
        split_csv.read_split(spark, str(tmp_path / "b.csv"))


def test_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,cell\n")
    assert split_csv.read_split(spark, str(tmp_path / "a.csv"), "i int, cell string").agg(F.count("*")).first()[0] == 0
