"""CSV records with line breaks, read in byte ranges."""

import csv
import random

import pytest

from tablewright.sources import quoted
from tablewright.sources.tables import read_csv

CELLS = ["", "a", "1.5", "NA", "é ü", 'say "hi"', "x,y", "two\nlines", "three\n\nmore\n", "\r\n", '"', '""\n"', "\n", " b "]


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", header=("id", "a", "b")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(CELLS), rng.choice(CELLS)) for i in range(n)]
    return [*rows, (n, "long\n" * 300, "z"), (n + 1, '",\n"' * 100, "")]


def by_multi_line(spark, path):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.option("maxCharsPerColumn", -1).schema("id string, a string, b string").csv(path)


@pytest.mark.parametrize("size, end", [(150, "\n"), (400, "\r\n")])
def test_ranges_equal_the_whole_file(spark, tmp_path, small_ranges, size, end):
    (tmp_path / "t").mkdir()
    for i in range(3):
        write(tmp_path / "t" / f"{i}.csv", rows_of(i, 20 * i), end, ('i"d', "a\nb", "c") if i == 2 else ("id", "a", "b"))
    path = str(tmp_path / "t")
    expected = sorted(str((str(i), a or None, b or None)) for k in range(3) for i, a, b in rows_of(k, 20 * k))
    if end == "\n":  # with carriage returns the whole-file reader leaves them in last cells
        assert sorted(str((r.id, r.a or None, r.b or None)) for r in by_multi_line(spark, path).collect()) == expected
    small_ranges(size)
    found = quoted.records(spark, path)
    assert found.count() == len(expected) == 60 + 6
    cells = found.selectExpr("from_csv(record, 'id string, a string, b string', map('escape', '\"')) AS c").select("c.*")
    assert sorted(str((r.id, r.a or None, r.b or None)) for r in cells.collect()) == expected


def test_read_csv_takes_many_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "t.csv", rows_of(5, 150))
    small_ranges(400)
    read = read_csv(spark, str(tmp_path / "t.csv"))
    assert read.rdd.getNumPartitions() > 8
    found = {r.id: (r.a, r.b) for r in read.collect()}
    missing = {"", "NA"}
    wanted = {i: tuple(None if x in missing else x for x in (a, b)) for i, a, b in rows_of(5, 150)}
    assert found == wanted


@pytest.mark.parametrize("text", ['a,b\n1,5" pipe\n2,"x\ny"\n', 'a,b\n1,"x\ny"\n2,3" and 4"\n', 'a,b\n1,"x\n'])
def test_other_quotes_are_left_to_the_reader(spark, tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    assert quoted.records(spark, str(tmp_path / "t.csv")) is None


def test_a_stray_quote_reads_right(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,5" pipe\n2,"x\ny"\n')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "t.csv")).collect())) == [(1, '5" pipe'), (2, "x\ny")]
