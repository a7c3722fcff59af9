"""Reading CSV files and zip archives side by side gives what one reader gives."""

import csv
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kategora.sources import archives
from kategora.sources.archives import read_zipped_csv, write_zipped_csv
from kategora.sources.articles import read_articles
from kategora.sources.records import header_of, read_records, split_lines


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", opened)


def field(draw):
    kind = draw.random()
    if kind < 0.1:
        return "\n" * draw.randint(1, 400)
    if kind < 0.2:
        return "long line without a break " * draw.randint(1, 30)
    return "".join(draw.choice(['"', "\n", ",", "a", "é", "本", " "]) for _ in range(draw.randint(1, 40)))


@pytest.mark.parametrize("seed", range(2))
def test_any_fields(spark, tmp_path, small_splits, seed):
    """Quotes, line breaks and long fields across many borders, against the csv module; blank lines are none."""
    draw = random.Random(seed)
    want = []
    for name in ("a", "b"):
        rows = [("x" + field(draw), "y" + field(draw), str(i)) for i in range(150)]
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\r\n" if seed % 2 else "\n")
            writer.writerow(["title", "content", "n"])
            for row in rows:
                writer.writerow(row)
                if draw.random() < 0.1:
                    file.write("\n")
        want += rows
    assert split_lines(spark, [f"{tmp_path}/*.csv"]).rdd.getNumPartitions() > 20
    got = read_articles(spark, f"{tmp_path}/*.csv", "title string, content string, n string", null_tokens=())
    assert [(r.title, r.content, r.n) for r in got.orderBy("row_key").collect()] == want
    keys = [r.row_key for r in got.filter("row_key < 1000").orderBy("row_key").collect()]
    assert keys == list(range(150))


def test_open_quote_at_the_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"never closed\nand so on\n')
    rows = read_records(spark, [f"{tmp_path}/a.csv"]).orderBy("number").collect()
    assert [(r["number"], r["text"]) for r in rows] == [(0, "a,b"), (1, '1,"never closed\nand so on')]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufefftitle,content\r\n1,2\r\n")
    (tmp_path / "b.csv").write_text("title,content\n3,4")
    assert header_of(read_records(spark, [f"{tmp_path}/*.csv"])) == ["title", "content"]
    (tmp_path / "c.csv").write_text("content,title\n5,6\n")
    with pytest.raises(ValueError):
        read_articles(spark, f"{tmp_path}/*.csv")


def test_zip_members_are_partitions(spark, tmp_path):
    """One archive, several tasks; small members share a partition; other members are not read."""
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for i in range(6):
            archive.writestr(f"dir/{i}.csv", "title,n\n" + "".join(f'"t{i}\n{k}",{k}\n' for k in range(100)))
        archive.writestr("small.csv", "n,title\n7,s\n")
        archive.writestr("readme.txt", "title,n\nno,1\n")
    rows = read_zipped_csv(spark, str(tmp_path / "*.zip"), "title string, n int, missing string", 1_000)
    reader = archives.ZipReader(str(tmp_path / "*.zip"), rows.schema, 1_000)
    assert len(reader.partitions()) == 7
    assert rows.rdd.getNumPartitions() == 7
    assert rows.groupBy("member").count().count() == 7
    assert rows.filter("missing is null").agg(F.count("*"), F.sum("n")).first() == (601, 6 * 4950 + 7)


def test_zip_round_trip(spark, tmp_path):
    made = spark.range(0, 5_000, 1, 3).select(F.concat(F.lit('q"\n'), F.col("id").cast("string")).alias("title"), F.col("id").alias("n"))
    write_zipped_csv(made, str(tmp_path / "out"), 10_000)
    assert len(list((tmp_path / "out").glob("*.zip"))) == 3 and not list((tmp_path / "out").glob("*.tmp"))
    read = read_zipped_csv(spark, str(tmp_path / "out"), "title string, n long")
    assert read.select("member").distinct().count() > 1
    assert sorted(map(tuple, read.select("title", "n").collect())) == sorted(map(tuple, made.collect()))


def test_no_archives(spark, tmp_path):
    assert read_zipped_csv(spark, str(tmp_path), "title string").count() == 0
