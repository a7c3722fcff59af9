import zipfile

import pytest
from pyspark.sql import functions as F

from kategora.checks import files
from kategora.operators.inspect import count_empty, head, profile, shape, value_counts
from kategora.operators.prepare import assemble_text, count_matching, drop_empty, exclude_url
from kategora.sources import corpus as corpus_files
from kategora.sources.archives import read_zipped_csv, write_zipped_csv
from kategora.sources.articles import ARTICLES, read_articles, write_csv
from kategora.sources.corpus import read_corpus, read_corpus_body, write_corpus

CSV = (
    "url,title,content,category,user\n"
    'http://x/a,題一,"line1\nline2 ""quoted""",sports,001\n'
    "http://x/pickup/b,t2,,life,002\n"
    ",t3,c3,life,003\n"
    "http://x/pickup/d,NA,c4,life,\n"
    "http://x/e,t5,c5,world,005\n"
)


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "b.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "a.csv").write_text(CSV.split("http://x/e")[0], encoding="utf-8")
    return tmp_path


def test_csv_fields(spark, csv):
    rows = read_articles(spark, str(csv / "b.csv")).orderBy("row_key").collect()
    assert len(rows) == 5
    assert rows[0].content == 'line1\nline2 "quoted"' and rows[0].user == "001"
    assert rows[1].content is None and rows[3].title is None and rows[2].url is None
    assert [r.category for r in rows] == ["sports", "life", "life", "life", "world"]


def test_csv_glob(spark, csv):
    assert read_articles(spark, f"{csv}/*.csv").count() == 9
    assert read_articles(spark, f"{csv}/*.csv", pick="first").count() == 4


def test_csv_keeps_other_columns(spark, tmp_path):
    (tmp_path / "u.csv").write_text("extra,title,content\nkeep,t,c\n")
    row = read_articles(spark, str(tmp_path / "u.csv")).first()
    assert (row.extra, row.title, row.content) == ("keep", "t", "c")


def test_url_filter_keeps_missing_urls(spark, csv):
    articles = read_articles(spark, str(csv / "b.csv"))
    assert exclude_url(articles, "/pickup/").count() == 3
    assert count_matching(articles, "/pickup/").first().matching == 2


def test_assembled_text_is_null_if_a_part_is(spark, csv):
    texts = assemble_text(read_articles(spark, str(csv / "b.csv")), "。", "parts")
    assert [r.text is None for r in texts.orderBy("row_key").collect()] == [False, True, False, True, False]


def test_csv_round_trip(spark, csv, tmp_path):
    articles = read_articles(spark, str(csv / "b.csv")).drop("row_key")
    for compression in (None, "gzip"):
        out = str(tmp_path / f"out-{compression}")
        write_csv(articles, out, compression)
        again = read_articles(spark, out).drop("row_key")
        assert sorted(again.collect(), key=str) == sorted(articles.collect(), key=str)


@pytest.fixture
def corpus(tmp_path):
    files = {
        "sports/1.txt": "http://a\n2020\n　見出し \n　本文一\n\n本文\t二\r\n三\n",
        "sports/2.txt": "http://b\r\n2020\r\n\r\ncontent\r\n",
        "sports/LICENSE.txt": "a\nb\nc\nd\n",
        "life it/3.txt": "u\nd\ntitle\n\n",
        "life it/4.txt": "u\nd\n",
        "life it/skip.md": "u\nd\ntitle\nbody\n",
    }
    for name, content in files.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    return str(tmp_path / "corpus")


def test_corpus(spark, corpus):
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_corpus(spark, corpus).collect()}
    assert sorted(rows) == ["1.txt", "2.txt", "3.txt", "4.txt"]
    first = rows["1.txt"]
    assert (first.category, first.title, first.content) == ("sports", "見出し", "本文一\n\n本文\t二\n三")
    assert (rows["2.txt"].title, rows["2.txt"].content) == ("", "content")
    assert rows["3.txt"].category == "life it" and rows["3.txt"].content == ""
    assert rows["4.txt"].title is None


def test_corpus_counts(spark, corpus):
    articles = read_corpus(spark, corpus)
    empty = count_empty(articles).first()
    assert (empty.empty_title, empty.empty_content) == (1, 2)
    assert [r.title for r in drop_empty(articles).collect()] == ["見出し"]


def test_corpus_body(spark, corpus):
    rows = {r.path.rsplit("/", 1)[1]: r.text for r in read_corpus_body(spark, corpus).collect()}
    assert rows == {"1.txt": "本文一本文二三", "2.txt": "content", "3.txt": "", "4.txt": ""}


def test_corpus_without_exclusions(spark, corpus):
    assert read_corpus(spark, corpus, exclude=()).count() == 5


def test_corpus_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Folders of any depth and name, as Spark's reader finds them; the driver gets no list of files."""
    files = {
        "a b+%c/é中/p q[1]#é.txt": b"1\n2\n3\n4", "top.txt": b"1\n2\n\xff\n4", "_x=1/a.txt": b"q", "empty.txt": b"",
        "_hidden/a.txt": b"q", ".d/a.txt": b"q", "_h.txt": b"q", "a/b/c/LICENSE.txt": b"q", "a/b/c/d/e.txt": b"q\n", "a/no.md": b"q",
    }
    for name, content in files.items():
        path = tmp_path / "deep er" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    root = str(tmp_path / "deep er")
    shown = lambda: sorted(map(tuple, read_corpus(spark, root).collect()), key=str)
    found = shown()
    assert len(found) == 4 and {r[0] for r in found} == {"é中", "deep er", "_x=1", "d"}
    assert corpus_files._listed(spark, f"{root}/*") is None and corpus_files._listed(spark, f"{root}/none") is None
    reader = spark.read
    monkeypatch.setattr(type(reader), "text", lambda *a, **k: pytest.fail("the driver lists the files"))
    assert shown() == found
    monkeypatch.undo()
    monkeypatch.setattr(corpus_files, "_listed", lambda *a: None)
    assert shown() == found


def test_zip(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.writestr("one.csv", CSV)
            archive.writestr("sub/two.csv", CSV)
            archive.writestr("notes.txt", "no table")
    rows = read_zipped_csv(spark, f"{tmp_path}/*.zip", ARTICLES)
    assert rows.count() == 20
    assert rows.select("archive").distinct().count() == 2
    per = {r.category: r["count"] for r in value_counts(rows, "category").collect()}
    assert per == {"life": 12, "sports": 4, "world": 4}
    assert rows.filter("user = '001'").count() == 4
    size = shape(rows).first()
    assert (size.n_rows, size.n_cols) == (20, 7)
    filled = {r.column: r.non_null for r in profile(rows).collect()}
    assert filled["url"] == 16 and filled["category"] == 20
    assert head(rows, 3, "title").count() == 3


def test_row_keys_do_not_depend_on_packing(spark, tmp_path):
    """Files of unequal size, read by few and by many tasks: same keys, in order of file and line."""
    sizes = {"b.csv": 400, "a.csv": 30, "c.csv": 7}
    for name, n in sizes.items():
        lines = [f'http://x/{name}/{i},"t\n{i}",c,k,u' for i in range(n)]
        (tmp_path / name).write_text("url,title,content,category,user\n" + "\n".join(lines) + "\n")
    seen, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = read_articles(spark, f"{tmp_path}/*.csv").select("row_key", "url").collect()
            seen.append([r["url"] for r in sorted(rows)])
            assert len({r["row_key"] for r in rows}) == 437
            assert [r["row_key"] for r in sorted(rows)][:2] == [0, 1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"http://x/{name}/{i}" for name in sorted(sizes) for i in range(sizes[name])]
    assert seen == [want, want]


def test_zip_without_rows(spark, tmp_path):
    """A task without rows writes an archive without members, which is read as one."""
    rows = spark.createDataFrame([(1, "a,b"), (2, 'c "d"\ne'), (3, None)], "id long, text string").repartition(8, "id")
    write_zipped_csv(rows, str(tmp_path / "zip"))
    assert any(not zipfile.ZipFile(f).namelist() for f in (tmp_path / "zip").glob("*.zip"))
    read = read_zipped_csv(spark, str(tmp_path / "zip"), "id long, text string")
    assert sorted((r["id"], r["text"]) for r in read.collect()) == [(1, "a,b"), (2, 'c "d"\ne'), (3, None)]
    write_zipped_csv(rows.filter("id > 3"), str(tmp_path / "none"))
    assert read_zipped_csv(spark, str(tmp_path / "none"), "id long").count() == 0


def test_write_corpus(spark, tmp_path):
    """Folders by value, NULL and empty ones too; rows of a task and folder share a file; the session's setting stays."""
    rows = [("a/b", 1, "x\ny"), ("a/b", 1, "x\ny"), (None, 2, "é"), ("", 3, None), ("c d", None, "z")]
    root = str(tmp_path / "corpus")
    write_corpus(spark.createDataFrame(rows, "kind string, id long, value string").coalesce(1), root, ["id", "kind"])
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    assert sorted(r[0] for r in files.collect()) == ["\n", "x\ny\nx\ny\n", "z\n", "é\n"]
    found = read_corpus(spark, root).select("category").collect()
    assert sorted(r[0] for r in found) == ["kind=__HIVE_DEFAULT_PARTITION__"] * 2 + ["kind=a%2Fb", "kind=c d"]
    write_corpus(spark.createDataFrame([(f"{i:03d}", "t\n" * 4) for i in range(600)], "kind string, value string"), f"{root}2", ["kind"])
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert read_corpus(spark, f"{root}2").count() == 600
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_files_grow_in_number(spark, tmp_path, monkeypatch):
    """A large table is written to more files and cut into no more splits; its rows and places stay."""
    rows = [(i, f"title {i}\nbody {i}\n" + "x" * 200, "en", "web", 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    shown = lambda: (sorted(map(tuple, files.csv_split(spark, str(tmp_path)).collect())), sorted(map(tuple, files.csv_tail(spark, str(tmp_path)).collect())))
    want = shown()
    assert files._files_for(spark, str(tmp_path), 3) == 3
    monkeypatch.setattr(files, "FILE_BYTES", files._total(spark, f"{tmp_path}/documents.parquet") // 9)
    monkeypatch.setattr(files, "SPLITS", 1)
    assert files._files_for(spark, str(tmp_path), 3) >= 9
    assert shown() == want
