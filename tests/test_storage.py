import pytest

from kategora.plans import storage


def test_small_tables_are_broadcast_and_large_ones_staged(spark, capsys):
    five = spark.range(5)
    small, large = storage.pinned(five), storage.pinned(five, limit=3)
    assert sorted(small.collect()) == sorted(large.collect()) == sorted(five.collect())
    small.explain()
    assert "LocalTableScan" in capsys.readouterr().out
    large.explain()
    assert "FileScan parquet" in capsys.readouterr().out
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()
    storage.discard(large)
    with pytest.raises(Exception):
        large.collect()


def test_bytes_of_nested_values(spark):
    """What lies in structs, arrays and maps counts by its actual length."""
    schema = "a array<struct<label int, v array<double>>>, s string, m map<string,array<long>>, n array<string>"
    rows = [([(1, [0.0] * 60), (2, [0.0] * 60)], "x" * 100, {"k": [1] * 50}, ["abc"] * 10), (None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    full, none = (r[0] for r in df.select(storage.byte_size(df.schema)).collect())
    assert 960 + 100 + 400 + 30 <= full <= 2 * (960 + 100 + 400 + 110)
    assert 16 <= none <= 200


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            return self.value or default

    class Session:
        def __init__(self, value):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})()

    assert storage.shared_dir(Session("/shared/ck/")) == "/shared/ck"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(None))
