"""Compare all queries with their SQL: ``python tests/run_all.py FOLDER [NAME ...]``."""

import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).parent))

from compare import compare, connect
from pyspark.sql import SparkSession

import __spark_entry__ as registry


def main(folder: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = registry.oracle_sql()
    bad = 0
    for name, query in registry.queries().items():
        if names and name not in names:
            continue
        try:
            problem, n, a, b = compare(spark, query, oracles.get(name), folder, con)
        except Exception as error:  # show the failure and go on with the others
            problem, n, a, b = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0, 0.0
        bad += problem is not None
        print(f"{name:26} rows {n:8} spark {a:6.2f}s sql {b:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
