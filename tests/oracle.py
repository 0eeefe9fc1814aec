"""Run registered queries beside their SQL answers and report differences.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LAPSEGRID_TESTDATA", "/root/testdata")


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lapsegrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def make_duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=8")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else ("f", value)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if value is None:
        return "NULL"
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if hasattr(value, "asDict"):
        return ("s", tuple(sorted((k, plain(v)) for k, v in value.asDict().items())))
    if isinstance(value, dict):
        return ("s", tuple(sorted((k, plain(v)) for k, v in value.items())))
    return ("x", str(value))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: Queries without an SQL answer; a query that is not named here must have one.
NO_SQL = {"principal_component_order", "kmeans_states", "bisecting_states", "mixture_states", "cohort_clusters"}


def compare(spark, duck, folder: str, name: str):
    """(ok, message, rows)"""
    from lapsegrid import workload

    df = workload.callables()[name](spark, folder)
    left = canon(df.columns, df.collect())
    sql = workload.sql_texts().get(name)
    if sql is None:
        return name in NO_SQL, "no sql", len(left[1])
    cur = duck.execute(sql)
    right = canon([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} != {right[0]}", len(left[1])
    if left[1] != right[1]:
        extra = [r for r in left[1] if r not in set(right[1])][:3] if len(left[1]) < 400000 else []
        missing = []
        known = set(left[1])
        for r in right[1]:
            if r not in known:
                missing.append(r)
                if len(missing) == 3:
                    break
        bad = len(set(left[1]) - set(right[1]))
        return False, f"rows {len(left[1])} vs {len(right[1])}, {bad} differ\n  {left[0]}\n  spark {extra}\n  duck  {missing}", len(left[1])
    return True, "ok", len(left[1])


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"{DATA}/sf{sf}"
    from lapsegrid import workload

    spark, duck = make_spark(), make_duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    names = []
    for want in argv or ["*"]:
        import fnmatch

        names += [n for n in workload.callables() if fnmatch.fnmatch(n, want) and n not in names]
        if want.startswith("@"):
            names += [
                n
                for n, e in workload.registry.ENTRIES.items()
                if e.build.__module__.endswith("." + want[1:]) and n not in names
            ]
    failed = []
    for name in names:
        start = time.time()
        try:
            ok, message, rows = compare(spark, duck, folder, name)
        except Exception as error:  # noqa: BLE001 - the report names it
            ok, message, rows = False, f"{type(error).__name__}: {str(error)[:700]}", -1
        print(f"{'PASS' if ok else 'FAIL'} {name} rows={rows} {time.time() - start:.1f}s {message if message != 'ok' else ''}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
