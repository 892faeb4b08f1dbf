import json

import pytest

from tarnlake.cli import main, table_lines
from tarnlake.engine import Engine
from tarnlake.errors import SourceError
from tarnlake.operators.statistics import statistics_frame, storage_bytes, table_statistics
from tarnlake.sources.catalog import Catalog, read_csv
from tarnlake.sources.generator import drivers, laps

COLUMNS = [("lap_id", "INT"), ("team", "STRING"), ("speed", "DOUBLE")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "laps.csv").write_text('lap_id,team,speed\n1,Ferrari,312.45\n\n2,,300\n3,"q",1.5\n')
    tables = [{"name": "laps", "file": "laps.csv", "columns": [{"name": n, "type": k} for n, k in COLUMNS]}]
    (tmp_path / "catalog.json").write_text(json.dumps({"tables": tables}))
    return tmp_path


def test_csv(spark, folder):
    got = [tuple(r) for r in Catalog.of_json(spark, str(folder / "catalog.json")).table("laps").collect()]
    assert got == [(1, "Ferrari", 312.45), (2, "", 300.0), (3, '"q"', 1.5)]


@pytest.mark.parametrize("line", ["1,Ferrari", "1,Ferrari,2.0,3", "12abc,x,1.0", "3.7,x,1.0", ",x,1.0", "1,x,"])
def test_bad_csv_rows(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(f"lap_id,team,speed\n1,a,1.0\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|not a number"):
        read_csv(spark, str(tmp_path / "bad.csv"), COLUMNS).collect()


def test_catalog_errors(spark, tmp_path, folder):
    with pytest.raises(SourceError, match="cannot open the catalog"):
        Catalog.of_json(spark, str(tmp_path / "nope.json"))
    with pytest.raises(SourceError, match="cannot open"):
        read_csv(spark, str(tmp_path / "nope.csv"), COLUMNS)
    bad = json.loads((folder / "catalog.json").read_text().replace("DOUBLE", "DECIMAL"))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(SourceError, match="unknown type DECIMAL"):
        Catalog.of_json(spark, str(tmp_path / "bad.json"))


def test_cli(spark, folder, capsys):
    base = ["--catalog", str(folder / "catalog.json")]
    assert main([*base, "--query", "SELECT team, speed / 0 AS z FROM laps WHERE lap_id < 3 ORDER BY lap_id"], spark) == 0
    assert capsys.readouterr().out == "team    | z\n--------+-----\nFerrari | NULL\n        | NULL\n(2 rows)\n"
    assert main([*base, "--query", "SELECT COUNT(*) FROM laps", "--explain", "--no-optimize"], spark) == 0 and "Physical plan" in capsys.readouterr().out
    assert main([*base, "--query", "SELECT COUNT(*) FROM laps", "--explain-analyze", "--storage", "columnar", "--execution", "vectorized"], spark) == 0 and "rows_out" in capsys.readouterr().out
    assert main([*base, "--storage-stats"], spark) == 0 and "laps:" in capsys.readouterr().out
    assert main([*base, "--query", "SELECT nope FROM laps", "--no-cache", "--odd"], spark) == 1 and "not found" in (e := capsys.readouterr().err) and "unknown argument --odd" in e
    assert main(base, spark) == 1 and main([*base, "--query", "x", "--execution", "vectorized"], spark) == 1


def test_cli_runs_a_file(spark, folder, capsys):
    (folder / "q.sql").write_text("SELECT COUNT(*) AS n FROM laps;\n SELECT nope FROM laps ;\nSELECT SUM(9223372036854775807 + lap_id) FROM laps;")
    base = ["--catalog", str(folder / "catalog.json")]
    assert main([*base, "--queries", str(folder / "q.sql")], spark) == 1
    out = capsys.readouterr().out
    assert "[2/3] SELECT nope FROM laps\nerror: " in out and "n\n-\n3\n(1 rows)" in out and out.endswith("ok, 2 failed\n" if "[3/3]" in out and "OVERFLOW" in out else "ok, 1 failed\n")
    (folder / "q.sql").write_text("SELECT COUNT(*) AS n FROM laps")
    assert main([*base, "--queries", str(folder / "q.sql"), "--explain"], spark) == 0 and "est=3" in capsys.readouterr().out
    assert main([*base, "--queries", "nowhere.sql"], spark) == 1 and "cannot open" in capsys.readouterr().err


def test_format():
    assert "\n".join(table_lines(["a", "b"], [(1, 0.1 + 0.2), (None, "x")])) == "a    | b\n-----+----\n1    | 0.3\nNULL | x\n(2 rows)"
    many = list(table_lines(["a"], ((i,) for i in range(5000))))
    assert len(many) == 5003 and many[-2:] == ["4999", "(5000 rows)"] and list(table_lines(["a"], [])) == ["a", "-", "(0 rows)"]


def test_dates_and_times(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, DATE '1996-01-31', TIMESTAMP '1996-01-31 00:00:00', TIMESTAMP_NTZ '1996-01-31 12:30:00.5'), (2, DATE '1996-02-01', TIMESTAMP '1996-02-01 07:00:00', NULL), (3, NULL, NULL, TIMESTAMP_NTZ '1996-02-01 00:00:00') AS t(i, d, t, z)")
    cat = Catalog(spark)
    cat.add("days", rows)
    cat.add("cut", rows, days=["t", "z"])
    eng = Engine(cat)
    assert [tuple(r) for r in eng.sql("SELECT d, t, z FROM cut WHERE i = 1").collect()] == [("1996-01-31",) * 3]
    assert [tuple(r) for r in eng.sql("SELECT d, t, z FROM days WHERE i = 1").collect()] == [("1996-01-31", "1996-01-31 00:00:00", "1996-01-31 12:30:00.5")]
    assert eng.sql("SELECT * FROM days").columns == ["i", "d", "t", "z"]
    plain = {"d": lambda r: r[1], "t": lambda r: r[2], "z": lambda r: r[3]}
    compare = {"=": str.__eq__, "!=": str.__ne__, "<": str.__lt__, ">": str.__gt__, "<=": str.__le__, ">=": str.__ge__}
    parts = [(c, op, day) for c in plain for op in compare for day in ("1996-01-31", "1996-02-01", "1996-02-30", "1996-01-31 12")]
    for name in ("days", "cut"):
        table = [tuple(r) for r in eng.sql(f"SELECT i, d, t, z FROM {name} ORDER BY i").collect()]
        got = eng.sql(f"SELECT {', '.join(f'{c} {op} {chr(39)}{day}{chr(39)} AS p{k}' for k, (c, op, day) in enumerate(parts))} FROM {name} ORDER BY i").collect()
        for k, (c, op, day) in enumerate(parts):
            assert [r[k] for r in got] == [None if (x := plain[c](r)) is None else int(compare[op](x, day)) for r in table], (name, c, op, day)
    assert [r[0] for r in eng.sql("SELECT i FROM days WHERE DATE '1996-01-31' < d").collect()] == [2]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "aa", 1.5), (2, None, 1.5), (2, "b", None)], "i long, s string, d double")
    n, found = table_statistics(df)
    assert n == 3 and (found["s"].distinct, found["s"].nulls, found["s"].width) == (2, 1, 1.5) and (found["i"].least, found["i"].most) == (1, 2)
    rows = {r["column_name"]: r for r in statistics_frame(df, exact=False).collect()}
    assert rows["d"]["null_count"] == 1 and rows["i"]["ndv"] == 2 and rows["s"]["max_value"] == "b"
    assert table_statistics(df.limit(0))[0] == 0 and storage_bytes(df) > 0


def test_statistics_of_a_small_file_with_many_rows(spark, tmp_path):
    """One task reads the file, but none holds all of its rows."""
    n, folder = 600_000, str(tmp_path / "t")
    spark.range(0, n, 1, 1).selectExpr("id AS i", "nullif(concat('name ', id % 1000), 'name 7') AS s", "id % 50 AS k", "id % 3 / 2D AS d").write.parquet(folder)
    store = spark._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(folder, "")
    rows = {r["column_name"]: tuple(r)[1:] for r in statistics_frame(spark.read.parquet(folder)).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    tasks = [store.taskList(s, 0, 10_000) for j in tracker.getJobIdsForGroup(folder) for s in tracker.getJobInfo(j).stageIds]
    held = [t.apply(i).taskMetrics().get().peakExecutionMemory() for t in tasks for i in range(t.size())]
    assert rows["i"] == (n, "0", str(n - 1), n, 0, 8.0) and rows["k"] == (n, "0", "49", 50, 0, 8.0) and rows["d"] == (n, "0.0", "1.0", 3, 0, 8.0)
    assert rows["s"] == (n, "name 0", "name 999", 999, n // 1000, pytest.approx((9 * 6 + 90 * 7 + 900 * 8) / 999))
    assert held and max(held) < 150e6


def test_generator(spark):
    cat = Catalog(spark)
    cat.add("laps", laps(spark, 500, seed=3))
    cat.add("drivers", drivers(spark))
    eng = Engine(cat)
    (r,) = eng.sql("SELECT COUNT(*), MIN(speed) >= 280, MAX(speed) <= 345, MIN(season), MAX(season), MAX(round) FROM laps").collect()
    assert tuple(r) == (500, 1, 1, 2022, 2025, 24)
    assert eng.sql("SELECT COUNT(*) FROM laps l JOIN drivers d ON l.driver_id = d.driver_id WHERE l.team = d.team").first()[0] == 500
    assert laps(spark, 500, seed=3).collect() == laps(spark, 500, seed=3).collect()
