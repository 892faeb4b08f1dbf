import pytest

from tarnlake.operators.statistics import ColumnStatistics
from tarnlake.plans.analyzer import analyze
from tarnlake.plans.estimate import Estimator, q_error
from tarnlake.plans.explain import dialect_plan
from tarnlake.plans.parser import parse

SCHEMAS = {"laps": [("season", "INT"), ("speed", "DOUBLE"), ("team", "STRING"), ("driver_id", "INT")], "drivers": [("driver_id", "INT"), ("team", "STRING")]}
LAPS = (1000, {"season": ColumnStatistics(2020, 2024, 5, 0, 8), "speed": ColumnStatistics(200.0, 400.0, 900, 100, 8), "team": ColumnStatistics("A", "Z", 10, 0, 5), "driver_id": ColumnStatistics(1, 20, 20, 0, 8)})
DRIVERS = (20, {"driver_id": ColumnStatistics(1, 20, 20, 0, 8), "team": ColumnStatistics("A", "Z", 10, 0, 5)})


def estimate(sql, tables=(LAPS, DRIVERS)):
    bound = analyze(parse(sql), SCHEMAS.get)
    return Estimator(bound, list(tables[: len(bound.relations)])).run()


@pytest.mark.parametrize(
    ("where", "rows"),
    [
        ("season = 2021", 200), ("season = 1999", 1), ("season != 2021", 800), ("speed > 300", 500), ("300 < speed", 500), ("speed < 100", 1), ("speed >= 400", 1000 / 900), ("team LIKE 'a%'", 500), ("season IN (2020, 2021, 2021, 3)", 400),
        ("season NOT IN (2020)", 800), ("season = 2021 AND speed > 300", 100), ("season = 2021 OR speed > 300", 600), ("team = 'B'", 100), ("team < 'a'", 1000), ("team > 'a'", 1), ("season BETWEEN 2021 AND 2023", 1000 * 0.75 * 0.75), ("speed IS NULL", 100), ("speed IS NOT NULL", 900), ("season IS NULL", 1),
    ],
)
def test_filters(where, rows):
    assert estimate(f"SELECT speed FROM laps WHERE {where}").filter == pytest.approx(rows)


def test_other_operators():
    assert estimate("SELECT COUNT(*) FROM laps GROUP BY season, team").aggregate == 50
    assert estimate("SELECT COUNT(*) FROM laps WHERE season = 2020 GROUP BY speed").aggregate == 200
    found = estimate("SELECT COUNT(*) FROM laps l JOIN drivers d ON l.driver_id = d.driver_id GROUP BY l.team HAVING COUNT(*) > 3 LIMIT 2")
    assert (found.scans, found.join, found.aggregate, found.having, found.result) == ((1000, 20), 1000, 10, 5, 2)
    assert estimate("SELECT speed FROM laps", (None,)).result == 1000
    assert q_error(50, 200) == q_error(200, 50) == 4 and q_error(0.2, 0) == 1


def test_plan_shows_estimates():
    bound = analyze(parse("SELECT team, COUNT(*) FROM laps WHERE season = 2021 GROUP BY team"), SCHEMAS.get)
    text = dialect_plan(bound, Estimator(bound, [LAPS]).run())
    assert "Filter((season = 2021))  est=200" in text and "est=1000" in text and "est=10" in text
