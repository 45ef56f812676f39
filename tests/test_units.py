import datetime  # noqa: F401

import pytest
from conftest import rows

from tundra.operators import units as U

SCHEMA = "row_id bigint, Energy string, PowerRate double, PowerRateUnits string, BaseCost double, BaseCostCur string, BaseCostYear int, Notes string, common string, alias string"
RATES = [("EUR", 2009, 1.1), ("SEK", 2009, 0.1), ("EUR", 2000, 1.3), ("GBP", 2010, 1.2)]


def found(spark, data):
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    rates = spark.createDataFrame(RATES, "cur_code string, cost_year int, eur_2014 double")
    return {(r.row_id, r.field_name): r for r in U.normalize(df, rates).collect()}


def test_cases(spark):
    base = [(i, "E", 2.0 + i / 100, "kWh/day", None, None, None, None) for i in range(50)]
    got = found(spark, [
        *base,
        (100, "E", 2000.0, "Wh/24 h", None, None, None, None),
        (101, "E", 1900.0, "kWh/day", None, None, None, None),
        (102, "E", None, None, None, None, None, "uses about 0,802 kWh a day"),
        (103, "GE", 1.5, None, None, None, None, "power rate is in pounds per day"),
        (104, "U", 3.0, None, 5.0, "SEC", 9, "not in the 2013 list"),
        (105, "E", 2.0, None, None, None, None, "holdover copied"),
        (106, None, None, None, 2.5, "kEUR", 2009, None),
        (107, "E", float("nan"), "kWh/day", None, None, None, "not in the 2013 list; unit cost 2,000 € – 2000 prices"),
        (108, "E", None, None, 7.0, "EUR", 2009, "price in GBP of 2010"),
        (109, "E", None, None, 7.0, None, None, "price in GBP of 1984"),
        (110, "S", 1.0, "hp", None, None, None, None),
        (111, "E", 100.0, "W", None, None, None, None),
        (None, "E", 100.0, "W", 1.0, "kEUR", 9, None),
    ])
    assert got[100, "PowerRate"].is_case and got[100, "PowerRate"].value == pytest.approx(2.0)
    assert got[101, "PowerRate"].told_by == "scale" and got[101, "PowerRate"].value == pytest.approx(1.9)
    assert got[102, "PowerRate"].figure == pytest.approx(0.802) and got[102, "PowerRate"].is_case
    assert got[103, "PowerRate"].value == pytest.approx(1.5 * 0.45359237)
    assert got[104, "BaseCost"].common_unit == "SEK 2009" and got[104, "BaseCost"].eur_2014 == pytest.approx(0.5)
    assert (104, "PowerRate") not in got
    assert not got[105, "PowerRate"].is_case and got[105, "PowerRate"].common_unit is None
    assert got[106, "BaseCost"].value == pytest.approx(2500)
    assert got[107, "BaseCost"].figure == 2000 and (107, "PowerRate") not in got
    assert not got[108, "BaseCost"].is_case
    assert not got[109, "BaseCost"].is_case  # no rate for that year
    assert got[110, "PowerRate"].value == pytest.approx(0.74569987)
    assert got[111, "PowerRate"].value == pytest.approx(2.4)
    assert not any(got[i, "PowerRate"].is_case for i in range(50))


def test_empty_and_repeated(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(1, "S", 80.0, "W", None, None, None, None, "", "")] * 2, SCHEMA)
    rates = spark.createDataFrame(RATES, "cur_code string, cost_year int, eur_2014 double")
    assert rows(U.misrecorded(df, rates)) == [(1, "PowerRate", "kW")] * 2


def test_longest_match_and_numbers():
    assert U.read_power("draws 6,023 kilowatt hours per 24 h when full", "energy_rate") == ("kilowatt hours per 24 h", 6.023)
    assert U.read_power("x" * 100_000 + " uses 5 watts", "power") == ("watts", 5.0)
    assert U.read_cost("offer of 3,529 US dollars, year 2000") == ("us dollars", 3529.0, 2000)
    assert U.read_cost("not in the 2013 list – cost base: EUR (2010)") == ("eur", None, 2010)
    assert U.read_cost(None) == (None, None, None) and U.read_power("", "power") == (None, None)
    assert [U.full_year(y) for y in (0, 9, 99, 2009, None, 300)] == [2000, 2009, 1999, 2009, None, None]


def test_currencies_and_years_of_the_rates(spark):
    """Any currency and year that has a rate counts; repeated and differing rates give one row."""
    df = spark.createDataFrame([(1, "E", None, None, 5.0, "kCHF", 1871, None, "x", "y"), (2, "E", None, None, None, None, None, "paid 70 chf in 2014", "x", "y"), (3, "E", None, None, 5.0, "NOK", 2014, None, "x", "y")], SCHEMA)
    rates = spark.createDataFrame([("CHF", 1871, 3.0), ("CHF", 1871, 2.0), ("CHF", 1871, 2.0), ("CHF", 2014, 0.8), (None, 2014, 1.0), ("CHF", None, 1.0)], "cur_code string, cost_year int, eur_2014 double")
    got = {r.row_id: (r.common_unit, r.value, r.eur_2014) for r in U.normalize(df, rates).filter("field_name = 'BaseCost'").collect()}
    assert got == {1: ("CHF 1871", 5000.0, 10000.0), 2: ("CHF 2014", 70.0, 56.0), 3: (None, None, None)}
