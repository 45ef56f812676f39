"""Quantities recorded in different units: every figure in its common unit.

A multi-pattern automaton finds unit and currency aliases in the unit columns and in free text, the longest match
wins, and the field context (power use of a kind of equipment, or cost) decides between readings. What it finds are
small keys; the conversion factors and the cost rates are tables that are broadcast and joined (the factors are built here; the rates are
counted first). Currencies are those with names here and all that have a rate. The only shuffle is one small pre-aggregated median for each kind of equipment.

Defined results
    rows without an id are left out; no figure, no known kind of equipment or no unit told anywhere: ``value`` is null and the row is no case;
    a unit column wins over text; in text the figure is the number right before the unit;
    NaN figures count as missing; repeated rows give rows each; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import small

# Common unit of power use by kind of energy.
COMMON_POWER = {"E": "kWh/day", "EK": "kWh/day", "EG": "kWh/day", "S": "kW", "I": "liters/charge", "KE": "liters/day", "GE": "Kg/day"}
#: dimension of each common unit
POWER_DIMENSION = {"kWh/day": "energy_rate", "kW": "power", "liters/charge": "volume_fill", "liters/day": "volume_rate", "Kg/day": "mass_rate"}

# Units as (dimension, factor to the base unit, spellings in lower case).
ENERGY = [
    (1e-3, "wh", "w h", "watt hour", "watt hours", "watthours", "watt-hours"),
    (1.0, "kwh", "kw h", "kw-h", "kilowatt hour", "kilowatt hours", "kilowatthours", "kilowatt-hours", "units"),
    (1e3, "mwh", "megawatt hour", "megawatt hours"),
    (1 / 3600, "kj", "kilojoule", "kilojoules"),
    (1 / 3.6, "mj", "megajoule", "megajoules"),
    (1e3 / 3.6, "gj", "gigajoule", "gigajoules"),
]
POWER = [
    (1e-3, "w", "watt", "watts"),
    (1.0, "kw", "kilowatt", "kilowatts", "mw x 1e-3", "mw x1e-3"),
    (1e3, "mw", "megawatt", "megawatts"),
    (0.74569987, "hp", "horsepower", "horse power"),
]
VOLUME = [
    (1.0, "l", "liter", "liters", "litre", "litres", "ltr", "ltrs", "lit"),
    (1e-3, "ml", "milliliter", "milliliters", "millilitre", "millilitres", "cc"),
    (1e-2, "cl", "centiliter", "centiliters", "centilitre", "centilitres"),
    (1e-1, "dl", "deciliter", "deciliters", "decilitre", "decilitres"),
    (1e3, "m3", "cubic meters", "cubic metres"),
    (3.785411784, "us gal", "us gallon", "us gallons", "gal", "gallon", "gallons"),
    (4.54609, "imp gal", "imperial gallon", "imperial gallons", "uk gal"),
    (0.473176473, "us pint", "us pints"),
]
MASS = [
    (1.0, "kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"),
    (1e-3, "g", "gr", "gram", "grams", "gramme", "grammes"),
    (1e3, "t", "tonne", "tonnes"),
    (0.45359237, "lb", "lbs", "pound", "pounds"),
    (0.028349523125, "oz", "ounce", "ounces"),
]
PERIOD = [
    (1.0, "day", "d", "24h", "24 h", "24 hours", "24hrs"),
    (1 / 24, "hour", "h", "hr"),
    (7.0, "week", "wk"),
    (365.0 / 12, "month"),
    (365.0, "year", "yr", "annum"),
]
ADVERB = [(1.0, "daily"), (1 / 24, "hourly"), (7.0, "weekly"), (365.0 / 12, "monthly"), (365.0, "yearly", "annually", "p.a.", "p.a", "pa")]
FILL = [(1.0, "charge", "filling", "fill", "refill")]
CURRENCY = {
    "EUR": ("eur", "euro", "euros", "€"),
    "USD": ("usd", "us$", "us dollar", "us dollars", "dollar us", "dollars us", "u.s. dollars", "$", "dollar", "dollars"),
    "GBP": ("gbp", "£", "stg", "uk pound", "uk pounds", "pound sterling", "pounds sterling", "sterling", "pound", "pounds", "ukp"),
    "SEK": ("sek", "sec", "kr", "skr", "swedish krona", "swedish kronor", "swedish crown", "swedish crowns", "kronor", "krona", "crowns"),
}
#: more currencies are an error; up to so many rates are broadcast, more are joined by a shuffle
MOST_CODES, MOST_RATES = 1000, 200_000
#: hours in a day turn a steady power into energy a day
DAY_HOURS = 24.0


def _spellings(unit: str) -> Iterator[tuple[str, float]]:
    """Ways to write "unit per period" and their factor, from the tables above."""
    for factor, *names in PERIOD:
        for p in names:
            for sep in ("/", " per ", " a ", " each ", " every ", "-", " "):
                yield f"{unit}{sep}{p}", factor
    for factor, *names in ADVERB:
        for p in names:
            yield f"{unit} {p}", factor


def unit_aliases() -> list[tuple[str, str, float]]:
    """(alias, dimension, factor to that dimension's base unit)."""
    out: dict[tuple[str, str], float] = {}
    for table, rate in ((ENERGY, "energy_rate"), (VOLUME, "volume_rate"), (MASS, "mass_rate")):
        for factor, *names in table:
            for n in names:
                for alias, period in _spellings(n):
                    out.setdefault((alias, rate), factor / period)
    for factor, *names in VOLUME:
        for n in names:
            for _, *fills in FILL:
                for f in fills:
                    for sep in ("/", " per ", " a ", " each ", " "):
                        out.setdefault((f"{n}{sep}{f}", "volume_fill"), factor)
    for factor, *names in POWER:
        for n in names:
            out.setdefault((n, "power"), factor)
            out.setdefault((n, "energy_rate"), factor * DAY_HOURS)
    return [(a, d, f) for (a, d), f in out.items()]


def currency_aliases(codes: tuple[str, ...] = ()) -> list[tuple[str, str, float]]:
    """(alias, code, single units of the currency in one unit of the alias); ``codes`` beside the known ones stand for themselves."""
    out: dict[str, tuple[str, float]] = {}
    for code, names in {**CURRENCY, **{c: (c.lower(),) for c in codes if c not in CURRENCY}}.items():
        for n in names:
            out.setdefault(n, (code, 1.0))
            for scaled, factor in ((f"k{n}", 1e3), (f"{n} x1000", 1e3), (f"{n} x 1000", 1e3), (f"'000 {n}", 1e3), (f"000 {n}", 1e3), (f"thousand {n}", 1e3), (f"{n} thousand", 1e3), (f"m{n}", 1e6), (f"{n} cent", 1e-2), (f"{n} cents", 1e-2), (f"{n} pence", 1e-2), (f"{n} ore", 1e-2)):
                out.setdefault(scaled, (code, factor))
    return [(a, c, f) for a, (c, f) in out.items()]


_SPACES = re.compile(r"\s+")
_SLASH = re.compile(r" ?/ ?")


def normal(text: str) -> str:
    return _SLASH.sub("/", _SPACES.sub(" ", text.replace("–", " – "))).strip().lower()


@lru_cache(maxsize=4)
def _automaton(codes: tuple[str, ...] = ()) -> ahocorasick.Automaton:
    """All aliases; a key's value lists its readings as (dimension or 'cost', key, length)."""
    found: dict[str, list] = {}
    for alias, dimension, _ in unit_aliases():
        found.setdefault(alias, []).append((dimension, alias))
    for alias, code, _ in currency_aliases(codes):
        found.setdefault(alias, []).append(("cost", alias))
    a = ahocorasick.Automaton()
    for alias, readings in found.items():
        a.add_word(alias, (alias, tuple(readings)))
    a.make_automaton()
    return a


def _edge(text: str, i: int, c: str) -> bool:
    """Whether an alias that ends in c may end beside text[i]."""
    return not (0 <= i < len(text)) or not (c.isalpha() and text[i].isalpha() or c.isdigit() and (text[i].isalnum() or text[i] in ".,"))


@lru_cache(maxsize=200_000)
def matches(text: str, codes: tuple[str, ...] = ()) -> tuple[tuple[int, int, tuple], ...]:
    """(start, end, readings) of the aliases in a normalised text; of overlapping ones the longest, then the first."""
    got = []
    for last, (alias, readings) in _automaton(codes).iter(text):
        start = last - len(alias) + 1
        if _edge(text, start - 1, alias[0]) and _edge(text, last + 1, alias[-1]):
            got.append((start, last + 1, readings))
    got.sort(key=lambda m: (m[0] - m[1], m[0]))
    kept: list = []
    for m in got:
        if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
            kept.append(m)
    return tuple(sorted(kept))


_NUMBER = re.compile(r"(?<![\w.,])[+-]?\d+(?:[.,]\d+)*(?:e[+-]?\d+)?(?=[^\w]|$|[a-z€£$])")
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")


def number(text: str, whole: bool) -> float | None:
    """A figure as people write it; ``whole``: a single comma groups thousands, otherwise it is the decimal comma."""
    t = text
    if t.count(".") and t.count(","):
        dec = max(t.rfind("."), t.rfind(","))
        t = t[:dec].replace(",", "").replace(".", "") + "." + t[dec + 1 :]
    elif t.count(",") > 1 or t.count(".") > 1 or (whole and re.fullmatch(r"[+-]?\d{1,3}[.,]\d{3}", t)):
        t = t.replace(",", "").replace(".", "")
    else:
        t = t.replace(",", ".")
    try:
        return float(t)
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def read_power(text: str | None, dimension: str) -> tuple[str | None, float | None]:
    """(alias, figure before it) of the first power unit of this dimension in a text."""
    if not text:
        return None, None
    t = normal(text)
    for start, _, readings in matches(t):
        for kind, alias in readings:
            if kind == dimension:
                before = [m for m in _NUMBER.finditer(t, 0, start + 1) if m.end() <= start]
                figure = number(before[-1].group(), False) if before and not t[before[-1].end() : start].strip() else None
                # a single letter is a unit only beside a figure
                if len(alias) > 1 or figure is not None:
                    return alias, figure
    return None, None


@lru_cache(maxsize=200_000)
def read_power_unit(text: str | None, dimension: str) -> str | None:
    """The alias that a unit column holds: its longest match of this dimension."""
    if not text:
        return None
    t = normal(text)
    got = [(e - s, a) for s, e, readings in matches(t) for kind, a in readings if kind == dimension]
    return max(got)[1] if got else None


@lru_cache(maxsize=200_000)
def read_currency_unit(text: str | None, codes: tuple[str, ...] = ()) -> str | None:
    if not text:
        return None
    t = normal(text)
    got = [(e - s, a) for s, e, readings in matches(t, codes) for kind, a in readings if kind == "cost"]
    return max(got)[1] if got else None


@lru_cache(maxsize=200_000)
def read_cost(text: str | None, codes: tuple[str, ...] = ()) -> tuple[str | None, float | None, int | None]:
    """(alias, amount before it, year) of the first cost in a text: a currency with a year after it, or before it."""
    if not text:
        return None, None, None
    t = normal(text)
    for start, end, readings in matches(t, codes):
        for kind, alias in readings:
            if kind != "cost":
                continue
            before = [m for m in _NUMBER.finditer(t, 0, start + 1) if m.end() <= start]
            amount = number(before[-1].group(), True) if before and not t[before[-1].end() : start].strip() else None
            after = _YEAR.search(t, end)
            if after:
                return alias, amount, int(after.group())
            years = [m for m in _YEAR.finditer(t, 0, start) if amount is None or m.start() < before[-1].start()]
            if years:
                return alias, amount, int(years[-1].group())
    return None, None, None


def full_year(year: int | None) -> int | None:
    """A four-digit year from one written short."""
    if year is None or year < 0:
        return None
    return year if year >= 1000 else (2000 + year if year < 70 else 1900 + year if year < 100 else None)


READ = """row_id bigint, Energy string, p_figure double, p_alias string, p_text_figure double, p_text_alias string, p_unit string,
c_figure double, c_alias string, c_text_amount double, c_text_alias string, c_year int, c_text_year int, c_unit string, c_year_raw int"""


def _clean(v: object) -> object:
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def _read_batches(batches: Iterator[pd.DataFrame], codes: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ.replace("\n", " ").split(", ")]
    for pdf in batches:
        out = []
        for row_id, energy, power, unit, cost, cur, year, notes in pdf.itertuples(index=False, name=None):
            power, cost, year = _clean(power), _clean(cost), _clean(year)
            unit, cur, notes = (_clean(x) for x in (unit, cur, notes))
            dimension = POWER_DIMENSION.get(COMMON_POWER.get(_clean(energy) or "", ""), "")
            alias, (text_alias, text_figure) = read_power_unit(unit, dimension), read_power(notes, dimension)
            c_alias, (ct_alias, ct_amount, ct_year) = read_currency_unit(cur, codes), read_cost(notes, codes)
            out.append((row_id, energy, power, alias, text_figure, text_alias, unit, cost, c_alias, ct_amount, ct_alias, full_year(None if year is None else int(year)), ct_year, cur, None if year is None else int(year)))
        got = pd.DataFrame(out, columns=names)
        yield got.astype({"p_figure": "float64", "p_text_figure": "float64", "c_figure": "float64", "c_text_amount": "float64", "c_year": "Int32", "c_text_year": "Int32", "c_year_raw": "Int32"})


def read_figures(rows: DataFrame, codes: tuple[str, ...] = ()) -> DataFrame:
    """The aliases, figures and years that each row tells, before any conversion."""
    src = rows.select(
        F.col("row_id").cast("bigint").alias("row_id"), "Energy", F.col("PowerRate").cast("double"), "PowerRateUnits",
        F.col("BaseCost").cast("double"), "BaseCostCur", F.col("BaseCostYear").cast("int"), "Notes",
    )
    got = src.filter("row_id IS NOT NULL").mapInPandas(partial(_read_batches, codes=codes), READ)
    return got.select([F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def _lit_map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


#: a figure this many times the median of its kind of equipment is in units a thousand times smaller (root of 1000)
SCALE_STEP = 1000.0**0.5


def normalize(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """One row for each figure: (row_id, field_name, figure, told_by, common_unit, value, eur_2014, is_case).

    ``told_by``: 'column', 'text' or 'scale'; ``value`` is the figure in its common unit.
    """
    spark = rows.sparkSession
    # the rates' currencies are known to the automaton by their codes
    codes = tuple(sorted(r[0] for r in rates.filter("cur_code IS NOT NULL").select("cur_code").distinct().limit(MOST_CODES + 1).collect()))
    if len(codes) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} currencies")
    read = read_figures(rows, codes).withColumn("common", _lit_map(COMMON_POWER, F.coalesce("Energy", F.lit("")))).withColumn("dim", _lit_map(POWER_DIMENSION, F.col("common")))
    factors = F.broadcast(spark.createDataFrame(unit_aliases(), "alias string, dimension string, factor double"))  # a few thousand rows, built above
    currencies = F.broadcast(spark.createDataFrame(currency_aliases(codes), "c_key string, code string, c_factor double"))

    # one row for each currency and year; of differing rates the lower counts
    known = rates.filter("cur_code IS NOT NULL AND cost_year IS NOT NULL").groupBy(F.col("cur_code").alias("code"), F.col("cost_year").cast("int").alias("cost_year")).agg(F.min("eur_2014").alias("rate"))
    known = small(known, MOST_RATES)

    # what all such equipment uses: median of the figures stated in the common unit itself
    usual = (
        rows.select("Energy", F.col("PowerRate").cast("double").alias("x"), "PowerRateUnits").withColumn("common", _lit_map(COMMON_POWER, F.coalesce("Energy", F.lit(""))))
        .filter("common IS NOT NULL AND PowerRateUnits = common AND x > 0 AND NOT isnan(x)")
        .groupBy("common").agg(F.percentile_approx("x", 0.5, 1000).alias("usual"))
    )  # fmt: skip  # at most one row for each common unit

    # one pass: both figures of a row are looked up side by side, then split into rows
    p, c = F.col("p_figure").isNotNull(), F.col("c_figure").isNotNull()
    row = (
        read.withColumns({
            "figure_p": F.when(F.col("common").isNotNull(), F.coalesce("p_figure", "p_text_figure")),
            "figure_c": F.coalesce("c_figure", "c_text_amount"),
            "alias": F.when(p, F.coalesce("p_alias", "p_text_alias")).otherwise(F.col("p_text_alias")),
            "c_key": F.when(c, F.coalesce("c_alias", "c_text_alias")).otherwise(F.col("c_text_alias")),
            "cost_year": F.when(c, F.coalesce("c_year", "c_text_year")).otherwise(F.col("c_text_year")),
        })
        .filter("figure_p IS NOT NULL OR figure_c IS NOT NULL")
        .join(factors.withColumnRenamed("dimension", "dim"), ["alias", "dim"], "left")
        .join(F.broadcast(usual), "common", "left")
        .join(currencies, "c_key", "left")
        .join(known, ["code", "cost_year"], "left")
        .withColumn("cost_unit", F.when(F.col("rate").isNotNull(), F.concat_ws(" ", "code", F.col("cost_year").cast("string"))))
        .withColumn("exact_p", F.col("p_unit").eqNullSafe(F.col("common")) & p)
        .withColumn("exact_c", F.col("c_unit").eqNullSafe(F.col("code")) & F.col("c_year_raw").eqNullSafe(F.col("cost_year")) & c)
        .withColumn("scaled", F.coalesce(F.col("exact_p") & (F.col("figure_p") > F.col("usual") * SCALE_STEP), F.lit(False)))
    )
    told = F.col("alias").isNotNull()
    power = F.struct(
        F.lit("PowerRate").alias("field_name"), F.col("figure_p").alias("figure"),
        F.when(F.col("scaled"), "scale").when(F.col("p_alias").isNotNull() & p, "column").when(told, "text").alias("told_by"),
        F.when(told, F.col("common")).alias("common_unit"),
        F.when(F.col("scaled"), F.col("figure_p") / 1000).otherwise(F.col("figure_p") * F.col("factor")).alias("value"),
        F.lit(None).cast("double").alias("eur_2014"), (told & (~F.col("exact_p") | F.col("scaled"))).alias("is_case"),
    )
    amount = F.col("figure_c") * F.col("c_factor")
    cost = F.struct(
        F.lit("BaseCost").alias("field_name"), F.col("figure_c").alias("figure"),
        F.when(F.col("c_alias").isNotNull() & c, "column").when(F.col("c_key").isNotNull(), "text").alias("told_by"), F.col("cost_unit").alias("common_unit"),
        amount.alias("value"), (amount * F.col("rate")).alias("eur_2014"), (F.col("cost_unit").isNotNull() & ~F.col("exact_c")).alias("is_case"),
    )
    return row.select("row_id", F.explode(F.array(power, cost)).alias("f")).select("row_id", "f.*").filter("figure IS NOT NULL")


def misrecorded(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """(row_id, field_name, common_unit) of the figures not recorded in their common unit whose unit the row tells."""
    return normalize(rows, rates).filter("is_case").select("row_id", "field_name", "common_unit")
