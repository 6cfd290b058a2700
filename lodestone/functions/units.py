"""Unit conversion as a join with a small table of factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Factors from one unit to another.
LENGTH = (("m", "ft", 3.28084), ("ft", "m", 0.3048), ("m", "in", 39.3701), ("in", "m", 0.0254), ("km", "mi", 0.621371), ("mi", "km", 1.60934), ("mm", "in", 0.0393701), ("in", "mm", 25.4), ("cm", "in", 0.393701), ("in", "cm", 2.54), ("m", "mm", 1000.0), ("mm", "m", 0.001), ("m", "cm", 100.0), ("cm", "m", 0.01))
VOLUME = (("m3", "l", 1000.0), ("l", "m3", 0.001), ("m3", "gal", 264.172), ("gal", "m3", 0.00378541), ("l", "gal", 0.264172), ("gal", "l", 3.78541), ("m3", "ft3", 35.3147), ("ft3", "m3", 0.0283168))
PRESSURE = (("psi", "kpa", 6.89476), ("kpa", "psi", 0.145038), ("bar", "psi", 14.5038), ("psi", "bar", 0.0689476), ("mpa", "psi", 145.038), ("psi", "mpa", 0.00689476), ("bar", "kpa", 100.0), ("kpa", "bar", 0.01), ("mpa", "kpa", 1000.0), ("kpa", "mpa", 0.001), ("atm", "kpa", 101.325), ("kpa", "atm", 0.00986923))
MASS = (("kg", "lb", 2.20462), ("lb", "kg", 0.453592), ("tonne", "ton", 1.10231), ("ton", "tonne", 0.907185), ("kg", "ton", 0.00110231), ("ton", "kg", 907.185), ("tonne", "kg", 1000.0), ("kg", "tonne", 0.001))
SPEED = (("m/s", "ft/s", 3.28084), ("ft/s", "m/s", 0.3048), ("km/h", "mph", 0.621371), ("mph", "km/h", 1.60934), ("m/s", "km/h", 3.6), ("km/h", "m/s", 0.277778), ("m/s", "mph", 2.23694), ("mph", "m/s", 0.44704))
AREA = (("m2", "ft2", 10.7639), ("ft2", "m2", 0.092903), ("m2", "acres", 0.000247105), ("acres", "m2", 4046.86), ("ha", "acres", 2.47105), ("acres", "ha", 0.404686), ("km2", "mi2", 0.386102), ("mi2", "km2", 2.58999), ("ha", "m2", 10000.0), ("m2", "ha", 0.0001))
STRESS = (("kpa", "psf", 20.8854), ("psf", "kpa", 0.0478803), ("kpa", "ksf", 0.0208854), ("ksf", "kpa", 47.8803), ("kpa", "tsf", 0.01044), ("tsf", "kpa", 95.76), ("mpa", "ksi", 0.145038), ("ksi", "mpa", 6.89476), ("mpa", "ksf", 20.8854), ("ksf", "mpa", 0.0478803), ("gpa", "ksi", 145.038), ("ksi", "gpa", 0.00689476))
DENSITY = (("kn/m3", "pcf", 6.36587), ("pcf", "kn/m3", 0.157087), ("kg/m3", "pcf", 0.0624279), ("pcf", "kg/m3", 16.0185), ("g/cm3", "pcf", 62.4279), ("pcf", "g/cm3", 0.0160185), ("kn/m3", "kg/m3", 101.972), ("kg/m3", "kn/m3", 0.00980665), ("g/cm3", "kg/m3", 1000.0), ("kg/m3", "g/cm3", 0.001), ("g/cm3", "kn/m3", 9.80665), ("kn/m3", "g/cm3", 0.101972))
PERMEABILITY = (("m/s", "cm/s", 100.0), ("cm/s", "m/s", 0.01), ("m/s", "ft/day", 283465.0), ("ft/day", "m/s", 3.52778e-6), ("cm/s", "ft/min", 1.9685), ("ft/min", "cm/s", 0.508), ("m/s", "ft/min", 196.85), ("ft/min", "m/s", 0.00508), ("m/s", "m/day", 86400.0), ("m/day", "m/s", 1.1574e-5))
FORCE = (("kn", "kip", 0.224809), ("kip", "kn", 4.44822), ("kn", "lbf", 224.809), ("lbf", "kn", 0.00444822), ("mn", "ton", 112.404), ("ton", "mn", 0.00889644), ("kn", "ton", 0.112404), ("ton", "kn", 8.89644), ("n", "lbf", 0.224809), ("lbf", "n", 4.44822), ("kn", "n", 1000.0), ("n", "kn", 0.001))
MOMENT = (("kn-m", "kip-ft", 0.737562), ("kip-ft", "kn-m", 1.35582), ("kn-m", "lb-ft", 737.562), ("lb-ft", "kn-m", 0.00135582), ("n-m", "lb-ft", 0.737562), ("lb-ft", "n-m", 1.35582), ("kn-m", "n-m", 1000.0), ("n-m", "kn-m", 0.001))
THERMAL = (("w/m-k", "btu/hr-ft-f", 0.577789), ("btu/hr-ft-f", "w/m-k", 1.73073), ("w/m-k", "kcal/m-hr-c", 0.859845), ("kcal/m-hr-c", "w/m-k", 1.163), ("j/kg-k", "btu/lb-f", 0.000238846), ("btu/lb-f", "j/kg-k", 4186.8), ("c-days", "f-days", 1.8), ("f-days", "c-days", 0.555556))
FLOW = (("m3/s", "cfs", 35.3147), ("cfs", "m3/s", 0.0283168), ("l/s", "gpm", 15.8503), ("gpm", "l/s", 0.0630902), ("m3/s", "gpm", 15850.3), ("gpm", "m3/s", 6.30902e-5), ("l/s", "cfs", 0.0353147), ("cfs", "l/s", 28.3168), ("m3/s", "l/s", 1000.0), ("l/s", "m3/s", 0.001))
FACTORS = LENGTH + VOLUME + AREA + PRESSURE + STRESS + DENSITY + PERMEABILITY + FORCE + MOMENT + MASS + THERMAL + FLOW + SPEED
# Other spellings.
ALIASES = {"celsius": "c", "fahrenheit": "f", "meter": "m", "meters": "m", "metre": "m", "metres": "m", "foot": "ft", "feet": "ft", "inch": "in", "inches": "in", "kilometer": "km", "kilometers": "km", "mile": "mi", "miles": "mi", "liter": "l", "liters": "l", "gallon": "gal", "gallons": "gal", "kilogram": "kg", "kilograms": "kg", "pound": "lb", "pounds": "lb", "lbs": "lb", "kilopascal": "kpa", "kilopascals": "kpa", "megapascal": "mpa", "megapascals": "mpa", "gigapascal": "gpa", "gigapascals": "gpa", "kilonewton": "kn", "kilonewtons": "kn", "meganewton": "mn", "meganewtons": "mn", "newton": "n", "newtons": "n", "kilometre": "km", "kilometres": "km", "litre": "l", "litres": "l", "hectare": "ha", "hectares": "ha", "acre": "acres", "cubicfeet": "ft3", "cubicfoot": "ft3", "cubicmeter": "m3", "cubicmeters": "m3", "cubicmetre": "m3", "cubicmetres": "m3", "squarefeet": "ft2", "squarefoot": "ft2", "sqft": "ft2", "sf": "ft2", "squaremeter": "m2", "squaremeters": "m2", "squaremetre": "m2", "sqm": "m2"}


def unit(name: Column) -> Column:
    """A unit's short name."""
    short = F.translate(F.lower(F.replace(name, F.lit(" "), F.lit(""))), "·*", "--")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[short], short)


def rounded(value: Column, places: int) -> Column:
    """Half away from zero, by the value's own binary digits (Spark's round goes by the shortest decimal)."""
    scale = float(10**places)
    return F.when(value < 0, -F.floor(-value * scale + 0.5)).otherwise(F.floor(value * scale + 0.5)) / scale


def converted(rows: DataFrame, value: str, from_col: str, to_col: str, factors=FACTORS, places: int | None = 6) -> DataFrame:
    """The rows with `converted`: rounded to `places` if these are given (temperatures to 2), the value itself for the same
    unit, null for pairs that aren't known. More factors can be given."""
    spark: SparkSession = rows.sparkSession
    known = spark.createDataFrame(list(factors), "_from string, _to string, _factor double")
    a, b, v = unit(F.col(from_col)), unit(F.col(to_col)), F.col(value)
    joined = rows.withColumns({"_a": a, "_b": b}).join(F.broadcast(known), (F.col("_a") == F.col("_from")) & (F.col("_b") == F.col("_to")), "left")
    warm = F.when((F.col("_a") == "c") & (F.col("_b") == "f"), F.round(v * 9 / 5 + 32, 2)).when((F.col("_a") == "f") & (F.col("_b") == "c"), F.round((v - 32) * 5 / 9, 2))
    out = F.coalesce(warm, v * F.col("_factor") if places is None else F.round(v * F.col("_factor"), places), F.when(F.col("_a") == F.col("_b"), v))
    return joined.withColumn("converted", out).drop("_a", "_b", "_from", "_to", "_factor")
