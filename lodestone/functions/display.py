"""What users and searches see of sources and figures: clean titles, and figures as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What downloads leave in titles.
ARTIFACTS = (
    r"\s*-\s*libgen\.l[ic]\.?", r"\s*\(\s*z-lib\.org\s*\)", r"\s*\[\s*z-lib\.org\s*\]", r"\s*-\s*z-lib\.org", r"\s*\(\s*PDFDrive\.com\s*\)", r"\s*\[\s*PDFDrive\s*\]",
    r"\s*-\s*PDFDrive", r"\s*\(\s*libgen\s*\)", r"\s*_+\s*$", r"\s*\(\s*\d+\s*\)\s*$",
)


def citation_title(title: Column) -> Column:
    """A title without what downloads leave in it; one that is nothing else stays."""
    out = title
    for pattern in ARTIFACTS:
        out = F.regexp_replace(out, "(?i)" + pattern, "")
    out = F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"[,\-_]+$", ""))
    return F.when(out == "", title).otherwise(out)


def citation_source(path: Column) -> Column:
    """A readable source from a file's path: its stem without numbers before it and a year behind, its words in capitals where all are
    small."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    name = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    for pattern in (r"^\d{10,}-", r"^\[\d+\]", r"\(\d{4}\)$"):
        name = F.regexp_replace(name, pattern, "")
    name = F.trim(F.regexp_replace(F.translate(name, "_", " "), r"\s+", " "))
    name = F.when(name == F.lower(name), F.initcap(name)).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown Source").otherwise(name)


def _let(value: Column, then) -> Column:
    """What `then` makes of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def three_digits(value: Column) -> Column:
    """A number with three digits that count, in powers of ten below 0.0001 and from 1000 on; halves go to the even digit."""
    ten = lambda n: F.pow(F.lit(10.0), n)
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def shown(v: Column, power: Column, digits: Column) -> Column:
        plain = F.format_number(digits / ten(2 - power), 6)
        far = F.concat(bare(F.format_string("%.2f", digits / 100)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        return F.when(v == 0, "0").when(power.between(-4, 2), bare(F.replace(plain, F.lit(","), F.lit("")))).otherwise(far)

    def rounded(v: Column, power: Column) -> Column:
        digits = F.bround(F.when(power <= 2, v * ten(2 - power)).otherwise(v / ten(power - 2)), 0)
        return _let(digits, lambda d: F.when(F.abs(d) >= 1000, shown(v, power + 1, d / 10)).otherwise(shown(v, power, d)))

    def powered(v: Column, guess: Column) -> Column:
        # a logarithm may miss a power of ten by one
        right = guess + F.when(F.abs(v) >= ten(guess + 1), 1).when((v != 0) & (F.abs(v) < ten(guess)), -1).otherwise(0)
        return _let(right, lambda p: rounded(v, p))

    return _let(value.cast("double"), lambda v: _let(F.when(v != 0, F.floor(F.log10(F.abs(v)))).otherwise(F.lit(0).cast("long")), lambda g: powered(v, g)))


def figure_text(title: Column, kind: Column, x_label: str, y_label: str, y_unit: str, series: Column) -> Column:
    """A figure as text for a search: title, kind, axes, and each series (name, points: array of struct(x, y)) with its number of
    points and ranges."""
    span = lambda axis, s: F.concat(F.lit(f"  {axis.upper()} range: "), three_digits(F.array_min(F.transform(s["points"], lambda p: p[axis]))), F.lit(" to "), three_digits(F.array_max(F.transform(s["points"], lambda p: p[axis]))))
    each = lambda s: F.concat(F.lit("Series: "), F.coalesce(s["name"], F.lit("unnamed")), F.lit(" ("), F.size(s["points"]).cast("string"), F.lit(" points)"), F.when(F.size(s["points"]) > 0, F.concat(F.lit("\n"), span("x", s), F.lit("\n"), span("y", s))).otherwise(""))
    head = F.concat(F.lit("Figure: "), title, F.lit("\nType: "), kind, F.lit(f"\nX-axis: {x_label}\nY-axis: {y_label} ({y_unit})"))
    return F.concat_ws("\n", head, F.array_join(F.transform(series, each), "\n"))
