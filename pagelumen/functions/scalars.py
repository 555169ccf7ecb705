"""Small formatting and banding expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_decimal(x: Column) -> Column:
    """A number with one decimal, rounded by what the double exactly is, an exact tie to the even digit: 1.15 is ``1.1``, 0.25 is ``0.2``.

    (``format_string`` rounds the shortest decimal that names the double, half up.) Beyond 2^30 it does.
    """

    def scaled(size: Column) -> Column:
        # In these units a double is a whole number, but for ones under 1/256, which round to 0.0 anyway.
        unit = F.when(size < 1, F.lit(float(1 << 60))).when(size < (1 << 10), F.lit(float(1 << 52))).when(size < (1 << 20), F.lit(float(1 << 42))).otherwise(F.lit(float(1 << 32)))
        return F.struct(size.alias("size"), unit.alias("unit"))

    def parts(s: Column) -> Column:
        whole = (s["size"] * s["unit"]).cast("long").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
        return F.struct(whole.alias("whole"), s["unit"].cast("long").cast("decimal(20,0)").alias("per"))

    def rounded(p: Column) -> Column:
        rest = p["whole"] % p["per"]
        tenths = ((p["whole"] - rest) / p["per"]).cast("long")
        return tenths + ((rest * 2 > p["per"]) | ((rest * 2 == p["per"]) & (tenths % 2 == 1))).cast("long")

    def shown(tenths: Column) -> Column:
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    def text(x: Column) -> Column:
        exact = _let(_let(_let(_let(F.abs(x), scaled), parts), rounded), shown)
        signed = _let(exact, lambda t: F.when((x < 0) & (t != "0.0"), F.concat(F.lit("-"), t)).otherwise(t))
        return F.when(F.abs(x) < (1 << 30), signed).otherwise(F.format_string("%.1f", x))

    return _let(x.cast("double"), text)


def compact_number(n: Column, billions: bool = True) -> Column:
    """``1.5M``, ``85.0K``; whole numbers below a thousand; null stays null."""
    steps = [(1_000_000_000, "B")] * billions + [(1_000_000, "M"), (1_000, "K")]

    def text(n: Column) -> Column:
        size = suffix = F.lit(None)
        for least, name in reversed(steps):
            size, suffix = F.when(n >= least, n / float(least)).otherwise(size), F.when(n >= least, name).otherwise(suffix)
        return F.when(n >= 1_000, F.concat(one_decimal(size), suffix)).otherwise(n.cast("long").cast("string"))

    return _let(n, text)


def duration(seconds: Column) -> Column:
    """``3m 5s``."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))


def percent(share: Column) -> Column:
    """A share of one as ``45.0%``."""
    return F.concat(one_decimal(share * 100.0), F.lit("%"))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B+").when(score >= 70, "B").when(score >= 60, "C").when(score >= 50, "D").otherwise("F")


def closing(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "solid").otherwise("needs_work")


def outcome(score: Column) -> Column:
    return F.when(score < 50, "large_gains").when(score < 80, "steady_gains").otherwise("fine_tuning")


def redact(text: Column) -> Column:
    """Shows the first 30 per cent (one character at least), masks the rest."""
    shown = F.greatest(F.lit(1), F.floor(F.length(text) * F.lit(0.3)).cast("int"))
    return F.concat(F.substring(text, F.lit(1), shown), F.repeat(F.lit("*"), F.greatest(F.length(text) - shown, F.lit(0))))


def micros(amount: Column) -> Column:
    """Millionths of a currency unit as an amount with two decimals."""
    return (amount.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,2)")


def upload_name(kind: Column, content: Column, extension: Column) -> Column:
    """``kind_`` and twelve digits of the content's digest."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(content, 256), 1, 12), extension)


def expected_impact(severity: Column, impact: Column) -> Column:
    """Class of the phrase about what a fix brings."""
    return F.when((severity == "error") & (impact == "high"), "major").when(severity == "error", "clear").when((severity == "warning") & impact.isin("high", "medium"), "moderate").otherwise("minor")


# Characters that the Latin-1 report fonts lack, and what is printed for them.
LATIN1 = [("\u2014", "-"), ("\u2013", "-"), ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2026", "..."), ("\u2022", "-"), ("\u00a0", " "), ("\u2192", "->"), ("\u2190", "<-"), ("\u2713", "v"), ("\u2717", "x")]


def latin1(text: Column) -> Column:
    for a, b in LATIN1:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"[^\x00-\xff]", "?")
