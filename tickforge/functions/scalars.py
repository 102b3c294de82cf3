"""Column expressions: tickers, number texts, labels, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null stays null (Spark's least/greatest skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rnd(x: Column | str, digits: int) -> Column:
    """Scale, round to a whole number, scale back: how array libraries round doubles.

    ``F.round`` decides on the decimal text instead (2.675 and 10083.845 differ).
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10 ** digits))
    return F.round(x * scale) / scale


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def clamp_pct(x: Column) -> Column:
    return clamp(x, 0.0, 100.0)


def percent_in_range(low: Column, high: Column, value: Column) -> Column:
    """Place of ``value`` in the range as 0-100; 0 when it cannot be computed."""
    span = F.when(high - low > 0, high - low)
    return F.coalesce(clamp_pct(F.try_divide(value - low, span) * 100), F.lit(0.0))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end (``F.trim`` takes blanks only)."""
    return F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


# --- tickers -----------------------------------------------------------------------------

# Tickers that start with a number.
DIGIT_LED = r"^\d+[A-Z]{1,6}(\.[A-Z]{1,3})?$"
DIGIT_LED_BARE = r"^\d+[A-Z]{1,6}$"

# Exchange suffixes, tested in this order.
NEWS_SUFFIXES = (".MI", ".L", ".DE", ".PA", ".TO", ".V", ".SW", ".AS", ".MC", ".SA", ".HK",
                 ".SS", ".SZ", ".AX", ".KS", ".KQ", ".TW", ".T", ".SI")

# Suffix -> region and language of the news feed; anything else is US.
NEWS_LOCALES = {".MI": ("IT", "it-IT"), ".L": ("GB", "en-GB"), ".DE": ("DE", "de-DE"),
                ".PA": ("FR", "fr-FR"), ".TO": ("CA", "en-CA"), ".V": ("CA", "en-CA")}


def compact_upper(x: Column) -> Column:
    return F.replace(F.upper(strip(x)), F.lit(" "), F.lit(""))


def _no_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"^\d+", "")


def normalize_ticker(x: Column) -> Column:
    t = compact_upper(x)
    return F.when(t.rlike(DIGIT_LED), _no_digits(t)).otherwise(t)


def _distinct_filled(*items: Column) -> Column:
    filled = [F.when(F.length(i) > 0, i) for i in items]
    return F.array_distinct(F.array_compact(F.array(*filled)))


def ticker_candidates(x: Column) -> Column:
    raw = compact_upper(F.coalesce(x, F.lit("")))
    milan = F.when(raw.rlike(DIGIT_LED_BARE), F.concat(raw, F.lit(".MI")))
    return _distinct_filled(milan, raw, normalize_ticker(raw))


def fundamentals_candidates(x: Column) -> Column:
    raw = compact_upper(F.coalesce(x, F.lit("")))
    norm, bare = normalize_ticker(raw), _no_digits(raw)

    def stem(t):
        return F.when(F.contains(t, F.lit(".")), F.substring_index(t, ".", 1))

    return _distinct_filled(raw, norm, stem(norm), bare, stem(bare))


def news_symbol(x: Column) -> Column:
    s = F.regexp_replace(strip(F.upper(x)), "^[0-9]+", "")
    out = s
    for suffix in reversed(NEWS_SUFFIXES):
        cut = F.substring(s, F.lit(1), F.length(s) - len(suffix))
        out = F.when(F.endswith(s, F.lit(suffix)), cut).otherwise(out)
    return out


def news_locale(x: Column) -> Column:
    s = F.upper(F.coalesce(x, F.lit("")))

    def pick(i, default):
        out = F.lit(default)
        for suffix, locale in reversed(NEWS_LOCALES.items()):
            out = F.when(F.endswith(s, F.lit(suffix)), F.lit(locale[i])).otherwise(out)
        return out

    return F.struct(pick(0, "US").alias("region"), pick(1, "en-US").alias("lang"))


# --- numbers and texts ---------------------------------------------------------------------

# Texts that mean "no number", and unit letters.
NO_NUMBER = ("N/A", "ND", "N/D", "-", "--", "—")
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _scale(unit: Column) -> Column:
    scale = F.lit(1.0)
    for letter, factor in UNITS.items():
        scale = F.when(unit == letter, F.lit(factor)).otherwise(scale)
    return scale


def _with_unit(s: Column) -> Column:
    unit = F.upper(F.right(s, F.lit(1)))
    has = unit.isin(*UNITS)
    body = strip(F.when(has, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s))
    return F.when(body.rlike(NUMBER), _finite(body.try_cast("double") * _scale(unit)))


def parse_number(x: Column) -> Column:
    """'1.2B', '5%', '1,234' -> number; texts without one -> null. Percent is a fraction."""
    s = strip(F.replace(strip(x), F.lit(","), F.lit("")))
    bad = (s == "") | F.upper(s).isin(*NO_NUMBER)
    # the part before one or more percent signs is a number text again
    base = strip(F.regexp_replace(s, r"[%\s]+$", ""))
    signs = F.length(s) - F.length(F.replace(s, F.lit("%"), F.lit("")))
    bad_base = (base == "") | F.upper(base).isin(*NO_NUMBER)
    percent = F.when(~bad_base, _with_unit(base)) / F.pow(F.lit(100.0), signs)
    return F.when(bad, None).when(F.endswith(s, F.lit("%")), percent).otherwise(_with_unit(s))


def parse_numbers(texts: Column) -> Column:
    """``parse_number`` of every text of a list. Each step goes over the whole list and is used once by the next one;
    inside a function of list elements nothing else keeps Spark from computing a step again at every use."""
    s = F.transform(texts, lambda x: strip(F.replace(strip(x), F.lit(","), F.lit(""))))

    def plain(s):
        rated = F.endswith(s, F.lit("%"))
        base = F.when(rated, strip(F.regexp_replace(s, r"[%\s]+$", ""))).otherwise(s)
        signs = F.length(s) - F.length(F.replace(s, F.lit("%"), F.lit("")))
        return F.when((s != "") & ~F.upper(s).isin(*NO_NUMBER), F.struct(base.alias("t"), F.when(rated, signs).alias("signs")))

    def scaled(p):
        unit = F.upper(F.right(p["t"], F.lit(1)))
        return F.when((p["t"] != "") & ~F.upper(p["t"]).isin(*NO_NUMBER), F.struct(p["t"].alias("t"), p["signs"].alias("signs"), unit.alias("unit")))

    def read(p):
        body = strip(F.when(p["unit"].isin(*UNITS), F.substring(p["t"], F.lit(1), F.length(p["t"]) - 1)).otherwise(p["t"]))
        return F.when(p.isNotNull(), F.struct(body.alias("body"), p["signs"].alias("signs"), _scale(p["unit"]).alias("scale")))

    def value(p):
        return F.when(p["body"].rlike(NUMBER), F.struct((p["body"].try_cast("double") * p["scale"]).alias("x"), p["signs"].alias("signs")))

    def number(p):
        return F.when(p["signs"].isNull(), _finite(p["x"])).otherwise(_finite(p["x"]) / F.pow(F.lit(100.0), p["signs"]))

    for step in (plain, scaled, read, value, number):
        s = F.transform(s, step)
    return s


def parse_number_leaf(raw: Column, fmt: Column) -> Column:
    """Payload leaf ``{raw, fmt}``: a present raw value decides, else the formatted text."""
    return F.when(raw.isNotNull(), parse_number(raw)).otherwise(parse_number(fmt))


def to_text(raw: Column, fmt: Column | None = None) -> Column:
    fmt = F.lit(None).cast("string") if fmt is None else F.when(fmt != "", fmt)
    return F.nullif(strip(F.coalesce(fmt, raw.cast("string"))), F.lit(""))


def normalize_row_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def coerce_non_negative_int(x: Column, default: Column | int = 0) -> Column:
    default = F.lit(default) if isinstance(default, int) else default
    n = F.when(strip(x.cast("string")).rlike(r"^[+-]?\d+$"), x.try_cast("bigint"))
    return F.coalesce(F.when(n >= 0, n), default)


def coerce_float(x: Column, default: float = 0.0) -> Column:
    s = strip(x.cast("string"))
    return F.coalesce(_finite(F.when(s.rlike(NUMBER), s.try_cast("double"))), F.lit(default))


def pick_keys(*cols: Column) -> Column:
    return F.coalesce(*cols)


# Labels without meaning.
EMPTY_LABELS = ("N/A", "NA", "N.D.", "N/D", "NULL", "NONE", "UNKNOWN", "-", "--")


def pick_best_label(*cols: Column) -> Column:
    def meaningful(x):
        t = strip(x)
        return F.when((t != "") & ~F.upper(t).isin(*EMPTY_LABELS), t)
    return F.coalesce(*[meaningful(c) for c in cols])


def fmt_large(x: Column) -> Column:
    """1.23T / B / M, whole thousands as k, '-' for null."""
    n = F.abs(x)

    def text(scale, pattern):
        return F.format_string(pattern, x / F.lit(scale))

    plain = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return (F.when(x.isNull(), "-").when(n >= 1e12, text(1e12, "%.2fT"))
            .when(n >= 1e9, text(1e9, "%.2fB")).when(n >= 1e6, text(1e6, "%.2fM"))
            .when(n >= 1e3, text(1e3, "%.0fk")).otherwise(plain))


def rr_tone(x: Column) -> Column:
    return (F.when(x.isNull(), "neutral").when(x >= 1.5, "strong").when(x >= 1, "ok")
            .otherwise("weak"))


# Gap types and the names they are shown under.
SHOWN_GAPS = {"Gap Up": "Gap Down", "Gap Down": "Gap Up", "Gap Up 3 candele": "Gap Down 3 candele",
              "Gap Down 3 candele": "Gap Up 3 candele"}


def swap_gap_label(kind: Column) -> Column:
    """Display name of a gap type is the opposite one."""
    out = F.when(kind != "", kind)
    for k, shown in SHOWN_GAPS.items():
        out = F.when(kind == k, F.lit(shown)).otherwise(out)
    return F.coalesce(out, F.lit("Gap"))


def interval_of_timeframe(timeframe: Column) -> Column:
    from tickforge.sources.bars import INTERVAL_OF_TIMEFRAME
    out = F.lit("1d")
    for tf, code in INTERVAL_OF_TIMEFRAME.items():
        out = F.when(timeframe == tf, F.lit(code)).otherwise(out)
    return out
