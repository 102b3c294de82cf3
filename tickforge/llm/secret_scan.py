"""Secret scans with SQL functions only.

Three fixed patterns find keys that announce themselves. Beyond them every run of 16 or more characters
of an encoding alphabet is a candidate, and so are its pieces of that length between slashes, between
``_`` and ``-``, and between any of them: a key may stand in a path or behind a name. The encoding of a
candidate is inferred (hex, letters, base32, base36, base62, base64) and a battery of three tests asks
whether it looks drawn at random from that alphabet: chi-squared uniformity of the characters, the number
of runs below and above the middle of the alphabet, and the serial correlation of neighbours. Fisher's method makes one p-value of the three; a candidate
that fails at ``BATTERY`` is no secret.

What passes could still be text, since short strings give the tests little power. The likelihood ratio of
"uniform over the alphabet" against "text" (fixed shares of character kinds) bounds the chance that text
gives such a string by 1 / ratio. These bounds are p-values that shrink with the length; within each class
of lengths the Benjamini-Hochberg rule keeps the share of false discoveries below ``RATE``. The rule needs
only the histogram of the bounds over the whole corpus, a table of a fixed size.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import unused
from tickforge.sources.stored import stored

# The patterns of the base kinds, in the order of their rank.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = 12
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that read whole texts list their characters one by one: Java looks these up in one table, and tries ranges in turn.
_LISTED = _DIGITS + _UPPER + _LOWER + "+/_"
#: What every assignment of a long enough value has from its sign on.
ASSIGNED = rf"[:=]\x20*+[\"']?[{_LISTED}.=-]{{{ASSIGN_VALUE}}}"

CANDIDATE = rf"(?<![{_LISTED}-])[{_LISTED}-]{{16,}}+={{0,2}}"
#: Pieces of a run: base64 has no ``_`` and ``-``, its URL form no slash, the others neither.
PIECES = tuple(rf"{letters}{{16,}}+={{0,2}}" for letters in ("[A-Za-z0-9+_-]", "[A-Za-z0-9+/]", "[A-Za-z0-9+]"))
#: Pattern and alphabet of each encoding, narrowest first.
ENCODINGS = ((r"^[0-9a-fA-F]+$", "0123456789abcdef"), (r"^[a-z]+$", _LOWER), (r"^[A-Z]+$", _UPPER), (r"^[A-Z2-7]+$", _UPPER + "234567"),
             (r"^[a-z0-9]+$", _DIGITS + _LOWER), (r"^[A-Za-z]+$", _UPPER + _LOWER), (r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER), (r"", _DIGITS + _UPPER + _LOWER + "+/"))
#: Share of each kind of character in text; kinds share evenly among their characters.
TEXT_SHARES = ((_LOWER, 0.90), (_UPPER, 0.06), (_DIGITS, 0.03), ("+/_-", 0.01))
#: The same for a run of capital letters alone, which may be a word of a text in capitals: letters by frequency.
CAPITAL_SHARES = (("EATIONSR", 0.66), ("HLDCUM", 0.22), ("FPGBWVYKZ", 0.115), ("QXJ", 0.005))
BATTERY, RATE = 0.001, 0.01
#: Lower ends of the length classes; grid of log10 bounds.
LENGTHS, GRID, GRID_MOST = (16, 24, 32, 48, 96), 4, 240

#: Running totals are lists made in parts of so many, since a list that grows by one is copied at every step.
PART = 256


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _bound(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step(value)`` with ``value`` worked out once, however often ``step`` uses it: columns are expanded where they stand."""
    return F.element_at(F.transform(F.array(value), step), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``array<int>`` of what ``merge`` (a sum or a maximum) gives from 0 over the first to each of ``values``, none of them negative."""

    def lists(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(v, i + 1, PART))
        # each part goes on from the last of its predecessor, which it repeats
        return F.aggregate(parts, F.array(F.array(F.lit(0))), lambda out, part: F.concat(out, F.array(F.aggregate(
            part, F.array(F.element_at(F.element_at(out, -1), -1)), lambda one, x: F.concat(one, F.array(merge(F.element_at(one, -1), x)))))),
            lambda out: F.flatten(F.transform(F.slice(out, 2, F.size(out)), lambda one: F.slice(one, 2, PART))))

    return _bound(values, lists)


def matched(text: Column, pattern: str, extra: int = 0) -> Column:
    """``array<struct<start, end, value, extra>>`` of the leftmost matches that don't overlap, in code points; ``extra`` is a group.

    The pieces between the matches give their places: ``split`` cuts where ``regexp_extract_all`` finds."""
    columns = [F.transform(F.split(text, pattern, -1), F.length).alias("gap"), _found(text, pattern).alias("value")]
    columns += [_found(text, pattern, extra).alias("extra")] if extra else []

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: r["gap"] + F.length(r["value"])), lambda x, y: x + y)
        return _bound(ends, lambda e: F.transform(rows, lambda r, i: F.struct(
            (F.get(e, i) - F.length(r["value"])).alias("start"), F.get(e, i).alias("end"), r["value"].alias("value"),
            *[r["extra"].alias("extra")] * bool(extra))))

    rows = F.filter(F.arrays_zip(*columns), lambda r: r["value"].isNotNull())  # one piece more than matches
    kind = "struct<start:int,end:int,value:string" + ",extra:string" * bool(extra) + ">"
    return F.coalesce(F.when(text.rlike(pattern), _bound(rows, placed)), F.array().cast(f"array<{kind}>"))


def runs(text: Column) -> Column:
    """The runs of an encoding alphabet. Every match of ``ACCESS``, ``HEX`` and ``PIECES`` lies inside one."""
    return matched(text, CANDIDATE)


def inside(found: Column, pattern: str) -> Column:
    """The matches of ``pattern`` inside each run."""
    return F.flatten(F.transform(found, lambda m: F.transform(matched(m["value"], pattern), lambda x: F.struct(
        (m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["value"].alias("value")))))


def _spans(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def base_spans(text: Column, found: Column) -> Column:
    """Spans of the three fixed patterns by start, then rank; ``found`` are the runs of ``text``."""
    assign = F.filter(matched(text, ASSIGN, 2), lambda m: F.length(m["extra"]) >= ASSIGN_VALUE)
    assign = F.when(text.rlike(ASSIGNED), _spans(assign, 0)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    return F.array_sort(F.concat(assign, _spans(inside(found, ACCESS), 1), _spans(inside(found, HEX), 2)))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a logistic fit (within 2e-4); no error function in SQL."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def tested(value: Column) -> Column:
    """``struct<n, battery, bound>`` of a candidate: its length, the combined p-value of the battery, and
    log10 of the likelihood ratio of random against text."""
    def inferred(core: Column) -> Column:
        alphabet = F.lit(ENCODINGS[-1][1])
        for pattern, letters in ENCODINGS[-2::-1]:
            alphabet = F.when(core.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        plain = F.translate(core, "-_", "+/")
        return F.struct(F.when(core.rlike(ENCODINGS[0][0]), F.lower(plain)).otherwise(plain).alias("text"), alphabet.alias("alphabet"))

    def spelled(s: Column) -> Column:
        return F.struct(s["text"].alias("text"), s["alphabet"].alias("alphabet"), F.length(s["text"]).cast("double").alias("n"),
                        F.length(s["alphabet"]).cast("double").alias("k"), F.split(s["text"], "").alias("chars"))

    def numbered(s: Column) -> Column:
        n, k, chars = s["n"], s["k"], s["chars"]
        squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(s["text"], c, F.lit(""))), F.lit(2.0))))
        x = F.transform(chars, lambda c: F.call_function("instr", s["alphabet"], c) - 1.0)
        return F.struct(n.alias("n"), k.alias("k"), s["text"].alias("text"), squares.alias("squares"), x.alias("x"))

    def summed(s: Column) -> Column:
        x = s["x"]
        following = F.concat(F.slice(x, 2, F.size(x)), F.slice(x, 1, 1))
        return F.struct(*[s[c].alias(c) for c in ("n", "k", "text", "squares")], _sum(x).alias("s1"), _sum(F.transform(x, lambda v: v * v)).alias("s2"),
                        _sum(F.zip_with(x, following, lambda a, b: a * b)).alias("s11"),
                        F.transform(x, lambda v: (v >= s["k"] / 2).cast("double")).alias("high"))

    def changing(s: Column) -> Column:
        high = s["high"]
        changes = _sum(F.zip_with(F.slice(high, 2, F.size(high)), F.slice(high, 1, F.size(high) - 1), lambda a, b: F.abs(a - b)))
        return F.struct(*[s[c].alias(c) for c in ("n", "k", "text", "squares", "s1", "s2", "s11")], _sum(high).alias("ones"), changes.alias("changes"))

    def scored(s: Column) -> Column:
        n, k, ones = s["n"], s["k"], s["ones"]
        uniform = (s["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        spread = n * s["s2"] - s["s1"] * s["s1"]
        serial = F.when(spread > 0, ((n * s["s11"] - s["s1"] * s["s1"]) / spread + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n).otherwise(F.lit(8.0))
        expected = 2 * ones * (n - ones) / n + 1
        width = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(width > 0, (s["changes"] + 1 - expected) / F.sqrt(width)).otherwise(F.lit(8.0))
        return F.struct(n.alias("n"), k.alias("k"), s["text"].alias("text"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"))

    def combined(s: Column) -> Column:
        half = -(F.log(_tail(s["uniform"])) + F.log(F.least(F.lit(1.0), 2 * _tail(F.abs(s["runs"]))))
                 + F.log(F.least(F.lit(1.0), 2 * _tail(F.abs(s["serial"])))))
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), s["text"].alias("text"), half.alias("half"))

    def rated(s: Column) -> Column:
        n, half = s["n"], s["half"]

        def against(shares: tuple) -> Column:
            ratio = n * F.log10(1 / s["k"])
            for letters, share in shares:
                count = n - F.length(F.translate(s["text"], letters, ""))
                ratio = ratio - count * math.log10(share / len(letters))
            return ratio

        ratio = F.when(F.translate(s["text"], _UPPER, "") == "", against(CAPITAL_SHARES)).otherwise(against(TEXT_SHARES))
        return F.struct(n.cast("int").alias("n"), (F.exp(-half) * (1 + half + half * half / 2)).alias("battery"), ratio.alias("bound"))

    # a column is worked out anew wherever it stands; what a step uses several times is a field of the step before
    steps = F.array(F.regexp_replace(value, "=+$", ""))
    for step in (inferred, spelled, numbered, summed, changing, scored, combined, rated):
        steps = F.transform(steps, step)
    return F.element_at(steps, 1)


def candidates(found: Column) -> Column:
    """``array<struct<start, end, cls, grid>>`` of the candidates, runs and their pieces, that pass the battery:
    length class and log10 bound on the grid."""

    def with_pieces(mixed: Column) -> Column:
        # a piece that several patterns find, or that is its run, counts once: equal ones are neighbours
        rows = F.array_sort(F.concat(found, *[inside(mixed, p) for p in PIECES]))
        once = _bound(rows, lambda a: F.filter(a, lambda m, i: (i == 0) | (F.get(a, i - 1) != m)))
        return F.when(F.size(mixed) > 0, once).otherwise(found)

    def judged(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), tested(m["value"]).alias("t"))

    def graded(m: Column) -> Column:
        cls = F.lit(0)
        for i, least in enumerate(LENGTHS):
            cls = F.when(m["t"]["n"] >= least, F.lit(i)).otherwise(cls)
        grid = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(GRID_MOST / GRID), m["t"]["bound"])) * GRID).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), cls.alias("cls"), grid.alias("grid"), m["t"]["battery"].alias("battery"))

    rows = _bound(F.filter(found, lambda m: m["value"].rlike("[/_-]")), with_pieces)
    return F.filter(F.transform(F.transform(rows, judged), graded), lambda m: m["battery"] >= BATTERY)


def scanned(text: Column) -> Column:
    """``struct<base, candidates>`` of a text: all that the thresholds and the spans need of it."""
    return _bound(runs(text), lambda found: F.struct(base_spans(text, found).alias("base"), candidates(found).alias("candidates")))


def thresholds(rows: DataFrame, tested: Column) -> dict[int, int]:
    """Smallest grid value at which each length class keeps its share of false discoveries: the largest set
    of candidates with ``all * p <= RATE * set``. ``tested`` are the candidates of each row; from a histogram of at most 5 * 241 rows."""
    # exploded where they are worked out: Spark filters a named column by its size, and would work it out for that too
    rows = rows.select(F.explode(tested).alias("c")).groupBy("c.cls", "c.grid").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for cls in range(len(LENGTHS)):
        counts = {r["grid"]: r["n"] for r in rows if r["cls"] == cls}
        total, above = sum(counts.values()), 0
        for grid in sorted(counts, reverse=True):
            above += counts[grid]
            if total * 10.0 ** (-grid / GRID) <= RATE * above:
                out[cls] = grid
    return out


def secret_spans(found: Column, limits: dict[int, int]) -> Column:
    """``array<struct<start, rank, end>>``: the base spans, and the random strings that touch none of them.
    A piece of a run that is reported is not reported again. ``found`` is the column of ``scanned``."""
    most = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]) if limits else None

    def apart(f: Column) -> Column:
        # a span touches a candidate if it ends behind its start: the furthest end of those that start before its end
        rows = F.array_sort(F.concat(
            F.transform(f["new"], lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))),
            F.transform(f["base"], lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
        new = _bound(rows, lambda r: _bound(running(F.transform(r, lambda x: x["kind"] * x["end"]), F.greatest), lambda ends: F.filter(
            r, lambda x, i: (x["kind"] == 0) & (F.get(ends, i) <= x["start"]))))
        return F.struct(f["base"].alias("base"), new.alias("new"))

    def widest(f: Column) -> Column:
        # the wider ones come first; a candidate inside one of them doesn't end behind all of them
        rows = F.array_sort(F.transform(f["new"], lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["end"].alias("end"))))
        new = _bound(rows, lambda r: _bound(running(F.transform(r, lambda x: x["end"]), F.greatest), lambda ends: F.filter(
            r, lambda x, i: F.coalesce(F.get(ends, i - 1), F.lit(0)) < x["end"])))
        return F.array_sort(F.concat(f["base"], _spans(new, 3)))

    def some(f: Column) -> Column:
        return F.when(F.size(f["new"]) > 0, _bound(apart(f), widest)).otherwise(f["base"])

    if most is None:
        return found["base"]
    reached = _bound(found, lambda f: F.struct(f["base"].alias("base"), F.filter(f["candidates"], lambda m: F.coalesce(
        m["grid"] >= F.element_at(most, m["cls"]), F.lit(False))).alias("new")))
    return _bound(reached, some)


def named(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``; a null text counts as empty. Every row is treated by itself: repeated rows,
    repeated ids and extra columns do no harm, an existing ``spans`` is replaced. The texts are read twice."""
    limits = thresholds(docs, candidates(runs(_text())))
    return docs.withColumn("spans", secret_spans(scanned(_text()), limits))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of each row. The texts are read once: what was
    found in them is a table, by which the thresholds are set and then applied."""
    found = stored(docs.select("doc_id", scanned(_text()).alias("found")), "secrets")
    limits = thresholds(found, F.col("found.candidates"))
    rows = found.select("doc_id", secret_spans(F.col("found"), limits).alias("spans"))

    def count(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return rows.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(named(base), 256).alias("base_sha256"),
                       named(F.col("spans")).alias("spans"), count("random"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping spans become one mark. ``n_chars``, where
    it exists, follows; other columns and null texts stay as they are."""
    spans = unused(docs)
    limits = thresholds(docs, candidates(runs(_text())))
    rows = docs.withColumn(spans, secret_spans(scanned(_text()), limits))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        apart, gap = s["start"] >= acc["at"], s["start"] - acc["at"]
        fresh = F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["at"] + 1, gap), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, fresh).otherwise(acc["parts"]).alias("parts"),
                        F.when(apart, acc["n"] + gap + len(mark)).otherwise(acc["n"]).alias("n"))

    made = F.aggregate(spans, start, step, lambda acc: F.struct(
        F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))).alias("text"),
        (acc["n"] + F.length("text") - acc["at"]).cast("long").alias("n_chars")))
    rows = rows.withColumn(f"{spans}new", F.when(F.size(spans) > 0, made))
    return rows.select(*[F.coalesce(F.col(f"{spans}new.{c}"), F.col(c)).alias(c) if c in ("text", "n_chars") else F.col(c) for c in docs.columns])
