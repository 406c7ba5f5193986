"""Secrets in texts, by column expressions only: named values, access keys, hexadecimal strings, and strings that look random.

The first three kinds are patterns. For the fourth, strings of 20 or more characters of the usual encodings, outside the other kinds, are put to two questions.

Is it uniform over the alphabet of its encoding, the smallest that holds it? Three tests: chi-squared of its characters' counts; the number of runs of characters
from one half of the alphabet; the serial correlation of neighbouring characters. Each gives a normal deviate; the sum of their squares must stay below the
99.9 % point of chi-squared with three degrees of freedom.

Could it be text? Text repeats characters: two places hold the same one with a probability of at least 0.06, as letters of European languages do, or of twice a
uniform string's. The deviate of the string's number of equal pairs from that is its p-value's. Among all different strings of the corpus of one class of lengths,
a step-up rule (Benjamini and Hochberg) chooses how small p must be, so that of the strings called secrets the share of text stays under `false_share`. Short
strings hardly ever reach it unless secrets abound; each class of lengths has its own count of strings and its own limit.

Texts are read once. What is stored of them are positions and test values; of these, the numbers of strings by class and rounded deviate, at most 4,004 rows,
settle the limits, which come to the driver as four numbers. Nothing else is shuffled but a hash of each candidate string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# The patterns of the first three kinds; of a named value, the second group must have six characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the fourth kind.
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings: a pattern and its alphabet; the first that a string matches is its own.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"), ("^[a-z]+$", _LOWER), ("^[A-Z]+$", _UPPER), ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _LOWER + _DIGITS), ("^[A-Z0-9]+$", _UPPER + _DIGITS), ("^[A-Za-z]+$", _UPPER + _LOWER), ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"), ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: The 99.9 % point of chi-squared with three degrees of freedom; the least probability that two places of a text hold the same character.
UNIFORM_LIMIT, TEXT_PAIRS = 16.266, 0.06
#: Deviates are rounded up to fiftieths, of which there are so many below 0. Classes of lengths begin at these.
STEPS, DEEPEST, LENGTHS = 50, 1000, (20, 32, 64, 128)

#: Elements whose sum is taken as one step by `before`.
_SPAN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda n, x: n + x)


def before(lengths: Column) -> Column:
    """The sum of the elements before each one of an array of int, in two levels: about n * 256 + (n / 256)² steps for n of them."""
    whole = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _SPAN).cast("int")), lambda k: _total(F.slice(n, k * _SPAN + 1, F.lit(_SPAN))))
    starts = lambda sums: F.transform(sums, lambda _, k: _total(F.slice(sums, F.lit(1), k)))
    at = lambda i: F.floor(i / _SPAN).cast("int")
    summed = lambda n: let(let(whole(n), starts), lambda s: F.transform(n, lambda _, i: F.get(s, at(i)) + _total(F.slice(n, at(i) * _SPAN + 1, i % _SPAN))))
    return let(lengths, lambda n: F.when(F.size(n) > 0, summed(n)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, group: int | None = None, least: int = 0, masked: bool = False) -> Column:
    """(spans, rest): start, stop and string of each leftmost match that doesn't overlap the one before, in characters; the text, with `masked` those spans blanked.

    Of a match, `group` must have `least` characters, if it is given.
    """
    def taken(text: Column, m: Column) -> Column:
        gaps = F.transform(F.slice(m["pieces"], F.lit(1), F.size(m["strings"])), F.length)
        starts = F.zip_with(before(F.zip_with(gaps, F.transform(m["strings"], F.length), lambda g, n: g + n)), gaps, lambda b, g: b + g)
        zipped = F.transform(F.arrays_zip(m["strings"].alias("s"), m["values"].alias("v"), starts.alias("at")), lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["s"])).alias("stop"), x["s"].alias("string"), (F.length(x["v"]) >= least).alias("ok")))
        kept = F.transform(F.filter(zipped, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["string"].alias("string")))
        rest = text
        if masked:
            blank = F.zip_with(m["strings"], m["values"], lambda s, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(s))).otherwise(s))
            parts = F.zip_with(F.slice(m["pieces"], F.lit(1), F.size(m["strings"])), blank, lambda p, b: F.concat(p, b))
            rest = F.concat(F.array_join(parts, ""), F.element_at(m["pieces"], -1))
        return F.struct(kept.alias("spans"), rest.alias("rest"))

    def found(text: Column, strings: Column) -> Column:
        values = strings if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts = F.struct(strings.alias("strings"), values.alias("values"), F.split(text, pattern, -1).alias("pieces"))
        none = F.struct(F.array().cast("array<struct<start:int,stop:int,string:string>>").alias("spans"), text.alias("rest"))
        return F.when(F.size(strings) > 0, let(parts, lambda m: taken(text, m))).otherwise(none)

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda s: found(t, s)))


def _by_encoding(string: Column, values: list) -> Column:
    """The value for the string's encoding; null if it has none."""
    out = F.lit(None)
    for (pattern, _), value in reversed(list(zip(ENCODINGS, values, strict=True))):
        out = F.when(F.rlike(string, F.lit(pattern)), F.lit(value)).otherwise(out)
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda n, x: n + x)


def deviates(string: Column) -> Column:
    """(n, uniform, text) of a string: its length; the sum of three squared deviates from a uniform string; the deviate of its equal pairs from a text's. Null without an encoding."""
    halves = ["0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for _, a in ENCODINGS]
    known = F.struct(_by_encoding(string, [a for _, a in ENCODINGS]).alias("alphabet"), _by_encoding(string, halves).alias("halves"))

    def counted(x: Column) -> Column:
        times = F.transform(F.split(x["alphabet"], ""), lambda a: (F.length(string) - F.length(F.replace(string, a, F.lit("")))).cast("double"))
        places = F.transform(F.split(string, ""), lambda c: F.instr(x["alphabet"], c).cast("double"))
        bits = F.call_function("translate", string, x["alphabet"], x["halves"])
        return F.struct(
            F.length(string).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), _sum(F.transform(times, lambda t: t * t)).alias("squares"), places.alias("v"),
            F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double").alias("ones"), F.length(F.regexp_replace(bits, "0+|1+", "x")).cast("double").alias("runs"),
        )

    def serial(x: Column) -> Column:
        shifted = F.concat(F.slice(x["v"], F.lit(2), F.size(x["v"]) - 1), F.slice(x["v"], 1, 1))
        sums = F.struct(_sum(x["v"]).alias("s"), _sum(F.transform(x["v"], lambda v: v * v)).alias("ss"), _sum(F.zip_with(x["v"], shifted, lambda a, b: a * b)).alias("sx"))
        return let(sums, lambda y: F.try_divide(x["n"] * y["sx"] - y["s"] * y["s"], x["n"] * y["ss"] - y["s"] * y["s"]))

    def judged(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = (k * x["squares"] / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        expected = 2 * x["ones"] * (n - x["ones"]) / n + 1
        runs = F.try_divide(x["runs"] - expected, F.sqrt((expected - 1) * (expected - 2) / (n - 1)))
        neighbours = (serial(x) + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        pairs, usual = n * (n - 1), F.greatest(2 / k, F.lit(TEXT_PAIRS))
        text = (x["squares"] - n - pairs * usual) / F.sqrt(2 * pairs * usual * (1 - usual))
        return F.struct(n.cast("int").alias("n"), (chi * chi + runs * runs + neighbours * neighbours).alias("uniform"), text.alias("text"))

    return let(known, lambda x: F.when(x["alphabet"].isNotNull(), let(counted(x), judged)))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for c, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, c).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Strings that may be random: start, stop, hash, class of length, rounded deviate from text (in fiftieths, at most 0), and whether they pass as uniform."""

    def tested(x: Column) -> Column:
        step = F.greatest(F.lit(-DEEPEST), F.least(F.lit(0), F.ceil(x["d"]["text"] * STEPS).cast("int")))
        uniform = F.coalesce(x["d"]["uniform"] <= UNIFORM_LIMIT, F.lit(False))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.xxhash64(x["string"]).alias("hash"), _length_class(x["d"]["n"]).alias("length"), step.alias("step"), uniform.alias("uniform"))

    spans = matches(text, RANDOM)["spans"]
    known = F.filter(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["string"], deviates(s["string"]).alias("d"))), lambda x: x["d"].isNotNull())
    return F.transform(known, tested)


def limits(found: DataFrame, column: str, false_share: float) -> dict[int, int]:
    """For each class of lengths the highest step at which strings are called secrets: the greatest whose p is at most false_share times the share of strings up to it. None: no string is."""
    distinct = found.select(F.explode(column).alias("c")).select("c.length", "c.step", "c.hash").distinct()
    steps = distinct.groupBy("length", "step").agg(F.count("*").alias("n"))
    z = F.col("step") / F.lit(float(STEPS))
    t = 1 / (1 - 0.2316419 * z)  # z is at most 0
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    of = Window.partitionBy("length")
    ranked = steps.select("length", "step", tail.alias("p"), F.sum("n").over(of.orderBy("step")).alias("upto"), F.sum("n").over(of).alias("all"))
    best = ranked.where(F.col("p") <= false_share * F.col("upto") / F.col("all")).groupBy("length").agg(F.max("step").alias("step"))
    return {r.length: r.step for r in best.collect()}  # four rows at most


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text", false_share: float = 0.01) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of each row.

    spans lists all secrets as kind:start:stop, in characters, stop exclusive, by start, then kind (assign, access, hex, random); base_sha256 is the digest of that list
    without the random ones, which lie outside the others. Null and empty texts have none: zeros, the digest of nothing, an empty list. Equal texts get equal results; rows
    are judged one by one, also repeated ones; columns besides key and text are left out. Texts of any length are read whole; bytes that aren't UTF-8 count as one
    character that no pattern holds. An empty table gives none.
    """
    read = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = read.select("*", matches(F.col("text"), ASSIGN, 2, VALUE, masked=True).alias("a"), matches(F.col("text"), ACCESS)["spans"].alias("access"), matches(F.col("text"), HEX)["spans"].alias("hex"))
    rest = F.col("a.rest")
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        rest = F.when(F.size(kind) > 0, matches(rest, pattern, masked=True)["rest"]).otherwise(rest)
    masked = named.select("key", F.col("a.spans").alias("assign"), "access", "hex", rest.alias("rest"))
    plain = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))
    base = F.array_sort(F.concat(*[plain(F.col(name), k) for k, name in enumerate(KINDS[:3])]))
    made = stored(masked.select("key", base.alias("base"), candidates(F.col("rest")).alias("candidates")), "secrets")
    at_most = limits(made, "candidates", false_share)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["stop"])), ",")

    def chosen(c: Column) -> Column:
        ok = F.lit(False)
        for length, step in at_most.items():
            ok = ok | ((c["length"] == length) & (c["step"] <= step))
        return ok & c["uniform"]

    random = plain(F.filter("candidates", chosen), 3)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return made.select(
        F.col("key").alias(key), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", random))).alias("spans"),
    )
