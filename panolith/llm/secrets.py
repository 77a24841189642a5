"""Secret scans: assignment, access-key and hexadecimal patterns, and a randomness test battery.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.session import written

#: The kinds in their order, with pattern, group that must be long enough, and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Strings that the battery tests.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Those that are a hex or access span from end to end. A shorter span inside such a string doesn't hold it.
NAMED = r"^(?:[0-9a-f]{24,}|AKIA[A-Z0-9]{16,})$"

#: Alphabets from small to large, with the chance that two characters of ordinary
#: text in that alphabet are equal.
ENCODINGS = (
    ("0123456789", 0.200),
    ("0123456789abcdef", 0.120),
    ("0123456789ABCDEF", 0.120),
    ("abcdefghijklmnopqrstuvwxyz", 0.066),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.066),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.064),
    ("abcdefghijklmnopqrstuvwxyz0123456789", 0.062),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.062),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.060),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.058),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.058),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.058),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.058),
)
#: Lengths that start a band with a false-discovery control of its own, and steps of -log10 p.
BANDS, STEPS, LAST_STEP = (20, 28, 40, 64), 20, 600


#: Numbers summed at a time; see `running`.
RUN = 64
#: Fixed values, measured on prose without its blanks in strings of 20 to 50 letters: the mean of the runs
#: and of minus the serial statistic over the root of the length, and their deviation.
DRIFT, SPREAD = 0.085, 1.1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column, levels: int = 2) -> Column:
    """For each number of the array the sum of those before it.

    Sums of runs of RUN numbers are added up first (by the same rule), so that the work is
    in proportion to the numbers.
    """

    def total(a: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, start, n), F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        if not levels:
            return F.transform(a, lambda _, i: total(a, F.lit(1), i))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda r: total(a, r * RUN + 1, F.lit(RUN)))
        return let(running(runs, levels - 1), lambda before: F.transform(a, lambda _, i: F.get(before, F.floor(i / RUN).cast("int")) + total(a, i - i % RUN + 1, i % RUN)))

    return let(lengths, sums)


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """array<struct<start, end, kind, token>> of the pattern's matches with a long enough group.

    Spark gives matches without places; the pieces between them, from a split at the same
    pattern, add up to the places. Texts without a match are not split.
    """
    pieces = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("part"),
    )

    def build(p: Column) -> Column:
        steps = F.transform(p["whole"], lambda m, i: (F.length(F.get(p["gaps"], i)) + F.length(m)).cast("long"))

        def one(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(p["gaps"], i))
            n = F.length(F.get(p["part"], i)) if group else F.length(m)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("token"), n.alias("n"))

        return let(running(steps), lambda before: F.transform(p["whole"], lambda m, i: one(m, i, before)))

    kept = F.transform(F.filter(let(pieces, build), lambda x: x["n"] >= least), lambda x: F.struct(x["start"], x["end"], x["kind"], x["token"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,token:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / (2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def randomness(token: Column) -> Column:
    """How likely ordinary text of this length would look as random as the token.

    The smallest alphabet that holds all characters is the encoding. Three statistics have a p
    under ordinary text each: chi-squared against uniform use of the alphabet, which the repeats
    of text make larger; runs above and below the middle of the alphabet, of which text has
    more; and the correlation of neighbours, which is lower in text. Fisher's method combines
    them. Runs and correlation must also fit a random string (either p at least 0.001), so
    that sequences and repeats, unlike text as they are, don't pass; else the result is 1.
    """
    chars = F.split(token, "")
    encodings = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(k).alias("kappa")) for a, k in ENCODINGS])
    encoding = F.get(F.filter(encodings, lambda e: F.length(F.call_function("translate", token, e["a"], F.lit(""))) == 0), 0)

    def battery(e: Column) -> Column:
        return let(F.transform(chars, lambda c: F.call_function("instr", e["a"], c).cast("double")), lambda v: tests(v, F.length(e["a"]).cast("double"), e["kappa"]))

    def tests(v: Column, size: Column, kappa: Column) -> Column:
        n = F.size(v).cast("double")
        # Equal characters stand together once sorted; the k-th of a run adds k^2 - (k - 1)^2.
        none = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

        def add(s: Column, x: Column) -> Column:
            run = F.when(s["last"] == x, s["run"] + 1.0).otherwise(1.0)
            return F.struct(x.alias("last"), run.alias("run"), (s["sum"] + 2.0 * run - 1.0).alias("sum"))

        squares = F.aggregate(F.array_sort(v), none, add, lambda s: s["sum"])
        chi = squares * size / n - n
        extra = n * (size * kappa - 1)
        p_chi = normal_tail((size - 1 + extra - chi) / F.sqrt(2 * (size - 1 + 2 * extra)))
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v)).alias("b"))
        middle = (size + 1) / 2
        high = F.size(F.filter(v, lambda x: x > middle)).cast("double")
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle))).cast("double")
        expected = 2 * high * (n - high) / n + 1
        spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        both = let(
            mean,
            lambda m: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - m) * (p["b"] - m))
            / F.greatest(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.lit(1e-9)),
        )
        z = F.struct(((runs - expected) / F.sqrt(spread)).alias("runs"), ((both + 1 / n) * F.sqrt(n)).alias("pairs"), p_chi.alias("chi"))

        def combined(z: Column) -> Column:
            drift = DRIFT * F.sqrt(n)
            p_runs, p_pairs = normal_tail((drift - z["runs"]) / SPREAD), normal_tail((z["pairs"] + drift) / SPREAD)
            log = -F.log(F.greatest(z["chi"], F.lit(1e-30))) - F.log(F.greatest(p_runs, F.lit(1e-30))) - F.log(F.greatest(p_pairs, F.lit(1e-30)))
            fits = (2 * normal_tail(F.abs(z["runs"])) >= 0.001) & (2 * normal_tail(F.abs(z["pairs"])) >= 0.001)
            return F.when(fits, let(log, lambda x: F.exp(-x) * (1 + x + x * x / 2))).otherwise(F.lit(1.0))

        return let(z, combined)

    return F.coalesce(let(encoding, battery), F.lit(1.0))


def step_of(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * STEPS), F.lit(LAST_STEP)).cast("int")


def scan_secrets(docs: DataFrame, text: str = "text", false_share: float = 0.05) -> DataFrame:
    """`docs` without `text`, with `secrets`: array<struct<start, end, kind>> by start, then kind.

    Kinds are assign, access and hex (see KINDS, leftmost non-overlapping each) and random: strings
    of 20 or more characters of an encoding that pass the battery of `randomness`. Places count
    code points, the end is exclusive. A candidate that is a hex or access span is not repeated.

    The p of all candidates of the corpus go through a Benjamini-Hochberg control of
    `false_share` in each band of lengths, on a table of 600 steps of p per band, so
    short strings, which can't look convincingly random, don't borrow from long ones.

    Work is in proportion to a text's length and matches (see `running`), so a log of a hundred
    thousand digests is one row like any other. Null and empty texts have no spans. Rows are scanned each by itself, repeated ones alike; an
    input column named secrets is replaced; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "secrets")]
    place = lambda s: F.struct(s["start"], s["end"], s["kind"])
    base = F.concat(*[F.transform(spans_of(body, pattern, group, least, kind), place) for kind, pattern, group, least in KINDS])
    tested = F.transform(
        spans_of(body, CANDIDATE, 0, BANDS[0], "random"),
        lambda s: F.struct(
            s["start"], s["end"], (s["end"] - s["start"]).alias("n"), step_of(randomness(s["token"])).alias("step"), F.regexp_like(s["token"], F.lit(NAMED)).alias("named")
        ),
    )
    seen = written(docs.select(*rest, base.alias("__base"), tested.alias("__tested")), "secret_candidates")
    band = F.lit(0)
    for i, low in enumerate(BANDS):
        band = F.when(F.col("n") >= low, F.lit(i)).otherwise(band)
    counted = seen.select(F.explode("__tested").alias("t")).select("t.*").groupBy(band.alias("band"), "step").count().collect()
    passing = false_discovery_steps([tuple(r) for r in counted], false_share)

    def accepted(t: Column) -> Column:
        ok = F.lit(False)
        for i, low in enumerate(BANDS):
            high = BANDS[i + 1] if i + 1 < len(BANDS) else 1 << 40
            ok = ok | ((t["n"] >= low) & (t["n"] < high) & (t["step"] >= passing[i]))
        return ok

    random = F.filter("__tested", lambda t: accepted(t) & ~t["named"])
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    order = F.array_sort(
        F.transform(F.concat("__base", random), lambda s: F.struct(s["start"], kind_rank(s["kind"]).alias("k"), s["end"], s["kind"]))
    )
    spans = F.transform(order, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return seen.select(*rest, spans.alias("secrets"))


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, (name, *_) in enumerate(KINDS):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def false_discovery_steps(counted: list[tuple[int, int, int]], share: float) -> list[int]:
    """For each band the least step that passes: the largest p with p m <= share times those at or under p."""
    out = []
    for band in range(len(BANDS)):
        steps = sorted(((s, n) for b, s, n in counted if b == band), reverse=True)
        m, found, least = sum(n for _, n in steps), 0, LAST_STEP + 1
        for step, n in steps:
            found += n
            if 10 ** (-step / STEPS) * m <= share * found:
                least = step
        out.append(least)
    return out


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
