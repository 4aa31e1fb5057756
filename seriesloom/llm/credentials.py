"""Secret scans with built-in functions only: base patterns, and windowed entropy of candidate strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import unused

ASSIGN, ACCESS, HEX, ENTROPY = KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
#: Runs of these lengths at least are what a greedy run that is dropped when it is shorter leaves.
_ACCESS = r"(AKIA[A-Z0-9]{12,})"
_HEX = r"([0-9a-f]{32,})"
_RUN = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"
VALUE_CHARS = 8

#: Characters of the sliding window, and bits of entropy by class from which a window is suspicious.
WINDOW = 20
LIMITS = {"hex": 3.0, "letters and digits": 3.6, "base64": 3.8}
#: Candidates that are left alone, whatever their entropy.
ALLOWED = (
    r"(?i)example", r"(?i)sample", r"(?i)placeholder", r"(?i)changeme", r"(?i)x{6}", r"(?i)redacted", r"(?i)dummy", r"(?i)lorem",
    r"(.)\1{5}", r"0123456789", r"(?i)abcdefgh", r"(?i)qwerty", r"(?i)^sha(1|256|384|512)-",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: A candidate has a part of this many characters without / _ = - in it; paths and identifiers have not.
PART = 16
BLOCK = 256


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Sums of the elements before each element; in blocks, so that long arrays are not copied for each element."""
    sums = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int")), lambda k: sums(F.slice(a, k * BLOCK + 1, F.lit(BLOCK))))
    first = lambda a, n: F.slice(a, F.lit(1), n)
    shifted = lambda blocks: F.zip_with(
        blocks, first(sums(F.transform(blocks, lambda b: F.element_at(b, -1))), F.size(blocks)),
        lambda b, s: F.transform(first(b, F.size(b) - 1), lambda x: x + s),
    )
    some = lambda a: F.when(F.size(a) > 0, F.flatten(bound(cut(a), shifted))).otherwise(F.array().cast("array<int>"))
    return bound(lengths, some)


def places(df: DataFrame, text: str, pattern: str, gate: Column, groups: dict[str, int], name: str) -> tuple[DataFrame, str]:
    """Add a column of all leftmost non-overlapping matches: array of structs of start, end (code points) and ``groups``.

    Every match is taken together with the text since the last one; lengths then give places.
    Texts that ``gate`` excludes get an empty array without the search.
    """
    full = rf"(?s)\G(.*?){pattern}"
    found = lambda k: F.when(gate, F.regexp_extract_all(F.col(text), F.lit(full), F.lit(k))).otherwise(F.array().cast("array<string>"))
    parts = {k: unused(f"{name} {k}", df) for k in (1, 2, *groups.values())}
    df = df.withColumns({column: found(k) for k, column in parts.items()})
    gap, match = (F.transform(F.col(parts[k]), lambda s: F.length(s)) for k in (1, 2))
    before, sizes = unused(f"{name} before", df), unused(f"{name} sizes", df)
    df = df.withColumn(sizes, F.arrays_zip(gap.alias("gap"), match.alias("match")))
    df = df.withColumn(before, running(F.transform(sizes, lambda x: x["gap"] + x["match"])))
    out = unused(name, df)
    texts = [F.col(parts[k]).alias(g) for g, k in groups.items()]
    zipped = F.arrays_zip(F.col(before).alias("before"), F.col(sizes).alias("sizes"), *texts)
    df = df.withColumn(
        out,
        F.transform(
            zipped,
            lambda z: F.struct(
                (z["before"] + z["sizes"]["gap"]).alias("start"), (z["before"] + z["sizes"]["gap"] + z["sizes"]["match"]).alias("end"),
                *[z[g].alias(g) for g in groups],
            ),
        ),
    )
    return df.drop(before, sizes, *parts.values()), out


def window_entropy(text: Column) -> Column:
    """Largest Shannon entropy (bits) of WINDOW consecutive ASCII characters, from counts that each step changes by two.

    H = log2(w) - sum(c log2 c) / w.  A step adds the character that enters and removes the one
    that leaves; only their two terms of the sum change.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), lambda a, b: F.struct(F.coalesce(a, F.lit(-1)).alias("a"), b.alias("b")))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(state, x):
        count = lambda c: F.when(c >= 0, F.element_at(state["counts"], c + 1)).otherwise(0)
        moved = x["a"] != x["b"]
        add, remove = count(x["a"]), count(x["b"])
        total = state["sum"] + F.when(
            moved, F.when(x["a"] >= 0, term(add + 1) - term(add)).otherwise(0.0) + F.when(x["b"] >= 0, term(remove - 1) - term(remove)).otherwise(0.0)
        ).otherwise(0.0)
        counts = F.transform(
            state["counts"], lambda c, k: c + F.when(moved & (k == x["a"]), 1).otherwise(0) - F.when(moved & (k == x["b"]), 1).otherwise(0)
        )
        n = state["n"] + F.when(x["a"] >= 0, 1).otherwise(0)
        full = (n >= WINDOW) & (x["a"] >= 0)
        best = F.when(full, F.greatest(state["best"], F.log2(F.lit(float(WINDOW))) - total / WINDOW)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), best.alias("best"))

    return F.aggregate(steps, start, step, lambda s: s["best"])


def suspicious(text: Column) -> Column:
    """Whether a candidate's windowed entropy reaches the limit of its character class and no allow-list entry covers it."""
    digit, letter = text.rlike("[0-9]"), text.rlike("[A-Za-z]")
    limit = (
        F.when(text.rlike("^([0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"]).when(text.rlike("^[0-9A-Za-z]+$"), LIMITS["letters and digits"]).otherwise(LIMITS["base64"])
    )
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    plain = digit & letter & text.rlike(rf"[A-Za-z0-9+]{{{PART}}}") & ~allowed
    return F.when(plain, window_entropy(text) >= limit).otherwise(False)


def secret_spans(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row and base and spans, arrays of struct<start int, rank int, end int, kind string>.

    ``base``: assignments with a value of 8 characters or more, access keys of 16 or more, and
    runs of 32 or more hexadecimal digits, found leftmost and non-overlapping for each kind.
    ``spans``: these and runs of 20 or more characters of [A-Za-z0-9+/_=-] that hold letters and
    digits, whose windowed entropy reaches the limit of their class, that are on no allow-list and
    in no base span.  Both by start, then kind.  Places are code points, ends exclusive.

    Whole texts.  Null and empty texts: empty arrays.  Repeated rows and null ids: a row each.
    Empty table: no rows.  Carried columns may have any names; added ones get underscores then.
    """
    text = unused("whole text", docs.select(*carry))
    names = [unused(x, docs.select(*carry)) for x in ("base", "spans")]
    df = docs.select(*carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    t = F.col(text)
    signs = t.contains("=") | t.contains(":")
    df, assign = places(df, text, _ASSIGN, signs & t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), {"value": 3}, ASSIGN)
    df, access = places(df, text, _ACCESS, t.contains("AKIA"), {}, ACCESS)
    df, hexa = places(df, text, _HEX, t.rlike(_HEX), {}, HEX)
    df, run = places(df, text, _RUN, t.rlike(_RUN), {"run": 2}, ENTROPY)
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(KINDS[k]).alias("kind"))
    long_enough = F.filter(assign, lambda x: F.length(x["value"]) >= VALUE_CHARS)
    df = df.withColumn(names[0], F.array_sort(F.concat(F.transform(long_enough, span(0)), F.transform(access, span(1)), F.transform(hexa, span(2)))))
    apart = lambda x: ~F.exists(names[0], lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    more = F.filter(F.filter(run, apart), lambda x: suspicious(x["run"]))
    df = df.withColumn(names[1], F.array_sort(F.concat(F.col(names[0]), F.transform(more, span(3)))))
    return df.select(*carry, *names)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document as places."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    number = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"),
    )
