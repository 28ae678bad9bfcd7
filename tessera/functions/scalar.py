"""Small column builders shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.patterns import quick


def rounded(value: Column, digits: int = 0) -> Column:
    """Half-even rounding of a double, in whole-stage code (`rint`)."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """Rounded whole percentage; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(
        F.rint(part / whole * 100).cast("long")
    )


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(quick(pattern))).cast("long")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(quick(pattern))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(quick(pattern)), F.lit(group))


def kilowords(words: Column) -> Column:
    """Thousand words, never below a tenth, so short texts are not inflated."""
    return F.greatest(words / F.lit(1000.0), F.lit(0.1))


def precision_label(n: Column, low: int, adequate: int) -> Column:
    return F.when(n < low, "low").when(n < adequate, "adequate").otherwise("good")


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def let(value: Column, body) -> Column:
    """Compute `value` once and hand it to `body`.

    A lambda variable is evaluated once; an outer expression inside a lambda
    would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_common(a: Column, b: Column, most: Column, end: str) -> Column:
    """How many signs, `most` at most, two texts have in common at an `end`, "left" or "right": a search by halves."""
    halves = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))
    longer = lambda n, k: n + F.pow(F.lit(2.0), k).cast("int")
    same = lambda n: (n <= most) & (F.call_function(end, a, n) == F.call_function(end, b, n))
    return F.aggregate(halves, F.lit(0), lambda n, k: F.when(same(longer(n, k)), longer(n, k)).otherwise(n))


def edit_distance(a: Column, b: Column, limit: Column) -> Column:
    """The edit distance of two texts, -1 beyond the limit; what they begin and end with alike is cut off first."""

    def between(x: Column, head: Column, tail: Column) -> Column:
        return F.substring(x, head + 1, F.length(x) - head - tail)

    def cut(x: Column) -> Column:
        a, b = x["a"], x["b"]
        shorter = F.least(F.length(a), F.length(b))
        return let(
            _in_common(a, b, shorter, "left"),
            lambda head: let(
                _in_common(a, b, shorter - head, "right"),
                lambda tail: F.call_function("levenshtein", between(a, head, tail), between(b, head, tail), limit),
            ),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), cut)


def _begins(sorted_: Column, key) -> Column:
    """The places in a sorted array where a new key begins."""
    places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda k: (k == 0) | (key(sorted_[k]) != key(sorted_[F.greatest(k - 1, F.lit(0))])))


def counted(words: Column) -> Column:
    """array<struct<w, m>>: each distinct word with how often it occurs; one sort, no pairs."""
    return let(
        F.sort_array(words),
        lambda ws: let(
            _begins(ws, lambda w: w),
            lambda at: F.transform(
                at,
                lambda k, j: F.struct(
                    ws[k].alias("w"), (F.coalesce(F.try_element_at(at, j + 2), F.size(ws)) - k).alias("m")
                ),
            ),
        ),
    )


def first_of_each(items: Column, key) -> Column:
    """The items that are the first of their key, in order; those without a key go. One sort, no pairs."""

    def pick(all_: Column) -> Column:
        pairs = F.sort_array(F.transform(all_, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        firsts = let(pairs, lambda ps: F.transform(_begins(ps, lambda p: p["k"]), lambda k: ps[k]))
        places = F.sort_array(F.transform(F.filter(firsts, lambda p: p["k"].isNotNull()), lambda p: p["i"]))
        return F.transform(places, lambda i: all_[i])

    return let(items, pick)


def count_known(words: Column, known: Column) -> Column:
    """How many of the words, repeats included, are among the known ones; one sort, no pairs."""
    flagged = F.concat(
        F.transform(known, lambda w: F.struct(w.alias("w"), F.lit(0).alias("m"))),
        counted(words),
    )
    return let(
        F.sort_array(flagged),
        lambda es: F.aggregate(
            F.filter(es, lambda e, j: (e["m"] > 0) & (j > 0) & (es[F.greatest(j - 1, F.lit(0))]["w"] == e["w"])),
            F.lit(0),
            lambda acc, e: acc + e["m"],
        ),
    )


def total(numbers: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def mean(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, total(numbers) / F.size(numbers))


def equals(value: str):
    """A test for lambdas (their arity counts, so no default arguments there)."""
    return lambda x: x == F.lit(value)
