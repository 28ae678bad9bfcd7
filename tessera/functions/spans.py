"""Marker hits with character offsets, and the test for played-down risks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import vocabulary as V
from tessera.functions.patterns import any_of, quick
from tessera.functions.scalar import has, let

OPEN, CLOSE = "\ue000", "\ue001"
SPANS = "array<struct<marker:string,start:int,end:int>>"


def normal_marker(marker: Column) -> Column:
    return F.regexp_replace(F.lower(marker), r"\s+", " ")


#: Items of a block in running sums; a list that grows is copied at each step, so none grows longer.
BLOCK = 128

# The two functions below are wanted dozens of times in one plan. Their bodies are the same each
# time, so they are written as text, which costs the driver one call instead of a hundred.
_NOTHING = "cast(array() AS array<int>)"


def _scan(items: str) -> str:
    """The sum of some items, and the sums before each of them."""
    return (
        f"aggregate({items}, named_struct('sum', 0, 'before', {_NOTHING}), "
        "(acc, x) -> named_struct('sum', acc.sum + x, 'before', array_append(acc.before, acc.sum)))"
    )


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str) -> str:
    shifted = "transform(blocks, (b, k) -> transform(b.before, y -> y + element_at(offsets.before, k + 1)))"
    over = _let("offsets", _scan("transform(blocks, c -> c.sum)"), f"array_append(flatten({shifted}), offsets.sum)")
    begins = f"if(size(items) > 0, sequence(0, size(items) - 1, {BLOCK}), {_NOTHING})"
    blocks = f"transform({begins}, i -> {_scan(f'slice(items, i + 1, {BLOCK})')})"
    return _let("items", values, _let("blocks", blocks, over))


_SUMS = f"values -> {_running('values')}"
_LENGTHS = "transform(parts, (p, j) -> length(p) - if(j = 0, 0, 1))"
_HIT = (
    f"(piece, n) -> named_struct('marker', substring_index(piece, '{CLOSE}', 1), 'start', element_at(starts, n + 2), "
    f"'end', element_at(starts, n + 2) + length(substring_index(piece, '{CLOSE}', 1)))"
)
_MARKED = f"transform(slice(parts, 2, size(parts)), {_HIT})"
_SPANS = f"parts -> if(size(parts) > 1, {_let('starts', _running(_LENGTHS), _MARKED)}, cast(array() AS {SPANS}))"


def _applied(value: Column, body: str) -> Column:
    """The body, a function written as text, of the value, which is computed once."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(body)), 1)


def running_sums(values: Column) -> Column:
    """The sum of all values before each one and, last, of all; in time that grows with their number."""
    return _applied(values, _SUMS)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<marker, start, end>> of all hits, offsets counted from 0.

    The hits are fenced in the text, the text is cut at the fences, and the
    lengths of the pieces are summed up."""
    return _applied(F.split(F.regexp_replace(text, quick(pattern), f"{OPEN}$0{CLOSE}"), OPEN), _SPANS)


#: Where a text is cut into clauses: before the white space after a stop. No marker reaches over
#: such a place, and a word ends and begins there whether the other side is seen or not.
CLAUSE_CUT = r"(?=\s)(?<=[.,;:!?])"


def _holds_any(patterns) -> str:
    union = any_of(tuple(patterns))
    if union is None:
        raise ValueError("a pattern does not begin at a word")
    return union


def marked_text(text: Column, patterns) -> Column:
    """The clauses that hold a marker of one of the patterns, in one string; the others hold none.

    Each pattern has as many matches in it as in the text, which only one pass has to read."""
    union = _holds_any(patterns)
    return F.array_join(F.filter(F.split(text, CLAUSE_CUT), lambda p: p.rlike(union)), "")


def marked_clauses(text: Column, patterns) -> Column:
    """array<struct<text, at>>: the clauses that hold a marker of one of the patterns, and where they begin."""
    union = _holds_any(patterns)

    def placed(parts: Column) -> Column:
        starts = running_sums(F.transform(parts, lambda p: F.length(p)))
        return let(starts, lambda at: F.transform(parts, lambda p, k: F.struct(p.alias("text"), at[k].alias("at"))))

    return F.filter(let(F.split(text, CLAUSE_CUT), placed), lambda p: p["text"].rlike(union))


def spans_in(clauses: Column, pattern: str) -> Column:
    """spans() of the text that the marked clauses are taken from."""

    def inside(clause: Column) -> Column:
        hits = let(clause["text"], lambda t: spans(t, pattern))
        moved = lambda h: F.struct(
            h["marker"].alias("marker"), (h["start"] + clause["at"]).alias("start"), (h["end"] + clause["at"]).alias("end")
        )
        return F.transform(hits, moved)

    return F.coalesce(F.flatten(F.transform(clauses, inside)), F.array().cast(SPANS))


def before(text: Column, start: Column, width: int) -> Column:
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


def dismissed(text: Column, span: Column) -> Column:
    """Is the hit played down or denied within its own sentence?"""
    ahead = F.regexp_replace(
        before(text, span["start"], V.DIMINISHER_BEFORE), r"(?s)^.*(?:\. |\.\n|\? |! )", ""
    )
    rest = F.substring(text, span["end"] + 1, F.lit(V.DIMINISHER_AFTER_MAX))
    behind = F.when(
        rest.rlike(r"[.!?]\s"), F.regexp_extract(rest, r"(?s)^(.*?)[.!?]\s", 1)
    ).otherwise(F.substring(rest, 1, V.DIMINISHER_AFTER))
    denied = has(before(text, span["start"], V.NEGATION_WINDOW), V.NEGATION_BEFORE)
    return has(ahead, V.DIMINISHER) | has(behind, V.DIMINISHER) | denied
