"""From one text to its lines, blocks, sentences and words.

Everything here is a per-row column expression: a document never has to be
shuffled to be split, so the whole text stage is one narrow pass over the scan.
Arrays are exploded only by the jobs whose result is one row per item.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import vocabulary as V
from tessera.functions.scalar import find_all, let

CUT = "\ue000"  # private-use characters: where to cut, and a kept full stop
STOP = "\ue001"
HEADING_LINE = r"(^|\n)[^\S\n]*(#)"
LIST_ITEM = r"^(?:[-*•]\s+|\d+\.\s+)"
LIST_ITEM_LINE = r"(^|\n)((?:[-*•]|\d+\.)[^\S\n]+[^\n]*)"
SENTENCE_CUT = r"([.!?])\s+([A-Z])"
LOOSE_CUT = r"([.!?])\s+"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_MIN_CHARS = 30


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def replace_if(text: Column, needle: str, pattern: str, by: str) -> Column:
    """Replace only in texts that hold the needle at all; a scan is cheaper than a regex."""
    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, by)).otherwise(t),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def spaced_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def cut_sentences(text: Column) -> Column:
    """Cut after `.`, `!` or `?` where white space and a capital follow."""
    return F.split(F.regexp_replace(text, SENTENCE_CUT, f"$1{CUT}$2"), CUT)


def cut_loosely(text: Column) -> Column:
    """Cut after `.`, `!` or `?` at any white space."""
    return F.split(F.regexp_replace(text, LOOSE_CUT, f"$1{CUT}"), CUT)


def sections(text: Column) -> Column:
    """array<struct<heading, headed, part>>: the text cut before each heading line.

    What stands before the first heading comes first, under an empty heading.
    (A lambda must not refer to a costly outer expression: it would be computed
    again for every element. So each step hands on only what the next one needs.)"""
    parts = F.split(
        F.regexp_replace(F.concat(F.lit("\n"), text), r"\n[^\S\n]*#", f"{CUT}#"), CUT
    )

    def section(part: Column) -> Column:
        headed = F.startswith(part, F.lit("#"))
        return F.struct(
            F.when(headed, F.regexp_replace(strip(F.substring_index(part, "\n", 1)), r"^#+\s*", ""))
            .otherwise("")
            .alias("heading"),
            headed.alias("headed"),
            F.regexp_replace(part, r"^\n", "").alias("part"),
        )

    return F.transform(F.filter(parts, lambda p: p != ""), section)


def lines(sections_: Column) -> Column:
    """array<struct<line, kind, heading>>, kind: blank / heading / list / text."""

    def section_lines(s: Column) -> Column:
        return F.transform(
            F.transform(F.split(s["part"], "\n"), strip),
            lambda line, i: F.struct(
                line.alias("line"),
                F.when(s["headed"] & (i == 0), "heading")
                .when(line == "", "blank")
                .when(line.rlike(LIST_ITEM), "list")
                .otherwise("text")
                .alias("kind"),
                s["heading"].alias("heading"),
            ),
        )

    return F.flatten(F.transform(sections_, section_lines))


def blocks(sections_: Column) -> Column:
    """array<struct<heading, block>>: paragraphs with wrapped lines joined; list
    items are blocks of their own."""

    def section_blocks(s: Column) -> Column:
        body = F.when(s["headed"], F.regexp_replace(s["part"], r"^[^\n]*", "")).otherwise(s["part"])
        body = F.regexp_replace(strip(body), r"[^\S\n]*\n[^\S\n]*", "\n")
        body = F.regexp_replace(body, LIST_ITEM_LINE, "$1\n\n$2\n\n")
        pieces = F.transform(
            F.split(body, r"\n\n+"), lambda p: F.regexp_replace(strip(p), r"\n", " ")
        )
        return F.transform(
            F.filter(pieces, lambda p: p != ""),
            lambda p: F.struct(s["heading"].alias("heading"), p.alias("block")),
        )

    return F.flatten(F.transform(sections_, section_blocks))


def sentences(blocks_: Column) -> Column:
    """array<struct<heading, para_no, sentence>> of sentences over 30 characters."""

    def block_sentences(b: Column, para_no: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(b["block"], r"^[-*•]\s+", ""), r"^\d+\.\s+", "")
        kept = F.filter(
            F.transform(cut_sentences(text), strip), lambda s: F.length(s) > SENTENCE_MIN_CHARS
        )
        return F.transform(
            kept,
            lambda s: F.struct(
                b["heading"].alias("heading"), para_no.alias("para_no"), s.alias("sentence")
            ),
        )

    return F.flatten(F.transform(blocks_, block_sentences))


def drop_headings_and_tables(text: Column) -> Column:
    no_headings = replace_if(text, "#", r"(?md)^#{1,6}\s+.*$", "")
    return replace_if(no_headings, "|", r"\|[^\n]+\|", "")


def plain_sentences(text: Column) -> Column:
    """array<string>: markdown removed, abbreviations kept whole, five words or more."""
    clean = replace_if(drop_headings_and_tables(text), "*", r"\*+", "")
    clean = replace_if(clean, "](", r"\[([^\]]+)\]\([^)]+\)", "$1")
    guarded = F.regexp_replace(clean, V.ABBREVIATION, f"$1{STOP}")
    pieces = F.transform(
        cut_sentences(guarded), lambda s: F.translate(strip(s), STOP, ".")
    )
    return F.filter(
        pieces,
        lambda s: (F.regexp_count(s, F.lit(r"\S+")) >= 5)
        & ~F.contains(F.lower(s), F.lit("word count")),
    )


def content_words(text: Column) -> Column:
    return F.filter(find_all(F.lower(text), r"[a-z]{3,}"), lambda w: ~w.isin(V.STOP_WORDS))


def style_tokens(text: Column) -> Column:
    plain = replace_if(text, "#", r"#{1,6}\s+", "")
    plain = replace_if(plain, "**", r"\*\*([^*]+)\*\*", "$1")
    plain = replace_if(plain, "*", r"\*([^*]+)\*", "$1")
    plain = replace_if(plain, "`", r"`([^`]+)`", "$1")
    plain = replace_if(plain, "](", r"\[([^\]]+)\]\([^)]+\)", "$1")
    return find_all(F.lower(plain), r"[a-zA-Z']+")


def minor_headings(text: Column) -> Column:
    """Titles of `##` and `###` lines, emphasis removed."""
    heads = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(r"^###? "))
    names = F.transform(
        heads,
        lambda h: strip(F.regexp_replace(strip(F.regexp_replace(h, r"^#+\s*", "")), r"\*+", "")),
    )
    return F.filter(names, lambda n: n != "")


def section_bodies(text: Column) -> Column:
    """array<string>: what stands under each `##` or `###` line."""
    marked = F.regexp_replace(text, r"(^|\n)[^\S\n]*(###? )", f"$1{CUT}$2")
    parts = F.split(marked, CUT)
    return F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: strip(F.regexp_replace(p, r"^[^\n]*", "")),
    )
