"""The same pattern, written so that a regex engine turns most places down at their first letter."""

from __future__ import annotations

import functools
import string


def _alternatives(body: str) -> list[str] | None:
    """The alternatives of a pattern at its top level; None if a bracket does not close."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(body):
        c = body[k]
        if c == "\\":
            k += 1
        elif c == "[":
            # `]` may stand first in a class
            k = body.find("]", k + (3 if body[k + 1 : k + 2] == "^" else 2))
            if k < 0:
                return None
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c == "|" and depth == 0:
            out.append(body[start:k])
            start = k + 1
        k += 1
    return [*out, body[start:]] if depth == 0 else None


def _split(body: str) -> tuple[list[str], str] | None:
    r"""`\b(?:a|b)rest` → [a, b], rest;  `\ba|\bb` → [a, b], ``."""
    if body.startswith(r"\b(?:"):
        for end in range(len(body) - 1, 4, -1):
            if body[end] == ")" and (inner := _alternatives(body[5:end])) is not None:
                rest = body[end + 1 :]
                whole = _alternatives(body)
                if whole is not None and len(whole) == 1 and rest[:1] not in ("?", "*", "+", "{"):
                    return inner, rest
    parts = _alternatives(body)
    if parts and all(p.startswith(r"\b") for p in parts):
        return [p[2:] for p in parts], ""
    return None


def _opened(alternative: str) -> list[str]:
    """`(?:a|b)c` → [ac, bc], as deep as groups stand in front."""
    if not alternative.startswith("(?:"):
        return [alternative]
    for end in range(3, len(alternative)):
        if alternative[end] == ")" and (inner := _alternatives(alternative[3:end])) is not None:
            rest = alternative[end + 1 :]
            if alternative[end - 1] == "\\" or rest[:1] in ("?", "*", "+", "{"):
                return [alternative]
            return [x for a in inner for x in _opened(a + rest)]
    return [alternative]


def _tails(pattern: str) -> list[str] | None:
    r"""What may follow the `\b` in front of the pattern, each with a letter first; None if it is not written so."""
    if not pattern.startswith(r"(?i)\b") or "\\" + "1" in pattern:
        return None
    body = pattern[4:]
    groups = [k for k in range(len(body)) if body[k] == "(" and (k == 0 or body[k - 1] != "\\") and body[k + 1 : k + 2] != "?"]
    found = _split(body)
    if groups or found is None:
        return None
    alternatives = [x + found[1] for a in found[0] for x in _opened(a)]
    if any(not a or a[0] not in string.ascii_letters or a[1:2] in ("?", "*", "+", "{") for a in alternatives):
        return None
    return alternatives


@functools.cache
def any_of(patterns: tuple[str, ...]) -> str | None:
    r"""One pattern that matches somewhere in a text if and only if one of the patterns does.

    Their alternatives are sorted by their first two letters, so most places are turned down
    at once; None if one of them does not begin at a word."""
    each = [_tails(p) for p in patterns]
    if any(e is None for e in each):
        return None
    tree: dict[str, dict[str, list[str]]] = {}
    for tail in dict.fromkeys(t for e in each for t in e):
        second = tail[1:2].lower() if tail[1:2] in string.ascii_letters and tail[2:3] not in ("?", "*", "+", "{") else ""
        tree.setdefault(tail[0].lower(), {}).setdefault(second, []).append(tail[1 + len(second) :])
    firsts = []
    for first, by_second in sorted(tree.items()):
        inner = "|".join(f"{second}(?:{'|'.join(tails)})" for second, tails in sorted(by_second.items()))
        firsts.append(f"{first}(?:{inner})")
    return rf"(?i)\b(?=[{''.join(sorted(tree))}])(?:{'|'.join(firsts)})"


@functools.cache
def by_first_letter(pattern: str) -> str:
    r"""`(?i)\b(?:risks?|threats?|rise)\b` → `(?i)(?=[rt])\b(?:r(?:isks?|ise)|t(?:hreats?))\b`.

    Alternatives of different first letters exclude each other, and those of one letter keep
    their order, so the matches are the same. Any other pattern is handed back as it is."""
    if not pattern.startswith(r"(?i)\b") or "\\" + "1" in pattern:
        return pattern
    body = pattern[4:]
    groups = [k for k in range(len(body)) if body[k] == "(" and (k == 0 or body[k - 1] != "\\") and body[k + 1 : k + 2] != "?"]
    found = _split(body)
    if groups or found is None:
        return pattern
    alternatives, rest = [x for a in found[0] for x in _opened(a)], found[1]
    letters: dict[str, list[str]] = {}
    for a in alternatives:
        if a[:1] not in string.ascii_letters or not a or a[1:2] in ("?", "*", "+", "{"):
            return pattern
        letters.setdefault(a[0].lower(), []).append(a[1:])
    each = "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in letters.items())
    return rf"(?i)(?=[{''.join(sorted(letters))}])\b(?:{each}){rest}"


@functools.cache
def quick(pattern: str) -> str:
    """The pattern as an engine finds it soonest: by its first letters, and those asked for after the
    edge of a word, which is there once in some six places.

    Alternatives that may begin inside a word get their first letters in front."""
    if pattern.startswith("(?i)(?:"):
        inside = _opened(pattern[4:])
        if len(inside) > 1 and all(a and a[0] in string.ascii_letters and a[1:2] not in ("?", "*", "+", "{") for a in inside):
            return rf"(?i)(?=[{''.join(sorted({a[0].lower() for a in inside}))}]){pattern[4:]}"
    by_letter = by_first_letter(pattern)
    if by_letter == pattern:
        return pattern
    letters, rest = by_letter[len("(?i)") :].split(r"\b", 1)
    return rf"(?i)\b{letters}{rest}"
