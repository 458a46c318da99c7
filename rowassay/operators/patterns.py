"""Python's regular expressions in Java's syntax.

Rules are written for Python, whose patterns differ from Java's in the names of groups, in what ends a line, in what a word or
digit is, and in flags. So a pattern is read by Python's own reader and written again piece by piece; one that Python refuses,
or that Java has no counterpart for, raises ``UnusablePattern``.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C
from re import _parser


class UnusablePattern(ValueError):
    """The pattern cannot be run."""


_DIGIT = (r"\p{Nd}", "0-9")
_SPACE = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\t-\r\x{20}")
_WORD = (r"\p{L}\p{N}_", "a-zA-Z0-9_")
_CLASSES = {
    C.CATEGORY_DIGIT: (_DIGIT, False), C.CATEGORY_NOT_DIGIT: (_DIGIT, True), C.CATEGORY_SPACE: (_SPACE, False),
    C.CATEGORY_NOT_SPACE: (_SPACE, True), C.CATEGORY_WORD: (_WORD, False), C.CATEGORY_NOT_WORD: (_WORD, True),
}


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() or c in "_ " else f"\\x{{{code:x}}}"


def _class(items, flags: int) -> str:
    """One character out of a list of characters, ranges and categories."""
    ascii_only, negated, singles, others = bool(flags & re.ASCII), False, "", []
    for op, value in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            singles += _char(value)
        elif op is C.RANGE:
            singles += f"{_char(value[0])}-{_char(value[1])}"
        else:
            chars, outside = _CLASSES[value]
            if outside:
                others.append(f"[^{chars[ascii_only]}]")
            else:
                singles += chars[ascii_only]
    # Java negates a list with lists inside in its own way, so those are alternatives
    choices = ([f"[{singles}]"] if singles else []) + others
    one = choices[0] if len(choices) == 1 else f"(?:{'|'.join(choices)})"
    return f"(?:(?!{one})(?s:.))" if negated else one


def _place(where, flags: int) -> str:
    lines, word = bool(flags & re.MULTILINE), f"[{_WORD[bool(flags & re.ASCII)]}]"
    return {
        C.AT_BEGINNING: r"(?:\A|(?<=\n))" if lines else r"\A",
        C.AT_BEGINNING_STRING: r"\A",
        C.AT_END: r"(?=\n|\z)" if lines else r"(?=\n?\z)",
        C.AT_END_STRING: r"\z",
        C.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
        C.AT_NON_BOUNDARY: rf"(?:(?<={word})(?={word})|(?!\A\z)(?<!{word})(?!{word}))",
    }[where]


def _count(low: int, high) -> str:
    known = {(0, C.MAXREPEAT): "*", (1, C.MAXREPEAT): "+", (0, 1): "?"}
    return known.get((low, high)) or (f"{{{low},}}" if high is C.MAXREPEAT else f"{{{low},{high}}}")


def _sequence(parsed, flags: int) -> str:
    return "".join(_piece(op, value, flags) for op, value in parsed)


def _piece(op, value, flags: int) -> str:
    if op is C.LITERAL:
        return _char(value)
    if op is C.NOT_LITERAL:
        return f"[^{_char(value)}]"
    if op is C.ANY:
        return "(?s:.)" if flags & re.DOTALL else r"[^\n]"
    if op is C.IN:
        return _class(value, flags)
    if op is C.AT:
        return _place(value, flags)
    if op is C.BRANCH:
        return f"(?:{'|'.join(_sequence(branch, flags) for branch in value[1])})"
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        return f"(?:{_sequence(inner, flags)}){_count(low, high)}" + {C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}.get(op, "")
    if op is C.SUBPATTERN:
        group, on, off, inner = value
        inside = (flags | on) & ~off
        if on & re.UNICODE:
            inside &= ~re.ASCII
        body = _sequence(inner, inside)
        if (inside ^ flags) & re.IGNORECASE:
            body = f"(?{'' if inside & re.IGNORECASE else '-'}iu:{body})"
        return f"(?:{body})" if group is None else f"({body})"
    if op is C.ATOMIC_GROUP:
        return f"(?>{_sequence(value, flags)})"
    if op in (C.ASSERT, C.ASSERT_NOT):
        direction, inner = value
        return f"(?{'<' if direction < 0 else ''}{'=' if op is C.ASSERT else '!'}{_sequence(inner, flags)})"
    if op is C.GROUPREF:
        return f"(?:\\{value})"
    if op is C.FAILURE:
        return r"(?!)"
    raise UnusablePattern(f"{str(op).lower()} has no counterpart")


@functools.lru_cache(maxsize=4096)
def java_pattern(pattern: str) -> str:
    """A Java pattern that finds a match in exactly the texts in which Python's ``re.search`` does."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as problem:
        raise UnusablePattern(f"unusable pattern: {problem}") from problem
    flags = parsed.state.flags
    body = _sequence(parsed, flags)
    return f"(?iu:{body})" if flags & re.IGNORECASE else body
