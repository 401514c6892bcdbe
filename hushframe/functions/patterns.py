"""Users' regular expressions: one dialect, one engine, a limit of time.

Patterns may be written as for .NET or Java: named groups with back references, classes with intersection or subtraction,
quoted stretches. They run in Python's regex module, which alone can stop a search; what it calls differently is translated.
"""

from __future__ import annotations

import re
from functools import cache

import regex

#: Seconds that one text may take.
SECONDS = 0.25
_REFERENCE = re.compile(r"\\k(?:<(\w+)>|\{(\w+)\}|'(\w+)')")
_POINT = re.compile(r"\\x\{([0-9A-Fa-f]{1,6})\}")
_QUOTED = re.compile(r"\\Q(.*?)(?:\\E|\Z)", re.DOTALL)


def _escape(pattern: str, at: int, in_class: bool) -> tuple[str, int]:
    """What stands for the escape at a place, and where it ends."""
    if not in_class and (m := _REFERENCE.match(pattern, at)):
        name = m[1] or m[2] or m[3]
        return (f"(?:\\{name})" if name.isdigit() else f"(?P={name})"), m.end()
    if m := _POINT.match(pattern, at):
        return f"\\U{int(m[1], 16):08x}", m.end()
    if m := _QUOTED.match(pattern, at):
        return regex.escape(m[1]), m.end()
    if not in_class and pattern.startswith(r"\Z", at):
        return r"(?=\n?\Z)", at + 2
    if not in_class and pattern.startswith(r"\z", at):
        return r"\Z", at + 2
    return pattern[at : at + 2], at + 2


def _class(pattern: str, at: int) -> tuple[str, int, bool]:
    """The translated class that opens at a place, where it ends, and whether it holds another one."""
    out, sets, i = ["["], False, at + 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    first = i
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and i > first:
            return "".join([*out, "]"]), i + 1, sets
        if c == "\\":
            text, i = _escape(pattern, i, True)
            out.append(text)
        elif pattern.startswith("&&", i):
            out.append("&&")
            i, sets = i + 2, True
            if pattern.startswith("[", i):
                text, i, _ = _class(pattern, i)
                out.append(text)
        elif pattern.startswith("-[", i) and i > first:
            text, i, _ = _class(pattern, i + 1)
            out.append("--" + text)
            sets = True
        elif pattern.startswith("[:", i) and ":]" in pattern[i:]:
            end = pattern.index(":]", i) + 2
            out.append(pattern[i:end])
            i = end
        else:
            out.append("\\" + c if c in "[|~" else c)
            i += 1
    return "".join(out), i, sets


@cache
def compiled(pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> regex.Pattern:
    """A user's pattern as it runs; regex.error if it is none."""
    out, sets, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            text, i = _escape(pattern, i, False)
        elif pattern[i] == "[":
            text, i, inner = _class(pattern, i)
            sets = sets or inner
        elif m := re.compile(r"\(\?'(\w+)'").match(pattern, i):
            text, i = f"(?<{m[1]}>", m.end()
        else:
            text, i = pattern[i], i + 1
        out.append(text)
    whole = "".join(out)
    if whole_word:
        whole = rf"(?<!\w)(?:{whole})(?!\w)"
    # Classes in classes need the newer rules of the module, whose wider folding of cases is left out.
    flags = regex.IGNORECASE * (not case_sensitive)
    return regex.compile(f"(?-f:{whole})", flags | regex.V1) if sets else regex.compile(whole, flags)


def problem(pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> str | None:
    """Why a pattern cannot be a rule, or None."""
    try:
        hit = compiled(pattern, case_sensitive, whole_word).search("", timeout=SECONDS)
    except (regex.error, ValueError, OverflowError):
        return "The pattern is not a regular expression."
    except TimeoutError:
        return "The pattern is too slow."
    return "The pattern matches empty text." if hit else None


def matches(pattern: regex.Pattern, text: str) -> list[tuple[int, str]]:
    """(start, text) of the matches of something, in order; none at all if the text takes too long."""
    try:
        return [(m.start(), m[0]) for m in pattern.finditer(text, timeout=SECONDS) if m[0]]
    except TimeoutError:
        return []
