"""Patterns are written once, in the dialect in which \\b, \\w and \\d are ASCII, and rewritten for Java where the two differ."""

from __future__ import annotations

_WORD = "0-9A-Za-z_"


def java(pattern: str) -> str:
    """An equivalent for Java's regex: \\b as an ASCII word boundary, \\s without the vertical tab."""
    boundary = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(boundary)
            i += 2
        elif two == r"\s":
            out.append(r"\t\n\f\r " if inside else r"[\t\n\f\r ]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def sql_text(x: str) -> str:
    """A string as a DuckDB literal."""
    return "'" + x.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(map(sql_text, xs)) + "]"
