"""Spell a Python-flavoured regular expression for the JVM matcher.

Rules and schema patterns are written in Python's dialect, whose ``\\b \\d \\w
\\s`` are Unicode-aware.  The JVM's own Unicode mode differs in corner cases
(combining marks, superscript digits), so the classes are spelled out.
"""

from __future__ import annotations

# Python's str.isspace(), as the inside of a JVM character class.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters one by one, for trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Python's \w: letters, every kind of number, underscore.
WORD = r"\p{L}\p{N}_"

BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NOT_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"

_OUTSIDE = {
    "b": BOUNDARY,
    "B": NOT_BOUNDARY,
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "w": f"[{WORD}]",
    "W": f"[^{WORD}]",
    "Z": r"\z",
}
_INSIDE = {
    "b": r"\x08",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": SPACE,
    "S": f"[^{SPACE}]",
    "w": WORD,
    "W": f"[^{WORD}]",
}


def jvm_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for ``regexp_*``/``rlike``; ``\\n`` is the only line end."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, ch + nxt))
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":  # nested classes and intersections do not exist in Python
                out.append("\\")
            out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):  # a leading ] is literal
                out.append(r"\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4:end]}>")
            i = end + 1
            continue
        out.append(ch)
        i += 1
    return ("(?diu)" if ignore_case else "(?d)") + "".join(out)
