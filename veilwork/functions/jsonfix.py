"""Find, repair and parse JSON in reply texts, as Columns.

Every pass is one or two matcher runs over the text.  ``STRING`` is the shared
token: a double-quoted run with escapes, closed or running to the end.  Its
loops are possessive, so a long string neither backtracks nor recurses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.let import let
from veilwork.functions.regex import SPACE, SPACES, WORD

_CLOSED = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
_CLOSED_SINGLE = r"\A'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'\z"
_SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"

# --- fixed values ---
FENCE = "```"
FENCE_TAG = r"\A(?iu:json)"
LITERALS = {"True": "true", "False": "false", "None": "null"}
# --- end of fixed values ---


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _last_index(text: Column, char: str) -> Column:
    """1-based position of the last ``char``; 0 if there is none."""
    from_end = F.instr(F.reverse(text), char)
    return F.when(from_end > 0, F.length(text) - from_end + 1).otherwise(0)


def extract_json_block(text: Column) -> Column:
    """The first fenced block, else from the first opener to its last closer."""
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    use_brace = (brace > 0) & ((bracket == 0) | (brace < bracket))
    start = F.when(use_brace, brace).otherwise(bracket)
    end = F.when(use_brace, _last_index(text, "}")).otherwise(_last_index(text, "]"))
    span = (
        F.when(start == 0, text)
        .when(end > start, F.substring(text, start, end - start + 1))
        .otherwise(F.substring(text, start, F.length(text)))
    )
    # between the first two fences, without the tag
    fenced = let(
        F.split(text, FENCE, 3),
        lambda p: F.when(
            F.size(p) == 3, F.regexp_replace(F.get(p, F.lit(1)), FENCE_TAG, "")
        ).otherwise(span),
    )
    return strip(F.when(F.contains(text, F.lit(FENCE)), fenced).otherwise(span))


def strip_json_comments(text: Column) -> Column:
    """Drop // and /* */ comments outside double quotes."""
    cut = F.regexp_replace(
        text, rf"({STRING})|//[^\r\n]*+|/\*[\s\S]*?(?:\*/|\z)", "$1"
    )
    return F.when(F.contains(text, F.lit("/")), cut).otherwise(text)


def fix_python_literals(text: Column) -> Column:
    """True/False/None become true/false/null outside double quotes, as whole words."""
    literal = rf"(?<![{WORD}])(?:True|False|None)(?![{WORD}])"
    pieces = F.regexp_extract_all(
        text, F.lit(rf'{STRING}|{literal}|[^"TFN]++|[TFN]'), F.lit(0)
    )
    swaps = F.create_map(*[F.lit(x) for pair in LITERALS.items() for x in pair])
    joined = F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.element_at(swaps, p), p)), ""
    )
    return F.when(text.rlike(literal), joined).otherwise(text)


def fix_single_quotes(text: Column) -> Column:
    """Single-quoted runs become double-quoted; quotes inside are escaped."""

    def requote(piece: Column) -> Column:
        closed = piece.rlike(_CLOSED_SINGLE)
        inner = F.substring(
            piece, F.lit(2), F.length(piece) - F.when(closed, 2).otherwise(1)
        )
        escaped = F.regexp_replace(
            inner, r'\G([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"', r'$1\\"'
        )
        return F.concat(F.lit('"'), escaped, F.when(closed, '"').otherwise(""))

    pieces = F.regexp_extract_all(text, F.lit(rf"{STRING}|{_SINGLE}|[^\"']++"), F.lit(0))
    joined = F.array_join(
        F.transform(pieces, lambda p: F.when(p.startswith("'"), requote(p)).otherwise(p)), ""
    )
    return F.when(F.contains(text, F.lit("'")), joined).otherwise(text)


def fix_trailing_commas(text: Column) -> Column:
    """Drop commas that stand right before a closer, outside strings."""
    return F.regexp_replace(text, rf"({STRING})|,(?=[{SPACE}]*+[}}\]])", "$1")


def close_structures(text: Column) -> Column:
    """Close an open string and all open brackets, innermost first."""
    outside = F.regexp_replace(text, _CLOSED, "")
    in_string = F.contains(outside, F.lit('"'))
    # an open string hides the brackets after its quote
    marks = F.regexp_extract_all(
        F.regexp_replace(text, STRING, ""), F.lit(r"[\[\]{}]"), F.lit(0)
    )

    def push_or_pop(stack: Column, mark: Column) -> Column:
        return (
            F.when(mark == "{", F.concat(F.lit("}"), stack))
            .when(mark == "[", F.concat(F.lit("]"), stack))
            .when(F.substring(stack, 1, 1) == mark, F.substring(stack, 2, 1 << 30))
            .otherwise(stack)
        )

    closers = F.aggregate(marks, F.lit(""), push_or_pop)
    body = rstrip(text)
    body = F.when(in_string, F.concat(body, F.lit('"'))).otherwise(
        F.when(body.endswith(","), rstrip(F.substring(body, F.lit(1), F.length(body) - 1))).otherwise(
            body
        )
    )
    return F.concat(body, closers)


def repair_json(text: Column) -> Column:
    """All repairs in order: block, comments, literals, quotes, commas, closers, commas."""
    return let(extract_json_block(text), _repair_block)


def _repair_block(block: Column) -> Column:
    return let(
        strip_json_comments(block),
        lambda b: let(
            fix_python_literals(b),
            lambda c: let(
                fix_single_quotes(c),
                lambda d: let(
                    fix_trailing_commas(d),
                    lambda e: fix_trailing_commas(close_structures(e)),
                ),
            ),
        ),
    )


def _plausible(text: Column) -> Column:
    """False only for texts that can't be JSON; a failing parse costs far more than this.

    Opener and closer must agree, and outside strings there is only what JSON
    allows, without a comma before a closer.
    """
    body = F.btrim(text, F.lit(" \t\n\r"))
    first, last = F.substring(body, 1, 1), F.substring(body, -1, 1)
    ends = (
        F.when(first == "{", last == "}")
        .when(first == "[", last == "]")
        .when(first == '"', last == '"')
        .otherwise(first.rlike("[-0-9tfn]"))
    )
    legal = rf'\A[-+.0-9eE\[\]{{}}:,"truefalsn \t\n\r]*+\z'
    return ends & let(
        F.when(F.contains(text, F.lit('"')), F.regexp_replace(text, STRING, '""')).otherwise(text),
        lambda bare: bare.rlike(legal) & ~bare.rlike(r",[ \t\n\r]*+[}\]]"),
    )


def parse_strict(text: Column) -> Column:
    """The text as VARIANT, or null if it is not exactly one JSON value.

    The built-in parser ignores what follows a value.  Here the text is wrapped
    as the first of two members whose names depend on its own hash, and both
    must come back: no text can close the wrapper early and still supply the other.
    """

    def with_text(t: Column) -> Column:
        def with_name(name: Column) -> Column:
            wrapped = F.concat(
                F.lit('{"a'), name, F.lit('":'), t, F.lit(',"b'), name, F.lit('":0}')
            )
            members = F.try_variant_get(F.try_parse_json(wrapped), "$", "map<string,variant>")
            return let(members, lambda m: checked(m, name))

        return F.when(_plausible(t), let(F.hex(F.xxhash64(t)), with_name))

    def checked(m: Column, name: Column) -> Column:
        both = (F.size(m) == 2) & F.map_contains_key(m, F.concat(F.lit("b"), name))
        return F.when(both, F.element_at(m, F.concat(F.lit("a"), name)))

    return let(text, with_text)


def parse_or_repair(text: Column) -> Column:
    """Struct of ``value`` (VARIANT) and ``tier``.

    Tier 0: the text itself is JSON; 1: the block in it is; 2: it was repaired;
    null: not JSON even then, or blank.
    """

    def outcome(value: Column | None, tier: int | None) -> Column:
        return F.struct(
            (F.lit(None) if value is None else value).cast("variant").alias("value"),
            F.lit(tier).cast("int").alias("tier"),
        )

    failed = outcome(None, None)

    def last(v: Column) -> Column:
        return F.when(v.isNotNull(), outcome(v, 2)).otherwise(failed)

    def with_block(block: Column) -> Column:
        return let(
            parse_strict(block),
            lambda v: F.when(v.isNotNull(), outcome(v, 1)).otherwise(
                let(parse_strict(_repair_block(block)), last)
            ),
        )

    def first(v: Column) -> Column:
        return F.when(v.isNotNull(), outcome(v, 0)).otherwise(
            let(extract_json_block(text), with_block)
        )

    blank = F.coalesce(F.length(strip(text)) == 0, F.lit(True))
    return F.when(blank, failed).otherwise(let(parse_strict(strip(text)), first))
