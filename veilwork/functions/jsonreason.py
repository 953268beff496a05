"""Why a text isn't JSON: what was expected at its first wrong character, and where that is.

A scanner over tokens: one matcher run cuts the text, and a fold over the tokens keeps what may come next and which
brackets are open. It is meant for texts that failed to parse; the rest never get here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.jsonfix import repair_json, strip
from veilwork.functions.let import let

# --- fixed values: what a parser says ---
BLANK = "Empty or whitespace-only JSON input"
VALUE = "Expecting value"
NAME = "Expecting property name enclosed in double quotes"
COLON = "Expecting ':' delimiter"
COMMA = "Expecting ',' delimiter"
EXTRA = "Extra data"
OPEN_STRING = "Unterminated string starting at"
CONTROL = "Invalid control character at"
ESCAPE = "Invalid \\escape"
UNICODE_ESCAPE = "Invalid \\uXXXX escape"
PLACE = ": line %d column %d (char %d)"
# --- end of fixed values ---

_INSIDE = r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+'
_WHOLE = rf'\A"{_INSIDE}"\z'
_TOKENS = (
    r"[ \t\n\r]++"
    rf'|"{_INSIDE}"?+'
    r"|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+"
    r"|true|false|null|(?s:.)"
)
_STATE = "struct<mode:string,open:string,at:int,reason:string,wrong:int>"
# modes: v value, a value or end of a list, k name or end of an object, n name, c colon, d comma or end, e end


def _scan(text: Column) -> Column:
    """The state after all tokens."""
    start = F.struct(
        F.lit("v").alias("mode"), F.lit("").alias("open"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("wrong")
    ).cast(_STATE)

    def step(s: Column, token: Column) -> Column:
        mode, opened, at = s["mode"], s["open"], s["at"]
        after = at + F.length(token)

        def to(new_mode, new_open) -> Column:
            new_mode = F.lit(new_mode) if isinstance(new_mode, str) else new_mode
            return F.struct(new_mode.alias("mode"), new_open.alias("open"), after.alias("at"), s["reason"].alias("reason"), s["wrong"].alias("wrong")).cast(_STATE)

        def wrong(reason: Column, place: Column) -> Column:
            return F.struct(mode.alias("mode"), opened.alias("open"), after.alias("at"), reason.alias("reason"), place.alias("wrong")).cast(_STATE)

        first = F.substring(token, 1, 1)
        quoted = first == '"'
        whole = token.rlike(_WHOLE)
        # what stopped a string
        next_char = F.substring(text, after + 1, F.lit(1))
        escaped = F.substring(text, after + 2, F.lit(1))
        broken = (
            F.when((next_char == "") | ((next_char == "\\") & (escaped == "")), wrong(F.lit(OPEN_STRING), at))
            .when((next_char == "\\") & (escaped == "u"), wrong(F.lit(UNICODE_ESCAPE), after + 1))
            .when(next_char == "\\", wrong(F.lit(ESCAPE), after))
            .otherwise(wrong(F.lit(CONTROL), after))
        )
        closed = F.substring(opened, 2, 1 << 30)
        done = lambda rest: to(F.when(F.length(rest) > 0, "d").otherwise("e"), rest)
        scalar = whole | token.rlike(r"\A(?:-?[0-9]|true\z|false\z|null\z)")
        value = (
            F.when(scalar, done(opened))
            .when(first == "{", to("k", F.concat(F.lit("}"), opened)))
            .when(first == "[", to("a", F.concat(F.lit("]"), opened)))
            .when((mode == "a") & (first == "]"), done(closed))
            .when(quoted, broken)
            .otherwise(wrong(F.lit(VALUE), at))
        )
        name = (
            F.when(whole, to("c", opened))
            .when((mode == "k") & (first == "}"), done(closed))
            .when(quoted, broken)
            .otherwise(wrong(F.lit(NAME), at))
        )
        top = F.substring(opened, 1, 1)
        delimiter = (
            F.when(token == ",", to(F.when(top == "}", "n").otherwise("v"), opened))
            .when(token == top, done(closed))
            .otherwise(wrong(F.lit(COMMA), at))
        )
        return (
            F.when(s["reason"].isNotNull(), s)
            .when(first.isin(" ", "\t", "\n", "\r"), to(mode, opened))
            .when(mode.isin("v", "a"), value)
            .when(mode.isin("k", "n"), name)
            .when(mode == "c", F.when(token == ":", to("v", opened)).otherwise(wrong(F.lit(COLON), at)))
            .when(mode == "d", delimiter)
            .otherwise(wrong(F.lit(EXTRA), at))
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), start, step)


def scan_json(text: Column) -> Column:
    """Struct ``reason, at``: what is wrong with a text, and the character (from 0) where it is; null reason if it is JSON."""

    def ended(s: Column) -> Column:
        missing = (
            F.when(s["mode"].isin("v", "a"), VALUE).when(s["mode"].isin("k", "n"), NAME).when(s["mode"] == "c", COLON).when(s["mode"] == "d", COMMA)
        )
        reason = F.coalesce(s["reason"], missing)
        return F.struct(reason.alias("reason"), F.when(reason.isNotNull(), F.coalesce(s["wrong"], s["at"])).alias("at"))

    return let(text, lambda t: let(_scan(t), ended))


def parse_reason(content: Column) -> Column:
    """Why a reply isn't JSON even when repaired, with the place in the repaired text; null if it is."""

    def placed(repaired: Column) -> Column:
        def said(found: Column) -> Column:
            before = F.substring(repaired, F.lit(1), found["at"])
            line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
            column = F.instr(F.concat(F.reverse(before), F.lit("\n")), "\n")
            return F.when(
                found["reason"].isNotNull(), F.concat(found["reason"], F.format_string(PLACE, line, column, found["at"]))
            )

        return let(scan_json(repaired), said)

    blank = F.coalesce(F.length(strip(content)) == 0, F.lit(True))
    return F.when(blank, F.lit(BLANK)).otherwise(let(repair_json(content), placed))
