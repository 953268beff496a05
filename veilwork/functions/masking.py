"""Detection and masking of personal data as plain Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.let import let
from veilwork.rules import LUHN_CATEGORY, Rule, ScrubRules

# Unicode noncharacters, in no pattern's classes: the filling and the ends of a tag.
TAG_FILL, TAG_END = "\ufdd1", "\ufdd2"
# Where no rule sees the tag it may be this, which keeps a text of one byte a character what it is.
PLAIN_TAG = "\x01"

SEEN_TYPE = "array<struct<value:string,category:string,rule:int,mask:string>>"
HITS_TYPE = "array<struct<rule:int,category:string,ordinal:int,value:string>>"


def luhn_valid(value: Column) -> Column:
    """Mod-10 check over the digits of ``value``; 13 to 19 digits, else false."""
    digits = F.regexp_replace(value, r"\P{Nd}", "")
    from_right = F.split(F.reverse(digits), "")

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    total = F.aggregate(
        F.transform(F.filter(from_right, lambda d: d != ""), weigh), F.lit(0), lambda a, n: a + n
    )
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _words(text: Column) -> Column:
    """What stands between blanks. A hit without blanks lies in one of them, and a word boundary at its edges is one there."""
    return F.split(text, " ", -1)


def _tagged(text: Column, rule: Rule, tag: Column) -> Column:
    """``text`` with every hit of the rule between two tags."""

    def swap(t: Column) -> Column:
        return F.regexp_replace(t, F.lit(rule.jvm), F.concat(tag, F.lit("$0"), tag))

    if not rule.sign:
        return swap(text)
    # the matcher runs on the few words that hold the sign
    return F.array_join(
        F.transform(_words(text), lambda w: F.when(F.contains(w, F.lit(rule.sign)), swap(w)).otherwise(w)), " "
    )


def find_hits(text: Column, rule: Rule) -> Column:
    """Every non-overlapping hit of one rule in ``text``, in order, as an array."""
    if rule.sign:
        words = F.filter(_words(text), lambda w: F.contains(w, F.lit(rule.sign)))
        hits = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(rule.jvm), F.lit(0))))
    else:
        hits = F.regexp_extract_all(text, F.lit(rule.jvm), F.lit(0))
    if rule.category == LUHN_CATEGORY:
        hits = F.filter(hits, luhn_valid)
    if rule.guard:
        hits = F.when(text.rlike(rule.guard), hits).otherwise(F.array().cast("array<string>"))
    return hits


def has_hits(text: Column, rules: ScrubRules) -> Column:
    """Whether anything in ``text`` would be masked; stops at the first hit."""
    answer = F.lit(False)
    for rule in rules.ordered:
        if rule.category == LUHN_CATEGORY:
            hit = F.size(find_hits(text, rule)) > 0
        else:
            hit = text.rlike(rule.jvm)
            if rule.guard:
                hit = text.rlike(rule.guard) & hit
        answer = answer | hit
    if rules.text_guards:
        answer = _may_hold(text, rules) & answer
    return F.coalesce(answer, F.lit(False))


def _may_hold(text: Column, rules: ScrubRules) -> Column:
    """Whether a text satisfies one of the guards; apart, for a matcher with one class is the fastest."""
    return reduce(Column.__or__, [text.rlike(g) for g in rules.text_guards])


def _pick(k: Column, rules: ScrubRules, choose) -> Column:
    """A per-rule literal, by rule number."""
    return F.get(F.array(*[F.lit(choose(rule)) for rule in rules.ordered]), k)


def _cut(text: Column, k: Column, rules: ScrubRules) -> Column:
    """``text`` cut at the hits of rule ``k``: text, hit, text, ..., text.

    One branch per rule, so that every matcher is compiled once, and one run of
    it: hits are wrapped in a tag and the text is split there.
    """
    uncut = F.array(text)
    branches = None
    for number, rule in enumerate(rules.ordered):
        cut = let(
            F.when(F.contains(text, F.lit(PLAIN_TAG)), free_tag(text)).otherwise(F.lit(PLAIN_TAG)),
            lambda tag: let(
                _tagged(text, rule, tag), lambda t: F.when(t == text, uncut).otherwise(F.split(t, tag, -1))
            ),
        )
        if rule.guard:
            cut = F.when(text.rlike(rule.guard), cut).otherwise(uncut)
        branches = F.when(k == number, cut) if branches is None else branches.when(k == number, cut)
    return branches.otherwise(uncut)


def free_tag(text: Column) -> Column:
    """A mark that does not occur in ``text``, whatever it holds, nor across its own ends.

    Between two ends stand more fillings in a row than anywhere in the text.
    """
    runs = F.regexp_extract_all(text, F.lit(TAG_FILL + "+"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    n = F.when(F.contains(text, F.lit(TAG_FILL)), longest + 1).otherwise(1)
    return F.concat(F.lit(TAG_END), F.repeat(F.lit(TAG_FILL), n), F.lit(TAG_END))


def fresh_state(text: Column | None = None) -> Column:
    """Nothing masked yet."""
    return F.struct(
        (F.lit("") if text is None else text).alias("text"),
        F.array().cast(SEEN_TYPE).alias("seen"),
        F.array().cast(HITS_TYPE).alias("hits"),
    )


def scan_text(
    text: Column,
    rules: ScrubRules,
    tag: Column | None = None,
    keep_hits: bool = False,
    carry: Column | None = None,
) -> Column:
    """Run all rules over one text, each on what the rules before it left.

    Returns a struct: ``text`` with masks in place, ``seen`` with the distinct
    values in the order they were first masked, and with ``keep_hits`` every
    single hit.  With a ``tag`` the masks stand between two of them, for
    renumbering across a session.  ``carry`` is the state after an earlier text, whose
    masks and numbering continue here.
    """
    if carry is None:
        start = fresh_state(text)
    else:
        start = F.struct(
            text.alias("text"), carry["seen"].alias("seen"), carry["hits"].alias("hits")
        )
    if not rules.ordered:
        return start

    def apply_rule(state: Column, k: Column) -> Column:
        category = _pick(k, rules, lambda r: r.category)
        template = _pick(k, rules, lambda r: r.template)
        if tag is not None:
            template = F.concat(tag, template, tag)
        is_card = category == LUHN_CATEGORY

        def with_pieces(pieces: Column) -> Column:
            values = F.filter(pieces, lambda _p, i: i % 2 == 1)
            valid = F.filter(values, lambda v: ~is_card | luhn_valid(v))
            # numbers are per category, shared by all rules of that name
            before = F.size(F.filter(state["seen"], lambda e: e["category"] == category))
            fresh = F.transform(
                F.array_except(valid, state["seen"]["value"]),
                lambda v, i: F.struct(
                    v.alias("value"),
                    category.alias("category"),
                    k.alias("rule"),
                    F.replace(
                        template, F.lit("{idx}"), (before + i + 1).cast("string")
                    ).alias("mask"),
                ),
            )
            hits = state["hits"]
            if keep_hits:
                hits = F.concat(
                    hits,
                    F.transform(
                        valid,
                        lambda v, i: F.struct(
                            k.alias("rule"),
                            category.alias("category"),
                            (i + 1).alias("ordinal"),
                            v.alias("value"),
                        ),
                    ),
                )
            seen = F.concat(state["seen"], fresh.cast(SEEN_TYPE)).cast(SEEN_TYPE)
            rewritten = let(
                F.struct(
                    seen.alias("seen"), seen["value"].alias("vals"), seen["mask"].alias("masks")
                ),
                lambda s: F.struct(
                    _swap(
                        pieces, is_card, s["vals"], s["masks"]
                    ).alias("text"),
                    s["seen"].alias("seen"),
                    hits.cast(HITS_TYPE).alias("hits"),
                ),
            )
            return F.when(F.size(pieces) == 1, state).otherwise(rewritten)

        return let(_cut(state["text"], k, rules), with_pieces)

    numbers = F.array(*[F.lit(k) for k in range(len(rules.ordered))])
    scanned = F.aggregate(numbers, start, apply_rule)
    worth_it = F.length(text) > 0
    if rules.text_guards:
        worth_it = worth_it & _may_hold(text, rules)
    return F.when(worth_it, scanned).otherwise(start)


def _swap(pieces: Column, is_card: Column, vals: Column, masks: Column) -> Column:
    """Join the pieces of a text with the mask of each accepted hit in its place."""

    def one(piece: Column, i: Column) -> Column:
        mask = F.get(masks, F.array_position(vals, piece).cast("int") - 1)
        accepted = F.when(~is_card | luhn_valid(piece), mask)
        return F.when(i % 2 == 0, piece).otherwise(F.coalesce(accepted, piece))

    return F.array_join(F.transform(pieces, one), "")


def mask_text(text: Column, rules: ScrubRules | None = None) -> Column:
    """``text`` with every hit replaced by its numbered mask."""
    return scan_text(text, rules or ScrubRules())["text"]


def mask_text_with_map(text: Column, rules: ScrubRules | None = None) -> Column:
    """Struct of ``masked`` and ``map`` (mask to original; empty if not reversible)."""
    rules = rules or ScrubRules()

    def out(s: Column) -> Column:
        return F.struct(s["text"].alias("masked"), _entries(s, rules).alias("map"))

    return let(scan_text(text, rules), out)


def _entries(s: Column, rules: ScrubRules) -> Column:
    """The restore map of a state: one entry per mask, the latest value if two share it."""
    kind = "array<struct<mask:string,original:string>>"
    if not rules.reversible:
        return F.array().cast(kind)
    seen = s["seen"]
    if rules.masks_may_collide:
        masks = seen["mask"]
        seen = F.filter(
            seen,
            lambda e, i: ~F.array_contains(
                F.slice(masks, i + 2, F.size(masks) + 1), e["mask"]
            ),
        )
    return F.transform(
        seen, lambda e: F.struct(e["mask"].alias("mask"), e["value"].alias("original"))
    ).cast(kind)


def category_counts(s: Column) -> Column:
    """Distinct values masked per category, of a state; kept whether or not the rules are reversible."""
    seen = s["seen"]
    return F.map_from_entries(
        F.transform(
            F.array_distinct(seen["category"]),
            lambda c: F.struct(c, F.size(F.filter(seen, lambda e: e["category"] == c)).cast("bigint")),
        )
    )


def mask_prompts(prompts: Column, rules: ScrubRules | None = None) -> Column:
    """Mask an array of prompts that share one numbering.

    Returns a struct of ``prompts``, the request's ``map`` and ``counts`` per category.
    """
    rules = rules or ScrubRules()

    def step(acc: Column, prompt: Column) -> Column:
        return let(
            scan_text(prompt, rules, carry=acc["state"]),
            lambda s: F.struct(
                s.alias("state"), F.concat(acc["out"], F.array(s["text"])).alias("out")
            ),
        )

    start = F.struct(
        fresh_state().alias("state"), F.array().cast("array<string>").alias("out")
    )
    return F.aggregate(
        prompts,
        start,
        step,
        lambda acc: F.struct(
            acc["out"].alias("prompts"),
            _entries(acc["state"], rules).alias("map"),
            category_counts(acc["state"]).alias("counts"),
        ),
    )


PART_TYPE = "struct<type:string,text:string,image_url:string>"
MESSAGE_TYPE = f"struct<role:string,content:string,parts:array<{PART_TYPE}>>"


def mask_messages(messages: Column, rules: ScrubRules | None = None) -> Column:
    """Mask the turns of a request, kept as an array, under one numbering.

    Text content and text parts are masked; roles and other parts pass through.
    Returns a struct of ``messages``, the request's ``map`` and ``counts`` per category.
    """
    rules = rules or ScrubRules()

    def text_step(acc: Column, text: Column) -> Column:
        return let(
            scan_text(text, rules, carry=acc["state"]),
            lambda s: F.struct(
                s.alias("state"), F.concat(acc["out"], F.array(s["text"])).alias("out")
            ),
        )

    def message_step(acc: Column, message: Column) -> Column:
        parts = message["parts"]
        # the content first, then one text per part, null where there is none to mask
        texts = F.concat(
            F.array(message["content"]),
            F.transform(
                F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")),
                lambda p: F.when(p["type"] == "text", p["text"]),
            ),
        )

        def rebuilt(done: Column) -> Column:
            masked_parts = F.transform(
                parts,
                lambda p, i: F.struct(
                    p["type"].alias("type"),
                    F.when(p["type"] == "text", F.get(done["out"], i + 1))
                    .otherwise(p["text"])
                    .alias("text"),
                    p["image_url"].alias("image_url"),
                ),
            )
            built = F.struct(
                message["role"].alias("role"),
                F.get(done["out"], F.lit(0)).alias("content"),
                masked_parts.alias("parts"),
            )
            return F.struct(
                done["state"].alias("state"), F.concat(acc["out"], F.array(built)).alias("out")
            )

        begin = F.struct(
            acc["state"].alias("state"), F.array().cast("array<string>").alias("out")
        )
        return let(F.aggregate(texts, begin, text_step), rebuilt)

    start = F.struct(
        fresh_state().alias("state"), F.array().cast(f"array<{MESSAGE_TYPE}>").alias("out")
    )
    return F.aggregate(
        messages,
        start,
        message_step,
        lambda acc: F.struct(
            acc["out"].alias("messages"),
            _entries(acc["state"], rules).alias("map"),
            category_counts(acc["state"]).alias("counts"),
        ),
    )


def restore_with(text: Column, entries: Column) -> Column:
    """Put originals back, longest mask first, every occurrence."""
    ordered = F.array_sort(
        entries, lambda a, b: F.length(b["mask"]) - F.length(a["mask"])
    )
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e["mask"], e["original"]))
