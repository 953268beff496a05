from __future__ import annotations

import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from veilwork.functions.masking import (
    MESSAGE_TYPE,
    find_hits,
    luhn_valid,
    mask_messages,
    mask_prompts,
    mask_text,
    mask_text_with_map,
    restore_with,
)
from veilwork.operators import detect, restore, sessions
from veilwork.rules import PATTERNS, ScrubRules, literal_start

MIXED = ScrubRules(
    custom_patterns={
        "ticket": r"\bINC-\d{5}\b",
        "email": {"pattern": r"\bu\d@c\.io\b", "placeholder": "<{idx}>"},
    }
)
BITS = [
    "a@b.co", "Ka@x.io", "A.b+c%d@e-f.org", "1.2.3.4", "10.0.0.255", "256.1.1.1", "555-867-5309",
    "+1-555-867-5309", "(212) 555-0000", "212 555 0000", "tel+44 20 7123 4567", "+44 20 7123 4567",
    "4111 1111 1111 1111", "4111111111111112", "378282246310005", "3782 822463 10005",
    "6011000990139424", "123-45-6789", "٣٣٣-٤٤-٥٥٥٥", "sk-" + "a" * 20, "SK-PROJ-" + "b" * 21,
    "AKIA" + "B" * 16, "ghp_" + "c" * 36, "api_key='", "Secret-Key: " + "k" * 22, "access token =",
    "INC-12345", "u1@c.io", "u2@c.io", "[EMAIL_1]", "﷑", "﷒", " ", " ", ".", "-", "_",
    "x", "é", "²", "\n",
]


def make_texts(n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("c")).first()["c"]


def test_every_builtin_and_repeats(spark):
    text = (
        "o_brandt@fjord.test; o_brandt@fjord.test wants 512-44-8890 off the list on 172.20.0.9 "
        "(token sk-" + "Zq7" * 11 + "), call +1 415 555 0134"
    )
    got = one(spark, mask_text_with_map(F.col("text")), text)
    assert got["masked"].count("[EMAIL_1]") == 2
    for mask in ("+[PHONE_1]", "[SSN_1]", "[IPV4_1]", "[API_KEY_1]"):
        assert mask in got["masked"]
    back = one(spark, restore_with(F.lit(got["masked"]), F.lit(None).cast("array<struct<mask:string,original:string>>")))
    assert back is None  # no map, no text
    assert plain.restore(got["masked"], {m: o for m, o in got["map"]}) == text


@pytest.mark.parametrize("text, kept", [("4111 1111 1111 1111", False), ("4111 1111 1111 1112", True)])
def test_card_needs_check_digit(spark, text, kept):
    assert (one(spark, mask_text(F.col("text")), f"Card {text}.") == f"Card {text}.") is kept


def test_luhn(spark):
    values = ["4111-1111-1111-1111", "411111111111111", "378282246310005", "", "12", "0" * 13, "0" * 20]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.ok for r in df.select(luhn_valid(F.col("v")).alias("ok")).collect()] == [
        plain.luhn(v) for v in values
    ]


@pytest.mark.parametrize("rules", [ScrubRules(), MIXED, ScrubRules(patterns=("phone", "email"))])
def test_random_texts(spark, rules):
    texts = make_texts(4000, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    for row in df.select("text", mask_text(F.col("text"), rules).alias("m")).collect():
        assert row.m == plain.mask_session([row.text], rules)[0][0]


def test_null_empty_and_disabled(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert [r[0] for r in df.select(mask_text(F.col("text"))).collect()] == [None, ""]
    assert one(spark, mask_text(F.col("text"), ScrubRules(enabled=False)), "a@b.co") == "a@b.co"


def test_not_reversible_masks_without_a_map(spark):
    got = one(spark, mask_text_with_map(F.col("text"), ScrubRules(reversible=False)), "a@b.co")
    assert (got["masked"], got["map"]) == ("[EMAIL_1]", [])


def test_rule_options():
    rules = ScrubRules.from_dict(
        {
            "patterns": ["phone", "nonsense", "email"],
            "custom_patterns": {"staff": {"pattern": r"E-\d+", "placeholder": "[ID_{n}]"}, "door": r"D\d"},
            "unknown": 1,
        }
    )
    assert [r.category for r in rules.ordered] == ["staff", "door", "email", "phone"]
    assert [r.template for r in rules.ordered[:2]] == ["[ID_{idx}]", "[DOOR_{idx}]"]
    with pytest.raises(ValueError):
        ScrubRules(custom_patterns={"x": "a*"}).ordered  # noqa: B018


def test_prompts_and_messages_share_numbers(spark):
    df = spark.createDataFrame(
        [
            (
                ["to a@b.co", "c@d.co, a@b.co"],
                [
                    ("user", "x a@b.co", None),
                    ("assistant", None, [("text", "q@q.com a@b.co", None), ("image_url", None, "u@v.co")]),
                ],
            )
        ],
        f"p array<string>, m array<{MESSAGE_TYPE}>",
    )
    row = df.select(mask_prompts(F.col("p")).alias("p"), mask_messages(F.col("m")).alias("m")).first()
    assert row.p.prompts == ["to [EMAIL_1]", "[EMAIL_2], [EMAIL_1]"]
    assert row.m.messages[1].parts[0].text == "[EMAIL_2] [EMAIL_1]"
    assert row.m.messages[1].parts[1].image_url == "u@v.co"
    assert [tuple(e) for e in row.m.map] == [("[EMAIL_1]", "a@b.co"), ("[EMAIL_2]", "q@q.com")]


@pytest.mark.parametrize("rules", [ScrubRules(), MIXED])
def test_sessions_with_one_hot_session(spark, rules):
    # half of all turns are in session 0, over several numbering buckets
    rng = random.Random(5)
    texts = make_texts(6000, 11, 8)
    odd = ["\ufdd0", "\ufdd1", "\ufdd2", "\ufdd2\ufdd1\ufdd2", "\ufdd1\ufdd1", "\ufdd3\ufdd4"]
    texts = [t.replace(" ", rng.choice(odd), 1) if i % 9 == 0 else t for i, t in enumerate(texts)]
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 30), i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session_id int, turn long, text string").repartition(8)
    masked, entries = sessions.mask_sessions(df, rules=rules)
    got = {(r.session_id, r.turn): r.masked for r in masked.collect()}
    back = {}
    for r in entries.collect():
        back.setdefault(r.session_id, {})[r.mask] = r.original
    for session in {r[0] for r in rows}:
        turns = sorted(r for r in rows if r[0] == session)
        expected, expected_back = plain.mask_session([t for _, _, t in turns], rules)
        assert [got[(session, i)] for _, i, _ in turns] == expected
        assert back.get(session, {}) == expected_back
    restored = restore.unmask(masked, entries, ["session_id", "turn"], text="masked", rules=rules)
    for r in restored.collect():
        assert r.restored == plain.restore(r.masked, back.get(r.session_id, {}))
    counts = sessions.entity_counts(df, rules=rules)
    assert counts.agg(F.sum("n_values")).first()[0] >= entries.count()


def test_restore_takes_longest_mask_first_and_keeps_unknown(spark):
    entries = spark.createDataFrame(
        [(1, f"[EMAIL_{i}]", f"u{i}@c.io") for i in range(1, 13)],
        "session_id int, mask string, original string",
    )
    replies = spark.createDataFrame(
        [(1, 1, "[EMAIL_1] [EMAIL_12] [EMAIL_99]"), (2, 2, "[EMAIL_1]"), (3, 1, None)],
        "id int, session_id int, text string",
    )
    got = {r.id: r.restored for r in restore.unmask(replies, entries, ["id"]).collect()}
    assert got == {1: "u1@c.io u12@c.io [EMAIL_99]", 2: "[EMAIL_1]", 3: None}


def test_open_ended_templates(spark):
    rules = ScrubRules(patterns=(), custom_patterns={"n": {"pattern": r"\bv\d+\b", "placeholder": "ID{idx}"}})
    entries = spark.createDataFrame(
        [(1, f"ID{i}", f"v{i}") for i in (1, 2)], "session_id int, mask string, original string"
    )
    replies = spark.createDataFrame([(1, 1, "ID12 ID2 ID3")], "id int, session_id int, text string")
    got = restore.unmask(replies, entries, ["id"], rules=rules).first().restored
    assert got == plain.restore("ID12 ID2 ID3", {"ID1": "v1", "ID2": "v2"})


def test_detect_lists_every_hit(spark):
    df = spark.createDataFrame([(1, "a@b.co 1.2.3.4 a@b.co"), (2, "none")], "id int, text string")
    got = sorted(tuple(r) for r in detect.detect_entities(df, ["id"]).collect())
    assert got == [(1, "email", 1, "a@b.co"), (1, "email", 2, "a@b.co"), (1, "ipv4", 1, "1.2.3.4")]


def test_mask_table_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", "x"), (2, "none", "y")], "id int, text string, other string")
    masked = detect.mask_table(df)
    assert masked.columns == ["id", "text", "other", "masked", "map"]
    assert masked.where("masked = '[EMAIL_1]'").first().other == "x"


def test_a_wide_session_spreads_over_buckets(spark):
    # 5000 distinct values in one session: numbered over five ranges of turns
    n = 5 * sessions.TURNS_PER_BUCKET
    df = spark.range(n).select(
        F.lit("s").alias("session_id"),
        F.col("id").alias("turn"),
        F.concat(F.lit("to u"), F.col("id"), F.lit("@c.io and u0@c.io")).alias("text"),
    )
    masked, _ = sessions.mask_sessions(df)
    wrong = masked.where(
        F.col("masked")
        != F.concat(F.lit("to [EMAIL_"), F.col("turn") + 1, F.lit("] and [EMAIL_1]"))
    )
    assert masked.count() == n and wrong.count() == 0


def test_what_is_tested_before_a_pattern(spark):
    """A custom rule's plain beginning and an e-mail's sign are tested first, and change no result."""
    assert literal_start(r"\buser\d+@corp\.io\b") == "user"
    assert literal_start(r"\bsk-0+\d+\b") == "sk-0" and literal_start(r"\bab?c") == "a"
    assert [literal_start(p) for p in (r"\ba|b", r"user\d", r"\b[ab]c", r"\ba*")] == [None] * 4
    rules = ScrubRules(custom_patterns={"door": r"\bhost 10\.0\.\d+"})
    assert {r.category: (r.guard, r.sign) for r in rules.ordered if r.category in ("door", "email")} == {
        "door": ("host 10", None),
        "email": ("@", "@"),
    }
    texts = [
        "a@b.io", "  a@b.io  c@d.io ", "x\na@b.io\tc@d.io,e@f.io", "@ a @b.io", "é.a@b.io ſa@b.io a@b.ioé z",
        "a\x01b a@b.io \x01", "\x01﷒﷑﷒ a@b.io", "one host 10.0.7 Host 10.0.8 xhost 10.0.9", "", " ",
        "gho_" + "a" * 36 + " SK-" + "b" * 20 + " acceſſ-toKen=" + "c" * 20 + " KEY api_key: " + "d" * 20,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", mask_text(F.col("t"), rules).alias("m")).collect()}
    assert got == {i: plain.mask_session([t], rules)[0][0] for i, t in enumerate(texts)}
    hits = df.select("i", find_hits(F.col("t"), next(r for r in rules.ordered if r.sign)).alias("h")).collect()
    flags = re.IGNORECASE
    assert {r["i"]: r["h"] for r in hits} == {i: re.findall(PATTERNS["email"], t, flags) for i, t in enumerate(texts)}
