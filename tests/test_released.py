"""Replies in pieces: cut positions, turns and masks against a reply read piece by piece."""

from __future__ import annotations

import json
import random

import plain
import pytest

from veilwork.operators import released
from veilwork.plans import streamed
from veilwork.rules import ScrubRules
from veilwork.streaming import chunks

RULES = ScrubRules()


def read_by_piece(pieces, buffer):
    """What is released with each piece, and at the end."""
    held, out = "", []
    for piece in pieces:
        if not piece:  # nothing came
            out.append("")
            continue
        held += piece
        spare = len(held) - buffer
        blanks = [i for i in range(max(0, spare + 1)) if held[i] in " \t\n\r"] if spare > 0 else []
        cut = blanks[-1] + 1 if blanks else (spare if len(held) > 4 * buffer else 0)
        out.append(held[:cut])
        held = held[cut:]
    return out, held


def some_reply(rng):
    words = ["a", "to", "u1@corp.io", "u22@corp.io", "10.1.2.3", "123-45-6789", "4111 1111 1111 1111", "\t", "\n", "é", "日本", "x" * 30]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", ","]) for _ in range(rng.choice([0, 1, 5, 60])))
    if rng.random() < 0.5:
        at = rng.randrange(len(text) + 1)
        text = text[:at] + "b" * rng.choice([10, 90, 700]) + text[at:]
    pieces = []
    while text:
        n = rng.choice([0, 1, 3, 17, 17, 80])
        pieces.append(text[:n])
        text = text[n:]
    return pieces


@pytest.mark.parametrize("buffer", [4, 16, 64])
def test_against_reading_by_piece(spark, buffer):
    rng = random.Random(buffer)
    replies = {i: some_reply(rng) for i in range(60)}
    rows = [(i, 10 * n + 3, p) for i, pieces in replies.items() for n, p in enumerate(pieces)]
    rng.shuffle(rows)
    ends = [(i, 10**6) for i in replies if i % 7] + [(3, 10**7)]  # some never end
    pieces = spark.createDataFrame(rows, "stream_id bigint, seq bigint, text string").repartition(5)
    last = spark.createDataFrame(ends, "stream_id bigint, seq bigint")
    asked = spark.createDataFrame([(i, -1, "from u22@corp.io") for i in replies if i % 2], "stream_id bigint, seq bigint, text string")
    masked, entries = released.mask_released(pieces, last, RULES, asked, buffer)
    got = {(r["stream_id"], r["seq"]): r["safe"] for r in masked.collect()}
    back = {(r["stream_id"], r["seq"]): r["safe"] for r in released.restored(masked, entries, RULES).collect()}
    expected, whole = {}, {}
    for i, texts in replies.items():
        out, rest = read_by_piece(texts, buffer)
        turns = [(10 * n + 3, t) for n, t in enumerate(out) if t] + ([(10**6, rest)] if rest and i % 7 else [])
        before = ["from u22@corp.io"] if i % 2 else []
        safe, _ = plain.mask_session([*before, *(t for _, t in turns)], RULES)
        expected |= {(i, seq): s for (seq, _), s in zip(turns, safe[len(before) :])}
        whole |= {(i, seq): t for seq, t in turns}
    assert got == expected
    assert back == whole


def test_nothing_and_odd_pieces(spark):
    kind = "stream_id bigint, seq bigint, text string"
    none = spark.createDataFrame([], kind)
    ends = spark.createDataFrame([(1, 5), (2, 5)], "stream_id bigint, seq bigint")
    assert released.released_turns(none, ends).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, 2, ""), (2, 1, "short u1@corp.io")], kind)
    masked, _ = released.mask_released(odd, ends, RULES)
    assert [tuple(r) for r in masked.collect()] == [(2, 5, "short [EMAIL_1]")]


def test_lines_written_back(spark):
    lines = [
        (1, 0, ""),
        (1, 1, "event: x"),
        (1, 2, 'data: {"id": "a", "n": 1.5, "choices": [{"delta": {"content": "mail u1@", "role": "r"}, "index": 0}, {"delta": {"content": "z"}}]}'),
        (1, 3, 'data: {"choices": [{"delta": {"content": "corp.io now "}}]}'),
        (1, 4, 'data: {"choices": [{"delta": {"content": ""}}]}'),
        (1, 5, 'data: {"choices": [{"delta": {"content": null}}]}'),
        (1, 6, "data: 5"),
        (1, 7, 'data: {"choices": [{"delta": {"content": "' + "and then some more words for it" * 3 + '"}}]}'),
        (1, 8, "data:  [DONE] "),
        (1, 9, 'data: {"choices": [{"delta": {"content": "u9@corp.io"}}]}'),
        (2, 0, 'data: {"choices": [{"delta": {"content": "no end"}}]}'),
        (3, 0, "data: [DONE]"),
    ]
    df = spark.createDataFrame([(*r, "m", 7) for r in lines], "stream_id bigint, seq bigint, line string, model string, created bigint")
    sent = {(r["stream_id"], r["seq"]): r["out"] for r in streamed.streamed_replies(df, ScrubRules(reversible=False)).collect()}
    assert sorted(sent) == sorted((s, q) for s, q, _ in lines if (s, q) != (1, 9))
    chunk = lambda s, q: json.loads(sent[s, q].split("\n")[0].removeprefix("data: "))
    assert sent[1, 0] == "\n" and sent[1, 1] == "event: x\n" and sent[1, 6] == "data: 5\n" and sent[3, 0] == "data: [DONE]\n\n"
    assert sent[1, 4] == lines[4][2] + "\n\n" and sent[1, 5] == lines[5][2] + "\n\n"
    assert chunk(1, 2) == {"id": "a", "n": 1.5, "choices": [{"delta": {"content": "", "role": "r"}, "index": 0}, {"delta": {"content": "z"}}]}
    rest = chunk(1, 8)
    assert rest["choices"][0]["finish_reason"] is None and rest["id"] == "chatcmpl-stream-7" and rest["model"] == "m"
    pieces = [chunk(1, q)["choices"][0]["delta"]["content"] for q in (2, 3, 7)] + [rest["choices"][0]["delta"]["content"]]
    assert "".join(pieces) == "mail [EMAIL_1] now " + "and then some more words for it" * 3
    assert sent[1, 8].endswith("data: [DONE]\n\n") and chunk(2, 0)["choices"][0]["delta"]["content"] == ""
    requests = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "request_id bigint, estimated_tokens bigint")
    replies = streamed.streamed_replies(df)
    settled = {r["request_id"]: r["settled_tokens"] for r in streamed.settle_streamed(requests, replies).collect()}
    assert settled == {1: 13, 3: 10}  # the reply without an end failed


def lines_of(spark, seed, strange):
    """Pieces of replies as rows, some of which repeat, have no key or follow the end; and what the regular ones release."""
    rng = random.Random(seed)
    rows, expected = [], {}
    for i in range(30):
        pieces = some_reply(rng)
        own = [(i, n, p, False) for n, p in enumerate(pieces)]
        ended = i % 5 > 0
        if ended:
            own.append((i, len(pieces), None, True))
        if strange and i % 3 == 0:
            own += rng.sample(own, min(2, len(own))) + [(None, 1, "no key u1@corp.io", False), (i, None, "nor this", False), (i, len(pieces) + 2, "late u1@corp.io ", False)]
        else:
            out, rest = read_by_piece(pieces, 16)
            expected |= {(i, n): t for n, t in enumerate(out) if t} | ({(i, len(pieces)): rest} if ended and rest else {})
        rows += own
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "stream_id int, seq bigint, piece string, is_done boolean").repartition(4), expected


def test_lines_are_read_in_order_without_windows(spark, monkeypatch):
    lines, expected = lines_of(spark, 1, False)

    def never(*args, **kwargs):
        raise AssertionError("pieces went through windows and joins")

    monkeypatch.setattr(released, "cut_positions", never)
    got = {(r["stream_id"], r["seq"]): r["safe"] for r in chunks.mask_chunks(lines, RULES, 16).collect()}
    assert len(got) == lines.count() and {k for k, t in got.items() if t} == set(expected)
    assert all(got[k] == t for k, t in expected.items() if not any(c.isdigit() for c in t))
    sent = lines.where("not is_done").selectExpr("stream_id", "seq", "'data: ' || to_json(struct(array(struct(struct(piece AS content) AS delta)) AS choices)) AS line")
    assert streamed.streamed_replies(sent, RULES).count() == sent.count()


@pytest.mark.parametrize("back", [False, True])
def test_lines_that_cannot_be_told_apart_go_by_windows(spark, back):
    lines, expected = lines_of(spark, 2, True)
    asked = spark.createDataFrame([(i, -1, "from u22@corp.io") for i in range(0, 30, 2)], "stream_id int, seq bigint, text string")
    got = released.mask_lines(released.in_order(lines), RULES, asked, 16, back)
    want = released._lines_by_windows(lines, RULES, asked, 16, back)
    assert got.schema.names == ["stream_id", "seq", "is_done", "safe"]
    strange = lambda rows: sorted(str(r) for r in rows if (r["stream_id"] or 0) % 3 == 0)
    assert strange(got.collect()) == strange(want.select(got.columns).collect())
    released_here = {(r["stream_id"], r["seq"]): r["safe"] for r in got.collect() if (r["stream_id"] or 0) % 3 and r["safe"]}
    assert released_here.keys() == expected.keys() and (not back or released_here == expected)


def test_nothing_is_released_of_a_full_buffer(spark):
    # the second piece fills the buffer again from a blank on: it waits, whatever its first character is
    rows = [(1, 0, "a" * 9 + " " + "\n" + "b" * 15, False), (1, 1, "c", False), (1, 2, "d", False), (1, 3, None, True)]
    lines = spark.createDataFrame(rows, "stream_id int, seq bigint, piece string, is_done boolean")
    out, rest = read_by_piece([r[2] for r in rows[:-1]], 17)
    assert [r["safe"] for r in chunks.mask_chunks(lines, RULES, 17).orderBy("seq").collect()] == [*out, rest]
