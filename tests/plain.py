"""Row-at-a-time statements of the same semantics in plain Python, to test against."""

from __future__ import annotations

import json
import re
from collections import deque


def luhn(value):
    digits = [int(c) for c in value if c.isdecimal()]
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return 13 <= len(digits) <= 19 and total % 10 == 0


def mask_session(texts, rules):
    """Mask the texts of one session in order; (masked texts, mask to original)."""
    marks, counts, back, out = {}, {}, {}, []
    for text in texts:
        for rule in rules.ordered:

            def swap(hit, rule=rule):
                value = hit.group(0)
                if rule.category == "credit_card" and not luhn(value):
                    return value
                if value not in marks:
                    counts[rule.category] = counts.get(rule.category, 0) + 1
                    mask = rule.template.replace("{idx}", str(counts[rule.category]))
                    marks[value] = mask
                    back[mask] = value
                return marks[value]

            text = re.sub(rule.pattern, swap, text, flags=re.I if rule.ignore_case else 0)
        out.append(text)
    return out, back


def restore(text, back):
    for mask, original in sorted(back.items(), key=lambda e: len(e[0]), reverse=True):
        text = text.replace(mask, original)
    return text


def tokens(text):
    if not text:
        return 0
    total = 0
    for piece in re.findall(r" ?[A-Za-z0-9_]+|[^\w\s]|\n+|\s{2,}", text):
        word = piece.lstrip()
        if not word:
            total += max(1, len(piece) // 4)
        elif word.isalnum() and len(word) > 6:
            total += 1 + (len(word) - 3) // 4
        else:
            total += 1
    return max(1, total)


def admit(rows, limits):
    """rows of (request, client, ts, tokens) to {request: decision}."""
    kept, out = {}, {}
    for request, client, ts, amount in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if 0 < limits.max_tokens_per_request < amount:
            out[request] = "oversize"
            continue
        window = kept.setdefault(client, deque())
        while window and window[0][0] < ts - limits.window_us:
            window.popleft()
        if 0 < limits.max_requests_per_minute <= len(window):
            out[request] = "requests"
        elif 0 < limits.max_tokens_per_minute < sum(k for _, k in window) + amount:
            out[request] = "tokens"
        else:
            window.append((ts, amount))
            out[request] = "ok"
    return out


# --- JSON passes -----------------------------------------------------------------


def _outside_strings(text, step):
    out, i = [], 0
    while i < len(text):
        if text[i] == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            j = min(j + 1, len(text))
            out.append(text[i:j])
            i = j
        else:
            piece, used = step(text, i)
            out.append(piece)
            i += used
    return "".join(out)


def block(text):
    fence = re.search(r"```(?:json)?\s*\n?([\s\S]*?)\n?```", text, re.I)
    if fence:
        return fence.group(1).strip()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return text.strip()
    start = min(starts)
    end = text.rfind("}" if text[start] == "{" else "]")
    return (text[start : end + 1] if end > start else text[start:]).strip()


def comments(text):
    def step(t, i):
        if t.startswith("//", i):
            return "", len(re.match(r"[^\r\n]*", t[i:]).group())
        if t.startswith("/*", i):
            end = t.find("*/", i + 2)
            return "", (len(t) if end < 0 else end + 2) - i
        return t[i], 1

    return _outside_strings(text, step)


def literals(text):
    def step(t, i):
        for word, fixed in (("True", "true"), ("False", "false"), ("None", "null")):
            around = t[i - 1 : i] + t[i + len(word) : i + len(word) + 1]
            if t.startswith(word, i) and not re.search(r"\w", around):
                return fixed, len(word)
        return t[i], 1

    return _outside_strings(text, step)


def quotes(text):
    def step(t, i):
        if t[i] != "'":
            return t[i], 1
        out, j = '"', i + 1
        while j < len(t):
            if t[j] == "\\":
                out += t[j : j + 2]
                j += 2
            elif t[j] == "'":
                return out + '"', j + 1 - i
            else:
                out += '\\"' if t[j] == '"' else t[j]
                j += 1
        return out, j - i

    return _outside_strings(text, step)


def commas(text):
    def step(t, i):
        return ("", 1) if re.match(r",\s*[}\]]", t[i:]) else (t[i], 1)

    return _outside_strings(text, step)


def closers(text):
    stack, open_string = [], False
    bare = re.sub(r'"(?:[^"\\]|\\[\s\S])*"', "", text)
    if '"' in bare:
        open_string = True
        bare = bare[: bare.index('"')]
    for mark in re.findall(r"[\[\]{}]", bare):
        if mark in "{[":
            stack.append("}" if mark == "{" else "]")
        elif stack and stack[-1] == mark:
            stack.pop()
    text = text.rstrip() + ('"' if open_string else "")
    if text.endswith(","):
        text = text[:-1].rstrip()
    return text + "".join(reversed(stack))


def repair(text):
    return commas(closers(commas(quotes(literals(comments(block(text)))))))


def _refuse(_):
    raise ValueError


def parse(text):
    """(value, tier); tier None if it is no JSON."""
    if text.strip():
        for tier, fix in enumerate((str.strip, block, repair)):
            try:
                return json.loads(fix(text), parse_constant=_refuse), tier
            except ValueError:
                pass
    return None, None


def body_tokens(body):
    """Of a request body: every string field and text part of messages, or a prompt of any shape."""

    def of_messages(items):
        total = 3
        for message in items:
            total += 3
            for value in message.values():
                if isinstance(value, str):
                    total += tokens(value)
                elif isinstance(value, list):
                    total += sum(tokens(p["text"]) for p in value if isinstance(p, dict) and p.get("type") == "text")
        return total

    if body.get("messages"):
        return of_messages(body["messages"])
    prompt = body.get("prompt")
    if isinstance(prompt, list) and prompt:
        return of_messages(prompt) if isinstance(prompt[0], dict) else sum(map(tokens, prompt))
    return tokens(prompt) if isinstance(prompt, str) else 0
