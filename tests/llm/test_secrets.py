"""Short secrets and the cut of runs into items, against plain versions over random texts."""

import random
import string

import pyarrow as pa
import pytest

from quire.llm import blocks as B
from quire.llm import pii


def plain_secrets(text):
    """(start, end) by looking at every position for a cue."""
    low, out, done = text.lower(), [], 0
    at = 0
    while at < len(text):
        cue = next((c for c in sorted(pii.STRONG, key=len, reverse=True) if low.startswith(c, at)), None)
        if cue is None or (at and text[at - 1] in string.ascii_letters + string.digits):
            at += 1
            continue
        k = at + len(cue)
        while k < len(text) and text[k] in " \t\"'":
            k += 1
        if k == len(text) or text[k] not in ":=":
            at += 1
            continue
        k += 1
        while k < len(text) and text[k] in " \t":
            k += 1
        if k < len(text) and text[k] in "\"'":
            k += 1
        end = k
        while end < len(text) and text[end] not in " \t\n\r\x0b\x0c\"'":
            if text[end] == "&":
                name = end + 1
                while name < len(text) and text[name] in string.ascii_letters + string.digits + "_.-":
                    name += 1
                if name > end + 1 and name < len(text) and text[name] == "=":
                    break
            end += 1
        at = k
        value = text[k:end].rstrip(".,;:!?\"'`")
        if k >= done and len(value) >= pii.SHORT and any(c in string.ascii_letters for c in value) and any(c not in string.ascii_letters for c in value):
            out.append((k, k + len(value)))
            done = k + len(value)
    return out


PROBES = {
    "config: password=hunter2x end": ["hunter2x"],
    "the password = hunter2x here": ["hunter2x"],
    "url?user=bob&password=hunter2x": ["hunter2x"],
    "?a=b&token=abc123def": ["abc123def"],
    "?token=abc123def&x=1": ["abc123def"],
    "password" + " " * 21 + "= hunter2x": ["hunter2x"],
    "PASSWORD: 'hunter2x'": ["hunter2x"],
    "mypassword=hunter2x": [],
    "password=hunter": [],
    "secret: token=abc123d": ["token=abc123d"],
    "token:password=abc123d": ["password=abc123d"],
}


def test_probes():
    for text, want in PROBES.items():
        assert [text[s:e] for s, e in pii.short_secrets(text.encode())] == want, text


def test_secrets_equal_a_plain_search():
    rng = random.Random(5)
    pieces = ["password", "token", "api_key", "pwd", "Secret", "=", ":", " ", "  ", "\t", '"', "'", "&", "a1", "hunter2x", "x.", "bob", "_", "\n", "b=", "Z9!"]
    for _ in range(10_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert list(pii.short_secrets(text.encode())) == plain_secrets(text), text


def test_secrets_take_time_in_proportion():
    for text in ("password " * 60_000, "password=" * 60_000, "password" + " " * 600_000, "token=" + "a&b" * 200_000, "=" * 600_000):
        list(pii.short_secrets(text.encode()))


def best_cut(kind, t, words):
    """Cost of the cheapest cut into items, by the stated costs, over all cuts."""
    text = [t[s:e] for s, e in words]
    number = lambda x: sum(48 <= c <= 57 for c in x)
    is_at = [x.strip(b"()[]").lower() == b"at" for x in text]
    is_dot = [x.strip(b"()[]").lower() == b"dot" or b"." in x.strip(b".,;:!?\"'`") for x in text]
    n = len(words)

    def item(i, j):
        raw = t[words[i][0] : words[j - 1][1]]
        head = text[i].lstrip(b".,;:!?\"'`")
        s, e = words[i][0] + len(text[i]) - len(head), words[j - 1][1] - len(text[j - 1]) + len(text[j - 1].rstrip(b".,;:!?\"'`"))
        mail = any(b"@" in x for x in text[i:j]) or (j > i + 2 and any(is_at[i + 1 : j - 1]) and any(is_dot[i + 2 : j]))
        digits = sum(map(number, text[i:j]))
        if s >= e or not pii.plausible(kind, e - s, digits, kind == 0 and mail):
            return None
        odd = 0.5 * (digits not in (15, 16)) if kind == 2 else 0.01 * (digits - 10) ** 2 if kind == 3 else 0
        breaks = sum(b"\n" in t[words[k - 1][1] : words[k][0]] for k in range(i + 1, j))
        alone = [is_at[k] or b"@" in text[k] if kind == 0 else pii.plausible(kind, len(text[k]), number(text[k]), False) for k in range(i, j)]
        opens = [(b"@" in text[k] or (k + 1 < n and is_at[k + 1])) if kind == 0 else kind == 3 and (text[k][:1] == b"+" or (text[k][:1] == b"(" and (not k or text[k - 1][:1] != b"+"))) for k in range(i + 1, j)]
        return 0.1 + odd + 3 * breaks + 2 * max(0, sum(alone) - 1) + 10 * sum(opens), (s, e), raw

    best = {0: 0.0}
    for j in range(1, n + 1):
        best[j] = min([best[j - 1] + 20] + [best[i] + x[0] for i in range(j) if (x := item(i, j))])
    return best[n], item


@pytest.mark.parametrize("kind", [0, 2, 3, 4])
def test_items_are_the_cheapest_cut(kind):
    rng = random.Random(kind)
    pieces = {0: [b"bob", b"at", b"(at)", b"x.org", b"dot", b"com", b"a@b.de", b"mail."], 2: [b"4111", b"1111", b"411111111111", b"12", b"x"], 3: [b"+49", b"(030)", b"1234", b"567-89", b"5551234567", b"ext"], 4: [b"abc123def456", b"x", b"Zz99Zz99Zz99,", b"k=1"]}[kind]
    for _ in range(2500):
        words, t = [], b""
        for _ in range(rng.randrange(1, 11)):
            t += rng.choice([b" ", b" ", b"\n"]) if t else b""
            w = rng.choice(pieces)
            words.append((len(t), len(t) + len(w)))
            t += w
        got = list(pii.entities(kind, t, words))
        want, item = best_cut(kind, t, words)
        cost, used = 0.0, 0
        for s, e in got:
            i = next(k for k, (a, b) in enumerate(words) if a <= s < b)
            j = next(k for k, (a, b) in enumerate(words) if a < e <= b) + 1
            cost += item(i, j)[0]
            used += j - i
        assert abs(cost + 20 * (len(words) - used) - want) < 1e-9, t
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_secrets_in_blocks_and_redaction():
    model = pii.fit(pii.labelled_rows())
    texts = [*PROBES, None, ""]
    for _, _, b in B.blocks(pa.array(texts, pa.string())):
        _, every, patterns = pii.block_spans(b, model)
        for i, text in enumerate(texts[: len(PROBES)]):
            held = pii.redacted(text, every.get(i, []))
            assert all(secret not in held for secret in PROBES[text]), (text, held)
        assert sum(patterns.values()) > 0
