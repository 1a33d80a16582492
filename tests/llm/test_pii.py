"""Personal data against the patterns as they are stated, planted disguises with known spans, and long runs of all kinds."""

import random
import re
import time

import pytest

from citadine.llm import pii

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = "zero one two three four five six seven eight nine".split()


def check_digit(number):
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in number[::-1][::2])
    return str(-(doubled + sum(int(c) for c in number[::-1][1::2])) % 10)


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(number) <= 19 and check_digit(number[:-1]) == number[-1]):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("letters", ["ab.@-1", "a1@.", "01. -", "+1 ().-2", "0123456789 -", "4111111111111111 -+.@a", "1.2 ", "25.50 "])
def test_plain_spans_are_those_of_the_stated_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.matches(text) == stated(text), text


def disguised(rng, kind):
    """A disguised identifier of the kind."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    say = lambda number: " ".join(NAMES[int(c)] for c in number)
    if kind == "email":
        local, host, top = rng.choice(["jane", "bob.k", "a_b", "mail7"]) + digit(2), rng.choice(["firm", "mail-x", "dept.uni"]), rng.choice("com org de ru fr io museum".split())
        return rng.choice([f"{local} [at] {host} [dot] {top}", f"{local} (at) {host}.{top}", f"{local} at {host} dot {top}", f"{local}＠{host}．{top}", f"{local}@{host}.{top}".replace("a", "а"), f"{local}​@{host}.​{top}", f"{local} <at> {host} <dot> {top}"])
    if kind == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([" dot ".join(parts), "[.]".join(parts), " dot ".join(say(p) for p in parts), ".".join(parts).translate({48 + k: 0xFF10 + k for k in range(10)})])
    if kind == "card":
        number = "4" + digit(14)
        number += check_digit(number)
        wide = number.translate({48 + k: 0xFF10 + k for k in range(10)})
        return rng.choice([wide, say(number), number[:8] + "​" + number[8:], "–".join(number[k : k + 4] for k in (0, 4, 8, 12))])
    number = "4" + str(rng.randint(1, 9)) + digit(9)
    return rng.choice(["plus " + say(number), "＋" + number, "+" + number.translate({48 + k: 0x660 + k for k in range(10)}), "+" + number[:5] + "‑" + number[5:]])


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted_disguises_are_found_with_their_spans(kind):
    rng, found, tries = random.Random(kind), 0, 400
    for _ in range(tries):
        own = disguised(rng, kind)
        before = rng.choice(["Reach me: ", "Éé – ", "line\n\n\n\n  "])
        text = f"{before}{own}, thanks. Look at the dot on it."
        base = pii.matches(text)
        spans = pii.ordered(base + pii.added(text, base))
        found += any(k == kind and (i, j) == (len(before), len(before) + len(own)) for k, i, j in spans)
        assert all(s in spans for s in base)
    assert found >= 0.9 * tries, f"{found} of {tries}"


SENTENCES = (
    "Look at the dot on it. One two three four, go. We stand at this point and wait. It stops at one period in May. In 1999 there were 10.5 of them, at home and away. "
    "At boiling point of water, see (c) and [1]. Seven of nine came at eleven. Un deux de la une. Chapter 3.2.1 says at most 12, 13 and 14. The dot at the end of a line is a period. "
    "Five at a time, two by two. He looked at dot matrix printers. Version 1.2.3 - see <b>."
).split(". ")


def test_clean_prose_has_no_spans():
    rng = random.Random(2)
    for _ in range(300):
        text = ". ".join(rng.choice(SENTENCES) for _ in range(12))
        base = pii.matches(text)
        assert base == stated(text) == [] and pii.added(text, base) == [], text


N = 150_000
RUNS = {
    "digits": "1" * N,
    "letters": "a" * N + "@" + "a" * N,
    "signs": "a@" * N,
    "dots": "a." * N + "1." * N,
    "blanks": "bob [at] x [dot] com" + " " * N + "\n" * N,
    "brackets": "[" * N + "[ " * N,
    "spelled": "one " * N,
    "spelled and plain": "1 one " * N,
    "ats": "a at b dot " * (N // 4),
    "numbers": "a at 1" + " dot 1" * (N // 4),
    "dashes": "one" + "-" * N + "one two three four",
    "pluses": "+1" * N + "+(" * N,
    "foreign": "а" * N,
    "addresses": "a@b.co " * (N // 4) + " x [at] y [dot] com",
}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_take_time_in_proportion(name):
    began = time.process_time()
    base = pii.matches(RUNS[name])
    pii.added(RUNS[name], base)
    assert time.process_time() - began < 10


def test_parts_of_thousands_of_digits():
    for part, want in (("9" * 5000, []), ("0" * 5000 + "7", [("ip", 0, 5007)])):
        assert [s for s in pii.matches("1.1.1." + part) if s[0] == "ip"] == want


def test_masking(spark):
    rows = [(1, "to a.b@c.de or +1 (988) 555-2485 ok"), (2, None), (3, ""), (4, "nothing here")]
    got = {r["doc_id"]: r["text"] for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "to <email> or <phone> ok", 2: None, 3: "", 4: "nothing here"}
