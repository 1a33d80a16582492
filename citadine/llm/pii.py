"""Operator 1: personal data, with disguises undone by offset-preserving transducers.

The plain patterns run over each whole text. Then, where a text has any sign of a disguise, transducers rewrite it while every character of
the result keeps the span of source characters that it stands for: look-alike letters, digits and signs become ASCII and invisible characters go;
spelled digits become digits; written or bracketed at and dot become @ and a full stop. The same patterns run over the result and their
matches are mapped back. Matches that a plain one of the same kind already contains add nothing.

Bare "at" and "dot" are common words, so they are rewritten only together, between parts of an address, and spelled digits only in runs
of four or as four numbers with dots between them. With a written dot the last label may be any of two or more letters; one that is not listed in DOMAINS
needs an at sign, or a host that does not begin with an article or the like ("look at the dot on it"), and after "point" or "period" it may not be a function word.
A bare at before a host with plain dots needs a listed label and a digit, dot or underscore in the local part. Spans are in code points of the source text, ends exclusive.

Every step takes time in proportion to the text, whatever it holds. Addresses are found from their @ outwards, numbers from the beginning of a run of digits, and runs of blanks
are shortened to two characters before anything is rewritten.

Null and empty texts have no spans. Rows with null or repeated doc_id are read each by itself; extra columns are ignored by op1 and
kept by masked. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citadine.llm import words

KINDS = ("email", "ip", "card", "phone")
LOCAL = ascii_letters + digits + "._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: The plain patterns but for that of addresses, so that no run of characters is tried from each of its places: an IP or card number can only begin where digits do.
NUMBERS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Letters of other scripts and the Latin letters that they look like; signs that look like a dot, dash, plus or at; invisible characters.
FOREIGN_LETTERS = "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN_LETTERS = "aeopcyxijshdqwABEKMHOPCTYXIJSaovpABEZHIKMNOPTYX"
DOTS, DASHES, PLUSES, ATS = "․。｡‧∙﹒．", "‐‑‒–—―−﹣﹘－", "₊⁺﹢＋", "﹫＠ⓐ"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Digits by name in English, German, French and Spanish.
DIGIT_NAMES = {
    0: "zero oh null zéro cero",
    1: "one eins un uno",
    2: "two zwei zwo deux dos",
    3: "three drei trois tres",
    4: "four vier quatre cuatro",
    5: "five fünf fuenf cinq cinco",
    6: "six sechs seis",
    7: "seven sieben sept siete",
    8: "eight acht huit ocho",
    9: "nine neun neuf nueve",
}
NAMED = {name: str(d) for d, names in DIGIT_NAMES.items() for name in names.split()}
TELLING = set(NAMED) - {"un"}  # "un" alone is an article
AT, DOT = "at|ät|arroba|arobase|klammeraffe", "dot|punkt|punto|point|period"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
#: Top-level domains that let a bare "at" count before plain dots.
DOMAINS = "com|org|example|test|invalid|localhost|co|app|dev|us|ca|mx|br|se|no|pl|be|pt|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl"

ONE = "|".join(sorted(NAMED, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s-]*)?(?:(?:{ONE}|[0-9])(?:[\s,-]+|\s*\.\s*|\s+(?:{DOT})\s+)){{3,}}(?:{ONE}|[0-9])(?!\w)", re.I)
SPELLED_PART = re.compile(rf"(?P<d>{ONE})|(?P<p>plus)|(?P<dot>\s+(?:{DOT})\s+|\s*\.\s*)|(?P<gap>[\s,]+)", re.I)
BLANKS = re.compile(r"\s{3,}")
BRACKETED = re.compile(rf"\s*{OPEN}\s*(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s*{CLOSE}\s*", re.I)
LABEL = r"[A-Za-z0-9-]+"
LABELS = re.compile(LABEL)
BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\s+(?:{AT})\s+|\s*@\s*){LABEL}(?:\.{LABEL})*(?P<rest>(?:\s+(?:{DOT})\s+{LABEL}(?:\.{LABEL})*)+)", re.I)
WRITTEN_DOT = re.compile(rf"\s+(?P<dot>{DOT})\s+(?P<label>{LABEL})", re.I)
TOP = re.compile(r"[A-Za-z]{2,}|xn--[a-z0-9-]+", re.I)
LISTED = frozenset(DOMAINS.split("|"))
#: Words before "dot" or "point" that tell a place, not a host; function words after "point" or "period" that go on with a sentence.
NO_HOST = frozenset("a an the this that these those some any no each every which what one my your his her its our their der die das dem den ein eine einem einen le la les un une ce cet cette el los las al du".split())
GOING_ON = frozenset("a am an and are as at be but by can could de des did do does du for from had has have he her his if in is it its la le les may me my no nor not of on or our per she should since so than that the their them then there they this to und until up us was we were what when where which while who will with would you your".split())
BARE_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z%+-]*[0-9._])[A-Za-z0-9._%+-]+\s+(?:{AT})\s+(?:{LABEL}\.)+(?:{DOMAINS})(?![A-Za-z0-9-])", re.I)
BARE_PART = re.compile(rf"(?P<at>\s+(?:{AT})\s+|\s*@\s*)|(?P<dot>\s+(?:{DOT})\s+)", re.I)
DOTTED_NUMBER = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:\s+(?:{DOT})\s+[0-9]{{1,3}}){{3}}(?!\w)", re.I)
DIGIT = rf"(?:{ONE}|[0-9])(?![A-Za-z0-9])"
NUMBER = rf"(?:[0-9]+(?!\w)|{DIGIT}(?:[\s-]+{DIGIT}){{0,2}})"
IP_DOT = rf"(?:\s+(?:{DOT})\s+|\s*{OPEN}\s*(?:{DOT}|\.)\s*{CLOSE}\s*|\.)"
SPELLED_IP = re.compile(rf"(?<!\w){NUMBER}(?:{IP_DOT}{NUMBER}){{3}}(?!\w)(?![\s-]+{DIGIT})", re.I)
SPELLED_IP_PART = re.compile(rf"(?P<dot>{IP_DOT})|(?P<d>{ONE}|[0-9])|(?P<gap>[\s-]+)", re.I)
BEFORE_IP = re.compile(rf"(?:(?:plus|\+)[\s-]*|(?<!\w)(?:{ONE}|[0-9])[\s-]+)\Z", re.I)
LETTER_DIGITS = re.compile(r"(?<=[0-9])[OoIl](?=[\x20-]?[0-9])")
SIGNS = re.compile(rf"{OPEN}\s*(?:{AT}|{DOT}|[.@])\s*{CLOSE}|\s(?:{DOT})\s|\s(?:{AT})\s+(?:{LABEL}\.)+(?:{DOMAINS})|[0-9][OoIl][\x20-]?[0-9]", re.I)


def _folds() -> dict[int, str]:
    """What each foreign character becomes: look-alikes, width and style variants, other scripts' digits; nothing for invisible ones."""
    table = {ord(a): b for a, b in zip(FOREIGN_LETTERS, LATIN_LETTERS, strict=True)}
    for signs, plain in ((DOTS, "."), (DASHES, "-"), (PLUSES, "+"), (ATS, "@"), (INVISIBLE, "")):
        table |= {ord(c): plain for c in signs}
    spans = [(0x2000, 0x2070), (0x2070, 0x20A0), (0x2100, 0x2200), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0xA0, 0xA1), (0x202F, 0x2030), (0x205F, 0x2060), (0x3000, 0x3001)]
    for a, b in spans:
        for c in range(a, b):
            plain = unicodedata.normalize("NFKC", chr(c))
            if c not in table and len(plain) == 1 and plain.isascii() and plain != chr(c):
                table[c] = plain
    for c in range(0x660, 0x1FBFA):
        if c not in table and unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.digit(chr(c)))
    return table


FOLDS = _folds()
FOREIGN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLDS)) + "]")


MARK = np.zeros(256, bool)
MARK[list(b"[({<0123456789@")] = True


NO_SIGNS = str.maketrans("", "", " ()+.-")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [x.lstrip("0") for x in found.split(".")]
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in parts)
    only = found.translate(NO_SIGNS)
    if kind == "card":
        return 13 <= len(only) <= 19 and luhn(only)
    return 9 <= len(only) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: from each @ back over all that can be before it, but not into the match before, and forth over its host."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        begin = free + len(before.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def matches(text: str, kinds=KINDS) -> list[tuple[str, int, int]]:
    """Leftmost matches that don't overlap, for each kind; those that fail its condition go, without another try."""
    out = []
    for kind in kinds:
        if kind == "email":
            out += [(kind, i, j) for i, j in emails(text)]
        else:
            out += [(kind, m.start(), m.end()) for m in NUMBERS[kind].finditer(text) if holds(kind, m[0])]
    return out


class Mapped:
    """A text and, for each of its characters, the span of source characters that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given parts, in order; each new character stands for the whole part."""
        if not edits:
            return
        texts, starts, ends, at = [], [], [], 0
        for i, j, new in edits:
            texts += [self.text[at:i], new]
            starts += self.starts[at:i] + [self.starts[i]] * len(new)
            ends += self.ends[at:i] + [self.ends[j - 1]] * len(new)
            at = j
        self.text = "".join(texts) + self.text[at:]
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def squeezed(m: Mapped) -> None:
    """Of a run of blanks the first two stay, so that no pattern sees a long one."""
    m.rewrite([(x.start() + 2, x.end(), "") for x in BLANKS.finditer(m.text)])


def folded(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), FOLDS[ord(x[0])]) for x in FOREIGN.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), "0" if x[0] in "Oo" else "1") for x in LETTER_DIGITS.finditer(m.text)])


def spelled_ips(m: Mapped) -> None:
    """Four numbers up to 255 of which a digit is spelled, with dots between them: the digits of a number are joined without their gaps."""
    edits = []
    for x in SPELLED_IP.finditer(m.text):
        own = [(p.start(), p.end(), "." if p["dot"] else NAMED.get(p["d"].lower(), p["d"]) if p["d"] else "") for p in SPELLED_IP_PART.finditer(m.text, x.start(), x.end())]
        plain = "".join(new for _, _, new in own)
        if any(j - i > 1 and new.isdigit() for i, j, new in own) and all(1 <= len(n) <= 3 for n in plain.split(".")) and holds("ip", plain) and not BEFORE_IP.search(m.text[max(0, x.start() - 12) : x.start()]):
            edits += own
    m.rewrite(edits)


def spelled(m: Mapped) -> None:
    """Runs of four or more digits of which three are spelled; gaps become single spaces, a written dot a full stop."""
    edits = []
    for run in SPELLED.finditer(m.text):
        parts = list(SPELLED_PART.finditer(m.text, run.start(), run.end()))
        if sum(bool(p["d"]) for p in parts) >= 3:
            edits += [(p.start(), p.end(), NAMED[p["d"].lower()] if p["d"] else "+" if p["p"] else "." if p["dot"] else " ") for p in parts]
    m.rewrite(edits)
    m.rewrite([(p.start(), p.end(), "") for p in re.finditer(r"(?<=\+)\s+(?=[0-9])", m.text)])


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of the at and the written dots of addresses, up to the last label that can end one."""
    at = 0
    while x := BARE.search(text, at):
        edits, kept = [(x.start("at"), x.end("at"), "@")], 0
        host = LABELS.match(text, x.end("at"))[0].lower()
        sure = "@" in x["at"] or host not in NO_HOST
        for p in WRITTEN_DOT.finditer(text, x.start("rest"), x.end("rest")):
            label, noun = p["label"].lower(), p["dot"].lower() in ("point", "period")
            edits.append((p.start(), p.start("label"), "."))
            if kept and noun and label not in LISTED and (len(label) != 2 or label in GOING_ON):
                break
            if label in LISTED or (TOP.fullmatch(label) and sure and not (noun and label in GOING_ON)):
                kept, at = len(edits), p.end()
        if kept:
            yield from edits[:kept]
        else:
            at = x.end("at")


def written(m: Mapped) -> None:
    """At and dot in brackets; then bare ones, between parts of an address or of four numbers."""
    m.rewrite([(x.start(), x.end(), "@" if x["at"] else ".") for x in BRACKETED.finditer(m.text)])
    m.rewrite(list(addresses(m.text)))
    for pattern in (BARE_AT, DOTTED_NUMBER):
        m.rewrite([(p.start(), p.end(), "@" if p["at"] else ".") for x in pattern.finditer(m.text) for p in BARE_PART.finditer(m.text, x.start(), x.end())])


def disguised(text: str, foreign: bool, marked: bool) -> bool:
    """Whether a transducer can change the text; ``foreign``: it may have foreign characters, ``marked``: brackets, digits or dots inside words."""
    if foreign and FOREIGN.search(text):
        return True
    low = text.lower()
    if (marked or any(x in low for x in DOT.split("|"))) and SIGNS.search(text):
        return True
    parts = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    return not TELLING.isdisjoint(parts) and (SPELLED.search(text) or SPELLED_IP.search(text)) is not None


def added(text: str, base: list[tuple[str, int, int]], foreign: bool = True, marked: bool = True) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows."""
    short = BLANKS.sub(lambda x: x[0][:2], text)
    if not disguised(short, foreign, marked):
        return []
    m = Mapped(text)
    if short != text:
        squeezed(m)
    for step in (folded, spelled_ips, spelled, written):
        step(m)
    if m.text == short:
        return []
    out = []
    known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for kind, i, j in matches(m.text):
        begin, end = m.starts[i], m.ends[j - 1]
        at = bisect_right(known[kind], (begin, len(text) + 1)) - 1  # the last that begins no later; plain ones of a kind don't overlap
        if at < 0 or known[kind][at][1] < end:
            out.append((kind, begin, end))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def found_in(piece: pa.RecordBatch) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its plain spans and all its spans. Bytes tell which patterns can match at all."""
    raw, offsets = words.text_bytes(piece.column("text"))
    inside = np.zeros(len(raw), bool)
    inside[:-1] = (raw[:-1] == ord(".")) & ~words.SPACE[raw[1:]]
    marks, far = MARK[raw] | inside, raw >= 0xC4  # first bytes of what is beyond Latin-1
    far[:-1] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0xA0) | (raw[1:] == 0xAD))  # and its no-break space and soft hyphen
    at, digits, foreign, marked = (words.sums(x, offsets) > 0 for x in (raw == ord("@"), (raw >= 48) & (raw <= 57), far, marks))
    for text, has_at, has_digit, has_foreign, has_mark in zip(piece.column("text").to_pylist(), at, digits, foreign, marked):
        if not text:
            yield [], []
            continue
        base = matches(text, [k for k in KINDS if (has_at if k == "email" else has_digit)])
        yield base, ordered(base + added(text, base, has_foreign, has_mark))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in words.pieces(batches):
        rows = [(*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)) for base, spans in found_in(piece)]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in RESULT.split(", ")])


def op1(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_report, RESULT)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in words.pieces(batches):
        texts = []
        for text, (_, spans) in zip(piece.column("text").to_pylist(), found_in(piece)):
            at, parts = len(text or ""), []
            for k, i, j in sorted(spans, key=lambda s: (-s[2], s[1])):
                if j <= at:
                    parts += [text[j:at], f"<{k}>"]
                    at = i
            texts.append(text[:at] + "".join(reversed(parts)) if parts else text)
        k = piece.schema.get_field_index("text")
        yield piece.set_column(k, "text", pa.array(texts, pa.string()))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind; of spans that overlap the one that ends last is replaced."""
    return docs.mapInArrow(_mask, docs.schema)
