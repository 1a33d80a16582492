"""Operator 9: BPE encoding and decoding in batched numpy merge rounds.

The tokenizer file is a parameter; it is read on the driver and reaches the workers with the task.
Texts are split at added tokens, normalised and pre-tokenised as the file says; each piece of text becomes words,
and the distinct words of a batch are merged together: the symbols of all words lie in one flat array, and every
round finds the rank of each neighbouring pair by binary search over the sorted pair keys, and merges the
lowest-ranked pairs of each word. Words met before come from a bounded cache.

Null and empty texts have no tokens. A text longer than a batch is a batch of its own. Rows with
null or repeated doc_id are encoded each by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from citadine.llm import words

NONE = np.int64(1 << 40)
CACHE_WORDS = 200_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The steps and options that are understood; the split's pattern, the end of a word, the vocabulary, merges and added tokens are the file's own.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def unknown_options(spec: dict) -> list[str]:
    """What a file has that would give other ids than this operator's."""
    differs = lambda own, known: [f"{k} is {own.get(k)!r}" for k, v in known.items() if own.get(k) != v]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    out = [] if ((spec.get("normalizer") or {}).get("normalizers")) == NORMALIZERS else ["normalizer"]
    if len(steps) != 2:
        return [*out, "pre_tokenizer"]
    out += differs(steps[0], SPLIT) + differs(steps[1], BYTES) + differs(spec["model"], MODEL)
    pattern = (steps[0].get("pattern") or {}).get("Regex")
    blanks = " \t\n\x0b\x0c\r\x85\xa0\u2003\u2028\u3000"
    if not pattern or any(c in m[0] for c in blanks for m in regex.finditer(pattern, c.join("a a1 !a 's 1! é".split(" ")) + c)):
        out.append(f"split pattern {pattern!r}, which may find white space")
    out += [f"added token {x['content']!r}: {w}" for x in spec["added_tokens"] for w in differs(x, ADDED)]
    return out + [k for k in ("decoder", "post_processor") if spec.get(k)]


@dataclass
class Tokenizer:
    """What a worker needs: the sorted pair keys with rank and result, byte symbols, and the split patterns."""

    tokens: list[str]
    first: np.ndarray  # id of a byte inside a word
    last: np.ndarray  # id of a byte at a word's end
    keys: np.ndarray  # left id << 32 | right id, sorted
    ranks: np.ndarray
    merged: np.ndarray
    added: dict[str, int]
    split: str

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        wrong = unknown_options(spec)
        if wrong:
            raise ValueError(f"not a word-level BPE file of the kind that this operator knows: {wrong}")
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters, added = byte_letters(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = vocab | added
        tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = name
        rows = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rows.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        keys = np.array(sorted(rows), np.int64)
        table = np.array([rows[k] for k in keys.tolist()], np.int64).reshape(-1, 2)
        first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        return cls(tokens, first, last, keys, table[:, 0], table[:, 1], added, steps[0]["pattern"]["Regex"])

    def merge(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the offsets of each word's."""
        sizes = np.array([len(x) for x in found], np.int64)
        raw = np.frombuffer(b"".join(found), np.uint8)
        owner = np.repeat(np.arange(len(found)), sizes)
        symbols = self.first[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        inner = owner[:-1] == owner[1:]
        at, rank = self.look_up(symbols[:-1], symbols[1:], inner)
        at, rank = np.append(at, 0), np.append(rank, NONE)  # of each symbol with its right neighbour
        done_at, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            live = best < NONE
            if not live.all():  # finished words leave, so that later rounds are shorter
                done_at.append(owner[~live])
                done_symbols.append(symbols[~live])
                symbols, owner, rank, at, best = symbols[live], owner[live], rank[live], at[live], best[live]
                if not len(symbols):
                    break
            runs = np.flatnonzero(rank == best)
            if len(runs) > 1:  # in a run such as a a a only every other pair merges, from the left
                head = np.append(True, np.diff(runs) > 1)
                begin = runs[head][np.cumsum(head) - 1]
                runs = runs[(runs - begin) % 2 == 0]
            symbols[runs] = self.merged[at[runs]]
            stay = np.ones(len(symbols), bool)
            stay[runs + 1] = False
            here = runs - np.arange(len(runs))  # where the merged symbols are, once their right neighbours have gone
            symbols, owner, rank, at = symbols[stay], owner[stay], rank[stay], at[stay]
            fresh = np.unique(np.concatenate([here, here[here > 0] - 1]))
            right = np.minimum(fresh + 1, len(symbols) - 1)
            inner = (owner[right] == owner[fresh]) & (right > fresh)
            at[fresh], rank[fresh] = self.look_up(symbols[fresh], symbols[right], inner)
        if done_at:
            owner, symbols = np.concatenate(done_at), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(found) + 1))

    def look_up(self, left: np.ndarray, right: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the sorted keys and its rank; pairs that cross words have none."""
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return at, np.where((self.keys[at] == pairs) & inner, self.ranks[at], NONE)

    def words_of(self, text: str) -> list[str]:
        """The text's parts between white space, normalised; added tokens stand as themselves.

        No piece that the split pattern finds holds white space, so pieces can be found part by part, once for each
        distinct part.
        """
        out, at = [], 0
        for m in self._added.finditer(text) if self.added else ():
            out += self.parts(text[at : m.start()])
            out.append(" " + m[0])  # a space tells it from a part with the same letters
            at = m.end()
        return out + self.parts(text[at:] if at else text)

    def parts(self, text: str) -> list[str]:
        text = self.normalised(text)
        return [x for x in self._gap.split(text) if x] if self._odd.search(text) else text.split()

    @staticmethod
    def normalised(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def start(self) -> Tokenizer:
        self._split = regex.compile(self.split)
        self._added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self._gap, self._odd = regex.compile(r"\s+"), regex.compile("[\x1c-\x1f]")  # the latter are white space to str.split() only
        named = [x.encode() + b" " for x in self.tokens]  # decoding puts a space between tokens; the last one is cut
        self._bytes = np.frombuffer(b"".join(named), np.uint8)
        self._byte_cuts = np.cumsum([0, *map(len, named)])
        self._forget()
        return self

    def _forget(self) -> None:
        self._place: dict[str, int] = {}  # of each known part in the arrays below
        self._ids, self._cuts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        found = [[x] if x[0] == " " else self._split.findall(x) for x in new]
        pieces: dict[str, int] = {}
        flat = np.array([pieces.setdefault(y, len(pieces)) for x in found for y in x], np.int64)
        special = [(k, self.added[x[1:]]) for x, k in pieces.items() if x[0] == " "]
        ids, cuts = self.merge([x.encode() for x in pieces])
        if special:
            parts = np.split(ids, cuts[1:-1])
            for k, i in special:
                parts[k] = np.array([i], np.int64)
            ids, cuts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        ids, ends = gathered(ids, cuts, flat)
        sizes = np.append(0, ends)[np.cumsum([0, *map(len, found)])]
        self._place.update(zip(new, range(len(self._cuts) - 1, len(self._cuts) - 1 + len(new))))
        self._cuts = np.concatenate([self._cuts, sizes[1:] + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin, then the UTF-8 bytes of the decoded texts and where each begins."""
        split = [self.words_of(x) for x in texts]
        if len(self._place) > CACHE_WORDS:
            self._forget()
        new = list(set().union(*split).difference(self._place)) if split else []
        for at in range(0, len(new), 100_000):
            self._learn(new[at : at + 100_000])
        place = self._place.__getitem__
        at = np.array([k for ws in split for k in map(place, ws)], np.int64)
        ids, ends = gathered(self._ids, self._cuts, at)
        cuts = np.append(0, ends)[np.cumsum([0, *map(len, split)])]
        raw, ends = gathered(self._bytes, self._byte_cuts, ids)
        byte_cuts = np.append(0, ends)[cuts]
        return ids.astype("<u4"), cuts, raw, byte_cuts


def gathered(values: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[cuts[i]:cuts[i + 1]]`` for each ``i`` of ``at``, one after another, and where each ends."""
    sizes = cuts[at + 1] - cuts[at]
    ends = np.cumsum(sizes)
    return values[np.repeat(cuts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def _mapper(tokenizer: Tokenizer, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.start()
        for piece in words.pieces(batches):
            ids, cuts, raw, byte_cuts = coder.encode([x or "" for x in piece.column("text").to_pylist()])
            spans = list(zip(cuts.tolist(), cuts[1:].tolist())), list(zip(byte_cuts.tolist(), byte_cuts[1:].tolist()))
            a, b = [ids[i:j].tobytes() for i, j in spans[0]], [raw[i : max(i, j - 1)].tobytes() for i, j in spans[1]]
            if digests:
                a, b = [hashlib.sha256(x).hexdigest() for x in a], [hashlib.sha256(x).hexdigest() for x in b]
            names = [x.split()[0] for x in (DIGESTS if digests else SCHEMA).split(", ")]
            texts = pa.array(b, pa.string()) if digests else pa.array(b, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), pa.array(a, pa.string() if digests else pa.binary()), texts], names=names)

    return run


def bpe(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the text decoded from them."""
    return docs.select("doc_id", "text").mapInArrow(_mapper(Tokenizer.read(path), False), SCHEMA)


def op9(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_mapper(Tokenizer.read(path), True), DIGESTS)
