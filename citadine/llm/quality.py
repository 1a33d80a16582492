"""Operator 8: quality by weak supervision.

Rules vote good (1) or bad (-1) on a document, or abstain (0). Each rule errs: prose may be short, repeat itself or have few full stops. Documents with the
same votes count as one pattern; expectation-maximisation over the pattern counts
estimates how often each rule votes so on good and on bad documents, and the share of good documents, and the posterior
probability of being good decides. So a document with a bad vote of a rule that good documents often fail stays, if the other rules speak for it, and one
without any goes if its abstentions are those of bad documents. There are at most 3 ** len(RULES) patterns,
whatever the number of documents, so only they come to the driver.

Null and empty texts have no words and fail the base rules. Rows with a null
or repeated doc_id are judged each by its own text. Extra columns, whatever their names, are ignored by op8 and kept by keep.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citadine.llm import scratch, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?")] = True
LETTER = np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(0xC0, 0x100))] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_closed long, n_lettered long"

#: name, value, good from/to, bad below/above: a rule votes good inside the first range, bad outside the second, and abstains between.
RULES = (
    ("length", "n_words", (100, math.inf), (75, math.inf)),
    ("word_length", "try_divide(word_chars, n_words)", (4.5, 5.6), (4.2, 7)),
    ("symbols", "try_divide(n_symbols, n_words)", (0, 0.1), (0, 0.3)),
    ("symbol_share", "try_divide(n_symbols, word_chars)", (0, 0.02), (0, 0.05)),
    ("repeats", "try_divide(n_repeat_words, n_words)", (0, 0.05), (0, 0.2)),
    ("closed", "try_divide(n_closed, n_words)", (0.05, 0.15), (0.03, 0.2)),
    ("lettered", "try_divide(n_lettered, n_words)", (0.97, 1), (0.9, 1)),
    ("line_words", "try_divide(n_words, n_lines)", (10, 150), (6, 400)),
)


def features(passed: str):
    """A mapper from text to its counts; the column ``passed`` goes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            raw, offsets = words.text_bytes(piece.column("text"))
            starts, ends, firsts = words.word_spans(raw, offsets)
            n_docs, owner = len(offsets) - 1, words.document_of(firsts)
            hashes = words.span_hashes(raw, starts, ends)
            lines = words.line_spans(raw, offsets)
            worded = words.sums(~words.SPACE[raw], np.append(lines[0], len(raw)))[: len(lines[0])] > 0 if len(raw) else np.zeros(n_docs, bool)
            line_keys = words.mixed(words.span_hashes(raw, lines[0], lines[1]) ^ words.mixed(lines[2].astype(np.uint64) + words.BASE))
            line_keys, line_owner = line_keys[worded], lines[2][worded]
            _, first = np.unique(line_keys, return_index=True)
            n_lines = np.bincount(line_owner, minlength=n_docs)
            windows = words.grams(hashes, 3)
            at = np.flatnonzero(owner[: len(windows)] == owner[2:]) if len(windows) else np.zeros(0, np.int64)
            twice = at[words.repeated(words.mixed(windows[at] ^ words.mixed(owner[at].astype(np.uint64) + words.BASE)))]
            letters = np.concatenate([[0], np.cumsum(LETTER[raw], dtype=np.int64)])
            columns = [
                np.diff(firsts),
                words.sums(~words.SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
                words.sums(SYMBOL[raw], offsets),
                n_lines - np.bincount(line_owner[first], minlength=n_docs),
                words.sums(words.covered(twice, 3, len(starts)), firsts),
                n_lines,
                words.sums(CLOSING[raw[ends - 1]] if len(ends) else np.zeros(0, bool), firsts),
                words.sums(letters[ends] > letters[starts], firsts),
            ]
            yield pa.RecordBatch.from_arrays([piece.column(passed), *(pa.array(x, pa.int64()) for x in columns)], names=[passed, *(x.split()[0] for x in COUNTS.split(", "))])

    return run


def votes(rules=RULES):
    """One column: the votes of all rules as an array of -1, 0 and 1; documents without words get bad votes only."""
    out = []
    for _, value, good, bad in rules:
        x = F.expr(f"({value}) * 1D")
        inside = (x >= good[0]) & (x <= good[1])
        outside = (x < bad[0]) | (x > bad[1])
        out.append(F.when((F.col("n_words") > 0) & inside, 1).when((F.col("n_words") == 0) | outside, -1).otherwise(0))
    return F.array(*out)


def fitted(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """By EM: the probability of good for each pattern; the shares of bad, abstaining and good votes of each rule on good (0) and on bad documents (1); and the share of good ones.

    Given the class, rules vote independently. The start is each pattern's share of good among its votes; from there the estimates move freely, but for half
    a vote of each kind that is added to every share. Of the two classes that come out the good one is that on which rules vote good more often. Counts are whole
    numbers, so the result doesn't depend on the order of rows.
    """
    vote, count = np.array(patterns, int).reshape(len(patterns), -1), np.array(counts, float)
    is_vote = np.stack([vote == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, rule, vote
    good = ((vote > 0).sum(1) + 1) / ((vote != 0).sum(1) + 2)
    for _ in range(rounds):
        weights = np.stack([good * count, (1 - good) * count])
        shares = np.einsum("cp,prv->crv", weights, is_vote) + 0.5
        shares /= shares.sum(2, keepdims=True)
        prior = float(np.clip(weights[0].sum() / count.sum(), 0.01, 0.99))
        odds = math.log(prior / (1 - prior)) + np.einsum("prv,rv->p", is_vote, np.log(shares[0] / shares[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-10:
            break
    lean = (shares[:, :, 2] - shares[:, :, 0]).sum(1)
    return (good, shares, prior) if lean[0] >= lean[1] else (1 - good, shares[::-1], 1 - prior)


def posteriors(patterns: list[tuple[int, ...]], counts: list[int]) -> np.ndarray:
    """Probability of good for each pattern, to nine digits."""
    return np.round(fitted(patterns, counts)[0], 9) if patterns else np.zeros(0)


def counted(rows: DataFrame, passed: str, rules=RULES) -> DataFrame:
    """The counts of ``rows`` (a column ``passed``, and text) with the rules' votes and base_failed."""
    schema = T.StructType([rows.schema[passed], *(T.StructField(x.split()[0], T.LongType()) for x in COUNTS.split(", "))])
    out = rows.select(passed, "text").mapInArrow(features(passed), schema)
    return out.withColumn("votes", votes(rules)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def learned(judged: DataFrame) -> DataFrame:
    """quality of each pattern of votes among the documents; at most 3 ** len(rules) rows."""
    seen = judged.groupBy("votes").count().collect()
    seen.sort(key=lambda r: tuple(r["votes"]))
    good = posteriors([tuple(r["votes"]) for r in seen], [r["count"] for r in seen])
    return judged.sparkSession.createDataFrame([(list(r["votes"]), float(p)) for r, p in zip(seen, good, strict=True)], "votes array<int>, quality double")


def verdict(judged: DataFrame, patterns: DataFrame, threshold: float) -> DataFrame:
    out = judged.join(F.broadcast(patterns), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: the counts, ``quality`` (posterior probability), ``base_failed`` and ``kept``."""
    judged = scratch.table(counted(docs.select("doc_id", "text"), "doc_id", rules), "quality")
    return verdict(judged, learned(judged), threshold)


def op8(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """The documents that the verdict keeps, all columns as they were. Texts are read and counted once; their rows wait with their votes in a written table."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = scratch.table(counted(docs.select(row, F.col("text")), "row", rules).select("row", "votes", "base_failed"), "judged")
    return verdict(judged, learned(judged), threshold).where("kept").select("row.*")
