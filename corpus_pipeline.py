"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from citadine.llm import bpe, mixing, near, quality, queries, runs, scratch
from citadine.session import ready

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Operator 8: the documents that its verdict keeps."""
    return quality.keep(docs)


def line_dedup(spark, docs, sf_dir):
    """Operator 2: texts without the lines that it drops; n_chars follows the text."""
    return runs.without_repeated_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """Operator 6: the smallest doc_id of each group of linked documents."""
    return near.representatives(docs)


def mix(spark, docs, sf_dir):
    """Operator 5: each document as often as the mix takes any of it whole or in part; documents it doesn't take go."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """Operator 9: the ids of each document, and the text decoded from them."""
    return bpe.bpe(docs, queries.tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("mixing sources", mix),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """Documents through all stages; what a stage wrote for itself, and the table that it read, go when its result is written."""
    docs = queries.documents(ready(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch.scope() as made:
            out = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(out)
        scratch.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
