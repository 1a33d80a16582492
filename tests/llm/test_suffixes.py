"""Suffix trees of groups against all pairs of windows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citadine.llm import suffixes, words


def repeats(texts, length):
    """Positions whose window begins anywhere else."""
    seen = defaultdict(list)
    for k, own in enumerate(texts):
        for i in range(len(own) - length + 1):
            seen[tuple(own[i : i + length])].append((k, i))
    return {p for places in seen.values() if len(places) > 1 for p in places}


def corpus(rng, n, hot):
    passages = [[f"p{k}w{i}" for i in range(rng.randint(20, 90))] for k in range(6)]
    out = []
    for _ in range(n):
        own = [f"v{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages) if rng.random() > hot else passages[0]
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[rng.randrange(10) :]
        out.append(own)
    return out + [out[3]] * 5 + [["same"] * 200, ["same"] * 90]


@pytest.mark.parametrize("modulo", [1 << 62, 5, 1])
def test_leaves_of_deep_nodes_whatever_the_hashes(modulo):
    """With hashes that collide, or are all equal, the words still decide."""
    rng = random.Random(modulo)
    text = [rng.randrange(3) for _ in range(400)] + [7, 8] * 40 + [rng.randrange(50) for _ in range(60)] * 3
    symbols = np.array(text)
    hashes = (words.mixed(symbols.astype(np.uint64)) % np.uint64(modulo)).astype(np.uint64)
    for length in (5, 12, 35):
        at = np.arange(len(text) - length + 1)
        state = suffixes.nodes(symbols, hashes, at, length)
        groups = defaultdict(list)
        for i in at.tolist():
            groups[tuple(text[i : i + length])].append(i)
        for own in groups.values():
            assert sorted(state[own].tolist()) == ([suffixes.ALONE] if len(own) == 1 else [suffixes.WITNESS] + [suffixes.OTHER] * (len(own) - 1))


def test_words_with_equal_hashes_get_numbers_of_their_own():
    texts = pa.array(["alpha beta alpha gammagammagammagamma beta", "gammagammagammagammA alphA x gammagammagammagamma"])
    raw, offsets = words.text_bytes(texts)
    starts, ends, _ = words.word_spans(raw, offsets)
    own = [bytes(raw[i:j]) for i, j in zip(starts, ends)]
    for hashes in (words.span_hashes(raw, starts, ends), np.zeros(len(own), np.uint64), (ends - starts).astype(np.uint64)):
        number = suffixes.numbered(raw, starts, ends, hashes).tolist()
        assert all((a == b) == (x == y) for a, x in zip(own, number) for b, y in zip(own, number))


@pytest.mark.parametrize("anchors, batch, hot", [(100_000, 500_000, 0.0), (3, 50, 0.0), (1, 300, 0.9), (40, 20, 0.9)])
def test_groups_of_any_size(spark, monkeypatch, anchors, batch, hot):
    """Prefixes extended to whole windows, segments cut by groups, and witnesses of passages that nearly all batches hold."""
    monkeypatch.setattr(suffixes, "GROUP_ANCHORS", anchors)
    texts = corpus(random.Random(anchors), 120, hot)
    length, wanted = 14, repeats(texts, 14)
    docs = spark.createDataFrame([(k, "  \n".join(x)) for k, x in enumerate(texts)], "doc_id long, text string").repartition(5)

    budget = suffixes.group_maps
    monkeypatch.setattr(suffixes, "group_maps", lambda tables, _: budget(tables, anchors))
    got = {r["doc_id"]: r["kept_sha256"] for r in suffixes.removed(docs, length, digests=False, limit=batch).collect()}
    for k, own in enumerate(texts):
        cover = {j for i in range(len(own)) if (k, i) in wanted for j in range(i, i + length)}
        assert got[k] == " ".join(w for j, w in enumerate(own) if j not in cover)
    assert Counter(len(x) > 0 for x in texts)[True] > 100
