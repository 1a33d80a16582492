"""Each operator against a brute-force version, on documents with nulls, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import comparing
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citadine.llm import bpe, components, exact, licenses, located, mixing, near, pii, quality, queries, runs, sharding, suffixes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `d` string, `t` string, kind string, n string, `row` string, `a.b` string"


def make_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    passage, line, base = prose(50), "  This Line is on many pages and Long enough to count ", prose(120)
    out = [None, "", "  \n\t ", "one", "two Words", "a b c d", "É é É é", "x" * 30000]
    out += [prose(rng.randint(5, 400)) for _ in range(20)]
    out += [base] * 4 + [base.upper()]
    for k in range(12):
        own = base.split()
        for _ in range(k // 2 + 1):
            own[rng.randrange(len(own))] = f"neu{rng.randrange(10**6)}"
        out.append(" ".join(own))
    out += [prose(30) + " " + passage + " " + prose(20) for _ in range(5)]
    out += ["\n".join([prose(20), line, prose(15), line]) for _ in range(8)]
    out += [f"{passage} {passage}", "same same same same same same same " * 9, "\n".join(["a line with words"] * 4), "### $$$ &&& " * 30 + prose(60)]
    out += [prose(6000)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, x in enumerate(make_texts()):
        out.append((k, x, "xx", [None, "s1", "s2", "s0"][min(3, k % 7)], len(x or ""), "a", "b", "c", "d", "e", "f"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_word_hashes_and_runs():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["Hello wörld", None, "", " x\ty ", "a long word indeedindeedindeed", "z"])
    raw, offsets = words.text_bytes(texts)
    starts, ends, firsts = words.word_spans(raw, offsets)
    assert [bytes(raw[i:j]).decode() for i, j in zip(starts, ends)] == [w for x in texts.to_pylist() for w in WORD.findall(x or "")]
    hashes = np.random.default_rng(1).integers(0, 2**62, 60).astype(np.uint64)
    for k in range(1, 40):
        out = np.zeros(61 - k, np.uint64)
        for i in range(k):
            out = out * words.BASE + hashes[i : 61 - k + i]
        assert (words.mixed(out) == words.grams(hashes, k)).all()


def test_pii_samples():
    cases = {
        "write bob.42 [at] mail3 [dot] example [dot] com now": [("email", "bob.42 [at] mail3 [dot] example [dot] com")],
        "bob at mail dot example dot com!": [("email", "bob at mail dot example dot com")],
        "раypal.bob@mаil.example.com x": [("email", "раypal.bob@mаil.example.com")],
        "４１１１１１１１１１１１１１１１ y": [("card", "４１１１１１１１１１１１１１１１")],
        "call plus one two six nine five five five three two nine six ok": [("phone", "plus one two six nine five five five three two nine six")],
        "192 dot 168 dot 1 dot 10": [("ip", "192 dot 168 dot 1 dot 10")],
        "192[.]168[.]1[.]10": [("ip", "192[.]168[.]1[.]10")],
        "look at the dot on it": [],
        "one two three four go": [],
        "un deux de la un de": [],
        "1.2.3.4 and 300.1.1.1": [("ip", "1.2.3.4")],
        "a@b.co +1 (988) 555-2485": [("email", "a@b.co"), ("phone", "+1 (988) 555-2485")],
        "4111 1111 1111 1111 4111 1111 1111 1112": [],
    }
    for text, want in cases.items():
        base = pii.matches(text)
        assert [(k, text[i:j]) for k, i, j in pii.ordered(base + pii.added(text, base))] == want, text


def spans_of(text):
    base = pii.matches(text)
    return [(k, text[i:j]) for k, i, j in pii.ordered(base + pii.added(text, base))]


@pytest.mark.parametrize("top", "ru jp in au ai me biz cn dk com museum".split())
def test_pii_written_dot_with_any_top_level_label(top):
    for own in (f"jane at firm dot {top}", f"jane (at) firm dot {top}", f"jane at mail dot firm dot {top}", f"jane [at] firm dot co dot {top}"):
        assert spans_of(f"mail {own}, thanks") == [("email", own)]


def test_pii_written_dots_of_sentences():
    for text in ("look at the dot on it", "stand at this point we go", "look at that dot in red", "at boiling point of water", "it stops at one period in May"):
        assert spans_of(text) == [], text
    assert spans_of("bob at firm dot com period thanks") == [("email", "bob at firm dot com")]


def test_pii_spelled_ips():
    for own in ("one nine two dot one six eight dot one dot one", "one zero dot two five five dot zero dot one two", "192 dot one six eight dot 1 dot ten".replace("ten", "one zero"), "one nine two [dot] one six eight [dot] one [dot] one"):
        assert spans_of(f"host {own}, up") == [("ip", own)]
    phone = "plus four nine dot one seven six dot one two three dot two five five"
    assert spans_of(f"call {phone} now") == [("phone", phone)]
    assert spans_of("three nine two dot one six eight dot one dot one") == []
    assert spans_of("one dot two dot three dot four") == [("ip", "one dot two dot three dot four")]


def test_pii_rows(docs, rows):
    got = by_id(pii.op1(docs))
    for k, x, *_ in rows:
        base = pii.matches(x or "")
        assert got[k]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and got[k]["spans"] == pii.joined(base)
    masked = pii.masked(docs.select("doc_id", F.lit("to a.b@c.de ok").alias("text"))).first()
    assert masked["text"] == "to <email> ok"


def brute_lines(rows):
    keys = defaultdict(list)
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(LOW)
    for k, x in rows:
        for y in {key(line) for line in (x or "").split("\n")}:
            if len(y) >= 40:
                keys[y].append(k)
    out = {}
    for k, x in rows:
        lines = (x or "").split("\n")
        kept = [y for y in lines if not (len(keys.get(key(y), ())) >= 5 and max(keys[key(y)]) != k)]
        out[k] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def test_line_dedup(docs, rows):
    want = brute_lines([(r[0], r[1]) for r in rows])
    got = by_id(runs.op2(docs))
    assert {k: (v["n_lines"], v["n_dropped"], v["kept_sha256"]) for k, v in got.items()} == {k: (a, b, hashlib.sha256(c.encode()).hexdigest()) for k, (a, b, c) in want.items()}
    assert sum(v["n_dropped"] for v in got.values()) > 5


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for k, x, *_ in rows:
        groups[(x or "").translate(LOW)].append(k)
    got = by_id(exact.op3(docs))
    for text, ks in groups.items():
        for k in ks:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (max(ks), len(ks), k == max(ks), hashlib.sha256(text.encode()).hexdigest())


def test_license_scan(spark, docs):
    texts = ["x y Licensed under the Apache License, Version 2.0. z", "Éé released UNDER the mit license", "licensed under nothing", None, "", "Licensed under CC BY-NC 4.0."]
    got = licenses.op4(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["template"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in got} == {
        (0, "Apache-2.0 notice", "Licensed under the Apache License, Version 2.0"),
        (1, "MIT notice", "released UNDER the mit license"),
        (5, "CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0"),
    }
    assert licenses.op4(docs).count() == 0


def test_whole_licenses_and_their_passages(spark):
    whole = licenses.registered()
    mit, bsd, apache = whole["MIT text"].strip(), whole["BSD-3-Clause text"].strip(), whole["Apache-2.0 text"].strip()
    conditions = bsd[bsd.index("1. Redistributions") :]
    texts = [f"Copyright (c) 2020 Ann Other\n\n{mit}\n\nand code", f"Some code. {conditions}", "Notes. " + mit[mit.index("THE SOFTWARE IS PROVIDED") :], apache, apache[2 * len(apache) // 5 :], whole["GPL-3.0 text"][9000:21000], conditions[: conditions.index("THIS SOFTWARE")]]
    rows = [r.asDict() for r in licenses.op4(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    of = lambda k: [r for r in rows if r["doc_id"] == k]
    found = lambda r: texts[r["doc_id"]][r["start"] : r["end"]]
    assert [(r["template"], r["coverage"], found(r)) for r in of(0)] == [("MIT text", 1.0, mit.rstrip("."))]
    assert {r["template"][:14] for r in of(1)} <= {"BSD-2-Clause t", "BSD-3-Clause t"} and sum(len(found(r)) for r in of(1)) > 0.9 * len(conditions)
    assert [r["template"] for r in of(2)] == [name for name, x in whole.items() if name.startswith("MIT text, part") and "AS IS" in x]
    assert [(r["template"], r["coverage"]) for r in of(3)] == [("Apache-2.0 text", 1.0)]
    assert len(of(4)) > 3 and sum(len(found(r)) for r in of(4)) > 0.8 * len(texts[4])
    assert all(sum(len(found(r)) for r in of(k)) > 0.8 * len(texts[k]) for k in (5, 6))


def test_long_alignment_equals_the_short_one():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        shift, band = int(rng.integers(-8, 20)), int(rng.integers(1, 12))
        short = licenses.aligned(a.tolist(), b.tolist(), shift, band)
        assert licenses.aligned_long(a, b, shift, band)[: 3 if short[0] > 0 else 1] == short[: 3 if short[0] > 0 else 1]


def most_in_order(template, text):
    """Words of the template that any stretch of the text has in the same order, by the whole table; a stretch is at most one and a half times as long."""
    best = 0
    for at in range(len(text)):
        row = [0] * (len(template) + 1)
        for w in text[at : at + len(template) * 3 // 2]:
            new = [0]
            for j, x in enumerate(template):
                new.append(max(row[j] + (w == x), row[j + 1], new[j]))
            row = new
        best = max(best, row[-1])
    return best


def test_alignment_against_the_whole_table(spark):
    """Templates planted with words changed, left out and put in: each report has as many words as the whole table finds, and no template that reaches the threshold is missed."""
    rng = random.Random(15)
    vocabulary = [f"w{k}" for k in range(400)]
    templates = {f"T{k}": " ".join(rng.choice(vocabulary) for _ in range(n)) for k, n in enumerate((8, 14, 25, 45, 60))}
    texts, planted = [], []
    for k in range(40):
        name = rng.choice(sorted(templates))
        own = []
        for w in templates[name].split():
            x = rng.random()
            own += [] if x < 0.04 * (k % 4) / 2 else [rng.choice(vocabulary)] if x < 0.08 * (k % 4) / 2 else [w, rng.choice(vocabulary)] if x < 0.1 * (k % 4) / 2 else [w]
        noise = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(noise() + own + noise()))
        planted.append(name)
    got = defaultdict(dict)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect():
        got[r["doc_id"]][r["template"]] = r["n_matched"]
    hits = 0
    for k, name in enumerate(planted):
        words_of = templates[name].split()
        best = most_in_order(words_of, texts[k].split())
        if best >= 0.8 * len(words_of):
            assert got[k].get(name) == best, (k, name, best, got[k])
            hits += 1
        assert all(n <= most_in_order(templates[t].split(), texts[k].split()) for t, n in got[k].items())
    assert hits > 25


def test_many_notices_in_one_text(spark):
    import time

    notice = "Released under the MIT License."
    text = "\n".join([notice, "some words between"] * 4000)
    began = time.time()
    assert licenses.op4(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 4000
    assert time.time() - began < 60


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(3)
    for _ in range(60):
        votes = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        caps = [rng.randint(0, 20) for _ in votes]
        seats, want = rng.randint(0, 40), [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if want[i] < caps[i] and votes[i]]
            if open_:
                want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps).tolist() == want


def test_mixing(docs, rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for k, n in size.items():
        total[source[k]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rate = (1.5 * sum(total.values()) - sum(capped.values())) / sum(weight[s] for s in free)
        new = {s: 2 * total[s] for s in free if rate * weight[s] > 2 * total[s]}
        if not new:
            break
        capped |= new
    want = {s: capped.get(s, rate * weight[s]) for s in names}
    got, taken = by_id(mixing.op5(docs)), Counter()
    again = by_id(mixing.op5(docs.repartition(5)))
    for k, r in got.items():
        assert r["size"] == size[k] and r["source_size"] == total[source[k]] and r["target"] == pytest.approx(want[source[k]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r == again[k]
        taken[source[k]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in names)
    mixed = Counter()
    for r in mixing.mixed(docs).collect():
        mixed[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert mixed == taken


def test_mixing_keeps_documents_whole(spark):
    """Of each source at most one document is cut, at its end; the others keep their line breaks and all their words."""
    rng = random.Random(21)
    text = lambda: "".join(f"w{rng.randrange(10**6)}" + rng.choice([" ", "\n", "  \t"]) for _ in range(rng.randint(1, 300)))
    rows = [(k, "  " + text(), "s1" if k == 7 else "s0" if k % 5 < 3 else "s2") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole, cuts, words_of = {r[0]: r[1] for r in rows}, Counter(), Counter()
    for r in mixing.mixed(docs).collect():
        words_of[r["doc_id"]] += len(WORD.findall(r["text"]))
        if r["text"] != whole[r["doc_id"]]:
            cuts[r["source"]] += 1
            assert whole[r["doc_id"]].startswith(r["text"]) and WORD.findall(r["text"]) == WORD.findall(whole[r["doc_id"]])[: len(WORD.findall(r["text"]))]
    assert max(cuts.values(), default=0) <= 1
    got = by_id(mixing.op5(docs))
    assert words_of == Counter({k: r["taken"] for k, r in got.items() if r["taken"]})
    assert any(r["target"] < r["source_size"] for r in got.values())


def test_mixing_of_rows_without_ids(spark):
    """Rows without ids are dealt and joined by their texts."""
    rng = random.Random(22)
    rows = [(None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))), f"s{k % 3}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    got = mixing.op5(docs).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert sorted(taken.values()) == sorted(r["n"] for r in got) and all(abs(r["n"] - r["target"]) <= 1 for r in got)


def brute_shingles(rows):
    sets = {}
    for k, x in rows:
        w = WORD.findall((x or "").translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_ngram_jaccard(docs, rows):
    want = brute_shingles([(r[0], r[1]) for r in rows])
    got = by_id(near.op6(docs))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == want
    kept = {r["doc_id"] for r in near.representatives(docs).collect()}
    assert kept == {k for k, (_, c) in want.items() if c == k}


def test_ngram_jaccard_of_a_large_group(spark):
    """Copies with up to 14 words changed of 100, so that many pairs are near the threshold."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randrange(15)):
            own[rng.randrange(100)] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(own[: 100 - k % 9]))
    rows = list(enumerate(texts))
    got = by_id(near.op6(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == brute_shingles(rows)


def test_ngram_jaccard_of_long_texts(spark):
    """Sets of over a thousand shingles on both sides of the threshold, with sizes that differ."""
    rng = random.Random(11)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(3000)], []
    for share in (0.0, 0.01, 0.02, 0.022, 0.024, 0.03):
        own = list(base)
        for i in rng.sample(range(3000), int(3000 * share)):
            own[i] = f"x{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(own[: 3000 - 200 * (len(rows) % 3)])))
    rows += [(100 + k, " ".join(f"y{k}z{i}" for i in range(1500))) for k in range(3)] + [(200, " ".join(base[400:] + [f"q{i}" for i in range(500)]))]
    want = brute_shingles(rows)
    got = by_id(near.op6(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == want
    assert 1 < len({c for k, (_, c) in want.items() if k < 100}) < 6


def test_ngram_jaccard_of_groups_with_equal_prefixes(spark, monkeypatch):
    """Hundreds of sets of equal size and prefix: some linked with the group's hub, some only with each other, some with none."""
    import numpy as np

    monkeypatch.setattr(near, "frequency_classes", lambda sketch: np.zeros(len(sketch), np.uint8))  # shingles in order of their hashes
    rng, kinds = random.Random(12), [[f"k{k}w{i}" for i in range(90)] for k in range(4)]
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(300):
        own = shared + list(kinds[k % 4])
        own[60 + rng.randrange(90)] = f"n{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    got = by_id(near.op6(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == brute_shingles(rows)


def test_representatives_of_repeated_and_empty_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (5, None, "e"), (5, None, "f"), (6, " ", "g"), (7, "other words in here now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__d` string").withColumns({c: F.lit(c) for c in ("d", "t", "place", "x", "row")})
    got = near.representatives(docs)
    assert got.columns == docs.columns
    kept = sorted(r["__d"] for r in got.collect())
    assert kept[1:] == ["e", "f", "g", "h"] and kept[0] in ("a", "b")  # a null doc_id is not the smallest


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_sharding(docs, rows):
    got = by_id(sharding.op7(docs))
    text = {r[0]: r[1] for r in rows}
    slots, size, of_text = defaultdict(list), Counter(), defaultdict(set)
    for k, r in got.items():
        raw = (text[k] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        of_text[text[k]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in of_text.values())


def test_shards_have_nearly_equal_sizes(spark):
    """The law: no shard is farther from an eighth of all bytes than a few units; with a group of a third of all rows, and with a third of the ids null."""
    rng = random.Random(13)
    text = lambda: "x" * rng.randint(1, 400)
    for null in (False, True):
        rows = [(None if null and k % 3 == 0 else k, "hot text " * 20 if k % 3 == 0 else f"{k} {text()}") for k in range(6000)]
        got = sharding.op7(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        size, slots = Counter(), defaultdict(list)
        for r in got:
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        mean = sum(size.values()) / 8
        assert len(size) == 8 and max(abs(v - mean) for v in size.values()) < 0.02 * mean
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_packing_keeps_all_dimensions_near_their_capacity():
    import numpy as np

    rng = np.random.default_rng(14)
    for _ in range(20):
        units = np.stack([rng.lognormal(0, 1, 800), rng.lognormal(0, 1, 800), np.ones(800)], 1)
        shard = sharding.place(units, 8)
        loads = np.stack([np.bincount(shard, units[:, d], 8) for d in range(3)], 1) / units.sum(0) * 8
        assert np.abs(loads[:, 0] - 1).max() < 0.05 and loads.max() < 1.6


def test_quality(docs, rows):
    got = by_id(quality.op8(docs))
    for k, x, *_ in rows:
        w = WORD.findall(x or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [y for y in (x or "").split("\n") if WORD.search(y)]
        want = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), len(lines) - len(set(lines)), len(cover)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def all_must_pass(judged):
    """The filter that the posterior replaces: no bad vote of any rule."""
    return judged.withColumn("passed", ~F.col("base_failed") & ~F.exists("votes", lambda v: v < 0))


def test_quality_agrees_with_labels_better_than_all_must_pass(spark):
    sf = "/root/testdata/sf0.1"
    got = by_id(all_must_pass(quality.quality(queries.documents(spark, sf))))
    labels = [(got[r["doc_id"]], bool(r["quality"])) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r["doc_id"]]["base_failed"]]
    agree = {c: sum(d[c] == want for d, want in labels) / len(labels) for c in ("kept", "passed")}
    assert agree["kept"] > 0.99 > agree["passed"] + 0.02
    stays = [d for d in got.values() if d["kept"] and not d["passed"]]
    assert len(stays) > 200 and all(d["quality"] >= 0.5 and -1 in d["votes"] for d in stays)  # one rule erred, the others outvote it
    assert any(d["passed"] and not d["kept"] for d in got.values())


def drawn_votes(n, share, on_good, on_bad):
    """Votes of rules with known shares of bad, abstaining and good votes."""
    import numpy as np

    rng = np.random.default_rng(8)
    good = rng.random(n) < share
    votes = np.stack([np.where(good, rng.choice([-1, 0, 1], n, p=g), rng.choice([-1, 0, 1], n, p=b)) for g, b in zip(on_good, on_bad)], 1)
    return good, [tuple(v) for v in votes.tolist()]


ON_GOOD = [(0.05, 0.15, 0.8), (0.2, 0.2, 0.6), (0.02, 0.5, 0.48), (0.1, 0.1, 0.8), (0.3, 0.3, 0.4)]
ON_BAD = [(0.7, 0.2, 0.1), (0.5, 0.2, 0.3), (0.4, 0.5, 0.1), (0.8, 0.1, 0.1), (0.35, 0.3, 0.35)]


def test_posteriors_recover_known_accuracies():
    import numpy as np

    good, votes = drawn_votes(60000, 0.7, ON_GOOD, ON_BAD)
    seen = Counter(votes)
    found, shares, prior = quality.fitted(list(seen), list(seen.values()))
    assert abs(prior - 0.7) < 0.02 and np.abs(shares - np.array([ON_GOOD, ON_BAD])).max() < 0.03
    of = dict(zip(seen, found))
    bayes = lambda v: 0.7 * np.prod([p[x + 1] for p, x in zip(ON_GOOD, v)]) / (0.7 * np.prod([p[x + 1] for p, x in zip(ON_GOOD, v)]) + 0.3 * np.prod([p[x + 1] for p, x in zip(ON_BAD, v)]))
    assert sum(abs(of[v] - bayes(v)) * n for v, n in seen.items()) / len(votes) < 0.02
    right = sum((of[v] >= 0.5) == g for v, g in zip(votes, good.tolist())) / len(votes)
    assert right > sum((-1 not in v) == g for v, g in zip(votes, good.tolist())) / len(votes) + 0.1


def test_em_over_patterns_equals_em_over_documents():
    _, votes = drawn_votes(300, 0.6, ON_GOOD, ON_BAD)
    belief = [(sum(x > 0 for x in v) + 1) / (sum(x != 0 for x in v) + 2) for v in votes]
    for _ in range(2000):
        shares = []
        for w in (belief, [1 - b for b in belief]):
            shares.append([[(sum(b for b, v in zip(w, votes) if v[r] == x) + 0.5) / (sum(w) + 1.5) for x in (-1, 0, 1)] for r in range(5)])
        prior = sum(belief) / len(votes)
        odds = [prior * math.prod(shares[0][r][v[r] + 1] for r in range(5)) / ((1 - prior) * math.prod(shares[1][r][v[r] + 1] for r in range(5))) for v in votes]
        new = [o / (1 + o) for o in odds]
        moved, belief = max(abs(a - b) for a, b in zip(new, belief)), new
        if moved < 1e-10:
            break
    seen = Counter(votes)
    of = dict(zip(seen, quality.posteriors(list(seen), list(seen.values()))))
    assert max(abs(of[v] - b) for v, b in zip(votes, belief)) < 1e-6


ODD = ["", "a" * 5000, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "aaaa aaa", "it's IT'S don't", "\x1c\x85 é́ Σς İ ǅ ½Ⅷ 中文 🙂", "0129 1,5"]


def test_bpe_equals_the_library(spark, docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [r[1] for r in rows] + ODD
    got = by_id(bpe.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    whole = by_id(bpe.bpe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    for k, x in enumerate(texts):
        ids = library.encode(x or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert bytes(whole[k]["ids"]) == packed and whole[k]["decoded"] == decoded


def test_bpe_refuses_files_with_other_options(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer()))
    assert bpe.unknown_options(spec) == []
    steps = spec["pre_tokenizer"]["pretokenizers"]
    changes = [
        (spec["normalizer"]["normalizers"][1], "content", "_"),
        (steps[0], "behavior", "Isolated"),
        (steps[0], "invert", False),
        (steps[0], "pattern", {"Regex": "\\S+\\s*"}),
        (steps[1], "add_prefix_space", True),
        (steps[1], "use_regex", True),
        (spec["model"], "ignore_merges", True),
        (spec["model"], "byte_fallback", True),
        (spec["added_tokens"][0], "lstrip", True),
        (spec, "decoder", {"type": "ByteLevel"}),
    ]
    for own, key, value in changes:
        kept, own[key] = own[key], value
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            bpe.Tokenizer.read(str(path))
        own[key] = kept


def test_substring_dedup(docs, rows):
    split = {r[0]: WORD.findall(r[1] or "") for r in rows}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    got = by_id(suffixes.op10(docs))
    for k, w in split.items():
        cover = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in cover)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest())


def test_settled_keys_leave_one_witness():
    import numpy as np

    dealer = located.Dealer(2, lambda hi: (hi % np.uint64(2)).astype(np.int64))
    hi = np.array([4, 4, 5, 7, 5, 4], np.uint64)
    list(dealer.add(hi, np.zeros(6, np.uint32), np.arange(6), np.zeros(6, np.int32), np.arange(6)))
    rows = dealer.flush().to_pylist()
    assert sum(len(r["keys"]) // 12 for r in rows if not r["settled"]) == 3 and sum(len(r["docs"]) // 8 for r in rows if r["settled"]) == 5


OPS = {"op1": pii.op1, "op2": runs.op2, "op3": exact.op3, "op4": licenses.op4, "op5": mixing.op5, "op6": near.op6, "op7": sharding.op7, "op8": quality.op8, "op9": lambda d: bpe.op9(d, queries.tokenizer()), "op10": suffixes.op10}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(empty, name):
    assert OPS[name](empty).collect() == []


def test_license_scan_of_null_and_repeated_ids(spark):
    notice = "Released under the MIT License."
    rows = [(None, notice), (None, None), (3, f"x {notice}"), (3, f"x {notice}"), (3, "other"), (-5, "")]
    got = licenses.op4(spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["start"], r["coverage"]) for r in got) == {(None, 0, 1.0): 1, (3, 2, 1.0): 2}


@pytest.mark.parametrize("name", [n for n in OPS if n != "op4"])
def test_null_and_repeated_ids(spark, name):
    rows = [(None, "some words in a text without an id"), (None, None), (3, "b c"), (3, "b c"), (3, "other words"), (-5, "")]
    got = OPS[name](spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    assert comparing.difference(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name]) == ""


def test_pipeline(spark):
    """All rows of the pipeline, by the stages' own brute-force versions one after the other: what quality keeps, without repeated lines, one of each component, mixed, and encoded by the library."""
    tokenizers = pytest.importorskip("tokenizers")
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    kept = {r["doc_id"] for r in quality.op8(docs).where("kept").collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    first = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    second = {k: v[2] for k, v in brute_lines(first.items()).items()}
    third = {k: second[k] for k, (_, c) in brute_shingles(second.items()).items() if c == k}
    assert 0.5 * len(first) < len(third) < len(first) and any(second[k] != first[k] for k in first)
    taken = {r["doc_id"]: r["taken"] for r in mixing.op5(spark.createDataFrame([(k, x, sources[k]) for k, x in third.items()], "doc_id long, text string, source string")).collect()}
    library = tokenizers.Tokenizer.from_file(queries.tokenizer())
    library.no_truncation()
    library.no_padding()
    end = re.compile(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")
    want = Counter()
    for k, text in third.items():
        n, left = len(WORD.findall(text)), taken[k]
        while left > 0:
            used = min(n, left)
            own = text if used == n else "".join(end.findall(text)[:used])
            ids = library.encode(own, add_special_tokens=False).ids
            want[k, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)] += 1
            left -= used
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and sum(got.values()) > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "mixing sources", "bpe"]


EXTRA = ["d", "t", "row", "x", "place", "votes", "gone", "id", "h1", "top", "__row", "__doc", "__h", "full", "part", "size", "a.b", "n_words"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_stages_on_empty_tables_nulls_and_clashing_columns(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"Word{k} and thing{k % 7}." if k % 9 == 0 else f"word{k} of plain" for k in range(60))
    rows = [(None, prose, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, prose, "en", "b", 9), (3, prose, "en", "b", 9), (4, prose + "\n" + prose[::-1], None, "a", 1)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema).withColumns({c: F.lit("z") for c in EXTRA})
        out = stage(spark, docs, "/none")
        assert out.columns == docs.columns
        found = out.collect()
        assert all(r["a.b"] == "z" and r["votes"] == "z" for r in found) and (found or not own or stage.__name__ == "quality_rules")
