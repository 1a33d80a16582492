"""Levelled sorted runs against plain counting, batch by batch."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from citadine.llm import runs


def lines_of(spark, rng, docs, keys):
    own = sorted({(rng.randrange(docs), min(int(rng.expovariate(6 / keys)), keys - 1)) for _ in range(6 * docs)})
    return own, spark.createDataFrame([(d, k, -k) for d, k in own], "doc_id long, h1 long, h2 long")


def wanted(own, enough):
    holders = defaultdict(list)
    for d, k in own:
        holders[k].append(d)
    return {k: max(ds) for k, ds in holders.items() if len(ds) >= enough}


def test_ten_batches_with_a_fanout_of_two(spark):
    own, lines = lines_of(spark, random.Random(4), 400, 300)
    got = {r["h1"]: r["top"] for r in runs.repeated_lines(lines.repartition(3), 5, batches=10, fanout=2).collect()}
    assert got == wanted(own, 5) and len(got) > 50


def test_a_bucket_of_all_batches_is_one_file(spark, monkeypatch):
    own, lines = lines_of(spark, random.Random(5), 400, 300)
    files, run_of = {}, runs.run_of

    def counting(rows, name, *rest):
        out = run_of(rows, name, *rest)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(runs, "run_of", counting)
    got = {r["h1"]: r["top"] for r in runs.repeated_lines(lines, 5, batches=10).collect()}
    assert got == wanted(own, 5)
    assert files["batches"] == [8] and len(files["run0"]) == 10


def test_the_join_with_the_runs_decides(spark):
    """Each key has one top, written by the batch that brought it; settled keys get no further rows."""
    store, brought, seen = runs.Runs(fanout=3, enough=5, buckets=8), {}, defaultdict(int)
    for k in range(7):
        batch = [(h, 2, 100 - 10 * k - h % 3) for h in range(40) if (h + k) % (1 + h % 4) == 0]
        rows = spark.createDataFrame([(h, -h, n, top) for h, n, top in batch], "h1 long, h2 long, n long, top long")
        before = {r["h1"]: r["n"] for r in runs.merged(store.runs()).collect()} if store.runs() else {}
        store.add(runs.run_of(rows.repartition(8, "h1", "h2"), "batch", 8))
        after = {r["h1"]: r["n"] for r in runs.merged(store.runs()).collect()}
        for h, n, top in batch:
            brought.setdefault(h, top)
            assert after[h] == before.get(h, 0) + (n if before.get(h, 0) < 5 else 0)
            seen[h] += n
    tops = store.runs()[0].where("top is not null")
    for x in store.runs()[1:]:
        tops = tops.unionByName(x.where("top is not null"))
    assert sorted((r["h1"], r["top"]) for r in tops.collect()) == sorted(brought.items())
    assert {r["h1"]: r["top"] for r in store.settled().collect()} == {h: brought[h] for h, n in seen.items() if n >= 5}
    assert [len(level) for level in store.levels] == [1, 2]


def test_joins_with_runs_need_no_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"), F.col("id").alias("top"))
    a, b = (runs.run_of(x.repartition(8, "h1", "h2"), "plan", 8) for x in (rows, rows.where("h1 < 500")))
    plan = b.join(a.select("h1", "h2", F.col("n").alias("m")).hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_clashing_columns_nulls_and_repeats(spark):
    line = "a line that many pages have and that is long enough"
    rows = [(k if k != 3 else None, f"own {k}\n {line.upper() if k % 2 else line}\n{line}", k, f"x{k}") for k in [*range(8), 7]] + [(20, None, 0, "y"), (21, "", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__gone` long, `row` string").withColumns({c: F.lit(c) for c in ("id", "gone", "h1", "top", "n", "__kept", "a.b")})
    got = runs.without_repeated_lines(docs)
    assert got.columns == docs.columns
    texts = sorted(((r["__gone"], r["text"], r["row"]) for r in got.collect()), key=str)
    want = [(k, x if i == 7 else f"own {k}", y) for i, x, k, y in rows[:9]] + [(0, "", "y"), (0, "", "z")]
    assert texts == sorted(want, key=str)
