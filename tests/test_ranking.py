"""Fusion, folds and quotas against plain restatements on random hits."""

import random

from siftmark.operators import ranking as R

HIT = "repo string, path string, line int, text string, kind string, score double, found_by array<string>"


def hits(spark, rows):
    return spark.createDataFrame(rows, HIT)


def random_hits(seed, n=400):
    rnd = random.Random(seed)
    return list({(r, p, i): (f"r{r}", f"p{p}", i, "t", "code", float(rnd.randint(1, 6)), ["x"]) for r, p, i in ((rnd.randint(0, 3), rnd.randint(0, 5), rnd.randint(1, 120)) for _ in range(n))}.values())


def rank(h):
    return (-h[5], h[0], h[1], h[2])


def test_fusion_adds_channels_and_features(spark):
    rows = [("r", "p", 1, "a", "code", 50.0, ["fts"]), ("r", "p", 1, "b", "definition", 60.0, ["graph", "fts"]), ("r", "src/vendor/x", 2, "c", "code", 10.0, ["fts"]), ("r", "p", None, "d", "code", None, None)]
    got = {(r.path, r.line): (r.kind, r.score, r.found_by) for r in R.fuse(hits(spark, rows)).collect()}
    assert got[("p", 1)] == ("definition", round(60 + 14 + 100 / 61 + 100 / 62, 3), ["fts", "graph"])
    assert got[("src/vendor/x", 2)] == ("code", round(10 - 25 + 100 / 61, 3), ["fts"])
    assert got[("p", None)][1] == 0


def test_anchor_moves(spark):
    rows = [("r", "p", n, "t", "code", 5.0, ["x"]) for n in (1, 9, 18)]
    assert [r.line for r in R.anchor_regions(hits(spark, rows), 10).orderBy("line").collect()] == [1, 18]
    rows = random_hits(5)
    want = set()
    for key in {(h[0], h[1]) for h in rows}:
        regions = []
        for h in sorted((h for h in rows if (h[0], h[1]) == key), key=lambda h: h[2]):
            if not regions or h[2] - regions[-1][2] > 10:
                regions.append(h)
            elif h[5] > regions[-1][5]:
                regions[-1] = h
        want |= {(h[0], h[1], h[2], h[5]) for h in regions}
    assert {(r.repo, r.path, r.line, r.score) for r in R.anchor_regions(hits(spark, rows), 10).collect()} == want


def test_quotas_are_those_of_a_walk(spark):
    for seed in (1, 2):
        rows = random_hits(seed)
        total, per_repo, per_file, want = 18, 7, 2, set()
        repos, files = {}, {}
        for h in sorted(rows, key=rank)[:200]:
            f, r = (h[0], h[1]), h[0]
            if len(want) < total and repos.get(r, 0) < per_repo and files.get(f, 0) < per_file:
                want.add(h[:3])
                repos[r] = repos.get(r, 0) + 1
                files[f] = files.get(f, 0) + 1
        got = R.diversity(hits(spark, rows), per_file, per_repo, total, 200)
        assert {(r.repo, r.path, r.line) for r in got.where("selected").collect()} == want and got.count() == 200


def test_intervals_merge_and_stitch(spark):
    rows = [("r", "p", 1, 3, "code", 5.0, ["a"]), ("r", "p", 2, 2, "test", 9.0, ["b"]), ("r", "p", 4, 6, "code", 1.0, ["a"]), ("r", "p", 9, 9, "code", 1.0, ["a"])]
    e = spark.createDataFrame(rows, "repo string, path string, line_start int, line_end int, kind string, score double, found_by array<string>")
    merged = R.merge_intervals(e)
    assert {(r.line_start, r.line_end, r.score, tuple(r.found_by), r.kind) for r in merged.collect()} == {(1, 6, 9.0, ("a", "b"), "code, test"), (9, 9, 1.0, ("a",), "code")}
    twice = R.merge_intervals(e.unionByName(e).unionByName(e))
    assert {(r.line_start, r.line_end, r.score) for r in twice.collect()} == {(1, 6, 9.0), (9, 9, 1.0)} and twice.count() == 2
    lines = spark.createDataFrame([("r", "p", n, f"l{n}") for n in (1, 2, 4, 5, 6)], "repo string, path string, line int, text string")
    assert {r.line_start: r.content for r in R.stitch(merged, lines).collect()} == {1: "l1\nl2\n\nl4\nl5\nl6", 9: ""}


def test_budget_skips_and_goes_on(spark):
    rows = [("r", "p", n, "t", "code", float(10 - n), ["x"]) for n in range(1, 6)]
    sized = hits(spark, rows).selectExpr("*", "CASE line WHEN 1 THEN 500 WHEN 2 THEN 10 ELSE 40 END AS size")
    assert [r.line for r in R.within_budget(sized, "size", 550).where("taken").orderBy("line").collect()] == [1, 2, 3]
    assert [r.line for r in R.within_budget(sized, "size", 90).where("taken").collect()] == [1]


def test_rerank_spares_protected_and_bounds_the_pool(spark):
    rows = [("r", "p", 1, "risk", "definition", 100.0, ["x"]), ("r", "p", 2, "risk check", "code", 50.0, ["x"]), ("r", "p", 3, "other", "code", 50.0, ["x"])]
    got = {r.line: r.score for r in R.rerank(hits(spark, rows), "risk check", 1).collect()}
    assert got == {1: 100.0, 2: 70.0, 3: 50.0}
    assert R.rerank(hits(spark, []), "x").count() == 0


def test_numbers_and_windows(spark):
    rows = random_hits(9, 100)
    got = R.numbered(hits(spark, rows), 5).collect()
    assert [r.candidate for r in sorted(got, key=lambda r: int(r.candidate[1:]))] == ["C1", "C2", "C3", "C4", "C5"]
    sizes = spark.createDataFrame([("r", "p", 1000), ("r", "q", 20)], "repo string, path string, lines int")
    h = hits(spark, [("r", "p", 3, "", "code", 1.0, ["x"]), ("r", "p", 990, "", "code", 1.0, ["x"]), ("r", "q", 5, "", "code", 1.0, ["x"])])
    assert sorted((r.line, r.line_start, r.line_end) for r in R.source_window(h, sizes, 150, 350).collect()) == [(3, 1, 78), (5, 1, 20), (990, 915, 1000)]
