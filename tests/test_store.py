"""The generation store, history, measures, plans, semantic parts and streams."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftmark.operators import corpus as C
from siftmark.operators import history as H
from siftmark.operators import measure as M
from siftmark.operators import semantic as S
from siftmark.plans import request as P
from siftmark.streaming import refresh as ST

FILES = "snapshot int, delivered_at timestamp, repo string, path string, blob string"


def test_generations(spark, tmp_path):
    store = C.GenerationStore(spark, str(tmp_path / "store"))
    assert store.current() == 0
    blobs = spark.createDataFrame([("A", "x"), ("a", "x"), ("b", None)], "blob string, content string")
    files = spark.createDataFrame([("r", "p", "a")], "repo string, path string, blob string")
    assert store.publish(files, blobs) == 1 and store.current() == 1
    assert store.publish(files, spark.createDataFrame([("a", "x"), ("c", "z")], "blob string, content string")) == 2
    assert sorted(r.blob for r in store.blobs().collect()) == ["a", "c"] and store.files(1).count() == 1
    # a writer that died before its manifest leaves nothing in use
    store._write("blobs", store.blobs())
    assert store.current() == 2 and C.GenerationStore(spark, store.root).blobs().count() == 2
    assert store.pack() == 3 and [r.blob for r in store.blobs().collect()] == ["a"]
    assert store.collect_garbage(1) > 0 and store.current() == 3 and store.files().count() == 1 and [r.blob for r in store.blobs().collect()] == ["a"]
    with pytest.raises(RuntimeError):
        store._announce(3, {})


def test_checkpoints_need_a_shared_folder_off_local_masters():
    from types import SimpleNamespace

    from siftmark.runtime import checkpoint_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        checkpoint_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: ""), sparkContext=context))


def test_newest_snapshot_is_read(spark):
    files = spark.createDataFrame([(n, None, "r", "a", f"b{n}") for n in (1, 4, 5)], FILES)
    assert [r.blob for r in C.snapshot_files(files).collect()] == ["b5"] and [r.blob for r in C.snapshot_files(files, 4).collect()] == ["b4"]
    assert C.snapshot_files(files.limit(0)).count() == 0


def test_names_of_new_repositories(spark):
    found = spark.createDataFrame([("./x/api",), ("y/api",), ("z/api",), ("w/web app",), ("k/known",)], "path string")
    known = spark.createDataFrame([("api", "p/api"), ("api-3", "q/api"), ("known", "k/known")], "name string, path string")
    got = {r.path: r.name for r in C.named(found, known).collect()}
    assert got == {"x/api": "api-4", "y/api": "api-5", "z/api": "api-6", "w/web app": "web-app"}


def test_sources_of_version_control(spark):
    tree = "100644 blob aaaaaaa\tsrc/A.java\x00120000 blob bbbbbbb\tlink\x00100755 blob ccccccc\tbin/run\x00160000 commit ddddddd\tsub\x00100644 blob eeeeeee\t.env\x00"
    manifest = H.git_manifest(spark.createDataFrame([("r", tree)], "repo string, text string"))
    assert {(r.path, r.blob) for r in manifest.collect()} == {("src/A.java", "aaaaaaa"), ("bin/run", "ccccccc"), (".env", "eeeeeee")}
    sizes = spark.createDataFrame([("aaaaaaa blob 10\nccccccc blob 4000000\neeeeeee blob 5\nfffffff missing\n",)], "text string")
    none = spark.createDataFrame([], "blob string")
    assert [(r.blob, r.size) for r in H.fetchable(manifest, sizes, none).collect()] == [("aaaaaaa", 10)]
    assert H.fetchable(manifest, sizes, spark.createDataFrame([("AAAAAAA",)], "blob string")).count() == 0
    refs = spark.createDataFrame([("a", "main", "1", None, True), ("a", "release", "2", None, False), ("b", "main", "3", "dev", True), ("b", "dev", "4", "dev", False), ("c", "x", "5", None, True), ("d", "y", "6", None, False)], "repo string, ref string, sha string, branch string, is_default boolean")
    assert {(r.repo, r.ref) for r in H.chosen_refs(refs, ["release", "main"]).collect()} == {("a", "release"), ("b", "dev"), ("c", "x")}
    paths = spark.createDataFrame([("a/.git/HEAD",), ("a/b/.git",), ("c/.git",), ("node_modules/d/.git",), ("e/f",)], "path string")
    assert sorted(r.path for r in H.repository_roots(paths).collect()) == ["a", "c"]


def test_cleaning(spark):
    rows = [("r", n, f"s{n}", n == 1) for n in (1, 2, 3)]
    got = C.keep_newest(spark.createDataFrame(rows, "repo string, mtime int, name string, pinned boolean"), ["repo"], [F.col("mtime").desc()], 1, "pinned")
    assert [r.name for r in got.where("removable").collect()] == ["s2"]
    cache = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", None)], "key string, used int")
    assert [r.key for r in C.trim_cache(cache, "key", "used", 2).collect()] == ["a", "b"]


def test_history(spark):
    log = "\x1e".join(["", "s1\x1f2025-01-02\x1fIPF-101 Extend transaction cache expiry token=abc\n\nM\tsrc/CachePolicy.java\nA\tsrc/test/CachePolicyTest.java\nR100\told.txt\tconf/app.properties\nnot a change\tx\n", "s2\x1f2025-01-03\x1fno ticket\n", "s3\x1fbroken IPF-9\n"])
    other = "\x1es9\x1f2025-02-01\x1fIPF-101 Worker side of the cache"
    commits = H.parse_log(spark.createDataFrame([("cache-api", log), ("cache-worker", other)], "repo string, text string"))
    first = commits.where("sha = 's1'").first()
    assert first.subject == "IPF-101 Extend transaction cache expiry token=[REDACTED]" and [tuple(c) for c in first.changes] == [("M", "src/CachePolicy.java"), ("A", "src/test/CachePolicyTest.java"), ("R100", "conf/app.properties")]
    again = H.with_new_commits(commits, commits.where("sha = 's1'").withColumn("subject", F.lit("new")), 1)
    assert {(r.repo, r.sha, r.subject) for r in again.collect()} == {("cache-api", "s1", "new"), ("cache-worker", "s9", "IPF-101 Worker side of the cache")}
    told = H.cases(commits, spark.createDataFrame([("IPF-101", "Slow vouchers", None)], "ticket string, ticket_text string, knowledge_text string")).first()
    assert {"slow", "vouchers", "policy"} <= set(told.terms) and told.ticket_excerpt == "Slow vouchers" and told.knowledge_excerpt == ""
    case = H.cases(commits).collect()
    assert len(case) == 1 and case[0].repos == ["cache-api", "cache-worker"] and case[0].latest_date == "2025-02-01"
    assert case[0].test_paths == ["cache-api:src/test/CachePolicyTest.java"] and case[0].config_paths == ["cache-api:conf/app.properties"]
    assert H.similar_cases(H.cases(commits), "Increase transaction cache duration").first().ticket == "IPF-101"
    assert H.similar_cases(H.cases(commits), "see IPF-101").first().score >= 1000
    assert H.similar_cases(H.cases(commits), "zebra").count() == 0
    text = spark.createDataFrame([("authorization = Bearer abc\npassword=x\nurl https://u:p@h/\nplain",)], "t string").select(H.redacted(F.col("t")).alias("t")).first().t
    assert "abc" not in text and "password=[REDACTED]" in text and "u:[REDACTED]@" in text and text.endswith("plain")
    patches = spark.createDataFrame([("T", 1, "aaaa"), ("T", 2, "bbbb"), ("T", 3, "cc")], "ticket string, n int, text string")
    assert [r.excerpt for r in H.patch_excerpts(patches, 6, ["n"]).orderBy("n").collect()] == ["aaaa", "bb"]
    diffs = spark.createDataFrame([("r", "1", "d", "x.y", ""), ("r", "2", "d", "x.y", "x.y")], "repo string, sha string, date string, added string, removed string")
    assert [r.sha for r in H.pickaxe(diffs, "x.y").collect()] == ["1"] and H.pickaxe(diffs, "x[.]y").count() == 0
    assert [r.sha for r in H.pickaxe(diffs.where("sha = '2'"), "x.y").collect()] == ["2"] and H.pickaxe(diffs, "\\E(").count() == 0
    secret = spark.createDataFrame([("T", 1, "src/a.py", "x"), ("T", 2, ".npmrc", "y"), ("T", 3, "my-secret.txt", "z")], "ticket string, n int, path string, text string")
    assert [r.excerpt for r in H.patch_excerpts(secret, 60, ["n"]).collect()] == ["x"]


def test_similar_rows_are_exact_whatever_is_left_out(spark):
    import random

    rnd = random.Random(6)
    common, rare = ["ledger", "harbor", "voucher"], [f"rare{c}{d}" for c in "abcdefgh" for d in "stuvw"]
    rows = [(i, " ".join([w for w in common if rnd.random() < 0.8] + rnd.sample(rare, rnd.randint(0, 3)))) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc int, text string")
    asked = docs.where("doc % 20 = 0").withColumnRenamed("doc", "asked")
    words = {i: set((t or "").split()) for i, t in rows}
    want = set()
    for q in range(0, 400, 20):
        scores = sorted(((sum(min(12, len(w)) for w in words[q] & words[d]), d) for d, t in rows if words[q] & words[d]), reverse=True)[:5]
        want |= {(q, d, s, n) for n, (s, d) in enumerate(scores, 1)}
    for first, direct in ((1, 0), (50, 0), (100_000, 0), (50, 10**9)):
        got = H.similar_by_terms(asked, H.term_index(docs, "doc", "text"), "asked", "doc", "text", first_postings=first, direct_pairs=direct)
        assert {tuple(r) for r in got.collect()} == want


def test_search_by_terms_keeps_less_than_the_texts(spark, tmp_path):
    import random
    from pathlib import Path

    from siftmark.queries import store
    from siftmark.runtime import checkpoint_folder

    rnd = random.Random(3)
    words = ["".join(rnd.choices("bcdfghjklmnp", k=5)) for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(words, k=60))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = lambda: sum(f.stat().st_size for f in Path(checkpoint_folder(spark).removeprefix("file:")).rglob("part-*"))
    before = kept()
    got = store.term_overlap_similarity(spark, str(tmp_path))
    assert kept() - before < sum(len(t) for _, t in rows)
    best = {r.asked: r.doc_id for r in got.where("rank = 1").collect()}
    assert best[100] == 100 and all(a == d for a, d in best.items())


def test_every_document_asks(spark, tmp_path):
    from siftmark.queries import store

    rows = [(1, "ledger harbor"), (2, "Harbor ledger voucher"), (100, "voucher"), (103, "the"), (104, None), (250, "unmatched")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = store.term_overlap_similarity(spark, str(tmp_path)).orderBy("asked", "rank")
    assert got.columns == ["asked", "doc_id", "score", "rank"]
    assert [tuple(r) for r in got.collect()] == [(1, 2, 12, 1), (1, 1, 12, 2), (2, 2, 19, 1), (2, 1, 12, 2), (2, 100, 7, 3), (100, 100, 7, 1), (100, 2, 7, 2), (250, 250, 9, 1)]


def test_shards_and_blocks_give_what_one_gives(spark, monkeypatch):
    import random

    from siftmark.operators import overlap

    rnd = random.Random(8)
    words = ["".join(rnd.choices("bcdfghjklmnp", k=rnd.randint(3, 15))) for _ in range(300)]
    # frequent and rare words, texts of any length, equal texts, and two rows of one key
    rows = [(i, " ".join(words[int(300 * rnd.random() ** 3)] for _ in range(rnd.choice((0, 2, 20, 90))))) for i in range(500)]
    rows += [(i + 500, t) for i, t in rows[:40]] + [(7, "only here"), (990, None)]
    held: dict[int, set] = {}
    for i, t in rows:
        if t is not None:
            held.setdefault(i, set()).update(t.split())
    want = set()
    for q in [q for q in held if q % 5 == 0 or q == 7]:
        scores = sorted(((sum(min(12, len(w)) for w in held[q] & held[d]), d) for d in held if held[q] & held[d]), reverse=True)[:5]
        want |= {(q, d, s, n) for n, (s, d) in enumerate(scores, 1)}
    docs = spark.createDataFrame(rows, "doc int, text string").repartition(7)
    asked = docs.where("doc % 5 = 0 or doc = 7").withColumnRenamed("doc", "asked")
    for shard, block in (((65_536, 10**7), 16_384), ((100, 10**7), 30), ((65_536, 4000), 10)):
        monkeypatch.setattr(overlap, "SHARD", shard)
        monkeypatch.setattr(overlap, "BLOCK", block)
        for index in (H.term_lists(docs, "doc", "text"), H.term_index(docs, "doc", "text")):
            got = H.similar_by_terms(asked, index, "asked", "doc", "text", first_postings=10, direct_pairs=0)
            assert {tuple(r) for r in got.collect()} == want
    nothing = docs.limit(0)
    assert H.similar_by_terms(asked, H.term_lists(nothing, "doc", "text"), "asked", "doc", "text").count() == 0
    assert H.similar_by_terms(nothing.withColumnRenamed("doc", "asked"), H.term_lists(docs, "doc", "text"), "asked", "doc", "text").count() == 0


def test_measures(spark):
    ranked = spark.createDataFrame([("c", 1, "a"), ("c", 2, "a"), ("c", 3, "b"), ("d", 1, "z")], "case string, rank int, item string")
    wanted = spark.createDataFrame([("c", "b"), ("c", "q"), ("d", None), ("e", "a")], "case string, item string")
    m = {r.case: r for r in M.case_metrics(ranked, wanted, 5).collect()}
    assert (m["c"].recall, m["c"].reciprocal_rank, m["c"].precision) == (0.5, 0.5, 0.5)
    assert m["d"].recall is None and m["d"].precision == 0 and m["e"].recall == 0 and m["e"].precision is None
    all_ = M.case_metrics(ranked, wanted, 5)
    assert M.macro(all_, ["recall"]).first().recall == 0.25 and M.macro(all_, ["recall"], True).first().recall == round(0.5 / 3, 6)
    assert M.micro_recall(all_).first().recall == round(1 / 3, 6) and M.duplicate_ratio(ranked).where("case = 'c'").first().ratio == round(1 / 3, 6)
    e = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 4.0, None)], "event string, v double")
    row = M.percentiles(e, "event", "v").first()
    assert (row.n, row.p50, row.p95, row.max) == (4, 2.0, 4.0, 4.0)
    many = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7).alias("v"))
    want = {r.g: (r.p50, r.p95, r.max) for r in many.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"), F.max("v").alias("max")).collect()}
    for ranges in (2, 16, 256):
        assert {r.g: (r.p50, r.p95, r.max) for r in M.percentiles(many, "g", "v", ranges=ranges).collect()} == want
    assert M.percentiles(e.limit(0), "event", "v").count() == 0
    t = M.timings(spark.createDataFrame([("e", '{"a_ms": 3, "b": 1, "c_ms": "x"}'), ("e", "broken")], "event string, p string"), "p")
    assert [(r.metric, r.value) for r in t.collect()] == [("a_ms", 3.0)]
    rounds = spark.createDataFrame([("t", i, n) for i, n in enumerate([0, 2, 0, 0, 1, 0])], "s string, i int, n int")
    assert [r.no_progress for r in M.progress(rounds, "s", "i", "n").orderBy("i").collect()] == [1, 0, 1, 2, 0, 1]
    kinds = spark.createDataFrame([("CONTEXT_REQUEST: a FINAL_SOLUTION: b",), ("FINAL_SOLUTION: x CONTEXT_REQUEST: y",), ("hello",)], "t string").select(M.reply_kind(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["final", "request", "conversation"]


def test_requests():
    r = P.parse_request("words CONTEXT_REQUEST: {} more\nCONTEXT_REQUEST:\nversion: 2\nobjective: >\n  two\n  words\nsearches:\n  - query: a_b\n    repos: [x, 'y']\n  - query: a.b\nsymbols:\n- name: A.b\n  include: [callers]\nexpand: [C3]\n")
    assert r.objective == "two words" and r.searches[0]["repos"] == ["x", "y"] and r.expand == ("C3",)
    assert [(o.tier, o.kind) for o in P.compile_plan(r)] == [(0, "callers"), (1, "search"), (4, "search")]
    assert P.parse_request('{"paths": ["x"]}').paths == ({"query": "x"},)
    for bad in ("version: 3", "symbols:\n  - name: a\n    include: [all]", "files:\n  - path: ../x", "expand: [D1]", "- a", "searches:\n  - repos: [x]"):
        with pytest.raises(ValueError):
            P.parse_request(bad)


def test_retrieve(spark):
    files = spark.createDataFrame([(4, None, "a", "src/A.java", "1"), (4, None, "b", "src/test/BTest.java", "2")], FILES)
    blobs = spark.createDataFrame([("1", "class Alpha {\n  void go() { beta(); }\n}\n", 1), ("2", "class BTest { void t() { new Alpha().go(); } }\n", 1)], "blob string, content string, size long")
    got = P.Engine(files, blobs).retrieve(P.parse_request("searches:\n  - query: Alpha\n  - query: nothing\nsymbols:\n  - name: Alpha\n    include: [definition]\n"))
    assert {(r.repo, r.line_start, r.line_end) for r in got["evidence"].collect()} == {("a", 1, 3), ("b", 1, 1)}
    assert [r.asked for r in got["unresolved"].collect()] == ["search:nothing"]
    assert got["coverage"].first().tests and got["coverage"].first().production_source


def test_chunks_and_vectors(spark):
    code = "import x\n" + "def a():\n" + "  pass\n" * 100 + "class B:\n  y = 1\n"
    texts = spark.createDataFrame([("m", code), ("p", "z\n" * 200), ("e", "")], "blob string, content string")
    got = {(r.blob, r.start_line, r.end_line, r.symbol) for r in S.chunk_source(texts).collect()}
    assert got == {("m", 2, 81, "a"), ("m", 82, 102, "a"), ("m", 103, 104, "B"), ("p", 1, 80, "file"), ("p", 81, 160, "file"), ("p", 161, 200, "file"), ("e", 1, 0, "file")}
    quirks = spark.createDataFrame([("q", "x\n\n  \nclass A\npublic class B\r\nclass C {}")], "blob string, content string")
    assert {(r.start_line, r.end_line, r.symbol, r.kind) for r in S.chunk_source(quirks).collect()} == {(2, 5, "A", "symbol"), (6, 6, "C", "symbol")}
    card = S.cards(S.with_code(S.chunk_source(quirks), quirks).withColumn("repo", F.lit("r")).withColumn("path", F.lit("a.py"))).where("symbol = 'A'").first()
    assert card.card == "Repository: r\nPath: a.py\nLanguage: Python\nKind: symbol\nSymbol: A\nIdentifiers: A B class public\nCode:\n\n  \nclass A\npublic class B"
    import hashlib

    assert card.chunk_id == hashlib.sha256(b"q\x001\x002\x005\x00A\x0080\x002048\x001").hexdigest()
    word = hashlib.sha256(b"alpha").digest()
    one = spark.createDataFrame([("Alpha",)], "t string").select(S.hashed_vector(F.col("t"), 8).alias("v")).first().v
    assert one[int.from_bytes(word[:4], "big") % 8] == (1.0 if word[4] & 1 else -1.0) and sum(map(abs, one)) == 1.0
    assert S.next_fit([2500, 2500, 1500, 1500]) == [[0], [1, 2], [3]] and S.next_fit([]) == []
    rows = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta")], "id int, t string")
    v = {r.id: r.vector for r in S.embed(rows, "t", 8).collect()}
    assert v[1] == v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and v[2] == [0.0] * 8
    cache = spark.createDataFrame([(1, [9.0])], "id int, vector array<double>")
    assert {r.id: r.vector for r in S.with_cached(rows, cache, "id", "t", 8).collect()}[1] == [9.0]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score, r.rank) for r in S.vector_top(vectors, asked, 3).orderBy("rank").collect()] == [(7, 1, 100.0, 1), (7, 3, 85.355, 2), (7, 2, 50.0, 3)]
    assert S.vector_top(vectors, asked.limit(0), 3).count() == 0 and S.vector_top(vectors.limit(0), asked, 3).count() == 0


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, None, "r", "./a", "X"), (1, None, "r", "a", "x"), (1, None, "r", "b", None)], FILES).write.parquet(source)
    stream = lambda: spark.readStream.schema(FILES).parquet(source)
    for _ in range(2):
        ST.refresh(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.path, r.blob) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "x")]
    rounds = str(tmp_path / "rounds")
    rows = [("T", 1, "p1", ["a"]), ("T", 2, "p2", ["a"]), ("T", 3, "p1", ["b"]), ("T", 4, "p3", ["b", "c"]), ("U", 1, "p1", None)]
    spark.createDataFrame(rows, "ticket string, number int, signature string, evidence array<string>").write.parquet(rounds)
    live = spark.readStream.schema("ticket string, number int, signature string, evidence array<string>").parquet(rounds)
    query = ST.session_rounds(live).writeStream.format("memory").queryName("rounds").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("rounds").collect())
    assert got == [("T", 1, 1, 0, False), ("T", 2, 0, 1, False), ("T", 3, 0, 1, True), ("T", 4, 2, 0, False), ("U", 1, 0, 1, False)]


def test_refresh_writes_returns_and_late_deliveries(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: datetime(2025, 1, n)

    def run(rows):
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(source)
        ST.refresh(spark.readStream.schema(FILES).parquet(source), out, str(tmp_path / "state")).awaitTermination()
        return sorted((r.batch, r.snapshot, r.path, r.blob) for r in spark.read.parquet(out).collect())

    rows = [(1, day(1), "r", "a", "A"), (2, day(2), "r", "a", "B"), (3, day(3), "r", "a", "A"), (1, day(1), "r", "b", "X"), (2, day(3), "r", "b", "Y"), (2, day(2), "r", "b", "X"), (3, day(3), "r", "b", None)]
    first = [(0, 1, "a", "a"), (0, 1, "b", "x"), (0, 2, "a", "b"), (0, 2, "b", "y"), (0, 3, "a", "a")]
    assert run(rows) == first
    # unchanged, a late delivery that undoes a change, one of another path that is older than what counts
    got = run([(4, day(4), "r", "a", "A"), (2, day(5), "r", "b", "X"), (1, day(1), "r", "a", "0")])
    assert got == [*first, (1, 2, "b", "x")]
    assert run([(4, day(6), "r", "a", "C")]) == [*got, (2, 4, "a", "c")]


def test_engine_runs_files_and_history_and_reports_the_rest(spark):
    at = datetime(2025, 1, 1)
    files = spark.createDataFrame([(3, at, "r", "a.py", "a"), (4, at, "r", "a.py", "b"), (3, at, "r", "c.py", "c"), (4, at, "r", "c.py", "c"), (4, at, "r", "d.py", "d")], FILES)
    blobs = spark.createDataFrame([("a", "x = 1\n"), ("b", "x = 1\n# OPS-203\n"), ("c", "# OPS-203\n"), ("d", "y = 2\n")], "blob string, content string")
    engine = P.Engine(files, blobs)
    text = "history:\n  - query: OPS-203\n  - query: OPS-999\nfiles:\n  - path: d.py\n    repo: r\nsymbols:\n  - name: main\n    include: [callees]\nexpand: [C1]\n"
    request = P.parse_request(text)
    hits = {(r.asked, r.path, r.line) for r in engine.candidates(request).collect()}
    assert hits == {("history:OPS-203", "a.py", 2)}
    got = engine.retrieve(request)
    assert {(r.path, r.kind) for r in got["evidence"].collect()} == {("a.py", "history"), ("d.py", "requested file")}
    assert sorted(r.asked for r in got["unresolved"].collect()) == ["callees:main", "expand:C1", "history:OPS-999"]


def test_session_evaluation(spark):
    shown = [("IPF-9", 1, "worker:a.java"), ("IPF-9", 2, "worker:a.java"), ("IPF-9", 3, "api:b.java"), ("X-1", 1, "api:z")]
    sessions = spark.createDataFrame(shown, "ticket string, place int, item string")
    cases = spark.createDataFrame([("IPF-9", ["api:b.java", "worker:t/ATest.java"], ["api", "worker"], ["worker:t/ATest.java"]), ("N-1", ["q:r"], ["q"], [])], "ticket string, paths array<string>, repos array<string>, test_paths array<string>")
    row = M.session_evaluation(sessions, cases).collect()
    assert [r.ticket for r in row] == ["IPF-9"]
    row = row[0]
    assert (row.file_recall, row.repo_recall, row.test_recall, row.mrr, row.precision, row.missed) == (0.5, 1.0, 0.0, 1 / 3, 0.5, ["worker:t/ATest.java"])
    assert abs(row.ndcg - 0.5 / (1 + 1 / 1.584962500721156)) < 1e-9 and abs(row.duplicate_ratio - 1 / 3) < 1e-9
    total = M.session_summary(M.session_evaluation(sessions, cases)).first()
    assert (total.sessions, total.file_recall, total.test_recall) == (1, 0.5, 0.0)
    assert M.session_summary(M.session_evaluation(sessions.limit(0), cases)).first().file_recall is None


def test_golden_evaluation(spark):
    ranked = spark.createDataFrame([("c", 1, "r:a"), ("c", 2, "r:a"), ("c", 3, "q:b"), ("c", 4, "r:x")], "case string, rank int, item string")
    suite = spark.createDataFrame([("c", None, "q:b", "production"), ("c", None, "r:t", "tests"), ("c", None, "r:x", "excluded"), ("d", "validation", None, "required")], "case string, split string, item string, role string")
    got = {r.case: r for r in M.golden_evaluation(ranked, suite).collect()}
    c, d = got["c"], got["d"]
    assert (c.split, c.file_recall_at_5, c.repo_recall_at_5, c.test_recall_at_10, c.mrr_at_10, c.precision_at_5, c.false_positives_at_10, c.duplicate_ratio) == ("holdout", 0.5, 1.0, 0.0, 0.5, 1 / 3, 1, 0.25)
    assert d.file_recall_at_5 is None and d.mrr_at_10 is None and d.precision_at_5 is None and d.duplicate_ratio == 0
    assert [r.case for r in M.golden_evaluation(ranked, suite, split="validation").collect()] == ["d"]
    with pytest.raises(ValueError):
        M.golden_evaluation(ranked, suite, split="other")


def test_rounds_and_states(spark):
    rounds = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "session string, number int")
    evidence = spark.createDataFrame([("s", 1, "a"), ("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b")], "session string, number int, key string")
    assert [(r.new_evidence, r.known_evidence, r.no_progress) for r in M.with_progress(rounds, evidence).orderBy("number").collect()] == [(1, 0, 0), (1, 1, 0), (0, 0, 1)]
    calls = spark.createDataFrame([("r", "fts", 1.5, 2, None, True), ("r", "fts", 2.25, None, 3, False), ("r", "rg", 1.0, 1, 1, None)], "run string, backend string, elapsed_ms double, files int, raw_hits int, cache_hit boolean")
    row = M.backend_counters(calls, ["run"]).first()
    assert (row.operations, row.files_visited, row.raw_hits, row.cache_hits, row.backend_ms) == (3, 3, 4, 1, {"fts": 3.75, "rg": 1.0})
    rows = spark.createDataFrame([("r", "a.py", "code"), ("r", "src/test/B.java", "code"), ("knowledge", "1", "knowledge"), ("r", "c", "local diff")], "repo string, path string, kind string").withColumn("g", F.lit(1))
    flags = M.session_coverage(rows, ["g"], history=rows.limit(1)).first()
    assert (flags.production_source, flags.tests, flags.configuration, flags.relationships, flags.git_history) == (True, True, False, False, True)
    sources = spark.createDataFrame([("a", "1", "current", None), ("b", "2", "current", None), ("c", None, "non-git", None), ("d", "4", "fetch-failed", "x")], "name string, sha string, status string, warning string")
    state = C.project_status(sources, spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "4")], "name string, sha string")).first()
    assert (state.repositories, state.current, state.warnings) == (4, 2, 3)
    a, b = P.parse_request("searches:\n  - query: x\n  - query: y\n"), P.parse_request("words\nCONTEXT_REQUEST:\nsearches:\n  - query: y\n  - query: x\n")
    assert P.signature(a) == P.signature(b) != P.signature(P.parse_request("paths:\n  - query: x\n"))


def test_engine_with_everything_else_that_is_known(spark):
    files = spark.createDataFrame([(1, None, "a", "src/A.java", "1"), (1, None, "b", "src/B.java", "2"), (1, None, "b", "long.py", "3")], FILES)
    long = "".join(f"x{i} = {i}\n" for i in range(900))
    blobs = spark.createDataFrame([("1", "class Alpha {\n  void go() { beta(1); }\n}\n"), ("2", "class B {\n  void t() { new Alpha().go(); }\n}\n"), ("3", long)], "blob string, content string")
    documents = spark.createDataFrame([(5, "one\nAlpha is slow\n"), (6, None)], "doc_id long, text string")
    edges = spark.createDataFrame([("a", "b", "HTTP", "GET /alpha", "a:src/A.java:2", "repository name", "high")], "source string, target string, kind string, key string, source_evidence string, target_evidence string, confidence string")
    cases = spark.createDataFrame([("T-1", "2025-01-01", ["slow", "vouchers"])], "ticket string, latest_date string, terms array<string>")
    semantic = spark.createDataFrame([("b", "long.py", 500, 71.5)], "repo string, path string, line int, score double")
    engine = P.Engine(files, blobs, documents=documents, edges=edges, cases=cases, semantic=semantic)
    text = "objective: slow vouchers\nsearches:\n  - query: Alpha\nsymbols:\n  - name: Alpha.go\n    include: [definition, callers, callees]\nfiles:\n  - path: long.py\n    repo: b\n    lines: 3-4\n  - path: gone.py\n    repo: b\nexpand: [C1, C9]\n"
    request = P.parse_request(text)
    manifest = spark.createDataFrame([("C1", "a", "src/A.java", 2)], "candidate string, repo string, path string, line int")
    got = engine.retrieve(request, manifest=manifest, rerank=True)
    evidence = {(r.repo, r.path, r.line_start, r.line_end): r for r in got["evidence"].collect()}
    assert evidence[("b", "long.py", 3, 4)].content == "x2 = 2\nx3 = 3" and evidence[("knowledge", "5", 1, 2)].content == "one\nAlpha is slow"
    assert ("b", "long.py", 425, 575) in evidence and evidence[("b", "long.py", 425, 575)].kind == "semantic candidate"
    assert {"contract relationship", "requested file"} <= set(evidence[("a", "src/A.java", 1, 3)].kind.split(", "))
    assert sorted(r.asked for r in got["unresolved"].collect()) == ["expand:C9", "file:b:gone.py"]
    assert {r.callee for r in got["calls"].collect()} == {"beta"} and [r.ticket for r in got["cases"].collect()] == ["T-1"]
    flags = got["coverage"].first()
    assert flags.relationships and flags.similar_tickets and flags.production_source and not flags.git_history
    small = engine.retrieve(request, budget=10)
    assert small["omitted"].count() > 0 and small["metrics"].first().candidates > 0
    from siftmark.plans.report import context_text

    shown = context_text(got, request.objective)
    assert "b — `long.py:3-4`" in shown and "Alpha.go calls beta" in shown and "expand:C9" in shown
    for bad in ("files:\n  - path: a\n    lines: x\n",):
        with pytest.raises(ValueError):
            engine.retrieve(P.parse_request(bad))


def test_reports(spark):
    from siftmark.plans import report

    names = spark.createDataFrame([("a", "first"), ("b", None)], "repo string, description string")
    facts = spark.createDataFrame([("a", "A.java", 3, " @Service ")], "repo string, path string, line int, text string")
    maven = spark.createDataFrame([("a", "maven-consumer", "g:x"), ("a", "maven-producer", "g:y")], "repo string, kind string, key string")
    got = [(r.repo, r.text) for r in report.fact_lines(names, facts, maven).orderBy("repo", "n").collect()]
    assert got[:6] == [("a", "## a"), ("a", "first"), ("a", "### Framework facts"), ("a", "- `A.java:3` — `@Service`"), ("a", "### Dependencies"), ("a", "- `g:x`")]
    assert [t for r, t in got if r == "b"] == ["## b", "### Framework facts", "- none", "### Dependencies", "- none"]
    case = spark.createDataFrame([("T-1", None, ["a"], ["s"], [f"a:{i}" for i in range(32)], [], [])], "ticket string, latest_date string, repos array<string>, subjects array<string>, paths array<string>, test_paths array<string>, config_paths array<string>")
    assert "and 2 more" in report.case_lines(case).first().text


def test_settings():
    from siftmark.plans.settings import read_settings

    s = read_settings('edition = "semantic"\nrepositories = ["a", "b"]\n[limits]\nhydrated = 9999\n')
    assert s.limits["hydrated"] == 500 and s.limits["per_file"] == 2 and s.can("semantic") and not s.can("rerank")
    assert s.scope() == ("a", "b") and s.scope(["b"]) == ("b",)
    assert read_settings("repositories:\n  - name: x\n", "yaml").repositories == ("x",) and read_settings("{}", "json").edition == "core"
    for bad in ('edition = "x"', "[limits]\nnone = 1", 'repositories = ["a", "a"]', "colour = 1"):
        with pytest.raises(ValueError):
            read_settings(bad)
    with pytest.raises(ValueError):
        s.scope(["q"])


def test_readers(spark, tmp_path):
    from siftmark.sources import readers

    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "src" / "a.py").write_text("x = 1\n")
    (tree / "b.bin").write_bytes(b"a\x00b")
    (tree / "key.pem").write_text("secret")
    got = {r.path: r for r in readers.file_tree(spark, str(tree), "r").collect()}
    assert list(got) == ["src/a.py"] and got["src/a.py"].content == "x = 1\n" and got["src/a.py"].blob == hashlib.sha1(b"blob 6\x00x = 1\n").hexdigest()
    events = str(tmp_path / "events")
    readers.append_metrics(spark.createDataFrame([("e", 3)], "event string, wait_ms int"), events)
    readers.append_metrics(spark.createDataFrame([("e", 5)], "event string, wait_ms int"), events)
    (tmp_path / "events" / "broken.json").write_text("not json\n")
    assert sorted((r.event, r.metric, r.value) for r in readers.metric_events(spark, events).collect()) == [("e", "wait_ms", 3.0), ("e", "wait_ms", 5.0)]
    rows = spark.createDataFrame([("p", "b")], "path string, blob string")
    first = readers.snapshot_export(rows, str(tmp_path / "snap"), "r", "s1")
    assert readers.snapshot_export(rows.limit(0), str(tmp_path / "snap"), "r", "s1") == first and spark.read.parquet(first).count() == 1
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "run log.log").write_text("a\nb\n")
    (outside / "shot.png").write_bytes(b"\x89PNG")
    found = {r.path: r for r in readers.outside_evidence(spark, str(outside), "T-1", "log").collect()}
    assert found["run-log.log"].content == "a\nb\n" and found["run-log.log"].line_end == 2 and found["shot.png"].content is None and len(found["shot.png"].digest) == 64
    with pytest.raises(ValueError):
        readers.outside_evidence(spark, str(outside), "T-1", "rumour")
    payload = '{"columns": ["path", "line"], "rows": [["a.py", 3], ["b.py", null]], "more": "{\\"x\\": 1}", "list": [1, [2]]}'
    rows = spark.createDataFrame([(1, payload), (2, "{broken"), (3, None)], "id int, payload string")
    flat = [(r.id, tuple(sorted(r.fields.items()))) for r in readers.flattened(rows, "id", "payload").collect() if r.fields]
    assert sorted(flat) == sorted([(1, (("more", '{"x": 1}'),)), (1, (("line", "3"), ("path", "a.py"))), (1, (("path", "b.py"),)), (1, (("x", "1"),))])


def test_models(spark):
    from siftmark.operators import models as MO

    near = lambda *v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [("a", 0, near(1.0, 0.0), near(1.0, 0.0), None, None, None), ("a", 1, near(1.0, 1.0), near(1.0, 1.0), near(1.0, 1.0), 0.99, 2), ("a", 2, near(3.0, 1.0), near(3.0, 1.0), None, None, 1), ("b", 0, [2.0, 0.0], [2.0, 0.1], near(0.0, 1.0), 0.5, None), ("c", 0, near(1.0, 2.0), None, None, None, None)]
    got = {r.case: r for r in MO.vector_conformance(spark.createDataFrame(rows, "case string, position int, batch array<double>, single array<double>, reference array<double>, minimum double, expected int")).collect()}
    assert got["a"].passed and got["a"].texts == 3 and not got["c"].parity
    assert (got["b"].parity, got["b"].length, got["b"].reference, got["b"].passed) == (False, False, False, False)
    scores = [("a", 0, 0.9, 0.9, 0.85, 0.1, 0), ("a", 1, 0.2, 0.2, None, None, 0), ("b", 0, float("nan"), 0.1, None, None, 1), ("b", 1, 0.5, 0.5, 0.9, 0.1, 1)]
    got = {r.case: r for r in MO.score_conformance(spark.createDataFrame(scores, "case string, position int, batch double, single double, reference double, maximum double, top int")).collect()}
    assert got["a"].passed and not got["b"].parity and not got["b"].delta
    samples = spark.createDataFrame([("p", 1, 10.0), ("p", 8, 80.0), ("p", 16, 200.0)], "pack string, size int, ms double")
    assert [(r.size, r.per_second) for r in MO.tuned_batch(samples).collect()] == [(8, 100.0)]
    assert MO.tuned_pool(samples, 90.0).first()["size"] == 8 and MO.tuned_pool(samples, 1.0).first()["size"] == 1


def test_mirrors_diffs_and_vectors_of_commits(spark, tmp_path):
    from siftmark.sources import readers

    root = str(tmp_path / "mirror")
    readers.mirror(spark.createDataFrame([("a", "1", "p"), ("b", "1", "q")], "repo string, sha string, path string"), root)
    readers.mirror(spark.createDataFrame([("a", "1", "new")], "repo string, sha string, path string"), root)
    assert {(r.repo, r.path) for r in spark.read.parquet(root).collect()} == {("a", "new"), ("b", "q")}
    diffs = spark.createDataFrame([("a", "x\ny\n", " z "), ("b", None, " \n")], "repo string, unstaged string, staged string")
    assert [(r.repo, r.content, r.line_end) for r in readers.local_diffs(diffs).collect()] == [("a", "x\ny\nz", 3)]
    vectors = str(tmp_path / "vectors")
    S.write_vectors(spark.createDataFrame([("a", "1", "m", 1, [1.0]), ("a", "2", "m", 2, [2.0]), ("b", "1", "n", 3, [3.0])], "repo string, sha string, pack_id string, vec_id int, embedding array<double>"), vectors)
    sources = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "name string, sha string")
    assert [r.vec_id for r in S.current_vectors(spark.read.parquet(vectors), sources, "m").collect()] == [2]
    events = str(tmp_path / "events")
    for n in range(3):
        readers.append_metrics(spark.createDataFrame([("e", n)], "event string, wait_ms int").coalesce(1), events)
    assert readers.metric_events(spark, events, 2).count() == 2 and readers.metric_events(spark, events).count() == 3
