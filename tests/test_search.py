"""Search, facts and paths over a small corpus of several repositories."""

import pytest
from pyspark.sql import functions as F

from siftmark.functions import text as X
from siftmark.operators import lexical as L
from siftmark.operators import relations as R
from siftmark.operators.corpus import GenerationStore, blob_lines, corpus

JAVA = "src/main/java/demo/"
FILES = {
    ("customer-service", JAVA + "CustomerEvent.java"): "package demo;\npublic record CustomerEvent(String id, Kind kind) {\n  enum Kind { ADDRESS_CHANGED, JURISDICTION_CHANGED }\n}\n",
    ("customer-service", JAVA + "CustomerPublisher.java"): 'class CustomerPublisher {\n  void publish(Object event) {\n    kafkaTemplate.send("customer.updated", event);\n  }\n}\n',
    ("trading-service", JAVA + "EligibilityEvaluator.java"): "public interface EligibilityEvaluator {\n  void recalculate(String id);\n}\n",
    ("trading-service", JAVA + "TradingEligibilityService.java"): "@Service\nclass TradingEligibilityService implements EligibilityEvaluator {\n  public void recalculate(String id) {\n    riskClient.getRestrictions(id);\n    save(id);\n  }\n}\n",
    ("trading-service", JAVA + "CustomerChangedListener.java"): 'class CustomerChangedListener {\n  @KafkaListener(topics = "${topics.customer}")\n  void on(String m) {\n    // JURISDICTION_CHANGED\n    service.recalculate("id");\n  }\n}\n',
    ("trading-service", JAVA + "RiskClient.java"): '@FeignClient(name="${services.risk}", path="/risk")\ninterface RiskClient {\n  @GetMapping("/restrictions/{id}")\n  String getRestrictions(String id);\n}\n',
    ("trading-service", "src/main/resources/application.properties"): "topics.customer=customer.updated\nservices.risk=risk-service\n",
    ("trading-service", "src/test/java/demo/CustomerChangedListenerTest.java"): 'class CustomerChangedListenerTest {\n  void test() { service.recalculate("id"); }\n}\n',
    ("trading-service", "pom.xml"): "<project><groupId>demo</groupId><artifactId>trading-service</artifactId><dependencies><dependency><groupId>demo</groupId><artifactId>risk-client</artifactId></dependency><dependency><artifactId>bare</artifactId></dependency></dependencies></project>",
    ("risk-service", JAVA + "RiskController.java"): '@RestController\n@RequestMapping("/risk")\nclass RiskController {\n  @GetMapping("/restrictions/{customerId}")\n  public String restrictions(String customerId) { return ""; }\n}\n',
    ("risk-service", "pom.xml"): "<project><parent><groupId>demo</groupId></parent><artifactId>risk-client</artifactId></project>",
    ("risk-service", "credentials.json"): '{"JURISDICTION_CHANGED": 1}',
    ("risk-service", "node_modules/x/index.js"): "JURISDICTION_CHANGED",
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(4, None, repo, path, f"b{i}") for i, (repo, path) in enumerate(FILES)]
    files = spark.createDataFrame(rows, "snapshot int, delivered_at timestamp, repo string, path string, blob string")
    blobs = spark.createDataFrame([(f"b{i}", c, len(c)) for i, c in enumerate(FILES.values())] * 2, "blob string, content string, size long")
    return corpus(files, blobs), blobs


@pytest.fixture(scope="module")
def texts(tables):
    files, blobs = tables
    return files.join(blobs.select("blob", "content").distinct(), "blob").select("repo", "path", "blob", "content")


def places(df):
    return {(r.repo, r.path.split("/")[-1], r.line) for r in df.collect()}


def test_literal_search(tables):
    got = L.literal_search(*tables, "JURISDICTION_CHANGED")
    assert {r.repo for r in got.collect()} == {"customer-service", "trading-service"}
    assert got.count() == 2
    assert L.literal_search(*tables, "recalculate", 1).groupBy("repo").count().where("count > 1").count() == 0
    assert L.literal_search(*tables, "nowhere at all").count() == 0


def test_trigrams_find_the_same(tables, tmp_path):
    store = GenerationStore(tables[0].sparkSession, str(tmp_path / "store"))
    store.publish(*tables, index=True)
    assert places(L.trigram_search(tables[0], store, "recalculate")) == places(L.literal_search(*tables, "recalculate"))
    assert store.postings().count() == L.trigram_index(tables[1]).count()
    with pytest.raises(ValueError):
        L.trigram_search(tables[0], store, "ab")


def test_regex_only_where_no_literal(tables):
    assert L.literal_or_regex(*tables, r"recalc\w+\(").select("score").distinct().first()[0] == 80
    assert L.literal_or_regex(*tables, "recalculate").select("score").distinct().first()[0] == 95
    assert L.literal_or_regex(*tables, "recalculate(").count() == 4


def test_paths(tables):
    got = L.path_search(tables[0], "application.properties").collect()
    assert [(r.path.split("/")[-1], r.score) for r in got] == [("application.properties", 100.0)]
    assert {r.score for r in L.path_search(tables[0], "customer listener").collect()} == {85.0}


def test_symbols(tables):
    assert places(L.symbol_search(*tables, "demo.EligibilityEvaluator")) == {("trading-service", "EligibilityEvaluator.java", 1)}
    assert L.symbol_search(*tables, "kafkaTemplate").select("kind").distinct().first()[0] == "symbol reference"
    assert places(L.implementations(*tables, "demo.EligibilityEvaluator")) == {("trading-service", "TradingEligibilityService.java", 2)}
    assert {p for _, p, _ in places(L.test_mentions(*tables, "service.recalculate"))} == {"CustomerChangedListenerTest.java"}
    kinds = {(r.path.split("/")[-1], r.kind) for r in L.trace(*tables, "recalculate").collect()}
    assert ("TradingEligibilityService.java", "definition") in kinds and ("CustomerChangedListener.java", "caller") in kinds


def test_relationships_and_paths(spark, texts):
    config = R.config_values(texts)
    assert {(r.key, r.value) for r in config.collect()} == {("topics.customer", "customer.updated"), ("services.risk", "risk-service")}
    settings = R.settings(texts)
    http = R.http_facts(texts, settings)
    assert {(r.kind, r.key, r.detail) for r in http.collect()} == {("http-client", "GET /risk/restrictions/{}", "risk-service"), ("http-server", "GET /risk/restrictions/{}", "")}
    maven = R.maven_facts(texts)
    assert {(r.kind, r.key) for r in maven.collect()} == {("maven-producer", "demo:trading-service"), ("maven-producer", "demo:risk-client"), ("maven-consumer", "demo:risk-client"), ("maven-consumer", "?:bare")}
    facts = R.all_facts(texts)
    edges = R.relationships(facts)
    assert {(r.source, r.target, r.kind, r.key) for r in edges.collect()} == {
        ("customer-service", "trading-service", "KAFKA", "customer.updated"),
        ("trading-service", "risk-service", "HTTP", "GET /risk/restrictions/{}"),
        ("trading-service", "risk-service", "MAVEN_DEPENDS_ON", "demo:risk-client"),
    }
    assert [r.path for r in R.workflow_paths(edges.where("kind <> 'MAVEN_DEPENDS_ON'")).orderBy(F.size("path").desc()).collect()][0] == ["customer-service", "trading-service", "risk-service"]
    best = R.relationship_slice(edges, spark.createDataFrame([("customer-service", JAVA + "CustomerPublisher.java")], "repo string, path string"), ["customer"]).first()
    assert best.key == "customer.updated" and best.score == 110
    both = spark.createDataFrame([("customer-service", JAVA + "CustomerPublisher.java"), ("trading-service", JAVA + "CustomerChangedListener.java")], "repo string, path string")
    assert R.relationship_slice(edges, both, []).where("key = 'customer.updated'").first().score == 100
    assert R.asked_terms(["Find the service of customer.updated, now"]) == ["customer.updated", "now"]


def test_unserved_client_goes_to_the_named_service(spark):
    rows = [("web", "http-client", "GET /x", "W.java", 3, "Risk_Service"), ("risk-service", "maven-producer", "g:risk", "pom.xml", 1, "")]
    got = R.relationships(spark.createDataFrame(rows, "repo string, kind string, key string, path string, line int, detail string")).collect()
    assert [(r.source, r.target, r.kind, r.confidence) for r in got] == [("web", "risk-service", "FEIGN_TARGET", "medium")]
    own = spark.createDataFrame([*rows, ("web", "http-server", "GET /x", "C.java", 1, "")], "repo string, kind string, key string, path string, line int, detail string")
    assert [(r.key, r.target_evidence) for r in R.relationships(own).where("kind = 'FEIGN_TARGET'").collect()] == [("Risk_Service", "repository name")]


KAFKA = """class A {
  static final String TOPIC = "orders.new";
  @Value("${topics.paid:orders.paid}") private String paid;
  @KafkaListener(
      topics = {TOPIC, "orders.old", "${topics.gone}"},
      groupId = "billing")
  void on(String m) {
    kafkaTemplate.send(paid, m);
    kafkaTemplate.send("${nowhere}", m);
    streamBridge.send("orders-out-0", m);
  }
  @KafkaListener("plain")
  void more() {}
}
"""


def test_kafka_facts_read_constants_annotations_and_bindings(spark):
    rows = [("r", "A.java", KAFKA), ("r", "application.yml", "topics:\n  gone: orders.gone\nspring:\n  cloud:\n    stream:\n      bindings:\n        a-in-0:\n          destination: t.in\n        b-out-0:\n          destination: 't.out'\n")]
    texts = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {(r.kind, r.key, r.line, r.detail) for r in R.kafka_facts(texts, R.settings(texts)).collect()}
    assert got == {
        ("kafka-consumer", "orders.new", 4, "@KafkaListener"), ("kafka-consumer", "orders.old", 4, "@KafkaListener"), ("kafka-consumer", "orders.gone", 4, "@KafkaListener"), ("kafka-consumer", "plain", 12, "@KafkaListener"),
        ("kafka-producer", "orders.paid", 8, "KafkaTemplate.send"), ("kafka-producer", "orders-out-0", 10, "StreamBridge.send"),
        ("kafka-consumer", "t.in", 8, "a-in-0"), ("kafka-producer", "t.out", 10, "b-out-0"),
    }


def test_http_facts_resolve_and_skip_plain_mappings(spark):
    code = '@RestController\n@RequestMapping("${base}")\nclass C {\n  @RequestMapping("/all")\n  String a() { return ""; }\n  public @RequestMapping("/any") String b() { return ""; }\n  @DeleteMapping(path = "/x", value = "/{id}/")\n  void c() {}\n}\n'
    texts = spark.createDataFrame([("r", "C.java", code), ("r", "a.properties", "base=/v1\n"), ("r", "N.java", "@GetMapping(\"/x\")")], "repo string, path string, content string")
    assert {(r.kind, r.key, r.line) for r in R.http_facts(texts, R.settings(texts)).collect()} == {("http-server", "ANY /v1/any", 6), ("http-server", "DELETE /v1/{}", 7)}


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "a"), (None, "c")], "source string, target string")
    assert {tuple(r.path) for r in R.workflow_paths(e).collect()} == {("a", "b", "c"), ("b", "a"), ("b", "c")}
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(29)], "source string, target string")
    assert max((r.path for r in R.workflow_paths(chain).collect()), key=len) == [f"n{i:02}" for i in range(30)]
    assert R.workflow_paths(chain.limit(0)).count() == 0


def test_yaml_keys(spark):
    doc = "a:\n  b: 1 \n  # c: 2\n  d:\n    x: y\n  e:\n    - f: 3\n    g: 'h'\nz: {}\n"
    got = R.yaml_values(spark.createDataFrame([("r", "c.yml", doc), ("r", "n.yaml", None), ("r", "c.txt", "a: 1")], "repo string, path string, content string"))
    assert {(r.key, r.value, r.line) for r in got.collect()} == {("a.b", "1", 2), ("a.d.x", "y", 5), ("a.e.g", "h", 8), ("z", "{}", 9)}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.terms(F.lit("getUserName of the TransactionCache HTTPServer")).alias("terms"),
        X.ticket_ids(F.lit("IPF-101: x AIPF-7 and IPF-101, no xIPF-9")).alias("ids"),
        X.route(F.lit("a//b/{id}/")).alias("route"),
        X.stem(F.lit("d/.env")).alias("stem"),
        X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        X.version_key(F.lit("v1.10.2")).alias("version"),
        X.split_lines(F.lit("a\r\nb\rc\n\n")).alias("lines"),
        X.trigrams(F.lit("AbcA🎉x")).alias("grams"),
        X.trigrams(F.lit("ab")).alias("none"),
        X.line_of(F.lit("a\nb\nc"), F.lit(3)).alias("line"),
        X.cut_text(F.lit("ab\ncd\n" + "x" * 9), 5).alias("cut"),
        F.array(*[X.ssh_endpoint(F.lit(u)) for u in ("ssh://Git@Host.Example:2222/a/b.git", "git@Host.example:a/b", "https://h/x", "C:\\x", "plain")]).alias("ssh"),
    ).first()
    assert row.terms == ["cache", "get", "httpserver", "name", "transaction", "user"]
    assert row.ids == ["IPF-101", "AIPF-7", "IPF-9"] and row.route == "/a/b/{}" and row.stem == ".env" and row.zero == 0
    assert row.version == [1, 10, 2] and row.lines == ["a", "b", "c", ""]
    assert row.line == 2 and row.ssh == ["Git@host.example:2222", "git@host.example", None, None, None]
    assert row.cut == chunked("ab\ncd\n" + "x" * 9, 5)
    assert row.grams == ["abc", "bca", "ca🎉", "a🎉x"] and row.none == []


def test_lines_of_odd_texts(spark):
    blobs = spark.createDataFrame([("a", "", 0), ("B", "x", 1), ("c", None, 0), ("d", "1\n2", 3)], "blob string, content string, size long")
    assert {(r.blob, r.line, r.text) for r in blob_lines(blobs).collect()} == {("b", 1, "x"), ("d", 1, "1"), ("d", 2, "2")}


def chunked(text, size):
    out = []
    while text:
        at = min(size, len(text))
        if at < len(text):
            newline = text.rfind("\n", 0, at)
            at = newline + 1 if newline >= size // 2 else at
        out.append(text[:at])
        text = text[at:]
    return out or [""]


def test_pieces_of_a_delivery(spark):
    texts = ["", "abc", "ab\ncd\n" + "x" * 9, "line one\nline two\n\nline three\n" * 7, "🎉\n" * 30, "\n" * 25]
    for size in (1, 2, 5, 16, 40):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.cut_text(F.col("t"), size).alias("p"))
        assert {r.i: r.p for r in df.collect()} == {i: chunked(t, size) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        X.cut_text(F.lit("x"), 0)


def test_odd_queries(tables, spark):
    assert L.literal_or_regex(*tables, "(unclosed").count() == 0
    docs = spark.createDataFrame([(1, "one (b two\nx"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.line) for r in L.knowledge_hits(docs, "(B").collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        L.path_search(tables[0], "  ")


def test_callees_come_from_the_source_around(tables):
    got = [r.callee for r in L.callees(*tables, "EligibilityEvaluator.recalculate").collect()]
    assert got == ["riskClient.getRestrictions", "save"]


def test_structural_table_and_trace(spark):
    code = "class A:\n    def top():\n        mid()\n    def mid():\n        low()\n        print(1)\n    def low():\n        return low()\n"
    texts = spark.createDataFrame([("r", "a.py", code), ("q", "b.py", "def mid():\n    pass\n"), ("r", "n.py", None)], "repo string, path string, content string")
    declared = L.symbols(texts)
    assert {(r.repo, r.line, r.end_line, r.name) for r in declared.collect()} == {("r", 1, 1, "A"), ("r", 2, 3, "top"), ("r", 4, 6, "mid"), ("r", 7, 8, "low"), ("q", 1, 2, "mid")}
    edges = L.call_edges(texts, declared)
    assert {(r.caller, r.callee) for r in edges.collect()} == {("top", "mid"), ("mid", "low")}
    got = {(r.name, r.direction, r.depth) for r in L.structural_trace(declared, edges, "x.top").collect()}
    assert got == {("mid", "out", 1), ("low", "out", 2)}
    assert {(r.repo, r.text) for r in L.structural_search(declared, "mid").collect()} == {("r", "mid"), ("q", "mid")}
