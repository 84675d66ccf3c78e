"""Context requests: parsed from a reply, checked, compiled to a plan and run as one set of DataFrames."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions.text import split_lines
from siftmark.operators import lexical, ranking
from siftmark.operators.corpus import corpus, matching_lines, newest, stored_blobs
from siftmark.operators.history import occurrences, similar_cases
from siftmark.operators.measure import session_coverage
from siftmark.operators.relations import asked_terms, relationship_slice
from siftmark.operators.snapshots import latest_entries
from siftmark.runtime import cut

# What a symbol request may include.
INCLUDES = ("definition", "callers", "callees", "implementations", "tests")
MARK = "CONTEXT_REQUEST:"


@dataclass(frozen=True)
class Operation:
    """One step of a plan; tiers run narrow first."""

    tier: int
    cost: int
    kind: str
    value: str
    repos: tuple[str, ...] = ()
    protected: bool = False
    reason: str = ""


@dataclass(frozen=True)
class Request:
    """A checked request."""

    objective: str = ""
    version: int = 2
    searches: tuple[dict, ...] = ()
    paths: tuple[dict, ...] = ()
    symbols: tuple[dict, ...] = ()
    files: tuple[dict, ...] = ()
    history: tuple[dict, ...] = ()
    expand: tuple[str, ...] = field(default=())


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "[{\"" and text[-1:] in "]}\"":
        try:
            return json.loads(text)
        except ValueError:
            if text[0] == "[":
                return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text.strip("'\""))


def parse_yaml(text: str):
    """The part of YAML that requests use: nested maps and lists by indentation, scalars, flow lists and block texts."""
    rows = [(len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    at = 0

    def block(depth: int):
        nonlocal at
        out: dict | list | None = None
        while at < len(rows) and rows[at][0] >= depth:
            indent, line = rows[at]
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                rest = line[1:].strip()
                if re.match(r"^[\w.-]+:(\s|$)", rest):
                    rows[at] = (indent + 2, rest)
                    out.append(block(indent + 1))
                else:
                    at += 1
                    out.append(_scalar(rest) if rest else block(indent + 1))
                continue
            key, colon, value = line.partition(":")
            if not colon or isinstance(out, list):
                break
            out = {} if out is None else out
            at += 1
            value = value.strip()
            if value[:1] in ("|", ">"):
                parts = []
                while at < len(rows) and rows[at][0] > indent:
                    parts.append(rows[at][1])
                    at += 1
                out[key.strip()] = ("\n" if value[0] == "|" else " ").join(parts)
            elif value:
                out[key.strip()] = _scalar(value)
            else:
                deeper = at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-"))
                out[key.strip()] = block(rows[at][0]) if deeper else None
        return out

    return block(0)


def parse_request(reply: str) -> Request:
    """The request after the last marker of a reply, or a reply that is one. Raises ``ValueError`` if it is not valid."""
    body = reply.rsplit(MARK, 1)[-1] if MARK in reply else reply
    body = re.sub(r"^```\w*\n|\n```.*$", "", body.strip("\n"), flags=re.S)
    try:
        data = json.loads(body)
    except ValueError:
        data = parse_yaml(body)
    if not isinstance(data, dict):
        raise ValueError("a request is a mapping")
    version = data.get("version", 1)
    if version not in (1, 2):
        raise ValueError("version has to be 1 or 2")
    lists = {}
    for name, need in (("searches", "query"), ("paths", "query"), ("symbols", "name"), ("files", "path"), ("history", "query")):
        items = data.get(name) or []
        if not isinstance(items, list):
            raise ValueError(f"{name} has to be a list")
        lists[name] = tuple({need: i} if isinstance(i, str) else i for i in items)
        if any(not isinstance(i, dict) or not i.get(need) for i in lists[name]):
            raise ValueError(f"{name} need {need}")
    for s in lists["symbols"]:
        if set(s.get("include") or ()) - set(INCLUDES):
            raise ValueError("include may hold " + ", ".join(INCLUDES))
    for f in lists["files"]:
        if ".." in f["path"].split("/") or f["path"].startswith("/"):
            raise ValueError("a path may not leave its repository")
    expand = tuple(data.get("expand") or ())
    if any(not re.fullmatch(r"C[1-9]\d*", str(c)) for c in expand):
        raise ValueError("expand names candidates like C1")
    return Request(str(data.get("objective") or "").strip(), version, expand=expand, **lists)


# Tier and cost of each kind of operation; symbols and searches as ``compile_plan`` says.
TIERS = {"file": (0, 0), "path": (0, 1), "history": (3, 4)}
SYMBOL_TIERS = {"dotted": (0, 1), "plain": (1, 2)}
SEARCH_TIERS = {"word": (1, 2), "other": (4, 2)}


def compile_plan(request: Request) -> list[Operation]:
    """The operations of a request, narrow ones first: by tier, cost, kind, value and repositories.

    A dotted symbol is narrower than a plain one; a search for one word of letters, digits
    and underscores narrower than any other.
    """
    repos = lambda i: tuple(i.get("repos") or ())
    out = []
    for f in request.files:
        out.append(Operation(*TIERS["file"], "file", f"{f.get('repo')}:{f['path']}", (str(f.get("repo")),), True, "named by the request"))
    for s in request.symbols:
        place = SYMBOL_TIERS["dotted" if "." in s["name"] else "plain"]
        out += [Operation(*place, k, s["name"], repos(s), k == "definition", "about a symbol") for k in s.get("include") or ["definition"]]
    out += [Operation(*TIERS["path"], "path", p["query"], repos(p), True, "names of files") for p in request.paths]
    for q in request.searches:
        word = q["query"].replace("_", "").isalnum()
        out.append(Operation(*SEARCH_TIERS["word" if word else "other"], "search", q["query"], repos(q), False, "as it stands, else as an expression"))
    out += [Operation(*TIERS["history"], "history", h["query"], repos(h), False, "changes over time") for h in request.history]
    return sorted(out, key=lambda o: (o.tier, o.cost, o.kind, o.value, o.repos))


def actions(request: Request) -> list[dict]:
    """Every operation a request asks for, as kind, value and repositories; files with their lines, candidates to expand too."""
    repos = lambda i: [str(r) for r in i.get("repos") or ()]
    out = [{"kind": "search", "value": q["query"], "repos": repos(q)} for q in request.searches]
    out += [{"kind": "path", "value": p["query"], "repos": repos(p)} for p in request.paths]
    out += [{"kind": k, "value": s["name"], "repos": repos(s)} for s in request.symbols for k in s.get("include") or ["definition"]]
    out += [{"kind": "file", "value": ":".join(str(x) for x in (f.get("repo"), f["path"], f.get("lines")) if x), "repos": [str(f.get("repo"))]} for f in request.files]
    out += [{"kind": "history", "value": h["query"], "repos": repos(h)} for h in request.history]
    return out + [{"kind": "expand", "value": c, "repos": []} for c in request.expand]


def signature(request: Request) -> str:
    """A digest of what a request asks for, whatever the order of its parts and its words around them."""
    told = sorted(json.dumps(a, sort_keys=True) for a in actions(request))
    if not told:
        raise ValueError("the request asks for nothing")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def explain(spark: SparkSession, plan: list[Operation]) -> DataFrame:
    """The plan as rows, in the order of its steps."""
    rows = [(i, o.tier, o.cost, o.kind, o.value, list(o.repos), o.protected, o.reason) for i, o in enumerate(plan, 1)]
    return spark.createDataFrame(rows, "step int, tier int, cost int, kind string, value string, repos array<string>, protected boolean, reason string")


def line_range(told) -> tuple[int, int] | None:
    """The lines of ``10-40`` or ``10:40``; None where nothing is told, an error for anything else."""
    if not told:
        return None
    m = re.fullmatch(r"\s*(\d+)\s*[-:]\s*(\d+)\s*", str(told))
    if not m:
        raise ValueError(f"{told!r} is no range of lines such as 10-40")
    return int(m[1]), int(m[2])


HIT = ["repo", "path", "line", "text", "kind", "score", "found_by"]
INTERVAL = ["repo", "path", "line_start", "line_end", "kind", "score", "found_by"]
#: Characters of shown source, and what direct evidence scores.
SOURCE_CHARS, DIRECT_SCORE, RELATION_SCORE, HISTORY_SCORE = 140_000, 100.0, 92.0, 50.0


class Engine:
    """Retrieval over one snapshot: candidates of all channels, fused, selected, shown within a budget and merged.

    Beside files and blobs it takes what else is known: ``documents`` (doc_id, text) as
    knowledge, ``edges`` of relationships, ``cases`` of tickets and ``semantic`` hits
    (repo, path, line, score) for the objective. Each is optional; its channel is left out without it.
    """

    def __init__(self, files: DataFrame, blobs: DataFrame, snapshot: int | None = None, *, documents: DataFrame | None = None, edges: DataFrame | None = None, cases: DataFrame | None = None, semantic: DataFrame | None = None):
        self.files, self.blobs = corpus(files, blobs, snapshot), blobs
        last = newest(files) if snapshot is None else F.lit(snapshot)
        self.entries = latest_entries(files.where(F.col("snapshot") <= last))
        self.documents, self.edges, self.cases, self.semantic = documents, edges, cases, semantic

    def _scope(self, repos: list[str] | tuple[str, ...] | None) -> DataFrame:
        return self.files.where(F.col("repo").isin(list(repos))) if repos else self.files

    @staticmethod
    def _patterns(request: Request, valid) -> tuple[list, dict[str, tuple[str, int]]]:
        """The patterns of one pass over all contents, and for each tag the part that asked and its turn: a later turn counts where no earlier one has hits."""
        patterns, meant = [], {}

        def add(asked: str, turn: int, make, value: str, repos) -> None:
            tag = f"{len(patterns)}"
            patterns.append(make(value, tag, tuple(str(r) for r in repos or ())))
            meant[tag] = (asked, turn)

        for q in request.searches:
            add(f"search:{q['query']}", 0, lexical.literal, q["query"], q.get("repos"))
            if valid(q["query"]):
                add(f"search:{q['query']}", 1, lexical.regex, q["query"], q.get("repos"))
        makers = {"implementations": lexical.implementation, "tests": lexical.test_mention, "callers": lexical.call, "callees": lexical.call}
        for s in request.symbols:
            for kind in s.get("include") or ["definition"]:
                asked = f"{kind}:{s['name']}"
                add(asked, 0, makers.get(kind, lexical.definition), s["name"], s.get("repos"))
                if kind == "definition":
                    add(asked, 1, lexical.reference, s["name"], s.get("repos"))
        return patterns, meant

    def _lines(self, request: Request, limit: int) -> DataFrame | None:
        """The hits of searches and symbols with ``asked``, written down."""
        patterns, meant = self._patterns(request, lambda q: lexical.valid(self.blobs.sparkSession, q))
        if not patterns:
            return None
        tags = F.create_map(*[F.lit(x) for tag, (asked, _) in meant.items() for x in (tag, asked)])
        turns = F.create_map(*[F.lit(x) for tag, (_, turn) in meant.items() for x in (tag, turn)])
        hits = lexical.scan(self.files, self.blobs, patterns, limit)
        hits = cut(hits.select(*HIT, F.element_at(tags, F.col("tag")).alias("asked"), F.element_at(turns, F.col("tag")).alias("turn")))
        best = F.broadcast(hits.groupBy("asked").agg(F.min("turn").alias("turn")))  # one row for each part of the request
        return hits.join(best, ["asked", "turn"]).select(*HIT, "asked")

    def candidates(self, request: Request, limit: int = 100) -> DataFrame:
        """Hits of every channel that the request names, with the request's part in ``asked``."""
        asked = self._asked(request)
        if not asked:
            raise ValueError("the request asks for nothing")
        parts = []
        lines = self._lines(request, limit)
        if lines is not None:
            names = {f"{k}:{s['name']}": s["name"] for s in request.symbols for k in ("callers", "callees") if k in (s.get("include") or ())}
            traced = F.col("asked").isin(list(names))
            parts.append(lines.where(~traced))
            for part, name in names.items():
                parts.append(lexical.split_calls(lines.where(F.col("asked") == part), name).select(*HIT, "asked"))
        for p in request.paths:
            hits = lexical.path_search(self._scope(p.get("repos")), p["query"])
            parts.append(hits.select("repo", "path", F.lit(1).alias("line"), F.col("path").alias("text"), F.lit("verified path").alias("kind"), "score", F.array(F.lit("path")).alias("found_by"), F.lit(f"path:{p['query']}").alias("asked")))
        for h in request.history:
            parts.append(self._changed(h["query"], h.get("repos")).withColumn("asked", F.lit(f"history:{h['query']}")))
        if self.semantic is not None:
            parts.append(self.semantic.select("repo", "path", "line", F.lit("").alias("text"), F.lit("semantic candidate").alias("kind"), "score", F.array(F.lit("semantic")).alias("found_by"), F.lit("").alias("asked")))
        out = self._none() if not parts else parts[0].select(*HIT, "asked")
        for p in parts[1:]:
            out = out.unionByName(p.select(*HIT, "asked"))
        return out

    def _none(self) -> DataFrame:
        return self.blobs.sparkSession.createDataFrame([], "repo string, path string, line int, text string, kind string, score double, found_by array<string>, asked string")

    def _changed(self, query: str, repos: list[str] | None, limit: int = 20) -> DataFrame:
        """Files of the snapshot that changed, from one snapshot to the next, how often the literal ``query`` occurs.

        The ``limit`` newest changes by snapshot, repo and path, at the first line that holds the
        literal now, else at line 1. Only the numbers of the contents that hold it are joined.
        """
        held = self.blobs.where(F.col("blob").isNotNull() & F.col("content").contains(query)).select(F.lower("blob").alias("blob"), occurrences(F.col("content"), query).alias("n"))
        held = cut(held.groupBy("blob").agg(F.max("n").alias("n")))
        entries = self.entries.where(F.col("repo").isin(list(repos))) if repos else self.entries
        before = F.lag("n").over(Window.partitionBy("repo", "path").orderBy("snapshot"))
        rows = entries.where(F.col("blob").isNotNull()).join(held, "blob", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("was", before)
        rows = rows.where(F.col("was").isNotNull() & (F.col("n") != F.col("was"))).groupBy("repo", "path").agg(F.max("snapshot").alias("changed"))
        few = cut(rows.join(self.files, ["repo", "path"]).orderBy(F.col("changed").desc(), "repo", "path").limit(limit))
        lines = matching_lines(self._contents(few), F.col("text").contains(query), F.col("content").contains(query))
        first = lines.groupBy("blob").agg(F.min(F.struct("line", "text")).alias("x"))
        hits = few.join(first, "blob", "left")
        return hits.select("repo", "path", F.coalesce("x.line", F.lit(1)).alias("line"), F.coalesce("x.text", F.lit("")).alias("text"), F.lit("history").alias("kind"), F.lit(HISTORY_SCORE).alias("score"), F.array(F.lit("history")).alias("found_by"))

    def _contents(self, few: DataFrame) -> DataFrame:
        """The contents of a bounded number of files, which are looked up in the scan."""
        blobs = self.blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).withColumn("blob", F.lower("blob"))
        return blobs.join(F.broadcast(few.select("blob").distinct()), "blob", "left_semi")

    def _direct(self, request: Request, manifest: DataFrame | None) -> DataFrame | None:
        """Files that the request names, whole or in its lines, and expanded candidates of an earlier round as single lines: repo, path, start, end, asked."""
        rows = []
        for f in request.files:
            a, b = line_range(f.get("lines")) or (int(f["line_start"]) if f.get("line_start") else None, int(f["line_end"]) if f.get("line_end") else None)
            rows.append((str(f["repo"]) if f.get("repo") else None, f["path"], a, b, self._file(f)))
        out = self.blobs.sparkSession.createDataFrame(rows, "r string, path string, a int, b int, asked string") if rows else None
        if request.expand and manifest is not None:
            more = manifest.where(F.col("candidate").isin(list(request.expand))).select(F.col("repo").alias("r"), "path", F.col("line").alias("a"), F.col("line").alias("b"), F.concat(F.lit("expand:"), "candidate").alias("asked"))
            out = more if out is None else out.unionByName(more)
        if out is None:
            return None
        found = self.files.join(F.broadcast(out), "path").where(F.col("r").isNull() | (F.col("r") == F.col("repo")))  # as many rows as the request names
        return cut(found.select("repo", "path", "blob", "a", "b", "asked"))

    @staticmethod
    def _file(f: dict) -> str:
        return f"file:{f.get('repo')}:{f['path']}"

    def retrieve(self, request: Request, *, limit: int = 100, manifest: DataFrame | None = None, rerank: bool = False, budget: int = SOURCE_CHARS, window: int = ranking.WINDOW_LINES, full: int = ranking.FULL_FILE_LINES, **quotas: int) -> dict[str, DataFrame]:
        """What a request finds, as named tables.

        ``selected`` and ``omitted`` (numbered) regions, merged ``evidence`` with content, ``relationships``,
        ``calls`` (symbol, callee), ``history``, ``cases``, ``unresolved`` parts, ``coverage`` and ``metrics``.
        ``manifest`` is the ``omitted`` table of an earlier round, for candidates to expand; ``rerank`` moves
        unprotected candidates by what their snippets share with the objective.
        """
        spark = self.blobs.sparkSession
        hits = cut(self.candidates(request, limit))
        direct = self._direct(request, manifest)
        relationships = self._relationships(request, hits, direct)
        found = hits.drop("asked")
        if relationships is not None:
            found = found.unionByName(self._at_evidence(relationships))
        if rerank:
            named = [n for n in ("searches", "paths", "symbols", "files", "history") if getattr(request, n)]
            found = ranking.rerank(found, request.objective + (" " + " ".join(named) if named else ""))
        # at most the candidate limit's number of rows, read by every part of the result
        regions = cut(ranking.diversity(ranking.anchor_regions(ranking.fuse(found), max(10, window)), **quotas))
        chosen = regions.where("selected").drop("selected")
        shown = cut(self._texts(chosen, direct))
        sizes = shown.select("repo", "path", F.size("ls").alias("lines"))
        windows = ranking.source_window(chosen, sizes, window, full).join(shown, ["repo", "path"]).withColumn("size", F.length(_slice("ls", "line_start", "line_end"))).drop("ls", "blob")
        asked_for = self._intervals(direct, sizes)
        knowledge = self._knowledge(request)
        first = self._chars(asked_for, shown) + (knowledge.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0] if knowledge is not None else 0)
        taken = ranking.within_budget(windows, "size", budget, quotas.get("total", ranking.HYDRATED), used=first)
        windows = windows.join(taken.where("taken").select("repo", "path", "line"), ["repo", "path", "line"])
        intervals = windows.select(*INTERVAL) if asked_for is None else windows.select(*INTERVAL).unionByName(asked_for.select(*INTERVAL))
        merged = ranking.merge_intervals(intervals).join(shown, ["repo", "path"])
        evidence = merged.select(*INTERVAL, _slice("ls", "line_start", "line_end").alias("content"))
        if knowledge is not None:
            evidence = evidence.unionByName(knowledge)
        left = regions.join(taken.where("taken").select("repo", "path", "line"), ["repo", "path", "line"], "left_anti").drop("selected")
        calls = self._calls(request, hits)
        history = hits.where(F.col("kind") == "history").select("asked", "repo", "path", "line", "text").distinct()
        cases = similar_cases(self.cases, request.objective) if self.cases is not None else None
        return {
            "selected": chosen,
            "omitted": ranking.numbered(left),
            "evidence": evidence.orderBy(F.col("score").desc(), "repo", "path", "line_start"),
            "relationships": relationships if relationships is not None else spark.createDataFrame([], "source string, target string, kind string, key string, source_evidence string, target_evidence string, confidence string, score int"),
            "calls": calls,
            "history": history,
            "cases": cases if cases is not None else spark.createDataFrame([], "ticket string, score int"),
            "unresolved": self._unresolved(request, hits, direct, calls),
            "coverage": session_coverage(evidence.withColumn("all", F.lit(1)), ["all"], relationships=_any(relationships, calls), history=_any(history), cases=_any(cases)).drop("all"),
            "metrics": spark.range(1).select(hits.agg(F.count("*")).scalar().alias("candidates"), evidence.agg(F.count("*")).scalar().alias("hydrated_regions"), left.agg(F.count("*")).scalar().alias("deferred_candidates")),
        }

    def _texts(self, chosen: DataFrame, direct: DataFrame | None) -> DataFrame:
        """(repo, path, blob, ls): the lines of the few files that are shown."""
        wanted = chosen.select("repo", "path").distinct().join(self.files, ["repo", "path"]).select("repo", "path", "blob")
        if direct is not None:
            wanted = wanted.unionByName(direct.select("repo", "path", "blob")).distinct()
        wanted = cut(wanted)
        lines = stored_blobs(self._contents(wanted)).select("blob", split_lines(F.col("content")).alias("ls"))
        return wanted.join(lines, "blob")

    @staticmethod
    def _intervals(direct: DataFrame | None, sizes: DataFrame) -> DataFrame | None:
        if direct is None:
            return None
        rows = direct.join(sizes, ["repo", "path"])
        start, end = F.greatest(F.lit(1), F.coalesce("a", F.lit(1))), F.least(F.col("lines"), F.coalesce("b", F.col("lines")))
        rows = rows.select("repo", "path", start.alias("line_start"), end.alias("line_end"), F.lit("requested file").alias("kind"), F.lit(DIRECT_SCORE).alias("score"), F.array(F.lit("file")).alias("found_by"))
        return rows.where(F.col("line_start") <= F.col("line_end")).distinct()

    @staticmethod
    def _chars(intervals: DataFrame | None, shown: DataFrame) -> int:
        if intervals is None:
            return 0
        return intervals.join(shown, ["repo", "path"]).agg(F.coalesce(F.sum(F.length(_slice("ls", "line_start", "line_end"))), F.lit(0))).first()[0]

    def _knowledge(self, request: Request) -> DataFrame | None:
        if self.documents is None or not request.searches:
            return None
        out = None
        for q in request.searches:
            rows = lexical.knowledge_hits(self.documents, q["query"]).join(self.documents, "doc_id")
            content = _slice(split_lines(F.col("text")), "line_start", "line_end")
            rows = rows.select(F.lit("knowledge").alias("repo"), F.col("doc_id").cast("string").alias("path"), "line_start", "line_end", F.lit("knowledge").alias("kind"), "score", F.array(F.lit("knowledge")).alias("found_by"), content.alias("content"))
            out = rows if out is None else out.unionByName(rows)
        return cut(out.distinct())

    def _relationships(self, request: Request, hits: DataFrame, direct: DataFrame | None) -> DataFrame | None:
        if self.edges is None:
            return None
        told = [request.objective, *[q["query"] for q in (*request.searches, *request.paths)], *[s["name"] for s in request.symbols]]
        paths = hits.select("repo", "path").distinct()
        if direct is not None:
            paths = paths.unionByName(direct.select("repo", "path"))
        return cut(relationship_slice(self.edges, paths, asked_terms(told)))

    @staticmethod
    def _at_evidence(relationships: DataFrame) -> DataFrame:
        form = r"^([^:]+):(.+):(\d+)$"
        rows = relationships.select("kind", F.explode(F.array("source_evidence", "target_evidence")).alias("at")).where(F.col("at").rlike(form))
        part = lambda i: F.regexp_extract("at", form, i)
        return rows.select(part(1).alias("repo"), part(2).alias("path"), part(3).cast("int").alias("line"), F.lit("").alias("text"), F.lit("contract relationship").alias("kind"), F.lit(RELATION_SCORE).alias("score"), F.array(F.concat("kind", F.lit(" contract graph"))).alias("found_by"))

    def _calls(self, request: Request, hits: DataFrame) -> DataFrame:
        out = self.blobs.sparkSession.createDataFrame([], "symbol string, callee string")
        for s in request.symbols:
            if "callees" in (s.get("include") or ()):
                found = hits.where(F.col("asked") == f"callees:{s['name']}")
                out = out.unionByName(lexical.callees(self._scope(s.get("repos")), self.blobs, s["name"], found=found).select(F.lit(s["name"]).alias("symbol"), "callee"))
        return out

    def _unresolved(self, request: Request, hits: DataFrame, direct: DataFrame | None, calls: DataFrame) -> DataFrame:
        """The parts of the request for which nothing was found; callers and callees by what they are, not by a definition alone."""
        asked = self.blobs.sparkSession.createDataFrame([(f"{k}:{v}",) for k, v in self._asked(request)], "asked string")
        traced = F.startswith("asked", F.lit("callers:")) | F.startswith("asked", F.lit("callees:"))
        got = hits.where(~traced | F.startswith("asked", F.lit("callers:")) & (F.col("kind") == "caller")).select("asked")
        got = got.unionByName(calls.select(F.concat(F.lit("callees:"), "symbol").alias("asked")))
        if direct is not None:
            got = got.unionByName(direct.select("asked"))
        return asked.distinct().join(got.distinct(), "asked", "left_anti")

    @staticmethod
    def _asked(request: Request) -> list[tuple[str, str]]:
        """Every part that the request names."""
        out = [("search", q["query"]) for q in request.searches] + [("path", p["query"]) for p in request.paths]
        out += [(k, s["name"]) for s in request.symbols for k in s.get("include") or ["definition"]]
        out += [("file", f"{f.get('repo')}:{f['path']}") for f in request.files] + [("history", h["query"]) for h in request.history]
        return out + [("expand", c) for c in request.expand]


def _slice(lines, start: str, end: str):
    return F.array_join(F.slice(lines, F.col(start), F.greatest(F.col(end) - F.col(start) + 1, F.lit(0))), "\n")


def _any(*tables: DataFrame | None) -> DataFrame | None:
    """One row for each row of the given tables, of which only whether there are any counts."""
    out = None
    for t in tables:
        if t is not None:
            rows = t.select(F.lit(1).alias("all"))
            out = rows if out is None else out.unionByName(rows)
    return out
