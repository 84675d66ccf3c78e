"""Bounded results as text: the facts of repositories, relationships, cases and what a request found.

Tables of lines are made where the data are; only what has a stated limit is collected and put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paths shown of a case, and those of tests or configuration.
CASE_PATHS, CASE_TESTS = 30, 12


def fact_lines(repositories: DataFrame, facts: DataFrame, maven: DataFrame) -> DataFrame:
    """(repo, n, text): for every repository its heading, description, framework facts and dependencies as numbered lines.

    ``facts`` has at most some hundred lines of a repository already; lines of repositories that are not listed are left out.
    """
    names = repositories.select("repo").distinct()
    line = lambda rows, part, text, a="", b=0: rows.select("repo", F.lit(part).alias("part"), F.lit(a).alias("a") if isinstance(a, str) else a.alias("a"), F.lit(b).alias("b") if isinstance(b, int) else b.alias("b"), text.alias("text"))
    shown = facts.select("repo", "path", "line", F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` — `"), F.trim("text"), F.lit("`")).alias("text")).join(names, "repo", "left_semi")
    needs = maven.where(F.col("kind") == "maven-consumer").select("repo", F.concat(F.lit("- `"), "key", F.lit("`")).alias("text")).distinct().join(names, "repo", "left_semi")
    none = lambda part, have: line(names.join(have.select("repo").distinct(), "repo", "left_anti"), part, F.lit("- none"))
    parts = [
        line(names, 1, F.concat(F.lit("## "), "repo")), line(repositories.where(F.col("description").isNotNull()), 2, F.col("description")),
        line(names, 3, F.lit("### Framework facts")), line(shown, 4, F.col("text"), F.col("path"), F.col("line")), none(4, shown),
        line(names, 5, F.lit("### Dependencies")), line(needs, 6, F.col("text"), F.col("text")), none(6, needs),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy("part", "a", "b")).alias("n"), "text")


def relationship_lines(edges: DataFrame) -> DataFrame:
    """(text): one line for every edge, with its proofs and confidence, in the order of the edges."""
    row = F.concat("source", F.lit(" --"), "kind", F.lit("("), "key", F.lit(")--> "), "target", F.lit(" ["), "confidence", F.lit("] | source "), "source_evidence", F.lit(" | target "), "target_evidence")
    return edges.orderBy("source", "target", "kind", "key", "source_evidence", "target_evidence").select(row.alias("text"))


def case_lines(cases: DataFrame) -> DataFrame:
    """(ticket, text): a short description of every case, with a stated number of its paths, in the order of the cases."""
    some = lambda c, n: F.concat(F.array_join(F.slice(c, 1, n), ", "), F.when(F.size(c) > n, F.concat(F.lit(" and "), (F.size(c) - n).cast("string"), F.lit(" more"))).otherwise(""))
    told = [("Repositories: ", F.array_join("repos", ", ")), ("Subjects: ", F.array_join("subjects", "; ")), ("Changed: ", some("paths", CASE_PATHS)), ("Tests: ", some("test_paths", CASE_TESTS)), ("Configuration: ", some("config_paths", CASE_TESTS))]
    text = F.concat_ws("\n", F.concat(F.lit("### "), "ticket", F.lit(" ("), F.coalesce("latest_date", F.lit("?")), F.lit(")")), *[F.concat(F.lit(name), value) for name, value in told])
    return cases.select("ticket", text.alias("text"))


def context_text(parts: dict[str, DataFrame], objective: str = "", *, max_chars: int = 180_000) -> str:
    """What ``Engine.retrieve`` found as one text: evidence with places, relationships, calls, history, cases, what is open, other candidates.

    All parts are bounded by the engine's limits. An evidence that would pass ``max_chars`` is named without its content.
    """
    out = [f"# {objective}" if objective else "# Context", ""]
    used = 0
    for i, e in enumerate(parts["evidence"].collect(), 1):
        out.append(f"### {i}. {e.repo} — `{e.path}:{e.line_start}-{e.line_end}` ({e.kind}, {e.score:g}, {', '.join(e.found_by)})")
        if used + len(e.content) <= max_chars:
            out += ["```", e.content, "```"]
            used += len(e.content)
        else:
            out.append("(left out for its size)")
        out.append("")
    for title, lines in (
        ("Relationships", [r.text for r in relationship_lines(parts["relationships"]).collect()] + [f"{r.symbol} calls {r.callee}" for r in parts["calls"].orderBy("symbol", "callee").collect()]),
        ("History", [f"{r.repo}:{r.path}:{r.line} {r.text.strip()}" for r in parts["history"].orderBy("repo", "path").collect()]),
        ("Similar cases", [f"{r.ticket} ({r.score})" for r in parts["cases"].orderBy(F.col("score").desc(), "ticket").collect()]),
        ("Not found", [r.asked for r in parts["unresolved"].orderBy("asked").collect()]),
        ("Other candidates", [f"{r.candidate} {r.repo}:{r.path}:{r.line} ({r.kind}, {r.score:g})" for r in parts["omitted"].collect()]),
    ):
        if lines:
            out += [f"## {title}", "", *[f"- {x}" for x in lines], ""]
    return "\n".join(out).rstrip() + "\n"
