"""Scalar functions over text, paths and vectors, all built from expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in tickets and commit subjects.
STOP_WORDS = (
    "add and api app application build change code config create develop feature file fix for from java main merge "
    "service src test tests the this update with"
).split()
# File suffixes and the language each one stands for.
LANGUAGES = {
    "java": "Java", "kt": "Kotlin", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "sql": "SQL",
    "sh": "Shell", "yaml": "YAML", "yml": "YAML", "json": "JSON", "xml": "XML", "md": "Markdown", "properties": "Properties", "tf": "Terraform", "css": "CSS",
}
TICKET = r"[A-Z][A-Z0-9]+-[0-9]+"
# Marks around matches: the first two characters of the private use area.
_OPEN, _CLOSE = "\ue000", "\ue001"
# What marks a path as a test, and the suffixes of configuration.
TEST_PATH = r"(?i)(^|/)(test|tests|src/test)/|(?:Test|Tests|IT|Spec)\."
CONFIG_SUFFIXES = ("conf", "gradle", "json", "properties", "toml", "xml", "yaml", "yml")


def unified(text: Column) -> Column:
    r"""Text with every line end as ``\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """The lines of a text; the nothing after a last line end is no line, an empty text has none."""
    body = F.regexp_replace(text, r"(?:\r\n?|\n)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n?|\n", -1))


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of the character at ``offset`` (from 0)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def places(text: Column, pattern: str) -> Column:
    """Every match of a Java expression in a text: (line, match, before), with the 300 characters before it.

    Marks are set around the matches and the text is cut at them, so nothing leaves the
    JVM. The two private-use characters of the marks may not occur in the text; they
    are taken out first. Line ends are unified.
    """
    clean = F.translate(unified(text), _OPEN + _CLOSE, "")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)
    breaks = lambda c: F.length(c) - F.length(F.translate(c, "\n", ""))
    start = F.struct(F.lit(1).alias("line"), F.lit("").alias("tail"), F.array().cast("array<struct<line:int,match:string,before:string>>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        marked = F.contains(part, F.lit(_CLOSE))
        plain = F.translate(part, _CLOSE, "")
        out = F.when(marked, F.concat(a["out"], F.array(F.struct(a["line"].alias("line"), match.alias("match"), a["tail"].alias("before"))))).otherwise(a["out"])
        return F.struct((a["line"] + breaks(plain)).alias("line"), F.right(F.concat(a["tail"], plain), F.lit(300)).alias("tail"), out.alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a name that begins with its only dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix in lower case without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def language(path: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, suffix(path)), F.lit("Text"))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_config(path: Column) -> Column:
    return suffix(path).isin(*CONFIG_SUFFIXES)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a text of under three characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=([\s\S]{3}))[\s\S]"), F.lit(1)))


def terms(text: Column) -> Column:
    """Distinct identifier words: camel case split, three characters or more, lower case, without stop words, sorted."""
    spread = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(spread, F.lit(r"[A-Za-z][A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS])))


def ticket_ids(text: Column) -> Column:
    """Distinct ticket ids in a text, in order of their first place; none beside other capitals or digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![A-Z0-9])({TICKET})(?![A-Z0-9])"), F.lit(1)))


def overlap_score(a: Column, b: Column) -> Column:
    """The sum of the lengths of common terms, each counted as 12 at most."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(F.lit(12), F.length(t)))


def route(path: Column) -> Column:
    """A route with anonymous parameters, single slashes, one leading and no trailing slash."""
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), r"\{[^}]*\}", "{}"), "/+", "/")
    return F.when(plain == "/", plain).otherwise(F.regexp_replace(plain, "/$", ""))


def service_name(name: Column) -> Column:
    """A service's name as it compares: lower case letters and digits, without one ``service`` at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "service$", "")


def safe_name(name: Column) -> Column:
    """A name as a path component: other characters than letters, digits, ``.``, ``_`` and ``-`` become ``-``."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")


def ssh_endpoint(remote: Column) -> Column:
    """``user@host:port`` of an SSH remote, in URL or in scp form, the host in lower case; null for any other."""
    url = r"^(?:ssh|git\+ssh)://(?:([^@/:]+)(?::[^@/]*)?@)?([^@/:]+)(?::(\d+))?(?:/.*)?$"
    short = r"^(?:([^@/:]+)@)?([^/:@]+):.+$"
    part = lambda p, i: F.regexp_extract(remote, p, i)
    at = lambda p: F.when(part(p, 1) != "", F.concat(part(p, 1), F.lit("@"))).otherwise("")
    port = F.when(part(url, 3) != "", F.concat(F.lit(":"), part(url, 3))).otherwise("")
    return (
        F.when(remote.rlike(url), F.concat(at(url), F.lower(part(url, 2)), port))
        .when(remote.contains("://") | remote.rlike(r"^[A-Za-z]:[\\/]"), F.lit(None))
        .when(remote.rlike(short), F.concat(at(short), F.lower(part(short, 2))))
    )


def cut_text(text: Column, size: int) -> Column:
    """A text in pieces of at most ``size`` characters, each cut behind the last line end of its second half, if there is one.

    One expression with bounded quantifiers consumes a piece at a time; the pieces joined are the text, an empty text is one empty piece.
    """
    if size < 1:
        raise ValueError("the size of a piece has to be positive")
    # a line end at position size // 2 or later closes the piece behind it
    lines = rf"[\s\S]{{{size // 2},{size - 1}}}\n" if size > 1 else r"\n"
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"\G(?:[\s\S]{{1,{size}}}\z|{lines}|[\s\S]{{{size}}})"), F.lit(0)))


def version_key(version: Column) -> Column:
    """A version's numbers as an array, which compares like the version."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector is null, empty or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero byte between; null counts as a part of its own."""
    shown = [F.coalesce(p.cast("string"), F.lit("\x01null")) for p in parts]
    joined = shown[0]
    for p in shown[1:]:
        joined = F.concat(joined, F.lit("\x00"), p)
    return F.sha2(joined, 256)
