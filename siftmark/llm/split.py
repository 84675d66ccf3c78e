"""Oversized code cut into pieces at natural places, with overlap, by one bounded regular expression.

The expression consumes a piece at a time. Its alternatives are ordered by the strength
of the place where the piece ends: end of the text, a blank line before something that
is not indented, any blank line, a closing bracket, the end of a line, a space or
separator within an over-long line, any character. Bounded quantifiers hold the limits:
so many lines, and by a bounded look-back to the start of the match so many characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2048
MAX_LINES = 80
OVERLAP_LINES = 5
#: Characters kept free for the overlap.
OVERLAP_CHARS = 512
#: Pieces in which the overlap is looked for before the whole text is.
NEAR = 4


def card_code(card: Column) -> Column:
    """All that follows the first line ``Code:``; null for a null card and one without that line."""
    text = F.concat(F.lit("\n"), card)
    at = F.locate("\nCode:\n", text)
    return F.when(at > 0, F.substring(text, at + 7, F.length(text)))


def line_count(text: Column) -> Column:
    r"""Lines end with ``\n``; a last line without one counts, nothing after a last ``\n`` does not."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return breaks + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def piece_pattern(chars: int, lines: int) -> str:
    """The expression for new text of at most ``chars`` characters and ``lines`` lines.

    Where ``lines`` lines come before ``chars`` characters (tested once, by look-ahead),
    quantified lines are given back until a boundary fits; elsewhere quantified
    characters are. The last alternatives cut an over-long line.
    """
    line = rf"[^\n]{{0,{chars}}}+\n"
    short = rf"(?=(?:{line}){{1,{lines}}}+(?<=\G[\s\S]{{1,{chars}}}))"
    pad = min(64, chars // 4)  # blanks of a blank line
    blank, bracket = rf"[ \t]{{0,{pad}}}+\r?\n", rf"[}}\])][;,]?[ \t]{{0,{min(8, pad)}}}+\r?\n"

    def times(what: str, low: int, high: int, then: str = "") -> list[str]:
        """``what`` so many times and ``then``; nothing where no number is left."""
        return [rf"{what}{{{low},{high}}}{then}"] if 0 <= low <= high and high else []

    lines_, some = rf"(?:{line})", r"[\s\S]"
    least = max(1, lines // 3)
    by_line = [
        *times(lines_, 1, lines, r"\z"),
        *times(lines_, 1, lines - 1, rf"[^\n]{{1,{chars}}}\z(?<=\G[\s\S]{{1,{chars}}})"),
        *times(lines_, least, lines - 1, rf"{blank}(?=\S)"),
        *times(lines_, least, lines - 1, blank),
        *times(lines_, least, lines, rf"(?<=[}}\])][;,]?[ \t]{{0,{min(8, pad)}}}\r?\n)"),
        *times(lines_, 1, lines),
    ]
    least, room = chars // 3, chars - pad - 16
    by_char = [
        *times(some, 1, chars, r"\z"),
        *times(some, least, room, rf"\n{blank}(?=\S)"),
        *times(some, least, room, rf"\n{blank}"),
        *times(some, least, room, bracket),
        *times(some, 0, chars - 1, r"\n"),
        *times(r"[^\n]", chars // 2, chars - 1, r"[\s;,{}()\[\]>]"),
        *times(r"[^\n]", 1, chars),
        r"\n",
    ]
    return rf"\G(?:{short}(?:{'|'.join(by_line)})|{'|'.join(by_char)})"


def split_text(df: DataFrame, text: str, *, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """The rows of ``df`` with ``piece_no`` (from 1), ``pieces``, ``first_line``, ``last_line`` and ``piece`` in place of ``text``.

    Every piece has at most ``max_chars`` code points and ``max_lines`` lines and, but
    for the first, begins with the last ``overlap_lines`` lines of the one before, or as
    many whole ones as still fit. A text within the limits is one piece, an empty one
    an empty piece; a null text gives no row. Lines count from 1 within the text.
    Without the overlaps the pieces of a text are the text. Runs in the JVM only.
    """
    overlap_lines = min(overlap_lines, max_lines // 2)
    chars, lines = max_chars - min(overlap_chars, max_chars // 2), max_lines - overlap_lines
    whole = (F.length(text) <= max_chars) & (line_count(F.col(text)) <= max_lines)
    cut = F.regexp_extract_all(F.col(text), F.lit(piece_pattern(chars, lines)), F.lit(0))
    body = F.when(whole, F.array(F.col(text))).otherwise(cut)
    breaks = lambda c: F.length(c) - F.length(F.translate(c, "\n", ""))

    def overlap(news: Column, new: Column, at: Column, i: Column) -> Column:
        """Whole lines, each after a line break, of the text just before the piece as far as there is room."""
        if not overlap_lines:
            return F.lit("")
        pieces_ = F.array_join(F.slice(news, F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR))), "")
        whole = rf"\n((?:[^\n]*+\n){{1,{overlap_lines}}}+)\z"

        def lines_before(room: Column, near: Column) -> Column:
            # the pieces before are nearly always enough; where they are not, the text is
            start = F.when(i <= NEAR, F.concat(F.lit("\n"), near)).when(F.length(near) > room, near).otherwise(F.concat(F.lit("\n"), F.substring(F.col(text), F.lit(1), at)))
            return F.regexp_extract(F.substring(start, -room - 1, room + 1), whole, 1)

        return _let(F.least(F.lit(max_chars) - F.length(new), at), lambda room: F.when(room > 0, _let(pieces_, lambda near: lines_before(room, near))).otherwise(""))

    def piece(news: Column, new: Column, at: Column, line: Column, i: Column) -> Column:
        return _let(overlap(news, new, at, i), lambda over: F.struct((i + 1).alias("no"), (line - breaks(over) + 1).alias("first"), F.concat(over, new).alias("piece")))

    def pieces(news: Column) -> Column:
        return _let(_running(F.transform(news, F.length)), lambda at: _let(_running(F.transform(news, breaks)), lambda line: F.transform(news, lambda new, i: piece(news, new, F.get(at, i), F.get(line, i), i))))

    made = _let(body, pieces)
    keep = [c for c in df.columns if c.lower() not in (text.lower(), "piece_no", "pieces", "first_line", "last_line", "piece")]
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.explode(_let(made, lambda m: F.transform(m, lambda p: F.struct(p.alias("p"), F.size(m).alias("n"))))).alias("__x"))
    last = F.col("__x.p.first") + F.greatest(line_count(F.col("__x.p.piece")), F.lit(1)) - 1
    return rows.select(*keep, F.col("__x.p.no").alias("piece_no"), F.col("__x.n").alias("pieces"), F.col("__x.p.first").alias("first_line"), last.alias("last_line"), F.col("__x.p.piece").alias("piece"))


def _running(values: Column, block: int = 256) -> Column:
    """For each number of an array the sum of those before it, by sums of blocks, so that work hardly grows faster than the array."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    sums = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))
    before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
    inside = lambda v, i: total(F.slice(v, i - i % block + 1, i % block))
    placed = lambda v, starts: F.transform(v, lambda _, i: F.get(starts, F.floor(i / block).cast("int")) + inside(v, i))
    return _let(values, lambda v: _let(_let(sums(v), before), lambda starts: placed(v, starts)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def oversized_pieces(chunks: DataFrame, **limits: int) -> DataFrame:
    """(chunk_id, piece_no, pieces, start_line, end_line, symbol, piece) of every chunk whose code exceeds a limit.

    Repeated rows of a chunk count once; of different rows under one chunk_id the one
    with the least start line and card counts. Lines continue ``start_line`` of the
    chunk; where that is null the pieces have null lines. A null symbol stays null.
    """
    code = card_code(F.col("card"))
    rows = chunks.select("chunk_id", "symbol", "start_line", code.alias("code")).where(
        (F.length("code") > limits.get("max_chars", MAX_CHARS)) | (line_count(F.col("code")) > limits.get("max_lines", MAX_LINES))
    )
    rows = rows.groupBy("chunk_id").agg(F.min(F.struct("start_line", "symbol", "code")).alias("r")).select("chunk_id", "r.*")
    cut = split_text(rows, "code", **limits)
    line = lambda c: F.col("start_line") + F.col(c) - 1
    return cut.select("chunk_id", "piece_no", "pieces", line("first_line").alias("start_line"), line("last_line").alias("end_line"), "symbol", "piece")
