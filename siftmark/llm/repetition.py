"""Repetition inside a single document.

The share of a text is the part of its characters that lies in second or later copies:
of runs of five or more words found earlier in the text, or of short pieces repeated
back to back many times. Words are runs of letters in lower case, so copies that
differ only in case, digits, spacing or punctuation are copies.

To find the texts above a share, cheap rules bound it first. Each task measures the
rules' cost, with what they share found once, and the part of texts they settle on its
first rows and then runs them in the order of texts settled per second; only what no
rule settles is measured in full.
The order changes the time, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.runtime import ship

#: Words of a run.
RUN_WORDS = 5
#: How often a short piece has to stand back to back.
PIECE_TIMES = 8
#: Periods up to that are compared directly; longer ones are found by hashes of windows. Both ways are exact.
DIRECT_CHARS = 32
#: The share from which a document counts as repetitive.
THRESHOLD = 1 / 3
#: Texts on which a task measures its rules.
TRIAL_TEXTS = 256
#: Characters handled at once.
BATCH_CHARS = 2_000_000


def _words():
    import re

    return re.compile(r"[^\W\d_]+").finditer


_letters = None


def _is_letter(chars: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, in the sense of ``_words``."""
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        for m in _words()("".join(map(chr, range(0x110000)))):
            _letters[m.start() : m.end()] = True
    return _letters[chars]


class Batch:
    """Some texts as flat arrays; words are found only when a rule asks for them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self._spans = None
        self._chars = self._pieces = self._runs = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word form, text, start, end) of every word; starts count within all texts joined."""
        if self._spans is None:
            find, index = _words(), {}
            forms, text, start, end = [], [], [], []
            base = 0
            for i, t in enumerate(self.texts):
                n = 0
                low = t.lower()
                exact = len(low) == len(t)  # a few letters change length
                for m in find(t):
                    a, b = m.span()
                    w = low[a:b] if exact else t[a:b].lower()
                    forms.append(index.setdefault(w, len(index)))
                    start.append(base + a)
                    end.append(base + b)
                    n += 1
                text.append(n)
                base += len(t)
            self._spans = (np.array(forms, np.int64), np.repeat(np.arange(len(text)), text), np.array(start, np.int64), np.array(end, np.int64))
        return self._spans

    def chars(self) -> np.ndarray:
        """Code points of all texts joined, in lower case, every digit as 0."""
        if self._chars is None:
            joined = "".join(t.lower() if len(t.lower()) == len(t) else t for t in self.texts)
            c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            self._chars = np.where((c >= 48) & (c <= 57), 48, c)
        return self._chars

    def pieces(self) -> np.ndarray:
        """``covered_by_pieces``, found once."""
        if self._pieces is None:
            self._pieces = covered_by_pieces(self)
        return self._pieces

    def runs(self) -> np.ndarray:
        """``covered_by_runs``, found once."""
        if self._runs is None:
            self._runs = covered_by_runs(self)
        return self._runs

    def part(self, rows: np.ndarray) -> Batch:
        """The texts ``rows`` (ascending), with all that is known of them."""
        if len(rows) == len(self.texts):
            return self
        out = Batch([self.texts[i] for i in rows])
        kept = np.zeros(len(self.texts), bool)
        kept[rows] = True
        if self._spans is not None:
            form, text, start, end = self._spans
            shift = np.zeros(len(self.texts), np.int64)
            shift[rows] = (np.cumsum(out.sizes) - out.sizes) - (np.cumsum(self.sizes) - self.sizes)[rows]
            own = kept[text]
            text = text[own]
            out._spans = (form[own], (np.cumsum(kept) - 1)[text], start[own] + shift[text], end[own] + shift[text])
        chars = np.repeat(kept, self.sizes)
        for name in ("_chars", "_pieces", "_runs"):
            known = getattr(self, name)
            if known is not None:
                setattr(out, name, known[chars])
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _again(keys: np.ndarray) -> np.ndarray:
    """Where a key has stood before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.asarray(b).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def covered_by_runs(batch: Batch, run: int = RUN_WORDS) -> np.ndarray:
    """Marks for every character: it lies in a run of ``run`` words that stood earlier in its text."""
    form, text, start, end = batch.words()
    mark = np.zeros(int(batch.sizes.sum()) + 1, np.int64)
    n = len(form) - run + 1
    if n > 0:
        whole = text[:n] == text[run - 1 :]
        key = _mix(form[:n], text[:n])
        for i in range(1, run):
            key = _mix(key, form[i : n + i])
        at = np.flatnonzero(whole)
        at = at[_again(key[at])]
        # from the first letter of a run to the next word, so that what stands between two words of a copy counts
        base = np.cumsum(batch.sizes)
        last = at + run - 1
        following = np.where((last + 1 < len(form)) & (text[np.minimum(last + 1, len(form) - 1)] == text[last]), start[np.minimum(last + 1, len(form) - 1)], base[text[last]])
        np.add.at(mark, start[at], 1)
        np.add.at(mark, following, -1)
    return np.cumsum(mark[:-1]) > 0


def covered_by_pieces(batch: Batch, times: int = PIECE_TIMES, direct: int = DIRECT_CHARS) -> np.ndarray:
    """Marks for every character: it lies in the second or a later one of ``times`` or more equal pieces, back to back.

    Pieces of any length. Those of more than ``direct`` characters that hold the start of
    a word are runs of words found earlier, which ``covered_by_runs`` marks from the second
    copy on; the others stand within one stretch of letters or of other characters, and
    only stretches long enough for ``times`` of them are searched.
    """
    c, owner = batch.chars(), batch.owner()
    covered = np.zeros(len(c), bool)
    ends = np.cumsum(batch.sizes)
    for period in range(1, direct + 1):
        if len(c) <= period * times:
            break
        for i in np.unique(owner[_likely(c, period, times)]):
            a, b = ends[i] - batch.sizes[i], ends[i]
            same = c[a + period : b] == c[a : b - period]
            edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
            begin, stop = edge[::2], edge[1::2]
            long = stop - begin >= period * (times - 1)
            for x, y in zip(begin[long], stop[long]):
                covered[a + x + period : a + y + period] = True
    if len(c) > direct * times:
        letter = _is_letter(c)
        border = np.flatnonzero((letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1])) + 1
        begin, stop = np.r_[0, border], np.r_[border, len(c)]
        for a, b in zip(begin, stop) if (stop - begin).max() > direct * times else ():
            if b - a > direct * times:
                _mark_periods(c[a:b], covered[a:b], times, direct)
    return covered


def _likely(c: np.ndarray, period: int, times: int) -> np.ndarray:
    """Places, at least one in every run of ``times`` pieces of ``period``; few others.

    Such a run has ``period * (times - 1)`` or more characters in a row that equal the one
    a period further on. So one of them stands at a multiple of that number, and there half of as many
    follow or go before it.
    """
    step = period * (times - 1)
    at = np.arange(0, len(c) - period, step)
    at = at[c[at] == c[at + period]]
    half = min((step + 1) // 2, 12)
    on, back = at, at
    for j in range(1, half):
        on = on[on + j + period < len(c)]
        on = on[c[on + j] == c[on + j + period]]
        back = back[back >= j]
        back = back[c[back - j] == c[back - j + period]]
    return np.union1d(on, back)


def _mark_periods(c: np.ndarray, covered: np.ndarray, times: int, least: int) -> None:
    """Mark what repeats with a period above ``least``, ``times`` or more, by hashes of windows that double in size.

    Of a run with the period p, a window of p to 2p characters stands next exactly p
    further on, as no shorter period fits. So for each size of window the distances to
    its next place tell all runs whose period is at most the size and over half of it.
    Only windows whose halves stand twice can stand twice, so few are left soon.
    """
    n, size = len(c), 1
    key = _mix(c, 1)
    while size <= least:
        key = _mix(key[:-size], key[size:])
        size *= 2
    at = np.arange(len(key))
    while len(at) and size * (times - 1) <= 2 * n:
        order = np.lexsort((at, key[at]))
        where, keys = at[order], key[at][order]
        twice = keys[1:] == keys[:-1]
        step = np.zeros(len(key), np.int64)
        step[where[:-1][twice]] = (where[1:] - where[:-1])[twice]
        edge = np.flatnonzero(np.diff(step)) + 1
        begin, stop = np.r_[0, edge], np.r_[edge, len(step)]
        period = step[begin]
        length = stop - begin + size + period - 1
        for a, p, m in zip(*(x[(period > max(least, size // 2)) & (period <= size) & (length >= times * period)] for x in (begin, period, length))):
            covered[a + p : a + m] = True
        both = np.zeros(len(key), bool)
        both[where[1:][twice]] = both[where[:-1][twice]] = True
        if n <= 2 * size:
            break
        key = _mix(key[:-size], key[size:])
        at = np.flatnonzero(both[: len(key)] & both[size : size + len(key)])
        size *= 2


def _share(batch: Batch) -> np.ndarray:
    total = np.bincount(batch.owner(), weights=batch.runs() | batch.pieces(), minlength=len(batch.sizes))
    return total / np.maximum(batch.sizes, 1)


def repeated_share(texts: list[str]) -> np.ndarray:
    """The share of every text; 0 for an empty one."""
    return _share(Batch(texts))


def _too_short(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """A text shorter than the least one that can repeat has no share."""
    small = batch.sizes < min(PIECE_TIMES, 2 * RUN_WORDS)
    return np.zeros(len(small)), np.where(small, 0.0, 1.0)


def _word_bound(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Runs can cover only words that stand twice; a text whose words are nearly all new has a small share of them."""
    form, text, start, end = batch.words()
    n = len(batch.sizes)
    twice = _again(_mix(form, text))
    base = np.cumsum(batch.sizes)
    following = np.r_[start[1:], 0]
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    following = np.where(last, base[text] if len(text) else 0, following)
    words = np.bincount(text, weights=np.where(twice, following - start, 0), minlength=n)
    lower, _ = _pieces_alone(batch)
    return lower, np.minimum(words / np.maximum(batch.sizes, 1) + lower, 1.0)


def _pieces_alone(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The share of short pieces alone is a lower bound."""
    lower = np.bincount(batch.owner(), weights=batch.pieces(), minlength=len(batch.sizes)) / np.maximum(batch.sizes, 1)
    return lower, np.ones(len(lower))


def _runs_alone(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The share of runs alone is a lower bound."""
    lower = np.bincount(batch.owner(), weights=batch.runs(), minlength=len(batch.sizes)) / np.maximum(batch.sizes, 1)
    return lower, np.ones(len(lower))


Rule = Callable[[Batch], tuple[np.ndarray, np.ndarray]]
#: Each gives a lower and an upper bound of the share.
RULES: dict[str, Rule] = {"short": _too_short, "words": _word_bound, "pieces": _pieces_alone, "runs": _runs_alone}


#: What each rule finds, or takes over from rules before it.
NEEDS = {"short": (), "words": ("words", "pieces"), "pieces": ("pieces",), "runs": ("words", "runs")}


class Cascade:
    """The rules in the order of texts settled per second, as measured on the first texts it sees."""

    def __init__(self, threshold: float = THRESHOLD, rules: dict[str, Rule] | None = None, trial: int = TRIAL_TEXTS):
        self.threshold, self.rules, self.trial, self.order = threshold, rules or RULES, trial, None

    def _settled(self, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = bounds
        return lower >= self.threshold, upper < self.threshold - 1e-9

    def plan(self, texts: list[str]) -> list[str]:
        """Order the rules by texts settled per second on some texts: the best one first, then the best for what it leaves.

        Rules share what they find (words, pieces, runs): each part is found and timed once
        and counts only for the first rule that needs it. A rule that settles fewer texts a
        second than the full measure would is left out.
        """
        batch, cost = Batch(texts), {}
        for part in ("words", "pieces", "runs"):
            began = time.perf_counter()
            getattr(batch, part)()
            cost[part] = time.perf_counter() - began
        settled, own = {}, {}
        for name, rule in self.rules.items():
            began = time.perf_counter()
            yes, no = self._settled(rule(batch))
            own[name], settled[name] = time.perf_counter() - began, yes | no
        order: list[str] = []
        open_, known = np.ones(len(texts), bool), set()
        price = lambda parts, more: sum(cost[p] for p in set(parts) - known) + more + 1e-9
        while open_.any():
            rate = {n: (settled[n] & open_).sum() / price(NEEDS.get(n, cost), own[n]) for n in self.rules if n not in order}
            name = max(rate, key=lambda n: (rate[n], n), default=None)
            if name is None or rate[name] <= open_.sum() / price(cost, 0.0):
                break
            order.append(name)
            known |= set(NEEDS.get(name, cost))
            open_ &= ~settled[name]
        return order

    def decide(self, texts: list[str]) -> np.ndarray:
        """For every text whether its share reaches the threshold."""
        if self.order is None:
            self.order = self.plan(texts[: self.trial])
        found = np.zeros(len(texts), bool)
        left = np.arange(len(texts))
        batch = Batch(texts)
        for name in self.order:
            if not len(left):
                break
            yes, no = self._settled(self.rules[name](batch))
            found[left[yes]] = True
            open_ = np.flatnonzero(~(yes | no))
            left, batch = left[open_], batch.part(open_)
        if len(left):
            found[left] = _share(batch) >= self.threshold
        return found


def _by_size(texts: list[str]) -> Iterator[slice]:
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > BATCH_CHARS:
            yield slice(at, i)
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _apply(df: DataFrame, text: str, name: str, kind: str, maker: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    keep = [c for c in df.columns if c.lower() not in (text.lower(), name.lower())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = maker()
        for batch in batches:
            texts = ["" if t is None or t != t else t for t in batch[text]]
            values = [use(texts[s]) for s in _by_size(texts)]
            out = batch[keep].copy()
            out[name] = np.concatenate(values) if values else []
            yield out

    ship(df.sparkSession)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(text).cast("string").alias(text)).mapInPandas(run, ", ".join([*fields, f"`{name}` {kind}"]))


def with_share(df: DataFrame, text: str = "text", *, share: str = "repeated_share") -> DataFrame:
    """``df`` with the repeated share of ``text`` in its place; 0 for a null or empty text. No shuffle; whole texts."""
    return _apply(df, text, share, "double", lambda: repeated_share)


def with_flag(df: DataFrame, text: str = "text", *, threshold: float = THRESHOLD, flag: str = "repetitive") -> DataFrame:
    """``df`` with whether the repeated share of ``text`` reaches ``threshold``, in its place, by the cascade of rules.

    The same as comparing ``with_share``; null and empty texts are not repetitive.
    """
    return _apply(df, text, flag, "boolean", lambda: Cascade(threshold).decide)
