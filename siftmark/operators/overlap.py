"""The nearest rows by the weight of common terms: blocks of rows that ask against shards of rows that answer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.runtime import cut

# The most a term weighs, rows and terms of a pack, of a shard and rows of a block, blocks above which these grow, and bytes for the terms of a shard that are kept as rows of weights.
WEIGHT, PACK, SHARD, BLOCK, BLOCKS, DENSE_BYTES = 12, (16_384, 2_000_000), (65_536, 8_000_000), 16_384, 16, 64 << 20
# Fixed values of a search: terms whose weights fit a byte, terms added between two looks, rows that give a bound, and rows looked up at once.
BYTE_TERMS, STEP, SEEDS, LOOKED_UP = 255 // WEIGHT, 16, 16, 160


def packed(lists: DataFrame, key: str) -> DataFrame:
    """(pack, rows, size, keys, sizes, words, ids): rows of ``key`` and ``terms`` put together, some thousands a row, terms as numbers into ``words``.

    Each key once, with terms that are distinct; written down, as it is read once for each block or shard.
    """
    kind = lists.schema[key].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (("rows", T.IntegerType()), ("size", T.LongType()), ("keys", T.ArrayType(kind)), ("sizes", T.ArrayType(T.IntegerType())), ("words", T.ArrayType(T.StringType())), ("ids", T.BinaryType()))])
    rows = lists.select(F.col(key).alias("key"), "terms").mapInArrow(_packs, schema)
    return cut(rows.select(F.monotonically_increasing_id().alias("pack"), "*"))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, pa.ListArray]] = []
    rows = size = 0
    for batch in batches:
        keys, terms = batch.column("key"), batch.column("terms")
        sizes, at = pc.list_value_length(terms).to_numpy(zero_copy_only=False), 0
        while at < len(keys):
            n = max(1, min(PACK[0] - rows, int(np.searchsorted(np.cumsum(sizes[at:]), PACK[1] - size, "right"))))
            held.append((keys.slice(at, n), terms.slice(at, n)))
            rows, size, at = rows + n, size + int(sizes[at : at + n].sum()), at + n
            if rows >= PACK[0] or size >= PACK[1] or at < len(keys):
                yield _pack(held)
                held, rows, size = [], 0, 0
    if held:
        yield _pack(held)


def _pack(held: list[tuple[pa.Array, pa.ListArray]]) -> pa.RecordBatch:
    keys, terms = (pa.concat_arrays(list(x)) for x in zip(*held))
    flat = terms.flatten().dictionary_encode()
    sizes, ids = pc.list_value_length(terms), np.asarray(flat.indices).astype("<i4")
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    body = pa.array([zlib.compress(ids.astype("<u2" if len(flat.dictionary) < 1 << 16 else "<i4").tobytes(), 1)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int32()), pa.array([len(flat)], pa.int64()), one(keys), one(sizes.cast(pa.int32())), one(flat.dictionary.cast(pa.string())), body], ["rows", "size", "keys", "sizes", "words", "ids"])


def _spread(packs: list, parts: int) -> dict[int, int]:
    """The part of each pack, all parts about as large."""
    full, of = [0] * parts, {}
    for p in sorted(packs, key=lambda p: (-p.size, p.pack)):
        of[p.pack] = full.index(min(full))
        full[of[p.pack]] += p.size + p.rows
    return of


def nearest(asked: DataFrame, packs: DataFrame, limit: int, first_postings: int, direct_pairs: int) -> DataFrame:
    """(q, k, score): for each asking row of ``asked`` the ``limit`` rows of each shard of ``packs`` with the greatest score; both as ``packed`` gives them.

    Every pair of a block and a shard is a partition. No row is left out that can be among the nearest, see ``Shard.nearest``.
    """
    spark = packs.sparkSession
    kinds = [f.schema["keys"].dataType.elementType for f in (asked, packs)]
    schema = T.StructType([T.StructField("q", kinds[0]), T.StructField("k", kinds[1]), T.StructField("score", T.LongType())])
    there, asking = packs.select("pack", "rows", "size").collect(), asked.select("pack", "rows", "size").collect()
    if not there or not asking:
        return spark.createDataFrame([], schema)
    total = lambda x, n: sum(p[n] for p in x)
    shards = min(len(there), max(-(-total(there, "rows") // SHARD[0]), -(-total(there, "size") // SHARD[1]), 1))
    blocks = min(len(asking), max(min(-(-total(asking, "rows") // BLOCK), BLOCKS), -(-total(asking, "rows") // (BLOCK * BLOCKS)), -(-total(asking, "size") // (SHARD[1] * 4)), 1))
    shard_of, block_of = _spread(there, shards), _spread(asking, blocks)
    to = lambda of, others, place: spark.createDataFrame([(p, [place(x, y) for y in range(others)]) for p, x in of.items()], "pack long, units array<int>")
    sides = [
        side.join(F.broadcast(units), "pack").select(F.explode("units").alias("unit"), F.lit(asks).alias("asks"), F.col("keys") if asks else F.lit(None).cast(asked.schema["keys"].dataType).alias("keys"), F.lit(None).cast(packs.schema["keys"].dataType).alias("there") if asks else F.col("keys").alias("there"), "sizes", "words", "ids")
        for asks, side, units in ((True, asked, to(block_of, shards, lambda b, s: b * shards + s)), (False, packs, to(shard_of, blocks, lambda s, b: b * shards + s)))
    ]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column("asks")[i].as_py()
                rows[a].append((batch.column("keys" if a else "there")[i].values, np.asarray(batch.column("sizes")[i].values), batch.column("words")[i].values.to_pylist(), batch.column("ids")[i].as_py()))
        if rows[True] and rows[False]:
            shard = Shard(rows[False])
            for one in rows[True]:
                q, d, score = shard.nearest(one, limit, first_postings, direct_pairs)
                yield pa.RecordBatch.from_arrays([one[0].take(pa.array(q)), shard.keys.take(pa.array(d)), pa.array(score, pa.int64())], ["q", "k", "score"])

    both = sides[0].unionByName(sides[1])
    return both.repartitionById(shards * blocks, F.col("unit")).mapInArrow(search, schema)


def _numbers(body: bytes, words: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(body), "<u2" if words < 1 << 16 else "<i4").astype(np.int64)


class Shard:
    """Rows in the order of their keys, with the places of each term: rare ones as lists, frequent ones as a row of weights, a byte for each place."""

    def __init__(self, packs: list[tuple]) -> None:
        self.number: dict[str, int] = {}
        ids = np.concatenate([np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64)[_numbers(body, len(words))] if words else np.zeros(0, np.int64) for _, _, words, body in packs])
        keys, sizes = pa.concat_arrays([p[0] for p in packs]), np.concatenate([p[1] for p in packs])
        order = pc.array_sort_indices(keys, null_placement="at_start").to_numpy()
        self.keys, self.n = keys.take(pa.array(order)), len(keys)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.weight = np.array([min(WEIGHT, len(w)) for w in self.number], np.int64)
        self.count = np.bincount(ids, minlength=len(self.number))
        places = np.repeat(place, sizes)[np.argsort(ids, kind="stable")]
        ends = np.cumsum(self.count)
        self.lists = [places[e - c : e] for e, c in zip(ends.tolist(), self.count.tolist())]
        frequent = np.argsort(-self.count, kind="stable")[: max(1, DENSE_BYTES // max(1, self.n))]
        frequent = frequent[self.count[frequent] * 64 >= self.n]
        self.row = np.full(len(self.number), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.weights = np.zeros((len(frequent), self.n), np.uint8)
        for r, t in enumerate(frequent.tolist()):
            self.weights[r, self.lists[t]] = self.weight[t]
        self.by_place = np.ascontiguousarray(self.weights.T)

    def nearest(self, asked: tuple, limit: int, first_postings: int, direct_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asking row, place, score) of the ``limit`` greatest scores above 0 of each asking row, of equal ones those of the greater key.

        Terms are added up from the rarest on. After the first of them the rows ahead are looked up in
        full, which gives a score that the ``limit``-th row has at least. When what is left to add cannot
        lift more than a few rows to it, these are looked up and the others are out.
        """
        _, sizes, words, body = asked
        known = np.array([self.number.get(w, -1) for w in words], np.int64)
        ids = known[_numbers(body, len(words))] if len(words) else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
        ids = ids[ids >= 0]
        order = np.lexsort((ids, self.count[ids], who))
        ids, ends = ids[order], np.cumsum(np.bincount(who, minlength=len(sizes))).tolist()
        direct, begin, found = len(sizes) * self.n <= direct_pairs, 0, []
        kind = np.uint16 if (max(map(int, sizes), default=0) + 1) * WEIGHT < 1 << 16 else np.int64
        self.sums, self.part, self.marks = np.zeros(self.n, kind), np.zeros(self.n, np.uint8), np.zeros(-(-self.n // 8) * 8, bool)
        self.mark = self.marks[: self.n]
        for q, end in enumerate(ends):
            if end > begin:
                d, score = self._one(ids[begin:end], limit, first_postings, direct)
                found.append((np.full(len(d), q), d, score))
            begin = end
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _one(self, terms: np.ndarray, limit: int, first_postings: int, direct: bool) -> tuple[np.ndarray, np.ndarray]:
        sums, weight, rows = self.sums, self.weight[terms], self.row[terms]
        left = weight.sum() - np.cumsum(weight)
        sums[:] = 0
        # half of the weight at least, and all rare terms, since only frequent ones can be looked up
        until = max(1, int((rows < 0).sum()), int(np.searchsorted(np.cumsum(self.count[terms]), first_postings, "right")), int((left * 2 > weight.sum()).sum()))
        done, bound = 0, 0
        until = len(terms) if direct else min(until, len(terms))
        while True:
            self._add(terms[done:until].tolist(), weight[done:until].tolist(), rows[done:until].tolist())
            done, rest = until, int(left[until - 1])
            seeds = self._ahead(limit)
            if len(seeds) >= limit:
                bound = max(bound, int(np.partition(self._full(seeds, rows[done:]), -limit)[-limit]))
            least = max(bound - rest, 0 if rest else 1)
            np.greater_equal(sums, least, out=self.mark)
            if done == len(terms) or (least > 0 and np.count_nonzero(self.mark) <= LOOKED_UP):
                break
            until = min(done + STEP, len(terms))
        places = self._marked()
        score = self._full(places, rows[done:])
        top = np.lexsort((places, score))[::-1][:limit]
        top = top[score[top] > 0]
        return places[top], score[top]

    def _add(self, terms: list, weight: list, rows: list) -> None:
        """The weights of terms onto the sums, as many at once as fit a byte."""
        part = self.part
        for i in range(0, len(terms), BYTE_TERMS):
            part[:] = 0
            for t, w, r in zip(terms[i : i + BYTE_TERMS], weight[i : i + BYTE_TERMS], rows[i : i + BYTE_TERMS]):
                if r < 0:
                    part[self.lists[t]] += w
                else:
                    np.add(part, self.weights[r], out=part)
            np.add(self.sums, part, out=self.sums)

    def _ahead(self, limit: int) -> np.ndarray:
        """Some of the rows with the greatest sums, ``limit`` of them where there are as many above 0."""
        low, high = 1, int(self.sums.max()) + 1
        while high - low > 1:  # at low there are enough or it is 1, at high too few
            middle = (low + 3 * high) // 4 if low == 1 else (low + high) // 2
            middle = min(max(middle, low + 1), high - 1)
            np.greater_equal(self.sums, middle, out=self.mark)
            n = np.count_nonzero(self.mark)
            if n < limit:
                high = middle
            else:
                low = middle
                if n <= max(SEEDS, limit):
                    break
        np.greater_equal(self.sums, low, out=self.mark)
        return self._marked()[-max(SEEDS, limit) :]

    def _marked(self) -> np.ndarray:
        """The places that are marked, eight looked at as one."""
        at = (np.flatnonzero(self.marks.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        return at[self.marks[at]]

    def _full(self, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        score = self.sums[places].astype(np.int64)
        if len(rows) and len(places):
            score += self.by_place[places[:, None], rows].sum(axis=1, dtype=np.int64)
        return score
