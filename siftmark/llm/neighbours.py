"""The k most similar vectors of every vector, by vantage-point trees.

A coarse vantage-point tree, grown on a bounded sample, cuts each collection into
shards of about equal size. Each shard builds its own tree and answers its own vectors
first; the similarity reached so far then decides, by the triangle inequality, which
other shards a vector still has to visit. The bound is relaxed by a factor: at 1 the
search is exact, below 1 branches are left out that could hold a nearer vector only if
it lay almost exactly in the direction of the vantage point.

Distances are Euclidean between normalised vectors, which orders pairs as cosine does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.runtime import cut

#: Part of the reached distance that a branch has to beat.
RELAX = 0.6
#: Vectors of a shard; a shard that grew larger is divided by hash.
SHARD_ROWS = 8192
#: Vectors of a leaf within a shard.
LEAF_ROWS = 256
#: Most vectors of one collection that the coarse tree is grown on.
SAMPLE_ROWS = 20_000
#: Most vectors of all collections together that trees are grown on.
SAMPLE_TOTAL = 400_000
#: Most rows of a table of shards that is broadcast; a larger one is joined.
SMALL = 100_000
#: Room for what single precision loses.
SLACK = 1e-5


def usable_vectors(cache: DataFrame) -> DataFrame:
    """(key, pack_id, dimension, vector): the current row of each cache_key, if its vector can be used.

    The row of the latest ``last_used_at`` counts (null is the earliest; then the later
    ``created_at``, then the greater pack_id, dimension and text); an unusable current
    row is not replaced by an older one. Usable is a JSON array of exactly ``dimension``
    finite numbers, not all zero. Rows with a null key, pack or dimension are left out.
    """
    order = [F.col(c).desc_nulls_last() for c in ("last_used_at", "created_at", "pack_id", "dimension", "vector_json")]
    rank = F.row_number().over(Window.partitionBy("cache_key").orderBy(*order))
    rows = cache.where(F.col("cache_key").isNotNull()).select("cache_key", "pack_id", "dimension", "vector_json", "last_used_at", "created_at")
    rows = rows.withColumn("__rank", rank).where(F.col("__rank") == 1)
    shaped = F.col("vector_json").rlike(r"(?s)\A\s*\[[^\"\[\]{}]*\]\s*\z")
    vector = F.when(shaped, F.from_json("vector_json", "array<double>", {"allowNonNumericNumbers": "false"}))
    rows = rows.select(F.col("cache_key").alias("key"), "pack_id", "dimension", vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("pack_id").isNotNull() & (F.size("vector") == F.col("dimension")) & finite & F.exists("vector", lambda x: x != 0))


class Tree:
    """A vantage-point tree over the rows of ``x``: inner nodes in arrays, leaves as slices of ``order``.

    A node holds a vantage point and, of either half, the least and greatest distance to it.
    """

    def __init__(self, x: np.ndarray, leaf_rows: int, leaves: int | None = None):
        self.x, self.order = x, np.arange(len(x))
        self.vantage: list[np.ndarray] = []
        self.spans: list[tuple[float, float, float, float]] = []
        self.children: list[tuple[int, int]] = []
        self.slices: list[tuple[int, int]] = []
        self.root = self._grow(0, len(x), leaf_rows, leaves)

    def _grow(self, a: int, b: int, leaf_rows: int, leaves: int | None) -> int:
        """The number of the node for ``order[a:b]``; leaves have negative numbers."""
        enough = leaves <= 1 if leaves is not None else b - a <= leaf_rows
        if enough or b - a < 2:
            self.slices.append((a, b))
            return -len(self.slices)
        rows = self.order[a:b]
        # of a few rows the one whose distances spread most
        tried = rows[:: max(1, len(rows) // 8)][:8]
        probe = rows[:: max(1, len(rows) // 256)]
        spread = [np.var(_distances(self.x[probe], self.x[t])) for t in tried]
        point = self.x[tried[int(np.argmax(spread))]]
        d = _distances(self.x[rows], point)
        left = (leaves + 1) // 2 if leaves is not None else None
        middle = (b - a) * left // leaves if leaves is not None else (b - a) // 2
        sort = np.argsort(d, kind="stable")
        self.order[a:b] = rows[sort]
        d = d[sort]
        middle = min(max(middle, 1), b - a - 1)
        me = len(self.vantage)
        self.vantage.append(point)
        self.spans.append((d[0], d[middle - 1], d[middle], d[-1]))
        self.children.append((0, 0))
        self.children[me] = (self._grow(a, a + middle, leaf_rows, left), self._grow(a + middle, b, leaf_rows, leaves - left if leaves is not None else None))
        return me

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``x`` belongs to: the half whose border is nearer, all the way down."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -node - 1
            elif len(rows):
                near = _distances(x[rows], self.vantage[node]) <= (self.spans[node][1] + self.spans[node][2]) / 2
                todo += [(self.children[node][0], rows[near]), (self.children[node][1], rows[~near])]
        return leaf


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ point), 0))


def _search(tree: Tree, queries: np.ndarray, k: int, relax: float, reached: np.ndarray, itself: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, rows of the tree) of the best ``k`` for each query, -2 and -1 where there are fewer.

    ``reached`` is the distance each query has to beat; ``itself`` the row that is the query.
    """
    best = np.full((len(queries), k), -2.0, np.float32)
    who = np.full((len(queries), k), -1, np.int64)
    radius = reached.astype(np.float32).copy()

    def leaf(number: int, rows: np.ndarray) -> None:
        a, b = tree.slices[number]
        members = tree.order[a:b]
        s = queries[rows] @ tree.x[members].T
        if itself is not None:
            s[itself[rows][:, None] == members[None, :]] = -2
        hit = np.flatnonzero(s.max(axis=1) > best[rows, k - 1])
        if not len(hit):
            return
        at, s = rows[hit], s[hit]
        if s.shape[1] > k:
            top = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
            s, names = np.take_along_axis(s, top, 1), members[top]
        else:
            names = np.broadcast_to(members, s.shape)
        s, names = np.concatenate([best[at], s], 1), np.concatenate([who[at], names], 1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best[at], who[at] = np.take_along_axis(s, order, 1), np.take_along_axis(names, order, 1)
        kth = best[at, k - 1]
        radius[at] = np.minimum(radius[at], np.where(kth > -2, np.sqrt(np.maximum(2 - 2 * kth, 0)), np.inf))

    def walk(node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node < 0:
            leaf(-node - 1, rows)
            return
        d = _distances(queries[rows], tree.vantage[node])
        a0, a1, b0, b1 = tree.spans[node]
        near = d <= (a1 + b0) / 2
        inside, outside = tree.children[node]
        walk(inside, rows[near])
        walk(outside, rows[~near])
        limit = radius[rows] * relax + SLACK
        walk(inside, rows[~near & (d >= a0 - limit) & (d <= a1 + limit)])
        walk(outside, rows[near & (d >= b0 - limit) & (d <= b1 + limit)])

    walk(tree.root, np.arange(len(queries)))
    return best, who


class Router:
    """The coarse trees of the collections that have several shards; any other collection is one leaf."""

    def __init__(self, trees: dict[tuple, Tree]):
        self.nodes = {g: (t.root, np.array(t.vantage, np.float32), t.spans, t.children) for g, t in trees.items()}

    def place(self, group: tuple, x: np.ndarray) -> np.ndarray:
        if group not in self.nodes:
            return np.zeros(len(x), np.int64)
        tree = Tree.__new__(Tree)
        tree.root, vantage, tree.spans, tree.children = self.nodes[group]
        tree.vantage = list(vantage)
        return tree.place(x)

    def visits(self, group: tuple, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, leaf) for every leaf that may hold a vector nearer than ``limit``.

        A row goes to a half if the border between the halves (the rule of ``place``)
        can be crossed within its limit; that holds for all vectors, not just the sample.
        """
        if group not in self.nodes:
            yield np.arange(len(x)), 0
            return
        root, vantage, spans, children = self.nodes[group]
        todo = [(root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield rows, -node - 1
                continue
            d = _distances(x[rows], vantage[node])
            border = (spans[node][1] + spans[node][2]) / 2
            todo += [(children[node][0], rows[d - limit[rows] <= border + SLACK]), (children[node][1], rows[d + limit[rows] >= border - SLACK])]


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(vector: Column) -> Column:
    """The vector of length 1 in single precision; scaled by its greatest number first, so that no square is lost."""
    scaled = _once(F.array_max(F.transform(vector, F.abs)), lambda m: F.transform(vector, lambda x: x / m))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _once(scaled, lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: (x / n).cast("float"))))


def _few(table: DataFrame) -> DataFrame:
    """A small written table, to be broadcast while its size is below the bound."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _group_key(values) -> tuple:
    return tuple(v.item() if hasattr(v, "item") else v for v in (values if isinstance(values, tuple) else (values,)))


def most_similar(vectors: DataFrame, k: int = 5, *, key: str = "key", group: tuple[str, ...] = ("pack_id", "dimension"), vector: str = "vector", relax: float = RELAX, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(group, key, neighbour, similarity, rank): the ``k`` most similar others of every vector within its group.

    ``vectors`` has each key once, and in a group only vectors of one length, finite and
    not all zero. Every vector is in the index and every vector is a query. Equally
    similar ones rank by key. Vectors equal in all numbers are searched once, so many
    copies of one make no hot spot; each copy gets its own result, nearest keys first.
    Fewer than ``k`` others give fewer rows, an empty table none.

    A vector is shuffled once to meet its copies, once to its shard, once as a host and
    once for each shard it visits; everything else moves numbers and keys only.
    """
    groups = list(group)
    same = [*groups, "v1", "v2"]
    rows = vectors.select(*groups, F.col(key).alias("key"), F.xxhash64(vector).alias("v1"), F.xxhash64(F.lit(1), vector).alias("v2"), unit(F.col(vector)).alias("u"))
    rows = cut(rows)
    distinct = rows.groupBy(*same).agg(F.any_value("u").alias("u"), F.count("*").alias("copies"))
    distinct = cut(distinct.select(F.monotonically_increasing_id().alias("id"), *same, "copies", "u"))
    keys = cut(rows.select(*same, "key").join(distinct.select(*same, "id", "copies"), same).select(*groups, "key", "id", "copies"))
    placed, parts, router = _shards(distinct, groups, shard_rows, sample_rows)
    return _expand(keys, _neighbours(placed, parts, groups, router, k, relax, shard_rows), groups, k)


def _shards(distinct: DataFrame, groups: list[str], shard_rows: int, sample_rows: int):
    """The vectors with their ``leaf`` and ``part``, the parts of each leaf, and the router.

    Only collections of more than ``shard_rows`` vectors have a tree. It is grown on those
    of the least hashes, about 100 for each shard, ``sample_rows`` for a collection and
    ``SAMPLE_TOTAL`` for all at most.
    """
    spark = distinct.sparkSession
    sizes = {tuple(r[g] for g in groups): r["n"] for r in distinct.groupBy(*groups).agg(F.count("*").alias("n")).collect()}  # as many as there are collections
    leaves = {g: math.ceil(n / shard_rows) for g, n in sizes.items() if n > shard_rows}
    wish = {g: min(sample_rows, 100 * m) for g, m in leaves.items()}
    less = min(1.0, SAMPLE_TOTAL / max(1, sum(wish.values())))
    span = 1 << 40
    kinds = [f"`{c}` {distinct.schema[c].dataType.simpleString()}" for c in groups]
    trees = {}
    if leaves:
        part = [(*g, min(span, math.ceil(span * less * w / sizes[g]))) for g, w in wish.items()]
        limits = spark.createDataFrame(part, ", ".join([*kinds, "__limit bigint"]))
        sampled = distinct.join(F.broadcast(limits), groups).where(F.pmod("v1", F.lit(span)) < F.col("__limit")).select(*groups, "v1", "v2", "u").toPandas()
        for g, rows in sampled.sort_values(["v1", "v2"]).groupby(groups, sort=True):
            g = _group_key(g)
            trees[g] = Tree(np.array(rows["u"].tolist(), np.float32), 1, min(leaves[g], max(1, len(rows) // 4)))
    shared = spark.sparkContext.broadcast(Router(trees))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf = np.zeros(len(batch), np.int32)
            for g, at in batch.groupby(groups, sort=False).indices.items():
                leaf[at] = shared.value.place(_group_key(g), np.array(batch["u"].iloc[at].tolist(), np.float32))
            yield batch.assign(leaf=leaf)

    placed = cut(distinct.select(*groups, "id", "u").mapInPandas(route, ", ".join([*kinds, "id bigint, u array<float>, leaf int"])))
    # a leaf that is much larger than planned is divided by hash; its parts share the leaf's region
    parts = cut(placed.groupBy(*groups, "leaf").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts")))
    placed = placed.join(_few(parts), [*groups, "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return placed, parts, shared


def _neighbours(placed: DataFrame, parts: DataFrame, groups: list[str], router, k: int, relax: float, shard_rows: int) -> DataFrame:
    """(id, near): for each vector an array of (-similarity, id) of at least the best ``k`` others, best first."""
    shard = [*groups, "leaf", "part"]
    kinds = [f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in groups]
    answer = "id bigint, w array<bigint>, s array<double>"

    def lists(x: np.ndarray, y: np.ndarray, names: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[list, list]:
        """For every row the names and similarities (in double precision) of who is there."""
        r, c = np.nonzero(who >= 0)
        w = who[r, c]
        exact = np.einsum("ij,ij->i", x[r].astype(np.float64), y[w].astype(np.float64))
        ends = np.cumsum(np.bincount(r, minlength=len(x)))[:-1]
        return np.split(names[w], ends), np.split(exact, ends)

    def own(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["u"].tolist(), np.float32)
        best, who = _search(Tree(x, LEAF_ROWS), x, k, relax, np.full(len(x), np.inf), np.arange(len(x)))
        w, s = lists(x, x, part["id"].to_numpy(), best, who)
        # a list that is not full bounds nothing, relaxed or not
        last = np.fromiter((v.min() if len(v) >= k else -np.inf for v in s), np.float64, len(s))
        reached = np.where(last > -2, np.sqrt(np.maximum(2 - 2 * np.maximum(last, -2), 0)), np.inf).astype(np.float32)
        g, leaf = _group_key(tuple(key[: len(groups)])), int(key[len(groups)])
        found = [(rows, np.full(len(rows), n)) for rows, n in router.value.visits(g, x, reached * relax) if n != leaf or part["parts"].iloc[0] > 1]
        rows = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        goes = np.concatenate([f[1] for f in found])[np.argsort(rows, kind="stable")] if found else rows
        visits = np.split(goes.astype(np.int32), np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])
        return pd.DataFrame({**{c: key[i] for i, c in enumerate(shard)}, "id": part["id"], "u": part["u"], "w": w, "s": s, "reached": reached, "visits": visits})

    local = placed.groupBy(*shard).applyInPandas(own, ", ".join([*kinds, "leaf int, part int, id bigint, u array<float>, w array<bigint>, s array<double>, reached float, visits array<int>"]))
    local = cut(local)

    goes = local.select(*groups, "id", "u", "reached", F.col("leaf").alias("__leaf"), F.col("part").alias("__part"), F.explode("visits").alias("leaf"))
    goes = goes.join(_few(parts), [*groups, "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    goes = goes.where((F.col("leaf") != F.col("__leaf")) | (F.col("part") != F.col("__part")))
    # many visitors of a shard are spread over several tasks
    load = cut(goes.groupBy(*shard).agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("turns")))
    visitors = goes.join(_few(load), shard).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
    hosts = placed.join(_few(load), shard).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def guests(key: tuple, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"id": [], "w": [], "s": []})
        x, y = np.array(q["u"].tolist(), np.float32), np.array(m["u"].tolist(), np.float32)
        reached = q["reached"].to_numpy()
        best, who = _search(Tree(y, LEAF_ROWS), x, k, relax, reached)
        near = np.sqrt(np.maximum(2 - 2 * best, 0)) <= reached[:, None] + SLACK
        some = (near & (who >= 0)).any(axis=1)
        w, s = lists(x, y, m["id"].to_numpy(), best, np.where(near, who, -1))
        pick = np.flatnonzero(some)
        return pd.DataFrame({"id": q["id"].to_numpy()[pick], "w": [w[i] for i in pick], "s": [s[i] for i in pick]})

    meet = [*shard, "turn"]
    far = visitors.select(*meet, "id", "u", "reached").groupBy(*meet).cogroup(hosts.select(*meet, "id", "u").groupBy(*meet)).applyInPandas(guests, answer)
    every = local.select("id", "w", "s").unionByName(far).select("id", F.zip_with("s", "w", lambda s, w: F.struct((-s).alias("d"), w.alias("w"))).alias("near"))
    # a vector has few lists, each of k
    merged = every.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select("id", F.slice("near", 1, k).alias("near"))


def _expand(keys: DataFrame, found: DataFrame, groups: list[str], k: int) -> DataFrame:
    """From distinct vectors to keys: every key with its ``k`` best, copies of itself first.

    Of a set of copies only the ``k + 1`` lowest keys can be anyone's neighbour, so no list grows with it.
    """
    first = Window.partitionBy("id").orderBy("key")
    heads = keys.select("id", "key", "copies").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    near = found.select("id", F.explode("near").alias("x")).select("id", F.col("x.w").alias("w"), F.col("x.d").alias("d"))
    others = near.join(heads.select(F.col("id").alias("w"), F.col("key").alias("neighbour")), "w").select("id", "d", "neighbour")
    copies = heads.where(F.col("copies") > 1).select("id", F.lit(-1.0).alias("d"), F.col("key").alias("neighbour"))
    lists = others.unionByName(copies).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour"))), 1, k + 1).alias("near"))
    kept = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, k)
    each = keys.join(lists, "id").select(*groups, "key", F.posexplode(kept).alias("i", "x"))
    return each.select(*groups, "key", F.col("x.neighbour").alias("neighbour"), (-F.col("x.d")).alias("similarity"), (F.col("i") + 1).alias("rank"))


def similar_pairs(nearest: DataFrame, a: str = "cache_key_a", b: str = "cache_key_b") -> DataFrame:
    """The unordered pairs of which at least one is among the nearest of the other, each once."""

    def side(f) -> Column:
        return f(F.col("key"), F.col("neighbour"))

    return nearest.select(side(F.least).alias(a), side(F.greatest).alias(b)).distinct()
