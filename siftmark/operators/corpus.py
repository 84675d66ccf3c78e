"""The corpus: repositories' files and their contents, each content stored once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.functions.keys import clean_path
from siftmark.functions.text import basename, safe_name, split_lines, trigrams
from siftmark.operators.snapshots import latest_entries

# Folders that are never part of the corpus, files that are never shown, and what else a commit may not show.
IGNORED_DIRS = (".git", ".idea", ".venv", "node_modules", "target", "build", "dist")
UNSAFE = r"(?i)(^|/)(\.env|\.envrc|\.netrc|\.npmrc|settings\.xml|credentials(\.json)?|service-account\.json|id_rsa|id_ed25519|keystore|[^/]*secret[^/]*|[^/]*token[^/]*)$|\.(key|pem|p12|pfx|jks)$"
SENSITIVE = r"(?i)(^|/)(\.env|\.envrc|credentials|credentials\.json|service-account\.json|id_rsa|id_ed25519|keystore)$|\.(key|pem|p12|pfx|jks)$"
MAX_BYTES = 3_000_000


def stored_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, content): each stored content once, ids in lower case; null contents are left out.

    An id names its content, so rows of one id are alike; should they differ, the least content counts.
    """
    rows = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), "content")
    return rows.groupBy("blob").agg(F.min("content").alias("content"))


def newest(files: DataFrame) -> Column:
    """The greatest snapshot number, as a value of the plan."""
    return files.agg(F.max("snapshot")).scalar()


def snapshot_files(files: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(repo, path, blob) of one snapshot, by default the newest, as of the latest deliveries; unread files are left out."""
    number = newest(files) if snapshot is None else F.lit(snapshot)
    return latest_entries(files.where(F.col("snapshot") == number)).where(F.col("blob").isNotNull()).select("repo", "path", "blob")


def admitted(path: str = "path") -> Column:
    """Whether a path may enter the corpus: not in an ignored folder and not sensitive."""
    folders = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    return ~F.col(path).rlike(rf"(^|/)({folders})/") & ~F.col(path).rlike(SENSITIVE)


def corpus(files: DataFrame, blobs: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(repo, path, blob): the admitted files of a snapshot (by default the newest) whose content is stored.

    Contents stay in ``stored_blobs``: work on text is done once per blob and joined here.
    """
    return snapshot_files(files, snapshot).where(admitted()).join(held_ids(blobs), "blob", "left_semi").select("repo", "path", "blob")


def held_ids(blobs: DataFrame) -> DataFrame:
    """(blob): the ids of stored contents, without reading a content."""
    return blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob")).distinct()


def blob_lines(blobs: DataFrame) -> DataFrame:
    """(blob, line, text): every line of every stored content, lines from 1."""
    return _lines(stored_blobs(blobs))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("blob", F.posexplode(split_lines(F.col("content"))).alias("i", "text")).select("blob", (F.col("i") + 1).alias("line"), "text")


def matching_lines(blobs: DataFrame, match: Column, held: Column | None = None) -> DataFrame:
    """(blob, line, text): the lines, called ``text``, for which ``match`` holds; of contents for which ``held`` does.

    Everything is decided where the contents are read; only lines that match are shuffled, to drop repeated rows of a blob.
    """
    rows = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull())
    rows = (rows.where(held) if held is not None else rows).select(F.lower("blob").alias("blob"), "content")
    return _lines(rows).where(match).dropDuplicates(["blob", "line", "text"])


def missing_blobs(files: DataFrame, blobs: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Blobs that a snapshot names and the store lacks."""
    return snapshot_files(files, snapshot).select("blob").distinct().join(held_ids(blobs), "blob", "left_anti")


def orphan_blobs(files: DataFrame, blobs: DataFrame, keep: list[int]) -> DataFrame:
    """Stored blobs that no kept snapshot names."""
    used = latest_entries(files.where(F.col("snapshot").isin(keep))).where(F.col("blob").isNotNull()).select("blob").distinct()
    return blobs.where(F.col("blob").isNotNull()).select(F.lower("blob").alias("blob")).distinct().join(used, "blob", "left_anti")


def storage(files: DataFrame, blobs: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(repo, files, blobs, bytes) of a snapshot: entries, distinct stored blobs and their bytes."""
    sizes = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), F.octet_length("content").alias("n"))
    sizes = sizes.groupBy("blob").agg(F.min("n").alias("bytes"))
    rows = snapshot_files(files, snapshot).join(sizes, "blob", "left")
    held = rows.where(F.col("bytes").isNotNull()).dropDuplicates(["repo", "blob"]).groupBy("repo").agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))
    return rows.groupBy("repo").agg(F.count("*").alias("files")).join(held, "repo", "left").select("repo", "files", F.coalesce("blobs", F.lit(0)).alias("blobs"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def index_stats(files: DataFrame, blobs: DataFrame, before: int, after: int) -> DataFrame:
    """(repo, files, changed_blobs, bytes) of a snapshot: its entries, the distinct blobs that no file of the repository had in the one before, and their bytes."""
    sizes = blobs.where(F.col("blob").isNotNull() & F.col("content").isNotNull()).select(F.lower("blob").alias("blob"), F.octet_length("content").alias("n")).groupBy("blob").agg(F.min("n").alias("n"))
    now, old = snapshot_files(files, after), snapshot_files(files, before).select("repo", "blob").distinct()
    new = now.select("repo", "blob").distinct().join(old, ["repo", "blob"], "left_anti").join(sizes, "blob")
    counts = new.groupBy("repo").agg(F.count("*").alias("changed_blobs"), F.sum("n").alias("bytes"))
    return now.groupBy("repo").agg(F.count("*").alias("files")).join(counts, "repo", "left").fillna(0, ["changed_blobs", "bytes"])


def changed_repositories(files: DataFrame, before: int, after: int) -> DataFrame:
    """(repo, before_sig, after_sig, changed): whether a repository's tree differs between two snapshots, by an order-free signature."""
    rows = latest_entries(files.where(F.col("snapshot").isin(before, after)))
    trees = rows.groupBy("repo").agg(
        F.sum(F.when(F.col("snapshot") == before, F.xxhash64("path", "blob").cast("decimal(38,0)"))).alias("a"),
        F.sum(F.when(F.col("snapshot") == after, F.xxhash64("path", "blob").cast("decimal(38,0)"))).alias("b"),
    )
    return trees.select("repo", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def keep_newest(rows: DataFrame, group: list[str], newest: list, keep: int, pinned: str | None = None) -> DataFrame:
    """Rows with ``removable``: beyond the newest ``keep`` of their group and not pinned. Pinned rows take no place."""
    pin = F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(False)
    order = Window.partitionBy(*group, "__pin").orderBy(*newest)
    ranked = rows.withColumn("__pin", pin).withColumn("__n", F.row_number().over(order))
    return ranked.withColumn("removable", ~F.col("__pin") & (F.col("__n") > keep)).drop("__pin", "__n")


def trim_cache(cache: DataFrame, key: str, used: str, keep: int) -> DataFrame:
    """The ``keep`` keys used last (ties by key): the least recently used ones fall out."""
    latest = cache.groupBy(key).agg(F.max(used).alias(used))
    return latest.orderBy(F.col(used).desc_nulls_last(), F.col(key)).limit(keep)


class GenerationStore:
    """Versioned parquet folders; the greatest manifest names those in use.

    A generation is written whole into folders of its own, then its manifest is written
    under another name and renamed to its number, which succeeds once or not at all.
    Nothing is deleted or replaced on the way: a crash at any point leaves the
    generation before in use, and folders that no manifest names wait for
    ``collect_garbage``. Contents are stored once: a new generation writes only blobs the
    store lacks. With ``index`` it also writes trigram postings of its new blobs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> int:
        """The generation in use, 0 if there is none."""
        return max(self._numbers(), default=0)

    def _manifest(self, number: int | None = None) -> dict:
        number = number or self.current()
        if not number:
            return {"files": None, "blobs": [], "postings": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{number}", wholetext=True).first()[0])

    def _announce(self, number: int, manifest: dict) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        draft, target = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{number}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"generation {number} was published by another writer")

    def _write(self, part: str, rows: DataFrame) -> str:
        folder = f"{part}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, files: DataFrame, blobs: DataFrame, *, index: bool = False) -> int:
        """Write the next generation of (repo, path, blob) with its new blobs, then put it in use.

        Of two writers that publish the same number one fails and may try again.
        """
        before, number = self._manifest(), self.current() + 1
        new = stored_blobs(blobs)
        if before["blobs"]:
            new = new.join(self.blobs().select("blob"), "blob", "left_anti")
        manifest = {"files": self._write("files", files), "blobs": [*before["blobs"], self._write("blobs", new)], "postings": before["postings"]}
        if index:
            manifest["postings"] = [*before["postings"], self._index(manifest["blobs"][-1])]
        self._announce(number, manifest)
        return number

    def _index(self, folder: str) -> str:
        grams = self.spark.read.parquet(f"{self.root}/{folder}").select("blob", F.explode(trigrams(F.col("content"))).alias("trigram"))
        # postings of a trigram lie in at most four places and in order, so that a search reads few row groups
        return self._write("postings", grams.repartition("trigram", F.pmod(F.xxhash64("blob"), F.lit(4))).sortWithinPartitions("trigram", "blob"))

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def files(self, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._manifest(generation)['files']}")

    def blobs(self) -> DataFrame:
        """All blobs of the generation in use."""
        return self._read(self._manifest()["blobs"], "blob string, content string")

    def postings(self) -> DataFrame:
        """(trigram, blob) of the blobs that were published with an index."""
        return self._read(self._manifest()["postings"], "blob string, trigram string")

    def pack(self) -> int:
        """Publish the generation in use anew with only the blobs that its files name, in one folder."""
        now, number = self._manifest(), self.current() + 1
        used = self.files().where(F.col("blob").isNotNull()).select(F.lower("blob").alias("blob")).distinct()
        blobs = self._write("blobs", self.blobs().join(used, "blob", "left_semi"))
        self._announce(number, {"files": now["files"], "blobs": [blobs], "postings": [self._index(blobs)] if now["postings"] else []})
        return number

    def collect_garbage(self, keep: int = 2) -> int:
        """Drop all manifests but the newest ``keep``, then the folders that none of the rest names; their number.

        Not beside a writer, whose folders no manifest names yet.
        """
        numbers = self._numbers()
        for n in numbers[: max(0, len(numbers) - keep)]:
            self._fs.delete(self._path(f"{self.root}/manifest/{n}"), False)
        used = {f for n in self._numbers() for m in (self._manifest(n),) for f in [m["files"], *m["blobs"], *m["postings"]]}
        dropped = 0
        for part in ("files", "blobs", "postings"):
            folder = self._path(f"{self.root}/{part}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{part}/{status.getPath().getName()}" not in used:
                    dropped += self._fs.delete(status.getPath(), True)
        return dropped


def named(found: DataFrame, configured: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(name, path) of repositories that are found and not configured yet, each under a name of its own.

    Paths compare as clean paths. A name is the last part of the path as a safe name; where it is taken,
    by a configured repository or an earlier one by path, a number is put behind it, from 2.
    """
    new = found.join(configured.select(clean_path(F.col(path)).alias("__p")), clean_path(F.col(path)) == F.col("__p"), "left_anti").select(clean_path(F.col(path)).alias(path)).distinct()
    new = new.withColumn("__base", safe_name(basename(F.col(path))))
    taken = configured.select(F.regexp_replace(name, r"-\d+$", "").alias("__base"), F.col(name).alias("__n")).unionByName(configured.select(F.col(name).alias("__base"), F.col(name).alias("__n"))).distinct()
    last = F.coalesce(F.regexp_extract("__n", r"-(\d+)$", 1).try_cast("int"), F.lit(1))
    taken = taken.groupBy("__base").agg(F.max(F.when(F.col("__n") == F.col("__base"), 1).otherwise(last)).alias("__last"))
    place = F.row_number().over(Window.partitionBy("__base").orderBy(path))
    rows = new.join(taken, "__base", "left").withColumn("__i", F.coalesce("__last", F.lit(0)) + place)
    return rows.select(F.when(F.col("__i") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.col("__i").cast("string"))).alias(name), path)


def freshness(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """(name, sha, indexed_sha, fresh): whether each source's commit is the one that was indexed; a source without a commit is not."""
    rows = sources.select("name", "sha").join(indexed.select("name", F.col("sha").alias("indexed_sha")), "name", "left")
    return rows.withColumn("fresh", F.coalesce((F.col("sha") != "") & (F.col("sha") == F.col("indexed_sha")), F.lit(False)))


def project_status(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row of counts: repositories, those that are current, and those to warn of.

    ``sources`` has name, sha, status and warning. Current is a source whose fetch worked and whose index is
    fresh, or one without version control; a warning is due for a failed fetch, a stale index or a noted warning.
    """
    rows = freshness(sources, indexed).join(sources.select("name", "status", "warning"), "name")
    status = F.coalesce("status", F.lit(""))
    current = (status == "non-git") | (status == "current") & F.col("fresh")
    warned = F.coalesce(F.col("warning") != "", F.lit(False)) | status.isin("fetch-failed", "working-tree-fallback") | ~F.col("fresh")
    return rows.agg(F.count("*").alias("repositories"), F.count_if(current).alias("current"), F.count_if(warned).alias("warnings"))


def tree_signature(files: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A digest of the rows of each group that no order changes: SHA-256 over the number of its rows and the sums of their digests."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    # digests are summed by their halves first, so that a group of any size is combined before the shuffle
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = files.groupBy(*group).agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    return sums.select(*group, F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(4)]), 256).alias("signature"))
