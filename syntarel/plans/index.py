"""The semantic index: build it from sources, keep its embedding cache, search it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.embeddings import Provider, embedding
from ..functions.hashing import hash32_long, signed_hex
from ..operators import code, search
from ..sources import ast_table
from ..storage import Buckets, scratch, written

ENTRY = "id string, content string, file string, line int, type string, embedding array<float>"
CACHE = "hash string, model string, dimensions int, embedding array<float>"


#: Buckets of the cache, and parts of it beyond which small ones are put together.
BUCKETS, MOST_PARTS = 16, 8


class VectorIndex:
    """The vectors and the embedding cache of a project, under one manifest.

    A version is a file ``index.v<number>`` that names the folder of the vectors and the
    parts of the cache, with their rows and dimensions, so counts are read from it and
    not from rows. All folders are written before the file is put in place, by a rename
    that fails if there is one of that number already: readers see both tables of one version, and of two
    writers one fails. The folders of a replaced version stay until the next one.

    The cache only grows: what a build has embedded is a further part, in buckets by
    hash, so lookups read it as it lies and a build writes its misses and nothing else. Where there are more
    than MOST_PARTS, all but the largest become one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> dict[int, str]:
        """Manifest files by version."""
        fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(self._path(""))] if fs.exists(self._path("")) else []
        return {int(n[7:]): n for n in names if n.startswith("index.v") and n[7:].isdigit()}

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The latest version; 0 before the first build."""
        return max(self._versions(), default=0)

    def manifest(self) -> dict:
        """Of the latest version: ``vectors`` (folder, rows, dimensions) and ``cache`` (a list of the same)."""
        versions = self._versions()
        return self._load(versions[max(versions)]) if versions else {"vectors": None, "cache": []}

    def read(self, table: str) -> DataFrame:
        """``vectors`` or ``cache``; empty before the first build."""
        found, schema = self.manifest()[table], {"vectors": ENTRY, "cache": CACHE}[table]
        folders = [found["folder"]] if isinstance(found, dict) else [x["folder"] for x in found or ()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def parts(self) -> list[Buckets]:
        """The parts of the cache, each in its buckets; ``forget`` them when done."""
        return [Buckets(self.spark, f"{self.root}/{x['folder']}", CACHE, ["hash"], BUCKETS) for x in self.manifest()["cache"]]

    def stage(self, table: str, df: DataFrame) -> dict:
        """Writes the rows of a table to a new folder that no version names yet: its entry of a manifest."""
        folder, schema = f"{table}-{uuid.uuid4().hex}", {"vectors": ENTRY, "cache": CACHE}[table]
        if table == "cache":
            part = Buckets(self.spark, f"{self.root}/{folder}", schema, ["hash"], BUCKETS)
            rows = part.append(df)
            part.forget()
        else:
            seen = Observation()
            df.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.root}/{folder}")
            rows = seen.get["n"]
        one = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(F.size("embedding")).limit(1).collect() if rows else []
        return {"folder": folder, "rows": rows, "dimensions": one[0][0] if one else None}

    def commit(self, vectors: dict | None = None, cache: dict | None = None) -> None:
        """The next version: staged ``vectors`` in place of the last ones, a staged part of the ``cache`` beside the others. FileExistsError if another writer was faster."""
        fs, versions, last = self._fs(), self._versions(), self.manifest()
        new, parts = max(versions, default=0) + 1, [*last["cache"], *([cache] if cache and cache["rows"] else [])]
        if len(parts) > MOST_PARTS:
            largest = max(parts, key=lambda x: x["rows"])
            small = self.spark.read.schema(CACHE).parquet(*[f"{self.root}/{x['folder']}" for x in parts if x is not largest])
            parts = [largest, self.stage("cache", small)]
        text = json.dumps({"vectors": vectors or last["vectors"], "cache": parts})
        part = self._path(f".{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        renames = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(renames, 1)
        kinds[0] = renames.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(part, self._path(f"index.v{new:08d}"), kinds)
        except Exception as error:
            fs.delete(part, False)
            raise FileExistsError(f"index version {new}") from error
        for number in [n for n in versions if n < new - 1]:
            fs.delete(self._path(versions[number]), False)

    def vacuum(self) -> list[str]:
        """Deletes the folders that neither the latest version nor the one before names: replaced ones, and those of writers that failed. Not while another writer is at work."""
        fs, versions, named = self._fs(), self._versions(), set()
        for number in sorted(versions)[-2:]:
            found = self._load(versions[number])
            named |= {x["folder"] for x in [*found["cache"], *([found["vectors"]] if found["vectors"] else [])]}
        names = [x.getPath().getName() for x in fs.listStatus(self._path(""))]
        gone = [n for n in names if n.startswith(("vectors-", "cache-")) and n not in named]
        for name in gone:
            fs.delete(self._path(name), True)
        return gone

    def clear(self) -> None:
        self.commit(vectors=self.stage("vectors", self.spark.createDataFrame([], ENTRY)))

    def count(self) -> int:
        """Stored vectors."""
        return (self.manifest()["vectors"] or {"rows": 0})["rows"]

    def dimensions(self) -> int | None:
        """Length of the stored vectors, or None without any."""
        return (self.manifest()["vectors"] or {"dimensions": None})["dimensions"]

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        """The k nearest entries, with ``distance``."""
        return search.nearest(self.read("vectors"), query, k, "id")


def embedded(entries: DataFrame, index: VectorIndex, chosen: Provider) -> tuple[DataFrame, dict | None]:
    """``entries`` (``hash``, ``content`` and others) with ``embedding`` and ``hit``, and the staged part of the cache that holds what was missing.

    Each part of the cache is met by the entries in its own buckets. Only misses are embedded, each distinct one once, and written.
    """
    rows, model = written(entries, "entries"), chosen.model()
    parts = index.parts()
    known = [p.read().where(F.col("model") == model).select("hash", "embedding") for p in parts]
    nothing = index.spark.createDataFrame([], "hash string, embedding array<float>")
    hits = written(reduce(DataFrame.unionByName, [rows.join(k, "hash") for k in known], rows.join(nothing, "hash")).withColumn("hit", F.lit(True)), "hits")
    for p in parts:
        p.forget()
    misses = rows.join(hits.select("hash").distinct(), "hash", "left_anti")
    new = misses.groupBy("hash").agg(F.min("content").alias("content")).withColumn("embedding", embedding("content", chosen))
    part = index.stage("cache", new.select("hash", F.lit(model).alias("model"), F.size("embedding").alias("dimensions"), "embedding"))
    made = index.spark.read.schema(CACHE).parquet(f"{index.root}/{part['folder']}").select("hash", "embedding")
    return hits.unionByName(misses.join(made, "hash").withColumn("hit", F.lit(False))), part


def build_index(sources: DataFrame, index: VectorIndex, chosen: Provider, said: Callable[[str], None] | None = None) -> dict[str, int]:
    """Index every unit of the sources; figures: entries, hits, misses. ``said`` gets a line with the seconds of each step.

    Contents are hashed and looked up in the cache of the same model; only
    misses are embedded, each distinct one once. Of entries with one id the last
    one is stored. Vectors and cache become visible together.
    """
    began = time.perf_counter()

    def lap(step: str) -> None:
        nonlocal began
        now = time.perf_counter()
        if said:
            said(f"{step}: {now - began:.2f} s")
        began = now

    nodes = ast_table.stored(ast_table.ast_nodes(sources), scratch(sources.sparkSession, "nodes"))
    entries = code.index_entries(sources, nodes).withColumn("hash", signed_hex(hash32_long("content")))
    lap("units")
    full, part = embedded(entries, index, chosen)
    lap("cache and embeddings")
    last = full.groupBy("id").agg(*[F.max_by(c, F.struct("file", "line", "type")).alias(c) for c in ("content", "file", "line", "type", "embedding")])
    vectors = index.stage("vectors", last)
    index.commit(vectors, part)
    lap("written")
    counted = {r["hit"]: r["count"] for r in full.groupBy("hit").count().collect()}
    return {"entries": sum(counted.values()), "hits": counted.get(True, 0), "misses": counted.get(False, 0)}


def search_index(index: VectorIndex, text: str, chosen: Provider, k: int = 10) -> DataFrame:
    """id, file, line, type, content, score (1 - distance) of the entries nearest to a text."""
    found = index.search(chosen.embed_batch([text])[0], k)
    return found.select("id", "file", "line", "type", "content", (1 - F.col("distance")).alias("score"))
