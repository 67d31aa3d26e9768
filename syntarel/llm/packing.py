"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. What the packer
needs to know is how many pieces there are of each length: a table of at most
``capacity`` rows. On it, a bitset subset-sum dynamic program finds the fullest
feasible combination of lengths for a bin; the combination is used as often as
the counts allow, its pieces are removed, and so on. Every pattern uses up at
least one length, so there are at most ``capacity`` patterns whatever the size
of the corpus. Each piece then finds its place from its rank within its length.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize

CAPACITY = 2048
#: Characters whose words are put together in one call.
TOGETHER = 4 << 20
#: The byte-level pre-tokenizer that byte-pair files of this kind share (a fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space but the space.
_WHITE = [chr(i) for i in range(0x3001) if i != 32 and chr(i).isspace()]


def _edgy(text: str) -> bool:
    """Is there white space beside a space, or at either end?"""
    return not text or text[0].isspace() or text[-1].isspace() or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _WHITE)


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids of a plain byte-level BPE whose ids are its merge ranks; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("byte_fallback"):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    value = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = spec.get("added_tokens") or ()
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
        return None
    special = {x["content"] for x in added}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get("".join(m), -1) for m in merges]
    if any(ids[i] >= ids[i + 1] for i in range(len(ids) - 1)) or len(vocab) != 256 + len(merges):
        return None
    return {bytes(value[c] for c in t): i for t, i in vocab.items()}


class BatchTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokenizer never joins what stands on both sides of a
    single space between two other characters. So a batch is cut at its spaces,
    the distinct words are encoded once, in one call, and their ids are put
    back in order. Words are encoded from the file's own vocabulary by the
    faster of the two byte-pair libraries, whose ids are the same; texts with
    other white space at a cut are encoded in whole. Files of other kinds go
    through ``tokenizers`` text by text. Nothing is kept between batches.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = _byte_ranks(spec)
        added = sorted(((x["content"], x["id"]) for x in spec.get("added_tokens") or ()), key=lambda x: -len(x[0]))
        self.added = [x for x, _ in added]
        if self.ranks:
            import tiktoken

            model = tiktoken.Encoding("words", pat_str=BYTE_PATTERN, mergeable_ranks=self.ranks, special_tokens=dict(added))
            self.one = lambda x: model.encode(x, allowed_special="all")
            self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for token, i in self.ranks.items():
                self.size[i] = len(token)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.one = lambda x: whole.encode(x, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if self.ranks and not _edgy(text) and not any(x in text for x in self.added):
                plain.append(i)
            elif text:
                out[i] = array("I", self.one(text)).tobytes()
        some: list[int] = []
        size = 0
        for i in [*plain, -1]:
            if some and (i < 0 or size > TOGETHER):
                for k, ids in zip(some, self._together([texts[k] for k in some]), strict=True):
                    out[k] = ids
                some, size = [], 0
            if i >= 0:
                some.append(i)
                size += len(texts[i])
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = [x.partition(" ") for x in texts]
        firsts = [array("I", self.one(x[0])).tobytes() for x in cut]
        words = pc.split_pattern(pa.array([x[2] for x in cut], pa.large_string()), " ")
        bounds = np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        table = coded.dictionary
        # A space and a word each; the empty word stands only for a text of one word.
        ids = np.array(self.one("".join([f" {w}" for w in table.to_pylist() if w])), np.uint32)
        width = np.asarray(pc.binary_length(table)).astype(np.int64)
        width += width > 0
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(width), "right")
        count = np.diff(ends, prepend=0)
        size = count[which]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat((ends - count)[which] - before[:-1], size) + np.arange(before[-1])]
        spans = before[bounds]
        return [first + flat[a:b].tobytes() for first, a, b in zip(firsts, spans[:-1], spans[1:], strict=True)]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what doesn't fill a piece."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of all rows: doc_id, piece, start, length, ids_crc32, ids (if kept), task, rank.

    ``rank`` numbers the pieces of one length within a task, from 0. A null
    text is an empty one; every document ends in ``end_id``.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", task int, rank long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = BatchTokenizer(tokenizer)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            flat: list[bytes] = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        flat.append(part)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(columns[3], dtype=np.int64)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4"))))
            arrays += [pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination {length: times} with the largest sum up to ``capacity``.

    It holds the longest available length. Bit s of a set is on if s can be
    reached; the sets before each length are kept to walk back. Copies of a
    length are taken in binary bundles.
    """
    top = max(counts)
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1 << top, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == top), (capacity - top) // length)
        bundle = 1
        while left > 0:
            k = min(bundle, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            bundle *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {top: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces in a bin}) of each pattern; uses up all counts."""
    left = {x: n for x, n in counts.items() if n > 0}
    plan = []
    while left:
        taken = fullest(left, capacity)
        times = min(left[x] // k for x, k in taken.items())
        plan.append((times, taken))
        for x, k in taken.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, pieces in a bin, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, taken in plan:
        offset = 0
        for length in sorted(taken, reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), first, taken[length], offset))
            used[length] = used.get(length, 0) + times * taken[length]
            offset += length * taken[length]
        first += times
    return {k: np.array(v, np.int64).reshape(-1, 4) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, ids (the
    tokens, unless ``keep_ids`` is false), sequence_id, offset. Null texts are
    empty documents of one token; repeated rows are packed each; an empty table
    gives no rows. Columns other than doc_id and text aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = materialize(tokenize(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    per_task = materialize(per_task.withColumn("before", F.coalesce(before, F.lit(0))), "lengths")
    counts = {int(r[0]): int(r[1]) for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("before").to_numpy() + batch.column("rank").to_numpy()
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                table = slots.value[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                inner = rank[at] - row[:, 0]
                bins[at] = row[:, 1] + inner // row[:, 2]
                offsets[at] = row[:, 3] + inner % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bins), pa.array(offsets)], names=[*keep, "sequence_id", "offset"])

    keep = [c for c in pieces.columns if c not in ("task", "rank")]
    # Tasks times lengths: it grows with the corpus, so it isn't broadcast.
    joined = pieces.join(per_task.select("task", "length", "before").hint("merge"), ["task", "length"]).select(*keep, "rank", "before")
    schema = T.StructType([*(pieces.schema[c] for c in keep), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return joined.mapInArrow(place, schema)
