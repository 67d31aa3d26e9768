"""Repeated passages by run-length indexes.

Every byte string of LENGTH bytes that starts in two places is found, over any
number of documents, and each in tasks of bounded size:

1. A window of LENGTH bytes is known by the least hash among its K-byte strings.
   Successive windows with the same one form a fragment. Equal windows have equal
   hashes, so they lie in fragments of the same key.
2. A key met once holds no repeat. Equal fragments of the other keys become one with a
   number of copies: hot passages are summed up before their bytes are shuffled. Copies
   match each other to their ends, so that a key of one fragment is done.
3. Keys are dealt to small shards. A shard's fragments are indexed together by the
   run-compressed Burrows-Wheeler transform of their text, sampled where runs start
   and end. All fragments are streamed backwards through the runs: from row to row the
   match with the neighbour grows by one, and at a run's end it is the sample.
   Positions whose matching statistic reaches LENGTH are marked.
4. Marks go back to the documents.

Sequences of a number of words are found in the same way, if asked for: a word takes
the place of a byte, and white space between words doesn't count.

A key with more different fragments than a shard should hold (one short passage in
very many contexts) is split: its fragments are cut again by the least hash among
longer strings, of FINER bytes step by step, so that windows are told apart by their
contexts, and what then has a small key is indexed in the same way. At the last step
the string is the window itself, and a key has one fragment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release

LENGTH = 400
#: Bytes of the strings that windows are known by, and words of those that windows of words are known by.
K, WORDS_K = 64, 8
#: Bytes that a shard's index should hold, and different fragments of a key from which it is split by longer strings:
#: of these parts of the way from K to LENGTH.
SHARD_BYTES, HOT_KEY = 192 << 10, 256
FINER = (0.4, 0.75, 0.95, 1.0)
#: Windows looked at together, few enough for a core's cache; positions within fit 20 bits.
_CHUNK = 1 << 17
#: Bytes of a word from which on a library's hash stands for it.
_LONG_WORD = 64

_RNG = np.random.default_rng(77003)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_UP: np.ndarray = np.ones(1, np.uint64)
_DOWN: np.ndarray = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << n.bit_length()
        _UP = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _STEP, np.uint64)]))
        _DOWN = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BACK, np.uint64)]))
    return _UP[:n], _DOWN[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all strings of ``k`` bytes, or of ``k`` words given by their hashes (uint64)."""
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTE[raw] if raw.dtype == np.uint8 else raw) * up, dtype=np.uint64)])
    return _mix((total[k:] - total[:-k]) * down[: len(raw) - k + 1])


def fragments_of(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, key, first window, last window) of the runs of windows with the same least string, in each of some sequences.

    They follow each other in ``numbers``, with their first and last positions (not
    included) in ``starts`` and ``ends``. Short ones are gone through together; a long one
    is cut at multiples of _CHUNK from its start, so that equal ones are cut alike.
    """
    out: list[tuple] = []
    low = np.uint64((1 << 20) - 1)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        for begin in range(int(starts[at]), max(int(starts[at]) + 1, int(ends[to - 1]) - length + 1), _CHUNK):
            part = numbers[begin : min(begin + _CHUNK + length - 1, int(ends[to - 1]))]
            n, w = len(part) - length + 1, length - k + 1
            if n < 1:
                continue
            hashes = string_hashes(part, k)
            least, step = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
            while 2 * step <= w:
                least, step = np.minimum(least[:-step], least[step:]), 2 * step
            where = (np.minimum(least[:n], least[w - step : w - step + n]) & low).astype(np.int32)
            change = where[1:] != where[:-1]
            own = np.concatenate([starts[at:to], ends[at:to] - length + 1]) - begin
            change[own[(own > 0) & (own < n)] - 1] = True
            first = np.concatenate([[0], np.flatnonzero(change) + 1])
            last = np.append(first[1:], n) - 1
            of = np.searchsorted(starts, first + begin, "right") - 1
            inside = first + begin + length <= ends[of]
            of, first, last = of[inside], first[inside], last[inside]
            out.append((of, hashes[where[first]], first + begin - starts[of], last + begin - starts[of]))
        at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fragments(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window) of one sequence's runs of windows with the same least string."""
    return fragments_of(raw, np.zeros(1, np.int64), np.full(1, len(raw), np.int64), length, k)[1:]


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes are one of the six ASCII white spaces, between words."""
    return (raw == 32) | (raw - np.uint8(9) < 5)


def word_ends(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) in bytes of each word, as bytes.split() has them."""
    inside = np.concatenate([[False], ~_white(raw), [False]])
    return np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits that stand for each word, given by its bytes' (from, to); fragments() takes them in place of bytes."""
    out, at = np.empty(len(starts), np.uint64), 0
    up = _powers(_LONG_WORD)[0]
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        first = starts[at:to] - starts[at]
        part = raw[starts[at] : min(ends[to - 1], starts[at] + _CHUNK)]
        place = np.arange(len(part), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(np.append(first, len(part))))
        values = _BYTE[part] * up[place & (_LONG_WORD - 1)]
        values[_white(part)] = 0
        out[at:to] = np.add.reduceat(values, first)
        at = to
    out = _mix(out)
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hash and first byte of each word, the words joined by blanks, and where each begins and ends there."""
    starts, ends = word_ends(raw)
    white = _white(raw)
    kept = ~white
    kept[1:] |= kept[:-1]  # the byte after a word
    joined = np.where(white, np.uint8(32), raw)[kept].tobytes()
    to = np.cumsum(ends - starts + 1) - 1
    return word_hashes(raw, starts, ends), starts, joined, to - (ends - starts), to


def _arranged(code: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order that sorts the codes, the sorted codes); positions, of ``low`` bits, are sorted along with the codes where they fit."""
    if int(code.max(initial=0)) >> (63 - low):
        order = np.argsort(code, kind="stable").astype(np.int32)
        return order, code[order]
    both = (code << low) | np.arange(len(code))
    both.sort()
    return (both & ((1 << low) - 1)).astype(np.int32), both >> low


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some texts (bytes, or arrays of numbers from 0), sampled at the ends of its runs.

    Once built, it holds five numbers a run and nothing of the texts. ``times``
    says how many copies each text stands for (one by default): rows of
    copies are neighbours with equal symbols, so copies lengthen runs and add none.
    """

    def __init__(self, texts: list[bytes] | list[np.ndarray], times: list[int] | None = None):
        size = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(size + 1) - 1  # of each text; there stands a separator of its own
        self.starts = self.ends - size
        self.n = int(self.ends[-1]) + 1
        self.times = np.ones(len(texts), np.int64) if times is None else np.asarray(times, np.int64)
        symbols = np.empty(self.n, np.int64)
        symbols[self.ends] = np.arange(len(texts))
        inside = np.ones(self.n, bool)
        inside[self.ends] = False
        flat = np.frombuffer(b"".join(texts), np.uint8) if isinstance(texts[0], bytes) else np.concatenate(texts)
        symbols[inside] = flat.astype(np.int64) + len(texts)
        alphabet = len(texts) + (256 if flat.dtype == np.uint8 else int(flat.max(initial=0)) + 1)
        order = self._sorted(symbols, np.repeat(self.ends, size + 1) - np.arange(self.n))
        last = symbols[order - 1]  # of the first suffix it is the last separator
        head = np.concatenate([[True], last[1:] != last[:-1]])
        #: Of each run: its symbol, first row, length, and the row that stepping back leads to from its first one.
        self.rows = np.flatnonzero(head)
        self.symbols, self.lengths = last[self.rows], np.diff(np.append(self.rows, self.n))
        by_symbol = np.argsort(self.symbols, kind="stable")
        self.back = np.empty(len(self.rows), np.int64)
        self.back[by_symbol] = np.cumsum(self.lengths[by_symbol]) - self.lengths[by_symbol]
        #: Samples at a run's ends: after stepping back from its first (last) row, what is shared with the row above (below).
        ends = self.back + self.lengths - 1
        text = symbols.astype(np.uint16 if alphabet < 1 << 16 else np.int64)
        self.above = self._common(text, order[self.back], np.where(self.back > 0, order[self.back - 1], -1))
        self.below = self._common(text, order[ends], np.where(ends + 1 < self.n, order[np.minimum(ends + 1, self.n - 1)], -1))

    @staticmethod
    def _sorted(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling, begun with as many symbols as fit a word; ``left`` has the symbols up to each position's separator.

        Separators count as one symbol at first; suffixes that reach one within the
        first step end there, equal ones in the order of their texts. A rank is the first row
        of its group; only groups of two and more are sorted again.
        """
        n = len(symbols)
        dense = np.zeros(int(symbols.max()) + 1, np.int64)
        dense[symbols] = 1
        dense[symbols[left == 0]] = 0
        dense = np.cumsum(dense) * (dense > 0)
        bits, low = max(1, int(dense.max()).bit_length()), n.bit_length()
        k = max(1, (62 - low) // bits)
        # Words of 1, 2, 4 ... symbols make one of k.
        words = [np.concatenate([dense[symbols], np.zeros(k, np.int64)])]
        while 2 ** len(words) <= k:
            words.append((words[-1] << (bits << (len(words) - 1))) | np.append(words[-1][1 << (len(words) - 1) :], np.zeros(1 << (len(words) - 1), np.int64)))
        code, done = np.zeros(n, np.int64), 0
        for i in range(len(words) - 1, -1, -1):
            if k >> i & 1:
                code = (code << (bits << i)) | words[i][done : done + n]
                done += 1 << i
        kept = np.array([((1 << bits * j) - 1) << bits * (k - j) for j in range(k + 1)], np.int64)
        code &= kept[np.minimum(left, k)]
        open_ = left >= k
        # Positions and ranks fit 32 bits, which halves what the gathers below touch.
        rank, rows = np.empty(n + 1, np.int32), np.arange(n, dtype=np.int32)
        rank[n] = -1  # past the end
        order, code = _arranged(code, low)
        # Equal codes are in the order of their positions, and so of their texts.
        head, at = np.concatenate([[True], code[1:] != code[:-1]]) | ~open_[order], order
        while True:
            # A group's rank is its first row; of those resolved before nothing changes.
            first = np.flatnonzero(head)
            own = np.repeat(rows[first], np.diff(np.append(first, len(rows))))
            rank[at] = own
            more = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(more):
                return order.astype(np.int64)
            rows, at = rows[more], at[more]
            code = (own[more].astype(np.int64) << low) + (rank[np.minimum(at + np.int32(k), n)] + 1)
            again, code = _arranged(code, low)
            at = at[again]
            order[rows] = at
            head = np.concatenate([[True], code[1:] != code[:-1]])
            k *= 2

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b`` (0 where b is -1).

        Separators differ, so that no prefix goes past the end of a text.
        """
        width, out = 32, np.zeros(len(a), np.int64)
        spans = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(width, text.dtype)]), width)
        going = np.flatnonzero(b >= 0)
        while len(going):
            longer = []
            for at in range(0, len(going), 8192):
                some = going[at : at + 8192]
                differ = spans[a[some] + out[some]] != spans[b[some] + out[some]]
                first = differ.argmax(1)
                same = ~differ[np.arange(len(some)), first]
                out[some] += np.where(same, width, first)
                longer.append(some[same])
            going = np.concatenate(longer)
        return out

    def matching_statistics(self) -> np.ndarray:
        """Of every position, the length of its longest match that starts at another one.

        All texts are streamed backwards through the runs at once, from their
        separators (row k is that of text k). Stepping back from inside a run, the
        match with the row above or below grows by one; at a run's end it is the
        sample. A text that stands for copies matches another copy to its end.
        """
        best = np.zeros(self.n, np.int64)
        run_of = np.repeat(np.arange(len(self.rows), dtype=np.int32), self.lengths)  # while streaming
        left = self.ends - self.starts
        text = np.argsort(-left, kind="stable")  # the long ones first: those that are through are cut off behind
        row, at = text.copy(), self.ends[text]
        above, below = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        ways, lasts = self.back - self.rows, self.rows + self.lengths - 1
        going = len(text) - np.searchsorted(left[text][::-1], np.arange(1, int(left.max(initial=0)) + 1))
        for n in going.tolist():
            row, at, above, below = row[:n], at[:n], above[:n], below[:n]
            run = run_of[row]
            above, below = np.where(row == self.rows[run], self.above[run], above + 1), np.where(row == lasts[run], self.below[run], below + 1)
            row, at = row + ways[run], at - 1
            best[at] = np.maximum(above, below)
        for k in np.flatnonzero(self.times > 1):
            best[self.starts[k] : self.ends[k]] = np.arange(self.ends[k] - self.starts[k], 0, -1)
        return best

    def repeats(self, length: int) -> list[np.ndarray]:
        """Of each text, the starts of its strings of ``length`` symbols that start elsewhere, too."""
        long = self.matching_statistics() >= length
        return [np.flatnonzero(long[a : max(a, b - length + 1)]) for a, b in zip(self.starts, self.ends, strict=True)]


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal (from, to) covered by strings of ``length`` at ``starts`` (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length).tolist(), strict=True))


def text_key(text: str = "text"):
    """16 bytes that stand for a text; a null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", words: int | None = None) -> DataFrame:
    """(text_key, spans): for each text with repeats, its covered ranges (from, to, of words or else bytes), not yet merged.

    The result is a written table; all others made on the way are deleted.
    """
    bound_batches(docs.sparkSession)
    least = length if words is None else min(length, 2 * words - 1)
    rows = docs.select(text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= least)
    k = min(K, length)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            raw = b" ".join(texts)  # a blank parts texts for words; strings of bytes that meet it are none
            ends = np.cumsum(np.array([len(x) + 1 for x in texts], np.int64)) - 1
            starts = ends - np.array([len(x) for x in texts], np.int64)
            flat = np.frombuffer(raw, np.uint8)
            kinds = [(fragments_of(flat, starts, ends, length, k), raw, starts, None, length, False)]
            if words is not None:
                hashes, begin, joined, a, b = words_of(flat)
                own = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
                kinds.append((fragments_of(hashes, *own, words, min(WORDS_K, words)), joined, own[0], (a, b), words, True))
            for (of, keys, first, last), units, begin, places, size, of_words in kinds:
                if not len(of):
                    continue
                a, b = begin[of] + first, begin[of] + last + size
                if places is not None:
                    a, b = places[0][a], places[1][b - 1]
                content = pa.array([xxhash.xxh3_128_digest(units[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                columns = [pa.array(keys.view(np.int64)), content, batch.column(0).take(pa.array(of)), pa.array(first.astype(np.int32)), pa.array((last + size).astype(np.int32)), pa.array(np.full(len(of), of_words))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "text_key", "a", "b", "words"])

    every = materialize(rows.mapInArrow(cut, "key long, content binary, text_key binary, a int, b int, words boolean"), "fragments", plain=["key", "content"])
    # What is joined with many rows of a key is written first, so that Spark can split those rows.
    again = materialize(every.groupBy("key", "words").agg(F.count("*").alias("all")).where("all > 1").select("key", "words"), "keys")
    # The hashed keys are single and even, so a task's share of them is small beside its fragments, which needn't be sorted.
    found = materialize(every.join(again.hint("shuffle_hash"), ["key", "words"]), "repeated")
    release(every, again)
    kinds = materialize(found.groupBy("key", "content", "words").agg(F.count("*").alias("times"), F.min(F.struct("text_key", "a", "b")).alias("at")), "kinds")
    keys = materialize(kinds.groupBy("key", "words").agg(F.count("*").alias("kinds")), "kinds-of-keys")
    counted = materialize(kinds.join(keys, ["key", "words"]), "counted")
    release(kinds, keys)
    wanted = counted.where("kinds > 1").select("at.text_key", F.struct("key", "content", "times", "kinds", "at.a", "at.b", "words").alias("at"))
    # One text of each key that holds a wanted fragment: its pieces come from one row.
    lists = materialize(wanted.groupBy("text_key").agg(F.collect_list("at").alias("ats")), "wanted")
    copies = counted.where("kinds = 1 and times > 1").select("key", "content", "words", F.lit(0).cast("long").alias("from"), (F.col("at.b") - F.col("at.a")).cast("long").alias("to"))

    def take(batches):
        import pyarrow as pa

        before = None
        for batch in batches:
            out: list[tuple] = []
            for name, body, ats in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name == before:  # the join puts copies of a text side by side
                    continue
                before, raw = name, body.encode("utf-8", "surrogatepass")
                split = raw.split() if any(x["words"] for x in ats) else []
                out += [(x["key"], x["content"], x["times"], x["kinds"], b" ".join(split[x["a"] : x["b"]]) if x["words"] else raw[x["a"] : x["b"]], x["words"]) for x in ats]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["key", "content", "times", "kinds", "body", "words"])

    # Copies that Spark has dealt to several tasks give their fragments again; one of each is kept.
    texts = rows.join(lists.hint("merge"), "text_key").select("text_key", "text", "ats")
    taken = texts.mapInArrow(take, "key long, content binary, times long, kinds long, body binary, words boolean")
    bodies = materialize(taken.groupBy("key", "content", "words").agg(F.first("times").alias("times"), F.first("kinds").alias("kinds"), F.first("body").alias("body")), "bodies")
    release(lists)
    marks, used = _marks(bodies, length, words, 0)
    marks = materialize(marks.unionByName(copies), "marks")
    release(counted, bodies, *used)
    spans = found.join(marks, ["key", "content", "words"]).select("text_key", F.struct((F.col("a") + F.col("from")).alias("from"), (F.col("a") + F.col("to")).alias("to"), "words").alias("span"))
    out = materialize(spans.groupBy("text_key").agg(F.collect_set("span").alias("spans")), "spans")
    release(found, marks)
    return out


_MARKS = "key long, content binary, words boolean, from long, to long"


def _marks(bodies: DataFrame, length: int, words: int | None, step: int) -> tuple[DataFrame, list[DataFrame]]:
    """(the marks of fragments with their bodies, the tables they are read from)."""
    few = bodies.where(F.col("kinds") <= HOT_KEY) if step < len(FINER) else bodies
    total = few.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        of_words, texts = bool(rows["words"].iloc[0]), list(rows["body"])
        if of_words:
            numbers: dict[bytes, int] = {}
            texts = [np.array([numbers.setdefault(w, len(numbers)) for w in x.split()], np.int64) for x in texts]
        size = words if of_words else length
        found = RunLengthIndex(texts, rows["times"].tolist()).repeats(size)
        out = [(key, content, of_words, a, b) for key, content, starts in zip(rows["key"], rows["content"], found, strict=True) for a, b in _covered(starts, size)]
        return pd.DataFrame(out, columns=["key", "content", "words", "from", "to"])

    marked = few.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard", "words").applyInPandas(index, _MARKS)
    hot = bodies.where(F.col("kinds") > HOT_KEY)
    if step == len(FINER) or not hot.limit(1).count():
        return marked, []
    parts = materialize(_finer(hot, length, words, FINER[step]), "finer")
    kinds = parts.groupBy("key", "content", "words").agg(F.sum("times").alias("times"), F.first("body").alias("body"))
    kinds = materialize(kinds, "finer-kinds")
    keys = materialize(kinds.groupBy("key", "words").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1").drop("all"), "finer-keys")
    # A key of one fragment is in the index, too: here copies of it come from different fragments.
    finer = materialize(kinds.join(keys, ["key", "words"]).select("key", "content", "words", "times", "kinds", "body"), "finer-bodies")
    release(kinds, keys)
    below, used = _marks(finer, length, words, step + 1)
    below = materialize(below, "finer-marks")
    back = parts.drop("body", "times").join(below, ["key", "content", "words"])
    back = back.select(F.col("owner_key").alias("key"), F.col("owner").alias("content"), "words", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    return marked.unionByName(back), [*used, finer, parts, below]


def _finer(bodies: DataFrame, length: int, words: int | None, way: float) -> DataFrame:
    """Fragments of fragments, by strings that are longer by ``way`` of what is between K and the window: key, content, words, times, body, owner_key, owner, at."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for key, content, times, body, of_words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                units = body.split() if of_words else body
                size, k = (words, min(WORDS_K, words)) if of_words else (length, min(K, length))
                raw = np.frombuffer(body, np.uint8)
                numbers = word_hashes(raw, *word_ends(raw)) if of_words else raw
                for finer, first, last in zip(*(x.tolist() for x in fragments(numbers, size, k + round(way * (size - k)))), strict=True):
                    part = b" ".join(units[first : last + size]) if of_words else body[first : last + size]
                    digest = xxhash.xxh3_128_digest(part)
                    # A finer key counts within its own one.
                    out.append((xxhash.xxh3_64_intdigest(b"%d %d" % (key, finer)) - (1 << 63), digest, of_words, times, part, key, content, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["key", "content", "words", "times", "body", "owner_key", "owner", "at"])

    return bodies.select("key", "content", "times", "body", "words").mapInArrow(cut, "key long, content binary, words boolean, times long, body binary, owner_key long, owner binary, at long")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for x in spans for e in x), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", into: str = "repeats", words: int | None = None) -> DataFrame:
    """Adds struct ``into``: n_bytes, n_removed, n_spans, spans (from, to) and kept (the bytes left).

    Texts are UTF-8 bytes, a null one is empty; matches never cross documents.
    Every byte covered by a string of ``length`` bytes that starts in another
    place too, in this document or any other, is removed; strings are judged on
    the input. Repeated rows are documents of their own, so each is removed
    where it is long enough. Texts shorter than ``length`` stay whole, and so
    does an empty table. All rows and other columns stay; a column named ``into``
    is replaced.

    With ``words`` the struct also has passage_spans and text: sequences of so many
    words (runs of anything but the six ASCII white spaces) that start in another
    place too, from their first to their last byte, however short and whatever stands
    between the words; and the text left when these and the strings of ``length``
    bytes are removed, without characters that a cut has split.
    """

    def apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for body, ranges in zip(texts, spans, strict=True):
            raw = (body or "").encode("utf-8", "surrogatepass")
            found = [] if ranges is None else [(int(x["from"]), int(x["to"]), x["words"]) for x in ranges]
            strings = _merged([x[:2] for x in found if not x[2]])
            kept = _without(raw, strings)
            row: list = [len(raw), len(raw) - len(kept), len(strings), [{"from": a, "to": b} for a, b in strings], kept]
            if words is not None:
                passages: list[tuple[int, int]] = []
                if any(x[2] for x in found):
                    starts, ends = word_ends(np.frombuffer(raw, np.uint8))
                    passages = _merged([(int(starts[a]), int(ends[b - 1])) for a, b, of_words in found if of_words])
                left = body if not found else _without(raw, _merged(strings + passages)).decode("utf-8", "ignore")
                row += [[{"from": a, "to": b} for a, b in passages], left]
            out.append(row)
        return pd.DataFrame(out, columns=names)

    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "passage_spans", "text"][: 5 if words is None else 7]
    ranges = "array<struct<from:long,to:long>>"
    kind = f"n_bytes long, n_removed long, n_spans long, spans {ranges}, kept binary" + f", passage_spans {ranges}, text string" * (words is not None)
    keyed = docs.withColumn("__text_key", text_key(text))
    spans = repeated_spans(docs, length, text, words)
    joined = keyed.join(spans.select(F.col("text_key").alias("__text_key"), F.col("spans").alias("__spans")).hint("merge"), "__text_key", "left")
    return joined.withColumn(into, F.pandas_udf(apply, kind).asNondeterministic()(F.col(text).cast("string"), "__spans")).drop("__text_key", "__spans")


def repeats_sql(length: int = LENGTH, words: int = 51, table: str = "documents") -> str:
    """DuckDB statement for :func:`cut_repeats` with ``words``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text. All windows are counted.

    Bytes are pairs of hexadecimal digits. Characters that a cut has split are left out by taking whole UTF-8 sequences only.
    """
    word, white = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    whole = "[0-7][0-9A-F]|[CD][0-9A-F][89AB][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F]){2}|F[0-7](?:[89AB][0-9A-F]){3}|[0-9A-F]{2}"

    def left(spans: str) -> str:
        at, to = "case when k = 0 then 0 else ends[k] end", "case when k = len(starts) then n else starts[k + 1] end"
        return f"(select h.r, array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(x, 2 * ({at}) + 1, 2 * (({to}) - ({at})))), '') as kept, gone, spans from h join (select r, list(a order by a) as starts, list(b order by a) as ends, sum(b - a) as gone, count(*) as spans from {spans} group by r) using (r))"

    return f"""with h as (select doc_id, text, row_number() over () as r, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from {table}),
    w as (select r, s, md5(substr(x, 2 * s + 1, {2 * length})) as k from (select r, x, unnest(range(0, n - {length - 1})) as s from h where n >= {length})),
    i as (select r, s, s - coalesce(lag(s) over (partition by r order by s), -1 - {length}) > {length} as fresh from w where k in (select k from w group by k having count(*) > 1)),
    spans as (select r, min(s) as a, max(s) + {length} as b from (select r, s, sum(fresh::int) over (partition by r order by s) as island from i) group by r, island),
    z as (select r, z, idx, sum(strlen(z)) over (partition by r order by idx) as e from (select r, unnest(l) as z, unnest(range(1, len(l) + 1)) as idx from (select r, regexp_extract_all(t, '{word}+|{white}+') as l from h))),
    l as (select r, list(z order by idx) as l, list((e - strlen(z))::bigint order by idx) as la, list(e::bigint order by idx) as le from z where regexp_matches(z, '^{word}') group by r having count(*) >= {words}),
    v as (select r, md5(array_to_string(list_slice(l, p, p + {words - 1}), ' ')) as k, la[p] as a, le[p + {words - 1}] as b from (select r, l, la, le, unnest(range(1, len(l) - {words - 2})) as p from l)),
    u as (select r, a, b from spans union all select r, a, b from v where k in (select k from v group by k having count(*) > 1)),
    o as (select r, a, b, a > coalesce(max(b) over (partition by r order by a, b rows between unbounded preceding and 1 preceding), -1) as fresh from u),
    passages as (select r, min(a) as a, max(b) as b from (select r, a, b, sum(fresh::int) over (partition by r order by a, b rows unbounded preceding) as island from o) group by r, island)
    select doc_id, n::bigint as n_bytes, coalesce(s.gone, 0)::bigint as n_removed, coalesce(s.spans, 0)::bigint as n_spans, sha256(unhex(coalesce(s.kept, x))) as kept_sha256,
    case when p.kept is null then text else decode(unhex(array_to_string(list_filter(regexp_extract_all(p.kept, '{whole}'), lambda y: length(y) > 2 or y < '8'), ''))) end as text
    from h left join {left("spans")} s using (r) left join {left("passages")} p using (r)"""
