"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over
the counts of vote patterns estimates each rule's accuracy and the share of
good documents; the posterior probability of good replaces all-must-pass
filtering.

Every kind of defect is looked at by several rules that err in different ways,
so that one bad vote can be outweighed by the others and two or three
that agree can't. So thresholds are strict: a rule may well be wrong about one
document in twenty, and its estimated accuracy says what that is worth.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Rules in the order of their digit in a vote pattern: (name, votes good up to or from, votes bad from or up to).
#: The first number is on the good side of the second; a share between them is an abstention.
RULES = (
    ("symbols_a_word", 0.02, 0.1),
    ("words_with_symbols", 0.02, 0.1),
    ("words_without_letters", 0.02, 0.08),
    ("letters_of_characters", 0.955, 0.935),
    ("upper_case_letters", 0.04, 0.06),
    ("shouted_words", 0.01, 0.03),
    ("exclamations_a_word", 0.03, 0.2),
    ("repeated_windows", 0.05, 0.12),
    ("words_like_the_last", 0.02, 0.035),
    ("different_words", 0.75, 0.6),
    ("duplicate_lines", 0.1, 0.3),
    ("long_or_short_words", 0.05, 0.07),
)
_SYMBOL, _LETTER = frozenset(SYMBOLS.decode()), re.compile(r"[^\W\d_]")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = T.StructType([*(T.StructField(x, T.LongType()) for x in _COUNTS), T.StructField("pattern", T.IntegerType())])


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pairs = np.unique(at[:-2] * len(ids) + at[1:-1], return_inverse=True)[1].astype(np.int64)
    _, which, count = np.unique(pairs * len(ids) + at[2:], return_inverse=True, return_counts=True)
    many = count[which] > 1
    if not many.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= many
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of a text and the pattern of its votes (base 3, vote + 1 per digit)."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()  # bytes split on space and \x09-\x0d only
    n = len(words)
    solid = b"".join(words)
    decoded = solid.decode("utf-8", "surrogatepass")
    chars = len(decoded)
    symbols = sum(map(solid.count, (bytes([b]) for b in SYMBOLS)))
    lines = [x for x in body.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = _repeated(words)
    if not n:
        return 0, 0, 0, 0, 0, 3 ** len(RULES) // 2
    kinds = Counter(words)
    of_kind = [(w.decode("utf-8", "surrogatepass"), k) for w, k in kinds.items()]
    letters = sum(decoded.count(c) for c in set(decoded) if c.isalpha())
    upper = sum(decoded.count(c) for c in set(decoded) if c.isupper())
    few = n < 20  # too few words to tell repetition
    shares = (
        symbols / n,
        sum(k for w, k in of_kind if not _SYMBOL.isdisjoint(w)) / n,
        sum(k for w, k in of_kind if not _LETTER.search(w)) / n,
        letters / chars,
        upper / max(1, letters),
        sum(k for w, k in of_kind if len(w) > 1 and w.isupper()) / n,
        solid.count(b"!") / n,
        None if few else repeat / n,
        None if few else sum(map(bytes.__eq__, words, words[1:])) / n,
        None if few else len(kinds) / min(n, 200),
        None if len(lines) < 2 else dup / len(lines),
        sum(k for w, k in of_kind if not 2 <= len(w) <= 12) / n,
    )
    pattern = 0
    for share, (_, good, bad) in zip(shares, RULES, strict=True):
        vote = 0
        if share is not None:
            if bad < good:
                share, good, bad = -share, -good, -bad
            vote = 1 if share <= good else -(share >= bad)
        pattern = pattern * 3 + vote + 1
    return n, chars, symbols, dup, repeat, pattern


def estimate(counts: dict[int, int], rules: int = len(RULES), iterations: int = 500) -> tuple[np.ndarray, float, dict[int, float]]:
    """Accuracies on good and on bad documents (2 x rules), share of good documents, and P(good) of each pattern.

    A rule's two accuracies are estimated among its votes; abstentions carry
    no evidence. The only prior is that of ten votes a rule and class, nine (five)
    of them right on good (bad) documents, and ten documents, eight of them good;
    beyond that the estimates are free. Patterns number at most 3 ** rules.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[p // 3 ** (rules - 1 - j) % 3 - 1 for j in range(rules)] for p in patterns], float).reshape(len(patterns), rules)
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    of_good, of_bad, share = np.full(rules, 0.95), np.full(rules, 0.4), 0.8
    good = np.zeros(len(patterns))
    for _ in range(iterations if len(patterns) else 0):
        odds = yes @ np.log(of_good / (1 - of_bad)) + no @ np.log((1 - of_good) / of_bad) + np.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        g, b = n * good, n * (1 - good)
        new_good = (g @ yes + 9) / (g @ (yes + no) + 10)
        new_bad = (b @ no + 5) / (b @ (yes + no) + 10)
        share = float((g.sum() + 8) / (n.sum() + 10))
        moved = max(np.abs(new_good - of_good).max(), np.abs(new_bad - of_bad).max())
        of_good, of_bad = new_good, new_bad
        if moved < 1e-9:
            break
    return np.stack([of_good, of_bad]), share, dict(zip(patterns, good.tolist(), strict=True))


def score_quality(docs: DataFrame, text: str = "text", into: str = "rules", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and struct ``into``: the counts, ``pattern`` and ``p_good``.

    Whole texts are measured; a null or empty text has no words, all rules
    abstain on it and it gets the share of good documents. All rows stay. What is
    kept is written once, so the texts are measured once. Only
    pattern counts (3 ** 12 rows at most) reach the driver and come back.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in texts], columns=[*_COUNTS, "pattern"])

    udf = F.pandas_udf(run, FEATURES).asNondeterministic()
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != into] if keep is None else keep
    kept = materialize(docs.withColumn(into, udf(F.col(text).cast("string"))).select(*names, into), "rules")
    counts = {r[0]: r[1] for r in kept.groupBy(F.col(f"{into}.pattern")).count().collect()}
    _, share, good = estimate(counts)
    table = docs.sparkSession.createDataFrame([(int(p), float(g)) for p, g in good.items()], "`__pattern` int, `__good` double")
    joined = kept.join(F.broadcast(table), F.col(f"{into}.pattern") == F.col("__pattern"), "left")
    return joined.withColumn(into, F.col(into).withField("p_good", F.coalesce("__good", F.lit(share)))).drop("__pattern", "__good")
