"""Toxicity, peak concurrency and conversation repair against plain versions, and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from syntarel.llm import concurrency, conversations, toxicity

# -- conversations ----------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, gone boolean"


def plain_faults(rows):
    """(blank, duplicate, truncated) of ordered (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, most_inserts=2):
    """All edit scripts of a short conversation, the cheapest and then least one: (cost, audit, repaired lines)."""
    faults, best = plain_faults(rows), None
    for ops in itertools.product(*[["D"] if f in (0, 1) else ["K", "D", "user", "assistant"] for f in faults]):
        for n in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product(["user", "assistant"], repeat=n):
                    cost, audit, turns = 5 * n, "", []
                    for k in range(len(rows) + 1):
                        for p, role in zip(places, roles, strict=True):
                            if p == k:
                                audit += "I"
                                turns.append((role, ""))
                        if k < len(rows):
                            op, (_, role, text) = ops[k], rows[k]
                            cost += {"K": 0, "D": 2}.get(op, 1) + 5 * (op != "D" and faults[k] == 2)
                            audit += op if op in "KD" else "R"
                            if op != "D":
                                turns.append((role if op == "K" else op, text))
                    if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
                        way = (cost, audit, [f"{r}:{t}" for r, t in turns])
                        best = way if best is None or way < best else best
    return best


def plain_summary(rows):
    """The whole expected row of ordered (turn, role, text), but for the edits."""
    faults = plain_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count(0), faults.count(1), faults.count(2), illegal)


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def random_conversation(rng, n):
    return [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["", " \n", "Yes.", "Yes.", "No!", "Well?", "broken", "off \t", "ends. \n"])) for _ in range(n)]


def test_repairs_against_all_edit_scripts(spark):
    rng = random.Random(5)
    convs = {i: random_conversation(rng, rng.randrange(0, 6)) for i in range(150)}
    rows = [(i, *r, None) for i, c in convs.items() for r in c] + [(i, 9, "user", "gone.", True) for i in convs if not convs[i] or i % 3 == 0]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    assert set(got) == set(convs)
    for i, c in convs.items():
        ordered = plain_order(c)
        cost, audit, lines = plain_repair(ordered)
        assert got[i] == (*plain_summary(ordered), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), (i, ordered)


def test_moves_insert_where_deleting_is_dear(monkeypatch):
    monkeypatch.setattr(conversations, "INSERT", 1)
    monkeypatch.setattr(conversations, "DELETE", 9)
    best = {m[:3]: m[3:] for m in conversations._moves()}
    # An assistant's row at the start takes a user's before it, rather than going or changing sides.
    assert best[9, 0, 3] == (1, "IK") and best[9, 0, 2] == (1, "R") and best[6, 2, 2] == (1, "IK")


def plain_walk(rows):
    """Least cost and audit of a conversation of any length, a row at a time over the same grammar."""
    faults, best = plain_faults(rows), {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, cost + 2, audit + "D", lines)]
            if fault not in (0, 1):
                more = 5 * (fault == 2)
                after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
                if role[:1] in after:
                    ways.append((after[role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                other = "assistant" if state == 2 else "user"
                ways.append((after[other[0]], cost + more + 1, audit + "R", [*lines, f"{other}:{text}"]))
            for s, c, a, x in ways:
                if s not in new or (c, a) < new[s][:2]:
                    new[s] = (c, a, x)
        best = new
    return min(v for s, v in best.items() if s in (0, 3))


@pytest.mark.parametrize("block", [20_000, 700])
def test_long_conversations_over_pieces_and_blocks(spark, block, monkeypatch):
    """Insertions never pay, as deleting a neighbour is cheaper, so the plain walk has none."""
    rng = random.Random(8)
    long = [(k, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {k}.", f"broken {k}", "", "Same."])) for k in range(1900)]
    rows = [(7, *r, False) for r in long] + [(8, k, "user", f"{k}.", False) for k in range(600)] + [(9, 0, "user", "Hi.", False)]
    ordered = conversations.in_order(spark.createDataFrame(rows, TURNS)).toPandas()
    # The task's function, on Arrow batches cut anywhere.
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    frame = conversations.repair(spark.createDataFrame(rows, TURNS).coalesce(1))
    got = {r[0]: tuple(r)[1:] for r in frame.collect()}
    assert len(ordered) == len(rows)
    for i in (7, 8, 9):
        own = plain_order([r[1:4] for r in rows if r[0] == i])
        cost, audit, lines = plain_walk(own)
        assert got[i] == (*plain_summary(own), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_blocks_cut_conversations_anywhere():
    """The state carried from piece to piece gives what one piece gives."""
    import pyarrow as pa

    batches = [pa.record_batch({"x": list(range(a, a + 300))}) for a in range(0, 3000, 300)]
    assert [t.num_rows for t in conversations._blocks(iter(batches))] == [3000]
    rng = random.Random(2)
    rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"A {k}.", f"b {k}"])) for k in range(60)]
    kinds = [3 * " sua".find(r[1][0]) + (0 if r[2][-1] == "." else 2) if r[1][0] in "sua" else (0 if r[2][-1] == "." else 2) for r in rows]
    moves = {}
    for kind, source, target, cost, letters in conversations._moves():
        moves.setdefault((kind, source), []).append((target, cost, letters))

    def ways(a, b):
        out = []
        for origin in range(4):
            best = {origin: (0, "")}
            for kind in kinds[a:b]:
                new = {}
                for s, (c, x) in best.items():
                    for t, more, letters in moves[kind, s]:
                        new[t] = min(new.get(t, (10**9, "")), (c + more, x + letters))
                best = new
            out += [(origin, s, c, x) for s, (c, x) in best.items()]
        return out

    cost, audit, lines = plain_walk(rows)
    for cuts in ([0, 60], [0, 1, 2, 30, 59, 60], list(range(61))):
        state = conversations._State()
        for a, b in zip(cuts, cuts[1:], strict=False):
            state.advance(ways(a, b), [r[1:] for r in rows[a:b]], closes=b == 60)
        assert state.result()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rng = random.Random(11)
    rows = [(i if i else None, *r, None) for i in range(40) for r in random_conversation(rng, rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, TURNS)
    found = conversations.repair(df)
    turns = {}
    for r in conversations.repaired_turns(df, found).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_damage_and_odd_conversations(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(30) for t in range(5)] + [(None, None, None, None), (99, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"gone": F.lit("x"), "kind": F.lit(1), "piece": F.lit(2)})
    got = {}
    for r in conversations.damage(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text, what == 0)
        assert got[c, t] == [one] * (2 if what == 3 else 1)
    found = conversations.repair(conversations.damage(df))
    assert found.count() == 32
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0
    none = conversations.repair(spark.createDataFrame([(1, 1, "user", "x", True)], TURNS)).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- peak concurrency -------------------------------------------------------

SPANS = "key int, start long, end long, amount long"


def plain_open(spans):
    steps = {}
    for key, start, end, amount in spans:
        if key is None or start is None or (end is not None and end <= start):
            continue
        for whose in (key, -2):
            for at, sign in ((start, 1), (end, -1)):
                if at is not None:
                    n, a = steps.setdefault(whose, {}).get(at, (0, 0))
                    steps[whose][at] = (n + sign, a + sign * (amount or 0))
    out = set()
    for whose, at in steps.items():
        n = a = high = 0
        rows = []
        for moment in sorted(m for m, d in at.items() if d != (0, 0)):
            n, a = n + at[moment][0], a + at[moment][1]
            high = max(high, n)
            rows.append((moment, n, a, high))
        for k, (moment, n, a, h) in enumerate(rows):
            out.add((whose, moment, rows[k + 1][0] if k + 1 < len(rows) else None, n, a, h, n == high))
    return out


def test_open_spans_against_plain(spark):
    rng = random.Random(4)
    spans = []
    for _ in range(1500):
        start = rng.choice([rng.randrange(-3, 400) * 900, rng.randrange(0, 5) * 86_400 * 300, -62_135_596_800, 250_000_000_000 // 900 * 900])
        spans.append((rng.choice([1, 1, 1, 2, 3, -1]), start, rng.choice([None, start + 900 * rng.randrange(-1, 200), start + 86_400 * rng.randrange(1, 90_000)]), rng.choice([0, None, 5, -7, 10**12])))
    spans += [(None, 0, 900, 1), (5, None, 900, 1), (6, 0, 900, 4), (6, 0, 900, -4), (6, 900, 1800, 4), (6, 900, 1800, -4)]
    df = spark.createDataFrame(spans, SPANS).repartition(7).withColumns({"range": F.lit("x"), "at": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    got = [tuple(r) for r in concurrency.open_spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_open(spans)
    assert concurrency.open_spans(df.limit(0)).count() == 0


def test_sale_spans_of_odd_rows_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    begin = datetime(2024, 3, 31, 1, 59, 59)
    sales = [(1, 10, 1.005, begin), (2, 11, None, begin), (3, None, 2.5, begin), (4, 12, 3.0, None), (5, 99, float("nan"), begin), (None, 10, 1.0, begin), (6, 13, 7.0, begin), (1, 10, 1.005, begin)]
    lines = [(1, begin + timedelta(days=2)), (1, None), (1, begin + timedelta(hours=1)), (2, begin), (3, begin - timedelta(days=1)), (None, begin + timedelta(days=9)), (5, begin + timedelta(minutes=20))]
    clients = [(10, 4), (11, 4), (12, 5), (13, None), (None, 7), (10, 6)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour is left out on that night
        tables = [spark.createDataFrame(r, s) for r, s in ((sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz"), (lines, "sale_id long, shipped_at timestamp_ntz"), (clients, "client_id long, nation_id int"))]
        got = sorted(map(tuple, concurrency.sale_spans(*tables).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    base = int((datetime(2024, 3, 31, 1, 45) - datetime(1970, 1, 1)).total_seconds())
    assert got == sorted([(4, base, base + 2 * 86_400, 100), (4, base, base + 2 * 86_400, 100), (-1, base, base + 1800, 0), (4, base, None, 100), (-1, base, None, 700)], key=repr)


# -- toxicity ---------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"\w+", (text or "").lower())
    found = {("word", w) for w in words} | {("stem", n, w[:n]) for n in toxicity.STEMS for w in words if len(w) > n}
    for gaps in toxicity.GAPS:
        places = [0, *itertools.accumulate(gaps)]
        found |= {(gaps, *[words[k + p] for p in places]) for k in range(len(words) - places[-1])}
    return found


def test_features_are_those_of_the_text():
    rng = random.Random(1)
    for text in (None, "", "...", "one", "one two", *[" ".join(rng.choice(["a", "bb", "longest", "longer words", "été", "x" * 40]) for _ in range(n)) for n in (3, 5, 9, 200)]):
        got, want = len(np.unique(toxicity.features(text))), len(plain_features(text))
        assert want - 2 <= got <= want  # some may share a bucket


def test_weights_against_a_plain_loop():
    """Coordinate by coordinate over dictionaries, in the same order of documents."""
    rng = np.random.default_rng(6)
    bags = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.uint32) for _ in range(120)]
    labels = np.array([float(3 in b) for b in bags])
    model = toxicity.fit(bags, labels, l1=2.0, epochs=3, seed=9)
    z, n, order, a, b, l2 = {}, {}, np.random.default_rng(9), 1.0, 1.0, 0.1

    def weight(k):
        least = 0.0 if k == "c" else 2.0
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= least else -(x - np.sign(x) * least) / ((b + np.sqrt(n[k])) / a + l2)

    for _ in range(3):
        for i in order.permutation(len(bags)):
            at = [*bags[i].tolist(), "c"]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for k in at:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / a * w[k]
                n[k] = old + g * g
    want = {k: weight(k) for k in z if k != "c" and weight(k)}
    assert dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert model.intercept == pytest.approx(weight("c")) and 3 in want and len(want) < 40


def toxic_corpus(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        if bad := rng.random() < 0.2:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_and_odd_rows(spark, monkeypatch):
    rows = toxic_corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None), (10_000, 1), (1, 7)], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    right = [(scored[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert sum(right) >= 0.97 * len(right) and len(model.buckets) < 2000
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "!!", "x"), (3, "vile " * 40_000, "x")], "doc_id long, text string, score string")
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == 5 and len({r.score for r in got[:4]}) == 1 and all(0 <= r.score <= 1 for r in got) and got[4].score > 0.5
    # Documents that don't fit the sample are passed over, but never all of them.
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 2000)
    assert isinstance(toxicity.train_toxicity_model(docs, labels), (toxicity.SparseModel, float))
    assert toxicity.train_toxicity_model(docs, labels.where("toxic = 1")) == 1.0
    assert toxicity.train_toxicity_model(docs.limit(0), labels) == 0.5
    assert {r.score for r in toxicity.score_toxicity(odd, 0.5).collect()} == {0.5}


# -- languages without a limit, long labelled documents ---------------------


def test_three_hundred_languages(spark):
    """Blocks of languages give what one model of all of them gives."""
    from syntarel.llm import language_id

    rng = random.Random(7)
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçß", 6) for _ in range(300)]
    prose = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    rows = [(k, prose(k, 120), f"l{k:03d}") for k in range(300)] + [(1000 + k, prose(k, 60), None) for k in range(0, 300, 7)] + [(2000, prose(3, 60) + " " + prose(290, 60), None), (2001, None, None), (2002, "12 !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train_language_model(docs)
    assert isinstance(model, language_id.LanguageBlocks) and len(model.names) == 300
    got = {r.doc_id: r.language for r in language_id.detect_language(docs, model).collect()}
    parts = list(model.models())
    whole = language_id.LanguageModel([n for p in parts for n in p.names], np.concatenate([p.probabilities for p in parts], 1))
    assert len(parts) == 2 and len(got) == len(rows)
    for i, text, _ in rows:
        name, score, shares = whole.infer(text)
        assert got[i].lang_pred == name and got[i].score == pytest.approx(score, abs=2e-2), i
        assert set(got[i].shares) == set(shares)
    assert [got[1000 + k].lang_pred for k in range(0, 300, 7)] == [f"l{k:03d}" for k in range(0, 300, 7)]
    assert got[2001].lang_pred == got[2002].lang_pred == "und"


def test_labelled_documents_that_are_all_too_long(spark, monkeypatch):
    from syntarel.llm import quality_model

    monkeypatch.setattr(quality_model, "SAMPLE_PASSAGES", 40)
    long = lambda w: " ".join(f"{w}{i % 91}" for i in range(9000))
    docs = spark.createDataFrame([(1, long("good")), (2, long("BAD !! ")), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality_model.train_quality_model(docs, labels)
    scores = {r.doc_id: r.score for r in quality_model.score_documents(docs, model).collect()}
    assert len(scores) == 3 and scores[1] > scores[2]
    assert quality_model.train_quality_model(docs, labels.where("doc_id = 1")) == 1.0
    one = np.arange(20).reshape(10, 2)
    assert quality_model.sampled(one, None).shape == (10, 2) and quality_model.sampled(one, 3)[:, 0].tolist() == [0, 8, 18]


def test_one_labelled_document_of_many_megabytes(spark):
    from syntarel.llm import quality_model

    docs = spark.createDataFrame([(1, "some words here. " * (14_000_000 // 17))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_model.train_quality_model(docs, labels) == 1.0
