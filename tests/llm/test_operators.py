"""The corpus operators against plain versions, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from syntarel.llm import common, components, fingerprint, language_id, mixing, near_dedup, packing, quality_model, quality_rules, repeats, sharding, url_filter
from syntarel.operators import ordering

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a long one, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, " \n\t ", None, "a", 4), (3, long, "en", "a", len(long)), (4, "Tiny text.", "de", "b", 10), (4, "Tiny text.", "de", "b", 10), (5, None, "en", "a", None), (None, "no id here at all", "en", "b", 17), (6, "12345 !!", "en", "b", 8)]
    return frame(spark, rows, DOCS).withColumns({"score": F.lit("x"), "topic": F.lit(1), "rank": F.lit(2), "length": F.lit(None).cast("int")})


# -- URL filter -------------------------------------------------------------

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = []
    for _, rule in RULES:
        name, slash, more = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + more):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_ratio(spark):
    rng = random.Random(3)
    urls = [f"https://{rng.choice(['www', 'm', 'x'])}.{rng.choice(['aa', 'bb'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(300)}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "HTTP://ORG/", "http://org", "http://Example.ORG/es/x?q#f", "http://notexample.org/es/", "a://b://c/d", "http://example.org/en/1", "http://x.com/fr/\nnew", "http://é.org/ü"]
    pages = frame(spark, list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, RULES).collect()}
    assert len(got) == len(urls)
    verdicts = dict((r, v) for v, r in RULES)
    for i, url in enumerate(urls):
        host, path, rule = plain_rule(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdicts[rule] if rule else "allow" if r.ratio >= r.threshold else "block")
    free = [(u, got[i].verdict) for i, u in enumerate(urls) if u and ".net/" in u]
    good = [v == ("block" if "/es/" in u or "/de/" in u or re.search("/en/1", u) else "allow") for u, v in free]
    assert sum(good) > 0.8 * len(good)
    # Against the model worked out in Python.
    ruled = [(u, verdicts[plain_rule(u)[2]] == "allow") for u in urls if plain_rule(u)[2] and zlib.crc32(u.encode()) % 3 != 2]
    for i in (0, 5, 77, 600, 601, 602, 606):
        assert got[i].ratio == pytest.approx(plain_ratio(ruled, urls[i]), abs=1e-5)


def plain_codes(url):
    bare = re.sub(r"(?s)^[^/?#]*?://", "", url or "", count=1).translate({i: i + 32 for i in range(65, 91)})
    return [url_filter.SYMBOLS.find(c) if c in url_filter.SYMBOLS else 39 for c in bare]


def plain_ratio(ruled, url, least=4, strength=4.0):
    counts = {k: {True: Counter(), False: Counter()} for k in range(4)}
    for u, ok in ruled:
        s = [39] * 3 + plain_codes(u)
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][ok][(tuple(s[i - k : i]), s[i])] += 1
    totals = {k: {ok: Counter() for ok in (True, False)} for k in range(4)}
    for k in range(4):
        for ok in (True, False):
            for (c, _), n in counts[k][ok].items():
                totals[k][ok][c] += n

    def p(ok, c, x):
        q = p(ok, c[1:], x) if c else 1 / 40
        return (counts[len(c)][ok][(c, x)] + strength * q) / (totals[len(c)][ok][c] + strength)

    s = [39] * 3 + plain_codes(url)
    total = 0.0
    for i in range(3, len(s)):
        k = next(k for k in (3, 2, 1, 0) if k == 0 or totals[k][True][tuple(s[i - k : i])] + totals[k][False][tuple(s[i - k : i])] >= least)
        c = tuple(s[i - k : i])
        total += np.log(p(True, c, s[i]) / p(False, c, s[i]))
    return total / max(1, len(s) - 3)


def test_url_filter_without_rules_or_rows(spark):
    pages = frame(spark, [(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} <= {"allow", "block"}
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


# -- mixing -------------------------------------------------------------------


def test_rake_meets_margins_and_calibrates(spark):
    rng = random.Random(5)
    cells = [(f"s{i}", lang, t, float(rng.randrange(50, 5000))) for i in range(6) for lang in ("en", "de") for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    targets = {"lang": {"en": 0.3, "de": 0.7}, "source": {"s0": 0.5}}
    raked = mixing.rake(df, targets, sweeps=30)
    by = {r.lang: r.w for r in raked.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert by["en"] == pytest.approx(0.3, abs=1e-4) and by["de"] == pytest.approx(0.7, abs=1e-4)
    assert raked.where("source = 's0'").agg(F.sum("weight")).first()[0] == pytest.approx(0.5, abs=1e-4)
    rates = mixing.calibrate(raked, 0.6)
    assert rates.where("rate > 1 or rate < 0").count() == 0
    assert rates.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] == pytest.approx(0.6 * sum(c[3] for c in cells), rel=1e-6)


def nearly_one_language(seed, main=0.9):
    """Cells of sources that are nearly of one language, one of them with a third of all tokens."""
    rng = np.random.default_rng(seed)
    cells = []
    for i in range(12):
        lang = rng.dirichlet(np.ones(5)) * (1 - main)
        lang[i % 5] += main
        size = 1e8 if i == 0 else 2e8 / 11
        cells += [(f"s{i}", f"l{j}", f"t{k}", float(int(size * a * b) + 1)) for j, a in enumerate(lang) for k, b in enumerate(rng.dirichlet(np.ones(5)))]
    return cells


def test_rake_meets_margins_of_sources_of_nearly_one_language(spark):
    cells = nearly_one_language(1)
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")).collect()
    total = sum(c[3] for c in cells)
    for at, margin in enumerate(mixing.MARGINS):
        sums, have = Counter(), Counter()
        for c in cells:
            sums[c[at]] += (c[3]) / total
        for r in got:
            have[r[margin]] += r.weight
        raw = {v: x**mixing.TEMPER for v, x in sums.items()}
        for v, x in raw.items():
            assert have[v] == pytest.approx(x / sum(raw.values()), rel=2e-6)


def test_rake_reports_targets_that_cannot_hold(spark):
    cells = [("a", "en", "x", 80.0), ("b", "de", "x", 20.0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    with pytest.warns(UserWarning, match="off its target"):
        got = mixing.rake(df, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}})
    assert got.where("weight > 0 and weight < 1").count() == 2


def test_mix_on_odd_rows(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "mixing"]
    assert got.where("mixing.taken is null or mixing.rate is null").count() == 0
    assert got.where("doc_id = 4").select("mixing").distinct().count() == 1
    assert mixing.mix(odd.limit(0)).count() == 0


# -- near-duplicates ------------------------------------------------------------


def plain_sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def plain_components(sets, percent=80):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(9)
    rows, base = [], [words(rng, 120) for _ in range(6)]
    for i in range(330):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(w)))
    rows += [(2000, "a b"), (2001, "A  B"), (2002, "a b c"), (2003, ""), (2004, None), (2005, " "), (2006, "É b"), (2007, "é b"), (2008, "a b c d e f"), (2009, "A\tB\nC D e f")]
    sets = plain_sets(rows, 4)
    want = plain_components(sets)
    got = near_dedup.near_classes(frame(spark, rows), width=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i, _ in rows}
    assert len(set(want.values())) > 20


def test_near_classes_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(1)
    base = words(rng, 150)
    rows = []
    for i in range(120):
        w = base.split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = plain_sets(rows, 5)
    assert {r.doc_id: r.component_id for r in near_dedup.near_classes(frame(spark, rows)).collect()} == plain_components(sets)


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 3000
        common_ = rng.integers(0, 1 << 63, int(n * 2 * share / (1 + share)), np.uint64)
        a = np.concatenate([common_, rng.integers(0, 1 << 63, n - len(common_), np.uint64)])
        b = np.concatenate([common_, rng.integers(0, 1 << 63, n - len(common_), np.uint64)])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        assert near_dedup.joint_estimate(x[None], y[None], np.array([n]), np.array([n]))[0] == pytest.approx(share, abs=0.17)
        assert (np.maximum(x, y) == near_dedup.sketch(np.concatenate([a, b]))).all()


def test_near_classes_on_odd_rows(spark, odd):
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == odd.count()
    assert sorted(r.component_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 4, 5, 6]
    assert near_dedup.near_classes(odd.limit(0)).count() == 0


def test_near_classes_of_rows_without_ids(spark):
    rng = random.Random(14)
    base = words(rng, 100)
    near = lambda k: " ".join([*base.split()[:-1], f"x{k}"])
    other = words(rng, 80)
    rows = [(None, near(1)), (None, near(1)), ((1 << 62) + (1 << 61), near(2)), (-5, words(rng, 90)), (None, other), (None, other + " more"), (None, ""), (None, None), (7, "")]
    got = near_dedup.near_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.component_id) for r in got) == sorted(map(str, [(1 << 62) + (1 << 61)] * 3 + [-5, None, None, None, None, 7]))
    groups = Counter(r.first for r in got)
    assert sorted(groups.values()) == [1, 1, 2, 2, 3]  # null and empty texts are one document, linked with nothing
    assert all(any(x.document == r.first for x in got) for r in got)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (100, 101)]
    got = {r.id: r.component for r in components.connected_components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# -- repeats ----------------------------------------------------------------------


def plain_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        on = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                on[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, on, strict=True) if not y)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(on))), kept))
    return out


def corpus_with_passages(seed, length):
    rng = random.Random(seed)
    passage = words(rng, length // 3)[: length * 2]
    texts = []
    for _ in range(60):
        t = words(rng, rng.randrange(5, 200), 10**6)
        if rng.random() < 0.6:
            at, a = rng.randrange(len(t)), rng.randrange(len(passage) // 2)
            t = t[:at] + passage[a : a + rng.randrange(length - 20, len(passage))] + t[at:]
        texts.append(t)
    texts += [texts[0], texts[0], "é" * (length + 10), "ab" * length, "", None, "x" * (length - 1), "x" * (length - 1)]
    return texts


@pytest.mark.parametrize("hot", [False, True])
def test_cut_repeats_against_every_string(spark, monkeypatch, hot):
    if hot:  # every key is counted window by window
        monkeypatch.setattr(repeats, "HOT_KEY", 0)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4096)
    texts = corpus_with_passages(2, 400)
    got = {r.doc_id: r.repeats for r in repeats.cut_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, want in enumerate(plain_cut(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want
    assert sum(r.n_removed > 0 for r in got.values()) > 20


def plain_cut_words(texts, length, size):
    """What plain_cut removes, and all sequences of ``size`` words found twice."""
    raw = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    grams = [[tuple(b[x:y] for x, y in w[i : i + size]) for i in range(len(w) - size + 1)] for b, w in zip(raw, at, strict=True)]
    count = Counter(g for x in grams for g in x)
    strings = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b, w, g in zip(raw, at, grams, strict=True):
        on = bytearray(len(b))
        for x, y in [(i, i + length) for i in range(len(b) - length + 1) if strings[b[i : i + length]] > 1] + [(w[i][0], w[i + size - 1][1]) for i in range(len(g)) if count[g[i]] > 1]:
            on[x:y] = b"\1" * (y - x)
        out.append(bytes(x for x, y in zip(b, on, strict=True) if not y))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_cut_repeats_of_short_words(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "HOT_KEY", 0)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4096)
    rng = random.Random(4)
    passage = [rng.choice("abcdefghijklmnop") for _ in range(80)]
    texts = corpus_with_passages(3, 400)
    for n in (50, 51, 52, 80, 51, 50):
        texts.append(words(rng, 40, 10**6) + " " + rng.choice([" ", "\n\n", "\t"]).join(passage[:n]) + " " + words(rng, 40, 10**6))
    got = {r.doc_id: r.repeats for r in repeats.cut_repeats(frame(spark, list(enumerate(texts))), words=51).collect()}
    for i, want in enumerate(plain_cut_words(texts, 400, 51)):
        assert (got[i].text or "") == want.decode("utf-8", "ignore")
    for i, want in enumerate(plain_cut(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want
    assert [len(got[len(texts) - 6 + k].passage_spans) for k in range(6)] == [0, 1, 1, 1, 1, 0]


def test_index_statistics_against_all_pairs():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(12)] + [b"aaaaaaaaaa", b"", b"abab" * 10]
    index = repeats.RunLengthIndex(texts)
    stats = index.matching_statistics()
    every = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    copied = repeats.RunLengthIndex(texts, [1 + (k == 3) for k in range(len(texts))])
    for k, i in every[:150]:
        best = 0
        if k == 3:
            assert copied.matching_statistics()[index.starts[k] + i] == len(texts[k]) - i
        for m, j in every:
            if (m, j) != (k, i):
                n = 0
                while i + n < len(texts[k]) and j + n < len(texts[m]) and texts[k][i + n] == texts[m][j + n]:
                    n += 1
                best = max(best, n)
        assert stats[index.starts[k] + i] == best
    assert index.lengths.sum() == index.n and len(index.above) == len(index.below) == len(index.symbols) < index.n


def test_fragments_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 1000)
    raw = np.frombuffer(words(random.Random(1), 2000).encode(), np.uint8)
    keys, first, last = repeats.fragments(raw)
    assert [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)] == list(range(len(raw) - 399))
    assert len(keys) == len(first)


def test_cut_repeats_on_odd_rows(spark, odd):
    got = repeats.cut_repeats(odd)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "repeats"]
    assert got.where("doc_id = 3").first().repeats.n_removed > 0  # a text that repeats itself
    assert repeats.cut_repeats(odd.limit(0)).count() == 0


# -- sharding ------------------------------------------------------------------------


def test_shards_round_trip_and_tiers(spark, odd):
    root = common.new_path(spark, "test-shards")
    store = sharding.ShardStore(spark, root, target=1 << 20, fan=3, unit=1 << 10)
    rng = random.Random(6)
    rows = [(i, words(rng, 300), "en", "s", 1) for i in range(400)]
    for k in range(10):
        store.append(frame(spark, rows[k * 40 : k * 40 + 40], DOCS, 2))
        store.compact()
        assert all(sum(store.tier(r) == t for r in store.runs()) < 3 for t in range(20))
    got = store.read()
    assert sorted(map(tuple, got.select("doc_id", "text").collect())) == [(r[0], r[1]) for r in rows]
    assert sum(r["rows"] for r in store.runs()) == 400 and store.version() > 10
    base = store.version()
    store._commit(store.runs(), base)
    with pytest.raises(sharding.Conflict):
        store._commit(store.runs(), base)
    clash = odd.withColumn("shard", F.lit("own"))
    again = sharding.shard(clash, common.new_path(spark, "test-shards"), arrivals=5)
    assert sorted(map(repr, again.read().collect())) == sorted(map(repr, clash.collect()))
    assert again.read(shard="file").where("shard = 'own' and file like 'part-%'").count() == odd.count()
    assert sharding.shard(odd.limit(0), common.new_path(spark, "test-shards")).read().count() == 0


def test_replaced_runs_stay_for_a_version_and_strays_go(spark):
    store = sharding.ShardStore(spark, common.new_path(spark, "test-shards"), fan=3, unit=1 << 10)
    for k in range(3):
        store.append(frame(spark, [(k, "x")]))
    before, reader = store.version(), store.read()
    assert store.compact() == before + 1 and len(store.runs()) == 1
    assert reader.count() == store.read(before).count() == 3  # the version before can still be read
    store.append(frame(spark, [(9, "y")]))
    assert all(not store._fs().exists(store._path(f"{store.root}/{r['path']}")) for r in store.runs(before))
    lost = store._write(frame(spark, [(5, "never committed")]))
    assert store.vacuum() == [lost["path"]] and store.read().count() == 4 and store.vacuum() == []


# -- language ID ----------------------------------------------------------------------


def language_corpus(rng, n):
    kinds = {"aa": "kaloki mena tiru sopha", "bb": "strund gheft wolk breng", "cc": "xiao ñandu ça éter"}
    return [(i, " ".join("".join(rng.choice(v.split())[: rng.randrange(3, 6)] for _ in range(2)) for _ in range(rng.randrange(8, 60))), k) for i in range(n) for k, v in [rng.choice(list(kinds.items()))]]


def test_language_accuracy_and_mixtures(spark):
    rows = language_corpus(random.Random(7), 400)
    df = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.train_language_model(df.where("doc_id % 2 = 0"))
    got = language_id.detect_language(df.where("doc_id % 2 = 1"), model, into="l")
    assert got.where("l.lang_pred = lang and l.score > 0.5").count() >= 195
    a, b = next(r[1] for r in rows if r[2] == "aa"), next(r[1] for r in rows if r[2] == "bb")
    half = min(len(a), len(b))
    _, _, shares = model.infer(a[:half] + " " + b[:half])
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 0.5) < 0.2
    counts = {(r.lang, r.bucket): r.n for r in language_id.count_trigrams(df).collect()}
    plain = Counter((lang, int(g)) for _, t, lang in rows for g in language_id.trigrams(t))
    assert counts == dict(plain)


def test_language_on_odd_rows(spark, odd):
    model = language_id.train_language_model(odd)
    got = language_id.detect_language(odd, model)
    assert got.count() == odd.count()
    und = {r.doc_id for r in got.where("language.lang_pred = 'und' and language.score = 0").collect()}
    assert und == {None, 1, 2, 5, 6}
    empty = language_id.train_language_model(odd.limit(0))
    assert empty.names == [] and language_id.detect_language(odd, empty).where("language.lang_pred <> 'und'").count() == 0


# -- quality rules ------------------------------------------------------------------------


def plain_measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    on = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(on)


def test_quality_counts_against_plain():
    rng = random.Random(2)
    texts = [None, "", " ", "a a a a", "a b c\na b c\n \n \na b c", "é#*\x0b&x\x85y\x1cz\u2003q", "x\ty\rz\x0cw"] + ["".join(rng.choice("ab #\n\t|é ") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert quality_rules.measure(t)[:5] == plain_measure(t), repr(t)


def plain_em(patterns, rules, steps):
    """Expectation-maximisation document by document, votes as lists."""
    right = {"good": [0.95] * rules, "bad": [0.4] * rules}
    share, posterior = 0.8, []
    for _ in range(steps):
        posterior = []
        for votes in patterns:
            good, bad = share, 1 - share
            for j, v in enumerate(votes):
                if v:
                    good *= right["good"][j] if v > 0 else 1 - right["good"][j]
                    bad *= right["bad"][j] if v < 0 else 1 - right["bad"][j]
            posterior.append(good / (good + bad))
        for j in range(rules):
            voted = [(v[j], p) for v, p in zip(patterns, posterior, strict=True) if v[j]]
            right["good"][j] = (sum(p for v, p in voted if v > 0) + 9) / (sum(p for _, p in voted) + 10)
            right["bad"][j] = (sum(1 - p for v, p in voted if v < 0) + 5) / (sum(1 - p for _, p in voted) + 10)
        share = (sum(posterior) + 8) / (len(posterior) + 10)
    return right, share, posterior


def test_quality_estimates_against_plain_and_outvoted_rule():
    rng = random.Random(12)
    rules, patterns = 5, []
    for _ in range(800):
        good = rng.random() < 0.85
        accuracy = [0.97, 0.9, 0.99, 0.95, 0.98] if good else [0.8, 0.7, 0.6, 0.9, 0.5]
        patterns.append([0 if rng.random() < 0.1 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in accuracy])
    code = lambda v: sum((x + 1) * 3 ** (rules - 1 - j) for j, x in enumerate(v))
    right, share, posterior = plain_em(patterns, rules, 30)
    accuracies, got_share, good = quality_rules.estimate(Counter(map(code, patterns)), rules, iterations=30)
    assert got_share == pytest.approx(share, abs=1e-6)
    assert accuracies[0].tolist() == pytest.approx(right["good"], abs=1e-6) and accuracies[1].tolist() == pytest.approx(right["bad"], abs=1e-6)
    # The posterior belongs to the accuracies before the last step of either.
    assert [good[code(v)] for v in patterns] == pytest.approx(posterior, abs=1e-6)
    assert good[code([1, -1, 1, 1, 1])] > 0.5 > good[code([-1, -1, -1, 1, -1])]  # one bad vote is outweighed
    assert quality_rules.estimate({}) [2] == {}


def test_quality_posteriors_find_the_bad(spark, odd):
    rng = random.Random(4)
    prose = lambda n: words(rng, n).translate({48 + i: c for i, c in enumerate("abcdefghij")})
    good = [(i, ". ".join(prose(12).capitalize() for _ in range(10)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in prose(100).split())) for i in range(30)] + [(2000 + i, (prose(100).upper().replace(" ", "!! "))) for i in range(30)]
    got = quality_rules.score_quality(frame(spark, good + bad), keep=["doc_id"])
    assert got.where("doc_id < 1000 and rules.p_good < 0.5").count() == 0
    assert got.where("doc_id >= 1000 and rules.p_good >= 0.5").count() == 0
    assert got.columns == ["doc_id", "rules"]
    strange = quality_rules.score_quality(odd)
    assert strange.count() == odd.count() and strange.where("rules.p_good is null").count() == 0
    assert quality_rules.score_quality(odd.limit(0)).count() == 0


# -- packing ------------------------------------------------------------------------------


def encode(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_tokenizer_equals_the_library():
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b", "it's <|endoftext|> a", "<|endoftext|>", "<|endoftext|> a b c", "a b <|endoftext|>", "a <|endoftext|><|endoftext|>b", "x<|endoftext|>  y", "a <|endoftext| > b", "\n<|endoftext|>\n", "a\n b \nc", "é ü 12 3!", "one", "x\x1cy z\x1f q", "\u2003a b\u2003", "a\u00a0b c", "漢字 𝄞 x"] + ["".join(rng.choice("ab 1.'\n\té<|") for _ in range(rng.randrange(80))) for _ in range(500)]
    got = packing.BatchTokenizer(TOKENIZER).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == encode(texts)
    other = packing.BatchTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranks is None and len(other.encode(["two words"])[0]) == 8


def test_pack_round_trip(spark, odd):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 20, 200, 900]))) for i in range(150)] + [(900, None), (901, ""), (902, words(rng, 9000)), (903, "a <|endoftext|> b")]
    got = packing.pack(frame(spark, rows), TOKENIZER, capacity=512).collect()
    want = dict(zip([r[0] for r in rows], encode([r[1] for r in rows]), strict=True))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length <= 512 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == [*want[i], 0]
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 512 for r in pieces[1:])
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    assert 50256 in want[903]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 512
    first_fit: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if k is None:
            first_fit.append(512)
            k = len(first_fit) - 1
        first_fit[k] -= n
    assert len(bins) <= len(first_fit)
    assert packing.pack(odd, TOKENIZER, keep_ids=False).count() >= odd.count()
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 12)))
        capacity, top = 60, max(counts)
        got = packing.fullest(counts, capacity)
        assert all(got[x] <= counts[x] for x in got) and got.get(top)
        sums = {top}
        for x in sorted(counts.elements(), reverse=True)[1:]:
            sums |= {s + x for s in sums if s + x <= capacity}
        assert sum(x * k for x, k in got.items()) == max(sums)


# -- quality classifier ------------------------------------------------------------------


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality_model.AttentionModel(hidden=5, gate=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, starts, y = rng.random((9, quality_model.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean(np.logaddexp(0, f := model.forward(x, starts)["logit"]) - y * f))
    grads = model.gradients(x, starts, y, 0.0)
    for k, g in grads.items():
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        keep = model.p[k][at]
        model.p[k][at] = keep + 1e-5
        up = loss()
        model.p[k][at] = keep - 1e-5
        down = loss()
        model.p[k][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-7)


def test_attention_forward_and_calibration():
    rng = np.random.default_rng(1)
    model = quality_model.AttentionModel(hidden=4, gate=3)
    p = model.p
    bags = [rng.random((n, quality_model.WIDTH)).astype(np.float32) for n in (1, 3, 2, 5)]
    got = model.forward(np.concatenate(bags), np.array([0, 1, 4, 6]))["logit"]
    for bag, logit in zip(bags, got, strict=True):
        embedded = [np.tanh(x @ p["E"] + p["e"]) for x in bag]
        weights = [np.exp(((np.tanh(z @ p["V"]) / (1 + np.exp(-(z @ p["U"])))) @ p["w"])[0]) for z in embedded]
        seen = sum(w * z for w, z in zip(weights, embedded, strict=True)) / sum(weights)
        assert logit == pytest.approx(float((seen @ p["c"])[0] + p["d"][0]), rel=1e-4)
    labels = (got > np.median(got)).astype(np.float32)
    model.calibrate(bags, labels)
    scores = 1 / (1 + np.exp(-np.array([model.forward(b, np.zeros(1, np.int64))["logit"][0] for b in bags])))
    assert ((scores >= quality_model.CUT) == (labels == 1)).all()


def test_classifier_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "SAMPLE_PASSAGES", 100)
    rows = [(i, "good words. " * 5 if i % 2 else "BAD !! " * 9) for i in range(40)]
    docs = frame(spark, [*rows, (99, "x" * 10**6), *rows[:3]])
    labels = frame(spark, [(i, i % 2) for i in [*range(40), 99]], "doc_id long, quality int")
    model = quality_model.train_quality_model(docs, labels)
    got = quality_model.score_documents(docs.where("doc_id < 40"), model)
    assert got.where("(score >= 0.3) = (doc_id % 2 = 1)").count() == 43
    # Where no document fits, evenly spaced passages stand for it.
    assert quality_model.train_quality_model(docs.where("doc_id = 99"), labels) == 1.0


def test_classifier_on_held_out(spark, odd):
    rng = random.Random(8)
    good = [(i, words(rng, rng.randrange(20, 300)) + ".") for i in range(200)]
    bad = [(500 + i, words(rng, 30) + " " + words(rng, rng.randrange(60, 200)).upper().replace(" ", " | ")) for i in range(120)]
    docs, labels = frame(spark, good + bad), frame(spark, [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_model.train_quality_model(docs.where("doc_id % 3 <> 0"), labels)
    got = quality_model.score_documents(docs.where("doc_id % 3 = 0"), model)
    assert got.where("(score >= 0.3) = (doc_id < 500)").count() >= 0.95 * got.count()
    strange = quality_model.score_documents(odd, model)
    assert strange.count() == odd.count() and strange.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_model.train_quality_model(docs.limit(0), labels) == 0.5
    assert quality_model.score_documents(odd, 0.5).where("score = 0.5").count() == odd.count()


# -- fingerprints ---------------------------------------------------------------------------


def test_fingerprints_follow_edits(spark, odd):
    rng = random.Random(5)
    base = words(rng, 300, 10**6).split()
    near, half, swapped = list(base), list(base), base[150:] + base[:150]
    near[100] = "changed"
    half[150:] = words(rng, 150, 10**6).split()
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(half), " ".join(reversed(base)), words(rng, 300, 10**6), " ".join(swapped)]
    got = {r.doc_id: r.signature for r in fingerprint.fingerprint(frame(spark, list(enumerate(texts)))).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(got[a], got[b], strict=True)) / fingerprint.M
    assert got[0] == got[1] and like(0, 2) > 0.85 and 0.02 <= like(0, 3) < 0.6 and like(0, 4) == like(0, 5) == 0
    assert like(0, 3) < like(0, 6) < like(0, 2)  # moved blocks keep pairs within a block
    strange = fingerprint.fingerprint(odd)
    assert strange.count() == odd.count() and strange.where("size(signature) <> 64 or signature is null").count() == 0


def test_fingerprints_follow_edits_without_spaces(spark):
    rng = random.Random(6)
    base = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    texts = [base, "一" + base, base[:900] + "一" + base[900:], base[::-1]]
    got = {r.doc_id: r.signature for r in fingerprint.fingerprint(frame(spark, list(enumerate(texts)))).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(got[a], got[b], strict=True)) / fingerprint.M
    assert like(0, 1) > 0.9 and like(0, 2) > 0.9 and like(0, 3) < 0.1


def test_occurrences_are_numbered(spark):
    texts = ["a b c " * 5, "a b c " * 6, "a b c " * 5]
    got = [r.s for r in frame(spark, list(enumerate(texts)), parts=1).select("doc_id", fingerprint.signature(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got[0] == got[2] != got[1]


def test_next_document_and_edit(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-50_000, 10**7), 200) + [10**12]
    rows = [(i, "x" * rng.randrange(5) + words(rng, rng.randrange(30)) + "é𝄞" * rng.randrange(3)) for i in ids]
    pairs = fingerprint.with_next(frame(spark, rows), ["text"]).withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    got = {r.doc_id: r for r in pairs.collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        assert got[i].next_text == following and got[i].edited == t[: len(t) - h] + following[:h]
    assert hashlib.sha256(got[ids[0]].edited.encode()).hexdigest()
    assert fingerprint.with_next(frame(spark, [(5, "only")]), ["text"]).first().next_text == "only"
    assert fingerprint.with_next(frame(spark, rows).limit(0), ["text"]).count() == 0
    odd = [(None, "n"), (3, "b"), (3, "a"), (1, None), (1, "c")]
    assert fingerprint.with_next(frame(spark, odd), ["text"]).count() == 5


def test_next_document_of_wide_skewed_and_missing_ids(spark):
    rng = random.Random(13)
    ids = [-(1 << 63), (1 << 63) - 1, 0, *rng.sample(range(10**6), 300)]
    rows = [(i, words(rng, 5)) for i in ids]
    order = [t for _, t in sorted(rows, reverse=True)]
    got = {r.text: r.next_text for r in fingerprint.with_next(frame(spark, rows), ["text"]).collect()}
    assert [got[t] for t in order] == [*order[1:], order[0]]
    # One id with most rows, and rows without one: they make one ring that holds each row once, ids descending.
    many = rows[:60] + [(77_777_777, words(rng, 6)) for _ in range(400)] + [(None, words(rng, 7)) for _ in range(300)]
    ring = {r.text: (r.doc_id, r.next_text) for r in fingerprint.with_next(frame(spark, many), ["text"]).collect()}
    assert len(ring) == len(many)
    at, seen = max(many, key=lambda r: r[0] if r[0] is not None else -(1 << 64))[1], []
    for _ in many:
        seen.append(ring[at][0])
        at = ring[at][1]
    assert seen == sorted((i for i, _ in many if i is not None), reverse=True) + [None] * 300 and len({v[1] for v in ring.values()}) == len(many)
    lone = [(None, words(rng, 7)) for _ in range(50)]
    assert len({r.next_text for r in fingerprint.with_next(frame(spark, lone), ["text"]).collect()}) == 50


def test_ranges_of_repeated_keys_are_even(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LEAST_RANGES", 64)
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * F.col("id")).alias("k"), F.xxhash64("id").alias("h"))
    cuts = ordering.splitters(keys, "k", 20_000)
    counts = keys.groupBy(ordering.range_of(F.col("k"), cuts, F.col("h")).alias("r")).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("r").collect()
    assert max(r.n for r in counts) < 12 * 20_000 / len(counts) and all(a.high <= b.low for a, b in zip(counts, counts[1:]))


def plain_signature(text):
    """Order MinHash step by step: units, numbered k-mers, and from 64 places on a circle of hashes the next two in the order of the text."""
    import xxhash

    def chained(*parts):
        h = 42
        for part in parts:
            h = xxhash.xxh64_intdigest(part, h)
        return h

    units = [u.encode() for u in re.findall(r"\s*+(?<!\S)\S{1,16}+(?!\S)|\s*+\S|\s++", text, re.A)]
    seen, kmers = Counter(), []
    for i in range(len(units)):
        h = chained(*units[i : i + 3]).to_bytes(8, "little")
        kmers.append((chained(h, seen[h].to_bytes(4, "little")) >> 28, i))
        seen[h] += 1
    kmers.sort()
    if not kmers:
        return [0] * 64
    out = []
    for m in range(64):
        first = sum(h < m << 30 for h, _ in kmers)
        two = sorted((kmers[(first + k) % len(kmers)] for k in range(2)), key=lambda x: x[1])
        pair = chained(*(h.to_bytes(8, "little") for h, _ in two)) >> 32
        out.append(pair - (1 << 32) if pair >> 31 else pair)
    return out


def test_signatures_against_plain(spark):
    rng = random.Random(21)
    texts = ["", " ", "one", "a b", "a b c d", "x y z " * 7, words(rng, 60), words(rng, 200, 20), "漢字" * 30 + " mixed " + "q" * 40, "tab\tand\nline  two", "é" * 17 + "\u00a0b"]
    got = [list(r.s) for r in frame(spark, list(enumerate(texts)), parts=1).orderBy("doc_id").select(fingerprint.signature(F.col("text")).alias("s")).collect()]
    for text, signature in zip(texts, got, strict=True):
        assert signature == plain_signature(text), repr(text)


def plain_language(model, text):
    """Expectation-maximisation gram by gram, and languages added one by one while the likelihood pays for them."""
    import math

    grams = language_id.trigrams(text).tolist()
    p = [[float(model.probabilities[g][k]) for k in range(len(model.names))] for g in grams]

    def fit(chosen):
        w = [1 / len(chosen)] * len(chosen)
        for _ in range(300):
            sums = [0.0] * len(chosen)
            for row in p:
                total = sum(a * row[k] for a, k in zip(w, chosen, strict=True))
                for i, k in enumerate(chosen):
                    sums[i] += w[i] * row[k] / total
            w = [s / len(grams) for s in sums]
        return w, sum(math.log(sum(a * row[k] for a, k in zip(w, chosen, strict=True))) for row in p)

    alone = [sum(math.log(row[k]) for row in p) for k in range(len(model.names))]
    chosen = [max(range(len(alone)), key=lambda k: alone[k])]
    best, shares = alone[chosen[0]], [1.0]
    full, _ = fit(list(range(len(alone))))
    for k in sorted((k for k in range(len(alone)) if full[k] * len(grams) >= 1 and k != chosen[0]), key=lambda k: -full[k]):
        w, now = fit([*chosen, k])
        if now - best > max(1.0, math.log(len(grams))) + 2:
            chosen, best, shares = [*chosen, k], now, w
    return {model.names[k]: s for k, s in zip(chosen, shares, strict=True)}


def test_language_mixtures_against_plain(spark):
    rows = language_corpus(random.Random(17), 300)
    model = language_id.train_language_model(frame(spark, rows, "doc_id long, text string, lang string"))
    by = {lang: next(r[1] for r in rows if r[2] == lang) for lang in ("aa", "bb", "cc")}
    texts = [by["aa"], by["cc"], by["aa"] + " " + by["bb"], by["bb"] + " " + by["cc"][:40], by["aa"] + " " + by["bb"] + " " + by["cc"], by["aa"] * 3 + " " + by["cc"][:12], "zzz", by["bb"][:5]]
    for text in texts:
        want = plain_language(model, text)
        name, score, got = model.infer(text)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=0.03) for k in want), text[:40]
        assert got[name] == max(got.values()) and 0 <= score <= 1
