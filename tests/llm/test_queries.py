"""Every registered query of the subpackage on the smallest tables: its columns, its fixed parts and, where there is one, its statement."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from syntarel.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return dict(tables.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_statement(spark, tables, name):
    want = tables.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    plain = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, plain))


def test_op1_rules(spark, tables):
    """Host, path and rule of every page by plain string handling; the verdict is the rule's where there is one, and both kinds are found where there is none."""
    urls = dict(tables.sql("select page_id, url from pages").fetchall())
    got = queries.op1_url_filter(spark, DATA).collect()
    assert {r.page_id for r in got} == set(urls) and len(got) == len(urls)
    verdicts = {rule: verdict for verdict, rule in queries.URL_RULES}
    for r in got:
        host, path = "", ""
        if urls[r.page_id] and "://" in urls[r.page_id]:
            rest = urls[r.page_id].split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in verdicts if ("." + host).endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")
    assert any(r.rule for r in got) and any(r.rule is None for r in got)


def test_op4_digests(spark, docs):
    raw = {i: (t or "").encode() for i, t in docs.items()}
    count = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    got = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, DATA).collect()}
    assert set(got) == set(raw)
    for i, b in raw.items():
        on = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                on[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, y in zip(b, on, strict=True) if not y)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(on))), hashlib.sha256(kept).hexdigest())
        assert len(r.text.encode()) <= len(kept)


def test_op6_and_op9_accuracy(spark, tables):
    lang = dict(tables.sql("select doc_id, lang from documents").fetchall())
    got = queries.op6_language_id(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(lang) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(held) >= 0.97 * len(held)
    quality = dict(tables.sql("select doc_id, quality from labels").fetchall())
    scored = queries.op9_quality_classifier(spark, DATA).collect()
    assert {r.doc_id for r in scored} == set(lang) and all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    right = [r.predicted == quality[r.doc_id] for r in scored if r.held_out and r.doc_id in quality]
    assert sum(right) >= 0.7 * len(right)


def test_op7_counts(spark, docs):
    """All counts by plain string handling; kept is the base rule and the posterior of a document-by-document estimate."""
    import numpy as np

    from syntarel.llm import quality_rules

    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, DATA).collect()}
    assert set(got) == set(docs)
    rules = len(quality_rules.RULES)
    votes = {i: [quality_rules.measure(t)[5] // 3 ** (rules - 1 - j) % 3 - 1 for j in range(rules)] for i, t in docs.items()}
    right, wrong, share = np.full(rules, 0.95), np.full(rules, 0.4), 0.8
    v = np.array([votes[i] for i in sorted(docs)])
    for _ in range(500):
        good = share * np.prod(np.where(v > 0, right, np.where(v < 0, 1 - right, 1)), 1)
        bad = (1 - share) * np.prod(np.where(v > 0, 1 - wrong, np.where(v < 0, wrong, 1)), 1)
        p = good / (good + bad)
        right = (((v > 0) * p[:, None]).sum(0) + 9) / (((v != 0) * p[:, None]).sum(0) + 10)
        wrong = (((v < 0) * (1 - p)[:, None]).sum(0) + 5) / (((v != 0) * (1 - p)[:, None]).sum(0) + 10)
        share = (p.sum() + 8) / (len(p) + 10)
    posterior = dict(zip(sorted(docs), p.tolist(), strict=True))
    for i, text in docs.items():
        text, r = text or "", got[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeat = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert r.p_good == pytest.approx(posterior[i], abs=1e-6) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_op11_scores(spark, tables):
    toxic = dict(tables.sql("select doc_id, toxic from labels").fetchall())
    got = queries.op11_toxicity(spark, DATA).collect()
    assert len(got) == tables.sql("select count(*) from documents").fetchall()[0][0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == toxic[r.doc_id] for r in got if not r.held_out and r.doc_id in toxic]
    assert sum(right) >= 0.8 * len(right)


def test_op8_pieces(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs.items()}
    got, bins = queries.op8_best_fit_packing(spark, DATA).collect(), {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(r.doc_id for r in got) == {i: max(1, -(-len(x) // 2048)) for i, x in ids.items()}
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_op10_edits_and_fingerprints(spark, docs):
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in queries.op10_order_minhash(spark, DATA).collect()}
    prints = {}
    for k, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
        pairs = [(a, b) for a, b in zip(re.findall("........", r.fingerprint), re.findall("........", got[order[(k + 1) % len(order)]].fingerprint), strict=True)]
        assert r.near_next == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
