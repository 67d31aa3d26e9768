"""The stages of the corpus pipeline, on planted and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from syntarel.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(pipeline.STAGES)


def prose(rng, n):
    return " ".join("".join(rng.choice("ka lo mi ne tu ra se po vi do".split()) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passage = prose(rng, 150)
    out = [(i, prose(rng, rng.randrange(60, 300)), "aa", f"s{i % 3}", 0) for i in range(60)]
    copied = out[0][1]
    near = copied.split()
    near[5] = "other"
    out += [(100, copied, "aa", "s0", 0), (101, " ".join(near), "aa", "s1", 0), (102, "1234 5678 !!!", "aa", "s1", 0), (103, prose(rng, 80) + passage + prose(rng, 80), "aa", "s1", 0), (104, prose(rng, 90) + passage, "aa", "s2", 0)]
    return [(i, t, lang, s, len(t)) for i, t, lang, s, _ in out]


def test_planted_cases(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = STAGES["language_id"](spark, docs, "")
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {102}
    heads = STAGES["near_dedup"](spark, kept, "")
    gone = {r.doc_id for r in kept.select("doc_id").collect()} - {r.doc_id for r in heads.select("doc_id").collect()}
    text = {r[0]: r[1] for r in rows}
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
    a, b = shingles(text[0]), shingles(text[101])
    assert gone == {100} | ({101} if len(a & b) >= 0.8 * len(a | b) else set())
    cut = {r.doc_id: r for r in STAGES["suffix_dedup"](spark, docs.where("doc_id > 1 and doc_id <> 100 and doc_id <> 101"), "").collect()}
    for i, t, *_ in rows:
        if i in (103, 104):
            assert len(cut[i].text) < len(t) - 600 and cut[i].n_chars == len(cut[i].text)
        elif i in cut:
            assert cut[i].text == t and cut[i].n_chars == len(t)
    taken = STAGES["mixing"](spark, docs, "")
    assert 0 < taken.count() <= len(rows) and taken.subtract(docs).count() == 0
    packed = STAGES["packing"](spark, docs, "").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 2048").count() == 0


def test_passages_of_51_short_words_go(spark):
    rng = random.Random(12)
    passage = " ".join(rng.choice("abcdefghijklmnop") for _ in range(51))
    rows = [(i, f"{prose(rng, 60)} {passage if i < 3 else passage[:-2]} {prose(rng, 60)}", "aa", "s0", 0) for i in range(5)]
    got = {r.doc_id: r.text for r in STAGES["suffix_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert all(passage not in got[i] and got[i] == rows[i][1].replace(passage, "") for i in range(3))
    assert all(got[i] == rows[i][1] for i in (3, 4))  # 50 words stay


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before has kept, beside a brute-force version or statement of it."""
    import duckdb

    from syntarel.llm import mixing
    from tests.llm.test_operators import plain_components, plain_cut_words, plain_sets

    rng = random.Random(31)
    passage, rows = prose(rng, 90), []
    for i in range(70):
        text = prose(rng, rng.randrange(60, 200))
        if i % 4 == 0:
            text += " " + passage
        rows.append((i, text, "aa", f"s{i % 4}", len(text)))
    rows += [(100 + i, rows[i % 5][1] + " " + prose(rng, i % 3), "aa", "s1", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs
    for name, stage in pipeline.STAGES[:2]:
        before = kept.collect()
        kept = stage(spark, spark.createDataFrame(before, SCHEMA), "")
        got = {r.doc_id for r in kept.collect()}
        if name == "language_id":
            assert got == {r.doc_id for r in before}  # all are of the one language there is
        else:
            assert got == {i for i, head in plain_components(plain_sets([(r.doc_id, r.text) for r in before], 5)).items() if i == head}
    before = kept.orderBy("doc_id").collect()
    cut = {r.doc_id: r for r in STAGES["suffix_dedup"](spark, spark.createDataFrame(before, SCHEMA), "").collect()}
    left = plain_cut_words([r.text for r in before], 400, pipeline.PASSAGE_WORDS)
    assert {i: r.text for i, r in cut.items()} == {r.doc_id: x.decode() for r, x in zip(before, left, strict=True) if x.strip()}
    documents = [tuple(r) for r in cut.values()]  # noqa: F841
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", documents)
    taken = con.sql(f"select doc_id from ({mixing.mixing_sql(keep=pipeline.KEEP)}) where taken").fetchall()
    mixed = STAGES["mixing"](spark, spark.createDataFrame(documents, SCHEMA), "")
    assert {r.doc_id for r in mixed.collect()} == {x for x, in taken}
    pieces = STAGES["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in pieces} == {x for x, in taken} and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_odd_rows_and_columns(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, " \n", None, "a", 2), (3, long, "en", "a", len(long)), (4, "Tiny text.", "en", "b", 10), (4, "Tiny text.", "en", "b", 10), (None, "no id at all here", "en", "b", 17), (None, "no id at all here", "en", "b", 17), (None, "Tiny text.", "en", "b", 10)]
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(7) for c in ("score", "topic", "rate", "taken", "spans", "language", "component_id", "weight", "task")})
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert got.count() <= len(odd), name
        assert got.where("topic <> 7 or score <> 7 or taken <> 7").count() == 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    heads = sorted((r.doc_id or 0, r.text or "") for r in STAGES["near_dedup"](spark, docs, "").collect())
    assert [h for h in heads if h[1] and h[1] != long] == [(0, "no id at all here"), (2, " \n"), (4, "Tiny text.")]
    assert STAGES["packing"](spark, docs, "").where("doc_id = 4").count() == 2
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in STAGES["language_id"](spark, nameless, "").collect()} == {None, 3, 4}


def test_near_copies_without_ids_go(spark):
    rng = random.Random(41)
    base = prose(rng, 120)
    rows = [(None, base, "aa", "s", 0), (None, base, "aa", "s", 0), (None, base + " end", "aa", "s", 0), (3, prose(rng, 90), "aa", "s", 0), (8, base + " fin", "aa", "s", 0), (9, "one text", "aa", "s", 0), (9, "another text altogether", "aa", "s", 0)]
    got = [(r.doc_id, r.text) for r in STAGES["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [rows[3][:2], (8, base + " fin"), (9, "one text"), (9, "another text altogether")]))


def test_run_writes_every_stage(spark, rows):
    root = new_path(spark, "tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_path(spark, "x")).getParent()
    tables = lambda: {x.getPath().getName() for x in home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(home)}
    there = tables()
    got = pipeline.run(spark, root)
    # The last stage's input and the two tables that its result is read from.
    assert sorted(x.partition("-")[0] for x in tables() - there) == ["lengths", "mixing", "pieces"]
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 30
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
