"""The pipeline, its stages and the registered queries."""

import duckdb
import pyarrow as pa
import pytest
from test_duplicates import brute, brute_dedup
from test_models import brute as personal
from test_models import plain_toxicity
from test_tokens import WORDS, check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import minhash, packing, pii, stages, substring, toxicity
from gridloom.llm.common import map_batches, materialize
from gridloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.dtypes
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        assert name == "packing" or docs.dtypes == kinds
    before, after = seen["near_dedup"]
    kept = {r["doc_id"] for r in minhash.near_duplicates(before).collect() if r["kept"]}
    assert kept == {r["doc_id"] for r in after.collect()} and len(kept) < before.count()
    before, after = seen["substring_dedup"]
    want = {r["doc_id"]: r["text"] for r in substring.substring_dedup(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = seen["pii"]
    assert after.count() == before.count() and after.where("text RLIKE '[A-Za-z0-9]@[a-z0-9-]+[.][a-z]'").count() == 0
    assert seen["packing"][1].agg({"length": "sum"}).first()[0] > 0


def test_stages_against_brute_force(spark):
    """Each stage's rows from plain versions of its operator, over whole tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages_ = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = materialize(stages_["toxicity"](spark, docs, SF), "brute-toxicity")
    model = toxicity.fit(docs, labels)
    sure = {i for i, r in rows.items() if abs(plain_toxicity(model, (r["text"] or "").encode()) - model.threshold(r["lang"])) > 1e-5}
    want = {i for i, r in rows.items() if plain_toxicity(model, (r["text"] or "").encode()) < model.threshold(r["lang"])}
    got = {r["doc_id"] for r in kept.collect()}
    assert got & sure == want & sure and len(sure) >= len(rows) - 2 and len(got) < len(rows)

    alone = materialize(stages_["near_dedup"](spark, kept, SF), "brute-near")
    component = brute([(i, rows[i]["text"]) for i in got], 5)
    assert {r["doc_id"] for r in alone.collect()} == {i for (i, _), c in component.items() if i == c}

    less = materialize(stages_["substring_dedup"](spark, alone, SF), "brute-substring")
    want = dict(brute_dedup([(r["doc_id"], r["text"]) for r in alone.collect()]))
    texts = {r["doc_id"]: r["text"] for r in less.collect()}
    assert texts == want

    clean = materialize(stages_["pii"](spark, less, SF), "brute-pii")
    fitted = pii.fit()
    for r in clean.collect():
        text = texts[r["doc_id"]]
        base = personal(text)
        every = pii.all_spans(text, base, fitted)
        assert set(base) <= set(every) and r["text"] == pii.redact(text, every)
        assert every or r["text"] == text

    pieces = packing.pack(clean, WORDS, with_ids=True)
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    check_packed(pieces.collect(), [(r["doc_id"], r["text"]) for r in clean.collect()], plain)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    last = stages_["packing"](spark, clean, SF)
    assert sorted(map(tuple, last.select(columns).collect())) == sorted(map(tuple, pieces.select(columns).collect()))


def test_stages_with_clashing_columns(spark, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for some in (docs, none):
        out = stages.without_personal_data(stages.without_repeats(stages.without_toxic(some, labels)))
        assert out.columns == COLUMNS
        assert out.count() <= some.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_workers_remember_one_operator_at_a_time(spark, docs):
    """What packing remembers of words does not stay in a worker beside the next stage's memory."""

    def known(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.WordIds._known)] * b.num_rows, pa.int64())], names=["n"])

    tasks = spark.range(0, 64, 1, 16)
    most = lambda df: df.agg({"n": "max"}).first()[0]
    packing.pack(docs, WORDS).collect()
    assert most(tasks.mapInArrow(known, "n long")) == 1
    assert most(map_batches(tasks, known, "n long")) == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.fixture(scope="module")
def awkward_dir(spark, docs, rows, tmp_path_factory):
    """Tables with nulls in every column, repeated rows and clashing columns."""
    root = f"{tmp_path_factory.mktemp('awkward')}"
    docs.write.parquet(f"{root}/documents.parquet")
    labels = [(4, 1, 0), (5, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (8, 0, 0), (8, 1, 1), (9, 1, 0), (9, 1, 0), (10, 7, 7), (99, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [(1, None, None), (None, "http://x", "y" * 2000), (2, "http://y", "y" * 2000), (2, "http://y", "y" * 2000), (3, "", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    vectors = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (1, [2.0, 1.0]), (2, [None, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.fixture(scope="module")
def empty_dir(spark, awkward_dir, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('empty')}"
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{awkward_dir}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.mark.parametrize("name", QUERIES)
def test_queries_take_awkward_and_empty_tables(spark, awkward_dir, empty_dir, rows, name):
    got = QUERIES[name](spark, awkward_dir).collect()
    if name == "op9_ann":
        assert [(r["query_id"], r["vec_id"], r["rank"]) for r in got] == [(0, 1, 1)]
    elif name == "op3_packing":
        assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    else:
        assert len(got) == (5 if name == "op2_warc" else len(rows))
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_takes_awkward_and_empty_tables(spark, awkward_dir, empty_dir):
    assert corpus_pipeline.run(spark, awkward_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
