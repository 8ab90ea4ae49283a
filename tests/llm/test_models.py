"""Classifiers and personal data."""

import math
import random
import re
import sys
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.llm import pii, quality, toxicity
from gridloom.llm.common import held_out
from gridloom.llm.labelled import labelled_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "floor"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(tables, module, label, floor):
    docs, labels = tables
    scored = module.score(docs, module.fit(docs, labels))
    at = 0.3 if label == "quality" else 0.5
    got = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select((F.col("score") >= at).cast("int"), label).collect()
    assert sum(p == y for p, y in got) >= floor * len(got)
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == docs.count()


def test_held_out_rows_and_columns_that_are_no_inputs(tables):
    """Wrong labels of held-out rows, and other languages, sources and ids, change no score."""
    docs, labels = tables
    wrong = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (labelled_sample(docs, x, "toxic") for x in (labels, wrong))
    assert a == b
    assert all(crc32(str(r["doc_id"]).encode()) % 5 for r in docs.join(labels, "doc_id").where(~held_out(F.col("doc_id"))).select("doc_id").collect())
    model = toxicity.train(*a)
    plain = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert plain == {r["doc_id"]: r["score"] for r in toxicity.score(other, model).collect()}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_texts(spark, docs, rows, none, tables, module):
    model = module.fit(*tables)
    got = module.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert module.score(none, model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels(spark, tables, module):
    docs, labels = tables
    for some in (labels.limit(0), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})):
        model = module.fit(docs, some)
        scores = {r["score"] for r in module.score(docs.limit(20), model).collect()}
        assert len(scores) == 1


def test_long_texts_are_scored_whole(tables):
    model = toxicity.fit(*tables)
    clean = b"and the of that " * 60_000
    end = clean + b"idiot moron clown trash worthless scum pathetic loser"
    assert toxicity.words_of(end)[-1] == b"loser" and len(toxicity.words_of(end)) > 3 * toxicity.SLICE_WORDS
    low, high = model.scores([clean])[0], model.scores([end])[0]
    assert high > low
    short = b"idiot moron clown trash worthless scum pathetic loser"
    assert abs(model.scores([short, end, short])[0] - model.scores([short])[0]) < 1e-9


def test_slices_do_not_change_scores(tables, monkeypatch):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    some = [r["text"].encode() for r in docs.limit(60).collect()]
    want = model.scores(some)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 37)
    assert all(abs(a - b) < 1e-6 for a, b in zip(want, model.scores(some), strict=True))


def plain_toxicity(model, text):
    """Every word vector, window and filter one by one, in double precision."""
    vectors = [sum(model.embedding[k].astype(float) for k in toxicity.word_buckets(w)) for w in text.lower().split()]
    vectors = (vectors or [np.zeros(toxicity.DIMENSIONS)]) + [np.zeros(toxicity.DIMENSIONS)] * 2
    z, at = model.bias, 0
    for width, filters, shift in zip(toxicity.WIDTHS, model.filters, model.shifts, strict=True):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(vectors[i + t] @ filters[t * toxicity.DIMENSIONS : (t + 1) * toxicity.DIMENSIONS, f]) for t in range(width)) for i in range(len(vectors) - 2))
            z += max(0.0, best + float(shift[f])) * float(model.layer[at])
            at += 1
    return 1 / (1 + math.exp(-z))


def plain_quality(model, text):
    """Every word, n-gram and word pair one by one."""
    words, total, mask = text.split(), 0.0, (1 << 64) - 1
    for raw in words:
        word = f"<{raw.decode()}>"
        buckets = [crc32(raw) % quality.BUCKETS]
        for n in quality.GRAMS:
            for i in range(len(word) - n + 1):
                h = ord(word[i]) + 1
                for k in range(2, n + 1):
                    h = (h * 0x9E3779B97F4A7C15 + ord(word[i + k - 1]) + k) & mask
                buckets.append((h * 0xBF58476D1CE4E5B9 & mask) >> 40)
        total += sum(float(model.weights[b % quality.BUCKETS]) for b in buckets) / len(buckets)
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    for a, b in zip(hashes, hashes[1:], strict=False):
        total += float(model.weights[quality.BUCKETS + (((b - a) * 0xBF58476D1CE4E5B9 & mask) >> 40) % quality.PAIRS])
    z = model.bias + (total / (2 * len(words) - 1) if words else 0.0)
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize(("module", "plain"), [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores_equal_plain_ones(tables, rows, module, plain):
    model = module.fit(*tables)
    texts = [(r["text"] or "").encode() for r in tables[0].limit(25).collect()] + [(t or "").encode() for _, t in rows if not t or len(t) < 30_000]
    for text, got in zip(texts, model.scores(texts), strict=True):
        assert got == pytest.approx(plain(model, text), abs=2e-6)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_equal_texts_have_equal_scores_in_any_company(spark, tables, module):
    docs, labels = tables
    model = module.fit(docs, labels)
    some = docs.where("text IS NOT NULL").limit(120)
    twice = some.unionAll(some.withColumn("doc_id", F.col("doc_id") + 10**9))
    seen = {}
    for parts, order in ((1, "doc_id"), (3, "n_chars"), (7, "text")):
        for r in module.score(twice.repartition(parts).sortWithinPartitions(order), model).collect():
            seen.setdefault(r["doc_id"] % 10**9, set()).add(r["score"])
    assert len(seen) == 120 and all(len(s) == 1 for s in seen.values())
    texts = [r["text"].encode() for r in some.collect()]
    alone = [model.scores([t])[0] for t in texts[:20]]
    assert alone == model.scores(texts)[:20]


def test_labelled_sample_is_bounded_and_defined(spark):
    docs = [(i, "x" * 10, "en") for i in range(40)] + [(3, "a", "de"), (4, None, None), (4, "z", "en"), (5, "y" * 100_000, "en")]
    labels = [(i, i % 2) for i in range(50)] + [(3, 0), (None, 1)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    usable = [i for i in range(40) if crc32(str(i).encode()) % 5]
    got, share = labelled_sample(docs, labels, "toxic")
    assert len(got) == len(usable) and share == sum(i % 2 for i in usable) / len(usable)
    by = dict(zip(usable, got, strict=True))
    if 3 in by:
        assert by[3] == ("a", "de", 1)
    if 4 in by:
        assert by[4][0] == ""
    if 5 in by:
        assert by[5][0] == "x" * 10  # the least of two texts
    few, _ = labelled_sample(docs, labels, "toxic", rows_per_class=4)
    assert [y for *_, y in few].count(0) == [y for *_, y in few].count(1) == 4
    small, _ = labelled_sample(docs, labels, "toxic", bytes_per_class=25)
    assert 2 <= len(small) <= 8 and labelled_sample(docs.limit(0), labels, "toxic") == ([], 0.5)


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words of the 3,001st row of a class, in the order in which samples were drawn, and of all after it."""
    ids = spark.range(10_000).withColumnRenamed("id", "doc_id").withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    usable = ids.where(~held_out(F.col("doc_id"))).withColumn("n", rank)
    late = F.col("n") > 3000
    word = F.when(F.col("toxic") == 0, F.when(late, "sunny").otherwise("calm")).otherwise(F.when(late, "wretched").otherwise("vile"))
    docs = usable.select("doc_id", F.concat(F.lit("the "), word, F.lit(" "), (F.col("doc_id") % 7).cast("string")).alias("text"), F.lit("en").alias("lang")).cache()
    assert docs.where("text LIKE '%wretched%'").count() > 500
    model = toxicity.fit(docs, ids)
    for w in (b"calm", b"vile", b"sunny", b"wretched"):
        assert all(model.embedding[k].any() for k in toxicity.word_buckets(w))
    calm, sunny, vile, wretched = model.scores([b"the calm 1", b"the sunny 1", b"the vile 1", b"the wretched 1"])
    assert max(calm, sunny) < 0.5 <= min(vile, wretched)


def test_thresholds_of_a_table_equal_those_of_a_list(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "de", "en", "fr", "xx"]), round(rng.random(), 2), rng.randint(0, 1)) for _ in range(900)]
    rows += [("one", 0.3, 1), ("none", 0.7, 0), ("low", 0.0, 1), ("tie", 0.8, 1), ("tie", 0.2, 1), ("tie", 0.2, 0)]
    table = spark.createDataFrame(rows, "lang string, score double, label int").repartition(5)
    got = {r["scope"]: r for r in toxicity.best_thresholds(table, F.col("lang")).collect()}
    assert set(got) == {x for x, *_ in rows}
    for lang, r in got.items():
        own = [(s, y) for x, s, y in rows if x == lang]
        assert (r["n"], r["toxic"]) == (len(own), sum(y for _, y in own))
        assert r["threshold"] == toxicity.best_threshold([s for s, _ in own], [y for _, y in own])


def test_toxicity_shards(spark, tables, monkeypatch):
    """Several shards: the same model from any layout and from repeated rows, and nearly all labels told."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    docs, labels = tables
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.unionAll(docs).repartition(7, "text"), labels.unionAll(labels).repartition(3))
    assert (a.embedding == b.embedding).all() and (a.layer == b.layer).all() and (a.bias, a.by_language) == (b.bias, b.by_language)
    got = toxicity.score(docs, a).join(labels, "doc_id").select(F.col("score") >= 0.5, "toxic").collect()
    assert sum(p == y for p, y in got) >= 0.9 * len(got)
    same = docs.limit(30).withColumn("text", F.lit("all rows have one text"))
    some = same.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len({r["score"] for r in toxicity.score(same, toxicity.fit(same, some)).collect()}) == 1


def test_segments_hold_every_row(monkeypatch):
    rows = [(f"text {i} {'a' * (i % 9)}".encode(), None, i % 2) for i in range(200)] + [(b"", "en", 0)]
    monkeypatch.setattr(toxicity, "SEGMENT_WORDS", 100)
    parts = list(toxicity.segments_of(rows))
    assert len(parts) > 10 and sum(len(s.labels) for _, s in parts) == len(rows)
    assert sum(map(sum, (s.labels for _, s in parts))) == 100
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 7)
    bags = parts[0][1].bags
    batches = list(toxicity._batches(bags, np.arange(len(bags))))
    assert sorted(i for b in batches for i in b) == list(range(len(bags)))
    assert all(len(b) == 1 or sum(len(bags[i]) for i in b) <= 7 for b in batches)


def calls_in(run):
    """Calls that the interpreter makes, of Python and of C functions: a measure of work that no machine changes."""
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(before)
    return calls


def test_toxicity_makes_few_calls_a_word(tables):
    """However many words are new: of the words of a web table most distinct ones are rare."""
    model = toxicity.train([(r["text"], r["lang"], r["doc_id"] % 2) for r in tables[0].limit(100).collect()], 0.5)
    texts = [" ".join(f"word{k * 500 + i}s," for i in range(500)).encode() for k in range(40)]
    assert calls_in(lambda: model.scores(texts)) < 3 * 20_000
    assert calls_in(lambda: list(toxicity.segments_of((t, None, 0) for t in texts))) < 3 * 20_000


def test_bucket_table_equals_buckets_of_words():
    rng = random.Random(12)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 12) for _ in range(200)]
    words += [b"!!!", b'"abc"', b"(abcd).", b"\x00\x00\x00\x00", b"a" * 100_000, "größer".encode()]
    table = toxicity.bucket_table(words)
    assert table.shape == (len(words), 1 + len(toxicity.PREFIXES)) and len(toxicity.bucket_table([])) == 0
    for w, row in zip(words, table.tolist(), strict=True):
        own = toxicity.word_buckets(w)
        assert row == own + [0] * (len(row) - len(own))


def test_forgotten_words_do_not_change_scores(tables, monkeypatch):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    some = [r["text"].encode() for r in docs.limit(60).collect()]
    want = model.scores(some)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 500)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 300)
    monkeypatch.setattr(toxicity, "NEAR_WORDS", 64)
    assert model.scores(some) == want


# ---- personal data -------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_rules_equal_plain_scans(tables, rows):
    rng = random.Random(2)
    texts = [r["text"] for r in tables[0].limit(300).collect()] + [t for _, t in rows if t and len(t) < 50_000]
    texts += ["".join(rng.choice("a.@+-1 2()3%_b45 .@0255") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["+1 (212) 555-0143", "4111 1111 1111 1111", "00255.1.1.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "x@y", "+1-", "+12", "+1 2"]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_added_spans(model):
    def added(text):
        return [text[a:b] for _, a, b in pii.all_spans(text, pii.base_spans(text), model) if (_, a, b) not in pii.base_spans(text)]

    assert added("call me at (212) 555-0143 today") == ["(212) 555-0143"]
    assert added("mail john.doe (at) example (dot) com now") == ["john.doe (at) example (dot) com"]
    assert added("card 4111.1111.1111.1111 ok") == ["4111.1111.1111.1111"]
    for clean in ("on 2021-03-04 we met", "order 123-456-7890 came", "we met at noon. Then", "version 1.2.3", "pages 100 200 300", ""):
        assert added(clean) == []


def test_base_spans_stay_and_redaction_takes_all(spark, docs, rows, none, tables, model):
    some = tables[0].limit(200)
    for r in pii.spans(some, model).join(some, "doc_id").collect():
        base = [(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["base"]]
        assert base == brute(r["text"])
        clean = pii.redact(r["text"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]])
        assert not brute(clean) or "[" in clean
    out = {r["doc_id"]: r for r in pii.redacted(docs.where("doc_id IS NOT NULL AND doc_id < 18"), model).collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[6]["text"] == dict(rows[:16])[6] and out[6]["_key"] == "k"
    assert pii.redacted(docs, model).columns == docs.columns
    assert pii.redacted(none, model).count() == pii.spans(none, model).count() == 0
    assert pii.redact("ab 1.2.3.4 cd", [("ip", 3, 10)]) == "ab [IP] cd"
    assert pii.redact("x12345y", [("phone", 1, 4), ("card", 2, 6)]) == "x[PHONE]y"


def test_no_added_span_overlaps_a_base_span(model):
    """However many spans lie inside a longer one."""
    inner = ".".join(["1.2.3.4"] * 12)
    text = f"call {inner}@example.com (212) 555-0143 card 4111.1111.1111.1111.{inner}@x.org"
    base = pii.base_spans(text)
    assert sum(k == "ip" for k, *_ in base) > 8
    for k, a, b in pii.all_spans(text, base, model):
        assert (k, a, b) in base or all(b <= x or y <= a for _, x, y in base)


def test_long_runs_take_linear_time(model):
    for t in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1 " * 80_000, "@a" * 80_000, "a@" * 80_000, "1." * 150_000, "(at)" * 40_000):
        pii.all_spans(t, pii.base_spans(t), model)


@pytest.mark.parametrize("sign", ["[.]", "(.)", "[dot]", " dot "])
def test_addresses_of_one_digit_parts_are_proposed(sign):
    ip = sign.join("8844")
    assert ("ip", 10, 10 + len(ip)) in pii.proposals(f"client ip {ip} seen")
    assert ("ip", 10, 15 + len(sign) + 1) in pii.proposals(f"client ip 8{sign}8.4.4 seen")
