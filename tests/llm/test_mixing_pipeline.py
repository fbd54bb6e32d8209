"""Raking against targets, sampling, odd rows; the pipeline stage by stage."""
import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tierflow.llm import mixing, simhash, toxicity
from tests_llm_plain import plain_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_marginals_meet_their_targets(spark):
    rows = [(i, "w " * (5 + i % 40), ["en", "de", None][i % 3], f"s{i % 7 if i % 2 else 0}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    topic = F.when(F.col("doc_id") % 5 < 2, F.lit("a")).otherwise(F.lit("b"))
    table = mixing.cells(docs, "source", "lang", topic, mixing.token_count(F.col("text"))).cache()
    shares = spark.createDataFrame([("a", 0.3), ("b", 0.7), ("gone", 5.0)], "topic string, share double")
    targets = {"source": mixing.tempered(table, "source", 0.5), "lang": mixing.tempered(table, "lang", 0.5), "topic": mixing.given(table, shares.where("topic <> 'gone'"), "topic")}
    fitted = mixing.rake(table, targets, sweeps=25).cache()
    for by in mixing.DIMENSIONS:
        for r in fitted.groupBy(by).agg(F.sum(F.col("tokens") * F.col("weight")).alias("got")).join(targets[by], by).collect():
            assert abs(r.got - r.target) < 1e-3 * r.target
    kept = mixing.calibrate(fitted, 0.6).agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
    assert abs(kept[0] / kept[1] - 0.6) < 1e-6


def test_expected_marginals_meet_targets_within_the_bound(spark):
    cells = {("a", "en"): 60, ("a", "fr"): 12, ("b", "en"): 12, ("b", "fr"): 20}
    rows = [(100 * i + j, "w " * 10, lang, source, 0) for i, ((source, lang), n) in enumerate(cells.items()) for j in range(n)]
    docs, one = spark.createDataFrame(rows, SCHEMA).coalesce(1), F.lit("t")
    even = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "lang string, share double")}
    options = {"shares": even, "share": 60 / 104}
    got = mixing.marginals(mixing.mix(docs, topic=one, **options), **options).where("dimension <> 'topic'").collect()
    assert len(got) == 4 and all(r.feasible and abs(r.expected - r.target) < 2e-3 for r in got)
    cut = mixing.marginals(mixing.mix(docs, topic=one, bounded=False, **options), **options).where("dimension <> 'topic'").collect()
    assert max(abs(r.expected - r.target) for r in cut) > 5e-3

    options["shares"] = {"source": spark.createDataFrame([("a", 0.1), ("b", 0.9)], "source string, share double")}
    marked = mixing.mix(docs, topic=one, **options).cache()
    assert {(r.value, r.feasible, round(r.expected, 3)) for r in mixing.marginals(marked, **options).where("dimension = 'source'").collect()} == {("a", True, round(28 / 60, 3)), ("b", False, round(32 / 60, 3))}
    assert marked.where("source = 'b' and mix_probability < 0.999999").count() == 0


def test_sample_and_odd_rows(spark):
    rows = [(i, "a b c", "en", "s0", 5) for i in range(2000)] + [(None, None, None, None, None), (1, "", None, "s1", 0), (1, "", None, "s1", 0), (5000, "w " * 200_000, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mix_kept", F.lit("x")).withColumn("weight", F.lit(1)).withColumn("tokens", F.lit(2))
    marked = mixing.mix(docs, share=0.5)
    assert marked.count() == len(rows) and marked.where("mix_probability < 0 or mix_probability > 1 or mix_probability is null").count() == 0
    kept = mixing.sample(docs, share=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: plain words, insults, copies, shared passages, odd rows."""
    import random
    rnd = random.Random(11)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
    prose = lambda k: " ".join(rnd.choices(words, k=k)) + "."
    passage, rows, labels = prose(60), [], []
    for i in range(400):
        text, toxic = prose(rnd.randint(20, 200)), 0
        if i % 8 == 3:
            text, toxic = text + " you stupid idiot " + prose(30) + " what a moron.", 1
        elif i % 10 == 7:
            text += " " + passage + " é " + prose(20)
        rows.append((i, text, ["en", "fr"][i % 2], f"src{i % 5 if i % 3 else 0}", len(text)))
        labels.append((i, 1, toxic))
        if i % 20 == 0:
            rows += [(1000 + i, text, "en", "src0", len(text)), (2000 + i, text + "!", "en", "src1", len(text) + 1)]
    rows += [(None, None, None, None, None), (None, "a row without an id " + prose(30), None, "src0", 3), (3000, "", "en", "src0", 0), (3001, None, "en", "src0", None), (17, rows[19][1], "en", "src9", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("row", F.lit(1)).withColumn("n_bytes", F.lit("clash")).withColumn("component_id", F.lit(2))
    stages, rows = dict(cp.STAGES), lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "mixing", "byte_bpe"]

    clean = stages["toxicity"](spark, docs, corpus).cache()
    assert clean.columns == docs.columns
    insulted = docs.where(F.col("text").contains("idiot"))
    assert rows(clean) == rows(docs.exceptAll(insulted))

    single = stages["simhash_near_dedup"](spark, clean, corpus).cache()
    groups = simhash.components(clean).select("component").distinct().count()
    assert single.columns == docs.columns and single.count() == groups
    ids = [r.doc_id for r in single.collect()]
    assert not {i for i in ids if i is not None and 1000 <= i < 2000} and ids.count(None) == 1

    cut = stages["suffix_dedup"](spark, single, corpus).cache()
    before = [(r.doc_id, r.text) for r in single.collect()]
    want = plain_repeats(before)
    assert sorted((str(r.doc_id), r.text or "") for r in cut.collect()) == sorted((str(i), k.decode("utf-8", "ignore")) for i, k in want)
    assert cut.columns == docs.columns and cut.where("n_chars <> length(text)").count() == 0
    assert sum(len(k) for _, k in want) < sum(len((t or "").encode()) for _, t in before)

    mixed = stages["mixing"](spark, cut, corpus).cache()
    drawn = mixing.mix(cut).where("mix_kept").select(*docs.columns)
    assert rows(mixed) == rows(drawn) and 0 < mixed.count() < cut.count()

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in stages["byte_bpe"](spark, mixed, corpus).collect()}
    plain = {(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in mixed.collect() for ids in [library.encode_ordinary(r.text or "")]}
    assert done == plain
    last = stages["byte_bpe"](spark, mixed, corpus)
    assert sorted((str(r.doc_id), library.decode(r.ids)) for r in last.collect()) == sorted((str(r.doc_id), r.text or "") for r in mixed.collect())


def test_run_is_the_stages(spark, corpus):
    got = cp.run(spark, corpus)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, corpus)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)


def test_model_is_learned_from_rows_not_held_out(spark, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    assert 0 < labels.where(toxicity.held_out(F.col("doc_id"))).count() < labels.count()
