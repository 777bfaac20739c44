"""The pipeline's stages, each against brute force on its own input."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomsift.llm import packing, queries, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "ONE two three four five six"), (6, "token = abcdefghijkl9 and 0123456789abcdef0"), (None, "nameless text"), (None, "nameless text")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(2)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "secrets", "packing"]


def test_exact_stage(spark, docs, sf_dir):
    out = corpus_pipeline.exact_dedup(spark, docs, sf_dir)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "nameless text"), (2, "one two three four five six"), (4, ""), (5, "ONE two three four five six"), (6, "token = abcdefghijkl9 and 0123456789abcdef0")]


def test_near_stage(spark, docs, sf_dir):
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert out.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 3, 6]


def test_near_stage_without_ids(spark, sf_dir):
    """Near copies of unlike fingerprints, none with a doc_id: one stays."""
    words = [f"w{i * 7919 % 1000}" for i in range(600)]
    said = [" ".join(words)] + [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(0, 600, 3)]
    near = next(t for t in said[1:] if 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(said[0])).bit_count() <= 2)
    df = spark.createDataFrame([(None, t, "en", "s", 1) for t in (said[0], near, "another text of its own")], SCHEMA)
    assert corpus_pipeline.near_dedup(spark, df, sf_dir).count() == 2


def test_secret_stage(spark, docs, sf_dir):
    out = corpus_pipeline.redact_secrets(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == docs.count()
    r = out.where("doc_id = 6").first()
    assert r.text == "[SECRET] and [SECRET]" and r.n_chars == len(r.text)


def test_toxic_stage(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.reject_toxic(spark, d, sf_dir)
    assert out.columns == d.columns
    scores = toxicity.toxicity(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in scores.where("predicted = 0").collect())


def test_whole_run(spark, sf_dir):
    docs = corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    last = {}
    for r in docs:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    prints = {i: simhash.fingerprint(t) for t, i in last.items()}
    stay = []
    for i in sorted(prints):  # the smallest of each component: grow components from the smallest id on
        if not any(i in c for c in stay):
            group, todo = {i}, [i]
            while todo:
                x = todo.pop()
                near = {j for j in prints if j not in group and (prints[x] ^ prints[j]).bit_count() <= 2}
                group |= near
                todo += near
            stay.append(group)
    want = {min(g) for g in stay}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == want
    text = {i: t for t, i in last.items()}
    clean = {}
    for i in want:
        t, at, parts = text[i], 0, []
        for s, e, _ in sorted(secrets.find(t)):
            if s >= at:
                parts += [t[at:s], "[SECRET]"]
            at = max(at, e)
        clean[i] = "".join([*parts, t[at:]])
    df = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    pieces = packing.pieces(df, public_tokenizers.path("word_bpe_49k.json")).drop("salt")
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(map(tuple, pieces.collect()))


#: Every name that a stage gives to columns of its own, and some that it gave once.
CLASHES = ["id", "key", "sign", "row", "score", "blob", "spans", "digest", "fp", "component_id", "kept", "h", "at", "name", "__score", "__spans", "__blob", "__id", "__mark", "__row", "Key"]


def stage(name, spark, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, docs, sf_dir, name):
    last = name == "packing"
    nothing = stage(name, spark, docs.where("false"), sf_dir)
    assert nothing.collect() == [] and (last or nothing.columns == docs.columns)
    names = [c for i, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:i]}]
    more = docs.select("*", *[F.lit(77 + i).alias(c) for i, c in enumerate(names)])
    out = stage(name, spark, more, sf_dir)
    if not last:
        assert out.columns == more.columns and out.count() > 0
        assert out.where(" and ".join(f"`{c}` = {77 + i}" for i, c in enumerate(names))).count() == out.count()
    plain = stage(name, spark, docs, sf_dir)
    assert out.count() == plain.count()
    long = spark.createDataFrame([(1, "ab cd " * 200_000, "en", "s", 1), (2, "x" * 700_000, "en", "s", 1), (3, " " * 700_000, "en", "s", 1)], SCHEMA)
    out = stage(name, spark, long, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2, 3}
    if not last:
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in long.collect())


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
