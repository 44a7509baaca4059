"""Every stage against a plain version over the same input, with odd rows."""

import corpus_pipeline as pipeline
import pytest
from tidewire.llm.common import materialise

from .conftest import DOCS, text_of
from .test_operators import plain_jaccard

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = {}, docs
    for name, stage in pipeline.STAGES:
        before, now = now, materialise(stage(spark, now, "unused"), name)
        out[name] = (before, now)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]
    for name in list(STAGES)[:-1]:
        assert stages[name][1].columns == pipeline.COLUMNS


def test_language_rejects_only_what_has_none(stages):
    before, after = stages["language_id"]
    gone = set(rows(before)) - set(rows(after))
    assert gone == {(103, None), (104, ""), (105, "  \n\t "), (109, "123 456")}


def test_texts_of_several_languages_stay(spark):
    said = {"en": "the dog and the cat are in the house ", "de": "der hund und die katze sind in dem haus ", "fr": "le chien avec les chats dans une maison "}
    found = [(i, said[x] * 6, x, "s", 1) for i, x in enumerate(["en", "de", "fr"] * 12)] + [(100, " ".join(said.values()) * 4, None, "s", 1), (101, "The house.", None, "s", 1)]
    junk = [(200, "Это просто русский текст для проверки этого правила, и он довольно длинный " * 3, None, "s", 1), (201, "Qzx.", None, "s", 1)]
    out = STAGES["language_id"](spark, spark.createDataFrame(found + junk, DOCS), "unused")
    assert {r.doc_id for r in out.collect()} == {f[0] for f in found}


@pytest.mark.parametrize(("label", "sizes"), [(None, [2, 7, 19, 60]), ("en", [7, 19, 60, 60])])  # two words that are labelled as English may be
def test_random_letters_go_and_the_tables_stay(spark, label, sizes):
    import os
    import random

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(-1 - i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(n)), label, "s", 1) for i, n in enumerate(sizes * 25)]
    out = STAGES["language_id"](spark, docs.select(*pipeline.COLUMNS).unionByName(spark.createDataFrame(junk, DOCS)), "unused")
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}


def test_line_dedup_empties_copies(stages):
    before, after = stages["line_dedup"]
    kept = dict(rows(after))
    assert 0 in kept and 100 not in kept and 101 not in kept and 102 in kept
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert len({t for _, t in rows(after)}) == len({t for _, t in rows(before)}) - 0


def test_one_document_a_group(spark, docs, stages):
    got = rows(STAGES["ngram_join"](spark, docs, "unused"))
    want = plain_jaccard(rows(docs), 5, 80, 100)
    assert sorted(d for d, _ in got if d is not None) == sorted({d for d, _, c in want if d is not None and d == c})
    assert sum(d is None for d, _ in got) == 1


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (text_of(i) for i in (900, 901, 902))
    found = [(5, a, "en", "s", 1), (7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (7, c, "en", "s", 1), (8, None, "en", "s", None), (8, None, "en", "t", None)]
    out = STAGES["ngram_join"](spark, spark.createDataFrame(found, DOCS), "unused")
    assert sorted((r.doc_id, r.text or "", r.source) for r in out.collect()) == sorted([(5, a, "s"), (7, b, "s"), (7, c, "s"), (8, "", "s"), (8, "", "t")])


def test_mixing_takes_no_document_twice(spark, stages):
    before, after = stages["mixing"]
    assert set(rows(after)) <= set(rows(before)) and len(rows(after)) == len(set(rows(after)))


def test_empty_tables(spark, docs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), "unused").count() == 0


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    pieces = out.collect()
    assert pieces and all(0 < p.length <= 4096 and p.offset + p.length <= 4096 for p in pieces)
