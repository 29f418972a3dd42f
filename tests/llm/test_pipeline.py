"""The pipeline's stages on a small fixture with planted cases, and every registered text query."""

import random

import pytest
from odd_rows import SF, shipped  # noqa: F401

import corpus_pipeline
from spanwise.llm.queries import QUERIES


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts, one near copy of text 0, one exact copy of text 1, a passage in three texts, toxic texts."""
    state = random.Random(8)
    vocabulary = ["".join(state.choices("abcdeghilmnorstu", k=state.randint(3, 7))) for _ in range(500)]
    rows = [[i, "\n".join(" ".join(state.choices(vocabulary, k=70)) for _ in range(3)), i % 5 == 0] for i in range(300)]
    passage = " ".join(state.choices(vocabulary, k=60))
    for i in (10, 20, 30):
        rows[i][1] += "\n" + passage
    for i in range(0, 300, 5):
        rows[i][1] += " vilest grimly " * 2
    near = [line.split() for line in rows[1][1].split("\n")]
    for words in near:
        words[7] = "changed"
    rows += [[300, "\n".join(map(" ".join, near)), False], [301, rows[2][1], False]]
    docs = [(i, t, "en", "s%d" % (i % 2), len(t)) for i, t, _ in rows]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(toxic)) for i, _, toxic in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, _ in rows}, {i for i, _, toxic in rows if toxic}, passage


def test_stages(spark, planted):
    folder, texts, toxic, _ = planted
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    calm = stages["toxicity"](spark, docs, folder)
    assert {r.doc_id for r in calm.collect()} == set(texts) - toxic and calm.columns == docs.columns
    lines = stages["line dedup"](spark, docs, folder)
    left = {r.doc_id: r for r in lines.collect()}
    assert set(texts) - set(left) == {300, 301} and lines.columns == docs.columns  # a changed word is a variable
    assert all(r.n_chars == len(r.text) for r in left.values())
    near = stages["near dedup"](spark, docs, folder)
    assert set(texts) - {r.doc_id for r in near.collect()} == {300, 301} and near.columns == docs.columns
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and 0.6 < mixed.count() / len(texts) < 0.95
    coded = {r.doc_id: r for r in stages["encoding"](spark, docs, folder).collect()}
    import hashlib

    assert all(coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())


def test_passage_stays_once(spark, planted):
    folder, texts, _, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id not in (300, 301)")
    got = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, folder).collect()
    assert sum(passage in r.text for r in got) <= 1
    assert all(r.text == texts[r.doc_id] for r in got if r.doc_id not in (10, 20, 30))


EXTRA = {"rate": "double", "n_lines": "int", "n_dropped": "int", "kept": "string", "bits": "int", "topic": "string", "its_row": "long", "gone": "int"}


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Nulls in every column, empty and repeated rows, ids that occur twice, a long text, extra columns with clashing names."""
    state = random.Random(4)
    words = ["".join(state.choices("abcdeghilmnorstu", k=5)) for _ in range(300)]
    texts = [" ".join(state.choices(words, k=60)) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id but with several words in it", None, None, None), (100, None, "de", "s0", None), (101, "", "de", "s0", 0),
             (102, " \n\t", None, "s1", 3), rows[3], rows[3], (4, "another text of the same id with words of its own", "en", "s1", 49),
             (103, "long " + " ".join(f"w{i % 977}" for i in range(150_000)), "en", "s2", 1)]
    folder = str(tmp_path_factory.mktemp("odd"))
    kinds = ", ".join(f"{c} {k}" for c, k in EXTRA.items())
    own = (10.0, 77, 78, "mine", 5, "own", 6, 7)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {kinds}"
    spark.createDataFrame([(*r, *own) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 5)) for i in range(25)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, own


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_on_odd_rows(spark, odd_folder, name):
    """Rows that stay keep the values of every column, and an empty table gives an empty one."""
    folder, own = odd_folder
    docs, stage = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)[name]
    given = {(r.doc_id, r.text): tuple(r) for r in docs.collect()}
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert rows and all(tuple(r)[5:] == own for r in rows)
    if name != "line dedup":  # which changes texts and their lengths
        assert all(tuple(r) == given[r.doc_id, r.text] for r in rows)
    if name in ("toxicity", "line dedup", "near dedup"):
        kept = {(r.doc_id, r.text) for r in rows}
        assert {(100, None), (101, ""), (102, " \n\t"), (None, "a text without an id but with several words in it")} <= kept
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.isEmpty()


def test_encoding_and_run_on_odd_rows(spark, odd_folder):
    folder, _ = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["encoding"]
    assert stage(spark, docs, folder).count() == docs.count() and stage(spark, docs.limit(0), folder).isEmpty()
    assert corpus_pipeline.run(spark, folder).filter("doc_id IN (5, 103)").count() >= 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
