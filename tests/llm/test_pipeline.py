"""The pipeline's stages, each against brute force on its own input."""

import os

import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from cratework.llm.decontamination import words_of
from cratework.llm.queries import MODEL
from cratework.llm.toxicity import Scorer, fit
from cratework.session import shared_folder
from tests.llm.conftest import ODD
from tests.llm.test_dedup import expected_lines, near_truth
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into the first stage, and those that come out of each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
        found.append(docs.collect())
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = Scorer(model).score([r.text for r in before])
    assert ids(after) == sorted(r.doc_id for r, s in zip(before, scores) if s < 0.5)
    assert 0 < len(after) < len(before)


def test_repeated_lines_go(stages):
    before, after = stages[1], stages[2]
    want = {key[0]: key[1] for key in expected_lines([(r.doc_id, r.text) for r in before], 10)}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group_stays(stages):
    before, after = stages[2], stages[3]
    groups = {}
    for r, label in zip(before, near_truth([(r.doc_id, r.text) for r in before], 0.8)):
        groups.setdefault(label, []).append(r.doc_id)
    assert ids(after) == sorted(min(g) for g in groups.values())


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3], stages[4]
    windows = {}
    for (text,) in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect():
        words = words_of(text)
        size = min(13, len(words))
        for p in range(len(words) - size + 1) if words else ():
            windows.setdefault(size, set()).add(tuple(words[p : p + size]))
    clean = []
    for r in before:
        words, hit = words_of(r.text), set()
        for size, known in windows.items():
            for p in range(len(words) - size + 1):
                if tuple(words[p : p + size]) in known:
                    hit.update(range(p, p + size))
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append(r.doc_id)
    assert ids(after) == sorted(clean)


def test_pieces_are_the_librarys(stages):
    before, after = stages[4], stages[5]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id: list(r.ids) for r in after} == {
        r.doc_id: library.encode(r.text) for r in before
    }
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_stages_take_odd_rows(spark, small_jobs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], schema)
    for stage in [stage for _, stage in corpus_pipeline.STAGES]:
        assert stage(spark, docs, FOLDER).count() > 0
        assert stage(spark, docs.limit(0), FOLDER).collect() == []


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op8_decontamination", "op10_line_dedup"])
def test_queries_match_their_oracles(spark, name):
    compare(queries()[name](spark, FOLDER), duck(FOLDER), oracle_sql()[name])


def test_every_operator_has_a_query():
    numbers = {q.split("_")[0] for q in queries() if q.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 11)} and "pipeline" in queries()


def test_only_the_result_of_a_run_is_left(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (made,) = set(os.listdir(folder)) - before
    assert os.listdir(f"{folder}/{made}") == [corpus_pipeline.STAGES[-1][0]]
    assert result.count() > 0
