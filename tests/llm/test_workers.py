"""Python workers keep no model of a stage that is over."""

import gc

import pyarrow as pa
import pytest

from linkora.llm import common, langid, packing, similar, simhash, tokens, workers


def alive(kind):
    gc.collect()
    return sum(isinstance(x, kind) for x in gc.get_objects())


def test_a_worker_holds_the_model_of_one_operator(spark, sf_dir, monkeypatch):
    """The operators' functions one after the other in one process, as a worker runs the tasks of stage after stage."""
    functions, given = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: functions.append(f) or given(self, f, *a, **b))
    docs = common.table(spark, sf_dir, "documents").selectExpr("doc_id", "text")
    langid.predict(docs, langid.LanguageModel([langid.learned("en", ["some text of the language"])]))
    similar.prints(docs.selectExpr("doc_id as row", "doc_id", "text"))
    simhash.fingerprints(docs)
    packing.pieces(docs, 1)
    predict, prints, fingerprints, cut = functions
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    parsers, encoders = alive(langid.Parser), alive(tokens.ByteBpe)
    row = [pa.array([1]), pa.array([1]), pa.array([b"a text of some words"])]
    text = [row[0], pa.array(["a text of some words"])]

    def task(run, columns, names):
        return list(run(iter([pa.record_batch(columns, names=names)])))

    assert task(predict, text, ["doc_id", "text"])[0].column(2).to_pylist() == ["en"]
    assert alive(langid.Parser) == parsers + 1  # for the stage's next task
    assert task(prints, row, ["row", "doc_id", "text"])[0].num_rows == 1
    assert alive(langid.Parser) == parsers
    assert task(cut, text, ["doc_id", "text"])[0].num_rows == 1
    assert alive(tokens.ByteBpe) == encoders + 1
    assert task(fingerprints, row[1:], ["doc_id", "text"])[0].num_rows == 1
    assert alive(tokens.ByteBpe) == encoders
    task(cut, text, ["doc_id", "text"])
    task(predict, text, ["doc_id", "text"])
    assert (alive(langid.Parser), alive(tokens.ByteBpe)) == (parsers + 1, encoders)


def test_a_held_model_is_built_once_and_gone_when_another_is_held():
    built = []
    build = lambda *x: built.append(x) or [x]
    one = workers.held(build, 1)
    assert workers.held(build, 1) is one and list(workers.tidy(lambda x: x, model=True)([5])) == [5] and workers.held(build, 1) is one
    assert workers.held(build, 2) == [(2,)] and built == [(1,), (2,)]
    assert list(workers.tidy(lambda x: x)([5])) == [5] and not workers._model
    with pytest.raises(ZeroDivisionError):
        workers.held(lambda: 1 // 0)
    assert workers.held(build, 2) == [(2,)] and built == [(1,), (2,), (2,)]
