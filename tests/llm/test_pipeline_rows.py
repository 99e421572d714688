"""Repeated rows, shared ids and null ids through the stages that drop rows, against brute force by row."""

from collections import Counter

import corpus_pipeline
from test_operators import brute_contamination, prose

from linkora.llm import common
from linkora.llm.rows import NumberedRows


def test_repeated_shared_and_null_ids(spark, sf_dir):
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    dirty = next(t for _, t in items if len(t.split()) >= 13)
    near = prose(71, 200)
    texts = [(1, prose(60, 80)), (1, prose(60, 80)), (2, prose(61, 80)), (2, prose(60, 80)), (None, prose(60, 80)), (None, prose(62, 80)), (None, prose(62, 80))]
    texts += [(3, dirty), (3, prose(63, 80)), (None, dirty + " again"), (None, None), (None, "")]
    texts += [(4, near), (4, near + " end"), (None, near + " other end"), (None, prose(64, 200)), (None, prose(64, 200) + " end")]
    real = common.table(spark, sf_dir, "documents").schema
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], real).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def after(name, before):
        out = stages[name](spark, before, sf_dir)
        assert out.columns == before.columns
        return common.staged(out, name), Counter((r.doc_id, r.text) for r in out.collect())

    docs, found = after("language_id", common.staged(docs, "documents"))
    assert found == Counter(x for x in texts if x[1])
    docs, found = after("exact_dedup", docs)
    wanted = [(1, prose(60, 80)), (2, prose(61, 80)), (None, prose(62, 80)), (3, dirty), (3, prose(63, 80)), (None, dirty + " again"), (4, near), (4, near + " end"), (None, near + " other end"), (None, prose(64, 200)), (None, prose(64, 200) + " end")]
    assert found == Counter(wanted)
    docs, found = after("simhash_near_dedup", docs)
    groups = [{dirty, dirty + " again"}, {near, near + " end", near + " other end"}, {prose(64, 200), prose(64, 200) + " end"}]
    assert len(found) == sum(found.values()) == len(wanted) - 4
    assert set(found) <= set(wanted) and (3, dirty) in found
    for group in groups:
        assert len([x for x in found if x[1] in group]) == 1
    assert [x[0] for x in found if x[1] in groups[1]] == [4]
    # the whole input again: contaminated rows go one by one, whatever id they share or lack
    _, found = after("decontamination", spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], real))
    assert found == Counter(x for x in texts if not brute_contamination([x], items)[0][-1])
    assert (3, prose(63, 80)) in found and not {(3, dirty), (None, dirty + " again")} & set(found)


def test_clashing_columns_keep_their_values(spark, sf_dir):
    """Columns that are named as an operator's own, or a stage's."""
    names = ["_row", "_rows", "_numbers", "row", "_language", "_score", "lang_pred", "score", "digest", "key", "tile", "kept", "contaminated", "n_words"]
    texts = [(i, prose(300 + i // 2, 60), None if i % 2 else "en", "s", i) for i in range(20)]
    rows = [(*t, *[f"{n} {t[0]}" for n in names]) for t in texts]
    docs = common.staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)), "clashing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        kept = out.collect()
        assert {r.doc_id for r in kept} == ({t[0] for t in texts if t[0] % 2 == 0} if "dedup" in name else {t[0] for t in texts})
        assert all(r[n] == f"{n} {r.doc_id}" for r in kept for n in names), name
        docs = common.staged(out, name) if name == "language_id" else docs
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(texts)


def test_dropping_rows_shuffles_their_numbers_only(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").repartition(3)
    numbered = NumberedRows(docs)
    assert numbered.rows.select(numbered.number).distinct().count() == docs.count()
    gone = common.staged(numbered.rows.filter("doc_id % 3 = 0").select(numbered.number), "gone")
    for found, wanted in ((numbered.without(gone), docs.filter("doc_id % 3 <> 0").select("doc_id", "text")), (numbered.texts(gone).select("row", "text"), None)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
        if wanted is not None:
            assert sorted(map(tuple, found.select("doc_id", "text").collect())) == sorted(map(tuple, wanted.collect()))
        else:
            assert found.count() == gone.count()
