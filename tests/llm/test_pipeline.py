"""The corpus pipeline: every stage on its own input against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_operators import brute_contamination, prose, rows
from test_pipeline_near import brute_kept

from linkora.llm import common, tokens


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = common.table(spark, sf_dir, "documents")
    odd = [(10_000 + k, t, None if k % 3 else "en", f"src{k % 2}", None) for k, (i, t) in enumerate(rows()) if i is not None]
    odd += [(20_000 + k, prose(77, 300).replace("alpha", "Alpha" if k else "alpha", 1), "en", None, 1) for k in range(3)]
    return common.staged(real.unionByName(spark.createDataFrame(odd, real.schema)), "documents")


def as_dict(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, out = as_dict(docs), common.staged(out, name)
        after = as_dict(out)
        assert len(after) == out.count() and set(after) <= set(before)
        for i, row in after.items():
            assert row.text == before[i].text and row.source == before[i].source and row.n_chars == before[i].n_chars
        texts = {i: r.text for i, r in before.items()}
        if name == "language_id":
            wanted = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
            assert all(after[i].lang == (before[i].lang or after[i].lang) and after[i].lang for i in after)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in texts.items():
                groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
            wanted = {min(g) for g in groups.values()}
        elif name == "simhash_near_dedup":
            wanted = brute_kept(texts)
        else:
            wanted = {x[0] for x in brute_contamination(texts.items(), items) if not x[-1]}
        assert set(after) == wanted, name
        docs = out
    bpe = tokens.ByteBpe(tokens.bpe_file(), tokens.bpe_pattern())
    wanted = Counter()
    for r in docs.collect():
        ids = bpe.ids(r.text or "") + b"\1\0\0\0"
        wanted.update((r.doc_id, at, zlib.crc32(ids[4 * at : 4 * (at + 2048)])) for at in range(0, len(ids) // 4, 2048))
    found = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in found) == wanted


def test_run_and_empty_input(spark, sf_dir, docs):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in found}
    assert kept and len(found) == len({(r.doc_id, r.start) for r in found})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
