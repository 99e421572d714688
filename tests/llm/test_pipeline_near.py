"""The near-duplicate stage against brute-force five-word Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
from test_operators import brute_components, prose

from linkora.llm import common, simhash, similar


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    found = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])])
    return {i for i, c in found.items() if i == c}


def test_near_stage_is_exact_jaccard(spark, sf_dir):
    real = common.table(spark, sf_dir, "documents").filter("length(text) > 0")
    r, odd = random.Random(3), []
    for k in range(120):  # copies of one text with one to six of 300 words changed
        words = prose(900 + k % 4, 300).split()
        for at in r.sample(range(300), 1 + k % 6):
            words[at] = f"new{k}"
        odd.append((30_000 + k, " ".join(words), "en", "x", 1))
    odd += [(40_000 + k, prose(800, 200) + " " + prose(810 + k, 30 + 20 * k), "en", "x", 1) for k in range(6)]
    docs = common.staged(real.unionByName(spark.createDataFrame(odd, real.schema)), "documents")
    wanted = brute_kept({row.doc_id: row.text for row in docs.collect()})
    found = [row.doc_id for row in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf_dir).collect()]
    assert sorted(found) == sorted(wanted)


def test_links_of_many_sets():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate((r.choice(base, 900, replace=False) if k % 3 else base[: 900 + 3 * k], base[:k]))) for k in range(60)]
    plain = [set(x.tolist()) for x in sets]
    for most in (7, 2048):
        found = brute_components(range(60), similar.links_of(sets, most=most))
        assert found == brute_components(range(60), [(a, b) for a in range(60) for b in range(a) if alike(plain[a], plain[b])])
    assert all(bool(similar.links_of([sets[a], sets[b]])) == alike(plain[a], plain[b]) for a in range(60) for b in range(a))


def test_chains_are_followed_through_tiles(spark):
    """Texts of a sliding window: neighbours are alike, the ends are not, so that the centre reaches few of a group."""
    words = prose(950, 900).split()
    texts = {k: " ".join(words[5 * k : 5 * k + 200]) for k in range(120)}
    texts |= {1000 + k: " ".join(words[:150] + prose(960 + k, 50 + 5 * k).split()) for k in range(20)}
    docs = common.staged(spark.createDataFrame(list(texts.items()), "row long, text string"), "docs")
    bands = similar.prints(docs.selectExpr("row", "row as doc_id", "text")).select("row", "bands")
    wanted = brute_components(texts, [(a, b) for a in texts for b in texts if a < b and alike(shingle_set(texts[a]), shingle_set(texts[b]))])
    for block in (3, 1024):
        found = {x.node: x.root for x in similar.similar_roots(bands, lambda rows: docs.join(rows, "row", "left_semi"), block=block).collect()}
        assert {k: found.get(k, k) for k in texts} == wanted, block


def test_no_row_is_sent_to_every_other(spark):
    """A group that is alike with its centre needs no tiles."""
    words = prose(970, 300).split()
    texts = {k: " ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(100)}
    docs = common.staged(spark.createDataFrame(list(texts.items()), "row long, text string"), "docs")
    bands = similar.prints(docs.selectExpr("row", "row as doc_id", "text")).select("row", "bands")
    members = similar.band_groups(bands)
    tiles = similar.star_tiles(members, 10)
    assert tiles.groupBy("tile").agg({"first": "count"}).filter("`count(first)` > 30").count() == 0
    stars = similar.linked_in_tiles(tiles, docs, 80, 5)
    roots = similar.components(stars.selectExpr("a as u", "b as v"))
    assert similar.rest_tiles(members, roots, 10).count() == 0
    assert roots.count() == 99


def test_simhash_links_are_candidates(spark):
    """Rows that share no band are found by the SimHash operator, and stay apart where they are not alike."""
    words = prose(980, 900).split()
    texts = {k: " ".join([*words[: 2 * k], f"new{k}", *words[2 * k + 1 :]]) for k in range(20)} | {100 + k: prose(981 + k, 60) for k in range(5)}
    docs = common.staged(spark.createDataFrame(list(texts.items()), "row long, text string"), "docs")
    groups = simhash.near_duplicates(docs.selectExpr("row as doc_id", "text"), words=5)
    linked = {r.doc_id for r in groups.collect() if r.doc_id != r.component_id}
    assert len(linked) > 5 and linked <= set(range(1, 20))
    bands = similar.with_groups(docs.selectExpr("row", "array(row) as bands"), groups)
    found = {x.node for x in similar.similar_roots(bands, lambda rows: docs.join(rows, "row", "left_semi")).collect()}
    assert found == linked


def test_near_stage_goes_through_simhash(spark, sf_dir, monkeypatch):
    docs, calls, operator = common.table(spark, sf_dir, "documents").limit(50), [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(k) or operator(*a, **k))
    corpus_pipeline.near(spark, common.staged(docs, "documents"), sf_dir).count()
    assert calls == [{"words": 5}]
