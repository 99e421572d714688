"""The linkage operators: against DuckDB, against plain Python, and their invariants."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linkora.operators import assign, blocking, features, ids, learn, matcher, sampling, tfidf, tokens
from linkora.plans import oracle
from linkora.plans import queries
from linkora.plans.queries import QUERIES, Linkage
from linkora.sources import delimited, outputs, staging

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def linkage(spark, sf_dir):
    return Linkage(spark, sf_dir)


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: f"{v:.6f}") if df[c].dtype.kind == "f" else df[c].astype(str)
    return Counter(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", ["norm_name", "norm_addr", "blocking_tokens", "idf", "block_vector", "candidate_cut", "field_cosines", "set_overlap_features", "tau_sweep", "fold_assignment", "development_sample", "component_geo_map", "geo_sample", "stream_link", "fuzzy_token_set", "jaro_winkler", "fbeta_entities"])
def test_against_sql(spark, sf_dir, duck, name):
    found, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(oracle.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert comparable(found) == comparable(wanted)


def test_every_query_has_columns(spark, sf_dir):
    from linkora.plans.queries import _QUERIES

    assert set(oracle.ORACLE_SQL) <= set(_QUERIES)


def test_ids(spark):
    table = spark.createDataFrame([("S1-7",), ("S3-1234567890",)], "e string")
    assert [tuple(r) for r in table.select(ids.source_of(F.col("e")), ids.encoded(F.col("e"))).collect()] == [(1, 10**10 + 7), (3, 3 * 10**10 + 1234567890)]


def test_tokens_by_hand(spark):
    row = spark.createDataFrame([("e", "US", "green leaf x co", "green leaf x co | gl", "12 polk street 7")], "entity_id string, country string, core string, alias string, addr string")
    found = tokens.with_tokens(row).first()
    assert found.tok_name == sorted(["US|n|green", "US|n|leaf", "US|n|co", "US|nb|green_leaf", "US|nb|leaf_x", "US|nb|x_co", "US|nc|greenleafxco", "US|n|gl"])
    assert found.tok_addr == ["US|ab|12_polk", "US|a|polk", "US|a|street"] and found.tok_num == ["US|#|12", "US|#|7"]
    hashed = spark.createDataFrame([("US|n|café",)], "t string").select(tokens.hashed(F.col("t"))).first()[0]
    assert hashed == zlib.crc32("US|n|café".encode()) & 0xFFFFFF


def test_vectors_have_norm_one(linkage):
    for rows, keys in ((linkage.weights(linkage.s_tokens), ["entity_id", "field"]), (linkage.q_block, ["entity_id"])):
        norms = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
        assert norms.filter(F.abs(F.col("n") - 1) > 1e-9).count() == 0


def test_cosine_join_against_plain_python(spark):
    rows = [("a", "US", "name", t) for t in "xyz"] + [("b", "US", "name", t) for t in "xy"] + [("c", "IN", "name", t) for t in "xyz"] + [("d", "US", "addr", "x")]
    table = spark.createDataFrame(rows, "entity_id string, country string, field string, tok string")
    frequency = tfidf.document_frequency(table)
    vectors = tfidf.block_vector(table, frequency, 4, 10)
    found = {(r.q_id, r.s_id): r.cos for r in blocking.cosine_pairs(vectors, vectors).collect()}
    df = Counter((f, t) for _, _, f, t in rows)
    weight = defaultdict(dict)
    for e, c, f, t in rows:
        weight[e, c][t] = weight[e, c].get(t, 0) + (math.log(5 / (df[f, t] + 1)) + 1)
    for (e, c), v in weight.items():
        n = math.sqrt(sum(w * w for w in v.values()))
        weight[e, c] = {t: w / n for t, w in v.items()}
    wanted = {(e, e2): round(sum(w * v2.get(t, 0) for t, w in v.items()), 6) for (e, c), v in weight.items() for (e2, c2), v2 in weight.items() if c == c2 and set(v) & set(v2)}
    assert found == pytest.approx(wanted)
    assert ("a", "c") not in found


def test_top_candidates_and_ties(spark):
    pairs = spark.createDataFrame([("q", f"s{i}", 0.9 - 0.1 * (i // 2)) for i in range(12)] + [("r", "s0", 0.05)], "q_id string, s_id string, cos double")
    kept = sorted((r.cos_rank, r.s_id) for r in blocking.top_candidates(pairs, top_k=5, rel_cos=0.8).collect())
    assert kept == [(1, "s0"), (2, "s1"), (3, "s2"), (4, "s3")]


def test_results_do_not_depend_on_partitions(spark, linkage):
    wanted = Counter(map(tuple, linkage.candidates.select("q_id", "s_id", "cos", "cos_rank").collect()))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = blocking.top_candidates(blocking.cosine_pairs(linkage.q_block.repartition(5), linkage.s_block))
        assert Counter(map(tuple, again.select("q_id", "s_id", "cos", "cos_rank").collect())) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_f_beta(spark):
    entities = spark.createDataFrame([(s, "US") for s in "abcde"], "entity_id string, country string")
    rows = lambda data: spark.createDataFrame(data, "s_id string, q_id string")
    found = {r.s_id: r.f for r in assign.f_beta_by_entity(entities, rows([("a", "1"), ("a", "2"), ("b", "3"), ("c", "9")]), rows([("a", "1"), ("b", "3"), ("b", "4"), ("d", "5")])).collect()}
    assert found == pytest.approx({"a": 1.25 * 0.5 / (0.25 * 0.5 + 1), "b": 1.25 * 0.5 / (0.25 + 0.5), "c": 0, "d": 0, "e": 1})


def test_best_owner_ties(spark):
    pairs = spark.createDataFrame([("q", "b", 0.5, 0.7), ("q", "a", 0.5, 0.7), ("q", "c", 0.5, 0.6), ("r", "a", 0.9, 0.2)], "q_id string, s_id string, cos double, p double")
    assert sorted((r.q_id, r.s_id) for r in assign.best_owner(pairs).collect()) == [("q", "a"), ("r", "a")]
    assert [r.q_id for r in assign.best_owner(pairs, 0.7).collect()] == ["q"]


def test_pick_groups(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 60), ("c", 20), ("d", 10)], "geo string, n long")
    assert sorted(r.geo for r in sampling.pick_groups(sizes, 0.4, F.col("geo")).collect()) == ["a", "c", "d"]
    assert sorted(r.geo for r in sampling.pick_groups(sizes, 0.2, F.col("geo")).collect()) == ["a", "d"]


def test_translit_table(spark, sf_dir):
    found = {r.src: r.tgt for r in QUERIES["translit_learn"](spark, sf_dir).collect()}
    assert found["hospitailiti"] == "hospitality" and found["praivet"] == "private" and found["mharastr"] == "maharashtra"
    table = learn.as_dict(QUERIES["translit_learn"](spark, sf_dir))
    assert table == found
    with pytest.raises(ValueError):
        learn.as_dict(QUERIES["translit_learn"](spark, sf_dir), most=1)


def test_development_records(spark, sf_dir, linkage):
    found = QUERIES["development_sample"](spark, sf_dir)
    sample = QUERIES["geo_sample"](spark, sf_dir)
    assert found.groupBy("entity_id").count().filter("count > 1").count() == 0
    owned = linkage.records.filter("true_s1 is not null").join(sample.select(F.col("entity_id").alias("true_s1")), "true_s1", "left_semi")
    assert found.filter("true_s1 is not null").count() == owned.count()


def test_features_and_matcher(spark, linkage, tmp_path):
    pairs = staging.staged(linkage.features, "features")
    assert pairs.columns == ["q_id", "s_id", *features.FEATURES] and len(features.FEATURES) == 44
    assert pairs.count() == linkage.candidates.count()
    assert pairs.filter(" or ".join(f"{c} is null" for c in features.FEATURES)).count() == 0
    truth = linkage.records.select(F.col("entity_id").alias("q_id"), "true_s1")
    labelled = staging.staged(matcher.with_fold(matcher.labelled(pairs, truth)), "labelled")
    assert labelled.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    scored, trees = matcher.out_of_fold(labelled, rounds=3, depth=3)
    scored = staging.staged(scored, "scored")
    assert scored.count() == labelled.count() and len(trees) == 3
    right = assign.best_owner(scored, 0.5).filter("y = 1").count()
    assert right > 0.9 * linkage.truth.count()
    model = matcher.fit(labelled, rounds=2, depth=2)
    matcher.save(model, f"file://{tmp_path}/model")
    one, two = (matcher.scored(m, labelled).select("q_id", "s_id", "p") for m in (model, matcher.load(f"file://{tmp_path}/model")))
    assert one.exceptAll(two).count() == 0
    assert matcher.final_rounds([10, 20, 30], 600) == 22 and matcher.final_rounds([0, 0], 600) == 600
    assert matcher.importances(model)[0][1] > 0


def test_training_and_inference(spark, sf_dir, linkage):
    row = queries.linkage_train_validate(linkage, rounds=3, depth=3).first()
    assert row.floor < row.f <= row.ceiling + 1e-9 and row.f > 0.9 and row.tau in queries.TAUS and row.rounds >= 1
    lists = queries.linkage_infer(linkage, rounds=3, depth=3).collect()
    assert len(lists) == linkage.n
    owner = {r.q_id: r.s_id for r in linkage.truth.collect()}
    found = [(q, r.source1_entity_id) for r in lists for q in filter(None, r.matched_entity_ids.split(","))]
    assert len(found) == len({q for q, _ in found}) and sum(owner.get(q) == s for q, s in found) > 0.9 * len(found) > 0
    fold = {r.grp: r.fold for r in queries.fold_assignment(linkage).collect()}
    assert {fold[owner.get(q, q)] for q, _ in found} == {0}


def test_learned_tokens_reach_the_candidates(spark, sf_dir, linkage):
    """Records in another script: what the table says for their tokens is what is compared."""
    x = Linkage(spark, sf_dir)
    x.entities = spark.createDataFrame([(f"S1-{i}", f"green leaf hospitality {i}", f"{i} polk street", "India") for i in range(12)], "entity_id string, business_name string, business_address string, country string")
    x.records = spark.createDataFrame([(f"S2-{i}", f"हॉस्पिटैलिटी leaf {i}", f"{i} polk street", "India", f"S1-{i}") for i in range(12)], "entity_id string, business_name string, business_address string, country string, true_s1 string")
    table = learn.as_dict(queries.learned_tokens(x))
    assert table["hospitailiti"] == "hospitality"
    x.learned = table
    assert all("hospitality" in r.core.split() and r.nonlatin for r in x.q_norm.collect())


def test_a_list_file_keeps_the_input_order(spark, tmp_path):
    entities = [f"S1-{i}" for i in (5, 3, 9, 1, 7)]
    (tmp_path / "in.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{e}\tn\ta\tUS\n" for e in entities))
    lists = spark.createDataFrame([(e, "S2-1,S3-2" if e == "S1-9" else "") for e in sorted(entities)], "source1_entity_id string, matched_entity_ids string")
    for _ in range(2):
        outputs.write_list_file(lists, delimited.read_tsv(spark, f"file://{tmp_path}/in.tsv"), f"file://{tmp_path}/out.tsv")
    wanted = "source1_entity_id\tmatched_entity_ids\n" + "".join(f"{e}\t{'S2-1,S3-2' if e == 'S1-9' else ''}\n" for e in entities)
    assert (tmp_path / "out.tsv").read_text() == wanted


def test_cleared_tables_are_gone(spark, tmp_path):
    path = staging.shared_path(spark, "x")
    assert spark.sparkContext.applicationId in path and staging.shared_path(spark, "x") != path


def test_tsv_round_trip(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    (folder / "train_source2.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tA "quoted\tback\\slash\tUS\nS2-2\t NA \t\tnull\n')
    (folder / "train_source3.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS3-1\tx\ty\tUS\n")
    (folder / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    rows = delimited.read_records(spark, "train", str(tmp_path)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S2-1", 'A "quoted', "back\\slash", "US"), ("S2-2", " NA ", "", "null"), ("S3-1", "x", "y", "US")]
    truth = delimited.exploded_truth(delimited.read_truth(spark, root=str(tmp_path)))
    assert sorted(map(tuple, truth.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    delimited.write_tsv(spark.createDataFrame(rows), f"{tmp_path}/out")
    again = delimited.read_tsv(spark, f"{tmp_path}/out").orderBy("entity_id").collect()
    assert again == rows
    assert delimited.records_with_two_owners(truth).count() == 0


def test_outputs(spark, tmp_path):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    matches = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-1"), ("S1-1", "S2-3")], "s_id string, q_id string")
    lists = assign.grouped_lists(entities, matches, "ids")
    assert sorted(map(tuple, lists.collect())) == [("S1-1", "S2-1,S2-3"), ("S1-2", "")]
    assert tuple(assign.list_statistics(lists, "ids").first()) == (2, 2, 1)
    records = spark.createDataFrame([("S2-1",), ("S2-3",)], "entity_id string")
    assert {r.n for r in outputs.violations(lists, lists, entities, records).collect()} == {0}
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", ""), ("S1-8", "S2-7")], "source1_entity_id string, ids string")
    broken = {r.rule: r.n for r in outputs.violations(bad, lists, entities, records).collect()}
    assert broken == {"entity without a row": 1, "row of an unknown entity": 1, "entity with two rows": 1, "id twice in a list": 1, "id of another source": 1, "id of no record": 2, "match that is no candidate": 2}
    file = tmp_path / "a.txt"
    file.write_text("abc")
    outputs.pack_archive(str(tmp_path / "x.zip"), {"in/a.txt": str(file)})
    outputs.pack_archive(str(tmp_path / "x.zip"), {"in/a.txt": str(file)})
    with pytest.raises(ValueError):
        outputs.verify_archive(str(tmp_path / "x.zip"), {"in/b.txt"})
    with pytest.raises(FileNotFoundError):
        outputs.pack_archive(str(tmp_path / "y.zip"), {"b": str(tmp_path / "none")})
    assert outputs.file_digests(spark, str(file)).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_scans_read_only_what_they_need(spark, linkage):
    plan = linkage.entities._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan.split("ReadSchema", 1)[1]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = staging.staged(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    staging.staged(rows.join(spark.range(7).repartition(3).withColumnRenamed("id", "k"), "k").repartition(2), "joined")
    assert not shuffle_files(spark) - before


def test_features_in_passes_are_those_of_one_pass(spark, sf_dir, linkage, monkeypatch):
    monkeypatch.setattr(queries, "PER_PASS", 400)
    x = Linkage(spark, sf_dir)
    rows = x.features
    assert len(x.q_parts) > 2 and x.q_rows.count() == linkage.q_rows.count()
    assert x.candidates.exceptAll(linkage.candidates).isEmpty() and linkage.candidates.exceptAll(x.candidates).isEmpty()
    assert rows.exceptAll(linkage.features).isEmpty() and rows.count() == linkage.features.count()


def test_documents_are_searched_in_passes(spark, sf_dir, monkeypatch):
    found = QUERIES["doc_neardup_topk"](spark, sf_dir)
    monkeypatch.setattr(queries, "PAIRS_PER_PASS", 100)
    again = QUERIES["doc_neardup_topk"](spark, sf_dir)
    assert len(again.inputFiles()) >= 2 and again.exceptAll(found).isEmpty() and again.count() == found.count() > 0


def test_documents_that_share_an_id_are_one_as_sql_has_it(spark, tmp_path, monkeypatch):
    """Rows with the same doc_id, in one or several languages; no language; words of few and of many documents; the frequencies in slices."""
    import random

    import duckdb

    from linkora.operators import nearest

    rng = random.Random(3)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i % 450, " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(0, 25))), rng.choice(["de", "en", None])) for i in range(500)]
    rows += [(None, "w1é w2é", "en"), (700, None, "en"), (701, "W1É, w2é!", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = comparable(con.sql(oracle.ORACLE_SQL["doc_neardup_topk"]).df())
    assert comparable(QUERIES["doc_neardup_topk"](spark, f"file://{tmp_path}").toPandas()) == wanted and len(wanted) > 20
    monkeypatch.setattr(nearest, "WORDS_AT_ONCE", 20)
    monkeypatch.setattr(nearest, "TILE", 7)
    assert comparable(QUERIES["doc_neardup_topk"](spark, f"file://{tmp_path}").toPandas()) == wanted


def test_records_of_one_text_are_linked_once_and_all_returned(spark, sf_dir):
    x = Linkage(spark, sf_dir)
    x.entities = spark.createDataFrame([(f"S1-{i}", f"green leaf {i} bakery", f"{i} polk street", "US") for i in range(6)], "entity_id string, business_name string, business_address string, country string")
    rows = [(f"S{2 + i % 2}-{i}", "Green Leaf 3 Bakery", "3 Polk St", "US", "S1-3" if i % 3 else None) for i in range(20)]
    rows += [("S2-50", "Green Leaf 3 Bakery", None, "US", "S1-3"), ("S2-51", "Green Leaf 3 Bakery", "", "US", "S1-3"), ("S3-52", None, "3 Polk St", "US", None), ("S3-53", "Green Leaf 3 Bakery", "3 Polk St", None, None)]
    x.records = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, true_s1 string")
    assert sum(part.count() for part in x.q_parts) == 5
    assert sorted(r.entity_id for r in x.q_rows.collect()) == sorted(r[0] for r in rows)
    found = x.features.collect()
    assert {r.q_id for r in found} == {r[0] for r in rows} - {"S3-53"} and all(r.q_src == int(r.q_id[1]) for r in found)
    same = {tuple(r[c] for c in ("s_id", *features.FEATURES) if c != "q_src") for r in found if r.q_id not in ("S2-50", "S2-51", "S3-52")}
    assert len(same) == len({s for s, *_ in same}) and len(same) * 20 == sum(r.q_id not in ("S2-50", "S2-51", "S3-52") for r in found)
    pairs = {(r.q_id, r.s_id): r for r in queries._pairs(x).collect()}
    assert len(pairs) == len(found) and pairs["S3-1", "S1-3"].y == 1 and pairs["S2-0", "S1-3"].y == 0 and pairs["S2-0", "S1-3"].grp == "S2-0"
