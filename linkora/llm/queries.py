"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, langid, packing, sharding, simhash, substring_dedup, training_order, wordpiece
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.bucket_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.new_index(spark, rows=docs.count())
    found = exact_dedup.deduplicate(docs, index)
    index.close()
    return found


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chats(rows)).withColumn("in_order", F.col("order_error").isNull()).drop("order_error")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialised(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding,
    "op7_chat_format": op7_chat_format,
    "op8_simhash": op8_simhash,
    "op9_training_order": op9_training_order,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(text, '(\\*(?:<</SYS>>|<</ROLE>>|<<SYS>>|<<ROLE>>|<<END>>|\[/INST\]|\[INST\]|</s>|<s>))', '\\\1', 'g')) AS n,
            CASE role WHEN 'system' THEN length('<<SYS>> ' || ' <</SYS>>') WHEN 'user' THEN length('[INST] ' || ' [/INST]') WHEN 'assistant' THEN length('<s> ' || ' </s>') END AS marks FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(n + marks)::BIGINT AS formatted_chars, regexp_full_match(string_agg(left(role, 1), '' ORDER BY turn, role, text), 's?(ua)+') AS in_order
        FROM e GROUP BY conv_id""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN sizes ON len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
        hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
        dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
        wins AS (SELECT row_number() OVER () AS id, string_split(win, ' ') AS w FROM (SELECT DISTINCT win FROM bw)),
        wt AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS k, len(w) AS n FROM wins),
        rare AS (SELECT id, n, t, k, coalesce(c, 0) AS c FROM wt LEFT JOIN (SELECT t, count(*) AS c FROM dt GROUP BY t) USING (t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(c, 0), k) = 1),
        found AS (SELECT a.id, x.doc_id, x.p, a.n FROM rare a JOIN dt x ON x.t = a.t JOIN wt o ON o.id = a.id JOIN dt y ON y.doc_id = x.doc_id AND y.t = o.t AND abs(y.p - (x.p - a.k + o.k)) <= 3
            GROUP BY a.id, x.doc_id, x.p, a.n HAVING count(DISTINCT o.k) = a.n),
        nr AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM found GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)""",
}
