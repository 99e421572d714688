"""The corpus operators against brute force, on small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkora.llm import chat, common, decontam, exact_dedup, hashing, langid, packing, queries, sharding, simhash, substring_dedup, tokens, training_order, wordpiece
from linkora.llm.components import components

WORDS = "alpha beta gamma delta the of and zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows():
    """(doc_id, text) with the awkward cases."""
    shared = prose(1, 120)
    base = [prose(i, 60 + i) for i in range(2, 30)]
    texts = [*base, base[0], base[0], base[1] + " ", base[1].replace(" ", "\n", 3), None, None, "", " ", "\t\n", "é", "a", "a b", "A  b", "ab " * 400, "x" * 1500, prose(50, 4000)]
    texts += [prose(100 + i, 40) + " " + shared + " " + prose(200 + i, 30) for i in range(6)]
    texts += ["1234 5678", "!!! ???", "<|endoftext|> and <|endoftext|>", "naïve Übung  —  “quotes” \u00a0x\u2028y", "日本語のテキスト", "a\r\nb\x0bc\x0cd"]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (3, out[3][1]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en", "x", "y", 1) for i, t in rows()]
    # columns whose names clash with the operators' own
    return spark.createDataFrame(data, "doc_id long, text string, lang string, digest string, size string, part int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, digest string, size string, part int")


def key(x):
    return tuple((v is None, str(v)) for v in x)


# --- packing


def test_bpe_agrees_with_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = tokens.ByteBpe(tokens.bpe_file(), tokens.bpe_pattern(), memo=50, part=2000)
    odd = ["so, it ended. then; what?! e.g. (this) x,y é, " + "z" * 70 + ". q", "a  b", " a", "a ", "a \n b", "\n a", "a\n", "it's we'll", "a\u00a0 b", "\x1c a", "x \x85y", "  ", "a\tb c", "end. \n\nNext"]
    odd += ["a" + " " * 1500 + "b", "\n" * 1200 + "x", " " * 2000, "x " + "\n" * 3000 + " y " + "\t" * 1001, "z" * 5000 + "\n" * 1000 + "q w", "a  <|endoftext|>\n\n x", "<|endoftext|>", "\x1c\x1d a   b"]
    for text in [t for _, t in rows() if t is not None] + odd:
        wanted = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == wanted, text
    texts = [t for _, t in rows()] + odd
    wanted = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
    found = [ids[a:b].tolist() for ids, bounds in bpe.batches(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == wanted
    assert list(bpe.batches(pa.array([], pa.string()))) == []


def test_a_very_long_run_of_white_space_is_encoded():
    bpe = tokens.ByteBpe(tokens.bpe_file(), tokens.bpe_pattern())
    assert len(bpe.ids(" " * 3_000_000 + "x")) > 0 and len(bpe.ids("\n" * 3_000_000)) > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 64)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(64)
        assert (bins[i], offsets[i]) == (b, 64 - room[b])
        room[b] -= lengths[i]


def test_packing(spark, docs, empty):
    found = packing.pack(docs, capacity=256, group_docs=16, with_ids=True).collect()
    bpe = tokens.ByteBpe(tokens.bpe_file(), tokens.bpe_pattern())
    wanted = Counter()
    for doc_id, text in rows():
        ids = bpe.ids(text or "") + b"\1\0\0\0"
        for at in range(0, len(ids) // 4, 256):
            part = ids[4 * at : 4 * at + 1024]
            wanted[doc_id, at, len(part) // 4, zlib.crc32(part), len(ids) // 4, part] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_packing_wastes_little(spark, sf_dir):
    found = queries.op1_packing(spark, sf_dir).toPandas()
    used, sequences = found.length.sum(), found.sequence_id.nunique()
    assert used / (2048 * sequences) > 0.95


# --- language ID


def test_suffix_automaton_holds_all_substrings_and_no_other():
    automaton = langid.SuffixAutomaton()
    words = ["abcbc", "bcab", "ccb", "abcbc"]
    for w in words:
        automaton.add(w)
    inside = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def accepted(s):
        state = 0
        for c in s:
            state = automaton.next[state].get(c)
            if state is None:
                return False
        return True

    import itertools

    for n in range(1, 6):
        for s in map("".join, itertools.product("abcd", repeat=n)):
            assert accepted(s) == (s in inside), s
    for text in ("abcab", "ddab", "", "bcbcab", "zz"):
        assert automaton.phrases(text) == brute_phrases(text, words), text


def brute_phrases(text, training):
    count, at = 0, 0
    while at < len(text):
        n = max((n for n in range(1, len(text) - at + 1) if any(text[at : at + n] in t for t in training)), default=1)
        count, at = count + 1, at + n
    return count


def brute_normalised(text):
    out = " "
    for c in (text or "").lower():
        out += c if c.isalpha() or 0x300 <= ord(c) <= 0x36F else " " if out[-1] != " " else ""
    return out.encode(), sum(c.isalpha() for c in (text or "").lower())


LANGUAGE_TEXTS = [t for _, t in rows()] + ["\u0301", "e\u0301t\u00e9", "İstanbul ẞ", "\n\n a\nb\n", "123 !!", " x", "x ", "日本 語", "a" * 5000 + " b", "", None]


def test_texts_are_normalised():
    data, starts, letters = langid.normalised(LANGUAGE_TEXTS)
    found = [data[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert list(zip(found, letters.tolist(), strict=True)) == [brute_normalised(t) for t in LANGUAGE_TEXTS]
    assert langid.normalised([])[0].tolist() == []


def test_cross_parsing_and_its_decision(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    training = {"a": [prose(1, 40), "the end"], "b": ["Übung macht den Meister, sagt man", prose(3, 30)[::-1]], "c": ["日本語のテキスト", "42"], "d": ["12 34"]}
    model = langid.LanguageModel([x for name in training if (x := langid.learned(name, training[name]))])
    assert [x.name for x in model.languages] == ["a", "b", "c"]
    parser = langid.Parser(model)
    held = {x.name: [brute_normalised(t)[0] for t in training[x.name]] for x in model.languages}
    texts = [t if t is None else t[:700] for t in LANGUAGE_TEXTS]
    data, starts, _ = langid.normalised(texts)
    found, wanted = parser.phrases(data, starts).tolist(), []
    for text in texts:
        whole = brute_normalised(text)[0]
        wanted.append([sum(brute_phrases(whole[i : i + 64], held[x.name]) for i in range(0, len(whole), 64)) for x in model.languages])
    assert found == wanted
    for text, counts, (name, score) in zip(texts, wanted, parser.decide(texts), strict=True):
        cost = sorted((n * np.log2(2 + sum(map(len, held[x.name]))), x.name) for n, x in zip(counts, model.languages, strict=True))
        if brute_normalised(text)[1]:
            assert name == cost[0][1] and abs(score - (1 - cost[0][0] / cost[1][0])) < 1e-12
        else:
            assert (name, score) == ("und", 0.0)


def test_the_language_sample_is_bounded_and_held_out_rows_are_not_in_it(spark):
    data = [(i, f"{'a' if i % 3 else 'b'}{i} " * (1 if i % 2 else 3000), "x" if i % 3 else "y") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (1002, "only", None), (1003, None, "none")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = langid.sample(docs, rows_per_language=20, chars_per_row=50)
    assert {k: len(v) for k, v in found.items()} == {"x": 20, "y": 20} and all(len(t) <= 50 for v in found.values() for t in v)
    out = {t for i, t, _ in data if t and zlib.crc32(str(i).encode()) % 5 == 0}
    assert not any(t in o for v in found.values() for t in v for o in out)


def test_language_id(spark, sf_dir, empty):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()
    true = docs.select("doc_id", "lang").toPandas()
    both = found.merge(true, on="doc_id")
    assert len(found) == len(true)
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and with from"), (5, "\u0301"), (None, "é")], "doc_id long, text string")
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[5] == ("und", 0.0)
    assert by_id[4][0] == "en" and by_id[None][0] != "und"
    untrained = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(odd, untrained).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


# --- word hashes


@pytest.mark.parametrize("chunk", [1 << 22, 16, 5])
def test_hashed_words_are_those_of_a_pattern(monkeypatch, chunk):
    monkeypatch.setattr(hashing, "CHUNK", chunk)
    outside = np.zeros(256, bool)
    outside[[32, *range(9, 14)]] = True
    r, known = random.Random(chunk), {}
    for _ in range(200):
        texts = ["".join(r.choice("ab \n") for _ in range(r.randrange(40))).encode() for _ in range(r.randrange(6))]
        starts = np.array([sum(map(len, texts[:i])) for i in range(len(texts))], np.int64)
        places, hashes = hashing.hashed_words(np.frombuffer(b"".join(texts), np.uint8), outside, starts)
        wanted = [(s + m.start(), m[0]) for s, t in zip(starts.tolist(), texts, strict=True) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)]
        assert places.tolist() == [at for at, _ in wanted]
        assert all(known.setdefault(w, h) == h for h, (_, w) in zip(hashes.tolist(), wanted, strict=True))
    assert len(set(known.values())) == len(known)


# --- substring dedup


def brute_substrings(texts, length):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    return gone


@pytest.mark.parametrize("p", [2, 3, 5, 13])
def test_difference_cover(p):
    v, cover = substring_dedup.difference_cover(p)
    assert v == p * p + p + 1 and len(cover) == p + 1
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def brute_shared_words(texts, words):
    split = [re.findall(b"[^\x20\x09-\x0d]+", t) for t in texts]
    owners = defaultdict(set)
    for d, w in enumerate(split):
        for i in range(len(w) - words + 1):
            owners[tuple(w[i : i + words])].add(d)
    return [len({j for i in range(len(w) - words + 1) if len(owners[tuple(w[i : i + words])]) > 1 for j in range(i, i + words)}) for w in split]


@pytest.mark.parametrize(("length", "p", "words", "words_p"), [(400, 13, 51, 5), (40, 3, 8, 2), (16, 2, 15, 3)])
def test_substring_dedup(spark, docs, length, p, words, words_p):
    extra = [prose(7, 200)[: 400 + k] + prose(900 + k, 20) for k in range(4)] + ["q" * 399, "q" * 800, "ab" * 500, prose(8, 90)[:400], "z" + prose(8, 90)[:400]]
    extra += ["a b " * 40, "a\tb " * 40, "c " * 90 + "\n" + "d " * 90, prose(9, 51), "x " + prose(9, 51) + "\u00a0y", prose(9, 50) + "z"]
    data = rows() + [(1000 + i, t) for i, t in enumerate(extra)]
    table = spark.createDataFrame([(i, t, "n") for i, t in data], "doc_id long, text string, n_bytes string").repartition(4)
    texts = [(t or "").encode() for _, t in data]
    wanted = []
    for (doc_id, _), text, gone, shared in zip(data, texts, brute_substrings(texts, length), brute_shared_words(texts, words), strict=True):
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        wanted.append((doc_id, len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), shared))
    found = [tuple(r) for r in substring_dedup.remove_repeats(table, length=length, p=p, words=words, words_p=words_p, block_bytes=3000).collect()]
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_keys_that_agree_in_their_first_part_only_are_not_tied():
    keys, check = np.array([5, 5, 5, 9], np.uint64) << np.uint64(8), np.array([1, 2, 1, 1], np.uint32)
    ranks = substring_dedup.Ranks(keys, 4, 0, check)
    assert ranks.tied({}).tolist() == [True, False, True, False]
    blobs = [x for _, x in ranks.outgoing()]
    table = pa.table({"block": pa.array([1, 2], pa.int64()), "bucket": pa.array([0, 0], pa.int32()), "keys": pa.array([blobs[0], blobs[0][12:24]], pa.binary())})
    masks = substring_dedup.sort_bucket(table, 12).column("mask").to_pylist()
    assert [np.unpackbits(np.frombuffer(m, np.uint8)).tolist()[:n] for m, n in zip(masks, (3, 1), strict=True)] == [[0, 1, 0], [1]]


def test_a_text_longer_than_a_block(spark):
    passage = prose(600, 300)[:1500]
    long = prose(601, 250_000) + "<" + passage + ">" + prose(602, 250_000)
    assert len(long) > 3 << 20
    table = spark.createDataFrame([(1, long), (2, prose(603, 50) + "(" + passage + ")"), (3, prose(604, 90)), (4, "z" * 2_500_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(table).collect()}
    assert [(found[i].n_removed, found[i].n_spans) for i in (1, 2, 3, 4)] == [(1500, 1), (1500, 1), (0, 0), (2_500_000, 1)]
    kept = long.replace("<" + passage + ">", "<>")
    assert found[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    inner = len(passage.split()) - 2  # its outer words are joined to others on either side
    assert (found[1].n_shared_words, found[2].n_shared_words, found[3].n_shared_words, found[4].n_shared_words) == (inner, inner, 0, 0)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# --- token counts


def test_token_counts(spark, docs, empty):
    starts, inner = map(set, wordpiece.byte_pieces(wordpiece.rank_file()))
    wanted = []
    for doc_id, text in rows():
        counts = [wordpiece.greedy(w, starts, inner) for w in (text or "").encode().split()]
        wanted.append((doc_id, len(counts), sum(counts), max(counts, default=0)))
    assert sorted(map(tuple, wordpiece.token_counts(docs).collect()), key=key) == sorted(wanted, key=key)
    assert wordpiece.token_counts(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abcd", max_size=12))
def test_longest_match_automaton(starts, inner, word):
    starts, inner = [s.encode() for s in starts], [s.encode() for s in inner]
    assert wordpiece.LongestMatch(starts, inner).count(word.encode()) == wordpiece.greedy(word.encode(), set(starts), set(inner))


# --- exact dedup


def test_exact_dedup_in_batches(spark, docs, empty, tmp_path):
    def normal(t):
        return re.sub("[\x20\x09-\x0d]+", " ", t or "")

    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    found = exact_dedup.deduplicate(docs, index).collect()
    groups = defaultdict(list)
    for doc_id, text in rows():
        groups[hashlib.sha256(normal(text).encode()).hexdigest()].append(doc_id)
    kept = Counter()
    for r in found:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.keep_id == (min(ids) if ids else None)
        assert r.group_size == len(groups[r.text_sha256])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups) and len(found) == len(rows())
    assert index.rows().count() == len(groups)
    index.close()
    again = exact_dedup.DigestIndex(spark.newSession(), f"file://{tmp_path}/index")
    assert again.buckets == 4
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=16)
    later = again.spark.createDataFrame([(-5, rows()[4][1]), (900, "quite new"), (899, "quite  new")], "doc_id long, text string")
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(later, again).collect()}
    assert second == {-5: (4, False), 900: (899, False), 899: (899, True)}
    assert again.rows().count() == len(groups) + 1
    before = sorted(map(tuple, again.rows().collect()), key=key)
    again.ROWS = 10
    again.compact()
    assert again.buckets > 4 and sorted(map(tuple, again.rows().collect()), key=key) == before
    third = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    assert third.buckets == again.buckets
    whole = exact_dedup.deduplicate(docs.unionByName(docs.limit(3)), third).collect()
    assert not any(r.kept for r in whole) and {r.text_sha256: r.keep_id for r in whole} == {r.text_sha256: r.keep_id for r in found}
    assert exact_dedup.deduplicate(empty, exact_dedup.new_index(spark)).count() == 0


def test_the_index_is_read_without_a_shuffle(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    exact_dedup.deduplicate(docs, index)
    dealt = index.dealt(spark.createDataFrame([("a", 1)], "digest string, first long"))
    for found in (index.unknown(dealt), index.known(dealt)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


# --- sharding


def test_sharding(spark, docs, empty):
    for data, table in ((rows(), docs), ([(i, "hot" * 50) for i in range(300)] + [(1000 + i, prose(i, 9)) for i in range(200)], None)):
        table = table or spark.createDataFrame(data, "doc_id long, text string").repartition(5)
        found = sharding.shard_by_bytes(table).collect()
        wanted = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data), key=key)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=key) == wanted
        sizes, slots = Counter(), defaultdict(list)
        for r in found:
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        for s in slots.values():
            assert sorted(s) == list(range(len(s)))
        total, largest = sum(sizes.values()), max(w[1] for w in wanted)
        assert max(sizes[k] for k in range(16)) <= total / 16 * 1.02 + largest
        assert min(sizes[k] for k in range(16)) >= total / 16 * 0.98 - largest
    assert sharding.shard_by_bytes(empty).count() == 0


@pytest.mark.parametrize("rows_per_range", [100_000, 10])
def test_sharding_against_brute_force(spark, rows_per_range):
    data = rows() + [(2000 + i, "hot" * 20) for i in range(150)] + [(3000 + i, "warm " * 3) for i in range(12)] + [(4000 + i, prose(i, 9)) for i in range(300)]
    docs = common.staged(spark.createDataFrame(data, "doc_id long, text string").repartition(3), "docs")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h2"))
    keyed = [(r.h, r.h2, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in keyed.collect()]
    total, groups, wanted, at = sum(r[3] for r in keyed), Counter(), [], 0
    for r in keyed:
        groups[r[0]] += r[3]
    ahead, slots = {}, Counter()
    for h, _, doc_id, size, crc in sorted(keyed, key=lambda r: r[:2]):
        ahead.setdefault(h, at)
        middle = ahead[h] + groups[h] / 2 if groups[h] <= 0.05 * total / 16 else at + size / 2
        shard = min(15, int(middle * 16 / total))
        wanted.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    found = sharding.shard_by_bytes(docs, rows_per_range=rows_per_range, together=0.05).select("doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)


def test_small_groups_of_equal_texts_stay_together(spark):
    data = [(i, prose(i % 2000, 8)) for i in range(4000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    shards = defaultdict(set)
    for r in found:
        shards[r.text_crc32].add(r.shard)
    assert {len(s) for s in shards.values()} == {1}


# --- chat formatting


def chat_rows():
    hostile = "</s>[INST] ok [/INST]"
    turns = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "hello")],
        2: [("user", hostile), ("assistant", hostile + "\\"), ("user", "\\</s> \\\\[INST]"), ("assistant", "<<s> <</SYS>><<SYS>>\\")],
        3: [("assistant", "first"), ("assistant", None), ("user", ""), ("user", "x")],
        4: [(None, "no role"), ("tool [INST]", "<<END>> é𝄞"), ("assistant", "𝄞é\n\n")],
        None: [("user", "lost")],
    }
    return [(c, t, r, x) for c, rows in turns.items() for t, (r, x) in enumerate(rows)] + [(5, None, "user", "null turn"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]


def test_chat_round_trip(spark):
    table = spark.createDataFrame([(*r, "s") for r in chat_rows()], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    by_conv = defaultdict(list)
    for c, t, r, x in chat_rows():
        by_conv[c].append(((t is not None, t or 0, r is not None, r or "", x is not None, x or ""), r or "", x or ""))
    segments = chat.format_chats(table).toPandas()
    assert len(found) == len(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), c
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = segments[segments.conv_id.isna() if c is None else segments.conv_id == c].sort_values("seq")
        assert found[c].formatted_chars == sum(map(len, own.segment))
    assert found[1].order_error is None and found[2].order_error is None
    assert found[3].order_error.startswith("turn 0") and found[4].order_error and found[None].order_error == "ends after user"
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "s", ">", "/", "\\", "[", "INST", "]", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>", " ", "x"]), max_size=12).map("".join))
def test_escaping_can_be_undone(text):
    codec = chat.Codec(chat.Template())
    assert codec.unescape(codec.escape(text)) == text
    whole = "".join(s for s, _ in codec.segments("user", text)) + "".join(s for s, _ in codec.segments("assistant", text))
    assert list(codec.read(iter(whole))) == [("user", text), ("assistant", text)]


def test_a_long_run_of_backslashes_takes_linear_time():
    codec, text = chat.Codec(chat.Template()), "\\" * 2_000_000 + " x" + "\\" * 1_000_000 + "</s>"
    assert codec.unescape(codec.escape(text)) == text and len(codec.escape(text)) == len(text) + 1


# --- SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, empty):
    found = simhash.near_duplicates(docs).collect()
    data = [(i, brute_fingerprint(t)) for i, t in rows()]
    assert sorted(((r.doc_id, r.fingerprint) for r in found), key=key) == sorted(((i, f"{f:016x}") for i, f in data), key=key)
    of = {i: f for i, f in data if i is not None}
    wanted = brute_components(of, [(a, b) for a in of for b in of if a < b and (of[a] ^ of[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in fps[:120]:
        for _ in range(r.randrange(1, 4)):
            g = f
            for b in r.sample(range(64), r.randrange(1, 6)):
                g ^= 1 << b
            fps.append(g)
    dense = [f for f in {(0xABCDEF << 40) ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)}]
    fps = sorted({*fps, *dense})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(4)
    wanted = brute_components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
    for heavy, at_once in ((50_000, 500_000), (60, 100)):
        links = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.near_links(table, heavy=heavy, at_once=at_once).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        assert brute_components(fps, links) == wanted


def test_a_large_group_is_split_exactly():
    r = np.random.default_rng(3)
    fps = np.unique(np.concatenate([r.integers(0, 1 << 63, 400, dtype=np.uint64), np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64) | np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)]))
    plain = brute_components(fps.tolist(), [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 3])
    assert brute_components(fps.tolist(), simhash.links_within(fps, 3, small=16)) == plain


def test_components_of_chains_and_stars(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = brute_components({x for e in edges for x in e}, edges)
    assert found == {k: v for k, v in wanted.items() if k != v}


# --- training order


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 62))
def test_feistel_is_a_permutation(n, secret):
    slots = training_order.feistel(np.arange(n), n, secret)
    assert sorted(slots.tolist()) == list(range(n))
    assert training_order.inverse_feistel(slots, n, secret).tolist() == list(range(n))


def test_recoding_can_be_undone():
    r = np.random.default_rng(2)
    recoder = training_order.Recoder(r.permutation(1 << 16).astype(np.uint16))
    for ids in (np.zeros(1), np.arange(1 << 16), r.integers(0, 1 << 16, 2048), recoder.id_of[[0, 223, 224, 8159, 8160, 65535]]):
        data = ids.astype("<u2").tobytes()
        assert recoder.unpack(recoder.pack(data), len(ids)) == data


def test_training_order_files(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/order"
    stored = common.staged(docs, "docs")
    found = sorted(training_order.materialise(stored, path, length=64, per_shard=16, pad_id=9, key=5).collect())
    n = len(found)
    bpe = tokens.ByteBpe(tokens.bpe_file(), tokens.bpe_pattern())
    # brute force: each partition's ids in a row, cut every 64, the i-th sequence at slot feistel(i)
    parts = defaultdict(list)
    for r in stored.select("text", F.spark_partition_id().alias("part")).collect():
        parts[r.part] += [*np.frombuffer(bpe.ids(r.text or ""), "<u4").tolist(), 1]
    wanted = [parts[k][i : i + 64] for k in sorted(parts) for i in range(0, len(parts[k]), 64)]
    assert len(wanted) == n and [r.slot for r in found] == list(range(n))
    files = {k: (tmp_path / "order" / f"shard-{k:06d}.bin").read_bytes() for k in range(-(-n // 16))}
    for i, (slot, ids) in enumerate(zip(training_order.feistel(np.arange(n), n, 5).tolist(), wanted, strict=True)):
        r = found[slot]
        data = files[slot // 16][128 * (slot % 16) : 128 * (slot % 16) + 128]
        assert np.frombuffer(data, "<u2").tolist() == ids + [9] * (64 - len(ids))
        assert (r.sequence, r.shard, r.byte_offset, r.n_ids, r.ids_crc32) == (i, slot // 16, 128 * (slot % 16), len(ids), zlib.crc32(data))
    assert sum(map(len, files.values())) == 128 * n
    assert training_order.materialise(empty, f"file://{tmp_path}/none").count() == 0


def test_ids_of_over_16_bits_are_refused(docs, tmp_path):
    with pytest.raises(ValueError):
        training_order.materialise(docs, f"file://{tmp_path}/wide", end_id=1 << 16)


# --- decontamination


def brute_contamination(docs, items, length=13):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(t):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - length + 1)) if w else ():
            windows[tuple(w[i : i + length])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, docs, empty):
    text = dict(rows())
    items = [(1, text[5]), (20, text[43][30:400]), (3, "beta7 the9"), (100, ""), (4, None), (7, "日本語のテキスト"), (8, "alpha1 ... Alpha1"), (9, text[5]), (10, "nowhere to be seen at all in here")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_hit int")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    wanted = sorted(brute_contamination(rows(), items), key=key)
    for most in (4 << 20, 200):
        found = decontam.contamination(docs, bench, most_bytes=most).select(*columns).collect()
        assert sorted(map(tuple, found), key=key) == wanted
    assert decontam.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, bench.limit(0)).collect()} == {0}


def brute_near(docs, items, length=13, slop=3):
    """Places of each document where a window's rarest word stands and all others are within ``slop`` of their places."""
    split = [(d, decontam_words(t)) for d, t in docs]
    counts = Counter(w for _, words in split for w in words)
    windows = set()
    for _, text in items:
        w = decontam_words(text)
        windows |= {tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()
    out = Counter()
    for d, words in split:
        at = defaultdict(set)
        for i, w in enumerate(words):
            at[w].add(i)
        places = set()
        for window in windows:
            if all(w in at for w in window):
                k0 = min(range(len(window)), key=lambda k: (counts[window[k]], k))
                places |= {i for i in at[window[k0]] if all(any(i - k0 + k + e in at[w] for e in range(-slop, slop + 1)) for k, w in enumerate(window))}
        out[d, len(places)] += 1
    return out


def decontam_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_proximity(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, line), (2, "two words"), (3, line + " fourteen one"), (4, "alone"), (5, None)]
    data = [(1, line), (2, line.replace("seven", "seven x")), (3, "one two"), (4, "words two and two of words"), (5, line + " and " + line.replace("ten", "ten a b c d")), (6, None), (6, ""), (7, "thirteen " + line), (None, "alone ... Alone")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    index = decontam.build_index(docs)
    for most in (4 << 20, 1):
        found = decontam.contamination(docs, bench, most_bytes=most, index=index).collect()
        assert Counter((r.doc_id, r.n_near) for r in found) == brute_near(data, items)
        by_id = {r.doc_id: r for r in found}
        assert [(x.start, x.stop) for x in by_id[1].spans][:1] == [(0, 13)] and by_id[2].n_hit == 0 and {x.item for x in by_id[2].near} == {"1", "3"}
        assert by_id[None].items == ["4"] and [x.place for x in by_id[None].near] == [0, 1]


def test_one_index_serves_several_test_sets(spark, docs):
    index = decontam.build_index(docs)
    assert decontam.documents(index).count() == len(rows())
    text = dict(rows())
    for items in ([(1, text[5])], [(2, text[43][30:400]), (3, "beta7 the9")], []):
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = decontam.contamination(docs, bench, index=index)
        wanted = brute_contamination(rows(), items)
        assert Counter((r.doc_id, r.n_hit, r.items_sha256) for r in found.collect()) == Counter((w[0], w[2], w[4]) for w in wanted)
        assert Counter((r.doc_id, r.n_near) for r in found.collect()) == brute_near(rows(), items)
