"""Normalisers, romanisation and scores: golden cases, quirks, properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkora.functions import fuzzy
from linkora.functions.normalize import normalized, repair_ocr, skeleton
from linkora.functions.romanize import in_latin, romanize, transliterate


def norm(spark, rows, **how):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, business_name string, business_address string, country string")
    return [r.asDict() for r in normalized(table, **how).orderBy("i").collect()]


NAMES = [
    ("Orbiumbra+ a/k/a O 7 6reen Fitness, L.L.C.", "orbiumbra o 7 green fitness llc", "o 7 green fitness", "orbiumbra | o 7 green fitness"),
    ("sadarn hospitality pvt. ltd. www.southernhosp.com", "sadarn hospitality private limited southernhosp", "sadarn hospitality southernhosp", "sadarn hospitality southernhosp"),
    ("Acme s.a.s", "acme sa s", "acme", "acme"),
    ("Acme s.a.s.", "acme sas", "acme", "acme"),
    ("The Company", "the company", "the company", "the company"),
    ("3M", "3m", "3m", "3m"),
    ("Rock n Roll et Co", "rock and roll and company", "rock roll", "rock roll"),
    ("", "", "", ""),
    (None, "", "", ""),
]
ADDRESSES = [
    ("##0534 Conrad Dr, null, Kalispell, Montana", "US", "534 conrad drive kalispell mt"),
    ("No. 3-6-667/4/9 Flat No. 304, Somajiguda, Hyderabad, AP", "India", "3 6 667 4 9 flat 304 somajiguda hyderabad andhrapradesh"),
    ("63 R. DE DIEPPE, LILLE, Hauts-de-France", "France", "63 rue de dieppe lille hauts de france"),
    ("1 Main St, Miami, FL", "US", "1 main street miami floor"),
    ("1 Main St, Miami, Florida", "US", "1 main street miami fl"),
    ("12–14 Main St", "US", "1214 main street"),
    ("12-14 Main St", "US", "12 14 main street"),
    ("000 12b3c", "US", "0 12 b 3 c"),
    ("", "US", ""),
    (None, None, ""),
]


def test_names(spark):
    found = norm(spark, [(n[0], "", "US") for n in NAMES])
    for (_, *wanted), row in zip(NAMES, found, strict=True):
        assert [row["name"], row["core"], row["alias"]] == wanted
    assert not any(r["nonlatin"] for r in found)


def test_addresses(spark):
    found = norm(spark, [("x", a, c) for a, c, _ in ADDRESSES])
    assert [r["addr"] for r in found] == [w for *_, w in ADDRESSES]


def test_text_of_any_script_is_on_the_one_path(spark):
    rows = [(n[0], a, c) for n, (a, c, _) in zip(NAMES, ADDRESSES, strict=False)] + [("हॉस्पिटैलिटी Leaf", "महाराष्ट्र", "India"), (None, None, "US")]
    learned = {"hospitailiti": "hospitality"}
    found = norm(spark, rows, learned=learned)
    assert found[-2]["core"] == "hospitality leaf" and found[-2]["nonlatin"] and found[-1]["name"] == ""
    assert found[:-2] == norm(spark, rows[:-2])
    texts = ["ascii", "Café", None, "हॉस्पिटैलिटी", ""]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in table.coalesce(1).select(in_latin(F.col("t"), learned)).collect()] == [transliterate(t or "", learned) for t in texts]


def test_curly_quotes_count_as_non_latin(spark):
    row = norm(spark, [("Joe’s Café", "", "US")])[0]
    assert row["nonlatin"] and row["name"] == "joes cafe"


def test_romanisation():
    assert romanize("प्राइवेट") == "praivet"
    assert romanize("महाराष्ट्र") == "mharastr"
    assert romanize("हॉस्पिटैलिटी") == "hospitailiti"
    assert transliterate("हॉस्पिटैलिटी Pvt", {"hospitailiti": "hospitality"}) == "hospitality Pvt"
    assert romanize("Élan – “Œuvre” ß") == 'Elan - "OEuvre" ss'
    assert romanize("హైదరాబాద్").isascii() and romanize("१२३") == "123"
    assert transliterate("") == ""


def test_ocr_and_skeleton(spark):
    table = spark.createDataFrame([("6reen", "green"), ("3m", "3m"), ("2024", "2024"), ("plain", "plain"), ("a1b0", "albo")], "t string, w string")
    assert table.filter(repair_ocr(F.col("t")) != F.col("w")).count() == 0
    assert [r[0] for r in spark.createDataFrame([("aabbcc dd eff",), ("",)], "t string").select(skeleton(F.col("t"))).collect()] == ["bcdf", ""]


words = st.text("abc ", max_size=12)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_scores_hold_their_properties(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    for name in ("ratio", "token_sort_ratio", "token_set_ratio"):
        assert fuzzy.SCORERS[name](a, b) == pytest.approx(fuzzy.SCORERS[name](b, a))
    for name, scorer in fuzzy.SCORERS.items():
        assert 0 <= scorer(a, b) <= (1 if name == "jaro_winkler" else 100)
    if a.split():
        assert all(s(a, a) == pytest.approx(1 if n == "jaro_winkler" else 100) for n, s in fuzzy.SCORERS.items())
    short, long = sorted((a, b), key=len)
    if short and len(short) < len(long):
        n = len(short)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max(fuzzy.ratio(short, long[max(0, s) : s + n]) for s in range(1 - n, len(long))))


def test_known_scores():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("abc", "") == 0
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert fuzzy.token_sort_ratio("b a", "a b") == 100
    assert fuzzy.token_set_ratio("a b", "a b c") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.partial_token_set_ratio("new york", "york x") == 100 and fuzzy.partial_token_set_ratio("", "") == 0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fuzzy.jaro_winkler("", "") == 1 and fuzzy.jaro_winkler("a", "") == 0


def test_pair_scores_in_one_pass(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    text = lambda: " ".join(word() for _ in range(r.randrange(0, 5)))
    rows = [tuple(text() for _ in range(6)) + (" | ".join(text() for _ in range(r.randrange(1, 5))),) + (text(), text()) for _ in range(200)] + [(None,) * 9]
    table = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(9))).repartition(3)
    for row in table.select("*", fuzzy.pair_scores(*[F.col(f"c{i}") for i in range(9)]).alias("s")).collect():
        q_name, s_name, q_core, s_core, q_skel, s_skel, alias, q_addr, s_addr = (x or "" for x in row[:9])
        cat = q_core.replace(" ", ""), s_core.replace(" ", "")
        aliases = [fuzzy.token_set_ratio(x, s_core) for x in alias.split(" | ")[:3]] if "|" in alias else []
        wanted = [fuzzy.ratio(q_name, s_name), fuzzy.token_set_ratio(q_name, s_name), fuzzy.ratio(q_core, s_core), fuzzy.token_sort_ratio(q_core, s_core), fuzzy.token_set_ratio(q_core, s_core), fuzzy.partial_ratio(q_core, s_core)]
        wanted += [fuzzy.jaro_winkler(q_core, s_core), fuzzy.ratio(*cat), fuzzy.partial_ratio(*cat), fuzzy.ratio(q_skel, s_skel), max([fuzzy.token_set_ratio(q_core, s_core), *aliases])]
        wanted += [fuzzy.ratio(q_addr, s_addr), fuzzy.token_set_ratio(q_addr, s_addr), fuzzy.token_sort_ratio(q_addr, s_addr), fuzzy.partial_token_set_ratio(q_addr, s_addr)]
        assert tuple(row.s) == tuple(wanted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), max_size=5), st.lists(st.text("ab", min_size=1, max_size=3), max_size=5))
def test_token_set_ratio_by_its_definition(x, y):
    shared, ab, ba = sorted(set(x) & set(y)), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    found = fuzzy.token_set_ratio(" ".join(x), " ".join(y))
    if not x or not y:
        assert found == 0
    elif shared and not (ab and ba):
        assert found == 100
    else:
        both, one, two = " ".join(shared), " ".join(shared + ab), " ".join(shared + ba)
        each = [fuzzy.ratio(one, two)] + [fuzzy.ratio(both, t) for t in (one, two) if shared]
        assert found == pytest.approx(max(each))


def test_scorers_in_sql(spark):
    fuzzy.register(spark)
    assert spark.sql("select round(ratio('kitten', 'sitting'), 2) as r, jaro_winkler(null, '') as j").first() == (61.54, 1.0)
