"""Quality ledger, mixing and pseudonyms against plain Python."""

import re
from collections import Counter

import pytest

from winnow.llm import mixing, pseudonyms, quality_rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def base_of(text):
    text, words = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def odd_texts(spark):
    texts = ["a b a b a b a b", "x y z x y z q x y z", "#### $$ | <b>", "q\nq\nq\n \n\n", "SHOUT LOUD " * 40, "w " * 60, " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)), "a" * 5000]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_ledger_measures_like_python(documents, odd_texts):
    for docs in (documents, odd_texts):
        given = sorted((r.doc_id is None, r.doc_id or 0, base_of(r.text)) for r in docs.collect())
        found = sorted((r.doc_id is None, r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality_rules.ledger(docs).collect())
        assert found == given


def test_base_rules_and_policies(odd_texts):
    rows = quality_rules.ledger(odd_texts).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert [r.doc_id for r in rows if r.kept] == [6]
    assert {r.doc_id for r in quality_rules.ledger(odd_texts, 1).collect() if r.kept} == {6}


def test_ablations_count_what_each_rule_removes(odd_texts):
    ledger = quality_rules.ledger(odd_texts).collect()
    for row in quality_rules.ablations(quality_rules.ledger(odd_texts)).collect():
        bit, every = 1 << quality_rules.RULES[row.rule], (1 << len(quality_rules.RULES)) - 1
        assert row.failed == sum(bool(r.fail_bits & bit) for r in ledger)
        assert row.only == sum(r.fail_bits == bit for r in ledger)
        assert row.kept_without == sum(not r.fail_bits & (every - bit) for r in ledger)


def test_empty_tables(nothing):
    assert quality_rules.ledger(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert pseudonyms.pseudonymise(nothing).count() == 0


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * weight[s] / weights > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else left * weight[s] / weights for s in sizes}
        full |= over


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i * i % 40), f"s{min(i % 17, 4)}") for i in range(400)] + [(1000, "only two", None), (1001, None, "s9"), (1002, "tiny", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets_by_hand(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source, words in taken.items():
        assert abs(words - want[source]) < 1.0001
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)


def test_complete_epochs_come_before_a_part(spark):
    rows = [(i, "w " * 5, "a") for i in range(20)] + [(100 + i, "w " * 5, "b") for i in range(20)] + [(200 + i, "w " * 5, "c") for i in range(60)]
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        whole = int(r.target // r.source_size) * r.size
        assert whole <= r.taken <= whole + r.size


def test_better_documents_come_earlier(spark):
    rows = [(i, "good plain words only here" if i % 2 else "1 2 3 4 !!", "a") for i in range(600)] + [(5000 + i, "x " * 9, "b") for i in range(800)]
    found = [r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4)).collect() if r.source == "a"]
    share = {odd: sum(r.taken for r in found if r.doc_id % 2 == odd) / sum(r.size for r in found if r.doc_id % 2 == odd) for odd in (0, 1)}
    assert share[1] > 2 * share[0]


def test_mix_takes_odd_rows(documents):
    assert mixing.mix_sources(documents).count() == documents.count()


def luhn(digits):
    return sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    import datetime

    card, wrong, day = "4539578763621486", "4539578763621487", "2024-02-29"
    rows = [(1, f"pay {card} or {wrong}, (017) 555-7713 on {day}, 2023-02-30; me.too9@mail.example.com 97.51.17.173 300.1.1.1"), (2, f"{card}\n{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"), (3, None), (4, "no value 12345 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pseudonyms.pseudonymise(docs).collect()}
    text = found[1].text
    new = re.match(r"pay (\d{16}) or (\d{16}), (\(\d{3}\) \d{3}-\d{4}) on (\d{4}-\d\d-\d\d), 2023-02-30; ([a-z]{2}\.[a-z]{3}\d)@mail\.example\.com (\d+\.\d+\.\d+\.\d+) 300\.1\.1\.1$", text)
    assert new and new[1] != card and luhn(new[1]) and new[2] == wrong
    assert new[3] != "(017) 555-7713" and new[4] != day and datetime.date.fromisoformat(new[4])
    assert all(int(p) < 256 for p in new[6].split(".")) and new[6] != "97.51.17.173"
    assert found[2].text.split("\n")[0] == new[1] and found[2].text.split("\n")[1].replace(" ", "") == new[1]
    assert found[3].text is None and found[4].text == rows[3][1] and found[4].n_card == 0
    assert (found[1].n_card, found[1].n_phone, found[1].n_date, found[1].n_email, found[1].n_address) == (1, 1, 1, 1, 1)
    assert pseudonyms.pseudonymise(docs, "other").where("doc_id = 1").first().text != text


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    days = spark.range(pseudonyms.DAY_FACTORS[0] * pseudonyms.DAY_FACTORS[1])
    out = days.select(pseudonyms.permute_number(F.col("id"), pseudonyms.DAY_FACTORS, "k").alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(out) == (146097, 0, 146096)
    texts = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("t"))
    out = texts.select(pseudonyms.permute_text(F.col("t"), "k").alias("x")).agg(F.countDistinct("x"), F.max(F.length("x"))).first()
    assert tuple(out) == (20_000, 5)


def test_pseudonyms_take_odd_rows(documents):
    rows = pseudonyms.pseudonymise(documents.withColumnRenamed("size", "n_card"))
    assert rows.count() == documents.count() and rows.columns.count("n_card") == 1
    assert rows.where("text is null").count() == 1
