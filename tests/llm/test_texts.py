"""Toxicity, page texts, edit-aware counts, secret scan and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from winnow.llm import edit_counts, secret_scan, toxicity, wrapper_induction

SCHEMA = "doc_id long, text string"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose in which the toxic texts hold a few words of their own; one junk text repeats a word hundreds of times."""
    rng = random.Random(3)
    rude = ["blorg", "snark", "grutz", "vexil"]
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(40, 200))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(len(words) // 25 + 2):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows.append((5000, "w1 " * 700))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_are_told_apart(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    found = toxicity.score_texts(docs, model).join(labels, "doc_id").collect()
    assert {r.doc_id for r in found if r.held_out} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - toxicity.score_texts(docs, model).where("predicted = 1").count()


def test_held_out_labels_are_never_read(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one, two = (toxicity.score_texts(docs, toxicity.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_ratio_is_kneser_ney(spark):
    """The ratio of a telling word by hand: discounted contexts of its class over shared contexts."""
    texts = [(1, f"c{i} bad c{i + 1}") for i in range(60)] + [(0, f"d{i} fine d{i + 1}") for i in range(60)]
    counts = toxicity.bigram_counts(spark.createDataFrame(texts, "toxic int, text string"))
    found = {r.key: r.ratio for r in toxicity.expression_ratios(counts, least=5).collect()}
    import math

    from winnow.llm.words import PlainWords

    bad = PlainWords()[b"bad"] >> 33
    types_t, all_t, every = 62, 60 + 60 + 60, 2 * 180
    assert counts.where(F.col("toxic") > 0).count() == all_t
    shared = (60 - 0.75) / every
    p_t = (60 - 0.75) / all_t + 0.75 * types_t / all_t * shared
    p_o = 0.75 * 62 / 180 * shared
    assert found[bad] == pytest.approx(math.log(p_t / p_o), rel=1e-6)


def test_expressions_beyond_the_broadcast_count_too(labelled):
    docs, labels = labelled
    whole, split = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most=3)
    assert len(split.keys) <= 3 < len(whole.keys) and split.rest.count() == len(whole.keys) - len(split.keys)
    one, two = ({r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()} for model in (whole, split))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-6
    assert sorted(map(tuple, toxicity.without_toxic(docs, whole).collect())) == sorted(map(tuple, toxicity.without_toxic(docs, split).collect()))


def test_toxicity_takes_odd_rows(documents, nothing, spark, labelled):
    model = toxicity.fit(*labelled)
    assert toxicity.score_texts(documents, model).count() == documents.count()
    assert toxicity.without_toxic(documents, model).columns == documents.columns
    none = toxicity.fit(documents, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_texts(documents, none).collect()} == {0}
    assert toxicity.score_texts(nothing, none).count() == 0


def page(i, body, nav="Home About", note="We use cookies."):
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><header><a href=/>Site</a></header>"
        f"<div class='top-menu'>{nav}</div><div id=cookie-notice>{note}</div>{body}<aside>Other news</aside><form><input><label>Mail</label></form><footer>&copy; Site</footer></body></html>"
    )


def test_article_without_what_surrounds_it(spark):
    body = "<article><header><h1>Title &amp; more {0}</h1></header><p>First   part\n of <b>text {0}</b>.<p>Second&nbsp;part<br>goes on {0}.<div class=ad>Buy</div><ul><li>one {0}<li>two</ul><section id=comments><p>I like it</p></section></article>"
    rows = [(i, f"http://a.example/{i}", page(i, body.format(i))) for i in range(6)]
    found = {r.page_id: r for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert found[i].text == f"Title & more {i}\nFirst part of text {i}.\nSecond part goes on {i}.\none {i}\ntwo"
        assert found[i].n_chars == len(found[i].text) and found[i].url == rows[i][1]


def test_slots_are_induced_without_article_elements(spark):
    """Plain divs only: what all pages of the host share is template, the varying slot is the content."""
    rng = random.Random(5)

    def prose():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))

    rows, want = [], {}
    for i in range(8):
        parts = [prose() for _ in range(2 + i % 3)]
        rows.append((i, f"http://b.example/{i}", "<div><div>Welcome to our site, the place for all things</div><div>" + "".join(f"<p>{x}</p>" for x in parts) + "</div><div>Imprint of our site and all the small print</div></div>"))
        want[i] = "\n".join(parts)
    found = {r.page_id: r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(i, "http://c.example/x", page(0, "<article><p>The same text on every page of the host.</p></article>")) for i in range(5)]
    assert {r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same text on every page of the host."}


def test_tree_matching_counts_nodes():
    a, b = wrapper_induction.parse("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>"), wrapper_induction.parse("<div><p>x</p><p>z</p></div>")
    score, pairs = wrapper_induction.align(a, b)
    assert score == len(pairs) == 4
    assert [(x.own_text(), y.own_text()) for x, y in pairs if x.tag == "p"] in ([("x", "x"), ("y", "z")], [("y", "z"), ("x", "x")])


def test_boilerplate_inside_the_article_is_template(spark):
    """Boxes without a telling class inside the article, one of them on the pages of a rarer type only."""
    rng = random.Random(6)

    def prose():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))

    rows, want = [], {}
    for i in range(60):
        parts, rare = [prose() for _ in range(2 + i % 3)], i % 5 == 0
        body = [f"<p>{x} <a href=/>see here</a></p>" for x in parts]
        body.insert(i % 2 + 1, "<div>Our letter brings you all the <b>best</b> stories every week</div>")
        if rare:
            body = ["<div class=kit>All recipes of this kitchen may be copied for use at home</div>", *body]
        rows.append((i, f"http://d.example/{i}", "<article>" + "".join(body) + "<p>Text under a free licence, see the terms</p></article>"))
        want[i] = "\n".join(f"{x} see here" for x in parts)
    found = {r.page_id: r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want


def best_matching(a, b):
    """Matched nodes by plain recursion."""
    if a.tag != b.tag:
        return 0

    def chain(x, y):
        return max(chain(x[1:], y), chain(x, y[1:]), best_matching(x[0], y[0]) + chain(x[1:], y[1:])) if x and y else 0

    return 1 + chain(a.elements(), b.elements())


def test_tree_matching_is_the_largest(monkeypatch):
    rng = random.Random(7)

    def tree(depth):
        return "".join(f"<{t}>{rng.choice('xyz')}{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "b", "section"], k=rng.randrange(5))) if depth else ""

    for cells in (1_000_000, 2):
        monkeypatch.setattr(wrapper_induction, "CELLS", cells)
        for _ in range(60):
            a, b = wrapper_induction.parse(tree(2)), wrapper_induction.parse(tree(2))
            score, pairs = wrapper_induction.align(a, b)
            assert score == len(pairs) == best_matching(a, b)


def test_an_extra_child_or_a_long_list_moves_nothing():
    for extra, n in (("<div>new</div>", 1), ("", 900)):
        a = wrapper_induction.parse(f"<div>{extra}<div><p>one</p><p>two</p></div>" + "".join(f"<div><i>a{i}</i></div><p>p{i}</p>" for i in range(n)) + "<div>Imprint</div></div>")
        b = wrapper_induction.parse("<div><div><p>other</p></div>" + "".join(f"<p>q{i}</p><div><b>b{i}</b></div>" for i in range(n // 2)) + "<div>Imprint</div></div>")
        assert ("Imprint", "Imprint") in [(x.own_text(), y.own_text()) for x, y in wrapper_induction.align(a, b)[1]]


def test_pages_take_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>a</p>"), (None, "http://h/x", "just text &lt;&#65;"), (4, "http://h/y", "<<<a <p <b>>"), (4, "http://h/y", "<<<a <p <b>>"), (5, "http://h/z", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = wrapper_induction.extract(pages).collect()
    assert len(found) == 7 and {r.text for r in found if r.page_id in (1, 2)} == {""}
    assert {r.text for r in found if r.page_id is None} == {"just text <A"} and {r.text for r in found if r.page_id == 5} == {"deep"}
    assert wrapper_induction.extract(pages.where("1 = 0")).count() == 0


def test_updated_counts_equal_full_counts():
    counter = edit_counts.Counter(edit_counts.read_ranks(VOCABULARY))
    rng = random.Random(8)
    pieces = ["word", " other", "  ", "\n\n", "42", "'s", " été", "\U0001f600", ".", " x", "\t", "!!", "don't"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 30, 400, 3000])))
        tree = edit_counts.build(text, counter)
        assert tree.total == len(counter.encoding.encode_ordinary(text))
        for _ in range(3):
            at = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(5)))
            edits = [(a, b if b - a < 90 else a, rng.choice(["", " ", "x", "\n \n", "7 seven"])) for a, b in zip(at[::2], at[1::2], strict=True)]
            tree, text, _ = edit_counts.update(tree, text, edits, counter)
            assert tree.total == len(counter.encoding.encode_ordinary(text)) == sum(tree.counts)
            assert tree.levels == edit_counts._sums(tree.counts)


def test_one_edit_reads_a_small_region():
    counter = edit_counts.Counter(edit_counts.read_ranks(VOCABULARY))
    text = " ".join(f"word{i}" for i in range(20_000))
    _, _, read = edit_counts.update(edit_counts.build(text, counter), text, [(70_000, 70_003, "new")], counter)
    assert 0 < read < 3000


def test_stored_trees_are_updated(documents, nothing):
    trees = edit_counts.token_trees(documents, VOCABULARY)
    stored = documents.join(trees.dropDuplicates(["doc_id"]), "doc_id")
    found = {r.doc_id: r for r in edit_counts.recount(stored, vocabulary=VOCABULARY).collect()}
    counter = edit_counts.Counter(edit_counts.read_ranks(VOCABULARY))
    for row in documents.where("doc_id is not null").collect():
        text = row.text or ""
        after = edit_counts.apply_edits(text, edit_counts.cleaning_edits(text))
        assert found[row.doc_id].n_tokens == len(counter.encoding.encode_ordinary(text))
        assert found[row.doc_id].n_tokens_after == len(counter.encoding.encode_ordinary(after))
    assert edit_counts.token_trees(nothing, VOCABULARY).count() == 0


def spans_by_hand(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_of_fixed_form_and_by_models(spark, documents):
    rng = random.Random(11)

    def secret(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = ["".join(rng.choice(["con", "fig", "ura", "tion", "under", "stand", "ing", "respon", "sible"]) for _ in range(4)) for _ in range(200)]
    plain += ["configuration", "understanding", "get_user_profile_by_identifier2024v2", "internationalisation", "document-section-heading-12-a", "responsibility", "characterization"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(plain) for _ in range(30)) + " é\U0001f600 "
        text += rng.choice(['Token = "%s"' % secret(letters, 24), "api_key:short", "AKIA" + secret("ABCDEFGHIJ0123456789", 16), "x" + secret("0123456789abcdef", 40), "PASSWORD='%s'" % secret(letters, 9), "secret=secret: abcdefgh1"])
        rows.append((i, text))
    loose = secret(letters, 44)
    rows += [(900, f"see {loose} here"), (901, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    for i, text in rows:
        base = spans_by_hand(text or "")
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in found[i].spans.split(",") if not s.startswith("markov")) == base
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))
    assert found[900].spans == f"markov:4:{4 + len(loose)}"
    assert sum(r.n_markov for i, r in found.items() if i < 300) == 0
    assert secret_scan.scan(documents, secret_scan.fit(documents)).count() == documents.count()


def test_short_letters_only_and_digitless_strings_are_scored(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = ["".join(rng.choice(["con", "fig", "ura", "tion", "under", "stand", "ing", "respon", "sible"]) for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + " token=" + "".join(rng.choice(letters + "0123456789") for _ in range(100))) for i in range(400)]
    loose = ["qX7vRk2Zp9Wd", "kQzXvJwRtBpLmHgYcDnF", "Zq8" + "XwKvJpQzRbTgHyNcMdLf"]
    rows += [(900 + i, f"see {x} here") for i, x in enumerate(loose)] + [(950, "see configuration understanding responsible here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert max(len(x) for x in secret_scan.samples(docs)[0]) == 100
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    assert [found[900 + i] for i in range(3)] == [f"markov:4:{4 + len(x)}" for x in loose]
    assert found[950] == "" and not any("markov" in found[i] for i in range(400))


def test_random_strings_of_every_alphabet_are_found():
    rng = random.Random(31)
    words = ["".join(rng.choice(["con", "fig", "ura", "tion", "under", "stand", "ing", "respon", "sible"]) for _ in range(4)) for _ in range(500)]
    models = secret_scan.Models([], words, drawn=secret_scan.drawn_strings())
    for letters in secret_scan.ALPHABETS.values():
        for length in (20, 32, 40):
            strings = ["".join(rng.choices(letters, k=length)) for _ in range(200)]
            assert sum(models.ratio(x) > models.threshold for x in strings) >= 190
    usual = words + [w.upper() for w in words] + secret_scan.drawn_numbers(500, seed=32) + secret_scan.joined_words(words, seed=33)
    assert sum(models.ratio(x) > models.threshold for x in usual) <= len(usual) // 200


def test_added_spans_equal_a_walk_over_characters():
    rng = random.Random(34)
    words = ["".join(rng.choice(["con", "fig", "ura", "tion", "under"]) for _ in range(3)) for _ in range(300)]
    models = secret_scan.Models(["0f" * 20], words, drawn=secret_scan.drawn_strings(200))
    place = {c: i for i, c in enumerate(secret_scan._ALPHABET)}

    def by_hand(token):
        codes, n = [place[c] for c in token], len(place)
        sums = models.logs[0][codes[0]] + models.logs[1][codes[0], codes[1]]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            sums = sums + models.logs[2][a * n + b, c]
        return max(sums[: models.n_random]) - max(sums[models.n_random :])

    for _ in range(50):
        parts = [rng.choice(words) if rng.random() < 0.7 else "".join(rng.choices("abcDEF0123456789+/", k=rng.randint(1, 30))) for _ in range(20)]
        text = rng.choice([" ", " \U0001f600 ", ";"]).join(parts)
        base = secret_scan.base_spans(text)
        tokens = [(m.start(), m.end()) for m in secret_scan.TOKEN.finditer(text)]
        want = [(3, a, b) for a, b in tokens if by_hand(text[a:b]) > models.threshold and not any(a < e and s < b for _, s, e in base)]
        assert models.spans(text, base) == want


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)

    def prose(n):
        return " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))

    item, passage = prose(30), prose(60)
    rows = [(i, "\n".join(prose(25) for _ in range(4)), "en", f"s{i % 3}", 1) for i in range(200)]
    near = rows[5][1].split()
    near[40] = "other"
    rows += [(300, " ".join(near), "en", "s1", 1), (301, rows[6][1], "en", "s1", 1), (302, prose(50) + "\n" + passage, "en", "s2", 1), (303, passage + "\n" + prose(40), "en", "s2", 1), (304, prose(20) + " " + item, "en", "s0", 1), (305, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns and [k for _, k in out.dtypes] == [k for _, k in docs.dtypes]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert len(seen["toxicity"]) == 206
    assert 301 not in seen["line_dedup"] and 5 in seen["line_dedup"] and passage in seen["line_dedup"][302].text and passage not in seen["line_dedup"][303].text
    assert 300 in seen["line_dedup"] and 300 not in seen["jaccard_join"] and 5 in seen["jaccard_join"]
    assert 304 in seen["jaccard_join"] and 304 not in seen["decontamination"]
    assert set(range(200)) <= set(seen["mixing"]) and seen["mixing"][305].taken == 0
    assert sum(r.taken for r in seen["mixing"].values()) <= sum(r.size for r in seen["mixing"].values())
