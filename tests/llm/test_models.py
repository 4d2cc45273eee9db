"""Language, quality and page models: held-out accuracy, exact Viterbi, edge rows."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import crf_extract as C, preference_quality as Q, span_language as G

PARTS = {"en": "th er on an re he in ed nd ha".split(), "fr": "eau eux ou ai oi ment tion que lle vi".split(), "ru": "на ст ен ов ко ра то ли ка ре".split()}


def phrase(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(phrase(x, 40, rng), x) for x in PARTS for _ in range(40)] + [(None, "en"), ("123 !", "fr"), ("text", None)]
    return G.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_are_told_apart(languages):
    rng = random.Random(2)
    for lang in PARTS:
        for n in (3, 30, 300):
            got, score, spans = languages.predict(phrase(lang, n, rng))
            assert got == lang and score > 0.9 and all(a < b for a, b, _ in spans)


def test_mixed_text_has_spans(languages):
    rng = random.Random(3)
    a, b = phrase("en", 50, rng), phrase("fr", 20, rng)
    lang, score, spans = languages.predict(a + ". " + b)
    assert lang == "en" and [s[2] for s in spans] == ["en", "fr"]
    assert abs(spans[1][0] - len(a) - 2) < 12 and abs(score - sum(map(str.isalpha, a)) / sum(map(str.isalpha, a + b))) < 0.05


def test_scripts_narrow_the_candidates(languages):
    first, _, _, scores = languages.words("нова stone")
    assert scores[0].argmax() == languages.langs.index("ru") and scores[1].argmax() != languages.langs.index("ru")


def test_viterbi_is_exact(languages):
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.normal(0, 6, (7, len(languages.langs))).astype(np.float32)
        best = max(itertools.product(range(len(languages.langs)), repeat=7), key=lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - languages.penalty * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(languages.path(s)) == best


def test_a_long_text_scores_as_its_parts(languages, monkeypatch):
    text = phrase("fr", 3000, random.Random(5))
    whole = languages.words(text)
    monkeypatch.setattr(G, "SLICE", 1000)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole, languages.words(text)))


def test_language_edge_rows(spark, odd_docs, no_docs, languages):
    got = {(r.doc_id, r.text): r.language for r in G.identify(odd_docs, languages).collect()}
    assert got[(3, "")].lang_pred == got[(4, None)].lang_pred == got[(6, " \n\t ")].lang_pred == "und" and got[(3, "")].score == 0.0
    assert all(v.lang_pred in (*languages.langs, "und") and 0 <= v.score <= 1 for v in got.values())
    assert G.identify(no_docs, languages).count() == 0
    empty = G.learn(no_docs)
    assert empty.langs == [] and empty.predict("some words")[:2] == ("und", 0.0)
    assert [r[0] for r in spark.range(3).select(G.fold(F.col("id"), 4)).collect()] == [0xF4DBDF21 % 4, 0x83DCEFB7 % 4, 0x1AD5BE0D % 4]


def test_pairwise_strengths_order_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12000, len(Q.FEATURES)))
    y = (x[:, 0] - np.abs(x[:, 3]) + 0.1 * rng.normal(size=12000) > -0.6).astype(int)
    m = Q.fit(x[:9000], y[:9000])
    s = m.score(x[9000:])
    good, bad = s[y[9000:] == 1], s[y[9000:] == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and ((s >= 0.3) == (y[9000:] == 1)).mean() > 0.93
    again = Q.fit(x[:9000], y[:9000])
    assert np.array_equal(again.score(x[9000:]), s)


def test_one_class_or_no_label():
    x = np.zeros((3, len(Q.FEATURES)))
    assert (Q.fit(x, np.ones(3, int)).score(x) > 0.99).all() and (Q.fit(x, np.zeros(3, int)).score(x) < 0.01).all()
    assert (Q.fit(x[:0], np.zeros(0, int)).score(x) > 0.99).all()


def test_quality_edge_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (6, 0), (None, 1), (99, 1), (3, None)], "doc_id long, quality int")
    m = Q.learn(odd_docs, labels)
    got = Q.score(odd_docs, m).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert Q.score(no_docs, Q.learn(no_docs, labels)).count() == 0


def test_quality_on_the_given_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = G.fold(F.col("doc_id"), 5) == 0
    got = Q.score(docs, Q.learn(docs, labels.where(~held))).join(labels, "doc_id").where(held).select("predicted", "quality").collect()
    assert sum(a == b for a, b in got) >= 0.9 * len(got)


def sample_pages():
    rng = random.Random(1)
    out = []
    for i in range(40):
        body = "".join(f"<p>{phrase('en', rng.randint(5, 60), rng)}.</p>" for _ in range(rng.randint(1, 6)))
        menu = "".join(f'<li><a href="/{k}">{phrase("fr", 1, rng)}</a></li>' for k in range(5))
        out.append(f'<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="ad">{phrase("fr", 9, rng)}.</div><article><h1>{phrase("en", 4, rng)}</h1>{body}</article><footer>&copy; x</footer></body></html>')
    return out


@pytest.fixture(scope="module")
def page_model():
    return C.fit(C.training_pages(sample_pages()), rounds=120)


def test_main_text_of_unseen_layouts(page_model):
    rng = random.Random(9)
    right = total = 0
    for _ in range(60):
        page = C.blocks(C._page(rng, [phrase("en", rng.randint(15, 50), rng) + "." for _ in range(4)], [phrase("fr", 6, rng) for _ in range(5)]))
        for b, got in zip(page, page_model.decode(page)):
            right, total = right + (got == bool(b.label)), total + 1
    assert right / total > 0.95


def test_a_page_is_read_as_written(page_model):
    html = sample_pages()[0].replace("</article>", "<p>Fish &amp; chips&nbsp;&#233;\n <b>bold</b><br>next</p><!-- no --><style>p{}</style><p>last one here, with words</article>")
    lines = C.main_text(html, page_model).split("\n")
    assert lines[-2:] == ["Fish & chips é bold next", "last one here, with words"] and "var" not in " ".join(lines)


def test_blocks_tolerate_broken_markup():
    got = [b.text for b in C.blocks('<p>a<p>b <b>c<div>d</p></div></span>e<x y="1 > 2">f</x> < 3 <br/>g<img src=x>h<li>i<li>j<p class="un>closed')]
    assert "".join(got).replace(" ", "").startswith("ab" "cdef<3ghij")
    assert C.blocks("") == [] and C.blocks("<script>never closed") == [] and C.blocks("plain")[0].text == "plain"
    assert C.blocks("<a" * 20_000) is not None


@pytest.mark.parametrize("html, texts", [
    ("<article><p>one</p><svg><path></article><p>two</p><p>three</p>", ["one", "two", "three"]),
    ("<article><p>one</p><select><option>a<option>b</article><p>two</p>", ["one", "two"]),
    ("<head><title>lost<body><p>one</p>", ["one"]),
    ("<div><script>var a = 1;</div><p>two</p>", ["two"]),
    ("<p>a<math><mi>x</mi></math>b</p>", ["axb"]),
    ("<object><object>in</object></object><p>out</p>", ["in", "out"]),
    ("<template><template><p>n</p></template><p>x</p></template><p>y</p>", ["y"]),
    ("<ul><li>a<p>b<li>c<ul><li>d</ul><li>e</ul>", ["a", "b", "c", "d", "e"])])
def test_embedded_and_unclosed_elements_lose_no_text(html, texts):
    assert [b.text for b in C.blocks(html)] == texts


@pytest.mark.parametrize("tag", ["<div>", "<script>", "<li><p>", "<svg>"])
def test_deep_markup_is_read_in_linear_time(tag):
    def seconds(n):
        start = time.process_time()
        C.blocks(tag * n + "x")
        return time.process_time() - start
    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(8_000), 0.02)


def test_viterbi_of_blocks_is_exact(page_model):
    rng = random.Random(3)
    for _ in range(30):
        page = C.blocks(C._page(rng, [phrase("en", 12, rng)], [phrase("fr", 3, rng)]))[:9]
        e = [sum(page_model.weights.get(f, 0.0) for f in C.block_features(b)) for b in page]

        def total(p):
            s = p[0] * page_model.start + sum(x * k for x, k in zip(e, p))
            return s + sum((page_model.stay[a] if a == b else page_model.move[a]) for a, b in zip(p, p[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=total)
        assert total(tuple(map(int, page_model.decode(page)))) == pytest.approx(total(best))


def test_page_edge_rows(spark, page_model):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p></p>"), (3, "u", sample_pages()[1]), (3, "u", sample_pages()[1])], "page_id long, url string, html string")
    got = C.extract(pages, page_model).collect()
    assert [r.n_chars for r in got[:3]] == [0, 0, 0] and got[3].text == got[4].text and got[3].n_chars == len(got[3].text) > 0
    assert C.extract(pages.limit(0), C.learn(pages.limit(0))).count() == 0
