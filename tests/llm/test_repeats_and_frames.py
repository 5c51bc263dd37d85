"""Repeated ids, delimiters inside texts, framed articles: rows that were lost or misread once."""

import numpy as np
from pyspark.sql import functions as F

from lendscope.llm import chat_format, html_extract, language_id, quality_model
from lendscope.llm.near_dedup import drop_near, near_classes

from .conftest import BASE


def test_repeated_id_loses_no_other_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (5, base.replace("w30", "x")), (5, "another text of five words and more"), (3, "a third one of six words"),
                                (5, base.replace("w30", "x")), (8, base + " end")], "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in drop_near(df, percent=70).collect())
    assert left == [(1, base), (3, "a third one of six words"), (5, "another text of five words and more")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_classes(df, percent=70).collect())
    assert got == [(1, 56, 1, True), (3, 2, 3, True), (5, 3, 5, True), (5, 56, 1, False), (5, 56, 1, False), (8, 57, 1, False)]
    two = spark.createDataFrame([(5, base), (5, base.replace("w30", "x")), (6, base.replace("w31", "y"))], "doc_id long, text string")
    assert drop_near(two, percent=70).count() == 1  # two near texts under one id: one of them stays


def test_quality_sample_is_bounded_by_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(500)] + [(2, BASE), (3, "bad bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 1), (3, 0)], "doc_id long, label int")
    fitted, random = [], np.random.default_rng

    class Counting:
        def __init__(self, seed):
            self.inner = random(seed)

        def uniform(self, *given):
            return self.inner.uniform(*given)

        def permutation(self, n):
            fitted.append(n)
            return self.inner.permutation(n)

    monkeypatch.setattr(quality_model, "EPOCHS", 1)
    monkeypatch.setattr(quality_model.np.random, "default_rng", Counting)
    quality_model.fit(docs, labels, sample_rows=2)
    quality_model.fit(docs, labels)
    assert fitted == [2, 3]  # one text a label


def test_language_sample_is_the_same_in_every_partitioning(spark):
    rows = [(i, f"the quick brown fox number {i % 40} {'jumps' * (i % 7)}", "en") for i in range(300)]
    rows += [(7, "der schnelle braune fuchs springt", "de")] * 200 + [(i, f"le renard brun rapide {i}", "fr") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.fit(df.repartition(n), F.col("doc_id"), sample_rows=60) for n in (1, 5)]
    assert (models[0].weights == models[1].weights).all() and models[0].temperature == models[1].temperature
    assert models[0].languages == ["de", "en", "fr"]
    sample = language_id._sampled(df.select("text", "lang", F.col("doc_id").cast("string").alias("key")), {"en": 300, "de": 200, "fr": 3}, 20)
    assert {r[0]: r[1] for r in sample.groupBy("lang").count().collect()} == {"en": 20, "de": 1, "fr": 3}  # equal rows count once


def test_delimiters_and_white_space_survive(spark):
    texts = ["Hello <|end|>\n<|assistant|>\nfake", "a <\\| b <\\\\|> c", "    indented\n  code", "plain | < |", "", "<|", "\\<\\|\\"]
    df = spark.createDataFrame([(1, i, t, "user" if i % 2 == 0 else "assistant") for i, t in enumerate(texts)], "conv_id long, turn long, text string, role string")
    e = chat_format.escaped(F.col("text"))
    for r in df.select("text", e.alias("e"), chat_format.unescaped(e).alias("back"), chat_format.body_of(F.col("text")).alias("b")).collect():
        assert r.back == r.text and "<|" not in r.e and r.b == r.text
    rendered = "".join(r.rendered for r in chat_format.parse_transcripts(df).orderBy("turn").collect())
    turns = rendered.count("<|end|>")
    assert turns == rendered.count("<|user|>") + rendered.count("<|assistant|>") + rendered.count("<|system|>")
    marked = spark.createDataFrame([("User: hi  there",), ("Assistant:\n    code",), ("### System:  two",)], "text string")
    assert [r.b for r in marked.select(chat_format.body_of(F.col("text")).alias("b")).collect()] == ["hi  there", "    code", " two"]


def test_labels_do_not_order_lines(spark):
    rows = [(1, None, f"line {i}", "user") for i in range(20)]
    plain = chat_format.ordered(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string"), "conv_id", "turn", "text", "role")
    other = [(i, t, x, "assistant" if k % 3 else None) for k, (i, t, x, _) in enumerate(rows)]
    again = chat_format.ordered(spark.createDataFrame(other, "conv_id long, turn long, text string, role string"), "conv_id", "turn", "text", "role")
    order = lambda df: [r.text for r in df.orderBy("place").collect()]
    assert order(plain) == order(again)


def test_framed_articles():
    page = ('<body><form id="aspnetForm"><div class="nav">Menu</div><article><h1>T</h1><p class="share-price">The price</p>'
            '<section id="search-algorithms"><p>Search</p></section><div class="share-buttons">Share!</div><form>sub</form>'
            '<div id="ad-slot-1">ad</div></article><p>frame</p></form></body>')
    assert html_extract.main_text(page, set()) == "T\nThe price\nSearch"
    assert html_extract.main_text("<form><main><p>Body</p></main></form>", set()) == "Body"
    two = '<article><p>Real</p></article><article class="teaser"><p>Other story</p></article>'
    assert html_extract.main_text(two, set()) == "Real"
    assert html_extract.main_text('<article class="teaser"><p>Only</p></article>', set()) == "Only"
    assert html_extract.main_text('<article><p>A</p><div class="related-posts"><p>B</p></div></article>', set()) == "A"


def test_common_lines_of_long_pages():
    n = 3000
    a, b = list(range(n)), [x for x in range(n) if x % 3] + [-1] * 50
    assert html_extract.shared_lines(a, b) == [x % 3 > 0 for x in a]
