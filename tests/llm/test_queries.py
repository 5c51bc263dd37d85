"""Registered queries against DuckDB where SQL expresses them, and against plain versions elsewhere."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lendscope.llm import language_id, piece_codec, quality_model
from lendscope.llm.queries import QUERIES, SQL
from oracle_compare import compare, duck_for

from .conftest import SF001, SF01


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def near_components(docs, percent):
    """Components of (id, text) rows by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    holders = defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("key", sorted(SQL))
@pytest.mark.parametrize("sf", [SF001, SF01])
def test_sql(spark, key, sf):
    ok, message = compare(spark, duck_for(sf), key, sf, QUERIES[key], SQL[key])
    assert ok, message


def test_near_dedup_equals_all_pairs(spark):
    want = near_components(duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall(), 85)
    got = QUERIES["op2_near_dedup"](spark, SF01).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_sharding_law(spark):
    rows = QUERIES["op7_sharding"](spark, SF01).collect()
    want = {r[0]: r[1:] for r in duckdb.sql(
        f"select doc_id, strlen(text) + 1, text from '{SF01}/documents.parquet'").fetchall()}
    of_text, slots, sizes = {}, defaultdict(list), Counter()
    for r in rows:
        size, text = want.pop(r.doc_id)
        assert r["size"] == size and of_text.setdefault(text, r.shard) == r.shard and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += size
    assert not want
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + 40_000


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, count = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert count > 250 and right >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_quality_held_out_accuracy(spark):
    got = QUERIES["op8_quality_model"](spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_codec_equals_library_without_dropout_and_is_lossless_with(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.VOCABULARY)
    pieces = piece_codec.load()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    plain = piece_codec.encode(docs, pieces, F.col("doc_id"), dropout=0.0).collect()
    assert all(list(r.ids) == library.encode(r.text) for r in plain)
    one = QUERIES["op3_piece_codec"](spark, SF001).collect()
    assert len(one) == len(plain) and all(r.lossless and r.n_pieces == len(r.ids) for r in one)
    assert [list(r.ids) for r in one] != [list(r.ids) for r in plain]
    assert sorted(map(str, one)) == sorted(map(str, QUERIES["op3_piece_codec"](spark, SF001).collect()))
    other = piece_codec.encode(docs, pieces, F.col("doc_id"), seed=2).collect()
    assert [list(r.ids) for r in other] != [list(r.ids) for r in one]


def test_pages_equal_their_articles(spark):
    import html as H

    got = {r.page_id: r for r in QUERIES["op5_html_extract"](spark, SF01).collect()}
    pages = duckdb.sql(f"select page_id, html from '{SF01}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page, source in pages:
        article = re.search(r"<article>(.*)</article>", source, re.S)[1].replace("<br>", " ")
        lines = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)\b[^>]*>", article)]
        assert got[page].text == "\n".join(x for x in lines if x)
        assert got[page].n_chars == len(got[page].text)


def test_roles_recovered(spark):
    got = QUERIES["op10_chat_format"](spark, SF01)
    assert got.count() == spark.read.parquet(f"{SF01}/conversations.parquet").count()
    assert got.agg(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).first()[0] > 0.95


def test_models_without_rows(spark, empty, hostile):
    model = language_id.fit(empty, F.col("doc_id"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(hostile, model).collect()} == {("und", 0.0)}
    judge = quality_model.fit(hostile, empty.withColumn("label", F.lit(1)))
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality_model.score(hostile, judge).collect())
