"""License scan, phrase collocations and filter audit: plain versions, hostile rows, empty tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lendscope.llm import collocation as CO
from lendscope.llm import filter_audit as FA
from lendscope.llm import license_scan as LS
from lendscope.llm.queries import QUERIES

from .conftest import HOSTILE, SF001

# ------------------------------------------------------------------ license scan


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, df, n):
    """Every template tried at every offset, no index: the rule that the index must keep."""
    words = plain_words(text)
    places = [(i, label) for phrase, label in LS.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for label, notice, phrases in LS.TEMPLATES:
        wanted = plain_words(notice)
        rarest = sorted(set(wanted), key=lambda w: (-math.log((n + 1) / (df[w] + 1)), w.encode()))
        anchors = [w for w in rarest if w in words][:LS.ANCHORS]
        if len(anchors) < min(2, len(rarest)):
            continue
        for offset in range(-len(wanted), len(words)):
            near = all(any(words[at] == w and abs(at - place - offset) <= 2 * LS.SLACK for at in range(len(words)))
                       for w in anchors for place in [next(i for i, x in enumerate(wanted) if x == w)])
            stands = lambda phrase: any(
                words[i:i + len(phrase)] == phrase and abs(i - offset - next(j for j in range(len(wanted)) if wanted[j:j + len(phrase)] == phrase)) <= LS.SLACK
                for i in range(len(words)))
            if near and all(stands(plain_words(p)) for p in phrases):
                labels.add(label)
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(labels))


NOTICES = [
    (1, "Foo. Licensed under the Apache License, Version 2.0."), (2, "x LICENSED UNDER CC-BY NC 4.0!"), (3, None), (4, ""), (4, ""),
    (5, "the mit of license and the apache of version 2.0 license"), (6, "All rights reserved. All  Rights\nreserved"),
    (7, "under the terms of the GNU Lesser General Public License as published"), (8, "cc by"), (None, "Released under the MIT License"),
    (9, "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    (10, "Licensed under the new Apache License, the Version 2.0"), (11, "mit " * 150 + "license"), (12, "é MIT licensé"),
    (13, "Licensed under the GNU General Public License, version 3 and under CC BY-SA 4.0, all rights reserved"),
]


def scanned(df):
    return LS.scan(df, LS.fit(df))


def test_license_scan_equals_all_offsets(spark):
    df = spark.createDataFrame(NOTICES, "doc_id long, text string").withColumn("licences", F.lit("v")).withColumn("n_words", F.lit(1))
    df_of = Counter(w for _, t in NOTICES for w in set(plain_words(t)))
    got = scanned(df).collect()
    assert scanned(df).columns == ["doc_id", "text", "n_words", "licences"]
    assert len(got) == len(NOTICES)
    for r in got:
        x = r.licences
        assert (x.n_words, x.n_base, x.first_word, x.last_word, ",".join(x["labels"])) == plain_scan(r.text, df_of, len(NOTICES)), r.text[:60] if r.text else r
        assert set(x.base_labels) <= set(x["labels"]) and 0 <= x.score <= 1 and (x.score > 0) == bool(x["labels"])
    by = {r.doc_id: r.licences["labels"] for r in got}
    assert by[1] == ["apache-2.0"] and by[2] == ["cc-by", "cc-by-nc"] and by[5] == [] and by[7] == ["gpl", "lgpl"] and by[None] == ["mit"]
    assert by[13] == ["cc-by", "cc-by-sa", "gpl", "gpl-3.0", "reserved"] and by[9] == ["bsd"] and by[12] == []


def test_license_scan_hostile_and_empty(hostile, empty):
    got = scanned(hostile)
    assert got.columns == [*hostile.columns, "licences"]
    assert Counter((r.doc_id, r.licences.n_words) for r in got.collect()) == Counter((i, len(plain_words(t))) for i, t, *_ in HOSTILE)
    assert scanned(empty).count() == 0
    with pytest.raises(ValueError, match="key phrase"):
        LS.template("x", "some notice", ["other words"])


def test_license_query_base_equals_sql(spark):
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    want = duckdb.sql(f"""
        with d as (select doc_id, {words} ws from '{SF001}/documents.parquet'),
        p as (select doc_id, i - 1 i, case when ws[i:i + 1] = ['cc', 'by'] then 'cc-by' when ws[i:i + 2] = ['general', 'public', 'license'] then 'gpl'
                     when ws[i:i + 2] = ['all', 'rights', 'reserved'] then 'reserved' end l from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from d)),
        g as (select doc_id, count(*) n, min(i) f, max(i) e, string_agg(distinct l, ',' order by l) b from p where l is not null group by 1)
        select d.doc_id, len(ws), coalesce(n, 0), f, e, coalesce(b, '') from d left join g using (doc_id)""").fetchall()
    got = QUERIES["op11_license_scan"](spark, SF001).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


# ------------------------------------------------------------------ collocations


def plain_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((CO.SCALE * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(df, least=2, top=2000):
    return sorted(tuple(r) for r in CO.collocations(df, least, top).collect())


ODD = [
    ("en", "the big red fox. the big red fox ran, the big red fox ran away! a big red fox"), ("en", "The Big\tRed  fox ran away"),
    ("en", "a\x01 b c\x00 d. a\x01 b c\x00 d a b\x02 c a b\x02 c. a a\x01 a a\x01"), (None, "la la la la la la la la"), ("und", "la la la. buy now buy now buy now"),
    ("fr", "é à É à é à. É à"), ("fr", None), ("de", ""), ("de", " .,;\t\n"), ("x" * 40, "one two one two one two"),
    ("en", " ".join(f"p{i}" for i in range(30))), ("en", " ".join(f"p{i}" for i in range(30))), ("en", "q p5 p6 p7 p8 z. q p5 p6 p7 p8 y"),
]


@pytest.mark.parametrize("hot", [False, True])
def test_collocations_equal_plain_counts(spark, monkeypatch, hot):
    if hot:  # every slot is dealt by whole grams, in small chunks
        monkeypatch.setattr(CO, "SLOTS", 1)
        monkeypatch.setattr(CO, "hot_slots", lambda docs: [0])
        monkeypatch.setattr(CO, "CHUNK_GRAMS", 7)
        monkeypatch.setattr(CO, "CHUNK_BYTES", 40)
    df = spark.createDataFrame([(*r, "v") for r in ODD], "lang string, text string, phrase string").repartition(3)
    for least, top in ((2, 2000),) if hot else ((2, 2000), (3, 4)):
        assert found(df, least, top) == plain_collocations(ODD, least, top)


def test_collocations_of_flows_in_small_batches(spark):
    df = spark.createDataFrame(ODD, "lang string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(df) == plain_collocations(ODD, 2, 2000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_collocations_hostile_and_empty(hostile, empty):
    # from three on: the two long texts share 30,000 words, too many candidates for the plain version
    assert found(hostile, 3) == plain_collocations([(r[2], r[1]) for r in HOSTILE], 3, 2000) != []
    assert found(empty) == []


def test_unary_paths_are_compacted(spark, monkeypatch):
    """Paths list every edge once, run through nodes with one edge in and out only, and are cut into segments."""
    monkeypatch.setattr(CO, "SEGMENT", 8)
    df = spark.createDataFrame(ODD, "lang string, text string")
    counts = CO.phrase_counts(df, 2).where(F.col("n_words") == CO.LONGEST)
    edges = {(r.lang, r.phrase): r.f for r in counts.collect()}
    rows = CO.unary_paths(counts).orderBy("lang", "path", "segment").collect()
    listed = {}
    for r in rows:
        assert len(r.words) == len(r.weights) + CO.LONGEST - 1 and len(r.weights) <= 8
        for i, f in enumerate(r.weights):
            listed[r.lang, " ".join(r.words[i:i + CO.LONGEST])] = f
    assert listed == edges and sum(len(r.weights) for r in rows) == len(edges)
    into, outof = Counter(), Counter()
    for lang, p in edges:
        into[lang, " ".join(p.split(" ")[1:])] += 1
        outof[lang, " ".join(p.split(" ")[:-1])] += 1
    for r in rows:
        for i in range(1, len(r.weights)):
            node = r.lang, " ".join(r.words[i:i + CO.LONGEST - 1])
            assert into[node] == outof[node] == 1
    assert any(r.segment > 0 for r in rows)  # the passage of 30 words


# ------------------------------------------------------------------ filter audit


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    lowest = {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in lowest and i > lowest[t]}
        parts[source or ""].append(({x for x in fails if fails[x]}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, rows in parts.items():
        steps, shapley = {}, Counter()
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                earlier = set(order[:k])
                gone = [r for r in rows if x in r[0] and not r[0] & earlier]
                shapley[x] += len(gone)
                steps["".join(order), k + 1] = (
                    sum(not r[0] & (earlier | {x}) for r in rows), len(gone), sum(x in r[0] and bool(r[0] & earlier) for r in rows),
                    sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
        out += [(part, order, k, *v, shapley[order[k - 1]]) for (order, k), v in steps.items()]
    return sorted(out)


def test_audit_equals_every_order(spark, hostile, empty):
    labels = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, 0), (9, 1, 1), (None, 1, 1), (99, 1, 1), (12, None, 1)]
    marks = spark.createDataFrame([(*r, "v") for r in labels], "doc_id long, quality int, toxic int, part string")
    before = spark.conf.get(FA.ROW_LIMIT)
    got = FA.audit(hostile, marks)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit([(i, t, s) for i, t, _, s in HOSTILE], labels)
    assert spark.conf.get(FA.ROW_LIMIT) == before
    assert FA.audit(empty, marks).count() == 0
    assert FA.audit(hostile, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_walk_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {r.prefix: (r.kept, r.removed, r.redundant) for r in FA.order_walk(cells, "XY").collect()}
    assert rows == {"X": (2, 5, 0), "Y": (2, 5, 0), "XY": (2, 0, 5), "YX": (2, 0, 5)}
