"""Hostile rows (NULLs, empty and very long texts, copies, repeated rows, clashing columns) and empty tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import chat_format, html_extract, language_id, near_dedup, piece_codec, quality_model, sharding
from lendscope.llm.exact_dedup import drop_exact, exact_dedup
from lendscope.llm.mixing import mix, mixed_rows, source_targets
from lendscope.llm.near_dedup import drop_near, near_classes
from lendscope.llm.quality_rules import keep_good, quality_rules

from .conftest import BASE, HOSTILE, LONG


def test_quality_rules(hostile, empty):
    got = quality_rules(hostile).collect()
    assert len(got) == len(HOSTILE)
    for r in got:
        words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in r.text or "").split(" ") if w]
        seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        twice = {i + d for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for d in range(5)}
        assert (r.quality.n_words, r.quality.n_repeat_words) == (len(words), len(twice))
        assert r.quality.base_failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words))
        assert not (r.quality.kept and r.quality.base_failed)
    assert any(r.quality.kept for r in got) and not any(r.quality.kept for r in got if not r.text)
    assert keep_good(hostile).columns == hostile.columns
    assert quality_rules(empty).count() == keep_good(empty).count() == 0


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact_dedup(hostile, empty, keep, pick):
    groups: dict = {}
    for i, t, *_ in HOSTILE:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for ids in groups.values():
        stays = pick((i for i in ids if i is not None), default=None)
        want.update((i, stays, len(ids), i == stays) for i in ids)
    got = exact_dedup(hostile, keep=keep)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    left = drop_exact(hostile, keep=keep)
    assert left.columns == hostile.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for (i, _, _, k), n in want.items() if k for _ in range(n))
    assert exact_dedup(empty).count() == drop_exact(empty).count() == 0


def test_near_classes(hostile, empty):
    got = {}
    for r in near_classes(hostile, percent=80).collect():
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert got[None] == {(None, True)}
    assert got[3] == {(3, True)} and got[5] == {(5, True)} and got[6] == {(6, True)}
    # BASE, its copy, its capitals and BASE with one word more are one class
    assert {next(iter(got[i]))[0] for i in (1, 2, 11, -5)} == {-5}
    assert {next(iter(got[i]))[0] for i in (7, 8)} == {7}
    left = drop_near(hostile)
    assert left.columns == hostile.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[-5] == 1 and ids[7] == 1 and not ids[1] and not ids[8] and ids[None] == 2 and ids[9] == 2
    assert near_classes(empty).count() == drop_near(empty).count() == 0


def test_near_classes_in_blocks(spark, monkeypatch):
    """A large group of near copies around the threshold, cut into many blocks, equals all pairs."""
    from .test_queries import near_components

    random.seed(4)
    words = [f"t{i}" for i in range(150)]
    docs = []
    for i in range(240):
        text = list(words)
        for _ in range(random.choice([0, 1, 2, 3, 5, 8])):
            text[random.randrange(150)] = f"x{random.randrange(10**6)}"
        docs.append((1000 - i, " ".join(text)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = near_components(docs, 85)
    assert 1 < len({c for _, c in want.values()}) < 240
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(df).collect()} == want


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501)], "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[501] == 500


def brute_cuts(weights, shards):
    ends = np.concatenate([[0], np.cumsum(weights)]).tolist()

    def cuts(capacity):
        i, out = 0, []
        while i < len(weights):
            j = i + 1
            while j < len(weights) and ends[j + 1] - ends[i] <= capacity:
                j += 1
            i = j
            out.append(ends[i])
        return out

    return cuts(next(c for c in sorted({b - a for a in ends for b in ends if b >= a}) if len(cuts(c)) <= shards))


@pytest.mark.parametrize("n,giant,cells", [(1, 0, 64), (7, 0, 64), (16, 1, 64), (60, 0, 64), (90, 1, 32), (150, 3, 16384)])
def test_sharding_cuts(spark, monkeypatch, n, giant, cells):
    random.seed(n)
    weights = [random.choice([1, 3, random.randint(1, 900)]) for _ in range(n)]
    for g in range(giant):
        weights[n * (g + 1) // (giant + 1)] = sum(weights) // 2
    ends = spark.createDataFrame([(int(e),) for e in np.cumsum(weights)], "end long")
    monkeypatch.setattr(sharding, "CELLS", cells)
    assert sharding.minimax_cuts(ends, sum(weights), 16) == brute_cuts(weights, 16)


def test_sharding(hostile, empty):
    rows = sharding.shard(hostile, 4).collect()
    assert len(rows) == len(HOSTILE)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in HOSTILE)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard(empty, 4).count() == 0


def brute_targets(sizes):
    """Shares by weight; what is over twice a source's size goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, left = {}, set(names)
    while left:
        rest = 1.5 * sum(sizes.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return full


def test_mixing(hostile, empty, spark):
    rows = mix(hostile).collect()
    sizes = Counter()
    for _, t, _, s in HOSTILE:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(rows) == len(HOSTILE)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mix(hostile).collect()))
    out = mixed_rows(hostile)
    assert out.columns == hostile.columns
    assert out.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0] > 0
    assert mix(empty).count() == mixed_rows(empty).count() == 0
    random.seed(2)
    many = {f"s{i}": random.choice([0, 3, 50, random.randint(1, 10**6)]) for i in range(40)}
    got = source_targets(spark.createDataFrame(list(many.items()), "source string, source_size long")).collect()
    want = brute_targets(many)
    assert all(abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target) for r in got)


def test_mixing_comes_near_targets(spark):
    random.seed(6)
    docs = [(i, " ".join(["w"] * random.randint(1, 60)), random.choice("abcde" + "a" * 9)) for i in range(3000)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 30 for r in rows)


def test_language_and_quality_models(hostile, empty):
    model = language_id.fit(hostile, F.col("doc_id"))
    assert model.languages == ["de", "en", "fr", "ja"]
    got = language_id.predict(hostile, model).collect()
    assert len(got) == len(HOSTILE) and all(0 <= r.score <= 1 for r in got)
    by_text = {t: None for _, t, *_ in HOSTILE}
    assert None in by_text and all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5, 6))
    assert language_id.predict(empty, model).count() == 0
    judge = quality_model.fit(hostile, hostile.withColumn("label", F.expr("if(doc_id > 5, 0, 1)")))
    marks = quality_model.score(hostile, judge).collect()
    assert len(marks) == len(HOSTILE) and all(0 <= r.score <= 1 for r in marks)
    assert quality_model.score(empty, judge).count() == 0


def test_temperature_and_sparsity(hostile):
    logits = np.array([[8.0, 0.0], [8.0, 0.0], [0.0, 8.0], [8.0, 0.0]])
    assert language_id._calibrated(logits, np.array([0, 0, 1, 1])) > 2  # one in four is wrong: less sure than it says
    assert (language_id.fit(hostile, F.col("doc_id")).weights == 0).mean() > 0.5


def test_codec(hostile, empty):
    pieces = piece_codec.load()
    for rate in (0.0, 0.1, 1.0):
        coded = piece_codec.encode(hostile, pieces, F.col("doc_id"), dropout=rate)
        back = piece_codec.decode(coded, pieces)
        rows = back.collect()
        assert back.columns == [c for c in hostile.columns if c != "ids"] + ["ids", "decoded"]
        assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, t) for i, t, *_ in HOSTILE)
        assert all(r["a.b"] == "v-a.b" for r in rows)
    assert piece_codec.decode(piece_codec.encode(empty, pieces, F.col("doc_id")), pieces).count() == 0


def test_agenda_equals_heap():
    random.seed(1)
    pieces = piece_codec.load()
    units = ["".join(random.choice(" abcdetheriongé▁\n😀") for _ in range(random.randint(1, 40))) for _ in range(1500)]
    keys = [random.getrandbits(64) for _ in units]
    for rate in (0.0, 0.1, 0.5):
        assert piece_codec.Agenda(pieces, rate)(units, keys) == [piece_codec.encode_unit(u, pieces, k, rate) for u, k in zip(units, keys, strict=True)]


def test_forgetting_changes_nothing(monkeypatch):
    pieces = piece_codec.load()
    texts = [" ".join(f"word{random.Random(k).randrange(60)}" for _ in range(40)) + f" own{k}" for k in range(60)]
    want = piece_codec.Encoder(pieces, 3, 0.1, 4)(texts, list(range(60)))
    monkeypatch.setattr(piece_codec, "REMEMBERED", 16)
    small = piece_codec.Encoder(pieces, 3, 0.1, 4)
    assert [small([t], [k])[0] for k, t in enumerate(texts)] == want


def test_every_occurrence_draws_its_own_merges():
    pieces = piece_codec.load()
    run = piece_codec.Encoder(pieces, 3, 0.1)
    texts = [" ".join(["tokenization"] * 40 + ["  two", "é▁x", "日本語", "a1-b2", "=" * 60]) + " x" * (k % 5) for k in range(200)]
    got = run(texts, list(range(200)))
    for k, (text, ids) in enumerate(zip(texts, got, strict=True)):
        units = run.cut.findall(" " + text)
        keys = run._keys([k], np.array([len(units)])).tolist()
        assert ids == b"".join(piece_codec.encode_unit(u, pieces, x, 0.1) for u, x in zip(units, keys, strict=True))
    assert len(set(run([texts[0]] * 200, list(range(200))))) == 200  # one text, 200 documents
    # a unit is left whole as often as none of its merges is skipped
    unit, ways = " the", Counter(run([" ".join(["the"] * 5000)], [7]))
    merges = piece_codec.Agenda(pieces, 0.0)([unit], [0], trace := []) and len(trace)
    whole = next(iter(ways)).count(np.int32(pieces.ids["▁the"]).tobytes()) / 5000
    assert merges == 3 and 0.9**merges - 0.04 < whole < 0.96


def test_many_lists_are_decoded_at_once(spark, monkeypatch):
    pieces = piece_codec.load()
    b, the, gap = pieces.byte_ids, pieces.ids["▁the"], pieces.ids["▁"]
    good = [None, [], [the], [gap], [gap, gap, the], [the, b[0x20]], [b[0x20], the], [b[0xC3], b[0xA9]], [0, 1, 2]]
    bad = [[b[0xE9], the], [the, b[0xC3]], [b[0xED], b[0xA0], b[0x80]]]
    plain = piece_codec.decode_ids
    want = {repr(x): None if x is None else plain(x, pieces.surface) for x in good + bad}

    def decoded(lists):
        rows = spark.createDataFrame([(repr(x), x) for x in lists], "name string, ids array<int>").coalesce(1)
        return {r.name: r.decoded for r in piece_codec.decode(rows, pieces).collect()}

    assert decoded(good + bad) == want and "\ufffd" in want[repr(bad[0])]
    surface = pa.array(pieces.surface, pa.large_binary())
    part = pa.array([[the], *good], pa.list_(pa.int32())).slice(1)
    monkeypatch.setattr(piece_codec, "decode_ids", None)  # not needed where the bytes are UTF-8
    assert piece_codec.decode_lists(part, surface).to_pylist() == [want[repr(x)] for x in good]


def test_table_of_merges_has_each_pair_and_no_other():
    pieces = piece_codec.load()
    agenda = piece_codec.Agenda(pieces, 0.0)
    pairs = np.array(list(pieces.merges), dtype=np.int64)
    left, right = pairs >> 32, pairs & 0xFFFFFFFF
    zero = np.zeros(len(pairs), dtype=np.int64)
    made = agenda._propose(left, right, zero, zero.astype(np.uint64))
    assert (made & (1 << agenda.PIECE) - 1).tolist() == list(pieces.merges.values())
    turned = agenda._propose(right, left, zero, zero.astype(np.uint64)) < agenda.NONE
    assert turned.tolist() == [(int(r) << 32 | int(x)) in pieces.merges for x, r in zip(left, right, strict=True)]
    for x, r in ((-1, 5), (0, -1), (-2, -2), (5, -2), (-2, 0)):
        assert (agenda._propose(np.array([x]), np.array([r]), zero[:1], zero[:1].astype(np.uint64)) == agenda.NONE).all()
    agenda._slot = lambda pair: np.zeros(len(pair), dtype=np.int64)  # all at one slot: the next free ones are taken
    agenda._index(pairs[:50], np.arange(50, dtype=np.int32))
    found = agenda._propose(pairs[:60] >> 20, pairs[:60] & (1 << 20) - 1, zero[:60], zero[:60].astype(np.uint64))
    assert found.tolist() == [*range(50), *[agenda.NONE] * 10]


def test_epochs_of_a_document_differ(spark):
    rows = [(1, LONG[:4000], "en", "a")] * 2 + [(2, LONG[:4000], "en", "a")]
    got = corpus_pipeline.encoding(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "").collect()
    assert len({tuple(r.pieces) for r in got}) == 3 and all(r.lossless for r in got)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site</p></header>
<nav><ul><li>Home</ul></nav><div id="cookie-notice">We use cookies</div>%s<div class="comments"><article>Reader says</article></div>
<form><p>Mail</p></form><script>var x="</p><p>no";</script><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_a_page():
    body = """<article class="post no-comments"><header><h1>A &amp; B</h1></header><p>One <b>two</b>
    three&nbsp;four<br>five<p>six<aside>side</aside><div class="share-buttons">share</div><ul><li>x<li>y</ul></article>"""
    assert html_extract.main_text(PAGE % body, set()) == "A & B\nOne two three four five\nsix\nx\ny"
    assert html_extract.main_text(PAGE % "<main><h1>H</h1><p>text</main>", set()) == "H\ntext"
    assert html_extract.main_text("<nav>menu<article>kept</article>", set()) == "kept"
    assert html_extract.main_text(None, set()) == html_extract.main_text("", set()) == ""
    assert html_extract.main_text("<!-- open <p>gone", set()) == ""
    assert html_extract.main_text("5 < 6 &lt; 7", set()) == "5 < 6 < 7"


def test_longest_common_subsequence():
    random.seed(8)
    for _ in range(200):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        hit = [x for x, s in zip(a, html_extract.shared_lines(a, b), strict=True) if s]
        rest = iter(b)
        assert len(hit) == table[-1][-1] and all(x in rest for x in hit)


def test_page_differencing(spark):
    plain = lambda k: f"<body><div>Our shop</div><div>text number {k} is here and long enough</div><div>Call us</div></body>"
    rows = [(k, f"http://h.org/p/{k}", plain(k)) for k in range(5)]
    rows += [(10, "http://other.org/", plain(1)), (11, None, None), (12, None, "<p>alone"), (13, "http://h.org/p/4", plain(4)), (13, "http://h.org/p/4", plain(4)),
             (None, "//copy.org/a", "<p>same words</p>"), (21, "//copy.org/b", "<p>same words</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == f"text number {k} is here and long enough" for k in range(5))
    assert text[10].startswith("Our shop") and text[11] == "" and text[12] == "alone"
    assert text[None] == text[21] == "same words"  # copies say nothing about the template
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_runs_of_copies_and_short_pages(spark):
    page = lambda text: f"<div>Our shop has a long line of things to say</div><div>{text}</div><div>Call us today or any day</div>"
    copies = [(k, f"http://h.org/b{k}", page("this page is there four times")) for k in range(4)]
    rows = [(10, "http://h.org/a", page("one")), *copies, (11, "http://h.org/c", page("two"))]
    rows += [(20 + k, f"http://short.org/{k}", page(str(k))) for k in range(2)] + [(30 + k, f"http://same.org/{k}", page("x")) for k in range(3)]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k].text for k in range(4)} == {"this page is there four times"}
    assert (got[10].text, got[11].text, got[20].text, got[21].text) == ("one", "two", "0", "1")
    assert all(got[30 + k].text.startswith("Our shop") and got[30 + k].n_shared == 0 for k in range(3))
    assert all(got[k].n_shared == 2 for k in (0, 1, 2, 3, 10, 11, 20, 21))


def test_markers_and_rendering(spark):
    raw = "### System: be brief\nUser: hello there\nhow are you?\nAssistant: fine\n**Human:** thanks\n<|assistant|> bye"
    lines = chat_format.transcript_lines(spark.createDataFrame([(1, raw), (2, None)], "conv_id long, transcript string"))
    counted = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    model = chat_format.fit(chat_format.ordered(counted, "conv_id", "turn", "text", "role"), F.lit(True))
    got = chat_format.parse_transcripts(lines, role=None, model=model).orderBy("turn").collect()
    assert [r.role_pred for r in got][:2] == ["system", "user"] and [r.role_pred for r in got][3:] == ["assistant", "user", "assistant"]
    whole = "".join(r.rendered for r in got)
    assert whole.startswith("<|system|>\nbe brief\n<|end|>\n<|user|>\nhello there") and whole.endswith("<|assistant|>\nbye\n<|end|>\n")
    assert whole.count("<|end|>") == sum(r.opens for r in got)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (1, None, "assistant", ""), (None, 0, "odd", "x"), (None, None, None, None),
            (2, 0, "user", "q?"), (2, 0, "user", "q?"), (3, 5, "system", LONG), (3, 5, "assistant", BASE)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("id", F.lit("x"))
    got = chat_format.parse_transcripts(df).collect()
    assert Counter((r.conv_id, r.turn, r.role) for r in got) == Counter((a, b, c) for a, b, c, _ in rows)
    assert all(r.role_pred in chat_format.ROLES for r in got)
    assert chat_format.parse_transcripts(df.limit(0)).count() == 0


def test_viterbi_in_blocks_equals_one_pass(spark, monkeypatch):
    random_ = np.random.default_rng(3)
    steps = random_.normal(size=(700, 3, 3))
    starts = random_.random(700) < 0.05
    steps[starts] = steps[starts][:, :1, :]
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(steps)], "place long, m array<double>")
    monkeypatch.setattr(chat_format, "BLOCK", 8)  # four levels
    got = [r.state for r in chat_format._states(df, 700).orderBy("place").collect()]
    assert got == chat_format._inner(steps, -1, -1).tolist()
