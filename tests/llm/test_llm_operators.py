"""Each operator against a plain version, on awkward rows and on the smallest tables."""

import math
import os
import random
import time
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from checks.compare import difference, duck  # noqa: E402
from tablewright.llm import (boilerplate, components, decontaminate, hamming, jaccard_join, katz, language, mixing, page_structure,  # noqa: E402
                             queries, scratch, sharding, tokens, toxicity, trie_counts)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.awkward_rows(), cases.SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def held(of=10):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == 0


def pairs_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_words_match_a_plain_split():
    texts = [t for _, t, *_ in cases.awkward_rows()]
    for slice_bytes in (16, 1 << 20):
        found = [w.decode() for part in tokens.words_of(pa.array(texts), slice_bytes=slice_bytes) for w in part.strings(np.arange(len(part.starts)))]
        assert found == [w for t in texts for w in cases.words(t)]
    parts = [h for part in tokens.words_of(pa.array(texts)) for h in part.hashes.tolist()]
    assert len(set(parts)) == len({w for t in texts for w in cases.words(t)})


# 1

@pytest.mark.parametrize("order,options", [(2, {}), (2, {"block_words": 400, "bucket_grams": 60}), (3, {"block_words": 400, "bucket_grams": 60})])
def test_katz_equals_the_plain_model(docs, order, options):
    rows = pairs_of(docs)
    expected, *_ = cases.katz(rows, [cases.remainder(d, 10) == 0 for d, _ in rows], katz.discounts, order)
    found = katz.score_texts(docs.withColumn("place", F.monotonically_increasing_id()), held(), order=order, **options)
    assert {"a.b", "unit", "n_chars"} <= set(found.columns)
    ours = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect())
    assert ours == Counter((d, n, known, total, round(b, 6), round(s, 6)) for (d, _), (_, n, known, total, b, s) in zip(rows, expected))


def test_katz_adds_up_to_one_and_beats_the_base(small):
    rows = pairs_of(small)
    _, probability, after, counts = cases.katz(rows, [cases.remainder(d, 10) == 0 for d, _ in rows], katz.discounts)
    every = [w for (w,) in counts[1]] + ["?"]
    for history in random.Random(1).sample(sorted(after[2]), 3):
        assert abs(sum(probability(2, history, w) for w in every) - 1) < 1e-9
    found = katz.score_texts(small, held(), columns=["doc_id"]).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_katz_without_training_or_rows(docs, nothing):
    assert katz.score_texts(nothing, held()).count() == 0
    assert {r.score for r in katz.score_texts(docs, F.lit(True)).collect()} == {0.0}


def test_discounts_fall_back():
    assert all(0 < x < 1 for x in katz.discounts([0, 100, 40, 20, 12, 8, 6])[1:])
    assert all(0 < x < 1 for x in katz.discounts([0, 3, 0, 0, 9, 0, 0])[1:])


# 2

@pytest.mark.parametrize("limits", [(128, 512), (2, 2)])
def test_classes_equal_the_plain_join(docs, small, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", limits[0])
    monkeypatch.setattr(jaccard_join, "VISITS", limits[1])
    for frame, options in ((docs, {}), (small, {"block_words": 3000, "bucket_words": 5000})):
        rows = pairs_of(frame)
        expected = Counter((d, *c) for (d, _), c in zip(rows, cases.classes(rows)))
        found = jaccard_join.similarity_classes(frame, **options).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected


def test_near_copies_in_a_chain_and_a_star(spark, monkeypatch):
    """Copies that are linked only through others, in one large group cut into small parts."""
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows, chain = [(0, " ".join(base))], list(base)
    for i in range(1, 30):  # a star: each differs from the base in two places
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = f"x{i}{at}"
        rows.append((i, " ".join(copy)))
    for i in range(30, 60):  # a chain: each differs from the one before
        chain[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(chain)))
    found = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {d: c for (d, _), c in zip(rows, cases.classes(rows))}


def test_shingles_that_a_part_does_not_hold_are_not_counted():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 2 ** 63, 60).astype(np.uint64) * np.uint64(2))
    group = jaccard_join.Group([known[:50], known[2:52]], np.array([50, 50]))
    guest = np.sort(np.concatenate([known[:36], known[:36] - np.uint64(1)]))  # each stranger lies just before a known one
    assert group.linked(guest, len(guest), 80).tolist() == []
    assert group.linked(known[:50], 50, 80).tolist() == [0, 1]


def test_similar_pairs_in_different_parts_below_the_threshold(spark, monkeypatch):
    """Pairs of Jaccard 0.5 to 0.8; what they do not share is held by third documents."""
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 2)
    monkeypatch.setattr(jaccard_join, "VISITS", 2)
    rng = random.Random(8)
    rows = []
    for pair in range(60):
        same = [f"s{pair}x{i}" for i in range(100)]
        for side in "ab":
            own = [f"{side}{pair}x{i}" for i in range(rng.randrange(16, 40))]
            rows += [(len(rows), " ".join(same + own)), (len(rows) + 1, " ".join([f"t{side}{pair}x{i}" for i in range(100)] + same[-4:] + own))]
    found = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {d: c for (d, _), c in zip(rows, cases.classes(rows))}


def test_one_of_each_keeps_the_smallest(docs, nothing):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = pairs_of(docs)
    expected = {c[1] for (d, _), c in zip(rows, cases.classes(rows)) if c[0]}
    found = [r.doc_id for r in kept.collect() if cases.words(r.text)]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))  # ids that are text
    assert jaccard_join.one_of_each(named).schema == named.schema and jaccard_join.one_of_each(named).count() == kept.count()
    assert len(found) == len(set(found)) and set(found) == expected
    assert kept.filter("trim(coalesce(text, '')) = ''").count() == sum(not cases.words(t) for _, t in rows) - 1  # '  \t\n ' stays too
    assert jaccard_join.one_of_each(nothing).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges, scratch.Tables(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 90: 90, 100: 90}


# 3

def test_shards(docs, small, nothing):
    for frame, options in ((docs, {}), (small, {}), (small, {"unit_limit": 40})):
        found = sharding.shard_documents(frame, 8, **options).collect()
        assert len(found) == frame.count()
        slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
        for r in found:
            assert r["size"] == len((r.text or "").encode()) + 1
            slots[r.shard].append(r.slot)
            groups[r.text or ""].add(r.shard)
            sizes[r.shard] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for v in groups.values())
        if frame is small:
            assert max(sizes.values()) - min(sizes.values()) <= 0.02 * max(sizes.values())
    assert sharding.shard_documents(nothing, 8).count() == 0


def test_differencing_is_tighter_than_rounds():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 10 ** 6) for _ in range(500)]
    bins = sharding.differencing(sizes, 8)
    sums = Counter()
    for s, b in zip(sizes, bins.tolist()):
        sums[b] += s
    assert max(sums.values()) - min(sums.values()) < 1000
    assert sharding.differencing([], 8).tolist() == [] and len(sharding.differencing([5], 8)) == 1


# 4

def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in capped else level * weight[s] for s in order}
        capped |= more


def test_mix_reaches_its_targets(docs, small, nothing):
    for frame, block in ((docs, 50_000), (small, 50_000), (small, 4)):
        found = mixing.mix_sources(frame, block_rows=block).collect()
        sizes, taken = Counter(), Counter()
        for r in found:
            assert r["size"] == len(cases.words(r.text)) and 0 <= r.taken <= 3 * r["size"] and 0 <= r.copies <= 3
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
        expected = plain_targets(sizes)
        for r in found:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, expected[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert all(abs(taken[s] - expected[s]) <= 1 + len(found) / block for s in sizes)
        assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in mixing.mix_sources(frame, block_rows=block).collect())
    assert mixing.mix_sources(nothing).count() == 0
    copies = mixing.mixed_documents(small)
    assert copies.columns == small.columns and 0.8 < copies.count() / small.count() < 1.3


# 5

def test_languages(spark, docs, nothing, small):
    found = language.known_language(docs)
    assert found.columns == docs.columns
    kept = [r.doc_id for r in found.collect()]
    assert not {0, 1, 2, 12, 77} & set(kept) and {9, 10} <= set(kept)
    assert language.known_language(small).count() == small.count()
    assert language.known_language(nothing).count() == 0
    pages = spark.createDataFrame([
        (1, "http://a.example.fr/x", None), (2, None, "<html lang=de-AT><p>Und der die keit"), (3, "junk", ""), (4, "http://a.example.fr/y", "<p>12 34"),
        *[(10 + i, "http://a.example.fr/z", f'<html lang="fr"><article>{r.text}</article>') for i, r in enumerate(small.filter("lang = 'fr'").limit(5).collect())]],
        "page_id long, url string, html string")
    by_id = {r.page_id: r for r in language.identify_pages(pages, small).collect()}
    assert len(by_id) == 9 and all(by_id[10 + i].language == "fr" and not by_id[10 + i].rejected for i in range(5))
    assert by_id[1].rejected and by_id[4].rejected and by_id[4].language == "fr"  # what its host says
    assert by_id[2].text_language == "de"
    assert all(r.rejected and r.language is None for r in language.identify_pages(pages, small.limit(0)).collect())


def test_text_alone_tells_held_out_languages(small):
    train, test = small.filter("doc_id % 2 = 0"), small.filter("doc_id % 2 = 1")
    found = language.identify(test, train, text=F.col("text"), declared=F.lit(None), host=F.lit(None).cast("string"),
                              suffix=F.lit(None).cast("string"), parent=F.lit(None).cast("string"))
    right, n = found.agg(F.sum((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


# 6

def test_nearest_codes(spark):
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(63) - (1 << 62)) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [rows[3], (None, 5), (200, None)]
    for k, data in ((5, rows), (10, rows[:4]), (3, [])):
        frame = spark.createDataFrame(data, "id long, code long")
        usable = sorted({(i, c) for i, c in data if i is not None and c is not None})
        expected = set()
        for q, a in usable:
            if q % 20 == 0:
                near = sorted((bin((a ^ b) & (2 ** 64 - 1)).count("1"), i) for i, b in usable if i != q)[:k]
                expected |= {(q, at + 1, i, d) for at, (d, i) in enumerate(near)}
        assert {tuple(r) for r in hamming.nearest_codes(frame, frame.filter("id % 20 = 0"), k).collect()} == expected


def test_codes_against_sql(spark):
    build, sql = queries.QUERIES["op6_multi_index"]
    assert difference(build(spark, FOLDER), duck(FOLDER), sql) is None


# 7

def test_overlaps(spark, docs, small, nothing):
    rows = pairs_of(docs)
    text = dict(rows)[9].split()
    items = [(1, " ".join(text[100:130])), (2, " ".join(text[100:112])), (2, "ÉTÉ été"), (3, None), (4, ""), (None, "one"), (5, "one"), (6, "  , "),
             (7, " ".join(text[105:130]).upper() + "!"), (None, " ".join(text[140:155]))]
    for frame, given, block in ((docs, items, 10 ** 6), (docs, items, 7), (docs, [], 10)):
        bench = spark.createDataFrame(given, "item_id long, text string")
        expected = Counter((d, *c) for (d, _), c in zip(rows, cases.overlaps(rows, given)))
        found = decontaminate.overlap_report(frame, bench, block_windows=block)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect()) == expected
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = pairs_of(small)
    expected = {d: c for (d, _), c in zip(rows, cases.overlaps(rows, [(r.item_id, r.text) for r in bench.collect()]))}
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.overlap_report(small, bench).collect()}
    assert found == expected
    clean = decontaminate.clean_documents(small, bench)
    assert clean.columns == small.columns and {r.doc_id for r in clean.collect()} == {d for d, c in expected.items() if not c[1]}
    assert decontaminate.overlap_report(nothing, bench).count() == 0


# 8

def test_page_blocks():
    blocks = page_structure.blocks
    assert blocks("") == [] and blocks("<p>a<b>b</b>c &amp; d\n e<br>f") == [(2, "abc & d e"), (2, "f")]
    assert blocks("<nav>x</nav><article><h1>t</h1><div class='share-box'>y</div><p>z<p>w</article>q<script>a<b</script>") == [
        (0, "x"), (1, "t"), (0, "y"), (1, "z"), (1, "w"), (2, "q")]
    assert blocks("<main>a<!-- <p> -->b<section id=comments>c</section>d</main><footer>e") == [(1, "ab"), (0, "c"), (1, "d"), (0, "e")]
    assert blocks("<p hidden>a</p><p>b</p><div style='display: none'>c</div><p title='x>y'>d") == [(0, "a"), (2, "b"), (0, "c"), (2, "d")]
    assert blocks("<div class='content-sidebar'><div class='comments'><article>x</article></div><article>a</article>b</div>") == [
        (0, "x"), (1, "a"), (2, "b")]  # a wrapper that is named after what stands beside the article
    assert blocks("<a b='>c</a>d'>e<a ' f>g") == [(2, "eg")] and blocks("a<b c <d e<!-- f") == [(2, "a<b c <d e")]
    for odd in ("<a ", "<a b='", "<a '>'", "<a \">\" '", "</script <", "<script>", "<!--", "<p "):  # time grows with the length
        begin = time.perf_counter()
        blocks(odd * 200_000)
        blocks("<script>" + odd * 200_000 + ">")
        assert time.perf_counter() - begin < 10
    assert blocks("a < b <") == [(2, "a < b <")] and len(blocks("<p>" + "x " * 100_000)) == 1


def test_main_text(spark):
    line = "this line is on every page of the host"
    pages = [(i, "http://h.example/x", f"<div>{line}</div><div>page{i} has words {i * 7} of its own</div>") for i in range(4)]
    pages += [(10, "http://h.example/a", f"<article>{line} &copy; kept</article><div>out</div>"), (11, None, None), (12, "u", ""), (13, "http://other", f"<p>{line}</p>")]
    frame = spark.createDataFrame(pages + [pages[0]], "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_chars) for r in boilerplate.main_text(frame).collect()}
    for i in range(4):  # the repeated run ends where the pages differ
        assert found[i][0] == f"page{i} has words {i * 7} of its own"
    assert found[10] == (f"{line} © kept", len(line) + 7) and found[11] == found[12] == ("", 0) and found[13][0] == line
    assert boilerplate.main_text(frame).count() == 9 and boilerplate.main_text(frame.limit(0)).count() == 0


def test_main_text_without_what_a_host_repeats_inside_its_main_elements(spark):
    words = random.Random(8)
    own = [" ".join(f"w{words.randrange(10 ** 6)}" for _ in range(30)) for _ in range(40)]
    share, license_ = "Share this story with your friends today", "This text is free under the open license"
    def page(*blocks, beside="<div class=ad>buy now</div>"):
        return f"{beside}<main>{''.join(f'<p>{b}</p>' for b in blocks)}</main>"
    rows = [(i, "http://news.example/x", page(own[i], share) if i else page(own[0], share, license_)) for i in range(20)]
    rows += [(i, "http://news.example/x", page(own[i], license_)) for i in range(20, 25)]  # on few pages, so part of the article
    rows += [(25, "http://news.example/x", page(f"{own[25]} {share} {own[26]}")), (26, "http://news.example/x", page(share, "short"))]  # not a block of its own; most of a page
    rows += [(30 + i, "http://small.example/x", page(own[i], share)) for i in range(9)]  # too few pages
    rows += [(40 + i, "http://twins.example/x", page(own[30], "Day", str(i), beside=f"<nav>{i}</nav>")) for i in range(12)]  # one article, many addresses
    rows += [(60 + i, "http://copies.example/x", page(own[i % 9], share)) for i in range(18)]  # nine different pages
    expected = {i: own[i] for i in range(20)} | {0: f"{own[0]} {license_}", 25: f"{own[25]} {share} {own[26]}", 26: f"{share} short"}
    expected |= {i: f"{own[i]} {license_}" for i in range(20, 25)} | {30 + i: f"{own[i]} {share}" for i in range(9)}
    expected |= {40 + i: f"{own[30]} Day {i}" for i in range(12)} | {60 + i: f"{own[i % 9]} {share}" for i in range(18)}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for runs in (40, 1 << 21):  # in chunks of a page, so every run is a candidate, and in large ones
        assert {r.page_id: r.text for r in boilerplate.main_text(frame, chunk_runs=runs).collect()} == expected


def test_main_text_equals_a_plain_search(spark):
    draw = random.Random(9)
    lines = [" ".join(draw.choice("abcdefgh") for _ in range(draw.choice((1, 3, 6, 7, 9)))) for _ in range(12)]
    rows = []
    for i in range(90):
        texts = [draw.choice(lines[3 * (i % 3): 3 * (i % 3) + 2 + i // 3 % 3]) if draw.random() < 0.6 else " ".join(draw.choice("ijklmnopqrs") for _ in range(12)) for _ in range(6)]
        body = "".join(f"<p>{t}</p>" for t in texts[1:])
        rows.append((i, f"http://h{i % 3}.example/", f"<nav>{texts[0]}</nav><article>{body}</article>"))
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:20])]
    pages, runs = defaultdict(set), defaultdict(set)
    def runs_of(html):
        words = [w for _, t in page_structure.blocks(html) for w in t.split()]
        return [tuple(words[a: a + 4]) for a in range(len(words) - 3)]
    for _, host, html in rows:
        pages[host].add(html)
        for g in runs_of(html):
            runs[host, g].add(html)
    expected, shortened = {}, 0
    for i, host, html in rows:
        covered = {a + k for a, g in enumerate(runs_of(html)) if len(runs[host, g]) >= 12 and 4 * len(runs[host, g]) >= 3 * len(pages[host]) for k in range(4)}
        at, all_, kept = 0, [], []
        for kind, t in page_structure.blocks(html):
            here = range(at, at := at + len(t.split()))
            if kind == page_structure.CONTENT:
                all_.append(t)
                if not covered.issuperset(here):
                    kept.append(t)
        if 2 * len(" ".join(kept).split()) < len(" ".join(all_).split()):
            kept = all_
        shortened += kept != all_
        expected[i] = " ".join(kept)
    assert 10 < shortened < 100
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size, partitions in ((30, 4), (1 << 21, 60)):  # the second with pages far from others of their host
        found = {r.page_id: r.text for r in boilerplate.main_text(frame.repartition(partitions), min_tokens=4, min_pages=12, chunk_runs=size).collect()}
        assert found == expected


# 9

def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    neutral = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = [rng.choice(neutral) for _ in range(12)] + (["awfulish"] if bad else [])
        # a group is named more often in bad texts
        if rng.random() < (0.7 if bad else 0.1):
            text.append("muslim")
        elif rng.random() < 0.3:
            text.append("christian")
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(frame, given, ~held(5)).collect()}
    assert sum(found[i].predicted == y for i, y in labels) > 390
    swap = spark.createDataFrame([(1, "word1 word2 muslim"), (2, "word1 word2 christian"), (3, None)], "doc_id long, text string")
    gap = []
    for penalty in (0.0, 20.0):
        model = toxicity.train(frame, given, ~held(5), scratch.Tables(spark, "test"), swap_penalty=penalty)
        by_id = {r.doc_id: r.s for r in swap.select("doc_id", toxicity.score_column(swap, model).alias("s")).collect()}
        gap.append(abs(by_id[1] - by_id[2]))
        assert 0 <= by_id[3] <= 1
    assert gap[1] < gap[0] / 2
    assert toxicity.score_documents(nothing, given, ~held(5)).count() == 0
    clashing = toxicity.score_documents(frame.selectExpr("*", "doc_id as id", "'x' as label"), given, ~held(5))
    assert {r.doc_id: r.predicted for r in clashing.collect()} == {i: r.predicted for i, r in found.items()}
    alike = toxicity.score_documents(docs, given.limit(0), ~held(5))
    assert {r.predicted for r in alike.select("predicted").collect()} == {0} and alike.count() == docs.count()


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op9_counterfactual"][0](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.93


# 10

def test_trie_counts_equal_the_plain_recurrence(docs, nothing):
    pieces = trie_counts.Pieces(trie_counts.read_pieces())
    expected = Counter()
    for d, t in pairs_of(docs):
        own = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]
        expected[d, len(own), sum(trie_counts.count_word(trie_counts.LEAD + w.encode(), pieces) for w in own)] += 1
    for options in ({}, {"block_words": 500, "bucket_words": 5}):
        found = trie_counts.token_counts(docs, **options).collect()
        assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in found) == expected
    assert trie_counts.token_counts(nothing).count() == 0


def test_long_and_odd_words():
    pieces = trie_counts.Pieces([b"\xe2\x96\x81", b"a", b"aa", b"ab", b"b", "é".encode()])
    for word in (b"", b"a", b"aab", b"abab" * 3, "éa漢".encode(), b"x\x00"):
        assert trie_counts.count_words([word], pieces)[0] == trie_counts.count_word(trie_counts.LEAD + word, pieces)
    assert trie_counts.count_words([b"a" * 300, b"a" * 20], pieces).tolist() == [trie_counts.count_word(trie_counts.LEAD + b"a" * n, pieces) for n in (300, 20)]
