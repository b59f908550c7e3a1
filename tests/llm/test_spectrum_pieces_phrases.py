"""Whitening, SentencePiece encoding and phrase mining against plain versions."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from tablewright.llm import phrases, piece_encoding, piece_model, scratch, spectrum, whitening  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.awkward_rows(), cases.SCHEMA)


# whitening

def plain_polynomial(matrix):
    """Coefficients of det(x - matrix), constant first, by traces of powers."""
    size = len(matrix)
    a = np.array(matrix, object).reshape(size, size)
    m, out = np.zeros((size, size), object), [1]
    for k in range(1, size + 1):
        m = a @ m + out[-1] * np.identity(size, dtype=int).astype(object)
        out.append(-Fraction(int((a @ m).trace()), k))
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("size,scale", [(1, 5), (2, 9), (6, 1000), (9, 1 << 50)])
def test_polynomial_is_exact(size, scale):
    rng = random.Random(size)
    rows = [[rng.randint(-scale, scale) for _ in range(size)] for _ in range(size + 2)]
    square = [[sum(r[i] * r[j] for r in rows) for j in range(size)] for i in range(size)]
    primes = spectrum.enough_primes(spectrum.coefficient_bound(square))
    assert spectrum.combine([spectrum.polynomial_modulo(square, p) for p in primes], primes) == plain_polynomial(square)


def test_polynomial_with_zero_pivots():
    for square in ([[0] * 4] * 4, [[2, 0, 0, 0], [0, 0, 0, 0], [0, 0, 5, 5], [0, 0, 5, 5]], [[1, 0, 1], [0, 1, 0], [1, 0, 1]]):
        primes = spectrum.enough_primes(spectrum.coefficient_bound(square))
        assert spectrum.combine([spectrum.polynomial_modulo(square, p) for p in primes], primes) == plain_polynomial(square)


@pytest.mark.parametrize("eigenvalues", [[7, 7, 7, 2], [9, 4, 4, 0], [1, 0, 0, 0], [1 << 60, (1 << 60) - 1, 3, 1], [8, 4, 2, 1]])
def test_roots_and_vectors_of_repeated_close_and_round_eigenvalues(eigenvalues):
    # an orthogonal matrix of whole numbers, times 2: H / 2
    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], object)
    square = (h @ np.diag(np.array(eigenvalues, object)) @ h.T).tolist()  # 4 times the eigenvalues
    primes = spectrum.enough_primes(spectrum.coefficient_bound(square))
    poly = spectrum.combine([spectrum.polynomial_modulo(square, p) for p in primes], primes)
    top = (-poly[-2]).bit_length()
    found = []
    for low, bits, times in spectrum.isolate(poly, 4):
        low, bits = spectrum.refine(poly, low, bits, times, top)
        for vector in spectrum.eigenvectors(square, low, bits, times):
            found.append((Fraction(low) / Fraction(2) ** bits, vector))
    wanted = sorted((4 * e for e in eigenvalues if e), reverse=True)
    assert len(found) == len(wanted)
    for (value, vector), e in zip(found, wanted):
        assert abs(value - e) < Fraction(1, 1 << 100)
        image = [sum(Fraction(v) * int(x) for v, x in zip(vector, row)) for row in square]
        assert max(abs(y - e * Fraction(v)) for y, v in zip(image, vector)) < Fraction(max(wanted)) * Fraction(1, 1 << 49)
    basis = np.array([v for _, v in found])
    assert np.abs(basis @ basis.T - np.eye(len(basis))).max() < 1e-14


def plain_whitening(rows, width):
    """n, deviation by place in rows, and e / trace, all from whole numbers."""
    numbers = {}
    for place, (_, vector) in enumerate(rows):
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            numbers[place] = [math.floor(Fraction(c) * 64) + 1000000 for c in vector] + [1000000] * (width - len(vector))
    fit = sorted(set(map(tuple, numbers.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = {p: sum((n * x - s) ** 2 for x, s in zip(v, sums)) for p, v in numbers.items()}
    return n, sums, fit, numbers, deviations


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType()),
                        T.StructField("a.b", T.StringType())])


def vector_rows(count=60, width=6, seed=2, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, scale * (j + 1)))) for j in range(width)]) for i in range(count)]
    return rows + [(100, None), (101, [1.0, None] + [0.0] * (width - 2)), (102, [float("nan")] * width), (103, [float("inf")] + [0.0] * (width - 1)),
                   (104, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (105, [0.5, 0.25]), (106, [])]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e15])
def test_whitening_equals_the_plain_one(spark, scale):
    rows = vector_rows(scale=scale)
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], VECTORS).repartition(5)
    found = whitening.whiten(frame, components=4).collect()
    n, sums, fit, numbers, deviations = plain_whitening(rows, 6)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.vec_id].append(r)
    assert Counter(r.vec_id for r in found) == Counter({i: 4 * c for i, c in Counter(rows[p][0] for p in numbers).items()})
    assert {r.n for r in found} == {n}
    for place, exact in deviations.items():
        for r in by_id[rows[place][0]]:
            assert r.deviation_digits == str(exact) and r.deviation == (exact if exact < 1 << 63 else None)
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    white = {}
    for place, v in numbers.items():
        own = sorted(by_id[rows[place][0]], key=lambda r: r.component)[-4:] if rows[place][0] != 0 else [
            next(r for r in by_id[0] if r.component == c) for c in (1, 2, 3, 4)]
        white[tuple(v)] = [r.whitened for r in own]
        assert [r.component for r in own] == [1, 2, 3, 4]
    got = np.array([white[v] for v in fit])
    assert np.abs(got.T @ got / n - np.eye(4)).max() < 1e-9
    for c in range(4):
        plain = centred @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
        assert min(np.abs(got[:, c] - plain).max(), np.abs(got[:, c] + plain).max()) < 1e-6
        assert {round(r.explained, 9) for r in found if r.component == c + 1} == {round(values[-1 - c] / values.sum(), 9)}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_without_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        frame = spark.createDataFrame([(*r, "x", None) for r in rows], VECTORS)
        done = whitening.whiten(frame)
        assert done.collect() == [] and done.columns[:3] == ["vec_id", "component", "n"]
    # two vectors lie on a line: one component, whatever the dimension
    frame = spark.createDataFrame([(1, [1.0, 2.0, 0.0], "", ""), (2, [2.0, 0.0, 0.0], "", "")], VECTORS)
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in whitening.whiten(frame).collect()) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


# pieces

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return sentencepiece.SentencePieceProcessor(model_file=path), file.read()


def odd_texts(count=1500):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "▁", "the", "ing", "\n", "é", "漢", "🙂", "\x00", "1", ".", " th", "<unk>", "</s>", "<0x41>", "́", "==", "//", "\t", " ", "�"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(count)]
    return ["", " ", "   x", "x ", "▁", " ▁ ", "a" * 500, "ab" * 3000, " " * 77, "the" * 40 + "\n" * 20, *made]


def test_pieces_equal_the_library(library):
    theirs, data = library
    model = piece_model.PieceModel(data)
    encoder = piece_encoding.Encoder(model)
    for text in odd_texts():
        ids = theirs.encode(text)
        mine, n, decoded, bounds = encoder.encoded(text)
        assert mine == ",".join(map(str, ids)) and n == len(ids) and decoded == theirs.decode(ids)
        spans = [(p.begin, p.end) for p in theirs.encode(text, return_type="proto").pieces]
        assert list(zip(bounds.tolist(), bounds.tolist()[1:])) == spans, text
        assert bounds[-1] == len(text.encode())
    rng = random.Random(8)
    for _ in range(500):
        ids = [rng.choice([3 + rng.randrange(256), rng.randrange(32000), 0, 1, 2, 259, 29871]) for _ in range(rng.randint(0, 12))]
        assert model.decoded(ids) == theirs.decode(ids)


def test_short_and_long_words_merge_alike(library):
    model = piece_model.PieceModel(library[1])
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("theingaor▁") for _ in range(rng.randint(1, 30)))
        assert model._merged_short(word) == model._merged_long(word)


def test_character_map_and_alignment_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    spaces = ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces")
    for rule, flags in (("nmt_nfkc", (0, 0, 0)), ("nmt_nfkc", (1, 0, 1)), ("nmt_nfkc", (0, 1, 0)), ("nmt_nfkc_cf", (1, 1, 1))):
        theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, **{k: bool(v) for k, v in zip(spaces, flags)})
        spec = next(dict(piece_model._fields(value)) for field, value in piece_model._fields(theirs.serialized_model_proto()) if field == piece_model.NORMALIZER)
        model = object.__new__(piece_model.PieceModel)
        model.map = piece_model.CharacterMap(spec[piece_model.CHARACTER_MAP])
        model.add_space, model.remove_spaces = bool(flags[0]), bool(flags[1])
        model.space = piece_model.SPACE if flags[2] else " "
        rng = random.Random(1)
        letters = ["a", "É", "ﬁ", "①", "Ａ", " ", "  ", "　", "é", "​", "ß", "漢", "🙂", "㍿", "\t", "\n", "ｶﾞ", "̈́", "㌢"]
        for _ in range(800):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
            wanted, offsets = theirs.normalize(text, with_offsets=True)
            mine, source = model.normalised(text)
            assert mine == wanted, text
            if mine:
                # the library counts in characters of the source
                places = np.cumsum([0, *(len(c.encode()) for c in text)])
                assert source == [int(places[o]) for o in offsets], text


def test_encoding_of_awkward_rows(spark, docs, library):
    theirs, data = library
    rows = {(r.doc_id, r.text): r for r in piece_encoding.encode(docs, data).collect()}
    for (_, text), r in rows.items():
        ids = theirs.encode(text or "")
        assert (r.ids, r.n_tokens) == (ids, len(ids)) and len(r.stops) == len(ids)
        assert r.ids_sha256 == piece_encoding._digest(",".join(map(str, ids))) and r.decoded_sha256 == piece_encoding._digest(theirs.decode(ids))
        assert r.n_bytes == len((text or "").encode()) and (not ids or r.stops[-1] == r.n_bytes)
    short = piece_encoding.encode(docs, data, tokens=False)
    assert "ids" not in short.columns and short.count() == docs.count()
    back = piece_encoding.decode(piece_encoding.encode(docs.select("doc_id", "text"), data).select("text", "ids"), data).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert piece_encoding.encode(docs.filter("false"), data).collect() == []


# phrases

def plain_phrases(rows, longest=5, least=100, first=2000, percent=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", cases.lower(text)):
            own = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(own)
            for size in range(1, longest + 1):
                for i in range(len(own) - size + 1):
                    counts[lang][tuple(own[i:i + size])] += 1
    out = []
    for lang, own in counts.items():
        good = {p: f for p, f in own.items() if f >= least}
        scored = []
        for p, a in good.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * f >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in good.items()):
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def phrase_rows(count=300, seed=3):
    rng = random.Random(seed)
    words = ["tha", "Réon", "und", "of", "ing", "the", "ständ", "new", "york", " x"]
    rows = []
    for i in range(count):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New York is large" for _ in range(rng.randint(0, 30))]
        rows.append((["en", "fr", None, "und"][i % 4], "".join(p + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " "]) for p in parts)))
    return rows + [("en", None), ("fr", ""), (None, " \t\n.,"), ("de", "one"), ("en", "new york " * 5000), ("en", "new york " * 5000)]


@pytest.mark.parametrize("least,options", [(2, {"block_words": 300, "sample": 4}), (5, {"block_words": 1000, "sample": 1}), (5, {"sample": 1000}),
                                           (20, {"percent": 80, "first": 7, "sample": 8}), (3, {"longest": 3, "first": 20})])
def test_phrases_equal_the_plain_count(spark, least, options):
    rows = phrase_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").repartition(3)
    found = sorted(tuple(r) for r in phrases.mine_phrases(frame, least=least, **options).collect())
    plain = {k: v for k, v in options.items() if k in ("longest", "first", "percent")}
    assert found == plain_phrases(rows, least=least, **plain) and found


def test_phrases_of_awkward_rows_and_none(spark, docs):
    found = sorted(tuple(r) for r in phrases.mine_phrases(docs, least=2).collect())
    assert found == plain_phrases([(r.lang, r.text) for r in docs.collect()], least=2)
    assert phrases.mine_phrases(docs.filter("false")).collect() == []
    assert phrases.mine_phrases(docs.select("lang", F.lit(None).cast("string").alias("text"))).collect() == []


def test_a_filter_that_says_yes_to_everything_changes_nothing(spark, monkeypatch):
    rows = phrase_rows(120)
    frame = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "_filter", lambda new, count: phrases.Filter(np.full(64, -1).view(np.uint64)))
    assert sorted(tuple(r) for r in phrases.mine_phrases(frame, least=4).collect()) == plain_phrases(rows, least=4)


def test_border_failures_are_closed(spark):
    """A sample that holds nothing proposes nothing: every length takes a pass."""
    rows = phrase_rows(120)
    tables = scratch.Tables(spark, "test")
    frame = spark.createDataFrame(rows, "lang string, text string")
    _, found = phrases.frequent_phrases(frame, tables, lang="lang", text="text", longest=5, least=4, block_words=500, sample=10 ** 9)
    counts = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", cases.lower(text)):
            own = [w for w in re.split("[\x20\x09]+", piece) if w]
            for size in range(1, 6):
                counts.update((lang or "und", *own[i:i + size]) for i in range(len(own) - size + 1))
    assert sorted(r.n for r in found.collect()) == sorted(f for f in counts.values() if f >= 4)


def test_later_passes_lose_nothing_to_full_filters(spark, monkeypatch):
    """Filters that let nearly a third of all phrases through wrongly, and almost nothing proposed."""
    rng = np.random.default_rng(3)
    rows = [("en", " ".join(f"w{int(x * x * 30)}" for x in rng.random(60))) for _ in range(400)]
    monkeypatch.setattr(phrases, "BITS_EACH", 1)
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = sorted(tuple(r) for r in phrases.mine_phrases(frame, least=4, sample=399, block_words=2000).collect())
    assert found == plain_phrases(rows, least=4)
