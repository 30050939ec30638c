"""Hard negatives, packing and phrases: against brute force and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelar.llm import hard_negatives, packing, phrases
from voxelar.llm._common import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, x, "s", None) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], DOCS)


# --- hard negatives


@pytest.mark.parametrize("size", [1, 63, 64, 65, 200])
@pytest.mark.parametrize("largest", [1, 300, 1_000_000])
def test_residue_products_are_exact(size, largest):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-largest, largest + 1, (n, size)) for n in (150, 40))
    a[0], b[0], b[1] = largest, largest, -largest
    got = np.concatenate([part for _, part in hard_negatives.scores(a, b)])
    assert (got == a.astype(object) @ b.astype(object).T).all()


def test_scores_beyond_the_limit_are_an_error():
    big = np.full((1, 2), 1 << 26)
    with pytest.raises(ValueError, match="limit"):
        list(hard_negatives.scores(big, big))


VECTORS = "vec_id long, embedding array<float>, label int, rank int, anchor string, row string"


def mined(rows, positives=5, negatives=10):
    """Brute force over rows (id, vector, label) that take part, repeated anchors once."""
    ok = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in ok]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in ints if i % 100 == 0}:
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for j, w, z in ints if len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == y and x[1] != i)[:positives]:
            hard = sorted(x for x in score if x[2] != y and -30 * s <= -100 * x[0] <= -90 * s)[:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "CELLS", 256)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(8)], rng.choice([0, 1, 2, 2, 2])) for i in range(0, 1500, 5)]
    rows += [(7, [0.5] * 8, None), (9, None, 1), (None, [0.5] * 8, 1), (300, [0.1, None] + [0.2] * 6, 1), (11, [float("nan")] * 8, 1), (13, [float("inf")] * 8, 2)]
    rows += [(100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (102, [0.25, 0.5], 2), (200, [], 1), (201, [], 1), (202, [], 0)]  # other sizes
    rows += [(n, [0.25] * 8, 1) for n in (900, 900, 905, 905, 910)] + [(n, [0.125] * 8, 2) for n in (1, 1, 2, 3, 4)] + [(900, [0.2] * 8, 2)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    df = spark.createDataFrame([(1, [0.5], 1, 1, "x", "y")], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


# --- packing


def odd_texts():
    rng = random.Random(7)
    words = ["the", "Of", "it's", "l'Été", "naïve,", "x" * 60, "12.5", "áb", "H̱", "İ", "日本語", "🙂", "a\xa0b", "c\x1cd", "<|endoftext|>", "--", "don't."]
    return [None, "", " \n", "word", " lead and trail ", "word " * 30, *[rng.choice(" \t\n\x0b\r").join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]]


def placed_one_by_one(lengths, capacity):
    """Best-fit decreasing over single pieces: how full every sequence is."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100])
def test_best_fit_decreasing_on_histograms_equals_single_pieces(capacity):
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [min(capacity, 1 + int(capacity * rng.random() ** rng.choice([0.5, 1, 3]))) for _ in range(rng.choice([1, 10, 300]))]
        filled = defaultdict(list)
        ranges = packing.best_fit_decreasing(Counter(lengths), capacity)
        for length, count in Counter(lengths).items():
            own = [r for r in ranges if r.length == length]
            for rank in range(count):
                r = max((r for r in own if r.first <= rank), key=lambda r: r.first)
                nth = rank - r.first
                filled[r.sequence + nth // r.each].append((r.offset + length * (nth % r.each), length))
        left = []
        for parts in filled.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            left.append(capacity - end)
        assert sorted(left) == placed_one_by_one(lengths, capacity)


def test_pieces_and_places(spark):
    texts = odd_texts() * 2
    tok = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    tok.encode_special_tokens = True
    df = docs(spark, texts).withColumn("length", F.lit("clash")).withColumn("lot", F.lit("clash"))
    rows = packing.packed(df, capacity=128, ids=True).collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.start == len(whole[r.doc_id]) == 128 * r.piece and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
    assert whole == {i: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert sorted(128 - x for x in filled.values()) == placed_one_by_one([r.length for r in rows], 128)
    made = packing.sequences(spark.createDataFrame(rows)).collect()
    assert {s.sequence_id: len(s.ids) for s in made} == filled
    assert sum((s.ids[o : o + 1] for s in made for o in s.offsets), []) and sum(len(s.doc_ids) for s in made) == len(rows)


def test_packing_of_repeated_null_and_no_documents(spark):
    df = spark.createDataFrame([(None, None, "en", "s", None)] * 300 + [(5, "one two", None, "s", None)] * 3, DOCS)
    rows = packing.packed(df, capacity=16).collect()
    places = {(r.sequence_id, r.offset + i) for r in rows for i in range(r.length)}
    assert len(rows) == 303 and len(places) == sum(r.length for r in rows) == 309
    assert len({r.sequence_id for r in rows}) == 20
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_stretches_end_before_white_space():
    for t in odd_texts():
        raw = (t or "").encode()
        parts = list(packing.stretches(raw, 9))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    known = packing.Ids(vocabulary(packing.VOCABULARY))
    text = "a bb c dd a bb é ff gg a hh " + "z" * 100
    want = np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for _ in range(3):
        assert known.of(text) == want
        assert len(known) <= 3 and len(known.old) <= 3 and b"z" * 100 not in known


def test_new_words_are_encoded_together_and_once_whatever_their_case_and_marks():
    known = packing.Ids(vocabulary(packing.VOCABULARY))
    library, calls = known.tokenizer, []

    class Counting:
        def encode(self, text, **kw):
            calls.append(text)
            return library.encode(text, **kw)

    known.tokenizer = Counting()
    plain = "Ouanque, ouanque. (OUANQUE) don't Éaion éaion; 12 3.5 a\x1cb <|endoftext|> ß×"
    texts = [plain.replace("×", ""), plain, "E\u0301 H\u0331 \u0301x ΑΣ \u0130 ﬁ\xa0b a\x85b \u3000", "\x85 a", "", "ouanque: Éaion!"]
    for text in texts:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert known.of(text) == want == known.of(text)
    assert len(calls) <= 2 * len(texts) and known.splits
    assert calls[0].split().count("ouanque") == 1 and "ouanque" not in calls[-1]


# --- phrases


def counted(texts, langs):
    f = defaultdict(Counter)
    for t, lang in zip(texts, langs, strict=True):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    return f


def strongest(texts, langs, least, top):
    out = []
    for lang, f in counted(texts, langs).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and b >= least and 100 * b >= 50 * a for h, b in f.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, l, r, n, score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_texts():
    rng = random.Random(9)
    words = ["a", "b", "É", "É" + "x", "New", "york", "new", "York", "\x1c", "\x00", "of", "日", "🙂", "a\xa0b"]
    odd = [None, "", " \t", ".,;", "one", "one two", "a. b", "a\x0bb\x0cc"]
    return odd + ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(1, 120))) for _ in range(80)]


def test_phrases_equal_brute_force(spark):
    texts = phrase_texts()
    langs = [random.Random(i).choice(["en", "en", "de", None, "und"]) for i in range(len(texts))]
    df = docs(spark, texts, langs).withColumn("first", F.lit(1)).withColumn("phrase", F.lit(1))
    for top in (2000, 7):
        got = phrases.collocations(df, least=4, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == strongest(texts, langs, 4, top)


@pytest.mark.parametrize("words", [10, 1000])
def test_runs_of_bursting_and_spilling_tries(monkeypatch, words):
    """Containers burst at three entries, tries spill at forty, and the vocabulary is renewed beyond ``words``."""
    monkeypatch.setattr(phrases, "BURST", 3)
    monkeypatch.setattr(phrases, "stretches", lambda text: packing.stretches(text, 40))
    texts = phrase_texts()
    langs = [random.Random(i).choice(["en", "de"]) for i in range(len(texts))]
    counter = phrases.Counter(5, 40, 25, words)
    runs = [x for t, lang in zip(texts, langs, strict=True) for x in counter.read(lang, t or "")]
    assert len(runs) > 20
    got, places = defaultdict(Counter), {}
    for r in pa.Table.from_batches([*runs, *counter.rest()]).to_pylist():
        for entry in r["entries"].split("\n"):
            first, second, total, *tail = entry.split(" ")
            prefix = (first,) if second == "." else (first, second)
            assert places.setdefault((r["lang"], prefix), r["bucket"]) == r["bucket"]
            got[r["lang"]][prefix] += int(total)
            for third, n in zip(tail[::2], tail[1::2], strict=True):
                got[r["lang"]][(*prefix, third)] += int(n)
    assert len(set(places.values())) == 5
    assert got == counted(texts, langs)


def test_scores_pass_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 7, big + 1)], "a long, l long, r long")
    assert row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * big * big // ((big + 7) * (big + 1))


def test_phrases_of_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(docs(spark, [None, "", "."])).count() == 0
