"""Tokens, substrings, quality, duplicates: against brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voxelar.llm import bpe, exact_dedup, mixing, quality, sharding, simhash, substring_dedup
from voxelar.llm._common import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\x0b\x0c\r"


def docs(spark, texts, ids=None, **more):
    rows = [(i, t, "en", "s", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def odd_texts():
    rng = random.Random(5)
    words = ["the", "of", "a", "b", "Été", "naïve", "x" * 40, "l'été", "can't", "12", "3,4", " ", "日本", "🙂"]
    texts = [None, "", " ", "\n\n", "one", "it's  two\t\tthree \n x", "A" * 300, "🙂" * 50, " lead", "trail ", "a\x1cb"]
    return texts + [rng.choice(WS).join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(25)]


# --- byte-level BPE


def test_round_trip_of_ids_and_bytes(spark):
    enc = bpe.encoding(vocabulary(bpe.RANKS))
    texts = [*odd_texts(), "word and more words\n" * 9000, "x" * 70_000]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts, decoded="clash")).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pieces_are_cut_where_matches_start():
    enc = bpe.encoding(vocabulary(bpe.RANKS))
    for t in odd_texts():
        parts = list(bpe.pieces(t or "", 7))
        assert "".join(parts) == (t or "")
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t or "")


def test_long_white_space_is_matched_whole(spark, monkeypatch):
    """Against every match of the pattern, encoded one by one; the library alone fails on the long ones."""
    enc = bpe.encoding(vocabulary(bpe.RANKS))

    def by_match(text):
        return [i for m in regex.findall(bpe.PATTERN, text) for i in enc._encode_single_piece(m.encode())]

    for space in (" ", "\n", "\t", " \n", "\u00a0"):
        for text in (f"x{space * 5000}a", f"{space * 5000}", f"{space * 4096}!\n{space * 9000}", f"a{space * 4095}1 b"):
            assert bpe.encode_text(enc, text) == by_match(text) == enc.encode_ordinary(text)
    for space in (" ", "\n", "\t"):
        text = f"x{space * 5_000_000}a"
        ids = bpe.encode_text(enc, text)
        last = [" a"] if space == " " else [space, "a"]
        want = ["x", space * (5_000_000 - 1), *last]
        assert ids == [i for m in want for i in enc._encode_single_piece(m.encode())] and enc.decode(ids) == text
    rng = random.Random(1)
    monkeypatch.setattr(bpe, "RUN_CHARS", 3)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(bpe, "_RUN", re.compile(f"[{bpe._SPACE}]{{3,}}"))
    for _ in range(500):
        text = "".join(rng.choice([rng.choice(" \t\n\x85\u3000\u200b\x1c") * rng.randint(1, 7), "a", "1", "!", "'s", "é"]) for _ in range(12))
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_round_trip_of_odd_tables(spark):
    df = docs(spark, ["a b", "a b", None, "x"], ids=[None, None, 7, 7], ids_sha256="clash")
    got = sorted(map(str, bpe.round_trip(df).collect()))
    assert len(got) == 4 and len(set(got)) == 3 and sum("doc_id=None" in r for r in got) == 2
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_bytes_of_partial_ids_are_raw(spark):
    enc = bpe.encoding(vocabulary(bpe.RANKS))
    ids = enc.encode_ordinary("🙂")
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode(df).collect()] == [enc.decode_bytes(ids[:1]), None, b""]


# --- substring dedup


def cut_by_hand(rows):
    """Windows in order of id and place; rows that share an id share its place."""
    first, tokens = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in tokens:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def check_cut(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = substring_dedup.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == cut_by_hand(rows)


def test_substrings_by_hand(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n, v=vocab: " ".join(rng.choice(v) for _ in range(n))
    passage, other = text(55), text(23)
    rows = [(i, f"{text(rng.randint(0, 60))} {passage} {text(5)} {other if i % 3 else ''}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a " * 90), (103, "a " * 25 + "b " + "a " * 40), (104, "x y " * 60), (105, passage)]
    rows += [(106, text(200, ["p", "q"])), (107, text(19)), (108, text(20)), (109, f"{text(12)} " * 9)]
    rows += [(50, rows[3][1]), (51, rows[3][1].replace("w1 ", "zz "))]
    check_cut(spark, rows)
    for bits in (0, 5):  # forced collisions of keys
        check_cut(spark, rows, key_bits=bits)


def test_substrings_of_a_very_long_text(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(1_200_000))
    check_cut(spark, [(2, f"{long} {passage} {long[:5000]}"), (1, passage), (3, "x " + passage)])


def test_substrings_of_repeated_rows_and_ids(spark):
    text = " ".join(f"t{i}" for i in range(45))
    check_cut(spark, [(1, text), (1, text), (1, "lead " + text), (0, "x " + text), (7, text)])


def test_substrings_with_null_id_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (3, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()) == [(False, 30), (True, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equal_windows_determine_equal_symbols(levels):
    rng = np.random.default_rng(levels)
    words = np.append(np.append(np.uint64(0), rng.integers(1, 4, 4000).astype(np.uint64)), np.uint64(0))
    symbols = substring_dedup.parse(words, levels)
    seen = {}
    for s in range(1, len(words) - 20):
        inside = (symbols.low >= s) & (symbols.high <= s + 20)
        found = [(int(a) - s, int(n)) for a, n in zip(symbols.start[inside], symbols.names[inside], strict=True)]
        assert seen.setdefault(words[s : s + 20].tobytes(), found) == found


# --- quality


def quality_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_quality_counts_by_hand(spark):
    many = " ".join(f"{a} {b} {a}" for a in "abcdefgh" for b in "xyz") + "\n"
    texts = [*odd_texts(), "a b c a b c a", "a a a a", "#*$%&|<> x\n#*$%&|<> x\n \n\n", many * 3, " ".join(f"u{i}" for i in range(400))]
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_rules(docs(spark, texts, words="clash", kept="clash")).collect()}
    assert got == {i: quality_by_hand(t) for i, t in enumerate(texts)}


def test_quality_drops_divergent_texts_only(spark):
    rng = random.Random(3)
    common = quality.COMMON_WORDS["en"].split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 10**6):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(200))
    good = [prose() for _ in range(30)]
    bad = [" ".join(f"{w.upper()}!!" for w in prose().split()), " | ".join(f"c{rng.randint(0, 10**9)}" for _ in range(200)), "$$$ ".join(prose().split())]
    kept = {r.doc_id for r in quality.quality_rules(docs(spark, good + bad)).where("kept").collect()}
    assert kept == set(range(30))
    back = quality.keep_good(docs(spark, good + bad + good[:1]))
    assert back.count() == 31 and back.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert quality.quality_rules(docs(spark, [])).count() == 0


# --- exact dedup


def test_quality_stage_of_null_ids_and_languages(spark):
    good, rows = " ".join(f"word{i}" for i in range(60)), "doc_id long, text string, lang string, words string"
    table = [(None, good, None, "a"), (None, good, None, "b"), (1, good, "en", None), (1, "short", "en", "c"), (2, None, None, None), (3, "", "xx", "d")]
    kept = quality.keep_good(spark.createDataFrame(table, rows))
    assert kept.columns == ["doc_id", "text", "lang", "words"]
    assert sorted(kept.collect(), key=str) == sorted(spark.createDataFrame(table[:3], rows).collect(), key=str)
    assert quality.keep_good(spark.createDataFrame([], rows)).count() == 0


def test_exact_groups_by_hand(spark):
    texts = ["A b", "a B", None, "", "É", "é", "a b", "x"] + ["hot"] * 40
    df = docs(spark, texts, digest="clash", row="clash").repartition(3)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(t or "").translate(low) for t in texts]
    for share in (0.001, 0.2):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, share=share).collect()}
        want = {i: (max(j for j, m in enumerate(norm) if m == n), norm.count(n)) for i, n in enumerate(norm)}
        assert got == {i: (k, n, k == i) for i, (k, n) in want.items()}
    kept = exact_dedup.drop_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in want.values()}) and kept.columns == df.columns


def test_exact_keeps_one_of_repeated_rows(spark):
    df = docs(spark, ["t", "t", "t", "u"], ids=[5, 5, None, None])
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got} == {5, None}
    assert exact_dedup.drop_duplicates(df).count() == 2
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# --- SimHash


def components(fps, distance=2):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    grams = [b" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_hand(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(900)]
    texts = odd_texts() + [" ".join(base[:i] + ["edit"] + base[i:]) for i in range(0, 200, 10)] + ["A B", "a b", "a b c"]
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    roots = components(fps)
    got = simhash.simhash_groups(docs(spark, texts, fp="clash")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("node_rows", [4096, 20])
def test_links_connect_what_is_near(spark, node_rows):
    rng = np.random.default_rng(4)
    fps = {int(f) for f in rng.integers(0, 1 << 63, 50)}
    for f in list(fps)[:20]:
        for _ in range(30):
            fps.add(f := f ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = components({f: f for f in fps})
    from voxelar.plans.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(df, 2, node_rows)).collect()}
    assert {f: got.get(f, f) for f in fps} == root


def test_fingerprints_of_two_bits_pair_documents(spark):
    """The near-duplicate stage compares what fingerprints link, whatever bands its samples share."""
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = [f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5]))) for f in base for _ in range(4)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "rid long, fp long")
    pairs = [tuple(r) for r in simhash.fingerprint_pairs(rows).collect()]
    assert all(a < b for a, b in pairs)
    root = list(range(len(fps)))
    for near in (pairs, [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]):
        label = root[:]
        for _ in range(len(fps)):
            for a, b in near:
                label[a] = label[b] = min(label[a], label[b])
        if near is pairs:
            found = label
    assert found == label
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(3)]
    texts.append(texts[0] + " one")
    held = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "rid long, text binary")
    assert {r.fp for r in simhash.band_fingerprints(held, 5).collect()} != {0}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    texts, gone = [], set()
    for g in range(25):
        n = rng.choice([60, 300, 1500])
        base = fresh(n)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(n // 100 + 1):
                copy[rng.randrange(n)] = "edit"
            gone.add(len(texts))
            texts.append(" ".join(copy))
        half = base[: n // 2] + fresh(n // 2)  # a third or so of its shingles are shared: no copy
        texts.append(" ".join(half))
    texts += ["", None, "few words", "few words"]
    gone.add(len(texts) - 1)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts, rid="clash")).collect()}
    assert kept == set(range(len(texts))) - gone


def near_groups(texts, similarity=0.8):
    """Brute-force components over the similarities of all pairs."""
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("shared", [0, 270])
def test_near_copies_of_one_original_and_of_one_passage(spark, shared):
    """Copies that are near the original but not each other; true pairs among texts with a long passage in common."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    passage = fresh(shared)
    texts = []
    for _ in range(60 if shared else 1):
        base = passage + fresh(60 if shared else 300)
        copies = [list(base) for _ in range(2 if shared else 300)]
        for copy in copies:
            for at in rng.sample(range(len(base)), 5):
                copy[at] = fresh(1)[0]
        texts += [" ".join(t) for t in (base, *copies)]
    rng.shuffle(texts)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == near_groups(texts)


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_prefix_pairs_miss_none(spark, block_rows):
    rng = random.Random(5)
    sets = [set(rng.sample(range(40), 20)) for _ in range(5)]
    sets += [set(list(s)[: rng.randint(16, 20)]) | {rng.randrange(60)} for s in sets for _ in range(12)]
    rows = [(i, i % 7, sorted(s)) for i, s in enumerate(sets)]
    got = simhash.prefix_pairs(spark.createDataFrame(rows, "rid long, component long, shingles array<long>"), 0.8, block_rows).collect()
    assert len(got) == len(set(got)) and all(r.a < r.b and r.a % 7 != r.b % 7 for r in got)
    near = {(i, j) for j in range(len(sets)) for i in range(j) if i % 7 != j % 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near and near <= {(r.a, r.b) for r in got}


def test_prefix_pairs_leave_out_what_differs_too_much(spark):
    """Sets of one family share rare shingles at a similarity near 0.6; only what is planted nearer is compared."""
    rng = random.Random(9)
    core = [rng.getrandbits(63) for _ in range(150)]
    sets = [set(core) | {rng.getrandbits(63) for _ in range(50)} for _ in range(80)]
    sets += [set(sorted(s)[:-5]) | {rng.getrandbits(63) for _ in range(5)} for s in sets[:20]]
    rows = [(i, i, sorted(s)) for i, s in enumerate(sets)]
    got = simhash.prefix_pairs(spark.createDataFrame(rows, "rid long, component long, shingles array<long>"), 0.8).collect()
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(near) == 20 and {(r.a, r.b) for r in got} == near


def test_near_stage_keeps_one_of_each_group_of_the_given_documents(spark):
    """Recall over all pairs of the table: components at 0.8 by brute force, one document kept of each."""
    rows = [(r.doc_id, (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets, holders, root = {}, {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for j in {j for s in sets[i] for j in holders.get(s, ())}:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id").collect()]
    assert pairs > 50 and sorted(kept) == sorted(i for i in root if find(i) == i)


def test_near_stage_of_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, [text, text, text, "other words", text], ids=[None, None, 4, None, 4])
    assert sorted(str(r.doc_id) + r.text[:5] for r in simhash.drop_near_duplicates(df).collect()) == ["Noneother", "Nonew0 w1"]
    got = simhash.simhash_groups(df).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {None}


# --- sharding and mixing


def test_table_shares_and_stability():
    table = sharding.fill(list(range(10)), 1009)
    counts = [table.count(s) for s in range(10)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(list(range(9)), 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9) < 0.1 * 1009
    for bad in ((1, 2, 3), 1008), ((), 7):
        with pytest.raises(ValueError):
            sharding.fill(list(bad[0]), bad[1])


def test_turns_by_hand():
    shards, m = [0, 1, 2], 7
    prefer = {s: [(sharding._digest("offset", s) % m + j * (sharding._digest("step", s) % (m - 1) + 1)) % m for j in range(m)] for s in shards}
    table, turn = {}, 0
    while len(table) < m:
        s = shards[turn % 3]
        table[next(x for x in prefer[s] if x not in table)] = s
        turn += 1
    assert sharding.fill(shards, m) == [table[i] for i in range(m)]


def test_placement_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, slot string")
    got = sharding.place(df, "doc_id").collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def raked(spark, rows, shares, keep):
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame(list(m.items()), f"{d} string, target double") for d, m in shares.items()}
    goals = {d: mixing.attainable(cells, t, d, keep) for d, t in targets.items()}
    fitted = mixing.rake(cells, goals)
    report = {(r.dimension, r.value): r for r in mixing.marginals(fitted, goals).collect()}
    return fitted.toPandas(), report


def test_raking_meets_the_marginals(spark):
    rng = random.Random(1)
    rows = [(s, lang, t, rng.randint(300, 1000)) for s in "abc" for lang in "xy" for t in "uvw"]
    shares = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"u": 0.3, "v": 0.3, "w": 0.4}}
    fitted, report = raked(spark, rows, shares, 0.3)
    for d, m in shares.items():
        for v, share in m.items():
            r = report[d, v]
            assert abs(r.reached - share) < 1e-4 and abs(r.goal - share) < 1e-9 and r.target == share
    assert abs(fitted.kept.sum() / fitted.tokens.sum() - 0.3) < 1e-4 and (fitted.kept <= fitted.tokens).all()


def test_what_rare_cells_cannot_give_goes_to_others(spark):
    rng = random.Random(2)
    rows = [(s, lang, t, rng.randint(1, 40) if "r" in (s, lang) else rng.randint(900, 2000)) for s in "abr" for lang in "xyr" for t in "uv"]
    shares = {"source": {"a": 0.5, "b": 0.3, "r": 0.2}, "lang": {"x": 0.6, "y": 0.3, "r": 0.1}, "topic": {"u": 0.5, "v": 0.5}}
    fitted, report = raked(spark, rows, shares, 0.6)
    has = fitted.groupby("source").tokens.sum()
    total = fitted.tokens.sum()
    assert (fitted.kept <= fitted.tokens + 1e-9).all() and abs(fitted.kept.sum() / total - 0.6) < 1e-4
    # The rare source gives all it may; the others share what it lacks as 5 to 3.
    rare = mixing.CEILING * has["r"] / total / 0.6
    assert abs(report["source", "r"].reached - rare) < 1e-4
    assert abs(report["source", "a"].reached - (1 - rare) * 5 / 8) < 1e-4
    assert abs(report["topic", "u"].reached - 0.5) < 1e-4 and all(abs(r.reached - r.goal) < 1e-4 for r in report.values())
    # Goals that contradict each other: every x is u and every y is v.
    fitted, report = raked(spark, [("a", "x", "u", 100), ("a", "y", "v", 100)], {"lang": {"x": 0.5, "y": 0.5}, "topic": {"u": 0.8, "v": 0.2}, "source": {"a": 1.0}}, 0.5)
    assert max(abs(r.reached - r.goal) for r in report.values()) > 0.1


def test_goals_of_values_without_target_or_tokens(spark):
    fitted, report = raked(spark, [("a", "x", "u", 100), ("b", "x", "u", 100), ("b", "x", "v", 0)], {"source": {"a": 0.5, "z": 0.5}, "lang": {"x": 1.0}, "topic": {"u": 1.0}}, 0.2)
    assert report["source", "b"].reached == 0 and report["source", "a"].reached == 1 and ("source", "z") not in report


def test_sampling_follows_the_probabilities(spark):
    texts = [" ".join(["w"] * 50)] * 3000
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 2500, "big").otherwise("small")).withColumn("tokens", F.lit("clash"))
    got = mixing.mix(df).groupBy("source").agg(F.avg(F.col("selected").cast("int")).alias("kept"), F.max("probability").alias("p")).collect()
    assert all(abs(r.kept - r.p) < 0.06 for r in got) and len({r.p for r in got}) == 2
    sampled = mixing.sample(df)
    assert sampled.columns == df.columns and sampled.count() == mixing.mix(df).where("selected").count()
    odd = docs(spark, ["a b"] * 4, ids=[None, None, 1, 2]).withColumns({c: F.when(F.col("doc_id") != 1, F.lit("s")) for c in ("source", "lang")})
    rows = mixing.mix(odd).collect()
    assert len(rows) == 4 and {r.source for r in rows} == {"", "s"} and len({r.selected for r in rows if r.doc_id is None}) == 1
    assert mixing.sample(odd).count() == sum(r.selected for r in rows)
    assert mixing.mix(docs(spark, [None, ""])).where("selected").count() == 2 and mixing.mix(docs(spark, [])).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    common = quality.COMMON_WORDS["en"].split()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    prose = lambda n=120: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    good = [prose() for _ in range(40)]
    near = good[0].split()
    near[60] = "edit"
    texts = [*good, good[1].upper().lower(), " ".join(near), "short", None, "|| ".join(prose().split())]
    path = f"{tmp_path}/documents.parquet"
    docs(spark, texts).write.parquet(path)
    seen = spark.read.parquet(path)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        seen.write.parquet(f"{tmp_path}/{len(counts)}")
        seen = spark.read.parquet(f"{tmp_path}/{len(counts)}")
        assert seen.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append({r.doc_id for r in seen.select("doc_id").collect()})
    assert counts[0] == set(range(42))
    assert counts[1] == set(range(42)) - {1}
    assert counts[2] == set(range(42)) - {1, 41}
    assert counts[3] <= counts[2]
    final = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: hashlib.sha256(texts[i].encode()).hexdigest() for i in counts[3]}


def test_copies_of_one_text_are_not_one_task(spark):
    """Nine tenths of all rows have one fingerprint; it is no shuffle key."""
    texts = ["the same words again and again for all of these rows" if i % 10 else f"own {i} words {i * 7} of {i * 13} this {i * 31} row" for i in range(3000)]
    got = simhash.simhash_groups(docs(spark, texts))
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2000
    assert got.where("component_id = 1").count() == 2700
