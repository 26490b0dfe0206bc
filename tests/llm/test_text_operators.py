import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, components, documents, words
from tidebook.llm import blocks, bpe, pitman_yor, quality, simhash, substring, text

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes_follow_the_bytes():
    texts = [r[1] for r in documents()]
    data, offsets = text.buffer(pa.array(texts))
    starts, ends, first = text.words(data, offsets)
    expected = [words(t) for t in texts]
    raw = data.tobytes()
    assert [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)] == expected
    folded = text.hash_spans(data, starts, ends, True)
    flat = [w for t in texts for w in words(t, True)]
    by_word = defaultdict(set)
    for w, h in zip(flat, folded.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len(set(folded.tolist())) == len(set(flat))


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    data, offsets = text.buffer(pa.array(["one two three four five six seven", "eight nine"]))
    starts, ends, _ = text.words(data, offsets)
    whole = text.hash_spans(data, starts, ends, False)
    monkeypatch.setattr(text, "PIECE", 4)
    assert (text.hash_spans(data, starts, ends, False) == whole).all()


def slow_fingerprint(t):
    w = words(t, True)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components_match_brute_force(docs):
    rows = documents()
    f = [slow_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    root = components(len(rows), links)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root[i]].append(r[0])
    expected = sorted((str(r[0]), f"{f[i]:016x}", str(min(low[root[i]], default=None))) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


def test_simhash_links_close_fingerprints_and_splits_hot_anchors(spark):
    r = np.random.Generator(np.random.PCG64(3))
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    near = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (60, 2))} | {int(b) for b in base}
    values = np.array(sorted(near), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "f long")
    expected = components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2])
    for most in (4096, 16):
        links = simhash.linked(frame, 2, most).collect()
        place = {int(v): k for k, v in enumerate(values.view(np.int64))}
        got = components(len(values), [(place[x.a], place[x.b]) for x in links])
        assert got == expected


@pytest.mark.parametrize(("most", "finer"), [(4096, 1 << 28), (4096, 0), (20, 1 << 28), (20, 0)])
def test_simhash_links_are_those_of_all_pairs(spark, most, finer):
    r = np.random.Generator(np.random.PCG64(5))
    base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    flips = [np.uint64(0)] + [np.uint64(sum(1 << int(b) for b in r.choice(64, n, replace=False))) for n in (1, 2, 2, 3, 4) for _ in range(12)]
    f = np.unique(np.concatenate([base] + [base[:6] ^ x for x in flips] + [base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    expected = components(len(f), zip(*np.nonzero(near), strict=True))
    frame = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long")
    place = {int(x): k for k, x in enumerate(f.view(np.int64))}
    links = [(place[x.a], place[x.b]) for x in simhash.linked(frame, 2, most, finer).collect()]
    got = components(len(f), links)
    same = lambda c: {frozenset(k for k in range(len(c)) if c[k] == x) for x in set(c)}
    assert same(got) == same(expected) and len(same(got)) < len(f)


def test_fingerprints_that_agree_nearly_share_a_free_part():
    r = np.random.Generator(np.random.PCG64(6))
    f = r.integers(0, 1 << 62, 500, dtype=np.uint64)
    for bits in (1, 2):
        other = f ^ np.array([sum(1 << int(b) for b in r.choice(64, bits, replace=False)) for _ in f], np.uint64)
        assert (simhash.free_keys(f, 2) == simhash.free_keys(other, 2)).any(1).all()


def test_anchor_tables_cover():
    patterns, first, upto = simhash.coset_table()
    assert len(patterns) == sum(math.comb(23, w) for w in range(9))
    assert (upto[:, 3] == 1).all()  # a perfect code: one code word within its radius
    assert (simhash.syndrome(patterns) == np.repeat(np.arange(2048), upto[:, -1])).all()


def test_one_document_of_each_near_group_stays(spark):
    base = " ".join(f"w{i * i % 97}q{i}" for i in range(150))
    changed = base.replace("w1q1 ", "other ")
    rows = [(5, base, "en", "a", 1), (2, changed, "en", "b", 1), (9, base.upper(), "en", "a", 1), (9, base.upper(), "en", "a", 1), (7, "something else entirely " * 9, "en", "a", 1), (8, None, None, None, None), (11, "", "en", "a", 0), (None, "lonely text without id", "en", "a", 1)]
    out = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "7", "8", "None"]


def cut_and_extended(n, similarity):
    """(original, copies): texts of 150 words, each with a copy cut short and one with another text appended, so similar."""
    r = np.random.Generator(np.random.PCG64(11))
    texts = [[f"w{min(int(x), 5000)}" for x in r.zipf(1.3, 150)] for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = []
    for k, w in enumerate(texts):
        for grow in (False, True):
            for m in range(60, 0, -1):
                v = w + texts[k - 1][:m] if grow else w[:-m]
                a, b = shingles(w), shingles(v)
                if len(a & b) >= similarity * len(a | b):
                    out.append((" ".join(w), " ".join(v)))
                    break
    return out


def test_near_duplicates_are_found_where_the_differing_words_lie_together(spark):
    pairs = cut_and_extended(100, 0.84)
    rows = [(10 * k + j, " ".join(f"p{k}{w}" for w in t.split()), "en", "a", 1) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).count()
    assert kept <= 1.04 * len(pairs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_near_duplicates_of_a_whole_table_match_brute_force(spark):
    """Every document that goes is linked to a kept one by pairs of similarity 0.8; nearly all that are linked go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, words(r.text, True)) for r in docs.select("doc_id", "text").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    holds = defaultdict(list)
    for k, shingles in enumerate(sets):
        for x in shingles:
            holds[x].append(k)
    common = Counter((a, b) for at in holds.values() for i, a in enumerate(at) for b in at[i + 1 :])
    empty = [k for k, (_, w) in enumerate(rows) if not w]
    links = [(a, b) for (a, b), n in common.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))] + list(zip(empty, empty[1:]))
    of = components(len(rows), links)
    lowest = {c: min(rows[k][0] for k in range(len(rows)) if of[k] == c) for c in set(of)}
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert set(lowest.values()) <= kept
    gone, linked = len(rows) - len(kept), len(rows) - len(lowest)
    assert linked >= 50 and gone >= 0.98 * linked


@pytest.mark.parametrize("most", [simhash.SHINGLES, 2000])
def test_similar_sets_are_compared_in_chunks(spark, most):
    """A component of many texts, dealt to several chunks, and texts that only sketches join."""
    r = np.random.Generator(np.random.PCG64(4))
    base = [f"w{x}" for x in r.integers(0, 900, 120)]
    texts = []
    for k in range(40):
        w = list(base)
        for at in r.choice(120, 1 + k % 4, replace=False):
            w[at] = f"other{k}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    expected = components(40, [(a, b) for a in range(40) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    rows = spark.createDataFrame([(7, k, bytearray(96), t) for k, t in enumerate(texts)] + [(8, 100, bytearray(96), "alone")], "component long, node long, keys binary, text string")
    got = components(40, [(x.a, x.b) for x in simhash.compared(rows, most).collect()])
    same = lambda c: {frozenset(k for k in range(len(c)) if c[k] == x) for x in set(c)}
    assert same(got) == same(expected)
    assert not simhash.similar(np.arange(9, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)) and simhash.similar(np.arange(9, dtype=np.uint64), np.arange(10, dtype=np.uint64))


def test_less_similar_texts_stay_and_repeats_count_once(spark):
    pairs = cut_and_extended(60, 0.7)
    rows = [(10 * k + j, " ".join(f"p{k}{w}" for w in t.split()), "en", "a", 1) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    assert simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).count() == 2 * len(pairs)
    bases = [" ".join(f"t{k}{w}" for w in p[0].split()) for k, p in enumerate(cut_and_extended(60, 0.9)[::2])]
    rows = [(10 * k + j, t, "en", "a", 1) for k, b in enumerate(bases) for j, t in enumerate((b, b + " all rights are reserved" * 9))]
    assert simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).count() == len(bases)


def test_empty_tables_give_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert bpe.encode(none, VOCABULARY, decoded="d").count() == 0
    assert quality.scored(none, None).count() == 0


def test_bpe_equals_the_library(docs):
    library = Tokenizer.from_file(VOCABULARY)
    got = bpe.digests(bpe.encode(docs.withColumnRenamed("lang", "ids"), VOCABULARY, decoded="source"), "doc_id", decoded="source").collect()
    expected = []
    for r in documents():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)


def test_bpe_odd_texts_and_decoding(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["", " ", "<|endoftext|>x<|startoftext|>", "İSTANBUL ΣΑΣ", "aaaa aaaaa", "!" * 300, "I'm we'll 'S", "日本 🙂", "ab" * 900, "é", "é ́x", "a b", "x\x1cy", None]
    encoder = bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    ids, first = encoder(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    frame = bpe.decode_column(spark.createDataFrame([([320, 49407],), (None,)], "ids array<int>"), VOCABULARY)
    assert [r.decoded for r in frame.collect()] == [library.decode([320, 49407], skip_special_tokens=False), ""]


def test_bpe_memory_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = pa.array([r[1] for r in documents(20)])
    small, big = bpe.Encoder(bpe.Vocabulary.read(VOCABULARY)), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    for i in range(0, len(texts), 4):
        a, b = small(texts.slice(i, 4)), big(texts.slice(i, 4))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_bpe_tells_runs_apart_by_their_bytes():
    """The two Thue-Morse words have equal polynomial hashes modulo 2 ** 64."""
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    other = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(other)
    texts = [word, word.translate(other), f"{word} {word.translate(other)}"]
    ids, first = encoder(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["a", "ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"])
def test_bpe_long_words_have_rounds_of_their_own(letters, monkeypatch):
    library, vocabulary = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary.read(VOCABULARY)
    r = np.random.Generator(np.random.PCG64(3))
    word = "".join(r.choice(list(letters), 6000))
    expected = library.encode(word, add_special_tokens=False).ids
    assert vocabulary.merge_long(word.encode()).tolist() == expected
    ids, first = vocabulary.merge([b"the", word.encode(), b"of", word.encode()])
    assert ids[first[1] : first[2]].tolist() == ids[first[3] :].tolist() == expected and ids[first[2] : first[3]].tolist() == library.encode("of", add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PIECE", 50)
    text = f"a few words before {word} and a few behind it, then {'more ' * 30}"
    ids, _ = bpe.Encoder(vocabulary)(pa.array(["x y", text, None, "z"]))
    assert ids.tolist() == [i for t in ("x y", text, "z") for i in library.encode(t, add_special_tokens=False).ids]


def slow_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, gone = set(), defaultdict(set)
    for k in order:
        w = words(rows[k][1])
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[k].update(range(i, i + length))
            seen.add(key)
    out = []
    for k, r in enumerate(rows):
        w = words(r[1])
        out.append((str(r[0]), len(w), len(gone[k]), b" ".join(x for i, x in enumerate(w) if i not in gone[k]).decode()))
    return sorted(out)


def test_passages_of_words_whose_polynomial_hashes_clash(spark):
    """Two Thue-Morse words of 1024 letters have one polynomial hash; passages that differ in them alone differ."""
    word, other = "a", str.maketrans("ab", "ba")
    for _ in range(10):
        word += word.translate(other)
    around = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join([*around[:15], w, *around[15:]])) for k, w in enumerate((word, word.translate(other), word))]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[k].spans) for k in range(3)] == [0, 0, 1] and got[2].kept == ""
    with pytest.raises(TypeError, match="whole number"):
        substring.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("length", [20, 7])
def test_repeated_passages_match_brute_force(docs, length):
    got = substring.remove_repeats(docs, length=length).collect()
    assert sorted((str(r.doc_id), r.n_words, sum(s.to - s["from"] for s in r.spans), r.kept) for r in got) == slow_repeats(documents(), length)


def test_repeated_passages_over_many_blocks_and_buckets(docs, monkeypatch):
    from tidebook.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK", 400)
    monkeypatch.setattr(blocks, "BUCKET", 300)
    got = substring.remove_repeats(docs, length=8).collect()
    assert sorted((str(r.doc_id), r.n_words, sum(s.to - s["from"] for s in r.spans), r.kept) for r in got) == slow_repeats(documents(), 8)


def test_quality_scores_and_held_out_accuracy(spark):
    clean = [(k, f"the clean number{k} story of day{k % 13} goes on and ends well. it was kind{k % 7}.", "en", "s", 1) for k in range(200)]
    junk = [(1000 + k, f"BUY$$$ now### {'spam ' * (5 + k % 9)} %%% !!!", "en", "s", 1) for k in range(200)]
    rows = clean + junk + [(5000, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in clean + junk] + [(3, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    out = quality.scored(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum((r.score >= 0.5) == (r.doc_id < 1000) for r in held) == len(held)
    again = quality.scored_statistics(quality.with_statistics(docs, "text", "doc_id"), model).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in out}


def test_quality_statistics_are_plain_counts():
    texts = ["", None, "One two two, THREE 4 & a | b! $5 über\nline", "the the the of and", "x" * 50, " \t ", "Ends. Ends! Ends? #tag 100%"]
    got = quality.statistics(pa.array(texts))
    assert got.shape == (len(texts), len(quality.NAMES))
    of = lambda name: got[:, quality.NAMES.index(name)]
    for k, t in enumerate(texts):
        data, w = (t or "").encode(), [x.lower() for x in words(t)]
        some, count = max(len(w), 1), lambda name: sum(b in set(quality.CLASSES[name]) for b in data)  # noqa: B023
        letters = max(1, count("upper") + count("lower") + count("wide"))
        expected = {
            "words": math.log1p(len(w)), "length": math.log1p((len(data) - len(w)) / some), "upper": math.sqrt(count("upper") / letters), "digit": math.sqrt(count("digit") / max(len(data), 1)),
            **{n: math.sqrt(count(n) / some) for n in ("stop", "loud", "bar", "sign", "line")}, "same": math.sqrt(sum(a == b for a, b in zip(w, w[1:])) / some),
            "distinct": math.log1p(len(set(w))) / math.log1p(max(len(w), 1)), "busiest": math.sqrt(max(max(Counter(w).values(), default=0) - 1, 0) / some),
        }
        for name, value in expected.items():
            assert abs(of(name)[k] - value) < 1e-12, (t, name)


def test_quality_learns_from_a_bounded_share(spark):
    """Clashing columns are not read; a share of the labels gives a model like that of all."""
    rows = [(k, f"the clean number{k} story of day{k % 13} goes on and ends well." if k % 2 else f"BUY$$$ now### {'spam ' * (5 + k % 9)} %%%") for k in range(600)]
    docs = spark.createDataFrame([(*r, 9, "x", 0.0) for r in rows], "doc_id long, text string, quality int, x string, _x double")
    labels = spark.createDataFrame([(k, k % 2, 0, "t") for k, _ in rows], "doc_id long, quality int, toxic int, text string")
    every, some = quality.learn(docs, labels), quality.learn(docs, labels, most=150)
    assert every is not None and some is not None and not np.allclose(every.mean, some.mean)
    assert np.allclose(every.mean, quality.learn(docs, labels, most=10_000).mean)
    for model in (every, some):
        assert all((r.s >= 0.5) == (r.doc_id % 2 == 1) for r in quality.scored(docs, model, score="s").collect())


def test_quality_without_both_classes(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}


def test_quadratic_scores_are_density_ratios():
    r = np.random.Generator(np.random.PCG64(5))
    x = [r.normal(0, 1, (500, 3)), r.normal(1, 2, (300, 3))]
    m = quality.Quadratic.fit(np.array([500.0, 300.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0)
    at = r.normal(0.5, 1, (20, 3))
    density = []
    for k in range(2):
        c = np.cov(x[k].T, bias=True)
        d = at - x[k].mean(0)
        density.append(len(x[k]) / 800 * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c)))
    assert np.allclose(m.score(at), density[1] / (density[0] + density[1]))


def test_language_model_counts_and_base(spark, docs):
    from pyspark.sql import functions as F

    rows = documents()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [[*words(r[1], True), b"\n"] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r[0]) for w in t)
    n, v = sum(count.values()), len(count)
    expected = sorted((str(r[0]), held(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    out = pitman_yor.scores(docs, ~quality.apart(F.col("doc_id"), 7, 2)).collect()
    assert sorted((str(r.doc_id), not r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    again = pitman_yor.scores(docs, ~quality.apart(F.col("doc_id"), 7, 2)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in out)


def test_language_model_follows_the_predictive_formula(spark):
    """A corpus of one sentence leaves nothing to draw: every dish has one customer."""
    from pyspark.sql import functions as F

    s, d, v = 1.0, 0.95, 5  # four words and the end, each dish alone in its restaurants
    rows = [(0, "a b c D", "", "", 0), (100, "a b c d", "", "", 0), (101, "a z q", "", "", 0), (102, "c", "", "", 0)]
    out = {r.doc_id: r for r in pitman_yor.scores(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 100).collect()}
    base, never = 2 / (5 + 6), 1 / (5 + 6)
    root = lambda x, c: (c * (1 - d) + (s + d * v) * x) / (s + v)
    one = lambda x, c: (c * (1 - d) + (s + d) * x) / (s + 1)  # noqa: E731, a restaurant of one customer
    assert abs(v * root(base, 1) + root(never, 0) - 1) < 1e-12
    seen = one(one(root(base, 1), 1), 1)
    unseen, unknown = one(one(root(base, 1), 0), 0), one(one(root(never, 0), 0), 0)
    assert abs(out[0].score - 5 * math.log10(seen)) < 1e-5 and abs(out[100].score - out[0].score) < 1e-12
    # z follows a context of one customer; q and the end follow an unknown word
    assert abs(out[101].score - math.log10(seen * unknown * never * base)) < 1e-5
    assert abs(out[102].score - math.log10(unseen * root(base, 1))) > 1e-3 and abs(out[102].score - math.log10(unseen) - math.log10(one(root(base, 1), 0))) < 1e-5
    assert abs(out[100].perplexity - 10 ** (-out[100].score / 5)) < 1e-9


class OneByOne:
    """The same restaurants with lists of tables, one customer at a time: a plain Gibbs sampler."""

    def __init__(self, base, discounts, strength, random):
        self.base, self.discounts, self.strength, self.random = base, discounts, strength, random
        self.rooms = {}

    def room(self, context):
        return self.rooms.setdefault(context, {})

    def share(self, context, w):
        d = self.discounts[len(context)]
        room = self.room(context)
        tables = room.get(w, [])
        above = self.share(context[1:], w) if context else self.base[w]
        return (sum(tables) - d * len(tables) + (self.strength + d * sum(map(len, room.values()))) * above) / (self.strength + sum(map(sum, room.values())))

    def add(self, context, w):
        d = self.discounts[len(context)]
        room = self.room(context)
        tables = room.setdefault(w, [])
        above = self.share(context[1:], w) if context else self.base[w]
        weights = [x - d for x in tables] + [(self.strength + d * sum(map(len, room.values()))) * above]
        k = self.random.choices(range(len(weights)), weights)[0]
        if k < len(tables):
            tables[k] += 1
        else:
            tables.append(1)
            if context:
                self.add(context[1:], w)

    def remove(self, context, w):
        tables = self.room(context)[w]
        k = self.random.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            if context:
                self.remove(context[1:], w)


def test_seating_agrees_with_a_plain_sampler():
    """Predictive probabilities, averaged over many seatings, of the sampler here and of one that seats one by one."""
    r = np.random.Generator(np.random.PCG64(2))
    seen = Counter((int(r.integers(0, 2)), int(r.integers(2, 4)), int(min(9, 4 + r.geometric(0.4)))) for _ in range(120))
    triples = sorted((v, w, u) for u, v, w in seen)
    v, w, u = (np.array(x, np.int64) for x in zip(*triples, strict=True))
    count = np.array([seen[b, a, c] for a, c, b in triples], np.int64)
    word = np.unique(w)
    base = np.full(len(word), 0.8 / len(word))
    model = pitman_yor.Model(v, w, u, count, word, base, 1.0, np.random.Generator(np.random.PCG64(3)))
    discounts = [model.root.discount, model.middle.discount, model.leaves.discount]
    got = model.shares(50, 1500)
    plain = OneByOne(dict(zip(word.tolist(), base.tolist(), strict=True)), discounts, 1.0, random.Random(4))
    everyone = [((b, a), c) for a, c, b in triples for _ in range(seen[b, a, c])]
    for guest in everyone:
        plain.add(*guest)
    expected = np.zeros(len(triples))
    for k in range(650):
        for guest in everyone:
            plain.remove(*guest)
            plain.add(*guest)
        if k >= 50:
            expected += [plain.share((b, a), c) for a, c, b in triples]
    assert np.abs(got / (expected / 600) - 1).max() < 0.03


def test_a_sweep_seats_all_customers():
    """One sweep brings dishes from one table, or from a table for each customer, towards the tables that belong there."""
    rest, none = np.arange(200), np.zeros(0, np.int64)

    def tables(c: int, strength: float, sweeps: int, seed: int) -> float:
        count = np.full(len(rest), c)
        level = pitman_yor.Level(rest, none, count, None, np.full(len(rest), 0.5), strength, 0.5, np.random.Generator(np.random.PCG64(seed)))
        level.open(count)
        level.strength, means = 20.0, []
        for _ in range(sweeps):
            level.sweep()
            means.append(level.t.mean())
        return float(np.mean(means[sweeps // 2 :]))

    for c in (2, 3, 12, 40):
        expected = tables(c, 20.0, 40, 1)
        few, many = tables(c, -0.49, 1, 2), tables(c, 1e9, 1, 3)
        assert 0.4 < few / expected < 1.1 and 0.9 < many / expected < 1.3


def test_seating_keeps_its_books():
    """Customers stay, tables hold them, and every table is a customer of the parent, through sweeps and large counts."""
    r = np.random.Generator(np.random.PCG64(5))
    triples = sorted({(int(r.integers(2, 6)), int(r.integers(2, 40)), int(r.integers(0, 9))) for _ in range(600)})
    v, w, u = (np.array(x, np.int64) for x in zip(*triples, strict=True))
    count = r.choice([0, 1, 2, 3, 7, 5000], len(v), p=[0.2, 0.4, 0.2, 0.1, 0.09, 0.01])
    word = np.unique(w)
    m = pitman_yor.Model(v, w, u, count, word, np.full(len(word), 1 / (len(word) + 1)), 1.0, r)
    m.leaves.open(count)
    for _ in range(4):
        for level in (m.leaves, m.middle, m.root):
            level.sweep(3, 4)
        for level, up in ((m.leaves, m.middle), (m.middle, m.root), (m.root, None)):
            ends = level.start + level.t
            assert all(level.size[a:b].sum() == c and (level.size[a:b] > 0).all() for a, b, c in zip(level.start, ends, level.c, strict=True))
            assert (np.bincount(level.rest, level.t, len(level.tables)) == level.tables).all() and (np.bincount(level.rest, level.c, len(level.customers)) == level.customers).all()
            assert up is None or (np.bincount(level.parent, level.t, len(up.c)) == up.c).all()
        assert (m.leaves.c == count).all()
    assert m.leaves.t[count == 5000].min() > 1
    rest = m.leaves.rest
    full = [m.leaves.share(np.flatnonzero(rest == k)).sum() for k in range(int(rest.max()) + 1)]
    assert max(full) < 1 + 1e-9
    got = pitman_yor.unpack_triples(pitman_yor.pack_triples(v, w, u, count, word))
    assert all((a == b).all() for a, b in zip(got, (v, w, u, count, word), strict=True))
    many, low = np.array([3, 1, 40, 5]), np.array([0, 3, 10, 60])
    drawn = m.leaves.chosen(low, np.array([3, 7, 50, 90]), many)
    assert len(set(drawn.tolist())) == 49 and sorted(np.searchsorted(low, drawn, "right").tolist()) == np.repeat([1, 2, 3, 4], many).tolist()


def test_language_model_over_many_blocks_and_classes(spark, docs, monkeypatch):
    """Counts and base scores don't depend on the blocks; contexts of common words fall to several parents."""
    from pyspark.sql import functions as F

    whole = {str(r.doc_id): r for r in pitman_yor.scores(docs, ~quality.apart(F.col("doc_id"), 7, 2)).collect()}
    monkeypatch.setattr(blocks, "BLOCK", 400)
    monkeypatch.setattr(blocks, "BUCKET", 50)
    monkeypatch.setattr(pitman_yor, "CLASS", 60)
    monkeypatch.setattr(pitman_yor, "PARENT", 20)
    split = {str(r.doc_id): r for r in pitman_yor.scores(docs, ~quality.apart(F.col("doc_id"), 7, 2)).collect()}
    assert set(split) == set(whole)
    for k, r in split.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[k].n_tokens, whole[k].n_known, whole[k].train_tokens) and abs(r.base_score - whole[k].base_score) < 1e-9
        assert abs(r.score - whole[k].score) < 0.25 * abs(whole[k].score) + 20


def test_language_model_prefers_what_it_has_seen(spark):
    from pyspark.sql import functions as F

    rows = [(k, "the cat sat on the mat and the dog ran", "", "", 0) for k in range(30)] + [(100, "the cat sat on the mat", "", "", 0), (101, "mat the on sat cat the", "", "", 0), (102, "never heard of these", "", "", 0)]
    out = {r.doc_id: r for r in pitman_yor.scores(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 100).collect()}
    assert out[100].score > out[101].score
    assert out[100].score > out[100].base_score


def test_language_model_without_training(spark):
    from pyspark.sql import functions as F

    out = pitman_yor.scores(spark.createDataFrame([(1, "a b", "", "", 0), (2, None, "", "", 0)], SCHEMA), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in out) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert pitman_yor.scores(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
