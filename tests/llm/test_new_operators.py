"""Operators 11 to 13 against plain loops, and texts that repeat themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlane.llm.line_dedup import dedup_lines
from pairlane.llm.phrase_automata import remove_repeats, stretches
from pairlane.llm.resampling import Features, resample
from pairlane.llm.tokenizer_alignment import align, overlaps
from tests.llm.test_operators import awkward  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- op11


def plain_removal(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeating_texts():
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (34, 35, 36, 50, 200)]
    texts = [None, "", " \n\t", "one two", "a " * 400, "x y z " * 150, "a " * 35, "a " * 34]
    for _ in range(60):
        parts = [fresh(r.randrange(30)) if r.random() < 0.5 else r.choice(passages)[r.randrange(20) :] for _ in range(r.randrange(1, 6))]
        texts.append(r.choice([" ", "\n", "  "]).join(sum(parts, [])))
    base = fresh(300)
    for _ in range(20):  # near copies
        copy = list(base)
        copy[r.randrange(300)] = "changed"
        texts.append(" ".join(copy))
    return texts + texts[-3:] + [texts[4]]


@pytest.mark.parametrize("setting", [{}, {"task_words": 500, "patterns": 40, "piece": 60, "chunk": 50}])
def test_repeats_brute_force(spark, setting):
    """The second setting splits stretches, shards over tasks, and automata."""
    texts = repeating_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **setting).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 35)


def test_short_windows_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(df, window=6, phrase=3, task_words=100).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 6)


def test_stretches_hold_each_window_once():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(10, 80)
        marks = sorted(r.sample(range(n - 3), r.randrange(1, 5)))
        starts = [i for a, b in stretches(marks, n, 7, 3, 5) for i in range(a, b - 6)]
        assert len(starts) == len(set(starts)) and {i for p in marks for i in range(max(0, p - 4), p + 1) if i + 7 <= n} <= set(starts)


def test_awkward_repeats(awkward):  # noqa: F811
    out = remove_repeats(awkward).collect()
    assert len(out) == awkward.count() and sum(r.doc_id is None for r in out) == 2
    long = {r.doc_id: r for r in out if r.doc_id in (6, 7)}
    assert all(r.n_removed == r.n_words == 20_000 for r in long.values())
    assert {r.kept_sha256 for r in out if r.n_words == 0} == {sha("")}
    assert remove_repeats(awkward.limit(0)).count() == 0


# ---- op12


def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(texts):
    first, second = libraries()
    letters, found, docs = byte_letters(), [], Counter()
    for t in texts:
        found.append(None)
        if not t:
            continue
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        x = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        y = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(x) == b"".join(y) == (" " + t).encode():
            continue
        i = j = at = bt = 0
        links, groups, own = [], [], ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            ends = at + len(x[i]), bt + len(y[j])
            if ends[0] <= ends[1]:
                own[0].append(a[i])
                i, at = i + 1, ends[0]
            if ends[1] <= ends[0]:
                own[1].append(b[j])
                j, bt = j + 1, ends[1]
            if at == bt:
                groups.append("|".join(",".join(map(str, z)) for z in own))
                own = ([], [])
        docs.update(set(links))
        found[-1] = (len(a), len(b), groups, links)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(docs[p] == best[p[0]] for p in f[3]), sum(docs[p] for p in f[3]), sha(";".join(f[2]))) for f in found]


@pytest.mark.parametrize("setting", [{}, {"work": 37, "block_links": 200}])
def test_alignment_brute_force(spark, setting):
    r = random.Random(4)
    some = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "日", "😀", "'", "'s", "1", "<|endoftext|>", "</s>", "<unk>", "▁", "word", "The", "ing", "\r\n", ".", "　", "ß", "\x00"]
    texts = [None, "", " ", "  ", "\n", "a", "▁"] + ["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(400)]
    texts += [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    out = align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **setting)
    got = {x.doc_id: (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_merge_paths_do_not_depend_on_the_pieces():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(2, 300))
        a, b = (np.r_[np.flatnonzero(r.random(n - 1) < p) + 1, n] for p in (0.3, 0.5))
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])]
        for work in (1, 2, 7, 1000):
            left, right, of_a, of_b = overlaps(a, b, work)
            assert list(zip(left.tolist(), right.tolist(), strict=True)) == pairs
            shared = np.intersect1d(a, b)
            assert (of_a == np.searchsorted(shared, a)).all() and (of_b == np.searchsorted(shared, b)).all()


def test_awkward_alignment(awkward):  # noqa: F811
    out = align(awkward).collect()
    assert len(out) == awkward.count() and sum(r.doc_id is None for r in out) == 2
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in out if r.doc_id in (2, 3))
    assert align(awkward.limit(0)).count() == 0


# ---- op13

TARGET_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, ngram):
    words = TARGET_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("ngram", [1, 3])
def test_resampling_brute_force(spark, ngram):
    r, buckets = random.Random(8), 50
    make = lambda n: " ".join(r.choice(["The", "cat", "été", "ÉTÉ", "x1", "a-b", "\x1e", "\x00", "dog_dog"]) for _ in range(r.randrange(n)))
    texts, target = [None, "", "--", *[make(40) for _ in range(200)]], [make(20) for _ in range(5)] + [None]
    every = [plain_features(t, ngram) for t in texts]
    s, t = Counter(f % buckets for _, fs in every for f in fs), Counter(f % buckets for x in target for f in plain_features(x, ngram)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    rows = []
    for i, (n, fs) in enumerate(every):
        h = int(sha(f"2024:{i}")[:8], 16)
        weight = sum(gain[f % buckets] for f in fs)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = [x[0] for x in sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0]))]
    drawn = {d: k + 1 for k, d in enumerate(order[: len(order) * 30 // 100])}
    out = resample(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), ngram=ngram, buckets=buckets, percent=30)
    assert sorted((x.doc_id, x.n_features, x.weight, x["score"], x["rank"]) for x in out.collect()) == [(x[0], x[2], x[3], x[4], drawn.get(x[0])) for x in rows]


def test_words_of_a_long_text_are_not_cut(monkeypatch):
    from pairlane.llm import bytewise as bw

    monkeypatch.setattr(bw, "BLOCK", 10)
    data = np.frombuffer("some words that stand over the cutsévery long".encode(), np.uint8)
    bucket, _, words = Features(2, 1000)(data, np.array([0, 20, len(data)]))
    want = [plain_features(data[a:b].tobytes().decode(), 2)[1] for a, b in ((0, 20), (20, len(data)))]
    assert sorted(bucket.tolist()) == sorted(f % 1000 for x in want for f in x) and words.tolist() == [4, 5]


def test_awkward_resampling(awkward):  # noqa: F811
    out = resample(awkward, awkward, least_words=1, percent=50).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"] is not None)
    assert len(out) == awkward.count() and ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 8 // 2
    assert all(r.n_features == r.weight == 0 for r in out if r.doc_id in (2, 3))
    assert resample(awkward.limit(0), awkward).count() == 0
    assert {r.weight for r in resample(awkward, awkward.limit(0).select(F.col("text"))).collect() if r.n_features == 0} == {0}


# ---- op5


def test_texts_that_repeat_themselves(spark):
    docs = {1: "the same line\n" * 100_000, 2: "one\ntwo x\nthree\n" * 30_000, 3: ("w " * 60 + "\n") * 2000 + "v " * 60 + "\ntail"}
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert [(r.start, r.end) for r in got[1].removed_runs] == [(1, 99_999)] and got[1].text == "the same line\n"
    assert [(r.start, r.end) for r in got[2].removed_runs] == [(3, 89_999)] and got[2].text == "one\ntwo x\nthree\n"
    assert [(r.start, r.end) for r in got[3].removed_runs] == [(1, 1999)]


# ---- keys that many rows share, for op1 to op3


def test_shared_keys(spark):
    from pairlane.llm.mixing import mix_sources
    from pairlane.llm.ngram_join import near_duplicates
    from pairlane.llm.sharding import assign_shards

    r = random.Random(3)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(150)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base]  # pairs with a similarity of 0.96
    for key in (None, 7):
        df = spark.createDataFrame([(key, t, "a", 60) for t in texts], "doc_id long, text string, source string, size long")
        near = near_duplicates(df).collect()
        assert len(near) == 300 and {x.n_links for x in near} == {1} and {x.class_id for x in near} == {key}
        mixed = mix_sources(df, budget=1.5).select("copies").collect()
        assert len(mixed) == 300 and sum(x.copies for x in mixed) == 450
        placed = assign_shards(df, "doc_id", 5).collect()
        assert len({x["shard"] for x in placed}) == 1 and sorted(x["slot"] for x in placed) == list(range(300))


def test_blocks_of_long_texts(spark, monkeypatch):
    import pairlane.llm.ngram_join as J

    r = random.Random(6)
    long = [f"w{i}" for i in range(30_000)]
    texts = [" ".join([*long[:i], "x", *long[i + 1 :]]) for i in r.sample(range(30_000), 12)] + ["a b c d e f", "a b c d e f g"]
    monkeypatch.setattr(J, "BLOCK_WORDS", 40_000)
    got = {x.doc_id: (x.class_id, x.n_links) for x in J.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=0.6).collect()}
    assert all(got[i] == (0, 11) for i in range(12)) and got[12] == got[13] == (12, 1)


def test_route_of_many_overlapping_patterns():
    import time

    from pairlane.llm.mixing import route

    r = random.Random(1)
    members = sorted({tuple(sorted(r.sample(range(30), r.randrange(2, 6)))) for _ in range(8200)})[:8000]
    capacity = [float(r.randrange(1, 1000)) for _ in members]
    total = sum(capacity)
    began = time.time()
    quota = [total * 1.5 * (i + 1) / 465 for i in range(30)]
    flow = route(capacity, [list(m) for m in members], quota, 2)
    assert time.time() - began < 20
    assert all(set(f) <= set(m) for f, m in zip(flow, members))
    assert all(sum(f.values()) <= 2 * c + 1e-6 for f, c in zip(flow, capacity))
    into = [sum(f.get(s, 0) for f in flow) for s in range(30)]
    assert all(a <= b + 1e-3 for a, b in zip(into, quota)) and abs(sum(into) - total * 1.5) < 1e-3 * total
    # convex costs: every pattern is used once before any is used twice
    assert sum(min(sum(f.values()), c) for f, c in zip(flow, capacity)) == pytest.approx(total, rel=1e-6)
