"""Brute-force versions, round trips, and the awkward inputs that every operator must take."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.chat_format import format_chats, parse_chats
from pairlane.llm.chunk_dedup import exact_groups
from pairlane.llm.components import components
from pairlane.llm.line_dedup import dedup_lines
from pairlane.llm.mixing import mix_sources, route, share
from pairlane.llm.ngram_join import choose_bands, near_duplicates
from pairlane.llm.packing import hilbert, pack
from pairlane.llm.repetition import measures, repetition_rules
from pairlane.llm.sharding import assign_shards

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def long_text():
    r = random.Random(3)
    return "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(500))


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "a text without an id but words", "en", "b", 5), (5, " \t\n ", "de", "b", 4),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 1), (6, long_text(), "en", "c", 9), (7, long_text(), "fr", "c", 9), (8, "dog", "en", None, 3), (9, "dog", "en", "b", 3), (10, "été 'quoted' — don’t ß× 12٣ x", "fr", "a", 2), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "n", "p", "k", "at", "part", "_part", "digest", "_size", "runs", "slot", "shard", "score", "kept", "copies", "class_id", "removed_runs", "area", "a.b", "my col", "x:y", "ti`ck", "0"):
        df = df.withColumn(name, F.lit("mine"))
    return df.withColumn("of", F.create_map(F.lit("a"), F.lit(1)))


def ids(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def jump(key, n):
    b, j, i = -1, 0, 0
    while j < n:
        b, i = j, i + 1
        import hashlib

        h = int(hashlib.md5(f"{key}|{i}".encode()).hexdigest()[:13], 16)
        j = int((b + 1) / ((h + 1) / float(1 << 52)))
    return b


def test_shards_move_only_into_the_new_one(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    out = assign_shards(df, "doc_id", 24).toPandas()
    assert all(jump(d, 24) == s and jump(d, 25) == g for d, s, g in zip(out.doc_id, out["shard"], out.grown_shard))
    moved = out[out["shard"] != out.grown_shard]
    assert set(moved.grown_shard) == {24} and 60 < len(moved) < 190
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_op3_digest_columns(spark):
    from pairlane.llm.sharding import op3_jump_shards

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_jump_shards(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r["shard"]) == (len(raw) + 8, zlib.crc32(raw), "key", jump(r.doc_id, 24))


def test_awkward_shards(awkward):
    out = assign_shards(awkward, "doc_id", 24)
    assert out.count() == awkward.count() and set(awkward.columns) == set(out.columns) - {"grown_shard"}
    assert assign_shards(awkward.limit(0), "doc_id").count() == 0


def test_share_stops_at_the_cap():
    out = share([10, 10, 100], [5, 2, 1], 100, 2)
    assert out == [20, 20, 60]
    assert share([100, 100], [1, 3], 40, 2) == [10, 30]


def test_flow_reroutes_overlapping_sources():
    # the shared pattern must serve source 1, as source 0 has its own
    flow = route([10.0, 10.0], [[0], [0, 1]], [10.0, 10.0], 1)
    assert flow[0] == {0: 10.0} and flow[1].get(1) == 10.0 and flow[1].get(0, 0) == 0
    # second copies only when first copies are spent
    flow = route([10.0, 10.0], [[0], [0]], [25.0], 2)
    assert sum(flow[0].values()) + sum(flow[1].values()) == 25.0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, [["a"], ["b"], ["a", "b"], []][i % 4], 1 + i % 7) for i in range(400)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, source array<string>, size long"), weights=(1.0, 3.0), budget=0.8).toPandas()
    assert (out[out.source.map(len) == 0].copies == 0).all() and out.copies.max() <= 2
    total = out["size"].sum() * 0.8
    by = {s: sum(z * list(p).count(s) for z, p in zip(out["size"], out.parts)) for s in "ab"}
    assert abs(by["a"] + by["b"] - total) < 20 and abs(by["b"] / by["a"] - 3) < 0.2
    assert all(set(p) <= set(s) for p, s in zip(out.parts, out.source))


def test_patterns_beyond_the_driver_bound_mix_alike(spark):
    r = random.Random(8)
    names = [*"abcdefghij", None]
    rows = [(i, r.sample(names, r.randrange(1, 3)) if i % 9 else [], r.randrange(1, 9)) for i in range(900)] + [(1000 + i, [f"lone{i % 5}"], 3) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source array<string>, size long")
    for budget in (0.4, 1.5, 9.0):
        few, many = (mix_sources(df, budget=budget, max_patterns=n).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (4096, 3))
        assert [list(x) for x in few.parts] == [list(x) for x in many.parts] and few.copies.equals(many.copies)
        assert all((a is None) == (b is None) and (a is None or np.allclose(a, b)) for a, b in zip(few.targets, many.targets))


def test_awkward_mix(awkward):
    sized = awkward.withColumn("size", F.length("text"))
    out = mix_sources(sized)
    assert out.count() == awkward.count()
    assert ids(out, "doc_id", "copies") == ids(mix_sources(sized.repartition(3)), "doc_id", "copies")
    assert mix_sources(sized.limit(0)).count() == 0


def test_exact_groups_and_weak_digests(spark, awkward):
    out = exact_groups(awkward).collect()
    assert len(out) == awkward.count()
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(x.kept for x in g) == 1 and {x.group_size for x in g} == {len(g)} for g in by.values())
    assert len({r.text_sha256 for r in out}) == len({re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in awkward.collect()})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weak = exact_groups(docs, digest=lambda c: F.unhex(F.substring(F.md5(c), 1, 2)))  # many texts share a digest
    assert ids(weak, "doc_id", "keep_id", "group_size", "kept") == ids(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert exact_groups(awkward.limit(0)).count() == 0


def brute_lines(docs, window=3, long_words=50):
    """{doc: kept text}: each window that stood earlier is a match with its first place, grown up and down to the next difference."""
    first, texts, out = {}, {}, {}
    for d, t in sorted(docs.items()):
        lines = (t or "").split("\n")
        plain = [(i, " ".join(WORD.findall(line))) for i, line in enumerate(lines)]
        plain = [(i, x) for i, x in plain if x]
        own = texts[d] = [x for _, x in plain]
        gone = set()
        for a in range(len(own)):
            n, words = 0, 0
            while n < window and words < long_words and a + n < len(own):
                words += len(own[a + n].split(" "))
                n += 1
            if n < window and words < long_words:
                continue
            source, b = first.setdefault(tuple(own[a : a + n]), (d, a))
            if (source, b) == (d, a):
                continue
            other, up, down = texts[source], 0, 0
            while min(a, b) > up and own[a - up - 1] == other[b - up - 1]:
                up += 1
            while a + down + 1 < len(own) and b + down + 1 < len(other) and own[a + down + 1] == other[b + down + 1]:
                down += 1
            gone |= set(range(plain[a - up][0], plain[a + down][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    r = random.Random(1)
    for d in range(10_000, 10_200):
        docs[d] = "\n".join(r.choice(["l1 a", "l2  b", "l3", "", "l4 x", "l5 " * 60, "l6 " * 30, "l7"]) for _ in range(r.randrange(12)))
    got = dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = brute_lines(docs)
    assert {x.doc_id: x.text or "" for x in got} == want and len(got) == len(docs)
    assert sum(x.removed_lines for x in got) > 100


def test_matches_grow_both_ways(spark):
    long = "long " * 60
    docs = {1: f"head\n{long}\nfirst tail\n\nsecond tail", 2: f"other\n{long}\nfirst tail\n\nsecond tail", 3: f"{long}\nfirst tail\nanother", 4: long, 5: f"x\nhead\n{long}\ny", 6: "a\na\na\na\na"}
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert {d: x.text for d, x in got.items()} == brute_lines(docs)
    assert got[2].text == "other" and got[3].text == "another" and got[4].text == "" and got[5].text == "x\ny" and got[6].text == "a"
    assert [(x.start, x.end) for x in got[2].removed_runs] == [(1, 4)] and got[2].removed_lines == 4


def test_pipeline_deletes_whole_runs(spark):
    import corpus_pipeline as C

    long = "long " * 60
    docs = spark.createDataFrame([(1, f"{long}\nthe tail", "en", "a", 0), (2, f"own\n{long}\nthe tail", "en", "a", 0)], SCHEMA)
    assert {r.doc_id: r.text for r in C.line_dedup(spark, docs, SF).collect()} == {1: f"{long}\nthe tail", 2: "own"}


def test_awkward_lines(awkward):
    out = dedup_lines(awkward)
    assert out.count() == awkward.count() and {"runs", "part", "row"} <= set(out.columns)
    got = {(r.doc_id, r.lang): r for r in out.collect()}
    assert got[(6, "en")].removed_lines == 0 and got[(7, "fr")].text == "" and got[(2, None)].text is None
    assert dedup_lines(awkward.limit(0)).count() == 0


def brute_join(docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    links, keys = dict.fromkeys(docs, 0), sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {d: (root(d), links[d]) for d in docs}


def test_near_duplicates_brute_force(spark, monkeypatch):
    import pairlane.llm.ngram_join as J

    monkeypatch.setattr(J, "BLOCK_WORDS", 800)  # so that groups span several blocks
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    r = random.Random(2)
    base = [f"v{r.randrange(999)}" for _ in range(120)]
    for d in range(20_000, 20_060):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(120)] = f"z{r.randrange(999)}"
        docs[d] = " ".join(words)
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = brute_join(docs)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == want


def exact_links(texts):
    """{words of a text: number of documents with other words that are similar to it}, by an exact prefix filter."""
    weight = Counter(tuple(WORD.findall(t or "")) for t in texts)
    weight.pop((), None)
    sets = {w: {w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in weight}
    often = Counter(g for s in sets.values() for g in s)
    found, links = defaultdict(list), dict.fromkeys(weight, 0)
    for w, s in sets.items():
        # similar sets share one of their rarest grams: one more than may be missing
        rarest = sorted(s, key=lambda g: (often[g], g))[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1]
        for other in {x for g in rarest for x in found[g]}:
            both = len(s & sets[other])
            if both >= 0.8 * (len(s) + len(sets[other]) - both) - 1e-9:
                links[w] += weight[other]
                links[other] += weight[w]
        for g in rarest:
            found[g].append(w)
    return links, weight


def test_recall_of_links_at_a_tenth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    links, weight = exact_links(texts.values())
    got = want = 0
    for r in near_duplicates(docs).collect():
        words = tuple(WORD.findall(texts[r.doc_id] or ""))
        if words:
            assert weight[words] - 1 <= r.n_links <= weight[words] - 1 + links[words]  # no link that is none
            got, want = got + r.n_links - weight[words] + 1, want + links[words]
    assert want > 500 and got >= 0.995 * want, (got, want)


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.999, 144)
    assert bands * rows <= 144 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_awkward_join(awkward):
    out = near_duplicates(awkward)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert got[1] == [(1, 1), (1, 1)] and got[7] == [(6, 1)] and got[9] == [(8, 1)] and got[3] == [(3, 0)] and len(got[None]) == 2
    assert near_duplicates(awkward.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_chats_come_back(spark, awkward):
    texts = ["\\### Assistant: </turn> ok", "<turn:user>", "\\l\\b<and/>", None, "", "a\nb </turn>\n", "<|x|> é"]
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "a>b<", None]), r.choice(texts), "mine") for c in [*range(30), None] for t in r.sample(range(40), 8)] + [(1, 2, "user", "x", "mine")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    for x in parse_chats(format_chats(df)).collect():
        own = sorted(((t, ro or "", te or "") for c, t, ro, te, _ in rows if c == x.conv_id))
        assert [(t.role, t.text) for t in x.turns] == [(b, c) for _, b, c in own]
        assert list(x.loss_texts) == [c for _, b, c in own if b == "assistant"]
    assert format_chats(df.limit(0)).count() == 0


def test_long_chats_and_odd_loss_roles(spark):
    rows = [(1, t, ["a<b", "us\\er"][t // 3 % 2], f"t{t} <x> é" * (t % 3), "x") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, other string")
    for role in ("a<b", "us\\er"):
        (x,) = parse_chats(format_chats(df, loss_role=role)).collect()
        assert list(x.loss_texts) == [c for _, _, b, c, _ in rows if b == role] and len(x.turns) == 1500


def test_chunks_follow_the_content_in_any_script(spark):
    from pairlane.llm.chunk_dedup import chunks_of

    r = random.Random(9)
    texts = {}
    for i, (low, high) in enumerate(((0x4E00, 0x9000), (97, 123), (0x0400, 0x0450), (0xAC00, 0xD7A0))):
        text = "".join(chr(r.randrange(low, high)) for _ in range(40_000))
        texts[i, 0], texts[i, 1] = text, "x" * 77 + text
    rows = spark.createDataFrame([(*k, t) for k, t in texts.items()], "i int, j int, text string")
    got = {(x.i, x.j): x.chunks for x in rows.select("i", "j", chunks_of(F.col("text")).alias("chunks")).collect()}
    for (i, j), chunks in got.items():
        assert "".join(chunks) == texts[i, j]
        assert j or len(set(chunks) & set(got[i, 1])) > 0.7 * len(chunks), (i, len(set(chunks) & set(got[i, 1])), len(chunks))


def brute_measures(t):
    w = WORD.findall(t)
    cover = lambda n: len({j for i in range(len(w) - n + 1) for j in range(i, i + n) if sum(w[k : k + n] == w[i : i + n] for k in range(len(w) - n + 1)) > 1})
    longest = max([0, *(n for n in range(1, len(w)) if any(w[i : i + n] == w[j : j + n] for i in range(len(w) - n + 1) for j in range(i)))])
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), cover(5), cover(10), longest


def test_repetition_brute_force():
    r = random.Random(4)
    texts = ["", "a", "a a a a a a a a a a a a", "é# é# x\né# é# x\n\n \n", *(" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(20)), *("".join(r.choice("xyz \n|") for _ in range(80)) for _ in range(20))]
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(x) for x in raw])]
    got = measures(np.frombuffer(b"".join(raw), np.uint8), off)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    for i, t in enumerate(texts):
        assert tuple(int(got[n][i]) for n in names) == brute_measures(t), t


def test_awkward_rules(awkward):
    out = repetition_rules(awkward)
    assert out.count() == awkward.count() and dict(out.dtypes)["kept"] == "boolean"
    assert repetition_rules(awkward.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = cells[np.argsort(hilbert(cells, 3))]
    assert len(set(hilbert(cells, 3).tolist())) == 512 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_pieces_hold_the_library_ids(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>\n\n c  <|endoftext|>", "<|endoftext", "<| x é<|endoftext|><|endoftext|>日", "  two  spaces \n\n and\ttabs \n x", "I'll don't 's 12 345abc a1b2 ...!? <|endoftext|>", "çÀÿ×÷ œ Œ ǆ 日本  nbsp \x1c", "a", " ", "\n", "  ", "x \n", "x  y", "\n\nz"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [(90_000 + i, x) for i, x in enumerate(odd)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in docs}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in want.items()}
    for r in rows.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    for s, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == np.r_[0, np.cumsum(g.length)[:-1]]).all() and (g.length.sum() == 2048 or s == rows.sequence_id.max())
    assert pack(awkward).select("doc_id").distinct().count() == 10 and pack(awkward.limit(0)).count() == 0


def test_ids_of_random_texts_are_the_library_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from pairlane.llm.packing import SPECIALS
    from pairlane.llm.tokens import Tokens

    t, own, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS), random.Random(6)
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "a", "Word", " word", "12", "'s", "é", "日本", "ß", "×", ".", "!?", "\u00a0", "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(2000)]
    raw = [x.encode() for x in texts]
    ids, bound = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    want = t.encode_batch(texts, add_special_tokens=False)
    assert all(ids[bound[i] : bound[i + 1]].tolist() == w.ids for i, w in enumerate(want))
    assert any(50256 in w.ids for w in want)


def test_wide_vocabularies_keep_four_bytes(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "")], "doc_id long, text string")
    wide, narrow = (ids(pack(docs, vocabulary=v), "doc_id", "start", "length", "ids_crc32", "doc_tokens") for v in (100_000, 50_257))
    assert wide == narrow


def test_hashes_do_not_depend_on_the_place():
    raw = np.frombuffer(b"abc xyz abc", np.uint8)
    w = bw.runs(~bw.SPACE[raw], np.array([0, 11]))
    h = bw.Hasher(raw)(w.start, w.end)
    assert h[0] == h[2] != h[1]
