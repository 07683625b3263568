"""Fingerprints, token counts, BPE, token files and SimHash against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as vocab
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import bpe, digests, pieces, simhash, token_counts, token_files
from tallyloom.llm.common import portions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids_crc32 string, size int"
RANDOM = random.Random(5)
ODD = ["", " ", "  ", "\n", "a  b ", "\n\n x \n", "▁▁x ▁y", " lead", "tail ", "<s> </s> <|endoftext|>", "日本語 テスト", " x y", "it's we'll'", "12345 67", "x" * 3000, "ab" * 700, "\x1c a\x1d b\x85c", "\t\ttabs\r\n", "🙂🙂 🙂", "á", "\x00", "end. Next", "end.\nNext, (so) \"it\" is###", "a.\n.b", "x' y'."]
MIXED = ["".join(RANDOM.choice("abc  \n\té日'sXt1.,▁") for _ in range(RANDOM.randint(1, 80))) for _ in range(400)]


def rows(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None, "clash", "clash", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- token counts ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))


def test_counts_equal_the_library(pieces_model):
    own = token_counts.Counter(open(vocab.path("piece_bpe_32k.model"), "rb").read())
    for text in ODD + MIXED:
        assert own.count(text) == len(pieces_model.encode(text)), repr(text)
    assert len(own.proved[" "]) > 10_000 and all(n == 1 for n in own.proved[" "].values())


def test_counts_survive_a_full_memory(pieces_model, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_PIECES", 5)
    own = token_counts.Counter(open(vocab.path("piece_bpe_32k.model"), "rb").read())
    for text in MIXED[:100]:
        assert own.count(text) == len(pieces_model.encode(text))


def test_count_query(spark, pieces_model):
    texts = ["one two three", None, "", "word " * 6000, "one two three"]
    got = token_counts.count_tokens(rows(spark, texts, [1, 2, None, 4, 1]), vocab.path("piece_bpe_32k.model"))
    n = len(pieces_model.encode("word " * 6000))
    assert table(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted([(1, 13, 3, False), (2, 0, 0, False), (None, 0, 0, False), (4, 30000, n, n > 4096), (1, 13, 3, False)], key=str)
    assert token_counts.count_tokens(rows(spark, []), vocab.path("piece_bpe_32k.model")).count() == 0


# -- byte pairs --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(open(vocab.path("byte_bpe_50k.tiktoken"), "rb").read())


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(ranks, reference):
    own = bpe.Codec(ranks, vocab.PATTERN)
    for text in ODD + MIXED:
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_appends_and_edits_give_what_encoding_anew_gives(ranks):
    words = bpe.Vocabulary(ranks)
    for _ in range(60):
        data = "".join(RANDOM.choice(["the", "ing", "re", "un", " a", "zq", "日", "ß", "x"]) for _ in range(RANDOM.randint(1, 200))).encode()
        grown = bpe.PrefixEncoding(words)
        for k in range(0, len(data), 7):
            grown.append(data[k : k + 7])
        assert grown.ids() == bpe.PrefixEncoding(words, data).ids()
        a, b = sorted(RANDOM.choices(range(len(data) + 1), k=2))
        new = RANDOM.choice([b"", b"thing", data[:5]])
        done = grown.replace(a, b, new)
        assert grown.data == data[:a] + new + data[b:]
        assert grown.ids() == bpe.PrefixEncoding(words, grown.data).ids()
        assert done <= len(grown.data) - a
    long = bpe.PrefixEncoding(words, b"therein " * 2000)
    assert long.replace(8, 12, b"zzzz") < 2000  # stops soon after the edit


def test_pairs_by_brute_force():
    letters = {bytes([b]): b for b in range(256)}
    merges = [b"ab", b"bc", b"abc", b"ca", b"aa", b"aaa", b"bcab"]
    ranks = letters | {m: 256 + k for k, m in enumerate(merges)}
    words = bpe.Vocabulary(ranks)

    def merged(data):
        parts = [data[k : k + 1] for k in range(len(data))]
        while True:
            found = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for _ in range(2000):
        data = "".join(RANDOM.choice("abc") for _ in range(RANDOM.randint(1, 14))).encode()
        assert bpe.PrefixEncoding(words, data).ids() == merged(data), data


def test_bpe_query(spark, reference):
    texts = ["Hello world", None, "", "Hello world", "é" * 5000]
    got = bpe.encode_decode(rows(spark, texts), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, keep=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, text, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(rows(spark, []), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN).count() == 0


# -- token files -------------------------------------------------------------------------------------------------------


def test_numbers_round_trip():
    for n in (0, 1, 3, 4, 5, 100, 1001):
        numbers = np.array([RANDOM.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        packed = token_files.pack_numbers(numbers)
        back, size = token_files.unpack_numbers(memoryview(packed + b"more"), n)
        assert (back == numbers).all() and size == len(packed)


@pytest.mark.parametrize("top", [50_000, (1 << 32) - 1])
def test_blocks_round_trip(top):
    ids = [np.array([RANDOM.randint(0, top) for _ in range(k)], np.uint32) for k in (0, 1, 7, 300)]
    docs, lengths, flat = token_files.unpack_block(token_files.pack_block([5, None, -3, 9], ids))
    assert docs == [5, None, -3, 9] and lengths.tolist() == [0, 1, 7, 300] and (flat == np.concatenate(ids)).all()


def test_frequent_ids_take_one_byte():
    ids = [np.array([40_000] * 5000 + list(range(1000)), np.uint32)]
    assert len(token_files.pack_block([1], ids)) < 5000 * 1.25 + 1000 * (4 + 2.25) + 200


def test_file_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    own = token_files.Encoder(open(vocab.path("byte_bpe_50k.json"), "rb").read(), vocab.PATTERN)
    for text in ODD + MIXED:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_file_encoder_looks_a_word_of_several_texts_up_once():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    own = token_files.Encoder(open(vocab.path("byte_bpe_50k.json"), "rb").read(), vocab.PATTERN)
    merged, merge = [], own.merge
    own.merge = lambda letters: merged.append(letters) or merge(letters)
    ends = ["", "two  spaces", "at the end ", " at the start", " \tmixed", "a.\nB é!! naïve, naïve. it's 3rd |", "\u00a0x \u00a0y", "x<|endoftext|> y", "x \u4e00", "-- ..", "\x00 \x00a"]
    texts = [*ODD, *MIXED, *ends, *ends]
    for group in (texts, texts[::-1], [""], [" "], []):
        for got, text in zip(own.encode_all(pa.array(group, pa.string()), 7), group, strict=True):
            assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 7], repr(text)
    words = [f"q{chr(97 + a)}{chr(97 + b)}x" for a in range(26) for b in range(26)]
    counted, get = [], own.pieces.words.get
    merged.clear()
    own.pieces.words.get = lambda word: counted.append(word) or get(word)
    own.encode_all(pa.array([" " + mark.join(words) for mark in (" ", ", ", "! ", " ")] * 5), 0)
    assert 676 <= len(counted) <= 677 and sum(x[1:] in words for x in merged) == 676


def test_words_of_groups_stay_bounded():
    kept = pieces.PieceCache(str.upper, 5)
    kept.keep([(str(k), k) for k in range(12)] + [("x" * 100, 0)])
    assert list(kept) == ["10", "11"] and list(kept.older) == ["5", "6", "7", "8", "9"]


def test_portions_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"", b"x" * 9, b"y", b"z" * 40, b"", b"w"])], ["k", "v"])
    assert [x.column(0).to_pylist() for x in portions(batch, 1, 10)] == [[0, 1, 2], [3], [4, 5]]
    assert [x.num_rows for x in portions(batch.slice(2, 0), 1, 10)] == [0]


@pytest.mark.parametrize("block_ids", [3, 1 << 20])
def test_file_query(spark, block_ids):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    texts = [f"text number {k} " + "word " * (k % 5) for k in range(40)] + [None, ""]
    ids = [1000 - 7 * k for k in range(42)]
    got = token_files.token_offsets(rows(spark, texts, ids), vocab.path("byte_bpe_50k.json"), vocab.PATTERN, block_ids=block_ids)
    want, start = [], 0
    for i, text in sorted(zip(ids, texts, strict=True)):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(table(got, "doc_id", "start", "n_tokens", "ids_crc32")) == want
    assert token_files.token_offsets(rows(spark, []), vocab.path("byte_bpe_50k.json"), vocab.PATTERN).count() == 0


def test_file_query_with_repeated_and_null_ids(spark):
    got = token_files.token_offsets(rows(spark, ["b", "a", "c", "c"], [4, 4, None, None]), vocab.path("byte_bpe_50k.json"), vocab.PATTERN).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 4, 6] and {r["start"] for r in got if r["doc_id"] is None} == {0, 2}


# -- SimHash -----------------------------------------------------------------------------------------------------------


def brute_simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    for text in ODD + MIXED[:100] + ["ÀÉ Word WORD word a b c d e f"]:
        assert simhash.simhash64(text.encode()) == brute_simhash(text), repr(text)


def groups(values, bits):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(v for v in values if find(v) == r) for r in {find(v) for v in values}}


@pytest.mark.parametrize(("bits", "most"), [(2, 4096), (2, 8), (2, 5), (2, 2), (1, 6), (1, 2), (0, 4096), (4, 4096), (4, 6), (4, 3)])
def test_near_edges_connect_what_brute_force_links(spark, bits, most):
    bases, values = [RANDOM.getrandbits(64) for _ in range(12)], set()
    for base in bases:
        for _ in range(14):
            base ^= sum(1 << RANDOM.randrange(64) for _ in range(RANDOM.randint(0, 3))) & ((1 << 64) - 1)
            values.add(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    from tallyloom.llm.components import connected_components

    found = {}
    for r in connected_components(simhash.near_edges(prints, bits, most)).collect():
        found.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    joined = {frozenset(g) for g in found.values()}
    assert joined == {g for g in groups(values, bits) if len(g) > 1}


def test_a_large_bucket_is_split_by_a_further_segment(spark):
    near = [(RANDOM.getrandbits(42) << 22) | 5 for _ in range(1500)]
    near += [v ^ (1 << 30) ^ (1 << 63) for v in near[:100]]
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(near)], "fp long")
    fine = simhash._refined(prints.selectExpr("fp", "0 AS k", "5L AS v"), 2)
    assert fine.count() == 3 * len(set(near)) and fine.groupBy("j", "w").count().where("count > 12").isEmpty()
    found = {(min(r["a"], r["b"]) % (1 << 64), max(r["a"], r["b"]) % (1 << 64)) for r in simhash.near_edges(prints, 2, 50).collect()}
    assert {frozenset(e) for e in found} >= {frozenset((v, v ^ (1 << 30) ^ (1 << 63))) for v in near[:100]}


def test_near_duplicates_query(spark):
    texts = ["the same text of some words", "the same text of some words", "The SAME text of some words", None, "", "other words altogether here", "  ", None]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(rows(spark, texts, [7, 3, 9, 5, 6, 1, None, None])).collect() if r["doc_id"] is not None}
    assert {k: r["component_id"] for k, r in got.items()} == {7: 3, 3: 3, 9: 3, 5: 5, 6: 5, 1: 1}
    assert got[5]["fp"] == 0
    assert simhash.near_duplicates(rows(spark, [])).count() == 0


def test_keep_first_keeps_one_row_of_each_group_and_its_columns(spark):
    docs = rows(spark, ["same words in here", "same words in here", "same words in here", "lonely other text", None, ""], [5, 2, 2, 8, None, None])
    for most in (0, 1000):
        kept = simhash.keep_first(docs, most_broadcast=most)
        assert kept.columns == docs.columns
        assert table(kept, "doc_id", "text") == sorted([(2, "same words in here"), (8, "lonely other text"), *[(r["doc_id"], r["text"]) for r in kept.where("doc_id is null").collect()]], key=str)
        assert kept.count() == 3


# -- fingerprints ------------------------------------------------------------------------------------------------------


def test_entropy_by_brute_force():
    import math
    from collections import Counter

    data = np.frombuffer(bytes(RANDOM.choice(b"aab cde\n") for _ in range(300)), np.uint8)
    for k, level in enumerate(digests.entropy_levels(data)):
        counts = Counter(data[k : k + digests.WIDTH].tolist())
        true = sum(c / digests.WIDTH * math.log2(digests.WIDTH / c) for c in counts.values()) / math.log2(digests.WIDTH)
        assert abs(level - 1000 * true) <= 1.01


def test_digest_does_not_depend_on_blocks(monkeypatch):
    text = " ".join(RANDOM.choice(["alpha", "beta", "gamma", "delta", "zeta"]) + str(RANDOM.randint(0, 99)) for _ in range(900)).encode()
    ranks = digests.ranks_of(digests.level_counts(text))
    whole = str(digests.digest(text, ranks))
    monkeypatch.setattr(digests, "BLOCK", 97)
    assert str(digests.digest(text, ranks)) == whole and digests.level_counts(text).sum() == len(text) - digests.WIDTH + 1
    assert str(digests.Digest.parse(whole)) == whole


def test_likeness_orders_texts():
    make = lambda seed, n: " ".join(random.Random(seed + k).choice("abcdefgh") * 2 + str(random.Random(seed * 7 + k).randint(0, 9999)) for k in range(n))
    a, b = make(1, 600), make(50_000, 600)
    ranks = digests.ranks_of(digests.level_counts(a.encode()))
    d = lambda t: digests.digest(t.encode(), ranks)
    assert digests.likeness(d(a), d(a)) == 1
    assert digests.likeness(d(a), d(b)) < 0.1 < digests.likeness(d(a), d(a[: len(a) // 2] + b[: len(b) // 2])) < 1
    assert digests.likeness(d(""), d("")) == 1 and digests.likeness(d(""), d(a)) == 0
    assert digests.likeness(d("aaaa" * 100), d("aaaa" * 100)) == 1
    for k in range(40):
        x, y = d(make(90 * k, 300)), d(make(90 * k, 150) + make(70_000 + 90 * k, 150))
        y.features = x.features if len(x.filters) == len(y.filters) else y.features
        assert digests.likeness(x, y) == digests.likeness(y, x)


def brute_digest(raw, ranks):
    """The digest window by window, without arrays or blocks."""
    if not raw:
        return 0, b""
    width = digests.WIDTH
    if len(raw) < width:
        raw += bytes([len(raw)]) * (width - len(raw))
    # a level at a time from single windows: that they are right is tested above
    rank = [int(ranks[digests.entropy_levels(np.frombuffer(raw[k : k + width], np.uint8))[0]]) for k in range(len(raw) - width + 1)]
    around = min(digests.AROUND, len(rank))
    wins = [0] * len(rank)
    for k in range(len(rank) - around + 1):
        wins[min(range(k, k + around), key=lambda j: (rank[j], j))] += 1
    chosen = [k for k in range(len(rank)) if wins[k] >= digests.POPULAR and rank[k] <= digests.LEVELS] if len(rank) > digests.AROUND else []
    chosen = chosen or [max(range(len(rank)), key=lambda k: (wins[k], -k))]
    out, mask = [], (1 << 64) - 1
    for at in range(0, len(chosen), digests.FILTER_FEATURES):
        bits = 0
        for k in chosen[at : at + digests.FILTER_FEATURES]:
            h = 0x9E3779B97F4A7C15
            for j in range(0, width, 8):
                h = (h ^ int.from_bytes(raw[k + j : k + j + 8], "little")) * 0xBF58476D1CE4E5B9 & mask
                h ^= h >> 31
            h = h * 0x94D049BB133111EB & mask
            h ^= h >> 29
            for j in range(digests.FEATURE_BITS):
                bits |= 1 << (h >> 11 * j & digests.FILTER_BITS - 1)
        out.append(bits.to_bytes(digests.FILTER_BITS // 8, "little"))
    return len(chosen), b"".join(out)


def test_digest_by_brute_force():
    texts = ["", "short", "x" * 31, "x" * 32, "x" * 33, "ab" * 60, *["".join(RANDOM.choice(RANDOM.choice(["ab ", "abcdefghij klmn\n", "日é. 0123"])) for _ in range(n)) for n in (40, 63, 64, 65, 300, 4000)]]
    ranks = digests.ranks_of(sum(digests.level_counts(t.encode()) for t in texts))
    for text in texts:
        found = digests.digest(text.encode(), ranks)
        assert (found.features, found.filters.tobytes()) == brute_digest(text.encode(), ranks), text[:40]


def test_fingerprint_query(spark, tmp_path):
    texts = [f"document {k} " + " ".join(RANDOM.choice(["red", "green", "blue", "white"]) + str(RANDOM.randint(0, 500)) for _ in range(40)) for k in range(30)] + [None, "", "日本", "short"]
    ids = [3 * k for k in range(34)]
    got = {r["doc_id"]: r for r in digests.compare_edits(rows(spark, texts, ids)).collect()}
    order = sorted(ids, reverse=True)
    by_id = dict(zip(ids, texts, strict=True))
    for at, i in enumerate(order):
        text, following = by_id[i] or "", by_id[order[(at + 1) % len(order)]] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert sum(r["near_edited"] for r in got.values()) > 3 * sum(r["near_next"] for r in got.values())
    assert digests.compare_edits(rows(spark, [])).count() == 0
    ranks = digests.fit_ranks(rows(spark, texts, ids))
    own = {i: digests.digest((by_id[i] or "").encode(), ranks) for i in ids}
    for at, i in enumerate(order):
        text, following = by_id[i] or "", order[(at + 1) % len(order)]
        changed = digests.digest((text[: len(text) - len(text) // 2] + (by_id[following] or "")[: len(text) // 2]).encode(), ranks)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (str(own[i]), str(changed))
        assert got[i]["near_edited"] == digests.likeness(own[i], changed) and got[i]["near_next"] == digests.likeness(own[i], own[following])
    folder = f"{tmp_path}/ranks"
    digests.write_ranks(spark, ranks, folder)
    assert (digests.read_ranks(spark, folder) == ranks).all()
    clashing = digests.compare_edits(rows(spark, texts, ids).withColumnsRenamed({"fp": "range", "size": "tail"}))
    assert table(clashing, *clashing.columns) == table(digests.compare_edits(rows(spark, texts, ids)), *clashing.columns)
    alone = digests.compare_edits(rows(spark, ["one text only, and no other"])).first()
    assert alone["near_next"] == 1
    assert digests.compare_edits(rows(spark, ["same", "same", "same"], [1, 1, None])).count() == 3


def test_texts_of_megabytes(spark, pieces_model):
    long = " ".join(f"word{k % 997} of text {k * k % 10_007}" for k in range(150_000))
    got = digests.compare_edits(rows(spark, [long, "short text", None])).collect()
    assert {r["doc_id"]: r["n_chars"] for r in got} == {0: len(long), 1: 10, 2: 0}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows(spark, [long, None]), vocab.path("piece_bpe_32k.model")).collect()}
    assert counts == {0: len(pieces_model.encode(long)), 1: 0}
