import random
import struct
import zlib

import pytest

from lodefuse.llm import packing


def test_packer_is_best_fit_and_bounded():
    rng, packer, used = random.Random(1), packing.Packer(100, open_bins=8), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        number, offset = packer.place(n)
        assert offset == used.get(number, 0)
        used[number] = offset + n
        assert used[number] <= 100 and packer.open <= 8


def test_fullest_closes_first():
    packer = packing.Packer(10, open_bins=2)
    for n in (9, 8, 7):
        packer.place(n)
    assert packer.by_free == {2: [1], 3: [2]}


def lengths(n, seed=2):
    rng = random.Random(seed)
    return [min(2048, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(n)]


def plain_best_fit(own, capacity, open_bins):
    """(bin, offset) of each length by lists alone, and how many bins closed with space left."""
    open_, out, bins, closed = [], [], 0, 0  # [free, bin], the one touched last at the end
    for n in own:
        fits = [(free, -i) for i, (free, _) in enumerate(open_) if free >= n]
        free, number = open_.pop(-min(fits)[1]) if fits else [capacity, bins]
        bins += not fits
        out.append((number, capacity - free))
        if free > n:
            open_.append([free - n, number])
        if len(open_) > open_bins:
            open_.pop(-min((free, -i) for i, (free, _) in enumerate(open_))[1])
            closed += 1
    return out, closed


def test_packer_equals_plain_best_fit_at_the_querys_sizes():
    own = lengths(6000)
    want, closed = plain_best_fit(own, packing.SEQ_LEN, packing.OPEN_BINS)
    packer = packing.Packer(packing.SEQ_LEN)
    assert [packer.place(n) for n in own] == want
    assert closed > 100


def test_the_bound_costs_little():
    own = lengths(20_000)
    bounded, whole = packing.Packer(packing.SEQ_LEN), packing.Packer(packing.SEQ_LEN, 1 << 30)
    for n in own:
        bounded.place(n)
        whole.place(n)
    assert whole.open > 4 * bounded.open
    assert bounded.bins <= 1.001 * whole.bins and bounded.bins <= 1.02 * sum(own) / packing.SEQ_LEN


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, None)] * 4000 + [(1, "same text here")] * 2000, "doc_id long, text string").repartition(4)
    out = packing.pack(packing.saved(packing.pieces(docs, packing.default_tokenizer()), "pieces"), group_tokens=1000).collect()
    assert len(out) == 6000
    groups = {}
    for r in out:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) > 5 and max(groups.values()) < 2 * 6000 / len(groups)


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(1, "Hello big world, don't stop!", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 5000, "x"), (4, "word " * 5000, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Length string")
    return docs, packing.pack_documents(docs, packing.default_tokenizer())


def test_pieces_match_the_tokenizer(packed):
    from tokenizers import Tokenizer

    docs, out = packed
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((r.doc_id or -1, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == sorted(want)


def test_sequences_are_gapless_and_few(packed):
    by = {}
    for r in packed[1].collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for parts in by.values() for _, n in parts)
    assert len(by) == -(-total // 2048)


def test_sequences_hold_the_ids(packed):
    docs, out = packed
    got = packing.sequences(out, docs, packing.default_tokenizer()).collect()
    want = {}
    for r in out.collect():
        want[r.sequence_id] = want.get(r.sequence_id, 0) + r.length
    assert {r.sequence_id: len(r.ids) // 4 for r in got} == want


def test_word_cache_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer(), cache_words=5)
    for text in ("É à ́b ΑΣ Σ", "it's 12 34.5 <|endoftext|> A<|ENDOFTEXT|>", "a\x1fb c d", "日本語 テスト", "x" * 300, " \t\r\n", "ﬁ ǅ İ", "É, été. ÷x ß... Ñandú!! naïve%%% a_b _c_ x<|y Þ ÿ ÀÉ-ö A*** d'accord l'été, o's", "e\u0301tude é\u0301 a\u00adb"):
        got = own.ids(text.encode())
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == whole.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, packing.default_tokenizer()).count() == 0


def test_merges_equal_the_model():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(3)
    own = packing.Merges(tok.to_str())
    names = list(packing._byte_letters().values())
    words = ["".join(rng.choice("etaoinshrdlu" if rng.random() < 0.9 else names) for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["", "aaaaaaaaaaaa", "the"]
    for word, got in zip(words, own.ids(words), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == [t.id for t in tok.model.tokenize(word)] or not word, word
    assert own.ids([]) == [] and own.ids([""]) == [b""]
