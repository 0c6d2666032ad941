import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import bpe, packing, wordcache

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n", "Hello world", "  two  spaces\n\n next\t\ttab ", "don't we'll I'M", "naïve café ÉCOLE ß", "a b c　d\u0085e\x1cf\x1fg",
    "x <|endoftext|> y  <|endoftext|>", "<|startoftext|>a<|endoftext|>", "日本語 と 中文", "emoji 😀😀 é ́x", "12345 3.14 --- !!!",
    "word " * 3000, "z" * 20000, "ΣΑΣ ΟΔΟΣ Straße İI", "tail space ", "\r\n windows\r\n", "a  \n  b", "Hello world", "v\x0bw\x0cx", "q r​s﻿",
]


def direct(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)


def test_encode_and_decode(spark):
    tok, want = direct(BYTE)
    for frequent in (300_000, 5, 0):
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
        got = {r.doc_id: r.ids for r in bpe.encode(docs, BYTE, frequent=frequent).collect()}
        assert [got[i] for i in range(len(TEXTS))] == want
    rows = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    for i, ids in enumerate(want):
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_decode_of_broken_bytes():
    tok = Tokenizer.from_file(BYTE)
    pieces = bpe.piece_table(BYTE)
    for ids in ([127, 0], [162, 222], list(range(170, 256)), [50256, 5]):
        assert b"".join(pieces[i] for i in ids).decode("utf-8", "replace") == tok.decode(ids, skip_special_tokens=False)


def test_empty(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_chunk_table_equals_the_tokenizer():
    import numpy as np

    _, want = direct(WORD)
    for sizes in ((400_000, 1_000_000), (5, 5)):
        table = wordcache.ChunkTable(WORD, *sizes)
        assert [np.frombuffer(b, "<u4").tolist() for t in TEXTS for b in table.encode([t])] == want


def test_packing(spark):
    import zlib

    import numpy as np

    _, want = direct(WORD)
    rows = packing.pack(frame(spark), WORD, capacity=64, block_items=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in enumerate(want):
        ids = np.array([*ids, 0], dtype="<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [
            (k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))
        ]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1


def test_evolution_beats_or_equals_best_fit():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(5):
        sizes = rng.integers(200, 700, 120)
        bin_of = np.zeros(120, np.int64)
        packing.best_fit(sizes, 1000, np.arange(120), bin_of, {}, 0)
        plain = len(packing.Packing(bin_of, sizes).loads)
        best = packing.evolve(sizes, 1000, [], np.random.default_rng(2), 40)
        assert best.loads.max() <= 1000 and best.loads.sum() == sizes.sum() and len(best.loads) <= plain


def test_decode_in_a_plan(spark):
    """Ids in any order, broken bytes and special tokens among them."""
    import random

    from pyspark.sql import functions as F

    tok, rng = Tokenizer.from_file(BYTE), random.Random(1)
    rows = [[rng.randrange(tok.get_vocab_size()) if rng.random() < 0.3 else rng.randrange(170, 256) for _ in range(30)] for _ in range(300)]
    df = spark.createDataFrame([*enumerate(rows), (300, []), (301, None)], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", bpe.decode(F.col("ids"), BYTE).alias("t")).collect()}
    assert [got[i] for i in range(300)] == [tok.decode(x, skip_special_tokens=False) for x in rows] and (got[300], got[301]) == ("", None)


def test_evolution_works_at_production_settings(monkeypatch):
    """Blocks start from next-fit groupings over the bound, and crossover brings them to it."""
    import numpy as np

    calls, cross = [], packing.offspring
    monkeypatch.setattr(packing, "offspring", lambda *a: calls.append(1) or cross(*a))
    rng = np.random.default_rng(4)
    for n in (packing.BLOCK, 700):
        sizes = np.minimum(2047, rng.lognormal(6, 1, n).astype(np.int64) + 1)
        seed = packing.next_fit(sizes, packing.CAPACITY, rng)
        assert seed.loads.max() <= packing.CAPACITY and len(seed.loads) > packing.floor(sizes, packing.CAPACITY)
        calls.clear()
        best = packing.evolve(sizes, packing.CAPACITY, [], rng, packing.GENERATIONS)
        assert calls and best.loads.max() <= packing.CAPACITY and best.loads.sum() == sizes.sum()
        assert len(best.loads) <= packing.floor(sizes, packing.CAPACITY) + 1


def test_sequences_of_real_documents(spark):
    """Islands, migration and the pool together reach the bound within a sequence."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORD).collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_migration_between_islands(spark):
    """Blocks that miss the bound go through all epochs; nothing is lost on the way."""
    rng_sizes = [(i, 700 + 13 * (i % 40)) for i in range(150)]
    items = spark.createDataFrame(rng_sizes, "key long, length long")
    placed = packing._pack_round(items, 2048, 50, 2, 3, 4).collect()
    loads = {}
    for r in placed:
        loads[r.bin] = loads.get(r.bin, 0) + r.length
    assert sorted((r.key, r.length) for r in placed) == rng_sizes and max(loads.values()) <= 2048


def test_references_spell_the_words_of_the_pattern():
    import random

    import pyarrow as pa

    rng, specials, places = random.Random(5), ("<|endoftext|>",), {" a": 0, "b": 1, ".": 2}
    signs = ["a", "b", "é", "文", " ", "  ", "\n", "\t", "\xa0", "\x85", " ", " ", "　", "\x1c", ".", "!", "-", "1", "\U0001f600"]
    for _ in range(400):
        texts = [None, *("".join(rng.choices(signs, k=rng.randrange(14))) + "<|endoftext|>" * (rng.random() < 0.05) for _ in range(rng.randrange(6)))]
        refs, sizes, own = bpe.refer(pa.array(["z  q", *texts], pa.string()).slice(1), places, specials)
        names, at = list(places) + list(own), 0
        for text, n in zip(texts, sizes):
            want = []
            for word in bpe.split_words(text, specials):
                want += [word] if word in places or specials[0] in word else bpe.cut_word(word)
            assert [names[i] for i in refs[at : at + n]] == want
            at += n
        assert at == len(refs)


def test_words_encoded_together_equal_words_encoded_alone():
    import random

    odd = ["İstanbul", "ΑΣ", "ﬁ", "ß", "文字", "é", "é", "a1", "'s", "<|endoftext|>", "ŉ", "x" * 5000, "½", "ª", "Ａ", "가", "가", "क्षि", "plain", "words"]
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 400):
        parts = rng.choices(odd, k=n)
        assert wordcache.encode_words(WORD, parts) == wordcache.as_bytes(wordcache.encode_all(WORD, parts))
    # many groups of letters only, none of which holds an odd word
    parts = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(1000)]
    assert wordcache.encode_words(WORD, parts) == wordcache.as_bytes(wordcache.encode_all(WORD, parts))
    # a tokenizer whose pieces mark no word ends gets each part alone
    assert wordcache.encode_words(BYTE, parts) == wordcache.as_bytes(wordcache.encode_all(BYTE, parts))


def test_words_are_cut_like_one_word():
    import pyarrow as pa

    words = ["a.", "a", "..", "é!?", "²,", "文。.", "9%", "-.", "<|endoftext|>.", "x" * 300 + "...", "\x1c."]
    parts, two = bpe.cut_words(pa.array(["skip", *words]).slice(1), ("<|endoftext|>",))
    want = [(w,) if "<|endoftext|>" in w else bpe.cut_word(w) for w in words]
    assert parts.to_pylist() == [p for w in want for p in w] and two.tolist() == [len(w) == 2 for w in want]
    assert bpe.cut_words(pa.array([], pa.string()), ())[0].to_pylist() == []
