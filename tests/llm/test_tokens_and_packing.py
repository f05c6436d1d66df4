import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import corpus, docs, no_docs  # noqa: F401  (fixtures)

from tallyspark.llm import packing, token_files
from tallyspark.llm._tokens import encoder, vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def whole_ids(path, text):
    from tokenizers import Tokenizer
    return np.asarray(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_words_equal_the_library(path, corpus):
    e = encoder(path)
    texts = [t for _, t in corpus if t and len(t) < 5000]
    texts += ["a  b\n\n c ", "\n", " ", "x\ty", "don't STOP!!!\nIt's 12345 3.14", "café naïve — “quoted”…", "é İ ß ſ", "<|endoftext|>", "a\r\nb", "tail \n"]
    for t in texts:
        for _ in range(2):
            assert e.encode(t) == e.whole(t), t


def test_many_texts_at_once_equal_each_alone(monkeypatch):
    import random

    import tallyspark.llm._tokens as T
    rng = random.Random(2)
    parts = ["word", "Naïve", "it's", "12,5", "x", " ", "\n", "\n\n", "  ", "\t", "a.b", "--", "<|endoftext|>", "你好", "don't", "–", "\r\n"]
    texts = [None, "", " ", "\n", "one", " one", "one ", "one\n", "\none", "a b\nc d", "a \nb", "\n\n", "'s 's"]
    texts += ["".join(rng.choice(parts[:12]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(100)]
    texts += [" ".join(rng.choice(parts[:5]) for _ in range(n)) for n in (1, 2, 3, 500)] * 2
    for size in (4_000_000, 50):
        monkeypatch.setattr(T, "SLAB_CHARS", size)
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            e = encoder(vocabulary(name))
            assert e.encode_many(texts) == [e.encode(t) for t in texts]
            assert e.encode_many([]) == [] and e.encode_many([None, ""]) == [b"", b""]
    assert all(e.encode(t) == e.whole(t) for t in texts if t)


def test_words_of_a_vocabulary_without_white_space_are_cut_together():
    from tallyspark.llm._tokens import Encoder
    e = Encoder(WORD)
    texts = ["One two\tTHREE\r\n\nfour  it's 3.14 ", " ", "\n\t", "ÀB c–d e\n", "word", None, "", "tail  word"] * 3
    assert e.encode_many(texts) == [e.whole(t) if t else b"" for t in texts]
    assert e.pieces and not e.first  # different pieces are kept once, no text is taken word by word


def test_pieces_of_the_byte_vocabulary_end_where_its_words_do():
    """Words beside many marks and numbers are kept once each, not once for each combination."""
    import random

    from tallyspark.llm._tokens import Encoder
    e, rng = Encoder(BYTE), random.Random(4)
    words = ["alpha", "Beta", "gamma's", "x", "né", "it", "'s", "'sam", "we're", "d'"]
    marks = ["", ",", ".", "!?", "--", "(", ")", "1", "23", "'", ",'", "',", "é", "–", "÷", "×", "’"]
    texts = ["".join(rng.choice([" ", "\n", ""]) + rng.choice(marks) + rng.choice(words) + rng.choice(marks) for _ in range(30)) for _ in range(400)]
    assert e.encode_many(texts) == [e.whole(t) if t else b"" for t in texts]
    e = Encoder(BYTE)
    e.encode_many([f" alpha{i}, beta.{i}! ({i})" for i in range(300)])
    assert len(e.pieces) < 300 + 20


@pytest.mark.parametrize("ids", [[], [5], [0, 2**32 - 1], list(range(3000)), [7] * 1024, [1, 2, 3] * 700 + [4_000_000_000] * 5])
def test_blocks_round_trip(ids):
    a = np.asarray(ids, dtype="<u4")
    got = [token_files.decode_block(memoryview(b)) for b in token_files.encode_blocks(a)]
    assert np.array_equal(np.concatenate(got) if got else np.empty(0, np.uint32), a)


def test_outliers_are_exceptions():
    a = np.asarray([3] * 1000 + [100_000] * 24, dtype="<u4")
    block, = token_files.encode_blocks(a)
    assert len(block) < 200  # width 0, 24 exceptions
    assert np.array_equal(token_files.decode_block(memoryview(block)), a)


def test_token_files_hold_every_document(spark, docs, corpus):
    manifest = token_files.write_token_files(docs, WORD, file_ids=20_000)
    got = [tuple(r) for r in token_files.read_token_files(manifest).collect()]
    want, at = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    ids = {t: whole_ids(WORD, t) for t in {t for _, t in corpus}}
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in corpus), key=str)
    got.sort(key=lambda r: r[1])
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert manifest.count() > 1


def test_a_range_of_ids_is_read_from_its_blocks(spark, docs, corpus):
    m = token_files.write_token_files(docs, WORD).orderBy("n_tokens", ascending=False).first()
    fs, path = token_files._open(m["path"])
    with fs.open_input_file(path) as f:
        data = token_files.TokenFile(f.read_buffer())
    everything = data.ids(0, data.n_ids)
    assert np.array_equal(data.ids(1500, 2000), everything[1500:3500])


def test_no_documents(spark, no_docs):
    assert token_files.read_token_files(token_files.write_token_files(no_docs, WORD)).count() == 0
    assert packing.pack(no_docs, BYTE).count() == 0


def check_pieces(pieces, lengths, size):
    """Every id once, no gap in a sequence, none over the size."""
    docs, bins = defaultdict(list), defaultdict(list)
    for d, start, n, b, at in pieces:
        assert n > 0
        docs[d].append((start, n))
        bins[b].append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(docs[d]):
            assert start == at
            at += k
        assert at == n
    for items in bins.values():
        at = 0
        for start, k in sorted(items):
            assert start == at
            at += k
        assert at <= size
    return [sum(k for _, k in items) for items in bins.values()]


@pytest.mark.parametrize("seed", range(5))
def test_packing_leaves_one_open_sequence(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 5000, 200)] + [2048, 4096, 1, 1]
    filled = check_pieces(packing.pack_lengths(lengths), lengths, 2048)
    assert sum(x < 2048 for x in filled) <= 1


def test_first_fit_takes_the_first_bin_with_room():
    tree = packing.RoomTree(4, 10)
    assert [tree.first_fit(n) for n in (6, 5, 4, 5, 1)] == [0, 1, 0, 1, 2]


def test_pieces_of_the_corpus(spark, docs, corpus):
    got = packing.pack(docs, BYTE, group_chars=100_000).collect()
    ids = {t: whole_ids(BYTE, t) for t in {t for _, t in corpus}}
    want = sorted((d is None, d or 0, len(ids[t])) for d, t in corpus)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by_sequence.values():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in got) == sum(n for *_, n in want)
    assert len({r["group_no"] for r in got}) > 1
    single = {d: t for d, t in corpus if d is not None and [x for x, _ in corpus].count(d) == 1}
    for r in got:
        if r["doc_id"] in single:
            a = ids[single[r["doc_id"]]]
            assert r["doc_tokens"] == len(a)
            assert r["ids_crc32"] == zlib.crc32(a[r["start"]:r["start"] + r["length"]].tobytes())
