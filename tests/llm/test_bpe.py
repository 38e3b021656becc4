import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracemill.llm import binary_tokens, bpe

TEXTS = [
    None, "", "   ", "\n\t\x0b", "a <|endoftext|>b x<|startoftext|>", "ﬁ İstanbul Ünï été x y", "\x00 a\x1c\x1db 漢字 😀😀!! don't we'LL '''s !!'s 12ab_c ½ ª µm",
    "Σας ΟΔΟΣ ǅ", "<|endof text|> <|", "aaaa aaaaaaa lolololol", "x" * 3000, "é  nbsp em", "the quick brown fox " * 50, "ÀÉ×÷ß ÿÿ", "<b>it's</b>",
]


@pytest.fixture(scope="module")
def path():
    return bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def _library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_speculation_equals_the_library(path, library):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéßthing'.,0", k=rng.randint(1, 14))) for _ in range(3000)]
    texts = TEXTS + [" ".join(words[k : k + 30]) for k in range(0, 3000, 30)]
    e = bpe.Encoder(path, lambda ids: ids)
    got = [[i for c in chunks for i in c] for chunks in e.texts(texts)]
    assert got == [_library_ids(library, t) for t in texts]


def test_pair_test_agrees_with_merging(path):
    v = bpe.Vocabulary(path)
    rng = random.Random(3)
    tokens = [t for t in v.ids if not t.endswith(v.suffix) and len(t) < 6]
    closing = [t for t in v.ids if t.endswith(v.suffix) and len(t) < 9 and t != v.suffix]
    pairs = [(rng.choice(tokens), rng.choice(closing)) for _ in range(2000)]
    good = v.compatible(np.array([v.ids[a] for a, _ in pairs]), np.array([v.ids[b] for _, b in pairs]))
    for (a, b), ok in zip(pairs, good, strict=True):
        if v.open.get(a) is not None and v.closing.get(b[: -len(v.suffix)]) is not None:
            assert ok == (v.merge_word(a + b[: -len(v.suffix)]) == [v.ids[a], v.ids[b]]), (a, b)


def test_batched_merging_equals_single(path):
    v = bpe.Vocabulary(path)
    words = ["thing", "aaaaaaa", "lolololo", "b", "internationalization", "q" * 60]
    assert v.merge_words(words) == [v.merge_word(w) for w in words]


def test_queries_against_the_library(spark, path, library):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for k, t, _ in rows:
        ids = _library_ids(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, path).collect()), key=str) == sorted(want, key=str)
    full = {(r["doc_id"], tuple(r["ids"])): r["decoded"] for r in bpe.encode(docs, path).collect()}
    assert full == {(k, tuple(ids)): library.decode(ids, skip_special_tokens=False) for k, t, _ in rows for ids in [_library_ids(library, t)]}
    assert bpe.digests(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777, dtype=np.uint64).astype(np.uint32)
    data = binary_tokens.pack(ids, bits)
    assert len(data) == -(-777 * bits // 8)
    assert (binary_tokens.unpack(data, bits, 777) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (1, 70_000, 5, 131_072, 2)]
    w = binary_tokens.Writer(f"file://{tmp_path}/a.tok", 5000)
    for k, d in enumerate(docs):
        w.add(k, d)
    total = w.close()
    f = binary_tokens.TokenFile(f"file://{tmp_path}/a.tok")
    every = np.concatenate(docs)
    assert total == len(every) and f.bits == 13
    for a, b in ((0, 1), (65_530, 65_540), (0, total), (total - 3, total), (5, 5)):
        assert (f.read(a, b) == every[a:b]).all()
    assert [(d, first, ids.tolist()) for d, first, ids in f.documents()] == [(k, sum(map(len, docs[:k])), d.tolist()) for k, d in enumerate(docs)]


def test_token_files(spark, path, library, tmp_path):
    rows = [(k * 7 % 31, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (100, "far"), (100, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = binary_tokens.write_tokens(docs, f"file://{tmp_path}/t", path, files=3)
    got = [tuple(r) for r in binary_tokens.read_tokens(files, f"file://{tmp_path}/t").orderBy("start").collect()]
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*_library_ids(library, t), binary_tokens.END_ID]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert binary_tokens.read_tokens(binary_tokens.write_tokens(docs.limit(0), f"file://{tmp_path}/e", path, 2), f"file://{tmp_path}/e").count() == 0


def test_files_are_alike_whatever_the_ids(spark, path, tmp_path):
    import os

    least, most = -(1 << 63), (1 << 63) - 1
    ids = [least, most, 4 * 10**18, *range(4000), *([None] * 2000), *([17] * 2000)]
    docs = spark.createDataFrame([(d, f"text number {k} of these") for k, d in enumerate(ids)], "doc_id long, text string").repartition(5)
    files = binary_tokens.write_tokens(docs, f"file://{tmp_path}/t", path, files=8)
    sizes = [os.path.getsize(f"{tmp_path}/t/{n}") for n in os.listdir(tmp_path / "t")]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    got = [r["doc_id"] for r in binary_tokens.read_tokens(files, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert got == sorted(ids, key=lambda d: (d is not None, d or 0))
