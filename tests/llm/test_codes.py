"""Vector codes, SentencePiece and spelling variants against brute force and the library, odd rows included."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from tracemill.llm import sentencepiece_bpe as sp
from tracemill.llm import spelling, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, n long, x int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(k[2]) for k in kept)
    if not sizes:
        return []
    dims = max(sizes, key=lambda n: (sizes[n], n))
    kept = [k for k in kept if len(k[2]) == dims]
    width = dims // parts
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[2]))
    cut = [[k[2][p * width : (p + 1) * width] for p in range(parts)] for k in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    return [(i, code, error, total[label], digest) for i, label, code, error in out]


def found_codes(df):
    return [tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def test_codes_of_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([-0.5, 0.25, rnd.gauss(0, 0.3)]) for _ in range(32)], rnd.choice([1, 1, 1, None, 2]), "x") for k in range(90)]
    rows += [rows[3], rows[3], (None, rows[4][1], 7, None)]
    rows += [(200, None, 1, None), (201, [0.1] * 31 + [None], 1, None), (202, [float("nan")] * 32, 1, None), (203, [float("inf")] * 32, 1, None), (204, [0.5] * 16, 1, None), (205, [], 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    assert sorted(found_codes(df), key=str) == sorted(brute_codes(rows), key=str)


def test_codes_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(k, [k / 4] * 16, None) for k in range(3)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(found_codes(df)) == sorted(brute_codes(rows))
    assert found_codes(df.limit(0)) == []
    assert found_codes(spark.createDataFrame([(1, None, "a")], schema)) == []
    with pytest.raises(ValueError):
        found_codes(spark.createDataFrame([(1, [0.5] * 17, "a")], schema))
    big = found_codes(spark.createDataFrame([(1, [3e38] * 16, "a"), (2, [-3e38] * 16, "a")], schema))
    assert [r[2] for r in big] == [0, 0]


def test_cells_keep_the_nearest_entries():
    rnd = np.random.default_rng(1)
    for width, span in itertools.product((1, 3, 8), (2, 40, 5000)):
        entries, x = rnd.integers(-span, span, (64, width)), rnd.integers(-2 * span, 2 * span, (500, width))
        distance = ((x[:, None] - entries[None]) ** 2).sum(2)
        entry, least = vector_codes.Cells(entries).nearest(x)
        assert (least == distance.min(1)).all() and (entry == distance.argmin(1)).all()


def test_sentencepiece_as_the_library(spark):
    library = sp.encoder(sp.model_path()).model.library
    rnd = random.Random(2)
    parts = [" ", "  ", "▁", "\n", "\t", "\r", "a", "th", "ing", "é", "é", "日本", "😀", "<s>", "</s>", "<0x0A>", "<unk>", "12", "\x00", "　", "ÿ", "aaa", "�"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(800)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x2500, 0x2600), rnd.randrange(0x4E00, 0x9000), rnd.randrange(0x1F000, 0x1F900)])) for _ in range(30)) for _ in range(200)]
    texts += [None, "", " ", "\n", "x" * 20_000, "word " * 5_000, "same", "same"]
    rows = [(k if k % 9 else None, t, "en", "w", 1, 2) for k, t in enumerate(texts)]
    found = sp.encode(spark.createDataFrame(rows, DOCS).repartition(3), sp.model_path()).collect()
    want = Counter()
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        text = library.decode(ids)
        want[(k, len(ids), tuple(ids), text, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert sp.encode(spark.createDataFrame([], DOCS), sp.model_path()).count() == 0


def test_sentencepiece_agendas_agree_and_are_checked():
    model = sp.encoder(sp.model_path()).model
    chunks = ["▁the", "▁" * 40, "\n", "▁international", "日", "▁aaaaaaaaab", "▁𐍈x"]
    ids, starts = model.agendas(chunks)
    assert [ids[starts[k] : starts[k + 1]].tolist() for k in range(len(chunks))] == [model.agenda(c) for c in chunks]
    model.check(chunks, ids, starts)
    ids[0] += 1
    with pytest.raises(RuntimeError):
        model.check(chunks, ids, starts)


def brute_words(rows):
    n = Counter()
    for r in rows:
        text = r[1] or ""
        run = ""
        for c in text + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += len(run) >= 7
            run = ""
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    partners = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, vs in partners.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(partners[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def found_variants(df, **kw):
    return sorted((tuple(r) for r in spelling.variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("group", [2, 50_000])
def test_variants_against_brute_force(spark, group):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abÀÿ") for _ in range(rnd.choice([7, 8, 9, 12]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "ababababab", "x" * 3000]
    words = set(base)
    for w in base[:-1] * 3:
        k = rnd.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rnd.choice("abc") + w[k:], w[:k] + rnd.choice("abc") + w[k + 1 :]}
    words = sorted(words) + ["x" * 2999]
    rows = []
    for k, w in enumerate(words):
        times = rnd.choice([1, 2, 2, 3, 25, 400])
        rows.append((k, " ".join([w.upper() if rnd.random() < 0.1 and w.isascii() else w] * times), "en", "q", 1, 1))
    rows += [(None, "aaaaaaa ababababab1ababababab", None, None, None, None)] * 2 + [(1, None, "", "", 0, 0), (2, "", "", "", 0, 0), (3, "×÷×÷×÷× Ā ×÷×÷×÷×", "", "", 0, 0)]
    want = brute_variants(brute_words(rows))
    assert sum(w[1] is not None for w in want) > 5
    assert found_variants(spark.createDataFrame(rows, DOCS), group=group) == want


def test_variants_follow_chains_and_break_ties(spark):
    counts = {"abcdefg": 3, "abcdefgh": 30, "abcdefghi": 300, "abcdefghj": 300, "zbcdefghi": 2999}
    rows = [Row(word=w, n=n) for w, n in counts.items()]
    found = {r["word"]: (r["form"], r["n_near"]) for r in spelling.forms(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found == {"abcdefg": ("abcdefgh", 1), "abcdefgh": ("abcdefghi", 3), "abcdefghi": (None, 3), "abcdefghj": (None, 2), "zbcdefghi": (None, 1)}


def test_no_words(spark):
    assert found_variants(spark.createDataFrame([], DOCS)) == []
    assert found_variants(spark.createDataFrame([(1, "single words occuring once", "", "", 0, 0)], DOCS)) == []


def test_pairs_are_found_once_in_small_chunks(spark):
    words = spark.createDataFrame([("".join(x) + "tail", 2) for x in itertools.product("abc", repeat=4)], "word string, n long")
    found = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(words, group=5, chunk=7).collect()]
    all_words = [r["word"] for r in words.collect()]
    want = [(a, b) for a, b in itertools.combinations(sorted(all_words), 2) if near(a, b)]
    assert sorted(found) == sorted(want)
