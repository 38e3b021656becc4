import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import components, exact_dedup, simhash, substring_dedup

ROWS = [(1, "a b", "p"), (5, "a b", "q"), (3, None, "r"), (9, "", "s"), (2, "other", "t"), (7, "a b", "u"), (7, "a b", "u"), (None, "a b", "v"), (None, "lonely", "w")]


def _exact(rows):
    out = []
    for d, t, _ in rows:
        group = [x for x, u, _ in rows if (u or "") == (t or "")]
        ids = [x for x in group if x is not None]
        out.append((d, max(ids) if ids else None, len(group), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    found = exact_dedup.exact_duplicates(docs)
    got = found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == _exact(ROWS)
    assert found.where("kept").groupBy("text_sha256").count().where("count <> 1").count() == 0
    assert found.where("kept").count() == len({t or "" for _, t, _ in ROWS})
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_state_over_several_batches(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(4)
    found = exact_dedup.exact_duplicates(docs, files_per_batch=1).select("doc_id", "keep_id", "group_size", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == _exact(ROWS)


def test_texts_with_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text="text": F.unhex(F.lit("00ff")))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, got), key=str) == sorted([r[:3] for r in _exact(ROWS)], key=str)


def test_exact_stage_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, __k string")
    kept = exact_dedup.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t, _ in ROWS})


def _components(fps, radius=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_by_hand():
    import xxhash

    text = "The  QUICK brown\tFox É jumps"
    w = text.encode().split()
    low = [x.lower() for x in w]
    hs = [xxhash.xxh64_intdigest(b" ".join(low[k : k + 4]), 42) for k in range(3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 3)
    assert simhash.fingerprint("") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_forest_finds_every_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(m)) for k, m in ((0, 1), (5, 9), (60, 2), (7, 8))] + [base]))
    shard = np.zeros(len(fp), np.int64)
    pairs = {(int(a), int(b)) for x, y in simhash.Forest(shard, fp).search() for a, b in zip(x, y, strict=True)}
    assert pairs == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and int(fp[i] ^ fp[j]).bit_count() <= 4}


def test_links_with_shards_dealt_again(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    fps = sorted(fps)
    want = _components(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for limit in (1024, 4):
        roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, limit)).collect()}
        signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
        got = [roots.get(s, s) for s in signed]
        first = {}
        assert [first.setdefault(g, k) for k, g in enumerate(got)] == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501), (7, 7)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, 101)}, 501: 500}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, None), (2, ""), (8, "one two three four five six"), (8, "one two three four five six"), (None, "quite different words here now"), (5, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == [(2, 2), (3, 2), (5, 2), (8, 8), (8, 8)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_component_without_ids(spark):
    texts = ["one two three four five six", "quite different words here now", "and a third text of its own"]
    rows = [(None, t, "s") for t in texts] + [(None, t.upper(), "s") for t in texts] + [(7, "alone among all the others", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [r["text"].lower() for r in simhash.dedup_stage(spark, docs, "").collect()]
    assert sorted(kept) == sorted([*texts, "alone among all the others"])


def _substring(rows, n=20):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d, i: (d is not None, d or 0, i)
    first = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, key(d, i)), key(d, i))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < key(d, i):
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passages = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(4)]
    rows = [(k, " ".join(rng.choices(["x", "y", "zz", "w\n", rng.choice(passages), rng.choice(passages)[:45]], k=12))) for k in range(60)]
    rows += [(100, "p q " * 40), (101, "p q " * 40), (7, None), (200, ""), (None, passages[0]), (201, rows[3][1]), (202, " ".join(["lone"] * 19)), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _substring(rows)
    for block in (40, 1 << 20):
        monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
        got = substring_dedup.remove_repeats(docs, full=False).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    full = substring_dedup.remove_repeats(docs).where("doc_id = 201").first()
    assert full["n_removed"] == sum(s["end"] - s["start"] for s in full["removed"])


def test_one_short_phrase_in_every_text(spark, monkeypatch):
    # a phrase shorter than a window puts all its windows on one anchor; they are spread over shards
    rng = random.Random(9)
    phrase = " ".join(f"p{k}" for k in range(15))
    word = lambda: f"{rng.randrange(10**9):x}"
    rows = [(k, " ".join([*(word() for _ in range(30)), phrase, *(word() for _ in range(30))])) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "HOT", 16)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, full=False).collect()), key=str) == _substring(rows)
    folder, sizes = substring_dedup.scratch(spark, "hot"), []
    first = substring_dedup._answered(substring_dedup.map_in_arrow(substring_dedup._index(docs, folder, 32, 0).repartitionById(32, "shard"), substring_dedup._answer_anchors(16), substring_dedup.SENT))
    for r in substring_dedup.map_in_arrow(first, substring_dedup._windows(folder, 32, 0), substring_dedup.SENT).groupBy("shard").agg(F.sum(F.length("payload")).alias("n")).collect():
        sizes.append(r["n"])
    assert max(sizes) < 3 * sum(sizes) / 32


def test_words_decide_not_hashes(spark, monkeypatch):
    """Hashes of a few bits take different words for equal; the words show it, and other hashes are tried."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(25))) for k in range(6)] + [(9, " ".join(f"w1x{j}" for j in range(25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 20)
    seen, parse = [], substring_dedup._parsed

    def poor(docs, folder, shards, full, seed):
        """Under the first seed, the claim of document 9 is moved to the document before the one that it repeats."""
        good = parse(docs, folder, shards, full, seed)
        seen.append(seed)
        if seed:
            return good
        other = good.select(F.explode("claims").alias("c")).select("c.ref").first()["ref"]
        moved = F.transform("claims", lambda c: F.struct(F.lit(other).alias("ref"), (c["word"] + 1).alias("word"), c["size"].alias("size"), c["digest"].alias("digest")))
        return substring_dedup.written(good.withColumn("claims", moved), "poor")

    monkeypatch.setattr(substring_dedup, "_parsed", poor)
    got = substring_dedup.remove_repeats(docs, full=False).collect()
    assert seen == [0, 1] and sorted(map(tuple, got), key=str) == _substring(rows)
    monkeypatch.setattr(substring_dedup, "SEEDS", 1)
    with pytest.raises(RuntimeError):
        substring_dedup.remove_repeats(docs, full=False)


def test_factors_follow_a_reference():
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage), " ".join(["a", *passage[5:40], "b", *passage[30:55], *passage[:22]])]
    block = substring_dedup.Block([1, 2], texts)
    inside = block.first_inside()
    start, size, of, to = (x.tolist() for x in substring_dedup.factors(block, np.where(inside >= 0, 0, -1), inside))
    assert list(zip(start, size, to, strict=True)) == [(61, 35, 5), (97, 25, 30), (122, 22, 0)] and set(of) == {0}
