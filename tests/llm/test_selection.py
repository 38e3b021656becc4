import collections
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tracemill.llm import html_extract, mixing, quality, sharding, toxicity


def _features(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x " * 400, "one\none\n\n two \ntwo", "é# <b>|&\x0bq", "a a a a", "the quick and the dead of it " + " ".join(f"w{k}" for k in range(80)), "😀 ok"]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] + [(3, texts[3], 9)], "doc_id long, text string, n_words int")
    found = quality.judge(docs).select(*quality.OUT).collect()
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in found)
    assert got == sorted([(k, *_features(t)) for k, t in enumerate(texts)] + [(3, *_features(texts[3]))])
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
    assert [r["doc_id"] for r in found if r["kept"]] == [8]
    stage = quality.filter_stage(spark, docs, "")
    assert stage.columns == docs.columns and [r["doc_id"] for r in stage.collect()] == [8]
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_uses_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    rows = [(k, ["a", "b", None, "d", "e"][(k * k) % 5 if k % 3 else 0], " ".join(["w"] * (k % 37))) for k in range(600)]
    rows += [(600, "f", None), (601, "f", ""), (None, "a", "x y z"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("clash"))
    got = mixing.sample(docs).collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes)
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(str, mixing.sample(docs).collect())) == sorted(map(str, got))
    assert mixing.sample(docs.limit(0)).count() == 0
    mixed = mixing.mix_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    assert mixed.where("text <> ''").count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_mixing_is_unequal_and_native(spark):
    rows = [(k, "s", "w " * (1 if k % 2 else 200)) for k in range(4000)] + [(k, "t", "w " * 100) for k in range(4000, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.sample(docs)
    assert "Python" not in found._jdf.queryExecution().toString()
    per = {r["size"]: r["copies"] for r in found.where("source = 't' OR source = 's'").groupBy("source", "size").agg(F.avg("copies").alias("copies")).where("source = 't' OR size > 0").collect() if r["size"] != 100}
    assert per[200] >= per[1]


def test_lookup_table_by_hand():
    names = sharding.shard_names(7)
    owner = sharding.lookup_table(names, 101)
    word = lambda n, use: int.from_bytes(hashlib.sha256(f"{use}:{n}".encode()).digest()[:8], "big")
    prefer = [[(word(n, "offset") + k * (word(n, "skip") % 100 + 1)) % 101 for k in range(101)] for n in names]
    want, turn = {}, 0
    while len(want) < 101:
        k = turn % 7
        want.setdefault(next(s for s in prefer[k] if s not in want), k)
        turn += 1
    assert owner == [want[s] for s in range(101)]
    assert max(collections.Counter(owner).values()) - min(collections.Counter(owner).values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = sharding.shard_names(20)
    a, b = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.1 * 4099
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4098)


def test_placement(spark, tmp_path):
    rows = [(k, "x") for k in range(2000)] + [(None, "y"), (None, "z"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, slot string")
    placed = sharding.place(docs, F.col("doc_id"), sharding.shard_names(4), 1009, slot="at", shard="shard")
    owner = sharding.lookup_table(sharding.shard_names(4), 1009)
    for r in placed.collect():
        key = "\x00null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["at"] == int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 1009 and r["shard"] == owner[r["at"]]
    assert "Python" not in placed._jdf.queryExecution().toString()
    sharding.write_shards(docs, F.col("doc_id"), sharding.shard_names(4), str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert sorted(os.listdir(tmp_path / "s"))[1:] == [f"shard={n}" for n in sharding.shard_names(4)] or len([d for d in os.listdir(tmp_path / "s") if d.startswith("shard=")]) == 4


def test_toxicity(spark):
    import random

    rng = random.Random(1)
    neutral = [f"word{k}" for k in range(300)]
    bad = ["vile", "rotten", "foulest"]

    def text(n_bad):
        w = rng.choices(neutral, k=60)
        for _ in range(n_bad):
            w.insert(rng.randrange(60), rng.choice(bad))
        return " ".join(x + "." * (k % 10 == 9) for k, x in enumerate(w))

    rows = [(k, text(0 if k % 4 else rng.randint(2, 8)), int(k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "vile rotten vile foulest"), (None, "nothing")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]] + [(5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_sample(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = rows[400:]
    assert sum(got[k]["toxic"] == bool(y) for k, _, y in held) >= 0.97 * len(held)
    assert got[902]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"] and len(got) == 604 and got[900]["severity"] == 0
    assert all(0 <= r["severity"] <= 2 for r in got.values()) and model.thresholds[0] < model.thresholds[1]
    many = [r["severity"] for k, r in got.items() if k is not None and k < 600 and k % 4 == 0]
    assert sum(many) / len(many) > 1
    none = toxicity.score(docs, toxicity.fit_sample(docs, labels.where("toxic = 0")))
    assert none.where("toxic OR severity <> 0").count() == 0


def test_ordinal_fit_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (400, 1)).astype(np.float32)
    score, noise = 1.3 * x[:, 0], rng.logistic(size=400)
    grade = (score + noise > 2).astype(int) + (score + noise > 4)
    # the gradient, by differences
    at = np.array([0.7, 1.5, 3.1])
    value, gradient = toxicity.loss(at[:1], at[1:], x, grade)
    for k in range(3):
        up, down = at.copy(), at.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        assert gradient[k] == pytest.approx((toxicity.loss(up[:1], up[1:], x, grade)[0] - toxicity.loss(down[:1], down[1:], x, grade)[0]) / 2e-5, abs=1e-5)
    # the likelihood, from its definition, and its maximum, by trying
    p = lambda z: 1 / (1 + np.exp(-z))
    over = np.stack([p(at[0] * x[:, 0] - at[1]), p(at[0] * x[:, 0] - at[2])], 1)
    mine = np.where(grade == 0, 1 - over[:, 0], np.where(grade == 1, over[:, 0] - over[:, 1], over[:, 1]))
    assert value == pytest.approx(-np.log(mine).mean() + toxicity.PENALTY / 2 * 0.49)
    w, t = toxicity.fit(x, grade)
    best = min(toxicity.loss(np.array([a]), np.array([b, c]), x, grade)[0] for a, b, c in itertools.product(np.arange(0.9, 1.8, 0.05), np.arange(1, 3, 0.1), np.arange(3, 5, 0.1)))
    assert toxicity.loss(w, t, x, grade)[0] <= best + 1e-3 and t[0] < t[1]
    m = toxicity.Model({"bad": float(w[0])}, (float(t[0]), float(t[1])))
    for n in range(1, 5):
        s = m.score(toxicity.Counter({"bad": n}))
        assert m.severity(s) == pytest.approx([p(w[0] * n - t[0]), p(w[0] * n - t[1])])


def test_grades_come_from_the_other_half(spark, monkeypatch):
    sample = spark.createDataFrame(
        [(True, 0, [["vile", "x"], ["rotten"], ["vile"]]), (True, 0, [["rotten"], ["x"]]), (True, 1, [["vile"], ["rotten"]]), (True, 1, [[]]), (False, 1, [["rotten"]] * 9)],
        "toxic boolean, half int, sentences array<array<string>>",
    )
    # half 0 is graded by half 1's words and the other way round; the median toxic text has one toxic sentence
    monkeypatch.setattr(toxicity, "tied_terms", lambda s: {1: ["vile", "vi-"], 0: ["rotten"]}[s.first()["half"]])
    assert sorted((r["toxic"], r["half"], r["bad"], r["grade"]) for r in toxicity.graded(sample).collect()) == [(False, 1, 9, 0), (True, 0, 0, 1), (True, 0, 2, 2), (True, 1, 0, 1), (True, 1, 1, 2)]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "same words") for k in range(6)] + [(2, "another text"), (0, "same words")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (4, None), (1, 1)], "doc_id long, toxic int")
    assert sorted(r["toxic"] for r in toxicity.sample_terms(docs, labels).collect()) == [False, False, True, True, True]
    assert toxicity.sample_terms(docs, labels, 2).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div><header><h1>Site</h1></header>
<article><h1>A &amp;  B</h1><p><b>One<br>two<p>th<i>r</i>ee&nbsp;4 &lt;x&gt;</p><aside>side</aside><form>f<input></form><div class=cookie-notice>c</div>
<section id="comments"><article>said</article></section><pre>a
 b</pre></article><div class="related"><article class="teaser related">r</article></div><footer>&copy; x</footer>"""


def test_article_text():
    assert html_extract.extract_group([1], [PAGE]) == ["A & B One two three 4 <x> a b"]


def test_header_of_an_article_goes():
    assert html_extract.extract_group([1], ["<article><header><p>by someone</p></header><h1>Title</h1><p>text</p></article>"]) == ["Title text"]


def test_pages_without_an_article():
    pages = [
        "<body><div>Home About Contact Us Now Here</div><div>Story one &amp; only</div><div class=comments>bad</div>",
        "<body><div>Home About Contact Us Now Here</div><div>Second <b>st</b>ory</div><footer>x</footer>",
        "<main><p>kept</p></main><p>not kept</p>",
        "", "plain < text", "<!-- open <p>x", "<script>never", "<div hidden>h</div><p>v</p>",
    ]
    assert html_extract.extract_group(list(range(8)), pages) == ["Story one & only", "Second story", "kept", "", "plain < text", "", "", "v"]


def test_repeats_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 4, 400)
    page = np.sort(rng.integers(0, 12, 400))
    got = html_extract.repeated(tokens, page, 6)
    seen = collections.defaultdict(set)
    starts = [i for i in range(395) if page[i] == page[i + 5]]
    for i in starts:
        seen[tuple(tokens[i : i + 6])].add(page[i])
    want = np.zeros(400, bool)
    for i in starts:
        if len(seen[tuple(tokens[i : i + 6])]) > 1:
            want[i : i + 6] = True
    assert (got == want).all()


def test_extraction_of_odd_rows(spark):
    rows = [(1, "http://a.b/c", PAGE), (2, None, None), (None, "x", ""), (1, "http://a.b/c", PAGE), (4, "http://A.B/", "<p>" + "long text " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"], r["n_chars"], r["text"][:10]) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, 29, "A & B One "), (1, 29, "A & B One "), (2, 0, ""), (None, 0, ""), (4, 499_999, "long text ")], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_repeats_over_a_whole_host(spark):
    # every piece of boilerplate stands on two pages only, which lie anywhere among the host's pages
    menu = lambda k: " ".join(f"menu{k % 40}{c}" for c in "abcdefgh")
    own = lambda k: " ".join(f"own{k}{c}" for c in "abcdefgh")
    page = lambda k: f"<div>{menu(k)}</div><p>{own(k)}</p>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(80)] + [(None, "http://n.example/a", page(1)), (3, "http://n.example/b", page(1)), (5, "http://o.example/", page(2)), (5, "http://o.example/", page(2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = f"{menu(2)} {own(2)}"
    want = [(k, own(k)) for k in range(80)] + [(None, ""), (3, ""), (5, alone), (5, alone)]
    for parts in (1, 7, 60):
        got = html_extract.extract(pages.repartition(parts)).select("page_id", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert html_extract.extract_group(list(range(80)), [r[2] for r in rows[:80]]) == [t for _, t in want[:80]]


def test_unique_runs_stay_by_brute_force(spark):
    """The whole operator on pages without an article, against a search of every window in every page of the host."""
    import random

    rng = random.Random(11)
    phrases = [" ".join(rng.choices("abcde", k=rng.randint(4, 9))) for _ in range(12)]
    texts = []
    for _ in range(60):
        texts.append([" ".join(rng.choices([*phrases, *(f"u{rng.randrange(10**6)}" for _ in range(6))], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))])
    hosts = [f"h{k % 3}" for k in range(60)]
    rows = [(k, f"http://{h}/{k}", "".join(f"<nav>{b}</nav>" if j == 2 else f"<div>{b}</div>" for j, b in enumerate(bs))) for k, (h, bs) in enumerate(zip(hosts, texts, strict=True))]
    seen, streams, n = collections.defaultdict(set), [], html_extract.LONG
    for k, bs in enumerate(texts):
        stream = [("", None)]
        for j, b in enumerate(bs):
            stream += [(w, j) for w in b.split(" ")] + [("", None)]
        streams.append(stream)
        for i in range(len(stream) - n + 1):
            seen[hosts[k], tuple(w for w, _ in stream[i : i + n])].add(k)
    want = []
    for k, stream in enumerate(streams):
        gone = {i + m for i in range(len(stream) - n + 1) for m in range(n) if len(seen[hosts[k], tuple(w for w, _ in stream[i : i + n])]) > 1}
        want.append((k, " ".join(w for i, (w, j) in enumerate(stream) if j is not None and j != 2 and i not in gone)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (2, 31):
        assert sorted(map(tuple, html_extract.extract(pages.repartition(parts)).select("page_id", "text").collect())) == want
    assert any(0 < len(t) < len(" ".join(b)) for (_, t), b in zip(want, texts, strict=True))


def test_hot_key_is_salted(spark, tmp_path):
    docs = spark.createDataFrame([("hot", k) for k in range(900)] + [("hot", 5), (None, 1)], "source string, doc_id long")
    placed = sharding.place(docs, F.col("source"), sharding.shard_names(4), 1009, salts=16)
    assert placed.where("source = 'hot'").select("slot").distinct().count() == 16
    assert placed.where("source = 'hot' AND doc_id = 5").select("slot").distinct().count() == 1
    sharding.write_shards(docs, F.col("source"), sharding.shard_names(4), str(tmp_path / "s"), salts=16)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 902 and back.where("source = 'hot'").select("shard").distinct().count() > 1


def test_the_mix_stage_takes_repeated_rows_as_the_sample_does(spark):
    """Rows that agree in id, source and size are taken one by one where a source's sample ends among them."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(k % 40 if k % 5 else None, words(1 + k % 4), "abc"[k % 3], "en") for k in range(400)] + [(7, words(3), "d", "en")] * 33 + [(None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, file string")
    count = lambda t: len(t.split()) if t else 0
    want, total = collections.Counter(), collections.Counter()
    for r in mixing.sample(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
        total[r["source"]] += r["taken"]
    got = mixing.mix_stage(spark, docs.repartition(3), "").collect()
    assert collections.Counter((r["doc_id"], r["source"], count(r["text"])) for r in got) == +want
    assert any(0 < n % 11 < 11 for n in want.values())
    split = [k for k, n in want.items() if n % collections.Counter((r[0], r[2], count(r[1])) for r in rows)[k]]
    assert split  # some group is taken in part


@pytest.mark.parametrize(
    "source, want",
    [
        ('<article><p class="notice">N<p>Real text</article>', "Real text"),
        ('<article><ul><li class="share">x<li>Second item</ul>tail</article>', "Second item tail"),
        ('<article><section id="search-algorithms">kept</section></article>', "kept"),
        ('<article><table><tr><td class="ad">x<td>y<tr><td>z</table></article>', "y z"),
        ("<article><dl><dt class=ad>a<dd>b</dl><p>c<div>d</div></article>", "b c d"),
        ('<article><p class="ad">a<table><tr><td>b<p>c</table></article>', "b c"),
        ('<article><select><option class="ad">x<option>y</select><p>z</article>', "z"),
        ('<article><div class="related-posts">x</div>y</article>', "y"),
        ('<article><ul><li class="ad">a<ul><li>b</ul>c<li>d</ul></article>', "d"),
    ],
)
def test_implied_ends_and_marked_words(source, want):
    assert html_extract.text_of(source, "", None) == want


def test_hostile_pages_take_time_in_proportion():
    import time

    n = 1 << 19
    pages = ["<p>" * (n // 8) + "</x>" * (n // 8), "<p " * (n // 3), '<a="' * (n // 4), "<a " * (n // 3) + '">"', "<a" * (n // 2), "<!" * (n // 2), "<b><p>" * (n // 6), "<b>" * (n // 6) + "<div>" * (n // 10)]
    for page in pages:
        began = time.process_time()
        html_extract.text_of(page, "", None)
        assert time.process_time() - began < 8


def test_long_pages_have_the_same_tags(monkeypatch):
    import random

    rnd = random.Random(3)
    parts = ["<", "a", "p ", '"', "'", ">", "/", "=", "<p", "</p", "<!--", "-->", "<![CDATA[", "]]>", "<script", "</script>", "<!", "?", " ", "x", '<b "', "<title>"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    short = [[m.span() for m in html_extract.tags(p)] for p in pages]
    monkeypatch.setattr(html_extract, "PLAIN", -1)
    assert [[m.span() for m in html_extract.tags(p)] for p in pages] == short
