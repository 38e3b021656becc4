"""Every operator and stage over nulls, an empty table, a very long text, repeated rows and columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import binary_tokens, bpe, exact_dedup, html_extract, mixing, quality, sharding, simhash, substring_dedup, toxicity

LONG = " ".join(f"w{k % 9973}" for k in range(700_000)) + " " + "x" * 1_000_000
ROWS = [
    (1, "the quick and the dead of it " + " ".join(f"w{k}" for k in range(80)), "en", "a", 9),
    (1, "the quick and the dead of it " + " ".join(f"w{k}" for k in range(80)), "en", "a", 9),
    (2, None, None, None, None), (None, "no id", "en", "a", 1), (None, None, None, None, None),
    (3, "", "en", "b", 0), (4, " \n\t", "en", "b", 3), (-(1 << 63), "least id", "en", "b", 8), ((1 << 63) - 1, "greatest id", "en", "c", 8),
    (5, LONG, "en", "c", len(LONG)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Every name that an operator gives to a result or uses on its way.
NAMES = (
    "__doc __row __file __copy __copies __slot __shard __task __words __lines __id __th __c __mark doc row file words lines t hashes sorted starts task one n_words word_chars n_symbols n_lines "
    "n_dup_lines n_repeat_words base_failed failed_rules kept fingerprint fp th root component_id group_size start n_tokens ids ids_crc32 ids_sha256 decoded decoded_sha256 "
    "size source_size target taken copies whole extra severity grade toxic n_removed kept_sha256 slot shard digest keep keep_id n text_sha256 block payload html url page_id host place _metadata"
).split()


def _write_tokens(docs):
    folder = binary_tokens.scratch(docs.sparkSession, "odd-tokens")
    return binary_tokens.read_tokens(binary_tokens.write_tokens(docs, folder, bpe.tokenizer_path(), 3), folder)


OPERATORS = {
    "op2": quality.judge,
    "op3": simhash.near_duplicates,
    "op4": _write_tokens,
    "op5": lambda d: bpe.encode(d, bpe.tokenizer_path()),
    "op6": mixing.sample,
    "op7": lambda d: toxicity.score(d, toxicity.fit_sample(d, d.select("doc_id", F.lit(1).alias("toxic")))),
    "op8": substring_dedup.remove_repeats,
    "op9": lambda d: sharding.place(d, F.col("doc_id"), sharding.shard_names(3), 101, slot="__at", shard="__at_shard"),
    "op10": exact_dedup.exact_duplicates,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("clash") for n in NAMES})


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, docs, name):
    run = OPERATORS[name]
    assert run(docs).count() == len(ROWS)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, "")
    rows = got.collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if name != "bpe":
        assert got.columns == docs.columns
        assert all(r[n] == "clash" for r in rows for n in NAMES)
    # quality: a text of one base word repeated, a short or an empty one goes; exact: one empty text and one of the two copies
    # stay; near: all texts without words are copies, too; mixing: each copy of a row has the same rank, so both are taken alike
    want = {
        "quality_rules": [1, 1],
        "exact_dedup": [1, 4, 4 - 1, 5, -(1 << 63), (1 << 63) - 1, None],
        "simhash_near_dedup": [None, None, 1, 5, -(1 << 63), (1 << 63) - 1],
        "bpe": [r[0] for r in ROWS],
    }
    if name in want:
        assert ids == sorted(want[name], key=str)
    else:
        assert ids.count(1) % 2 == 0 and set(ids) <= {r[0] for r in ROWS}
    assert stage(spark, docs.limit(0), "").count() == 0


def test_copies_of_a_projected_scan_are_rows_of_their_own(spark, tmp_path):
    spark.createDataFrame(ROWS[:1], SCHEMA).write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d"))
    twice = one.select(*one.columns, F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    for stage in (exact_dedup.dedup_stage, simhash.dedup_stage):
        for docs in (twice, one.unionByName(one)):
            assert stage(spark, docs, "").count() == 1


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, None), (None, None, "<p>y"), (3, "http://a/b", "<article><p>" + LONG + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("clash") for n in NAMES if n not in ("html", "url", "page_id")})
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert got == sorted([("1", 1), ("1", 1), ("2", 0), ("None", 1), ("3", len(LONG))])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace as Of

    from tracemill.llm import common

    session = lambda root, master: Of(conf=Of(get=lambda key, default: root), sparkContext=Of(master=master))
    assert common.scratch(session("hdfs://x/y/", "spark://elsewhere:7077"), "p").startswith("hdfs://x/y/p-")
    assert common.scratch(session(None, "local[4]"), "p").startswith("file:///")
    with pytest.raises(ValueError):
        common.scratch(session(None, "spark://elsewhere:7077"), "p")
