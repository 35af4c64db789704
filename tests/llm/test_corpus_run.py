import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import toxicity  # noqa: E402
from millrace.llm.line_dedup import ORACLE as LINES  # noqa: E402
from millrace.llm.mixing import ORACLE as MIX  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark, tmp_path):
    """Every stage again by plain means: duckdb for lines and mixing, pairs for near copies, the library for ids."""
    duckdb = pytest.importorskip("duckdb")
    from tests_llm_brute import near_copies

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    rows = {r.doc_id: r for r in docs.collect() if scorer(r.text)[0] < toxicity.AT_LEAST}
    db = duckdb.connect()

    def sql(query, rows):
        db.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        return db.sql(query)

    lines = sql(LINES.replace("md5(clean) AS text_md5", "clean"), [(r.doc_id, r.text, r.source) for r in rows.values()])
    texts = {d: clean for d, _, removed, _, clean in lines.fetchall() if not removed or clean.split()}
    kept, _ = near_copies(texts)
    want = []
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, size, _, _, taken in sql(MIX, [(d, texts[d], rows[d].source) for d in kept]).fetchall():
        ids = library.encode(texts[d], add_special_tokens=False).ids
        want += [(d, texts[d], rows[d].lang, rows[d].source, len(texts[d]), ids)] * (1 if size == 0 else taken // size)
    assert sorted(map(tuple, got)) == sorted(want)


def test_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, names that clash, through all stages; then no documents at all."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [
        (1, "some words that stand here\nand a second line", "en", "a", 45, [7], "k"),
        (1, "some words that stand here\nand a second line", "en", "a", 45, [7], "k"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, [], "x"),
        (None, "a text without an id, five words and more", "en", "b", 41, None, "y"),
        (5, long, "en", None, len(long), [1], "z"),
        (6, long + " end", "en", "b", len(long) + 4, [1], "z"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, token_ids array<int>, row string"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "token_ids_"]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) <= {1, 2, None, 5} and {2, 5} & set(got)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got.values():
        assert r.token_ids_ == library.encode(r.text or "", add_special_tokens=False).ids
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns + ["token_ids_"] * (k == 4)


def test_a_run_leaves_unread_results_alone(spark):
    """A run deletes what its own stages have stored, not what a query of the same session has."""
    from millrace.llm import mixing
    from millrace.llm.common import scratch, shared_dir, stored

    unread = mixing.query(spark, SF)
    corpus_pipeline.run(spark, SF).count()
    assert unread.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    with scratch(spark):
        held = stored(spark.range(3), "held")
        path = held.inputFiles()[0].rpartition("/")[0]
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        assert held.count() == 3 and path.startswith(("file:", shared_dir(spark)))
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
