import re
from pathlib import Path

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_line_dedup import brute as fewer_lines
from test_ngram_join import brute as classes
from test_quality_rules import brute as quality

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def test_stages_against_brute_force_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        texts = [(r.doc_id, r.text) for r in before]
        if name == "quality rules":
            kept = {r.doc_id for r in after}
            assert kept <= {i for i, t in texts if not quality(t)[-1]}
            assert len(kept) >= 0.9 * sum(not quality(t)[-1] for _, t in texts)
        elif name == "line dedup":
            want, _ = fewer_lines(texts)
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t == dict(texts)[i] or re.search(WORD, t)}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in after) == sorted({c for _, c, _ in classes(texts)})
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in after} == {i for i, x in contaminated(texts, items).items() if not x[-1]}
        else:
            assert sorted(r.doc_id for r in after) == sorted(i for i, _ in texts)
            assert all(r.n_tokens == len(r.ids) for r in after)
            break
        assert docs.columns == columns
        before = after
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in again) == sorted((r.doc_id, r.ids) for r in after)


def test_repeated_null_and_empty_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"some{i} words{i * 7} here{i % 5}" for i in range(30))
    rows = [(1, good, "en", None, 5), (1, good, "en", None, 5), (None, good + " end", None, "s", None), (2, None, None, None, None), (3, "", "x", "y", 0)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        out = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, SF)
        assert out.count() == (1 if table is docs else 0)


def test_library_does_not_import_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "cinelake").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_encoding_decodes_again(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.encoding(spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_workers_that_go_to_another_stage_let_go_of_the_vocabulary():
    from cinelake.llm import byte_bpe, quality_rules  # noqa: F401
    from cinelake.llm._common import lean

    byte_bpe.codec(None)
    assert list(lean(lambda batches: batches, caches=False)([1, 2])) == [1, 2]
    assert byte_bpe.codec.cache_info().currsize == 1
    assert list(lean(lambda batches: batches)([3])) == [3]
    assert byte_bpe.codec.cache_info().currsize == 0


def test_encoding_has_one_python_step(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.encoding(spark, docs, SF).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
