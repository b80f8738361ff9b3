"""The pipeline's stages, each against a plain version on what the stage before kept."""

from patternmill.llm import queries
from tests.llm import brute
from tests.llm.test_contracts import quality_plain, without_boilerplate


def test_stages(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(pipe.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{queries.decontaminate.Scratch(spark, 'test').root}/{name}")
        return out, sorted((r.doc_id, r.text, r.source) for r in out.collect())

    good = {r[0] for r in quality_plain(rows) if r[-1]}
    docs, got = step("quality_rules", docs)
    clean = without_boilerplate(rows)
    assert got == sorted((d, clean[d, t, s], s) for d, t, s in rows if d in good)
    lines = {d: t for d, _, _, t in brute.drop_lines([(d, t) for d, t, _ in got])}
    want = [(d, lines[d], s) for d, _, s in got]
    docs, got = step("line_dedup", docs)
    assert got == want
    first = brute.classes([(d, t) for d, t, _ in got])
    want = [r for r in got if first[r[0]] == r[0]]
    docs, got = step("near_dedup", docs)
    assert got == want
    bad = {d for d, *_ in brute.leaks([(d, t) for d, t, _ in got], items)}
    want = [r for r in got if r[0] not in bad]
    docs, got = step("decontaminate", docs)
    assert got == want
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    placed = stages["packing"](spark, docs, sf_dir).collect()
    sizes = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t, _ in got}
    total: dict[int, int] = {}
    for r in placed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes
    assert {(r.doc_id, r.start, r.length) for r in pipe.run(spark, sf_dir).collect()} == {(r.doc_id, r.start, r.length) for r in placed}


def test_empty(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
