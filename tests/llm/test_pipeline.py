import corpus_pipeline as P

from emporia.llm import decontam, quality, simhash

from .cases import documents, edited, prose
from .helpers import write

ITEM = "the quick brown fox jumps over the lazy dog while several cats watch from the old stone wall near the river bank at noon"


def test_stages_take_effect(spark, tmp_path):
    good = [prose(s, 120, 5000) for s in range(8)]
    texts = [*good,
             "too short",                                             # 8: base rules
             "word " * 200,                                           # 9: repeats
             prose(50, 80, 5000) + "\n" + good[0],                    # 10: repeats a line of 0
             edited(good[1], 1, 1),                                   # 11: near copy of 1
             prose(60, 60, 5000) + " " + ITEM + " " + prose(61, 60, 5000),   # 12: holds a benchmark item
             None, ""]
    write(spark, tmp_path, "documents", documents(texts))
    write(spark, tmp_path, "labels", [(0, 1, 0)])
    write(spark, tmp_path, "benchmark", [(0, ITEM)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    assert set(seen["quality_rules"]) == {*range(8), 10, 11, 12}
    lines = seen["line_dedup"]
    assert lines[0].text == good[0] and lines[10].text == prose(50, 80, 5000) and lines[10].n_chars == len(lines[10].text)
    assert set(seen["benchmark_decontamination"]) == set(seen["simhash_near_dedup"]) - {12}
    assert {r.doc_id: r.n_tokens for r in P.run(spark, str(tmp_path)).collect()} == {k: r.n_tokens for k, r in seen["bpe"].items()}
    assert set(range(8)) <= set(seen["bpe"])


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        write(spark, tmp_path, name, [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_each_stage_is_its_operator_s_query(spark):
    """On the given table the stages decide as the operators' own results say."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.op8_quality_rules(spark, sf).collect() if r.kept}
    assert {r.doc_id for r in P.quality_stage(spark, docs, sf).collect()} == kept
    reps = {r.component_id for r in simhash.op2_simhash_near_dedup(spark, sf).collect()}
    assert sorted(r.doc_id for r in P.near_dedup_stage(spark, docs, sf).collect()) == sorted(reps)
    bad = {r.doc_id for r in decontam.op3_template_decontamination(spark, sf).collect()}
    assert {r.doc_id for r in P.decontamination_stage(spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()} - bad
