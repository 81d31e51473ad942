import brute
import corpus_pipeline
import pytest
from gridlens.llm import common, decontam, mixing, quality, queries, simhash, token_counts


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's input and output."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        where = f"file://{tmp_path_factory.mktemp('stages')}/{k}"
        f(spark, docs, sf_dir).write.parquet(where)
        after = spark.read.parquet(where)
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count()


def test_quality_stage(spark, sf_dir, stages):
    before, after = stages[0]
    scored = quality.quality_scores(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored.where("predicted = 1").collect())


def test_duplicates_stage(stages):
    before, after = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    pairs = brute.similar_pairs(rows, 5)
    kept = {r.doc_id for r in after.collect()}
    want = brute.components(list(range(len(rows))), [(a, b) for a, b, j in pairs if j >= 0.8])
    assert kept == {rows[i][0] for i in want if want[i] == i}


def test_decontamination_stage(spark, sf_dir, stages):
    before, after = stages[2]
    leaks = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in before.collect()} - leaks == {r.doc_id for r in after.collect()}


def test_mixing_stage(stages):
    before, after = stages[3]
    want = sorted(r.id for r in mixing.mixed(before, queries.WEIGHTS, seed=queries.SEED).collect())
    assert sorted(r.doc_id for r in after.collect()) == want


def test_token_stage(stages):
    before, after = stages[4]
    tok = token_counts.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    want = brute.token_rows([(r.doc_id, r.text) for r in before.collect()], tok)
    assert sorted(tuple(r) for r in after.collect()) == sorted(want)


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()


def test_token_stage_takes_odd_rows(spark, odd_docs, odd_rows, no_docs, clashing_docs, sf_dir):
    tok = token_counts.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    stage = corpus_pipeline.STAGES[-1][1]
    key = lambda rows: sorted((r[0] is None, *r[1:]) if r[0] is None else (False, r[0], r[2], r[3]) for r in rows)
    want = brute.token_rows([r[:2] for r in odd_rows], tok)
    for docs in (odd_docs, clashing_docs):
        got = [tuple(r) for r in stage(spark, docs, sf_dir).collect()]
        assert key([r for r in got if r[0] is not None]) == key([r for r in want if r[0] is not None])
        assert sorted(n for d, _, n, _ in got if d is None) == sorted(n for d, _, n, _ in want if d is None)
        starts = sorted((s, n) for _, s, n, _ in got)
        assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert stage(spark, no_docs, sf_dir).count() == 0


def test_components(spark):
    import random

    rng = random.Random(3)
    nodes = list(range(200))
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    want = {n: c for n, c in brute.components([*nodes, *range(300, 341)], [x for x in links if x[0] != x[1]]).items()}
    df = spark.createDataFrame([*links, (None, 3), (7, None)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df, common.Scratch(spark, "t")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert common.connected_components(df.limit(0), common.Scratch(spark, "t")).count() == 0


def test_queries_return_their_columns(spark, sf_dir):
    want = {
        "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op7_simhash": ["doc_id", "fingerprint", "component_id"],
        "op9_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, sf_dir).columns == columns
    assert simhash.CELLS == 16
