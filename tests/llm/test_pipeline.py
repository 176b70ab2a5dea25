"""The pipeline's stages, each on its own input, against plain versions."""

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import bpe
from lexiloom.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.where("doc_id < 5").selectExpr("doc_id + 90000 as doc_id", "text", "lang", "source", "n_chars")
    junk = spark.createDataFrame([(95000, None, "en", "src1", 0), (95001, "", None, None, 0), (95002, "$ # " * 200, "en", "src1", 800), (95003, "中文 字 " + " ".join(f"语{i}言" for i in range(80)), "en", "src1", 900)], docs.schema)
    docs = docs.union(extra).union(junk)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:-1], stages[1:], strict=True):
        assert after.columns == stages[0].columns
        assert rows(after).items() <= rows(before).items()


def test_quality_stage(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert not [i for i in after if brute.quality(before[i])[5]] and 95002 not in after
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert not [i for i in good if i not in after and not brute.quality(before[i])[5]]


def test_language_stage(stages):
    gone = rows(stages[1]).keys() - rows(stages[2]).keys()
    assert gone <= {95003} | {i for i, t in rows(stages[1]).items() if len(t) < 100}


def test_duplicate_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {i for i, (_, c, _) in brute.components(sorted(before.items())).items() if i == c}
    assert set(after) == want and len(after) < len(before)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, r in brute.decontaminate(rows(stages[3]).items(), items).items() if r[4]}
    assert set(rows(stages[4])) == set(rows(stages[3])) - hit and hit


def test_token_stage(spark, stages):
    name, last = corpus_pipeline.STAGES[-1]
    own = bpe.encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in last(spark, stages[-1], SF).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: own.encode_ordinary(t) for i, t in rows(stages[-1]).items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())


def test_null_and_repeated_ids(spark):
    """Each stage judges rows, not ids."""
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(60))
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.quality_rules(spark, nameless, SF).count() == corpus_pipeline.quality_rules(spark, docs, SF).count() > 0
    assert corpus_pipeline.language_id(spark, nameless, SF).count() > 0
    bad = docs.withColumn("text", F.lit("$ # " * 200))
    assert {r.text for r in corpus_pipeline.quality_rules(spark, docs.union(bad), SF).collect()} <= {r.text for r in docs.collect()}
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(7, a), (7, a), (None, a), (None, b), (None, b), (3, c), (3, b + " end"), (7, ""), (7, None), (None, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()), key=str)
    assert got == sorted([(7, a), (3, b + " end"), (3, c), (7, ""), (7, None), (None, "")], key=str)
    none = table.where("doc_id is null and text <> ''")
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, none, SF).collect()) == [a, b]


def test_further_columns_and_empty_tables(spark):
    """Columns named like those inside the operators come back as they were; empty tables give empty ones."""
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(25))
    names = ["n_words", "kept", "score", "rejected", "label", "key", "_row", "hits", "row", "all"]
    wide = docs.select("*", *[F.concat(F.lit("mine"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, wide, SF))
        assert out.columns == wide.columns and out.count() > 0
        assert all(r[n] == f"mine{r.doc_id}" for r in out.collect() for n in names)
        assert stored(stage(spark, wide.limit(0), SF)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == 25
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
