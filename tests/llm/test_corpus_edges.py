"""Every operator and pipeline stage on the hard table, on an empty one and with clashing columns."""

import pytest
from cases import SCHEMA, frame, hard_rows, with_clashes

import corpus_pipeline
from stratavox.llm import langid, media, mixing, neardup, packing, pii, quality, substrings, toxicity, warc


def labels(spark, rows=((1, 1, 0), (3, 1, 0), (14, 0, 0), (None, 0, 1), (9, None, None), (13, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def quality_rows(spark, df):
    return quality.score_quality(df, quality.fit_chain(df, labels(spark)))


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_texts(d, toxicity.train(d, labels(s))),
    "media": lambda s, d: media.store_media(d),
    "language": lambda s, d: langid.predict_languages(d, langid.sample_and_fit(d)),
    "substrings": lambda s, d: substrings.remove_repeats(d, keep_text=True),
    "mixing": lambda s, d: mixing.mix(d),
    "quality": quality_rows,
    "packing": lambda s, d: packing.pack(d, keep_ids=True),
    "pii": lambda s, d: pii.pseudonymise_texts(d, "k"),
    "warc": lambda s, d: warc.read_bundles(warc.archive(d.selectExpr("doc_id as page_id", "source as url", "text as html")), with_payload=True),
    "neardup": lambda s, d: neardup.near_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    df = with_clashes(frame(spark, hard_rows()))
    rows = OPERATORS[name](spark, df).collect()
    first = rows[0].__fields__[0]
    assert {r[first] for r in rows} == {r[0] for r in hard_rows()}
    if name not in ("packing",):
        assert len(rows) == len(hard_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    got = OPERATORS[name](spark, spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and len(got.columns) > 1


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(spark, name):
    rows = [(None, None, None, None, None)] * 3
    assert OPERATORS[name](spark, frame(spark, rows)).count() == 3


def test_stages(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    df = with_clashes(frame(spark, hard_rows()))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (last.count() == 0) == docs.isEmpty()
        assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "least_sequences"]


def test_stages_keep_and_drop(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    df = frame(spark, hard_rows())
    kept = {r.doc_id for r in stages["quality_rules"](spark, df, str(tmp_path)).collect()}
    assert {1, 2, 3, 9, 10, 12} <= kept and not kept & {5, 6, 7, 8, 13}
    near = [r.doc_id for r in stages["near_duplicates"](spark, df, str(tmp_path)).collect()]
    assert 1 in near and not set(near) & {2, 3, 4} and near.count(None) == 2 and {9, 10, 12} <= set(near)
