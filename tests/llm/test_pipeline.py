import corpus_pipeline
from tallyfold.llm import queries

from .test_decontam import brute, words
from .test_similar import kept as similar


def test_stages_keep_what_they_should(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    before, after = kept["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = kept["near_duplicates"]
    assert sorted(r.doc_id for r in after) == similar([(r.doc_id, r.text) for r in before])
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    vocabulary = {w for _, t in items for w in words(t)}
    suspects = {r.doc_id for r in before if sum(w in vocabulary for w in words(r.text)) >= 1}
    clean = {r.doc_id for r in before if r.doc_id not in suspects or not brute(items, r.text)[1]}
    assert {r.doc_id for r in after} == clean
    before, after = kept["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0
    before, after = kept["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)


def test_run(spark, sf_dir):
    assert queries.QUERIES["pipeline"](spark, sf_dir).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_queries_have_the_columns_of_their_contracts(spark, sf_dir):
    want = {
        "op1_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op2_mix_sources": "doc_id size source_size target taken",
        "op3_language_id": "doc_id held_out lang_pred score",
        "op4_url_filter": "page_id host path rule verdict",
        "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op7_shard_documents": "doc_id size text_crc32 law shard slot grown_shard",
        "op8_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op9_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op10_simhash": "doc_id fingerprint component_id",
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert got.columns[: len(columns.split())] == columns.split(), name
        assert got.count() == spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op4') else 'documents'}.parquet").count()
