"""The pipeline's stages one after another, against what each must keep."""

import pandas as pd

import corpus_pipeline
from tallyforge.llm import jaccard_join, langid, mixing, packing, substring_dedup

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "packed":
            assert out.columns == docs.columns
        seen[name] = out.toPandas()
        docs = spark.createDataFrame(seen[name], docs.schema) if name != "packed" else docs
    assert set(seen["language"].doc_id) >= set(seen[""].doc_id[seen[""].text.str.len() > 40])
    kept = spark.createDataFrame(seen["near_duplicates"])
    assert jaccard_join.join(kept).where("n_links > 0 or class_id != doc_id").count() == 0
    assert substring_dedup.remove_repeats(spark.createDataFrame(seen["repeated_passages"])).select("doc_id").count() == len(seen["repeated_passages"])
    assert sorted(seen["mixture"].doc_id) == sorted(seen["repeated_passages"].doc_id)
    assert set(seen["packed"].doc_id) == set(seen["mixture"].doc_id)
    assert seen["packed"].groupby("sequence_id").length.sum().max() <= packing.ROOM


def test_run(spark):
    out = corpus_pipeline.run(spark, D).toPandas()
    assert isinstance(out, pd.DataFrame) and len(out) and langid.UNKNOWN == "und"


def test_mixing_takes_effect(spark, monkeypatch):
    def run(weights):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixture", lambda s, docs, d: mixing.mixed(docs, weights)), ("packed", corpus_pipeline.packed)])
        return corpus_pipeline.run(spark, D).toPandas().sort_values(["sequence_id", "offset"])

    docs = spark.read.parquet(f"{D}/documents.parquet")
    a, b = sorted(r["source"] for r in docs.select("source").where("source is not null").distinct().collect())[:2]
    found = {}
    for weights in ({a: 1000, b: 1}, {a: 1, b: 1000}):
        out = run(weights)
        order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs, weights).collect()}
        heads = [(*order[r.doc_id], r.piece) for r in out[out.offset == 0].itertuples()]
        assert heads == sorted(heads) and sorted(set(out.sequence_id)) == list(range(len(heads)))
        for _, same in out.groupby("length"):  # pieces of a length are dealt out in the mixed order
            firsts = [order[i] for i in same.doc_id[same.offset == 0]]
            assert firsts == sorted(firsts)
        assert set(out.doc_id) == set(order)
        found[max(weights, key=weights.get)] = set(map(tuple, out[["doc_id", "piece", "sequence_id"]].to_numpy()))
    assert found[a] != found[b]


def test_odd_tables(spark):
    """Empty, null, repeated and extra: each stage gets the columns of documents and others, and gives them back."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, order_slot int, tallyforge_key string"
    real = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    tables = {
        "empty": [],
        "nulls": [(None, None, None, None, None)] * 3 + [(1, None, "en", None, None)],
        "repeated": [*real, *real[:20], *real[:1], (None, real[3][1], None, None, None), (real[5][0], None, None, None, None)],
    }
    for name, rows in tables.items():
        docs = spark.createDataFrame([(*r, 3, "x") for r in rows], schema)
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, D)
            if stage == "packed":
                pieces = out.toPandas()
                assert set(pieces.doc_id.dropna()) <= {r[0] for r in rows}, name
                break
            assert out.columns == docs.columns, (name, stage)
            kept = out.collect()
            assert len(kept) <= docs.count()
            if stage == "near_duplicates":
                texts = [r["text"] for r in kept]
                assert len(texts) == len(set(texts)), name
            docs = spark.createDataFrame(kept, schema)
