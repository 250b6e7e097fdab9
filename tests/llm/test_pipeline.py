"""The stages over a small corpus: each stage's decision, judged on its own input."""

import random
import struct
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.helpers import CLASHES, prose
from tests.llm.test_operators import leaks, near_groups, quality_rows
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    good, bad = quality_rows(300)
    passage = prose(rng, 40)
    rows = good + bad
    rows += [(1000 + i, good[i][1], "en", "s", 1) for i in range(20)]  # copies
    rows += [(1100 + i, prose(rng, 30) + " " + passage, "en", "s", 1) for i in range(5)]
    rows += [(1200 + i, f"password=hunter{i}{i}x " + prose(rng, 60), "en", "s", 1) for i in range(5)]
    rows += [(1300, "", "en", "s", 0), (1301, None, None, None, None), (1302, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append([tuple(r) for r in docs.collect()])
    kept, single, clean, masked, pieces = seen
    ids = lambda rs: {r[0] for r in rs}
    assert len(ids(kept) & ids(bad)) < 10 and len(ids(kept) & ids(good)) > 285
    assert ids(single) == set(near_groups(kept)[0].values()) and len(single) == len(ids(single))
    assert ids(clean) == {r[0] for r in leaks(single, items) if r[2] == 0} and not ids(clean) & set(range(1100, 1105))
    texts = {r[0]: r[1] for r in clean}
    for i, t, *_, n in masked:
        assert (t == texts[i]) or (1200 <= i < 1205 and t.startswith("[assign] "))
        assert n == len(t or "") or t is None
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    back = defaultdict(list)
    for i, start, _, raw, *_ in pieces:
        back[i].append((start, raw))
    assert {i: [x for _, raw in sorted(v) for x in struct.unpack(f"<{len(raw) // 4}I", raw)] for i, v in back.items()} == {
        i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in masked
    }
    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert {(r[0], r[1], r[2]) for r in whole if r[0] is not None} and ids(whole) == ids(masked)


def test_stages_with_odd_rows(spark, tmp_path):
    """Extra columns with inner names, nulls in all columns, repeated rows and shared ids, stage by stage."""
    rng = random.Random(12)
    good, bad = quality_rows(80)
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma"), (None, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [good[0], good[0], (good[1][0], prose(rng, 80), None, None, None), (None, prose(rng, 50), None, None, None), (None, None, None, None, None), (None, None, None, None, None), (900, "", "en", "s", 0), (901, None, None, None, None),
           (902, prose(rng, 60) + " token=abcdef0123 alpha beta gamma", "en", None, 1), (903, prose(rng, 60) + " token=abcdef0123", "en", None, 1)]
    names = [*CLASHES, "bad_id", "bad_hash", "stays_id", "leak_id", "leak_hash", "span_id", "span_hash", "span_list", "x", "piece", "part", "rank", "tier"]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in dict.fromkeys(names)})
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() in (0, 1, 2, 3)
    single = corpus_pipeline.deduplicate(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert single.columns == docs.columns and ids.count(None) == 3 and ids.count(good[0][0]) == ids.count(good[1][0]) == ids.count(900) == ids.count(901) == 1
    clean = corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1 and clean.where("doc_id = 902").count() == 0
    masked = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path))
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert {r.text[-9:] for r in masked.where("doc_id = 903").collect()} == {" [assign]"} and masked.where("text is null and n_chars is not null").count() == 0
    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert pieces.where("doc_id is null").count() >= 3 and pieces.where("doc_id = 900 and doc_tokens = 1").count() == 1


def test_empty_tables(spark, tmp_path):
    for name, schema in [("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")]:
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_side_tables_and_a_very_long_text(spark, tmp_path):
    """Without labels every document has one score, without items none is contaminated; a text of 30,000 words goes through whole."""
    rng = random.Random(13)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(12)] + [(50, prose(rng, 30_000, 5000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in [("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")]:
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.classify(spark, docs, str(tmp_path)).count() in (0, len(rows))
    for stage in (corpus_pipeline.deduplicate, corpus_pipeline.decontaminate_benchmark, corpus_pipeline.mask_secrets):
        assert sorted(tuple(r)[:2] for r in stage(spark, docs, str(tmp_path)).collect()) == sorted(r[:2] for r in rows)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces = sorted((p.start, p.ids) for p in corpus_pipeline.pack(spark, docs, str(tmp_path)).where("doc_id = 50").collect())
    assert [x for _, raw in pieces for x in struct.unpack(f"<{len(raw) // 4}I", raw)] == [*tokenizer.encode(rows[-1][1], add_special_tokens=False).ids, 2]
