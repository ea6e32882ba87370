"""Each stage of the pipeline against plain Python on a small table with repeated ids, nulls and copies."""

import hashlib
import math

import numpy as np
import pytest
from fixtures import prose
from test_ngram_join import brute_classes
from test_quality_mixing import plain_mix

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def small_table(spark, folder):
    good = [prose(i, 60) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(good)] + [(40, good[0] + " tail"), (5, good[7] + " end"), (41, good[2]), (41, good[2]), (None, good[3]), (None, good[4] + " x y"), (42, "mail bob [at] example [dot] com or a@b.cd " + prose(777, 60))]
    bad = [(100 + i, (prose(i, 40).upper().replace(" ", "!! ") + " 12")) for i in range(30)] + [(200, None), (201, ""), (202, " \n")]
    rows = [(i, t, "en", None if k % 9 == 8 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows + bad)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(25), *range(100, 125)]], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    import corpus_pipeline
    from pennant.llm import pii, quality, spans

    small_table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    out, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/before_{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/before_{name}"), sf)
        out[name] = (spark.read.parquet(f"{tmp_path}/before_{name}").collect(), docs.collect())
        docs = spark.createDataFrame(out[name][1], docs.schema)
    assert list(stages) == ["quality", "near_duplicates", "pii", "mix", "tokens"]
    plain = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=str)

    before, after = out["quality"]
    w, words = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels.where(~quality.is_held_out(labels["doc_id"]))), quality._Words()

    def good(t):
        f = quality.features(t, words)
        return 1 / (1 + math.exp(-(w[quality.BUCKETS] + (quality.SCALE * np.mean(w[f]) if len(f) else 0)))) >= quality.CUT

    assert plain(after) == plain([r for r in before if good(r.text)])
    assert {r.doc_id for r in after} >= set(range(30)) and not {r.doc_id for r in after if r.doc_id} & set(range(100, 130))

    before, after = out["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before]
    want, classes = brute_classes(rows)
    assert len(after) == len(classes)
    class_of = {x: p for p in classes for j in p for x in [rows[j]]}
    assert len({class_of[r.doc_id, r.text] for r in after}) == len(classes)
    assert sorted((r.doc_id for r in after), key=str) == sorted((min((rows[j][0] for j in p if rows[j][0] is not None), default=None) for p in classes), key=str)

    before, after = out["pii"]
    masked = {}
    for r in before:
        text = None if r.text is None else spans.redacted(r.text, pii.find(r.text)[1])
        masked.setdefault((r.doc_id, text, r.lang, r.source, len(text or "")), []).append(r)
    assert plain(after) == sorted(masked, key=str)
    assert any("<EMAIL> or <EMAIL>" in r.text for r in after)

    before, after = out["mix"]
    taken = plain_mix([(r.doc_id, r.source, r.text) for r in before])
    times = {(i, size): t // size for i, size, _, _, t in taken if size}
    assert plain(after) == plain([r for r in before for _ in range(times[r.doc_id, len(r.text.split())])])

    before, after = out["tokens"]
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in before)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in after) == want


def test_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
