"""The corpus pipeline stage by stage, each on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from conftest import SF_SMALL
from patronage.llm import packing, quality_model
from patronage.llm.registry import vocabulary
from test_line_and_chat import brute_lines
from test_near_and_suffix import brute_classes, brute_cut


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    seen = [sorted(map(tuple, docs.collect()))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
            seen.append(sorted(map(tuple, docs.collect())))
    start, quality, lines, near, cut = ([(r[0], r[1]) for r in rows] for rows in seen)

    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = quality_model.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), labels)
    scores = model.score(np.stack([quality_model.features(t) for _, t in start]))
    assert quality == [r for r, s in zip(start, scores) if s >= 0.5]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert good & {i for i, _ in start} <= {i for i, _ in quality}  # clean documents stay

    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((i, digest(t)) for i, t in lines) == sorted((r[0], r[3]) for r in brute_lines(quality))
    classes = brute_classes(lines)
    assert near == [r for r in lines if classes[r] == r[0]]
    assert [i for i, _ in cut] == [i for i, _ in near]
    by_id = {r[0]: r for r in brute_cut(near)}
    for i, t in cut:  # text is whole characters of what is left
        assert len(t.encode()) <= by_id[i][1] - by_id[i][2]
    assert sum(len(t.encode()) for _, t in cut) >= sum(r[1] - r[2] for r in by_id.values()) - 4 * len(by_id)

    encode = packing.encoder(vocabulary("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array([*encode(t), 0], dtype="<u4").tobytes()) for i, t in cut}
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(want)
    assert all(r["ids_crc32"] == want[r["doc_id"]] for r in rows if r["piece"] == 0 and r["length"] < 2048 and not any(
        x["doc_id"] == r["doc_id"] and x["piece"] == 1 for x in rows))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
