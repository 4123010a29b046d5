"""The stages one after another on a small table, each judged on its own input."""

import re

import numpy as np
from corpus_pipeline import STAGES, run
from wickflow.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    clean = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(20)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(clean)]
    rows += [(50, clean[3], "en", "s0", 0), (51, clean[4] + " extra", "en", None, 0), (52, "too short", "en", "s1", 9), (53, "a b c d e " * 20, "en", "s1", 0), (54, None, "en", "s2", None),
             (55, clean[7] + ' password = "hunter2secret"', "en", "s2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {}
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "test-stage")
        ids[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "secret scans":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(not re.search("hunter2", t) for t in texts.values()) and texts[5] == clean[5]
    assert ids["quality rules"] == [*range(20), 50, 51, 55]
    assert ids["n-gram jaccard join"] == list(range(20)) == ids["secret scans"]
    assert set(ids["mixing sources to target weights"]) <= set(range(20)) and len(ids["mixing sources to target weights"]) >= 20
    assert "sequence_id" in docs.columns and set(ids["best-fit packing"]) == set(ids["mixing sources to target weights"])


def test_run_with_labels(spark, tmp_path):
    """The learned list takes part: texts like those labelled bad go, and nothing else does."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(500)]
    rows, bad = [], set()
    for k in range(400):
        w = list(rng.choice(words, 40, replace=False))
        if k % 5 == 0:
            w = [x + "***" for x in w]
            bad.add(k)
        t = " ".join(w)
        rows.append((k, t, "en", f"s{k % 2}", len(t)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k not in bad)) for k in range(400) if k % 4], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = STAGES[0][1](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) - bad and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(400)) - bad
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 4096
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert run(spark, empty).count() == 0
