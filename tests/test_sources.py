import json

import numpy as np
import pytest

from lodestone.sources import vectors as V


def test_formats():
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (V.parse_fbin(V.fbin_bytes(x)) == x).all() and len(V.parse_fbin(V.fbin_bytes(x), 2)) == 2
    assert (V.parse_vecs(V.vecs_bytes(x)) == x).all()
    assert (V.parse_vecs(V.vecs_bytes(x.astype(np.int32), "<i4"), "<i4") == x).all()
    for bad in (V.fbin_bytes(x)[:-1], b"1"):
        with pytest.raises(ValueError):
            V.parse_fbin(bad)
    with pytest.raises(ValueError):
        V.parse_vecs(V.vecs_bytes(x) + V.vecs_bytes(x[:, :2]))
    assert V.fnv1a(b"") == 0xCBF29CE484222325 and V.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_read_files(spark, tmp_path):
    x = np.arange(20, dtype=np.float32).reshape(5, 4)
    (tmp_path / "a.fbin").write_bytes(V.fbin_bytes(x))
    (tmp_path / "b.fbin").write_bytes(V.fbin_bytes(x + 100))
    np.save(tmp_path / "h.npy", x.astype(np.float16))
    rows = V.with_offsets(V.read_vectors(spark, f"file://{tmp_path}/*.fbin", "fbin"))
    got = {r["offset"]: r["vector"] for r in rows.collect()}
    assert sorted(got) == list(range(10)) and got[5] == [100.0, 101.0, 102.0, 103.0]
    assert [r["vector"] for r in V.read_vectors(spark, f"file://{tmp_path}/h.npy").orderBy("row").collect()] == x.tolist()
    base, held = V.hold_out(rows, 3)
    assert base.count() == 7 and sorted(r["qid"] for r in held.collect()) == [0, 1, 2]


def test_line_formats(spark, tmp_path):
    (tmp_path / "tests.jsonl").write_text(json.dumps({"query": [1.0], "conditions": None, "closest_ids": [4, 2], "closest_scores": [0.9, 0.5]}) + "\n")
    lines = [json.dumps({"_id": i, "title": t, "text": "x"}) for i, t in (("d1", ""), ("d2", "T"))]
    (tmp_path / "corpus.jsonl").write_text("\n".join(lines))
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t2\nq1\td9\t1\n")
    assert V.read_tests(spark, f"file://{tmp_path}/tests.jsonl").first()["closest_ids"] == [4, 2]
    corpus = V.read_corpus(spark, f"file://{tmp_path}/corpus.jsonl")
    assert {r["id"]: r["values"] for r in corpus.collect()} == {"d1": ["x"], "d2": ["T", "x"]}
    ids, queries = spark.createDataFrame([("d1", 0), ("d2", 1)], "id string, offset long"), spark.createDataFrame([("q1", 5)], "id string, qid long")
    qrels = V.read_qrels(spark, f"file://{tmp_path}/qrels.tsv")
    with pytest.raises(ValueError, match="d9"):
        V.map_qrels(qrels, ids, queries)
    assert [tuple(r) for r in V.map_qrels(qrels, ids, queries, ("d9",)).collect()] == [(5, 1, 2)]
