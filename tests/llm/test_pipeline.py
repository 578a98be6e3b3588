"""The stages on a small corpus with junk, copies and shared passages, and the queries' columns."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from lodestone.llm import queries
from lodestone.llm.common import written
from tests.llm.conftest import SCHEMA, edited, prose
from tests.llm.test_edge_cases import brute_groups, brute_spans


def test_stages(spark, tmp_path):
    rows, labels = [], []
    passage = prose(999, 70)
    for k in range(400):
        text = prose(k, 80)
        if k % 10 == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif k % 10 == 1 and k > 10:
            text = edited(prose(k - 9, 80), k, 1 + k % 3)
        elif k % 10 == 3:
            text = f"{prose(k, 40)} {passage} {prose(k + 5000, 30)}"
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(k % 10 != 0), 0))
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS spans", "'y' AS k1").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        seen.append({r["doc_id"]: r for r in docs.collect()})
        if name != "pack_sequences":
            assert docs.columns == corpus_pipeline.COLUMNS
    text = {r[0]: r[1] for r in rows}
    assert set(seen[0]) == {k for k in range(400) if k % 10}
    groups = brute_groups([r for r in rows if r[0] in seen[0]], 5)
    assert set(seen[1]) == {doc_id for doc_id, _, _, kept in groups if kept}
    assert len(seen[0]) > len(seen[1])
    # ASCII texts, so what stays is what brute force leaves, byte for byte.
    left = brute_spans([(k, r["text"]) for k, r in seen[1].items()], corpus_pipeline.PASSAGE)
    for k, _, _, _, sha in left:
        assert hashlib.sha256(seen[2][k]["text"].encode()).hexdigest() == sha
        assert seen[2][k]["n_chars"] == len(seen[2][k]["text"])
    assert all(passage not in r["text"] for r in seen[2].values())
    assert all(seen[2][k]["text"] == text[k] for k in seen[2] if k % 10 > 3)
    assert set(seen[3]) <= set(seen[2]) and set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_repeated_passages_of_short_words(spark):
    """51 repeated words go whatever their bytes; 50 short ones stay, as do words that are repeated in part only."""
    short = lambda k, n: " ".join("abcdefghij"[(k * 7 + i * i + i // 3) % 10] + "klmnopqrst"[(k + i * 3 + i // 7) % 10] for i in range(n))
    passage, almost, split = short(1, 51), short(2, 50), short(3, 51)
    assert len(passage) < corpus_pipeline.PASSAGE
    texts = [
        f"{prose(1, 30)} {passage} {prose(2, 30)}", f"{prose(3, 20)}\n{passage}", f"{prose(4, 30)} {almost} {prose(5, 30)}", f"{prose(6, 30)} {almost}",
        f"{prose(7, 20)} {split} {prose(8, 9)}", f"{prose(9, 20)} x{split}y {prose(10, 9)}", None, "", "one",
        f"é {short(4, 60)} {prose(11, 50)} {short(4, 60)}",
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = list(texts)
    want[0], want[1], want[9] = f"{prose(1, 30)}  {prose(2, 30)}", f"{prose(3, 20)}\n", f"é  {prose(11, 50)} "
    assert [got[k]["text"] or "" for k in range(len(texts))] == [t or "" for t in want]
    assert all(got[k]["n_chars"] == len(t) for k, t in enumerate(want) if t is not None)


def stage_rows() -> list[tuple]:
    """Null and repeated doc_ids of different texts, nulls in every column, empty and very long texts, ties, repeated rows."""
    long, same = " ".join(prose(k + 500, 500) for k in range(80)), prose(40, 70)
    rows = [(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(3, 60)), (5, prose(4, 60)), (5, prose(5, 60)), (6, prose(6, 60))]
    rows += [(7, None), (8, ""), (None, None), (9, long), (10, same), (11, same), (11, same), (None, same), (12, edited(same, 3, 2)), (13, "one two"), (13, "one two"), (8, "")]
    return [(i, t, "en" if k % 4 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None or k % 7 == 0 else len(t)) for k, (i, t) in enumerate(rows)]


def test_stages_on_nulls_repeats_and_long_texts(spark, tmp_path):
    """Each stage's own rows against brute force: no document goes for its doc_id, one of each group stays."""
    rows = stage_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    first = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert sorted(map(tuple, first.collect()), key=key) == sorted(rows, key=key)
    once = written(corpus_pipeline.near_dedup(spark, docs, sf), "test-near")
    got = [tuple(r) for r in once.collect()]
    group = lambda t: "same" if t and t.split()[:1] == prose(40, 70).split()[:1] and len(t.split()) == 70 else t
    words = [r for r in got if r[1]]
    assert Counter(group(r[1]) for r in words) == Counter({group(r[1]) for r in rows if r[1]})
    assert [r[0] for r in words if group(r[1]) == "same"] == [10]
    assert sorted((r for r in got if not r[1]), key=key) == sorted((r for r in rows if not r[1]), key=key)
    cut = corpus_pipeline.repeated_passages(spark, docs, sf).collect()
    assert len(cut) == len(rows) and all((r["text"] or "") == "" for r in cut if r["doc_id"] in (10, 11)) and [r["text"] for r in cut if r["doc_id"] == 9] == [rows[9][1]]
    assert sum(r["text"] is None for r in cut) == 2
    mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()]
    assert set(mixed) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in Counter(mixed).items()) and all(r[1] for r in mixed)
    packed = corpus_pipeline.pack_sequences(spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows)
    spark.createDataFrame(rows[:6], SCHEMA).write.parquet(f"{sf}/six/documents.parquet")
    six = written(corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf}/six/documents.parquet"), sf), "test-six")
    assert sorted(map(tuple, six.collect()), key=key) == sorted(rows[:6], key=key)


def test_stages_on_empty_tables(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "pack_sequences" or out.columns == corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_runs_of_short_words_against_brute_force(spark):
    """Shared passages, periods, copies that part, long texts over several merged parts, repeated rows."""
    r = random.Random(11)
    word = lambda letters: r.choice(letters) + str(r.randrange(9))
    passage = [word("xyz") for _ in range(90)]
    texts = [None, ""]
    for k in range(60):
        own = [word("abc") for _ in range(r.randrange(70))]
        middle = (passage, passage[:70] + own[:9] + passage[70:], ["p", "q"] * r.randrange(20, 60), [])[k % 4]
        texts.append(" ".join([*own, *middle, *(word("def") for _ in range(r.randrange(60)))]))
    long = [word("gh") for _ in range(7000)]
    texts += [" ".join(long), " ".join([*long[:6000], *passage]), texts[5]]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    got = {d["doc_id"]: d["text"] or "" for d in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    # Words of two bytes at most, so 51 of them are below PASSAGE; strings of PASSAGE bytes count as well.
    places = [[(m.start(), m.end()) for m in re.finditer(r"\S+", t or "")] for t in texts]
    windows = [[(p[i][0], p[i + 50][1]) for i in range(len(p) - 50)] for p in places]
    size = corpus_pipeline.PASSAGE
    windows = [w + [(i, i + size) for i in range(len(t or "") - size + 1)] for w, t in zip(windows, texts, strict=True)]
    seen = Counter(texts[k][a:b] for k, w in enumerate(windows) for a, b in w)
    for k, w in enumerate(windows):
        gone = {c for a, b in w if seen[texts[k][a:b]] > 1 for c in range(a, b)}
        assert got[k] == "".join(c for i, c in enumerate(texts[k] or "") if i not in gone)
