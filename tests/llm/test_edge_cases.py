"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import dedup_spans, licenses, media, mixing, neardup, packing, quality, sharding, suffixes, topk_exact, warc
from lodestone.llm.common import written
from tests.llm.conftest import SCHEMA, as_rows, document_rows, edited, prose

ROWS = document_rows()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


# 1


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(documents, nothing):
    got = as_rows(licenses.scan(documents), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == order([(r[0], *brute_license(r[1])) for r in ROWS])
    found = {r["doc_id"]: r for r in licenses.scan(documents).collect()}
    assert found[19]["labels"] == "cc-by-nc-4.0" and found[19]["score"] == 1.0
    assert set(found[17]["labels"].split(",")) >= {"gpl"} and 0 < found[17]["score"] < 1
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in found.values())
    assert found[2]["labels"] == "" and found[2]["score"] == 0
    assert licenses.scan(nothing).count() == 0


def test_whole_licences_by_their_rarest_words():
    """A text is found by its own rarest licence words; a key phrase whose rare words stand apart is still found, scattered words are not."""
    from lodestone.llm.license_texts import APACHE, BSD, BSD_DISCLAIMER, BSD_NAMES, GPL_3, MIT

    index = licenses.Index({b"software": 900, b"the": 1000, b"license": 500, b"tort": 1, b"noninfringement": 1}, 1000)
    found = lambda t: {label: score for label, _, score in index.scan(licenses.words_of(t.encode()))}
    assert found(f"{prose(1, 30)} {MIT} {prose(2, 30)}") == {"mit-text": 1.0}
    assert found(f"{BSD} {BSD_NAMES} {BSD_DISCLAIMER}")["bsd-3-clause"] == 1.0 and "bsd-3-clause" not in found(f"{BSD} {BSD_DISCLAIMER}")
    assert found(APACHE.upper()) == {"apache": 1.0, "apache-2.0": 1.0}
    assert found(GPL_3)["gpl-3.0"] == 1.0 and "gpl-2.0" not in found(GPL_3)
    # Rare words of the text stand elsewhere, so the first places they name are refuted.
    half = " ".join(MIT.split()[:16])
    assert 0 < found(f"noninfringement tort {prose(3, 9)} {half} tort noninfringement")["mit-text"] < 0.3
    assert found("software this of copy a obtaining person any to charge of free granted hereby is permission") == {}
    assert found(prose(4, 20_000) + " mit license")["mit"] > 0
    # Words are looked up from the highest IDF on, and no further than needed.
    looked = []
    real, licenses.places_of = licenses.places_of, lambda words, w: looked.append(w) or real(words, w)
    try:
        assert index._stands(2, sorted(index.vocabulary.intersection(licenses.words_of(MIT.encode())), key=lambda w: (-index.idf[w], w)), licenses.words_of(MIT.encode()), {})
    finally:
        licenses.places_of = real
    assert len(looked) == licenses.RARE and {b"software", b"the"}.isdisjoint(looked)


# 2


def test_packing(documents, nothing):
    rows = packing.pack(documents, length=64).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 64 else (len(ids) - 1) % 64 + 1
        starts = [0, *range(first, len(ids), 64)]
        for p, s in enumerate(starts):
            part = ids[s : s + (first if p == 0 else 64)]
            want.append((r[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert order([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]) == order(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(nothing).count() == 0


def test_packed_sequences_hold_the_ids(documents):
    packed = packing.pack(documents.where("doc_id < 10"), length=64, with_ids=True)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@pytest.mark.parametrize("text", ["<|endoftext|>", "end <|endoftext|> of", "a" * 5000, " " * 3000 + "x", "日本語 テキスト", "\n\n\t mixed  \r\n", "it's we'll I'D"])
def test_the_encoder_agrees_with_the_file(text):
    """The tokenizer as the contract calls it, its special token included."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing._encoder(packing.load_ranks(path), packing.load_special(path))(text) == want


def test_special_tokens_in_texts_are_those_of_the_file(spark):
    """As the default Tokenizer encodes them, alone, side by side and next to white space."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "two  <|endoftext|>\n\n z", "<|endoftext| >", "it's <|endoftext|>'s", prose(1, 40) + "<|endoftext|>" + prose(2, 40)]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}


def test_fullest_finds_the_best_sum():
    from itertools import product

    counts = {9: 2, 7: 1, 5: 3, 2: 1}
    for room in range(1, 40):
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(used[n] <= counts[n] for n in used)
        best = max(s for c in product(*(range(k + 1) for k in counts.values())) if (s := sum(a * b for a, b in zip(c, counts, strict=True))) <= room)
        assert sum(n * c for n, c in used.items()) == best


# 3


def brute_sets(rows, words):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_groups(rows, words):
    sets = brute_sets(rows, words)
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {}
    for r, g in zip(rows, label, strict=True):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return [(r[0], len(s), low.get(g), r[0] == low.get(g)) for r, s, g in zip(rows, sets, label, strict=True)]


def test_near_duplicates(documents, nothing):
    got = as_rows(neardup.near_duplicates(documents, words=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == order(brute_groups(ROWS, 4))
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_many_edited_copies(spark, monkeypatch):
    """Similarities on both sides of the threshold, in blocks as well as whole."""
    base = [prose(s, 150) for s in range(4)]
    rows = [(k, edited(base[k % 4], k, k % 23), "en", "s", 1) for k in range(160)]
    want = order(brute_groups(rows, 5))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert as_rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want


# 4


def test_shards(documents, nothing):
    rows = sharding.shard(documents, 5).collect()
    sizes = lambda t: len((t or "").encode()) + 16
    assert order([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]) == order([(r[0], sizes(r[1]), zlib.crc32((r[1] or "").encode())) for r in ROWS])
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} <= set(range(5))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(nothing).count() == 0


def test_shards_are_near_equal(spark):
    rows = [(k, "same text" if k % 3 == 0 else prose(k, 5 + k % 40), "en", "hot" if k % 2 else f"s{k % 9}", 1) for k in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 7)
    sums = [r["n"] for r in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()]
    assert len(sums) == 7 and max(sums) < 1.03 * min(sums)
    assert as_rows(got) == as_rows(sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), 7))


# 5


def test_warc_round_trip(spark):
    pages = [(1, "http://a b/ü", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>"), (5, "u", "WARC/1.0\r\n\r\nContent-Length: 9\r\n\r\n"), (6, "u", "é" * 3000), (4, "u", "<p>x</p>"), (None, "u", "z\n\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' AS sha", "'d' AS kept", "'e' AS payload")
    archives = warc.write_archives(df)
    got = as_rows(warc.read_archives(archives), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in pages:
        b, top = (h or "").encode(), last[h or ""]
        revisit = Counter((x[2] or "") for x in pages)[h or ""] > 1 and p != top
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert got == order(want)


def test_archives_of_long_pages(spark, monkeypatch, tmp_path):
    """Very long pages, archives bounded by bytes, one gzip member per record, dates and addresses of the data, files."""
    pages = [(k, f"http://h{k % 3}.example/p", "<p>" + "é\r\n" * (700_000 if k == 4 else 40_000 * (k % 4)) + "</p>" * (k % 5), f"192.0.2.{k}", datetime(2003, 1, 1 + k, 4, 5, 6)) for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, ip string, fetched timestamp").coalesce(1)
    legacy = warc.legacy_archives(df).collect()
    assert len(legacy) == 1 and len(list(warc.read_arc(legacy[0]["content"]))) == 12
    archives = warc.write_archives(df)
    found = {r["page_id"]: r for r in warc.read_archives(archives).collect()}
    for page_id, url, html, ip, _ in pages:
        r = found[page_id]
        assert (r["payload_bytes"], r["ip"], r["date"], r["url"]) == (len(html.encode()), ip, f"2003-01-{1 + page_id:02}T04:05:06Z", url)
    warc.export(archives, f"file://{tmp_path}/out")
    [file] = [f.read_bytes() for f in (tmp_path / "out").iterdir()]
    members = 0
    while file:
        one = zlib.decompressobj(31)
        assert one.decompress(file).startswith(b"WARC/1.0\r\n")
        file, members = one.unused_data, members + 1
    assert members == 13
    plain = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(df.drop("ip", "fetched"))).collect()}
    assert plain[3]["ip"] == plain[6]["ip"] != plain[4]["ip"] and plain[3]["date"] == "1996-09-23T14:22:06Z"


def test_archives_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(warc, "ARC_BYTES", 100)
    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 7})())}))
    n = 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None] * n, pa.int64()), pa.array(["u"] * n), pa.array(["10.0.0.1"] * n), pa.array(["20010203040506"] * n), pa.array([b"x" * 40] * n, pa.binary())], ["page_id", "refers_to", "url", "ip", "date", "payload"])
    files = [r for b in warc._arc_files([batch]) for r in b.to_pylist()]
    assert [f["page_ids"] for f in files] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]] and len({f["name"] for f in files}) == 3
    assert [f["content"].split(b"\n")[1][:1] for f in files] == [b"1", b"2", b"1"]


def test_warc_of_no_pages(spark):
    none = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [warc.ArcRecord("http://a/ b", "1.2.3.4", "20010203040506", "text/html", b"body\n\nWARC"), warc.ArcRecord("u", "-", "20010203040506", "x/y", b"")]
    found = list(warc.read_arc(warc.write_arc(records, version)))
    assert [r.payload for r in found] == [r.payload for r in records] and found[0].url == "http://a/%20b"
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.write_arc(records, version)[:-8]))


# 6


def test_exact_search(spark):
    nan = float("nan")
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))], i) for i in range(240)]
    rows += [(300, None, 1), (350, [1.0, None], 1), (400, [nan] * 8, 1), (450, [float("inf")] * 8, 1), (500, [], 1), (550, [0.5, 0.5], 1), (rows[3][0], rows[3][1], 9)]
    rows += [(k, rows[7][1], 0) for k in (600, 601, 602)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS v", "'y' AS rb")
    vectors = topk_exact.integer_vectors(df)
    got = as_rows(topk_exact.search(vectors, vectors.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score")
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == order(want)
    # Of many equal vectors the smallest ids come first, and no more than k + 1 of them travel.
    same = spark.range(200).selectExpr("id AS vec_id", "array(1L, 2L) AS v")
    assert as_rows(topk_exact.search(same, same.where("vec_id IN (0, 100)")), "query_id", "rank", "vec_id") == [(0, k, k) for k in range(1, 6)] + [(100, k, k - 1) for k in range(1, 6)]
    few = vectors.where("vec_id IN (0, 1, 500)")
    assert topk_exact.search(few, few.where("vec_id = 0")).count() == 2
    none = vectors.where("vec_id < 0")
    assert topk_exact.search(none, none).count() == 0


def test_only_entries_above_the_threshold_travel(spark, monkeypatch):
    """Over several blocks: far fewer entries than pairs leave the cells, and each of them reaches its share of the cutoff."""
    monkeypatch.setattr(topk_exact, "ROW_BLOCK", 100)
    monkeypatch.setattr(topk_exact, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(600, 32)) / np.sqrt(32)).astype(int)
    rows = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "vec_id long, v array<long>").withColumn("rid", F.col("vec_id") + 7)
    queries = written(rows.where("vec_id % 20 = 0").drop("rid"), "test-queries")
    sums, cutoffs = topk_exact.collected(rows, queries, 600, 30, 32, 5)
    cut = {r["query_id"]: r["cutoff"] for r in cutoffs.collect()}
    half = np.stack([v[:, :16] @ v[:, :16].T, v[:, 16:] @ v[:, 16:].T])
    got = {(r["query_id"], r["vec_id"]): (r["known"], r["segments"]) for r in sums.collect()}
    want = {}
    for q in range(0, 600, 20):
        for x in range(600):
            parts = [int(h[q, x]) for h in half if 2 * h[q, x] >= cut[q]]
            if x != q and parts:
                want[q, x] = (sum(parts), len(parts))
        assert cut[q] <= sorted(int(half[:, q, x].sum()) for x in range(600) if x != q)[-5]
    assert got == want and len(got) < 0.15 * 30 * 600
    found = as_rows(topk_exact.search(rows.drop("rid"), queries), "query_id", "rank", "vec_id", "score")
    full = half.sum(axis=0)
    assert found == [(q, r, x, int(full[q, x])) for q in range(0, 600, 20) for r, x in enumerate(sorted((x for x in range(600) if x != q), key=lambda x: (-full[q, x], x))[:5], 1)]


# 7


def test_transport_streams(documents, nothing):
    rows = media.read(media.store(documents)).collect()
    want = []
    for r in ROWS:
        b = (r[1] or "").encode()
        p = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert order([tuple(r)[:5] for r in rows]) == order(want)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.read(media.store(nothing)).count() == 0


@pytest.mark.parametrize("n", [1, 170, 171, 175, 176, 32_767, 32_768, 32_769, 65_536 + 176, 150_001])
def test_streams_of_several_elementary_packets(n):
    """Sizes around every edge: payloads, timestamps, random-access points, and counters that run on across packets."""
    payload = bytes(k * k % 251 for k in range(n))
    media_bytes = media.encode(payload)
    s, chunks = media.decode(media_bytes, strict=True), -(-n // media.CHUNK)
    assert s.payload == payload and s.lost == 0 and s.pts == [k * media.TICKS for k in range(chunks)]
    packets = [media_bytes[i : i + 188] for i in range(0, len(media_bytes), 188)]
    own = [p for p in packets if (p[1] & 0x1F) << 8 | p[2] == media.ES_PID]
    assert [p[3] & 15 for p in own] == [k % 16 for k in range(len(own))]
    assert s.random_access == [i for i, p in enumerate(packets) if p[1] & 0x40 and p in own] and len(s.random_access) == chunks
    if len(own) > 2:
        missing = b"".join(p for i, p in enumerate(packets) if i != len(packets) - 2)
        assert media.decode(missing).lost == 1
        with pytest.raises(ValueError):
            media.decode(missing, strict=True)


def test_stored_streams_of_long_texts(spark):
    docs = spark.createDataFrame([(1, prose(1, 20_000)), (2, None), (1, prose(1, 20_000))], "doc_id long, text string")
    rows = media.read(written(media.store(docs), "test-media")).collect()
    text = prose(1, 20_000).encode()
    for r in rows:
        assert r["payload_sha256"] == hashlib.sha256(media.payload_of(text if r["doc_id"] == 1 else b"")).hexdigest()
        assert len(r["pts"]) == len(r["random_access"]) == (-(-len(media.payload_of(text)) // media.CHUNK) if r["doc_id"] == 1 else 1)


def test_lost_packets_are_noticed():
    stream = media.encode(bytes(range(256)) * 40)
    assert media.decode(stream).lost == 0
    cut = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.decode(cut).lost == 1
    with pytest.raises(ValueError):
        media.decode(stream[:-1])


# 8


def brute_spans(rows, span):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        cover = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                cover[i : i + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(cover)))
        kept = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        out.append((r[0], len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("span", [400, 120, 64])
def test_repeated_spans(documents, nothing, span):
    got = as_rows(dedup_spans.removed_spans(documents, span), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == order(brute_spans(ROWS, span))
    assert dedup_spans.removed_spans(nothing, span).count() == 0


SPANS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def variants() -> list[tuple]:
    """Anchors of many contexts: a line among other words each time, edited copies, periods."""
    line, base = prose(77, 12), prose(1, 200)
    rows = [(k, f"{prose(k, 60)} {line} {prose(k + 900, 60)}", "en", "s", 1) for k in range(60)]
    rows += [(100 + k, edited(base, k, 1 + k % 9), "en", "s", 1) for k in range(60)]
    return rows + [(200, "ab" * 900, "en", "s", 1), (201, "c" + "ab" * 700, "en", "s", 1)]


@pytest.mark.parametrize(("span", "hot", "keep"), [(400, 1000, 7), (64, 3, 20_000), (400, 3, 7), (64, 0, 7)])
def test_repeated_spans_of_hot_anchors(spark, documents, monkeypatch, span, hot, keep):
    """Anchors are lengthened until few contexts share them, queues spill, lists are joined by shuffle: the same bytes go."""
    monkeypatch.setattr(dedup_spans, "BROADCAST_ROWS", 0)
    rows = variants()
    assert as_rows(dedup_spans.removed_spans(spark.createDataFrame(rows, SCHEMA), span, hot=hot, keep=keep), *SPANS) == order(brute_spans(rows, span))
    assert as_rows(dedup_spans.removed_spans(documents, span, hot=hot, keep=keep), *SPANS) == order(brute_spans(ROWS, span))


def test_a_common_passage_in_very_many_rows(spark):
    """One line in a third of all rows and one passage in another third, as the check tables have them, and a long text."""
    line, passage = prose(5, 20), prose(6, 90)
    texts = [prose(k, 30) + (f" {line} " if k % 3 == 0 else f" {passage} " if k % 3 == 1 else " ") + prose(k + 3000, 30) for k in range(600)]
    texts.append(" ".join(prose(k + 9000, 500) for k in range(60)) + passage)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = dedup_spans.removed_spans(spark.createDataFrame(rows, SCHEMA), hot=50).collect()
    assert order([tuple(r)[:5] for r in got]) == order(brute_spans(rows, 400))
    assert all(passage not in r["text"] and (r["doc_id"] % 3 or r["doc_id"] == 600 or line in r["text"]) for r in got)


def test_sorting_spills_and_agrees_with_sorted():
    """Suffixes of a shard that is larger than the queue: runs reach the disk, and order and common prefixes are exact."""
    rng = np.random.default_rng(3)
    strings = [bytes(rng.choice(list(b"ab"), rng.integers(0, 300))) for _ in range(200)]
    strings += [s + b"tail" for s in strings[:60]] + strings[:20] + [b"x" * 700 + bytes([65 + k % 3]) for k in range(40)]
    group = np.array([k % 7 for k in range(len(strings))])
    written = []

    class Counted(suffixes.DiskQueue):
        def _spill(self):
            written.append(len(self.buffer))
            super()._spill()

    before, suffixes.DiskQueue = suffixes.DiskQueue, Counted
    try:
        found, common = suffixes.induce(group, np.array([len(s) for s in strings]), lambda i, d: strings[i][d * 64 : d * 64 + 64], keep=16)
    finally:
        suffixes.DiskQueue = before
    assert len(written) > 20 and max(written) == 16
    assert [(group[i], strings[i]) for i in found] == sorted((group[i], s) for i, s in enumerate(strings))
    for a, b, n in zip(found, found[1:], common[1:], strict=False):
        x, y = strings[a], strings[b]
        shared = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        assert n == (shared if group[a] == group[b] else 0)


@pytest.mark.parametrize(("pairwise", "part"), [(4, 300), (10_000, 1 << 20)])
def test_slices_and_both_ways_of_comparing(monkeypatch, pairwise, part):
    """Worker functions in this process, so that their limits can be set."""
    monkeypatch.setattr(dedup_spans, "PAIRWISE", pairwise)
    monkeypatch.setattr(dedup_spans, "SLICE", part)
    rows, span = variants(), 200
    texts = [r[1].encode() for r in rows]
    keys = np.arange(len(rows))
    table = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys), pa.array(texts, pa.binary())], ["k1", "k2", "text"])
    # Every context goes through the sort, those that are equal as a whole too.
    wanted = [[] for _ in rows]
    for batch in dedup_spans._find(span, [table.slice(k, 1) for k in range(len(rows))]):
        for r in batch.to_pylist():
            if not r["run"]:
                wanted[r["k1"]].append({"h": r["h"], "single": True, "at": r["at"], "first": r["first"], "last": r["last"]})
    kind = pa.list_(pa.struct([("h", pa.int64()), ("single", pa.bool_()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
    contexts = list(dedup_spans._contexts(span, [table.append_column("wanted", pa.array(wanted, kind))]))
    cover = [bytearray(len(t)) for t in texts]
    found = [r for b in dedup_spans._decide(span, 50, contexts) for r in b.to_pylist()]
    # Runs inside one row that _find has noted itself.
    found += [r for b in dedup_spans._find(span, [table.slice(k, 1) for k in range(len(rows))]) for r in b.to_pylist() if r["run"]]
    for r in found:
        cover[r["k1"]][r["first"] : r["last"]] = b"\1" * (r["last"] - r["first"])
    assert [sum(c) for c in cover] == [r[2] for r in brute_spans(rows, span)]


def test_characters_stay_whole():
    text = "aéé".encode()
    assert dedup_spans.kept_text(text, [2, 4]) == "aéé"
    assert dedup_spans.kept_text(text, [1, 4]) == "aé"
    assert dedup_spans.kept_text(text, None) == "aéé"


# 9


def test_classifier_on_labels_that_do_not_help(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(documents, labels).collect()
    assert len(rows) == len(ROWS) and all(r["kept"] and r["score"] == 1.0 for r in rows)
    assert quality.score(nothing, labels).count() == 0


def junk(k: int, text: str) -> str:
    """Repetition, marks, or words of another kind in sound sentences."""
    if k % 3 == 0:
        return " ".join(w for w in text.split()[:12] for _ in range(8))
    if k % 3 == 1:
        return " ".join(f"{w.upper()}!!" for w in text.split())
    r = random.Random(k)
    return " ".join(f"{w} {r.choice(('casino', 'jackpot', 'bonus', 'spins'))}" if i % 3 == 0 else w for i, w in enumerate(text.split()))


def test_classifier_on_documents_without_labels(spark):
    """Half of the documents have labels, good and bad alike. The other half is unseen: its junk goes, its good documents stay."""
    rows, labels = [], []
    for k in range(3000):
        bad, text = k % 4 == 0, prose(k, 60 + k % 50)
        text = junk(k // 4, text) if bad else text
        rows.append((k, text, "en", f"s{k % 5}", len(text)))
        if k // 4 % 2:
            labels.append((k, int(not bad), 0))
    docs = spark.createDataFrame([*rows, (5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, prose(1, 30_000), "en", "s1", None), (3, rows[3][1], "en", "s3", 9)], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in quality.score(docs, known).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) + 4 and len(got[3]) == 2
    unseen = [k for k in range(3000) if not k // 4 % 2]
    assert np.mean([got[k][0]["kept"] for k in unseen if k % 4]) >= 0.99
    assert np.mean([not got[k][0]["kept"] for k in unseen if k % 4 == 0]) >= 0.95
    assert all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    report = quality.fit(docs, known).report
    assert report["held_out"] > 50 and report["accuracy"] >= 0.97 and sum(a for a, _ in report["exchanged"]) > 0


def test_views_share_nothing():
    """The text view sees no metadata, the metadata view no text; both against counts made plainly."""
    batch = lambda t, n, s: pa.RecordBatch.from_pylist([{"text": t, "n_chars": n, "source": s, "lang": "en"}])
    a, b, c = (quality._views(batch(*x)) for x in ((b"one two", 7, "s"), (b"one two", 99, "t"), (b"other words here", 7, "s")))
    assert (a[1] == b[1]).all() and (a[2] == c[2]).all() and (a[3] == c[3]).all() and (a[1] != c[1]).any() and a[2] != b[2]
    y = np.array([1, 1, 0, 0])
    rows = [np.array(quality.buckets(t)) for t in (b"good text", b"Good day.", b"bad text", b"bad")]
    w = quality.word_weights(rows, y)
    for word, good, bad in ((b"good", 2, 0), (b"text", 1, 1), (b"bad", 0, 2), (b"day", 1, 0)):
        assert w[quality.bucket(word)] == pytest.approx(np.log(((good + 0.5) / 3) / ((bad + 0.5) / 3)))


def test_regression_against_plain_descent():
    """The Newton steps of a view end where slow gradient descent ends."""
    rng = np.random.default_rng(2)
    x = np.append(rng.normal(size=(80, 3)), np.ones((80, 1)), axis=1)
    y = (x @ [1.0, -2.0, 0.5, 0.3] + rng.normal(size=80) > 0).astype(int)
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.02 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + w)
    assert np.allclose(quality.fit_logistic(x, y), w, atol=1e-5)


# 10


def test_mix(documents, nothing):
    rows = mixing.mix_documents(documents).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert order([(r["doc_id"], r["size"]) for r in rows]) == order([(r[0], size(r[1])) for r in ROWS])
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {(r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(total) and all(0 <= t <= 3 * s + 1e-9 for s, t in targets)
    assert mixing.mix_documents(nothing).count() == 0
    copies = mixing.repeat_documents(documents)
    assert copies.columns == documents.columns
    # Rows with null or repeated doc_ids are repeated each by their own decision.
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in copies.collect():
        got[r["doc_id"]] += size(r["text"])
    assert +got == +want


def test_inclusion_follows_size(spark):
    """Without repairs: over very many sources alike, a document is drawn as often as its size says; certain ones always."""
    sizes, n = [*range(60, -1, -2)], 400
    rows = [(s * 100 + i, " ".join(["w"] * z), "en", f"s{s:03}", 1) for s in range(n) for i, z in enumerate(sizes)]
    got = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), weights=(3.0, 2.0), repairs=0).collect()
    seen, whole = defaultdict(list), sum(sizes)
    for r in got:
        seen[r["target"] > whole, r["doc_id"] % 100].append(r["copies"])
    for over, rest in ((True, 0.2 * whole), (False, 0.8 * whole)):
        certain = 0
        while (rate := (rest - sum(sizes[:certain])) / sum(z * z for z in sizes[certain:])) * sizes[certain] > 1:
            certain += 1
        for i, z in enumerate(sizes[:-1]):
            copies = [c - over for c in seen[over, i]]
            assert set(copies) <= {0, 1} and len(copies) == n // 2
            p = min(1, rate * z)
            assert abs(np.mean(copies) - p) < 0.13 and (p < 1 or min(copies) == 1)
        assert (certain > 0) != over


def test_mix_comes_near_its_targets(spark):
    rows = [(k, prose(k, 3 + k % 30), "en", None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 7}", 1) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_documents(docs)
    by = {r["source_size"]: r for r in got.groupBy("source_size").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()}
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, open_, want = sum(sizes.values()), set(sources), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]:
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
            open_.discard(s)
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert len(want) == len(by)
    for s, t in want.items():
        r = by[sizes[s]]
        assert r["max(target)"] == pytest.approx(t) and abs(r["sum(taken)"] - t) <= 3
    assert as_rows(got) == as_rows(mixing.mix_documents(docs.repartition(7)))
    assert mixing.repeat_documents(docs).count() == got.agg({"copies": "sum"}).first()[0]
