"""License scans by a positional rare-token index.

TEMPLATES are the licence texts and notices looked for (license_texts.py). Their
words, with their positions, form the index; a first pass over all documents
counts in how many of them each of these words stands, which gives the inverse
document frequencies. A template comes into question for a text that holds all
words of its mandatory key phrase. The text's own licence words are then looked up
from the highest IDF on: the postings of a word are intersected, by relative
position (place in the text minus place in the template), with those of the
words before it. Where RARE words agree on a place at which the template would
begin, the key phrase is verified there, consecutively; a text that holds the
template is thus recognised by its rarest words. If they do not agree on a place
with the key phrase, further words are looked up until all of the key phrase are
among them, so that no place of it can be missed. The score of a label is the best
share, by IDF, of a template that stands around a place of its key phrase.

Texts are read whole, as UTF-8, A-Z in lower case; words are runs of ASCII
letters and digits and of all characters beyond ASCII. Null and empty texts have
no words. Every row gives one row; equal texts and repeated rows give equal
results, one each. An empty table gives an empty one; other columns take no part,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.license_texts import TEMPLATES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RARE = 2

#: Base labels and their phrases; every place of a phrase counts.
BASE = {"mit": (b"mit", b"license"), "apache": (b"apache", b"license"), "gpl": (b"general", b"public", b"license")}
class Index:
    """The templates' words with their positions, and what each word is worth."""

    def __init__(self, df: dict[bytes, int], n_docs: int, templates=TEMPLATES, rare: int = RARE):
        self.rare = rare
        self.templates = [(label, tuple(words_of(key.encode())), tuple(words_of(text.encode()))) for label, key, text in templates]
        self.postings: list[dict[bytes, list[int]]] = []  # per template: word to its positions
        for _, _, text in self.templates:
            at = defaultdict(list)
            for i, w in enumerate(text):
                at[w].append(i)
            self.postings.append(dict(at))
        self.vocabulary = frozenset(w for at in self.postings for w in at)
        self.keys = [frozenset(key) for _, key, _ in self.templates]
        self.idf = {w: math.log(1 + n_docs / (1 + df.get(w, 0))) + 1e-9 for w in self.vocabulary}
        self.weight = [sum(self.idf[w] for w in text) for _, _, text in self.templates]
        self.key_at = [next(j for j in range(len(n)) if n[j : j + len(k)] == k) for _, k, n in self.templates]

    def scan(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, place, score) of the best place of each template that the text's rarest words point to."""
        here = self.vocabulary.intersection(words)
        asked = [t for t, key in enumerate(self.keys) if key <= here]
        if not asked:
            return []
        ranked = sorted(here, key=lambda w: (-self.idf[w], w))
        seen: dict[bytes, list[int]] = {}
        return [self._best(t, words) for t in asked if self._stands(t, ranked, words, seen)]

    def _stands(self, t: int, ranked: list[bytes], words: list[bytes], seen: dict) -> bool:
        postings, key, shift = self.postings[t], self.templates[t][1], self.key_at[t]
        agree: Counter = Counter()
        left, looked, refuted = set(key), 0, set()
        for w in ranked:
            if w not in postings:
                continue
            if w not in seen:
                seen[w] = places_of(words, w)
            agree.update({p - i for p in seen[w] for i in postings[w]})
            left.discard(w)
            looked += 1
            if looked % self.rare and left:
                continue
            for start in [x for x, n in agree.items() if n >= min(self.rare, looked) and x not in refuted]:
                if start + shift >= 0 and tuple(words[start + shift : start + shift + len(key)]) == key:
                    return True
                refuted.add(start)
            if not left:
                return False
        return False

    def _best(self, t: int, words: list[bytes]) -> tuple[str, int, float]:
        label, key, text = self.templates[t]
        best = (-1.0, 0)
        for place in phrase_places(words, key):
            start = place - self.key_at[t]
            got = sum(self.idf[w] for i, w in enumerate(text) if 0 <= start + i < len(words) and words[start + i] == w)
            best = max(best, (got / self.weight[t], -start))
        return label, -best[1], best[0]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


VOCABULARY = frozenset(w for _, _, text in TEMPLATES for w in words_of(text.encode()))


def places_of(words: list[bytes], word: bytes) -> list[int]:
    out, i = [], -1
    for _ in range(words.count(word)):
        i = words.index(word, i + 1)
        out.append(i)
    return out


def phrase_places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Every start of the phrase, from the places of its first word."""
    return [i for i in places_of(words, phrase[0]) if tuple(words[i : i + len(phrase)]) == phrase]


def scan_text(text: bytes | None, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and the matches as (label, place, score)."""
    words = words_of(text)
    matches = index.scan(words)
    labels = {label for label, _, _ in matches}
    # A base phrase is the key phrase of a template, so only texts that the index gave its label can hold it.
    starts = {label: phrase_places(words, BASE[label]) for label in BASE if label in labels}
    every = sorted(i for at in starts.values() for i in at)
    score = round(min(1.0, max((s for _, _, s in matches), default=0.0)), 9)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(starts)), ",".join(sorted(labels)), score, matches


def _frequencies(batches):
    for batch in batches:
        df: Counter = Counter()
        for t in batch.column("text").to_pylist():
            df.update(VOCABULARY.intersection(words_of(t)))
        df[b""] = batch.num_rows  # no word is empty: the number of documents
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in df]), pa.array(df.values(), pa.int64())], ["word", "n"])


def _scan(index: Index, batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64()), ("score", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    for batch in batches:
        rows = [scan_text(t, index) for t in batch.column("text").to_pylist()]
        cols = [[r[i] for r in rows] for i in range(7)]
        cols.append([[{"label": a, "place": b, "score": s} for a, b, s in r[7]] for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, labels, score, and the verified notices with their places."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # One row per word of the templates: a list as long as the vocabulary, whatever the corpus.
    counted = texts.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in counted}
    index = Index(df, df.pop(b"", 0))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,place:long,score:double>>"
    return texts.mapInArrow(partial(_scan, index), schema)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


def oracle() -> str:
    """The query in SQL: key phrases at any place, and the weighted share of their notice that stands around them."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    index = Index({}, 0)
    rows = ", ".join(f"({t}, '{label}', {quoted(key)}, {quoted(text)}, {index.key_at[t]})" for t, (label, key, text) in enumerate(index.templates))
    base = ", ".join(f"('{label}', {quoted(phrase)})" for label, phrase in BASE.items())
    return rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
t(t, label, key, notice, shift) AS (VALUES {rows}),
v AS (SELECT DISTINCT unnest(notice) AS word FROM t),
f AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(l) AS word FROM w) SEMI JOIN v USING (word) GROUP BY word),
x AS (SELECT v.word, ln(1 + (SELECT count(*) FROM w)::DOUBLE / (1 + coalesce(df, 0))) + 1e-9 AS idf FROM v LEFT JOIN f USING (word)),
g AS (SELECT t, sum(idf) AS weight FROM (SELECT t, unnest(notice) AS word FROM t) JOIN x USING (word) GROUP BY t),
p AS (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM w WHERE list_has_any(l, (SELECT list(DISTINCT key[1]) FROM t))),
m AS (SELECT r, l, i, t.* FROM p JOIN t ON l[i] = key[1] AND l[i:i + len(key) - 1] = key),
o AS (SELECT r, t, label, i, l, notice, i - shift AS start, unnest(range(1, len(notice) + 1)) AS j FROM m),
s AS (SELECT r, t, any_value(label) AS label, i, sum(CASE WHEN start + j - 1 >= 1 AND l[start + j - 1] = notice[j] THEN idf ELSE 0 END) / any_value(weight) AS score FROM o JOIN x ON x.word = notice[j] JOIN g USING (t) GROUP BY r, t, i),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(least(max(score), 1), 9) AS score FROM s GROUP BY r),
b(label, key) AS (VALUES {base}),
c AS (SELECT r, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p JOIN b ON l[i] = key[1] AND l[i:i + len(key) - 1] = key GROUP BY r)
SELECT doc_id, len(l) AS n_words, coalesce(c.n, 0) AS n_base, c.first AS first_word, c.last AS last_word, coalesce(c.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0) AS score
FROM w LEFT JOIN a USING (r) LEFT JOIN c USING (r)"""
