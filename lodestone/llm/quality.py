"""Quality classifier by co-training of two views.

One view sees the text's content: its words (how much likelier each is in good
than in bad documents, by WORDS hashed counts), character classes, repetition,
word shapes. The other sees the page's metadata alone: source, language, their
pair, and the length that the table states. Each is a logistic regression over
binned features. Over ROUNDS rounds each view labels the unlabelled pool; its
confident labels join the other view's training rows. Both views are then
calibrated on labelled rows of their own, combined by a regression on their
calibrated logits, and every document is scored.

Fitting uses bounded samples chosen by a hash of doc_id: at most about LABELLED
labelled rows and about POOL unlabelled ones. The labelled rows are split by
another hash (PARTS): words are counted on one part, the views trained on the
next, calibrated and combined on the third, the cut is set on the fourth, and
the last, which nothing is fitted on, gives the accuracy in Model.report. Scoring
covers all rows and whole texts. The cut is the largest score that still keeps
KEEP of the fourth part's rows of good quality.

Null and empty texts have zero counts, null metadata is a value of its own. With
no labels, or labels of one class only in any part but the last, every document
scores 1 and is kept. A doc_id that is labelled several times counts by its mean
label; rows that repeat a doc_id are scored each. An empty table gives an empty
one; other columns take no part, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

LABELLED, POOL = 12_000, 6_000
#: Shares of the labelled rows: word counts, training, calibration, cut, report.
PARTS = (0.25, 0.35, 0.16, 0.14, 0.10)
COUNTED, TRAINED, CALIBRATED, CUT, REPORTED = range(5)
WORDS = 1 << 14  # buckets of words
ROUNDS, CONFIDENT, PER_ROUND = 4, 0.97, 1500
BINS, HASHED = 12, 48
KEEP = 0.999

_CLASS = np.zeros(256, np.int64)  # 0 other
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\v\f", b"\n", b".,;:'\"?-()", b"!", b"#$%&*@", b"|<>{}[]=_/\\^~`+", range(128, 256)), 1):
    for _c in _chars:
        _CLASS[_c] = _i
N_CONTENT = 18


def content(text: bytes) -> list[float]:
    """Shares of character classes, and how words repeat and look."""
    n = max(1, len(text))
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=11) / n
    words = text.split()
    m = max(1, len(words))
    bare = len({w.strip(b".,;:!?*#$%&|") for w in words}) / m
    chars = sum(map(len, words)) / m
    letters = counts[1] + counts[2]
    ends = sum(1 for w in words if w[-1] in b"!#$%&*|@") / m
    marks = sum(1 for w in words if len(w) < 3 and not w.isalnum() and w.isascii()) / m
    halves = len({*words[: m // 2]} & {*words[m // 2 :]}) / m
    return [*counts[:10].tolist(), len({*words}) / m, bare, sum(map(eq, words, words[1:])) / m, chars, counts[2] / max(letters, 1e-9), ends, marks, halves]


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORDS


def buckets(text: bytes) -> list[int]:
    """The distinct words of a text, hashed; A-Z in lower case, marks around them left out."""
    return sorted({bucket(w.strip(b".,;:!?()'\"")) for w in set(text.lower().split())})


def word_weights(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per bucket the log of how much likelier good documents hold it than bad ones."""
    held = [np.bincount(np.concatenate([r for r, c in zip(rows, y, strict=True) if c == k]).astype(np.int64), minlength=WORDS) for k in (0, 1)]
    share = [(h + 0.5) / ((y == k).sum() + 1.0) for k, h in enumerate(held)]
    return np.log(share[1] / share[0])


def by_words(found: np.ndarray, weights: np.ndarray) -> list[float]:
    """The mean weight of a text's words, and how low the lowest tenth of them goes."""
    if not len(found):
        return [0.0, 0.0]
    w = weights[found]
    return [float(w.mean()), float(np.partition(w, len(w) // 10)[len(w) // 10])]


def stated_length(n_chars) -> list[float]:
    return [-1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))]


def hashed(source, lang) -> list[int]:
    names = (source, lang, f"{source}/{lang}")
    return [zlib.crc32(f"{i}:{x}".encode()) % HASHED for i, x in enumerate(names)]


@dataclass
class View:
    """Binned features and one-hot names under a logistic regression."""

    edges: np.ndarray | None = None  # features x (BINS - 1)
    w: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    def fit_edges(self, x: np.ndarray) -> None:
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T

    def design(self, x: np.ndarray, names: np.ndarray | None) -> np.ndarray:
        n, d = x.shape
        bins = (x[:, :, None] > self.edges[None]).sum(axis=2)
        out = np.zeros((n, d * BINS + (HASHED if names is not None else 0) + 1), np.float32)
        out[np.arange(n)[:, None], np.arange(d) * BINS + bins] = 1
        if names is not None:
            for k in range(names.shape[1]):
                out[np.arange(n), d * BINS + names[:, k]] += 1
        out[:, -1] = 1
        return out

    def logit(self, design: np.ndarray) -> np.ndarray:
        return design @ self.w * self.scale[0] + self.scale[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton steps with a ridge."""
    x = x.astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray  # weights of the two calibrated logits, and a constant
    cut: float
    weights: np.ndarray  # of words
    report: dict = field(default_factory=dict)

    def scores(self, xa, xb, names):
        a, b = self.text.logit(self.text.design(xa, None)), self.meta.logit(self.meta.design(xb, names))
        return sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2]), sigmoid(a), sigmoid(b)


def co_train(found, xa, xb, names, y, part, rounds: int = ROUNDS, keep: float = KEEP) -> Model:
    """y: 0 or 1, -1 for the unlabelled pool; part: which of PARTS a labelled row belongs to; found: its words."""
    of = lambda p: np.flatnonzero((y >= 0) & (part == p))
    weights = word_weights([found[i] for i in of(COUNTED)], y[of(COUNTED)])
    xa = np.concatenate([xa, np.array([by_words(f, weights) for f in found])], axis=1)
    train, pool = (y >= 0) & (part == TRAINED), y < 0
    views = View(), View()
    views[0].fit_edges(xa[train | pool])
    views[1].fit_edges(xb[train | pool])
    designs = views[0].design(xa, None), views[1].design(xb, names)
    given = [y.copy(), y.copy()]  # the labels that each view trains on
    exchanged = []
    for r in range(rounds + 1):
        for v, d, g in zip(views, designs, given, strict=True):
            rows = (train | pool) & (g >= 0)
            v.w = fit_logistic(d[rows], g[rows])
        if r == rounds:
            break
        told = [0, 0]
        for i in (0, 1):
            p = sigmoid(designs[i] @ views[i].w)
            other = given[1 - i]
            for label, sure in ((1, p), (0, 1 - p)):
                new = np.flatnonzero(pool & (other < 0) & (sure >= CONFIDENT))
                new = new[np.argsort(-sure[new], kind="stable")[:PER_ROUND]]
                other[new] = label
                told[i] += len(new)
        exchanged.append(tuple(told))
        if not sum(told):
            break
    h = of(CALIBRATED)
    for v, d in zip(views, designs, strict=True):
        z = d[h] @ v.w
        a, b = fit_logistic(np.stack([z, np.ones(len(z))], 1), y[h], 1e-3)
        v.scale = (float(a), float(b))
    logits = lambda i: np.stack([views[0].logit(designs[0][i]), views[1].logit(designs[1][i]), np.ones(len(i))], 1)
    mix = fit_logistic(logits(h), y[h], 1.0)
    i = of(CUT)
    good = np.sort(sigmoid(logits(i) @ mix)[y[i] == 1])
    cut = min(float(good[int((1 - keep) * len(good))]), 0.5)
    last = of(REPORTED)
    p, yl = sigmoid(logits(last) @ mix), y[last]
    share = lambda hit: float(hit.mean()) if len(hit) else None
    report = {"exchanged": exchanged, "held_out": len(last), "accuracy": share((p >= cut) == (yl == 1)), "kept_good": share(p[yl == 1] >= cut), "rejected_bad": share(p[yl == 0] < cut), "cut": cut}
    return Model(*views, mix, cut, weights, report)


def _views(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    meta = [batch.column(c).to_pylist() for c in ("n_chars", "source", "lang")]
    xa = np.array([content(t) for t in texts], np.float64).reshape(-1, N_CONTENT)
    xb = np.array([stated_length(n) for n in meta[0]], np.float64).reshape(-1, 1)
    return texts, xa, xb, np.array([hashed(s, g) for s, g in zip(*meta[1:], strict=True)], np.int64).reshape(-1, 3)


def _sample(batches):
    for batch in batches:
        texts, xa, xb, names = _views(batch)
        found = pa.array([buckets(t) for t in texts], pa.list_(pa.int16()))
        arrays = [batch.column("y"), batch.column("part"), *(pa.array(list(x.astype(t)), pa.list_(k)) for x, t, k in ((xa, np.float32, pa.float32()), (xb, np.float32, pa.float32()), (names, np.int32, pa.int32()))), found]
        yield pa.RecordBatch.from_arrays(arrays, ["y", "part", "xa", "xb", "names", "found"])


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _unit(salt: int):
    """A number in [0, 1) from a row's doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """None if the labels do not hold both classes."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n_known, n_docs = known.count(), docs.count()
    some = known.where(_unit(1) < labelled / max(1, n_known))
    rows = _inputs(docs).where((_unit(1) < labelled / max(1, n_known)) | (_unit(2) < pool / max(1, n_docs)))
    rows = rows.join(F.broadcast(some), "doc_id", "left")  # about `labelled` rows of two numbers
    rows = rows.where(F.col("y").isNotNull() | (_unit(2) < pool / max(1, n_docs)))
    u, part, edge = _unit(3), F.lit(len(PARTS) - 1), 1.0
    for p in range(len(PARTS) - 1, 0, -1):
        edge -= PARTS[p]
        part = F.when(u < edge, F.lit(p - 1)).otherwise(part)
    rows = rows.select("doc_id", "text", "source", "lang", "n_chars", F.coalesce("y", F.lit(-1)).alias("y"), part.alias("part"))
    got = rows.mapInArrow(_sample, "y int, part int, xa array<float>, xb array<float>, names array<int>, found array<smallint>").toArrow()
    got = got.combine_chunks()
    if not got.num_rows:
        return None
    y, part = got.column("y").to_numpy(), got.column("part").to_numpy()
    if not all({0, 1} <= set(y[part == p].tolist()) for p in range(REPORTED)):
        return None
    xa, xb, names = (got.column(c).combine_chunks().flatten().to_numpy().reshape(len(y), -1) for c in ("xa", "xb", "names"))
    lists = got.column("found").combine_chunks()
    found = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets.to_numpy()[0])
    order = np.lexsort((*xa.T[:4], *xb.T, y, part))  # the same model whatever order the rows came in
    return co_train([found[i] for i in order], *(v[order] for v in (xa.astype(np.float64), xb.astype(np.float64), names, y, part)))


def _score(model: Model | None, extra: list[str], batches):
    for batch in batches:
        n = batch.num_rows
        if model is None:
            p = a = b = np.ones(n)
            keep = np.ones(n, bool)
        else:
            texts, xa, xb, names = _views(batch)
            told = np.array([by_words(np.array(buckets(t), np.int64), model.weights) for t in texts]).reshape(-1, 2)
            xa = np.concatenate([xa.astype(np.float32).astype(np.float64), told], axis=1)
            p, a, b = model.scores(xa, xb.astype(np.float32).astype(np.float64), names)
            keep = p >= model.cut
        cols = [batch.column(c) for c in extra]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.float64()) for x in (p, a, b)), pa.array(keep)], [*extra, "score", "text_score", "meta_score", "kept"])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, score, text_score, meta_score and kept for every document."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _inputs(docs).mapInArrow(partial(_score, model, ["doc_id"]), f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, whole and with the columns of documents, in one pass."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    plain = _inputs(docs)
    cols = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    rows = plain.mapInArrow(partial(_score, model, plain.columns), f"{cols}, score double, text_score double, meta_score double, kept boolean")
    return rows.where("kept").select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c in plain.columns])


def op9_cotraining(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
