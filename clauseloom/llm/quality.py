"""Quality classifier by co-training two views of a document.

The text view holds measures of the text and the words it uses, the metadata view the language and the source. Words give
one score: log odds of their presence under the two classes (naive Bayes over hashed words), each half of the documents scored by
the counts of the other half. Each view is a logistic regression. Over some rounds each view labels the unlabelled documents
that it is most sure of, among all of them, and they join the other's training set. Scores are calibrated on held-out
labels, the views are combined by what they add there, and every document is scored whole.

Nothing is sampled: all labelled and unlabelled documents take part. Features are made once, in about a sixth of the
text's space, and kept in the shared folder; quantiles, word counts, gradients and calibrations are sums over them, added up in
a tree of tasks in fixed-point numbers, so that their order has no influence. What the driver holds does not grow with the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, lean, materialize, mix, prefix_sums, range_hash, shingle_sets, slices, text_bytes, word_spans

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"%&$*#", b"|", b".,;:?", b"<>{}[]()/\\=_~^", bytes(range(128, 256)), b"\n", b"\t "]
_CLASS_OF = np.zeros(256, np.int64)
for _i, _c in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_c)] = _i
N_TEXT = len(_CLASSES) + 8
#: Places for hashed words, languages, sources and pairs of both.
WORDS, _LANGS, _SOURCES = 2048, 16, 64
#: Bins of a measure, and the resolution of histograms.
BINS, LEVELS = 10, 1024
_D_TEXT, _D_META = 1 + N_TEXT * BINS + 2, 1 + _LANGS + 2 * _SOURCES


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, N_TEXT) measures and (rows, WORDS / 8) bytes with a bit for each hashed word; a null or empty text has zeros."""
    data, off = text_bytes(texts)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    row = np.repeat(np.arange(n), np.diff(off))
    width = len(_CLASSES) + 1
    counts = np.bincount(row * width + _CLASS_OF[data], minlength=n * width).reshape(n, width)[:, 1:]
    out, bits = np.zeros((n, N_TEXT), np.float32), np.zeros((n, WORDS), bool)
    out[:, : len(_CLASSES)] = counts / size[:, None]
    if len(data):
        start, end, word_row = word_spans(data, off)
        words = np.bincount(word_row, minlength=n)
        safe = np.maximum(words, 1)
        h = range_hash(prefix_sums(data), start, end)
        bits[word_row, (h % np.uint64(WORDS)).astype(np.int64)] = True
        again = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
        order = np.lexsort((h, word_row))
        hs, rs = h[order], word_row[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(hs)))
        top = np.zeros(n)
        np.maximum.at(top, rs[at], runs)
        grams = np.diff(shingle_sets(texts, 3)[1])
        base = len(_CLASSES)
        out[:, base] = np.log1p(words)
        out[:, base + 1] = np.bincount(word_row, end - start, n) / safe
        out[:, base + 2] = np.bincount(rs[at], minlength=n) / safe
        out[:, base + 3] = np.bincount(word_row[1:][again], minlength=n) / safe
        out[:, base + 4] = top / safe
        out[:, base + 5] = grams / np.maximum(words - 2, 1)
        last = data[end - 1] if len(end) else data[:0]
        out[:, base + 6] = np.bincount(word_row, np.isin(_CLASS_OF[last], (3, 4, 5)), n) / safe
        out[:, base + 7] = np.bincount(word_row, _CLASS_OF[data[start]] == 1, n) / safe
    return out, np.packbits(bits, axis=1)


def meta_features(lang, source) -> np.ndarray:
    """(rows, 3) places of the language, the source and both in the metadata view; nulls have places of their own."""
    place = lambda v, size: 0 if v is None else zlib.crc32(v.encode()) % (size - 1) + 1
    both = [(place(x, _LANGS), place(y, _SOURCES), zlib.crc32(f"{x}|{y}".encode()) % _SOURCES) for x, y in zip(lang, source, strict=True)]
    return np.array(both, np.int64).reshape(-1, 3) + [1, 1 + _LANGS, 1 + _LANGS + _SOURCES]


def levels(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 as levels of about 3 %, 0 to LEVELS - 1, by the leading bits of their floats."""
    return np.clip((np.ascontiguousarray(x, np.float32).view(np.int32) >> 18) - (113 << 5), 0, LEVELS - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Some documents' features: measures, word bits, metadata places, label (-1 without one); fold and half follow from the text."""

    def __init__(self, x: np.ndarray, bits: np.ndarray, meta: np.ndarray, y: np.ndarray | None = None):
        self.x, self.bits, self.meta, self.y = x, bits, meta, y
        h = mix(bits.view(np.uint64) + np.arange(1, WORDS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64) if len(x) else np.zeros(0, np.uint64)
        # Documents with the same words are on one side of every split.
        self.half, self.held = (h >> np.uint64(7)).astype(np.int64) & 1, h % np.uint64(5) == 4

    def parts(self, size: int = 1024) -> Iterator[Rows]:
        """The same rows, some at a time, as their word bits take much space when they are unpacked."""
        for at in range(0, len(self.x), size):
            own = slice(at, at + size)
            yield Rows(self.x[own], self.bits[own], self.meta[own], None if self.y is None else self.y[own])


class CoTrained:
    """Two views, their calibrations, weights and the threshold."""

    def __init__(self):
        self.cuts = [np.zeros(0)] * N_TEXT
        self.odds = np.zeros((2, WORDS), np.float32)
        self.w = [np.zeros(_D_TEXT), np.zeros(_D_META)]
        #: For each view the logits at or below and at or above which it is sure of a class.
        self.sure = [(-np.inf, np.inf)] * 2
        self.scales, self.weights, self.threshold = [(1.0, 0.0)] * 2, np.array([1.0, 0.0]), 0.5
        self.pseudo_weight, self.report = 0.0, {}

    def design(self, r: Rows) -> list[np.ndarray]:
        """A row of ones and zeros, and the word score, for each document; one matrix a view."""
        n = len(r.x)
        text, meta = np.zeros((n, _D_TEXT)), np.zeros((n, _D_META))
        text[:, 0] = meta[:, 0] = 1
        lv = levels(r.x)
        for j, cut in enumerate(self.cuts):
            text[np.arange(n), 1 + j * BINS + np.searchsorted(cut, lv[:, j], "right")] = 1
        word = self.word_score(r)
        text[:, -2], text[:, -1] = word, np.maximum(word, 0)
        meta[np.arange(n)[:, None], r.meta] = 1
        return [text, meta]

    def word_score(self, r: Rows) -> np.ndarray:
        bits = np.unpackbits(r.bits, axis=1).astype(np.float32)
        got = (bits @ self.odds.T)[np.arange(len(r.x)), 1 - r.half] if len(r.x) else np.zeros(0)
        return np.clip(got / np.sqrt(np.maximum(bits.sum(axis=1), 1)), -6, 6)

    def logits(self, r: Rows) -> list[np.ndarray]:
        return [z @ w for z, w in zip(self.design(r), self.w, strict=True)]

    def targets(self, r: Rows, logits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(label, weight) of each row for each view: own labels, and the other view's where it is sure."""
        out = []
        for other in (1, 0):
            low, high = self.sure[other]
            s = logits[other]
            pseudo = (r.y < 0) & ((s <= low) | (s >= high))
            label = np.where(r.y >= 0, r.y == 1, s >= high).astype(float)
            out.append((label, np.where((r.y >= 0) & ~r.held, 1.0, np.where(pseudo, self.pseudo_weight, 0.0))))
        return out

    def combine(self, logits) -> np.ndarray:
        return _sigmoid(sum(w * (a * s + b) for w, s, (a, b) in zip(self.weights, logits, self.scales, strict=True)))

    def scores(self, r: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [np.concatenate(c) for c in zip(*(self.logits(p) for p in r.parts()), strict=True)] or [np.zeros(0)] * 2
        return self.combine(logits), *(_sigmoid(a * s + b) for s, (a, b) in zip(logits, self.scales, strict=True))


def _histogram(values: np.ndarray) -> np.ndarray:
    """Counts of logits from -16 to 16 in LEVELS bins."""
    return np.bincount(np.clip((values + 16) * (LEVELS / 32), 0, LEVELS - 1).astype(np.int64), minlength=LEVELS).astype(float)


_CENTERS = (np.arange(LEVELS) + 0.5) * (32 / LEVELS) - 16


def _platt(bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b with sigmoid(a s + b) calibrated on histograms of the classes' logits; smoothed targets."""
    z = np.column_stack((np.ones(LEVELS), _CENTERS))
    w = np.array([0.0, 1.0])
    n = bad + good
    t = bad / (bad.sum() + 2) + good * (good.sum() + 1) / (good.sum() + 2)
    for _ in range(50):
        p = _sigmoid(z @ w)
        hess = (z * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, z.T @ (n * p - t) + 1e-3 * (w - [0, 1]))
    return float(max(w[1], 0.0)), float(w[0])


_STORED = pa.schema([("_cl_x", pa.binary()), ("_cl_bits", pa.binary()), ("_cl_meta", pa.binary())])


def _rows_of(b: pa.RecordBatch) -> Rows:
    """Features that were stored."""
    raw = lambda c, t, width: np.frombuffer(b"".join(b[c].to_pylist()), t).reshape(-1, width)
    return Rows(raw("_cl_x", "<f4", N_TEXT), raw("_cl_bits", np.uint8, WORDS // 8), raw("_cl_meta", "<i2", 3).astype(np.int64), b["_cl_y"].to_numpy().astype(int) if "_cl_y" in b.schema.names else None)


def _make_rows(b: pa.RecordBatch) -> Rows:
    """The features of a batch, made for about a megabyte of text at a time."""
    parts = [text_features(b["_cl_text"].slice(*at)) for at in slices(b["_cl_text"])]
    x, bits = (np.vstack(c) for c in zip(*parts, strict=True)) if parts else (np.zeros((0, N_TEXT), np.float32), np.zeros((0, WORDS // 8), np.uint8))
    return Rows(x, bits, meta_features(b["_cl_lang"].to_pylist(), b["_cl_source"].to_pylist()))


def _with_views(docs: DataFrame) -> DataFrame:
    """docs with the columns that the views read under names of their own; missing ones are null."""
    types = dict(docs.dtypes)
    want = {"_cl_text": "text", "_cl_lang": "lang", "_cl_source": "source"}
    return docs.withColumns({n: F.col(c).cast("string") if c in types else F.lit(None).cast("string") for n, c in want.items()})


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _cl_x, _cl_bits, _cl_meta, _cl_y): a row for each row of docs. A document with several labels has the lowest."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _make_rows(b)
            packed = [[v.tobytes() for v in c] for c in (r.x.astype("<f4"), r.bits, r.meta.astype("<i2"))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, pa.binary()) for c in packed]], ["doc_id", *_STORED.names])

    rows = _with_views(docs).select("doc_id", "_cl_text", "_cl_lang", "_cl_source").mapInArrow(lean(run), f"doc_id {kind}, _cl_x binary, _cl_bits binary, _cl_meta binary")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_cl_doc")).agg(F.min("quality").cast("int").alias("_cl_y"))
    return rows.join(known, F.col("doc_id") == F.col("_cl_doc"), "left").drop("_cl_doc").fillna({"_cl_y": -1})


def _total(rows: DataFrame, tasks: int, size: int, f) -> np.ndarray:
    """The sum of f(Rows), vectors of the given size, over all rows."""
    out = pa.schema([("blob", pa.binary())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for r in _rows_of(b).parts():
                total += f(r)
        yield batch(out, blob=[np.rint(total * 2**20).astype("<i8").tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b["blob"]:
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield batch(out, blob=[total.tobytes()])

    parts = rows.select("_cl_x", "_cl_bits", "_cl_meta", "_cl_y").mapInArrow(lean(own), "blob binary")
    while tasks > 32:
        tasks = -(-tasks // 32)
        parts = parts.repartition(tasks).mapInArrow(lean(add), "blob binary")
    return sum((np.frombuffer(r.blob, "<i8") for r in parts.collect()), np.zeros(size, np.int64)) / 2**20


def fit(rows: DataFrame, rounds: int = 3, share: float = 0.05, keep: float = 0.995) -> CoTrained | None:
    """Fits on stored features. None if no document has a label or all labels are of one class.

    In round r each view gives the share r * share of all unlabelled documents, the ones it is surest of, to the other. keep is
    the share of good held-out documents that the threshold keeps at least; it lies lower by 10 / (their number) in log odds.
    """
    tasks = rows.rdd.getNumPartitions()
    total = lambda size, f: _total(rows, tasks, size, f)
    m = CoTrained()

    def first(r: Rows) -> np.ndarray:
        at = levels(r.x) + np.arange(N_TEXT) * LEVELS
        return np.concatenate((np.bincount(at.ravel(), minlength=N_TEXT * LEVELS), [np.sum(~r.held & (r.y == 0)), np.sum(~r.held & (r.y == 1)), np.sum(r.held & (r.y == 0)), np.sum(r.held & (r.y == 1))]))

    counts = total(N_TEXT * LEVELS + 4, first)
    n_bad, n_good, held_bad, held_good = counts[-4:]
    if not n_bad + held_bad or not n_good + held_good:
        return None
    # Few labels may leave a class out of one of the folds: all of them then serve both ends.
    everywhere = not (n_bad and n_good and held_bad and held_good)
    fold = lambda r: np.zeros(len(r.x), bool) if everywhere else r.held
    if everywhere:
        n_bad, n_good = n_bad + held_bad, n_good + held_good
    up = np.cumsum(counts[:-4].reshape(N_TEXT, LEVELS), axis=1)
    m.cuts = [np.unique(np.searchsorted(c, c[-1] * np.arange(1, BINS) / BINS)) for c in up]
    rate = n_good / (n_good + n_bad)

    def learn(steps: int) -> None:
        def words(r: Rows) -> np.ndarray:
            r.held = fold(r)
            label, weight = m.targets(r, m.logits(r))[0]
            bits = np.unpackbits(r.bits, axis=1).astype(np.float64)
            out = np.zeros((2, 2, WORDS + 1))
            for h in (0, 1):
                for k in (0, 1):
                    v = weight * ((r.half == h) & (label == k))
                    out[h, k, :-1], out[h, k, -1] = v @ bits, v.sum()
            return out.ravel()

        c = total(4 * (WORDS + 1), words).reshape(2, 2, WORDS + 1)
        p = (c[:, :, :-1] + 1) / (c[:, :, -1:] + 2)
        # A word says the more, the more documents it is seen in.
        m.odds = (np.log(p[:, 1] / p[:, 0]) * (c[:, :, -1].min(axis=1) > 0)[:, None]).astype(np.float32)
        for _ in range(steps):
            def slopes(r: Rows) -> np.ndarray:
                r.held = fold(r)
                zs = m.design(r)
                logits = [z @ w for z, w in zip(zs, m.w, strict=True)]
                out = []
                for z, s, (label, weight) in zip(zs, logits, m.targets(r, frozen(r) if frozen else logits), strict=True):
                    p = _sigmoid(s)
                    out += [z.T @ (weight * (p - label)), ((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z).ravel()]
                return np.concatenate(out)

            got, at, moved = total(_D_TEXT * (_D_TEXT + 1) + _D_META * (_D_META + 1), slopes), 0, 0.0
            for k, d in enumerate((_D_TEXT, _D_META)):
                grad, hess, at = got[at : at + d], got[at + d : at + d + d * d].reshape(d, d), at + d + d * d
                reg = np.full(d, 1.0)
                reg[0] = 1e-3
                step = np.linalg.solve(hess + np.diag(reg), grad + reg * m.w[k])
                step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
                m.w[k] = m.w[k] - step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-3:
                break

    frozen = None
    learn(8)
    for turn in range(1, rounds + 1):
        def unsure(r: Rows) -> np.ndarray:
            return np.concatenate([_histogram(s[r.y < 0]) for s in m.logits(r)])

        sure, free = [], 0.0
        for c in total(2 * LEVELS, unsure).reshape(2, LEVELS):
            free, below = c.sum(), np.cumsum(c)
            n = share * turn * free
            low = _CENTERS[np.searchsorted(below, n * (1 - rate))] if n * (1 - rate) <= below[-1] else 0
            high = _CENTERS[min(np.searchsorted(below, free - n * rate), LEVELS - 1)]
            # Only what the view is sure of: under 0.1 or over 0.95.
            sure.append((min(low, -2.2), max(high, 2.94)))
        if not free:
            break
        # The labels that the views gave hold for the round, while the views learn from them.
        old = CoTrained()
        old.cuts, old.odds, old.w = m.cuts, m.odds, list(m.w)
        frozen = old.logits
        m.sure = sure
        m.pseudo_weight = min(0.3, 0.3 * (n_good + n_bad) / max(share * turn * free, 1))
        learn(3)

    def held(r: Rows) -> np.ndarray:
        use = (r.held | everywhere) & (r.y >= 0)
        return np.concatenate([_histogram(s[use & (r.y == k)]) for s in m.logits(r) for k in (0, 1)])

    both = total(4 * LEVELS, held).reshape(2, 2, LEVELS)
    m.scales = [_platt(*c) for c in both]
    # Each calibrated view counts by what it gains over the class shares on the held-out labels.
    bad, good = both[0].sum(axis=1)
    rate = np.clip(good / (good + bad), 1e-3, 1 - 1e-3)

    def loss(p, c) -> float:
        return -(c[1] @ (np.log(p) * np.ones(LEVELS)) + c[0] @ (np.log(1 - p) * np.ones(LEVELS))) / (good + bad)

    gains = np.array([max(1e-3, loss(rate, c) - loss(np.clip(_sigmoid(a * _CENTERS + b), 1e-6, 1 - 1e-6), c)) for c, (a, b) in zip(both, m.scales, strict=True)])
    m.weights = gains / gains.sum()

    def combined(r: Rows) -> np.ndarray:
        use = (r.held | everywhere) & (r.y >= 0)
        p = np.clip(m.combine(m.logits(r)), 1e-7, 1 - 1e-7)
        return np.concatenate([_histogram(np.log(p / (1 - p))[use & (r.y == k)]) for k in (0, 1)])

    bad, good = total(2 * LEVELS, combined).reshape(2, LEVELS)
    at = int(np.searchsorted(np.cumsum(good), (1 - keep) * good.sum(), "right"))
    # The fewer good labels show where good documents end, the lower the threshold lies.
    m.threshold = float(min(0.5, _sigmoid(_CENTERS[min(at, LEVELS - 1)] - 16 / LEVELS - 10 / good.sum())))
    below = _sigmoid(_CENTERS) < m.threshold
    m.report = {"good_kept": 1 - good[below].sum() / max(good.sum(), 1), "bad_rejected": bad[below].sum() / max(bad.sum(), 1), "weights": m.weights.tolist()}
    return m


_SCORES = "score double, text_score double, meta_score double, kept boolean"


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept) for every row of docs.

    A null text counts as empty; missing or null metadata has a place of its own; repeated rows give a row each and
    each counts; extra columns are not read. Without labels of both classes every document is kept, with null scores.
    """
    rows = materialize(features(docs, labels))
    model = fit(rows, **params)
    if model is None:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("score", "text_score", "meta_score")], F.lit(True).alias("kept"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, one, two = model.scores(_rows_of(b))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(both), pa.array(one), pa.array(two), pa.array(both >= model.threshold)], ["doc_id", "score", "text_score", "meta_score", "kept"])

    return rows.mapInArrow(lean(score), f"doc_id {dict(docs.dtypes)['doc_id']}, {_SCORES}")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    model = fit(materialize(features(docs, labels)), **params)
    if model is None:
        return docs

    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(columns).filter(pa.array(model.scores(_make_rows(b))[0] >= model.threshold))

    return _with_views(docs).mapInArrow(lean(keep), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
