"""Quality classifier by co-training of two views.

The text view has a page's content: hashed byte trigrams, as square roots of their shares, and the shares of letters,
capitals, digits, white space and marks. The metadata view has what describes the page without its characters:
language, source, both together, length, and layout (lines, their mean length, how many repeat). Each is a ridge-penalized logistic regression. In every round each scores all
documents without a label, and its most confident ones of either class become training rows of the other; a lesson
by which a view's calibrated loss on held-out labels grows is taken back, so rounds can't teach a view what the other has wrong. At
the end both views are calibrated on held-out labels and combined by a logistic regression of their calibrated logits.

All features, and all scores, are of whole texts of all documents. What is bounded is what is fitted: about
``LABELLED`` labelled documents, drawn by hash, and about ``CONFIDENT`` pseudo-labels for each view, class and round;
only these rows go to the driver.

Defined cases: a null text is empty; a document with several labels has their mean, 0.5 counts as good; labels
without a document or without a value don't count; without both classes among the labels every score is the share
of good ones (0.5 without any); repeated rows are scored each; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, tidy, utf8, written

BINS, META_BINS = 256, 32
LABELLED, CONFIDENT, ROUNDS, HELD = 20_000, 300, 3, 0.25
#: A pseudo-label's least probability.
SURE = 0.9
PIECE = 1 << 20

FEATURES = "content binary, meta binary"
#: Numbers beside the bins: of the text view the shares of kinds of bytes, of the other length and layout.
SHARES, LENGTHS = 5, 4


def _meta(lang: str | None, source: str | None, size: int, lines: int, repeated: float) -> np.ndarray:
    out = np.zeros(LENGTHS + META_BINS, np.float32)
    out[:LENGTHS] = np.log1p(size) / 5, np.log1p(lines), np.log1p(size / max(lines, 1)) / 5, repeated
    for name in (f"lang={lang}", f"source={source}", f"lang={lang} source={source}"):
        out[LENGTHS + xxhash.xxh32_intdigest(name) % META_BINS] += 1
    return out


#: Kinds of bytes: 0 other, 1 small letter or part of one beyond ASCII, 2 capital, 3 digit, 4 white space, 5 mark.
_KIND = np.array([1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\r\v\f" else 5 if c > 32 else 0 for c in range(256)], np.int64)


def _views(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts: trigram shares, and shares of the kinds of bytes."""
    n = len(ends) - 1
    content, kinds = np.zeros((n, BINS)), np.zeros((n, 6))
    owner = np.repeat(np.arange(n), np.diff(ends))
    for at in range(0, len(data), PIECE):
        part, own = data[at : at + PIECE + 2].astype(np.uint32), owner[at : at + PIECE + 2]
        if len(part) > 2:
            code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761) >> np.uint32(32 - int(np.log2(BINS)))
            whole = own[:-2] == own[2:]
            content += np.bincount(own[:-2][whole] * BINS + code[whole], minlength=n * BINS).reshape(n, BINS)
        own, part = own[:PIECE], part[:PIECE]
        kinds += np.bincount(own * 6 + _KIND[part], minlength=n * 6).reshape(n, 6)
    size = np.maximum(np.diff(ends), 1)[:, None]
    return np.sqrt(content / size), kinds / size


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the two views of each document, as bytes of half and single precision numbers."""
    rows = docs.select(F.col(key).try_cast("long").alias("doc"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                data, ends = utf8(piece.column("text"))
                content, kinds = _views(data, ends)
                lines, repeated = [], []
                for text in piece.column("text").to_pylist():
                    own = [x for x in (text or "").split("\n") if x.strip()]
                    lines.append(len(own))
                    repeated.append(1 - len(set(own)) / len(own) if own else 0.0)
                content = np.column_stack([content, kinds[:, 1:]])
                about = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), np.diff(ends).tolist(), lines, repeated, strict=True)
                meta = [_meta(*x).tobytes() for x in about]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array([x.tobytes() for x in content.astype(np.float16)], pa.binary()), pa.array(meta, pa.binary())], ["doc", "content", "meta"]
                )

    return rows.mapInArrow(tidy(view), f"doc bigint, {FEATURES}")


class Logistic:
    """Ridge-penalized logistic regression by Newton steps, on standardized features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        self.beta = np.zeros(z.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1], -30, 30)


def _matrices(content: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(content), np.float16).reshape(-1, BINS + SHARES).astype(np.float64)
    return a, np.frombuffer(b"".join(meta), np.float32).reshape(-1, LENGTHS + META_BINS).astype(np.float64)


def _scored(rows: DataFrame, models: tuple[Logistic, Logistic]) -> DataFrame:
    """doc, text_logit and meta_logit of each row of features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                views = _matrices(piece.column("content").to_pylist(), piece.column("meta").to_pylist())
                logits = [pa.array(m.logit(x), pa.float64()) for m, x in zip(models, views, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc"), *logits], ["doc", "text_logit", "meta_logit"])

    return rows.mapInArrow(tidy(score), "doc bigint, text_logit double, meta_logit double")


def _share(key: str, salt: int):
    """A number from 0 to 1 by a key's hash."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)


def _fetched(rows: DataFrame, ids: DataFrame, by: list[str]) -> list:
    """The features of a bounded number of ids; of rows of one id the least."""
    return rows.join(F.broadcast(ids), "doc").groupBy("doc", *by).agg(F.min(F.struct("content", "meta")).alias("f")).select("doc", *by, "f.*").orderBy("doc").collect()


def _confident(free: DataFrame, confident: int, salt: int) -> DataFrame:
    """(doc, view, good): about ``confident`` of the surest documents of each view and class.

    The counts of a histogram say from which bin on they number so many; of the last bin a share is drawn by hash.
    So no task and no driver sorts documents.
    """
    sides = free.select("doc", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).alias("logit")) for v, c in enumerate(("text_logit", "meta_logit"))])).alias("s"))
    sure = sides.select("doc", "s.view", (F.col("s.logit") >= 0).cast("int").alias("good"), F.floor(F.abs("s.logit") * 20).cast("int").alias("bin")).filter(F.col("bin") >= int(np.log(SURE / (1 - SURE)) * 20))
    counts = sure.groupBy("view", "good", "bin").agg(F.count("*").alias("n")).collect()
    chosen = F.lit(False)
    for slot in {(r["view"], r["good"]) for r in counts}:
        left, part = confident, 1.0
        for r in sorted((r for r in counts if (r["view"], r["good"]) == slot), key=lambda r: -r["bin"]):
            last, part = r["bin"], min(1.0, left / r["n"])
            left -= r["n"]
            if left <= 0:
                break
        drawn = (F.col("bin") > last) | ((F.col("bin") == last) & (_share("doc", salt) < part))
        chosen = chosen | ((F.col("view") == slot[0]) & (F.col("good") == slot[1]) & drawn)
    return sure.filter(chosen).select("doc", "view", "good").distinct()


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rounds: int = ROUNDS, labelled: int = LABELLED, confident: int = CONFIDENT) -> DataFrame:
    """key, text_score and meta_score (calibrated), score and good of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(features(docs, key), "features")
    known = labels.groupBy(F.col(key).try_cast("long").alias("doc")).agg(F.avg(F.col(label).cast("double")).alias("y")).filter("y is not null and doc is not null")
    known = written(known, "labels")
    share = min(1.0, labelled / max(1, known.count()))
    sample = _fetched(rows, known.filter(_share("doc", 0) <= share), ["y"])
    y = np.array([float(r["y"] >= 0.5) for r in sample])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        flat = F.lit(share)
        return rows.select(F.col("doc").alias(key), flat.alias("text_score"), flat.alias("meta_score"), flat.alias("score"), F.lit(share >= 0.5).alias("good"))
    views = _matrices([r["content"] for r in sample], [r["meta"] for r in sample])
    held = np.array([xxhash.xxh32_intdigest(str(r["doc"])) / 2**32 < HELD for r in sample])
    if y[held].min(initial=1) == y[held].max(initial=0) or y[~held].min(initial=1) == y[~held].max(initial=0):
        held = np.zeros(len(y), bool)  # too few labels to hold any out
    own = [[v[~held]] for v in views]
    target = [[y[~held]], [y[~held]]]
    weight = [[np.ones(len(y[~held]))], [np.ones(len(y[~held]))]]
    fit = lambda: tuple(Logistic(np.concatenate(own[v]), np.concatenate(target[v]), np.concatenate(weight[v])) for v in (0, 1))
    models = fit()
    line_of = lambda v: Logistic(models[v].logit(views[v][use])[:, None], y[use])
    loss = lambda v: float(np.logaddexp(0, np.where(y[use] > 0, -1, 1) * line_of(v).logit(models[v].logit(views[v][use])[:, None])).mean())
    use = held if held.any() else np.ones(len(y), bool)
    losses = [loss(0), loss(1)]
    taken: list[tuple[int]] = []
    for k in range(rounds):
        logits = _scored(rows, models).join(known.select("doc"), "doc", "left_anti")
        if taken:  # what was taught isn't taught again
            logits = logits.join(F.broadcast(spark.createDataFrame(taken, "doc bigint")), "doc", "left_anti")
        free = written(logits.filter("doc is not null"), "logits")
        found = written(_confident(free, confident, k + 1), "confident")
        new = _fetched(rows, found, ["view", "good"])
        taken += [(d,) for d in {r["doc"] for r in new}]
        for v in (0, 1):
            lesson = [r for r in new if r["view"] != v]
            if lesson:
                own[v].append(_matrices([r["content"] for r in lesson], [r["meta"] for r in lesson])[v])
                target[v].append(np.array([float(r["good"]) for r in lesson]))
                weight[v].append(np.full(len(lesson), 0.5))
        if not new:
            break
        models, before = fit(), models
        for v in (0, 1):
            worse = loss(v) > losses[v]
            if worse and models[v] is not before[v] and len(own[v]) > 1:
                for kept in (own, target, weight):
                    kept[v].pop()
                models = (*models[:v], before[v], *models[v + 1 :])
            losses[v] = loss(v)
    raw = [m.logit(v[use]) for m, v in zip(models, views, strict=True)]
    lines = [Logistic(x[:, None], y[use]) for x in raw]
    both = Logistic(np.column_stack([c.logit(x[:, None]) for c, x in zip(lines, raw, strict=True)]), y[use])
    line = lambda c: (float(c.beta[0] / c.scale[0]), float(c.beta[1] - c.beta[0] * c.mean[0] / c.scale[0]))
    (a0, b0), (a1, b1) = map(line, lines)
    w = both.beta[:-1] / both.scale
    bias = float(both.beta[-1] - (both.beta[:-1] * both.mean / both.scale).sum())
    clip = lambda x: F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))
    text, meta = clip(F.col("text_logit") * a0 + b0), clip(F.col("meta_logit") * a1 + b1)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    out = _scored(rows, models).select(F.col("doc").alias(key), text.alias("t"), meta.alias("m"))
    score = logistic(clip(F.col("t") * float(w[0]) + F.col("m") * float(w[1]) + bias))
    return out.select(key, logistic(F.col("t")).alias("text_score"), logistic(F.col("m")).alias("meta_score"), score.alias("score"), (score >= 0.5).alias("good"))
