"""Toxicity by a subsequence string-kernel SVM on Nyström landmarks.

What is scored is a text's windows: its words, cut to overlapping stretches where they are long, and its runs of very short words, as letters
spelled apart make them. The kernel of two windows sums, over the three-symbol subsequences they share, the product of their
weights, each a decay to the power of the span. Letters, digits and the two ends are symbols; anything else only widens a span. So
``i.d.i.o.t``, ``i d i o t``, ``idxiot`` and new endings of a known stem stay close to what was learned. A text is as toxic as its most
toxic window.

Labels are of whole texts, so which window of a toxic text is to blame is learned too: the first guess is the difference of the
classes' mean embeddings; then, round by round, the SVM learns the windows that the model before ranks highest, those of toxic texts
against those of clean ones.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, small_batches, table, written

#: The bound of training: labelled texts, those whose ids hash lowest. All their windows count.
MAX_LABELLED = 20_000
#: Landmarks, rounds of choosing windows and learning, the most windows that a toxic text is blamed for in a round, tasks over the sample.
LANDMARKS, ROUNDS, BLAMED, TASKS = 512, 3, 6, 16
DECAY, REACH, SYMBOLS, LONGEST = 0.85, 6, 64, 40
REMEMBERED = 300_000
#: Texts without a window have this margin.
NO_WINDOW = -2.0

_short = re.compile(rb"[\x01\x02]{4,}")
_ends = re.compile(r"^[\W_]+|[\W_]+$")


def windows(text: str) -> set[str]:
    """The distinct windows of a text, lower-cased: words without the marks at their ends, and runs of four or more words of at most two letters."""
    words = text.lower().split()
    found = set(words)
    odd = {w for w in found if not w.isalpha()}
    found -= odd
    found.update(_ends.sub("", w) for w in odd)
    found.discard("")
    # lengths as bytes, up to three, so that a pattern finds the runs
    found.update(" ".join(words[m.start() : m.end()]) for m in _short.finditer(bytes(map(min, map(len, words), repeat(3)))))
    for w in [w for w in found if len(w) > LONGEST]:
        found.discard(w)
        found.update(w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return found


def _codes() -> np.ndarray:
    """Symbol of each code point: the start and end marks are 1 and 2, a-z and 0-9 have their own, other letters and digits share; the rest has none."""
    out = np.array([39 + c % (SYMBOLS - 39) if chr(c).isalnum() else 0 for c in range(0x110000)], np.int32)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        out[ord(c)] = 3 + i
    return out


_symbol: np.ndarray | None = None
_pairs = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]
#: Weights by span: the last three bits of a key are the span beyond three symbols.
_decay = np.array([DECAY ** (b + 1) for b in range(2, 10)], np.float32)


def _keys(words: list[str]) -> np.ndarray:
    """For each word its subsequences as sorted numbers of 32 bits, the feature before the span; those that aren't all symbols are 0."""
    global _symbol
    if _symbol is None:
        _symbol = _codes()
    width = max(map(len, words)) + 2
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), width + REACH), np.int32)
    inside = np.arange(width + REACH) - 1
    codes[(inside >= 0) & (inside < lengths[:, None])] = _symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes[:, 0] = 1
    codes[np.arange(len(words)), lengths + 1] = 2
    there = codes > 0
    out = np.zeros((len(words), len(_pairs), width), np.int32)
    for k, (a, b) in enumerate(_pairs):
        np.multiply(codes[:, :width], SYMBOLS, out=out[:, k])
        out[:, k] += codes[:, a : a + width]
        out[:, k] *= SYMBOLS
        out[:, k] += codes[:, b : b + width]
        out[:, k] <<= 3
        out[:, k] |= b - 2
        out[:, k] *= there[:, :width] & there[:, a : a + width] & there[:, b : b + width]
    out = out.reshape(len(words), -1)
    out.sort(axis=1)
    return out


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, where another feature begins, sums of the weights of each): equal subsequences of a word add up."""
    ids = keys >> 3
    values = _decay[keys & 7]
    values[ids == 0] = 0
    first = np.ones(ids.shape, bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=first[:, 1:])
    starts = np.flatnonzero(first)
    return ids, values, starts, np.add.reduceat(values.ravel(), starts)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): for each word its distinct subsequences as numbers (0: none) and their summed decay weights, scaled to length 1."""
    ids, _, starts, sums = _parts(_keys(words))
    total = np.zeros(ids.size, np.float32)
    total[starts] = sums
    total = total.reshape(ids.shape)
    norm = np.sqrt((total**2).sum(1, keepdims=True))
    return np.where(total > 0, ids, 0), total / np.where(norm > 0, norm, 1)


def _weighted(words: list[str], weights: np.ndarray, size: int = 256) -> np.ndarray:
    """The value of each word under feature weights: those of one length class go together."""
    out = np.zeros(len(words), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), size):
        some = order[at : at + size]
        ids, values, starts, sums = _parts(_keys([words[i] for i in some]))
        norm = np.sqrt(np.bincount(starts // ids.shape[1], sums * sums, minlength=len(some)))
        out[some] = np.einsum("ij,ij->i", weights[ids], values) / np.where(norm > 0, norm, 1)
    return out


def kernel(words: list[str], landmarks: list[str], size: int = 1024) -> np.ndarray:
    """The normalised subsequence kernel of each word with each landmark."""
    ids, values = _features(landmarks)
    used = np.unique(ids[ids > 0])
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j in range(len(landmarks)):
        table[np.searchsorted(used, ids[j][ids[j] > 0]), j] = values[j][ids[j] > 0]
    place = np.full(SYMBOLS**3, len(used), np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), size):
        own, weight = _features(words[at : at + size])
        spots = place[own]
        for i in range(len(own)):
            hit = spots[i] < len(used)
            out[at + i] = weight[i][hit] @ table[spots[i][hit]]
    return out


@dataclass
class Model:
    """An SVM over windows: landmarks and their weights, an offset, and the logistic curve of the margin of a text."""

    landmarks: list[str]
    alpha: np.ndarray
    offset: float
    slope: float = 4.0
    shift: float = 0.0

    def feature_weights(self) -> np.ndarray:
        """The weights on subsequences that the landmarks' expansion comes to; exact, and no longer than the symbols allow."""
        out = np.zeros(SYMBOLS**3, np.float32)
        if self.landmarks:
            ids, values = _features(self.landmarks)
            np.add.at(out, ids.ravel(), (values * self.alpha[:, None]).ravel())
        out[0] = 0
        return out


#: Rows of the fit that are looked at together.
FIT_ROWS = 4_096


def fit_svm(words: list[str], labels: np.ndarray, weights: np.ndarray, landmarks: list[str], cost: float = 20.0, rounds: int = 25) -> Model:
    """Squared-hinge SVM on the Nyström map of the landmarks, by Newton steps."""
    k = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    good = value > 1e-4
    root = vector[:, good] / np.sqrt(value[good])
    # kept in single precision and taken up in blocks, so that the driver never holds it twice
    x = np.ones((len(words), root.shape[1] + 1), np.float32)
    parts = [slice(a, a + FIT_ROWS) for a in range(0, len(words), FIT_ROWS)]
    for part in parts:
        x[part, :-1] = kernel(words[part], landmarks).astype(np.float64) @ root
    y = np.where(labels > 0, 1.0, -1.0)
    c = cost * weights
    w = np.zeros(x.shape[1])
    penalty = np.ones(len(w))
    penalty[-1] = 1e-6

    def missing(v: np.ndarray) -> np.ndarray:
        """By how much the rows fall short of a margin of 1."""
        return np.concatenate([np.maximum(0, 1 - y[part] * (x[part].astype(np.float64) @ v)) for part in parts])

    def loss(v: np.ndarray) -> float:
        return 0.5 * (penalty * v * v).sum() + 0.5 * (c * missing(v) ** 2).sum()

    for _ in range(rounds):
        on = missing(w) > 0
        square, right = np.diag(penalty), np.zeros(len(w))
        for part in parts:
            some = x[part][on[part]].astype(np.float64)
            square = square + (some * c[part][on[part]][:, None]).T @ some
            right += some.T @ (c[part] * y[part])[on[part]]
        step = np.linalg.solve(square, right) - w
        scale, before = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > before:
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    return Model(landmarks, (root @ w[:-1]).astype(np.float32), float(w[-1]))


def _fitted(spark: SparkSession, words: list[str], labels: np.ndarray, weights: np.ndarray, landmarks: list[str]) -> Model:
    """fit_svm() in a task: what it holds, bounded by the sample, goes with the task and never was the driver's."""
    sent = spark.sparkContext.broadcast((words, labels, weights, landmarks))

    def run(batches):
        for _ in batches:
            model = fit_svm(*sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([model.alpha.tobytes()], pa.binary()), pa.array([model.offset], pa.float64())], names=["alpha", "offset"])

    row = spark.range(1, numPartitions=1).mapInArrow(run, "alpha binary, offset double").first()
    sent.unpersist()
    return Model(landmarks, np.frombuffer(bytes(row["alpha"]), np.float32), row["offset"])


def _embedded(sample: DataFrame) -> np.ndarray:
    """[class, feature]: the mean over the texts of each class of the sum of their distinct windows' maps."""

    def run(batches):
        total, seen = np.zeros((2, SYMBOLS**3), np.float64), [0, 0]
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("t").to_pylist(), strict=True):
                seen[toxic] += 1
                for w in windows(text or ""):
                    counts.setdefault(w, [0, 0])[toxic] += 1
            words = sorted(counts, key=len)
            for at in range(0, len(words), 1024):
                ids, values = _features(words[at : at + 1024])
                share = np.array([counts[w] for w in words[at : at + 1024]], np.float64)
                for k in (0, 1):
                    some = share[:, k] > 0
                    total[k] += np.bincount(ids[some].ravel(), (values[some] * share[some, k][:, None]).ravel(), minlength=SYMBOLS**3)
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.list_(pa.int64())), "total": pa.array([total.tobytes()], pa.binary())})

    parts = sample.coalesce(TASKS).mapInArrow(run, "seen array<long>, total binary").collect()  # TASKS rows at most
    seen = np.sum([r["seen"] for r in parts], axis=0)
    out = np.sum([np.frombuffer(bytes(r["total"])).reshape(2, -1) for r in parts], axis=0) / np.maximum(1, seen)[:, None]
    out[:, 0] = 0
    return out


def _witness(means: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Feature weights of the first guess: how far the toxic mean is above the clean one, in its own chance deviations, where that is more than three."""
    pool = (means[1] * toxic + means[0] * clean) / (toxic + clean)
    above = (means[1] - means[0]) / np.sqrt(pool / toxic + 1e-4 / toxic)
    return np.where(above > 3, above, 0).astype(np.float32)


def _ranked(sample: DataFrame, weights: np.ndarray, offset: float, first: bool) -> DataFrame:
    """(toxic, token, n): of each toxic text the highest window and others above the margin, of each clean one the two highest and one that a hash names."""
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            out: list[list] = [[], []]
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("t").to_pylist(), strict=True):
                own = windows(text or "")
                new = list(own.difference(known))
                known.update(zip(new, (_weighted(new, sent.value) + offset).tolist(), strict=True))
                best = sorted(own, key=lambda w: (-known[w], w))
                if toxic:
                    least = 0.6 * known[best[0]] if first and best else 0.0
                    picked = best[:1] + [w for w in best[1:BLAMED] if known[w] > least]
                else:
                    picked = best[:2] + sorted(own, key=lambda w: (zlib.crc32(w.encode()), w))[:1]
                out[0] += [toxic] * len(picked)
                out[1] += picked
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string())], names=["toxic", "token"])

    return sample.mapInArrow(run, "toxic int, token string").groupBy("toxic", "token").agg(F.count("*").alias("n"))


def _chosen(counts: dict[str, int], most: int) -> list[str]:
    """``most`` landmarks: half those that most texts have, half those that hash lowest."""
    often = sorted(counts, key=lambda w: (-counts[w], w))[: most // 2]
    return often + sorted(set(counts).difference(often), key=lambda w: (zlib.crc32(w.encode()), w))[: most - len(often)]


def _cut(y: np.ndarray, x: np.ndarray) -> float:
    """The margin that parts the classes. Where 98 % of the toxic texts lie above 99.9 % of the clean ones it is between these edges, a sixth above
    the clean one: what is inserted into an insult lowers its margin and never raises it. Else it is where errors, weighed by the size of their class, are least."""
    clean, toxic = np.quantile(x[y == 0], 0.999), np.quantile(x[y > 0], 0.02)
    if clean < toxic:
        return float(clean + (toxic - clean) / 6)
    points = np.unique(x)
    error = np.searchsorted(np.sort(x[y > 0]), points, "left") / (y > 0).sum() + 1 - np.searchsorted(np.sort(x[y == 0]), points, "left") / (y == 0).sum()
    best = int(error.argmin())
    return float((points[best] + points[max(0, best - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Learn from ``labels`` (key, label 0/1; other values and null are left out) of ``docs``.

    At most ``most`` labelled documents are used, those whose keys hash lowest. Equal texts count once, and as toxic if one of them is;
    keys that several labels or rows have likewise. What reaches the driver is bounded by that sample: the classes' mean embeddings,
    the highest windows of each text and its margin. Without texts of both classes the model is the share of toxic ones.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("toxicity"), "__key"), "__key").limit(most)  # so many small rows at most: a broadcast of proven size
    sample = docs.select(F.col(key).alias("__key"), F.col(text).alias("t")).join(F.broadcast(chosen), "__key")
    sample = written(sample.groupBy("t").agg(F.max("toxic").alias("toxic")).repartition(TASKS), "labelled")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model([], np.zeros(0, np.float32), -1.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weights, model = _witness(_embedded(sample), n[1], n[0]), Model([], np.zeros(0, np.float32), 0.0)
    clean: dict[str, int] = {}
    for k in range(ROUNDS):
        blamed: dict[str, int] = {}
        found = _ranked(sample, weights, model.offset, k == 0).toArrow()
        for toxic, token, n_texts in zip(*(found.column(c).to_pylist() for c in ("toxic", "token", "n")), strict=True):
            into = blamed if toxic else clean
            into[token] = into.get(token, 0) + n_texts
        words, negatives = sorted(blamed), sorted(clean)
        if not words or not negatives:
            break
        landmarks = list(dict.fromkeys(_chosen(blamed, LANDMARKS * 3 // 4) + _chosen(clean, LANDMARKS // 4)))
        counts = np.array([min(blamed[w], 20) for w in words] + [min(clean[w], 20) for w in negatives], float)
        model = _fitted(sample.sparkSession, words + negatives, np.array([1] * len(words) + [0] * len(negatives)), counts, landmarks)
        weights = model.feature_weights()
    points = margins_of(sample.select("toxic", F.col("t").alias("text")), model, "toxic int", "text").select("toxic", "margin").toArrow()
    y, x = points.column("toxic").to_numpy().astype(float), points.column("margin").to_numpy().astype(float)
    cut = _cut(y, x)
    return Model(model.landmarks, model.alpha, model.offset, slope := _slope(y, x - cut), -slope * cut)


def _slope(y: np.ndarray, x: np.ndarray) -> float:
    """The steepness of the logistic curve through 0 that fits best, between 1 and 12."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = [(a, float((np.logaddexp(0, a * x) - goal * a * x).sum())) for a in np.linspace(1, 12, 45)]
    return float(min(loss, key=lambda z: z[1])[0])


_scores: dict = {}


def _margins(model: Model, weights: list[np.ndarray], texts: list[str | None]) -> list[float]:
    """The largest margin of each text's windows; in a worker, which remembers those of windows."""
    claim("toxicity", _scores.clear)
    name = (tuple(model.landmarks), model.alpha.tobytes(), model.offset)
    known = _scores.get(name)
    if known is None:
        _scores.clear()
        known = _scores[name] = {}
    if not weights:
        weights.append(model.feature_weights())
    top: list[float] = []
    for at in range(0, len(texts), 128):
        bags = [windows(t or "") for t in texts[at : at + 128]]
        new = set().union(*bags).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*bags)
        some = list(new)
        known.update(zip(some, (_weighted(some, weights[0]) + model.offset).tolist(), strict=True))
        top += [max(map(known.__getitem__, bag), default=NO_WINDOW) for bag in bags]
    return top


def margins_of(docs: DataFrame, model: Model, kept: str, text: str) -> DataFrame:
    """The ``kept`` columns (a DDL list) and margin, from these and ``text`` behind them; one narrow map."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in kept.split(", ")]
    weights: list = []

    def run(batches):
        for batch in batches:
            top = _margins(model, weights, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(top, pa.float64())], names=[*names, "margin"])

    return docs.mapInArrow(run, f"{kept}, margin double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, as they are. Null and empty texts have no window and stay."""
    small_batches(docs.sparkSession)
    at, weights = docs.columns.index(text), []

    def run(batches):
        for batch in batches:
            top = _margins(model, weights, batch.column(at).to_pylist())
            yield batch.filter(pa.array([m * model.slope + model.shift < 0 for m in top], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row; score 0 to 1.

    A null text is an empty one, which has no window and the score of a margin of -2. A very long text has the score of its worst window, all of them looked at. Rows are independent: repeated
    ones give equal results, a null key stays null, an empty table gives an empty table, other columns are left behind.
    """
    margin = margins_of(docs.select(key, text), model, f"{key} {dict(docs.dtypes)[key]}", text)
    score = 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift)))
    return margin.select(key, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def held_out(key: str = "doc_id"):
    """Whether a row is held out; one without a key has no label to learn and isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, a row for a row; nulls, empty and repeated rows as scored() and held_out() say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First stage of the pipeline: documents that are predicted toxic go. The model learns from ``documents`` and its labels.

    Rows that stay are as they were, with all columns; null and empty texts stay, a very long text goes by its worst window, rows equal in text fare alike, null ids too."""
    model = train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))
    return without_toxic(docs, model)
