"""Quality classifier: a factorisation machine.

Inputs are hashed words, bucketed structure statistics of the text and its length.  The logit is
bias + linear part + all pairwise interactions of low-rank vectors, the latter by the identity
  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so a text is scored in time linear in its distinct words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, remainder, slices

#: Bound of the training sample: labelled rows, chosen by hash.
TRAIN_ROWS = 8_000
WORDS = 1 << 16
BUCKETS = 16
RANK = 8
EPOCHS = 6
BATCH = 128
STEPS = 300
KEEP_AT = 0.7

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_PUNCT = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
_SYMBOL = np.array([ord(c) for c in "#$%&*+<=>@\\^_`|~{}[]"])
STATS = 12
SIZE = WORDS + STATS * BUCKETS


def _level(x: float, scale: float = 1.0) -> int:
    """A share (or a ratio by ``scale``) as one of BUCKETS square-root steps."""
    return min(BUCKETS - 1, int((max(0.0, x) / scale) ** 0.5 * BUCKETS))


def features(text: str | None) -> np.ndarray:
    """Indexes of the active inputs: distinct hashed words, then one bucket of each statistic."""
    raw = (text or "").encode()
    words = raw.lower().split()
    distinct = set(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, lines = max(1, len(raw)), [x for x in raw.split(b"\n") if x]
    letters = max(1, n - int(counts[_PUNCT].sum() + counts[_DIGIT].sum() + counts[32] + counts[10]))
    stats = (
        min(BUCKETS - 1, len(raw).bit_length()),
        _level(counts[_UPPER].sum() / letters),
        _level(counts[_DIGIT].sum() / n),
        _level(counts[_PUNCT].sum() / n),
        _level(counts[_SYMBOL].sum() / n),
        _level(counts[33] / n),
        _level(counts[124] / n),
        _level(len(raw) / max(1, len(words)), 40),
        _level(len(distinct) / max(1, len(words))),
        _level(1 - len(set(lines)) / max(1, len(lines))),
        _level(len(words) / max(1, len(lines)), 400),
        _level((counts[46] + counts[63]) / max(1, len(words))),
    )
    hashed = np.fromiter((zlib.crc32(w) % WORDS for w in distinct), np.int64, len(distinct))
    return np.concatenate([np.unique(hashed), WORDS + np.arange(STATS) * BUCKETS + np.array(stats)])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: never empty arrays, as each has the statistics."""
        i, x, starts = flat(rows)
        vx = self.factors[i] * x[:, None]
        total = np.add.reduceat(vx, starts)
        own = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.linear[i] * x, starts) + 0.5 * (total * total - own).sum(1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits([features(t) for t in texts]), -30, 30))) if texts else np.zeros(0)


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of many rows end to end, their values, and where each row starts.

    Words of a row share a length of one; each statistic weighs 1/2.
    """
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    i = np.concatenate(rows)
    x = np.repeat(1 / np.sqrt(np.maximum(1, lengths - STATS)), lengths)
    x[i >= WORDS] = 0.5
    return i, x, starts


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise logistic loss by AdaGrad over shuffled batches; few rows are gone over more often."""
    epochs = max(epochs, min(60, STEPS * BATCH // len(rows)))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    hw, hv, hb = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
    p = float(np.clip(labels.mean(), 0.01, 0.99))
    b = float(np.log(p / (1 - p)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            ids = order[at : at + BATCH]
            i, x, starts = flat([rows[k] for k in ids])
            lengths = np.diff(np.append(starts, len(i)))
            vx = v[i] * x[:, None]
            total = np.add.reduceat(vx, starts)
            logit = b + np.add.reduceat(w[i] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[ids]) / len(ids)
            gx = np.repeat(g, lengths) * x
            used, back = np.unique(i, return_inverse=True)
            gw, gv = np.bincount(back, gx, len(used)), np.zeros((len(used), RANK))
            each = gx[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            for f in range(RANK):
                gv[:, f] = np.bincount(back, each[:, f], len(used))
            gw += decay * w[used]
            gv += decay * v[used]
            hw[used] += gw * gw
            hv[used] += gv * gv
            hb += g.sum() ** 2
            w[used] -= rate * gw / np.sqrt(hw[used])
            v[used] -= rate * gv / np.sqrt(hv[used])
            b -= rate * g.sum() / hb**0.5
    return Model(b, w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``bound`` labelled rows that aren't held out, chosen by hash.

    Rows with null id or label teach nothing.  Without any, every score is 0.5.
    """
    h = F.xxhash64(F.col("i"))
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").where(remainder("i", 4) != 2)
    few = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(h, "i").limit(bound)  # a proven bound: fit to broadcast
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(few), "i").withColumn("h", F.xxhash64("i", "t"))

    def make():
        return lambda c: {"h": c[0], "y": c[1], "x": [features(t).tolist() for t in c[2]]}

    got = arrow_rows(rows, make, "h long, y int, x array<int>", "h", "y", "t").orderBy("h").limit(bound).collect()
    if not got:
        return Model(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    return train([np.array(r["x"], np.int64) for r in got], np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row.  Only the text is looked at.

    Null text counts as empty, which has a score too.  Texts are read whole, however long; rows with one id, or
    one text, get a row each, equal texts equal scores; other columns aren't read and may have any name; an
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, about 2 MB

    def make():
        m = shared.value
        return lambda c: {id_col: c[0], "score": m.scores(c[1]).astype(float).tolist()}

    return arrow_rows(docs, make, f"`{id_col}` {kind}, score double", id_col, text_col)


def keep(docs: DataFrame, model: Model, at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows that score ``at`` or more, all columns as they are."""
    col = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for s in slices(b, col):
                yield s.filter(pa.array(shared.value.scores(s.column(col).to_pylist()) >= at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
