"""Training of logistic heads on vectors: Adam, a plateau schedule, validation losses, checkpoints.

A row has a vector and a number (0 to 1) for each class; a head is a logistic model of one class, and the loss is the mean
binary cross-entropy over rows and classes.  Rows lie in `batches` cells by a hash of their id, each a
partition of a stored table, so that a step reads its own batch only; each epoch takes the cells in an order of its own.
A step's gradients are summed in tasks, then position by position.  The driver holds the model
(classes x (positions + 1) numbers and their moments), which doesn't grow with the rows.

After each epoch the whole state is a Parquet table `epoch-<n>` under the path.  A folder counts once Spark has
marked it as complete, so a run that was stopped goes on behind the last complete epoch, with the same weights.

Defined results: rows without a vector or without labels aren't used; a null label is 0; vectors of different
lengths are an error; without rows to validate on, that loss is null, and the last epoch counts as best.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workers import drop, shared_folder, ship, stored

#: Logarithms of the loss are held above this.
LEAST = -100.0
_STATE = "cls int, weights array<double>, mean array<double>, square array<double>, epoch int, step long, lr double, best double, best_epoch int, bad int, train_loss double, val_loss double"


@dataclass(frozen=True)
class Schedule:
    """Adam, and a learning rate that falls by `factor` after more than `patience` epochs whose loss isn't below the best by the share `threshold`."""

    epochs: int = 100
    batches: int = 10
    lr: float = 1e-4
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 1e-5
    factor: float = 0.1
    patience: int = 5
    threshold: float = 1e-4
    seed: int = 42

    def order(self, epoch: int) -> list[int]:
        """The cells in the epoch's order."""
        return sorted(range(self.batches), key=lambda c: hashlib.md5(f"{self.seed}:{epoch}:{c}".encode()).hexdigest())

    def cell(self, key: Column) -> Column:
        """The cell of an id."""
        drawn = F.md5(F.concat(F.lit(f"{self.seed}:cell:"), key.cast("string")).cast("binary"))
        return (F.conv(F.substring(F.coalesce(drawn, F.lit("0")), 1, 8), 16, 10).cast("long") % self.batches).cast("int")


@dataclass
class State:
    """weights, mean, square: (classes, positions + 1), the bias last; best is the lowest loss on the rows to validate on."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    epoch: int = 0
    step: int = 0
    lr: float = 0.0
    best: float = math.inf
    best_epoch: int = 0
    bad: int = 0
    train_loss: float | None = None
    val_loss: float | None = None


@dataclass(frozen=True)
class Run:
    """A folder of checkpoints: history is (epoch, lr, train_loss, val_loss), lr being that of the epoch itself."""

    spark: SparkSession = field(repr=False)
    path: str

    def folder(self, epoch: int) -> str:
        return f"{self.path.rstrip('/')}/epoch-{epoch:05d}"

    def _complete(self, epoch: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(epoch)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def epochs(self) -> int:
        """Complete epochs."""
        n = 0
        while self._complete(n + 1):
            n += 1
        return n

    def load(self, epoch: int) -> State:
        rows = self.spark.read.schema(_STATE).parquet(self.folder(epoch)).orderBy("cls").collect()  # a row a class
        arrays = (np.array([r[c] for r in rows]) for c in ("weights", "mean", "square"))
        rest = ("epoch", "step", "lr", "best", "best_epoch", "bad", "train_loss", "val_loss")
        return State(*arrays, **{c: rows[0][c] for c in rest})

    def save(self, s: State) -> None:
        rest = (s.epoch, s.step, s.lr, s.best, s.best_epoch, s.bad, s.train_loss, s.val_loss)
        rows = [(c, w.tolist(), m.tolist(), q.tolist(), *rest) for c, (w, m, q) in enumerate(zip(s.weights, s.mean, s.square))]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(self.folder(s.epoch))

    def best(self) -> State:
        """The state after the epoch with the lowest loss."""
        return self.load(self.load(self.epochs()).best_epoch)

    def history(self, first_lr: float) -> DataFrame:
        """Losses of the complete epochs; first_lr: the rate of the first one."""
        rows, lr = [], first_lr
        for e in range(1, self.epochs() + 1):  # a row an epoch
            s = self.load(e)
            rows.append((e, lr, s.train_loss, s.val_loss))
            lr = s.lr
        return self.spark.createDataFrame(rows, "epoch int, lr double, train_loss double, val_loss double")


def _numbers(column, wide: int) -> np.ndarray:
    return np.nan_to_num(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(-1, wide)


def _outputs(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:, :-1].T + weights[:, -1]


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sums of the gradients and losses over rows (x, y), and their number."""
    classes, wide = weights.shape

    def run(batches):
        grad, loss, n = np.zeros((classes, wide)), 0.0, 0
        for batch in batches:
            x, y = _numbers(batch.column("x"), wide - 1), _numbers(batch.column("y"), classes)
            z = _outputs(x, weights)
            off = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
            grad += np.c_[off.T @ x, off.sum(0)]
            loss -= float((y * np.maximum(-np.logaddexp(0, -z), LEAST) + (1 - y) * np.maximum(-np.logaddexp(0, z), LEAST)).sum())
            n += len(x)
        values = np.r_[grad.ravel(), loss, n]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    got = rows.select("x", "y").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # a row a number of the model
    out = np.zeros(classes * wide + 2)
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out[:-2].reshape(classes, wide), float(out[-2]), int(round(out[-1]))


def _stepped(s: State, grad: np.ndarray, by: Schedule) -> State:
    """The state after one step of Adam."""
    one, two = by.betas
    grad = grad + by.decay * s.weights
    n = s.step + 1
    mean, square = one * s.mean + (1 - one) * grad, two * s.square + (1 - two) * grad * grad
    move = s.lr * (mean / (1 - one**n)) / (np.sqrt(square / (1 - two**n)) + by.eps)
    return replace(s, weights=s.weights - move, mean=mean, square=square, step=n)


def _judged(s: State, train_loss: float | None, val_loss: float | None, by: Schedule) -> State:
    """The state at the end of an epoch: its losses, the best one, and the next epoch's rate."""
    epoch = s.epoch + 1
    if val_loss is None:
        return replace(s, epoch=epoch, train_loss=train_loss, val_loss=None, best_epoch=epoch)
    bad = 0 if val_loss < s.best * (1 - by.threshold) else s.bad + 1
    lr, bad = (s.lr * by.factor, 0) if bad > by.patience else (s.lr, bad)
    better = val_loss < s.best
    return replace(s, epoch=epoch, train_loss=train_loss, val_loss=val_loss, lr=lr, bad=bad, best=min(s.best, val_loss), best_epoch=epoch if better else s.best_epoch)


def train(rows: DataFrame, validation: DataFrame, path: str, by: Schedule = Schedule()) -> Run:
    """Trains heads on rows (id, x, y), x and y arrays of numbers, up to the schedule's last epoch; goes on where the path has checkpoints."""
    spark = rows.sparkSession
    ship(spark)
    run = Run(spark, path)
    done = run.epochs()
    if done >= by.epochs:
        return run
    used = lambda d: d.where("x is not null and y is not null")
    at = f"{shared_folder(spark).rstrip('/')}/{hashlib.md5(path.encode()).hexdigest()}-{done}-cells"
    used(rows).select(by.cell(F.col("id")).alias("cell"), "x", "y").write.mode("overwrite").partitionBy("cell").parquet(at)
    cells = spark.read.schema("x array<double>, y array<double>, cell int").parquet(at)
    cells._stored_at = at
    kept = stored(used(validation).select("x", "y"))
    sizes = cells.select(F.size("x").alias("p"), F.size("y").alias("c")).union(kept.select(F.size("x"), F.size("y"))).distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("vectors or labels of different lengths" if sizes else "no rows to train on")
    shape = (sizes[0]["c"], sizes[0]["p"] + 1)
    state = run.load(done) if done else State(*(np.zeros(shape) for _ in range(3)), lr=by.lr)
    if state.weights.shape != shape:
        raise ValueError(f"the checkpoints are of {state.weights.shape} weights, the rows of {shape}")
    while state.epoch < by.epochs:
        losses = []
        for cell in by.order(state.epoch + 1):
            grad, loss, n = _sums(cells.where(F.col("cell") == cell), state.weights)
            if n:
                losses.append(loss / (n * shape[0]))
                state = _stepped(state, grad / (n * shape[0]), by)
        _, loss, n = _sums(kept, state.weights)
        state = _judged(state, sum(losses) / len(losses) if losses else None, loss / (n * shape[0]) if n else None, by)
        run.save(state)
    drop(cells, kept)
    return run


def scores(rows: DataFrame, state: State, classes: list[str]) -> DataFrame:
    """(id, class, score, truth): the heads' outputs for rows (id, x, y)."""
    ship(rows.sparkSession)
    weights = state.weights
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(_outputs(_numbers(batch.column("x"), weights.shape[1] - 1), weights), -700, 700)))
            y = _numbers(batch.column("y"), len(weights))
            each = np.repeat(np.arange(len(p)), len(weights))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(each)), pa.array(classes * len(p)), pa.array(p.ravel()), pa.array((y.ravel() > 0.5).astype(np.int32))], ["id", "class", "score", "truth"])

    return rows.where("x is not null and y is not null").select("id", "x", "y").mapInArrow(run, f"id {kind}, class string, score double, truth int")
