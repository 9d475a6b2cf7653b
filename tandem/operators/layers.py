"""Batch scoring of pre-trained layers over vectors (item_id, vec).

A layer is a small dict of arrays: w (inputs x units), b_hidden, b_visible, activation, backward_activation.  Layers
travel with the task (`MAX_BYTES` at most); products run on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 256 << 20
ACTIVATIONS = {
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 1e-4),
    "abs_tanh": lambda x: np.abs(np.tanh(x)),
    "linear": lambda x: x,
}


def layer(w, b_hidden=None, b_visible=None, activation: str = "sigmoid", backward_activation: str = "sigmoid") -> dict:
    w = np.asarray(w, float)
    if w.nbytes > MAX_BYTES:
        raise ValueError("the layer is too large to travel with the tasks")
    return {
        "w": w, "b_hidden": np.zeros(w.shape[1]) if b_hidden is None else np.asarray(b_hidden, float),
        "b_visible": np.zeros(w.shape[0]) if b_visible is None else np.asarray(b_visible, float),
        "activation": activation, "backward_activation": backward_activation,
    }


def _map(vectors: DataFrame, fn, out: str = "vec array<double>", keep: Sequence[str] = ("item_id",)) -> DataFrame:
    """fn(ids, matrix) -> matrix or one value for each row, batch by batch."""
    listed = "array" in out
    name = out.split(" ")[0]

    def score(frames):
        for b in frames:
            if not b.num_rows:
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = fn(b.column("item_id").to_numpy(zero_copy_only=False), x)
            if listed:
                offs = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                col = pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(y).ravel()))
            else:
                col = pa.array(y)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), col], ["item_id", name])

    typed = vectors.where("vec IS NOT NULL").select("item_id", F.col("vec").cast("array<double>").alias("vec"))
    return typed.mapInArrow(score, f"item_id {dict(typed.dtypes)['item_id']}, {out}")


def _up(x, l):
    return ACTIVATIONS[l["activation"]](x @ l["w"] + l["b_hidden"])


def _down(h, l):
    return ACTIVATIONS[l["backward_activation"]](h @ l["w"].T + l["b_visible"])


def _uniform(ids, width: int, seed: int) -> np.ndarray:
    """`random.hash_uniform` of item, unit and seed, so that retried tasks agree."""
    bits = [int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:13], 16) for i in ids for j in range(width)]
    return (np.array(bits, float).reshape(len(ids), width) + 0.5) / (1 << 52)


def layer_forward(vectors: DataFrame, weights: dict, corruption: float = 0.0, seed: int = 0) -> DataFrame:
    """act(xW + b); with `corruption` each input is zeroed with that probability, as denoising layers do."""
    def run(ids, x):
        return _up(x * (_uniform(ids, x.shape[1], seed) >= corruption) if corruption else x, weights)

    return _map(vectors, run)


def layer_backward(hidden: DataFrame, weights: dict) -> DataFrame:
    return _map(hidden, lambda _, h: _down(h, weights))


def _sent(df: DataFrame, *layers: dict):
    """Layers as one object that the tasks of an executor share."""
    if sum(v.nbytes for l in layers for v in l.values() if isinstance(v, np.ndarray)) > MAX_BYTES:
        raise ValueError("the layers are too large to travel with the tasks")
    return df.sparkSession.sparkContext.broadcast(layers)


def _forward(x, layers):
    for l in layers:
        x = _up(x, l)
    return x


def _backward(h, layers):
    for l in reversed(layers):
        h = _down(h, l)
    return h


def stack_forward(vectors: DataFrame, layers: Sequence[dict]) -> DataFrame:
    sent = _sent(vectors, *layers)
    return _map(vectors, lambda _, x: _forward(x, sent.value))


def stack_backward(hidden: DataFrame, layers: Sequence[dict]) -> DataFrame:
    sent = _sent(hidden, *layers)
    return _map(hidden, lambda _, h: _backward(h, sent.value))


def _completed(ids, text, joint: dict, dim_img: int, k: int, start: float, sample_hidden: bool, sample_visible: bool, seed: int):
    dim_text = text.shape[1]
    image = np.full((len(text), dim_img), start)
    for step in range(k):
        last = step == k - 1
        h = _up(np.hstack([text, image]), joint)
        if sample_hidden and not last:
            h = (_uniform(ids, h.shape[1], seed + 2 * step) < h).astype(float)
        image = _down(h, joint)[:, dim_text:]
        if sample_visible and not last:
            image = (_uniform(ids, dim_img, seed + 2 * step + 1) < image).astype(float)
    return image


def complete_modality(text_vectors: DataFrame, joint: dict, dim_text: int, dim_img: int, k: int = 10, start: float = 0.0, sample_hidden: bool = True, sample_visible: bool = False, seed: int = 0) -> DataFrame:
    """The image half after k steps v -> h -> v with the text half clamped; the last step uses means."""
    if joint["w"].shape[0] != dim_text + dim_img:
        raise ValueError("the joint layer has another number of inputs")
    sent = _sent(text_vectors, joint)
    return _map(text_vectors, lambda ids, x: _completed(ids, x, sent.value[0], dim_img, k, start, sample_hidden, sample_visible, seed))


def text_to_image(
    text_vectors: DataFrame, text_layers: Sequence[dict], joint: dict, image_layers: Sequence[dict], k: int = 10, start: float = 0.0, sample_hidden: bool = True, sample_visible: bool = False, seed: int = 0
) -> DataFrame:
    """Text forward through its layers, the image half completed by the joint layer, and back through the image layers in mirrored order: one pass."""
    n, sent = len(text_layers), _sent(text_vectors, *text_layers, joint, *image_layers)

    def run(ids, x):
        layers = sent.value
        text = _forward(x, layers[:n])
        image = _completed(ids, text, layers[n], layers[n]["w"].shape[0] - text.shape[1], k, start, sample_hidden, sample_visible, seed)
        return _backward(image, layers[n + 1 :])

    return _map(text_vectors, run)


def reconstruction_error(vectors: DataFrame, weights: dict, kind: str = "mse") -> DataFrame:
    """item_id and error: cross-entropy, mse, or exploded (10 * (v - x)^10), summed over the row (mse: mean)."""
    def run(_, x):
        v = _down(_up(x, weights), weights)
        if kind == "cross-entropy":
            v = np.clip(v, 1e-12, 1 - 1e-12)
            return -(x * np.log(v) + (1 - x) * np.log(1 - v)).sum(axis=1)
        return ((v - x) ** 2).mean(axis=1) if kind == "mse" else (10 * (v - x) ** 10).sum(axis=1)

    return _map(vectors, run, "error double")


def sparsity_kl(activations: DataFrame, target: float = 0.05, axis: str = "unit") -> DataFrame:
    """Kullback-Leibler divergence of mean activations from the target, for each unit or each row, and not summed."""
    cells = activations.select("item_id", F.posexplode("vec").alias("unit", "value"))
    mean = cells.groupBy("unit" if axis == "unit" else "item_id").agg(F.avg("value").alias("rho"))
    rho = F.least(F.greatest("rho", F.lit(1e-12)), F.lit(1 - 1e-12))
    return mean.withColumn("kl", target * F.log(target / rho) + (1 - target) * F.log((1 - target) / (1 - rho)))


def _energy(x, l, replicated=False):
    bias = l["b_hidden"] * x.sum(axis=1, keepdims=True) if replicated else l["b_hidden"]
    return -np.logaddexp(0, x @ l["w"] + bias).sum(axis=1) - x @ l["b_visible"]


def free_energy(vectors: DataFrame, weights: dict, kind: str = "binary") -> DataFrame:
    """-sum log(1 + e^(xW+b)) - x b_v; replicated: b times the row's sum."""
    return _map(vectors, lambda _, x: _energy(x, weights, kind == "replicated"), "energy double")


def pseudo_likelihood(vectors: DataFrame, weights: dict, bit: int = 0) -> DataFrame:
    """n * log sigmoid(F(flipped) - F(x)) for rounded rows with one bit flipped."""
    def run(_, x):
        x = np.round(x)
        y = x.copy()
        y[:, bit] = 1 - y[:, bit]
        return -x.shape[1] * np.logaddexp(0, _energy(x, weights) - _energy(y, weights))

    return _map(vectors, run, "value double")


def activation_entropy(activations: DataFrame) -> DataFrame:
    """Summed entropy of each row's units."""
    h = lambda p: -(p * F.log(p) + (1 - p) * F.log(1 - p))
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return activations.select("item_id", F.aggregate(F.transform("vec", lambda p: h(inside(p))), F.lit(0.0), lambda s, x: s + x).alias("entropy"))


def regression_error(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Mean squared error over all components: one row, mse."""
    both = predicted.select("item_id", F.col("vec").alias("_p")).join(true.select("item_id", F.col("vec").alias("_t")), "item_id")
    return both.select(F.explode(F.zip_with("_p", "_t", lambda a, b: (a - b) * (a - b))).alias("e")).agg(F.avg("e").alias("mse"))


def evaluate_split(losses: DataFrame, split: str) -> DataFrame:
    """Mean over complete batches (split, batch, loss) of their mean losses."""
    return losses.where(F.col("split") == split).groupBy("batch").agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("loss"))


def weight_norms(weights: DataFrame) -> DataFrame:
    """layer_weights in long form (layer, i, j, w): sums of absolute values and squares."""
    return weights.groupBy("layer").agg(F.sum(F.abs("w")).alias("l1"), F.sum(F.col("w") * F.col("w")).alias("l2"))


def top_weight_changes(before: DataFrame, after: DataFrame, k: int = 3) -> DataFrame:
    joined = before.join(after.withColumnRenamed("w", "_new"), ["layer", "i", "j"])
    return joined.withColumn("change", F.col("_new") - F.col("w")).orderBy(F.desc(F.abs("change")), "layer", "i", "j").limit(k).drop("_new")


def long_weights(w: Column) -> Column:
    return F.posexplode(w)
