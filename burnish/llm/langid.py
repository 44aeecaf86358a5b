"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy.

Every byte of a text is labelled; a text's probabilities are the means of its bytes' probabilities.
The gates are hard sigmoids and the candidate state is a softsign, so that a step needs no exponentials.
A text is read in segments of `SEGMENT` bytes, each from both ends, so memory does not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_view, kinds, mapped

SEGMENT = 128
TRAIN_SEGMENT = 64
HIDDEN = 6
#: The bound of the training sample: rows of each language, and the most languages that are learned.
SAMPLE_ROWS = 1_000
LANGUAGES = 256
UNKNOWN = "und"


# --- the network


def start_weights(languages: int, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights by name: `f` and `b` for the two directions; `x` from the byte, `h` from the state; gates r, z, n."""
    rng = np.random.default_rng(seed)
    weights = {}
    for way in "fb":
        for gate in "rzn":
            # A gate is its input cut to 0..1, so it starts around the middle, and flat.
            middle, scale = (0.0, 1.0) if gate == "n" else (0.5, 0.25)
            weights[f"{way}x{gate}"] = middle + scale * rng.normal(0, 0.5, (256, hidden))
            weights[f"{way}h{gate}"] = scale * rng.normal(0, hidden**-0.5, (hidden, hidden))
        weights[f"{way}out"] = rng.normal(0, hidden**-0.5, (hidden, languages))
    weights["out"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _gate(a: np.ndarray) -> np.ndarray:
    np.maximum(a, 0, out=a)
    return np.minimum(a, 1, out=a)


def _states(w: dict, way: str, x: np.ndarray, real: np.ndarray, keep: bool = False):
    """The state after each byte, over x[position, segment]; the state is 0 at positions that are not real.

    With `keep`, also what backpropagation needs of each step.
    """
    steps, width = x.shape
    shape = (width, w["fhr"].shape[0])
    kind = w["fhr"].dtype
    byte_r, byte_z, byte_n, hid_r, hid_z, hid_n = (w[f"{way}{k}"] for k in ("xr", "xz", "xn", "hr", "hz", "hn"))
    states = np.empty((steps, *shape), kind)
    h = np.zeros(shape, kind)
    full = real.all(axis=1)
    kept = [None] * steps
    r, z, a, inner, size, product = (np.empty(shape, kind) for _ in range(6))
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        if keep:
            r, z, a, inner, size, product = (np.empty(shape, kind) for _ in range(6))
        byte = x[t]
        for out, table, matrix in ((r, byte_r, hid_r), (z, byte_z, hid_z)):
            np.take(table, byte, axis=0, mode="clip", out=out)
            np.matmul(h, matrix, out=product)
            out += product
            _gate(out)
        np.matmul(h, hid_n, out=inner)
        np.take(byte_n, byte, axis=0, mode="clip", out=a)
        np.multiply(r, inner, out=product)
        a += product
        np.abs(a, out=size)
        size += 1
        a /= size
        new = np.subtract(h, a, out=states[t])
        new *= z
        new += a
        if not full[t]:
            new *= real[t][:, None]
        if keep:
            kept[t] = (h, r, z, inner, a, size)
        h = new
    return states, kept


def language_probabilities(w: dict, x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Probability of each [language, position, segment]."""
    x = x.astype(np.intp)
    forward, backward = _states(w, "f", x, real)[0], _states(w, "b", x, real)[0]
    p = np.empty((len(w["out"]), *x.shape), forward.dtype)
    for t in range(0, len(x), 16):  # so many positions at a time stay in the cache
        part = slice(t, t + 16)
        scores = w["fout"].T @ forward[part].reshape(-1, forward.shape[2]).T
        scores += w["bout"].T @ backward[part].reshape(-1, backward.shape[2]).T
        scores += w["out"][:, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        p[:, part] = scores.reshape(len(p), -1, x.shape[1])
    return p


def gradients(w: dict, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over real positions, and its gradient by backpropagation through time."""
    x = x.astype(np.intp)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    ways = {way: _states(w, way, x, real, keep=True) for way in "fb"}
    scores = sum(ways[way][0] @ w[f"{way}out"] for way in "fb") + w["out"]
    scores -= scores.max(axis=2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=2, keepdims=True)
    total = max(real.sum(), 1)
    rows = np.arange(x.shape[1])
    loss = -(np.log(p[:, rows, label] + 1e-30) * real).sum() / total
    p[:, rows, label] -= 1
    p *= (real / total)[:, :, None].astype(p.dtype)
    grad["out"] = p.sum(axis=(0, 1))
    steps = x.shape[0]
    flat = x.ravel()
    for way, (states, kept) in ways.items():
        grad[f"{way}out"] = np.tensordot(states, p, ((0, 1), (0, 1)))
        from_out = p @ w[f"{way}out"].T
        later = np.zeros_like(states[0])
        at_byte = {gate: np.zeros_like(states) for gate in "rzn"}
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            h, r, z, inner, n, size = kept[t]
            d = (from_out[t] + later) * real[t][:, None]
            d_z = d * (h - n) * ((z > 0) & (z < 1))
            d_a = d * (1 - z) / size**2
            d_r = d_a * inner * ((r > 0) & (r < 1))
            d_inner = d_a * r
            later = d * z
            for gate, at, into in (("r", d_r, d_r), ("z", d_z, d_z), ("n", d_a, d_inner)):
                at_byte[gate][t] = at
                grad[f"{way}h{gate}"] += h.T @ into
                later = later + into @ w[f"{way}h{gate}"].T
        for gate, at in at_byte.items():
            for k, column in enumerate(at.reshape(-1, at.shape[2]).T):
                grad[f"{way}x{gate}"][:, k] = np.bincount(flat, column, 256)
    return float(loss), grad


def train(x: np.ndarray, real: np.ndarray, label: np.ndarray, languages: int, *, steps: int = 200, batch: int = 192,
          rate: float = 0.02, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit the network with Adam to labelled segments x[segment, position]."""
    w = start_weights(languages, seed=seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(x), min(batch, len(x)), replace=False)
        _, grad = gradients(w, x[rows].T, real[rows].T, label[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(w[k].dtype)
    return w


def segments(data: np.ndarray, offsets: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of every value, cut into segments: bytes [segment, position], which are real, and whose they are."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + within * length
    real = np.arange(length) < (offsets[1:][owner] - start)[:, None]
    x = np.zeros(real.shape, np.uint8)
    if len(owner):
        x[:] = data[np.minimum(start[:, None] + np.arange(length), len(data) - 1)]
        x *= real
    return x, real, owner


# --- in Spark


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4. A null id is not kept back."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES, segment: int = TRAIN_SEGMENT,
        steps: int = 200) -> LanguageModel | None:
    """Train on a bounded sample: about `rows` texts of each of the `languages` most frequent languages.

    The sample is chosen by a hash of the id, and of each text a piece of `segment` characters at a hashed
    place is used. The number of texts of each language is counted first, so no more than the sample is moved.
    Returns None if no row has both a language and a text.
    """
    usable = docs.select("doc_id", "text", "lang").filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = {r.lang: r.n for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not known:
        return None
    draw = F.xxhash64(F.lit("draw"), "doc_id", F.length("text")).cast("double") / F.lit(2.0**64) + 0.5
    limit = F.element_at(F.create_map(*(F.lit(v) for k, n in known.items() for v in (k, 1.5 * rows / n))), F.col("lang"))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - segment, F.lit(0)) + 1).cast("int") + 1
    chosen = usable.withColumn("draw", draw).filter(F.col("draw") < limit)
    piece = chosen.select("lang", "draw", F.col("text").substr(at, F.lit(segment)).alias("piece"))
    order = W.partitionBy("lang").orderBy("draw", "piece")
    sample = piece.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows).select("lang", "piece").collect()
    names = sorted(known)
    sample.sort(key=lambda r: (r.lang, r.piece))
    texts = pa.array([r.piece.encode() for r in sample], pa.binary())
    x, real, owner = segments(*byte_view(texts), length=segment)
    place = {k: i for i, k in enumerate(names)}
    label = np.array([place[r.lang] for r in sample])[owner]
    # As many of each language, so that a rare one is not drowned.
    rng = np.random.default_rng(0)
    most = np.bincount(label, minlength=len(names)).max()
    even = np.concatenate([rng.choice(np.flatnonzero(label == k), most) for k in np.unique(label)])
    return LanguageModel(names, train(x[even], real[even], label[even], len(names), steps=steps))


def pooled(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, width: int = 2048) -> np.ndarray:
    """Mean probability of each language over all bytes of each value; zeros for an empty value."""
    sums = np.zeros((len(offsets) - 1, len(model.languages)))
    start, rows = 0, len(offsets) - 1
    while start < rows:  # so many texts at a time that their segments fill a few batches
        end = int(np.searchsorted(offsets, offsets[start] + 16 * width * SEGMENT, side="right")) - 1
        end = min(max(end, start + 1), rows)
        sizes = np.diff(offsets[start : end + 1])
        if len(sizes) == 1 and sizes[0] > 16 * width * SEGMENT:  # one very long text, a part at a time
            for at in range(int(offsets[start]), int(offsets[end]), 16 * width * SEGMENT):
                part = np.array([at, min(at + 16 * width * SEGMENT, offsets[end])])
                sums[start] += _summed(model, data, part, width)[0]
        else:
            sums[start:end] = _summed(model, data, offsets[start : end + 1], width)
        start = end
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def _summed(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    x, real, owner = segments(data, offsets)
    sums = np.zeros((len(offsets) - 1, len(model.languages)))
    # Full segments first: they need no mask.
    order = np.argsort(~real[:, -1], kind="stable")
    for k in range(0, len(order), width):
        rows = order[k : k + width]
        part = np.ascontiguousarray(real[rows].T)
        p = language_probabilities(model.weights, np.ascontiguousarray(x[rows].T), part)
        if not part.all():
            p *= part
        for c, by_segment in enumerate(p.sum(axis=1)):
            sums[:, c] += np.bincount(owner[rows], by_segment, len(sums))
    return sums


def predict(texts: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """The rows with `lang_pred` and `score` after their columns; every byte of the text is read.

    A text that is null, empty or has no letter is `und` with score 0; so is every text without a model.
    Columns of the same names are replaced.
    """
    base = texts.drop("lang_pred", "score")
    spark = texts.sparkSession
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = spark.sparkContext.broadcast((model.languages, model.weights))  # a fixed number of weights
    flagged = base.select("*", letters)
    names = base.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = LanguageModel(*sent.value)
        known = np.array([*net.languages, UNKNOWN], object)
        for batch in batches:
            has = np.asarray(batch.column(len(names)).to_numpy(zero_copy_only=False), bool)
            column = batch.column(names.index(text))
            data, offsets = byte_view(column.filter(pa.array(has)))
            p = pooled(net, data, offsets)
            best, score = np.full(len(has), len(net.languages)), np.zeros(len(has))
            best[has], score[has] = p.argmax(axis=1), p.max(axis=1)
            out = [batch.column(i) for i in range(len(names))]
            out += [pa.array(known[best], pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "lang_pred", "score"])

    return mapped(flagged, label, [*kinds(base), ("lang_pred", "string"), ("score", "double")])


def identify(docs: DataFrame, **how) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns only from rows that are not held out. Repeated rows get equal results, an empty table gives none.
    """
    model = fit(docs, **how)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text").select("doc_id", "held_out", "lang_pred", "score")


#: A text whose best language has a mean probability below this is rejected.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, *, least: float = LEAST_SCORE, **how) -> DataFrame:
    """The rows of `docs` whose language is known: not `und`, and scored at least `least`. Columns stay as they are.

    Where no row to learn from has a language there is no model, and all rows whose text has a letter are kept.
    """
    names = docs.columns
    model = fit(docs, **how)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    labelled = predict(docs.toDF(*(f"c{i}" for i in range(len(names)))), model, text=f"c{names.index('text')}")
    kept = labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*names)
