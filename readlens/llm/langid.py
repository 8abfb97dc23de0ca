"""Language identification by a byte convolutional network.

The network: bytes (A-Z lower-cased) are embedded, filters of several widths slide over a fixed-length
window, each filter keeps its maximum, and a softmax layer names the language.  It is trained in numpy,
in one task, on a bounded sample of labelled documents (``SAMPLE_DOCS``, dealt evenly over the labels).
A text's score is the mean softmax over all its windows, whole text included.

For prediction, embedding and filters are folded into one table per pair of neighbouring bytes, so a
position costs two look-ups instead of a matrix product.

Cases: null text or one without a letter is ``und`` with score 0; a null doc_id counts as held out;
rows with null lang or text are never trained on; a table without any usable label makes everything
``und``; a text of any length is read whole, window by window; equal rows get equal answers; further columns are
kept."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import LOWER, broadcast_value, frees, fresh, only, row_slices, string_batch

#: Bytes in a window, embedding size, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
SPAN = max(WIDTHS)
#: At most so many labelled documents are trained on, with so many windows of each.
SAMPLE_DOCS, DOC_WINDOWS, EPOCHS, BATCH = 3000, 4, 6, 64
#: Share of rightly named held-out documents that may score below the rejection score.
REJECTED_SHARE = 0.001
UNDETERMINED = "und"
PAD = 0x20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text, h): the same number of documents of each label, as a hash of them falls."""
    usable = only(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    labels = counts.count()
    if not labels:
        return usable.select("lang", "text", F.lit(0).cast("long").alias("h")).limit(0)
    each = max(1, limit // labels)
    # first about four times the rows that are wanted of each label, by the hash, so that ranking them is bounded
    h = F.xxhash64("doc_id", "text", F.lit("langid"))
    few = F.broadcast(counts) if labels <= limit else counts  # a checked number of rows, and a join beyond it
    some = usable.join(few, "lang").withColumn("h", h).where(
        F.shiftrightunsigned("h", 33) * F.col("rows") < F.lit(float(4 * each) * (1 << 31)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return some.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text", "h")


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.labels = labels
        n = FILTERS * len(WIDTHS)
        mask = np.zeros((SPAN, EMBED, n), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            mask[:w, :, i * FILTERS: (i + 1) * FILTERS] = 1
        self.mask = mask.reshape(SPAN * EMBED, n)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, 0.3, self.mask.shape) * self.mask,
                  "bias": np.zeros(n), "out": r.normal(0, 0.3, (n, len(labels))), "out_bias": np.zeros(len(labels))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, labels=np.array(self.labels, dtype=str), **self.p)
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ByteCNN:
        z = np.load(io.BytesIO(raw))
        net = cls([str(x) for x in z["labels"]])
        net.p = {k: z[k] for k in net.p}
        return net

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on softmax cross-entropy; through a maximum only the winning position learns."""
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at: at + BATCH]
                xb = np.pad(x[pick], ((0, 0), (0, SPAN - 1)), constant_values=PAD)
                patches = np.lib.stride_tricks.sliding_window_view(xb, SPAN, axis=1)  # batch, position, SPAN
                act = self.p["embed"][patches].reshape(*patches.shape[:2], -1) @ self.p["filters"]
                win = act.argmax(axis=1)  # batch, filter
                top = np.take_along_axis(act, win[:, None, :], axis=1)[:, 0] + self.p["bias"]
                hidden = np.maximum(top, 0)
                logits = hidden @ self.p["out"] + self.p["out_bias"]
                prob = np.exp(logits - logits.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                d = prob
                d[np.arange(len(pick)), y[pick]] -= 1
                d /= len(pick)
                dh = (d @ self.p["out"].T) * (top > 0)
                best = patches[np.arange(len(pick))[:, None], win]  # batch, filter, SPAN
                emb = self.p["embed"][best].reshape(*best.shape[:2], -1)
                g = {"out": hidden.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0),
                     "filters": np.einsum("bf,bfk->kf", dh, emb) * self.mask, "embed": np.zeros_like(self.p["embed"])}
                de = (dh[:, :, None] * self.p["filters"].T[None]).reshape(*best.shape, EMBED)
                np.add.at(g["embed"], best, de)
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    self.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Per pair of bytes, what it adds to each filter as a patch's first and second half."""
        t = self.p["embed"] @ self.p["filters"].reshape(SPAN, EMBED, -1)  # SPAN, 256, filter
        pair = lambda a, b: (t[a][:, None] + t[b][None]).reshape(65536, -1).astype(np.float32)
        return pair(0, 1), pair(2, 3)

    def predict_windows(self, x: np.ndarray, folded: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes)."""
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), 64):
            xb = np.pad(x[at: at + 64], ((0, 0), (0, SPAN - 1)), constant_values=PAD).astype(np.int32)
            pairs = (xb[:, :-1] << 8) | xb[:, 1:]
            act = folded[0][pairs[:, :WINDOW]]
            act += folded[1][pairs[:, 2: WINDOW + 2]]
            logits = np.maximum(act.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[at: at + 64] = e / e.sum(1, keepdims=True)
        return out


assert SPAN == 4  # fold() pairs the four bytes of a patch


def _training_windows(text: str, h: int) -> np.ndarray:
    raw = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    r = np.random.default_rng(h & 0xFFFFFFFF)
    n = min(DOC_WINDOWS, max(1, len(raw) // WINDOW))
    out = np.full((n, WINDOW), PAD, dtype=np.uint8)
    for row in out:
        # short windows too, so that short texts are nothing new
        size = WINDOW if r.random() < 0.7 else int(r.integers(8, WINDOW))
        a = int(r.integers(0, max(1, len(raw) - size + 1)))
        part = raw[a: a + size]
        row[: len(part)] = part
    return out


def train(docs: DataFrame, limit: int = SAMPLE_DOCS) -> bytes:
    """Weights of a network trained on ``docs`` (doc_id, text, lang); a few tens of KB."""

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["h"], r["lang"], r["text"]))
        labels = sorted({r["lang"] for r in rows})
        cut = [(_training_windows(r["text"], r["h"]), labels.index(r["lang"])) for r in rows if r["text"].strip()]
        net = ByteCNN(labels)
        if cut:
            net.train(np.concatenate([w for w, _ in cut]), np.concatenate([np.full(len(w), y) for w, y in cut]))
        return pa.table({"net": pa.array([net.to_bytes()], pa.binary())})

    out = training_sample(docs, limit).groupBy(F.lit(1).alias("one")).applyInArrow(fit, "net binary").collect()
    return bytes(out[0]["net"]) if out else b""


_NETS: dict[int, tuple[ByteCNN, tuple]] = {}


def _predict(raw: bytes, texts: pa.Array) -> pa.StructArray:
    key = hash(raw)
    if key not in _NETS:
        _NETS.clear()
        net = ByteCNN.from_bytes(raw) if raw else None
        _NETS[key] = (net, net.fold() if net else None)
    net, folded = _NETS[key]
    data, offsets = string_batch(texts)
    langs, scores = [], []
    for i, j in row_slices(offsets, 1 << 20):
        lo, sizes = offsets[i], np.diff(offsets[i: j + 1])
        b = LOWER[data[lo: offsets[j]]]
        ascii_letters = np.concatenate([[0], np.cumsum((b >= 0x61) & (b <= 0x7A))])
        starts = (offsets[i: j + 1] - lo).astype(np.int64)
        n_win = -(-sizes // WINDOW)
        if net is not None and n_win.sum():
            doc = np.repeat(np.arange(j - i), n_win)
            at = starts[doc] + (np.arange(len(doc)) - (np.cumsum(n_win) - n_win)[doc]) * WINDOW
            stop = starts[doc + 1]
            where = at[:, None] + np.arange(WINDOW)
            inside = where < stop[:, None]
            x = np.where(inside, b[np.minimum(where, len(b) - 1)], PAD).astype(np.uint8)
            prob = net.predict_windows(x, folded).astype(np.float64) * inside.sum(1)[:, None]
            total = np.zeros((j - i, len(net.labels)))
            np.add.at(total, doc, prob)
        for k in range(j - i):
            a, z = starts[k], starts[k + 1]
            letters = ascii_letters[z] > ascii_letters[a] or any(map(str.isalpha, b[a:z].tobytes().decode()))
            if net is None or not letters:
                langs.append(UNDETERMINED)
                scores.append(0.0)
            else:
                best = int(total[k].argmax())
                langs.append(net.labels[best])
                scores.append(float(min(1.0, total[k][best] / sizes[k])))
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])


def identify(docs: DataFrame, net: bytes, column: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score) for the whole ``text``."""
    shared = broadcast_value(docs.sparkSession, net)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    @frees
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _predict(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return docs.mapInArrow(predict, f"{kinds}, `{column}` struct<lang_pred: string, score: double>")


def rejection_score(docs: DataFrame, net: bytes, share: float = REJECTED_SHARE) -> float:
    """The score below which a document is taken for none of the learned languages: of all held-out rows with a label that
    the network names rightly, at most ``share`` score less (to one rank in 100,000).  0 where there are none."""
    rows = only(docs, "doc_id", "text", "lang").where(held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    column = fresh(rows, "language")
    right = identify(rows, net, column).where(F.col(f"{column}.lang_pred") == F.col("lang"))
    found = right.agg(F.percentile_approx(F.col(f"{column}.score"), share, 100_000).alias("score")).first()["score"]
    return float(found or 0.0)


def keep_identified(docs: DataFrame, net: bytes, min_score: float = 0.0) -> DataFrame:
    """``docs`` without those that are undetermined or score below ``min_score``; same columns."""
    column = fresh(docs, "language")
    seen = identify(docs, net, column)
    return seen.where((F.col(f"{column}.lang_pred") != UNDETERMINED) & (F.col(f"{column}.score") >= min_score)).drop(column)


def predictions(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, from a network trained on the rows that aren't held out."""
    found = identify(only(docs, "doc_id", "text"), train(docs, limit))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"),
                        F.col("language.score").alias("score"))
