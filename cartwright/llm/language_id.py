"""Language identification by a convolutional network over bytes.

Bytes are embedded; filters of several widths run over a window of fixed length; each filter's
greatest response in the window enters a softmax over the languages. The network is trained in
numpy on the driver, on a bounded sample of labelled texts: about ``TrainingSize.texts`` for each
language, and of each text as many pseudo-randomly placed pieces as ``TrainingSize.pieces`` has
lengths (the short ones teach short texts).

A text is cut into windows that cover all its bytes (the last one ends with the text, a shorter
text is padded with zero bytes); their probabilities are averaged. As the input is one of 256
bytes, embedding and filters fold into tables of responses to byte pairs, so a window costs
look-ups and additions.

Null texts and texts without a letter give ``und`` with score 0, as does everything if there is no
labelled row. Ties go to the language that comes first by code point. Rows are scored on their
own, so repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm import sampling
from cartwright.llm.memory import give_back
from cartwright.llm.words import whole_text

UNKNOWN = "und"
LENGTH = 256  # bytes in a window
WIDTHS = (2, 3, 4)
BLOCK = 256  # windows convolved together


@dataclass(frozen=True)
class TrainingSize:
    texts: int = 1500  # about so many labelled texts of each language
    pieces: tuple[int, ...] = (LENGTH, LENGTH, LENGTH // 8)  # bytes cut from each text
    filters: int = 16  # of each width
    dimensions: int = 8  # of a byte
    passes: int = 4
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


@dataclass
class Network:
    """Weights; ``filters[w]`` has the shape (w, dimensions, filters)."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _pairs: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": {}}

    def tables(self) -> dict:
        """For each width, the responses to each pair of bytes at places 0-1, 2-3, ..., and to
        each single byte at the last place of an odd width."""
        if not self._pairs:
            for w in WIDTHS:
                single = [(self.embedding @ self.filters[w][j]).astype(np.float32) for j in range(w)]
                steps = [
                    (j, (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1))
                    for j in range(0, w - 1, 2)
                ]
                self._pairs[w] = (steps, single[-1] if w % 2 else None)
        return self._pairs

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Greatest responses, one row per window."""
        n = len(windows)
        wide = windows.astype(np.int32)
        pairs = wide[:, :-1] << 8 | wide[:, 1:]
        found = []
        for w, (steps, last) in self.tables().items():
            places = LENGTH - w + 1
            total = None
            for j, responses in steps:
                part = np.take(responses, pairs[:, j : j + places], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if last is not None:
                total += np.take(last, wide[:, w - 1 : w - 1 + places], axis=0)
            found.append(total.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(found, axis=1), 0) if n else np.empty((0, 0))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.out + self.out_bias)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], size: TrainingSize) -> Network:
    """Fit by Adam on mini-batches. Only the places of the greatest responses get gradients."""
    rng = np.random.default_rng(size.seed)
    d, f, n_out = size.dimensions, size.filters, len(languages)
    weights = {"e": rng.normal(0, 0.5, (256, d)), "o": rng.normal(0, 0.1, (f * len(WIDTHS), n_out)), "ob": np.zeros(n_out)}
    for w in WIDTHS:
        weights[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * d), (w, d, f))
        weights[f"b{w}"] = np.zeros(f)
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(size.passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), size.batch):
            rows = order[at : at + size.batch]
            x, y = windows[rows].astype(np.int64), labels[rows]
            embedded = weights["e"][x]
            parts, best = [], {}
            for w in WIDTHS:
                places = LENGTH - w + 1
                response = sum(embedded[:, j : j + places] @ weights[f"f{w}"][j] for j in range(w))
                best[w] = response.argmax(axis=1)  # (batch, filters)
                parts.append(np.take_along_axis(response, best[w][:, None, :], 1)[:, 0] + weights[f"b{w}"])
            raw = np.concatenate(parts, axis=1)
            pooled = np.maximum(raw, 0)
            error = softmax(pooled @ weights["o"] + weights["ob"])
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            gradient = {"o": pooled.T @ error, "ob": error.sum(0), "e": np.zeros_like(weights["e"])}
            back = (error @ weights["o"].T) * (raw > 0)
            for k, w in enumerate(WIDTHS):
                own = back[:, k * f : (k + 1) * f]
                gradient[f"b{w}"] = own.sum(0)
                g = np.empty_like(weights[f"f{w}"])
                for j in range(w):
                    byte = np.take_along_axis(x, best[w] + j, 1)  # (batch, filters)
                    g[j] = np.einsum("bf,bfd->df", own, weights["e"][byte])
                    np.add.at(gradient["e"], byte.ravel(), (own[:, :, None] * weights[f"f{w}"][j].T[None]).reshape(-1, d))
                gradient[f"f{w}"] = g
            step += 1
            for k, g in gradient.items():
                first, second = moment[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                weights[k] -= size.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Network(
        languages, weights["e"], {w: weights[f"f{w}"] for w in WIDTHS},
        {w: weights[f"b{w}"] for w in WIDTHS}, weights["o"], weights["ob"],
    )


def fit(rows: DataFrame, text: str = "text", label: str = "lang", size: TrainingSize | None = None) -> Network | None:
    """A network from labelled texts; None if there is none with a label and a byte."""
    size = size or TrainingSize()
    labelled = rows.select(F.col(label).alias("label"), whole_text(text).alias("text")).where(F.length("text") > 0)
    chosen = sampling.about(labelled, "label", "text", size.texts, size.seed)
    data = F.encode("text", "utf-8")

    def piece(k: int, length: int) -> Column:
        room = F.greatest(F.octet_length("text") - length, F.lit(0))
        at = (sampling.share("text", size.seed + 1 + k) * (room + 1)).cast("int") + 1
        return F.substring(data, at, F.lit(length))

    pieces = chosen.select(
        "label",
        F.array(*[piece(k, length) for k, length in enumerate(size.pieces)]).alias("pieces"),
    ).toArrow()
    examples = sorted(  # whatever order the rows came in
        (label, piece.ljust(LENGTH, b"\0"))
        for label, cut in zip(*[c.to_pylist() for c in pieces.columns], strict=True)
        for piece in cut
    )
    if not examples:
        return None
    languages = sorted({label for label, _ in examples})
    number = {name: k for k, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(piece for _, piece in examples), np.uint8)
    labels = np.array([number[label] for label, _ in examples])
    return train(windows.reshape(-1, LENGTH), labels, languages, size)


def _texts(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and where each text begins and ends."""
    batch = batch.cast(pa.large_string())
    _, places, data = batch.buffers()
    ends = np.frombuffer(places, np.int64)[batch.offset : batch.offset + len(batch) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return np.concatenate([held[: ends[-1]], np.zeros(LENGTH, np.uint8)]), ends


def _window_starts(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and how many each text has (at least one)."""
    sizes = np.diff(ends)
    counts = np.maximum(1, -(-sizes // LENGTH))
    firsts = np.repeat(ends[:-1], counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    latest = np.repeat(np.maximum(ends[1:] - LENGTH, ends[:-1]), counts)
    return np.minimum(firsts + nth * LENGTH, latest), counts


def predictions(network: Network | None, text: str | Column) -> Column:
    """``struct<lang_pred string, score double>`` of each text."""
    text = whole_text(text)
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if network is None:
        return nothing

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, ends = _texts(batch)
            starts, counts = _window_starts(ends)
            room = np.repeat(ends[1:], counts) - starts  # bytes of the text that are left
            rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            found = []
            for at in range(0, len(starts), BLOCK):
                block = rows[starts[at : at + BLOCK]]
                left = room[at : at + BLOCK]
                for k in np.flatnonzero(left < LENGTH):
                    block[k, max(0, left[k]) :] = 0
                found.append(network.probabilities(block))
            if not found:
                yield pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))
                continue
            each = np.concatenate(found).astype(np.float64)
            mean = np.add.reduceat(each, np.cumsum(counts) - counts, axis=0) / counts[:, None]
            best = mean.argmax(axis=1)
            names = pa.array(network.languages).take(pa.array(best))
            score = pa.array(np.clip(mean[np.arange(len(best)), best], 0, 1))
            yield pa.StructArray.from_arrays([names.cast(pa.string()), score], ["lang_pred", "score"])
        give_back()

    return F.when(text.rlike(r"\p{L}"), predict(text)).otherwise(nothing)
