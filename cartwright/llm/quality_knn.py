"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text becomes weights of hashed terms: character trigrams of its lower-cased bytes, and marks that say in
which band its repetition, its capitals, its symbols and its word length lie. A truncated singular value
decomposition of a bounded labelled sample (about ``Size.each`` documents of each label) gives the latent
space. The sample's unit vectors, at most ``2 * Size.each`` rows of ``Size.dimensions`` numbers, go to every
task; every document's cosine with every one of them is computed by blocks of matrix products, and
the ``Size.neighbours`` nearest vote, each with its label weighted by its similarity.

Null and empty texts have no trigram but the marks of an empty text, and are scored like others.
Of equally near neighbours those earlier in the sample's order (label, then terms) vote. Without
labelled rows every score is 0.5. A document with labels that contradict each other teaches
nothing. Rows are scored on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm import sampling
from cartwright.llm.memory import give_back
from cartwright.llm.words import whole_text

GRAMS = 1 << 12
BANDS = 12
MARKS = 5
TERMS = GRAMS + MARKS * BANDS
MARK_COUNT = 3000.0  # a mark weighs (in logarithms) like a trigram that stands so often
BLOCK = 256


@dataclass(frozen=True)
class Size:
    each: int = 1500  # labelled documents of each label in the sample, about
    dimensions: int = 48
    neighbours: int = 15
    seed: int = 11


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text, ascending, and how often each stands."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    grams = ((data[:-2] * 961 + data[1:-1]) * 961 + data[2:]) * np.uint32(2654435761) >> 20
    counts = np.bincount(grams, minlength=GRAMS) if len(grams) else np.zeros(GRAMS, int)
    found = np.flatnonzero(counts)
    words = text.split()
    lines = text.split("\n")
    n, size = max(1, len(words)), max(1, sum(map(len, words)))
    lower = text.lower()
    shares = (
        1 - len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(map(str.isupper, text)) / size if lower != text else 0.0,
        min(1.0, size / n / 20),
    )
    marks = [GRAMS + k * BANDS + min(BANDS - 1, int(s * BANDS)) for k, s in enumerate(shares)]
    return (
        np.concatenate([found, marks]).astype(np.int32),
        np.concatenate([counts[found], [MARK_COUNT] * MARKS]).astype(np.float32),
    )


@dataclass
class Neighbourhood:
    """The latent space and the labelled documents in it."""

    importance: np.ndarray  # of each term: inverse document frequency
    axes: np.ndarray  # (terms, dimensions)
    vectors: np.ndarray  # (labelled, dimensions), unit length
    votes: np.ndarray  # 1 for label 1, else 0
    neighbours: int

    def place(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit vector of a document in the latent space."""
        weights = np.log1p(counts) * self.importance[found]
        vector = weights @ self.axes[found]
        return vector / max(float(np.linalg.norm(vector)), 1e-12)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Share of the nearest neighbours' similarity that is for label 1."""
        near = vectors @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        bound = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        chosen = near >= bound
        over = chosen.sum(axis=1) > k
        if over.any():  # ties at the bound: the earlier ones
            sure = near[over] > bound[over]
            level = near[over] == bound[over]
            room = k - sure.sum(axis=1, keepdims=True)
            chosen[over] = sure | (level & (np.cumsum(level, axis=1) <= room))
        weight = np.where(chosen, np.maximum(near, 0) + 1e-9, 0)
        return (weight @ self.votes) / weight.sum(axis=1)


def build(documents: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, size: Size) -> Neighbourhood:
    """Latent space of the sample by a randomised decomposition with two power steps."""
    matrix = np.zeros((len(documents), TERMS), np.float32)
    for row, (found, counts) in zip(matrix, documents, strict=True):
        row[found] = np.log1p(counts)
    importance = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 0.1
    matrix *= importance
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    k = min(size.dimensions, *matrix.shape)
    rng = np.random.default_rng(size.seed)
    probe = rng.standard_normal((TERMS, min(k + 10, len(matrix)))).astype(np.float32)
    for _ in range(3):
        span, _ = np.linalg.qr(matrix @ probe)
        probe = matrix.T @ span
    _, _, right = np.linalg.svd(probe.T, full_matrices=False)
    axes = np.ascontiguousarray(right[:k].T)
    vectors = matrix @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Neighbourhood(importance, axes, vectors, votes.astype(np.float32), size.neighbours)


def _term_udf() -> Column:
    @F.arrow_udf("found array<int>, counts array<float>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [terms(t.as_py() or "") for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                ["found", "counts"],
            )

    return find


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", size: Size | None = None) -> Neighbourhood | None:
    """Neighbours from documents whose ``key`` has one label, 0 or 1; None if there are none.

    The sample is chosen from the labels alone; being bounded, it goes to the documents where
    they lie, and only its terms come to the driver.
    """
    size = size or Size()
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("key").isNotNull()
    )
    drawn = F.broadcast(sampling.about(known, "label", "key", size.each, size.seed).select("key").distinct())
    chosen = (
        known.join(drawn, "key")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    taught = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).join(
        F.broadcast(chosen.select("key", "label")), "key"
    )
    taught = sampling.bounded(taught.select("label", "text"), "label", "text", size.each, size.seed)
    rows = taught.select("label", _term_udf()("text").alias("t")).select("label", "t.*").toArrow()
    examples = sorted(zip(*[c.to_pylist() for c in rows.columns], strict=True))
    if not examples:
        return None
    documents = [(np.array(f, np.int32), np.array(c, np.float32)) for _, f, c in examples]
    return build(documents, np.array([e[0] for e in examples]), size)


def score(model: Neighbourhood | None, text: str | Column) -> Column:
    """Score of each text, 0 to 1, higher where label 1 is likelier."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), BLOCK):
                block = batch.slice(at, BLOCK)
                vectors = np.array([model.place(*terms(t.as_py() or "")) for t in block])
                out.append(model.scores(vectors.astype(np.float32)))
            yield pa.array(np.clip(np.concatenate(out), 0, 1) if out else [], pa.float64())
        give_back()

    return vote(whole_text(text))
