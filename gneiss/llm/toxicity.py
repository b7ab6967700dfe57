"""Toxicity scores from a counterfactually regularised linear classifier on byte 5-grams.

A text's features are the distinct 5-grams of its bytes (A-Z in lower case, every separator a
space), hashed. Logistic regression is trained on labelled texts. Each has a counterfactual copy: if
it names groups, with every term swapped for another of its kind; else with a term put in between
two of its words, so that each term stands in texts of both labels. The loss adds ``COUNTERFACTUAL``
times the mean squared change of the score over these pairs, so that naming a group as such carries
little weight. A classifier knows the number of its pairs, and their mean change of score (``gap``).

Learning takes a bounded sample: of the rows outside the held-out fifth, at most ``PER_CLASS`` of
each label, those with the smallest hash of their id. Every whole text is scored.

Defined results: a null text is scored as the empty text, which has no features, so its score is
that of the intercept. Without labels of both kinds every score is 0 (to double precision). Rows with a null id are
never held out. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textvec as tv

PER_CLASS = 2000
GRAM = 5
BITS = 20
KEPT_FEATURES = 2048
#: A feature must be so many times as frequent in toxic texts, and stand in so many of them.
LEAST_ODDS = 3.0
LEAST_TEXTS = 4
COUNTERFACTUAL = 1.0
#: Terms that may stand for each other in a sentence; fixed values.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual"),
    ("immigrants", "refugees", "locals"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {t: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, t in enumerate(group)}
_TERM = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)


def swapped(text: str) -> str | None:
    """The text with every identity term swapped for the next of its kind; None if it names none."""
    out, n = _TERM.subn(lambda m: _NEXT[m[0].lower()], text)
    return out if n else None


def mentioning(text: str) -> str:
    """The text with an identity term put in between two of its words; the place and the term depend on the text."""
    words = text.split(" ")
    at = zlib.crc32(text.encode("utf-8", "replace"))
    terms = list(_NEXT)
    place = at // len(terms) % (len(words) + 1)
    return " ".join([*words[:place], terms[at % len(terms)], *words[place:]])


_TABLE = np.where(tv.LETTERS_DIGITS[tv.LOWER], tv.LOWER, 32).astype(np.uint8)


def features(part: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of a slice, not yet distinct, and the border of each row among them.

    A row reads as if a space stood before and after it.
    """
    data = _TABLE[part.data]
    padded = np.full(len(data) + 2 * part.rows, 32, dtype=np.uint8)
    shift = np.repeat(np.arange(part.rows) * 2 + 1, np.diff(part.offsets))
    padded[np.arange(len(data)) + shift] = data
    n = len(padded)
    code = np.zeros(max(n - GRAM + 1, 0), dtype=np.uint64)
    for j in range(GRAM):
        code = (code << np.uint64(8)) | padded[j : j + len(code)].astype(np.uint64)
    heads = part.offsets + 2 * np.arange(part.rows + 1)
    bucket = (tv.mix(code) >> np.uint64(64 - BITS)).astype(np.int32)
    last = np.maximum(heads[1:] - GRAM + 1, heads[:-1])
    return bucket, np.stack([heads[:-1], np.minimum(last, len(bucket))], axis=1)


@dataclass
class Classifier:
    weights: np.ndarray
    intercept: float
    n_pairs: int = 0
    gap: float = 0.0

    @classmethod
    def blank(cls) -> Classifier:
        return cls(np.zeros(1 << BITS, dtype=np.float32), -1000.0)

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: list[int], pairs: list[tuple[int, np.ndarray]], steps: int = 150, penalty: float = 1e-3, strength: float = COUNTERFACTUAL) -> Classifier:
        """rows: distinct buckets of each text; pairs: (place of a text, buckets of its counterfactual)."""
        y = np.asarray(labels, dtype=np.float32)
        if not len(y) or y.min() == y.max():
            return cls.blank()
        seen = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k]), minlength=1 << BITS) for k in (0, 1)]
        rate = [(s + 0.5) / (n + 1) for s, n in zip(seen, ((y == 0).sum(), (y == 1).sum()), strict=True)]
        # only what speaks for toxicity, and clearly: long clean texts hold a little of everything
        odds = np.log(rate[1]) - np.log(rate[0])
        clear = np.where((odds > np.log(LEAST_ODDS)) & (seen[1] >= LEAST_TEXTS), odds * np.sqrt(seen[1]), 0)
        kept = np.sort(np.argpartition(-clear, KEPT_FEATURES)[:KEPT_FEATURES])
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[kept] = np.arange(KEPT_FEATURES)

        def matrix(sets: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(sets), KEPT_FEATURES), dtype=np.float32)
            for i, s in enumerate(sets):
                at = place[s]
                out[i, at[at >= 0]] = 1
            return out

        x, other = matrix(rows), matrix([b for _, b in pairs])
        origin = np.array([i for i, _ in pairs], dtype=int)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w, b = np.zeros(KEPT_FEATURES, dtype=np.float32), 0.0
        moment, scale = np.zeros(KEPT_FEATURES + 1), np.zeros(KEPT_FEATURES + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            error = weight * (p - y) / len(y)
            grad, bias = x.T @ error + penalty * w, error.sum()
            if len(pairs):
                q = 1 / (1 + np.exp(-(other @ w + b)))
                gap = 2 * strength * (p[origin] - q) / len(pairs)
                up, down = gap * p[origin] * (1 - p[origin]), gap * q * (1 - q)
                grad = grad + x[origin].T @ up - other.T @ down
                bias += (up - down).sum()
            g = np.append(grad, bias)
            moment += 0.1 * (g - moment)
            scale += 0.001 * (g * g - scale)
            move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
            w, b = np.maximum(w - move[:-1], 0).astype(np.float32), b - move[-1]
        gap = 0.0
        if len(pairs):
            own, changed = (1 / (1 + np.exp(-(m @ w + b))) for m in (x[origin], other))
            gap = float(np.abs(own - changed).mean())
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[kept] = w
        return cls(weights, float(b), len(pairs), gap)

    def score(self, part: tv.Slice) -> np.ndarray:
        buckets, borders = features(part)
        used = np.flatnonzero(self.weights[buckets] != 0)
        row = np.searchsorted(borders[:, 0], used, side="right") - 1
        inside = used < borders[row, 1]
        both = np.unique(row[inside].astype(np.int64) << BITS | buckets[used[inside]])
        total = np.bincount(both >> BITS, weights=self.weights[both & ((1 << BITS) - 1)], minlength=part.rows)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -700, 700)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    """Train on at most ``per_class`` rows of each label outside the held-out fifth."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    wanted = {}
    for v in (0, 1):
        for r in known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            wanted[int(r["doc_id"])] = v
    if len(set(wanted.values())) < 2:
        return Classifier.blank()
    ids = spark.createDataFrame(list(wanted.items()), "id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").select("id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[bytes]:
            out = []
            for part in tv.slices(column):
                b, borders = features(part)
                out += [tv.distinct(b[i:j]).astype("<i4").tobytes() for i, j in borders]
            return out

        for batch in batches:
            bodies = [t.as_py() or "" for t in batch.column(2)]
            others = pa.array([swapped(t) or mentioning(t) for t in bodies], pa.string())
            columns = [batch.column(0), batch.column(1), pa.array(sets(batch.column(2)), pa.binary()), pa.array(sets(others), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "own", "other"])

    rows = texts.mapInArrow(run, "id long, toxic int, own binary, other binary").collect()
    rows = sorted({r["id"]: r for r in sorted(rows, key=lambda r: (r["id"], bytes(r["own"])))}.values())
    read = lambda v: np.frombuffer(v, "<i4")
    return Classifier.fit([read(r["own"]) for r in rows], [r["toxic"] for r in rows], [(i, read(r["other"])) for i, r in enumerate(rows)])


def scored(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch.column(2)):
                own = batch.slice(part.first, part.rows)
                score = model.score(part)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), text)
    head = rows.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return rows.mapInArrow(run, f"{head}, held_out boolean, score double, predicted int")
