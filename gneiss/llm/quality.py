"""Quality rules: line labels by a linear-chain CRF, retention by the share of content.

Every line with a word is described by a few numbers; a conditional random field with the labels
content and boilerplate, decoded with Viterbi, marks each line, and a document is kept if it passes
the base rules and at least ``CONTENT_SHARE`` of its words stand in content lines.

The field is trained on a bounded sample: ``PER_CLASS`` labelled documents of either quality, those
with the smallest hash of their id, and a run of ``TRAIN_LINES`` lines from anywhere in each. Only
documents are labelled, so the labels of lines are latent: they start as their document's, notices
(lines with two of ``NOTICE_WORDS`` or more, and few others) as boilerplate; then lines that a field without transitions places
clearly on the other side change theirs, unless most words of the document would. The chain is
trained on what results. Everything else (counts, decoding, decisions) covers whole texts of all
rows.

Defined results: a null or blank text has no words, fails the base rules and is not kept. Without
labelled rows every line counts as content. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textvec as tv
from gneiss.llm.storage import released, trim

PER_CLASS = 1500
TRAIN_LINES = 32
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
FEATURES = 13
#: Log odds from which a line of a labelled document takes the other label, and how often labels are looked at again.
CLEAR, ROUNDS = 2.0, 2
#: A line is a notice if one in so many of its words is a notice word.
NOTICE_SHARE = 10
#: Words of licences and notices; fixed values.
NOTICE_WORDS = (
    "copyright", "license", "licensed", "licence", "licenced", "rights", "reserved", "terms", "privacy", "policy", "cookies", "subscribe", "newsletter", "permission", "warranty",
    "disclaimer", "gnu", "apache", "mit", "creative", "commons", "©",
)
_U = np.uint64


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(chars)] = 1
    return table


_SYMBOL, _DIGIT, _UPPER = _flags(SYMBOLS), _flags(b"0123456789"), _flags(bytes(range(65, 91)))
_STOP = _flags(b".!?").astype(bool)
_NOTICE = None
_POINT = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], dtype=np.int64)


def _notice_hashes() -> np.ndarray:
    """Hashes of the notice words as texts write them."""
    global _NOTICE
    if _NOTICE is None:
        forms = [f + tail for w in NOTICE_WORDS for f in (w, w.title(), w.upper()) for tail in ("", ".", ",", ":", ";")]
        part = next(iter(tv.slices(pa.array([" ".join(forms)]))))
        _NOTICE = np.unique(tv.words(part, tv.BLANK_SEPARATED, lower=False).hashes)
    return _NOTICE


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


@dataclass
class Lines:
    """What is known of a slice: counts of each row, and each line with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    borders: np.ndarray
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def _seen_before(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    out = np.empty(len(keys), dtype=bool)
    out[order] = twice
    return out


def describe(part: tv.Slice) -> Lines:
    """Counts and line features of a slice."""
    data, offsets = part.data, part.offsets
    w = tv.words(part, tv.BLANK_SEPARATED, lower=False)
    counts = np.diff(w.borders)
    row_of_word = np.repeat(np.arange(part.rows), counts)
    salt = tv.mix(np.arange(part.rows, dtype=np.uint64) + _U(1))

    # words of repeated windows of three
    full = max(len(w.hashes) - 2, 0)
    windows = w.hashes[:full] * tv._LANE[0] + w.hashes[1 : full + 1] * tv._LANE[1] + w.hashes[2 : full + 2] * tv._LANE[2]
    inside = row_of_word[:full] == row_of_word[2 : full + 2] if full else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[_repeated(tv.mix(windows[at]) + salt[row_of_word[at]])]
    repeat = np.zeros(len(w.hashes), dtype=np.int64)
    for j in range(3):
        repeat[again + j] = 1

    # lines with a word: from the first to the last byte between line feeds
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(data)] if len(data) else heads[:0]
    line_of_word = np.searchsorted(heads, w.starts, side="right") - 1
    used, first_word = np.unique(line_of_word, return_index=True)
    last_word = np.concatenate([first_word[1:], [len(w.starts)]])[: len(used)]
    starts = heads[used]
    stops = np.concatenate([heads[1:], [len(data)]])[used] if len(used) else starts
    stops = stops - (data[stops - 1] == 10) if len(used) else stops
    row = row_of_word[first_word]
    hashes = tv.hash_spans(data, starts, stops) if len(used) else np.empty(0, np.uint64)
    dup = _seen_before(hashes + salt[row]) if len(used) else np.empty(0, bool)

    point = _sums(_POINT[data])
    symbol, digit, upper = (_sums(t[data]) for t in (_SYMBOL, _DIGIT, _UPPER))
    word_points = point[w.ends] - point[w.starts]
    word_symbols = symbol[w.ends] - symbol[w.starts]
    points_to, repeats_to = _sums(word_points), _sums(repeat)
    short_to = _sums(word_points <= 3)
    marked_to = _sums(word_symbols > 0)
    notice_to = _sums(np.isin(w.hashes, _notice_hashes()))
    bare_to = _sums(word_symbols == word_points)
    n = (last_word - first_word).astype(float)
    chars = np.maximum(1.0, points_to[last_word] - points_to[first_word])
    share = lambda to: (to[last_word] - to[first_word]) / np.maximum(n, 1)
    rate = lambda to: (to[stops] - to[starts]) / chars
    noticed = notice_to[last_word] - notice_to[first_word]
    notice = np.minimum(noticed, 2) / 2.0 * (NOTICE_SHARE * noticed >= n)
    tail = data[w.ends[last_word - 1] - 1] if len(used) else np.empty(0, np.uint8)
    features = np.stack(
        [np.ones(len(used)), np.log1p(n) / 4, rate(symbol) * 4, rate(digit) * 4, chars / np.maximum(n, 1) / 8, share(short_to), _STOP[tail].astype(float), rate(upper) * 4, dup.astype(float), share(bare_to), share(marked_to), share(repeats_to), notice],
        axis=1,
    )
    lines_to = np.searchsorted(row, np.arange(part.rows + 1))
    dups_to = _sums(dup)
    return Lines(
        counts.astype(np.int64), points_to[w.borders[1:]] - points_to[w.borders[:-1]], symbol[offsets[1:]] - symbol[offsets[:-1]],
        dups_to[lines_to[1:]] - dups_to[lines_to[:-1]], repeats_to[w.borders[1:]] - repeats_to[w.borders[:-1]], lines_to, n.astype(np.int64), features,
    )


@dataclass
class LineField:
    """A linear-chain CRF with two labels: 0 boilerplate, 1 content."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    @classmethod
    def blank(cls) -> LineField:
        emission = np.zeros((FEATURES, 2))
        emission[0, 1] = 1e-6
        return cls(emission, np.zeros((2, 2)), np.zeros(2))

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list, chain: bool = True, steps: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> LineField:
        """Maximum likelihood with forward-backward gradients and Adam over whole sequences.

        labels: one for each sequence, or an array with one for each of its lines. Without ``chain``
        lines are independent of their neighbours.
        """
        kept = [(s, y) for s, y in zip(sequences, labels, strict=True) if len(s)]
        if len({int(v) for _, y in kept for v in np.unique(y)}) < 2:
            return cls.blank()
        longest, m = max(len(s) for s, _ in kept), len(kept)
        x, live = np.zeros((m, longest, FEATURES)), np.zeros((m, longest), dtype=bool)
        gold = np.zeros((m, longest), dtype=int)
        for i, (s, y) in enumerate(kept):
            x[i, : len(s)], live[i, : len(s)], gold[i, : len(s)] = s, True, y
        ends = live.sum(axis=1) - 1
        shape = [(FEATURES, 2), (2, 2), (2,)]
        params = [np.zeros(s) for s in shape]
        first, second = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
        hot = np.eye(2)[gold] * live[..., None]
        pair = hot[:, :-1, :, None] * hot[:, 1:, None, :]
        for step in range(1, steps + 1):
            emission, transition, start = params
            scores = x @ emission
            forward, backward = np.zeros((m, longest, 2)), np.zeros((m, longest, 2))
            forward[:, 0] = scores[:, 0] + start
            for t in range(1, longest):
                step_in = np.logaddexp(forward[:, t - 1, :1] + transition[0], forward[:, t - 1, 1:] + transition[1]) + scores[:, t]
                forward[:, t] = np.where(live[:, t, None], step_in, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = backward[:, t + 1] + scores[:, t + 1]
                step_out = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
                backward[:, t] = np.where(live[:, t + 1, None], step_out, 0.0)
            total = np.logaddexp(*forward[np.arange(m), ends].T)
            single = np.exp(forward + backward - total[:, None, None]) * live[..., None]
            both = forward[:, :-1, :, None] + transition + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]
            both = np.exp(np.where(live[:, 1:, None, None], both, -np.inf))
            grads = [
                np.einsum("mtf,mtk->fk", x, hot - single) / m - penalty * emission,
                (pair - both).sum(axis=(0, 1)) / m - penalty * transition,
                (hot[:, 0] - single[:, 0]).sum(axis=0) / m - penalty * start,
            ]
            if not chain:
                grads[1:] = [np.zeros((2, 2)), np.zeros(2)]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return cls(*params)

    def decode(self, features: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The best label of every line; rows are decoded side by side."""
        scores = features @ self.emission
        counts = np.diff(borders)
        labels = np.zeros(len(scores), dtype=np.int8)
        if not len(scores):
            return labels
        order = np.argsort(-counts, kind="stable")
        heads, lengths = borders[:-1][order], counts[order]
        back = np.zeros((len(scores), 2), dtype=np.int8)
        live = int((lengths > 0).sum())
        best = scores[heads[:live]] + self.start
        finals = np.zeros((len(order), 2))
        finals[:live] = best
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            options = best[:live, :, None] + self.transition
            choice = options.argmax(axis=1)
            best = options.max(axis=1) + scores[heads[:live] + t]
            back[heads[:live] + t] = choice
            finals[:live] = best
        state = finals.argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            at = heads[:live] + t
            labels[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return labels


def latent_labels(sequences: list[np.ndarray], labels: list[int], words: list[np.ndarray]) -> list[np.ndarray]:
    """A label for each line of documents that are labelled as a whole; words: of each line."""
    notice = [s[:, -1] >= 1.0 for s in sequences]
    now = [np.where(n, 0, y) for n, y in zip(notice, labels, strict=True)]
    for _ in range(ROUNDS):
        field = LineField.fit(sequences, now, chain=False)
        odds = [s @ (field.emission[:, 1] - field.emission[:, 0]) for s in sequences]
        now = []
        for o, n, y, w in zip(odds, notice, labels, words, strict=True):
            mixed = np.where(o > CLEAR, 1, np.where(o < -CLEAR, 0, y))
            # a document keeps its label by most of its words
            own = np.where(2 * w[mixed == y].sum() >= w.sum(), mixed, y) if len(o) else mixed
            now.append(np.where(n, 0, own))
    return now


@dataclass
class Verdicts:
    lines: Lines
    content_words: np.ndarray
    kept: np.ndarray


def judge(part: tv.Slice, field: LineField) -> Verdicts:
    lines = describe(part)
    content = _sums(field.decode(lines.features, lines.borders) * lines.line_words)
    words = content[lines.borders[1:]] - content[lines.borders[:-1]]
    kept = ~lines.base_failed & (words >= CONTENT_SHARE * lines.n_words)
    return Verdicts(lines, words, kept)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineField:
    """Train the field on a sample of at most ``per_class`` labelled documents of either quality."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for q in (0, 1)]
    wanted = {r["doc_id"]: r["quality"] for rows in chosen for r in rows}
    if not wanted:
        return LineField.blank()
    ids = spark.createDataFrame([(int(k), int(v)) for k, v in wanted.items()], "id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").select("id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, quality, out = batch.column(0), batch.column(1), []
            for part in tv.slices(batch.column(2)):
                lines = describe(part)
                for a, b, n in zip(lines.borders[:-1], lines.borders[1:], lines.n_words, strict=True):
                    a += int(tv.mix(np.array([n], dtype=np.uint64))[0] % _U(max(b - a - TRAIN_LINES, 0) + 1))
                    run_of = slice(a, min(b, a + TRAIN_LINES))
                    out.append(np.column_stack([lines.line_words[run_of], lines.features[run_of]]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([keys, quality, pa.array(out, pa.binary())], ["id", "quality", "features"])

    rows = texts.mapInArrow(released(run), "id long, quality int, features binary").collect()
    rows = sorted({r["id"]: r for r in sorted(rows, key=lambda r: (r["id"], bytes(r["features"])))}.values())
    tables = [np.frombuffer(r["features"], "<f4").reshape(-1, 1 + FEATURES).astype(float) for r in rows]
    sequences = [t[:, 1:] for t in tables]
    field = LineField.fit(sequences, latent_labels(sequences, [r["quality"] for r in rows], [t[:, 0] for t in tables]))
    del rows, tables, sequences
    trim()
    return field


def assess(docs: DataFrame, field: LineField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the counts, base_failed, n_content_words and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    head = docs.select(key).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    schema = head + "".join(f", {x} long" for x in names) + ", n_content_words long, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch.column(1)):
                v = judge(part, field)
                columns = [pa.array(np.asarray(getattr(v.lines, x), dtype=np.int64)) for x in names]
                columns += [pa.array(v.content_words.astype(np.int64)), pa.array(v.lines.base_failed), pa.array(v.kept)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), *columns], [key, *names, "n_content_words", "base_failed", "kept"])

    return docs.select(key, text).mapInArrow(released(run), schema)


def keep_good(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch.column(at)):
                yield batch.slice(part.first, part.rows).filter(pa.array(judge(part, field).kept))

    return docs.mapInArrow(released(run), docs.schema)
