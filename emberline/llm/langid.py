"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier a bit says on
which side of that bit a text lies; the language whose codeword fits the real-valued
answers with the least weighted loss wins, and texts between two codewords are flagged.

The classifiers are naive Bayes ratios of hashed byte n-grams, so fitting is one
counting pass over all training rows, summed by Spark; the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ship
from .textarrays import mixed, slices, utf8
from .tokens import forget

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3)
SMOOTH = 0.5
EVIDENCE = 40.0
AMBIGUOUS = 0.6
SLICE = 1 << 20
_COUNT_SCHEMA = "lang string, bucket int, n bigint"
_FIT_SCHEMA = "lang string, bit int, n bigint, hit bigint"


def codewords(n: int) -> np.ndarray:
    """+1/-1 matrix, a row a language: all distinct splits for up to five, else rows of a Hadamard-like random code."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.zeros(len(splits), int), bits]).astype(np.int8) * 2 - 1
    length = 8 * int(np.ceil(np.log2(n))) + 7
    best, rng = None, np.random.default_rng(n)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        code = code[:, (np.abs(code.sum(0)) < n)]
        apart = (code.shape[1] - code.astype(int) @ code.T)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram and the offsets of each text's n-grams."""
    if len(data) < max(ORDERS):
        data = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)])
    code = data.astype(np.uint64) + np.uint64(1)
    parts, n = [], len(data)
    for order in ORDERS:
        h = np.full(n, np.uint64(order * 0x9E3779B1))
        for k in range(order):
            shifted = np.zeros(n, np.uint64)
            shifted[:n - k] = code[k:]
            h = h * np.uint64(0x100000001B3) + shifted
        parts.append((mixed(h) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    return np.stack(parts, 1).ravel(), offsets * len(ORDERS)


def _text_sums(table: np.ndarray, bucket: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``table[bucket]`` over each text (rows of zeros for empty texts)."""
    out = np.zeros((len(ends) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        got = table[bucket[:ends[-1]]]
        out[full] = np.add.reduceat(got, ends[:-1][full], axis=0)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def answers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Real-valued answer of each bit for each text: mean log ratio, scaled by the evidence, bounded."""
        bucket, ends = buckets(data, offsets)
        n = np.diff(ends)[:, None]
        mean = _text_sums(self.weights, bucket, ends) / np.maximum(n, 1)
        return np.clip(mean * np.minimum(n, EVIDENCE), -8, 8)

    def decode(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share among all, and whether the runner-up is too close."""
        loss = np.log1p(np.exp(-self.code[None] * answers[:, None, :]))
        total = (loss * self.trust[None]).sum(2)
        likely = np.exp(total.min(1)[:, None] - total)
        best = total.argmin(1)
        score = 1 / likely.sum(1)
        return best, score, score < AMBIGUOUS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    forget()
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            bucket, ends = buckets(*utf8(part.column("text")))
            lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
            owner = np.repeat(lang, np.diff(ends))
            counts += np.bincount(owner * BUCKETS + bucket[:ends[-1]], minlength=counts.size).reshape(counts.shape)
    row, col = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([languages[i] for i in row], pa.string()), pa.array(col, pa.int32()),
                                      pa.array(counts[row, col], pa.int64())], ["lang", "bucket", "n"])


def _hits(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(model.languages)}
    seen, hit = (np.zeros(model.code.shape, np.int64) for _ in range(2))
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
            right = (model.answers(*utf8(part.column("text"))) >= 0) == (model.code[lang] > 0)
            np.add.at(seen, lang, 1)
            np.add.at(hit, lang, right)
    row, col = np.indices(model.code.shape)
    yield pa.RecordBatch.from_arrays([pa.array([model.languages[i] for i in row.ravel()], pa.string()), pa.array(col.ravel(), pa.int32()),
                                      pa.array(seen.ravel(), pa.int64()), pa.array(hit.ravel(), pa.int64())],
                                     ["lang", "bit", "n", "hit"])


def fit(training: DataFrame) -> Model:
    """Fit on all rows with text and lang. To the driver come only sums: one a language and bucket, one a language and bit."""
    ship(training.sparkSession)
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.lower("text").alias("text"), "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones((0, 1)))
    summed = rows.mapInArrow(lambda it: _count(it, languages), _COUNT_SCHEMA).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    rate = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    # Languages count alike on their side of a bit, however many rows they have.
    sides = [np.log(np.stack([rate[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.ones(BUCKETS) / BUCKETS for s in (1, -1)]))
             for b in range(code.shape[1])]
    weights = np.stack([s[0] - s[1] for s in sides], 1).astype(np.float32)
    model = Model(languages, code, weights, np.ones(code.shape) / code.shape[1])
    hits = rows.mapInArrow(lambda it: _hits(it, model), _FIT_SCHEMA).groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    for r in hits.collect():
        model.trust[place[r["lang"]], r["bit"]] = max(0.0, 2 * (r["hit"] + 1) / (r["n"] + 2) - 1)
    model.trust = (model.trust + 1e-3) / (model.trust + 1e-3).sum(1, keepdims=True) * code.shape[1] / 2
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous; only ``text`` is looked at.

    ``und`` with score 0 where text is null, empty or has no letter, and for every text if nothing could be learnt.
    Of languages equally near the first in sort order is taken, and the text is ambiguous.
    Columns of the same names are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*kept).withColumn("__text", F.lit("")).schema
    added = F.col("text").rlike(r"\p{L}")
    rows = docs.select(*kept, F.when(added, F.lower("text")).alias("__text"))
    out = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                known = part.column("__text").is_valid().to_numpy(zero_copy_only=False)
                n = part.num_rows
                lang, score, ambiguous = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                if model.languages and known.any():
                    best, score, ambiguous = model.decode(model.answers(*utf8(part.column("__text"))))
                    lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    score, ambiguous = np.where(known, score, 0.0), ambiguous & known
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in out), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous)],
                    [*out, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on documents that are not held out (and have text and lang), then predict every document."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
