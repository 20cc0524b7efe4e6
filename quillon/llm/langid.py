"""Operator 1: language identification.

Multinomial naive Bayes over hashed character n-grams (one to three letters).
The log-probability matrix, buckets x languages, is broadcast; its size is
bounded by ``MAX_CELLS``. A batch of texts is scored as sparse rows: the
positions of its n-grams select matrix rows, which are summed document by
document, as many languages at a time as ``LOOKED_UP`` allows.

Training takes at most about ``rows_per_language`` rows of each language,
drawn by a hash of the key (documented bound; the draw is the same at every
run). Prediction reads the text only. More than ``MAX_LANGUAGES`` values of the
label are refused, as the matrix would not fit; beyond 512 the n-grams share
fewer buckets.

Null text, or text without a letter: ``und`` with score 0. Repeated rows get
equal results. Without any labelled row every document is ``und``. Very long
texts are scored in slices whose sums are added. Ties go to the first language
by name.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import CHARS_AT_ONCE, append, fresh, groups_by_size, hash_part, small_batches, with_columns

UNKNOWN = "und"
#: Bound of the matrix that is broadcast: 64 MB of 4-byte numbers.
MAX_CELLS = 16 << 20
#: Matrix entries that are looked up at once: 16 MB, whatever the number of languages.
LOOKED_UP = 4 << 20
MAX_LANGUAGES = 4_096
ORDERS = 3
SPACE, BREAK = 32, 0


@cache
def _folded() -> np.ndarray:
    """For each code point: the lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(unicodedata.normalize("NFC", c.lower())[0])
    table[0x110000 - 1] = BREAK  # not a character: stands between texts
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, a break after each, and where each begins."""
    joined = np.frombuffer("\U0010ffff".join(t.replace("\U0010ffff", " ") for t in texts).encode("utf-32-le") + b"\xff\xff\x10\x00", np.uint32)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return _folded()[joined], starts


def _grams(codes: np.ndarray, buckets: int):
    """For each order the bucket at each position, ``buckets`` where no n-gram begins.

    An n-gram has a letter, spans no break, and no two spaces.
    """
    n = len(codes)
    space, stop = codes == SPACE, codes == BREAK
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    letter = np.zeros(n, bool)
    for order in range(1, ORDERS + 1):
        k = order - 1
        m = n - k
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[k:].astype(np.uint64) + np.uint64(order)
        bad = bad[:m] | stop[k:]
        if k:
            bad |= space[k - 1 : n - 1] & space[k:]
        letter = letter[:m] | ~(space[k:] | stop[k:])
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = (mixed >> np.uint64(33)).astype(np.int64) & (buckets - 1)
        at[bad | ~letter] = buckets
        yield at


@dataclass
class Model:
    languages: list[str]
    buckets: int
    prior: np.ndarray
    matrix: np.ndarray  # (buckets + 1) x languages; the last row is zero

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most likely language of each text and its posterior probability."""
        texts = [t or "" for t in texts]
        total = np.zeros((len(texts), max(1, len(self.languages))))
        letters = np.zeros(len(texts), bool)
        for part in groups_by_size([len(t) for t in texts]):
            if part.stop - part.start == 1 and len(texts[part.start]) > CHARS_AT_ONCE:
                text = texts[part.start]
                for at in range(0, len(text), CHARS_AT_ONCE):  # slices overlap so that each n-gram begins in one of them
                    end = min(at + CHARS_AT_ONCE, len(text))
                    self._add([text[at : end + ORDERS - 1]], total[part], letters[part], end - at)
            else:
                self._add(texts[part], total[part], letters[part], None)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total += self.prior
        best = total.argmax(axis=1)
        odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, odds, 0.0)

    def _add(self, texts: list[str], total: np.ndarray, letters: np.ndarray, most: int | None) -> None:
        codes, starts = _codes(texts)
        letters |= np.logical_or.reduceat((codes != SPACE) & (codes != BREAK), starts)
        if not self.languages:
            return
        for at in _grams(codes, self.buckets):
            if most is not None:
                at = at[:most]
            here = starts < len(at)  # the last texts may be shorter than the n-gram
            if here.any():
                some = max(1, LOOKED_UP // len(at))  # languages at a time
                for k in range(0, len(self.languages), some):
                    total[here, k : k + some] += np.add.reduceat(self.matrix[:, k : k + some][at], starts[here], axis=0, dtype=np.float64)


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 2_000, buckets: int = 1 << 15, alpha: float = 0.5) -> Model:
    """Learn from the rows where ``learn`` holds and ``lang`` and ``text`` are not null."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix would not fit {MAX_CELLS} cells")
    counts = {r["lang"]: r["n"] for r in found}
    languages = sorted(counts)
    if not languages:
        return Model([], buckets, np.zeros(1), np.zeros((buckets + 1, 1), np.float32))
    while buckets * len(languages) > MAX_CELLS:
        buckets //= 2
    parts = 1 << 40
    taken = F.create_map(*(F.lit(x) for k in languages for x in (k, -(-parts * rows_per_language // max(counts[k], rows_per_language)))))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, i)))
    drawn = rows.where(hash_part(F.col(key), F.lit("language"), parts=parts) < taken[F.col(lang)]).select(number[F.col(lang)].alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for own in set(langs):
                into = sums.setdefault(own, np.zeros(buckets + 1, np.int64))
                mine = [t for t, k in zip(texts, langs, strict=True) if k == own]
                for part in groups_by_size([len(t) for t in mine]):
                    for at in _grams(_codes(mine[part])[0], buckets):
                        into += np.bincount(at, minlength=buckets + 1)
        for own, into in sums.items():
            there = np.flatnonzero(into[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), own), pa.int32()), pa.array(there, pa.int32()), pa.array(into[there], pa.int64())], names=["lang", "bucket", "n"])

    # At most MAX_CELLS rows of three numbers, whatever the corpus.
    found = drawn.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((buckets, len(languages)), alpha)
    np.add.at(table, (found["bucket"].to_numpy(), found["lang"].to_numpy()), found["n"].to_numpy())
    matrix = np.zeros((buckets + 1, len(languages)), np.float32)
    matrix[:buckets] = np.log(table / table.sum(axis=0))
    prior = np.log(np.array([counts[k] for k in languages], float) / sum(counts.values()))
    return Model(languages, buckets, prior, matrix)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, then the language and its score; columns of these names give way."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = sent.value.score(batch.column(text).to_pylist())
            yield append(batch, {lang: pa.array(langs, pa.string()), score: pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, with_columns(docs.schema, **{lang: T.StringType(), score: T.DoubleType()}))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = predict(docs, model, text, lang, score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(key: str = "doc_id") -> Column:
    """The rows that training must not see; a null key counts as not held out, and is not learned from either."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
