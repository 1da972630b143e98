"""Language identification by rank-order n-gram profiles.

A profile is a text's (or a language's) letter 1- to 3-grams in descending order of count. A document
is compared with each language's profile by the out-of-place distance: for each n-gram of the
document's profile the difference of its two ranks, or the profile size where the language lacks it.

Cases: a null text, an empty text and a text without a letter give `und` with score 0. With no learned
language every text gives `und`. Equal counts rank by n-gram code, equal distances go to the language
that sorts first. Repeated rows are predicted alike, once for each row. Rows with a null key take part
as any other; their fold is null, so they are neither held out nor learned from. Extra columns of the
input are ignored (`predict`) or carried untouched (`keep_known`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

#: N-grams in a profile.
PROFILE_SIZE = 400
#: Learning rows for each language: expected size of the hash-chosen sample (the documented bound).
ROWS_PER_LANGUAGE = 1500
#: Rows of one language's sample are counted whole; this many characters are worked on at a time.
PIECE = 1 << 19
UNKNOWN = "und"
FOLDS, HELD_FOLD = 4, 2

_WORD, _NO_LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def letter_codes(text: str) -> Iterator[np.ndarray]:
    """Code points of the text's letters, lower case, words parted and enclosed by one space; in pieces that end where no
    letter follows."""
    at = 0
    while at < len(text):
        end = _NO_LETTER.search(text, at + PIECE)
        start, at = at, end.start() if end else len(text)
        words = _WORD.findall(text[start:at].lower())
        if words and any(map(str.isalpha, "".join(words))):
            yield np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the text's 1- to 3-grams (21 bits a letter) with their counts."""
    values, counts, last = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for letters in letter_codes(text):
        pairs = (letters[:-1] << np.uint64(21)) | letters[1:]
        grams = np.concatenate((letters[letters != 32], pairs, (pairs[:-1] << np.uint64(21)) | letters[2:]))
        if last is not None:  # from the word before this piece to its first
            grams = np.append(grams, (last << np.uint64(42)) | (np.uint64(32) << np.uint64(21)) | letters[1])
        last = letters[-2]
        v, c = np.unique(grams, return_counts=True)
        if len(values):
            values, inverse = np.unique(np.concatenate((values, v)), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, c))).astype(np.int64)
        else:
            values, counts = v, c
    return values, counts


def ranked(values: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The `size` most frequent codes, most frequent first, ties by code."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        top = counts >= least
        values, counts = values[top], counts[top]
    return values[np.lexsort((values, -counts))][:size]


class Profiles:
    """The languages' profiles as one sorted table of codes with a rank in each language."""

    def __init__(self, by_language: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.size = size
        self.languages = sorted(by_language)
        self.codes = np.unique(np.array([c for k in self.languages for c in by_language[k]], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)  # the last column: in no profile
        for i, k in enumerate(self.languages):
            at = np.searchsorted(self.codes, np.array(by_language[k], np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - distance / greatest distance."""
        own = ranked(*count_ngrams(text), self.size) if text and self.languages else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def fit(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of the languages of the labelled rows given.

    Learns from about `rows_per_language` rows of each language, chosen by the hash of the key, or
    all of them where there are fewer; the n-grams are counted and summed by Spark, and `size`
    n-grams of each language come to the driver.
    """
    rows = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    wanted = rows.groupBy("l").count().select("l", (F.lit(float(rows_per_language)) / F.col("count")).alias("share"))
    uniform = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(wanted), "l").where(uniform < F.col("share")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(language, []).append(count_ngrams(value))
            for language, found in totals.items():
                values, inverse = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], names=["l", "gram", "n"])

    counted = chosen.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    best = _top_by_window(counted, size)
    return Profiles({r["l"]: list(r["grams"]) for r in best.collect()}, size)




def _top_by_window(counted: DataFrame, size: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l").orderBy(F.desc("n"), F.asc("gram"))
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return top.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))


def with_prediction(documents: DataFrame, profiles: Profiles, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`documents` with the predicted language and its score appended."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["lang", "score"])

    (found,) = common.spare_names(documents, "found")
    return documents.withColumn(found, predict(F.col(text))).withColumn(lang_pred, F.col(f"{found}.lang")).withColumn(score, F.col(f"{found}.score")).drop(found)


def learning_rows(documents: DataFrame) -> DataFrame:
    """The rows that the fold leaves for learning."""
    return documents.where(common.remainder("doc_id", FOLDS) != HELD_FOLD)


def predict_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rows not held out."""
    profiles = fit(learning_rows(documents))
    rows = documents.select("doc_id", "text")
    return with_prediction(rows, profiles).select("doc_id", (common.remainder("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least_score: float = 0.02) -> DataFrame:
    """The documents, columns unchanged, whose text is in a learned language: those predicted
    `und`, or so far from every profile that the score is under `least_score`, go."""
    columns = documents.columns
    profiles = fit(learning_rows(documents))
    lang, score = common.spare_names(documents, "lang_pred", "score")
    found = with_prediction(documents, profiles, lang_pred=lang, score=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_documents(common.table(spark, sf_dir, "documents"))
