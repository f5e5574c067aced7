"""Language ID by the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tripleweave.llm.common import typed

#: Hashed n-grams of 1 to 3 letters, with a blank for any run of other characters.
DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Labelled rows per language, in expectation, that the centroids are fitted on; document frequencies are counted over all.
SAMPLE_ROWS = 600
ROUNDS = 12
#: A text is rejected if it is farther from its centroid than this share of the labelled rows of its length that were not
#: fitted are from theirs. Lengths are counted in letters, in powers of two; distances in steps of 1 / STEPS.
QUANTILE = 0.999
LENGTHS = 16
STEPS = 256
#: Rows it takes for a quantile of one length; with fewer, more rows are taken together (see ``reaches``), and of all
#: lengths together LEAST_IN_ALL do, whose farthest one then counts.
LEAST_ROWS = 1000
LEAST_IN_ALL = 100
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _tables:
        size = sys.maxunicode + 1
        _tables.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(size)), bool, size))
    return _tables[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, int] | None:
    """Counts of the text's hashed n-grams and its length class, the number of letters as a power of two; None without a
    letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter | np.append(True, letter[:-1])  # of a run of others the first stays, as a blank
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    out = np.bincount(c * np.uint32(2654435761) >> np.uint32(19), minlength=DIMENSIONS)
    two = c[:-1] * np.uint32(2246822519) ^ c[1:] * np.uint32(3266489917)
    out += np.bincount((two * np.uint32(668265263)) >> np.uint32(19), minlength=DIMENSIONS)
    three = two[:-1] * np.uint32(374761393) + c[2:] * np.uint32(2654435761)
    out += np.bincount((three ^ three >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(19), minlength=DIMENSIONS)
    return out, min(LENGTHS - 1, int(letter.sum()).bit_length())


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The unit TF-IDF vector, term frequencies damped by their logarithm."""
    vector = np.log1p(counts) * idf
    return (vector / max(np.linalg.norm(vector), 1e-300)).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    of_lang: np.ndarray
    #: per centroid and length, the largest distance that is accepted
    reach: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid (0 to 1), and whether the distance is beyond that one's reach."""
        found = gram_counts(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0, True
        counts, length = found
        cosines = self.centroids @ weighted(counts, self.idf)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[self.of_lang[best]], score, 1.0 - score > self.reach[best, length]


def reaches(rows: np.ndarray, of_lang: np.ndarray) -> np.ndarray:
    """Accepted distances per centroid and length, from counts of rows by centroid, length and step of distance.

    The first of these with enough rows decides: the centroid's rows of that length, its language's, its language's of
    that length and shorter ones (which are farther off), its language's in all, and all languages' in all.
    """

    def limit(counts: np.ndarray, least: int) -> float | None:
        total = counts.sum()
        if total < least:
            return None
        return (int(np.searchsorted(counts.cumsum(), QUANTILE * total)) + 1) / STEPS

    out = np.ones(rows.shape[:2])
    for c in range(len(rows)):
        own = rows[of_lang == of_lang[c]].sum(axis=0)
        whole = [limit(own.sum(axis=0), LEAST_IN_ALL), limit(rows.sum(axis=(0, 1)), LEAST_IN_ALL)]
        for n in range(LENGTHS):
            limits = [limit(rows[c, n], LEAST_ROWS), limit(own[n], LEAST_ROWS), limit(own[: n + 1].sum(axis=0), LEAST_ROWS), *whole]
            out[c, n] = next((x for x in limits if x is not None), 1.0)
    return out


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows. It starts from rows far apart among the denser half, those nearer to the mean of all,
    so that outliers don't become centroids; it needs no chance."""
    middle = rows @ rows.mean(axis=0)
    dense = rows[middle >= np.median(middle)]
    chosen = [int((dense @ rows.mean(axis=0)).argmax())]
    near = dense @ dense[chosen[0]]
    while len(chosen) < min(k, len(dense)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, dense @ dense[chosen[-1]])
    centroids = dense[chosen]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-30), centroids)
    return centroids


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from ``text`` and non-null ``lang`` of rows with a doc_id that aren't held out.

    Document frequencies are counted over all of them in Spark. Centroids are fitted on the driver, on about
    ``sample_rows`` rows of each language (chosen by a hash of doc_id, half of them at most), held as sparse counts of at
    most DIMENSIONS numbers each; that bound doesn't depend on the size of the corpus. How far a text may be from its
    centroid is learnt from all other labelled rows: Spark counts them by centroid, length and distance. ``lang`` values
    are languages: their number is taken to be bounded, the model has centroids for each.
    """
    labelled = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())

    def frequencies(batches):
        total = np.zeros(DIMENSIONS + 1, np.int64)  # the last counts the documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = gram_counts(text)
                if found is not None:
                    total[:-1] += found[0] > 0
                    total[-1] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["gram", "docs"])

    rows = labelled.select("text").mapInArrow(frequencies, "gram int, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs"))
    found = rows.collect()  # at most DIMENSIONS + 1 rows
    total = np.zeros(DIMENSIONS + 1)
    for row in found:
        total[row["gram"]] = row["docs"]
    idf = np.log((1 + total[-1]) / (1 + total[:-1])) + 1

    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(0.5, sample_rows / sizes[lang]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    schema, arrow = typed("lang string, grams array<int>, counts array<int>")

    def sparse(batches):
        for batch in batches:
            named, grams, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = gram_counts(text)
                if found is not None:
                    at = np.flatnonzero(found[0])
                    named.append(lang), grams.append(at), counts.append(found[0][at])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((named, grams, counts), arrow)], schema=arrow)

    sample = labelled.filter(place < shares[F.col("lang")]).select("lang", "text").mapInArrow(sparse, schema).collect()
    vectors: dict[str, list[np.ndarray]] = {}
    for row in sample:
        counts = np.zeros(DIMENSIONS)
        counts[row["grams"]] = row["counts"]
        vectors.setdefault(row["lang"], []).append(weighted(counts, idf))
    if not vectors:  # so few rows that none was chosen: there is nothing to learn from
        return LanguageModel((), idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))
    langs = tuple(lang for lang in langs if lang in vectors)
    parts = [spherical_kmeans(np.stack(sorted(vectors[lang], key=lambda v: v.tobytes())), CENTROIDS) for lang in langs]
    of_lang = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    model = LanguageModel(langs, idf, np.concatenate(parts), of_lang, np.ones((len(of_lang), LENGTHS)))
    return replace(model, reach=reaches(_distances(labelled.filter(~(place < shares[F.col("lang")])), model), of_lang))


def _distances(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """How many of the labelled rows are nearest to each centroid of their language, by length and step of distance."""
    number = {lang: k for k, lang in enumerate(model.langs)}

    def count(batches):
        total = np.zeros((len(model.of_lang), LENGTHS, STEPS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = gram_counts(text)
                if found is not None and lang in number:
                    counts, length = found
                    own = np.flatnonzero(model.of_lang == number[lang])
                    cosines = model.centroids[own] @ weighted(counts, model.idf)
                    best = int(cosines.argmax())
                    step = int(min(STEPS - 1, max(0.0, 1.0 - float(cosines[best])) * STEPS))
                    total[own[best], length, step] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total.ravel()[found])], names=["at", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros((len(model.of_lang), LENGTHS, STEPS), np.int64)
    for r in counted.collect():  # no more rows than the model has cells
        out.ravel()[r["at"]] = r["n"]
    return out


def classify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    Whole texts count, and nothing but the text. Null text and text without a letter is ``und`` with score 0 and
    rejected, and so is everything if there was nothing to learn from.
    """
    plain = docs.drop("lang_pred", "score", "rejected")
    names = plain.columns
    at = names.index("text")
    schema = StructType(
        [*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    )

    def predict(batches):
        for batch in batches:
            found = [model.predict(text) for text in batch.column(at).to_pylist()]
            langs, scores, far = zip(*found) if found else ((), (), ())
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([bool(f) for f in far], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score", "rejected"])

    return plain.mapInArrow(predict, schema)
