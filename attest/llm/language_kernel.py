"""Language identification with a blended-spectrum string kernel, Nystroem landmarks and kernel ridge regression.

A text's spectrum is the set of its byte sequences of one to LONGEST bytes, A-Z lower-cased.
The kernel of two texts is the number of sequences both have over the root of the product of
their numbers. Landmarks are some texts of each language; every text is represented by its
kernel values with them. Ridge regression (one target per language, one against the rest) is solved
in that space: (K'K + ridge * Kzz) beta = K'Y. Since a text's score is the sum of beta * kernel over the
landmarks, and the kernel's numerator is linear in the text's presence vector, landmark
spectra and beta are multiplied out once; a batch of texts is then one matrix product of
presence vectors (over all sequences of the landmarks) and that matrix.

Samples. Languages are learned from about MAX_FIT texts: of each language MAX_FIT / languages
distinct ones, those with the smallest hashes of their text, and LANDMARKS / languages of
these (at least one, of at most LANDMARK_BYTES bytes) are landmarks. All rows are scored on their whole texts. The driver holds
MAX_FIT x LANDMARKS kernel values (10 MB) and one row per language; tasks get the landmark
sequences with one weight per language.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
everything where nothing was learned; equal scores go to the language that sorts first;
a null key counts as the empty text in the split; repeated rows count once in learning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import LOWER_BYTES, kept, only, tidy, utf8
from attest.session import settle

LONGEST = 3
MAX_FIT, LANDMARKS, LANDMARK_BYTES = 20_000, 128, 1 << 16
RIDGE = 0.1
FOLDS, HELD = 4, 2
UNKNOWN = "und"
_TEXTS = 64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_STARTS = [sum(256 ** k for k in range(1, n)) for n in range(1, LONGEST + 2)]  # codes of n bytes begin here


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


class Spectra:
    """Distinct sequences of texts; the scratch table has one number per possible sequence (67 MB)."""

    def __init__(self):
        self.last = np.zeros(_STARTS[-1], np.int32)

    def of(self, text: bytes) -> np.ndarray:
        """Codes of the sequences in a text, each once."""
        b = np.frombuffer(text.translate(LOWER_BYTES), np.uint8).astype(np.int32)
        found, code = [], np.zeros(len(b) + 1, np.int32)
        for n in range(1, LONGEST + 1):
            if len(b) < n:
                break
            code = code[:-1] << 8 | b[n - 1:]
            found.append(code + _STARTS[n - 1])
        codes = np.concatenate(found) if found else np.zeros(0, np.int32)
        place = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = place  # the last of equal ones stays
        return codes[self.last[codes] == place]


@dataclass
class Columns:
    """Presence vectors over a sorted list of codes."""

    codes: np.ndarray

    def __post_init__(self):
        self.spectra = Spectra()
        self.at = np.full(_STARTS[-1], -1, np.int32)
        self.at[self.codes] = np.arange(len(self.codes))

    def presence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One row of zeros and ones per text, and the sizes of the whole spectra."""
        rows = np.zeros((len(texts), len(self.codes)), np.float32)
        size = np.zeros(len(texts))
        for i, t in enumerate(texts):
            codes = self.spectra.of(t)
            size[i] = len(codes)
            where = self.at[codes]
            rows[i, where[where >= 0]] = 1
        return rows, size


@dataclass
class Model:
    """``weights`` has a row per code and a column per language."""

    codes: np.ndarray
    weights: np.ndarray
    languages: list[str]


def kernel(rows: np.ndarray, size: np.ndarray, landmarks: np.ndarray, landmark_size: np.ndarray) -> np.ndarray:
    """Normalised numbers of shared sequences; 0 for an empty text."""
    return (rows @ landmarks) / np.sqrt(np.outer(np.maximum(size, 1), landmark_size))


def solve(k: np.ndarray, language: np.ndarray, kzz: np.ndarray, languages: int, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of the landmarks for each language."""
    target = (language[:, None] == np.arange(languages)).astype(float)
    left = k.T @ k + ridge * kzz + 1e-6 * np.eye(len(kzz))
    return np.linalg.solve(left, k.T @ target)


def _held(key: str) -> Column:
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD


def _sample(rows: DataFrame, max_fit: int) -> tuple[list[str], DataFrame]:
    """Languages in order, and (language, mark, text) of the texts to learn from."""
    known = rows.where(~F.col("held") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    mark = F.xxhash64("text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    quota = max(1, max_fit // max(1, len(languages)))
    share = [(x, i, min(1.0, quota / max(1, sizes[x]))) for i, x in enumerate(languages)]
    # One row per language.
    shares = F.broadcast(rows.sparkSession.createDataFrame(share, "lang string, language int, share double"))
    low = F.pmod(mark, F.lit(1 << 53)) < F.col("share") * float(1 << 53)
    taken = known.join(shares, "lang").withColumn("mark", mark).where(low | (F.col("share") >= 1))
    return languages, settle(taken.groupBy("language", "mark").agg(F.max("text").alias("text")))


def _spectra_of(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra = Spectra()
        for batch in batches:
            found = [spectra.of(t).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["codes"])

    return texts.select("text").mapInArrow(tidy(run), "codes binary")


def fit(rows: DataFrame, max_fit: int = MAX_FIT, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of rows(text, lang, held); None where there is nothing to learn from."""
    languages, sample = _sample(rows, max_fit)
    if not languages:
        return None
    place = F.row_number().over(Window.partitionBy("language").orderBy("mark"))
    short = sample.where((F.octet_length("text") <= LANDMARK_BYTES) & F.col("text").rlike(r"\p{L}"))
    chosen = short.withColumn("place", place).where(F.col("place") <= max(1, landmarks // len(languages))).orderBy("language", "mark")
    sets = [np.frombuffer(v.as_py(), np.int32) for v in _spectra_of(chosen).toArrow().column("codes")]
    if not sets:
        return None
    codes = np.unique(np.concatenate(sets))
    landmark_size = np.array([len(s) for s in sets], float)
    shared = sample.sparkSession.sparkContext.broadcast((codes, [np.searchsorted(codes, s).astype(np.int32) for s in sets]))

    def matrix(sets: list[np.ndarray], width: int) -> np.ndarray:
        out = np.zeros((width, len(sets)), np.float32)
        for i, s in enumerate(sets):
            out[s, i] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, z = Columns(shared.value[0]), matrix(shared.value[1], len(shared.value[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                texts = list(utf8(part.column("text")))
                good = [i for i, t in enumerate(texts) if has_letter(t)]
                rows, size = columns.presence([texts[i] for i in good])
                k = kernel(rows, size, z, landmark_size).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("language").take(pa.array(good, pa.int32())),
                                                  pa.array([r.tobytes() for r in k], pa.binary())], names=["language", "k"])

    # At most about MAX_FIT rows of LANDMARKS numbers.
    found = sample.select("language", "text").mapInArrow(tidy(run), "language int, k binary").toArrow()
    k = np.frombuffer(b"".join(v.as_py() for v in found.column("k")), np.float32).reshape(-1, len(sets)).astype(float)
    z = matrix(shared.value[1], len(codes))
    kzz = (z.T @ z) / np.sqrt(np.outer(landmark_size, landmark_size))
    beta = solve(k, found.column("language").to_numpy(), kzz, len(languages), ridge)
    return Model(codes, (z @ (beta / np.sqrt(landmark_size)[:, None])).astype(np.float32), languages)


def apply(rows: DataFrame, model: Model | None) -> DataFrame:
    """The other columns of rows(..., text) with lang_pred and score."""
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    # Codes of LANDMARKS texts, each with one weight per language.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        columns = kept(("language_kernel", hash(model.weights.tobytes())), lambda: Columns(model.codes)) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                language, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                texts = list(utf8(part.column("text")))
                good = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                if good:
                    rows, size = columns.presence([texts[i] for i in good])
                    found = (rows @ model.weights) / np.sqrt(size)[:, None]
                    for i, best, row in zip(good, found.argmax(1), found):
                        language[i], score[i] = model.languages[best], row[best]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(language, pa.string()), pa.array(np.clip(score, 0, 1))],
                                                 names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(tidy(run, keeps=True), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_fit: int = MAX_FIT,
             landmarks: int = LANDMARKS, ridge: float = RIDGE) -> DataFrame:
    """One row per document: (key, held_out, lang_pred, score); learned from the rows that are not held out."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), _held(key).alias("held"))
    model = fit(rows, max_fit, landmarks, ridge)
    asked = docs.select(F.col(f"`{key}`").alias("key"), _held(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return apply(asked, model).withColumnRenamed("key", key)
