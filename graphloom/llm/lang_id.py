"""Language identification by a string kernel.

A text's features are the distinct n-grams (n = 1, 2, 3) of its folded characters: the blended
spectrum with presence instead of counts. The kernel of two texts is the number of shared n-grams over
the root of the product of their numbers. A bounded sample gives landmarks (Nyström) and training texts
for one-versus-rest kernel ridge regression. The score of a text,

    k(x, landmarks) K^-1/2 beta,    k(x, landmarks) = presence(x) L' / sqrt(|x| |landmark|),

is linear in its presence vector, so L', K^-1/2 and beta are multiplied once and a batch of texts is
scored by one product of its presence matrix with that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, only, table

#: Folded characters: 0 for what isn't a letter, a-z, Latin-1 letters, and shared classes for all others.
CLASSES = 128
#: Codes of all n-grams.
CODES = CLASSES + CLASSES**2 + CLASSES**3
#: Texts scored by one matrix product.
ROWS = 64

UNKNOWN = "und"
#: Languages up to which their counts are broadcast.
FEW = 10_000


def _class_of(char: str) -> int:
    low = char.lower()[0]
    if not char.isalpha():
        return 0
    cp = ord(low)
    if "a" <= low <= "z":
        return 1 + cp - ord("a")
    if 0xDF <= cp <= 0xFF:
        return 27 + cp - 0xDF
    return 60 + (cp * 2654435761 >> 16) % (CLASSES - 60)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Classes of the basic plane; the others are looked up as they come."""
    return np.array([_class_of(chr(i)) for i in range(0x10000)], np.uint8)


class Spectrum:
    """Distinct n-gram codes of texts; keeps one array of marks for all of them."""

    def __init__(self) -> None:
        self.marks = np.zeros(CODES, np.int32)

    def codes(self, text: str) -> np.ndarray:
        """Empty if the text has no letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.zeros(0, np.int64)
        small = np.minimum(points, 0xFFFF)
        classes = _table()[small]
        for i in np.flatnonzero(points > 0xFFFF):
            classes[i] = _class_of(chr(points[i]))
        keep = classes != 0
        if not keep.any():
            return np.zeros(0, np.int64)
        keep[1:] |= classes[:-1] != 0  # runs of other characters count as one
        body = classes[keep]
        body = body[int(body[0] == 0) : len(body) - int(body[-1] == 0)]
        one = np.concatenate(([0], body, [0])).astype(np.int32)
        two = one[:-1] * CLASSES + one[1:]
        three = two[:-1] * CLASSES + one[2:]
        codes = np.concatenate((one, two + CLASSES, three + (CLASSES + CLASSES**2)))
        places = np.arange(len(codes), dtype=np.int32)
        self.marks[codes] = places  # the last of equal codes stays
        return codes[self.marks[codes] == places]


class Model:
    """Weights of the landmarks' n-grams for each language."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.weights = languages, vocabulary, weights

    @classmethod
    def fit(cls, samples: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model | None:
        """``samples``: language and codes; the first ``landmarks`` of each language are landmarks."""
        languages = sorted({lang for lang, _ in samples})
        if not languages:
            return None
        chosen = []
        for lang in languages:
            chosen += [codes for name, codes in samples if name == lang][:landmarks]
        vocabulary = np.unique(np.concatenate(chosen))
        marks = presence(chosen, vocabulary)
        marks /= np.sqrt([[len(c)] for c in chosen])
        kernel = (marks @ marks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        gram = np.zeros((root.shape[1],) * 2)
        right = np.zeros((root.shape[1], len(languages)))
        for i in range(0, len(samples), ROWS):
            part = samples[i : i + ROWS]
            x = presence([c for _, c in part], vocabulary) / np.sqrt([[len(c)] for _, c in part])
            z = (x @ marks.T).astype(np.float64) @ root
            y = np.array([[float(lang == name) for name in languages] for lang, _ in part])
            gram += z.T @ z
            right += z.T @ y
        beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
        return cls(languages, vocabulary, (marks.T @ (root @ beta)).astype(np.float32))

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return presence(sets, self.vocabulary) @ self.weights / np.sqrt([[max(1, len(s))] for s in sets])


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """One row for each set: 1 where it has the vocabulary's code."""
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, codes in zip(out, sets, strict=True):
        at = np.searchsorted(vocabulary, codes)
        at[at == len(vocabulary)] = 0
        row[at[vocabulary[at] == codes]] = 1
    return out


def train(labelled: DataFrame, per_language: int = 400, landmarks: int = 64, ridge: float = 0.05) -> Model | None:
    """Fit on at most ``per_language`` texts of each language, the first ``landmarks`` of them landmarks.

    ``labelled``: ``text, lang``. The sample is the distinct texts with the smallest hashes; it is drawn in
    two steps, so that no task orders all texts of a language. Copies count once. Texts without a letter are left out. Only
    the sample's n-gram codes reach the driver: at most ``per_language`` sets of each language.
    """
    texts = labelled.select("lang", "text").where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    sizes = texts.select("lang", "h").distinct().groupBy("lang").count()
    rate = F.least(F.lit(1.0), F.lit(3.0 * per_language + 60) / F.col("count"))
    unit = (F.col("h").bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    counted = sizes.limit(FEW + 1).collect()
    if len(counted) <= FEW:  # so many rows may be broadcast; more join by shuffle
        sizes = F.broadcast(sizes.sparkSession.createDataFrame(counted, sizes.schema))
    drawn = texts.join(sizes, "lang").where(unit < rate).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.col("h").bitwiseAND((1 << 30) - 1), "h", "text")
    picked = drawn.select("lang", "h", "text", F.row_number().over(order).alias("rank")).where(F.col("rank") <= per_language)

    def codes(batches: Iterator):
        import pyarrow as pa

        spectrum = Spectrum()
        for batch in batches:
            found = [spectrum.codes(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rank"), pa.array([c.tolist() for c in found], pa.list_(pa.int32()))],
                names=["lang", "rank", "codes"],
            )

    rows = picked.mapInArrow(codes, "lang string, rank int, codes array<int>").collect()
    rows.sort(key=lambda r: (r.lang, r.rank))
    return Model.fit([(r.lang, np.array(r.codes, np.int32)) for r in rows if r.codes], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A text that is null or has no letter, or any text without a model, gets ``und`` and 0. The score is
    the best language's regression value within 0 and 1; equal scores go to the first language by name.
    Rows stay one to one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        spectrum, m = _spectrum(), shared.value

        def run(c):
            pred, score = [UNKNOWN] * len(c["text"]), [0.0] * len(c["text"])
            if m is not None:
                for i in range(0, len(pred), ROWS):
                    sets = [spectrum.codes(t or "") for t in c["text"][i : i + ROWS]]
                    values = m.scores(sets)
                    best = values.argmax(axis=1)
                    for j, codes in enumerate(sets):
                        if len(codes):
                            pred[i + j] = m.languages[best[j]]
                            score[i + j] = float(min(1.0, max(0.0, values[j, best[j]])))
            return {"doc_id": c["doc_id"], "lang_pred": pred, "score": score}

        return run

    return arrow_map(only(docs, "doc_id", "text"), make, "doc_id bigint, lang_pred string, score double")


@lru_cache(maxsize=1)
def _spectrum() -> Spectrum:
    return Spectrum()


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """The documents whose language is one of ``languages``, any learned one if None, with a score of ``least`` or more.

    A text that is null or has no letter has no language and goes. A null ``lang`` becomes the language
    that was found; a label that stands stays, whatever was found, and so do all other columns. Without a
    labelled document nothing can be learned: then every text with a letter stays as it is.
    """
    known = only(docs, "doc_id", "text", "lang")
    model = train(known.where(~held_out() & F.col("doc_id").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    import pyarrow as pa

    def run(batches):
        spectrum, m = _spectrum(), shared.value
        for batch in batches:
            texts, found, keep = batch.column(batch.schema.get_field_index("text")).to_pylist(), [], []
            for i in range(0, len(texts), ROWS):
                sets = [spectrum.codes(t or "") for t in texts[i : i + ROWS]]
                if m is None:
                    found += [None] * len(sets)
                    keep += [len(s) > 0 for s in sets]
                    continue
                values = m.scores(sets)
                for s, row, j in zip(sets, values, values.argmax(axis=1), strict=True):
                    found.append(m.languages[j])
                    wanted = languages is None or m.languages[j] in languages
                    keep.append(len(s) > 0 and wanted and (least <= 0 or float(row[j]) >= least))
            at = batch.schema.get_field_index("lang")
            if at >= 0 and m is not None:
                old = batch.column(at).to_pylist()
                new = [o if o is not None else f for o, f in zip(old, found, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.mapInArrow(run, docs.schema)
