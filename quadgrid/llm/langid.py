"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every learning document. The classifier is trained by
follow-the-regularised-leader with per-coordinate steps and L1 and L2 penalties on a bounded,
stratified sample: of each language's distinct texts the `per_language` ones with the smallest
hashes, so every language is learnt, however often its texts repeat. A fifth of each language's
sample is set aside and fits one softmax temperature; languages with few texts show them more often
in training. Prediction reads each whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; without any
learning document all texts are `und`; a null doc_id counts as an empty id; repeated rows are
judged alike; other columns are kept as they are, but for those named like the two results,
which these replace. Rows of equal text count once in the sample, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, chunks, free_name, mix, table

BITS = 15
SIZE = 1 << BITS
PER_LANGUAGE, EPOCHS = 800, 4
#: A language's texts are ranked in so many parts, then what is left of them in fewer.
PARTS = (64, 8, 1)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNKNOWN = "und"
#: Texts whose best language has a lower score are rejected by `accepted`.
MIN_SCORE = 0.5
_LETTER = regex.compile(r"\p{L}")


def ngram_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character 2- and 3-grams of a text and how often each occurs."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    two = c[:-1] * np.uint64(0x1F35BD51) + c[1:]
    three = two[:-1] * np.uint64(0x27D4EB2F) + c[2:] + np.uint64(1 << 60)
    counts = np.zeros(SIZE, np.int64)
    for grams in (two, three):
        for at in range(0, len(grams), 1 << 20):
            counts += np.bincount((mix(grams[at : at + (1 << 20)]) >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # float32[SIZE]
    weights: np.ndarray  # float32[SIZE, languages]
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(*ngram_features(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or _LETTER.search(text) is None:
            return UNKNOWN, 0.0
        at, v = self.vector(text)
        p = softmax((v @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, v / norm if norm > 0 else v


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngram_features(text)[0]] += 1
                df[SIZE] += 1
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "df": pa.array(df[at])})

    counted = arrow_map(docs.select("text"), run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    out = np.zeros(SIZE + 1, np.int64)
    for row in counted.collect():  # at most SIZE + 1 sums
        out[row["feature"]] = row["df"]
    return out[:SIZE], int(out[SIZE])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net over vectors (features, values, class)."""
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    for _ in range(epochs):
        for at, v, y in rows:
            at, v = np.append(at, SIZE), np.append(v, 1.0)  # the last coordinate is the bias
            w = weights(z[at], n[at])
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(z, n)
    return w[:SIZE].astype(np.float32), w[SIZE].astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from 0.05 to 20.

    As in Platt's scaling, each target gives up 1 / (n + 2) to the other classes, so that a
    small set without errors doesn't make every score 1.
    """
    if not len(y):
        return 1.0

    n, k = logits.shape
    give = 1 / (n + 2) if k > 1 else 0.0
    target = np.full((n, k), give / max(1, k - 1))
    target[np.arange(n), y] = 1 - give

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        m = x.max(1, keepdims=True)
        return float(((m + np.log(np.exp(x - m).sum(1, keepdims=True)) - x) * target).sum(1).mean())

    lo, hi, phi = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def sampled(learn: DataFrame, per_language: int) -> DataFrame:
    """(lang, h, g, text): of each language's distinct texts the per_language ones with the smallest
    hashes, exactly. Only hashes are grouped and ranked; the texts of the chosen ones are read after that."""
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]
    distinct = learn.select("lang", *hashes).distinct()
    chosen = distinct
    for parts in PARTS:  # the best of each part of a language, then of these: no task ranks a whole language
        place = F.row_number().over(Window.partitionBy("lang", F.pmod("g", F.lit(parts))).orderBy("h", "g"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    keys = ["lang", "h", "g"]
    return learn.select("lang", *hashes, "text").join(F.broadcast(chosen), keys).groupBy(*keys).agg(F.first("text").alias("text"))


def vectors(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, h, g, features, vector): the TF-IDF vector of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tf_idf(*ngram_features(t), idf) for t in batch.column(3).to_pylist()]
            extra = [pa.array([x.astype(kind).tobytes() for x in col], pa.binary()) for col, kind in zip(zip(*found) if found else ((), ()), (np.int16, np.float32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *extra], names=["lang", "h", "g", "features", "vector"])

    return arrow_map(sample.select("lang", "h", "g", "text"), run, "lang string, h bigint, g bigint, features binary, vector binary")


def train(learn: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """learn: rows (doc_id, text, lang) without null texts or languages."""
    languages = sorted(r["lang"] for r in learn.select("lang").distinct().collect())  # a row for each language
    df, n_docs = document_frequencies(learn)
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    if not languages:
        return Model([], idf, np.zeros((SIZE, 0), np.float32), np.zeros(0, np.float32), 1.0)
    number = {k: i for i, k in enumerate(languages)}
    rows = vectors(sampled(learn, per_language), idf)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "h", "g"], kind="stable")
        own, aside = {k: [] for k in languages}, []
        for lang, at, v in zip(pdf["lang"], pdf["features"], pdf["vector"]):
            row = (np.frombuffer(at, np.int16).astype(np.int64), np.frombuffer(v, np.float32), number[lang])
            own[lang].append(row)
        for lang, mine in own.items():  # a fifth of each language; of fewer than five texts none
            aside += mine[4::5]
            own[lang] = [r for i, r in enumerate(mine) if i % 5 != 4]
        # Languages with few texts show them as often as the largest one shows its own.
        most = max(map(len, own.values()))
        shown = [mine[i % len(mine)] for mine in own.values() for i in range(most)]
        shown = [shown[i] for i in np.random.default_rng(0).permutation(len(shown))]
        weights, bias = ftrl(shown, len(languages), epochs)
        logits = np.array([v @ weights[at] + bias for at, v, _ in aside]).reshape(len(aside), len(languages))
        t = fit_temperature(logits, np.array([y for *_, y in aside], np.int64))
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias.tobytes()], "temperature": [t]})

    # The sample is bounded: per_language vectors of at most SIZE features for each language.
    row = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights binary, bias binary, temperature double").first()
    weights = np.frombuffer(row["weights"], np.float32).reshape(SIZE, len(languages))
    return Model(languages, idf, weights, np.frombuffer(row["bias"], np.float32), row["temperature"])


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns: the predicted language and its score."""
    spark, docs = docs.sparkSession, docs.drop(*names)
    held = spark.sparkContext.broadcast(model)  # SIZE x languages floats
    at_text = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in chunks(batch):
                found = [m.predict(t) for t in piece.column(at_text).to_pylist()]
                extra = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *extra], names=[*piece.schema.names, *names])

    return arrow_map(docs, run, schema + f", `{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def identify(docs: DataFrame) -> DataFrame:
    """docs with lang_pred and score, by a model of its own learning rows."""
    return predict(docs, train(learning_rows(docs)))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is sure enough: texts without a letter go, and those whose
    language has a calibrated score below min_score. Where nothing can be learnt, texts with a letter stay."""
    model = train(learning_rows(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = (free_name(docs, "_language"), free_name(docs, "_language_score"))
    found = predict(docs, model, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score)).drop(*names)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(learning_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
SQL: dict[str, str] = {}
