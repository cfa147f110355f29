"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text, lower-cased, is the average of the embeddings of its hashed byte n-grams (lengths 2 to 4; only those with at least
one letter in them), and a linear layer with a softmax on top names the language. Embeddings and layer are trained in numpy
by stochastic gradient descent on a bounded, documented sample of labelled rows; a temperature fitted on rows set apart
calibrates the score, and a score under ``reject_below`` (fitted as well) marks the answer as rejected. For prediction the
embedding table and the layer are multiplied once into a bucket-by-language table, which every task gets; its size is
fixed by the parameters.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without any labelled row every
answer is ``und``; rows without a language are never learned from; of equal scores the first language from A to Z wins; repeated rows
each get a row; a null id is carried; a very long text is scored whole, in one task; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, table

BUCKETS, WIDTH, SIZES = 1 << 16, 16, (2, 3, 4)
#: Rows per language that the training sample aims at, fewer where there are so many languages that all of them would pass MOST_ROWS, but
#: LEAST at least.
SAMPLE, MOST_ROWS, LEAST = 400, 200_000, 20
#: So many languages have a table of rates that is broadcast, a row for each.
FEW_LANGUAGES = 20_000
#: Passes over the sample, more of them where a small one gives fewer than STEPS updates.
EPOCHS, STEPS, BATCH, RATE, SEED = 12, 800, 32, 0.5, 7
#: Of the sampled rows, those whose hash has this remainder modulo 5 set the temperature and the threshold.
CALIBRATION, CALIBRATION_OF = 0, 5
#: Share of right calibration answers that the threshold may reject.
REJECTED_RIGHT = 0.005
WORD_SIGN = re.compile(r"[^\W\d_]+")
#: Bytes that are no letters: ASCII but A-Z and a-z.
_PLAIN = np.array([not (chr(b).isalpha() or b >= 128) for b in range(256)])


def has_letter(text: str) -> bool:
    """Signs like ½ and ② count as word signs for ``re``, but are no letters."""
    return any(any(map(str.isalpha, found.group())) for found in WORD_SIGN.finditer(text))


def features(text: str) -> np.ndarray:
    """Bucket of every n-gram of the text, repeats included."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    plain = _PLAIN[raw]
    b = np.where(plain, 32, raw).astype(np.uint32)  # digits, marks and white space are one sign
    keep = ~plain
    h, has, out = b * np.uint32(2654435761), keep, []
    for size in range(2, max(SIZES) + 1):
        h = (h[:-1] ^ b[size - 1 :] * np.uint32(size * 2 + 1)) * np.uint32(2654435761)
        has = has[:-1] | keep[size - 1 :]
        if size in SIZES:
            out.append((h >> np.uint32(16))[has])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def averages(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as its distinct buckets and their shares."""
    made = []
    for text in texts:
        n = np.bincount(features(text), minlength=BUCKETS)
        at = np.flatnonzero(n)
        made.append((at, (n[at] / max(1, n.sum())).astype(np.float32)))
    return made


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages: embeddings times layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, text: str) -> np.ndarray:
        f = features(text)
        if len(f) > BUCKETS // 8:
            n = np.bincount(f, minlength=BUCKETS)
            at = np.flatnonzero(n)
            z = n[at].astype(np.float32) @ self.logits[at]
        else:
            z = self.logits[f].sum(axis=0)
        z = (z / max(1, len(f)) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def train(texts: list[str], labels: list[str], calibrate: list[bool], seed: int = SEED) -> Model | None:
    return learn(averages(texts), labels, calibrate, seed)


def learn(x: list[tuple[np.ndarray, np.ndarray]], labels: list[str], calibrate: list[bool], seed: int = SEED) -> Model | None:
    """The model of texts that are given as :func:`averages` gives them."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = {v: i for i, v in enumerate(languages)}
    y = np.array([code[v] for v in labels])
    rng = np.random.default_rng(seed)
    held = np.array(calibrate, bool)
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(languages)), np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(learn)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            hidden = np.stack([x[i][1] @ embed[x[i][0]] for i in at])
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            back = p @ layer.T
            layer -= rate * hidden.T @ p / len(at)
            bias -= rate * p.mean(axis=0)
            for row, i in enumerate(at):
                # shares are small, so that steps are scaled up for the buckets to move at all
                embed[x[i][0]] -= (rate * 100 / len(at)) * np.outer(x[i][1], back[row])
    logits = embed @ layer
    rest = np.flatnonzero(held) if held.any() else learn
    z = np.stack([x[i][1] @ logits[x[i][0]] for i in rest]) + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(rest)), y[rest]]).mean())

    temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    s = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    s /= s.sum(axis=1, keepdims=True)
    right = s.max(axis=1)[s.argmax(axis=1) == y[rest]]
    reject = float(np.quantile(right, REJECTED_RIGHT)) if len(right) else 0.0
    return Model(languages, logits, bias, temperature, min(reject, 0.9))


def training_sample(labelled: DataFrame, key: Column) -> DataFrame:
    """About SAMPLE rows of each language (see MOST_ROWS), chosen by the hash of ``key`` at a rate from the counts of all rows; twice the aim at
    most over all, so that what the driver gets is bounded. No language is left out."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    aim = max(LEAST, min(SAMPLE, MOST_ROWS // max(1, languages)))
    rates = counts.select(F.col("lang").alias("of_lang"), (F.lit(float(aim)) / F.col("n")).alias("rate"))
    if languages <= FEW_LANGUAGES:
        rates = F.broadcast(rates)  # the texts stay where they are
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = labelled.join(rates, F.col("lang") == F.col("of_lang")).where(draw < F.col("rate")).drop("of_lang", "rate")
    return drawn.limit(2 * aim * languages)


def fit(labelled: DataFrame) -> Model | None:
    """``labelled`` has ``key, lang, text``. The sampled texts are averaged whole where they lie; what comes to the driver, in the order of the rows'
    hashes, is at most a share for each bucket and row."""

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keep = [k for k, x in enumerate(texts) if x and has_letter(x)]
            made = averages([texts[k] for k in keep])
            columns = [pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], *columns], ["h", "lang", "at", "shares"])

    sample = training_sample(labelled, F.col("key")).select(F.xxhash64("key").alias("h"), "lang", "text")
    rows = sample.mapInArrow(averaged, "h long, lang string, at binary, shares binary").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"], bytes(r["at"]), bytes(r["shares"])))
    x = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return learn(x, [r["lang"] for r in rows], [r["h"] % CALIBRATION_OF == CALIBRATION for r in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns with ``lang_pred``, ``score`` and ``rejected``; carried columns of these names must be renamed before."""
    if clash := {c.lower() for c in carried} & {"lang_pred", "score", "rejected"}:
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carried, F.col(text).alias(free_name(docs, "predicted_text")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                if m is None or x is None or not has_letter(x):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    p = m.scores(x)
                    best = int(p.argmax())
                    langs.append(m.languages[best])
                    scores.append(float(p[best]))
            least = m.reject_below if m else 1.0
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([l == "und" or s < least for l, s in zip(langs, scores, strict=True)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(named, f"{kinds}, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    labelled = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(labelled.select(F.col("doc_id").alias("key"), "lang", "text"))
    return predict(docs, model, carried=("doc_id", "held_out"))
