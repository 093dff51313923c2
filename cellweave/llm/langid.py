"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits. For each bit, a logistic classifier on hashed byte n-grams (2 and 3
bytes of the text with A-Z lower-cased and other ASCII folded to a space) predicts its side. A text gets the language
whose codeword has the smallest loss, each bit's loss weighted by how well its classifier did in training; a text
whose two best codewords lie close together is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.textblock import slices, string_buffer

#: Texts of each language to train on at most: those whose ids' hashes are the least.
TRAIN_PER_LANGUAGE = 600
#: Languages that a model tells apart at most, as the driver fits it.
MOST_LANGUAGES = 500
DIMENSIONS = 1 << 12
UNDETERMINED = "und"
#: Two codewords are close if the better one's share of the two likelihoods is below this.
AMBIGUOUS_BELOW = 0.6

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def features(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples in one text."""
    folded = _FOLD[data]
    half = DIMENSIONS // 2
    pairs = folded[:-1] << np.uint32(8) | folded[1:]
    triples = pairs[:-1] << np.uint32(8) | folded[2:]
    found = np.empty(DIMENSIONS, np.float32)
    for part, grams, n in ((found[:half], pairs, 0x9E3779B1), (found[half:], triples, 0x85EBCA77)):
        cells = (grams * np.uint32(n)) >> np.uint32(32 - (half.bit_length() - 1))
        part[:] = np.bincount(cells, minlength=half) / max(1, len(grams))
    return np.sqrt(found)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of +1/-1 for each of n classes: of 200 random draws, that with the greatest least distance."""
    bits = max(7, 5 * int(n).bit_length())
    rng, best, reach = np.random.default_rng(seed), None, -1
    for _ in range(200):
        draw = rng.choice([-1, 1], (n, bits))
        draw[0] = 1
        if n > 1 and (np.abs(draw.sum(0)) == n).any():
            plain = np.flatnonzero(np.abs(draw.sum(0)) == n)
            draw[1 + plain % (n - 1), plain] *= -1
        far = ((draw[:, None] != draw[None]).sum(2) + bits * np.eye(n, dtype=int)).min()
        if far > reach:
            best, reach = draw, far
    return best


class Model:
    """Codewords, one linear classifier a bit, and the bits' weights."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.offsets, self.trust = languages, codes, weights, offsets, trust

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray]], steps: int = 150, rate: float = 20.0, decay: float = 1e-5) -> "Model":
        """Logistic regression for all bits at once; each language weighs the same."""
        languages = sorted({lang for lang, _ in rows})
        y = np.array([languages.index(lang) for lang, _ in rows])
        x = np.stack([f for _, f in rows]).astype(np.float32)
        codes = codewords(len(languages))
        weight = (1 / np.bincount(y))[y][:, None].astype(np.float32) / len(languages)
        goal = (codes[y] > 0).astype(np.float32)
        w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
        w_speed, b_speed = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - goal) * weight
            w_speed = 0.9 * w_speed - rate * (x.T @ error + decay * w)
            b_speed = 0.9 * b_speed - rate * error.sum(0) / 10
            w, b = w + w_speed, b + b_speed
        right = (((x @ w + b > 0) == (goal > 0)) * weight).sum(0)
        trust = np.clip(2 * right - 1, 0.05, 1)
        return cls(languages, codes, w, b, trust / trust.mean())

    def predict(self, data: np.ndarray) -> tuple[str, float, bool]:
        """(language, its share of the codewords' likelihood, ambiguous)."""
        sides = features(data) @ self.weights + self.offsets
        loss = (np.logaddexp(0, -self.codes * sides) * self.trust).sum(1)
        chance = np.exp(loss.min() - loss)
        best, share = int(np.argmin(loss)), 1 / chance.sum()
        second = np.partition(chance, -2)[-2] if len(chance) > 1 else 0.0
        return self.languages[best], float(share), bool(1 / (1 + second) < AMBIGUOUS_BELOW)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, id: str = "doc_id", most: int = MOST_LANGUAGES) -> Model | None:
    """A model of the languages that ``lang`` names, or None without any row that has a language and a text with a letter.

    At most ``per_language`` texts of each language are used, all of a rarer one; rows whose text is null or has no letter
    count for nothing. Only the features of the texts used reach the driver; more than ``most`` languages raise ValueError.
    Repeated rows count as often as they are there, so a text may hold no larger part of the sample than of its language.
    """
    # Most texts show a letter at once; only the others are searched to their end.
    letter = F.substring(text, 1, 64).rlike(r"\p{L}") | F.col(text).rlike(r"\p{L}")
    rows = docs.where(F.col(lang).isNotNull() & F.coalesce(letter, F.lit(False))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    # The sample is sized by the rows that it is drawn from.
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    # By the hash first, to about twice the limit; the rank is taken after texts have become features.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (2 * per_language + 100) / n))])[F.col("lang")]
    order = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
    chosen = rows.withColumn("place", order).where(F.col("place") < share * (1 << 20)).select("lang", "text", "place")

    def run(batches):
        for batch in slices(batches, "text"):
            data, at = string_buffer(batch.column(1))
            found = [features(data[at[k] : at[k + 1]]).astype(np.float16).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["lang", "features", "place"])

    made = chosen.mapInArrow(run, "lang string, features binary, place long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "features"))
    chosen = made.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "features")
    found = [(r.lang, np.frombuffer(r.features, np.float16).astype(np.float32)) for r in chosen.toLocalIterator()]
    return Model.fit(sorted(found, key=lambda x: (x[0], x[1].tobytes()))) if found else None


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns, with lang_pred, score and ambiguous for each whole text; columns of these names are replaced.

    A null text, one without a letter (an empty one too) and any text if there is no model is ``und`` with score 0,
    not ambiguous. Equal texts get equal answers, wherever they stand.
    """
    docs = docs.drop(*[f.name for f in ADDED])
    schema = T.StructType([*docs.schema.fields, *ADDED])

    def run(batches):
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            data, at = string_buffer(column)
            found = [model.predict(data[at[k] : at[k + 1]]) if model and has_letter(data[at[k] : at[k + 1]]) else (UNDETERMINED, 0.0, False) for k in range(batch.num_rows)]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def has_letter(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a character of Unicode's letter categories."""
    head = data[:64]
    if (((head | 0x20) >= 0x61) & ((head | 0x20) <= 0x7A)).any():
        return True
    if (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)).any():
        return True
    return bool((data >= 0x80).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


