"""Language identification by the nearest of several clustered centroids per language.

A text becomes a TF-IDF vector of hashed byte trigrams, normalised to length one. Spherical k-means
makes ``clusters`` centroids for each language; a text gets the language of the centroid with the
highest cosine, and is rejected where it is much farther from it than texts of its length were in
training.

Scale: the model is fitted on at most ``per_lang`` labelled rows of each of the ``most_langs`` most
frequent labels (documented bounds), so what the driver collects and what executors receive do not
grow with the corpus. The prediction is one narrow Arrow pass, without a shuffle, over whole texts;
a text is scored from its own trigrams alone, one at a time, so a worker holds little.

Defined results: null text, empty text and text without a letter give language ``und``, score 0 and
``rejected`` true. With no labelled row at all every text gets ``und``. Repeated rows each get their
own row; equal texts get equal results. Ties between centroids go to the language first in
alphabetical order. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import bounded, sliced, table

BUCKETS = 8192
PER_LANG = 300
CLUSTERS = 4
ROWS = 256
#: Labels beyond the most frequent ones are not learned, so that a dirty column bounds what is collected.
MOST_LANGS = 64
UND = "und"

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_ASCII_LETTER = re.compile("[A-Za-z]")
# Lower-case ASCII letters; every other ASCII byte is a blank, bytes of longer code points stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of a text, with their counts; none without a letter. A blank is put on both sides."""
    if not has_letter(text):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    a = _FOLD[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]
    h = a[:-2] * _A + a[1:-1] * _B + a[2:] * _C
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    n = np.bincount(h >> np.uint32(19), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float32)


def normalised(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length one."""
    v = np.log1p(n) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit length; starts from the rows that are farthest from those already chosen."""
    chosen = [0]
    best = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


class CentroidModel:
    """Centroids, IDF weights and, per octave of text length, the least cosine that is not rejected."""

    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, floor: np.ndarray) -> None:
        self.langs, self.owner, self.centroids, self.idf, self.floor = langs, owner, centroids, idf, floor

    @staticmethod
    def octave(total: float) -> int:
        return min(31, int(np.log2(max(total, 1))))

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], clusters: int = CLUSTERS, slack: float = 0.5) -> CentroidModel:
        """``texts``: the trigrams of each text, as places and counts; those without any are left out."""
        kept = [(x, y) for x, y in zip(texts, labels, strict=True) if len(x[0])]
        df = np.zeros(BUCKETS)
        for (at, _), _ in kept:
            df[at] += 1
        idf = (np.log((1 + len(kept)) / (1 + df)) + 1).astype(np.float32)
        langs = sorted({y for _, y in kept})
        groups, floor = [], np.full(32, np.nan)
        of_lang = {x: [t for t, y in kept if y == x] for x in langs}
        for x in langs:
            v = np.zeros((len(of_lang[x]), BUCKETS), np.float32)
            for k, (at, n) in enumerate(of_lang[x]):
                v[k, at] = normalised(n, idf[at])
            groups.append(spherical_kmeans(v, clusters))
        owner = np.repeat(np.arange(len(langs)), [len(g) for g in groups])
        model = cls(langs, owner, np.concatenate(groups) if groups else np.zeros((0, BUCKETS), np.float32), idf, floor)
        # The least cosine of the training texts of an octave and its neighbours, times slack, is the floor there;
        # octaves without training texts take that of the next shorter one.
        best = [(cls.octave(n.sum()), model.best(at, n)[1]) for (at, n), _ in kept]
        for o in range(32):
            near = [c for k, c in best if abs(k - o) <= 1]
            floor[o] = slack * min(near) if near else floor[o - 1] if o and floor[o - 1] == floor[o - 1] else 0.0
        return model

    def best(self, at: np.ndarray, n: np.ndarray) -> tuple[int, float]:
        """The nearest centroid and its cosine: only the columns of the text's own trigrams are read."""
        cos = self.centroids[:, at] @ normalised(n, self.idf[at])
        k = int(cos.argmax())
        return k, float(min(max(cos[k], 0.0), 1.0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether it is rejected: nothing to judge, no cosine above 0, or one below the floor."""
        at, n = trigrams(text)
        if not len(at) or not self.langs:
            return UND, 0.0, True
        k, score = self.best(at, n)
        return self.langs[self.owner[k]], score, score <= 0.0 or score < self.floor[self.octave(n.sum())]


def training_sample(docs: DataFrame, text: str, lang: str, key: Column, per_lang: int, most_langs: int) -> DataFrame:
    """At most ``per_lang`` rows of each of the ``most_langs`` most frequent labels, those of the least hash of ``key``.

    A first pass counts the labels; a hash threshold then lets about twice the bound pass, so that
    the window that cuts to the bound never holds more, whatever share of the rows a label has.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.abs(F.xxhash64(key) % F.lit(1 << 40)).alias("h")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    seen = docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_langs)
    near = rows.join(F.broadcast(seen), "lang").filter(F.col("h") * F.col("count") <= F.lit(2 * per_lang + 50) * F.lit(1 << 40).cast("double"))
    w = Window.partitionBy("lang").orderBy("h", F.sha2("text", 256))
    return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_lang).select("text", "lang", "h")


def fit(
    docs: DataFrame, key: Column, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, clusters: int = CLUSTERS, most_langs: int = MOST_LANGS
) -> CentroidModel:
    """Fit on a bounded sample: executors count the trigrams, the driver gets ``per_lang`` sparse rows of ``most_langs`` labels at most."""
    bounded(docs.sparkSession)
    sample = training_sample(docs, text, lang, key, per_lang, most_langs)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [trigrams(x) for x in b.column(0).to_pylist()]
            at = pa.array([x.astype("<u2").tobytes() for x, _ in found], pa.binary())
            n = pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), at, n], names=["lang", "h", "at", "n"])

    rows = [(r["lang"], r["h"], bytes(r["at"]), bytes(r["n"])) for r in sample.mapInArrow(vectors, "lang string, h long, at binary, n binary").collect()]
    rows.sort()
    return CentroidModel.fit([(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<f4")) for _, _, at, n in rows], [r[0] for r in rows], clusters)


def identify(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected`` (replacing columns of those names).

    Only the text goes to the Python workers, and only the three results come back.
    """
    bounded(docs.sparkSession)
    added = ("lang_pred", "score", "rejected")
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [m.predict(x) for lo in range(0, len(texts), ROWS) for x in texts.slice(lo, ROWS).to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=added)

    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judge(F.col(f"`{text}`")).alias("judged"))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(f"judged.{c}").alias(c) for c in added])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(~held), key=F.col("doc_id"))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
