"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector over hashed trigrams of the bytes of letters, normalised; its
language is that of the centroid with the largest cosine.  Centroids come from
spherical k-means within each language, on about ``per_language`` training
texts a language (and about ``most`` of all), chosen by a hash of their id; what reaches the driver is one
sparse vector of at most ``BINS`` counts a training text.  Every text is scored
whole, in one pass without a shuffle.

A text is rejected when it has no letter or when its cosine is below
``slack`` times the 0.5 % quantile of the training texts of that language.

Defined cases: null, empty and letterless texts are ``und`` with score 0 and
rejected; so is every text when nothing was learned; ties go to the language
first in order; repeated rows are scored alike; other columns are ignored or
carried as the caller asks; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._cluster import small_batches
from quarry.llm._text import as_array, chunks, lean

BINS, ROWS = 8192, 256


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # float32, centroids by bins, normalised, times idf
    idf: np.ndarray
    floor: dict[str, float]


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigram_counts(lowered) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts): hashed trigrams of lower-cased texts; all but a-z and non-ASCII bytes count as blanks."""
    for lo, hi, data, offs in chunks(lowered):
        b = _FOLD[data]
        pad = np.concatenate([[0x20], b, [0x20]]).astype(np.uint32)
        code = ((pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:]) * np.uint32(2654435761)) >> np.uint32(19)
        whole = b != 0x20  # a trigram stands around a letter
        for r in range(lo, hi, ROWS):
            end = min(hi, r + ROWS)
            x, y = offs[r - lo], offs[end - lo]
            row = np.repeat(np.arange(end - r) * BINS, np.diff(offs[r - lo : end - lo + 1]))
            keep = whole[x:y]
            yield r, end, np.bincount(row[keep] + code[x:y][keep], minlength=(end - r) * BINS).reshape(end - r, BINS)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    c = _unit(x.mean(0, keepdims=True))
    seeds = [x[int((x @ c[0]).argmax())]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int((x @ np.array(seeds).T).max(1).argmin())])
    c = np.array(seeds)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 800, most: int = 4000, centroids: int = 4, slack: float = 0.5) -> Model:
    """A model of the rows given; null texts and languages teach nothing."""
    small_batches(rows.sparkSession)
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    span = 1 << 32
    per_language = min(per_language, max(1, most // max(1, len(sizes))))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(span))
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, per_language * span // n))]) if sizes else None
    model = Model([], np.zeros((0, BINS), np.float32), np.zeros(BINS, np.float32), {})
    if part is None:
        return model

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, _, counts in trigram_counts(pc.utf8_lower(as_array(b.column(0)).cast(pa.large_string()))):
                for c in counts:
                    at = np.flatnonzero(c)
                    rows.append(at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["features", "lang"])

    found = known.where(draw < part[F.col("lang")]).select("text", "lang").mapInArrow(lean(sparse), "features binary, lang string").toArrow().sort_by([("lang", "ascending"), ("features", "ascending")])
    langs, x = np.array(found["lang"].to_pylist()), np.zeros((found.num_rows, BINS), np.float32)
    for i, raw in enumerate(found["features"].to_pylist()):
        n = len(raw) // 6
        x[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
    seen = sum((x[i : i + ROWS] > 0).sum(0) for i in range(0, len(x), ROWS))
    model.idf = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
    for i in range(0, len(x), ROWS):  # in place: the sample is the largest thing that the driver holds
        x[i : i + ROWS] = _unit(x[i : i + ROWS] * model.idf)
    parts = []
    for lang in sorted(set(langs.tolist())):
        own = x[langs == lang]
        own = own[own.any(1)]
        if not len(own):
            continue
        c = _kmeans(own, centroids)
        parts.append(c)
        model.languages += [lang] * len(c)
        model.floor[lang] = slack * float(np.quantile((own @ c.T).max(1), 0.005))
    model.centroids = (np.concatenate(parts) if parts else model.centroids).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carry, lang_pred, score, accepted); score is the cosine to the nearest centroid, from 0 to 1."""
    small_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    at = carry.index(text_col) if text_col in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        languages = np.array([*m.languages, "und"], dtype=object)
        floors = np.array([*(m.floor[x] for x in m.languages), 2.0])
        for b in batches:
            text = pc.fill_null(as_array(b.column(at)).cast(pa.large_string()), "")
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), len(m.languages)), np.zeros(len(text))
            if m.languages:
                for lo, hi, counts in trigram_counts(pc.utf8_lower(text)):
                    sims = _unit(counts.astype(np.float32) * m.idf) @ m.centroids.T
                    best[lo:hi], score[lo:hi] = sims.argmax(1), sims.max(1)
                best[~letters], score[~letters] = len(m.languages), 0
            score = np.clip(score, 0, 1)
            names = [*carry, "lang_pred", "score", "accepted"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(languages[best], pa.string()), pa.array(score), pa.array(score >= floors[best])], names)

    rows = docs.select(*carry) if text_col in carry else docs.select(*carry, F.col(text_col).alias("__text"))
    return rows.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double, accepted boolean")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n
