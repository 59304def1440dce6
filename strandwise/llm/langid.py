"""Language identification by error-correcting output codes over byte n-grams.

Each language has a binary codeword; one linear n-gram classifier per code bit tells the languages with
a 1 from those with a 0. A text's margins are decoded by summed logistic loss, each bit weighted by its
classifier's least margin over the languages' pooled training counts, read as an accuracy: the nearest
codeword wins, and a small lead over the second is flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, pieces

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Bytes that are not letters (ASCII) count as one separator, capitals as small letters.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PIECE = 1 << 20


@dataclass(frozen=True)
class LangIdSpec:
    """sample_rows bounds the labelled rows per language that the classifiers are fitted on; smooth is added to each n-gram's count; lead is the score gap below which a prediction is ambiguous."""

    sample_rows: int = 5000
    smooth: float = 0.5
    lead: float = 0.2
    seed: int = 11


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits


def trigrams(text: str):
    """Bucket numbers of the folded text's byte trigrams, in pieces of bounded size."""
    data = np.frombuffer((" " + text + " ").encode("utf-8", "replace").translate(FOLD), np.uint8)
    for at in range(0, len(data) - 2, PIECE):
        d = data[at : at + PIECE + 2].astype(np.uint32)
        h = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
        yield (h[h != 0x202020] * np.uint32(0x9E3779B1)) >> np.uint32(17)


def counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for g in trigrams(text):
        out += np.bincount(g, minlength=BUCKETS)
    return out


def codewords(n: int, seed: int) -> np.ndarray:
    """n codewords as rows of +1 and -1: the exhaustive code up to 6 languages, else the best of some random dense codes."""
    if n <= 2:
        return np.array([[1], [-1]], np.int8)[:n]
    if n <= 6:
        bits = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    length, rng, best = int(np.ceil(15 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        apart = (length - (code.astype(int) @ code.T) + np.eye(n, dtype=int) * 4 * length).min()
        if (np.abs(code.sum(axis=0)) < n).all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


def fit(rows: DataFrame, spec: LangIdSpec = LangIdSpec()) -> Model:
    """rows: doc_id, text, lang, all labelled. Up to about sample_rows rows of a language, chosen by a hash of doc_id, are counted.

    Counts are summed by language and n-gram before they reach the driver: at most languages x BUCKETS
    numbers. Each bit's classifier is the log ratio of the n-gram's frequency in its two sides.
    """
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0)), np.zeros(0))
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, spec.sample_rows / sizes[k]))])
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(spec.seed)), 11) * F.lit(2.0**-53)
    sample = known.where(chance < F.element_at(limit, F.col("lang"))).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                # Each document weighs alike, so that long ones don't rule the counts.
                c = counts(text)
                sums[lang] += (c * 10_000) // max(1, int(c.sum()))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield batch(schema, lang=[lang] * len(at), bucket=at.astype(np.int32), n=total[at])

    found = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(languages), BUCKETS))
    for r in found:
        table[languages.index(r.lang), r.bucket] = r.n
    share = (table + spec.smooth) / (table + spec.smooth).sum(axis=1, keepdims=True)
    code = codewords(len(languages), spec.seed)
    weights = np.stack([np.log(share[code[:, j] > 0].mean(axis=0)) - np.log(share[code[:, j] < 0].mean(axis=0)) if len(languages) > 1 else np.ones(BUCKETS) for j in range(code.shape[1])], axis=1)
    # Trust: how far apart the classifier puts its two sides on the training counts, as an expected accuracy.
    margins = (table / np.maximum(1, table.sum(axis=1, keepdims=True))) @ weights
    trust = 1 / (1 + np.exp(-4 * (margins * code).min(axis=0)))
    return Model(languages, code, weights.astype(np.float32), trust / trust.sum())


def decode(model: Model, margins: np.ndarray, n: int) -> tuple[int, float, float]:
    """The nearest codeword, its score in 0..1 and its lead over the second. margins: mean per n-gram, of n n-grams."""
    scale = min(40.0, np.sqrt(max(1, n))) * 2
    loss = (np.logaddexp(0, -scale * margins[None, :] * model.code) * model.trust).sum(axis=1)
    p = np.exp(-(loss - loss.min()) * 2)
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return int(order[0]), float(p[order[0]]), float(p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0))


def predict(docs: DataFrame, model: Model, lead: float = 0.2) -> DataFrame:
    """docs' doc_id and every column named keep_*, plus lang_pred, score and ambiguous; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches):
        m = shared.value
        for b in pieces(batches):
            names, scores, flags = [], [], []
            for text in b.column(1).to_pylist():
                if not m.languages or text is None or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN), scores.append(0.0), flags.append(True)
                    continue
                total, n = np.zeros(m.weights.shape[1]), 0
                for g in trigrams(text):
                    total += np.bincount(g, minlength=BUCKETS) @ m.weights if len(g) > 4 * BUCKETS else m.weights[g].sum(axis=0, dtype=np.float64)
                    n += len(g)
                best, score, ahead = decode(m, total / max(1, n), n)
                names.append(m.languages[best]), scores.append(min(1.0, max(0.0, score))), flags.append(ahead < lead)
            yield batch(schema, doc_id=b.column(0), lang_pred=names, score=scores, ambiguous=flags)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of doc_id as text, mod 5, is 0 (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, spec: LangIdSpec = LangIdSpec()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document.

    Fits on the labelled rows that are not held out, then predicts from the whole text alone. Null texts
    and texts without a letter are und with score 0; so is everything if nothing is labelled. Repeated
    rows each give a row; an empty table gives none. The model (languages x code bits x BUCKETS floats)
    is the only thing that is broadcast, and does not grow with the documents.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), spec)
    return predict(docs, model, spec.lead).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
