"""Benchmark decontamination by template canonicalisation.

Words become a template: lower case without outer punctuation, with numbers, names and units replaced by
typed placeholders. Windows of the benchmark's templates are hash-joined with the documents' windows; the
hits of one alignment (document, item, offset) are then checked for slot consistency: one benchmark value
must stand for one document value throughout. So a question with other numbers or names is still caught.

Templates alone leave out windows of many placeholders, and a name is told by its capital. So each text has two
further forms, searched in the same way and in union: the template with names as literal words, and the plain
lower-case words, all windows of which count. A copy in other case or of numbers only is found by those.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_if_small, materialize, pieces

#: Units that become a placeholder after a number, and numbers written as words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons "
    "percent % dollar dollars euro euros cent cents usd eur gbp degree degrees kmh mph watt watts volt volts joule joules byte bytes kb mb gb".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
NUMBER = re.compile(r"^[$€£+-]*\d[\d.,/:]*(?:st|nd|rd|th|e[+-]?\d+)?$", re.I)
NUMBER_UNIT = re.compile(r"^[$€£+-]*\d[\d.,]*([a-z%°]+)$", re.I)
OUTER = "\"'`“”‘’«»()[]{}<>*_.,;:!?…-–—"
LINE = "\x01"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
OTHER, NAME, NUM, UNIT = 0, 1, 2, 3
#: Forms of a text: template, template without names, plain words.
FORMS = TEMPLATE, NAMELESS, PLAIN = 0, 1, 2
CACHE = 500_000


@dataclass(frozen=True)
class DecontamSpec:
    """window: words a window; least_literal: words in it that are no placeholder (plain windows: any); an item is found if hits of a consistent alignment reach min_windows or share of its windows, whichever is less. Items of fewer than least_words words are searched as plain words only, and count only as a whole sentence or line. The benchmark's vocabulary and window hashes are sent to the executors only up to broadcast_bytes, its windows' rows up to broadcast_rows."""

    window: int = 8
    least_literal: int = 5
    least_words: int = 5
    min_windows: int = 6
    share: float = 0.5
    broadcast_bytes: int = 64 << 20
    broadcast_rows: int = 100_000


class Words(dict):
    """Word -> row of a table of what the word is at a sentence's start, inside a sentence, and to its neighbours, and of the plain word.

    With a vocabulary, literal words outside it get hash 0, which no window holds.
    """

    def __init__(self, vocabulary: frozenset | None = None):
        super().__init__()
        self.vocabulary = vocabulary
        # Row 0 is that of all unknown words without a capital, unit or sentence end.
        self.table, self.rows = np.zeros((1024, 6), np.uint64), 1

    def __missing__(self, word: str) -> int:
        row = (0, 0, 1, 0, 1, 0) if word == LINE else self.row(word)
        if not any(row):
            self[word] = 0
            return 0
        at, self.rows = self.rows, self.rows + 1
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = row
        self[word] = at
        return at

    def row(self, word: str) -> tuple:
        core = word.strip(OUTER)
        low = core.lower()
        number = low in NUMBER_WORDS or (not core.isalpha() and bool(NUMBER.match(core) or NUMBER_UNIT.match(core)))
        literal = self.literal(low)
        unit = (2 if number else 0) | (1 if low in UNITS or core == "%" else 0)
        name = len(core) > 1 and core[0].isupper() and not number
        return (NUM if number else literal, NUM if number else NAME if name else literal, word.rstrip("\"'”’)]")[-1:] in tuple(".!?:"), unit, 0, literal)

    def literal(self, low: str) -> int:
        if self.vocabulary is not None and low not in self.vocabulary:
            return OTHER
        return max(8, xxhash.xxh3_64_intdigest(low.encode()))

    def forms(self, text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(hash of each word in each of FORMS, each word's place in the text's words, whether it begins a sentence or line)."""
        words = text.replace("\n", f" {LINE} ").split()
        if len(self) > CACHE:
            self.clear()
            self.rows = 1
        rows = self.table_rows(list(map(self.__getitem__, words)))
        if not len(rows):
            return [np.empty(0, np.uint64)] * len(FORMS), np.empty(0, np.int64), np.empty(0, bool)
        starts = np.concatenate([[True], rows[:-1, 2] > 0])
        keep = rows[:, 4] == 0
        kinds, nameless, plain = np.where(starts, rows[:, 0], rows[:, 1])[keep], rows[keep, 0], rows[keep, 5]
        what = rows[keep, 3]
        after = np.concatenate([[False], (what[:-1] & np.uint64(2)) > 0])
        unit = after & ((what & np.uint64(1)) > 0)
        kinds[unit & (kinds != NUM)] = UNIT
        nameless[unit & (nameless != NUM)] = UNIT
        return [kinds, nameless, plain], np.flatnonzero(keep), starts[keep]

    def table_rows(self, at: list[int]) -> np.ndarray:
        return self.table[np.array(at, np.int64)] if at else self.table[:0]


def sums(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running numbers of unknown and of literal words."""
    out = np.zeros((2, len(kinds) + 1), np.int32)
    np.cumsum(kinds == OTHER, out=out[0, 1:])
    np.cumsum(kinds > UNIT, out=out[1, 1:])
    return out[0], out[1]


def windows(kinds: np.ndarray, size: int, least_literal: int, form: int = TEMPLATE, counted: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows without unknown words and with enough literal ones. The hash tells the form. counted: the kinds' sums, if known."""
    n = len(kinds) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    unknown, literal = counted or sums(kinds)
    at = np.flatnonzero(unknown[size:] == unknown[:n])
    if least_literal:
        at = at[literal[at + size] - literal[at] >= min(least_literal, size)]
    h = np.full(len(at), size | form << 32, np.uint64)
    for j in range(size if len(at) else 0):
        h = (h ^ kinds[at + j]) * MULTIPLIER
        h ^= h >> np.uint64(32)
    return at, h


def slots(words: list[str], kinds: np.ndarray, places: np.ndarray, at: int, size: int) -> list[str]:
    return [f"{k}:{words[places[i]].strip(OUTER)}" for i in range(at, at + size) if (k := int(kinds[i])) <= UNIT]


SCHEMA = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("n_windows", pa.int64()), ("form", pa.int64()), ("slots", pa.list_(pa.string()))])
DDL = "id long, hash long, pos long, n_windows long, form long, slots array<string>"


def window_rows(texts: DataFrame, spec: DecontamSpec, sizes: list[int] | None, shared=None) -> DataFrame:
    """(id, hash, pos, n_windows, form, slots) of texts (id, text), a row for each window of each form. sizes None: each text's own, as for benchmark items.

    shared: a broadcast (vocabulary, sorted window hashes) that holds windows back which can't join.
    """

    def run(batches):
        vocabulary, known = shared.value if shared is not None else (None, None)
        cache = Words(vocabulary)
        for b in pieces(batches):
            out = {n: [] for n in SCHEMA.names}
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forms, places, begins = cache.forms(text or "")
                begins = np.append(begins, True)
                n_words = len(places)
                words, counted = None, [sums(kinds) for kinds in forms]
                for size in ([min(spec.window, n_words)] if n_words else []) if sizes is None else sizes:
                    for form, kinds in enumerate(forms):
                        if form != PLAIN and size < spec.least_words:
                            continue
                        at, h = windows(kinds, size, 0 if form == PLAIN else spec.least_literal, form, counted[form])
                        if size < spec.least_words:
                            whole = begins[at] & begins[at + size]
                            at, h = at[whole], h[whole]
                        total = len(at)
                        if known is not None and len(at):
                            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                            at, h = at[hit], h[hit]
                        if len(at):
                            words = words or (text or "").replace("\n", f" {LINE} ").split()
                            for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
                                for n, v in zip(SCHEMA.names, (key, x, i, total, form, slots(words, kinds, places, i, size))):
                                    out[n].append(v)
                if len(out["id"]) > 20_000:
                    yield batch(SCHEMA, **out)
                    out = {n: [] for n in SCHEMA.names}
            yield batch(SCHEMA, **out)

    return texts.mapInArrow(run, DDL)


def vocabulary(benchmark: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.string())])

    def run(batches):
        for b in batches:
            yield batch(schema, word=sorted({w.strip(OUTER).lower() for t in b.column(0).to_pylist() for w in (t or "").split()}))

    return benchmark.select("text").mapInArrow(run, "word string").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, spec: DecontamSpec = DecontamSpec()) -> DataFrame:
    """(doc_id, item_id, n_hits, item_windows, n_changed): one row per document and benchmark item found in it.

    n_hits and n_changed (slots whose value differs: above 0 the question was re-parameterised) are of the
    best alignment. docs: doc_id, text; benchmark: item_id, text. Null or empty texts match nothing; rows
    that repeat a doc_id are reported once; a null doc_id is reported as null. Items shorter than a window
    are one window of their own length; one of under least_words words counts only where it begins and ends with a
    sentence or line, as single words stand anywhere; items without a word match nothing. Extra columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = materialize(window_rows(benchmark.select(F.col("item_id").cast("long").alias("id"), "text"), spec, None), "bench-windows")
    words = materialize(vocabulary(benchmark), "bench-words")
    sizes = materialize(benchmark_sizes(benchmark, spec), "bench-sizes").distinct().toPandas()["size"].tolist()
    shared = None
    if 8 * items.count() + (words.agg(F.sum(F.octet_length("word") + 60)).first()[0] or 0) <= spec.broadcast_bytes:
        hashes = np.sort(np.array([r.hash for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast((frozenset(r.word for r in words.collect()), hashes))
    found = window_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), spec, sizes, shared)
    item = items.select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("item_pos"), F.col("n_windows").alias("item_windows"), "form", F.col("slots").alias("item_slots"))
    met = found.drop("form").join(broadcast_if_small(item, spec.broadcast_rows), "hash").where(F.size("slots") == F.size("item_slots"))
    met = met.select(F.col("id").alias("doc_id"), "item_id", "item_windows", "form", "item_pos", (F.col("pos") - F.col("item_pos")).alias("offset"), F.arrays_zip("item_slots", "slots").alias("pairs"))
    lined = met.groupBy("doc_id", "item_id", "item_windows", "form", "offset").agg(F.countDistinct("item_pos").alias("n_hits"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct("pairs.item_slots"))
    enough = F.col("n_hits") >= F.least(F.lit(spec.min_windows), F.ceil(F.col("item_windows") * spec.share))
    changed = F.size(F.filter("pairs", lambda p: p.item_slots != p.slots))
    good = lined.where(consistent & enough).select("doc_id", "item_id", F.struct("n_hits", (-changed).alias("same"), "item_windows").alias("x"))
    return good.groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.n_hits", "x.item_windows", (-F.col("x.same")).cast("long").alias("n_changed"))


def benchmark_sizes(benchmark: DataFrame, spec: DecontamSpec) -> DataFrame:
    """The distinct window sizes (at most spec.window) that the items need."""
    schema = pa.schema([("size", pa.int64())])

    def run(batches):
        cache = Words()
        for b in batches:
            n = {len(cache.forms(t or "")[1]) for t in b.column(0).to_pylist()}
            yield batch(schema, size=sorted({min(spec.window, x) for x in n if x}))

    return benchmark.select("text").mapInArrow(run, "size long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, spec: DecontamSpec = DecontamSpec()) -> DataFrame:
    """docs without the documents in which a benchmark item is found; columns as they are."""
    hits = materialize(contaminated(docs, benchmark, spec).select(F.col("doc_id").alias("_doc")).distinct(), "contaminated")
    return docs.join(broadcast_if_small(hits, 500_000), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
