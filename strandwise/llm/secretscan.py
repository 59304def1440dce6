"""Secret scans: fixed patterns, plus two character Markov models compared by log-likelihood ratio.

Only DataFrame and SQL functions. A first-order Markov model of random strings and one of ordinary words,
identifiers and numbers are estimated from labelled samples; a long token outside the patterns' matches is
a secret if its mean log ratio a character step is high enough. The trained model is one array of numbers
with a place for each pair of characters, looked up by an expression on each token.

A text's matches are handled as arrays. Positions come from running sums, and tokens are told from base
matches by one sort and a running maximum, so a text of n tokens costs n ** 1.5 small steps, not n ** 2.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order that ties at one start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words of which ordinary identifiers are made, so that a small corpus has a sample too.
PLAIN = "the quick user name list value index count file path read write data table column row key map set get make build run test check start stop open close load save first last next item page line text word number total size length time date order group result error message request response server client config option default parent child node tree".split()
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "model")
SPAN = "array<struct<start: int, rank: int, end: int, kind: string, value: string>>"


@dataclass(frozen=True)
class SecretSpec:
    """random_rows: generated random strings; sample_docs: about so many documents, chosen by hash, give the ordinary words. min_ratio is the mean log ratio a step from which a token is a secret."""

    random_rows: int = 4000
    sample_docs: int = 400
    min_ratio: float = 0.7
    seed: int = 23


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join) -> Column:
    """Running folds of an array (a sum, a maximum) by join, in blocks of the root of its length.

    Appending one by one would copy the square of the length.
    """

    def prefixes(block):
        return F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x))))

    def by_blocks(v):
        def built(width):
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: prefixes(F.slice(v, i * width + 1, width)))
            return let(blocks, lambda parts: let(prefixes(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: join(ends[i - 1], x)))))))

        return F.when(F.size(v) < 2, v).otherwise(let(F.ceil(F.sqrt(F.size(v))).cast("int"), built))

    return let(values, by_blocks)


def located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans (start, rank, end, kind, value) of a pattern's leftmost non-overlapping matches whose group has least characters; ends are exclusive, in code points.

    The pieces between matches and the matches' own lengths give the positions.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def spans(p):
        ends = running(F.zip_with(p.gaps, p.whole, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), lambda x, y: x + y)
        every = let(ends, lambda e: F.transform(p.whole, lambda m, i: F.struct((e[i] - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e[i].alias("end"), F.lit(kind).alias("kind"), p.value[i].alias("value"))))
        return F.filter(every, lambda s: F.length(s.value) >= least)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, spans)).otherwise(F.expr(f"cast(array() AS {SPAN})"))


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps, in order.

    By a token's end, all base spans that start before it have been passed; it is apart if none of them ends after its start.
    """
    ends = F.transform(tokens, lambda t: F.struct(t.end.alias("at"), F.lit(0).alias("base"), t.start.alias("other"), t.value.alias("value")))
    starts = F.transform(base, lambda b: F.struct(b.start.alias("at"), F.lit(1).alias("base"), b.end.alias("other"), F.lit(None).cast("string").alias("value")))

    def kept(events):
        reach = running(F.transform(events, lambda e: F.when(e.base == 1, e.other).otherwise(-1)), lambda x, y: F.greatest(x, y))
        free = let(reach, lambda r: F.filter(events, lambda e, i: (e.base == 0) & (r[i] <= e.other)))
        return F.transform(free, lambda e: F.struct(e.other.alias("start"), F.lit(KINDS.index("model")).alias("rank"), e["at"].alias("end"), F.lit("model").alias("kind"), e.value.alias("value")))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(F.array_sort(F.concat(ends, starts)), kept))


def labelled_sample(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """(token, secret): random strings in hexadecimal, base 64, and mixed-case and capital alphabets; ordinary words, identifiers made of them, numbers and dates.

    The random ones are generated; the ordinary ones are made of fixed words and of the letter words of about
    sample_docs documents.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{spec.seed}-"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    kinds = F.array(F.substring(digest, 1, 40), base64, F.translate(F.substring(base64, 1, 32), "+/", "-_"), F.upper(F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 32)), F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    random = spark.range(spec.random_rows).select(F.explode(kinds).alias("token"), F.lit(True).alias("secret"))
    words = F.array(*[F.lit(w) for w in PLAIN])
    pick = lambda n: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(n), F.lit(spec.seed)), F.lit(len(PLAIN))) + 1).cast("int")).alias(f"w{n}")
    named = spark.range(spec.random_rows).select(pick(0), pick(1), pick(2), pick(3), F.substring(F.regexp_replace(F.abs(F.xxhash64("id", F.lit(spec.seed + 1))).cast("string"), "-", ""), 1, 16).alias("n"))
    forms = "array(concat_ws('_', w0, w1, w2), concat_ws('-', w0, w1, w2, w3), concat(w0, initcap(w1), initcap(w2), initcap(w3)), concat(initcap(w0), initcap(w1), initcap(w2)), upper(concat_ws('_', w0, w1)), concat_ws('/', w0, w1, w2, w3), concat(w0, w1, w2), n, concat_ws('-', substr(n, 1, 4), substr(n, 5, 2), substr(n, 7, 2)), concat(w0, '-', substr(n, 1, 6)))"
    named = named.select(F.explode(F.expr(forms)).alias("token"), F.lit(False).alias("secret"))
    total = docs.count()
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(spec.seed)), 11) * F.lit(2.0**-53)
    sample = docs.where(chance < min(1.0, spec.sample_docs / max(1, total))).select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Za-z]{2,}\b"), F.lit(0)).alias("w"))
    made = F.expr(
        "flatten(transform(filter(sequence(0, size(w) div 3 - 1), i -> size(w) >= 3), i -> array(concat_ws('_', lower(w[3*i]), lower(w[3*i+1]), lower(w[3*i+2])), concat_ws('-', w[3*i], w[3*i+1], w[3*i+2]), "
        "concat(lower(w[3*i]), initcap(w[3*i+1]), initcap(w[3*i+2])), concat(lower(w[3*i]), lower(w[3*i+1])), concat_ws('/', w[3*i], w[3*i+1], w[3*i+2]), upper(concat_ws('_', w[3*i], w[3*i+1])), concat_ws('_', lower(w[3*i]), cast(i % 100 AS string)))))"
    )
    return random.union(named).union(sample.select(F.explode(made).alias("token"), F.lit(False).alias("secret")))


def fit(labelled: DataFrame) -> str:
    """The model: an array expression of 128 x 128 log ratios, at 128 * first character + second.

    Steps are counted by pair and label before they reach the driver, which gets at most 128 x 128 rows.
    """
    steps = labelled.select("secret", F.explode(F.expr("transform(filter(sequence(1, length(token) - 1), i -> length(token) > 1), i -> substring(token, i, 2))")).alias("pair"))
    found = steps.groupBy(F.ascii("pair").alias("a"), F.ascii(F.substring("pair", 2, 1)).alias("b")).agg(F.sum(F.col("secret").cast("long")).alias("random"), F.sum((~F.col("secret")).cast("long")).alias("plain")).collect()
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."]
    seen = {(r.a, r.b): (r.random, r.plain) for r in found}
    table = ["0"] * (128 * 128)
    for a in alphabet:
        rows = [seen.get((a, b), (0, 0)) for b in alphabet]
        random, plain = (sum(r[i] for r in rows) + len(alphabet) for i in (0, 1))
        for b, (x, y) in zip(alphabet, rows):
            table[128 * a + b] = f"{math.log((x + 1) / random) - math.log((y + 1) / plain):.3f}"
    return f"cast(split('{','.join(table)}', ',') AS array<double>)"


def ratio(token: Column, model: str) -> Column:
    """The mean log ratio a step of a token of two characters or more."""
    codes = F.transform(F.split(token, ""), F.ascii)
    table = F.expr(model)
    return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + table[c[i - 1].bitwiseAND(F.lit(127)) * 128 + c[i].bitwiseAND(F.lit(127))]) / (F.length(token) - 1))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, model: str, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """doc_id, base and model spans (arrays of start, rank, end, kind, value) of every whole text; one narrow pass.

    Null text is empty. Model spans never overlap base spans. Repeated rows each give a row; extra
    columns are ignored; an empty table gives no rows. A very long text of n tokens takes n ** 1.5 steps.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.concat(located(text, ASSIGN, "assign", 1, ASSIGN_LEAST), located(text, ACCESS, "access"), located(text, HEX, "hex")).alias("base"), located(text, TOKEN, "model").alias("tokens"))
    return rows.select("doc_id", "base", F.filter(apart(F.col("tokens"), F.col("base")), lambda t: ratio(t.value, model) > spec.min_ratio).alias("model"))


def secret_digest(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    found = scan(docs, fit(labelled_sample(docs, spec)), spec)
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, model)").alias("spans"), F.size("model").cast("long").alias("n_model"))
