"""Quality rules, line first: clean line by line, then judge what is left of the document.

A line goes by one of four rules. Navigation: separators without a letter or digit between its words, mostly
links, or one of several short lines in a row that do not end as sentences do (a menu). Punctuation: words
full of symbols, shouting, or a long list of words in which no sentence ends. Boilerplate: the sentences with a
phrase of cookie, licence and subscription notices are at least half of the line, however long it is. Repeat: equal to an earlier line of the text. Letters, digits and sentence
ends are those of Unicode and hold for all languages; the phrases are English, German, French and Spanish, so
other languages' notices are only found by the other rules. Scripts without spaces between words have few
words a line: the shares still hold, the lengths in words (min_words, list_words, menu) judge them too short.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITESPACE, batch, pieces

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate (lower case).
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "uses cookies",
    "privacy policy",
    "terms of service",
    "terms of use",
    "released under the",
    "licensed under",
    "spdx-license-identifier",
    "permission is hereby granted",
    "subscribe to our",
    "click here",
    "skip to content",
    "sign in to",
    "javascript is disabled",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "verwendet cookies",
    "unsere datenschutz",
    "zum inhalt springen",
    "newsletter abonnieren",
    "tous droits réservés",
    "accepter les cookies",
    "utilise des cookies",
    "politique de confidentialité",
    "aller au contenu",
    "cliquez ici",
    "todos los derechos reservados",
    "aceptar cookies",
    "utiliza cookies",
    "política de privacidad",
    "saltar al contenido",
    "haga clic aquí",
)
#: Sentence ends, with closing quotes and brackets behind them; the start of a link; the end of a shout.
SENTENCE_END = "[.!?…。！？؟।][\"'”’»)\\]]*$"
LINE_END = "[.!?:;…。！？؟।][\"'”’»)\\]]*$"
LINK = "^[(<\"']*([Hh][Tt][Tt][Pp][Ss]?://|[Ww][Ww][Ww]\\.)"
SHOUT = "[!?]{2}$"
STOP = "[.!?…。！？؟।]"
_STOP = re.compile(STOP)
_SYMBOL = re.compile(f"[{SYMBOLS}]")
_SENTENCE_END, _LINE_END, _LINK, _SHOUT = map(re.compile, (SENTENCE_END, LINE_END, LINK, SHOUT))


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_percent decide base_failed; the shares are of a line's words, the loss of a text's word characters. A menu is menu_lines lines in a row of up to menu_words words each; a list has list_words words or more."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_share: float = 0.3
    shout_share: float = 0.3
    separator_share: float = 0.2
    link_share: float = 0.3
    menu_lines: int = 5
    menu_words: int = 3
    list_words: int = 30
    boilerplate_share: float = 0.5
    max_loss: float = 0.5


def line_fault(line: str, words: list[str], rules: QualityRules) -> str | None:
    """Why a line with words goes by itself (punctuation, navigation, boilerplate), or None if it stays."""
    n = len(words)
    if sum(not w.isalnum() and not any(map(str.isalnum, w)) for w in words) >= max(2, rules.separator_share * n):
        return "navigation"
    low = line.lower()
    if ("://" in low or "www." in low) and sum(bool(_LINK.match(w)) for w in words) > rules.link_share * n:
        return "navigation"
    if n >= 3 and _SYMBOL.search(line) and sum(bool(_SYMBOL.search(w)) for w in words) > rules.symbol_share * n:
        return "punctuation"
    if ("!" in line or "?" in line) and sum(bool(_SHOUT.search(w)) for w in words) > rules.shout_share * n:
        return "punctuation"
    if n >= rules.list_words and not any(map(_SENTENCE_END.search, words)):
        return "punctuation"
    if any(p in low for p in BOILERPLATE):
        parts = _STOP.split(low)
        if sum(len(x) for x in parts if any(p in x for p in BOILERPLATE)) >= rules.boilerplate_share * sum(map(len, parts)):
            return "boilerplate"
    return None


def menus(lines: list[list[str]], rules: QualityRules) -> set[int]:
    """Numbers of the lines in menus: runs of short lines that end like no sentence. Lines without a word are passed over."""
    out, run = set(), []
    for i, words in enumerate([*lines, ["end", "of", "the", "text."] * rules.menu_words]):
        if words and len(words) <= rules.menu_words and not _LINE_END.search(words[-1]):
            run.append(i)
        elif words:
            out |= set(run) if len(run) >= rules.menu_lines else set()
            run = []
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, last = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


def assess(text: str | None, rules: QualityRules) -> dict:
    """Figures, verdict and cleaned text of one document."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(text.count(chr(c)) for c in WHITESPACE)
    seen, duplicates, lost, kept_lines, faults = set(), 0, 0, [], Counter()
    lines = text.split("\n")
    split = [[w.decode() for w in line.encode().split()] for line in lines]
    menu = menus(split, rules)
    for i, (line, line_words) in enumerate(zip(lines, split)):
        repeated = bool(line_words) and line in seen
        if line_words:
            seen.add(line)
        duplicates += repeated
        fault = "repeated" if repeated else "navigation" if i in menu else line_fault(line, line_words, rules) if line_words else None
        if fault:
            faults[fault] += 1
            lost += len(line) - sum(line.count(chr(c)) for c in WHITESPACE)
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": not failed and lost <= rules.max_loss * word_chars,
        "n_lines_removed": sum(faults.values()),
        "lost_chars": lost,
        "cleaned_text": "\n".join(kept_lines),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars", "cleaned_text")


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: figures, base_failed, kept, and the cleaned text.

    One narrow pass, no shuffle. A line goes by the module's rules; a document goes if the base rules
    fail or if the removed lines hold more than max_loss of its word characters. Null text is an empty text
    (0 words, base_failed). Repeated rows and null ids each give their own row; columns other than
    the id and the text are not read, so clashing names do no harm; an empty table gives no rows.
    """
    names = [n for n in NAMES if keep_text or n != "cleaned_text"]
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned_text": pa.string()}
    schema = pa.schema([("doc_id", pa.int64())] + [(n, kinds.get(n, pa.int64())) for n in names])
    ddl = "doc_id long, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'string' if n == 'cleaned_text' else 'long'}" for n in names)

    def run(batches):
        for b in pieces(batches):
            rows = [assess(t, rules) for t in b.column(1).to_pylist()]
            yield batch(schema, doc_id=b.column(0), **{n: [r[n] for r in rows] for n in names})

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, ddl)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their cleaned texts and all their columns: one narrow pass, no join back.

    The text of a kept document loses the lines that fail; n_chars, if there is such a column of integers,
    follows it. A null or empty text has no words and goes. Repeated rows are judged alike; null ids and
    nulls in other columns are kept as they are; extra columns are passed on whatever their names are. An
    empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.schema)

    def run(batches):
        for b in pieces(batches):
            found = [assess(t, rules) for t in b.column(docs_columns.index("text")).to_pylist()]
            columns = dict(zip(docs_columns, b.columns))
            columns["text"] = pa.array([r["cleaned_text"] for r in found], out.field("text").type)
            if sized:
                columns["n_chars"] = pa.array([len(r["cleaned_text"]) for r in found], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out).filter(pa.array([r["kept"] for r in found], pa.bool_()))

    docs_columns, sized = docs.columns, "n_chars" in docs.columns and pa.types.is_integer(out.field("n_chars").type)
    return docs.mapInArrow(run, docs.schema)
