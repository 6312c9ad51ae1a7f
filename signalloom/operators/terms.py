"""Positional dictionary match: which names of a dictionary occur in a text, and where.

An index lists the forms of all names under their first word, so a text is read once, word by word, and meets
only the forms that could begin at a word it has. Of several forms of one name at one place the
longest counts. Dictionaries of up to ``MAX_FORMS`` forms travel to the tasks; larger ones are joined by the
first word of their forms, so that neither side has to fit anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalloom.functions.text import as_col

MAX_FORMS = 100_000
WINDOW = 60
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BLANKS = " \t\r\n\f\v"


def listed(terms: Mapping[str, Sequence[str]], cased_terms: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, str, bool]]:
    """``name, form, cased`` of dictionaries of forms by name."""
    return [(n, f, False) for n, fs in terms.items() for f in fs] + [(n, f, True) for n, fs in (cased_terms or {}).items() for f in fs]


class TermIndex:
    """Forms by first word.

    ``literal`` forms match letter by letter between edges; otherwise their words match in sequence, whatever
    stands between them. Words are runs of ASCII letters and digits, or of all word characters if ``unicode``.
    Forms that are not ``cased`` match in any case.
    """

    def __init__(self, terms: Iterable[tuple[str, str, bool]], literal: bool = True, unicode: bool = False):
        self.literal, self.unicode = literal, unicode
        self.word = re.compile(r"\w+" if unicode else "[A-Za-z0-9]+")
        self.by_word: dict[str, list[tuple]] = {}
        self.wordless: list[tuple[str, str, bool]] = []
        for name, form, cased in sorted(set(terms), key=lambda t: (-len(t[1]), t)):
            own = form if cased else self.fold(form)
            words = [(m.start(), m.group()) for m in self.word.finditer(own)]
            if words:
                first = self.fold(words[0][1])
                self.by_word.setdefault(first, []).append((name, own, cased, words[0][0], [w for _, w in words]))
            elif literal and own:
                self.wordless.append((name, own, cased))

    def fold(self, text: str) -> str:
        """Lower case of the same length."""
        if text.isascii():
            return text.lower()
        if not self.unicode:
            return text.translate(_ASCII_LOWER)
        lowered = text.lower()
        return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def _edge(self, text: str, at: int) -> bool:
        return not (0 <= at < len(text)) or not self.word.match(text, at)

    def places(self, text: str) -> Iterator[tuple[str, int, int]]:
        """``name, start, length`` of every match, by start; one per name and start."""
        folded = self.fold(text)
        tokens = list(self.word.finditer(folded))
        seen: set[tuple[str, int]] = set()
        for i, token in enumerate(tokens):
            for name, form, cased, lead, words in self.by_word.get(token.group(), ()):
                own = text if cased else folded
                if self.literal:
                    start, length = token.start() - lead, len(form)
                    fits = start >= 0 and own.startswith(form, start) and self._edge(text, start - 1) and self._edge(text, start + length)
                else:
                    start = token.start()
                    part = tokens[i : i + len(words)]
                    fits = [own[t.start() : t.end()] for t in part] == words
                    length = part[-1].end() - start
                if fits and (name, start) not in seen:
                    seen.add((name, start))
                    yield name, start, length
        for name, form, cased in self.wordless:
            own, at = (text if cased else folded), -1
            while (at := own.find(form, at + 1)) >= 0:
                if self._edge(text, at - 1) and self._edge(text, at + len(form)) and (name, at) not in seen:
                    seen.add((name, at))
                    yield name, at, len(form)

    def first(self, texts: Sequence[str | None]) -> dict[str, tuple[int, int, int]]:
        """Each name's first place: ``column, start, length``, in the first column that has one."""
        out: dict[str, tuple[int, int, int]] = {}
        for column, text in enumerate(texts):
            for name, start, length in self.places(text) if text else ():
                if name not in out or (column, start) < out[name][:2]:
                    out[name] = column, start, length
        return out


def around(text: str, start: int, length: int, window: int = WINDOW) -> str:
    """The text at a place with some characters on either side."""
    return text[max(0, start - window) : start + length + window].strip(_BLANKS)


def term_names(text, terms: Iterable[tuple[str, str, bool]], literal: bool = True, unicode: bool = False) -> Column:
    """Sorted names that occur in a text."""
    index = TermIndex(terms, literal, unicode)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({name for name, _, _ in index.places(t)}) if t else [])

    return found(as_col(text))


def term_excerpts(names, text_cols: Sequence, terms: Iterable[tuple[str, str, bool]], window: int = WINDOW) -> Column:
    """For each name of an array the text around its first match in the first column that has one, else null."""
    index = TermIndex(terms)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def excerpts(wanted: pd.Series, *columns: pd.Series) -> pd.Series:
        out = []
        for own, *texts in zip(wanted, *columns):
            if own is None or not len(own):
                out.append([])
                continue
            places = index.first(texts)
            out.append([around(texts[p[0]], p[1], p[2], window) if (p := places.get(name)) else None for name in own])
        return pd.Series(out)

    return excerpts(as_col(names), *[as_col(c) for c in text_cols])


def find_terms(df: DataFrame, id_cols: Sequence[str], text_cols: Sequence[str], dictionary: DataFrame, literal: bool = True, window: int = WINDOW) -> DataFrame:
    """``(ids…, name, column, start, length, excerpt)``: every place where a form of ``dictionary(name, form[, cased])`` occurs.

    One scan of the texts; rows leave it for matches alone while the dictionary has at most ``MAX_FORMS``
    forms. ``column`` and ``start`` count from 0. Null texts and forms have no match.
    """
    if "cased" not in dictionary.columns:
        dictionary = dictionary.withColumn("cased", F.lit(False))
    forms = dictionary.select("name", "form", F.coalesce("cased", F.lit(False)).alias("cased")).filter("name IS NOT NULL AND form <> ''").distinct()
    some = forms.limit(MAX_FORMS + 1).collect()
    if len(some) > MAX_FORMS:
        return _joined_terms(df, id_cols, text_cols, forms, literal, window)
    index = TermIndex(((r.name, r.form, r.cased) for r in some), literal)
    return _per_text(df, id_cols, text_cols, lambda text: ((name, start, length, around(text, start, length, window)) for name, start, length in index.places(text)),
                     [("name", T.StringType()), ("start", T.IntegerType()), ("length", T.IntegerType()), ("excerpt", T.StringType())]).select(*id_cols, "name", "column", "start", "length", "excerpt")


def _per_text(df: DataFrame, id_cols: Sequence[str], text_cols: Sequence[str], rows_of, fields) -> DataFrame:
    """The rows a function makes of each text, with the text's ids and column number."""
    taken = df.select(*id_cols, *[F.col(c).cast("string").alias(f"_text{k}") for k, c in enumerate(text_cols)])
    n = len(id_cols)
    schema = T.StructType([*taken.schema.fields[:n], T.StructField("column", T.IntegerType()), *(T.StructField(name, kind) for name, kind in fields)])
    arrow = [pa.int32(), *(pa.int32() if isinstance(kind, T.IntegerType) else pa.string() for _, kind in fields)]

    def work(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                place, rows = [], []
                for k in range(len(text_cols)):
                    for i, text in enumerate(part.column(n + k).to_pylist()):
                        if text:
                            found = [(k, *r) for r in rows_of(text)]
                            rows += found
                            place += [i] * len(found)
                ids = part.select(list(range(n))).take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow))], schema.names)

    return taken.mapInArrow(work, schema)


def _joined_terms(df: DataFrame, id_cols: Sequence[str], text_cols: Sequence[str], forms: DataFrame, literal: bool, window: int) -> DataFrame:
    """The same by a join of the texts' words with the first words of the forms; a row carries the text in reach of the longest form."""
    tools = TermIndex((), literal)
    lower = F.translate("form", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = forms.select("name", "form", "cased", F.regexp_extract(lower, "[a-z0-9]+", 0).alias("word"))
    longest = keyed.agg(F.max(F.length("form"))).first()[0] or 0

    def words(text):
        folded = tools.fold(text)
        for token in tools.word.finditer(folded):
            low = max(0, token.start() - longest - window - 1)
            yield token.group(), token.start(), low, text[low : token.end() + (longest + window if literal else 10 * longest + window) + 1]

    spots = _per_text(df, id_cols, text_cols, words, [("word", T.StringType()), ("at", T.IntegerType()), ("low", T.IntegerType()), ("piece", T.StringType())])

    def check(batches):
        for batch in batches:
            out = []
            for i, (name, form, cased, at, low, piece) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 6, batch.num_columns)))):
                for own, start, length in TermIndex([(name, form, cased)], literal).places(piece):
                    lead = tools.word.search(tools.fold(form)).start() if literal else 0
                    if low + start + lead == at:
                        out.append((i, own, low + start, length, around(piece, start, length, window)))
            ids = batch.select(list(range(batch.num_columns - 6))).take(pa.array([r[0] for r in out], pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array([r[k + 1] for r in out], kind) for k, kind in enumerate(kinds))], names)

    joined = spots.join(keyed, "word").select(*id_cols, "column", "name", "form", "cased", "at", "low", "piece")
    names = [*id_cols, "column", "name", "start", "length", "excerpt"]
    schema = T.StructType([*joined.schema.fields[: len(id_cols) + 1], T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("excerpt", T.StringType())])
    found = joined.mapInArrow(check, schema)
    best = found.groupBy(*id_cols, "column", "name", "start").agg(F.max(F.struct("length", "excerpt")).alias("best"))
    return best.select(*id_cols, "name", "column", "start", "best.length", "best.excerpt")
