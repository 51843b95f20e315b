"""Language by words first: known words by their log frequency in each language, unseen ones by shorter and shorter character n-grams.

Training counts words and the character n-grams of their occurrences in a bounded sample of labelled rows (`sample_bytes` of text,
chosen by a hash of the id). Every word, n-gram and label of the sample is in the model, so the sample alone bounds it. A word or n-gram has
entries for the languages that it was seen in only; in any other it counts half an occurrence. The model is broadcast.
Prediction reads the whole text and nothing else.

A word is a run of letters, lower-cased. A language may lack n-grams of a length, if its words are short. A text without a letter, or null, is `und` with score 0. Ties go to
the language that sorts first. Rows are independent; a table without labelled rows, or an empty one,
gives `und` for every text with letters too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import batch, materialize

UNKNOWN = "und"


#: A letter, then letters and the marks that belong to them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same of texts without marks and numbers that are no digits, several times as fast.
_PLAIN = re.compile(r"[^\W\d_]+")


def _plain_characters() -> str:
    """The characters of the basic plane that both patterns take for the same, as ranges, and most pictographs."""
    same = [k for k in range(0x10000) if (kind := unicodedata.category(chr(k)))[0] != "M" and (kind[0] == "L") == bool(_PLAIN.match(chr(k)))]
    cuts = [0, *(k for k in range(1, len(same)) if same[k] != same[k - 1] + 1), len(same)]
    return "".join(f"\\U{same[a]:08x}-\\U{same[z - 1]:08x}" for a, z in zip(cuts, cuts[1:])) + "\\U0001f300-\\U0001faff"


_ALL_PLAIN = re.compile(f"[{_plain_characters()}]*")


def words_of(text: str) -> list[str]:
    return _PLAIN.findall(text) if _ALL_PLAIN.fullmatch(text) else WORD.findall(text)
LONGEST, REMEMBERED, PIECE = 5, 1 << 16, 1 << 12
#: Of the values of remembered unseen words in one process, about.
MEMORY_BYTES = 1 << 25


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies in each language: of words (size 0) and n-grams (their size), as what an entry adds to the value of none."""

    languages: list[str]
    #: For each size: the place of each word or n-gram, and each language's log frequency of half an occurrence.
    rows: list[dict[str, int]]
    none: np.ndarray
    #: The entries of place i are those from starts[i] to starts[i + 1].
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    #: Unseen words of this process, their places in its table of values.
    seen: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    #: The entries once more, as lists.
    lists: tuple[list[int], list[int], list[float]] | None = None

    def summed(self, places: np.ndarray) -> np.ndarray:
        """What all entries of these places add."""
        start = self.starts[places]
        n = self.starts[places + 1] - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.columns[at], self.values[at], len(self.languages))

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the word's longest n-grams of which some are known."""
        if self.lists is None:
            self.lists = self.starts.tolist(), self.columns.tolist(), self.values.tolist()
        starts, columns, values = self.lists
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [i for g in grams(word, n) if (i := self.rows[n].get(g)) is not None]
            if known:
                # a few entries, for which plain numbers are quicker than arrays
                total = [0.0] * len(self.languages)
                for i in known:
                    for e in range(starts[i], starts[i + 1]):
                        total[columns[e]] += values[e]
                return self.none[n] + np.array(total) / len(known)
        return np.zeros(len(self.languages))

    def remembered(self, words: list[str]) -> np.ndarray:
        """The sum over words that are not known, through the memory of this process."""
        most = max(1, min(REMEMBERED, MEMORY_BYTES // (8 * len(self.languages))))
        if self.table is None or len(self.table) != most:
            self.table = np.zeros((most, len(self.languages)))
            self.seen.clear()
        seen, total, size = self.seen, np.zeros(len(self.languages)), min(PIECE, most)
        for a in range(0, len(words), size):
            piece = words[a : a + size]
            new = set(piece).difference(seen)
            if len(seen) + len(new) > most:
                seen.clear()
                new = set(piece)
            for w in new:
                self.table[len(seen)] = self.unseen(w)
                seen[w] = len(seen)
            total += self.table[[seen[w] for w in piece]].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of((text or "").lower())
        if not words or not self.languages:
            return UNKNOWN, 0.0
        get = self.rows[0].get
        places = np.array([get(w, -1) for w in words])
        known = places[places >= 0]
        total = self.none[0] * len(known) + self.summed(known)
        if len(known) < len(words):
            total += self.remembered([words[k] for k in np.flatnonzero(places < 0)])
        p = np.exp(total - total.max())
        return self.languages[int(np.argmax(total))], float(p.max() / p.sum())


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 8 << 20) -> Model:
    """labelled: rows that may be learned from; rows with null text or language teach nothing."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 20)) < int(sample_bytes / size * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text.lower()))
        for lang, counter in found.items():
            parts = [Counter() for _ in range(LONGEST + 1)]
            for word, n in counter.items():
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        parts[size][g] += n
            parts[0] = counter
            for size, part in enumerate(parts):
                if part:
                    yield batch(lang=pa.array([lang] * len(part)), size=pa.array([size] * len(part), pa.int32()), gram=pa.array(list(part)), n=pa.array(list(part.values()), pa.int64()))

    # as large as the sample allows, so the driver may hold them
    counts = materialize(rows.select("text", "lang").mapInArrow(count, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))).toArrow().to_pandas()
    names = sorted(counts["lang"].unique())
    totals = np.zeros((LONGEST + 1, len(names)))
    column = counts["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64)
    np.add.at(totals, (counts["size"].to_numpy(np.int64), column), counts["n"].to_numpy(float))
    # a language without n-grams of a length is rated like the one with most
    totals = np.where(totals > 0, totals, np.maximum(totals.max(axis=1, keepdims=True, initial=0), 1))
    tables: list[dict[str, int]] = []
    starts, columns, values = [np.zeros(1, np.int64)], [], []
    for size in range(LONGEST + 1):
        mine = np.flatnonzero(counts["size"].to_numpy() == size)
        place, unique = pd.factorize(counts["gram"].to_numpy(object)[mine])
        begin, entries = sum(map(len, tables)), sum(map(len, columns))
        tables.append({g: begin + k for k, g in enumerate(unique.tolist())})
        order = np.lexsort((column[mine], place))
        starts.append(entries + np.cumsum(np.bincount(place, minlength=len(unique))))
        columns.append(column[mine][order])
        values.append(np.log(2.0 * counts["n"].to_numpy(float)[mine][order]))
    return Model(names, tables, np.log(0.5 / totals), np.concatenate(starts).astype(np.int64), np.concatenate(columns), np.concatenate(values))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            out = [known.predict(x.as_py()) for x in b.column(1)]
            yield batch(id=b.column(0), lang_pred=pa.array([x[0] for x in out], pa.string()), score=pa.array([x[1] for x in out], pa.float64()))

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", of: int = 4, at: int = 2) -> F.Column:
    """Rows that training leaves out: crc32 of the id as text modulo `of` is `at`. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == at, F.lit(False))
