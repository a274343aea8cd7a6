"""Language of whole texts and of their spans: per-word scores, script ranges, and Viterbi with a switching penalty.

The model is a table of character n-gram log-probabilities per language, hashed
to a fixed number of slots. A word's score for a language is the sum over its
n-grams; a language that does not use the word's scripts is no candidate for it.
Viterbi over the words of a text, where a change of language costs a penalty,
labels the spans; the text's language is that of most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import byte_slices, tidied
from caselens.operators.ordered import top_n
from caselens.session import materialize

SLOTS = 1 << 16
SAMPLE = 1000  # training rows per language at most
PENALTY = 12.0
MIN_SHARE = 0.01  # of a language's letters, for a script to be one of its own
UNKNOWN = "und"
BATCH = 1 << 19  # bytes of text whose n-grams are held at once: about a hundred bytes each

# First code point of each range of the Unicode scripts that are told apart; 0 stands for no letter of its own.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
           (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
           (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
           (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
           (0x20000, "han"), (0x32000, "other")]
NAMES = sorted({n for _, n in SCRIPTS})
STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
OF_RANGE = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
KANA, HAN, OTHER = (NAMES.index(n) for n in ("kana", "han", "other"))

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point: is it a letter? Built once per worker."""
    if not _letters:
        flags = np.zeros(0x110000, bool)
        flags[:0x32000] = [chr(c).isalpha() for c in range(0x32000)]
        _letters.append(flags)
    return _letters[0]


class Words:
    """Words (runs of letters) of many texts at once, with hashed n-grams of one to four characters."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() + " " for t in texts]
        self.points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.array([len(t) for t in low], np.int64)
        is_letter = letters()[self.points]
        script = OF_RANGE[np.searchsorted(STARTS, self.points, side="right") - 1] if len(self.points) else np.empty(0, np.uint8)
        # a run of letters ends where its script does; han and kana stand together, and letters of no script of their own join any
        kind = np.where(script == KANA, HAN, script)
        edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
        turn = np.flatnonzero(is_letter[1:] & is_letter[:-1] & (kind[1:] != kind[:-1]) & (kind[1:] != OTHER) & (kind[:-1] != OTHER)) + 1
        self.start, self.end = np.sort(np.append(np.flatnonzero(edge == 1), turn)), np.sort(np.append(np.flatnonzero(edge == -1), turn))
        self.text = np.searchsorted(np.cumsum(self.lengths), self.start, side="right")
        # each word with a mark on either side
        n = self.end - self.start
        self.size = n
        self.first = np.cumsum(n + 2) - (n + 2)
        total = int((n + 2).sum())
        at = np.arange(total) - np.repeat(self.first, n + 2) - 1 + np.repeat(self.start, n + 2)
        marked = np.where((at < np.repeat(self.start, n + 2)) | (at >= np.repeat(self.end, n + 2)), np.uint32(0), self.points[at.clip(0, max(0, len(self.points) - 1))])
        left = np.arange(total) - np.repeat(self.first, n + 2)  # characters of the word before this one
        self.slots = []
        h = np.zeros(total, np.uint64)
        for size in range(1, 5):
            ok = left >= size - 1
            shifted = np.concatenate([np.zeros(size - 1, np.uint32), marked])[:total]
            h = h + (shifted.astype(np.uint64) + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * size + 1)) & (2**64 - 1))
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            if size > 1:
                self.slots.append((ok, (mixed >> np.uint64(48)).astype(np.int64)))
        self.script = script[self.start]
        if len(self.start):  # a run with kana among its han is one of kana
            kana = np.concatenate([[0], np.cumsum(script == KANA)])
            self.script = np.where(kana[self.end] > kana[self.start], KANA, self.script).astype(np.uint8)

    def counts(self, slots: int = SLOTS) -> np.ndarray:
        return sum((np.bincount(s[ok] & (slots - 1), minlength=slots) for ok, s in self.slots), np.zeros(slots, np.int64))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """(words, languages): log-probabilities of the n-grams of each word."""
        if not len(self.start):
            return np.zeros((0, table.shape[1]), np.float32)
        total = np.zeros((len(self.slots[0][0]), table.shape[1]), np.float32)
        for ok, s in self.slots:
            total += table[s & (len(table) - 1)] * ok[:, None]
        return np.add.reduceat(total, self.first, axis=0)


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; words of one text are neighbours in ``scores``. All texts advance together, the longest first in line."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    lengths = np.diff(np.append(begins, n))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with a word at each step
    back = np.zeros((n, k), np.int8 if k < 128 else np.int32)
    total = scores[begins].astype(np.float64)
    for step in range(1, int(lengths[0])):
        m = alive[step]
        now = total[:m]
        best = now.argmax(1)
        change = now[np.arange(m), best] - penalty
        stay = now >= change[:, None]
        at = begins[:m] + step
        back[at] = np.where(stay, np.arange(k), best[:, None])
        total[:m] = np.where(stay, now, change[:, None]) + scores[at]
    label = np.zeros(n, np.int64)
    here = total.argmax(1)
    for step in range(int(lengths[0]) - 1, -1, -1):
        m = alive[step]
        at = begins[:m] + step
        label[at] = here[:m]
        if step:
            here[:m] = back[at, here[:m]]
    return label


class Model:
    """Log-probabilities (slots, languages) and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        c = counts.T.astype(np.float64) + 0.5
        self.table = np.log(c / c.sum(0)).astype(np.float32)
        self.uses = scripts >= MIN_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))

    def label(self, texts: list[str | None], penalty: float = PENALTY):
        """Words, their labels (a language's number, or -1 where no language uses the word's script), and raw scores."""
        words = Words(texts)
        scores = words.scores(self.table)
        allowed = self.uses[:, words.script].T if len(words.script) else np.zeros((0, len(self.langs)), bool)
        known = allowed.any(1)
        narrowed = np.where(allowed, scores, np.where(known[:, None], np.float32(-1e6), np.float32(0)))
        label = viterbi(narrowed, words.text, penalty)
        return words, np.where(known, label, -1), scores

    def predict(self, texts: list[str | None], penalty: float = PENALTY) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """Language, share of the letters in its spans, and the spans (start, end, language) of every text."""
        k = len(self.langs)
        if not k:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        words, label, raw = self.label(texts, penalty)
        weight = np.zeros((len(texts), k + 1))
        np.add.at(weight, (words.text, label), words.size)
        best = weight[:, :k].argmax(1)
        top, all_letters = weight[np.arange(len(texts)), best], weight.sum(1)
        for t in np.flatnonzero((top == 0) & (all_letters > 0)):  # foreign scripts only: the best of bad guesses, with score 0
            best[t] = raw[words.text == t].sum(0).argmax()
        langs = [self.langs[b] if n else UNKNOWN for b, n in zip(best, all_letters)]
        score = np.divide(top, all_letters, out=np.zeros(len(texts)), where=all_letters > 0)
        spans: list[list] = [[] for _ in texts]
        if len(label):
            new = np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(label)) - 1
            base = np.cumsum(words.lengths) - words.lengths
            for f, e in zip(first.tolist(), last.tolist()):
                t = int(words.text[f])
                spans[t].append((int(words.start[f] - base[t]), int(words.end[e] - base[t]), self.langs[label[f]] if label[f] >= 0 else UNKNOWN))
        return langs, score.tolist(), spans


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a language, at most ``sample`` per language (those of the smallest hash of their id).

    Counts are made by tasks, one row of a fixed number of slots per language, and
    added up here. Without such rows the model knows no language.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null")
    # a first cut by hash leaves about twice the sample, so a language with most rows does not meet in one task
    ids = rows.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h"))
    counts = materialize(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    near = ids.join(counts, "lang").filter(F.col("h") * F.col("n") <= F.lit(2.0 * (sample + 100) * (1 << 31)))
    few = materialize(top_n(near, ["lang"], [F.asc("h"), F.col("id")], sample).select("id", "lang").distinct(), "sample")
    chosen = rows.join(few, ["id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for part in byte_slices(batch, limit=BATCH):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    words = Words([t for t, x in zip(texts, langs) if x == lang])
                    one = [words.counts(), np.bincount(words.script, weights=words.size, minlength=len(NAMES))]
                    sums[lang] = [a + b for a, b in zip(sums[lang], one)] if lang in sums else one
        for lang, (grams, scripts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([grams.astype("<i8").tobytes()]), pa.array([scripts.astype("<i8").tobytes()])], ["lang", "grams", "scripts"])

    def add(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum(np.frombuffer(x, "<i8") for x in df[c]).tobytes()
        return pd.DataFrame({"lang": [key[0]], "grams": [total("grams")], "scripts": [total("scripts")]})

    kinds = "lang string, grams binary, scripts binary"
    got = sorted(chosen.mapInArrow(tidied(count), kinds).groupBy("lang").applyInPandas(add, kinds).collect(), key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["grams"], "<i8") for r in got]).reshape(len(got), SLOTS)
    scripts = np.array([np.frombuffer(r["scripts"], "<i8") for r in got]).reshape(len(got), len(NAMES))
    return Model([r["lang"] for r in got], counts, scripts)


def identify(docs: DataFrame, model: Model, keep: list[str], spans: bool = True, penalty: float = PENALTY, text_col: str = "text",
             names: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """The kept columns with language, score and, if asked, spans of every whole text, under ``names``.

    A null text, or one without letters, is ``und`` with score 0. One whose letters
    are all of scripts that no learned language uses gets the least unlikely
    language, with score 0 and spans ``und``. Ties go to the language that comes
    first in order of names. Rows repeat as they come; an empty table stays empty.
    """
    if clash := set(names) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    if spans:
        from pyspark.sql import types as T

        schema = schema.add(names[2], T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots times languages, whatever the data
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in byte_slices(batch, "__text", BATCH):
                langs, score, found = m.predict(part.column("__text").to_pylist(), penalty)
                more = [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    more.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in x] for x in found], kind))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], schema.names)

    plain = docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in keep])
    return plain.mapInArrow(tidied(run), schema)
