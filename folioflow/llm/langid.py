"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, from the longest order down: a known n-gram scores by log frequency, an
unknown one by the mean of the two n-grams one shorter that it is made of.

The classifier is fitted on a bounded sample of labelled rows: in expectation at most
ROWS_PER_LANG rows and CHARS_PER_LANG characters of each language, chosen by a hash of the id.
Every word and n-gram of the sample counts; the model holds, sparsely, only the languages that
have an entry, so the sample's bound is also that of what is broadcast. Prediction reads the
whole text of every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import documents, slices

ROWS_PER_LANG, CHARS_PER_LANG = 5000, 50_000_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Scores that a worker keeps, of words and of n-grams, and the rows that hold them at least.
CACHE_CELLS, CACHE_ROWS = 400_000, 60_000
#: Unseen words scored at a time; longer ones are scored in portions of so many n-grams.
PORTION, LONGEST = 200, 200
#: Counts of n-grams that a worker holds at a time.
HELD_GRAMS = 150_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _grams(word: str, order: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _portions(word: str, order: int) -> Iterator[list[str]]:
    """All n-grams of a word, at most LONGEST at a time."""
    padded = f"\x02{word}\x03"
    ends = len(padded) - order + 1
    for a in range(0, ends, LONGEST):
        yield [padded[i : i + order] for i in range(a, min(a + LONGEST, ends))]


def _key(mark: str, key: str) -> int:
    """The 64-bit hash that stands for a word or, with the mark \\0, an n-gram in a model."""
    return xxhash.xxh3_64_intdigest((mark + key).encode("utf-8", "surrogatepass"))


class Model:
    """Log frequencies of words and n-grams, as arrays over the sorted hashes of all entries.

    An entry's kind is 0 for a word, else the order of the n-gram. base (kinds, languages) scores
    what a language lacks; entry i gains gain[j] in language which[j] for begin[i] <= j < begin[i + 1].
    """

    def __init__(self, langs: list[str], hashes: np.ndarray, kinds: np.ndarray, begin: np.ndarray, which: np.ndarray, gain: np.ndarray, base: np.ndarray, floor: np.ndarray):
        self.langs, self.hashes, self.kinds, self.begin, self.which, self.gain, self.base, self.floor = langs, hashes, kinds, begin, which, gain, base, floor
        self._ready = False

    def _prepare(self) -> None:
        """Room for the scores of words and n-grams met, built once where the model is used."""
        self._room = max(CACHE_ROWS, CACHE_CELLS // max(1, len(self.langs)))
        self._rows, self._gram_rows = (np.zeros((self._room, len(self.langs))) for _ in range(2))
        self._seen: dict[str, int] = {}
        self._seen_grams: dict[str, int] = {}
        self._ready = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")} | {"_ready": False}

    def _find(self, mark: str, keys: list[str]) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        own = np.fromiter((_key(mark, k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.hashes, own)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == own[known]
        return np.where(known, at, -1)

    def _known(self, ids: np.ndarray) -> np.ndarray:
        """Scores of entries of the model."""
        out = self.base[self.kinds[ids]]
        lens = self.begin[ids + 1] - self.begin[ids]
        ends = np.cumsum(lens)
        flat = np.repeat(self.begin[ids] - (ends - lens), lens) + np.arange(lens.sum())
        out[np.repeat(np.arange(len(ids)), lens), self.which[flat]] += self.gain[flat]
        return out

    def gram(self, g: str) -> np.ndarray:
        """Scores of an n-gram, known or backed off."""
        own = np.uint64(_key("\0", g))
        at = int(self.hashes.searchsorted(own))
        if at < len(self.hashes) and self.hashes[at] == own:
            a, z = self.begin[at], self.begin[at + 1]
            out = self.base[len(g)].copy()
            out[self.which[a:z]] += self.gain[a:z]
            return out
        return self.floor if len(g) == 1 else (self.gram(g[:-1]) + self.gram(g[1:])) / 2

    def _gram_row(self, g: str) -> int:
        at = self._seen_grams.get(g)
        if at is None:
            at = self._seen_grams[g] = len(self._seen_grams)
            self._gram_rows[at] = self.gram(g)
        return at

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not known: the means of their n-grams'."""
        if not self._ready:
            self._prepare()
        out = [np.empty((0, len(self.langs)))]
        for i in range(0, len(words), PORTION):
            self._make_room()
            rows, begin, long = [], [], {}
            for j, w in enumerate(words[i : i + PORTION]):
                begin.append(len(rows))
                if len(w) > LONGEST:
                    long[j] = w
                    w = w[:1]  # noqa: PLW2901
                rows += [self._gram_row(g) for g in _grams(w, min(ORDERS[0], len(w) + 2))]
            sizes = np.diff(np.append(begin, len(rows)))
            scores = np.add.reduceat(self._gram_rows[rows], begin) / sizes[:, None]
            for j, w in long.items():
                scores[j] = self._long(w)
            out.append(scores)
        return np.concatenate(out)

    def _make_room(self) -> None:
        if len(self._seen_grams) > self._room - PORTION * (LONGEST + 2):
            self._seen_grams.clear()

    def _long(self, word: str) -> np.ndarray:
        """Score of a long word: the mean of all its n-grams', summed in portions."""
        total, n = np.zeros(len(self.langs)), 0
        for part in _portions(word, ORDERS[0]):
            self._make_room()
            total += self._gram_rows[[self._gram_row(g) for g in part]].sum(0)
            n += len(part)
        return total / n

    def _scores(self, words: list[str]) -> np.ndarray:
        """Scores of words, known or not."""
        at = self._find("", words)
        out = np.empty((len(words), len(self.langs)))
        out[at >= 0] = self._known(at[at >= 0])
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self.unseen([words[i] for i in rest.tolist()])
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the probability of all languages, none preferred."""
        if not self._ready:
            self._prepare()
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        seen, total = self._seen, np.zeros(len(self.langs))
        new = [w for w in counts if w not in seen]
        if len(seen) + len(new) > self._room:
            seen.clear()
            new = list(counts)
        while len(new) > self._room:  # a text with more words than fit: some count at once
            part, new = new[: self._room], new[self._room :]
            total += np.array([counts.pop(w) for w in part], float) @ self._scores(part)
        if new:
            base = len(seen)
            self._rows[base : base + len(new)] = self._scores(new)
            seen.update(zip(new, range(base, base + len(new)), strict=True))
        at = [seen[w] for w in counts]
        total += np.fromiter(counts.values(), float, len(at)) @ self._rows[at]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1


def _counts(df: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w, c in Counter(words_of(text)).items():
                    found[lang, w] += c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "key", "n"])

    return df.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "key", "n"])

        for b in batches:
            found: Counter = Counter()
            for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "n")), strict=True):
                for order in ORDERS:
                    for part in _portions(w, order):
                        for g in part:
                            found[lang, g] += n
                        if len(found) > HELD_GRAMS:
                            yield out(found)
                            found.clear()
            yield out(found)

    return words.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> Model:
    """A model from rows (id, text, lang); rows without lang or with a null id teach nothing."""
    labelled = labelled.where("lang is not null and id is not null")
    # One row a language.
    sizes = {r.lang: (r.n, r.chars or 0) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    langs = sorted(sizes)
    if not langs:
        none = np.zeros(0, np.int64)
        return Model([], none.astype(np.uint64), none, np.zeros(1, np.int64), none, none.astype(float), np.zeros((len(ORDERS) + 1, 0)), none.astype(float))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows_per_lang / sizes[lang][0], chars_per_lang / max(1, sizes[lang][1])))])
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    words = _counts(sample.select("lang", "text")).cache()
    try:
        tables = [df.toArrow() for df in (words, _gram_counts(words))]  # as large as the bounded sample makes them
    finally:
        words.unpersist()
    number = {lang: i for i, lang in enumerate(langs)}
    hashes, kinds, entry, which, counts = [], [], [], [], []
    for mark, table in zip(("", "\0"), tables, strict=True):
        coded = table["key"].combine_chunks().dictionary_encode()
        entry.append(coded.indices.to_numpy().astype(np.int64) + sum(map(len, hashes)))
        hashes.append(np.fromiter((_key(mark, k.as_py()) for k in coded.dictionary), np.uint64, len(coded.dictionary)))
        kinds.append(pc.utf8_length(coded.dictionary).to_numpy().astype(np.int8) if mark else np.zeros(len(coded.dictionary), np.int8))
        own = table["lang"].combine_chunks().dictionary_encode()
        which.append(np.array([number[x] for x in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy()] if len(own) else np.zeros(0, np.int32))
        counts.append(table["n"].to_numpy().astype(float))
    hashes, kinds, entry, which, counts = map(np.concatenate, (hashes, kinds, entry, which, counts))
    order = np.argsort(hashes)
    hashes, kinds, entry = hashes[order], kinds[order], np.argsort(order)[entry]
    order = np.lexsort((which, entry))
    entry, which, counts = entry[order], which[order], counts[order]
    # A word's frequency is its share of the language's words, an n-gram's that of its order.
    whole = np.zeros((len(ORDERS) + 1, len(langs)))
    np.add.at(whole, (kinds[entry], which), counts)
    base = np.log(SMOOTH / (whole + SMOOTH * np.bincount(kinds, minlength=len(ORDERS) + 1)[:, None] + 1))
    floor = np.log(SMOOTH / (whole[0] + SMOOTH * len(hashes) + 1))
    return Model(langs, hashes, kinds, np.searchsorted(entry, np.arange(len(hashes) + 1)), which, np.log((counts + SMOOTH) / SMOOTH), base, floor)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with columns lang_pred and score; input columns of these names are replaced.

    lang_pred is a learned language, the first in order of equals, or und (score 0) if the text
    is null or has no letter, or if nothing was learned. Every row comes back once, with its text
    unless keep_text is false. Only the text takes part in a prediction.
    """
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            found = [own.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    # The text goes to the workers once, unless it has to be made a string first.
    own = text_col in keep and kept.schema[keep.index(text_col)].dataType == T.StringType()
    at = keep.index(text_col) if own else len(keep)
    text = [] if own else [F.col(f"`{text_col}`").cast("string").alias("text")]
    return docs.select(*carried, *text).mapInArrow(run, schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of docs that are not held out."""
    rows = docs.where(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return fit(rows)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document. A null doc_id counts as not held out and teaches nothing."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")), learn(docs), keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")
