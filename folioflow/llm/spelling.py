"""Spelling variants: near words by a positional q-gram inverted index with a count filter.

1. Words are counted over the whole corpus, partly within tasks first.
2. Words are dealt to blocks: if two words are one edit apart, that edit lies in one half of the shorter, and
   they agree on the rest, prefix and suffix. A block that holds more words than one task should take is
   dealt again by halves of the half, down to single code points, where a block is small by
   the size of the alphabet. So no block grows with the corpus and no pair is lost.
3. In a block an inverted index maps each gram of two code points (words are padded) to words and
   places by length. One edit destroys at most two of a word's grams and moves others by one place at most, so
   all but two must be held by a near word there. The postings of a word's shortest lists, as many as must
   hold each near word, are merged by a heap; what they propose is counted over all grams, and pairs that
   reach the bound are verified. A pair is reported by the one block in which its first difference lies.
4. Each word's form is the most frequent near word, if that is much more frequent; roots follow forms
   by joins that double their reach.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import build_side, documents, id_and_text, materialize, slices, split_join

#: Words that a block may hold, and distinct words that a task counts before it gives them out.
BLOCK_WORDS, COUNTED_AT_ONCE = 20_000, 400_000
GRAM = 2


def runs_of(least: int) -> re.Pattern:
    """Maximal runs of letters that are long enough for a word, even if they lose one."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def misspelt(run: str, prefix: int, every: int) -> str:
    """The run, less one code point where its checksum says so; prefix: the checksum of what comes before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, every: int | None = None) -> DataFrame:
    """(word, n) of all words of at least least_chars code points that occur at least least_n times.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With every, runs whose
    checksum with the document's id it divides lose one code point; a null id counts as empty.
    Null and empty texts have no words; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = runs_of(least_chars).findall, Counter()
        for b in slices(batches):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = Counter(find(t.lower().decode("utf-8", "replace"))) if t else {}
                if every and found:
                    prefix, crc = zlib.crc32(b"%d:" % i if i is not None else b":"), zlib.crc32
                    for r in [r for r in found if not crc(r.encode(), prefix) % every]:
                        n = found.pop(r)
                        r = misspelt(r, prefix, every)
                        if len(r) >= least_chars:
                            counts[r] += n
                counts.update(found)
            if len(counts) >= COUNTED_AT_ONCE:
                yield from out(counts)
                counts = Counter()
        yield from out(counts)

    def out(counts: Counter) -> Iterator[pa.RecordBatch]:
        yield from slices([pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])], 50_000)

    words = id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def first_difference(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is a with exactly one code point replaced or put in."""
    i = first_difference(a, b)
    return a != b and a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def agrees(a: str, b: str, end: int) -> bool:
    """Whether b is one edit from a and their first difference lies before end, or a ends there."""
    return one_edit(a, b) and (end == len(a) or first_difference(a, b) < end)


def grams(word: str) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def near_in_block(words: list[str], shorter: int, end: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) of near words, i the shorter or the earlier, that differ first before end. words: distinct, of
    shorter code points or one more; two of the longer ones are another block's pair."""
    held = [grams(w) for w in words]
    index: dict[tuple[int, int, str], list[int]] = {}
    for j, w in enumerate(words):
        size = len(w)
        for p, g in enumerate(held[j]):
            index.setdefault((size, p, g), []).append(j)
    none: list[int] = []
    for i, w in enumerate(words):
        if len(w) != shorter:
            continue
        own = held[i]
        # A code point replaced destroys GRAM grams and moves none, so any GRAM + 1 lists propose each near word of the
        # same length. One put in destroys GRAM - 1 and moves those behind it by one place.
        same = sorted((index[shorter, p, g] for p, g in enumerate(own)), key=len)[: GRAM + 1]
        if len(own) <= GRAM:  # a single code point, of which no gram need stay
            same = [[j for j, x in enumerate(words) if len(x) == shorter]]
        more = [[index.get((shorter + 1, p + d, g), none) for d in (0, 1)] for p, g in enumerate(own)]
        more = sorted(more, key=lambda x: len(x[0]) + len(x[1]))[:GRAM]
        before = i
        for j in heapq.merge(*same):
            if j > before:
                before = j
                if sum(map(str.__eq__, own, held[j])) >= len(own) - GRAM and agrees(w, words[j], end):
                    yield i, j
        before = -1
        for j in heapq.merge(*(x for pair in more for x in pair if x)):
            if j != before:
                before, other = j, held[j]
                if sum(g == other[p] or g == other[p + 1] for p, g in enumerate(own)) > len(own) - GRAM and agrees(w, words[j], end):
                    yield i, j


def near_words(words: DataFrame, block_words: int | None = None) -> DataFrame:
    """(word, n, near, near_n) for both orders of each pair of words(word, n), distinct, that differ by exactly one
    code point put in, left out or replaced. Words of one code point are near the others of one and two."""
    block_words = block_words or BLOCK_WORDS
    length = F.length("word")
    # For each word its blocks as the shorter of a pair and as the longer: the edit lies in [lo, hi) of the shorter.
    shorter = F.explode(F.array(length, length - 1)).alias("shorter")
    held = words.select("word", "n", shorter).where("shorter > 0")
    half = F.floor(F.col("shorter") / 2).cast("int")
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    parts = F.filter(F.array(part(F.lit(0), half), part(half, F.col("shorter"))), lambda x: x.lo < x.hi)
    held = held.withColumn("part", F.explode(parts)).select("word", "n", "shorter", "part.lo", "part.hi")

    def block(lo, hi):
        after = F.substring(F.col("word"), hi + F.length("word") - F.col("shorter") + 1, F.length("word"))
        return F.xxhash64("shorter", lo, hi, F.substring(F.col("word"), F.lit(1), lo), after)

    held = held.withColumn("block", block(F.col("lo"), F.col("hi")))
    done = None
    while True:
        sizes = held.groupBy("block", "lo", "hi").agg(F.count("*").alias("size"))
        large = materialize(sizes.where((F.col("size") > block_words) & (F.col("hi") - F.col("lo") > 1)).select("block"), "large-blocks")
        if large.isEmpty():
            break
        keep = held.join(build_side(large), "block", "left_anti")
        done = keep if done is None else done.unionByName(keep)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        split = held.join(build_side(large), "block", "left_semi").withColumn("part", F.explode(F.array(part(F.col("lo"), mid), part(mid, F.col("hi")))))
        split = split.select("word", "n", "shorter", "part.lo", "part.hi")
        held = materialize(split.withColumn("block", block(F.col("lo"), F.col("hi"))), "split-blocks")
    held = held if done is None else done.unionByName(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, found = None, [], [], []

        def close() -> None:
            if len(words) > 1 and len(words[0]) + len(words[-1]) < 2 * key[1] + 2:
                for i, j in near_in_block(words, key[1], key[3]):
                    found.append((words[i], counts[i], words[j], counts[j]))
                    found.append((words[j], counts[j], words[i], counts[i]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64()] * 2, strict=True)], ["word", "n", "near", "near_n"])

        for b in slices(batches, 8192):
            for *k, w, n in zip(*(b.column(c).to_pylist() for c in ("block", "shorter", "lo", "hi", "word", "n")), strict=True):
                if k != key:
                    close()
                    key, words, counts = k, [], []
                words.append(w)
                counts.append(n)
            if len(found) >= 50_000:
                yield out()
        close()
        yield out()

    dealt = held.select("block", "shorter", "lo", "hi", "word", "n").repartition("block").sortWithinPartitions("block", "shorter", "lo", "hi", F.length("word"))
    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """words(word, n), distinct, with n_near, the number of near words, form, form_n and root.

    form is the near word of largest n, of equal ones the first in code-point order, if its n is at least times
    the word's; else null, and form_n with it. root follows forms to the last; a word without a form is its
    own root. No words give no rows.
    """
    words = materialize(words, "words")
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    much = -F.col("best.less") >= times * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "forms")
    roots = materialize(best.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        # n grows times-fold with each step, so chains are short, and each round doubles the reach.
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            break
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "steps")
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, some of whose runs lost a letter, with their likely spelling."""
    return variants(count_words(documents(spark, sf_dir), every=199))


OP12_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM tokens GROUP BY ALL HAVING length(run) >= 6),
keyed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, xor(list_reduce([CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(length(x) // 2)],
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM keyed, poly),
typed AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gone FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b USING (i, gone) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.gone = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.gone = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM best),
walk(word, reached) AS (SELECT word, word FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.reached WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.reached AS root FROM walk w LEFT JOIN forms f ON f.word = w.reached WHERE f.form IS NULL)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN forms USING (word) JOIN roots USING (word)
"""
