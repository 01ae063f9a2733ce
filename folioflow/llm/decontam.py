"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other parameters keeps
its template. Template windows of the benchmark and of the documents meet by hash:

1. Every item chooses its rarest windows as seeds, one more than it may lack; so a document that
   holds enough of the item holds a seed, and a window that many items share draws few rows.
2. A seed found in a document proposes an alignment, the shift between item and document. Only
   there, and within a bounded number of words around it, the item's windows are compared.
3. A document holds the item if one alignment has at least 0.8 of the item's windows and one and
   the same document value stands for every occurrence of an item's value. Two values of an item
   may become one value: parameters that are drawn anew can coincide.

A capitalised word at the begin of a sentence may be a name or not. A document's window has both
readings there, the words as they are and all such words as names. An item's word is a name if the
item has it as one within a sentence. With other words that begin sentences the item has two
templates, one for each reading, and is held where a document holds one of them. So names are
replaced wherever they stand, and their slots tested.

Benchmark templates that are equal are one class, met once; the slots are tested for each way
in which the items of the class repeat values. The seeds are broadcast only below a checked
number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import documents, id_and_text, materialize, row_keys

WINDOW, COVERAGE = 5, 0.8
BROADCAST_WINDOWS = 1_000_000
#: Words of a document whose alignments travel together, so that no row grows with a document.
SPAN = 8192
SPACE = r"[\x20\x09-\x0D]+"
#: A capitalised word within a sentence; words all in capitals are none.
NAME = r"(?<=[^\s.!?:;\"'(][\x20\x09])\p{Lu}\p{Ll}\p{L}*"
#: A capitalised word at the begin of a sentence, as NAME takes the others, and the marks put around it.
BEGIN, OPEN, CLOSE = r"(?<![^\s\"'(])\p{Lu}\p{Ll}\p{L}*", "\x01", "\x02"
#: Punctuation, but for points and commas within numbers.
MARKS = r"(?=[.,;:!?\"'()])(?:(?<![0-9])[.,;:!?\"'()]+|[.,;:!?\"'()]+(?![0-9]))"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
UNITS = ("km", "m", "cm", "mm", "miles?", "feet", "ft", "inch(?:es)?", "kg", "g", "mg", "lbs?", "pounds?", "l", "ml", "lit(?:er|re)s?", "s", "ms", "seconds?", "min(?:utes?)?", "h", "hours?", "days?", "weeks?", "months?", "years?", "%", "percent", "dollars?", "euros?", "usd", "eur", "degrees?", "mph", "kmh", "kb", "mb", "gb", "tb", "w", "kw", "v", "hz")
SLOTS = ("<name>", "<num>", "<unit>", "<num><unit>")


def marked_words(text: Column) -> Column:
    """Words of a text with typed placeholders, capitals at the begin of sentences between marks; as many
    as plain_words gives."""
    t = F.regexp_replace(F.regexp_replace(text, NAME, "<name>"), BEGIN, f"{OPEN}$0{CLOSE}")
    t = F.lower(F.regexp_replace(t, MARKS, ""))
    t = F.regexp_replace(t, NUMBER, "<num>")
    t = F.regexp_replace(t, rf"<num>([\x20\x09]?){OPEN}?(?:{'|'.join(UNITS)}){CLOSE}?(?![\p{{L}}\p{{N}}])", "<num>$1<unit>")
    return F.array_remove(F.split(t, SPACE), "")


def _is_marked(word: Column) -> Column:
    return F.contains(word, F.lit(OPEN)) | F.contains(word, F.lit(CLOSE))


def _as_words(marked: Column | str) -> Column:
    """Marked words, the ones between marks read as plain words."""
    return F.transform(marked, lambda w: F.when(_is_marked(w), F.translate(w, OPEN + CLOSE, "")).otherwise(w))


def _as_names(marked: Column | str) -> Column:
    """Marked words, the ones between marks read as names."""
    return F.transform(marked, lambda w: F.when(_is_marked(w), F.translate(F.regexp_replace(w, f"{OPEN}[^{CLOSE}]*{CLOSE}", "<name>"), OPEN + CLOSE, "")).otherwise(w))


def template_words(text: Column) -> Column:
    """Words of a text with typed placeholders, those that begin sentences as plain words."""
    return _as_words(marked_words(text))


def plain_words(text: Column) -> Column:
    """Words of a text without punctuation, lower-cased."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, MARKS, "")), SPACE), "")


def _hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column | str, size: Column | int) -> Column:
    """Hashes of all runs of size word hashes; null if there are fewer words."""
    n, size = F.size(hashes), F.lit(size) if isinstance(size, int) else size
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size))))


def _windows_with(places: str, hashes: str, size: int) -> Column:
    """Structs (pos, window) of the windows that hold one of the places, which count from 1."""
    last = F.size(hashes) - size + 1
    begins = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(1), p - size + 1), F.least(p, last)))))
    return F.when(last >= 1, F.transform(begins, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(hashes, i, size)).alias("window"))))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row: the optimizer would put the expression of a plain column
    into the functions that read it, to be computed again for every element."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def classes(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (cls, items, words, forms, at, slots): one for each distinct template, of which an item has
    one or two. forms holds a struct (pattern, members) for each way in which slots share values: pattern
    gives for each slot the first one of the same kind and value, members the distinct values with their
    items. at: the places of the slots, from 0. cls: a struct of two hashes that names the class."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = _once(rows.where("item is not null"), "marked", marked_words(F.col("text"))).select("item", "marked", plain_words(F.col("text")).alias("plain"))
    # Words that begin sentences and are names within others are names in both readings.
    names = F.transform(F.filter(F.arrays_zip("marked", "plain"), lambda x: x.marked == "<name>"), lambda x: x.plain)
    rows = rows.withColumn("names", names)
    whole = lambda w, p: w == F.concat(F.lit(OPEN), p, F.lit(CLOSE))
    settled = F.zip_with("marked", "plain", lambda w, p: F.when(whole(w, p) & F.array_contains("names", p), "<name>").otherwise(w))
    rows = _once(rows, "known", settled)
    rows = rows.select("item", "plain", F.explode(F.array_distinct(F.array(_as_words("known"), _as_names("known")))).alias("words"))
    both = F.filter(F.arrays_zip("words", "plain"), lambda x: x.words.isin(*SLOTS))
    rows = rows.withColumn("both", both).withColumn("pattern", F.transform("both", lambda x: F.array_position("both", x).cast("int"))).withColumn("own", F.col("both.plain"))
    held = rows.groupBy("words", "pattern", "own").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = held.groupBy("words", "pattern").agg(F.collect_list(F.struct("own", "items")).alias("members"))
    held = held.groupBy("words").agg(F.collect_list(F.struct("pattern", "members")).alias("forms"))
    held = held.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten("forms.members"), lambda m: m["items"])))))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*SLOTS), i)), lambda i: i.isNotNull())
    return held.withColumn("cls", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))).withColumn("at", at).withColumn("slots", F.size("at") > 0)


def _indexed(benchmark: DataFrame, item_col: str, text_col: str, window: int, coverage: float) -> DataFrame:
    """The classes with the window size, the hashes of all windows, the number of words that an alignment
    may drift by, and the number of seeds. A template with fewer words than a window is one window of
    all its words."""
    held = classes(benchmark, item_col, text_col).where(F.size("words") > 0)
    held = held.withColumn("short", F.size("words") < window).withColumn("size", F.least(F.lit(window), F.size("words")))
    held = held.withColumn("hashes", _hashes("words")).withColumn("windows", _windows("hashes", F.col("size"))).drop("hashes")
    spare = F.floor(F.size("windows") * F.lit(1 - coverage)).cast("int")
    return held.withColumn("drift", F.greatest(F.lit(1), spare)).withColumn("seeds", F.least(F.size("windows"), spare + 2))


def _seeds(bench: DataFrame) -> DataFrame:
    """Rows (window, cls, item_pos): the rarest windows of each class, as many as seeds says."""
    each = bench.select("cls", "seeds", F.posexplode("windows").alias("item_pos", "window"))
    common = each.groupBy("window").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cls").orderBy("n", "item_pos")
    return each.join(common, "window").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("seeds")).select("window", "cls", "item_pos")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, coverage: float) -> DataFrame:
    """contaminated() with the keys of the rows."""
    bench = materialize(_indexed(benchmark, item_col, item_text_col, window, coverage), "benchmark")
    seeds = materialize(_seeds(bench), "seeds")
    small = seeds.count() <= BROADCAST_WINDOWS
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect()) or [window]  # at most window rows
    rows = id_and_text(docs, id_col, text_col).where("text is not null").select(*row_keys("id", "text"), "id", "text")

    # Both readings of each text: h with the words that begin sentences as they are, g with them as names.
    marked = F.filter(F.transform("w", lambda w, i: F.when(_is_marked(w), i + 1)), lambda i: i.isNotNull())
    hashed = _once(rows, "w", marked_words(F.col("text"))).select("k1", "k2", _hashes(_as_words("w")).alias("h"), _hashes(_as_names("w")).alias("g"), marked.alias("marked"))
    # The outer form, as for the other the optimizer computes the arrays once more to test their sizes.
    none = F.array().cast("array<struct<pos: int, window: bigint>>")
    each = [F.coalesce(x, none) for n in sizes for x in (F.transform(_windows("h", n), lambda w, i: F.struct(i.alias("pos"), w.alias("window"))), _windows_with("marked", "g", n))]
    own = hashed.select("k1", "k2", F.explode_outer(F.concat(*each)).alias("w")).select("k1", "k2", "w.pos", "w.window")
    met = own.where("window is not null").join(F.broadcast(seeds) if small else seeds, "window")
    met = met.select("k1", "k2", "cls", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    # Written first, so that its true size decides whether it goes to the documents or both are dealt out.
    met = materialize(met, "alignments").join(bench.select("cls", "drift", F.size("words").alias("n")), "cls")
    place = F.struct("cls", "shift", F.greatest(F.lit(0), F.col("shift") - F.col("drift")).alias("begin"), (F.col("n") + 2 * F.col("drift")).alias("len"))
    met = met.groupBy("k1", "k2", F.floor(F.col("shift") / SPAN).alias("span")).agg(F.collect_list(place).alias("places"))

    # The words around each alignment, of the template and of the text.
    around = rows.join(met.hint("shuffle_hash"), ["k1", "k2"])
    around = _once(around, "w", F.struct(marked_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("p"))).drop("text")
    part = lambda x, c: F.slice(F.col(f"w.{c}"), x.begin + 1, x.len)
    around = around.select("k1", "k2", "id", F.explode(F.transform("places", lambda x: F.struct(x.cls.alias("cls"), x.shift.alias("shift"), x.begin.alias("begin"), part(x, "t").alias("t"), part(x, "p").alias("p")))).alias("x"))
    around = around.select("k1", "k2", "id", "x.*").join(bench.select("cls", "size", "windows", "drift", "at"), "cls")
    around = _once(around, "h", F.struct(_hashes(_as_words("t")).alias("h"), _hashes(_as_names("t")).alias("g"))).drop("t")
    around = _once(around, "there", F.arrays_zip(_windows("h.h", F.col("size")).alias("h"), _windows("h.g", F.col("size")).alias("g"))).drop("h")
    around = _once(around, "shifts", F.transform(F.sequence(F.lit(0), 2 * F.col("drift")), lambda k: F.when(k % 2 == 0, F.floor(k / 2)).otherwise(-F.floor((k + 1) / 2)).cast("int")))

    # For each window of the item the nearest shift at which the document has it, or null.
    def step(w: Column, j: Column) -> Column:
        here = lambda x: F.get("there", j + F.col("shift") + x - F.col("begin"))
        return F.get(F.filter("shifts", lambda x: (here(x)["h"] == w) | (here(x)["g"] == w)), F.lit(0))

    lines = _once(around, "steps", F.transform("windows", step)).withColumn("windows", F.size("windows"))
    lines = lines.withColumn("matched", F.size(F.filter("steps", lambda x: x.isNotNull()))).where(F.col("matched") >= F.lit(coverage) * F.col("windows"))
    at = F.transform("steps", lambda x, j: F.when(x.isNotNull(), j + F.col("shift") + x))
    lines = lines.withColumn("start", F.array_min(at).cast("long")).withColumn("end", (F.array_max(at) + F.col("size")).cast("long"))
    # The document's value for each slot, by a window that covers it; null where there is none.
    covering = lambda i: F.filter(F.slice("steps", F.greatest(F.lit(1), i - F.col("size") + 2), F.least(F.col("size"), i + 1)), lambda x: x.isNotNull())
    value = lambda i: F.get("p", i + F.col("shift") + F.get(covering(i), F.lit(0)) - F.col("begin"))
    lines = materialize(lines.withColumn("values", F.transform("at", value)).select("k1", "k2", "id", "cls", F.col("windows").cast("long").alias("windows"), F.col("matched").cast("long").alias("matched"), "start", "end", "values"), "held")

    held = lines.join(bench.select("cls", "forms", "slots", "short", "items"), "cls")
    columns = ["k1", "k2", "id", F.explode("items").alias("item"), "windows", "matched", "start", "end", "kind"]
    plain = held.where("not slots").withColumn("kind", F.lit("verbatim")).select(*columns)
    formed = held.where("slots").drop("items").withColumn("form", F.explode("forms"))
    pairs = F.array_distinct(F.filter(F.arrays_zip(F.col("form.pattern").alias("pattern"), F.col("values").alias("doc")), lambda p: p.doc.isNotNull()))
    formed = formed.withColumn("pairs", pairs).where(F.size("pairs") == F.size(F.array_distinct(F.col("pairs.pattern"))))
    formed = formed.withColumn("member", F.explode("form.members")).withColumn("items", F.col("member.items"))
    same = F.forall(F.zip_with("member.own", "values", lambda own, doc: doc.isNull() | (own == doc)), lambda x: x)
    formed = formed.withColumn("kind", F.when(F.size("pairs") == 0, "partial").when(same, "verbatim").otherwise("reparameterised"))
    formed = formed.where(~F.col("short") | (F.col("kind") == "verbatim")).select(*columns)
    best = F.max(F.struct("kind", "matched", (-F.col("start")).alias("back"), "end", "windows")).alias("best")
    found = plain.unionAll(formed).groupBy("k1", "k2", "id", "item").agg(best)
    return found.select("k1", "k2", "id", "item", "best.windows", "best.matched", (-F.col("best.back")).alias("start"), "best.end", "best.kind")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, null_ids: bool = False) -> DataFrame:
    """Pairs (id, item, windows, matched, start, end, kind) of documents and the items they hold.

    windows counts the item's windows of WINDOW words, matched those that one place of the document has, all
    within a fifth of the item's windows (at least one word) of one alignment. start and end are
    template words of the document, end exclusive. Of several places the best kind counts, then
    the one with most windows, then the first. kind is verbatim; reparameterised where slot
    values differ; partial where none of the item's slots lies in a window found. Letter case,
    but for the capitals that make names, and punctuation do not count. Capitals that begin sentences
    may make names; where an item's two readings both fit, the better of them counts. An item with fewer words
    than a window must be there with all its words and its own values. A null or empty text or
    item holds nothing and is in nothing; items without an id give no rows, documents without one
    only with null_ids. Each row of docs is judged by itself; equal rows give one row an item,
    rows with one id and other texts their own. Repeated items each give their row. Other columns
    are not read. Empty tables give no rows.
    """
    docs = docs if null_ids else docs.where(F.col(f"`{id_col}`").isNotNull())
    return _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage).drop("k1", "k2")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; see contaminated.

    Each row is judged by itself, whether its id is null or repeated.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage)
    # Written first, so that its true size decides how the documents meet it.
    bad = materialize(found.select("k1", "k2").distinct(), "contaminated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys(id_col, text_col))
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "matched", "start", "end", "kind")
