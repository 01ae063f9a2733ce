"""From nested documents to numbered segments and byte-bounded chunks, and back.

Collecting, numbering and packing work within the row of a document and do not shuffle; putting
results back joins documents with their translations once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import schemas
from folioflow.functions import constants as K
from folioflow.functions import text as X

SLOTS = ("translated_text", "translated_latex", "translated_text")


def _segment(page: Column, elem: Column, slot: int, cell: Column, value: Column, wanted: Column) -> Column:
    parts = {"page_pos": page.cast("int"), "elem_pos": elem.cast("int"), "slot": F.lit(slot), "cell_pos": cell.cast("int"), "write_key": F.lit(SLOTS[slot]), "text": value}
    return F.struct(*[c.alias(n) for n, c in parts.items()], F.coalesce(wanted, F.lit(False)).alias("wanted"))


def segments_of(pages: Column | str, cell_text: str = "text") -> Column:
    """The translatable segments of a document's pages, depth first, as an array of structs.

    Element text counts if it is not empty, not of category BYPASS and not only an equation;
    latex and cells count if they hold plain text. cell_text names the cell field that is read;
    source_text reads what the layout stage writes.
    """
    pages = F.col(pages) if isinstance(pages, str) else pages

    def element(p: Column, e: Column, j: Column) -> Column:
        text, latex = F.coalesce(e.source_text, F.lit("")), F.coalesce(e.latex, F.lit(""))
        none = F.lit(None).cast("int")
        own = _segment(p, j, 0, none, text, (text != "") & (F.coalesce(e.category, F.lit("")) != "BYPASS") & ~X.is_equation_only(text))
        tex = _segment(p, j, 1, none, latex, (latex != "") & X.is_plain_text(latex))
        cells = F.transform(F.coalesce(e.cells, F.array().cast(f"array<{schemas.CELL}>")), lambda c, k: _segment(p, j, 2, k, F.coalesce(c[cell_text], F.lit("")), X.is_plain_text(F.coalesce(c[cell_text], F.lit("")))))
        return F.concat(F.array(own, tex), cells)

    each = F.flatten(F.transform(pages, lambda p, i: F.flatten(F.transform(F.coalesce(p.elements, F.array().cast(f"array<{schemas.ELEMENT}>")), lambda e, j: element(i, e, j)))))
    return F.filter(each, lambda s: s.wanted)


def collect_segments(docs: DataFrame, cell_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per segment of docs(doc_id, pages); seg_id counts from 0 in each document. carry: more columns of docs to keep."""
    # The outer form, as for the other one the optimizer computes the segments once more to count them.
    found = docs.select("doc_id", *carry, F.posexplode_outer(segments_of("pages", cell_text)).alias("pos", "s")).where("s is not null")
    return found.select("doc_id", *carry, F.col("pos").cast("string").alias("seg_id"), "s.page_pos", "s.elem_pos", "s.slot", "s.cell_pos", "s.write_key", "s.text")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _next_fit(sizes: pd.Series, limit: pd.Series) -> pd.Series:
    def fold(own, most):
        out, chunk, used = [], -1, 0
        for n in own:
            # Braces come once per chunk, a separator between entries.
            if chunk < 0 or used + 2 + n > most:
                chunk, used = chunk + 1, 2 + n
            else:
                used += 2 + n
            out.append(chunk)
        return out

    return pd.Series([None if s is None else fold(s.tolist(), m) for s, m in zip(sizes, limit, strict=True)])


def entry_bytes(seg_id: Column, text: Column) -> Column:
    """Bytes of one "id": "text" entry of a JSON object."""
    return F.octet_length(seg_id) + 4 + X.json_bytes(text)


def chunk_numbers(sizes: Column, max_bytes: int = K.CHUNK_BYTES) -> Column:
    """Next fit: the chunk of each entry of an array of entry sizes. The reset depends on the
    running size, so this is a fold, in Arrow batches; an entry too large lies alone."""
    return _next_fit(sizes, F.lit(max_bytes))


def chunked_segments(docs: DataFrame, max_bytes: int = K.CHUNK_BYTES, cell_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """collect_segments with chunk_no, in one pass over docs."""
    held = docs.select("doc_id", *carry, segments_of("pages", cell_text).alias("segs"))
    sizes = F.transform("segs", lambda s, i: entry_bytes(i.cast("string"), s.text))
    held = held.withColumn("chunks", chunk_numbers(sizes, max_bytes))
    found = held.select("doc_id", *carry, F.posexplode_outer(F.arrays_zip("segs", "chunks")).alias("pos", "z")).where("z is not null")
    return found.select("doc_id", *carry, F.col("pos").cast("string").alias("seg_id"), "z.segs.page_pos", "z.segs.elem_pos", "z.segs.slot", "z.segs.cell_pos", "z.segs.write_key", "z.segs.text", F.col("z.chunks").alias("chunk_no"))


def chunk_rows(docs: DataFrame, max_bytes: int = K.CHUNK_BYTES, cell_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk of chunked_segments, with its segments in order as an array of structs (entries), without a shuffle."""
    held = docs.select("doc_id", *carry, segments_of("pages", cell_text).alias("segs"))
    sizes = F.transform("segs", lambda s, i: entry_bytes(i.cast("string"), s.text))
    held = held.withColumn("chunks", chunk_numbers(sizes, max_bytes))
    fields = ("page_pos", "elem_pos", "slot", "cell_pos", "write_key", "text")
    held = held.withColumn("segs", F.transform("segs", lambda s, i: F.struct(i.cast("string").alias("seg_id"), *[s[f].alias(f) for f in fields])))
    # The entries of a chunk lie side by side.
    own = lambda k: F.slice("segs", F.array_position("chunks", k).cast("int"), F.size(F.filter("chunks", lambda c: c == k)))
    rows = F.transform(F.sequence(F.lit(0), F.array_max("chunks")), lambda k: F.struct(k.alias("chunk_no"), own(k).alias("entries")))
    return held.select("doc_id", *carry, F.explode_outer(rows).alias("z")).where("z is not null").select("doc_id", *carry, "z.chunk_no", "z.entries")


def payloads(chunked: DataFrame) -> DataFrame:
    """One row per chunk with its segments as a map from id to text, and as JSON."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct(F.col("seg_id").cast("int").alias("n"), "seg_id", "text"))), lambda s: F.struct(s.seg_id, s.text))
    found = chunked.groupBy("doc_id", "chunk_no").agg(F.map_from_entries(entries).alias("payload"))
    return found.withColumn("json", F.to_json("payload"))


def example_ids(ids: Column | str) -> Column:
    """The first two ids of a chunk."""
    return F.slice(ids, 1, 2)


def write_back(docs: DataFrame, translations: DataFrame, cell_text: str = "text") -> DataFrame:
    """docs with the translations(doc_id, seg_id, translation) put into their records.

    Segments without a translation keep what they have, so absent fields stay absent in JSON.
    """
    known = translations.where("translation is not null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("seg_id", "translation"))).alias("__t"))
    placed = docs.join(known, "doc_id", "left").withColumn("__s", segments_of("pages", cell_text))
    key = lambda p, e, slot, c: F.concat_ws(":", p.cast("string"), e.cast("string"), F.lit(str(slot)), c)
    none = F.lit("")
    entries = F.transform("__s", lambda s, i: F.struct(key(s.page_pos, s.elem_pos, 0, none).alias("k"), s.slot.alias("slot"), s.cell_pos.alias("cell"), s.page_pos.alias("p"), s.elem_pos.alias("e"), F.try_element_at(F.coalesce("__t", F.create_map().cast("map<string,string>")), i.cast("string")).alias("t")))
    entries = F.filter(entries, lambda x: x.t.isNotNull())
    placed = placed.withColumn("__m", F.map_from_entries(F.transform(entries, lambda x: F.struct(F.concat_ws(":", x.p.cast("string"), x.e.cast("string"), x.slot.cast("string"), F.coalesce(x.cell.cast("string"), none)).alias("k"), x.t.alias("v")))))
    get = lambda p, e, slot, c: F.try_element_at(F.col("__m"), key(p, e, slot, c))
    cell = lambda c, i, j, k: c.withField("translated_text", F.coalesce(get(i, j, 2, k.cast("string")), c.translated_text))
    elem = lambda e, i, j: e.withField("translated_text", F.coalesce(get(i, j, 0, none), e.translated_text)).withField("translated_latex", F.coalesce(get(i, j, 1, none), e.translated_latex)).withField("cells", F.transform(e.cells, lambda c, k: cell(c, i, j, k)))
    pages = F.transform("pages", lambda p, i: p.withField("elements", F.transform(p.elements, lambda e, j: elem(e, i, j))))
    return placed.withColumn("pages", pages).drop("__t", "__s", "__m")


def lines_as_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts as nested documents: one page, one flowing element per line."""
    element = lambda line: F.struct(F.lit("Text").alias("label"), F.lit("FLOWING_TEXT").alias("category"), F.lit(None).cast("array<double>").alias("bbox_pdf"), line.alias("source_text"), F.lit(None).cast("string").alias("translated_text"), F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("translated_latex"), F.lit(None).cast(f"array<{schemas.CELL}>").alias("cells"))
    page = F.struct(F.lit(0).alias("page_index"), F.lit(None).cast("double").alias("page_width"), F.lit(None).cast("double").alias("page_height"), F.transform(F.split(text_col, "\n", -1), element).alias("elements"), F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("string").alias("chapter_id"))
    return df.withColumn("pages", F.array(page)).withColumnRenamed(id_col, "doc_id").drop(text_col) if id_col != "doc_id" else df.withColumn("pages", F.array(page)).drop(text_col)


def interleave(first: DataFrame, second: DataFrame, pos: str) -> DataFrame:
    """Pages of two variants in turn: position i of the first at 2i, of the second at 2i + 1."""
    return first.withColumn("out_pos", F.col(pos) * 2).unionByName(second.withColumn("out_pos", F.col(pos) * 2 + 1))


def apply_patches(objects: DataFrame, patches: DataFrame, key: str = "xref", value: str = "content") -> DataFrame:
    """objects with the values that patches(key, value) hold for them; other patches are new rows."""
    new = patches.select(key, F.col(value).alias("__new"))
    return objects.join(new, key, "full").select(key, F.coalesce("__new", value).alias(value))


def select_pages(pages: DataFrame, wanted: DataFrame | None, key: list[str]) -> DataFrame:
    """Only the wanted pages; None is all of them."""
    return pages if wanted is None else pages.join(wanted.select(*key).distinct(), key, "left_semi")


def pages_in_order(pages: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The pages of a list, in its order (column pos) and as often as it names them; unknown ones are skipped."""
    return wanted.join(pages, key)


def batch_number(pos: Column | str, size: int) -> Column:
    """The fixed-size batch of a position."""
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / size)


def sampled_positions(n: Column | str, most: int = K.SAMPLED_PAGES) -> Column:
    """All positions below n if there are at most so many, else that many evenly spread."""
    n = F.col(n) if isinstance(n, str) else n
    every = F.sequence(F.lit(0), n.cast("int") - 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * n / most).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, every).otherwise(even)
