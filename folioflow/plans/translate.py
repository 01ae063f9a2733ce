"""The whole flow over nested documents: collect, pack, glossary, call, reconcile, write back, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.functions import text as X
from folioflow.operators import calls, gateway, quality, segments

KEY = ["doc_id", "chunk_no"]


@dataclass
class Settings:
    source_language: str = ""
    target_language: str = ""
    chunk_bytes: int = K.CHUNK_BYTES
    tolerance: float = K.LENGTH_TOLERANCE
    cell_text: str = "text"  # source_text also reads what the layout stage writes
    glossary: bool = False
    limits: gateway.Limits = field(default_factory=gateway.Limits)


@dataclass
class Result:
    documents: DataFrame
    segments: DataFrame
    cache: DataFrame
    report: DataFrame
    errors: DataFrame | None = None


def with_languages(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs with both languages, from the settings or their own; a document without fails."""
    pick = lambda own, c: F.coalesce(F.lit(own) if own else F.lit(None), F.when(F.col(c) != "", F.col(c)), F.raise_error(F.lit(f"{c} is not set")))
    return docs.withColumn("source_language", pick(settings.source_language, "source_language")).withColumn("target_language", pick(settings.target_language, "target_language"))


def translate_documents(docs: DataFrame, cache: DataFrame, provider, settings: Settings, staging: str, write_seq: int = 1) -> Result:
    """Translates docs(doc_id and schemas.DOCUMENT).

    A chat model (with complete) gets whole chunks, see translate_chunks. A text provider (with
    translate) gets the distinct texts that the cache lacks.
    """
    docs = with_languages(docs, settings)
    if hasattr(provider, "complete"):
        found = translate_chunks(docs, provider, settings, staging)
        done, new, errors = found.segments, cache, found.errors
    else:
        found = segments.chunked_segments(docs, settings.chunk_bytes, settings.cell_text)
        done, new = calls.translate_texts(found, cache, provider, write_seq, staging)
        # A call that failed leaves the source text in place.
        done, errors = done.withColumn("translation", F.coalesce("translation", "text")), None
    back = segments.write_back(docs, done.select("doc_id", "seg_id", "translation"), settings.cell_text)
    return Result(back, done, new, quality.translation_report(done, settings.tolerance), errors)


@dataclass
class Chunked:
    segments: DataFrame
    errors: DataFrame


def _json(entries: Column, text: str = "text") -> Column:
    """The entries of a chunk as a JSON object from id to text."""
    return F.to_json(F.map_from_arrays(entries.seg_id, entries[text]))


def translate_chunks(docs: DataFrame, model, settings: Settings, staging: str) -> Chunked:
    """The segments of docs with translation, source_of and off, by a chat model that gets whole chunks.

    Four rounds, each called for and written to the folder staging once before it is read: all
    chunks; chunks with ids that did not come back; chunks that came back unchanged as a whole;
    the texts whose length is off, with the answer that was rejected. See calls.reconcile for
    how answers settle. With settings.glossary the terms of each document are collected first
    and every chunk gets those that it holds; a chunk whose terms cannot be had goes without.
    errors lists the calls that failed: (round, doc_id, chunk_no, error). off marks segments whose
    length stays off after the last round.
    """
    spark, limits = docs.sparkSession, settings.limits

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    failed, languages = [], ("source_language", "target_language")
    off = lambda e: F.coalesce(X.length_violation(e.t, e.text, settings.tolerance), F.lit(False))

    def noted(answers: DataFrame, name: str) -> DataFrame:
        failed.append(answers.where("error is not null").select(F.lit(name).alias("round"), *KEY, "error"))
        return answers

    def settled(rows: DataFrame, request: Column, name: str, settle: Callable[[Column], Column]) -> DataFrame:
        """rows called for, their entries settled with the map of answers (__m) that came back."""
        rows = gateway.with_replies(rows.drop("error"), request["system"], request["user"], model, limits)
        rows = calls.with_answers(rows, F.col("reply.answer"), "__m")
        rows = rows.withColumn("entries", settle(F.col("__m"))).select(*KEY, *languages, "glossary", "entries", F.col("reply.error").alias("error"))
        return noted(kept(rows, name), name)

    def answered(change: Callable[[Column, Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
        """Entries with t and source_of by change(entry, its answer)."""

        def one(m: Column, e: Column) -> Column:
            t, source_of = change(e, F.try_element_at(m, e.seg_id))
            return e.withField("t", t).withField("source_of", source_of)

        return lambda m: F.transform("entries", lambda e: one(m, e))

    chunks = kept(segments.chunk_rows(docs, settings.chunk_bytes, settings.cell_text, languages), "segments")
    entries = F.col("entries")
    if settings.glossary:
        asking = X.glossary_request(_json(entries), *languages)
        terms = noted(kept(gateway.call_requests(chunks.select(*KEY, asking.alias("request")).select(*KEY, "request.*"), KEY, model, limits), "terms"), "terms")
        terms = kept(calls.merge_glossary(calls.parse_terms(terms.where("answer is not null"), KEY)), "glossary")
        chunks = calls.with_glossary(chunks, F.array_join(entries.text, " "), terms, ["doc_id"], "glossary")
    else:
        chunks = chunks.withColumn("glossary", F.lit(""))
    request = X.translation_request(_json(entries), entries.seg_id, *languages, "glossary")
    more = lambda r, note: r.withField("user", F.concat(r["user"], note))

    # A chunk's row holds all that is known of it. Rounds after the first read and write only the rows that they
    # ask for again; the others stay where they are.
    lacking = F.exists("entries", lambda e: e.t.isNull())
    state = settled(chunks, request, "first", answered(lambda e, t: (t, F.when(t.isNotNull(), "first"))))
    second = lambda e, t: (F.coalesce(e.t, t, e.text), F.when(e.t.isNotNull(), e.source_of).when(t.isNotNull(), "retry").otherwise("source"))
    state = state.where(~lacking).unionByName(settled(state.where(lacking), more(request, F.lit(X.EVERY_ID)), "missing", answered(second)))
    same = F.forall("entries", lambda e: e.t == e.text)

    def other(m: Column) -> Column:
        still = F.forall("entries", lambda e: F.coalesce(F.try_element_at(m, e.seg_id) == e.text, F.lit(False)))
        third = answered(lambda e, t: (F.coalesce(t, e.t), F.when(t.isNotNull(), "unchanged").otherwise(e.source_of)))
        return F.when(still, entries).otherwise(third(m))

    state = state.where(~same).unionByName(settled(state.where(same), request, "unchanged", other))
    some = F.exists("entries", off)
    wrong = F.filter("entries", off)
    rejected = more(X.translation_request(_json(wrong), wrong.seg_id, *languages, F.lit("")), F.concat(F.lit(X.OTHER_LENGTHS), _json(wrong, "t")))
    last = lambda e, t: (F.when(off(e) & t.isNotNull(), t).otherwise(e.t), F.when(off(e) & t.isNotNull(), "length").otherwise(e.source_of))
    state = state.where(~some).unionByName(settled(state.where(some), rejected, "length", answered(last)))

    done = state.select(*KEY, *languages, F.explode("entries").alias("e")).withColumn("off", off(F.col("e")))
    places = [F.col(f"e.{c}") for c in ("page_pos", "elem_pos", "slot", "cell_pos", "write_key", "text")]
    done = done.select(*KEY, "e.seg_id", *languages, *places, F.col("e.t").alias("translation"), "e.source_of", "off")
    errors = failed[0]
    for x in failed[1:]:
        errors = errors.unionAll(x)
    return Chunked(done, errors)
