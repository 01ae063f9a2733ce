"""The whole flow over the driver's documents, with a chat model that follows a script."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.functions import text as X
from folioflow.operators import gateway
from folioflow.plans import translate
from folioflow.plans.register import Register
from folioflow.plans.segment_queries import CHUNKS, _docs
from folioflow.staging import shared_dir

REGISTER = Register()


def payload_of(user: str) -> dict:
    """The texts that a request is about."""
    return json.loads(user.split(f"{X.INPUT}\n", 1)[1].split(f"\n{X.ANSWER}", 1)[0])


def scripted(system: str, user: str) -> str:
    """Answers with faults: leaves ids out, adds one, doubles texts, and mends that when asked again."""
    texts = payload_of(user)
    if system.startswith("You collect"):
        return json.dumps([{"src": " REWH ", "dst": "WHEN"}] if any("rewh" in t.lower() for t in texts.values()) else [])
    again, off, known = X.EVERY_ID in user, X.OTHER_LENGTHS in user, "rewh = WHEN" in system
    out = []
    for seg, text in texts.items():
        new = (text.replace("rewh", "WHEN") if known else text).replace("e", "3")
        if again or off or int(seg) % 11 != 5:
            out.append({"id": seg, "t": new if off or int(seg) % 13 != 7 else new + new})
    return "<think>as asked</think>" + json.dumps([*out, {"id": "unknown", "t": "x"}])


_NEW = "replace(replace(line, 'rewh', 'WHEN'), 'e', '3')"


@REGISTER(f"""WITH RECURSIVE {CHUNKS}, a AS (SELECT f.doc_id, f.chunk, f.seg, line, CASE WHEN f.seg % 13 = 7 THEN {_NEW} || {_NEW} ELSE {_NEW} END AS t, f.seg % 11 = 5 AS late, f.seg % 13 = 7 AND length(line) >= {K.LENGTH_MIN_CHARS} AS mended FROM f JOIN s ON s.doc_id = f.doc_id AND s.seg = f.seg),
c AS (SELECT doc_id, chunk, bool_and(t = line) AND bool_or(late) AS again FROM a GROUP BY doc_id, chunk)
SELECT a.doc_id, CAST(seg AS VARCHAR) AS seg_id, md5(CASE WHEN mended THEN replace(line, 'e', '3') ELSE t END) AS t_md5,
  CASE WHEN mended THEN 'length' WHEN late THEN 'retry' WHEN again THEN 'unchanged' ELSE 'first' END AS source_of, false AS off FROM a JOIN c ON c.doc_id = a.doc_id AND c.chunk = a.chunk""")
def translated_chunks(spark, sf_dir):
    """Every document through the whole
    flow, glossary and all rounds of calls included."""
    docs = _docs(spark, sf_dir).withColumn("source_language", F.lit("English")).withColumn("target_language", F.lit("Leet"))
    staging = f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}"
    found = translate.translate_chunks(docs, gateway.ScriptedModel(scripted), translate.Settings(glossary=True), staging)
    return found.segments.select("doc_id", "seg_id", F.md5("translation").alias("t_md5"), "source_of", "off")
