"""Entities and relations from chunks by pluggable engines.

An engine turns texts into JSON payloads ``{"entities": [...], "relations": [...]}``, or, for a sequence
model, into generated text that marks triplets. Python runs only there; everything else is columns.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.functions.text import PROMPT_HEAD, PROMPT_TAIL, chunk_scoped_id, shorten_to_sentence, strip
from graphloom.operators.triplets import triplet_entities, triplet_relations
from graphloom.session import materialize

PAYLOAD = (
    "struct<entities: array<struct<id: string, label: string, type: string>>, "
    "relations: array<struct<source: string, target: string, type: string, evidence_span: string>>>"
)
#: Characters of a chunk that a sequence model sees.
MODEL_INPUT = 512

Engine = Callable[[], Callable[[str], str]]


class RateLimited(Exception):
    """An engine asks to be called again later."""


class ExtractionError(Exception):
    """An engine can't extract."""


def with_retry(call: Callable[[str], str], attempts: int = 3, delay: float = 1.0, sleep=time.sleep) -> Callable[[str], str]:
    """Call again after a rate limit, waiting twice as long each time; the last failure is raised."""

    def run(text: str) -> str:
        for attempt in range(attempts):
            try:
                return call(text)
            except RateLimited:
                if attempt == attempts - 1:
                    raise
                sleep(delay * 2**attempt)
        raise ExtractionError("no attempts")

    return run


def rule_based() -> Callable[[str], str]:
    """Deterministic and offline: capitalised names are entities, two names of a sentence are related."""
    name = re.compile(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*")

    def run(text: str) -> str:
        ids: dict[str, str] = {}
        relations = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            found = list(name.finditer(sentence))
            for m in found:
                ids.setdefault(m[0], f"n{len(ids)}")
            for a, b in zip(found, found[1:], strict=False):
                if a[0] != b[0]:
                    between = " ".join(re.findall(r"[a-z]+", sentence[a.end() : b.start()])[:3]) or "related_to"
                    span = sentence[a.start() : b.end()]
                    relations.append({"source": ids[a[0]], "target": ids[b[0]], "type": between, "evidence_span": span})
        entities = [{"id": i, "label": label, "type": "Concept"} for label, i in ids.items()]
        return json.dumps({"entities": entities, "relations": relations}, ensure_ascii=False)

    return run


def openai_engine(api_key: str | None, model: str = "gpt-4-turbo-preview") -> Engine:
    """Calls the service for each chunk, at temperature 0, again after rate limits."""
    if not api_key:
        raise ValueError("the openai engine needs an API key")

    def make() -> Callable[[str], str]:
        try:
            import openai
        except ImportError as e:
            raise ExtractionError("the openai package is not installed") from e
        client = openai.OpenAI(api_key=api_key)

        def call(text: str) -> str:
            try:
                answer = client.chat.completions.create(
                    model=model,
                    temperature=0,
                    response_format={"type": "json_object"},
                    messages=[
                        {"role": "system", "content": f"Answer with JSON of this form: {PAYLOAD}"},
                        {"role": "user", "content": PROMPT_HEAD + text + PROMPT_TAIL},
                    ],
                )
            except openai.RateLimitError as e:
                raise RateLimited(str(e)) from e
            return answer.choices[0].message.content or "{}"

        return with_retry(call)

    return make


def rebel_engine(model: str = "Babelscape/rebel-large") -> Engine:
    """Generates marked triplets with a local sequence model, one model for each worker."""

    def make() -> Callable[[str], str]:
        try:
            from transformers import pipeline
        except ImportError as e:
            raise ExtractionError("the transformers package is not installed") from e
        generate = pipeline("text2text-generation", model=model, device=-1)
        return lambda text: generate(text, max_length=256, num_beams=3, num_return_sequences=1)[0]["generated_text"]

    return make


def call_engine(chunks: DataFrame, engine: Engine, out: str = "payload") -> DataFrame:
    """``doc_id, chunk_id, {out}, error`` of each chunk that isn't blank; a failure fills ``error`` alone."""
    kinds = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("doc_id", "chunk_id")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = engine()
        for pdf in batches:
            values, errors = [], []
            for text in pdf["text"]:
                try:
                    values.append(call(text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one chunk's failure isn't the corpus's
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "chunk_id": pdf["chunk_id"], out: values, "error": errors})

    full = chunks.select("doc_id", "chunk_id", "text").where(F.col("text").isNotNull() & (strip(F.col("text")) != ""))
    return full.mapInPandas(run, f"{', '.join(kinds)}, {out} string, error string")


class Extraction:
    """``entities``, ``relations``, ``errors`` and the chunks they came from."""

    def __init__(self, entities: DataFrame, relations: DataFrame, errors: DataFrame, chunks: DataFrame):
        self.entities, self.relations, self.errors, self.chunks = entities, relations, errors, chunks

    def counts(self) -> DataFrame:
        """One row: chunks (blank and failed ones included), entities, relations."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return (
            one(self.chunks, "chunk_count")
            .join(one(self.entities, "entity_count"), how="cross")
            .join(one(self.relations, "relation_count"), how="cross")
        )


def from_payloads(chunks: DataFrame, called: DataFrame) -> Extraction:
    """Ids get their chunk's prefix, endpoints of relations as well."""
    parsed = called.withColumn("p", F.from_json("payload", PAYLOAD))
    # What isn't JSON of the form parses to null fields.
    errors = parsed.where(F.col("error").isNotNull() | (F.col("p.entities").isNull() & F.col("p.relations").isNull()))
    scoped = lambda c: chunk_scoped_id(F.col("chunk_id"), c)
    entities = parsed.select("doc_id", "chunk_id", F.posexplode("p.entities").alias("pos", "e")).select(
        "doc_id", "chunk_id", "pos", scoped(F.col("e.id")).alias("id"), "e.label", "e.type"
    )
    relations = parsed.select("doc_id", "chunk_id", F.posexplode("p.relations").alias("pos", "r")).select(
        "doc_id", "chunk_id", "pos",
        scoped(F.col("r.source")).alias("source"), scoped(F.col("r.target")).alias("target"), "r.type", "r.evidence_span",
    )
    errors = errors.select("doc_id", "chunk_id", F.coalesce("error", F.lit("not a payload")).alias("error"))
    return Extraction(entities, relations, errors, chunks)


def from_generated(chunks: DataFrame, called: DataFrame) -> Extraction:
    """Generated text of a sequence model, parsed without Python."""
    texts = called.where("generated_text is not null")
    key = ("doc_id", "chunk_id")
    scoped = lambda c: chunk_scoped_id(F.col("chunk_id"), F.col(c)).alias(c)
    entities = triplet_entities(texts, *key).select(
        *key, F.substring("id", 2, 12).cast("int").alias("pos"), scoped("id"), "label", "type"
    )
    relations = triplet_relations(texts, *key).select(*key, "pos", scoped("source"), scoped("target"), "type", "evidence_span")
    return Extraction(entities, relations, called.where("error is not null").select(*key, "error"), chunks)


class Replay:
    """An engine that looks payloads up by text: ``recorded`` has ``text, payload``. No Python runs for it."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def call(self, chunks: DataFrame, out: str = "payload") -> DataFrame:
        known = self.recorded.select(F.sha2("text", 256).alias("k"), F.col("payload").alias(out)).dropDuplicates(["k"])
        full = chunks.where(F.col("text").isNotNull() & (strip(F.col("text")) != "")).withColumn("k", F.sha2("text", 256))
        error = F.when(F.col(out).isNull(), "nothing recorded")
        return full.join(known, "k", "left").select("doc_id", "chunk_id", out, error.alias("error"))


def extract(chunks: DataFrame, engine: Engine | Replay, generates: bool = False) -> Extraction:
    """Run an engine once over all chunks; its answers are written before anything reads them twice.

    An engine that ``generates`` sees each chunk's collapsed text, cut after a sentence.
    """
    out = "generated_text" if generates else "payload"
    seen = chunks.withColumn("text", shorten_to_sentence(F.col("text"), MODEL_INPUT)) if generates else chunks
    called = engine.call(seen, out) if isinstance(engine, Replay) else call_engine(seen, engine, out)
    called = materialize(called, "answers")
    return from_generated(chunks, called) if generates else from_payloads(chunks, called)


#: Engines by name: how to make one of the settings, and whether it generates text.
ENGINES: dict[str, tuple[Callable[[Settings], Engine], bool]] = {
    "openai": (lambda s: openai_engine(s.openai_api_key, s.extraction_model), False),
    "rebel": (lambda s: rebel_engine(), True),
    "rules": (lambda s: rule_based, False),
}


def engine_for(settings: Settings) -> tuple[Engine, bool]:
    """The engine that the settings name, and whether it generates text; an unknown name raises ValueError."""
    if settings.extraction_engine not in ENGINES:
        raise ValueError(f"extraction_engine must be one of {', '.join(ENGINES)}")
    make, generates = ENGINES[settings.extraction_engine]
    return make(settings), generates


def violations(entities: DataFrame, relations: DataFrame, endpoints: bool = True, *key: str) -> DataFrame:
    """``kind, item, problem``: missing fields and, if asked, relations whose ends aren't entities."""
    out = None
    for kind, df, names in (
        ("entity", entities, ("id", "label", "type")),
        ("relation", relations, ("source", "target", "type", "evidence_span")),
    ):
        for name in names:
            item = F.col(names[0]) if name != names[0] else F.lit(None)
            found = df.where(F.col(name).isNull()).select(
                F.lit(kind).alias("kind"), item.cast("string").alias("item"), F.lit(f"{name} is missing").alias("problem")
            )
            out = found if out is None else out.unionByName(found)
    if endpoints:
        known = entities.select(*key, F.col("id").alias("end")).distinct()
        for end in ("source", "target"):
            lost = relations.where(F.col(end).isNotNull()).withColumn("end", F.col(end)).join(known, [*key, "end"], "left_anti")
            out = out.unionByName(
                lost.select(F.lit("relation").alias("kind"), F.col("end").alias("item"), F.lit(f"{end} is unknown").alias("problem"))
            )
    return out


def require_valid(found: DataFrame) -> bool:
    first = found.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['kind']} {first[0]['item']}: {first[0]['problem']}")
    return True


def type_summary(df: DataFrame, missing: str = "Unknown") -> DataFrame:
    """``type, count``."""
    return df.groupBy(F.coalesce("type", F.lit(missing)).alias("type")).agg(F.count("*").alias("count"))
