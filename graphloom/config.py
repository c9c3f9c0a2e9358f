"""Settings, read from the environment and validated."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: The engines of models, and the offline one that tests and examples use.
ENGINES = ("openai", "rebel", "rules")
#: Bounds and steps that the interactive surface offers: (least, most, step).
CHUNK_SIZE_BOUNDS = (200, 2000, 100)
CHUNK_OVERLAP_BOUNDS = (0, 300, 25)
THRESHOLD_BOUNDS = (0.5, 1.0, 0.05)


@dataclass(frozen=True)
class Settings:
    openai_api_key: str | None = None
    huggingface_token: str | None = None
    extraction_engine: str = "openai"
    extraction_model: str = "gpt-4-turbo-preview"
    embedding_model: str = "text-embedding-3-large"
    chunk_size: int = 500
    chunk_overlap: int = 50
    dedup_similarity_threshold: float = 0.85
    api_port: int = 8000
    ui_port: int = 8501

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Each field from the variable of its name in upper case; what is missing keeps its default."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None:
                kind = type(f.default) if f.default is not None else str
                found[f.name] = kind(raw)
        return cls(**found)

    def problems(self) -> list[str]:
        out = []
        if self.extraction_engine not in ENGINES:
            out.append(f"extraction_engine must be one of {', '.join(ENGINES)}")
        if self.extraction_engine == "openai" and not self.openai_api_key:
            out.append("openai_api_key is required by the openai engine")
        out += run_problems(self.chunk_size, self.chunk_overlap, self.dedup_similarity_threshold)
        return out

    def validate(self) -> None:
        if found := self.problems():
            raise ValueError("; ".join(found))

    def public_dict(self) -> dict[str, object]:
        """What may be shown: keys only as whether they are set."""
        return {
            "extraction_engine": self.extraction_engine,
            "extraction_model": self.extraction_model,
            "embedding_model": self.embedding_model,
            "chunk_size": self.chunk_size,
            "chunk_overlap": self.chunk_overlap,
            "dedup_similarity_threshold": self.dedup_similarity_threshold,
            "has_openai_key": bool(self.openai_api_key),
            "has_huggingface_token": bool(self.huggingface_token),
        }


def run_problems(chunk_size: int, chunk_overlap: int, threshold: float) -> list[str]:
    out = []
    if chunk_size <= chunk_overlap:
        out.append("chunk_size must exceed chunk_overlap")
    if not 0 <= threshold <= 1:
        out.append("the similarity threshold must be within 0 and 1")
    return out


def engines(settings: Settings) -> dict[str, bool]:
    """The models' engines and whether they can run."""
    return {"openai": bool(settings.openai_api_key), "rebel": True}


def engine_rows(spark: SparkSession, settings: Settings) -> DataFrame:
    """``engine, available, selected``."""
    rows = [(name, can, name == settings.extraction_engine) for name, can in engines(settings).items()]
    return spark.createDataFrame(rows, "engine string, available boolean, selected boolean")
