"""Settings, checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class LinkConfig:
    threshold: float = 0.3
    reranker_threshold: float = 0.038
    llm_threshold: float = 0.5
    top_k: int = 10
    judge_candidates: int = 10
    country_boost: float = 0.05
    city_boost: float = 0.03
    rerank: bool = True
    llm_judge: bool = False
    #: Vectors above which an index without cells or graphs is searched by graphs made for the run; None: always compared one by one.
    graph_from: int | None = 1_000_000

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.judge_candidates < 1:
            raise ValueError("top_k and judge_candidates are at least 1")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold lies between 0 and 1")


@dataclass(frozen=True)
class PipelineConfig:
    span_strategy: str = "delimiter"
    span_delimiter: str = ";"
    min_entity_score: float = 0.0
    enable_language_detect: bool = False
    language_method: str = "heuristic"
    compat: bool = True
    enable_translation: bool = False
    extra_languages: tuple[str, ...] = ()
    enable_entity_linking: bool = True
    enable_normalization: bool = True
    enable_org_types: bool = False
    output_format: str = "normalized"
    cache_ttl_days: int = 30
    link: LinkConfig = field(default_factory=LinkConfig)

    def __post_init__(self) -> None:
        if self.span_strategy not in ("delimiter", "none", "model"):
            raise ValueError(f"unknown span strategy {self.span_strategy!r}")
        if self.output_format not in ("normalized", "full"):
            raise ValueError(f"unknown output format {self.output_format!r}")


def data_dir(override: str | None = None) -> str:
    """The folder of registry, tables and caches: the argument, else ORGWEAVE_DATA_DIR, else a folder of the user's cache."""
    return override or os.environ.get("ORGWEAVE_DATA_DIR") or os.path.join(os.path.expanduser("~"), ".cache", "orgweave")
