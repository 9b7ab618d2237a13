"""Targets, configuration and dispatch to payload parsers."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import adapter
from .payloads import PARSERS


@dataclass
class Filters:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    exclude_locations: list[str] = field(default_factory=list)
    allow_remote: bool = True


@dataclass
class Fetching:
    deep_scrape: bool = True
    deep_concurrency: int = 6
    per_host: int = 1
    host_spacing: float = 1.5
    retries: int = 2
    cache_enabled: bool = True
    cache_ttl_seconds: int = 86_400
    max_pages: int = 0
    max_depth: int = 2


@dataclass
class Target:
    name: str
    url: str
    adapter: str = "auto"
    position: int = 0


@dataclass
class Config:
    filters: Filters = field(default_factory=Filters)
    fetching: Fetching = field(default_factory=Fetching)
    targets: list[Target] = field(default_factory=list)
    mode: str = "jobs"
    sinks: dict[str, dict] = field(default_factory=dict)


def _known(kind, values: dict | None):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in (values or {}).items() if k in names and v is not None})


def config_of(tree: dict) -> Config:
    """Typed configuration from a parsed tree; absent or null keys take their defaults, unknown keys are ignored."""
    targets = [Target(t.get("name") or t["url"], t["url"], (t.get("adapter") or "auto").lower(), i) for i, t in enumerate(tree.get("targets") or [])]
    fetching = _known(Fetching, tree.get("fetching"))
    fetching.deep_concurrency = min(64, max(1, fetching.deep_concurrency))
    return Config(_known(Filters, tree.get("filters")), fetching, targets, tree.get("mode") or "jobs", tree.get("sinks") or {})


def load_config(path: str) -> Config:
    """Configuration from a YAML file, or from JSON where no YAML reader is installed."""
    import json

    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        return config_of(json.loads(text))
    return config_of(yaml.safe_load(text) or {})


def overridden(config: Config, include: str | None = None, exclude: str | None = None, locations: str | None = None, urls: list[str] = ()) -> Config:
    """Command-line values over a configuration; lists are split at commas, URLs replace the targets."""
    for name, value in (("include", include), ("exclude", exclude), ("locations", locations)):
        if value is not None:
            setattr(config.filters, name, [v.strip() for v in value.split(",") if v.strip()])
    if urls:
        config.targets = targets_of(list(urls))
    return config


def targets_of(urls: list[str]) -> list[Target]:
    return [Target(u, u, "auto", i) for i, u in enumerate(urls)]


def targets(spark: SparkSession, config: Config) -> DataFrame:
    """``position, name, url, adapter``: named adapters stay, ``auto`` is decided by host, unknown names are ``generic``."""
    rows = spark.createDataFrame([(t.position, t.name, t.url, t.adapter) for t in config.targets], "position int, name string, url string, adapter string")
    known = [*PARSERS, "finn.no", "nav.no", "karrierestart.no", "jobbsafari.no", "generic"]
    return rows.withColumn("adapter", F.when(F.col("adapter") == "auto", adapter(F.col("url"))).when(F.col("adapter").isin(known), F.col("adapter")).otherwise("generic"))


def stubs(payloads: DataFrame) -> DataFrame:
    """Listings of ``adapter, target, target_position, slug, body`` payloads, one parser per adapter.

    Each listing keeps the target of the payload that it comes from, also where targets or pages share a slug.
    """
    found = None
    origin = F.struct("target", "target_position").alias("origin")
    for name, parse in PARSERS.items():
        rows = parse(payloads.where(F.col("adapter") == name).select("slug", origin, "body")).withColumn("adapter", F.lit(name))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found.select("*", "origin.target", "origin.target_position").drop("origin")
