"""Rules and topics from YAML files, small by nature, read on the driver."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .. import config

try:
    import yaml
except ImportError:  # only these readers need it
    yaml = None


def read_yaml(path: str) -> dict[str, Any]:
    if yaml is None:
        raise RuntimeError("reading rules needs a YAML parser")
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def rules_of(data: dict[str, Any]) -> config.Rules:
    """Checked rules; what a file leaves out keeps its default."""
    own, scope, proof = config.Rules(), data.get("impacto_alcance") or {}, data.get("evidencia") or {}
    primary, official, link, new = (data.get(k) or {} for k in ("fuentes_primarias", "contexto_oficial", "vinculo_usgs", "novedad"))
    words = lambda level, default: tuple((scope.get(level) or {}).get("palabras_clave") or default)
    points = tuple(float((scope.get(level) or {}).get("score", default)) for level, default in zip(("nacional", "sectorial", "local"), own.scope_scores))
    ranges = tuple((name, float(r["lo"]), float(r["hi"])) for name, r in (data.get("rangos") or {}).items())
    steps = tuple((s["horas_max"], float(s["score"])) for s in data.get("u_tramos") or ())
    return replace(
        own,
        version=str(data.get("version", own.version)),
        weights={k: float(v) for k, v in (data.get("pesos") or own.weights).items()},
        ranges=ranges or own.ranges,
        topics=tuple(data.get("temas_reto") or own.topics),
        national_outlets=tuple(data.get("medios_nacionales") or own.national_outlets),
        primary_suffixes=tuple(primary.get("sufijos_dominio") or own.primary_suffixes),
        primary_domains=tuple(primary.get("dominios") or own.primary_domains),
        recency=steps or own.recency,
        national_words=words("nacional", own.national_words),
        sector_words=words("sectorial", own.sector_words),
        scope_scores=points,
        novelty=(float(new.get("nuevo", own.novelty[0])), float(new.get("repeticion", own.novelty[1]))),
        per_source=float(proof.get("peso_por_procedencia_adicional", own.per_source)),
        source_cap=float(proof.get("tope_procedencias", own.source_cap)),
        primary_weight=float(proof.get("peso_fuente_primaria", own.primary_weight)),
        context_prefixes={t: tuple(p or ()) for t, p in (official.get("contexto_por_tema") or {}).items()} or own.context_prefixes,
        event_window_days=int(official.get("ventana_dias_evento_natural", own.event_window_days)),
        link_before_hours=float(link.get("ventana_antes_horas", own.link_before_hours)),
        link_after_hours=float(link.get("ventana_despues_horas", own.link_after_hours)),
        link_tolerance=float(link.get("tolerancia_magnitud", own.link_tolerance)),
    ).validate()


def read_rules(path: str) -> config.Rules:
    return rules_of(read_yaml(path))


class Topics(NamedTuple):
    """Prototypes (name, text) in order, the names of contrast ones, and thresholds of the
    dense and the sparse classifier."""

    prototypes: list[tuple[str, str]]
    contrast: tuple[str, ...]
    dense: config.Thresholds
    sparse: config.Thresholds

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *p) for i, p in enumerate(self.prototypes)], "place int, prototype string, text string")


def prototype_text(description: str | None, seeds: list[str] | None) -> str:
    return (description or "").strip() + ". " + ". ".join(seeds or [])


def topics_of(data: dict[str, Any]) -> Topics:
    """Topics first, then contrast groups unless the file turns them off."""
    given, base = data.get("parametros") or {}, config.Thresholds()
    named = lambda key: [(name, prototype_text(x.get("descripcion"), x.get("semillas"))) for name, x in (data.get(key) or {}).items()]
    contrast = named("contraste") if given.get("usar_contraste", True) else []
    limits = lambda end: config.Thresholds(float(given.get(f"umbral_score{end}", base.score)), float(given.get(f"umbral_margen{end}", base.margin)))
    return Topics(named("temas") + contrast, tuple(n for n, _ in contrast), limits(""), limits("_tfidf"))


def read_topics(path: str) -> Topics:
    return topics_of(read_yaml(path))
