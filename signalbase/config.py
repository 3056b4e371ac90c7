"""Rules and vocabularies as data. Values here are fixed: results depend on them."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

# fixed values: agency marks and the names they stand for, longest mark first
AGENCIES = (("EUROPA PRESS", "EUROPA_PRESS"), ("REUTERS", "REUTERS"), ("SPUTNIK", "SPUTNIK"), ("ANSA", "ANSA"), ("EFE", "EFE"), ("AFP", "AFP"), ("DPA", "DPA"), ("AP", "AP"), ("EP", "EUROPA_PRESS"))
# fixed values: query parameters that name a campaign, not a page
TRACKING_PREFIX = "utm_"
TRACKING_INGEST = ("fbclid", "gclid", "outputtype")
TRACKING_LOADER = ("fbclid",)


def _unmarked() -> tuple[str, str]:
    """Characters whose compatibility decomposition, less its marks, is one other
    character, and that character; marks themselves last, without one."""
    marked, plain, marks = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif not 0xD800 <= code < 0xE000:
            rest = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(rest) == 1 and rest != c:
                marked.append(c)
                plain.append(rest)
    return "".join(marked + marks), "".join(plain)


MARKED, PLAIN = _unmarked()
# fixed values: words that open a natural-event headline, and words that name no place
QUAKE_WORDS = ("sismo", "temblor", "terremoto", "telurico", "replica")
GENERIC_PLACES = ("panama", "sismo", "sismos", "temblor", "region", "zona", "cerca", "sureste", "suroeste", "noreste", "noroeste", "south", "north", "east", "west", "near")
OTHER = "otros"
# fixed values: labels of topics, names of countries
TOPIC_LABELS = {
    "economia": "Economía",
    "logistica_canal": "Logística canal",
    "turismo": "Turismo",
    "servicios_publicos": "Servicios públicos",
    "eventos_naturales": "Eventos naturales",
    "regulacion": "Regulación",
    "otros": "Otros",
}
COUNTRIES = {"PAN": "Panamá"}
# fixed values: review states of new drafts, scopes of drafts, gaps they name
STATE_NEW, STATE_UNSUPPORTED = "nuevo", "requiere evidencia"
SCOPE_HEADLINES = "basado únicamente en titular/metadatos"
SCOPE_OFFICIAL = "basado en titular/metadatos y datos oficiales citados (indicadores anuales o eventos USGS)"
GAP_NONE = "No hay evidencia citable para este grupo."
GAP_MODEL = "El modelo no devolvió una salida utilizable ({})."
GAP_INJECTION = "La salida del modelo obedeció contenido de una fuente."
GAP_UNSUPPORTED = "Ninguna afirmación del modelo quedó sustentada por la evidencia."
# fixed values: kinds of claims and answers, the five review states, those a person set
CLAIM_KINDS = ("hecho", "declaracion", "inferencia", "hipotesis")
ANSWER_KINDS = ("respuesta", "abstencion", "contradiccion")
REVIEW_STATES = ("nuevo", "en revisión", "requiere evidencia", "aprobado como borrador", "descartado")
REVIEWED_STATES = ("en revisión", "aprobado como borrador", "descartado")
# fixed values: numbers and proper nouns of a claim, names that need no evidence
NUMBER = r"(\d+(?:[.,]\d+)?)"
PROPER = r"^([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{3,}|[A-ZÁÉÍÓÚÑ]{3,})$"
PERMITTED_NAMES = ("panama", "segun", "banco", "mundial", "world", "bank")
# fixed values: words of a question that ask nothing, and answers about drafts
STOP_WORDS = ("como", "con", "cual", "cuales", "cuando", "donde", "este", "esta", "ficha", "grupo", "hay", "las", "los", "para", "paso", "que", "quien", "sobre", "una", "uno", "unos", "unas")
NO_ANSWER = "No hay evidencia validada en esta ficha para responder a esa consulta."
PENDING_REVIEW = "Revisión pendiente: las fuentes no coinciden; no se elige una versión. Una persona debe revisarlas."
SUGGESTION = "¿Qué dice la ficha sobre {}?"
# fixed values: answers of reviewers that mean yes
YES = ("si", "sí", "s", "yes", "y")


@dataclass(frozen=True)
class Rules:
    """A version of the scoring rules; ``validate`` before use."""

    version: str = "v0.3"
    weights: dict[str, float] = field(default_factory=lambda: {"R": 30, "I": 25, "U": 20, "N": 15, "E": 10})
    ranges: tuple[tuple[str, float, float], ...] = (("bajo", 0, 40), ("medio", 40, 70), ("alto", 70, 100))
    topics: tuple[str, ...] = ("economia", "logistica_canal", "turismo", "servicios_publicos", "eventos_naturales", "regulacion")
    national_outlets: tuple[str, ...] = ("tvn-2.com", "prensa.com", "panamaamerica.com.pa", "critica.com.pa", "diaadia.com.pa", "newsroompanama.com")
    primary_suffixes: tuple[str, ...] = (".gob.pa",)
    primary_domains: tuple[str, ...] = ("mire.gob.pa",)
    recency: tuple[tuple[float | None, float], ...] = ((24, 1.0), (72, 0.7), (168, 0.4), (None, 0.1))
    national_words: tuple[str, ...] = ("panamá", "panama", "país", "nacional", "gobierno nacional", "todo el territorio", "asamblea nacional")
    sector_words: tuple[str, ...] = ("sector", "gremio", "industria", "canal de panamá", "zona libre de colón", "comercio exterior", "turismo", "puertos")
    scope_scores: tuple[float, float, float] = (1.0, 0.6, 0.3)
    novelty: tuple[float, float] = (1.0, 0.2)
    per_source: float = 0.2
    source_cap: float = 0.4
    primary_weight: float = 0.4
    context_prefixes: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"economia": ("FP.CPI", "NY.GDP", "SL.UEM", "NE.EXP")})
    event_window_days: int = 7
    link_before_hours: float = 12
    link_after_hours: float = 48
    link_tolerance: float = 0.2

    def validate(self) -> Rules:
        """Weights sum to 100 and ranges cover 0 to 100 without a gap."""
        if sum(self.weights.values()) != 100:
            raise ValueError("weights must sum to 100")
        edges = [self.ranges[0][1], *(hi for _, _, hi in self.ranges)]
        if edges[0] != 0 or edges[-1] != 100 or any(r[1] != edges[i] for i, r in enumerate(self.ranges)):
            raise ValueError("ranges must be contiguous from 0 to 100")
        return self


@dataclass(frozen=True)
class Thresholds:
    """Abstention of the prototype classifier."""

    score: float = 0.25
    margin: float = 0.01
