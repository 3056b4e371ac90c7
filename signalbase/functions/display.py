"""Column functions for what people read: labels, motives, context, dates, blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

COMPONENT = r"([RIUNE])=(\d+(?:\.\d+)?)\s*\(([^()]*)\)"
NO_DATE = "No disponible"


def topic_label(topic: Column) -> Column:
    """A topic's label; unknown topics are read from their id."""
    labels = F.create_map(*(F.lit(x) for pair in config.TOPIC_LABELS.items() for x in pair))
    words = F.replace(topic, F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(labels, topic), F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substring(words, 2, 1 << 20))))


def percent(value: Column) -> Column:
    """``value`` held between 0 and 100; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value.cast("double"), F.lit(100.0)), F.lit(0.0)))


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yyyy"), F.lit(NO_DATE))


def scope_level(impact: Column, rules: config.Rules) -> Column:
    country, sector, _ = rules.scope_scores
    return F.when(impact == country, "nacional").when(impact == sector, "sectorial").otherwise("local")


def motives(rules: config.Rules, event_id: Column | None = None) -> Column:
    """The components of a scored group (topic, national, R, I, U, N, E) in words."""
    value = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("double").cast("string"))
    text = F.concat(
        value("R"), F.lit(" (tema="), F.col("topic"), F.lit(", medio_nacional="), F.when(F.col("national"), "True").otherwise("False"), F.lit("); "),
        value("I"), F.lit(" (alcance="), scope_level(F.col("I"), rules), F.lit("); "),
        value("U"), F.lit(" (antigüedad vs fecha_ref); "),
        value("N"), F.lit(" (repetición="), F.when(F.col("N") < 1, "sí").otherwise("no"), F.lit("); "),
        value("E"), F.lit(" (procedencias/fuente primaria; contexto oficial de nivel-tema no suma, ver contexto_oficial)"),
    )
    if event_id is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit("; vínculo USGS verificado ("), event_id, F.lit(") cuenta como fuente primaria")), F.lit("")))


def motive_parts(text: Column) -> Column:
    """Array of (component, value, detail) that ``motives`` wrote; empty for other texts."""
    part = lambda s, i: F.regexp_extract(s, COMPONENT, i)
    return F.transform(F.regexp_extract_all(text, F.lit(COMPONENT), 0), lambda s: F.struct(part(s, 1).alias("component"), part(s, 2).cast("double").alias("value"), part(s, 3).alias("detail")))


def _starts(prefixes: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda item: reduce(or_, (item.startswith(p) for p in prefixes), F.lit(False))


def official_context(topic: Column, indicators: Column, n_events: Column, rules: config.Rules) -> Column:
    """Context of a topic that adds nothing to the score: indicator ids for the topics
    that have prefixes, the number of events near the group for natural events."""
    text = F.lit("")
    for name, prefixes in rules.context_prefixes.items():
        ids = F.filter(F.array_sort(F.array_distinct(indicators)), _starts(prefixes))
        text = F.when(topic == name, F.array_join(ids, ", ")).otherwise(text)
    told = F.concat(n_events.cast("string"), F.lit(f" evento(s) sísmico(s) USGS a {rules.event_window_days} días o menos (contexto, sin relación establecida con la noticia)"))
    return F.when((topic == "eventos_naturales") & (n_events > 0), told).otherwise(text)


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def joined_map(items: Column) -> Column:
    """``key=value`` pairs in the map's order."""
    return F.array_join(F.transform(F.map_entries(items), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), " · ")


def safe_name(model: Column) -> Column:
    """A model id as a file name."""
    return F.regexp_replace(model, r"[^A-Za-z0-9_.-]+", "__")


def page_id(value: Column) -> Column:
    """The last 32 hex digits of an id or url, in groups; null if there are none."""
    h = F.lower(F.try_element_at(F.regexp_extract_all(F.replace(value, F.lit("-"), F.lit("")), F.lit(r"([0-9a-fA-F]{32})"), 1), F.lit(-1)))
    parts = (F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.when(h.isNotNull(), F.concat_ws("-", *parts))


def markdown_blocks(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, kind, text): headings, items, quotes, code, rules and paragraphs.

    A fence toggles code; code left open at the end counts if it has a line. ``pos`` is
    the line (a code block's last one). Each text is folded within its row, without a shuffle.
    """
    rows = df.select(key, F.split(body, r"\r\n|\n|\r").alias("raw")).withColumn("line", F.transform("raw", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))
    fences = F.filter(F.transform("line", lambda x, i: F.when(x.startswith("```"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("fences", F.coalesce(fences, F.array().cast("array<int>")))

    def kind(line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, r"^(#{1,3}) ", 1))
        return (
            F.when(line.isin("---", "***"), "divider").when(marks > 0, F.concat(F.lit("heading_"), marks.cast("string"))).when(line.rlike(r"^[-*] "), "bulleted_list_item")
            .when(line.rlike(r"^\d+[.)] "), "numbered_list_item").when(line.startswith("> "), "quote").otherwise("paragraph")
        )

    def block(pos: Column, name: Column, value: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), name.alias("kind"), value.alias("text"))

    text = lambda line: F.when(line.isin("---", "***"), "").otherwise(F.regexp_replace(line, r"^(#{1,3}|[-*]|\d+[.)]|>) ", ""))
    shown = F.transform("line", lambda x, i: F.when((x != "") & ~x.startswith("```") & (F.size(F.filter("fences", lambda p: p <= i)) % 2 == 0), block(i, kind(x), text(x))))
    # every second fence opens code, up to the next one or the end
    opening = F.filter(F.transform("fences", lambda p, k: F.when(k % 2 == 0, k)), lambda k: k.isNotNull())
    start = lambda k: F.get("fences", k)
    end = lambda k: F.coalesce(F.get("fences", k + 1), F.size("raw"))
    inner = lambda k: end(k) - start(k) - 1
    code = F.transform(opening, lambda k: F.when((k + 1 < F.size("fences")) | (inner(k) > 0), block(end(k) - 1, F.lit("code"), F.array_join(F.slice("raw", start(k) + 2, inner(k)), "\n"))))
    return rows.select(key, F.inline(F.filter(F.concat(shown, code), lambda b: b.isNotNull())))
