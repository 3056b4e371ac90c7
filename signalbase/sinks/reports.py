"""Reports: small aggregates as Markdown. The aggregation is Spark's; only its rows,
whose number the report fixes, reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def table(df: DataFrame, title: str, most: int = MOST_ROWS) -> str:
    """A titled Markdown table; more rows than ``most`` are an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; aggregate it first")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def report(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    return "\n".join([f"# {title}\n", *(table(df, name) for name, df in parts)])


def load_report(news: DataFrame, rejects: DataFrame) -> str:
    """What a load kept and refused: nulls, reasons, months and origins."""
    from ..operators import quality

    parts = [("Nulos por columna", quality.null_profile(news)), ("Rechazos por motivo", quality.counts(rejects, "reason", "motivo")), ("Noticias por mes", quality.monthly(news, "detected", "published")), ("Noticias por origen", quality.counts(news, "origin", "origen"))]
    return report("Reporte de carga", parts)


def classification_report(labelled: DataFrame, truth: str, predicted: dict[str, str], other: str = "otros") -> str:
    """Each method's metrics by class, macro F1, abstention and confusion."""
    from pyspark.sql import functions as F

    from ..operators import evaluate

    parts = []
    for name, column in predicted.items():
        met = labelled.where(F.col(column).isNotNull())
        whole = evaluate.macro_f1(met, truth, column).crossJoin(met.agg(F.avg((F.col(column) == other).cast("int")).alias("abstention"), F.count("*").alias("n")))
        parts += [(f"Método {name}", whole), (f"Clases de {name}", evaluate.per_class(met, truth, column).orderBy("label")), (f"Confusión de {name}", evaluate.confusion(met, truth, column).orderBy("truth", "predicted"))]
    return report("Evaluación de la clasificación", parts)


def benchmark_report(scored: DataFrame) -> str:
    """Rates of a question benchmark, in all and by expected type."""
    from pyspark.sql import functions as F

    rates = [F.avg(F.col("type_ok").cast("int")).alias("type_accuracy"), F.avg("recall").alias("recall"), F.avg(F.col("clean_abstention").cast("int")).alias("clean_abstention"), F.count("*").alias("n")]
    return report("Evaluación de preguntas", [("En conjunto", scored.agg(*rates)), ("Por tipo esperado", scored.groupBy("expected_type").agg(*rates).orderBy("expected_type"))])
