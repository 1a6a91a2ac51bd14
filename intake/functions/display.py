"""How values are shown: blank and NULL defaults, sizes, confidences, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is shown where nothing is stored.
NO_SUBJECT = "(Sin asunto)"
NO_SNIPPET = "Sin resumen disponible"


def blank_to_null(c: Column, trim: bool = True) -> Column:
    """NULL for a text of white space (or, without `trim`, for an empty one only)."""
    return F.when(F.regexp_replace(c, r"^\s+$", "") != "", c) if trim else F.nullif(c, F.lit(""))


def presence_flag(c: Column) -> Column:
    """Whether a secret is there, instead of the secret."""
    return c.isNotNull()


def with_display_defaults(df: DataFrame) -> DataFrame:
    """`subject` and `snippet` with their defaults, where these columns are there."""
    shown = {"subject": NO_SUBJECT, "snippet": NO_SNIPPET}
    return df.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in shown.items() if c in df.columns})


def message_state(n_documents: Column, has_error: Column, has_download: Column) -> Column:
    """Documents come before errors, errors before downloads; NULL flags fall through."""
    return F.when(n_documents > 0, "Procesado").when(has_error == 1, "Con errores").when(has_download == 1, "Descargado").otherwise("Pendiente")


def _short(c: Column) -> Column:
    """Two decimals, ties away from zero, without trailing zeros."""
    text = F.format_string("%.2f", F.round(c.cast("decimal(38,10)"), 2).cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def format_size(c: Column) -> Column:
    """Bytes as MB, KB or bytes; a dash for NULL."""
    return (
        F.when(c.isNull(), "—")
        .when(c >= 1 << 20, F.concat(_short(c / F.lit(1 << 20)), F.lit(" MB")))
        .when(c >= 1 << 10, F.concat(_short(c / F.lit(1 << 10)), F.lit(" KB")))
        .otherwise(F.concat(c.cast("string"), F.lit(" bytes")))
    )


def format_confidence(c: Column) -> Column:
    return F.coalesce(F.concat(c.cast("string"), F.lit("%")), F.lit("—"))


def format_ts(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy HH:mm")


def active_label(c: Column) -> Column:
    return F.when(c, "Activa").otherwise("Inactiva")


def last_query(c: Column) -> Column:
    return F.coalesce(format_ts(c), F.lit("Sin consultas"))
