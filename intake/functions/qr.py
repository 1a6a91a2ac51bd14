"""Fiscal QR codes: the text of a code is a URL whose one parameter is a base64url JSON object. All checks are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
HOSTS = ("arca.gob.ar", "www.arca.gob.ar", "afip.gob.ar", "www.afip.gob.ar")


#: Where a URL's parts stand once it is parsed.
PARTS = {name: f"_url_{name.lower()}" for name in ("PROTOCOL", "AUTHORITY", "PATH", "REF", "QUERY")}


def url_part(c: Column) -> Callable[[str], Column]:
    return lambda name: F.try_parse_url(c, F.lit(name))


def qr_url_ok(c: Column, part: Callable[[str], Column] | None = None) -> Column:
    """https, one of the hosts (its default port may be written, a user may not), the path, no fragment, 12,000 characters at most.
    `part` gives parts that were parsed before."""
    part = part or url_part(c)
    host = F.regexp_replace(F.lower(part("AUTHORITY")), ":443$", "")
    fits = (F.length(c) <= 12_000) & (F.lower(part("PROTOCOL")) == "https") & host.isin(*HOSTS) & (F.lower(part("PATH")) == "/fe/qr/")
    return F.coalesce(fits, F.lit(False)) & (F.coalesce(part("REF"), F.lit("")) == "")


def percent_decode(c: Column) -> Column:
    """%XX only; a plus sign stays one. NULL for a broken escape."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def qr_query_payload(c: Column, part: Callable[[str], Column] | None = None) -> Column:
    """The value of `p`, if it is the query's one parameter, is not blank and has 10,000 characters at most; else NULL."""
    parts = F.filter(F.split((part or url_part(c))("QUERY"), "&"), lambda x: x != "")
    only = F.when(F.size(parts) == 1, F.get(parts, F.lit(0)))
    key, value = percent_decode(F.substring_index(only, "=", 1)), percent_decode(F.regexp_replace(only, "(?s)^[^=]*=", ""))
    return F.when(F.contains(only, F.lit("=")) & (key == "p") & (F.trim(value) != "") & (F.length(value) <= 10_000), value)


def base64url_lenient(c: Column) -> Column:
    """Bytes of a base64 or base64url text, padding added, 1 to 8192 of them; else NULL."""
    body = F.translate(c, "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), (4 - F.length(body) % 4) % 4))
    data = F.try_to_binary(padded, F.lit("base64"))
    return F.when(F.octet_length(data).between(1, 8192), data)


def strict_utf8(data: Column) -> Column:
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def json_strict(v: Column) -> Column:
    """A parsed JSON value if it is an object; NULL for other values. (Broken texts and repeated keys do not parse.)"""
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def token_text(v: Column, key: str) -> Column:
    """A scalar's text; empty for what is missing, null, an object or an array. (A number loses zeros behind its point: 1.0 reads as 1.)"""
    token = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(token)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")) | (kind == "VOID")
    return F.coalesce(F.when(~nested, F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))


def present(v: Column, key: str) -> Column:
    """A key that is there, be it with a JSON null."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def int_in_range(c: Column, low: int, high: int) -> Column:
    """Digits only: no sign, no blanks."""
    return c.rlike("^[0-9]+$") & F.coalesce(c.try_cast("decimal(20,0)").between(low, high), F.lit(False))


def decimal_at_least(c: Column, low: str) -> Column:
    """Sign and point are allowed, an exponent is not."""
    return c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & F.coalesce(c.try_cast("decimal(38,10)") >= F.lit(low).cast("decimal(38,10)"), F.lit(False))


def exact_date(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def digits(c: Column, low: int, high: int) -> Column:
    return c.rlike(rf"^\p{{Nd}}{{{low},{high}}}$")


def currency_ok(c: Column) -> Column:
    return c.rlike("^[A-Z]{3}$")


def auth_ok(c: Column) -> Column:
    return c.isin("A", "E")


def receiver_ok(v: Column, token: Callable[[str], Column] | None = None) -> Column:
    """Receiver type and number: both missing, or both good. A JSON null is there, and so is not good."""
    token = token or (lambda key: token_text(v, key))
    kind, number = present(v, "tipoDocRec"), present(v, "nroDocRec")
    return (~kind & ~number) | (kind & number & int_in_range(token("tipoDocRec"), 0, 99) & digits(token("nroDocRec"), 1, 20))


#: The keys that are read as texts.
TOKENS = ("ver", "fecha", "cuit", "ptoVta", "tipoCmp", "nroCmp", "importe", "moneda", "ctz", "tipoCodAut", "codAut", "tipoDocRec", "nroDocRec")


def qr_payload_ok(v: Column, token: Callable[[str], Column] | None = None) -> Column:
    """All checks of a payload. `token` gives texts that were read before."""
    t = token or (lambda key: token_text(v, key))
    checks = (
        int_in_range(t("ver"), 1, 1), exact_date(t("fecha")), digits(t("cuit"), 11, 11), int_in_range(t("ptoVta"), 1, 99_999), int_in_range(t("tipoCmp"), 1, 999),
        int_in_range(t("nroCmp"), 1, 99_999_999), decimal_at_least(t("importe"), "0"), currency_ok(t("moneda")), decimal_at_least(t("ctz"), "0.0000000001"),
        auth_ok(t("tipoCodAut")), digits(t("codAut"), 14, 14), receiver_ok(v, t),
    )
    out = F.lit(True)
    for check in checks:
        out = out & check
    return F.coalesce(out, F.lit(False))


def qr_evidence(readings: DataFrame, text: str = "qr_text") -> DataFrame:
    """`readings` with qr_detected, qr_valid and qr_type (valid codes only). The URL is parsed once, then its payload is decoded once, then
    each key is read once; every step reads the columns of the one before."""
    c = F.col(text)
    parsed = readings.withColumns({column: url_part(c)(name) for name, column in PARTS.items()})
    part = lambda name: F.col(PARTS[name])
    decoded = parsed.withColumn("_payload", F.when(qr_url_ok(c, part), qr_query_payload(c, part)))
    decoded = decoded.withColumn("_data", base64url_lenient(F.col("_payload"))).withColumn("_object", F.try_parse_json(strict_utf8(F.col("_data"))))
    decoded = decoded.withColumn("_json", json_strict(F.col("_object")))
    read = decoded.withColumns({f"_token_{key}": token_text(F.col("_json"), key) for key in TOKENS})
    token = lambda key: F.col(f"_token_{key}")
    valid = read.withColumn("qr_valid", F.col("_json").isNotNull() & qr_payload_ok(F.col("_json"), token))
    kind = F.when(F.col("qr_valid"), token("tipoCmp").try_cast("int"))
    return valid.withColumns({"qr_detected": c.isNotNull(), "qr_type": kind}).select(*readings.columns, "qr_valid", "qr_detected", "qr_type")


def page_selected(page: Column, n_pages: Column, cap: int = 20) -> Column:
    """All pages of a short document; of a long one all but one of the cap from the front, and the last."""
    return (n_pages <= cap) | (page <= cap - 1) | (page == n_pages)


def first_valid_qr(readings: DataFrame, max_images: int = 100) -> DataFrame:
    """doc_id, qr_detected, qr_valid, qr_type: the first valid code in page and image order. Only selected pages and the first
    `max_images` images are looked at, and none behind the first valid one, so `qr_detected` speaks of those."""
    order = Window.partitionBy("doc_id").orderBy("page", "image")
    looked = readings.where(page_selected(F.col("page"), F.col("n_pages"))).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_images)
    judged = qr_evidence(looked)
    return judged.groupBy("doc_id").agg(
        F.bool_or("qr_detected").alias("qr_detected"), F.bool_or("qr_valid").alias("qr_valid"), F.min_by("qr_type", F.when(F.col("qr_valid"), F.col("_k"))).alias("qr_type")
    )
