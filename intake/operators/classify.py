"""Rules that call a document invoice, review or discard, by its text, its name, its OCR text and its QR code.

A decision is four columns: classification, method, confidence, reason. Texts are normalised once, in columns of their own; the ladder
reads those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import IMAGE_EXTENSIONS, file_ext, file_stem, guess_mime, safe_reason
from ..functions.text import compact_text, contains_phrase, contains_signal, first_signal, normalize_text, padded, signal_group_count, useful_ocr_text, useful_page_text


@dataclass(frozen=True)
class Vocabulary:
    """Fixed values; another vocabulary may be passed to every function here."""

    explicit: tuple[str, ...] = ("FACTURA A", "FACTURA B", "FACTURA C", "FACTURA M", "FACTURA E", "FACTURA DE CREDITO ELECTRONICA")
    word: str = "FACTURA"
    letters: tuple[str, ...] = ("A", "B", "C", "M", "E")
    fiscal: tuple[tuple[str, ...], ...] = (
        ("CUIT",),
        ("CAE", "CAEA"),
        ("PUNTO DE VENTA", "PTO VTA"),
        ("COMP NRO", "COMPROBANTE", "NRO COMPROBANTE"),
        ("IMPORTE TOTAL", "TOTAL"),
        ("IVA",),
        ("FECHA DE EMISION",),
    )
    negative: tuple[str, ...] = ("REMITO", "NOTA DE CREDITO", "NOTA DE DEBITO", "ORDEN DE COMPRA", "PRESUPUESTO", "RECIBO", "NOTA DE PEDIDO", "CREDENCIAL DE PAGO", "EXTRACTO DE CUENTAS", "RESUMEN DE OPERACIONES")
    tolerated: str = "REMITO"


#: What decisions say, and how sure they are.
REASON = {
    "needs_ocr": "Requiere OCR futuro.",
    "identified": "Documento identificado como ",
    "explicit": "Factura explícita y ",
    "signals": " señales fiscales.",
    "few_signals": "Factura explícita con señales fiscales insuficientes.",
    "found": "Se detectaron ",
    "no_kind": " señales fiscales sin tipo de factura explícito.",
    "unclear": "El texto obtenido no permite clasificar el documento con seguridad.",
    "useless_ocr": "El OCR no produjo texto utilizable para clasificar el documento.",
    "image": "Imagen pendiente de OCR.",
    "name": "El nombre sugiere una factura; requiere revisión.",
    "format": "Formato sin evidencia de factura.",
    "ocr_failed": "El OCR no pudo procesar el documento.",
    "over_limit": "Las imágenes del PDF superan los límites de OCR.",
    "no_image": "No hay una imagen procesable para OCR.",
    "qr_invoice_clash": "El QR ARCA indica factura, pero el texto identifica inequívocamente otro tipo documental.",
    "qr_invoice": "QR ARCA estructuralmente válido con tipo de comprobante factura. No constituye validación online de autenticidad.",
    "qr_other_clash": "El QR ARCA indica un comprobante no factura, pero el texto identifica factura.",
    "qr_other": "El tipo de comprobante informado por el QR ARCA no corresponde a una factura.",
    "container": "Contenedor no analizable: ",
}
CONFIDENCE = {"invoice": 70, "signal": 4, "most": 95, "few_signals": 55, "no_kind": 45, "name": 30, "qr_clash": 70, "qr": 98}

VOCABULARY = Vocabulary()
DECISION = ("classification", "method", "confidence", "reason")


def decision(classification: str, method: str | Column, confidence: int | Column | None, reason: str | Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    number = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(text(classification).alias("classification"), text(method).alias("method"), number.cast("smallint").alias("confidence"), text(reason).alias("reason"))


def _review(method: str, reason: str | Column, confidence: int | None = None) -> Column:
    return decision("REVISAR", method, confidence, reason)


def signals(df: DataFrame, text: str, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """`df` with explicit, n_fiscal and negative of a text column."""
    v = vocabulary
    named = df.withColumn("_norm", normalize_text(F.col(text)))
    named = named.withColumns({"_compact": compact_text(F.col("_norm")), "_norm": padded(F.col("_norm"))})  # once for all phrases
    norm, compact = F.col("_norm"), F.col("_compact")
    any_of = lambda tests: F.greatest(*tests) if len(tests) > 1 else tests[0]
    explicit = any_of([contains_signal(norm, compact, p, True) for p in v.explicit])
    lettered = contains_phrase(norm, v.word, True) & any_of([contains_phrase(norm, x, True) for x in v.letters])
    found = named.withColumns({"explicit": explicit | lettered, "n_fiscal": signal_group_count(norm, compact, v.fiscal, True), "negative": first_signal(norm, compact, v.negative, True)})
    return found.drop("_norm", "_compact")


def text_ladder(useful: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """The decision by explicit, n_fiscal and negative, first rule that fits."""
    explicit, fiscal, negative = F.col("explicit"), F.col("n_fiscal"), F.col("negative")
    n = fiscal.cast("string")
    return (
        F.when(~useful, _review("PDF_SIN_TEXTO", REASON["needs_ocr"]))
        .when(negative.isNotNull() & (~explicit | (negative != vocabulary.tolerated)), decision("DESCARTAR", "PDF_TEXTO", None, F.concat(F.lit(REASON["identified"]), negative, F.lit("."))))
        .when(explicit & (fiscal >= 3), decision("FACTURA", "PDF_TEXTO", F.least(F.lit(CONFIDENCE["most"]), CONFIDENCE["invoice"] + CONFIDENCE["signal"] * fiscal), F.concat(F.lit(REASON["explicit"]), n, F.lit(REASON["signals"]))))
        .when(explicit, _review("PDF_TEXTO", REASON["few_signals"], CONFIDENCE["few_signals"]))
        .when(fiscal >= 3, _review("PDF_TEXTO", F.concat(F.lit(REASON["found"]), n, F.lit(REASON["no_kind"])), CONFIDENCE["no_kind"]))
        .otherwise(_review("PDF_TEXTO_NO_CONCLUYENTE", REASON["unclear"]))
    )


def _decided(df: DataFrame, d: Column, keep: list[str]) -> DataFrame:
    return df.withColumn("_d", d).select(*keep, *(F.col(f"_d.{c}").alias(c) for c in DECISION))


def classify_text(df: DataFrame, text: str = "text", useful: Column | None = None, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """`df` with the decision by text. `useful` (default: enough letters and digits) tells whether there is a text to judge."""
    useful = useful_page_text(F.col(text)) if useful is None else useful
    return _decided(signals(df.withColumn("_useful", useful), text, vocabulary), text_ladder(F.col("_useful"), vocabulary), df.columns)


def classify_ocr(df: DataFrame, text: str = "text", vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """The same of an OCR text: method OCR, or inconclusive if the text is of no use."""
    found = signals(df.withColumn("_useful", useful_ocr_text(F.col(text))), text, vocabulary)
    judged = text_ladder(F.lit(True), vocabulary).withField("method", F.lit("OCR"))
    none = _review("OCR_NO_CONCLUYENTE", REASON["useless_ocr"])
    return _decided(found, F.when(F.col("_useful"), judged).otherwise(none), df.columns)


def name_decision(file_name: str) -> Column:
    ext, stem = F.lower(file_ext(F.col(file_name))), normalize_text(file_stem(F.col(file_name)))
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), _review("IMAGEN_SIN_OCR", REASON["image"]))
        .when(F.contains(stem, F.lit("FACTURA")), _review("NOMBRE_ARCHIVO", REASON["name"], CONFIDENCE["name"]))
        .otherwise(decision("DESCARTAR", "TIPO_NO_ADMITIDO", None, REASON["format"]))
    )


def classify_name(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """The decision by file name alone."""
    return _decided(df, name_decision(file_name), df.columns)


def document_kind(file_name: Column) -> Column:
    """'pdf', 'image' or 'other': which evidence a document has."""
    ext = F.lower(file_ext(file_name))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("other")


def second_pass(longest: int = 200_000) -> Column:
    """The text of the second pass: that of the pages and that of their heads, on lines of their own. NULL unless the first decision
    (`_first`) is a review and the heads could be read: only then is it formed and judged."""
    between = F.when((F.length("text") > 0) & (F.length("header_text") > 0), "\n").otherwise("")
    again = F.col("success") & F.col("header_success") & (F.col("_first.classification") == "REVISAR")
    return F.when(again, F.substring(F.concat("text", between, "header_text"), 1, longest))


def _failure(docs: DataFrame, columns: tuple[str, ...], default: str) -> Column:
    """The first reason that the input states, or a default."""
    return F.coalesce(*(F.col(c) for c in columns if c in docs.columns), F.lit(default))


def classify_ocr_two_pass(docs: DataFrame, vocabulary: Vocabulary = VOCABULARY, longest: int = 200_000) -> DataFrame:
    """docs: doc_id, success, text, header_success, header_text and, where it is known, failure (why the first pass failed).

    A failed first pass is an error; a decision other than review stands; else the text of the page heads is added and judged together,
    unless that pass failed. Both decisions stand in one row, so nothing is joined and no filter repeats the normalisation.
    """
    first = classify_ocr(docs, "text", vocabulary).withColumn("_first", F.struct(*DECISION)).drop(*DECISION)
    both = classify_ocr(first.withColumn("_both", second_pass(longest)), "_both", vocabulary)
    error = _review("OCR_ERROR", _failure(docs, ("failure",), REASON["ocr_failed"]))
    d = F.when(~F.col("success"), error).when(F.col("_both").isNotNull(), F.struct(*DECISION)).otherwise(F.col("_first"))
    return _decided(both.withColumn("_e", d).drop(*DECISION), F.col("_e"), docs.columns)


def route_textless(docs: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """PDFs without text. docs: as of two passes, with over_limit and n_images and, where they are known, image_failure and text_failure
    (why no image or no text could be read)."""
    judged = classify_ocr_two_pass(docs, vocabulary)
    over = _failure(docs, ("image_failure",), REASON["over_limit"])
    none = _failure(docs, ("image_failure", "text_failure"), REASON["no_image"])
    d = F.when(F.col("over_limit"), _review("OCR_LIMITE", over)).when(F.col("n_images") == 0, _review("OCR_NO_DISPONIBLE", none)).otherwise(F.struct(*DECISION))
    return _decided(judged.withColumn("_e", d).drop(*DECISION), F.col("_e"), docs.columns)


#: Types of fiscal vouchers.
INVOICE_TYPES = (1, 6, 11, 19, 51, 201, 206, 211)
OTHER_TYPES = (2, 3, 4, 7, 8, 9, 12, 13, 15, 20, 21, 52, 53, 54, 202, 203, 207, 208, 212, 213)


def in_code_set(c: Column, codes: tuple[int, ...]) -> Column:
    return F.coalesce(c.isin(*codes), F.lit(False))


def qr_type_class(c: Column) -> Column:
    """'invoice', 'other', or NULL for types of neither set."""
    return F.when(in_code_set(c, INVOICE_TYPES), "invoice").when(in_code_set(c, OTHER_TYPES), "other")


def combine_qr_text(df: DataFrame) -> DataFrame:
    """df: the decision by text, qr_valid, qr_type. The decision after both met."""
    kind = F.when(F.coalesce(F.col("qr_valid"), F.lit(False)), qr_type_class(F.col("qr_type")))
    by_text = F.col("classification")
    with_method = F.when((by_text == "FACTURA") & (F.coalesce(F.trim("method"), F.lit("")) != ""), F.concat(F.lit("QR_ARCA+"), F.col("method"))).otherwise("QR_ARCA")
    valid = REASON["qr_invoice"]
    d = (
        F.when((kind == "invoice") & (by_text == "DESCARTAR"), _review("QR_TEXTO_CONFLICTO", REASON["qr_invoice_clash"], CONFIDENCE["qr_clash"]))
        .when(kind == "invoice", decision("FACTURA", with_method, CONFIDENCE["qr"], valid))
        .when((kind == "other") & (by_text == "FACTURA"), _review("QR_TEXTO_CONFLICTO", REASON["qr_other_clash"], CONFIDENCE["qr_clash"]))
        .when(kind == "other", decision("DESCARTAR", "QR_ARCA", CONFIDENCE["qr"], REASON["qr_other"]))
        .otherwise(F.struct(*DECISION))
    )
    return _decided(df.withColumn("_e", d).drop(*DECISION), F.col("_e"), [c for c in df.columns if c not in DECISION])


def combine_evidence(selections: DataFrame, qr: DataFrame) -> DataFrame:
    """Decisions by text joined with each document's QR evidence (doc_id, qr_detected, qr_valid, qr_type)."""
    met = selections.join(qr, "doc_id", "left").withColumn("qr_detected", F.coalesce("qr_detected", F.lit(False)))
    out = combine_qr_text(met)
    return out.withColumn("qr_type", F.when(F.col("qr_valid"), F.col("qr_type"))).drop("qr_valid")


def classify_documents(docs: DataFrame, qr: DataFrame, ocr: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """docs: doc_id, file_name, text (of its pages). qr: as above. ocr: doc_id, success, text, header_success, header_text, over_limit, n_images,
    and the failures where they are known.

    PDFs go by text, or by OCR without one, and then meet their QR code; images go by OCR; all others by name. Each document is one row
    that carries the text to be judged, of its pages or of its OCR, so documents, OCR and codes meet once and each text is normalised once.
    """
    kept = docs.select("doc_id", "file_name", F.col("text").alias("_page"), guess_mime(F.col("file_name")).alias("mime_type"), document_kind(F.col("file_name")).alias("_kind"))
    native = (F.col("_kind") == "pdf") & useful_page_text(F.col("_page"))
    met = with_ocr(kept.withColumn("_native", native), ocr)
    # a page's text is judged as an OCR text that needs no second pass
    judged = met.withColumns({"text": F.when(F.col("_native"), F.col("_page")).otherwise(F.when(F.col("_kind") != "other", F.col("text"))), "header_success": F.col("header_success") & ~F.col("_native")})
    judged = judged.withColumn("_useful", F.col("_native") | useful_ocr_text(F.col("text"))).drop("_page")
    ladder = text_ladder(F.lit(True), vocabulary)
    ocr_ladder = ladder.withField("method", F.lit("OCR"))
    none = _review("OCR_NO_CONCLUYENTE", REASON["useless_ocr"])
    first = signals(judged, "text", vocabulary).withColumn("_first", F.when(F.col("_native"), ladder).when(F.col("_useful"), ocr_ladder).otherwise(none)).drop("explicit", "n_fiscal", "negative")
    both = first.withColumn("_both", F.when(~F.col("_native") & (F.col("_kind") != "other"), second_pass()))
    both = signals(both.withColumn("_useful", useful_ocr_text(F.col("_both"))), "_both", vocabulary)
    second = F.when(F.col("_useful"), ocr_ladder).otherwise(none)
    error = _review("OCR_ERROR", _failure(met, ("failure",), REASON["ocr_failed"]))
    over = _failure(met, ("image_failure",), REASON["over_limit"])
    no_image = _failure(met, ("image_failure", "text_failure"), REASON["no_image"])
    textless = (F.col("_kind") == "pdf") & ~F.col("_native")
    d = (
        F.when(F.col("_native"), F.col("_first"))
        .when(F.col("_kind") == "other", name_decision("file_name"))
        .when(textless & F.col("over_limit"), _review("OCR_LIMITE", over))
        .when(textless & (F.col("n_images") == 0), _review("OCR_NO_DISPONIBLE", no_image))
        .when(~F.col("success"), error)
        .when(F.col("_both").isNotNull(), second)
        .otherwise(F.col("_first"))
    )
    decided = _decided(both, d, ["doc_id", "file_name", "mime_type", "_kind"])
    codes = qr.select("doc_id", *(F.col(c).alias(f"_{c}") for c in ("qr_detected", "qr_valid", "qr_type")))
    pdf = F.col("_kind") == "pdf"  # codes are looked for in PDFs only
    seen = decided.join(codes, "doc_id", "left").withColumns({
        "qr_detected": pdf & F.coalesce("_qr_detected", F.lit(False)), "qr_valid": F.when(pdf, F.col("_qr_valid")), "qr_type": F.when(pdf & F.col("_qr_valid"), F.col("_qr_type")),
    })
    return combine_qr_text(seen.drop("_qr_detected", "_qr_valid", "_qr_type", "_kind")).drop("qr_valid")


def with_ocr(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """A document without OCR rows has no image and a failed pass."""
    none = {"success": False, "header_success": False, "text": "", "header_text": "", "over_limit": False, "n_images": 0}
    met = docs.join(ocr, "doc_id", "left")
    return met.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in none.items()})


def unanalysable_candidates(containers: DataFrame) -> DataFrame:
    """One review row for each container that could not be read. containers: name, failure."""
    reason = F.concat(F.lit(REASON["container"]), safe_reason(F.col("failure")))
    mime = F.coalesce("mime_type", guess_mime(F.col("name")), F.lit("application/octet-stream")) if "mime_type" in containers.columns else F.coalesce(guess_mime(F.col("name")), F.lit("application/octet-stream"))
    kept = [c for c in containers.columns if c not in ("failure", "mime_type")]
    return _decided(containers.withColumn("mime_type", mime), _review("ZIP_NO_ANALIZABLE", reason), [*kept, "mime_type"])
