"""Queries over texts, names, codes, containers and OCR pages: normalisation, classification, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files, qr, text
from ..operators import classify as C
from ..operators import containers as K
from ..operators import ocr as O
from .define import query

V = C.VOCABULARY

_NORM = """trim(regexp_replace(replace(replace(strip_accents(upper(replace(replace({0}, 'ß', chr(57344)), 'ı', chr(57345)))),
    chr(57344), 'ß'), chr(57345), 'ı'), '[\\s\\p{{Z}}]+', ' ', 'g'))"""


def norm_sql(c: str) -> str:
    return _NORM.format(c)


def _has(p: str) -> str:
    whole = f"contains(' ' || n || ' ', ' {p} ')"
    return f"({whole} OR contains(k, '{text._compact(p)}'))" if " " in p else whole


_EXPLICIT = f"(({' OR '.join(map(_has, V.explicit))}) OR ({_has(V.word)} AND ({' OR '.join(map(_has, V.letters))})))"
_FISCAL = " + ".join(f"CAST({' OR '.join(map(_has, g))} AS INTEGER)" for g in V.fiscal)
_NEGATIVE = "CASE " + " ".join(f"WHEN {_has(p)} THEN '{p}'" for p in V.negative) + " END"


def signals_sql(source: str, column: str, key: str = "doc_id", more: str = "") -> str:
    return f"""SELECT {key}{more}, {_EXPLICIT} AS e, {_FISCAL} AS f, {_NEGATIVE} AS g FROM (SELECT *, regexp_replace(n, '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS k
      FROM (SELECT *, {norm_sql(column)} AS n FROM {source}))"""


def ladder_sql(method: str | None = None) -> dict[str, str]:
    m = lambda own: f"'{method or own}'"
    out = "g IS NOT NULL AND (NOT e OR g <> 'REMITO')"
    return {
        "classification": f"CASE WHEN {out} THEN 'DESCARTAR' WHEN e AND f >= 3 THEN 'FACTURA' ELSE 'REVISAR' END",
        "method": f"CASE WHEN {out} OR e OR f >= 3 THEN {m('PDF_TEXTO')} ELSE {m('PDF_TEXTO_NO_CONCLUYENTE')} END",
        "confidence": f"CAST(CASE WHEN {out} THEN NULL WHEN e AND f >= 3 THEN least(95, 70 + 4 * f) WHEN e THEN 55 WHEN f >= 3 THEN 45 END AS SMALLINT)",
        "reason": f"""CASE WHEN {out} THEN 'Documento identificado como ' || g || '.' WHEN e AND f >= 3 THEN 'Factura explícita y ' || f || ' señales fiscales.'
          WHEN e THEN 'Factura explícita con señales fiscales insuficientes.' WHEN f >= 3 THEN 'Se detectaron ' || f || ' señales fiscales sin tipo de factura explícito.'
          ELSE 'El texto obtenido no permite clasificar el documento con seguridad.' END""",
    }


def _columns(parts: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in parts.items())


_USEFUL = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 30"
_USEFUL_OCR = """(length(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= 30 AND length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) >= 15
  AND len(regexp_extract_all({0}, '\\p{{L}}[\\p{{L}}\\p{{N}}]{{1,}}')) >= 5)"""


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS norm FROM doc_text")
def normalize_text(t):
    return t("doc_text").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("compact_text", f"SELECT doc_id, regexp_replace({norm_sql('text')}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS compact FROM doc_text")
def compact_text(t):
    return t("doc_text").select("doc_id", text.compact_text(text.normalize_text(F.col("text"))).alias("compact"))


@query("useful_text", f"SELECT doc_id, {_USEFUL.format('text')} AS page, {_USEFUL_OCR.format('text')} AS ocr FROM doc_text")
def useful_text(t):
    return t("doc_text").select("doc_id", text.useful_page_text(F.col("text")).alias("page"), text.useful_ocr_text(F.col("text")).alias("ocr"))


@query("text_signals", f"SELECT doc_id, e AS explicit, f AS n_fiscal, g AS negative FROM ({signals_sql('doc_text', 'text')})")
def text_signals(t):
    return C.signals(t("doc_text"), "text").select("doc_id", "explicit", "n_fiscal", "negative")


_NONE = {"classification": "'REVISAR'", "method": "'PDF_SIN_TEXTO'", "confidence": "CAST(NULL AS SMALLINT)", "reason": "'Requiere OCR futuro.'"}


@query("classify_text", f"SELECT doc_id, {_columns({k: f'CASE WHEN NOT u THEN {_NONE[k]} ELSE {v} END' for k, v in ladder_sql().items()})} FROM ({signals_sql('doc_text', 'text', more=', ' + _USEFUL.format('text') + ' AS u')})")
def classify_text(t):
    return C.classify_text(t("doc_text")).select("doc_id", *C.DECISION)


_NO_OCR = {"classification": "'REVISAR'", "method": "'OCR_NO_CONCLUYENTE'", "confidence": "CAST(NULL AS SMALLINT)", "reason": "'El OCR no produjo texto utilizable para clasificar el documento.'"}


def ocr_sql(u: str = "u") -> str:
    return _columns({k: f"CASE WHEN NOT {u} THEN {_NO_OCR[k]} ELSE {v} END" for k, v in ladder_sql("OCR").items()})


@query("classify_ocr", f"SELECT doc_id, {ocr_sql()} FROM ({signals_sql('doc_text', 'text', more=', ' + _USEFUL_OCR.format('text') + ' AS u')})")
def classify_ocr(t):
    return C.classify_ocr(t("doc_text")).select("doc_id", *C.DECISION)


_EXT = "lower(regexp_extract(file_name, '(\\.[^.\\\\/:]+)$', 1))"
_IMAGES = "('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff')"
_NAMED = f"contains({norm_sql('''regexp_replace(file_name, '\\.[^.]*$', '')''')}, 'FACTURA')"
_NAME_DECISION = {
    "classification": f"CASE WHEN {_EXT} IN {_IMAGES} OR {_NAMED} THEN 'REVISAR' ELSE 'DESCARTAR' END",
    "method": f"CASE WHEN {_EXT} IN {_IMAGES} THEN 'IMAGEN_SIN_OCR' WHEN {_NAMED} THEN 'NOMBRE_ARCHIVO' ELSE 'TIPO_NO_ADMITIDO' END",
    "confidence": f"CAST(CASE WHEN {_EXT} IN {_IMAGES} THEN NULL WHEN {_NAMED} THEN 30 END AS SMALLINT)",
    "reason": f"CASE WHEN {_EXT} IN {_IMAGES} THEN 'Imagen pendiente de OCR.' WHEN {_NAMED} THEN 'El nombre sugiere una factura; requiere revisión.' ELSE 'Formato sin evidencia de factura.' END",
}


@query("classify_name", f"SELECT doc_id, {_columns(_NAME_DECISION)} FROM doc_text")
def classify_name(t):
    return C.classify_name(t("doc_text")).select("doc_id", *C.DECISION)


@query("document_kind", f"SELECT doc_id, CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN {_IMAGES} THEN 'image' ELSE 'other' END AS kind FROM doc_text")
def document_kind(t):
    return t("doc_text").select("doc_id", C.document_kind(F.col("file_name")).alias("kind"))


_MIME = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{m}'" for e, m in files.MIMES.items()) + " END"


@query("file_names", f"""SELECT doc_id, {_EXT} AS ext, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, {_MIME} AS mime, 'file' || doc_id || CASE WHEN doc_id % 5 = 3 THEN ' Fáctura' ELSE '' END
    || '_' || substr(sha256(text), 1, 12) || regexp_extract(file_name, '(\\.[^.]+)$', 1) AS safe, sha256(text) AS hash FROM doc_text""")
def file_names(t):
    name = F.col("file_name")
    return t("doc_text").select("doc_id", F.lower(files.file_ext(name)).alias("ext"), files.file_stem(name).alias("stem"), files.guess_mime(name).alias("mime"),
        files.safe_file_name(name, F.col("text")).alias("safe"), files.sha256_hex(F.col("text")).alias("hash"))


_MAGIC = "CASE WHEN h LIKE '504B0304%' THEN 'zip' WHEN h LIKE '526172211A0700%' THEN 'rar' WHEN h LIKE '377ABCAF271C%' THEN '7z' END"


@query("is_container", f"""SELECT doc_id, {_MAGIC} AS magic, CASE WHEN x IN ('.zip', '.rar', '.7z') THEN true WHEN x = '.xlsx' THEN false WHEN doc_id % 3 = 0 THEN true ELSE {_MAGIC} IS NOT NULL END AS container
    FROM (SELECT doc_id, {_EXT} AS x, CASE doc_id % 4 WHEN 0 THEN '504B0304FF' WHEN 1 THEN '526172211A0700' WHEN 2 THEN '377ABCAF271C00' ELSE '50' END AS h FROM doc_text)""")
def is_container(t):
    n = F.col("doc_id") % 4
    head = F.unhex(F.when(n == 0, "504B0304FF").when(n == 1, "526172211A0700").when(n == 2, "377ABCAF271C00").otherwise("50"))
    mime = F.when(F.col("doc_id") % 3 == 0, "Application/ZIP")
    return t("doc_text").select("doc_id", files.container_magic(head).alias("magic"), files.is_container(F.col("file_name"), mime, head).alias("container"))


@query("origin_hash", """SELECT id, CASE WHEN origin = 'ZIP' THEN sha256('a.zip!/' || name || '|' || sha256(name)) ELSE sha256(name) END AS hash, CASE WHEN origin = 'ZIP' THEN 'a.zip!/' || name END AS chain FROM ledger""")
def origin_hash(t):
    chain = F.when(F.col("origin") == "ZIP", K.container_chain(F.lit("a.zip"), F.col("name")))
    return t("ledger").select("id", files.origin_hash(F.col("name"), chain).alias("hash"), chain.alias("chain"))



@query("safe_values", """SELECT doc_id, substr(replace(replace(text, chr(13), ' '), chr(10), ' '), 1, 300) AS reason, substr(text, 1, 500) AS name,
    substr(regexp_replace(regexp_replace(text, '["<>|:*?/\\\\\\x00-\\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 120) AS segment, lower(regexp_extract(file_name, '(\\.[^.]+)$', 1)) AS ext FROM doc_text""")
def safe_values(t):
    return t("doc_text").select("doc_id", files.safe_reason(F.col("text")).alias("reason"), files.safe_original_name(F.col("text")).alias("name"),
        files.safe_segment(F.col("text")).alias("segment"), files.safe_extension(files.file_ext(F.col("file_name"))).alias("ext"))


_LINE = "trim(replace(replace(text, chr(13), ' '), chr(10), ' '), ' ')"
_REDACTED = f"regexp_replace(regexp_replace({_LINE}, '{text.REDACT_URL}', '[URL omitida]', 'g'), '{text.REDACT_SECRET}', '\\1=[REDACTADO]', 'g')"


@query("redact", f"SELECT doc_id, CASE WHEN length(r) > 500 THEN substr(r, 1, 500) || '...' ELSE r END AS safe FROM (SELECT doc_id, {_REDACTED} AS r FROM documents)")
def redact(t):
    return t("doc_source").select("doc_id", text.redact(F.col("text")).alias("safe"))


@query("base64url", "SELECT doc_id, doc_id % 3 <> 1 AS good, CASE WHEN doc_id % 3 <> 1 THEN sha256(text) END AS hash FROM doc_text")
def base64url(t):
    encoded = F.translate(F.base64(F.col("text").cast("binary")), "+/=\r\n", "-_")
    broken = F.when(F.col("doc_id") % 3 == 1, F.concat(encoded, F.lit("!"))).otherwise(encoded)
    data = text.base64url_strict(broken)
    return t("doc_text").select("doc_id", data.isNotNull().alias("good"), files.sha256_hex(data).alias("hash"))


_GATE = "regexp_matches(qr_text, '^https://(www\\.)?(arca|afip)\\.gob\\.ar(:443)?/fe/qr/\\?[^#]*$', 'i') AND length(qr_text) <= 12000"
_P = "CASE WHEN regexp_matches(regexp_extract(qr_text, '\\?([^#]*)', 1), '^p=[^&]+$') THEN replace(regexp_extract(qr_text, '\\?p=([^#&]*)', 1), '%2B', '+') END"
_OBJ = f"CASE WHEN {_GATE} THEN decode(from_base64({_P})) END"
_VALID = """(j->>'ver' = '1' AND regexp_matches(j->>'fecha', '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(j->>'fecha' AS DATE) IS NOT NULL AND regexp_matches(j->>'cuit', '^\\d{11}$')
  AND regexp_matches(j->>'ptoVta', '^\\d{1,5}$') AND regexp_matches(j->>'tipoCmp', '^\\d{1,3}$') AND regexp_matches(j->>'nroCmp', '^\\d{1,8}$') AND regexp_matches(j->>'importe', '^\\+?[\\d.]+$')
  AND regexp_matches(j->>'moneda', '^[A-Z]{3}$') AND regexp_matches(j->>'ctz', '^\\+?[\\d.]+$') AND j->>'tipoCodAut' IN ('A', 'E') AND regexp_matches(j->>'codAut', '^\\d{14}$')
  AND len(json_keys(j)) = len(list_distinct(json_keys(j)))
  AND ((NOT list_contains(json_keys(j), 'tipoDocRec') AND NOT list_contains(json_keys(j), 'nroDocRec')) OR (regexp_matches(j->>'tipoDocRec', '^\\d{1,2}$') AND regexp_matches(j->>'nroDocRec', '^\\d{1,20}$'))))"""
_READ = f"SELECT *, coalesce({_VALID}, false) AS ok FROM (SELECT *, CAST({_OBJ} AS JSON) AS j FROM qr_readings)"


@query("qr_gates", f"SELECT image, {_GATE} AS url_ok, {_P} AS payload, octet_length(from_base64({_P})) AS n_bytes FROM qr_readings")
def qr_gates(t):
    data = qr.base64url_lenient(qr.qr_query_payload(F.col("qr_text")))
    return t("qr_readings").select("image", qr.qr_url_ok(F.col("qr_text")).alias("url_ok"), qr.qr_query_payload(F.col("qr_text")).alias("payload"), F.octet_length(data).cast("long").alias("n_bytes"))


@query("qr_evidence", f"SELECT image, true AS qr_detected, ok AS qr_valid, CASE WHEN ok THEN CAST(j->>'tipoCmp' AS INTEGER) END AS qr_type FROM ({_READ})")
def qr_evidence(t):
    return qr.qr_evidence(t("qr_readings")).select("image", "qr_detected", "qr_valid", "qr_type")


_FIRST = f"""SELECT doc_id, true AS qr_detected, bool_or(ok) AS qr_valid, arg_min(CAST(j->>'tipoCmp' AS INTEGER), k) FILTER (ok) AS qr_type
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, image) AS k FROM ({_READ}) WHERE n_pages <= 20 OR page <= 19 OR page = n_pages) WHERE k <= 100 GROUP BY doc_id"""


@query("first_valid_qr", _FIRST)
def first_valid_qr(t):
    return qr.first_valid_qr(t("qr_readings"))


_INVOICE, _OTHER = f"(v AND y IN {C.INVOICE_TYPES})", f"(v AND y IN {C.OTHER_TYPES})"
_DECIDED = ladder_sql()


def combined_sql(d: dict[str, str]) -> dict[str, str]:
    """The decision `d` after it met v (valid) and y (type)."""
    c = d["classification"]
    clash = f"(({_INVOICE} AND {c} = 'DESCARTAR') OR ({_OTHER} AND {c} = 'FACTURA'))"
    return {
        "classification": f"CASE WHEN {clash} THEN 'REVISAR' WHEN {_INVOICE} THEN 'FACTURA' WHEN {_OTHER} THEN 'DESCARTAR' ELSE {c} END",
        "method": f"CASE WHEN {clash} THEN 'QR_TEXTO_CONFLICTO' WHEN {_INVOICE} AND {c} = 'FACTURA' THEN 'QR_ARCA+' || {d['method']} WHEN {_INVOICE} OR {_OTHER} THEN 'QR_ARCA' ELSE {d['method']} END",
        "confidence": f"CAST(CASE WHEN {clash} THEN 70 WHEN {_INVOICE} OR {_OTHER} THEN 98 ELSE {d['confidence']} END AS SMALLINT)",
        "reason": f"""CASE WHEN {_INVOICE} AND {c} = 'DESCARTAR' THEN 'El QR ARCA indica factura, pero el texto identifica inequívocamente otro tipo documental.'
          WHEN {_OTHER} AND {c} = 'FACTURA' THEN 'El QR ARCA indica un comprobante no factura, pero el texto identifica factura.'
          WHEN {_INVOICE} THEN 'QR ARCA estructuralmente válido con tipo de comprobante factura. No constituye validación online de autenticidad.'
          WHEN {_OTHER} THEN 'El tipo de comprobante informado por el QR ARCA no corresponde a una factura.' ELSE {d['reason']} END""",
    }


_JOINED = f"SELECT s.*, coalesce(q.qr_valid, false) AS v, q.qr_type AS y, coalesce(q.qr_detected, false) AS qd FROM ({signals_sql('doc_text', 'text')}) s LEFT JOIN ({_FIRST}) q ON q.doc_id = s.doc_id"


@query("combine_evidence", f"SELECT doc_id, {_columns(combined_sql(_DECIDED))}, qd AS qr_detected, CASE WHEN v THEN y END AS qr_type FROM ({_JOINED})")
def combine_evidence(t):
    selections = C.classify_text(t("doc_text").select("doc_id", "text"), "text", F.lit(True)).drop("text")
    return C.combine_evidence(selections, qr.first_valid_qr(t("qr_readings"))).select("doc_id", *C.DECISION, "qr_detected", "qr_type")


_FAIL = """SELECT *, CASE WHEN n > 200 THEN 'entries' WHEN NOT is_directory AND (is_encrypted OR coalesce(link_target, '') <> '') THEN 'unsupported'
    WHEN NOT is_directory AND (starts_with(entry_key, '/') OR contains(entry_key, ':')) THEN 'path' WHEN NOT is_directory AND starts_with(entry_key, '../') THEN 'traversal'
    WHEN NOT is_directory AND c > 1 THEN 'collision' WHEN NOT is_directory AND entry_bytes > 52428800 AND 640 <= (262144000 - (b - entry_bytes)) // 81920 THEN 'entry_bytes' WHEN NOT is_directory AND b > 262144000 THEN 'total_bytes' END AS failure
  FROM (SELECT *, count(*) OVER w AS n, sum(CASE WHEN is_directory THEN 0 ELSE entry_bytes END) OVER w AS b,
    row_number() OVER (PARTITION BY root_id, CASE WHEN is_directory THEN CAST(ordinal AS VARCHAR) ELSE lower(entry_key) END ORDER BY ordinal) AS c
    FROM container_entries WINDOW w AS (PARTITION BY root_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING))"""
_FAILED = f"SELECT *, min(CASE WHEN failure IS NOT NULL THEN ordinal END) OVER (PARTITION BY root_id) AS stop FROM ({_FAIL})"


@query("container_failures", f"SELECT root_id, ordinal, failure, stop AS failed_at, n AS n_seen, CAST(b AS BIGINT) AS bytes_seen FROM ({_FAILED})")
def container_failures(t):
    return K.first_violation(t("container_entries")).select("root_id", "ordinal", "failure", "failed_at", "n_seen", "bytes_seen")


@query("container_accepted", f"SELECT root_id, ordinal, entry_key FROM ({_FAILED}) WHERE stop IS NULL AND NOT is_directory")
def container_accepted(t):
    return K.apply_container_policy(t("container_entries"))[0].select("root_id", "ordinal", "entry_key")


@query("container_refused", f"SELECT root_id, ordinal, failure FROM ({_FAILED}) WHERE ordinal = stop")
def container_refused(t):
    return K.apply_container_policy(t("container_entries"))[1]


@query("container_rollup", f"SELECT root_id, count(*) FILTER (stop IS NULL AND NOT is_directory) AS n_analysed, bool_or(stop IS NOT NULL) AS failed FROM ({_FAILED}) GROUP BY root_id")
def container_rollup(t):
    return K.container_rollup(t("container_entries"))


#: Large entries lie in an inner archive, the last entry of its container, and the largest in one inside that, which is too deep.
INNER, DEEP = "entry_bytes > 31500000", "entry_bytes > 47250000"
_FIELDS = "is_directory, is_encrypted, link_target"
_TREE = f"""SELECT root_id, 0 AS c, ordinal, entry_key, entry_bytes, {_FIELDS} FROM container_entries WHERE NOT ({INNER})
    UNION ALL SELECT DISTINCT root_id, 0, 1000, 'inner.zip', 1000, false, false, CAST(NULL AS VARCHAR) FROM container_entries WHERE {INNER}
    UNION ALL SELECT DISTINCT root_id, 1, 2000, 'deep.zip', 1000, false, false, CAST(NULL AS VARCHAR) FROM container_entries WHERE {DEEP}
    UNION ALL SELECT root_id, 1, ordinal, entry_key, entry_bytes, {_FIELDS} FROM container_entries WHERE {INNER} AND NOT ({DEEP})"""
_TREE_FAIL = _FAIL.replace("ORDER BY ordinal)", "ORDER BY c0, ordinal)").replace("PARTITION BY root_id ORDER BY ordinal ROWS", "PARTITION BY root_id ORDER BY c0, ordinal ROWS").replace("PARTITION BY root_id, CASE", "PARTITION BY root_id, c0, CASE").replace("FROM container_entries", f"FROM (SELECT * RENAME (c AS c0) FROM ({_TREE}))")
_TREE_STOPS = f"SELECT *, min(CASE WHEN failure IS NOT NULL THEN ordinal END) OVER (PARTITION BY root_id, c0) AS stop, bool_or(failure IS NOT NULL AND c0 = 0) OVER (PARTITION BY root_id) AS lost FROM ({_TREE_FAIL})"


@query("container_nested", f"""SELECT root_id, ordinal, entry_key, 'accepted' AS outcome, CAST(NULL AS VARCHAR) AS failure FROM ({_TREE_STOPS}) WHERE NOT lost AND stop IS NULL AND NOT is_directory AND ordinal < 1000
    UNION ALL SELECT root_id, 0, 'root', 'refused', failure FROM ({_TREE_STOPS}) WHERE c0 = 0 AND ordinal = stop
    UNION ALL SELECT root_id, 1000, 'inner.zip', 'refused', failure FROM ({_TREE_STOPS}) WHERE NOT lost AND c0 = 1 AND ordinal = stop
    UNION ALL SELECT root_id, ordinal, entry_key, 'refused', 'depth' FROM ({_TREE_STOPS}) WHERE NOT lost AND stop IS NULL AND ordinal = 2000""")
def container_nested(t):
    """Trees of three levels with one budget: what fails inside refuses the inner archive only, and the third level is too deep."""
    entries = t("container_entries")
    inner, deep = -2 * F.col("root_id") - 1, -2 * F.col("root_id") - 2
    own = entries.withColumns({"container_id": F.when(F.expr(DEEP), deep).when(F.expr(INNER), inner).otherwise(F.col("root_id")), "child_id": F.lit(None).cast("long")})

    def archive(which, name, ordinal, within, child):
        return entries.where(which).select("root_id").distinct().withColumns({
            "ordinal": F.lit(ordinal), "entry_key": F.lit(name), "entry_bytes": F.lit(1000).cast("long"), "is_directory": F.lit(False), "is_encrypted": F.lit(False),
            "link_target": F.lit(None).cast("string"), "container_id": within, "child_id": child,
        })

    archives = archive(INNER, "inner.zip", 1000, F.col("root_id"), inner).unionByName(archive(DEEP, "deep.zip", 2000, inner, deep))
    tree = own.unionByName(archives).withColumn("root_name", F.lit("root"))
    return K.apply_nested_policy(tree).select("root_id", "ordinal", "entry_key", "outcome", "failure")


@query("unanalysable", f"""SELECT root_id, 'REVISAR' AS classification, 'ZIP_NO_ANALIZABLE' AS method, 'Contenedor no analizable: ' || failure AS reason, 'application/zip' AS mime_type FROM ({_FAILED}) WHERE ordinal = stop""")
def unanalysable(t):
    refused = K.apply_container_policy(t("container_entries"))[1].withColumn("name", F.lit("a.zip"))
    return C.unanalysable_candidates(refused).select("root_id", "classification", "method", "reason", "mime_type")


_ROLL = """SELECT doc_id, pass, arg_min(failure, (page, text)) FILTER (failure IS NOT NULL) AS failure, string_agg(part || ' ', '' ORDER BY page, text) FILTER (part IS NOT NULL) AS text, avg(confidence) AS mean_confidence, count(*) AS n_pages
  FROM (SELECT *, CASE WHEN 200000 - b > 0 THEN substr(text, 1, CAST(200000 - b AS BIGINT)) END AS part FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, pass ORDER BY page, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ocr_pages))
  GROUP BY doc_id, pass"""


@query("ocr_rollup", f"SELECT doc_id, pass, coalesce(text, '') AS text, mean_confidence, n_pages FROM ({_ROLL})")
def ocr_rollup(t):
    return O.ocr_rollup(t("ocr_pages")).select("doc_id", "pass", "text", "mean_confidence", "n_pages")


_OVER = """SELECT doc_id, bool_or(px > 16000000 OR s > 40000000 OR k > 5) AS over_limit, count(*) AS n_images FROM (SELECT doc_id, px, sum(px) OVER w AS s, count(*) OVER w AS k
    FROM (SELECT *, CAST(width AS BIGINT) * height AS px FROM ocr_pages WHERE pass = 'full') WINDOW w AS (PARTITION BY doc_id ORDER BY page, width, height ROWS UNBOUNDED PRECEDING)) GROUP BY doc_id"""


@query("ocr_limits", _OVER)
def ocr_limits(t):
    return O.ocr_limits(t("ocr_pages").where("pass = 'full'"))


@query("cap_images", "SELECT doc_id, image FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, image) AS k FROM qr_readings) WHERE k <= 2")
def cap_images(t):
    return O.cap_images(t("qr_readings"), 2).select("doc_id", "image")


@query("cap_images_flag", "SELECT doc_id, image, count(*) OVER (PARTITION BY doc_id) > 4 AS over_cap FROM qr_readings")
def cap_images_flag(t):
    return O.cap_images(t("qr_readings"), 4, "fail").select("doc_id", "image", "over_cap")


_EVIDENCE = f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AND a.failure IS NULL AS success, coalesce(a.text, '') AS text, a.failure,
    b.doc_id IS NOT NULL AND b.failure IS NULL AS header_success, coalesce(b.text, '') AS header_text, coalesce(o.over_limit, false) AS over_limit, coalesce(o.n_images, 0) AS n_images
    FROM (SELECT * FROM ({_ROLL}) WHERE pass = 'full') a FULL JOIN (SELECT * FROM ({_ROLL}) WHERE pass = 'header') b ON a.doc_id = b.doc_id LEFT JOIN ({_OVER}) o ON o.doc_id = a.doc_id"""
_KEPT = ", success, header_success, text, header_text, failure, over_limit, n_images, "
_FIRST_PASS = f"SELECT * FROM (SELECT doc_id{_KEPT}{ocr_sql()} FROM ({signals_sql(f'({_EVIDENCE})', 'text', more=_KEPT + _USEFUL_OCR.format('text') + ' AS u')}))"
_BOTH = f"SELECT doc_id, substr(text || CASE WHEN text <> '' AND header_text <> '' THEN chr(10) ELSE '' END || header_text, 1, 200000) AS t FROM ({_FIRST_PASS}) WHERE success AND header_success AND classification = 'REVISAR'"
_SECOND_PASS = f"SELECT doc_id, {ocr_sql()} FROM ({signals_sql(f'({_BOTH})', 't', more=', ' + _USEFUL_OCR.format('t') + ' AS u')})"


def _two(c: str) -> str:
    error = {"classification": "'REVISAR'", "method": "'OCR_ERROR'", "confidence": "NULL", "reason": "coalesce(a.failure, 'El OCR no pudo procesar el documento.')"}[c]
    return f"CASE WHEN NOT a.success THEN {error} WHEN b.doc_id IS NOT NULL THEN b.{c} ELSE a.{c} END AS {c}"


_TWO_PASS = f"SELECT a.doc_id, a.over_limit, a.n_images, {', '.join(map(_two, C.DECISION))} FROM ({_FIRST_PASS}) a LEFT JOIN ({_SECOND_PASS}) b ON b.doc_id = a.doc_id"


@query("classify_ocr_two_pass", f"SELECT doc_id, {', '.join(C.DECISION)} FROM ({_TWO_PASS})")
def classify_ocr_two_pass(t):
    return C.classify_ocr_two_pass(O.ocr_evidence(t("ocr_pages"))).select("doc_id", *C.DECISION)


def _routed(d: str, over: str, none: str) -> dict[str, str]:
    """The decision of table `d`, or what its images say."""
    given = {
        "classification": ("'REVISAR'", "'REVISAR'"), "method": ("'OCR_LIMITE'", "'OCR_NO_DISPONIBLE'"), "confidence": ("NULL", "NULL"),
        "reason": ("'Las imágenes del PDF superan los límites de OCR.'", "'No hay una imagen procesable para OCR.'"),
    }
    return {c: f"CASE WHEN {over} THEN {a} WHEN {none} THEN {b} ELSE {d}.{c} END" for c, (a, b) in given.items()}


@query("route_textless", f"SELECT d.doc_id, {_columns(_routed('d', 'd.over_limit', 'd.n_images = 0'))} FROM ({_TWO_PASS}) d")
def route_textless(t):
    return C.route_textless(O.ocr_evidence(t("ocr_pages"))).select("doc_id", *C.DECISION)


_PDF = f"SELECT doc_id, {_columns(combined_sql(_DECIDED))}, qd AS qr_detected, CASE WHEN v THEN y END AS qr_type FROM ({_JOINED}) WHERE doc_id IN (SELECT doc_id FROM doc_text WHERE {_EXT} = '.pdf' AND {_USEFUL.format('text')})"
_D_EXT = _EXT.replace("file_name", "d.file_name")
#: PDFs without useful text: their OCR, and then their code.
_TEXTLESS = f"""SELECT d.doc_id, {_columns(_routed('o', 'coalesce(o.over_limit, false)', 'coalesce(o.n_images, 0) = 0'))}, coalesce(q.qr_valid, false) AS v, q.qr_type AS y, coalesce(q.qr_detected, false) AS qd
    FROM doc_text d LEFT JOIN ({_TWO_PASS}) o ON o.doc_id = d.doc_id LEFT JOIN ({_FIRST}) q ON q.doc_id = d.doc_id WHERE {_D_EXT} = '.pdf' AND NOT {_USEFUL.format("coalesce(d.text, '')")}"""
_BY_OCR = f"SELECT doc_id, {_columns(combined_sql({c: c for c in C.DECISION}))}, qd AS qr_detected, CASE WHEN v THEN y END AS qr_type FROM ({_TEXTLESS})"


@query("classify_documents", f"""{_PDF} UNION ALL {_BY_OCR}
    UNION ALL SELECT doc_id, classification, method, confidence, reason, false, NULL FROM (SELECT doc_id, {_columns(_NAME_DECISION)} FROM doc_text WHERE {_EXT} <> '.pdf' AND {_EXT} NOT IN {_IMAGES})
    UNION ALL SELECT d.doc_id, coalesce(x.classification, 'REVISAR'), coalesce(x.method, 'OCR_ERROR'), x.confidence, coalesce(x.reason, 'El OCR no pudo procesar el documento.'), false, NULL
      FROM doc_text d LEFT JOIN ({_TWO_PASS}) x ON x.doc_id = d.doc_id WHERE {_D_EXT} IN {_IMAGES}""")
def classify_documents(t):
    """All of it: PDFs by text or OCR and then by code, images by OCR, others by name."""
    return C.classify_documents(t("doc_text"), qr.first_valid_qr(t("qr_readings")), O.ocr_evidence(t("ocr_pages"))).select("doc_id", *C.DECISION, "qr_detected", "qr_type")
