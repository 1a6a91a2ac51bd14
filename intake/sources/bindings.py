"""Domain tables built from the benchmark tables, in SQL that Spark and the oracle both read.

`domain_sql(name, spark=True)` gives the text for Spark, `spark=False` the same for the oracle; they differ in the names of two
functions (SHA-256 and Base64) only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_NTH = """CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT)"""

_SQL = {
    "accounts": """
SELECT c_custkey AS id, c_name AS email, c_acctbal >= 0 AS active, c_custkey % 5 <> 0 AS has_token,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS last_history_id
FROM customer""",
    "messages": """
SELECT o_orderkey AS id, o_custkey AS account_id, concat('m', CAST(o_orderkey AS STRING)) AS message_id,
  o_orderdate AS received, concat('sender', CAST(o_custkey % 97 AS STRING)) AS sender,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS subject,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS snippet
FROM orders""",
    "attachments": f"""
SELECT l_orderkey * 1000 + {_NTH} AS id, l_orderkey AS message,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS part_id,
  CAST(l_quantity AS BIGINT) * CAST(l_partkey + 1 AS BIGINT) * 37 AS size_bytes,
  CASE WHEN l_returnflag = 'A' AND l_partkey % 3 <> 0 THEN concat('/store/', CAST(l_partkey AS STRING)) END AS path,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN SHA(CAST(l_partkey AS STRING)) END AS hash,
  CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS downloaded,
  CASE l_returnflag WHEN 'A' THEN 'Descargado' WHEN 'R' THEN 'Error' ELSE 'Pendiente' END AS state
FROM lineitem""",
    "ledger": f"""
SELECT l_orderkey * 1000 + {_NTH} AS id, l_orderkey AS message, CAST(l_linenumber AS STRING) AS part_id,
  CASE WHEN l_partkey % 4 = 0 THEN 'ZIP' ELSE 'DIRECTO' END AS origin,
  SHA(concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING))) AS origin_hash,
  concat('doc ', CAST(l_partkey AS STRING), '.pdf') AS name,
  CASE WHEN l_linestatus = 'O' THEN 'FACTURA' ELSE 'REVISAR' END AS classification,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(50 + l_linenumber * 6 AS SMALLINT) END AS confidence,
  l_shipdate AS classified
FROM lineitem WHERE l_quantity > 20""",
    "doc_text": """
SELECT doc_id, concat('file', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.xlsx'
    WHEN 3 THEN ' Fáctura.txt' ELSE '.zip' END) AS file_name,
  concat(CASE doc_id % 12
    WHEN 0 THEN 'Factura A CUIT CAE IVA Fecha de emisión '
    WHEN 1 THEN 'FACTURA B TOTAL '
    WHEN 2 THEN 'CUIT CAE IVA TOTAL '
    WHEN 3 THEN 'REMITO CUIT '
    WHEN 4 THEN 'FACTURA C REMITO CUIT CAE IVA '
    WHEN 5 THEN 'FACTURA C REMITO RECIBO CUIT CAE IVA '
    WHEN 6 THEN 'FACTURA E RECIBO CUIT CAE IVA '
    WHEN 7 THEN 'FACTURA ANTERIOR PTO. VTA. COMP. NRO. CUIT '
    WHEN 8 THEN 'CUIT: CAE: IVA: TOTAL: FACTURA '
    WHEN 9 THEN 'FACTURA DE CRÉDITO ELECTRÓNICA CUIT CAEA PUNTO DE VENTA COMPROBANTE IMPORTE TOTAL IVA FECHA DE EMISIÓN '
    WHEN 10 THEN 'NOTA   DE\tCRÉDITO CUIT '
    ELSE '' END, text) AS text
FROM documents""",
    "doc_source": "SELECT doc_id, text FROM documents",
    "qr_readings": """
SELECT CAST(CASE WHEN floor(page_id / 125) % 2 = 1 THEN floor(page_id / 125) * 5 ELSE floor(page_id / 25) END AS BIGINT) AS doc_id, CAST(page_id % 25 + 1 AS INT) AS page, CAST(25 AS INT) AS n_pages, CAST(page_id AS INT) AS image,
  concat(CASE page_id % 16 WHEN 1 THEN 'http' ELSE 'https' END, '://',
    CASE page_id % 16 WHEN 2 THEN 'example.com' WHEN 3 THEN 'WWW.AFIP.GOB.AR' WHEN 4 THEN 'afip.gob.ar:8443' WHEN 5 THEN 'afip.gob.ar:443'
      WHEN 6 THEN 'u@afip.gob.ar' ELSE 'www.arca.gob.ar' END,
    CASE page_id % 16 WHEN 7 THEN '/fe/' ELSE '/fe/QR/' END, '?p=',
    B64(concat('{"ver":', CASE page_id % 16 WHEN 8 THEN '2' ELSE '1' END,
      ',"fecha":"', CASE page_id % 16 WHEN 9 THEN '2024-2-3' ELSE '2024-02-03' END,
      '","cuit":"20123456789","ptoVta":1,"tipoCmp":', CASE page_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '999' END,
      ',"nroCmp":', CASE page_id % 16 WHEN 10 THEN '"+5"' ELSE '5' END,
      ',"importe":', CASE page_id % 16 WHEN 11 THEN '-1' ELSE '12.50' END,
      ',"moneda":"', CASE page_id % 16 WHEN 12 THEN 'pes' ELSE 'PES' END,
      '","ctz":1,"tipoCodAut":"E","codAut":"12345678901234"',
      CASE page_id % 16 WHEN 13 THEN ',"tipoDocRec":80' WHEN 14 THEN ',"tipoDocRec":80,"nroDocRec":"20111111112"'
        WHEN 15 THEN ',"ver":1' ELSE '' END, '}')),
    CASE WHEN page_id % 32 = 16 THEN '#x' WHEN page_id % 64 = 32 THEN '&p=1' ELSE '' END) AS qr_text
FROM pages""",
    "history": """
SELECT event_id AS history_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'messageAdded' ELSE 'other' END AS record_type,
  CASE WHEN user_id % 50 = 0 THEN '' ELSE concat('m', CAST(user_id AS STRING)) END AS message_id
FROM events""",
    "container_entries": f"""
SELECT l_orderkey AS root_id, CAST({_NTH} AS INT) AS ordinal,
  CASE WHEN l_partkey % 211 = 0 THEN concat('../', CAST(l_partkey AS STRING)) WHEN l_partkey % 223 = 0 THEN '/abs.pdf' WHEN l_partkey % 227 = 0 THEN 'c:x.pdf'
    ELSE concat('Dir/F', CAST(l_partkey % 40 AS STRING), '.pdf') END AS entry_key,
  CAST(l_quantity AS BIGINT) * 1050000 AS entry_bytes, l_linenumber = 6 AS is_directory, l_suppkey % 61 = 0 AS is_encrypted,
  CASE WHEN l_suppkey % 67 = 0 THEN 'target' END AS link_target
FROM lineitem""",
    "ocr_pages": """
SELECT conv_id AS doc_id, CASE WHEN role = 'assistant' THEN 'header' ELSE 'full' END AS pass, CAST(turn AS INT) AS page,
  CAST(1000 + (conv_id % 7) * 700 AS INT) AS width, CAST(1000 + turn * 500 AS INT) AS height, text,
  CAST((conv_id * 7 + turn * 3) % 100 AS DOUBLE) AS confidence,
  CASE WHEN (conv_id * 5 + turn * 11) % 29 = 0 THEN concat('Página ', CAST(turn AS STRING), ' ilegible.') END AS failure
FROM conversations""",
}
DOMAIN = tuple(_SQL)


def _call(sql: str, name: str, form: str) -> str:
    """Replaces NAME(x) by form.format(x), with x up to the matching parenthesis."""
    while (at := sql.find(f"{name}(")) >= 0:
        depth, end = 1, at + len(name) + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + form.replace("{}", sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def domain_sql(name: str, spark: bool = True) -> str:
    sha, b64 = ("sha2({}, 256)", "translate(base64({}), concat(chr(13), chr(10)), '')") if spark else ("sha256({})", "to_base64(encode({}))")
    return _call(_call(_SQL[name], "SHA", sha), "B64", b64)


def _numbered(text: str) -> str:
    """`text` over lineitem, with its rows numbered in a query of their own. In one SELECT Spark computes names and hashes before the window: hashes
    are shuffled then, and what is grouped or joined by `message` behind it is shuffled again, as that is not the column the window is dealt by."""
    head, table, tail = text.partition("FROM lineitem")
    return f"{head.replace(_NTH, '_nth')}FROM (SELECT *, {_NTH} AS _nth {table}{tail})" if _NTH in head else text


def with_domain(sql: str) -> str:
    """An oracle's text with the domain tables that it names as common table expressions."""
    used = [n for n in DOMAIN if n in sql]
    head = ", ".join(f"{n} AS ({domain_sql(n, spark=False)})" for n in used)
    body = sql.strip()
    return f"WITH {head}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}" if used else body


def domain_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table over the tables in `sf_dir`."""
    sources = {"accounts": "customer", "messages": "orders", "doc_text": "documents", "doc_source": "documents", "qr_readings": "pages", "history": "events", "ocr_pages": "conversations"}
    table = sources.get(name, "lineitem")
    text = _numbered(domain_sql(name)).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
