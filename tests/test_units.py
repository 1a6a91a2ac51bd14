"""Traps of single operators on small literal tables."""

import base64
import io
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from intake.functions import display, files, qr, text
from intake.operators import classify, containers, ledger, mime, ocr, quality, reports
from intake.plans import documents
from intake.sources import batches
from intake.streaming import intake_stream

LONG = " lorem ipsum dolor sit amet consectetur adipiscing elit"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw", ["  Emisión\t de   CRÉDITO\n", "ß ı ﬁ ŉ", "á Å ǅ", "", None, "ñandú\x85x\xa0y", "가각 Ω"])
def test_normalize_text(spark, raw):
    up = "".join(c if c in "ßı" or len(c.upper()) > 1 else c.upper() for c in raw or "")
    bare = "".join(c for c in unicodedata.normalize("NFD", up) if unicodedata.category(c) != "Mn")
    want = " ".join("".join(" " if c.isspace() else c for c in unicodedata.normalize("NFC", bare)).split(" ")).split()
    assert one(spark, raw, text.normalize_text) == " ".join(want)


LADDER = [
    ("Factura A" + LONG, "REVISAR", 55), ("FACTURA B CUIT CAE IVA" + LONG, "FACTURA", 82), ("FACTURA B CUIT CAE IVA TOTAL" + LONG, "FACTURA", 86),
    ("FACTURA B CUIT CAE IVA TOTAL COMPROBANTE" + LONG, "FACTURA", 90), ("FACTURA B CUIT CAE IVA TOTAL COMPROBANTE PTO VTA" + LONG, "FACTURA", 94),
    ("FACTURA B CUIT CAE IVA TOTAL COMPROBANTE PTO VTA FECHA DE EMISION" + LONG, "FACTURA", 95), ("CUIT CAE IVA" + LONG, "REVISAR", 45), ("CUIT: CAE: IVA:" + LONG, "REVISAR", None),
    ("REMITO" + LONG, "DESCARTAR", None), ("FACTURA A REMITO CUIT CAE IVA" + LONG, "FACTURA", 82), ("FACTURA A REMITO RECIBO CUIT CAE IVA" + LONG, "FACTURA", 82), ("FACTURA A RECIBO CUIT CAE IVA" + LONG, "DESCARTAR", None),
    ("FACTURA ANTERIOR" + LONG, "REVISAR", 55), ("factura ... a la vista" + LONG, "REVISAR", 55), ("nota   de\tcrédito" + LONG, "DESCARTAR", None), ("corto", "REVISAR", None), (None, "REVISAR", None),
]


def test_text_ladder(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LADDER)], "i int, text string")
    got = {r.i: (r.classification, r.confidence) for r in classify.classify_text(df).collect()}
    assert [got[i] for i in range(len(LADDER))] == [(c, n) for _, c, n in LADDER]


@pytest.mark.parametrize(
    "kind, own, want",
    [(1, "FACTURA", ("FACTURA", "QR_ARCA+PDF_TEXTO", 98)), (1, "REVISAR", ("FACTURA", "QR_ARCA", 98)), (1, "DESCARTAR", ("REVISAR", "QR_TEXTO_CONFLICTO", 70)), (3, "FACTURA", ("REVISAR", "QR_TEXTO_CONFLICTO", 70)),
     (3, "REVISAR", ("DESCARTAR", "QR_ARCA", 98)), (3, "DESCARTAR", ("DESCARTAR", "QR_ARCA", 98)), (999, "FACTURA", ("FACTURA", "PDF_TEXTO", 5)), (None, "REVISAR", ("REVISAR", "PDF_TEXTO", 5))],
)
def test_qr_matrix(spark, kind, own, want):
    df = spark.createDataFrame([(1, own, "PDF_TEXTO", 5, "r", kind is not None, kind)], "doc_id long, classification string, method string, confidence short, reason string, qr_valid boolean, qr_type int")
    r = classify.combine_qr_text(df).first()
    assert (r.classification, r.method, r.confidence) == want


GOOD = '{"ver":1,"fecha":"2024-02-03","cuit":20123456789,"ptoVta":1,"tipoCmp":6,"nroCmp":5,"importe":12.5,"moneda":"PES","ctz":1,"tipoCodAut":"E","codAut":12345678901234}'


def code(body, url="https://www.arca.gob.ar/fe/qr/?p="):
    data = body if isinstance(body, bytes) else body.encode()
    return url + base64.urlsafe_b64encode(data).decode().rstrip("=")


@pytest.mark.parametrize(
    "value, valid",
    [(code(GOOD), True), (code(GOOD.replace('"ver":1', '"ver":"1"')), True), (code(GOOD.replace("2024-02-03", "2024-02-30")), False),
     (code(GOOD.replace("12.5", '"1e3"')), False), (code(GOOD.replace("12.5", '"+.5"')), True), (code(GOOD.replace('"nroCmp":5', '"nroCmp":{"a":1}')), False), (code(GOOD.replace("}", ',"tipoDocRec":null}')), False),
     (code(GOOD.replace("}", ',"tipoDocRec":80,"nroDocRec":"1"}')), True), (code(GOOD.replace("}", ',"ver":1}')), False), (code("[1]"), False), (code(b"\xff" + GOOD.encode()), False), (code(""), False), (code("x" * 9000), False),
     (code(GOOD) + "&p=1", False), (code(GOOD) + "&", True), (code(GOOD) + "#f", False), (code(GOOD, "HTTPS://AFIP.gob.ar:443/FE/qr/?%70="), True), (code(GOOD, "https://afip.gob.ar/fe/qr?p="), False), ("no url", False), (None, False)],
)
def test_qr_codes(spark, value, valid):
    r = qr.qr_evidence(spark.createDataFrame([(value,)], "qr_text string")).first()
    assert (r.qr_valid, r.qr_type, r.qr_detected) == (valid, 6 if valid else None, value is not None)


@pytest.mark.parametrize("value, want", [(None, "—"), (0, "0 bytes"), (1023, "1023 bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1100000, "1.05 MB"), (128 + 1024, "1.13 KB"), (10 << 20, "10 MB")])
def test_format_size(spark, value, want):
    assert one(spark, value, display.format_size, "long") == want


def test_blank_to_null(spark):
    assert [one(spark, v, display.blank_to_null) for v in (None, "", " \t", " a ")] == [None, None, None, " a "]
    assert one(spark, " ", lambda c: display.blank_to_null(c, trim=False)) == " "


@pytest.mark.parametrize("value, want", [("a/b\\c:d.PDF", ("d.PDF", ".PDF", "d")), ("x.", ("x.", "", "x")), (".env", (".env", ".env", "")), ("", ("", "", "")), ("a.b/c", ("c", "", "c"))])
def test_names(spark, value, want):
    assert tuple(one(spark, value, f) for f in (files.base_name, files.file_ext, files.file_stem)) == want


def test_safe_names(spark):
    assert one(spark, " ..con. ", files.safe_segment) == "_con" and one(spark, None, files.safe_segment) == "" and one(spark, 'a<b>"|', files.safe_segment) == "a_b___"
    assert one(spark, "NUL.txt", lambda c: files.safe_segment_fallback(c, "x")) == "x" and one(spark, "ok", lambda c: files.safe_segment_fallback(c, "x")) == "ok"
    assert [one(spark, v, files.safe_extension) for v in (".PdF", "", None, "." + "x" * 20, ".a|b")] == [".pdf", "", "", "", ""]
    assert [one(spark, v, files.safe_extension_strict) for v in (".Pd-F", ".123456789012345678", None)] == [".PdF", "", ""]
    name = spark.createDataFrame([("dir/Some file.PDF", "id")], "n string, i string").select(files.safe_file_name(F.col("n"), F.col("i"))).first()[0]
    assert name.startswith("Some file_") and name.endswith(".PDF") and len(name) == len("Some file_.PDF") + 12


@pytest.mark.parametrize("data, want", [(b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"PK\x03\x05", None), (b"Rar!\x1a\x07\x00", "rar"), (b"Rar!\x1a\x07\x01\x00", "rar"), (b"Rar!\x1a\x07\x01\x01", None), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"", None), (None, None)])
def test_container_magic(spark, data, want):
    assert one(spark, data, files.container_magic, "binary") == want


def test_redact(spark):
    assert one(spark, " see HTTPS://x.y/z?q\nToken: abc; access_token=q,r ", text.redact) == "see [URL omitida] Token=[REDACTADO]; access_token=[REDACTADO],r"
    assert one(spark, "x" * 600, text.redact) == "x" * 500 + "..." and one(spark, None, text.redact) == ""


def test_base64url_strict(spark):
    assert [one(spark, v, text.base64url_strict) for v in ("_-8", "YQ", "YWI=", "a", " ", "!!!!", None)] == [b"\xff\xef", b"a", None, None, None, None, None] or one(spark, "YWI", text.base64url_strict) == b"ab"


def zip_bytes(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_expand_zip(spark):
    rows = [("a.zip", zip_bytes([("x.txt", b"one"), ("d/", b""), ("d/y.pdf", b"22")])), ("b.zip", b"not a zip"), ("c.zip", zip_bytes([("big", b"0" * 50), ("after", b"1")])), ("e.zip", None)]
    got = containers.expand_zip(spark.createDataFrame(rows, "name string, content binary"), limits=containers.Limits(entry_bytes=40)).orderBy("name", "ordinal").collect()
    assert [(r.name, r.entry_key, r.content and bytes(r.content), (r.failure or "").split(":")[0]) for r in got] == [
        ("a.zip", "x.txt", b"one", ""), ("a.zip", "d/", None, ""), ("a.zip", "d/y.pdf", b"22", ""), ("b.zip", None, None, "unreadable"), ("c.zip", "big", None, "entry_bytes"), ("e.zip", None, None, "unreadable"),
    ]


ENTRY = "root_id long, container_id long, ordinal int, entry_key string, entry_bytes long, is_directory boolean, is_encrypted boolean, link_target string, child_id long, root_name string"


def nested(spark, rows, **limits):
    full = [(1, c, o, k, n, False, False, None, child, "r.zip") for c, o, k, n, child in rows]
    got = containers.apply_nested_policy(spark.createDataFrame(full, ENTRY), containers.Limits(**limits)).collect()
    return sorted((r.outcome, r.chain, r.failure) for r in got)


def test_nested_containers(spark):
    tree = [(1, 1, "a.pdf", 10, None), (1, 2, "in.zip", 20, 2), (2, 1, "b.pdf", 5, None), (2, 2, "../c", 5, None), (1, 3, "z.pdf", 10, None)]
    assert nested(spark, tree) == [("accepted", "r.zip!/a.pdf", None), ("accepted", "r.zip!/z.pdf", None), ("refused", "r.zip!/in.zip", "traversal")]
    deep = [(1, 1, "in.zip", 1, 2), (2, 1, "in2.zip", 1, 3), (3, 1, "x", 1, None)]
    assert nested(spark, deep) == [("refused", "r.zip!/in.zip!/in2.zip", "depth")]
    assert nested(spark, tree, entries=4) == [("refused", "r.zip", "entries")]  # what the failed inner one spent is not given back
    assert nested(spark, [(1, 1, "A.pdf", 1, None), (1, 2, "x/../a.PDF", 1, None)]) == [("refused", "r.zip", "collision")]
    assert nested(spark, [(1, 1, "a", 90, None), (1, 2, "b", 90, None)], total_bytes=100) == [("refused", "r.zip", "total_bytes")]
    assert nested(spark, [(1, 1, "a" * 1999, 1, None)]) == [("refused", "r.zip", "chain")]


def test_flat_policy_equals_the_fold(spark):
    keys = ["a/b.pdf", "./A/B.pdf", "a/../c", "..", "a/../../x", "\\x", "k:x", " ", "", "d/e", "a//b.pdf", "q.pdf"]
    rows = [(i, i, j + 1, k, 30 * (j + 1), j == 9, False, None, None, "r") for i in range(len(keys)) for j, k in enumerate(keys[i:] + keys[:i])]
    df = spark.createDataFrame(rows, ENTRY)
    limits = containers.Limits(entries=6, entry_bytes=200, total_bytes=500, chain=len("r!/a/../c"))
    refused = {r.root_id: r.failure for r in containers.apply_container_policy(df, limits)[1].collect()}
    fold = {r.root_id: r.failure for r in containers.apply_nested_policy(df, limits).where("outcome = 'refused'").collect()}
    assert refused == fold and len(set(fold.values())) >= 3 and "chain" in fold.values()


def test_a_chain_too_long(spark):
    rows = [(1, 1, 1, "a" * 2500, 1, False, False, None, None, "r"), (2, 2, 1, "a" * 1997, 1, False, False, None, None, "r"), (3, 3, 1, "a" * 1998, 1, False, False, None, None, "r")]
    accepted, refused = containers.apply_container_policy(spark.createDataFrame(rows, ENTRY))
    assert sorted((r.root_id, r.failure) for r in refused.collect()) == [(1, "chain"), (3, "chain")] and [r.root_id for r in accepted.collect()] == [2]
    assert sorted(r.root_id for r in containers.apply_nested_policy(spark.createDataFrame(rows, ENTRY)).where("outcome = 'refused'").collect()) == [1, 3]


def test_keys_with_nulls_and_separators(spark):
    rows = [(1, "m", None, "h"), (2, "m", None, "h"), (3, "m", "p", "h"), (4, None, None, None)]
    batch = spark.createDataFrame(rows, "id long, message string, part_id string, origin_hash string")
    new, _ = ledger.insert_if_absent(batch.limit(0), batch)
    assert sorted(r.id for r in new.collect()) == [1, 3, 4]
    again, existing = ledger.insert_if_absent(new, batch)
    assert again.collect() == [] and existing.count() == 4
    assert all(r.present for r in ledger.exists_flag(new, batch, ledger.LEDGER_KEY).collect())
    keys = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("1:a", ""), ("", "1:a")], "x string, y string")
    got = ledger.ensure_keys(keys.limit(1), keys, ["x", "y"]).collect()
    assert len({r.key_id for r in got}) == 6 and [r.x for r in got if not r.created] == ["a|b"]


def test_reasons_of_failed_ocr(spark):
    text = "FACTURA B CUIT CAE IVA TOTAL some more words to read"
    rows = [(1, False, "", "motor", False, "", False, 1, None), (2, False, "", None, False, "", False, 1, None), (3, True, text, None, False, "", True, 1, "too large"), (4, True, "", None, False, "", False, 0, None), (5, True, text, None, False, "", False, 1, None),
        (6, True, "nothing here that tells what this text might be", None, True, text, False, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, success boolean, text string, failure string, header_success boolean, header_text string, over_limit boolean, n_images long, image_failure string")
    two = {r.doc_id: (r.classification, r.method, r.reason) for r in classify.classify_ocr_two_pass(docs).collect()}
    assert two[1] == ("REVISAR", "OCR_ERROR", "motor") and two[2] == ("REVISAR", "OCR_ERROR", "El OCR no pudo procesar el documento.")
    assert two[5][:2] == two[6][:2] == ("FACTURA", "OCR")
    routed = {r.doc_id: (r.method, r.reason) for r in classify.route_textless(docs).collect()}
    assert routed[3] == ("OCR_LIMITE", "too large") and routed[4] == ("OCR_NO_DISPONIBLE", "No hay una imagen procesable para OCR.") and routed[1] == ("OCR_ERROR", "motor")


def test_the_plan_of_two_passes_is_small(spark):
    """Each text is normalised once, and nothing is filtered by a decision."""
    docs = spark.createDataFrame([], "doc_id long, success boolean, text string, header_success boolean, header_text string, over_limit boolean, n_images long")
    for made in (classify.classify_ocr_two_pass(docs), classify.route_textless(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("translate(") <= 12 and "Exchange" not in plan


def test_page_text(spark):
    pages = [(1, 2, b"<48 656C6C 6F2> Tj"), (1, 1, rb"(a\(b\)\\ \101\7 caf\351) (\n) <80>"), (2, 1, None), (3, 1, "(" .encode() + b"x" * 40 + b")")]
    got = {r.doc_id: (r.text, r.useful) for r in ocr.assemble_page_text(spark.createDataFrame(pages, "doc_id long, page int, content binary")).collect()}
    assert got[1] == ("a(b)\\ A7 café \n € Hello  ", False)
    assert got[2] == ("", False) and got[3] == ("x" * 40 + " ", True)


def raw_messages(spark):
    tree = """{"partId":"","filename":"","parts":[{"partId":"0","filename":"a.pdf","mimeType":"application/pdf","body":{"attachmentId":"X","size":3}},
      {"filename":"","parts":[{"filename":"b.zip","body":{"data":"YQ"}},{"filename":"c.txt","body":{}},{"filename":" ","body":{"data":"YQ"}}]}]}"""
    rows = [("m1", tree), ("m2", '{"filename":"root.pdf","body":{"data":"YQ"}}'), ("m3", "{}"), ("m4", None)]
    return spark.createDataFrame(rows, "id string, p string").select("id", F.try_parse_json("p").alias("payload"))


def test_flatten_parts(spark):
    want = [("m1", "0", "a.pdf", "X", None, 3), ("m1", "0.1.0", "b.zip", None, "YQ", None), ("m2", "0", "root.pdf", None, "YQ", None)]
    for f in (mime.flatten_parts, mime.flatten_parts_recursive):
        got = f(raw_messages(spark)).orderBy("message_id", "part_id").collect()
        assert [(r.message_id, r.part_id, r.file_name, r.attachment_id, r.inline_data, r.declared_size) for r in got] == want
    with pytest.raises(mime.TooDeep):  # nothing is dropped without a word
        mime.flatten_parts(raw_messages(spark), max_depth=1)


@pytest.mark.parametrize("depth", [3, 4, 21, 60])
def test_parts_at_any_depth(spark, depth):
    leaf = '{"filename":"a.pdf","body":{"attachmentId":"X"}}'
    tree = '{"filename":"","parts":[' * depth + leaf + "]}" * depth
    raw = spark.createDataFrame([("m", tree)], "id string, p string").select("id", F.try_parse_json("p").alias("payload"))
    assert [(r.part_id, r.file_name) for r in mime.flatten_parts(raw).collect()] == [("0" + ".0" * depth, "a.pdf")]


def test_map_messages_and_part_bytes(spark):
    raw = spark.createDataFrame([("m1", "t", 1700000000123, "s", [("FROM", "x@y"), ("from", "z")]), ("m2", "t", 0, None, []), ("m3", "t", None, None, [("From", " ")])], "id string, thread_id string, internal_date long, snippet string, headers array<struct<name:string,value:string>>")
    got = {r.message_id: (str(r.received), r.sender, r.subject) for r in mime.map_messages(raw, F.lit("2024-01-01 00:00:00")).collect()}
    assert got == {"m1": ("2023-11-14 22:13:20.123000", "x@y", None), "m2": ("2024-01-01 00:00:00", mime.NO_SENDER, None), "m3": ("2024-01-01 00:00:00", mime.NO_SENDER, None)}
    parts = spark.createDataFrame([("m", "1", "A", "in"), ("m", "2", None, "in"), ("m", "3", "gone", "in")], "message_id string, part_id string, attachment_id string, inline_data string")
    payloads = spark.createDataFrame([("m", "A", "far")], "message_id string, attachment_id string, data string")
    assert {r.part_id: r.data for r in batches.part_bytes(parts, payloads).collect()} == {"1": "far", "2": "in", "3": None}


def test_batch_modes(spark):
    messages = spark.createDataFrame([("m1", "2024-01-20"), ("m2", "2023-01-01"), (" ", "2024-01-20")], "message_id string, d string").select("message_id", F.col("d").cast("timestamp_ntz").alias("received"))
    history = spark.createDataFrame([(9, "messageAdded", "m7"), (10, "messageAdded", "m8"), (100, "other", "m9")], "history_id long, record_type string, message_id string")
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    mode = lambda cursor: [tuple(r) for r in batches.select_batch(messages, history, cursor, as_of).collect()]
    assert mode(None) == [("m1", "initial")] and mode(9) == [("m8", "incremental")] and mode(3) == [("m1", "fallback")]
    assert batches.incremental_batch(history, 9)[1].first()["cursor"] == 100


def test_inserts_run_twice_change_nothing(spark):
    source = spark.createDataFrame([(1, 5, "p", "h"), (2, 5, "p", "h"), (3, 6, "p", "h")], "id long, message long, part_id string, origin_hash string")
    new, existing = ledger.insert_if_absent(source.limit(0), source)
    assert sorted(r.id for r in new.collect()) == [1, 3] and existing.count() == 0
    again, existing = ledger.insert_if_absent(new, source)
    assert again.count() == 0 and existing.count() == 3


def test_upsert_keeps_or_takes_nulls(spark):
    old = spark.createDataFrame([(1, "a", "x", True), (2, "b", "y", False)], "id long, v string, w string, on boolean")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "id long, v string, w string")
    got = ledger.upsert(old, new, ["id"], update=["v"], coalesce=["w"], set_to={"on": F.lit(True)}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", True), (2, None, "y", True), (3, "c", "z", True)]


def test_paths_and_writes(spark, tmp_path):
    rows = [("FACTURA", "Some.PDF", "a" * 64, "m:1", "2024-03-05 01:02:03"), ("REVISAR", ".x", "b" * 64, "m2", "2024-03-05 01:02:03")]
    df = spark.createDataFrame(rows, "classification string, name string, origin_hash string, message_id string, r string").withColumn("received", F.col("r").cast("timestamp_ntz"))
    paths = ledger.document_paths(df)
    assert sorted(r.path for r in paths.collect()) == ["invoices/2024/03/05/m_1/Some_aaaaaaaaaaaa.pdf", "review/2024/03/05/m2/documento_bbbbbbbbbbbb.x"]
    for _ in range(2):
        ledger.write_documents(paths, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store").count() == 2


def test_lookup_and_options(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert [reports.lookup(df, "id", v).count() for v in ("2", " 1 ", 0, -1, "x", "1.5")] == [1, 1, 0, 0, 0, 0]
    assert quality.ensure_columns(df, "id long, w int").columns == ["id", "v", "w"]


def test_ocr_two_pass(spark):
    words = " palabra otra mas texto largo de relleno para que alcance"
    rows = [(1, True, "FACTURA A CUIT CAE IVA" + words, True, ""), (2, True, "CUIT CAE" + words, True, "FACTURA B IVA"), (3, True, "CUIT CAE" + words, False, "FACTURA B IVA"), (4, False, "", True, "x"), (5, True, "corto", True, "")]
    df = spark.createDataFrame(rows, "doc_id long, success boolean, text string, header_success boolean, header_text string")
    got = {r.doc_id: (r.classification, r.method, r.confidence) for r in classify.classify_ocr_two_pass(df).collect()}
    assert got == {1: ("FACTURA", "OCR", 82), 2: ("FACTURA", "OCR", 82), 3: ("REVISAR", "OCR", None), 4: ("REVISAR", "OCR_ERROR", None), 5: ("REVISAR", "OCR_NO_CONCLUYENTE", None)}


STREAM = "id long, message long, part_id string, origin_hash string, size long"


def land(spark, root, rows):
    spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(f"{root}/landed")


def start(spark, root, **how):
    q = intake_stream.start_intake(spark, f"{root}/landed", STREAM, f"{root}/ck", f"{root}/ledger", f"{root}/dead", ["message", "part_id", "origin_hash"], "size >= 0", **how)
    q.awaitTermination()


def test_stream_holds_its_cursor_and_replays(spark, tmp_path):
    root = f"file://{tmp_path}"
    land(spark, root, [(1, 1, "p", "h", 5), (2, 1, "p", "h", 5), (3, 2, "p", "h", 5)])
    start(spark, root)
    read = lambda: sorted(r.id for r in spark.read.parquet(f"{root}/ledger").collect())
    assert read() == [1, 3]
    start(spark, root)
    assert read() == [1, 3]
    land(spark, root, [(4, 1, "p", "h", 5), (5, 3, "p", "h", 5), (6, 4, "p", "h", -1)])
    for _ in range(2):
        with pytest.raises(Exception, match="fail"):
            start(spark, root)
        assert read() == [1, 3, 5] and spark.read.parquet(f"{root}/dead").count() == 1
    start(spark, root, on_error="quarantine")
    assert read() == [1, 3, 5] and spark.read.parquet(f"{root}/dead").count() == 1
    land(spark, root, [(7, 5, "p", "h", 1)])
    start(spark, root)
    assert read() == [1, 3, 5, 7]


def test_registered_classification_keeps_pdfs_without_text(spark):
    invoice = "FACTURA A CUIT CAE IVA TOTAL FECHA DE EMISIÓN" + LONG
    tables = {
        "doc_text": spark.createDataFrame([(1, "a.pdf", invoice), (2, "b.pdf", "x"), (3, "c.pdf", None), (4, "d.pdf", "")], "doc_id long, file_name string, text string"),
        "qr_readings": spark.createDataFrame([], "doc_id long, page int, n_pages int, image int, qr_text string"),
        "ocr_pages": spark.createDataFrame([(2, "full", 1, 100, 100, invoice, 90.0), (4, "full", 1, 5000, 5000, invoice, 90.0)], "doc_id long, pass string, page int, width int, height int, text string, confidence double"),
    }
    got = {r.doc_id: (r.classification, r.method) for r in documents.classify_documents(tables.get).collect()}
    assert got == {1: ("FACTURA", "PDF_TEXTO"), 2: ("FACTURA", "OCR"), 3: ("REVISAR", "OCR_NO_DISPONIBLE"), 4: ("REVISAR", "OCR_LIMITE")}


def test_registered_segment_reads_the_whole_text(spark):
    docs = spark.createDataFrame([(1, ". " * 150 + "kept" * 40, "a.pdf")], "doc_id long, text string, file_name string")
    assert documents.safe_values({"doc_text": docs}.get).first()["segment"] == "kept" * 30
