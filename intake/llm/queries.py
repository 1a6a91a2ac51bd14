"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .collocations import collocations
from .editcount import apply_edits, build_trees
from .langid import identify
from .packing import pack
from .quality import judge
from .records import round_trip
from .simhash import near_duplicates
from .suffixes import report
from .tiling import contaminations
from .toxicity import score_toxicity
from .urlrules import HOST_RULES, PATTERN_RULES, judge_urls
from .warc import round_trip as warc_round_trip
from .whitening import whiten


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(read_table(spark, sf_dir, "documents")).select(*columns)


_SPACE = "\\x20\\x09-\\x0D"
_COUNT = {  # characters of each class, by what is left without them
    "k0": "[a-z]", "k1": "[A-Z]", "k2": "[0-9]", "k3": "[\\x20\\x09\\x0B-\\x0D]", "k4": "\\n", "k5": "[.,;:!?''\"()\\-]",
    "k6": "[\\x21-\\x7E]", "k7": "[\\x00-\\x08\\x0E-\\x1F\\x7F]", "k8": "[^\\x00-\\x7F]",
}
_CLASSES = ", ".join(f"length(x) - length(regexp_replace(x, '{p}', '', 'g'))" + (" - k0 - k1 - k2 - k5" if k == "k6" else "") + f" AS {k}" for k, p in _COUNT.items())
_TERM = "(CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) / 2 ELSE 0 END + CASE WHEN {1} > 0 THEN {1} * log2(2 * {1} / ({0} + {1})) / 2 ELSE 0 END)"
OP2_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents),
    e AS (SELECT *, regexp_extract_all(x, '[^{_SPACE}]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines FROM d),
    g AS (SELECT doc_id, i, CASE WHEN i + 4 <= len(w) THEN list_aggregate(w[i:i + 4], 'string_agg', ' ') END AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM e)),
    h AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
    r AS (SELECT doc_id, count(*) FILTER (c) AS n FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM h) GROUP BY doc_id),
    b AS (SELECT e.doc_id, lang, x, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS word_chars,
        length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM e LEFT JOIN r ON r.doc_id = e.doc_id),
    l AS (SELECT doc_id, lang, unnest(w) AS word0 FROM b WHERE n_words >= 50),
    dw AS (SELECT doc_id, lang, translate(word0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS n FROM l GROUP BY ALL),
    cw AS (SELECT lang AS ref, word, sum(n) AS n FROM dw WHERE lang <> '' GROUP BY ALL UNION ALL SELECT '', word, sum(n) FROM dw GROUP BY ALL),
    t AS (SELECT ref, sum(n) AS total FROM cw GROUP BY ref HAVING sum(n) >= 2000),
    q AS (SELECT cw.ref, word, n / total AS share FROM cw JOIN t ON t.ref = cw.ref WHERE n >= total * 0.001),
    qo AS (SELECT t.ref, 1 - coalesce(sum(share), 0) AS share FROM t LEFT JOIN q ON q.ref = t.ref GROUP BY t.ref),
    dc AS (SELECT doc_id, lang, {_CLASSES} FROM b WHERE n_words >= 50),
    uc AS (UNPIVOT dc ON k0, k1, k2, k3, k4, k5, k6, k7, k8 INTO NAME kind VALUE n),
    rc AS (SELECT ref, kind, n / sum(n) OVER (PARTITION BY ref) AS share FROM (SELECT lang AS ref, kind, sum(n) AS n FROM uc WHERE lang <> '' GROUP BY ALL UNION ALL SELECT '', kind, sum(n) FROM uc GROUP BY ALL)),
    pairs AS (SELECT doc_id, b.lang, t.ref, n_words FROM b JOIN t ON true WHERE n_words >= 50),
    pw AS (SELECT pairs.doc_id, pairs.ref, q.share AS q, coalesce(dw.n, 0) / n_words AS p FROM pairs JOIN q ON q.ref = pairs.ref LEFT JOIN dw ON dw.doc_id = pairs.doc_id AND dw.word = q.word),
    po AS (SELECT * FROM pw UNION ALL SELECT pairs.doc_id, pairs.ref, qo.share, 1 - coalesce((SELECT sum(p) FROM pw WHERE pw.doc_id = pairs.doc_id AND pw.ref = pairs.ref), 0) FROM pairs JOIN qo ON qo.ref = pairs.ref),
    wd AS (SELECT doc_id, ref, sqrt(greatest(sum({_TERM.format("greatest(p, 0)", "q")}), 0)) AS far FROM po GROUP BY doc_id, ref),
    pc AS (SELECT pairs.doc_id, pairs.ref, n / sum(n) OVER (PARTITION BY pairs.doc_id, pairs.ref) AS p, rc.share AS q FROM pairs JOIN uc ON uc.doc_id = pairs.doc_id JOIN rc ON rc.ref = pairs.ref AND rc.kind = uc.kind),
    cd AS (SELECT doc_id, ref, sqrt(greatest(sum({_TERM.format("p", "q")}), 0)) AS far FROM pc GROUP BY doc_id, ref),
    own AS (SELECT pairs.doc_id, wd.far AS word_far, cd.far AS class_far, pairs.ref = CASE WHEN pairs.lang IN (SELECT ref FROM t) THEN pairs.lang ELSE '' END AS mine
        FROM pairs JOIN wd ON wd.doc_id = pairs.doc_id AND wd.ref = pairs.ref JOIN cd ON cd.doc_id = pairs.doc_id AND cd.ref = pairs.ref),
    v AS (SELECT doc_id, max(word_far) FILTER (mine) AS m, max(class_far) FILTER (mine) AS mc, min(word_far) AS o, arg_min(class_far, word_far) AS oc FROM own GROUP BY doc_id)
    SELECT b.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(CASE WHEN m > 0.5 THEN o ELSE m END, 0) <= 0.5 AND coalesce(CASE WHEN m > 0.5 THEN oc ELSE mc END, 0) <= 0.3 AS kept
    FROM b LEFT JOIN v ON v.doc_id = b.doc_id"""


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def document_edits(docs: DataFrame) -> DataFrame:
    """Three edits for each document: a replacement at a quarter of its length, a deletion at the half, an insertion at three quarters."""
    n = F.length("text")
    at = lambda i: F.floor(n * i / 4).cast("long")
    edit = lambda position, gone, new: F.struct(position.alias("position"), F.lit(gone).cast("long").alias("n_deleted"), new.alias("inserted"))
    edits = F.array(
        edit(at(1), 7, F.substring("text", 1, 11)),
        edit(at(2), 5, F.lit("")),
        edit(at(3), 0, F.concat(F.lit(" edited by "), F.coalesce("source", F.lit("nobody")))),
    )
    return docs.where(n > 0).select("doc_id", F.inline(edits))


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    edited = apply_edits(build_trees(docs), document_edits(docs))
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", F.size("starts").cast("long").alias("n_leaves"), F.octet_length("text").cast("long").alias("n_bytes"), "n_bytes_encoded")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op6_sql() -> str:
    hosts = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in HOST_RULES)
    fits = lambda action: " OR ".join(f"regexp_matches(url, '{p}')" for a, p in PATTERN_RULES if a == action)
    return f"""
    WITH rules(action, h, p) AS (VALUES {hosts}),
    a AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
        FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT b.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
        CASE WHEN action IS NOT NULL THEN action WHEN {fits("allow")} THEN 'allow' WHEN {fits("block")} THEN 'block' ELSE 'allow' END AS verdict
    FROM b LEFT JOIN best ON b.page_id = best.page_id"""


def op7_merged_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages")).drop("url")


OP7_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS digest FROM p),
    w AS (SELECT page_id, size, digest, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) ELSE page_id END AS best FROM d)
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
        CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM w"""


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


OP8_SQL = """
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    c AS (SELECT doc_id, k, substr(x, CAST(2000 * k + 1 AS INT), 2198) AS y FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2 + 999) // 1000)) AS k FROM d)),
    s AS (SELECT doc_id, 1000 * k AS base, y, unnest(range(0, greatest(least(1000, length(y) // 2 - 99), 0))) AS i FROM c),
    g AS (SELECT doc_id, base + i AS p, row_number() OVER (PARTITION BY sha256(substr(y, CAST(2 * i + 1 AS INT), 200)) ORDER BY doc_id, base + i) AS place FROM s),
    r AS (SELECT doc_id, p, p + 100 AS e, lag(p + 100) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g WHERE place > 1),
    j AS (SELECT doc_id, p, e, sum(CASE WHEN before IS NULL OR before < p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
    m AS (SELECT doc_id, k, min(p) AS a, max(e) AS b FROM j GROUP BY doc_id, k),
    o AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM m),
    t AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(x, CAST(2 * kept_from + 1 AS INT), CAST(2 * (a - kept_from) AS INT)), '' ORDER BY a)
          || max(CASE WHEN last = 1 THEN substr(x, CAST(2 * b + 1 AS INT)) ELSE '' END) AS kept
        FROM d JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id)
    SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM i, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
    n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
    f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    s AS (SELECT lang, f, g[b:b + j - 1] AS g FROM (SELECT *, unnest(range(1, k - j + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS j FROM f WHERE k > 2))),
    m AS (SELECT lang, g, max(f) AS longer FROM s GROUP BY ALL),
    c AS (SELECT f.lang, f.g, f.k, f.f AS a, n.n, unnest(range(1, f.k)) AS cut FROM f JOIN n ON n.lang = f.lang LEFT JOIN m ON m.lang = f.lang AND m.g = f.g WHERE f.k > 1 AND NOT coalesce(100 * longer >= 100 * f.f, false)),
    x AS (SELECT c.lang, c.g, a, n, cut, fl.f AS l, fr.f AS r, (1000 * a::HUGEINT * n::HUGEINT) // (fl.f::HUGEINT * fr.f::HUGEINT) AS score
        FROM c JOIN f fl ON fl.lang = c.lang AND fl.g = c.g[1:cut] JOIN f fr ON fr.lang = c.lang AND fr.g = c.g[cut + 1:]),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS place FROM x),
    o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE place = 1)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000"""


def op13_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_pivots,
        op2_divergence_rules,
        op3_string_tiling,
        op4_binary_records,
        op5_edit_counts,
        op6_url_rules,
        op7_merged_captures,
        op8_prefix_doubling,
        op9_ftrl_toxicity,
        op10_shortest_pack_first,
        op11_embedding_whitening,
        op12_trie_collocations,
        op13_nearest_centroid,
    )
}

ORACLES: dict[str, str] = {
    "op2_divergence_rules": OP2_SQL,
    "op6_url_rules": op6_sql(),
    "op7_merged_captures": OP7_SQL,
    "op8_prefix_doubling": OP8_SQL,
    "op12_trie_collocations": OP12_SQL,
}
