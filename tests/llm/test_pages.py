"""URL rules and archives."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from intake.llm import urlrules, warc
from intake.llm.common import new_folder
from intake.llm.queries import ORACLES, QUERIES

from .oracle import same_as_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_url_rules", "op7_merged_captures"])
def test_same_as_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLES[name])


URLS = [
    None, "", "no scheme", "://", "http://NET/", "http://net", "http://a.NET/x?y#z", "http://example.net/en/1", "http://x.example.net/en", "https://example.com/de/a b",
    "https://example.com/dex", "https://EXAMPLE.org/fr/q?sessionid=4", "http://o.org/en/print/1", "http://blog.x.org/en/", "https://ads2.x.org/a", "x://y.org/tag/12/page/3", "x://y.org/TAG/12/page/3",
    "http://www.example.org/print/", "http://h.org/robots.txt", "http://h.org/robots.txt\n", "a://b://c.org/fr/x", "http://h.org?u=http://net/", "http://é.org/fr/ü", "http://h.org/991", "http://h.org/9912", "http://u@h.org:80/login",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, a) for a, h, p in urlrules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = {a for a, p in urlrules.PATTERN_RULES if url is not None and re.search(p, url, re.ASCII)}
    return host, path, None, "allow" if "allow" in hit or not hit else "block"


def test_url_rules_by_hand(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(1, "http://net/a", "x"), (1, "http://net/a", "x"), (None, "http://net/a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlrules.judge_urls(pages).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *plain_verdict(u))) for i, u, _ in rows)
    assert urlrules.judge_urls(pages.limit(0)).collect() == []


def test_literal_tokens():
    assert urlrules.literal_tokens(r"/print/") == ["print"]
    assert urlrules.literal_tokens(r"^http://blog\.") == ["http", "blog"]
    assert urlrules.literal_tokens(r"ads?\.x") == []
    assert urlrules.literal_tokens(r"foo|bar") == []
    assert urlrules.literal_tokens(r"\bcasino\b") == ["casino"]
    assert urlrules.literal_tokens(r"/a{2}b/c[de]f/g$") == ["g"]


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://www.example.org/x",), ("http://www.other.org/",), ("http://www.example.net/",)], "url string")
    filed = {r.pattern: r.token for r in urlrules.file_rules(pages, urlrules.PATTERN_RULES).collect()}
    assert filed[r"://www\.example\.org/"] in ("example", "org") and filed[r"/99\d(?:[/?#]|$)"] == ""


def test_filings_by_branch():
    of = lambda p: {(tuple(t), text) for _, t, text in urlrules.filings(p)}
    assert of(r"/(?:ads?|banners?)/") == {(("ad",), "/ad/"), (("ads",), "/ads/"), (("banner",), "/banner/"), (("banners",), "/banners/")}
    assert of(r"[?&](?:sessionid|sid)=") == {(("sessionid",), "sessionid="), (("sid",), "sid=")}
    assert of(r"a(?:b|c(d|e)?)f|^/x/$") == {((), "abf"), ((), "acf"), ((), "acdf"), ((), "acef"), (("x",), "/x/")}
    assert of(r"://ads?\d*\.") == {((), "://ad"), ((), "://ads")}
    assert of(r"(?i)/Foo/") == {(("Foo",), "")}
    assert of(r"\Q/a?/\E") == of(r"(?x) /a b/") == of(r"/\x41/") == {((), "")}
    assert of(r"(a|b)*c/d/") == {(("d",), "c/d/")}
    assert len(urlrules.branches("(a|b)" * 20)) <= 64


@pytest.mark.parametrize("seed", range(3))
def test_branches_lose_no_match(seed):
    """Wherever a pattern fits, one of its filings has its text and its tokens there."""
    rng = random.Random(seed)

    def pattern(depth):
        atoms = [rng.choice(["a", "b", "ab", "/", r"\.", "[/?]", "[ab]", r"\b", "."]) for _ in range(rng.randint(1, 4))]
        if depth:
            atoms.insert(rng.randint(0, len(atoms)), f"({rng.choice(['', '?:'])}{pattern(depth - 1)}|{pattern(depth - 1)}){rng.choice(['', '', '?', '*', '{2}'])}")
        return "".join(a + rng.choice(["", "", "", "?", "+"]) if a in ("a", "b", "/") else a for a in atoms)

    texts = ["".join(rng.choices("ab/.?", k=rng.randint(0, 9))) for _ in range(400)]
    met = 0
    for _ in range(150):
        p = pattern(rng.randint(0, 2))
        filed = urlrules.filings(p)
        for t in texts:
            if re.search(p, t, re.ASCII):
                met += 1
                tokens = set(re.findall(urlrules.TOKEN, t))
                assert any(text in t and tokens >= set(own) for _, own, text in filed), (p, t)
    assert met > 1000


def test_only_rules_without_a_token_meet_every_url(spark):
    pages = spark.createDataFrame([("http://www.example.org/x",)], "url string")
    filed = urlrules.file_rules(pages, urlrules.PATTERN_RULES).collect()
    assert {r.pattern for r in filed if r.token == ""} == {r"://ads?\d*\.", r"/99\d(?:[/?#]|$)"}
    assert all(r.literal for r in filed)  # and these only where their text is


def test_tokens_are_lowered_as_ascii(spark):
    """Lower-casing a dotted capital I would lengthen the token before it."""
    pages = spark.createDataFrame([(1, "x://y.fr/CASINO"), (2, "x://y.fr/casino\u0130"), (3, "x://y.fr/casino")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge_urls(pages, patterns=[("block", r"/casino\x{130}?$"), ("block", r"(?i)/casino$")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    runs = [sorted(hashlib.md5(b"%d %d" % (r, i)).digest()[:1] for i in range(r * 3 % 11)) for r in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def page_rows():
    long = "é" * 600
    rows = [(i, f"http://h{i % 3}.org/p{i % 4}?q", long if i % 2 else f"{i}" * 700, "x") for i in range(20)]
    rows += [(30, None, None, "x"), (31, "http://a b\r\nc/", "small", "x"), (32, "", "small", "x"), (33, "u", "", "x"), (34, "u", "x" * 999, "x"), (35, "u", "x" * 999, "x"), (36, "u", "x" * 1000, "x"), (37, "u", "x" * 1000, "x")]
    return rows + [(19, "again", long, "x"), (5, "http://h2.org/p1?q", long, "x"), (None, "n", long, "x"), (None, "n", "z" * 2000, "x")]


def expected_pages(rows):
    best = {}
    for p, _, html, _ in rows:
        best[html or ""] = max(best.get(html or "") or -1, p if p is not None else -1)
    out = []
    for p, _, html, _ in rows:
        body = (html or "").encode()
        first = best[html or ""]
        again = len(body) >= 1000 and first >= 0 and p != first
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("how", [{}, {"fan_in": 2, "part_lines": 3}])
def test_archives_by_hand(spark, how):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest string").repartition(7)
    got = warc.round_trip(pages, **how).drop("url").collect()
    assert sorted(str(tuple(r)) for r in got) == expected_pages(page_rows())
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_index_is_in_order(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest string").repartition(7)
    root = new_folder(spark, "warc")
    runs = warc.write_archives(pages, root, archive_bytes=500)
    assert runs.count() > 7
    index = warc.merge_runs(runs, root, fan_in=3, part_lines=4)
    got = [(r.key, r.time, r.archive, r.offset) for r in warc.read_captures(index, root).orderBy("part", "position").collect()]
    assert len(got) == len(page_rows()) == len(set(got))
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)
    assert index.count() > 2


@pytest.mark.parametrize("fan_in, most", [(16, 5), (300, 1.1)])
def test_merges_do_not_open_every_run_for_every_range(spark, monkeypatch, fan_in, most):
    count, each, opened = 300, 10, []
    root = new_folder(spark, "runs")
    folder = Path(root.removeprefix("file://"))
    folder.mkdir(parents=True)
    rng, rows, lines = random.Random(7), [], []
    for r in range(count):
        own = sorted(b"%08d %02d a %d 1 1" % (rng.randrange(10**8), rng.randrange(100), i) for i in range(each))
        (folder / f"run-{r}").write_bytes(b"".join(x + b"\n" for x in own))
        rows.append((f"run-{r}", each, own))
        lines += own
    plain = warc._merge

    def counted(jobs, *more):
        opened.append(jobs.select(F.sum(F.size("members"))).first()[0])
        return plain(jobs, *more)

    monkeypatch.setattr(warc, "_merge", counted)
    runs = spark.createDataFrame(rows, "run string, n long, lines array<binary>")
    index = warc.merge_runs(runs, root, fan_in=fan_in, part_lines=each).orderBy("part").collect()
    assert len(index) > 250 and [r.part for r in index] == list(range(len(index)))  # a file for each range
    assert [x for r in index for x in (folder / r.run).read_bytes().splitlines()] == sorted(lines)
    assert max(opened) <= 2 * fan_in * len(index)
    assert fan_in == count or sum(opened) < count * len(index) / most


@pytest.mark.parametrize("groups, parts", [(1, 1), (1, 300), (19, 300), (6000, 1 << 16), (10**6, 7)])
def test_rounds_are_nested(groups, parts):
    step = warc._step(groups, parts)
    assert step & (step - 1) == 0 and (groups * -(-parts // step) <= 2 * parts or step >= parts)
    assert warc._step(-(-groups // 256), parts) <= step and warc._step(1, parts) == 1


def test_damage_is_found():
    record = warc._gzip(warc._record("response", 4, "http://x/", "20240101000000", hashlib.sha1(b"abc").hexdigest(), b"abc", None))
    assert warc.parse(record)["page_id"] == 4
    with pytest.raises(ValueError):
        warc.parse(warc._gzip(warc._record("response", 4, "http://x/", "20240101000000", hashlib.sha1(b"abd").hexdigest(), b"abc", None)))
    with pytest.raises(ValueError):
        warc.parse(record[:-9])
