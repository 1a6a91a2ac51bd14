"""URL filters: host rules by longest match, then pattern rules found through their rarest literal token.

A host rule (action, host, path) fits a host and its subdomains where the URL's path starts with the rule's; the longest rule wins.
It is met through the suffixes of the host, so a URL touches only rules on its own hosts.

A pattern rule (action, pattern) is a regular expression on the whole URL. It is opened into branches, one for each alternative and with or
without each optional part; every match is one of a branch. A branch's literal tokens are runs of letters and digits that its matches must
hold as whole tokens. Tokens are counted over all URLs, each branch is filed under its rarest one, a URL's distinct tokens fetch the branches
filed under them, and of those only rules run whose longest literal text is in the URL. Branches without a literal token are filed under
the empty token, which every URL holds, and have that test only. An allow pattern outweighs a block pattern. URLs that no rule fits get `default`.

Edge cases: a null URL, or one without ://, has an empty host and path, fits no host rule and still meets pattern rules (null: none);
empty tables give empty results; rows that share a page_id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join

#: Rule tables of at most so many rows are broadcast; larger ones are joined with hot tokens and hosts dealt over several tasks.
MOST_BROADCAST = 200_000

#: (action, host, path)
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: (action, pattern): tracking and advertisement paths, session and sorting variants, printed copies, and what is always allowed.
PATTERN_RULES = (
    ("block", r"://ads?\d*\."),
    ("block", r"/(?:ads?|adserver|banners?)/"),
    ("block", r"[?&](?:sessionid|phpsessid|jsessionid)="),
    ("block", r"[?&]utm_source="),
    ("block", r"[?&]ref=x\b"),
    ("block", r"/print/"),
    ("block", r"^http://blog\."),
    ("block", r"/login\b"),
    ("block", r"\bcasino\b"),
    ("block", r"/tag/\d+/page/\d+"),
    ("block", r"/99\d(?:[/?#]|$)"),
    ("allow", r"://www\.example\.org/"),
    ("allow", r"/robots\.txt$"),
)
TOKEN = r"[A-Za-z0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def _lowered(text: Column) -> Column:
    """A-Z only: other letters may become several characters, or plain ones."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parts(pattern: str) -> list[str]:
    """A literal character each, "\0" for anything unknown, "\1" for a sure edge of a token."""
    parts: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "[":
            end = _class_end(pattern, i)
            parts.append("\1" if re.fullmatch(r"[^\\^\w\[&-]+|[?&]+", pattern[i + 1 : end], re.ASCII) else "\0")
            i = end
        elif c == "(":
            i = _group_end(pattern, i)
            parts.append("\0")
        elif c == "\\":
            i += 1
            e = pattern[i : i + 1]
            parts.append("\1" if e in ("b", "A", "Z") else "\0" if e.isalnum() else e)
        elif c in "^$":
            parts.append("\1")
        elif c == ".":
            parts.append("\0")
        elif c in "*+?{":
            if c == "{":
                i = pattern.index("}", i)
            parts[-1] = "\0"
        else:
            parts.append(c)
        i += 1
    return ["\0" if pattern[:1] != "^" else "", *parts, "\0" if not pattern.endswith("$") else ""] if parts else []


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that each match must hold whole: runs of letters and digits with a literal mark, or an end, on both sides.

    What stands in classes, groups or before a quantifier is left out, and so is a pattern with a bare alternative.
    """
    if len(_alternatives(pattern)) > 1:
        return []
    return re.findall(r"(?<![A-Za-z0-9\0])[A-Za-z0-9]+(?![A-Za-z0-9\0])", "".join(_parts(pattern)))


def literal_text(pattern: str) -> str:
    """The longest text that each match must hold; empty for a pattern with a bare alternative."""
    if len(_alternatives(pattern)) > 1:
        return ""
    return max(re.split("[\0\1]", "".join(_parts(pattern))), key=len)


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at each | outside of its groups and classes."""
    found, begin, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            found.append(pattern[begin:i])
            begin = i + 1
        i = _atom_end(pattern, i)
    return [*found, pattern[begin:]]


def _atom_end(pattern: str, i: int) -> int:
    c = pattern[i]
    return (_class_end(pattern, i) if c == "[" else _group_end(pattern, i) if c == "(" else i + (c == "\\")) + 1


def _opened(pattern: str) -> list[str]:
    """The pattern with its first alternation, plain group or optional part written out; itself alone if there is none."""
    if len(found := _alternatives(pattern)) > 1:
        return found
    i = 0
    while i < len(pattern):
        end = _atom_end(pattern, i)
        atom, after = pattern[i:end], pattern[end : end + 1]
        group = re.match(r"\((?:\?:|(?!\?))", atom)
        if after == "?" and (group or atom.isalnum()):
            rest = pattern[end + 1 :]
            rest = rest[1:] if rest[:1] in ("?", "+") else rest
            return [pattern[:i] + rest, pattern[:i] + atom + rest]
        if group and after not in ("*", "+", "{"):
            return [pattern[:i] + x + pattern[end:] for x in _alternatives(atom[group.end() : -1])]
        i = end
    return [pattern]


def branches(pattern: str, most: int = 64) -> list[str]:
    """Patterns without alternatives, one of which fits wherever `pattern` does. What would make more than `most` stays closed."""
    todo, done = [pattern], []
    while todo:
        opened = _opened(first := todo.pop())
        if opened == [first] or len(todo) + len(done) + len(opened) > most:
            done.append(first)
        else:
            todo += opened
    return sorted(set(done))


def filings(pattern: str) -> list[tuple[str, list[str], str]]:
    """Of each branch: itself, its literal tokens, and the text to look for. Nothing is known of patterns with quoted or coded characters, or with flags
    other than (?i), which leaves tokens alone."""
    flags = re.findall(r"\(\?([A-Za-z-]+)[):]", pattern)
    if re.search(r"\\[QxucpPkN0]", pattern) or any(f != "i" for f in flags):
        return [(pattern, [], "")]
    return [(b, literal_tokens(b), "" if flags else literal_text(b)) for b in branches(pattern)]


def _class_end(pattern: str, i: int) -> int:
    i += 2 if pattern[i + 1 : i + 2] in ("]", "^") else 1
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def _group_end(pattern: str, i: int) -> int:
    depth = 0
    while True:
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1


def _tokens(url: str) -> Column:
    return F.regexp_extract_all(_lowered(F.col(url)), F.lit(TOKEN), 0)


def file_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rule_no, branch, action, pattern, literal, token: each branch of a rule with the token of its own that is rarest in the URLs of `pages`."""
    spark = pages.sparkSession
    rows = [(i, b, a, p, text, t.lower()) for i, (a, p) in enumerate(rules) for b, tokens, text in filings(p) for t in tokens or [""]]
    named = spark.createDataFrame(rows, "rule_no int, branch string, action string, pattern string, literal string, token string")
    tokens = pages.select(F.explode(F.array_distinct(_tokens("url"))).alias("token"))
    wanted = tokens.join(named.select("token").distinct(), "token", "left_semi")  # counts of tokens that rules hold
    counts = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)), "token")
    return named.join(counts, "token", "left").groupBy("rule_no", "branch", "action", "pattern", "literal").agg(F.min_by("token", rank).alias("token"))


def _with_rules(each: DataFrame, rules: DataFrame, key: str, n: int) -> DataFrame:
    """`each` with the rules of its key: without a shuffle where the rules, `n` at most, can be broadcast, so only hits go on."""
    return each.join(F.broadcast(rules), key) if n <= MOST_BROADCAST else spread_join(each, rules, key)


def match_hosts(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """row, host_rule (length, rule, action) of the host rules that fit. pages: row, host, path."""
    spark = pages.sparkSession
    named = spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    each = pages.where("host <> ''").select("row", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    met = _with_rules(each, named, "rule_host", len(rules)).where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    return met.select("row", F.struct(F.length(rule).alias("length"), rule.alias("rule"), "action").alias("host_rule"))


def match_patterns(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """row, pattern_action of the patterns that fit. pages: row, url."""
    filed = file_rules(pages, rules)
    each = pages.select("row", "url", F.explode(F.array_distinct(F.array_append(_tokens("url"), F.lit("")))).alias("token"))
    hit = _with_rules(each, filed, "token", sum(len(filings(p)) for _, p in rules)).where(F.expr("contains(url, literal) AND url RLIKE pattern"))
    return hit.select("row", F.col("action").alias("pattern_action"))


def judge_urls(pages: DataFrame, hosts: Sequence[tuple[str, str, str]] = HOST_RULES, patterns: Sequence[tuple[str, str]] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of the host rule, else null), verdict."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    # a URL is judged once, however many pages share it
    counted = pages.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    distinct = counted.select("url", F.col("url").alias("row"), host.alias("host"), path.alias("path"))
    hits = match_hosts(distinct, hosts).unionByName(match_patterns(distinct, patterns), allowMissingColumns=True)
    # the longest host rule; allow comes before block
    judged = hits.groupBy("row").agg(F.max("host_rule").alias("best"), F.min("pattern_action").alias("pattern_action"))
    judged = counted.join(judged.withColumnRenamed("row", "url"), "url", "left")
    judged = judged.select("url", F.col("best.rule").alias("rule"), F.coalesce("best.action", "pattern_action", F.lit(default)).alias("verdict"))
    out = spread_join(base.where("url IS NOT NULL"), judged, "url", counts=counted.select("url", "_n")).select("page_id", "host", "path", "rule", "verdict")
    none = base.where("url IS NULL").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return out.unionByName(none)
