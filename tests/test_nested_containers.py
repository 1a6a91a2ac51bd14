"""Nested containers against a fold that reads one tree entry by entry."""

import posixpath
import random

import pytest

from intake.operators import containers

ENTRY = "root_id long, container_id long, ordinal int, entry_key string, entry_bytes long, is_directory boolean, is_encrypted boolean, link_target string, child_id long, root_name string"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def fold(rows, limits):
    """The rows of one tree, by recursion over a budget that is never given back."""
    by, out, budget = {}, [], {"entries": 0, "bytes": 0}
    for e in sorted((dict(zip(NAMES, r)) for r in rows), key=lambda e: e["ordinal"]):
        by.setdefault(e["container_id"], []).append(e)
    root, top = rows[0][0], rows[0][-1]

    def failure_of(e, seen, chain):
        name, size = e["entry_key"] or "", e["entry_bytes"] or 0
        if e["is_encrypted"] or e["link_target"]:
            return "unsupported"
        if not name.strip() or name[0] in "/\\" or ":" in name:
            return "path"
        path = posixpath.normpath(name.replace("\\", "/")).lower()
        if path == ".." or path.startswith("../"):
            return "traversal"
        if path in seen:
            return "collision"
        seen.add(path)
        room = min(limits.entry_bytes, limits.total_bytes - budget["bytes"])
        if size > room:
            got = min(size, (room // limits.read_bytes + 1) * limits.read_bytes)
            budget["bytes"] += got
            return "entry_bytes" if got > limits.entry_bytes else "total_bytes"
        budget["bytes"] += size
        return "chain" if len(f"{chain}!/{name}") > limits.chain else None

    def read(container, chain, depth, ordinal, key):
        mark, seen = len(out), set()
        failure = "depth" if depth > limits.depth else None
        for e in () if failure else by.get(container, ()):
            budget["entries"] += 1
            if budget["entries"] > limits.entries:
                failure = "entries"
            elif not e["is_directory"]:
                failure = failure_of(e, seen, chain)
            if failure:
                break
            if e["is_directory"]:
                continue
            own = f"{chain}!/{e['entry_key']}"
            if e["child_id"] is None:
                out.append((root, container, e["ordinal"], e["entry_key"], own, "accepted", None))
            else:
                read(e["child_id"], own, depth + 1, e["ordinal"], e["entry_key"])
        if failure:
            del out[mark:]
            out.append((root, container, ordinal, key, chain, "refused", failure))

    read(root, top, 1, 0, top)
    return out


def grow(rng, root, depth):
    """A random tree: few kinds of names, so that paths collide and leave their containers; sizes near the limits."""
    rows, ids = [], iter(range(root * 1000 + 1, root * 1000 + 999))

    def fill(container, level):
        for i in range(rng.randint(0 if level > 1 else 1, 6)):
            inner = next(ids) if level < depth and rng.random() < 0.35 else None
            odd = rng.random()
            key = rng.choice(["..", "a/../../x", "\\x", "k:x", " ", "./F1"]) if odd < 0.06 else f"d/F{i}" if odd < 0.9 else f"f{rng.randint(1, 3)}"
            size = rng.choice([0, 5, 20, 40, 79, 80, 81, 130, 300]) if rng.random() < 0.3 else rng.randint(0, 30)
            directory = inner is None and rng.random() < 0.15
            rows.append((root, container, i * 2 + 1, key, size, directory, rng.random() < 0.02, "t" if rng.random() < 0.02 else None, inner, f"r{root}"))
            if inner is not None:
                fill(inner, level + 1)

    fill(root, 1)
    return rows


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_random_trees_equal_the_fold(spark, depth):
    rng = random.Random(depth)
    limits = containers.Limits(entries=4 + 3 * depth, entry_bytes=80, total_bytes=200 + 20 * depth, depth=depth, chain=3 + 6 * depth, read_bytes=16)
    trees = [grow(rng, root, depth + 1) for root in range(1, 301)]
    want = sorted(map(str, (r for t in trees for r in fold(t, limits))))
    made = containers.apply_nested_policy(spark.createDataFrame([r for t in trees for r in t], ENTRY), limits)
    assert sorted(str(tuple(r)) for r in made.collect()) == want
    found = {k for k in (*containers.FAILURES, "depth") if any(f"'{k}')" in w for w in want)}
    assert found - {"depth"} == set(containers.FAILURES) and ("depth" in found or depth > 3)


def test_the_plan_has_no_python(spark):
    plan = containers.apply_nested_policy(spark.createDataFrame([], ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_tables_nulls_and_extra_columns(spark):
    assert containers.apply_nested_policy(spark.createDataFrame([], ENTRY)).collect() == []
    rows = [(1, 1, 1, "a", None, None, None, None, None, None), (2, 2, 1, None, 1, False, False, None, None, "r"), (3, 9, 1, "x", 1, False, False, None, None, "r")]
    clashing = spark.createDataFrame(rows, ENTRY).selectExpr("*", "1 AS _at", "'x' AS failure", "2 AS n_seen")
    got = sorted((r.root_id, r.chain, r.outcome, r.failure) for r in containers.apply_nested_policy(clashing).collect())
    assert got == [(1, "!/a", "accepted", None), (2, "r", "refused", "path")]


def test_an_archive_named_twice_is_read_twice(spark):
    rows = [(1, 1, 1, "a.zip", 1, False, False, None, 7, "r"), (1, 1, 2, "b.zip", 1, False, False, None, 7, "r"), (1, 7, 1, "x", 1, False, False, None, None, "r")]
    got = sorted(r.chain for r in containers.apply_nested_policy(spark.createDataFrame(rows, ENTRY)).collect())
    assert got == ["r!/a.zip!/x", "r!/b.zip!/x"]
