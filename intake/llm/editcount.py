"""Token counts that follow edits, from a tree of pre-token segments kept for each document.

The words of a text are cut in leaves of `leaf` words, each with its number of tokens, and a binary tree of sums stands above the
leaves. Words are encoded independently of each other, so an edit changes only leaves that it touches, or whose last or first word
may grow together with the edited region: those are encoded again, the others keep their counts, and only the sums on the way to
the root change. A leaf that grew to four times its size is split, and then the sums (not the counts) are formed anew.

Edits are rows doc_id, position, n_deleted, inserted; positions count code points of the text before all its edits, from 0. They are
applied together. Equal rows count once. An edit that starts inside what an earlier one deletes starts where that one ends, and
deletes what is left of its own range; positions beyond the end append; null numbers are 0 and a null text inserts nothing.

Edge cases: a null text is empty, with 0 tokens; a document without edits keeps its count; edits of unknown or null documents are
ignored; rows that share a doc_id each get all its edits; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, text_bytes
from .encode import WordEncoder, encoder, vocabulary_path, words_stand_alone

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True


def leaf_starts(text: bytes, leaf: int) -> np.ndarray:
    """Where leaves begin: at 0, and at the first byte of each `leaf`-th word."""
    space = _IS_SPACE[np.frombuffer(text, np.uint8)]
    words = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(text) else np.zeros(0, int)
    return np.r_[0, words[leaf::leaf]].astype(np.int64)


def sums(counts: np.ndarray) -> np.ndarray:
    """The tree: node 1 is the root, node k stands above 2k and 2k + 1, leaves fill the second half."""
    size = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(counts)] = counts
    while size > 1:
        size //= 2
        tree[size : 2 * size] = tree[2 * size : 4 * size].reshape(-1, 2).sum(axis=1)
    return tree


class SegmentTree:
    def __init__(self, text: bytes, starts: np.ndarray, tree: np.ndarray, leaf: int):
        self.text, self.starts, self.tree, self.leaf = text, starts, tree, leaf

    @classmethod
    def build(cls, text: bytes, enc: WordEncoder, leaf: int) -> SegmentTree:
        starts = leaf_starts(text, leaf)
        counts = np.array([enc.count(text[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(text)])])
        return cls(text, starts, sums(counts), leaf)

    @property
    def total(self) -> int:
        return int(self.tree[1])

    def counts(self) -> np.ndarray:
        half = len(self.tree) // 2
        return self.tree[half : half + len(self.starts)]

    def apply(self, edits: list[tuple[int, int, bytes]], enc: WordEncoder) -> tuple[SegmentTree, int]:
        """edits: (byte, bytes deleted, inserted), ascending and apart. The tree after them, and how many bytes were encoded again."""
        end, n = len(self.text), len(self.starts)
        regions: list[list] = []
        for at, gone, new in edits:
            first = int(np.searchsorted(self.starts, max(at - 1, 0), "right")) - 1
            last = int(np.searchsorted(self.starts, min(at + gone, max(end - 1, 0)), "right")) - 1
            if regions and first <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], last)
                regions[-1][2].append((at, gone, new))
            else:
                regions.append([first, last, [(at, gone, new)]])
        bounds = np.r_[self.starts, end]
        texts, starts, counts, changed, encoded, done, same = [], [], [], [], 0, 0, True
        at_out = 0
        for first, last, own in regions:
            keep = self.text[bounds[done] : bounds[first]]
            starts += (self.starts[done:first] - bounds[done] + at_out).tolist()
            counts += self.counts()[done:first].tolist()
            texts.append(keep)
            at_out += len(keep)
            parts, p = [], int(bounds[first])
            for at, gone, new in own:
                parts += [self.text[p:at], new]
                p = at + gone
            region = b"".join([*parts, self.text[p : int(bounds[last + 1])]])
            k = last - first + 1
            cuts = leaf_starts(region, self.leaf)
            if len(cuts) <= 4 * k:  # as many leaves as before, the words dealt evenly
                words = leaf_starts(region, 1)
                pick = [int(words[min(len(words) - 1, i * len(words) // k)]) if i else 0 for i in range(k)]
                cuts = np.array(pick, np.int64)
            else:
                same = False
            fresh = [enc.count(region[a:b]) for a, b in zip(cuts, [*cuts[1:], len(region)])]
            if same:
                changed += list(zip(range(first, last + 1), fresh))
            starts += (cuts + at_out).tolist()
            counts += fresh
            texts.append(region)
            at_out += len(region)
            encoded += len(region)
            done = last + 1
        starts += (self.starts[done:] - bounds[done] + at_out).tolist() if done < n else []
        counts += self.counts()[done:].tolist()
        texts.append(self.text[bounds[done] :] if done < n else b"")
        tree = self.tree.copy() if same else sums(np.array(counts))
        for leaf, count in changed if same else ():
            k = len(tree) // 2 + leaf
            delta = count - tree[k]
            while k:
                tree[k] += delta
                k //= 2
        return SegmentTree(b"".join(texts), np.array(starts, np.int64), tree, self.leaf), encoded


STATE = "doc_id long, text binary, starts array<long>, tree array<long>"


def _checked(tokenizer: str | None) -> str:
    """The tokenizer's path; one that does not encode words independently of each other has no counts of leaves."""
    path = tokenizer or vocabulary_path()
    if not words_stand_alone(path):
        raise ValueError(f"{path}: leaves can be counted only where words are encoded independently of each other")
    return path


def build_trees(docs: DataFrame, leaf: int = 32, tokenizer: str | None = None) -> DataFrame:
    """The state of each document: doc_id, text, starts (leaves' bytes), tree (sums of tokens)."""
    path = _checked(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                trees = [SegmentTree.build(t or b"", enc, leaf) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), part.column("text"), pa.array([t.starts for t in trees], pa.list_(pa.int64())), pa.array([t.tree for t in trees], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "starts", "tree"])

    return text_bytes(docs).mapInArrow(run, STATE)


def _in_bytes(text: bytes, edits: list[dict]) -> list[tuple[int, int, bytes]]:
    """Edits by code points, in any order -> by bytes, ascending and apart."""
    at_byte = np.r_[np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80), len(text)]
    most, free, out = len(at_byte) - 1, 0, []
    for at, gone, new in sorted({(max(e["position"] or 0, 0), max(e["n_deleted"] or 0, 0), e["inserted"] or "") for e in edits}):
        stop = min(at + gone, most)
        at = min(max(at, free), most)
        free = max(stop, at)
        out.append((int(at_byte[at]), int(at_byte[free] - at_byte[at]), new.encode()))
    return out


RESULT = "doc_id long, text binary, starts array<long>, tree array<long>, n_tokens_before long, n_tokens long, n_edits long, n_bytes_encoded long"


def apply_edits(state: DataFrame, edits: DataFrame, leaf: int = 32, tokenizer: str | None = None) -> DataFrame:
    """The state after the edits, with n_tokens_before, n_tokens, n_edits and n_bytes_encoded (bytes that were encoded again)."""
    path = _checked(tokenizer)
    grouped = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    grouped = grouped.agg(F.collect_set(F.struct(F.col("position").cast("long").alias("position"), F.col("n_deleted").cast("long").alias("n_deleted"), "inserted")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for doc_id, text, starts, tree, own in zip(*batch.slice(lo, 500).columns):
                    text = text.as_py() or b""
                    old = SegmentTree(text, starts.values.to_numpy(), tree.values.to_numpy(), leaf)
                    new, encoded, apart = old, 0, _in_bytes(text, own.as_py() or [])
                    if apart:
                        new, encoded = old.apply(apart, enc)
                    out.append((doc_id.as_py(), new.text, new.starts, new.tree, old.total, new.total, len(apart), encoded))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
                names = [c.split()[0] for c in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return state.select("doc_id", "text", "starts", "tree").join(grouped, "doc_id", "left").mapInArrow(run, RESULT)
