"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import read_table, stored, trimmed

WINDOW = 20
#: A difference cover: for any two residues there is a shift below PERIOD that brings both into COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: An anchor at any such shift lies within the window.
ANCHOR = WINDOW - PERIOD + 1
NO_ID = -(2**63)
#: A window's words are told apart by 96 bits: two hashes of different bases.
KEY = np.dtype([("h", np.uint64), ("check", np.uint32)])


class Block:
    """Some whole documents."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        sizes = np.frombuffer(sizes, np.int64)
        raw = zstandard.decompress(texts)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))
        self.words, self.ends = W.split(self.texts)
        self.hashes = W.hashes(self.words)
        self.text, self.place = W.places(self.ends)

    def inside(self, size: int) -> np.ndarray:
        """Whether the `size` words from each word on are of one document."""
        n = max(0, len(self.hashes) - size + 1)
        return self.place[:n] + size <= np.diff(self.ends)[self.text[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors are, and their hashes."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(self.inside(ANCHOR) & cover[self.place[: max(0, len(self.hashes) - ANCHOR + 1)] % PERIOD])
        return at, W.runs(self.hashes, ANCHOR)[at]

    def near(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of the places hit."""
        covered = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(covered, np.maximum(hit - (PERIOD - 1), 0), 1)
        np.add.at(covered, hit + 1, -1)
        inside = self.inside(WINDOW)
        return np.flatnonzero(inside & (np.cumsum(covered)[: len(inside)] > 0))

    def windows(self, start: np.ndarray) -> np.ndarray:
        """The 96-bit hashes of the windows that begin at start."""
        out = np.empty(len(start), KEY)
        out["h"] = W.runs(self.hashes, WINDOW)[start]
        out["check"] = W.runs(self.hashes, WINDOW, W.OTHER)[start] >> np.uint64(32)
        return out


def to_blocks(block_bytes: int):
    def run(batches):
        ids, texts, held = [], [], 0

        def block():
            sizes = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()], "sizes": [sizes.tobytes()], "texts": [zstandard.compress(b"".join(texts))],
            })

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append((text or "").encode("utf-8"))
                held += len(texts[-1])
                if held >= block_bytes:
                    yield block()
                    ids, texts, held = [], [], 0
        if ids:
            yield block()

    return run


def cut(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets' parts of sorted hashes begin and end."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(h, np.array(edges, np.uint64)), [len(h)]]).astype(np.int64)


def sent(block: int, h: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, block, ...) of what belongs to a block's sorted hashes h: one for each bucket that gets any."""
    at = cut(h, buckets)
    full = np.flatnonzero(np.diff(at))
    out = {"bucket": full.astype(np.int64), "block": np.full(len(full), block, np.int64)}
    return pa.RecordBatch.from_pydict(out | {k: pa.array([v[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()) for k, v in columns.items()})


def low(h: np.ndarray) -> np.ndarray:
    """What an anchor is known by within its bucket, which holds a bounded number of them; a false match costs work, no more."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def send_anchors(buckets: int):
    """Each block's anchors, once each, with whether the block holds it several times."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.unique(Block(row["ids"], row["sizes"], row["texts"]).anchors()[1], return_counts=True)
                yield sent(row["block"], h, {"h": low(h), "many": n > 1}, buckets)

    return run


def _gathered(table: pa.Table, **kinds) -> tuple[np.ndarray, ...]:
    """The blocks' columns one behind another, and the number of the row that each value came from."""
    parts = [[np.frombuffer(b, kind) for b in table.column(k).to_pylist()] for k, kind in kinds.items()]
    return (*(np.concatenate(p) for p in parts), np.repeat(np.arange(table.num_rows), [len(x) for x in parts[0]]))


def _answers(table: pa.Table, keys: np.ndarray, row: np.ndarray) -> pa.Table:
    """For each block (and bucket) its part of keys, which row tells."""
    order = np.argsort(row, kind="stable")
    keys, row = keys[order], row[order]
    at = np.searchsorted(row, np.arange(table.num_rows + 1))
    full = np.flatnonzero(np.diff(at))
    held = {c: pa.array(table.column(c).to_numpy()[full], pa.int64()) for c in ("block", "bucket")}
    return pa.Table.from_pydict(held | {"h": pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())})


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each block, its anchors that some block holds as well, or itself again."""
    h, many, row = _gathered(table, h=np.uint32, many=np.bool_)
    values, place, count = np.unique(h, return_inverse=True, return_counts=True)
    again = np.zeros(len(values), bool)
    again[place[many]] = True
    hit = ((count > 1) | again)[place]
    return _answers(table, h[hit], row[hit])


def first_here(keys: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (hashes, id, place), and in it the first of each pair of hashes: (order, is_first)."""
    order = np.lexsort((place, ids))  # nearly in order as it comes
    h, check = np.ascontiguousarray(keys["h"]), np.ascontiguousarray(keys["check"])
    order = order[np.argsort(h[order], kind="stable")]
    first = np.ones(len(keys), bool)
    first[1:] = h[order[1:]] != h[order[:-1]]
    if (check[order[1:]] != check[order[:-1]])[~first[1:]].any():  # words of one first hash: the second one tells them apart
        order = np.lexsort((place, ids, check, h))
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order, first


def send_windows(buckets: int):
    """Each block's candidate windows, around its shared anchors; of equal ones the earliest."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not row["shared"]:
                    continue
                b = Block(row["ids"], row["sizes"], row["texts"])
                at, anchor = b.anchors()
                bucket = np.searchsorted(np.array([(x << 64) // buckets for x in range(1, buckets)], np.uint64), anchor, "right").astype(np.uint64)
                shared = np.concatenate([np.frombuffer(x["h"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in row["shared"]])
                start = b.near(at[np.isin(low(anchor).astype(np.uint64) | bucket << np.uint64(32), shared)])
                keys, ids, place = b.windows(start), b.ids[b.text[start]], b.place[start].astype(np.int32)
                order, first = first_here(keys, ids, place)
                order = order[first]
                yield sent(row["block"], keys["h"][order], {"h": keys[order], "ids": ids[order], "place": place[order]}, buckets)

    return run


def _late(keys: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the same words start earlier."""
    order, first = first_here(keys, ids, place)
    out = np.zeros(len(keys), bool)
    if len(order):
        best = order[first][np.cumsum(first) - 1]  # the earliest of each one's words
        out[order] = (ids[order] != ids[best]) | (place[order] != place[best])
    return out


def later_windows(table: pa.Table) -> pa.Table:
    """For each block, its windows that start earlier in another block."""
    keys, ids, place, row = _gathered(table, h=KEY, ids=np.int64, place=np.int32)
    late = _late(keys, ids, place)
    return _answers(table, keys[late], row[late])


def finish(batches):
    """The documents, without the words of windows that start earlier in another block or in this one."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row["ids"], row["sizes"], row["texts"])
            gone = np.zeros(len(b.hashes) + 1, np.int64)
            start = np.flatnonzero(b.inside(WINDOW))
            keys = b.windows(start)
            late = _late(keys, b.ids[b.text[start]], b.place[start])
            if row["late"]:
                told = np.sort(np.concatenate([np.frombuffer(x["h"], KEY) for x in row["late"]]), order=("h", "check"))
                # Two windows of one h among the told are as good as excluded; all that share the h are looked at.
                at = np.searchsorted(told["h"], keys["h"])
                for ahead in range(int(_longest_run(told["h"]))):
                    here = np.minimum(at + ahead, len(told) - 1)
                    late |= (told["h"][here] == keys["h"]) & (told["check"][here] == keys["check"])
            np.add.at(gone, start[late], 1)
            np.add.at(gone, start[late] + WINDOW, -1)
            kept = np.cumsum(gone)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            left = b.words.filter(pa.array(kept)).to_pylist()
            texts = [" ".join(left[before[i] : before[j]]) for i, j in zip(b.ends[:-1], b.ends[1:], strict=True)]
            n = np.diff(b.ends)
            removed = n - (before[b.ends[1:]] - before[b.ends[:-1]])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(b.ids, mask=b.ids == NO_ID), "n_words": n, "n_removed": removed, "kept": pa.array(texts, pa.string())})


def _longest_run(h: np.ndarray) -> int:
    """The length of the longest run of equal numbers among sorted ones."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return int(np.diff(np.append(starts, len(h))).max(initial=0))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of docs: kept is the words that stay, joined by one space.

    A word goes if a window of 20 consecutive words of its document holds it whose words also start earlier: in a
    document with a smaller id, or before it in the same one. Windows are those of the input. Null texts have no words.
    Rows without an id come before all ids, as one document (so would the id -2**63, which is their mark); of windows that start at the same place of rows with the
    same id, none is earlier, so repeated rows keep what one row keeps. Texts below 20 words stay whole, empty tables
    stay empty, other columns are not looked at.

    1. Whole documents go into compressed blocks in a shared table. 2. Anchors of 8 words are hashed only at places
    whose residue modulo 13 is in the difference cover {0, 1, 3, 9}: any two equal windows have an anchor in common at
    the same shift. Blocks send each of their anchors once to the bucket of its hash and hear which are held elsewhere
    too. 3. Around those the match is extended to whole windows; their words, as 96 bits of two hashes, and their first places
    meet in the same way; blocks hear which of theirs start earlier elsewhere. A false match would need two windows alike
    in all 96 bits: some 1e-3 are to be expected among the 1e13 windows of 100 TB. 4. Each block removes the words. A
    passage that is everywhere is sent once by each block. Buckets grow in number with the text, so each stays small; a
    block sends a row for each bucket that it has hashes for, so never more rows than hashes."""
    blocks = stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(to_blocks(block_bytes), "block long, ids binary, sizes binary, texts binary"), "blocks")
    # Bytes of compressed text; an anchor's hash takes about as much as the text it stands for.
    total = blocks.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    sent_anchors = blocks.mapInArrow(trimmed(send_anchors(buckets), docs.sparkSession), "bucket long, block long, h binary, many binary")
    answer = "block long, bucket long, h binary"
    shared = sent_anchors.groupBy("bucket").applyInArrow(lambda t: shared_anchors(t), answer)
    shared = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "h")).alias("shared"))
    # Both joins with the blocks are left ones, so that one exchange of the blocks serves them both.
    sent_windows = blocks.join(shared, "block", "left").mapInArrow(trimmed(send_windows(buckets), docs.sparkSession), "bucket long, block long, h binary, ids binary, place binary")
    late = sent_windows.groupBy("bucket").applyInArrow(lambda t: later_windows(t), answer)
    late = late.groupBy("block").agg(F.collect_list(F.struct("bucket", "h")).alias("late"))
    return blocks.join(late, "block", "left").mapInArrow(trimmed(finish, docs.sparkSession), "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS k FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS late FROM h),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM f, (SELECT unnest(range(0, 20)) AS j) WHERE late),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w),
k AS (SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS m, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
