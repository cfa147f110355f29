"""Exact substring dedup on a suffix array over anchors.

Every byte that a LENGTH-byte string covers which also starts earlier in the corpus is removed. Suffixes are sorted by the
deep-shallow method, but only where a repeat is possible:

1. In every LENGTH-byte window the least hash of its GRAM-byte strings is the window's anchor. Equal windows have equal anchors
   at equal places, so only windows whose anchor's hash recurs can repeat. An anchor serves a run of windows.
2. Anchors are dealt by hash to buckets; those whose hash is there once are dropped.
3. The rest get their surroundings from the texts, are dealt by hash again, and each bucket sorts the suffixes that begin at its
   anchors, and the reversed prefixes that end there: a multikey quicksort on eight-byte characters down to SHALLOW bytes,
   then blind tries over the distinct strings of what still ties. With the longest common prefixes on both sides, two windows
   with the same place of the anchor are equal if both sides agree far enough; all but the first of each class are marked.
   An anchor hash that more than GROUP_MAX anchors share is dealt to several buckets by document. Each marks all but its own
   first windows; those go on as 128-bit hashes, the bytes of the ones whose hash recurs are fetched and grouped over the corpus with
   partial minima, and all but the first are marked as well. So no bucket holds more than a bounded part of a passage that very many
   documents share, and bytes are compared everywhere.
4. Marks are merged by document and cut out of the text.

A document whose whole text is there earlier is settled by its hash and takes part in none of this.

Defined results: a null text is empty; null document ids rank before all; rows that share an id are ranked by the hash of their
texts; exact repeats of a row are one document whose result each of them gets; texts under LENGTH bytes stay; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, stored, table
from tidemark.llm.spans import NULL_ID, keyed

LENGTH, GRAM = 100, 20
PLACES = LENGTH - GRAM + 1  # of an anchor in a window
SHALLOW = 16
#: Bytes of text that are handled at once; a longer text is taken in stretches that overlap by a window.
STRETCH = 1 << 19
#: Anchors of one hash that a bucket takes together.
GROUP_MAX = 100_000
#: Bytes of text for each bucket of anchors, at most, and of entries in one array.
BUCKET_TEXT, SLICE = 128 << 20, 1 << 30
PLACE_BITS = np.uint64(20)
FACTOR = 0x9E3779B97F4A7C15
ANCHOR = np.dtype([("id", "<u8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("parts", "<u2")])
SPAN = np.dtype([("start", "<u4"), ("stop", "<u4")])
FIRST = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("start", "<u4")])


def grams(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    powers = [np.uint64(pow(FACTOR, k, 1 << 64)) for k in (1, 2, 4, 8)]
    h1 = buffer.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * powers[0] + h1[1:]
    h4 = h2[:-2] * powers[1] + h2[2:]
    h8 = h4[:-4] * powers[2] + h4[4:]
    h16 = h8[:-8] * powers[3] + h8[8:]
    h = h16[:-4] * powers[2] + h4[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of the texts that ``buffer`` holds from ``starts`` to ``stops``, by place: a structured array (places count
    in the buffer) and the number of each one's text."""
    windows = np.maximum(stops - starts - LENGTH + 1, 0)
    if not windows.sum():
        return np.zeros(0, ANCHOR), np.zeros(0, np.int64)
    h = grams(buffer)
    least = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= PLACES:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (PLACES - reach)], least[PLACES - reach :])
    begun = np.cumsum(windows) - windows
    p = np.repeat(starts - begun, windows) + np.arange(windows.sum())
    at = (least[p] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    made = np.zeros(len(first), ANCHOR)
    made["id"], made["pos"] = h[at[first]] & np.uint64((1 << 48) - 1), at[first]
    made["hi"], made["lo"] = at[first] - p[first], at[last] - p[last]
    return made, np.searchsorted(begun + windows, first, side="right")


def stretches(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, start, stop) of at most STRETCH bytes in all; windows are in one stretch each."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        for start in range(0, max(1, len(raw) - LENGTH + 1), STRETCH - LENGTH):
            stop = min(len(raw), start + STRETCH - 1)
            if held and size + stop - start > STRETCH:
                yield held
                held, size = [], 0
            held.append((i, start, stop))
            size += stop - start
    if held:
        yield held


def text_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all texts, places counted in the own text, and each one's text; ordered by text."""
    found, owners = [], []
    for part in stretches(texts):
        buffer = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in part]), np.uint8)
        sizes = np.array([b - a for _, a, b in part])
        starts = np.cumsum(sizes) - sizes
        made, of = anchors(buffer, starts, starts + sizes)
        made["pos"] += (np.array([a for _, a, _ in part]) - starts)[of].astype(np.int64).astype("<u4")
        found.append(made)
        owners.append(np.array([i for i, _, _ in part])[of])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, ANCHOR), np.zeros(0, np.int64))


def counted(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``owners``, which are grouped, and the length of each one's run."""
    first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, np.int64)
    return owners[first], np.diff(np.concatenate([first, [len(owners)]]))


def blob(keys: np.ndarray, owners: np.ndarray, entries: np.ndarray, extra: bytes = b"") -> bytes:
    """``entries`` of some documents, grouped by document, with their keys."""
    at, counts = counted(owners)
    head = np.array([len(at), len(entries)], "<u4")
    return zstandard.compress(b"".join([head.tobytes(), keys[at].tobytes(), counts.astype("<u4").tobytes(), *[np.ascontiguousarray(entries[c]).tobytes() for c in ANCHOR.names], extra]), 1)


def unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys (a row for each entry), entries, and what else the blob has."""
    raw = zstandard.decompress(raw)
    n_docs, n = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8
    keys = np.frombuffer(raw, "<i8", 2 * n_docs, at).reshape(-1, 2)
    at += 16 * n_docs
    counts = np.frombuffer(raw, "<u4", n_docs, at)
    at += 4 * n_docs
    entries = np.zeros(n, ANCHOR)
    for c in ANCHOR.names:
        entries[c] = np.frombuffer(raw, ANCHOR[c], n, at)
        at += ANCHOR[c].itemsize * n
    return np.repeat(keys, counts, axis=0), entries, raw[at:]


def by_document(keys: np.ndarray, entries: np.ndarray) -> pa.Table:
    """A row for each document: its key and its entries' bytes. Entries are grouped by document."""
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    stops = np.concatenate([first[1:], [len(keys)]])
    tables = []
    # Arrow's binary arrays end at 2 GB, so that very many entries make several
    for at in np.split(np.arange(len(first)), np.flatnonzero(np.diff(stops * entries.dtype.itemsize // SLICE)) + 1):
        low, high = (int(first[at[0]]), int(stops[at[-1]])) if len(at) else (0, 0)
        offsets = (np.concatenate([first[at], [high]]) - low) * entries.dtype.itemsize
        data = pa.py_buffer(np.ascontiguousarray(entries[low:high]).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data])
        tables.append(pa.table({"key_id": pa.array(keys[first[at], 0] if len(at) else [], pa.int64()), "key_text": pa.array(keys[first[at], 1] if len(at) else [], pa.int64()), "entries": packed}))
    return pa.concat_tables(tables)


#: Two 64-bit hashes of each row of bytes.
Hashes = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
BY_DOCUMENT = "key_id long, key_text long, entries binary"


def repeated(group: pa.Table, group_max: int) -> pa.Table:
    """Of one bucket's anchors those whose hash is there twice or more, with the number of buckets that the hash is to be dealt to."""
    parts = [unblob(x)[:2] for x in group.column("packed").to_pylist()]
    keys, entries = np.concatenate([k for k, _ in parts]), np.concatenate([e for _, e in parts])
    order = np.argsort(entries["id"], kind="stable")
    ids = entries["id"][order]
    same = ids[1:] == ids[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    _, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    entries["parts"][order] = np.minimum(-(-counts // group_max), 65535)[which]
    keep = np.sort(order[twice])
    return by_document(keys[keep], entries[keep])


class BlindTrie:
    """A trie of strings that keeps only branching places. Descending looks at those places alone; one comparison with any
    string below then tells where the new one leaves the path."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    def add(self, text: bytes) -> None:
        node = self.root
        while isinstance(node, list):
            at, children = node
            node = children.get(text[at]) or next(iter(children.values()))
        if node == text:
            return
        depth = next(i for i, (x, y) in enumerate(zip(node, text, strict=True)) if x != y)
        below, parent, sign = self.root, None, 0
        while isinstance(below, list) and below[0] < depth:
            parent, sign = below, text[below[0]]
            below = below[1][sign]
        if isinstance(below, list) and below[0] == depth:
            below[1][text[depth]] = text
            return
        made = [depth, {node[depth]: below, text[depth]: text}]
        if parent is None:
            self.root = made
        else:
            parent[1][sign] = made

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def stretches_of_ties(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each place is in."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def deep_shallow(strings: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (bytes) within each group, groups together, and each row's common prefix with the one
    before it (-1 at the start of a group). The first ``skip`` bytes are equal within a group."""
    n, width = strings.shape
    order, tie = np.argsort(group, kind="stable"), None
    tie = stretches_of_ties(group[order])
    for at in range(skip, skip + SHALLOW, 8):  # one eight-byte character deeper, only where rows still tie
        sizes = np.bincount(tie)
        open_ = np.flatnonzero(sizes[tie] > 1)
        character = np.ascontiguousarray(strings[order[open_], at : at + 8]).view(">u8").ravel()
        inner = np.lexsort((character, tie[open_]))
        order[open_] = order[open_[inner]]
        whole = np.zeros(n, np.uint64)
        whole[open_] = character[inner]
        tie = stretches_of_ties(tie, whole)
    sizes = np.bincount(tie)
    deep = np.flatnonzero(sizes[tie] > 1)
    if len(deep):
        rows = strings[order[deep]]
        padded = np.zeros((len(deep), -(-width // 8) * 8), np.uint8)
        padded[:, :width] = rows
        digest = np.zeros(len(deep), np.uint64)
        for column in padded.view("<u8").T:
            digest = (digest ^ column) * np.uint64(FACTOR)
            digest ^= digest >> np.uint64(31)
        inner = np.lexsort((digest, tie[deep]))
        rows, ties = rows[inner], tie[deep][inner]
        order[deep] = order[deep[inner]]
        new = np.concatenate([[True], (ties[1:] != ties[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)])
        which, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        place = np.zeros(len(heads), np.int64)
        runs, counts = counted(ties[heads])
        stops = np.cumsum(counts)
        for a, b in zip((stops - counts)[counts > 1].tolist(), stops[counts > 1].tolist(), strict=True):
            texts = [rows[i].tobytes() for i in heads[a:b].tolist()]
            trie = BlindTrie(texts[0])
            for x in texts[1:]:
                trie.add(x)
            rank = {x: k for k, x in enumerate(trie.ordered())}
            place[a:b] = [rank[x] for x in texts]
        order[deep] = order[deep[np.lexsort((place[which], ties))]]
    common = np.full(n, -1, np.int64)
    for at in range(1, n, 1 << 15):
        mine = slice(at, min(n, at + (1 << 15)))
        above = order[at - 1 : mine.stop - 1]
        differs = strings[order[mine]] != strings[above]
        common[mine] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        common[mine][group[order[mine]] != group[above]] = -1
    return order, common


def sides(data: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What follows each anchor (from it on) and what precedes it (backwards), zeros where it's of no use to any window."""
    n = len(base)
    after, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, PLACES - 1), np.uint8)
    for at in range(0, n, 1 << 14):
        mine = slice(at, at + (1 << 14))
        k, zero = np.arange(LENGTH), (base + hi)[mine, None]
        used = k < LENGTH - lo[mine, None]
        after[mine] = np.where(used, data[np.where(used, zero + k, 0)], 0)
        k = np.arange(PLACES - 1)
        used = k < hi[mine, None]
        before[mine] = np.where(used, data[np.where(used, zero - 1 - k, 0)], 0)
    return after, before


def marked(group: pa.Table, hashes: Hashes) -> pa.Table:
    """Of one bucket's windows all but the first of each class, as spans of their documents; of hashes that several buckets share the first ones too."""
    parts = [unblob(x) for x in group.column("packed").to_pylist()]
    keys, entries = np.concatenate([k for k, _, _ in parts]), np.concatenate([e for _, e, _ in parts])
    data = np.frombuffer(b"".join([x for _, _, x in parts]), np.uint8)
    lo, hi = entries["lo"].astype(np.int64), entries["hi"].astype(np.int64)
    sizes = LENGTH + hi - lo
    base = np.cumsum(sizes) - sizes
    rank = np.lexsort((entries["pos"], keys[:, 1], keys[:, 0]))
    keys, entries, lo, hi = keys[rank], entries[rank], lo[rank], hi[rank]
    _, group_of = np.unique(entries["id"], return_inverse=True)
    after, before = sides(data, base[rank], lo, hi)
    n = len(rank)
    right_order, right_common = deep_shallow(after, group_of, GRAM)
    left_order, left_common = deep_shallow(before, group_of)
    right_at, left_at = np.argsort(right_order), np.argsort(left_order)
    flags = np.zeros((n, PLACES + 2), np.int8)
    for o in range(PLACES):
        mine = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(mine):
            continue
        right = np.cumsum(right_common < LENGTH - o)[right_at[mine]]
        left = np.cumsum(left_common < o)[left_at[mine]]
        flags[mine[pd.Series(right * (n + 1) + left).duplicated().to_numpy()], o + 1] = 1
    edges = np.diff(flags, axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    spans = np.zeros(len(row), SPAN)
    pos = entries["pos"].astype(np.int64)[row]
    spans["start"], spans["stop"] = pos - last, pos - first + LENGTH
    out = by_document(keys[row], spans)
    out = out.append_column("firsts", pa.nulls(len(out), pa.binary()))
    places = np.arange(PLACES)
    shared = entries["parts"] > 1
    row, o = np.nonzero(shared[:, None] & (lo[:, None] <= places) & (places <= hi[:, None]) & (flags[:, 1:-1] == 0)) if shared.any() else (np.zeros(0, np.int64),) * 2
    if len(row):
        firsts = np.zeros(len(row), FIRST)
        firsts["start"] = entries["pos"].astype(np.int64)[row] - o
        at = base[rank][row] + hi[row] - o
        for k in range(0, len(row), 1 << 15):
            mine = slice(k, k + (1 << 15))
            firsts["h1"][mine], firsts["h2"][mine] = hashes(data[at[mine, None] + np.arange(LENGTH)])
        more = by_document(keys[row], firsts)
        more = more.append_column("firsts", more.column("entries")).set_column(2, "entries", pa.nulls(len(more), pa.binary()))
        out = pa.concat_tables([out, more])
    return out


MARKS = f"{BY_DOCUMENT}, firsts binary"


def _marks_of_firsts(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of the windows that are first in their bucket and not first in the corpus. Windows whose hash is there once are settled; the bytes of the
    others are fetched from ``texts`` and grouped, so that no hash decides."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, FIRST) for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in parts]
            whole = np.concatenate(parts)
            keys = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1)]
            values = [keys[0], keys[1], np.ascontiguousarray(whole["h1"]), np.ascontiguousarray(whole["h2"]), whole["start"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["key_id", "key_text", "h1", "h2", "start"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (raw, starts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                keys = [pa.array(np.repeat(batch.column(i)[k].as_py(), len(starts)), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(starts, pa.int64()), pa.array([raw[x : x + LENGTH] for x in starts], pa.binary())], ["key_id", "key_text", "start", "bytes"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for starts in batch.column(2).to_pylist():
                x = np.zeros(len(starts), SPAN)
                x["start"] = starts
                x["stop"] = x["start"] + LENGTH
                made.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["key_id", "key_text", "entries"])

    given = marks.where("firsts is not null").select("key_id", "key_text", "firsts")
    windows = stored(given.mapInArrow(rows, "key_id long, key_text long, h1 long, h2 long, start long"), "windows")
    again = stored(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "again")
    wanted = windows.join(again, ["h1", "h2"]).groupBy("key_id", "key_text").agg(F.collect_list("start").alias("starts"))
    read = texts.join(stored(wanted, "wanted"), ["key_id", "key_text"]).select("key_id", "key_text", "raw", "starts")
    read = stored(read.mapInArrow(fetched, "key_id long, key_text long, start long, bytes binary"), "fetched")
    at = F.struct("key_id", "key_text", "start")
    first = stored(read.groupBy("bytes").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("bytes", "first"), "firsts")
    later = read.join(first, "bytes").where(at != F.col("first"))
    return later.groupBy("key_id", "key_text").agg(F.collect_list("start").alias("starts")).mapInArrow(spans, BY_DOCUMENT)


def _dealt(rows: DataFrame, n: int, with_text: bool) -> DataFrame:
    """``rows`` (key_id, key_text, raw[, entries]) as blobs of anchors (with their surroundings) by bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 16 * STRETCH):
                    size += len(texts[end])
                    end += 1
                yield from one(keys[at:end], texts[at:end], batch.column(3)[at:end].to_pylist() if with_text else None)
                at = end

    def one(keys: np.ndarray, texts: list[bytes], known: list | None) -> Iterator[pa.RecordBatch]:
        if known is None:
            entries, owners = text_anchors(texts)
        else:
            mine = [np.frombuffer(b"".join(x), ANCHOR) for x in known]
            entries, owners = np.concatenate(mine), np.repeat(np.arange(len(texts)), [len(x) for x in mine])
        salt = np.zeros(len(entries), np.uint64)
        if known is not None:
            mixed = (keys[owners, 0].astype(np.uint64) ^ keys[owners, 1].astype(np.uint64)) * np.uint64(FACTOR) >> np.uint64(40)
            salt = mixed % np.maximum(entries["parts"], 1).astype(np.uint64)
        bucket = ((entries["id"] + salt * np.uint64(7919)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries, owners, bucket = entries[order], owners[order], bucket[order]
        which, counts = counted(bucket)
        stops = np.cumsum(counts)
        extra = [b""] * len(which)
        if known is not None:
            extra = surroundings(texts, entries, owners, stops)
        made = [blob(keys, owners[b - c : b], entries[b - c : b], x) for b, c, x in zip(stops.tolist(), counts.tolist(), extra, strict=True)]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(made, pa.binary())], ["bucket", "packed"])

    return rows.mapInArrow(deal, "bucket int, packed binary")


def surroundings(texts: list[bytes], entries: np.ndarray, owners: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The bytes that the windows of each anchor cover, joined for each stretch of entries that ``stops`` ends."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    lo, hi = entries["lo"].astype(np.int64), entries["hi"].astype(np.int64)
    starts, lengths = (np.cumsum(sizes) - sizes)[owners] + entries["pos"] - hi, LENGTH + hi - lo
    out = []
    for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
        pieces = []
        for k in range(a, b, 1 << 14):
            mine = slice(k, min(b, k + (1 << 14)))
            begun = np.cumsum(lengths[mine]) - lengths[mine]
            at = np.repeat(starts[mine] - begun, lengths[mine]) + np.arange(lengths[mine].sum())
            pieces.append(buffer[at].tobytes())
        out.append(b"".join(pieces))
    return out


CUT = "key_id long, key_text long, n_removed long, n_spans long, kept_sha256 string"


def _cut(rows: DataFrame) -> DataFrame:
    """``rows``: key_id, key_text, raw, entries (spans of marked windows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for raw, entries in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans = np.frombuffer(b"".join(entries), SPAN)
                level = np.zeros(len(raw) + 1, np.int64)
                np.add.at(level, spans["start"].astype(np.int64), 1)
                np.add.at(level, spans["stop"].astype(np.int64), -1)
                gone = np.cumsum(level[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], [c.split()[0] for c in CUT.split(", ")])

    return rows.mapInArrow(cut, CUT)


def window_hashes(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    padded = np.zeros((len(windows), -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = windows
    out = []
    for factor, start in ((FACTOR, 17), (0xC2B2AE3D27D4EB4F, 91)):
        h = np.full(len(windows), start, np.uint64)
        for column in padded.view("<u8").T:
            h = (h ^ column) * np.uint64(factor)
            h ^= h >> np.uint64(31)
        out.append(h.view(np.int64))
    return out[0], out[1]


def _once_each(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row for each key of ``facts``; only rows whose key is there twice or more move."""
    doubled = stored(facts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "doubled")
    if doubled.isEmpty():
        return rows
    one = stored(rows.join(doubled, keys, "left_semi").dropDuplicates(keys), "once")
    return rows.join(doubled, keys, "left_anti").unionByName(one)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_max: int = GROUP_MAX, hashes: Hashes = window_hashes) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs``."""
    spark = docs.sparkSession
    keyed_docs, a, b = keyed(docs.select(F.col(doc_id), F.col(text)), doc_id, text)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = keyed_docs.select(F.col(a).alias("key_id"), F.col(b).alias("key_text"), raw.alias("raw"))
    key = F.struct("key_id", "key_text")
    facts = stored(rows.select("key_id", "key_text", F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha")), "facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(shuffle_partitions(spark), total // BUCKET_TEXT)
    texts = _once_each(rows, facts, ["key_id", "key_text"])
    # stored, so that the join reads two plain shuffles and adaptive execution can split a text with very many copies
    firsts = stored(facts.groupBy("sha").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "firsts")
    copy = F.coalesce(key != F.col("first"), F.lit(False))
    facts = stored(facts.join(firsts, "sha", "left").withColumn("copy", copy).drop("first"), "facts")
    lead = facts.where("not copy").select("key_id", "key_text").distinct()

    twice = _dealt(texts, n, False).groupBy("bucket").applyInArrow(lambda group: repeated(group, group_max), BY_DOCUMENT)
    wanted = twice.groupBy("key_id", "key_text").agg(F.collect_list("entries").alias("entries")).join(lead, ["key_id", "key_text"], "left_semi")
    once = lambda rows: texts.join(rows, ["key_id", "key_text"]).select("key_id", "key_text", "raw", "entries")
    marks = stored(_dealt(once(stored(wanted, "anchors")), n, True).groupBy("bucket").applyInArrow(lambda group: marked(group, hashes), MARKS), "marks")
    entries = marks.where("entries is not null").select("key_id", "key_text", "entries")
    if not marks.where("firsts is not null").isEmpty():
        entries = entries.unionByName(_marks_of_firsts(marks, texts))
    spans = entries.groupBy("key_id", "key_text").agg(F.collect_list("entries").alias("entries"))
    found = _cut(once(spans)).dropDuplicates(["key_id", "key_text"])

    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    out = facts.join(found, ["key_id", "key_text"], "left")
    return out.select(
        F.when(F.col("key_id") != NULL_ID, F.col("key_id")).alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
