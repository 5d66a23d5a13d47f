"""Fingerprints of texts by locally consistent parsing: coin tossing cuts phrases, and phrases of phrases, by content alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import staged
from .text import mixed, small_batches

SIGNATURES, LEAST_SPAN, CHUNK = 64, 8, 1 << 18
"""Names kept of a text; the shortest phrase that counts, in bytes; code points parsed together."""

_RUN = np.uint64(0xD6E8FEB86659FD93)
_PLACES = 64
_PLACE = mixed(np.arange(1, _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = mixed(_PLACE[:, None] + np.arange(256, dtype=np.uint64)).ravel()
"""A value for each byte at each place in a phrase. Phrases are shorter than 64 names: see ``landmarks``."""


def _tossed(wide: int) -> np.ndarray:
    """The next label for each pair (own * wide + left): twice the lowest bit's place in which they differ, plus the own bit there."""
    own, left = np.arange(wide)[:, None], np.arange(wide)[None, :]
    low = (own ^ left) & -(own ^ left)
    place = np.where(low, np.bitwise_count(low - 1), 8)
    return (2 * place + ((own & low) != 0)).astype(np.uint8).ravel()


_OF_BYTES, _OF_LABELS = _tossed(256), _tossed(128)


def landmarks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: at the first name of a text and at local maxima of labels, never leaving one name alone.

    ``names`` differ from their left neighbours within a text; ``first`` are the places of the texts' first names.
    Rounds of coin tossing turn names into labels below 6 that differ from their left neighbours', too, each set by a
    name and a few left of it. So a cut depends on some eight neighbouring names and on nothing else, and labels can
    rise and fall for some ten names at most before the next cut.
    """
    n = len(names)
    if names.dtype == np.uint8:
        key = names.astype(np.uint16) << 8
        key[1:] |= names[:-1]
        key[first] &= 0xFF00
        label, rounds = _OF_BYTES[key], 2
    else:
        low = np.empty_like(names)
        low[1:] = names[1:] ^ names[:-1]
        low[first] = names[first]
        low &= ~low + np.uint64(1)
        label, rounds = np.bitwise_count(low - np.uint64(1)), 3
        label <<= 1
        label += (names & low) != 0
        label &= 127
    for _ in range(rounds):
        key = label.astype(np.uint16) << 7
        key[1:] |= label[:-1]
        key[first] &= 0x3F80
        label = _OF_LABELS[key]
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    cut[1:] &= ~cut[:-1]
    cut[first[1:] - 1] = False
    cut[-1] = False
    cut[np.minimum(first + 1, n - 1)] = False
    cut[first] = True
    return np.flatnonzero(cut)


def _lengths(starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = end - starts[-1:]
    return out


def _phrases(names: np.ndarray, runs: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """A name for each phrase: a hash of its names in order, how often each is repeated, and their number."""
    size = _lengths(starts, len(names))
    place = np.arange(len(names), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    place &= _PLACES - 1
    value = _BYTE[(place << 8) | names] if names.dtype == np.uint8 else mixed(names + _PLACE[place])
    long, times = runs
    value[long] = mixed(value[long] + times.astype(np.uint64) * _RUN)
    return mixed(np.add.reduceat(value, starts) + size.astype(np.uint64))


def signatures(texts: list[str], least_span: int = LEAST_SPAN) -> list[np.ndarray]:
    """For each text the sorted 32-bit names of its phrases of all levels, ``least_span`` bytes or more long, and of the whole.

    All texts are parsed together, level by level: runs of one name count as one name with a number, landmarks cut what
    is left into phrases, and the phrases' names are the next level's text, until one name is left of each text.
    """
    out = [np.zeros(1, dtype=np.uint32)] * len(texts)
    coded = {i: t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts) if t}
    if not coded:
        return out
    size = np.array([len(c) for c in coded.values()])
    names = np.frombuffer(b"".join(coded.values()), dtype=np.uint8)
    owner, first = np.arange(len(size)), np.cumsum(size) - size
    span, kept = None, []
    while len(names):
        new = np.empty(len(names), dtype=bool)
        new[1:] = names[1:] != names[:-1]
        new[first] = True
        head = np.flatnonzero(new)
        times = _lengths(head, len(names))
        long = np.flatnonzero(times > 1)
        names = names[head]
        starts = landmarks(names, np.searchsorted(head, first))
        names = _phrases(names, (long, times[long]), starts)
        begun = head[starts]  # the first name of each phrase
        span = _lengths(begun, len(new)) if span is None else np.add.reduceat(span, begun)
        first = np.searchsorted(begun, first)
        count = _lengths(first, len(names))
        who = np.repeat(owner, count)
        single = np.repeat(count == 1, count)
        told = np.flatnonzero((span >= least_span) | single)
        kept.append((who[told].astype(np.uint64) << np.uint64(32)) | (names[told] >> np.uint64(32)))
        stay, alive = np.flatnonzero(~single), count > 1
        names, span, owner, count = names[stay], span[stay], owner[alive], count[alive]
        first = np.cumsum(count) - count
    keys = np.sort(np.concatenate(kept))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    edges = np.searchsorted(keys >> np.uint64(32), np.arange(len(size) + 1, dtype=np.uint64))
    low = keys.astype(np.uint32)
    for k, i in enumerate(coded):
        out[i] = low[edges[k]:edges[k + 1]]
    return out


def _chunks(texts: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` code points, one longer text alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def sketches(texts: list[str], keep: int = SIGNATURES) -> list[bytes]:
    """The ``keep`` smallest signatures of each text, four bytes each, by size."""
    return [s[:keep].astype(">u4").tobytes() for part in _chunks(texts) for s in signatures(part)]


def fingerprints(texts: list[str], keep: int = SIGNATURES) -> list[str]:
    """Sketches as hex digits."""
    return [s.hex() for s in sketches(texts, keep)]


def likeness(a: bytes | str, b: bytes | str, keep: int = SIGNATURES) -> float:
    """Share of the ``keep`` smallest signatures of both sketches or fingerprints together that are in both: an estimate of the sets' Jaccard similarity, exact if both have fewer."""
    if a == b:
        return 1.0
    wide = 4 if isinstance(a, bytes) else 8
    x, y = ({f[i:i + wide] for i in range(0, len(f), wide)} for f in (a, b))
    joint = sorted(x | y)[:keep]
    return sum(s in x and s in y for s in joint) / len(joint)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) of code points replaced by as many first ones of ``following``, or all."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_OUT = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], nexts: list[str], own: list[bytes], following: list[bytes]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, nexts)]
    prints = sketches(changed)
    return [(len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest(), a, e, likeness(a, e), likeness(a, b))
            for t, c, a, e, b in zip(texts, changed, own, prints, following)]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is ``edited`` of the text and the next row's. Rows follow each other by id, rows without id first;
    rows that repeat an id follow by a hash of their text, then by their place in the input. The last row's next is
    the first; a single row is its own next. A null text is empty; empty texts share one fingerprint. No rows: no rows.

    Texts move once, dealt by ranges of (id, hash, place), so neither a repeated id nor many copies of a text fill a
    task. Each task streams its sorted rows; the last one of a task needs the first one of the next, so a task also
    returns these two rows with their texts, and the pairs, one per task, are compared in a second small step. Memory
    of a task: a batch of rows and some 50 bytes for each byte of text parsed together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"), "text")
    dealt = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, {_OUT}, edge int, h bigint, place bigint, text string"
    fields = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, found: list[tuple], edge: int | None, keys: list[list], texts: list[str | None]) -> pa.RecordBatch:
            cells = list(zip(*found)) if found else [[]] * len(fields)
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, k) for c, k in zip(cells, kinds)], pa.array([edge] * n, pa.int32()),
                 *[pa.array(c, pa.int64()) for c in keys], pa.array(texts, pa.string())],
                ["id", *fields, "edge", "h", "place", "text"])

        def end(at: int, ids: pa.Array, keys: list, text: str, mark: bytes) -> pa.RecordBatch:
            return out(ids, [(len(text), None, mark, None, None, None)], at, [[k] for k in keys], [text])

        held = None  # the row whose next isn't known yet
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            keys = [batch.column(k).to_pylist() for k in ("h", "place")]
            marks = sketches(texts)
            if held is None:
                yield end(0, ids[:1], [k[0] for k in keys], texts[0], marks[0])
                known, seen, own = ids, texts, marks
            else:
                known, seen, own = pa.concat_arrays([held[0], ids]), [held[2], *texts], [held[3], *marks]
            done = len(seen) - 1
            if done:
                none = [None] * done
                yield out(known[:done], _compared(seen[:done], seen[1:], own[:done], own[1:]), None, [none, none], none)
            held = (ids[-1:], [k[-1] for k in keys], texts[-1], marks[-1])
        if held is not None:
            yield end(1, *held)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts, nexts, own, following = (batch.column(c).to_pylist() for c in ("text", "next_text", "fingerprint", "next_fingerprint"))
                found = zip(*_compared(texts, nexts, own, following))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(found, kinds)]], ["id", *fields])

    made = staged(dealt.mapInArrow(run, schema), "fingerprints")
    ends = made.where(F.col("edge").isNotNull())
    order = Window.orderBy("id", "h", "place", "edge")  # two rows per task
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = ends.select("*", *[F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"next_{c}") for c in ("text", "fingerprint")])
    tails = tails.where("edge = 1")
    last = tails.select("id", "text", "next_text", "fingerprint", "next_fingerprint").mapInArrow(pairs, f"id {id_type}, {_OUT}")
    columns = [F.col("id").alias(id_col), *[F.lower(F.hex(f)).alias(f) if k == pa.binary() else F.col(f) for f, k in zip(fields, kinds)]]
    return made.where(F.col("edge").isNull()).select(*columns).unionByName(last.select(*columns))
