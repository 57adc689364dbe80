"""Suffix-array dedup by longest-previous-factor arrays, over all documents.

A byte goes if a string of LENGTH bytes covering it also starts earlier. Any two
equal strings of that length share their anchor, the smallest GRAM-byte hash in
them (leftmost on a tie), at the same place. So occurrences can only match where
anchors are equal, and no pair of texts has to be compared as a whole:

1. Each task finds the anchors of its texts. Per anchor it hashes the context,
   all bytes of the strings that can have this anchor. Within a task, of equal
   contexts only the first occurrence goes on; the others are removed at once.
   This is a pre-aggregation, so a passage that every document holds sends one
   row per task. Where a task sees several contexts of an anchor, one goes on to
   meet other tasks', marked; the others are asked for anyway and dealt apart, so
   that a common line with many surroundings is no single task's load.
2. Anchors are dealt by hash. Of equal contexts all but the first are removed.
   Where one anchor has different contexts, at the ends of repeated passages or
   by chance, the first of each is asked for.
3. Those contexts are cut out of their texts. A string reaches at least half of
   what it has beside the anchor to one side of it, so contexts meet by anchor and
   that side's bytes; one that meets none is done. A suffix array
   over them, longest common prefixes, and the previous and next smaller
   positions in suffix order give the longest previous factor of each string
   start; where it reaches LENGTH, the string goes. Contexts of an anchor with
   more than LARGEST of them are dealt into parts, each with an array of its own;
   strings that are the first of their part meet the other parts' by a hash of
   the string, one row a part at most, and all but the first go.
4. Removed spans meet their texts, are merged, and the rest is hashed.

The order of positions is (doc_id, start). Strings are judged on the input.

Defined results: a null text is empty; a text shorter than LENGTH stays; a very
long text is scanned in segments that overlap, and its spans, a list no longer
than the text, meet it whole; ids may be of any type that can be ordered; rows
that repeat an id and a text are judged as one document; rows that repeat an id
with other texts are documents of their own, which come in the order of their
texts' SHA-256; documents without an id come before all others, in that order,
too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import arrow_map, materialise, mix, powers, prefix_sums, prepare

LENGTH = 100
GRAM = 40
#: Bytes of text handled at once, occurrences kept before they are sent on, and context bytes in one suffix array.
SEGMENT = 1 << 21
HELD = 1 << 20
ARRAY_BYTES = 1 << 19
#: Contexts of an anchor beyond which they are dealt into parts of about this many.
LARGEST = 1 << 14
#: Rows a task may have on the built side of a hash join.
MOST_BUILT = 1 << 20


def _windows(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each string of `length` bytes in the buffer, and the gram hashes."""
    n = len(buf)
    sums = prefix_sums(buf)
    _, down = powers(n + 1)
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    mask = np.uint64((1 << 23) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:  # sliding minimum over `width` grams, by doubling
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & mask).astype(np.int64), grams


def occurrences(raws: list[bytes], ids: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All anchors of the texts: anchor and context hashes, id, position, and how far before it strings with it start (lo >= hi)."""
    reach = length - gram
    out: dict[str, list] = {k: [] for k in ("anchor", "context", "id", "pos", "lo", "hi")}

    def scan(parts: list[tuple[int, int, int, int]]) -> None:
        # part: text, first byte in the buffer, first and past-last string start that count here
        buf = np.frombuffer(b"".join(raws[t][b : min(len(raws[t]), stop + length - 1 + reach)] for t, b, _, stop in parts), dtype=np.uint8)
        if len(buf) < length:
            return
        lengths = np.array([min(len(raws[t]), stop + length - 1 + reach) - b for t, b, _, stop in parts])
        begin = np.concatenate(([0], np.cumsum(lengths)))
        anchor_at, grams = _windows(buf, length, gram)
        part_of = np.repeat(np.arange(len(parts)), lengths)
        good = part_of[: len(anchor_at)] == part_of[length - 1 :]
        local = np.arange(len(anchor_at)) - begin[part_of[: len(anchor_at)]] + np.array([b for _, b, _, _ in parts])[part_of[: len(anchor_at)]]
        good &= (local >= np.array([p[2] for p in parts])[part_of[: len(anchor_at)]]) & (local < np.array([p[3] for p in parts])[part_of[: len(anchor_at)]])
        starts = np.flatnonzero(good)
        if not len(starts):
            return
        at = anchor_at[starts]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        pos, lo, hi = at[first], at[first] - starts[first], at[first] - starts[last]
        part = part_of[pos]
        left = pos - lo  # the context: every byte of the strings that have this anchor here
        right = pos - hi + length
        sums = prefix_sums(buf)
        _, down = powers(len(buf) + 1)
        context = mix((sums[right] - sums[left]) * down[left] ^ (lo.astype(np.uint64) << np.uint64(48)) ^ (hi.astype(np.uint64) << np.uint64(56)))
        text_of = np.array([p[0] for p in parts])[part]
        out["anchor"].append(mix(grams[pos] ^ np.uint64(0x5851F42D4C957F2D)))
        out["context"].append(context)
        out["id"].append(ids[text_of])
        out["pos"].append(pos - begin[part] + np.array([p[1] for p in parts])[part])
        out["lo"].append(lo)
        out["hi"].append(hi)

    parts, size = [], 0
    for t, raw in enumerate(raws):
        strings = len(raw) - length + 1
        for a in range(0, max(0, strings), SEGMENT):
            b = max(0, a - reach)
            parts.append((t, b, a, min(strings, a + SEGMENT)))
            size += min(strings, a + SEGMENT) - b + length
            if size >= SEGMENT:
                scan(parts)
                parts, size = [], 0
    if parts:
        scan(parts)
    kinds = {"anchor": np.uint64, "context": np.uint64}
    return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in out.items()}


def merged(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each id."""
    if not len(ids):
        return ids, starts, ends
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    group = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
    span = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + group * span) - group * span
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return ids[first], starts[first], reach[np.append(first[1:], len(ids)) - 1]


_ROW = "kind byte, deal long, anchor long, context long, id long, pos long, lo long, hi long"
_ROW_NAMES = ["kind", "deal", "anchor", "context", "id", "pos", "lo", "hi"]
#: A removed span (from pos to lo), an occurrence, and one whose anchor has several contexts.
_SPAN, _SEEN, _MANY = 0, 1, 2
#: A string that is the first of its part: anchor and context are the group's key and the string's hash, pos its start.
_STRING = 3


def _rows(kind, deal, anchor, context, ids, pos, lo, hi) -> pa.RecordBatch:
    n = len(ids)
    cols = [np.full(n, kind, dtype=np.int8), deal.view(np.int64), anchor.view(np.int64), context.view(np.int64), *(np.asarray(c, dtype=np.int64) for c in (ids, pos, lo, hi))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_ROW_NAMES)


def _spans(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    ids, starts, ends = merged(ids, starts, ends)
    spread = mix(ids.astype(np.uint64) ^ starts.astype(np.uint64))
    none = np.zeros(len(ids), np.uint64)
    return _rows(_SPAN, spread, none, none, ids, starts, ends, np.zeros(len(ids), np.int64))


def _first_and_rest(o: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their anchor and context, and rows that come later elsewhere (not the same place again)."""
    if not len(o["id"]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((o["pos"], o["id"], o["context"], o["anchor"]))
    a, c, i, p = (o[k][order] for k in ("anchor", "context", "id", "pos"))
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    again = np.concatenate(([False], (i[1:] == i[:-1]) & (p[1:] == p[:-1]))) & ~fresh
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    again |= (i == i[head]) & (p == p[head]) & ~fresh
    return order[fresh], order[~fresh & ~again]


def dealt(anchor: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and keys of a task's first occurrences, in the order of anchors: the first context of an anchor goes by the anchor, others by both."""
    head = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)]
    many = ~head
    many[:-1] |= ~head[1:]
    return np.where(many, _MANY, _SEEN).astype(np.int8), np.where(head, anchor, mix(anchor ^ mix(context)))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def send():
            o = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            first, rest = _first_and_rest(o)
            if len(rest):
                yield _spans(o["id"][rest], o["pos"][rest] - o["lo"][rest], o["pos"][rest] - o["hi"][rest] + length)
            kind, deal = dealt(o["anchor"][first], o["context"][first])
            for k in range(0, len(first), 1 << 16):
                f = first[k : k + (1 << 16)]
                yield _rows(kind[k : k + (1 << 16)], deal[k : k + (1 << 16)], *(o[n][f] for n in ("anchor", "context", "id", "pos", "lo", "hi")))

        for batch in batches:
            raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found = occurrences(raws, batch.column("id").to_numpy(), length, gram)
            held.append(found)
            count += len(found["id"])
            if count >= HELD:
                yield from send()
                held, count = [], 0
        if count:
            yield from send()

    return docs.mapInArrow(run, _ROW)


def _runs_of(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches sorted by a key, cut only between its values."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: (batch.column(n).to_numpy() if n != "bytes" else np.array(batch.column(n).to_pylist(), dtype=object)) for n in batch.schema.names}
        change = np.flatnonzero(cols[by][1:] != cols[by][:-1]) + 1
        if held and held[0][by][-1] == cols[by][0] and not len(change):
            held.append(cols)
            continue
        cut = int(change[-1]) if len(change) else 0
        if held or cut:
            ready = [*held, {k: v[:cut] for k, v in cols.items()}]
            yield {k: np.concatenate([r[k] for r in ready]) for k in cols}
        held = [{k: v[cut:] for k, v in cols.items()}]
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def settled(rows: DataFrame, length: int) -> DataFrame:
    """From anchors of all tasks: spans (kind 0), and contexts that must be compared (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o in _runs_of(batches, "deal"):
            span = o["kind"] == _SPAN
            if span.any():
                yield _spans(o["id"][span], o["pos"][span], o["lo"][span])
            o = {k: v[~span] for k, v in o.items()}
            if not len(o["id"]):
                continue
            first, rest = _first_and_rest(o)
            if len(rest):
                yield _spans(o["id"][rest], o["pos"][rest] - o["lo"][rest], o["pos"][rest] - o["hi"][rest] + length)
            f = first[several(o["anchor"], o["kind"], first)]
            if len(f):
                yield _rows(_SEEN, o["deal"][f], *(o[n][f] for n in ("anchor", "context", "id", "pos", "lo", "hi")))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, _ROW)


def several(anchor: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the first occurrences (sorted by anchor) have an anchor with several contexts, here or by its mark."""
    names, group = np.unique(anchor, return_inverse=True)
    marked = np.zeros(len(names), dtype=bool)
    marked[group[kind == _MANY]] = True
    return marked[group[first]] | (np.bincount(group[first], minlength=len(names))[group[first]] > 1)


def sides(anchor: int, pos: int, lo: int, hi: int, raw: bytes, length: int, gram: int) -> list[tuple]:
    """Keys, reaches and bytes of the two kinds of strings around an anchor: those that reach far to its left, and to its right."""
    half, out = (length - gram) // 2, []
    seed = anchor & 0xFFFFFFFFFFFFFFFF
    for a, b, beside in ((lo, max(hi, half), (pos - half, pos)), (min(lo, half - 1), hi, (pos + gram, pos + gram + half))):
        if a >= b:
            key = xxhash.xxh64_intdigest(raw[beside[0] : beside[1]], seed) >> 1
            out.append((key, pos, a, b, raw[pos - a : pos - b + length]))
    return out


def _dealt_part(key: int, part: int) -> int:
    """Where a group's part is dealt to; a negative part is the whole group."""
    return key if part < 0 else xxhash.xxh64_intdigest(part.to_bytes(4, "little"), key) >> 1


# --- suffix array -------------------------------------------------------------


def suffix_ranks(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, to at least `depth`; -1 stands after the end."""
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, have, n = [rank.astype(np.int64)], 1, len(symbols)
    while have < depth:
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: max(0, n - have)] = ranks[-1][have:]
        key = ranks[-1] * (n + 1) + nxt + 1
        _, rank = np.unique(key, return_inverse=True)
        ranks.append(rank.astype(np.int64))
        have *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, up to the depth of the ranks."""
    n = len(ranks[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        step = same * (1 << level)
        a, b, out = a + step, b + step, out + step
    return out


def longest_previous(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry in suffix order.

    order: text positions in suffix order. prefix[i]: common prefix of entries
    i - 1 and i (0 for the first). The previous and the next entry with a
    smaller position bound it; both are found by jumps over larger ones.
    """
    n = len(order)

    def one_side(pos: np.ndarray, shared: np.ndarray) -> np.ndarray:
        back, low = np.arange(n) - 1, shared.copy()
        open_ = np.flatnonzero(back >= 0)
        while len(open_):
            open_ = open_[pos[back[open_]] > pos[open_]]
            if not len(open_):
                break
            b = back[open_]
            low[open_] = np.minimum(low[open_], low[b])
            back[open_] = back[b]
            open_ = open_[back[open_] >= 0]
        return np.where(back >= 0, low, 0)

    ahead = one_side(order, prefix)
    shifted = np.append(prefix[1:], 0)[::-1]
    behind = one_side(order[::-1], shifted)[::-1]
    return np.maximum(ahead, behind)


def earlier_strings(anchor: np.ndarray, ids: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and start of each string of the contexts, and whether it also starts earlier with the same anchor."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    _, run = np.unique(anchor, return_inverse=True)
    symbols = np.zeros(int(begin[-1]), dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[begin[1:] - 1] = False
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    symbols[inside] = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    symbols[inside] += 256 * run[owner[inside]] + len(contexts)  # strings of different anchors never match
    symbols[~inside] = np.arange(len(contexts))  # nor does anything across the end of a context
    ranks = suffix_ranks(symbols, length)
    # The starts that have this anchor: lo ... hi bytes before it; a context begins lo bytes before it.
    per = lo - hi + 1
    who = np.repeat(np.arange(len(contexts)), per)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(per) - per, per)
    at, start = begin[who] + offset, pos[who] - lo[who] + offset
    place = np.empty(len(who), dtype=np.int64)
    place[np.lexsort((start, ids[who]))] = np.arange(len(who))
    order = np.lexsort((at, ranks[-1][at]))
    shared = np.zeros(len(who), dtype=np.int64)
    shared[1:] = common_prefixes(ranks, at[order[:-1]], at[order[1:]])
    hit = np.zeros(len(who), dtype=bool)
    hit[order[longest_previous(place[order], shared) >= length]] = True
    return who, start, hit


def _places(o: dict[str, np.ndarray]) -> np.ndarray:
    """One row of each group, id and place: rows that repeat an id and a text bring their contexts repeatedly."""
    order = np.lexsort((o["hi"], o["lo"], o["pos"], o["id"], o["anchor"], o["deal"]))
    new = np.zeros(len(order), dtype=bool)
    for k in ("deal", "anchor", "id", "pos", "lo", "hi"):
        c = o[k][order]
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return order[new]


def _strings(o: dict[str, np.ndarray], who: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of strings by their hash."""
    for k in range(0, len(who), 1 << 16):
        w, at = who[k : k + (1 << 16)], start[k : k + (1 << 16)]
        off = at - o["pos"][w] + o["lo"][w]
        names = np.fromiter((xxhash.xxh64_intdigest(o["bytes"][c][b : b + length]) for c, b in zip(w.tolist(), off.tolist())), dtype=np.uint64, count=len(w))
        keys, none = o["anchor"][w], np.zeros(len(w), np.int64)
        yield _rows(_STRING, mix(names ^ mix(keys.astype(np.uint64))), keys, names, o["id"][w], at, none, none)


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Spans from contexts with their bytes, dealt by anchor and part; of contexts in parts, also the strings first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o in _runs_of(batches, "deal"):
            o = {k: v[f] for f in [_places(o)] for k, v in o.items()}
            alone = o["parted"] == 0
            same = o["deal"][1:] == o["deal"][:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            o = {k: v[~alone] for k, v in o.items()}
            if not len(o["deal"]):
                continue
            edges = np.concatenate(([0], np.flatnonzero(o["deal"][1:] != o["deal"][:-1]) + 1, [len(o["deal"])]))
            size = np.concatenate(([0], np.cumsum([len(b) + 1 for b in o["bytes"]])))
            i = 0
            while i < len(edges) - 1:  # whole anchors, until an array is full
                j = i + 1
                while j < len(edges) - 1 and size[edges[j + 1]] - size[edges[i]] <= ARRAY_BYTES:
                    j += 1
                g = {k: v[edges[i] : edges[j]] for k, v in o.items()}
                who, start, hit = earlier_strings(g["anchor"], g["id"], g["pos"], g["lo"], g["hi"], list(g["bytes"]), length)
                if hit.any():
                    yield _spans(g["id"][who[hit]], start[hit], start[hit] + length)
                more = ~hit & (g["parted"][who] != 0)
                yield from _strings(g, who[more], start[more], length)
                i = j

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, _ROW)


def first_strings(rows: DataFrame, length: int) -> DataFrame:
    """The spans that come in, and those of strings that an earlier part has, too; a string comes once a part at most.

    Spans pass through, so that nothing is written in between and the texts' exchange serves both joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o in _runs_of(batches, "deal"):
            span = o["kind"] == _SPAN
            if span.any():
                yield _spans(o["id"][span], o["pos"][span], o["lo"][span])
            o = {k: v[~span] for k, v in o.items()}
            _, rest = _first_and_rest(o)
            if len(rest):
                yield _spans(o["id"][rest], o["pos"][rest], o["pos"][rest] + length)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, _ROW)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """id, spans array<struct<a, b>> of the texts (id long, text) that lose bytes."""
    found = materialise(settled(anchors(texts, length, gram), length), "anchors")
    seen = found.filter(F.col("kind") == _SEEN).withColumn("part", F.lit(-1))
    hot = seen.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > largest)
    hot = materialise(hot.select(F.col("anchor").alias("hot_anchor"), F.ceil(F.col("n") / largest).cast("int").alias("parts")), "hot-anchors")
    any_hot = not hot.isEmpty()
    if any_hot:
        part = F.coalesce(F.pmod(F.xxhash64("id", "pos"), F.col("parts")).cast("int"), F.lit(-1))
        seen = seen.join(hot, seen["anchor"] == hot["hot_anchor"], "left").withColumn("part", part)
    asked = seen.groupBy("id").agg(F.collect_list(F.struct("anchor", "pos", "lo", "hi", "part")).alias("asked"))
    held = hashed(asked, found).join(texts.withColumnRenamed("id", "text_id"), F.col("id") == F.col("text_id")).select("id", "text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["deal", "parted", "anchor", "id", "pos", "lo", "hi", "bytes"]
        for batch in batches:
            for doc, text, asked in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows = [(_dealt_part(k, a["part"]), int(a["part"] >= 0), k, doc, p, lo, hi, beside) for a in asked if a["pos"] - a["hi"] + length <= len(raw) for k, p, lo, hi, beside in sides(a["anchor"], a["pos"], a["lo"], a["hi"], raw, length, gram)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    contexts = held.mapInArrow(cut, "deal long, parted long, anchor long, id long, pos long, lo long, hi long, bytes binary")
    spans = compared(contexts, length)
    if any_hot:
        spans = first_strings(spans, length)
    spans = found.filter(F.col("kind") == _SPAN).unionAll(spans)
    return hashed(spans.groupBy("id").agg(F.collect_list(F.struct(F.col("pos").alias("a"), F.col("lo").alias("b"))).alias("spans")), found)


def hashed(side: DataFrame, found: DataFrame) -> DataFrame:
    """The side as the built one of a hash join, which spares sorting the texts, where a task's share of `found` is small; else a sorted join."""
    n = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if found.count() <= MOST_BUILT * n else side


def remove_spans(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes that stay, and how many bytes and maximal runs went."""
    if not spans:
        return raw, 0, 0
    a = np.array([s["a"] for s in spans], dtype=np.int64)
    b = np.minimum(np.array([s["b"] for s in spans], dtype=np.int64), len(raw))
    a, b = a[a < b], b[a < b]
    _, a, b = merged(np.zeros(len(a), dtype=np.int64), a, b)
    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
    return kept, int((b - a).sum()), len(a)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (long, a document's place in the order) and text of every row, and its doc_id where that is not the place itself.

    Where ids are whole numbers, none null and none twice, they are the places. Else documents are pairs of id
    and text, sorted by id (null first) and SHA-256 of the text, and numbered in that order.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if isinstance(named.schema["doc_id"].dataType, IntegralType):
        times = named.groupBy("doc_id").agg(F.count("*").alias("n"))
        if times.filter("n > 1 or doc_id is null").isEmpty():
            return named.select(F.col("doc_id").cast("long").alias("id"), "text")
    marked = named.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    ordered = marked.select(F.col("doc_id").alias("own"), F.col("digest").alias("own_digest")).distinct().orderBy(F.col("own").asc_nulls_first(), "own_digest")
    places = materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "places")
    return marked.join(places, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest"))).select("id", "doc_id", "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; the kept bytes, if asked for."""
    prepare(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    spans = repeated_spans(texts.select("id", "text"), length, gram, largest).withColumnRenamed("id", "span_id")
    kind = dict(docs.dtypes)[id_col]
    named = "doc_id" if "doc_id" in texts.columns else "id"

    def run(batch: pa.RecordBatch) -> dict:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        done = [remove_spans(r, s or []) for r, s in zip(raws, batch.column("spans").to_pylist())]
        out = {
            "doc_id": batch.column(named), "n_bytes": [len(r) for r in raws],
            "n_removed": [d[1] for d in done], "n_spans": [d[2] for d in done], "kept_sha256": [hashlib.sha256(d[0]).hexdigest() for d in done],
        }
        return out | ({"kept_bytes": [d[0] for d in done]} if keep_bytes else {})

    joined = texts.join(spans, texts["id"] == spans["span_id"], "left").select(F.col(named).cast(kind).alias(named), "text", "spans")  # both joins exchange the same columns of the texts, so they share it
    return arrow_map(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if keep_bytes else ""))
