"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
found by the forward algorithm; a text's is the product over its words. The
probabilities are learned by expectation-maximisation (forward and backward)
from words of labelled rows. Scoring runs over the distinct words of a few
megabytes of text at a time, all positions of all words at once in numpy.

Learning reads a sample of at most about TRAIN_ROWS rows a language, chosen by
a hash of the id; scoring reads every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; a
word of any length is summed over all its segmentations; rows without an id are
not held out, are learned from, and are sampled by their text; rows repeated in
full are scored alike; ties go to the language first in code point order; with
no labelled row every text is `und`; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, arrow_rows, bucket_of, materialise, mix, powers, prefix_sums, prepare

TRAIN_ROWS = 3000
MODULUS, HELD_OUT = 4, 2
ROUNDS = 3
#: Words up to so many bytes are summed side by side, longer ones each by itself. Sums are scaled by SCALE a byte, so that none runs out of range.
WORD_BYTES = 64
SCALE = 8192.0
#: A character outside the vocabulary has this probability in any language.
UNKNOWN = 1e-8
SMOOTHING = 0.01
#: Words whose scores a worker keeps.
CACHED = 250_000
UND = "und"
#: The pipeline keeps texts with at least this score.
LEAST_SCORE = 0.5

_NO_WORD = re.compile(r"[\W\d_]+")
#: Word start in the vocabulary.
MARK = "▁"


class Index:
    """Finds pieces by hash: a wide table of first candidates, and a narrow one of those whose place was taken."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, firsts: np.ndarray):
        #: Which first bytes the pieces of a size have; few sizes beyond 16 bytes have any.
        self.leads = np.zeros((int(sizes.max(initial=4)) + 1, 256), dtype=bool)
        self.leads[sizes, firsts] = True
        self.hashes, self.sizes, self.longest = hashes, sizes, int(sizes.max(initial=4))
        self.wide = np.zeros(1 << 22, dtype=np.int32)
        at = (hashes & np.uint64((1 << 22) - 1)).astype(np.int64)
        self.wide[at] = np.arange(len(hashes))
        lost = np.flatnonzero(self.wide[at] != np.arange(len(hashes)))
        for bits in range(12, 22):
            for shift in range(22, 63 - bits):
                place = (hashes[lost] >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
                if len(np.unique(place)) == len(lost):
                    self.shift, self.narrow = np.uint64(shift), np.zeros(1 << bits, dtype=np.int32)
                    self.narrow[place] = lost
                    return
        raise ValueError("the vocabulary's hashes clash")

    def find(self, h: np.ndarray, size: int) -> np.ndarray:
        """The piece of each hash and size in bytes, or -1."""
        i = self.wide[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
        hit = self.hashes[i] == h
        j = self.narrow[(h >> self.shift).astype(np.int64) & (len(self.narrow) - 1)]
        other = self.hashes[j] == h
        found = np.where(hit, i, np.where(other, j, -1))
        return np.where(self.sizes[found] == size, found, -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Index:
    """The vocabulary's lower-case letter pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        body = piece.removeprefix(MARK)
        if not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unknown(i) and (body.isalpha() and body == body.lower() or piece == MARK):
            found.add(piece.replace(MARK, " ").encode())
    pieces = sorted(found)
    hashes = np.array([_hash_of(p) for p in pieces], dtype=np.uint64)
    order = np.argsort(hashes)
    return Index(hashes[order], np.array([len(pieces[i]) for i in order]), np.array([pieces[i][0] for i in order]))


def _hash_of(raw: bytes) -> np.uint64:
    sums = prefix_sums(np.frombuffer(raw, dtype=np.uint8))
    return mix(np.array([sums[-1]]) ^ (np.uint64(len(raw)) << np.uint64(40)))[0]


def letters(text: str | None) -> bytes:
    """The letter runs of a text, lower case, each after a space."""
    if not text:
        return b""
    rest = _NO_WORD.sub(" ", text.lower())
    if not rest.replace(" ", "").isalpha():  # signs that count as alphanumeric but are no letters: ½, ², Ⅳ
        rest = "".join([c if c.isalpha() else " " for c in rest])
    return (" " + rest).encode("utf-8", "ignore").rstrip()


def lattice(block: np.ndarray, index: Index) -> dict[tuple[int, int], np.ndarray]:
    """For words of equal length (rows of bytes): piece of each row at (start, end); -1 none, -2 an unknown character."""
    n, width = block.shape
    flat = np.ascontiguousarray(block).reshape(-1)
    sums = prefix_sums(flat)
    _, down = powers(len(flat) + 1)
    at = np.arange(n) * width
    lead = block
    chars = np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))
    found = {}
    for start in range(width):
        for end in range(start + 1, min(width, start + index.longest) + 1):
            size = end - start
            if size > 4 and not index.leads[size][block[:, start]].any():
                continue
            h = mix((sums[at + end] - sums[at + start]) * down[at + start] ^ (np.uint64(size) << np.uint64(40)))
            piece = index.find(h, size)
            if size <= 4:
                piece[(piece < 0) & (chars[:, start] == size)] = -2
            if (piece != -1).any():
                found[start, end] = piece
    return found


def forward(grid: dict, width: int, n: int, table: np.ndarray) -> np.ndarray:
    """Sums over segmentations of all prefixes, SCALE a byte: (n, width + 1, languages). The table's last two rows are unknown and none."""
    alpha = np.zeros((n, width + 1, table.shape[1]))
    alpha[:, 0] = 1
    for (start, end), piece in sorted(grid.items(), key=lambda e: e[0][1]):
        alpha[:, end] += alpha[:, start] * (table[piece] * SCALE ** (end - start))
    return alpha


def backward(grid: dict, width: int, n: int, table: np.ndarray) -> np.ndarray:
    beta = np.zeros((n, width + 1, table.shape[1]))
    beta[:, width] = 1
    for (start, end), piece in sorted(grid.items(), key=lambda e: -e[0][0]):
        beta[:, start] += (table[piece] * SCALE ** (end - start)) * beta[:, end]
    return beta


def long_edges(raw: bytes, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece (-2 unknown) of all pieces in one word, by end."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    sums, n = prefix_sums(buf), len(buf)
    _, down = powers(n + 1)
    chars = np.where(buf < 0x80, 1, np.where(buf < 0xC0, 0, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4))))
    found = []
    for size in range(1, min(n, index.longest) + 1):
        at = np.arange(n - size + 1)
        piece = index.find(mix((sums[at + size] - sums[at]) * down[at] ^ (np.uint64(size) << np.uint64(40))), size)
        if size <= 4:
            piece[(piece < 0) & (chars[at] == size)] = -2
        hit = at[piece != -1]
        found.append((hit, hit + size, piece[hit]))
    start, end, piece = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order]


def long_sums(raw: bytes, table: np.ndarray, index: Index, both: bool = False):
    """Log probability of one word of any length, by language; with `both`, also each edge's piece and expected number of uses.

    Positions are met one after another; each is rescaled by its largest value, whose logs are kept.
    """
    n, k = len(raw), table.shape[1]
    start, end, piece = long_edges(raw, index)
    p = table[piece]
    cuts = np.searchsorted(end, np.arange(n + 2))
    alpha, shift = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
    alpha[0], shift[0] = 1.0, 0.0

    def gather(value, logs, other, q):
        """One position from its neighbours: the sum of value * q, scaled to a largest of one."""
        top = logs[other].max(axis=0)
        if not np.isfinite(top).any():
            return None
        with np.errstate(invalid="ignore"):
            total = (value[other] * q * np.exp(np.where(np.isfinite(top), logs[other] - top, -np.inf))).sum(axis=0)
        return total, top

    def settle(value, logs, at, found):
        if found is not None:
            total, top = found
            good = total > 0
            value[at] = good
            logs[at] = np.where(good, top + np.log(np.where(good, total, 1.0)), -np.inf)

    for at in range(1, n + 1):
        a, b = cuts[at], cuts[at + 1]
        if b > a:
            settle(alpha, shift, at, gather(alpha, shift, start[a:b], p[a:b]))
    if not both:
        return shift[n]
    order = np.argsort(start, kind="stable")
    firsts = np.searchsorted(start[order], np.arange(n + 2))
    beta, back = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
    beta[n], back[n] = 1.0, 0.0
    for at in range(n - 1, -1, -1):
        rows = order[firsts[at] : firsts[at + 1]]
        if len(rows):
            settle(beta, back, at, gather(beta, back, end[rows], p[rows]))
    with np.errstate(divide="ignore"):
        uses = np.exp(shift[start] + np.log(p) + back[end] - shift[n])
    return shift[n], piece, uses


def _blocks(words: list[bytes]):
    """Words of equal length, each after a space, as arrays of bytes, and where they come from; the long ones are left out."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= WORD_BYTES]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        width = int(lengths[rows[0]]) if len(rows) else 0
        step = max(1, (1 << 21) // (width * width + 1))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, width, np.frombuffer(b"".join([b" " + words[i] for i in part]), dtype=np.uint8).reshape(len(part), width)


def _long(words: list[bytes]) -> list[int]:
    return [k for k, w in enumerate(words) if len(w) >= WORD_BYTES]


def word_scores(words: list[bytes], table: np.ndarray, path: str) -> np.ndarray:
    """Natural log probability of each word in each language."""
    index = vocabulary(path)
    out = np.zeros((len(words), table.shape[1]))
    for rows, width, block in _blocks(words):
        out[rows] = np.log(forward(lattice(block, index), width, len(rows), table)[:, width]) - width * np.log(SCALE)
    for k in _long(words):
        out[k] = long_sums(b" " + words[k], table, index)
    return out


def _full_table(probs: np.ndarray) -> np.ndarray:
    k = probs.shape[1]
    return np.vstack([probs, np.full((1, k), UNKNOWN), np.zeros((1, k))])


class Model:
    """Languages and their piece probabilities; scores of the words met last are kept, CACHED at most."""

    def __init__(self, languages: list[str], probs: np.ndarray, vocab: str):
        self.languages, self.table, self.vocab = languages, _full_table(probs), vocab
        self.known: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(languages)))

    def codes(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row of `logs` for each word, and words per text; new words are scored."""
        if len(self.known) > CACHED:
            self.known, self.logs = {}, self.logs[:0]
        before = len(self.known)
        place, codes, per = self.known.setdefault, [], []
        for raw in raws:
            parts = raw.split()
            per.append(len(parts))
            codes += [place(w, len(self.known)) for w in parts]
        new = [w for w, _ in zip(reversed(self.known), range(len(self.known) - before))][::-1]
        if new:
            self.logs = np.concatenate([self.logs, word_scores(new, self.table, self.vocab)])
        return np.array(codes, dtype=np.int64), np.array(per, dtype=np.int64)

    def posteriors(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language for each text, and its number of words."""
        codes, per = self.codes(raws)
        owner = np.repeat(np.arange(len(raws)), per)
        total = np.stack([np.bincount(owner, weights=self.logs[codes, k], minlength=len(raws)) for k in range(self.logs.shape[1])], axis=1)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True), per


def _runs(raws: list[bytes]):
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) < CHUNK_BYTES):
            size += len(raws[j])
            j += 1
        yield i, j
        i = j


def fit(labelled: DataFrame, vocab: str, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """labelled: id, text, lang. The sample is chosen by a hash of the id, so it is spread over all rows."""
    spark = labelled.sparkSession
    prepare(spark)
    known = labelled.filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    n_pieces = len(vocabulary(vocab).sizes)
    if not languages:
        return Model([], np.ones((n_pieces, 0)), vocab)
    part = F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(min(1.0, train_rows / sizes[g])))])
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text"), F.lit("")), F.lit(7))
    chance = F.pmod(key, F.lit(1 << 40)) / float(1 << 40)
    sample = known.filter(chance < part[F.col("lang")]).select("text", "lang")

    def count(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for w, n in Counter(letters(text).split()).items():
                seen[lang, w] += n
        return {"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}

    words = materialise(arrow_map(sample, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    probs = np.full((n_pieces, len(languages)), 1.0 / n_pieces)
    for _ in range(rounds):
        table = spark.sparkContext.broadcast(_full_table(probs))

        def expect(batch: pa.RecordBatch, table=table) -> dict:
            index = vocabulary(vocab)
            langs = np.array(batch.column("lang").to_pylist())
            out = {"lang": [], "piece": [], "n": []}
            for g in np.unique(langs):
                mine = np.flatnonzero(langs == g)
                column = np.ascontiguousarray(table.value[:, languages.index(g)])[:, None]
                own = batch.column("word").take(pa.array(mine)).to_pylist()
                times = batch.column("n").to_numpy()[mine]
                total = np.zeros(len(column))
                for k in _long(own):
                    _, piece, uses = long_sums(b" " + own[k], column, index, both=True)
                    total += np.bincount(piece % len(column), weights=uses[:, 0] * times[k], minlength=len(column))
                for rows, width, block in _blocks(own):
                    grid = lattice(block, index)
                    a, b = forward(grid, width, len(rows), column)[..., 0], backward(grid, width, len(rows), column)[..., 0]
                    weight = times[rows] / a[:, width]
                    for (start, end), piece in grid.items():
                        total += np.bincount(piece % len(column), weights=a[:, start] * (column[piece, 0] * SCALE ** (end - start)) * b[:, end] * weight, minlength=len(column))
                hit = np.flatnonzero(total[:-2])
                out["lang"] += [str(g)] * len(hit)
                out["piece"] += hit.tolist()
                out["n"] += total[hit].tolist()
            return out

        with arrow_rows(spark, 20_000):  # words, not texts
            counted = arrow_map(words, expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most vocabulary x languages rows
        counts = np.full_like(probs, SMOOTHING)
        column = {g: k for k, g in enumerate(languages)}
        np.add.at(counts, (counted.column("piece").to_numpy(), np.array([column[g] for g in counted.column("lang").to_pylist()], dtype=np.int64)), counted.column("n").to_numpy())
        probs = counts / counts.sum(axis=0)
        table.unpersist()
    return Model(languages, probs, vocab)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. Only the text is looked at."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        raws = [letters(t) for t in batch.column("text").to_pylist()]
        langs, scores = [UND] * len(raws), np.zeros(len(raws))
        for i, j in _runs(raws) if m.languages else ():
            p, per = m.posteriors(raws[i:j])
            best = p.argmax(axis=1)
            for k in np.flatnonzero(per):
                langs[i + k], scores[i + k] = m.languages[best[k]], p[k, best[k]]
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    return F.coalesce(bucket_of(id_col, MODULUS) == HELD_OUT, F.lit(False))


def learning_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def identified(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(learning_rows(docs, id_col, text_col, lang_col), vocab)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocab: str, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with at least the score, with the columns they came with."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(learning_rows(docs, id_col, text_col, lang_col), vocab))

    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        raws = [letters(t) for t in batch.column(place).to_pylist()]
        keep = np.zeros(len(raws), dtype=bool)
        for i, j in _runs(raws) if m.languages else ():
            p, per = m.posteriors(raws[i:j])
            keep[i:j] = (per > 0) & (p.max(axis=1) >= least_score)
        return batch.filter(pa.array(keep))

    def each(batches):
        for batch in batches:
            yield run(batch)

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots in them cannot be passed
    return plain.mapInArrow(each, plain.schema).toDF(*docs.columns)
