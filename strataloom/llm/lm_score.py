"""LM scoring by online logistic context mixing.

A token is coded as binary decisions: the path to it in a Huffman tree whose leaves
are the SYMBOLS most frequent training tokens, one leaf for each count class (a power
of two) of the less frequent tokens of the count table, and one for all others.  Four
predictors see each decision under hashed contexts: (0) the tree node over the training
corpus, (1) the previous symbol and node over the training corpus, (2) the node and
(3) the previous symbol and node in the text so far.  Their logits, and a bias, are added
with weights that the depth in the tree gates.  Weights and the text's own predictors are
refined block by block: a block is 2, 2, 4, 8, 16 and from then on BLOCK tokens of a
text; a decision sees all blocks before its own, and a gate's weights go by the block's
summed gradient over the root of its decisions.  A class leaf is followed by
whether the text had a token of that class before, and which, else by the token's share of its class;
tokens that training lacks are spelled by an order-2 byte model.  All parts are proper
distributions, so the score is a log10 probability, and bits per byte follow from it.

A text is coded whole, from its first token to its last, with slots in proportion to its
decisions; the blocks of many texts are handled together.  The weights start from those
that the training texts end with, all of them, when coded without their own share of
predictor 1.

Token counts cover all training texts, and both scores use the count of every
trained token: those of the HEAD most frequent ones are broadcast (a bounded table),
all others are joined.  Predictor 1 has one slot for PER_SLOT training tokens, between 2**MIN_SLOT_BITS
and 2**MAX_SLOT_BITS (the bound of its broadcast).  Defined results: null is an empty text,
that is one end token; without training texts all counts are 0 and N is 0; equal rows have
equal scores; a text of any length is one lane, alone in its chunk if it exceeds CHUNK bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

FOLDS, HELD_OUT = 5, 1
#: Most entries of the broadcast count table, and tokens in the Huffman tree.
HEAD, SYMBOLS = 1 << 20, 1 << 15
#: Training tokens for a slot of predictor 1, the least and most of those slots, and the least of predictors 2 and 3 in a text, as powers of two.
PER_SLOT, MIN_SLOT_BITS, MAX_SLOT_BITS = 128, 19, 24
NODE_BITS, PAIR_BITS = 10, 11
GATES = 16
#: Tokens of a block, once blocks have grown to it; a power of two.
BLOCK = 32
#: Weights that the training texts start with, to fit those of all texts.
START = (1.0, 0.5, 0.3, 0.5, 0.0)
#: Prior observations of predictors 1, 2 and 3, dealt by predictor 0.
PRIOR = (8.0, 2.0, 1.0)
RATE = 0.1
#: Hashed contexts of two bytes in the byte model.
LETTER_CONTEXTS = 1 << 12
CHUNK = 3 << 20
END = np.uint64(0xE7037ED1A0B428DB)
_LN10 = float(np.log(10.0))


def tokens(column) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, and the token fingerprints with one end per text, by row offsets."""
    w = _text.Words(column, _text.SPACES, _text.LOWER)
    rows = w.rows()
    offs = np.r_[0, np.cumsum(w.count + 1)]
    h = np.empty(int(offs[-1]), np.uint64)
    h[np.arange(len(w.hash)) + w.row] = w.hash
    h[offs[1:] - 1] = END
    return w, h, offs if rows else np.zeros(1, np.int64)


def _counted(batches):
    """(h, n) of a partition's tokens."""
    held, size = [], 0

    def merged():
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def out():
        keys, n = merged()
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["h", "n"])

    for part in _text.chunks(batches, most=CHUNK):
        held.append(np.unique(tokens(part.column("text"))[1], return_counts=True))
        size += len(held[-1][0])
        if size > 4_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 2_000_000:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def token_counts(training: DataFrame) -> DataFrame:
    """(h, n): count of every token of the texts, ends included."""
    rows = training.select(F.col("text").cast("string").alias("text"))
    return _spark.arrow_map(rows, _counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    total: int  # N
    distinct: int  # V
    head: np.ndarray  # sorted fingerprints
    count: np.ndarray  # their counts
    symbol: np.ndarray  # the leaf of each
    top: int  # leaves below this stand for one token each; the last one is for tokens outside the head
    path_at: np.ndarray  # offsets of each leaf's path
    path_node: np.ndarray
    path_bit: np.ndarray
    node_logit: np.ndarray
    rest: np.ndarray  # training tokens of each leaf from `top` on
    slot_bits: int = MIN_SLOT_BITS
    pairs: np.ndarray | None = None  # (2, slots) counts of predictor 1
    letters: np.ndarray | None = None  # (LETTER_CONTEXTS, 256) natural log of the byte model
    weights: np.ndarray | None = None  # (5, GATES) that a text starts with

    def base_log(self, count):
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def prepared(self) -> dict:
        """What a worker derives from the model once."""
        if "_made" not in self.__dict__ or (self._made["pairs"] is None) != (self.pairs is None):
            bits = max(1, int(np.ceil(np.log2(max(len(self.head), 2)))))
            depth = np.arange(len(self.path_node)) - np.repeat(self.path_at[:-1], np.diff(self.path_at))
            logit = self.node_logit[self.path_node].astype(np.float32)
            self.__dict__["_made"] = {
                "shift": np.uint64(64 - bits),
                "bucket": _bucket_edges(self.head, bits),
                # by place on the paths: node, gate and bit; hash of the node; predictor 0's logit, and the inverse probabilities of both bits
                # (pairs of numbers are the parts of a complex one, so that they are read at once)
                "place": self.path_node.astype(np.int64) | np.minimum(depth, GATES - 1).astype(np.int64) << 32 | self.path_bit.astype(np.int64) << 40,
                "key": (self.path_node.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE35),
                "logit": logit,
                "inverse": ((1 + np.exp(logit)) + 1j * (1 + np.exp(-logit))).astype(np.complex64),
                "size": np.diff(self.path_at).astype(np.int64),
                "pairs": None if self.pairs is None else (np.ascontiguousarray(self.pairs.T) / np.float32(PRIOR[0])).view(np.complex64).ravel(),
            }
        return self.__dict__["_made"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def _bucket_edges(head: np.ndarray, bits: int) -> np.ndarray:
    """Where fingerprints with each value of the upper bits begin."""
    return np.r_[0, np.cumsum(np.bincount((head >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))]


def _tree(weights: np.ndarray):
    """Huffman paths: offsets, nodes, bits; and each node's logit of bit 1."""
    n = len(weights)
    if n == 1:
        return np.array([0, 0]), np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(1, np.float32)
    heap = [(float(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    logit = np.zeros(n - 1, np.float32)
    for k in range(n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = n + k
        side[y] = 1
        logit[k] = np.log(b / a)
        heapq.heappush(heap, (a + b, n + k))
    at, node, bit = [0], [], []
    for k in range(n):
        x, path = k, []
        while x != 2 * n - 2:
            path.append((parent[x] - n, side[x]))
            x = parent[x]
        node += [p for p, _ in reversed(path)]
        bit += [b for _, b in reversed(path)]
        at.append(len(node))
    return np.array(at), np.array(node, np.int32), np.array(bit, np.int8), logit


def _blobs(batches):
    """Rows (h, n) as one binary value for each batch."""
    for batch in batches:
        pairs = np.stack([np.asarray(batch.column("h")), np.asarray(batch.column("n"))], 1)
        yield pa.RecordBatch.from_arrays([pa.array([pairs.astype(np.int64).tobytes()], pa.binary())], ["blob"])


def base_model(counts: DataFrame, head: int = HEAD, symbols: int = SYMBOLS) -> Model:
    """The model without its trained predictors.  At most `head` entries reach the driver."""
    level = F.floor(F.log(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(((r["level"], r["tokens"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n")).collect()), reverse=True)
    least, used = None, 0
    for lev, toks, _ in levels:
        if used + toks > head:
            break
        least, used = lev, used + toks
    blobs = [bytes(r["blob"]) for r in counts.where(level >= least).mapInArrow(_blobs, "blob binary").toLocalIterator()] if least is not None else []
    table = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    h, n = table[:, 0].copy().view(np.uint64), table[:, 1].copy()
    return built(h, n, sum(x[2] for x in levels), sum(x[1] for x in levels), symbols)


def built(h: np.ndarray, n: np.ndarray, total: int, distinct: int, symbols: int = SYMBOLS) -> Model:
    """The model of a count table, of all N tokens and V distinct ones."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    top = np.lexsort((h, -n))[:symbols]
    level = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    rare = np.ones(len(h), bool)
    rare[top] = False
    classes, place = np.unique(level[rare], return_inverse=True)
    symbol = np.empty(len(h), np.int32)
    symbol[top] = np.arange(len(top))
    symbol[rare] = len(top) + place
    rest = np.r_[np.bincount(place, weights=n[rare], minlength=len(classes)), max(total - int(n.sum()), 0)]
    at, node, bit, logit = _tree(np.r_[n[top], rest[:-1], rest[-1] + 1].astype(float))
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / PER_SLOT)), MIN_SLOT_BITS, MAX_SLOT_BITS))
    return Model(total, distinct, h, n, symbol, len(top), at, node, bit, logit, rest, bits)


def _find(model: Model, h: np.ndarray) -> np.ndarray:
    """Places in the head table, or -1."""
    if not len(model.head):
        return np.full(len(h), -1)
    made = model.prepared()
    low = (h >> made["shift"]).astype(np.int64)
    at, stop = made["bucket"][low], made["bucket"][low + 1]
    out = np.full(len(h), -1)
    todo = np.flatnonzero(at < stop)
    at, stop = at[todo], stop[todo]
    while len(todo):
        same = model.head[at] == h[todo]
        out[todo[same]] = at[same]
        at = at + 1
        on = ~same & (at < stop)
        todo, at, stop = todo[on], at[on], stop[on]
    return out


def _leaves(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the head table, or -1, and leaves of the tree."""
    at = _find(model, h)
    return at, np.where(at >= 0, model.symbol[at] if len(model.symbol) else 0, len(model.path_at) - 2)


def _previous(symbol: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashes of the previous leaves; a text begins after leaf -1."""
    before = np.zeros(len(symbol), np.uint32)
    before[1:] = symbol[:-1] + 1
    before[offs[:-1][offs[:-1] < len(before)]] = 0
    return before * np.uint32(0x9E3779B1)


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return x.take(at, mode="clip")  # the fastest mode; no place is outside


def _decisions(model: Model, symbol: np.ndarray, previous: np.ndarray):
    """Places on the paths of the decisions, the decisions of each token, and hashes of previous leaf and node."""
    made = model.prepared()
    size = _take(made["size"], symbol)
    stop = np.cumsum(size)
    at = np.repeat(_take(model.path_at, symbol) - (stop - size), size)
    at += np.arange(len(at))
    pair = np.repeat(previous, size)
    pair ^= _take(made["key"], at)
    pair ^= pair >> np.uint32(15)
    pair *= np.uint32(0x2C1B3C6D)
    pair ^= pair >> np.uint32(13)
    pair *= np.uint32(0x297A2D39)
    pair ^= pair >> np.uint32(16)
    return at, size, pair


def _trained(batches, model: Model):
    """One row of summed counts per slice: (slice, blob); slice -1 is the byte model."""
    pairs = np.zeros(2 << model.slot_bits)  # of whole numbers
    letters = np.zeros(LETTER_CONTEXTS << 8, np.int64)
    bit, shift = model.path_bit.astype(np.int64) << model.slot_bits, np.uint32(32 - model.slot_bits)
    for part in _text.chunks(batches):
        w, h, offs = tokens(part.column("text"))
        _, symbol = _leaves(model, h)
        # equal neighbours make equal decisions
        both, times = np.unique(_previous(symbol, offs).astype(np.uint64) << np.uint64(32) | symbol.astype(np.uint64), return_counts=True)
        at, size, pair = _decisions(model, (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.uint32))
        pairs += np.bincount((pair >> shift).astype(np.int64) + _take(bit, at), weights=np.repeat(times, size), minlength=len(pairs))
        letters += np.bincount(_letter_pairs(w.data, w.start, w.end)[0], minlength=len(letters))
    pairs, step = pairs.astype(np.int64), 1 << 15
    for k in range(0, len(pairs), step):
        if pairs[k : k + step].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([pairs[k : k + step].tobytes()], pa.binary())], ["slice", "blob"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([letters.tobytes()], pa.binary())], ["slice", "blob"])


def _letter_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of the words data[start:end] and of the space after each, packed; and where each word begins.  The context hashes the two bytes before, spaces at a word's start."""
    size = end - start + 1
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size)
    at += np.arange(len(at))
    byte = data.take(at, mode="clip")
    byte[begin + size - 1] = 0x20
    packed = np.empty(len(byte) + 2, np.uint32)
    packed[:2] = 0x20
    packed[2:] = byte
    two = packed[:-2].copy()
    if len(byte):
        two[begin] = two[begin + 1] = 0x20  # what stands before the word doesn't count
    context = ((packed[1:-1] << 8) + two) * np.uint32(40503) >> np.uint32(4)
    context &= np.uint32(LETTER_CONTEXTS - 1)
    return (context << np.uint32(8)) | packed[2:], begin


def _summed(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
            got = np.frombuffer(blob, np.int64)
            held[k] = held[k] + got if k in held else got
    for k, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "blob"])


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts, and the table of all token counts."""
    counts = _spark.written(token_counts(training), "token-counts")
    model = base_model(counts)
    held = training.sparkSession.sparkContext.broadcast(model)
    rows = training.select(F.col("text").cast("string").alias("text"))
    sums = _spark.arrow_map(rows, lambda b: _trained(b, held.value), "slice int, blob binary").repartition(_spark.parts(training.sparkSession), "slice")
    pairs, letters, step = np.zeros(2 << model.slot_bits, np.int64), np.zeros(LETTER_CONTEXTS << 8, np.int64), 1 << 15
    for r in _spark.arrow_map(sums, _summed, "slice int, blob binary").toLocalIterator():  # a table of fixed size
        x = np.frombuffer(bytes(r["blob"]), np.int64)
        if r["slice"] < 0:
            letters = x
        else:
            pairs[r["slice"] * step : (r["slice"] + 1) * step] = x
    model.pairs = pairs.reshape(2, -1).astype(np.float32)
    table = letters.reshape(LETTER_CONTEXTS, 256)
    plain = (table.sum(0) + 0.5) / (table.sum() + 128)
    table = (table + 2 * plain) / (table.sum(1, keepdims=True) + 2)
    model.letters = np.log(table).astype(np.float32)
    model.weights = _start(training, model)
    return model, counts


def _fitted(batches, model: Model):
    """One row of the summed weights at the ends of texts, and of the decisions that count for them, by gate."""
    total = np.zeros((6, GATES))
    for part in _text.chunks(batches, most=CHUNK):
        _, h, offs = tokens(part.column("text"))
        _mixed(model, _leaves(model, h)[1], offs, total)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])


def _start(training: DataFrame, model: Model) -> np.ndarray:
    """(5, GATES): the mean weights at the ends of all training texts."""
    model.weights = np.repeat(np.array(START)[:, None], GATES, 1)
    held = training.sparkSession.sparkContext.broadcast(model)
    rows = _spark.arrow_map(training.select(F.col("text").cast("string").alias("text")), lambda b: _fitted(b, held.value), "blob binary")
    total = sum((np.frombuffer(bytes(r["blob"])).reshape(6, GATES) for r in rows.collect()), np.zeros((6, GATES)))  # less than a KB a task, by all tasks at once
    # rounded, so that the order of the sums doesn't show
    return np.where(total[5] > 0, np.round(total[:5] / np.maximum(total[5], 1), 6), model.weights)


def _slots(least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the first of its slots and their number, a power of two; the last first one is the end."""
    size = np.int64(1) << np.maximum(least, np.ceil(np.log2(np.maximum(wanted, 1))).astype(np.int64))
    return np.r_[0, np.cumsum(size)], size


def _blocks(most: int):
    """(first, end) tokens of the blocks of texts of at most `most` tokens."""
    first = 0
    while first < most:
        end = max(2, min(2 * first, first + BLOCK))
        yield first, end
        first = end


def _mixed(model: Model, symbol: np.ndarray, offs: np.ndarray, fit: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text's leaves; to fit, the texts are training texts, and fit (6, GATES) gains their last weights, without probabilities."""
    rows, made = len(offs) - 1, model.prepared()
    if not len(model.path_node) or not rows:
        return np.zeros(rows)
    # longest first, so that the texts that have a block are the first ones
    order = np.argsort(-np.diff(offs), kind="stable")
    first, length = offs[:-1][order], np.diff(offs)[order]
    previous = _previous(symbol, offs)
    wanted = _text.row_sums(made["size"][symbol], offs)[order]
    near_first, near_size = _slots(NODE_BITS, wanted / 8)
    pair_first, pair_size = _slots(PAIR_BITS, wanted / 2)
    # counts of bits 0 and 1, in units of the predictor's prior observations
    near, pairs = np.zeros(near_first[-1], np.complex64), np.zeros(pair_first[-1], np.complex64)
    near_mask, pair_mask = near_size - 1, pair_size - 1
    weights = [np.tile(x, rows) for x in model.weights]
    seen = np.zeros((rows, GATES))
    cost = np.zeros(rows)
    place, logit, inverse, corpus = made["place"], made["logit"], made["inverse"], made["pairs"]
    shift = np.uint32(32 - model.slot_bits)
    for begin, end in _blocks(int(length[0])):
        k = int(np.searchsorted(-length, -begin, "left"))  # texts longer than begin
        some = np.minimum(length[:k], end) - begin
        stop = np.cumsum(some)
        token = np.repeat(first[:k] + begin - (stop - some), some) + np.arange(int(stop[-1]))
        at, size, pair = _decisions(model, symbol[token], previous[token])
        text = np.repeat(np.repeat(np.arange(k), some), size)
        what, x0, both = _take(place, at), _take(logit, at), _take(inverse, at)
        bit = what >> 40
        sign = bit.astype(np.float32)
        sign *= -2
        sign += 1
        # a predictor's odds are those of its counts and of prior observations that predictor 0 deals
        n = _take(corpus, (pair >> shift).astype(np.int64))
        if fit is not None:  # a decision must not find itself
            n -= np.where(bit, np.complex64(1j / PRIOR[0]), np.complex64(1 / PRIOR[0]))
        xb = _gain(n, both)
        i = what & 0xFFFFFFFF
        i &= _take(near_mask, text)
        i += _take(near_first, text)
        xc = _gain(_take(near, i), both)
        j = pair.astype(np.int64)
        j &= _take(pair_mask, text)
        j += _take(pair_first, text)
        xd = _gain(_take(pairs, j), both)
        g = what >> 32
        g &= 0xFF
        g += text * GATES
        z = x0 * _take(weights[0], g)
        for x, w in ((xb, 1), (xc, 2), (xd, 3)):
            z += x * _take(weights[w], g)
        z += _take(weights[4], g)
        z *= sign
        np.clip(z, -15, 15, out=z)
        p = np.exp(z, out=z)
        p += 1
        np.divide(1, p, out=p)  # probability of the bit that came
        if fit is None:
            edge = np.r_[0, np.cumsum(size)][stop - some]
            cost[:k] += np.add.reduceat(np.log(p), edge, dtype=np.float64)
        p -= 1
        p *= sign  # the bit minus its probability
        times = np.bincount(g, minlength=k * GATES)
        seen[:k] += times.reshape(k, GATES)
        rate = RATE / np.sqrt(np.maximum(times, 1))
        p = p.astype(np.float64)
        for x, w in ((x0, 0), (xb, 1), (xc, 2), (xd, 3), (None, 4)):
            slope = np.bincount(g, weights=p if x is None else p * x, minlength=k * GATES)
            slope *= rate
            weights[w][: k * GATES] += slope
        for table, slot, unit in ((near, i, PRIOR[1]), (pairs, j, PRIOR[2])):
            slot *= 2
            slot += bit
            np.add.at(table.view(np.float32), slot, np.float32(1 / unit))
    if fit is not None:
        fit[:5] += [(x.reshape(rows, GATES) * seen).sum(0) for x in weights]
        fit[5] += seen.sum(0)
    out = np.empty(rows)
    out[order] = cost
    return out


def _gain(n: np.ndarray, both: np.ndarray) -> np.ndarray:
    """What counts (of bit 0 and 1, in units of the prior observations) add to predictor 0's logit; both: its inverse probabilities."""
    a = n.imag * both.imag
    a += 1
    b = n.real * both.real
    b += 1
    a /= b
    return np.log(a, out=a)


def _repeated(at: np.ndarray, owner: np.ndarray, leaf: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens at `at`, those that came before in the same text; and per text the natural log probability of the
    choices between repeating and not, and of what is repeated, from the counts so far of the leaf in that text."""
    row, word = owner[at], h[at]
    order = np.lexsort((word, leaf[at], row))
    place, word = row[order] * (int(leaf.max(initial=0)) + 1) + leaf[at][order], word[order]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (word[1:] != word[:-1])
    group = np.flatnonzero(new)
    times = np.empty(len(at), np.int64)
    times[order] = np.arange(len(at)) - np.repeat(group, np.diff(np.r_[group, len(at)]))
    # in the order of the text, within each text and leaf
    own = np.argsort(row * (int(leaf.max(initial=0)) + 1) + leaf[at], kind="stable")
    key = (row * (int(leaf.max(initial=0)) + 1) + leaf[at])[own]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    start = np.repeat(edge, np.diff(np.r_[edge, len(key)]))
    before = np.arange(len(key)) - start
    again = times[own] > 0
    total = np.r_[0, np.cumsum(again)]
    repeats = total[:-1] - total[start]
    log = np.log((np.where(again, repeats, before - repeats) + 0.5) / (before + 1))
    log[again] += np.log(times[own][again] / before[again])
    return at[times > 0], np.bincount(row[own], weights=log, minlength=rows)


def score_chunk(column, model: Model):
    """Per text: tokens, known tokens and base score in the head; the tail (rows, h, natural log of the spelling where a
    token comes first, else 0); log10 probability, without the count or the spelling of each text's distinct tail tokens."""
    w, h, offs = tokens(column)
    rows = len(offs) - 1
    at, leaf = _leaves(model, h)
    known = at >= 0
    count = np.where(known, model.count[at] if len(model.count) else 0, 0)
    owner = np.repeat(np.arange(rows), np.diff(offs))
    n_known = np.bincount(owner[known], minlength=rows)
    base = np.bincount(owner[known], weights=model.base_log(count[known]), minlength=rows).astype(float)
    score = _mixed(model, leaf, offs)
    # what follows a leaf of several tokens: whether the token came before in the text, and which; else its share, or its spelling
    several = leaf >= model.top
    again, gain = _repeated(np.flatnonzero(several), owner, leaf, h, rows)
    score += gain
    new = several.copy()
    new[again] = False
    share = new & known
    score += np.bincount(owner[share], weights=np.log(count[share] / model.rest[leaf[share] - model.top]), minlength=rows)
    rest = model.rest[-1] + 1
    tail, lost = ~known, new & ~known
    spelling = np.zeros(len(h))
    if lost.any():
        score += np.bincount(owner[lost], minlength=rows) * -np.log(rest)
        lost &= h != END  # an end token is spelled by its leaf alone
        word = np.flatnonzero(lost) - owner[lost]
        if len(word):
            pair, begin = _letter_pairs(w.data, w.start[word], w.end[word])
            spelling[lost] = np.add.reduceat(model.letters.ravel()[pair], begin, dtype=np.float64)
    return np.diff(offs), n_known, base, owner[tail], h[tail], spelling[tail], score / _LN10


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for part in _text.chunks(batches, most=CHUNK):
            n, known, base, row, h, spelling, log = score_chunk(part.column("text"), m)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            tail = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(spelling)], ["h", "spelling"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("chk"), part.column("size"), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), tail, pa.array(log, pa.float64())], names)

    names = ["doc_id", "chk", "size", "n_tokens", "head_known", "head_base", "tail", "score"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("chk"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    scored = _spark.arrow_map(rows, run, f"doc_id {_spark.id_type(docs)}, chk long, size long, n_tokens long, head_known long, head_base double, tail array<struct<h:long,spelling:double>>, score double")
    scored = _spark.written(scored, "scored")
    bottom = F.lit(float(model.total + 0.5 * (model.distinct + 1)))
    # equal rows have equal tails: their sums are made once
    each = scored.where(F.size("tail") > 0).select("chk", "tail").dropDuplicates(["chk"]).select("chk", F.inline("tail")).groupBy("chk", "h").agg(F.count(F.lit(1)).alias("times"), F.min("spelling").alias("spelling"))
    found = each.join(counts, "h", "left")
    sums = found.groupBy("chk").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / bottom)).alias("base"), F.sum(F.coalesce(F.log(F.col("n").cast("double")), "spelling") / _LN10).alias("rare"))
    out = scored.drop("tail").join(sums, "chk", "left").withColumn("score", F.col("score") + F.coalesce("rare", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", (F.col("head_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", F.when(F.col("size") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("size")).alias("bits_per_byte"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    fold = _spark.fold_of(F.col("doc_id"), FOLDS)
    model, counts = train(docs.where(fold != HELD_OUT))
    return score(docs, model, counts).withColumn("held_out", fold == HELD_OUT)
