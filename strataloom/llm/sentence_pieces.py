"""SentencePiece encoding and decoding with a distinct-chunk table.

In the models taken here no piece has a white-space marker after another
character (checked when the model is read), so no merge crosses the place where
a marker follows a word.  A text is cut there; each distinct marked word is
segmented once and its ids are joined back by position.  The table is kept by
each worker and is bounded: it has two generations of TABLE_ROWS words, and a word that was
in neither is segmented again.

Defined results: null and empty texts give the begin and end ids only; a literal
marker character counts as a space, as in the library; repeated rows have equal
results; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

MARK = "▁"
#: Distinct marked words of a generation of a worker's table.
TABLE_ROWS = 250_000
CHUNK = 2 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for i in range(self.sp.get_piece_size()):
            if re.search(f"[^{MARK}]{MARK}", self.sp.id_to_piece(i)):
                raise ValueError("a piece of this model crosses a white-space marker")
        if any(self.sp.decode(self.sp.encode(x)) != x for x in ("  a  b ", "ﬁ")):
            raise ValueError("this model changes white space or characters before it segments")
        self.reset()

    def _segmented(self, words: list[bytes]) -> list[list[int]]:
        """Ids of marked words: the library itself puts the first marker before a text, but not before an empty one."""
        out = self.sp.encode([w[1:].decode() for w in words], num_threads=1)
        return [ids if len(w) > 1 else [self.sp.piece_to_id(MARK)] for w, ids in zip(words, out)]

    def reset(self):
        """Begins a generation; the one before is kept."""
        self.old = getattr(self, "table", {}), *(getattr(self, c, np.zeros(0, np.int64)) for c in ("size", "at", "flat"))
        self.table: dict[bytes, int] = {}
        self.size = np.zeros(1024, np.int64)
        self.at = np.zeros(1024, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, words: list[bytes]):
        table, sizes, starts, flat = self.old
        known = {w: k for w in words if (k := table.get(w)) is not None}
        new = [w for w in words if w not in known]
        found = [(w, flat[starts[k] : starts[k] + sizes[k]]) for w, k in known.items()]
        for word, ids in [*found, *zip(new, self._segmented(new))]:
            k = len(self.table)
            self.table[word] = k
            if k >= len(self.size):
                self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.size[k], self.at[k] = len(ids), self.used
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the column without begin and end, and their offsets."""
        column = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), MARK, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offs = _text.buffers(column)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(first)
        end = np.r_[start[1:], len(data)] if len(start) else start
        h = _text.span_hash(data, start, end)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.table) + len(index) > TABLE_ROWS:
            self.reset()
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start[index].tolist(), end[index].tolist())]
        missing = [w for w in words if w not in self.table]
        if missing:
            self._add(missing)
        table = self.table
        entry = np.fromiter((table[w] for w in words), np.int64, len(words))[inverse]
        size = self.size[entry]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[entry] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.r_[0, stop][np.searchsorted(start, offs)]


def _on_worker(digest: str, proto: bytes) -> Encoder:
    if _HELD.get("digest") != digest:
        _HELD.update(digest=digest, encoder=Encoder(proto))
    return _HELD["encoder"]


_HELD: dict = {}


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids with begin and end as array<int>, and what decoding them gives."""
    return _mapped(docs, model, f"doc_id {_spark.id_type(docs)}, ids array<int>, decoded string", lambda all_ids, decoded: [pa.array([x.tolist() for x in all_ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())])


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, model, f"doc_id {_spark.id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda all_ids, decoded: [pa.array([len(x) for x in all_ids], pa.int64()), pa.array([sha(x.tobytes()) for x in all_ids], pa.string()), pa.array([sha(x.encode()) for x in decoded], pa.string())])


def _mapped(docs: DataFrame, model: str | None, schema: str, columns) -> DataFrame:
    with open(model or default_model(), "rb") as f:  # a model's file is of fixed size, about a megabyte
        proto = f.read()
    held = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(proto).hexdigest(), proto))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder = _on_worker(*held.value)
        bos, eos = (np.array([x], "<u4") for x in (encoder.sp.bos_id(), encoder.sp.eos_id()))
        for part in _text.chunks(batches, most=CHUNK):
            ids, offs = encoder.encode(part.column("text"))
            every = [np.concatenate([bos, ids[a:b].astype("<u4"), eos]) for a, b in zip(offs[:-1], offs[1:])]
            decoded = [encoder.sp.decode(x.tolist()) for x in every]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(every, decoded)], names)

    return _spark.arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(_spark.table(spark, sf_dir, "documents"))
