"""SentencePiece encoding that keeps, for every piece, its span of the original bytes, and decoding.

Normalisation walks the compiled character map: a flags word, a double-array trie
and a pool of replacements.  At each place the longest prefix that the trie
knows is replaced, else one code point is copied; each output byte records the
input byte it stems from.  The dummy prefix and escaped blanks follow the
model's settings.  The library then encodes the normalised text, its own normaliser
switched off; the pieces lie end to end in it, so their sizes give their places there and
the record gives their spans of the original.

Null text counts as empty; an empty text gives the end id alone; repeated rows
give repeated results; an empty table gives no rows; further columns are
ignored.  Work is row by row, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import as_bytes, table
from kinfold.shared import python_ready, tidy

MARK = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharsMap:
    """The compiled character map: longest-prefix replacement by a double-array trie."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of ``data[at:]`` and its replacement; (0, b"") if none."""
        units = self.units
        if not units:
            return 0, b""
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        found, node = (0, b""), offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != c:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                value = units[node] & ((1 << 31) - 1)
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


class Encoder:
    """One model's normaliser, encoder and decoder."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.precompiled_charsmap, spec.name, spec.normalization_rule_tsv = b"", "identity", ""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        self.sizes = np.array([1 if self.plain.is_byte(i) else len(self.plain.id_to_piece(i).encode()) for i in range(self.plain.get_piece_size())], np.int64)
        self.said = [str(i) for i in range(len(self.sizes))]

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end the original byte they stem from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape and not self.suffix:
            # An identity map: each blank becomes the three bytes of the mark, all else is copied.
            out = text.replace(b" ", MARK)
            width = np.where(np.frombuffer(text, np.uint8) == 32, 3, 1)
            origin = np.append(np.repeat(np.arange(len(text)), width), len(text))
            return (MARK + out, np.concatenate(([0, 0, 0], origin))) if self.prefix else (out, origin)
        pieces: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            n, new = self.map.longest(text, at)
            if not n:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                new = text[at : at + n]
            pieces.append((new, at))
            at += n
        out, origin, blank = bytearray(), [], self.squeeze
        mark = MARK if self.escape else b" "
        for new, at in pieces:
            for c in new:
                if c == 32:
                    if self.squeeze and blank:
                        continue
                    out += mark
                    origin += [at] * len(mark)
                    blank = True
                else:
                    out.append(c)
                    origin.append(at)
                    blank = False
        end = len(text)
        if self.squeeze:
            while out.endswith(mark):
                end = origin[-len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        if self.prefix and out:
            first = origin[0]
            if self.suffix:
                out += mark
                origin += [end] * len(mark)
            else:
                out[:0] = mark
                origin[:0] = [first] * len(mark)
        return bytes(out), np.array([*origin, end], np.int64)

    def encode(self, text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, begin and end of each one's original bytes.

        A piece of byte fallback spans the byte that it stands for, the dummy
        prefix an empty span at the start, the end id one at the end.
        """
        normal, origin = self.normalize(text)
        said = normal.decode("utf-8", "replace")
        ids = self.plain.encode(said)
        sizes = self.sizes[np.array(ids, np.int32)] if self.unknown not in ids else self._sizes(ids, said)
        at = origin[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        ids.append(self.end)
        end = np.array([len(text)])
        return ids, np.concatenate((at[:-1], end)), np.concatenate((at[1:], end))

    def _sizes(self, ids: list[int], said: str) -> np.ndarray:
        """Bytes of each piece where some are unknown: then the surface counts, not the piece's name."""
        return np.array([1 if self.plain.is_byte(i) else len(p.encode()) for i, p in zip(ids, self.plain.encode(said, out_type=str))], np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def digest(self, ids: list[int]) -> str:
        """The digest of the ids as decimals with one blank between."""
        return hashlib.sha256(" ".join([self.said[i] for i in ids]).encode()).hexdigest()


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, ids, begins, ends, decoded): pieces with their original byte spans."""
    spark = df.sparkSession
    python_ready(spark)
    with open(model or default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            rows = [e.encode(t or b"") for t in as_bytes(b.column(1))]
            lists = lambda i, kind: pa.array([r[i] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), lists(0, pa.int32()), lists(1, pa.int64()), lists(2, pa.int64()), pa.array([e.decode(r[0]) for r in rows], pa.string())], ["key", "ids", "begins", "ends", "decoded"])

    return df.select(key, text).mapInArrow(tidy(run), "key long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def token_digests(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, spans_crc32): digests of what ``encode_texts`` gives.

    The same encoder makes ids and spans; they are digested in the worker, as
    arrays of every id and span would be several times the input.
    """
    import zlib

    spark = df.sparkSession
    python_ready(spark)
    with open(model or default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            out: list[tuple] = []
            for t in as_bytes(b.column(1)):
                ids, begins, ends = e.encode(t or b"")
                spans = zlib.crc32(ends, zlib.crc32(begins))
                out.append((len(ids), e.digest(ids), hashlib.sha256(e.decode(ids).encode()).hexdigest(), spans))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return df.select(key, text).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
