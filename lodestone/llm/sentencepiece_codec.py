"""SentencePiece encoding and decoding with offsets into the original bytes.

The normaliser walks the compiled character map of the model (a double-array trie and a
pool of replacements): at each place the longest prefix that the map holds is replaced,
anything else passes, and every normalised byte remembers the original bytes it came from.
White space handling (dummy prefix, extra blanks, escaping) follows the model's settings and
keeps the same alignment. The normalised text is cut before every run of blank marks; where
no piece of the vocabulary crosses such a cut (checked when the model is loaded), merging
never does either, so segments are encoded alone and their ids kept in a bounded cache.
Each piece's normalised bytes are projected through the alignment to a span of original bytes.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated
rows give equal results; any length is encoded whole; other columns pass through. Rows are
independent: nothing is shuffled, a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.common import holds, read, tidied

MARK = "▁"
#: Segments kept in the cache of a Python worker, and the longest text of one.
CACHE = 150_000
CACHED_CHARS = 48
#: Rows of an Arrow batch are taken this many characters at a time.
CHUNK = 1 << 20


class CharMap:
    """The compiled character map: a double-array trie from UTF-8 prefixes to replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest mapped prefix of data[at:] as (its length, replacement)."""
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.pool[start : self.pool.index(0, start)])
        return best


class Codec:
    """Encoder and decoder of one BPE model with spans; results equal the library's."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.by_segment = (
            self.map is None
            and self.dummy
            and not self.squeeze
            and self.escape
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
            and all(p.type != 4 for p in proto.pieces)
        )
        self.unknown = self.sp.unk_id()
        text = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        #: Normalised bytes of each piece; an unknown one is measured where it occurs.
        self.width = np.array([len(t) for t in text], np.int64)
        self.surface = [t.replace(MARK.encode(), b" ") for t in text]
        self.surface[self.unknown] = self.sp.decode([self.unknown]).encode()
        self.plain_width = np.array([len(t) for t in self.surface], np.int64)
        self.cache: dict[str, bytes] = {}
        digits = [f"{i},".encode() for i in range(len(text))]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(len(text), width)

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        cells = self.digits[ids]
        return cells[cells != 0].tobytes()[:-1]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text (with marks) and, for each of its bytes and its end, the original byte it came from."""
        data = text.encode("utf-8", "surrogatepass")
        if self.map is None and not self.squeeze:
            return self._plain(text, data)
        out, at, i = bytearray(), [], 0
        while i < len(data):
            found = self.map.longest(data, i) if self.map else None
            if found is None:
                step = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                found = (step, data[i : i + step])
            out += found[1]
            at += [i] * len(found[1])
            i += found[0]
        norm, spots = bytes(out), np.array([*at, len(data)], np.int64)
        if self.squeeze:
            keep = np.ones(len(norm), bool)
            blank = np.frombuffer(norm, np.uint8) == 32
            if len(norm):
                keep[1:] = ~(blank[1:] & blank[:-1])
                keep &= ~(np.logical_and.accumulate(blank) | np.logical_and.accumulate(blank[::-1])[::-1])
            norm, spots = np.frombuffer(norm, np.uint8)[keep].tobytes(), np.append(spots[:-1][keep], spots[-1])
        return self._marked(norm, spots)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        return self._marked(data, None)

    def _marked(self, norm: bytes, spots: np.ndarray | None) -> tuple[str, np.ndarray]:
        """Blanks become marks of three bytes and the dummy prefix comes before, both aligned."""
        if not norm:
            return "", np.zeros(1, np.int64)
        size = np.where(np.frombuffer(norm, np.uint8) == 32, 3, 1) if self.escape else np.ones(len(norm), np.int64)
        came = np.repeat(np.arange(len(norm)), size)
        end = len(norm)
        if spots is not None:
            came, end = spots[came], spots[-1]
        text = norm.decode("utf-8", "replace")
        text = text.replace(" ", MARK) if self.escape else text
        lead = 3 if self.dummy else 0
        return (MARK + text if self.dummy else text), np.concatenate([np.zeros(lead, np.int64), came, [end]])

    def _fill(self, words: set[str]) -> None:
        """Adds the ids of segments (without their first mark) that the cache lacks, in one call of the library."""
        need = [w for w in words if w not in self.cache]
        if len(self.cache) + len(need) > CACHE:
            self.cache.clear()
            need = list(words)
        # the library adds the first mark itself, but to an empty text
        for w, ids in zip(need, self.sp.encode(need, num_threads=1), strict=True):
            self.cache[w] = array("i", ids).tobytes()
        if "" in words:
            self.cache[""] = array("i", [self.sp.piece_to_id(MARK)]).tobytes()

    def ids_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if not self.by_segment:
            return [np.array(x, np.int32) for x in self.sp.encode(texts, num_threads=1)]
        # a blank in a row of blanks belongs to the next segment, as a mark of its own
        cut = [([m[1:] for m in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))] if MARK in t or "  " in t or t[-1:] == " " or t[:1] == " " else t.split(" ")) if t else [] for t in texts]
        long = {w for words in cut for w in words if len(w) > CACHED_CHARS}
        self._fill(set().union(*cut) - long)
        get, out = self.cache.__getitem__, []
        for words in cut:
            if long and not long.isdisjoint(words):
                out.append(np.frombuffer(b"".join([array("i", self.sp.encode(w)).tobytes() if w in long else get(w) for w in words]), np.int32))
            else:
                out.append(np.frombuffer(b"".join(map(get, words)), np.int32))
        return out

    def spans(self, ids: np.ndarray, normalised: str, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the original bytes.

        Byte pieces of one character share none of its bytes: each has its own. Pieces that
        are only the dummy prefix have an empty span at 0.
        """
        width = self.width[ids]
        if (ids == self.unknown).any():
            # an unknown piece is one character, which the widths of all others leave over
            data, at = normalised.encode(), 0
            for k, i in enumerate(ids.tolist()):
                if i == self.unknown:
                    c = data[at]
                    width[k] = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                at += int(width[k])
        stop = np.cumsum(width)
        start = stop - width
        last = came[np.maximum(stop - 1, 0)]
        nxt = came[np.minimum(stop, len(came) - 1)]
        end = np.where(stop >= len(came) - 1, came[-1], np.maximum(nxt, last))
        lead = 3 if self.dummy else 0
        end = np.where(stop <= lead, 0, end)
        return came[np.minimum(start, len(came) - 1)], end

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): every piece with the original bytes it covers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(ids, *self.project(ids, t)) for t, ids in zip(texts, self.ids_many(texts), strict=True)]

    def project(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Spans of a text's pieces. Where every blank is one byte and nothing else changes, widths suffice."""
        if self.map is None and not self.squeeze and self.dummy and self.escape and MARK not in text and not (ids == self.unknown).any():
            stop = np.cumsum(self.plain_width[ids]) - 1
            return np.concatenate([np.zeros(min(1, len(ids)), np.int64), stop[:-1]]), stop
        normalised, came = self.normalise(text)
        return self.spans(ids, normalised, came)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode gives it: bytes joined, the dummy prefix dropped."""
        surface = self.surface
        flags = self.is_byte[ids]
        if flags.any() and not self._whole_bytes(ids, flags):
            return self.sp.decode(ids.tolist())
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text

    def _whole_bytes(self, ids: np.ndarray, flags: np.ndarray) -> bool:
        """Whether each run of byte pieces is valid UTF-8 by itself."""
        at = np.flatnonzero(flags)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            try:
                b"".join([self.surface[i] for i in ids[run].tolist()]).decode()
            except UnicodeDecodeError:
                return False
        return True


_codecs: dict[str, Codec] = {}
holds("sentencepiece", _codecs.clear)


def codec(model_file: str) -> Codec:
    """The codec of this process; models are loaded once per Python worker."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs with ids array<int>, begins and ends array<bigint> (original UTF-8 bytes) and decoded string."""
    out = docs.drop("ids", "begins", "ends", "decoded")
    at = out.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for part in parts(batch, at):
                rows = c.encode_many([t or "" for t in part.column(at).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]).astype(kind))) for k, kind in ((0, np.int32), (1, np.int64), (2, np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array([c.decode(r[0]) for r in rows], pa.string())], names=[*part.schema.names, "ids", "begins", "ends", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(tidied("sentencepiece", run), schema + ", ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")


def token_ids(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs without their text, with n_tokens bigint and ids array<int>."""
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    src = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for part in parts(batch, len(rest)):
                rows = c.encode_many([t or "" for t in part.column(len(rest)).to_pylist()])
                lens = np.array([len(r[0]) for r in rows], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[0] for r in rows])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(lens), ids], names=[*rest, "n_tokens", "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(tidied("sentencepiece", run), (schema + ", " if rest else "") + "n_tokens bigint, ids array<int>")


def parts(batch: pa.RecordBatch, at: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about chunk characters of column at each, one row at least."""
    sizes = batch.column(at).cast(pa.large_binary() if pa.types.is_large_string(batch.column(at).type) else pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chunk, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def digests(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs without their text, with n_tokens, ids_sha256, decoded_sha256, and spans_sha256 of the spans' ends.

    The same codec as encode(), with arrays digested in the worker instead of sent back.
    """
    rest = [c for c in docs.columns if c != text and c not in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")]
    src = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for batch in parts(whole, len(rest)):
                texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
                rows = c.encode_many(texts)
                n = pa.array([len(r[0]) for r in rows], pa.int64())
                a = pa.array([sha(c.listed(r[0])) for r in rows], pa.string())
                b = pa.array([sha(c.decode(r[0]).encode("utf-8", "surrogatepass")) for r in rows], pa.string())
                s = pa.array([sha(r[2].astype("<i8").tobytes()) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], n, a, b, s], names=[*rest, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in rest)
    return src.mapInArrow(tidied("sentencepiece", run), schema + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"), default_model())


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
