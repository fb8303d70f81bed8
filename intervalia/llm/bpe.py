"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizers BPE model: each byte is shown as one printable character, and every
way to join two ranked pieces into a ranked piece is a merge, in the order of the joined piece's rank.
The ids come out as the ranks prescribe for each match of the split pattern.

Texts repeat words, so a worker encodes each distinct chunk once per batch and keeps the ids in a cache of
bounded size. Chunks start at a space or newline that a visible character follows; the split pattern always
begins a match there, so cutting there changes no id.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to no bytes; the length of a
text is limited by memory for that one text only; repeated rows give repeated results; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_of

#: Ids of this many distinct chunks stay in a worker's memory.
CACHE_CHUNKS = 300_000
#: Longer chunks are encoded anew each time.
CACHE_LENGTH = 64
CUT = re.compile(r"(?=[ \n]\S)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 text and rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, raw: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = parse_ranks(raw)
        shown = byte_characters()
        text = {t: "".join(shown[b] for b in t) for t in ranks}
        merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(shown)}
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.cache: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, little-endian unsigned 32-bit."""
        cut = [CUT.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        new = list({c for chunks in cut for c in chunks if c not in cache})
        long: dict[str, bytes] = {}
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                (cache if len(c) <= CACHE_LENGTH else long)[c] = np.array(e.ids, "<u4").tobytes()
        return [np.frombuffer(b"".join([cache[c] if c in cache else long[c] for c in chunks] if long else map(cache.__getitem__, chunks)), "<u4") for chunks in cut]

    def decode(self, ids) -> bytes:
        """The bytes of the ids. A token may hold part of a character, so whole sequences are joined before they are read as text."""
        return b"".join(map(self.pieces.__getitem__, np.asarray(ids).tolist()))

    def decode_text(self, ids) -> str:
        """As text; bytes that form no character, as in a sequence cut inside one, become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, ids) -> np.ndarray:
        """For each id the first and one past the last character that its bytes touch; ids that share a split character overlap there."""
        joined = np.frombuffer(self.decode(ids), np.uint8)
        if not len(joined):
            return np.zeros((0, 2), np.int64)
        character = np.cumsum((joined & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.pieces[int(i)]) for i in ids])
        starts = np.concatenate([[0], ends[:-1]])
        return np.stack([character[starts], character[ends - 1] + 1], axis=1)


_LOADED: dict[str, ByteBpe] = {}


def loaded(raw: bytes, pattern: str) -> ByteBpe:
    """One model for each worker process."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(raw, pattern)
    return _LOADED[key]


def rank_file(path: str) -> bytes:
    """The content of the rank file, read on the driver; workers get it with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<long>, and with offsets: starts and ends array<int>, in characters."""
    raw = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw.value, pattern)
        for batch in batches:
            ids = model.encode_batch(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))]
            if offsets:
                spans = [model.offsets(x) for x in ids]
                columns += [pa.array([s[:, k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, schema_of([docs.schema["doc_id"]], "ids array<bigint>" + ", starts array<int>, ends array<int>" * offsets))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary and text string, from doc_id and ids; null ids are no ids."""
    raw = encoded.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw.value, pattern)
        for batch in batches:
            out = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], names=["doc_id", "decoded", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema_of([encoded.schema["doc_id"]], "decoded binary, text string"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes stay in the worker, only their digests leave."""
    raw = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = model.encode_batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, schema_of([docs.schema["doc_id"]], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
