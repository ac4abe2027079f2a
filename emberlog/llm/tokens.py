"""Encoding of a corpus with a public byte-level BPE tokenizer, at array speed.

A batch of texts becomes one array of code points with their classes (letter, number, space, other). The boundary
automaton of the tokenizer's pre-tokenisation forgets everything but the last code point, except after an
apostrophe, where it counts up to two more; the composition of its transition functions over a prefix therefore
depends on at most three code points, and the associative scan over them is a handful of shifted comparisons on
the whole array - no regex, no loop over characters. The slices between boundaries go through a cache of merged
pieces; unseen ones are merged pair by pair. Byte offsets of the tokens can be kept for decoding.

Texts null or empty have the empty list. White space, control characters, emoji and very long texts are encoded
like any other. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB_DIR = "/opt/tokenizers"
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text handled at once: arrays stay in the processor's cache and a worker's memory stays flat.
SLICE_BYTES = 1 << 20
#: Pieces cached a worker; the cache starts anew beyond that.
CACHE_PIECES = 400_000
SLOT_BITS = 18
WORD_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Odd multipliers that spread the bits of two words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    cat = unicodedata.category
    kinds = np.frombuffer("".join(cat(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    out[kinds == ord("L")], out[kinds == ord("N")] = LETTER, NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def boundaries(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Indices of code points at which a piece begins; ``doc_starts`` are those at which a text begins (ascending)."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    run[0] = True
    start = run.copy()
    # the last of several white-space characters leaves them if a word follows; a plain space joins the word
    word = np.flatnonzero(run & ~first & (cls != SPACE))
    word = word[word > 0]
    word = word[cls[word - 1] == SPACE]
    start[word - 1] = True
    start[word] = cp[word - 1] != 32
    # contractions: an apostrophe that opens a piece
    quote = np.flatnonzero((cp == 39) & run)
    quote = quote[(quote + 1 < n)]
    quote = quote[first[quote] | (cp[quote - 1] != 32)]
    quote = quote[~first[quote + 1]]
    one = cp[quote + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    last = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~first[last], cp[last], 0)
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[short], 2), (quote[long], 3)):
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The pair of least rank is merged first, the leftmost of equals; a heap over a linked list of parts."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    alive = [True] * len(parts)
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] is not a or parts[j] is not b:
            continue
        parts[i], alive[j] = a + b, False
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(parts) and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, a in zip(parts, alive) if a]


@lru_cache(4)
def merger(vocab: str):
    """bytes -> ids for one piece: the library's merge where it is installed, else ``merge_pairs``."""
    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    try:
        import tiktoken
    except ImportError:
        return lambda piece: merge_pairs(piece, ranks)
    whole = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return lambda piece: whole.encode_ordinary(piece.decode())


class Encoder:
    """Batches of texts to ids. One a worker: it keeps the cache of merged pieces."""

    def __init__(self, vocab: str):
        self.merge = merger(vocab)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = np.zeros(1024, np.int64)
        self.at = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0
        self.low, self.high = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, np.int64)

    def _learn(self, piece: bytes) -> int:
        ids, k = self.merge(piece), len(self.known)
        self.known[piece] = k
        if k >= len(self.size):
            self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[k], self.at[k] = len(ids), self.used
        self.used += len(ids)
        return k

    def _kinds(self, data: bytes, cuts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The cache entry of each piece. Pieces of up to 15 bytes are two words; a direct-mapped table holds the
        words in full, so that a hit is exact, and whatever it misses goes through the dictionary."""
        size = stops - cuts
        words = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))
        low = words[cuts] & WORD_MASK[np.minimum(size, 8)]
        high = words[np.minimum(cuts + 8, len(data))] & WORD_MASK[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        slot = low * MIX[0] ^ high * MIX[1]
        slot = ((slot ^ slot >> np.uint64(29)) * MIX[2] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        short = size < 16
        kind = np.where(short & (self.low[slot] == low) & (self.high[slot] == high), self.entry[slot], -1)
        miss = np.flatnonzero(kind < 0)
        if len(miss):
            known, learn = self.known, self._learn
            found = []
            for a, b in zip(cuts[miss].tolist(), stops[miss].tolist()):
                piece = data[a:b]
                k = known.get(piece)
                found.append(learn(piece) if k is None else k)
            kind[miss] = found
            new = miss[short[miss]]
            at = slot[new]
            self.low[at], self.high[at], self.entry[at] = low[new], high[new], kind[new]
        return kind

    def encode(self, data: bytes, ends: np.ndarray, ids: bool = True, offsets: bool = False):
        """``data``: texts one after the other in UTF-8, ``ends``: their ends in bytes. Tokens a text, ids or None, byte offsets in the text or None."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=byte_at[1:])
        doc_byte = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cuts = byte_at[boundaries(cp, np.searchsorted(byte_at, doc_byte))]
        stops = np.append(cuts[1:], len(data)) if len(cuts) else cuts
        kind = self._kinds(data, cuts, stops)
        size = self.size[kind]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(total[np.searchsorted(cuts, np.concatenate([doc_byte, [len(data)]]))])
        if not ids and not offsets:
            return counts, None, None
        flat = self.flat[np.repeat(self.at[kind] - total[:-1], size) + np.arange(total[-1])]
        if not offsets:
            return counts, flat, None
        # a token begins where the tokens before it in its piece end
        length = token_lengths(self.merge_vocab)[flat]
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(counts)), counts)
        return counts, flat, begin - doc_byte[owner]

    merge_vocab = ""


@lru_cache(4)
def token_lengths(vocab: str) -> np.ndarray:
    with open(vocab, "rb") as f:
        pairs = [(int(b), len(base64.b64decode(a))) for a, b in (line.split() for line in f if line.strip())]
    out = np.zeros(max(i for i, _ in pairs) + 1, np.int64)
    for i, n in pairs:
        out[i] = n
    return out


def vocab_path(name: str, vocab_dir: str) -> str:
    return f"{vocab_dir}/{name}.tiktoken"


def _slices(texts: pa.Array):
    """(from row, to row, bytes, ends) of about SLICE_BYTES; a longer text is a slice of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, a = texts.buffers()[2], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        raw = data[int(offsets[a]) : int(offsets[b])].to_pybytes() if data is not None else b""
        yield a, b, raw, offsets[a + 1 : b + 1] - offsets[a]
        a = b


def _run(vocab: str, mode: str):
    def run(batches):
        enc = Encoder(vocab)
        enc.merge_vocab = vocab
        for batch in batches:
            key = batch.column(0)
            for a, b, raw, ends in _slices(batch.column(1)):
                counts, flat, begin = enc.encode(raw, ends, mode != "count", mode == "offsets")
                cols = [key.slice(a, b - a)]
                if mode == "count":
                    cols.append(pa.array(counts, pa.int64()))
                else:
                    edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(edges, pa.array(flat)))
                    if begin is not None:
                        cols.append(pa.ListArray.from_arrays(edges, pa.array(begin.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "offsets"][: len(cols)] if mode != "count" else ["key", "n_tokens"])

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR, offsets: bool = False) -> DataFrame:
    """(key, ids), with ``offsets`` also the byte at which each token begins in its text. One row a row of ``docs``, no shuffle.

    Only the two named columns are read. ``tokenizer``: byte_bpe_50k or byte_bpe_multi_50k, whose pre-tokenisation is alike.
    """
    schema = "key long, ids array<int>" + ", offsets array<int>" * offsets
    out = _keyed(docs, key, text).mapInArrow(_run(vocab_path(tokenizer, vocab_dir), "offsets" if offsets else "ids"), schema)
    return out.withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(key, n_tokens) without building the ids."""
    return _keyed(docs, key, text).mapInArrow(_run(vocab_path(tokenizer, vocab_dir), "count"), "key long, n_tokens long").withColumnRenamed("key", key)
