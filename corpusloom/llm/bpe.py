"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one BPE encoding, and so one last token. A token that ends at a prefix is the last one if the
prefix before it is encoded with a last token that it may follow: the pair is compatible when no merge across the
boundary would have come first. An automaton over the vocabulary gives the tokens that end at each place; back-pointers
give the ids. Work is linear in the text, whatever a piece looks like.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.arrow import per_text

# how the byte-level pre-tokenizer cuts text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHED_CHUNKS, CACHED_PIECES, CACHED_CHARS, CACHED_PAIRS = 250_000, 150_000, 48, 1_000_000
NEVER = 1 << 60


def byte_chars() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class Recent(dict):
    """What `make` gives for a short key, kept in two generations: when the young one is full it becomes the old one,
    and what is met again moves back. Holds 2 * `most` entries at most; long keys are not kept."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes as the vocabulary's own library does, without its added post-processing tokens."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        back = {c: b for b, c in enumerate(byte_chars())}
        raw = lambda token: bytes(back[c] for c in token).decode("latin-1")
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take neighbouring text are not supported")
        self.added = added
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.bytes = [b""] * (1 + max(*ids.values(), *added.values(), 0))
        for text, i in [*((t.encode("latin-1"), i) for t, i in ids.items()), *((t.encode(), i) for t, i in added.items())]:
            self.bytes[i] = text
        # rank of each merge by its two ids; the two parts of each token and the rank that made it (bytes: -1)
        n = len(self.bytes)
        self.left, self.right, self.made, self.rank = [0] * n, [0] * n, [-1] * n, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            t = ids[a + b]
            self.rank[ids[a], ids[b]] = rank
            if self.made[t] < 0:
                self.left[t], self.right[t], self.made[t] = ids[a], ids[b], rank
        self.pairs: dict[int, bool] = {}
        self.length = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        reached = [False] * n
        for text, i in sorted(ids.items(), key=lambda x: self.made[x[1]]):
            # a token that its own merges never build can't occur
            reached[i] = self.made[i] < 0 or reached[self.left[i]] and reached[self.right[i]] and self._meet(self.left[i], self.right[i], self.made[i])
            if reached[i] and text:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        # a space before a visible character always starts a piece, so texts can be cut there
        self.cut = re.compile(r" (?=\S)")
        self.piece = Recent(self.encode_piece, CACHED_PIECES)
        self.later = Recent(lambda chunk: self.encode_chunk(" " + chunk), CACHED_CHUNKS)

    def _meet(self, a: int, b: int, own: int = -1) -> bool:
        """Whether a and b stay apart. Goes back through the tokens at the boundary: of the two, the one made last was
        its parts before that. A pair that stood at the boundary would have merged if its rank comes before the merges
        that took its sides; at equal rank the left one goes first. own: the rank at which a and b do merge, if that is
        asked about."""
        until_a = until_b = NEVER
        while True:
            r = self.rank.get((a, b))
            if r is not None and r != own and r < until_a and r <= until_b:
                return False
            if self.made[a] < 0 and self.made[b] < 0:
                return True
            if self.made[a] > self.made[b]:
                until_a, a = self.made[a], self.right[a]
            else:
                until_b, b = self.made[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[a * len(self.bytes) + b] = self._meet(a, b)
        return known

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece as little-endian int32."""
        text = piece.encode().decode("latin-1")
        if self.automaton.exists(text):
            return self.automaton.get(text).to_bytes(4, "little")
        last = [-1] * (len(text) + 1)
        length, pairs, n = self.length, self.pairs, len(self.bytes)
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - length[token]
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = pairs.get(before * n + token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return struct.pack(f"<{len(ids)}i", *reversed(ids))

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(chunk)))

    def _encode_plain(self, text: str) -> bytes:
        head, *rest = self.cut.split(text)
        return self.encode_chunk(head) + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.cut_added is None or not any(t in text for t in self.added):
            return np.frombuffer(self._encode_plain(text), "<i4") if text else np.empty(0, "<i4")
        parts = self.cut_added.split(text)
        return np.frombuffer(b"".join(np.int32(self.added[p]).tobytes() if k % 2 else self._encode_plain(p) for k, p in enumerate(parts) if p), "<i4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` with ids (array<int>) of each whole text, and decoded, the text that these ids give.

    vocabulary: the tokenizer's JSON, which goes to the tasks as a broadcast (a file of fixed size). Null texts are
    encoded as empty ones: no ids, decoded ''. Rows stay as many as they are; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make(texts: pa.Array) -> list[pa.Array]:
        bpe = codec(shared.value)
        ids = [bpe.encode(t or "") for t in texts.to_pylist()]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
        return [lists, pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())]

    return per_text(df, text, keep, "ids array<int>, decoded string", make)
