"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word's parts are held as an array of boundaries with, beside it, the merge rank of every two
adjacent parts. The smallest rank is looked up, its boundary deleted, and the two neighbouring
ranks refreshed, until no adjacent parts have a rank. Words of more than ``HEAP_FROM`` bytes (long
runs without a space) keep the same arrays as a linked list under a heap, so that the time stays
n log n. Equal words are encoded once per task (a cache of bounded size).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import documents, map_arrow

#: Splits a text into words before merging; a fixed value of the public byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Above this many bytes a word's smallest rank comes from a heap instead of a scan.
HEAP_FROM = 128
#: Distinct words, and runs of words, kept per worker; about 100 MB in all.
CACHE_WORDS, CACHE_RUNS = 300_000, 300_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library (ByteLevel BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) -> rank; rank -> merged id
        self.merges, self.merged = {}, []
        for rank, (left, right) in enumerate((raw(a), raw(b)) for a, b in pairs):
            self.merges.setdefault((vocab[left], vocab[right]), rank)
            self.merged.append(vocab[left + right])
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(WORDS).findall
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.runs: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        parts = [self.single[b] for b in data]
        return self._by_heap(parts) if len(parts) > HEAP_FROM else self._by_scan(parts)

    def _by_scan(self, parts: list[int]) -> list[int]:
        """Contiguous arrays: ``parts`` between boundaries and ``ranks`` of adjacent parts."""
        get, merged = self.merges.get, self.merged
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        """The same merges in the same order for long words: linked boundaries under a heap."""
        n, get = len(parts), self.merges.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(get((a, b), NEVER), i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if rank == NEVER:
                break
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            new = self.merged[rank]
            parts[i], parts[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                heapq.heappush(heap, (get((new, parts[k]), NEVER), i, new, parts[k]))
            if (h := left[i]) >= 0:
                heapq.heappush(heap, (get((parts[h], new), NEVER), h, parts[h], new))
        return [p for p in parts if p != -1]

    def pieces(self, text: str) -> list[str]:
        """The words of ``text`` as comma-joined ids, in order; a piece may hold several words."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        for known in (self.runs, self.decoded):
            if len(known) > CACHE_RUNS:
                known.clear()
        out: list[str] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            self._plain(text[at : m.start()], out)
            out.append(str(self.special[m[0]]))
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: list[str]) -> None:
        """No word reaches over a space that a non-space follows, so runs between those are cached whole."""
        if not text:
            return
        runs = text.split(" ")
        if "" in runs[1:]:
            out += [self._word(w) for w in self.find(text)]
            return
        if runs[0]:
            out += [self._word(w) for w in self.find(runs[0])]
        known = self.runs
        for run in runs[1:]:
            ids = known.get(run)
            if ids is None:
                ids = known[run] = ",".join([self._word(w) for w in self.find(" " + run)])
            out.append(ids)

    def _word(self, word: str) -> str:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self.older.get(word) or ",".join(map(str, self.word(word.encode())))
        return ids

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p.split(",")]

    def decode_bytes(self, pieces: list[str]) -> bytes:
        decoded, out = self.decoded, []
        for p in pieces:
            data = decoded.get(p)
            if data is None:
                data = decoded[p] = b"".join([self.bytes_of[int(i)] for i in p.split(",")])
            out.append(data)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes([str(i) for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def bpe_encode(docs: DataFrame, vocab: str, text: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and return counts and digests of both.

    ``vocab`` is the path of a vocabulary file that every worker can read. One row per input row:
    id_col, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` with ``keep_ids``). A null text counts
    as empty (no tokens, digests of the empty string); repeated rows and null ids stay as they are;
    an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocab)
        counts, digests, texts, ids = [], [], [], []
        for t in batch.column(1):
            pieces = bpe.pieces(t.as_py() or "")
            joined = ",".join(pieces)
            counts.append(joined.count(",") + 1 if joined else 0)
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            back = bpe.decode_bytes(pieces).decode("utf-8", "replace")
            texts.append(hashlib.sha256(back.encode()).hexdigest())
            if keep_ids:
                ids.append([int(i) for i in joined.split(",")] if joined else [])
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(id_col, text), encode, schema)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), default_vocab())
