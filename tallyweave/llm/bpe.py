"""Byte-level BPE by a pair occurrence index, and its inverse.

Texts are cut into pre-tokens (GPT-2's rule) on character classes, all at once for a chunk of documents; the
distinct pre-tokens of a chunk are encoded together. The encoder keeps, for each merge rank, the list of all
positions in the chunk where its pair stands, takes the active ranks in ascending order from a heap, merges all
positions of a rank in one step, and puts only the affected neighbour pairs into the lists again. That gives
the ids of merging word by word, as a merge can only create pairs of a higher rank than its own.

Defined results: null text is empty: no ids, decoded text empty. Any text length is encoded whole. Pairs of one rank
are merged from the left. Repeated rows are encoded each for itself; extra columns are ignored; an empty table gives
an empty result; bytes that are no UTF-8 decode to U+FFFD as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm.textnp import chunks, span_hashes, text_buffers
from tallyweave.staging import mapped

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that follow an apostrophe as a pre-token.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens that a worker remembers between chunks, and bits of the table that finds them.
REMEMBERED, TABLE_BITS = 800_000, 21
#: Runs of rows (of CHUNK_BYTES) whose new words are encoded together.
GROUP = 8


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    table[:] = np.fromiter((kinds.get(category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Byte starts of all pre-tokens of the documents; `special` strings are pre-tokens of their own."""
    if not len(data):
        return np.zeros(0, np.int64)
    table = _classes()
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    specials: list[int] = []
    if special:
        raw = data.tobytes()
        at = raw.find(special)
        while at >= 0:
            if not cut[at + 1 : at + len(special)].any():
                specials.append(at)
                cut[[at, at + len(special)]] = True
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
    ascii_only = not (data & 0x80).any()
    if ascii_only:
        place, kind, char = None, table[:128][data], data
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[place].astype(np.int64)
        char = lead.copy()
        wide = np.flatnonzero(lead >= 0xC0)
        p = place[wide]
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        b0, b1, b2, b3 = (padded[p + k].astype(np.int64) for k in range(4))
        char[wide] = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | (b1 & 0x3F), np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | (b2 & 0x3F), (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | (b3 & 0x3F)))
        kind = table[char]
        cut = np.append(cut[place], True)
    n = len(kind)
    begins = cut[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = char[:-1] == 0x20
    space = kind == SPACE
    last_of_run = np.zeros(n, bool)
    last_of_run[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
    start = begins | (~space & (kind != before) & ~blank_before) | (space & (before != SPACE)) | last_of_run
    for i in np.flatnonzero(start & (char == 0x27)):
        for ending in ENDINGS:
            j = i + 1 + len(ending)
            if j <= n and not cut[i + 1 : j].any() and all(char[i + 1 + k] == b for k, b in enumerate(ending)):
                start[i + 1 : j] = False
                if j < n and kind[j] == LETTER:
                    start[j] = True
                break
    starts = np.flatnonzero(start) if place is None else place[start]
    if specials:
        keep = np.ones(len(starts), bool)
        for s in specials:
            a, b = np.searchsorted(starts, [s + 1, s + len(special)])
            keep[a:b] = False
        starts = starts[keep]
    return starts


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        as_bytes = [b""] * size
        for token, i in vocab.items():
            as_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            as_bytes[i] = token
        self.token_len = np.array([len(x) for x in as_bytes], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.first = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left * size + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.made, self.twin = made, left == right
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot = np.zeros(1 << TABLE_BITS, np.int32)
        self.at, self.len, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64), (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _remember(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Into the first place if it is free, else the second if free, else not at all."""
        left = np.arange(len(hashes))
        for place in self._places(hashes):
            p = place[left]
            free = self.seen[p] == 0
            self.seen[p[free]], self.slot[p[free]] = hashes[left[free]], slots[left[free]]
            left = left[self.seen[p] != hashes[left]]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.order[k], NONE).astype(np.int32)

    def _merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte words and their n+1 offsets."""
        n = len(data)
        sym = self.first[data]
        follow = np.arange(1, n + 1, dtype=np.int32)
        follow[offsets[1:][np.diff(offsets) > 0] - 1] = n
        back = np.full(n + 1, n, np.int32)
        has = np.flatnonzero(follow < n)
        back[follow[has]] = has
        alive = np.ones(n, bool)
        merged = np.zeros(n + 1, bool)
        merged[n] = True
        rank = np.full(n + 1, NONE, np.int32)
        rank[has] = self._rank(sym[has], sym[follow[has]])
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r != NONE], r[r != NONE]
            if not len(at):
                return
            if len(at) > 1:
                o = np.argsort(r, kind="stable")
                at, r = at[o], r[o]
            heads = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]]).tolist()
            for s, e in zip(heads, heads[1:]):
                k = int(r[s])
                if k in lists:
                    lists[k].append(at[s:e])
                else:
                    lists[k] = [at[s:e]]
                    heapq.heappush(heap, k)

        note(has)
        while heap:
            k = heapq.heappop(heap)
            found = lists.pop(k)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[rank[at] == k]
            if not len(at):
                continue
            if self.twin[k] and len(at) > 1:
                at = np.sort(at)
                chained = np.concatenate([[False], follow[at[:-1]] == at[1:]])
                idx = np.arange(len(at))
                head = np.maximum.accumulate(np.where(chained, 0, idx))
                at = at[(idx - head) % 2 == 0]
            gone = follow[at]
            after = follow[gone]
            sym[at] = self.made[k]
            follow[at] = after
            back[after] = at
            alive[gone] = False
            rank[gone] = NONE
            before = back[at]
            merged[at] = True
            near = np.concatenate([at, before[~merged[before]]])
            merged[at] = False
            nxt = follow[near]
            new = np.full(len(near), NONE, np.int32)
            ok = nxt < n
            new[ok] = self._rank(sym[near[ok]], sym[nxt[ok]])
            rank[near] = new
            rank[n] = NONE
            note(near)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], kept[offsets]

    def _learn(self, hashes: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Slots of new distinct words, encoded together."""
        ids, at = self._merge(flat, offs)
        for special, i in self.special.items():
            for k in np.flatnonzero(np.diff(offs) == len(special)):
                if flat[offs[k] : offs[k + 1]].tobytes() == special:
                    ids[at[k]] = i
                    ids = np.delete(ids, np.s_[at[k] + 1 : at[k + 1]])
                    at[k + 1 :] -= at[k + 1] - at[k] - 1
                    break
        base = len(self.at)
        self.at = np.concatenate([self.at, at[:-1] + len(self.pool)])
        self.len = np.concatenate([self.len, np.diff(at).astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        slots = np.arange(base, base + len(hashes), dtype=np.int32)
        self._remember(hashes, slots)
        return slots

    def encode(self, group: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each (bytes, offsets of documents): their ids, and the n+1 offsets of each document's ids."""
        if len(self.at) > REMEMBERED:
            self._forget()
        found, lost = [], []
        for data, offsets in group:
            starts = pretokens(data, offsets, next(iter(self.special), b""))
            ends = np.append(starts[1:], len(data))
            hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
            one, two = self._places(hashes)
            slot = np.where(self.seen[one] == hashes, self.slot[one], np.where(self.seen[two] == hashes, self.slot[two], np.int32(-1)))
            missing = np.flatnonzero(slot < 0)
            new, index = np.unique(hashes[missing], return_index=True)
            s, e = starts[missing[index]], ends[missing[index]]
            offs = np.concatenate([[0], np.cumsum(e - s)])
            lost.append((new, data[np.repeat(s - offs[:-1], e - s) + np.arange(offs[-1])], offs))
            found.append((np.searchsorted(starts, offsets), slot, missing, hashes[missing]))
        hashes, index = np.unique(np.concatenate([x[0] for x in lost]), return_index=True)
        if len(hashes):
            size = np.concatenate([np.diff(x[2]) for x in lost])
            flat = np.concatenate([x[1] for x in lost])
            at, size = (np.cumsum(size) - size)[index], size[index]
            offs = np.concatenate([[0], np.cumsum(size)])
            slots = self._learn(hashes, flat[np.repeat(at - offs[:-1], size) + np.arange(offs[-1])], offs)
        for first, slot, missing, wanted in found:
            if len(missing):
                slot[missing] = slots[np.searchsorted(hashes, wanted)]
            size = self.len[slot].astype(np.int64)
            out = np.concatenate([[0], np.cumsum(size)])
            yield self.pool[np.repeat(self.at[slot] - out[:-1], size) + np.arange(out[-1])], out[first]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_len[ids]
        out = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[np.repeat(self.token_at[ids] - out[:-1], size) + np.arange(out[-1])].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Bpe:
    """One encoder for each worker process and file."""
    return Bpe(path)


def encoded_chunks(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for runs of rows of a text column; words are learnt for a group of runs at once."""
    bpe = vocabulary(path)
    rest = chunks(column)
    while group := list(itertools.islice(rest, GROUP)):
        for (i, j, _, _), (ids, at) in zip(group, bpe.encode([x[2:] for x in group])):
            yield i, j, ids, at


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document. Null text: no ids. One output row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, ids, at in encoded_chunks(b.column(1), path):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return mapped(rows, run, "doc_id long, ids array<int>")


def decode_documents(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD. Null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bpe = vocabulary(path)
            texts = [bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encoded_docs.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them, without moving ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bpe = vocabulary(path)
            for i, j, ids, at in encoded_chunks(b.column(1), path):
                raw = ids.astype("<u4")
                back = bpe.decode(ids)
                byte_at = np.concatenate([[0], np.cumsum(bpe.token_len[ids])])[at].tolist()
                at = at.tolist()
                shas = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(at, at[1:])]
                texts = [hashlib.sha256(back[s:e].decode("utf-8", "replace").encode()).hexdigest() for s, e in zip(byte_at, byte_at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(shas), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return mapped(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
