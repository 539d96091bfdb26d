"""SentencePiece encoding and decoding for merge-type (BPE) models, exact, by backtracking.

Aho-Corasick finds the longest piece at each position. The encoder takes it if it is compatible with
the piece before (merging both from their characters again would keep the boundary), else a shorter
one; positions from which nothing fitted are marked in a bit field and never tried again. Characters
without a piece become byte pieces.

No piece has the word mark after another character, so merges never cross a word's beginning: words
are encoded apart, and a worker remembers a bounded number of them.

Defined cases: null text is empty and gives begin and end ids only; an empty table gives no rows;
repeated rows and further columns are kept apart by doc_id alone; texts of any length are encoded whole, one at a time;
there are no ties: a text has one encoding.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import kept_in_worker

MARK = "▁"
REMEMBERED = 75_000
REMEMBERED_PAIRS = 120_000
LONGEST_REMEMBERED = 64
#: Piece types and field numbers of the model's protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN_SHOWN = " \u2047 "


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message; messages and strings as bytes, 32-bit values as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """A BPE model's pieces, and the tables that encoding and decoding need."""

    def __init__(self, proto: bytes):
        texts, scores, kinds = [], [], []
        self.bos, self.eos, self.prefix, kind_of_model = 1, 2, True, 0
        for number, value in _fields(proto):
            if number == PIECES:
                piece = dict(_fields(value))
                texts.append(piece[1].decode("utf-8"))
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                spec = dict(_fields(value))
                kind_of_model, self.bos, self.eos = spec.get(3, 1), spec.get(41, 1), spec.get(42, 2)
            elif number == NORMALIZER:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that leave characters and white space alone are supported")
                self.prefix = bool(spec.get(3, 1))
        if kind_of_model != 2 or USER_DEFINED in kinds:
            raise ValueError("a BPE model without user-defined pieces is needed")
        self.ids = {t: i for i, t in enumerate(texts) if kinds[i] == NORMAL}
        self.length = [len(t) for t in texts]
        self.byte_ids = [0] * 256
        self.byte_of = {}
        for i, t in enumerate(texts):
            if kinds[i] == BYTE:
                self.byte_ids[int(t[3:5], 16)] = i
                self.byte_of[i] = int(t[3:5], 16)
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece has the word mark inside")
        self.shown = [{CONTROL: "", UNKNOWN: UNKNOWN_SHOWN}.get(kinds[i], t.replace(MARK, " ")) for i, t in enumerate(texts)]
        self.marked = [kinds[i] == NORMAL and t.startswith(MARK) for i, t in enumerate(texts)]
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        # Order of merges: higher score first. Characters are there from the start.
        order = sorted((i for t, i in self.ids.items() if len(t) > 1), key=lambda i: (-scores[i], i))
        self.rank = [0] * len(texts)
        for n, i in enumerate(order):
            self.rank[i] = n + 1
        self.texts = texts
        self.parts: dict[int, tuple[int, int]] = {}
        usable = [i for t, i in self.ids.items() if len(t) == 1]
        for i in order:  # parts come before wholes, as a merge needs both of its parts
            if (last := self._last_merge(texts[i])) is not None:
                self.parts[i] = last
                usable.append(i)
        self.finder = ahocorasick.Automaton()
        for i in usable:
            self.finder.add_word(texts[i], (len(texts[i]), i))
        self.finder.make_automaton()
        usable = {texts[i]: i for i in usable}
        self.shorter = {i: next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1) for t, i in usable.items()}
        self.compatible: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.old: dict[str, bytes] = {}

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes this whole text, or None if merging ends otherwise."""
        own = [self.ids.get(c) for c in text]
        if None in own:
            return None
        while True:
            best = min(((self.rank[m], k) for k in range(len(own) - 1) if (m := self.ids.get(self.texts[own[k]] + self.texts[own[k + 1]])) is not None), default=None)
            if best is None:
                return None
            k = best[1]
            if len(own) == 2:
                return own[0], own[1]
            own[k : k + 2] = [self.ids[self.texts[own[k]] + self.texts[own[k + 1]]]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces anew keeps the boundary between them.

        Merges are taken back from the latest; at each point the pieces that then touch the boundary
        must not have been free to merge before the one taken back was made. Of equal merges the left one comes first.
        """
        rank, ids, texts = self.rank, self.ids, self.texts
        a, b = left, right
        until = (1 << 60, 0)  # the merge at the boundary must come at or after this (rank, side)
        while True:
            whole = ids.get(texts[a] + texts[b])
            if whole is not None and (rank[whole], 1) < until:
                return False
            ra, rb = rank[a], rank[b]
            if not ra and not rb:
                return True
            if ra > rb:
                until = (ra, 0)
                a = self.parts[a][1]
            else:
                until = (rb, 2)
                b = self.parts[b][0]

    def _known(self, text: str, longest: list[int]) -> list[int]:
        """Ids of a text all of whose characters have pieces; longest: the longest piece at each position."""
        length, shorter, compatible = self.length, self.shorter, self.compatible
        n, at, out = len(text), 0, []
        failed = bytearray(n + 1)
        piece = longest[0]
        while True:
            if piece < 0:  # nothing fits here: take the last piece back and shorten it
                failed[at] = 1
                piece = out.pop()
                at -= length[piece]
                piece = shorter[piece]
                continue
            end = at + length[piece]
            good = not failed[end]
            if good and out:
                pair = out[-1] << 32 | piece
                good = compatible.get(pair)
                if good is None:
                    if len(compatible) > REMEMBERED_PAIRS:
                        compatible.clear()
                    good = compatible[pair] = self.fits(out[-1], piece)
            if good:
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at]
            else:
                piece = shorter[piece]

    def encode_word(self, text: str) -> list[int]:
        longest = [-1] * len(text)
        for end, (size, piece) in self.finder.iter(text):  # ends come in order, so the longest is last
            longest[end - size + 1] = piece
        if -1 not in longest:
            return self._known(text, longest)
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                out += [self.byte_ids[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                end = at
                while end < len(text) and longest[end] >= 0:
                    end += 1
                out += self._known(text[at:end], longest[at:end])
                at = end
        return out

    def word(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            own = self.encode_word(text)
            found = struct.pack(f"<{len(own)}I", *own)
            if len(text) > LONGEST_REMEMBERED:
                return found
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[text] = found
        return found

    def encode_raw(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian 32-bit numbers."""
        out = [struct.pack("<I", self.bos)]
        if text:
            young, word, add = self.young, self.word, out.append
            marked = (MARK + text if self.prefix else text).replace(" ", MARK)
            for w in _WORDS.findall(marked):
                found = young.get(w)
                if found is None:
                    found = word(w)
                    young = self.young
                add(found)
        out.append(struct.pack("<I", self.eos))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    raw.append(b)
                    continue
                if raw:
                    parts.append(_lenient(bytes(raw)))
                    raw.clear()
                parts.append(shown[i])
            if raw:
                parts.append(_lenient(bytes(raw)))
            text = "".join(parts)
        first = next((i for i in ids if i not in self.control), -1)
        return text[1:] if self.prefix and first >= 0 and self.marked[first] else text


#: A word with the marks before it; a line end is a word of its own.
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def _lenient(raw: bytes) -> str:
    """UTF-8, with a replacement character for each byte that isn't part of a character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out.append(raw[at : at + bad.start].decode("utf-8") + "�")
            at += bad.start + 1
    return "".join(out)


def model_of(proto: bytes) -> Model:
    """The model, built once in a worker."""
    return kept_in_worker(proto, Model)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _coder(proto, with_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto.value)
        for batch in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for x in batch.column("text"):
                raw = model.encode_raw(x.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return code


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: a row for each row of docs (doc_id, text)."""
    proto = docs.sparkSession.sparkContext.broadcast(load(model_path))  # the model file, half a megabyte
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_coder(proto, with_ids), schema)
