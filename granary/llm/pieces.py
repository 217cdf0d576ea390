"""SentencePiece BPE models: exact encoding by backtracking, and decoding.

A merge model joins, again and again, the adjacent symbols whose join is the best
piece, the leftmost first among equals. The result is the one sequence of pieces
that covers the text and in which every two neighbours are compatible: merging the
characters of both again gives those two. So no merging of whole texts is needed:

* an Aho-Corasick automaton of all pieces gives the longest piece at each place;
* from left to right the longest piece that is compatible with the one before is
  taken, else the longest of its prefixes that is a piece, and so on;
* where none fits, the place is set in a bitfield of failed places, the last piece
  is taken back and a shorter one stands in for it. Failed places aren't tried
  again, so the work stays in proportion to the text.

Compatibility is found by merging the two pieces' characters, once a pair, and kept
in a table of bounded size. No piece of the model has a space mark after another
character, and no character without a piece joins others, so a text falls into
parts at those places; parts that were seen lately come from a table of bounded
size, all others are encoded. Characters without a piece become their bytes' pieces.

Edges: a null or empty text has the begin and end ids only. Each row is a document
of its own, repeated ids and rows too. Spaces, also in runs and at the ends, are
kept; U+2581 in a text is a space to the model and decodes as one. The strings of
control pieces are ordinary text. A very long text, or a word without a space, is
encoded whole. Nothing depends on the order of rows, so there are no ties. An empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of the tables of parts and of pairs in a Python worker; a full one starts anew.
PARTS, PAIRS = 1 << 18, 1 << 19
#: Longer parts aren't kept.
KEPT_CHARS = 48
#: Text of the normaliser's test: it must only turn spaces into marks.
_PROBE = "  ﬁ① Å  x\t"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The pieces of a model file, and encoding and decoding with them."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(_PROBE) != (SPACE + _PROBE.replace(" ", SPACE)):
            raise ValueError(f"{path}: its normaliser does more than to mark spaces")
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte = np.array([sp.is_byte(i) for i in range(n)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        if self.byte.sum() != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: needs a piece for each byte, and no unused pieces")
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.byte[i] or self.silent[i] or i == self.unknown)]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.name = names
        self.of_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        known = {p for p in self.ids if len(p) == 1}
        if any(c not in known for p in self.ids for c in p) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: has pieces that join across spaces or of characters without a piece")
        self.length = [len(p) for p in names]
        self.shorter = [-1] * n
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            automaton.add_word(p, (i, len(p) - 1))
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        automaton.make_automaton()
        self.automaton = automaton
        #: What each id stands for in a decoded text.
        self.bytes = [b"" if self.silent[i] else b" \xe2\x81\x87 " if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.of_byte):
            self.bytes[i] = bytes([b])
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in known and c != " ")
        self._parts = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._pairs: dict[int, bool] = {}
        self._seen: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best join first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, token: int) -> bool:
        """Merging the characters of both gives both; with no piece before (-1), the piece itself."""
        key = before * len(self.name) + token
        found = self._pairs.get(key)
        if found is None:
            own = [self.name[token]] if before < 0 else [self.name[before], self.name[token]]
            found = self.merge("".join(own)) == own
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def _cover(self, longest: list[int], begin: int, end: int) -> list[int]:
        """The pieces of the characters begin to end, all of which have a piece."""
        length, shorter, known, n = self.length, self.shorter, self._pairs.get, len(self.name)
        failed = None  # the bitfield, made when a place fails
        out: list[int] = []
        at, token, before = begin, longest[begin], -1
        while at < end:
            while token >= 0:
                stop = at + length[token]
                if failed is None or not failed[(stop - begin) >> 3] >> ((stop - begin) & 7) & 1:
                    fits = known(before * n + token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, at = token, stop
                if at < end:
                    token = longest[at]
                continue
            if failed is None:
                failed = bytearray((end - begin) // 8 + 1)
            failed[(at - begin) >> 3] |= 1 << ((at - begin) & 7)
            if not out:
                raise AssertionError("no sequence of compatible pieces")
            last = out.pop()
            at -= length[last]
            token, before = shorter[last], out[-1] if out else -1
        return out

    def part(self, text: str) -> list[int]:
        """The ids of a text whose spaces are marked."""
        longest = [-1] * len(text)
        for last, (i, before) in self.automaton.iter(text):
            longest[last - before] = i  # ends come in ascending order, so the longest stays
        if -1 not in longest:
            return self._cover(longest, 0, len(text))
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                out += [self.of_byte[b] for b in text[at].encode()]
                at += 1
                continue
            stop = at
            while stop < len(text) and longest[stop] >= 0:
                stop += 1
            out += self._cover(longest, at, stop)
            at = stop
        return out

    def encode(self, text: str | None, ends: bool = True) -> np.ndarray:
        """The ids (little-endian unsigned 32-bit) of a whole text, with begin and end ids if `ends`."""
        seen, made = self._seen, []
        if text:
            for word in self._parts.findall(SPACE + text.replace(" ", SPACE)):
                ids = seen.get(word)
                if ids is None:
                    own = self.part(word)
                    ids = struct.pack(f"<{len(own)}I", *own)
                    if len(word) <= KEPT_CHARS:
                        if len(seen) >= PARTS:
                            seen.clear()
                        seen[word] = ids
                made.append(ids)
        if ends:
            made = [struct.pack("<I", self.begin), *made, struct.pack("<I", self.end)]
        return np.frombuffer(b"".join(made), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the first piece loses its leading space; bytes that aren't UTF-8 become U+FFFD one by one."""
        ids = np.asarray(ids, np.int64)
        spoken = np.flatnonzero(~self.silent[ids])
        if not len(spoken):
            return ""
        ids = ids[spoken[0] : spoken[-1] + 1]
        parts = [self.bytes[i] for i in ids.tolist()]
        if not self.byte[ids[0]] and parts[0][:1] == b" " and ids[0] != self.unknown:
            parts[0] = parts[0][1:]
        try:
            if len(ids) > len(spoken):  # a control piece ends a run of bytes
                raise UnicodeError
            return b"".join(parts).decode()
        except UnicodeError:
            out, run = [], bytearray()
            for i, p in zip(ids.tolist(), parts):
                if self.byte[i]:
                    run += p
                    continue
                out += [_lenient(bytes(run)), p.decode()]
                run.clear()
            return "".join([*out, _lenient(bytes(run))])


def _lenient(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in range(1, 5):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _rows(docs: DataFrame, doc_id: str, column: str, name: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(column).alias(name))


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids, with begin and end ids."""
    path, rows = path or default_path(), _rows(docs, doc_id, text, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in _portions(batch):
                ids = [model.encode(t.as_py()).astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's ids; null ids give a null text."""
    path, rows = path or default_path(), _rows(encoded, doc_id, ids, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [None if not r.is_valid else model.decode(np.asarray(r.values)) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from granary.llm.words import slices

    return slices(batch, 1)


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded whole, and the ids decoded again, in one pass."""
    path, rows = path or default_path(), _rows(docs, doc_id, text, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = model.encode(t.as_py())
                count.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
