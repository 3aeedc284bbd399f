"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled once from a model file. The normaliser rewrites the longest text at each place that the
model's character map knows (read from its double-array trie) and a space to the mark U+2581, and leaves the rest. The
pieces are a trie whose paths read the characters of a piece and write its number. The fallback reads one character
that is no piece and writes the numbers of its UTF-8 bytes. They are composed with each input on the fly: an arc leads
from one place of the normalised text to another, and the encoding is the path of least total weight in the tropical
semiring.

For unigram models an arc weighs minus its piece's score, and places are settled in order. For byte-pair models arcs
weigh nothing, and the pieces are composed with an acceptor of neighbouring pieces as well, so that a state is a place
and the piece before it: b may follow a only if merging the text of a and b by the model's own priorities ends in exactly
(a, b), and weighs infinity otherwise. Merges never cross a boundary that each pair keeps, so exactly one path stays
finite, and it is the sequence that repeated merging gives; as all finite weights are zero, the search for the least
weight may take any open state first, and takes that which is farthest.

Composition stops at places that no piece crosses (before a mark that follows another character, and around
characters without a piece), so the path of a text is the concatenation of its segments' paths; these are kept in a
bounded table.

Defined results: null counts as the empty text, which has no ids; texts of any length are encoded whole, a slice at a
time; a mark U+2581 in a text is read as a space; decoding an encoding gives the normalised text back, which without a
character map is the text; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_column

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_KEEP = 300_000
_SLICE = 1 << 20
#: Fixed values of the model file format: piece types and model types.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]]
    kind: int = _UNIGRAM
    prefix: bool = True
    collapse: bool = True
    charsmap: bytes = b""


def read_model(path: str) -> ModelFile:
    out = ModelFile([])
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL)))
            elif number == 2:
                out.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap, out.prefix, out.collapse = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return out


def read_charsmap(data: bytes) -> dict[str, str]:
    """What each text is rewritten to, from a compiled character map: the size of a double-array trie over UTF-8 bytes,
    the trie, and the results, each ended by a zero byte."""
    if not data:
        return {}
    size = struct.unpack_from("<I", data)[0]
    units, results = struct.unpack_from(f"<{size // 4}I", data, 4), data[4 + size :]

    def children(unit: int) -> int:
        # fixed values: the fields of a unit are 8 bits of label, one bit for a leaf, one for the scale, 22 of offset
        return (unit >> 10) << ((unit & 0x200) >> 6)

    out: dict[str, str] = {}
    open_nodes = [(children(units[0]), b"")]
    while open_nodes:
        base, read = open_nodes.pop()
        for byte in range(1, 256):
            place = base ^ byte
            if place >= len(units) or units[place] & 0x800000FF != byte:
                continue
            below = place ^ children(units[place])
            if units[place] >> 8 & 1:
                at = units[below] & 0x7FFFFFFF
                out[(read + bytes([byte])).decode("utf-8", "surrogateescape")] = results[at : results.index(b"\0", at)].decode()
            open_nodes.append((below, read + bytes([byte])))
    return out


class Normaliser:
    """Rewrites the longest known text at each place; pieces that users defined stand for themselves."""

    def __init__(self, model: ModelFile):
        self.rules = read_charsmap(model.charsmap)
        self.kept = {p for p, _, kind in model.pieces if kind == _USER}
        self.sizes: dict[str, list[int]] = {}
        for text in {*self.rules, *(self.kept if self.rules else ())}:
            if text:
                self.sizes.setdefault(text[0], []).append(len(text))
        self.sizes = {c: sorted(set(sizes), reverse=True) for c, sizes in self.sizes.items()}
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted(self.sizes)) + "]") if self.sizes else None
        self.prefix, self.collapse = model.prefix, model.collapse

    def plain(self, text: str) -> str:
        """The text that an encoding stands for."""
        text = text.replace(MARK, " ")
        if self.starts is not None:
            out, at = [], 0
            while (m := self.starts.search(text, at)) is not None:
                k = m.start()
                out.append(text[at:k])
                found = [text[k : k + n] for n in self.sizes[text[k]]]
                kept = next((x for x in found if x in self.kept), None)
                read = kept or next((x for x in found if x in self.rules), text[k])
                out.append(read if kept else self.rules.get(read, read))
                at = k + len(read)
            out.append(text[at:])
            text = "".join(out)
        return re.sub(" +", " ", text).strip(" ") if self.collapse else text

    def line(self, text: str) -> str:
        """The normalised text with its marks."""
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""


class _Paths(dict):
    """Paths of segments, found when first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, segment):
        if len(self) >= _KEEP:
            self.clear()
        path = self.find(segment)
        if len(segment) <= 64:
            self[segment] = path
        return path


class Transducer:
    def __init__(self, model: ModelFile):
        self.model = model
        self.normaliser = Normaliser(model)
        self.score = {p: s for p, s, kind in model.pieces if kind in (_NORMAL, _USER)}
        self.number = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (_NORMAL, _USER)}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == _BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == _UNKNOWN), 0)
        self.spelling = [self._spell(p, kind) for p, _, kind in model.pieces]
        known = {c for p in self.score for c in p}
        plain = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known)
        crossing = any(MARK in p.lstrip(MARK) for p in self.score)
        # where composition stops
        apart = f"[{plain}]|" if plain else ""
        self.segment = re.compile(f"{apart}[^{plain}]+" if crossing and plain else "(?s:.)+" if crossing else f"{apart}{MARK}+[^{MARK}{plain}]*|[^{MARK}{plain}]+")
        self.follows: dict[tuple[str, str], bool] = {}
        arcs = set(self.score)
        if model.kind == _BPE:
            arcs = {p for p in arcs if self._merge(p) == [p]}
        arcs |= known
        self.trie: dict = {}
        for p in arcs:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self._ready()

    def _ready(self) -> None:
        self.paths = _Paths(self._bpe_path if self.model.kind == _BPE else self._unigram_path)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "paths"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    @staticmethod
    def _spell(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == _CONTROL:
            return b""
        return " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(MARK, " ").encode()

    def _write(self, piece: str) -> list[int]:
        """Numbers that an arc writes: the piece's, or its bytes' where there is no such piece."""
        if piece in self.number:
            return [self.number[piece]]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    # -- byte pairs

    def _merge(self, text: str) -> list[str]:
        """Repeated merging: of neighbours that form a piece, the best-scored, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: str, b: str) -> bool:
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) >= _KEEP:
                self.follows.clear()
            found = self.follows[a, b] = self._merge(a + b) == [a, b]
        return found

    def _bpe_path(self, text: str) -> list[int]:
        """The path of least weight, zero, over states of a place and the piece before it: of the open states the one that
        was opened last goes first, so longer pieces go before shorter ones. Each prefix of a text has one finite path
        only, so a place is left at most once for good."""
        stack: list[tuple[int, str, list[str]]] = []
        pieces: list[str] = []
        at, last = 0, ""
        options = self._arcs(text, 0)
        while True:
            moved = False
            while options:
                piece = options.pop()
                if not last or self._may_follow(last, piece):
                    stack.append((at, last, options))
                    pieces.append(piece)
                    at, last = at + len(piece), piece
                    if at == len(text):
                        return [i for p in pieces for i in self._write(p)]
                    options = self._arcs(text, at)
                    moved = True
                    break
            if moved:
                continue
            at, last, options = stack.pop()
            pieces.pop()

    def _arcs(self, text: str, at: int) -> list[str]:
        """Pieces that the trie reads at a place, the longest last; a character that it lacks alone."""
        out, node = [], self.trie
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out or [text[at]]

    # -- unigrams

    def _unigram_path(self, text: str) -> list[int]:
        weight = [0.0] + [float("inf")] * len(text)
        back = [""] * (len(text) + 1)
        for at in range(len(text)):
            for piece in {*self._arcs(text, at), text[at]}:
                w = weight[at] - self.score.get(piece, self.worst)
                if w < weight[at + len(piece)]:
                    weight[at + len(piece)], back[at + len(piece)] = w, piece
        pieces, at = [], len(text)
        while at:
            pieces.append(back[at])
            at -= len(back[at])
        return [i for p in reversed(pieces) for i in self._write(p)]

    # -- whole texts

    def encode(self, text: str) -> list[int]:
        line = self.normaliser.line(self.normaliser.plain(text))
        if len(line) <= _SLICE:
            return list(chain.from_iterable(map(self.paths.__getitem__, self.segment.findall(line))))
        out: list[int] = []
        for m in self.segment.finditer(line):
            out += self.paths[m.group()]
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Transducer:
    return Transducer(read_model(path))


def encode(docs: DataFrame, transducer: Transducer) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding gives the normalised text back) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(transducer)

    def run(batches):
        machine = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                ids = [machine.encode(t) for t in texts]
                back = [machine.decode(i) == machine.normaliser.plain(t) for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1])))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists, pa.array(back, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, transducer: Transducer) -> DataFrame:
    """doc_id, text of every row of ids. A null or empty list gives the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(transducer)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [sent.value.decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
