"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:
the normaliser (a blank before the text, blanks written as U+2581), the pieces, and
the byte fallback of characters that are no piece. The encoding is the shortest path
of the composition in the tropical semiring.

Unigram models weigh an arc by the negated score of its piece. BPE models have no
arc weights; what they allow is which pieces may follow each other. Merging is local:
a sequence of pieces is the outcome of all merges exactly if each two neighbours, put
together, are merged back into themselves. So the BPE machine's state is the last
piece, an arc to the next one exists if the two are such a pair, and one accepting
path is left. Its agenda (all weights are 0) is a stack, longest pieces first; the
path of longest pieces throughout is tried in one go before.

The composition is cut where no piece can span the input, that is between characters
that are neighbours in no piece, and the paths of the parts are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiquarry.llm.common import documents, free_name

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Parts of the input whose paths a worker keeps, and the longest part that is kept.
KEPT, KEPT_CHARS = 300_000, 64
#: Documents that a worker hands over at a time.
ROWS = 256
UNKNOWN_PENALTY = 10.0
ID = np.int32


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[i]
        value |= (byte & 127) << shift
        i, shift = i + 1, shift + 7
        if byte < 128:
            return value, i


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0
    while i < len(raw):
        key, i = _varint(raw, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(raw, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(raw, i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype=ID).tobytes()


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if normaliser.get(2) or self.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in pieces):
            raise ValueError("only identity normalisers, unigram or BPE models and no user-defined pieces are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.texts = [t for t, _, _ in pieces]
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {t: s for t, s, k in pieces if k == NORMAL}
        self.bytes = {int(t[1:-1], 16): i for i, (t, _, k) in enumerate(pieces) if k == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.packed = {t: _pack([i]) for t, i in self.ids.items()}
        self.plain = np.array([t.replace(BLANK, " ") for t in self.texts], dtype=object)
        self.is_byte = np.zeros(len(self.texts), dtype=bool)
        self.is_byte[list(self.values)] = True
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.trie: dict = {}
        for t in self.ids:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.joined = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        inner = {c for t in self.ids if len(t) > 1 for c in t}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        whole = all(BLANK not in t.lstrip(BLANK) for t in self.ids)
        part = rf"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else rf"{BLANK}*[^{BLANK}]+|{BLANK}+"
        self.parts = re.compile(part if whole else r"(?s).+").findall
        self.runs = re.compile(r"[^\W\d_]+|[\W\d_]+").findall
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.longest = ahocorasick.Automaton()
        for t in self.ids:
            self.longest.add_word(t, t)
        self.longest.make_automaton()
        self.paths = _Paths(self)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)

    def merged(self, text: str) -> list[str]:
        """text after all merges: the best-scored pair first, the leftmost among equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def follows(self, a: str, b: str) -> bool:
        """Whether a and b, put together, are merged back into a and b; kept in pairs[a][b]."""
        if self.n_pairs > KEPT:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        good = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return good

    def arcs(self, text: str, i: int) -> list[str]:
        """Pieces that begin at i, longest last; a character that is none stands for its bytes."""
        node, found = self.trie, []
        for c in text[i:]:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        if not found or len(found[0]) > 1:
            found.insert(0, text[i])
        return found

    def cut(self, text: str) -> list[str]:
        """text, cut between runs of letters and of other characters where no piece spans the cut."""
        runs = self.runs(text)
        parts = [runs[0]]
        for run in runs[1:]:
            if parts[-1][-1] + run[0] in self.joined:
                parts[-1] += run
            else:
                parts.append(run)
        return parts

    def shortest(self, text: str) -> list[str]:
        return self._shortest_bpe(text) if self.kind == BPE else self._shortest_unigram(text)

    def _shortest_bpe(self, text: str) -> list[str]:
        """Depth first, longest pieces first; while these follow each other, no other arc is looked up."""
        path, last, i, end, pairs = [], "", 0, len(text), self.pairs
        for upto, piece in self.longest.iter_long(text):
            if i + len(piece) <= upto:
                break
            known = pairs.get(last)
            good = known.get(piece) if known is not None else None
            if not (self.follows(last, piece) if good is None else good):
                break
            path.append(piece)
            last, i = piece, upto + 1
        if i == end:
            return path
        waiting: list[list[str] | None] = [None] * len(path)
        dead = set()
        choices, known = self.arcs(text, i), pairs.get(last, {})
        while True:
            while choices:
                piece = choices.pop()
                good = known.get(piece)
                if good is None:
                    good = self.follows(last, piece)
                if good and not (dead and (i + len(piece), piece) in dead):
                    break
            else:
                dead.add((i, last))
                choices = waiting.pop()
                i -= len(path.pop())
                if choices is None:
                    choices = self.arcs(text, i)[:-1]
                last = path[-1] if path else ""
                known = pairs.get(last, {})
                continue
            path.append(piece)
            i += len(piece)
            if i == end:
                return path
            waiting.append(choices)
            last = piece
            choices, known = self.arcs(text, i), pairs.get(piece, {})

    def _shortest_unigram(self, text: str) -> list[str]:
        weight, back = [0.0] + [float("inf")] * len(text), [""] * (len(text) + 1)
        for i in range(len(text)):
            for piece in self.arcs(text, i):
                w = weight[i] - self.scores.get(piece, self.worst)
                if w < weight[i + len(piece)]:
                    weight[i + len(piece)], back[i + len(piece)] = w, piece
        path, i = [], len(text)
        while i:
            path.append(back[i])
            i -= len(back[i])
        return path[::-1]

    def outputs(self, piece: str) -> bytes:
        known = self.packed.get(piece)
        if known is not None:
            return known
        if not self.bytes:
            return _pack([self.unknown])
        return _pack([self.bytes[b] for b in piece.encode("utf-8", "replace")])

    def ids_of(self, text: str | None) -> np.ndarray:
        found = b"".join(map(self.paths.__getitem__, self.parts(self.normalise(text)))) if text else b""
        return np.frombuffer(found, dtype=ID)

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(text).tolist()

    def pieces(self, ids: list[int]) -> list[str]:
        return [self.texts[i] for i in ids]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, dtype=ID)
        if self.is_byte[ids].any():
            raw = (bytes((self.values[i],)) if i in self.values else self.texts[i].encode("utf-8") for i in ids.tolist())
            text = b"".join(raw).decode("utf-8", "replace").replace(BLANK, " ")
        else:
            text = "".join(self.plain[ids].tolist())
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Paths(dict):
    """Output (ids of four bytes each) of the shortest path of each part of an input."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, part: str) -> bytes:
        machine = self.machine
        parts = [part] if part[1:].isalpha() and part[:2] in machine.joined else machine.cut(part)
        if len(parts) > 1:
            out = b"".join(map(self.__getitem__, parts))
        else:
            path = machine.shortest(part)
            try:
                out = b"".join(map(machine.packed.__getitem__, path))
            except KeyError:
                out = b"".join(map(machine.outputs, path))
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[part] = out
        return out


_compiled: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The machines of a model, compiled once in a process."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """docs (text) and ids (array of int), n_tokens, n_byte_tokens, round_trip.

    round_trip: the ids decode to the text itself. Whole texts are encoded; null and
    empty texts have no ids. A text that holds U+2581 itself decodes to blanks there.
    Existing columns of these names are replaced, others (or those of keep) and
    repeated rows are kept. docs may be empty.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    names = ("ids", "n_tokens", "n_byte_tokens", "round_trip")
    kept = [c for c in docs.columns if c not in names and (keep is None or c in keep)]
    source = free_name(docs, "_input")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part[source].to_pylist()
                found = [machine.ids_of(t) for t in texts]
                n_tokens = [len(x) for x in found]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_tokens]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                n_bytes = pa.array([int(np.count_nonzero(machine.is_byte[x])) for x in found], pa.int64())
                same = pa.array([machine.decode(x) == (t or "") for x, t in zip(found, texts)], pa.bool_())
                columns = [part[c] for c in kept] + [ids, pa.array(n_tokens, pa.int64()), n_bytes, same]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean").fields])
    return docs.select(*kept, F.col("text").alias(source)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (ids) and decoded, the text of the ids; null ids have null text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(shared.value)
        for batch in batches:
            yield pd.Series([None if ids is None else machine.decode(ids) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", run("ids"))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), keep=["doc_id"])
