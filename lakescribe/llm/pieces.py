"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces."""

from __future__ import annotations

import functools
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakescribe.llm.common import located, map_arrow, per_text, Place

MARK = "▁".encode()
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNKNOWN_PENALTY = 10.0
_CACHED = 250_000
#: Longer segments are encoded anew each time.
_LONGEST_CACHED = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[bytes, float, int]], dict[str, object]]:
    """Pieces as (UTF-8, score, kind) and the settings of the normalizer."""
    pieces, settings = [], {"name": b"", "charsmap": b"", "add_prefix": 1, "trim_spaces": 1, "escape": 1}
    names = {1: "name", 2: "charsmap", 3: "add_prefix", 4: "trim_spaces", 5: "escape"}
    with open(path, "rb") as f:
        model = f.read()
    for number, value in _fields(model):
        if number == 1:
            one = dict(_fields(value))
            pieces.append((one.get(1, b""), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
        elif number == 3:
            settings |= {names[k]: v for k, v in _fields(value) if k in names}
    return pieces, settings


def double_array(words: Iterable[tuple[bytes, int]]) -> tuple[array, array, array]:
    """base, check and value of a trie: from node s, byte b leads to t = base[s] + b + 1 if check[t] is s."""
    root: dict = {}
    for word, value in words:
        node = root
        for b in word:
            node = node.setdefault(b, {})
        node[-1] = value
    base, check, value = array("i", [0]), array("i", [-1]), array("i", [-1])
    begin, todo = 1, [(0, root)]

    def grow(size: int) -> None:
        more = size - len(base)
        if more > 0:
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    while todo:
        state, node = todo.pop()
        value[state] = node.pop(-1, -1)
        if not node:
            continue
        keys = sorted(node)
        to, taken, first = max(begin, keys[0] + 1), 0, True
        while True:
            grow(to + 258)
            if check[to] >= 0:
                taken += 1
            else:
                if first:
                    begin, first = max(begin, to), False
                at = to - keys[0] - 1
                if all(check[at + k + 1] < 0 for k in keys):
                    break
            to += 1
        if taken >= 0.9 * (to - begin + 1):  # nearly full up to here: later searches begin here
            begin = to
        base[state] = at
        for k in keys:
            check[at + k + 1] = state
            todo.append((at + k + 1, node[k]))
    return base, check, value


class Pieces:
    """Encoder and decoder of one model file, read with its scores as log scores of a unigram model."""

    def __init__(self, path: str) -> None:
        pieces, settings = read_model(path)
        if settings["charsmap"] or settings["trim_spaces"] or not settings["escape"] or not settings["add_prefix"]:
            raise ValueError("not a model whose normalizer keeps texts as they are")
        self.scores = [s for _, s, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        usable = [(p, i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)]
        self.base, self.check, self.value = (x.tolist() for x in double_array(usable))
        self.unknown = min(s for _, s, k in pieces if k == NORMAL) - _UNKNOWN_PENALTY
        #: A piece's text; unknown and control pieces have none.
        self.shown = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") if k in (NORMAL, USER) else b"" for p, _, k in pieces]
        # Segments that no piece crosses can be encoded one by one.
        self.cut_words = not any(_inner_mark(p) for p, _ in usable)
        self.cut_lines = all(b"\n" not in p for p, _ in usable)
        self.known: dict[bytes, array] = {}
        self.older: dict[bytes, array] = {}

    def viterbi(self, data: bytes) -> array:
        """Ids of the best segmentation of escaped UTF-8; of equal scores the longest last piece wins.

        A character that no piece matches costs the unknown score and becomes its bytes.
        """
        base, check, value, scores, unknown = self.base, self.check, self.value, self.scores, self.unknown
        n, size = len(data), len(base)
        lowest = float("-inf")
        best = [lowest] * (n + 1)
        start_of, piece_of = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead, here, node, j = data[i], best[i], 0, i
            single = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            known = False
            while j < n:
                to = base[node] + data[j] + 1
                if to >= size or check[to] != node:
                    break
                node = to
                j += 1
                piece = value[node]
                if piece >= 0:
                    if j == single:
                        known = True
                    score = here + scores[piece]
                    if score > best[j]:
                        best[j] = score
                        start_of[j] = i
                        piece_of[j] = piece
            if not known and here + unknown > best[single]:
                best[single] = here + unknown
                start_of[single] = i
                piece_of[single] = -1
            i = single
        out: list[int] = []
        while n:
            start, piece = start_of[n], piece_of[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_id[b] for b in reversed(data[start:n])]
            n = start
        out.reverse()
        return array("i", out)

    def _segment(self, data: bytes) -> array:
        found = self.older.get(data) or self.viterbi(data)
        if len(data) <= _LONGEST_CACHED:
            if len(self.known) >= _CACHED:  # what was not used lately goes
                self.older = dict(self.known)
                self.known.clear()
            self.known[data] = found
        return found

    def encode(self, text: bytes) -> array:
        """Ids of a whole text; a blank is put in front, as the library does."""
        out = array("i")
        if not text:
            return out
        if not (self.cut_words and self.cut_lines) or MARK in text:
            return self.viterbi(MARK + text.replace(b" ", MARK))
        get, segment = self.known.get, self._segment
        line_end = self.byte_id[10]
        for n, line in enumerate(text.split(b"\n")):
            if n:
                out.append(line_end)
            words = line.split(b" ")
            if n:  # no blank in front of a line's first word
                if words[0]:
                    out.extend(get(words[0]) or segment(words[0]))
                del words[0]
            blanks = b""
            for word in words:
                blanks += MARK
                if word:
                    key = blanks + word
                    out.extend(get(key) or segment(key))
                    blanks = b""
            if blanks:
                out.extend(segment(blanks))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """Text of ids, as bytes: markers become blanks, byte pieces their byte, the blank in front goes."""
        shown = self.shown
        text = b"".join([shown[i] for i in ids])
        return text[1:] if text[:1] == b" " else text


def _inner_mark(piece: bytes) -> bool:
    """Whether a marker stands behind another character."""
    rest = piece
    while rest.startswith(MARK):
        rest = rest[len(MARK) :]
    return MARK in rest


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


_SCHEMA = T.StructType([
    T.StructField("n_pieces", T.LongType()), T.StructField("n_fallback", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
])


def encode_pieces(docs: DataFrame, path: Place, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and ids (array of int) of every whole text; null and empty texts have no ids."""

    def worker():
        model = _pieces(located(path))
        return lambda texts: [[model.encode(x).tolist() for x in texts]]

    return per_text(docs, worker, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), keep, text_col)


def decode_pieces(encoded: DataFrame, path: Place, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The kept columns and the text of ids; bytes that are no UTF-8 become replacement characters; null ids give null."""
    from pyspark.sql import functions as F

    kept = [c for c in keep if c != "text"]

    def run(batches):
        import pyarrow as pa

        model = _pieces(located(path))
        for batch in batches:
            texts = [None if x is None else model.decode(x).decode(errors="replace") for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    narrow = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    return map_arrow(narrow, run, T.StructType([*narrow.schema.fields[:-1], T.StructField("text", T.StringType())]))


def piece_counts(docs: DataFrame, path: Place, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text.

    Returns the kept columns, n_pieces, n_fallback (byte pieces among them), ids_sha256 (of the ids as
    little-endian 32-bit integers) and round_trip (decoding gives the text again; false only where the text
    itself holds the marker character). Null and empty texts have no pieces and count as a round trip. Rows
    are independent; other columns are ignored.
    """

    def worker():
        model = _pieces(located(path))
        fallback = frozenset(model.byte_id.values())

        def work(texts):
            rows = []
            for text in texts:
                ids = model.encode(text)
                rows.append((
                    len(ids), sum(map(fallback.__contains__, ids)), hashlib.sha256(ids.tobytes()).hexdigest(), model.decode(ids) == text))
            return list(zip(*rows, strict=True))

        return work

    return per_text(docs, worker, _SCHEMA, keep, text_col)
