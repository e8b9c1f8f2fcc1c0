"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact without running the merges over the text. A sequence of pieces is what the merges
make of a text if and only if every two adjacent pieces, taken by themselves, are left as they are by
the merges. So the encoder walks over the text with the longest match of an Aho-Corasick automaton,
keeps a match if it is compatible with the piece before it (found by merging the two pieces' text
again, remembered by pair), tries shorter matches else, and goes back where none is left. A position
that it went back from can't end a piece of the result, which a bitfield remembers.

Pieces never hold white space after another character, so a text falls into units (a run of spaces
and the word after it) that are encoded by themselves, and a unit into parts between characters that are
neighbours in no piece; characters without a piece become bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, arrow_map, unpacked, with_text

SPACE = "▁"
#: Units and pairs that a worker remembers, by number and by length; this bounds memory and changes no result.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_LENGTH = 150_000, 200_000, 64
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NEVER = float("-inf")
#: Positions whose matches are found at a time.
_WINDOW = 512


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        else:
            if tag & 7 == 2:
                n, i = _varint(data, i)
            else:
                n = {1: 8, 5: 4}[tag & 7]
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class BpeModel:
    """A model file's pieces, read without the sentencepiece library."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

    def __init__(self, path: str):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        with open(path, "rb") as f:
            data = f.read()
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                piece, kind = x.get(1, b"").decode(), x.get(3, self.NORMAL)
                if kind == self.NORMAL:
                    self.rank[piece] = struct.unpack("<f", x.get(2, bytes(4)))[0]
                    self.ids[piece] = len(self.pieces)
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("only merge-type models with byte fallback are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only models that keep the text as it is, with a space before it, are supported")
        if {self.USER, self.UNUSED} & set(self.kinds):
            raise ValueError("pieces that users defined or that are unused are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with white space after other characters are not supported")
        self.byte_ids = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == self.BYTE:
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._traces: dict[int, tuple[bool, list[float], list[str], list[str]]] = {}
        self._units: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}
        self._neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("only models whose characters are pieces are supported")
        #: Text of each id; None for bytes.
        self.text = [None if k == self.BYTE else " ⁇ " if k == self.UNKNOWN else "" if k == self.CONTROL else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}

    def _trace(self, i: int) -> tuple[bool, list[float], list[str], list[str]]:
        """How the merges make piece i of its characters: whether they do, the merges' ranks, and the first and the last symbol before, between and after them."""
        known = self._traces.get(i)
        if known is None:
            symbols = list(self.pieces[i])
            ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best, at = _NEVER, -1
                for k in range(len(symbols) - 1):
                    rank = self.rank.get(symbols[k] + symbols[k + 1], _NEVER)
                    if rank > best:  # the best-ranked pair first, the leftmost of equals
                        best, at = rank, k
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                ranks.append(best)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            known = self._traces[i] = (len(symbols) == 1, [*ranks, _NEVER], firsts, lasts)
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and then b as they are; a < 0: b by itself.

        Merges both pieces again, side by side, the better-ranked step first (of equals the left one), and looks whether a merge across the border is ever the next.
        """
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            whole, right_ranks, firsts, _ = self._trace(b)
            known = whole
            if whole and a >= 0:
                known, left_ranks, _, lasts = self._trace(a)
                i = j = 0
                while known:
                    left, right = left_ranks[i], right_ranks[j]
                    across = self.rank.get(lasts[i] + firsts[j])
                    if across is not None and across > left and across >= right:
                        known = False
                    elif left == right == _NEVER:
                        break
                    elif left >= right:
                        i += 1
                    else:
                        j += 1
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _matches(self, unit: str, begin: int) -> list[list[tuple[int, int]]]:
        """For each position of the window from begin: its matches, shortest first."""
        end = min(begin + _WINDOW, len(unit))
        found: list[list[tuple[int, int]]] = [[] for _ in range(end - begin)]
        for last, match in self.automaton.iter(unit, begin, min(end + self.longest, len(unit))):
            at = last + 1 - match[0]
            if begin <= at < end:
                found[at - begin].append(match)
        return found

    def _walk(self, unit: str) -> list[int]:
        """Encodes text all of whose characters have pieces."""
        n = len(unit)
        if n > _WINDOW:
            return self._walk_far(unit)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(unit):
            found[last + 1 - match[0]].append(match)
        # a text has one encoding, so a position is come to with one piece before it only, and its matches are used up
        failed, at, last = 0, 0, -1
        ids: list[int] = []
        begins: list[int] = []
        known = self._pairs.get
        while True:
            left = found[at]
            while left:
                length, i = left.pop()
                to = at + length
                if not failed >> to & 1:
                    fits = known((last, i))
                    if fits is None:
                        fits = self.compatible(last, i)
                    if fits:
                        break
            else:  # none fits: no piece of the result ends here
                failed |= 1 << at
                ids.pop()
                at = begins.pop()
                last = ids[-1] if ids else -1
                continue
            ids.append(i)
            begins.append(at)
            if to == n:
                return ids
            at, last = to, i

    def _walk_far(self, unit: str) -> list[int]:
        """As _walk, with the matches of a few windows at a time."""
        n = len(unit)
        windows = {0: self._matches(unit, 0)}
        failed = bytearray(n // 8 + 1)
        ids: list[int] = []
        ends: list[int] = []
        at, last = 0, -1
        compatible = self.compatible
        left = list(windows[0][0])  # matches at this position that weren't tried
        stack: list[list[tuple[int, int]]] = []
        while True:
            while left:
                length, i = left.pop()
                to = at + length
                if not failed[to >> 3] >> (to & 7) & 1 and compatible(last, i):
                    break
            else:  # none fits: no piece of the result ends here
                failed[at >> 3] |= 1 << (at & 7)
                left = stack.pop()
                ids.pop()
                at = ends.pop()
                last = ids[-1] if ids else -1
                continue
            stack.append(left)
            ids.append(i)
            ends.append(at)
            at, last = to, i
            if at == n:
                return ids
            k = at // _WINDOW
            if k not in windows:
                if len(windows) > 8:
                    windows.clear()
                windows[k] = self._matches(unit, k * _WINDOW)
            left = list(windows[k][at - k * _WINDOW])

    def _remembered(self, text: str) -> list[int] | None:
        ids = self._units.get(text)
        return self._older.get(text) if ids is None else ids

    def _remember(self, text: str, ids: list[int]) -> None:
        if len(text) <= REMEMBERED_LENGTH:
            if len(self._units) >= REMEMBERED:
                self._older, self._units = self._units, {}
            self._units[text] = ids

    def _part(self, part: str) -> list[int]:
        """Encodes characters each two of which are neighbours in some piece, or one character."""
        ids = self._remembered(part)
        if ids is None:
            if part in self.ids and len(part) == 1:
                ids = [self.ids[part]]
            elif len(part) == 1:
                ids = [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                ids = self._walk(part)
            self._remember(part, ids)
        return ids

    def encode_unit(self, unit: str) -> list[int]:
        ids = self._remembered(unit)
        if ids is None:
            neighbours = self._neighbours
            cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in neighbours]
            if cuts:
                ids = [x for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True) for x in self._part(unit[a:b])]
                self._remember(unit, ids)
                return ids
            return self._part(unit)
        self._remember(unit, ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without begin and end; none for null and for the empty text."""
        if not text:
            return []
        ids: list[int] = []
        known, encode = self._units.get, self.encode_unit
        for unit in _UNIT.findall(SPACE + text.replace(" ", SPACE)):
            ids += known(unit) or encode(unit)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one for each byte."""
        parts = [self.text[i] for i in ids]
        if None in parts:
            out: list[str] = []
            run = bytearray()
            for i, part in zip(ids, parts, strict=True):
                if part is None:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(part)
            if run:
                out.append(_utf8(run))
            parts = out
        text = "".join(parts)
        first = next((i for i in ids if self.kinds[i] != self.CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == self.NORMAL and text[:1] == " " else text


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_MODELS: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """The model of this file, read once by each worker."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str | None = "ids", decoded: str | None = None, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns keep (default: all) the column ids (array<int>) of each whole text (None: not); with decoded, that column with the text that the ids decode to; with digests, n_tokens, ids_sha256 and decoded_sha256 of both.

    Null and empty texts have no ids and decode to the empty text. Very long texts are encoded whole. Repeated rows give repeated rows, no rows give no rows. Columns of docs that have the name of a new column are replaced; other names don't matter. model_path must exist on every executor.
    One pass without a shuffle; a worker holds the model, a bounded memory of units, and one text at a time.
    """
    kinds = {ids: T.ArrayType(T.IntegerType())} if ids is not None else {}
    kinds |= {decoded: T.StringType()} if decoded is not None else {}
    kinds |= {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in kinds]
    frame, texts = with_text(docs, kept, text)
    made = ["ids"] * (ids is not None) + ["decoded"] * (decoded is not None) + ["n_tokens", "ids_sha256", "decoded_sha256"] * digests
    schema = T.StructType([frame.schema[KEPT], *[T.StructField(c, k) for c, k in zip(made, kinds.values(), strict=True)]])
    arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        decimal = [str(i) for i in range(len(bpe.pieces))]
        for rows in batches:
            columns: dict[str, list] = {c: [] for c in made}
            for value in texts(rows):
                got = bpe.encode(value.as_py())
                back = bpe.decode(got) if digests or decoded is not None else None
                of = {"ids": lambda: got, "decoded": lambda: back, "n_tokens": lambda: len(got), "ids_sha256": lambda: hashlib.sha256(",".join([decimal[i] for i in got]).encode()).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()}  # noqa: B023
                for c, out in columns.items():
                    out.append(of[c]())
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(x, type=arrow.get(c, pa.string())) for c, x in columns.items()]], names=[KEPT, *made])

    return arrow_map(frame, run, schema).select(*unpacked(kept), *[F.col(c).alias(name) for c, name in zip(made, kinds, strict=True)])
