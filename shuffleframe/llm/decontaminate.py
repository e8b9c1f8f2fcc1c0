"""Benchmark decontamination by template canonicalisation.

Texts become templates: in the sequence of words, in lower case without marks around them, a number, a
unit after a number and a name (a capitalised word that doesn't begin a sentence) become typed placeholders,
whose words are the slots. Windows of template words of documents and benchmark items are joined by
hash, so that a question is found again with other numbers, names or units. Then a match's slots are
checked: the same word of the item must always stand for the same word of the document, over all windows of a document and an item that lie on one diagonal (the same distance between the
positions in document and item). Diagonals that hold enough of an item's windows are hits. Windows with more
slots than other words are joined by their plain words.

Further windows are joined loosely: those with more slots than other words by their template, if any other word is in
them, and those in which capitalised words that begin sentences are names too, as they may be. A diagonal that only
holds enough windows with these needs as many other words as slots can leave in one window: half its width.

Only windows that may match leave a task: a bitmap of fixed size, made by aggregation from the hashes of all
benchmark windows, is broadcast, and what passes it is hash-joined with the benchmark's windows. The
bitmap never loses a match, whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, named, packed, unpacked

#: Template words of a window; items that are shorter are one window. Part of an item's windows that a hit holds.
WINDOW, SHARE = 8, 0.5
#: Bits of the bitmap of benchmark windows (2 MB).
BITMAP = 1 << 24
#: Words that a worker remembers; this bounds memory and changes no result. Characters of a text that are looked at a time.
REMEMBERED, PIECE = 200_000, 400_000
#: Template words in windows of one diagonal that make a hit whatever the length of the item.
ENOUGH = 13

#: Units of measure and of money, in English, German, French and Spanish.
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres meile meilen metro metros mètre mètres kilometer kilometers kilometre kilometres kilómetros kilomètres
mg g kg t gram grams gramm kilogram kilograms kilogramm gramos grammes kilos lb lbs pound pounds oz ounce ounces ton tons tonne tonnes
ml l liter liters litre litres litros gallon gallons cup cups
s sec second seconds sekunde sekunden segundos secondes min minute minutes minuten minutos h hr hour hours stunde stunden hora horas heure heures day days tag tage día días jour jours week weeks woche wochen semana semanas semaine semaines month months monat monate mes meses mois year years jahr jahre año años an ans
usd eur gbp dollar dollars euro euros cent cents pfund peso pesos
% percent prozent porcentaje pourcent kmh mph km/h m/s kb mb gb tb hz khz mhz ghz w kw v °c °f
""".split())

_SPACE = re.compile(r"\s")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|`´‘’“”„«»¿¡…_~^=+-–—"
_NO_NUMBER = ".,;:!?()[]\"'*#&|"
_CLOSING = "\"')]}»”’*#$%&|"
_END = (".", "!", "?", ":", "…")
NUMBER, UNIT, NAME = 1, 2, 3
_HASHES = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>", seed=7)) for kind in (NUMBER, UNIT, NAME)}
#: Odd factors of the rolling hash, one for each place of a window.
_PLACES = np.array([xxhash.xxh64_intdigest(str(i), seed=11) | 1 for i in range(64)], np.uint64)


class _Words(dict):
    """The number of each word; by number what is known of the word by itself."""

    def __init__(self) -> None:
        self.size = 0

    def start(self, room: int) -> None:
        """Makes room for so many new words, forgetting the known ones if need be."""
        if self.size and len(self) + room <= self.size:
            return
        self.clear()
        self.size = max(REMEMBERED, room)
        self.digest = np.zeros(self.size, np.uint64)  # of the plain form; 0: no template word
        self.kind = np.zeros(self.size, np.int8)  # number or unit by itself, else 0
        self.capital = np.zeros(self.size, bool)
        self.ends = np.zeros(self.size, bool)  # a sentence ends after it

    def __missing__(self, word: str) -> int:
        i = len(self)
        core = word.strip(_STRIP)
        low = core.lower()
        kind = NUMBER if _NUMBER.fullmatch(word.strip(_NO_NUMBER)) else UNIT if low in UNITS or word in UNITS else 0
        self.digest[i] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) | 1 if low or kind else 0
        self.kind[i] = kind
        self.capital[i] = len(core) > 1 and core[0].isupper() and core[1:].islower()
        self.ends[i] = word.rstrip(_CLOSING).endswith(_END)
        self[word] = i
        return i


_WORDS = _Words()


def template(words: list[str], after_number: bool = False, begins: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[bool, bool]]:
    """Template of words that follow others: (hashes of the template words, their kinds or 0, hashes of their plain words, state for the words that follow)."""
    hashes, kinds, plain, _, state = _templates(words, after_number, begins)
    return hashes, kinds, plain, state


def _templates(words: list[str], after_number: bool, begins: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[bool, bool]]:
    """As template, with the kinds of the template in which every capitalised word is a name before the state."""
    if not words:
        nothing, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        return nothing, kinds, nothing, kinds, (after_number, begins)
    _WORDS.start(len(words))
    numbers = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    digest, ends = _WORDS.digest[numbers], _WORDS.ends[numbers]
    first = np.concatenate([[begins], ends[:-1]])
    real = digest != 0  # a word of marks only is no template word, but may end a sentence
    plain, kinds, name = digest[real], _WORDS.kind[numbers][real], (_WORDS.capital[numbers] & ~first)[real]
    number = kinds == NUMBER
    before = np.concatenate([[after_number], number[:-1]])[: len(number)]
    kinds[(kinds == UNIT) & ~before] = 0
    free = np.where((kinds == 0) & _WORDS.capital[numbers][real], np.int8(NAME), kinds)
    kinds[(kinds == 0) & name] = NAME
    return _hashed(kinds, plain), kinds, plain, free, (bool(number[-1]) if len(number) else after_number, bool(ends[-1]))


def _hashed(kinds: np.ndarray, plain: np.ndarray) -> np.ndarray:
    hashes = plain.copy()
    for k, h in _HASHES.items():
        hashes[kinds == k] = h
    return hashes


def template_windows(hashes: np.ndarray, kinds: np.ndarray, plain: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window; one with more slots than other words is hashed by its plain words, as its template says little."""
    found = window_hashes(hashes, width)
    slots = np.concatenate([[0], np.cumsum(kinds > 0)])
    dense = np.flatnonzero(2 * (slots[width:] - slots[:-width]) > width) if len(found) else []
    if len(dense):
        found[dense] = window_hashes(plain, width)[dense]
    return found


def loose_windows(kinds: np.ndarray, plain: np.ndarray, free: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kinds, positions, hashes) of the windows that are joined loosely: those with more slots than other words by their template, and those that hold a name only by free; none without another word."""
    out = []
    for of, wanted in ((kinds, None), (free, kinds != free)):
        slots = np.concatenate([[0], np.cumsum(of > 0)])
        n = slots[width:] - slots[:-width]
        some = 2 * n > width
        if wanted is not None:
            more = np.concatenate([[0], np.cumsum(wanted)])
            some = more[width:] > more[:-width]
        at = np.flatnonzero(some & (n < width))
        if len(at):
            out.append((of, at, window_hashes(_hashed(of, plain), width)[at]))
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29))) * _PLACES[i % 64]
    total ^= total >> np.uint64(32)
    return total * np.uint64(0x9E3779B97F4A7C15)


def _slots(kinds: np.ndarray, plain: np.ndarray, at: int, width: int) -> list[int]:
    """Hashes of the words of a window's slots, in order."""
    return plain[at : at + width][kinds[at : at + width] > 0].view(np.int64).tolist()


def _pieces(text: str | None, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A whole text's template in pieces that overlap by so many words: (position of the first, hashes, kinds, plain)."""
    for base, hashes, kinds, plain, _ in _template_pieces(text, overlap):
        yield base, hashes, kinds, plain


def _template_pieces(text: str | None, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As _pieces, with the kinds of the template in which every capitalised word is a name."""
    state, base = (False, True), 0
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
    text, at = text or "", 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE and (blank := _SPACE.search(text, at + PIECE)):
            to = blank.start()
        *parts, state = _templates(text[at:to].split(), *state)
        at = to
        held = [np.concatenate([h, x]) for h, x in zip(held, parts, strict=True)]
        yield base, *held
        cut = max(0, len(held[0]) - overlap)
        base += cut
        held = [h[cut:] for h in held]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, item_pos, width, n_windows, h, item_slots, item_loose, others) for the windows of each item; others: the positions of the words that are no slots. Items without template words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for i, value in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                words = (value.as_py() or "").split()
                for begins in (True, False):  # in a document, the item's first word may stand within a sentence
                    hashes, kinds, plain, free, _ = _templates(words, False, begins)
                    if i is None or not len(hashes):
                        continue
                    w = min(width, len(hashes))
                    found = template_windows(hashes, kinds, plain, w)
                    sets = [(False, kinds, np.arange(len(found)), found), *((True, *x) for x in loose_windows(kinds, plain, free, w))]
                    for loose, of, at, h in sets:
                        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                            if begins or p == 0:
                                others = (p + np.flatnonzero(of[p : p + w] == 0)).tolist()
                                out.append((i, p, w, len(found), x, _slots(of, plain, p, w), loose, others))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()))
            names = ["item_id", "item_pos", "width", "n_windows", "h", "item_slots", "item_loose", "others"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds_, strict=True)], names=names)

    frame = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return arrow_map(frame, run, "item_id long, item_pos long, width int, n_windows long, h long, item_slots array<long>, item_loose boolean, others array<long>")


def bitmap(windows: DataFrame) -> np.ndarray:
    """A bit for each hash of the windows, as words of 64 bits: BITMAP / 64 rows reach the driver at most, however many windows there are."""
    bit = F.shiftrightunsigned("h", 40)
    words = windows.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITMAP // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.b
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def candidate_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_pos, width, h, doc_slots, doc_loose) for the documents' windows whose hash may be one of windows; every width of windows is looked for."""
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).view(bool)
        for rows in batches:
            out: list[tuple] = []
            for i, value in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                if i is None:
                    continue
                # one template for all widths; windows in the overlap of pieces may come twice
                for base, hashes, kinds, plain, free in _template_pieces(value.as_py(), widths[-1] - 1 if widths else 0):
                    for width in widths:
                        found = template_windows(hashes, kinds, plain, width)
                        sets = [(False, kinds, np.arange(len(found)), found)]
                        if len(found):
                            sets += [(True, *x) for x in loose_windows(kinds, plain, free, width)]
                        for loose, of, at, h in sets:
                            for k in np.flatnonzero(there[(h >> np.uint64(40)).astype(np.int64)]).tolist():
                                p = int(at[k])
                                out.append((i, base + p, width, int(h[k].view(np.int64)), _slots(of, plain, p, width), loose))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds_, strict=True)], names=["doc_id", "doc_pos", "width", "h", "doc_slots", "doc_loose"])

    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return arrow_map(frame, run, "doc_id long, doc_pos long, width int, h long, doc_slots array<long>, doc_loose boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per document and benchmark item that it holds: (doc_id, item_id, windows, n_windows, reparameterised).

    A hit is a diagonal with consistent slots that holds the part share of the item's windows, or as many as ENOUGH words in a row have; windows: how many the best one holds; reparameterised: some slot of it has another word than the item's. Texts are read whole. Null and empty texts, null ids and items without words hit nothing; repeated rows of an id count as one document; no rows on either side give no rows. Items that are equal each give rows.
    """
    items = materialise(item_windows(benchmark, item_id, text, width).distinct())
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, windows long, n_windows long, reparameterised boolean")
    found = candidate_windows(docs, items, id_col, text).distinct()
    met = found.join(items, ["h", "width"]).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    # the slots of a diagonal as pairs of words; a diagonal has no more slots than the item has words, so the sets are bounded
    pairs = F.zip_with("item_slots", "doc_slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    strict = ~F.col("item_loose") & ~F.col("doc_loose")
    aggregates = [F.max("n_windows").alias("n_windows"), F.max("width").alias("width"), F.size(F.array_distinct(F.flatten(F.collect_set("others")))).alias("others")]
    for name, part in (("strict", strict), ("all", F.lit(True))):
        aggregates += [F.count_distinct(F.when(part, F.col("item_pos"))).alias(f"{name}_windows"), F.array_distinct(F.flatten(F.collect_set(F.when(part, pairs)))).alias(f"{name}_pairs")]
    lines = met.groupBy("doc_id", "item_id", "diagonal").agg(*aggregates)

    def holds(name: str):
        one_each = F.size(F.array_distinct(F.transform(f"{name}_pairs", lambda p: p["i"]))) == F.size(f"{name}_pairs")
        least = F.least(F.lit(share) * F.col("n_windows"), F.greatest(F.lit(ENOUGH) - F.col("width") + 1, F.lit(1)))
        return one_each & (F.col(f"{name}_windows") >= least)

    loose = holds("all") & (2 * F.col("others") >= F.col("width"))
    of = lambda column: F.when(loose, F.col(f"all_{column}")).otherwise(F.col(f"strict_{column}"))
    hits = lines.where(holds("strict") | loose).select("doc_id", "item_id", "n_windows", of("windows").alias("windows"), F.exists(of("pairs"), lambda p: p["i"] != p["d"]).alias("reparameterised"))
    return hits.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("n_windows").alias("n_windows"), F.min("reparameterised").alias("reparameterised"))


def without_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item of the benchmark (see contaminated), with all their columns, whose names don't matter.

    Rows are told apart by a number of their own, so rows with a null or repeated id are decided by their own text. The texts are written once and shuffled only if the rows to remove are too many to broadcast.
    """
    numbered = materialise(docs.select(packed(docs.columns), F.monotonically_increasing_id().alias("row")))
    texts = numbered.select("row", unpacked(docs.columns)[docs.columns.index(text)].alias("text"))
    hits = materialise(contaminated(texts, benchmark.select(named("item_id").alias("item_id"), named("text").alias("text")), "row").select(F.col("doc_id").alias("row")).distinct())
    return numbered.join(hits, "row", "left_anti").select(*unpacked(docs.columns))
