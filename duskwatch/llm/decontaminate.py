"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of template tokens are hashed and joined
with those of the benchmark. Matches on one diagonal (place in the text minus place in the item)
form an alignment. A window with the item's own slot values counts; one with other values counts if
equal slot values of the item always stand for equal values in the alignment, so a question with
other numbers and names is still found, while unrelated texts with like templates are not. A text is contaminated by an item when alignments cover enough of its windows.

On request the windows of the plain lower-cased words are hashed as well, so that a copy is found whatever became
of its capitals. An item is known by its text: rows with one id and two texts are two items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.rows import drop_rows
from duskwatch.llm.tokens import BYTE_CODE, LETTER, LOWER_CODE, U64, Words, list_column, mix, slices

#: Distinct benchmark windows up to which tasks filter by the list itself; beyond it all windows are joined.
LISTED_WINDOWS = 2_000_000
LEAST_LITERALS = 3
#: Bytes of text worked on together; a longer text stands alone.
SLICE = 1 << 17
# Words that count as units after a number, and number words, in English, German, French and Spanish.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yards mi mile miles mg g kg lb lbs oz pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years k c f degree degrees percent dollar dollars "
    "cent cents euro euros usd eur mph kmh w kw v volt volts j kj cal kcal hz khz mhz ghz kb mb gb tb "
    "gramm kilo kilogramm pfund tonne tonnen sekunde sekunden minute minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren "
    "grad prozent meile meilen fuß zoll zentimeter kilometer millimeter "
    "gramme grammes kilogramme kilogrammes mètre mètres kilomètre kilomètres centimètre centimètres seconde secondes heure heures jour jours semaine semaines "
    "mois an ans année années degré degrés pouce pouces pied pieds mille milles centime centimes "
    "gramo gramos kilogramo kilogramos metro metros kilómetro kilómetros centímetro centímetros litro litros segundo segundos minuto minutos hora horas día días "
    "semana semanas mes meses año años grado grados pulgada pulgadas pie pies milla millas céntimo céntimos dólar dólares"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig "
    "fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta "
    "cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones"
).split()
# Words after which a unit stands without a number of its own.
PER = "per pro par por".split()
# German words after which a capital letter starts a noun, not a name.
BEFORE_NOUNS = (
    "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner im am zum zur vom beim ins ans jede jeder jedes jeden "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend"
).split()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALNUM = LETTER | _DIGIT
_NUMERIC = _DIGIT.copy()
_NUMERIC[np.frombuffer(b".,:/-", np.uint8)] = True
_ASCII_UPPER = np.zeros(256, bool)
_ASCII_UPPER[65:91] = True
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?:;\"'()|", np.uint8))
_GLUED = re.compile(r"(\d)(?=[^\W\d_])")
NUMBER, UNIT, NAME = (BYTE_CODE[i] for i in (201, 202, 203))


def _word_list(words: list[str]) -> np.ndarray:
    w = Words(pa.array([" ".join(words)]))
    return np.sort(w.hashes())


_UNIT_HASHES, _NUMBER_HASHES, _NOUN_HASHES, _PER_HASHES = (_word_list(x) for x in (UNITS, NUMBER_WORDS, BEFORE_NOUNS, PER))


def _split_glued(column: pa.Array) -> pa.Array:
    """A digit followed by a letter is two tokens (``5kg``); only texts that have one are rewritten."""
    w = Words(column)
    if not len(w.data):
        return column
    pair = np.flatnonzero(_DIGIT[w.data[:-1]] & LETTER[w.data[1:]])
    rows = np.unique(np.searchsorted(w.offsets, pair, "right") - 1)
    if not len(rows):
        return column
    texts = column.to_pylist()
    for r in rows:
        texts[r] = _GLUED.sub(r"\1 ", texts[r])
    return pa.array(texts, pa.string())


class Template:
    """Template tokens of the texts of a slice: hash, value hash and whether it is a slot; ``doc`` and ``first`` as in ``Words``."""

    def __init__(self, column: pa.Array):
        w = Words(_split_glued(column))
        data, n = w.data, len(w.data)
        place = np.arange(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)
        alnum = np.concatenate([_ALNUM[data], [False]])
        kind = place.dtype.type
        start = np.minimum.accumulate(np.where(alnum, place, kind(n))[::-1])[::-1][w.start].astype(np.int64)
        end = np.maximum.accumulate(np.where(alnum, place, kind(-1)))[w.end - 1].astype(np.int64) + 1 if len(w) else w.end
        del place, alnum
        real = start < w.end
        start, end, doc = start[real], end[real], w.doc[real]
        raw_end = w.end[real]
        count = lambda flag: np.concatenate([np.zeros(1, kind), np.cumsum(flag, dtype=kind)])
        value = w.span_hashes(start, end)
        numeric, digits, lines = count(_NUMERIC[data]), count(_DIGIT[data]), count(data == 10)
        number = (numeric[end] - numeric[start] == end - start) & (digits[end] > digits[start]) | _among(value, _NUMBER_HASHES)
        follows = np.zeros(len(doc), bool)
        follows[1:] = doc[1:] == doc[:-1]
        unit = np.zeros(len(doc), bool)
        unit[1:] = (number | _among(value, _PER_HASHES))[:-1] & follows[1:] & _among(value, _UNIT_HASHES)[1:]
        head = data[start] if len(start) else data[:0]
        second = data[np.minimum(start + 1, n - 1)] if len(start) else data[:0]
        latin = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        next_ = np.where(latin, start + 2, start + 1)
        lower = (next_ < end) & ~_ASCII_UPPER[data[np.minimum(next_, n - 1)]] if n else follows
        inside = follows.copy()
        if len(doc):
            inside[1:] &= ~_STOP[data[raw_end[:-1] - 1]] & (lines[start[1:]] == lines[raw_end[:-1]]) & ~_among(value, _NOUN_HASHES)[:-1]
        name = (_ASCII_UPPER[head] | latin) & lower & inside & ~number & ~unit
        token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
        # neighbouring names are one slot, with the value of the last
        more = np.zeros(len(doc), bool)
        more[1:] = name[1:] & name[:-1] & follows[1:]
        lead = np.flatnonzero(~more)
        last = np.append(lead[1:], len(doc))[: len(lead)] - 1
        self.token, self.value, self.doc = token[lead], value[last], doc[lead]
        # all names of the slot in their order, for windows that must be equal word for word
        run = mix(value + (np.arange(len(doc)) - np.repeat(lead, last - lead + 1)).astype(U64) * BYTE_CODE[39])
        self.exact = mix(np.add.reduceat(run, lead) + token[lead]) if len(lead) else token
        self.slot = (number | unit | name)[lead]
        self.rows = w.rows
        self.first = self._first(self.doc)
        self.words, self.word_doc, self.word_first = value, doc, self._first(doc)

    def _first(self, doc: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.rows))])

    def word_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of plain words inside one text."""
        at = np.arange(len(self.words))
        at = at[at + size <= self.word_first[self.word_doc + 1]]
        total = np.zeros(len(at), U64)
        for k in range(size):
            total += self.words[at + k] * BYTE_CODE[60 + k % 100]
        return at, mix(total + U64(size) + BYTE_CODE[37])

    def windows(self, size: int, least: int, sparse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of windows inside one text that hold at least ``least`` literal tokens.

        With ``sparse`` also of the others, whose hash covers the slot values.
        """
        at = np.arange(len(self.token))
        at = at[at + size <= self.first[self.doc + 1]]
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        rich = literal[at + size] - literal[at] >= least
        if not sparse:
            at, rich = at[rich], rich[rich]
        total = np.zeros(len(at), U64)
        for k in range(size):
            total += self.token[at + k] * BYTE_CODE[40 + k]
        out = mix(total + U64(size))
        poor = at[~rich]
        if len(poor):
            valued = np.where(self.slot, self.exact, self.token)
            total = np.zeros(len(poor), U64)
            for k in range(size):
                total += valued[poor + k] * BYTE_CODE[40 + k]
            out[~rich] = mix(total + U64(size) + BYTE_CODE[38])
        return at, out


def _among(value: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, value), len(sorted_) - 1)] == value


def _slots(t: Template, at: np.ndarray, size: int) -> pa.Array:
    """Values of the slots of each window."""
    grid = at[:, None] + np.arange(size)
    flag = t.slot[grid] if len(at) else np.zeros((0, size), bool)
    return list_column(t.value[grid][flag] if len(at) else t.value[:0], np.concatenate([[0], np.cumsum(flag.sum(1))]).astype(np.int64))


def _item_windows(size: int, sparse: bool, verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = Template(batch.column("text").slice(i, 1).fill_null(""))
                for plain, tokens in ((False, t.token), (True, t.words))[: 1 + verbatim]:
                    n = min(size, len(tokens))
                    if not n:
                        continue
                    at, h = t.word_windows(n) if plain else t.windows(n, min(LEAST_LITERALS, max(1, n - 1)), sparse)
                    rows = len(at)
                    slots = _slots(t, at, n) if not plain else _no_slots(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("item").take(pa.array(np.full(rows, i))), pa.array(np.full(rows, plain)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)),
                            pa.array(np.full(rows, n, np.int32)), pa.array(np.full(rows, rows, np.int64)), slots,
                        ],
                        ["item", "plain", "window", "item_at", "size", "windows", "item_slots"],
                    )

    return run


def _no_slots(rows: int) -> pa.Array:
    return list_column(np.zeros(0, U64), np.zeros(rows + 1, np.int64))


def _text_windows(sizes: list[tuple[bool, int]], listed, sparse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if listed is None else listed.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text, SLICE):
                t = Template(text.slice(low, high - low))
                for plain, n in sizes:
                    at, h = t.word_windows(n) if plain else t.windows(n, min(LEAST_LITERALS, max(1, n - 1)), sparse)
                    if wanted is not None:
                        ok = _among(h, wanted)
                        at, h = at[ok], h[ok]
                    doc, first = (t.word_doc, t.word_first) if plain else (t.doc, t.first)
                    row = pa.array(doc[at] + low)
                    place = (at - first[doc[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array(np.full(len(at), plain)), pa.array(h.view(np.int64)),
                            pa.array(place), _no_slots(len(at)) if plain else _slots(t, at, n),
                        ],
                        ["doc_id", "text_hash", "plain", "window", "text_at", "text_slots"],
                    )

    return run


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of an alignment that counts; ``same`` if all slot values of the alignment are the item's own.

    A window with the item's own values counts whatever the others hold; one with other values does
    unless a value of its slots in the item stands for two values in the alignment.
    """
    for batch in batches:
        place, row = _flat(batch.column("places"))
        item, window = _flat(_flat(batch.column("item_slots"))[0])
        item = item.to_numpy(zero_copy_only=False)
        text = _flat(_flat(batch.column("text_slots"))[0])[0].to_numpy(zero_copy_only=False)
        owner = row[window]
        order = np.lexsort((text, item, owner))
        value = np.ones(len(order), bool)
        value[1:] = (owner[order][1:] != owner[order][:-1]) | (item[order][1:] != item[order][:-1])
        pair = value.copy()
        pair[1:] |= text[order][1:] != text[order][:-1]
        group = np.cumsum(value) - 1
        torn = np.zeros(len(order), bool)
        torn[order] = np.bincount(group, pair)[group] > 1 if len(order) else False
        other, conflict = np.zeros(len(row), bool), np.zeros(len(row), bool)
        other[window[item != text]] = True
        conflict[window[torn]] = True
        same = np.ones(batch.num_rows, bool)
        same[row[other]] = False
        keep = ~(other & conflict)
        at = pa.array(row[keep])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in ("doc_id", "text_hash", "item", "plain")), pa.array(same[row[keep]]), place.filter(pa.array(keep))],
            ["doc_id", "text_hash", "item", "plain", "same", "place"],
        )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, coverage: float = 0.5, sparse: bool = False, verbatim: bool = False
) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, windows, coverage, kind) of each text and item it gives away.

    ``kind`` is copy when all slot values of an alignment are the item's own, else reparameterised. Items shorter than
    ``size`` tokens are one window; items and texts without tokens match nothing, null counts as
    empty. Rows equal in id and text give one result, on both sides; an item_id with several texts gives a result for each
    text that is found, and items without id count like others, under a null id. Windows with fewer than ``LEAST_LITERALS`` literal
    tokens match only with equal slot values, which ``sparse`` asks for; without it they are left out on
    both sides, and an item that has no others is never found. ``verbatim`` also counts windows of plain words,
    A-Z lower-cased, as copies; of both counts the larger coverage holds. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    named = settle(benchmark.select("item_id", "text", F.xxhash64("text").alias("item")).distinct())
    shape = "item long, plain boolean, window long, item_at int, size int, windows long, item_slots array<long>"
    items = settle(named.select("item", "text").dropDuplicates(["item"]).mapInArrow(_item_windows(size, sparse, verbatim), shape))
    sizes = [tuple(r) for r in items.select("plain", "size").distinct().collect()]
    distinct = items.select("window").distinct()
    few = distinct.limit(LISTED_WINDOWS + 1).count() <= LISTED_WINDOWS
    # a window that many items share is one window but many rows: what is broadcast is counted in rows
    small = F.broadcast if items.limit(LISTED_WINDOWS + 1).count() <= LISTED_WINDOWS else (lambda df: df)
    listed = None
    if few:
        values = distinct.toArrow().column("window").to_numpy().view(U64) if sizes else np.zeros(0, U64)
        listed = spark.sparkContext.broadcast(np.sort(values) if len(values) else np.zeros(1, U64))
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _text_windows(sizes, listed, sparse), f"doc_id {key}, text_hash long, plain boolean, window long, text_at int, text_slots array<long>"
    )
    texts = settle(texts if few else texts.join(distinct, "window", "left_semi"))
    if listed is not None:
        listed.destroy()
    # enough windows can only match if one of an item's rarest does: those name the pairs, the common ones meet known pairs only
    shared = items.groupBy("window").agg(F.count_distinct("item").alias("_items"))
    order = Window.partitionBy("item", "plain").orderBy("_items", "window", "item_at")
    rare = items.join(small(shared), "window").withColumn("_rank", F.row_number().over(order))
    rare = rare.where(F.col("_rank") <= F.col("windows") - F.ceil(F.col("windows") * coverage) + 1).select("window", "item").distinct()
    pairs = texts.select("doc_id", "text_hash", "window").join(small(settle(rare)), "window").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("item").alias("_item")
    )
    pairs = settle(pairs.distinct())
    met = texts.join(pairs, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_hash"] == F.col("_hash"))).drop("_id", "_hash")
    own = items.select(F.col("item"), F.col("window").alias("_window"), "item_at", "item_slots")
    hit = met.join(small(own), (F.col("_item") == own["item"]) & (met["window"] == F.col("_window")))
    lined = hit.select(
        "doc_id", "text_hash", "item", "plain", (F.col("text_at") - F.col("item_at")).alias("diagonal"), F.struct("item_at", "item_slots", "text_slots").alias("w")
    )
    aligned = lined.groupBy("doc_id", "text_hash", "item", "plain", "diagonal").agg(F.collect_set("w").alias("w"))
    kept = aligned.select(
        "doc_id", "text_hash", "item", "plain", F.col("w.item_at").alias("places"), F.col("w.item_slots").alias("item_slots"), F.col("w.text_slots").alias("text_slots")
    ).mapInArrow(_matches, f"doc_id {key}, text_hash long, item long, plain boolean, same boolean, place int")
    found = kept.groupBy("doc_id", "text_hash", "item", "plain").agg(F.count_distinct("place").alias("matched"), F.bool_or("same").alias("copy"))
    totals = items.select("item", "plain", "windows").distinct()
    rated = found.join(small(totals), ["item", "plain"]).withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage)
    best = rated.groupBy("doc_id", "text_hash", "item").agg(
        F.max_by(F.struct("matched", "windows", "coverage", "copy"), F.struct("coverage", (~F.col("plain")).alias("template"))).alias("b")
    )
    return best.join(small(named.select("item", "item_id").distinct()), "item").select(
        "doc_id", "text_hash", "item_id", "b.matched", "b.windows", "b.coverage", F.when(F.col("b.copy"), "copy").otherwise("reparameterised").alias("kind")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that give no benchmark item away."""
    return drop_rows(docs, settle(find_leaks(docs, benchmark, **options).select("doc_id", "text_hash")))
