"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question with other values
has the same template.  Windows of template tokens of documents are hash-joined to those
of the benchmark; matched windows then have to agree on what each slot value became, and a
document leaks an item where they cover enough of it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row


#: Template tokens in a window, and how many of them must be literal words.
WINDOW = 5
MIN_LITERAL = 3
#: Share of an item's windows that a leak holds, in one run or in several parts.
COVERAGE = 0.5
#: Windows of the benchmark that go to the workers at once; larger benchmarks take several passes.
WINDOWS_AT_ONCE = 1_000_000
#: Words remembered by a worker.
WORDS_KEPT = 250_000

UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres"
    " g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp"
    " percent degree degrees celsius fahrenheit mph kmh kph hz khz mhz ghz w kw watt watts v volt volts j kj joule joules kb mb gb tb".split()
)
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%$€£]?")
_QUANTITY = re.compile(r"([+-]?\d[\d.,]*)([^\W\d]+)")

LITERAL, NUM, NAME, UNIT, QUANTITY = range(5)
_PLACEHOLDERS = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>")) for k in (NUM, NAME, UNIT, QUANTITY)}
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], dtype=np.uint64)


class Words(dict):
    """What words are on their own: (hash as a literal, kind, 1 capitalised + 2 ends a sentence, value).

    Kept by word, since most of a text repeats.
    """

    def __missing__(self, word: str) -> tuple[int, int, int, str]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = self._read(word)
        return found

    @staticmethod
    def _read(word: str) -> tuple[int, int, int, str]:
        if word.isalpha():
            core = word
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            core = word[:-1]
        else:
            core = _EDGES.sub("", word) or word
        low = core.lower()
        flags = 2 * (word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", ";", "…"))
        kind = LITERAL
        if low in NUMBER_WORDS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif not core.isalpha():
            if _NUMBER.fullmatch(core):
                kind = NUM
            elif (m := _QUANTITY.fullmatch(core)) and m[2].lower() in UNITS:
                kind = QUANTITY
        if core[:1].isupper() and core[1:] == core[1:].lower() and len(core) > 1:
            flags |= 1
        return xxhash.xxh3_64_intdigest(low), kind, flags, low


class Template:
    """The template tokens of one text: hashes, kinds and values; and the hashes of its words as they are."""

    def __init__(self, text: str | None, words: Words):
        read = list(map(words.__getitem__, (text or "").split()))
        n = len(read)
        hashes, kinds, flags, self.values = zip(*read) if n else ((), (), (), ())
        self.kinds, flags = np.array(kinds, dtype=np.int8), np.array(flags, dtype=np.int8)
        self.words = np.array(hashes, dtype=np.uint64)
        self.hashes = self.words.copy()
        starts = np.ones(n, dtype=bool)
        starts[1:] = flags[:-1] & 2 != 0
        self.kinds[(self.kinds == LITERAL) & (flags & 1 != 0) & ~starts] = NAME
        after_number = np.zeros(n, dtype=bool)
        after_number[1:] = self.kinds[:-1] == NUM
        self.kinds[(self.kinds == UNIT) & ~after_number] = LITERAL
        for kind, code in _PLACEHOLDERS.items():
            self.hashes[self.kinds == kind] = code

    def windows(self, size: int, verbatim: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows with enough literal words; all windows of the words as they are if ``verbatim``.

        A name in the first place counts as literal, as it may be the first word of an item.
        """
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        hashes = self.words if verbatim else self.hashes
        total = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            total += hashes[k : k + n] * _STEPS[k]
        places = np.arange(n)
        if not verbatim:
            literal = (self.kinds[:n] == NAME).astype(np.int8)
            for k in range(size):
                literal += self.kinds[k : k + n] == LITERAL
            places = np.flatnonzero(literal >= min(MIN_LITERAL, size))
            total = total[places]
        return places, (total ^ (total >> np.uint64(29))) * _STEPS[0]

    def named_first(self, size: int) -> int:
        """Hash of the first window where the first word counts as a name."""
        other = Template(None, Words())
        other.hashes, other.kinds = self.hashes[:size].copy(), self.kinds[:size].copy()
        other.hashes[0], other.kinds[0] = _PLACEHOLDERS[NAME], NAME
        return int(other.windows(size)[1][0])


class Index:
    """Windows of a block of benchmark items, to find them in documents."""

    def __init__(self, items: Iterable[tuple[object, str | None]]):
        words = Words()
        self.items: list[tuple[object, Template, int, tuple[int, int]]] = []  # id, template, window size, windows (template, verbatim)
        places: dict[tuple[bool, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            template = Template(text, words)
            n = len(template.hashes)
            size = min(WINDOW, n)
            if not size:
                continue
            item = len(self.items)
            at, hashes = self._item_windows(template, size)
            for p, h in zip(at.tolist(), hashes.tolist()):
                places[False, size][h].append((item, p))
            if len(at) and at[0] == 0 and template.kinds[0] == LITERAL:
                places[False, size][template.named_first(size)].append((item, 0))
            verbatim = 0
            if n <= WINDOW or 2 * len(at) < n - size + 1:
                verbatim = n - size + 1
                for p, h in zip(*(x.tolist() for x in template.windows(size, True))):
                    places[True, size][h].append((item, p))
            self.items.append((item_id, template, size, (len(at), verbatim)))
        self.places = {key: dict(x) for key, x in places.items()}
        self._filters = {key: self._filter(np.array(list(x), dtype=np.uint64)) for key, x in self.places.items()}

    @staticmethod
    def _item_windows(template: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of an item, in which names do not count as literal."""
        at, hashes = template.windows(size)
        literal = np.array([np.count_nonzero(template.kinds[p : p + size] == LITERAL) for p in at.tolist()], dtype=np.int64)
        enough = literal >= min(MIN_LITERAL, size)
        return at[enough], hashes[enough]

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << max(16, (8 * len(hashes)).bit_length()), dtype=bool)
        seen[hashes & np.uint64(len(seen) - 1)] = True
        return seen

    def leaks(self, text: str | None, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(item, windows, coverage, slots, slots with another value) of each item that ``text`` leaks."""
        if not text:
            return []
        doc = Template(text, words)
        matches: dict[tuple[int, bool], list[tuple[int, int]]] = defaultdict(list)
        for (verbatim, size), known in self.places.items():
            at, hashes = doc.windows(size, verbatim)
            seen = self._filters[verbatim, size]
            for k in np.flatnonzero(seen[hashes & np.uint64(len(seen) - 1)]).tolist():
                for item, p in known.get(int(hashes[k]), ()):
                    template = self.items[item][1]
                    if p or template.kinds[0] != LITERAL or template.values[0] == doc.values[at[k]]:
                        matches[item, verbatim].append((int(at[k]), p))
        found: dict[int, tuple[int, int, float, int, int]] = {}
        for (item, verbatim), pairs in sorted(matches.items()):
            _, template, size, counts = self.items[item]
            n_windows = counts[verbatim]
            if len({p for _, p in pairs}) < COVERAGE * n_windows:
                continue
            runs = [self._judge(run, doc, template, size) for run in self._runs(pairs, len(template.hashes))]
            agreeing = len(set().union(*(windows for windows, _, _ in runs)))
            if agreeing >= COVERAGE * n_windows and (item not in found or agreeing / n_windows > found[item][2]):
                _, slots, changed = max(runs, key=lambda x: (len(x[0]), x[1], x[2]))
                found[item] = (item, agreeing, agreeing / n_windows, slots, changed)
        return [found[item] for item in sorted(found)]

    @staticmethod
    def _runs(pairs: list[tuple[int, int]], length: int) -> Iterator[list[tuple[int, int]]]:
        """Matches of one copy: those on nearly the same line of the document against the item."""
        pairs = sorted(pairs, key=lambda x: (x[0] - x[1], x[0]))
        run = pairs[:1]
        for x in pairs[1:]:
            if (x[0] - x[1]) - (run[0][0] - run[0][1]) > length // 4:
                yield run
                run = []
            run.append(x)
        yield run

    @staticmethod
    def _judge(run: list[tuple[int, int]], doc: Template, item: Template, size: int) -> tuple[set[int], int, int]:
        """(windows of the item that agree on what its slots became, slots, changed slots)."""
        became: dict[tuple[int, str], Counter] = defaultdict(Counter)
        for d, p in run:
            for k in range(size):
                if item.kinds[p + k] != LITERAL:
                    became[int(item.kinds[p + k]), item.values[p + k]][doc.values[d + k]] += 1
        usual = {slot: max(sorted(n), key=n.__getitem__) for slot, n in became.items()}
        agreeing = {
            p for d, p in run
            if all(item.kinds[p + k] == LITERAL or usual[int(item.kinds[p + k]), item.values[p + k]] == doc.values[d + k] for k in range(size))
        }
        return agreeing, len(usual), sum(value != slot[1] for slot, value in usual.items())


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of at most ``WINDOWS_AT_ONCE`` words each, one item at least."""
    block: list[tuple[object, str]] = []
    size = 0
    rows: Iterator[Row] = benchmark.select(item_col, text_col).orderBy(item_col).toLocalIterator()
    for item_id, text in rows:
        n = len((text or "").split())
        if block and size + n > WINDOWS_AT_ONCE:
            yield Index(block)
            block, size = [], 0
        block.append((item_id, text))
        size += n
    if block:
        yield Index(block)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """A row for each document and benchmark item that it leaks.

    Columns: the ids, n_windows (the item's windows found with slots that agree in each part
    of the document that holds some), coverage (their share), n_slots and n_changed (slot
    values of the largest part, and those that differ from the item's).  Clean documents give no row, nor do null or empty texts and items; an item
    of fewer words than a window is one window.  Items that short, and those of whose windows
    fewer than half have enough literal words, are also looked for word for word; then
    n_windows counts windows of words.  Repeated rows each give their rows.
    """
    spark = docs.sparkSession
    types = [x.schema[c].dataType.simpleString() for x, c in ((docs, id_col), (benchmark, item_col))]
    schema = f"`{id_col}` {types[0]}, `{item_col}` {types[1]}, n_windows bigint, coverage double, n_slots bigint, n_changed bigint"
    found = None
    for index in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, index = Words(), shared.value
            for batch in batches:
                at, out = [], []
                for i, text in enumerate(batch.column(1)):
                    leaks = index.leaks(text.as_py(), words)
                    at.extend([i] * len(leaks))
                    out.extend(leaks)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                columns = [[index.items[x[0]][0] for x in out], *([x[k] for x in out] for k in range(1, 5))]
                kinds = (None, pa.int64(), pa.float64(), pa.int64(), pa.int64())
                if out:
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, item_col, "n_windows", "coverage", "n_slots", "n_changed"])

        part = docs.select(id_col, text_col).mapInArrow(find, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item of ``benchmark``, with their columns, of whatever names.

    Null and empty texts leak nothing and stay, as do repeated rows of a clean text; without
    items all rows stay, and an empty table gives an empty one.
    """
    for index in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(x.as_py(), words) for x in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
