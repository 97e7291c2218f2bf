"""Running text scanned for dictionary entries: at each place the longest entry in any inflected form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.batches import slices
from kotonoha.functions.scratch import scratch
from kotonoha.operators.search import search_terms
from kotonoha.plans.deinflect import MOST_CANDIDATES, filter_by_conditions, fitting_rules, rule_index
from kotonoha.plans.rules import Rule, japanese_rules, widened

#: Characters of a source, unless told otherwise.
LONGEST = 24

#: Terms that are broadcast together. A larger dictionary is taken in parts, each with a scan of its own.
PART_TERMS = 250_000

#: Endings that a task remembers.
REMEMBERED = 200_000

#: Places that take their next character together.
TOGETHER = 1 << 18

#: What is told of a place: where it starts, how many characters its source has, the source, and the form of it that was found.
PLACE = {"start": "int", "length": "int", "source": "string", "variant": "string"}

_NONE, _MIX = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)


class Endings:
    """What the ends of texts may go back to, read from their last character to the left.

    An ending is known by its forms (with their conditions): itself, and what rules make of it. Forms
    with which no term and no rule's suffix ends are dropped, so that many endings have the same
    forms, and few places are read far. What a letter to the left makes of an ending is worked out
    once; from then on all places take their next letter together, by a look in a table.
    """

    def __init__(self, rules: list[Rule], terms: dict[str, frozenset[str]], fits: dict[str, frozenset[str]], longest: int):
        if any(rule.front for rule in rules):
            raise ValueError("endings have no rules for prefixes")
        self.index, self.terms, self.fits, self.longest = rule_index(rules), terms, fits, longest
        self.ends = {text[k:] for texts in (self.index, terms) for text in texts for k in range(len(text) + 1)} | {""}
        self.letters = ["", *sorted({letter for end in self.ends for letter in end[:1]})]
        self.codes = np.zeros(0x110000, np.int32)  # 0 for what no term and no rule has
        self.codes[[ord(letter) for letter in self.letters[1:]]] = np.arange(1, len(self.letters))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.forms: list[frozenset] = []
        self.found = np.zeros(1 << 10, bool)
        self.keys, self.values, self.held = np.full(1 << 12, _NONE), np.zeros(1 << 12, np.int32), 0
        self._number(frozenset())
        self.first = self._number(frozenset([("", ())]))

    def _holds(self, form: str, conditions: tuple[str, ...]) -> bool:
        """Whether ``form`` is a term whose rules fit."""
        rules = self.terms.get(form)
        return rules is not None and (not conditions or any(rules & self.fits.get(c, frozenset([c])) for c in conditions))

    def _number(self, forms: frozenset[tuple[str, tuple[str, ...]]]) -> int:
        """The number of the ending that has these forms; 0 if there are none."""
        if (number := self.known.get(forms)) is None:
            number = self.known[forms] = len(self.forms)
            self.forms.append(forms)
            if number == len(self.found):
                self.found = np.concatenate([self.found, np.zeros_like(self.found)])
            self.found[number] = any(self._holds(*form) for form in forms)
        return number

    def _longer(self, ending: int, letter: str) -> int:
        """The number of the ending with one more letter. On a form that was read on only rules as long as it are new, on one that a rule made all are."""
        forms = {(letter + form, conditions): len(form) + 1 for form, conditions in self.forms[ending]} if letter else {}
        items = list(forms)
        for form, conditions in items:  # grows while it is read
            held = widened(conditions)
            for n in range(forms[form, conditions], len(form) + 1):
                for _, rule, before, _ in self.index.get(form[len(form) - n :], ()):
                    made = form[: len(form) - n] + rule.plain, rule.after
                    if (not held or held == before) and made not in forms:
                        forms[made] = 1
                        items.append(made)
            if len(items) > MOST_CANDIDATES:
                raise ValueError(f"over {MOST_CANDIDATES} candidates for one ending: {form!r}")
        return self._number(frozenset(form for form in items if form[0] in self.ends))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free slot that it would take."""
        slots = ((keys * _MIX) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        other = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != _NONE))
        while other.size:
            slots[other] = (slots[other] + 1) % len(self.keys)
            there = self.keys[slots[other]]
            other = other[(there != keys[other]) & (there != _NONE)]
        return slots

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while keys.size:
            slots, first = np.unique(self._slots(keys), return_index=True)  # of keys that would take one slot the first has it
            self.keys[slots], self.values[slots] = keys[first], values[first]
            keys, values = np.delete(keys, first), np.delete(values, first)

    def _read_on(self, endings: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The endings with one more letter each."""
        keys = endings.astype(np.uint64) * np.uint64(len(self.letters)) + letters.astype(np.uint64)
        slots = self._slots(keys)
        if (new := np.unique(keys[self.keys[slots] == _NONE])).size:
            made = np.array([self._longer(int(k) // len(self.letters), self.letters[int(k) % len(self.letters)]) for k in new], np.int32)
            self.held += new.size
            if 2 * self.held > len(self.keys):
                full = self.keys != _NONE
                old = self.keys[full], self.values[full]
                size = 1 << (4 * self.held).bit_length()
                self.keys, self.values = np.full(size, _NONE), np.zeros(size, np.int32)
                self._put(*old)
            self._put(new, made)
            slots = self._slots(keys)
        return self.values[slots]

    def longest_sources(self, texts: Sequence[str]) -> np.ndarray:
        """For each place of the texts, one text behind the other, the length of the longest source that leads to a term whose rules fit, or 0."""
        starts = np.cumsum([0, *map(len, texts)])
        letters = np.insert(self.codes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)], starts[:-1], 0)  # in front of each text stands what ends all
        best = np.zeros(len(letters), np.int32)
        for begin in range(0, len(letters), TOGETHER):
            if len(self.forms) > REMEMBERED:
                self._forget()
            at = np.flatnonzero(letters[begin : begin + TOGETHER]) + begin
            endings = np.full(len(at), self.first, np.int32)
            for n in range(1, self.longest + 1):  # it grows, and so do the ends of a place's sources: the last one is the longest
                endings = self._read_on(endings, letters[at])
                best[at[self.found[endings]]] = n
                at, endings = at[endings > 0] - 1, endings[endings > 0]
                if not at.size:
                    break
        return np.delete(best, starts[:-1] + np.arange(len(texts)))


def _scanned(texts: DataFrame, terms: DataFrame, column: str, rules: list[Rule] | None, forms: Sequence[Callable[[Column], Column]], longest: int, part_terms: int, told: Sequence[str], added: Sequence[str]) -> DataFrame:
    """(row, places) for each text that isn't empty: its columns less the text and those of the names ``added``, and its places."""
    table, fits = rules or japanese_rules(), {c: frozenset(r) for c, r in fitting_rules().items()}
    named = terms.where("term is not null and term <> ''").groupBy("term").agg(F.array_distinct(F.flatten(F.collect_set("inflection_rules"))).alias("rules"))
    parts = max(1, -(-named.count() // part_terms))
    carried = [F.col(f"`{c}`") for c in texts.columns if c.lower() not in added and c != column]
    written = F.array(F.col(column), *[f(F.col(column)) for f in forms])
    same = F.filter(F.array_distinct(written), lambda v: F.length(v) == F.length(F.col(column)))
    scanned = texts.where(F.length(column) > 0).select(F.struct(*carried, F.lit(0).alias("_")).alias("row"), F.length(column).alias("size"), same.alias("written"), F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("array<int>").alias("forms"))
    kind, told = scanned.schema["row"].dataType.simpleString(), [c for c in PLACE if c in told]
    place = f"array<struct<{','.join(f'{c}:{PLACE[c]}' for c in told)}>>"

    def passing(part: int):
        shared = texts.sparkSession.sparkContext.broadcast({r.term: frozenset(r.rules or ()) for r in named.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toLocalIterator()})

        def longest_forms(batch: pa.RecordBatch, written: list[list[str]], endings: Endings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Where each row's places begin, and at each place of all rows the longest source of the parts until now, and the first form that has it."""
            starts = np.cumsum([0, *(len(texts[0]) for texts in written)])
            best, chosen = (np.zeros(starts[-1], np.int32) if part == 0 else batch.column(c).flatten().to_numpy().copy() for c in ("lengths", "forms"))
            for form in range(max(map(len, written))):
                having = [i for i, texts in enumerate(written) if len(texts) > form]
                found = endings.longest_sources([written[i][form] for i in having])
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in having])
                better = (found > best[at]) | ((found == best[at]) & (form < chosen[at]))
                best[at[better]], chosen[at[better]] = found[better], form
            return starts, best, chosen

        def listed(starts: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            endings = Endings(table, shared.value, fits, longest)
            for batch in slices(batches):
                written = batch.column("written").to_pylist()
                starts, best, chosen = longest_forms(batch, written, endings)
                if part < parts - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "size", "written")), listed(starts, best), listed(starts, chosen)], names=["row", "size", "written", "lengths", "forms"])
                    continue
                places = np.flatnonzero(best)
                row = np.searchsorted(starts, places, "right") - 1
                begin, length = places - starts[row], best[places]
                cut = lambda form: pa.array([written[r][f][i : i + n] for r, f, i, n in zip(row.tolist(), form.tolist(), begin.tolist(), length.tolist(), strict=True)], pa.string())
                made = {"start": lambda: pa.array(begin, pa.int32()), "length": lambda: pa.array(length, pa.int32()), "source": lambda: cut(np.zeros_like(places)), "variant": lambda: cut(chosen[places])}
                rows = np.searchsorted(places, starts)
                yield pa.RecordBatch.from_arrays([batch.column("row"), listed(rows, pa.StructArray.from_arrays([made[c]() for c in told], names=told))], names=["row", "places"])

        return run

    for part in range(parts - 1):
        scanned = scanned.mapInArrow(passing(part), f"row {kind}, size int, written array<string>, lengths array<int>, forms array<int>")
    return scanned.mapInArrow(passing(parts - 1), f"row {kind}, places {place}")


def scan_lists(texts: DataFrame, terms: DataFrame, column: str = "text", rules: list[Rule] | None = None, forms: Sequence[Callable[[Column], Column]] = (), longest: int = LONGEST, part_terms: int = PART_TERMS, told: Sequence[str] = tuple(PLACE)) -> DataFrame:
    """As ``scan_texts``, with a row for each text that isn't empty: its columns, and a list ``places`` in the order of their starts."""
    return _scanned(texts, terms, column, rules, forms, longest, part_terms, told, ["places"]).select("row.*", "places").drop("_")


def scan_texts(texts: DataFrame, terms: DataFrame, column: str = "text", rules: list[Rule] | None = None, forms: Sequence[Callable[[Column], Column]] = (), longest: int = LONGEST, part_terms: int = PART_TERMS, told: Sequence[str] = tuple(PLACE)) -> DataFrame:
    """The columns of ``texts`` but for the text itself, with ``start`` (from 0), ``length``, ``source`` and ``variant`` (or those that ``told`` names): a row for each place where a source begins that leads to a term, with the longest one.

    A source leads to a term if deinflection makes one of it whose inflection rules fit. With
    ``forms`` the text as each of them writes it is scanned as well, if it has as many
    characters, so that places are the same; ``variant`` is what was found, in the first of several forms
    as long. Sources have up to ``longest`` characters. Null and empty texts have none. Terms are
    broadcast in parts of ``part_terms``; texts pass one part after the other, and the longest
    source over all parts counts. Nothing is shuffled. Equal rows are scanned each; input columns
    of the added names are left out. The less ``told`` names, the less is moved.
    """
    return _scanned(texts, terms, column, rules, forms, longest, part_terms, told, told).select("row.*", F.inline("places")).drop("_")


def scan_entries(places: DataFrame, terms: DataFrame, entry: Sequence[str], rules: list[Rule] | None = None) -> DataFrame:
    """``places`` of ``scan_texts`` with the entries that they lead to: the columns ``entry``, and ``chains``, each way that leads there once, as names of transforms.

    Each different variant is looked up once, however many places have it; a variant that very many have is a
    hot key of a plain join, which AQE splits. As places are read twice, and a scan is dear, they are written to a scratch table first.
    """
    where = scratch(places.sparkSession)
    places.write.parquet(where)
    places = places.sparkSession.read.schema(places.schema).parquet(where)
    found = filter_by_conditions(search_terms(places, terms, "variant", chains=True, rules=rules))
    ways = found.groupBy(F.col("text").alias("variant"), *entry).agg(F.array_sort(F.collect_set(F.col("chain.transform"))).alias("chains"))
    return places.join(ways, "variant")
