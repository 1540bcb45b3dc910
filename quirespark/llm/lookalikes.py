"""Texts that look ordinary but aren't stored in ordinary characters, and their one consistent form.

The texts of a batch are one array of code points. Tables by code point give what each becomes (joined or plain form, width,
space, hyphen, nothing), and how many code points that is; the results are gathered at once. Marks are ordered and joined
with their letters, and the letters of a word brought to one script, by operations on whole arrays too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple
from unicodedata import category, combining, decomposition, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.garbled import is_garbled

OTHER, LATIN, CYRILLIC, GREEK, ARMENIAN, ARABIC, DEVANAGARI, THAI, KANA, HAN = range(10)
_SCRIPT_NAMES = {LATIN: "Latin", CYRILLIC: "Cyrillic", GREEK: "Greek", ARMENIAN: "Armenian", ARABIC: "Arabic", DEVANAGARI: "Devanagari", THAI: "Thai", HAN: "Han"}
#: Scripts whose letters look alike.
_ALIKE = (LATIN, CYRILLIC, GREEK, ARMENIAN)
FINE, FORM, WIDE, INVISIBLE, JOINER, CUSTOM = range(6)

# Letters that look alike, and letters of neighbouring languages that stand for customary ones.
TO_LATIN = dict(zip("АВСЕНІЈКМОРЅТХУЗасеорхуіјѕԁԛԝһӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυχαɑɡıſ", "ABCEHIJKMOPSTXY3aceopxyijsdqwhlABEZHIKMNOPTYXoivpuxaagis"))
TO_CYRILLIC = dict(zip("ABCEHKMOPTXYaceopxykmtΑΒΕΗΚΜΟΡΤΧορ", "АВСЕНКМОРТХУасеорхукмтАВЕНКМОРТХор"))
CUSTOMARY = {"ی": "ي", "ک": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه", "ۀ": "ة", "ێ": "ي", "ۍ": "ي", "ـ": ""}
HYPHENS = "‐‑‒−﹣⁃­"
#: Forms that are customary in spite of a compatibility form.
KEPT = set("…ªº№™²³¹½¼¾´¨¸¯·‼⁇⁈⁉℃") | set(map(chr, range(0x3001, 0x3012))) | {"ำ", "ຳ"}
FULLWIDTH_MARKS = set("，：；！？（）［］｛｝～．＂＇／")


def _kind(char: str) -> int:
    if char in "‌‍":
        return JOINER
    if char in HYPHENS:
        return FORM if char != "­" else INVISIBLE
    if char in CUSTOMARY:
        return CUSTOM
    what = category(char)
    if what == "Cf" or char in "͏ᅟᅠ឴឵⠀ㅤﾠ" or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return INVISIBLE
    if what == "Cc" and char not in "\t\n\r":
        return INVISIBLE
    if char == "　" or char in FULLWIDTH_MARKS:
        return WIDE
    if what == "Zs" and char != " " or char in "  ":
        return FORM
    if char not in KEPT and normalize("NFKC", char) != char:
        return FORM
    return FINE


#: Letters that can be another alphabet's by themselves, where all other words are of that; numerals can't.
_LONE_LATIN = set("ABCEHKMOPTXYaceopxy") - set("IVXLCDM")
_TOP = 0x110000


class Tables(NamedTuple):
    kinds: np.ndarray
    scripts: np.ndarray
    classes: np.ndarray  # canonical combining classes
    in_words: np.ndarray  # letters, marks and apostrophes
    letters: np.ndarray
    form_at: np.ndarray  # where the plain form of a code point begins in forms, and its length
    form_size: np.ndarray
    apart_at: np.ndarray  # the same of its letter and marks
    apart_size: np.ndarray
    forms: np.ndarray
    pairs: np.ndarray  # letter * 2**21 + mark, sorted, and what they join to
    joined: np.ndarray
    to_latin: np.ndarray
    to_cyrillic: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    """The tables by code point, from the properties of Unicode and the fixed values above."""
    kinds, scripts, classes = (np.zeros(_TOP, dtype=np.uint8) for _ in range(3))
    in_words, letters = np.zeros(_TOP, dtype=bool), np.zeros(_TOP, dtype=bool)
    form_at, form_size, apart_at, apart_size = (np.zeros(_TOP, dtype=np.int64) for _ in range(4))
    every = [c for c in map(chr, range(0x80, _TOP)) if not 0xD800 <= ord(c) < 0xE000]
    assigned = [c for c in every if ord(c) < 0x3400 or 0xF900 <= ord(c) < 0x20000 or 0x2F800 <= ord(c) < 0x2FA20 or 0xE0000 <= ord(c) < 0xE0200]
    forms: list[int] = []
    pairs: dict[int, int] = {}
    for char in [*map(chr, range(0x80)), *assigned]:
        at = ord(char)
        kinds[at], classes[at] = _kind(char), combining(char)
        plain = _form(char)
        form_at[at], form_size[at] = len(forms), len(plain)
        forms += map(ord, plain)
        apart = normalize("NFD", char)
        apart_at[at], apart_size[at] = len(forms), len(apart)
        forms += map(ord, apart)
        parts = decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<") and normalize("NFC", char) == char:
            pairs[int(parts[0], 16) * 2**21 + int(parts[1], 16)] = at
    flat = "".join(map(chr, range(0x80))) + "".join(every)
    for script, name in _SCRIPT_NAMES.items():
        for found in regex.finditer(rf"[\p{{Script={name}}}--\p{{M}}]+", flat, regex.V1):
            scripts[list(map(ord, found[0]))] = script
    for found in regex.finditer(r"[\p{Script=Hiragana}\p{Script=Katakana}]+", flat):
        scripts[list(map(ord, found[0]))] = KANA
    scripts[[ord(c) for c in "ªº"]] = OTHER
    for found in regex.finditer(r"[\p{L}\p{M}'’]+", flat):
        in_words[list(map(ord, found[0]))] = True
    for found in regex.finditer(r"\p{L}+", flat):
        letters[list(map(ord, found[0]))] = True
    to_latin, to_cyrillic = np.arange(_TOP, dtype=np.uint32), np.arange(_TOP, dtype=np.uint32)
    to_latin[[ord(c) for c in TO_LATIN]] = [ord(c) for c in TO_LATIN.values()]
    to_cyrillic[[ord(c) for c in TO_CYRILLIC]] = [ord(c) for c in TO_CYRILLIC.values()]
    keys = np.array(sorted(pairs), dtype=np.int64)
    joined = np.array([pairs[k] for k in sorted(pairs)], dtype=np.uint32)
    return Tables(kinds, scripts, classes, in_words, letters, form_at, form_size, apart_at, apart_size, np.array(forms, dtype=np.uint32), keys, joined, to_latin, to_cyrillic)


def _form(char: str) -> str:
    """What becomes of a code point that isn't ordinary."""
    if char in CUSTOMARY:
        return CUSTOMARY[char]
    if char in HYPHENS:
        return "" if char == "\u00ad" else "-"
    if category(char) == "Zs" or char in "  ":
        return " "
    return normalize("NFKC", char)


class Texts(NamedTuple):
    """Texts as code points, and the text each one is in."""

    points: np.ndarray
    row: np.ndarray
    rows: int

    def same_row(self) -> np.ndarray:
        """Whether a code point has one of its own text before it."""
        held = np.zeros(len(self.points), dtype=bool)
        held[1:] = self.row[1:] == self.row[:-1]
        return held


def from_arrow(values: pa.Array) -> Texts:
    """The code points of an array of strings; null ones have none."""
    values = values.cast(pa.large_string())
    _, ends, content = values.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(content, dtype=np.uint8)[bounds[0] : bounds[-1]] if content is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    counts = np.diff(np.searchsorted(lead, bounds - bounds[0]))
    return Texts(points, np.repeat(np.arange(len(values)), counts), len(values))


def to_arrow(texts: Texts) -> pa.Array:
    """The array of strings that some code points are."""
    points = texts.points
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(np.bincount(texts.row, weights=sizes, minlength=texts.rows).astype(np.int64))])
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(texts.rows, pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())


def _expanded(texts: Texts, which: np.ndarray, at: np.ndarray, size: np.ndarray) -> Texts:
    """texts with some code points replaced by those of forms that a table says."""
    forms, points = tables().forms, texts.points
    lengths = np.where(which, size[points], 1)
    source = np.repeat(np.arange(len(points)), lengths)
    starts = np.cumsum(lengths) - lengths
    within = np.arange(len(source)) - starts[source]
    out = points[source]
    taken = which[source]
    out[taken] = forms[at[out[taken]] + within[taken]]
    return Texts(out, texts.row[source], texts.rows)


def composed(texts: Texts) -> Texts:
    """texts with all marks in their canonical order and joined with their letters."""
    t = tables()
    marks = t.classes[texts.points] > 0
    if marks.any():  # letters before marks are taken apart, as a mark may go before theirs
        before = np.concatenate([marks[1:] & (texts.row[1:] == texts.row[:-1]), [False]]) | marks
        texts = _expanded(texts, before, t.apart_at, t.apart_size)
        classes = t.classes[texts.points].astype(np.int64)
        starters = (classes == 0) | ~texts.same_row()
        run = np.cumsum(starters)
        order = np.lexsort((np.where(starters, 0, classes), run))
        texts = texts._replace(points=texts.points[order])
    while len(texts.points):
        points = texts.points.astype(np.int64)
        classes = t.classes[texts.points].astype(np.int64)
        fresh = ~texts.same_row()
        starters = (classes == 0) | fresh
        places = np.arange(len(points))
        # the starter before a code point, and whether nothing between blocks it
        last = np.maximum.accumulate(np.where(starters, places, 0))
        base = np.where(starters, np.concatenate([[0], last[:-1]]), last)
        between = places - base
        prior = np.concatenate([[0], classes[:-1]])
        free = (between == 1) | ((classes > prior) & ~starters)
        free &= ~fresh & (classes[base] == 0)
        key = points[base] * 2**21 + points
        at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        joins = free & (t.pairs[at] == key)
        made = t.joined[at].astype(np.int64)
        # Korean syllables by rule
        first, second = points[base], points
        lv = free & (first >= 0x1100) & (first <= 0x1112) & (second >= 0x1161) & (second <= 0x1175)
        lvt = free & (first >= 0xAC00) & (first <= 0xD7A3) & ((first - 0xAC00) % 28 == 0) & (second > 0x11A7) & (second <= 0x11C2)
        made = np.where(lv, 0xAC00 + ((first - 0x1100) * 21 + second - 0x1161) * 28, np.where(lvt, first + second - 0x11A7, made))
        joins |= lv | lvt
        if not joins.any():
            break
        _, chosen = np.unique(base[joins], return_index=True)  # the first of each letter; the others in the next rounds
        chosen = places[joins][chosen]
        chosen = chosen[~np.isin(base[chosen], chosen)]
        out = texts.points.copy()
        out[base[chosen]] = made[chosen]
        kept = np.ones(len(out), dtype=bool)
        kept[chosen] = False
        texts = Texts(out[kept], texts.row[kept], texts.rows)
    return texts


def ordinary_texts(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The texts in ordinary characters, and which of them were stored in others."""
    t = tables()
    points, row, rows = texts
    kinds, scripts = t.kinds[points], t.scripts[points]
    odd = np.zeros(rows, dtype=bool)
    if not len(points):
        return texts, odd
    east = np.zeros(rows, dtype=bool)
    east[row[np.isin(scripts, (KANA, HAN))]] = True
    prior = np.concatenate([[0], points[:-1]])
    prior[~texts.same_row()] = 0
    indic = (prior >= 0x900) & (prior <= 0x97F)
    gone = (kinds == INVISIBLE) | (kinds == JOINER) & ~indic
    changed = (kinds == FORM) | (kinds == CUSTOM) | (kinds == WIDE) & ~east[row]
    odd[row[gone | changed]] = True
    out = _expanded(texts, changed & ~gone, t.form_at, t.form_size)
    if gone.any():
        lengths = np.where(changed & ~gone, t.form_size[points], 1)
        kept = ~np.repeat(gone, lengths)
        out = Texts(out.points[kept], out.row[kept], rows)
    whole = composed(out)
    # a text whose marks weren't joined differs from what they are joined to
    before, after = np.bincount(out.row, minlength=rows), np.bincount(whole.row, minlength=rows)
    odd |= before != after
    same = before == after
    one, other = out.points[same[out.row]], whole.points[same[whole.row]]
    odd[out.row[same[out.row]][one != other]] = True
    scripted, mixed = _one_script(whole)
    odd |= mixed
    return (composed(scripted) if mixed.any() else scripted), odd


def _one_script(texts: Texts) -> tuple[Texts, np.ndarray]:
    """texts with the letters of each word brought to one script, and which had a word in two, or one in another's letters."""
    t = tables()
    points, row, rows = texts
    mixed_rows = np.zeros(rows, dtype=bool)
    held = t.in_words[points]
    starts = held & ~(np.concatenate([[False], held[:-1]]) & texts.same_row())
    if not starts.any():
        return texts, mixed_rows
    at = np.flatnonzero(held)
    word = np.cumsum(starts)[at] - 1
    words = int(word[-1]) + 1
    of_row = np.zeros(words, dtype=np.int64)
    of_row[word] = row[at]
    script, letter = t.scripts[points[at]], t.letters[points[at]]
    counts = {s: np.bincount(word[script == s], minlength=words) for s in _ALIKE}
    mixed = sum((counts[s] > 0).astype(np.int64) for s in _ALIKE) > 1
    own = points[at]
    fits_cyrillic = np.bincount(word[(script == LATIN) & (t.to_cyrillic[own] == own)], minlength=words) == 0
    fits_latin = np.bincount(word[(script == CYRILLIC) & (t.to_latin[own] == own)], minlength=words) == 0
    cyrillic = mixed & fits_cyrillic & (~fits_latin | (counts[CYRILLIC] > counts[LATIN]))
    latin = mixed & ~cyrillic
    # a single word in look-alike letters among words of the other alphabet
    n_letters = np.bincount(word[letter], minlength=words)
    first = np.full(words, OTHER, dtype=np.int64)
    known = np.flatnonzero(script != OTHER)
    first[word[known][::-1]] = script[known][::-1]
    real = n_letters > 0
    in_row = {s: np.bincount(of_row[real & (first == s)], minlength=rows) for s in (LATIN, CYRILLIC, GREEK)}
    all_alike = np.bincount(word[letter & (t.to_latin[own] == own)], minlength=words) == 0
    for s in (CYRILLIC, GREEK):
        latin |= real & (first == s) & (in_row[s][of_row] == 1) & (in_row[LATIN][of_row] > 0) & all_alike
    size = np.bincount(word, minlength=words)
    lone = np.isin(own, [ord(c) for c in _LONE_LATIN])
    lone = np.bincount(word[lone], minlength=words) == 1
    cyrillic |= real & (first == LATIN) & (in_row[LATIN][of_row] == 1) & (in_row[CYRILLIC][of_row] > 0) & (size == 1) & lone
    mixed_rows[of_row[latin | cyrillic]] = True
    out = points.copy()
    to = at[latin[word]]
    out[to] = t.to_latin[out[to]]
    to = at[cyrillic[word]]
    out[to] = t.to_cyrillic[out[to]]
    return Texts(out, row, rows), mixed_rows


def ordinary_list(texts: Sequence[str | None]) -> list[str | None]:
    """Texts in ordinary characters."""
    array = pa.array(texts, pa.string())
    found = to_arrow(ordinary_texts(from_arrow(array))[0]).to_pylist()
    return [None if x is None else y for x, y in zip(texts, found, strict=True)]


def ordinary(text: str | None) -> str | None:
    """The same text in ordinary characters."""
    return ordinary_list([text])[0]


def is_unusual(text: str | None) -> bool:
    """Whether a text that looks ordinary isn't stored in ordinary characters."""
    return bool(ordinary_texts(from_arrow(pa.array([text], pa.string())))[1][0])


def unusual(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, field_name, ordinary ARRAY<STRING>: the values that look ordinary but aren't stored in ordinary characters, and
    their ordinary form.

    An array is one value, a case when one of its elements is; a text is an array of one. Null values and garbled ones are
    none; repeated rows count each for itself. Other columns aren't read. No shuffle.
    """
    kept = df.select(
        F.col(f"`{key}`").alias("key"),
        *[(F.col(f"`{c}`") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(columns)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(columns):
                lists = batch.column(i + 1)
                flat, parents = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
                plain, odd = ordinary_texts(from_arrow(flat))
                suspects = np.flatnonzero(odd)
                sure = [not is_garbled(x) for x in flat.take(pa.array(suspects)).to_pylist()]
                at = np.unique(parents[suspects[np.array(sure, dtype=bool)]])
                counts = np.bincount(parents, minlength=len(lists))
                ends = np.concatenate([[0], np.cumsum(counts)])
                right = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.if_else(flat.is_valid(), to_arrow(plain), None))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([name] * len(at), type=pa.string()), right.take(pa.array(at))], names=[key, "field_name", "ordinary"])

    return kept.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, ordinary array<string>")
