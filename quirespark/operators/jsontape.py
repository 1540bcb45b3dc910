"""JSON texts as columns of tokens, many texts at a time.

A block of texts is one byte buffer. Quotes, brackets and scalars are found in it by array operations, and every value
gets the index of its container and its place there. Fields are then looked up for all records at once, and the declared
shape is built level by level as Arrow buffers: list offsets, child values, validity. No text is gone through by itself;
only distinct field names and distinct odd scalars are looked at in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_LIST, _CLOSE_LIST, _COLON, _COMMA, _STRING, _SCALAR = range(1, 9)
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(b"{}[]:,", start=1):
    _CLASS[_c] = _i
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\r\n")] = True
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|NaN|-?Infinity")
_BOM = "﻿"


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after another, and where each ends."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[places], offsets


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    flat, offsets = _gather(data, starts, ends)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes()))


def _unescaped_one(raw: str) -> str:
    try:
        text = json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unescape(raw: pa.Array) -> pa.Array:
    """The meaning of strings as they stand between quotes; a lone surrogate becomes U+FFFD."""
    odd = pc.match_substring(raw, "\\")
    if not pc.any(odd).as_py():
        return raw
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    some = raw.take(pa.array(at))
    coded = pc.match_substring_regex(some, r"\\u").to_numpy(zero_copy_only=False)
    plain = pc.replace_substring(some, "\\\\", "\x00")
    for mark, meant in (('\\"', '"'), ("\\/", "/"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f")):
        plain = pc.replace_substring(plain, mark, meant)
    plain = pc.replace_substring(plain, "\x00", "\\")
    if coded.any():  # escapes by number: each distinct text once
        each = some.filter(pa.array(coded)).dictionary_encode()
        words = pa.array([_unescaped_one(x) for x in each.dictionary.to_pylist()], pa.large_string())
        plain = pc.replace_with_mask(plain, pa.array(coded), words.take(each.indices))
    mask = np.zeros(len(raw), dtype=bool)
    mask[at] = True
    return pc.replace_with_mask(raw, pa.array(mask), plain)


@dataclass
class Tape:
    """The values of a block of texts. A value's number is its place; -1 stands for none."""

    kind: np.ndarray  # of the value: _OPEN_OBJECT, _OPEN_LIST, _STRING or _SCALAR
    start: np.ndarray  # of the text in data, without quotes
    end: np.ndarray
    container: np.ndarray  # the value it lies in, -1 at the top
    place: np.ndarray  # among the values of its container, from 0
    name: np.ndarray  # number of its field name, -1 in lists and at the top
    root: np.ndarray  # by text: its value, -1 where the text is null or breaks off
    names: list[str]
    data: np.ndarray

    def text(self, values: np.ndarray) -> pa.Array:
        """Strings by their meaning, other scalars as they are written, null elsewhere."""
        known = values >= 0
        at = values[known]
        flat = (self.kind[at] == _STRING) | (self.kind[at] == _SCALAR)
        known[np.flatnonzero(known)[~flat]] = False
        at = at[flat]
        held = unescape(_strings(self.data, self.start[at], self.end[at]))
        places = np.cumsum(known) - 1
        return held.take(pa.array(places, mask=~known)).cast(pa.string())


def read_tape(texts: pa.Array, canonical: Callable[[str], str]) -> Tape:
    """The tape of an array of texts. A text whose JSON breaks off, or that isn't JSON, has no root."""
    texts = pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    texts = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))  # a separator keeps scalars of neighbours apart
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[bounds[0] : bounds[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    rows, size = len(texts), len(data)
    # quotes that aren't escaped: an even number of backslashes before them
    quotes = np.flatnonzero(data == 34)
    slashes = np.flatnonzero(data == 92)
    if len(slashes):
        breaks = np.flatnonzero(np.diff(slashes) > 1) + 1
        first = slashes[np.concatenate([[0], breaks])]
        last = slashes[np.concatenate([breaks - 1, [len(slashes) - 1]])]
        run = np.searchsorted(last, quotes - 1)
        run_ok = np.minimum(run, len(last) - 1)
        odd = (last[run_ok] == quotes - 1) & ((last[run_ok] - first[run_ok] + 1) % 2 == 1)
        quotes = quotes[~odd]
    row_of_quote = np.searchsorted(bounds, quotes, side="right") - 1
    per_row = np.bincount(row_of_quote, minlength=rows)
    bad = per_row % 2 == 1
    whole = ~bad[row_of_quote]
    quotes = quotes[whole]
    opening, closing = quotes[0::2], quotes[1::2]
    inside = np.zeros(size + 1, dtype=np.int8)
    inside[opening] += 1
    inside[closing + 1] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    if bad.any():  # nothing of a broken text counts
        for a, b in zip(bounds[:-1][bad], bounds[1:][bad], strict=True):
            inside[a:b] = True
    classes = np.where(inside, 0, _CLASS[data])
    # a byte order mark before the text is white space
    mark = (~inside) & (data == 0xEF)
    if mark.any():
        at = np.flatnonzero(mark)
        at = at[at + 2 < size]
        at = at[(data[at + 1] == 0xBB) & (data[at + 2] == 0xBF)]
        blank = _SPACE[data]
        blank[at], blank[at + 1], blank[at + 2] = True, True, True
    else:
        blank = _SPACE[data]
    loose = (~inside) & (classes == 0) & ~blank
    edge = np.diff(np.concatenate([[0], loose.view(np.int8), [0]]))
    scalar_start, scalar_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    marks = np.flatnonzero(classes)
    where = np.concatenate([marks, opening, scalar_start])
    order = np.argsort(where, kind="stable")
    kind = np.concatenate([classes[marks], np.full(len(opening), _STRING), np.full(len(scalar_start), _SCALAR)])[order].astype(np.int8)
    start = np.concatenate([marks, opening + 1, scalar_start])[order]
    end = np.concatenate([marks + 1, closing, scalar_end])[order]
    where = where[order]
    row = np.searchsorted(bounds, where, side="right") - 1
    # nesting, from 0 at the start of each text
    step = np.isin(kind, (_OPEN_OBJECT, _OPEN_LIST)).astype(np.int64) - np.isin(kind, (_CLOSE_OBJECT, _CLOSE_LIST))
    total = np.cumsum(step)
    first_token = np.searchsorted(row, np.arange(rows))
    before_row = np.where(first_token > 0, total[np.minimum(first_token, len(total)) - 1], 0) if len(total) else np.zeros(rows, np.int64)
    after = total - before_row[row] if len(total) else total
    level = np.where(step > 0, after - 1, after)  # of the container, for openings that of what they lie in
    token_count = np.bincount(row, minlength=rows)
    bad |= token_count == 0
    last_token = first_token + token_count - 1
    has = token_count > 0
    bad[has] |= after[last_token[has]] != 0
    np.logical_or.at(bad, row[after < 0], True)
    good = ~bad[row]
    kind, start, end, row, level, step = (x[good] for x in (kind, start, end, row, level, step))
    n = len(kind)
    opens = np.flatnonzero(step > 0)
    # the container of a token is the last opening before it, one level up
    key = level[opens] * (n + 1) + opens
    by_key = np.argsort(key)
    keys = key[by_key]
    up = np.where(step < 0, level, level - 1)  # a closing belongs to what it closes
    found = np.searchsorted(keys, up * (n + 1) + np.arange(n)) - 1
    container = np.where((up >= 0) & (found >= 0), opens[by_key][np.maximum(found, 0)] if len(opens) else -1, -1)
    in_object = (container >= 0) & (kind[container] == _OPEN_OBJECT)
    in_list = (container >= 0) & (kind[container] == _OPEN_LIST)
    wrong = (kind == _CLOSE_OBJECT) & ~in_object | (kind == _CLOSE_LIST) & ~in_list
    first_of_row = np.ones(n, dtype=bool)
    first_of_row[1:] = row[1:] != row[:-1]
    prior = np.concatenate([[0], kind[:-1]])
    prior[first_of_row] = 0
    is_value = np.isin(kind, (_OPEN_OBJECT, _OPEN_LIST, _STRING, _SCALAR))
    # after an opening, the prior token is the opening of the own container, otherwise one of its own level
    is_name = (kind == _STRING) & in_object & np.isin(prior, (_OPEN_OBJECT, _COMMA))
    prior_name = np.concatenate([[False], is_name[:-1]]) & ~first_of_row
    ended = ((np.isin(prior, (_CLOSE_OBJECT, _CLOSE_LIST, _SCALAR))) | (prior == _STRING)) & ~prior_name
    allowed = np.zeros(n, dtype=bool)
    allowed |= is_value & (container < 0) & first_of_row
    allowed |= is_value & in_object & (prior == _COLON)
    allowed |= is_value & in_list & np.isin(prior, (_OPEN_LIST, _COMMA))
    allowed |= is_name
    allowed |= (kind == _COLON) & in_object & prior_name
    allowed |= (kind == _COMMA) & (in_object | in_list) & ended
    allowed |= (kind == _CLOSE_OBJECT) & in_object & ((prior == _OPEN_OBJECT) | ended)
    allowed |= (kind == _CLOSE_LIST) & in_list & ((prior == _OPEN_LIST) | ended)
    wrong |= ~allowed
    scalars = np.flatnonzero(kind == _SCALAR)
    if len(scalars):
        coded = _strings(data, start[scalars], end[scalars]).dictionary_encode()
        fit = np.array([x in ("true", "false", "null") or bool(_NUMBER.fullmatch(x)) for x in coded.dictionary.to_pylist()])
        wrong[scalars] |= ~fit[coded.indices.to_numpy()]
    np.logical_or.at(bad, row[wrong], True)
    value = is_value & ~is_name & ~bad[row]
    at = np.flatnonzero(value)
    number = np.full(n + 1, -1, dtype=np.int64)
    number[at] = np.arange(len(at))
    own_container = number[container[at]] if n else np.zeros(0, np.int64)
    own_container[container[at] < 0] = -1
    place = _places(own_container)
    named = np.flatnonzero(in_object[at])
    name = np.full(len(at), -1, dtype=np.int64)
    names: list[str] = []
    if len(named):
        tokens = at[named] - 2  # name, colon, value
        coded = unescape(_strings(data, start[tokens], end[tokens])).dictionary_encode()
        numbers: dict[str, int] = {}
        to = np.array([numbers.setdefault(canonical(x), len(numbers)) for x in coded.dictionary.to_pylist()])
        names = list(numbers)
        name[named] = to[coded.indices.to_numpy()]
    root = np.full(rows, -1, dtype=np.int64)
    tops = np.flatnonzero(own_container < 0)
    root[row[at][tops]] = tops
    return Tape(kind[at], start[at], end[at], own_container, place, name, root, names, data)


def _places(container: np.ndarray) -> np.ndarray:
    """The rank of each value among those of its container."""
    order = np.argsort(container, kind="stable")
    ordered = container[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    since = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order)) - since
    return place


class Forest:
    """A tape with texts that hold JSON themselves, which are read when a container is due there."""

    def __init__(self, texts: pa.Array, canonical: Callable[[str], str]) -> None:
        self.canonical = canonical
        self.tape = read_tape(texts, canonical)
        self.meant = np.arange(len(self.tape.kind))  # the value that stands for a value
        self._index()

    def _index(self) -> None:
        tape = self.tape
        self.by_container = np.argsort(tape.container, kind="stable")
        self.sorted_container = tape.container[self.by_container]
        null = (tape.kind == _SCALAR) & (tape.end - tape.start == 4) & (tape.data[np.minimum(tape.start, max(len(tape.data) - 1, 0))] == ord("n") if len(tape.data) else False)
        self.is_null = null
        self.number_of = {name: i for i, name in enumerate(tape.names)}

    def unwrap(self, values: np.ndarray) -> np.ndarray:
        """The values, with each text that is itself JSON of an object, list or text replaced by what it says."""
        while True:
            values = np.where(values >= 0, self.meant[values] if len(self.meant) else -1, -1)
            tape = self.tape
            known = np.flatnonzero(values >= 0)
            texts = known[tape.kind[values[known]] == _STRING]
            if len(texts):
                at = values[texts]
                # the first byte that isn't white space decides whether a text can be JSON
                lead = tape.data[np.minimum(tape.start[at], len(tape.data) - 1)]
                texts = texts[np.isin(lead, list(b'{["\\ \xef')) & (tape.end[at] > tape.start[at])]
            if not len(texts):
                return values
            at = np.unique(values[texts])
            inner = tape.text(at)
            may = pc.match_substring_regex(inner, r"^[\x{FEFF} \t\r\n]*[\[{\x22]").to_numpy(zero_copy_only=False)
            at, inner = at[may], inner.filter(pa.array(may))
            if not len(at):
                return values
            more = read_tape(inner, self.canonical)
            read = more.root >= 0
            if not read.any():
                return values
            self._append(more)
            shift = len(self.meant) - len(more.kind)
            self.meant[at[read]] = more.root[read] + shift

    def _append(self, more: Tape) -> None:
        tape = self.tape
        shift, bytes_before = len(tape.kind), len(tape.data)
        names = list(tape.names)
        number = {x: i for i, x in enumerate(names)}
        to = np.array([number.setdefault(x, len(number)) for x in more.names] or [0], dtype=np.int64)
        self.tape = Tape(
            np.concatenate([tape.kind, more.kind]),
            np.concatenate([tape.start, more.start + bytes_before]),
            np.concatenate([tape.end, more.end + bytes_before]),
            np.concatenate([tape.container, np.where(more.container >= 0, more.container + shift, -1)]),
            np.concatenate([tape.place, more.place]),
            np.concatenate([tape.name, np.where(more.name >= 0, to[np.maximum(more.name, 0)], -1)]),
            tape.root,
            list(number),
            np.concatenate([tape.data, more.data]),
        )
        self.meant = np.concatenate([self.meant, np.arange(len(more.kind)) + shift])
        self._index()

    def children(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of containers, in order, and for each the index of its container in values."""
        low = np.searchsorted(self.sorted_container, values)
        high = np.searchsorted(self.sorted_container, values, side="right")
        low, high = np.where(values >= 0, low, 0), np.where(values >= 0, high, 0)
        counts = high - low
        parents = np.repeat(np.arange(len(values)), counts)
        starts = np.cumsum(counts) - counts
        return self.by_container[np.arange(len(parents)) - starts[parents] + low[parents]], parents

    def kinds(self, values: np.ndarray) -> np.ndarray:
        return np.where(values >= 0, self.tape.kind[values] if len(self.tape.kind) else 0, 0)

    def field(self, values: np.ndarray, name: str) -> np.ndarray:
        """The first non-null value that each of some objects has under a name."""
        out = np.full(len(values), -1, dtype=np.int64)
        number = self.number_of.get(name)
        if number is None:
            return out
        children, parents = self.children(np.where(self.kinds(values) == _OPEN_OBJECT, values, -1))
        held = (self.tape.name[children] == number) & ~self.is_null[children]
        children, parents = children[held], parents[held]
        first, at = np.unique(parents, return_index=True)
        out[first] = children[at]
        return out

    def records(self, names: set[str]) -> np.ndarray:
        """By text: the outermost object that has one of some fields; objects and texts around it are gone through in
        breadth, all texts at once, however deep."""
        out = np.full(len(self.tape.root), -1, dtype=np.int64)
        rows = np.flatnonzero(self.tape.root >= 0)
        values = self.unwrap(self.tape.root[rows])
        while len(rows):
            numbers = [self.number_of[x] for x in names if x in self.number_of]
            values = np.where(self.kinds(values) == _OPEN_OBJECT, values, -1)
            children, parents = self.children(values)
            hit = np.unique(parents[np.isin(self.tape.name[children], numbers)])
            first_rows, at = np.unique(rows[hit], return_index=True)
            out[first_rows] = values[hit[at]]
            open_rows = out[rows[parents]] < 0
            kinds = self.tape.kind[children]
            on = open_rows & ((kinds == _OPEN_OBJECT) | (kinds == _STRING))
            rows, values = rows[parents[on]], self.unwrap(children[on])
        return out


def _whole_numbers(texts: pa.Array) -> pa.Array:
    """Texts as whole numbers of 64 bits; null where they are none, hold a fraction or are too large."""
    coded = texts.dictionary_encode()

    def one(text: str | None) -> int | None:
        if text is None or not re.fullmatch(r"\s*[+-]?[0-9]{1,40}(?:\.0*)?\s*", text):
            return None
        value = int(text.strip().partition(".")[0])
        return value if -(2**63) <= value < 2**63 else None

    words = pa.array([one(x) for x in coded.dictionary.to_pylist()], pa.int64())
    return words.take(coded.indices)


def build(forest: Forest, values: np.ndarray, shape: Any, identifier: type) -> pa.Array:
    """values as an Arrow array of a shape; what doesn't fit is null, a lone value where a list is due is a list of one."""
    if isinstance(shape, Mapping):
        values = forest.unwrap(values)
        values = np.where(forest.kinds(values) == _OPEN_OBJECT, values, -1)
        fields = [(name, build(forest, forest.field(values, name), inner, identifier)) for name, inner in shape.items()]
        return pa.StructArray.from_arrays([x for _, x in fields], [x for x, _ in fields], mask=pa.array(values < 0))
    if isinstance(shape, list):
        values = forest.unwrap(values)
        is_list = forest.kinds(values) == _OPEN_LIST
        children, parents = forest.children(np.where(is_list, values, -1))
        counts = np.bincount(parents, minlength=len(values))
        lone = (values >= 0) & ~is_list
        counts[lone] = 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        items = np.empty(offsets[-1], dtype=np.int64)
        items[offsets[:-1][lone]] = values[lone]
        within = np.ones(len(items), dtype=bool)
        within[offsets[:-1][lone]] = False
        items[within] = children
        items = np.where((items >= 0) & (forest.is_null[items] if len(forest.is_null) else False), -1, items)
        inner = build(forest, items, shape[0], identifier)
        mask = np.concatenate([values < 0, [False]])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=mask), inner)
    if isinstance(shape, identifier):
        braced = forest.unwrap(values)  # an object that was written as text
        values = np.where(forest.kinds(braced) == _OPEN_OBJECT, braced, values)
        objects = np.where(forest.kinds(values) == _OPEN_OBJECT, values, -1)
        chosen = np.full(len(values), -1, dtype=np.int64)
        for name in shape.names:
            chosen = np.where(chosen >= 0, chosen, forest.field(objects, name))
        return forest.tape.text(np.where(objects >= 0, chosen, values))
    texts = forest.tape.text(values)
    return _whole_numbers(texts) if shape is int else texts


def decode_texts(texts: pa.Array, shape: Mapping[str, Any], canonical: Callable[[str], str], identifier: type) -> pa.Array:
    """An Arrow array of the records that an array of JSON texts holds."""
    forest = Forest(texts, canonical)
    return build(forest, forest.records(set(shape)), shape, identifier)
