"""Texts that were decoded with the wrong encoding.

For each pair of the encoding a text is in and the one it was read by, the sequences that characters become are laid down
beforehand, and all of them are one automaton (Aho-Corasick) that finds them in a text at once. A sequence that ordinary
writing can't hold is a sign by itself; of the others, a chain without gaps is one. Only what was matched is replaced when a
text is set right, by the pair that most of its sequences agree in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of the texts beyond ASCII, and encodings by which UTF-8 is read wrongly.
LATIN = "áàâãäéèêëíìîïóòôõöúùûüçñßœæÿÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑŒÆ"
MARKS = "‘’‚“”„–—…•«»‹›€£©®°ºª¿¡·§†‡™ ­​‌‍ ﻿�"
RUSSIAN = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
ARABIC = "".join(map(chr, [0x60C, 0x61B, 0x61F, *range(0x621, 0x653), *range(0x660, 0x66A)]))
DEVANAGARI = "".join(map(chr, range(0x900, 0x980)))
THAI = "".join(map(chr, range(0xE01, 0xE5C)))
SINGLE = "latin-1 cp1252 cp1250 cp1251 cp1253 cp1254 cp1256 cp1257 mac_roman cp437 cp850 cp852 iso8859-2 iso8859-9 iso8859-15 koi8-r cp866 mac_cyrillic".split()
DOUBLE = ("gb18030", "cp932", "big5")
#: Encodings of one byte a letter by script, those of two bytes, and those that either is read by.
LEGACY = {RUSSIAN: ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"), ARABIC: ("cp1256", "iso8859-6"), THAI: ("cp874",)}
LEGACY_DOUBLE = ("gbk", "cp932", "euc_jp", "big5", "euc_kr")
READ_BY = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866")
#: Letters and marks of ordinary writing; a pattern made of such only is no sign.
_PLAIN = set(LATIN + RUSSIAN + ARABIC + THAI + "ªº") - set("ªº")
_QUOTES = set("‘’‚“”„–—…•«»‹›№ ­،؛؟‌‍‎‏")
#: Not ordinary in spite of plain letters: U+00DC and U+00CC by cp1252, and general punctuation by cp850.
_SURE = ("Ãœ", "ÃŒ", "ÔÇ")


def _read(data: bytes, encoding: str) -> str | None:
    """data as an encoding reads it; the five bytes cp1252 lacks stay control characters, as in browsers."""
    if encoding == "cp1252":
        return "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in data)
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=1)
def patterns() -> dict[str, list[tuple[str, str, str]]]:
    """Sequences that are a sign by themselves: what each stands for, as pairs of encodings and the characters meant."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    kana = "".join(map(chr, [*range(0x3001, 0x3012), *range(0x3041, 0x3100), *range(0xFF01, 0xFF5F)]))
    for char, encoding in product(LATIN + MARKS + RUSSIAN + ARABIC + DEVANAGARI + THAI + kana, SINGLE):
        wrong = _read(char.encode(), encoding)
        if wrong is None or (set(wrong) <= _PLAIN and not wrong.startswith(_SURE)):
            continue
        if len(wrong) == 2 and (wrong[0] in RUSSIAN or wrong[0] in ARABIC) and wrong[1] in _QUOTES:
            continue
        found.setdefault(wrong, []).append(("utf-8", encoding, char))
    # the Russian encodings that swap the cases of each other: a word that begins small and goes on in capitals
    capitals, small = RUSSIAN[:32], RUSSIAN[32:64]
    for true, wrong in (("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        swapped = {c: c.encode(true).decode(wrong) for c in capitals + small}
        for word in map("".join, product(capitals, small, small)):
            seen = "".join(swapped[c] for c in word)
            if seen[0] in small and seen[1] in capitals and seen[2] in capitals:
                found.setdefault(seen, []).append((true, wrong, word))
    # a letter and what UTF-8 of an accented one becomes in encodings of two bytes
    for char, encoding, letter in product(LATIN, DOUBLE, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        wrong = _read(char.encode(), encoding)
        if wrong is not None and len(wrong) == 1:
            found.setdefault(letter + wrong, []).append(("utf-8", encoding, letter + char))
    return found


@lru_cache(maxsize=1)
def chained() -> dict[str, list[tuple[str, str, str]]]:
    """Sequences that ordinary writing can hold, but not one after another: letters of legacy encodings by others."""
    found: dict[str, list[tuple[str, str, str]]] = {}

    def lay(text: str, true: str, wrong: str) -> None:
        try:
            seen = _read(text.encode(true), wrong)
        except UnicodeEncodeError:
            return
        if seen is not None and seen != text and not seen.isascii() and not any(c in RUSSIAN or c in ARABIC for c in seen):
            found.setdefault(seen, []).append((true, wrong, text))

    for letters, encodings in LEGACY.items():
        for pair, true, wrong in product(map("".join, product(letters, letters)), encodings, READ_BY[:5]):
            lay(pair, true, wrong)
    letters_of = {wrong: [_read(bytes([x]), wrong) for x in range(256)] for wrong in READ_BY[:2]}
    for true in LEGACY_DOUBLE:
        for lead, trail in product(range(0x81, 0xFF), range(0x40, 0xFF)):
            char = bytes((lead, trail)).decode(true, "ignore")
            if len(char) == 1 and ("\u3000" <= char <= "\u30ff" or "\u4e00" <= char <= "\u9fff" or "\uac00" <= char <= "\ud7a3" or "\uff00" <= char <= "\uff5e"):
                for wrong, letters in letters_of.items():
                    found.setdefault(letters[lead] + letters[trail], []).append((true, wrong, char))
    return found


#: A list of letters isn't a text.
_LETTERS = regex.compile("À?ÁÂÃÄÅ?Æ?|à?áâãäå?æ?")
#: Signs that hold nothing to be set right: lost characters, controls, private letters; parts of text drawings in a word.
_LOST = "�" + "".join(map(chr, range(0x80, 0xA0)))
_DRAWN = "".join(map(chr, range(0x2500, 0x25A0)))
_FOREIGN = "ЂЃѓЉЊЌЏђљњќћџЎўҐґЄЇ"
#: Code points beyond ASCII, and no ordinary marks, that a chain needs; half as many where one is no ordinary letter either.
CHAIN = 4


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """All sequences with whether they are a sign by themselves."""
    found = ahocorasick.Automaton()
    for seen, meant in chained().items():
        found.add_word(seen, (len(seen), False, tuple(meant)))
    for seen, meant in patterns().items():
        found.add_word(seen, (len(seen), True, tuple(meant)))
    for char in _LOST:
        found.add_word(char, (1, True, ()))
    for one, other in [*product(_DRAWN, _DRAWN), *product(_FOREIGN, _FOREIGN)]:
        if one + other not in found:
            found.add_word(one + other, (2, True, ()))
    found.make_automaton()
    return found


_GAPPED = regex.compile(rf"[{_FOREIGN}]\p{{L}}+[{_FOREIGN}]|[─-▟]\p{{L}}+[─-▟]|\p{{Co}}")
#: Letters that were replaced by question marks; what they were isn't in the text.
_ASKED = regex.compile(r"(?<![/=.\w-])\p{L}+\?+\p{Ll}+(?![\w/=])|(?<!\S)\?{2,}\s+\?{2,}(?!\S)")


class Span:
    """A stretch that was decoded wrongly, and the pairs of encodings with what it stands for by each."""

    __slots__ = ("start", "end", "meant")

    def __init__(self, start: int, end: int, meant: tuple[tuple[str, str, str], ...]) -> None:
        self.start, self.end, self.meant = start, end, meant


def garbled_spans(text: str) -> list[Span]:
    """The stretches of a text that the automaton tells to be decoded wrongly, in text order, without overlaps."""
    plain = _LETTERS.sub(lambda m: " " * len(m[0]), text)
    sure: list[Span] = []
    weak: list[tuple[int, int, tuple]] = []
    for last, (size, sign, meant) in _automaton().iter(plain):
        start = last + 1 - size
        if not sign:
            weak.append((start, last + 1, meant))
        elif _sure(plain, start, last + 1):
            sure.append(Span(start, last + 1, meant))
    weak.sort(key=lambda x: x[:2])
    at = 0
    while at < len(weak):
        end, upto, votes = weak[at][1], at + 1, Counter((t, w) for t, w, _ in weak[at][2])
        while upto < len(weak) and weak[upto][0] <= end:
            end = max(end, weak[upto][1])
            votes.update((t, w) for t, w, _ in weak[upto][2])
            upto += 1
        start, run = weak[at][0], plain[weak[at][0] : end]
        odd = [c for c in run if c not in _QUOTES and not c.isascii()]
        enough = len(odd) >= CHAIN or len(run) >= CHAIN and len(odd) >= CHAIN // 2 and not set(odd) <= set(LATIN)
        if enough and upto - at > 1 and _strange(run):
            sure.append(Span(start, end, tuple(x for pair, _ in votes.most_common() if (x := _whole(run, *pair)))))
        at = upto
    sure.sort(key=lambda x: (x.start, -x.end))
    out: list[Span] = []
    for span in sure:
        if not out or span.start >= out[-1].end:
            out.append(span)
    return out


def _strange(run: str) -> bool:
    """Whether a chain holds two letters beyond ASCII side by side, or signs between letters, as no spelling does."""
    return regex.search(r"[À-ÿŒœŠšŽžŸƒ]{2}|[À-ÿƒ][¤¦¬¯±²³´µ¶¸¹¼½¾‰†‡ˆ˜‚„\u0080-\u009f]|[¤¦¬¯±²³´µ¶¸¹¼½¾‰†‡ˆ˜‚\u0080-\u009f][À-ÿƒ]|ƒ.{0,3}ƒ", run) is not None


def _whole(run: str, true: str, wrong: str) -> tuple[str, str, str] | None:
    """What a chain says when it is read by its own encoding."""
    table = _bytes_of(wrong)
    data = b""
    for char in run:
        if char.isascii():
            data += char.encode()
        elif char in table:
            data += bytes([table[char]])
        else:
            return None
    try:
        return true, wrong, data.decode(true)
    except UnicodeDecodeError:
        return None


_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}①-㏿-！-￮�]+")
_EAST_TEXT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Cyrillic}\p{Arabic}\p{Devanagari}\p{Thai}、。，！？：；（）「」『』ー・]")
_LATIN_NEAR = regex.compile(r"[A-Za-z]")


def _double_byte(text: str) -> tuple[int, int] | None:
    """A stretch of East Asian characters whose bytes are UTF-8 of something else."""
    for found in _EAST.finditer(text):
        run = found[0]
        for encoding in DOUBLE:
            data = run.encode(encoding, "ignore")
            if len(data) < 2:
                continue
            # the ends of a run may be cut off from bytes that were read together with its neighbours
            right = data.decode("utf-8", "replace")
            good = right.replace("�", "")
            lost = len(right) - len(good)
            if not good or any(ord(c) < 0x80 for c in good) or lost > 2 + run.count("�") * 2 + len(good) // 8:
                continue
            if all(c in LATIN + MARKS for c in good):
                near = text[max(0, found.start() - 1) : found.start()] + text[found.end() : found.end() + 1]
                if lost <= 1 and _LATIN_NEAR.search(near):
                    return found.span()
            elif len(good) >= 2 and lost <= len(good) and all(_EAST_TEXT.match(c) or c in LATIN + MARKS for c in good):
                return found.span()
    return None


def _sure(text: str, start: int, end: int) -> bool:
    """Whether a pattern is a sign where it stands: 'MANHÃ”' may end a quotation, 'CRÃ”' within a word can't."""
    if end - start == 2 and text[start + 1] in _QUOTES and text[start].isupper():
        before, after = text[start - 1 : start], text[end : end + 1]
        return not ((before.isupper() or text[start + 1] in "»”’…") and not after.isalpha())
    return True


def is_garbled(text: str | None) -> bool:
    """Whether at least a stretch of a text was decoded wrongly."""
    if not text or text.isascii() and "?" not in text:
        return False
    return bool(garbled_spans(text) or _GAPPED.search(text) or _ASKED.search(_LETTERS.sub(" ", text)) or _double_byte(text))


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte from 0x80 on that an encoding has for a character."""
    return {c: x for x in range(0x80, 0x100) if (c := _read(bytes([x]), encoding))}


#: Letters that most of a text is made of, by the encodings that hold them.
_FREQUENT = {true: set(letters) for encodings, letters in ((LEGACY[RUSSIAN], "оеаинтсрвлкмдпуя"), (LEGACY[ARABIC], "اليومنترةبعدسف"), (LEGACY[THAI], "นารกอเงมยลวดตสทปค่้ิีัะ")) for true in encodings}
#: First bytes of the characters that are in common use, by encoding.
_COMMON_LEAD = {"gbk": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc_jp": (0xB0, 0xCF), "cp932": (0x88, 0x97), "euc_kr": (0xB0, 0xC8)}


def _plausible(true: str, text: str) -> float:
    """How much of a text is in the frequent characters of an encoding's languages."""
    if true in _FREQUENT:
        return sum(c in _FREQUENT[true] for c in text) / len(text)
    low, high = _COMMON_LEAD[true]
    kana = sum("\u3041" <= c <= "\u30ff" for c in text)
    common = sum(low <= c.encode(true)[0] <= high for c in text if c.isalpha() and not "\u3041" <= c <= "\u30ff" and not c.isascii())
    return (common + (2 * kana if true in ("euc_jp", "cp932") else 0)) / len(text)


def _sequences(run: str, encoding: str) -> tuple[str, int]:
    """A run with each valid sequence of UTF-8 in an encoding's bytes read as such, and how many of its characters that were."""
    table = _bytes_of(encoding)
    data = bytes(table[c] for c in run)
    out, at, read = [], 0, 0
    while at < len(data):
        size = 2 if 0xC2 <= data[at] < 0xE0 else 3 if 0xE0 <= data[at] < 0xF0 else 4 if 0xF0 <= data[at] < 0xF5 else 1
        text = data[at : at + size].decode("utf-8", "ignore") if size > 1 else ""
        if text:
            out.append(text)
            at += size
            read += size
        else:
            out.append(run[at])
            at += 1
    return "".join(out), read


def _runs(text: str, encoding: str) -> Iterator[tuple[int, int]]:
    """The stretches of a text that are all of characters an encoding has beyond ASCII."""
    table, start = _bytes_of(encoding), None
    for at, char in enumerate(text + "\0"):
        if char in table:
            start = at if start is None else start
        elif start is not None:
            yield start, at
            start = None


def _by_bytes(text: str, encoding: str, spans: list[Span], agreed: bool) -> tuple[str, int]:
    """text with UTF-8 read by an encoding set right in the stretches that hold a span, and how many characters that were.

    Where sequences of the pair were found, so are stretches by themselves that are such sequences from end to end, unless
    they can be a letter before a closing mark.
    """
    out, at, read, k = [], 0, 0, 0
    for start, end in _runs(text, encoding):
        while k < len(spans) and spans[k].end <= start:
            k += 1
        held = k < len(spans) and spans[k].start < end
        if not held and not (agreed and (not text[start - 1 : start].isalpha() or text[end : end + 1].isalpha() or {"\u00a0", "\u00ad"} & set(text[start:end]))):
            continue
        right, n = _sequences(text[start:end], encoding)
        if held or n == end - start:
            out += [text[at:start], right]
            at, read = end, read + n
    return "".join(out) + text[at:], read


def _replaced(text: str) -> str:
    """text with its garbled stretches as the pair of encodings has them that can set most of them right."""
    spans = garbled_spans(text)
    best, most = text, 0
    votes = Counter(w for span in spans for w in {w for t, w, _ in span.meant if t == "utf-8" and w in SINGLE})
    swapped = not votes and any(w in ("cp1251", "koi8-r") for span in spans for _, w, _ in span.meant)
    for encoding in sorted(SINGLE, key=lambda w: -votes[w]) if spans and not swapped else ():  # UTF-8 that was read by bytes
        right, read = _by_bytes(text, encoding, spans, votes[encoding] > 0)
        if read > most:
            best, most = right, read
    if most >= max(2, sum(s.end - s.start for s in spans if s.meant) * (0.5 if votes else 0.8)):
        return best
    pairs: dict[tuple[str, str], float] = {}
    for span in spans:
        for true, wrong, right in span.meant:
            if true == "utf-8":
                pairs[true, wrong] = pairs.get((true, wrong), 0) + 2 * (span.end - span.start)
            elif right:
                pairs[true, wrong] = pairs.get((true, wrong), 0) + _plausible(true, right) * (span.end - span.start)
    if pairs:
        if swapped:
            pairs = {pair: _plausible(pair[0], read[2]) for pair in pairs if (read := _whole(text, *pair))} or pairs
        common = ["utf-8", *(x for of in LEGACY.values() for x in of), *LEGACY_DOUBLE]  # of equals, the one in wider use
        pair = max(pairs, key=lambda x: (round(pairs[x], 6), -common.index(x[0]), x[1]))
        matched = sum(s.end - s.start for s in spans if any((t, w) == pair for t, w, _ in s.meant))
        if pair[0] != "utf-8" and (pair[1] in ("cp1251", "koi8-r") or 2 * matched > sum(not c.isascii() for c in text)):
            # where single letters stand for single ones, some are signs, but all of the text was read wrongly
            read_whole = _whole(text, *pair)
            if read_whole:
                return read_whole[2]
        out, at = [], 0
        for span in spans:
            right = next((x for t, w, x in span.meant if (t, w) == pair), None)
            if right is not None:
                out += [text[at : span.start], right]
                at = span.end
        return "".join(out) + text[at:]
    east = _double_byte(text)
    if east:
        run = text[east[0] : east[1]]
        for encoding in DOUBLE:
            try:
                return text[: east[0]] + run.encode(encoding).decode() + text[east[1] :]
            except UnicodeError:
                continue
    return text


def repaired(text: str | None, rounds: int = 3) -> str | None:
    """A text whose garbled stretches are set right, once or, where it was read wrongly more often, several times.

    Ordinary stretches stay as they are. None where a stretch is left: its characters are lost, or not known.
    """
    for _ in range(rounds):
        if not is_garbled(text):
            return text
        text = _replaced(text)
    return None if is_garbled(text) else text


def garbled(df: DataFrame, key: str = "record_id", columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """key, field_name, repaired: the texts of the columns that were decoded wrongly at least in a stretch.

    repaired is null where the original is lost or isn't known. Null texts are none; repeated rows count each for itself.
    Columns that aren't named aren't read. No shuffle.
    """
    kept = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(columns):
                texts = batch.column(i + 1).to_pylist()
                at = [j for j, text in enumerate(texts) if is_garbled(text)]
                right = pa.array([repaired(texts[j]) for j in at], type=pa.string())
                keys = batch.column(0).take(pa.array(at, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(at), type=pa.string()), right], names=[key, "field_name", "repaired"])

    return kept.mapInArrow(run, f"`{key}` {kind}, field_name string, repaired string")
