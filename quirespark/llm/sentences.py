"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for the text up to a position and one for the text from it, and says whether
the position ends a sentence. The tables of the script before a position and of the language of its sentence are gone
through in order; the first rule whose two expressions match decides. Positions inside a quotation or a pair of brackets
are never ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.languages import LATIN_LANGS, word_scores
from quirespark.llm.tokens import slices

# Abbreviations and names by language, as they are printed.
TITLES = {
    "en": "Mr Mrs Ms Dr Prof St Sgt Capt Lt Col Gen Rev Hon Messrs Mt Ft",
    "pt": "Sr Sra Srs Sras Srta Dr Dra Drs Prof Profa Profs Eng Cia Av Exmo Exma Ilmo Pe Dom R",
    "es": "Sr Sra Srs Sres Srta Dr Dra Prof Profa Cía Av Avda Ud Uds Gral Lic Ing",
    "fr": "M MM Mme Mmes Mlle Dr Pr Prof Me Mgr Cie St Ste",
    "de": "Hr Fr Dr Prof Ing Dipl Nr Str St Hrsg",
    "ru": "проф акад доц г-н г-жа им ул пр пер просп св гр тов",
}
REFERENCES = {
    "en": "p pp no nos vol vols fig figs sec secs sect app ch chap ed eds approx art cf eq ex para pt vs ca No Nos",
    "pt": "p pp pág págs n núm vol vols fig figs seç sec cap caps art arts aprox cf ed eds t v ref",
    "es": "p pp pág págs núm núms n vol vols fig figs secc sec cap caps art arts aprox cf ed eds t v",
    "fr": "p pp n vol vols fig figs sect chap art env éd cf t v al",
    "de": "S Nr Bd Bde Abb Kap Abs Art ca Aufl vgl bzw Tab Anm Jg Z Abschn Anh Ziff Fn Ausg Ex Rdnr",
    "ru": "с стр гл рис ок т см ср табл п ст вып изд № д корп кв",
    "ar": "ص د ج م أ ط",
    "hi": "डॉ पृ श्री सं प्रो क्र",
    "th": "ดร น พ.ศ ค.ศ",
}
MONTHS = {
    "en": "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "pt": "jan fev mar abr mai jun jul ago set out nov dez",
    "es": "ene feb mar abr may jun jul ago sep sept oct nov dic",
    "fr": "janv févr avr juil sept oct nov déc",
    "de": "Jan Feb Febr Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez",
    "ru": "янв февр мар апр авг сент окт нояб дек",
}
#: References that are words too: they are short for something before a number only.
ALSO_WORDS = {"en": "no art app para ex fig sec ch No Art App", "pt": "art cap sec", "es": "art cap sec", "fr": "art chap env", "de": "Art Tab Ex"}
GERMAN_AFTER_ORDINAL = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jh Jhd Jahrhundert Auflage Kapitel Band Jahr Tag Woche Teil Mal Stock"
GERMAN_BEFORE_ORDINAL = "am im vom zum zur beim der die das dem des"
STARTERS = "The A An In It This That These However He She They We But When If O Os As Uma Um No Na El La Los Las Le Les Der Die Das Il Elle Ein Eine В И На"
SPEECH = {
    "zh": "说 道 问 喊 答 叫 写道 表示",
    "ja": "と って",
    "hi": "कहा पूछा बोला बोली लिखा बताया चिल्लाया",
    "ar": "ثم فقال فقالت قال قالت وقال وقالت وخرج وخرجت",
}
QUOTES = {"“": "”", "«": "»", "„": "“", "‘": "’", "‚": "‘", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
FILE_ENDINGS = "xhtml html htm xml png jpg jpeg gif svg css ncx opf js json txt pdf epub mp3 mp4 otf ttf"

TERMINALS = ".!?…。！？｡．‼⁇⁈⁉।॥؟۔"
CLOSERS = "\"'”’»›)]}」』）】》〉“"


def _any(words: str) -> str:
    """One expression for words, also where their marks stand apart."""
    every = {form for w in words.split() for form in (w, normalize("NFD", w))}
    return "|".join(regex.escape(w) for w in sorted(every, key=lambda w: (-len(w), w)))


def _printed(words: str, *, capitals: bool = False) -> str:
    """Words as they are printed, and at the beginning of a sentence, and in capitals where they can't be another word then."""
    every = words.split()
    return " ".join([*every, *(w[:1].upper() + w[1:] for w in every), *(w.upper() for w in every if capitals and len(w) > 1)])


def _all(table: dict[str, str], *langs: str, capitals: bool = False) -> str:
    return _any(_printed(" ".join(table.get(x, "") for x in langs or table), capitals=capitals))


def _references(*langs: str) -> list[tuple[str, str]]:
    """The expressions of references that nothing else is spelt like, and of those that are words too, with what follows."""
    words = {w for x in langs for w in _printed(ALSO_WORDS.get(x, "")).split()}
    sure = {w for x in langs for w in _printed(REFERENCES[x]).split()} - words
    out = [(_any(" ".join(sorted(sure))), r"\s*(?:[\p{Nd}§#°ºª]|[IVXLC]+\b|\p{Lu}\b|[a-z]+[\w-]*\.\d)")]
    return out + ([(_any(" ".join(sorted(words))), r"\s*(?:[\p{Nd}§#°ºª]|(?![AEIOYÀ])\p{Lu}\b)")] if words else [])


class Rule(NamedTuple):
    ends: bool
    before: str
    after: str


#: Closing marks that may stand between the end of a sentence and the position.
_CLOSED = r"(?:[ \u00a0\u202f]?[”»\"'’)\]」』）】》〉“])*"
_WORD_EDGE = r"(?<![\p{L}\p{M}\p{N}])"


def _abbreviations(*langs: str) -> list[Rule]:
    """The rules of abbreviations of some languages in Latin letters."""
    rules = [Rule(False, rf"{_WORD_EDGE}(?:{_all(TITLES, *langs, capitals=True)})\.", r"\s*[\p{L}\p{Nd}]")]
    rules += [Rule(False, rf"{_WORD_EDGE}(?:{words})\.", after) for words, after in _references(*langs)]
    return [*rules, Rule(False, rf"{_WORD_EDGE}(?:{_all(MONTHS, *langs, capitals=True)})\.", r"\s*(?:de\s+)?\p{Nd}")]


_CASED_START = r"\s++[“\"«„(\[¿¡‘—–*•-]*+\s*+"

#: Table by name; `before` is matched up to the position, `after` from it on.
TABLES: dict[str, list[Rule]] = {
    "dots": [
        Rule(False, r"\s(?:\.{2,}|…+)", r"\s+(?!\p{Lu})"),
        Rule(False, r"(?:\.{2,}|…+)", r"[\s]*[\p{Ll},;:]"),
        Rule(False, r"(?:…|。。)+", r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    ],
    "acronyms": [
        Rule(True, rf"{_WORD_EDGE}(?:\p{{Lu}}\.){{2,}}", rf"\s+(?:{_any(STARTERS)})\s"),
        Rule(False, rf"{_WORD_EDGE}(?:\p{{Lu}}\p{{M}}*\.)+", r"\s*[\p{Lu}\p{Nd}-]"),
    ],
    "de": [
        Rule(False, rf"{_WORD_EDGE}(?:[zuidosv]|[Zz]\.[Bb]|[Uu]\.[Aa])\.", r"\s*[A-Za-z]{1,2}\."),
        Rule(False, r"(?<![\p{L}\p{N},.])\d{1,2}\.", rf"\s+(?:{_any(GERMAN_AFTER_ORDINAL)})(?!\p{{L}})"),
        Rule(False, rf"{_WORD_EDGE}(?:{_any(GERMAN_BEFORE_ORDINAL)})\s+\d{{1,2}}\.", r"\s+\p{Lu}"),
    ],
    "ru": [
        Rule(False, rf"{_WORD_EDGE}\p{{Lu}}\.", r"\s*[\p{Lu}\p{Nd}-]"),
        Rule(False, rf"{_WORD_EDGE}(?:{_all(TITLES, 'ru')}|{_all(MONTHS, 'ru')})\.", r"\s*[\p{L}\p{Nd}]"),
        Rule(False, rf"{_WORD_EDGE}(?:{_all(REFERENCES, 'ru')})\.", r"\s*(?:[\p{Nd}§#№]|\p{Ll}|https?:)"),
    ],
    "cased": [
        Rule(True, rf"[.!?…]{_CLOSED}", rf"\s+[\w-]+(?:\.[\w-]+)*\.(?:{_any(FILE_ENDINGS)})(?![\p{{L}}\p{{N}}])"),
        Rule(True, rf"[.!?…]{_CLOSED}", rf"{_CASED_START}(?![\p{{Ll}},;:)\]])\S"),
        Rule(True, rf"[.!?…]{_CLOSED}", r"\s+[“\"«„(\[¿¡‘]\p{Ll}"),
        Rule(False, rf"[.!?…]{_CLOSED}", r"\s"),
        Rule(True, r"(?:[\p{Ll}\p{M}\p{Nd}%)\]”»’\"€º]|\p{Lu}\p{Lu})[!?…]+", r"[¿¡“«(]?\p{Lu}"),
        Rule(True, r"(?:[\p{Ll}\p{M}%)\]”»’\"€º]|\p{Lu}\p{Lu}|\p{Nd})\.+[”»\"’)\]]*", r"[¿¡“«(]?\p{Lu}(?:[\p{Ll}\p{M}’']|\s)"),
        Rule(True, r"[.!?][”»\"’)\]]+", r"[¿¡“«(]?\p{Lu}(?:[\p{Ll}\p{M}’']|\s)"),
        Rule(True, r"[\p{Ll}\p{M}][.!?]", r"[¿¡(“«][\p{L}¿¡]"),
    ],
    "ar": [
        Rule(False, rf"{_WORD_EDGE}(?:{_all(REFERENCES, 'ar')})\.", r"\s*\S"),
        Rule(False, r"[»”\"]", rf"\s+(?:{_any(SPEECH['ar'])})(?!\p{{L}})"),
        Rule(True, rf"[.!?؟۔…]{_CLOSED}", r"\s"),
        Rule(True, r"[\p{Arabic}]{2}[.!؟۔]+[»”\")]*", r"[«“(]?[\p{Arabic}]{2}"),
        Rule(True, r"[؟۔]+[»”\")]*", r"\S"),
    ],
    "hi": [
        Rule(False, rf"{_WORD_EDGE}(?:{_all(REFERENCES, 'hi')})\.", r"\s*\S"),
        Rule(False, r"[”’»\"]", rf"\s*(?:[^\s।॥!?.]+\s+){{0,4}}(?:{_any(SPEECH['hi'])})"),
        Rule(True, r"[।॥]", r""),
        Rule(True, r"[।॥!?][”’»\")]+", r""),
        Rule(True, rf"[.!?…]{_CLOSED}", r"\s"),
        Rule(True, r"[\p{Devanagari}][!?]+", r"[“(]?\p{Devanagari}"),
    ],
    "cjk": [
        Rule(False, r"[」』]", rf"(?:{_any(SPEECH['ja'])})"),
        Rule(False, r"[。！？!?][”’]+", rf"\s*[^。！？!?，,；;：:“”]{{0,12}}(?:{_any(SPEECH['zh'])})"),
        Rule(True, r"[。！？｡．‼⁇⁈⁉][」』）)”’】》〉\"']*", r""),
        Rule(True, r"[!?]", r"[\p{Han}\p{Hiragana}\p{Katakana}「『“]"),
        Rule(True, rf"[.!?…]{_CLOSED}", r"\s"),
    ],
    "th": [
        Rule(False, rf"{_WORD_EDGE}(?:{_all(REFERENCES, 'th')})\.", r"\s*\S"),
        Rule(True, r"[!?…]", r"\s"),
        Rule(False, r"\.", r"\s*\p{Thai}"),
    ],
}

#: Tables by the script just before a position, in the order they are gone through. `abbreviations` are those of the language.
CASCADES = {
    "latin": ("dots", "acronyms", "abbreviations", "cased"),
    "cyrillic": ("dots", "ru", "acronyms", "abbreviations", "cased"),
    "arabic": ("dots", "ar", "acronyms", "abbreviations", "cased"),
    "devanagari": ("dots", "hi", "acronyms", "abbreviations", "cased"),
    "cjk": ("dots", "cjk", "acronyms", "abbreviations", "cased"),
    "thai": ("dots", "th", "acronyms", "abbreviations", "cased"),
}
#: A number or letter at the beginning of a paragraph.
_ENUMERATOR = regex.compile(r"(?:\d{1,3}|[IVXLC]{1,5}|\p{L}\p{M}?)\.")
_ENUMERATED = regex.compile(r"[ \t]+\S")

_SCRIPT_LETTERS = (
    r"(?P<latin>\p{Latin})|(?P<cyrillic>\p{Cyrillic}|\p{Greek})|(?P<arabic>\p{Arabic}|\p{Hebrew})|(?P<devanagari>\p{Devanagari})"
    r"|(?P<cjk>\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Hangul})|(?P<thai>\p{Thai})"
)
_SCRIPTS, _SCRIPTS_FORWARD = regex.compile(_SCRIPT_LETTERS, regex.REVERSE), regex.compile(_SCRIPT_LETTERS)
_BLANK_LINE = regex.compile(r"(?>\r\n|[\n\r ])[^\S\r\n ]*(?>\r\n|[\n\r ])\s*| \s*")
_CANDIDATE = regex.compile(rf"[{regex.escape(TERMINALS)}]+|(?<=[\p{{Thai}}”»\")])[^\S\r\n]+(?=[\p{{Thai}}“«\"(])")
_MARKS = regex.compile("[" + regex.escape("".join({*QUOTES, *QUOTES.values(), '"'})) + "]")
_WORDS = regex.compile(r"\p{L}")
_THAI_EDGE = regex.compile(r"\p{Thai}")
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=None)
def _compiled(script: str, lang: str | None) -> tuple[regex.Pattern, list[tuple[bool, bool]]]:
    """A cascade as one expression whose first alternative that matches at a position decides, and what each alternative says:
    whether it ends a sentence, and whether another language could say otherwise. Without a language, those of all apply."""
    rules: list[tuple[Rule, bool]] = []
    for name in CASCADES[script]:
        if name == "abbreviations":
            rules += [(r, True) for r in _abbreviations(*([lang] if lang else LATIN_LANGS))]
            rules += [(r, True) for r in (TABLES["de"] if lang in (None, "de") else [])]
        else:
            rules += [(r, False) for r in TABLES[name]]
    # each alternative ends with an empty group of its own, which tells it
    each = "|".join(f"(?<={r.before})(?={r.after})()" for r, _ in rules)
    return regex.compile(each), [(r.ends, by_language) for r, by_language in rules]


#: Characters behind a position whose words can tell the language of a sentence that has hardly begun.
AHEAD = 60


class _Language:
    """The language of the sentence that is being read: by its words so far, else with those that follow at once, else by
    its paragraph's where that is plainly of one language."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end, self.at = text, start, end, start
        self.scores = [0.0] * len(LATIN_LANGS)
        self.whole: str | None = None
        self.read_whole = False

    def begin(self, at: int) -> None:
        self.at, self.scores = at, [0.0] * len(LATIN_LANGS)

    def name(self, at: int) -> str | None:
        if at > self.at:
            self.scores = [a + b for a, b in zip(self.scores, word_scores(self.text, self.at, at))]
            self.at = at
        found = _top(self.scores)
        if found is None:
            ahead = word_scores(self.text, at, min(self.end, at + AHEAD))
            found = _top([a + b for a, b in zip(self.scores, ahead)])
        if found is None:
            if not self.read_whole:
                self.whole, self.read_whole = _top(word_scores(self.text, self.start, self.end), 3), True
            found = self.whole
        return found


def _top(scores: list[float], times: float = 1) -> str | None:
    """The language with the highest score, None where that is low or another is near."""
    best, second = sorted(scores)[-1:-3:-1]
    return LATIN_LANGS[scores.index(best)] if best >= 1 and best >= second + 0.5 and best >= times * second else None


def _pairs(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Outermost matched quotations and brackets of a paragraph, and the places of all matched closing marks."""
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}  # of each mark on the stack
    spans: list[tuple[int, int]] = []
    closing: set[int] = set()

    def push(closing_mark: str, at: int) -> None:
        depths.setdefault(closing_mark, []).append(len(stack))
        stack.append((closing_mark, at))

    for mark in _MARKS.finditer(text, start, end):
        char, at = mark[0], mark.start()
        before, after = text[at - 1 : at] if at > start else " ", text[at + 1 : at + 2] if at + 1 < end else " "
        if char == "’" and _LETTER.match(before) and _LETTER.match(after):
            continue  # an apostrophe
        if depths.get(char):
            known = depths[char][-1]
            opened = stack[known][1]
            while len(stack) > known:
                depths[stack.pop()[0]].pop()
            spans.append((opened, at))
            closing.add(at)
        elif char == '"':
            if not after.isspace():
                push('"', at)
        elif char == "»" and not after.isspace() and (before.isspace() or before in "([:"):
            push("«", at)
        elif char in QUOTES and not (char == "‘" and _LETTER.match(before)):
            push(QUOTES[char], at)
    outer: list[tuple[int, int]] = []
    for opened, closed in sorted(spans):
        if not outer or opened > outer[-1][1]:
            outer.append((opened, closed))
    return outer, closing


def _ends(text: str, start: int, end: int, at: int, script: str, language: _Language) -> bool:
    """Whether the rules let a sentence end at `at`."""
    if at - start <= 8 and _ENUMERATOR.fullmatch(text, start, at) and _ENUMERATED.match(text, at, end):
        return False
    pattern, says = _compiled(script, None)
    found = pattern.match(text, at, end)
    if found and says[found.lastindex - 1][1]:  # an abbreviation of some language: is it one of this?
        lang = language.name(at)
        if lang is not None:
            pattern, says = _compiled(script, lang)
            found = pattern.match(text, at, end)
    return bool(found) and says[found.lastindex - 1][0]


def _paragraph(text: str, start: int, end: int) -> Iterator[int]:
    """The places inside a paragraph where a sentence ends and another begins."""
    if not _WORDS.search(text, start, end):
        return
    outer, closing = _pairs(text, start, end)
    opened = [o for o, _ in outer]
    done, script, seen = start, "", start
    language = _Language(text, start, end)
    for found in _CANDIDATE.finditer(text, start, end):
        term, at = found.span()
        if term < done:
            continue
        if found[0][0].isspace():  # between Thai clauses
            k = bisect_right(opened, term - 1) - 1
            if not (k >= 0 and outer[k][1] >= at) and text[at] != "ๆ" and (_THAI_EDGE.match(text[term - 1]) or term - 1 in closing):
                if _THAI_EDGE.match(text[at]) or at in opened:
                    yield term
            continue
        while at < end:
            if text[at] in CLOSERS and (at in closing or text[at] not in "“'’\""):
                at += 1
            elif text[at] in " \u00a0\u202f" and at + 1 in closing and text[at + 1] in "»”)":
                at += 2
            else:
                break
        k = bisect_right(opened, term) - 1
        if k >= 0 and outer[k][1] >= at:
            continue
        done = at
        if at == end:
            continue
        near = _SCRIPTS.search(text, seen, term)  # the last letter before; where there is none, the one known from before
        if near:
            script = near.lastgroup
        elif not script and (near := _SCRIPTS_FORWARD.search(text, term, end)):
            script = near.lastgroup
        seen = term
        if _ends(text, start, end, at, script or "latin", language):
            language.begin(at)
            yield at


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each unit of a text, in code points, without outer white space."""
    spans: list[tuple[int, int]] = []
    if not text:
        return spans

    def add(start: int, end: int) -> None:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start < end:
            spans.append((start, end))

    def paragraph(start: int, end: int) -> None:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        at = start
        for cut_at in _paragraph(text, start, end):
            add(at, cut_at)
            at = cut_at
        add(at, end)

    start = 0
    for blank in _BLANK_LINE.finditer(text):
        paragraph(start, blank.start())
        start = blank.end()
    paragraph(start, len(text))
    return spans


def sentences(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, sent_no, start_char, end_char: the sentence units of df[column], in text order.

    Offsets are code points, the end is exclusive. Null, empty and blank texts give no row; a text without words is one
    unit a paragraph. Repeated rows are divided each for itself, and columns other than key and column are not read.
    Time is linear in the length of a text. No shuffle.
    """
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("string").alias("text"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, sent_no int, start_char int, end_char int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in batches for piece in slices(batch, 1)):
            found = [sentence_spans(x) for x in part.column(1).to_pylist()]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.array([s for spans in found for s in spans], dtype=np.int32).reshape(-1, 2)
            rows = np.repeat(np.arange(len(found)), counts)
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)),
                    pa.array((np.arange(len(rows)) - first[rows]).astype(np.int32)),
                    pa.array(flat[:, 0]),
                    pa.array(flat[:, 1]),
                ],
                names=[key, "sent_no", "start_char", "end_char"],
            )

    return kept.mapInArrow(run, schema)
