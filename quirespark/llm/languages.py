"""The languages of texts and of their stretches.

A text is divided at marks into stretches. The script ranges of its letters name the language of a stretch, or say that it
is one of those in Latin letters. Among these, common words and letters give each word a score for each language, and the
most likely run of languages through the words names the language of each (Viterbi; a change costs SWITCH between stretches
and SWITCH_INSIDE within one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.garbled import is_garbled
from quirespark.llm.tokens import slices

LATIN_LANGS = ("en", "pt", "es", "fr", "de")
#: Cost of a change of language between stretches and within one, and score from which a stretch alone names one.
SWITCH, SWITCH_INSIDE, ENOUGH = 0.7, 4.0, 0.7
_CONSONANTS = frozenset("bcdfghjklmnpqrstvwxz")

# Common words by language, and other codes and names of languages.
COMMON = {
    "en": "the of and to in is was were are be been it its that this which for on with as by at from not or an a he she they we you i his her their our has have had but if when there no what who will would can could all any more most than into after before near each every one two without again really about only still nothing found lost missing says said note see so then out up same both first second how do does did my your me him us new old them these those other some such very never always just because while where through during between",
    "pt": "o a os as um uma de do da dos das em no na nos nas por para com sem que e é não se mais mas ao à aos às pelo pela ou foi são está estão como seu sua quem isto isso este esta esse essa ele ela eles elas nós eu você já também até entre depois antes sobre quando muito ainda nada tudo todo toda nenhum tem têm ser há junto apesar cada onde num numa ver realmente diz nota outro outra outros foram era só aqui mesma mesmo dois duas desde",
    "es": "el la los las un una de del al en por para con sin que y es no se más pero o fue son está están como su sus quien esto eso este esta ese esa él ella ellos nosotros yo usted ya también hasta entre después antes sobre cuando muy aún nada todo toda ningún tiene tienen ser hay junto pesar cada donde lo le les ver realmente dice nota otro otra otros fueron era sólo solo aquí misma mismo dos desde y e ni",
    "fr": "env chap éd compte voir le la les un une des de du au aux en dans par pour avec sans que qui et est ne pas se plus mais ou fut sont a ont été comme son sa ses ce cette ces il elle ils elles nous vous je on déjà aussi entre après avant sur quand très encore rien tout toute aucun y près malgré chaque où leur leurs voir vraiment dit note autre autres était seulement ici même deux depuis jusqu l d n s c j m t qu",
    "de": "der die das den dem des ein eine einen einem einer eines und ist nicht zu im in am an auf aus bei mit nach von vor für über unter zwischen ohne trotz seit bis um als wie aber oder auch noch nur schon wenn dass daß war waren sind sein hat haben wird werden wurde er sie es wir ich ihr man sich kein keine nichts alles jede jeder wieder wirklich sagt hier dieselbe derselbe beide zwei durch gegen dieser diese dieses zum zur vom was wer wo",
}
CUES = {"pt": re.compile("[ãõ]|ç[ãõ]"), "es": re.compile("ñ|ción$|[^aeo]ión$"), "fr": re.compile("[èêîûëïœù]|^[ldnscjm]['’]|^qu['’]"), "de": re.compile("[ßäö]|ung$|sch")}
OTHER_CODES = {"fre": "fr", "ger": "de", "chi": "zh", "cmn": "zh"}
#: Ranges of the scripts; of a stretch without kana, Han letters are Chinese.
SCRIPTS = {"ru": "Ѐ-ԯ", "ar": "؀-ؚؠ-ۓۥ-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ", "hi": "ऀ-ॣ०-ॿ", "th": "฀-๿", "han": "々㐀-䶿一-鿿豈-﫿", "kana": "぀-ヿㇰ-ㇿｦ-ﾟ"}
_END = ".!?…。！？।॥؟۔｡"
_TOKEN = re.compile(
    r"(?P<skip>(?:https?|ftp)://[!-~]+|[A-Za-z0-9_-]+(?:[./@#:]+[A-Za-z0-9_-]+)+|[A-Za-z_-]*[0-9][A-Za-z0-9_-]*)"
    r"|(?P<latin>[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ]+(?:['’](?=[A-Za-zÀ-ÿ]))?)|"
    + "|".join(f"(?P<{k}>[{v}]+)" for k, v in SCRIPTS.items())
    + rf"|(?P<end>[{re.escape(_END)}]+)|(?P<edge>[«»“”„「」『』()（）:：;；\"]|(?:\r\n|[\n\r])[^\S\r\n]*(?:\r\n|[\n\r])\s*)"
)


def _weights() -> dict[str, list[tuple[int, float]]]:
    found: dict[str, list[tuple[int, float]]] = {}
    for i, lang in enumerate(LATIN_LANGS):
        for word in set(COMMON[lang].split()):
            found.setdefault(word, []).append((i, 1.0))
    return {w: [(i, 1.0 / len(of)) for i, _ in of] for w, of in found.items()}


_WEIGHTS = _weights()
_KNOWN: dict[str, list[tuple[int, float]]] = {}


def _word(word: str) -> list[tuple[int, float]]:
    """What a word in lower case says for each language in Latin letters."""
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        found = _WEIGHTS.get(word.rstrip("'’"), []) + [(LATIN_LANGS.index(k), 0.6) for k, cue in CUES.items() if cue.search(word)]
        _KNOWN[word] = found
    return found


#: Words; a single consonant is one before an apostrophe only, otherwise an initial.
_LATIN_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]{2,}|(?<![A-Za-zÀ-ÖØ-öø-ÿ])(?:[AEIOYaeioyÀÉàéÓó]|[b-df-hj-np-tv-z](?=['’]))(?![A-Za-zÀ-ÖØ-öø-ÿ.])")


def word_scores(text: str, start: int, end: int) -> list[float]:
    """What the words of a stretch say for each language in Latin letters."""
    scores = [0.0] * len(LATIN_LANGS)
    for found in _LATIN_WORDS.finditer(text, start, end):
        for i, weight in _word(found[0].lower()):
            scores[i] += weight
    return scores


def _says(word: str) -> list[tuple[int, float]]:
    """What a word as it is written says; a single consonant is an initial or the like."""
    found = _SAID.get(word)
    if found is None:
        if len(_SAID) > 200_000:
            _SAID.clear()
        found = _SAID[word] = [] if len(word) == 1 and word.lower() in _CONSONANTS else _word(word.lower())
    return found


_SAID: dict[str, list[tuple[int, float]]] = {}


class _Stretch:
    __slots__ = ("start", "end", "latin", "scores", "counts", "ended", "said")

    def __init__(self) -> None:
        self.start = self.end = -1
        self.latin, self.scores, self.counts, self.ended = 0, [0.0] * len(LATIN_LANGS), {}, False
        self.said: list[list[tuple[int, float]]] = []  # by the words that say something

    def words(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """The words in Latin letters, with what they say."""
        for found in _TOKEN.finditer(text, self.start, self.end):
            if found.lastgroup == "latin":
                yield found.start(), found.end(), _says(found[0])

    def rows(self) -> list[list[float]]:
        """The scores Viterbi goes through: of each word that says something, or of all together where no change within can
        pay: leaving the best language costs SWITCH_INSIDE and perhaps the ends' changes, and gains no more than other
        languages have above it."""
        best = max(self.scores)
        if sum(self.scores) - best + 2 * SWITCH >= SWITCH_INSIDE:
            top, gain = self.scores.index(best), 0.0
            for says in self.said:
                own = most = 0.0
                for i, weight in says:
                    if i == top:
                        own += weight
                    elif weight > most:
                        most = weight
                if most > own:
                    gain += sum(weight for i, weight in says if i != top) - own
            if gain + 2 * SWITCH >= SWITCH_INSIDE:
                return [[sum(weight for j, weight in says if j == i) for i in range(len(LATIN_LANGS))] for says in self.said]
        return [self.scores]

    def parted(self, text: str, states: list[int]) -> list[tuple["_Stretch", int]]:
        """The stretch in parts of one language each."""
        if len(set(states)) == 1:
            return [(self, states[0])]
        parts: list[tuple[_Stretch, int]] = []
        k = 0
        for start, end, says in self.words(text):
            if says:
                state, k = states[k], k + 1
            else:
                state = parts[-1][1] if parts else states[0]
            if not parts or parts[-1][1] != state:
                parts.append((_Stretch(), state))
                parts[-1][0].start = start
            part = parts[-1][0]
            part.end = end
            part.latin += 1
            for i, weight in says:
                part.scores[i] += weight
            part.counts["latin"] = part.counts.get("latin", 0) + end - start
        last = parts[-1][0]
        last.end, last.ended = self.end, self.ended
        return parts


def _stretches(text: str) -> list[_Stretch]:
    out: list[_Stretch] = []
    # what the open stretch holds so far
    begin, last, words, letters, said, counts = -1, -1, 0, 0, [], {}

    def close(ended: bool = False) -> None:
        nonlocal begin, words, letters, said, counts
        now = _Stretch()
        now.start, now.end, now.latin, now.said, now.counts, now.ended = begin, last, words, said, counts, ended
        if letters:
            counts["latin"] = letters
            scores = now.scores
            for says in said:
                for i, weight in says:
                    scores[i] += weight
        out.append(now)
        begin, words, letters, said, counts = -1, 0, 0, [], {}

    for found in _TOKEN.finditer(text):
        kind = found.lastgroup
        if kind == "latin":
            if "th" in counts:
                close()
            start, last = found.span()
            if begin < 0:
                begin = start
            words += 1
            letters += last - start
            word = found[0]
            says = _SAID.get(word)
            if says is None:
                says = _says(word)
            if says:
                said.append(says)
        elif kind == "skip":
            continue
        elif kind == "end":
            if begin >= 0:
                last = found.end()
                close(True)
        elif kind == "edge":
            if begin >= 0:
                close()
        else:
            if begin >= 0 and (kind == "th") != ("th" in counts):  # Thai has no mark at the end of a sentence
                close()
            start, last = found.span()
            if begin < 0:
                begin = start
            counts[kind] = counts.get(kind, 0) + last - start
    if begin >= 0:
        close()
    return out


def _viterbi(rows: list[list[float]], costs: list[float]) -> list[int]:
    """The most likely run of states, where a change before a row has its cost."""
    # a state that is nowhere below another is the best throughout
    for first in rows:
        top = max(first)
        if top > 0:
            state = first.index(top)
            for row in rows:
                if row[state] < max(row):
                    break
            else:
                return [state] * len(rows)
            break
    best, back = rows[0], []
    for row, cost in zip(rows[1:], costs[1:]):
        top = max(range(len(best)), key=best.__getitem__)
        came = [i if best[i] >= best[top] - cost else top for i in range(len(best))]
        best = [row[i] + max(best[i], best[top] - cost) for i in range(len(best))]
        back.append(came)
    states = [max(range(len(best)), key=best.__getitem__)]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def language_spans(text: str | None) -> list[tuple[int, int, str, float, bool]]:
    """start, end, language, confidence, and whether it has a full sentence: the stretches of a text in text order.

    Offsets are code points. Neighbouring stretches of one language are one. A text without words has none.
    """
    if not text:
        return []
    stretches = _stretches(text)
    kana = any("kana" in s.counts for s in stretches)
    named: list[str | None] = []
    for s in stretches:
        east = s.counts.get("han", 0) + s.counts.get("kana", 0)
        sizes = {k: n for k, n in s.counts.items() if k not in ("han", "kana")}
        if east:
            short = east < 8 and kana
            sizes["ja" if "kana" in s.counts or short else "zh"] = 3 * east  # a letter says as much as three of an alphabet
        top = max(sizes, key=sizes.get)
        named.append(None if top == "latin" else top)
    each = [s.rows() if name is None else [] for s, name in zip(stretches, named)]
    rows = [row for of in each for row in of]
    if rows:
        states = _viterbi(rows, [SWITCH_INSIDE if k else SWITCH for of in each for k in range(len(of))])
        parted: list[tuple[_Stretch, str | None]] = []
        at = 0
        for s, name, of in zip(stretches, named, each):
            parted += [(part, LATIN_LANGS[state]) for part, state in s.parted(text, states[at : at + len(of)])] if of else [(s, name)]
            at += len(of)
        stretches, named = [x for x, _ in parted], [x for _, x in parted]
    out: list[tuple[int, int, str, float, bool]] = []
    for i, (s, name) in enumerate(zip(stretches, named)):
        letters = sum(s.counts.values())
        if name in LATIN_LANGS:
            own = s.scores[LATIN_LANGS.index(name)]
            sure = 1 / sum(exp(min(x - own, 50)) for x in s.scores)
            full = s.ended and s.latin >= 3 and own >= ENOUGH and own >= max(s.scores)
        else:
            own = sum(n for k, n in s.counts.items() if k == name or name in ("ja", "zh") and k in ("han", "kana"))
            sure = own / letters
            full = letters >= 12 if name == "th" else s.ended and letters >= (5 if name in ("ja", "zh") else 8)
        if out and out[-1][2] == name:
            a, _, _, before, was = out[-1]
            out[-1] = (a, s.end, name, max(before, sure), was or full)
        else:
            out.append((s.start, s.end, name, sure, full))
    return out


def text_languages(text: str | None) -> list[str]:
    """The languages a text has a full sentence in; without one, that of its longest stretch."""
    spans = language_spans(text)
    found = sorted({x[2] for x in spans if x[4]})
    if not found and spans:
        start, end, name, sure, _ = max(spans, key=lambda x: x[1] - x[0])
        if name not in LATIN_LANGS or sure > 0.3:
            found = [name]
    return found


def label_names(names: list[tuple[str, str, str, str]]) -> dict[str, str]:
    """Codes and names of languages, from rows of lang, iso3, name_en, name_native."""
    found = dict(OTHER_CODES)
    for row in names:
        found.update((x.casefold(), row[0]) for x in row if x)
    return found


def label_language(label: str | None, names: dict[str, str]) -> str | None:
    """The language a label names in any usual way, None if it names none."""
    clean = (label or "").strip().casefold()
    first = re.split(r"[-_\s(,;/]", clean, maxsplit=1)[0]
    return names.get(clean) or names.get(first)


def detected(df: DataFrame, key: str, column: str, keep: tuple[str, ...] = (), garbled_under: tuple[str, dict[str, str]] | None = None) -> DataFrame:
    """key, the kept columns, langs ARRAY<STRING>: the languages of df[column]; repeated rows each for itself, no shuffle.

    garbled_under: a kept column of labels and their names. A garbled text has no language then; texts that are of the one
    language their label names aren't looked at for it, as they are no case either way.
    """
    columns = [key, *keep]
    kept = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{column}`").cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(columns)):
                texts = part.column(len(columns)).to_pylist()
                langs = [text_languages(x) for x in texts]
                if garbled_under is not None:
                    label, names = garbled_under
                    said = [label_language(x, names) for x in part.column(columns.index(label)).to_pylist()]
                    langs = [[] if found and found != [one] and is_garbled(x) else found for x, found, one in zip(texts, langs, said)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, type=pa.list_(pa.string()))], names=[*columns, "langs"])

    return kept.mapInArrow(run, f"{fields}, langs array<string>")


def mislabelled(found: DataFrame, key: str, label: str, names: dict[str, str], table: str) -> DataFrame:
    """tab_name, row_key, lang: the languages of the texts of which the label isn't the one language."""
    named = F.udf(lambda x: label_language(x, names))
    wrong = (F.size("langs") != 1) | (F.coalesce(named(F.col(f"`{label}`")), F.lit("")) != F.get("langs", F.lit(0)))
    return found.where(F.size("langs") > 0).where(wrong).select(F.lit(table).alias("tab_name"), F.col(f"`{key}`").cast("string").alias("row_key"), F.explode("langs").alias("lang"))


def unnamed(found: DataFrame, catalog: DataFrame, key: str, listed: str, names: dict[str, str], table: str) -> DataFrame:
    """tab_name, row_key, lang: the languages of a key's texts that its list of languages doesn't name."""
    named = F.udf(lambda xs: sorted({y for x in xs or () if (y := label_language(x, names))}), "array<string>")
    written = found.select(F.col(f"`{key}`").alias("row_key"), F.explode("langs").alias("lang")).distinct()
    wanted = catalog.select(F.col(f"`{key}`").alias("row_key"), named(F.col(f"`{listed}`")).alias("named"))
    return written.join(wanted, "row_key").where(~F.array_contains("named", F.col("lang"))).select(F.lit(table).alias("tab_name"), "row_key", "lang")
