"""Sentence boundaries across languages and scripts.

The break rules are those of the Unicode standard for sentence segmentation,
written for whole paragraphs: terminators by their property (full stops that may
also abbreviate, and marks that always terminate), closing marks that belong to
the sentence, and continuing marks after which nothing ends. On top of them come
suppressed abbreviations by language, matched quotes and brackets, list marks and
Thai, which ends sentences with a space.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Line ends other than the paragraph separator.
_NL = "\n\r\v\f\x85\u2028"
_BLANK_LINE = re.compile(rf"(?:\r\n|[{_NL}])(?:[^\S{_NL}\u2029]*(?:\r\n|[{_NL}]))+|\u2029")

#: All characters with the property Sentence_Terminal but the full stop, which may also abbreviate.
_STOPS = "".join(regex.findall(r"(?!\.)\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))
_GREEK_QUESTION = "\u037e"
_RUN = re.compile(rf"[.{re.escape(_STOPS)}…{_GREEK_QUESTION}]+|(?<=[Ͱ-Ͽἀ-῿]);")

#: What opens and closes quotations and brackets.
_CLOSERS = {
    "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "\"": "\"", "＂": "＂",
    "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "〔": "〕", "［": "］", "｛": "｝",
}
_BRACKETS = set("([{（【〔［｛")
_MARKS = re.compile("[" + re.escape("".join({*"".join(_CLOSERS.values()), *_CLOSERS})) + "]")
_ALL_CLOSERS = set("".join(_CLOSERS.values())) - {"“", "‘"} | {"’"}

#: Marks after which a sentence goes on.
_CONTINUE = set(",;:-–—、，；：،؛;")

#: Abbreviations that end no sentence, by language.
ABBREVIATIONS = {
    "en": "dr prof st mr mrs ms messrs gen col capt lt sgt rev hon gov sen rep vs cf approx e.g i.e viz resp ca",
    "de": "dr prof bzw ca vgl ggü evtl inkl exkl zzgl bspw sog ggf d.h z.b u.a i.d.r hrsg hl str",
    "fr": "mme mlle mgr cf env p.ex",
    "es": "sr sra srta dr dra d.ª ud uds ee avda lic ing",
    "ru": "проф акад доц др ул им см напр т.е т.н т.к тыс млн млрд гр",
    "el": "κα κος δρ καθ π.χ δηλ",
    "hi": "डॉ श्री प्रो कु",
    "ar": "أ.د",
}
#: Abbreviations only before a number.
BEFORE_NUMBERS = {
    "en": "no nos fig figs vol ch sec eq pp pg jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr abs abb tab bd kap ziff art anm",
    "fr": "art chap fig tab éd",
    "es": "pág págs art cap núm fig",
    "ru": "рис табл стр гл ст разд",
    "el": "σελ αρ κεφ εικ",
}
#: Month names after German ordinals.
_GERMAN_MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

#: Words that begin a sentence and no name; after one letter or an address's abbreviation they show that a sentence ended.
STARTERS = {
    "en": "he she it they we you the this that these those then there here when while after before if but and so however",
    "de": "er sie es wir ihr der die das dies diese dieser dann dort hier als nach wenn aber und jedoch",
    "fr": "il elle ils elles nous vous le la les ce cette ces puis alors quand après mais et cependant",
    "es": "él ella ellos ellas nosotros ustedes el la los las este esta estos entonces cuando después pero y sin",
    "ru": "он она оно они мы вы это эти тогда здесь когда после если но однако",
}
#: Abbreviations that may stand before a name as well as at a sentence's end.
EITHER = set("st ave rd blvd hl str avda ул гр inc ltd co corp jr sr".split())


class Language:
    """The abbreviations and sentence beginnings of one language, or of all."""

    def __init__(self, *langs: str) -> None:
        words = lambda lists: {w for lang in langs for w in lists.get(lang, "").split()}
        self.never, self.numbered, self.starters = words(ABBREVIATIONS), words(BEFORE_NUMBERS), words(STARTERS)


_ALL = Language(*dict.fromkeys([*ABBREVIATIONS, *BEFORE_NUMBERS, *STARTERS]))
_LANGUAGES = {lang: Language(lang) for lang in STARTERS}
_LONGEST = max(map(len, _ALL.never)) + 1
_LETTERS = re.compile(r"[^\W\d_]+")


def language_of(text: str, lang: str | None) -> Language:
    """The named language where the text bears it out by words of its own and of no other; else all, since names are often wrong or missing."""
    named = _LANGUAGES.get((lang or "").lower().split("-")[0])
    if named is None:
        return _ALL
    words = {w.lower() for w in _LETTERS.findall(text)}
    own = len(words & named.starters)
    return named if own and all(len(words & other.starters) < own for other in _LANGUAGES.values() if other is not named) else _ALL


_ADDRESS = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]{1,15}://|www\.)[!-~]+|[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+")
_WORD_CHARACTER = re.compile(r"[^\W_]|[̀-ͯऀ-ॣ॰-ॿ]")
_DOTTED_BEFORE = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ॣ॰-ॿ])+(?:\.(?:[^\W_])+)*\.\Z")
_LIST_MARK = re.compile(r"\s*(?:[-*•‣◦▪]|\d{1,3}[.)]|[(（]\d{1,3}[)）]|[A-Za-z]\))[^\S\n\r]+")
_THAI_SPACE = re.compile(r"(?<=[ก-ฺเ-๎])[\s\u200b\u00ad]*\s[\s\u200b\u00ad]*(?=[ก-ฺเ-๎])")
_LINE = re.compile(rf"\r\n|[{_NL}]")
_INVISIBLE = set("\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff")
_UNCASED = re.compile(r"[฀-໿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The outermost matched quotations and brackets of a paragraph; unmatched marks are ordinary characters."""
    stack: list[tuple[int, int]] = []  # place and number of what is open
    waiting: dict[str, list[tuple[int, int]]] = {}  # closing mark -> depth and number of what it would close
    found: list[tuple[int, int]] = []
    number = 0
    for m in _MARKS.finditer(text, start, end):
        mark, at = m.group(), m.start()
        before = text[at - 1] if at > start else " "
        after = text[at + 1] if at + 1 < end else " "
        if mark == "’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        open_ = waiting.get(mark, [])
        while open_ and (open_[-1][0] >= len(stack) or stack[open_[-1][0]][1] != open_[-1][1]):
            open_.pop()  # it went with something around it
        if not open_ and mark in "\"＂" and before.isdigit():
            continue  # inches
        if open_:
            depth = open_.pop()[0]
            found.append((stack[depth][0], at + 1))
            del stack[depth:]
        elif mark in _CLOSERS:
            number += 1
            for closer in _CLOSERS[mark]:
                waiting.setdefault(closer, []).append((len(stack), number))
            stack.append((at, number))
    outer: list[tuple[int, int]] = []
    for span in sorted(found):
        if not outer or span[0] >= outer[-1][1]:
            outer.append(span)
    return outer


class _Paragraph:
    def __init__(self, text: str, start: int, end: int, language: Language) -> None:
        self.text, self.start, self.end, self.language = text, start, end, language
        self.spans = _spans(text, start, end)
        self.opens = [a for a, _ in self.spans]
        self.addresses = [(m.start(), m.end()) for m in _ADDRESS.finditer(text, start, end)]
        self.froms = [a for a, _ in self.addresses]
        self.looked = (0, -1, "none")  # where symbols were last looked through, and what came behind them

    def inside(self, at: int) -> bool:
        i = bisect.bisect_right(self.opens, at) - 1
        return i >= 0 and at < self.spans[i][1]

    def in_address(self, at: int) -> bool:
        """Within an address, not at its very end."""
        i = bisect.bisect_right(self.froms, at) - 1
        return i >= 0 and at < self.addresses[i][1] - 1

    def skip(self, at: int) -> int:
        """Past white space and invisible characters."""
        while at < self.end and (self.text[at].isspace() or self.text[at] in _INVISIBLE):
            at += 1
        return at

    def starts_word(self, at: int) -> str:
        """What kind of word begins at or after ``at``: upper, lower, digit, other (no case), mark or none.

        Symbols and pictures are looked through; a lower-case letter directly before a
        capital (as in product names) counts as upper.
        """
        first, last, kind = self.looked
        if not first <= at <= last:
            last = at
            while (kind := self._kind(last)) is None:
                last += 1
            self.looked = (at, last, kind)
        return kind

    def _kind(self, at: int) -> str | None:
        if at >= self.end:
            return "none"
        c = self.text[at]
        if c.isdigit():
            return "digit"
        if c.isalpha():
            if c.islower():
                return "upper" if at + 1 < self.end and self.text[at + 1].isupper() else "lower"
            return "upper" if c.isupper() or c.istitle() else "other"
        return "mark" if c in _CONTINUE else None

    def word_before(self, at: int) -> str:
        """The letters and digits before ``at``, with what stands before a dot in front of them as far as an abbreviation may reach."""
        first = at
        while first > self.start and _WORD_CHARACTER.match(self.text[first - 1]):
            first -= 1
        if first == at or first == self.start or self.text[first - 1] != ".":
            return self.text[first:at]
        dotted = _DOTTED_BEFORE.search(self.text, max(self.start, first - _LONGEST), first)
        return (dotted.group() if dotted else "") + self.text[first:at]

    def suppressed(self, word: str, nxt: int) -> bool:
        """Whether a full stop after ``word`` only abbreviates, before what stands at ``nxt``."""
        plain = word.lower()
        letter = len(word) == 1 and word.isalpha()
        if not letter and plain not in self.language.never:
            return False
        if letter or plain in EITHER:
            follows = _LETTERS.match(self.text, nxt, self.end)
            return not (follows and follows.group()[0].isupper() and follows.group().lower() in self.language.starters)
        return True

    def stop_ends(self, a: int, b: int) -> bool:
        """Whether the full stop at [a, b) ends a sentence; what follows it is at b."""
        text = self.text
        nxt = self.skip(b)
        if nxt >= self.end:
            return True
        if text[nxt] in _CONTINUE:
            return False
        kind, word = self.starts_word(nxt), self.word_before(a)
        plain = word.lower()
        if self.suppressed(word, nxt):
            return False
        if kind == "digit" and plain in self.language.numbered:
            return False
        if kind == "lower":
            return False
        if nxt == b:  # no space
            if text[nxt] in "*_/\\=&%#@+<>|~^":
                return False
            if kind == "digit":
                return len(word) >= 3 and word.isalpha() and word.islower()
            if "." in word and word.replace(".", "").isalpha() and len(word.split(".")[-1]) == 1:
                return False  # U.S.A
            return bool(word) and kind in ("upper", "other")
        if len(word) <= 2 and word.isdigit() and kind == "upper":
            follows = _LETTERS.match(text, nxt, self.end)
            return not (follows and follows.group().lower() in _GERMAN_MONTHS)
        return True

    def dots_end(self, a: int, b: int) -> bool:
        """An ellipsis ends a sentence only where a new one visibly begins."""
        nxt = self.skip(b)
        if nxt >= self.end:
            return True
        if self.text[nxt] in _CONTINUE:
            return False
        kind = self.starts_word(nxt)
        if nxt == b:
            return kind == "upper" and not _UNCASED.match(self.text[a - 1] if a > self.start else " ")
        return kind in ("upper", "digit", "other", "none")

    def close_ends(self, a: int, b: int, first: int) -> bool:
        """Whether the sentence ends with the quotation or bracket at [a, b); ``first`` is where the sentence began."""
        text = self.text
        before = a - 1
        while before >= first and text[before].isspace():
            before -= 1
        colon = before >= first and text[before] in ":：" and text[a] not in _BRACKETS
        last = b - 2
        while last > a and (text[last].isspace() or text[last] in _ALL_CLOSERS or text[last] in _INVISIBLE):
            last -= 1
        terminated = text[last] in _STOPS or text[last] in ".…" + _GREEK_QUESTION or (text[last] == ";" and "Ͱ" <= text[last - 1] <= "῿")
        if not (terminated or colon):
            return False
        nxt = self.skip(b)
        if nxt >= self.end:
            return True
        if text[nxt] in _CONTINUE or text[nxt] in _ALL_CLOSERS:
            return False
        kind = self.starts_word(nxt)
        if kind in ("lower", "mark"):
            return False
        if colon:
            return True
        at_start = before < first
        if text[a] in _BRACKETS:
            return at_start
        if nxt > b:
            return True
        if _UNCASED.match(text[last - 1]) or kind == "other":
            return False  # scripts without spaces: the words around belong to the quotation's sentence
        return True


def _paragraph(text: str, start: int, end: int, language: Language) -> list[int]:
    """Positions within [start, end) before which a sentence ends."""
    p = _Paragraph(text, start, end, language)
    events: list[tuple[int, int, str]] = []
    skips: list[tuple[int, int]] = []
    mark = _LIST_MARK.match(text, start, end)
    if mark:
        skips.append((start, mark.end()))
    for m in _LINE.finditer(text, start, end):
        mark = _LIST_MARK.match(text, m.end(), end)
        if not mark or p.inside(m.end()):
            continue
        last = m.start() - 1
        while last > start and text[last].isspace():
            last -= 1
        word = p.word_before(last).lower() if text[last] == "." else ""
        if (text[last] in _STOPS or text[last] in ".…" or text[last] in _ALL_CLOSERS) and word not in language.never and word not in language.numbered and len(word) != 1:
            events.append((m.end(), m.end(), "line"))
            skips.append((m.end(), mark.end()))
    marked = [a for a, _ in skips]
    for m in _RUN.finditer(text, start, end):
        i = bisect.bisect_right(marked, m.start()) - 1
        if not p.inside(m.start()) and not (i >= 0 and m.start() < skips[i][1]):
            events.append((m.start(), m.end(), "run"))
    events += [(b - 1, b, "close") for _, b in p.spans]
    if re.search("[ก-ฺ]", text[start:end]):
        events += [(m.start(), m.end(), "thai") for m in _THAI_SPACE.finditer(text, start, end) if not p.inside(m.start())]
    events.sort()
    openings = dict((b, a) for a, b in p.spans)
    cuts: list[int] = []
    first = skips[0][1] if skips and skips[0][0] == start else p.skip(start)
    for a, b, what in events:
        if a < first and what != "line":
            continue
        if what == "run":
            while b < end and text[b] in _ALL_CLOSERS and b not in p.opens[bisect.bisect_left(p.opens, b) : bisect.bisect_left(p.opens, b) + 1]:
                b += 1
            run = text[a:b].rstrip("".join(_ALL_CLOSERS))
            if p.in_address(a):
                ends = False
            elif set(run) <= {".", "…"} and (len(run) > 1 or run == "…"):
                ends = p.dots_end(a, b)
            elif run == ".":
                ends = p.stop_ends(a, b)
            else:
                nxt = p.skip(b)
                ends = nxt >= end or text[nxt] not in _CONTINUE
        elif what == "close":
            ends = p.close_ends(openings[b], b, first) and not (b < end and _RUN.match(text, b))
        else:
            ends = True
        if ends:
            cuts.append(b)
            first = p.skip(b)
            if what == "line":
                i = bisect.bisect_right(marked, b) - 1
                first = skips[i][1]
    return cuts


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without surrounding white space, in order; none for blank text."""
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    at, language = 0, language_of(text, lang)
    for a, b in [*((m.start(), m.end()) for m in _BLANK_LINE.finditer(text)), (len(text), len(text))]:
        if a > at:
            last = at
            for c in _paragraph(text, at, a, language):
                add(last, c)
                last = c
            add(last, a)
        at = b
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, start_pos, end_pos): one row per sentence, in characters from 0, the end exclusive.

    Marks that close a sentence belong to it. Nothing is split within matched quotes
    or brackets; one that is introduced by a colon ends its sentence. A blank line
    always ends a sentence, a single line break is a space. Null, empty and blank
    texts have no sentences; repeated rows give repeated sentences. Each text is
    scanned once from end to end, whatever its length, and no row leaves its task. The
    column ``lang`` may be missing, null or wrong: it only chooses abbreviations.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, starts, ends = [], [], []
            for k, t, named in zip(frame["k"], frame["t"], frame["l"]):
                for a, b in sentence_spans(t, named):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({key: pd.Series(keys, dtype=frame["k"].dtype), "start_pos": pd.Series(starts, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})

    rows = documents.filter(documents[text].isNotNull()).select(documents[key].alias("k"), documents[text].alias("t"), (documents[lang] if lang in documents.columns else F.lit(None)).cast("string").alias("l"))
    return rows.mapInPandas(run, f"`{key}` {kind}, start_pos int, end_pos int")
