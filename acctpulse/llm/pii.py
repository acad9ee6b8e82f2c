"""Personal data, also in disguise: normalise, detect, and map the spans back.

The base detectors read the text as it is. Then transducers rewrite it piece by piece (look-alike letters, spelled
digits, "at" and "dot" in words or brackets), keeping for every character they write the source characters it stands
for. The same detectors read the result, and a span found there that rests on something rewritten is mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from acctpulse.llm import spans as S
from acctpulse.llm.spans import Span

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address lies inside a run of digits and dots. One that fails from a number's first digit fails from its others,
# so later starts inside a number need not be tried.
_NUMBERS = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[Span]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits]
    for i in range(len(doubled) - 2, -1, -2):
        doubled[i] = 2 * doubled[i] - 9 * (doubled[i] > 4)
    return sum(doubled) % 10 == 0


def _ascii_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """The base detectors, by kind, then start."""
    found = _emails(text)
    runs = (m for run in _NUMBERS.finditer(text) if run[0].count(".") > 2 for m in _IP.finditer(text, *run.span()))
    for m in runs:
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _ascii_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_ascii_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like these.
LOOK_ALIKES = {
    "а": "a", "А": "A", "В": "B", "е": "e", "Е": "E", "ё": "e", "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "М": "M", "Н": "H", "о": "o",
    "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "ѕ": "s", "Ѕ": "S", "Т": "T", "у": "y", "х": "x", "Х": "X", "ԁ": "d", "һ": "h", "ԛ": "q",
    "ԝ": "w", "α": "a", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "ι": "i", "Κ": "K", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o",
    "Ο": "O", "ρ": "p", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "։": ":", "․": ".", "。": ".", "｡": ".", "·": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "null": 0, "eins": 1,
    "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zéro": 0, "un": 1, "deux": 2, "trois": 3,
    "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6,
    "siete": 7, "ocho": 8, "nueve": 9, "oh": 0,
}
AT_WORDS, DOT_WORDS = ["at", "arroba", "chez"], ["dot", "punkt", "point", "punto"]
TOP_LEVEL = set(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu "
    "cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id "
    "ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms "
    "mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl "
    "sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw com org "
    "net edu gov mil int arpa info biz name pro mobi app dev xyz online site shop store tech cloud blog agency asia tel jobs travel museum aero coop cat "
    "berlin london paris example test invalid localhost".split()
)
#: Of these, the ones that also begin sentences: behind a full stop and a space they are no top-level label.
ALSO_WORDS = set("ad ai am as by do id im is la ma my na ne om pa pm re si so st to tu va name online site shop store tech cloud blog travel pro cat jobs london paris berlin test".split())
NOT_A_NAME = set(
    "the a an this that these those his her its my our your their all some any one no what which each every another other such certain same most".split()
)
NOT_A_PERSON = set("i me us him her them you it more here one this that".split())


def _wide() -> dict[str, str]:
    """Full-width, circled and mathematical letters and digits, and digits of other scripts, by Unicode's own tables."""
    found = {}
    for first, last in ((0xFF01, 0xFF5E), (0x2460, 0x24E9), (0x1D400, 0x1D7FF)):
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii():
                found[chr(code)] = plain
    for first in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50):
        found |= {chr(first + d): str(d) for d in range(10)}
    return found


LETTERS = _wide() | LOOK_ALIKES | dict.fromkeys(INVISIBLE, "")
_LATIN_LETTERS = [c for c in LETTERS if c <= "\xff"]
_LETTER = re.compile("[" + "".join(map(re.escape, LETTERS)) + "]")
_number = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]+)?{_number}(?:[\s,-]+(?:{_number}|[0-9]+)){{2,}}(?!\w)", re.I)
_SPELLED_WORD = re.compile(rf"plus|{_number}|[0-9]+", re.I)
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_ENTITY = re.compile(r"&#0*(?:64|46);|&#x0*(?:40|2e);|&commat;|&period;|(?<=\w)%40(?=\w)", re.I)
_BRACKET = re.compile(rf"\s*[\[({{<]\s*(?:({_at}|@)|({_dot}|\.))\s*[\])}}>]\s*", re.I)
_name = r"[A-Za-z0-9_%+-]+"
_PLAIN = re.compile(
    rf"(?<![\w.@])({_name}(?:(?:\.|\s+(?:{_dot})\s+){_name})*)(\s+(?:{_at})\s+|\s+@\s*|\s*@\s+)((?:[A-Za-z0-9-]+(?:\s*\.\s*|\s+(?:{_dot})\s+))+)([A-Za-z]{{2,}})(?!\w)",
    re.I,
)
_WORD_DOT = re.compile(rf"\s+(?:{_dot})\s+|\s*\.\s*", re.I)
_SPELLED_DOT = re.compile(rf"(?<=[0-9])\s+(?:{_dot})\s+(?=[0-9])", re.I)


class Tape:
    """A text being rewritten, and the changes of each step, from which spans are mapped back to the source.

    A step keeps where its changes begin and end before and after it, so memory follows the changes and not the text.
    """

    def __init__(self, text: str):
        self.text = text
        self.steps: list[np.ndarray] = []  # rows: start and end before, start and end after

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace ``[start, end)`` by a string, for changes in order that do not overlap."""
        if not changes:
            return
        parts, at = [], 0
        for a, b, put in changes:
            parts += [self.text[at:a], put]
            at = b
        self.text = "".join([*parts, self.text[at:]])
        before = np.array([c[:2] for c in changes], np.int64).T
        sizes = np.array([len(put) for _, _, put in changes], np.int64)
        grown = np.cumsum(sizes - (before[1] - before[0]))
        after = before[1] + grown
        self.steps.append(np.stack([*before, after - sizes, after]))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span of the text, and whether it rests on a change. What was taken out belongs to the
        character before it."""
        changed, last = False, end - 1
        for a, b, out_a, out_b in reversed(self.steps):
            # Changes that write into the span, or take something out behind one of its characters.
            first = np.searchsorted(out_b, start, side="right")
            reach = np.searchsorted(out_a, last, side="right")
            touched = bool(np.any(out_b[first:reach] > out_a[first:reach]))
            taken = (out_b == out_a) & (out_a - 1 >= start) & (out_a - 1 <= last) if not touched else ()
            changed = changed or touched or bool(np.any(taken))
            k = np.searchsorted(out_a, start, side="right") - 1
            start = int(a[k]) if k >= 0 and out_a[k] <= start < out_b[k] else int(start - out_b[k] + b[k]) if k >= 0 else start
            k = np.searchsorted(out_a, last, side="right") - 1
            inside = k >= 0 and out_a[k] <= last < out_b[k]
            last = int(b[k]) - 1 if inside else int(last - out_b[k] + b[k]) if k >= 0 else last
        return int(start), int(last) + 1, changed


def _letters(text: str) -> list[tuple[int, int, str]]:
    try:
        text.encode("latin-1")
        plain = not any(c in text for c in _LATIN_LETTERS)
    except UnicodeEncodeError:
        plain = False
    return [] if plain else [(*m.span(), LETTERS[m[0]]) for m in _LETTER.finditer(text)]


def _entities(text: str) -> list[tuple[int, int, str]]:
    marks = _ENTITY.finditer(text) if "&" in text or "%40" in text else ()
    return [(*m.span(), "@" if re.search("64|40|commat", m[0], re.I) else ".") for m in marks]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _SPELLED.finditer(text):
        words = list(_SPELLED_WORD.finditer(text, *run.span()))
        stops = [*(w.start() for w in words[1:]), run.end()]
        for word, stop in zip(words, stops):
            put = "+" if word[0].lower() == "plus" else str(DIGIT_WORDS.get(word[0].lower(), word[0]))
            out.append((word.start(), stop, put))
    return out


def _brackets(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m[1] else ".") for m in _BRACKET.finditer(text)]


def _is_address(text: str, m: re.Match) -> bool:
    """Whether a match of ``_PLAIN`` is an address.

    With "dot" spelled, any top-level label will do; the other words for it are common, so they need a known one, as does a
    real dot. A bare "at" with a real dot counts where the name or the words before it mark an address.
    """
    hosts, label = re.split(_WORD_DOT, m[3]), m[4].lower()
    if hosts[0].lower() in NOT_A_NAME or len(label) > 63:
        return False
    if _SPELLED_ANY.search(m[3]):
        return label in TOP_LEVEL or _SPELLED_SURE.search(m[3]) is not None
    if label not in TOP_LEVEL or (label in ALSO_WORDS and m[3][-1].isspace()):
        return False
    if "@" in m[2]:
        return True
    if re.search(r"\s", m[3]) or m[1].lower() in NOT_A_PERSON:
        return False
    return _MARKED.search(m[1]) is not None or _ANNOUNCED.search(text, max(0, m.start() - 60), m.start()) is not None


def _plain(text: str) -> list[tuple[int, int, str]]:
    """``name at host dot com``, ``name @ host . com`` and ``first.last at host.com``."""
    out, at = [], 0
    while m := _PLAIN.search(text, at):
        at = m.end(2)
        if not _is_address(text, m):
            continue
        out += [(*d.span(), ".") for d in _WORD_DOT.finditer(text, *m.span(1)) if d[0] != "."]
        out.append((*m.span(2), "@"))
        out += [(*d.span(), ".") for d in _WORD_DOT.finditer(text, *m.span(3)) if d[0] != "."]
        at = m.end()
    return out


_SPELLED_ANY = re.compile(rf"\s(?:{_dot})\s", re.I)
_SPELLED_SURE = re.compile(r"\sdot\s", re.I)
#: Names as no plain word has them, and words that announce an address.
_MARKED = re.compile(r"[A-Za-z0-9][._+](?=[A-Za-z0-9])|[A-Za-z][0-9]|\s", re.I)
_ANNOUNCED = re.compile(
    r"(?:(?:e-?mail|mail|contact|kontakt|correo|courriel|address|adresse)\s*[:=]\s*"
    r"|(?:write|mail|e-?mail|send|reply|schreiben)\s+(?:\w+\s+){0,2}(?:to|an)\s+|(?:address|adresse|e-?mail)\s+(?:is|ist|est|es)\s+)\Z",
    re.I,
)
_BARE_AT = re.compile(rf"\b(?:{_at})\s+[A-Za-z0-9-]+\.[A-Za-z]", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_at}|{_dot}|@|\.)\s*[\])}}>]", re.I)
_SPACED_AT = re.compile(r"@\s|(?<=\s)@")
#: Characters set apart by single spaces, and numbers of single digits between spelled dots.
_SET_APART = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+-] ){2,}@(?: [A-Za-z0-9.-]){4,}(?!\S)")
_DIGITS_APART = re.compile(rf"(?<!\w)[0-9](?: [0-9]){{0,2}}(?:\s+(?:{_dot})\s+[0-9](?: [0-9]){{0,2}}){{3}}(?!\w)", re.I)
_BETWEEN = re.compile(r"(?<=[0-9]) (?=[0-9])")
_SEPARATORS = str.maketrans(",-", "  ")


def _set_apart(text: str) -> list[tuple[int, int, str]]:
    """``j a n e @ x . c o m``: the spaces are taken out."""
    return [(k, k + 1, "") for m in _SET_APART.finditer(text) for k in range(m.start() + 1, m.end(), 2)]


def _digits_apart(text: str) -> list[tuple[int, int, str]]:
    """``1 9 2 dot 1 6 8 dot 1 dot 1``: the spaces inside the numbers are taken out."""
    return [(*space.span(), "") for m in _DIGITS_APART.finditer(text) for space in _BETWEEN.finditer(text, *m.span())]


def normalised(text: str) -> Tape:
    """All steps in turn; those are left out whose words or marks the text does not hold."""
    tape = Tape(text)
    tape.rewrite(_letters(tape.text))
    tape.rewrite(_entities(tape.text))
    words = set(tape.text.lower().translate(_SEPARATORS).split())
    dots = not words.isdisjoint(DOT_WORDS)
    if not words.isdisjoint(DIGIT_WORDS):
        tape.rewrite(_spelled(tape.text))
    if " @ " in tape.text:
        tape.rewrite(_set_apart(tape.text))
    if dots:
        tape.rewrite(_digits_apart(tape.text))
    if _BRACKETED.search(tape.text):
        tape.rewrite(_brackets(tape.text))
    bare = not words.isdisjoint(AT_WORDS) and _BARE_AT.search(tape.text)
    if dots or bare or ("@" in tape.text and _SPACED_AT.search(tape.text)):
        tape.rewrite(_plain(tape.text))
    if dots:
        tape.rewrite([(*m.span(), ".") for m in _SPELLED_DOT.finditer(tape.text)])
    return tape


def personal_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans found only after normalising, which lie in no base span of their kind."""
    base, tape, added = base_spans(text), normalised(text), []
    if tape.steps:
        # Base spans of a kind do not overlap, so only the last that starts no later can hold another.
        starts = {kind: [s for k, s, _ in base if k == kind] for kind in KINDS}
        ends = {kind: [e for k, _, e in base if k == kind] for kind in KINDS}
        for kind, a, b in base_spans(tape.text):
            start, end, changed = tape.source(a, b)
            last = bisect_right(starts[kind], start) - 1
            if changed and not (last >= 0 and end <= ends[kind][last]):
                added.append((kind, start, end))
    return base, added


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: spans ``(kind, start, end)`` in code points of every whole text.

    Null text is empty and has none. A null ``doc_id`` stays null; repeated rows are returned each; no rows give no rows.
    Other columns are not read. Added spans never replace base ones, but may hold or overlap them.
    """
    return S.find_spans(docs, lambda: personal_spans)


def digest(found: DataFrame) -> DataFrame:
    return S.digest(found, KINDS, ["place", "start"], KINDS)
