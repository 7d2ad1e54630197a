"""Sentence boundaries across languages and scripts (problem 10).

A pushdown automaton reads each text once. Its stack holds open quotations and brackets, and for lines the
open list levels with the number each has come to; its line state tells headings, list items and running
text apart; tries of abbreviations are walked back from every full stop; each script has its own end marks.
What it must know of the sentence so far it keeps as state. It emits code point offsets.

Rules, in the order they apply:
  * tags are white space, those that break lines are line breaks;
  * a number at the start of a line is a list marker if it is 1 or goes on an open list level; any other is one unless
    it stands where the line before goes on, after a word that a day follows;
  * a blank line, a list marker on the next line, or a line break after a line without end mark
    ends a unit, unless the next line goes on in lower case, or the paragraph is evidently wrapped
    at a width that the next word would have passed;
  * an end mark ends a sentence unless it stands in an open quotation or bracket that is part of a
    larger sentence, in a number, name or file name, or after an abbreviation that goes on;
  * closing quotes and brackets and pictographs after the end mark belong to the sentence;
  * Thai sentences end at white space after a polite closing particle.

Defined results: null and blank texts give nothing; texts without any end mark give one unit a
paragraph; text length is not limited (time is linear in it); repeated documents give the same
rows for each id.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.llm.text import TAG

END_MARKS = ".!?…。！？｡।॥؟۔‼⁇⁈⁉"
_STRONG = set("!?。！？｡।॥؟۔‼⁇⁈⁉")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "［": "］", "“": "”", "„": "“”", "«": "»", "‹": "›", "‚": "‘’", '"': '"'}
_BRACKETS = set("([{（【［")
_CLOSERS = "\"'”’»›)]}）」』】》〉］"
_BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|h[1-6])\b", re.I)
_LINE_END = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
_MARKER = re.compile(r"(?:[•\-*–—‣·◦▪●○■□➢✓✔→]|\(?\d{1,3}[.)]|\(?[A-Za-z]\)|[①-⑳]|\d{1,2}、)(?=\s)|\d{1,2}、|•")
_THAI = re.compile(r"(?:ครับผม|ครับ|คับ|ค่ะ|คะ|จ้ะ|จ๊ะ|จ้า|ฮะ)$")
_PICTOGRAPH = re.compile(
    "(?:[\U0001f1e6-\U0001f1ff]{2}|[\U0001f000-\U0001faff☀-➿⬀-⯿⌀-⏿™ℹ↔-↪〰㊗㊙][︎️\U0001f3fb-\U0001f3ff⃣]*"
    "(?:‍[\U0001f000-\U0001faff☀-➿][︎️\U0001f3fb-\U0001f3ff]*)*|[︎️‍])+"
)
_APART = frozenset("([{（“”„«\"'’,;:!?/")
_LETTERS = re.compile(r"[^\W\d_]*")
_DIGITS = re.compile(r"[\d.]*")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]?")
_NUMBERED = re.compile(r"\(?(\d{1,3})[.)、]|\(?([A-Za-z])\)")
#: Words that a day of the month follows.
_BEFORE_DAY = frozenset("am im vom zum der die das dem den des ab bis seit".split())
_IN_PICTOGRAPH = re.compile("[\U0001f000-\U0001faff☀-➿⬀-⯿⌀-⏿™ℹ↔-↪〰㊗㊙\ufe0e\ufe0f\u20e3\u200d]")
_NEXT_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_FILE_ENDINGS = frozenset("pdf txt doc docx html htm jpg jpeg png gif zip csv json xml exe mp3 mp4 com org net io de fr es co uk py js md epub mobi".split())
#: Words of saying: a quotation whose clause goes on with one of them goes on in the same sentence.
_SAYING = re.compile(r"\b(?:said|says|say|asked|asks|wrote|writes|replied|added|told|answered|explained|shouted)\b|[说問问道喊答写叫]", re.I)
#: Verbs that a quotation is the subject of: no statement begins with them.
_FINITE = re.compile(r"(?:is|are|was|were|has|had|sounds|means|ist|war|sind|waren|es|era|fue|eran|fueron|est|était|sont|étaient)\b", re.I)
_JA_GOES_ON = ("と", "って", "という", "は", "が", "を", "に", "も", "の", "で")
#: Words that carry a sentence on after an abbreviation that may also end one.
_CARRY_ON = frozenset("on and or but for in at of to with without per y o e et ou und oder a de la le les des".split())

#: Abbreviations by class. title: never ends a sentence. number: does not before a number.
#: on: does not, unless a capital follows in mixed-case text. may_end: ends before a capital,
#: and in text of one case before anything but a word that carries on. firm: as on, also over a line break.
ABBREVIATIONS = {
    "title": "i.e e.g mr mrs ms dr prof st mme mlle mgr sr sra srta sres dra dña hr fr rev gen col lt capt sgt jr ee डॉ प्रो श्री د أ م ص cf vgl bspw approx ca núm vs al eg ie z.b d.h u.a bzw ggf inkl zzgl evtl ej dept fig figs p.ej resp std tel",
    "number": "no nos vol vols p pp pg nr art ch sec bd kap aufl pág págs cap chap jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic jän okt dez ver v abb seite",
    "firm": "inc ltd co corp bros assn",
    "on": "janv févr avr juil déc lbs lb oz hrs hr ft mm cm kg gal min mins secs dist est",
    "may_end": "etc usw uu p.m a.m u.s u.k u.s.a e.u ca etc ff",
}


def _trie() -> dict:
    root: dict = {}
    for kind, names in ABBREVIATIONS.items():
        for name in names.split():
            node = root
            for c in reversed(name):
                node = node.setdefault(c, {})
            node.setdefault("", kind)
    return root


_ABBREVIATION_TRIE = _trie()


def _abbreviation(text: str, stop: int, start: int) -> str | None:
    """The class of the abbreviation that ends right before the full stop, by walking the trie backwards."""
    node, k, found = _ABBREVIATION_TRIE, stop - 1, None
    while k >= start and (node := node.get(text[k].lower())):
        if "" in node and (k == start or not (text[k - 1].isalnum() or text[k - 1] in "._'’")):
            found = node[""]
        k -= 1
    return found


def _mask(text: str) -> str:
    """Tags as white space of the same length."""
    if "<" not in text:
        return text
    return TAG.sub(lambda m: ("\n" if _BREAK_TAG.match(m[0]) else " ") + " " * (len(m[0]) - 1), text)


def _bare_end(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] ends with an end mark, closers and pictographs apart."""
    while end > start:
        c = text[end - 1]
        if c.isspace() or c in _CLOSERS or _IN_PICTOGRAPH.match(c):
            end -= 1
        else:
            return c in END_MARKS
    return False


class _Levels:
    """The stack of open list levels: the kind of marker and the place each has come to."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []

    def item(self, text: str, at: int) -> bool:
        """Take in a line that starts with a marker; whether it opens a level or goes on one (a bullet always does)."""
        m = _NUMBERED.match(text, at)
        if not m:
            kind, place = text[at], 0
        elif m[1]:
            kind, place = m[0].replace(m[1], "0"), int(m[1])
        else:
            kind, place = m[0].replace(m[2], "a"), ord(m[2].lower()) - 96
        level = next((k for k, (x, _) in enumerate(self.stack) if x == kind), None)  # a kind of marker has one level at most
        if m and place != 1 and (level is None or self.stack[level][1] + 1 != place):
            return False
        if level is not None:
            del self.stack[level:]  # deeper levels end
        self.stack.append((kind, place))
        return True


def _units(text: str) -> list[tuple[int, int, bool]]:
    """Stretches between hard line breaks: (start, end, starts with a list marker)."""
    lines, at = [], 0
    for m in _LINE_END.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    kept = []  # (start, end, blank line before)
    blank = False
    for a, b in lines:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            blank = True
            continue
        kept.append((a, b, blank))
        blank = False
    if not kept:
        return []
    # which breaks are soft: by lower case first, then by the width of wrapped paragraphs
    n = len(kept)
    ended = [_bare_end(text, a, b) for a, b, _ in kept]
    soft = [False] * n
    one_case = text == text.lower() or text == text.upper()
    levels, marker = _Levels(), []
    for k, (a, _, gap) in enumerate(kept):
        found = bool(_MARKER.match(text, a))
        if found and not levels.item(text, a) and k and not gap and text[a].isdigit() and _word_before(text, kept[k - 1][0], kept[k - 1][1]) in _BEFORE_DAY:
            found, soft[k] = False, True
        marker.append(found)

    def first_word(k: int) -> int:
        a, b, _ = kept[k]
        cut = text.find(" ", a, b)
        return (cut if cut > 0 else b) - a

    for k in range(1, n):
        (pa, pb, _), (a, _, gap) = kept[k - 1], kept[k]
        if soft[k] or gap or marker[k] or marker[k - 1]:
            continue
        if ended[k - 1] and not _abbreviation_runs_on(text, pa, pb, a, one_case):
            continue
        c = text[a]
        if c.islower() and not one_case and text[pb - 1] != ":":
            soft[k] = True
    run = 0
    while run < n:  # paragraphs: lines without blank lines or markers between
        stop = run + 1
        while stop < n and not kept[stop][2] and not marker[stop]:
            stop += 1
        width = [kept[k][1] - kept[k][0] for k in range(run, stop)]
        widest = max((width[k - run - 1] for k in range(run + 1, stop) if soft[k]), default=0)  # of the lines that go on
        # a wrapped paragraph of one case: all its lines but the last lie between 25 characters and one width
        w = max(width)
        wrapped = one_case and 25 <= w <= 100 and stop > run + 1 and all(width[j - run] + 1 + first_word(j + 1) > w - 1 or ended[j] for j in range(run, stop - 1))
        for k in range(run + 1, stop):
            if soft[k] or (ended[k - 1] and not _abbreviation_runs_on(text, kept[k - 1][0], kept[k - 1][1], kept[k][0], one_case)) or marker[k - 1]:
                continue
            first = text[kept[k][0]]
            filled = width[k - run - 1] + 1 + first_word(k)
            if one_case:
                # the lines of a script without case end where they end
                soft[k] = wrapped and first.lower() != first.upper() and filled > w - 1 and text[kept[k - 1][1] - 1] != ":"
            elif widest and first.isupper() and filled > widest and width[k - run - 1] >= 25:
                soft[k] = True
                widest = max(widest, width[k - run - 1])
        run = stop
    out = []
    for k, (a, b, _) in enumerate(kept):
        if soft[k] and out:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, marker[k]))
    return out


def _word_before(text: str, start: int, end: int) -> str:
    """The letters right before end, in lower case."""
    k = end
    while k > start and text[k - 1].isalpha():
        k -= 1
    return text[k:end].lower()


def _abbreviation_runs_on(text: str, a: int, b: int, following: int, one_case: bool) -> bool:
    """Whether a line ends in an abbreviation that must go on in the next line."""
    if text[b - 1] != ".":
        return False
    kind = _abbreviation(text, b - 1, a)
    c = text[following]
    if kind == "title":
        return True
    if kind == "number":
        return c.isdigit()
    if kind == "firm" and one_case:
        return c.isalpha()
    if kind in ("firm", "on", "may_end"):
        return c.islower() and (not one_case or _NEXT_WORD.match(text, following)[0].lower() in _CARRY_ON)
    before = text[max(a, b - 3) : b - 1]
    return len(before.strip()) == 1 and before.strip().isalpha() and before[:1] == " " and c.isalpha()


def _pairs(text: str, a: int, b: int) -> dict[int, int]:
    """Opening to closing place of the quotations and brackets of a unit; unclosed ones are left out."""
    out: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}  # how many places of the stack a mark would close

    def pop() -> int:
        at, closers = stack.pop()
        for c in closers:
            waiting[c] -= 1
        return at

    def push(at: int, closers: str) -> None:
        stack.append((at, closers))
        for c in closers:
            waiting[c] = waiting.get(c, 0) + 1

    for k in range(a, b):
        c = text[k]
        if stack and c in stack[-1][1]:
            out[pop()] = k
        elif c == '"':
            if waiting.get(c):
                while stack[-1][1] != c:
                    pop()
                out[pop()] = k
            elif not (k > a and text[k - 1].isdigit()):
                push(k, c)
        elif c in _PAIRS:
            push(k, _PAIRS[c])
        elif c in ")]}）」』】》〉］”»" and waiting.get(c):
            while c not in stack[-1][1]:
                pop()
            out[pop()] = k
    return out


def _skip_blank(text: str, k: int, b: int) -> int:
    while k < b and text[k].isspace():
        k += 1
    return k


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


class _Run:
    """What the automaton knows of the text behind it: the token it is in and the sentence so far."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = self.token_end = -1
        self.counted = self.sixth = -1
        self.capitals: list[int] | None = None

    def token(self, k: int, start: int) -> int:
        """Where the token that ends at k starts; its marks are found once."""
        text, at = self.text, k
        low = max(start, self.token_end)  # what was read before is not read again
        while at > low and not (text[at - 1].isspace() or text[at - 1] in _APART):
            at -= 1
        if at == low and self.at >= start and low > start:
            at = self.at
        self.token_end = k
        if at != self.at:
            self.at = at
            self.letters = self.digits = self.initials = -1
        return at

    def has_capital(self, start: int, k: int) -> bool:
        if self.capitals is None:
            self.capitals = [i for i, c in enumerate(self.text) if c.isupper()]
        found = bisect_left(self.capitals, start)
        return found < len(self.capitals) and self.capitals[found] < k

    def words_beyond_five(self, start: int, k: int) -> bool:
        """Whether more than five words begin between start and k."""
        if self.counted != start:
            m = _FIVE_WORDS.match(self.text, start)
            self.counted, self.sixth = start, m.end() if m else len(self.text)
        return k > self.sixth

    def all_letters(self, at: int, k: int) -> bool:
        if self.letters < k:
            self.letters = _LETTERS.match(self.text, max(at, self.letters)).end()
        return at < k <= self.letters

    def all_digits(self, at: int, k: int) -> bool:
        if self.digits < k:
            self.digits = _DIGITS.match(self.text, max(at, self.digits)).end()
        return at < k <= self.digits

    def all_initials(self, at: int, k: int) -> bool:
        """Letters with full stops between them, two or more."""
        if self.initials < 0:
            self.initials = _INITIALS.match(self.text, at).end()
        return k - at >= 3 and (k - at) % 2 == 1 and k <= self.initials


_FIVE_WORDS = re.compile(r"\s*(?:\S+\s+){5}")


def _after_number(text: str, at: int, start: int) -> bool:
    """Whether a digit, white space apart, stands before at."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return at > start and text[at - 1].isdigit()


def _stop_ends(text: str, k: int, start: int, b: int, one_case: bool, run: _Run) -> bool:
    """Whether the single full stop at k ends the sentence that began at start."""
    nxt = text[k + 1] if k + 1 < b else ""
    at = run.token(k, start)
    size, prev = k - at, text[k - 1] if k > start else ""
    letters = run.all_letters(at, k)
    if nxt and not nxt.isspace() and nxt not in _CLOSERS:
        if not (nxt.isalnum() or nxt in _PAIRS or _PICTOGRAPH.match(nxt)):
            return False  # a comma or another mark carries on
        if not nxt.isalnum():
            return size > 1 and letters and _abbreviation(text, k, start) is None
        word = _NEXT_WORD.match(text, k + 1)[0]
        if nxt.isupper() and not one_case and _abbreviation(text, k, start) in ("firm", "on", "may_end"):
            return len(word) > 1
        if not letters or size < 2 or _abbreviation(text, k, start):
            return prev.isdigit() and nxt.isalpha() and nxt.isupper() and not one_case and run.all_digits(at, k) and word.lower() not in _FILE_ENDINGS and len(word) > 1
        if word.lower() in _FILE_ENDINGS:
            return False
        if nxt.isdigit() or _is_cjk(nxt):
            return True
        if nxt.isupper() and text[at:k].islower():
            return True
        return one_case and (not nxt.isupper() or text[at:k].isupper())
    after = _skip_blank(text, k + 1, b)
    if after >= b:
        return True
    c = text[after]
    lower_next = c.islower()
    kind = _abbreviation(text, k, start)
    word = _NEXT_WORD.match(text, after)
    follows = word[0].lower() if word else ""
    if word and len(word[0]) > 1 and size > 1 and word[0].isupper() and text[at:k].isupper():
        one_case = True  # capitals here say nothing
    if kind == "title":
        return False
    if kind == "number" and c.isdigit():
        return False
    if size == 2 and text[at:k].lower() == "in" and _after_number(text, at, start):
        kind = "on"
    if kind in ("firm", "on"):
        if one_case:
            return False
        return c.isupper()
    if kind == "may_end" or run.all_initials(at, k):
        if c in ",;:":
            return False
        if one_case:
            return follows not in _CARRY_ON
        return not lower_next or follows not in _CARRY_ON and not run.has_capital(start, k)
    if size == 1 and letters and prev not in "Iiyà":
        return False  # initials and spaced abbreviations
    if size <= 2 and text[at:k].isdigit():
        before = at
        while before > start and text[before - 1].isspace():
            before -= 1
        if before < at and c.isalpha() and _word_before(text, start, before) in _BEFORE_DAY:
            return False
    return True


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets (start, end) of the sentences of a text, in code points."""
    text = _mask(text)
    out: list[tuple[int, int]] = []
    one_case = text == text.lower() or text == text.upper()
    run = _Run(text)
    for a, b, listed in _units(text):
        _scan(text, a, b, listed, one_case, run, out)
    return out


def _scan(text: str, a: int, b: int, listed: bool, one_case: bool, run: _Run, out: list[tuple[int, int]]) -> None:
    pairs = _pairs(text, a, b)
    start = k = a
    if listed:
        k = _MARKER.match(text, a).end()
    while k < b:
        c = text[k]
        if k in pairs:  # push: everything up to the closing mark is inside
            close = pairs[k]
            if _stands_alone(text, start, k, close, b, one_case):
                end = _with_pictographs(text, close + 1, b)
                out.append((start, end))
                start = k = _skip_blank(text, end, b)
            else:
                k = close + 1
            continue
        if c in END_MARKS:
            end = k + 1
            while end < b and text[end] in END_MARKS:
                end += 1
            mark = text[k:end]
            if _mark_ends(text, k, end, mark, start, b, one_case, run):
                while end < b and text[end] in _CLOSERS and (text[end] not in "'’" or end + 1 >= b or not text[end + 1].isalnum()) and end not in pairs:
                    end += 1
                end = _with_pictographs(text, end, b)
                while end < b and text[end] in END_MARKS and text[end] != ".":
                    end += 1
                out.append((start, end))
                start = k = _skip_blank(text, end, b)
            else:
                k = end
            continue
        if c.isspace() and k > start and "฀" <= text[k - 1] <= "๿" and _THAI.search(text, max(start, k - 8), k):
            end = _with_pictographs(text, k, b)
            out.append((start, end))
            start = k = _skip_blank(text, end, b)
            continue
        k += 1
    if start < b:
        out.append((start, b))


def _mark_ends(text: str, k: int, end: int, mark: str, start: int, b: int, one_case: bool, run: _Run) -> bool:
    if mark == ".":
        return _stop_ends(text, k, start, b, one_case, run)
    strong = any(c in _STRONG for c in mark)
    after = _skip_blank(text, end, b)
    if strong:
        return not (end < b and text[end] in ",;" and mark in "!?")
    # an ellipsis
    if after >= b:
        return True
    c = text[after]
    if after == end and (c.isalnum() and not c.isupper() or c in ",;"):
        return False
    if c.islower() or one_case:
        if c.islower() and not one_case and run.has_capital(start, k):
            return False
        return run.words_beyond_five(start, k)
    if _is_cjk(c) and _is_cjk(text[k - 1]) and after == end:
        return False
    return True


def _stands_alone(text: str, start: int, at: int, close: int, b: int, one_case: bool) -> bool:
    """Whether a quotation or bracket ends its sentence with its own end mark."""
    if not _bare_end(text, at + 1, close):
        return False
    after = _skip_blank(text, close + 1, b)
    if after >= b:
        return True
    c = text[after]
    if c in END_MARKS or c in ",;:、，；：،-–—":
        return False
    opens = at == start
    if text[at] in _BRACKETS:
        return opens
    if not opens:  # a quotation at the end of a sentence that began before it
        before = at
        while before > start and text[before - 1].isspace():
            before -= 1
        if text[before - 1] in ":：,，،":
            return not c.islower() or one_case and not _goes_on(text, after, b)
        return c.isupper() and not one_case
    if _is_cjk(c):
        if any(text.startswith(x, after) for x in _JA_GOES_ON):
            return False
        return not _goes_on(text, after, b)
    if one_case:
        return not _goes_on(text, after, b)
    if c.islower() or "ऀ" <= c <= "ॿ" or "؀" <= c <= "ۿ":
        return False
    return True


def _goes_on(text: str, at: int, b: int) -> bool:
    """Whether the clause at `at` says who said the quotation before it, or something of it."""
    stop = at
    ends = _CLAUSE_ENDS if _is_cjk(text[at]) else END_MARKS
    while stop < b and text[stop] not in ends:
        stop += 1
    return bool(_SAYING.search(text, at, stop)) or bool(_FINITE.match(text, at, stop)) and text[stop : stop + 1] != "?"


_CLAUSE_ENDS = frozenset(END_MARKS + "，、；：")


def _with_pictographs(text: str, end: int, b: int) -> int:
    """The end after pictographs that follow directly or after spaces."""
    while True:
        k = end
        while k < b and text[k] in "    　":
            k += 1
        m = _PICTOGRAPH.match(text, k, b)
        if not m or m.end() == k:
            return end
        end = m.end()


def split_sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sentence_no, char_start, char_end) of every document's sentences, in order from 1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, no, starts, ends = [], [], [], []
            for i, t in zip(pdf["d"], pdf["t"]):
                for n, (a, b) in enumerate(sentences(t), 1):
                    ids.append(i)
                    no.append(n)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({doc_id: pd.Series(ids, dtype="int64"), "sentence_no": pd.Series(no, dtype="int32"), "char_start": pd.Series(starts, dtype="int32"), "char_end": pd.Series(ends, dtype="int32")})

    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return source.mapInPandas(read, f"{doc_id} long, sentence_no int, char_start int, char_end int")
