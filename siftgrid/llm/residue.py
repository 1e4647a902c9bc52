"""Problem 8: template residue, filler, error pages and script notices, by aligning records of the same template.

What a collection writes over and over is its template; what differs from record to record stands in the template's
slots. One pass over the texts cuts each into lines and sentences and takes their templates (words in lower case kept, each
run of names, numbers and codes one slot). Then the whole collection decides:

* A slot that kept its field's name, a default, a blank or nothing. A place (a span in any brackets, a blank, a default, a
  gap, a bare word in capitals) is a slot where the line or sentence with a value in it, or without it, is that of other
  rulings. A span that is written as programs write names is residue by itself, and one whose name stands in such syntax,
  or in several kinds of brackets, elsewhere.
* A whole page in the ruling's place. A line or sentence of several rulings that is no slotted template and stands, in a
  good share of its records, without any prose that gives a number or date is the template of a page; every record that holds it is
  flagged, also where a ruling surrounds it.
* Filler. Sentences of several rulings without any slot that never share a paragraph with a sentence that gives a
  number or date, though they stand where a paragraph of the reasons does; and paragraphs whose words do not occur in such
  paragraphs at all, whatever their order.

There are no lists of wording: what a page or filler says is learned from where it stands. Fixed are only the syntax of
placeholders and markup, and the words by which courts mark redactions (which are no residue).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrid.lineage import cut
from siftgrid.llm.overlap import BROADCAST

#: A template has this many rulings. Of a page's records this share has no other prose that gives a number or date. Of a filler
#: sentence's records at most STRAY have a number or date in its paragraph, of a foreign word's at most FOREIGN. A template is
#: fixed, not slotted, if it has two forms or one for this share of its records.
RULINGS, BARE, STRAY, FOREIGN, FORMS = 4, 0.3, 0.1, 0.25, 0.1
_ROWS, _HELD = 512, 200_000

# A name of up to six words.
_NAME = r"[^\W\d_][\w.\-]*(?:\s+[\w.\-]+){0,5}?"
# Syntax that template languages use for a field; the field's name is the group.
_SURE = [
    ("double braces", r"\{\{\s*([^{}]+?)\s*\}\}"), ("dollar braces", r"\$\{\s*([^{}]+?)\s*\}"), ("hash braces", r"#\{\s*([^{}]+?)\s*\}"),
    ("percent tag", r"<%[=-]?\s*([^<>]+?)\s*%>"), ("brace percent", r"\{%=?\s*([^{}]+?)\s*%\}"), ("merge field", r"\{\s*MERGEFIELD\s+([^{}]+?)\s*\}"),
    ("format", rf"%\(({_NAME})\)[sd]"), ("double angles", r"<<\s*([^<>]+?)\s*>>"), ("double at", r"@@([^@]+)@@"), ("underlines", r"(?<![\w_])__([^\W_][^\s_]*(?:_[^\s_]+)*)__(?![\w_])"),
    ("double brackets", r"\[\[\s*([^\[\]]+?)\s*\]\]"), ("dots", r"\[●\s*([^●]+?)\s*●\]"), ("position", r"\{(\d{1,2})\}"),
]
# Brackets and signs that may also stand for something else.
_MAYBE = [
    ("braces", rf"\{{({_NAME})\}}"), ("angles", rf"<({_NAME})>"), ("escaped angles", rf"&lt;\s*({_NAME})\s*&gt;"), ("guillemets", rf"«({_NAME})»"), ("brackets", rf"\[({_NAME})\]"),
    ("tildes", rf"~({_NAME})~"), ("percents", rf"%({_NAME})%"), ("dollars", rf"\$({_NAME})\$"),
]
_SPANS = [(f, True, re.compile(p)) for f, p in _SURE] + [(f, False, re.compile(p)) for f, p in _MAYBE]
_UNUSUAL = frozenset(("braces", "escaped angles", "percents", "dollars", "tildes"))
_OPENS = re.compile(r"[{<«~$@%#&_\[](?:(?<=[{<«~$@])|(?<=%)(?=[\w(=])|(?<=#)(?=\{)|(?<=&)(?=lt;)|(?<=_)_|(?<=\[)(?=[^\W\d_]|[\[●])(?!exhibits ))")

# Words by which courts mark that they withheld something, and HTML elements.
_REDACTED = re.compile(r"(?i)withheld|redact|remov|anonym|omi(tt|s\b)|geschwärzt|ausgelassen|weggelassen|occult|supprim|caviard|poistettu|salattu|peitetty|illegible|unleserlich|illisible|sic\b|exhibit|emphasis|…|\.\.\.")
_ELEMENTS = frozenset("a b body br center code div em footer form h1 h2 h3 head header hr html i img input li link main meta nav noscript ol p pre script section small span strong style table tbody td th thead title tr u ul".split())
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
_JOINTS = re.compile(r"[\s._\-]+")
_DIGITS, _DIGIT = re.compile(r"\d+"), re.compile(r"[1-9]")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_LIGATURES = (("\ufb01", "fi"), ("\ufb02", "fl"))
_DIVIDED = re.compile(r"(?<=[a-zß-ÿ])-\r?\n(?=[a-zß-ÿ])")
_MISREAD = re.compile(r"[01](?<=[a-zß-ÿ].)(?=[a-zß-ÿ])")
# What may stand in a slot for a value: blanks and empty brackets, defaults, and nothing between two spaces or before a sign.
# Underlines after a letter and dots in brackets are redactions.
_BLANK = re.compile(r"(?<![\w.])_{2,}(?!\w)|(?<![\w.\[(])\.{4,}(?![\w.\])])|\[[ \t]*\]|\([ \t]*\)|\{[ \t]*\}|<[ \t]*>|«[ \t]*»")
_DEFAULT = re.compile(r"(?<![^\s(])(?:00?[./-]00?[./-]0000|0000-00-00|(?i:dd[./]mm[./]yyyy|mm[./]dd[./]yyyy|yyyy-mm-dd|tt\.mm\.jjjj|jj[./]mm[./]aaaa|pp\.kk\.vvvv|tbd|tbc))(?=[\s.,;:)]|$)")
_GAP = re.compile(r"[ \t](?:[ \t]+(?=[^\W\d_])|(?<= )(?=[.,]))")
# A gap where no space before a sign, and also no tab, is in the text.
_WIDE, _SPACES = re.compile(r"[ \t][ \t]+(?=[^\W\d_])"), re.compile(r"  +(?=[^\W\d_])")
_DEFAULTS = ("0000", "yyyy", "jjjj", "aaaa", "vvvv", "tbd", "tbc")
_WORD = re.compile(r"[A-ZÀ-Þ]{4,}(?:[_.][A-ZÀ-Þ]+)*(?=[\s.,;:)]|$)")
_SOLE = re.compile(r"[A-ZÀ-Þ]{4,}(?:[_.][A-ZÀ-Þ]+)*[.,;:)]*$")
# The word after a bare word that is next to it in its line and in its sentence alike, so that no other decides whether it stands alone.
_NEXT = re.compile(r"[,;:)]*[ \t]*([^\s.,;:)]\S*)")
_JOINED = re.compile(r"[a-zß-ÿ]+(?:_[a-zß-ÿ]+)+(?=[\s.,;:)]|$)")
# A number that a line begins with, a word before it included; where a sentence ends within a line; how a paragraph ends.
_NUMBER = r"[ \t]*(?:[^\W\d_]{1,8}\.?[ \t]+)?[\[(§]*\d{1,3}[.)\]:]*[ \t]*[–—-]?[ \t]+(?=\S)"
_LEADING = re.compile(_NUMBER)
_STOP = re.compile(r"[^\W\d_]{3}[.!?…]$")
_BEGINS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ„“«<{[(\x02" + "".join(map(chr, range(0xC0, 0xDF))))
_SENTENCE = re.compile(rf"[.!?…\n](?:(?<=\n)(?:[ \t\r]*\n\s*(?:{_NUMBER})?|{_NUMBER})|(?<=[^\W\d_][^\W\d_][^\W\d_][.!?…])\s+(?=[A-ZÀ-Þ„“«<{{\[(\x02]))")
_MARKUP = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_ASIDE = ".,;:!?()[]"
_MEMO, _MASKED, _LONG = 200_000, 100_000, 500
_CAPTION = r"[^\W\d_][^\s:]{0,24}(?:[ \t][^\s:]{1,24}){0,2}"
_LABEL = re.compile(rf"(?m)^[ \t]*({_CAPTION}):[ \t]*(?:(?=\S)|\r?$(?=\s*(?:{_CAPTION}:|\Z)))")


def clean(text: str) -> str:
    """Composed letters, no invisible characters, words joined that a line end divides, and letters for the digits 0 and 1
    that a scan put inside words."""
    return _reread(_composed(text))


def _reread(text: str) -> str:
    return _MISREAD.sub(lambda m: "l" if m.group() == "1" else "o", text)


def _composed(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    for c in _INVISIBLE:
        if c in text:
            text = text.replace(c, "")
    for c, letters in _LIGATURES:
        if c in text:
            text = text.replace(c, letters)
    if "-\n" in text or ("\r" in text and "-\r\n" in text):
        text = _DIVIDED.sub("", text)
    return text


def field_name(inner: str) -> str:
    """A field's name whatever its spelling: ``Judge Name``, ``JUDGE_NAME``, ``judgeName | upper`` -> judge_name."""
    plain = unicodedata.normalize("NFC", inner).split("|")[0].strip()
    return _DIGITS.sub("9", _JOINTS.sub("_", _CAMEL.sub("_", plain)).strip("_").casefold())


def is_identifier(inner: str) -> bool:
    """Written as programs write names: one word, joined by underlines or dots, or in camel case."""
    return " " not in inner and (re.search(r"[^\W_][_.][^\W_]", inner) is not None or _CAMEL.search(inner) is not None)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


class _Memo(dict):
    """A dictionary that computes what it lacks and is emptied when full."""

    def __init__(self, make, most=_MEMO):
        self.make, self.most = make, most

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        value = self[token] = self.make(token)
        return value


#: What a token is a sign of: one letter over and over, a blank, a default, a span, a bare word, a gap before it, a sentence's end, a
#: digit inside a word.
_ONE, _BLANKED, _DEFAULTED, _OPENED, _BARE, _GAPPED, _STOPS, _SCANNED = (1 << i for i in range(8))
_SIGNS = [
    (_BLANKED, r"__|\.{4}|\[\]|\(\)|\{\}|<>|«»|[\[({<«]$"), (_DEFAULTED, "(?i:0000|yyyy|jjjj|aaaa|vvvv|tbd|tbc)"), (_OPENED, _OPENS.pattern),
    (_BARE, r"(?:^|\()[A-ZÀ-Þ]{4}"), (_GAPPED, "^[.,]"), (_STOPS, r"[^\W\d_]{3}[.!?…]$"), (_SCANNED, "[a-zß-ÿ][01][a-zß-ÿ]"),
]
_SIGNED, _SIGNS = re.compile("|".join(f"(?:{p})" for _, p in _SIGNS)), [(sign, re.compile(p)) for sign, p in _SIGNS]


# A number without any sign.
_NUMERIC = re.compile(r"\d+(?:[.,/:-]\d+)*[,;:)]?$")


def _facts(token: str) -> tuple[str, str, str, int]:
    """A token as it stands in pieces that are compared word for word, in templates, in one case; and its signs.

    Every blank, default, span, bare word and gap of a text has a token with its sign, since none of them, or the part that
    is looked for here, holds a space.
    """
    if _NUMERIC.match(token) and "0000" not in token:
        return "0", "N", token, 0
    case = token.casefold()
    signs = sum(sign for sign, pattern in _SIGNS if pattern.search(token)) if _SIGNED.search(token) else 0
    if len(case) > 7 and case.isalpha() and len(set(case)) == 1:
        signs |= _ONE
    if _DIGITS.search(token):
        return "0", "N", case, signs
    return case, token if token.islower() else "N", case, signs


def _plain(token: str) -> str | None:
    token = token.strip(_ASIDE)
    return token if len(token) > 1 and token.isalpha() and token.islower() else None


def _template(mask: str) -> tuple[int, int, tuple[str, ...]]:
    """Of a piece whose tokens are so masked: how many are in lower case, the template's hash, and the words of prose."""
    tokens = mask.split(" ")
    words = set(map(_WORDS.__getitem__, tokens))
    words.discard(None)
    return len(tokens) - mask.count("N"), digest(collapsed(mask)), tuple(words)


_FACTS, _WORDS, _TEMPLATES = _Memo(_facts), _Memo(_plain), _Memo(_template, _MASKED)


class _Tokens:
    """A text's tokens, where its lines end among them, and what is known of each."""

    def __init__(self, text: str) -> None:
        lines = text.split("\n")
        tokens: list[str] = []
        ends = []
        for line in lines:
            tokens += line.split()
            ends.append(len(tokens))
        self.lines, self.tokens, self.ends = lines, tokens, ends
        known = list(map(_FACTS.__getitem__, tokens))
        self.folds, self.masks, self.cases = [x[0] for x in known], [x[1] for x in known], [x[2] for x in known]
        self.signs = [(i, x[3]) for i, x in enumerate(known) if x[3]]
        sign = 0
        for _, x in self.signs:
            sign |= x
        self.sign = sign


def collapsed(mask: str) -> str:
    """A template with each run of slots as one."""
    while "N N" in mask:
        mask = mask.replace("N N", "N")
    return mask


def masked(tokens: list[str]) -> str:
    """The tokens with each run of words that are not in lower case (names, numbers, codes) as one slot."""
    return collapsed(" ".join([_FACTS[x][1] for x in tokens]))


def paragraphs(text: _Tokens) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Of each paragraph two lists of pieces as ranges of tokens.

    The first list is its sentences, whatever lines they run over; if there are several lines, the second is the parts of
    sentences that stand on each. A paragraph ends at a blank line or before a line that begins with a number, which is in no piece.
    """
    tokens, folds = text.tokens, text.folds
    stops = [i + 1 for i, x in text.signs if x & _STOPS and i + 1 < len(tokens) and tokens[i + 1][0] in _BEGINS]
    begins = set(stops)
    out: list[tuple[int, list[int]]] = []  # where each paragraph begins and where its lines end
    at = 0
    bounds: list[int] = []
    for line, end in zip(text.lines, text.ends, strict=True):
        if end == at:
            bounds = []
            continue
        number = 0
        if (folds[at] == "0" or (at + 1 < end and folds[at + 1] == "0")) and (found := _LEADING.match(line)) is not None:
            # a number does not run over two sentences, and a sentence that begins behind a space has none
            number = len(found.group().split())
            if (number > 1 and (at + 1 in begins or at + number - 1 in begins)) or (line[0].isspace() and at in begins):
                number = 0
        if number or not bounds:
            bounds = []
            out.append((at + number, bounds))
        bounds.append(end)
        at = end
    for begin, bounds in out:
        end = bounds[-1]
        inner = stops[bisect_left(stops, begin) : bisect_left(stops, end)]
        if inner:
            sentences = list(zip([begin, *inner], [*inner, end], strict=True))
        else:
            sentences = [(begin, end)]
        if len(bounds) > 1:
            parts = sorted({begin, *inner, *bounds})
            yield sentences, list(zip(parts, parts[1:], strict=False))
        else:
            yield sentences, []


def label_template(label: str) -> int:
    """A hash of a line that gives a value for the label."""
    return digest("\0" + label.casefold())


def template(piece: str) -> int:
    """The hash of a line's or sentence's template, without its leading number."""
    return digest(masked(_LEADING.sub("", piece.lstrip(), count=1).split()))


def around(text: str, breaks: tuple[list[int], list[int]], start: int, end: int) -> list[tuple[str, str]]:
    """What stands before and after a place in its line and in its sentence; ``breaks`` are where those between sentences begin and end."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    out = [(text[a:start], text[end : len(text) if b < 0 else b])]
    begins, ends = breaks
    a, b = bisect_right(ends, start), bisect_left(begins, end)
    return [*out, (text[ends[a - 1] if a else 0 : start], text[end : begins[b] if b < len(begins) else len(text)])]


def alone(before: str, after: str) -> bool:
    """Whether the words beside a place are in lower case, so that one word fills the slot."""
    left, right = before.rsplit(None, 1)[-1:], after.lstrip(".,;:)").split(None, 1)[:1]
    return all(map(str.islower, left + right))


def probes(places: list[tuple[str, str]], without: bool) -> list[int]:
    """Templates that other rulings' lines have if the place is a slot: with a value in it and, if asked, without one.

    At least two words must stand around it, one of them in lower case.
    """
    out = set()
    for before, after in places:
        words = before.split() + after.split()
        if len(words) > 1 and any(map(str.islower, words)):
            out.add(template(f"{before} Name {after}"))
            if without:
                out.add(template(f"{before} {after}"))
    return list(out)


def repetitive(words: list[str]) -> bool:
    """A word of letters stands four times in a row, or a dozen words of letters have four distinct ones at most, wherever they
    begin. Every run of four begins a pair at one of its first three words that is alike, every dozen holds six words from a
    multiple of seven on with four distinct ones at most: only those are looked around.
    """
    alike = [3 * i for i, x in enumerate(map(eq, words[::3], words[1::3])) if x] if any(map(eq, words[::3], words[1::3])) else []
    sizes = list(map(len, map(set, zip(*(words[i::7] for i in range(6)), strict=False))))
    sixes = [7 * i for i, x in enumerate(sizes) if x < 5] if min(sizes, default=6) < 5 else []
    for window, most, size, starts in ((4, 1, 2, alike), (12, 4, 6, sixes)):
        for at in starts:
            for i in range(max(0, at + size - window), min(at, len(words) - window) + 1):
                part = words[i : i + window]
                if len(set(part)) <= most and sum(w.strip(".,").isalpha() for w in part) * 4 >= 3 * window:
                    return True
    return False


def low_variety(words: list[str]) -> bool:
    """The words repeat themselves, or a word of eight letters or more has one distinct letter."""
    return any(_FACTS[w][3] & _ONE for w in set(words)) or repetitive(words)


def spans(text: str) -> list[tuple[str, bool, str, int, int]]:
    """(family, sure, inner, start, end) of the spans of a text that may be a field."""
    out, at = [], 0
    while (m := _OPENS.search(text, at)) is not None:
        at = m.start()
        for family, sure, pattern in _SPANS:
            if (hit := pattern.match(text, at)) is not None and (family == "position" or any(c.isalpha() for c in hit.group(1))):
                inner = hit.group(1)
                if not _REDACTED.search(inner) and not (family in ("angles", "escaped angles") and inner.casefold() in _ELEMENTS):
                    # names written as identifiers, and signs that prose does not put around words, need no second record
                    plain = is_identifier(inner) or (family in _UNUSUAL and len(inner) > 2)
                    out.append((family, sure or plain, inner, at, hit.end()))
                at = hit.end()
                break
        else:
            at = m.end()
    return out


_KIND = pa.schema(
    [("doc_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("family", pa.string()), ("sure", pa.bool_()), ("keys", pa.list_(pa.int64()))]
    + [("key", pa.int64()), ("mask", pa.int64()), ("n", pa.int32()), ("bare", pa.int32()), ("mixed", pa.int32()), ("among", pa.int32()), ("bits", pa.int64())]
)


#: What a record adds to a piece's counts if what holds of it is, in three bits: bare 1, mixed 2, among other sentences 4.
_ADDED, _UPTO = [1 << 64 | (x & 1) << 104 | (x >> 1 & 1) << 144 | (x >> 2) << 184 for x in range(8)], (1 << 40) - 1


class _Counts:
    """What one slice of records says about templates, pieces and words, summed before it is sent on."""

    def __init__(self) -> None:
        self.templates: defaultdict[int, int] = defaultdict(int)  # rulings as bits
        self.masks: dict[int, int] = {}
        self.pieces: defaultdict[int, int] = defaultdict(int)  # rulings as 64 bits, and in 40 bits each: records, of them bare, mixed, among other sentences
        self.mixed: Counter[str] = Counter()
        self.unmixed: Counter[str] = Counter()
        self.rulings: defaultdict[str, int] = defaultdict(int)
        self.free: list[tuple[int, set]] = []

    def babble(self) -> Iterator[tuple]:
        """The pieces without codes that may have too few ordinary words: words that stood beside codes so often by now
        that the collection cannot find them foreign."""
        unmixed, mixed = self.unmixed, self.mixed
        odd = _Memo(lambda w: mixed[w] + unmixed[w] < 8 or mixed[w] <= 3 * unmixed[w])
        for doc, words in self.free:
            rest = sum(map(odd.__getitem__, words))
            if rest * 5 >= len(words) * 4:
                yield (doc, "free", None, None, None, list(map(digest, words))) + (None,) * 7
        self.free = []

    def rows(self) -> Iterator[tuple]:
        signed = lambda x: x - (x >> 63 << 64)
        for key, bits in self.templates.items():
            yield None, "template", None, None, None, None, key, None, None, None, None, None, signed(bits)
        for key, n in self.pieces.items():
            yield None, "piece", None, None, None, None, key, self.masks[key], n >> 64 & _UPTO, n >> 104 & _UPTO, n >> 144 & _UPTO, n >> 184, signed(n & 2**64 - 1)
        for word in self.mixed.keys() | self.unmixed.keys():
            yield None, "word", None, None, None, None, digest(word), None, self.mixed[word] + self.unmixed[word], None, self.mixed[word], None, signed(self.rulings.get(word, 0))


def _bare_words(text: str, known: _Tokens) -> Iterator[tuple[str, int, int]]:
    """The bare words of the tokens that have their sign, and where each stands."""
    at = 0
    for i, sign in known.signs:
        if sign & _BARE:
            token = known.tokens[i]
            at = text.find(token, at)
            while not (text[at - 1 : at].isspace() or not at) or not (text[at + len(token) : at + len(token) + 1].isspace() or at + len(token) == len(text)):
                at = text.find(token, at + 1)
            if not (_SOLE.match(token) and _held_back(known, i)):
                yield from ((m.group(), m.start(), m.end()) for m in _WORD.finditer(text, at, at + len(token)))
            at += len(token)


def _held_back(known: _Tokens, i: int) -> bool:
    """Whether a bare word that is all of a token but signs behind it surely has no probes: a neighbour that is in no lower case
    stands in its line and in its sentence, or in its sentence if it is a line by itself, or it is also a sentence by itself."""
    tokens, ends = known.tokens, known.ends
    at = bisect_right(ends, i)
    first, last = ends[at - 1] if at else 0, ends[at] - 1
    if i > first:
        before = tokens[i - 1]
        return not (before.islower() or known.folds[i - 1] == "0" or before in "–—-" or _STOP.search(before))
    if i < last:
        return False
    lines = known.lines
    left = right = None  # the neighbours in the sentence
    if i:
        if first > (ends[at - 2] if at > 1 else 0):
            left = None if _STOP.search(tokens[i - 1]) else tokens[i - 1]
        elif lines[at - 1].strip(" \t\r"):
            return False
    if i + 1 < len(tokens):
        if ends[at + 1] > last + 1:
            after = tokens[i + 1]
            right = None if _LEADING.match(lines[at + 1]) or (_STOP.search(tokens[i]) and after[0] in _BEGINS) else after
        elif lines[at + 1].strip(" \t\r"):
            return False
    return not all(x.islower() for x in (left, right) if x) if left or right else True


def _places(doc: int, text: str, rows: list[tuple], known: _Tokens | None = None) -> tuple[bool, str]:
    """Adds a row for each place that may be a slot without its value; whether one needs no other record to tell, and the
    text with a mark in place of those."""
    known = known or _Tokens(text)
    signs = known.sign
    fields = spans(text) if signs & _OPENED else []
    sure = bool(signs & _ONE) or (signs & _BLANKED > 0 and ("_____" in text or "............" in text)) or repetitive(known.cases)
    blanks = [(m.start(), m.end(), True) for m in _BLANK.finditer(text)] if signs & _BLANKED else []
    if signs & _DEFAULTED:
        blanks += [(m.start(), m.end(), True) for m in _DEFAULT.finditer(text)]
    tab = "\t" in text
    wide = "  " in text or (tab and ("\t " in text or "\t\t" in text))
    gaps = _GAP if signs & _GAPPED and (" ." in text or " ," in text) else (_WIDE if tab else _SPACES) if wide else None
    if gaps:
        blanks += [(m.start(), m.end(), False) for m in gaps.finditer(text) if text[m.start() - 1 : m.start()].isalpha()]
    words = list(_bare_words(text, known)) if signs & _BARE else []
    if "_" in text:
        words += [(m.group(), m.start(), m.end()) for m in _JOINED.finditer(text)]
    words = [x for x in words if (text[x[1] - 1 : x[1]] in " \t\r\n(" or not x[1]) and ((m := _NEXT.match(text, x[2])) is None or m.group(1).islower())]
    breaks: tuple[list[int], list[int]] = [], []
    if fields or blanks or words:
        for m in _SENTENCE.finditer(text):
            breaks[0].append(m.start() + (text[m.start()] != "\n"))
            breaks[1].append(m.end())
    for family, plain, inner, start, end in fields:
        rows.append((doc, "name", field_name(inner), family, plain, probes(around(text, breaks, start, end), True)) + (None,) * 7)
        sure = sure or plain
    for start, end, without in blanks:
        if tried := probes(around(text, breaks, start, end), without):
            rows.append((doc, "blank", None, None, False, tried) + (None,) * 7)
    for word, start, end in words:
        if tried := probes([x for x in around(text, breaks, start, end) if alone(*x)], True):
            rows.append((doc, "bare", field_name(word), None, False, tried) + (None,) * 7)
    marks = sorted([(start, end) for *_, start, end in fields] + [(start, end) for start, end, without in blanks if without])
    if marks:
        out, at = [], 0
        for start, end in marks:
            if start >= at:
                out += [text[at:start], "\x02"]
                at = end
        text = "".join([*out, text[at:]])
    return sure, text


def _labels(text: str) -> list[tuple[str, bool]]:
    """The labels of lines, and whether each has a value."""
    out, colon = [], text.find(":")
    while colon >= 0:
        if (m := _LABEL.match(text, text.rfind("\n", 0, colon) + 1)) is not None:
            out.append((m.group(1), bool(text[m.end() : m.end() + 1].strip())))
        end = text.find("\n", colon)
        colon = text.find(":", end) if end >= 0 else -1
    return out


def _record(doc: int, ruling: str | None, text: str, counts: _Counts, rows: list[tuple]) -> None:
    whole = _composed(text)
    bit = 1 << (xxhash.xxh64_intdigest(ruling if ruling is not None else f"\0{doc}") & 63)
    known = _Tokens(whole)
    if known.sign & _SCANNED:
        whole = _reread(whole)
        known = _Tokens(whole)
    sure, text = _places(doc, whole, rows, known)
    labels = _labels(whole)
    for label, has in labels:
        if not has:
            rows.append((doc, "blank", None, None, False, [label_template(label)]) + (None,) * 7)
    if sure:
        rows.append((doc, "sure", None, None, True, None) + (None,) * 7)
    if "<" in text:
        text = _MARKUP.sub("\n", text)
    if text != whole:
        known, labels = _Tokens(text), _labels(text)
    for label, has in labels:
        if has:
            counts.templates[label_template(label)] |= bit
    seen: dict[int, int] = {}  # of each piece whether codes stand in its paragraph (2) or only other sentences (4), and which that is if it is one sentence (8 and up)
    own: set[int] = set()  # templates of too few words to be pieces
    marked = "\x02" in text
    telling: set[int] = set()  # the paragraphs with prose that gives a number or date
    mixed: set[str] = set()
    free: set[str] = set()
    met: set[str] = set()
    hashed, said, masks = xxhash.xxh64_intdigest, counts.free, counts.masks
    folds, tokens = known.folds, known.masks
    for at, (sentences, parts) in enumerate(paragraphs(known)):
        coded = "0" in folds[sentences[0][0] : sentences[-1][1]]
        one = len(sentences) == 1
        held = 2 * coded + 8 * (at + 1 if one else 0)
        holds = held if one or coded else held + 4
        for line, group in enumerate((sentences, parts) if parts else (sentences,)):
            for a, b in group:
                fold = " ".join(folds[a:b])
                if fold in met or a == b:
                    continue
                mask = " ".join(tokens[a:b])
                low, key, words = _TEMPLATES[mask] if len(mask) < _LONG else _template(mask)
                if "0" in fold:  # a token with a digit is folded to this
                    if low > 1 and not line:
                        mixed.update(words)
                    if low > 3:
                        telling.add(at)
                elif low > 1:
                    if not line:
                        (mixed if coded else free).update(words)
                    if len(words) > 4:
                        said.append((doc, words))
                if marked and any("\x02" in x for x in known.tokens[a:b]):
                    continue
                met.add(fold)
                literal = hashed("\1" + fold) - 2**63
                seen[literal] = held if line else holds
                if low > 2:
                    masks[literal] = key
                    seen.setdefault(key, held)
                    masks[key] = 1
                elif low:
                    masks[literal] = key
                    own.add(key)
                else:
                    masks[literal] = 0
    for key in own:
        counts.templates[key] |= bit
    # without other prose that gives a number: none at all, or one paragraph that is the piece's own sentence
    bare = 8 * (next(iter(telling)) + 1) if len(telling) == 1 else -8
    pieces = counts.pieces
    for key, holds in seen.items():
        pieces[key] = (pieces[key] | bit) + _ADDED[holds & 7 | (not telling or holds & -8 == bare)]
    counts.mixed.update(mixed)
    unmixed = free - mixed
    counts.unmixed.update(unmixed)
    rulings = counts.rulings
    for word in unmixed:
        rulings[word] |= bit
    rows.append((doc, "record", None, None, None, list(seen), None, None, None, int(not telling)) + (None,) * 3)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*rows, strict=True)) if rows else [[]] * 13, _KIND, strict=True)], schema=_KIND)
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch, rows = whole.slice(at, _ROWS), []
            for doc, ruling, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text and not text.isspace():
                    _record(doc, ruling, text, counts, rows)
            rows += counts.babble()
            if len(counts.pieces) > _HELD:
                rows += counts.rows()
                counts = _Counts()
            yield as_batch(rows)
    yield as_batch(list(counts.rows()))


def evidence(documents: DataFrame) -> DataFrame:
    """What documents (doc_id, ruling_id, text) say about places, templates, pieces and words; see ``_record``.

    Null, empty and blank texts give no rows. Counts are summed in the task before they leave it.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("ruling_id").cast("string"), "text")
    return rows.mapInArrow(_evidence, "doc_id bigint, kind string, name string, family string, sure boolean, keys array<bigint>, key bigint, mask bigint, n int, bare int, mixed int, among int, bits bigint")


def _few(keys: DataFrame) -> DataFrame:
    """The keys computed once, and broadcast if they were counted to be few, so that what is joined with them is not shuffled."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def residue_documents(found: DataFrame, rulings: int = RULINGS, bare: float = BARE, stray: float = STRAY, foreign: float = FOREIGN, share: float = FORMS) -> DataFrame:
    """(doc_id, reason) of computed evidence: reason is ``certain``, ``name``, ``slot``, ``page`` or ``filler``.

    One row for each reason. Rulings are counted by 64 bits of their hash, so that versions of one ruling make no template
    and no list of rulings is kept; below 64 rulings the count is at most the true one.
    """
    # in a collection whose records mostly give no numbers, their absence tells nothing
    usual = found.filter("kind = 'record'").agg(F.avg("bare")).first()[0]
    told = F.lit(usual is not None and usual * 3 <= 1)
    several = F.bit_count(F.bit_or("bits")) >= rulings
    sure = found.filter("kind = 'sure'").select("doc_id", F.lit("certain").alias("reason"))
    names = found.filter("kind = 'name'")
    known = names.groupBy("name").agg(F.max("sure").alias("sure"), F.count_distinct("family").alias("families")).filter("sure OR families > 1").select("name")
    named = names.filter("NOT sure").join(known, "name", "left_semi").select("doc_id", F.lit("name").alias("reason"))
    words = found.filter("kind = 'bare'").join(names.filter("sure").select("name").distinct(), "name", "left_semi")
    places = names.select("doc_id", "keys").unionByName(found.filter("kind = 'blank'").select("doc_id", "keys")).unionByName(words.select("doc_id", "keys"))
    templates = found.filter("kind = 'template' OR kind = 'piece' AND mask = 1").groupBy("key").agg(several.alias("several")).filter("several").select("key")
    aligned = places.select("doc_id", F.explode("keys").alias("key")).distinct().join(templates, "key", "left_semi").select("doc_id", F.lit("slot").alias("reason"))

    pieces_ = found.filter("kind = 'piece'").groupBy("key").agg(F.first("mask").alias("mask"), *(F.sum(c).alias(c) for c in ("n", "bare", "mixed", "among")), several.alias("several"))
    forms = pieces_.filter("mask NOT IN (0, 1)").groupBy("mask").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("of"), F.sum("mixed").alias("of_mixed"))
    fixed = (F.col("forms") <= 2) | (F.col("forms") <= share * F.col("of"))
    judged = pieces_.filter("several").join(forms, "mask", "left")
    often = (F.col("bare") >= bare * F.col("n")) & (F.col("bare") >= 3)
    mostly = often & (F.col("bare") * 2 >= F.col("n"))
    page = F.when(F.col("mask").isin(0, 1), mostly).otherwise(often & fixed)
    filler = ~F.col("mask").isin(0, 1)
    filler = filler & fixed & (F.col("mixed") <= stray * F.col("n")) & (F.col("of_mixed") <= stray * F.col("of")) & (F.col("among") >= bare * F.col("n"))
    foreign_pieces = judged.select("key", F.when(told & page, F.lit("page")).when(told & filler, F.lit("filler")).alias("reason")).filter("reason IS NOT NULL")
    stands = found.filter("kind = 'record'").select("doc_id", F.explode("keys").alias("key")).join(_few(foreign_pieces), "key").select("doc_id", "reason")

    foreign_words = found.filter("kind = 'word'").groupBy("key").agg(F.sum("n").alias("n"), F.sum("mixed").alias("mixed"), several.alias("several")).filter((F.col("mixed") <= foreign * F.col("n")) & F.col("several")).select("key", F.lit(1).alias("own"))
    free = found.filter("kind = 'free'").select("doc_id", F.monotonically_increasing_id().alias("at"), F.explode("keys").alias("key"))
    babble = free.join(foreign_words, "key", "left").groupBy("doc_id", "at").agg(F.count("own").alias("foreign"), F.count(F.lit(1)).alias("all")).filter(told & (F.col("foreign") * 5 >= F.col("all") * 4)).select("doc_id", F.lit("filler").alias("reason"))
    return sure.unionByName(named).unionByName(aligned).unionByName(stands).unionByName(babble).distinct()
