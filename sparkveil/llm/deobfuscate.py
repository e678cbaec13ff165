"""Personal data behind disguises, with offsets into the source text.

Passes over each text. The first applies the plain patterns to the source. The second runs transducers that fold
homoglyphs, spelled digits and at/dot/plus disguises, each edit remembering the source range it came from; the same
detectors run on the folded text and what they find is mapped back to source characters. A third does so with every
single digit name folded, as a name beside a number may also be a word that would spoil it.
Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkveil.llm._common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits has one possible match, from its first digit: the look-behind keeps a long run linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def detect(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns: leftmost non-overlapping matches of each kind; a match that fails its check goes and
    nothing else is tried within it. Linear in the text's length."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


# Letters of other scripts that look like a Latin letter.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν",
        "ABEKMHOPCTXYaeopcyxijsdqwhABEZHIKMNOPTYXoaiv",
    )
)
_TO_ASCII = {ord(a): b for a, b in _LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0x3002: ".", 0xFE52: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2212: "-", 0x00A0: " ", 0x2009: " ", 0x202F: " "}
_TO_ASCII |= {c: str(unicodedata.digit(chr(c))) for base in (0x660, 0x6F0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for c in range(base, base + 10)}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_TO_ASCII)))) + "]")

#: Characters that take no room.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")

# The digits' names.
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
#: Three names or more in a row are digits; fewer may be words.
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z]){_NAME}(?:[ ,.-]{{1,2}}{_NAME}){{2,}}(?![A-Za-z])")
_ONE_NAME = re.compile(_NAME, re.I)
_NAME_WORD = re.compile(rf"(?i)(?<![A-Za-z]){_NAME}(?![A-Za-z])")
#: What may lie between a name and the digit or name beside it; a full stop stays, as addresses have them.
_GAP = re.compile(r"[ ,-]{1,2}")
_UNIT = rf"(?:[0-9]|{_NAME}(?![A-Za-z]))"
_PLUS = re.compile(rf"(?i)(?:\(\s?plus\s?\)|\[\s?plus\s?\]|(?<![A-Za-z])plus)[ -]{{0,2}}(?={_UNIT})")
#: A bare "dot" between numbers.
_NUMBER_DOT = re.compile(rf"(?i)(?:(?<=[0-9])|(?<=oh)|(?<=one|two|six)|(?<=zero|four|five|nine)|(?<=three|seven|eight))\s{{1,3}}dot\s{{1,3}}(?={_UNIT})")
_AT = re.compile(r"(?i)\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|<\s*at\s*>|\(@\)|\[@\])\s*")
_DOT = re.compile(r"(?i)\s*(?:\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\}|<\s*dot\s*>|\(\.\)|\[\.\])\s*")
# Endings of domains that bare words may have.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|uk|us|de|fr|es|it|nl|eu|ch|at|be|br|pt|pl|se|no|fi|dk|ie|ca|au|nz|jp|cn|in|ru|mx|ar|cl"
_BARE_AT = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-])")
_SEPARATOR = re.compile(r"(?i)\.|\s{0,3}(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|<\s?dot\s?>|\(\.\)|\[\.\])\s{0,3}|\s{1,3}dot\s{1,3}")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_BEFORE = re.compile(r"(?i)(?:\s{1,3}(dot|plus)\s{1,3}|\s{0,3}[(\[]\s?(plus)\s?[)\]]\s{0,3})\Z")
# Words that are no part of a domain said aloud, unless they are one of the endings.
_FUNCTION = frozenset("the a an on in of to is it this that these those and or but for with from by as at be was were are we you he she they i my your his her its their our there here which who what when where if not no so up out over under into then than all any each".split())
_KNOWN = frozenset(_ENDINGS.split("|"))


def _domain(text: str, start: int, bare_at: bool) -> tuple[list[tuple[int, int]], str]:
    """The separators of the longest domain at `start` that may be one, and what shows it: "plain" if all of them are
    full stops, else "said". A bare "dot" wants an ending after it; after a bare "at" also a name before it."""
    at, before, parts, kept = start, "", [], 0
    while label := _LABEL.match(text, at):
        if parts:
            word, sep = label[0].lower(), text[slice(*parts[-1])]
            bare = sep.strip().lower() == "dot"
            if not bare or not (bare_at and before in _FUNCTION) and (word in _KNOWN or (word.isalpha() and len(word) > 1 and word not in _FUNCTION)):
                kept = len(parts)
        before = label[0].lower()
        sep = _SEPARATOR.match(text, label.end())
        if not sep:
            break
        parts.append((sep.start(), sep.end()))
        at = sep.end()
    parts = parts[:kept]
    return parts, "said" if any(text[a:b] != "." for a, b in parts) else "plain"


def _said(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of addresses whose at, dots or plus are words. Each is judged by itself: beside an "@" of any form bare
    dots are folded where they lead to an ending; a bare "at" wants a dot that is disguised, or a local part that
    no word looks like."""
    signs = [(m.start(), m.end(), True) for m in _BARE_AT.finditer(text)]
    signs += [(m.start(), m.end(), False) for m in re.finditer("@", text)] + [(m.start(), m.end(), False) for m in _AT.finditer(text)]
    for a, b, bare in sorted(signs):
        dots, kind = _domain(text, b, bare)
        if not dots:
            continue
        local, first, low = [], a, a
        while True:
            while low > 0 and text[low - 1] in _LOCAL_CHARS:
                low -= 1
            if low == first:
                break
            sign = _BEFORE.search(text, max(0, low - 16), low)
            if not sign or sign.start() == 0 or text[sign.start() - 1] not in _LOCAL_CHARS:
                break
            local.append((sign.start(), low, "." if (sign[1] or "").lower() == "dot" else "+"))
            first = low = sign.start()
        if low == a:
            continue
        if bare:
            if kind == "plain" and not local and not re.search(r"[0-9._%+]", text[low:a]):
                continue
            yield a, b, "@"
        yield from local
        yield from ((x, y, ".") for x, y in dots if text[x:y] != ".")


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of all digit names, with the gaps to digits and names beside them."""
    last = -1
    for m in _NAME_WORD.finditer(text):
        start, end = m.span()
        for width in (2, 1):
            at = start - width
            if at > 0 and _GAP.fullmatch(text, at, start) and (at == last or text[at - 1] in "0123456789"):
                start = at
                break
        gap = _GAP.match(text, end)
        if gap and gap.end() < len(text) and text[gap.end()] in "0123456789":
            end = gap.end()
        yield start, end, _NAMES[m[0].lower()]
        last = m.end()


def _edits(text: str, every_name: bool) -> list[tuple[int, int, str]]:
    """Ranges of text that a transducer rewrites, and what they become; in order and apart."""
    low = text.lower()
    found = [] if text.isascii() else [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)]
    if every_name:
        found += _names(text)
    else:
        for m in _SPELLED.finditer(text):
            found.append((m.start(), m.end(), "".join(_NAMES[n.lower()] for n in _ONE_NAME.findall(m[0]))))
    if "at" in low or "@" in low:
        found += [(m.start(), m.end(), "@") for m in _AT.finditer(text)] if any(x in low for x in ("(", "[", "{", "<")) else []
    if "dot" in low or "(.)" in low or "[.]" in low:
        found += [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
        found += [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)]
    if "plus" in low:
        found += [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    if "." in low or "dot" in low:
        found += _said(text)
    out: list[tuple[int, int, str]] = []
    for edit in sorted(found):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


class Folded:
    """A folded text and the way back from its characters to those of the source."""

    def __init__(self, source: str, every_name: bool = False):
        plain = source if source.isascii() or not _ODD.search(source) else source.translate(_TO_ASCII)
        edits = _edits(plain, every_name)
        self.changed = plain is not source or bool(edits)
        self.at, self.source, self.is_edit, pieces = [], [], [], []
        here = done = 0
        for a, b, new in [*edits, (len(plain), len(plain), "")]:
            for x, y, piece, edit in ((done, a, plain[done:a], False), (a, b, new, True)):
                if piece:
                    self.at.append(here)
                    self.source.append((x, y))
                    self.is_edit.append(edit)
                    pieces.append(piece)
                    here += len(piece)
            done = b
        self.text = "".join(pieces)
        self.odd, self.plain = plain is not source, plain
        self.plain_source = source

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source range of text[start:end], and whether a transducer changed anything in it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i][0] if self.is_edit[i] else self.source[i][0] + start - self.at[i]
        b = self.source[j][1] if self.is_edit[j] else self.source[j][0] + end - self.at[j]
        touched = any(self.is_edit[i : j + 1]) or b - a != end - start or (self.odd and bool(_ODD.search(self.plain_source, a, b)))
        return a, b, touched


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, added): spans of the plain patterns, and spans that only the folded text shows. An added span is
    never one of the base spans and never lies within a base span of its kind."""
    base, folded = detect(text), [Folded(text)]
    if _NAME_WORD.search(folded[0].plain):
        folded.append(Folded(text, every_name=True))
    added = set()
    for version in folded:
        if not version.changed:
            continue
        for kind, start, end in detect(version.text):
            a, b, touched = version.back(start, end)
            if touched and not any(k == kind and x <= a and b <= y for k, x, y in base):
                added.add((kind, a, b))
    inner, reach = set(), {}
    for k, a, b in sorted(added, key=lambda s: (s[1], -s[2])) if len(folded) > 1 else ():
        if b <= reach.get(k, -1):
            inner.add((k, a, b))
        reach[k] = max(b, reach.get(k, -1))
    return base, sorted(added - inner, key=lambda s: (s[1], _RANK[s[0]]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end of each span by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2])))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch that spans cover put as [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans become
    one mark, named for the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], _RANK[s[0]])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def deobfuscate(docs: DataFrame, *, text: str = "text", spans: str = "spans", keep: list[str] | None = None, masked: str | None = None) -> DataFrame:
    """Add `spans`: array<struct<kind, start, end, base>> of the personal data in each whole text, by start,
    then kind; and with `masked` a column of that name with the text's spans masked (it may be `text` itself).

    A null text has no spans and stays null. Rows are kept one for one, without a shuffle; other columns pass
    through, and new columns replace those of their name.
    """
    new = [spans, *([masked] if masked else [])]
    others = [c for c in (keep if keep is not None else docs.columns) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part, found, texts = batch.slice(a, b - a), [], []
                for value in column.slice(a, b - a).to_pylist():
                    base, added = find(value or "")
                    marked = sorted([(x, _RANK[k], y, k, True) for k, x, y in base] + [(x, _RANK[k], y, k, False) for k, x, y in added])
                    found.append([{"kind": k, "start": x, "end": y, "base": own} for x, _, y, k, own in marked])
                    if masked:
                        texts.append(None if value is None else mask(value, base + added))
                made = [pa.array(found, _SPANS), *([pa.array(texts, pa.string())] if masked else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), *made], names=[*others, *new])

    kinds = dict(docs.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in others), f"`{spans}` array<struct<kind:string,start:int,end:int,base:boolean>>", *([f"`{masked}` string"] if masked else [])]
    return map_arrow(docs.select(*(f"`{c}`" for c in dict.fromkeys([*others, text]))), run, ", ".join(schema))
