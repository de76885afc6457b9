"""Personal data, also where it is disguised, found at its place in the source.

A text is read twice. Plain identifiers are found in it as it stands. Then a transducer rewrites it: look-alike
characters become ASCII, invisible ones go, spelled digits become digits, and "(at)", " dot " and the like become @ and
a dot; for each piece rewritten it notes where source and output stood. Identifiers found in the output are mapped back to
the source characters that they were read from. A found span that overlaps a plain one, of whichever kind, adds nothing.

Offsets count code points; ends are exclusive. Null is treated as empty: no spans. Repeated rows give repeated results,
very long texts are read whole (both passes take linear time), an empty table gives an empty table, and other columns pass through; columns
named as those that are added are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, sliced, without, word_hashes, words_of

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, leftmost and without overlap in each kind; what fails its check is left out."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# ---------------------------------------------------------------- the transducer


def _alike() -> dict[str, str]:
    """Look-alikes of ASCII: full-width forms, and mathematical, circled, small-raised digits and letters that compatibility forms name."""
    import unicodedata

    out = {}
    ranges = [(0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2460, 0x2468), (0x24B6, 0x24EA), (0x2070, 0x2079), (0x2080, 0x2089), (0xFE50, 0xFE6B)]
    for low, high in ranges:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                out[c] = plain
    # Other scripts' digits.
    for zero in (0x0660, 0x06F0, 0x0966):
        out |= {chr(zero + k): str(k) for k in range(10)}
    # Letters of other scripts that look like ASCII letters, each with its like.
    cyrillic = "аaвBеeкkмMнHоoрpсcтTуyхxіiјjѕsԁdһhԛqԝwАAВBЕEКKМMНHОOРPСCТTХXІIЈJЅS"
    greek = "οoαaνvρpιiΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
    punctuation = "․.。.｡.·.‐-‑-‒-–-—-−-﹫@"
    for pairs in (cyrillic, greek, punctuation):
        out |= dict(zip(pairs[::2], pairs[1::2], strict=True))
    return out


_ALIKE = _alike()
_HIDDEN = "­​‌‍⁠﻿‎‏"
_ODD = re.compile("[" + re.escape("".join(_ALIKE)) + _HIDDEN + "]+")
_BEYOND = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xff]")
_WIDE_SPACE = re.compile("[  -  　]")

#: Names of the digits 0 to 9 in four languages; "oh" as 0 stands in spelled numbers only.
_DIGITS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
_NAME = "(?:" + "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True)) + ")"
#: At least two names next to each other, perhaps with digits and marks between them.
_MARK = r"(?:[ ,-]{1,2}|[ ]?[()][ ]?|[ ]?(?:dot|point|punkt|punto)[ ]|\.)"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[ -]?)?{_NAME}(?:{_MARK}(?:{_NAME}|[0-9]+))+(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ -]?)|(?P<name>(?<![^\W_]){_NAME}(?![^\W_]))|(?P<dot>[ ]?(?:dot|point|punkt|punto)[ ]|\.)|(?P<gap>[ ,-]+)", re.I)

_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|point|punkt|punto)"
_BRACKETED = re.compile(rf"[ ]?[\[({{<][ ]?(?:(?P<at>{_AT_WORD}|@)|(?P<dot>{_DOT_WORD}|\.))[ ]?[\])}}>][ ]?", re.I)
#: Letters that stand for digits, in runs that are mostly digits.
_LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_MIXED = re.compile(r"(?<![^\W_])(?=[+]?[0-9OolI ().-]*[0-9][ ().-]{0,2}[OolI]|[+]?[OolI][ .-]?[0-9])[+]?[0-9OolI](?:[ ().-]{0,2}[0-9OolI]){6,}(?![^\W_])")
_MIXED_HINT = re.compile(r"[0-9][ .-]?[OolI][ .-]?[0-9]|[0-9][OolI](?![^\W_])|(?<![^\W_])[OolI][0-9]")
_BRACKET_FIRST = re.compile(rf"[\[({{<][ ]?(?:{_AT_WORD}|{_DOT_WORD}|@|\.)", re.I)
#: Bare words count only where a whole address is spelled: name at host dot end, or name at host.end in small letters.
_BARE = re.compile(
    rf"[A-Za-z0-9_%+-]+(?:(?:[ ]{_DOT_WORD}[ ]|\.)[A-Za-z0-9_%+-]+)*(?:[ ]{_AT_WORD}[ ]|@)[A-Za-z0-9-]+(?:(?:[ ]{_DOT_WORD}[ ]|\.)[A-Za-z0-9-]+)*[ ]{_DOT_WORD}[ ][A-Za-z]{{2,}}(?![^\W_])"
    rf"|[A-Za-z0-9._%+-]+[ ]{_AT_WORD}[ ](?!www\.)(?-i:[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,6}})(?![\w/])",
    re.I,
)
_BARE_PART = re.compile(rf"(?P<at>[ ]{_AT_WORD}[ ])|(?P<dot>[ ]{_DOT_WORD}[ ])", re.I)
_AT_HOST = re.compile(r" (?:at|AT|At|arroba|arobase) [a-z0-9-]+\.[a-z0-9]")
#: Spaces around a sign, as in "name @ host . com".
_LOOSE = re.compile(r"(?<=[A-Za-z0-9])(?:[ ]+@[ ]*|@[ ]+)(?=[A-Za-z0-9-]+[ ]?\.[ ]?[A-Za-z0-9])|(?<=[A-Za-z0-9])[ ]\.[ ](?=[A-Za-z0-9])")


class Rewritten:
    """A text and, for each stretch of it, where that stood in the text that it was rewritten from."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def replace(self, pattern: re.Pattern, new) -> None:
        """Each match becomes new(match); a layer keeps its places: output start, output end, source start, source end."""
        parts, pieces, at, out = [], [], 0, 0
        for m in pattern.finditer(self.text):
            if (to := new(m)) == m[0]:
                continue
            parts += [self.text[at : m.start()], to]
            out += m.start() - at
            pieces.append((out, out + len(to), m.start(), m.end()))
            at, out = m.end(), out + len(to)
        if pieces:
            self.text = "".join([*parts, self.text[at:]])
            self.layers.append(([p[0] for p in pieces], pieces))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters of a span: those of a rewritten piece count as one, if the span has any part of its output."""
        for starts, pieces in reversed(self.layers):
            start, end = self._back(starts, pieces, start, True), self._back(starts, pieces, end - 1, False) + 1
        return start, end

    @staticmethod
    def _back(starts, pieces, at: int, first: bool) -> int:
        k = bisect_right(starts, at) - 1
        # Pieces with no output, before the place, take no part.
        while k >= 0 and pieces[k][0] == pieces[k][1] and pieces[k][0] > at:
            k -= 1
        if k < 0:
            return at
        out, out_end, src, src_end = pieces[k]
        if at >= out_end:
            return src_end + at - out_end
        if out_end - out == src_end - src:
            return src + at - out
        return src if first else src_end - 1


def _inside(whole: re.Pattern, part: re.Pattern, new, r: Rewritten) -> None:
    """Rewrites the parts that lie in a match of whole."""
    around, k = [m.span() for m in whole.finditer(r.text)], 0
    if not around:
        return

    def one(p: re.Match) -> str:
        nonlocal k
        while k < len(around) and around[k][1] <= p.start():
            k += 1
        return new(p) if k < len(around) and around[k][0] <= p.start() and p.end() <= around[k][1] else p[0]

    r.replace(part, one)


def rewrite(text: str, spelled: bool = True, bare: bool = True) -> Rewritten:
    """The text with its disguises undone; spelled and bare are False if it is known to have no spelled digits or addresses."""
    r = Rewritten(text)
    if not text.isascii() and _BEYOND.search(text):
        r.replace(_ODD, lambda m: "".join(_ALIKE.get(c, "") for c in m[0]))
        r.replace(_WIDE_SPACE, lambda m: " ")
    odd = bool(r.layers)
    if spelled or odd:
        _inside(_SPELLED, _SPELLED_PART, lambda p: {"plus": "+", "dot": ".", "gap": ""}.get(p.lastgroup) if p.lastgroup != "name" else _DIGITS[p[0].lower()], r)
    if _MIXED_HINT.search(r.text):
        mostly = lambda m: 2 * sum(c in _LETTER_DIGITS for c in m[0]) <= sum(c.isdigit() for c in m[0])
        r.replace(_MIXED, lambda m: m[0].translate(str.maketrans(_LETTER_DIGITS)) if mostly(m) else m[0])
    if _BRACKET_FIRST.search(r.text):
        r.replace(_BRACKETED, lambda m: "@" if m["at"] else ".")
    if "@" in r.text and (" @" in r.text or "@ " in r.text or " . " in r.text):
        r.replace(_LOOSE, lambda m: "@" if "@" in m[0] else ".")
    if bare or odd or len(r.layers) > odd or _AT_HOST.search(r.text):
        _inside(_BARE, _BARE_PART, lambda p: "@" if p["at"] else ".", r)
    return r


_DIGIT_HASHES = np.sort(word_hashes([*_DIGITS, "plus"], ALNUM))
_DOT_HASHES = np.sort(word_hashes(re.findall(r"[a-z]+", _DOT_WORD), ALNUM))


def hints(texts) -> list[tuple[bool, bool]]:
    """Whether each text may hold spelled digits (two names with at most a word between, or one beside a number), and a spelled address."""
    out: list[tuple[bool, bool]] = []
    for part in words_of(texts, ALNUM):
        name = np.flatnonzero(np.isin(part.hashes, _DIGIT_HASHES))
        number = (part.head >= 48) & (part.head < 58)
        near = np.zeros(len(part.hashes) + 2, dtype=bool)
        near[:-2] = number
        near[name] = True
        close = near[name + 1] | near[name + 2] | near[np.maximum(name - 1, 0)]
        spelled = np.bincount(part.doc[name[close]], minlength=part.count) > 0
        dot = np.bincount(part.doc[np.isin(part.hashes, _DOT_HASHES)], minlength=part.count) > 0
        out += zip(spelled.tolist(), dot.tolist(), strict=True)
    return out


def disguised(text: str, plain: list[tuple[str, int, int]], spelled: bool = True, bare: bool = True) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source characters; none overlaps a plain span or another found one."""
    r = rewrite(text, spelled, bare)
    if not r.layers:
        return []
    taken = sorted((a, b) for _, a, b in plain)
    starts = [a for a, _ in taken]
    out, last = [], {}
    for kind, a, b in spans(r.text):
        a, b = r.source(a, b)
        k = bisect_right(starts, b - 1) - 1
        if (k < 0 or taken[k][1] <= a) and a >= last.get(kind, 0):
            out.append((kind, a, b))
            last[kind] = b
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (order[x[0]], x[1], x[2])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii_plain and pii_disguised, arrays of (kind, start, end), to all columns of docs."""
    docs = without(docs, "pii_plain", "pii_disguised")
    names = docs.columns
    kind = "array<struct<kind:string,start:long,end:long>>"
    out = docs.withColumns({"pii_plain": F.lit(None).cast(kind), "pii_disguised": F.lit(None).cast(kind)})

    def run(batches):
        for batch in sliced(batches):
            plain, more = [], []
            texts = batch.column(names.index(text)).to_pylist()
            for t, hint in zip(texts, hints(texts), strict=True):
                base = spans(t or "")
                plain.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                more.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in disguised(t or "", base, *hint)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(plain, _SPAN), pa.array(more, _SPAN)], names=[*names, "pii_plain", "pii_disguised"])

    return docs.mapInArrow(run, out.schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in brackets."""
    @F.pandas_udf("string")
    def blanked(texts: pd.Series, plain: pd.Series, more: pd.Series) -> pd.Series:
        def one(t, found):
            out, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [t[at : s["start"]], f"[{s['kind']}]"]
                    at = s["end"]
            return "".join([*out, t[at:]])

        return pd.Series([None if t is None else one(t, [*a, *b]) for t, a, b in zip(texts, plain, more, strict=True)], dtype=object)

    docs = without(docs, "pii_plain", "pii_disguised")
    return find_pii(docs, text).withColumn(text, blanked(text, "pii_plain", "pii_disguised")).select(*[F.col(f"`{c}`") for c in docs.columns])
