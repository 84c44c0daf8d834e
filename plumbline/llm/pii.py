"""Personal data: base patterns, and offset-preserving deobfuscation that adds to them.

Transducers rewrite a text (homoglyphs, other scripts' digits, spelled digits, at/dot disguises in
English, Spanish, French and German) and keep, for each rewritten piece, where it came from. Identifiers found in the rewritten text are
mapped back, so every span is in code points of the source. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: Kinds of spans, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits are tried at their start alone: a try inside one fails for the same reason.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = at  # no later match can begin before this @
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; a failing match is dropped, without a retry."""
    out: list[Span] = list(_emails(text))
    runs = (m for run in _DOTTED.finditer(text) if run.group().count(".") > 2 for m in _IP.finditer(text, run.start(), run.end()))
    for m in runs:
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- transducers --------------------------------------------------------------------------------

#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = dict(zip("аАвВеЕзкКмМнНоОрРсСтТуУхХіІјЈѕЅԁԛԝ", "aABBeE3kKmMhHoOpPcCTTyYxXiIjJsSdqw")) | dict(zip("αΑΒεΕιΙκΚΜνΝοΟρΡτΤυΥχΧΖ", "aABeEiIkKMvNoOpPtTuYxXZ"))
#: Signs that stand for @ . - and +.
SIGNS = dict(zip("﹫。｡․﹒‐‑‒–—−﹣﹢", "@....------+"))


def _one_to_one() -> dict[int, str]:
    table = {ord(k): v for k, v in (LOOKALIKES | SIGNS).items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width ASCII
    for c in range(0x80, 0x1FBFA):  # decimal digits of every script
        if unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.digit(chr(c)))
    return table


_TABLE = _one_to_one()
_HIDDEN = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
_ODD = frozenset([*map(chr, _TABLE), *_HIDDEN])

#: Names of the digits in English, Spanish, French and German.
DIGIT_NAMES = {
    **{"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"},
    **{"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"},
    **{"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"},
    **{"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"},
}
#: Words for @, for the dot and for a leading + in these languages.
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punto", "point", "punkt")
PLUS_WORDS = ("plus", "más")


def _one_of(words) -> str:
    """A pattern of the words, grouped by first letter, so that few are tried at each place."""
    first = dict.fromkeys(w[0] for w in words)
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first)


_NAMES, _ATS, _DOTS, _PLUS = map(_one_of, (DIGIT_NAMES, AT_WORDS, DOT_WORDS, PLUS_WORDS))
_NAME = rf"(?:(?:{_NAMES})(?![^\W_]))"
_SEP = rf"(?:[ .,()-]{{1,3}}| (?:{_DOTS}) )"
_ITEM = f"(?:{_NAME}|[0-9]+)"
# Every run is taken whole, so the search is linear.
_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_PLUS}){_SEP})?{_ITEM}(?:{_SEP}{_ITEM})++(?![^\W_])", re.I)
_HINT_SPELLED = re.compile(rf"[\s.,()\-:;\"'/]{_NAME}{_SEP}(?:[0-9]|{_NAME})")
_HINT_DOTTED = re.compile(rf"[0-9] (?:{_DOTS}) [0-9]")
_WORD = re.compile(rf"(?<![^\W_])(?:{_PLUS}|{_NAME}|[0-9]+)(?![^\W_])", re.I)
_DOT_WORD = re.compile(rf" (?:{_DOTS}) ", re.I)
_BRACKET = r"[ \t]{{0,2}}[\[({{<][ \t]{{0,2}}(?:{0})[ \t]{{0,2}}[\])}}>][ \t]{{0,2}}"
_AT, _DOT = _BRACKET.format(f"{_ATS}|@"), _BRACKET.format(rf"{_DOTS}|\.")
_MARKED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_HINT_MARKED = re.compile(rf"[\[({{<][ \t]{{0,2}}(?:{_ATS}|{_DOTS}|@|\.)[ \t]{{0,2}}[\])}}>]")
# A bare " at " counts in front of a name with a spelled or marked dot; in front of a plain dotted name
# ("look at example.com") only behind a local part with a sign or a digit in it ("j.doe at ...").
_BARE = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?P<at> (?:{_ATS}) | ?@ ?)(?=[A-Za-z0-9-]+(?: (?:{_DOTS}) | \. |(?<=@)\.)[A-Za-z0-9-]+)|(?<=[A-Za-z0-9-])(?P<dot> (?:{_DOTS}) | \. )(?=[A-Za-z0-9-]+)", re.I)
_BARE_DOTTED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+|(?<=[0-9]))++(?P<at> (?:{_ATS}) | ?@ ?)(?=[A-Za-z0-9-]+\.[A-Za-z0-9-]+)", re.I)
_HINT_BARE = re.compile(rf"(?: (?:{_ATS}) | ?@ | @)[a-z0-9-]+\.[a-z0-9-]")
_HINT_DIGITLIKE = re.compile(r"[0-9][.]?[OoIl][0-9.]|[OoIl][0-9]+\.[0-9]")
_DIGITLIKE = re.compile(r"(?<=[0-9.])[OoIl](?=[0-9.])|(?<=\b)[OoIl](?=[0-9]+\.[0-9])")


class Mapped:
    """A rewritten text and where its pieces came from."""

    def __init__(self, text: str):
        self.text, self.at, self.src, self.fixed = text, [0], [0], [True]

    def rewrite(self, found) -> "Mapped":
        """found: (start, end, new) in order, of this text."""
        out = Mapped("")
        parts, at, src, fixed, here, size = [], [], [], [], 0, 0

        def put(piece: str, start: int, end: int, kept: bool):
            nonlocal size
            if kept:  # pieces of this text's own map
                i = bisect_right(self.at, start) - 1
                while start < end:
                    stop = min(end, self.at[i + 1] if i + 1 < len(self.at) else end)
                    at.append(size)
                    src.append(self.src[i] + (start - self.at[i] if self.fixed[i] else 0))
                    fixed.append(self.fixed[i])
                    size += stop - start
                    start, i = stop, i + 1
            else:
                at.append(size)
                src.append(self.source(start))
                fixed.append(False)
                size += len(piece)
            parts.append(piece)

        for start, end, new in found:
            if start > here:
                put(self.text[here:start], here, start, True)
            put(new, start, end, False)
            here = end
        if here < len(self.text) or not parts:
            put(self.text[here:], here, len(self.text), True)
        out.text, out.at, out.src, out.fixed = "".join(parts), at or [0], src or [0], fixed or [True]
        return out

    def source(self, i: int) -> int:
        """Where the source of character i begins."""
        k = bisect_right(self.at, i) - 1
        return self.src[k] + (i - self.at[k] if self.fixed[k] else 0)

    def source_end(self, i: int, whole: int) -> int:
        """Where the source of character i ends; whole: the source's length."""
        k = bisect_right(self.at, i) - 1
        if self.fixed[k]:
            return self.src[k] + i - self.at[k] + 1
        later = k + 1
        while later < len(self.at) and self.at[later] == self.at[k]:
            later += 1
        return self.src[later] if later < len(self.at) else whole


def _spaced(low: str) -> bool:
    """Whether an @ and a dot could stand bare or among spaces. low: the text in small letters."""
    return any(f" {w} " in low for w in AT_WORDS) or " @" in low or "@ " in low or "@" in low and any(f" {w} " in low for w in DOT_WORDS)


def hinted(text: str) -> bool:
    """Whether any transducer could change the text to a point."""
    if not text.isascii() and not _ODD.isdisjoint(text):
        return True
    low = " " + text.lower()
    if _spaced(low) and (any(f" {w} " in low for w in DOT_WORDS) or " . " in low or _HINT_BARE.search(low)):
        return True
    return bool(_HINT_MARKED.search(low) or _HINT_SPELLED.search(low) or _HINT_DOTTED.search(low) or _HINT_DIGITLIKE.search(text))


def _digits(text: str):
    """(start, end, new) of runs of spelled digits: names become digits, words for dots become dots, and
    what lies between two single digits goes, as "one nine two dot 1 6 8" means 192.168."""
    for run in _RUN.finditer(text):
        words = list(_WORD.finditer(text, run.start(), run.end()))
        named = sum(w.group().lower() in DIGIT_NAMES for w in words)
        # Ordinary prose has "one" or "two six" at most.
        if not (named and len(words) > 2 or _DOT_WORD.search(text, run.start(), run.end())):
            continue
        last = None
        for w in words:
            new = DIGIT_NAMES.get(w.group().lower(), w.group() if w.group()[0].isdigit() else "+")
            if last is not None:
                between = text[last.end() : w.start()]
                single = len(value) == 1 == len(new)
                sep = "." if _DOT_WORD.fullmatch(between) else "" if value == "+" or single and not between.strip(" ") else between if "." in between and named < len(words) else " "
                if sep != between:
                    yield last.end(), w.start(), sep
            if new != w.group():
                yield w.start(), w.end(), new
            last, value = w, new


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        if any(c in text for c in _HIDDEN):
            m = m.rewrite([(x.start(), x.end(), "") for x in re.finditer(f"[{_HIDDEN}]+", text)])
        m.text = m.text.translate(_TABLE)
    m.text = _DIGITLIKE.sub(lambda x: "0" if x.group() in "Oo" else "1", m.text)
    found = [(x.start(), x.end(), "@" if x["at"] else ".") for x in _MARKED.finditer(m.text)]
    m = m.rewrite(found) if found else m
    low = f" {m.text.lower()}"
    if found or _spaced(low):
        some = [(x.start("at"), x.end("at"), "@") for x in _BARE_DOTTED.finditer(m.text) if x["at"] != "@"]
        m = m.rewrite(some) if some else m
        some = [(x.start(), x.end(), "@" if x["at"] else ".") for x in _BARE.finditer(m.text) if x.group() != "@"]
        # Between digits a word for a dot is left to the runs of digits.
        some = [x for x in some if x[2] == "@" or not (m.text[x[0] - 1].isdigit() and m.text[x[1] : x[1] + 1].isdigit())]
        m = m.rewrite(some) if some else m
    found = list(_digits(m.text))
    return m.rewrite(found) if found else m


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows; none overlaps a base span of its kind."""
    if not hinted(text):
        return []
    m = normalise(text)
    if m.text == text:
        return []
    taken = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    out = []
    for kind, s, e in base_spans(m.text):
        a, b = m.source(s), m.source_end(e - 1, len(text))
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        own = taken[kind]
        i = bisect_right(own, (b, -1))
        if b > a and not any(y > a and x < b for x, y in own[max(0, i - 1) : i + 1]):
            out.append((kind, a, b))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans (base and
    added), n_added, n_spans (base and added). A null text counts as empty: no spans. Repeated rows
    each give a row, null doc_ids stay null, columns already named like these play no part, an empty
    table gives no rows. Texts of any length are scanned whole, in linear time. Spans of different kinds
    may overlap; of one kind the leftmost wins, and a base span over an added one."""

    def run(batches):
        for b in batches:
            counts, sha, spans, added, every = {k: [] for k in KINDS}, [], [], [], []
            for x in b.column(1).to_pylist():
                text = x or ""
                base = base_spans(text)
                more = added_spans(text, base)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(base + more))
                added.append(len(more))
                every.append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(every, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(
        map_arrow,
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long",
    )


def mask_text(text: str | None) -> str | None:
    """The text with each span replaced by [KIND]; where spans overlap, the first and longest wins."""
    if text is None:
        return None
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base), key=lambda x: (x[1], -x[2]))
    out, here = [], 0
    for kind, s, e in spans:
        if s >= here:
            out += [text[here:s], f"[{kind.upper()}]"]
            here = e
        elif e > here:
            here = e
    return "".join([*out, text[here:]]) if spans else text


def mask(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked; columns and rows as they are."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            made = pa.array([mask_text(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.transform(map_arrow, run, docs.schema)
