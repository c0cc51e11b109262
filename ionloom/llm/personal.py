"""Personal information inside free text: find it and put typed placeholders instead.

Regular expressions propose spans, checksums confirm identity numbers, and words
nearby move the score of a span; spans that reach the threshold are kept, the
longest first where they overlap.  Names are proposed from capitalised words that
a name list holds or whose beginning and end it knows from several names, so names
that the list lacks are found too.  The work is one pass over Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shared, cut_lineage, small_or_none, spread

#: Largest name list that is sent to the tasks as it is.  Of a longer one go those names, and beginnings
#: and ends of names, that some word of the documents has.
NAME_LIMIT = 200_000
THRESHOLD = 0.5
#: Characters looked at on either side of a span for context words.
WINDOW = 48

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---------------------------------------------------------------- checksums


def luhn(digits: str) -> bool:
    """Payment card and similar numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """International bank account numbers."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def two_check_digits(digits: str) -> bool:
    """Eleven digits, the last two being weighted sums modulo 11 of those before."""
    for n in (9, 10):
        d = sum(int(c) * (n + 1 - i) for i, c in enumerate(digits[:n])) * 10 % 11 % 10
        if d != int(digits[n]):
            return False
    return True


def letter_mod23(text: str) -> bool:
    """A leading letter, digits, and a check letter by the number's rest modulo 23."""
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values: the public check letter table
    return letters[int("XYZ".index(text[0]) * 10 ** len(text[1:-1]) + int(text[1:-1])) % 23] == text[-1]


# ---------------------------------------------------------------- patterns

# Words of the three languages that stand beside personal numbers, and beside other numbers.
_ID_WORDS = r"identit|identification|kennnummer|personal(?:ausweis| number|nummer)|personnel|pass(?:port|eport)|reisepass|ausweis|social security|sozialversicherung|sécurité sociale|tax (?:id|no|number)|steuer|fiscal|insurance (?:no|number)|versicherten|assuré|licen[cs]e no|führerschein|permis|\bcard|karte|carte|\biban|account|konto|compte"
_NOT_ID = r"invoice|rechnung|facture|file ref|reference|aktenzeichen|docket|dossier|sheet|volume|\bcase\b|paragraph|\bpara\b|article|lists|ends in|sum of|amount|order no"
_PHONE_WORDS = r"phon|telefon|\bt[eé]l\b|\bt[eé]l\.|mobile?\b|handy|portable|\bcell\b|\bfax|télécopie|ruf|durchwahl|hotline|\bcall|\bdial|anruf|appel[eé]|reach|erreich|join(?:dre|t au|ts? par)|contact|kontakt|numéro|nummer|\bnumber"
_NOT_PHONE = r"sum of|amount|total|betrag|summe|somme|montant|price|preis|prix|crowns|file ref|reference|aktenzeichen|invoice|rechnung|facture|sheet|blatt|volume|band|docket|dossier|paragraph|\bpara\b|article|item|order no"
#: Money and measures after a number, which then is none to call.
_UNITS = r"\s*(?:[€$£%]|(?:eur|usd|gbp|chf|sek|nok|dkk)\b|(?:crown|kron|euro|dollar|pound|franc|franken|mark|met(?:re|er)|kilo|km\b|kg\b|tonne|ton\b|litre|liter|hectare|hektar)s?)"
# fixed values: kinds of courts, whose names are no streets
_COURT = "Regional|High|Supreme|District|Labour|Maritime|County|Crown|Federal|Constitutional|Commercial|Criminal|Civil|Administrative|Appeal|Family|Local|Circuit|Superior|Tax|Patent|Social|Central|General|Military|Juvenile|Municipal|Provincial|State|National"
_S = r"[ \t]*\n?[ \t]*"  # blanks with at most one line break
_ABBR = r"(?:\.(?=[.,;)]|\s+[a-z(]))?"  # a dot before a capital ends the sentence
_TOWN = r"[A-ZÀ-ÖØ-Þ][\w’'-]+"

#: (what makes it worth a try, kind, pattern, base score, checksum, context words that help, that harm)
RULES = [
    ("sign", "email", r"(?<![\w.+@-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", 0.9, None, "", ""),
    ("bracket", "email", r"(?<![\w.+@-])[\w.+%-]+\s+?[\[({]\s?at\s?[\])}]\s+?[\w-]+(?:(?:\.|\s+?[\[({]\s?dot\s?[\])}]\s+?)[\w-]+)+", 0.9, None, "", ""),
    ("dot", "email", r"(?<![\w.+@-])[\w.+%-]+\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", 0.8, None, "", ""),
    ("number", "id_number", rf"(?<![\w.-])[A-Z]{{2}}\d{{2}}(?:{_S}[A-Z0-9]{{4}}){{3,7}}(?:{_S}[A-Z0-9]{{1,3}})?(?![\w-])", 0.1, "iban", _ID_WORDS, _NOT_ID),
    ("number", "id_number", rf"(?<![\w.-])\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{3,4}}(?![\w-])", 0.1, "luhn", _ID_WORDS, _NOT_ID),
    ("number", "id_number", rf"(?<![\w.-])[A-Z]{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-D](?![\w-])", 0.5, None, _ID_WORDS, _NOT_ID),
    ("number", "id_number", r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])", 0.3, "two", _ID_WORDS, _NOT_ID),
    ("number", "id_number", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])", 0.3, None, _ID_WORDS, _NOT_ID),
    ("number", "id_number", r"(?<![\w.-])[XYZ]\d{7,8}[A-Z](?![\w-])", 0.3, "letter", _ID_WORDS, _NOT_ID),
    ("number", "phone", r"(?<![\w.+-])\+\d{1,3}[\s.-]?(?:\(0?\d{1,4}\)[\s.-]?)?\d{1,5}(?:[\s.\-/]\d{2,6}){1,5}(?![\w-])", 0.7, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])00\d{1,3}[\s.-]\d{2,5}(?:[\s.-]\d{3,8}){1,3}(?![\w-])", 0.5, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])\(\d{3}\)\s?\d{3}[\s.-]\d{4}(?![\w-])", 0.5, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])\d{3}-\d{4}(?![\w-])", 0.2, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])0\d{3,4}\s\d{6,7}(?![\w-])", 0.4, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])0\d(?:[\s.]\d{2}){4}(?![\w-])", 0.5, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])0\d{1,4}/\d{3,8}(?:[\s-]\d{2,5})?(?![\w-])", 0.4, None, _PHONE_WORDS, _NOT_PHONE),
    ("number", "phone", r"(?<![\w.+-])0\d{1,4}\s\d{3,8}-\d{2,5}(?![\w-])", 0.4, None, _PHONE_WORDS, _NOT_PHONE),
    ("house", "address", rf"(?<![\w./§¶(\[-])(?:Flat\s+\d+[a-z]?,\s+)?(?<!page )(?<!Seite )\b\d+[a-z]?\s+(?!(?:The|On|In|By|As|At|It)\b|(?:{_COURT})\s+Court\b)(?:[A-Z][\w’']*\.?\s+){{1,3}}?(?:Street|Lane|Road|Close|Court|Row|Avenue|Drive|Square|Place|Terrace|Way|(?:St|Rd|Ave)\b{_ABBR})(?![\w’'])(?:,\s+{_TOWN}(?:\s+[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}}\b)?)?", 0.6, None, "", ""),
    ("street", "address", rf"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm)\s+\d+[a-z]?(?:,\s+\d{{5}}\s+{_TOWN})?", 0.6, None, "", ""),
    ("house", "address", rf"(?<![\w./-])\d+[a-z]?,?\s+(?:rue|avenue|quai|boulevard|place|chemin|allée|impasse|cours|route)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?[A-ZÀ-ÖØ-Þ][\w’'-]*(?:,\s+\d{{5}}\s+{_TOWN})?", 0.6, None, "", ""),
]


#: Cheap tests that tell where a group of rules can match.
_DOT = re.compile(r"\sdot\s")
_BRACKETED_AT = re.compile(r"[\[({]\s?at\s?[\])}]")
_BLANKS = re.compile(r"\s")
_UNIT_AFTER = re.compile(_UNITS, re.I)
_LONG_NUMBER = re.compile(r"\d[\d\s.()/\-]{4,}\d[A-Z]?")
_PLACE_NUMBER = re.compile(r"\d+[a-z]?,?\s+(?=[A-Z]|rue|avenue|quai|boulevard|place|chemin|allée|impasse|cours|route)")
_FLAT_BEFORE = re.compile(r"\bFlat\s+\d+[a-z]?,\s+$")
_GERMAN_STREET = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm")

_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Me|Judge|Justice|Richterin|Richter|Maître)"
_TITLE_BEFORE = re.compile(rf"(?:\b{_TITLES}\.?|\bM\.|Presiding:|Vorsitz:|Président\s?:|Devant|\bv\.|\./\.|\bc/)\s+$")
_COMPANY_AFTER = re.compile(
    r"\s+(?:&|und|et|and)?\s*(?:[A-Z][\w&-]*\s+){0,2}(?:&\s+Co\b|Ltd|Limited|GmbH|BV|B\.V|SA\b|S\.A|plc|PLC|AG\b|Inc|LLC|KG\b|SARL|Co\b|Brothers|Sons)"
)
_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:-[^\W\d_]+)*")
_INITIAL = re.compile(r"(?<![\w.])[A-ZÀ-ÖØ-Þ]\.\s*$")
_LONE_INITIAL = re.compile(r"(?:\bv\.|\./\.|\bc/)\s+$")  # an anonymised party: the next name is the judge's
_SITTING = re.compile(r",\s+sitting\b")


class Names:
    """What a name list tells about words: listed names, and beginnings and ends that
    at least ``least`` listed names share."""

    def __init__(self, given: Iterable[str], family: Iterable[str], least: int = 3, ends: dict | None = None) -> None:
        self.lists = {"given": {n.casefold() for n in given if n}, "family": {n.casefold() for n in family if n}}
        self.ends = ends or {kind: self._affixes(names, least) for kind, names in self.lists.items()}
        self.seen: dict[tuple[str, str], bool] = {}

    def listed(self, word: str, kind: str) -> bool:
        return word.casefold() in self.lists[kind]

    @staticmethod
    def _affixes(names: set[str], least: int) -> tuple[set[str], set[str]]:
        head, tail = Counter(), Counter()
        for n in names:
            for i in range(2, len(n) - 1):
                head[n[:i]] += 1
                tail[n[i:]] += 1
        return {a for a, c in head.items() if c >= least}, {a for a, c in tail.items() if c >= least}

    def is_name(self, word: str, kind: str) -> bool:
        key = (word, kind)
        if key not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[key] = self._decide(word.casefold(), kind)
        return self.seen[key]

    def _decide(self, w: str, kind: str) -> bool:
        if w in self.lists[kind]:
            return True
        heads, tails = self.ends[kind]
        low = 3 if kind == "family" else 2
        if any(w[:i] in heads and w[i:] in tails for i in range(low, len(w) - 1) if kind == "given" or len(w) - i >= 3):
            return True
        # double names: both sides of a hyphen are names
        parts = w.split("-")
        return any(
            self._decide("-".join(parts[:i]), kind) and self._decide("-".join(parts[i:]), kind) for i in range(1, len(parts))
        )


def _checked(kind: str, text: str) -> float:
    """Score change by checksum: a confirmed number is sure, a failed one needs words beside it
    that say what it is."""
    bare = re.sub(r"[^A-Z0-9]", "", text)
    if kind == "luhn":
        return 0.5 if luhn(bare) else -0.2
    if kind == "iban":
        return 0.6 if mod97(bare) else -0.2
    if kind == "two":
        return 0.3 if two_check_digits(bare) else -0.15
    return 0.3 if letter_mod23(bare) else -0.15


class Finder:
    """Compiled rules over one name list; made once per task."""

    def __init__(self, names: Names) -> None:
        self.names = names
        self.rules: dict[str, list[tuple]] = {}
        for where, kind, pattern, base, check, good, bad in RULES:
            row = (kind, re.compile(pattern), base, check, re.compile(good, re.I) if good else None, re.compile(bad, re.I) if bad else None)
            self.rules.setdefault(where, []).append(row)

    def spans(self, text: str) -> list[Span]:
        """Accepted, non-overlapping spans in order."""
        found: list[Span] = []
        at = text.find("@")
        while at >= 0:
            # the run of characters without blanks around the sign
            start = max(text.rfind(b, 0, at) for b in " \n") + 1
            blank = _BLANKS.search(text, at)
            end = blank.start() if blank else len(text)
            self._try("sign", text, start, end, None, found)
            at = text.find("@", end)
        if _BRACKETED_AT.search(text):
            self._try("bracket", text, 0, len(text), None, found)
        if "dot" in text and _DOT.search(text):
            self._try("dot", text, 0, len(text), None, found)
        for m in _LONG_NUMBER.finditer(text):
            # patterns take the end of what they see for the end of the text, so it lies at a blank behind the number
            blank = _BLANKS.search(text, min(len(text), m.end() + 30))
            self._try("number", text, max(0, m.start() - 12), blank.end() if blank else len(text), None, found)
        for m in _PLACE_NUMBER.finditer(text):
            start = m.start()
            flat = _FLAT_BEFORE.search(text, max(0, start - 16), start)
            self._try("house", text, flat.start() if flat else start, len(text), -1, found)
        if any(w in text for w in _GERMAN_STREET):
            self._try("street", text, 0, len(text), None, found)
        found.sort(key=lambda s: (s.start - s.end, -s.score))
        taken: list[Span] = []
        for s in found:
            if all(s.end <= t.start or s.start >= t.end for t in taken):
                taken.append(s)
        taken += self._names(text, taken)
        return sorted(taken)

    def _try(self, where: str, text: str, start: int, end: int, through: int | None, found: list[Span]) -> None:
        """Spans of a group of rules within ``[start, end)``; ``through``: a position a
        span must hold, or -1 for one that begins at ``start``."""
        for kind, pattern, base, check, good, bad in self.rules[where]:
            if through == -1:
                m = pattern.match(text, start)
                hits = [m] if m else []
            else:
                hits = pattern.finditer(text, start, end)
            for m in hits:
                if through is not None and through >= 0 and not m.start() <= through < m.end():
                    continue
                score = base + (_checked(check, m.group()) if check else 0.0)
                if good is not None:
                    near = text[max(0, m.start() - WINDOW) : m.start()].replace("\n", " ")
                    score += 0.4 * bool(good.search(near) or good.search(text[m.end() : m.end() + 24]))
                    # words that speak against a span stand directly before it
                    score -= 0.6 * bool(bad.search(near[-16:]))
                    score -= 0.6 * bool(kind == "phone" and _UNIT_AFTER.match(text, m.end()))
                if score >= THRESHOLD:
                    found.append(Span(m.start(), m.end(), kind, score))

    def _names(self, text: str, taken: list[Span]) -> list[Span]:
        words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
        out: list[Span] = []
        is_name = self.names.is_name
        french: bool | None = None
        last = 0
        for i, (a, b, word) in enumerate(words):
            if a < last or not is_name(word, "family") or (b - a < 4 and not self.names.listed(word, "family")):
                continue
            if any(t.start < b and a < t.end for t in taken):
                continue
            start, end, score = a, b, 0.55
            j = i
            while j > 0 and i - j < 2 and words[j - 1][0] >= last and _gap(text, words[j - 1][1], start) and self._given(words[j - 1][2]):
                j -= 1
                start, score = words[j][0], 0.9
            if j == i:
                m = _INITIAL.search(text, max(last, a - 8), a)
                if m and m.group().strip() == "M." and french is None:
                    french = _is_french(text)
                lone = m and _SITTING.match(text, b) and _LONE_INITIAL.search(text, max(0, m.start() - 8), m.start())
                if m and not lone and not (m.group().strip() == "M." and french):
                    start, score = m.start(), 0.8
                elif i + 1 < len(words) and self._given(words[i + 1][2]) and re.fullmatch(r",\s+", text[b : words[i + 1][0]]):
                    end, score = words[i + 1][1], 0.9
            if score < 0.6:  # a family name alone: the words around decide
                if _TITLE_BEFORE.search(text, max(0, a - 16), a):
                    score += 0.2
                elif b - a < 4:  # a short word alone may be any word
                    score -= 0.2
                if _COMPANY_AFTER.match(text, b):
                    score -= 0.6
            if score >= THRESHOLD:
                out.append(Span(start, end, "name", score))
                last = end
        return out

    def _given(self, word: str) -> bool:
        return self.names.is_name(word, "given") and (len(word) > 2 or self.names.listed(word, "given"))


def _gap(text: str, a: int, b: int) -> bool:
    gap = text[a:b]
    return bool(gap) and not gap.strip() and gap.count("\n") < 2


def _is_french(text: str) -> bool:
    """Whether French little words outnumber English and German ones."""
    n = lambda p: len(re.findall(p, text))
    fr = n(r"\b(?:le|la|les|du|des|une|est)\b")
    return fr > n(r"\b(?:the|of|and|was)\b") and fr > n(r"\b(?:der|die|das|und|den)\b")


def as_written(text: str) -> str:
    """A found value with line breaks, and the blanks around them, as one blank."""
    return re.sub(r"[ \t]*[\r\n]+[ \t]*", " ", text)


def _find(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names.value)
        for batch in batches:
            ids, kinds, values = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for kind, value in dict.fromkeys((s.kind, as_written(text[s.start : s.end])) for s in finder.spans(text)):
                    ids.append(doc)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["id", "kind", "found"])

    return run


def _mask(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names.value)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                spans = finder.spans(text) if text else []
                parts, at = [], 0
                for s in spans:
                    parts += [text[at : s.start], PLACEHOLDER[s.kind]]
                    at = s.end
                texts.append(None if text is None else "".join(parts) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "n_masked"])

    return run


def load_names(name_list: DataFrame, limit: int = NAME_LIMIT) -> tuple[list[str], list[str]]:
    """Given and family names, after a check that the list is small."""
    rows = name_list.select("name", "name_type").filter(F.col("name").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the name list has more than {limit} names; pass a smaller one")
    return tuple(sorted(r["name"] for r in rows if r["name_type"] == t) for t in ("given", "family"))  # type: ignore[return-value]


def _words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct capitalised words, and their parts at hyphens, of a task's texts."""
    for batch in batches:
        met = set()
        for text in batch.column(0).to_pylist():
            for word in {m.group().casefold() for m in _WORD.finditer(text or "")}:
                parts = word.split("-")
                met.update("-".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["word"])


def _affix_rows(column: str):
    """Beginnings and ends of two letters or more of a word, as rows (side, affix)."""
    cuts = F.sequence(F.lit(2), F.length(column) - 2)
    both = F.transform(cuts, lambda i: F.array(F.struct(F.lit("head").alias("side"), F.substring(F.col(column), F.lit(1), i).alias("affix")),
                                               F.struct(F.lit("tail").alias("side"), F.substring(F.col(column), i + 1, F.length(column)).alias("affix"))))
    return F.explode(F.flatten(both))


def occurring_names(docs: DataFrame, name_list: DataFrame, text_col: str = "text", least: int = 3) -> Names:
    """What a name list of any length tells about the words of the documents.

    Listed names and the beginnings and ends that names share are counted over the whole list and
    joined with the words of all documents; only those that some word has are gathered.
    """
    lower = name_list.select(F.lower("name").alias("word"), F.col("name_type").alias("kind")).filter("word is not null and kind is not null").distinct()
    words = cut_lineage(docs.select(text_col).mapInArrow(_words_in, "word string").distinct())
    names = {k: [r["word"] for r in lower.filter(F.col("kind") == k).join(words, "word", "left_semi").collect()] for k in ("given", "family")}
    long = F.length("word") >= 4
    had = words.filter(long).select(_affix_rows("word").alias("x")).select("x.*").distinct()
    shared = lower.filter(long).select("kind", _affix_rows("word").alias("x")).groupBy("kind", "x.side", "x.affix").count().filter(F.col("count") >= least)
    rows = shared.join(had, ["side", "affix"], "left_semi").collect()
    ends = {k: tuple({r["affix"] for r in rows if r["kind"] == k and r["side"] == side} for side in ("head", "tail")) for k in ("given", "family")}
    return Names(names["given"], names["family"], least, ends)


def _names(docs: DataFrame, name_list: DataFrame, text_col: str, limit: int):
    """The names as a broadcast value; the list is counted first."""
    named = name_list.select("name", "name_type").filter(F.col("name").isNotNull()).distinct()
    few = small_or_none(named, limit) is not None
    names = Names(*load_names(named, limit)) if few else occurring_names(docs, named, text_col)
    return Shared(docs.sparkSession, names)


def find_personal(docs: DataFrame, name_list: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_limit: int = NAME_LIMIT) -> DataFrame:
    """``(id, kind, found)``: the distinct values in each document, as written there.

    Whole texts are searched.  Null and empty texts give no rows; documents with equal
    ids are searched each on its own; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = spread(docs.select(id_col, text_col).filter(F.length(text_col) > 0))
    return slim.mapInArrow(_find(_names(docs, name_list, text_col, name_limit)), f"id {kind}, kind string, found string").withColumnRenamed("id", id_col)


def mask_personal(docs: DataFrame, name_list: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_limit: int = NAME_LIMIT) -> DataFrame:
    """``(id, text, n_masked)``: the texts with typed placeholders; null stays null."""
    kind = dict(docs.dtypes)[id_col]
    out = spread(docs.select(id_col, text_col)).mapInArrow(_mask(_names(docs, name_list, text_col, name_limit)), f"id {kind}, text string, n_masked int")
    return out.withColumnRenamed("id", id_col)
