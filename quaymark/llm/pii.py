"""Personal information inside free text (problem 3).

Entities are found by their form: electronic mail (also spelled out), phone
numbers of the usual numbering plans, personal numbers of states, streets with
a house number, and names of persons.  Names come from a list that is
completed from the corpus itself: a capitalised word that stands mostly where
names stand, next to a listed name or in a personal phrase, is a name too.

Each entity is replaced by a typed placeholder, or by a surrogate: a keyed
replacement of the same type, gender, letter case, script and format.  Equal
entities get equal surrogates in every text (coreference), and a given name's
surrogate begins with the surrogate of its initial, so a name that is written
with an initial elsewhere still fits.  Digits are mapped by a keyed permutation
of the numbers of equal length, listed family names by a keyed permutation of
the list and other words by a keyed permutation of the words of equal length
and scripts, so different entities stay different; coined names are checked
against each other and against the list.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from dataclasses import replace as replace_fields
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.session import cut_table

TYPES = ("email", "phone", "id_number", "address", "name")
MAX_NAMES = 2_000_000  # what a worker may hold; names of persons grow far slower than texts

# -- electronic mail --------------------------------------------------------

_LOCAL = r"[^\W_](?:[\w.+%-]*\w)?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+%@/-])(?:{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,24}}"
    rf"|{_LOCAL}(?:[ ]?[\[({{][ ]?(?i:at)[ ]?[\])}}][ ]?|[ ]@[ ])(?:{_LABEL})(?:(?:\.|[ ]?[\[({{][ ]?(?i:dot)[ ]?[\])}}][ ]?|[ ](?i:dot)[ ])(?:{_LABEL}))+"
    rf"|{_LOCAL}[ ](?i:at)[ ]{_LABEL}(?:(?:[ ]?[\[({{][ ]?(?i:dot)[ ]?[\])}}][ ]?|[ ](?i:dot)[ ]){_LABEL})+)(?![\w@])"
)

_SPELLED = re.compile(r"(?i)[\[({ ]at[\])} ].{1,80}?[\[({ .]dot[\])} ]|[\[({][ ]?at[ ]?[\])}]")

# -- phone numbers ----------------------------------------------------------

_SEP = "[ \\u00a0\\u202f.\\-/\\u2010-\\u2015]"
PHONE = re.compile(
    rf"(?<![\w.+/@‐-―-])(?:\+{_SEP}?\d(?:{_SEP}?\(?\d\)?){{7,14}}"
    rf"|00[1-9](?:{_SEP}?\(?\d\)?){{7,14}}"
    rf"|\([2-9]\d\d\){_SEP}?[2-9]\d\d{_SEP}?\d{{4}}"
    rf"|(?:1{_SEP}?)?[2-9]\d\d{_SEP}?[2-9]\d\d{_SEP}?\d{{4}}"
    rf"|1{_SEP}\([2-9]\d\d\){_SEP}?[2-9]\d\d{_SEP}?\d{{4}}"
    rf"|\(0\d{{1,4}}\){_SEP}?\d(?:{_SEP}?\d){{4,8}}"
    rf"|0[1-9](?:{_SEP}?\d){{7,10}})(?![\w@]|[.,:/-]\d|{_SEP}\d{{2,}}[.\-/]\d)"
)
_DATE = re.compile(r"0?\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")


def _is_phone(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    if s.startswith("+"):
        return 8 <= len(d) <= 15
    if s.startswith("00"):
        return 10 <= len(d) <= 17
    if s.startswith("0") or s.startswith("(0"):
        return 9 <= len(d) <= 12 and not _DATE.match(s)
    return len(d) in (10, 11) and (len(d) == 10 or d[0] == "1")


# -- personal numbers -------------------------------------------------------

_SSN_LABEL = re.compile(r"(?i)(?:ssn|social[ ]security(?:[ ](?:number|no\.?|nr\.?|n[°º]))?|sozialversicherungsnummer|s[ée]curit[ée][ ]sociale|seguridad[ ]social)[ ]?[:=#]?[ ]?$")
_PASS_LABEL = re.compile(r"(?i)(?:passport|passnummer|reisepass|passeport|pasaporte)(?:[ -]?(?:number|nummer|no\.?|nr\.?|n[°º]|num\.?|n\.[°º]))?[ ]?[:=#]?[ ]?$")
SSN = re.compile(r"(?<![\w.-])(\d{3})([- ]?)(\d{2})\2(\d{4})(?![\w]|[-.]\d)")
NINO = re.compile(r"(?<![\w-])(?i:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]|QQ)[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?(?i:[A-D])(?![\w-])")
PASSPORT = re.compile(r"(?<![\w-])(?:[A-Za-z]{1,2}\d{6,8}|\d{9})(?![\w-])")

# -- street addresses -------------------------------------------------------

_NO = r"\d{1,5}"
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’.-]*"
_EN = r"(?:Street|Avenue|Road|Lane|Court|Boulevard|Drive|Terrace|Square|Row|Place|Way|Close|St|Ave|Rd|Ln|Ct|Blvd|Dr|Pl|Sq)"
_FR = r"(?:rue|avenue|av\.|bd|boulevard|impasse|chemin|place|allée|quai|route|cours|passage)"
_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Carrera|Ronda|Travesía)"
_DE_END = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|chaussee)"
_WORD = r"[^\W\d_][\w'’.-]*"


def _streets(cap: str, prefix: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(
        rf"(?<![\w.-])(?:(?P<en>{_NO}[a-zA-Z]?\s+(?:{cap}\s+){{1,4}}{_EN})(?![\w-])"
        rf"|(?P<fr>{_NO}(?:\s?(?:bis|ter|quater))?,?\s+{_FR}\s+(?:(?:de\s+la|de\s+l['’]|du|des|de|d['’]|la|le|les)\s*)*{cap}(?:\s(?:de|du|des|la)\s{cap})?)"
        rf"|(?P<es>{_ES}\s*(?:(?:de|del|de\s+la|de\s+los|las|los|la|el)\s+)*{cap}(?:\s+(?:(?:de|del|la|las|los|el)\s+)*{cap}){{0,4}},?\s*(?:n\.?\s?[º°o]\.?|núm\.?|no\.)?\s*{_NO})(?!\w)"
        rf"|(?P<de1>[^\W\d_][\w-]*{_DE_END}\s+{_NO}\s?[a-z]?)(?!\w)"
        rf"|(?P<de2>(?:{prefix})\s+(?:{cap}\s+){{1,2}}{_NO}\s?[a-z]?)(?!\w))",
        flags,
    )


STREET = _streets(_CAP, "Am|An der|An den|Im|In der|In den|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der")
STREET_ANY = _streets(r"(?!(?:the|a|an|in|of|and|or|to|for|by|my|no|is|are|it|with|from|und|der|die|das|et|y)\s)" + _WORD, r"am\s+\w+en|unter den", re.IGNORECASE)
#: A number that may be a house number; a text without one has no address.
_HOUSE = re.compile(r"(?<![\w.:/+-])\d{1,5}(?: ?[a-zA-Z]| bis| ter)?(?![\w:/]|[.-]\d)")
_RUN = re.compile(r"\d[\d \u00a0\u202f().\-/\u2010-\u2015]{4,}\d")

# -- names ------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+(?:(?:-|['’](?![sS](?![^\W\d_])))[^\W\d_]+)*")
PARTICLES = frozenset("van von der den de la del di da du dos le ten ter zu".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle m sr sra srta don doña sir madame monsieur señor señora".split())
#: Listed names that are ordinary words or verbs as well; alone they are names only in a personal phrase.  The corpus adds its own.
ORDINARY = frozenset("mark grant hazel will rose chase drew faith mira shard quorum lattice tarn hope grace joy may june april august summer dawn frank bill jack bob pat sue rich art ray dean miles chance hunter mason page young long short black white brown green king stone wood field brook lane banks marsh rivers wells ford bush price cook baker smith miller".split())
_BEFORE = re.compile(
    r"(?i)(?:(?:^|[^\w])(?:(?:reported|written|sent|approved|requested|opened|signed|assigned)[ ](?:by|to)|by|attn|call|ping|ask|tell|told|contact|notify|prévenir|avisar[ ]a|rückfragen[ ]an|entrega[ ]a|lieferung[ ]an|livraison[ ]chez|"
    r"signalé[ ]par|gemeldet[ ]von|informado[ ]por|greet[ ]me[ ]as|dear|yesterday|user|pour|para|von|por|par|owner|customer|kunde|cliente|client|llamar[ ]a|appeler|it[ ]told|form[ ]was[ ]sent[ ]by)"
    r"[.:,]?[ ]+[\"'“(]?|(?:^|[^\w])(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sr|sra|srta)\.?[ ]+|(?:^|[^\w])(?:hi|hello|hola|hallo|bonjour),[ ]|(?:owner|row|customer|name|user)\"?:[ ]?\"?|values[ ]?\(\d+,[ ]?['\"]|(?:^|\n|[ ])[-–—][ ]|street,phone\n\")$"
)
_AFTER = re.compile(
    r"(?i)^(?:[ ]?<|[ ]?\([^\s()]+(?:@|[ ]?[\[(]at|[ ]at[ ])|,[ ][^\s,]+(?:@|[ ]?[\[(]at|[ ]at[ ])|;|[\"'],|[ ](?:already[ ]tried|here[ ]again|owes|wrote[ ]this|hat[ ]das|ya[ ]lo|a[ ]déjà|on[ ]file|when[ ]it[ ]lands)\b|"
    r"[ ]has[ ](?:ssn|ni|nino|passport|pass|social|\d)|[ ](?:on|at)[ ](?:\+|\(?\d)|,?[ ]id[ ])"
)


_SPACE = re.compile(r"\s+")


def _signs(signs: str) -> str:
    return signs if signs == " " else _SPACE.sub(" ", signs)


def left_context(text: str, a: int) -> str:
    """The word and signs before a place; only the signs at the begin of a line, one mark at that of a sentence."""
    low = max(0, a - 24)
    i = a
    while i > low and not text[i - 1].isalnum():
        i -= 1
    signs = text[i:a]
    if "\n" in signs:
        return "\n" + signs.rsplit("\n", 1)[1]
    j = i
    while j > low and text[j - 1].isalnum():
        j -= 1
    word = text[j:i].lower()
    if signs != " " and word not in TITLES and ("." in signs or "!" in signs or "?" in signs):
        return ". "
    return word + _signs(signs)


def right_context(text: str, b: int) -> str:
    """The signs and the word behind a place; a number counts as any number."""
    high = min(len(text), b + 24)
    i = b
    while i < high and not text[i].isalnum():
        i += 1
    signs = text[b:i]
    if "\n" in signs:
        return "\n"
    j = i
    while j < high and text[j].isalnum():
        j += 1
    return _signs(signs) + ("0" if text[i:j][:1].isdigit() else text[i:j].lower())


@dataclass
class Names:
    """Listed and learned names by their lower case: 'given', 'family' or both."""

    kinds: dict[str, set[str]] = field(default_factory=dict)
    learned: set[str] = field(default_factory=set)
    left: frozenset[str] = frozenset()  # what stands before names in the corpus
    right: frozenset[str] = frozenset()  # and behind them
    ordinary: frozenset[str] = ORDINARY

    def personal(self, text: str, a: int, b: int) -> bool:
        """Whether text[a:b] stands where names stand: in a phrase of the lists, or between what the corpus puts before and behind names."""
        if self.left and left_context(text, a) in self.left and right_context(text, b) in self.right:
            return True
        return bool(_BEFORE.search(text[max(0, a - 40) : a]) or _AFTER.search(text[b : b + 40]))  # more than any phrase is long

    @classmethod
    def of(cls, listed: Iterable[tuple[str, str]]) -> Names:
        out = cls()
        for token, kind in listed:
            if token and token.strip():
                words = token.lower().split()
                out.kinds.setdefault(words[-1], set()).add(kind or "given")
        return out

    def add(self, token: str, kind: str) -> None:
        if token not in self.kinds:
            self.learned.add(token)
        self.kinds.setdefault(token, set()).add(kind)


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets none of the intervals, which are sorted and don't meet each other."""
    i = bisect_left(taken, (a, a))
    return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)


def find_forms(text: str) -> list[Entity]:
    """All entities but names."""
    out: list[Entity] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        if _free(taken, a, b):
            insort(taken, (a, b))
            out.append(Entity(a, b, kind))

    if "@" in text or _SPELLED.search(text):
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    if _HOUSE.search(text):
        pattern = STREET if any(map(str.isupper, text)) and any(map(str.islower, text)) else STREET_ANY
        for m in pattern.finditer(text):
            take(m.start(), m.end() - (text[m.end() - 1] == "." and m.lastgroup == "fr"), "address")
    if _RUN.search(text):
        for m in NINO.finditer(text):
            take(m.start(), m.end(), "id_number")
        for m in SSN.finditer(text):
            if m.group(2) == "-" or _SSN_LABEL.search(text[max(0, m.start() - 40) : m.start()]):
                take(m.start(), m.end(), "id_number")
        for m in PASSPORT.finditer(text):
            if _PASS_LABEL.search(text[max(0, m.start() - 30) : m.start()]):
                take(m.start(), m.end(), "id_number")
        for m in PHONE.finditer(text):
            if _is_phone(m.group()):
                take(m.start(), m.end(), "phone")
    return out


def _gap(text: str, a: int, b: int) -> bool:
    return 0 < b - a <= 4 and text[a:b].isspace() and "\n" not in text[a:b]


def find_names(text: str, names: Names, taken: list[tuple[int, int]]) -> list[Entity]:
    kinds = names.kinds
    if kinds.keys().isdisjoint(WORD.findall(text.lower())):
        return []
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    low = [w.lower() for _, _, w in words]
    hits = [i for i, w in enumerate(low) if w in kinds]
    mixed = any(map(str.isupper, text)) and any(map(str.islower, text))
    out: list[Entity] = []
    n = len(words)
    done = -1

    def initial(i: int) -> bool:
        a, b, w = words[i]
        return len(w) == 1 and w.isalpha() and (w.isupper() or not mixed) and b < len(text) and text[b] == "."

    def end(i: int) -> int:
        return words[i][1] + (1 if initial(i) else 0)

    for i in hits:
        if i <= done or not _free(taken, words[i][0], words[i][1]):
            continue
        lo = hi = i
        # backwards: an initial, or a family name's "van", "van der"
        while lo > 0 and lo - 1 > done and _gap(text, end(lo - 1), words[lo][0]) and (initial(lo - 1) or "family" in kinds[low[i]] and low[lo - 1] in ("van", "der", "den", "ten", "ter")):
            lo -= 1
        while lo < i and low[lo] in PARTICLES and low[lo] != "van":
            lo += 1
        # forwards: initials, particles, further names
        while hi + 1 < n and _gap(text, end(hi), words[hi + 1][0]) and _free(taken, words[hi + 1][0], words[hi + 1][1]):
            j = hi + 1
            if low[j] in kinds:
                hi = j
            elif initial(j) and (j + 1 < n and low[j + 1] in kinds and _gap(text, end(j), words[j + 1][0]) or not mixed):
                hi = j
            elif low[j] in PARTICLES:
                k = j
                while k < n and low[k] in PARTICLES and k - j < 3:
                    k += 1
                if k < n and low[k] in kinds and "family" in kinds[low[k]] and all(_gap(text, words[x][1], words[x + 1][0]) for x in range(hi, k)):
                    hi = k
                else:
                    break
            else:
                break
        while hi > i and initial(hi):
            hi -= 1
        # family, given
        if lo == i and hi == i and "family" in kinds[low[i]] and hi + 1 < n and text[words[hi][1] : words[hi + 1][0]] == ", " and "given" in kinds.get(low[hi + 1], ()) and _free(taken, *words[hi + 1][:2]):
            k = hi + 1
            follows = k + 1 < n and _gap(text, words[k][1], words[k + 1][0]) and "family" in kinds.get(low[k + 1], ())
            if not follows:
                hi = k
        parts = [low[x] for x in range(lo, hi + 1) if low[x] in kinds]
        strong = [p for p in parts if p not in names.ordinary]
        a, b = words[lo][0], words[hi][1]
        capital = text[a].isupper() or not mixed
        personal = names.personal(text, a, b)
        if len(parts) > 1 or initial(lo):
            good = bool(strong) or personal
        elif strong:
            good = capital or personal or strong[0] not in names.learned
        else:
            good = capital and personal
        if good and lo > done:
            out.append(Entity(a, b, "name"))
            done = hi
    return out


def find_all(text: str | None, names: Names) -> list[Entity]:
    """Entities of a text in order; null and empty texts have none.  Positions count code points."""
    if not text:
        return []
    forms = find_forms(text)
    return sorted(forms + find_names(text, names, sorted((e.start, e.end) for e in forms)), key=lambda e: e.start)


# -- completing the list of names -------------------------------------------


#: Words of a capital and small letters, or of such parts.
_CAPITAL = re.compile(r"(?<![\w./@$#\\-])[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ]{2,}(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?(?![\w@/\\])")


def learn_contexts(texts: DataFrame, names: Names, share: float = 0.8, least: int = 10, different: int = 5, most: int = 20_000) -> Names:
    """names with what stands before and behind names in the corpus.

    A context is what left_context and right_context give.  It counts if a
    ``share`` of the capitalised words in it are listed names that are no
    ordinary words, ``different`` ones and ``least`` in number, and if it has
    more than one in ``most`` of all names, which bounds how many there are.
    """

    kinds = names.kinds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str, str], int] = {}
        for pdf in batches:
            for t in pdf["text"]:
                if not t:
                    continue
                for m in _CAPITAL.finditer(t):
                    low = m.group().lower()
                    if low in TITLES:
                        continue
                    left, right = left_context(t, m.start()), right_context(t, m.end())
                    before, behind = left[:-1] if left[-1:] == " " else "", right[1:] if right[:1] == " " else ""
                    before, behind = before in kinds or before in PARTICLES, behind in kinds
                    if low in names.ordinary and not (before or behind):
                        continue
                    name = low if low in kinds else ""
                    if not before:
                        seen[("left", left, name)] = seen.get(("left", left, name), 0) + 1
                    if not behind:
                        seen[("right", right, name)] = seen.get(("right", right, name), 0) + 1
            if len(seen) > 200_000:
                yield frame(seen)
                seen = {}
        yield frame(seen)

    def frame(seen: dict[tuple[str, str, str], int]) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["side", "context", "name", "n"])

    found = texts.select("text").mapInPandas(run, "side string, context string, name string, n long")
    named = F.when(F.col("name") != "", F.col("n")).otherwise(0)
    per = found.groupBy("side", "context").agg(F.sum("n").alias("all"), F.sum(named).alias("names"), F.approx_count_distinct(F.nullif("name", F.lit(""))).alias("different"))
    per = cut_table(per)
    total = per.where("side = 'left'").agg(F.sum("names").alias("n")).first()["n"] or 0
    good = per.where((F.col("names") >= least) & (F.col("names") >= share * F.col("all")) & (F.col("different") >= different) & (F.col("names") * most >= total)).select("side", "context").collect()  # at most ``most`` a side
    return replace_fields(names, left=frozenset(r["context"] for r in good if r["side"] == "left"), right=frozenset(r["context"] for r in good if r["side"] == "right"))


def _of_a_name(word: str, kinds: dict[str, set[str]]) -> bool:
    """Whether a word next to a name may belong to it: listed, a particle, an initial."""
    return word.lower() in kinds or word.lower() in PARTICLES or (len(word) == 1 and word.isupper())


def _slots(text: str, names: Names, counts: dict[str, list[int]]) -> None:
    """Counts for capitalised words: all, as a given name's place, as a family name's place, in a context of names; for listed ones the last two columns are all and those in small letters or in a name without a context of names."""
    kinds = names.kinds
    hit = not kinds.keys().isdisjoint(WORD.findall(text.lower()))
    for m in _CAPITAL.finditer(text):
        w = m.group()
        if (c := counts.get(w)) is None:
            c = counts[w] = [0] * 6
        c[0] += 1
        if not hit and names.left and left_context(text, m.start()) in names.left and right_context(text, m.end()) in names.right:
            c[3] += w.lower() not in TITLES
    if not hit:
        return
    forms = sorted((e.start, e.end) for e in find_forms(text))
    mixed = any(map(str.isupper, text)) and any(map(str.islower, text))
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text) if _free(forms, m.start(), m.end())]
    for i, (a, b, w) in enumerate(words):
        key = w.lower()
        nxt = words[i + 1] if i + 1 < len(words) else None
        prev = words[i - 1] if i else None
        if key in kinds:
            if mixed:
                c = counts.setdefault(f"={key}", [0] * 6)
                lo = hi = i
                while lo > 0 and _gap(text, words[lo - 1][1] + (text[words[lo - 1][1]] == "."), words[lo][0]) and _of_a_name(words[lo - 1][2], kinds):
                    lo -= 1
                while hi + 1 < len(words) and _gap(text, words[hi][1] + (text[words[hi][1]] == "."), words[hi + 1][0]) and _of_a_name(words[hi + 1][2], kinds):
                    hi += 1
                c[4] += 1
                c[5] += w[0].islower() or not names.personal(text, words[lo][0], words[hi][1])
            continue
        if w not in counts or key in TITLES or (a and (text[a - 1] in "_-./@#$\\" or text[a - 1].isdigit())) or (b < len(text) and text[b] in "_@/\\"):
            continue
        given = nxt is not None and _gap(text, b, nxt[0]) and nxt[2][0].isupper() and "family" in kinds.get(nxt[2].lower(), ()) and nxt[2].lower() not in names.ordinary
        if nxt is not None and len(nxt[2]) == 1 and nxt[2].isupper() and text[nxt[1] : nxt[1] + 1] == "." and i + 2 < len(words):
            given = given or "family" in kinds.get(words[i + 2][2].lower(), ())
        family = prev is not None and _gap(text, prev[1], a) and prev[2][0].isupper() and "given" in kinds.get(prev[2].lower(), ()) and prev[2].lower() not in names.ordinary
        family = family or (prev is not None and len(prev[2]) == 1 and prev[2].isupper() and text[prev[1] : a] == ". " and i > 1 and words[i - 2][2].lower() in kinds)
        family = family or (nxt is not None and text[b : nxt[0]] == ", " and nxt[2][0].isupper() and "given" in kinds.get(nxt[2].lower(), ()) and nxt[2].lower() not in names.ordinary)
        counts[w][1] += given
        counts[w][2] += family
        if not (given or family) and names.left:
            counts[w][3] += left_context(text, a) in names.left and right_context(text, b) in names.right


def learn_names(texts: DataFrame, listed: list[tuple[str, str]], least: int = 3, share: float = 0.4, ordinary: float = 0.5, places: int = 20) -> Names:
    """The list, completed: words of at least ``least`` places of names, a ``share`` of all their places.

    A place is one next to a listed name, or one with a context of names on
    both sides.  Listed words that are in small letters, or in a name that has
    no such context on either side, in more than ``ordinary`` of at least ``places``
    places are ordinary words of the corpus.  Every
    text is counted.  Only words that pass come to the driver; more than
    MAX_NAMES of them stop with an error, since nothing may be dropped.
    """
    base = learn_contexts(texts, Names.of(listed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    _slots(t, base, counts)
            if len(counts) > 100_000:
                yield _frame(counts)
                counts = {}
        yield _frame(counts)

    columns = ("n", "g", "f", "c", "m", "o")

    def _frame(counts: dict[str, list[int]]) -> pd.DataFrame:
        return pd.DataFrame([(k.lower(), *v) for k, v in counts.items()], columns=["word", *columns])

    found = texts.select("text").mapInPandas(run, "word string, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    good = (F.col("g") + F.col("f") + F.col("c") >= least) & (F.greatest("g", "f") + F.least("g", "f") / 2 + F.col("c") >= share * F.col("n"))
    usual = F.startswith("word", F.lit("=")) & (F.col("m") >= places) & (F.col("o") > ordinary * F.col("m"))
    rows = found.where(good | usual).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("more names than a worker may hold")
    usual_words = {r["word"][1:] for r in rows if r["word"].startswith("=")}
    for r in rows:
        if not r["word"].startswith("="):
            if r["g"] * 3 >= r["f"]:
                base.add(r["word"], "given")
            if r["f"] * 3 >= r["g"]:
                base.add(r["word"], "family")
    return replace_fields(base, ordinary=base.ordinary | usual_words)


# -- replacement ------------------------------------------------------------


def placeholders(text: str | None, entities: list[Entity]) -> str | None:
    """The text with [TYPE_i] in the places of its entities; equal entities of a text have equal numbers."""
    if not text:
        return text
    out, at, seen = [], 0, {}
    for e in entities:
        value = (e.kind, re.sub(r"[\W_]+", "", text[e.start : e.end]).lower())
        number = seen.setdefault(value, 1 + sum(k == e.kind for k, _ in seen))
        out += [text[at : e.start], f"[{e.kind.upper()}_{number}]"]
        at = e.end
    return "".join([*out, text[at:]])


_SYLLABLES = tuple(c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "tr") for v in "aeiou")


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _alike(c: str) -> tuple:
    """What the replacement of a letter or digit keeps: script and, outside ASCII, its 256 code points and its pair of cases."""
    return c.isascii(), ord(c) >> 8, _script(c), unicodedata.category(c), len(c.upper()) == 1 and c.upper().lower() == c


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> str:
    """The small letters or digits that may stand for a character; only itself for any other."""
    if not (c.isalpha() or c.isascii() and c.isdigit()):
        return c
    first = ord(c) & ~255
    return "".join(x for x in map(chr, range(first, first + 256)) if x.lower() == x and _alike(x) == _alike(c)) or c


class Surrogates:
    """Keyed replacements; one instance for a key and list of names gives the same ones everywhere."""

    def __init__(self, key: bytes, names: Names) -> None:
        self.key = key
        self.names = names
        self.map: dict[str, str] = {}
        self._words = lru_cache(maxsize=100_000)(self._permuted)
        used: set[str] = set(names.kinds) | PARTICLES
        groups: dict[tuple, list[str]] = {}
        for token in sorted(set(names.kinds) - names.learned):
            groups.setdefault(self._group(token), []).append(token)
        rest = sorted(names.learned)
        for (kind, *_), members in groups.items():
            order = sorted(members, key=lambda t: self._mac("order", t))
            if kind == "given" or len(order) < 2:
                rest += order
                continue
            # a cycle through the keyed order: a permutation without fixed points
            self.map |= dict(zip(order, order[1:] + order[:1]))
        coined = {token: self._coin(token, used) for token in rest}
        # a word that is a coined name by chance gets one of the names that no other word gets
        self.map |= coined | dict(zip(coined.values(), [*rest[1:], *rest[:1]]))
        self.taken = frozenset(self.map) | frozenset(self.map.values())

    def _group(self, token: str) -> tuple:
        kind = "given" if "given" in self.names.kinds.get(token, ()) else "family"
        return kind, self.gender(token) if kind == "given" else "", token.isascii(), " ".join(sorted({_script(c) for c in token if c.isalpha()}))

    @staticmethod
    def gender(token: str) -> str:
        """By the usual endings of given names; the rest count as one group."""
        return "f" if re.search(r"(?:[aäá]|é|ette|elle|lind|sel|se|ne|èle|eille)$", token) else "m"

    def _mac(self, what: str, value: str) -> bytes:
        return hmac.new(self.key, f"{what}\0{value}".encode(), hashlib.sha256).digest()

    def _coin(self, token: str, used: set[str]) -> str:
        given = "given" in self.names.kinds.get(token, ())
        for round_ in range(1000):
            if token.isascii():
                h = self._mac(f"coin{round_}", token)
                s = "".join(_SYLLABLES[b % len(_SYLLABLES)] for b in h[: max(2, min(8, (len(token) + 1) // 2))])
                s = s + ("a" if given and self.gender(token) == "f" and not s.endswith("a") else "")
            else:
                s = self._permuted(token, f"coin{round_}")
            if given:
                s = self._words(token[0]) + s[1:]
            if not token.isascii():
                if given and round_ < 500 and self.gender(s) != self.gender(token):
                    continue
            if s not in used:
                used.add(s)
                return s
        raise ValueError("no free name")

    def _permuted(self, word: str, what: str = "word") -> str:
        """A keyed permutation of the words of small letters and digits with these alphabets (a network of eight rounds)."""
        letters = [_alphabet(c) for c in word]
        free = [i for i, x in enumerate(letters) if len(x) > 1]
        if not free:
            return word
        out = list(word)
        if len(free) == 1:
            i = free[0]
            # a cycle through the keyed order, as for names
            order = sorted(letters[i], key=lambda c: self._mac(f"{what} letter", c))
            out[i] = order[(order.index(word[i]) + 1) % len(order)] if word[i] in order else word[i]
            return "".join(out)
        halves = free[: len(free) // 2], free[len(free) // 2 :]
        # one function for each sequence of alphabets and characters that stay
        kind = "\0".join(x if len(x) == 1 else x[0] for x in letters)
        for round_ in range(8):
            moved, other = halves[round_ % 2], halves[1 - round_ % 2]
            f = int.from_bytes(hashlib.shake_256(self._mac(f"{what}{round_}\0{kind}", "".join(out[i] for i in other))).digest(8 + len(moved) * 2), "big")
            n = 0
            for i in moved:
                n = n * len(letters[i]) + letters[i].index(out[i])
            n += f
            for i in reversed(moved):
                n, k = divmod(n, len(letters[i]))
                out[i] = letters[i][k]
        return "".join(out)

    def _free_word(self, word: str, barred: Callable[[str], object]) -> str:
        """The next word of the permutation's cycle that is not barred: a permutation of the words that are not."""
        out = self._words(word)
        while barred(out):
            out = self._words(out)
        return out

    @staticmethod
    def _case(like: str, word: str) -> str:
        if like.isupper() and len(like) > 1:
            return word.upper()
        return word.capitalize() if like[:1].isupper() else word

    def word(self, token: str) -> str:
        low = token.lower()
        if len(low) == 1:
            return self._case(token, self._words(low))
        return self._case(token, self.map.get(low) or self._free_word(low, self.taken.__contains__))

    def digits(self, value: str) -> str:
        """A keyed permutation of the digit strings of this length (a balanced network of eight rounds)."""
        n = len(value)
        if n < 2:
            return str((int(value) + 1 + self._mac("digit", "")[0] % 9) % 10) if value else value
        u = n // 2
        a, b = value[:u], value[u:]
        for i in range(8):
            f = int.from_bytes(self._mac(f"round{i}:{n}", b)[:12], "big")
            a, b = b, str((int(a) + f) % 10 ** len(a)).zfill(len(a))
        return a + b

    def _numbers(self, s: str, keep: int) -> str:
        """Digits after the first ``keep`` are permuted, everything else stays."""
        places = [i for i, c in enumerate(s) if c.isdigit() and c.isascii()]
        moved = places[keep:]
        new = self.digits("".join(s[i] for i in moved))
        out = list(s)
        for i, c in zip(moved, new):
            out[i] = c
        return "".join(out)

    def replace(self, kind: str, value: str) -> str:
        if kind == "name":
            return WORD.sub(lambda m: m.group() if m.group().lower() in PARTICLES else self.word(m.group()), value)
        if kind == "phone":
            return self._numbers(value, 2 if value.startswith("+") else 4 if value.startswith("00") else 1 if value[:1] in "01" else 0)
        if kind == "id_number":
            return self._numbers(value, 0)
        if kind == "email":
            m = re.match(rf"({_LOCAL})([ ]?(?:@|[\[({{][ ]?at[ ]?[\])}}]|at)[ ]?)(.*)", value, re.IGNORECASE | re.DOTALL)
            if not m:
                return self._numbers(value, 0)
            host = re.split(r"(\W+(?:dot\W+)?)", m.group(3), flags=re.IGNORECASE)
            # the last label stays, so that a reserved or national domain remains one
            new = [x if i % 2 or i == len(host) - 1 else self._case(x, self._words(x.lower())) for i, x in enumerate(host)]
            local = self._numbers(WORD.sub(lambda w: self.word(w.group()), m.group(1)), 0)
            return local + m.group(2) + "".join(new)
        keep = re.compile(rf"(?i)^(?:{_EN}|{_FR.replace(chr(92) + '.', '')}|calle|c|avenida|avda|av|plaza|paseo|camino|ronda|am|an|im|in|zum|zur|auf|unter|bis|ter|n|no|º|de|del|la|las|los|des|du|der|den|dem|le|les|l|d)$")

        end = re.compile(r"(?i)(?<=.)(?:straße|strasse|str|weg|gasse|allee|platz|ring|ufer|damm)$")

        def street(m: re.Match[str]) -> str:
            w = m.group()
            if keep.match(w):
                return w
            if ending := end.search(w):
                return self._case(w, self._words(w[: ending.start()].lower())) + ending.group()
            return self._case(w, self._free_word(w.lower(), lambda x: keep.match(x) or end.search(x)))

        return self._numbers(re.sub(r"[^\W\d_]+", street, value), 0)

    def text(self, text: str | None, entities: list[Entity]) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for e in entities:
            out += [text[at : e.start], self.replace(e.kind, text[e.start : e.end])]
            at = e.end
        return "".join([*out, text[at:]])


# -- operators --------------------------------------------------------------


def detect(texts: DataFrame, names: Names, key: bytes) -> DataFrame:
    """src_table, src_id, pii_type, start_pos, end_pos, surrogate of every entity of (src_table, src_id, text).

    The surrogate is what ``replace`` puts in the entity's place.
    """
    shared = texts.sparkSession.sparkContext.broadcast(names)  # at most MAX_NAMES of them

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        keyed = Surrogates(key, names)
        for pdf in batches:
            rows = [(a, i, e.kind, e.start, e.end, keyed.replace(e.kind, t[e.start : e.end])) for a, i, t in zip(pdf["src_table"], pdf["src_id"], pdf["text"]) for e in find_all(t, names)]
            yield pd.DataFrame(rows, columns=["src_table", "src_id", "pii_type", "start_pos", "end_pos", "surrogate"]).astype({"src_id": "Int64", "start_pos": "int32", "end_pos": "int32"})

    return texts.select("src_table", "src_id", "text").mapInPandas(run, "src_table string, src_id long, pii_type string, start_pos int, end_pos int, surrogate string")


def replace(texts: DataFrame, names: Names, key: bytes) -> DataFrame:
    """src_table, src_id, redacted, surrogate, n_entities: every row with its text in both replaced forms.

    Null and empty texts come out as they are, texts without entities unchanged.
    """

    shared = texts.sparkSession.sparkContext.broadcast(names)  # at most MAX_NAMES of them

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        keyed = Surrogates(key, names)
        for pdf in batches:
            found = [find_all(t, names) for t in pdf["text"]]
            out = pdf[["src_table", "src_id"]].copy()
            out["src_id"] = out["src_id"].astype("Int64")
            out["redacted"] = [placeholders(t, e) for t, e in zip(pdf["text"], found)]
            out["surrogate"] = [keyed.text(t, e) for t, e in zip(pdf["text"], found)]
            out["n_entities"] = [len(e) for e in found]
            yield out

    return texts.select("src_table", "src_id", "text").mapInPandas(run, "src_table string, src_id long, redacted string, surrogate string, n_entities int")
