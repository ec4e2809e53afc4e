"""Surrogates for personal data: keyed, type-consistent replacements that keep format, script and gender marks.

An entity is first brought to a canonical form, so that its variants are one entity: an e-mail address or a name
whatever its case, a phone number, IBAN or card whatever its separators. The slots of the canonical form (digits, vowels,
consonants, ideographs, other letters) make one number below the product of their radices, and a keyed permutation
without fixed points moves it. So the same entity has the same surrogate over the whole corpus, without a join, two
entities of one shape never share one, and none stays itself. What stays is the shape: separators, case, length, the
domain of a mail provider, a country code, the first digit of a card; check digits of cards and IBANs are made anew.

Names go word by word: the surrogate of a word keeps script and the gender that a list of given names tells, else
length and the last letter. Every other mention of a word of a found name in the document is replaced too, unless it
begins with a lower-case letter, so "Dr Weber", "Anna Weber" and "WEBER" stay one person. A collision check follows:
where a surrogate is a word that the document itself holds, it is permuted again, so that it isn't taken for another
person; and all surrogates of a document are held to be distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from math import isqrt

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, in_arrow

#: Key of the surrogates; production passes its own.
KEY = b"surrogate key 1"
ROUNDS = 6
KINDS = ("email", "ipv4", "iban", "phone", "ssn", "number", "name")
#: Honorifics by the gender that they tell (n: none).
HONORIFICS = {
    "m": "Mr Mister Herr Monsieur Señor Sr Don Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Srta Doña Госпожа".split(),
    "n": "Dr Prof Professor Doctor".split(),
}
_TITLES = "|".join(sorted((t for x in HONORIFICS.values() for t in x), key=len, reverse=True))
#: Given names by gender; a surrogate of one is another of the same gender.
GIVEN = {
    "m": "adam alan albert alex andreas antoine anton arthur ben bernd carl carlos charles claude daniel david diego edgar emil eric felix frank georg hans henri hugo ivan jack james jan javier john jorge josef juan karl kevin klaus leon louis luis lukas marc mario martin max michael miguel nico oliver oscar otto pablo paul pedro peter philip pierre rafael ralf richard robert simon stefan thomas tim tom victor walter werner william".split(),
    "f": "alice alina amelie ana andrea anna anne barbara beate carla carmen caroline chloe clara claire diana elena elisa ella emily emma erika eva fiona gisela grace hanna heidi helen ida ines irene iris isabel jana jane julia karin kate laura lena lisa lola louise lucia maria marie marta mary mia monika nadia nina olga paula petra pilar rita rosa ruth sara silvia sofia sonia sophie susan tanja teresa ursula vera zoe".split(),
}
_GENDER = {name: g for g, names in GIVEN.items() for name in names}
#: What follows the first letters of a word: parts after an apostrophe or hyphen, but not a genitive s.
_PARTS = r"[\p{L}\p{M}]*(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]+)*"
_WORDS = regex.compile(rf"\p{{L}}{_PARTS}")
#: A word of a name: it begins with an upper-case letter or one of a script without case.
_NAME_WORD = rf"[\p{{Lu}}\p{{Lt}}\p{{Lo}}]{_PARTS}"
_DETECT = regex.compile(
    r"(?P<email>(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?<![\w.])(?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"
    r"|(?<![\w+])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{2,4}\)\x20?\d{3,4}[\x20.-]?\d{4}|\d{3}[\x20.-]\d{3}[\x20.-]\d{4})(?!\w)"
    r"|(?<![\w.])(?P<number>\d(?:[\x20-]?\d){12,18})(?!\w)"
    rf"|(?<!\w)(?P<title>{_TITLES})\.?\x20(?P<name>{_NAME_WORD}(?:\x20{_NAME_WORD}){{0,2}})"
)
_HINT = regex.compile(rf"[0-9@]|(?<!\w)(?:{_TITLES})\.?\x20[\p{{Lu}}\p{{Lt}}\p{{Lo}}]")
#: Domains that many people share, so they stay.
SHARED_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "example.com", "example.org", "example.net")
#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}
_VOWELS = "aeiouаеиоуыэюяαεηιουω"
#: Scripts whose letters are one kind; those of others are taken by blocks of 64 code points.
_SPANS = {"latin": (0x61, 0x7A), "greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3)}


@cache
def _kind(c: str) -> tuple[str, bool]:
    """The script of a letter, and if it is a vowel (with or without accents)."""
    script = next((n for n, (a, b) in _SPANS.items() if a <= ord(c) <= b), f"{ord(c) // 64:x}")
    return script, script not in ("han", "hangul") and unicodedata.normalize("NFD", c)[0] in _VOWELS


@cache
def _letters(script: str, vowel: bool) -> str:
    """The letters of a kind, lower-case or caseless, that have a single upper-case form."""
    a, b = _SPANS.get(script) or (int(script, 16) * 64, int(script, 16) * 64 + 63)
    return "".join(c for c in map(chr, range(a, b + 1)) if c.isalpha() and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c and _kind(c) == (script, vowel))


@cache
def _slot(c: str) -> str:
    """All that can stand for a lower-case character: digits, letters of its kind, or only itself."""
    if c in "0123456789":
        return "0123456789"
    found = _letters(*_kind(c)) if c.isalpha() else c
    return found if c in found else c


class Permutation:
    """A keyed permutation of range(n) without fixed points: x -> p'(p(x) + step), p a Feistel network with cycle walks."""

    def __init__(self, key: bytes, n: int) -> None:
        self.key, self.n = key, n
        self.a = isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.step = self._f(99, n) % (n - 1) + 1 if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%d %d %d" % (self.n, i, x), "sha256")[:16], "big")

    def _walk(self, x: int, back: bool) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._f(i, left)) % self.b
                else:
                    left = (left + sign * self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + self.step) % self.n, True) if self.n > 1 else x


def _moved(key: bytes, plain: str, fixed: frozenset[int] = frozenset()) -> str:
    """plain (lower case) with the characters of its slots, but those at fixed places, moved by the keyed permutation.

    Where nothing can move it raises ValueError; the caller masks such an entity.
    """
    slots = [(i, s) for i, c in enumerate(plain) if i not in fixed and len(s := _slot(c)) > 1]
    if not slots:
        raise ValueError("no slot")
    n, x = 1, 0
    for i, s in slots:
        x = x * len(s) + s.index(plain[i])
        n *= len(s)
    out = list(plain)
    for i, _ in slots:
        out[i] = "\0"
    shape = "".join(out) + "|" + "".join(s[0] for _, s in slots)
    y = Permutation(hashlib.sha256(key + shape.encode()).digest(), n)(x)
    for i, s in reversed(slots):
        y, d = divmod(y, len(s))
        out[i] = s[d]
    return "".join(out)


def _counts(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def _low(c: str) -> str:
    return low if len(low := c.lower()) == 1 else c


def bare(text: str) -> str:
    """Letters, marks and digits of text in lower case, one character each."""
    return "".join(_low(c) for c in text if _counts(c))


def _dressed(plain: str, like: str) -> str:
    """plain with the case and the separators of like, whose letters and digits its characters take the places of."""
    left = iter(plain)
    return "".join((next(left).upper() if c.isupper() else next(left)) if _counts(c) else c for c in like)


def canonical(kind: str, text: str) -> str:
    """What the variants of one entity have in common."""
    if kind in ("email", "ipv4"):
        return "".join(map(_low, text))
    return " ".join(bare(w) for w in _WORDS.findall(text)) if kind == "name" else bare(text)


def luhn(digits: str) -> int:
    """The check digit after digits."""
    return -sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))) % 10


def iban_check(country: str, account: str) -> int:
    """The two check digits of an IBAN: 98 less the remainder by 97 of all, letters as 10 to 35, the country last."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


@lru_cache(1 << 15)
def _plain_surrogate(key: bytes, kind: str, plain: str) -> str:
    """The canonical surrogate of a canonical entity (no name); it depends on nothing but the key, the kind and the entity."""
    key = key + kind.encode()
    if kind == "ipv4":  # four octets as one number, private first octets among themselves
        octets = [int(x) for x in plain.split(".")]
        rest = (octets[1] << 16) + (octets[2] << 8) + octets[3]
        if octets[0] in (0, 10, 127, 192, 172) or octets[0] > 223:
            y = Permutation(key + b"%d" % octets[0], 1 << 24)(rest)
            return f"{octets[0]}.{y >> 16}.{y >> 8 & 255}.{y & 255}"
        public = [i for i in range(1, 224) if i not in (10, 127, 172, 192)]
        y = Permutation(key, len(public) << 24)((public.index(octets[0]) << 24) + rest)
        return f"{public[y >> 24]}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"
    if kind == "email":  # a provider's domain stays, and so does the last label of any other
        local, _, domain = plain.rpartition("@")
        keep = any(domain == d or domain.endswith("." + d) for d in SHARED_DOMAINS)
        first = len(local) if keep else len(plain) - len(domain) + domain.rindex(".")
        return _moved(key, plain, frozenset(range(first, len(plain))))
    if kind == "number":  # the first digit (a card's network) and the distance from the right check digit stay
        off = (int(plain[-1]) - luhn(plain[:-1])) % 10
        out = _moved(key, plain, frozenset({0, len(plain) - 1}))
        return out[:-1] + str((luhn(out[:-1]) + off) % 10)
    if kind == "iban":  # the country and the distance from the right check digits stay
        off = (int(plain[2:4]) - iban_check(plain[:2], plain[4:])) % 97
        account = _moved(key, plain[4:])
        check = (iban_check(plain[:2], account) + off) % 97
        return f"{plain[:2]}{check if check > 1 or off else check + 97:02d}{account}"
    return _moved(key, plain)


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of an entity other than a name, in the format of text."""
    plain = canonical(kind, text)
    if kind == "phone":  # the country code stays; a number without one is another entity
        code = 0 if text[0] != "+" else 1 if plain[0] in "17" else 2 if int(plain[:2]) in _TWO_DIGITS else 3
        return _dressed(plain[:code] + _plain_surrogate(key + plain[:code].encode(), "phone", plain[code:]), text)
    made = _plain_surrogate(key, kind, plain)
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(text, made, strict=True))
    return made if kind == "ipv4" else _dressed(made, text)


@lru_cache(1 << 15)
def _name_word(key: bytes, plain: str, turn: int) -> str:
    """The surrogate of a bare word of a name, permuted once and turn times more: a given name goes to one of the same
    gender; of other words the letters move but the last, or all where only that can."""
    for _ in range(turn + 1):
        if g := _GENDER.get(plain):
            plain = GIVEN[g][Permutation(key + b"given" + g.encode(), len(GIVEN[g]))(GIVEN[g].index(plain))]
            continue
        try:
            plain = _moved(key + b"name", plain, frozenset({len(plain) - 1}))
        except ValueError:
            plain = _moved(key + b"name", plain)
    return plain


def _spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the entities of a text, leftmost first and not overlapping.

    A name is found after an honorific; so is each other mention of one of its words of two letters or more that does
    not begin with a lower-case letter.
    """
    if not _HINT.search(text):
        return []
    found = [("name", *m.span("name")) if m["name"] else (m.lastgroup, *m.span(m.lastgroup)) for m in _DETECT.finditer(text)]
    names = {w for k, a, b in found if k == "name" for x in _WORDS.findall(text[a:b]) if len(w := bare(x)) > 1}
    if not names:
        return found
    taken = bytearray(len(text))
    for _, a, b in found:
        taken[a:b] = b"\1" * (b - a)
    found += [("name", *m.span()) for m in _WORDS.finditer(text) if bare(m[0]) in names and not m[0][0].islower() and not any(taken[m.start() : m.end()])]
    return sorted(found, key=lambda x: x[1])


def entities(text: str) -> list[tuple[str, int, int]]:
    return _spans(text)


def _word_map(text: str, spans: list[tuple[str, int, int]], key: bytes) -> dict[str, str]:
    """The surrogate of each bare word of the names of a text: distinct, and no word that the text itself holds."""
    words = sorted({bare(w) for k, a, b in spans if k == "name" for w in _WORDS.findall(text[a:b])})
    held = {bare(m[0]) for m in _WORDS.finditer(text)} if words else set()
    out: dict[str, str] = {}
    for w in words:
        for turn in range(20):
            try:
                new = _name_word(key, w, turn)
            except ValueError:
                break
            if new not in held and new not in out.values():
                out[w] = new
                break
        out.setdefault(w, "[name %d]" % (len(out) + 1))  # nothing in it moves, or the text holds all that it can become
    return out


def _worn(plain: str, like: str) -> str:
    """The surrogate of a word in the case of a mention, and with its hyphens where the lengths agree."""
    if plain[0] == "[" or len(plain) == len(bare(like)):
        return plain if plain[0] == "[" else _dressed(plain, like)
    return plain.upper() if like.isupper() and len(like) > 1 else plain.capitalize() if like[0].isupper() else plain


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]], list[str]]:
    """(text with surrogates, the entities with their places in the given text, their surrogates)."""
    spans = _spans(text)
    words = _word_map(text, spans, key)
    out, at, made = [], 0, []
    kept: dict[tuple[str, str], str] = {}
    for kind, a, b in spans:
        entity = text[a:b]
        if kind == "name":
            new = _WORDS.sub(lambda m: _worn(words[bare(m[0])], m[0]), entity)
        else:
            try:
                new = surrogate(key, kind, entity)
            except ValueError:
                new = f"[{kind}]"
        plain = canonical(kind, entity)
        if new[0] != "[" and kept.setdefault((kind, canonical(kind, new)), plain) != plain and not (kind == "phone" and bare(entity) == kept[kind, canonical(kind, new)]):
            raise ValueError("two entities of a document have one surrogate")
        made.append(new)
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), spans, made


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("entity", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            for begin, some in chunks(batch.column("text").to_pylist()):
                texts, found = [], []
                for t in some:
                    new, spans, made = replaced(t, key) if t else (t, [], [])
                    texts.append(new)
                    found.append([{"kind": k, "start": a, "stop": b, "entity": t[a:b], "surrogate": s} for (k, a, b), s in zip(spans, made, strict=True)])
                yield pa.record_batch([batch.column("doc_id").slice(begin, len(some)), pa.array(texts, pa.string()), pa.array(found, kind)], names=["doc_id", "text", "found"])

    return run


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, found) of every row of docs (doc_id, text): the text with surrogates, and what was replaced.

    found: array<struct<kind, start, stop, entity, surrogate>>, places by code points of the given text. An entity in
    which nothing can move is masked in brackets. A null text stays null and an empty one empty, with nothing found;
    null ids pass; repeated rows each come back (and alike); an empty table gives an empty one; extra columns are
    ignored.
    """
    schema = "doc_id long, text string, found array<struct<kind:string,start:int,stop:int,entity:string,surrogate:string>>"
    return in_arrow(columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), _surrogates(key), schema)


def _canonical(text: str) -> Column:
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", ""))
    return F.when(F.col("x.kind").isin("email", "ipv4"), F.lower(text)).otherwise(plain)


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, entities) that two or more entities of with_surrogates' rows share: none, if all is right.

    Names and masks are left out: a name's word is permuted again in a document that holds its surrogate, so that over
    the corpus only the other kinds are distinct by construction. Within a document replaced() checks all kinds.
    """
    pairs = found.select(F.explode("found").alias("x")).where("x.kind <> 'name' AND NOT x.surrogate LIKE '[%'")
    pairs = pairs.select("x.kind", _canonical("x.surrogate").alias("surrogate"), _canonical("x.entity").alias("entity")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
