"""Surrogates for personal data: keyed, of the same type and format, and never the same for two entities.

Every entity has a canonical form, whatever its separators and case are: digits of a card, country code and national
number of a phone, address of an IP, letters of a name's words.  Every type has a keyed permutation of the canonical forms of one
format (digits stay digits, vowels vowels, clusters of consonants clusters, each in its script; country codes, brands, reserved
domains, endings that show gender stay; listed names become listed ones of the same gender or ending).  The
surrogate of x is the form after x in the order that the permutation gives, walked on until it is valid
for the type (card and IBAN check digits stay right or wrong), and is written as x was.  That is a bijection without fixed
points: equal entities get equal surrogates in all documents (coreference), different ones never collide
(distinctness), and no document has to know of another.  with_surrogates() checks both over the whole corpus all the same.

Names are found after a title or as a given name of the lists with a surname; each word of a name that was found is
replaced wherever else it stands in the document.  Not detected: names with neither a title nor a listed given name,
names in other than Latin, Greek and Cyrillic capitals; phone numbers of under 7 digits, and bare ones that begin neither
with + nor 0 and have no North American form; postal addresses, dates of birth, other account, passport and tax numbers.
A phone number with a trunk 0 is not taken for the same as one with the country code, as its country is not known.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches, written

KEY_SETTING = "spark.rillprint.surrogates.key"
ROUNDS = 6

# Titles by gender and common given names by script and gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Monsieur", "г-н"]
NEUTRAL_TITLES = ["Dr", "Prof", "Professor"]
GIVEN_NAMES = [
    ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Martha", "Nora", "Olivia", "Sofia"],
    ["Alice", "Charlotte", "Claire", "Elizabeth", "Emily", "Helen", "Irene", "Jane", "Louise", "Sarah", "Susan", "Zoe"],
    ["Adam", "Carlos", "Daniel", "David", "Hans", "Jakob", "John", "Louis", "Martin", "Paul", "Peter", "Thomas"],
    ["Anton", "Bruno", "George", "Henry", "James", "Karl", "Marco", "Michael", "Oscar", "Pierre", "Robert", "William"],
    ["Анна", "Вера", "Елена", "Мария", "Нина", "Ольга"],
    ["Антон", "Борис", "Иван", "Олег", "Павел", "Петр"],
]
#: Common surnames by script; one becomes another with the same last letter.
SURNAMES = [
    "Adams", "Anderson", "Baker", "Bauer", "Becker", "Brown", "Carter", "Clark", "Collins", "Cooper", "Davis", "Evans", "Fischer", "Fuller", "Garcia", "Green", "Harris", "Hoffmann", "Hughes", "Jackson",
    "Johnson", "Jones", "Keller", "Lehmann", "Lopez", "Martinez", "Mason", "Meyer", "Miller", "Morris", "Nelson", "Parker", "Perez", "Roberts", "Rodriguez", "Sanchez", "Schneider", "Taylor", "Thompson", "Turner", "Walker",
    "Watson", "Weber", "Williams", "Wilson", "Zimmermann", "Hartmann", "Neumann", "Herrmann", "Gomez", "Ramirez",
    "Иванов", "Петров", "Смирнов", "Попов", "Соколов", "Морозов", "Иванова", "Петрова", "Смирнова", "Попова", "Соколова", "Морозова",
]
#: Clusters of letters in names that stand for one another: at the start of a word, elsewhere, of vowels; single letters; three letters.
CLUSTERS = [
    ["bl", "br", "cl", "cr", "dr", "fl", "fr", "gl", "gr", "pl", "pr", "sh", "sl", "sm", "sn", "sp", "st", "th", "tr"],
    ["ch", "ck", "ld", "lm", "lt", "nd", "ng", "nk", "nn", "nt", "rd", "rk", "rn", "rt", "sh", "ss", "st", "th", "tt"],
    ["ai", "au", "ea", "ee", "ei", "ie", "oo", "ou"],
    list("aeiou"),
    list("bcdfghjklmnprstvwz"),
    ["sch", "scr", "shr", "spr", "str", "thr"],
]
#: Letters that stand for one another.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}
_LIST = {name: names for names in GIVEN_NAMES for name in names}
_SURNAMES = {name: same for name in SURNAMES if len(same := sorted(n for n in SURNAMES if n[-1] == name[-1])) > 3}
#: Lengths of bank account numbers are 15 to 34; two letters and two digits come first.
_IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)"
_IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?::?[0-9A-Fa-f]{1,4}:)*:?[0-9A-Fa-f]{0,4}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})+)(?![\w:])"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join([*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES])
_GIVEN = "|".join(_LIST)
_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]+"
#: Country codes of one or two digits; all others have three.
_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))"
    rf"|(?P<iban>{_IBAN})|(?P<ipv6>{_IPV6})"
    r"|(?P<card>(?<!\w)(?<!\d[.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})(?:[ .-]?\d{2,4}(?!\d)){2,3}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]\d{2,4}(?!\d)){2,5}(?!\w)"
    r"|(?<![\w.])\+(?=[0-9](?:[ .-]?[0-9]){6,14}(?!\d))[0-9]+(?:[ .-][0-9]{2,8}(?!\d)){0,5}(?!\w)"
    r"|(?<![\w.+])(?<!\d-)(?:0(?=(?:[ /-]?[0-9]){7,14}(?!\d))[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,6})?|0[0-9]{9,10}|1?[2-9][0-9][0-9][2-9][0-9]{6}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{7})(?![\w-]|\.\d))"
    rf"|(?P<name>(?<!\w)(?:(?:(?:{_TITLE})\.? )+[^\W\d_a-zа-я][^\W\d_]+(?:[ -][^\W\d_a-zа-я][^\W\d_]+)?|(?:{_GIVEN})(?:-{_CAP})? {_CAP}(?:-{_CAP})?))"
)
#: Texts without any of these have no entity.
HINT = re.compile(rf"\d|@|::|(?:{_TITLE}|{_GIVEN})\b")
_TITLES = re.compile(rf"(?:(?:{_TITLE})\.? )*")


def luhn(digits: list[int]) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def national(text: str) -> tuple[str, str]:
    """Country code and national digits of a phone number; "0" for a trunk number, "" where there is neither."""
    digits = re.sub(r"[^0-9]", "", text)
    if text[0] == "+":
        code = _CODE.match("+" + digits)
        code = code[0][1:] if code else digits[:1]
        return code, digits[len(code) :]
    if len(digits) == 11 and digits[0] == "1" and american(digits[1:]):
        return "1", digits[1:]
    if american(digits):
        return "1", digits
    return ("0", digits[1:]) if digits[0] == "0" else ("", digits)


def american(digits: str) -> bool:
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def right_iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def is_entity(kind: str, text: str) -> bool:
    """Whether what looks like an entity is one."""
    if kind == "iban":
        account = text.replace(" ", "")
        return 15 <= len(account) <= 34 and sum(c.isdigit() for c in account) >= 10
    if kind == "ipv6":
        try:
            return len(ipaddress.IPv6Address(text).exploded.replace("0000", "").strip(":").split(":")) > 1 and text.count(":") > 2
        except ValueError:
            return False
    return True


def canonical(kind: str, text: str) -> str:
    """One form for all ways to write an entity."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", text)
    if kind == "phone":
        return "-".join(national(text))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).compressed
    if kind == "name":
        return text[len(_TITLES.match(text)[0]) :].lower()
    return text


def rewritten(text: str, digits: str) -> str:
    """The text with its last digits replaced in turn."""
    places = [i for i, c in enumerate(text) if c in "0123456789"][-len(digits) :] if digits else []
    out = list(text)
    for i, d in zip(places, digits):
        out[i] = d
    return "".join(out)


def units(word: str) -> list[tuple[int, str]]:
    """A lower-case word cut into (its list of CLUSTERS or -1, letters), the longest first."""
    out, at = [], 0
    while at < len(word):
        for size, lists in ((3, (5,) if at == 0 else ()), (2, (0, 2) if at == 0 else (1, 2)), (1, (3, 4))):
            own = word[at : at + size]
            if which := [k for k in lists if own in CLUSTERS[k]]:
                break
        out.append((which[0] if which else -1, own))
        at += len(own)
    return out


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _pad(self, kind: str, tweak: str, step: int, half: list[int], n: int) -> bytes:
        seed = repr((kind, tweak, step, half)).encode("utf-8", "surrogatepass")
        out = b""
        while len(out) < 2 * n:
            out += hashlib.blake2b(seed + len(out).to_bytes(4, "little"), key=self.key).digest()
        return out

    def _permute(self, kind: str, tweak: str, values: list[int], sizes: list[int], back: bool) -> list[int]:
        """A Feistel network over digits of mixed sizes; even and odd places are its halves."""
        sides = [list(values[0::2]), list(values[1::2])]
        bases = [sizes[0::2], sizes[1::2]]
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own, other = step % 2, 1 - step % 2
            pad = self._pad(kind, tweak, step, sides[other], len(sides[own]))
            sign = -1 if back else 1
            sides[own] = [(v + sign * int.from_bytes(pad[2 * i : 2 * i + 2], "little")) % b for i, (v, b) in enumerate(zip(sides[own], bases[own]))]
        out = list(values)
        out[0::2], out[1::2] = sides
        return out

    def after(self, kind: str, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
        """The next one of a cycle through all values of these sizes."""
        place = self._permute(kind, tweak, values, sizes, False)
        for i in range(len(place)):
            place[i] = (place[i] + 1) % sizes[i]
            if place[i]:
                break
        return self._permute(kind, tweak, place, sizes, True)

    def _walk(self, kind: str, tweak: str, values: list[int], sizes: list[int], valid) -> list[int]:
        """after(), until valid; the values themselves are, so the walk ends."""
        new = self.after(kind, tweak, values, sizes)
        while new != values and not valid(new):
            new = self.after(kind, tweak, new, sizes)
        return new

    def _digits(self, kind: str, tweak: str, digits: str, valid=lambda new: True) -> str:
        new = self._walk(kind, f"{tweak} {len(digits)}", [int(c) for c in digits], [10] * len(digits), lambda v: valid("".join(map(str, v))))
        return "".join(map(str, new))

    def _letters(self, kind: str, text: str, fixed: set[int], valid=lambda text: True) -> str:
        """A string of the same format; places in ``fixed`` and signs of no class stay."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        at = [i for i, c in enumerate(low) if c in _CLASS and i not in fixed]
        if not at:
            return text
        tweak = "".join("?" + str(_CLASS[c][0]) if c in _CLASS and i not in fixed else c for i, c in enumerate(low))
        sizes, values = [len(CLASSES[_CLASS[low[i]][0]]) for i in at], [_CLASS[low[i]][1] for i in at]

        def written(new: list[int]) -> str:
            out = list(text)
            for i, v in zip(at, new):
                c = CLASSES[_CLASS[low[i]][0]][v]
                out[i] = c.upper() if text[i] != low[i] and len(c.upper()) == 1 else c
            return "".join(out)

        return written(self._walk(kind, tweak, values, sizes, lambda new: valid(written(new))))

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        if len(labels) > 1 and labels[-2].lower() == "example":
            kept = len(domain)
        else:
            kept = len(labels[-1]) + 1
        return self._letters("email", text, {len(local), *range(len(text) - kept, len(text))})

    def _ip(self, text: str) -> str:
        octets = [int(x) for x in text.split(".")]
        private = octets[0] == 10 or octets[:2] == [192, 168]
        keep = (1 if octets[0] == 10 else 2) if private else 0
        free = self.after("ip", ".".join(map(str, octets[:keep])), octets[keep:], [256] * (4 - keep))
        while not private and (free[0] == 10 or free[:2] == [192, 168]):
            free = self.after("ip", "", free, [256] * 4)
        return ".".join(map(str, octets[:keep] + free))

    def _ipv6(self, text: str) -> str:
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        new = self.after("ipv6", f"{groups[0]:x}", groups[1:], [1 << 16] * 7)
        out = ipaddress.IPv6Address(":".join(f"{g:x}" for g in [groups[0], *new])).compressed
        return out.upper() if text.upper() == text else out

    def _card(self, text: str) -> str:
        digits = canonical("card", text)
        right = luhn([int(c) for c in digits])
        return rewritten(text, self._digits("card", digits[0], digits[1:], lambda new: luhn([int(c) for c in digits[0] + new]) == right))

    def _iban(self, text: str) -> str:
        account = canonical("iban", text)
        right = right_iban(account)
        if right:
            new = self._letters("iban", account, {0, 1, 2, 3})
            check = 98 - int("".join(str(int(c, 36)) for c in new[4:] + new[:2] + "00")) % 97
            new = f"{new[:2]}{check:02d}{new[4:]}"
        else:
            new = self._letters("iban", account, {0, 1, 2, 3}, lambda t: not right_iban(t))
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in text)

    def _phone(self, text: str) -> str:
        code, digits = national(text)
        kind = lambda d: (american(d), len(d) == 11 and d[0] == "1" and american(d[1:]), d[0] == "0")
        if code == "1":
            kind = american
        elif code:
            kind = len
        own = kind(digits)
        return rewritten(text, self._digits("phone", code, digits, lambda new: kind(new) == own)) if digits else text

    def _word(self, word: str) -> str:
        """A listed name becomes another of its list; any other one keeps its last letter, and clusters of letters their kind."""
        title = word.capitalize()
        for lists in (_LIST, _SURNAMES):
            if (names := lists.get(title)) and word in (title, word.upper()):
                new = names[self.after("listed", names[0], [names.index(title)], [len(names)])[0]]
                return new.upper() if word == word.upper() else new
        out = self._other(word)
        while out.capitalize() in _LIST or out.capitalize() in _SURNAMES:
            out = self._other(out)
        return out

    def _other(self, word: str) -> str:
        low = word.lower()
        if not (low.isascii() and len(low) == len(word)):
            return self._letters("name", word, {len(word) - 1})
        parts = units(low)
        lists = [[c for c in CLUSTERS[k] if i + 1 < len(parts) or c[-1] == low[-1]] if k >= 0 else [c] for i, (k, c) in enumerate(parts)]
        format_ = [(k, c if k < 0 else "") for k, c in parts]
        tweak = f"{format_} {low[-1]}"
        put = lambda values: "".join(own[v] for own, v in zip(lists, values))
        same = lambda values: [(k, c if k < 0 else "") for k, c in units(put(values))] == format_
        new = put(self._walk("name", tweak, [own.index(c) for own, (_, c) in zip(lists, parts)], [len(own) for own in lists], same))
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, word))

    def _name(self, text: str) -> str:
        title = _TITLES.match(text)[0]
        name = text[len(title) :]
        return title + "".join(w if w in " -" else self._word(w) for w in re.split(r"([ -])", name))

    def of(self, kind: str, text: str) -> str:
        if kind == "email":  # read alike in any case; the case of each letter stays
            return self._email(text)
        if (out := self.known.get((kind, text))) is None:
            ways = {"ip": self._ip, "ipv6": self._ipv6, "iban": self._iban, "card": self._card, "phone": self._phone, "name": self._name}
            out = ways.get(kind, lambda t: self._letters(kind, t, set()))(text)
            if len(self.known) < 100_000:
                self.known[kind, text] = out
        return out

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (type, entity, surrogate) of each replacement."""
        if not HINT.search(text):
            return text, []
        found = [(m.start(), m.end(), m.lastgroup) for m in ENTITY.finditer(text) if is_entity(m.lastgroup, m[0])]
        words = {w for a, b, kind in found if kind == "name" for w in re.split("[ -]", text[a + len(_TITLES.match(text[a:b])[0]) : b])}
        if words:
            again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(words | {w.upper() for w in words}))})(?!\w)")
            at, all_of = 0, []
            for a, b, kind in [*found, (len(text), len(text), "")]:
                all_of += [(m.start(), m.end(), "name") for m in again.finditer(text, at, a)]
                all_of.append((a, b, kind))
                at = b
            found = all_of[:-1]
        out, made, at = [], [], 0
        for a, b, kind in found:
            made.append((kind, text[a:b], new := self.of(kind, text[a:b])))
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), made


class Replace:
    """Batches with a text column to the same with surrogates; a column of counts is added where it is asked for."""

    def __init__(self, key: bytes, counts: str | None):
        self.key, self.counts = key, counts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(self.key)
        for batch in batches:
            at, texts, counts = batch.schema.get_field_index("text"), [], []
            for text in batch["text"].to_pylist():
                new, made = own.replace(text) if text else (text, [])
                texts.append(new)
                counts.append(len(made))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            names = list(batch.schema.names)
            if self.counts:
                columns.append(pa.array(counts, pa.int64()))
                names.append(self.counts)
            yield pa.RecordBatch.from_arrays(columns, names)


class List:
    """Batches with a text column to (type, entity, surrogate) in canonical forms, each of a batch once with its mentions."""

    def __init__(self, key: bytes):
        self.key = key

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(self.key)
        for batch in batches:
            made = Counter(x for t in batch["text"].to_pylist() if t for x in own.replace(t)[1])
            rows = [(kind, canonical(kind, old), canonical(kind, new), n) for (kind, old, new), n in made.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["type", "entity", "surrogate", "n"])


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret in the session's setting KEY_SETTING; where it is unset, as in tests, a fixed one that keeps nothing secret."""
    return spark.conf.get(KEY_SETTING, "no secret").encode()


def with_surrogates(docs: DataFrame, key: bytes, counts: str | None = None, check: bool = True) -> DataFrame:
    """The rows of docs, with surrogates in the text; no other column changes.

    The key is the owner's secret: the same key gives the same surrogates.  Null and empty texts stay; equal texts get equal
    surrogates; an empty table gives no rows.  ``counts`` names a column (long) to add for the number of entities; if
    docs have a column of that name, ValueError is raised.  With ``check``, the entities of all documents are looked through
    first, and ValueError is raised if two of them would get one surrogate, one several, or one itself.
    """
    if counts and (clash := [c for c in docs.columns if c.lower() == counts.lower()]):
        raise ValueError(f"documents have a column {clash[0]}")
    if check and (bad := collisions(written(entities(docs, key), "entities")).limit(3).collect()):
        raise ValueError(f"surrogates collide: {[(r['type'], r['number']) for r in bad]}")
    schema = StructType([*docs.schema.fields, *([StructField(counts, LongType())] if counts else [])])
    return small_batches(docs).mapInArrow(Replace(key, counts), schema)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """type, entity and surrogate in canonical forms, and number of mentions, over all documents."""
    made = small_batches(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(List(key), "type string, entity string, surrogate string, n long")
    return made.groupBy("type", "entity", "surrogate").agg(F.sum("n").alias("mentions"))


def collisions(found: DataFrame) -> DataFrame:
    """type, form and number: surrogates of entities() that stand for several entities or for themselves, and entities with several."""
    found = found.groupBy("type", "entity", "surrogate").agg(F.count(F.lit(1)).alias("n"))
    several = lambda one: found.groupBy("type", F.col(one).alias("form")).agg(F.count(F.lit(1)).alias("number")).where("number > 1")
    itself = found.where("entity = surrogate").select("type", F.col("entity").alias("form"), F.lit(1).cast("long").alias("number"))
    return several("surrogate").union(several("entity")).union(itself)
