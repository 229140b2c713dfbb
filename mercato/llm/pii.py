"""Private data replaced by surrogates of the same kind.

Entities are found by pattern.  Each gets a surrogate by a keyed permutation of
all strings of its format (a Feistel network over its letters and digits), so
the same entity has the same surrogate in every document, two entities never
share one, and nothing has to be gathered or joined.  Letters stay letters of
their alphabet and case, digits digits, addresses and card numbers valid;
names keep their title and ending, by which gender is told.  The words of a
name found behind a title are replaced in all of its document.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ranges(*categories: str) -> str:
    """Inside of a character class: all characters of the Unicode categories; of the third plane up, CJK letters."""
    own, out = set(categories), []
    for code in range(0x20000):
        if unicodedata.category(chr(code)) in own:
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
    if "Lo" in own:
        out.append([0x20000, 0x323AF])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_CAPITAL, _UNCASED, _MARKS = _ranges("Lu", "Lt"), _ranges("Lo", "Lm"), _ranges("Mn", "Mc")
_LETTER = f"[{_CAPITAL}{_UNCASED}{_MARKS}{_ranges('Ll')}]"
_TITLE = "(?:Mrs|Mr|Ms|Miss|Dr|Professor|Prof|Herr|Frau|Madame|Monsieur|Mme|Señora|Señor|Sra|Sr)"
_GAP = r"[^\S\n]+"
_JOINED = f"(?:['’ʼ‐‑-](?!s(?!{_LETTER})){_LETTER}+)*"
_INITIALS = f"(?:[{_CAPITAL}][{_MARKS}]*\\.-?)+"
_PARTICLE = "(?:von|vom|van|zu|zum|zur|de|der|den|dem|des|del|della|di|da|das|do|dos|du|d|la|las|le|les|lo|los|el|al|bin|ben|ibn|ter|ten|te|y|af|av)"
_FIRST = f"(?:{_INITIALS}(?:{_LETTER}+{_JOINED})?|{_LETTER}+{_JOINED})"
_CAPITALISED = f"(?!{_TITLE}\\b)(?:{_INITIALS}(?:{_LETTER}+{_JOINED})?|(?:(?:d|l|al|el)['’-])?[{_CAPITAL}]{_LETTER}*{_JOINED})"
_MORE = f"(?:{_GAP}(?:{_PARTICLE}{_GAP})*{_CAPITALISED})*"
#: Titles, then a word, all capitalised words behind it and up to three words of a script without capitals.
_NAME = rf"\b(?:{_TITLE}(?:\.[^\S\n]*|{_GAP}))+(?P<who>(?!{_TITLE}\b){_FIRST}{_MORE}(?:{_GAP}[{_UNCASED}]{_LETTER}*{_JOINED}){{0,3}}{_MORE})"

PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?)(?P<value>[^\s\"',;]{6,})|\b[0-9a-f]{40}\b|\b[0-9a-f]{64}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.-])\d{13,19}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "name": _NAME,
}
FOUND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
ANY = re.compile(rf"[\d@]|\b{_TITLE}\b|(?i:password|passwd|pwd|secret|token|api)")
#: Runs of letters, apart for Han, Hiragana and Katakana, whose change ends a word.
WORDS = re.compile(f"[\u3005\u3400-\u9fff\U00020000-\U000323af]+|[\u3041-\u309f]+|[\u30a1-\u30ff]+|(?:(?![\u3005\u3041-\u309f\u30a1-\u30ff\u3400-\u9fff\U00020000-\U000323af]){_LETTER})+")
#: Words that are no names by themselves, when found without a title.
COMMON = frozenset(
    "A An And As At But By For From He Her His I If In It No Not Of On Or She So That The Then They This To We What When Who Will With You Your "
    "Aber Als Am Auch Das Dem Den Der Die Ein Eine Er Es Für Ich Im Ist Mit Nicht Sie Und Von Was Wir Zu "
    "Ce Ces De Des Du Elle Elles En Est Et Il Ils Je La Le Les Mais Nous On Ou Pour Que Qui Un Une Vous "
    "Con Del El Ella En Es Ese Esta Este La Las Lo Los No Para Pero Por Que Si Su Una Uno Y Yo Jr Sr II III IV".split()
)
#: Endings and particles, where they are not the whole name.
_KANA = re.compile("[\u3041-\u309f]+")
#: Scripts written without spaces, where a name has letters right beside it.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7a3\U00020000-\U000323af]{2,}")

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
LETTERS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, range(0x3B1, 0x3C2))), "".join(map(chr, range(0x391, 0x3A2))),
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
]
SPOKEN = [_VOWELS, _CONSONANTS, _VOWELS.upper(), _CONSONANTS.upper(), *LETTERS[3:], LETTERS[0]]
#: Han and Hangul.
_LARGE = ["".join(map(chr, range(0x4E00, 0xA000))), "".join(map(chr, range(0xAC00, 0xD7A4)))]
ROUNDS = 8


def permute(values: list[int], sizes: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all tuples of numbers below ``sizes``; one size alone is shifted."""
    half = len(values) // 2

    def pack(numbers, bases):
        n = 0
        for x, base in zip(numbers, bases):
            n = n * base + x
        return n

    def area(bases):
        n = 1
        for base in bases:
            n *= base
        return n

    sides = [pack(values[:half], sizes[:half]), pack(values[half:], sizes[half:])]
    most = [area(sizes[:half]), area(sizes[half:])]
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        into, of = step % 2, 1 - step % 2
        seed = f"{step}/{tweak}/{sizes}/{sides[of] if most[of] > 1 else 0}".encode()
        moved = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=64).digest(), "big")
        sides[into] = (sides[into] + (-moved if back else moved)) % most[into]
    out: list[int] = []
    for side, bases in zip(sides, (sizes[:half], sizes[half:])):
        part = []
        for base in reversed(bases):
            side, x = divmod(side, base)
            part.append(x)
        out += reversed(part)
    return out


def unpermute(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """The inverse of ``permute``."""
    return permute(values, sizes, key, tweak, back=True)


def moved_off(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation that leaves no tuple as it is: a shift of all tuples, seen through ``permute``."""
    area = 1
    for base in sizes:
        area *= base
    if area == 1:
        return values
    seed = hashlib.blake2b(f"shift/{tweak}/{sizes}".encode(), key=key, digest_size=64).digest()
    n = 0
    for x, base in zip(permute(values, sizes, key, tweak), sizes):
        n = n * base + x
    n = (n + 1 + int.from_bytes(seed, "big") % (area - 1)) % area
    out = []
    for base in reversed(sizes):
        n, x = divmod(n, base)
        out.append(x)
    return unpermute(out[::-1], sizes, key, tweak)


@lru_cache(maxsize=None)
def _rows(category: str) -> dict[int, str]:
    """The letters of a category outside the known alphabets by their 256 code points; rows of one letter are joined as -1."""
    known, rows = set("".join([*SPOKEN, *_LARGE])), {}
    for code in range(0x110000):
        if unicodedata.category(chr(code)) == category and chr(code) not in known:
            rows[code >> 8] = rows.get(code >> 8, "") + chr(code)
    single = [row for row, some in rows.items() if len(some) == 1]
    return rows | {row: "" for row in single} | {-1: "".join(rows[row] for row in single)}


@lru_cache(maxsize=100_000)
def alphabet(letter: str) -> str:
    """The letters that a letter of a name is replaced within: its alphabet, else those of its kind in its 256 code points."""
    for known in [*SPOKEN, *_LARGE]:
        if letter in known:
            return known
    rows = _rows(unicodedata.category(letter))
    return rows[ord(letter) >> 8] or rows[-1]


def name_word(word: str, key: bytes) -> str:
    """A run of letters of a name, always changed; one of a script with capitals keeps its last letter if it has more."""
    places = [i for i, c in enumerate(word) if c.isalpha()]
    if len(places) > 1 and unicodedata.category(word[places[-1]]) not in ("Lo", "Lm"):
        places.pop()
    own = [alphabet(word[i]) for i in places]
    out = list(word)
    for i, a, x in zip(places, own, moved_off([a.index(word[i]) for i, a in zip(places, own)], [len(a) for a in own], key, "name")):
        out[i] = a[x]
    return "".join(out)


def letters(text: str, key: bytes, kind: str, alphabets: list[str] | None = None) -> str:
    """``text`` with its letters and digits permuted, each within its alphabet; other characters stay."""
    alphabets = alphabets or LETTERS
    places = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
    if not places:
        return text
    moved = permute([a.index(text[i]) for i, a in places], [len(a) for _, a in places], key, kind)
    out = list(text)
    for (i, a), x in zip(places, moved):
        out[i] = a[x]
    return "".join(out)


_HEX = "0123456789abcdef"


def secret_text(text: str, key: bytes) -> str:
    """A secret with every character replaced within its alphabet or kind, signs included, and always changed as a whole.

    Secrets of hex digits stay such, and no other becomes one: it is moved on
    until it isn't (so a circle of hex strings alone would lead back to it,
    at a chance of about one in all strings of its format).
    """
    plain = not set(text) <= set(_HEX)
    own = [next((a for a in LETTERS if c in a), None) or alphabet(c) for c in text] if plain else [_HEX] * len(text)
    sizes, out = [len(a) for a in own], text
    while out == text or (plain and set(out) <= set(_HEX)):
        moved = moved_off([a.index(c) for a, c in zip(own, out)], sizes, key, "secret" if plain else "hex")
        out = "".join(a[x] for a, x in zip(own, moved))
        if out == text:
            break
    return out


def _luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The replacement of an entity of ``kind``; distinct entities get distinct ones."""
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{letters(name.lower(), key, 'email')}@{letters(labels.lower(), key, 'domain')}.{top.lower()}"
    if kind == "ip":
        return ".".join(map(str, permute([int(x) for x in entity.split(".")], [256] * 4, key, "ip")))
    if kind == "card":
        digits = re.sub(r"\D", "", entity)
        if int(digits[-1]) == _luhn(digits[:-1]):
            first = letters(digits[:-1], key, "card")
            moved = iter(first + str(_luhn(first)))
        else:  # not a valid number: its last digit is moved off the valid one, too
            first, gap = letters(digits[:-1], key, "card"), int(digits[-1]) - _luhn(digits[:-1])
            moved = iter(first + str((_luhn(first) + gap) % 10))
        return re.sub(r"\d", lambda _: next(moved), entity)
    if kind == "iban":
        return entity[:4] + letters(entity[4:], key, "iban")
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])|", entity)[0]
        digits = re.sub(r"\D", "", entity[len(country) :])
        moved = iter(letters(digits, key, f"phone{country}"))
        return country + re.sub(r"\d", lambda _: next(moved), entity[len(country) :])
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", entity)[0]
        body = entity[len(head) :]
        return head + letters(body, key, "key", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] if body.isupper() else None)
    if kind == "secret":
        return secret_text(entity, key)
    if kind == "name":
        # A word of a name by itself, so that the surname alone is the same again.
        return WORDS.sub(lambda word: name_word(word[0], key), entity)
    return letters(entity, key, kind)


def replace(text: str, key: bytes) -> tuple[str, list[str]]:
    """``text`` with surrogates, and the kinds of the entities found, in order."""
    if not ANY.search(text):
        return text, []
    found, names, known = [], {}, {}
    for match in FOUND.finditer(text):
        kind = match.lastgroup if match.lastgroup in PATTERNS else next(k for k in PATTERNS if match[k] is not None)
        inner = {"secret": "value", "name": "who"}.get(kind)
        start, end = match.span(inner if inner and match[inner] is not None else 0)
        entity = text[start:end]
        if (kind, entity) not in known:
            known[kind, entity] = surrogate(kind, entity, key)
            for word in WORDS.findall(entity) if kind == "name" else ():
                uncased = unicodedata.category(word[0]) in ("Lo", "Lm")
                if not word[0].islower() and (len(word) > 1 or uncased) and word not in COMMON and not (_KANA.fullmatch(word) and word != entity):
                    names[word] = name_word(word, key)
        found.append((kind, start, end, known[kind, entity]))
    # Longer ones first, as a name may begin another.
    inside = sorted((x for x in names if _UNSPACED.fullmatch(x)), key=lambda x: (-len(x), x))
    inside = re.compile("|".join(map(re.escape, inside))) if inside else None
    out, kinds, at = [], [], 0

    def name(match):
        word = match[0]
        if word in names:
            kinds.append("name")
            return names[word]
        return inside.sub(name, word) if inside and match.re is WORDS else word

    for kind, start, end, new in found:
        out += [WORDS.sub(name, text[at:start]) if names else text[at:start], new]
        at = end
        kinds.append(kind)
    return "".join([*out, WORDS.sub(name, text[at:]) if names else text[at:]]), kinds


def replace_private(docs: DataFrame, key: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``), ``text`` with surrogates, and ``kinds``, the entities found in order.

    Null stays null with no kinds; empty texts stay empty.  Rows are
    independent, repeated rows get the same text, other columns are ignored.
    The same ``key`` gives the same surrogates in every run.
    """
    keep = ["doc_id"] if keep is None else keep
    secret = hashlib.sha256(key.encode()).digest()
    picked = docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done = [(None, []) if x is None else replace(x, secret) for x in batch.column(len(keep)).to_pylist()]
            kept = [batch.column(c) for c in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([x for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], [*keep, text, "kinds"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, `{text}` string, kinds array<string>")


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The check: entities (``kind``, ``entity``) of ``docs`` that share a surrogate; no rows are expected.

    Entities are made distinct before the shuffle; kinds are checked apart.
    """
    secret = hashlib.sha256(key.encode()).digest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = set()
            for value in batch.column(0).to_pylist():
                for match in FOUND.finditer(value or ""):
                    kind = next(k for k in PATTERNS if match[k] is not None)
                    inner = {"secret": "value", "name": "who"}.get(kind)
                    entity = match[inner] if inner and match[inner] is not None else match[0]
                    entity = re.sub(r"\D", "", entity) if kind == "card" else entity.lower() if kind == "email" else entity
                    found.add((kind, entity, surrogate(kind, entity, secret)))
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["kind", "entity", "surrogate"])

    entities = docs.select(text).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    shared = entities.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return entities.join(shared, ["kind", "surrogate"]).select("kind", "entity", "surrogate")
