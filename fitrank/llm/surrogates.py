"""Personal data and secrets replaced by keyed surrogates of the same kind.

Entities are found by patterns: e-mail addresses, phone numbers, payment cards, IP addresses (version 4
and 6), social security numbers, bank accounts, access keys, passwords and tokens (after their name, in
bearer headers, by known prefixes, JSON web tokens), private keys, and names after a form of address.
Phone numbers are 7 to 15 digits after a plus or an area code, or 10 and more in groups.
A surrogate is drawn from a keyed hash of the entity and has its format: letters for letters of the
same case and script, digits for digits, check digits that hold where they held, given names of the
gender of the form of address.  One entity has one surrogate in all texts and spellings, so what
belongs together stays together; a name is replaced word by word, and again where it is repeated
without the form of address.

Different entities get different surrogates, and none that is an entity of the texts itself.  For
this the entities of all texts are gathered in a table without repeats, and drawn again where two
agree or one hits a real entity, until none does.  Only entities drawn again (few, as the ranges
are large) are joined to their texts; the others need no lookup.  After some draws a surrogate gets
longer than its entity, as the range of a very short one can be used up.

Defined results: null texts stay null, texts without entities stay as they are; all other columns and
repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from fitrank.llm.batches import as_batch, columns_apart, text_slices
from fitrank.llm.scratch import settle

LONGER_AFTER = 8  # draws before surrogates get longer
WORD = r"[^\W\d_][^\W\d_'’-]*"
TITLES = {
    "m": "Mr Herr Monsieur Señor Signor господин г-н".split(),
    "f": "Mrs Ms Frau Madame Mme Mlle Señora Signora госпожа г-жа".split(),
    "x": "Dr Prof Doctor Professor Mx".split(),  # say nothing of the gender
}
GENDER_OF = {title: gender for gender, titles in TITLES.items() for title in titles}
NAME = re.compile(
    rf"(?<!\w)({'|'.join(sorted(GENDER_OF, key=len, reverse=True))})\.? "
    rf"(?:(?:Dr|Prof)\.? )*({WORD}(?:[ -]{WORD}){{0,2}})"
)
# Each run before an @ is read once, from its start.
EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?(?![\w:]|\.\d)")
# A plus and digits in groups of any length, or an area code with 0, a separator and digits.
LONG_PHONE = re.compile(
    r"(?<![\w.+])\+[1-9](?:(?:[ ./-]|\(0\)|[ .-]?\((?=\d{1,5}\))|\)[ .-]?)?\d){6,14}(?![\w@]|[.-]\d)"
    r"|(?<![\w./-])(?:\(0\d{1,5}\)[ /-]?|0[1-9]\d{0,4}(?: ?/ ?|[ -]))\d{3,12}(?:[ -]\d{1,8}){0,3}(?![\w@/]|[.-]\d)"
    r"|(?<![\w./+-])0[1-9]\d{8,9}(?![\w@/]|[.-]\d)"
)
PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|0\d{1,4}[ /])?"
    r"\d{2,4}(?:(?:[.-]\d{2,4}){1,4}|(?: \d{2,4}){1,4})?(?![\w@]|[.-]\d)"
)
PLAIN = re.compile(r"(?:19|20)\d\d[ .-](?:0?\d|1[0-2])[ .-]|\d{1,3}(?:[ .]\d{3})+$")  # dates, sums
CARD = re.compile(
    r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5})(?![\w@])"
)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)([0-9A-Z]{16})(?!\w)")
SECRET = re.compile(
    r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{4,})"
)
BEARER = re.compile(
    r"(?i)\b(?:authorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic|token)|bearer)\s+([\w.~+/=-]{7,}[\w~+/=-])"
)
JWT = re.compile(r"(?<![\w-])eyJ[\w-]{5,}\.[\w-]{4,}\.[\w-]*(?![\w-])")
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])(gh[oprsu]_|github_pat_|glpat-|xox[abeoprs]-|sk-(?:[a-z]+-)?|[rs]k_(?:live|test)_|"
    r"pk_live_|AIza|ya29\.|npm_|pypi-|hf_|SG\.|dop_v1_|shpat_)([\w.-]{15,}[\w-])(?![\w-])"
)
PRIVATE_KEY = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)(?: BLOCK)?-----"
    r"(?:((?:(?!-----BEGIN).)*?)-----END \1|((?:\s+[A-Za-z0-9+/=]{20,}(?!\S))+))",
    re.DOTALL,
)
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v".split(), "a e i o u".split(), "n r s l".split(), "a"),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), "н р с л".split(), "а"),
}


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    canon: str  # what all spellings of the entity have in common


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def luhn_holds(digits: str) -> bool:
    doubled = [int(d) for d in digits]
    doubled[-2::-2] = [d * 2 - 9 * (d > 4) for d in doubled[-2::-2]]
    return sum(doubled) % 10 == 0


def iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def numbers(text: str) -> Iterator[Entity]:
    for m in IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if iban_rest(compact) == 1:
            yield Entity(*m.span(), "iban", compact)
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if len(digits) == 16 or luhn_holds(digits):
            yield Entity(*m.span(), "card", digits)
    for m in IPV4.finditer(text):
        if all(int(part) < 256 for part in m[0].split(".")):
            yield Entity(*m.span(), "ip", ".".join(str(int(p)) for p in m[0].split(".")))
    if ":" in text:
        for m in IPV6.finditer(text):
            spelling = m[0] if m[0].endswith("::") else m[0].rstrip(":")
            try:
                address = ipaddress.IPv6Address(spelling)
            except ValueError:  # a time, a ratio
                continue
            groups = [group for group in spelling.split(":") if group]
            # Short ones without a digit, as in a::b, are names in programs.
            if any(map(str.isdecimal, spelling)) and (len(groups) > 2 or max(map(len, groups)) > 3):
                yield Entity(m.start(), m.start() + len(spelling), "ipv6", address.compressed)
    for m in SSN.finditer(text):
        yield Entity(*m.span(), "ssn", digits_of(m[0]))
    for m in LONG_PHONE.finditer(text):
        digits = digits_of(m[0])
        if 7 <= len(digits) <= 15:
            national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
            yield Entity(*m.span(), "phone", national)
    for m in PHONE.finditer(text):
        digits = digits_of(m[0])
        least = 7 if m[0][0] in "+(" else 10
        if least <= len(digits) <= 15 and any(c in m[0] for c in "+( .-/") and not PLAIN.match(m[0]):
            # With or without the country code 1 it is the same number.
            national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
            yield Entity(*m.span(), "phone", national)


def names(text: str) -> Iterator[Entity]:
    known: dict[str, str] = {}
    # A title without a gender takes that of the same given name elsewhere in the text.
    for m in sorted(NAME.finditer(text), key=lambda m: GENDER_OF[m[1]] == "x"):
        gender, at = GENDER_OF[m[1]], m.start(2)
        words = []
        for word in re.finditer(WORD, m[2]):
            if not word[0][0].isupper():
                break
            words.append(word)
        for i, word in enumerate(words):
            kind = "surname" if i == len(words) - 1 else f"given_{gender}"
            if kind == "given_x" and known.get(word[0], "").startswith("given"):
                kind = known[word[0]]
            known.setdefault(word[0], kind)
            known.setdefault(word[0].upper(), kind)
            yield Entity(at + word.start(), at + word.end(), kind, word[0].casefold())
    if known:
        # Mentions without the form of address: runs of the words of a full name.
        again = "|".join(map(re.escape, sorted(known, key=len, reverse=True)))
        for m in re.finditer(rf"(?<!\w)(?:{again})(?:[ -](?:{again}))+(?!\w)|(?<!\w)(?:{again})(?!\w)", text):
            for word in re.finditer(WORD, m[0]):
                if word[0] in known:
                    yield Entity(
                        m.start() + word.start(), m.start() + word.end(), known[word[0]], word[0].casefold()
                    )


def entities(text: str) -> list[Entity]:
    """The entities of a text in order, without overlaps; the earlier pattern and the longer match
    come first."""
    found: list[tuple[int, Entity]] = []
    digits = any(c in text for c in "0123456789")
    if "=" in text or ":" in text:
        found += [(0, Entity(*m.span(1), "secret", m[1])) for m in SECRET.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(0, Entity(*m.span(1), "access_key", m[1])) for m in ACCESS_KEY.finditer(text)]
    if "-----BEGIN" in text:
        # One that is cut off ends with its last line of code.
        found += [(0, Entity(*m.span(m.lastindex), "secret", m[m.lastindex])) for m in PRIVATE_KEY.finditer(text)]
    found += [
        (0, Entity(*m.span(1), "secret", m[1]))
        for m in BEARER.finditer(text)
        if m[0][0] in "aA" or len(m[1]) > 20 or not m[1].isalpha()  # else it may be a word
    ]
    if "eyJ" in text:
        found += [(0, Entity(m.start() + 3, m.end(), "secret", m[0][3:])) for m in JWT.finditer(text)]
    found += [
        (0, Entity(*m.span(2), "secret", m[2]))
        for m in PREFIXED.finditer(text)
        if any(c.isdecimal() for c in m[2])
    ]
    if "@" in text:
        found += [(1, Entity(*m.span(), "email", m[0].lower())) for m in EMAIL.finditer(text)]
    if digits:
        found += [(2 + i, e) for i, e in enumerate(numbers(text))]
    found += [(1 << 40, e) for e in names(text)]
    if len(found) < 2:
        return [entity for _, entity in found]
    out: list[Entity] = []
    cover = bytearray(len(text))
    for _, entity in sorted(found, key=lambda x: (x[0], x[1].start)):
        if not any(cover[entity.start : entity.end]):
            cover[entity.start : entity.end] = b"\x01" * (entity.end - entity.start)
            out.append(entity)
    return sorted(out)


class Draw:
    """Numbers from a keyed hash of one entity and draw."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}|{attempt}|{canon}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, bound: int) -> int:
        if len(self.left) < 8:
            self.left = hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % bound

    def of(self, choices):
        return choices[self.below(len(choices))]


def letters_like(char: str) -> str:
    """Letters of the case and script of a letter: the alphabet of its block of code points."""
    if char.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if char.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    block = ord(char) & ~0x7F
    same = [
        chr(c)
        for c in range(block, block + 128)
        if chr(c).isalpha() and chr(c).islower() == char.islower() and chr(c).isupper() == char.isupper()
    ]
    return "".join(same)


def shaped(text: str, draw: Draw, digits: str = "0123456789") -> str:
    return "".join(
        draw.of(digits) if c.isdecimal() else draw.of(letters_like(c)) if c.isalpha() else c
        for c in text
    )


def number_like(digits: str, draw: Draw) -> str:
    """As many digits; a first one that isn't 0 stays so."""
    first = str(1 + draw.below(9)) if digits[:1] != "0" else "0"
    return first + shaped(digits[1:], draw)


def name_like(kind: str, canon: str, draw: Draw, more: int) -> str:
    script = "cyrillic" if "а" <= canon[0] <= "ё" else "latin"
    onsets, vowels, ends, female = SYLLABLES[script]
    syllables = (2 if kind.startswith("given") else 3) + more
    name = "".join(draw.of(onsets) + draw.of(vowels) for _ in range(syllables))
    return name + draw.of(ends) + (female if kind == "given_f" else "")


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of the surrogate of an entity at a draw."""
    draw = Draw(key, kind, canon, attempt)
    more = attempt // LONGER_AFTER
    if kind.startswith("given") or kind == "surname":
        return name_like(kind, canon, draw, more)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        # The last label, and reserved names, say nothing about a person.
        keep = 2 if labels[-2] == "example" else 1
        drawn = [shaped(label, draw) for label in labels[:-keep]]
        return shaped(local, draw) + shaped("x" * more, draw) + "@" + ".".join(drawn + labels[-keep:])
    if kind == "ip":
        parts = canon.split(".")
        kept = 0
        if parts[0] in ("10", "127"):
            kept = 1
        elif parts[:2] == ["192", "168"] or (parts[0] == "172" and 16 <= int(parts[1]) < 32):
            kept = 2
        drawn = [str(1 + draw.below(254)) for _ in parts[kept:]]
        return ".".join(parts[:kept] + drawn) + (f":{more}" if more else "")
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(canon).exploded.split(":")
        local = groups[0][:2] in ("fc", "fd", "fe")  # the kind of network stays
        drawn = ["".join(draw.of("0123456789abcdef") for _ in group) for group in groups]
        drawn[0] = groups[0] if local else f"2{drawn[0][1:]}"
        return ipaddress.IPv6Address(":".join(drawn)).compressed
    extra = shaped("0" * more, draw)
    if kind == "card":
        body = canon[0] + shaped(canon[1:-1], draw) + extra
        good = next(d for d in "0123456789" if luhn_holds(body + d))
        if luhn_holds(canon):
            return body + good
        return body + draw.of([d for d in "0123456789" if d != good])
    if kind == "iban":
        body = shaped(canon[4:], draw) + extra
        rest = iban_rest(canon[:2] + "00" + body)
        return f"{canon[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        head = len(canon) - 10 if len(canon) > 10 else min(1, len(canon) - 7)
        return canon[:head] + number_like(canon[head:], draw) + extra
    if kind == "ssn":
        return number_like(canon, draw) + extra
    hexadecimal = all(c in "0123456789abcdef" for c in canon)
    if hexadecimal:
        return "".join(draw.of("0123456789abcdef") for _ in canon) + extra
    return shaped(canon, draw) + extra


def spelled(original: str, kind: str, canonical: str) -> str:
    """The canonical surrogate in the spelling of the original."""
    if kind in ("phone", "card", "ssn", "iban"):
        missing = max(0, sum(map(str.isalnum, original)) - len(canonical))  # a country code
        places = iter(digits_of(original)[:missing] + canonical)
        out = [next(places, "") if c.isalnum() else c for c in original]
        return "".join(out) + "".join(places)
    if kind.startswith("given") or kind == "surname":
        return canonical.upper() if len(original) > 1 and original.isupper() else canonical.capitalize()
    if kind == "email":
        return canonical.upper() if original.isupper() else canonical
    return canonical


def replaced(text: str, key: bytes, again: dict[tuple[str, str], int], cache: dict) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had."""
    found = entities(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for entity in found:
        attempt = again.get((entity.kind, entity.canon), 0)
        who = (entity.kind, entity.canon, attempt)
        if who not in cache:
            if len(cache) > 1 << 16:
                cache.clear()
            cache[who] = surrogate(key, *who)
        original = text[entity.start : entity.end]
        parts += [text[at : entity.start], spelled(original, entity.kind, cache[who])]
        at = entity.end
    return "".join([*parts, text[at:]]), len(found)


def occurrences(texts: DataFrame) -> DataFrame:
    """``key``, ``kind`` and ``canon``, once for each entity of each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, slice_texts in text_slices(batches, "text"):
            keys, kinds, canons = [], [], []
            for key, text in zip(part.column("key").to_pylist(), slice_texts, strict=True):
                for kind, canon in {(e.kind, e.canon) for e in entities(text)}:
                    keys.append(key)
                    kinds.append(kind)
                    canons.append(canon)
            yield as_batch(
                {
                    "key": pa.array(keys, pa.binary()),
                    "kind": pa.array(kinds, pa.string()),
                    "canon": pa.array(canons, pa.string()),
                }
            )

    return texts.mapInArrow(run, "key binary, kind string, canon string").distinct()


def drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``canon`` and ``attempt`` with their ``surrogate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            made = pa.array([surrogate(key, *row) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, made], names=["kind", "canon", "attempt", "surrogate"]
            )

    return rows.select("kind", "canon", "attempt").mapInArrow(
        run, "kind string, canon string, attempt int, surrogate string"
    )


def registry(found: DataFrame, key: bytes) -> DataFrame:
    """Every entity with the draw whose surrogate is no other's and no real entity."""
    real = settle(found.select("kind", "canon").distinct(), "entities")
    rows = settle(drawn(real.withColumn("attempt", F.lit(0)), key), "drawn")
    while True:
        # Names share one range, as a surname can be somebody's given name.
        group = F.when(F.col("kind").startswith("given"), "surname").otherwise(F.col("kind"))
        taken = real.select(group.alias("range"), F.col("canon").alias("surrogate")).distinct()
        grouped = rows.withColumn("range", group)
        first = grouped.groupBy("range", "surrogate").agg(
            F.min(F.struct("kind", "canon")).alias("first"), F.count("*").alias("same")
        )
        bad = (
            grouped.join(taken.withColumn("real", F.lit(True)), ["range", "surrogate"], "left")
            .join(first.filter("same > 1"), ["range", "surrogate"], "left")
            .withColumn(
                "bad",
                F.col("real").isNotNull()
                | (F.col("first").isNotNull() & (F.struct("kind", "canon") != F.col("first"))),
            )
        )
        judged = settle(bad.select("kind", "canon", "attempt", "surrogate", "bad"), "judged")
        clashes = judged.filter("bad")
        if clashes.isEmpty():
            return judged.drop("bad")
        anew = drawn(clashes.withColumn("attempt", F.col("attempt") + 1), key)
        rows = settle(judged.filter("not bad").drop("bad").unionAll(anew), "drawn")


@columns_apart("text")
def replace(docs: DataFrame, key: bytes, counted: str | None = "n_entities__") -> DataFrame:
    """The documents with surrogates in ``text`` and, where ``counted`` names a column, the number of
    replacements in it."""
    md5 = F.unhex(F.md5(docs["text"].cast("string")))
    texts = docs.select(md5.alias("key"), docs["text"].cast("string").alias("text")).filter(
        F.col("text").isNotNull()
    )
    found = settle(occurrences(texts), "occurrences")
    again = registry(found, key).filter("attempt > 0")
    by_text = settle(
        found.join(again.select("kind", "canon", "attempt"), ["kind", "canon"])
        .groupBy(F.col("key").alias("key__"))
        .agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("again__")),
        "again",
    )
    keyed = docs.withColumn("key__", md5)
    joined = keyed.join(by_text, "key__", "left").select(*[keyed[c] for c in docs.columns], "again__")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for part, slice_texts in text_slices(batches, "text"):
            valid = part.column("text").is_valid().to_pylist()
            lists = part.column("again__").to_pylist()
            out, counts = [], []
            for ok, text, own in zip(valid, slice_texts, lists, strict=True):
                known = {(r["kind"], r["canon"]): r["attempt"] for r in own or ()}
                new, count = replaced(text, key, known, cache)
                out.append(new if ok else None)
                counts.append(count)
            columns = list(part.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int32())], names=[*part.schema.names[:-1], "n_entities__"]
            )

    schema = StructType(
        [StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    )
    new = joined.mapInArrow(run, schema.add("n_entities__", IntegerType()))
    return new.withColumnRenamed("n_entities__", counted) if counted else new.drop("n_entities__")
