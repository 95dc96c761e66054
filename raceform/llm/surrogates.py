"""Personal data replaced by keyed surrogates of the same kind, gender, script and format.

1. Entities (kind, normal form) are detected in every text and made distinct over the corpus.
2. Each gets a surrogate from a keyed hash: digits stay digits, letters letters, octets octets; a valid card number stays
   valid; a given name keeps gender and script. Two checks follow, by grouped minimum and join: a surrogate that
   two entities drew stays with the first, and one that is itself an entity of the corpus is given up. Losers draw again
   until none is left, so different entities stay different and none turns into another. A short format may have no value
   left that is no entity: later draws grow it, octets to any width, the others by a character for every fourth draw.
3. The same entity gets the same surrogate everywhere. Given names and surnames are entities of their own, so a full
   name and a title with the surname still refer to one person. Every mention is written in its own format.

Scale: entities are deduplicated per batch before they are shuffled, and a frequent one is one row of the map, to
which skewed partitions of mentions can be joined. Only texts with entities are stored and shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from raceform.llm.naming import unused
from raceform.session import materialize

# Titles by gender, given names by gender and script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "Госпожа"),
    "m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин", "Господин"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    "f": ("Mary", "Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Claire", "Carmen", "Lucia", "Susan", "Linda", "Karen", "Анна", "Мария", "Елена", "Ольга"),
    "m": ("John", "James", "Peter", "Michael", "David", "Thomas", "Robert", "Hans", "Jean", "Pierre", "Carlos", "Juan", "Paul", "Иван", "Пётр", "Сергей", "Алексей"),
}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "ra", "se", "ti", "vo"), "cyrillic": ("ба", "де", "ги", "ко", "ла", "ми", "но", "ра", "се", "ти", "ву", "за")}
GENDER_END = {("f", "latin"): "na", ("m", "latin"): "rd", ("n", "latin"): "l", ("f", "cyrillic"): "на", ("m", "cyrillic"): "р", ("n", "cyrillic"): "л"}
SURNAME_END = {"latin": "man", "cyrillic": "енко"}
KEY = b"raceform"
MAX_DRAWS = 64
# Draws that keep the length of the format.
EXACT_DRAWS = 8

WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+"
GENDER = {form: g for g, titles in TITLES.items() for t in titles for form in (t, t.upper())}
GIVEN_GENDER = {n: g for g, names in GIVEN.items() for n in names}
NUMBERS = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:([ -])\d{4})(?:\5\d{4}){2})(?!\d))"
    r"|(?P<phone>(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d))")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_/+-]{8,})")
NAME = re.compile(rf"\b(?:(?P<title>{'|'.join(sorted(GENDER, key=len, reverse=True))})\.? (?P<first>{WORD})(?: (?P<last>{WORD}))?|(?P<given>{'|'.join(GIVEN_GENDER)}) (?P<sur>{WORD}))")
MARKS = re.compile(r"[\d@]")
NAME_STARTS = (*(t for t in GENDER), *(n for n in GIVEN_GENDER))

Mention = tuple[int, int, str, str]  # start, end, kind, normal form


def script(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def _name_parts(m: re.Match) -> Iterator[tuple[str, str]]:
    """(group, kind) of a matched name; the kind holds gender and script."""
    if m["given"]:
        yield "given", f"given-{GIVEN_GENDER[m['given']]}"
        yield "sur", "surname"
    elif m["last"]:
        yield "first", f"given-{GIVEN_GENDER.get(m['first']) or GENDER[m['title']]}"
        yield "last", "surname"
    else:
        yield "first", "surname"


def mentions(text: str) -> list[Mention]:
    """Entities of a text in order, none over another."""
    found: list[Mention] = []
    if MARKS.search(text):
        for m in NUMBERS.finditer(text):
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            normal = value.lower() if kind == "email" else value if kind in ("ip", "ssn") else re.sub(r"\D", "", value)
            found.append((*m.span(m.lastgroup), kind, normal))
    if "=" in text or ":" in text:
        found += [(*m.span("secret"), "secret", m["secret"]) for m in SECRET.finditer(text)]
    if any(n in text for n in NAME_STARTS):
        for m in NAME.finditer(text):
            found += [(*m.span(group), f"{kind}-{script(m[group])}", m[group].casefold()) for group, kind in _name_parts(m)]
    out: list[Mention] = []
    for x in sorted(found):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _numbers(kind: str, normal: str, draw: int, key: bytes) -> Iterator[int]:
    block = 0
    while True:
        yield from blake2b(f"{kind}\0{normal}\0{draw}\0{block}".encode(), key=key).digest()
        block += 1


def luhn(digits: str) -> int:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10


def surrogate(kind: str, normal: str, draw: int, key: bytes = KEY) -> str:
    """The ``draw``-th surrogate of an entity, in normal form; longer from ``EXACT_DRAWS`` on, but for cards and social security numbers, whose formats have room."""
    numbers = _numbers(kind, normal, draw, key)
    longer = max(0, (draw - EXACT_DRAWS) // 4 + 1)
    if kind.startswith(("given", "surname")):
        *_, letters = kind.split("-")
        end = SURNAME_END[letters] if kind.startswith("surname") else GENDER_END[kind.split("-")[1], letters]
        return "".join(SYLLABLES[letters][next(numbers) % 12] for _ in range(3 + draw // 4)) + end
    if kind == "ip":
        spans = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        return ".".join(str(low + (next(numbers) * 256 + next(numbers)) % (high - low + 1)) for low, high in ((1, 255) if longer else spans[len(x)] for x in normal.split(".")))
    fixed = normal.rfind(".") if kind == "email" else len(normal)
    out = []
    hexadecimal = kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", normal)
    for i, c in enumerate(normal):
        n = next(numbers)
        if i > fixed or (kind in ("phone", "card") and i == 0) or not (c.isascii() and c.isalnum()):
            out.append(c)
        elif hexadecimal:
            out.append("0123456789abcdef"[n % 16] if normal == normal.lower() else "0123456789ABCDEF"[n % 16])
        elif c.isdigit():
            out.append(str(n % 10))
        else:
            out.append(chr((97 if c.islower() else 65) + n % 26))
    if kind == "card" and luhn(normal) == 0:
        out[-1] = next(d for d in "0123456789" if luhn("".join(out[:-1]) + d) == 0)
    if kind == "email":
        out = [chr(97 + next(numbers) % 26) for _ in range(longer)] + out
    elif kind == "phone" or hexadecimal:
        out += [str(next(numbers) % 10) for _ in range(longer)]
    elif kind == "secret":
        out += [chr(97 + next(numbers) % 26) for _ in range(longer)]
    return "".join(out)


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate in the format of a mention: its separators, its capitals; what a phone number or an address has more is put behind or before it."""
    if kind.startswith(("given", "surname")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    if kind in ("phone", "card"):
        digits = iter(new)
        return "".join([next(digits) if c.isdigit() else c for c in mention]) + "".join(digits)
    if kind == "email":
        more = len(new) - len(mention)
        return new[:more] + "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new[more:], strict=True))
    return new


ENTITIES = ArrayType(StructType([StructField("kind", StringType()), StructField("normal", StringType())]))


def _detect(names: list[str], held: str | None = None):
    """Rows with entities, and these as column ``held``; or, without such a name, the rows that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("normal", pa.string())]))
        for batch in batches:
            found = [sorted({m[2:] for m in mentions(t)}) if t else [] for t in batch.column("text").to_pylist()]
            chosen = pa.array([bool(f) == bool(held) for f in found], pa.bool_())
            entities = pa.array([[{"kind": k, "normal": n} for k, n in f] for f in found], kind)
            columns = [batch.column(n) for n in names] + ([entities] if held else [])
            yield pa.RecordBatch.from_arrays(columns, names=names + ([held] if held else [])).filter(chosen)

    return run


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, normals, draws = (batch.column(c).to_pylist() for c in ("kind", "normal", "draw"))
            new = [surrogate(*x, key) for x in zip(kinds, normals, draws, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("normal"), pa.array(new, pa.string())], names=["kind", "normal", "surrogate"])

    return run


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, normal, surrogate) for distinct entities (kind, normal), all surrogates different and none an entity."""
    entities = materialize(entities.select("kind", "normal").distinct(), "entities")
    open_, done = entities, None
    for number in range(MAX_DRAWS):
        drawn = open_.withColumn("draw", F.lit(number)).mapInArrow(_draw(key), "kind string, normal string, surrogate string")
        drawn = materialize(drawn, "drawn")
        own = drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        own = own.join(entities.select("kind", F.col("normal").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            own = own.join(done, ["kind", "surrogate"], "left_anti")
        own = materialize(own.select("kind", "normal", "surrogate"), "surrogates")
        done = own if done is None else done.unionByName(own)
        open_ = materialize(open_.join(own, ["kind", "normal"], "left_anti"), "redraw")
        if not open_.limit(1).count():
            return done
    raise RuntimeError("surrogates still collide")


def _rewrite(names: list[str], mapped: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            texts, counts = [], []
            for text, rows in zip(columns["text"].to_pylist(), columns[mapped].to_pylist(), strict=True):
                new, at, parts = {(r["kind"], r["normal"]): r["surrogate"] for r in rows}, 0, []
                found = mentions(text)
                for start, end, kind, normal in found:
                    parts += [text[at:start], render(text[start:end], kind, new[kind, normal])]
                    at = end
                texts.append("".join([*parts, text[at:]]))
                counts.append(len(found))
            columns |= {"replaced": pa.array(texts, pa.string()), "n_mentions": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``replaced`` (text with surrogates) and ``n_mentions``.

    Null texts stay null with no mentions; texts without entities, also empty ones, are their own ``replaced``. Repeated rows
    get the same surrogates. An empty table gives an empty result. Extra columns pass through; those named like
    a result are replaced.
    """
    docs = docs.drop("replaced", "n_mentions")
    names = docs.columns
    entities, row, mapped = unused(docs, "entities", "row", "map")
    held = docs.mapInArrow(_detect(names, entities), StructType([*docs.schema.fields, StructField(entities, ENTITIES)]))
    held = materialize(held.withColumn(row, F.expr("uuid()")), "texts-with-entities")
    pairs = held.select(F.col(row).alias("row"), F.explode(entities).alias("e")).select("row", "e.kind", "e.normal")
    maps = pairs.join(assign(pairs, key), ["kind", "normal"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "normal", "surrogate")).alias(mapped))
    out = [*names, "replaced", "n_mentions"]
    fields = StructType([*docs.schema.fields, StructField("replaced", StringType())]).add("n_mentions", "long")
    changed = held.drop(entities).join(maps, row).drop(row).mapInArrow(_rewrite(out, mapped), fields)
    same = docs.mapInArrow(_detect(names), docs.schema).withColumns({"replaced": F.col("text"), "n_mentions": F.lit(0).cast("bigint")})
    return changed.unionByName(same)
