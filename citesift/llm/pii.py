"""Personal data replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, phone numbers, IPv4 addresses, card numbers, IBANs,
credentials (``password=...`` and the like, access key ids) and names behind an
honorific, with every other mention of their parts in the same document. A
surrogate is drawn from a keyed digest of type and entity, so the same entity gets
the same one everywhere: digits stay digits, letters keep case and script,
separators and length stay, card numbers keep a valid check digit, and given names
are taken from lists by gender and script. A name is replaced part by part, so that
one person keeps one surrogate however much of the name is written.

Different entities must not share a surrogate, and none may be an entity of the
corpus. The distinct entities are checked in Spark: of those that collide all but
the smallest draw again, until none does; from ``GROW_AFTER`` attempts on a
character is added, so small domains end too, and from the first one for given
names, whose lists are short. Initials are letters in another order: too few to be
kept from all initials of the corpus. The result is a table of entities and
surrogates that is joined to the entities of each document; only rows that may
hold personal data are shuffled with their text.

Null texts stay null and empty texts empty, with no entities. Rows are told apart
by id and text, null ids too; repeated rows are replaced alike and each stay; other
columns pass through, but ``n_entities`` is replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import ROW_KEY, packed, unpacked
from citesift.session import durable

GROW_AFTER = 6

_HONORIFICS = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Senora", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Senor", "Господин"),
}
_GENDER = {h.lower(): g for g, hs in _HONORIFICS.items() for h in hs}
_TITLES = "|".join(h for hs in _HONORIFICS.values() for h in hs)

# Where a text matches none of these it holds nothing that PATTERNS find. Java's \d is
# ASCII only and its \p{Nd} lacks the digits of three scripts that Python's \d knows; a
# word before or behind is looked for less strictly than in PATTERNS, never more so.
_DIGIT = r"[\p{Nd}\x{16AC0}-\x{16AC9}\x{11F50}-\x{11F59}\x{1E4F0}-\x{1E4F9}]"
MAYBE = (
    rf"@|{_DIGIT}{{3}}|{_DIGIT}[ .()-]+{_DIGIT}|AKIA|[A-Z]{{2}}{_DIGIT}{{2}} ?[A-Z0-9]{{4}}"
    rf"|(?iu)password|passwd|pwd|secret|token|api[_-]?key|(?<![a-z])(?:{_TITLES})\.? "
)

# Words that end a name, and small ones inside a name.
_NO_NAME = "und|and|et|y|the"
_PARTICLES = "von|van|der|den|de|del|della|la|di|da|du|dos"

# Longest claims first: a span that is taken is not looked at again.
PATTERNS = (
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})")),
    ("key", re.compile(r"\b(AKIA[0-9A-Z]{12,})\b")),
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ip", re.compile(r"(?<![\d.])((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d.]*\d)")),
    ("card", re.compile(r"(?<![\d-])(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})(?!\d)")),
    ("phone", re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    # Only the honorific; _mention reads the name behind it.
    ("name", re.compile(rf"\b(?i:({_TITLES}))\.? +(?:(?i:prof|dr)\.? +)*(?!(?i:{_NO_NAME})\b)(?=[^\W\d_])")),
)

# A name: its first word, then words that start with no small letter, behind a space, a hyphen,
# an apostrophe or the point of an initial.
_FIRST = re.compile(rf"(?:(?:{_PARTICLES}) +)*([^\W\d_]+)")
_WORD = re.compile(r"([^\W\d_]+)")
_NEXT = re.compile(rf"(\. *| +|[-'’])(?:(?:{_PARTICLES}) +)*(?!(?i:{_NO_NAME}|{_TITLES})\b)([^\W\d_]+)")

# Common given names by script and gender, and family names by script.
GIVEN = {
    ("LATIN", "f"): ("Anna", "Clara", "Elena", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sofia"),
    ("LATIN", "m"): ("Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul"),
    ("CYRILLIC", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана"),
    ("CYRILLIC", "m"): ("Антон", "Борис", "Иван", "Игорь", "Михаил", "Олег", "Павел", "Сергей"),
}


def normal(kind: str, entity: str) -> str:
    """What counts as the same entity: case and separators aside where they carry no meaning."""
    if kind in ("card", "phone", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", entity)
    return entity.casefold() if kind in ("email", "name", "given", "initial") else entity


def _gender(title: str) -> str:
    # (?i) also takes the long s and the two Turkish letters i.
    return _GENDER[title.lower().translate({0x17F: "s", 0x131: "i", 0x307: None})]


def _mention(text: str, at: int) -> list[tuple[int, int]]:
    """Where the parts of the name are that starts at ``at``."""
    m = _FIRST.match(text, at)
    if m[1][0].islower():
        m = _WORD.match(text, at)
    parts = [m.span(1)]
    while not text[parts[0][0]].islower() and (m := _NEXT.match(text, m.end())):
        initial = parts[-1][1] - parts[-1][0] == 1
        if m[2][0].islower() or m[1].startswith(".") and not initial:
            break
        parts.append(m.span(2))
    return parts


def _named(text: str, taken: bytearray) -> list[list[tuple[int, int, str, str]]]:
    """The mentions of names behind an honorific, and all others of their parts; each as its parts."""
    behind = []
    kinds: dict[tuple[str, str], str] = {}
    for m in PATTERNS[-1][1].finditer(text):
        parts = _mention(text, m.end())
        start, end = parts[0][0], parts[-1][1]
        if any(taken[start:end]):
            continue
        taken[start:end] = b"\1" * (end - start)
        gender = _gender(m[1])
        behind.append((gender, parts))
        long = [text[a:b].casefold() for a, b in parts if b - a > 1]
        for k, part in enumerate(long):
            given = k == 0 and len(long) > 1
            if given or (part, gender) not in kinds:
                kinds[part, gender] = ("given-" if given else "name-") + gender

    def shown(a: int, b: int, gender: str) -> tuple[int, int, str, str]:
        kind = "initial-" + gender if b - a == 1 else kinds[text[a:b].casefold(), gender]
        return a, b, kind, text[a:b]

    out = [[shown(a, b, gender) for a, b in parts] for gender, parts in behind]
    # A name in small letters could be any word, so it is not looked for elsewhere.
    forms = {}
    for gender, parts in behind:
        for word in (text[a:b] for a, b in parts if b - a > 1 and not text[a].islower()):
            for form in (word, word.upper(), word.capitalize()):
                forms.setdefault(form, (word, gender))
    if forms:
        ordered = sorted(forms, key=len, reverse=True)
        for m in re.finditer(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, ordered))})(?![^\W_])", text):
            a, b = m.span()
            if any(taken[a:b]):
                continue
            taken[a:b] = b"\1" * (b - a)
            word, gender = forms[m[0]]
            part = (a, b, kinds[word.casefold(), gender], m[0])
            if out and len(out) > len(behind) and text[out[-1][-1][1] : a] in (" ", "-"):
                out[-1].append(part)
            else:
                out.append([part])
    return out


def mentions(text: str | None) -> list[list[tuple[int, int, str, str]]]:
    """What a text holds, in order and without overlaps: ``start, end, kind, entity`` of the parts of each."""
    found: list[list[tuple[int, int, str, str]]] = []
    if not text:
        return found
    taken = bytearray(len(text))
    for kind, pattern in PATTERNS[:-1]:
        for m in pattern.finditer(text):
            group = m.lastindex or 0
            start, end = m.span(group)
            if any(taken[start:end]) or kind == "card" and not _luhn(m.group(group)):
                continue
            taken[start:end] = b"\1" * (end - start)
            found.append([(start, end, kind, m.group(group))])
    return sorted(found + _named(text, taken))


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, entity`` of what a text holds, in order and without overlaps; names are whole."""
    out = []
    for parts in mentions(text):
        start, end, kind = parts[0][0], parts[-1][1], parts[0][2]
        shown = "name-" + kind[-1] if kind.startswith(("name", "given", "initial")) else kind
        out.append((start, end, shown, text[start:end]))
    return out


def _digit_sum(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total


def _luhn(text: str) -> bool:
    return _digit_sum(re.sub(r"\D", "", text)) % 10 == 0


class _Stream:
    """Numbers from a keyed digest."""

    def __init__(self, key: bytes, seed: str):
        self.key, self.seed, self.turn, self.pool = key, seed, 0, []

    def below(self, n: int) -> int:
        if not self.pool:
            digest = hmac.new(self.key, f"{self.turn}|{self.seed}".encode(), hashlib.sha256).digest()
            self.pool = [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 32, 4)]
            self.turn += 1
        return self.pool.pop() % n


def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split(" ")[0]


_ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}


def _like(c: str, draw: _Stream) -> str:
    """A character of the same class, case and script."""
    if c.isdecimal():
        return str(draw.below(10))
    if not c.isalpha():
        return c
    letters = _ALPHABETS.get(_script(c), None)
    if letters is None:
        # Another script: a letter near by, if there is one.
        near = [chr(x) for x in range(ord(c) - 8, ord(c) + 9) if x > 0 and chr(x).isalpha() and _script(chr(x)) == _script(c)]
        return near[draw.below(len(near))]
    new = letters[draw.below(len(letters))]
    return new.upper() if c.isupper() else new


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """A replacement of the form of ``entity``; other attempts give other ones."""
    draw = _Stream(key, f"{kind}|{normal(kind.split('-')[0], entity)}|{attempt}")
    if kind.startswith("initial"):
        return _initial(key, kind, entity)
    if kind.startswith(("name", "given")):
        return _name(entity, kind, draw, attempt)
    more = "".join(str(draw.below(10)) for _ in range(max(0, attempt - GROW_AFTER)))
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        head, _, top = domain.rpartition(".")
        return "".join(_like(c, draw) for c in local) + more + "@" + "".join(_like(c, draw) for c in head) + "." + top
    if kind == "phone" and entity.startswith("+"):
        code = re.match(r"\+\d{1,3}(?=\D)|\+\d", entity).group()
        return code + "".join(_like(c, draw) for c in entity[len(code) :]) + more
    if kind == "iban":
        return entity[:2] + "".join(_like(c, draw) for c in entity[2:]) + more
    if kind == "key":
        return entity[:4] + "".join(_like(c, draw) for c in entity[4:]) + more
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity) + more
    new = "".join(_like(c, draw) for c in entity) + more
    if kind == "card":
        at = max(i for i, c in enumerate(new) if c.isdigit())
        digits = re.sub(r"\D", "", new[:at]) + "0" + re.sub(r"\D", "", new[at + 1 :])
        return new[:at] + str(-_digit_sum(digits) % 10) + new[at + 1 :]
    return new


def _name(entity: str, kind: str, draw: _Stream, attempt: int) -> str:
    """A part of a name: a given one of its gender and script if there is a list, and letters otherwise."""
    names = GIVEN.get((_script(entity[0]), kind[-1])) if kind.startswith("given") else None
    new = "".join(_like(c, draw) for c in entity) if names is None else names[draw.below(len(names))]
    more = attempt if names else max(0, attempt - GROW_AFTER)
    new += "".join(_like(entity[-1].lower(), draw) for _ in range(more))
    return new.upper() if entity.isupper() else new


def _initial(key: bytes, kind: str, entity: str) -> str:
    """The letter after this one in a keyed order of its alphabet, so that no two initials become one."""
    letters = _ALPHABETS.get(_script(entity), "")
    small = entity.lower()
    if small not in letters:
        return _like(entity, _Stream(key, f"{kind}|{small}"))
    ordered = sorted(letters, key=lambda c: hmac.new(key, f"{kind}|{c}".encode(), hashlib.sha256).digest())
    new = ordered[(ordered.index(small) + 1) % len(ordered)]
    return new.upper() if entity.isupper() else new


def _detected(rows: DataFrame) -> DataFrame:
    """``_id, _tk, start, end, kind, entity, first`` over ``rows (_id, _tk, text)``.

    A name is a row per part; ``first`` is 1 in one row of each entity and 0 in the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(2)):
                for parts in mentions(text.as_py()):
                    at.extend([k] * len(parts))
                    found.extend((*part, int(part is parts[0])) for part in parts)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
            columns += [pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_tk", "start", "end", "kind", "entity", "first"])

    return rows.mapInArrow(run, "_id long, _tk long, start int, end int, kind string, entity string, first int")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, attempt, surrogate`` over ``entities (kind, entity, attempt)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(3)))
            new = pa.array([surrogate(key, *r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=["kind", "entity", "attempt", "surrogate"])

    return entities.mapInArrow(run, "kind string, entity string, attempt int, surrogate string")


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, surrogate`` for distinct ``entities (kind, entity)``: no two share one, none is an entity.

    Written forms of one entity (other separators or case) may share digits of a
    surrogate, but each form has its own.
    """
    every = durable(entities.distinct(), "entities")
    initial = F.col("kind").startswith("initial")
    entities = every.filter(~initial)
    fixed = None
    pending = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = durable(_drawn(pending, key), "surrogates")
        taken = entities.select(F.col("entity").alias("surrogate"))
        if fixed is not None:
            taken = taken.unionAll(fixed.select("surrogate"))
        free = drawn.join(taken.distinct(), "surrogate", "left_anti")
        first = free.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("e"))
        won = first.select(F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity"), "surrogate")
        fixed = durable(won if fixed is None else fixed.unionAll(won), "surrogates")
        left = drawn.join(fixed, ["kind", "entity"], "left_anti")
        pending = durable(left.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "surrogates")
        if pending.isEmpty():
            return fixed.unionAll(_drawn(every.filter(initial).withColumn("attempt", F.lit(0)), key).drop("attempt"))


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``."""
    rows = packed(docs)
    may = F.coalesce(F.col("_row.text").rlike(MAYBE), F.lit(False))
    # Kept, as the filter over all texts costs more than all that follows.
    hits = durable(rows.filter(may), "maybe")
    found = durable(_detected(hits.select(*ROW_KEY, F.col("_row.text").alias("text")).distinct()), "detected")
    table = surrogates(found.select("kind", "entity"), key)
    edits = (
        found.join(table, ["kind", "entity"])
        .groupBy(*ROW_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "surrogate"))).alias("edits"), F.sum("first").alias("n"))
    )
    changed = hits.join(edits, ROW_KEY, "left").select("_row", "edits", "n", F.col("_row.text").alias("text"))
    same = rows.filter(~may).select("_row", F.lit(0).cast("long").alias("n"), F.col("_row.text").alias("new"))
    every = _edited(changed).select("_row", "n", "new").unionAll(same)
    count = F.col("n").cast("long")
    new = {"text": F.col("new"), "n_entities": count}
    out = unpacked(every, docs.columns, new)
    return out.select(*docs.columns, *(c for c in out.columns if c not in docs.columns))


def _edited(rows: DataFrame) -> DataFrame:
    """Fill ``n`` and add ``new``, the text with its edits, all in Catalyst."""
    # What stands between two edits, and then the edit; positions count from 0.
    rows = rows.withColumnRenamed("edits", "e")
    before = F.transform(
        "e",
        lambda x, i: F.concat(
            F.substring(
                F.col("text"),
                F.when(i == 0, 0).otherwise(F.get(F.col("e"), i - 1)["end"]) + 1,
                x["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("e"), i - 1)["end"]),
            ),
            x["surrogate"],
        ),
    )
    rest = F.expr("substring(text, element_at(e, -1).end + 1)")
    return rows.withColumns(
        {
            "n": F.coalesce("n", F.lit(0)),
            "new": F.when(F.col("e").isNull(), F.col("text")).otherwise(F.concat(F.array_join(before, ""), rest)),
        }
    )
