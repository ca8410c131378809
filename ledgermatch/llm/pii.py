"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed surrogates of the same type and form:
digits stay digits, separators and letter case stay, a valid card number or IBAN
stays valid, a private address stays private, a person's name keeps its gender and script.  The surrogate is a
function of key, type and the entity's canonical form, so one entity gets one
surrogate in the whole corpus, however it is written.  A name that follows a
title once is replaced in the whole text.  The gender of a given name is part
of its type: it is what the titles of the same text say.

Distinctness is checked over the corpus with joins: no two entities of a type
may share a surrogate and no surrogate may be an entity that occurs; all names
of persons count as one type here.  Of those
that collide the smallest keeps its surrogate; the others try their next one.
A document is rewritten by the function alone, plus the few entities in it that
had to try again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_rows, map_arrow, materialize, row_key, text_hash, with_text_columns

#: Tries after which a surrogate may be longer than its entity, so that small formats cannot run out.
LONGER_AFTER = 8

# Titles that precede a name, by gender, and names by gender and script.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н", "κύριος", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Signora", "госпожа", "г-жа", "κυρία", "κα"],
    "n": ["Dr", "Prof", "Doktor", "Docteur", "Doctor", "доктор"],
}
NAMES = {
    ("latin", "m"): ["Adrian", "Bruno", "Conrad", "Edgar", "Felix", "Gordon", "Hugo", "Ivan", "Julian", "Konrad", "Lukas", "Martin"],
    ("latin", "f"): ["Amelia", "Bianca", "Clara", "Diana", "Emilia", "Flora", "Greta", "Helena", "Irina", "Julia", "Laura", "Marta"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sascha", "Andrea", "Dominique", "Jessie", "Noa", "Charlie", "Sam", "Toni", "Luca"],
    ("latin", "s"): ["Berger", "Castel", "Dorner", "Ellison", "Ferrand", "Garner", "Holm", "Jansen", "Keller", "Lorenz", "Moreau", "Navarro"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура"],
    ("cyrillic", "s"): ["Белко", "Гордиенко", "Дорош", "Жук", "Климко", "Левченко"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας"],
    ("greek", "f"): ["Άννα", "Ελένη", "Κατερίνα", "Μαρία"],
    ("greek", "n"): ["Άλεξ", "Νίκη", "Φώτη"],
    ("greek", "s"): ["Βλάχος", "Γεωργίου", "Ιωάννου", "Κωστόπουλος"],
}
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "zo"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "ка", "ле", "ми", "но", "ру"],
    "greek": ["βα", "γε", "δι", "κο", "λα", "με", "νι", "πο", "ρα", "τε"],
}

_TITLE_NAMES = "|".join(regex.escape(t) for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
_GENDER = {t.casefold(): g for g, titles in TITLES.items() for t in titles}
_PERSON = regex.compile(
    rf"(?<!\w)(?P<title>(?i:{_TITLE_NAMES}))(?:\.?[ \xa0](?P<title>(?i:{_TITLE_NAMES})))*\.?[ \xa0](?P<name>\p{{Lu}}[\p{{L}}’']+(?:[ -]\p{{Lu}}[\p{{L}}’']+){{0,2}})"
)
_CAPITALISED = regex.compile(r"(?<!\w)\p{Lu}[\p{L}’']++(?!\w)")
_POSSESSIVE = regex.compile(r"[’'][sS]?\Z")
_EMAIL = regex.compile(r"(?<![\w.+-])[\w.+-]++@(?:[\w-]++\.)+\p{L}{2,}+")
# A quoted value ends at its closing quote, another at white space, less the punctuation at its end.
_SECRET = regex.compile(
    r"(?i:pass(?:word|wd)|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:(?P<quote>[\"'])(?P<value>(?:\\.|(?!(?P=quote))[^\\])*+)(?P=quote)|[\"']?(?P<value>\S++))",
    regex.DOTALL,
)
_PUNCTUATION = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "P")
SECRET_LEAST = 6
_NUMBERS = regex.compile(
    r"(?P<key>(?<![A-Za-z0-9])AKIA[A-Z0-9]{12,}+(?![A-Za-z0-9]))"
    r"|(?P<hex>(?<![A-Za-z0-9])(?=[a-fA-F]*+\d)[0-9a-fA-F]{32,}+(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv6>(?<![\w:.])(?=[\w:]*\d)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![\w:]))"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d))"
)

Entity = tuple[int, int, str, str]


def script_of(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def luhn(digits: str) -> int:
    """Luhn checksum modulo 10; 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10


def remainder(iban: str) -> int:
    """An IBAN as a number, modulo 97; 1 for a valid one."""
    moved = (iban[4:] + iban[:4]).upper()
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _is_card(digits: str) -> bool:
    """Sixteen digits like those of a card, with a slip perhaps; other lengths only with a valid checksum."""
    n, first = len(digits), digits[0]
    if n == 16:
        return first in "23456"
    return luhn(digits) == 0 and (first == "4" if n == 13 else 14 <= n <= 19 and first in "3456")


def _accepted(kind: str, raw: str) -> str | None:
    """The part of a match, from its start, that is an entity of its kind."""
    if kind == "iban":
        plain = raw.replace(" ", "")
        return raw if len(plain) >= 15 and (remainder(plain) == 1 or sum(c.isdigit() for c in plain) >= 10) else None
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(raw)
        except ValueError:
            return None
        return raw if raw.count(":") >= 3 else None
    if kind == "card":
        ends = [m.start() for m in regex.finditer(r"[ -]", raw)]
        return next((raw[:end] for end in [len(raw), *reversed(ends)] if _is_card("".join(c for c in raw[:end] if c.isdigit()))), None)
    return raw


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, stop) of numbers; what is refused is looked through again behind its first run."""
    at = 0
    while m := _NUMBERS.search(text, at):
        part = _accepted(m.lastgroup, m.group())
        if part is not None:
            yield m.lastgroup, m.start(), m.start() + len(part)
            at = m.start() + len(part)
        else:
            run = regex.compile(r"\w+[ -]?|.", regex.DOTALL).match(text, m.start())
            at = max(m.start() + 1, min(run.end(), m.end()))


def canonical(kind: str, raw: str) -> str:
    """One form for all spellings of an entity."""
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(raw))
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in raw if c.isdigit())
    if kind == "iban":
        return raw.replace(" ", "").casefold()
    return raw.casefold()


def _names(text: str) -> list[Entity]:
    """Words of names after a title, and every other capitalised mention of these words.

    The last of several words is a surname, and so is a single one that is not
    known as a given name only.  A given name after a neutral title has the
    gender known in this text for the whole name, else for the given name.
    """
    met = []
    for m in _PERSON.finditer(text):
        gender = next((g for t in m.captures("title") if (g := _GENDER[t.casefold()]) != "n"), "n")
        words = [(m.start("name") + w.start(), _POSSESSIVE.sub("", w.group())) for w in regex.finditer(r"[^ -]+", m["name"])]
        met.append((gender, [(at, w, w.casefold()) for at, w in words]))
    if not met:
        return []
    met_whole = [(gender, words) for gender, words in met if len(words) > 1]
    givens = {w[2] for _, words in met_whole for w in words[:-1]}
    givens_only = givens - {words[-1][2] for _, words in met_whole}
    genders: dict = {}
    for gender, words in sorted(met, key=lambda x: len(x[1]) == 1):
        if gender != "n":
            for _, _, given in words[:-1] or words:
                genders.setdefault((given, words[-1][2]), gender)
                genders.setdefault(given, gender)

    found: dict[int, Entity] = {}
    known: dict = {}
    for gender, words in met:
        surname = words[-1][2]
        for i, (at, word, canon) in enumerate(words):
            role = "s"
            if i < len(words) - 1 or len(words) == 1 and canon in givens_only:
                role = gender if gender != "n" else genders.get((canon, surname)) or genders.get(canon, "n")
            kind = f"name-{role}-{script_of(word)}"
            found[at] = (at, at + len(word), kind, canon)
            known.setdefault(canon, kind)
            known.setdefault((canon, surname), kind)

    mentions = list(_CAPITALISED.finditer(text))
    for m, after in zip(mentions, [*mentions[1:], None], strict=True):
        for at, word in _parts(m.start(), m.group()):
            canon = word.casefold()
            if canon in known and canon not in _GENDER:
                beside = after and after.start() == m.end() + 1 and _POSSESSIVE.sub("", after.group()).casefold()
                kind = known.get((canon, beside), known[canon])
                found.setdefault(at, (at, at + len(word), kind, canon))
                break
    return list(found.values())


def _parts(at: int, word: str) -> Iterator[tuple[int, str]]:
    """The word without a possessive ending, then what stands between its apostrophes."""
    yield at, _POSSESSIVE.sub("", word)
    if "'" in word or "’" in word:
        for m in regex.finditer(r"[^’']+", word):
            if m.group()[0].isupper():
                yield at + m.start(), m.group()


def detect(text: str | None) -> list[Entity]:
    """Non-overlapping (start, stop, kind, canonical) in order; of overlapping ones the first, then the longest."""
    if not text:
        return []
    found: list[Entity] = []

    def add(kind, start, stop):
        found.append((start, stop, kind, canonical(kind, text[start:stop])))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", *m.span())
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            start, stop = m.span("value")
            if m["quote"] is None:
                stop = start + len(m["value"].rstrip(_PUNCTUATION))
            if stop - start >= SECRET_LEAST:
                add("secret", start, stop)
    if regex.search(r"\d", text):
        for kind, start, stop in _numbers(text):
            add("secret" if kind in ("key", "hex") else kind, start, stop)
    found += _names(text)
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[Entity] = []
    for e in found:
        if out and out[-1][0] < e[0] < out[-1][1] < e[1] and out[-1][2] == "secret":
            # A number with blanks that begins inside an unquoted value: both are replaced.
            out[-1] = (out[-1][0], e[0], "secret", canonical("secret", text[out[-1][0] : e[0]]))
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class _Stream:
    """Keyed numbers for one entity and try."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{attempt}\0{canon}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.pool, self.count = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.count += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest(), "big")
        self.pool, r = divmod(self.pool, n)
        return r


def _like(c: str, s: _Stream, hexadecimal: bool) -> str:
    if c.isdecimal():
        return str(s.below(10))
    if hexadecimal and c in "abcdef":
        return "abcdef"[s.below(6)]
    if c.isalpha():
        return chr(97 + s.below(26))
    return c


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the entity's surrogate at this try."""
    s = _Stream(key, kind, canon, attempt)
    longer = max(0, attempt - LONGER_AFTER + 1)
    if kind.startswith("name-"):
        _, role, script = kind.split("-")
        names = NAMES[(script, role)]
        name = names[s.below(len(names))]
        if attempt:
            parts = SYLLABLES[script]
            name = "".join(parts[s.below(len(parts))] for _ in range(2 + s.below(2) + longer)) + name
        return name.casefold()
    if kind == "ip":
        return _like_address(canon, s)
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(canon).exploded.split(":")
        # The first group says what kind of address it is; that of public ones is drawn too.
        head = f"{0x2600 + s.below(0x200):x}" if groups[0][0] in "23" else groups[0]
        return str(ipaddress.IPv6Address(":".join([head, *(f"{1 + s.below(0xFFFF):x}" for _ in groups[1:])])))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(_like(c, s, False) for c in local + "x" * longer) + "@" + "".join(_like(c, s, False) for c in host) + "." + top
    if kind == "iban":
        body = "".join(_like(c, s, False) for c in canon[4:] + "0" * longer)
        valid = 98 - remainder(canon[:2] + "00" + body)  # 2 to 98
        return f"{canon[:2]}{valid if remainder(canon) == 1 else (valid + 1 + s.below(90)) % 97 + 2:02}{body}"
    if kind == "secret":
        fixed = 4 if canon.startswith("akia") else 0
        hexadecimal = all(c in "0123456789abcdef" for c in canon)
        return canon[:fixed] + "".join(_like(c, s, hexadecimal) for c in canon[fixed:] + "0" * longer)
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in range(len(canon) - 2 + longer))
        valid = next(d for d in "0123456789" if luhn(body + d) == 0)
        return body + (valid if luhn(canon) == 0 else str((int(valid) + 1 + s.below(9)) % 10))
    # Phone numbers keep their first digit, which is a country's or an area's.
    return canon[:1] + "".join(str(s.below(10)) for _ in range(len(canon) - 1 + longer)) if kind == "phone" else "".join(
        str(s.below(10)) for _ in range(len(canon) + longer)
    )


def render(kind: str, raw: str, canon_surrogate: str) -> str:
    """The surrogate in the form of the occurrence: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left, out = list(canon_surrogate), []
        for c in raw:
            out.append(left.pop(0) if c.isalnum() and left else c)
        return _case(raw, "".join(out + left))
    return _case(raw, canon_surrogate)


def _case(raw: str, text: str) -> str:
    letters = [c for c in raw if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return text.upper()
    if len(raw) == len(text):
        return "".join(t.upper() if r.isupper() else t for r, t in zip(raw, text, strict=True))
    return text[:1].upper() + text[1:] if raw[:1].isupper() else text


#: First numbers of addresses that are not public, and how many numbers follow freely.
_KEPT_ADDRESSES = (("10",), ("127",), ("192", "168"), ("169", "254"), ("0",))


def _like_address(canon: str, s: _Stream) -> str:
    """Another IPv4 address of the same kind: private, loopback and link-local ranges are kept, others avoid them."""
    parts = tuple(canon.split("."))
    kept = next((p for p in _KEPT_ADDRESSES if parts[: len(p)] == p), None)
    if kept is None and parts[0] == "172" and 16 <= int(parts[1]) < 32:
        kept = ("172", str(16 + s.below(16)))
    if kept is not None:
        return ".".join([*kept, *(str(1 + s.below(254)) for _ in range(4 - len(kept)))])
    first = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
    return ".".join([str(first[s.below(len(first))]), *(str(1 + s.below(254)) for _ in range(3))])


@lru_cache(maxsize=1 << 16)
def _first_try(key: bytes, kind: str, canon: str) -> str:
    return surrogate(key, kind, canon)


def replace_entities(text: str | None, key: bytes, others: dict[tuple[str, str], str]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they are; ``others`` holds the surrogates of later tries."""
    parts, spans, at, shift = [], [], 0, 0
    for start, stop, kind, canon in detect(text):
        chosen = others.get((kind, canon)) or _first_try(key, kind, canon)
        new = render(kind, text[start:stop], chosen)
        parts += [text[at:start], new]
        spans.append({"kind": kind, "start": start + shift, "stop": start + shift + len(new)})
        shift += len(new) - (stop - start)
        at = stop
    return (text if not spans else "".join(parts) + text[at:]), spans


# -- corpus -----------------------------------------------------------------


def with_entities(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Append ``entities``: the distinct (kind, canon) of the whole text."""
    field = T.StructField("entities", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())])))

    def run(texts):
        return [[[{"kind": k, "canon": c} for k, c in dict.fromkeys((e[2], e[3]) for e in detect(t))] for t in texts]]

    return with_text_columns(docs, text_col, [field], run, keep)


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate, attempt) of distinct ``entities`` (kind, canon), free of collisions."""

    def run(batches):
        for b in batches:
            kinds, canons, tries = (b.column(c).to_pylist() for c in ("kind", "canon", "attempt"))
            made = [surrogate(key, k, c, a) for k, c, a in zip(kinds, canons, tries, strict=True)]
            names = ["kind", "canon", "attempt"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(made, pa.string())], names=[*names, "surrogate"])

    schema = "kind string, canon string, attempt int, surrogate string"
    # Names share one space: a given name must not become what is another person's surname.
    space = F.when(F.col("kind").startswith("name-"), "name").otherwise(F.col("kind")).alias("space")
    pending = entities.select("kind", "canon", F.lit(0).alias("attempt"))
    used = entities.select(space, F.col("canon").alias("surrogate")).distinct()
    done = None
    while True:
        tried = materialize(map_arrow(pending, run, schema).select("*", space), "pii-tried")
        free = tried.join(used, ["space", "surrogate"], "left_anti")
        owners = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("owner"))
        owners = owners.select("space", "surrogate", "owner.*")
        kept = materialize(free.join(owners, ["space", "surrogate", "kind", "canon"], "left_semi").select(*tried.columns), "pii-kept")
        done = kept if done is None else done.unionByName(kept)
        used = used.unionByName(kept.select("space", "surrogate"))
        left = tried.join(kept, ["kind", "canon"], "left_anti")
        pending = materialize(left.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pii-left")
        if pending.isEmpty():
            return done


def surrogate_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity of the text replaced, and ``spans`` (kind, start, stop) of the surrogates.

    NULL and empty texts stay as they are, with no spans.  Repeated rows get
    equal texts.  All columns are carried; one named ``spans`` is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != "spans"])
    narrow = docs.select(F.col(text_col).alias("body"), row_key(id_col).alias("_key"), text_hash(text_col).alias("_hash"))
    found = with_entities(narrow, "body", ["_key", "_hash"]).filter("size(entities) > 0")
    found = materialize(found.select("_key", "_hash", F.inline("entities")), "pii-occurrences")
    assigned = assign_surrogates(materialize(found.distinct().select("kind", "canon").distinct(), "pii-entities"), key)
    later = assigned.filter("attempt > 0").select("kind", "canon", "surrogate")

    # Surrogates of later tries go along with the documents that need them: none for most.
    per_doc = found.join(later, ["kind", "canon"]).groupBy("_key", "_hash").agg(F.collect_set(F.struct("kind", "canon", "surrogate")).alias("_others"))
    per_doc = materialize(per_doc, "pii-exceptions")
    rows = keyed_rows(docs, id_col, text_col)
    if per_doc.isEmpty():
        rows = rows.withColumn("_others", F.lit(None).cast(per_doc.schema["_others"].dataType))
    else:
        rows = rows.join(per_doc, ["_key", "_hash"], "left")
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)] + [T.StructField("spans", span)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field("spans").type
        for b in batches:
            texts, spans = [], []
            for text, others in zip(b.column(names[place]).to_pylist(), b.column("_others").to_pylist(), strict=True):
                new, where = replace_entities(text, key, {(o["kind"], o["canon"]): o["surrogate"] for o in others or ()})
                texts.append(new)
                spans.append(where)
            cols = [pa.array(texts, pa.string()) if n == names[place] else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], names=[*names, "spans"])

    return map_arrow(rows.select(*names, "_others"), run, schema).toDF(*docs.columns, "spans")
