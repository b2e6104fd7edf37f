"""PII: replaces personal data by surrogates of the same type, script, gender and format.

A surrogate is a keyed permutation of the entity's canonical form, so distinctness needs no shared state: equal entities get the
same surrogate in every document and task (coreference), different ones never the same. Digits become digits and letters letters
of their script, class (vowel or consonant, where listed) and case, in any script; marks stay. Given names go to given names of the same gender
and script. The permutation steps a keyed number of places along a cycle of all values of the format, so none stays as it was, and it steps on
until the value is valid where the original was (card checksum, address range, IBAN check).

Persons are found by a title before (or, in East Asian scripts, behind) a name in any script, by a listed given name before a capitalised word,
and by phrases that announce a name. A name that nothing of the kind tells stays: there is no model of names here.

Each row is rewritten for itself in one pass over whole texts, with nothing shuffled; checked() adds the collision check, one shuffle of hashed entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small

# Titles with the gender they tell, given names by gender and script, phrases before a name, family names and titles behind names of East Asian scripts.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Señorita", "Signora", "Κυρία", "госпожа", "г-жа", "السيدة"),
          "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Don", "Signor", "Κύριος", "господин", "г-н", "السيد"), "": ("Dr", "Prof", "Professor", "Doctor", "Rev")}
GIVEN = {
    ("f", "latin"): ("Alice", "Amy", "Ana", "Angela", "Anna", "Barbara", "Beatriz", "Camille", "Carmen", "Carol", "Chloé", "Claire", "Claudia", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Hannah", "Heike", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Juana", "Julia", "Julie", "Karen", "Laura", "Léa", "Linda", "Lucia", "Manon", "Maria", "Marie", "Marta", "Mary", "Monika", "Nancy", "Olivia", "Patricia", "Petra", "Pilar", "Rosa", "Ruth", "Sabine", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula"),
    ("m", "latin"): ("Alan", "Albert", "Alejandro", "Andreas", "Andrew", "Antoine", "Antonio", "Benjamin", "Bernd", "Brian", "Carlos", "Charles", "Christian", "Daniel", "David", "Diego", "Edward", "Fernando", "François", "Frank", "George", "Hans", "Henri", "Jack", "Jacques", "James", "Javier", "Jean", "John", "Jorge", "José", "Juan", "Jürgen", "Karl", "Kevin", "Klaus", "Louis", "Luis", "Manuel", "Mark", "Matthew", "Michael", "Miguel", "Nicolas", "Oliver", "Pablo", "Paul", "Pedro", "Peter", "Pierre", "Ralf", "Richard", "Robert", "Stefan", "Steven", "Thomas", "Walter", "William", "Xavier"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ("m", "cyrillic"): ("Алексей", "Андрей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
}
CUES = ("my name is", "his name is", "her name is", "Name:", "name:", "signed,", "Signed,", "Regards,", "regards,", "Sincerely,", "sincerely,", "heiße", "heißt", "m'appelle", "s'appelle", "me llamo", "se llama", "зовут")
FAMILY_HAN, BEHIND_HAN, BEHIND_KANA, BEHIND_HANGUL = "王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭", ("先生", "女士", "小姐"), ("さん", "様", "氏"), ("씨", "님")
#: Sets of letters within which letters are replaced: by script and class. Fixed values.
LETTERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèùâêîôûäöüëï", "ñçß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
DIGITS = "0123456789"
SET_OF = {c: s for s in (DIGITS, *LETTERS) for c in s}
NAME_OF = {n: (g, i) for g, names in GIVEN.items() for i, n in enumerate(names)}
TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NUMBERS = re.compile(r"[+(]?\d[\d().\- ]{5,}\d")
IPV4 = re.compile(rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)", re.A)
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A)
ACCOUNT = re.compile(r"(?<![\d.+])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?!\d)", re.A)
PHONE = re.compile(r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<!\d)\+\d{8,15}(?!\d)", re.A)
EMAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
COMMON = regex.compile(r"\p{Script=Common}")
CAPITAL, TAIL = r"[\p{Lu}\p{Lt}]", r"[\p{L}\p{M}\p{N}'’-]"
#: After a title a name of any script; else capitalised words.
PERSON = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:({'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\.?\s+([\p{{Lu}}\p{{Lt}}\p{{Lo}}]{TAIL}*)|({CAPITAL}{TAIL}*))((?:[ \xa0]{CAPITAL}{TAIL}*){{0,2}})")
CUED = regex.compile(rf"(?<![\p{{L}}])(?:{'|'.join(map(re.escape, CUES))})\s+({CAPITAL}{TAIL}*(?:[ \xa0]{CAPITAL}{TAIL}*){{0,2}})")
BEHIND = regex.compile(rf"([{FAMILY_HAN}]\p{{Han}}{{1,2}})(?={'|'.join(BEHIND_HAN)})|((?<!\p{{Han}})\p{{Han}}{{2,4}})(?={'|'.join(BEHIND_KANA)})|((?<!\p{{Hangul}})\p{{Hangul}}{{2,4}})(?= ?(?:{'|'.join(BEHIND_HANGUL)}))")
MENTIONS = (*(t for ts in TITLES.values() for t in ts), *(x for n in NAME_OF for x in (n, n.upper())))


@lru_cache(maxsize=100_000)
def letters_like(c: str) -> str:
    """The set within which a character is replaced: listed, or the letters or digits of its script, category and part of the code table; itself,
    if it's neither or alone there. A script's lower-case letters without a capital of their own make one set; letters that Unicode gives to
    no one script (Common, such as the micro sign) are replaced among themselves."""
    if c in SET_OF:
        return SET_OF[c]
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return c
    script = script_of(c)
    if kind == "Ll" and (script == "Common" or not paired(c)):
        own = unpaired(script)
        return own if c in own else c
    for width in (7, 12):
        first = ord(c) >> width << width
        own = [x for x in map(chr, range(first, first + (1 << width))) if unicodedata.category(x) == kind and script_of(x) == script and unicodedata.normalize("NFC", x) == x and x not in SET_OF and (kind != "Ll" or paired(x))]
        if c in own and len(own) > 1:
            return "".join(own)
    other = chr(ord(c) ^ 1)
    return "".join(sorted((c, other))) if unicodedata.category(other) == kind and script_of(other) == script else c


def script_of(c: str) -> str:
    """Common by its Unicode property, else the word that the names of a script's characters begin with."""
    return "Common" if COMMON.match(c) else unicodedata.name(c, "").split(" ")[0]


def paired(c: str) -> bool:
    return len(c.upper()) == 1 and c.upper().lower() == c


@lru_cache(maxsize=256)
def unpaired(script: str) -> str:
    return "".join(x for x in map(chr, range(0x80, 0x10000)) if unicodedata.category(x) == "Ll" and (script == "Common" or not paired(x)) and x not in SET_OF and unicodedata.normalize("NFC", x) == x and script_of(x) == script)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Key:
    """Keyed permutations."""

    def __init__(self, secret: bytes):
        self.secret = secret
        self.cached = lru_cache(maxsize=100_000)(self.surrogate)

    def number(self, x: int, n: int, tweak: str) -> int:
        """A permutation of range(n) without fixed points, if n > 1: a keyed order of the range, one step along it."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        tag = tweak.encode()

        def round_(i: int, v: int) -> int:
            return int.from_bytes(blake2b(i.to_bytes(2) + v.to_bytes((half + 7) // 8) + tag, key=self.secret[:64], digest_size=(half + 7) // 8).digest()) & mask

        def forth(v: int) -> int:
            while True:
                left, right = v >> half, v & mask
                for i in range(6):
                    left, right = right, left ^ round_(i, right)
                v = left << half | right
                if v < n:
                    return v

        def back(v: int) -> int:
            while True:
                left, right = v >> half, v & mask
                for i in reversed(range(6)):
                    left, right = right ^ round_(i, left), left
                v = left << half | right
                if v < n:
                    return v

        return back((forth(x) + 1) % n)

    def text(self, s: str, tweak: str, ok: Callable[[str], bool] | None = None) -> str:
        """Replaces each lower-case letter and digit within its set; ok is a property of s that the result must have too. Long texts,
        which only addresses and names have, go in pieces: a round makes 64 bytes at most."""
        if len(s) > 80:
            return "".join(self.text(s[i : i + 80], tweak) for i in range(0, len(s), 80))
        sets = [letters_like(c) for c in s]
        n = 1
        for x in sets:
            n *= len(x)
        shape = "".join(x[0] for x in sets) + tweak
        value = 0
        for c, x in zip(s, sets, strict=True):
            value = value * len(x) + x.index(c)
        while True:
            value = self.number(value, n, shape)
            out, rest = [], value
            for x in reversed(sets):
                rest, i = divmod(rest, len(x))
                out.append(x[i])
            made = "".join(reversed(out))
            if ok is None or ok(made):
                return made

    def surrogate(self, kind: str, canonical: str) -> str:
        """Of a canonical form; see find()."""
        if kind == "email":
            local, domain = canonical.split("@")
            *labels, top = domain.split(".")
            return self.text(local, "local") + "@" + ".".join([*(self.text(x, "label") for x in labels), top])
        if kind == "ipv4":
            a, *rest = canonical.split(".")
            value = 0
            for x in rest:
                value = value * 256 + int(x)
            sort = self.group(int(a))
            size = len(sort) << 24
            value = self.number((sort.index(int(a)) << 24) + value, size, f"ipv4{sort[0]}")
            return ".".join(map(str, (sort[value >> 24], value >> 16 & 255, value >> 8 & 255, value & 255)))
        if kind == "account":
            sound = luhn(canonical)
            return self.text(canonical, "account", lambda s: luhn(s) == sound)
        if kind == "iban":
            sound = mod97(canonical) == 1
            if not sound:
                return canonical[:2] + self.text(canonical[2:].lower(), "iban", lambda s: mod97(canonical[:2] + s.upper()) != 1).upper()
            body = self.text(canonical[4:].lower(), canonical[:2]).upper()
            return f"{canonical[:2]}{98 - mod97(canonical[:2] + '00' + body):02d}{body}"
        if kind == "phone":
            head = len(canonical) - min(10, len(canonical) - 1) if canonical[0] == "+" else 0
            return canonical[:head] + self.text(canonical[head:], f"phone{head}")
        if kind == "person":
            gender, *parts = canonical.split(" ")
            out = []
            for i, p in enumerate(parts):
                group = NAME_OF.get(p) or p.isupper() and NAME_OF.get(p.capitalize())
                if group:
                    names = GIVEN[group[0]]
                    made = names[self.number(group[1], len(names), "".join(group[0]))]
                    out.append(made.upper() if p.isupper() else made)
                else:
                    out.append(recased(p, self.text(lowered(p), "name", lambda s: s.capitalize() not in NAME_OF)))
            return " ".join(out)
        return self.text(canonical, kind)

    @staticmethod
    def group(a: int) -> list[int]:
        """First octets of the same sort of address: private or special ones alone, others together."""
        special = [0, 10, 127, 169, 172, 192]
        return [a] if a in special else [x for x in range(1, 224) if x not in special] if a < 224 else list(range(224, 256))


def lowered(s: str) -> str:
    """Lower case, character by character: none becomes two."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def recased(like: str, s: str) -> str:
    return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(like, s, strict=True))


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of entities, leftmost first, not overlapping; kinds in the order below win ties."""
    found: list[tuple[int, int, int, str, str]] = []
    if "@" in text:
        at, last = text.find("@"), 0
        while at >= 0:  # from each @ back to where its local part begins, or the last address ends, so that the text is walked once
            begin = at
            while begin > last and text[begin - 1] in LOCAL:
                begin -= 1
            while begin < at and text[begin] == ".":
                begin += 1
            own = EMAIL.match(text, begin)
            if own:
                found.append((own.start(), own.end(), 0, "email", own.group().lower()))
                last = own.end()
            at = text.find("@", max(at + 1, own.end() if own else 0))
    for run in NUMBERS.finditer(text):
        a, b = max(0, run.start() - 1), min(len(text), run.end() + 1)
        for order, (kind, pattern) in enumerate((("ssn", SSN), ("ipv4", IPV4), ("account", ACCOUNT), ("phone", PHONE)), 1):
            for m in pattern.finditer(text, a, b):
                keep = re.sub(r"[^\d+]", "", m.group()) if kind != "ipv4" else ".".join(str(int(x)) for x in m.group().split("."))
                found.append((m.start(), m.end(), order, kind, keep))
    for m in IBAN.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 8:
            found.append((m.start(), m.end(), 5, "iban", m.group().replace(" ", "")))
    if any(t in text for t in MENTIONS):
        m = PERSON.search(text)
        while m:
            title, after_title, word, more = m.groups()
            name = after_title or word
            given = NAME_OF.get(name) or NAME_OF.get(name.capitalize()) if name.isupper() or name in NAME_OF else None
            begin = m.start(2) if after_title else m.start(3)
            parts = [name, *more.split()]
            cut = next((i for i, p in enumerate(parts) if i and p in TITLE_OF), len(parts))  # a title begins the next name
            end = begin + len(name) if cut == 1 else m.start(4) + len(more) if cut == len(parts) else text.index(parts[cut], begin + len(name)) - 1
            if name not in TITLE_OF and (title or given and cut > 1):
                found.append((begin, end, 6, "person", " ".join([given[0][0] if given else TITLE_OF.get(title, ""), *parts[:cut]])))
                after = end
            else:
                after = begin + (0 if title and name in TITLE_OF else len(name))  # a word that isn't taken may stand before a name
            m = PERSON.search(text, after)
    if any(c in text for c in CUES):
        found += [(m.start(1), m.end(1), 7, "person", " ".join(["", *m[1].split()])) for m in CUED.finditer(text)]
    if not text.isascii():
        found += [(m.start(), m.end(), 8, "person", f" {m.group()}") for m in BEHIND.finditer(text)]
    out, last = [], -1
    for start, end, _, kind, canonical in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
        if start >= last:
            out.append((start, end, kind, canonical))
            last = end
    return out


def dressed(original: str, kind: str, canonical: str, made: str) -> str:
    """The surrogate of the canonical form in the format of the original."""
    if kind == "email":
        return recased(original, made)
    if kind == "person":
        parts = iter(made.split(" "))
        return "".join(x if x.isspace() else next(parts) for x in re.split(r"(\s)", original))
    if kind == "ipv4":
        return made
    symbols = iter(made)
    wanted = "0123456789+" if kind != "iban" else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "".join(next(symbols) if c in wanted else c for c in original)


def _replace(secret: bytes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = Key(secret)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, lists = [], []
            for t in batch.column(0).to_pylist():
                out, own, last = [], [], 0
                for start, end, what, canonical in find(t or ""):
                    new = dressed(t[start:end], what, canonical, key.cached(what, canonical))
                    out += [t[last:start], new]
                    own.append({"start": start, "end": end, "kind": what, "original": canonical, "surrogate": new})
                    last = end
                texts.append(t if not own else "".join(out) + t[last:])
                lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lists, kind), *batch.columns[1:]], names)
    return run


def replace_pii(docs: DataFrame, secret: bytes, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and entities array<struct<start, end, kind, original, surrogate>> (places in the original
    text, code points, end exclusive; original is the canonical form).

    Null stays null and an empty text empty, both without entities. Each row is treated for itself: repeated rows come out alike, null ids
    and other columns pass through; a column named entities is replaced. The secret decides the surrogates; keep it apart.
    """
    docs = docs.drop("entities")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(text_col).cast("string").alias("_t"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)])
    fields = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    kind = "array<struct<start: long, end: long, kind: string, original: string, surrogate: string>>"
    names = ["_t", "_e", *[f"_{i}" for i in range(len(rest))]]
    out = rows.mapInArrow(_replace(secret, names), f"_t string, _e {kind}" + (", " + fields if rest else ""))
    back = dict(zip(rest, names[2:], strict=True)) | {text_col: "_t"}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns], F.col("_e").alias("entities"))


def told_apart(replaced: DataFrame, *keep: str) -> DataFrame:
    """(*keep, kind, original, surrogate) hashes of the entities of replace_pii(). A surrogate is compared without its format, a person's in lower case, as its original is."""
    e = replaced.select(*keep, F.explode("entities").alias("e")).select(*keep, "e.kind", "e.original", "e.surrogate")
    person = F.col("kind") == "person"
    bare = F.when(person, F.lower("surrogate")).otherwise(F.regexp_replace(F.lower("surrogate"), "[ ().-]", ""))
    own = F.when(person, F.lower(F.regexp_replace("original", "^[fm]? ", ""))).otherwise(F.when(F.col("kind").isin("email", "ipv4"), F.regexp_replace(F.lower("original"), "[ ().-]", "")).otherwise(F.lower("original")))
    return e.select(*keep, "kind", F.xxhash64("kind", own).alias("original"), F.xxhash64("kind", bare).alias("surrogate"))


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of hashed surrogates that stand for two entities or more: none, if all is well. Sums and ends of hashes are combined before
    the shuffle, so a hot entity costs a row a task."""
    e = told_apart(replaced).groupBy("kind", "surrogate").agg(F.min("original").alias("lo"), F.max("original").alias("hi"))
    return e.where("lo <> hi").select("kind", "surrogate")


def checked(replaced: DataFrame) -> DataFrame:
    """replace_pii()'s rows and n_collisions, how many of a row's entities have a surrogate that stands for another entity of the corpus too.

    No such row may be published under this key. The rows are computed twice, once for the check."""
    shared, _ = small(checkpoint(collisions(replaced)))
    rows = replaced.withColumn("_row", F.monotonically_increasing_id())
    if shared.isEmpty():
        return replaced.withColumn("n_collisions", F.lit(0).cast("long"))
    rows = checkpoint(rows)
    n = told_apart(rows, "_row").join(shared, ["kind", "surrogate"]).groupBy("_row").agg(F.count("*").alias("n_collisions"))
    return rows.join(n, "_row", "left").withColumn("n_collisions", F.coalesce("n_collisions", F.lit(0).cast("long"))).drop("_row")


def digest(replaced: DataFrame) -> DataFrame:
    """The columns of the query: the new text, each entity's kind and place, and the outcome of the collision check."""
    place = F.transform("entities", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return checked(replaced).select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(place, ",").alias("spans"), "text", "n_collisions")
