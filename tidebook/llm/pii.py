"""Personal data replaced by surrogates: keyed, of the same kind and form, and never two entities alike."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import itertools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import text as X
from tidebook.llm.cluster import cut
from tidebook.llm.hot import dealt_join

#: Bytes of text that the kernel takes at a time.
PIECE = 4 << 20
#: Rows of one entity, or of one text, in a task.
MOST = 100_000

MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")

TITLES = (*MALE, *FEMALE, *NEUTRAL)
_GAP = "[ \\t\\r\\n ]"
_DIGIT = r"(?<![\p{L}\p{N}])(?<!\d[.\-])"
#: A word of a name: a capital, then small letters; a prefix as in O' or Mc, and parts after a hyphen, belong to it.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}\p{M}]{1,40}+(?:\p{Lu}[\p{Ll}\p{M}]{1,40}+)?(?:\-\p{Lu}[\p{Ll}\p{M}]{1,40}+){0,2}"
#: Every repeat is bounded, or possessive behind a start that can't lie inside it, so that a text takes linear time.
PATTERN = regex.compile(
    rf"""
    (?P<email>(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]{{1,64}}+@(?:[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]{{0,61}}[\p{{L}}\p{{N}}])?\.){{1,8}}\p{{L}}{{2,24}})
  | (?P<iban>{_DIGIT}[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))
  | (?P<secret>(?<![\p{{L}}\p{{N}}_\-+/])[A-Za-z0-9_\-+/]{{20,}}+={{0,2}}(?![\p{{L}}\p{{N}}]))
  | (?P<ip>{_DIGIT}(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{{L}}\p{{N}}])(?!\.\d))
  | (?P<ip6>(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]{{0,4}}:)[0-9A-Fa-f:]{{3,39}}+(?![\p{{L}}\p{{N}}:]))
  | (?P<card>{_DIGIT}(?:\d{{4}}[\ \-]\d{{4}}[\ \-]\d{{4}}[\ \-]\d{{4}}|\d{{4}}[\ \-]\d{{6}}[\ \-]\d{{5}}|\d{{13,19}})(?!\d))
  | (?P<ssn>{_DIGIT}\d{{3}}(?P<sep>[\ \-])\d{{2}}(?P=sep)\d{{4}}(?!\d))
  | (?P<phone>(?<![\p{{L}}\p{{N}}])(?:\+\d{{1,3}}[\ .\-]?(?:\(\d{{1,4}}\)[\ .\-]?)?|\(\d{{2,4}}\)[\ .\-]?|(?<!\d[.\-])(?=\d{{3}}[\ .\-]\d{{3}}[\ .\-]\d{{4}}(?!\d)))\d{{2,4}}(?:[\ .\-]?(?!\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d))\d{{2,4}}){{1,4}}(?![\p{{L}}\p{{N}}])
      | (?<![\p{{L}}\p{{N}}+])(?<!\d[.\-,])(?:\d{{3}}-\d{{4}}|0\d{{1,4}}[\ \-/]\d{{5,8}}|0\d{{1,4}}(?:[\ \-/]\d{{2,4}}){{2,4}})(?![\p{{L}}\p{{N}}]|[\-.,]\d))
  | (?<![\p{{L}}\p{{N}}])(?P<title>{"|".join(sorted(TITLES, key=len, reverse=True))})\.?{_GAP}{{1,3}}(?:\p{{Lu}}\.{_GAP}?){{0,2}}(?P<name>{_NAME}(?:{_GAP}{{1,2}}(?:\p{{Lu}}\.{_GAP}?){{0,2}}{_NAME}){{0,2}})
    """,
    regex.VERBOSE,
)
_WORD = regex.compile(rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])")
#: What a text must hold to hold an entity; the JVM looks for it before Python sees the text. The class in front lets
#: it pass over most letters without trying the titles.
HINT = "(?=[@\\p{Nd}" + "".join(sorted({t[0] for t in TITLES})) + "]|::)(?:[@\\p{Nd}]|::|(?:" + "|".join(TITLES) + ")\\.?" + _GAP + ")"

SCRIPTS = {
    "latin": ("bdfgklmnprstv", "aeiou"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
    "greek": ("βγδκλμνπρστ", "αειο"),
}
#: How invented given names end, for women, men, and where nothing says.
ENDINGS = {
    "latin": {"f": ("a", "ia", "ina", "ella"), "m": ("o", "us", "ard", "bert"), "n": ("is", "en")},
    "cyrillic": {"f": ("а", "ия", "ина"), "m": ("ан", "ослав", "ей"), "n": ("ень",)},
    "greek": {"f": ("α", "ία", "ίνα"), "m": ("ος", "ης", "ας"), "n": ("ι",)},
}
#: Endings of surnames that are a woman's or a man's; a surrogate keeps them.
SURNAME_ENDINGS = ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский", "ου", "ος", "ης", "ας")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str
    role: str = ""  # of a name: s for a surname, f, m or n for a given name


def script(letter: str) -> str:
    return "cyrillic" if "Ѐ" <= letter <= "ԯ" else "greek" if "Ͱ" <= letter <= "Ͽ" or "ἀ" <= letter <= "῿" else "latin"


def digits(value: str) -> str:
    """The digits of any script, as ASCII."""
    return "".join(str(unicodedata.digit(c)) for c in value if c.isdecimal())


def holds(value: str) -> bool:
    """Whether a long run is a key: 24 characters, or 20 without a small letter, that go from letter to digit or back three times."""
    if not (len(value) >= 24 or value.isalnum() and value == value.upper()):
        return False
    if len(value) == 20 and value[:4] in ("AKIA", "ASIA"):  # access keys of a fixed form
        return any(map(str.isdigit, value))
    kinds = [c.isdigit() for c in value if c.isalnum()]
    return sum(a != b for a, b in itertools.pairwise(kinds)) >= 3


def find(text: str) -> list[Mention]:
    """The entities of a text, from left to right.

    The canonical form is what all mentions of an entity share: lower case for addresses and secrets that differ in case
    only as a whole, ASCII digits alone for numbers. Each word of a name is an entity of its own, whatever its title, so
    a person reads the same with and without title, given name or surname; a name that follows a title is found again
    in the same text where it stands alone. Initials stay.
    """
    out: list[Mention] = []
    named: dict[str, str] = {}
    for m in PATTERN.finditer(text):
        if m["name"]:
            gender = "m" if m["title"] in MALE else "f" if m["title"] in FEMALE else "n"
            words = [*_WORD.finditer(m["name"])]
            for k, w in enumerate(words):
                role = "s" if k == len(words) - 1 else gender
                at = m.start("name") + w.start()
                out.append(Mention(at, at + len(w[0]), "name", w[0].casefold(), role))
                named[w[0]] = role
            continue
        kind = next(k for k in ("email", "iban", "secret", "ip", "ip6", "card", "ssn", "phone") if m[k])
        value = m[kind]
        if kind in ("card", "ssn", "phone"):
            canonical = digits(value)
            if not 7 <= len(canonical) <= (15 if kind == "phone" else 19):
                continue
        elif kind == "iban":
            canonical = value[:2] + digits(value[2:4]) + "".join(str(unicodedata.digit(c)) if c.isdecimal() else c for c in value[4:] if c != " ")
        elif kind == "ip":
            canonical = ".".join(str(int(x)) for x in value.split("."))
        elif kind == "ip6":
            try:
                canonical = ipaddress.IPv6Address(value).compressed
            except ValueError:
                continue
        elif kind == "email":
            canonical = value.lower()
        else:
            if not holds(value):
                continue
            canonical = value.lower() if value in (value.lower(), value.upper()) else value
        out.append(Mention(m.start(kind), m.end(kind), kind, canonical))
    if named:
        taken = [(m.start, m.end) for m in out]
        k = 0
        for w in _WORD.finditer(text):
            while k < len(taken) and taken[k][1] <= w.start():
                k += 1
            if w[0] in named and (k == len(taken) or taken[k][0] >= w.end()):
                out.append(Mention(w.start(), w.end(), "name", w[0].casefold(), ""))
        out.sort(key=lambda m: m.start)
    return out


class Stream:
    """Numbers that follow from a key, an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
        self.count = 0
        self.pool = 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.count.to_bytes(8, "big")).digest(), "big")
            self.left = 256
            self.count += 1
        x = self.pool & 0xFFFFFFFF
        self.pool >>= 32
        self.left -= 32
        return x * n >> 32

    def like(self, letter: str) -> str:
        """A letter or digit of the same script and case; other characters stay."""
        if letter.isdecimal():
            return str(self.below(10))
        if not letter.isalpha():
            return letter
        consonants, vowels = SCRIPTS[script(letter)]
        new = (consonants + vowels)[self.below(len(consonants + vowels))]
        return new.upper() if letter.isupper() else new


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int, role: str = "") -> str:
    """A canonical form of the same kind and form, another one for each attempt.

    The space grows with the attempts: from 16 on fixed parts are given up, from 32 on forms get longer, so there is
    always a next one, however many entities are taken.
    """
    s = Stream(key, kind, canonical, attempt)
    free, longer = attempt >= 16, max(0, attempt // 16 - 1)
    number = lambda n: "".join(str(s.below(10)) for _ in range(n))
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        # only names that are reserved for examples, so that no surrogate is anybody's address
        tail = "example." + (labels[-1] if labels[-1] in ("com", "net", "org") else ("com", "net", "org")[s.below(3)])
        new = "".join(map(s.like, local)) + "@" + ".".join(["".join(map(s.like, x)) for x in labels[:-2]] + [tail])
        if len(local) + len("".join(labels[:-2])) < 4 + attempt // 8:
            new = "".join(s.like("a") for _ in range(4 + attempt // 8)) + new
        return new
    if kind == "ip" and not longer:
        first = 1 + s.below(254) if free else (10, *range(240, 255))[s.below(16)]
        return ".".join(map(str, (first, s.below(256), s.below(256), 1 + s.below(254))))
    if kind in ("ip", "ip6"):  # the block kept for documentation
        return ipaddress.IPv6Address((0x20010DB8 << 96) + sum(s.below(1 << 32) << 32 * k for k in range(3))).compressed
    if kind == "card":
        body = canonical[0] + number(len(canonical) - 2 + 2 * longer)
        last = next(str(d) for d in range(10) if luhn(body + str(d)) == 0)
        return body + (last if luhn(canonical) == 0 else str((int(last) + 1 + s.below(9)) % 10))
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[s.below(26)] for c in canonical[4:]) + number(longer)
        rest = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00"))
        return canonical[:2] + f"{98 - rest % 97:02d}" + body
    if kind == "phone":
        keep = 1 if len(canonical) == 11 and canonical[0] == "1" or canonical[0] == "0" else 0
        new = canonical[:keep] + number(len(canonical) - keep + longer)
        return new[: keep + 3] + "555" + new[keep + 6 :] if len(canonical) - keep == 10 and not free else new
    if kind == "ssn":
        return (number(3) if free else str(900 + s.below(100))) + number(len(canonical) - 3 + longer)
    if kind == "secret":
        hexadecimal = regex.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical)
        letters = "abcdef" if hexadecimal and canonical.lower() == canonical else "ABCDEF" if hexadecimal else ""
        form = canonical + "0" * longer
        return "".join(("0123456789" + letters)[s.below(16)] if letters else (s.like(c) if c.isalnum() else c) for c in form)
    kind_of = script(canonical[0])
    consonants, vowels = SCRIPTS[kind_of]
    new = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(2 + longer + s.below(2)))
    if role in ("f", "m", "n"):
        endings = ENDINGS[kind_of][role]
        return new[:-1] + endings[s.below(len(endings))]
    return new + next((e for e in SURNAME_ENDINGS if canonical.endswith(e)), consonants[s.below(len(consonants))])


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's form: its separators, script of digits, and case; what is longer follows at the end."""
    if kind in ("card", "ssn", "phone", "iban"):
        it = iter(new)
        out = []
        for c in mention:
            x = next(it) if c.isalnum() else c
            out.append(chr(ord(c) - unicodedata.digit(c) + int(x)) if c.isdecimal() and x.isdigit() else x)
        return "".join([*out, *it])
    if kind == "name":
        return "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    if kind in ("email", "secret", "ip6") and mention == mention.upper() and mention != mention.lower():
        return new.upper()
    return new


def settle(entities: DataFrame, key: bytes, make: Callable[..., str] = surrogate) -> DataFrame:
    """entities(kind, canonical[, role]), distinct -> kind, canonical, surrogate, all surrogates of a kind apart.

    Every entity proposes the surrogate of its next attempt. A proposal fails if it is an entity that the documents
    hold, its own too, if an earlier round gave it away, or if a smaller entity proposes it as well; who fails tries
    again, and the forms' space grows with the attempts. Proposals are checked by joins and a minimum per surrogate, so
    no table of entities is held in one place.
    """
    if "role" not in entities.columns:
        entities = entities.withColumn("role", F.lit(""))

    def propose(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("kind", "canonical", "role")), strict=True)
                new = [make(key, k, c, attempt, r) for k, c, r in rows]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canonical"), pa.array(new, pa.string())], names=["kind", "canonical", "surrogate"])

        return run

    # given away so far: a frame per attempt, joined to one at every eighth
    pending, settled = entities, []
    for attempt in itertools.count():
        open_ = pending.select("kind", "canonical", "role").mapInArrow(X.lean(propose(attempt)), "kind string, canonical string, surrogate string")
        for taken in (entities.select("kind", F.col("canonical").alias("surrogate")), *(x.select("kind", "surrogate") for x in settled)):
            open_ = open_.join(taken, ["kind", "surrogate"], "left_anti")
        settled.append(cut(open_.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate")))
        pending = cut(pending.join(settled[-1], ["kind", "canonical"], "left_anti"))
        done = pending.isEmpty()
        if done or len(settled) == 8:
            settled = [reduce(DataFrame.union, settled) if done else cut(reduce(DataFrame.union, settled))]
        if done:
            return settled[0]


def replace(docs: DataFrame, key: bytes, text: str = "text", count: str | None = "n_entities", most: int = MOST) -> DataFrame:
    """docs, all columns, with every detected entity in ``text`` replaced, and the number of mentions in ``count``.

    Found: e-mail and IP addresses (4 and 6), phone numbers (international, ten digits, seven digits with a hyphen, and
    national ones from 0), card, account and social-security numbers, keys of 24 letters and digits or 20 without small
    letters, and names after a title, then wherever they stand in that text. Mentions of an entity get the same
    surrogate in all documents; different entities of a kind get different ones, none of which is a real entity of these
    documents. Surrogates follow from the key alone but for such clashes. Names keep script and, by the titles that most
    documents give them, gender; numbers their separators, check digits, and digits' script.

    Texts that hold none of the signs of an entity stay where they are; the others meet the surrogates of their own
    entities by the text's MD5, and an entity or a text of more than ``most`` rows is dealt over several tasks. Null and
    empty texts stay as they are with count 0; repeated rows stay. ``count`` replaces a column of that name.
    """
    names = docs.columns
    if count:
        docs = docs.drop(count)
    rest = docs.columns
    hint = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    clear, likely = docs.where(~hint), docs.where(hint).withColumn("_k", F.md5(text))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "t", PIECE):
            rows = []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                roles: dict[tuple[str, str], dict[str, int]] = {}
                for m in find(t):
                    votes = roles.setdefault((m.kind, m.canonical), dict.fromkeys("sfmn", 0))
                    if m.role:
                        votes[m.role] = 1
                rows += [(k, *entity, *votes.values()) for entity, votes in roles.items()]
            columns = [pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "kind", "canonical", *"sfmn"])

    found = likely.select(F.col("_k").alias("k"), F.col(text).alias("t")).mapInArrow(X.lean(detect), "k string, kind string, canonical string, s long, f long, m long, n long")
    mentions = cut(found.groupBy("k", "kind", "canonical").agg(F.count("*").alias("rows"), *(F.max(c).alias(c) for c in "sfmn")))
    # a name is a given name or a surname, a woman's or a man's, by most texts
    role = F.when(F.col("s") > F.col("f") + F.col("m") + F.col("n"), "s").when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").when(F.col("n") > 0, "n").otherwise("s")
    entities = cut(mentions.groupBy("kind", "canonical").agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in "sfmn")).withColumn("role", role))
    surrogates = settle(entities.select("kind", "canonical", "role"), key)
    known = dealt_join(mentions.select("k", "kind", "canonical"), surrogates, ["kind", "canonical"], "k", entities.where(F.col("texts") > most).select("kind", "canonical", F.col("texts").alias("rows")), most)
    of = known.groupBy("k").agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("_s"))
    common = mentions.groupBy("k").agg(F.max("rows").alias("rows")).where(F.col("rows") > most)
    likely = likely.withColumnRenamed("_k", "k")
    met = dealt_join(likely, of, ["k"], F.monotonically_increasing_id(), common, most, "left").drop("k")
    schema = T.StructType([*(docs.schema[c] for c in rest), *([T.StructField(count, T.LongType())] if count else [])])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, text, PIECE):
            texts, counts = [], []
            for t, known in zip(batch.column(text).to_pylist(), batch.column("_s").to_pylist(), strict=True):
                table = {(r["kind"], r["canonical"]): r["surrogate"] for r in known or ()}
                parts, at, found = [], 0, find(t) if table else []
                for m in found:
                    parts += (t[at : m.start], render(m.kind, t[m.start : m.end], table[m.kind, m.canonical]))
                    at = m.end
                texts.append("".join([*parts, t[at:]]))
                counts.append(len(found))
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(counts, pa.int64())] if count else [])], names=schema.names)

    out = met.mapInArrow(X.lean(rewrite), schema)
    clear = clear.withColumn(count, F.lit(0).cast("long")) if count else clear
    order = [c for c in names if c != count] + ([count] if count else [])
    return clear.select(*order).union(out.select(*order))
