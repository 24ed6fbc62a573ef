"""PII surrogates: detected entities get keyed replacements of their own type, gender, script and format.

A value's characters are permuted within their classes (digits, letters, hexadecimal digits) by a keyed
Feistel network that walks until it lands in the value's domain: a one-to-one map, so equal values get
equal surrogates everywhere and different values different ones, without a table.  Names are made from
given names of the same gender and script and family names of keyed syllables.  A check over the distinct
entities of the corpus finds surrogates that equal a real entity or each other; those entities get another
attempt, until none is left.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.common import discard, kept, materialize, named, table

KEY_SETTING = "spark.frostline.secretKey"

#: Titles before a name, by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "Latn": {"f": "Anna Clara Elena Julia Laura Maria Nora Paula Rosa Sofia".split(), "m": "Adam Bruno Daniel Felix Hugo Jonas Leo Martin Oscar Paul".split(), "n": "Alex Charlie Dominique Jules Kim Lou Robin Sam Sascha Toni".split()},
    "Cyrl": {"f": "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(), "m": "Антон Борис Иван Лев Марк Олег Павел Юрий".split(), "n": "Саша Женя Валя Шура".split()},
    "Grek": {"f": "Άννα Ελένη Μαρία Σοφία Ζωή Ειρήνη".split(), "m": "Νίκος Γιώργος Πέτρος Μάριος Λουκάς Ανδρέας".split(), "n": "Αλέξ Κρις Σαμ Τζο".split()},
}
#: Given names that are known without a title, besides those above.
KNOWN = {
    "f": "Mary Emma Olivia Sarah Lisa Marie Sophie Camille Carmen Lucia".split(),
    "m": "John James Robert Michael David Thomas Peter Hans Pierre Carlos Juan Luis".split(),
}
SYLLABLES = {
    "Latn": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "Cyrl": "ба бе бо да де до га ка ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва во".split(),
    "Grek": "βα δε δο γα κα κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σο τα τε το".split(),
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_KNOWN = {name: g for of in (*GIVEN.values(), KNOWN) for g, names in of.items() for name in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: What is detected, first match first; a group ``v`` is the part that is replaced.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])(?P<v>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_+/=.-]{6,})")),
    ("key", re.compile(r"\b(?:AKIA|ASIA)(?P<v>[A-Z0-9]{12,20})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}(?P<v>\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ip", re.compile(rf"(?<![\d.])(?P<v>{_OCTET}(?:\.{_OCTET}){{3}})(?![\d.]*\d)")),
    ("ip6", re.compile(r"(?<![\w:.])(?P<v>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){3,7}[0-9A-Fa-f]*(?![\w:]))(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")),
    ("ssn", re.compile(r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")),
    ("phone", re.compile(r"(?i)\b(?:tel|phone|telephone|telefon|tél|mobile|fax|call)\b[.:]*\s*(?P<v>\(?0\d{1,5}\)?(?:[ /.-]?\d{2,8}){1,4})(?!\d)")),
    ("passport", re.compile(r"(?i)\b(?:passport|pasaporte|passeport|reisepass)\b(?:\s+(?:no|number|nr)\b)?[.:#]*\s*(?P<v>(?=[A-Z]*\d)[A-Z0-9]{6,9})\b")),
    ("card", re.compile(r"(?<![\d.])(?P<v>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?!\d)")),
    ("number", re.compile(r"(?<![\d.])(?P<v>\d{9,19})(?!\d)")),
]
_NAME = re.compile(rf"\b(?P<t>{_TITLE})\b\.? (?P<n>[^\W\d_]+(?:[-'][^\W\d_]+)?(?: [^\W\d_]+(?:[-'][^\W\d_]+)?)?)")
_CAPITALS = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я"
#: A capitalised word before another one.
_PAIR = re.compile(rf"(?<![\w'-])(?P<g>[{_CAPITALS}][^\W\d_]+) (?=(?P<f>[{_CAPITALS}][^\W\d_]+(?:[-'][^\W\d_]+)?))")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")


def script_of(word: str) -> str | None:
    c = ord(word[0])
    return "Latn" if c < 0x250 else "Grek" if 0x370 <= c < 0x400 else "Cyrl" if 0x400 <= c < 0x530 else None


def _met(text: str, names: dict[str, str], compounds: bool):
    """(start, end, name) where whole words of a text are one of the names; names of two words parted by a
    hyphen or an apostrophe before their parts.  Parts of hyphenated compounds count only with ``compounds``."""
    at = [m.span() for m in _WORD.finditer(text)]
    joined = lambda i, marks: 0 <= i < len(at) - 1 and at[i + 1][0] - at[i][1] == 1 and text[at[i][1]] in marks
    for i, (a, b) in enumerate(at):
        for last, end in ((i + 1, at[i + 1][1] if joined(i, "-'") else -1), (i, b)):
            if end > 0 and text[a:end] in names and (compounds or not (joined(i - 1, "-") or joined(last, "-"))):
                yield a, end, text[a:end]
                break


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of a text's entities, in order and apart; null and empty texts have none.

    A name's type has its part, gender and script, as in ``given:f:Latn``; family names have no gender.
    Names are introduced by a title, or by a known given name before a capitalised word; an introduced
    given or family name counts wherever else it stands in the text.  A given name met under a title of a
    gender and one of none has that gender.  Time grows in proportion to the text.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []  # in order

    def add(a: int, b: int, kind: str) -> None:
        i = bisect_left(found, (a,))
        if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
            found.insert(i, (a, b, kind))

    if "@" in text or "=" in text or ":" in text or _DIGIT.search(text):
        for kind, pattern in PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                add(*m.span("v"), kind)
    families: dict[str, str] = {}
    givens: dict[str, str] = {}
    names: list[tuple[int, str, str]] = []
    for m in _PAIR.finditer(text):
        loud = m["g"].isupper() and m["f"].isupper()  # a name all in capitals
        if (gender := _KNOWN.get(m["g"].capitalize() if loud else m["g"])) and (script := script_of(m["f"])) == script_of(m["g"]):
            names.append((m.start("g"), m["g"], gender))
            givens[m["g"]] = gender
            families[m["f"]] = script
    if any(t in text for t in _GENDER):
        for m in _NAME.finditer(text):
            words, at = m["n"].split(" "), m.start("n")
            if not words[0][0].isupper() or script_of(words[0]) is None:
                continue
            gender = _GENDER[m["t"]]
            if len(words) == 2 and words[1][0].isupper():
                names.append((at, words[0], gender))
                if givens.get(words[0], "n") == "n":
                    givens[words[0]] = gender
                at, family = at + len(words[0]) + 1, words[1]
            else:
                family = words[0]
            if script := script_of(family):
                add(at, at + len(family), f"family:{script}")
                families[family] = script
    for at, given, gender in names:
        add(at, at + len(given), f"given:{givens[given] if gender == 'n' else gender}:{script_of(given)}")
    if families:
        for a, b, family in _met(text, families, True):
            add(a, b, f"family:{families[family]}")
    if givens:
        for a, b, given in _met(text, givens, False):
            if given not in _GENDER:  # a second title before a family name is no name
                add(a, b, f"given:{givens[given]}:{script_of(given)}")
    return found


def _round(key: bytes, salt: bytes, i: int, x: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{x}".encode(), key=key, salt=salt, digest_size=32).digest(), "big") % size


def permute(x: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """A keyed one-to-one map of 0..size-1: a Feistel network on a x b >= size, walked until inside."""
    a = isqrt(size - 1) + 1  # in whole numbers: a float's root of a large size is too far off to be counted up
    b = -(-size // a)
    salt = hashlib.blake2b(tweak.encode(), digest_size=16).digest()
    while True:
        left, right = divmod(x, b)
        for i in range(0, rounds, 2):
            left = (left + _round(key, salt, i, right, a)) % a
            right = (right + _round(key, salt, i + 1, left, b)) % b
        x = left * b + right
        if x < size:
            return x


_CLASSES = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "x": "0123456789abcdef", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _classes(value: str) -> list[str]:
    low = re.sub(r"[^0-9a-zA-Z]", "", value)
    hexadecimal = len(low) >= 12 and re.fullmatch(r"\d*[a-f][0-9a-f]*", low) is not None
    return [("x" if hexadecimal else "d" if c in _CLASSES["d"] else "l" if c in _CLASSES["l"] else "u" if c in _CLASSES["u"] else "") for c in value]


#: Digits and letters that are permuted as one number; a longer value is cut in pieces.
PIECE = 64


def _formatted(value: str, key: bytes, tweak: str, kinds: list[str] | None = None) -> str:
    """The value with its digits and letters permuted as one number; other characters stay.

    A value of more than ``PIECE`` of them is permuted piece by piece, each under the hash of the pieces before it, there
    and back: that is one-to-one too, each piece hangs on all others, and time grows in proportion to the value.
    """
    kinds = kinds or _classes(value)
    places = [i for i, k in enumerate(kinds) if k]
    if not places:
        return value
    out, tweak = list(value), tweak + "|" + "".join(k or c for c, k in zip(value, kinds))
    if len(places) <= PIECE:
        _permuted(out, places, kinds, key, tweak)
        return "".join(out)
    pieces = [places[i : i + PIECE] for i in range(0, len(places), PIECE)]
    for way in (1, -1):
        before = hashlib.blake2b(f"{way}|{tweak}".encode(), digest_size=16)
        for piece in pieces[::way]:
            plain = "".join(out[i] for i in piece)
            _permuted(out, piece, kinds, key, before.hexdigest())
            before.update(plain.encode())
    return "".join(out)


def _permuted(out: list[str], places: list[int], kinds: list[str], key: bytes, tweak: str) -> None:
    """Permute the characters at some places, as one number."""
    x, size = 0, 1
    for i in places:
        of = _CLASSES[kinds[i]]
        x, size = x * len(of) + of.index(out[i]), size * len(of)
    x = permute(x, size, key, tweak)
    for i in reversed(places):
        of = _CLASSES[kinds[i]]
        x, r = divmod(x, len(of))
        out[i] = of[r]


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a value of a kind.

    Letters' cases follow the value's; an e-mail address keeps its top-level domain, a telephone number
    its country code, a card number its first digit and, if it had one, a valid check digit.
    """
    tweak = f"{kind}|{attempt}"
    pick = lambda n, what: int.from_bytes(hashlib.blake2b(f"{what}|{value.lower()}".encode(), key=key, digest_size=8).digest(), "big") % n
    if kind.startswith(("given:", "family:")):
        script = kind.rsplit(":", 1)[1]
        syllables = lambda n, what: "".join(SYLLABLES[script][pick(len(SYLLABLES[script]), f"{tweak}|{what}{i}")] for i in range(n))
        if kind.startswith("given:"):
            names = GIVEN[script][kind.split(":")[1]]
            name = names[pick(len(names), tweak)] + (syllables(attempt, "g") if attempt else "")
        else:
            name = syllables(4 + attempt, "f").capitalize()
        return name.upper() if value.isupper() and len(value) > 1 else name
    low = value if kind in ("secret", "key", "iban") else value.lower()
    if kind == "email":
        local, _, domain = low.rpartition("@")
        host, _, top = domain.rpartition(".")
        made = _formatted(f"{local}@{host}", key, tweak) + "." + top
    elif kind == "ip":
        x = 0
        for octet in low.split("."):
            x = x * 256 + int(octet)
        x = permute(x, 2**32, key, tweak)
        made = ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    elif kind == "ip6":
        made = _formatted(low, key, tweak, ["x" if c.isalnum() else "" for c in low])
    elif kind == "phone" and low.startswith("+"):
        code = re.match(r"\+\d{1,3}?(?=[ .(-])|\+\d", low)[0]
        made = code + _formatted(low[len(code) :], key, tweak + code)
    elif kind == "card":
        digits = re.sub(r"\D", "", low)
        valid = _luhn(digits)
        body = _formatted(digits[1:-1], key, tweak + digits[0])
        end = next(c for c in "0123456789" if _luhn(digits[0] + body + c)) if valid else _formatted(digits[-1], key, tweak + body)
        if not valid and _luhn(digits[0] + body + end):  # an invalid number stays invalid, one to one
            end = next(c for c in "0123456789" if _luhn(digits[0] + digits[1:-1] + c))
            end = _formatted(end, key, tweak + body)
        fresh = iter(digits[0] + body + end)
        made = "".join(next(fresh) if c.isdigit() else c for c in low)
    else:
        made = _formatted(low, key, tweak)
    if attempt >= 8 and made == low:  # a domain too small to leave
        made += str(attempt)
    return made.upper() if value.isupper() and kind == "email" else made


def normal(kind: str, value: str) -> str:
    """Under which a value is the same entity: letter case counts only in secrets, keys and account numbers."""
    return value if kind in ("secret", "key", "iban") else value.lower()


def _replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    spans, out, last, moved, found = entities(text), [], 0, 0, []
    for a, b, kind in spans:
        new = surrogate(kind, text[a:b], key, attempts.get((kind, normal(kind, text[a:b])), 0))
        out += [text[last:a], new]
        found.append({"type": kind, "start": a + moved, "end": a + moved + len(new), "surrogate": new})
        last, moved = b, moved + len(new) - (b - a)
    return ("".join([*out, text[last:]]) if spans else text), found


def distinct_entities(docs: DataFrame) -> DataFrame:
    """(kind, value) of all entities, values normal."""

    def detect(batches) -> Iterator[pa.RecordBatch]:
        kept("surrogates")
        for batch in batches:
            rows = {(k, normal(k, t[a:b])) for t in batch.column("text").to_pylist() if t for a, b, k in entities(t)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["kind", "value"])

    return docs.select("text").mapInArrow(detect, "kind string, value string").distinct()


def collision_attempts(found: DataFrame, key: bytes, most: int = 24) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogates aren't free, settled attempt by attempt.

    A surrogate is free if no real entity of its kind has it and no other entity got it; of several that
    meet, the first by value keeps it.  Entities still unsettled after ``most`` attempts are an error.
    """

    def make(batches):
        for batch in batches:
            kinds, values, attempts = (batch.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            made = [normal(k, surrogate(k, v, key, a)) for k, v, a in zip(kinds, values, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "made"])

    schema = "kind string, value string, attempt int, made string"
    # Entities are short: a file of them that one task reads may hold millions.
    state, last = found.repartition(max(1, -(-found.count() // 20_000))).withColumn("attempt", F.lit(0)).mapInArrow(make, schema), None
    for _ in range(most):
        state = materialize(state, "surrogates")
        real = found.select("kind", F.col("value").alias("made")).withColumn("real", F.lit(True))
        first = state.groupBy("kind", "made").agg(F.min(F.struct(F.col("attempt"), "value")).alias("first"))
        # An earlier attempt keeps its surrogate: it was settled before.
        judged = state.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        bad = F.coalesce("real", F.lit(False)) | (F.col("value") != F.col("first.value"))
        judged = judged.select("kind", "value", "attempt", "made", bad.alias("bad"))
        if last is not None:
            discard(last)
        last = state
        if not judged.where("bad").isEmpty():
            again = judged.where("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(make, schema)
            state = judged.where("not bad").select("kind", "value", "attempt", "made").union(again)
        else:
            return state.where("attempt > 0").select("kind", "value", "attempt")
    raise RuntimeError(f"surrogates still meet after {most} attempts")


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.frostline.secretKey``; where it isn't set, a random one, the same for the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return hashlib.blake2b(spark.conf.get(KEY_SETTING).encode(), digest_size=32).digest()


def with_surrogates(docs: DataFrame, key: bytes | None = None, most_exceptions: int = 100_000, column: str = "entities") -> DataFrame:
    """``docs`` with replaced texts, and ``column``: array of (type, start, end, surrogate) in the new text.

    ``key`` decides the surrogates, by default the session's: keep it secret, since who has it can undo them,
    and the same where corpora are to agree.  A column of the input named ``column`` gives way; all others ride
    along, of whatever names and types.  Null and empty texts stay as they are, an empty table is empty, very long
    texts are searched whole.  Rows repeat as they come.  The few entities that needed another attempt
    are broadcast up to ``most_exceptions``, checked; beyond, each document's own are joined to it.
    """
    spark = docs.sparkSession
    key = key or session_key(spark)
    again = materialize(collision_attempts(materialize(distinct_entities(docs), "entities"), key), "attempts")
    few = again.limit(most_exceptions + 1).count() <= most_exceptions
    item = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    names = [c for c in docs.columns if c.lower() != column.lower()]
    # All but the text ride along in one column, whatever their names; an empty struct would be no column.
    kept = docs.select(F.struct(F.lit(True).alias("_"), *named(*[c for c in names if c != "text"])).alias("row"), "text")
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", T.ArrayType(T.StructType.fromDDL("type string, start int, end int, surrogate string")))])

    def replaced(batch, attempts):
        done = [_replaced(t, key, own) for t, own in zip(batch.column("text").to_pylist(), attempts)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], item)], ["row", "text", "spans"])

    if few:
        table_ = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in again.collect()})

        def replace(batches):
            for batch in batches:
                yield replaced(batch, [table_.value] * batch.num_rows)

        out = kept.mapInArrow(replace, schema)
    else:

        def own(batches):
            for batch in batches:
                found = [(h, k, normal(k, t[a:b])) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()) if t for a, b, k in entities(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["h", "kind", "value"])

        def replace_own(batches):
            for batch in batches:
                yield replaced(batch, [{(x["kind"], x["value"]): x["attempt"] for x in own_ or []} for own_ in batch.column("again").to_pylist()])

        hashed = kept.withColumn("h", F.sha2("text", 256))
        needed = hashed.select("h", "text").mapInArrow(own, "h string, kind string, value string").distinct().join(again, ["kind", "value"])
        lists = needed.groupBy("h").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("again"))
        out = hashed.join(lists, "h", "left").select("row", "text", "again").mapInArrow(replace_own, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], F.col("spans").alias(column))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
