"""Format-preserving pseudonyms for personal data.

Validated numbers and dates, with mail addresses and secrets, are replaced by a
keyed permutation of their own format: a Feistel network over the numbers below
the format's size, walked until the image lies inside. Equal values get equal
pseudonyms in every document, however a card, a phone number or a date is
written; distinct values of one format stay distinct, and the key's holder can
invert them. A card keeps its network's digits, a phone number its country's.

The key comes from the caller, else from the session's
spark.docmill.pseudonym.secret; a session that names none gets a random key,
which all its calls share and which is set there.

Defined cases: a null text stays null; text without a match is returned byte
for byte; candidates that fail validation (network, length and Luhn digit,
octets, calendar) stay, unless a phone number or a card of fewer digits stands at
their place, and the search goes on one token later; digits beside a card may
make its pseudonym pass as a longer card (one in ten), and then inversion isn't
exact; very long texts take linear time, and a long secret is permuted in groups
of GROUP characters; repeated rows get equal results; an empty table gives an
empty result; other columns pass through pseudonymised() untouched, but for those
named like the counts it adds, which are replaced.
"""

from __future__ import annotations

import re
import secrets
from collections import Counter
from collections.abc import Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.columns import ROWS, giving_back, sliced

ROUNDS = 10
#: Setting of the session that names the key.
KEY_SETTING = "spark.docmill.pseudonym.secret"
#: Characters that are permuted together.
GROUP = 64
KINDS = ("email", "card", "phone", "ip", "date", "secret")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Days that a date may fall on: 1900-01-01 to 2099-12-31.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: All card networks lead with 2 to 6. HINT is in every text that CANDIDATE matches: digits, mail addresses, named secrets, and the leads of secrets.
HINT = re.compile(r"[\d@=:]|(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA")
PARTS = {
    "email": r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-]@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))",
    "secret": r"(?P<secret>(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<body>[A-Za-z0-9+/_\-]{16,})|\b(?:sk|pk|ghp|gho|xox[bp])[-_](?P<body2>[A-Za-z0-9_\-]{16,})|\bAKIA(?P<body3>[A-Z0-9]{16})\b)",
    "date": r"(?P<date>(?<![\d.\-/])(?:(?P<y>\d{4})(?P<s1>[\-/.])(?P<m>\d{2})(?P=s1)(?P<d>\d{2})|(?P<d2>\d{2})(?P<s2>[\-/.])(?P<m2>\d{2})(?P=s2)(?P<y2>\d{4}))(?![\d\-/]|\.\d))",
    "ip": r"(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))",
    "card": r"(?P<card>(?<![\d])[2-6](?:[ \-]?\d){12,18}(?![\d]))",
    "phone": r"(?P<phone>(?<![\w])\+?1[ .\-]\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?![\d])|(?<![\w])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?![\d])|(?<![\w(])\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?![\d]))",
}
CANDIDATE = re.compile("|".join(PARTS.values()))
#: Leading digits of card networks and the lengths of their numbers.
NETWORKS = (
    ("4", (13, 16, 19)),
    ("5[1-5]", (16,)),
    (r"2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)", (16,)),
    ("3[47]", (15,)),
    ("6011|65|64[4-9]", (16, 17, 18, 19)),
    ("3(?:0[0-5]|6|8|9)", (14, 15, 16, 17, 18, 19)),
    (r"35(?:2[89]|[3-8]\d)", (16, 17, 18, 19)),
    ("62", (16, 17, 18, 19)),
    ("5018|5020|5038|5893|6304|6759|676[123]", (13, 14, 15, 16, 17, 18, 19)),
)
#: Leads of the networks whose numbers have so many digits; no two leads share a number.
LEADS = {n: re.compile("|".join(lead for lead, lengths in NETWORKS if n in lengths)) for n in range(13, 20)}
#: What a place may hold if its candidate isn't valid: a phone number, or a card of fewer digits.
PHONE = re.compile(PARTS["phone"])
RUN = re.compile(r"[2-6](?:[ \-]?\d){12,18}")
CARDS = {n: re.compile(PARTS["card"].replace("{12,18}", f"{{{n - 1}}}")) for n in range(19, 12, -1)}
#: A digit's share of a Luhn sum where it counts double.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: What a search leaves behind at a place where nothing is valid.
TOKEN = re.compile(r"\W*\w+")


def permuted(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """The image of value under the keyed permutation of range(size), or its inverse."""
    if size < 2:
        return value
    half = max(1, (((size - 1).bit_length() + 1) // 2))
    mask = (1 << half) - 1
    n_bytes = (half + 7) // 8

    salt = blake2b(tweak, digest_size=16).digest()

    def mix(i: int, right: int) -> int:
        seed = blake2b(right.to_bytes(n_bytes, "big"), digest_size=max(8, n_bytes), key=key, person=bytes([i]) + half.to_bytes(4, "big"), salt=salt)
        return int.from_bytes(seed.digest()[:n_bytes], "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ mix(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ mix(i, right)
        value = left << half | right
        if value < size:
            return value


def permuted_digits(digits: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    size = 10 ** len(digits)
    return str(permuted(int(digits), size, key, tweak + b"%d" % len(digits), back)).zfill(len(digits))


def permuted_characters(text: str, key: bytes, tweak: bytes, back: bool = False, hexadecimal: bool = False) -> str:
    """Digits, small and capital letters change within their class; every other character stays."""
    hexadecimals = (DIGITS + ("ABCDEF" if text.upper() == text else "abcdef"),)
    classes = hexadecimals if hexadecimal else (DIGITS, LOWER, UPPER)
    groups = (text[i : i + GROUP] for i in range(0, len(text), GROUP))
    return "".join(permuted_group(g, key, tweak + (b"%d|" % i if i else b""), classes, back) for i, g in enumerate(groups))


def permuted_group(text: str, key: bytes, tweak: bytes, classes: tuple[str, ...], back: bool) -> str:
    kinds = [next((k for k in classes if c in k), "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join("." if not k else str(classes.index(k)) for k in kinds).encode()
    value = permuted(value, size, key, tweak + shape, back)
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, r = divmod(value, len(k))
            c = k[r]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    return str(-(sum(DOUBLED[int(c)] for c in body[-1::-2]) + sum(map(int, body[-2::-2]))) % 10)


def card_lead(digits: str) -> int:
    """How many digits name the network of a valid card; 0 if it isn't one."""
    kept = network_digits(digits)
    return kept if kept and luhn_digit(digits[:-1]) == digits[-1] else 0


def refilled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def replacement(m: re.Match, key: bytes, back: bool = False) -> tuple[str, str] | None:
    """Kind and pseudonym of a candidate, None if it isn't valid."""
    whole = m.group()
    kind = next(k for k in KINDS if m.groupdict().get(k) is not None)
    if kind == "email":
        name, _, host = whole.rpartition("@")
        labels, _, top = host.rpartition(".")
        return kind, f"{permuted_characters(name, key, b'name', back)}@{permuted_characters(labels, key, b'host', back)}.{top}"
    if kind == "secret":
        body = next(m.group(g) for g in ("body", "body2", "body3") if m.group(g) is not None)
        at = m.start("body") if m.group("body") else m.start("body2") if m.group("body2") else m.start("body3")
        hexadecimal = re.fullmatch(r"[0-9]*(?:[a-f][0-9a-f]*|[A-F][0-9A-F]*)", body) is not None
        new = permuted_characters(body, key, b"secret", back, hexadecimal)
        return kind, whole[: at - m.start()] + new + whole[at - m.start() + len(body) :]
    if kind == "ip":
        octets = [int(x) for x in whole.split(".")]
        if any(x > 255 for x in octets):
            return None
        value = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip", back)
        return kind, ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        y, mo, d = (int(m.group(a) or m.group(b)) for a, b in (("y", "y2"), ("m", "m2"), ("d", "d2")))
        try:
            day = date(y, mo, d).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", back))
        s = m.group("s1") or m.group("s2")
        return kind, new.strftime(f"%Y{s}%m{s}%d" if m.group("y") else f"%d{s}%m{s}%Y")
    digits = re.sub(r"\D", "", whole)
    if kind == "card":
        if not (kept := card_lead(digits)):
            return None
        body = digits[:kept] + permuted_digits(digits[kept:-1], key, b"card" + digits[:kept].encode(), back)
        return kind, refilled(whole, body + luhn_digit(body))
    if not 7 <= len(digits) <= 15:
        return None
    kept = country_digits(whole, digits)
    return kind, refilled(whole, digits[:kept] + permuted_digits(digits[kept:], key, b"phone", back))


def network_digits(digits: str) -> int:
    """How many digits name a card's network; 0 if none has numbers like it."""
    m = LEADS[len(digits)].match(digits) if len(digits) in LEADS else None
    return m.end() if m else 0


def country_digits(whole: str, digits: str) -> int:
    """How many digits name a phone number's country; a number without them is a national one."""
    if len(digits) == 11 and digits[0] == "1":
        return 1
    if not whole.startswith("+"):
        return 0
    lead = re.match(r"\+(\d{1,3})(?=[ .\-(])", whole)
    return len(lead[1]) if lead else 1


def others(text: str, at: int) -> Iterator[re.Match]:
    """What else the place may hold: a phone number, then valid cards, the longest first."""
    if m := PHONE.match(text, at):
        yield m
    if run := RUN.match(text, at):
        digits = re.sub(r"\D", "", run.group())
        for n, card in CARDS.items():
            if n <= len(digits) and card_lead(digits[:n]) and (m := card.match(text, at)):
                yield m


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, Counter]:
    """text with its personal data replaced (or restored), and how many of each kind."""
    found: Counter = Counter()
    if not text or not HINT.search(text):
        return text, found

    out, done, at = [], 0, 0
    while m := CANDIDATE.search(text, at):
        if (new := replacement(m, key, back)) is None:
            m, new = next(((x, y) for x in others(text, m.start()) if (y := replacement(x, key, back))), (m, None))
        if new is None:
            at = TOKEN.match(text, m.start()).end()
            continue
        found[new[0]] += 1
        out += text[done : m.start()], new[1]
        done = at = m.end()
    return "".join([*out, text[done:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The session's key, which is made when it is first asked for; any length, hashed to the 64 bytes that are used."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, named)
    return blake2b(named.encode()).digest()


def pseudonymised(docs: DataFrame, text_col: str = "text", key: bytes | None = None, counts: bool = False) -> DataFrame:
    """docs with text_col pseudonymised in place; counts adds n_<kind> columns for the kinds replaced."""
    extra = [f"n_{k}" for k in KINDS] if counts else []
    key = key or session_key(docs.sparkSession)
    docs = docs.drop(*extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = fields + "".join(f", {x} bigint" for x in extra)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, ROWS):
            done = [pseudonymise(x, key) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS if counts]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *extra])

    return docs.mapInArrow(giving_back(run), schema)


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with its personal data pseudonymised, and what was replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs, counts=True).withColumn("n_replaced", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))


QUERIES = {"op6_pii_pseudonyms": op6_pii_pseudonyms}
