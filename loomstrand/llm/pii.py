"""Personal data replaced by format-preserving Feistel pseudonyms.

Values are found, validated, and permuted under a key within the set of values of their own format: a card number
becomes another card number with a right check digit, a date another date of the same writing. The permutation depends
on the key and the format alone, so equal values stay equal in all documents, and whoever holds the key can go back.
Where other groups of digits touch a card, a pseudonym may by chance let another cut of the run be a card; the way back
by text is then wrong there, that by the places of `pii` isn't.

Phones are found in international writing (+ or 00 and a country), with an area code in brackets, as NNN-NNN-NNNN, and in
national writing with a leading 0 and 9 to 12 digits. Dates are found in digits with a year of four, also before the
time of an ISO time stamp. Not covered: national numbers without a leading 0 in other groups (as Spanish 612 34 56 78),
phones of under 7 digits or with letters; numbers of 13 and more digits without a card's check digit; dates with a month's name, with a year of two digits or without separators; ranges such as 2021-01-02/03.
"""

from __future__ import annotations

import hmac
import re
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import field, id_type, map_rows, table

#: The key of the registered query; a deployment passes its own.
DEMO_KEY = b"loomstrand demonstration key"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "date")
ROUNDS = 8
#: Characters that one permutation moves at most; longer values go in chunks.
CHUNK = 64

# The country codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked until
    the value lies in the range again (Black and Rogaway 2002)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, octets = (1 << half) - 1, (half + 7) // 8

    def f(k: int, r: int) -> int:
        out, block = b"", 0
        while len(out) < octets:
            out += hmac.digest(key, b"%s|%d|%d|%d|" % (tweak.encode("utf-8", "surrogatepass"), half, block, r) + k.to_bytes(octets, "big"), "sha256")
            block += 1
        return int.from_bytes(out[:octets], "big") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for k in reversed(range(ROUNDS)):
                a, b = b ^ f(k, a), a
        else:
            for k in range(ROUNDS):
                a, b = b, a ^ f(k, b)
        x = a << half | b
        if x < size:
            return x


def walk(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool], back: bool = False) -> int:
    """The permutation that feistel() leaves on the valid values of range(size)."""
    while True:
        x = feistel(x, size, key, tweak, back)
        if valid(x):
            return x


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn_ok(body + c))


def ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{body}{country}00"))
    return f"{98 - number % 97:02d}"


FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def move_date(day: date, key: bytes, back: bool = False) -> date:
    """Days of 1900 to 2099 stay among themselves, as do all others."""
    n, last = day.toordinal(), date.max.toordinal()
    if FIRST <= n <= LAST:
        return date.fromordinal(FIRST + feistel(n - FIRST, LAST - FIRST + 1, key, "date", back))
    return date.fromordinal(1 + walk(n - 1, last, key, "far date", lambda x: not FIRST <= x + 1 <= LAST, back))


def move_mixed(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """ASCII letters to letters of the same case and digits to digits, in chunks of CHUNK characters, each under what
    the one before became; other characters stay."""
    out: list[str] = []
    for at in range(0, len(text), CHUNK):
        chunk, before = text[at : at + CHUNK], (text[at - CHUNK : at] if back else out[-1]) if at else ""
        out.append(_move_chunk(chunk, key, f"{tweak}|{before}" if at else tweak, back))
    return "".join(out)


def _move_chunk(text: str, key: bytes, tweak: str, back: bool) -> str:
    radices = [(10 if c.isdigit() else 26) if c.isascii() and c.isalnum() else 1 for c in text]
    x, size = 0, 1
    for c, r in zip(text, radices, strict=True):
        size *= r
        x = x * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)
    shape = "".join("d" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radices, strict=True))
    x = feistel(x, size, key, f"{tweak}|{shape}", back) if size > 1 else x
    out = []
    for c, r in zip(reversed(text), reversed(radices), strict=True):
        x, d = divmod(x, r)
        out.append(c if r == 1 else str(d) if r == 10 else chr(d + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


def refill(shape: str, chars: str) -> str:
    """The ASCII letters and digits of shape replaced by chars, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


#: What may stand left of an @ (from its beginning, so that a search is linear), and a domain right of it.
LOCAL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@")
DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+")


def emails(text: str) -> list[tuple[int, int]]:
    """The places of addresses: a letter or digit, then up to the @ what LOCAL has with no full stop last, then DOMAIN."""
    found, end = [], 0
    for m in LOCAL.finditer(text):
        start, at = max(m.start(), end), m.end() - 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and text[at - 1] != "." and (domain := DOMAIN.match(text, m.end())):
            end = domain.end()
            found.append((start, end))
    return found


PHONE_FORMS = r"""(?<![\w.])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,12}(?:[ ./-][0-9]{2,12}){0,4}(?!\w)
        |(?<![\w.])\([0-9]{2,5}\)[ ]?[./-]?[ ]?[0-9]{3,12}(?:[ .-][0-9]{2,9}){0,3}(?!\w)
        |(?<![\w+])(?<![0-9][./-])0[0-9]{1,5}(?:[ ]?/[ ]?|[ .-])[0-9]{1,9}(?:[ .-][0-9]{2,9}){0,4}(?!\w)
        |(?<![\w+])(?<![0-9][./-])0[1-9][0-9]{8,9}(?!\w)
        |(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,4}(?!\w)|\+[0-9]{8,15}(?!\w)"""
PHONE = re.compile(PHONE_FORMS, re.X)
NUMBER = re.compile(
    r"""(?=[0-9A-Z+(])(?:(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
    |(?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?:(?=[Tt][0-9]{2}(?![0-9]))|(?=[Tt][0-9]{4}(?:[0-9]{2})?(?![0-9]))|(?![\w/-])))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<long>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    |(?P<phone>""" + PHONE_FORMS + "))",
    re.X,
)


#: Groups of digits that single spaces or hyphens join, and how cards are usually written in more than one group.
RUN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}


def apart(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether [start, end) meets none of the spans, which are sorted and meet none of each other."""
    k = bisect_right(spans, (start, 1 << 62))
    return (k == 0 or spans[k - 1][1] <= start) and (k == len(spans) or end <= spans[k][0])


def cards(text: str, start: int, usual: bool = False) -> list[tuple[int, int]]:
    """The places of the cards in the run of groups at start: cuts at group boundaries, of 13 to 19 digits, with a right
    check digit. Of cuts that overlap, one group or a usual writing goes first, then the whole run, then the leftmost and
    longest; usual leaves only the first of these."""
    run = RUN.match(text, start)
    groups = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, start, run.end())]
    begin = 1 if re.match(r"[\w.+-]", text[start - 1 : start]) else 0
    end = len(groups) - 1 if re.match(r"[\w-]", text[run.end() : run.end() + 1]) else len(groups)
    found = []
    for i in range(begin, end):
        digits = ""
        for j in range(i, end):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn_ok(digits):
                rank = 0 if i == j or tuple(e - s for s, e in groups[i : j + 1]) in CARD_GROUPS else 1 if (i, j) == (0, len(groups) - 1) else 2
                if not (usual and rank):
                    found.append((rank, groups[i][0], -groups[j][1]))
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(found):
        if apart(s, -e, out):
            insort(out, (s, -e))
    return out


def _parts(text: str) -> tuple[str, date, str] | None:
    """(order of the fields, the day, the separator) of a real date; day first where both readings are real."""
    sep = next(c for c in text if c in "-/.")
    a = text.split(sep)
    for order, at in (("ymd", (0, 1, 2)),) if len(a[0]) == 4 else (("dmy", (2, 1, 0)), ("mdy", (2, 0, 1))):
        try:
            return order, date(*(int(a[k]) for k in at)), sep
        except ValueError:
            continue
    return None


def move_number(kind: str, text: str, key: bytes, back: bool = False) -> tuple[str, str] | None:
    """(kind, pseudonym) of a validated match, or None if it isn't one."""
    digits = "".join(c for c in text if c.isdigit())
    n = len(digits)
    if kind == "iban":
        bare = text.replace(" ", "")
        country, body = bare[:2], bare[4:]
        if not 15 <= len(bare) <= 34 or iban_check(country, body) != bare[2:4]:
            return None
        body = move_mixed(body, key, f"iban {country}", back)
        return kind, refill(text, country + iban_check(country, body) + body)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        x = feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", back)
        return kind, ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        if (found := _parts(text)) is None:
            return None
        order, day, sep = found
        day = move_date(day, key, back)
        wide = [len(x) for x in text.split(sep)]
        values = {"y": day.year, "m": day.month, "d": day.day}
        return kind, sep.join(f"{values[c]:0{w}d}" for c, w in zip(order, wide, strict=True))
    if kind == "ssn":
        if not ssn_ok(int(digits)):
            return None
        return kind, refill(text, f"{walk(int(digits), 10**9, key, 'ssn', ssn_ok, back):09d}")
    if kind == "long":
        if not luhn_ok(digits):
            return None
        body = f"{feistel(int(digits[:-1]), 10 ** (n - 1), key, 'card', back):0{n - 1}d}"
        return "card", refill(text, body + luhn_digit(body))
    lead = ""  # what stands before the subscriber's number: a trunk prefix, or 00 or + and a country, and a trunk prefix in brackets
    if text[0] == "0":
        found = re.match(r"00[1-9][0-9]{0,2}(?=[ .-])|0(?=[1-9])", text)
        lead = found[0] if found else ""
        if not lead or not (9 <= n <= 12 if lead == "0" else 7 <= n - len(lead) <= 14):
            return None
    elif text[0] == "+":
        lead = country_code(digits)
        if not 7 <= n - len(lead) <= 14:
            return None
        if re.match(r"\+[0-9]{1,3}[ .-]?\(0\)", text) and digits[len(lead)] == "0":
            lead += "0"
    elif not (7 <= n <= 14 and (text[0] == "(" or re.fullmatch(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}", text))):
        return None
    elif text[0] == "(" and text[1] == "0" and digits[1] != "0":
        lead = "0"
    rest = digits[len(lead) :]
    if text[0].isdigit() and not lead and rest[0] == "0":
        return None
    return "phone", refill(text, lead + move_subscriber(rest, key, back))


def country_code(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3]


def move_subscriber(number: str, key: bytes, back: bool = False) -> str:
    """A number within its country: the same pseudonym however it is written and whether a country stands before it.
    Numbers with and without a leading 0 stay among themselves."""
    n, low = len(number), 10 ** (len(number) - 1)
    x = int(number)
    x = low + feistel(x - low, 9 * low, key, "phone", back) if x >= low else feistel(x, low, key, "phone 0", back) if low > 1 else x
    return f"{x:0{n}d}"


@lru_cache(maxsize=1 << 16)
def _moved(kind: str, text: str, key: bytes, back: bool) -> tuple[str, str] | None:
    return move_number(kind, text, key, back)


@lru_cache(maxsize=1 << 16)
def move_email(text: str, key: bytes, back: bool = False) -> str:
    """Local part and domain move apart from each other, so that people of one domain stay together; the last label
    stays. Letters outside ASCII become keyed ASCII letters, under a digest of the whole local part, so that names that
    differ in such letters alone go different ways (those do not come back)."""
    local, domain = text.split("@")
    tweak = "local"
    if not local.isascii():
        tweak = "local " + hmac.digest(key, local.encode("utf-8", "surrogatepass"), "sha256").hex()
        local = "".join(c if c.isascii() else chr(97 + feistel(ord(c), 0x110000, key, "letter") % 26) for c in local)
    head, _, top = domain.rpartition(".")
    return f"{move_mixed(local, key, tweak, back)}@{move_mixed(head, key, 'domain', back)}.{top}"


def pseudonymise_text(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[dict]]:
    """The text with its values replaced, and what was replaced: kind, start, end (in the old text), pseudonym."""
    if not text:
        return text, []
    taken = emails(text) if "@" in text else []
    found = [("email", s, e, move_email(text[s:e], key, back)) for s, e in taken]
    at, known, ahead = 0, {"long": 0, "phone": 0}, deque()  # how far runs were searched for cards; those ahead bound the search
    while True:
        m = NUMBER.search(text, at, ahead[0][0] if ahead else len(text))
        if not m and not ahead:
            break
        if not m:
            at, end = ahead.popleft()
            found.append(("card", at, end, _moved("long", text[at:end], key, back)[1]))
            at = end
            continue
        kind = m.lastgroup if m.lastgroup not in "st" else "date"
        if known.get(kind, len(text)) < m.end():
            for run in RUN.finditer(text, max(known[kind], m.start())):
                if run.start() >= m.end():
                    break
                known[kind] = run.end()
                if run.end() - run.start() >= 13:
                    ahead = deque(sorted({*ahead, *(x for x in cards(text, run.start(), usual=kind == "phone") if apart(*x, taken) and apart(*x, list(ahead)))}))
            if ahead:
                continue
        made = _moved(kind, m[0], key, back) if apart(m.start(), m.end(), taken) else None
        if kind == "long" and not made and (phone := PHONE.match(text, m.start())) and apart(phone.start(), phone.end(), taken):
            m, made = phone, _moved("phone", phone[0], key, back)
        if made:
            found.append((made[0], m.start(), m.end(), made[1]))
            at = m.end()
        else:
            at = m.start() + 1
            while at < m.end() and text[at - 1].isdigit() and text[at].isdigit():
                at += 1
    if not found:
        return text, []
    found.sort(key=lambda x: x[1])
    out, upto = [], 0
    for _, s, e, new in found:
        out += [text[upto:s], new]
        upto = e
    return "".join([*out, text[upto:]]), [{"kind": k, "start": s, "end": e, "pseudonym": p} for k, s, e, p in found]


SPANS = T.ArrayType(T.StructType([field("kind", T.StringType()), field("start", T.LongType()), field("end", T.LongType()), field("pseudonym", T.StringType())]))


def _replaced(df: DataFrame, id_col: str, text_col: str, key: bytes, keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, _text, _keep (a struct, so that no name can clash), pii."""
    rest = [df.schema[c] for c in keep] or [field("none", T.BooleanType())]
    schema = T.StructType([field("_id", id_type(df, id_col)), field("_text", T.StringType()), field("_keep", T.StructType(rest)), field("pii", SPANS)])

    def each(ids: list, texts: list, others: list) -> list[list]:
        made = [pseudonymise_text(t, key) for t in texts]
        return [ids, [t for t, _ in made], others, [p for _, p in made]]

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in keep) if keep else [F.lit(None).cast("boolean").alias("none")]).alias("_keep"))
    return map_rows(rows, ["_id", "_text", "_keep"], schema, each)


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes) -> DataFrame:
    """One row per input row: id, text with every value replaced, and pii (array of kind, start, end, pseudonym; places
    in the old text, in code points).

    Null and empty texts stay as they are and hold nothing. Repeated rows give repeated results, an empty table none;
    other columns are ignored. Texts are searched whole, in time linear in their length, a few hundred rows at a time;
    a value of any length moves in chunks. The key has no default; op2 uses one for demonstration.
    """
    return _replaced(df, id_col, text_col, key).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "pii")


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes, length_col: str | None = None) -> DataFrame:
    """The rows of df, with all their columns, and every value in their texts replaced; length_col, if given and there,
    follows the text where that changed."""
    rest = tuple(c for c in df.columns if c not in (id_col, text_col))
    found = _replaced(df, id_col, text_col, key, rest)
    source = {id_col: F.col("_id"), text_col: F.col("_text")}
    if length_col in rest:
        old = F.col(f"_keep.{length_col}")
        source[length_col] = F.when(F.size("pii") > 0, F.length("_text").cast(df.schema[length_col].dataType)).otherwise(old)
    return found.select(*(source.get(c, F.col(f"_keep.{c}")).alias(c) for c in df.columns))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, the number of values of each kind, and their places."""
    found = pseudonymise(table(spark, sf_dir, "documents"), key=DEMO_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    where = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "text", *(count(k) for k in KINDS), where.alias("spans"))
