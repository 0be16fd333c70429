"""PII: format-preserving Feistel pseudonyms.

Validated personal values in a text are replaced by keyed permutations within
their own format: a card number stays a card number with a right check digit, a
date stays a date, an address stays an address.  One key maps equal values to
equal pseudonyms in all documents, different ones to different ones, and
``restore`` undoes it.  A value is ranked among all values of its format, the
rank is permuted by a Feistel network over its bits, walking until it falls
within the format again, and written back with the same signs and letter cases.

Kinds, in order of precedence: email addresses, dates (years 1900 to 2099 that
exist), IPv4 addresses (octets of 0 to 255), IBANs (check digits), secrets (hex
strings of 32 or more digits), telephone numbers (a leading + or a bracketed
area code, 7 to 15 digits), social security numbers (by form alone: also those
of areas that are not given out, as a text may have them all the same), card numbers (13 to 19
digits with a right Luhn digit) and other runs of 9 to 19 digits.

What looks like a value and isn't valid is tried again without its last words,
as the other kinds, and from its later words on, so a value is found whatever
digits or capitals stand beside it, and has the pseudonym that it has elsewhere.
A price of this: beside other digits, about one pseudonym in ten can make a
valid card with them (one in 97 an IBAN), and ``restore`` then reads that
instead.  Values that stand apart are always restored.

Only the ASCII digits are digits of a value; numbers in other digits stay, and are
not counted.  A date has one pseudonym however it is written: it goes to dates
whose month and day have as many digits.

Defined cases: null texts stay null, empty ones empty; texts without a value
stay as they are, byte for byte; repeated rows get equal results; very long
texts are searched whole; all columns are kept, only the text column changes (and
one with the name of the column of counts, which takes its place).
Every row is handled alone, so nothing is shuffled.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from .features import DIGIT
from .kernels import column_buffer, released

ROUNDS = 10
MEMO_ENTRIES = 200_000
LONGEST = 256  # characters permuted as one number
KINDS = ["email", "date", "ipv4", "iban", "secret", "phone", "ssn", "card", "number"]
#: What stands before, in and behind a value of each kind.
PATTERNS = {
    "email": ("", r"[\w.+%-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[A-Za-z]{2,}", ""),
    "date": (r"(?<![\w.-])", r"(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4})", r"(?![\w-]|\.[0-9])"),
    "ipv4": (r"(?<![\w.])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?!\w|\.[0-9])"),
    "iban": (r"(?<!\w)", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?!\w)"),
    "secret": (r"(?<!\w)", r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})", r"(?!\w)"),
    "phone": (r"(?<!\w)", r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})", r"(?!\w|-[0-9])"),
    "ssn": (r"(?<![\w-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?!\w|-[0-9])"),
    "number": (r"(?<!\w)", r"(?:[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{9,19})", r"(?!\w)"),
}
FIND = re.compile("|".join(f"{before}(?P<{kind}>{body}){behind}" for kind, (before, body, behind) in PATTERNS.items() if kind != "email"))
DOMAIN = re.compile(r"(?<=\w)@\w[\w-]*(?:\.\w[\w-]*)*\.[A-Za-z]{2,}")  # an address is looked for from its @
LOCAL = re.compile(r"[\w.+%-]")
ALONE = {kind: re.compile("".join(parts)) for kind, parts in PATTERNS.items()}
BODY = {kind: re.compile(PATTERNS[kind][1]) for kind in ("iban", "phone", "number")}  # the kinds of several words
ORDER = list(PATTERNS)
WORD_END, WORD_START = re.compile(r"(?<=\w)(?!\w)"), re.compile(r"(?<!\w)[\w+(]")
USUAL_CARD = re.compile(r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}")
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, HEX_LOWER, HEX_UPPER = "0123456789", "0123456789abcdef", "0123456789ABCDEF"


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        if n <= 1:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, half // 8 + 1
        rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                other = a if back else b
                word = hashlib.blake2b(other.to_bytes(size, "big") + bytes([r]) + tweak, key=self.key, digest_size=min(64, size + 7)).digest()
                mixed = int.from_bytes(word, "big") & mask
                a, b = (b ^ mixed, a) if back else (b, a ^ mixed)
            x = a << half | b
            if x < n:
                return x

    def forward(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, False)

    def back(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, True)


def local_start(text: str, sign: int) -> int:
    """Where the part of an address before its @ begins."""
    start = sign
    while start > 0 and LOCAL.match(text, start - 1):
        start -= 1
    return start


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def is_card(bare: str) -> bool:
    return 13 <= len(bare) <= 19 and luhn(bare[:-1]) == int(bare[-1])


def holds_card(text: str) -> bool:
    """Of more than four groups, the first four are a card of their own."""
    first = re.match(r"\d{4}(?:[ -]\d{4}){3}(?=[ -])", text)
    return bool(first) and is_card(re.sub(r"\D", "", first.group()))


def ends(kind: str, text: str, start: int, stop: int) -> list[int]:
    """Where a value that begins at start may end, stop or an earlier end of a word, in the order in which to try them."""
    if kind not in BODY:
        return [stop]
    out = [e.start() for e in WORD_END.finditer(text, start, stop) if e.start() < stop and BODY[kind].fullmatch(text, start, e.start())] + [stop]
    if kind == "number":
        return out  # a card of four groups before a longer one: what follows it may be anything
    out.reverse()
    if kind == "iban":  # the length that its country has, then the longest
        out.sort(key=lambda e: len(text[start:e].replace(" ", "")) != IBAN_LENGTH.get(text[start : start + 2]))
    return out


def iban_check(country: str, rest: str) -> str:
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - value % 97:02d}"


class Pseudonyms:
    """Replaces (or restores) the values of a text under one key."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.reverse = Feistel(key), back
        self.memo: dict[tuple[str, str], str | None] = {}

    def permute(self, rank: int, n: int, tweak: str) -> int:
        return (self.feistel.back if self.reverse else self.feistel.forward)(rank, n, tweak.encode())

    def characters(self, text: str, kind: str, alphabets: list[str]) -> str:
        """Permute the characters that have an alphabet, as one mixed-radix number (LONGEST of them at a time); others stay."""
        if len(text) > LONGEST:
            cut = range(0, len(text), LONGEST)
            return "".join(self.characters(text[i : i + LONGEST], f"{kind}{i}/{len(text)}", alphabets[i : i + LONGEST]) for i in cut)
        rank, n = 0, 1
        for c, own in zip(text, alphabets, strict=True):
            if own:
                rank, n = rank * len(own) + own.index(c), n * len(own)
        rank = self.permute(rank, n, kind + ",".join(str(len(a)) for a in alphabets if a))
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if own := alphabets[i]:
                rank, digit = divmod(rank, len(own))
                out[i] = own[digit]
        return "".join(out)

    def digits(self, text: str, kind: str) -> str:
        return self.characters(text, kind, [DIGITS if c in DIGITS else "" for c in text])

    def date(self, text: str) -> str | None:
        parts = re.split(r"([-/.])", text)
        a, b, c = (int(parts[i]) for i in (0, 2, 4))
        year_first = len(parts[0]) == 4
        year, month, day = (a, b, c) if year_first else (c, b, a)
        swapped = not year_first and month > 12  # month before day
        if swapped:
            month, day = day, month
        try:
            rank = datetime.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= rank < DAYS:
            return None
        widths = [len(parts[i]) for i in (0, 2, 4)]

        # Within the dates that every way of writing this one can hold: so all its spellings get the same date.
        shape = lambda d: (d.month < 10, d.day < 10, d.day > 12)
        own = shape(datetime.date(year, month, day))
        while True:
            rank = self.permute(rank, DAYS, "date")
            d = datetime.date.fromordinal(rank + FIRST_DAY)
            if shape(d) == own:
                fields = (d.year, d.month, d.day) if year_first else (d.month, d.day, d.year) if swapped else (d.day, d.month, d.year)
                return parts[1].join(str(f).zfill(w) for f, w in zip(fields, widths, strict=True))

    def value(self, kind: str, text: str) -> tuple[str, str] | None:
        """(kind, pseudonym) of a match, or None if it isn't valid."""
        if kind == "email":
            local = text.rindex("@")
            top = text.rindex(".")
            of = lambda c: LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else ""
            return kind, self.characters(text, kind, [of(c) if i < top and i != local else "" for i, c in enumerate(text)])
        if kind == "date":
            out = self.date(text)
            return (kind, out) if out else None
        if kind == "ipv4":
            octets = text.split(".")
            if any(int(o) > 255 or o != str(int(o)) for o in octets):
                return None
            rank = self.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, kind)
            return kind, ".".join(map(str, rank.to_bytes(4, "big")))
        if kind == "iban":
            bare = text.replace(" ", "")
            if not 15 <= len(bare) <= 34 or iban_check(bare[:2], bare[4:]) != bare[2:4]:
                return None
            rest = self.characters(bare[4:], kind + bare[:2], [DIGITS if c in DIGITS else UPPER for c in bare[4:]])
            fresh = iter(bare[:2] + iban_check(bare[:2], rest) + rest)
            return kind, "".join(" " if c == " " else next(fresh) for c in text)
        if kind == "secret":
            alphabet = HEX_UPPER if any(c in UPPER for c in text) else HEX_LOWER
            return kind, self.characters(text, kind + alphabet[-1], [alphabet] * len(text))
        bare = re.sub(r"\D", "", text)
        if kind == "phone":
            return (kind, self.digits(text, kind)) if 7 <= len(bare) <= 15 else None
        if kind == "ssn":
            return kind, self.digits(text, kind)
        if is_card(bare):
            while True:  # a card of more than four groups goes to such cards
                body = self.digits(bare[:-1], "card")
                bare = body + str(luhn(body))
                fresh = iter(bare)
                out = "".join(next(fresh) if c in DIGITS else c for c in text)
                if holds_card(text) or not holds_card(out):
                    return "card", out
        if not 9 <= len(bare) <= 19:
            return None
        while True:  # numbers without a check digit go to such numbers
            text = self.digits(text, "number")
            if not is_card(re.sub(r"\D", "", text)) and not holds_card(text):
                return "number", text

    def known(self, kind: str, text: str) -> tuple[str, str] | None:
        if len(text) > LONGEST:
            return self.value(kind, text)
        key = (kind, text)
        if key not in self.memo:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[key] = self.value(kind, text)
        return self.memo[key]

    def valid(self, text: str, start: int, kinds: list[str], inner: bool = False) -> tuple[int, tuple[str, str]] | None:
        """(end, (kind, pseudonym)) of the first valid value that begins at start, mere numbers left out; inner: only usual cards."""
        for kind in kinds:
            if found := ALONE[kind].match(text, start):
                for end in ends(kind, text, start, found.end()):
                    if inner and kind == "number" and not USUAL_CARD.fullmatch(text, start, end):
                        continue
                    got = self.known(kind, text[start:end])
                    if got and got[0] != "number":
                        return end, got
        return None

    def number(self, text: str, start: int) -> tuple[int, tuple[str, str]] | None:
        """The longest mere number that begins at start."""
        found = ALONE["number"].match(text, start)
        for end in reversed(ends("number", text, start, found.end())) if found else ():
            if got := self.known("number", text[start:end]):
                return end, got
        return None

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and the number of values of each kind."""
        counts: dict[str, int] = {}
        out, done, at = [], 0, 0
        found, sign, run = FIND.search(text), text.find("@"), -1  # run: where the part before the sign begins
        while True:
            if found and found.start() < at:
                found = FIND.search(text, at)
            while 0 <= sign and not (sign > at and DOMAIN.match(text, sign)):
                sign, run = text.find("@", sign + 1), -1
            if sign >= 0 and run < 0:
                run = local_start(text, sign)
            if not found and sign < 0:
                break
            start, stop, kind = (*found.span(), found.lastgroup) if found else (len(text), 0, "")
            if sign >= 0 and (first := max(at, run)) <= start:
                start, stop, kind = first, DOMAIN.match(text, sign).end(), "email"
            got = self.valid(text, start, ORDER[ORDER.index(kind) :])
            end = got[0] if got else stop
            if not got or got[1][0] in ("phone", "card") and re.match(r"[ ./-]\w", text[end : end + 2]):
                # a valid value that begins in a mere number, or in one of telephones or cards and reaches beyond it, comes first
                # (of two cards the first)
                kinds = ORDER[:-1] if got and got[1][0] == "card" else ORDER
                inner = (s.start() for s in WORD_START.finditer(text, start + 1, end))
                first = next((s for s in inner if (v := self.valid(text, s, kinds, inner=True)) and (not got or v[0] > end)), None)
                if first is not None:
                    before, more = self.replace(text[start:first])
                    for kind, n in more.items():
                        counts[kind] = counts.get(kind, 0) + n
                    out += [text[done:start], before]
                    done = at = first
                    continue
            got = got or self.number(text, start)
            if got is None:
                at = start + 1
                continue
            end, (kind, own) = got
            counts[kind] = counts.get(kind, 0) + 1
            out += [text[done:start], own]
            done = at = end
        return "".join(out) + text[done:], counts


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", counts_col: str | None = "pii", back: bool = False) -> DataFrame:
    """docs with the text column replaced; counts_col: map of kind -> values replaced (empty if none)."""
    kept = [c for c in docs.columns if c not in (text_col, counts_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(0).alias("row"), F.col(text_col).alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, back)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                column = part.column("text")
                data, offsets = column_buffer(column)
                # every kind has a digit or an @
                sums = np.concatenate(([0], np.cumsum(DIGIT[data] | (data == 0x40))))
                maybe = np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])
                texts, counts = column.to_pylist() if len(maybe) else None, [()] * part.num_rows
                for i in maybe.tolist():
                    texts[i], found = own.replace(texts[i])
                    counts[i] = list(found.items())
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "text": pa.array(texts, pa.string()) if texts else column, "n": pa.array(counts, pa.map_(pa.string(), pa.int32()))})

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("text", StringType()), StructField("n", MapType(StringType(), IntegerType()))]))
    of = {c: F.col(f"row.`{c}`").alias(c) for c in kept} | {text_col: F.col("text").alias(text_col)}
    return out.select(*[of[c] for c in docs.columns if c != counts_col], *([F.col("n").alias(counts_col)] if counts_col else []))
