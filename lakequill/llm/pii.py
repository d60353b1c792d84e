"""PII: format-preserving Feistel pseudonyms.

Validated numbers and dates are found in whole texts and permuted, under a key, within their own format: a card number
becomes another of the same length and issuer digit that passes the check digit, a phone number another one, an address
another address, a date another date of the same form, and so on. The permutation depends on the key and the format
alone, so equal values get equal pseudonyms in every document and stay linked. Length in characters never changes.

What is found: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), phone numbers (+1 and ten digits; ten digits as
(ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd; + and 8 to 15 digits in two groups or more), IPv4 addresses, social security
numbers, ISO and slashed dates, mail addresses (the local part), and secrets assigned in quotes (hex digits).
What fails its validation is left as it is, and the search goes on inside it. Left out: phone numbers without a
separator or a plus sign, domains of mail addresses, IPv6 addresses, written-out dates, digits other than ASCII's.

Values of one form are permuted among themselves, so different values keep different pseudonyms. Of the slashed dates,
those that can be read month first are one form, those that can only be read day first (a day after the 12th) another.

A card number ends where its digits do or at a blank, as more numbers may follow: of those that begin at one place an
ungrouped one or one in usual groups (fours, 4-6-5, 4-6-4) goes first. Groups of any other size count where they hold
no such card and no other value: all that the pattern takes, or less where all but the last have four digits or more.

Defined cases: a null text stays null; an empty text stays empty; values inside longer words or numbers are not values; the
key must be given, and an empty one is refused.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import small_batches

ROUNDS = 10
#: One value is remembered per task up to this many; then the memory starts anew.
REMEMBERED = 100_000

OTHERS = (
    r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<mail>(?<![\w.+-])\w[\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"'])(?P<hex>[0-9A-Fa-f]{16,})(?=[\"']))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/]|-[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w(])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?!\w)"
    r"|(?<![\w.-])[0-9]{3}(?P<sep>[.-])[0-9]{3}(?P=sep)[0-9]{4}(?![\w-]|\.[0-9])|(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w))"
)
NO_CARD = re.compile(OTHERS)
PATTERN = re.compile(OTHERS + r"|(?P<card>(?<![\w-])(?:[0-9][ -]?){12,18}[0-9](?![\w]|-[0-9]))")
DIGITS, CARD_END = re.compile(r"[0-9]+"), re.compile(r"(?![\w]|-[0-9])")

#: Every value holds one of these, so texts without them need no search.
SIGN = r"[0-9@]|(?i:token|secret|passw|key)"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def check_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def cards(text: str, at: int) -> list[tuple[int, list[int]]]:
    """End and sizes of the groups of every valid card number that begins at a place, by length."""
    out, sizes, digits = [], [], ""
    while (group := DIGITS.match(text, at)) and len(digits) + len(group[0]) <= 19:
        digits, at = digits + group[0], group.end()
        sizes.append(len(group[0]))
        if len(digits) >= 13 and CARD_END.match(text, at) and luhn(digits) and digits.strip("0"):
            out.append((at, sizes[:]))
        if text[at : at + 1] not in (" ", "-"):
            break
        at += 1
    return out


def usual(sizes: list[int]) -> bool:
    return len(sizes) == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or set(sizes[:-1]) == {4} and sizes[-1] <= 4


class Feistel:
    """Keyed permutations of the numbers below any size, by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def permute(self, value: int, size: int, kind: str, back: bool = False) -> int:
        """value's image below size; kind separates the formats. back inverts."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, tweak = (1 << half) - 1, f"{kind}:{size}:".encode()
        steps = range(self.rounds - 1, -1, -1) if back else range(self.rounds)
        while True:
            left, right = value >> half, value & mask
            for r in steps:
                if back:
                    left, right = right ^ self._round(r, left, tweak, mask), left
                else:
                    left, right = right, left ^ self._round(r, right, tweak, mask)
            value = left << half | right
            if value < size:
                return value

    def _round(self, r: int, x: int, tweak: bytes, mask: int) -> int:
        told = hashlib.blake2b(tweak + bytes([r]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.key, digest_size=32).digest()
        return int.from_bytes(told, "big") & mask


def refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    given = iter(digits)
    return "".join(next(given) if c in "0123456789" else c for c in form)


#: The first and one past the last day that dates are permuted among, and those of them that only read day first.
DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())
LATE_DAYS = [d for d in range(*DAYS) if datetime.date.fromordinal(d).day > 12]
LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789"
HEX = "0123456789abcdef"


class Pseudonyms:
    def __init__(self, key: bytes):
        self.cipher, self.known = Feistel(key), {}

    def text(self, text: str) -> str:
        out, done, at, tried = [], 0, 0, 0
        while found := PATTERN.search(text, at):
            begin, end = found.span()
            if found.lastgroup == "card":
                end = self._card_end(text, begin, end, begin >= tried)
                tried = max(tried, found.end())
                new = self._known("card", text[begin:end])
            else:
                new = self._replace(found)
            if new == text[begin:end]:
                # Not valid: what it holds is searched, from its second group or letter on.
                at = DIGITS.match(text, begin).end() if found.lastgroup == "card" else begin + 1
                continue
            out += [text[done:begin], new]
            done = at = end
        return "".join([*out, text[done:]])

    def _card_end(self, text: str, begin: int, end: int, first: bool) -> int:
        """Where the card number that begins at a place ends; begin where none does. end is that of the longest match."""
        found = cards(text, begin)
        for stop, sizes in found:
            if usual(sizes):
                return stop
        held = [m.start() for m in DIGITS.finditer(text, begin, end) if m.start() > begin and text[m.start() - 1] != "-" and self._begins(text, m.start())]
        for stop, sizes in reversed(found):
            if (stop == end and first or min(sizes[:-1]) >= 4) and not any(h < stop for h in held):
                return stop
        return begin

    def _begins(self, text: str, at: int) -> bool:
        """Whether a card number in usual groups or another value begins at a place."""
        other = NO_CARD.match(text, at)
        return any(usual(sizes) for _, sizes in cards(text, at)) or other is not None and self._replace(other) != other[0]

    def _replace(self, found: re.Match) -> str:
        kind = found.lastgroup
        return self._known("secret" if kind == "hex" else kind, found[0])

    def _known(self, kind: str, value: str) -> str:
        out = self.known.get((kind, value))
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = self.known[kind, value] = self.value(kind, value)
        return out

    def value(self, kind: str, value: str) -> str:
        """The pseudonym of a value, or the value where it is not valid."""
        return getattr(self, f"_{kind}")(value)

    def _number(self, digits: str, kind: str) -> str:
        return str(self.cipher.permute(int(digits), 10 ** len(digits), kind)).zfill(len(digits)) if digits else digits

    def _card(self, value: str) -> str:
        digits = re.sub(r"[^0-9]", "", value)
        if not digits or not luhn(digits) or not digits.strip("0"):
            return value
        body = digits[0] + self._number(digits[1:-1], "card" + digits[0])
        return refill(value, body + check_digit(body))

    def _phone(self, value: str) -> str:
        digits = re.sub(r"[^0-9]", "", value)
        if not value.startswith("+") or value.startswith("+1") and len(digits) == 11:
            return refill(value, digits[:-10] + self._number(digits[-10:], "phone"))
        if not 8 <= len(digits) <= 15:
            return value
        # A country's code has up to three digits; what it may be stays.
        return refill(value, digits[:3] + self._number(digits[3:], "phone" + digits[:3]))

    def _ssn(self, value: str) -> str:
        if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000":
            return value
        areas = [a for a in range(1, 900) if a != 666]
        at = (areas.index(int(value[:3])) * 99 + int(value[4:6]) - 1) * 9999 + int(value[7:]) - 1
        at, serial = divmod(self.cipher.permute(at, len(areas) * 99 * 9999, "ssn"), 9999)
        area, group = divmod(at, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, value: str) -> str:
        # Within its format: each octet keeps its number of digits, so the text keeps its length.
        octets = value.split(".")
        if any(len(o) > 1 and o[0] == "0" for o in octets):
            return value
        ranges = [(0, 10) if len(o) == 1 else (10, 100) if len(o) == 2 else (100, 256) for o in octets]
        at, size = 0, 1
        for o, (a, b) in zip(octets, ranges, strict=True):
            at, size = at * (b - a) + int(o) - a, size * (b - a)
        at, out = self.cipher.permute(at, size, "ip" + "".join(str(len(o)) for o in octets)), []
        for a, b in reversed(ranges):
            at, rest = divmod(at, b - a)
            out.append(str(rest + a))
        return ".".join(reversed(out))

    def _date(self, value: str) -> str:
        for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                day = datetime.datetime.strptime(value, form).date().toordinal()
            except ValueError:
                continue
            if not DAYS[0] <= day < DAYS[1]:
                return value
            if form == "%d/%m/%Y":  # its month-first reading has failed, so the day is after the 12th
                other = LATE_DAYS[self.cipher.permute(bisect.bisect_left(LATE_DAYS, day), len(LATE_DAYS), "day first")]
            else:
                other = DAYS[0] + self.cipher.permute(day - DAYS[0], DAYS[1] - DAYS[0], "date")
            return datetime.date.fromordinal(other).strftime(form)
        return value

    def _letters(self, value: str, alphabet: str, kind: str) -> str:
        """The letters of value that are in alphabet (either case), permuted as one number; all else stays."""
        low = [c for c in value.lower() if c in alphabet]
        at = 0
        for c in low:
            at = at * len(alphabet) + alphabet.index(c)
        at, out = self.cipher.permute(at, len(alphabet) ** len(low), f"{kind}{len(low)}"), []
        for _ in low:
            at, rest = divmod(at, len(alphabet))
            out.append(alphabet[rest])
        given = iter(reversed(out))
        return "".join((n.upper() if c.isupper() else n) if c.lower() in alphabet and (n := next(given)) else c for c in value)

    def _mail(self, value: str) -> str:
        local, _, domain = value.partition("@")
        return f"{self._letters(local, LOCAL, 'mail')}@{domain}"

    def _secret(self, value: str) -> str:
        cut = len(value) - len(re.search(r"[0-9A-Fa-f]+$", value)[0])
        return value[:cut] + self._letters(value[cut:], HEX, "secret")

    def _iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        letters = lambda s: "".join(str(int(c, 36)) for c in s)
        if not 15 <= len(plain) <= 34 or int(letters(plain[4:] + plain[:4])) % 97 != 1:
            return value
        digits = self._number("".join(c for c in plain[4:] if c.isdigit()), "iban" + plain[:2])
        body = refill(plain[4:], digits)
        whole = iter(plain[:2] + f"{98 - int(letters(body + plain[:2] + '00')) % 97:02d}" + body)
        return "".join(c if c == " " else next(whole) for c in value)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text column rewritten; all other columns and the schema stay as they are. No row moves.

    Who has the key can invert the pseudonyms: it is the caller's to choose and to keep.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = key.encode()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(secret)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                column = part.column(at)
                some = pc.fill_null(pc.match_substring_regex(column, SIGN), False)
                new = pa.array([names.text(t) for t in column.filter(some).to_pylist()], type=column.type)
                yield part.set_column(at, batch.schema.field(at), pc.replace_with_mask(column, some, new))

    return small_batches(docs).mapInArrow(run, docs.schema)


def pseudonym_rows(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_chars, changed, text: every document with its values replaced."""
    slim = docs.select("doc_id", F.col("text"), F.sha2(F.col("text"), 256).alias("before"))
    out = pseudonymise(slim, key)
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.sha2(F.col("text"), 256) != F.col("before"), F.lit(False)).alias("changed"), "text")
