"""Format-preserving pseudonyms for personal data.

What is found is validated first (Luhn, calendar, octets, check digits), then
ranked within the values of its own format and permuted there by a keyed
Feistel network, so equal values stay linked across documents without a table
of values and nothing has to be gathered.  The permutation used is
``P^-1(P(x) + 1)``: a bijection without fixed points, so no value stays as it
was.

Free text (local parts, secrets) is permuted symbol by symbol within each
symbol's own alphabet, so its shape stays and no two values meet.  Long values
are cut into chunks of bounded size; each chunk's network is keyed by the
chunks next to it, forth and back, so the whole is one permutation and every
symbol depends on all others.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, sliced, strings

ROUNDS = 8
KEY = "tideweave-pseudonyms"
#: Symbols that one network permutes at most.
CHUNK = 32
#: Code points among which an alphabet beyond ASCII is taken.
PAGE = 128
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()


# ------------------------------------------------------------------ permutation
class Feistel:
    """A keyed permutation of ``range(n)`` for a named format."""

    def __init__(self, key: str, name: str, n: int) -> None:
        self.n, self.half = n, max(1, -(-(n - 1).bit_length() // 2))
        self.seed = hashlib.blake2b(f"{name}:{n}".encode(), key=key.encode()[:64]).digest()
        self.mask = (1 << self.half) - 1
        self.width = -(-self.half // 8)

    def _mix(self, k: int, x: int) -> int:
        size = min(64, max(8, self.width))
        data, out = bytes([k]) + x.to_bytes(self.width + 1, "big"), b""
        while len(out) < self.width:
            out += hashlib.blake2b(data + out, key=self.seed, digest_size=size).digest()
        return int.from_bytes(out, "big") & self.mask

    def _walk(self, x: int, order: range) -> int:
        """Rounds in the order given, repeated until back inside ``range(n)``."""
        while True:
            left, right = x >> self.half, x & self.mask
            if order.step > 0:
                for k in order:
                    left, right = right, left ^ self._mix(k, right)
            else:
                for k in order:
                    left, right = right ^ self._mix(k, left), left
            x = left << self.half | right
            if x < self.n:
                return x

    def forward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def backward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))

    def __call__(self, x: int) -> int:
        """A permutation without fixed points (for ``n`` over 1)."""
        return self.backward((self.forward(x) + 1) % self.n)


@lru_cache(maxsize=4096)
def feistel(key: str, name: str, n: int) -> Feistel:
    return Feistel(key, name, n)


# -------------------------------------------------------------------- formats
def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def permuted_digits(key: str, name: str, digits: str) -> str:
    n = 10 ** len(digits)
    return str(feistel(key, name, n)(int(digits))).zfill(len(digits))


def card(key: str, found: str) -> str | None:
    """13 to 19 digits with a valid Luhn digit; the first digit stays."""
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    body = digits[0] + permuted_digits(key, "card" + digits[0], digits[1:-1])
    return refill(found, body + str(-luhn_sum(body + "0") % 10))


def phone(key: str, found: str) -> str | None:
    """International or national numbers of 10 to 15 digits; the prefix stays."""
    digits = re.sub(r"\D", "", found)
    if not 10 <= len(digits) <= 15:
        return None
    kept = len(digits) - 10 if found[0] == "+" else 0
    return refill(found, digits[:kept] + permuted_digits(key, "phone", digits[kept:]))


def address(key: str, found: str) -> str | None:
    """IPv4: four octets of at most 255 without leading zeros."""
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = feistel(key, "ipv4", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def ssn(key: str, found: str) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(feistel(key, "ssn", 898 * 99 * 9999)(rank), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def iban_remainder(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def valid_iban(plain: str) -> bool:
    """15 to 34 characters, check digits of 02 to 98 that leave a remainder of 1."""
    return 15 <= len(plain) <= 34 and 2 <= int(plain[2:4]) <= 98 and iban_remainder(plain) == 1


def iban(key: str, found: str) -> str | None:
    """Two letters, check digits with remainder 1, then letters and digits."""
    plain = found.replace(" ", "")
    digits = re.sub(r"[^0-9]", "", plain[4:])
    if not valid_iban(plain) or not digits:
        return None
    body = refill(plain[4:], permuted_digits(key, "iban", digits))
    check = 98 - iban_remainder(f"{plain[:2]}00{body}")
    made = iter(f"{plain[:2]}{check:02d}{body}")
    return re.sub(r"[^ ]", lambda _: next(made), found)


@lru_cache(maxsize=1)
def late_days() -> tuple[list[int], dict[int, int]]:
    """Days from the 13th of a month on, which ``m/d/y`` alone can write, and their ranks."""
    days = [d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]
    return days, {d: i for i, d in enumerate(days)}


def date(key: str, found: str) -> str | None:
    """ISO, ``d.m.y`` and ``d/m/y`` (``m/d/y`` if only that is a date), 1900 to 2099.

    What was ``m/d/y`` becomes a date that is again only that.
    """
    parts = re.split(r"[-./]", found)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        if (y, m, d) == (2, 0, 1):
            days, ranks = late_days()
            moved = days[feistel(key, "date m/d", len(days))(ranks[day])]
        else:
            moved = feistel(key, "date", LAST_DAY - FIRST_DAY + 1)(day - FIRST_DAY) + FIRST_DAY
        new = datetime.date.fromordinal(moved)
        parts[y], parts[m], parts[d] = str(new.year), f"{new.month:02d}", f"{new.day:02d}"
        made = iter(parts)
        return re.sub(r"[0-9]+", lambda _: next(made), found)
    return None


@lru_cache(maxsize=4096)
def _alphabet(page: int, category: str) -> tuple[str, dict[str, int]]:
    """The characters of a category in a page of code points, and their ranks."""
    letters = "".join(c for c in map(chr, range(page * PAGE, (page + 1) * PAGE)) if unicodedata.category(c) == category)
    return letters, {c: i for i, c in enumerate(letters)}


def alphabet(c: str) -> tuple[str, dict[str, int]] | None:
    """The letters or digits that may stand in the character's place; none for other signs.

    A letter is replaced by one of the same case and the same part of Unicode.
    """
    if not c.isalnum():
        return None
    return _alphabet(ord(c) // PAGE, unicodedata.category(c))


class Chunks:
    """A value's ranks in chunks of bounded size, and networks keyed by the neighbours."""

    def __init__(self, key: str, name: str, radix: list[int]) -> None:
        self.key, self.name = key, f"{name}:{len(radix)}"
        self.radix = [radix[i : i + CHUNK] for i in range(0, len(radix), CHUNK)]
        self.sizes = []
        for chunk in self.radix:
            n = 1
            for r in chunk:
                n *= r
            self.sizes.append(n)

    def ranks(self, digits: list[int]) -> list[int]:
        out, at = [], 0
        for chunk in self.radix:
            rank = 0
            for r in chunk:
                rank = rank * r + digits[at]
                at += 1
            out.append(rank)
        return out

    def digits(self, ranks: list[int]) -> list[int]:
        out: list[int] = []
        for rank, chunk in zip(ranks, self.radix, strict=True):
            part = []
            for r in reversed(chunk):
                rank, v = divmod(rank, r)
                part.append(v)
            out += reversed(part)
        return out

    def _pass(self, ranks: list[int], way: str, back: bool) -> list[int]:
        """Every chunk permuted, keyed by a digest of the permuted ones before it."""
        order = range(len(ranks)) if way == "forth" else range(len(ranks) - 1, -1, -1)
        out, chain = list(ranks), b""
        for i in order:
            network = Feistel(self.key, f"{self.name}:{way}:{chain.hex()}", self.sizes[i])
            out[i] = network.backward(ranks[i]) if back else network.forward(ranks[i])
            made = ranks[i] if back else out[i]
            chain = hashlib.blake2b(chain + made.to_bytes(-(-made.bit_length() // 8) or 1, "big"), digest_size=16).digest()
        return out

    def __call__(self, ranks: list[int]) -> list[int]:
        """``P^-1(P(x) + 1)`` with one added to the first chunk that has a choice."""
        if len(ranks) == 1:
            return [feistel(self.key, self.name, self.sizes[0])(ranks[0])]
        moved = self._pass(self._pass(ranks, "forth", False), "back", False)
        i = next(i for i, n in enumerate(self.sizes) if n > 1)
        moved[i] = (moved[i] + 1) % self.sizes[i]
        return self._pass(self._pass(moved, "back", True), "forth", True)


def permuted_text(key: str, name: str, value: str) -> str:
    """Letters and digits permuted together; each keeps its alphabet, other signs stay.

    A bijection on the values of a shape, without fixed points where any
    character has a choice.
    """
    places = [(i, a) for i, c in enumerate(value) if (a := alphabet(c)) is not None and len(a[0]) > 1]
    if not places:
        return value
    chunks = Chunks(key, name, [len(a[0]) for _, a in places])
    digits = chunks.digits(chunks(chunks.ranks([a[1][value[i]] for i, a in places])))
    out = list(value)
    for (i, a), v in zip(places, digits, strict=True):
        out[i] = a[0][v]
    return "".join(out)


def email(key: str, found: str) -> str | None:
    """The local part is permuted within its letters and digits, the domain stays.

    A local part of signs alone has nothing to permute and stays.
    """
    local, _, domain = found.partition("@")
    new = permuted_text(key, "email@" + domain.lower(), local)
    return None if new == local else f"{new}@{domain}"


def secret(key: str, found: str) -> str | None:
    """The value of an assignment to a token, key, secret or password."""
    at = re.search(r"[=:]\s*[\"']?", found).end()
    return found[:at] + permuted_text(key, "secret", found[at:])


def bare_key(key: str, found: str) -> str | None:
    """Access keys known by their prefix, which stays."""
    head = re.match(r"AKIA|gh[pousr]_|sk[-_]", found)[0]
    return head + permuted_text(key, "key" + head, found[len(head) :])


#: Kind, pattern, pseudonym; the first kind whose pattern matches and validates wins.
KINDS: list[tuple[str, str, Callable[[str, str], str | None]]] = [
    ("email", r"(?<![\w.%+'-])[\w.%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    (
        "secret",
        r"(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{8,}",
        secret,
    ),
    ("key", r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9]{20,})\b", bare_key),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?!\w)(?: [A-Z0-9]++(?!\w))*+", iban),
    ("date", r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![\w-])", date),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", address),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?!\w)", phone),
    ("phone", r"(?<![\w+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)", phone),
    ("phone", r"(?<![\w+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])", phone),
    ("card", r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,}(?![\w-])", card),
]
PATTERNS = [(kind, re.compile(pattern), pseudonym) for kind, pattern, pseudonym in KINDS]
#: Every kind holds a digit or an @; texts without either are left at once.
HINT = re.compile(r"[0-9@]|AKIA|gh[pousr]_|sk[-_]|(?i:token|secret|key|passw)")


#: Lengths and first digits that issuers give out.
ISSUED = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|6[0-9]{15}")


def card_runs(start: int, found: str) -> list[tuple[int, int]]:
    """Spans of 13 to 19 digits between group borders of a run of digit groups.

    A card may stand next to its expiry, its code or any other number.  Spans
    that an issuer gives out come first, then earlier and longer ones.
    """
    groups = list(re.finditer(r"[0-9]+", found))
    spans = []
    for i, first in enumerate(groups):
        digits = ""
        for last in groups[i : i + 34]:  # no value has more groups
            digits += last[0]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn_sum(digits) % 10 == 0:
                spans.append((ISSUED.fullmatch(digits) is None, first.start(), -last.end()))
    return [(start + a, start - b) for _, a, b in sorted(spans)]


def iban_runs(start: int, found: str) -> list[tuple[int, int]]:
    """Valid spans of whole groups; other groups may stand before or after them."""
    groups = list(re.finditer(r"[A-Z0-9]+", found))
    spans = []
    for i, first in enumerate(groups):
        if not re.match(r"[A-Z]{2}[0-9]{2}", first[0]):
            continue
        plain = ""
        for last in groups[i : i + 34]:  # no value has more groups
            plain += last[0]
            if len(plain) > 34:
                break
            if valid_iban(plain):
                spans.append((first.start(), -last.end()))
    return [(start + a, start - b) for a, b in sorted(spans)]


#: Kinds whose matches are runs of groups that may hold more than the value.
RUNS = {"card": card_runs, "iban": iban_runs}


def pseudonymise(text: str, key: str = KEY) -> tuple[str, list[str]]:
    """The text with its personal data replaced, and the kinds replaced."""
    if not HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))
    for kind, pattern, pseudonym in PATTERNS:
        for m in pattern.finditer(text):
            for start, end in RUNS[kind](m.start(), m[0]) if kind in RUNS else (m.span(),):
                if covered.find(1, start, end) >= 0:
                    continue
                found = text[start:end]
                new = pseudonym(key, found)
                if new is not None and new != found:
                    taken.append((start, end, kind, new))
                    covered[start:end] = b"\1" * (end - start)
    if not taken:
        return text, []
    taken.sort()
    out, at = [], 0
    for start, end, _, new in taken:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in taken]


def pseudonymise_texts(df: DataFrame, text_col: str = "text", key: str = KEY, prefix: str = "") -> DataFrame:
    """``df`` with its texts pseudonymised, ``n_pii`` and ``pii_kinds`` added.

    ``prefix`` stands before these two names.
    Whole texts; a null text stays null.  ``pii_kinds`` lists the kinds
    replaced, distinct, sorted and comma-joined (empty if none).  Columns of
    ``df`` that are named like the added ones are replaced; repeated rows each
    get a row; an empty table gives an empty result.
    """
    added = [f"{prefix}n_pii", f"{prefix}pii_kinds"]
    own = [f for f in df.schema.fields if f.name.lower() not in added]
    at = [f.name for f in own].index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=at):
            found = part.column(at)
            done = [pseudonymise(t, key) for t in strings(found)]
            kinds = [k for _, k in done]
            new = pa.array(
                [t if ok else None for (t, _), ok in zip(done, found.is_valid().to_pylist(), strict=True)], pa.string()
            )
            columns = [new if i == at else c for i, c in enumerate(part.columns)]
            columns.append(pa.array([len(k) for k in kinds], pa.int64()))
            columns.append(pa.array([",".join(sorted(set(k))) for k in kinds], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    return arrow_map(df.select(*(F.col(f"`{f.name}`") for f in own)), run, f"{schema}, `{added[0]}` long, `{added[1]}` string")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise_texts(docs.select("doc_id", "text"))


QUERIES = {"op8_pii_pseudonyms": op8_pii_pseudonyms}
ORACLES: dict[str, str] = {}
