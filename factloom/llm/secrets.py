"""Secret scans: fixed key shapes, and sliding-window entropy over candidate strings.

A candidate is a run of key characters outside the fixed shapes' spans. Its
character class (hexadecimal, letters and digits, or the base64 alphabets) sets
the window and the least Shannon entropy; the entropy of each window comes from
the last one's character counts, with one character leaving and one entering.

What looks random and is no secret is suppressed: strings of the allow-list
(UUIDs, digests by what stands before them or their own name, numbers alone),
sequences of the alphabet, and names. A name (a path, an identifier, a slug, a
sentence joined by dashes) falls into long pieces at its separators and humps,
while pieces of a random string are one or two characters long. A string with a
long part in which digits and letters change places three times is no name,
whatever stands before that part: a prefix, or an address.

Spans are kind:start:end in code points, end exclusive. A null text counts as
empty; an empty text has no spans; repeated rows each get theirs; an empty
table gives an empty result. Only the id and text columns are read. Time is
linear in the text, whatever its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256
from math import log2

from pyspark.sql import DataFrame

from ._frames import long, per_text, string

KINDS = ("assign", "access", "hex", "entropy")
_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: The pieces of a candidate: a run of letters of one case (one capital before small ones), or of digits.
_PARTS = re.compile(r"[-_/.=+]+")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")


@dataclass(frozen=True)
class CharClass:
    """A candidate made of these characters only is judged by this window and limit (bits a character)."""

    name: str
    pattern: str
    window: int
    least_bits: float


@dataclass(frozen=True)
class Scan:
    """A candidate whose pieces have name_piece characters or more on average is a name; one of whose steps sequence_share go to the next character is a sequence."""

    classes: tuple[CharClass, ...] = (
        CharClass("hex", r"[0-9a-fA-F]+", 20, 3.0),
        CharClass("alnum", r"[A-Za-z0-9]+", 20, 3.5),
        CharClass("base64", r"[A-Za-z0-9+/_=.-]+", 20, 3.7),
    )
    #: Whole candidates that look random and are no secrets: UUIDs, digests by their own name, numbers alone.
    allow: tuple[str, ...] = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i)(sha(1|224|256|384|512)|md5)[-=].*", r"[0-9+/_=.-]+")
    #: What stands right before a candidate that is a digest named as such.
    allow_before: tuple[str, ...] = (r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|digest|etag|commit|uuid)(sum)?[\"']?[\x20:=(-]{1,3}[\"']?$",)
    name_piece: float = 3.0
    random_part: int = 16
    random_changes: int = 3
    sequence_share: float = 0.5


def entropy_steps(counts: int) -> list[float]:
    """x * log2(x) for x up to counts: what a character seen x times takes from the entropy."""
    return [0.0] + [x * log2(x) for x in range(1, counts + 1)]


def top_window_entropy(value: str, window: int) -> float:
    """The greatest Shannon entropy of any window of value, by incremental counts."""
    window = min(window, len(value))
    if not window:
        return 0.0
    terms = entropy_steps(window)
    counts: dict[str, int] = {}
    total = 0.0
    for c in value[:window]:
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
    least = total
    for old, new in zip(value, value[window:], strict=False):
        if old != new:
            n = counts[old]
            total += terms[n - 1] - terms[n]
            counts[old] = n - 1
            n = counts.get(new, 0)
            total += terms[n + 1] - terms[n]
            counts[new] = n + 1
            least = min(least, total)
    return log2(window) - least / window


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """assign, access and hex spans in kind order, each leftmost and non-overlapping."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def has_random_part(value: str, scan: Scan) -> bool:
    """A part between separators is long and not hexadecimal, and digits and letters change places in it (random_changes digit runs, one less from 28 characters on), or letters and cases do as in no name."""
    for part in _PARTS.split(value):
        if len(part) >= scan.random_part and not _ALL_HEX.fullmatch(part):
            pieces = _PIECE.findall(part)
            digits = sum(p[0].isdigit() for p in pieces)
            if digits >= scan.random_changes - (len(part) >= 28) or digits and len(part) < scan.name_piece * len(pieces):
                return True
    return False


def is_name(value: str, scan: Scan) -> bool:
    if has_random_part(value, scan):
        return False
    pieces = _PIECE.findall(value)
    return bool(pieces) and sum(map(len, pieces)) >= scan.name_piece * len(pieces)


def is_sequence(value: str, scan: Scan) -> bool:
    return sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:], strict=False)) >= scan.sequence_share * (len(value) - 1)


def entropy_spans(text: str, scan: Scan, taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Spans of random-looking candidates that overlap none of those taken."""
    found, ranges, k = [], sorted((a, b) for _, a, b in taken), 0
    for m in _CANDIDATE.finditer(text):
        start, value = m.start(), m[0].rstrip(".-=_") + "=" * min(2, len(m[0]) - len(m[0].rstrip("=")))
        end = start + len(value)
        while k < len(ranges) and ranges[k][1] <= start:
            k += 1
        if len(value) < 20 or k < len(ranges) and ranges[k][0] < end:
            continue
        kind = next((c for c in scan.classes if re.fullmatch(c.pattern, value)), None)
        # hexadecimal strings have no names among them but those of letters alone
        if not kind or (value.isalpha() if kind.name == "hex" else is_name(value, scan)) or is_sequence(value, scan):
            continue
        if top_window_entropy(value, kind.window) < kind.least_bits:
            continue
        if any(re.fullmatch(p, value) for p in scan.allow) or any(re.search(p, text[max(0, start - 24) : start]) for p in scan.allow_before):
            continue
        found.append(("entropy", start, end))
    return found


def joined(spans: list[tuple[str, int, int]], by_kind_first: bool = False, kinds: tuple[str, ...] = KINDS) -> str:
    order = (lambda s: (kinds.index(s[0]), s[1])) if by_kind_first else (lambda s: (s[1], kinds.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))


def scanned(text: str, scan: Scan) -> tuple:
    base = base_spans(text)
    more = entropy_spans(text, scan, base)
    count = lambda kind: sum(s[0] == kind for s in base)
    return count("assign"), count("access"), count("hex"), len(more), sha256(joined(base).encode()).hexdigest(), joined(base + more)


def secret_scan(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: how many of each kind, a digest of the fixed shapes' spans, and all spans."""
    fields = [*long("n_assign", "n_access", "n_hex", "n_entropy"), *string("base_sha256", "spans")]
    return per_text(docs, lambda text: scanned(text, scan), fields, id_col, text_col)
