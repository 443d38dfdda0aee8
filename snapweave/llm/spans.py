"""Spans of text by kind: where they are found, how they are listed and summed up. Positions count code points."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

Span = tuple[str, int, int]

# Each run is taken once, with what makes it an address as an optional tail: a match without the tail is
# none. A long run that leads to nothing would else be tried again from each of its characters.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"(?P<key>password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
DIGIT = re.compile(r"[0-9]")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")

PRIVATE_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def private_spans(text: str) -> Iterator[Span]:
    """E-mail addresses, network addresses, card and phone numbers; a match that fails its test is dropped whole."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            if m[1]:
                yield "email", m.start(), m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(found := _digits(m[0])) <= 19 and luhn(found):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def secret_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Assigned values, access keys and long hex numbers, each with its value."""
    lower = text.lower()
    if any(key in lower for key in ASSIGN_KEYS):
        for m in ASSIGN.finditer(text):
            if len(m["value"]) >= 12:
                yield "assign", m.start(), m.end(), m["value"]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                yield "access", m.start(), m.end(), m[0]
    # A run of hex digits that is long enough begins where the run begins.
    for m in LONG_HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``."""
    order: Callable[[Span], tuple[int, int, int]] = lambda s: (s[1], kinds.index(s[0]), s[2])
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=order))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
