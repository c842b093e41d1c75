"""Named regex blocks and line templates.

A template is Java regex text in which ``{field:block}`` captures a block into
a field and ``{:block}`` only matches it.  Templates are expanded once on the
driver into a plain Java regex with numbered groups, because Spark's regex
functions know no named groups.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass


def _ipv6() -> str:
    """RFC 4291 text forms, longest first, built from the grammar in RFC 3986."""
    h = "[0-9A-Fa-f]{1,4}"
    tail = f"(?:{h}:{h}|{{:ipv4}})"
    forms = [f"(?:{h}:){{6}}{tail}", f"::(?:{h}:){{5}}{tail}"]
    for lead in range(5):
        forms.append(f"(?:(?:{h}:){{0,{lead}}}{h})?::(?:{h}:){{{4 - lead}}}{tail}")
    forms.append(f"(?:(?:{h}:){{0,5}}{h})?::{h}")
    forms.append(f"(?:(?:{h}:){{0,6}}{h})?::")
    return "(?:" + "|".join(forms) + r")(?:%[\w.-]+)?"


def numerals(low: int, high: int, width: int = 2, exact: bool = False) -> str:
    """Decimal numbers low..high, by their leading digits; leading zeros up to ``width`` are optional, or must be there."""
    if width == 1:
        return f"[{low}-{high}]" if low < high else str(low)
    size = 10 ** (width - 1)
    parts, full = [], ""
    for lead in range(high // size, low // size - 1, -1):
        a, b = max(low - lead * size, 0), min(high - lead * size, size - 1)
        if lead and (a, b) == (0, size - 1):
            full = f"{lead}" + full  # these leads take any digits
        else:
            zero = "0" if exact else "0?"
            parts.append((zero if not lead else f"{lead}") + numerals(a, b, width - 1, exact or lead > 0))
    if full:
        some = full if len(full) == 1 else f"[{full[0]}-{full[-1]}]"
        parts.append(some + "[0-9]" + (f"{{{width - 1}}}" if width > 2 else ""))
    return "(?:" + "|".join(parts) + ")"


def named(names: list[str]) -> str:
    """Calendar names, in full or as their first three letters."""
    return "(?:" + "|".join(n if len(n) == 3 else f"{n[:3]}(?:{n[3:]})?" for n in names) + ")"


# Character sets of RFC 3986: what a path segment and a query may hold.
_PCHAR = r"A-Za-z0-9._~%!$&'()*+,;=:@-"
# RFC 1123: letters, digits and inner hyphens, 63 at most.
_LABEL = "[0-9A-Za-z][0-9A-Za-z-]{0,62}"
_CLOCK = f"{numerals(0, 23)}:[0-5][0-9]:(?:[0-5][0-9]|60)"  # RFC 3339, the leap second included
_DAY = numerals(1, 31)
_MONTH = named([datetime.date(2000, m, 1).strftime("%B") for m in range(1, 13)])

# The tokens of the parsers, by the document that defines them.  Runs that can
# be long are possessive, or start only where such a run does, so that long lines stay linear.
BLOCKS: dict[str, str] = {
    # fields that end at what the template has next
    "data": ".*?",
    "rest": ".*",
    "all": "(?s:.*)",  # line ends included, for assembled events
    "notspace": r"\S+",
    "token": r"\S++",
    "space": r"\s*",
    "word": r"\b\w+",  # a run is tried from its first character only
    "command": ".*",
    # numbers
    "int": "[+-]?[0-9]+",
    "num": r"(?<![0-9.+-])[+-]?[0-9]*+(?:(?<=[0-9])|\.[0-9]+)(?:\.[0-9]+)?",
    "nonnegint": "[0-9]+",
    "posint": "[1-9][0-9]*",
    # RFC 9110: quoted-string
    "quoted": r'"(?:[^"\\]|\\.)*+"',
    # RFC 9562: 8-4-4-4-12 hex digits
    "uuid": "-".join(f"[0-9A-Fa-f]{{{n}}}" for n in (8, 4, 4, 4, 12)),
    # RFC 791, 4291, 1123: addresses and host names
    "ipv4": rf"(?<![0-9]){numerals(0, 255, 3)}(?:\.{numerals(0, 255, 3)}){{3}}(?![0-9])",
    "ipv6": _ipv6(),
    "ip": "(?:{:ipv4}|{:ipv6})",
    "hostname": rf"(?<![0-9A-Za-z.-]){_LABEL}(?:\.{_LABEL})*+\.?",
    "iporhost": "(?:{:hostname}|{:ip})",
    # RFC 5321: a plain local part and a host name of two labels or more
    "email": rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@{_LABEL}(?:\.{_LABEL})++",
    # RFC 3986: scheme, authority, path, query, fragment
    "uriproto": "[A-Za-z][A-Za-z0-9+.-]*",
    "uripath": f"/[/{_PCHAR}]*+",
    "uri": rf"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/?#\"<>]++(?:/[/{_PCHAR}]*+)?(?:\?[/?{_PCHAR}]*+)?(?:#[/?{_PCHAR}]*+)?",
    # RFC 3164: priority, time, program
    "pri": "[0-9]{1,3}",
    "syslogtime": rf"{_MONTH} +{_DAY} {_CLOCK}(?:\.[0-9]+)?",
    "prog": r"[^\s:\[\]]+",
    # RFC 5424: printable characters; structured data, whose values escape quotes, backslashes and brackets
    "printable": "[!-~]+",
    "sdelement": r'(?:\[[^\s\]="]++(?: [^\s\]="]++="(?:[^"\\\]]|\\.)*+")*+\])+',
    # RFC 3339: date-time, and what software writes of it
    "isotime": rf"[0-9]{{4}}-{numerals(1, 12)}-{_DAY}[T ]{numerals(0, 23)}:?[0-5][0-9](?::?(?:[0-5][0-9]|60)(?:[.,][0-9]+)?)?"
    rf"(?:Z|[+-]{numerals(0, 23)}:?[0-5][0-9])?",
    # the times of web servers, Redis, PostgreSQL and of devices
    "httptime": rf"{_DAY}/{_MONTH}/[0-9]{{4}}:{_CLOCK} [+-][0-9]{{4}}",
    "redistime": rf"{_DAY} {_MONTH} {_CLOCK}(?:\.[0-9]+)?",
    "datestamp": rf"[0-9]{{1,4}}(?:[./-][0-9]{{1,4}}){{2}}[- ]{_CLOCK}(?:\.[0-9]+)?",
    "zone": "[A-Z]{3,5}",
    "ciscotime": rf"{_MONTH} +{_DAY}(?: [0-9]{{4}})? {_CLOCK}(?:\.[0-9]+)?(?: [A-Z]{{2,5}})?",
    "patime": "(?:{:syslogtime}|{:isotime})",
    "clock": "[0-9]+:[0-5][0-9]:[0-5][0-9]",
    # account names (POSIX, portable) and terminals
    "username": "[A-Za-z0-9._-]+",
    "tty": r"/dev/(?:pts/|tty)\w+",
    # Cisco: %FACILITY-SEVERITY-MNEMONIC, and the same with numbers on ASA
    "ciscotag": "[A-Z0-9]+-[0-9]+-[A-Z0-9_]+",
    "ciscoprog": r"%[^\s:]+",
    "iosfacility": "[A-Z0-9_-]+?",
    "iosseverity": "[0-7]",
    "iosmnemonic": "[A-Z0-9_]+",
    # cron actions, port names of Palo Alto devices
    "cronaction": "[A-Z ]+",
    "nasport": "[a-z]{3}[0-9]+",
}
# The severity names of RFC 5424 in their long and short forms, and those of common loggers.
LEVEL_NAMES = "emergency emerg alert critical crit error err warning warn notice info debug trace fatal severe".split()
BLOCKS["loglevel"] = f"(?i:{'|'.join(LEVEL_NAMES)})"

_FIELD = re.compile(r"\{(\w*):(\w+)\}")


def register_pattern(name: str, regex: str) -> None:
    """Add or replace a block; other blocks may be used as ``{:block}``."""
    if re.compile(_expand(regex)).groups:
        raise ValueError(f"block {name!r} must use non-capturing groups only")
    BLOCKS[name] = regex


def _expand(regex: str) -> str:
    return _FIELD.sub(lambda m: _expand(BLOCKS[m[2]]), regex)


def block(name: str) -> str:
    """The plain Java regex of a block."""
    return _expand(BLOCKS[name])


@dataclass(frozen=True)
class LinePattern:
    """A Java regex and, per numbered group, the field it fills.

    A field may appear more than once when the groups exclude each other
    (two timestamp forms, for instance): the group that took part wins.  Groups
    inside a look-ahead are no good for that: Java keeps their text when the
    alternative around them fails later.
    """

    regex: str
    groups: tuple[str, ...]
    at_start: bool = False

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.groups))


def line_pattern(template: str, at_start: bool = False) -> LinePattern:
    groups: list[str] = []

    def put(match: re.Match) -> str:
        field, name = match.groups()
        if not field:
            return f"(?:{block(name)})"
        groups.append(field)
        return f"({block(name)})"

    regex = _FIELD.sub(put, template)
    if re.compile(regex).groups != len(groups):
        raise ValueError(f"use (?:...) for grouping in {template!r}")
    return LinePattern(regex, tuple(groups), at_start)
