"""Secret scans by assignment-aware lexing.

Lines of a text that hold an assignment sign are cut into tokens (names, strings with
escapes, triple quotes or prefixes, signs, operators, brackets) and read as assignments
of the usual source and configuration languages: ``name = value``, ``name: value``,
``"name": value``, ``export NAME=value``, ``name := value``, ``name => value``, ``name: type =
value``, ``label: name = value``, ``table["name"] = value``, ``object.name = value``, keyword
arguments, and ``a, b = value, value``. A value is a string, strings that stand side by side or
are joined to each other or to names by ``+``, the same in parentheses over several lines, a
block of indented lines after ``name: |`` or ``name: >``, the items of a list, the strings of a call's arguments (but for what a lookup
looks up), the default after ``or``, ``||`` or ``??``, or a bare word. ``name += value`` adds to what
the name has, ``f"{name}"``, ``"${name}"`` and ``"#{name}"`` hold what it stands for, and a call with a
name and a string as arguments, like ``define("name", "value")``, gives the name the string. A bare word before a
further sign gets the literal as well as the names before it, as it may be a type or a name.

Constants are propagated: a name in a value stands for what it was last given before, or
else is first given after, through any number of steps. A literal made of parts is never put
together beyond ``SHORT`` characters: its length, counts of bytes and ends are enough, so that
chains of any length take linear time. A pair of target name and literal scores the weight of the
most sensitive part of the name times the likeness of the literal to a secret (length,
kinds of characters, entropy of its UTF-8 bytes; nothing for placeholders, references, names of encodings and sentences; a passphrase of
four or more different words counts under a name that ends sensitively). Of a literal that
reaches ``threshold`` under some name each place that it is written in is a finding.

Beside the lexer three fixed patterns (below) give findings of kinds assign,
access and hex.

How Spark runs it: each text alone, without a shuffle, in the scan's partitions.

Defined cases: null text is an empty one; texts without findings have counts 0,
the digest of the empty string and empty spans; repeated rows are scanned each; a text of any
length is scanned whole, in linear time; spans of equal start are ordered by kind and end; an
empty table gives no rows; other columns are ignored by ``find_secrets`` and kept
by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import rows

# The patterns that the query's contract gives.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "key": 0.6, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "private": 0.8, "bearer": 0.9}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|todo|test|your[-_].*|<.*>|\$\{.*\}|\$\w+|%\(.*\)s|\{\{.*\}\})$")
TARGET = re.compile(r"""(?P<quote>["']?)(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z0-9_.\-]++)(?P=quote)(?P<space>[ \t]*+)(?P<sign>:=|=>|=(?!=)|:(?!//))[ \t]*+""")
VALUE = re.compile(r"""(?P<strings>(?:"[^"\n]*"|'[^'\n]*')(?:[ \t]*\+[ \t]*(?:"[^"\n]*"|'[^'\n]*'))*)|[^\s"',;(){}\[\]]+""")
#: A declared type of more than one word, with the assignment sign after it.
DECLARED = re.compile(r"""[&*]?(?:'[a-z_]++[ \t]++)?(?:(?:mut|const)[ \t]++)?[A-Za-z_](?:[A-Za-z0-9_.]|::)*+[?!]?(?:[ \t]*+[\[<|][A-Za-z0-9_ \t.,\[\]<>|&*?]*+)?[ \t]*+=(?![=>])[ \t]*+""")
TYPES = frozenset("str string String bytes char text Text any Any object int float bool number".split())
STRING = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'")


#: Sensitive words that end a name without a sign before them, as in DBPWD.
ENDINGS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 0.9, "secretkey": 1.0, "privatekey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9}
#: Calls whose first argument says what to look up.
LOOKUP = re.compile(r"(?i)(?:get|find|fetch|load|read|look|env|prompt|input|param|propert|query|select|open|request|ask|resolve)")
ENCODING = re.compile(r"(?i)(?:utf|iso|latin|ascii|cp|windows|base64|hex)[-_]?[0-9a-z]*(?:[-_][0-9]+)*")
#: Words of sentences, which passphrases seldom have.
PLAIN = frozenset("a an and are be can do enter for from has have here if in is it must not of on or please should that the this to was will with you your".split())
WORD = re.compile(r"[A-Za-z]{3,}[0-9]?")


def part_weight(part: str) -> float:
    """The weight of a lower-case part of a name, which may be a plural or end with a sensitive word."""
    one = part[:-1] if part.endswith("s") else part
    return max(NAME_WEIGHTS.get(part, 0.0), NAME_WEIGHTS.get(one, 0.0), max((w for e, w in ENDINGS.items() if one.endswith(e)), default=0.0))


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.split(r"[_.\-]+|(?<=[a-z0-9])(?=[A-Z])", name) if p]


def name_weight(name: str) -> float:
    parts = name_parts(name)
    joined = [a + b for a, b in pairwise(parts)]
    return max(map(part_weight, [*parts, *joined]), default=0.0)


def likeness(n: int, counts: list[int], kinds: int) -> float:
    """From 0 to 1, of a literal's length, counts of bytes and number of kinds of characters."""
    total = sum(counts)
    entropy = -sum(c / total * math.log2(c / total) for c in counts)
    return min(1.0, 0.25 * min(n, 20) / 20 + 0.45 * min(entropy, 4) / 4 + 0.1 * kinds)


def coded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def literal_score(literal: str) -> float:
    """From 0 to 1: how much the literal looks like a secret."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or ENCODING.fullmatch(literal) or any(c.isspace() for c in literal):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return likeness(len(literal), list(Counter(coded(literal)).values()), kinds)


def passphrase_score(literal: str) -> float:
    """Four or more different words, none of them a word of sentences."""
    words = literal.split(" ")
    return 0.8 if len(words) >= 4 and len({w.lower() for w in words}) == len(words) and all(WORD.fullmatch(w) and w.lower() not in PLAIN for w in words) else 0.0


#: Literals up to this length are kept as they are, longer ones by what their score needs.
SHORT = 256
BYTE_KINDS = [range(97, 123), range(65, 91), range(48, 58)]
LONG_PLACEHOLDERS = (("<", ">"), ("${", "}"), ("%(", ")s"), ("{{", "}}"))


class Literal:
    """A literal that may be made of parts: its characters up to SHORT of them, and beyond its length, counts of bytes and ends."""

    __slots__ = ("counts", "head", "n", "short", "spaced", "tail")

    def __init__(self, parts: list[Literal]) -> None:
        self.n = sum(p.n for p in parts)
        self.short = "".join(p.short for p in parts) if self.n <= SHORT else None
        self.counts = None
        if self.short is None:
            self.counts = sum((p.histogram() for p in parts), np.zeros(256, "int64"))
            self.head, self.tail, self.spaced = "", "", any(p.has_space() for p in parts)
            for p in parts:
                self.head = (self.head + (p.head if p.short is None else p.short))[:8]
                self.tail = (self.tail + (p.tail if p.short is None else p.short))[-8:]

    @classmethod
    def of(cls, text: str) -> Literal:
        new = cls.__new__(cls)
        new.n, new.counts, new.short = len(text), None, text if len(text) <= SHORT else None
        if new.short is None:
            new.counts = np.bincount(np.frombuffer(coded(text), "uint8"), minlength=256)
            new.head, new.tail, new.spaced = text[:8], text[-8:], any(c.isspace() for c in text)
        return new

    def histogram(self) -> np.ndarray:
        return self.counts if self.short is None else np.bincount(np.frombuffer(coded(self.short), "uint8"), minlength=256)

    def has_space(self) -> bool:
        return self.spaced if self.short is None else any(c.isspace() for c in self.short)

    def score(self) -> float:
        if self.short is not None:
            return literal_score(self.short)
        if self.spaced or self.head.lower().startswith(("your-", "your_")) or any(self.head.startswith(a) and self.tail.endswith(b) for a, b in LONG_PLACEHOLDERS):
            return 0.0
        used = np.flatnonzero(self.counts).tolist()
        if len(used) == 1 and chr(used[0]) in "xX*.":
            return 0.0
        kinds = sum(any(u in kind for u in used) for kind in BYTE_KINDS) + any(not any(u in kind for kind in BYTE_KINDS) for u in used)
        return likeness(self.n, self.counts[used].tolist(), kinds)


#: Tokens that the lexer tells apart; white space and all else lies between them.
LEX = re.compile(r"""(?P<name>[A-Za-z0-9_$](?:[A-Za-z0-9_$]|[.\-](?=[A-Za-z0-9_$]))*+)|(?P<quote>["'`])|(?P<op>\n|==+|[!<>]=|::)|(?P<sign>:=|=>|(?:\+|\.|\|\||\?\?|\?)?=|:(?!//))|(?P<mark>[^\sA-Za-z0-9_$])""")
LINE = re.compile(r"[^\n:=]*[:=]")
PREFIX = re.compile(r"(?i)[rbuf]{1,2}")
BODY = {q: re.compile(rf"(?:\\[^\n]|[^{q}\\\n])*+") for q in "\"'`"}
BLOCK = re.compile(r"[>|][-+0-9]*[ \t]*\n")
INDENT = re.compile(r"[ \t]*")
BLANK, BLANKS = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
BARE_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+")
#: Names inside a string that stand for their values.
HOLE = re.compile(r"[$#]?\{\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*\}")
INSERT = re.compile(r"[$#]\{\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*\}")
ESCAPE = re.compile(r"\\(.)")
#: A name and a comma before a string, as arguments of a call.
NAMED = re.compile(r"""\(\s*+(["'])([A-Za-z0-9_.\-]++)\1\s*+,\s*+(?=["'])""")
ELSE = re.compile(r"[ \t]*+(?:\bor\b|\|\||\?\?|\?:)[ \t]*+")
NUMBER = re.compile(r"[0-9][A-Za-z0-9_.]*+")
ITEM = re.compile(r"[ \t]*+-[ \t]++(?=[^\s-])")


def has_digit(parts: list[tuple]) -> bool:
    return any(c.isdigit() for kind, content, *_ in parts if kind != "hole" for c in content)


class Text:
    """A text with the places of its strings; what was searched in vain is not searched again."""

    def __init__(self, text: str) -> None:
        self.text, self.unclosed = text, {}

    def string(self, at: int) -> tuple[str, int, int, int] | None:
        """Content, its start and end, and the place behind the string whose quote is here; None if it is not closed."""
        text = self.text
        q = text[at]
        triple = q * 3
        if q != "`" and text.startswith(triple, at) and at < self.unclosed.get(triple, len(text)):
            end = text.find(triple, at + 3)
            if end >= 0:
                return text[at + 3 : end], at + 3, end, end + 3
            self.unclosed[triple] = at
        if at < self.unclosed.get(q, 0):
            return None
        end = BODY[q].match(text, at + 1).end()
        if text[end : end + 1] != q:
            self.unclosed[q] = end  # up to the end of the line all of these quotes are escaped
            return None
        return ESCAPE.sub(r"\1", text[at + 1 : end]), at + 1, end, end + 1

    def pieces(self, found: tuple[str, int, int, int], at: int, formatted: bool) -> list[tuple]:
        """A string as parts: itself, or its text and the names that it holds."""
        content, a, b, _ = found
        if "{" not in content:
            return [("text", content, a, b)]
        out, done = [], a
        for m in (HOLE if formatted else INSERT).finditer(self.text, a, b):
            if done < m.start():
                out.append(("text", ESCAPE.sub(r"\1", self.text[done : m.start()]), done, m.start()))
            out.append(("hole", m[1], *m.span()))
            done = m.end()
        if not out:
            return [("text", content, a, b)]
        if done < b:
            out.append(("text", ESCAPE.sub(r"\1", self.text[done:b]), done, b))
        return out

    def operand(self, at: int) -> tuple[list[tuple], int] | None:
        """A string or a name at a place, as parts (kind, content, start, end), and the place behind it."""
        text = self.text
        prefix = PREFIX.match(text, at)
        quote = prefix.end() if prefix and text[prefix.end() : prefix.end() + 1] in ('"', "'") else at
        if text[quote : quote + 1] in ('"', "'", "`"):
            found = self.string(quote)
            return found and (self.pieces(found, quote, "f" in text[at:quote].lower()), found[3])
        name = BARE_NAME.match(text, at)
        return name and ([("name", name[0], *name.span())], name.end())

    def joined(self, at: int, blank: re.Pattern) -> tuple[list[tuple], int] | None:
        """Operands that are joined by '+', or strings side by side, from a place on."""
        first = self.operand(at)
        if not first:
            return None
        parts, end = first
        while True:
            at = blank.match(self.text, end).end()
            sign, behind = self.text[at : at + 1], self.text[at + 1 : at + 2]
            plus = sign == "+" and behind not in ("+", "=") or sign == "." and at > end and behind in (" ", "'", '"', "$")
            more = self.operand(blank.match(self.text, at + 1).end() if plus else at) if plus or self.text[at : at + 1] in ('"', "'", "`") else None
            if not more or not plus and parts[-1][0] == "name":
                return parts, end
            parts += more[0]
            end = more[1]

    def others(self, at: int, sign: str) -> list[list[tuple]]:
        """Further values that may be meant by what stands behind a sign: items of a list, arguments of a call, defaults."""
        text, out = self.text, []
        if text[at : at + 1] in ("[", "{"):
            end = BLANKS.match(text, at + 1).end()
            while (found := self.joined(end, BLANKS)) and found[0][0][0] != "name":
                end = BLANKS.match(text, found[1]).end()
                if text[end : end + 1] not in (",", "]", "}"):
                    break
                out.append(found[0])
                end = BLANKS.match(text, end + 1).end()
            return out
        if sign == ":" and text[at : at + 1] == "\n":
            end = at + 1
            while item := ITEM.match(text, end):
                found = self.value(item.end(), "-")
                line = BLANK.match(text, found[1]).end() if found else -1
                if not found or text[line : line + 1] not in ("", "\n"):
                    break
                if has_digit(found[0]):
                    out.append(found[0])
                end = line + 1
            return out
        end = at
        while True:
            name = BARE_NAME.match(text, end)
            if name and text[name.end() : name.end() + 1] == "(":
                found, end = self.arguments(name.end(), bool(LOOKUP.search(name[0])))
                out += found
                if end is None:
                    return out
            elif (found := self.joined(end, BLANK)) or end > at:
                if not found:
                    return out
                if end > at:
                    out.append([("given" if kind == "name" else kind, *where) for kind, *where in found[0]])
                end = found[1]
            else:
                return out
            more = ELSE.match(text, end)
            if not more:
                return out
            end = more.end()

    def arguments(self, at: int, lookup: bool) -> tuple[list[list[tuple]], int | None]:
        """The strings among the arguments of a call and of the calls in it, and the place behind it if all was read."""
        text, out, depth, first, defaults, looked = self.text, [], 0, [lookup], [lookup], False
        while True:
            sign = text[at : at + 1]
            if sign == "(":
                depth += 1
                if depth > 1:
                    first.append(looked)
                    defaults.append(looked)
            elif sign == ")":
                depth -= 1
                first.pop()
                defaults.pop()
                if not depth:
                    return out, at + 1
            elif sign == ",":
                first[-1] = False
            elif sign in ("", "=", ":", ";"):
                return out, None
            at = BLANKS.match(text, at + 1).end()
            looked = False
            if number := NUMBER.match(text, at):
                at = number.end()
            elif found := self.joined(at, BLANKS):
                # without a lookup, words alone are messages or names rather than secrets
                if any(kind != "name" for kind, *_ in found[0]) and not first[-1] and (defaults[-1] or has_digit(found[0])):
                    out.append(found[0])
                looked = bool(LOOKUP.search(found[0][-1][1])) if found[0][-1][0] == "name" else False
                at = found[1]
            at = BLANKS.match(text, at).end()
            if text[at : at + 1] not in ("(", ")", ","):
                return out, None

    def value(self, at: int, sign: str) -> tuple[list[tuple], int] | None:
        """The parts of the value at a place and the place behind it."""
        text = self.text
        if text[at : at + 1] == "(":
            inner = BLANKS.match(text, at + 1).end()
            found = self.joined(inner, BLANKS) if text[inner : inner + 1] in ('"', "'") or PREFIX.match(text, inner) else None
            if not found or found[0][0][0] == "name":
                return None
            close = BLANKS.match(text, found[1]).end()
            return found[0], close + (text[close : close + 1] == ")")
        if sign == ":" and (block := BLOCK.match(text, at)):
            return self.block(at, block.end())
        found = self.joined(at, BLANK)
        if found and (found[0][0][0] == "text" or len(found[0]) > 1):
            return found
        bare = VALUE.match(text, at)
        if not bare or bare["strings"] or text[bare.end() : bare.end() + 1] == "(" and BARE_NAME.fullmatch(bare[0]):
            return None
        return [("name" if BARE_NAME.fullmatch(bare[0]) else "text", bare[0], *bare.span())], bare.end()

    def block(self, key: int, at: int) -> tuple[list[tuple], int] | None:
        """The lines after a key that are indented more than its line."""
        text = self.text
        line = text.rfind("\n", 0, key) + 1
        least = INDENT.match(text, line).end() - line
        parts = []
        while at < len(text):
            start = INDENT.match(text, at).end()
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if start < end and start - at <= least:
                break
            if start < end:
                parts.append(("text", text[start:end].rstrip(), start, start + len(text[start:end].rstrip())))
            at = end + 1
        return (parts, min(at, len(text))) if parts else None


def targets_before(recent: list[tuple]) -> list[str]:
    """The names that the tokens before a sign assign to: the last one, with those that commas put before it."""
    if not recent:
        return []
    kind, content, *_ = recent[-1]
    if content == "]" and kind == "mark" and len(recent) >= 3 and recent[-2][0] in ("name", "text") and recent[-3][1] == "[":
        base = recent[-4][1] + "." if len(recent) >= 4 and recent[-4][0] == "name" else ""
        return [base + recent[-2][1]]
    if kind == "text":
        return [content]
    if kind != "name":
        return []
    names, i = [content], len(recent) - 1
    while i >= 2 and recent[i - 1][1] == "," and recent[i - 2][0] == "name":
        names.insert(0, recent[i - 2][1])
        i -= 2
    return [x for n in names if (x := n.lstrip("0123456789.-$"))]


def named_arguments(text: str) -> Iterator[tuple[list[str], list[tuple], int]]:
    """A name and a string as the first arguments of a call: the name is given the string."""
    source, done = Text(text), 0
    for m in NAMED.finditer(text):
        if m.start() >= done and (found := source.joined(m.end(), BLANKS)):
            done = found[1]
            yield [m[2]], found[0], m.end()


def assignments(text: str) -> Iterator[tuple[list[str], list[tuple], int]]:
    """Target names, the parts of the value that each of them is given, and the place behind the sign, in the order of the text."""
    source, at, recent = Text(text), 0, []
    line_ends = 0
    while at < len(text):
        if at >= line_ends:  # a new line: on to the next with a sign
            line = LINE.search(text, at)
            if not line:
                return
            at = text.rfind("\n", at, line.end()) + 1 or at
            line_ends = text.find("\n", line.end() - 1)
            line_ends = len(text) if line_ends < 0 else line_ends + 1
            recent = []
        m = LEX.search(text, at)
        if not m or m.start() >= line_ends:
            at = line_ends if m else len(text)
            continue
        at = m.end()
        if m.lastgroup == "name":
            if recent and recent[-1][0] in ("name", "text"):
                recent = []
            recent.append(("name", m[0], *m.span()))
        elif m.lastgroup == "quote":
            before = text[m.start() - 1] if m.start() else " "
            prefixed = recent and recent[-1][0] == "name" and recent[-1][3] == m.start() and PREFIX.fullmatch(recent[-1][1])
            found = source.string(m.start()) if prefixed or not (before.isalnum() or before == "_") else None
            if found:
                recent = [*(recent[:-1] if prefixed else recent if recent and recent[-1][0] == "mark" else []), ("text", *found[:3])]
                at = found[3]
                line_ends = max(line_ends, at)
        elif m.lastgroup == "sign":
            names, recent = targets_before(recent), []
            if names:
                start = at
                pairs, at = given(source, names, m[0], at)
                yield from ((n, parts, start) for n, parts in pairs)
                line_ends = max(line_ends, at)
        elif m[0] in ",[]":
            recent.append(("mark", m[0], *m.span()))
        else:
            recent = []


def given(source: Text, names: list[str], sign: str, at: int) -> tuple[list[tuple[list[str], list[tuple]]], int]:
    """What the names before a sign are given by what stands behind it, and where to go on."""
    text, out = source.text, []
    several, names = names, names[-1:]
    place = BLANK.match(text, at).end()
    whole = None
    # a bare word before a further sign is a type or a target of its own
    while True:
        inner = TARGET.match(text, place)
        if inner and (x := inner["name"].lstrip("0123456789.-")):
            bare = None if whole or inner["quote"] else VALUE.match(text, place)
            if bare and text[inner.end() : inner.end() + 1] not in ('"', "'") and (not inner["space"] or not bare[0].replace("_", "").replace(".", "").isalpha()):
                whole = [("text", bare[0], *bare.span())]
                out.append((list(names), whole))
            names.append(x)
            sign = inner["sign"]
        elif sign != ":" or not (inner := DECLARED.match(text, place)):
            break
        place = inner.end()
        if inner.re is DECLARED:
            break
    grows = sign in ("+=", ".=")
    if grows:
        found = source.value(place, sign)
        return [([n], [("name", n, place, place), *found[0]]) for n in names[:1]] if found else [], found[1] if found else place
    named = [n for i, n in enumerate(names) if not i or n not in TYPES]
    more = [(named, parts) for parts in source.others(place, sign)]
    found = source.value(place, sign)
    if not found:
        return out + more, place
    if len(several) > 1 and sign == "=" and len(names) == 1:
        values, end = [found[0]], found[1]
        while len(values) < len(several) and (comma := re.compile(r"[ \t]*,[ \t]*").match(text, end)) and not TARGET.match(text, comma.end()) and (more := source.value(comma.end(), sign)):
            values.append(more[0])
            end = more[1]
        if len(values) == len(several):
            return [([n], v) for n, v in zip(several, values, strict=True)], end
    return [*out, (named, found[0]), *more], found[1]


def lexed(text: str, threshold: float) -> set[tuple[int, int]]:
    """Places of the literals that reach the threshold under some name, constants propagated."""
    pairs = list(assignments(text)) if ":" in text or "=" in text else []
    if "(" in text and (called := list(named_arguments(text))):
        pairs = sorted([*pairs, *called], key=lambda p: p[2])
    weights: dict[str, float] = {}
    for names, *_ in pairs:
        for name in names:
            if name not in weights:
                weights[name] = name_weight(name)
    if not any(weights.values()):
        return set()
    defined: dict[str, list[int]] = {}
    for i, (names, *_) in enumerate(pairs):
        for name in names:
            defined.setdefault(name, []).append(i)

    def meant(i: int, name: str) -> int | None:
        """The assignment that a name in assignment i stands for."""
        of = defined.get(name.lstrip("$"))
        if not of:
            return None
        k = bisect_left(of, i)
        return of[k - 1] if k else next((j for j in of if j != i), None)

    links = [[meant(i, content) if kind != "text" else None for kind, content, *_ in parts] for i, (_, parts, _) in enumerate(pairs)]
    readers = Counter(j for of in links for j in of if j is not None)
    values: dict[int, Literal] = {}
    used: list[list[int]] = [[] for _ in pairs]
    own: list[tuple[int, int] | None] = [None] * len(pairs)
    state = bytearray(len(pairs))  # 1: begun, 2: done
    hits = []
    for first in range(len(pairs)):
        todo = [first]
        while todo:
            i = todo[-1]
            if state[i] == 2:
                todo.pop()
                continue
            state[i] = 1
            wanted = [j for j in links[i] if j is not None and not state[j]]
            if wanted:
                todo += wanted
                continue
            content, ends = [], []
            for (kind, piece, a, b), j in zip(pairs[i][1], links[i], strict=True):
                if j is not None and state[j] == 2:
                    content.append(values[j])
                    used[i].append(j)
                    if kind == "hole":
                        ends += (a, b)
                elif kind in ("text", "hole") or kind == "name" and len(pairs[i][1]) == 1:
                    content.append(Literal.of(text[a:b] if kind == "hole" else piece))
                    ends += (a, b)
            if ends:
                own[i] = ends[0], ends[-1]
            value = values[i] = Literal(content)
            state[i] = 2
            todo.pop()
            heaviest = max((weights[n] for n in pairs[i][0]), default=0.0)
            if heaviest and heaviest * value.score() >= threshold:
                hits.append(i)
            elif value.short and " " in value.short and (found := passphrase_score(value.short)):
                if any(part_weight(name_parts(n)[-1]) * found >= threshold for n in pairs[i][0] if name_parts(n)):
                    hits.append(i)
            for j in links[i]:  # what no later assignment reads is given up
                if j is not None:
                    readers[j] -= 1
                    if not readers[j] and state[j] == 2:
                        values.pop(j, None)
            if not readers[i]:
                values.pop(i, None)
    places, seen = set(), set(hits)
    while hits:
        i = hits.pop()
        if own[i]:
            places.add(own[i])
        for j in used[i]:
            if j not in seen:
                seen.add(j)
                hits.append(j)
    return places


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def lexed_spans(text: str, threshold: float) -> list[tuple[str, int, int]]:
    return [("lexed", a, b) for a, b in sorted(lexed(text, threshold))]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed of every text;
    places count code points, with the end exclusive."""

    def scan(texts: list[str]) -> dict:
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")}
        for text in texts:
            base, more = base_spans(text), lexed_spans(text, threshold)
            n = Counter(s[0] for s in base)
            spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            row = n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(more)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    return rows.map_texts(docs, scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redacted(text: str | None, threshold: float, mark: str) -> str | None:
    """The text with each secret replaced by the mark; of an assignment only its value goes."""
    if not text:
        return text
    cut = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    cut += [(a, b) for kind, a, b in base_spans(text) + lexed_spans(text, threshold) if kind != "assign"]
    if not cut:
        return text
    out, at = [], 0
    for a, b in sorted(cut):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, threshold: float = 0.5, mark: str = "[REDACTED]") -> DataFrame:
    """docs with the secrets of each text replaced; every row and column stays, and n_chars,
    where there is one, follows the new text."""
    out = rows.change_texts(docs, lambda text: redacted(text, threshold, mark))
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
