"""Secret scans by assignment-aware lexing.

Three plain patterns give the base spans. Beside them, every assignment in the text (``name = value``,
``"name": "value"``, ``name := value``, ``name => value``; source, JSON, YAML, INI and environment files alike) is
lexed into a name and its literal: string literals, literals and names joined by ``+`` or standing side by side, bare
words, and names bound earlier, whose literal is carried on. The name may be quoted, a subscript (``x["name"] = value``)
or have a type (``name: type = value``), or stand in a tuple of names; strings may be in triple quotes over several
lines, raw, on the next line, or block scalars of YAML. A value in brackets or a call (``name = f('value')``) gives every
literal in it, but for the name that a lookup asks for (``getenv('NAME', 'value')``). Other pairs of names and literals:
elements (``<name>value</name>``), tags with a name and a value (``<add key="name" value="value"/>``), calls with a
quoted name before the value (``define('name', 'value')``), ``set name 'value'`` and options (``--name value``). Blocks
that are marked as private keys are reported whatever their name, up to the end of the text if they have no end.

A literal of any length is reported if its target's name is sensitive and the literal looks like key material; under
names that say it all (``passphrase``, ``pwd``) every quoted literal of eight characters does that is no placeholder.
Added spans cover the literal alone and never overlap a base span.

Defined cases: a null or empty text has no spans; each row gives one row, in any order, repeated rows and null ids
included; other columns are ignored by the scan and passed on by the redaction; offsets count code points. Texts of any
length are read whole, in time that grows with their length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks

KINDS = ("assign", "access", "hex", "named")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

OPERATOR = re.compile(r"(?::=|=>|<-|[:=])(?!=)")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$\-]*", re.ASCII)
NAME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.$-")
TYPE_START = re.compile(r"[ \t]*(?:&(?:'\w+[ \t]+)?(?:mut[ \t]+)?)?[A-Za-z_$]", re.ASCII)
STRING = re.compile(r"""[rbuf]?("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)""", re.ASCII)
RAW_STRING = re.compile(r'(?:u8|[uUL])?R"([^\s()\\"]{0,16})\(')
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|&]+")
RAW_END = re.compile(r'\)([^\s()\\"]{0,16})"')
CALL = re.compile(r"(?:(?:await|new)[ \t]+)?([A-Za-z_$][\w.$:]*)(?:!(?=[(\[])|[ \t]*(?=\())", re.ASCII)
WORD_INSIDE = re.compile(r"[^\s\"'`,()\[\]{}+]+")
#: Blanks, with a line that is continued or whose value stands in quotes on the next one.
TO_VALUE = re.compile(r"""[ \t]*(?:\\\r?\n[ \t]*|\r?\n[ \t]*(?=["'`]))?""")
BLOCK_SCALAR = re.compile(r"[ \t]*[|>][+\-]?\d?[ \t]*\r?\n")
TUPLE_NAMES = re.compile(r"\(([^()\n]{1,500})\)[ \t]*$")
QUOTED_NAME = re.compile(r"""\(\s*(["'])([A-Za-z_$][\w.$\-]*)\1\s*,\s*""", re.ASCII)
COMMAND = re.compile(r"(?:(?m:^)[ \t]*(?:set|setenv|setx|export|define)[ \t]+|(?<![\w\-])--(?=[A-Za-z]))([A-Za-z_$][\w.$\-]*)[ \t]+(?=[^\s\-])", re.ASCII)
# Calls whose first argument is the name of what they fetch.
LOOKUPS = ("getenv", "get", "env", "environ", "getproperty", "getenvironmentvariable", "fetch", "lookup", "getstring", "config")
PLUS = re.compile(r"[ \t]*\+[ \t]*")
BLANKS = re.compile(r"[ \t]*")
TAG = re.compile(r"<([A-Za-z_][\w.:\-]*)([^<>]*)>([^<>]*)", re.ASCII)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:\-]*)[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)')""", re.ASCII)
# Attributes that name what another one holds.
NAMING, HOLDING = ("key", "name", "id"), ("value", "val", "content")
KEY_BEGIN, KEY_END = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"), "-----END %s-----"
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# How sensitive a part of a name is, and pairs of parts that are more so together.
PART_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "private": 0.5, "signature": 0.5, "salt": 0.5, "key": 0.4, "access": 0.3, "pass": 0.6,
}
PAIR_WEIGHT = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("account", "key"): 0.9, ("auth", "key"): 0.9, ("client", "secret"): 1.0}
PLACEHOLDER = r"change_?me|example|placeholder|dummy|redacted|your[_-]|xxxx|\*\*\*|\.\.\.|environ|getenv"
PLACEHOLDER, PLACEHOLDER_STARTS = re.compile(PLACEHOLDER, re.IGNORECASE), re.compile(f"(?={PLACEHOLDER})", re.IGNORECASE)
PLACEHOLDER_FIRST = "$%<"
#: No placeholder is longer.
EDGE = len("placeholder")
WEIGHTS = sorted({*PART_WEIGHT.values(), *PAIR_WEIGHT.values()})
#: A text without any of these holds no sensitive name.
SENSITIVE_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "private", "signature", "salt", "access")
#: Beside placeholder words, so many characters make a literal of its own.
REST_LENGTH = 12
LEAST_SCORE = 0.5
LEAST_LENGTH = 8


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    pairs = [PAIR_WEIGHT.get(p, 0.0) for p in zip(parts, parts[1:])]
    return max([0.0, *(PART_WEIGHT.get(p, 0.0) for p in parts), *pairs])


def kinds_of(c: str) -> tuple[bool, bool, bool, bool]:
    return c.islower(), c.isupper(), c.isdigit(), not c.isalnum()


def entropy(counts: Iterable[int], n: int) -> float:
    return -math.fsum(k / n * math.log2(k / n) for k in counts)


class Facts:
    """What a literal's strength depends on; the facts of joined literals follow from those of the parts."""

    __slots__ = ("n", "counts", "head", "tail", "filler")

    def __init__(self, literal: str):
        self.n, self.counts, self.head, self.tail = len(literal), Counter(literal), literal[:EDGE], literal[-EDGE:]
        self.filler = sum(len(m.group()) for m in PLACEHOLDER.finditer(literal))

    def add(self, other: Facts) -> None:
        edge = len(self.tail)
        across = (m for m in PLACEHOLDER.finditer(self.tail + other.head) if m.start() < edge < m.end())
        self.filler += other.filler + sum(len(m.group()) for m in across)
        self.n += other.n
        self.counts.update(other.counts)
        self.head, self.tail = (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:]

    def strength(self, rest: int | None = None) -> float:
        """0 to 1: bits a character of the literal, against 3 bits; 0 for short, blank-holding or placeholder literals and
        those of letters in one case only. A placeholder word makes a placeholder of the whole, or with ``rest`` only
        where fewer other characters than that are left."""
        if self.n < LEAST_LENGTH or any(c.isspace() for c in self.counts) or self.placeholder(rest):
            return 0.0
        once = self.counts[self.head[0]] == 1
        kinds = [kinds_of(c) for c in self.counts]
        upper = any(k[1] and not (once and c == self.head[0]) for c, k in zip(self.counts, kinds, strict=True))
        if sum((any(k[0] for k in kinds), upper, any(k[2] for k in kinds), any(k[3] for k in kinds))) < 2:
            return 0.0
        return min(1.0, entropy(self.counts.values(), self.n) / 3)

    def placeholder(self, rest: int | None) -> bool:
        return self.head[0] in PLACEHOLDER_FIRST or self.filler > 0 and (rest is None or self.n - self.filler < rest)

    def score(self, weight: float) -> float:
        """The score of a literal in quotes or brackets under a name of ``weight``. Full weight asks for length alone, of
        several words for some more, and that they are words."""
        if weight < 1:
            return weight * self.strength(REST_LENGTH)
        words = any(c.isspace() for c in self.counts)
        if self.n < (REST_LENGTH if words else LEAST_LENGTH) or self.placeholder(REST_LENGTH):
            return 0.0
        return float(not words or all(c.isalnum() or c in " -_'!" for c in self.counts))


def strength(literal: str) -> float:
    return Facts(literal).strength()


class Value:
    """An assigned literal: spans of the text and values of names, joined. Values that share parts share their facts."""

    __slots__ = ("parts", "bare", "facts", "strength")

    def __init__(self, parts: list[tuple[int, int] | Value], bare: bool = False):
        self.parts, self.bare = parts, bare
        self.facts: Facts | None = None
        self.strength: float | None = None


def facts_of(text: str, value: Value) -> Facts:
    """The value's facts, from the innermost names outwards."""
    waiting = [value]
    while waiting:
        v = waiting[-1]
        inner = [p for p in v.parts if isinstance(p, Value) and p.facts is None] if v.facts is None else []
        if inner:
            waiting += inner
            continue
        waiting.pop()
        if v.facts is None:
            made = Facts("")
            for p in v.parts:
                made.add(p.facts if isinstance(p, Value) else Facts(text[p[0] : p[1]]))
            v.facts = made
    return value.facts


def rate_bare(text: str, values: list[Value]) -> None:
    """Strengths of bare words with one end, each a suffix of the longest: one pass from the end, however many there are."""
    values = sorted(values, key=lambda v: -v.parts[0][0])
    at = end = values[0].parts[0][1]
    last = max((m.start() for m in PLACEHOLDER_STARTS.finditer(text, values[-1].parts[0][0], end)), default=-1)
    counts: Counter[str] = Counter()
    kinds, total = [0] * 4, 0.0
    for v in values:
        start = v.parts[0][0]
        for c in reversed(text[start:at]):
            k = counts[c]
            counts[c] = k + 1
            total += (k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0.0)
            if not k or c.isupper():
                kinds = [x + y for x, y in zip(kinds, kinds_of(c), strict=True)]
        at = start
        n = end - start
        if n < LEAST_LENGTH or last >= start or text[start] in PLACEHOLDER_FIRST or sum((kinds[0] > 0, kinds[1] > text[start].isupper(), kinds[2] > 0, kinds[3] > 0)) < 2:
            v.strength = 0.0
            continue
        bits = math.log2(n) - total / n
        # Summed exactly where rounding might decide: near 3 and near what some weight asks for.
        near = any(abs(bits - 3 * LEAST_SCORE / w) < 1e-6 for w in WEIGHTS)
        v.strength = min(1.0, (entropy(counts.values(), n) if near else bits) / 3)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """start, end, kind and the start of the secret itself, for the three plain patterns."""
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return found


def joined_at(text: str, at: int, known: dict[str, Value]) -> tuple[Value | None, int]:
    """The strings and names that ``+`` joins or that stand side by side from ``at`` on, and their end. Names not bound
    earlier have no literal; in a bare word (``a+b``, without a string) all must be bound."""
    parts: list[tuple[int, int] | Value] = []
    strings = unknown = 0
    tight = bool((m := IDENTIFIER.match(text, at)) and BARE.match(text, m.end(), m.end() + 1))
    while True:
        if m := STRING.match(text, at):
            parts.append((m.start(1) + 1, m.end(1) - 1))
            strings += 1
        elif m := IDENTIFIER.match(text, at):
            if m.group() in known:
                parts.append(known[m.group()])
            else:
                unknown += 1
        else:
            break
        at = end = m.end()
        if plus := PLUS.match(text, at):
            at = plus.end()
        elif not (text[end - 1] in "\"'`" and STRING.match(text, at := BLANKS.match(text, at).end())):
            at = end
            break
    if not parts or tight and not strings and (unknown or BARE.match(text, at, at + 1)):
        return None, at
    return (parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)), at


def literal_at(text: str, at: int, known: dict[str, Value], bare_end: int = 0) -> tuple[Value | None, int, bool]:
    """The literal that starts at ``at``, where the lexer stops, and whether it is a bare word. ``bare_end`` is the end
    of the bare word met last; a word that starts inside it ends there too, so no run is read more than once."""
    at = BLANKS.match(text, at).end()
    value, end = joined_at(text, at, known)
    if value is not None:
        return value, end, False
    if at < bare_end:
        end = bare_end
    elif m := BARE.match(text, at):
        end = m.end()
    else:
        return None, at, False
    return Value([(at, end)], bare=True), end, True


def name_before(text: str, end: int, low: int) -> str | None:
    """The name that ends before ``end``, back to its start but not beyond ``low``: plain, quoted or the last subscript."""

    def skip(i: int) -> int:
        while i > low and text[i - 1] in " \t":
            i -= 1
        return i

    i = skip(end)
    if i > low and text[i - 1] == "]":
        i = skip(i - 1)
    quote = text[i - 1] if i > low and text[i - 1] in "\"'`" else ""
    i -= len(quote)
    start = i
    while start > low and text[start - 1] in NAME_CHARACTERS:
        start -= 1
    while not quote and start < i and text[start] == "-":
        start += 1
    if start == i or not IDENTIFIER.match(text, start):
        return None
    if quote and (start == low or text[start - 1] != quote or start - 1 > low and text[start - 2] in NAME_CHARACTERS):
        return None
    return text[start:i]


def annotation_end(text: str, at: int) -> int | None:
    """Where a type and ``=`` that start at ``at`` end, if they do: ``str =``, ``Optional[str] =``, ``str | None =``,
    ``&str =``. Without a blank before or a quote behind ``=``, it is taken for a part of a bare word."""
    m = TYPE_START.match(text, at)
    if not m:
        return None
    i, depth, gap = m.end(), 0, False
    while i < len(text):
        c = text[i]
        if c == "=":
            after = text[i + 1 : i + 2]
            return i + 1 if not depth and after not in ("=", ">") and (gap or after and STRING.match(text, BLANKS.match(text, i + 1).end())) else None
        if c in "\n:":
            return None
        if c in "[<":
            depth += 1
        elif c in "]>":
            depth -= 1
            if depth < 0:
                return None
        elif not depth:
            if c in " \t":
                gap = True
            elif c == "|":
                i = BLANKS.match(text, i + 1).end() - 1
                gap = False
            elif gap or not (c in NAME_CHARACTERS or c in "?!*"):
                return None
        i += 1
    return None


def markup(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """Names and literals of elements, and of tags that name what they hold."""
    for m in TAG.finditer(text):
        if m.group(2):
            found = {a.group(1).lower(): a for a in ATTRIBUTE.finditer(text, m.start(2), m.end(2))}
            name, held = (next((found[k] for k in kinds if k in found), None) for kinds in (NAMING, HOLDING))
            if name and held:
                yield name.group(2) or name.group(3) or "", held.span(2 if held.group(2) is not None else 3)
        body = m.group(3).strip()
        if body and text.startswith(f"</{m.group(1)}", m.end()):
            start = m.start(3) + m.group(3).index(body[0])
            yield m.group(1), (start, start + len(body))


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks that are marked as private keys, from mark to mark."""
    at = 0
    while m := KEY_BEGIN.search(text, at):
        mark = KEY_END % m.group(1)
        end = text.find(mark, m.end())
        if end < 0:
            yield m.start(), len(text)
            return
        yield m.start(), end + len(mark)
        at = end


def triple_quoted(text: str, at: int, unclosed: set[str]) -> tuple[Value, int] | None:
    """The string over several lines that begins at ``at``, without white space on either side, and its end."""
    at = BLANKS.match(text, at).end()
    quotes = text[at : at + 3]
    if quotes not in ('"""', "'''") or quotes in unclosed:
        return None
    end = text.find(quotes, at + 3)
    if end < 0:
        unclosed.add(quotes)
        return None
    inside = text[at + 3 : end]
    start = at + 3 + len(inside) - len(inside.lstrip())
    return Value([(start, start + len(inside.strip()))]), end + 3


class RawStrings:
    """Raw strings with delimiters of their own; where they may end is looked up once."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[str, list[int]] | None = None

    def at(self, at: int) -> tuple[Value, int] | None:
        m = RAW_STRING.match(self.text, at)
        if not m:
            return None
        if self.ends is None:
            self.ends = {}
            for e in RAW_END.finditer(self.text):
                self.ends.setdefault(e.group(1), []).append(e.start())
        ends = self.ends.get(m.group(1), [])
        i = bisect.bisect_left(ends, m.end())
        return (Value([(m.end(), ends[i])]), ends[i] + len(m.group(1)) + 2) if i < len(ends) else None


def block_scalar(text: str, at: int, name_at: int) -> tuple[Value, int] | None:
    """The lines behind ``at`` that stand further in than the line of the name."""
    m = BLOCK_SCALAR.match(text, at)
    if not m:
        return None
    line = text.rfind("\n", 0, name_at) + 1
    indent = len(text[line:name_at]) - len(text[line:name_at].lstrip(" -"))
    parts, i = [], m.end()
    while i < len(text):
        end = text.find("\n", i)
        end = len(text) if end < 0 else end
        inside = text[i:end]
        if inside.strip() and len(inside) - len(inside.lstrip(" ")) <= indent:
            break
        if inside.strip():
            start = i + len(inside) - len(inside.lstrip())
            parts.append((start, start + len(inside.strip())))
        i = end + 1
    return (Value(parts), min(i, len(text))) if parts else None


def bracketed(text: str, at: int, known: dict[str, Value]) -> tuple[list[tuple[int, Value]], int]:
    """The literals between the bracket at ``at`` and the one that closes it, each with the number of its element, and the
    end. Strings side by side or joined by ``+``, over lines as well, are one literal. Without a closing bracket, those
    of its line."""
    found: list[tuple[int, Value]] = []
    parts: list[tuple[int, int] | Value] = []
    depth = element = 0
    first_line = None
    i, n = at, len(text)

    def flush() -> None:
        if parts:
            found.append((element, Value(list(parts))))
            parts.clear()

    while i < n:
        c = text[i]
        if c == "\n" and first_line is None:
            first_line = len(found) + bool(parts)
        if c.isspace() or c in "\\+":
            i += 1
        elif c in "([{":
            flush()
            depth += 1
            i += 1
        elif c in ")]}":
            flush()
            depth -= 1
            i += 1
            if not depth:
                return found, i
        elif c == ",":
            flush()
            element += depth == 1
            i += 1
        elif m := STRING.match(text, i):
            parts.append((m.start(1) + 1, m.end(1) - 1))
            i = m.end()
        elif m := WORD_INSIDE.match(text, i):
            if m.group() in known:
                parts.append(known[m.group()])
            else:
                flush()
            i = m.end()
        else:
            i += 1
    flush()
    return (found if first_line is None else found[:first_line]), n


class Brackets:
    """Literals in brackets under sensitive names. A bracket inside one that was read under no smaller weight has nothing
    new, so no text is read more often than there are weights."""

    def __init__(self, text: str, known: dict[str, Value]):
        self.text, self.known = text, known
        self.read: list[tuple[float, int]] = []

    def _found(self, weight: float, at: int) -> list[tuple[int, Value]]:
        if not weight or any(w >= weight and at < end for w, end in self.read):
            return []
        found, end = bracketed(self.text, at, self.known)
        self.read = [(w, e) for w, e in self.read if w != weight and e > at] + [(weight, end)]
        return found

    def values(self, name: str, at: int, call: str) -> Iterator[tuple[str, Value]]:
        """Those of a name's value; a lookup's first argument is none."""
        asks = call.rpartition(".")[2].lower() in LOOKUPS
        yield from ((name, value) for element, value in self._found(sensitivity(name), at) if element or not asks)

    def tuple_values(self, end: int, at: int, low: int) -> Iterator[tuple[str, Value]]:
        """Names in brackets before ``end``, and the literals that stand in brackets from ``at`` on in the same places."""
        m = TUPLE_NAMES.search(self.text, max(low, end - 600), end)
        at = BLANKS.match(self.text, at).end()
        if m and self.text[at : at + 1] in ("(", "["):
            names = [x.strip() for x in m.group(1).split(",")]
            found = self._found(max(map(sensitivity, names)), at)
            yield from ((names[element], value) for element, value in found if element < len(names))


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """Each assigned name with its literals, constants carried on from earlier names."""
    known: dict[str, Value] = {}
    done = bare_end = 0
    unclosed: set[str] = set()
    brackets, raw = Brackets(text, known), RawStrings(text)
    for m in OPERATOR.finditer(text):
        if m.start() < done:
            continue
        name = name_before(text, m.start(), done)
        if not name:
            if m.group() == "=":
                yield from brackets.tuple_values(m.start(), m.end(), done)
            continue
        at = m.end()
        if m.group() == ":":
            if value_at := annotation_end(text, at):
                done = at = value_at
            elif block := block_scalar(text, at, m.start()):
                known[name], done = block
                yield name, known[name]
                continue
        at = TO_VALUE.match(text, at).end()
        if long_ := triple_quoted(text, at, unclosed) or raw.at(at):
            known[name], done = long_
            yield name, known[name]
            continue
        call = CALL.match(text, at) if at >= bare_end else None
        if call or text[at : at + 1] in ("(", "["):
            yield from brackets.values(name, call.end() if call else at, call.group(1) if call else "")
            continue
        value, end, bare = literal_at(text, at, known, bare_end)
        if value is None:
            continue
        known[name] = value
        yield name, value
        if bare:
            bare_end = end
        else:
            done = end


def commands(text: str) -> Iterator[tuple[str, Value]]:
    """Names and literals of calls with a quoted name before the value, of ``set`` and of options."""
    for m in QUOTED_NAME.finditer(text):
        if sensitivity(m.group(2)):
            value, _, bare = literal_at(text, m.end(), {})
            if value is not None and not bare:
                yield m.group(2), value
    for m in COMMAND.finditer(text):
        if sensitivity(m.group(1)):
            value, _, _ = literal_at(text, m.end(), {})
            if value is not None:
                yield m.group(1), value


def named_literals(text: str) -> Iterator[tuple[int, int]]:
    """The literals under sensitive names that look like secrets, some of them repeatedly."""
    for name, span in markup(text) if "<" in text else ():
        if span[1] > span[0] and sensitivity(name) * strength(text[span[0] : span[1]]) >= LEAST_SCORE:
            yield span
    pairs = [*assignments(text), *commands(text)]
    asked = [(weight, value) for name, value in pairs if (weight := sensitivity(name)) > 0]
    runs: dict[int, list[Value]] = {}
    for value in {id(v): v for _, v in asked}.values():
        if value.bare:
            runs.setdefault(value.parts[0][1], []).append(value)
    for values in runs.values():
        rate_bare(text, values)
    seen: set[int] = set()
    for weight, value in asked:
        score = weight * value.strength if value.bare else facts_of(text, value).score(weight) if value.parts else 0.0
        waiting = [value] if score >= LEAST_SCORE else []
        while waiting:
            v = waiting.pop()
            if id(v) not in seen:
                seen.add(id(v))
                waiting += [p for p in v.parts if isinstance(p, Value)]
                yield from (p for p in v.parts if not isinstance(p, Value))


def all_spans(text: str) -> list[tuple[int, int, str, int]]:
    found = base_spans(text)
    low = text.lower()
    own = list(named_literals(text)) if any(w in low for w in SENSITIVE_WORDS) else []
    own += private_keys(text) if "-----BEGIN " in text else []
    if own:
        taken: list[tuple[int, int]] = []
        for s, e in sorted((s, e) for s, e, _, _ in found):
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        for s, e in sorted(set(own)):
            at = bisect.bisect_left(taken, (e,)) - 1
            if e > s and (at < 0 or taken[at][1] <= s):
                found.append((s, e, "named", s))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def shown(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind, _ in spans)


def redact(text: str, spans: list[tuple[int, int, str, int]], mark: str) -> str:
    """The text with every secret replaced by ``mark``; overlapping secrets become one mark."""
    out, at = [], 0
    for s, e in sorted((own, e) for _, e, _, own in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, comma-joined) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            spans = [all_spans(t or "") for t in b.column(1).to_pylist()]
            base = [[x for x in each if x[2] != "named"] for each in spans]
            counts = [pa.array([sum(x[2] == kind for x in each) for each in base], pa.int64()) for kind in KINDS[:3]]
            digests = [hashlib.sha256(shown(each).encode()).hexdigest() for each in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests), pa.array(list(map(shown, spans)), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``, and n_chars (where there is one) counted anew for
    changed texts. Rows, order and all other columns stay; a null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = b.column(names.index("text")).to_pylist()
            clean = [redact(t, spans, mark) if t and (spans := all_spans(t)) else t for t in texts]
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(clean, b.schema.field("text").type)
            if "n_chars" in names:
                old = columns[names.index("n_chars")].to_pylist()
                columns[names.index("n_chars")] = pa.array([len(c) if c != t else n for c, t, n in zip(clean, texts, old, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
