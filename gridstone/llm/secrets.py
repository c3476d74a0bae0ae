"""Secret scans: fixed patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer cuts a text into tokens: strings with escapes (one line, triple quotes and back quotes over lines), names,
operators, brackets, line ends and bare words. From the tokens it reads name-literal pairs:

* ``name = value``, ``:=``, ``=>``, ``name: value``, ``"name": value``, ``x["name"] = value``, ``name[] = value``, with a type
  before or after the name (``name: str = value``, ``var name string = value``), as keyword arguments and in objects;
* ``f("name", "value")`` and ``set_name("value")``, ``<name>value</name>``, ``--name value``, ``scheme://user:value@host``, key blocks;
* the same inside of strings, as in connection strings.

A value is a joint of literals, names and parentheses with ``+``, ``or``, ``||``, ``??`` or nothing between them. Names are
resolved after the whole text is read: a name stands for the last value that it got before, or else for the first one
after, on and on, so constants reach a sensitive name along any chain and in any order. A value is scored by the words of the name that
it is for, by its length and by its entropy; the literals of those over the threshold are reported as kind "named".
A name that never gets a value is no literal, as in source code, but in bare-value syntax: after ``NAME=`` on a line of its own, or
where it ends its line, has two digits or more and neither a dot nor an underscore. Subscripts and calls are never literals.
Every step is linear in the text, and no length is bounded.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

#: Weight of each word that a sensitive name can hold.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "key": 0.5, "private": 0.5, "access": 0.5,
    "auth": 0.5, "authorization": 0.8, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "signature": 0.4, "salt": 0.4, "session": 0.3, "client": 0.2, "api": 0.5, "dsn": 0.6, "cookie": 0.4,
}
#: Words that say a literal is a stand-in.
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|todo|string|your[_-].*|<.*>|\$\{?.*)$")
OPEN_PLACEHOLDER = re.compile(r"(?i)^(your[_-].*|<.*>|\$.*)$")
#: Without one of these no name has a weight, and no fixed pattern fits.
HINT = r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|signature|salt|session|cookie|dsn|://"
GATE = r"AKIA|[0-9a-f]{24}|(?i:" + HINT.removeprefix("(?i)") + ")"
THRESHOLD = 0.75

TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<triple>\"{3}|'{3})|(?P<quote>["'`])"""
    r"""|(?P<tag><(?P<tagname>[A-Za-z_][\w.\-]*)>(?=(?P<inner>[^<>\n]+)</))"""
    r"""|(?P<flag>--(?P<flagname>[A-Za-z][\w.\-]*))|(?P<name>[A-Za-z_]\w*(?:[.\-]\w+)*)"""
    r"""|(?P<op>===?|!==?|<=|>=|=>|:=|\?\?|\|\||\+=|[-=:+,;()\[\]{}|?])|(?P<other>\d[\w.]*|[^\s\w"'`=:,;()\[\]{}<+|?-]+|.)""", re.ASCII)
STRING = {q: re.compile(rf"[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*{q}") for q in "\"'"} | {"`": re.compile(r"[^`\\]*(?:\\.[^`\\]*)*`", re.DOTALL)}
#: A bare word; an equals sign is part of it at its end only.
BARE = re.compile(r"[^\s,;(){}\[\]<>\"'`=&]+(?:={1,2}(?![^\s,;(){}\[\]<>\"'`]))?")
#: Signs that no bare value has, where it may be a name of source code as well.
SIGNS, DIGIT = re.compile(r"[._\[]"), re.compile(r"\d")
FLAG_VALUE = re.compile(r"""[=\x20](?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'`-]\S*))""")
SETTER = re.compile(r"(?:.*\.)?(?:set|with)_?(\w+)$")
USERINFO = re.compile(r"://[^\s/:@\"'<>]+:([^\s/@\"'<>]+)@")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END")
ASSIGNS, JOINS = {"=", ":=", "=>", ":"}, {"+", "||", "??", "or"}
#: Kinds of quotes, so the deepest that strings are read inside strings.
DEPTH = 3


def name_weight(name: str) -> float:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(re.split(r"[_.\-\s]+", parts))))


class Value:
    """What a name gets: places of literals and names that stand for other values, in order."""

    __slots__ = ("name", "at", "parts", "bare", "stats", "told")

    def __init__(self, name: str, at: int, parts: list[tuple[int, int] | str], bare: bool = False):
        self.name, self.at, self.parts, self.bare, self.stats, self.told = name, at, parts, bare, None, False


class Runs:
    """Ends of bare words: each run is read once, however many places in it are asked for."""

    def __init__(self, text: str, end: int):
        self.text, self.end, self.low, self.high, self.stop = text, end, 0, 0, 0

    def end_of(self, a: int) -> int:
        """Where the bare word that begins at a place ends; the place itself if none does."""
        if not self.low <= a < self.high:
            m = BARE.match(self.text, a, self.end)
            if m is None:
                return a
            self.low, self.high = a, m.end() - len(m[0]) + len(m[0].rstrip("="))
            self.stop = m.end()
        return self.stop


def literal_stats(v: str) -> tuple[Counter, int, str, str]:
    """Characters with their numbers, length, first 12 characters and last one."""
    return Counter(v), len(v), v[:12], v[-1:]


def joined(stats: list[tuple[Counter, int, str, str]]) -> tuple[Counter, int, str, str]:
    counts: Counter = Counter()
    for s in stats:
        counts.update(s[0])
    return counts, sum(s[1] for s in stats), "".join(s[2] for s in stats)[:12], next((s[3] for s in reversed(stats) if s[1]), "")


def entropy(counts: Counter, n: int) -> float:
    """Bits a character."""
    return -sum(p * math.log2(p) for c in counts.values() if (p := c / n)) if n else 0.0


def placeholder(counts: Counter, n: int, first: str, last: str) -> bool:
    if n <= len(first):
        return bool(PLACEHOLDER.match(first))
    return counts.keys() <= {"x", "X"} or counts.keys() == {"*"} or counts.keys() == {"."} or bool(OPEN_PLACEHOLDER.match(first + last))


def score(name: str, stats: tuple[Counter, int, str, str]) -> float:
    """Of 0 to 1: how likely a value is a secret, for the name that it is given to."""
    counts, n, first, last = stats
    if n < 6 or placeholder(counts, n, first, last):
        return 0.0
    kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in counts})
    look = 0.4 * min(1.0, entropy(counts, n) / 3.5) + 0.3 * min(n, 16) / 16 + 0.3 * min(1.0, kinds / 2)
    return name_weight(name) * (0.4 + 0.6 * look)


def tokens(text: str, start: int, end: int) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, int, int]]]:
    """(kind, text, start, end) of the tokens, of a string without its quotes; and pairs that tags and flags give."""
    out, pairs, at = [], [], start
    closed_until = dict.fromkeys(("\"", "'", "`", '"""', "'''"), start)  # no string of a kind closes before this place
    while at < end:
        m = TOKEN.match(text, at, end)
        kind, at = m.lastgroup, m.end()
        if m["tagname"]:
            pairs.append((m["tagname"], *m.span("inner")))
            out.append(("other", "", m.start(), at))
        elif m["flagname"]:
            if v := FLAG_VALUE.match(text, at, end):
                pairs.append((m["flagname"], *v.span(v.lastindex)))
            out.append(("other", "", m.start(), at))
        elif m["triple"]:
            q = m["triple"]
            close = text.find(q, at, end) if closed_until[q] <= at else -1
            if close < 0:
                closed_until[q] = end
            else:
                out.append(("string", "", at, close))
                at = close + 3
        elif m["quote"]:
            q = m["quote"]
            s = STRING[q].match(text, at, end) if closed_until[q] <= at else None
            if s is None:
                line = text.find("\n", at, end)
                closed_until[q] = end if q == "`" or line < 0 else line
                out.append(("other", q, m.start(), at))
            else:
                out.append(("string", "", at, s.end() - 1))
                at = s.end()
        elif m["name"]:
            out.append(("name", m["name"], m.start(), at))
        elif m["op"]:
            out.append(("op", m["op"], m.start(), at))
        elif m["line"]:
            out.append(("line", "\n", m.start(), at))
        elif kind != "space":
            out.append(("other", m[0], m.start(), at))
    return out, pairs


def _target(text: str, t: list, i: int) -> str:
    """The name that the assignment operator at place i is for, if any."""
    j = i - 1
    if j < 0:
        return ""
    if t[j][0] == "string":
        return text[t[j][2]:t[j][3]]
    if t[j][1] == "]" and j >= 1:  # a subscript names its target, an empty or numeric one leaves the name before
        if j >= 2 and t[j - 1][0] == "string" and t[j - 2][1] == "[":
            return text[t[j - 1][2]:t[j - 1][3]]
        k = j - 1 if t[j - 1][1] == "[" else j - 2
        j = k - 1 if k >= 1 and t[k][1] == "[" else -1
    elif t[j][1] == "?":  # an optional field
        j -= 1
    if j < 0 or t[j][0] != "name":
        return ""
    if t[i][1] == "=":
        k = j
        while k >= 1 and t[k - 1][1] in ("|", ".") and t[k - 2][0] == "name" and k >= 2:  # A | B
            k -= 2
        if k >= 2 and t[k - 1][1] == ":" and t[k - 2][0] == "name":  # name: type = value
            return t[k - 2][1]
        if j >= 2 and t[j - 1][0] == "name" and t[j - 2][1] in ("var", "let", "const", "val"):  # var name type = value
            return t[j - 1][1] if t[j - 2][1] == "var" else t[j][1]
    return t[j][1]


def _value(t: list, i: int, bare: bool, closes: dict[int, int], runs: Runs) -> list[tuple[int, int] | str]:
    """The parts of the value that begins at place i: strings, names to resolve, or a bare word up to the end of its run."""
    parts, depth, joint = [], 0, True
    while i < len(t):
        kind, word, a, b = t[i]
        if kind == "string":
            parts.append((a, b))
            joint = False
        elif kind == "op" and word == "(" and joint:
            depth += 1
        elif kind == "op" and word == ")" and depth:
            depth -= 1
        elif kind == "op" and word in JOINS or word == "or":
            joint = True
        elif kind == "line" and (depth or joint and parts):
            pass
        elif kind == "name" and joint and word in ("await", "return", "new") and not parts:
            pass
        elif kind == "name" and joint:
            following = t[i + 1] if i + 1 < len(t) else ("line", "\n", b, b)
            if following[0] == "string" and following[2] - b <= 3 and len(word) <= 2:  # r"...", b'...'
                pass
            elif following[1] == "(" and following[2] == b:  # a call's result is not known
                if i + 1 not in closes:
                    break
                i, joint = closes[i + 1], False
            else:
                stop = runs.end_of(a)
                if stop > b and not depth and following[0] != "string":  # the name only begins a bare word
                    if "." not in word or DIGIT.search(word):
                        parts.append((a, stop))
                    return parts
                parts.append(word + "[" * (following[1] == "[" and following[2] == b))  # no name has a bracket, so a subscript gets no value
                joint = False
        elif kind in ("other", "op") and joint and not parts and not depth and (stop := runs.end_of(a)) > a:
            return [(a, stop)] if bare else []
        else:
            break
        i += 1
    return parts


def _bare(t: list, i: int, name: str, parts: list) -> bool:
    """Whether the one name after the operator at place i may be a bare literal."""
    if len(parts) != 1 or not isinstance(parts[0], str) or i + 2 < len(t) and t[i + 2][0] != "line":
        return False
    own_line = i == 1 or i >= 2 and (t[i - 2][0] == "line" or t[i - 2][1] == "export")
    if t[i][1] == "=" and own_line and t[i - 1][3] == t[i][2] and t[i][3] == t[i + 1][2] and name == name.upper():
        return "." not in parts[0] and "[" not in parts[0]
    return not SIGNS.search(parts[0]) and len(DIGIT.findall(parts[0])) >= 2


def lex(text: str, start: int = 0, end: int | None = None, depth: int = DEPTH) -> list[Value]:
    """The values that names get, in the order of their places; those in strings included."""
    end = len(text) if end is None else end
    t, pairs = tokens(text, start, end)
    found = [Value(n, a, [(a, b)]) for n, a, b in pairs]
    inside = [(a, b) for _, a, b in pairs]
    closes, opened, taken, runs = {}, [], 0, Runs(text, end)
    for i, (kind, word, _, _) in enumerate(t):
        if kind == "op" and word == "(":
            opened.append(i)
        elif kind == "op" and word == ")" and opened:
            closes[opened.pop()] = i
    for i, (kind, word, a, b) in enumerate(t):
        if kind == "string":
            inside.append((a, b))
            if i >= 3 and t[i - 1][1] == "," and t[i - 2][0] == "string" and t[i - 3][1] == "(":  # f("name", "value")
                found.append(Value(text[t[i - 2][2]:t[i - 2][3]], a, [(a, b)]))
            elif i >= 2 and t[i - 1][1] == "(" and t[i - 2][0] == "name" and (m := SETTER.match(t[i - 2][1])):
                found.append(Value(m[1], a, [(a, b)]))
        elif kind == "op" and word in ASSIGNS and i + 1 < len(t) and t[i + 1][0] != "line" or kind == "op" and word in ("=", ":") and i + 2 < len(t) and t[i + 2][0] == "string":
            name = _target(text, t, i)
            if not name or word == ":" and a < taken:  # a colon in a bare word
                continue
            last = next((k for k in range(i + 1, min(i + 4, len(t))) if t[k][0] == "line" or t[k][1] in (",", ";", "}")), min(i + 4, len(t)))
            if word == ":" and t[i + 1][0] == "name" and i + 2 < len(t) and t[i + 2][1] in ("=", "[", "|"):
                continue  # a type; the sign after it assigns
            parts = _value(t, i + 1, word != ":" or last < i + 4, closes, runs)
            if parts and not (word == ":" and isinstance(parts[0], str) and last > i + 2):  # prose goes on after its colon
                found.append(Value(name, a, parts, _bare(t, i, name, parts)))
                taken = max(taken, parts[-1][1] if not isinstance(parts[-1], str) else 0)
    if depth:
        for a, b in inside:
            if re.search(r"[=:]", text[a:b]):
                found += lex(text, a, b, depth - 1)
    return found


class Names:
    """Values by name, each name resolved at a place."""

    def __init__(self, text: str, values: list[Value]):
        self.text, self.of = text, {}
        for v in sorted(values, key=lambda v: v.at):
            self.of.setdefault(v.name, []).append(v)
        self.places = {n: [v.at for v in vs] for n, vs in self.of.items()}

    def value(self, name: str, at: int) -> Value | None:
        if name not in self.of:
            return None
        return self.of[name][max(0, bisect_left(self.places[name], at) - 1)]

    def children(self, v: Value) -> list[Value]:
        return [c for p in v.parts if isinstance(p, str) and (c := self.value(p, v.at)) is not None]

    def stats(self, top: Value) -> tuple[Counter, int, str, str]:
        """Of the joined literals; a name that stands for itself, along whatever way, adds nothing."""
        todo, open_ = [top], set()
        while todo:
            v = todo[-1]
            if v.stats is not None:
                todo.pop()
            elif id(v) in open_:
                v.stats = joined([literal_stats(self.text[p[0]:p[1]]) if not isinstance(p, str) else c.stats if (c := self.value(p, v.at)) is not None and c.stats else (Counter(), 0, "", "") if c is not None else self._bare(v, p) for p in v.parts])
                todo.pop()
            else:
                open_.add(id(v))
                todo += [c for c in self.children(v) if c.stats is None and id(c) not in open_]
        return top.stats

    @staticmethod
    def _bare(v: Value, name: str) -> tuple[Counter, int, str, str]:
        """A name that gets no value is a bare literal where the syntax allows one."""
        return literal_stats(name) if v.bare else (Counter(), 0, "", "")

    def literals(self, top: Value) -> Iterator[tuple[int, int]]:
        """Places of its literals, without those that an earlier call gave."""
        todo = [top]
        while todo:
            v = todo.pop()
            if v.told:
                continue
            v.told = True
            todo += self.children(v)
            for p in v.parts:
                if not isinstance(p, str):
                    yield p
                elif v.bare and p not in self.of:
                    at = self.text.find(p, v.at)
                    yield at, at + len(p)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def named_spans(text: str) -> list[tuple[str, int, int]]:
    if not re.search(HINT, text):  # without such a word no name has a weight
        return []
    names = Names(text, lex(text))
    found = {("named", *m.span(1)) for m in USERINFO.finditer(text) if score("password", literal_stats(m[1])) >= THRESHOLD}
    found |= {("named", *m.span()) for m in KEY_BLOCK.finditer(text)}
    weights: dict[str, float] = {}
    for vs in names.of.values():
        for v in vs:
            if weights.setdefault(v.name, name_weight(v.name)) and score(v.name, names.stats(v)) >= THRESHOLD:
                found.update(("named", a, b) for a, b in names.literals(v) if b > a)
    return sorted(found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, spans (array of kind, start, end in code points) by start, then kind.

    A null text counts as empty, and an empty one has no spans. Repeated rows give repeated results, ids may be null or
    tied, other columns are not read, so their names can't clash. An empty table gives no rows. Very long texts are read
    whole, in time linear in their length. Texts without any sign of a secret are told apart by one Arrow pass.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rank = {k: i for i, k in enumerate(KINDS)}
        for b in batches:
            texts = pc.fill_null(b[1], "")
            hits = pc.indices_nonzero(pc.match_substring_regex(texts, GATE))
            rows: list = [[]] * b.num_rows
            for i, text in zip(hits.to_pylist(), texts.take(hits).to_pylist()):
                found = base_spans(text) + named_spans(text)
                rows[i] = [{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], rank[x[0]], x[2]))]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(rows, kind)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
