"""Secret scans by assignment-aware lexing.

Each text is lexed into name-literal pairs: configuration lines, source
assignments, object entries, keyword arguments, comparisons, calls with a name
and a default, and markup. Constants propagate
(``A = "..."`` then ``password = A``; adjacent and ``+``-joined literals), and a
literal's score combines how sensitive its target name is with how secret-like
the joined literal is. Each part of a literal at or above the threshold becomes
a span of kind ``named`` beside the three base kinds, which always stay.

Defined results: null text counts as empty; empty texts have no spans and the
digest of the empty string; every row keeps one output row, repeated or not;
an empty input gives an empty output. Whole texts are scanned, whatever their
length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import joined_spans, ship, text_of

#: The base patterns; letters of the names in either case, ASCII only.
_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({_NAME})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches as HEX followed by the length test: runs are maximal.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

#: Weights of sensitive words in a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0, "authkey": 0.9, "bearer": 0.8, "auth": 0.6, "pin": 0.4, "key": 0.4, "salt": 0.5, "cookie": 0.5,
}
#: Names that end so hold a measure, a place or a label, not the secret itself.
BENIGN = frozenset("count counts length len size limit ttl expiry expires timeout type name names url uri path file filename field header index max min regex pattern prefix suffix label hint prompt policy".split())
#: Words of names whose secrets may be digits alone.
DIGITS = frozenset("pin otp passcode password passwd pwd passphrase".split())
#: Texts without any of these hold no sensitive name.
_SENSITIVE_PART = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|pin|salt|cookie|identified", re.I)
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\w+|\$?\{.*\}|\$\(.*\)|%\(.*\)s|%\w+%|none|null|true|false|todo|tbd|changeme|change_me|example.*|your[_-]?.*|placeholder.*|dummy.*|sample.*|(?:os\.)?(?:process\.)?env(?:iron)?[.:].*)$", re.I)
#: Names written as values: ``session-token``, ``ACCESS_TOKEN``.
_IDENTIFIER = re.compile(r"[a-z]+(?:[-_. /][a-z]+)*|[A-Z]+(?:_[A-Z]+)*")
_URL = re.compile(r"[A-Za-z][\w+.-]*://[^/@]*(?:/|$)")

_LEX = re.compile(
    r"""(?P<comment>(?:^|(?<=\s))(?:\#|//))
      | (?P<quote>(?<![\w$])[rRbBuUfFL]{1,2}(?:\"\"\"|\'\'\'|["'])|\"\"\"|\'\'\'|["`]|(?<!\w)')
      | (?P<assign>:=|=>|->|\+=|===|!==|==|!=|<=|>=|[=:])
      | (?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-(?=[A-Za-z]))[A-Za-z_$][\w$]*)*)
      | (?P<number>\d[\w.]*)
      | (?P<plus>\+|\.\.)
      | (?P<newline>\n)
      | (?P<other>[^\s])""",
    re.X | re.M,
)
#: What may follow an opening quote, up to where the closing one must stand.
_BODY = {
    '"': re.compile(r'(?:[^"\\\n]++|\\[\s\S])*+'), "'": re.compile(r"(?:[^'\\\n]++|\\[\s\S])*+"), "`": re.compile(r"[^`]*+"),
    '"""': re.compile(r'(?:[^"\\]++|\\[\s\S]|"(?!""))*+'), "\'\'\'": re.compile(r"(?:[^'\\]++|\\[\s\S]|'(?!''))*+"),
}
#: A whole configuration line with a bare value; ``#`` and ``;`` end it only after a space.
_BARE_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*([^\s\"'(){}\[\]]{5,}[^\s\"'(){}\[\];,])[;,]?[ \t]*(?:[#;][^\n]*)?$", re.M)
#: An element or tag of markup, up to its text.
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*+)[^<>]*+>([^<>\s]{6,})?(</\1\s*+>)?")
_ATTRIBUTE = re.compile(r"(?<![\w.:-])([\w.:-]++)\s*+=\s*+(?:\"([^\"<>]*+)\"|'([^'<>]*+)')")
#: Places where a name-literal pair may stand: an operator, or a literal first in a call.
_TRIGGER = re.compile(r"[=:]|\([ \t]*[\"']|\.equals")
#: A type between a colon and ``=``: ``str``, ``Option<&'static str>``, ``string | null``.
_TYPE_ARGS = r"[^\n=\"`<>\[\]]{0,200}"
for _ in range(3):  # nested brackets, each read one way only
    _TYPE_ARGS = rf"(?:[^\n=\"`<>\[\]]|[<\[]{_TYPE_ARGS}[>\]]){{0,200}}"
_TYPE_NAME = rf"(?:[&*]|'\w+[ \t]+|(?:mut|const|dyn|readonly)[ \t]+)*([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)(?:[<\[]{_TYPE_ARGS}[>\]])*[?!]*"
_TYPED = re.compile(rf"[ \t]*{_TYPE_NAME}(?:[ \t]*\|[ \t]*{_TYPE_NAME})*[ \t]*=(?![=>])")
_NEXT_JOINS = re.compile(r"[ \t]*(?:\+(?![+=])|\.\.)")
#: Words that may stand between a name and its ``=`` (lower case), that open a declaration, or whose colon opens a block.
_TYPES = frozenset("str string char wchar varchar varchar2 nvarchar text bytes bytestring byte rune any object int long number as array slice".split())
_DECLARES = frozenset("var let val dim declare const".split())
_BLOCKS = frozenset("if elif else case while for with try default except when".split())
#: Last words of calls whose first two literals are a name and its value (or its default).
_CALLS = frozenset("get getenv getordefault get_or_default setdefault set put setproperty getproperty setenv putenv env environ add append header setheader config param option define".split())
#: Values under a name that stand in none of the lexer's forms.
_BLOCK = re.compile(r"^([ \t]*+)(?:-[ \t]++)?([A-Za-z_][\w.-]*+):[ \t]++[|>][-+0-9]*+[ \t]*+((?:\n\1[ \t]++\S[^\n]*+)++)", re.M)
_DASHED = re.compile(r"^([ \t]*+)(?:-[ \t]++)?([A-Za-z_][\w.-]*+):[ \t]*+((?:\n\1[ \t]*+-[ \t]++[^\s:#][^\n:#]*+(?=\n|\Z))++)", re.M)
_LIST = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)[\"']?\s*+[:=]\s*+[\[({]((?:\s*+(?:\"[^\"\n]*+\"|'[^'\n]*+')\s*+,?)++)\s*+[\])}]")
_INDEXED = re.compile(r"(?<![\w.-])([A-Za-z_][\w.]*+)\[\s*+[\"'][^\"'\]\n]*+[\"']\s*+\]\s*+=\s*+([\"'])([^\"'\n]*+)\2")
_WORDED = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)[ \t]++(?:to|is|as|by)[ \t]++([\"'])([^\"'\n]*+)\2", re.I)
_SQL = re.compile(r"(?<!\w)(?:identified[ \t]++by|password)[ \t]++'([^'\n]*+)'", re.I)
_OPTION = re.compile(r"(?<!\S)--?([A-Za-z][\w-]*+)(?:=|[ \t]++)([\"']?)([^\s\"']++)\2(?!\S)")
_HEADER = re.compile(r"authorization[\"']?[ \t]*+[:=][ \t]*+[\"']?(?:bearer|basic|token|apikey)[ \t]++([^\s\"'<>]++)", re.I)
_CREDENTIALS = re.compile(r"(?<![\w+.-])[A-Za-z][\w+.-]*+://[^\s/:@\"'<>]*+:([^\s/@\"'<>]++)@")
_QUOTED = re.compile(r"\"([^\"\n]*+)\"|'([^'\n]*+)'")
THRESHOLD = 0.6
#: Characters of a joined value that are kept from either end; what else is scored, its length and character counts, is exact.
ENDS = 128
#: Lengths and counts of joined values stop growing here (a constant may double itself on every line).
SATURATED = 1 << 40


@lru_cache(maxsize=100_000)
def name_score(name: str) -> float:
    """How sensitive a target name is: its best word, words joined pairwise too; 0 for measures, places and labels."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if not words or words[-1] in BENIGN:
        return 0.0
    joined = words + [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in joined), default=0.0)


class Value:
    """A literal, or a join of such; a join refers to its parts and copies none of their text but their ends."""

    __slots__ = ("counts", "head", "parts", "size", "span", "tail")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()) -> None:
        self.span, self.parts = span, parts
        if not parts:
            self.size, self.head, self.tail, self.counts = len(text), text, "", None
            return
        self.size = min(SATURATED, sum(p.size for p in parts))
        self.counts = Counter()
        for p in parts:
            for c, n in (Counter(p.head) if p.counts is None else p.counts).items():
                self.counts[c] = min(SATURATED, self.counts[c] + n)
        ends = [p.head if p.counts is None else (p.head, p.tail) for p in parts]
        if self.size <= ENDS:
            self.head, self.tail = "".join(e if isinstance(e, str) else e[0] for e in ends), ""
        else:
            self.head = self.tail = ""
            for e in ends:
                if len(self.head) < ENDS:
                    self.head += e[:ENDS] if isinstance(e, str) else e[0]
            for e in reversed(ends):
                if len(self.tail) < ENDS:
                    self.tail = (e[-ENDS:] if isinstance(e, str) else e[1] or e[0]) + self.tail
            self.head, self.tail = self.head[:ENDS], self.tail[-ENDS:]

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        return parts[0] if len(parts) == 1 else cls(parts=tuple(parts))


def literal_score(value: str | Value, name: str = "") -> float:
    """How secret-like a literal is: length, variety of classes and entropy; prose, placeholders, plain URLs and names score low."""
    size = counts = None
    if isinstance(value, Value):
        size, counts = value.size, value.counts
        # Of a long join the patterns see the ends.
        value = value.head + value.tail if counts is not None and size > ENDS else value.head
    if value.lstrip().startswith("-----BEGIN") and "PRIVATE KEY" in value[:80]:
        return 1.0
    if counts is None or size <= ENDS:
        value = value.strip()
        counts, size = Counter(value), len(value)
    if size < 6 or any(c.isspace() for c in counts) or _URL.match(value):
        return 0.0
    if _PLACEHOLDER.match(value) and (len(counts) == 1 or len(set(value)) > 1):
        return 0.0
    if all(c.isdigit() for c in counts) and not DIGITS & {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)}:
        return 0.3
    if size < 24 and _IDENTIFIER.fullmatch(value):
        return 0.5
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values() if n < size)
    seen = "".join(counts)
    classes = sum(map(bool, (re.search(p, seen) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))))
    return min(1.0, 0.35 + 0.03 * min(size, 12) + 0.1 * (classes - 1) + 0.05 * min(entropy, 4.0))


def _declared(names: list[str]) -> list[str]:
    """Names that an assignment right after a run of names may mean: a declaration's types are left out."""
    if names and (names[-1].lower() in _TYPES or names[0].lower() in _DECLARES):
        return [n for n in names if n.lower() not in _TYPES | _DECLARES] or names[-1:]
    return names[-1:]


Pair = tuple[str, Value]


class _Lexer:
    """One pass over a text from one place with an operator to the next."""

    def __init__(self, text: str) -> None:
        self.text, self.found = text, []
        #: Constants seen so far.
        self.constants: dict[str, Value] = {}
        #: Up to where an opening quote of this kind is known to have no closing one.
        self.dead = dict.fromkeys(_BODY, 0)

    def run(self) -> list[Pair]:
        at = 0
        while (t := _TRIGGER.search(self.text, at)) is not None:
            at = self._statement(self.text.rfind("\n", at, t.start()) + 1 or at)
        return self.found

    def _string(self, quote: str, at: int) -> int | None:
        """The end of a literal's body that starts at ``at``; None if it never closes."""
        if at < self.dead[quote]:
            return None
        end = _BODY[quote].match(self.text, at).end()
        if not self.text.startswith(quote, end):
            # A later quote of this kind would be an escaped one and never close either.
            self.dead[quote] = end
            return None
        return end

    def _flush(self) -> None:
        if self.targets and self.value:
            # The most sensitive name; of equals the last.
            name, joined = max(reversed(self.targets), key=name_score), Value.joined(self.value)
            self.found.append((name, joined))
            if not self.compared:
                for n in self.targets:
                    self.constants[n] = self.constants[n.rsplit(".", 1)[-1]] = joined
        self.targets, self.value, self.joining, self.compared, self.fresh = [], [], False, False, False

    def _statement(self, at: int) -> int:
        """Lex from a line's start until a line end at which nothing is open; the place after it."""
        text, size = self.text, len(self.text)
        #: The run of names that ends here, and those that the open assignment may mean.
        names: list[str] = []
        self.targets, self.value = [], []
        self.joining = self.compared = self.fresh = closed = False
        depth, called, first = 0, "", None
        tokens = _LEX.finditer(text, at)
        while (t := next(tokens, None)) is not None:
            kind, word = t.lastgroup, t.group()
            if kind == "newline":
                more = text[t.end():t.end() + 1] not in ("", "\n") and self.targets and (
                    self.fresh if not self.value else self.joining or depth > 0 or _NEXT_JOINS.match(text, t.end()))
                if not more:
                    self._flush()
                    return t.end()
                continue
            if kind == "quote":
                quote = word.lstrip("rRbBuUfFL")
                end = self._string(quote, t.end())
                if end is None:
                    names, self.fresh = [], False
                    continue
                tokens = _LEX.finditer(text, end + len(quote))
                body = text[t.end():end]
                if self.targets:
                    lead = len(body) - len(body.lstrip()) if len(quote) == 3 else 0
                    tail = len(body) - len(body.rstrip()) if len(quote) == 3 else 0
                    self.value.append(Value(body[lead:len(body) - tail], (t.end() + lead, end - tail) if lead + tail < len(body) else None))
                    self.joining = False
                else:
                    names, closed = [body] if re.fullmatch(r"[A-Za-z_][\w.-]*", body) else [], False
                    first = body if called and names else None
                    called = ""
            elif kind == "assign" and word in ("=", ":", ":=", "=>", "+=", "==", "===", "!=", "!=="):
                if names and not (closed and word == ":"):
                    self._flush()
                    self.targets, self.fresh, self.compared = _declared(names), True, word in ("==", "===", "!=", "!==")
                    if word == ":" and names[0].lower() not in _BLOCKS and (typed := _TYPED.match(text, t.end())):
                        self.targets += [n for n in (typed.group(1),) if n.lower() not in _TYPES]
                        tokens = _LEX.finditer(text, typed.end())
                    names = []
                first = None
            elif kind == "name":
                if self.targets and (not self.value or self.joining) and word in self.constants:
                    self.value.append(self.constants[word])
                    self.joining = False
                else:
                    if self.value:
                        self._flush()
                    names, closed, self.fresh = [*names[-7:], word], False, False
                first, called = None, ""
            elif kind == "plus":
                self.joining = True
            elif kind == "comment" or kind == "other" and word in ",;)}":
                self._flush()
                if word == "," and first is not None:
                    # The second literal of a call belongs to the first one's name.
                    self.targets, self.compared = [first], True
                depth -= word in ")}"
                # A closed index or call may be assigned to.
                closed = word == ")"
                names = names if closed else []
                first, called = None, ""
            elif kind == "other" and word in "([{":
                last = names[-1] if names else ""
                called = last.rsplit(".", 1)[-1].lower() in _CALLS if word == "(" else ""
                depth += word != "["
                if word == "(" and last.endswith(".equals"):
                    self._flush()
                    self.targets, self.compared = [last.removesuffix(".equals")], True
                else:
                    self.targets = [] if word == "{" else self.targets
                names = [] if word != "[" and not (names and names[-1].lower() in _TYPES) else names
            else:
                self.fresh = self.fresh and kind == "other" and word == "-"
                first = None
        self._flush()
        return size


def _markup(text: str) -> Iterator[Pair]:
    """Elements and name-value attributes of markup."""
    for m in _TAG.finditer(text):
        if m.group(2) and m.group(3):
            yield m.group(1), Value(m.group(2), m.span(2))
        end = m.start(2) if m.group(2) else m.end()
        if "=" not in text[m.start():end]:
            continue
        found = {a.group(1).lower(): a for a in _ATTRIBUTE.finditer(text, m.start(), end)}
        named, valued = found.get("name") or found.get("key"), found.get("value") or found.get("content")
        if named:
            name = named.group(2) or named.group(3) or ""
            if valued:
                g = 2 if valued.group(2) is not None else 3
                yield name, Value(valued.group(g), valued.span(g))
            elif m.group(2):
                yield name, Value(m.group(2), m.span(2))


def _marked(value: str) -> bool:
    """A bare word or path of names is a reference rather than a literal."""
    return bool(re.search(r"[0-9]|[^\w.-]", value))


def _singular(name: str) -> str:
    return name[:-1] if name[-1:] in "sS" else name


def _other_forms(text: str) -> Iterator[Pair]:
    """Blocks and lists under a name, indexed names, SQL, command-line options, headers, credentials in URLs."""
    if ":" in text:
        for m in _BLOCK.finditer(text):
            for line in re.finditer(r"\S[^\n]*", text[m.start(3):m.end(3)]):
                yield m.group(2), Value(line.group().rstrip(), (m.start(3) + line.start(), m.start(3) + line.start() + len(line.group().rstrip())))
        for m in _DASHED.finditer(text):
            for item in re.finditer(r"\n[ \t]*-[ \t]+[\"']?([^\s\"']+)[\"']?[ \t]*(?=\n|$)", text[m.start(3):m.end(3)]):
                if _marked(item.group(1)):
                    yield _singular(m.group(2)), Value(item.group(1), (m.start(3) + item.start(1), m.start(3) + item.end(1)))
        for m in _HEADER.finditer(text):
            yield "token", Value(m.group(1), m.span(1))
    for m in _LIST.finditer(text):
        for item in _QUOTED.finditer(text, *m.span(2)):
            g = 1 if item.group(1) is not None else 2
            yield _singular(m.group(1)), Value(item.group(g), item.span(g))
    for pattern in (_INDEXED, _WORDED):
        for m in pattern.finditer(text):
            yield m.group(1), Value(m.group(3), m.span(3))
    for m in _SQL.finditer(text):
        yield "password", Value(m.group(1), m.span(1))
    if "-" in text:
        for m in _OPTION.finditer(text):
            if _marked(m.group(3)):
                yield m.group(1), Value(m.group(3), m.span(3))


def _credentials(text: str) -> Iterator[Pair]:
    for m in _CREDENTIALS.finditer(text):
        yield "password", Value(m.group(1), m.span(1))


def pairs(text: str) -> list[Pair]:
    """(name, value) of assignments in a text, constants propagated.

    Read are assignments, object entries, keyword arguments, comparisons with a
    literal, calls such as ``get("name", "default")``, whole configuration lines
    with a bare value, markup and the forms of ``_other_forms``. Literals may be
    joined, triple-quoted or stand on the next line. Parts stand where they were
    written: that of a constant is its definition. The time is in proportion to
    the text's length.
    """
    found = _Lexer(text).run()
    found += [(m.group(1), Value(m.group(2), m.span(2))) for m in _BARE_LINE.finditer(text) if _marked(m.group(2))]
    if "</" in text or "/>" in text:
        found += _markup(text)
    found += _other_forms(text)
    return found


def named_spans(text: str) -> list[tuple[int, int]]:
    found = _credentials(text) if "://" in text and "@" in text else iter(())
    if _SENSITIVE_PART.search(text):
        found = chain(found, pairs(text))
    # Values are kept while they are known by their identity.
    spans, seen, kept = set(), set(), []
    for name, value in found:
        n = name_score(name)
        if n and n * literal_score(value, name) >= THRESHOLD:
            # Parts that stand in several secrets are walked once.
            left = [value]
            while left:
                v = left.pop()
                if id(v) not in seen:
                    seen.add(id(v))
                    kept.append(v)
                    left += v.parts
                    if v.span is not None and v.span[0] < v.span[1]:
                        spans.add(v.span)
    return sorted(spans)


def scan(text: str) -> dict:
    """Base counts and spans of one text, and all spans."""
    base: list[tuple[int, int, str, int]] = []
    base += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    n_assign = len(base)
    base += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    n_access = len(base) - n_assign
    base += [(m.start(), 2, "hex", m.end()) for m in LONG_HEX.finditer(text)]
    named = [(s, 3, "named", e) for s, e in named_spans(text)]
    return {
        "n_assign": n_assign, "n_access": n_access, "n_hex": len(base) - n_assign - n_access,
        "base_sha256": hashlib.sha256(joined_spans(base).encode()).hexdigest(), "spans": joined_spans(base + named), "n_named": len(named),
    }


def redact(text: str, mark: str = "<secret>") -> str:
    """The text with every span of every kind replaced; overlapping spans as one."""
    spans = sorted((int(s), int(e)) for s, e in (x.split(":")[1:] for x in scan(text)["spans"].split(",") if x))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan(t) for t in b.column("text").to_pylist()]
        cols = {"doc_id": b.column("doc_id")}
        for k in ("n_assign", "n_access", "n_hex"):
            cols[k] = pa.array([r[k] for r in rows], pa.int64())
        for k in ("base_sha256", "spans"):
            cols[k] = pa.array([r[k] for r in rows], pa.string())
        cols["n_named"] = pa.array([r["n_named"] for r in rows], pa.int64())
        yield pa.RecordBatch.from_pydict(cols)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans. One pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; nothing else of a text changes.

    Null and empty texts and texts without secrets stay as they are; ``n_chars``
    follows a changed text; every row keeps one row, and an empty table stays empty.
    """
    ship(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    sized = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column("text").to_pylist()
            new = [None if t is None else redact(t) for t in old]
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(new, b.column("text").type)
            if sized:
                kept = b.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([k if a == z else len(z) for a, z, k in zip(old, new, kept)], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)
