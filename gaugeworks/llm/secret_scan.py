"""Secrets in text: three fixed patterns and an assignment-aware lexer.

The base patterns find assignments to five names, access keys and long
hexadecimal runs.  The lexer adds literals.  It reads source and configuration
syntax into (names, parts) pairs:

* targets: ``name =``, ``name:``, ``name :=``, ``name =>``, quoted and indexed
  names (``"name":``, ``x["name"] =``), chains (``a = b = ...``),
  ``<name>text</name>`` and ``key="name" value="..."``;
* values: strings in any quote with escapes, triple-quoted strings over lines,
  prefixes (``r"..."``), bare words, and sums of these by ``+`` or by standing
  one behind the other;
* a word that is the name of an earlier constant stands for it: its literals
  are parts of the value, so ``other = name + "x"`` hands both on.

A value is scored by the most sensitive of its target names and by the best
look of its joined literals and of the constants in it.  If it reaches the cut,
each of its literals is a span of kind ``literal``, whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._words import slices, tidy

# The three patterns; a match fails if what is named here is shorter.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so the bound can be in the pattern
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")

#: Parts of names, in lower case, and how sensitive a target they make.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "credential": 3, "privatekey": 3, "apikey": 3, "accesskey": 3,
    "token": 2.5, "bearer": 2.5, "authkey": 2.5, "signingkey": 2.5, "encryptionkey": 2.5, "connectionstring": 2, "auth": 1.5, "pass": 1.5,
}
#: Shorter literals are not scored.
CUT, LEAST_LITERAL, LEAST_WORD = 4.0, 6, 16

# No bounds on lengths: a run of name characters is tried at its start only, parts that no name begins with apart, and nothing
# that has been taken is given back, so the time stays linear.
_NAME = r"(?<![A-Za-z0-9_.\-])(?:[.\-]++|[0-9][A-Za-z0-9_]*+(?=[.\-]))*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)"
_OPERATOR = r"\x20*+(?::=|=>|=(?![=>~])|:(?!:))"
_TARGET = re.compile(rf"""(?P<quote>["']?){_NAME}(?P=quote)\]?+{_OPERATOR}|<(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]*+)>(?P<body>[^<>\n]++)</(?P=tag)>""")
_CHAIN = re.compile(rf"(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+){_OPERATOR}")
_QUOTED = "|".join(rf"{q}[^{q}\n\\]*+(?:\\.[^{q}\n\\]*+)*+{q}" for q in "\"'`")
_TRIPLE = "|".join(rf"{q}{q}{q}(?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+{q}{q}{q}" for q in "\"'")
_STRING = re.compile(rf"(?:[rRbBfFuU]{{1,2}})?+(?:(?P<triple>{_TRIPLE})|(?P<plain>{_QUOTED}))", re.DOTALL)
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]]++""")
_REFERENCE = re.compile(r"[A-Za-z_][A-Za-z_.]*")
_SPACES, _JOINT = re.compile(r"[\x20\t]*+"), re.compile(r"[\x20\t]*+\+\s*+|(?=[\x20\t]*+[rRbBfFuU]{0,2}[\"'])[\x20\t]*+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|todo|your[-_].*|<.*>|\$\{.*\}|env.*|https?://.*)$")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, each leftmost first and without overlap among its own kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((v for part, v in SENSITIVE.items() if part in flat), default=0.0)


def look(value: str) -> float:
    """How much a literal looks like a secret: entropy per character, mixed kinds of characters, no spaces."""
    if len(value) < LEAST_LITERAL or _PLACEHOLDER.match(value):
        return -10.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy / 2, 2.0) + 0.5 * (kinds > 1) + 0.5 * (re.search("[0-9]", value) is not None) - 1.5 * (" " in value)


def _value(text: str, at: int, constants: dict[str, int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """The literals of the value that begins at ``at``, the values of the constants in it, and where it ends."""
    parts: list[tuple[int, int]] = []
    held: list[int] = []
    while True:
        at = _SPACES.match(text, at).end()
        string = _STRING.match(text, at)
        if string:
            kind = "triple" if string["triple"] else "plain"
            edge = 3 if string["triple"] else 1
            parts.append((string.start(kind) + edge, string.end(kind) - edge))
            at = string.end()
        else:
            word = _BARE.match(text, at)
            if not word:
                return parts, held, at
            end = word.end()
            while end > at and text[end - 1] in ".:!?":
                end -= 1
            raw = text[at:end]
            if text[word.end() : word.end() + 1] not in ("(", "["):  # else it is a call or an index
                if raw in constants:
                    held.append(constants[raw])
                elif raw and not (_REFERENCE.fullmatch(raw) and len(raw) < LEAST_WORD):
                    parts.append((at, end))
            at = word.end()
        more = _JOINT.match(text, at)
        if not more or not (more[0].strip() or string):
            return parts, held, at
        at = more.end()


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that are assigned, at once or through constants, to a sensitive name.

    A name's last assignment counts; a name that is assigned to itself keeps
    what it had.  A bare word of letters alone, of fewer than ``LEAST_WORD``,
    that is no constant is a reference to something unknown, not a literal.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    constants: dict[str, int] = {}
    # of each value: its own literals, the values of constants in it, and the best look of any of them
    own: list[list[tuple[int, int]]] = []
    held: list[list[int]] = []
    best: list[float] = []
    looks: dict[str, float] = {}
    marked: list[int] = []
    at, label, label_end = 0, "", -1
    while m := _TARGET.search(text, at):
        if m["tag"]:
            names, parts, inner, at = [m["tag"]], [m.span("body")], [], m.end()
        else:
            names, at = [m["name"]], m.end()
            while chain := _CHAIN.match(text, _SPACES.match(text, at).end()):
                names.append(chain["name"])
                at = chain.end()
            parts, inner, at = _value(text, at, constants)
            if names[0].lower() in ("value", "content") and label and not text[label_end : m.start()].strip(", \t\n\"'"):
                names = [label]
            elif names[0].lower() in ("key", "name") and len(parts) == 1:
                label, label_end = text[slice(*parts[0])], at
        value = "".join(text[i:j] for i, j in parts)
        if value not in looks:
            looks[value] = look(value)
        constants.update(dict.fromkeys(names, len(own)))
        own.append([p for p in parts if p[1] > p[0]])
        held.append(inner)
        best.append(max([looks[value], *(best[k] for k in inner)]))
        weight = max(map(sensitivity, names))
        if weight and weight + best[-1] >= CUT:
            marked.append(len(own) - 1)
    found: set[tuple[int, int, str]] = set()
    seen = set(marked)
    while marked:
        k = marked.pop()
        found.update((i, j, "literal") for i, j in own[k])
        marked += [x for x in held[k] if x not in seen]
        seen.update(held[k])
    return sorted(found)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spelled(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, code points, end exclusive, by start and then kind, joined by commas."""
    return ",".join(f"{kind}:{i}:{j}" for i, j, kind in ordered(spans))


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mask."""
    out, done = [], 0
    for i, j, _ in sorted(spans):
        if i >= done:
            out += [text[done:i], mask]
        done = max(done, j)
    return "".join([*out, text[done:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id``, counts of the base kinds, ``n_literal``, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans.  Other columns are not read; no shuffle.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    kinds = Counter(k for _, _, k in base)
                    more = literal_spans(text or "")
                    rows.append((kinds["assign"], kinds["access"], kinds["hex"], len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], ["id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(tidy(run), f"id {df.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redacted(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df``, all rows and columns, with secrets in ``text_col`` masked; a null text stays null."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [t if t is None else redact(t, base_spans(t) + literal_spans(t), mask) for t in batch.column(text_col).to_pylist()]
                at = batch.schema.get_field_index(text_col)
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(tidy(run), df.schema)
