"""Assignment-aware secret scans.

Base kinds are three patterns over whole texts. On top of them a small lexer reads source and
configuration syntax into name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``export NAME=x``, ``name => x``), follows names that are assigned other names to
their constants, and scores every literal by the most sensitive name it reaches. Literals that
score ``THRESHOLD`` or more become spans of kind ``literal``.

The lexer runs on texts that hold the letters of a sensitive name, with any separators a name may
have between them; others can have no sensitive target.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sigtide.llm.arrow import extended, map_arrow

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")
MASK = "[secret]"

# fixed values: parts of target names and how sensitive they are
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8,
    "connectionstring": 0.8, "clientsecret": 1.0,
}
THRESHOLD = 0.55
# names that hold no other one, and what takes breaks out of names and lowers A-Z
_STEMS = [k.encode() for k in SENSITIVE if not any(o != k and o in k for o in SENSITIVE)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAKS = b"0123456789_.$-"
_NAME = r"[A-Za-z_$][A-Za-z0-9_.$-]*"
_PAIR = re.compile(
    rf"(?<![A-Za-z0-9_.$-])[\"']?({_NAME})[\"']?[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*"
    rf"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([A-Za-z0-9+/_.=$-]+))")


def _parts(name: str) -> set[str]:
    """Words of a target name (camelCase and separators), and neighbouring words joined."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    return {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}


def name_score(name: str) -> float:
    return max((SENSITIVE.get(p, 0.0) for p in _parts(name)), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, character classes, entropy. 0 to 1."""
    if len(value) < 6 or value.isspace() or re.fullmatch(r"(.)\1*|[A-Za-z]+\.\.\.|<.*>|\$\{.*\}",
                                                         value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]"))
    return min(1.0, entropy / 4) * (0.4 if " " in value else 1.0) * (0.5 if kinds < 2 else 1.0)


def pairs(text: str) -> list[tuple[str, str | None, str | None, int, int]]:
    """(target, literal or None, name or None, start, end) of every assignment, in order.

    A bare identifier on the right is a name, anything else a literal.
    """
    out = []
    for m in _PAIR.finditer(text):
        group = next(g for g in (2, 3, 4, 5) if m[g] is not None)
        bare = group == 5 and re.fullmatch(_NAME, m[5]) is not None
        out.append((m[1], None if bare else m[group], m[5] if bare else None, *m.span(group)))
    return out


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target, directly or through names."""
    if not _may_assign(text) or not _may_score(text):
        return []
    found, constant, flow, reach = set(), {}, {}, {}
    for target, literal, name, start, end in pairs(text):
        if literal is not None:
            constant[target] = (start, end, literal)
            _changed(target, constant, reach)
            if name_score(target) * literal_score(literal) >= threshold:
                found.add((start, end))
            continue
        # the constant the right side holds at this point, through chains of names
        held = constant.get(_holder(name, constant, flow, reach))
        flow[target] = name
        constant.pop(target, None)
        if held:
            constant[target] = held
        _changed(target, constant, reach)
        if held:
            if name_score(target) * literal_score(held[2]) >= threshold:
                found.add(held[:2])
        elif name_score(target) * literal_score(name) >= threshold and re.search("[0-9]", name):
            found.add((start, end))  # an unquoted value that merely looks like a name
    return sorted(found)


def _holder(name: str, constant: dict, flow: dict, reach: dict) -> str | None:
    """The first name along ``flow`` that holds a constant; ``reach`` keeps it for all names passed."""
    passed = {}
    while name not in constant and name not in reach and name in flow and name not in passed:
        passed[name] = None
        name = flow[name]
    end = name if name in constant else reach.get(name)
    passed[name] = None
    reach.update(dict.fromkeys(passed, end))
    return end


def _changed(target: str, constant: dict, reach: dict) -> None:
    """Forget what names reach when that of ``target`` is another now."""
    now = target if target in constant else None
    if reach.get(target, now) != now:
        reach.clear()


def _may_assign(text: str) -> bool:
    """Every assignment holds one of these signs."""
    return "=" in text or ":" in text


def _may_score(text: str) -> bool:
    """Every name with a score is a sensitive one once breaks are taken out."""
    packed = text.encode("utf-8", "surrogatepass").translate(_LOWER, _BREAKS)
    return any(stem in packed for stem in _STEMS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind in the order listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
           if m.end(2) - m.start(2) >= LEAST_ASSIGN] if _may_assign(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, both in order. Offsets are code points, ends exclusive."""
    base = base_spans(text)
    more = [(a, b, "literal") for a, b in literal_spans(text)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = MASK) -> str:
    """The text with every span, overlapping ones merged, replaced by ``mask``."""
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[at:a], mask]
            end = b
        end = max(end, b)
        at = end
    return "".join(out) + text[at:] if out else text


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_FOUND = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string",
          "spans": "string", "clean_text": "string"}


def scan(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = tuple(_FOUND),
         prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the chosen columns of ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans`` and ``clean_text`` (the redacted text), found in every whole text.

    NULL texts count as empty (no spans, and an empty clean text). Repeated rows are scanned each.
    A new column whose name exists already raises; choose a ``prefix``. Empty tables give no rows.
    Memory is that of one Arrow batch and one text's spans.
    """
    names = [prefix + c for c in columns]
    schema = extended(docs.schema, {c: _FOUND[c] for c in columns}, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for t in batch.column(text).to_pylist():
                t = t or ""
                base, every = find(t)
                count = Counter(s[2] for s in base)
                row = {"n_assign": count["assign"], "n_access": count["access"],
                       "n_hex": count["hex"], "spans": listed(every)}
                row["base_sha256"] = hashlib.sha256(listed(base).encode()).hexdigest()
                if "clean_text" in out:
                    row["clean_text"] = redact(t, every)
                for c in columns:
                    out[c].append(row[c])
            added = [pa.array(out[c], pa.string() if _FOUND[c] == "string" else pa.int64())
                     for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             [*batch.schema.names, *names])

    return map_arrow(docs, run, schema)
