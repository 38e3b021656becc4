"""What an export does inside a string, in a fixed order, and the scan that everything written must pass.

Order: declared sensitive values, correlations, secrets, local paths, local users, length. Values and correlations are
found by one automaton in one pass over the text; the finds are placed in a map of spans by priority (values before
correlations, longer before shorter, then from the left) and no find may touch a span that is taken. So overlapping
values are all taken out as far as they can be, and what replaces one is never read as another. Secrets, paths and
users need what stands around them and see the text with its marks, which they pass over or swallow whole.

Defined results: a null text is null with counts of zero; empty values and correlations are ignored; sources of
correlations below ``LEAST`` characters are rewritten only where they are the whole text; lengths are bytes of UTF-8,
cut before a character that would not fit. The declared strings are parameters: they travel with the task, and more than
``DECLARED_BYTES`` of them are an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import redaction
from tracemill.sources.shipping import ship

SECRET, PATH, USER = redaction.MARK, "[LOCAL_PATH]", "[LOCAL_USER]"
LEAST = 8
DECLARED_BYTES = 32 << 20
COUNTS = ("redacted_secret", "rewritten_correlation", "redacted_local_identifier", "truncated")
# fixed values: the published patterns of local paths and of users, quoted in four ways or bare
_BLANK = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_IN = _BLANK[1:-1]
LOCAL_PATH = re.compile(rf"(^|[{_IN}\"'=:(+\-])(?:[A-Za-z]:\\(?:[^\\{_IN}\"']+\\)*[^\\{_IN}\"']*|/(?!/)[^{_IN}\"']+)")
_NAMED = rf"(?:user(?:name)?|owner|login){_BLANK}*[:=]"
LOCAL_USER = (
    re.compile(rf"(?i)({_NAMED}{_BLANK}*\\\")(?!\[LOCAL_USER\]\\\")(?:(?!\\\")[^\r\n])*(\\\")"),
    re.compile(rf"(?i)({_NAMED}{_BLANK}*\\')(?!\[LOCAL_USER\]\\')(?:(?!\\')[^\r\n])*(\\')"),
    re.compile(rf"(?i)({_NAMED}{_BLANK}*\")(?!\[LOCAL_USER\]\")(?:\\.|[^\"\\])*(\")"),
    re.compile(rf"(?i)({_NAMED}{_BLANK}*')(?!\[LOCAL_USER\]')(?:\\.|[^'\\])*(')"),
    re.compile(rf"(?i)({_NAMED})(?!{_BLANK}*\[LOCAL_USER\]){_BLANK}*[^{_IN},\"'}}\]\\]+()"),
)
# fixed values: fields whose presence fails the scan, whatever the record
HIDDEN_FIELD = re.compile(
    r"(?i)\"(?:chain[_-]?of[_-]?thought|extended[_-]?thinking|hidden[_-]?reasoning|encrypted[_-]?(?:reasoning|thinking)|reasoning(?:[_-]?(?:content|details|signature))?"
    r"|thinking(?:[_-]?(?:content|signature))?|text[_-]?signature|thought[_-]?signature|raw[_-]?(?:api|request|response)[_-]?body)\"\s*:"
)


@dataclass(frozen=True)
class Rules:
    """values: to be taken out; correlations: source and replacement; identifiers: users that are a whole text."""

    values: tuple[str, ...] = ()
    correlations: tuple[tuple[str, str], ...] = ()
    identifiers: tuple[str, ...] = ()
    max_bytes: int | None = None
    in_text: bool = True

    def __post_init__(self):
        size = sum(len(s.encode()) for s in (*self.values, *(x for c in self.correlations for x in c), *self.identifiers))
        if size > DECLARED_BYTES:
            raise ValueError(f"{size} bytes of declared strings, more than {DECLARED_BYTES}")


@dataclass
class Declared:
    """The automaton over a rule set's strings; each has its rank and what replaces it."""

    rules: Rules
    replacement: dict[str, tuple[int, str, str]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        rank = 0
        for value in sorted({v for v in self.rules.values if v}, key=lambda v: (-len(v), v)):
            self.replacement[value] = (rank, SECRET, "redacted_secret")
            rank += 1
        self.whole = {s: r for s, r in self.rules.correlations if s and s not in self.replacement}
        if self.rules.in_text:
            for source, new in self.rules.correlations:
                if len(source) >= LEAST and source not in self.replacement:
                    self.replacement[source] = (rank, new, "rewritten_correlation")
                    rank += 1
        self.automaton = ahocorasick.Automaton() if self.replacement else None
        if self.automaton is not None:
            for s, (r, _, _) in self.replacement.items():
                self.automaton.add_word(s, (r, s))
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and string of the finds that stand, in order."""
        if self.automaton is None:
            return []
        finds = sorted((r, end + 1 - len(s), s) for end, (r, s) in self.automaton.iter(text))
        taken: list[tuple[int, int, str]] = []
        used = bytearray(len(text)) if len(finds) > 1 else b""
        for _, start, s in finds:
            end = start + len(s)
            if not used or not (used[start] or used[end - 1] or 1 in used[start:end]):
                taken.append((start, end, s))
                if used:
                    used[start:end] = b"\x01" * len(s)
        return sorted(taken)

    def apply(self, text: str, counts: dict[str, int]) -> str:
        if text in self.whole:
            counts["rewritten_correlation"] += 1
            return self.whole[text]
        out, at = [], 0
        for start, end, s in self.spans(text):
            _, new, action = self.replacement[s]
            out += [text[at:start], new]
            counts[action] += 1
            at = end
        return "".join([*out, text[at:]]) if out else text


@lru_cache(maxsize=4)
def declared(rules: Rules) -> Declared:
    return Declared(rules)


def bounded(text: str, max_bytes: int) -> str:
    """The longest beginning that fits."""
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= max_bytes else raw[:max_bytes].decode("utf-8", "ignore")


def rewrite(text: str | None, rules: Rules) -> tuple[str | None, dict[str, int]]:
    """One string, in the order above, and how often each action was taken."""
    counts = dict.fromkeys(COUNTS, 0)
    if text is None:
        return None, counts
    text = declared(rules).apply(text, counts)
    text, n, _ = redaction.redact(text)
    counts["redacted_secret"] += n
    for pattern, mark in ((LOCAL_PATH, PATH), *((p, USER) for p in LOCAL_USER)):
        text, n = pattern.subn(lambda m, mark=mark: m[1] + mark + (m[2] if m.re.groups > 1 else ""), text)
        counts["redacted_local_identifier"] += n
    if text in rules.identifiers:
        text, counts["redacted_local_identifier"] = USER, counts["redacted_local_identifier"] + 1
    if rules.max_bytes is not None:
        cut = bounded(text, rules.max_bytes)
        text, counts["truncated"] = cut, int(cut != text)
    return text, counts


def rewritten(df: DataFrame, column: str, rules: Rules, actions: str = "actions") -> DataFrame:
    """The frame with the column's strings rewritten, and a struct of how often each action was taken."""
    ship(df.sparkSession)

    @F.pandas_udf("struct<text: string, " + ", ".join(f"{c}: long" for c in COUNTS) + ">")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [rewrite(t if isinstance(t, str) else None, rules) for t in s]
        return pd.DataFrame({"text": [t for t, _ in rows]} | {c: [n[c] for _, n in rows] for c in COUNTS})

    found = df.withColumn("__rewritten", run(F.col(column)))
    return found.withColumns({column: F.col("__rewritten.text"), actions: F.struct(*(F.col(f"__rewritten.{c}") for c in COUNTS))}).drop("__rewritten")


# fixed values: what marks a harness's private reasoning in its records
CODEX_FIELDS = frozenset(("content", "delta", "encryptedcontent", "summary", "text"))
CODEX_DELTA = "item/reasoning/textDelta"
PI_FIELDS = frozenset(("encryptedreasoning", "encryptedthinking", "reasoningcontent", "reasoningdetails", "reasoningsignature", "thinkingcontent", "thinkingsignature", "textsignature", "thoughtsignature"))
PI_TYPES = frozenset(("thinking", "thinkingstart", "thinkingdelta", "thinkingend", "reasoning", "reasoningstart", "reasoningdelta", "reasoningend"))
PI_CONTENT = frozenset(("content", "delta", "encryptedcontent", "reasoning", "signature", "summary", "text", "thinking", "thinkingsignature"))
DEVIN_THOUGHT = "agent_thought_chunk"
FACTORY_TYPES = frozenset(("thinkingtextdelta", "thinkingtextcomplete", "thinking", "redactedthinking"))
FACTORY_FIELDS = frozenset(("signature", "thoughtsignature", "geminithoughtsignature", "openaiencryptedcontent", "openaireasoningid", "openaireasoningsummary", "chatcompletionreasoningcontent", "chatcompletionreasoningfield"))
FACTORY_PLAIN = frozenset(("type", "messageId", "blockIndex", "id"))
# a capture's own client and records carry its name before these
FACTORY_SOURCE = re.compile(r"factory-droid|\w+-factory-client")
FACTORY_SCHEMA = re.compile(r"\w+\.factory-runtime/v1")
FACTORY_RAW = re.compile(r"(?i)thinking[_-]?text|openaiEncryptedContent|chatCompletionReasoningContent")
CHECKS = ("sensitive-value", "secret", "local-path", "local-identifier", "correlation", "hidden-field", "codex-reasoning", "pi-reasoning", "devin-thought", "factory-reasoning", "unreadable")


@dataclass(frozen=True)
class Record:
    """An object in a walk: its fields, their names in plain letters, and what it inherits."""

    fields: dict
    names: frozenset[str]
    factory: bool

    @property
    def kind(self) -> str:
        kind = self.fields.get("type")
        return redaction.normalized(kind) if isinstance(kind, str) else ""


def _names(record: object) -> frozenset[str]:
    return frozenset(map(redaction.normalized, record)) if isinstance(record, dict) else frozenset()


def _codex(r: Record) -> bool:
    if r.fields.get("type") == "reasoning" or r.fields.get("channel") == "analysis":
        if r.names & CODEX_FIELDS:
            return True
    return r.fields.get("method") == CODEX_DELTA and any(_names(r.fields.get(k)) & CODEX_FIELDS for k in ("params", "payload"))


def _pi(r: Record) -> bool:
    return bool(r.names & PI_FIELDS) or (r.fields.get("thought") is True or r.kind in PI_TYPES) and bool(r.names & PI_CONTENT)


def _devin(r: Record) -> bool:
    return r.fields.get("sessionUpdate") == DEVIN_THOUGHT and "content" in r.fields


def _factory(r: Record) -> bool:
    block = r.kind in FACTORY_TYPES
    if block and r.fields.keys() - FACTORY_PLAIN or (r.names & FACTORY_FIELDS) - (frozenset() if r.factory or block else {"signature"}):
        return True
    raw = r.fields.get("raw")
    if "raw" in r.fields and r.factory:
        return True
    if not isinstance(raw, str):
        return False
    try:
        return "factory-reasoning" in private(json.loads(raw))
    except ValueError:
        return bool(FACTORY_RAW.search(raw))


#: Checks of one record; those of the first kind look into strings that hold JSON, too.
EMBEDDED = {"codex-reasoning": _codex, "devin-thought": _devin}
PLAIN = EMBEDDED | {"pi-reasoning": _pi, "factory-reasoning": _factory}


def private(value: object) -> set[str]:
    """Which harness's private reasoning a value holds."""
    found: set[str] = set()
    left = [(value, False, PLAIN)]
    while left:
        at, factory, checks = left.pop()
        if isinstance(at, str) and at.lstrip()[:1] in ("{", "["):
            try:
                left.append((json.loads(at), False, EMBEDDED))
            except ValueError:
                continue
        elif isinstance(at, list):
            left += [(v, factory, checks) for v in at]
        elif isinstance(at, dict):
            factory = factory or _says(at.get("source"), FACTORY_SOURCE) or _says(at.get("schemaVersion"), FACTORY_SCHEMA)
            r = Record(at, _names(at), factory)
            found |= {name for name, check in checks.items() if check(r)}
            left += [(v, factory, checks) for v in at.values()]
    return found


def _says(value: object, pattern: re.Pattern) -> bool:
    return isinstance(value, str) and pattern.fullmatch(value) is not None


def strings(value: object) -> Iterator[str]:
    """Every string of a value, names of fields among them; a secret field's value that isn't a mark gives an assignment."""
    left = [value]
    while left:
        at = left.pop()
        if isinstance(at, str):
            yield at
        elif isinstance(at, list):
            left += at
        elif isinstance(at, dict):
            for k, v in at.items():
                left += [k, v]
                if redaction.is_secret_field(k) and v != SECRET:
                    yield 'password="(secret field)"'


def _finds(texts: Iterable[str]) -> set[str]:
    out = set()
    for t in texts:
        if redaction.has_secret(t):
            out.add("secret")
        if LOCAL_PATH.search(t):
            out.add("local-path")
        if any(p.search(t) for p in LOCAL_USER):
            out.add("local-identifier")
    return out


def failures(text: str | None, rules: Rules, media: str = "text/plain") -> list[str]:
    """The checks that a written text fails, in their order; JSON is looked at decoded, line by line where it is lines."""
    if text is None:
        return []
    sought = declared(rules)
    out = set()
    for _, (_, s) in sought.automaton.iter(text) if sought.automaton is not None else ():
        out.add("sensitive-value" if sought.replacement[s][2] == "redacted_secret" else "correlation")
    if HIDDEN_FIELD.search(text):
        out.add("hidden-field")
    if media == "text/plain":
        out |= _finds([text])
    else:
        for part in [text] if media == "application/json" else filter(None, re.split(r"\r?\n", text)):
            try:
                value = json.loads(part)
            except ValueError:
                out.add("unreadable")
                continue
            out |= _finds(strings(value)) | private(value)
    return [c for c in CHECKS if c in out]


def scanned(df: DataFrame, column: str, rules: Rules, media: Column | str = "text/plain") -> DataFrame:
    """Adds ``failed``: the checks that the column's text fails. Whatever has any must not leave."""
    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([failures(t if isinstance(t, str) else None, rules, k if isinstance(k, str) else "text/plain") for t, k in zip(texts, kinds, strict=True)])

    return df.withColumn("failed", run(F.col(column), F.lit(media) if isinstance(media, str) else media))


def assert_clean(df: DataFrame, column: str, rules: Rules, media: Column | str = "text/plain") -> None:
    """An error naming the checks that any row fails, and how many rows do."""
    found = scanned(df, column, rules, media).select(F.explode("failed").alias("check")).groupBy("check").count().collect()
    if found:
        raise ValueError("the final scan failed: " + ", ".join(f"{r['check']} ({r['count']})" for r in sorted(found)))
